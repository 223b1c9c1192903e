"""URL filters: stated host and path rules, and association rules mined from labelled URLs by FP-growth.

A URL's tokens are the parts of its host, its path's segments, the file's extension and the query's keys, with digits taken for one another. FP-growth over the
labelled URLs' tokens finds the combinations that go with a blocked label often enough (support) and seldom without one (confidence); a rule that
holds all tokens of another says nothing new and goes. An inverted index keeps each rule under its rarest token, so a URL meets only rules whose rarest
token it holds.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, column, stored

BLOCKED = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lowered; empty without a :// or a url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """A URL's distinct tokens, sorted, of all its parts however many; none without a host and a path."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\p{Nd}+", "0")
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    steps = F.filter(F.split(path_, "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x: F.concat(F.lit("path="), plain(x)))
    query_ = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(query_, "&"), lambda x: F.regexp_replace(x, r"(?s)=.*\z", "")), lambda x: x != "")
    kind = F.regexp_extract(path_, r"\.([A-Za-z0-9]+)\z", 1)
    every = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), plain(x))), steps, F.when(kind != "", F.array(F.concat(F.lit("file="), plain(kind)))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("key="), plain(x))),
    )
    return F.array_sort(F.array_distinct(every))


def stated_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does: 'host/path' fits its host and all hosts below it, if the URL's path begins with
    the rule's. Of rules of one length the first in code-point order counts."""
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        here = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        fits.append(F.when(here, F.struct(F.lit(-len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def mined_rules(labelled: DataFrame, least_support: float = 0.001, least_rows: int = 20, least_confidence: float = 0.6) -> DataFrame:
    """(tokens array<string>, n, confidence, lift) of labelled(tokens array<string>, blocked boolean): token combinations of which `least_confidence` or more of the
    rows that hold them are blocked, found in blocked rows at least `least_support` of all rows and `least_rows` times; n counts those. Rules that hold all tokens
    of a rule of equal or higher confidence are left out. Rows with a null label or without tokens say nothing.

    FP-growth's work doubles with each item that goes with others, and a URL has any number of tokens, so it sees only what can be in a rule and once: tokens in blocked rows
    often enough, those that the very same rows hold (told by their number and 128 bits of their hashes) as one. Two of these in one rule say no more than
    one, so the rules found stand for those with any of them in its place.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where("blocked is not null and size(tokens) > 0")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "items")
    total = rows.count()
    none = rows.sparkSession.createDataFrame([], "tokens array<string>, n bigint, confidence double, lift double")
    if not total:
        return none
    least = max(least_support, least_rows / total)
    if least > 1:
        return none
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("b") >= math.ceil(least * total))
    alike = stored(held.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("item"), "members"), "alike")
    items = each.join(alike.select("item", F.explode("members").alias("token")), "token").groupBy("row").agg(F.collect_set("item").alias("found"))
    items = rows.join(items, "row", "left").select(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=least_confidence).fit(stored(items, "itemsets")).associationRules
    found = found.where((F.element_at("consequent", 1) == BLOCKED) & (F.size("consequent") == 1))
    found = stored(found.select(F.array_sort("antecedent").alias("tokens"), F.round(F.col("support") * total).cast("bigint").alias("n"), "confidence", "lift"), "rules")
    # a wider rule is found by each of its tokens' narrower rules, themselves indexed by their first token
    wide = found.select("tokens", "confidence", F.explode("tokens").alias("t"))
    narrow = found.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("as_sure"), F.col("tokens")[0].alias("t"))
    idle = wide.join(narrow, "t").where((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("as_sure") >= F.col("confidence")))
    kept = found.join(idle.select("tokens").distinct(), "tokens", "left_anti")
    # one rule for each choice of a token from each of its items
    choices = kept.select("*", F.explode("tokens").alias("item")).join(alike, "item").groupBy("tokens", "n", "confidence", "lift").agg(F.collect_list("members").alias("members"))
    one_each = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda t: F.array_append(d, t)))))
    return choices.select(F.explode(one_each).alias("tokens"), "n", "confidence", "lift").withColumn("tokens", F.array_sort("tokens"))


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, confidence): each rule under the one of its tokens that the fewest of `urls`(tokens) hold."""
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    named = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    rarest = each.join(named, "token", "left").groupBy("tokens", "confidence").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("r"))
    return rarest.select(F.col("r.token").alias("token"), F.col("tokens").alias("rule"), F.col("confidence").alias("sure"))


def judge(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), key: str = "page_id", url: str = "url",
    least_support: float = 0.001, least_rows: int = 20, least_confidence: float = 0.6,
) -> DataFrame:
    """(key, host, path, rule, verdict, mined, confidence) per row of pages(key, url, ...), judged by the stated `rules` ((verdict, 'host/path'), ...) and, where
    none fits, by what FP-growth finds in labelled(url, blocked): block if a mined rule's tokens are all there, else allow.

    mined is that rule (of several the surest, then the longest, then the first by its tokens) and confidence its confidence, both null where no
    mined rule decides. A null url, or one without ://, has empty host and path, no tokens and the verdict allow. Repeated rows and null keys are
    judged like others; an empty table gives an empty result, no labels no mined rules; other columns are ignored.
    """
    rows = pages.select(column(pages, key, "bigint").alias("key"), column(pages, url, "string").alias("url"))
    learned = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("boolean").alias("blocked"))
    learned = learned.select(tokens(F.col("url"), host(F.col("url")), path(F.col("url"))).alias("tokens"), "blocked")
    with Scratch(pages.sparkSession) as scratch:
        found = stored(index(mined_rules(learned, least_support, least_rows, least_confidence), learned), "index")
        rows = rows.select("key", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        rows = rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
        rows = rows.withColumn("tokens", F.when(F.col("stated").isNull(), tokens(F.col("url"), F.col("host"), F.col("path"))))
        rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", "host", "path", "stated", "tokens")
        met = rows.withColumn("token", F.explode_outer("tokens")).join(found, "token", "left")
        hit = F.when(F.size(F.array_except("rule", "tokens")) == 0, F.struct((-F.col("sure")).alias("sure"), (-F.size("rule")).alias("size"), "rule"))
        out = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("key", "host", "path", "stated")], F.min(hit).alias("hit"))
        verdict = F.coalesce("stated.verdict", F.when(F.col("hit").isNotNull(), F.lit("block")), F.lit("allow"))
        out = out.select(
            F.col("key").alias(key), "host", "path", F.col("stated.rule").alias("rule"), verdict.alias("verdict"), F.col("hit.rule").alias("mined"), (-F.col("hit.sure")).alias("confidence")
        )
        return scratch.keep(out, "judged")
