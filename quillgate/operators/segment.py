"""Text to blocks to sections, heading ids and name spaces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

FENCE = r"\A {0,3}(`{3,}|~{3,})"
HEADING_LINE = rf"(?md)^( {{0,3}}#{{1,6}}{X.WS_LINE}+[^{X.WS_CHARS}][^\n]*)$"
BLANK_LINE = rf"\n{X.WS_LINE}*(?=\n)"
LEVELS = 6


def _fences(lines: Column) -> Column:
    """array<struct<a, b>>: lines a to b - 1 of each code fence, in order. A line's effect on the fence that is open depends on its mark alone, so only
    lines with a mark are folded: where none is open, a mark opens one; an open one closes on a mark of its kind, at least as long, that
    is all there is on its line; other marks change nothing. A fence that nothing closes runs to the end."""
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.left(x["line"], F.lit(6)).rlike(FENCE))  # a pattern is tried at every place of a line, wherever it must begin
    marks = F.transform(marked, lambda x: F.struct(x["at"].alias("at"), F.regexp_extract(x["line"], FENCE, 1).alias("mark"), X.trim(x["line"]).alias("bare")))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    state = lambda open_, at, done: F.struct(open_.alias("open"), at.cast("int").alias("at"), done.alias("done"))

    def step(s, m):
        closes = (s["open"] != "") & m["mark"].startswith(F.left(s["open"], F.lit(1))) & (F.length(m["mark"]) >= F.length(s["open"])) & (m["bare"] == m["mark"])
        return F.when(s["open"] == "", state(m["mark"], m["at"], s["done"])).when(closes, state(F.lit(""), m["at"], F.array_append(s["done"], span(s["at"], m["at"] + 1)))).otherwise(s)

    start = state(F.lit(""), F.lit(0), F.array().cast("array<struct<a:int,b:int>>"))
    return F.aggregate(marks, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], span(s["at"], F.size(lines)))))


def _open_text(text: Column) -> Column:
    """Blocks of a text outside of fences: heading lines alone, others parted by blank lines."""
    apart = X.let(text, lambda t: F.when(F.contains(t, F.lit("#")), F.regexp_replace(t, HEADING_LINE, "\n$1\n")).otherwise(t))
    return F.filter(F.transform(F.split(apart, BLANK_LINE), X.trim), lambda b: b != "")


def _fenced_text(lines: Column) -> Column:
    """Blocks of a text with fences: what stands between them as `_open_text` says, each fence as one block."""
    joined = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n")

    def pieces(spans):
        def piece(k):
            before = F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k - 1)["b"])
            here = F.get(spans, k)
            return F.concat(_open_text(joined(before, F.coalesce(here["a"], F.size(lines)))), F.when(here.isNotNull(), F.array(X.trim(joined(here["a"], here["b"])))).otherwise(F.array().cast("array<string>")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), piece))

    return X.let(_fences(lines), pieces)


def block_list(text: Column) -> Column:
    """The blocks of a text as an array: blank lines part them, a heading line stands alone, a code fence is one block. Null gives none."""
    marks = lambda t: F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~"))
    return X.let(X.normalize(F.coalesce(text, F.lit(""))), lambda t: F.when(marks(t), X.let(F.split(t, "\n"), _fenced_text)).otherwise(_open_text(t)))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_pos, block) of docs(key, text, ...), where each text is read: no shuffle, whether it holds fences or not."""
    rows = docs.select(F.col(key), F.posexplode_outer(block_list(F.col(text))).alias("block_pos", "block"))
    return rows.where("block is not null")  # of a plain posexplode the planner asks first, by a filter of its own, whether the array is empty, and so makes it twice


def section_list(blocks_: Column, texts: bool = True, closing: bool = False) -> Column:
    """array<struct<sec_pos, heading, level, text>>: a heading opens a section; text before the first one has heading ''. sec_pos counts the headings so
    far. Without `texts`, text is left empty. `closing` is that of `heading`."""
    section = lambda pos, heading, level, text: F.struct(pos.cast("bigint").alias("sec_pos"), heading.alias("heading"), level.cast("int").alias("level"), (text if texts else F.lit("")).alias("text"))
    told = F.filter(F.transform(blocks_, lambda b, i: F.struct(i.alias("at"), X.heading(b, closing).alias("head"))), lambda x: x["head"].isNotNull())

    def cut(heads):
        body = lambda a, b: F.array_join(F.slice(blocks_, a + 1, b - a), "\n\n")
        first = F.coalesce(F.get(heads, F.lit(0))["at"], F.size(blocks_))
        none = F.array().cast("array<struct<sec_pos:bigint,heading:string,level:int,text:string>>")
        opening = F.when(first > 0, F.array(section(F.lit(0), F.lit(""), F.lit(1), body(F.lit(0), first)))).otherwise(none)
        return F.concat(opening, F.transform(heads, lambda h, k: section(k + 1, h["head"]["title"], h["head"]["level"], body(h["at"] + 1, F.coalesce(F.get(heads, k + 1)["at"], F.size(blocks_))))))

    return X.let(told, cut)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", closing: bool = False) -> DataFrame:
    """(key, sec_pos, heading, level, text) of docs(key, text, ...): `section_list` of each text's blocks, made where the text is read."""
    return docs.select(F.col(key), F.explode_outer(X.let(block_list(F.col(text)), lambda b: section_list(b, closing=closing))).alias("s")).where("s is not null").select(key, "s.*")


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sec_pos, heading, level): `sections` without the texts, which are not put together."""
    found = X.let(block_list(F.col(text)), lambda b: section_list(b, texts=False))
    return docs.select(F.col(key), F.explode_outer(found).alias("s")).where("s is not null").select(key, "s.sec_pos", "s.heading", "s.level")


def free_name(base, used):
    """base, or base-2, base-3, ... : the first that is not in the array `used`."""
    tries = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda n: F.concat(base, F.lit("-"), n.cast("string")))
    return F.when(~F.array_contains(used, base), base).otherwise(F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), F.lit(0)))


def heading_ids(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sec_pos, id) of headings(key, sec_pos, heading, level): the ids of the headings above, joined by '/', 'section' where a level is left out, and
    made unique within a document in its order by the first free of -2, -3, ...

    Ids of one level have one number of parts, so they meet only others of their level below the same parent: level by level, windows give a heading the last
    one of each level above it, and its number among those of the same slug there. That number is the suffix unless some other slug of the
    level is the same but for a number at its end and one of them is repeated; documents with such a level are folded heading by heading.
    Levels beyond 6 count as 6, those below 1 as 1.
    """
    rows = headings.select(F.col(key), F.col("sec_pos").cast("bigint").alias("sec_pos"), F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.col("level").cast("int"))).alias("level"), X.slugify(F.col("heading")).alias("slug"))
    rows = rows.repartition(F.col(key)).withColumn("family", F.regexp_replace("slug", r"(-[0-9]+)+\z", ""))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, "level", "family", "slug").orderBy("sec_pos")))
    family = Window.partitionBy(key, "level", "family")
    rows = rows.withColumn("mixed", (F.max("nth").over(family) > 1) & (F.min("slug").over(family) != F.max("slug").over(family)))
    rows = rows.withColumn("mixed", F.max("mixed").over(Window.partitionBy(key))).drop("family", "nth")
    return _ids_by_windows(rows.where("not mixed"), key).unionByName(_ids_by_fold(rows.where("mixed"), key))


def _ids_by_windows(rows: DataFrame, key: str) -> DataFrame:
    above = Window.partitionBy(key).orderBy("sec_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(key, "sec_pos", "level", "slug", F.lit("").alias("parent"), F.lit(None).cast("string").alias("id"))
    for level in range(1, LEVELS + 1):
        here = F.col("level") == level
        nth = F.row_number().over(Window.partitionBy(key, here, "parent", "slug").orderBy("sec_pos"))
        name = F.when(nth == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), nth.cast("string")))
        rows = rows.withColumn("own", F.when(here, name))
        rows = rows.withColumn("id", F.when(here, F.concat("parent", "own")).otherwise(F.col("id")))
        if level < LEVELS:
            last = F.last(F.when(F.col("level") <= level, F.when(here, F.col("own")).otherwise(F.lit("section"))), ignorenulls=True).over(above)
            rows = rows.withColumn("up", F.coalesce(last, F.lit("section")))
            rows = rows.withColumn("parent", F.when(F.col("level") > level, F.concat("parent", "up", F.lit("/"))).otherwise(F.col("parent"))).drop("up")
        rows = rows.drop("own")
    return rows.select(key, "sec_pos", "id")


def id_list(heads: Column) -> Column:
    """The ids of an array of (level, slug) in order, by the rules of `heading_ids`; the work grows with the square of the headings."""
    texts = F.array().cast("array<string>")

    def step(s, h):
        missing = F.greatest(F.lit(0), h["level"] - 1 - F.size(s["path"]))
        above = F.concat(F.slice(s["path"], F.lit(1), h["level"] - 1), F.array_repeat(F.lit("section"), missing))

        def named(base):
            return X.let(free_name(base, s["ids"]), lambda name: F.struct(F.array_append(above, F.substring_index(name, "/", -1)).alias("path"), F.array_append(s["ids"], name).alias("ids")))

        return X.let(F.array_join(F.array_append(above, h["slug"]), "/"), named)

    return F.aggregate(heads, F.struct(texts.alias("path"), texts.alias("ids")), step, lambda s: s["ids"])


def identified(sections_: Column) -> Column:
    """array<struct<id, sec_pos, heading, level, text>> of `section_list`'s sections."""
    level = lambda s: F.greatest(F.lit(1), F.least(F.lit(LEVELS), s["level"]))
    heads = F.transform(sections_, lambda s: F.struct(level(s).alias("level"), X.slugify(s["heading"]).alias("slug")))
    return F.zip_with(sections_, id_list(heads), lambda s, i: F.struct(i.alias("id"), s["sec_pos"].alias("sec_pos"), s["heading"].alias("heading"), s["level"].alias("level"), s["text"].alias("text")))


def identified_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(key, id, sec_pos, heading, level, text) of docs(key, text, ...), each row a document, text empty without `texts`: `sections` with the ids of `heading_ids`, both made where the text is read. For
    documents of some hundred headings, as a compile's inputs are, that is less work than windows over all; for longer ones windows are."""
    found = X.let(X.let(block_list(F.col(text)), lambda b: section_list(b, texts)), identified)
    return docs.select(F.col(key), F.explode_outer(found).alias("s")).where("s is not null").select(key, "s.*")


def keyed_sections(text: Column) -> Column:
    """array<struct<id, sha256>> of a text's sections that have a body, made from the text alone, so that it goes in streams, too."""

    def keyed(found):
        filled = F.filter(found, lambda x: x["text"].rlike(f"[^{X.WS_CHARS}]"))
        return F.transform(filled, lambda x: F.struct(x["id"].alias("id"), F.sha2(x["text"], 256).alias("sha256")))

    return X.let(X.let(X.let(block_list(text), lambda b: section_list(b)), identified), keyed)


def _ids_by_fold(rows: DataFrame, key: str) -> DataFrame:
    """The same for any headings, one document at a time."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sec_pos", "level", "slug"))).alias("heads"))
    ids = id_list(F.col("heads"))
    return listed.select(key, "heads", ids.alias("ids")).select(key, F.explode(F.arrays_zip(F.col("heads.sec_pos").alias("sec_pos"), F.col("ids").alias("id"))).alias("x")).select(key, "x.sec_pos", "x.id")


def unique_names(rows: DataFrame, base: str, order: str, name: str = "name") -> DataFrame:
    """rows with `name`: their base, or the first of base-2, base-3, ... that no row before them in `order` has.

    A name made from a base can only be another row's where that row's base is the name: a base x-k, k a number that x, itself repeated, may come to. All other bases,
    however many they are and often they come, get their numbers by one window. Those so linked are gone through in their order, a family (bases alike but for numbers at
    their end) at a time, with a state of one number for each base.
    """
    counts = rows.groupBy(F.col(base).alias("_base")).agg(F.count("*").alias("_n"))
    cut = lambda k: F.regexp_extract("_base", NUMBERED, k)
    children = counts.where(F.col("_base").rlike(NUMBERED)).select("_base", cut(1).alias("_above"), cut(2).try_cast("bigint").alias("_k"))
    kids = children.groupBy("_above").agg(F.count("*").alias("_kids"))
    repeated = counts.where("_n > 1").join(kids, F.col("_base") == F.col("_above")).select("_above", (F.col("_n") + F.col("_kids") + 1).alias("_most"))
    linked = children.join(repeated, "_above").where("_k <= _most")
    linked = linked.select(F.explode(F.array("_base", "_above")).alias("_base")).distinct().withColumn("_linked", F.lit(True))
    told = rows.join(linked, F.col(base) == F.col("_base"), "left").drop("_base")
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    plain = told.where("_linked is null").select(*rows.columns, nth.alias("_nth"))
    plain = plain.select(*rows.columns, F.when(F.col("_nth") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_nth").cast("string"))).alias(name))
    mixed = told.where("_linked").select(*rows.columns, F.regexp_replace(base, r"(-[0-9]+)+\z", "").alias("_family")).repartition("_family").sortWithinPartitions("_family", order)
    return plain.unionByName(mixed.mapInArrow(_named_in_order(base, rows.columns, name), plain.schema))


# A base and the number at its end, as names are made; longer numbers than these no base comes to.
NUMBERED = r"(?s)\A(.+)-([2-9]|[1-9][0-9]{1,17})\z"


def _named_in_order(base: str, columns: list[str], name: str):
    """A mapInArrow function that names rows sorted by `_family` and order. What is taken is told by the bases that have themselves as a name and by how far each base's
    numbers have come, as all below that number are taken."""
    numbered = re.compile(r"(.+)-([2-9]|[1-9][0-9]{1,17})", re.S)

    def run(batches):
        import pyarrow as pa

        family, own, next_ = None, set(), {}
        for batch in batches:
            names = []
            for fam, b in zip(batch.column("_family").to_pylist(), batch.column(base).to_pylist()):
                if fam != family:
                    family, own, next_ = fam, set(), {}
                cut = numbered.fullmatch(b)
                if b not in own and not (cut and int(cut[2]) < next_.get(cut[1], 2)):
                    own.add(b)
                    names.append(b)
                    continue
                k = next_.get(b, 2)
                while f"{b}-{k}" in own:
                    k += 1
                next_[b] = k + 1
                names.append(f"{b}-{k}")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(names, pa.string())], [*columns, name])

    return run


def name_spaces(files: DataFrame) -> DataFrame:
    """(path, prefix) of files(path), each path once: the slug of what stands below the folder that all paths share, without extension, made unique in the order of paths;
    '' for a single path. The shared folder is what the least and the greatest path share, so no path but these is looked at together with others."""
    rows = files.select("path", F.filter(F.split("path", r"[\\\\/]+"), lambda s: s != "").alias("parts"))
    ends = rows.agg(F.min("parts").alias("a"), F.max("parts").alias("b"), F.min(F.size("parts")).alias("least"), F.count("*").alias("n"))
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("least") - 1)), F.lit(0), lambda n, i: F.when((n == i) & (F.get("a", i) == F.get("b", i)) & (i < F.col("least") - 1), n + 1).otherwise(n))
    ends = ends.select(F.coalesce(same, F.lit(0)).alias("shared"), (F.col("n") > 1).alias("several"))
    rows = rows.join(F.broadcast(ends))  # one row
    last = F.regexp_replace(F.element_at("parts", -1), r"(?s)(?<=.)\.[^.]+\z", "")
    below = F.concat(F.slice("parts", F.col("shared") + 1, F.greatest(F.lit(0), F.size("parts") - F.col("shared") - 1)), F.array(last))
    rows = rows.select("path", "several", X.slugify(F.array_join(F.filter(below, lambda s: s != ""), "-")).alias("slug"))
    return unique_names(rows, "slug", "path").select("path", F.when(F.col("several"), F.col("name")).otherwise("").alias("prefix"))


def namespaced(prefix, id_):
    """An id below its file's name space; an empty prefix leaves it as it is."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", id_).otherwise(F.concat_ws("/", prefix, id_))


def population(sections_: DataFrame) -> DataFrame:
    """Sections with a text that isn't blank."""
    return sections_.where(F.col("text").rlike(f"[^{X.WS_CHARS}]"))
