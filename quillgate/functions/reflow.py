"""Page texts of wrapped lines to paragraphs and headings, as one expression that stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

MOST_HEADING = 60
SHORT = 0.7
# One UTF-16 unit at a seam decides, so characters of two units count as no CJK there.
SEAM = X.CJK.removesuffix("]") + r"&&[\x{0}-\x{FFFF}]]"


def _glued(before: Column, after: Column) -> Column:
    """A line as it goes on the one before it: a blank between them, but not between two CJK characters."""
    cjk = F.right(before, F.lit(1)).rlike(SEAM) & F.left(after, F.lit(1)).rlike(SEAM)
    return F.when(cjk, after).otherwise(F.concat(F.lit(" "), after))


def _blocks(lines: Column) -> Column:
    """Blocks of a page's lines, none of them empty. A line that closes a sentence and is short beside the longest ends its paragraph. Where no
    paragraph is open, a short line of at most 60 units that closes none and is no list item is a heading. Any other line opens a paragraph or goes on with it.

    The fold keeps where the open paragraph began and the spans that are done, not their texts."""
    span = lambda a, b, head: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(head).alias("head"))
    state = lambda open_, done: F.struct(open_.cast("int").alias("open"), done.alias("done"))

    def by_length(longest):
        def told(line, i):
            short = X.utf16_length(line) < longest * F.lit(SHORT)
            ends = F.right(line, F.lit(1)).rlike(X.TERMINAL)
            return F.struct(i.alias("at"), (ends & short).alias("closes"), (short & ~ends & (X.utf16_length(line) <= MOST_HEADING) & ~line.rlike(X.LIST_ITEM)).alias("heading"))

        def step(s, x):
            start = F.when(s["open"] < 0, x["at"]).otherwise(s["open"])
            head = F.array_append(s["done"], span(x["at"], x["at"] + 1, True))
            body = F.array_append(s["done"], span(start, x["at"] + 1, False))
            return F.when((s["open"] < 0) & x["heading"], state(F.lit(-1), head)).when(x["closes"], state(F.lit(-1), body)).otherwise(state(start, s["done"]))

        def rest(s):
            return F.when(s["open"] < 0, s["done"]).otherwise(F.array_append(s["done"], span(s["open"], F.size(lines), False)))

        return F.aggregate(F.transform(lines, told), state(F.lit(-1), F.array().cast("array<struct<a:int,b:int,head:boolean>>")), step, rest)

    def said(s):
        first, more = F.get(lines, s["a"]), s["b"] - s["a"] - 1
        joined = F.array_join(F.zip_with(F.slice(lines, s["a"] + 1, more), F.slice(lines, s["a"] + 2, more), _glued), "")
        return F.when(s["head"], F.concat(F.lit("# "), first)).otherwise(F.concat(first, joined))

    longest = F.coalesce(F.array_max(F.transform(lines, X.utf16_length)), F.lit(0))
    return F.transform(X.let(longest, by_length), said)


def reflow(pages: Column) -> Column:
    """The text of an array of page texts, each normalised and read by itself, blocks parted by blank lines. Null pages and a null array give nothing."""
    lines = lambda page: F.filter(F.transform(F.split(X.normalize(F.coalesce(page, F.lit(""))), "\n"), X.trim), lambda x: x != "")
    found = F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda page: X.let(lines(page), _blocks))
    return F.array_join(F.flatten(found), "\n\n")
