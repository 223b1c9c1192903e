"""Reflow of page texts against a reading line by line."""

import random
import re

from pyspark.sql import functions as F

from quillgate.functions.reflow import reflow

WORDS = ["wax", "comb", "hive", "終わり", "ミツ", "ﾐﾂ", "꿀", "𠮷", "end.", "so;", "then,", "はい。", "well，", "ｘ．", "- item", "3) three", "  ", "", "\u3000", "<!-- no\nneed -->", "\ufeff", "long words that fill the line until its very end here", "b" * 61, "😀😀"]


def read(pages):
    out = []
    for page in pages or []:
        page = re.sub("<!--.*?-->", "", (page or "").replace("\ufeff", "").replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)
        units = lambda t: len(t.encode("utf-16-le")) // 2
        lines = [x for x in (y.strip(" \t\u3000") for y in page.split("\n")) if x]
        longest = max(map(units, lines), default=0)
        para = []
        for line in lines:
            closing = line[-1] in ".!?:;,。．！？：；、"
            short = units(line) < longest * 0.7
            if not para and not closing and units(line) <= 60 and short and not re.match(r"(?:[0-9]+[.)]|[-*+•])\s", line):
                out.append("# " + line)
                continue
            cjk = lambda c: re.match("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff66-\uff9d]", c)
            para.append(line if not para or (cjk(para[-1][-1]) and cjk(line[0])) else " " + line)
            if closing and short:
                out.append("".join(para))
                para = []
        if para:
            out.append("".join(para))
    return "\n\n".join(out)


def test_reflow(spark):
    r = random.Random(6)
    given = [None, [], [None, ""], ["Heading\nthis line wraps over to the\n\nnext one."], ["a\r\nb"]]
    for _ in range(600):
        given.append(["\n".join(" ".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 3))])
    df = spark.createDataFrame(list(enumerate(given)), "i int, pages array<string>")
    for row in df.select("i", reflow(F.col("pages")).alias("t")).collect():
        assert row.t == read(given[row.i]), given[row.i]
    long = spark.createDataFrame([("\n".join(["some words of a line", "short."] * 8000),)], "t string").select(F.length(reflow(F.array("t"))).alias("n")).first()
    assert long.n == 8000 * 27 + 7999 * 2
