"""Blocks, sections and heading ids against a plain line-by-line reading, over random texts of awkward lines."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillgate.operators import segment

WHITE = "\t\n\x0b\x0c\r          　﻿"
LINES = [
    "", "", " ", " ", "　 ", "plain words", "a sentence.", "終わり。", "終わり．", "and so on，", "- item", "12) item", "see [x](y)", "# Top", "## Mid ##", "   ### Indented", "    # too far", "#　Wide", "#none", "#",
    "#  ", "###### Six #", "####### seven", "```", "~~~", "````", "```python", "  ```  ", "   ~~~~", "        ```", "~~~ x", "``", "<!-- gone\n# hidden\n-->", "x" * 81, " ", "tail  ", "Ends here:", "\x85", "# A B", "😀" * 41,
]


def clean(raw):
    text = re.sub("\r\n?", "\n", raw.replace("﻿", ""))
    text = re.sub("[ \t]+\n", "\n", re.sub("<!--.*?-->", "", text, flags=re.S))
    return re.sub("\n{3,}", "\n\n", text).strip(WHITE)


def read_blocks(raw):
    done, now, fence = [], [], None

    def close():
        joined = "\n".join(now).strip(WHITE)
        now.clear()
        if joined:
            done.append(joined)

    for line in clean(raw).split("\n"):
        run = re.match(" {0,3}(```+|~~~+)", line)
        bare = line.strip(WHITE)
        if fence:
            now.append(line)
            if run and run[1][0] == fence[0] and len(run[1]) >= len(fence) and bare == run[1]:
                fence = None
                close()
        elif run:
            close()
            now.append(line)
            fence = run[1]
        elif not bare:
            close()
        elif re.match(f" {{0,3}}#{{1,6}}[{WHITE}]+[^{WHITE}]", line):
            close()
            done.append(bare)
        else:
            now.append(line)
    close()
    return done


def read_heading(block):
    found = re.fullmatch(f"(#{{1,6}})[{WHITE}]+([^\n\r  ]+?)[{WHITE}]*#*", block)
    if found:
        return found[2].strip(WHITE), len(found[1])
    units = len(block.encode("utf-16-le")) // 2
    if "\n" in block or units > 80 or block[-1] in ".!?:;,。．！？：；、" or re.match(f"(?:[0-9]+[.)]|[-*+•])[{WHITE}]", block) or "](" in block:
        return None
    return block, 1


def read_sections(raw):
    out, count = [], 0
    for block in read_blocks(raw):
        head = read_heading(block)
        if head:
            count += 1
            out.append([count, *head, ""])
        elif not out:
            out.append([0, "", 1, block])
        else:
            out[-1][3] = f"{out[-1][3]}\n\n{block}" if out[-1][3] else block
    return [tuple(s) for s in out]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    return [None, "", " \n ", "﻿"] + ["\n".join(r.choices(LINES, k=r.randint(1, 14))) for _ in range(700)]


def test_blocks_and_sections(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id int, text string, block string, sec_pos string")
    got = {}
    for row in segment.blocks(docs).collect():
        got.setdefault(row.doc_id, {})[row.block_pos] = row.block
    for i, t in enumerate(texts):
        mine = got.get(i, {})
        assert [mine[k] for k in range(len(mine))] == read_blocks(t or ""), repr(t)
    found = {}
    for row in segment.sections(docs).collect():
        found.setdefault(row.doc_id, []).append((row.sec_pos, row.heading, row.level, row.text))
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == read_sections(t or ""), repr(t)
    assert segment.sections(docs.limit(0)).count() == 0


def test_identified_sections(spark, texts):
    """In place, sections and ids are those that rows and windows give."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, id string")
    rows = segment.sections(docs)
    want = rows.join(segment.heading_ids(rows), ["doc_id", "sec_pos"]).select("doc_id", "id", "sec_pos", "heading", "level", "text")
    assert sorted(map(tuple, segment.identified_sections(docs).collect())) == sorted(map(tuple, want.collect()))


def test_one_rule_with_and_without_fences(spark):
    """A line of white space parts paragraphs in either kind of text; an indented heading stands alone; a fence closes at most three blanks in."""
    plain = "Head words go\nover two lines\n \nthen more\n  ## Sub title\nDetail of it."
    docs = spark.createDataFrame([(1, plain), (2, plain + "\n~~~\nkept # as is\n        ~~~\n~~~\nafter")], "doc_id int, text string")
    rows = segment.blocks(docs).orderBy("doc_id", "block_pos").collect()
    want = ["Head words go\nover two lines", "then more", "## Sub title", "Detail of it."]
    assert [r.block for r in rows if r.doc_id == 1] == want
    assert [r.block for r in rows if r.doc_id == 2] == [*want, "~~~\nkept # as is\n        ~~~\n~~~", "after"]


def test_long_texts(spark):
    lines = ["~~~", "x", "~~~", "words", "", "# H"] * 4000 + [" "] * 20000
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([" ", "y."] * 20000))], "doc_id int, text string")
    assert segment.sections(docs).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 8001), (2, 1)]


def read_ids(headings):
    path, used, out = [], set(), []
    for level, slug in headings:
        path = (path + ["section"] * level)[: level - 1]
        base = "/".join([*path, slug])
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base}-{n}"
        used.add(name)
        out.append(name)
        path.append(name.split("/")[-1])
    return out


def test_heading_ids(spark):
    r = random.Random(4)
    given = []
    for doc in range(500):
        slugs = r.choice([["hive", "comb", "wax"], ["a", "a-2", "a-3", "b"], ["a", "a-2", "a-2-2", "section"], [f"step-{k}" for k in range(9)], ["x"]])
        given.append([(r.randint(1, 6), r.choice(slugs)) for _ in range(r.randint(0, 16))])
    rows = [(d, k, s.replace("-", " "), level, "x") for d, heads in enumerate(given) for k, (level, s) in enumerate(heads)]
    rows += [(None, 0, "Null's own", 1, "x"), (None, 1, "null s own", 1, "x"), (900, 5, "!", 9, "x")]
    got = {}
    for row in segment.heading_ids(spark.createDataFrame(rows, "doc_id int, sec_pos int, heading string, level int, slug string").repartition(6)).collect():
        got.setdefault(row.doc_id, {})[row.sec_pos] = row.id
    for d, heads in enumerate(given):
        assert [got.get(d, {})[k] for k in range(len(heads))] == read_ids(heads), heads
    assert got[None] == {0: "null-s-own", 1: "null-s-own-2"} and got[900] == {5: "section/section/section/section/section/section"}
    plan = segment.heading_ids(spark.range(1).selectExpr("id AS doc_id", "id AS sec_pos", "'a' AS heading", "1 AS level"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_free_name(spark):
    used = spark.createDataFrame([("a", ["a", "a-2"]), ("b", []), ("c", ["c"])], "b string, u array<string>")
    assert [r[0] for r in used.select(segment.free_name(F.col("b"), F.col("u"))).collect()] == ["a-3", "b", "c-2"]


def test_unique_names(spark):
    """Against going through the rows one by one; many rows of one family, and many of one base, take no time that grows with their square."""
    r = random.Random(9)
    given = [r.choice(["a", "a", "a-2", "a-3", "a-2-2", "a-02", "a-1", "a-40", "b", "b-7", "c-2", "c-2", "c", "-2", "d-99999999999999999999"]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(given)), "at int, base string").repartition(7)
    used, want = set(), {}
    for at, base in enumerate(given):
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base}-{n}"
        used.add(name)
        want[at] = name
    assert {x.at: x.name for x in segment.unique_names(rows, "base", "at").collect()} == want
    many = spark.range(60000).selectExpr("id AS at", "CASE WHEN id % 2 = 0 THEN 'doc' WHEN id % 4 = 1 THEN concat('doc-', id % 3000 + 2) ELSE concat('other-', id % 200) END AS base")
    began = time.perf_counter()
    named = segment.unique_names(many, "base", "at")
    assert named.select("name").distinct().count() == 60000 and time.perf_counter() - began < 60
    assert segment.unique_names(rows.limit(0), "base", "at").count() == 0


def test_long_blocks_are_trimmed_without_a_pattern(spark):
    """Blocks of 100,000 characters with white space at their edges, 60 MB in all; the same edges beyond the size where a pattern cuts them."""
    from quillgate.functions import text as X

    words = F.repeat(F.lit("words go here, and there "), 4000)
    docs = spark.range(600, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("```\ncode\n```\n\n 　"), words, F.lit("\t \n \nlast.")).alias("text"))
    rows, took = segment.blocks(docs).select("block_pos", F.length("block").alias("n")), []
    for _ in range(2):
        began = time.perf_counter()
        assert [tuple(r) for r in rows.groupBy("block_pos", "n").count().orderBy("block_pos").collect()] == [(0, 12, 600), (1, 99_999, 600), (2, 5, 600)]
        took.append(time.perf_counter() - began)
    assert min(took) < 8
    long = F.concat(F.lit(" 　\n"), F.repeat(F.lit("a  b "), 300_000), F.lit("c﻿\t "))
    got = spark.range(1).select(X.trim(long).alias("t"), F.repeat(F.lit("a  b "), 300_000).alias("a")).select((F.col("t") == F.concat("a", F.lit("c"))).alias("same")).first()
    assert got.same
