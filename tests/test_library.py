"""Golden vectors and small tables for the library's own operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgate import catalog
from quillgate.functions import text as X
from quillgate.operators import gate, markers, segment
from quillgate.plans.questions import CallCap, Calls, Scripted, evaluate
from quillgate.sources.files import extract, first_error, limit_breaches, read_files
from quillgate.sources.html import to_blocks
from quillgate.streaming.incremental import changed_rows


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, X.estimate_tokens, "abcd", "한국어", "한글abcd", "", "😀a") == [1, 3, 3, 0, 1]
    assert one(spark, X.normalize, "﻿a\r\nb\n\n\n\nc", "x <!-- a\nb --> y") == ["a\nb\n\nc", "x  y"]
    assert one(spark, X.slugify, "3.2 Prerequisites & Setup", "설치 방법", "---") == ["3-2-prerequisites-setup", "설치-방법", "section"]
    assert one(spark, X.is_correct, "CORRECT", "correct.", "**CORRECT**", '"CORRECT"', "CORRECT, but", "INCORRECT", "") == [True] * 4 + [False] * 3
    assert one(spark, X.heading_title, "# Title #", "Short line", "A sentence.", "- item", "see [x](y)", "a\nb") == ["Title", "Short line", None, None, None, None]
    assert one(spark, X.anchors, "[§a] x [§b] [§a]") == [["a", "b"]]
    assert one(spark, X.json_span, 'x {"a": 1} y', "```json\n[1]\n```", "none") == ['{"a": 1}', "[1]", None]
    assert one(spark, X.section_ref, "[§a/b]", "§c", " d ") == ["a/b", "c", "d"]
    assert one(spark, X.sanitize, "a\nsk-abcdefghijk token = xyz") == ["a sk-*** token = ***"]
    assert one(spark, X.route, "a.PDF", "b.markdown", "c.htm", "d.bin") == ["pdf", "text", "html", None]
    assert one(spark, X.secret_reason, "x/.env", "id_rsa", "a.txt") == ["env file", "private key file", None]


def test_name_spaces(spark):
    """By hand: the shared folder goes, extensions go, both separators part, and equal slugs get numbers in the order of their paths."""
    cases = [
        {"/srv/bees/hive.md": "hive", "/srv/bees/wax/comb.txt": "wax-comb", "/srv/bees/faq.html": "faq"}, {"/one/file.md": ""}, {"A.md": "a", "a-2.md": "a-2", "a.md": "a-3", "a.txt": "a-4"},
        {"C:\\x\\.env": "env", "C:\\x\\y.tar.gz": "y-tar"}, {"a/b": "b", "a/b/c.d": "b-c"}, {"x/1-2.md": "1-2", "x/1.md": "1", "x/1.txt": "1-3", "x/2.md": "2"}, {"p/!.md": "section", "p/?.md": "section-2"}, {},
    ]
    for case in cases:
        assert {r.path: r.prefix for r in segment.name_spaces(spark.createDataFrame([(p,) for p in case], "path string")).collect()} == case


def test_gate(spark):
    rows = spark.createDataFrame([(10, 9), (10, 8), (0, 0)], "asked long, correct long")
    assert [r[0] for r in rows.select(gate.verdict(F.col("asked"), F.col("correct"), F.lit(0))).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        gate.verdict(F.lit(1), F.lit(1), F.lit(0), 0.4)
    before, after = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in gate.difference(before, after, "k", "v").collect()} == {(1, "missing"), (2, "changed"), (3, "unknown")}


def bundle_rows(spark):
    hive = "Set the hive on a level stand. [§hive]\n**Nectar flow** — weeks in which plants give more than bees eat. [§hive/spring]\n- [RULE] Lift no frame below ten degrees. [§hive]\n- [procedure] Smoke the entrance, wait a minute, open. [§hive/spring]"
    honey = "Comb is ripe when most cells are capped. [§honey]\n\n- [ANTI-PATTERN] Do not heat honey in a pan. [§honey]\n**Étuve** — a warm cupboard. [§honey]\n**Nectar flow** — said again elsewhere. [§honey]\n**apiary** — where hives stand. [§honey]"
    return spark.createDataFrame([(1, "The hive", ["hive", "hive/spring"], hive), (2, "Honey & wax", ["honey"], honey)], "chapter_pos int, title string, section_ids array<string>, body string")


def test_assembly(spark):
    """Every file as a whole; tokens of texts without CJK are a quarter of their characters, rounded up."""
    rows = bundle_rows(spark)
    files = {f.path: f for f in markers.assemble(markers.Bundle("bee-notes", "Bee notes", verified=False), rows).collect()}
    one, two = "`chapters/ch01-the-hive.md`", "`chapters/ch02-honey-wax.md`"
    bodies = [r.body + "\n" for r in rows.orderBy("chapter_pos").collect()]
    assert [files[p.strip("`")].content for p in (one, two)] == bodies
    assert files["glossary.md"].content == "\n".join([
        "# Glossary", "", f"**apiary** — where hives stand. [§honey] ({two})", "", f"**Étuve** — a warm cupboard. [§honey] ({two})", "",
        f"**Nectar flow** — weeks in which plants give more than bees eat. [§hive/spring] ({one}, {two})", "",
    ])
    assert files["patterns.md"].content == f"# Patterns\n\n## Procedures\n\n- Smoke the entrance, wait a minute, open. [§hive/spring] ({one})\n\n## Anti-patterns\n\n- Do not heat honey in a pan. [§honey] ({two})\n"
    assert files["cheatsheet.md"].content == f"# Cheatsheet\n\n- Lift no frame below ten degrees. [§hive] ({one})\n"
    index = files["SKILL.md"].content
    assert index.startswith('---\nname: "bee-notes"\ndescription: "Bee notes"\n---\n\n# Bee notes\n') and "unverified" in index
    assert f"- {one} — The hive (source sections: hive, hive/spring)\n- {two} — Honey & wax (source sections: honey)\n" in index
    assert all(f.est_tokens == -(-len(f.content) // 4) for p, f in files.items() if p != "SKILL.md")
    assert markers.issues(spark.createDataFrame([(f.path, f.content) for f in files.values()], "path string, content string")).count() == 0
    bare = markers.assemble(markers.Bundle("a", "A"), spark.createDataFrame([(1, "T", ["s"], "No marks.")], "chapter_pos int, title string, section_ids array<string>, body string"))
    assert {f.path: f.content for f in bare.collect()}["patterns.md"] == "# Patterns\n\n(no patterns extracted.)\n"


def test_html():
    assert "| a\\| b | c |" in to_blocks("<table><tr><th>a| b</th><th>c</th></tr><tr><td>only</td></tr></table>")
    assert to_blocks("<h1>T</h1><p>one<br>two</p><ul><li>x<ol><li>y</li></ol></li></ul><script>no</script><pre># k</pre>") == "# T\n\none\ntwo\n\n- x\n  1. y\n\n```\n# k\n```"
    assert to_blocks("<p>first line\nsecond&nbsp; line\n\n \u2003third</p><pre>\n\n  kept  in\n place  \n </pre><pre> \n</pre>") == "first line\nsecond line\nthird\n\n```\n  kept  in\n place\n```"


def test_html_of_any_depth():
    """Thousands of elements in each other, lists and pre among them, and every text once."""
    n = 5000
    assert to_blocks("<div>" * n + "x" + "</div>" * n) == "x" and to_blocks("<b>" * n + "y" + "</b>" * n) == "y"
    lists = to_blocks("<ul><li>a" * 1500 + "</ul>" * 1500).split("\n")
    assert lists[0] == "- a" and lists[1499] == "  " * 1499 + "- a" and len(lists) == 1500
    assert to_blocks("<table><tr><td>" + "<i>" * n + "z" + "</i>" * n + "</td></tr></table>") == "| z |\n| --- |"
    assert to_blocks("<form>a<fieldset><legend>b</legend>c</fieldset><center>d</center>e</form>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert to_blocks("<ol><li>p<ul><li>q</li></ul>r<ol><li>s</li><li>t</li></ol></li><li>u</li><ul><li>v</li></ul></ol>") == "1. pr\n  - q\n  1. s\n  2. t\n2. u\n  - v"


def test_html_without_end_tags():
    """Elements end where a browser ends them."""
    assert to_blocks("<p>one<p>two<div>three</div>four") == "one\n\ntwo\n\nthree\n\nfour"
    assert to_blocks("<p>one<b>bold<ul><li>x<p>y<li>z</ul>after") == "onebold\n\n- x y\n- z\n\nafter"
    assert to_blocks("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "- a\n  - b\n  - c\n- d"
    assert to_blocks("<table><thead><tr><th>h<th>i<tbody><tr><td>1<td>2<tr><td>3</table>end") == "| h | i |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n\nend"
    assert to_blocks("<div><table><tr><td>a</div>b<td>c</table>d</div>e") == "| ab | c |\n| --- | --- |\n\nd\n\ne"
    assert to_blocks("<dl><dt>t<dd>d1<dd>d2<dt>u</dl>") == "t\n\nd1\n\nd2\n\nu"
    assert to_blocks("<h1>A<h2>B</h3>c</p>d") == "# A\n\n## B\n\ncd"
    assert to_blocks("<table><caption>Cap<tr><td>x</table>") == "Cap\n| x |\n| --- |"


def test_docx():
    import io
    import zipfile

    from quillgate.sources import parsers

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda text, n, level: para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>')
    cell = lambda *texts: f"<w:tc>{''.join(map(para, texts))}</w:tc>"
    body = (
        para("Bees", '<w:pStyle w:val="Heading2"/>') + item("first", 1, 0) + item("inner", 1, 1) + item("second", 1, 0) + item("dot", 2, 0) + para("")
        + f'<w:p><w:r><w:t>see </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>this</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr>{cell("a", "b")}{cell("c")}</w:tr><w:tr>{cell("d")}{cell("")}</w:tr></w:tbl>'
    )
    level = lambda n, kind: f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{kind}"/></w:lvl>'
    forms = f'<w:numbering xmlns:w="{w}"><w:abstractNum w:abstractNumId="7">{level(0, "decimal")}{level(1, "bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level(0, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>')
        z.writestr("word/numbering.xml", forms)
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="https://bees.example"/></Relationships>')
    assert parsers.docx_text(held.getvalue()) == "## Bees\n\n1. first\n  - inner\n2. second\n- dot\n\nsee [this](https://bees.example)\n\na b\tc\n\nd"


def test_listing(spark, tmp_path):
    from quillgate.sources import documents, files

    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / "node_modules").mkdir()
    for name in ("d/.hidden.md", "d/_b.md", "d/z.md", "d/.git/x.md", "d/node_modules/y.md", "a.md"):
        (tmp_path / name).write_text("# A\n\nB.")
    found = files.list_files(str(tmp_path))
    assert [f.removeprefix(str(tmp_path.resolve())) for f in found] == ["/a.md", "/d/.hidden.md", "/d/_b.md", "/d/z.md"]
    assert {r.path: bytes(r.content) for r in documents.read_documents(spark, *found).collect()} == {f: b"# A\n\nB." for f in found}
    for kind, limits in (("too_many", {"most_files": 3}), ("too_large", {"most_each": 3}), ("total_too_large", {"most_total": 20})):
        with pytest.raises(files.ListingError) as e:
            files.list_files(str(tmp_path), **limits)
        assert e.value.kind == kind
    (tmp_path / "in").symlink_to(tmp_path / "d")
    assert len(files.list_files(str(tmp_path / "in"))) == 3  # a given path may be a link
    with pytest.raises(files.ListingError) as e:
        files.list_files(str(tmp_path))
    assert e.value.kind == "link"


def test_text_in_utf16_units(spark):
    """Cuts are made in the unit that lengths are measured in, and never within a character."""
    bees = "🐝" * 150
    assert one(spark, X.sanitize, bees, "🐝" * 100, "a" * 199 + "🐝") == ["🐝" * 100 + "…", "🐝" * 100, "a" * 199 + "…"]
    assert one(spark, X.slugify, "𝒶" * 40, "ab " * 40) == ["𝒶" * 30, ("ab-" * 20)[:59]]


def test_sanitize_of_long_texts(spark):
    """The short way from a text's beginning gives what all of the text gives."""
    import random

    r = random.Random(8)
    piece = lambda: r.choice(["word ", " " * 3000, "token = " + "x" * r.choice([3, 4000]) + " ", "\x07", "sk-" + "a" * r.choice([5, 30, 5000]) + " ", "bearer\n\n", "api_key:  ", "\t", "é" * 40, "🐝", "." * 150])
    texts = ["".join(piece() for _ in range(r.randint(1, 60))) for _ in range(150)] + ["a " * 50 + "token" + " " * 3000 + "= y z", "b" * 90 + " " + "\x01" * 2000 + "c" * 300]

    def whole(c):
        c = F.regexp_replace(X.strip_controls(c), r"[\n\r\t]+", " ")
        for pattern, to in X.MASKED:
            c = F.regexp_replace(c, pattern, to)
        c = X.trim(F.regexp_replace(c, f"{X.WS}+", " "))
        return F.when(X.utf16_length(c) > 200, F.concat(X.utf16_cut(c, 200), F.lit("…"))).otherwise(c)

    assert one(spark, X.sanitize, *texts) == one(spark, whole, *texts)


def test_json_of_responses(spark):
    said = ['"just text"', "```\n\"x\"\n```", '```json\n{"a": "```"}\n```', "```{\"b\": 1}```", 'Here: [1, {"c": 2}] and more', "{not json", None]
    assert one(spark, X.json_span, *said) == ['"just text"', '"x"', '{"a": "```"}', '{"b": 1}', '[1, {"c": 2}]', None, None]


def test_published_paths(spark):
    assert one(spark, X.forbidden_reason, "dist/a.js", "README.md", "dist/.env", "dist/.quillgate/x", "src/a.ts", "b.PEM") == [None, None, "env file", "own state folder", "outside the publish allowlist", "private key file"]


def test_quotes_in_blocks(spark):
    """Any number of blocks of quotes gives the pairs that `contains` gives; equal quotes and rows repeat."""
    from quillgate.operators import quotes

    texts = spark.createDataFrame([(1, "abcabc é🐝"), (1, "abcabc é🐝"), (2, None), (None, "xa")], "k long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "abc"), (2, "abc"), (3, "é🐝"), (4, ""), (5, None), (6, "bca"), (7, "zz")], "i int, quote string")
    want = sorted(map(tuple, texts.join(items.where("quote <> ''"), F.contains("text", "quote")).select("k", "i").collect()), key=repr)
    for size in (1, 40, 1 << 20):
        assert sorted(map(tuple, quotes.contained(texts, items, size).collect()), key=repr) == want
    assert quotes.contained(texts, items.limit(0)).count() == 0 and quotes.contained(texts.limit(0), items).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nBody.")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.txt").write_text("\n\n")
    out = extract(read_files(spark, str(tmp_path)))
    assert [(r.kind, r.error) for r in out.orderBy("path").collect()] == [("text", None), ("text", "invalid_utf8"), (None, "unsupported"), ("text", "empty_text")]
    assert first_error(out).first().path.endswith("b.txt")
    assert limit_breaches(read_files(spark, str(tmp_path))).count() == 0


def test_questions(spark):
    q = spark.createDataFrame([("q1", "chapters/a.md", "Q?", "R", "quote"), ("q2", "chapters/a.md", "Q?", "R", "absent")], "qa_id string, chapter_file string, question string, ref_answer string, anchor_quote string")
    files = spark.createDataFrame([("chapters/a.md", "has a quote")], "path string, content string")
    calls = Calls(Scripted(by_role={"select": "chapters/a.md", "answer": "R", "grade": "CORRECT"}), most=10)
    got = {r.qa_id: (r.correct, r.failure_reason) for r in evaluate(q, "index", files, calls).collect()}
    assert got == {"q1": (True, None), "q2": (False, "anchor_missing")} and calls.made == 4
    with pytest.raises(CallCap):
        evaluate(q, "index", files, Calls(Scripted(), most=1))


def test_incremental(spark):
    known = spark.createDataFrame([(1, "x")], "k int, t string").select("k", F.sha2("t", 256).alias("sha256"))
    new = spark.createDataFrame([(1, "y"), (2, "z")], "k int, t string")
    assert {tuple(r) for r in changed_rows(known, new, "k", "t").collect()} == {(1, "changed"), (2, "unknown")}


def test_event_rates(spark, tmp_path):
    """Files of events as a stream, against counting."""
    from collections import Counter
    from datetime import datetime, timedelta

    from quillgate.streaming.incremental import event_rates

    began = datetime(2024, 1, 1, 10)
    rows = [(began + timedelta(minutes=7 * k), "ab"[k % 2], float(k)) for k in range(60)]
    table = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    table.write.parquet(f"{tmp_path}/in/events.parquet")
    stream = event_rates(spark, f"{tmp_path}/in/*", table.schema, "*.parquet", late="1 day")
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.table("rates").collect()}
    counts, totals = Counter(), Counter()
    for ts, kind, value in rows:
        counts[ts.replace(minute=0), kind] += 1
        totals[ts.replace(minute=0), kind] += value
    assert got == {k: (n, totals[k]) for k, n in counts.items()}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalogue(spark, name):
    d = "/root/testdata/sf0.001"
    rows = catalog.QUERIES[name](spark, d)
    if name not in catalog.SQL:
        assert rows.count() > 0
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    said = con.sql(catalog.SQL[name])
    columns = sorted(said.columns)
    assert columns == sorted(rows.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    key = lambda r: tuple(map(repr, r))
    ours = sorted((tuple(plain(x) for x in r) for r in rows.select(*columns).collect()), key=key)
    theirs = sorted((tuple(plain(x) for x in r) for r in said.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=key)
    assert ours == theirs


def test_anchor_contains_of_many_quotes(spark, tmp_path):
    """More quotes than go at once: short ones, quoted ones, ones within words, and repeated rows, as the query's SQL says."""
    texts = [(1, 'He said "the old house is near" to all.'), (2, "one two three, four five"), (3, "x"), (3, "x"), (4, None), (5, "")] + [(100 + k, f"doc number {k} stands here, word{k} ends.") for k in range(60)]
    quotes = ["the old house is", '"the old house is near"', "two three", "one two three,", "two", "wo thr", "x", "x", None, "", "ear"] + [f"number {k} stands here" for k in range(2500)] + [f"word{k}" for k in range(2500)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    said = con.sql(catalog.SQL["anchor_contains"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["anchor_contains"](spark, str(tmp_path)).collect())) == sorted(said)


def _over(spark, tmp_path, **tables):
    """A folder of tables as the catalogue's queries read them."""
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_closing_marks(spark, tmp_path):
    """Marks at the end of a short line are no part of the query's heading, as in its SQL; the operator's own headings keep them."""
    docs = spark.createDataFrame([(1, "That*** so.###\n\nIt is.\n\n# Top ##"), (2, "#"), (3, "a ## ##")], "doc_id long, text string")
    got = catalog.queries()["document_sections"](spark, _over(spark, tmp_path, documents=docs)).orderBy("doc_id", "sec_pos").collect()
    assert [(r.doc_id, r.sec_pos, r.heading) for r in got] == [(1, 1, "That*** so."), (1, 2, "Top"), (2, 1, ""), (3, 1, "a ##")]
    assert [r.heading for r in segment.sections(docs.where("doc_id = 1")).orderBy("sec_pos").collect()] == ["That*** so.###", "Top"]


def test_pages_of_one_url(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://a", "x"), (8, "http://a", "y"), (14, "http://a", "z"), (9, "9 b", "x")], "page_id long, url string, html string")
    talks = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "conv_id long, text string")
    got = catalog.queries()["manifest_violations"](spark, _over(spark, tmp_path, pages=pages, conversations=talks)).collect()
    assert sorted(map(tuple, got)) == [("output without hash", "http://a")] * 2 + [("question listed twice", "1"), ("question of no section", "nobody")]
