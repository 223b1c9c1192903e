"""Frontmatter problems, manifest rules and call bounds."""

from quillgate.operators import manifest as M


def test_frontmatter(spark):
    head = M.write_frontmatter({"name": "a-b", "description": 'Guide: "Setup"'})
    assert M.frontmatter(head + "\nbody") | {"unknown": []} == {"problem": None, "detail": None, "name": "a-b", "description": 'Guide: "Setup"', "body": "body", "unknown": []}
    problems = ["no block", "---\na: [\n---\n", "---\n- a\n---\n", "---\nname: x\n---\n", "---\nname: 1\ndescription: y\n---\n"]
    assert [M.frontmatter(p)["problem"] for p in problems] == ["missing_block", "syntax", "not_a_map", "missing_field", "invalid_field"]
    block = lambda name, text, *more: M.frontmatter("\n".join(["---", f"name: {name}", f"description: {text}", *more, "---", "rest"]))
    assert block("a-b", "x", "license: MIT", "allowed-tools: all", "metadata: {a: 1}", "compatibility: any")["unknown"] == [] and block("a", "x")["body"] == "rest"
    assert [block(*x)["problem"] for x in (("A", "x"), ("a--b", "x"), ("a" * 65, "x"), ("a", "' '"), ("a", "y" * 1025), ("a", '"\\x07"'))] == ["invalid_field"] * 6
    assert block("a", "🐝" * 512)["problem"] is None and block("a", "🐝" * 513)["problem"] == "invalid_field"
    assert [block("a", x)["description"] for x in ("yes", "2024-05-01", "12:30", "no", "<<", "0o", "1_000")] == ["yes", "2024-05-01", "12:30", "no", "<<", "0o", "1_000"]
    assert [block("a", x)["problem"] for x in ("true", "12", "0x1F", "0o17", "-1.5e3", ".inf", "~", "")] == ["invalid_field"] * 8
    assert [block("a", "b", x)["problem"] for x in ("name: c", "metadata: {x: 1, x: 2}", "metadata: {x: 1, y: 1}")] == ["syntax", "syntax", None]
    files = spark.createDataFrame([("SKILL.md", "---\nname: a\ndescription: b\nextra: c\n---\n")], "path string, content string")
    assert [(r.severity, r.message) for r in M.frontmatter_issues(files).collect()] == [("warning", "unknown field extra")]
    assert [r.code for r in M.frontmatter_issues(files.limit(0)).collect()] == ["missing_frontmatter"]


def test_each_file_is_parsed_once(spark):
    files = spark.createDataFrame([("SKILL.md", "---\nname: a\ndescription: b\nextra: c\nmore: d\n---\n"), ("SKILL.md", "none"), ("x.md", "none")], "path string, content string")
    issues = M.frontmatter_issues(files)
    assert sorted(r.message for r in issues.collect()) == ["missing_block", "unknown field extra", "unknown field more"]
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_manifest(spark):
    outputs = spark.createDataFrame([("a.md",), ("b.md",), ("b.md",)], "path string")
    hashes = spark.createDataFrame([("a.md", "0" * 64), ("c.md", "x")], "path string, sha256 string")
    sections = spark.createDataFrame([(1, "s1", "a.md"), (0, "s0", "a.md"), (2, "s2", "z.md")], "pos int, id string, chapter_file string")
    questions = spark.createDataFrame([("q1", "s1"), ("q2", "s9")], "qa_id string, section_id string")
    assert {tuple(r) for r in M.manifest_violations(outputs, hashes, sections, questions).collect()} == {
        ("output listed twice", "b.md"), ("output without hash", "b.md"), ("hash without output", "c.md"), ("chapter not among outputs", "z.md"), ("question of no section", "s9"), ("malformed hash", "c.md"),
    }
    assert {r.chapter_file: r.section_ids for r in M.chapters_of(sections).collect()}["a.md"] == ["s0", "s1"]
    assert (M.gate_call_bound(4, 3), M.evaluation_call_bound(12), M.compile_call_bound(2, 4, 3)) == (44, 36, 47)


def test_manifest_shape():
    from quillgate.sinks import bundle

    fine = {"version": 1, "createdAt": "x", "sourceFiles": [], "sections": [], "outputs": ["a"], "outputHashes": [{"path": "a", "sha256": "b"}], "goldenQa": [], "gate": {"skipped": True}}
    assert bundle.manifest_faults(fine) == [] and bundle.manifest_faults([]) == ["manifest: must be an object"]
    bad = fine | {"version": True, "outputs": [1, "a"], "outputHashes": [{"path": "a"}], "gate": {"passRate": "1"}}
    found = bundle.manifest_faults(bad)
    assert found[:4] == ["version: must be a whole number", "outputs.0: must be text", "outputHashes.0.sha256: is missing", "gate.passRate: must be a number"]
    assert bundle.told(found).endswith(f"; +{len(found) - 5} more") and bundle.told(found[:2]) == "; ".join(found[:2])
