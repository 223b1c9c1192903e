"""A whole compile with scripted answers, its bundle on disk, and the rules of what is read back."""

import json

import pytest
from pyspark.sql import functions as F

from quillgate import config
from quillgate.functions import text as X
from quillgate.operators import rules
from quillgate.plans import compiling, reports
from quillgate.plans.questions import Calls
from quillgate.sinks import bundle

DOC = "# Guide\n\nIntro text here.\n\n## Setup\n\nMount the unit flat.\n\n## Care\n\nClean it weekly.\n"
QUOTES = {"guide": "Intro text", "guide/setup": "Mount the unit flat", "guide/care": "Clean it weekly"}


def provider(short="", grade="CORRECT", plan=None):
    plan = plan or {"slug": "unit-guide", "title": "Unit guide", "chapters": [{"id": "a", "title": "Basics", "sectionIds": ["guide", "[§guide/setup]"]}, {"id": "b", "title": "Care", "sectionIds": ["§guide/care"]}]}
    quotes = QUOTES

    class Told:
        def complete(self, role, prompt):
            if role == "outline":
                return f"Here: {json.dumps(plan)} Done."
            if role == "distill":
                return "\n".join(f"{q}. [§{i}]" for i, q in quotes.items())
            if role == "qaGen":
                here = [q for i, q in quotes.items() if f"[§{i}]" in prompt and i != short]
                return json.dumps({"items": [{"question": "What?", "refAnswer": "That.", "anchorQuote": q} for q in [*here, "not in it"]]})
            if role == "select":
                return "chapters/ch01-basics.md"
            return grade if role == "grade" else "That."

    return Told()


@pytest.fixture
def paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "guide.md").write_text(DOC)
    return [str(tmp_path / "in")]


PLAIN = config.Config(questions_per_section=1)


def test_compile_and_publish(spark, paths, tmp_path):
    calls = Calls(provider())
    made = compiling.compile_documents(spark, paths, calls, PLAIN)
    assert made.passed and made.slug == "unit-guide" and calls.made == 1 + 2 + 3 + 3 * 3
    out = tmp_path / "out" / "bundle"
    bundle.publish(made.files, made.manifest, out)
    with pytest.raises(bundle.PublishError) as e:
        bundle.publish(made.files, made.manifest, out)
    assert e.value.kind == "already_exists"
    (out / "old.txt").write_text("x")
    bundle.publish(made.files, made.manifest, out, force=True)
    assert not (out / "old.txt").exists() and [p.name for p in out.parent.iterdir()] == ["bundle"]
    tables, files = bundle.manifest_tables(spark, str(out)), bundle.read_bundle(spark, str(out))
    assert compiling.stored_problems(tables).collect() == [] and compiling.integrity(tables, files).count() == 0
    assert "PASSED (100.0% right" in reports.gate_report(tables) and reports.validation_report(compiling.validate(files))[0]
    again = compiling.evaluate_again(tables, files, Calls(provider(grade="no")), PLAIN)
    assert again["summary"].first().passed is False and again["failures"].count() == 3
    (out / "extra.md").write_text("x")
    (out / "SKILL.md").write_text("changed")
    found = compiling.integrity(tables, bundle.read_bundle(spark, str(out)))
    assert reports.integrity_report(found)[0] == "tampered" and {(r.path, r.state) for r in found.collect()} == {("extra.md", "unknown"), ("SKILL.md", "changed")}


def test_open_sections_fail(spark, paths):
    made = compiling.compile_documents(spark, paths, Calls(provider(short="guide/care")), PLAIN)
    assert made.passed is False and [r.qa_id for r in made.tables["failures"].collect()] == ["guide/care-q0"]
    assert "unverified" in made.files.where("path = 'SKILL.md'").first().content


@pytest.mark.parametrize(
    "chapters, said",
    [([], "no chapters"), ([{"id": "a", "title": "T", "sectionIds": ["guide"]}], "missing"), ([{"id": "a", "title": "T", "sectionIds": list(QUOTES) + ["guide"]}], "duplicate"), ([{"id": "a", "title": "T", "sectionIds": [*QUOTES, "x"]}], "unknown"), ([{"id": "a", "title": "T", "sectionIds": []}], "without sections"), ([{"id": "a"}], "lacks")],
)
def test_bad_plans(spark, paths, chapters, said):
    with pytest.raises(compiling.CompileError, match=said):
        compiling.compile_documents(spark, paths, Calls(provider(plan={"slug": "s", "title": "T", "chapters": chapters})), PLAIN)


def test_bounds(spark, paths):
    with pytest.raises(compiling.CompileError, match="calls"):
        compiling.compile_documents(spark, paths, Calls(provider(), most=10), PLAIN)
    with pytest.raises(compiling.CompileError, match="tokens"):
        compiling.compile_documents(spark, paths, Calls(provider()), config.Config(most_tokens=3))


def test_failing_provider(spark, paths):
    from quillgate.plans.questions import ProviderError, Scripted

    calls = Calls(Scripted(by_role={"outline": ProviderError("rate_limit", "slow down")}))
    with pytest.raises(compiling.CompileError) as e:
        compiling.compile_documents(spark, paths, calls, PLAIN)
    assert (e.value.kind, e.value.retryable, e.value.calls) == ("rate_limit", True, 1)
    text = reports.compile_failure(e.value)
    assert "rate_limit; may work if repeated" in text and "slow down" in text and "1 calls" in text
    assert reports.compile_failure(compiling.CompileError("sources", "x")) == "Not compiled: sources: x"


def test_calls_are_counted_and_kept(spark):
    class Blank:
        def complete(self, role, prompt):
            return " " if role == "blank" else "four" * 4

    calls = Calls(Blank(), most=3)
    rows = spark.createDataFrame([("1", "blank", "p" * 8), ("2", "told", "p" * 8)], "request_id string, role string, prompt string")
    got = {r.request_id: (r.answer, r.kind, r.retryable) for r in calls.answer(rows).collect()}
    assert got == {"1": (None, "bad_response", True), "2": ("four" * 4, None, None)}
    assert calls.made == 2 and calls.tokens == 2 + 2 + 4 and calls.log().count() == 2


def test_commands(spark, paths, tmp_path, capsys, monkeypatch):
    import sys

    from quillgate.__main__ import main

    monkeypatch.setitem(sys.modules, "told_provider", type(sys)("told_provider"))
    sys.modules["told_provider"].make = lambda config: provider()
    monkeypatch.setenv("QA_PER_SECTION", "1")
    out = str(tmp_path / "made")
    ask = ["--provider", "told_provider:make", "--env-file", str(tmp_path / "none")]
    assert main(["compile", *paths, "--out", out, *ask]) == 0 and "Compiled:" in capsys.readouterr().out
    assert main(["report", out]) == 0 and main(["validate", out]) == 0 and "PASSED" in capsys.readouterr().out
    sys.modules["told_provider"].make = lambda config: provider(grade="no")
    assert main(["eval", out, "--source", *paths, *ask]) == 1 and "FAILED" in capsys.readouterr().out
    assert main(["compile", str(tmp_path / "nowhere"), "--out", out, *ask]) == 1


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# note\nGATE_THRESHOLD=0.8\nexport MODEL='m 1'\nANTHROPIC_API_KEY=secret\nBAD\n")
    got = config.load({"GATE_THRESHOLD": "0.7", "MODEL": " "}, str(tmp_path / ".env"))
    assert (got.threshold, got.model, got.key) == (0.7, "m 1", "secret") and "secret" not in repr(got)


def test_paths():
    assert bundle.relative_path("a/./b.md") == "a/b.md"
    for bad in ("", "..", "../a", "/a", "a/../../b", "C:\\a", "."):
        with pytest.raises(bundle.PublishError):
            bundle.relative_path(bad)
    with pytest.raises(bundle.PublishError):
        bundle.target_folder("agents", "Up/Down")
    assert str(bundle.target_folder("agents", "a-b", "/home/x")) == "/home/x/.agents/skills/a-b"


def test_config():
    assert config.load({"GATE_THRESHOLD": " ", "QA_PER_SECTION": "5"}) == config.Config(questions_per_section=5)
    for bad in ({"GATE_THRESHOLD": "0.3"}, {"MAX_LLM_CALLS": "many"}, {"QA_PER_SECTION": "0"}):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_rules(spark):
    q = spark.createDataFrame([("a", "s", "x" * 2001, "r", "q"), ("a", "s", "x", "", None)], "qa_id string, section_id string, question string, ref_answer string, anchor_quote string")
    assert sorted(r.rule.split()[0] for r in rules.question_violations(q).collect()) == ["anchor_quote", "question", "question", "ref_answer"]
    assert compiling.question_items('{"items": [{"question": "a", "refAnswer": "b"}]}') == [] and compiling.question_items(None) == []
    assert spark.range(1).select(X.listed(F.array(*map(F.lit, "abcdefg")))).first()[0] == "a, b, c, d, e … and 2 more"
