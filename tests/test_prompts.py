"""Role texts and scripts in order."""

import pytest
from pyspark.sql import functions as F

from quillgate.functions import text as X
from quillgate.plans import prompts
from quillgate.plans.questions import Calls, InOrder, ProviderError

ROLES = ("outline", "distill", "qaGen", "select", "answer", "grade")


def test_every_role_is_told_its_task(spark):
    told = {name: prompts.role(name, budget=400, items=2) for name in ROLES}
    tags = spark.createDataFrame([(n, r.text) for n, r in told.items()], "name string, text string").select("name", X.role_tag(F.col("text")).alias("tag")).collect()
    assert all(r.name == r.tag for r in tags) and all(prompts.DATA in r.text for r in told.values())
    assert "about 400 tokens" in told["distill"].text and told["distill"].most_tokens == 600 and "2 questions" in told["qaGen"].text and told["grade"].most_tokens == 20
    with pytest.raises(ValueError):
        prompts.role("poet")


def test_scripts_in_order(spark):
    """Requests of several tables and tasks get their role's answers in turn; one too many fails, a failure is passed on, what is left over is told, and the log holds all."""
    script = InOrder(grade=["A", "B", ProviderError("rate_limit", "slow"), "D"], select=["x", "y"])
    calls = Calls(script, most=20)
    ask = lambda *rows: calls.answer(spark.createDataFrame(list(rows), "request_id string, role string, prompt string").repartition(4))
    first = {(r.request_id, r.answer) for r in ask(("q2", "grade", "p"), ("q1", "grade", "p"), ("q1", "select", "p")).collect()}
    assert first == {("q1", "A"), ("q2", "B"), ("q1", "x")}
    second = {r.request_id: (r.answer, r.kind, r.retryable) for r in ask(("q3", "grade", "p"), ("q4", "grade", "p")).collect()}
    assert second == {"q3": (None, "rate_limit", True), "q4": ("D", None, None)} and script.unused(calls) == {"select": 1}
    third = ask(("q5", "grade", "p"), ("q9", "answer", "p")).collect()
    assert {r.kind for r in third} == {"unknown"} and "request 5" in {r.request_id: r.error for r in third}["q5"]
    assert calls.log().count() == calls.made == 7 and calls.log().where("role = 'grade'").count() == 5
