"""The question gate as staged DataFrames around an opaque text provider.

Each stage builds a request table (request_id, role, prompt); calls are counted exactly before any is made. Every answer is stored under its request's own name in
the shared folder before the next request is made, and a task that is run again finds it there, so neither retries nor later recomputation call again.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.gate import loaded, outcome_reason

# Kinds of failure of a provider, and whether the same request may succeed later.
FAILURES = {"auth": False, "rate_limit": True, "network": True, "server": True, "bad_response": True, "refusal": False, "unknown": False}


class ProviderError(RuntimeError):
    """A provider's failure; `kind` is one of FAILURES, which says whether it is `retryable` unless the provider knows better."""

    def __init__(self, kind: str, message: str = "", retryable: bool | None = None):
        super().__init__(message or kind)
        self.kind = kind if kind in FAILURES else "unknown"
        self.retryable = FAILURES[self.kind] if retryable is None else retryable


class Provider(Protocol):
    """Answers with text or raises ProviderError; anything else that it raises counts as `unknown`. Retries are the caller's, so it makes none. What a role is told before its
    prompt, and how long its answer may be, is in `prompts.role(role)`. A provider with `at(role, turn)` is asked by turns instead, as InOrder is."""

    def complete(self, role: str, prompt: str) -> str: ...


class Scripted:
    """Answers by (role, prompt) or, failing that, by role; independent of the order of calls. An answer that is a ProviderError is raised."""

    def __init__(self, by_prompt: dict[tuple[str, str], str] | None = None, by_role: dict[str, str] | None = None):
        self.by_prompt, self.by_role = by_prompt or {}, by_role or {}

    def complete(self, role: str, prompt: str) -> str:
        found = self.by_prompt.get((role, prompt), self.by_role.get(role))
        if found is None:
            raise ProviderError("unknown", f"nothing scripted for {role}")
        if isinstance(found, ProviderError):
            raise ProviderError(found.kind, str(found), found.retryable)
        return found


class InOrder:
    """Answers by role in a stated order: the n-th request of a role, over all tables of requests, each in the order of its request ids, gets the n-th answer, whichever task
    asks. A role asked more often than scripted fails as `unknown`; an answer that is a ProviderError is raised. `unused` says what was not asked for."""

    def __init__(self, **answers: list):
        self.answers = {role: list(entries) for role, entries in answers.items()}

    def complete(self, role: str, prompt: str) -> str:
        raise ProviderError("unknown", "a script in order is asked by turns")

    def at(self, role: str, turn: int) -> str:
        entries = self.answers.get(role, [])
        if turn >= len(entries):
            raise ProviderError("unknown", f"the script of {role} has {len(entries)} answers; this is request {turn + 1}")
        if isinstance(entries[turn], ProviderError):
            raise ProviderError(entries[turn].kind, str(entries[turn]), entries[turn].retryable)
        return entries[turn]

    def unused(self, calls: "Calls") -> dict[str, int]:
        """How many answers of each role are left after `calls`, roles without any left out."""
        left = {role: len(entries) - calls.turns.get(role, 0) for role, entries in self.answers.items()}
        return {role: n for role, n in left.items() if n > 0}


class CallCap(RuntimeError):
    """More calls than allowed; raised before the first of them."""


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _answered(provider: Provider, role: str, prompt: str, turn: int) -> dict:
    """One call: {answer, error, kind, retryable}, of which an answer is never blank."""
    out = dict.fromkeys(("answer", "error", "kind", "retryable"))
    try:
        out["answer"] = provider.at(role, turn) if hasattr(provider, "at") else provider.complete(role, prompt)
        if not isinstance(out["answer"], str) or not out["answer"].strip():
            raise ProviderError("bad_response", "empty text")
    except ProviderError as e:
        out |= {"answer": None, "error": str(e)[:200], "kind": e.kind, "retryable": e.retryable}
    except Exception as e:
        out |= {"answer": None, "error": str(e)[:200], "kind": "unknown", "retryable": False}
    return out


class Calls:
    """The calls to a provider, at most `most`; `made` and `tokens` (estimated, of prompts and answers) say what was spent."""

    KIND = "request_id string, role string, prompt string, answer string, error string, kind string, retryable boolean"

    def __init__(self, provider: Provider, most: int = 300, slots: int = 4):
        self.provider, self.most, self.slots, self.made, self.tokens = provider, most, slots, 0, 0
        self.said: list[DataFrame] = []
        self.turns: dict[str, int] = {}

    def _numbered(self, requests: DataFrame) -> DataFrame:
        """requests with turn: how many of their role came before, in earlier tables or earlier in this one. A table has at most `most` rows."""
        before = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in self.turns.items() for x in pair]), F.col("role")), F.lit(0)) if self.turns else F.lit(0)
        rows = requests.withColumn("turn", (F.row_number().over(Window.partitionBy("role").orderBy("request_id", "prompt")) - 1 + before).cast("int"))
        for row in requests.groupBy("role").count().collect():
            self.turns[row["role"]] = self.turns.get(row["role"], 0) + row["count"]
        return rows

    def answer(self, requests: DataFrame) -> DataFrame:
        """(request_id, answer, error, kind, retryable) of requests(request_id, role, prompt)."""
        n = requests.count()
        if self.made + n > self.most:
            raise CallCap(f"{self.made + n} calls, {self.most} allowed")
        self.made += n
        provider = self.provider
        spark = requests.sparkSession
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            root = tempfile.mkdtemp(prefix="quillgate-")
        path = f"{root.rstrip('/')}/quillgate/answers-{uuid.uuid4().hex}"

        def run(batches):
            store, folder = _filesystem(f"{path}/single")
            store.create_dir(folder, recursive=True)
            for batch in batches:
                for row in batch.to_pylist():
                    name = f"{folder}/{hashlib.sha256(json.dumps([row['request_id'], row['role'], row['prompt']]).encode()).hexdigest()}"
                    if store.get_file_info(name).is_file:
                        with store.open_input_file(name) as f:
                            said = json.loads(f.read())
                    else:
                        said = _answered(provider, row["role"], row["prompt"], row["turn"])
                        fresh = f"{name}.{uuid.uuid4().hex}"
                        with store.open_output_stream(fresh) as f:
                            f.write(json.dumps(said).encode())
                        store.move(fresh, name)
                    row.pop("turn")
                    yield pa.RecordBatch.from_pylist([row | said], pa.schema([(k, pa.bool_() if k == "retryable" else pa.string()) for k in ("request_id", "role", "prompt", "answer", "error", "kind", "retryable")]))

        asked = self._numbered(requests.select(F.col("request_id").cast("string").alias("request_id"), "role", "prompt")).repartition(self.slots)
        asked.mapInArrow(run, self.KIND).write.parquet(f"{path}/all")
        out = spark.read.schema(self.KIND).parquet(f"{path}/all")
        spent = F.coalesce(X.estimate_tokens(F.col("prompt")), F.lit(0)) + F.coalesce(X.estimate_tokens(F.col("answer")), F.lit(0))
        self.tokens += out.agg(F.coalesce(F.sum(spent), F.lit(0)).alias("n")).first()["n"]
        self.said.append(out)
        return out.select("request_id", "answer", "error", "kind", "retryable")

    def log(self) -> DataFrame | None:
        """Every call made, as KIND; null before the first."""
        return reduce(DataFrame.unionByName, self.said) if self.said else None


def data_block(label: str, content):
    """Untrusted content in a block whose marks it can't close."""
    held = F.replace(F.replace(content, F.lit("<<<"), F.lit("<​<<")), F.lit(">>>"), F.lit(">>​>"))
    return F.concat(F.lit(f"<<<DATA {label}>>>\n"), held, F.lit("\n<<<END>>>"))


def evaluate(questions: DataFrame, index: str, files: DataFrame, calls: Calls) -> DataFrame:
    """(qa_id, chapter_file, correct, failure_reason, selected_file) of questions(qa_id, chapter_file, question, ref_answer, anchor_quote)
    and files(path, content): choose a chapter, find it, find the quote, answer from it, grade. A question ends at its first failure, and
    later stages call only for those left; the one who answers sees the index and the chosen chapter alone."""
    ask = questions.select(F.col("qa_id").alias("request_id"), F.lit("select").alias("role"), F.concat(data_block("INDEX", F.lit(index)), F.lit("\n"), data_block("QUESTION", F.col("question"))).alias("prompt"))
    chosen = calls.answer(ask).select(F.col("request_id").alias("qa_id"), X.trim(F.coalesce("answer", F.lit(""))).alias("selected_file"))
    rows = loaded(questions.join(chosen, "qa_id"), files)
    there, quoted = F.col("content").isNotNull(), F.contains("content", "anchor_quote")
    rows = rows.withColumn("reason", outcome_reason(there, quoted, F.lit(True)))
    left = rows.where("reason is null")
    reply = calls.answer(left.select(F.col("qa_id").alias("request_id"), F.lit("answer").alias("role"), F.concat(data_block("CONTEXT", F.concat(F.lit(index), F.lit("\n"), F.col("content"))), F.lit("\n"), data_block("QUESTION", F.col("question"))).alias("prompt")))
    left = left.join(reply.select(F.col("request_id").alias("qa_id"), F.col("answer").alias("reply")), "qa_id")
    marks = calls.answer(left.select(F.col("qa_id").alias("request_id"), F.lit("grade").alias("role"), F.concat(*[data_block(k, F.coalesce(F.col(c), F.lit(""))) for k, c in (("QUESTION", "question"), ("REFERENCE", "ref_answer"), ("QUOTE", "anchor_quote"), ("CANDIDATE", "reply"))]).alias("prompt")))
    marks = marks.select(F.col("request_id").alias("qa_id"), F.coalesce(X.is_correct(F.col("answer")), F.lit(False)).alias("right"))
    return rows.join(marks, "qa_id", "left").select(
        "qa_id", "chapter_file", F.coalesce("right", F.lit(False)).alias("correct"), outcome_reason(there, quoted, F.col("right")).alias("failure_reason"), "selected_file"
    )
