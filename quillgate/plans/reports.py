"""Reports as text, from the small summary tables of a gate, an integrity check or a validation."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_LISTED = 5


def listed(ids: list[str], most: int = MOST_LISTED) -> str:
    """The first ids, and how many follow."""
    more = len(ids) - most
    return ", ".join(ids[:most]) + (f" … and {more} more" if more > 0 else "")


def gate_report(tables: dict[str, DataFrame]) -> str:
    """tables: summary, per_chapter, coverage, failures, as gate_tables makes them. A bundle has at most some thousand of these rows."""
    found = tables["summary"].first()
    if found is None:
        return skipped_gate()
    out = [f"Gate: {'PASSED' if found.passed else 'FAILED'} ({found.pass_rate:.1%} right, {found.threshold:.0%} needed)", "", "Chapters:"]
    out += [f"  {r.file}: {r.correct} of {r.asked}" for r in tables["per_chapter"].orderBy("file").collect()]
    open_ = tables["coverage"].where("generated = 0").orderBy("section_id").collect()
    short = tables["coverage"].where("generated > 0 and generated < requested").orderBy("section_id").collect()
    failed = tables["failures"].orderBy("qa_id").collect()
    for title, rows in (
        ("Sections without a question, which no pass rate makes up for:", [f"  {r.section_id}" for r in open_]),
        ("Sections with fewer questions than asked for:", [f"  {r.section_id}: {r.generated} of {r.requested}" for r in short]),
        ("Failed questions:", [f"  {r.qa_id}: {r.reason}" for r in failed]),
    ):
        out += ["", title, *rows] if rows else []
    return "\n".join(out)


def skipped_gate() -> str:
    return "Gate: SKIPPED. The bundle carries the mark of an unverified one."


def integrity_report(differences: DataFrame) -> tuple[str, str]:
    """(status, text) of differences(path, state) between a manifest's hashes and the files on disk."""
    by_state: dict[str, list[str]] = {}
    for r in differences.orderBy("path").collect():
        by_state.setdefault(r.state, []).append(r.path)
    if not by_state:
        return "ok", ""
    status = "tampered" if "unknown" in by_state else "stale"
    why = {"tampered": "there are files that no gate has seen; remove them or compile again.", "stale": "files differ from those that were verified; restore them or compile again."}[status]
    out = [f"Integrity: {status.upper()}: {why}"]
    for state, title in (("changed", "Changed"), ("missing", "Missing"), ("unknown", "Not in the manifest")):
        out += [f"  {title}:", *[f"    {p}" for p in by_state[state]]] if state in by_state else []
    return status, "\n".join(out)


def source_report(differences: DataFrame) -> str:
    """Sections of one side only, as population differences (id, state) give them; '' where only bodies changed."""
    rows = differences.where("state <> 'changed'").orderBy("id").collect()
    sides = {s: [r.id for r in rows if r.state == s] for s in ("missing", "unknown")}
    if not rows:
        return ""
    labels = {"missing": "in the manifest only", "unknown": "in the sources only"}
    return "\n".join(["The sources are not those of this bundle.", *[f"  {len(v)} sections {labels[s]}: {listed(v)}" for s, v in sides.items() if v]])


def changed_note(differences: DataFrame) -> str:
    ids = [r.id for r in differences.where("state = 'changed'").orderBy("id").collect()]
    return f"{len(ids)} sections changed since the bundle was made ({listed(ids)}); questions are made anew from them." if ids else ""


def validation_report(issues: DataFrame) -> tuple[bool, str]:
    """(passed, text) of issues(severity, code, file, message): warnings do not fail a bundle."""
    rows = issues.orderBy("severity", "file", "code", "message").collect()
    passed = not any(r.severity == "error" for r in rows)
    return passed, "\n".join([f"Validation: {'PASSED' if passed else 'FAILED'}", *([f"  [{r.severity.upper()}] {r.file} ({r.code}): {r.message}" for r in rows] or ["No issues."])])


# What a reader of a failure may do about it, by kind.
ADVICE = {
    "auth": ("the provider did not accept the key", "set the provider's key in the environment or in .env"),
    "rate_limit": ("the provider asks for fewer calls", "wait, or lower QA_PER_SECTION, and run it again"),
    "network": ("the provider was not reached", "look at the network and run it again"),
    "server": ("the provider failed", "run it again later"),
    "bad_response": ("the answer was of no use", "run it again, or with another MODEL"),
    "refusal": ("the provider refused the text", "look at the source; this request is not made again"),
    "unknown": ("the call failed", "run it again, and report the message if it comes back"),
}


def call_failure(stage: str, kind: str, retryable: bool, detail: str, calls: int) -> str:
    """A provider's failure in plain words: where, what, whether trying again may help, and what was spent."""
    what, advice = ADVICE[kind if kind in ADVICE else "unknown"]
    again = "may work if repeated" if retryable else "will not work if repeated"
    out = [f"The {stage} stopped: {what} ({kind}; {again}). {calls} calls were made and nothing was written.", f"To do: {advice}."]
    return "\n".join(out + ([f"The provider says: {detail}"] if detail and detail != kind else []))


def compile_failure(error) -> str:
    """A CompileError as text, with the report of a failed validation or the advice for a failed call where it has one."""
    if error.kind:
        return "Not compiled. " + call_failure(error.stage, error.kind, error.retryable, error.message, error.calls)
    head = f"Not compiled: {error}"
    return head if error.issues is None else f"{head}\n{validation_report(error.issues)[1]}"


def outline_report(issues: DataFrame) -> str:
    """issues(issue, id) of an outline in one line; '' where there are none."""
    labels = {"missing": "missing from all chapters", "unknown": "unknown", "duplicate": "duplicate, in several places"}
    rows: dict[str, list[str]] = {}
    for r in issues.orderBy("issue", "id").collect():
        rows.setdefault(r.issue, []).append(str(r.id))
    return "; ".join(f"{labels[k]}: {listed(rows[k])}" for k in labels if k in rows)
