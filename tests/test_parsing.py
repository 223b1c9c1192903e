"""Parsers in child processes: ones that never end, take all memory, die or fail, and what other files make of that."""

import ctypes
import os
import time

from pyspark.sql import functions as F

from quillgate.sources.files import EXTRACTORS, extract, routed
from quillgate.sources.parsing import Child, Extractor, parsed


def endless(content: bytes) -> str:
    """A C function that takes no signal of Python's and holds its lock."""
    ctypes.PyDLL(None).sleep(600)
    return ""


def greedy(content: bytes) -> str:
    held = [bytes(1 << 28) for _ in range(64)]
    return str(len(held))


def dying(content: bytes) -> str:
    os._exit(3)


def noisy(content: bytes) -> str:
    print("not an answer")
    return content.decode().upper()


OWN = tuple(Extractor(name, f"tests.test_parsing:{name}", (f"x/{name}",), (f".{name}",)) for name in ("endless", "greedy", "dying", "noisy"))


def test_child():
    child = Child(seconds=8.0, memory=2 << 30)
    at = "tests.test_parsing:"
    try:
        assert child.parse(at + "noisy", b"abc") == ("ABC", None)
        first = child.process.pid
        assert child.parse(at + "noisy", b"x" * (5 << 20)) == ("X" * (5 << 20), None) and child.process.pid == first
        began = time.monotonic()
        assert child.parse(at + "endless", b"") == (None, "timeout") and time.monotonic() - began < 20
        assert child.parse(at + "noisy", b"on") == ("ON", None) and child.process.pid != first
        assert child.parse(at + "dying", b"") == (None, "corrupt: the parser's process died")
        assert child.parse(at + "greedy", b"") == (None, "memory")
        assert child.parse(at + "noisy", b"\xff") == (None, "invalid_utf8") and child.parse(at + "noisy", b" ") == (None, "empty_text")
        assert child.parse(at + "nothing", b"")[1].startswith("corrupt: ")
    finally:
        child.stop()
    assert parsed(at + "noisy", b"a") == ("A", None)


def test_a_task_goes_on(spark):
    """One task, files of every kind: each bad one is its own error, those after it are read. Own extractors come first and may take an ending from the shipped ones."""
    rows = [("a.md", "# A", None), ("b.endless", "x", None), ("c.txt", "c", None), ("d.bin", "d", "x/noisy"), ("e.dying", "e", None), ("f.html", "<p>f</p>", None), ("g.bin", "g", None), ("h.MD", "h", None), ("i.noisy", None, None)]
    files = spark.createDataFrame([(p, (t or "").encode() if t is not None else None, m) for p, t, m in rows], "path string, content binary, mime string").coalesce(1)
    got = {r.path: (r.kind, r.text, r.error) for r in extract(files, OWN + EXTRACTORS, seconds=8.0).collect()}  # the first of these parsers has Spark to import
    assert got == {
        "a.md": ("text", "# A", None), "b.endless": ("endless", None, "timeout"), "c.txt": ("text", "c", None), "d.bin": ("noisy", "D", None), "e.dying": ("dying", None, "corrupt: the parser's process died"),
        "f.html": ("html", "f", None), "g.bin": (None, None, "unsupported"), "h.MD": ("text", "h", None), "i.noisy": ("noisy", None, "empty_text"),
    }
    mine = (Extractor("log", "tests.test_parsing:noisy", (), (".md",)),) + EXTRACTORS
    assert files.select(routed(F.col("path"), F.col("mime"), mine).alias("k")).first().k == "log"
