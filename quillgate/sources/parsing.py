"""Parsers in processes of their own, which can be stopped whatever they do.

A task keeps one child process and sends it one file after another: a request names the parser's function and holds the file's bytes; the answer is (text, error). A child that
takes longer than its time is killed and the next file gets a new one; so is one that dies. A child has a limit of memory, beyond which its file's error is `memory`.
"""

from __future__ import annotations

import importlib
import os
import pickle
import select
import struct
import subprocess
import sys
import time
from dataclasses import dataclass

SECONDS, MEMORY = 60.0, 2 << 30


@dataclass(frozen=True)
class Extractor:
    """A kind of file: the types and name endings that tell it, and its parser, named `module:function`, which makes text from bytes.

    A parser raises ValueError for a file that is not in order; UnicodeDecodeError counts as invalid_utf8, NotImplementedError as unsupported."""

    kind: str
    parser: str
    types: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()


def parsed(parser: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, None) or (None, error) of a file's bytes, in this process."""
    try:
        module, name = parser.split(":")
        text = getattr(importlib.import_module(module), name)(content)
    except UnicodeDecodeError:
        return None, "invalid_utf8"
    except NotImplementedError:
        return None, "unsupported"
    except MemoryError:
        return None, "memory"
    except Exception as e:  # any defect of a file is that file's error
        return None, f"corrupt: {str(e)[:200]}"
    return (text, None) if text.strip() else (None, "empty_text")


class Child:
    """A parsing process, started when first asked and again after each that was killed or died."""

    def __init__(self, seconds: float = SECONDS, memory: int = MEMORY):
        self.seconds, self.memory, self.process = seconds, memory, None

    def parse(self, parser: str, content: bytes) -> tuple[str | None, str | None]:
        request = pickle.dumps((parser, bytes(content)))
        try:
            return pickle.loads(self._exchange(struct.pack("<q", len(request)) + request))
        except TimeoutError:
            self.stop()
            return None, "timeout"
        except (EOFError, BrokenPipeError):
            self.stop()
            return None, "corrupt: the parser's process died"

    def _exchange(self, request: bytes) -> bytes:
        if self.process is None or self.process.poll() is not None:
            self.stop()
            env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
            self.process = subprocess.Popen([sys.executable, "-c", f"from quillgate.sources.parsing import serve; serve({self.memory})"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env, bufsize=0)
            os.set_blocking(self.process.stdin.fileno(), False)
            self._read(1, time.monotonic() + 60)  # a byte says that it is ready; its start is no part of a file's time
        until, sent = time.monotonic() + self.seconds, memoryview(request)
        while sent:
            if not select.select([], [self.process.stdin], [], max(0, until - time.monotonic()))[1]:
                raise TimeoutError
            sent = sent[os.write(self.process.stdin.fileno(), sent[: 1 << 16]) :]
        return self._read(struct.unpack("<q", self._read(8, until))[0], until)

    def _read(self, size: int, until: float) -> bytes:
        out = bytearray()
        while len(out) < size:
            if not select.select([self.process.stdout], [], [], max(0, until - time.monotonic()))[0]:
                raise TimeoutError
            some = os.read(self.process.stdout.fileno(), size - len(out))
            if not some:
                raise EOFError
            out += some
        return bytes(out)

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
            self.process = None


def serve(memory: int) -> None:
    """A child's life: requests from its input until that ends. What a parser prints goes to the error stream, not among the answers."""
    answers, requests = os.fdopen(os.dup(1), "wb"), os.fdopen(os.dup(0), "rb")
    os.dup2(2, 1)
    importlib.import_module("quillgate.sources.parsers")  # what the shipped parsers need, so that it is no part of a file's time
    try:
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
    except (ImportError, ValueError, OSError):  # not every system can limit
        pass
    answers.write(b"+")
    answers.flush()
    while head := requests.read(8):
        answer = pickle.dumps(parsed(*pickle.loads(requests.read(struct.unpack("<q", head)[0]))))
        answers.write(struct.pack("<q", len(answer)) + answer)
        answers.flush()
