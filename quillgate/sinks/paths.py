"""Paths within a bundle, and files written below its folder and nowhere else."""

from __future__ import annotations

import os
import posixpath
import re
from pathlib import Path

MANIFEST = "manifest.json"


class PublishError(ValueError):
    """A refused target; `kind` is escapes, link, unsafe_slug or already_exists."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"[{kind}] {message}")
        self.kind, self.message = kind, message

    def __reduce__(self):
        return PublishError, (self.kind, self.message)


def relative_path(path: str) -> str:
    """The path in normal form; refused if it is absolute, leaves the bundle or names the bundle itself."""
    plain = posixpath.normpath(path.replace("\\", "/")) if path else "."
    if plain in (".", "..") or plain.startswith(("/", "../")) or re.match(r"[A-Za-z]:", plain) or "\0" in plain:
        raise PublishError("escapes", f"{path!r} does not lie below the bundle's folder")
    return plain


def write_text(root: Path, path: str, raw: bytes) -> None:
    """A new file below `root`; no link on the way is followed, and none may be there."""
    place = root.joinpath(*path.split("/"))
    place.parent.mkdir(parents=True, exist_ok=True)
    if not place.parent.resolve().is_relative_to(root.resolve()):
        raise PublishError("link", f"{path!r} leads out of the bundle's folder")
    try:
        handle = os.open(place, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o644)
    except FileExistsError:
        raise PublishError("twice", f"{path!r} is written more than once") from None
    with os.fdopen(handle, "wb") as f:
        f.write(raw)
