"""A bundle's files as a sink with two phases: df.write.format("quillgate_bundle").

Tasks write the files of their rows (path, content) to a folder beside the target and report names, sizes and hashes. The driver, once all tasks have
reported, moves those files together by renaming, adds the manifest and puts the whole in the target's place. A failing task leaves what stood
there as it was. No content passes through the driver. Driver and executors must see the target's file system.

Options: path (the target), manifest (JSON text, written as manifest.json), token (names the folders beside the target). Mode overwrite replaces a target that holds anything; append refuses it.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Iterator

from pyspark.sql import Row
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .paths import MANIFEST, PublishError, relative_path, write_text


@dataclass
class Staged(D.WriterCommitMessage):
    """A task's folder and its files: (path, bytes, sha256)."""

    folder: str
    files: list[tuple[str, int, str]] = field(default_factory=list)


def checked_target(folder: str | Path, force: bool) -> Path:
    """Where a bundle goes, with what stands above it pinned; refused where it is a link, or holds anything and `force` is not set."""
    target = Path(folder).absolute()
    for place in (target, *target.parents):
        if place.is_symlink() and not place.resolve().is_dir():
            raise PublishError("link", f"{place} leads nowhere")
    if target.is_symlink():
        raise PublishError("link", f"{target} is a link")
    target = target.parent.resolve() / target.name
    if not force and target.exists() and (not target.is_dir() or any(target.iterdir())):
        raise PublishError("already_exists", f"{target} exists and is not empty")
    return target


def beside(target: Path, part: str, token: str) -> Path:
    return target.with_name(f".{target.name}.{part}-{token}")


def cleared(target: Path, token: str) -> None:
    """Removes what a write that is done, or given up, has left beside its target."""
    for part in ("parts", "new"):
        gone = beside(target, f"gone-{part}", token)
        try:
            beside(target, part, token).rename(gone)  # at once, as tasks may still be writing there
        except FileNotFoundError:
            continue
        shutil.rmtree(gone, ignore_errors=True)


class BundleWriter(D.DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, force: bool):
        if not {"path", "content"} <= set(schema.fieldNames()):
            raise ValueError("a bundle's rows have a path and a content")
        self.target, self.force, self.manifest = checked_target(options["path"], force), force, options.get("manifest")
        self.token = options.get("token") or uuid.uuid4().hex[:12]
        self._beside("parts").mkdir(parents=True)

    def _beside(self, part: str) -> Path:
        return beside(self.target, part, self.token)

    def write(self, iterator: Iterator[Row]) -> Staged:
        mine = self._beside("parts") / uuid.uuid4().hex
        mine.mkdir()  # the folder above is there unless the write was given up
        out = Staged(str(mine))
        for row in iterator:
            path = relative_path(row["path"])
            raw = (row["content"] or "").encode()
            write_text(mine, path, raw)
            out.files.append((path, len(raw), hashlib.sha256(raw).hexdigest()))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [path for m in done for path, *_ in m.files]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        try:
            if twice or (self.manifest and MANIFEST in names):
                raise PublishError("twice", f"{(twice or [MANIFEST])[0]!r} is written more than once")
            fresh = self._beside("new")
            fresh.mkdir(parents=True)
            for m in done:
                for path, *_ in m.files:
                    place = fresh.joinpath(*path.split("/"))
                    place.parent.mkdir(parents=True, exist_ok=True)
                    os.rename(Path(m.folder).joinpath(*path.split("/")), place)
            if self.manifest:
                write_text(fresh, MANIFEST, self.manifest.encode())
            self._swap(fresh)
        finally:
            self.abort(messages)

    def _swap(self, fresh: Path) -> None:
        target, previous = checked_target(self.target, self.force), self._beside("old")
        moved = target.exists() and self.force
        if moved:
            target.rename(previous)
        try:
            fresh.rename(target)  # an empty folder is replaced, one that has filled up meanwhile refuses
        except OSError as e:
            if moved:
                previous.rename(target)
            raise PublishError("already_exists", f"{target} could not be replaced: {e}") from e
        if moved:
            shutil.rmtree(previous, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        cleared(self.target, self.token)


class Bundle(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillgate_bundle"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(schema, self.options, overwrite)


def manifest_text(manifest: dict) -> str:
    return json.dumps(manifest, indent=2, ensure_ascii=False) + "\n"
