"""Getting the package to the workers of a session that was not started from its folder and doesn't have it installed."""

from __future__ import annotations

import hashlib
import os
import site
import sys
import sysconfig
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def _found_by_workers() -> bool:
    """Whether workers import the package without help: it is installed, or on the path that they inherit, or in the folder that they start in."""
    installed = {sysconfig.get_paths()["purelib"], *site.getsitepackages(), site.getusersitepackages()}
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return str(_ROOT) in installed or any(Path(p).resolve() == _ROOT for p in [*inherited, os.getcwd()])


def package_archive(folder: str | None = None) -> str:
    """A zip file of the package's modules, named by its contents, so that equal ones are one file."""
    names = sorted(p for p in (_ROOT / "quillgate").rglob("*.py"))
    digest = hashlib.sha256(b"".join(str(p.relative_to(_ROOT)).encode() + b"\0" + p.read_bytes() for p in names)).hexdigest()[:16]
    target = Path(folder or tempfile.gettempdir()) / f"quillgate-{digest}.zip"
    if not target.exists():
        fresh = target.with_suffix(f".{os.getpid()}")
        with zipfile.ZipFile(fresh, "w", zipfile.ZIP_DEFLATED) as z:
            for p in names:
                z.write(p, str(p.relative_to(_ROOT)))
        fresh.replace(target)
    return str(target)


def ship(spark: SparkSession, force: bool = False) -> None:
    """Sends the package to the session's workers, once a session, unless they find it anyway. Spark serves the file from the driver, so no shared folder is needed."""
    session = f"{spark.sparkContext.applicationId}"
    if session in _sent or not (force or not _found_by_workers()):
        return
    spark.sparkContext.addPyFile(package_archive())
    _sent.add(session)
    if str(_ROOT) not in sys.path:
        sys.path.insert(0, str(_ROOT))
