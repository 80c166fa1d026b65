"""The package on the executors' import path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def package_zip() -> bytes:
    """The package's modules as a zip archive."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once for each application, unless their
    environment has it: it is on ``PYTHONPATH``, or a local session runs in its
    folder. The driver serves the archive; executors read it from there."""
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _DONE or os.path.realpath(home) in there:
        return
    if not (sc.master.startswith("local[") or sc.master == "local") or os.path.realpath(os.getcwd()) != os.path.realpath(home):
        path = os.path.join(tempfile.mkdtemp(prefix="quireline-"), "quireline.zip")
        with open(path, "wb") as f:
            f.write(package_zip())
        sc.addPyFile(path)
    _DONE.add(sc.applicationId)
