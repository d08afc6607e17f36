"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH has it or it came as a file of theirs."""
    here = os.path.dirname(os.path.abspath(__file__))
    root, sc = os.path.dirname(here), spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _done or root in known or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kinfold-"), "kinfold.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(f := os.path.join(folder, n), os.path.relpath(f, root))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
