"""Sends this package to the executors, so that it need not be installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Once for each Spark context: Python code that runs on executors imports this package."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmesh_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillmesh"), "quillmesh_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("quillmesh", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quillmesh_sent = True
