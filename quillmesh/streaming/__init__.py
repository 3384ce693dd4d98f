"""Exports as they arrive."""

from __future__ import annotations

from ..sources.shred import shred


def stream_exports(spark, path: str, pattern: str = "*.xml"):
    """A streaming DataFrame of records, of each file that appears below path; the same columns as read_exports()."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return shred(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path))
