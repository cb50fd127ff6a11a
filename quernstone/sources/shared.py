"""A folder that driver and executors share, and what is given back when a step is done."""

from __future__ import annotations

import re
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; on a local master that has none, of this machine."""
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (kept.get() if kept.isDefined() else None)
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quernstone-")
    return f"{folder.rstrip('/')}/{name}-{uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path that scratch() gave."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside, _before = Lock(), defaultdict(int), {}


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What begins in here removes its shuffle files when it ends, not when the driver happens to collect its garbage.

    Several threads may be in here with one session: the last to leave restores its setting.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _inside[session]:
            _before[session] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _inside[session] += 1
    try:
        yield
    finally:
        with _lock:
            _inside[session] -= 1
            if not _inside[session]:
                del _inside[session]
                before = _before.pop(session)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
