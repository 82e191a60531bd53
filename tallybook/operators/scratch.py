"""Intermediate results that several jobs read.

A frame that must not be computed twice (because it is expensive, or because a
second computation could place its rows differently) is written once as a
Parquet table in the shared folder named by ``spark.checkpoint.dir``. Losing an
executor afterwards costs nothing: the table is read again from that folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Of intermediate tables and of loads.
COMPRESSION = "zstd"

_own_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def _refuse_own_disk(root: str) -> str:
    """A temporary folder of one machine is no shared folder."""
    place = urlparse(root)
    own = tempfile.gettempdir().rstrip("/")
    if place.scheme in ("", "file") and (place.path == own or place.path.startswith(f"{own}/")):
        raise RuntimeError(f"spark.checkpoint.dir is {root}, which other machines of a cluster cannot reach")
    return root


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local session may go without ``spark.checkpoint.dir``, or have it in the
    machine's temporary folder; on a cluster that would be invisible to the others.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/") if local else _refuse_own_disk(named.rstrip("/"))
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = tempfile.mkdtemp(prefix="tallybook-")
    return _own_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/tallybook-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and return it as a scan of the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, and only those.

    Collect or save results inside: frames that read those tables do not outlive
    it. Tables that other frames read are left alone.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
