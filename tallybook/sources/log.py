"""The log of a folder of tables: which loads count, guarded against writers at the same time.

Every entry is a file of its own, numbered without gaps, and says what has been true
since: the loads whose files are read, all loads that count, the last ids given
out. A writer reads the log, prepares its load, and makes its entry the next one.
The file of an entry is complete when it gets its name, and a name is given once:
of two writers that read the same log the second one finds the number taken
(``CommitConflict``), reads the log again and prepares anew.

A name is given by a hard link on a mounted file system, and by Hadoop's rename
without overwriting anywhere else. Stores whose rename is not atomic need one writer
at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_ENTRY = (
    "seq bigint, load_id string, live array<string>, done array<string>, "
    "last_item bigint, last_country int, buckets int"
)


class CommitConflict(RuntimeError):
    """Another writer's entry came first."""


@dataclass(frozen=True)
class State:
    """What an entry of the log says; the default is an empty folder."""

    seq: int = -1
    load_id: str = ""
    live: list[str] = field(default_factory=list)  # loads whose files are read, oldest first
    done: list[str] = field(default_factory=list)  # loads that count, oldest first; compaction keeps them
    last_item: int = 0
    last_country: int = 0
    buckets: int = 0  # of the key registry


def read_state(spark: SparkSession, folder: str) -> State:
    """The last entry, by one read of the log."""
    try:
        entries = spark.read.schema(_ENTRY).json(f"{folder}/log")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return State()
        raise
    last = entries.agg(F.max_by(F.struct(*entries.columns), "seq").alias("last")).first()["last"]
    return State() if last is None else State(**last.asDict())


def write_state(spark: SparkSession, folder: str, state: State) -> None:
    """Make the entry the next one of the log, or raise ``CommitConflict``."""
    if not create_once(spark, f"{folder}/log", f"{state.seq:012}.json", json.dumps(asdict(state))):
        raise CommitConflict(f"{folder}: entry {state.seq} of the log is another writer's")


def create_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Whether the file got its name; False if a file has it already."""
    draft = f"_draft-{uuid.uuid4().hex}"  # readers pass over names that begin with an underscore
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        root = Path(unquote(place.path) if place.scheme else folder)
        root.mkdir(parents=True, exist_ok=True)
        with (root / draft).open("w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(root / draft, root / name)
        except FileExistsError:
            return False
        finally:
            (root / draft).unlink()
        return True
    return _create_once_hadoop(spark, folder, draft, name, text)


def _create_once_hadoop(spark: SparkSession, folder: str, draft: str, name: str, text: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(conf)
    files.mkdirs(root)
    out = files.create(hadoop.Path(root, draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    mode = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(root.toUri(), conf).rename(hadoop.Path(root, draft), hadoop.Path(root, name), mode)
    except Exception as error:
        files.delete(hadoop.Path(root, draft), False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True
