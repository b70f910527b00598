"""Append-only log of score versions with an atomic commit.

Every save writes its rows as Parquet below a folder of its own,
``<path>/log/commit=<n>-<attempt>/model=.../uc_type=.../lang=...``, and then
publishes them with one manifest file, ``<path>/manifest/<n>.json``: the list of
live partition folders, their schema and the key of the scores.  The manifest
with the highest number is the table.  It appears by a rename, so a job that
ends between partitions leaves the old scores readable, and what it wrote is
never listed.  Each number is published once; a writer that finds its number
taken starts again from the newer manifest.

Reading keeps, for each key, the rows of its last commit (a group limit, so a
task passes on one version of a key).  Partitions with a single commit need no
such step and are read as they are; ``compact`` makes them of those that have
gathered several.  Saving writes only the rows it is given.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["model", "uc_type", "lang"]
#: Commits of a partition before a save compacts it.
MOST_COMMITS = 16
#: Manifests kept; readers of an older one still find its folders until ``remove_unlisted``.
MANIFESTS = 20


class _Files:
    """The few file operations of a log, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def glob(self, pattern: str) -> list:
        return list(self.fs.globStatus(self._path(pattern)) or [])

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, path: str) -> bool:
        """Write a file that appears whole or not at all; False if it exists."""
        target, draft = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def _manifest(files: _Files, path: str) -> dict | None:
    found = [s.getPath().getName() for s in files.glob(f"{path}/manifest/*.json")]
    return json.loads(files.read(f"{path}/manifest/{max(found)}")) if found else None


def _partition(folder: str) -> str:
    return folder.split("/", 1)[1]


def _write(scores: DataFrame, path: str, number: int, files: _Files) -> list[str]:
    """Rows in a folder of their own; its partition folders, relative to the log."""
    name = f"commit={number:012d}-{uuid.uuid4().hex[:8]}"
    scores.write.partitionBy(*PARTITIONS).parquet(f"{path}/log/{name}")
    leaves = files.glob(f"{path}/log/{name}/*/*/*/*.parquet")
    return sorted({name + "/" + "/".join(s.getPath().toString().rsplit("/", 4)[1:4]) for s in leaves})


def _merged(schema: dict | None, new: T.StructType) -> T.StructType:
    """Stored columns with the new ones after them."""
    if schema is None:
        return new
    old = T.StructType.fromJson(schema)
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in old.names]])


def append(
    scores: DataFrame, path: str, keys: list[str], batch: tuple[str, int] | None = None,
) -> None:
    """Add scores; of a key they bring, earlier rows are replaced at reading.

    ``batch`` names a stream and its batch number: one that is already in the log adds nothing.
    """
    spark = scores.sparkSession
    files = _Files(spark, path)
    folders = None
    while True:
        old = _manifest(files, path)
        batches = old["batches"] if old else {}
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return
        number = old["number"] + 1 if old else 0
        if folders is None:
            folders = _write(scores, path, number, files)
        schema = _merged(old and old["schema"], T.StructType([f for f in scores.schema.fields if f.name not in PARTITIONS]))
        if folders or batch:
            new = {"number": number, "keys": keys, "schema": json.loads(schema.json()),
                   "folders": (old["folders"] if old else []) + folders,
                   "batches": {**batches, **({batch[0]: batch[1]} if batch else {})}}
            if not _publish(files, path, new):
                # Another writer was first: under a later number, so that these rows count as the later ones.
                folders = None
                continue
            if max(_commits(new["folders"]).values(), default=0) > MOST_COMMITS:
                compact(spark, path, MOST_COMMITS)
        return


def _publish(files: _Files, path: str, manifest: dict) -> bool:
    done = files.publish(json.dumps(manifest), f"{path}/manifest/{manifest['number']:012d}.json")
    if done:
        for status in sorted(files.glob(f"{path}/manifest/*.json"), key=lambda s: s.getPath().getName())[:-MANIFESTS]:
            files.delete(status.getPath().toString())
    return done


def _commits(folders: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for folder in folders:
        counts[_partition(folder)] = counts.get(_partition(folder), 0) + 1
    return counts


def _resolved(spark: SparkSession, path: str, manifest: dict, folders: list[str]) -> DataFrame | None:
    """The last version of every key in some partition folders."""
    counts = _commits(folders)
    schema = T.StructType.fromJson(manifest["schema"])
    text = [T.StructField(c, T.StringType()) for c in ("commit", *PARTITIONS)]

    def read(some: list[str]) -> DataFrame:
        # Names of columns are known, so no footer is read while planning.
        return spark.read.schema(T.StructType([*schema.fields, *text])).option("basePath", f"{path}/log").parquet(
            *[f"{path}/log/{f}" for f in some])

    parts = []
    if single := [f for f in folders if counts[_partition(f)] == 1]:
        parts.append(read(single))
    if several := [f for f in folders if counts[_partition(f)] > 1]:
        last = Window.partitionBy(*manifest["keys"]).orderBy(F.desc("commit"))
        parts.append(read(several).withColumn("_rank", F.rank().over(last)).where("_rank = 1").drop("_rank"))
    return reduce(DataFrame.union, parts).drop("commit") if parts else None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """Current scores; None only where nothing has been stored yet."""
    manifest = _manifest(_Files(spark, path), path)
    return _resolved(spark, path, manifest, manifest["folders"]) if manifest else None


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(model, uc_type, lang) that hold scores; no data file is read."""
    manifest = _manifest(_Files(spark, path), path)
    if manifest is None or not manifest["folders"]:
        return spark.createDataFrame([], "model string, uc_type string, lang string")
    return _resolved(spark, path, manifest, manifest["folders"]).select(*PARTITIONS).distinct()


def compact(spark: SparkSession, path: str, beyond: int = 1) -> None:
    """Rewrite the partitions with more than ``beyond`` commits to their current rows, as one commit."""
    files = _Files(spark, path)
    manifest = _manifest(files, path)
    if manifest is None:
        return
    counts = _commits(manifest["folders"])
    crowded = [f for f in manifest["folders"] if counts[_partition(f)] > beyond]
    if crowded:
        current = _resolved(spark, path, manifest, crowded)
        number = manifest["number"] + 1
        folders = _write(current, path, number, files)
        # If another writer was first, its rows stay beside the old ones, and a later call compacts them.
        _publish(files, path, {
            **manifest, "number": number,
            "folders": [f for f in manifest["folders"] if f not in set(crowded)] + folders})


def remove_unlisted(spark: SparkSession, path: str, hours: float = 24) -> int:
    """Delete commits that no kept manifest lists and that are older than some hours; how many there were.

    They are what failed jobs left behind and what compaction replaced.
    """
    files = _Files(spark, path)
    listed = set()
    for status in files.glob(f"{path}/manifest/*.json"):
        listed |= {f.split("/", 1)[0] for f in json.loads(files.read(status.getPath().toString()))["folders"]}
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    old = [s for s in files.glob(f"{path}/log/*")
           if s.getPath().getName() not in listed and now - s.getModificationTime() > hours * 3_600_000]
    for status in old:
        files.delete(status.getPath().toString())
    return len(old)
