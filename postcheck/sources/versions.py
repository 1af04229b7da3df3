"""Tables in versions: Parquet parts under a manifest that is published in one step.

A table's folder holds `data`, where each write has a folder of its own, and `versions`, one small manifest for each version: the
schema and the folder of each part. Parts that a write does not touch keep their folders. A manifest appears by a rename that
refuses to replace another, so a lost driver, a repeated job or a second writer leaves the old version or the new one and nothing
between. A table has as many parts as it has key buckets or runs; only their names pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import settled

PART = "__part"


class Outrun(RuntimeError):
    """Another writer published a version first; the write left no trace and can be run again."""


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    at = version or max(versions(spark, path), default=0)
    if not at:
        return 0, {"schema": None, "parts": {}}
    return at, json.loads(spark.read.text(f"{path}/versions/{at:012d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, after: int, manifest: dict) -> int:
    """Make the manifest the version that follows `after`, or raise Outrun."""
    draft, fs = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{after + 1:012d}.json")
    out = fs.create(draft)
    out.write(json.dumps(manifest).encode())
    out.close()
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), never_replace)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Outrun(f"version {after + 1} of {path} exists") from e
        raise
    return after + 1


def read(spark: SparkSession, path: str, version: int | None = None, parts: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The newest version or the one named, whole or some of its parts; a table that was never written is empty and needs a schema."""
    _, manifest = _manifest(spark, path, version)
    known = T.StructType.fromJson(manifest["schema"]) if manifest["schema"] else schema
    if known is None:
        raise ValueError(f"no version of {path} and no schema")
    folders = [f"{path}/{f}/{p}" for p, f in manifest["parts"].items() if parts is None or p in parts]
    return spark.read.schema(known).parquet(*folders) if folders else spark.createDataFrame([], known)


def _written(df: DataFrame, path: str, part: Column) -> dict[str, str]:
    """Write the rows into a folder of their own; the folders of its parts. Large parts are split over tasks, small ones share them."""
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn(PART, part).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/{folder}")
    return {n: folder for n in _names(df.sparkSession, f"{path}/{folder}") if n.startswith(f"{PART}=")}


def replace_parts(df: DataFrame, path: str, part: str) -> int:
    """Publish a version in which the parts named by a column's values in df hold df's rows and all others what they held.

    Part values are texts or numbers, a null is a part of its own. All writes of a table have one schema. Returns the version.
    """
    spark = df.sparkSession
    at, manifest = _manifest(spark, path)
    parts = manifest["parts"] | _written(df, path, F.col(part))
    return _publish(spark, path, at, {"schema": json.loads(df.schema.json()), "parts": parts})


def drop_parts(spark: SparkSession, path: str, values: Sequence[str]) -> int:
    """Publish a version without the parts of these values."""
    at, manifest = _manifest(spark, path)
    gone = {f"{PART}={v}" for v in values}
    return _publish(spark, path, at, manifest | {"parts": {p: f for p, f in manifest["parts"].items() if p not in gone}})


def merge(changes: DataFrame, path: str, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> int:
    """Publish a version with combine(stored rows, changes) in the key buckets that changes touch; other buckets are not read.

    combine works by key and returns the stored columns. A first write takes the changes' columns. buckets is fixed by the first
    write. Changes are written once before they are used, so both passes over them see the same rows. Without changes no version is made.
    """
    spark = changes.sparkSession
    at, manifest = _manifest(spark, path)
    n = manifest.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n))
    changes = settled(changes)
    touched = [f"{PART}={r[0]}" for r in changes.select(bucket).distinct().collect()]  # at most n
    if not touched:
        return at
    new = combine(read(spark, path, at or None, touched, changes.schema), changes)
    untouched = {p: f for p, f in manifest["parts"].items() if p not in touched}
    return _publish(spark, path, at, {"schema": json.loads(new.schema.json()), "buckets": n, "parts": untouched | _written(new, path, bucket)})


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all versions but the newest ones, and the data that only they name; what is being written is not touched."""
    every = versions(spark, path)
    old, kept = every[:-keep], every[-keep:]
    named = lambda vs: {f"{f}/{p}" for v in vs for p, f in _manifest(spark, path, v)[1]["parts"].items()}
    gone = named(old) - named(kept)
    for name in [f"versions/{v:012d}.json" for v in old] + sorted(gone):
        where, fs = _files(spark, f"{path}/{name}")
        fs.delete(where, True)
    return old
