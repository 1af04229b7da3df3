"""Shared helpers: shared-folder tables, plan-time sizes, word splitting and Arrow row maps."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes that separate words and are stripped from line ends (fixed value).
SPACE = " \t\n\x0b\x0c\r"
#: One word: a run of anything but those (fixed value, Java regex).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_HELD: list = []


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: the vocabulary and memos of one operator; those of another are dropped first."""
    if not _HELD or _HELD[0] != key:
        _HELD.clear()
        gc.collect()
        _HELD[:] = [key, make()]
    return _HELD[1]


class Memo(dict):
    """Key to value in two generations of at most `size` entries: what is used again moves to the young one, the old one goes when that is full."""

    def __init__(self, make: Callable, size: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.size, self.longest = make, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()
        self[key] = value

    def unknown(self, keys: Iterable) -> list:
        """Those of the keys, once each, that are in neither generation and short enough to be kept."""
        old, longest = self.old, self.longest
        return [k for k in set(keys) if k not in self and k not in old and len(k) <= longest]


def make_importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local sessions only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="postcheck-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting by which an execution's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, an action's shuffle files go when it ends, not when the driver next collects garbage. For actions whose result is kept elsewhere."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables that loops carry on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def map_rows(
    df: DataFrame,
    new: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    rows: int = 1024,
) -> DataFrame:
    """Append columns computed batch by batch in Arrow; columns of the same name are replaced.

    make runs once in each task and returns the function from a batch of at most `rows` rows to the new columns.
    """
    make_importable(df.sparkSession)
    names = {f.name for f in new}
    df = df.select(*[quoted(c) for c in df.columns if c not in names])
    schema = T.StructType([*df.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = [*part.columns, *work(part)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use names it inside another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
