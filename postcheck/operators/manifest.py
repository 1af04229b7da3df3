"""Run and content manifests: ingest, retention, budgets, sliding counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import settled
from ..sources import versions

ORPHANED = "interrupted by a restart"


def ingest_new(files: DataFrame, manifest: DataFrame, version: str, kind: str = "") -> DataFrame:
    """Files (path, content) whose content was not ingested by this parser version, once each, with their hash."""
    salted = F.sha2(F.concat(F.lit(f"{version}|{kind}|").cast("binary"), F.col("content")), 256)
    keyed = files.withColumn("hash", salted)
    once = keyed.groupBy("hash").agg(F.min_by(F.struct(*[F.col(c) for c in files.columns]), "path").alias("f")).select("hash", "f.*")
    return once.join(manifest.select("hash"), "hash", "left_anti")


#: The stored record of an ingested file.
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("hash", "path", "version", "kind")]).add("shape", T.IntegerType()).add("payload", T.StringType()).add("warnings", T.ArrayType(T.StringType()))


def ingest(files: DataFrame, table: str, parse: Callable[[DataFrame], DataFrame], version: str, kind: str = "", shape: int = 1) -> int:
    """Parse and record the files whose content the table does not hold in this shape yet; running it again changes nothing.

    parse takes (hash, path, content) and returns one row (hash, payload, warnings) for each. A record of an older shape counts as
    absent and is replaced. Null content is empty content. Returns the table's version.
    """
    spark = files.sparkSession
    known = versions.read(spark, table, schema=RECORD).where(F.col("shape") >= shape)
    filled = files.select("path", F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    new = ingest_new(filled, known, version, kind)
    fields = {"version": F.lit(version), "kind": F.lit(kind), "shape": F.lit(shape)}
    parsed = parse(new.select("hash", "path", "content")).select("hash", "payload", "warnings")
    records = parsed.join(new.select("hash", "path"), "hash").select(*[fields.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RECORD])

    def kept(base: DataFrame, changes: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("hash").orderBy(F.desc("shape"), F.col("__new")))
        both = base.withColumn("__new", F.lit(1)).unionByName(changes.withColumn("__new", F.lit(0)))
        return both.withColumn("__place", place).where("__place = 1").drop("__new", "__place")

    return versions.merge(records, table, ["hash"], kept)


def replay(files: DataFrame, table: str, version: str, kind: str = "", shape: int = 1) -> DataFrame:
    """(path, hash, state, payload, warnings) of every file: what was recorded of its content, whatever name it came under first.

    state: stored; legacy, whose payload is of an older shape and is refused; absent. Warnings are told again at every reading.
    """
    named = files.select("path", F.sha2(F.concat(F.lit(f"{version}|{kind}|").cast("binary"), F.coalesce("content", F.lit("").cast("binary"))), 256).alias("hash"))
    stored = versions.read(files.sparkSession, table, schema=RECORD).select("hash", "shape", "payload", "warnings")
    state = F.when(F.col("shape").isNull(), "absent").when(F.col("shape") < shape, "legacy").otherwise("stored")
    ok = state == "stored"
    return named.join(stored, "hash", "left").select("path", "hash", state.alias("state"), F.when(ok, F.col("payload")).alias("payload"), F.when(ok, F.col("warnings")).alias("warnings"))


def expired(runs: DataFrame, as_of, max_age_seconds: float, active: DataFrame | None = None) -> DataFrame:
    """Runs older than the retention that are neither waiting, running nor named active."""
    old = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at") > max_age_seconds
    out = runs.where(old & ~F.col("status").isin("pending", "queued", "running"))
    return out if active is None else out.join(active.select("run_id"), "run_id", "left_anti")


def sums_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Append the sum of value over all rows before each one in the given order, without one task seeing all of them.

    Rows go into ranges of the order, written once so that the ranges stay what they are if an executor is lost; the
    ranges' sums (one for each, no more than there are shuffle partitions) pass through the driver and come back as offsets. Nulls count as 0.
    """
    spark = df.sparkSession
    amount = F.coalesce(F.col(value), F.lit(0))
    ranges = settled(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *order).withColumn("__range", F.spark_partition_id()))
    sums = ranges.groupBy("__range").agg(F.sum(amount).alias("s"))
    kind = sums.schema["s"].dataType
    offsets, so_far = [], 0
    for r in sorted(sums.collect()):
        offsets.append((r["__range"], so_far))
        so_far += r["s"]
    known = spark.createDataFrame([(n, str(s)) for n, s in offsets], "__range int, __offset string").select("__range", F.col("__offset").cast(kind))
    within = F.sum(amount).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    with_offsets = ranges.join(F.broadcast(known), "__range")
    return with_offsets.withColumn(out, F.coalesce(within, F.lit(0)) + F.col("__offset")).select(*[F.col(f"`{c}`") for c in df.columns], out)


def over_budget(runs: DataFrame, budget: int) -> DataFrame:
    """Runs to evict, oldest first, until the total fits; protected ones stay but count. runs: run_id, bytes, modified_at, protected. Null sizes count as 0."""
    total = runs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))  # one row
    ranked = sums_before(runs.where("not protected"), ["modified_at", "run_id"], "bytes", "__before")
    return ranked.crossJoin(F.broadcast(total)).where(F.col("total") - F.col("__before") > budget).select(*runs.columns)


def drop_run(overrides: DataFrame, removed: DataFrame) -> DataFrame:
    return overrides.join(removed.select("run_id"), "run_id", "left_anti")


def mark_orphans(runs: DataFrame) -> DataFrame:
    lost = F.col("status").isin("running", "queued")
    return runs.withColumn("message", F.when(lost, ORPHANED).otherwise(F.col("message"))).withColumn("status", F.when(lost, "error").otherwise(F.col("status")))


def recent_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "kind").agg(F.sum("amount").alias("calls"))


def sliding_failures(df: DataFrame, key: str, ts: str, seconds: int = 300, limit: int = 5) -> DataFrame:
    """Append failures (those of the key within the last seconds), blocked, and retry_after in seconds."""
    at = F.unix_timestamp(ts)
    w = W.partitionBy(key).orderBy("__at").rangeBetween(-seconds, 0)
    out = df.withColumn("__at", at).withColumn("failures", F.count("*").over(w)).withColumn("__first", F.min("__at").over(w))
    blocked = F.col("failures") >= limit
    return out.withColumn("blocked", blocked).withColumn("retry_after", F.when(blocked, F.col("__first") + seconds - F.col("__at")).otherwise(0)).drop("__at", "__first")
