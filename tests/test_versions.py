"""Versioned tables, stored runs, ingest and run documents: what a writer that dies, comes second or runs again leaves behind."""

import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcheck.operators import manifest, output
from postcheck.sources import versions
from postcheck.streaming import jobs


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_upsert_replaces_by_key_and_keeps_old_versions(spark, path):
    schema = "k int, v string"
    assert output.store_upsert(spark.createDataFrame([], schema), path, ["k"]) == 0
    assert output.store_upsert(spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], schema), path, ["k"]) == 1
    assert output.store_upsert(spark.createDataFrame([(3, "b"), (500, None), (None, "m")], schema), path, ["k"]) == 2
    want = {i: "a" for i in range(200)} | {3: "b", 500: None, None: "m"}
    assert {r["k"]: r["v"] for r in versions.read(spark, path).collect()} == want and versions.read(spark, path).count() == 202
    assert versions.read(spark, path, version=1).count() == 201
    first, second = (versions._manifest(spark, path, v)[1]["parts"] for v in (1, 2))
    assert sum(first[p] != second[p] for p in first) <= 3  # untouched buckets keep their files
    assert versions.forget(spark, path, keep=1) == [1]
    assert {r["k"]: r["v"] for r in versions.read(spark, path).collect()} == want and versions.versions(spark, path) == [2]


def test_a_writer_that_dies_before_publishing_leaves_the_old_version(spark, path, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    output.store_upsert(df, path, ["k"])

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched, pytest.raises(KeyboardInterrupt):
        patched.setattr(versions, "_publish", dies)
        output.store_upsert(spark.createDataFrame([(1, "b")], "k int, v string"), path, ["k"])
    assert _rows(versions.read(spark, path)) == [(1, "a"), (2, "a")]
    output.store_upsert(spark.createDataFrame([(1, "b")], "k int, v string"), path, ["k"])
    assert _rows(versions.read(spark, path)) == [(1, "b"), (2, "a")]


def test_the_second_of_two_writers_is_refused(spark, path):
    schema = "k int, v string"
    output.store_upsert(spark.createDataFrame([(1, "a")], schema), path, ["k"])

    def overtaken(base, new):
        if not versions.versions(spark, path)[1:]:
            output.store_upsert(spark.createDataFrame([(1, "other")], schema), path, ["k"])
        return output.upsert(base, new, ["k"])

    late = spark.createDataFrame([(1, "late")], schema)
    with pytest.raises(versions.Outrun):
        versions.merge(late, path, ["k"], overtaken)
    assert _rows(versions.read(spark, path)) == [(1, "other")]
    versions.merge(late, path, ["k"], overtaken)
    assert _rows(versions.read(spark, path)) == [(1, "late")]


def test_runs_are_parts(spark, path):
    run = lambda *rows: spark.createDataFrame(rows, "excel_row int, status string")
    output.write_run(run((2, "MATCH"), (3, "REVIEW")), path, "a/1")
    output.write_run(run((2, "NO_POST")), path, "b 2")
    output.write_run(run((9, "MATCH")), path, "a/1")
    assert _rows(versions.read(spark, path)) == [(2, "NO_POST", "b 2"), (9, "MATCH", "a/1")]
    assert _rows(versions.read(spark, path, version=1)) == [(2, "MATCH", "a/1"), (3, "REVIEW", "a/1")]
    versions.drop_parts(spark, path, ["b 2"])
    assert _rows(versions.read(spark, path)) == [(9, "MATCH", "a/1")]
    with pytest.raises(ValueError):
        versions.read(spark, path + "x")


def _parse(calls):
    def parse(new):
        calls.append(sorted(r["path"] for r in new.collect()))
        text = F.col("content").cast("string")
        return new.select("hash", F.upper(text).alias("payload"), F.array_compact(F.array(F.when(text == "", "empty"))).alias("warnings"))

    return parse


def test_ingest_parses_each_content_once_and_replays_warnings(spark, path):
    files = lambda *rows: spark.createDataFrame([(p, c if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    calls = []
    first = files(("f1", b"x"), ("f2", b"x"), ("f3", b""), ("f4", None))
    manifest.ingest(first, path, _parse(calls), "v1")
    manifest.ingest(first, path, _parse(calls), "v1")
    assert calls[0] == ["f1", "f3"] and calls[1] == []
    told = {r["path"]: (r["state"], r["payload"], r["warnings"]) for r in manifest.replay(files(("f1", b"x"), ("other", b"x"), ("f4", None), ("f9", b"new")), path, "v1").collect()}
    assert told == {"f1": ("stored", "X", []), "other": ("stored", "X", []), "f4": ("stored", "", ["empty"]), "f9": ("absent", None, None)}
    # another parser version or kind knows none of it; a newer shape refuses what is stored until it is parsed again
    assert {r["state"] for r in manifest.replay(first, path, "v2").collect()} == {r["state"] for r in manifest.replay(first, path, "v1", kind="k").collect()} == {"absent"}
    assert {(r["state"], r["payload"]) for r in manifest.replay(first, path, "v1", shape=2).collect()} == {("legacy", None)}
    manifest.ingest(files(("f1", b"x")), path, _parse(calls), "v1", shape=2)
    assert calls[2] == ["f1"] and {(r["path"], r["state"]) for r in manifest.replay(first, path, "v1", shape=2).collect()} == {("f1", "stored"), ("f2", "stored"), ("f3", "legacy"), ("f4", "legacy")}
    assert versions.read(spark, path).count() == 2


def test_ingest_stream_survives_a_restart(spark, path, monkeypatch):
    calls, source = [], f"{path}/in"
    put = lambda *rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").coalesce(1).write.mode("append").parquet(source)
    put(("f1", b"x"), ("f2", b"y"))
    start = lambda check="c": jobs.ingest_stream(spark.readStream.schema("path string, content binary").parquet(source), f"{path}/t", f"{path}/{check}", _parse(calls), "v1").awaitTermination()
    with monkeypatch.context() as patched, pytest.raises(Exception):
        patched.setattr(versions, "_publish", lambda *_: 1 / 0)
        start()
    assert versions.versions(spark, f"{path}/t") == []
    start()
    put(("f3", b"x"), ("f4", b"z"))
    start()
    start("another checkpoint")
    assert sorted(r["payload"] for r in versions.read(spark, f"{path}/t").collect()) == ["X", "Y", "Z"]
    assert calls[:3] == [["f1", "f2"], ["f1", "f2"], ["f4"]] and not any(calls[3:])


def test_run_document_comes_back_as_its_tables(spark):
    verdicts = spark.createDataFrame([(i, "MATCH" if i % 2 else "REVIEW", {"m": i}) for i in range(2, 60)] + [(7, "MATCH", None)] * 40 + [(None, "REVIEW", None)], "excel_row int, status string, matched map<string,int>")
    over = spark.createDataFrame([(3, "old", 1), (3, "new", 2)], "excel_row int, status string, updated_at int")
    counts = verdicts.groupBy("status").agg(F.count("*").alias("n"))
    reverse = spark.createDataFrame([(5, '"quoted", [x]\n'), (6, None)], "excel_row int, blogger string")
    run = spark.createDataFrame([("r1", "2026-05-01")], "run_id string, created_at string")
    doc = output.run_document(run, verdicts, over, counts, reverse, size=10).cache()
    pieces = doc.where("section = 'verdicts'").collect()
    assert len(pieces) >= 11 and all(len(json.loads(p["document"])) <= 10 for p in pieces)
    schema = T.StructType.fromDDL("excel_row int, status string, matched map<string,int>, override struct<status: string>, absent string")
    back = output.document_rows(doc, "verdicts", schema).collect()
    plain = lambda rs: sorted((str(r["excel_row"]), r["status"], str(r["matched"])) for r in rs)
    assert plain(back) == plain(verdicts.collect()) and {r["excel_row"]: r["override"]["status"] for r in back if r["override"]} == {3: "new"}
    assert {r["run_id"] for r in back} == {"r1"} and {r["absent"] for r in back} == {None}
    head = json.loads(doc.where("section = 'head'").first()["document"])
    assert head["counts"] == {r["status"]: r["n"] for r in counts.collect()} and head["created_at"] == "2026-05-01" and head["caveat"] == output.CAVEAT
    assert _rows(output.document_rows(doc, "reverse_audit", T.StructType.fromDDL("excel_row int, blogger string"))) == [("r1", 5, '"quoted", [x]\n'), ("r1", 6, None)]
    empty = output.run_document(run, verdicts.limit(0), over.limit(0), counts.limit(0), reverse.limit(0)).collect()
    assert [r["section"] for r in empty] == ["head"] and json.loads(empty[0]["document"])["counts"] == {}


def test_run_document_moves_verdicts_once(spark):
    """By the band alone, though overrides meet them: the newest of each row, also for repeated rows and rows without a number."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = spark.createDataFrame([("r1", "now")], "run_id string, created string")
        verdicts = spark.createDataFrame([(1, "A"), (1, "B"), (12, "C"), (None, "D"), (30, "E")], "excel_row bigint, status string")
        over = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (12, None, 5), (None, "none", 1), (30, "undated", None), (99, "nobody", 3)], "excel_row int, status string, updated_at int")
        reverse = spark.createDataFrame([(5, "b")], "excel_row int, blogger string")
        doc = output.run_document(run, verdicts, over, spark.createDataFrame([("A", 1)], "status string, n long"), reverse, size=10)
        plan = doc._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning(") == 2  # verdicts with overrides, reverse audit; 5 before
        rows = output.document_rows(doc, "verdicts", T.StructType.fromDDL("excel_row bigint, status string, override struct<status: string, updated_at: int>"))
        got = {(r.excel_row, r.status): None if r.override is None else tuple(r.override) for r in rows.collect()}
        assert got == {(1, "A"): ("new", 2), (1, "B"): ("new", 2), (12, "C"): (None, 5), (None, "D"): ("none", 1), (30, "E"): ("undated", None)}
        texts = {(r.band, r.piece): json.loads(r.document) for r in doc.where("section = 'verdicts'").collect()}
        assert sorted(texts) == [(-1, 0), (0, 0), (1, 0), (3, 0)] and list(texts[0, 0][0]) == ["excel_row", "status", "override"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
