import random
import time

import corpus_pipeline
from postcheck.llm import common
from postcheck.llm.queries import ORACLE_SQL, QUERIES


def _tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    draw, docs, labels = random.Random(2), [], []
    word = lambda: "".join(draw.choice("bcdfgl") + draw.choice("aeiou") for _ in range(3))
    for i in range(300):
        words = [word() for _ in range(30)]
        if i % 5 == 0:
            for bad in ("idiot", "scumbag", "moron"):
                words.insert(draw.randrange(len(words)), bad)
        text = " ".join(words) + ("\nShared footer line of many documents" if i % 2 else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[1][1].split("\n")[0], "en", "s1", 9) for i in range(6)]
    _tables(spark, tmp_path, docs, labels)
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "bpe":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = frame.collect()
        frame = spark.createDataFrame(seen[name], frame.schema)
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert len([i for i in range(300) if i % 5 and i in kept]) >= 238 and len([i for i in range(300) if i % 5 == 0 and i in kept]) <= 3
    assert not any("Shared footer" in r["text"] for r in seen["line_dedup"])
    assert {r["doc_id"] for r in seen["near_dedup"]} & {1, *range(1000, 1006)} == {1}
    assert all(r["round_trip"] for r in seen["bpe"]) and len(seen["bpe"]) == len(seen["mixing"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in run) == sorted((r["doc_id"], r["n_tokens"]) for r in seen["bpe"])


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_stored_tables_leave_no_shuffle_files(spark):
    """On many partitions the files of all earlier shuffles would fill the disk until the driver collects garbage."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    shuffles = lambda: {f for f in files() if "shuffle_" in f}
    counts = lambda: spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    setting = spark.conf.get(common.SHUFFLES_GO, None)
    before = shuffles()
    kept = common.stored(counts())
    for _ in range(50):  # files are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(common.SHUFFLES_GO, None) == setting
    assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6
