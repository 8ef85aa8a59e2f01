"""Intermediate folders belong to the call that named them; the filter of hit digests."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup
from tessera.functions.storage import folders
from tessera.llm._common import stored
from tessera.llm.chosen_path import op3_chosen_path


def shared(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_blocks_delete_what_they_named_but_what_is_kept(spark):
    before = shared(spark)
    with folders(spark) as outer:
        a = stored(spark.range(3), "a")
        with folders(spark) as inner:
            b, c = stored(spark.range(4), "b"), inner.keep(stored(spark.range(5), "c"))
            assert b.count() == 4 and len(shared(spark) - before) == 3
        assert a.count() == 3 and c.count() == 5 and len(shared(spark) - before) == 2
        outer.release(c)
        assert len(shared(spark) - before) == 1
    assert shared(spark) == before
    with pytest.raises(ValueError), folders(spark) as own:
        own.keep(stored(spark.range(3), "a"))
        raise ValueError
    assert shared(spark) == before


def test_a_block_leaves_another_threads_folders(spark):
    made, may_go, seen = threading.Event(), threading.Event(), []

    def other():
        with folders(spark):
            df = stored(spark.range(7), "other")
            made.set()
            may_go.wait(60)
            seen.append(df.count())

    t = threading.Thread(target=other)
    t.start()
    made.wait(60)
    with folders(spark):
        stored(spark.range(2), "mine")
    may_go.set()
    t.join()
    assert seen == [7]


def test_two_pipelines_and_two_joins_at_once(spark, write):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200)]
    texts = [" ".join(words[i : i + 30]) for i in range(40)] + [" ".join(words[i : i + 30]) + " end" for i in range(10)] + [" ".join(words[:30]), None]
    d = write(texts, labels=[(0, 1, 0), (3, 1, 1)])
    work = {"pipeline": corpus_pipeline.run, "join": op3_chosen_path}
    alone = {k: sorted(map(str, f(spark, d).collect())) for k, f in work.items()}
    before, found = shared(spark), []

    def run(kind):
        with folders(spark):
            found.append((kind, sorted(map(str, work[kind](spark, d).collect()))))

    threads = [threading.Thread(target=run, args=(k,)) for k in ("pipeline", "join", "pipeline", "join")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(k for k, _ in found) == ["join", "join", "pipeline", "pipeline"]
    assert all(rows == alone[k] for k, rows in found)
    assert shared(spark) == before


def test_the_filter_loses_no_hit_and_most_others(spark):
    rows = spark.range(4000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    hit = rows.filter("id % 40 = 7").select("digest")
    left = {r["id"] for r in exact_dedup.maybe(rows, hit, 1 << 16).select("id").collect()}
    assert {i for i in range(4000) if i % 40 == 7} <= left and len(left) < 130
    assert exact_dedup.maybe(rows, hit.limit(0)).isEmpty()


def test_no_rows_with_ids_of_other_kinds(spark, tmp_path):
    spark.createDataFrame([], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = exact_dedup.op4_exact_dedup(spark, str(tmp_path))
    assert out.collect() == [] and dict(out.dtypes)["keep_id"] == "string"
