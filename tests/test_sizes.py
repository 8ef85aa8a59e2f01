"""Operators that once paired, folded or moved too much, against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions.columns import packed, unpacked
from tessera.operators import aggregates, context, experience, intervals, retrieval
from tessera.plans import context as plans
from tessera.sources import embedding, lexical_index, sinks, store


def test_coverage_meets_symbols_by_equality(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abé", k=rng.randint(0, n)))
    maybe = lambda x: None if rng.random() < 0.1 else x
    expected = [(rng.randint(0, 2), maybe(rng.choice("pq")), maybe(word(3))) for _ in range(60)]
    changes = [(rng.randint(0, 2), rng.choice("pq"), word(3), maybe(word(12))) for _ in range(25)]
    e, c = spark.createDataFrame(expected, "case_id long, path string, symbol string"), spark.createDataFrame(changes, "case_id long, path string, symbol string, text string")
    got = {r["case_id"]: tuple(r)[1:] for r in aggregates.implementation_coverage(e, c).collect()}
    want = {}
    for case, path, symbol in set(expected):
        exact = None not in (path, symbol) and any(x[:3] == (case, path, symbol) for x in changes)
        said = symbol is not None and any(x[0] == case and x[3] is not None and symbol in x[3] for x in changes)
        n, i, m = want.get(case, (0, 0, 0))
        want[case] = (n + 1, i + exact, m + (said and not exact))
    assert got == want


def test_requests_are_not_folded_a_group_at_a_time(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for e in range(400):
        version, n = 0, 0
        for i in range(rng.randint(1, 4)):
            seq = e * 10 + i
            ok = rng.random() < 0.7
            rows.append((f"k{seq}", e, "add", version if ok else None, [seq], seq))
            version, n = version + ok, n + ok
            if e % 7:
                want[f"k{seq}"] = ("applied" if ok else "conflict", version, n)
    episodes = spark.createDataFrame([(e, 0, "open") for e in range(400) if e % 7], "episode_id long, version long, status string")
    requests = spark.createDataFrame(rows, "request_key string, episode_id long, action string, expected_version long, event_ids array<long>, seq long").repartition(5)
    out = experience.mutated(episodes, requests)
    assert {r["request_key"]: (r["result"], r["version"], r["members"]) for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def _random_spans(spark, rng, n, name, wide):
    rows = [(rng.randint(0, 3), f"{name}{rng.randint(0, 3 * n)}", s := rng.randint(0, 60), s + rng.choice(wide)) for _ in range(n)]
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, f"document_id long, {name}_id string, start long, end long")


def _exchanges(df):
    """Shuffles in the plan that runs."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_nearest_chunks_moves_each_range_once(spark):
    for seed, most in ((1, 1), (2, 2), (3, 4)):
        rng = random.Random(seed)
        _, n = _random_spans(spark, rng, 150, "node", (-2, 0, 1, 9, 40))
        _, c = _random_spans(spark, rng, 120, "chunk", (-2, 0, 1, 5, 30, 60))
        got = {(r["node_id"], r["rank"]): r["chunk_id"] for r in intervals.nearest_chunks(n, c, most).collect()}
        pairs = n.distinct().withColumnsRenamed({"start": "node_start", "end": "node_end"}).join(c.distinct(), "document_id")
        assert got == {(r["node_id"], r["rank"]): r["chunk_id"] for r in intervals.nearest(pairs, most).collect()}
    assert _exchanges(intervals.nearest_chunks(n, c, 2)) <= 2


def test_smallest_enclosing_moves_each_range_once(spark):
    rows, c = _random_spans(spark, random.Random(4), 400, "chunk", (0, 0, 1, 5, 30, 60))
    want = {}
    for d, i, s, e in rows:
        for d2, j, s2, e2 in rows:
            if d == d2 and s2 <= s and e2 >= e and e2 - s2 > e - s:
                want[i] = min(want.get(i, (10**9,)), (e2 - s2, s2, j))
    assert {r["chunk_id"]: r["enclosing_id"] for r in intervals.smallest_enclosing(c).collect()} == {i: w[2] for i, w in want.items()}
    assert _exchanges(intervals.smallest_enclosing(c)) <= 2


def test_parts_that_are_dealt_by_key_meet(spark):
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        n = 300
        few = spark.createDataFrame([(i, f"a{i}", 0, 9) for i in range(n)], "document_id long, chunk_id string, start long, end long").repartition("document_id")
        many = spark.createDataFrame([(i, f"b{i}-{'x' * 90}", 1, 5) for i in range(n)], few.schema).repartition("document_id")
        assert intervals.smallest_enclosing(few.unionByName(many)).count() == n
        assert intervals.nearest_chunks(few.withColumnRenamed("chunk_id", "node_id"), many, 1).count() == n
        e = few.select(F.col("document_id").alias("episode_id"), F.lit(0).cast("long").alias("version"), F.lit("open").alias("status"))
        r = many.select(F.col("document_id").alias("episode_id"), F.col("chunk_id").alias("request_key"), F.lit("add").alias("action"), F.lit(0).cast("long").alias("expected_version"), F.array("start").alias("event_ids"), F.col("start").alias("seq"))
        assert experience.mutated(e, r).filter("result = 'applied'").count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_words_that_cancel_out_have_a_direction():
    embed = embedding.HashedWords(2).embed
    words = [f"w{i}" for i in range(20)]
    for text in [f"{a} {b}" for a in words for b in words] + ["\u00a0", "\x0b", "\x1c \u3000"]:
        assert abs(sum(x * x for x in embed([text])[0]) - 1) < 1e-9
    assert embed(["", " \t\r\n\f"]) == [[0.0, 0.0]] * 2


def test_equal_texts_tie(spark):
    words = [f"w{i}{'abcdefg'[i % 7]}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(30)] + [(100 + i, " ".join(words[: i % 37]) + " z" * i) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7)
    queries = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(30)], "query_id long, text string")
    equal = retrieval.indexed_many(lexical_index.build(docs, "id", "text"), queries, 30).filter("id < 30").groupBy("query_id").agg(F.countDistinct("score").alias("scores"))
    assert {r["scores"] for r in equal.collect()} == {1}


def test_explained_packets_move_lines_once(spark, sf):
    out = plans.packet_explanation(spark, sf)
    pool = context.bounded(context.ranked(context.merged(plans._candidates(spark, sf), "request")), "request", limit=50)
    joined = context.explained(context.packets(pool, "request", 100), pool, "request").select("request", "rank", "source_type", "source_id", F.array_join("reasons", ",").alias("reasons"), F.round("final", 6).alias("final"))
    want = sorted(map(tuple, joined.collect()))
    assert want and sorted(map(tuple, out.collect())) == want
    assert _exchanges(out) == 1


def test_what_stands_beside_a_packet_leaves_it_alone(spark):
    rng = random.Random(7)
    kinds = "request long, source_type string, source_id string, semantic double, lexical double, task double, working_set double, recency double, reasons array<string>, structural_evidence boolean, freshness string, content string, path string"
    rows = [(rng.choice([None, *range(6)]), rng.choice(["code", "memory"]), f"s{i}", rng.choice([None, 0.5]), None, 0.1, 0.2, rng.random(), rng.choice([[], ["pinned"], ["caller", "é"]]), i % 5 == 0, "recent", rng.choice([None, "", "éx" * rng.randint(1, 9)]), rng.choice([None, "p"])) for i in range(80)]
    pool = context.bounded(context.ranked(context.merged(spark.createDataFrame(rows, kinds).repartition(7), "request")), "request", limit=9)
    plain, more = context.packets(pool, "request", 40), context.packets(pool, "request", 40, beside=("reasons", "path"))
    assert more.columns == [*plain.columns, "reasons", "path"]
    assert {tuple(r) for r in more.drop("reasons", "path").collect()} == {tuple(r) for r in plain.collect()}
    held = {r[2]: (r[8], r[12]) for r in rows}
    assert {r["source_id"]: (sorted(r["reasons"]), r["path"]) for r in more.collect()} == {r["source_id"]: (sorted(held[r["source_id"]][0]), held[r["source_id"]][1]) for r in more.collect()}


def test_packed_texts_differ_as_texts_do(spark):
    texts = [None, "", "a", "ab", "AB", "0a", "ab\n", "é", "0" * 64, "f" * 63, "\0", "\x01ab", "ag", " ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("p"), unpacked(packed("t")).alias("back")).collect()
    assert [r["back"] for r in rows] == texts
    assert len({r["p"] and bytes(r["p"]) for r in rows}) == len(texts)
    assert max(len(r["p"]) for r in rows if r["t"] == "0" * 64) == 33


def test_acceptances_move_each_side_once(spark):
    requests = [(s, e, 1, "ab" if f else "x", "cd") for s, e, f in [(1, 1, 0), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0), (1, 2, 1), (1, None, 1), (9, 3, 1), (8, 3, 0)]]
    asked = spark.createDataFrame(requests, "seq long, episode_id long, expected_version long, expected_fingerprint string, expected_proposal_hash string").repartition(3)
    proposals = spark.createDataFrame([(e, 1, "closed", "proposal", True, "ab", "cd") for e in (1, 3)], "episode_id long, version long, status string, result string, automatic boolean, fingerprint string, proposal_hash string")
    records = spark.createDataFrame([(3, "r3", "ab", "cd")], "episode_id long, experience_id string, fingerprint string, proposal_hash string")
    with_joins = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in with_joins}
    [spark.conf.set(k, v) for k, v in with_joins.items()]
    try:
        out = experience.acceptances(asked, proposals, records)
        got = sorted((r["episode_id"] or 0, r["seq"], r["outcome"]) for r in out.collect())
        assert _exchanges(out) <= 4  # three by episode, and that of the test's own repartition
    finally:
        [spark.conf.set(k, v) for k, v in old.items()]
    assert got == [(0, 1, "episode_not_found"), (1, 1, "fingerprint_mismatch"), (1, 2, "accepted"), (1, 2, "accepted"), (1, 3, "replayed"), (1, 4, "already_consolidated"), (2, 1, "episode_not_found"), (3, 8, "already_consolidated"), (3, 9, "replayed")]
    assert [(r["episode_id"], r["fingerprint"], r["proposal_hash"]) for r in out.filter("made").collect()] == [(1, "ab", "cd")]


def test_appends_leave_what_is_stored_where_it_is(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/appended"

    def append(*ids):
        return sinks.sealed(spark, folder, "h", "id", lambda at: (spark.createDataFrame([(i, "x") for i in ids], "id long, v string"), {"c": lambda new: new.select("id", "v")}), buckets=2)

    first = append(*range(20))
    second = append(*range(15, 40))
    for name in ("h", "c", "h_seals"):
        kept = second["tables"][name]["files"]
        assert first["tables"][name]["files"].items() <= kept.items() and len(kept) == 4
        assert {r["id"] for r in store.read(spark, second, name).collect()} == set(range(40)) and store.read(spark, second, name).count() == 40
    held = store.holding(spark.createDataFrame([(i,) for i in range(40)], "id long"), second, "h")
    assert len(held) == 4 and store.read(spark, second, "h", held).count() == 40
    third = store.commit(spark, folder, 2, {"h": store.Change(spark.createDataFrame([(3, "y"), (30, "z")], "id long, v string"), spark.createDataFrame([(i,) for i in range(4, 15)], "id long"))})[0]
    assert {tuple(r) for r in store.read(spark, third, "h").collect()} == {(i, {3: "y", 30: "z"}.get(i, "x")) for i in range(40) if not 4 <= i < 15}
    monkeypatch.setattr(store, "APPENDS", 2)
    fourth = append(*range(40, 60))  # c has two folders a bucket by now, which become one
    assert len(fourth["tables"]["c"]["files"]) == 2 and len(fourth["tables"]["h"]["files"]) == 4
    store.vacuum(spark, folder, older_than_ms=-10_000)
    assert sorted(r["id"] for r in store.read(spark, fourth, "c").collect()) == list(range(60))
    assert sorted(r["acceptance_order"] for r in store.read(spark, fourth, "h_seals").collect()) == list(range(1, 61))
