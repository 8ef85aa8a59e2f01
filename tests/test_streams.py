"""The change journal and working sets as streams: restarts, overflow, bounded state."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest

from tessera.config import WorkingSet
from tessera.streaming import changes, journal
from tessera.streaming import working_set as K

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def some(n, at=0, path="f"):
    return [(f"{path}{i}", "modified", T0 + timedelta(seconds=at + i)) for i in range(n)]


@pytest.fixture
def run(spark, tmp_path):
    """Takes what the journal has; the rows of each new batch that has any."""
    root, taken = f"file://{tmp_path}/journal", {}

    def go(capacity=journal.CAPACITY, fail=False):
        before = set(taken)

        def sink(rows, batch):
            if fail:
                raise RuntimeError("died")
            taken[batch] = [(r["kind"], r["path"], r["signals"]) for r in rows.collect()]

        changes.run_available(journal.signals(spark, root, capacity), sink, f"file://{tmp_path}/offsets")
        return [taken[b] for b in sorted(set(taken) - before) if taken[b]]

    go.root = root
    return go


def test_a_restart_loses_nothing_and_repeats_nothing(run):
    assert run() == []
    journal.append(run.root, some(3))
    journal.append(run.root, some(2, 10, "g"))
    assert sorted(run()[0]) == [("signal", p, 1) for p in ("f0", "f1", "f2", "g0", "g1")]
    journal.append(run.root, some(1, 20, "h"))
    with pytest.raises(Exception, match="died"):
        run(fail=True)
    journal.append(run.root, some(1, 30, "i"))  # comes behind what the failed batch had planned
    assert [x for batch in [*run(), *run()] for x in batch] == [("signal", "h0", 1), ("signal", "i0", 1)]
    assert run() == []


def test_a_backlog_over_capacity_is_one_rescan(run):
    for i in range(11):
        journal.append(run.root, some(100, i * 100))
    assert run() == [[("rescan", None, 1100)]]
    journal.append(run.root, some(5))
    assert len(run()[0]) == 5
    journal.append(run.root, some(10))
    assert len(run(capacity=10)[0]) == 10


def test_cleaned_files_go_and_numbers_go_on(run):
    assert [journal.append(run.root, some(1)) for _ in range(3)] == [1, 2, 3]
    run()
    assert journal.clean(run.root, 3) == 3 and journal.append(run.root, some(2)) == 4
    assert len(run()[0]) == 2


def test_half_written_files_are_not_seen(run, tmp_path):
    journal.append(run.root, some(1))
    (tmp_path / "journal" / ".tmp-dead").write_text('{"pa')
    (tmp_path / "journal" / "other.txt").write_text("x")
    assert len(run()[0]) == 1


def test_batches_are_planned(spark):
    row = "kind string, seq long, path string, event_type string, ts timestamp, signals long"
    b = spark.createDataFrame([("signal", 1, "a", "created", T0, 1), ("signal", 2, "a", "removed", T0 + timedelta(seconds=1), 1), ("signal", 2, "b", "modified", T0, 1)], row)
    assert {tuple(r) for r in journal.planned(b).collect()} == {("reconcile", "a", "removed", 2), ("reconcile", "b", "modified", 1)}
    both = b.unionByName(spark.createDataFrame([("rescan", 3, None, None, None, 2000)], row))
    assert {tuple(r) for r in journal.planned(both).collect()} == {("rescan", None, None, 2003)}
    assert journal.planned(b.limit(0)).isEmpty()


def test_signals_between_scans(spark):
    scan = lambda *x: spark.createDataFrame(list(x), "path string, content_hash string")
    got = journal.between(scan(("a", "1"), ("b", "1"), ("c", "1")), scan(("a", "1"), ("b", "2"), ("d", "1")))
    assert {tuple(r) for r in got.collect()} == {("b", "modified"), ("c", "removed"), ("d", "created")}


W = WorkingSet(half_life_minutes=10.0, items=5)
ROW = "session_id long, source_id string, created_at timestamp"


def plain(rows, w):
    """Session -> source -> (score, time), one activation after another."""
    state = {}
    for s, k, t in sorted(rows, key=lambda r: (r[2], r[1])):
        e = state.setdefault(s, {})
        score, last = e.get(k, (0.0, t))
        e[k] = (min(w.most, score * 0.5 ** ((t - last).total_seconds() / 60 / w.half_life_minutes) + w.increment), t)
        now = {x: v * 0.5 ** ((t - at).total_seconds() / 60 / w.half_life_minutes) for x, (v, at) in e.items()}
        order = sorted(now, key=lambda x: (-now[x], -e[x][1].timestamp(), x))
        for i, x in enumerate(order):
            if i >= w.items or now[x] < w.least:
                del e[x]
    return state


@pytest.fixture
def streamed(spark, tmp_path):
    """Takes rows in one more batch; every row of state afterwards."""
    source, checkpoint = f"file://{tmp_path}/rows", f"file://{tmp_path}/state"

    def go(rows, mode="none", w=W):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        with K.state_store(spark):
            changes.run_available(K.working_sets(stream, w, mode, "0 seconds"), changes.by_batch(f"file://{tmp_path}/out"), checkpoint, "update")
            state = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
            return {(r["key"]["session_id"], r["user_map_key"]["source_id"]): r["user_map_value"]["score"] for r in state.select("key", "user_map_key", "user_map_value").collect()}

    return go


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_state_is_that_of_the_fold_and_bounded(streamed):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(30), f"s{rng.randrange(40)}", at(rng.random() * 200)) for _ in range(1500)]
    rows.sort(key=lambda r: r[2])
    seen = []
    for part in (rows[:700], rows[700:1100], rows[1100:]):
        seen += part
        state = streamed(part)
        want = {(s, k): v for s, e in plain(seen, W).items() for k, (v, _) in e.items()}
        assert set(state) == set(want) and all(abs(state[x] - want[x]) < 1e-9 for x in want)
        assert len(state) <= 30 * W.items  # of 1,200 pairs of session and source


def test_idle_sessions_leave_the_store(streamed):
    assert set(streamed([(1, "a", at(0)), (2, "b", at(0))], "eventTime")) == {(1, "a"), (2, "b")}
    # 0.35 falls under 0.01 after 5.2 half-lives; session 2 comes again before that
    assert set(streamed([(2, "b", at(45))], "eventTime")) == {(1, "a"), (2, "b")}
    state = streamed([(3, "c", at(70))], "eventTime")
    assert set(streamed([(3, "c", at(71))], "eventTime") if (1, "a") in state else state) == {(2, "b"), (3, "c")}


def test_odd_activations(streamed):
    assert streamed([]) == {}
    assert set(streamed([(None, None, at(0)), (1, "a", at(1)), (1, "a", at(1))])) == {(None, None), (1, "a")}
