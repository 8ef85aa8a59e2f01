"""Acceptance of experiences: retries, restarts, rivals, and runs that die."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import experience as X
from tessera.plans import assembly as A
from tessera.sources import sinks
from tessera.sources import store as S

EVENT = "episode_id long, ordinal int, kind string, passed boolean, scope string, failure string, subject string, accepted boolean, source_change boolean, closed boolean"
REQUEST = "seq long, episode_id long, expected_version long, expected_fingerprint string, expected_proposal_hash string"


def story(e, closed=True, accepted=False, passed=True):
    return [(e, 0, "verification", False, "s", "f", "t", False, False, closed), (e, 1, "change", None, None, None, None, False, False, closed), (e, 2, "verification", passed, "s", None if passed else "f", "t", accepted, False, closed)]


@pytest.fixture(scope="module")
def proposals(spark):
    rows = story(1) + story(2) + story(3, accepted=True) + story(4, closed=False) + [(5, 0, "other", None, None, None, None, False, False, True)] + [(6, i, "other", None, None, None, None, False, False, True) for i in range(150)]
    events = spark.createDataFrame(rows, EVENT)
    episodes = spark.createDataFrame([(e, 7, "open" if e == 2 else "abandoned" if e == 4 else "closed") for e in (1, 2, 3, 4, 5, 6, 8)], "episode_id long, version long, status string")
    return X.proposed(X.consolidated(events), X.fingerprinted(events), episodes).cache()


@pytest.fixture
def ask(spark, proposals):
    known = {r["episode_id"]: r for r in proposals.collect()}

    def make(*asked):
        """(episode, change): change is version, fingerprint, hash or nothing."""
        rows = []
        for i, (e, change) in enumerate(asked):
            p = known.get(e)
            rows.append((i, e, 7 + (change == "version"), "x" if change == "fingerprint" else p and p["fingerprint"], "x" if change == "hash" else p and p["proposal_hash"]))
        return spark.createDataFrame(rows, REQUEST)

    return make


def outcomes(df):
    return [r["outcome"] for r in df.orderBy("seq").collect()]


@pytest.fixture
def accept(spark, proposals, tmp_path):
    folder = f"file://{tmp_path}/store"
    evidence = spark.createDataFrame([(e, i, 100 * e + i) for e in (1, 3, 4) for i in range(3)], "episode_id long, ordinal int, event_id long")

    def go(requests):
        return A.accepted(spark, folder, requests, lambda: proposals, evidence)

    go.folder = folder
    return go


def sealed(spark, folder):
    at = S.state(spark, folder)
    return {n: [tuple(r) for r in S.read(spark, at, n).orderBy("experience_id").collect()] for n in at["tables"]}


def test_each_reason(ask, accept):
    got = outcomes(accept(ask((9, ""), (1, "version"), (2, ""), (5, ""), (6, ""), (8, ""), (3, ""), (4, ""), (1, "fingerprint"), (1, "hash"), (1, ""), (1, ""), (1, "hash"), (1, "version"))))
    assert got == ["episode_not_found", "stale_episode_version", "episode_not_closed", "no_supported_failure", "evidence_limit_exceeded", "episode_empty", "review_required", "review_required", "fingerprint_mismatch", "proposal_hash_mismatch", "accepted", "replayed", "already_consolidated", "replayed"]


def test_ten_retries_and_a_restart_give_one_record(spark, ask, accept):
    first = accept(ask((1, ""))).first()
    assert first["outcome"] == "accepted"
    before = sealed(spark, accept.folder)
    for _ in range(10):
        again = accept(ask((1, ""))).first()
        assert (again["outcome"], again["experience_id"]) == ("replayed", first["experience_id"])
    assert sealed(spark.newSession(), accept.folder) == before
    assert len(before["experiences"]) == len(before["experiences_seals"]) == 1 and len(before["experience_evidence"]) == 3
    assert outcomes(accept(ask((1, "hash"), (1, "version")))) == ["already_consolidated", "replayed"]


def test_of_rivals_one_wins(spark, ask, accept):
    barrier, found = threading.Barrier(2), []

    def rival(requests):
        barrier.wait()
        found.extend(outcomes(accept(requests)))

    threads = [threading.Thread(target=rival, args=(ask((1, "")),)) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(found) == ["accepted", "replayed"]
    assert len(sealed(spark, accept.folder)["experiences"]) == 1


class Killed(BaseException):
    pass


@pytest.mark.parametrize("tables", [0, 1, 2, 3])
def test_a_run_that_dies_after_some_tables_shows_nothing(spark, ask, accept, monkeypatch, tables):
    with monkeypatch.context() as m:
        real, done = S._stage, []

        def stage(*a):
            if len(done) == tables:
                raise Killed
            done.append(a)
            return real(*a)

        m.setattr(S, "_stage", stage) if tables < 3 else m.setattr(S, "put", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            accept(ask((1, "")))
    assert S.state(spark, accept.folder) == {"revision": 0, "tables": {}}
    assert outcomes(accept(ask((1, "")))) == ["accepted"]
    before = sealed(spark, accept.folder)
    S.vacuum(spark, accept.folder, older_than_ms=-10_000)
    assert sealed(spark, accept.folder) == before


def test_seals_are_gapless_and_orphans_go_nowhere(spark, tmp_path):
    folder = f"file://{tmp_path}/seals"

    def append(ids, children):
        return sinks.sealed(spark, folder, "h", "id", lambda state: (spark.createDataFrame([(i, "x") for i in ids], "id long, v string"), {"c": spark.createDataFrame(children, "id long, n long")}))

    append([3, 1], [(1, 1), (3, 1), (9, 1)])
    at = append([1, 2], [(1, 5), (2, 5)])  # 1 is sealed already
    assert {tuple(r) for r in S.read(spark, at, "h_seals").collect()} == {(1, 1), (3, 2), (2, 3)}
    assert {tuple(r) for r in S.read(spark, at, "c").collect()} == {(1, 1), (3, 1), (2, 5)}


def test_fingerprints_follow_what_events_say(spark):
    a = spark.createDataFrame(story(1) + story(2), EVENT)
    got = {r["episode_id"]: r["fingerprint"] for r in X.fingerprinted(a).collect()}
    assert got[1] == got[2] and got[1] != X.fingerprinted(a.withColumn("passed", F.lit(True))).first()["fingerprint"]
