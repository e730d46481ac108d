"""Moves between tiers that are broken off at any step, and the purge by policy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import archive as A
from tidewatch.sources import folders

DAY = dt.datetime(2024, 1, 1)
POLICIES = [
    {"policy_id": "p", "source_id": "a/b %", "hot_days": 10, "warm_days": 30, "cold_days": 60},
    {"policy_id": "q", "source_id": "007", "hot_days": 20, "warm_days": 5, "archival_enabled": False},
    {"policy_id": "r", "source_id": "keep", "hot_days": 1, "warm_days": 1, "cold_days": 1, "cleanup_enabled": False},
]
KEYS = ["source_id", "slot"]


def at(days):
    return F.lit(DAY + dt.timedelta(days=days)).cast("timestamp")


@pytest.fixture
def base(spark, tmp_path):
    rows = [(i, s, str(i % 3), DAY - dt.timedelta(days=i)) for i, s in enumerate(["a/b %", "007", "keep", None, "none"] * 12)] + [(100, "keep", "0", None)]
    df = spark.createDataFrame(rows, "i int, source_id string, slot string, ts timestamp")
    df.write.partitionBy(*KEYS).parquet(f"{tmp_path}/hot")
    return str(tmp_path)


def expected(days=0):
    """Row ids by tier after one move."""
    hot, warm, cold = set(), set(), set()
    for i, s in enumerate(["a/b %", "007", "keep", None, "none"] * 12):
        p = next((p for p in POLICIES if p["source_id"] == s), None)
        if p and i > p["hot_days"] - days:
            warm.add(i)
            if p.get("archival_enabled", True):
                cold.add(i)
        else:
            hot.add(i)
    return {"hot": hot | {100}, "warm": warm, "cold": cold}


def held(spark, base):
    out = {}
    for tier in ("hot", "warm", "cold"):
        rows = [r.i for r in A.read_tier(spark, base, tier, KEYS).collect()]
        assert len(rows) == len(set(rows)), tier
        out[tier] = set(rows)
    return out


def test_move_and_nothing_left_to_move(spark, base):
    want = expected()
    assert A.archive(spark, base, POLICIES, at(0), KEYS) == len(want["warm"])
    assert held(spark, base) == want and A.pending(spark, base) == [] and folders.children(spark, f"{base}/{A.MOVES}") == []
    assert A.archive(spark, base, POLICIES, at(0), KEYS) == 0 and held(spark, base) == want
    cold = A.read_tier(spark, base, "cold").where("i = 15").head()
    assert cold.source_id == "a/b %" and cold.ts == DAY - dt.timedelta(days=15) and (cold.year, cold.month) == ("2024", "01")


@pytest.mark.parametrize("step", ["warm written", "published", "switched", "unmarked"])
def test_a_broken_move_is_finished_by_the_next_run(spark, base, monkeypatch, step):
    stop = RuntimeError("executor lost")

    def fail(*args, **kwargs):
        raise stop

    move = A.stage(spark, base, POLICIES, at(0), KEYS)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "warm written":
            m.setattr("pyspark.sql.DataFrameWriter.json", fail)
        elif step == "published":
            m.setattr(A, "switch", fail)
        elif step == "switched":
            real = folders.drop
            m.setattr(folders, "drop", lambda spark, paths, encoded=False: real(spark, paths, True) if encoded else fail())
        else:
            m.setattr(folders, "touch", fail)
        A.complete(spark, base, move, KEYS)
    assert A.pending(spark, base) == [move]
    assert A.archive(spark, base, POLICIES, at(0), KEYS) == len(expected()["warm"])
    assert held(spark, base) == expected() and A.pending(spark, base) == []


def test_a_move_that_was_not_decided_leaves_nothing(spark, base, monkeypatch):
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        real = spark.range
        m.setattr(type(spark), "range", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        A.stage(spark, base, POLICIES, at(0), KEYS)
    assert real(1).count() == 1
    assert A.pending(spark, base) == [] and len(folders.children(spark, f"{base}/{A.MOVES}")) == 1
    assert A.archive(spark, base, POLICIES, at(0), KEYS) == len(expected()["warm"]) and held(spark, base) == expected()


def test_purge_by_policy(spark, base):
    assert A.purge_by_policy(spark, base, "warm", POLICIES, at(0)) == 0
    A.archive(spark, base, POLICIES, at(0), KEYS)
    A.archive(spark, base, POLICIES, at(25), KEYS)
    first, second = expected(0), expected(25)
    assert held(spark, base) == second
    source = dict(enumerate(["a/b %", "007", "keep", None, "none"] * 12))
    gone = {i for i in first["warm"] if source[i] in ("a/b %", "007")} | {i for i in second["warm"] if source[i] == "007"}
    assert A.purge_by_policy(spark, base, "warm", POLICIES, at(31)) == len(gone)
    assert held(spark, base) == {**second, "warm": second["warm"] - gone}
    assert A.purge_by_policy(spark, base, "cold", POLICIES, at(61)) == len({i for i in first["cold"] if source[i] == "a/b %"})
