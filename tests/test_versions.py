"""Two writers of one version, and a run that dies between a commit and its record."""

import threading

import pytest
from pyspark.sql import functions as F

from sparkward.operators import mutate as U
from sparkward.session import scratch_path, shared_dir


@pytest.fixture
def place(spark):
    root = scratch_path(spark, "table")
    U.write_version(spark.range(3).toDF("k"), root)
    return root


@pytest.mark.parametrize("first_added,second_added", [(True, False), (False, True), (True, True), (False, False)])
def test_both_looked_before_either_wrote(spark, place, monkeypatch, first_added, second_added):
    before = U._folders(spark, place)
    monkeypatch.setattr(U, "_folders", lambda *_: before)
    assert U.write_version(spark.range(10, 13).toDF("k"), place, 1, only_added=first_added) == 2
    with pytest.raises(FileExistsError):
        U.write_version(spark.range(100, 103).toDF("k"), place, 1, only_added=second_added)
    monkeypatch.undo()
    held = {r["k"] for r in U.read_version(spark, place).collect()}
    assert held == ({0, 1, 2, 10, 11, 12} if first_added else {10, 11, 12})


def test_many_writers_one_winner(spark, place):
    won, lost, start = [], [], threading.Barrier(6)

    def write(i):
        start.wait()
        try:
            U._claim(spark, place, 2, f"w{i}")
            won.append(i)
        except FileExistsError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5


def test_a_dead_writers_claim_is_cleared(spark, place):
    U._claim(spark, place, 2, "")
    with pytest.raises(FileExistsError):
        U.write_version(spark.range(1).toDF("k"), place, 1)
    assert U.clear_abandoned(spark, place) == [2]
    assert U.write_version(spark.range(1).toDF("k"), place, 1) == 2


def test_the_version_tells_what_was_applied(spark, place, monkeypatch):
    ledger, used = scratch_path(spark, "ledger"), scratch_path(spark, "used")
    change = U.Mutation(U.DELETE, where=F.col("k") == 1)
    spark.createDataFrame([("p1", 0, "DELETE", ["t"], change.sql("t"), [], U.AWAITING)], U.PROPOSAL_SCHEMA).write.parquet(ledger)
    real = U.apply

    def dies(*args):
        real(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(U, "apply", dies)
    with pytest.raises(KeyboardInterrupt):
        U.apply_proposal(spark, place, ledger, used, "p1", change, 1_000_000, True)
    monkeypatch.undo()
    assert U.claims(spark, place) == {1: "", 2: "p1"}
    for _ in range(2):
        with pytest.raises(PermissionError, match="applied"):
            U.apply_proposal(spark, place, ledger, used, "p1", change, 2_000_000, True)
    assert U.versions(spark, place) == [1, 2] and spark.read.parquet(used).count() == 1


def test_the_shared_folder_must_be_set(spark, monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Bare)
    assert shared_dir(spark)
