"""Runs that go on where they stopped, and batches that count once."""
import pytest

from tidemill.sources.ledger import Run, append_once


def test_finished_stages_are_not_done_again(spark, tmp_path):
    calls = []

    def stage(name, fail=0):
        def make():
            calls.append(name)
            if calls.count(name) <= fail:
                raise ValueError(f"{name} failed")
            return spark.range(len(calls)).selectExpr("id", f"'{name}' AS name")
        return make

    run = Run(spark, f"{tmp_path}/run", attempts=2)
    assert run.ledger().collect() == [] and not run.finished("a")
    a = run.stage("a", stage("a", fail=1))
    assert a.count() == 2 and calls == ["a", "a"]
    with pytest.raises(ValueError, match="b failed"):
        run.stage("b", stage("b", fail=3))
    assert [r["stage"] for r in run.ledger().collect()] == ["a"]
    again = Run(spark, f"{tmp_path}/run", attempts=2)
    assert sorted(r["id"] for r in again.stage("a", stage("a")).collect()) == [0, 1]
    assert again.stage("b", stage("b", fail=3)).count() == len(calls)
    assert calls == ["a", "a", "b", "b", "b", "b"]
    assert {r["stage"]: (r["attempt"], r["rows"]) for r in again.ledger().collect()} == {"a": (2, 2), "b": (2, 6)}
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path), attempts=0)


def test_half_written_stages_are_written_anew(spark, tmp_path):
    run = Run(spark, f"{tmp_path}/run", attempts=1)
    spark.range(50).write.parquet(f"{tmp_path}/run/stages/a")  # a driver lost after the write, before the ledger
    assert run.stage("a", lambda: spark.range(3)).count() == 3


def test_batches_count_once(spark, tmp_path):
    table = f"{tmp_path}/table"
    for batch, n in (("x", 5), ("y", 3), ("x", 4), ("z", 0)):
        append_once(spark.range(n), table, batch)
    got = spark.read.parquet(table).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {"x": 4, "y": 3}
