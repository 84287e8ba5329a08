"""Stored tables that change only in the buckets of a batch."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom.operators import keyed_table
from leadloom.operators.merge import upsert

SHAPE = "k long, empresa string, v double"
MERGE = partial(upsert, keys=["k"], owner="empresa")


def _files(path):
    return {str(f) for f in Path(path).rglob("*.parquet") if "/filas/" in str(f)}


def _rows(spark, path):
    return {r["k"]: (r["empresa"], r["v"]) for r in keyed_table.read(spark, path).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed_table.create(spark.createDataFrame([(i, "A", float(i)) for i in range(200)], SHAPE), path, ["k"], 16)
    return path


def test_a_batch_writes_its_own_buckets_only(spark, table):
    before = _files(table)
    batch = spark.createDataFrame([(3, "A", -1.0), (5, "B", -1.0), (900, "C", 9.0)], SHAPE)
    assert keyed_table.merge(table, batch, "l1", ["k"], MERGE)
    rows = _rows(spark, table)
    assert len(rows) == 201 and rows[3] == ("A", -1.0) and rows[5] == ("A", 5.0) and rows[900] == ("C", 9.0)
    assert before <= _files(table)
    touched = {f.split("cubo=")[1].split("/")[0] for f in _files(table) - before}
    assert 1 <= len(touched) <= 3
    read = keyed_table.read(spark, table, [int(c) for c in touched]).inputFiles()
    assert all("version=l1" in f for f in read)
    untouched = [f for f in keyed_table.read(spark, table).inputFiles() if "version=l1" not in f]
    assert len({f.split("cubo=")[1].split("/")[0] for f in untouched}) == 16 - len(touched)


def test_a_repeated_batch_changes_nothing(spark, table):
    batch = spark.createDataFrame([(3, "A", -1.0)], SHAPE)
    assert keyed_table.merge(table, batch, "l1", ["k"], MERGE)
    files = _files(table)
    assert not keyed_table.merge(table, batch.withColumn("v", F.lit(7.0)), "l1", ["k"], MERGE)
    assert _files(table) == files and _rows(spark, table)[3] == ("A", -1.0)


def test_a_batch_that_failed_is_not_seen_and_can_be_run_again(spark, table, monkeypatch):
    batch = spark.createDataFrame([(3, "A", -1.0)], SHAPE)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed_table, "_write_record", lost)
        with pytest.raises(RuntimeError, match="lost"):
            keyed_table.merge(table, batch, "l1", ["k"], MERGE)
    assert _rows(spark, table)[3] == ("A", 3.0)
    assert keyed_table.merge(table, batch, "l1", ["k"], MERGE) and _rows(spark, table)[3] == ("A", -1.0)


def test_later_batches_see_earlier_ones(spark, table):
    for i in range(3):
        add = spark.createDataFrame([(3, "A", -float(i)), (1000 + i, "A", 0.0)], SHAPE)
        assert keyed_table.merge(table, add, f"l{i}", ["k"], MERGE)
    rows = _rows(spark, table)
    assert rows[3] == ("A", -2.0) and len(rows) == 203


def test_empty_table_empty_batch_and_names(spark, tmp_path):
    path = str(tmp_path / "e")
    none = spark.createDataFrame([], SHAPE)
    keyed_table.create(none, path, ["k"], 4)
    assert _rows(spark, path) == {}
    assert keyed_table.merge(path, none, "007", ["k"], MERGE) and not keyed_table.merge(path, none, "007", ["k"], MERGE)
    assert keyed_table.merge(path, spark.createDataFrame([(1, None, None)], SHAPE), "l1", ["k"], MERGE)
    assert _rows(spark, path) == {1: (None, None)}
    for name in ("inicio", "a/b", ""):
        with pytest.raises(ValueError, match="batch name"):
            keyed_table.merge(path, none, name, ["k"], MERGE)
