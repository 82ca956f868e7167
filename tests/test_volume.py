"""Steps that run once and shuffle their rows once, whatever the size of the tables."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trajgraph.plans import catalogue, fixtures, queries_labels

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def counted(spark, df):
    """df, and an accumulator of the rows that come out of it each time it runs."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def exchanges_above(capsys, df, leaf):
    """Exchanges by key between the scan with this text and the result."""
    capsys.readouterr()
    df.explain()
    rows = capsys.readouterr().out.splitlines()
    depth = lambda r: len(r) - len(r.lstrip(" :+-"))
    at = next(k for k, r in enumerate(rows) if "FileScan" in r and leaf in r)
    found, low = [], depth(rows[at])
    for r in reversed(rows[:at]):
        if depth(r) < low and r.strip():
            low = depth(r)
            found += [r] if "Exchange hashpartitioning" in r else []
    return found


@needs_tables
@pytest.mark.parametrize("name", ["k6_append_splits"])
def test_streamlines_are_made_once(spark, monkeypatch, name):
    rows, seen = counted(spark, fixtures.assign(spark, DIR))
    monkeypatch.setattr(queries_labels, "assign", lambda *_: rows)
    catalogue.QUERIES[name](spark, DIR).collect()
    assert seen.value == spark.read.parquet(f"{DIR}/lineitem.parquet").count()


@needs_tables
def test_lineitem_is_shuffled_once(spark, monkeypatch, capsys):
    few = fixtures.assign(spark, DIR)
    want = sorted(map(tuple, few.collect()), key=str)
    assert exchanges_above(capsys, few, "l_orderkey") == []
    monkeypatch.setattr(fixtures, "FEW_ORDERS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = fixtures.assign(spark, DIR)
        assert len(exchanges_above(capsys, many, "l_orderkey")) == 1
        assert sorted(map(tuple, many.collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_of_groups_over_many_ranges(spark):
    from trajgraph.functions.ranks import numbered

    rng = random.Random(2)
    rows = [(k, rng.choice([None, 0.5, rng.random()]), i) for k, n in (("a", 900), ("b", 1), ("c", 60)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0.1, 0)], "k string, v double, i int").repartition(5)
    got = sorted((r.k, r.place, r.i) for r in numbered(df, ["k"], ["v", "i"], ["i"], "place").collect())
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0, r[2]))
    starts = {k: [r[0] for r in order].index(k) for k in "abc"}
    assert got == [(k, at - starts[k], i) for at, (k, _, i) in enumerate(order)]


def test_lines_are_not_shuffled(spark, tmp_path, capsys):
    from trajgraph.sources import text

    (tmp_path / "a.txt").write_text("1\n2\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = text.lines(spark, str(tmp_path))
        assert exchanges_above(capsys, got, "FileScan text [value") == []
        assert [(r.line, r.value) for r in got.orderBy("line").collect()] == [(0, "1"), (1, "2")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@needs_tables
def test_predictions_agree_with_sql(spark):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES["k2_write_predictions"](spark, DIR)
    want = c.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLES['k2_write_predictions']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_predictions_are_written_from_one_run(spark, tmp_path):
    from trajgraph.sources import sinks

    df, seen = counted(spark, spark.range(100).select((F.col("id") % 3).alias("s"), "id", (F.col("id") % 7).alias("label")))
    sinks.write_predictions(df, ["s"], "id", "label", 21, str(tmp_path / "p"))
    assert seen.value == 100 and spark.read.text(str(tmp_path / "p/encoded")).count() == 100
