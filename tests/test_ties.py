"""Means that lie on a bound or on half a digit: the order of additions may not decide them."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trajgraph.plans import catalogue
from trajgraph.sources import sinks


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """400 cells, each with the same 32 discounts (mean 0.05) or with one more hundredth (md ends on half of the eighth digit), in
    other orders."""
    d, rng = tmp_path_factory.mktemp("ties"), random.Random(5)
    rows, order = [], 0
    for subject in range(2):
        for a in range(1, 21):
            for b in range(1, 21):
                values = [0.01 * k for k in (1, 2, 3, 4, 6, 7, 8, 9)] * 4
                if subject:
                    values[0] += 0.01
                rng.shuffle(values)
                rows += [(subject, a, b, 1, 10.0, round(v, 2), 0.02, "F", 1.0) for v in values]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_extendedprice"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), d / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [0, 1], "o_custkey": [0, 1]}), d / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [0, 1], "c_nationkey": [0, 1]}), d / "customer.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["k1_write_matrix_csv", "l15_display_name"])
def test_ties_agree_with_sql(spark, tables, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, tables)
    want = c.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_marks_of_a_mean_on_the_bound(spark, tables):
    got = {(r.ctype, r.mark): r.n for r in catalogue.QUERIES["l15_display_name"](spark, tables).collect()}
    # True graphs: 210 cells a subject; a mean of 0.05 isn't below 0.05, nor one of 0.001 below 0.001.
    assert got[("fa", "n.s.")] == 2 * 2 * 210 and ("fa", "*") not in got and ("ad", "***") not in got


def test_halves_of_the_last_digit(spark):
    half = 0.000478125
    rows = [(k, 1, 2, w) for k, w in enumerate((math.nextafter(half, 0), half, math.nextafter(half, 1), -half, 0.1234567849))]
    e = spark.createDataFrame(rows, "k int, i int, j int, w double")
    got = {r.k: r.line.split(",")[1] for r in sinks.matrix_lines(e, ["k"], 2, 8).where(F.col("row") == 1).collect()}
    assert got == {0: "0.00047813", 1: "0.00047813", 2: "0.00047813", 3: "-0.00047813", 4: "0.12345678"}
