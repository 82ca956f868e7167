from pyspark.sql import functions as F

from trajgraph.functions import labels as L
from trajgraph.operators import clean as C
from trajgraph.sources import text


def test_encode_decode_all_pairs(spark):
    for n in (85, 165):
        dim = L.label_dimension(spark, n)
        a, b = L.decode_symmetric(F.col("label"), n)
        assert dim.count() == n * (n + 1) // 2
        assert dim.agg(F.min("label"), F.max("label"), F.countDistinct("label")).first() == (0, n * (n + 1) // 2 - 1, n * (n + 1) // 2)
        assert dim.where((a != F.col("a")) | (b != F.col("b"))).count() == 0


def test_pairs_edge(spark):
    df = spark.createDataFrame([(0, 3), (3, 0), (2, 2), (5, 1), (1, 5), (85, 1), (-1, 2)], "a int, b int")
    got = [r[0] for r in df.select(L.encode_symmetric(F.col("a"), F.col("b"), 85)).collect()]
    assert got == [3, 3, 169, 89, 89, None, None]
    assert [r[0] for r in df.select(L.mask_background(L.encode_symmetric(F.col("a"), F.col("b"), 85), 85)).collect()][:3] == [0, 0, 169]


def test_label_lines(spark):
    rows = ["# header", "", "7", "x y", "3 4 5", "1,2"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(rows)], "file string, line int, value string")
    assert [tuple(r) for r in text.parse_label_pairs(df).collect()] == [("f", 0, 3, 4), ("f", 1, 1, 2)]


def test_metric_lines(spark):
    files = {"one": ["1 2 nan abc 5"], "many": ["# x", "1", "2"], "short": ["1"], "long": ["1 2 3 4 5 6 7"], "empty": [""]}
    df = spark.createDataFrame([(f, i, v) for f, rows in files.items() for i, v in enumerate(rows)], "file string, line int, value string")
    n = spark.createDataFrame([(f, 5 if f != "many" else 3) for f in files], "file string, n int")
    got = {f: [r.value for r in text.parse_metric(df, n).where(F.col("file") == f).orderBy("ordinal").collect()] for f in files}
    assert got == {"one": [1, 2, None, None, 5], "many": [1, 2, None], "short": [None] * 5, "long": [1, 2, 3, 4, 5], "empty": [None] * 5}


def test_read_lines_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\r\n3 4\n\n")
    got = text.lines(spark, str(tmp_path / "a.txt")).orderBy("line").collect()
    assert [(r.line, r.value) for r in got] == [(0, "1 2"), (1, "3 4"), (2, "")]


def test_lines_of_files_in_many_splits(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 37), ("empty", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}\n" for k in range(n)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = text.lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1 and got.count() == 1037
        assert all(r.value.split()[1] == str(r.line) for r in got.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_counts(spark):
    df = spark.range(100).withColumnRenamed("id", "subject_id")
    got = {r.split: r["count"] for r in C.split_by_subject(df, "subject_id", F.xxhash64("subject_id")).groupBy("split").count().collect()}
    assert got == {"train": 69, "val": 10, "test": 21}


def test_rare_labels_never_add_labels(spark):
    df = spark.createDataFrame([(s, lab) for s in range(10) for lab in ((1, 2) if s < 2 else (1,))], "subject_id int, label int")
    rare = C.rare_labels_fit(df, "label", "subject_id", 30.0)
    assert [r.label for r in rare.collect()] == [2]
    assert {r.label for r in C.rare_labels_apply(df, rare, "label").select("label").distinct().collect()} == {0, 1}
