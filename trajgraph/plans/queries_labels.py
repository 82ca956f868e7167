"""Sources, sinks, labels and cleaning: queries S, K, L, T with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajgraph.functions import labels as L
from trajgraph.functions.ranks import numbered
from trajgraph.functions.tables import kept, shared_dir
from trajgraph.operators import clean as C
from trajgraph.operators import edges as E
from trajgraph.plans.fixtures import A20, KEYS, assign, assign_sql, edge_table, read, rounded, side, with_edges
from trajgraph.sources import sinks, text

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _lines(df, file, order, value):
    """Lines of text files made from a table: (file, line, value)."""
    from pyspark.sql.window import Window

    return df.select(file.cast("string").alias("file"), (F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1).alias("line"), value.alias("value"))


def _through_files(spark, rows):
    """(file, line, value) written as text files, a folder each, and read again."""
    path = f"{shared_dir(spark)}/texts/{uuid.uuid4().hex}"
    rows.repartition("file").sortWithinPartitions("file", "line").select("file", "value").write.partitionBy("file").text(path)
    return text.lines(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]*)/", 1))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "length_mm", "fa", "sift2"]
NUM = "row_number() OVER (PARTITION BY subject_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, length_mm, fa NULLS FIRST, sift2) - 1"


@query("s1_read_label_pairs", f"WITH {assign_sql()}, k AS (SELECT *, {NUM} AS ln FROM f_assign), z AS (SELECT * FROM k WHERE ln % 7 <> 0 AND ln % 11 <> 5) SELECT CAST(subject_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY subject_id ORDER BY ln) - 1 AS ordinal, ta AS node_a, tb AS node_b FROM z")
def s1(spark, d):
    a = assign(spark, d)
    numbered = _lines(a, F.col("subject_id"), ORDER, F.struct("ta", "tb"))
    sep = F.when(F.col("line") % 3 == 0, ",").otherwise("  ")
    value = F.when(F.col("line") % 7 == 0, F.concat(F.lit("# "), F.col("value.ta"))).when(F.col("line") % 11 == 5, F.concat(F.col("value.ta"), F.lit(" x"))).otherwise(F.concat(F.lit(" "), F.col("value.ta"), sep, F.col("value.tb"), F.lit("\r")))
    return text.parse_label_pairs(_through_files(spark, numbered.select("file", "line", value.alias("value"))))


@query("s2_read_int_labels", f"WITH {assign_sql()}, k AS (SELECT *, {NUM} AS ln FROM f_assign) SELECT CAST(subject_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY subject_id ORDER BY ln) - 1 AS ordinal, ta * 21 + tb AS label FROM k WHERE ln % 5 <> 0")
def s2(spark, d):
    numbered = _lines(assign(spark, d), F.col("subject_id"), ORDER, F.col("ta") * 21 + F.col("tb"))
    value = F.when(F.col("line") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return text.parse_int_labels(_through_files(spark, numbered.select("file", "line", value.alias("value"))))


@query("s3_read_streamline_metric", f"""WITH {assign_sql()}, k AS (SELECT *, {NUM} AS ln, count(*) OVER (PARTITION BY subject_id) AS c FROM f_assign), got AS (SELECT subject_id, ln, fa FROM k),
 e AS (SELECT subject_id, CASE subject_id % 3 WHEN 0 THEN c - 5 WHEN 1 THEN c + 7 ELSE 3 * c END AS n, c FROM k GROUP BY ALL), x AS (SELECT subject_id, n, c, unnest(range(0, n)) AS ordinal FROM e)
 SELECT CAST(x.subject_id AS VARCHAR) AS file, x.ordinal, CASE WHEN c >= 0.5 * n THEN fa END AS value FROM x LEFT JOIN got ON got.subject_id = x.subject_id AND got.ln = x.ordinal""")
def s3(spark, d):
    a = assign(spark, d)
    numbered = _lines(a, F.col("subject_id"), ORDER, F.col("fa"))
    token = F.coalesce(F.col("value").cast("string"), F.when(F.col("line") % 2 == 0, "nan").otherwise("abc"))
    # Eight values stand on one line; every file begins with a comment.
    packed = numbered.groupBy("file", F.floor(F.col("line") / 8).alias("row")).agg(F.array_sort(F.collect_list(F.struct("line", token.alias("t")))).alias("x"))
    rows = packed.select("file", (F.col("row") + 1).cast("int").alias("line"), F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("value"))
    heads = rows.select("file").distinct().select("file", F.lit(0).alias("line"), F.lit("# values").alias("value"))
    c = F.count(F.lit(1)).cast("int")
    n = a.groupBy("subject_id").agg(c.alias("c")).select(F.col("subject_id").cast("string").alias("file"), F.when(F.col("subject_id") % 3 == 0, F.col("c") - 5).when(F.col("subject_id") % 3 == 1, F.col("c") + 7).otherwise(3 * F.col("c")).alias("n"))
    return text.parse_metric(_through_files(spark, rows.union(heads)), n)


_CAND = "SELECT c_custkey AS subject_id, p AS priority, 'sub' || c_custkey || CASE p WHEN 0 THEN '/fa.txt' WHEN 1 THEN '/fa_thresholded.txt' ELSE '/old/fa.txt' END AS path FROM customer, (VALUES (0), (1), (2)) v(p) WHERE (c_custkey + p) % 3 <> 0"


def _candidates(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("priority")).where((F.col("subject_id") + F.col("priority")) % 3 != 0)
    return c.withColumn("path", F.concat(F.lit("sub"), "subject_id", F.when(F.col("priority") == 0, "/fa.txt").when(F.col("priority") == 1, "/fa_thresholded.txt").otherwise("/old/fa.txt")))


@query("s4_metric_file_fallback", f"WITH c AS ({_CAND}) SELECT subject_id, arg_min(path, priority) AS path FROM c GROUP BY subject_id")
def s4(spark, d):
    return text.pick_source(_candidates(spark, d), ["subject_id"])


def _matrix_files(spark, d, index=False):
    """Matrix files of the fa graphs: written as lines, read back."""
    e = side(edge_table(spark, d, metrics=["fa"]), "true").where(F.col("session") == "test").select("subject_id", "i", "j", "w")
    rows = sinks.matrix_lines(e, ["subject_id"], A20, None)
    line = F.concat(F.col("row").cast("string"), F.lit(","), "line") if index else F.regexp_replace("line", "0\\.0(?=,|$)", "nan")
    return _through_files(spark, rows.select(F.col("subject_id").cast("string").alias("file"), (F.col("row") - 1).alias("line"), line.alias("value")))


_MATRIX = f"{with_edges()} SELECT CAST(subject_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w, 8) + 0.0 AS w FROM f_edges WHERE version = 'true' AND session = 'test' AND ctype = 'fa'"


@query("s5_read_matrix_csv", _MATRIX)
def s5(spark, d):
    return rounded(text.parse_matrix(_matrix_files(spark, d)), ["w"], 8)


@query("s6_read_matrix_indexed", _MATRIX)
def s6(spark, d):
    return rounded(text.parse_matrix(_matrix_files(spark, d, True), index_column=True), ["w"], 8)


@query("s6_last_location_wins", f"WITH c AS ({_CAND}) SELECT subject_id, arg_max(path, priority) AS path FROM c GROUP BY subject_id")
def s6_last(spark, d):
    return text.pick_source(_candidates(spark, d), ["subject_id"], last=True)


@query("s7_read_subjects", "SELECT CAST(100000 + c_custkey AS VARCHAR) AS subject_id FROM customer WHERE c_custkey % 4 <> 0 ORDER BY c_custkey LIMIT 100")
def s7(spark, d):
    c = read(spark, d, "customer")
    value = F.when(F.col("c_custkey") % 4 == 0, F.lit(" \r")).otherwise(F.concat(F.lit(" "), (F.col("c_custkey") + 100000).cast("string"), F.lit("\r")))
    return text.parse_subjects(_through_files(spark, c.select(F.lit("all").alias("file"), F.col("c_custkey").alias("line"), value.alias("value"))), most=100)


@query("s7_subject_directories", "SELECT CAST(99990 + c_custkey AS VARCHAR) AS subject_id FROM customer WHERE c_custkey >= 10")
def s7_dirs(spark, d):
    return text.parse_subjects(read(spark, d, "customer").select(F.col("c_custkey").alias("line"), (F.col("c_custkey") + 99990).cast("string").alias("value")), directories=True)


@query("s8_parse_artifact_name", """SELECT CAST(100000 + c_custkey AS VARCHAR) AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'pred' ELSE 'true' END AS version, CASE c_custkey % 3 WHEN 0 THEN 'fa' WHEN 1 THEN 'nos' ELSE 'sift2' END AS ctype,
 CASE WHEN c_nationkey % 2 = 0 THEN 'aparc+aseg' ELSE 'aparc.a2009s+aseg' END AS atlas, CASE WHEN c_nationkey % 5 = 0 THEN 'retest' ELSE 'test' END AS session FROM customer""")
def s8(spark, d):
    c = read(spark, d, "customer")
    path = F.concat(F.when(F.col("c_nationkey") % 5 == 0, "/data/RETEST/").otherwise("/data/test/"), (F.col("c_custkey") + 100000).cast("string"), F.lit("/connectome_"), F.when(F.col("c_custkey") % 2 == 0, "pred").otherwise("true"), F.when(F.col("c_custkey") % 3 == 0, "_fa_").when(F.col("c_custkey") % 3 == 1, "_nos_").otherwise("_sift2_"), F.when(F.col("c_nationkey") % 2 == 0, "aparc+aseg").otherwise("aparc.a2009s+aseg"), F.lit(".csv"))
    return c.select(*[x.alias(k) for k, x in text.parse_artifact_name(path).items()])


@query("s9_load_pairs", f"{with_edges()}, e AS (SELECT * FROM f_edges WHERE NOT (version = 'pred' AND subject_id % 4 = 0 AND ctype = 'fa')), k AS (SELECT subject_id, session, ctype FROM e GROUP BY ALL HAVING count(DISTINCT version) = 2) SELECT subject_id, session, ctype, version, count(*) AS n, round(sum(w), 9) AS total FROM e JOIN k USING (subject_id, session, ctype) GROUP BY ALL")
def s9(spark, d):
    e = edge_table(spark, d).where(~((F.col("version") == "pred") & (F.col("subject_id") % 4 == 0) & (F.col("ctype") == "fa")))
    return E.load_pairs(e, [*KEYS, "ctype"]).groupBy(*KEYS, "ctype", "version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 9).alias("total"))


@query("s10_config_dims", "SELECT a AS atlas, n AS n_nodes, m AS metric, g AS agg, count(*) AS n_rows FROM nation, (VALUES ('aparc+aseg', 84), ('aparc.a2009s+aseg', 164)) x(a, n), (VALUES ('nos', 'count'), ('fa', 'mean'), ('md', 'mean'), ('ad', 'mean'), ('rd', 'mean'), ('sift2', 'sum')) y(m, g) WHERE (n_nationkey % 2 = 0) = (n = 84) GROUP BY ALL")
def s10(spark, d):
    atlas = spark.createDataFrame(list(L.ATLASES.items()), "atlas string, n_nodes int")
    metric = spark.createDataFrame(list(L.METRICS.items()), "metric string, agg string")
    n = read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, 84).otherwise(164).alias("n_nodes"))
    return n.join(F.broadcast(atlas), "n_nodes").join(F.broadcast(metric)).groupBy("atlas", "n_nodes", "metric", "agg").agg(F.count(F.lit(1)).alias("n_rows"))


_K1 = f"{with_edges()}, e AS (SELECT * FROM f_edges), k AS (SELECT DISTINCT subject_id, session, version, ctype FROM e), g AS (SELECT k.*, x.range AS i, y.range AS j FROM k, range(1, 21) x, range(1, 21) y)"


@query("k1_write_matrix_csv", f"{_K1} SELECT g.subject_id, g.session, g.version, g.ctype, g.i AS row, string_agg(printf('%.8f', CAST(round(CAST(round(coalesce(w, 0.0), 12) AS DECIMAL(28, 12)), 8) AS DOUBLE)), ',' ORDER BY g.j) AS line FROM g LEFT JOIN e ON e.subject_id = g.subject_id AND e.session = g.session AND e.version = g.version AND e.ctype = g.ctype AND e.i = least(g.i, g.j) AND e.j = greatest(g.i, g.j) GROUP BY ALL")
def k1(spark, d):
    """Matrices written as files and their lines read back; cells to 12 digits, of which halves of the eighth go up."""
    path = f"{shared_dir(spark)}/matrices/{uuid.uuid4().hex}"
    sinks.write_matrices(edge_table(spark, d), [*KEYS, "version", "ctype"], A20, path, 8)
    key = lambda name: F.regexp_extract("file", f"{name}=([^/]*)/", 1)
    return text.lines(spark, path).select(key("subject_id").cast("int").alias("subject_id"), *[key(c).alias(c) for c in ("session", "version", "ctype")], (F.col("line") + 1).alias("row"), F.col("value").alias("line"))


@query("k2_write_predictions", f"WITH {assign_sql()}, k AS (SELECT *, {NUM} AS ln FROM f_assign) SELECT subject_id, ln AS id, CAST(least(pa, pb) AS VARCHAR) || ' ' || CAST(greatest(pa, pb) AS VARCHAR) AS decoded, CAST(least(pa, pb) * 21 - (least(pa, pb) * (least(pa, pb) - 1)) // 2 + greatest(pa, pb) - least(pa, pb) AS VARCHAR) AS encoded FROM k")
def k2(spark, d):
    """Predictions written as decoded and encoded files, a line each streamline, and read back."""
    a = assign(spark, d).select(F.col("subject_id").cast("string").alias("file"), *ORDER, L.encode_symmetric(F.col("pa"), F.col("pb"), 21).alias("value"))
    k = numbered(a, ["file"], ORDER, ["value"], "line")
    path = f"{shared_dir(spark)}/predictions/{uuid.uuid4().hex}"
    sinks.write_predictions(k, ["file"], "line", "value", 21, path)
    back = lambda name: text.lines(spark, f"{path}/{name}").select(F.regexp_extract("file", "file=([^/]*)/", 1).cast("int").alias("subject_id"), F.col("line").alias("id"), F.col("value").alias(name))
    # Lines of a few characters are far larger as rows than their files tell Spark, so neither side is one for every task.
    return back("decoded").join(back("encoded").hint("merge"), ["subject_id", "id"])


@query("k3_encode_decode_file", f"WITH {assign_sql()}, k AS (SELECT *, {NUM} AS ln FROM f_assign) SELECT CAST(subject_id AS VARCHAR) AS file, ln AS ordinal, CAST(least(ta, tb) AS VARCHAR) || ' ' || CAST(greatest(ta, tb) AS VARCHAR) AS line FROM k")
def k3(spark, d):
    pairs = _lines(assign(spark, d), F.col("subject_id"), ORDER, F.concat_ws(" ", "ta", "tb"))
    encoded = sinks.encode_lines(text.parse_label_pairs(pairs), 21)
    labels = text.parse_int_labels(encoded.select("file", F.col("ordinal").alias("line"), F.col("line").alias("value")))
    return sinks.decode_lines(labels, 21)


@query("k4_write_results", f"{with_edges()} SELECT subject_id, session, version, ctype, count(*) AS n_edges, round(sum(w), 9) AS total FROM f_edges GROUP BY ALL")
def k4(spark, d):
    e = edge_table(spark, d).groupBy(*KEYS, "version", "ctype").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 9).alias("total"))
    path = f"{shared_dir(spark)}/results/{uuid.uuid4().hex}"
    sinks.write_results(e, path)
    return spark.read.option("header", True).schema(e.schema).csv(path)


_NUMBERS = ["mean", "std", "min", "q25", "median", "q75", "max"]


@query("k5_json_report", f"{with_edges()}, t AS (SELECT ctype, subject_id, round(sum(w), 5) AS total FROM f_edges GROUP BY ALL) SELECT ctype, count(*) AS n, round(avg(total), 5) AS mean, round(stddev_samp(total), 5) AS std, round(min(total), 5) AS min, round(quantile_cont(total, 0.25), 5) AS q25, round(quantile_cont(total, 0.5), 5) AS median, round(quantile_cont(total, 0.75), 5) AS q75, round(max(total), 5) AS max, count(total) AS count, round(sum(total), 4) AS record_total, max(subject_id) AS last_subject FROM t GROUP BY ctype")
def k5(spark, d):
    """Reports written as JSON and read back: the summary, and sums over the records."""
    e = edge_table(spark, d).groupBy("ctype", "subject_id").agg(F.round(F.sum("w"), 5).alias("total"))
    path = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    sinks.write_reports(e, ["ctype"], ["subject_id", "total"], ["total"], path)
    # A document in lines: the head, closed, has number and summary; each record is a line, all but the first after a comma.
    lines = spark.read.text(path)
    head = f"n long, summary struct<total: struct<{', '.join(f'{c}: double' for c in _NUMBERS)}, count: long>>"
    heads = lines.where(F.col("value").startswith('{"n"')).select("ctype", F.from_json(F.concat("value", F.lit("]}")), head).alias("r")).select("ctype", "r.n", "r.summary.total.*")
    record = F.from_json(F.regexp_replace("value", "^,", ""), "subject_id int, total double").alias("r")
    records = lines.where(~F.col("value").startswith('{"n"') & (F.col("value") != "]}")).select("ctype", record).groupBy("ctype").agg(F.sum("r.total").alias("record_total"), F.max("r.subject_id").alias("last_subject"))
    return rounded(rounded(heads.join(records, "ctype"), _NUMBERS, 5), ["record_total"], 4)


@query("k6_append_splits", f"WITH {assign_sql()} SELECT CASE WHEN subject_id % 5 = 0 THEN 'test' WHEN subject_id % 5 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM f_assign WHERE subject_id % 7 <> 3 OR subject_id NOT IN (SELECT subject_id FROM f_assign WHERE l_linenumber = 2) GROUP BY ALL")
def k6(spark, d):
    """Chunks of subjects appended to their splits as they stream in; subjects with another number of labels than of features wait."""
    from trajgraph.streaming.append import append_stream, counts_by_split

    base = f"{shared_dir(spark)}/append/{uuid.uuid4().hex}"
    # Stored, as all four writes and the splits read it.
    all_ = kept(assign(spark, d).select("subject_id", "ta", "tb", "length_mm", "l_linenumber"))
    labels = all_.where("subject_id % 7 <> 3 or l_linenumber <> 2")
    chunk, told = all_.select("subject_id", "ta", "tb", "length_mm"), labels.select("subject_id", "ta")
    subjects = chunk.select("subject_id").distinct()
    s = F.col("subject_id") % 5
    splits = kept(subjects.withColumn("split", F.when(s == 0, "test").when(s == 1, "val").otherwise("train")))
    # The second round has the labels of all subjects of the first one, so those wait for it.
    for rows, more in ((chunk.where("subject_id < 12"), told.where("subject_id < 6")), (chunk.where("subject_id >= 12"), told.where("subject_id >= 6"))):
        rows.write.mode("append").parquet(f"{base}/in")
        more.write.mode("append").parquet(f"{base}/labels")
        append_stream(spark, f"{base}/in", chunk.schema, splits, "subject_id", f"{base}/out", f"{base}/state", f"{base}/labels", told.schema)
    return counts_by_split(spark, f"{base}/out")


_TRACT = "CASE WHEN ta % 5 = 0 THEN 'Other' ELSE 'T' || (ta % 5) END"


@query("k7_partition_by_label", f"WITH {assign_sql()} SELECT {_TRACT} AS label_name, count(*) AS n FROM f_assign WHERE ta % 5 <> 0 GROUP BY ALL")
def k7(spark, d):
    a = assign(spark, d).select("subject_id", F.when(F.col("ta") % 5 == 0, "Other").otherwise(F.concat(F.lit("T"), F.col("ta") % 5)).alias("label_name"))
    path = f"{shared_dir(spark)}/labels/{uuid.uuid4().hex}"
    sinks.partition_by_label(a, "label_name", path)
    return spark.read.parquet(path).groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))


@query("k8_missing_outputs", f"{with_edges()}, x AS (SELECT DISTINCT subject_id, ctype FROM f_edges) SELECT DISTINCT subject_id FROM x WHERE (subject_id * 7 + length(ctype)) % 10 = 2")
def k8(spark, d):
    x = edge_table(spark, d).select("subject_id", "ctype").distinct()
    return E.missing_outputs(x, x.where((F.col("subject_id") * 7 + F.length("ctype")) % 10 != 2), ["subject_id", "ctype"], ["subject_id"])


@query("k9_load_or_compute", f"{with_edges()} SELECT ctype, count(*) AS n, round(sum(w), 9) AS total FROM f_edges GROUP BY ctype")
def k9(spark, d):
    path = f"{shared_dir(spark)}/cache/{uuid.uuid4().hex}"
    make = lambda: edge_table(spark, d).groupBy("ctype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 9).alias("total"))
    inputs = [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "customer")]
    sinks.load_or_compute(spark, path, make, inputs=inputs)
    return sinks.load_or_compute(spark, path, make, inputs=inputs)


_ENC = "least(ta, tb) * 21 - (least(ta, tb) * (least(ta, tb) - 1)) // 2 + greatest(ta, tb) - least(ta, tb)"


@query("l1_encode_symmetric", f"WITH {assign_sql()} SELECT subject_id, CASE WHEN tb < 19 THEN {_ENC} END AS label, count(*) AS n FROM (SELECT * FROM f_assign) GROUP BY ALL")
def l1(spark, d):
    # Node 19 and 20 of the second end are moved out of range.
    b = F.when(F.col("tb") >= 19, F.col("tb") + 10).otherwise(F.col("tb"))
    return assign(spark, d).groupBy("subject_id", L.encode_symmetric(F.col("ta"), b, 21).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("l2_decode_symmetric", f"WITH {assign_sql(40)} SELECT DISTINCT least(ta, tb) AS a, greatest(ta, tb) AS b FROM f_assign")
def l2(spark, d):
    a, b = L.decode_symmetric(L.encode_symmetric(F.col("ta"), F.col("tb"), 41), 41)
    return assign(spark, d, 40).select(a.alias("a"), b.alias("b")).distinct()


@query("l3_encode_decode_ordered", f"WITH {assign_sql()} SELECT DISTINCT ta * 21 + tb AS label, ta AS a, tb AS b FROM f_assign")
def l3(spark, d):
    k = L.encode_ordered(F.col("ta"), F.col("tb"), 21)
    a, b = L.decode_ordered(k, 21)
    return assign(spark, d).select(k.alias("label"), a.alias("a"), b.alias("b")).distinct()


@query("l4_label_dimension", f"WITH {assign_sql()}, g AS (SELECT a.range AS a, b.range AS b FROM range(0, 21) a JOIN range(0, 21) b ON a.range <= b.range), k AS (SELECT {_ENC} AS label, count(*) AS n FROM f_assign GROUP BY ALL), l AS (SELECT a * 21 - (a * (a - 1)) // 2 + b - a AS label, a, b, a || '_' || b AS name FROM g) SELECT l.label, a, b, name, coalesce(n, 0) AS n FROM l LEFT JOIN k USING (label)")
def l4(spark, d):
    a = assign(spark, d).select(L.encode_symmetric(F.col("ta"), F.col("tb"), 21).alias("label"))
    dim = L.label_dimension(spark, 21)
    return dim.join(C.class_histogram(a, "label", dim), "label")


@query("l5_convert_labels", f"WITH {assign_sql()} SELECT l_orderkey, array_to_string(list_sort(list({_ENC})), ',') AS labels FROM f_assign GROUP BY l_orderkey")
def l5(spark, d):
    pairs = assign(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("ta", "tb")).alias("p"))
    return pairs.select("l_orderkey", F.array_join(F.sort_array(F.transform("p", lambda x: L.encode_symmetric(x["ta"], x["tb"], 21))), ",").alias("labels"))


@query("l6_mask_background", f"WITH {assign_sql()}, k AS (SELECT {_ENC} AS label FROM f_assign) SELECT CASE WHEN label < 21 THEN 0 ELSE label END AS label, count(*) AS n FROM k GROUP BY 1")
def l6(spark, d):
    return assign(spark, d).groupBy(L.mask_background(L.encode_symmetric(F.col("ta"), F.col("tb"), 21), 21).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("l7_drop_background", f"WITH {assign_sql()} SELECT ta - 1 AS a, tb - 1 AS b, count(*) AS n FROM f_assign WHERE ta > 0 AND tb > 0 GROUP BY ALL")
def l7(spark, d):
    return assign(spark, d).where((F.col("ta") > 0) & (F.col("tb") > 0)).groupBy((F.col("ta") - 1).alias("a"), (F.col("tb") - 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("l8_detect_index_base", f"WITH {assign_sql()}, s AS (SELECT subject_id, session, ta, tb, CASE WHEN max(greatest(ta, tb)) OVER (PARTITION BY subject_id, session) = 20 THEN 1 ELSE 0 END AS sh FROM f_assign WHERE subject_id % 2 = 0 OR greatest(ta, tb) < 20), m AS (SELECT subject_id, session, ta - sh AS a, tb - sh AS b FROM s) SELECT subject_id, session, sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM m WHERE least(a, b) >= 0 AND greatest(a, b) < 20 GROUP BY ALL")
def l8(spark, d):
    a = assign(spark, d).where((F.col("subject_id") % 2 == 0) | (F.greatest("ta", "tb") < 20)).select(*KEYS, F.col("ta").alias("a"), F.col("tb").alias("b"))
    return L.detect_index_base(a, "a", "b", 20, KEYS).groupBy(*KEYS).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("n"))


@query("l9_cluster_to_tract", "WITH c AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 50 + 800 ELSE l_partkey % 50 END AS cluster FROM lineitem) SELECT CASE WHEN cluster >= 800 AND (cluster - 800) % 4 <> 3 THEN 3 WHEN cluster < 800 AND cluster % 4 <> 3 THEN cluster % 4 ELSE cluster END AS tract, count(*) AS n FROM c GROUP BY ALL")
def l9(spark, d):
    li = read(spark, d, "lineitem")
    name = F.format_string("cluster_%05d", (F.col("l_partkey") % 50 + 1).cast("int"))
    c = li.select((L.cluster_index(name) + F.when(F.col("l_partkey") % 3 == 0, 800).otherwise(0)).alias("cluster"))
    table = spark.range(50).select(F.col("id").cast("int").alias("cluster"), (F.col("id") % 4).cast("int").alias("tract")).where("tract <> 3")
    return L.cluster_to_tract(c, "cluster", table, 3).groupBy("tract").agg(F.count(F.lit(1)).alias("n"))


@query("l10_tract_cluster_map", "WITH c AS (SELECT DISTINCT l_partkey % 50 AS cluster FROM lineitem) SELECT CASE WHEN cluster % 4 = 3 THEN 'Other' ELSE 'T' || (cluster % 4) END AS tract, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS clusters FROM c GROUP BY 1")
def l10(spark, d):
    c = read(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("cluster")).distinct()
    table = c.where(F.col("cluster") % 4 != 3).withColumn("tract", F.concat(F.lit("T"), F.col("cluster") % 4))
    return L.tract_clusters(table, c).select("tract", F.array_join("clusters", ",").alias("clusters"))


@query("l11_relabel_lut", f"WITH {assign_sql()} SELECT CASE WHEN ta % 3 = 0 THEN 0 ELSE ta * 2 + 1 END AS node, count(*) AS n FROM f_assign GROUP BY 1")
def l11(spark, d):
    table = spark.range(21).where("id % 3 <> 0").select(F.col("id").alias("old"), (F.col("id") * 2 + 1).alias("new"))
    return L.relabel(assign(spark, d).select(F.col("ta").alias("node")), "node", table, "old", "new").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("l12_round_half_even", "SELECT l_quantity, round_even(l_quantity / 8, 2) AS r, count(*) AS n FROM lineitem GROUP BY ALL")
def l12(spark, d):
    return read(spark, d, "lineitem").groupBy("l_quantity", L.round_half_even(F.col("l_quantity") / 8, 2).alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("l13_parse_num_list", "SELECT l_orderkey, l_partkey, CAST(l_linenumber + l_partkey + l_suppkey AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def l13(spark, d):
    s = F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey")
    total = F.aggregate(L.parse_numbers(s), F.lit(0.0), lambda a, x: a + x)
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", total.alias("total")).agg(F.count(F.lit(1)).alias("n"))


@query("l14_composite_id", f"WITH {assign_sql()} SELECT DISTINCT subject_id * 7 + l_linenumber % 7 AS id, CAST(subject_id AS BIGINT) AS subject, CAST(l_linenumber % 7 AS BIGINT) AS aug FROM f_assign")
def l14(spark, d):
    c = L.composite_id(F.col("subject_id"), 7, F.col("l_linenumber") % 7)
    s, k = L.split_composite(c, 7)
    return assign(spark, d).select(c.alias("id"), s.alias("subject"), k.alias("aug")).distinct()


@query("l15_display_name", f"{with_edges()} SELECT ctype, CASE ctype WHEN 'nos' THEN 'NoS-weighted' WHEN 'fa' THEN 'FA-weighted' WHEN 'md' THEN 'MD-weighted' WHEN 'ad' THEN 'AD-weighted' WHEN 'rd' THEN 'RD-weighted' ELSE 'SIFT2-weighted' END AS name, CASE WHEN round(w, 12) < 0.001 THEN '***' WHEN round(w, 12) < 0.01 THEN '**' WHEN round(w, 12) < 0.05 THEN '*' ELSE 'n.s.' END AS mark, count(*) AS n FROM f_edges GROUP BY ALL")
def l15(spark, d):
    """Names and marks of all cells, to 12 digits: a mean on a bound isn't below it."""
    e = edge_table(spark, d)
    return e.groupBy("ctype", L.display_name(F.col("ctype")).alias("name"), L.stars(L.settled(F.col("w"))).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query("l16_weight_transform", f"{with_edges()}, m AS (SELECT *, max(w) OVER (PARTITION BY ctype, version) AS hi FROM f_edges) SELECT ctype, version, round(sum(ln(1 + w)), 6) AS log1p, round(sum(sqrt(w)), 6) AS root, round(sum(CASE WHEN ctype IN ('nos', 'sift2') AND hi > 100 THEN ln(1 + w) ELSE w END), 6) AS auto FROM m GROUP BY ALL")
def l16(spark, d):
    e = edge_table(spark, d)
    e = e.join(e.groupBy("ctype", "version").agg(F.max("w").alias("hi")), ["ctype", "version"])
    w = F.col("w")
    auto = L.weight_transform(w, "auto", F.col("hi"), F.col("ctype").isin("nos", "sift2"))
    return e.groupBy("ctype", "version").agg(F.round(F.sum(L.weight_transform(w, "log1p")), 6).alias("log1p"), F.round(F.sum(L.weight_transform(w, "sqrt")), 6).alias("root"), F.round(F.sum(auto), 6).alias("auto"))


_LAB = f"k AS (SELECT *, {_ENC} AS label FROM f_assign)"


def _labelled(spark, d):
    return assign(spark, d).withColumn("label", L.encode_symmetric(F.col("ta"), F.col("tb"), 21))


@query("t1_rare_labels_fit", f"WITH {assign_sql(40)}, k AS (SELECT *, least(ta, tb) * 41 - (least(ta, tb) * (least(ta, tb) - 1)) // 2 + greatest(ta, tb) - least(ta, tb) AS label FROM f_assign) SELECT label FROM k GROUP BY label HAVING count(DISTINCT subject_id) < 0.95 * (SELECT count(DISTINCT subject_id) FROM k)")
def t1(spark, d):
    a = assign(spark, d, 40).withColumn("label", L.encode_symmetric(F.col("ta"), F.col("tb"), 41))
    return C.rare_labels_fit(a, "label", "subject_id", 95.0)


@query("t2_rare_labels_apply", f"WITH {assign_sql(40)}, k AS (SELECT *, least(ta, tb) * 41 - (least(ta, tb) * (least(ta, tb) - 1)) // 2 + greatest(ta, tb) - least(ta, tb) AS label FROM f_assign), fit AS (SELECT label FROM k WHERE subject_id < 18 GROUP BY label HAVING count(DISTINCT subject_id) < 0.95 * (SELECT count(DISTINCT subject_id) FROM k WHERE subject_id < 18)) SELECT CASE WHEN label IN (SELECT label FROM fit) THEN 0 ELSE label END AS label, count(*) AS n FROM k WHERE subject_id >= 18 GROUP BY 1")
def t2(spark, d):
    a = assign(spark, d, 40).withColumn("label", L.encode_symmetric(F.col("ta"), F.col("tb"), 41))
    rare = C.rare_labels_fit(a.where("subject_id < 18"), "label", "subject_id", 95.0)
    return C.rare_labels_apply(a.where("subject_id >= 18"), rare, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("t3_split_by_subject", f"WITH {assign_sql()}, s AS (SELECT DISTINCT subject_id FROM f_assign), r AS (SELECT subject_id, row_number() OVER (ORDER BY (subject_id * 2654435761) % 4294967296, subject_id) AS k, count(*) OVER () AS n FROM s), x AS (SELECT subject_id, k, n, ceil(n * (1 - CAST(0.7 AS DOUBLE))) AS rest FROM r), y AS (SELECT subject_id, CASE WHEN k <= n - rest THEN 'train' WHEN k <= n - ceil(rest * (CAST(0.2 AS DOUBLE) / (CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE)))) THEN 'val' ELSE 'test' END AS split FROM x) SELECT subject_id, split, count(*) AS n FROM f_assign JOIN y USING (subject_id) GROUP BY ALL")
def t3(spark, d):
    order = (F.col("subject_id").cast("long") * 2654435761) % 4294967296
    return C.split_by_subject(assign(spark, d).select("subject_id"), "subject_id", order).groupBy("subject_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("t4_select_subjects", f"WITH {assign_sql()} SELECT subject_id, count(*) AS n FROM f_assign WHERE subject_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def t4(spark, d):
    s = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("subject_id"))
    return C.select_subjects(assign(spark, d), s, "subject_id").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("t5_class_histogram", f"WITH {assign_sql(40)}, k AS (SELECT least(ta, tb) * 41 - (least(ta, tb) * (least(ta, tb) - 1)) // 2 + greatest(ta, tb) - least(ta, tb) AS label, count(*) AS n FROM f_assign GROUP BY 1) SELECT r.range AS label, coalesce(n, 0) AS n FROM range(0, 861) r LEFT JOIN k ON k.label = r.range")
def t5(spark, d):
    a = assign(spark, d, 40).select(L.encode_symmetric(F.col("ta"), F.col("tb"), 41).alias("label"))
    return C.class_histogram(a, "label", L.label_dimension(spark, 41))


@query("t6_label_coverage", f"WITH {assign_sql(40)} SELECT round(count(DISTINCT least(ta, tb) * 100 + greatest(ta, tb)) / 861.0, 6) AS coverage FROM f_assign")
def t6(spark, d):
    a = assign(spark, d, 40).withColumn("label", L.encode_symmetric(F.col("ta"), F.col("tb"), 41))
    return rounded(C.label_coverage(a, "label", 861), ["coverage"])


@query("t7_alignment_check", f"WITH {assign_sql()} SELECT subject_id, count(*) AS labels, count(*) FILTER (length_mm < 50 OR subject_id % 2 = 0) AS lengths, count(*) FILTER (subject_id <> 3) AS predictions FROM f_assign GROUP BY ALL HAVING NOT (labels = lengths AND labels = predictions)")
def t7(spark, d):
    a = assign(spark, d)
    return C.alignment_check({"labels": a, "lengths": a.where("length_mm < 50 or subject_id % 2 = 0"), "predictions": a.where("subject_id <> 3")}, "subject_id")


@query("t8_subject_index", f"WITH {assign_sql()} SELECT subject_id, dense_rank() OVER (ORDER BY subject_id) - 1 AS subject_index, count(*) AS n FROM f_assign WHERE subject_id % 3 <> 0 GROUP BY subject_id")
def t8(spark, d):
    return C.subject_index(assign(spark, d).where("subject_id % 3 <> 0"), "subject_id").groupBy("subject_id", "subject_index").agg(F.count(F.lit(1)).alias("n"))


@query("t9_argmax_label", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label FROM embeddings")
def t9(spark, d):
    return read(spark, d, "embeddings").select("vec_id", C.argmax_label(F.col("embedding")).alias("label"))
