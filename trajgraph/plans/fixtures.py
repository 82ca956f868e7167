"""Views of the given tables as streamlines, polylines, features, classes and graphs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajgraph.operators import edges as E

#: Real nodes of the two node sets of the views.
A20, A40 = 20, 40
METRICS = ["nos", "fa", "md", "ad", "rd", "sift2"]
VERSIONS = {"true": ("ta", "tb"), "pred": ("pa", "pb")}
KEYS = ["subject_id", "session"]


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and 0 for -0."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(F.col(c), digits) for c in columns})


#: Orders that every task may hold.
FEW_ORDERS = 200_000


def assign(spark: SparkSession, d: str, nodes: int = A20) -> DataFrame:
    """One row a streamline: lineitem with the subject of its order's customer.

    Orders get their subject first, so lineitem is shuffled once, or not at all where orders are few.
    """
    n = nodes + 1
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_extendedprice")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    subjects = o.join(c, "c_custkey").select("l_orderkey", "c_nationkey")
    j = li.join(F.broadcast(subjects) if o.count() <= FEW_ORDERS else subjects, "l_orderkey")
    disc = F.col("l_discount")
    return j.select(
        F.col("c_nationkey").alias("subject_id"), F.when(F.col("l_linestatus") == "F", "test").otherwise("retest").alias("session"),
        (F.col("l_partkey") % n).alias("ta"), (F.col("l_suppkey") % n).alias("tb"),
        F.when(F.col("l_linenumber") % 4 == 0, (F.col("l_partkey") + 1) % n).otherwise(F.col("l_partkey") % n).alias("pa"), (F.col("l_suppkey") % n).alias("pb"),
        F.col("l_quantity").alias("length_mm"), F.when(F.col("l_linenumber") != 7, disc).alias("fa"), (disc / 100).alias("md"), (disc / 50).alias("ad"), (disc / 200).alias("rd"), F.col("l_tax").alias("sift2"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def assign_sql(nodes: int = A20, name: str = "f_assign") -> str:
    n = nodes + 1
    return f"""{name} AS (SELECT c_nationkey AS subject_id, CASE WHEN l_linestatus='F' THEN 'test' ELSE 'retest' END AS session,
      l_partkey % {n} AS ta, l_suppkey % {n} AS tb, CASE WHEN l_linenumber % 4 = 0 THEN (l_partkey + 1) % {n} ELSE l_partkey % {n} END AS pa, l_suppkey % {n} AS pb,
      CAST(l_quantity AS DOUBLE) AS length_mm, CASE WHEN l_linenumber <> 7 THEN CAST(l_discount AS DOUBLE) END AS fa, CAST(l_discount AS DOUBLE)/100 AS md,
      CAST(l_discount AS DOUBLE)/50 AS ad, CAST(l_discount AS DOUBLE)/200 AS rd, CAST(l_tax AS DOUBLE) AS sift2, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def edge_table(spark: SparkSession, d: str, nodes: int = A20, keys: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """(keys, version, ctype, i, j, w) of all subjects."""
    return E.edges_all_metrics(assign(spark, d, nodes), VERSIONS, metrics or METRICS, keys or KEYS, nodes)


def both_table(spark: SparkSession, d: str, nodes: int = A20, keys: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """(keys, ctype, i, j, t, p): the true and the predicted graphs of all subjects side by side."""
    return E.edges_both(assign(spark, d, nodes), VERSIONS["true"], VERSIONS["pred"], metrics or METRICS, keys or KEYS, nodes)


def edges_sql(nodes: int = A20, keys: list[str] | None = None, source: str = "f_assign", name: str = "f_edges") -> str:
    k = ", ".join(keys or KEYS)
    return f"""f_long AS (SELECT *, 'true' AS version, least(ta, tb) AS i, greatest(ta, tb) AS j FROM {source} UNION ALL SELECT *, 'pred' AS version, least(pa, pb) AS i, greatest(pa, pb) AS j FROM {source}),
    f_cells AS (SELECT {k}, version, i, j, CAST(count(*) AS DOUBLE) AS nos, avg(fa) AS fa, avg(md) AS md, avg(ad) AS ad, avg(rd) AS rd, sum(sift2) AS sift2 FROM f_long WHERE i >= 1 AND j <= {nodes} GROUP BY {k}, version, i, j),
    {name} AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f"SELECT {k}, version, '{m}' AS ctype, i, j, {m} AS w FROM f_cells" for m in METRICS)}) WHERE w IS NOT NULL AND w <> 0)"""


def with_edges(nodes: int = A20, keys: list[str] | None = None) -> str:
    return f"WITH {assign_sql(nodes)}, {edges_sql(nodes, keys)}"


def side(e: DataFrame, version: str) -> DataFrame:
    return e.where(F.col("version") == version).drop("version")


CMP_KEYS = ["subject_id", "session", "ctype"]


def both_sql(keys: list[str] | None = None) -> str:
    """f_both: the cells of either side; f_keys: keys that both have."""
    k = keys or CMP_KEYS
    on = " AND ".join(f"a.{c} = b.{c}" for c in [*k, "i", "j"])
    return f"""f_t AS (SELECT * FROM f_edges WHERE version = 'true'), f_p AS (SELECT * FROM f_edges WHERE version = 'pred'),
    f_both AS (SELECT {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in [*k, 'i', 'j'])}, coalesce(a.w, 0) AS t, coalesce(b.w, 0) AS p FROM f_t a FULL JOIN f_p b ON {on})"""


def polylines(spark: SparkSession, d: str) -> DataFrame:
    """(subject_id, streamline_id, points): the events of a user in order of time."""
    e = read(spark, d, "events")
    p = F.struct("ts", "event_id", F.col("value").alias("r"), (F.hour("ts") + F.minute("ts") / 60.0).alias("a"), (F.col("event_id") % 50).cast("double").alias("s"))
    lists = e.groupBy((F.col("user_id") % 10).alias("subject_id"), F.col("user_id").alias("streamline_id")).agg(F.array_sort(F.collect_list(p)).alias("points"))
    return lists.withColumn("points", F.transform("points", lambda x: F.struct(x["r"].alias("r"), x["a"].alias("a"), x["s"].alias("s"))))


#: f_points: one row a point with its place k from 0 and the number of points n.
POINTS_SQL = """f_points AS (SELECT user_id % 10 AS subject_id, user_id AS streamline_id, value AS r, hour(ts) + minute(ts) / 60.0 AS a, CAST(event_id % 50 AS DOUBLE) AS s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """(subject_id, streamline_id, feat): 15 points of the first 45 numbers of a vector."""
    v = read(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", i + 1).cast("double")
    feat = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.struct(at(3 * k).alias("r"), at(3 * k + 1).alias("a"), at(3 * k + 2).alias("s")))
    return v.select(F.col("label").alias("subject_id"), F.col("vec_id").alias("streamline_id"), feat.alias("feat"))


#: f_feat: the vectors with their first 45 numbers as doubles, and the same reversed point by point.
FEAT_SQL = """f_feat AS (SELECT label AS subject_id, vec_id AS streamline_id, [CAST(embedding[x] AS DOUBLE) FOR x IN range(1, 46)] AS v,
    [CAST(embedding[(14 - (x // 3)) * 3 + (x % 3) + 1] AS DOUBLE) FOR x IN range(0, 45)] AS rv FROM embeddings)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    """(lang, true, pred): quality of labelled documents against their length."""
    doc, lab = read(spark, d, "documents"), read(spark, d, "labels")
    return doc.join(lab, "doc_id").select("lang", F.col("quality").alias("true"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("pred"))


CLASS_SQL = "f_class AS (SELECT lang, quality AS true_l, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS pred_l FROM documents JOIN labels USING (doc_id))"


GRAPH_KEYS = ["subject_id", "session", "version"]


def graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of counts: every subject, session and version."""
    return edge_table(spark, d, metrics=["nos"]).select(*GRAPH_KEYS, "i", "j", "w")


GRAPHS_SQL = f"""{assign_sql()}, g_long AS (SELECT subject_id, session, 'true' AS version, least(ta, tb) AS i, greatest(ta, tb) AS j FROM f_assign UNION ALL SELECT subject_id, session, 'pred', least(pa, pb), greatest(pa, pb) FROM f_assign),
    f_graph AS MATERIALIZED (SELECT subject_id, session, version, i, j, CAST(count(*) AS DOUBLE) AS w FROM g_long WHERE i >= 1 AND j <= {A20} GROUP BY ALL),
    f_arcs AS MATERIALIZED (SELECT subject_id, session, version, i AS s, j AS t, w FROM f_graph UNION ALL SELECT subject_id, session, version, j, i, w FROM f_graph WHERE i <> j)"""
