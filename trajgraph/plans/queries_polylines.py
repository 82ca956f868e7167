"""Polylines, neighbours and graph construction: queries P and A with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajgraph.functions import polyline as P
from trajgraph.operators import compare as C
from trajgraph.operators import edges as E
from trajgraph.operators import neighbors as N
from trajgraph.plans.fixtures import A20, A40, CMP_KEYS, FEAT_SQL, KEYS, METRICS, POINTS_SQL, VERSIONS, assign, assign_sql, both_sql, both_table, edge_table, edges_sql, features, polylines, rounded, with_edges

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _points(df, points="points"):
    """One row a point: (subject_id, streamline_id, k, r, a, s)."""
    return rounded(df.select("subject_id", "streamline_id", F.posexplode(points).alias("k", "p")).select("subject_id", "streamline_id", "k", "p.*"), ["r", "a", "s"])


_OUT = "round(r, 6) + 0.0 AS r, round(a, 6) + 0.0 AS a, round(s, 6) + 0.0 AS s"


@query("p1_resample_floor", f"WITH {POINTS_SQL} SELECT p.subject_id, p.streamline_id, q.range AS k, {_OUT} FROM f_points p JOIN range(0, 15) q ON p.k = CAST(floor(q.range * (p.n - 1) / 14.0) AS BIGINT)")
def p1(spark, d):
    p = polylines(spark, d)
    return _points(p.withColumn("points", P.resample_floor(F.col("points"))))


def _resample_sql(decay: float) -> str:
    fr = P.fractions(15, decay)
    values = ", ".join(f"({k}, CAST({f!r} AS DOUBLE))" for k, f in enumerate(fr))
    mix = lambda c: f"round(lo.{c} + (x - floor(x)) * (hi.{c} - lo.{c}), 6) + 0.0 AS {c}"
    return f"""WITH {POINTS_SQL}, q AS (SELECT * FROM (VALUES {values}) v(k, f)), l AS (SELECT DISTINCT subject_id, streamline_id, n FROM f_points), x AS (SELECT subject_id, streamline_id, n, q.k, f * (n - 1) AS x FROM l, q)
    SELECT x.subject_id, x.streamline_id, x.k, {mix('r')}, {mix('a')}, {mix('s')} FROM x JOIN f_points lo ON lo.streamline_id = x.streamline_id AND lo.k = least(CAST(floor(x) AS BIGINT), x.n - 1) JOIN f_points hi ON hi.streamline_id = x.streamline_id AND hi.k = least(CAST(ceil(x) AS BIGINT), x.n - 1)"""


@query("p2_resample_even", _resample_sql(0.0))
def p2(spark, d):
    return _points(polylines(spark, d).withColumn("points", P.resample(F.col("points"), 15, 0.0)))


@query("p2_resample_decay", _resample_sql(2.0))
def p2_decay(spark, d):
    return _points(polylines(spark, d).withColumn("points", P.resample(F.col("points"), 15, 2.0)))


@query("p3_hits_endpoint", f"WITH {POINTS_SQL} SELECT true AS hits, count(DISTINCT streamline_id) AS n FROM f_points")
def p3(spark, d):
    return polylines(spark, d).groupBy(P.hits_endpoint(F.col("points"), 15, 2.0).alias("hits")).agg(F.count(F.lit(1)).alias("n"))


_LEN = f"WITH {POINTS_SQL}, x AS (SELECT *, lag(r) OVER w AS pr, lag(a) OVER w AS pa, lag(s) OVER w AS ps FROM f_points WINDOW w AS (PARTITION BY streamline_id ORDER BY k)), l AS (SELECT subject_id, streamline_id, sum(coalesce(sqrt((r-pr)*(r-pr)+(a-pa)*(a-pa)+(s-ps)*(s-ps)), 0)) AS len FROM x GROUP BY ALL)"


@query("p4_polyline_length", f"{_LEN} SELECT subject_id, streamline_id, round(len, 6) AS len FROM l")
def p4(spark, d):
    return polylines(spark, d).select("subject_id", "streamline_id", F.round(P.length(F.col("points")), 6).alias("len"))


@query("p5_length_filter", f"WITH {assign_sql()} SELECT subject_id, session, count(*) AS n, round(sum(sift2), 6) AS sift2, round(sum(fa), 6) AS fa FROM f_assign WHERE length_mm >= 20 AND length_mm <= 45 GROUP BY ALL")
def p5(spark, d):
    a = assign(spark, d).where(F.col("length_mm").between(20, 45))
    return a.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sift2"), 6).alias("sift2"), F.round(F.sum("fa"), 6).alias("fa"))


_VOX = "floor(r / 5) AS vr, floor(a / 5) AS va, floor(s / 5) AS vs"
_FIELD = f"vox AS (SELECT *, {_VOX} FROM f_points), field AS (SELECT DISTINCT vr, va, vs, CAST(abs(vr * 7 + va * 3 + vs) % 10 AS DOUBLE) AS value, CAST(abs(vr + va + vs) % 20 + 1 AS INTEGER) AS node FROM vox WHERE abs(vr + va + vs) % 4 <> 0)"


def _field(spark, d):
    v = polylines(spark, d).select(F.explode("points").alias("p")).select(N.voxel(F.col("p"), 5.0).alias("voxel")).distinct()
    total = F.col("voxel.r") + F.col("voxel.a") + F.col("voxel.s")
    v = v.where(F.abs(total) % 4 != 0)
    return v.select("voxel", (F.abs(F.col("voxel.r") * 7 + F.col("voxel.a") * 3 + F.col("voxel.s")) % 10).cast("double").alias("value"), (F.abs(total) % 20 + 1).cast("int").alias("node"))


@query("p6_sample_field", f"WITH {POINTS_SQL}, {_FIELD} SELECT subject_id, streamline_id, round(avg(value), 6) AS value FROM vox JOIN field USING (vr, va, vs) GROUP BY ALL")
def p6(spark, d):
    return rounded(N.sample_field(polylines(spark, d), ["subject_id", "streamline_id"], "points", _field(spark, d), 5.0), ["value"])


@query("p7_assign_endpoints", f"WITH {POINTS_SQL}, {_FIELD}, e AS (SELECT streamline_id, subject_id, k, n, coalesce(node, 0) AS node FROM vox LEFT JOIN field USING (vr, va, vs)) SELECT a.subject_id, a.streamline_id, a.node AS node_a, b.node AS node_b FROM e a JOIN e b ON a.streamline_id = b.streamline_id AND a.k = 0 AND b.k = b.n - 1")
def p7(spark, d):
    return N.assign_endpoints(polylines(spark, d), ["subject_id", "streamline_id"], "points", _field(spark, d).select("voxel", "node"), 5.0)


@query("p8_recenter", f"WITH {FEAT_SQL}, x AS (SELECT subject_id, streamline_id, unnest(range(0, 15)) AS k, v FROM f_feat), y AS (SELECT subject_id, streamline_id, k, v[3*k+1] AS r, v[3*k+2] AS a, v[3*k+3] AS s FROM x) SELECT subject_id, streamline_id, k, round(r + (1.0 - avg(r) OVER w), 6) + 0.0 AS r, round(a + (2.0 - avg(a) OVER w), 6) + 0.0 AS a, round(s + (3.0 - avg(s) OVER w), 6) + 0.0 AS s FROM y WINDOW w AS (PARTITION BY subject_id, k)")
def p8(spark, d):
    return _points(N.recenter(features(spark, d), ["subject_id"], "streamline_id", "feat", (1.0, 2.0, 3.0)), "feat")


@query("p9_augment", f"WITH {FEAT_SQL}, x AS (SELECT subject_id, streamline_id, aug_id, unnest(range(0, 15)) AS k, v FROM f_feat, (VALUES (0), (1)) g(aug_id)), y AS (SELECT subject_id, streamline_id, aug_id, k, v[3*k+1] AS r, v[3*k+2] AS a, v[3*k+3] AS s, 0.1 * (subject_id + 1) * (aug_id + 1) AS th, 1.0 + 0.05 * aug_id AS sc, 0.5 * subject_id AS tx FROM x) SELECT subject_id, streamline_id, aug_id, k, round(sc * (cos(th) * r - sin(th) * a) + tx, 6) + 0.0 AS r, round(sc * (sin(th) * r + cos(th) * a), 6) + 0.0 AS a, round(sc * s, 6) + 0.0 AS s FROM y")
def p9(spark, d):
    f = features(spark, d)
    zero = F.lit(0.0)
    rows = f.select("subject_id").distinct().withColumn("aug_id", F.explode(F.array(F.lit(0), F.lit(1))))
    turn, scale = F.lit(0.1) * (F.col("subject_id") + 1) * (F.col("aug_id") + 1), F.lit(1.0) + F.lit(0.05) * F.col("aug_id")
    params = rows.withColumn("matrix", P.affine_of(zero, zero, turn, scale, F.lit(0.5) * F.col("subject_id"), zero, zero))
    out = N.augment(f, "subject_id", "feat", params)
    each = out.select("subject_id", "streamline_id", "aug_id", F.posexplode("feat").alias("k", "p")).select("subject_id", "streamline_id", "aug_id", "k", "p.*")
    return rounded(each, ["r", "a", "s"])


def _draw(name: str, lo: float, hi: float) -> str:
    return f"({lo} + ({hi - lo}) * (CAST('0x' || substr(md5('{name}/' || subject_id || '/' || aug_id || '/42'), 1, 12) AS BIGINT) / 281474976710656.0))::DOUBLE"


#: Lengths don't change under rotations and shifts: the scale alone matters.
@query("p9_augment_random", f"WITH {FEAT_SQL}, a AS (SELECT subject_id, streamline_id, g.aug_id, v FROM f_feat, (VALUES (0), (1), (2)) g(aug_id)), s AS (SELECT *, {_draw('scale', 0.9, 1.1)} AS sc, list_sum([sqrt(pow(v[3*x+4] - v[3*x+1], 2) + pow(v[3*x+5] - v[3*x+2], 2) + pow(v[3*x+6] - v[3*x+3], 2)) FOR x IN range(0, 14)]) AS len FROM a) SELECT subject_id, streamline_id, CAST(aug_id AS INTEGER) AS aug_id, round(sc * len, 6) AS length FROM s")
def p9_random(spark, d):
    f = features(spark, d)
    params = N.augment_params(f, "subject_id", 3, 0.5, (0.1, 0.1), 2.0)
    out = N.augment(f, "subject_id", "feat", params)
    return out.select("subject_id", "streamline_id", "aug_id", F.round(P.length(F.col("feat")), 6).alias("length"))


@query("p10_include_original", "SELECT CASE WHEN a = 2 THEN -1 ELSE a END AS aug_id, label AS subject_id, count(*) AS n FROM embeddings, (VALUES (0), (1), (2)) v(a) GROUP BY ALL")
def p10(spark, d):
    f = features(spark, d)
    augmented = N.augment(f, "subject_id", "feat", N.augment_params(f, "subject_id", 2, 0.5, (0.0, 0.0), 2.0))
    return N.include_original(augmented, f).groupBy("aug_id", "subject_id").agg(F.count(F.lit(1)).alias("n"))


_D = "sqrt(list_sum([pow(a.v[x] - b.v[x], 2) FOR x IN range(1, 46)])) / 15"
_DR = "sqrt(list_sum([pow(a.v[x] - b.rv[x], 2) FOR x IN range(1, 46)])) / 15"
_DE = "sqrt(list_sum([pow(a.v[x] - b.v[x], 2) FOR x IN [1, 2, 3, 43, 44, 45]])) / 15"
_DER = "sqrt(list_sum([pow(a.v[x] - b.rv[x], 2) FOR x IN [1, 2, 3, 43, 44, 45]])) / 15"
_PAIRS = "f_feat a JOIN f_feat b ON a.subject_id = b.subject_id AND a.streamline_id % 100 = 0 AND a.streamline_id <> b.streamline_id"


def _pairs(spark, d):
    """The stated query set, lines whose id is divisible by 100, against all other lines of their subject."""
    return N.query_pairs(features(spark, d), ["subject_id"], "streamline_id", "feat", F.col("streamline_id") % 100 == 0)


@query("p11_streamline_distance", f"WITH {FEAT_SQL} SELECT a.streamline_id AS x_id, b.streamline_id AS y_id, round({_D}, 6) AS dist FROM {_PAIRS}")
def p11(spark, d):
    return _pairs(spark, d).select("x_id", "y_id", F.round(P.distance(F.col("x"), F.col("y")), 6).alias("dist"))


@query("p12_mdf", f"WITH {FEAT_SQL} SELECT a.streamline_id AS x_id, b.streamline_id AS y_id, round(least({_D}, {_DR}), 6) AS dist, CASE WHEN {_DR} < {_D} THEN 1 ELSE 0 END AS flip FROM {_PAIRS}")
def p12(spark, d):
    m = P.mdf(F.col("x"), F.col("y"))
    return _pairs(spark, d).select("x_id", "y_id", m.alias("m")).select("x_id", "y_id", F.round("m.dist", 6).alias("dist"), "m.flip")


@query("p13_mdf_endpoints", f"WITH {FEAT_SQL} SELECT a.streamline_id AS x_id, b.streamline_id AS y_id, round(least({_DE}, {_DER}), 6) AS dist, CASE WHEN {_DER} < {_DE} THEN 1 ELSE 0 END AS flip FROM {_PAIRS}")
def p13(spark, d):
    m = P.mdf_endpoints(F.col("x"), F.col("y"))
    return _pairs(spark, d).select("x_id", "y_id", m.alias("m")).select("x_id", "y_id", F.round("m.dist", 6).alias("dist"), "m.flip")


def _knn_sql(extra: str = "", join: str = "a.subject_id = b.subject_id") -> str:
    return f"WITH {FEAT_SQL}{extra} SELECT subject_id, streamline_id, neighbour, round(dist, 6) AS dist, flip, rank FROM (SELECT a.subject_id, a.streamline_id, b.streamline_id AS neighbour, least({_D}, {_DR}) AS dist, CASE WHEN {_DR} < {_D} THEN 1 ELSE 0 END AS flip, row_number() OVER (PARTITION BY a.subject_id, a.streamline_id ORDER BY round(least({_D}, {_DR}), 9), b.streamline_id) AS rank FROM f_feat a JOIN f_feat b ON {join}) WHERE rank <= 5"


@query("p14_knn", _knn_sql())
def p14(spark, d):
    return rounded(N.knn(features(spark, d), ["subject_id"], "streamline_id", "feat", 5), ["dist"])


_SAMPLE = ", f_s AS (SELECT subject_id, streamline_id, row_number() OVER (PARTITION BY subject_id ORDER BY (streamline_id * 2654435761) % 4294967296, streamline_id) AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM f_feat), f_c AS (SELECT streamline_id FROM f_s WHERE k <= floor(n * CAST(0.3 AS DOUBLE)))"


@query("p14_knn_sampled", _knn_sql(_SAMPLE, "a.subject_id = b.subject_id AND b.streamline_id IN (SELECT streamline_id FROM f_c)"))
def p14_sampled(spark, d):
    f = features(spark, d)
    c = N.rate_sample(f, ["subject_id"], (F.col("streamline_id") * 2654435761) % 4294967296, 0.3, "streamline_id")
    return rounded(N.knn(f, ["subject_id"], "streamline_id", "feat", 5, c), ["dist"])


_BLOCK = ", f_b AS (SELECT subject_id AS sj, streamline_id AS id, row_number() OVER (PARTITION BY subject_id ORDER BY streamline_id) - 1 AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM f_feat), f_k AS (SELECT sj, id, k // (n // greatest(n // 10000, 1) + 1) AS b FROM f_b)"


@query("p15_knn_blocked", _knn_sql(_BLOCK, "a.subject_id = b.subject_id AND (SELECT b FROM f_k WHERE id = a.streamline_id) = (SELECT b FROM f_k WHERE id = b.streamline_id)").replace("FROM f_feat a JOIN f_feat b ON a.subject_id = b.subject_id AND (SELECT b FROM f_k WHERE id = a.streamline_id) = (SELECT b FROM f_k WHERE id = b.streamline_id)", "FROM f_feat a JOIN f_k ka ON ka.id = a.streamline_id JOIN f_feat b ON a.subject_id = b.subject_id JOIN f_k kb ON kb.id = b.streamline_id AND ka.b = kb.b"))
def p15(spark, d):
    return rounded(N.knn(features(spark, d), ["subject_id"], "streamline_id", "feat", 5, block=10_000), ["dist"])


@query("p16_global_sample", "WITH r AS (SELECT label AS subject_id, vec_id AS streamline_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings), d AS (SELECT subject_id, n, unnest(range(0, 20)) AS draw FROM (SELECT DISTINCT subject_id, n FROM r)) SELECT d.subject_id, CAST(d.draw AS INTEGER) AS draw, streamline_id FROM d JOIN r ON r.subject_id = d.subject_id AND r.k = (((d.subject_id * 7919 + d.draw) * 2654435761) % 4294967296) % d.n")
def p16(spark, d):
    number = ((F.col("subject_id") * 7919 + F.col("draw")) * 2654435761) % 4294967296
    return N.global_sample(features(spark, d), ["subject_id"], "streamline_id", 20, number=number).select("subject_id", "draw", "streamline_id")


@query("p17_capped_sample", "SELECT label AS subject_id, vec_id AS streamline_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) <= 12")
def p17(spark, d):
    f = features(spark, d).select("subject_id", "streamline_id")
    return N.capped_sample(f, ["subject_id"], (F.col("streamline_id") * 2654435761) % 4294967296, 12, "streamline_id")


@query("p18_distance_by_norms", f"WITH {FEAT_SQL} SELECT a.streamline_id AS x_id, b.streamline_id AS y_id, round({_D}, 6) AS dist FROM {_PAIRS}")
def p18(spark, d):
    dist = P.distance_by_norms(P.norm(F.col("x")), P.norm(F.col("y")), P.dot(F.col("x"), F.col("y")))
    return _pairs(spark, d).select("x_id", "y_id", F.round(dist, 6).alias("dist"))


def _one(ctype: str, expr: str) -> str:
    return f"WITH {assign_sql(A40)} SELECT subject_id, session, least(ta, tb) AS i, greatest(ta, tb) AS j, round({expr}, 8) + 0.0 AS w FROM f_assign WHERE least(ta, tb) >= 1 AND greatest(ta, tb) <= 40 GROUP BY ALL HAVING {expr} IS NOT NULL AND {expr} <> 0"


@query("a1_edges_count", _one("nos", "CAST(count(*) AS DOUBLE)"))
def a1(spark, d):
    return rounded(E.edges(assign(spark, d, A40), "ta", "tb", KEYS, A40), ["w"], 8)


@query("a2_edges_mean", _one("fa", "avg(fa)"))
def a2(spark, d):
    # Weights that are not finite don't count: null, nan and infinity stand in for missing ones here.
    a = assign(spark, d, A40)
    odd = F.when(F.col("fa").isNull() & (F.col("l_partkey") % 2 == 0), F.lit(float("nan"))).when(F.col("fa").isNull() & (F.col("l_partkey") % 3 == 0), F.lit(float("inf"))).otherwise(F.col("fa"))
    return rounded(E.edges(a.withColumn("fa", odd), "ta", "tb", KEYS, A40, "fa", "mean"), ["w"], 8)


@query("a3_edges_sum", _one("sift2", "sum(sift2)"))
def a3(spark, d):
    return rounded(E.edges(assign(spark, d, A40), "ta", "tb", KEYS, A40, "sift2", "sum"), ["w"], 8)


@query("a4_edges_all_metrics", f"{with_edges(A40)} SELECT subject_id, session, version, ctype, i, j, round(w, 8) + 0.0 AS w FROM f_edges")
def a4(spark, d):
    return rounded(edge_table(spark, d, A40), ["w"], 8)


@query("a5_edges_accuracy", f"WITH {assign_sql()}, k AS (SELECT subject_id, ta * 21 + tb AS t, pa * 21 + pb AS p FROM f_assign), l AS (SELECT subject_id, t AS label FROM k UNION SELECT subject_id, p FROM k), a AS (SELECT subject_id, t AS label, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS acc FROM k GROUP BY ALL) SELECT l.subject_id, l.label, round(coalesce(acc, 1.0), 6) AS accuracy FROM l LEFT JOIN a ON a.subject_id = l.subject_id AND a.label = l.label")
def a5(spark, d):
    a = assign(spark, d).select("subject_id", (F.col("ta") * 21 + F.col("tb")).alias("t"), (F.col("pa") * 21 + F.col("pb")).alias("p"))
    return rounded(E.edges_accuracy(a, "t", "p", ["subject_id"]), ["accuracy"])


_A6 = f"WITH {assign_sql(A40)}, a6 AS (SELECT subject_id, session, least(ta, tb) AS i, greatest(ta, tb) AS j, 1 AS q, sift2 FROM f_assign UNION ALL SELECT subject_id, session, least(pa, pb), greatest(pa, pb), 0, sift2 FROM f_assign), s6 AS (SELECT subject_id, session, i, j, CAST(sum(q) AS DOUBLE) AS nt, CAST(sum(1 - q) AS DOUBLE) AS np, coalesce(sum(CASE WHEN q = 1 THEN sift2 END), 0) AS st, coalesce(sum(CASE WHEN q = 0 THEN sift2 END), 0) AS sp FROM a6 WHERE i >= 1 AND j <= 40 GROUP BY ALL), l6 AS (SELECT subject_id, session, 'nos' AS ctype, i, j, nt AS t, np AS p FROM s6 UNION ALL SELECT subject_id, session, 'sift2', i, j, st, sp FROM s6)"


@query("a6_edges_diff", f"{_A6} SELECT subject_id, session, ctype, i, j, round(t, 8) + 0.0 AS t, round(p, 8) + 0.0 AS p, round(t - p, 6) + 0.0 AS diff, round(abs(t - p), 6) AS abs_diff, CASE WHEN t = 0 THEN 0.0 ELSE round((t - p) / t, 6) + 0.0 END AS rel_diff FROM l6 WHERE t <> 0 OR p <> 0")
def a6(spark, d):
    out = E.edges_diff(both_table(spark, d, A40, metrics=["nos", "sift2"]))
    return rounded(rounded(out, ["t", "p"], 8), ["diff", "abs_diff", "rel_diff"])


POP_SQL = "f_n AS (SELECT ctype, version, count(DISTINCT subject_id) AS n_subjects FROM f_edges GROUP BY ALL), f_pop AS (SELECT ctype, version, i, j, sum(w) / any_value(n_subjects) AS w, any_value(n_subjects) AS n_subjects FROM f_edges JOIN f_n USING (ctype, version) GROUP BY ctype, version, i, j)"


@query("a7_population_mean", f"{with_edges(A40, ['subject_id'])}, {POP_SQL} SELECT ctype, version, i, j, round(w, 8) + 0.0 AS w, n_subjects FROM f_pop")
def a7(spark, d):
    return rounded(E.population_mean(edge_table(spark, d, A40, ["subject_id"]), ["ctype", "version"]), ["w"], 8)


@query("a8_contributing_subjects", f"{with_edges()} SELECT DISTINCT ctype, version, subject_id FROM f_edges")
def a8(spark, d):
    return E.contributing_subjects(edge_table(spark, d), ["ctype", "version"])


@query("a9_align_nodes", f"{with_edges()} SELECT ctype, i + 1 AS i, j + 1 AS j, count(*) AS n FROM f_edges WHERE i <= 19 AND j <= 19 GROUP BY ALL")
def a9(spark, d):
    return E.align_nodes(edge_table(spark, d).where("i <= 19 and j <= 19"), True).groupBy("ctype", "i", "j").agg(F.count(F.lit(1)).alias("n"))


_M = "CASE WHEN i = j THEN 1 ELSE 2 END"


@query("a10_graph_profile", f"{with_edges(A40)}, s AS (SELECT subject_id, session, version, ctype, sum({_M} * w) AS strength, CAST(sum({_M}) AS BIGINT) AS nonzero, sum({_M} * w * w) AS q, min(w) AS lo, max(w) AS hi FROM f_edges GROUP BY ALL) SELECT subject_id, session, version, ctype, round(strength, 8) AS strength, nonzero, round(strength, 9) / 1600 AS mean, round(sqrt(q / 1600 - (strength / 1600) * (strength / 1600)), 8) AS std, round(CASE WHEN nonzero < 1600 THEN least(lo, 0.0) ELSE lo END, 8) + 0.0 AS least, round(hi, 8) + 0.0 AS largest FROM s")
def a10(spark, d):
    out = E.graph_profile(edge_table(spark, d, A40), [*KEYS, "version", "ctype"], A40)
    # A mean over all cells is a short decimal that may end on a tie: its total is rounded.
    return rounded(out, ["strength", "std", "least", "largest"], 8).withColumn("mean", F.round(F.col("mean") * 1600, 9) / 1600)


@query("a11_validate_graph", f"{with_edges()}, raw AS (SELECT subject_id, session, version, ctype, i, j, CASE WHEN subject_id % 5 = 1 THEN -w ELSE w END AS w FROM f_edges UNION ALL SELECT subject_id, session, version, ctype, j, i, CASE WHEN subject_id % 5 = 1 THEN -w ELSE w END FROM f_edges WHERE i <> j AND subject_id % 5 <> 2), s AS (SELECT subject_id, session, version, ctype, count(*) AS nnz, sum(CASE WHEN i <> j THEN 1 ELSE 0 END) AS off, sum(w) AS s, sum(w * w) AS q, min(w) AS lo, max(w) AS hi FROM raw GROUP BY ALL) SELECT subject_id, session, version, ctype, nnz, round(1 - nnz / 400.0, 6) AS sparsity, round(s, 9) / 400 AS mean, round(sqrt(greatest(q / 400 - (s / 400) * (s / 400), 0)), 8) AS std, round(CASE WHEN nnz >= 400 THEN lo ELSE least(lo, 0) END, 8) + 0.0 AS min, round(CASE WHEN nnz >= 400 THEN hi ELSE greatest(hi, 0) END, 8) + 0.0 AS max, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, subject_id % 5 <> 2 OR off = 0 AS symmetric, CASE WHEN subject_id % 5 = 1 THEN 'negative' ELSE '' END AS issues, subject_id % 5 <> 1 AS valid FROM s")
def a11(spark, d):
    keys = [*KEYS, "version", "ctype"]
    e = edge_table(spark, d).select(*keys, "i", "j", F.when(F.col("subject_id") % 5 == 1, -F.col("w")).otherwise(F.col("w")).alias("w"))
    raw = e.union(e.where("i <> j and subject_id % 5 <> 2").select(*keys, "j", "i", "w"))
    out = E.validate(raw, keys, A20)
    return rounded(rounded(out, ["sparsity"]), ["std", "min", "max"], 8).withColumn("mean", F.round(F.col("mean") * 400, 9) / 400)


@query("a12_total_drift", f"{with_edges()}, s AS (SELECT subject_id, session, ctype, coalesce(sum(CASE WHEN version = 'true' THEN {_M} * w END), 0) AS t, coalesce(sum(CASE WHEN version = 'pred' THEN {_M} * w END), 0) AS p FROM f_edges GROUP BY ALL) SELECT subject_id, session, ctype, round(t, 6) AS t, round(p, 6) AS p, round(abs(t - p) / greatest(t, p) * 100, 6) AS drift, abs(t - p) / greatest(t, p) * 100 > 5 AS warn FROM s")
def a12(spark, d):
    return rounded(E.total_drift(edge_table(spark, d), CMP_KEYS, 5.0), ["t", "p", "drift"])


@query("a13_edges_min_length", f"WITH {assign_sql(A40)}, f_min AS (SELECT * FROM f_assign WHERE length_mm >= 20), {edges_sql(A40, None, 'f_min')} SELECT subject_id, session, version, ctype, i, j, round(w, 8) + 0.0 AS w FROM f_edges")
def a13(spark, d):
    return rounded(E.edges_min_length(assign(spark, d, A40), "length_mm", 20.0, VERSIONS, METRICS, KEYS, A40), ["w"], 8)


@query("slice_min_length_compare", f"WITH {assign_sql()}, f_min AS (SELECT * FROM f_assign WHERE length_mm >= 20), {edges_sql(A20, ['subject_id'], 'f_min')}, {both_sql(['subject_id', 'ctype'])}, s AS (SELECT subject_id, ctype, sum(t) AS sx, sum(p) AS sy, sum(t*t) AS sxx, sum(p*p) AS syy, sum(t*p) AS sxy, sum((t-p)*(t-p)) AS dd FROM f_both GROUP BY ALL) SELECT subject_id, ctype, round((210*sxy - sx*sy) / (sqrt(210*sxx - sx*sx) * sqrt(210*syy - sy*sy)), 6) AS r, round(dd / 210, 6) AS mse FROM s")
def slice_(spark, d):
    """Length filter, true and predicted graphs of all weightings, and their correlation and error for each subject."""
    b = E.edges_both(assign(spark, d).where("length_mm >= 20"), VERSIONS["true"], VERSIONS["pred"], METRICS, ["subject_id"], A20)
    k = ["subject_id", "ctype"]
    out = C.graph_compare(C.for_both(b, k), k, A20, spread=False)
    return rounded(out.select(*k, F.col("pearson_r").alias("r"), "mse"), ["r", "mse"])
