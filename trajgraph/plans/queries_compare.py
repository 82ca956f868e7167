"""Comparison of graphs and similarity across subjects: queries V, C, X with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajgraph.functions.tables import kept
from trajgraph.operators import compare as C
from trajgraph.operators import similarity as S
from trajgraph.plans.fixtures import A20, A40, CMP_KEYS, both_sql, both_table, edge_table, rounded, side, with_edges
from trajgraph.plans.queries_polylines import POP_SQL

QUERIES, SQL = {}, {}
K = ", ".join(CMP_KEYS)
N40, N40_OFF = C.cells(A40), C.cells(A40, False)
_M = "CASE WHEN i = j THEN 1 ELSE 2 END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _both(spark, d, nodes=A40, metrics=None):
    return C.for_both(both_table(spark, d, nodes, metrics=metrics), CMP_KEYS)


BOTH = f"{with_edges(A40)}, {both_sql()}"


def pearson_sql(n: str, sx: str = "sx", sy: str = "sy", sxx: str = "sxx", syy: str = "syy", sxy: str = "sxy") -> str:
    ok = f"{n} > 1 AND {n}*{sxx} - {sx}*{sx} > 1e-12*{n}*{sxx} AND {n}*{syy} - {sy}*{sy} > 1e-12*{n}*{syy}"
    return f"CASE WHEN {ok} THEN ({n}*{sxy} - {sx}*{sy}) / (sqrt({n}*{sxx} - {sx}*{sx}) * sqrt({n}*{syy} - {sy}*{sy})) END"


def sums_sql(m: str = "1") -> str:
    return f"sum({m}*t) AS sx, sum({m}*p) AS sy, sum({m}*t*t) AS sxx, sum({m}*p*p) AS syy, sum({m}*t*p) AS sxy, sum({m}) AS k"


@query("v1_densify", f"{with_edges()}, k AS (SELECT DISTINCT subject_id, session FROM f_edges WHERE version = 'true' AND ctype = 'nos'), g AS (SELECT subject_id, session, a.range AS i, b.range AS j FROM k, range(1, 21) a, range(1, 21) b WHERE a.range < b.range) SELECT g.*, coalesce(w, 0.0) AS w FROM g LEFT JOIN (SELECT * FROM f_edges WHERE version = 'true' AND ctype = 'nos') e USING (subject_id, session, i, j)")
def v1(spark, d):
    e = side(edge_table(spark, d, A20, metrics=["nos"]), "true").drop("ctype")
    return C.densify(e, ["subject_id", "session"], A20, diagonal=False)


@query("v2_zero_mask", f"{BOTH} SELECT {K}, count(*) FILTER (ctype NOT IN ('fa', 'md', 'ad', 'rd') OR (t <> 0 AND p <> 0)) AS kept, CAST(CASE WHEN ctype IN ('fa', 'md', 'ad', 'rd') THEN 1600 - sum(CASE WHEN t <> 0 AND p <> 0 THEN {_M} ELSE 0 END) ELSE 0 END AS BIGINT) AS n_masked FROM f_both GROUP BY {K}")
def v2(spark, d):
    b = _both(spark, d)
    kept = C.zero_mask(b).groupBy(*CMP_KEYS).agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(C.masked_count(b, CMP_KEYS, A40), CMP_KEYS).withColumn("n_masked", F.col("n_masked").cast("long"))


@query("v3_nonzero_either", f"{BOTH} SELECT {K}, count(*) AS n FROM f_both WHERE t <> 0 OR p <> 0 GROUP BY {K}")
def v3(spark, d):
    return C.nonzero_either(_both(spark, d)).groupBy(*CMP_KEYS).agg(F.count(F.lit(1)).alias("n"))


def _agg(name, make, cols, expr, where="", m="1", digits=6):
    """A query that is one aggregation of f_both."""
    inner = f"{BOTH}, s AS (SELECT {K}, {expr} FROM f_both {where} GROUP BY {K})"
    SQL[name] = f"{inner} SELECT {K}, {', '.join(f'round({v}, {digits}) + 0.0 AS {c}' for c, v in cols.items())} FROM s"
    QUERIES[name] = lambda spark, d: rounded(make(_both(spark, d)), list(cols), digits)


_agg("c1_pearson_dense", lambda b: C.pearson_dense(b, CMP_KEYS, A40), {"r": pearson_sql(str(N40))}, sums_sql())
_agg("c2_pearson_nonzero", lambda b: C.pearson_nonzero(b, CMP_KEYS), {"r": pearson_sql("k")}, sums_sql(), "WHERE t <> 0 AND p <> 0")
_Z = f"(sxy/{N40} - sx/{N40}*sy/{N40}) / ((sqrt(greatest(sxx/{N40} - sx/{N40}*sx/{N40}, 0)) + 1e-10) * (sqrt(greatest(syy/{N40} - sy/{N40}*sy/{N40}, 0)) + 1e-10))"
_agg("c3_pearson_z", lambda b: C.pearson_z(b, CMP_KEYS, A40), {"r": _Z}, sums_sql())
_agg("c4_pearson_full", lambda b: C.pearson_full(b, CMP_KEYS, A40), {"r": pearson_sql("1600")}, sums_sql(f"({_M})"))
_agg("c7_errors", lambda b: C.errors(b, CMP_KEYS, A40), {"mse": f"dd/{N40}", "rmse": f"sqrt(dd/{N40})", "mae": f"ad/{N40}"}, "sum((t-p)*(t-p)) AS dd, sum(abs(t-p)) AS ad", digits=7)
_agg("c8_errors_off_diagonal", lambda b: C.errors_off_diagonal(b, CMP_KEYS, A40), {"rmse": "sqrt(2*dd/1560)", "mae": "2*ad/1560"}, "sum(CASE WHEN i <> j THEN (t-p)*(t-p) ELSE 0 END) AS dd, sum(CASE WHEN i <> j THEN abs(t-p) ELSE 0 END) AS ad", digits=7)
_agg("c9_errors_legacy", lambda b: C.errors_legacy(b, CMP_KEYS, A40), {"mse": "dd/1600", "abs_err_sum": "ad", "mape": "CASE WHEN st > 0 THEN ad/st ELSE 0 END"}, f"sum(({_M})*(t-p)*(t-p)) AS dd, sum(({_M})*abs(t-p)) AS ad, sum(({_M})*t) AS st", digits=10)
_agg("c10_mean_relative_error", lambda b: C.mean_relative_error(b, CMP_KEYS, A40), {"mean_relative_error": f"x/{N40}"}, "sum(abs(t-p)/(abs(t)+abs(p)+1e-10)) AS x")
_agg("c11_norms", lambda b: C.norms(b, CMP_KEYS), {"frobenius": "sqrt(dd)", "max_abs_error": "mx"}, f"sum(({_M})*(t-p)*(t-p)) AS dd, max(abs(t-p)) AS mx", digits=7)
_agg("c13_overlap", lambda b: C.overlap(b, CMP_KEYS), {"edge_overlap": "kb/greatest(nt, 1)", "jaccard": "kb/greatest(ne, 1)"}, "count(*) FILTER (t > 0 AND p > 0) AS kb, count(*) FILTER (t > 0) AS nt, count(*) FILTER (t > 0 OR p > 0) AS ne")
_agg("c14_strength_ratio", lambda b: C.strength_ratio(b, CMP_KEYS), {"strength_ratio": "mp/greatest(mt, 1e-10)"}, f"sum(({_M})*p) AS mp, sum(({_M})*t) AS mt")
_agg("c15_rel_diff_mean", lambda b: C.rel_diff_mean(b, CMP_KEYS, A40), {"rel_diff_mean": f"x/{N40}"}, "sum(CASE WHEN t + p = 0 THEN 0 ELSE 2*abs(t-p)/(t+p) END) AS x")
_agg("c16_log_diff_mean", lambda b: C.log_diff_mean(b, CMP_KEYS, A40), {"log_diff_mean": f"x/{N40_OFF}"}, "sum(CASE WHEN i <> j THEN abs(ln(p+1e-10) - ln(t+1e-10)) ELSE 0 END) AS x")

_DENSE = f"k0 AS (SELECT DISTINCT {K} FROM f_both), grid AS (SELECT {K}, a.range AS i, b.range AS j FROM k0, range(1, 41) a, range(1, 41) b WHERE a.range <= b.range), dense AS (SELECT {K}, i, j, coalesce(t, 0.0) AS t, coalesce(p, 0.0) AS p FROM grid LEFT JOIN f_both USING ({K}, i, j))"


_FEW = BOTH.replace("WHERE w IS NOT NULL AND w <> 0", "WHERE w IS NOT NULL AND w <> 0 AND ctype IN ('nos', 'fa')").replace("avg(fa) AS fa", "round(avg(fa), 12) AS fa")


#: Weights at twelve places: means of equal values may differ in their last bits, which ranks would tell apart.
_ROUND12 = f"{with_edges(A40)}, {both_sql().replace('coalesce(a.w, 0) AS t', 'round(coalesce(a.w, 0), 12) AS t').replace('coalesce(b.w, 0) AS p', 'round(coalesce(b.w, 0), 12) AS p')}"


@query("c5_spearman", f"{_ROUND12}, {_DENSE}, rk AS (SELECT {K}, rank() OVER (PARTITION BY {K} ORDER BY t) + (count(*) OVER (PARTITION BY {K}, t) - 1) / 2.0 AS t, rank() OVER (PARTITION BY {K} ORDER BY p) + (count(*) OVER (PARTITION BY {K}, p) - 1) / 2.0 AS p FROM dense), s AS (SELECT {K}, {sums_sql()} FROM rk GROUP BY {K}) SELECT {K}, round({pearson_sql('k')}, 6) + 0.0 AS r FROM s")
def c5(spark, d):
    # Means of equal values may differ in the last bit: they are ranked at 12 places.
    b = _both(spark, d).withColumns({c: F.round(c, 12) for c in "tp"})
    return rounded(C.spearman(b, CMP_KEYS, A40), ["r"])


@query("c6_corr_pvalue")
def c6(spark, d):
    b = _both(spark, d)
    n = b.groupBy(*CMP_KEYS).agg(F.sum(((F.col("t") != 0) & (F.col("p") != 0)).cast("int")).alias("n"))
    return C.pearson_nonzero(b, CMP_KEYS).join(n, CMP_KEYS).withColumn("p", C.corr_pvalue(F.col("r"), F.col("n")))


@query("c12_wasserstein", f"{BOTH}, {_DENSE}, a AS (SELECT {K}, t, row_number() OVER (PARTITION BY {K} ORDER BY t) AS q FROM dense), b AS (SELECT {K}, p, row_number() OVER (PARTITION BY {K} ORDER BY p) AS q FROM dense) SELECT {K}, round(avg(abs(t - p)), 6) + 0.0 AS wasserstein FROM a JOIN b USING ({K}, q) GROUP BY {K}")
def c12(spark, d):
    return rounded(C.wasserstein(_both(spark, d), CMP_KEYS, A40), ["wasserstein"])


@query("c17_lerm")
def c17(spark, d):
    return C.lerm(_both(spark, d), CMP_KEYS, A40)


@query("c17_lerm_complex")
def c17_complex(spark, d):
    return C.lerm(_both(spark, d), CMP_KEYS, A40, "complex")


@query("c17_lerm_gated")
def c17_gated(spark, d):
    return C.lerm(_both(spark, d), CMP_KEYS, A40, "gated")


_C18 = {
    "pearson_r": pearson_sql(str(N40)), "mse": f"dd/{N40}", "rmse": f"sqrt(dd/{N40})", "mae": f"ad/{N40}", "mean_relative_error": f"re/{N40}", "frobenius": "sqrt(mdd)", "max_abs_error": "mx", "mape": "CASE WHEN mt > 0 THEN mad/mt ELSE 0 END",
    "edge_overlap": "kb/greatest(n_true, 1)", "jaccard": "kb/greatest(ke, 1)", "true_strength": "mt", "pred_strength": "mp", "strength_ratio": "mp/greatest(mt, 1e-10)", "rel_diff_mean": f"rd/{N40}", "log_diff_mean": f"ld/{N40_OFF}",
}
_C18_SUMS = f"{sums_sql()}, sum((t-p)*(t-p)) AS dd, sum(abs(t-p)) AS ad, sum(abs(t-p)/(abs(t)+abs(p)+1e-10)) AS re, sum(({_M})*(t-p)*(t-p)) AS mdd, sum(({_M})*abs(t-p)) AS mad, max(abs(t-p)) AS mx, count(*) FILTER (t > 0 AND p > 0) AS kb, count(*) FILTER (t > 0) AS n_true, count(*) FILTER (p > 0) AS n_pred, count(*) FILTER (t > 0 OR p > 0) AS ke, sum(({_M})*t) AS mt, sum(({_M})*p) AS mp, sum(CASE WHEN t + p = 0 THEN 0 ELSE 2*abs(t-p)/(t+p) END) AS rd, sum(CASE WHEN i <> j THEN abs(ln(p+1e-10) - ln(t+1e-10)) ELSE 0 END) AS ld"


# Means over all cells are short decimals that may end on a tie: their totals are rounded, not they.
_C18_COLS = ", ".join(f"round({v}, 9) + 0.0 AS {c}" for c, v in _C18.items()) + ", round(mt, 9) / 1600 AS true_mean, round(mp, 9) / 1600 AS pred_mean"


def _c18(out):
    means, other = ("true_mean", "pred_mean"), (*CMP_KEYS, "n_true", "n_pred", "n_masked")
    return rounded(out, [c for c in out.columns if c not in (*other, *means)], 9).withColumns({c: F.round(F.col(c) * 1600, 9) / 1600 for c in means})


@query("c18_graph_compare", f"{BOTH}, s AS (SELECT {K}, {_C18_SUMS} FROM f_both GROUP BY {K}) SELECT {K}, {_C18_COLS}, n_true, n_pred FROM s")
def c18(spark, d):
    return _c18(C.graph_compare(_both(spark, d), CMP_KEYS, A40, spread=False))


_W12 = f"a12 AS (SELECT {K}, t, row_number() OVER (PARTITION BY {K} ORDER BY t) AS q FROM dense), b12 AS (SELECT {K}, p, row_number() OVER (PARTITION BY {K} ORDER BY p) AS q FROM dense), ws AS (SELECT {K}, avg(abs(t - p)) AS wasserstein FROM a12 JOIN b12 USING ({K}, q) GROUP BY {K})"
_RK = f"rk AS (SELECT {K}, rank() OVER (PARTITION BY {K} ORDER BY t) + (count(*) OVER (PARTITION BY {K}, t) - 1) / 2.0 AS t, rank() OVER (PARTITION BY {K} ORDER BY p) + (count(*) OVER (PARTITION BY {K}, p) - 1) / 2.0 AS p FROM dense), rs AS (SELECT {K}, {sums_sql()} FROM rk GROUP BY {K}), sp AS (SELECT {K}, {pearson_sql('k')} AS spearman_r FROM rs)"


@query("c18_graph_compare_masked", f"{_FEW.replace('f_both AS (', 'f_all AS (')}, f_both AS (SELECT * FROM f_all WHERE ctype = 'nos' OR (t <> 0 AND p <> 0)), nm AS (SELECT {K}, CAST(CASE WHEN ctype = 'nos' THEN 0 ELSE 1600 - sum(CASE WHEN t <> 0 AND p <> 0 THEN {_M} ELSE 0 END) END AS BIGINT) AS n_masked FROM f_all GROUP BY {K}), {_DENSE}, {_W12}, {_RK}, s AS (SELECT {K}, {_C18_SUMS} FROM f_both GROUP BY {K}) SELECT {K}, {_C18_COLS}, n_true, n_pred, n_masked, round(spearman_r, 9) + 0.0 AS spearman_r, round(wasserstein, 9) + 0.0 AS wasserstein FROM s JOIN nm USING ({K}) JOIN ws USING ({K}) JOIN sp USING ({K})")
def c18_masked(spark, d):
    """All comparisons that SQL can say, fa by the cells that both sides have."""
    b = _both(spark, d, metrics=["nos", "fa"]).withColumns({c: F.round(c, 12) for c in "tp"})
    return _c18(C.graph_compare(b, CMP_KEYS, A40, mask="ctype").withColumn("n_masked", F.col("n_masked").cast("long")))


@query("c18_graph_compare_full")
def c18_full(spark, d):
    """With p-values and the log-Euclidean distances, which SQL can't say."""
    return C.graph_compare(_both(spark, d), CMP_KEYS, A40, p_values=True, logs=True)


@query("c19_error_histogram", f"{BOTH}, x AS (SELECT {K}, round(abs(t - p), 10) AS x FROM f_both WHERE i <> j), y AS (SELECT *, min(x) OVER (PARTITION BY {K}) AS lo, max(x) OVER (PARTITION BY {K}) AS hi FROM x) SELECT {K}, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 50 + 1e-6), 49) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM y GROUP BY ALL")
def c19(spark, d):
    return C.error_histogram(_both(spark, d), CMP_KEYS, 50, 10)


_agg("c19_bland_altman", lambda b: C.bland_altman(b, CMP_KEYS, A40), {"bias": f"sd/{N40_OFF}", "lower": f"sd/{N40_OFF} - 1.96*sqrt(greatest(q/{N40_OFF} - sd/{N40_OFF}*sd/{N40_OFF}, 0))", "upper": f"sd/{N40_OFF} + 1.96*sqrt(greatest(q/{N40_OFF} - sd/{N40_OFF}*sd/{N40_OFF}, 0))"}, "sum(CASE WHEN i <> j THEN p - t ELSE 0 END) AS sd, sum(CASE WHEN i <> j THEN (p-t)*(p-t) ELSE 0 END) AS q", digits=7)


@query("c20_clip_range", f"{with_edges(A40)}, x AS (SELECT {K}, version, CASE WHEN subject_id % 4 = 0 AND i = 3 THEN -w ELSE w END AS w FROM f_edges) SELECT {K}, version, CASE WHEN min(w) < 0 THEN -round(quantile_cont(abs(w), 0.99), 7) ELSE 0.0 END AS lo, round(quantile_cont(abs(w), 0.99), 7) AS hi FROM x GROUP BY ALL")
def c20(spark, d):
    e = edge_table(spark, d, A40).withColumn("w", F.when((F.col("subject_id") % 4 == 0) & (F.col("i") == 3), -F.col("w")).otherwise(F.col("w")))
    return rounded(C.clip_range(e, [*CMP_KEYS, "version"]), ["lo", "hi"], 7)


GROUP, SUBJ = ["ctype"], ["subject_id", "ctype"]
EDGES1 = f"{with_edges(A40, ['subject_id'])}, {POP_SQL}"
_K1 = ["ctype", "subject_id"]


def _one(spark, d):
    return both_table(spark, d, A40, ["subject_id"])


def _versions(b):
    """(ctype, subject_id, version, i, j, w) of both sides."""
    each = F.explode(F.array(F.struct(F.lit("true").alias("version"), F.col("t").alias("w")), F.struct(F.lit("pred").alias("version"), F.col("p").alias("w"))))
    return b.select(*_K1, "i", "j", each.alias("x")).select(*_K1, "x.version", "i", "j", "x.w").where("w <> 0")


def _logs(b, imaginary=False):
    """The matrix logarithm of each graph, once: several distances read them."""
    return kept(C.log_vectors(_versions(b), [*_K1, "version"], A40, imaginary=imaginary))


_MOM = f"mo AS (SELECT ctype, version, subject_id, sum(w)/{N40} AS m, sqrt(greatest(sum(w*w)/{N40} - (sum(w)/{N40})*(sum(w)/{N40}), 0)) + 1e-10 AS sd FROM f_edges GROUP BY ALL)"
_PROD = "xy AS (SELECT a.ctype, a.subject_id AS a, b.subject_id AS b, sum(a.w*b.w) AS xy FROM f_edges a JOIN f_edges b ON a.ctype = b.ctype AND a.i = b.i AND a.j = b.j AND a.version = 'pred' AND b.version = 'true' GROUP BY ALL)"
_SIM = f"{_MOM}, {_PROD}, sim AS (SELECT p.ctype, p.subject_id AS a, t.subject_id AS b, (coalesce(xy, 0)/{N40} - p.m*t.m)/(p.sd*t.sd) AS r FROM mo p JOIN mo t ON p.ctype = t.ctype AND p.version = 'pred' AND t.version = 'true' LEFT JOIN xy ON xy.ctype = p.ctype AND xy.a = p.subject_id AND xy.b = t.subject_id)"


@query("x1_intra_similarity", f"{EDGES1}, {_SIM} SELECT ctype, a AS subject_id, round(r, 6) AS value FROM sim WHERE a = b")
def x1(spark, d):
    return rounded(S.intra_similarity(C.for_both(_one(spark, d), _K1), GROUP, "subject_id", A40), ["value"])


@query("x2_inter_similarity", f"{EDGES1}, {_SIM} SELECT ctype, a AS subject_id, round(avg(r), 6) AS value FROM sim WHERE a <> b GROUP BY ALL")
def x2(spark, d):
    return rounded(S.inter_of_both(kept(_one(spark, d)), GROUP, "subject_id", A40), ["value"])


_POPR = f"pm AS (SELECT ctype, sum(w)/{N40} AS m, sqrt(sum(w*w)/{N40} - (sum(w)/{N40})*(sum(w)/{N40})) + 1e-10 AS sd FROM f_pop WHERE version = 'true' GROUP BY ctype), px AS (SELECT e.ctype, e.subject_id, sum(e.w*q.w) AS xy FROM f_edges e JOIN f_pop q ON q.version = 'true' AND e.version = 'pred' AND e.ctype = q.ctype AND e.i = q.i AND e.j = q.j GROUP BY ALL), gr AS (SELECT mo.ctype, mo.subject_id, (xy/{N40} - mo.m*pm.m)/(mo.sd*pm.sd) AS value FROM mo JOIN pm ON mo.ctype = pm.ctype AND mo.version = 'pred' JOIN px ON px.ctype = mo.ctype AND px.subject_id = mo.subject_id)"


@query("x3_group_similarity", f"{EDGES1}, {_MOM}, {_POPR} SELECT ctype, subject_id, round(value, 6) AS value FROM gr")
def x3(spark, d):
    return rounded(S.group_similarity(kept(_one(spark, d)), GROUP, "subject_id", A40), ["value"])


def similarity_long(spark, d):
    # Three comparisons read the same graphs: they are built and written once.
    return _table(kept(_one(spark, d)))


def _table(b):
    return S.similarity_table(S.intra_similarity(C.for_both(b, _K1), GROUP, "subject_id", A40), S.inter_of_both(b, GROUP, "subject_id", A40), S.group_similarity(b, GROUP, "subject_id", A40))


SIM_LONG = f"{EDGES1}, {_SIM}, {_POPR}, sl AS (SELECT ctype, a AS subject_id, r AS value, 'Intrasubject' AS comparison_type FROM sim WHERE a = b UNION ALL SELECT ctype, a, avg(r), 'Intersubject' FROM sim WHERE a <> b GROUP BY ctype, a UNION ALL SELECT ctype, subject_id, value, 'Group-average' FROM gr)"


@query("x4_similarity_table", f"{SIM_LONG} SELECT ctype, subject_id, comparison_type, round(value, 6) AS value FROM sl")
def x4(spark, d):
    return rounded(similarity_long(spark, d), ["value"])


@query("x1_intra_lerm")
def x1_lerm(spark, d):
    return S.intra_lerm(_logs(_one(spark, d)), GROUP, "subject_id")


@query("x2_inter_lerm")
def x2_lerm(spark, d):
    b = kept(_one(spark, d))
    return S.inter_lerm(_logs(b), GROUP, "subject_id", b)


@query("x3_group_lerm")
def x3_lerm(spark, d):
    b = kept(_one(spark, d))
    return S.group_lerm(_logs(b), S.population_logs(b, GROUP, "subject_id", A40), GROUP, "subject_id")


@query("x4_similarity_table_lerm")
def x4_lerm(spark, d):
    """The similarity table with both columns, pearson_r and lerm_dist."""
    b = kept(_one(spark, d))
    r, logs = _table(b), _logs(b)
    dist = S.similarity_table(S.intra_lerm(logs, GROUP, "subject_id"), S.inter_lerm(logs, GROUP, "subject_id").drop("left_out"), S.group_lerm(logs, S.population_logs(b, GROUP, "subject_id", A40), GROUP, "subject_id"))
    on = [*_K1, "comparison_type"]
    return r.withColumnRenamed("value", "pearson_r").join(dist.withColumnRenamed("value", "lerm_dist"), on, "left")


_TRT = f"{with_edges(A40)}, a AS (SELECT * FROM f_edges WHERE session = 'test'), b AS (SELECT * FROM f_edges WHERE session = 'retest'), f AS (SELECT coalesce(a.ctype, b.ctype) AS ctype, coalesce(a.version, b.version) AS version, coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.w, 0) AS t, coalesce(b.w, 0) AS p FROM a FULL JOIN b ON a.ctype = b.ctype AND a.version = b.version AND a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j), ts AS (SELECT ctype, version, subject_id, {sums_sql()} FROM f GROUP BY ctype, version, subject_id), trt AS (SELECT ctype, version, subject_id, {_Z} AS r FROM ts)"


@query("x5_trt_similarity", f"{_TRT} SELECT ctype, version, subject_id, round(r, 6) AS r FROM trt")
def x5(spark, d):
    return rounded(S.trt_similarity(edge_table(spark, d, A40), ["ctype", "version", "subject_id"], A40), ["r"])


_WITHIN = f"wm AS (SELECT ctype, version, session, subject_id, sum(w)/{N40} AS m, sqrt(greatest(sum(w*w)/{N40} - (sum(w)/{N40})*(sum(w)/{N40}), 0)) + 1e-10 AS sd FROM f_edges GROUP BY ALL), wx AS (SELECT a.ctype, a.version, a.session, a.subject_id AS a, b.subject_id AS b, sum(a.w*b.w) AS xy FROM f_edges a JOIN f_edges b ON a.ctype = b.ctype AND a.version = b.version AND a.session = b.session AND a.i = b.i AND a.j = b.j AND a.subject_id < b.subject_id GROUP BY ALL), ws AS (SELECT p.ctype, p.version, p.session, (coalesce(xy, 0)/{N40} - p.m*t.m)/(p.sd*t.sd) AS r FROM wm p JOIN wm t ON p.ctype = t.ctype AND p.version = t.version AND p.session = t.session AND p.subject_id < t.subject_id LEFT JOIN wx ON wx.ctype = p.ctype AND wx.version = p.version AND wx.session = p.session AND wx.a = p.subject_id AND wx.b = t.subject_id), wi AS (SELECT ctype, version, session, avg(r) AS mean_r, stddev_pop(r) AS std_r, count(r) AS n_pairs FROM ws GROUP BY ALL)"


@query("x6_intersubject_within_session", f"{_TRT}, {_WITHIN} SELECT ctype, version, session, round(mean_r, 6) AS mean_r, round(std_r, 6) AS std_r, n_pairs FROM wi")
def x6(spark, d):
    return rounded(S.intersubject_within(edge_table(spark, d, A40), ["ctype", "version", "session"], "subject_id", A40), ["mean_r", "std_r"])


@query("x7_trt_vs_intersubject", f"{_TRT}, {_WITHIN} SELECT ctype, version, round(trt_mean, 6) AS trt_mean, n_subjects, round(inter_mean, 6) AS inter_mean FROM (SELECT ctype, version, avg(r) AS trt_mean, count(r) AS n_subjects FROM trt GROUP BY ALL) JOIN (SELECT ctype, version, avg(mean_r) AS inter_mean FROM wi GROUP BY ALL) USING (ctype, version)")
def x7(spark, d):
    e = kept(edge_table(spark, d, A40))
    trt = S.trt_similarity(e, ["ctype", "version", "subject_id"], A40)
    return rounded(S.trt_vs_intersubject(trt, S.intersubject_within(e, ["ctype", "version", "session"], "subject_id", A40), ["ctype", "version"]), ["trt_mean", "inter_mean"])


def _session_logs(spark, d):
    return kept(C.log_vectors(edge_table(spark, d, A40), ["ctype", "version", "session", "subject_id"], A40))


@query("x5_trt_lerm")
def x5_lerm(spark, d):
    return S.intra_lerm(_session_logs(spark, d), ["ctype", "version"], "subject_id", ("test", "retest"), "session")


@query("x6_intersubject_lerm")
def x6_lerm(spark, d):
    return S.intersubject_lerm(_session_logs(spark, d), ["ctype", "version", "session"], "subject_id")


@query("x7_trt_vs_intersubject_lerm")
def x7_lerm(spark, d):
    logs = _session_logs(spark, d)
    trt = S.intra_lerm(logs, ["ctype", "version"], "subject_id", ("test", "retest"), "session").withColumnRenamed("value", "r")
    inter = S.intersubject_lerm(logs, ["ctype", "version", "session"], "subject_id").withColumnRenamed("mean_lerm", "mean_r")
    return S.trt_vs_intersubject(trt, inter, ["ctype", "version"])


def _x8_part(a: str, b: str, name: str) -> str:
    src = {"pred": "(SELECT ctype, subject_id, i, j, w FROM f_edges WHERE version = 'pred')", "true": "(SELECT ctype, subject_id, i, j, w FROM f_edges WHERE version = 'true')", "pop": "(SELECT f_pop.ctype, s.subject_id, i, j, w FROM f_pop JOIN (SELECT DISTINCT ctype, subject_id FROM f_edges WHERE version = 'pred') s ON s.ctype = f_pop.ctype WHERE version = 'true')"}
    on = "a.ctype = b.ctype AND a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j"
    f = f"SELECT coalesce(a.ctype, b.ctype) AS ctype, coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.w, 0) AS t, coalesce(b.w, 0) AS p FROM {src[a]} a FULL JOIN {src[b]} b ON {on}"
    nz = "CASE WHEN t <> 0 AND p <> 0 THEN 1 ELSE 0 END"
    return f"SELECT ctype, subject_id, '{name}' AS comparison, {sums_sql(f'({nz})')}, sqrt(sum(CASE WHEN i <> j THEN 2*(t-p)*(t-p) ELSE 0 END)/1560) AS rmse, sum(CASE WHEN i <> j THEN 2*abs(t-p) ELSE 0 END)/1560 AS mae, count(*) FILTER (t <> 0) AS n_a, count(*) FILTER (p <> 0) AS n_b FROM ({f}) GROUP BY ctype, subject_id"


_X8 = f"{EDGES1}, x8 AS ({_x8_part('pred', 'pop', 'pred-pop')} UNION ALL {_x8_part('true', 'pop', 'true-pop')} UNION ALL {_x8_part('pred', 'true', 'pred-true')}), x8r AS (SELECT ctype, subject_id, comparison, {pearson_sql('k')} AS r, rmse, mae, n_a, n_b FROM x8)"


def population_table(spark, d):
    return S.test_vs_population(kept(_one(spark, d)), GROUP, "subject_id", A40)


@query("x8_test_vs_population_lerm")
def x8_lerm(spark, d):
    b = kept(_one(spark, d))
    return S.test_vs_population_lerm(_logs(b, True), S.population_logs(b, GROUP, "subject_id", A40, True), GROUP, "subject_id")


@query("x8_test_vs_population", f"{_X8} SELECT ctype, subject_id, comparison, round(r, 6) + 0.0 AS r, round(rmse, 9) AS rmse, round(mae, 9) AS mae, n_a, n_b FROM x8r")
def x8(spark, d):
    return rounded(rounded(population_table(spark, d), ["r"]), ["rmse", "mae"], 9)


@query("x9_three_way_long", f"{_X8}, u AS (SELECT ctype, subject_id, comparison, 'r' AS metric, r AS value FROM x8r UNION ALL SELECT ctype, subject_id, comparison, 'rmse', rmse FROM x8r UNION ALL SELECT ctype, subject_id, comparison, 'mae', mae FROM x8r) SELECT ctype, subject_id, comparison, metric, round(value, 8) + 0.0 AS value FROM u WHERE value IS NOT NULL")
def x9(spark, d):
    return rounded(S.three_way_long(population_table(spark, d), _K1), ["value"], 8)
