"""Graph metrics, classification metrics and statistics: queries G, M, R with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajgraph.functions import labels as L
from trajgraph.functions.tables import kept
from trajgraph.operators import classify as K
from trajgraph.operators import compare as C
from trajgraph.operators import graph as G
from trajgraph.operators import similarity as X
from trajgraph.operators import stats as R
from trajgraph.plans.fixtures import A20, A40, CLASS_SQL, CMP_KEYS, GRAPH_KEYS, GRAPHS_SQL, assign, assign_sql, both_table, classes, edge_table, graphs, rounded, with_edges
from trajgraph.plans.queries_compare import SIM_LONG, pearson_sql, similarity_long, sums_sql

QUERIES, SQL = {}, {}
S = GRAPH_KEYS
GR = f"WITH {GRAPHS_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The keys of a graph in SQL, and their equality.
_GK = "subject_id, session, version"


def _on(a: str, b: str, extra: str = "") -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in (_GK + extra).split(", "))


def _pre(a: str, extra: str = "") -> str:
    return ", ".join(f"{a}.{k}" for k in (_GK + extra).split(", "))


@query("g1_size_and_density", f"{GR} SELECT {_GK}, 20 AS num_nodes, count(*) AS num_edges, round(2*count(*)/380.0, 6) AS density FROM f_graph GROUP BY ALL")
def g1(spark, d):
    return rounded(G.size_and_density(graphs(spark, d), S, A20), ["density"])


#: cc: the smallest node of each node's component, by doubling reachability five times.
_REACH = f"r0 AS MATERIALIZED (SELECT DISTINCT {_GK}, s, t FROM f_arcs UNION SELECT {_GK}, s, s FROM f_arcs), " + ", ".join(f"r{k} AS MATERIALIZED (SELECT DISTINCT {_pre('a')}, a.s, b.t FROM r{k - 1} a JOIN r{k - 1} b ON {_on('a', 'b')} AND a.t = b.s)" for k in range(1, 6)) + f", cc AS MATERIALIZED (SELECT {_GK}, s AS node, min(t) AS label FROM r5 GROUP BY ALL)"
_BIG = f"big AS (SELECT {_GK}, label FROM (SELECT {_GK}, label, count(*) AS k FROM cc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_GK} ORDER BY k DESC, label) = 1), g_big AS (SELECT f_arcs.* FROM f_arcs JOIN cc ON {_on('cc', 'f_arcs')} AND cc.node = f_arcs.s JOIN big ON {_on('big', 'cc')} AND big.label = cc.label)"


def _dist(source: str, extra: str = "", rounds: int = 5) -> str:
    keys = _GK + extra
    return f"d0 AS MATERIALIZED (SELECT {keys}, s, t, min(w) AS d FROM {source} WHERE s <> t GROUP BY ALL), " + ", ".join(f"d{n} AS MATERIALIZED (SELECT {keys}, s, t, min(d) AS d FROM (SELECT {_pre('a', extra)}, a.s, b.t, a.d + b.d AS d FROM d{n - 1} a JOIN d{n - 1} b ON {_on('a', 'b', extra)} AND a.t = b.s AND a.s <> b.t UNION ALL SELECT * FROM d{n - 1}) GROUP BY ALL)" for n in range(1, rounds + 1))


@query("g2_connected_components", f"{GR}, {_REACH}, z AS (SELECT {_GK}, label, count(*) AS k FROM cc GROUP BY ALL) SELECT {_GK}, CAST(count(*) + 20 - sum(k) AS BIGINT) AS n_components, max(k) AS largest FROM z GROUP BY ALL")
def g2(spark, d):
    return G.components(graphs(spark, d), S, A20)


_CLUST = f"mx AS (SELECT {_GK}, max(w) AS top FROM f_graph GROUP BY ALL), e AS (SELECT {_GK}, i, j, w/top AS w FROM f_graph JOIN mx USING ({_GK}) WHERE i <> j), tri AS MATERIALIZED (SELECT {_pre('ab')}, ab.i AS a, ab.j AS b, ac.j AS c, cbrt(ab.w*ac.w*bc.w) AS g FROM e ab JOIN e ac ON {_on('ab', 'ac')} AND ab.i = ac.i AND ab.j < ac.j JOIN e bc ON {_on('bc', 'ab')} AND bc.i = ab.j AND bc.j = ac.j), pn AS (SELECT {_GK}, node, sum(g) AS g FROM (SELECT {_GK}, a AS node, g FROM tri UNION ALL SELECT {_GK}, b, g FROM tri UNION ALL SELECT {_GK}, c, g FROM tri) GROUP BY ALL), dg AS (SELECT {_GK}, s AS node, count(*) AS d FROM f_arcs WHERE s <> t GROUP BY ALL), cl AS (SELECT {_GK}, sum(2*g/(d*(d-1)))/20 AS c FROM pn JOIN dg USING ({_GK}, node) GROUP BY ALL)"


@query("g3_average_clustering", f"{GR}, {_CLUST} SELECT {_pre('mx')}, round(coalesce(c, 0), 6) AS average_clustering FROM mx LEFT JOIN cl USING ({_GK})")
def g3(spark, d):
    return rounded(G.average_clustering(graphs(spark, d), S, A20), ["average_clustering"])


@query("g4_reciprocal_weights", f"{GR} SELECT {_GK}, i, j, round(1/w, 8) AS w FROM f_graph")
def g4(spark, d):
    return rounded(G.reciprocal(graphs(spark, d)), ["w"], 8)


@query("g5_average_path_length", f"{GR}, {_REACH}, {_BIG}, inv AS (SELECT {_GK}, s, t, 1/w AS w FROM g_big), {_dist('inv')}, pl AS (SELECT {_GK}, round(avg(d), 6) AS average_path_length FROM d5 GROUP BY ALL) SELECT {_pre('u')}, average_path_length FROM (SELECT DISTINCT {_GK} FROM f_graph) u LEFT JOIN pl USING ({_GK})")
def g5(spark, d):
    return rounded(G.average_path_length(graphs(spark, d), S, A20), ["average_path_length"])


@query("g6_global_efficiency", f"{GR}, one AS (SELECT {_GK}, s, t, 1.0::DOUBLE AS w FROM f_arcs), {_dist('one')}, ge AS (SELECT {_GK}, sum(1/d)/380 AS g FROM d5 GROUP BY ALL) SELECT {_pre('u')}, round(coalesce(g, 0), 6) AS global_efficiency FROM (SELECT DISTINCT {_GK} FROM f_graph) u LEFT JOIN ge USING ({_GK})")
def g6(spark, d):
    return rounded(G.global_efficiency(graphs(spark, d), S, A20), ["global_efficiency"])


@query("g7_local_efficiency", f"{GR}, nb AS (SELECT {_GK}, s AS ego, t AS node FROM f_arcs), one AS (SELECT {_pre('f')}, a.ego, f.s, f.t, CAST(1 AS DOUBLE) AS w FROM f_arcs f JOIN nb a ON {_on('a', 'f')} AND a.node = f.s JOIN nb b ON {_on('b', 'f')} AND b.ego = a.ego AND b.node = f.t), {_dist('one', ', ego', 4)}, sz AS (SELECT {_GK}, ego, count(*) AS k FROM nb GROUP BY ALL), pe AS (SELECT {_GK}, ego, sum(1/d) AS s FROM d4 GROUP BY ALL), g AS (SELECT {_GK}, sum(s/(k*(k-1)))/20 AS g FROM pe JOIN sz USING ({_GK}, ego) GROUP BY ALL) SELECT {_pre('u')}, round(coalesce(g, 0), 6) AS local_efficiency FROM (SELECT DISTINCT {_GK} FROM f_graph) u LEFT JOIN g USING ({_GK})")
def g7(spark, d):
    return rounded(G.local_efficiency(graphs(spark, d), S, A20), ["local_efficiency"])


_STR = f"st AS (SELECT {_GK}, s AS node, sum(CASE WHEN s = t THEN 2*w ELSE w END) AS strength, sum(CASE WHEN s = t THEN 2 ELSE 1 END) AS degree FROM f_arcs GROUP BY ALL)"
_ASSORT = f"fa AS (SELECT {_pre('f_arcs')}, a.strength AS t, b.strength AS p FROM f_arcs JOIN st a ON {_on('a', 'f_arcs')} AND a.node = f_arcs.s JOIN st b ON {_on('b', 'f_arcs')} AND b.node = f_arcs.t), za AS (SELECT {_GK}, {sums_sql()} FROM fa GROUP BY ALL)"


@query("g8_degree_assortativity", f"{GR}, {_STR}, {_ASSORT} SELECT {_GK}, round({pearson_sql('k')}, 6) + 0.0 AS degree_assortativity FROM za")
def g8(spark, d):
    return rounded(G.degree_assortativity(graphs(spark, d), S), ["degree_assortativity"])


@query("g9_degree_centrality", f"{GR}, {_STR} SELECT {_GK}, round(sum(degree)/19.0/20.0, 6) AS average_degree_centrality FROM st GROUP BY ALL")
def g9(spark, d):
    return rounded(G.average_degree_centrality(graphs(spark, d), S, A20), ["average_degree_centrality"])


@query("g10_eigenvector_centrality")
def g10(spark, d):
    return G.average_eigenvector_centrality(graphs(spark, d), S, A20)


@query("g11_betweenness")
def g11(spark, d):
    return G.average_betweenness(graphs(spark, d), S, A20)


@query("g12_modularity", f"{GR}, {_STR}, m AS (SELECT {_GK}, sum(w) AS m FROM f_graph GROUP BY ALL), ins AS (SELECT {_GK}, i % 3 AS part, sum(w) AS l FROM f_graph WHERE i % 3 = j % 3 GROUP BY ALL), dk AS (SELECT {_GK}, node % 3 AS part, sum(strength) AS k FROM st GROUP BY ALL) SELECT {_GK}, round(sum(coalesce(l, 0)/m - (k/(2*m))*(k/(2*m))), 6) + 0.0 AS modularity, count(*) AS num_communities FROM dk JOIN m USING ({_GK}) LEFT JOIN ins USING ({_GK}, part) GROUP BY ALL")
def g12(spark, d):
    g = graphs(spark, d)
    parts = G.strengths(g, S).select(*S, "node", (F.col("node") % 3).alias("part"))
    return rounded(G.modularity(g, parts, S), ["modularity"])


@query("g12_label_communities")
def g12_labels(spark, d):
    """Modularity of the labels, and whether they had settled after the rounds."""
    g = kept(graphs(spark, d))
    labels, settled = G.propagated_labels(g, S)
    return G.modularity(g, labels, S).join(settled, S)


@query("g12_greedy_communities")
def g12_greedy(spark, d):
    return G.community_score(graphs(spark, d), S, A20)


@query("g13_graph_metrics_table")
def g13(spark, d):
    """All tiers."""
    return G.graph_metrics(graphs(spark, d), S, A20, tuple(G.TIERS))


_G13 = f"{GR}, {_REACH}, {_CLUST}, {_STR}, {_ASSORT}, zc AS (SELECT {_GK}, label, count(*) AS k FROM cc GROUP BY ALL), gm AS MATERIALIZED (SELECT {_GK}, 'num_nodes' AS metric, 20.0::DOUBLE AS value FROM mx UNION ALL SELECT {_GK}, 'num_edges', CAST(count(*) AS DOUBLE) FROM f_graph GROUP BY ALL UNION ALL SELECT {_GK}, 'density', 2*count(*)/380.0 FROM f_graph GROUP BY {_GK} UNION ALL SELECT {_GK}, 'n_components', CAST(count(*) + 20 - sum(k) AS DOUBLE) FROM zc GROUP BY {_GK} UNION ALL SELECT {_GK}, 'largest', CAST(max(k) AS DOUBLE) FROM zc GROUP BY {_GK} UNION ALL SELECT {_pre('mx')}, 'average_clustering', coalesce(c, 0) FROM mx LEFT JOIN cl USING ({_GK}) UNION ALL SELECT {_GK}, 'degree_assortativity', {pearson_sql('k')} FROM za)"


@query("g13_graph_metrics_basic", f"{_G13} SELECT {_GK}, metric, round(value, 6) + 0.0 AS value FROM gm")
def g13_basic(spark, d):
    return rounded(G.graph_metrics(graphs(spark, d), S, A20), ["value"])


# Metrics count to nine places: a difference relative to a true value of 0 would multiply its rounding error by 10^10.
@query("x10_graph_metric_similarity", f"{_G13}, xt AS (SELECT t.subject_id, t.session, t.metric, round(t.value, 9) + 0.0 AS true_value, round(p.value, 9) + 0.0 AS pred_value FROM gm t JOIN gm p ON t.subject_id = p.subject_id AND t.session = p.session AND t.metric = p.metric AND t.version = 'true' AND p.version = 'pred') SELECT subject_id, session, metric, round(true_value, 6) + 0.0 AS true_value, round(pred_value, 6) + 0.0 AS pred_value, round(abs(true_value - pred_value), 6) AS abs_diff, round(abs(true_value - pred_value)/(abs(true_value) + 1e-10), 6) AS rel_diff, round(1 - abs(true_value - pred_value)/(abs(true_value) + 1e-10), 6) AS similarity FROM xt")
def x10(spark, d):
    m = kept(rounded(G.graph_metrics(graphs(spark, d), S, A20), ["value"], 9))
    return rounded(X.metric_similarity(m, ["subject_id", "session"]), ["true_value", "pred_value", "abs_diff", "rel_diff", "similarity"])


@query("x11_graph_metric_summary", f"{_G13}, xt AS (SELECT t.session, t.metric, round(t.value, 9) + 0.0 AS tv, round(p.value, 9) + 0.0 AS pv FROM gm t JOIN gm p ON t.subject_id = p.subject_id AND t.session = p.session AND t.metric = p.metric AND t.version = 'true' AND p.version = 'pred'), s AS (SELECT session, metric, avg(tv) AS tm, avg(pv) AS pm, avg(abs(tv - pv)) AS ad, avg(1 - abs(tv - pv)/(abs(tv) + 1e-10)) AS si, count(*) AS n, sum(tv) AS sx, sum(pv) AS sy, sum(tv*tv) AS sxx, sum(pv*pv) AS syy, sum(tv*pv) AS sxy FROM xt GROUP BY ALL) SELECT session, metric, round(tm, 6) AS true_mean, round(pm, 6) AS pred_mean, round(ad, 6) AS abs_diff_mean, round(si, 6) AS similarity_mean, n, round({pearson_sql('n')}, 4) + 0.0 AS corr FROM s")
def x11(spark, d):
    m = kept(rounded(G.graph_metrics(graphs(spark, d), S, A20), ["value"], 9))
    out = X.metric_summary(X.metric_similarity(m, ["subject_id", "session"]), ["session"])
    return rounded(rounded(out, ["true_mean", "pred_mean", "abs_diff_mean", "similarity_mean"]), ["corr"], 4)


@query("x10_graph_metric_similarity_all")
def x10_all(spark, d):
    """Metrics of all tiers."""
    m = kept(G.graph_metrics(graphs(spark, d), S, A20, tuple(G.TIERS)))
    return X.metric_similarity(m, ["subject_id", "session"])


def _cls(spark, d):
    return classes(spark, d)


def _multi(spark, d):
    a = assign(spark, d)
    e = lambda x, y: L.mask_background(L.encode_symmetric(F.col(x), F.col(y), 21), 21)
    return a.select("session", e("ta", "tb").alias("true"), e("pa", "pb").alias("pred"))


def _mask(a: str, b: str) -> str:
    e = f"least({a}, {b}) * 21 - (least({a}, {b}) * (least({a}, {b}) - 1)) // 2 + greatest({a}, {b}) - least({a}, {b})"
    return f"CASE WHEN {e} < 21 THEN 0 ELSE {e} END"


_MUL = f"{assign_sql()}, f_class AS (SELECT session AS lang, {_mask('ta', 'tb')} AS true_l, {_mask('pa', 'pb')} AS pred_l FROM f_assign)"


def _per(keys="lang"):
    return f"sup AS (SELECT {keys}, true_l AS label, count(*) AS support, count(*) FILTER (true_l = pred_l) AS tp FROM f_class GROUP BY ALL), prd AS (SELECT {keys}, pred_l AS label, count(*) AS predicted FROM f_class GROUP BY ALL), pc AS (SELECT coalesce(s.{keys}, p.{keys}) AS {keys}, coalesce(s.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM sup s FULL JOIN prd p ON s.{keys} = p.{keys} AND s.label = p.label), ps AS (SELECT *, CASE WHEN predicted > 0 THEN tp/predicted END AS precision, CASE WHEN support > 0 THEN tp/support END AS recall, 2*tp/(support + predicted) AS f1 FROM pc)"


_MACRO = "avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1"
_WEIGHT = ", ".join(f"sum({c}*support)/nullif(sum(CASE WHEN {c} IS NOT NULL THEN support END), 0) AS weighted_{c}" for c in ("precision", "recall", "f1"))


def _r(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


MC, WC = ["macro_precision", "macro_recall", "macro_f1"], ["weighted_precision", "weighted_recall", "weighted_f1"]


@query("m1_accuracy", f"WITH {CLASS_SQL} SELECT lang, round(avg(CASE WHEN true_l = pred_l THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f_class GROUP BY ALL")
def m1(spark, d):
    return rounded(K.accuracy(_cls(spark, d), "true", "pred", ["lang"]), ["accuracy"])


@query("m2_per_class", f"WITH {_MUL}, {_per()} SELECT lang AS session, label, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, {_r(['precision', 'recall', 'f1'])} FROM ps")
def m2(spark, d):
    return rounded(K.per_class(_multi(spark, d), "true", "pred", ["session"]), ["precision", "recall", "f1"])


@query("m3_macro", f"WITH {_MUL}, {_per()}, z AS (SELECT lang AS session, {_MACRO} FROM ps GROUP BY ALL) SELECT session, {_r(MC)} FROM z")
def m3(spark, d):
    return rounded(K.macro(K.per_class(_multi(spark, d), "true", "pred", ["session"]), ["session"]), MC)


@query("m4_weighted", f"WITH {_MUL}, {_per()}, z AS (SELECT lang AS session, {_WEIGHT} FROM ps GROUP BY ALL) SELECT session, {_r(WC)} FROM z")
def m4(spark, d):
    return rounded(K.weighted(K.per_class(_multi(spark, d), "true", "pred", ["session"]), ["session"]), WC)


@query("m5_ignore_labels", f"WITH {assign_sql()}, f_class AS (SELECT * FROM (SELECT session AS lang, {_mask('ta', 'tb')} AS true_l, {_mask('pa', 'pb')} AS pred_l FROM f_assign) WHERE true_l <> 0), {_per()}, z AS (SELECT lang AS session, {_MACRO}, {_WEIGHT} FROM ps GROUP BY ALL), a AS (SELECT lang AS session, avg(CASE WHEN true_l = pred_l THEN 1.0 ELSE 0.0 END) AS accuracy FROM f_class GROUP BY ALL) SELECT session, round(accuracy, 6) AS accuracy, {_r(MC + WC)} FROM z JOIN a USING (session)")
def m5(spark, d):
    return rounded(K.classification_metrics(_multi(spark, d), "true", "pred", ["session"], [0]), ["accuracy", *MC, *WC])


@query("m6_confusion_matrix", f"WITH {CLASS_SQL} SELECT lang, true_l AS \"true\", pred_l AS pred, n, round(n / sum(n) OVER (PARTITION BY lang, true_l), 6) AS share FROM (SELECT lang, true_l, pred_l, count(*) AS n FROM f_class GROUP BY ALL)")
def m6(spark, d):
    return rounded(K.confusion(_cls(spark, d), "true", "pred", ["lang"]), ["share"])


def _atlases(spark, d):
    one = lambda n, name: assign(spark, d, n).select(F.lit(name).alias("atlas"), L.encode_symmetric(F.col("ta"), F.col("tb"), n + 1).alias("true"), L.encode_symmetric(F.col("pa"), F.col("pb"), n + 1).alias("pred"))
    return one(A20, "A20").unionByName(one(A40, "A40"))


def _enc(a, b, n):
    return f"least({a}, {b}) * {n} - (least({a}, {b}) * (least({a}, {b}) - 1)) // 2 + greatest({a}, {b}) - least({a}, {b})"


_TWO = f"{assign_sql(A20, 'fa20')}, {assign_sql(A40, 'fa40')}, f_class AS (SELECT 'A20' AS lang, {_enc('ta', 'tb', 21)} AS true_l, {_enc('pa', 'pb', 21)} AS pred_l FROM fa20 UNION ALL SELECT 'A40', {_enc('ta', 'tb', 41)}, {_enc('pa', 'pb', 41)} FROM fa40)"


@query("m7_multi_atlas", f"WITH {_TWO}, {_per()}, z AS (SELECT lang AS atlas, {_MACRO}, {_WEIGHT} FROM ps GROUP BY ALL), a AS (SELECT lang AS atlas, avg(CASE WHEN true_l = pred_l THEN 1.0 ELSE 0.0 END) AS accuracy FROM f_class GROUP BY ALL) SELECT atlas, round(accuracy, 6) AS accuracy, {_r(MC + WC)} FROM z JOIN a USING (atlas)")
def m7(spark, d):
    return rounded(K.classification_metrics(_atlases(spark, d), "true", "pred", ["atlas"]), ["accuracy", *MC, *WC])


_M = "CASE WHEN i = j THEN 1 ELSE 2 END"


_M8 = f"f_class AS (SELECT session AS lang, {_mask('ta', 'tb')} AS true_l, {_mask('pa', 'pb')} AS pred_l FROM f_assign), {_per()}, z AS (SELECT lang AS session, {_MACRO}, {_WEIGHT} FROM ps GROUP BY ALL), a AS (SELECT lang AS session, avg(CASE WHEN true_l = pred_l THEN 1.0 ELSE 0.0 END) AS accuracy FROM f_class GROUP BY ALL)"
_M8_KNOWN = _M8.replace("pred_l FROM f_assign)", "pred_l FROM f_assign WHERE least(ta, tb) > 0)").replace("FROM ps", "FROM kps").replace("FROM f_class", "FROM kf_class").replace("f_class AS", "kf_class AS").replace("sup AS", "ksup AS").replace("prd AS", "kprd AS").replace("pc AS", "kpc AS").replace("ps AS", "kps AS").replace("FROM sup s", "FROM ksup s").replace("JOIN prd p", "JOIN kprd p").replace("FROM pc)", "FROM kpc)").replace(" z AS", " kz AS").replace(" a AS", " ka AS")
_M8_GRAPH = f"s8 AS (SELECT session, i, j, sum(CASE WHEN version = 'true' THEN w ELSE 0 END) AS t, sum(CASE WHEN version = 'pred' THEN w ELSE 0 END) AS p FROM f_edges WHERE ctype = 'nos' GROUP BY ALL), g8 AS (SELECT a.session, x.range AS i, y.range AS j FROM (SELECT DISTINCT session FROM s8) a, range(1, 21) x, range(1, 21) y), m8 AS (SELECT g8.session, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM g8 LEFT JOIN s8 ON s8.session = g8.session AND s8.i = least(g8.i, g8.j) AND s8.j = greatest(g8.i, g8.j)), q8 AS (SELECT session, {sums_sql()}, sum((t-p)*(t-p)) AS dd, sum(abs(t-p)) AS ad, max(abs(t-p)) AS mx FROM m8 GROUP BY ALL), k8 AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY t) + (count(*) OVER (PARTITION BY session, t) - 1) / 2.0 AS t, rank() OVER (PARTITION BY session ORDER BY p) + (count(*) OVER (PARTITION BY session, p) - 1) / 2.0 AS p FROM m8), sp8 AS (SELECT session, {pearson_sql('k')} AS spearman_r FROM (SELECT session, {sums_sql()} FROM k8 GROUP BY ALL)), w8 AS (SELECT session, avg(abs(t - p)) AS wasserstein FROM (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY t) AS q FROM m8) JOIN (SELECT session, p, row_number() OVER (PARTITION BY session ORDER BY p) AS q FROM m8) USING (session, q) GROUP BY ALL)"
_SC = ["accuracy", *MC, *WC]
_M8_OUT = ", ".join([*(f"round({c}, 6) AS {c}" for c in _SC), *(f"round({c}_known, 6) AS {c}_known" for c in _SC)])


@query("m8_evaluation_row", f"{with_edges()}, {_M8}, {_M8_KNOWN}, {_M8_GRAPH}, k AS (SELECT kz.session, {', '.join(f'{c} AS {c}_known' for c in _SC)} FROM kz JOIN ka USING (session)) SELECT session, {_M8_OUT}, round({pearson_sql('400')}, 6) AS r, round(spearman_r, 6) AS spearman_r, round(dd/400, 6) AS mse, round(ad, 6) AS abs_err_sum, round(CASE WHEN sx > 0 THEN ad/sx ELSE 0 END, 6) AS mape, round(sqrt(dd), 6) AS frobenius, round(mx, 6) AS max_abs_error, round(wasserstein, 6) AS wasserstein FROM z JOIN a USING (session) JOIN k USING (session) JOIN q8 USING (session) JOIN sp8 USING (session) JOIN w8 USING (session)")
def m8(spark, d):
    """Scores of all labels and of those that aren't background, and comparisons of the full matrices of counts, in one row."""
    k = ["session"]
    b = C.for_both(both_table(spark, d, metrics=["nos"]).groupBy(*k, "i", "j").agg(F.sum("t").alias("t"), F.sum("p").alias("p")), k)
    b = kept(b)
    graph = C.pearson_full(b, k, A20).join(C.errors_legacy(b, k, A20), k).join(C.norms(b, k), k).join(C.spearman(b, k, A20, full=True).withColumnRenamed("r", "spearman_r"), k).join(C.wasserstein(b, k, A20, full=True), k)
    labels = _multi(spark, d)
    known = K.classification_metrics(labels, "true", "pred", k, [0])
    scores = K.classification_metrics(labels, "true", "pred", k).join(known.select(*k, *[F.col(c).alias(f"{c}_known") for c in _SC]), k)
    out = scores.join(graph, k)
    return rounded(out, [c for c in out.columns if c not in k])


@query("r1_summary", f"{SIM_LONG} SELECT ctype, comparison_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS \"count\" FROM sl GROUP BY ALL")
def r1(spark, d):
    return rounded(R.summary(similarity_long(spark, d), ["ctype", "comparison_type"], "value"), ["mean", "std"])


_WIDE = "w AS (SELECT ctype, subject_id, max(CASE WHEN comparison_type = 'Intrasubject' THEN value END) AS \"Intrasubject\", max(CASE WHEN comparison_type = 'Intersubject' THEN value END) AS \"Intersubject\", max(CASE WHEN comparison_type = 'Group-average' THEN value END) AS \"Group-average\" FROM sl GROUP BY ALL)"
TYPES = ["Intrasubject", "Intersubject", "Group-average"]


@query("r2_describe", f"{with_edges(A40)} SELECT version, 'w' AS \"column\", round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, round(min(w), 6) AS min, round(max(w), 6) AS max, round(quantile_cont(w, 0.25), 6) AS q25, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.75), 6) AS q75 FROM f_edges WHERE ctype = 'nos' GROUP BY ALL")
def r2(spark, d):
    e = edge_table(spark, d, A40, metrics=["nos"]).select("version", "w")
    return rounded(R.describe(e, ["version"], ["w"]), ["mean", "std", "min", "max", "q25", "median", "q75"])


@query("r3_pivot_paired", f"{SIM_LONG}, {_WIDE} SELECT ctype, subject_id, round(\"Intrasubject\", 6) AS \"Intrasubject\", round(\"Intersubject\", 6) AS \"Intersubject\", round(\"Group-average\", 6) AS \"Group-average\" FROM w")
def r3(spark, d):
    return rounded(R.pivot_paired(similarity_long(spark, d), ["ctype", "subject_id"], "comparison_type", TYPES, "value"), TYPES)


def paired(spark, d):
    return R.pivot_paired(similarity_long(spark, d), ["ctype", "subject_id"], "comparison_type", TYPES, "value")


@query("r4_wilcoxon", f"{SIM_LONG}, {_WIDE}, dd AS (SELECT ctype, round(\"Intrasubject\" - \"Group-average\", 12) AS d FROM w), nz AS (SELECT ctype, d, rank() OVER (PARTITION BY ctype ORDER BY abs(d)) + (count(*) OVER (PARTITION BY ctype, abs(d)) - 1)/2.0 AS rk FROM dd WHERE d <> 0) SELECT ctype, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_minus, CAST(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS DOUBLE) AS w FROM nz GROUP BY ALL")
def r4(spark, d):
    return R.wilcoxon(paired(spark, d), "Intrasubject", "Group-average", ["ctype"]).drop("ties")


@query("r4_wilcoxon_p")
def r4_p(spark, d):
    t = R.wilcoxon(paired(spark, d), "Intrasubject", "Group-average", ["ctype"])
    return t.withColumn("p", R.wilcoxon_p(F.col("w"), F.col("n"), F.col("ties")))


@query("r5_common_subjects", f"{with_edges()} SELECT subject_id FROM f_edges WHERE subject_id % 2 = 0 INTERSECT SELECT subject_id FROM f_edges WHERE subject_id % 3 = 0 AND session = 'test'")
def r5(spark, d):
    e = edge_table(spark, d)
    return R.common_subjects(e.where("subject_id % 2 = 0"), e.where("subject_id % 3 = 0 and session = 'test'"), ["subject_id"])


@query("r6_representatives", f"{SIM_LONG}, {_WIDE}, m AS (SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY (\"Intrasubject\" + \"Intersubject\" + \"Group-average\")/3, subject_id) - 1 AS rank, count(*) OVER (PARTITION BY ctype) AS n FROM w) SELECT ctype, subject_id, rank, round((\"Intrasubject\" + \"Intersubject\" + \"Group-average\")/3, 6) AS mean_score FROM m WHERE n < 5 OR rank IN (0, n//4, n//2, (3*n)//4, n-1)")
def r6(spark, d):
    return rounded(R.representatives(paired(spark, d), ["ctype"], TYPES, "subject_id"), ["mean_score"]).select("ctype", "subject_id", "rank", "mean_score")


@query("r7_leaderboard", f"{SIM_LONG} SELECT ctype, comparison_type, subject_id, round(value, 6) AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY ctype, comparison_type ORDER BY value DESC, subject_id) AS place FROM sl) WHERE place <= 5")
def r7(spark, d):
    return rounded(R.leaderboard(similarity_long(spark, d), ["ctype", "comparison_type"], "value", "subject_id"), ["value"])


@query("r8_box_stats", f"{SIM_LONG}, q AS (SELECT ctype, comparison_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM sl GROUP BY ALL) SELECT ctype, comparison_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS whisker_low, round(max(value), 6) AS whisker_high FROM sl JOIN q USING (ctype, comparison_type) WHERE value BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1) GROUP BY ctype, comparison_type, q1, median, q3")
def r8(spark, d):
    return rounded(R.box_stats(similarity_long(spark, d), ["ctype", "comparison_type"], "value"), ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query("r9_value_filter", f"{SIM_LONG} SELECT ctype, subject_id, comparison_type, round(value, 6) AS correlation FROM sl WHERE ctype IN ('nos', 'fa', 'sift2') AND value IS NOT NULL")
def r9(spark, d):
    return rounded(R.select_values(similarity_long(spark, d), "ctype", ["nos", "fa", "sift2"], "value", "correlation"), ["correlation"])


@query("r10_run_manifest", f"{with_edges()} SELECT count(DISTINCT (subject_id, session, version, ctype)) AS n_graphs, count(*) AS n_edges, string_agg(DISTINCT ctype, ',' ORDER BY ctype) AS ctypes FROM f_edges")
def r10(spark, d):
    return R.run_manifest(edge_table(spark, d), [*CMP_KEYS, "version"])
