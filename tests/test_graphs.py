import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajgraph.operators import compare as C
from trajgraph.operators import edges as E
from trajgraph.operators import graph as G
from trajgraph.operators import neighbors as N
from trajgraph.operators import similarity as S
from trajgraph.operators import stats as R

GRAPHS = {
    "path4": [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)],
    "k4": [(i, j, 2.0) for i in range(1, 5) for j in range(i + 1, 5)],
    "two": [(1, 2, 1.0), (3, 4, 4.0)],
    "loop": [(1, 1, 3.0), (1, 2, 1.0)],
}


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame([(k, i, j, w) for k, rows in GRAPHS.items() for i, j, w in rows], "graph_id string, i int, j int, w double")


def values(df, column):
    return {r.graph_id: r[column] for r in df.collect()}


def test_components(e):
    got = G.components(e, ["graph_id"], 4)
    assert values(got, "n_components") == {"path4": 1, "k4": 1, "two": 2, "loop": 3}
    assert values(got, "largest") == {"path4": 4, "k4": 4, "two": 2, "loop": 2}


def test_density_and_clustering(e):
    assert values(G.size_and_density(e, ["graph_id"], 4), "density")["k4"] == 1
    got = values(G.average_clustering(e, ["graph_id"], 4), "average_clustering")
    assert math.isclose(got["k4"], 1.0) and got["path4"] == 0 and got["loop"] == 0


@pytest.mark.parametrize("bound", [2000, 0])
def test_paths(e, monkeypatch, bound):
    monkeypatch.setattr(G, "DENSE_NODES", bound)
    got = values(G.average_path_length(e, ["graph_id"], 4), "average_path_length")
    assert math.isclose(got["path4"], 10 / 6) and math.isclose(got["k4"], 0.5) and math.isclose(got["loop"], 1)
    got = values(G.global_efficiency(e, ["graph_id"], 4), "global_efficiency")
    assert math.isclose(got["path4"], (6 + 2 * 2 * 0.5 + 2 / 3) / 12) and got["k4"] == 1
    assert values(G.local_efficiency(e, ["graph_id"], 4), "local_efficiency")["k4"] == 1


@pytest.mark.parametrize("bound", [2000, 0])
def test_centrality(e, monkeypatch, bound):
    monkeypatch.setattr(G, "DENSE_NODES", bound)
    got = values(G.average_betweenness(e, ["graph_id"], 4), "average_betweenness")
    assert math.isclose(got["path4"], (2 * 2 / 3) / 4) and got["k4"] == 0 and got["two"] is None
    got = values(G.average_eigenvector_centrality(e, ["graph_id"], 4), "average_eigenvector_centrality")
    a = np.diag([1.0] * 3, 1) + np.diag([1.0] * 3, -1)
    want = np.abs(np.linalg.eigh(a)[1][:, -1]).mean()
    assert math.isclose(got["k4"], 0.5, rel_tol=1e-6) and math.isclose(got["path4"], want, rel_tol=1e-3) and got["two"] is None


def test_both_forms_of_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, i, j, float(rng.integers(1, 4))) for k in range(4) for i in range(1, 9) for j in range(i, 9) if rng.random() < 0.25]
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    for f in (G.average_path_length, G.average_betweenness, G.global_efficiency, G.local_efficiency):
        found = []
        for bound in (2000, 0):
            monkeypatch.setattr(G, "DENSE_NODES", bound)
            found.append({r.graph_id: r[1] for r in f(e, ["graph_id"], 8).collect()})
        assert found[0].keys() == found[1].keys()
        assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-9) for a, b in ((found[0][k], found[1][k]) for k in found[0])), f.__name__


def test_modularity_of_two_parts(e):
    parts = G.component_labels(e, ["graph_id"]).withColumnRenamed("label", "part")
    got = values(G.modularity(e, parts, ["graph_id"]), "modularity")
    assert math.isclose(got["two"], 1 - (1 / 5) ** 2 - (4 / 5) ** 2) and math.isclose(got["k4"], 0, abs_tol=1e-12)


def test_population_mean_counts_absent_edges(spark):
    e = spark.createDataFrame([(1, "nos", 1, 2, 3.0), (2, "nos", 1, 3, 1.0), (3, "nos", 1, 3, 2.0), (1, "fa", 1, 2, 1.0)], "subject_id int, ctype string, i int, j int, w double")
    got = {(r.ctype, r.i, r.j): (r.w, r.n_subjects) for r in E.population_mean(e, ["ctype"]).collect()}
    assert got == {("nos", 1, 2): (1.0, 3), ("nos", 1, 3): (1.0, 3), ("fa", 1, 2): (1.0, 1)}


def dense(rows, n=4):
    a = np.zeros((n, n))
    for i, j, w in rows:
        a[i - 1, j - 1] = a[j - 1, i - 1] = w
    return a


PAIRS = {"sparse": ([(1, 2, 1.0), (2, 2, 3.0), (3, 4, 2.0)], [(1, 2, 2.0), (1, 4, 1.0), (3, 4, 5.0)]), "equal": ([(1, 2, 1.0), (3, 4, 2.0)], [(1, 2, 1.0), (3, 4, 2.0)]), "disjoint": ([(1, 2, 1.0), (1, 1, 2.0)], [(3, 4, 1.0)])}


def test_comparisons_against_numpy(spark):
    frame = lambda k: spark.createDataFrame([(g, *r) for g, p in PAIRS.items() for r in p[k]], "graph_id string, i int, j int, w double")
    x, y = frame(0), frame(1)
    both = C.both_sides(x, y, ["graph_id"])
    iu = np.triu_indices(4)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = {n: values(df, c) for n, df, c in (("r", C.pearson_dense(both, ["graph_id"], 4), "r"), ("full", C.pearson_full(both, ["graph_id"], 4), "r"), ("s", C.spearman(both, ["graph_id"], 4), "r"), ("w", C.wasserstein(both, ["graph_id"], 4), "wasserstein"), ("sf", C.spearman(both, ["graph_id"], 4, full=True), "r"), ("wf", C.wasserstein(both, ["graph_id"], 4, full=True), "wasserstein"), ("z", C.pearson_z(both, ["graph_id"], 4), "r"), ("lerm", C.lerm(both, ["graph_id"], 4), "lerm"))}
    for g, (p, q) in PAIRS.items():
        a, b = dense(p), dense(q)
        t, u = a[iu], b[iu]
        assert math.isclose(got["r"][g], np.corrcoef(t, u)[0, 1], abs_tol=1e-9)
        assert math.isclose(got["z"][g], np.corrcoef(t, u)[0, 1], abs_tol=1e-6)
        assert math.isclose(got["full"][g], np.corrcoef(a.ravel(), b.ravel())[0, 1], abs_tol=1e-9)
        assert math.isclose(got["s"][g], np.corrcoef(rank(t), rank(u))[0, 1], abs_tol=1e-9)
        assert math.isclose(got["w"][g], np.abs(np.sort(t) - np.sort(u)).mean(), abs_tol=1e-9)

        assert math.isclose(got["sf"][g], np.corrcoef(rank(a.ravel()), rank(b.ravel()))[0, 1], abs_tol=1e-9)
        assert math.isclose(got["wf"][g], np.abs(np.sort(a.ravel()) - np.sort(b.ravel())).mean(), abs_tol=1e-9)

        def log(m):
            v, s = np.linalg.eigh(m + 1e-10 * np.eye(4))
            return (s * np.log(np.abs(v))) @ s.T

        assert math.isclose(got["lerm"][g], np.linalg.norm(log(a) - log(b)), rel_tol=1e-6, abs_tol=1e-9)


def test_p_values():
    assert math.isclose(C.p_of_r(0.5, 10), 0.1411, abs_tol=1e-4)
    assert C.p_of_r(0.0, 10) == 1.0
    assert math.isclose(R.p_of_w(0, 5, 0), 2 / 32)


def test_p_values_against_integrals_and_enumeration():
    for r, n in ((0.3, 20), (0.9, 5), (-0.5, 30), (0.05, 3240), (0.7, 12), (0.999, 8)):
        t, df = abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2
        # Student's density by the midpoint rule over x = t / sin(u), u from 0 to half of pi.
        k = 200_000
        u = (np.arange(k) + 0.5) * (math.pi / 2) / k
        x = t / np.sin(u)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
        tail = (density * t * np.cos(u) / np.sin(u) ** 2).sum() * (math.pi / 2) / k
        assert math.isclose(C.p_of_r(r, n), 2 * tail, rel_tol=1e-5), (r, n)
    for n in (3, 6, 9):
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert math.isclose(R.p_of_w(w, n, 0), min(1.0, 2 * sum(x <= w for x in sums) / len(sums)))


def test_betweenness_and_eigenvector_by_enumeration(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, j, float(rng.integers(1, 4))) for k in range(5) for i in range(1, 7) for j in range(i + 1, 7) if rng.random() < 0.5]
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    between = {r.graph_id: r[1] for r in G.average_betweenness(e, ["graph_id"], 6).collect()}
    eigen = {r.graph_id: r[1] for r in G.average_eigenvector_centrality(e, ["graph_id"], 6).collect()}
    for k in between:
        a = np.zeros((6, 6))
        for g, i, j, w in rows:
            if g == k:
                a[i - 1, j - 1] = a[j - 1, i - 1] = w
        own = G.largest(a)
        n = len(own)

        def paths(s, t, seen, own=own):
            if s == t:
                yield 0.0, 0
                return
            for v in np.flatnonzero(own[s]):
                if v not in seen:
                    for length, inner in paths(v, t, {*seen, v}):
                        yield own[s, v] + length, inner + (v != t)

        total = 0.0
        for s, t in itertools.permutations(range(n), 2):
            found = list(paths(s, t, {s}))
            best = min(x for x, _ in found)
            total += np.mean([inner for x, inner in found if math.isclose(x, best)])
        assert math.isclose(between[k], total / (n * (n - 1) * (n - 2)), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(eigen[k], np.abs(np.linalg.eigh(own)[1][:, -1]).mean(), rel_tol=1e-4)


def test_nearest_lines_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_LINES", 16)
    rng = np.random.default_rng(6)
    lines = rng.normal(size=(50, 5, 3)).round(1)
    lines[7], lines[8], lines[9] = lines[3], lines[3][::-1], lines[3]
    rows = [(i % 2, i, [tuple(map(float, p)) for p in x]) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "subject_id int, streamline_id int, points array<struct<r: double, a: double, s: double>>")
    got = {}
    for r in N.knn(df, ["subject_id"], "streamline_id", "points", 4).collect():
        got.setdefault(r.streamline_id, []).append((r["rank"], r.neighbour, round(r.dist, 9), r.flip))
    for i, x in enumerate(lines):
        want = []
        for j, y in enumerate(lines):
            if i % 2 == j % 2:
                direct, turned = np.linalg.norm(x - y) / 15, np.linalg.norm(x - y[::-1]) / 15
                want.append((round(min(direct, turned), 9), j, int(turned < direct)))
        want = [(k + 1, j, d, f) for k, (d, j, f) in enumerate(sorted(want)[:4])]
        assert sorted(got[i]) == want


def test_wilcoxon_small(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.0, 2.0), ("a", 5.0, 2.0), ("a", 3.0, 3.0), ("a", 2.0, 1.0), ("b", 1.0, 0.0)], "k string, x double, y double")
    got = R.wilcoxon(df, "x", "y", ["k"]).collect()
    assert [(r.k, r.n, r.w_plus, r.w_minus, r.w) for r in got] == [("a", 4, 1.5 + 1.5 + 4, 3.0, 3.0)]


def test_one_subject_has_no_inter_similarity(spark):
    e = spark.createDataFrame([("c", 1, 1, 2, 1.0), ("c", 1, 2, 3, 2.0)], "ctype string, subject_id int, i int, j int, w double")
    assert S.inter_similarity(e, e, ["ctype"], "subject_id", 4).count() == 0
    b = C.both_sides(e, e, ["ctype", "subject_id"])
    assert math.isclose(S.intra_similarity(b, ["ctype"], "subject_id", 4).first().value, 1.0, rel_tol=1e-6)


def test_similarities_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    rng, n, subjects = np.random.default_rng(1), 5, range(5)
    graphs = {}
    for v in ("true", "pred"):
        for s in subjects:
            a = np.triu(rng.integers(0, 4, (n, n)).astype(float))
            graphs[v, s] = a + a.T - np.diag(np.diag(a))
    rows = [("nos", s, v, i + 1, j + 1, float(a[i, j])) for (v, s), a in graphs.items() for i in range(n) for j in range(i, n) if a[i, j]]
    e = spark.createDataFrame(rows, "ctype string, subject_id int, version string, i int, j int, w double")
    keys, group = ["ctype", "subject_id"], ["ctype"]
    b = C.paired(e, keys, "version", "true", "pred")
    iu = np.triu_indices(n)

    def z(a):
        return (a[iu] - a[iu].mean()) / (a[iu].std() + 1e-10)

    def log(a):
        v, s = np.linalg.eigh(a + 1e-10 * np.eye(n))
        return (s * np.log(np.abs(v))) @ s.T

    r = lambda x, y: z(x) @ z(y) / len(iu[0])
    far = lambda x, y: np.linalg.norm(log(x) - log(y))
    by = lambda df, c="value": {x.subject_id: x[c] for x in df.collect()}
    logs = C.log_vectors(e, [*keys, "version"], n)
    mean = sum(graphs["true", s] for s in subjects) / len(subjects)
    population = S.population_logs(b, group, "subject_id", n)
    side = lambda v: e.where(F.col("version") == v).drop("version")
    got = {
        "intra": by(S.intra_similarity(b, group, "subject_id", n)), "inter": by(S.inter_similarity(side("true"), side("pred"), group, "subject_id", n)), "pop": by(S.group_similarity(b, group, "subject_id", n)),
        "intra_lerm": by(S.intra_lerm(logs, group, "subject_id")), "inter_lerm": by(S.inter_lerm(logs, group, "subject_id")), "pop_lerm": by(S.group_lerm(logs, population, group, "subject_id")),
    }
    for s in subjects:
        t, p = graphs["true", s], graphs["pred", s]
        others = [graphs["true", x] for x in subjects if x != s]
        want = {"intra": r(p, t), "inter": np.mean([r(p, x) for x in others]), "pop": r(p, mean), "intra_lerm": far(p, t), "inter_lerm": np.mean([far(p, x) for x in others]), "pop_lerm": far(p, mean)}
        for name, value in want.items():
            assert math.isclose(got[name][s], value, rel_tol=1e-6, abs_tol=1e-9), name
    within = S.intersubject_lerm(logs, ["ctype", "version"], "subject_id").where("version = 'true'").first()
    pairs = [far(graphs["true", x], graphs["true", y]) for x in subjects for y in subjects if x < y]
    assert within.n_pairs == len(pairs) and math.isclose(within.mean_lerm, np.mean(pairs), rel_tol=1e-6) and math.isclose(within.std_lerm, np.std(pairs), rel_tol=1e-5)
    x8 = {(x.subject_id, x.comparison): x.lerm for x in S.test_vs_population_lerm(logs, population, group, "subject_id").collect()}
    assert all(math.isclose(x8[s, "true-pop"], far(graphs["true", s], mean), rel_tol=1e-6) for s in subjects) and len(x8) == 3 * len(subjects)


def test_edges_of_two_versions_match_single_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), *map(int, rng.integers(0, 6, 4)), None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(rng.random())) for k, s in enumerate(rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "subject_id int, ta int, tb int, pa int, pb int, fa double")
    b = E.edges_both(df, ("ta", "tb"), ("pa", "pb"), ["nos", "fa"], ["subject_id"], 5)
    e = E.edges_all_metrics(df, {"true": ("ta", "tb"), "pred": ("pa", "pb")}, ["nos", "fa"], ["subject_id"], 5)
    for c, v in (("t", "true"), ("p", "pred")):
        got = {(r.subject_id, r.ctype, r.i, r.j): r[c] for r in b.collect() if r[c]}
        want = {(r.subject_id, r.ctype, r.i, r.j): r.w for r in e.where(F.col("version") == v).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_graph_compare_matches_parts(spark):
    x = spark.createDataFrame([("g", *r) for r in PAIRS["sparse"][0]], "graph_id string, i int, j int, w double")
    y = spark.createDataFrame([("g", *r) for r in PAIRS["sparse"][1]], "graph_id string, i int, j int, w double")
    b = C.both_sides(x, y, ["graph_id"])
    row = C.graph_compare(b, ["graph_id"], 4, p_values=True, logs=True).first()
    assert math.isclose(row.spearman_r, C.spearman(b, ["graph_id"], 4).first().r) and math.isclose(row.pearson_p, C.p_of_r(row.pearson_r, 10)) and math.isclose(row.lerm, C.lerm(b, ["graph_id"], 4, "complex").first().lerm) and math.isclose(row.lerm_real, C.lerm(b, ["graph_id"], 4).first().lerm) and math.isclose(row.mean_lerm, C.lerm(b, ["graph_id"], 4, "gated").first().lerm)
    assert math.isclose(row.pearson_r, C.pearson_dense(b, ["graph_id"], 4).first().r)
    assert math.isclose(row.mae, C.errors(b, ["graph_id"], 4).first().mae)
    assert (row.n_true, row.n_pred) == (3, 3)
    assert C.nonzero_either(b).where(F.col("t") == 0).count() == 1


def principal_log(a):
    """The complex logarithm by a complex eigendecomposition that knows nothing of symmetry."""
    values, vectors = np.linalg.eig(a.astype(complex))
    return vectors @ np.diag(np.log(values.real + 0j)) @ np.linalg.inv(vectors)


def test_lerm_flavours_by_complex_eigendecomposition(spark):
    """Random sparse graphs, most with negative eigenvalues; a singular one, a constant one and a tiny one shut the gate."""
    rng, n, rows, sides = np.random.default_rng(7), 7, [], {}
    for k in range(12):
        t, p = (np.where(rng.random((n, n)) < 0.7, rng.random((n, n)) * 20, 0.0) for _ in range(2))
        t, p = np.triu(t) + np.triu(t, 1).T, np.triu(p) + np.triu(p, 1).T
        if k == 9:
            t[:, 0] = t[0] = 0  # singular: the condition number is infinite
        if k == 10:
            t[:] = 1.0
        if k == 11:
            t *= 1e-9
        sides[k] = t, p
        rows += [(k, i + 1, j + 1, float(t[i, j]), float(p[i, j])) for i in range(n) for j in range(i, n) if t[i, j] or p[i, j]]
    b = spark.createDataFrame(rows, "graph_id int, i int, j int, t double, p double")
    got = {r.graph_id: r for r in C.lerm_flavours(b, ["graph_id"], n).collect()}
    gated, fallback = ({r.graph_id: r[1] for r in x.collect()} for x in (C.lerm(b, ["graph_id"], n, "gated"), C.rel_diff_mean(b, ["graph_id"], n)))
    for k, (t, p) in sides.items():
        d = principal_log(p + 1e-10 * np.eye(n)) - principal_log(t + 1e-10 * np.eye(n)) if k not in (9, 10) else None
        if d is not None:
            assert math.isclose(got[k].lerm_complex, np.linalg.norm(d), rel_tol=1e-6) and math.isclose(got[k].lerm_real, np.linalg.norm(d.real), rel_tol=1e-6)
        shift = max(1e-10, min(t.max(), p.max()) * 1e-6)
        well = t.max() > 1e-6 and max(np.linalg.cond(t), np.linalg.cond(p)) < 1e12
        want = np.linalg.norm(principal_log(p + shift) - principal_log(t + shift)) if well else fallback[k]
        assert (k >= 9) == (got[k].lerm_well is None) and math.isclose(gated[k], want, rel_tol=1e-6)
    assert any(got[k].lerm_complex > got[k].lerm_real + 1 for k in range(9))


def test_complex_log_vectors_keep_distances(spark):
    rng, n = np.random.default_rng(9), 6
    a = [m + m.T for m in rng.normal(size=(2, n, n))]
    e = spark.createDataFrame([(k, i + 1, j + 1, float(m[i, j])) for k, m in enumerate(a) for i in range(n) for j in range(i, n)], "k int, i int, j int, w double")
    x, y = (np.array(r.log) for r in sorted(C.log_vectors(e, ["k"], n, imaginary=True).collect()))
    assert math.isclose(np.linalg.norm(x - y), np.linalg.norm(principal_log(a[0]) - principal_log(a[1])), rel_tol=1e-6)
    assert C.log_vectors(e.withColumn("w", F.lit(0.0)), ["k"], n, eps=0.0).count() == 0


def merged_naively(a):
    """Greedy merging that measures the modularity of every possible merger of joined communities anew."""
    n, m = len(a), np.triu(a).sum()
    k = a.sum(1) + np.diag(a)
    parts = [{i} for i in range(n)]

    def q(parts):
        return sum(np.triu(a)[np.ix_(sorted(p), sorted(p))].sum() / m - (k[sorted(p)].sum() / (2 * m)) ** 2 for p in parts)

    while True:
        options = [(q([*parts[:i], *parts[i + 1 : j], *parts[j + 1 :], parts[i] | parts[j]]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)) if a[np.ix_(sorted(parts[i]), sorted(parts[j]))].any()]
        if not options or max(options)[0] < q(parts) - 1e-12:
            return q(parts), len(parts)
        _, i, j = max(options)
        parts = [*parts[:i], *parts[i + 1 : j], *parts[j + 1 :], parts[i] | parts[j]]


def test_greedy_communities_by_naive_merging(spark):
    """A hundred random graphs with loops and isolated nodes."""
    rng, n, rows, want = np.random.default_rng(12), 9, [], {}
    for g in range(100):
        a = np.triu(np.where(rng.random((n, n)) < rng.uniform(0.15, 0.6), rng.random((n, n)) + 0.1, 0.0))
        a = a + np.triu(a, 1).T
        a[:, n - 1] = a[n - 1] = 0
        a[0, 1] = a[1, 0] = 1.0
        rows += [(g, i + 1, j + 1, float(a[i, j])) for i in range(n) for j in range(i, n) if a[i, j]]
        want[g] = merged_naively(a)
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    got = {r.graph_id: (r.modularity, r.num_communities) for r in G.community_score(e, ["graph_id"], n).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g][0], want[g][0], abs_tol=1e-9) and got[g][1] == want[g][1] for g in want)
    parts = G.greedy_communities(e, ["graph_id"], n)
    again = {r.graph_id: r.modularity for r in G.modularity(e, parts, ["graph_id"]).collect()}
    assert all(math.isclose(again[g], got[g][0], abs_tol=1e-9) for g in want) and parts.count() == 100 * n


def test_moved_communities_of_large_graphs(spark, monkeypatch):
    """Three dense groups with few links between them: the rounds of joins find them, or as good a partition."""
    rng, n = np.random.default_rng(1), 24
    rows = [(0, i, j, 1.0) for i in range(1, n + 1) for j in range(i + 1, n + 1) if rng.random() < (0.9 if i % 3 == j % 3 else 0.05)]
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    whole = G.community_score(e, ["graph_id"], n + 1).first()
    monkeypatch.setattr(G, "DENSE_NODES", 0)
    got = G.community_score(e, ["graph_id"], n + 1).first()
    assert got.num_communities == whole.num_communities == 4 and math.isclose(got.modularity, whole.modularity, abs_tol=1e-9)
    found = {r.node: r.part for r in G.moved_communities(e, ["graph_id"]).collect()}
    assert all((found[i] == found[j]) == (i % 3 == j % 3) for i in found for j in found)


def test_all_metrics_in_one_pass_agree_with_joins(spark, monkeypatch):
    rng, n = np.random.default_rng(6), 8
    rows = [(g, i, j, float(rng.integers(1, 5))) for g in range(5) for i in range(1, n + 1) for j in range(i, n + 1) if rng.random() < 0.35]
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    tiers = ("basic", "advanced", "centrality")
    found = []
    for bound in (2000, 0):
        monkeypatch.setattr(G, "DENSE_NODES", bound)
        found.append({(r.graph_id, r.metric): r.value for r in G.graph_metrics(e, ["graph_id"], n, tiers).collect()})
    assert found[0].keys() == found[1].keys()
    for k, x in found[0].items():
        y = found[1][k]
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)), k


def test_labels_tell_whether_they_settled(spark):
    e = spark.createDataFrame([("two", 1, 2, 1.0), ("two", 3, 4, 4.0), ("loop", 1, 1, 3.0)], "graph_id string, i int, j int, w double")
    labels, settled = G.propagated_labels(e, ["graph_id"], 8)
    assert values(settled, "settled") == {"two": False, "loop": True}  # two nodes that only know each other swap for ever
    assert labels.count() == 5


def test_sums_of_pairs_without_pairs(spark, monkeypatch):
    """Subjects in many blocks: sums of all ordered and unordered pairs; a subject without a true graph, one without a predicted one."""
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(11, 6))
    df = spark.createDataFrame([("g", i, [float(x) for x in r]) for i, r in enumerate(v)], "g string, s int, z array<double>")
    dots = v @ v.T
    upper = dots[np.triu_indices(11, 1)]
    got = S.pair_sums(df, df, ["g"], "s", "z", "dot", False).first()
    assert got.k == 55 and math.isclose(got.total, upper.sum()) and math.isclose(got.squares, (upper**2).sum())
    each = {r.s: r for r in S.pair_sums(df, df.where("s < 5"), ["g"], "s", "z", "distance", True).collect()}
    for i in range(11):
        far = [np.linalg.norm(v[i] - v[j]) for j in range(5) if j != i]
        assert each[i].k == len(far) and math.isclose(each[i].total, sum(far), rel_tol=1e-9) and math.isclose(each[i].squares, sum(x * x for x in far), rel_tol=1e-9)
    graphs = {(side, i): np.triu(rng.integers(0, 3, (4, 4))).astype(float) + np.eye(4) for i in range(5) for side in "tp"}
    rows = [("c", i, r + 1, c + 1, float(graphs["t", i][r, c]) if i != 2 else 0.0, float(graphs["p", i][r, c]) if i != 3 else 0.0) for i in range(5) for r in range(4) for c in range(r, 4)]
    b = spark.createDataFrame(rows, "ctype string, subject_id int, i int, j int, t double, p double")
    iu = np.triu_indices(4)
    r = lambda x, y: np.corrcoef(x[iu], y[iu])[0, 1]
    got = {x.subject_id: x.value for x in S.inter_of_both(b, ["ctype"], "subject_id", 4).collect()}
    want = {i: np.mean([r(graphs["p", i], graphs["t", j]) for j in range(5) if j not in (i, 2)]) for i in range(5) if i != 3}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_graphs_without_a_logarithm_are_counted(spark):
    logs = spark.createDataFrame([("c", i, v, [float(i), 1.0]) for i in range(3) for v in ("true", "pred") if (i, v) != (2, "true")], "ctype string, subject_id int, version string, log array<double>")
    subjects = spark.createDataFrame([("c", i) for i in range(3)], "ctype string, subject_id int")
    got = {r.subject_id: (r.value, r.left_out) for r in S.inter_lerm(logs, ["ctype"], "subject_id", subjects).collect()}
    assert got == {0: (1.0, 1), 1: (1.0, 1), 2: (1.5, 0)}
