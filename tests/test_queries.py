"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from trajgraph.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
#: A few of each family; the others are compared by the driver on larger tables.
NAMES = ["s1_read_label_pairs", "s5_read_matrix_csv", "s9_load_pairs", "k6_append_splits", "l1_encode_symmetric", "l8_detect_index_base", "t2_rare_labels_apply", "t3_split_by_subject", "p2_resample_decay", "p7_assign_endpoints", "p8_recenter", "a2_edges_mean", "a4_edges_all_metrics", "a6_edges_diff", "c5_spearman", "c12_wasserstein", "c18_graph_compare", "x2_inter_similarity", "m2_per_class", "m4_weighted", "r4_wilcoxon", "g5_average_path_length"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else round(float(v), 4) + 0.0
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    cur = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert sorted(names) == columns and len(got) == len(want)
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-3, abs_tol=2e-4))
    assert all(near(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
