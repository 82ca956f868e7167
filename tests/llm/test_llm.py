"""The training-data operators against brute force on small tables, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajgraph.llm import decontaminate, fingerprints, langid, mixing, near_dedup, pii, quality, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and quick brown fox jumps over lazy dog while seven wizards boil jars from quartz mountain".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [sentence(rng, int(n)) for n in rng.integers(3, 120, 40)]
    shared = sentence(rng, 60)
    texts = [*base, base[0], base[0], base[1] + " end", *(sentence(rng, 20) + "\n" + shared + "\n" + sentence(rng, 15) for _ in range(6))]
    near = base[2] = sentence(rng, 100)
    for k in range(5):
        w = near.split()
        w[10 * k] = "changed"
        texts.append(" ".join(w))
    texts += [near, None, "", "   ", "one two", "One  TWO", "x" * 50_000, "ab " * 9000, "1 2 3", "né à ü", "Ünïcode straße"]
    return [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that clash with names of the operators, and a repeated row.
    df = spark.createDataFrame([*rows, rows[5]], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "score", "row", "key", "bin", "shard", "spans", "node", "component", "part", "y")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 2, r[0] % 3 % 2) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    items = [(1, " ".join(rows[7][1].split()[:30])), (2, "One two"), (3, None), (4, "!!"), (5, rows[43][1]), (5, rows[43][1]), (None, rows[9][1])]
    return spark.createDataFrame(items, "item_id long, text string")


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == docs.count() and sharding.shard_documents(empty).count() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {16}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_sharding_moves_only_to_the_new_shard(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for n in (16, 17, 20):
        both = sharding.descend(sharding.descend(ids, sharding.tree(n)), sharding.tree(n + 1), "grown")
        assert {r.grown for r in both.where("shard <> grown").select("grown").distinct().collect()} == {n}
        counts = [r["count"] for r in both.groupBy("shard").count().collect()]
        assert min(counts) > 0.8 * 20_000 / n and max(counts) < 1.2 * 20_000 / n


def water(sizes, weights):
    total, target, left = 1.5 * sum(sizes.values()), {}, dict(sizes)
    while True:
        w = sum(weights[s] for s in left)
        rest = total - sum(target.values())
        full = [s for s in left if rest * weights[s] / w >= 2 * sizes[s]] if w else []
        if not full:
            return target | {s: rest * weights[s] / w for s in left}
        for s in full:
            target[s] = 2.0 * sizes[s]
            del left[s]


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got["source"] = [source[i] or "~" for i in got["doc_id"]]
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) for r in got.itertuples())
    sizes = got.groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = water(sizes, weights)
    for s, g in got.groupby("source"):
        assert np.isclose(g["target"].iloc[0], want[s]) and g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - want[s]) <= g["size"].max()
        assert (g["taken"] <= 2 * g["size"]).all()
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert Counter(zip(got["doc_id"], got["taken"], strict=True)) == Counter(zip(again["doc_id"], again["taken"], strict=True))
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(docs).count() == got["times"].sum()


def words10(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


@pytest.mark.parametrize(("most", "at_once"), [(200_000, 2), (60, 100), (30, 2)])
def test_decontamination(docs, benchmark, empty, most, at_once):
    items = {r.item_id and str(r.item_id): words10(r.text) for r in benchmark.collect()}
    windows = [(k, w[i : i + 13]) for k, w in items.items() for i in range(max(1, len(w) - 12)) if w]
    hit, bad = decontaminate.contaminated()
    got = decontaminate.hit_columns(docs.select("doc_id", "text"), benchmark, most=most, at_once=at_once).select("doc_id", "text", "_n", "_items", hit.alias("hit"), bad.alias("bad")).collect()
    assert len(got) == docs.count()
    for r in got:
        w, marks, names = words10(r.text), set(), set()
        for k, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    marks.update(range(i, i + len(win)))
                    names.add(k)
        assert (r._n, r.hit, r._items) == (len(w), len(marks), sorted(names - {None}))
        assert r.bad == (len(marks) > 0 and 20 * len(marks) >= len(w))
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert not decontaminate.decontaminate(docs, benchmark.limit(0)).where("contaminated").count()
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r.bad for r in got)
    cut = decontaminate.cut_contaminated(docs, benchmark)
    assert cut.columns == docs.columns
    left = Counter((r.doc_id, len(words10(r.text))) for r in cut.collect())
    assert left == Counter((r.doc_id, r._n - (r.hit if r.bad else 0)) for r in got)


def test_suffix_order():
    rng = np.random.default_rng(10)
    for letters, longest in ((b"ab", 40), (bytes(range(256)), 20), (b"\0\1", 70)):
        strings = [bytes(rng.choice(list(letters), int(rng.integers(0, longest))).astype(np.uint8)) for _ in range(300)] + [b"", b"a" * 64, b"a" * 64, b"a" * 63]
        flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        size = np.array([len(x) for x in strings])
        order, common = suffix_dedup.suffix_order(flat, np.cumsum(size) - size, size)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for k in range(1, len(got)):
            a, b = got[k - 1], got[k]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("hot", "at_once"), [(2000, 20_000), (2, 5), (0, 1)])
def test_suffix_dedup(docs, empty, monkeypatch, hot, at_once):
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", hot)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    length = 50
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = []
    for i, b in rows:
        covered = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                covered[p] += 1
                covered[p + length] -= 1
        on = np.cumsum(covered)[:-1] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~on])
        want.append((i, len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs, length, 16).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.cut_repeats(empty, length, 16).count() == 0


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("large", [64, 1])
def test_near_dedup(docs, empty, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    text = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t, 4) for i, t in text.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if either and 100 * both >= 80 * either:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = near_dedup.near_duplicates(docs, 4).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(empty, 4).count() == 0
    kept = near_dedup.keep_one(docs, 4)
    assert kept.columns == docs.columns and kept.count() == sum(find(i) == i for i in sets)


@pytest.mark.parametrize("hot", [1000, 0])
def test_near_dedup_of_repeated_and_missing_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rng = np.random.default_rng(9)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (None, c), (None, c), (4, ""), (4, ""), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (None, None, True), (5, 5, True)]
    assert got == Counter(want)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, ""), (5, None), (None, a), (None, c), (None, c), (None, None)], key=str)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    graph = defaultdict(set)
    for a, b in pairs:
        graph[a].add(b)
        graph[b].add(a)
    want, seen = {}, set()
    for s in sorted(graph):
        todo = [s] if s not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = s
                todo += graph[x]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if graph[k] != {k}}


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == docs.count() and fingerprints.fingerprint(empty).count() == 0
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text)
    following = {i: text[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    by_text = {}
    for r in got:
        t, n = text[r.doc_id], following[r.doc_id]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)


def test_fingerprints_follow_edits():
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 3000))
    other = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 3000))
    edits = []
    for n in (1, 10, 100):
        t = list(base)
        for p in sorted(rng.integers(0, len(t), n), reverse=True):
            if p % 2:
                del t[p]
            else:
                t.insert(p, "q")
        edits.append("".join(t))
    a, b, c, d, z = fingerprints.fingerprints([base, *edits, other])
    like = [fingerprints.likeness(a, x) for x in (a, b, c, d, z)]
    # After an edit the walks need some steps to meet again, more or less as chance has it.
    assert like[0] == 1 and min(like[1:3]) > 0.6 and min(like[1:3]) > like[3] > like[4] and like[4] < 0.05


@pytest.mark.parametrize("large", [64, 1])
def test_near_classes(spark, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnop ")
    made = ["".join(rng.choice(letters, int(n))) for n in rng.integers(40, 4000, 40)]
    head = "".join(rng.choice(letters, 1500))
    made += [head + "".join(rng.choice(letters, 900)) for _ in range(6)]  # alike at their beginnings alone
    texts = list(made)
    for t in made:
        for k in (1, 2):
            p = int(rng.integers(0, len(t)))
            texts.append(t[:p] + "#" * k + t[p + k :])
    across = "".join(rng.choice(letters, 1700))
    texts += [across, across[:-9] + "#" + across[-9:], made[0], "", None]
    prints = spark.createDataFrame(list(enumerate(fingerprints.fingerprints([t or "" for t in texts]))), "doc_id long, fingerprint string")
    f = [r.fingerprint for r in prints.orderBy("doc_id").collect()]
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(f)), 2):
        if fingerprints.likeness(f[a], f[b]) >= fingerprints.LEAST:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    of = {(r.print, r.check): (r.class_id, r.n_class) for r in fingerprints.near_classes(prints).collect()}
    got = {r.doc_id: of[r.print, r.check] for r in prints.select("doc_id", *fingerprints.print_keys()).collect()}
    want = [find(i) for i in range(len(f))]
    assert sum(got[i][0] == want[i] for i in range(len(f))) >= 0.98 * len(f)  # a likeness may meet in no band
    assert all(got[i][0] >= want[i] for i in got) and got[len(f) - 1][0] == got[len(f) - 2][0]
    assert find(len(f) - 4) == find(len(f) - 5) and got[len(f) - 4] == got[len(f) - 5]
    blocks = fingerprints.alike_blocks([bytes.fromhex(x) for x in f], [bytes.fromhex(x) for x in f], fingerprints.LEAST)
    assert all(blocks[a, b] == (fingerprints.likeness(f[a], f[b]) >= fingerprints.LEAST) for a in range(0, len(f), 3) for b in range(len(f)))


def test_near_copies_of_the_documents_are_found():
    """Pairs of different texts of the given documents with a Jaccard of 0.8 or more over 4-word shingles: at least 0.9 of them reach
    LEAST, strangers stay far below it."""
    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({t for t in table["text"] if t})
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))})
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    common = Counter(pair for ks in where.values() for pair in itertools.combinations(ks, 2))
    near = [(a, b) for (a, b), k in common.items() if 100 * k >= 80 * len(sets[a] | sets[b])]
    prints = fingerprints.fingerprints(texts)
    found = sum(fingerprints.likeness(prints[a], prints[b]) >= fingerprints.LEAST for a, b in near)
    assert len(near) >= 10 and found >= 0.9 * len(near)
    strangers = [fingerprints.likeness(prints[a], prints[b]) for a, b in zip(range(len(texts) - 1), range(1, len(texts)), strict=True) if not common[a, b]]
    assert np.quantile(strangers, 0.99) < 0.1


def test_fingerprints_of_scattered_edits_and_long_texts(monkeypatch):
    """Edits of every 60th word leave most likeness, and pieces change nothing."""
    rng = np.random.default_rng(11)
    words = [w for w in (sentence(rng, 1) + str(k) for k in range(2500))]
    changed = [("edit" + w if k % 60 == 7 else w) for k, w in enumerate(words)]
    texts = [" ".join(words), " ".join(changed), "x", "xy", "", "né" * 700]
    whole = fingerprints.fingerprints(texts)
    assert fingerprints.likeness(whole[0], whole[1]) > 0.75 and fingerprints.likeness(whole[2], whole[4]) == 0
    for piece in (50, 1000):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        monkeypatch.setattr(fingerprints, "LOT", 100)
        assert fingerprints.fingerprints(texts) == whole


@pytest.mark.parametrize("parts", ["1", "7"])
def test_fingerprints_of_a_hot_id(spark, parts):
    """An id with most of the rows is dealt to several slots; what follows each row is as by sorting."""
    rng = np.random.default_rng(12)
    rows = [(int(i), sentence(rng, 4)) for i in rng.permutation(40)] + [(17, f"copy {k % 3}") for k in range(200)] + [(39, "last again")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    first = {}
    for i, t in rows:
        first[i] = min(first.get(i, t), t, key=lambda x: squeeze.compress(x.encode()))
    want = Counter((i, len(t), hashlib.sha256(fingerprints.edited(t, first[(i + 1) % 40]).encode()).hexdigest()) for i, t in rows)
    assert got == want


def test_fingerprints_without_ids(spark):
    df = spark.createDataFrame([(None, "abc"), (2, "second"), (1, "first"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.fingerprint_and_link(df).collect()}
    assert got[None, 3].edited_sha256 == hashlib.sha256(b"abf").hexdigest() and got[2, 6].edited_sha256 == hashlib.sha256(b"secfir").hexdigest()
    assert got[None, 0].class_id is None and got[1, 5].class_id == 1


def test_pii_base():
    text = "mail a.b@c-d.ef, x@y, p@q.r@s.t 1.2.3.4 999.1.1.1 01.02.03.256, 4111 1111 1111 1111, 4111111111111112, +1 (555) 123-4567 +12"
    got = pii.base_spans(text)
    want = [("email", "a.b@c-d.ef"), ("email", "p@q.r"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert [(k, text[a:b]) for k, a, b in got] == want
    assert pii.base_spans(None) == [] and pii.base_spans("a" * 200_000 + "1" * 100_000) == []


def test_pii_against_plain_patterns():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        s = "".join(rng.choice(list("a1@.+-() 4_"), int(rng.integers(1, 40))))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii._luhn(d)]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(s) == sorted(want, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_terms(spark, docs, empty):
    filler = "common words stand here again and again in every line of this little text"
    texts = [f"{filler} {k} call zanzibarius at +1 (555) 123-4567 for {filler}" for k in "abcde"] + [f"{filler} {k} or mail user{n}@mail.example.com now" for n, k in enumerate("fghij")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "term"] for r in pii.detect(df).collect()}
    assert all("zanzibarius" in found[i] for i in range(5)) and not any(found[i] for i in range(5, 10))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[phone]" in clean[0] and "[term]" in clean[0] and "zanzibarius" not in clean[0] and "[email]" in clean[7]
    assert pii.detect(docs).count() == docs.count() and pii.detect(empty).count() == 0


def test_pii_terms_of_copies_and_far_away(spark):
    rng = np.random.default_rng(6)
    phone, far = "+1 (555) 123-4567", " ".join(["common words"] * 10)
    first, second = f"{sentence(rng, 20)} zanzibarius {phone} {far}", f"{far} {phone} zanzibarius {sentence(rng, 20)} here zanzibarius"
    third = f"{phone} {far} Zanzibarius"
    texts = [*[first] * 50, second, third, f"{far} zanzibarius", *(sentence(rng, 40) for _ in range(30))]
    found = {r.doc_id: [s["start"] for s in r.spans if s["kind"] == "term" and texts[r.doc_id][s["start"] : s["end"]].lower() == "zanzibarius"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = [[m.start() for m in re.finditer("zanzibarius", t.lower())] for t in texts]
    assert all(found[i] == want[i] for i in range(52)) and found[52] == []


@pytest.fixture(scope="module")
def secrets(spark):
    """Some texts with entities, of which most also say token = and a hex string; copies and near copies of them; clean texts."""
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts = []
    for k in range(300):
        w = list(rng.choice(made, 30))
        if k < 24:
            w[5] = f"10.{k}.7.9"
        if 6 <= k < 30:
            w[9:9] = ["token", "=", "".join(rng.choice(list("0123456789abcdef"), 40))]
        texts.append(" ".join(w))
    near = " ".join(rng.choice(made, 30)) + " 99.9.9.9 nearcopies"
    texts += [texts[2]] * 30 + [f"{near} {k} tail" for k in range(20)] + [None, ""]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_classes(rank, min_entities, most, smoothing):
    """Terms of classes by plain counting over the different texts; rank: text -> (copy, check)."""
    n, chosen, words = Counter(), {}, {}
    for t in sorted(rank, key=rank.get):
        n.update({pii.form(w) for w in re.findall(r"[^\W_]+", t)})
        spans = pii.base_spans(t)
        words[t] = {w for w, _, _ in pii.words_outside(t, spans)}
        entities = sorted(pii.entity_of(t, x) for x in spans)
        for kind in {"any", *(e.split(":")[0] for e in entities)} if entities else ():
            chosen.setdefault((kind, min(e for e in entities if kind == "any" or e.startswith(kind + ":"))), t)
    out = set()
    for kind in {k for k, _ in chosen}:
        own = [t for (k, _), t in chosen.items() if k == kind]
        p = len(own) / len(rank)
        for w, both in Counter(w for t in own for w in words[t]).items():
            given = (both + smoothing * p) / (max(n[w], both) + smoothing)
            if both >= min_entities and np.log2(given / p) / -np.log2(p) > most:
                out.add((kind, w))
    return out


def test_pii_terms_of_classes(secrets):
    _, df = secrets
    keyed = df.select("doc_id", "text", *pii.keys())
    found = pii.with_entities(keyed).dropDuplicates(["copy", "check"])
    copies = keyed.groupBy("copy", "check").agg(F.count(F.lit(1)).alias("copies"))
    terms = pii.count_terms(keyed.join(copies, ["copy", "check"]))
    got = {(r.kind, r.term) for r in pii.of_classes(*pii.beside_classes(found), terms, copies.count()).collect()}
    rank = {r.text or "": (r.copy, r.check) for r in keyed.collect()}
    assert got == brute_classes(rank, pii.MIN_ENTITIES, pii.MOST_DISCLOSED, pii.SMOOTHING)
    assert {("any", "token"), ("any", "hex:40")} <= got and not any(w in ("nearcopies", "tail") for _, w in got)


@pytest.mark.parametrize("many", [1 << 20, 0])
def test_pii_marks_terms_of_classes_anywhere(secrets, monkeypatch, many):
    monkeypatch.setattr(pii, "MANY_TERMS", many)
    texts, df = secrets
    got = {r.doc_id: {texts[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "term"} for r in pii.detect(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts[:300]):
        want = {"token", t.split()[11]} if 6 <= i < 30 else set()
        assert want <= got[i] and (want or not got[i] or i < 24)


def test_sanitise_keeps_columns(docs):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_quality_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    z = 2 * np.sin(x[:, 0] * 2) + x[:, 1] + 2 * (x[:, 2] > 0) * (x[:, 3] > 0) - 1
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * z))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    s = model.score(x[3000:])
    assert ((s > 0.5) == (y[3000:] > 0.5)).mean() > 0.85
    assert any({i, j} == {2, 3} for i, j, _ in model.pairs)


def test_classifiers_on_odd_rows(docs, labels, empty):
    half = F.col("doc_id") % 2 == 0
    for made in (quality.classify, toxicity.classify):
        got = made(docs, labels, half).toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}
        assert made(empty, labels, half).count() == 0
        assert made(docs, labels.limit(0), half).count() == docs.count()


def test_toxicity_learns_rare_words(spark):
    rng = np.random.default_rng(1)
    rows, labs = [], []
    for i in range(1200):
        w = list(rng.choice(WORDS, 40))
        toxic = i % 4 == 0
        if toxic:
            w[int(rng.integers(40))] = "grumbl" + rng.choice(["ok", "est", "ing", "er"])
        rows.append((i, " ".join(w) + f" {i}"))
        labs.append((i, int(toxic)))
    held = F.col("doc_id") % 5 == 0
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labs, "doc_id long, toxic int"), held).where("held_out").toPandas()
    assert (got["predicted"] == (got["doc_id"] % 4 == 0)).mean() > 0.95


@pytest.mark.parametrize("contexts", [1 << 19, 64])
def test_toxicity_tables_grow(spark, monkeypatch, contexts):
    # Many ordinary n-grams against a few rare toxic ones: none is dropped, however few contexts go to every task.
    monkeypatch.setattr(toxicity, "TABLE_CONTEXTS", contexts)
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("abcdefghiklmnoprstuv"), int(rng.integers(4, 9)))) for _ in range(2000)]
    rows = [(i, " ".join([*rng.choice(made, 40), *(["xyzzyx"] if i % 20 == 0 else [])])) for i in range(800)]
    labs = [(i, int(i % 20 == 0)) for i in range(800)]
    held = F.col("doc_id") % 3 == 0
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labs, "doc_id long, toxic int"), held).where("held_out").toPandas()
    assert (got["predicted"] == (got["doc_id"] % 20 == 0)).all()


def brute_ratios(counts, order=6, discounts=(1.0, 1.5, 2.0), shared=0.75):
    """Log-ratio of a character after its context, by plain counting over (word, toxic, ordinary)."""
    top, per = Counter(), {c: defaultdict(Counter) for c in "to"}
    for word, t, o in counts:
        m = f"^{word}$"
        for end in range(2, len(m) + 1):
            g = m[max(0, end - order) : end]
            top[g] += t + o
            per["t"][g[:-1]][g[-1]] += t
            per["o"][g[:-1]][g[-1]] += o
    before = defaultdict(set)
    for g in top:
        for k in range(2, len(g) + 1):
            before[g[-k + 1 :]].add(g[-k])
    kinds = defaultdict(dict)
    for g, x in before.items():
        kinds[g[:-1]][g[-1]] = len(x)

    def backoff(h, c):
        """Shared probability of c after an ending of a context, from the longest seen one down."""
        q = 1e-6
        for k in range(len(h) + 1):
            own = kinds.get(h[len(h) - k :], {})
            if c in own:
                total = sum(own.values())
                q = max(own[c] - shared, 0) / total + shared * len(own) / total * q
        return q

    off = lambda n: 0.0 if n <= 0 else discounts[min(n, 3) - 1]

    def p(c, h, k):
        own = per[c][h]
        total = sum(own.values())
        share = sum(map(off, own.values())) / total if total else 1.0
        return (own[k] - off(own[k])) / max(total, 1) + share * backoff(h[1:], k), share

    def ratio(h, k):
        if h not in per["t"]:
            return 0.0
        (a, sa), (b, sb) = p("t", h, k), p("o", h, k)
        return np.log(a / b) if k in per["t"][h] else np.log(sa / sb)

    return ratio


@pytest.mark.parametrize("contexts", [1 << 19, 20])
def test_toxicity_against_plain_sums(spark, monkeypatch, contexts):
    monkeypatch.setattr(toxicity, "BLOCK_ITEMS", 50)
    monkeypatch.setattr(toxicity, "TABLE_CONTEXTS", contexts)
    rng = np.random.default_rng(4)
    made = [(w, *map(int, rng.integers(0, 5, 4))) for w in WORDS]
    table = toxicity.by_context(spark.createDataFrame(made, "word string, toxic long, ordinary long, toxic_apart long, ordinary_apart long"))
    texts = [sentence(rng, int(n)) for n in rng.integers(0, 30, 25)] + ["", None, "quicker foxes", "zz", "the the"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    for which, seen in (("ratio", [(w, t + ta, o + oa) for w, t, o, ta, oa in made]),):
        ratio = brute_ratios(seen)
        got = toxicity.measured(rows, table, which).toPandas()
        assert len(got) == len(texts)
        for row in got.itertuples():
            v = [sum(ratio(g[:-1], g[-1]) for g in toxicity.grams_of(w)) for w in toxicity.words_of(texts[int(row.id)])]
            want = (np.mean(v), max(v), max(sum(v[i : i + 3]) for i in range(max(1, len(v) - 2)))) if v else (0, 0, 0)
            assert np.allclose((row.a, row.b, row.c), want)


def test_measures_of_texts():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 5, 0, 40, 3, 0])
    v = np.round(rng.normal(size=sizes.sum()), 1)
    got = toxicity.measures(v, sizes)
    for row, end, n in zip(got, np.cumsum(sizes), sizes, strict=True):
        u = v[end - n : end]
        want = [u.mean(), u.max(), max(u[i : i + 3].sum() for i in range(max(1, n - 2))), np.sort(u)[-2] if n > 1 else 0, np.log(np.exp(u).mean()), np.log1p(n)] if n else [0] * 6
        assert np.allclose(row, want)


def test_discounts_estimated_from_counts_of_counts():
    assert toxicity.discounts_of([0, 5, 5, 5]) == toxicity.DISCOUNTS
    y = 100 / (100 + 2 * 40)
    assert np.allclose(toxicity.discounts_of([100, 40, 20, 10]), (1 - 2 * y * 40 / 100, 2 - 3 * y * 20 / 40, 3 - 4 * y * 10 / 20))


def test_toxicity_of_held_out_documents(spark):
    """The given documents: at 0.7 most held-out toxic ones are found and few others; numerals alone are no evidence."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(10_000_001, "½ ² Ⅷ"), (10_000_002, None), (10_000_003, "")], "doc_id long, text string")
    got = toxicity.classify(docs.select("doc_id", "text").unionByName(odd), labels, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).join(labels.select("doc_id", "toxic"), "doc_id", "left").toPandas()
    assert got[got["doc_id"] > 10_000_000]["score"].nunique() == 1
    held = got[got["held_out"] & got["toxic"].notna()]
    toxic, called = held["toxic"] == 1, held["predicted"] == 1
    assert (toxic & called).sum() >= 0.75 * toxic.sum() and (toxic & called).sum() >= 0.95 * called.sum()


def brute_forward(word, p, index):
    """Sums over all segmentations of word, in logarithms."""
    total = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for n in range(1, end + 1):
            k = index.get(word[end - n : end])
            if k is not None:
                total[end] = np.logaddexp(total[end], total[end - n] + np.log(p[k]))
        total[end] = np.logaddexp(total[end], total[end - 1] + np.log(langid.UNKNOWN))
    return total[-1]


def test_forward_sums_all_segmentations():
    names = sorted({"▁", "▁a", "a", "ab", "b", "▁ab", "ba", "c", "abc", "x" * 12})
    pieces = langid.Pieces(names)
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(names)), 2).T
    words = ["a", "ab", "abcab", "zzz", "bab" * 8, "x" * 13, "abc" * 60, "zq" * 200, "ab" * 18, "x" * 36, "x" * 37]
    model = langid.Model(["en", "de"], np.zeros(2), p, pieces)
    index = {x: k for k, x in enumerate(names)}
    want = [[brute_forward("▁" + w, p[:, lang], index) for lang in range(2)] for w in words]
    assert np.allclose(model.logs(words), want)
    # Expected counts are derivatives of the log-likelihood by the log-probabilities.
    counts = np.arange(1.0, len(words) + 1)
    got = langid.expected(words, counts, pieces, p[:, 0])
    for k in range(len(names)):
        up, down = p.copy(), p.copy()
        up[k], down[k] = up[k] * 1.0001, down[k] / 1.0001
        slope = sum(c * (a - b) for c, a, b in zip(counts, langid.Model(["en", "de"], np.zeros(2), up, pieces).logs(words)[:, 0], langid.Model(["en", "de"], np.zeros(2), down, pieces).logs(words)[:, 0], strict=True)) / (2 * np.log(1.0001))
        assert np.isclose(got[k], slope, rtol=1e-4, atol=1e-6)


def test_no_letters():
    assert langid.words_of("½ ² ⅔ 12 _ …") == [] and langid.words_of("a½b") == ["a", "b"]


def test_language_id(spark, docs, empty):
    rng = np.random.default_rng(2)
    lists = {"en": WORDS, "de": "der die und nicht schnell braune fuchs springt straße über während faule hund".split(), "es": "el la los rápido zorro marrón salta sobre perro mientras siete magos hierven".split()}
    rows = [(i, " ".join(rng.choice(lists[lang], 30)), lang) for i in range(300) for lang in [("en", "de", "es")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.col("doc_id") % 4 == 2).join(df, "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).all()
    odd = langid.identify(docs, F.col("doc_id") % 4 == 2).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(odd) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in odd.itertuples())
    assert langid.identify(empty, F.col("doc_id") % 4 == 2).count() == 0


def test_labelled_ids_are_bounded(labels):
    from trajgraph.llm.common import labelled_ids

    got = labelled_ids(labels, "quality", F.lit(True), 10).toPandas()
    assert len(got) == 10 and isinstance(got, pd.DataFrame)


def test_langid_takes_three_steps():
    assert langid.STEPS == 3


def drawn_by_hand(doc_id, leaves):
    """The shard of an id by the definition: at each level the child with the least draw among those of the branch reached."""
    weights = Counter()
    for x in leaves:
        for path in ((x.region,), (x.region, x.rack), (x.region, x.rack, x.shard)):
            weights[path] += x.weight
    at = ()
    for depth in (1, 2, 3):

        def least(path):
            digits = hashlib.md5(f"{'' if doc_id is None else doc_id}/{'.'.join(map(str, path))}".encode()).hexdigest()[:13]
            return -np.log((int(digits, 16) + 0.5) / 2**52) / weights[path]

        at = min((p for p in weights if len(p) == depth and p[:-1] == at), key=least)
    return at[-1]


def test_sharding_by_naive_draws(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(300), None, -7, 2**60]], "doc_id long")
    for leaves in (sharding.tree(16), sharding.tree(19), [sharding.Shard(0, 0, 0, 3.0), sharding.Shard(0, 1, 1, 0.5), sharding.Shard(1, 0, 2, 1.0)]):
        got = sharding.descend(ids, leaves).collect()
        assert all(r.shard == drawn_by_hand(r.doc_id, leaves) for r in got)


def test_weight_changes_move_rows_within_their_subtree(spark):
    """Less weight for a shard is less for its rack and region: rows leave that region for others, that rack for its siblings, and
    within the rack the shard itself; nothing else moves. More weight: the same the other way round."""
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    before = sharding.tree(16)
    changed, of = before[5], {x.shard: x for x in before}
    for factor in (0.25, 4.0):
        after = [sharding.Shard(x.region, x.rack, x.shard, x.weight * factor if x is changed else x.weight) for x in before]
        rows = sharding.descend(sharding.descend(ids, before), after, "new").select("shard", "new").collect()
        moved = [(of[r.shard], of[r.new]) for r in rows if r.shard != r.new]
        assert len(moved) > 50
        for out, into in moved:
            own, other = (out, into) if factor < 1 else (into, out)  # the side whose weight is the lesser part now
            assert own.region == changed.region
            assert other.region != own.region or (own.rack == changed.rack and (other.rack != own.rack or own == changed))
        counts = [sum(r[c] == changed.shard for r in rows) for c in ("shard", "new")]
        assert counts[1] < 0.6 * counts[0] if factor < 1 else counts[1] > 1.6 * counts[0]
