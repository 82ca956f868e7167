"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table for each binned feature, then one for each of the pairs of features
that explain most of what is left. A score is the logistic of the sum of table entries, looked up for whole batches at once.
The model is fitted on a bounded sample of labelled rows (`max_rows`); every document is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajgraph.llm.common import fold, labelled_ids, read

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "word_bytes", "upper", "digits", "white", "lines", "stops", "other_signs", "high_bytes", "distinct_words", "top_word",
    "same_neighbours", "distinct_triples", "distinct_lines", "line_words", "short_words", "long_words", "byte_entropy", "upper_words", "sign_ends",
)
_UPPER, _DIGIT, _WHITE, _LINE, _STOP, _OTHER, _HIGH, _LOWER = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
for _set, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\r\x0b\x0c", _WHITE), (b"\n", _LINE), (b".,;:?!'\"-()", _STOP), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (bytes(range(128, 256)), _HIGH)):
    _CLASS[list(_set)] = _k
_SIGNS = frozenset(b"!$%&*#|=<>@^~+_/\\")


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one whole text; a null or empty text is all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, nw = len(raw), len(words)
    if not nw:
        return [0.0] * len(FEATURES)
    byte_counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=byte_counts, minlength=8) / n
    p = byte_counts[byte_counts > 0] / n
    lower = raw.lower().split()
    kinds = Counter(lower)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=nw)
    return [
        math.log1p(n), (n - share[_WHITE] * n) / nw, share[_UPPER], share[_DIGIT], share[_WHITE], share[_LINE], share[_STOP], share[_OTHER], share[_HIGH],
        len(kinds) / math.sqrt(nw), kinds.most_common(1)[0][1] / nw, sum(map(eq, lower, lower[1:])) / nw, len(set(zip(lower, lower[1:], lower[2:], strict=False))) / max(1, nw - 2),
        len(set(lines)) / len(lines), nw / len(lines), float((lengths <= 3).mean()), float((lengths > 20).mean()), float(-(p * np.log2(p)).sum()),
        sum(map(bytes.isupper, words)) / nw, sum(w[-1] in _SIGNS for w in words) / nw,
    ]


@dataclass
class Additive:
    """Bin edges and a table for each feature, tables for pairs of coarse bins, and an intercept."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of neighbouring bins and its gain over none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of a tree of up to three leaves over ordered bins."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max((( *_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0.0, 0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted({*cuts, best[2] + best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid of bins: gain, and the step of its four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = 0.0, np.zeros_like(g)
    gain = np.zeros(g.shape)
    parts = []
    for c in (cg, ch):
        top, left, all_ = c[:, -1:], c[-1:, :], c[-1, -1]
        parts.append((c, top - c, left - c, all_ - top - left + c))
    for pg, ph in zip(*parts, strict=True):
        gain += _gain(pg, np.maximum(ph, 0))
    gain = gain[:-1, :-1]
    if gain.size:
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        best = float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1]))
        for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 48, n_pairs: int = 6) -> Additive:
    """Cyclic boosting of all features, then of the best pairs. Without rows of both labels: the prior alone."""
    if not len(y) or y.min() == y.max():
        return Additive(0.0 if not len(y) else 3.0 * (2 * float(y[0] >= 0.5) - 1))
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Additive(math.log(prior / (1 - prior)))
    quantiles = lambda j, k: np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quantiles(j, bins) for j in range(x.shape[1])]
    model.coarse = [quantiles(j, 8) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for b, table in zip(binned, model.tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def grids(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, b), cell = shape(i, j), rough[i] * (len(model.coarse[j]) + 1) + rough[j]
        return np.bincount(cell, y - p, a * b).reshape(a, b), np.bincount(cell, p * (1 - p), a * b).reshape(a, b)

    p = 1 / (1 + np.exp(-total))
    ranked = sorted(((_quadrants(*grids(i, j, p))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros(shape(i, j))) for gain, i, j in ranked if gain > 0]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*grids(i, j, 1 / (1 + np.exp(-total))))[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, keep=None, max_rows: int = MAX_ROWS) -> Additive:
    """Fits on the documents of at most max_rows labelled ids for which keep holds (all by default).

    The ids are few by that bound and so are broadcast; the driver gets their numbers, never a text. Of rows of one id with
    different texts one counts.
    """
    sample = labelled_ids(labels, "quality", F.lit(True) if keep is None else keep, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"].astype(str), "x": [features(t) for t in pdf["text"]], "y": pdf["y"]})

    got = rows.mapInPandas(measure, "id string, x array<float>, y double").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("id").toPandas()
    return fit(np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), (got["y"].to_numpy() >= 0.5).astype(float))


def with_scores(docs: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """docs with a score of each whole text; a column of that name is replaced."""
    kept = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]], dtype=np.float32).astype(np.float64).reshape(-1, len(FEATURES))
            yield pdf.assign(**{name: held.value.score(x)})

    return kept.mapInPandas(score, kept.select("*", F.lit(0.0).alias(name)).schema)


def classify(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from rows that aren't held out.

    held_out: a condition on doc_id. Null and empty texts get the score of a text of no words; a null id is held out; repeated
    rows score alike; without labels of both kinds scores are the prior; an empty table gives no rows. Other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(True))
    model = train(docs, labels, ~held, max_rows)
    out = with_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, columns as they were.

    Null and empty texts are judged as texts of no words; rows without an id are judged like others; repeated rows are judged alike;
    without labels of both kinds the prior decides for all; columns may have any names; an empty table gives no rows.
    """
    model = train(docs, labels, ~F.coalesce(held_out, F.lit(True)), max_rows)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return with_scores(docs.select(own, F.col("text").alias("text")), model).where(F.col("score") >= threshold).select("row.*")


def op1_quality(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)
