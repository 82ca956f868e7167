"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all runs of words of the benchmark items. A document streams through it word by word; the state and its
length give the longest run that ends there and stands in some item. Where that run covers a window (13 words of an item, or a
whole shorter item), the words of the window are hit. Documents with too large a share of hit words are contaminated: they are
dropped, or the hit stretches are cut out of them.

Items are dealt to blocks of about a fixed number of words (long ones in overlapping parts, so that no block can be larger), and
a Spark task builds the automaton of a block. Documents pass through AT_ONCE automata at a time; with more blocks than that
they pass again, and only what was hit is kept of a pass.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajgraph.llm.common import read, stored

WINDOW = 13
#: Item words in one automaton, about (some 100 MB of memory), and how many automata a pass holds.
BLOCK_WORDS, AT_ONCE = 200_000, 2
#: A document is contaminated if at least this part of its words is hit.
COVERAGE = 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased; digits, letters and all beyond ASCII make words."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Generalised suffix automaton over word ids, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        ends: list[list[int]] = [[]]
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), owners, ends)
                owners[last].add(k)
            if 0 < len(words) < window:
                ends[last].append(k)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        # up[s]: the nearest state on the suffix chain of s, s included, in which a window ends.
        self.windows: list[tuple[int, list[int]] | None] = [None] * len(self.next)
        self.up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[self.link[s]] < window <= self.length[s]:
                self.windows[s] = (window, sorted(owners[s]))
            elif ends[s]:
                self.windows[s] = (self.length[s], sorted(ends[s]))
            self.up[s] = s if self.windows[s] else self.up[self.link[s]]

    def _extend(self, last: int, c: int, owners: list[set[int]], ends: list[list[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            new = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            owners.append(set())
            ends.append([])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            link[q] = new
            return new

        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        owners.append(set())
        ends.append([])
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of hit words [start, end), merged and ascending, and the items whose windows occur."""
        nxt, link, length, up, windows = self.next, self.link, self.length, self.up, self.windows
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        state = matched = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = matched = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            s = up[state]
            widest = 0
            while s:
                n, items = windows[s]
                if n <= matched:
                    widest = max(widest, n)
                    if s in seen:
                        break
                    seen.add(s)
                    found.update(items)
                s = up[link[s]]
            if widest:
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def parts_of(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """(item, start, words): the words of the items (ids as strings), those of long ones in parts that overlap by window - 1 words.

    Repeated rows of an item are one item; items of no words have no window.
    """
    size = max(window, most // 8)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = words_of(text)
                if words:
                    rows += [(item, a, words[a : a + size + window - 1]) for a in range(0, max(1, len(words) - window + 1), size)]
            yield pd.DataFrame(rows, columns=["item", "start", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull()).distinct()
    return items.mapInPandas(cut, "item string, start long, words array<binary>")


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """(block, automaton): stored, the automaton pickled; each is built by one task."""
    parts = stored(parts_of(benchmark, window, most))
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Automaton([(None if pd.isna(i) else i, list(w)) for i, w in zip(pdf["item"], pdf["words"], strict=True)], window)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "automaton": [pickle.dumps(own)]})

    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item", "start"), F.lit(-(-total // most) or 1)).cast("int"))
    return stored(dealt.groupBy("block").applyInPandas(build, "block int, automaton binary"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Held:
    """The automata of a pass; a Python worker unpickles them once."""

    _loaded: dict[str, list[Automaton]] = {}

    def __init__(self, pickled: list[bytes]):
        self.pickled, self.key = pickled, uuid.uuid4().hex

    def get(self) -> list[Automaton]:
        if self.key not in Held._loaded:
            Held._loaded.clear()
            Held._loaded[self.key] = [pickle.loads(bytes(x)) for x in self.pickled]
        return Held._loaded[self.key]


_COLUMNS = {"_n": "int", "_spans": "array<array<int>>", "_items": "array<string>"}


def scanned(docs: DataFrame, held) -> DataFrame:
    """docs with _n (words), _spans (hit stretches of words) and _items (ids of items that occur) by the automata of one pass."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ns, spans, items = [], [], []
            for text in pdf["text"]:
                words = words_of(text)
                own, names = [], set()
                for a in held.value.get():
                    more, found = a.scan(words)
                    own = merged(own + more) if own else more
                    names.update(a.names[i] for i in found)
                ns.append(len(words))
                spans.append([list(x) for x in own])
                items.append(sorted(names - {None}))
            yield pdf.assign(_n=np.array(ns, dtype=np.int32), _spans=spans, _items=items)

    shape = docs.withColumns({c: F.lit(None).cast(t) for c, t in _COLUMNS.items()}).schema
    return docs.mapInPandas(scan, shape)


def hit_columns(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS, at_once: int = AT_ONCE) -> DataFrame:
    """docs with _n (words), _spans (hit stretches [start, end) in words, ascending) and _items (ids of items that occur).

    An item without an id hits words, but isn't among the items.
    """
    sc = docs.sparkSession.sparkContext
    made = automata(benchmark, window, most)
    numbers = sorted(r.block for r in made.select("block").collect())
    passes = [numbers[k : k + at_once] for k in range(0, len(numbers), at_once)] or [[]]

    def load(own: list[int]):
        return sc.broadcast(Held([r.automaton for r in made.where(F.col("block").isin(own)).select("automaton").toLocalIterator()] if own else []))

    if len(passes) == 1:
        return scanned(docs, load(passes[0]))
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    hits = None
    for own in passes:
        held = load(own)
        got = stored(scanned(docs.select("_row", "text"), held).drop("text").where((F.size("_spans") > 0) | F.lit(own is passes[0])))
        held.unpersist()
        hits = got if hits is None else hits.unionByName(got)
    one = hits.groupBy("_row").agg(F.max("_n").alias("_n"), F.array_sort(F.flatten(F.collect_list("_spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    # Ascending stretches: one that begins inside the last joins it.
    grow = lambda out, x: F.when((F.size(out) > 0) & (x[0] <= F.element_at(out, -1)[1]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], x[1]))))).otherwise(F.concat(out, F.array(x)))
    one = one.withColumn("_spans", F.aggregate("_spans", F.array().cast("array<array<int>>"), grow))
    return docs.join(one, "_row").drop("_row")


def contaminated(n: str = "_n", spans: str = "_spans"):
    """Hit words, and whether there are any and they are at least one in COVERAGE."""
    hit = F.aggregate(spans, F.lit(0), lambda a, x: a + x[1] - x[0])
    return hit, (hit > 0) & (COVERAGE * hit.cast("long") >= F.col(n))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit stretches (in words) of every document.

    Null and empty texts have no words and are clean; repeated rows are judged each; items without text or words hit nothing, one
    without an id hits words and isn't counted; an empty benchmark hits nothing; an empty table gives no rows. Other columns of
    docs are not read.
    """
    hit, bad = contaminated()
    out = hit_columns(docs.select("doc_id", "text"), benchmark, window)
    return out.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        bad.alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def _with_rows(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """row (a struct of all columns of docs), text and the columns of hit_columns: the whole row goes along, so no join is needed."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return hit_columns(docs.select(own, F.col("text").alias("text")), benchmark, window)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, columns as they were (a null id or text included; any names of columns).

    An empty table gives no rows, an empty benchmark drops none; repeated rows are judged each.
    """
    return _with_rows(docs, benchmark, window).where(~contaminated()[1]).select("row.*")


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without the stretches of words, from the first letter of the first to the last one of the last."""
    out = []
    for text, own in zip(texts, spans, strict=True):
        if text is None or own is None or not len(own):
            out.append(text)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in _WORD.finditer(raw.lower())]
        kept, end = [], 0
        for a, b in own:
            kept.append(raw[end : places[a][0]])
            end = places[b - 1][1]
        out.append(b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, columns as they were, with the hit stretches cut out of the texts of contaminated ones.

    Null texts stay null; n_chars and other columns are not changed; an empty table gives no rows.
    """
    out = _with_rows(docs, benchmark, window)
    spans = F.when(contaminated()[1], F.col("_spans"))
    return out.withColumn("_text", without("text", spans)).select(*[F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op10_decontamination(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")
