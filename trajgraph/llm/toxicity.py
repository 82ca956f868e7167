"""Toxicity: class-conditional Kneser-Ney models over the characters of words.

For each class the probability of a character after its context (up to ORDER - 1 characters of the word) is the discounted
count in the class plus a share of one backoff model, whose continuation counts both classes share, so an expression that is rare
in both moves no score. The counts come from all labelled documents of the learning folds. What scoring needs of them is the
log-ratio toxic to ordinary of each counted n-gram and of each context; these are tables that grow with the corpus.

The most frequent contexts, with all n-grams after them, go to every task in a table of a fixed size, and a document whose words
meet no other context is scored where it is read. Words with other contexts are summed by joins: documents that have such words
are kept as blocks of word numbers, and only those words, in blocks of n-gram numbers of their own, meet the ratios in one join and
their documents in another. Both ways add up the same ratios.

A document is judged by its length-normalised log-likelihood ratio, by the largest ones of its words and of stretches of three words,
and by its length. A logistic curve over these gives the score; it is fitted on labelled rows by counts that leave these rows out.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajgraph.llm.common import fold, read, splitmix, stored
from trajgraph.llm.langid import words_of

ORDER = 6
#: Taken off counts of 1, of 2 and of more in a class where they can't be estimated, and off continuation counts.
DISCOUNTS = (1.0, 1.5, 2.0)
SHARED_DISCOUNT = 0.75
#: Words of documents, or n-grams of words, in a block (a longer text is a block of its own).
BLOCK_ITEMS = 2_000_000
#: Contexts and n-grams in the table that goes to every task (some 32 MB with room for both); the others are joined.
TABLE_CONTEXTS, TABLE_ENTRIES = 1 << 19, 1 << 20
#: Most labelled rows that the final curve is fitted on; the counts take all.
MAX_ROWS = 20_000
THRESHOLD = 0.7
#: Counts held in a Python worker before they are sent on.
HELD_WORDS = 300_000


def count_words(texts: DataFrame) -> DataFrame:
    """(text, toxic boolean, apart boolean) -> (word, toxic, ordinary, toxic_apart, ordinary_apart): counts over all texts, summed
    in each task before the shuffle.
    """
    names = ("ordinary", "toxic", "ordinary_apart", "toxic_apart")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [Counter() for _ in names]

        def flush() -> pd.DataFrame:
            words = list(set().union(*held))
            out = pd.DataFrame({"word": np.array(words, dtype=object)} | {n: np.array([c[w] for w in words], dtype=np.int64) for n, c in zip(names, held, strict=True)})
            for c in held:
                c.clear()
            return out

        for pdf in batches:
            for text, toxic, apart in zip(pdf["text"], pdf["toxic"], pdf["apart"], strict=True):
                held[bool(toxic) + 2 * bool(apart)].update(words_of(text))
                if sum(map(len, held)) > HELD_WORDS:
                    yield flush()
        yield flush()

    counts = texts.mapInPandas(count, "word string, " + ", ".join(f"{n} long" for n in names))
    return counts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def discounts_of(kinds: list[int]) -> tuple[float, float, float]:
    """What to take off counts of 1, of 2 and of more, from the numbers of n-grams seen once, twice, three and four times (the
    estimate of modified Kneser-Ney smoothing); DISCOUNTS where too few kinds were seen."""
    one, two, three, four = kinds
    if not (one and two and three):
        return DISCOUNTS
    y = one / (one + 2 * two)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.0, k)) for k, a, b in ((1, one, two), (2, two, three), (3, three, four)))


def ratios(words: DataFrame, order: int = ORDER, discounts: tuple[float, float, float] | None = DISCOUNTS, shared: float = SHARED_DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """Word counts -> (gram, ratio, rest) and (context, weight, ratio, rest): natural logarithms, toxic to ordinary.

    ratio is of all counts, rest of those that aren't apart; what both classes share is of all. A word is read as ^word$; an n-gram
    is a character with up to order - 1 characters before it. discounts: None for those that discounts_of gives for each class.
    """
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    counts = [(F.col("toxic") + F.col("toxic_apart")).alias("t"), (F.col("ordinary") + F.col("ordinary_apart")).alias("o"), F.col("toxic").alias("tr"), F.col("ordinary").alias("or")]
    names = ("t", "o", "tr", "or")
    places = words.select(*counts, marked.alias("m"), F.explode(F.sequence(F.lit(2), F.length(marked))).alias("end"))
    begin = F.greatest(F.col("end") - (order - 1), F.lit(1))
    top = places.groupBy(F.col("m").substr(begin, F.col("end") - begin + 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in names))
    top = stored(top)
    given = dict.fromkeys(names, discounts)
    if discounts is None:
        kinds = top.agg(*(F.sum((F.col(c) == k).cast("long")) for c in "to" for k in range(1, 5))).first()
        of = {c: discounts_of([x or 0 for x in kinds[4 * i : 4 * i + 4]]) for i, c in enumerate("to")}
        given = {c: of[c[0]] for c in names}
    # Continuation counts, shared: how many different characters stand before a shorter n-gram.
    n = F.length("gram")
    ends = top.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.col("gram").substr(n - k + 1, k))).alias("g")).distinct()
    shorter = ends.where(F.length("g") > 1).groupBy(F.expr("substr(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("before"))
    histories = shorter.groupBy(F.expr("substr(g, 1, length(g) - 1)").alias("h")).agg(F.sum("before").alias("sum"), F.count(F.lit(1)).alias("kinds"))
    own = shorter.withColumn("h", F.expr("substr(g, 1, length(g) - 1)")).join(histories, "h").select("g", (F.greatest(F.col("before") - shared, F.lit(0.0)) / F.col("sum")).alias("a"), (shared * F.col("kinds") / F.col("sum")).alias("b"))
    own = stored(own)
    # The backoff probability of a gram: its endings from the shortest to the longest, folded.
    tails = top.select("gram", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k")).withColumn("g", F.expr("substr(gram, length(gram) - k + 1, k)"))
    chain = tails.join(own, "g").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("chain"))
    backoff = chain.select("gram", F.aggregate("chain", F.lit(1e-6), lambda p, x: x["a"] + x["b"] * p).alias("q"))
    history = F.expr("substr(gram, 1, length(gram) - 1)")
    off = lambda c: F.when(F.col(c) <= 0, 0.0).when(F.col(c) == 1, given[c][0]).when(F.col(c) == 2, given[c][1]).otherwise(given[c][2])
    contexts = top.withColumn("h", history).groupBy("h").agg(*(x for c in names for x in (F.sum(c).alias(f"{c}_sum"), F.sum(off(c)).alias(f"{c}_off"))))
    share = lambda c: F.when(F.col(f"{c}_sum") > 0, F.col(f"{c}_off") / F.greatest(F.col(f"{c}_sum"), F.lit(1))).otherwise(F.lit(1.0))
    weight = F.col("t_sum") + F.col("o_sum")
    contexts = stored(contexts.select("h", weight.alias("weight"), *(f"{c}_sum" for c in names), *(share(c).alias(f"{c}_share") for c in names)))
    p = lambda c: (F.col(c) - off(c)) / F.greatest(F.col(f"{c}_sum"), F.lit(1)) + F.col(f"{c}_share") * F.coalesce("q", F.lit(1e-6))
    grams = top.withColumn("h", history).join(contexts, "h").join(backoff, "gram", "left")
    grams = grams.select("gram", F.log(p("t") / p("o")).alias("ratio"), F.log(p("tr") / p("or")).alias("rest"))
    return grams, contexts.select(F.col("h").alias("context"), "weight", F.log(F.col("t_share") / F.col("o_share")).alias("ratio"), F.log(F.col("tr_share") / F.col("or_share")).alias("rest"))


def by_context(words: DataFrame, discounts: tuple[float, float, float] | None = DISCOUNTS) -> DataFrame:
    """Word counts -> (context, weight, backed, after): how often a context stands, its ratio and rest, and those of the characters
    counted after it.
    """
    grams, contexts = ratios(words, discounts=discounts)
    both = F.struct("ratio", "rest")
    last = F.struct(F.expr("substr(gram, length(gram), 1)").alias("k"), both.alias("v"))
    after = grams.groupBy(F.expr("substr(gram, 1, length(gram) - 1)").alias("context")).agg(F.map_from_entries(F.collect_list(last)).alias("after"))
    return stored(contexts.select("context", "weight", both.alias("backed")).join(after, "context", "left"))


def grams_of(word: str) -> list[str]:
    """The n-gram of each character of ^word$ but the first."""
    m = f"^{word}$"
    return [m[max(0, end - ORDER) : end] for end in range(2, len(m) + 1)]


class Table:
    """Ratios of some contexts and of all n-grams after them, in a hash table; finds those of all words of a batch at once."""

    def __init__(self, rows: Iterator[tuple[str, float, dict[str, float] | None]]):
        """rows: (context, its ratio, the ratios of the characters after it)."""
        self.whole = True  # there are no other contexts
        texts, values, found = [], array("d"), []

        def take() -> None:
            """Keys of the texts, by lots."""
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            codes = self._codes("".join(texts))
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found.append(self._join(self._before(codes, place), codes)[np.cumsum(sizes) - 1])
            texts.clear()

        for context, backed, after in rows:
            texts.append(context + "\n")  # no character of a word: keeps contexts and n-grams apart
            values.append(backed)
            for k, v in (after or {}).items():
                texts.append(context + k)
                values.append(v)
            if len(texts) > 50_000:
                take()
        take()
        keys = np.concatenate(found)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        value = np.frombuffer(values)
        while len(rest):  # linear probing: of those that meet in a free slot the first one takes it
            _, first = np.unique(slot[rest], return_index=True)
            first = first[self.keys[slot[rest[first]]] == 0]
            won = rest[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], value[won]
            rest = np.delete(rest, first)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.end = self._codes("\n")[0]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return splitmix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64))

    @staticmethod
    def _before(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each character a sum of those before it in its word, ORDER - 1 at most."""
        out = np.zeros(len(codes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(1, min(ORDER, len(codes))):
                out[j:] += np.where(place[j:] >= j, codes[:-j] * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)), np.uint64(0))
        return out

    @staticmethod
    def _join(before: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.maximum(splitmix(before + code), np.uint64(1))  # 0 is a free slot

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys and whether they are there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        there = held == keys
        out = np.where(there, self.values[slot], 0.0)
        rest = np.flatnonzero(~there & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            same = held == keys[rest]
            out[rest[same]], there[rest[same]] = self.values[slot[rest[same]]], True
            rest = rest[~same & (held != 0)]
        return out, there

    def words(self, words: list[str]) -> np.ndarray:
        """The sum of the ratios of each word; nan where a context isn't in the table that may be elsewhere."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 2
            codes = self._codes("^" + "$^".join(part) + "$")
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(codes)) - np.repeat(begin, sizes)
            before = self._before(codes, place)
            value, there = self.find(self._join(before, codes))
            rest = np.flatnonzero(~there & (place > 0))
            value[rest], known = self.find(self._join(before[rest], np.full(len(rest), self.end)))
            if not self.whole:
                value[rest[~known]] = np.nan
            value[begin] = 0.0
            out[a : a + 20_000] = np.add.reduceat(value, begin)
        return out


def frequent(table: DataFrame, which: str) -> Table:
    """The most frequent contexts of the table; which: ratio or rest."""
    slim = table.select("context", F.col(f"backed.{which}").alias("backed"), F.transform_values("after", lambda _, v: v[which]).alias("after"), "weight")
    more = False

    def rows() -> Iterator[tuple[str, float, dict[str, float] | None]]:
        nonlocal more
        entries = 0
        for n, r in enumerate(slim.orderBy(F.col("weight").desc(), "context").limit(TABLE_CONTEXTS + 1).drop("weight").toLocalIterator()):
            entries += 1 + len(r.after or ())
            if n == TABLE_CONTEXTS or entries > TABLE_ENTRIES:
                more = True
                return
            yield r.context, r.backed, r.after

    out = Table(rows())
    out.whole = not more
    return out


PACKED = "block long, ids binary, which binary, lengths binary, numbers binary, known binary, items array<string>"


class Block:
    """Rows with the numbers of their items; items whose value is known on the spot need no join."""

    def __init__(self) -> None:
        self.ids, self.which, self.lengths, self.numbers = [], array("i"), array("i"), array("i")
        self.texts: dict[str | None, int] = {}
        self.at: dict[str, int] = {}
        self.known = array("d")

    def add(self, i: str, text: str | None, items: list[str], values: np.ndarray | None) -> None:
        if text not in self.texts:
            self.texts[text] = len(self.texts)
            self.lengths.append(len(items))
            for k, x in enumerate(items):
                if x not in self.at:
                    self.at[x] = len(self.at)
                    self.known.append(float("nan") if values is None else values[k])
                self.numbers.append(self.at[x])
        self.ids.append(i)
        self.which.append(self.texts[text])

    def full(self, more: int) -> bool:
        return bool(self.ids) and max(len(self.ids), len(self.numbers) + more) > BLOCK_ITEMS

    def packed(self) -> dict:
        """A row of the columns of PACKED; items with a known value have no name."""
        arrays = {"ids": json.dumps(self.ids).encode(), **{n: getattr(self, n).tobytes() for n in ("which", "lengths", "numbers", "known")}}
        items = [x if v != v else None for x, v in zip(self.at, self.known, strict=True)]
        return {"block": uuid.uuid4().int >> 65} | {n: zlib.compress(x, 1) for n, x in arrays.items()} | {"items": items}


def blocks(rows: DataFrame, split: Callable[[str | None], list[str]]) -> DataFrame:
    """(id string, text) -> stored blocks of rows, with the columns of PACKED."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Block()
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                found = [] if text in own.texts else split(text)
                if own.full(len(found)):
                    yield pd.DataFrame([own.packed()])
                    own, found = Block(), split(text)
                own.add(i, text, found, None)
        if own.ids:
            yield pd.DataFrame([own.packed()])

    return stored(rows.select("id", "text").mapInPandas(gather, PACKED))


class Values:
    """Values of the words that a Python worker has met, for one table."""

    def __init__(self) -> None:
        self.of, self.at, self.rows = None, {}, np.zeros(0)

    def get(self, lists: list[list[str]], table: Table) -> list[np.ndarray]:
        if self.of is not table or len(self.at) > HELD_WORDS:
            self.of, self.at, self.rows = table, {}, np.zeros(0)
        fresh = [w for w in dict.fromkeys(w for words in lists for w in words) if w not in self.at]
        if fresh:
            begin = len(self.at)
            if begin + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows[:begin], np.zeros(max(begin, len(fresh), 65_536))])
            self.rows[begin : begin + len(fresh)] = table.words(fresh)
            self.at.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))
        return [self.rows[np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))] for words in lists]


_values = Values()


def measured(rows: DataFrame, table: DataFrame, which: str) -> DataFrame:
    """(id string, text) -> id and the MEASURES of each row."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(frequent(table, which))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Block()
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                lists = [words_of(text) for text in part["text"]]
                values = _values.get(lists, held.value)
                sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                m = measures(np.concatenate([np.zeros(0), *values]), sizes)
                open_ = np.isnan(m[:, 0])
                yield part.loc[~open_, ["id"]].assign(**dict(zip(MEASURES, m[~open_].T, strict=True)))
                for r in np.flatnonzero(open_):
                    if own.full(len(lists[r])):
                        yield pd.DataFrame([own.packed()])
                        own = Block()
                    own.add(part["id"].iloc[r], part["text"].iloc[r], lists[r], values[r])
        if own.ids:
            yield pd.DataFrame([own.packed()])

    shape = f"id string, {', '.join(f'{c} double' for c in MEASURES)}, {PACKED}"
    columns = [x.split()[0] for x in shape.split(", ")]

    def whole(x: pd.DataFrame) -> pd.DataFrame:
        x = x.reindex(columns=columns).astype(object)
        return x.where(x.notna(), None)

    out = rows.select("id", "text").mapInPandas(lambda batches: map(whole, gather(batches)), shape)
    if held.value.whole:
        return out.select("id", *MEASURES)
    out = stored(out)
    parts = out.where(F.col("block").isNotNull()).select(*[x.split()[0] for x in PACKED.split(", ")])
    joined = told(parts, word_values(parts, table, which), measures, MEASURES)
    return out.where(F.col("block").isNull()).select("id", *MEASURES).union(joined)


def asked(parts: DataFrame) -> DataFrame:
    """(of, at, item) of the distinct items of each block whose value isn't known."""
    return parts.select(F.col("block").alias("of"), F.posexplode("items").alias("at", "item")).where(F.col("item").isNotNull())


def told(parts: DataFrame, values: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: list[str]) -> DataFrame:
    """id and columns of each row of the blocks.

    values: (of, at, value) of items; others are 0. measure: (values of the items of all texts end to end, their number in each
    text) -> a row of columns for each text.
    """

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": []} | {c: [] for c in columns})]
        for row in left.itertuples():
            which, n, at = (np.frombuffer(zlib.decompress(x), dtype=np.int32) for x in (row.which, row.lengths, row.numbers))
            value = np.nan_to_num(np.frombuffer(zlib.decompress(row.known)), nan=0.0)
            value[right["at"].to_numpy()] = right["value"].to_numpy()
            ids = np.array(json.loads(zlib.decompress(row.ids)), dtype=object)
            out.append(pd.DataFrame({"id": ids} | dict(zip(columns, measure(value[at], n)[which].T, strict=True))))
        return pd.concat(out[-1:])

    slim = parts.drop("items")
    return slim.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(join, "id string, " + ", ".join(f"{c} double" for c in columns))


def total(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(v)])
    ends = np.cumsum(n)
    return (sums[ends] - sums[ends - n])[:, None]


#: The measures of a text: its ratio a word, the largest ratio of a word and of three words in a row, the second largest of a word,
#: the logarithm of the mean of the words' ratios as powers of e (within SOFT), and the logarithm of its length.
MEASURES = ["a", "b", "c", "d", "e", "f"]
SOFT = (-5.0, 12.0)


def measures(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The MEASURES of each text; zeros without words.

    The largest of many ratios is large by chance alone, so the length stands beside it; the second one tells an expression from a
    chance, as a text with one often has another.
    """
    out = np.zeros((len(n), len(MEASURES)))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    sizes = n[some]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mean = np.add.reduceat(v, starts) / sizes  # nan where a word isn't known yet: the row is measured again elsewhere
    v = np.nan_to_num(v, nan=0.0)
    sums = np.add.reduceat(v, starts)
    three = np.full(len(v), -np.inf)
    three[:-2] = v[:-2] + v[1:-1] + v[2:]
    three[np.arange(len(v)) + 3 > np.repeat(ends, sizes)] = -np.inf
    first = np.maximum.reduceat(v, starts)
    top = np.flatnonzero(v == np.repeat(first, sizes))
    rest = v.copy()
    rest[top[np.searchsorted(top, starts)]] = -np.inf  # one of the largest of each text
    second = np.where(sizes > 1, np.maximum.reduceat(rest, starts), 0.0)
    soft = np.log(np.add.reduceat(np.exp(np.clip(v, *SOFT)), starts) / sizes)
    out[some] = np.column_stack([mean, first, np.where(sizes < 3, sums, np.maximum.reduceat(three, starts)), second, soft, np.log1p(sizes)])
    return out


def word_values(parts: DataFrame, table: DataFrame, which: str) -> DataFrame:
    """(of, at, value): the log-likelihood ratio, toxic to ordinary, of each distinct word of blocks of documents.

    which: ratio or rest. All places that ask for a word meet in one block of words, so each word is summed once there.
    """
    wanted = asked(parts).repartition("item")
    words = blocks(wanted.select(F.concat_ws(":", "of", "at").alias("id"), F.col("item").alias("text")), grams_of)
    grams = asked(words).select("of", "at", F.expr("substr(item, 1, length(item) - 1)").alias("context"), F.expr("substr(item, length(item), 1)").alias("k"))
    slim = table.select("context", F.col(f"backed.{which}").alias("backed"), F.transform_values("after", lambda _, v: v[which]).alias("after"))
    values = grams.join(slim, "context").select("of", "at", F.coalesce(F.try_element_at("after", F.col("k")), "backed").alias("value"))
    place = F.split("id", ":")
    return told(words, values, total, ["value"]).select(place[0].cast("long").alias("of"), place[1].cast("int").alias("at"), "value")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a logistic curve (the last is the constant), by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
    return w


@dataclass
class Judge:
    """Ratios by context, and the coefficients of the measures with a constant (by default a fixed curve over the largest ratio)."""

    table: DataFrame
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -3.0]))


def train(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_ROWS) -> Judge:
    """Counts over all labelled documents for which keep holds; the curve over a bounded part of one in eight of them, measured by
    the counts of the other seven.
    """
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("y")).dropna().where(keep).groupBy("doc_id").agg(F.avg("y").alias("y"))
    # Copies of a text count once: its smallest id stands for all of them.
    prints = docs.where(keep).select("doc_id", F.xxhash64("text").alias("print")).join(known, "doc_id")
    known = prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).alias("toxic"))
    known = stored(known.select("doc_id", "toxic", (F.pmod(F.xxhash64("print"), F.lit(8)) == 0).alias("apart"), "print"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("print")).where(keep)
    words = stored(count_words(texts.join(known, ["doc_id", "print"]).select("text", "toxic", "apart")))
    table = by_context(words)
    sample = known.where("apart").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts.join(F.broadcast(sample), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select(F.col("toxic").cast("string").alias("id"), "text")
    got = measured(rows, table, "rest").toPandas()
    x, y = np.clip(got[MEASURES].to_numpy(dtype=float), -20, 20), (got["id"] == "true").to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return Judge(table)
    return Judge(table, logistic(x, y))


def scores(docs: DataFrame, model: Judge) -> DataFrame:
    """(doc_id, score) of each row of docs, by its whole text."""
    z = F.lit(float(model.curve[-1]))
    for x, w in zip(MEASURES, model.curve, strict=False):
        z = z + F.least(F.greatest(F.col(x), F.lit(-20.0)), F.lit(20.0)) * F.lit(float(w))
    out = measured(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), model.table, "ratio")
    return out.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labelled rows that aren't held out.

    held_out: a condition on doc_id. Null and empty texts and texts without letters get the score of no evidence; a null id is
    held out; repeated rows score alike; without labels a fixed curve over the largest ratios serves; an empty table gives no
    rows. Other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(True))
    out = scores(docs, train(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1)
