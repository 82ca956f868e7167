"""Document fingerprints by a randomised edit embedding.

All documents share SLOTS random walks over characters. A walk starts at an anchor that the content chooses: of all places of the
text those whose window of WINDOW characters hashes into the walk's slot compete, and the one of the smallest hash wins. From there
the walk goes on by 0 or 1, as a random bit of the step and of the character there says, stops after a number of steps of its own,
and writes one byte of the WIDTH characters it stands on. Walks that pass an edit fall into step again or write another byte; walks
elsewhere write what they wrote before, wherever the edit has moved them. So a small edit distance becomes a small Hamming distance
of what the walks write. Every place of the text competes. Slots without an anchor (in short texts) borrow that of another slot.

A fingerprint is the text's length and these bytes in hexadecimal. With the share h of equal bytes of two fingerprints, which
estimates the stretches that both texts have to those that either has, their likeness is 2h / (1 + h), the share of one text that
the other has too.

Near copies are found by banding: runs of BAND sampled bytes are keys of buckets. Texts of a bucket are compared by their whole
fingerprints; as in near_dedup, what a bucket of several components could still join is compared too, in blocks if it is large, so
no likeness within a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajgraph.llm.common import FEW_ROWS, join_hot, read, splitmix, stored
from trajgraph.llm.near_dedup import linked_components

#: Walks (a power of two), characters of an anchor's window, steps of a walk at most, and characters that are written together.
SLOTS, WINDOW, STEPS, WIDTH = 128, 12, 24, 3
#: Places that compete for a slot, on average: of longer texts those of the smallest hashes.
RIVALS = 6
#: Characters held at once, and characters hashed at once; a longer text is held alone and hashed in pieces.
LOT, PIECE = 3_000_000, 1 << 20
#: Bytes of a band, and the least likeness of near copies.
BAND, LEAST = 5, 0.8
#: Fingerprints of a block that is held against another one.
BLOCK = 4096

_BITS = SLOTS.bit_length() - 1
_PAD = WINDOW + STEPS + WIDTH
_MIX = splitmix(np.arange(16, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
_COINS = splitmix(np.arange(SLOTS * STEPS, dtype=np.uint64) + np.uint64(1 << 33)).reshape(SLOTS, STEPS)
_STOPS = (splitmix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(1 << 35)) % np.uint64(STEPS)).astype(np.int64)
_BY_STOP = np.argsort(-_STOPS, kind="stable")  # walks that still go on come first
_LENDERS = (splitmix(np.arange(SLOTS * 32, dtype=np.uint64) + np.uint64(1 << 36)) % np.uint64(SLOTS)).astype(np.int64).reshape(32, SLOTS)


def hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: the hash of its window, the byte that is written there, and which bit of a coin moves a walk on from there."""
    codes = splitmix(chars.astype(np.uint64))
    with np.errstate(over="ignore"):
        wide, size = codes, 1
        for mix in _MIX:
            if size == WINDOW:
                break
            step = min(size, WINDOW - size)
            longer = wide * mix
            longer[:-step] += wide[step:]
            wide, size = longer, size + step
        together = codes.copy()
        for k in range(1, WIDTH):
            together[:-k] += codes[k:] * np.uint64(2 * k + 1)
    return splitmix(wide), np.maximum((splitmix(together) >> np.uint64(56)).astype(np.uint8), 1), (codes >> np.uint64(58)).astype(np.uint8)


def borrowed(at: np.ndarray) -> np.ndarray:
    """at[text, slot] with the anchors of other slots where it is -1; a text has one anchor at least."""
    out, there = at.copy(), at >= 0
    for lender in _LENDERS:
        need = out < 0
        if not need.any():
            return out
        out = np.where(need & there[:, lender], at[:, lender], out)
    for k in range(1, SLOTS):
        out = np.where(out < 0, np.roll(at, k, axis=1), out)
    return out


def walk(texts: list[str]) -> np.ndarray:
    """The bytes that the walks write: written[text, slot], 0 for an empty text."""
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    gap = "\0" * _PAD  # a walk that leaves its text stays in the gap after it
    chars = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.cumsum(n + _PAD) - n - _PAD
    limit = np.minimum(2.0**63 * RIVALS * SLOTS / np.maximum(n, 1), 2.0**63 - 1024).astype(np.uint64)
    symbol, choice = np.zeros(len(chars), dtype=np.uint8), np.zeros(len(chars), dtype=np.uint8)
    best = np.full(len(texts) * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(chars), PIECE):
        z = min(a + PIECE, len(chars))
        key, sign, bit = hashes(chars[a : z + WINDOW])
        symbol[a:z], choice[a:z] = sign[: z - a], bit[: z - a]
        value = (key[: z - a] << np.uint64(_BITS)) >> np.uint64(1)
        first, last = np.searchsorted(begin, [a, z - 1], side="right") - 1
        of = np.arange(first, last + 1)
        # The bound of each place: that of its text, 0 in the gaps.
        edges = np.clip(np.stack([begin[of], begin[of] + n[of]], axis=1).ravel(), a, z)
        runs = np.diff(np.concatenate((edges, [z])))
        bound = np.repeat(np.stack([limit[of], np.zeros(len(of), dtype=np.uint64)], axis=1).ravel(), runs)
        place = np.flatnonzero(value < bound)
        text = np.searchsorted(begin, place + a, side="right") - 1
        slot = text * SLOTS + (key[place] >> np.uint64(64 - _BITS)).astype(np.int64)
        np.minimum.at(best, slot, value[place])
        found.append((slot, value[place], place + a))
    slot, value, place = (np.concatenate(x) for x in zip(*found, strict=True))
    won = value == best[slot]
    at = np.full(len(texts) * SLOTS, -1, dtype=np.int64)
    at[slot[won][::-1]] = place[won][::-1]  # of equal hashes the first place
    at = at.reshape(len(texts), SLOTS)
    lacking = np.flatnonzero((at < 0).any(1) & (at >= 0).any(1))
    at[lacking] = borrowed(at[lacking])
    none = np.flatnonzero((at < 0).any(1))  # empty texts
    at[none] = begin[none][:, None]
    here, stops = np.ascontiguousarray(at[:, _BY_STOP].T), _STOPS[_BY_STOP]
    for j in range(STEPS):
        going = int(np.searchsorted(-stops, -j, side="left"))
        here[:going] += ((_COINS[_BY_STOP[:going], j][:, None] >> choice[here[:going]]) & np.uint64(1)).astype(np.int64)
    written = np.empty((len(texts), SLOTS), dtype=np.uint8)
    written[:, _BY_STOP] = symbol[here].T
    written[n == 0] = 0
    return written


def fingerprints(texts: list[str]) -> list[str]:
    """Length and sampled bytes of each whole text in hexadecimal; equal texts have equal fingerprints."""
    found: dict[str, str] = {}
    lot: list[str] = []
    total = 0
    for text in [*dict.fromkeys(texts), None]:
        if lot and (text is None or total + len(text) > LOT):
            found.update((t, f"{len(t):08x}{b.tobytes().hex()}") for t, b in zip(lot, walk(lot), strict=True))
            lot, total = [], 0
        if text is not None:
            lot.append(text)
            total += len(text)
    return [found[t] for t in texts]


def likeness(a: str, b: str) -> float:
    """2h / (1 + h) of the share h of equal bytes; 1 for two equal fingerprints, 0 for an empty text and another one."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[8:]), dtype=np.uint8) for f in (a, b))
    h = float(((x == y) & (x != 0)).mean())
    return 2 * h / (1 + h)


def least_equal(least: float) -> int:
    """Equal bytes of a likeness of `least` or more."""
    return int(np.ceil(SLOTS * least / (2 - least) - 1e-9))


def alike_blocks(x: list[bytes], y: list[bytes], least: float) -> np.ndarray:
    """Whether the likeness of each pair of fingerprints (as bytes) of two blocks is `least` or more."""
    m, w = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), 4 + SLOTS) for v in (x, y))
    out = np.zeros((len(x), len(y)), dtype=bool)
    need = least_equal(least)
    for r, row in enumerate(m):
        same = w[:, 4:] == row[4:]
        out[r] = (same & (row[4:] != 0)).sum(1) >= need if row[4:].any() else (w == row).all(1)
    return out


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many of the first characters of what follows, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def packed(docs: DataFrame, cuts: np.ndarray, hot: dict[float, int], first: dict[int, int], sent: dict[int, list[int]]) -> DataFrame:
    """(slot, own, doc_id, packed): each document with an id, compressed, in the slot of its range of ids; own is false for copies of a
    document in slots in which it follows the last one. Texts cross the network once, and small.

    first: the slot of each range; a hot id has slots of its own after that of its range. sent: the slots that need a copy of an id;
    of repeated rows of it only the least of each batch is sent.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            raw = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]
            slot = np.array([first[p] for p in np.searchsorted(cuts, ids.astype(np.float64), side="right").tolist()], dtype=np.int32)
            for k, i in enumerate(ids.tolist()):
                if float(i) in hot:
                    slot[k] += 1 + k % hot[float(i)]
            least: dict[int, bytes] = {}
            for i, x in zip(ids.tolist(), raw, strict=True):
                if i in sent and x <= least.get(i, x):
                    least[i] = x
            more = [(to, i, x) for i, x in least.items() for to in sent[i]]
            yield pd.DataFrame({"slot": np.concatenate((slot, np.array([m[0] for m in more], dtype=np.int32))), "own": [True] * len(ids) + [False] * len(more), "doc_id": np.concatenate((ids, np.array([m[1] for m in more], dtype=np.int64))), "packed": raw + [m[2] for m in more]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, "slot int, own boolean, doc_id long, packed binary")


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows of packed, so that each slot also holds the document that follows the largest id in it; and the number of slots.

    Ranges of doc_id lie between quantiles. An id that is several quantiles, one with more rows than a range, is dealt to as many
    slots of its own. Only the smallest id of each range and the one after each hot id come to the driver: as many as partitions.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    each = ids.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    hot = {float(c): k for c, k in Counter(each).items() if k > 1}
    cuts, warm = np.unique(np.array(each, dtype=np.float64)), np.array(sorted(hot), dtype=np.float64)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["doc_id"].to_numpy()
            x = own.astype(np.float64)
            after = np.searchsorted(warm, x, side="left")  # hot ids below
            kinds = [("range", np.searchsorted(cuts, x, side="right"), own), ("after", after[after > 0] - 1, own[after > 0])]
            yield pd.concat([pd.DataFrame({"kind": kind, "k": k, "id": i}).groupby(["kind", "k"], as_index=False).min() for kind, k, i in kinds])

    # An id after several hot ones follows only the last of them; those before have that one after them.
    found = ids.mapInPandas(marks, "kind string, k long, id long").groupBy("kind", "k").agg(F.min("id").alias("id")).collect()
    least = {r.k: r.id for r in found if r.kind == "range"}
    after = {r.k: r.id for r in found if r.kind == "after"}
    first: dict[int, int] = {}
    sent: dict[int, list[int]] = {}
    slots = 0
    there = sorted(least)
    for at, p in enumerate(there):
        first[p] = slots
        following = least[there[(at + 1) % len(there)]]
        sent.setdefault(following, []).append(slots)
        own = [c for c in hot if np.searchsorted(cuts, c, side="right") == p]
        slots += 1
        for c in own:
            following = after.get(int(np.searchsorted(warm, c)), least[there[0]])
            sent.setdefault(following, []).extend(range(slots, slots + hot[c]))
            slots += hot[c]
    return packed(docs, cuts, hot, first, sent), slots


SHAPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def described(ids: list[int | None], texts: list[str], nexts: list[str]) -> pd.DataFrame:
    """Rows of SHAPE."""
    changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
    n = len(texts)
    all_ = fingerprints(texts + changed + nexts)
    own, new, then = all_[:n], all_[n : 2 * n], all_[2 * n :]
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"), "n_chars": np.array([len(t) for t in texts], dtype=np.int64),
            "edited_sha256": np.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], dtype=object),
            "fingerprint": np.array(own, dtype=object), "edited_fingerprint": np.array(new, dtype=object),
            "near_edited": np.array([likeness(a, b) for a, b in zip(own, new, strict=True)], dtype=float), "near_next": np.array([likeness(a, b) for a, b in zip(own, then, strict=True)], dtype=float),
        }
    )


def without_id(docs: DataFrame, following: str) -> DataFrame:
    """The documents without an id: they come before all others, so the first one with an id follows each of them."""
    held = docs.sparkSession.sparkContext.broadcast(following)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            yield described([None] * len(texts), texts, [held.value] * len(texts))

    return docs.where(F.col("doc_id").isNull()).select("text").mapInPandas(work, SHAPE)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is that of the next larger doc_id (of repeated rows of it the one that is first in compressed form), after the
    last id the first one. Null texts are empty; a row without an id comes before all others (if none has an id, an empty text
    follows); repeated rows have the same next document; a single document is its own next one; an empty table gives no rows. Other
    columns of docs are not read.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    parted, slots = in_order(named)
    # From the largest id down, copies first: what follows a document is known when it comes, and rows of one id aren't gathered.
    dealt = parted.repartitionByRange(max(1, slots), "slot").sortWithinPartitions("slot", "own", F.col("doc_id").desc(), "packed")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[int, str, str]] = []
        size, at, now, here, after = 0, None, None, "", ""
        for pdf in batches:
            for slot, own, doc_id, raw in zip(pdf["slot"].tolist(), pdf["own"].tolist(), pdf["doc_id"].tolist(), pdf["packed"], strict=True):
                text = unpack.decompress(raw).decode("utf-8", "surrogatepass")
                if slot != at:
                    at, now, after = slot, None, None
                if not own:
                    after = text if after is None else after
                    continue
                if doc_id != now:
                    after = after if now is None else here
                    now, here = doc_id, text
                held.append((doc_id, text, after))
                size += len(text)
                if size > LOT:
                    yield described(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield described(*map(list, zip(*held, strict=True)))

    out = dealt.mapInPandas(work, SHAPE)
    if not docs.where(F.col("doc_id").isNull()).limit(1).count():
        return out
    least = named.agg(F.min("doc_id")).first()[0]
    first = named.where(F.col("doc_id") == least)
    texts = [zstandard.ZstdDecompressor().decompress(bytes(r.packed)).decode("utf-8", "surrogatepass") for r in first.transform(first_packed).collect()]
    return out.unionByName(without_id(docs, texts[0] if texts else ""))


def first_packed(rows: DataFrame) -> DataFrame:
    """One row (packed): the first of the compressed texts."""
    return packed(rows, np.zeros(0), {}, {0: 0}, {}).groupBy().agg(F.min("packed").alias("packed")).where(F.col("packed").isNotNull())


def bands(classes: DataFrame) -> DataFrame:
    """(node, key) of each class (node, fingerprint): keys of the runs of BAND sampled bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.frombuffer(bytes.fromhex("".join(f[8:] for f in pdf["fingerprint"])), dtype=np.uint8).reshape(len(pdf), SLOTS)
            runs = m[:, : SLOTS // BAND * BAND].reshape(len(pdf), -1, BAND).astype(np.uint64)
            raw = np.tile(np.arange(runs.shape[1], dtype=np.uint64) << np.uint64(8 * BAND), (len(pdf), 1))
            for k in range(BAND):
                raw |= runs[:, :, k] << np.uint64(8 * k)
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), runs.shape[1]), "key": splitmix(raw).view(np.int64).ravel()})

    return classes.mapInPandas(cut, "node long, key long")


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), 4 + SLOTS)[:, 4:] for v in (a, b))
    return pd.Series(((x == y) & (x != 0)).sum(1) >= least_equal(float(least.iloc[0])))


def near_classes(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """(print, check, m, class_id, n_class) of each different fingerprint: two hashes of it, its documents, the least id and the number
    of the documents that likeness joins it to, directly or over others; prints: doc_id, fingerprint."""
    keyed = prints.select("doc_id", "fingerprint", *print_keys())
    classes = keyed.groupBy("print", "check").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m"), F.first("fingerprint").alias("fingerprint"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = bands(classes.where(F.substring("fingerprint", 1, 8) != "00000000").select("node", "fingerprint"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where(F.col("size") > 1)
    buckets = stored(join_hot(banded, crowded, ["key"], "size", "node").select(F.lit(0).alias("band"), "key", "node", "least"))
    whole = F.unhex("fingerprint")
    of = lambda name: classes.select(F.col("node").alias(name), whole.alias(f"_{name}"))

    def confirm_(pairs: DataFrame) -> DataFrame:
        return pairs.join(of("a"), "a").join(of("b"), "b").where(alike("_a", "_b", F.lit(least))).select("a", "b")

    def candidates(few: DataFrame) -> DataFrame:
        left = few.select("key", F.col("node").alias("a"), F.col("component").alias("ca"))
        right = few.select(F.col("key").alias("key"), F.col("node").alias("b"), F.col("component").alias("cb"))
        return left.join(right, "key").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()

    payload = classes.select("node", whole.alias("set"))
    found = linked_components(buckets, confirm_, candidates, payload, lambda x, y: alike_blocks(x, y, least), BLOCK)
    named = stored(classes.select("print", "check", "first", "m", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sums = named.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("m").alias("n_class"), F.count(F.lit(1)).alias("k"))
    return join_hot(named, sums, ["component"], "k", "node").select("print", "check", "m", "class_id", "n_class")


def print_keys() -> list:
    """Two hashes of a fingerprint, 96 bits."""
    return [F.xxhash64("fingerprint").alias("print"), F.hash("fingerprint").alias("check")]


def fingerprint_and_link(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The columns of fingerprint, with class_id and n_class: the least id and the number of the documents that likenesses of `least`
    or more join a document to (itself included).

    Empty texts are one class. Documents without an id are joined like others, and have no class_id if none of their class has an
    id; an empty table gives no rows.
    """
    rows = stored(fingerprint(docs))
    of = stored(near_classes(rows.select("doc_id", "fingerprint"), least))
    print_, check = print_keys()
    keyed, on = rows.withColumns({"print": print_, "check": check}), ["print", "check"]
    some = of.where(F.col("n_class") > 1)
    if some.limit(FEW_ROWS + 1).count() <= FEW_ROWS:  # most documents stand alone and need no join
        joined = keyed.join(F.broadcast(some), on, "left")
    else:
        joined = join_hot(keyed, of, on, "m", "doc_id")
    return joined.withColumns({"class_id": F.when(F.col("n_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")), "n_class": F.coalesce("n_class", F.lit(1))}).drop(*on, "m")


def op2_fingerprints(spark, sf_dir):
    return fingerprint_and_link(read(spark, sf_dir, "documents"))
