"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

Every string of LENGTH bytes has one anchor: the place in it whose GRAM bytes hash to the least value (the leftmost of equals).
The anchor depends on the string alone, so two equal strings have their anchors at the same offset, and only suffixes that begin at
anchors (about one in seventy bytes) must be sorted to find all repeats:

1. the grams at anchors are counted over all documents; those seen once start no repeated string. The others go into a bit
   map of a fixed size, which is broadcast;
2. around each anchor in the map goes a segment: all strings that have this anchor. Segments are counted by digest, without
   their bytes. All strings of a segment seen twice are repeats; a segment seen once must be compared with the others of its
   gram, and only such segments, one of each kind, send their bytes;
3. sampled splitters over the leading bytes and the gram deal the suffixes at the anchors of these segments to ranges. Each range
   sorts its suffixes, and the reversed bytes before the anchors, by multikey quicksort (eight bytes a step, NumPy arrays) and
   compares neighbours: runs of common prefixes on both sides tell equal strings, byte by byte. A boundary between ranges lies
   between different grams, whose suffixes differ within GRAM bytes: no repeat crosses it;
4. grams with more than HOT_KINDS kinds of segments would not fit one task: their strings are grouped by 128-bit digests instead;
5. segments get a bit for each of their strings; documents collect these and cut out what they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajgraph.llm.common import BYTE_CODES, Rolling, groups_of, join_hot, read, splitmix, stored

LENGTH, GRAM = 200, 64
#: Bits of the broadcast map (16 MB). With more repeated grams than that, more single segments are sorted; results stay.
MAP_BITS = 27
#: Leading bytes of a suffix by which ranges are cut.
LEAD = 16
#: Kinds of segments of a gram that are sorted in one task, and about how many segments are sorted at once.
HOT_KINDS, AT_ONCE = 2000, 20_000
_PLACE = np.uint64(24)
_GROUP = 500_000
_PIECE = 8_000_000


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the texts: flat bytes, rolling sums, and of each anchor its text, the first string's place in flat and in the
    text, the number of strings, the anchor's place in flat, and the hash of its gram."""
    width = length - gram + 1
    for a, b in groups_of([len(t) for t in texts], _GROUP):
        for piece, base in _pieces(texts[a:b], length):
            flat = np.frombuffer(b"".join(piece), dtype=np.uint8)
            if len(flat) < length:
                continue
            sizes = np.fromiter(map(len, piece), dtype=np.int64, count=len(piece))
            begin = np.cumsum(sizes) - sizes
            rolling = Rolling(BYTE_CODES[flat])
            h = rolling.fixed(gram)
            least = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size * 2 <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < width:
                least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
            at = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
            owner = np.repeat(np.arange(len(piece)), sizes)[: len(at)]
            whole = np.arange(len(at)) + length <= (begin + sizes)[owner]
            place = np.flatnonzero(whole)
            if not len(place):
                continue
            new = np.ones(len(place), dtype=bool)
            new[1:] = (np.diff(place) > 1) | (np.diff(at[place]) != 0) | (np.diff(owner[place]) != 0)
            first = np.flatnonzero(new)
            start = place[first]
            count = np.diff(np.append(first, len(place)))
            yield flat, rolling, owner[start] + a, start, start - begin[owner[start]] + base, count, at[start], h[at[start]]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], int]]:
    """Texts of a group together; a text too large for one piece in overlapping pieces, with the place where each begins."""
    if len(texts) > 1 or len(texts[0]) <= _PIECE:
        yield texts, 0
        return
    for base in range(0, len(texts[0]) - length + 1, _PIECE):
        yield [texts[0][base : base + _PIECE + length - 1]], base


def _raw(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def repeated_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram): hashes of the grams that stand at two anchors or more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [x[-1] for x in anchors(_raw(pdf["text"]), length, gram)]
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pd.DataFrame({"gram": keys.view(np.int64), "n": np.minimum(n, 2).astype(np.int8)})

    counts = docs.select("text").mapInPandas(count, "gram long, n byte")
    return counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("gram")


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A map of 2^bits bits with those of the hashes (one long column) set, by their upper bits.

    It comes to the driver in blocks, 2^bits / 8 bytes in all.
    """
    block = 16

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << block, dtype=bool)
        marks[pdf["low"]] = True
        return pd.DataFrame({"block": [key[0]], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned(hashes.columns[0], 64 - bits)
    low = hashes.select(F.shiftright(slot, block).cast("int").alias("block"), slot.bitwiseAND(F.lit((1 << block) - 1)).cast("int").alias("low")).distinct()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in low.groupBy("block").applyInPandas(pack, "block int, marks binary").toLocalIterator():
        size = 1 << (block - 3)
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.marks, dtype=np.uint8)
    return out


def _marked(marks: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return ((marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _place_hash(print_: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of (text, place), for the map of segments that send their bytes."""
    with np.errstate(over="ignore"):
        return splitmix(print_.astype(np.int64).view(np.uint64) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def places(docs: DataFrame, marks: np.ndarray, length: int, gram: int, bits: int = MAP_BITS) -> DataFrame:
    """(doc, print, start, strings, gram, digest, place) of the segment of each anchor whose gram is in the map."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, print_ = pdf["doc"].to_numpy(), pdf["print"].to_numpy()
            for _, rolling, text, start, place, count, _, h in anchors(_raw(pdf["text"]), length, gram):
                ok = np.flatnonzero(_marked(held.value, h, bits))
                digest = rolling.stretches(start[ok], start[ok] + count[ok] - 1 + length)
                yield pd.DataFrame({"doc": doc[text[ok]], "print": print_[text[ok]], "start": place[ok], "strings": count[ok].astype(np.int16), "gram": h[ok].view(np.int64), "digest": digest.view(np.int64), "place": _place_hash(print_[text[ok]], place[ok]).view(np.int64)})

    return docs.select("doc", "print", "text").mapInPandas(cut, "doc long, print long, start long, strings short, gram long, digest long, place long")


def segment_bytes(docs: DataFrame, marks: np.ndarray, length: int, gram: int, bits: int = MAP_BITS) -> DataFrame:
    """(gram, digest, strings, lead, anchor, segment) of the segments whose place is in the map; anchor: its place in the segment."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            print_ = pdf["print"].to_numpy()
            for flat, rolling, text, start, place, count, at, h in anchors(_raw(pdf["text"]), length, gram):
                ok = np.flatnonzero(_marked(held.value, _place_hash(print_[text], place), bits))
                end = start[ok] + count[ok] - 1 + length
                raw = flat.tobytes()
                yield pd.DataFrame({"gram": h[ok].view(np.int64), "digest": rolling.stretches(start[ok], end).view(np.int64), "strings": count[ok].astype(np.int16), "lead": [raw[p : p + LEAD] for p in at[ok]], "anchor": (at[ok] - start[ok]).astype(np.int16), "segment": [raw[x:y] for x, y in zip(start[ok], end, strict=True)]})

    return docs.select("print", "text").mapInPandas(cut, "gram long, digest long, strings short, lead binary, anchor short, segment binary")


KIND = ["gram", "digest", "strings"]


def kinds_of(found: DataFrame) -> DataFrame:
    """(gram, digest, strings, n, place): how often each segment stands, and the place of one of them."""
    return found.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def compared(kinds: DataFrame) -> DataFrame:
    """The kinds of grams that have several (`k`), one of them seen once: no other gram needs a comparison."""
    mixed = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where((F.col("k") > 1) & (F.col("least") == 1)).select("gram", "k")
    return join_hot(kinds, mixed, ["gram"], "k", "digest")


def suffix_order(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings flat[start : start + size] and the length of the prefix that each shares with the one before it.

    Multikey quicksort with keys of eight bytes: groups that are equal so far are sorted by their next key and split; a string that
    ends comes before those that go on.
    """
    n = len(start)
    wide = np.zeros(len(flat) + 8, dtype=np.uint64)
    for k in range(8):
        wide[: len(flat) - k] |= flat[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    order, common = np.arange(n), np.zeros(n, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64)  # of each place in the order: the first place of its group
    open_ = np.arange(n) if n > 1 else np.zeros(0, dtype=np.int64)
    depth = 0
    while len(open_):
        rows = order[open_]
        left = np.clip(size[rows] - depth, 0, 9)  # 9: goes on after this key
        word = wide[np.minimum(start[rows] + depth, len(flat))]
        over = ((8 - np.minimum(left, 8)) * 8 % 64).astype(np.uint64)
        word = np.where(left > 0, (word >> over) << over, np.uint64(0))
        by = np.lexsort((left, word, group[open_]))
        rows, left, word = rows[by], left[by], word[by]
        order[open_] = rows
        own = group[open_]  # groups stay where they are: only the rows inside moved
        same_group = own[1:] == own[:-1]
        split = same_group & ((word[1:] != word[:-1]) | (left[1:] != left[:-1]))
        differ = word[1:] ^ word[:-1]
        lead = np.full(len(differ), 8, dtype=np.int64)
        some = np.flatnonzero(differ)
        lead[some] = (63 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64)) // 8
        # A difference next below a power of two can round up to it: the byte is looked up again.
        lead[some] = np.where((differ[some] >> (np.uint64(56) - (8 * np.minimum(lead[some], 7)).astype(np.uint64))) == 0, lead[some] + 1, lead[some])
        shared = depth + np.minimum(np.minimum(lead, 8), np.minimum(left[1:], left[:-1]))
        common[open_[1:][split]] = shared[split]
        # Equal to the end: nothing is left to compare.
        first = np.concatenate([[True], ~same_group | split])
        begin = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        group[open_] = begin
        depth += 8
        members = np.bincount(np.cumsum(first) - 1)
        on = left == 9
        alone = np.repeat(members == 1, members)
        ended = np.flatnonzero(~first & ~on)
        common[open_[ended]] = size[rows[ended]]
        open_ = open_[on & ~alone]
    return order, common


def repeated_strings(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """(gram, digest, strings, mask) of the segments that were seen once and have a string that another segment has."""
    counts, n, anchor = (rows[c].to_numpy().astype(np.int64) for c in ("strings", "n", "anchor"))
    flat = np.frombuffer(b"".join(rows["segment"]), dtype=np.uint8)
    sizes = counts + length - 1
    begin = np.cumsum(sizes) - sizes
    after, shared_after = suffix_order(flat, begin + anchor, sizes - anchor)
    before, shared_before = suffix_order(flat[::-1], len(flat) - begin - anchor, anchor)
    bits = np.zeros((len(rows), -(-int(counts.max()) // 8) * 8), dtype=bool)
    run_before, run_after = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for ahead in range(int(anchor.max()) + 1):  # bytes of the string before its anchor
        some = np.flatnonzero((anchor >= ahead) & (anchor - ahead < counts))
        if len(some) < 2:
            continue
        # Runs of equal bytes on each side.
        run_before[before] = np.cumsum(shared_before < ahead)
        run_after[after] = np.cumsum(shared_after < length - ahead)
        _, of, size = np.unique(run_before[some] * (len(rows) + 1) + run_after[some], return_inverse=True, return_counts=True)
        again = some[(size > 1)[of] | (n[some] > 1)]
        bits[again, anchor[again] - ahead] = True
    own = np.flatnonzero(bits.any(1) & (n == 1))
    masks = np.packbits(bits, axis=1, bitorder="little")
    return pd.DataFrame({"gram": rows["gram"].to_numpy()[own], "digest": rows["digest"].to_numpy()[own], "strings": counts[own].astype(np.int16), "mask": [masks[i].tobytes() for i in own]})


def repeats(kinds: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """(gram, digest, strings, mask): for each kind seen once a bit for each of its strings that begins elsewhere too.

    kinds: those to compare, with the number `k` of their gram's; segments: their bytes.
    """
    own = stored(segments.join(kinds.select(*KIND, "n", "k"), KIND).dropDuplicates(KIND))
    cool = own.where(F.col("k") <= HOT_KINDS)
    ranges = cool.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < AT_ONCE:
                continue
            all_ = pd.concat(held, ignore_index=True)
            gram = all_["gram"].to_numpy()
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if cut:
                yield repeated_strings(all_.iloc[:cut].reset_index(drop=True), length)
            held = [all_.iloc[cut:]]
        if held and sum(map(len, held)):
            yield repeated_strings(pd.concat(held, ignore_index=True), length)

    sorted_ = ranges.select("gram", "digest", "strings", "n", "anchor", "segment").mapInPandas(sort, "gram long, digest long, strings short, mask binary")
    return sorted_.union(hot_repeats(own.where(F.col("k") > HOT_KINDS), length))


_OTHER_CODES = splitmix(BYTE_CODES)


def hot_repeats(hot: DataFrame, length: int) -> DataFrame:
    """repeats for the segments of grams with many kinds: strings meet by their digests, no gram in one task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            counts = pdf["strings"].to_numpy().astype(np.int64)
            flat = np.frombuffer(b"".join(pdf["segment"]), dtype=np.uint8)
            sizes = counts + length - 1
            row = np.repeat(np.arange(len(pdf)), counts)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = (np.cumsum(sizes) - sizes)[row] + inner
            one, two = (Rolling(codes[flat]).stretches(start, start + length).view(np.int64) for codes in (BYTE_CODES, _OTHER_CODES))
            yield pd.DataFrame({c: pdf[c].to_numpy()[row] for c in (*KIND, "n")} | {"inner": inner.astype(np.int16), "one": one, "two": two})

    strings = stored(hot.select(*KIND, "n", "segment").mapInPandas(each, "gram long, digest long, strings short, n long, inner short, one long, two long"))
    again = strings.groupBy("one", "two").agg(F.sum("n").alias("total")).where(F.col("total") > 1)
    found = join_hot(strings.where(F.col("n") == 1).drop("n"), again, ["one", "two"], "total", "digest")

    def mask(inner: list) -> bytes:
        return np.packbits(np.isin(np.arange(max(inner) + 1), inner), bitorder="little").tobytes()

    lists = found.groupBy(*KIND).agg(F.collect_set("inner").alias("inner"))
    return lists.mapInPandas(lambda batches: (pdf.assign(mask=[mask(list(x)) for x in pdf["inner"]]).drop(columns="inner") for pdf in batches), "gram long, digest long, strings short, mask binary")


def removed_spans(found: DataFrame, masks: DataFrame, length: int) -> DataFrame:
    """(doc, print, spans): maximal covered runs [start, end) of each document, ascending; flat pairs of places.

    masks: (gram, digest, strings, n, mask), n: how often the segment stands; a null mask stands for all strings.
    """
    places_ = join_hot(found.select("doc", "print", "start", *KIND), masks, KIND, "n", "print").select("doc", "print", "start", "strings", "mask")

    def runs(got) -> list[int]:
        """The strings' places of all segments, grown to their bytes and merged."""
        out: list[int] = []

        def add(a: int, b: int) -> None:
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out.extend((a, b))

        for x in sorted(got, key=lambda x: x["start"]):
            start = int(x["start"])
            if x["mask"] is None:
                add(start, start + int(x["strings"]) - 1 + length)
                continue
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], dtype=np.uint8), bitorder="little"))
            gap = np.flatnonzero(np.diff(bits) > length)
            for a, b in zip(np.append(bits[0], bits[gap + 1]), np.append(bits[gap], bits[-1]), strict=True):
                add(start + int(a), start + int(b) + length)
        return out

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "print": pdf["print"], "spans": [runs(got) for got in pdf["got"]]})

    # A set: equal rows without an id have the same places, which are one in each task before they are shuffled.
    lists = places_.groupBy("doc", "print").agg(F.collect_set(F.struct("start", "strings", "mask")).alias("got"))
    return lists.mapInPandas(merge, "doc long, print long, spans array<long>")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    Each byte covered by a string of `length` bytes that also starts elsewhere goes. Null texts are empty; texts shorter than
    `length` stay whole; repeated rows repeat each other and lose all such bytes; an empty table gives no rows. Other columns of
    docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("print"))
    found = stored(places(keyed, bit_map(repeated_grams(keyed, length, gram)), length, gram))
    kinds = stored(kinds_of(found))
    asked = stored(compared(kinds))
    own = repeats(asked, segment_bytes(keyed, bit_map(asked.select("place")), length, gram), length)
    masks = kinds.where(F.col("n") > 1).select(*KIND, "n", F.lit(None).cast("binary").alias("mask")).union(own.select(*KIND, F.lit(1).cast("long"), "mask"))
    spans = removed_spans(found, masks, length)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, pairs in zip(_raw(pdf["text"]), pdf["spans"], strict=True):
                pairs = [] if pairs is None else list(pairs)
                edges = [0, *pairs, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(pairs) // 2, hashlib.sha256(kept).hexdigest(), kept))
            n, gone, runs, digest, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": np.array(n, dtype=np.int64), "n_removed": np.array(gone, dtype=np.int64), "n_spans": np.array(runs, dtype=np.int64), "kept_sha256": np.array(digest, dtype=object), "kept": np.array(kept, dtype=object)})

    joined = keyed.join(spans, ["doc", "print"], "left").select("doc_id", "text", "spans")
    shape = joined.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").alias("kept_sha256"), F.lit(b"").alias("kept"))
    return joined.mapInPandas(keep, shape.schema)


def op5_suffix_dedup(spark, sf_dir):
    return cut_repeats(read(spark, sf_dir, "documents")).drop("kept")
