"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word may be cut into pieces in many ways; the
forward algorithm sums the probabilities of all of them, and a document scores the sum of the logarithms over its words plus the
logarithm of the language's share. The piece probabilities are learned from word counts of each language by expectation
maximisation over all segmentations; a Spark pass over the counted words makes each step.

The pieces of all words of a batch are found by one walk down a trie of the vocabulary from every letter at once; forward and
backward sums then go over the places of the words in lockstep.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajgraph.llm.common import fold, read, splitmix, stored

WORD = re.compile(r"[^\W\d_]+")
#: Words of more letters are summed in logarithms: the probabilities of shorter ones can't underflow (UNKNOWN bounds them).
LONG = 36
#: Letters of a batch of words.
LOT = 200_000
#: Probability of a character that stands in no piece, and the count added to every piece.
UNKNOWN, PRIOR = 1e-7, 0.01
STEPS = 3
HELD_WORDS = 300_000


def public_pieces(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece model: the file's path, or that of the installed public vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted({x.lower() for x in pieces if x})


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals such as one half are no letters."""
    if not text:
        return []
    words = WORD.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = [x for w in words for x in ("".join(c if c.isalpha() else " " for c in w)).split()]
    return words


@dataclass
class Lattice:
    """Words of one batch, the longest first: row r holds places 0..sizes[r] (the mark before a word counts as a letter).

    Pieces that stand in the words are sorted by the place where they start: those that start at place s are the slice
    [cuts[s], cuts[s + 1]) of `row`, `end` (their end's place) and `piece`. Of each start and row no two have one end.
    """

    sizes: np.ndarray
    row: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    cuts: np.ndarray


class Pieces:
    """The vocabulary as a trie in a hash table of (node, letter)."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        letters = sorted({c for x in pieces for c in x})
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: dict[tuple[int, str], int] = {}
        ids = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                to = nodes.get((at, c))
                if to is None:
                    to = nodes[at, c] = len(ids)
                    ids.append(-1)
                at = to
            ids[at] = k
        self.ids = np.array(ids, dtype=np.int32)
        keys = np.array([a * self.width + int(self.letter[ord(c)]) for a, c in nodes], dtype=np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.child = np.zeros(1 << self.bits, dtype=np.int32)
        rest = np.arange(len(keys))
        slot, to = self._slot(keys), np.arange(1, len(ids), dtype=np.int32)
        while len(rest):  # linear probing: of those that meet in a free slot the first one takes it
            _, first = np.unique(slot[rest], return_index=True)
            first = first[self.keys[slot[rest[first]]] < 0]
            won = rest[first]
            self.keys[slot[won]], self.child[slot[won]] = keys[won], to[won]
            rest = np.delete(rest, first)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def children(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there is none (the root is nobody's child)."""
        keys = node * self.width + letter
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.child[slot], 0).astype(np.int64)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.child[slot[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out

    def lattice(self, words: list[str]) -> Lattice:
        """words: the longest first."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        flat = np.frombuffer(("▁" + "\n▁".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = self.letter[np.minimum(flat, len(self.letter) - 1)]  # a line's end is no letter of a piece
        begin = np.cumsum(sizes + 1) - sizes - 1
        row = np.repeat(np.arange(len(words), dtype=np.int64), sizes + 1)
        place = np.arange(len(flat)) - begin[row]
        start = np.flatnonzero(letter)
        node = np.zeros(len(start), dtype=np.int64)
        starts, ends, pieces = [], [], []
        length = 0
        while len(start):
            node = self.children(node, letter[start + length])
            alive = np.flatnonzero(node)
            start, node = start[alive], node[alive]
            length += 1
            piece = self.ids[node]
            some = np.flatnonzero(piece >= 0)
            starts.append(start[some])
            ends.append(place[start[some]] + length)
            pieces.append(piece[some])
        at = np.concatenate([np.zeros(0, dtype=np.int64), *starts])
        end, piece = np.concatenate([np.zeros(0, dtype=np.int64), *ends]), np.concatenate([np.zeros(0, dtype=np.int32), *pieces])
        most = int(sizes.max(initial=0))
        from_ = place[at]
        order = np.argsort(from_.astype(np.uint16) if most < 1 << 16 else from_, kind="stable")
        cuts = np.searchsorted(from_[order], np.arange(most + 2))
        return Lattice(sizes, row[at][order], end[order], piece[order], cuts)


def forward(x: Lattice, p: np.ndarray) -> np.ndarray:
    """alpha[place, word, ...]: probabilities of all segmentations up to each place; p: (pieces, ...)."""
    most, n = int(x.sizes.max(initial=0)), len(x.sizes)
    alpha = np.zeros((most + 1, n, *p.shape[1:]))
    alpha[0] = 1.0
    # Rows that reach a place: the longest come first.
    active = np.searchsorted(-x.sizes, -np.arange(most + 2), side="right")
    for s in range(most):
        part = slice(x.cuts[s], x.cuts[s + 1])
        alpha[x.end[part], x.row[part]] += alpha[s, x.row[part]] * p[x.piece[part]]
        k = active[s + 1]
        alpha[s + 1, :k] += alpha[s, :k] * UNKNOWN
    return alpha


def backward(x: Lattice, p: np.ndarray) -> np.ndarray:
    """beta[place, word]: probabilities of all segmentations from each place on; p: (pieces,)."""
    most, n = int(x.sizes.max(initial=0)), len(x.sizes)
    beta = np.zeros((most + 1, n))
    beta[x.sizes, np.arange(n)] = 1.0
    active = np.searchsorted(-x.sizes, -np.arange(most + 2), side="right")
    for s in range(most - 1, -1, -1):
        part = slice(x.cuts[s], x.cuts[s + 1])
        beta[s] += np.bincount(x.row[part], weights=beta[x.end[part], x.row[part]] * p[x.piece[part]], minlength=n)
        k = active[s + 1]
        beta[s, :k] += beta[s + 1, :k] * UNKNOWN
    return beta


def log_forward(x: Lattice, logp: np.ndarray) -> np.ndarray:
    """forward in logarithms, for words of any length."""
    most, n = int(x.sizes.max(initial=0)), len(x.sizes)
    alpha = np.full((most + 1, n, *logp.shape[1:]), -np.inf)
    alpha[0] = 0.0
    active = np.searchsorted(-x.sizes, -np.arange(most + 2), side="right")
    for s in range(most):
        part = slice(x.cuts[s], x.cuts[s + 1])
        at = (x.end[part], x.row[part])
        alpha[at] = np.logaddexp(alpha[at], alpha[s, x.row[part]] + logp[x.piece[part]])
        k = active[s + 1]
        alpha[s + 1, :k] = np.logaddexp(alpha[s + 1, :k], alpha[s, :k] + np.log(UNKNOWN))
    return alpha


def log_backward(x: Lattice, logp: np.ndarray) -> np.ndarray:
    most, n = int(x.sizes.max(initial=0)), len(x.sizes)
    beta = np.full((most + 1, n), -np.inf)
    beta[x.sizes, np.arange(n)] = 0.0
    active = np.searchsorted(-x.sizes, -np.arange(most + 2), side="right")
    for s in range(most - 1, -1, -1):
        part = slice(x.cuts[s], x.cuts[s + 1])
        np.logaddexp.at(beta[s], x.row[part], beta[x.end[part], x.row[part]] + logp[x.piece[part]])
        k = active[s + 1]
        beta[s, :k] = np.logaddexp(beta[s, :k], beta[s + 1, :k] + np.log(UNKNOWN))
    return beta


def lots(words: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Numbers of the words in lots of like lengths, the longest first, and whether they are long."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(-sizes, kind="stable")
    edge = int((sizes > LONG).sum())
    for own, long_ in ((order[:edge], True), (order[edge:], False)):
        lot = (np.cumsum(sizes[own] + 2) - 1) // LOT
        for part in np.split(own, np.flatnonzero(np.diff(lot)) + 1) if len(own) else ():
            yield part, long_


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces, for words with counts in one language of piece probabilities p."""
    out = np.zeros(len(p))
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    for own, long_ in lots(words):
        x = pieces.lattice([words[i] for i in own])
        n = np.arange(len(own))
        start = np.repeat(np.arange(len(x.cuts) - 1), np.diff(x.cuts))
        if long_:
            alpha, beta = log_forward(x, logp), log_backward(x, logp)
            share = np.exp(alpha[start, x.row] + logp[x.piece] + beta[x.end, x.row] - alpha[x.sizes, n][x.row]) * counts[own][x.row]
        else:
            alpha, beta = forward(x, p), backward(x, p)
            share = alpha[start, x.row] * p[x.piece] * beta[x.end, x.row] * (counts[own] / alpha[x.sizes, n])[x.row]
        out += np.bincount(x.piece, weights=share, minlength=len(p))
    return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray
    pieces: Pieces
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def logs(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row a word."""
        out = np.zeros((len(words), len(self.languages)))
        for own, long_ in lots(words):
            x = self.pieces.lattice([words[i] for i in own])
            n = np.arange(len(own))
            out[own] = log_forward(x, np.log(self.p))[x.sizes, n] if long_ else np.log(forward(x, self.p)[x.sizes, n])
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, word, n) over all texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = [(lang, list(c), np.fromiter(c.values(), dtype=np.int64, count=len(c))) for lang, c in held.items()]
            held.clear()
            word = [w for _, ws, _ in rows for w in ws]
            return pd.DataFrame({"lang": np.repeat(np.array([x for x, _, _ in rows], dtype=object), [len(ws) for _, ws, _ in rows]), "word": np.array(word, dtype=object), "n": np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, _, n in rows)])})

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield flush()
        yield flush()

    return texts.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, keep, vocabulary: str | None = None, steps: int = STEPS) -> Model:
    """Learns from text and non-null lang of the rows for which keep holds.

    The driver holds a number for each language, and for each language and piece of the vocabulary.
    """
    known = docs.select("doc_id", "text", "lang").where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    pieces = Pieces(public_pieces(vocabulary))
    languages = [x for x, _ in shares]
    totals = np.array([n for _, n in shares], dtype=float)
    p = np.full((pieces.n, max(1, len(languages))), 1.0 / pieces.n)
    if languages:
        words = stored(count_words(known.select("text", "lang")))
        sc = docs.sparkSession.sparkContext
        look = sc.broadcast(pieces)
        for _ in range(steps):
            held = sc.broadcast(p)

            def expect(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                total = np.zeros_like(held.value)
                at = {x: k for k, x in enumerate(languages)}
                for pdf in batches:
                    for lang, own in pdf.groupby("lang"):  # a word counts for its own language alone
                        k = at[lang]
                        total[:, k] += expected(own["word"].tolist(), own["n"].to_numpy(dtype=float), look.value, np.ascontiguousarray(held.value[:, k]))
                piece, lang = np.nonzero(total)
                yield pd.DataFrame({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": total[piece, lang]})

            got = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
            p = np.full_like(p, PRIOR)
            p[got["piece"], got["lang"]] += got["n"]
            p /= p.sum(0)
            held.unpersist()
    return Model(languages, np.log(totals / totals.sum()) if languages else np.zeros(0), p, pieces)


class Known:
    """Values of the words that a Python worker has met, for one model; emptied when there are many."""

    def __init__(self) -> None:
        self.key, self.at, self.rows = "", {}, np.zeros((0, 0))

    def add(self, lists: list[list[str]], model: Model) -> None:
        """Works the new words of many texts together: lattices pay over thousands of words."""
        if self.key != model.key or len(self.at) > HELD_WORDS:
            self.key, self.at, self.rows = model.key, {}, np.zeros((0, len(model.languages)))
        fresh = [w for w in dict.fromkeys(w for words in lists for w in words) if w not in self.at]
        if not fresh:
            return
        begin = len(self.at)
        if begin + len(fresh) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), begin + len(fresh), 65_536), len(model.languages)))
            grown[:begin] = self.rows[:begin]
            self.rows = grown
        self.rows[begin : begin + len(fresh)] = model.logs(fresh)
        self.at.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))


_known = Known()


def guess(texts: pd.Series, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; `und` and 0 where there is no letter (or no language was learned)."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return langs, scores
    lists = [words_of(text) for text in texts]
    _known.add(lists, model)
    for i, words in enumerate(lists):
        if words:
            at = np.fromiter(map(_known.at.__getitem__, words), dtype=np.int64, count=len(words))
            z = _known.rows[at].sum(0) + model.prior
            z = np.exp(z - z.max())
            k = int(z.argmax())
            langs[i], scores[i] = model.languages[k], z[k] / z.sum()
    return langs, scores


def identify(docs: DataFrame, held_out, vocabulary: str | None = None, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from rows that aren't held out.

    held_out: a condition on doc_id. Null and empty texts and texts without letters are `und` with score 0; a null id is held
    out; a null lang teaches nothing; repeated rows get alike answers; an empty table gives no rows. Other columns aren't read.
    """
    held = F.coalesce(held_out, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held, vocabulary, steps))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, scores = [], []
            for a in range(0, len(pdf), 500):
                got = guess(pdf["text"].iloc[a : a + 500], model.value)
                langs += got[0]
                scores.append(got[1])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": np.array(langs, dtype=object), "score": np.concatenate([np.zeros(0), *scores])})

    slim = docs.select("doc_id", "text")
    out = slim.mapInPandas(label, slim.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_langid(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2)
