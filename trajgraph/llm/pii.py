"""Personal data: patterns for protected entities, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. A term is a word outside of them, or the form of
a token with digits (its length and kind of characters), as such tokens are seldom seen twice. From the whole corpus, where a text
counts once however often it is copied, two kinds of co-occurrence are estimated:

* a term and one entity: in how many texts the term stands among the REACH words around the entity. The pointwise mutual
  information is how many bits of the entity's information content a reader learns from the term;
* a term and a class of entities (each kind, and any): beside how many different entities of the class the term stands in a text;
  one text stands for all that have an entity, so near copies make no support.
  The estimate is drawn to the class's share of all texts by SMOOTHING texts, so that few sights say little.

Terms that give away more than a share of the information, with enough support, are spans of kind `term`: of one entity in every
text that has it, of a class wherever they stand. Sanitising puts the kind's name in the place of every span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajgraph.llm.common import read, small, stored

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that are its context.
REACH = 8
#: Texts in which a term must stand near an entity, different entities of a class beside which it must stand, and the share of the
#: information that it may give.
MIN_SUPPORT, MIN_ENTITIES, MOST_DISCLOSED = 2, 5, 0.6
SMOOTHING = 10.0
#: Up to so many terms of classes go to every task; beyond it all words of texts are joined with them.
MANY_TERMS = 1 << 20
HELD_WORDS = 300_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and with a look behind: the same matches as without, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", re.ASCII)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++", re.ASCII)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.ASCII)
_TERM = re.compile(r"[^\W_]+")
_HEX = frozenset("0123456789abcdef")
_DIGIT = re.compile(r"[0-9]", re.ASCII)

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from the beginning of the run before an @, but not before the end of the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by start, then in the order of KINDS."""
    if not text:
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def form(token: str) -> str:
    """A token in lower case, or, if it has digits, its kind of characters and length."""
    token = token.lower()
    if token.isalpha() or not any(c.isdigit() for c in token):
        return token
    return f"{'digits' if token.isdigit() else 'hex' if _HEX.issuperset(token) else 'mixed'}:{len(token)}"


def entity_of(text: str, span: Span) -> str:
    """The entity of a span in its normal form, after its kind."""
    kind, start, end = span
    return f"{kind}:{text[start:end].lower() if kind == 'email' else ''.join(c for c in text[start:end] if c.isdigit() or kind == 'ip')}"


def words_outside(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """All terms of a text with their places, but words in spans."""
    k, covered = 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            covered = max(covered, spans[k][2])
            k += 1
        if covered <= m.start():
            yield form(m[0]), m.start(), m.end()


def contexts(text: str, spans: list[Span], words: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """(entity, term) of the REACH words on each side of each span; words in spans are no terms."""
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    for span in spans:
        before, after = bisect_right(ends, span[1]), bisect_left(starts, span[2])
        for term, _, _ in words[max(0, before - REACH) : before] + words[after : after + REACH]:
            yield entity_of(text, span), term


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def with_entities(keyed: DataFrame) -> DataFrame:
    """(copy, check, entities, near, words) of each row whose text has an entity."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, copy, check in zip(pdf["text"], pdf["copy"], pdf["check"], strict=True):
                if spans := base_spans(text):
                    words = list(words_outside(text, spans))
                    near = {(e, t) for e, t in contexts(text, spans, words)}
                    rows.append((copy, check, sorted({entity_of(text, x) for x in spans}), [{"entity": e, "term": t} for e, t in near], [{"term": t, "start": a, "end": b} for t, a, b in words]))
            yield pd.DataFrame(rows, columns=["copy", "check", "entities", "near", "words"])

    shape = "copy long, check int, entities array<string>, near array<struct<entity:string,term:string>>, words array<struct<term:string,start:int,end:int>>"
    return keyed.select("text", "copy", "check").mapInPandas(scan, shape)


def count_terms(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(text, copies) -> (term, n): different texts that have the term; each of the copies of a text counts its part.

    Summed in each task before the shuffle. wanted: the only terms that are asked for; if they are few, no others are sent.
    """
    few = None if wanted is None else wanted.select("term").distinct().limit(MANY_TERMS + 1).toPandas()["term"].tolist()
    asked = texts.sparkSession.sparkContext.broadcast(frozenset(few) if few is not None and len(few) <= MANY_TERMS else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = [(list(c), np.fromiter(c.values(), dtype=float, count=len(c)) / copies) for copies, c in held.items()]
            held.clear()
            return pd.DataFrame({"term": np.array([t for terms, _ in rows for t in terms], dtype=object), "n": np.concatenate([np.zeros(0), *(n for _, n in rows)])})

        for pdf in batches:
            for text, copies in zip(pdf["text"], pdf["copies"], strict=True):
                if text:
                    terms = set(_TERM.findall(text.lower()))
                    odd = {t for t in terms if not t.isalpha()}
                    terms = (terms - odd).union(map(form, odd)) if odd else terms
                    held.setdefault(int(copies), Counter()).update(terms if asked.value is None else terms & asked.value)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield flush()
        yield flush()

    return texts.select("text", "copies").mapInPandas(count, "term string, n double").groupBy("term").agg(F.round(F.sum("n"), 3).alias("n"))


def beside_entities(found: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(entity, e, term, both): texts that have the entity, and those in which the term stands near it. found: one row a text."""
    near = found.select("copy", "check", F.explode("near").alias("x")).select("copy", "check", "x.entity", "x.term")
    entities = found.select("copy", "check", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("e")).where(F.col("e") >= min_support)
    return near.join(entities, "entity").groupBy("entity", "e", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_support)


def beside_classes(found: DataFrame, min_entities: int = MIN_ENTITIES) -> tuple[DataFrame, DataFrame]:
    """(kind, term, both) and (kind, entities): different entities of a kind, or of any (`any`), beside which a term stands, and all.

    A text counts for the least of its entities of a kind, and of texts of one such entity the least of (copy, check) counts.
    """
    kind = F.substring_index("entity", ":", 1)
    each = found.select("copy", "check", F.explode("entities").alias("entity")).select("copy", "check", "entity", F.explode(F.array(kind, F.lit("any"))).alias("kind"))
    least = each.groupBy("copy", "check", "kind").agg(F.min("entity").alias("entity"))
    chosen = stored(least.groupBy("kind", "entity").agg(F.min(F.struct("copy", "check")).alias("text")).select("kind", "text.*"))
    terms = chosen.join(found.select("copy", "check", F.array_distinct("words.term").alias("terms")), ["copy", "check"]).select("kind", F.explode("terms").alias("term"))
    pairs = terms.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_entities)
    return pairs, chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))


def of_entities(pairs: DataFrame, terms: DataFrame, texts: int, most: float = MOST_DISCLOSED) -> DataFrame:
    """(entity, term, bits, share): terms near one entity that give away too much of it.

    terms: (term, n), the texts that have a term; texts: their number.
    """
    bits = F.log2(F.col("both") * F.lit(float(texts)) / (F.col("e") * F.greatest("n", "both")))
    own = F.log2(F.lit(float(texts)) / F.col("e"))
    return pairs.join(terms, "term").select("entity", "term", bits.alias("bits"), F.try_divide(bits, own).alias("share")).where(F.col("share") > most)


def of_classes(pairs: DataFrame, entities: DataFrame, terms: DataFrame, texts: int, most: float = MOST_DISCLOSED, smoothing: float = SMOOTHING) -> DataFrame:
    """(kind, term, bits, share): terms that give away too much of the fact that a text has an entity of a kind, or any."""
    base = entities.select("kind", (F.col("entities") / F.lit(float(texts))).alias("p"))
    given = (F.col("both") + smoothing * F.col("p")) / (F.greatest("n", "both") + smoothing)
    bits = F.log2(given / F.col("p"))
    scored = pairs.join(F.broadcast(base), "kind").join(terms, "term")  # base: a row a kind
    return scored.select("kind", "term", bits.alias("bits"), F.try_divide(bits, -F.log2("p")).alias("share")).where(F.col("share") > most)


def places_of(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """keyed without its text, with its base spans and the places of the terms (one column) outside of them."""
    shape = keyed.drop("text").withColumns({"base": F.lit(None).cast(_SPANS), "terms": F.lit(None).cast(_SPANS)})
    few = terms.limit(MANY_TERMS + 1).toPandas()["term"].tolist()
    known = frozenset(few) if len(few) <= MANY_TERMS else None
    held = keyed.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [base_spans(text) for text in pdf["text"]]
            found = [[] for _ in spans]
            if held.value:
                # Most texts have none of the terms: their words alone tell that.
                some = [bool(t) and not held.value.isdisjoint(map(form, set(_TERM.findall(t)))) for t in pdf["text"]]
                found = [[("term", a, b) for w, a, b in words_outside(t, s) if w in held.value] if ok else [] for t, s, ok in zip(pdf["text"], spans, some, strict=True)]
            yield pdf.drop(columns=["text"]).assign(base=[_structs(x) for x in spans], terms=[_structs(x) for x in found])

    out = keyed.mapInPandas(scan, shape.schema)
    if known is not None:
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(copy, check, t, a, b) for text, copy, check in zip(pdf["text"], pdf["copy"], pdf["check"], strict=True) if text for t, a, b in words_outside(text, base_spans(text))]
            yield pd.DataFrame(rows, columns=["copy", "check", "term", "start", "end"])

    words = keyed.select("text", "copy", "check").mapInPandas(each, "copy long, check int, term string, start int, end int").join(terms.distinct(), "term")
    return out.drop("terms").join(gathered(words, "terms"), ["copy", "check"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(_SPANS)))


def gathered(words: DataFrame, name: str) -> DataFrame:
    """(copy, check, start, end) -> spans of kind `term` of each text."""
    one = F.struct(F.lit("term").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return words.groupBy("copy", "check").agg(F.collect_set(one).alias(name))


def detect(docs: DataFrame, min_support: int = MIN_SUPPORT, most: float = MOST_DISCLOSED) -> DataFrame:
    """doc_id, copy, check, base and spans (arrays of kind, start, end; spans are base and term spans, by start) of every document.

    copy and check are hashes of the text. Null texts are empty; repeated rows are found alike and count as one text in the corpus;
    an empty table gives no rows. Other columns of docs are not read.
    """
    keyed = docs.select("doc_id", "text", *keys())
    copies = stored(keyed.groupBy("copy", "check").agg(F.count(F.lit(1)).alias("copies")))
    texts = copies.count()
    found = stored(with_entities(keyed).dropDuplicates(["copy", "check"]))
    near = stored(beside_entities(found, min_support))
    beside, entities = beside_classes(found)
    beside = stored(beside)
    weighed = keyed.join(small(copies.where(F.col("copies") > 1)), ["copy", "check"], "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    terms = stored(count_terms(weighed, near.select("term").union(beside.select("term"))))
    pairs = stored(of_entities(near, terms, texts, most).select("entity", "term"))
    classes = stored(of_classes(beside, entities, terms, texts, most).select("term").distinct())
    # Words that an entity in the same text makes a term.
    held = found.select("copy", "check", F.explode("entities").alias("entity")).join(pairs, "entity").select("copy", "check", "term").distinct()
    words = found.select("copy", "check", F.explode("words").alias("x")).select("copy", "check", "x.*").join(held, ["copy", "check", "term"])
    merged = places_of(keyed, classes).join(gathered(words, "own"), ["copy", "check"], "left").withColumn("all", F.concat("base", F.array_union("terms", F.coalesce("own", F.array().cast(_SPANS)))))
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate((*KINDS, "term")) for x in (kind, k)])
    by_start = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return merged.select("doc_id", "copy", "check", "base", F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def keys() -> list:
    """Two hashes of a text, 96 bits."""
    return [F.xxhash64("text").alias("copy"), F.hash("text").alias("check")]


def sanitise(docs: DataFrame, min_support: int = MIN_SUPPORT, most: float = MOST_DISCLOSED) -> DataFrame:
    """docs with every span of text (overlapping ones as one) replaced by its kind's name in brackets; other columns stay.

    Null texts stay null; repeated rows become alike; an empty table gives no rows.
    """
    spans = detect(docs, min_support, most).where(F.size("spans") > 0).select(F.col("copy").alias("_copy"), F.col("check").alias("_check"), F.col("spans").alias("_spans")).dropDuplicates(["_copy", "_check"])

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, found, strict=True):
            if text is None or own is None:
                out.append(text)
                continue
            parts, end = [], 0
            for s in own:
                if s["start"] >= end:
                    parts += [text[end : s["start"]], f"[{s['kind']}]"]
                end = max(end, s["end"])
            out.append("".join(parts) + text[end:])
        return pd.Series(out, dtype=object)

    copy, check = keys()
    rows = docs.withColumns({"_copy": copy, "_check": check}).join(spans, ["_copy", "_check"], "left")
    return rows.withColumn("text", replaced("text", "_spans")).select(*[f"`{c}`" for c in docs.columns])


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8_pii(spark, sf_dir):
    found = detect(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
