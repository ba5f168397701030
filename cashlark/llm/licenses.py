"""License scan by a positional index of rare words, in DataFrame functions only.

The index holds the highest-IDF word of each mandatory phrase of each licence
text, with its place in the text.  IDF comes from a pass over all documents that
counts in how many of them each licence word occurs.  A second pass looks up
where a document has index words; a word at place i that a text has at place p
is a posting of the text at offset i - p.  The postings of a text's phrases are
intersected: an offset is left only if the rare words of all its phrases stand
where that offset puts them.  At each offset left, all words of the phrases are
verified.  It is scored by the share of the text's words that stand in place,
and the best offset counts, so that strays elsewhere change nothing.  As every
phrase has a word in the index, no place where the phrases stand is missed.

Index words are found by the slot of their checksum in a constant table of about
as many slots as there are words, so that a look-up does not grow with the index.

Base phrases are counted wherever their words stand together, on their own.

All work on a document stays in its row.  Licence texts are a parameter; they
reach the tasks as constants of the plan, of at most MOST_WORDS words.  Null and
empty texts have no words; repeated rows and null ids are scanned like any
others; an empty table gives no rows; columns beside id and text are not carried.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce
from string import ascii_lowercase, ascii_uppercase
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .license_texts import BASE, TEMPLATES

#: Words that all licence texts may have together.
MOST_WORDS = 1_000_000
#: Score of a document with base phrases alone.
BASE_SCORE = 0.5
#: Postings are numbers: text, then offset moved up so that it is positive.
_SHIFT, _ZERO = 40, 1 << 39

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a text in order, on the driver."""
    return re.findall(WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def _words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; all other ASCII letters and digits as they are."""
    breaks = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
    spaced = F.translate(text, ascii_uppercase + breaks, ascii_lowercase + " " * len(breaks))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def place_of(phrase: list[str], words: list[str]) -> int:
    """Where a phrase first stands in a licence text."""
    found = [t for t in range(len(words)) if words[t : t + len(phrase)] == phrase]
    if not phrase or not found:
        raise ValueError(f"the phrase {' '.join(phrase)!r} is not part of its licence text")
    return found[0]


def parsed(templates: dict[str, tuple[str, list[str]]]) -> list[tuple[str, list[str], list[tuple[int, list[str]]]]]:
    """Name, words, and phrases with their places, of each licence text."""
    out = []
    for name, (text, phrases) in templates.items():
        words = words_of(text)
        out.append((name, words, [(place_of(p, words), p) for p in map(words_of, phrases)]))
    if sum(len(words) for _, words, _ in out) > MOST_WORDS:
        raise ValueError(f"the licence texts have more than {MOST_WORDS} words")
    return out


def rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF of each word over all documents; as many values as there are words."""
    known = F.array_distinct(F.filter(_words(text_of(text)), lambda w: w.isin(vocabulary)))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(known).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def postings(texts: list, idf: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """The index: each word that is the rarest of a phrase, with (text, number of the phrase, place in the text)."""
    found = defaultdict(list)
    for number, (_, _, phrases) in enumerate(texts):
        for nth, (at, phrase) in enumerate(phrases):
            rarest = min(range(len(phrase)), key=lambda k: (-idf[phrase[k]], phrase[k], k))
            found[phrase[rarest]].append((number, nth, at + rarest))
    return dict(found)


def _strings(words: list[str]) -> Column:
    """A constant array of words; folded once, however long."""
    return F.split(F.lit(" ".join(words)), " ")


def _numbers(values: list[int]) -> Column:
    """A constant array of numbers."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<long>") if values else F.array().cast("array<long>")


def _slots(index: dict[str, list[tuple[int, int, int]]], nth: int) -> Column:
    """Slots of the index by checksum: words with the postings that they give their texts' ``nth`` phrases."""
    slots: list[list[Column]] = [[] for _ in index]
    for word, places in index.items():
        own = _numbers([(t << _SHIFT) - p + _ZERO for t, k, p in places if k == nth])
        slots[crc32(word.encode()) % len(index)].append(F.struct(F.lit(word).alias("w"), own.alias("postings")))
    empty = F.array().cast("array<struct<w:string,postings:array<long>>>")
    return F.array(*[F.array(*s) if s else empty for s in slots])


def _found(words: Column, index: dict[str, list[tuple[int, int, int]]], texts: list) -> Column:
    """Every text and offset at which the rare words of all phrases stand in place, once."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(list(index)))
    hits = F.transform(hits, lambda h: h.withField("slot", (F.crc32(h["w"].cast("binary")) % len(index)).cast("int")))

    def of_phrases(nth: int) -> Column:
        slots = _slots(index, nth)
        here = lambda h: F.flatten(F.transform(F.filter(F.get(slots, h["slot"]), lambda s: s["w"] == h["w"]), lambda s: s["postings"]))
        return F.flatten(F.transform(hits, lambda h: F.transform(here(h), lambda v: v + h["i"])))

    left = F.array_distinct(of_phrases(0))
    sizes = [len(phrases) for _, _, phrases in texts]
    for nth in range(1, max(sizes)):
        # Texts with fewer phrases have nothing more to intersect.
        done = _numbers([t for t, size in enumerate(sizes) if size <= nth])
        kept = F.filter(left, lambda v: F.array_contains(done, F.shiftright(v, _SHIFT)))
        left = F.array_union(kept, F.array_intersect(left, of_phrases(nth)))
    return left


def _matches(words: Column, found: Column, texts: list) -> Column:
    """Of the places found those at which all mandatory phrases stand: text number and share of its words in place."""
    constants = F.array(
        *[
            F.struct(
                _strings(own).alias("words"),
                F.array(*[F.struct(F.lit(at).alias("at"), _strings(p).alias("words")) for at, p in phrases]).alias("phrases"),
            )
            for _, own, phrases in texts
        ]
    )
    number = lambda v: F.shiftright(v, _SHIFT).cast("int")
    offset = lambda v: (v.bitwiseAND((1 << _SHIFT) - 1) - _ZERO).cast("int")
    stands = lambda own, at: F.transform(own, lambda w, j: F.coalesce(F.get(words, at + j) == w, F.lit(False)))
    whole = lambda v: F.forall(
        F.get(constants, number(v))["phrases"],
        lambda p: F.forall(stands(p["words"], offset(v) + p["at"]), lambda x: x),
    )

    def scored(v):
        own = F.get(constants, number(v))["words"]
        return F.struct(number(v).alias("number"), (F.size(F.filter(stands(own, offset(v)), lambda x: x)) / F.size(own)).alias("share"))

    return F.transform(F.filter(found, whole), scored)


def _base_places(words: Column, phrase: str) -> Column:
    """Where a base phrase's words stand consecutively, from 0."""
    own = phrase.split()
    here = lambda w, i: reduce(
        lambda a,
        b: a & b,
        [w == own[0], *[F.coalesce(F.get(words, i + k) == x, F.lit(False)) for k, x in enumerate(own[1:], 1)]],
    )
    return F.array_compact(F.transform(words, lambda w, i: F.when(here(w, i), i)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, list[str]]] = TEMPLATES) -> DataFrame:
    """Per row: word count, base phrases and labels, all labels, and a score from 0 to 1."""
    texts = parsed(templates)
    in_phrases = {w for _, _, phrases in texts for _, phrase in phrases for w in phrase}
    index = postings(texts, rarity(docs, sorted(in_phrases), text))
    rows = docs.select(F.col(key).alias("own_key"), _words(text_of(text)).alias("words"))
    words = F.col("words")
    rows = rows.select(
        "own_key",
        "words",
        *[_base_places(words, phrase).alias(f"at_{label}") for phrase, label in BASE.items()],
        _found(words, index, texts).alias("found"),
    )
    rows = rows.withColumn("matches", _matches(words, F.col("found"), texts))
    places = F.concat(*[F.col(f"at_{label}") for label in BASE.values()])
    own = F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in BASE.values()])
    names = F.transform("matches", lambda m: F.get(F.array(*[F.lit(name) for name, _, _ in texts]), m["number"]))
    text_list = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return rows.select(
        F.col("own_key").alias(key),
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        text_list(own).alias("base_labels"),
        text_list(F.concat(own, names)).alias("labels"),
        F.greatest(best, F.when(F.size(places) > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )
