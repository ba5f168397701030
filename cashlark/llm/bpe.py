"""Byte-pair encoding by forced boundaries, and decoding.

A byte pair that occurs inside no token of the vocabulary can never be joined
by a merge, so a cut between the two bytes is certain.  The normalised bytes of
many texts are cut at all such pairs at once (one table look-up per byte); the
distinct fragments of a block are encoded once each, independently of their
surroundings, and the ids are put back in text order.

The ids equal those of the tokenizers library with ``add_special_tokens=False``
and truncation and padding unused.  Null and empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_batches

#: Bytes of text that are cut and looked up together.
BLOCK_BYTES = 4 << 20
#: Fragments that a worker remembers; the memory is emptied when it is full.
CACHED_FRAGMENTS = 400_000
#: Longer fragments are encoded each time and not remembered.
CACHED_BYTES = 64

# The rules of tokenizer files that cuts and shortcuts here rely on.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL_RULES = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}

NO_CUT, CUT_AT_END, CUT_INSIDE = 0, 1, 2
#: Lower-case ASCII and Latin-1 letters in UTF-8.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
#: Words that the tokenizer's own pattern ends wherever they stand.
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
_WHITE = frozenset(b" \t\n\r")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pairs_in_vocabulary(vocabulary, suffix: str) -> np.ndarray:
    """A 256 x 256 table: whether any token has the two bytes side by side."""
    to_byte, seen = byte_alphabet(), np.zeros(65536, bool)
    for token in vocabulary:
        raw = [to_byte[c] for c in token.removesuffix(suffix) if c in to_byte]
        for a, b in zip(raw, raw[1:]):
            seen[a * 256 + b] = True
    return seen


def cut_kinds(seen: np.ndarray) -> np.ndarray:
    """What each byte pair marks: no cut, a cut where a word ends, a cut inside a word.

    Of the pairs that no token holds, only those are used whose effect on the
    word-end mark follows from the two bytes alone: white space on either side,
    or two printable ASCII bytes.  An apostrophe on the left is left alone, as
    contractions depend on what stands before it.
    """
    kinds = np.zeros(65536, np.uint8)

    def kind_of(byte: int) -> str:
        c = chr(byte)
        return "letter" if c.isalpha() else "digit" if c.isdigit() else "mark"

    for a in range(256):
        for b in range(256):
            at = a * 256 + b
            if seen[at]:
                continue
            if a in _WHITE or b in _WHITE:
                kinds[at] = CUT_AT_END if not 0x80 <= b < 0xC0 else NO_CUT
            elif 33 <= a < 127 and 33 <= b < 127 and a != ord("'"):
                left, right = kind_of(a), kind_of(b)
                if left != right or left == "digit":
                    kinds[at] = CUT_AT_END
                elif b != ord("'") and (a, b) not in {(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}:
                    kinds[at] = CUT_INSIDE
    return kinds


def check_rules(spec: dict) -> None:
    """Raise if a tokenizer file has other rules than those that cuts rely on."""
    other = [name for name, rule in RULES.items() if spec.get(name) != rule]
    other += [f"model.{name}" for name, rule in MODEL_RULES.items() if spec["model"].get(name) != rule]
    if other:
        raise ValueError(f"forced boundaries are not known for this tokenizer file: {', '.join(other)} differ")


class ForcedBoundaryEncoder:
    """Encodes many texts at once with one tokenizer file, which must have the rules that ``check_rules`` asks for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check_rules(spec)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        plain = {**spec, "added_tokens": [], "truncation": None, "padding": None}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(json.dumps({**plain, "model": {**spec["model"], "end_of_word_suffix": None}}))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.has_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.kinds = cut_kinds(pairs_in_vocabulary(spec["model"]["vocab"], self.suffix))
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.whole.id_to_token(i) or "").encode() for i in range(size)]
        self.shown = {b: c for c, b in byte_alphabet().items() if chr(b) != c}
        self.known: dict[bytes, bytes] = {}

    def _encode_end(self, fragment: bytes) -> bytes:
        """A fragment at whose end a word ends; a run of letters is one word and goes straight to the merges."""
        if LETTERS(fragment):
            ids = [t.id for t in self.plain.model.tokenize(fragment.decode("latin-1").translate(self.shown))]
        else:
            ids = self.plain.encode(fragment.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_inside(self, fragment: bytes) -> bytes:
        """A fragment whose last word goes on behind the cut, so that it bears no word end."""
        words = [w for w, _ in self.plain.pre_tokenizer.pre_tokenize_str(fragment.decode())]
        ids: list[int] = []
        for i, word in enumerate(words):
            goes_on = i == len(words) - 1 and word not in CONTRACTIONS
            ids += [t.id for t in (self.inner if goes_on else self.plain).model.tokenize(word)]
        return np.array(ids, "<u4").tobytes()

    def _ids_of(self, fragments: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [f for f in fragments if f not in known]
        if missing:
            if len(known) + len(missing) > CACHED_FRAGMENTS:
                known.clear()
                missing = fragments
            found = {f: self._encode_end(f) for f in missing}
            known.update((f, i) for f, i in found.items() if len(f) <= CACHED_BYTES)
            return [found[f] if f in found else known[f] for f in fragments]
        return [known[f] for f in fragments]

    def _normal(self, text: str) -> bytes:
        """Normalised UTF-8 of a text; Latin-1 needs only lower case, for the rest the library's rules run."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.plain.normalizer.normalize_str(text).encode()
        return text.lower().encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset at which each text's ids begin."""
        odd = {i for i, t in enumerate(texts) if self.has_special and "<" in t and self.has_special.search(t)}
        parts = [b"" if i in odd else self._normal(t) for i, t in enumerate(texts)]
        ids, offsets = self._encode_block(parts)
        if odd:
            each = [
                np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if i in odd else ids[offsets[i] : offsets[i + 1]]
                for i, t in enumerate(texts)
            ]
            ids, offsets = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, offsets

    def _encode_block(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(parts) + b" "
        raw = np.frombuffer(data, np.uint8)
        kinds = self.kinds[raw[:-1].astype(np.uint16) * 256 + raw[1:]]
        cuts = np.flatnonzero(kinds)
        edges = np.concatenate([[0], cuts + 1, [len(raw)]]).astype(np.int32)
        kept = ~np.isin(raw[edges[:-1]], list(_WHITE))
        column = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data)])
        coded = column.filter(pa.array(kept)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        fragments = coded.dictionary.to_pylist()
        values = self._ids_of(fragments)
        inside = np.concatenate([kinds[cuts], [CUT_AT_END]])[kept] == CUT_INSIDE
        if inside.any():
            distinct, back = np.unique(codes[inside], return_inverse=True)
            codes = codes.copy()
            codes[inside] = len(values) + back
            values = values + [self._encode_inside(fragments[c]) for c in distinct]
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        each = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(firsts[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else flat[:0]
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        return ids, ends[np.searchsorted(edges[:-1][kept], starts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded ids: without a decoder the library joins tokens by spaces."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encoded(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and the ids of each text of an Arrow batch."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    coder = encoder(path)
    for first, last in blocks(texts):
        ids, offsets = coder.encode(texts[first:last])
        for i in range(last - first):
            yield first + i, ids[offsets[i] : offsets[i + 1]]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the token ids of each whole text as ``array<int>``.

    Null texts count as empty and get an empty array.  An existing column named
    as ``ids`` is replaced.
    """
    arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            rows = [x.astype(np.int32) for _, x in encoded(batch, text, tokenizer)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded_docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids decode to the empty text."""
    arrow_batches(encoded_docs.sparkSession)
    kept = [c for c in encoded_docs.columns if c != text]
    schema = T.StructType([*(encoded_docs.schema[c] for c in kept), T.StructField(text, T.StringType())])

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)).decode() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text])

    return encoded_docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, token count, and SHA-256 of ids and of the decoded text.

    Ids and decoded texts never leave the task that made them, so the job is a
    scan without a shuffle.
    """
    arrow_batches(docs.sparkSession)
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for _, ids in encoded(batch, text, tokenizer):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)
