"""Text operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cashlark.llm import bpe, licenses, lines, neardup, packing, quality, secrets

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[i], 0) for i, t in enumerate(texts)], DOCS)


ODD = [
    None,
    "",
    "a",
    "don't stop 12 ½ naïve ÉCOLE",
    "İstanbul ΣΑΣ ﬁ é",
    "<|endoftext|>x <|ENDOFTEXT|>",
    "中文字 🙂!!\x1c\x85  z",
    "x" * 5000,
    "'ll'sx !'s rq",
]


def test_ids_and_text_equal_the_library(spark):
    coder = Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    letters = list("abqxzrevlstm'\"!.,;:_-*/0123 \t\n\r\x0béèßÀÉÇ×÷µª½ĀΣσжñ中🙂́") + ["'s", "'re", "<|endoftext|>", "the"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    frame = docs(spark, texts)
    found = {r["doc_id"]: r for r in bpe.digests(frame, WORDS).collect()}
    back = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(frame, WORDS), WORDS).collect()}
    for i, t in enumerate(texts):
        ids = coder.encode(t or "", add_special_tokens=False).ids
        text = coder.decode(ids, skip_special_tokens=False)
        assert back[i] == (ids, text)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="differ"):
        bpe.ForcedBoundaryEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_replaces_a_clashing_column_and_takes_empty_tables(spark):
    frame = docs(spark, ["a b"]).withColumn("ids", F.lit("old"))
    assert bpe.encode(frame, WORDS).dtypes[-1] == ("ids", "array<int>")
    assert bpe.encode(frame.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("rest", range(0, 4096, 97))
def test_pieces_fill_their_slots(rest):
    sizes = packing.cut_sizes(rest, 4096)
    assert sum(sizes) == rest and all(s == 4096 // (4096 // s) for s in sizes)


@pytest.mark.parametrize("whole", [False, True])
def test_packing_is_whole_and_gapless(spark, whole):
    texts = [
        None,
        "",
        *[" ".join(["word"] * n) for n in (1, 5, 63, 64, 300, 2047, 4095, 4096, 9000)],
        "same",
        "same",
        *["a b c"] * 900,
        *[" ".join(["word"] * (1000 + n)) for n in range(40)],
    ]
    coder = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs(spark, texts).repartition(3), WORDS, whole=whole).collect()
    own: dict = {}
    places: dict = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    assert set(own) == set(range(len(texts)))
    for i, pieces in own.items():
        ids = coder.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and (not whole or len(pieces) == -(-at // 4096))
    for pieces in places.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack(docs(spark, ["a"]).limit(0), WORDS, whole=whole).count() == 0


def test_packing_with_odd_keys_and_columns(spark):
    rows = [(None, "a b", 1), (None, "a b", 1), (2, "c", 2), (2, "d " * 20_000, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, worker int").withColumns(
        {"fits": F.lit("x"), "length": F.lit("y"), "nth": F.lit(0)}
    )
    found = packing.pack(frame, WORDS).collect()
    assert sum(r["length"] for r in found) == 3 + 3 + 2 + 20_001 and sum(r["doc_id"] is None for r in found) >= 2


def remaining(texts, least):
    """Brute force: lines of runs that an earlier place has too are deleted if the run has enough words."""
    split = {i: t.split("\n") for i, t in enumerate(texts) if t is not None}
    gone = {i: set() for i in split}
    places: dict = {}
    for i, own in split.items():
        for n, line in enumerate(own):
            places.setdefault(line, []).append((i, n))
    for i, own in split.items():
        for n in range(len(own)):
            best = 0
            for j, m in places[own[n]]:
                if (j, m) >= (i, n):
                    break
                other, k = split[j], 0
                while n + k < len(own) and m + k < len(other) and own[n + k] == other[m + k]:
                    k += 1
                best = max(best, k)
            if best and sum(len(x.split()) for x in own[n : n + best]) >= least:
                gone[i].update(range(n, n + best))
    return {
        i: "\n".join(x for n, x in enumerate(own) if n not in gone[i]) if gone[i] else texts[i]
        for i, own in split.items()
    } | {i: None for i, t in enumerate(texts) if t is None}


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 23)
    monkeypatch.setattr(lines, "FAN", 3)
    rng = random.Random(3)
    texts = [None, "", "", *["\n".join(rng.choice(["a a", "b b", "c c", "d", ""]) for _ in range(rng.randint(1, 20))) for _ in range(30)]]
    texts += [texts[5], texts[6], "a a", "a a", texts[7], texts[5]]  # copies of whole texts
    frame = docs(spark, texts).withColumn("n_lines", F.lit("clash"))
    found = {r["doc_id"]: r["text"] for r in lines.dedup(frame, least_words=6).collect()}
    assert found == remaining(texts, 6)


def test_lines_with_odd_keys(spark):
    run = "\n".join(f"line {i} of a passage" for i in range(12))
    rows = [
        (None, run, "x"),
        (None, run, "x"),
        (2, f"start\n{run}", "y"),
        (2, f"start\n{run}", "y"),
        (3, run, "z"),
        (4, None, "n"),
        (None, None, "n"),
        (5, f"start\n{run}\n" + "long " * 50_000, "w"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d1 string").withColumns({"gone": F.lit(1), "row": F.lit(2)})
    out = lines.dedup(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_deleted"]
    found = sorted((r["doc_id"] or 0, r["d1"], r["text"]) for r in out.where("text is not null").collect())
    assert found == [
        (0, "x", run),
        (0, "x", run),
        (2, "y", "start"),
        (2, "y", "start"),
        (3, "z", ""),
        (5, "w", "long " * 50_000),
    ] and out.count() == 8


def test_lines_without_repeats_stay(spark):
    frame = docs(spark, ["a b c", "d e f"])
    assert {r["text"] for r in lines.dedup(frame, least_words=1).collect()} == {"a b c", "d e f"}
    assert lines.dedup(frame.limit(0)).count() == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_banded_alignment_is_exact_within_its_band():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.07]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        if not b:
            continue
        n = common(a, b)
        least = neardup.SIMILAR / (1 + neardup.SIMILAR) * (len(a) + len(b))
        found = neardup.aligned(a, b, int(len(a) + len(b) - 2 * least) + 1)
        assert found <= n and (n < least or found == n)


def test_near_duplicates_share_a_class(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    far = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts = [
        " ".join(base),
        " ".join(near),
        " ".join(far),
        " ".join(base),
        None,
        None,
        "",
        "",
        "one two",
        "one two three",
        " ".join(reversed(base)),
    ]
    found = {r["doc_id"]: r for r in neardup.classes(docs(spark, texts)).collect()}
    assert [found[i]["class_id"] for i in range(len(texts))] == [0, 0, 2, 0, 4, 5, 6, 6, 8, 9, 10]
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs(spark, texts)).collect()) == [0, 2, 4, 5, 6, 8, 9, 10]
    assert neardup.classes(docs(spark, ["a"]).limit(0)).count() == 0


def boilerplate_pair():
    """A text whose paragraphs are each followed by one and the same passage, and its copy without the first of these."""
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    again = words(40)
    parts = [p for _ in range(12) for p in (words(40), again)]
    return " ".join(parts), " ".join([parts[0], *parts[2:]])


def test_repeated_passages_align_as_by_brute_force(spark):
    whole, short = boilerplate_pair()
    grams = lambda t: list(zip(*[t.split()[i:] for i in range(neardup.WORDS)]))
    a, b = grams(whole), grams(short)
    n = common(a, b)
    assert neardup.similarity(neardup.kmers(whole), neardup.kmers(short)) == n / (len(a) + len(b) - n) > 0.9
    assert [r["class_id"] for r in neardup.classes(docs(spark, [whole, short])).orderBy("doc_id").collect()] == [0, 0]


def test_short_near_copies_are_all_found(spark):
    rng = random.Random(13)
    short = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(8)) for _ in range(200)]
    texts = [t for s in short for t in (s, f"{s} more")]  # 4 of 5 k-mers
    found = neardup.classes(docs(spark, texts)).collect()
    assert [r["doc_id"] for r in found if r["class_id"] != r["doc_id"] - r["doc_id"] % 2] == []


def license_scan(text: str | None, templates=licenses.TEMPLATES) -> dict:
    """The whole result for one text by trying every offset of every licence text."""
    words = licenses.words_of(text or "")
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    labels, score = {x for _, x in places}, licenses.BASE_SCORE if places else 0.0
    for name, own, phrases in licenses.parsed(templates):
        for i in range(len(words)):
            start = i - phrases[0][0]
            if all(start + p >= 0 and words[start + p : start + p + len(phrase)] == phrase for p, phrase in phrases):
                labels.add(name)
                score = max(score, sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(own)) / len(own))
    base = {
        "n_words": len(words),
        "n_base": len(at),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted({x for _, x in places})),
    }
    return base | {"labels": ",".join(sorted(labels)), "score": score}


def test_licences(spark):
    texts = [
        None,
        "",
        "Released under the MIT License.",
        "MIT\nlicense apache-license GENERAL public LICENSE; mit license",
        "mit licenses, a license mit",
        "Licensed under CC BY-NC 4.0.",
        "cc by and nc 4 0",
        "word " * 3000 + "Licensed under the Apache License, Version 2.0",
    ]
    found = {r["doc_id"]: r.asDict() for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = license_scan(t)
        assert {k: found[i][k] for k in want} == want
        assert 0 <= found[i]["score"] <= 1 and set(filter(None, want["base_labels"].split(","))) <= set(found[i]["labels"].split(","))
    assert found[5]["labels"] == "cc-by-nc-4.0" and found[6]["labels"] == "" and found[2]["labels"] == "mit,mit-notice" and found[7]["labels"] == "apache,apache-2.0"


def test_licence_labels_equal_brute_force(spark):
    rng = random.Random(29)
    parts = [text for text, _ in licenses.TEMPLATES.values()] + ["", "word", "mit", "license the gnu", "public software licensed under"]
    texts = []
    for _ in range(60):
        chosen = [rng.choice(parts).split() for _ in range(rng.randint(1, 3))]
        for own in chosen:
            if own and rng.random() < 0.5:  # a word more, another, or one less
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = rng.choice([["changed"], []])
        texts.append(" ".join(w for own in chosen for w in own))
    frame = docs(spark, texts).withColumns({"words": F.lit("x"), "votes": F.lit(1), "matches": F.lit(2)})
    found = {r["doc_id"]: r.asDict() for r in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        want = license_scan(t)
        assert {k: found[i][k] for k in want} == pytest.approx(want), (t, want)
    assert licenses.scan(frame.union(frame).where("doc_id = 3")).count() == 2 and licenses.scan(frame.limit(0)).count() == 0


def test_licence_texts_are_a_parameter(spark):
    own = {"house": ("You may use this tool at home only", ["at home only"])}
    rows = licenses.scan(
        docs(spark, ["x you may use this tool at home only y", "at home only", "use at home"]),
        templates=own,
    ).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["house", "house", ""] and rows[0]["score"] == 1
    with pytest.raises(ValueError, match="not part"):
        licenses.scan(docs(spark, ["x"]), templates={"house": ("a b", ["c"])})


def test_licences_by_their_best_place(spark):
    loose, notice = "available under the mit license", "released under the mit license"
    texts = [
        loose,
        f"{loose} as it was released before",
        f"{loose} and {notice}",
        f"{notice} and {loose}",
        f"released {loose}",
        "mit license " * 4000 + notice,
    ]
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [found[i]["labels"] for i in range(len(texts))] == ["mit,mit-notice"] * len(texts)
    assert [found[i]["score"] for i in range(len(texts))] == [0.8, 0.8, 1, 1, 0.8, 1]


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def test_secrets(spark):
    texts = [
        None,
        "",
        "password=token:abcdefghij",
        'é🙂 API_KEY : "abcdefgh1" AKIAABCDEFGHIJKL1 AKIASHORT',
        "token=token=abcdefgh " + "0af" * 11,
        "a" * 40 + " secret = 'short'",
        'token = "shared99aa" x',
        'token = "shared99aa" y',
        'db_key="abcdefghij1234567890"',
    ]
    sources = ["s", "s", "s", "s", "s", "s", "s", "other", "s"]
    rows = docs(spark, texts, sources)
    found = {r["doc_id"]: r for r in secrets.scan(rows.union(rows.where("doc_id = 3"))).collect()}
    for i, t in enumerate(texts):
        want = sorted(
            (m.start(), k, m.end(), name)
            for k, (name, p, group, least) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m[group]) >= least
        )
        text = ",".join(f"{name}:{a}:{b}" for a, _, b, name in want)
        assert found[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
        assert [found[i][f"n_{n}"] for n, *_ in PATTERNS] == [sum(w[3] == n for w in want) for n, *_ in PATTERNS]
    assert (found[6]["n_live"], found[6]["n_copied"]) == (0, 1) and found[8]["spans"] == "named:2:28"
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(rows).collect()}
    assert masked[6] == texts[6] and masked[0] is None and "abcdefgh1" not in masked[3] and masked[3].startswith("é🙂 [SECRET]")


def test_secrets_with_odd_keys_and_columns(spark):
    held = 'token = "abcd1234efgh"'
    rows = [(None, held, None, "en"), (None, held, None, "en"), (2, "x " * 100_000 + held, None, None), (3, None, "s", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns(
        {"d1": F.lit("a"), "t": F.lit("b"), "kind": F.lit("c"), "secret": F.lit("d"), "spans": F.lit("e")}
    )
    found = sorted((r["doc_id"] or 0, r["n_assign"], r["n_live"]) for r in secrets.scan(frame).collect())
    assert found == [(0, 1, 1), (0, 1, 1), (2, 1, 1), (3, 0, 0)]
    masked = secrets.masked(frame)
    assert masked.columns == frame.columns and masked.where("text like '%abcd1234%'").count() == 0
    assert secrets.scan(frame.limit(0)).count() == 0


def added_spans(texts, owners):
    """Brute force: which values of the method's own kind one owner alone carries and look live."""
    name = re.compile(r"""(?:[_-]key|pwd|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    carriers: dict = {}
    for text, owner in zip(texts, owners):
        for _, p, group, least in PATTERNS:
            for m in p.finditer(text):
                if len(m[group]) >= least:
                    carriers.setdefault(m[group], set()).add(owner)
        for m in name.finditer(text):
            if len(m[1]) >= 16:
                carriers.setdefault(m[1], set()).add(owner)
    live = lambda v: len(carriers[v]) == 1 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    return [[f"named:{m.start()}:{m.end()}" for m in name.finditer(t) if len(m[1]) >= 16 and live(m[1])] for t in texts]


def test_spans_of_the_method_equal_brute_force(spark):
    rng = random.Random(23)
    values = [f"{rng.randrange(16**12):x}{'aZ9'[i % 3] * 8}" for i in range(60)]
    texts = [
        " ".join(rng.choice(["db_key = ", "auth:", "PWD='", "x-key=", "é "]) + rng.choice(values) for _ in range(rng.randint(1, 4)))
        for _ in range(40)
    ]
    owners = [f"s{rng.randrange(6)}" for _ in texts]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs(spark, texts, owners)).collect()}
    want = added_spans(texts, owners)
    assert any(want) and [[x for x in found[i].split(",") if x.startswith("named")] for i in range(len(texts))] == want


def test_quality_on_held_out_rows(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    found = quality.classify(table, labels).join(labels, "doc_id").where("held_out")
    good = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert good >= 0.9


def test_rules_as_columns_equal_rules_by_hand(spark):
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    stats = quality.with_statistics(table, ["doc_id"])
    model = quality.fit(stats, labels)
    assert len(model.rules) == len(model.weights) > 3
    for row in stats.withColumn("score", model.score()).collect():
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            total += weight * all(row[name] <= at if at_most else row[name] > at for name, at_most, at in rule)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "good words in a row" if i % 2 else "!! || ??", 0.5) for i in range(60)] + [
        (None, "good words", 0.1),
        (7, "good words in a row", 0.2),
        (61, "long text " * 100_000, 0.3),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumns(
        {"log_words": F.lit("x"), "row": F.lit(1), "whole_text": F.lit("y")}
    )
    found = quality.classify(frame, labels)
    assert found.count() == len(rows) and found.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality.kept(frame, labels)
    assert kept.columns == frame.columns and kept.where("text like 'good%'").count() >= 30
    assert quality.classify(frame.limit(0), labels).count() == 0


def test_quality_without_labels(spark):
    rows = docs(spark, [None, "", "some text"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality.classify(rows, none).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert quality.kept(rows.withColumn("label", F.lit("clash")), one).count() == 3


def similar_classes(texts):
    """Brute force: the smallest place of each text's class, by alignment of all pairs."""
    def kmers(text):
        words = text.split()
        return list(zip(*[words[i:] for i in range(neardup.WORDS)])) if len(words) >= neardup.WORDS else [tuple(words)] if words else [text]

    grams = [kmers(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            least = neardup.SIMILAR / (1 + neardup.SIMILAR) * (len(a) + len(b))
            if len(set(a) & set(b)) >= least - 1e-9 and common(a, b) >= least - 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("block", "kmers"), [(4096, 1 << 20), (7, 300)])
def test_classes_equal_brute_force(spark, monkeypatch, block, kmers):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_KMERS", kmers)
    rng = random.Random(17)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for size, copies in ((60, 60), (90, 60), (200, 20), (12, 60), (40, 1)):
        base = [fresh() for _ in range(size)]
        for _ in range(copies):  # pairs of copies lie on both sides of the limit
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = [fresh()]
            texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, texts)).collect()}
    want = similar_classes(texts)
    assert 5 < len(set(want)) < len(texts)
    assert [found[i] for i in range(len(texts))] == want


def test_near_duplicates_of_repeating_texts(spark):
    """Texts of boilerplate, of few words, and of periods, each with a copy that differs a little."""
    rng, pairs = random.Random(41), []
    for n in range(60):
        own = [f"p{n}w{i}" for i in range(rng.choice([3, 4, 6, 200]))]
        some = lambda k, own=own: rng.choices(own, k=k)
        again = some(rng.randint(5, 30))
        kinds = [
            lambda: [w for _ in range(rng.randint(3, 8)) for w in some(rng.randint(5, 40)) + again],
            lambda: some(rng.randint(30, 200)),
            lambda: (some(rng.randint(7, 20)) * 40)[: rng.randint(60, 200)],
        ]
        text = kinds[n % 3]()
        other = list(text)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(other))
            other[at : at + rng.choice([0, 1, 4])] = rng.choice([[], ["changed"], again[:3]])
        pairs.append((" ".join(text), " ".join(other)))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [t for pair in pairs for t in pair])).collect()}
    near = [n for n, (a, b) in enumerate(pairs) if neardup.similarity(neardup.kmers(a), neardup.kmers(b)) >= 0.8]
    assert len(near) > 20 and all(found[2 * n] == found[2 * n + 1] for n in near)


def test_a_line_common_to_most_texts_is_no_run(spark):
    rng = random.Random(43)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, run = "all rights reserved by all", "\n".join(words(20) for _ in range(4))
    texts = ["\n".join([words(9), common, words(9), *([run, common] if n % 7 == 0 else []), common]) for n in range(150)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs(spark, texts)).collect()}
    for n, text in enumerate(texts):
        if n % 7 or n == 0:
            assert got[n] == text
        else:
            assert run not in got[n] and got[n].split("\n")[:3] == text.split("\n")[:3]


def test_near_duplicates_with_odd_keys_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (None, "a b c d e f", 1, "x"),
        (None, "a b c d e f", 1, "x"),
        (3, "a b c d e f", 2, "y"),
        (4, long, 3, "z"),
        (5, long + " end", 4, "z"),
        (5, long + " end", 4, "z"),
        (None, None, 5, "n"),
        (7, None, 6, "n"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d1 int, row string").withColumns(
        {"t": F.lit("t"), "node": F.lit(0), "first": F.lit("f")}
    )
    found = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_copies"], r["kept"]) for r in neardup.classes(frame).collect())
    assert found == [
        (0, 0, 1, True),
        (0, 3, 3, False),
        (0, 3, 3, False),
        (3, 3, 3, True),
        (4, 4, 1, True),
        (5, 4, 2, False),
        (5, 4, 2, False),
        (7, 7, 1, True),
    ]
    left = neardup.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["d1"]) for r in left.collect()) == [(0, 5), (3, 2), (4, 3), (7, 6)]


def test_licence_phrases_are_intersected_among_many_templates(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    templates = {}
    for n in range(300):
        own = rng.choices(words, k=rng.randint(4, 30))
        cuts = sorted(rng.sample(range(len(own)), 3))
        templates[f"t{n}"] = (" ".join(own), [" ".join(own[cuts[0] : cuts[0] + 2]), " ".join(own[cuts[1] : cuts[2]]), " ".join(own[-2:])][: rng.randint(1, 3)])
    texts = []
    for _ in range(60):
        parts = [rng.choice([t for t, _ in templates.values()]).split() for _ in range(2)]
        mixed = [w if rng.random() > 0.05 else rng.choice(words) for w in rng.choices(words, k=5) + parts[0] + parts[1]]
        texts.append(" ".join(mixed))
    found = {r["doc_id"]: r.asDict() for r in licenses.scan(docs(spark, texts), templates=templates).collect()}
    for i, t in enumerate(texts):
        want = license_scan(t, templates)
        assert {k: found[i][k] for k in want} == pytest.approx(want)
