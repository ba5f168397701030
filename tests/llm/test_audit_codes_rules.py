"""Source divergence, vector codes and repetition rules against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cashlark.llm import codes, divergence, repetition

WORDS = ["the", "The", "a", "Ünï", "ünï", "exactly8", "ninechars", "sixteen_letters".replace("_", "x"), "seventeenletters7".replace("7", "y"), "é" * 9, "z" * 40, "z" * 41]


def term_lists(rows):
    return [[t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")] for *_, text in rows]


def audited(rows, least_docs=3, top=200):
    """The audit by its definition; rows are (lang, source, text)."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    terms = term_lists(rows)
    seen, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), found in zip(rows, terms):
        counts[lang, source].update(found)
        whole[lang].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q = shares(whole[lang])
        ps = {s: shares(counts[lang, s]) for g, s in counts if g == lang}
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in ps.items():
            pair = [(sum(f(p[t], o[t]) for t in kept), other) for other, o in ps.items() if other != s]
            term = [(f(p[t], q[t]), t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, rank + 1))
    return out


def documents(spark, rows):
    """Documents with further columns, named as columns that the operators use."""
    schema = "lang string, source string, text string, n int, docs int, term string, w1 string"
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], schema)


def some_documents(seed, n=120):
    rng = random.Random(seed)
    own = WORDS + ["".join(rng.choices("abcé", k=rng.randint(1, 20))) for _ in range(40)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), " ".join(rng.choices(own, k=rng.randint(0, 30))) + rng.choice(["", "!", "1"])) for _ in range(n)]
    return [*rows, ("en", "silent", None), ("en", "silent", ""), ("de", "one", "alone"), ("de", "two", "alone too"), *[("it", "hot", "same same text")] * 40]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_is_as_defined(spark, monkeypatch, small):
    if small:  # several tiles and blocks, and tasks that give out early
        for name, value in (("TILE_SOURCES", 2), ("TILE_TERMS", 5), ("HELD", 10)):
            monkeypatch.setattr(divergence, name, value)
    rows = some_documents(7)
    got = [tuple(r) for r in divergence.audit(documents(spark, rows), top=5).collect()]
    assert set(got) == audited(rows, top=5) and len(got) == len(set(got))


def test_divergence_of_no_rows(spark):
    assert divergence.audit(documents(spark, [])).count() == 0


def test_radix_order_is_that_of_lexsort():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, k, 5000, dtype=np.uint64) for k in (3, 1 << 20, (1 << 64) - 1)]
    assert (divergence.radix_order(keys) == np.lexsort(keys)).all()


def test_long_division_of_shares(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (5, 7), (10**15, 3 * 10**15), (10**12 - 1, 10**12), (0, 9 * 10**15)]
    want = [1 + 10**9 * (n + 1) // w for n, w in cases]
    assert divergence.shares(*np.array(cases).T).tolist() == want
    got = spark.createDataFrame(cases, "n long, w long").select("n", "w", divergence.share(F.col("n"), F.col("w")).alias("p")).collect()
    assert {(r["n"], r["w"]): r["p"] for r in got} == dict(zip(cases, want))


def compressed(rows, parts, entries, rounds):
    """Codes by their definition; rows are (id, vector of whole numbers / 256, label)."""
    whole = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    size = len(whole[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((gap(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for v in cut:
            for p, part in enumerate(v):
                members[p][near(p, part)[1]].append(part)
        books = [[tuple(sum(c) // len(members[p][k]) for c in zip(*members[p][k])) if members[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    found = [[near(p, part) for p, part in enumerate(v)] for v in cut]
    error = [sum(g for g, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(whole, error):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(whole, found, error))


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, entry int, code string")


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_codes_are_as_defined(spark, monkeypatch, rounds):
    monkeypatch.setattr(codes, "RESIDENTS", 50)
    rng = random.Random(rounds)
    rows = [(i, [rng.choice([-2.5, -0.001, 0.0, 0.3, 1.7]) + rng.randint(-9, 9) / 256 for _ in range(8)], rng.choice([1, 2, None])) for i in range(200)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1), *[(1000 + i, [0.5] * 8, 3) for i in range(100)]]
    odd = [(2000, None, 1), (2001, [None] + [0.1] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (2004, [0.1] * 7, 1), (2005, [], 1)]
    got = codes.compress(embeddings(spark, rows + odd).repartition(5), parts=4, entries=6, rounds=rounds)
    assert Counter(tuple(r) for r in got.collect()) == compressed(rows, 4, 6, rounds)


def test_codes_of_few_and_no_rows(spark):
    rows = [(1, [0.5, 1.0], 1), (2, [0.25, -1.0], None)]
    got = codes.compress(embeddings(spark, rows), parts=2)
    assert Counter(tuple(r) for r in got.collect()) == compressed(rows, 2, 64, 2)
    assert codes.compress(embeddings(spark, [(1, None, 1)])).count() == 0
    assert codes.compress(embeddings(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_nearest_entries_of_large_numbers_are_exact():
    entries = np.array([[0, 0], [(1 << 29) + 1, 0], [1 << 29, 0], [1 << 29, 0]])
    at, gap = codes.nearest(np.array([[1 << 29, 1], [(1 << 29) + 1, 0]]), entries)
    assert at.tolist() == [2, 1] and gap.tolist() == [1, 0]
    with pytest.raises(OverflowError):
        codes.whole_parts(np.array([[1e300, 0.0]]), 2)


def measured(text):
    """Measures and verdict of a text by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines, seen, later = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), []
    for line in lines:
        if line in seen:
            later.append(line)
        seen.add(line)
    chars = lambda line: sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
    out |= {"n_lines": len(lines), "n_dup_lines": len(later), "dup_line_chars": sum(map(chars, later))}
    for n in (3, 5, 6, 7, 8, 9, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, met, under = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1 and n == 3 or g in met:
                under |= set(range(i, i + n))
            met.add(g)
        if n == 3:
            out["n_repeat_words"] = len(under)
        else:
            out[f"dup_chars_{n}"] = sum(len(words[i]) for i in under)
    failed = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    bad = out["dup_line_chars"] >= 100 and (out["dup_line_chars"] * 100 > 20 * out["word_chars"] or out["n_dup_lines"] * 100 > 30 * out["n_lines"])
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    bad = bad or any(out[f"dup_chars_{n}"] >= 100 and out[f"dup_chars_{n}"] * 100 > p * out["word_chars"] for n, p in limits.items())
    return out, failed, not failed and not bad


def texts_with_repeats(seed, n=60):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "word", "a b \x1c c", "x\r\nx\r\nx", "\n".join(["one line said again and again"] * 60)]
    for _ in range(n):
        own = ["".join(rng.choices("abé€😀", k=rng.randint(1, 9))) for _ in range(rng.choice([2, 30, 400]))]
        sentence = " ".join(rng.choices(own, k=rng.randint(3, 25)))
        lines = [rng.choice([sentence, " ".join(rng.choices(own, k=rng.randint(0, 30)))]) for _ in range(rng.randint(1, 30))]
        out.append(rng.choice(["\n", "\n\n", " \n"]).join(lines) + rng.choice(["", "\n", " #*<"]))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_repetition_is_as_defined(spark, monkeypatch, collide):
    texts = texts_with_repeats(11)
    if collide:  # all windows share one hash, so blocks are compared exactly
        monkeypatch.setattr(repetition, "mixed", lambda x: np.zeros(len(x), np.uint64))
        assert all(repetition.measures([t or ""])[m][0] == measured(t)[0][m] for t in texts for m in repetition.MEASURES)
        return
    rows = [*enumerate(texts), (None, texts[-1]), (0, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, n_words string, whole_text int")
    got = repetition.judged(docs).collect()
    want = [(key, *[measured(t)[0][m] for m in repetition.MEASURES], *measured(t)[1:]) for key, t in rows]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {r["kept"] for r in got} == {True, False} and any(not r["kept"] and not r["base_failed"] for r in got)
    kept = repetition.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_repetition_of_no_rows(spark):
    assert repetition.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
