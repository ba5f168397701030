"""Archives, embeddings and the pipeline against brute force."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cashlark.llm import archives, capfilters, graph, neighbours
from cashlark.llm.vectors import usable


def test_archives_read_back_what_they_hold(spark):
    html = ["a\r\n\r\nWARC/1.1\r\nb", None, "", "é\x00\n", "a\r\n\r\nWARC/1.1\r\nb", "x" * 100_000]
    pages = [(i, None if i == 2 else f"http://h/{i} x", h) for i, h in enumerate(html)] + [(None, "u", "only")]
    rows = archives.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    found = {r["page_id"]: r for r in rows}
    first: dict = {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        first.setdefault(data, i)
        assert found[i]["payload_bytes"] == len(data)
        assert found[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (found[i]["record_type"], found[i]["refers_to"]) == (("response", None) if first[data] == i else ("revisit", first[data]))


def test_small_payloads_are_not_shared(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r["record_type"] for r in archives.round_trip(pages, least_bytes=3).collect()} == {"response"}


# Two files as other software wrote them: by the examples of the format's description.
BODY = b"HTTP/1.1 200 OK\r\n\r\nhi\n"
ARC_1 = (
    b"filedesc://IA-001102.arc 0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html 202\n"
    + b"HTTP/1.0 200 Document follows\nDate: Mon, 04 Nov 1996 14:21:06 GMT\nServer: NCSA/1.4.1\nContent-type: text/html Last-modified: Sat,10 Aug 1996 22:33:11 GMT\nContent-length: 30\n\n<HTML>\nHello World!!!\n</HTML>".ljust(202, b"x")
    + b"\nhttp://a/with blank 127.0.0.1 1996 text/html %d\n" % len(BODY)
    + BODY
    + b"\ndns:www.dryswamp.edu 127.0.0.1 19961104142103 text/dns 8\n20001231\n"
)
LATIN = "HTTP/1.1 200 OK\r\n\r\nna\u00efve \u00e9t\u00e9".encode("latin-1")
ARC_2 = (
    b"filedesc://two.arc 0 20010923142103 text/plain 200 - - 0 two.arc 121\n2 0 Alexa Internet\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    + b"http://b/ 127.0.0.1 20010923142104 text/html 200 abc - 209 two.arc %d\n" % len(LATIN)
    + LATIN
    + b"\nhttp://c/ 127.0.0.1 20010923142105 text/html 404 abd http://d/ 400 two.arc %d\n" % len(BODY)
    + BODY
    + b"\n"
)


def test_both_versions_are_parsed():
    one, two = (list(archives.arc_entries(d)) for d in (ARC_1, ARC_2))
    assert [(h["URL"], h["Archive-date"], len(b)) for _, h, b in one] == [
        (b"http://www.dryswamp.edu:80/index.html", b"19961104142103", 202),
        (b"http://a/with blank", b"1996", len(BODY)),
        (b"dns:www.dryswamp.edu", b"19961104142103", 8),
    ]
    assert [(h["URL"], h["Result-code"], h["Location"], b) for _, h, b in two] == [
        (b"http://b/", b"200", b"-", LATIN),
        (b"http://c/", b"404", b"http://d/", BODY),
    ]
    assert {h["Archive"] for _, h, _ in one + two} == {b"IA-001102.arc", b"two.arc"}
    assert all(data[at:].startswith(h["URL"]) for data, found in ((ARC_1, one), (ARC_2, two)) for at, h, _ in found)


@pytest.mark.parametrize(
    "data",
    [
        ARC_1[:-5],
        ARC_1.replace(b"text/html 202", b"text/html 190"),
        ARC_2.replace(b"two.arc 121", b"two.arc x"),
        ARC_1.replace(b"\n1 0 Alexa", b"\n7 0 Alexa"),
        b"no archive",
    ],
)
def test_wrong_lengths_and_lines_raise(data):
    with pytest.raises(ValueError, match="at \\d+"):
        list(archives.arc_entries(data))


def test_foreign_archives_are_converted(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(ARC_1)
    # A gzip member for each record.
    starts = [0, *(at for at, _, _ in archives.arc_entries(ARC_2)), len(ARC_2)]
    (tmp_path / "arc" / "two.arc.gz").write_bytes(b"".join(gzip.compress(ARC_2[a:b]) for a, b in zip(starts, starts[1:])))
    runs = []
    for run in ("x", "y"):
        archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / run))
        entries = []
        for file in sorted((tmp_path / run).glob("part-*")):
            entries += list(archives.warc_entries(gzip.decompress(file.read_bytes())))
        runs.append(
            sorted(
                (h["warc-type"], h.get("warc-target-uri"), h["warc-date"], h["warc-record-id"], b)
                for h, b in entries if h["warc-type"] != b"warcinfo"
            )
        )
        assert entries[0][0]["warc-type"] == b"warcinfo" and b"format: WARC" in entries[0][1]
        later = next(h for h, _ in entries if h["warc-type"] == b"revisit")
        first = next(h for h, _ in entries if h["warc-record-id"] == later["warc-refers-to"])
        assert (later["warc-refers-to-target-uri"], later["warc-refers-to-date"]) == (first["warc-target-uri"], first["warc-date"])
    assert runs[0] == runs[1]
    kinds = {uri: (kind, date, block) for kind, uri, date, _, block in runs[0]}
    assert kinds[b"http://b/"] == (b"response", b"2001-09-23T14:21:04Z", LATIN)
    assert kinds[b"dns:www.dryswamp.edu"] == (b"resource", b"1996-11-04T14:21:03Z", b"20001231")
    assert kinds[b"http://a/with blank"] == (b"response", b"1996-01-01T00:00:00Z", BODY)
    assert kinds[b"http://c/"] == (b"revisit", b"2001-09-23T14:21:05Z", BODY[:-3])
    rows = archives.with_originals(archives.read_warc(spark, str(tmp_path / "x"))).collect()
    assert len(rows) == 5 and all(r["bytes"] > 0 for r in rows)


def test_archives_are_closed_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 5000)
    pages = spark.createDataFrame(
        [(i // 2, f"http://h/{i}", "x" * 1000) for i in range(40)],
        "page_id long, url string, html string",
    ).coalesce(1)
    archives.write_arc(pages, str(tmp_path / "arc"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "arc").glob("part-*")]
    assert len(sizes) > 6 and max(sizes) < 8000
    rows = archives.round_trip(pages).collect()
    assert sum(
        r["record_type"] == "response"
        for r in rows
    ) == 1 and {r["refers_to"] for r in rows} == {None, 0} and len({r["record_id"] for r in rows}) == 40
    assert archives.round_trip(pages.limit(0)).count() == 0


def vectors(spark, seed, n, copies=True):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 16))
    v[n // 2 :] = v[: n - n // 2] + 0.02 * rng.standard_normal((n - n // 2, 16))
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], i % 3) for i in range(n)]
    rows = [(i, x, (i % (n // 2)) % 3) for i, x, _ in rows]
    if copies:
        rows += [
            (n, rows[0][1], 0),
            (n + 1, rows[0][1], None),
            (n + 2, None, 0),
            (n + 3, [0.0] * 16, 0),
            (n + 4, [float("nan")] * 16, 0),
            (n + 5, [None] * 16, 0),
        ]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 8)
    rows, frame = vectors(spark, 1, 200)
    sound = {
        i: (np.array(v, float), label)
        for i, v, label in rows if v and None not in v and np.isfinite(v).all() and any(v) and label is not None
    }
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in sound.items():
        for j, (b, y) in sound.items():
            if i != j and x == y and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
    seen = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += links[k]
    found = {r["vec_id"]: r for r in capfilters.near_duplicates(frame).collect()}
    assert {i: found[i]["n_links"] for i in links} == {i: len(x) for i, x in links.items()}
    assert {i: found[i]["component_id"] for i in links} == seen
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(9)
    for n, k in ((1, 0), (30, 20), (30, 200)):
        x, y = (rng.integers(0, n, k) for _ in range(2))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        forest = capfilters.spanning_links(n, x[order], y[order])

        def labels(edges):
            label = list(range(n))
            for _ in range(n):
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        assert labels(forest) == labels(list(zip(x, y))) and len(forest) == n - len(set(labels(forest)))


@pytest.mark.parametrize("n", [500, 50_000, 3_000_000, 200_000_000])
def test_near_vectors_share_a_filter(n):
    """Pairs at the limit itself: of 2,000 at cosine 0.98 nearly all are candidates, whatever the size of the code."""
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    parts, size = capfilters.code_shape(n)
    turn, codes = capfilters.rotation(64, 11), capfilters._codes(64, size, parts)
    one, two = capfilters.decode(a, turn, codes), capfilters.decode(0.98 * a + np.sqrt(1 - 0.98**2) * b, turn, codes)
    assert (one[:, :, None] == two[:, None, :]).any((1, 2)).mean() >= 0.99


def test_odd_vectors(spark):
    near = [1.0, 0.0, 0.0]
    rows = [
        (1, near, 0),
        (1, near, 0),
        (2, near, 0),
        (3, [1.0, 0.01, 0.0], 0),
        (4, near[:2], 0),
        (None, near, 0),
        (5, near, 1),
        (6, near, None),
        (7, [0.0, 1.0, 0.0], 0),
    ]
    frame = spark.createDataFrame(
        rows,
        "vec_id long, embedding array<double>, label int",
    ).withColumns({"node": F.lit("x"), "weight": F.lit(1)})
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(frame).collect())
    assert found == [
        (0, 4, 1, False),
        (1, 4, 1, True),
        (1, 4, 1, True),
        (2, 4, 1, False),
        (3, 4, 1, False),
        (4, 0, 4, True),
        (5, 0, 5, True),
        (6, 0, 6, True),
        (7, 0, 7, True),
    ]


def test_decoding_lists_the_best_filters():
    unit = np.random.default_rng(3).standard_normal((20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = capfilters._codes(12, 9)
    found = capfilters.decode(unit, np.eye(12), codes)
    scores = [unit[:, 4 * p : 4 * p + 4] @ codes[p].T for p in range(3)]
    whole = (scores[0][:, :, None, None] + scores[1][:, None, :, None] + scores[2][:, None, None, :]).reshape(20, -1)
    assert (found == np.sort(np.argsort(-whole, axis=1)[:, : capfilters.CAPS], axis=1)).all()


def test_search_finds_the_nearest(spark):
    rows, frame = vectors(spark, 2, 300)
    sound = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    found: dict = {}
    for r in neighbours.search(frame, F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q in (i for i in sound if i % 10 == 0):
        best = sorted(((-float(v @ sound[q]), i) for i, v in sound.items() if i != q))[:20]
        own = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - sound[q] @ sound[r["vec_id"]]) < 1e-12 for r in own)
        hits += len({i for _, i in best} & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 20 * len(found)


def exact_nearest(sound, queries, k=20):
    ids = np.array(sorted(sound))
    values = np.array([sound[i] for i in ids])
    for q in queries:
        scores = values @ sound[q]
        order = np.lexsort((ids, -scores))
        yield q, [int(i) for i in ids[order] if i != q][:k]


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    sound = {
        r["vec_id"]: np.array(r["embedding"], float)
        for r in table.collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])
    }
    found: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    queries = [i for i in sound if i % 20 == 0]
    assert set(found) == set(queries) and len(queries) >= 50
    hits = sum(len(found[q] & set(best)) for q, best in exact_nearest(sound, queries))
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize("scan", [20, 16_384])
def test_search_with_ties_repeats_and_odd_rows(spark, monkeypatch, scan):
    monkeypatch.setattr(neighbours, "SCAN", scan)
    v = lambda *x: [float(n) for n in x]
    rows = [(i, v(1, 0, i % 2)) for i in range(40)] + [
        (0, v(1, 0, 0)),
        (0, v(5, 0, 0)),
        (None, v(9, 9, 9)),
        (50, v(1, 0)),
        (60, None),
        (70, [None, 1.0, 2.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "list": F.lit(1)})
    found: dict = {}
    for r in neighbours.search(frame, F.col("vec_id").isin(0, 1, 50, 60) | F.col("vec_id").isNull(), waves=(0.0, 1.0)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 1}
    assert [x[1] for x in sorted(found[1])] == [0, *range(3, 40, 2)][:20]
    assert all(x[1] != 0 for x in found[0]) and len(found[0]) == 20


def test_parts_hold_all_lists(monkeypatch):
    monkeypatch.setattr(neighbours, "SCAN", 10)
    assert neighbours.scan_parts([(0, 4), (1, 6), (2, 25), (3, 1), (4, 10)]) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 1)]


def test_few_or_no_vectors(spark):
    _, frame = vectors(spark, 4, 8, copies=False)
    assert neighbours.search(frame, F.lit(True)).count() == 8 * 7
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0
    assert capfilters.near_duplicates(frame.limit(0)).count() == 0
    assert frame.where(usable("embedding")).count() == 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    ends = {x for a, b in edges if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in ends}


@pytest.mark.parametrize("place", range(4))
def test_stages_return_documents(spark, place):
    name, stage = corpus_pipeline.STAGES[place]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    out = stage(spark, table, "/root/testdata/sf0.001")
    assert out.columns == table.columns, name
    assert 0 < out.count() <= table.count()
    if place == 2:
        assert out.select("text").distinct().count() == out.count()
