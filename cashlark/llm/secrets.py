"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in whole texts by patterns; positions are code points, end
exclusive.  The hash of each candidate value is counted over the corpus by
distinct owners and repositories: a value that several owners carry is a widely
copied example, one that a single owner carries and that mixes letters and
digits looks like a live credential.

All kinds are found in the scan itself: of a text only the places and the hashes
of its candidates leave it, and values travel as hashes alone.  By default the
owner is the column ``source`` and the repository (``source``, ``lang``); with a
handful of sources "one owner" is a weak test, so name finer columns where there
are any.

Null and empty texts have no candidates; repeated rows share one result and are
each returned; rows with a null owner count as one unnamed owner; rows with a null
key count like any others.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import digest128, text_of, written

#: Base kinds in listed order: pattern, group that holds the value, least length of that group.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Kinds that count only where the value belongs to one owner and looks live.
OWNED = {
    "named": (r"""(?i)(?:[_-]key|pwd|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 16),
}
KINDS = BASE | OWNED
#: Any text with a candidate of any kind matches this.
ANY = r"""(?i:password|passwd|secret|token|api_?key|[_-]key|pwd|auth|credentials?|private_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
MASK = "[SECRET]"
KEY = ["key_id", "d1", "d2"]


def _keyed(docs: DataFrame, key: str, text: str) -> list[Column]:
    return [F.col(key).alias("key_id"), *digest128(text_of(text))]


def _matches(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """All matches of a pattern in order: the gap before each, its size, and its value as a hash."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    zipped = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"),
        sizes.alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def one(m, i):
        value = m["value"]
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.struct(
            F.lit(number).alias("kind_no"),
            i.alias("i"),
            m["gap"].alias("gap"),
            m["size"].alias("size"),
            (F.length(value) >= least).alias("long_enough"),
            mixed.alias("mixed"),
            F.sha2(value, 256).alias("secret"),
        )

    return F.transform(zipped, one)


def hits(docs: DataFrame, key: str, text: str, owner: str, repository: tuple[str, ...]) -> DataFrame:
    """Every match of every kind in the rows of ``docs``, with the row's owner and repository; texts stay in the scan."""
    unnamed = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.where(text_of(text).rlike(ANY)).select(
        *_keyed(docs, key, text),
        text_of(text).alias("t"),
        unnamed(owner).alias("owner"),
        F.struct(*[unnamed(c).alias(f"r{n}") for n, c in enumerate(repository)]).alias("repository"),
    )
    found = F.concat(*[_matches(F.col("t"), number, *how) for number, how in enumerate(KINDS.values())])
    rows = rows.select(*KEY, "owner", "repository", F.explode(found).alias("m"))
    return written(rows.select(*KEY, "owner", "repository", "m.*"), "secret-hits")


def owned(found: DataFrame) -> DataFrame:
    """``secret, repositories``: the values that one owner alone carries."""
    carriers = found.where("long_enough").select("secret", "owner", "repository").distinct()
    counts = carriers.groupBy("secret").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.count("*").alias("repositories"))
    return counts.where("least = most").select("secret", "repositories")


def spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """One row per distinct (key, text) with candidates: its spans in order of start and kind.

    ``spans`` is an array of structs: start, kind_no, end, kind, live, repositories
    (those of its one owner; null for values that several owners carry).
    """
    found = hits(docs, key, text, owner, repository)
    once = found.select(*KEY, "kind_no", "i", "gap", "size", "long_enough", "mixed", "secret").dropDuplicates([*KEY, "kind_no", "i"])
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy(*KEY, "kind_no").orderBy("i"))
    once = once.withColumn("end", upto).where("long_enough")
    once = written(
        once.select(
            *KEY,
            "kind_no",
            F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1).alias("kind"),
            (F.col("end") - F.col("size")).alias("start"),
            "end",
            "mixed",
            "secret",
        ),
        "secret-spans",
    )
    # Widely copied values are not on the right side, so they meet nothing there.
    judged = once.join(owned(found), "secret", "left").withColumn("live", F.col("mixed") & F.col("repositories").isNotNull())
    judged = judged.where(F.col("live") | (F.col("kind_no") < len(BASE)))
    return judged.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "live", "repositories"))).alias("spans")
    )


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, found: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` with the spans of their text, an empty array if none."""
    rows = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)], *_keyed(docs, key, text)).alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(found.alias("b"), same[0] & same[1] & same[2], "left").select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)],
        F.coalesce("spans", none).alias("found_spans"),
    )


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """Per row: counts by kind, a digest of the base spans, all spans, and how many look live or copied."""
    rows = _with_spans(docs, spans(docs, key, text, owner, repository), key, text, [key])
    base = F.filter("found_spans", lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter("found_spans", lambda s: s["kind"] == kind)).cast("long")
    live = F.size(F.filter("found_spans", lambda s: s["live"])).cast("long")
    return rows.select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found_spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("found_spans").cast("long") - live).alias("n_copied"),
    )


def masked(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """All rows and columns of ``docs`` with live-looking credentials replaced by a mask; other texts are unchanged."""
    rows = _with_spans(docs, spans(docs, key, text, owner, repository), key, text, docs.columns)
    live = F.filter("found_spans", lambda s: s["live"])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(done, span):
        gap = F.substr(F.col(text), (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        fresh = F.concat(done["out"], gap, F.lit(MASK))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(span["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"),
        )

    rebuilt = F.aggregate(live, start, add, lambda done: F.concat(done["out"], F.substr(F.col(text), (done["at"] + 1).cast("int"))))
    return rows.withColumn(text, F.when(F.size(live) > 0, rebuilt).otherwise(F.col(text))).select(docs.columns)
