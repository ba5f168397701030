"""The whole pipeline against what its stages are to do, one document at a time."""

from pyspark.sql import functions as F
from test_text_operators import WORDS, remaining, similar_classes
from tokenizers import Tokenizer

import corpus_pipeline
from cashlark.llm import quality, secrets
from cashlark.sources.scratch import made

SF = "/root/testdata/sf0.001"


def stored(spark, folder, docs):
    """A folder with these documents and the labels of the test data."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_equals_its_stages(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    top = docs.agg(F.max("doc_id")).first()[0]
    again = docs.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + top + 1)  # whole copies
    docs = docs.unionByName(again)
    folder = stored(spark, tmp_path, docs)
    before = made()
    found: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert len([p for p in made() if p not in before]) == 1  # only the last stage's result is left
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in good), key=lambda r: r["doc_id"])
    left = remaining([r["text"] for r in rows], 50)
    texts = {r["doc_id"]: left[i] for i, r in enumerate(rows)}
    some = [i for i, t in texts.items() if t is not None]
    distinct: dict = {}
    for i in some:
        distinct.setdefault(texts[i], i)
    classes = similar_classes(list(distinct))
    firsts = list(distinct.values())
    kept = {firsts[c] for c in classes} | {i for i, t in texts.items() if t is None}
    assert set(found) == kept and len(kept) < len(good) < docs.count()
    frame = spark.createDataFrame(
        [(r["doc_id"], texts[r["doc_id"]], r["lang"], r["source"], 0) for r in rows if r["doc_id"] in kept],
        docs.schema,
    )
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(frame).collect()}
    coder = Tokenizer.from_file(WORDS)
    for i, pieces in found.items():
        ids = coder.encode(masked[i] or "", add_special_tokens=False).ids
        assert {p["doc_tokens"] for p in pieces} == {len(ids) + 1} == {sum(p["length"] for p in pieces)}


def test_pipeline_takes_empty_and_single_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "none", docs.limit(0))).count() == 0
    one = docs.orderBy("doc_id").limit(1).withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "one", one)).count() <= 1
