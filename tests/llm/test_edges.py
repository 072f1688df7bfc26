"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from ledgerkit.llm import (
    decontaminate, jaccard, lexical, licenses, lines, lshforest, packing, prefixes, quality, repeats, secrets, shards,
    toxicity,
)

LONG = "the quick brown fox jumps over a lazy dog. " * 3000
ROWS = [
    (1, "some words that are here for the test of it", "en", 1, 1),
    (1, "some words that are here for the test of it", "en", 1, 1),
    (2, None, None, None, 2), (None, "a text without an id", "en", 2, 3), (None, None, None, None, None),
    (3, "", "en", 0, 4), (4, "   \n\n ", "en", 3, 5), (5, LONG, "en", len(LONG), 6), (6, LONG, "en", len(LONG), 7),
    (7, "Ärger über 你好 \U0001f600 x", "de", 9, 8), (7, "another text under the same id", "en", 9, 9),
]
# Names that operators use inside or return.
SCHEMA = "doc_id long, text string, lang string, n_chars long, score long"
LABELS = [(1, 1, 0), (1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (3, 0, 0), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def scored(df, labels):
    stats = df.select("doc_id", quality.features(F.col("text")).alias("x"))
    return quality.predict(stats, quality.train(stats, labels, "doc_id", "x", "quality"), "x")


OPERATORS = {
    "quality": lambda d, x: scored(d, x),
    "jaccard": lambda d, x: jaccard.groups(d),
    "licenses": lambda d, x: licenses.matches(d),
    "repeats": lambda d, x: repeats.remove(d),
    "packing": lambda d, x: packing.pack(d),
    "shards": lambda d, x: shards.shuffle(d, 4),
    "lines": lambda d, x: lines.judge(d.select("doc_id", "text"), lines.train(d, x)),
    "toxicity": lambda d, x: toxicity.predict(d.select("doc_id", "text"), toxicity.train(d, x)),
    "secrets": lambda d, x: secrets.judge(secrets.findings(d), secrets.train(secrets.weak_labels(secrets.findings(d)))),
    "decontaminate": lambda d, x: decontaminate.matches(d, x.select(
        F.col("doc_id").alias("item_id"), F.lit("words that are here for the test").alias("text"))),
    "prefixes": lambda d, x: prefixes.trie(d.withColumns({"conv_id": F.col("doc_id"), "turn": F.col("n_chars"), "role": F.col("lang")})),
    "lexical": lambda d, x: lexical.search(lexical.build(d), d.select(F.col("doc_id").alias("item_id"), "text")),
    "lshforest": lambda d, x: lshforest.groups(d),
}
PER_ROW = ["quality", "jaccard", "lshforest", "repeats", "shards", "lines", "toxicity"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    if name in ("quality", "toxicity"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels.limit(0)).collect() == []


def test_odd_rows_of_jaccard(docs):
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.groups(docs).collect()}
    assert found[1, 6] == 1 and found[2, 0] == 2 and found[3, 0] == 3 and found[4, 0] == 4
    assert found[5, 9] == found[6, 9] == 5
    assert found[None, 1] is None and found[None, 0] is None
    assert found[7, 1] == 7 and found[7, 2] == 7


def test_odd_rows_of_the_forest(docs):
    found = {(r["doc_id"], r["n_shingles"]): r for r in lshforest.groups(docs).collect()}
    assert found[5, 9]["component_id"] == found[6, 9]["component_id"] == 5 and not found[6, 9]["kept"]
    assert found[None, 2]["component_id"] is None and found[None, 2]["kept"] and found[3, 0]["kept"]


def test_odd_rows_of_repeats(docs):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in repeats.remove(docs).collect()}
    assert rows[5, len(LONG)]["n_removed"] == len(LONG) and rows[5, len(LONG)]["kept"] == ""
    assert rows[2, 0]["n_spans"] == 0 and rows[1, 43]["n_removed"] == 0


def test_odd_rows_of_lines(docs, labels):
    rows = {r["doc_id"]: r for r in OPERATORS["lines"](docs, labels).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[5]["base_failed"]  # one sentence over and over


def test_pipeline_stages_keep_the_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of that kind"), (2, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert packed.select(F.countDistinct("doc_id")).first()[0] <= len(ROWS)
