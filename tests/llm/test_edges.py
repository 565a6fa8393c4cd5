"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from paysheaf.llm import bpe, imatch, language_model, licenses, mixing, near, passages, pieces, quality, records, secret_scan, simhash, spelling, toxicity

SCHEMA = (
    "doc_id bigint, text string, company string, lang string, source string, n_chars bigint, row int, key string, size int, attempts int, "
    "n int, fingerprint string, start int, blob string, copies int, before int, kept boolean, term bigint, held_out string, words string"
)
LONG = " ".join(f"salário{i % 977} base{i % 31}" for i in range(15_000))
PAGE = " ".join(f"item{i} valor{i * 7 % 113}" for i in range(60))


def rows(*pairs):
    return [(i, t, c, "pt", c, None if t is None else len(t), 1, "k", 2, 1, 3, "f", 4, "b", 5, 6, True, 7, "h", "w") for i, t, c in pairs]


EDGES = rows(
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "a"), (5, PAGE, "b"), (5, PAGE, "b"), (6, PAGE, "b"), (7, "x", None),
    (None, PAGE, "c"), (8, "token = abcdefgh12 MIT License", "c"), (9, "é  ß 😀 \x00", "c"), (10, "recibo", "b"), (10, "outro recibo", "b"),
)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def labels(docs):
    ids = docs.select("doc_id").distinct()
    return ids.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


OPERATORS = {
    "passages": passages.shared_passages,
    "licenses": licenses.licenses,
    "quality": quality.judged,
    "quality_carry": lambda d: quality.judged(d, carry=True),
    "secrets": secret_scan.secrets,
    "cleaned": secret_scan.cleaned,
    "mixture": mixing.mixture,
    "repeated": mixing.repeated,
    "imatch": imatch.compared,
    "imatch_prints": imatch.fingerprints,
    "simhash": simhash.near_duplicates,
    "first_of_groups": simhash.first_of_groups,
    "bpe": lambda d: bpe.encoded(d, TOKENIZER),
    "pieces": lambda d: pieces.encoded(d, PIECES),
    "piece_digests": lambda d: pieces.digests(d, PIECES),
    "spelling": lambda d: spelling.variants(spelling.word_counts(spelling.runs(d))),
    "near": near.near_duplicates,
    "near_first": near.first_of_groups,
    "toxicity": lambda d: toxicity.judged(d, labels(d)),
    "language_model": language_model.scored,
}
# rows that leave by each operator's own rule
ALL = {"licenses", "quality", "quality_carry", "secrets", "cleaned", "mixture", "imatch_prints", "simhash", "bpe", "pieces", "piece_digests", "toxicity", "language_model"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    docs = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    found = OPERATORS[name](docs).collect()
    if name in ALL:
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    docs = spark.createDataFrame(rows((None, None, None), (None, None, None), (1, None, None)), SCHEMA)
    found = OPERATORS[name](docs).collect()
    if name in ALL:
        assert len(found) == 3


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    out = stage(spark, docs, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    out.collect()
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_document_text_joins_pages_in_order(spark):
    pages = spark.createDataFrame([("a", 2, "zwei"), ("a", 1, "eins"), ("b", 1, None)], "doc_id string, page int, text string")
    assert {r["doc_id"]: r["text"] for r in records.document_text(pages).collect()} == {"a": "eins\nzwei", "b": ""}
