"""Corpus pipeline: quality rules, near copies, secrets, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next one starts, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import mixing, pieces, quality, secrets, trie_join
from murmuration.session import prepare, stage_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts fail; a very long text costs its own row. Other nulls play no part, repeated
    rows are judged alike and all stay, columns beyond those of documents are dropped.
    """
    return docs.select(*COLUMNS).where(quality.passes())


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Ties (a missing or shared doc_id) go to the smaller digest of the text, a missing doc_id comes last;
    rows alike in doc_id and text are one row. Empty texts, were there any left, have no copies and stay.
    """
    return trie_join.one_of_each(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars that of the new text.

    A null text stays null with a null n_chars, an empty one is unchanged; repeated rows stay and are
    masked alike; missing ids are allowed.
    """
    masked = secrets.mask_secrets(docs.select(*COLUMNS))
    return masked.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated or left out so that sources come near their targets.

    A null source is a source, the last one. Texts without words take no room and are not taken.
    Repeated rows are one document with as many copies as they are granted together.
    """
    return mixing.mixture(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mixture, copies included.

    A null or empty text has no pieces; one of any length is encoded whole.
    """
    return pieces.encode_documents(docs, pieces.read_model(), keep=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# Piece encoding has no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = stage_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
