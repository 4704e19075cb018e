"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further columns docs has. Stages work on all
rows they get, null and repeated doc_ids included, and texts of any length are read whole. A null text counts as an
empty one; an empty table gives an empty table. Stages that run Python set the session's Arrow batches to a few MB,
unless it has a setting. What else holds is stated stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, contamination, lines, minhash, quality
from fleetlens.llm.common import dropped, new_path, scratch, small_batches, staged, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds neither junk nor abusive, unchanged.

    Null, empty and wordless texts are junk and go. Repeated rows are judged alike. Without labels the learned word
    lists are empty and the other labellers decide."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_rows(docs.select(*COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of smaller doc_id holds; n_chars follows the text.

    A document goes if no visible character is left and one earlier document holds all that it lost, or its whole text:
    it is a copy or a part of that one. Any other stays, with an empty text at worst. Rows that repeat a doc_id are one
    document and lose nothing to each other; a null doc_id loses nothing; a null text becomes empty."""
    got = lines.dedup_lines(docs, also=["lang", "source"], copies=True)
    blank = F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0
    left = got.filter(~(blank & F.col("copy_of").isNotNull()))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest doc_id.

    Null, empty and wordless texts are in no group and stay, as do rows with a null doc_id. Of rows that repeat a doc_id
    all stay or all go: they go if any of their texts is in a group of a smaller doc_id."""
    small_batches(spark)
    # staged, so that Spark knows its size before it deals the texts out
    verdict, _ = staged(minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "verdict")
    return docs.select(*COLUMNS).join(verdict, "doc_id", "left_anti")


def drop_benchmark_holders(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged.

    Null, empty and wordless texts hold none; rows with a null doc_id stay; rows that repeat a doc_id go if any of
    them holds an item."""
    small_batches(spark)
    return contamination.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit integers) of each row, with the digest of the text they decode to.

    Null and empty texts have no tokens; every row is returned, repeated and null doc_ids too."""
    import public_tokenizers

    small_batches(spark)
    got = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_holders),
    ("bpe_encoding", encode_tokens),
]

#: A fitted classifier decides in the first stage, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the last stage's table stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        dropped(spark, *before)
        before = [path]
    return docs
