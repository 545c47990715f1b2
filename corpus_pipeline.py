"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are replaced, sources are mixed to
their target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of `documents`. `run` writes each
stage's rows to the folder that the cluster shares and reads them as the next one's input, so a lost executor repeats one
stage at most. SQL expresses neither the learned scores nor the signatures, so there is none; tests hold the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm import bpe, mixing, neardup, secrets, toxicity
from quarrystone.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, learned from these documents and `labels`, doesn't reject."""
    return toxicity.clean(docs.select(*COLUMNS), toxicity.learn(docs, documents(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id; rows without an id stay.

    Rows that share the id of a kept document stay once for each of their texts, with the least of their other columns.
    """
    docs = docs.select(*COLUMNS)
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rest = F.min(F.struct("lang", "source", "n_chars")).alias("x")
        named = named.groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "x.*").select(*COLUMNS)
    return named.unionByName(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the text."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that share id, source, size and text share what the mix takes of them: each gets as many copies as the others, but
    that some in order of their other columns get one more.
    """
    own = docs.select(*COLUMNS).withColumn("_size", mixing.words("text")).withColumn("_text", F.xxhash64("text"))
    taken = mixing.mix(own, extra=("_text",)).groupBy("doc_id", "source", "size", "_text").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = stored(taken, "copies")
    right = taken.select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_n"), F.col("_text").alias("_t"), "copies", "rows")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_n")) & (F.col("_text") == F.col("_t"))
    found = own.join(right.hint("shuffle_hash"), same)
    times = found.where("rows = 1").withColumn("_times", F.col("copies"))
    if taken.where("rows > 1").limit(1).count():
        twins = found.where("rows > 1").groupBy(*COLUMNS, "_size", "_text", "copies", "rows").agg(F.count("*").alias("_alike"))
        running = Window.partitionBy("doc_id", "source", "_size", "_text").orderBy("lang", "n_chars", "text").rowsBetween(Window.unboundedPreceding, 0)
        upto = twins.withColumn("_upto", F.sum("_alike").over(running))

        def dealt(x: Column) -> Column:
            """Copies that the first x rows get."""
            return x * F.floor(F.col("copies") / F.col("rows")) + F.least(x, F.col("copies") % F.col("rows"))

        upto = upto.withColumn("_times", dealt(F.col("_upto")) - dealt(F.col("_upto") - F.col("_alike")))
        times = times.select(*COLUMNS, "_times").unionByName(upto.select(*COLUMNS, "_times"))
    return times.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each document's text, and whether they decode to just that text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.checked(docs.select("doc_id", "source", "text"), path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
