"""Retrieval: BM25 over terms, exact vectors, rank fusion, and matching of product metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators import packs, postings
from quarrystone.sources import shared

K1, B = 1.2, 0.75
TERM = r"[\p{L}\p{N}]+"
#: Numbers of all query vectors (of 8 bytes) up to which they are broadcast to the rows.
NUMBERS = 4_000_000
#: Terms of all queries, and queries, up to which they are sent to all tasks.
VOCABULARY, ASKED = 100_000, 10_000


def terms(c: Column) -> Column:
    """Lower-case terms; runs of Han characters as overlapping pairs."""
    text = F.lower(c)
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pairs = F.transform(words, lambda w: F.when(w.rlike(r"\p{IsHan}{2}"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w)))
    return F.when(text.rlike(r"\p{IsHan}{2}"), F.flatten(pairs)).otherwise(words)  # texts without such runs keep their words as they are


def query_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[\s,，;；、|/]+"), lambda t: t != ""))


def bm25(docs: DataFrame, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: docs (doc_id, text) by BM25 against queries (query_id, text).

    Null texts count as empty documents. Texts are read once, for the terms of the queries if a count has shown these to be few; packs of
    documents then go to packs of queries, and only each query's k best of a pack move. Rows that share an id and a length are one document
    of all their terms; those that share an id alone count apart, and their scores are summed.
    within (doc_id): the documents that may be found; statistics are of all.
    """
    known, wanted, few = _counted(docs, queries)
    known = shared.stored(known, "counted")
    stats = known.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    again = docs.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    several = None
    if again.limit(1).count():  # ids alone are cheap to compare
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        several = known.join(again, same, "left_semi").select("doc_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("doc_id", "length", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").cast("int").alias("tf"))
        several = several.groupBy("doc_id", "length").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
        known = known.join(again, same, "left_anti").unionByName(several)
    df = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").crossJoin(F.broadcast(stats)).groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", idf.alias("idf")))).alias("asked"))  # stats is one row
    asked = postings.asked(asked.coalesce(1) if few else asked)
    if within is not None:
        known = known.join(within, "doc_id", "left_semi")
    each = known.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", F.array_repeat("length", F.size("terms")).alias("lengths"))
    if several is not None:
        own = each.join(again, same, "left_semi").groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "tfs", "lengths")])
        each = each.join(again, same, "left_anti").unionByName(own)
    pairs = postings.packed(each).crossJoin(F.broadcast(asked) if few else asked).crossJoin(F.broadcast(stats.select("mean")))
    scored = postings.best(pairs, k, K1, B).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _counted(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """postings.counted of docs; query_id, term of queries; and whether queries and their terms are few: terms are then numbers in both."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    found = sorted(r.term for r in wanted.select("term").distinct().limit(VOCABULARY + 1).collect())
    few = len(found) <= VOCABULARY and queries.limit(ASKED + 1).count() <= ASKED
    known = postings.counted(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")), found if few else None)
    if few:
        places = docs.sparkSession.createDataFrame(list(enumerate(found)), "place int, term string")
        wanted = wanted.join(F.broadcast(places), "term").select("query_id", F.col("place").alias("term"))
    return known, wanted, few


def answered(docs: DataFrame, queries: DataFrame, within: DataFrame) -> DataFrame:
    """query_id of the queries for which bm25 finds a document: those that share a term with one, since each such term has a score above zero.

    Documents are cut into terms where they are read; neither statistics nor scores are needed.
    """
    known, wanted, _ = _counted(docs, queries)
    held = known.select("doc_id", "terms").join(within, "doc_id", "left_semi").select(F.explode("terms").alias("term")).distinct()
    return wanted.join(held, "term", "left_semi").select("query_id").distinct()


def cosine_top(rows: DataFrame, queries: DataFrame, k: int, own: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine of queries (query_id, q) against all rows (vec_id, v), both of doubles.

    Packs of queries go to all packs of rows; rows are never paired with each other. own: whether a query may find the row of its own id.
    Each pack keeps its k best of a query before rows move. Queries are broadcast if a count of numbers has shown them to be small.
    A vector of zeros has the cosine NaN, which comes first, as in SQL.
    """
    few = (queries.agg(F.sum(F.greatest(F.size("q"), F.lit(1)))).first()[0] or 0) <= NUMBERS
    asked = packs.packed(queries, "query_id", "q", "qs", packs.QUERIES)
    pairs = packs.packed(rows, "vec_id", "v", "vs", packs.ROWS).crossJoin(F.broadcast(asked) if few else asked)
    scored = packs.best(pairs, k, own).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def fused(lists: DataFrame, key: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: key, item, score, first. lists has list and rank; ties go to the list and rank seen first."""
    return lists.groupBy(key, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.col("list") * F.lit(1_000_000) + F.col("rank")).alias("first"))


def round_robin(ranked: DataFrame, key: str, group: str, order: list[Column]) -> DataFrame:
    """Rounds: the best of each group first, then the second ones, groups always in the order of their best; adds round and position."""
    own = Window.partitionBy(key)
    rows = ranked.withColumn("_at", F.row_number().over(own.orderBy(*order)))
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(key, group).orderBy("_at"))).withColumn("_best", F.min("_at").over(Window.partitionBy(key, group)))
    return rows.withColumn("position", F.row_number().over(own.orderBy("round", "_best"))).drop("_at", "_best")


def recall_size(top: int) -> int:
    return max(20, 3 * top)


