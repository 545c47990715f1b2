"""Retrieval of evidence for products in one plan: eligible products, their documents, text and vector recall, fusion, rounds by product.

Edge cases. Chunks without a vector are found by text only, those with null text by vector only. A document of several products counts for
the first of them. Queries without a vector have text recall only; those that find nothing are issues. Ties go to the text list, then to
the smaller chunk_id. Empty tables give no evidence and the issues that say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators import products as P
from quarrystone.operators import search as S
from quarrystone.sources import shared

ISSUE = "stage string, code string, query_id long, product_id long"


def matched(eligible: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """product_id, score, issue of the products that products.selected takes, in no order, and issues: preferences that conflict, no product at all, or none that fits.

    Products are scored once and stored as ids, since several steps read them.
    """
    rows = shared.stored(P.scored(eligible, terms).select("product_id", "recognized", "score", "contradicted"), "scored")
    found = P.fitting(rows).select("product_id", "score", "issue")
    conflict = _issues(found.where("issue is not null"), "METADATA", "issue")
    state = rows.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("kept")))  # a row each
    none = state.where("kept = 0").select(F.lit(None).cast("long").alias("product_id"), F.when(F.col("n") == 0, "NO_ELIGIBLE_PRODUCT").otherwise("NO_METADATA_MATCH").alias("code"))
    return found, conflict.unionByName(_issues(none, "METADATA", "code"))


def _issues(rows: DataFrame, stage: str, code: str) -> DataFrame:
    query = F.col("query_id") if "query_id" in rows.columns else F.lit(None)
    product = F.col("product_id") if "product_id" in rows.columns else F.lit(None)
    return rows.select(F.lit(stage).alias("stage"), F.col(code).alias("code"), query.cast("long").alias("query_id"), product.cast("long").alias("product_id"))


def _links_of(chosen: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """product_id, document_id of the chosen products' links to documents, each once.

    Links outside the documents' range of ids are left out as they are read, so that they aren't moved to be compared.
    """
    ends = documents.agg(F.min("document_id").alias("low"), F.max("document_id").alias("high")).first()
    near = links.where(F.col("document_id").between(F.lit(ends.low), F.lit(ends.high)))
    return near.join(documents, "document_id", "left_semi").join(chosen, "product_id", "left_semi").select("product_id", "document_id").distinct()


def evidence(found: DataFrame, links: DataFrame, chunks: DataFrame, queries: DataFrame, top: int = 10, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, product_id, score, round, position; issues) of the best chunks for each query.

    found: products (product_id, score); links (product_id, document_id); chunks (chunk_id, document_id, text, v); queries
    (query_id, text, q). vectors (chunk_id, v), where given, stand in for the chunks' v, so that texts need not be joined with them. Term statistics are those of all chunks; only chunks of found products are ranked. Products take turns,
    in the order of their best chunk. Products, links and chunks in question are stored as ids, since several steps read them.
    """
    inside, without = _inside(found, links, chunks)
    most = S.recall_size(top)
    by_text = S.bm25(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), queries, most, within=inside.select(F.col("chunk_id").alias("doc_id")))
    given = (chunks if vectors is None else vectors).where("v is not null").join(inside, "chunk_id", "left_semi")
    by_vector = S.cosine_top(given.select(F.col("chunk_id").alias("vec_id"), "v"), queries.where("q is not null").select("query_id", "q"), most, own=True)
    ranks = by_text.select("query_id", F.col("doc_id").alias("chunk_id"), F.lit(0).alias("list"), "rank").unionByName(by_vector.select("query_id", F.col("vec_id").alias("chunk_id"), F.lit(1).alias("list"), "rank"))
    scored = S.fused(ranks, "query_id", "chunk_id").join(inside.select("chunk_id", "product_id"), "chunk_id")
    out = S.round_robin(scored, "query_id", "product_id", [F.desc("score"), F.col("first"), F.col("chunk_id")]).where(F.col("position") <= top)
    return out.select("query_id", "chunk_id", "product_id", "score", "round", "position"), _unserved(without, queries, ranks.select("query_id").distinct())


def issues(found: DataFrame, links: DataFrame, chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The issues of evidence alone, for the same tables: whether a query finds anything is asked of all texts and vectors, but nothing is scored or ranked."""
    inside, without = _inside(found, links, chunks)
    within = inside.select("chunk_id")
    by_text = S.answered(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), queries, within.select(F.col("chunk_id").alias("doc_id")))
    given = (chunks if vectors is None else vectors).where("v is not null").join(within, "chunk_id", "left_semi")
    some = given.agg(F.count("*").alias("n")).where("n > 0").select()  # a row if there are any: every vector of a query has nearest ones then
    by_vector = queries.where("q is not null").select("query_id").crossJoin(F.broadcast(some))
    return _unserved(without, queries, by_text.unionByName(by_vector))


def _inside(found: DataFrame, links: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunk_id, document_id, product_id of the found products' chunks, and products without a document."""
    chosen = shared.stored(found.select("product_id", (-F.col("score")).alias("position")), "chosen")
    owned, without = P.documents_of(chosen, shared.stored(_links_of(chosen, links, chunks.select("document_id")), "links"))
    return shared.stored(chunks.select("chunk_id", "document_id").join(owned, "document_id"), "inside"), without  # ids only: texts and vectors stay where they are


def _unserved(without: DataFrame, queries: DataFrame, served: DataFrame) -> DataFrame:
    """Issues of products without a document and of queries that aren't served (query_id)."""
    unmapped = _issues(without.withColumn("code", F.lit("MISSING_DOCUMENT_MAPPING")), "DOCUMENT_MAPPING", "code")
    silent = _issues(queries.join(served, "query_id", "left_anti").withColumn("code", F.lit("NO_PRODUCT_EVIDENCE")), "RETRIEVAL", "code")
    return unmapped.unionByName(silent)
