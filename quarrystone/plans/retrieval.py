"""Retrieval queries: text and vector recall, fusion, round robin, metadata match."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import first_rule
from quarrystone.operators import evidence as E
from quarrystone.operators import search as S
from quarrystone.operators.inverted import Index
from quarrystone.plans.registry import ORACLES, query
from quarrystone.sources.shared import new_path
from quarrystone.sources.tables import spread, table

_TERMS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(
    "bm25_topk",
    f"""WITH t AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
    p AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT item_id AS query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM p JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = S.bm25(table(spark, d, "documents").select("doc_id", "text"), queries, 10)
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"))


_CHANGED = "CASE WHEN doc_id % 10 = 3 THEN concat_ws(' ', lang, lang, substring(text, 101)) ELSE text END"


@query("bm25_indexed", ORACLES["bm25_topk"].replace("FROM documents)", f"FROM (SELECT doc_id, {_CHANGED} AS text FROM documents WHERE doc_id % 10 <> 7))").replace("round(score, 4) AS score", "CAST(round(score * 1000000) AS BIGINT) AS score"))
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The stored index: all documents indexed once, a tenth replaced by other texts, a tenth deleted, and searched by all items."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    index = Index.made(spark, new_path(spark, "index"), docs.select("doc_id", "text"))
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.expr(_CHANGED).alias("text"))
    index.put(changed, deleted=docs.where("doc_id % 10 = 7").select("doc_id"))
    found, _ = index.top(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)
    return found.select("query_id", "doc_id", F.round(F.col("score") * 1_000_000).cast("long").alias("score"))  # six digits are rounded once, alike everywhere


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of ids divisible by 50 as queries."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


COSINE = """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q JOIN embeddings e ON {} q.vec_id % 50 = 0"""


@query(
    "vector_topk",
    f"""SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COSINE.format("e.vec_id <> q.vec_id AND")})) WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_top(*vectors(spark, d), 10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query(
    "vector_self_search",
    f"""SELECT query_id AS vec_id, vec_id AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COSINE.format("")})) WHERE rank = 1""",
)
def vector_self_search(spark: SparkSession, d: str) -> DataFrame:
    """A stored vector finds itself, or an equal one of smaller id, first."""
    e, q = vectors(spark, d)
    return S.cosine_top(e, q, 1, own=True).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nearest"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of orders for each customer: by price and by date."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey")
    a = o.select("o_custkey", "o_orderkey", F.lit(0).alias("list"), F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    b = o.select("o_custkey", "o_orderkey", F.lit(1).alias("list"), F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rank"))
    return a.where("rank <= 20").unionByName(b.where("rank <= 20"))


LISTS = """l AS (SELECT o_custkey, o_orderkey, 0 AS list, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders
    UNION ALL SELECT o_custkey, o_orderkey, 1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) FROM orders),
    f AS (SELECT o_custkey, o_orderkey, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM l WHERE rank <= 20 GROUP BY 1, 2)"""


@query("rrf_fusion", f"WITH {LISTS} SELECT o_custkey, o_orderkey, CAST(round(score * 1000000) AS BIGINT) AS score FROM f")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return S.fused(lists(spark, d), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.round(F.col("score") * 1_000_000).cast("long").alias("score"))


@query(
    "round_robin",
    f"""WITH {LISTS}, p AS (SELECT f.*, o_orderpriority, row_number() OVER (PARTITION BY f.o_custkey, o_orderpriority ORDER BY score DESC, first, f.o_orderkey) AS round FROM f JOIN orders USING (o_orderkey)),
    b AS (SELECT *, first_value(row(-score, first, o_orderkey)) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY round) AS best FROM p),
    n AS (SELECT o_custkey, o_orderkey, round, row_number() OVER (PARTITION BY o_custkey ORDER BY round, best) AS position FROM b)
    SELECT o_custkey, o_orderkey, CAST(round AS INTEGER) AS round, CAST(position AS INTEGER) AS position FROM n WHERE position <= 10""",
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    ranked = S.fused(lists(spark, d), "o_custkey", "o_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    out = S.round_robin(ranked, "o_custkey", "o_orderpriority", [F.desc("score"), F.col("first"), F.col("o_orderkey")])
    return out.where("position <= 10").select("o_custkey", "o_orderkey", "round", "position")


@query(
    "metadata_match",
    """WITH t AS (SELECT unnest(['economy', 'small', 'brand#1']) AS term), m AS (SELECT p_partkey, term, contains(lower(p_type), term) OR contains(lower(p_brand), term) AS matched,
      (term = 'small' AND contains(lower(p_type), 'large')) AS contradicted FROM part, t),
    a AS (SELECT p_partkey, count(*) FILTER (matched) AS score, bool_or(contradicted) AS contradicted FROM m GROUP BY 1)
    SELECT p_partkey, score, contradicted FROM a WHERE score > 0 AND NOT contradicted""",
)
def metadata_match(spark: SparkSession, d: str) -> DataFrame:
    """Each term matches, contradicts or says nothing; products without contradiction and with a score are eligible."""
    fields = F.array(F.lower("p_type"), F.lower("p_brand"))
    found = [(fields[0].contains(t) | fields[1].contains(t)).cast("long") for t in ("economy", "small", "brand#1")]
    score = reduce(add, found)
    against = F.lower("p_type").contains("large")  # a large one is no small one
    return table(spark, d, "part").select("p_partkey", score.alias("score"), against.alias("contradicted")).where("score > 0 and not contradicted")


@query("first_rule_codes", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'A' WHEN contains(p_type, 'BRASS') OR contains(p_type, 'TIN') THEN 'B' ELSE 'C' END AS code FROM part")
def first_rule_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", first_rule(F.col("p_type"), ((("STEEL",), "A"), (("BRASS", "TIN"), "B")), "C").alias("code"))


#: What the queries ask of products, and the hard condition.
ASKED, PRICE = ["产品 economy，1-2年", "保本"], 980
_FOUND = f"""income AS (SELECT *, CASE WHEN p_brand LIKE '%5' THEN '非保本浮动' WHEN p_brand LIKE '%4' THEN '保本固定' ELSE '其他' END AS income FROM part WHERE p_retailprice < {PRICE}),
    e AS (SELECT p_partkey, contains(lower(concat_ws(chr(10), p_name, p_type, p_brand)), 'economy')::INT + (floor(p_size * 36.5) BETWEEN 365 AND 730)::INT + (income = '保本固定')::INT AS score, income = '非保本浮动' AS against FROM income),
    m AS (SELECT * FROM e WHERE score > 0 AND NOT against), l AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents)),
    f AS (SELECT l_orderkey AS doc_id, p_partkey AS product_id FROM m JOIN l ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, p_partkey) = 1)"""


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    income = F.when(F.col("p_brand").endswith("5"), "非保本浮动").when(F.col("p_brand").endswith("4"), "保本固定").otherwise("其他")
    none = F.lit(None).cast("string")
    rows = spread(table(spark, d, "part").where(F.col("p_retailprice") < PRICE).select("p_partkey", "p_name", "p_type", "p_brand", "p_size")).select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category"), income.alias("income_type"), F.col("p_brand").alias("operation_mode"),
        *[none.alias(c) for c in ("term_type", "liquidity_rule", "target_customer", "eligibility_conditions", "risk_level")], F.floor(F.col("p_size") * 36.5).alias("term_days"))
    return E.matched(rows, ASKED)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """links, chunks, queries and vectors of evidence."""
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vecs.select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q")), "query_id", "left")
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("document_id"))
    return links, chunks, queries, vecs


_SCORES = ORACLES["bm25_topk"].split("SELECT query_id, doc_id, round(score, 4)")[0].rstrip()


@query(
    "product_evidence",
    f"""{_SCORES}, {_FOUND}, c AS ({COSINE.format("").replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")} AND e.vec_id IN (SELECT doc_id FROM f)),
    r AS (SELECT query_id, doc_id, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE doc_id IN (SELECT doc_id FROM f)
      UNION ALL SELECT query_id, vec_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM c),
    u AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM r WHERE rank <= 30 GROUP BY 1, 2),
    o AS (SELECT u.*, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, u.doc_id) AS place FROM u JOIN f USING (doc_id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY place) AS round, min(place) OVER (PARTITION BY query_id, product_id) AS best FROM o),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round, best) AS position FROM g)
    SELECT query_id, doc_id AS chunk_id, product_id, CAST(round AS INTEGER) AS round, CAST(position AS INTEGER) AS position FROM n WHERE position <= 10""",
)
def product_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each benchmark item the ten best chunks of products that fit, product by product."""
    links, chunks, queries, vectors = _tables(spark, d)
    return E.evidence(_found(spark, d)[0], links, chunks, queries, vectors=vectors)[0].drop("score")


@query(
    "product_issues",
    f"""WITH {_FOUND} SELECT 'DOCUMENT_MAPPING' AS stage, 'MISSING_DOCUMENT_MAPPING' AS code, CAST(NULL AS BIGINT) AS query_id, p_partkey AS product_id FROM m WHERE p_partkey NOT IN (SELECT l_partkey FROM l)""",
)
def product_issues(spark: SparkSession, d: str) -> DataFrame:
    """What a retrieval has to say about products and queries it could not serve."""
    found, notes = _found(spark, d)
    links, chunks, queries, vectors = _tables(spark, d)
    return notes.unionByName(E.issues(found, links, chunks, queries, vectors=vectors))
