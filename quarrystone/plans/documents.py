"""Documents: blocks, section paths, chunks, and checks of vectors and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators import chunks as C
from quarrystone.operators import relational as R
from quarrystone.operators import streams
from quarrystone.plans.registry import query
from quarrystone.sources.tables import by_key, spread, table


#: Blocks of HTML by splitting at tags; the kinds and texts that follow each.
BLOCKS = """t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>|<head\\b.*?</head\\s*>', ' ', 'g') AS body FROM pages),
    m AS (SELECT page_id, string_split(regexp_replace(body, '(?i)<(h[1-6]|p|li|td|/article|/body|/html|footer)\\b', chr(1) || '<\\1', 'g'), chr(1)) AS parts FROM t),
    f AS (SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '(?is)^<(h[1-6]|p|li|td)\\b[^>]*>')) AS parts FROM m),
    u AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS position FROM f),
    k AS (SELECT page_id, CAST(position AS INTEGER) AS position, lower(regexp_extract(part, '(?i)^<(h[1-6]|p|li|td)\\b', 1)) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(part, '(?is)^<[^>]*>', ''), '(?s)<[^>]*>', ' ', 'g'), '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g')) AS text FROM u),
    blocks AS (SELECT page_id, position, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' WHEN tag = 'td' THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, text FROM k WHERE text <> '')"""


@query("html_blocks", f"WITH {BLOCKS} SELECT page_id, position, kind, level, text FROM blocks")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.html_blocks(table(spark, d, "pages"))


@query(
    "section_path",
    f"""WITH {BLOCKS}, p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n,
        (SELECT arg_max(h.text, h.position) FROM blocks h WHERE h.page_id = b.page_id AND h.level = 1 AND h.position <= b.position) AS h1,
        coalesce((SELECT max(h.position) FROM blocks h WHERE h.page_id = b.page_id AND h.level = 1 AND h.position <= b.position), -1) AS r1,
        coalesce((SELECT max(h.position) FROM blocks h WHERE h.page_id = b.page_id AND h.level <= 2 AND h.position <= b.position), -1) AS r2 FROM blocks b)
    SELECT page_id, printf('D%06d_B%04d', page_id, n) AS block_id, kind, concat_ws(' > ', h1,
        (SELECT arg_max(h.text, h.position) FROM blocks h WHERE h.page_id = p.page_id AND h.level = 2 AND h.position <= p.position AND h.position > p.r1),
        (SELECT arg_max(h.text, h.position) FROM blocks h WHERE h.page_id = p.page_id AND h.level = 3 AND h.position <= p.position AND h.position > p.r2)) AS path FROM p""",
)
def section_path(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.section_paths(C.html_blocks(table(spark, d, "pages")))
    return C.block_ids(blocks, "page_id", F.format_string("D%06d", F.col("page_id"))).select("page_id", "block_id", "kind", F.array_join("path", " > ").alias("path"))


#: Holds for texts without blank lines and wide punctuation, as in these tables; a test has the rest.
@query(
    "chunks_text",
    """WITH RECURSIVE l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END), lambda x: x <> '') AS lines FROM documents WHERE text <> ''),
    p AS (SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] ELSE flatten(list_transform(lines, lambda x: list_transform(range(0, length(x), 500), lambda i: substr(x, i + 1, 500)))) END AS parts FROM l),
    w AS (SELECT doc_id, 1 AS i, 1 AS position, length(parts[1]) AS size FROM p UNION ALL
        SELECT w.doc_id, i + 1, CASE WHEN size + length(parts[i + 1]) > 400 THEN position + 1 ELSE position END, CASE WHEN size + length(parts[i + 1]) > 400 THEN 0 ELSE size END + length(parts[i + 1]) FROM w JOIN p USING (doc_id) WHERE i < len(parts)),
    c AS (SELECT doc_id, position, string_agg(parts[i], '' ORDER BY i) AS content FROM w JOIN p USING (doc_id) GROUP BY doc_id, position)
    SELECT doc_id, printf('D%06d_C%04d', doc_id, position) AS chunk_id, CAST(position AS INTEGER) AS position, CAST(length(content) AS INTEGER) AS tokens, sha256(content) AS content_sha256 FROM c""",
)
def chunks_text(spark: SparkSession, d: str) -> DataFrame:
    return C.chunked(table(spark, d, "documents")).select("doc_id", "chunk_id", "position", "tokens", F.sha2("content", 256).alias("content_sha256"))


@query(
    "section_chunks",
    """WITH RECURSIVE b AS (SELECT doc_id, i, trim(line) AS line, CASE WHEN i % 11 = 10 THEN 'table' WHEN length(trim(line)) <= 40 THEN 'heading' ELSE 'paragraph' END AS kind, i % 3 + 1 AS level
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> ''),
    r AS (SELECT *, max(CASE WHEN kind = 'heading' AND level = 1 THEN i END) OVER w AS p1, max(CASE WHEN kind = 'heading' AND level = 2 THEN i END) OVER w AS p2, max(CASE WHEN kind = 'heading' AND level = 3 THEN i END) OVER w AS p3
      FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT r.doc_id, r.i, r.line, r.kind, CASE WHEN r.p2 > coalesce(p1, -1) THEN p2 END AS q2, CASE WHEN r.p3 > coalesce(p1, -1) AND r.p3 > coalesce(p2, -1) THEN p3 END AS q3, p1 AS q1 FROM r),
    t AS (SELECT h.doc_id, h.i, h.line, h.kind, list_filter([a.line, c.line, e.line], lambda x: x IS NOT NULL) AS path
      FROM h LEFT JOIN b a ON a.doc_id = h.doc_id AND a.i = h.q1 LEFT JOIN b c ON c.doc_id = h.doc_id AND c.i = h.q2 LEFT JOIN b e ON e.doc_id = h.doc_id AND e.i = h.q3),
    n AS (SELECT *, CASE WHEN kind = 'table' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w = 'table' OR lag(path) OVER w <> path THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
    u AS (SELECT doc_id, i, g, kind = 'table' AS tab, path, unnest(CASE WHEN kind = 'table' THEN list_filter(list_transform(string_split(line, ', '), lambda x: trim(x)), lambda x: x <> '') ELSE [line] END) AS unit,
      unnest(range(len(CASE WHEN kind = 'table' THEN list_filter(list_transform(string_split(line, ', '), lambda x: trim(x)), lambda x: x <> '') ELSE [line] END))) AS k FROM g),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS s, length(unit) AS size FROM u),
    f AS (SELECT doc_id, s, g, size, size AS held, CAST(1 AS BIGINT) AS c FROM o WHERE s = 1 UNION ALL
      SELECT o.doc_id, o.s, o.g, o.size, CASE WHEN o.g <> f.g OR f.size > 500 OR o.size > 500 OR held + 1 + o.size > 500 OR held >= 400 THEN o.size ELSE held + 1 + o.size END,
        CASE WHEN o.g <> f.g OR f.size > 500 OR o.size > 500 OR held + 1 + o.size > 500 OR held >= 400 THEN c + 1 ELSE c END FROM f JOIN o ON o.doc_id = f.doc_id AND o.s = f.s + 1),
    k AS (SELECT doc_id, c, any_value(tab) AS tab, any_value(path) AS path, string_agg(unit, chr(10) ORDER BY s) AS content, min(i) AS first, max(i) AS last, max(o.size) > 500 AS cut FROM f JOIN o USING (doc_id, s) GROUP BY doc_id, c),
    x AS (SELECT *, unnest(range(0, CASE WHEN cut THEN length(content) ELSE 1 END, 500)) AS a FROM k)
    SELECT doc_id, CAST(p AS INTEGER) AS position, printf('D%06d_C%04d', doc_id, p) AS chunk_id, kind, path, sha256(content) AS content_sha256, CAST(length(content) AS INTEGER) AS tokens, first, last, cut FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c, a) AS p, CASE WHEN tab THEN 'table' ELSE 'text' END AS kind, array_to_string(path, ' > ') AS path, CASE WHEN cut THEN substr(content, a + 1, 500) ELSE content END AS content,
        CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, cut FROM x)""",
)
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks: short ones are headings, every eleventh one a table of its parts; sections to chunks in one pass over sorted blocks."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).select("doc_id", "position", F.trim("line").alias("text"))
    kind = F.when(F.col("position") % 11 == 10, "table").when(F.length("text") <= 40, "heading").otherwise("paragraph")
    blocks = lines.withColumn("kind", kind).withColumn("level", F.col("position") % 3 + 1)
    blocks = blocks.withColumn("rows", F.when(F.col("kind") == "table", F.transform(F.split("text", ", "), lambda x: F.array(x))))
    out = streams.chunked_blocks(blocks)
    return out.select("doc_id", "position", "chunk_id", "kind", F.array_join("path", " > ").alias("path"), F.sha2("content", 256).alias("content_sha256"), "tokens", "first", "last", "cut")


@query(
    "chunk_totals",
    """SELECT doc_id, CAST(length(text) AS BIGINT) AS characters FROM documents WHERE length(text) > 0""",
)
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """Chunks together hold every character of a text, once."""
    return C.chunked(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tokens").alias("characters"))


@query(
    "embedding_valid",
    """SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS valid FROM embeddings GROUP BY label""",
)
def embedding_valid(spark: SparkSession, d: str) -> DataFrame:
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(fine).alias("valid"))


@query(
    "reconcile_index",
    """WITH a AS (SELECT doc_id AS id, lang AS body FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0),
    b AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS body FROM documents WHERE doc_id % 5 <> 0)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'MISSING' WHEN a.id IS NULL THEN 'EXTRA' ELSE 'MISMATCH' END AS verdict
    FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.body <> b.body""",
)
def reconcile_index(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("body"))
    have = t.where("id % 5 <> 0").withColumn("body", F.when(F.col("id") % 11 == 0, "xx").otherwise(F.col("body")))
    return R.index_check(t.where("id % 7 <> 0 or id % 5 = 0"), have, "id", ["body"])


@query(
    "important_keywords",
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN 'ERROR' WHEN NOT contains(text, 'the ') THEN 'WARNING' END AS severity,
    CASE WHEN length(text) = 0 THEN 'FAILED' WHEN NOT contains(text, 'the ') THEN 'SUCCESS_WITH_WARNINGS' ELSE 'SUCCESS' END AS status FROM documents""",
)
def important_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Worst finding of a document decides its status."""
    severity = F.when(F.length("text") == 0, "ERROR").when(~F.col("text").contains("the "), "WARNING")
    status = F.when(severity == "ERROR", "FAILED").when(severity == "WARNING", "SUCCESS_WITH_WARNINGS").otherwise("SUCCESS")
    return table(spark, d, "documents").select("doc_id", severity.alias("severity"), status.alias("status"))


CLAUSES = """b AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, CASE l_suppkey % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' ELSE 'paragraph' END AS kind, l_quantity <= 44 AS numbered,
    l_partkey % 4 <> 0 AS sentence, l_linenumber // 3 + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 4 THEN 5 ELSE 0 END AS page, l_orderkey % 7 = 0 AND l_linenumber > 5 AS deep
    FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
    c AS (SELECT *, count(*) FILTER (numbered) OVER o + CASE WHEN doc_id % 3 = 0 AND position >= 5 THEN 10 ELSE 0 END AS number, row_number() OVER o AS place, count(*) FILTER (NOT numbered AND kind = 'heading') OVER o AS walls
        FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY position)),
    n AS (SELECT *, CASE WHEN number = lag(number) OVER o + 1 AND place - lag(place) OVER o <= {most} AND walls = lag(walls) OVER o AND page - lag(page) OVER o <= 1 AND deep = lag(deep) OVER o THEN 0 ELSE 1 END AS fresh
        FROM c WHERE numbered WINDOW o AS (PARTITION BY doc_id ORDER BY position)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM n),
    g AS (SELECT doc_id, run, count(*) AS size, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind <> 'heading') AS plain, count(*) FILTER (kind = 'list') AS lists,
        count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (sentence) AS sentences FROM r GROUP BY ALL)"""


def clauses(spark: SparkSession, d: str, form: str, level: int | None) -> DataFrame:
    """Blocks of numbered lines, made from the lines of orders; lines of equal number are one."""
    lines = by_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"), "l_orderkey")  # all steps keep this partitioning
    t = lines.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    here = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    numbered = F.col("l_quantity") <= 44
    number = F.count_if(numbered).over(here) + F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") >= 5), 10).otherwise(0)
    body = F.when(F.col("l_partkey") % 4 != 0, "投资者应当知悉条款。").otherwise("名称")
    kind = F.when(F.col("l_suppkey") % 3 == 0, "heading").when(F.col("l_suppkey") % 3 == 1, "list").otherwise("paragraph")
    page = (F.floor(F.col("l_linenumber") / 3) + F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") > 4), 5).otherwise(0)).cast("int")
    path = F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") > 5), F.array(F.lit("章"), F.lit("节"))).otherwise(F.array(F.lit("章")))
    text = F.when(numbered, F.concat(F.format_string(form, number), body)).otherwise("说明")
    return t.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), kind.alias("kind"), F.when(kind == "heading", F.lit(level)).cast("int").alias("level"), text.alias("text"), path.alias("path"), page.alias("page_start"), page.alias("page_end"))


@query(
    "steady_clauses",
    f"""WITH {CLAUSES.format(most=2)} SELECT doc_id, position, CASE WHEN paragraphs * 2 >= plain THEN 'paragraph' ELSE 'list' END AS kind FROM r JOIN g USING (doc_id, run)
    WHERE kind = 'heading' AND sentence AND size >= 3 AND plain >= 2 AND sentences >= greatest(2, (size + 1) // 2)""",
)
def steady_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that were headings only by mistake, and what they become."""
    return C.steady_clauses(clauses(spark, d, "%d. ", 3), "doc_id").where("steadied").select("doc_id", "position", "kind")


@query(
    "steady_siblings",
    f"""WITH {CLAUSES.format(most=3)} SELECT doc_id, position, CASE WHEN lists > 0 THEN 'list' ELSE 'paragraph' END AS kind FROM r JOIN g USING (doc_id, run) WHERE kind = 'heading' AND size >= 3 AND plain >= headings""",
)
def steady_siblings(spark: SparkSession, d: str) -> DataFrame:
    return C.steady_siblings(clauses(spark, d, "（%d）", None), "doc_id").where("steadied").select("doc_id", "position", "kind")


def tables(spark: SparkSession, d: str) -> DataFrame:
    """A table of each part: two pairs, of which one is in a row, a row of digits, a cell of its own."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    rows = F.array(F.array(F.lit("品 牌"), brand), F.array(size, F.lit(" 7")), F.array(F.lit(""), F.concat(F.lit("注："), name)))
    pairs = F.array(F.struct(F.lit("类型").alias("key"), F.col("p_type").alias("value")), F.struct(F.lit("品 牌").alias("key"), brand.alias("value")))
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")).select("p_partkey", rows.alias("rows"), F.when(F.col("p_partkey") % 3 > 0, pairs).alias("pairs"), F.lit("").alias("text"))


@query(
    "table_units",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN concat('品 牌：', p_brand, chr(10), '注：', p_name, chr(10), '类型：', p_type)
    ELSE concat('品 牌 | ', p_brand, chr(10), p_size, ' | 7', chr(10), ' | 注：', p_name) END AS units FROM part""",
)
def table_units(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d).select("p_partkey", F.array_join(C.table_units(F.col("rows"), F.col("pairs")), "\n").alias("units"))


@query(
    "table_chunks",
    """SELECT p_partkey, CAST(i AS INTEGER) AS position, CAST(100 * least(5, p_size - 5 * (i - 1)) - 1 AS INTEGER) AS tokens FROM part, unnest(generate_series(1, (p_size + 4) // 5)) AS s(i)""",
)
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of 99 characters, p_size of them: five to a chunk."""
    rows = F.array_repeat(F.array(F.repeat(F.lit("x"), F.lit(99))), F.col("p_size"))
    t = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", rows.alias("rows"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("pairs"), F.lit("").alias("text"))
    return C.table_chunks(t, "p_partkey").select("p_partkey", "position", "tokens")


def scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages of orders, some with next to no text; blocks that hold some pages, and the page after now and then."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_suppkey", "l_quantity")
    pages = t.select("doc_id", "page", F.when(F.col("l_suppkey") % 4 > 0, F.repeat(F.lit("页"), F.lit(20))).otherwise(" 少 ").alias("text"))
    last = F.col("page") + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)
    blocks = t.where("l_quantity > 20").select("doc_id", F.lit("table").alias("kind"), F.when(F.col("l_quantity") > 24, "块").otherwise(" ").alias("text"), F.col("page").alias("page_start"), last.alias("page_end"))
    return pages, blocks


@query(
    "page_fallback",
    """SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_suppkey % 4 = 0 THEN 'OCR_REQUIRED' ELSE 'FALLBACK_PARSER_USED' END AS reason, CASE WHEN l_suppkey % 4 = 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM lineitem a
    WHERE l_suppkey % 4 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity > 24 AND (b.l_linenumber = a.l_linenumber OR b.l_suppkey % 5 = 0 AND b.l_linenumber + 1 = a.l_linenumber))""",
)
def page_fallback(spark: SparkSession, d: str) -> DataFrame:
    return C.page_fallback(*scanned(spark, d))[1]


@query(
    "document_status",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_size = 1 THEN 'FAILED' WHEN p_partkey % 2 = 1 OR p_partkey % 3 = 0 THEN 'SUCCESS_WITH_WARNINGS' ELSE 'SUCCESS' END AS status FROM part""",
)
def document_status(spark: SparkSession, d: str) -> DataFrame:
    """Product documents: codes and pages, important contents, and codes of the text against the name's."""
    k = F.col("p_partkey")
    code = F.format_string("PRD%06d", k)
    docs = table(spark, d, "part").select("p_partkey", F.when(k % 11 == 0, " ").otherwise(code).alias("product_code"), code.alias("sales_code"), F.when(F.col("p_size") > 1, F.col("p_size")).otherwise(0).alias("page_count"))
    body = F.concat(F.lit("、".join(C.IMPORTANT[:5])), F.when(k % 2 == 0, C.IMPORTANT[5]).otherwise(""), F.lit("。销售代码："), F.when(k % 3 == 0, "OTHER001").otherwise(code))
    blocks = table(spark, d, "part").where("p_partkey % 13 <> 0").select("p_partkey", body.alias("text"))
    return C.document_status(docs, C.document_issues(docs, blocks, "p_partkey"), "p_partkey")


@query(
    "embedding_batches",
    """WITH i AS (SELECT *, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS chunk FROM lineitem), c AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, chunk) - 1) // 3 AS batch FROM i),
    v AS (SELECT l_orderkey, batch, max(CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END) AS blank, max(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END) AS missing, max(CASE WHEN l_suppkey % 10 = 0 AND l_quantity <> 50 THEN 1 ELSE 0 END) AS odd, count(*) - count(DISTINCT chunk) AS again FROM c GROUP BY ALL)
    SELECT l_orderkey, CAST(batch AS INTEGER) AS batch, CASE WHEN again > 0 THEN 'DUPLICATE_CHUNK' WHEN blank = 1 THEN 'EMPTY_TEXT' WHEN missing = 1 THEN 'ANSWER_COUNT' ELSE 'INVALID_VECTOR' END AS problem FROM v WHERE again + blank + missing + odd > 0""",
)
def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of three that weren't answered whole."""
    t = by_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    text = F.when(F.col("l_partkey") % 29 == 0, " ").otherwise("x")
    chunks = t.select("l_orderkey", F.col("l_linenumber").alias("position"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("chunk_id"), text.alias("embedding_text"), "l_quantity", "l_suppkey")
    batches = C.embedding_batches(chunks, "l_orderkey", 3)
    vector = F.when(F.col("l_suppkey") % 10 == 0, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    answers = batches.where("l_quantity <> 50").select("l_orderkey", "batch", "index", vector.alias("vector"))
    return C.embedded(batches, answers, "l_orderkey", 2)[1]
