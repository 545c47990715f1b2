"""Customer queries: lists, counts, panorama sections, scopes, audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators import relational as R
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


@query(
    "customer_list_latest",
    """WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, latest AS latest_status FROM customer LEFT JOIN l ON o_custkey = c_custkey
    WHERE c_nationkey IN (1, 3, 5, 7, 9, 11) AND c_name ILIKE '%customer%' ORDER BY c_custkey LIMIT 50 OFFSET 50""",
)
def customer_list_latest(spark: SparkSession, d: str) -> DataFrame:
    """Scope and keyword filters, the latest attribute by an aggregate, a page in total order."""
    latest = R.latest(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    c = R.containing(R.in_scope(table(spark, d, "customer"), "c_nationkey", [1, 3, 5, 7, 9, 11]), " CUSTOMER ", "c_name")
    rows = c.join(latest, c.c_custkey == latest.o_custkey, "left").select("c_custkey", "c_name", F.col("o_orderstatus").alias("latest_status"))
    return R.page(rows, 2, 50, "c_custkey")


@query("empty_scope", "SELECT c_custkey, c_name FROM customer WHERE FALSE")
def empty_scope(spark: SparkSession, d: str) -> DataFrame:
    """An empty list of allowed values allows nothing."""
    return R.in_scope(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", [])


@query("optional_filters", "SELECT p_partkey, p_brand FROM part WHERE p_size = 10")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return R.where_given(table(spark, d, "part"), p_size=10, p_brand=None).select("p_partkey", "p_brand")


@query(
    "dimension_counts",
    """WITH o AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1),
    l AS (SELECT o_custkey k, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    e AS (SELECT user_id k, count(*) n FROM events GROUP BY 1)
    SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS items, coalesce(e.n, 0) AS events
    FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN e ON e.k = c_custkey""",
)
def dimension_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each table is counted by key before it is joined."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    # items are counted by order first, so that the join to orders moves one row an order
    per_order = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    items = orders.join(per_order, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"))
    out = table(spark, d, "customer").select("c_custkey").join(items, "c_custkey", "left").join(events, "c_custkey", "left")
    return out.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "items", "events")])


@query(
    "panorama_sections",
    """WITH r AS (
      SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS position,
             count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT c_custkey, n_name, o_orderkey, o_totalprice, position, n > 5 AS truncated
    FROM r JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE position <= 5""",
)
def panorama_sections(spark: SparkSession, d: str) -> DataFrame:
    """The latest rows of each customer's section with a probe row beyond the cap."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = R.capped(orders, "o_custkey", 5, F.desc("o_orderdate"), F.desc("o_orderkey"))
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    out = rows.join(c, rows.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return out.select("c_custkey", "n_name", "o_orderkey", "o_totalprice", "position", "truncated")


@query(
    "enterprise_exists",
    """SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_suppkey = s_suppkey AND p_size > 45 AND l_quantity > 45)""",
)
def enterprise_exists(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    hits = table(spark, d, "lineitem").where("l_quantity > 45").join(part, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(hits, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("anti_remaining", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_remaining(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(
    "self_join_relation",
    """SELECT DISTINCT o_custkey AS c_custkey, a.l_suppkey AS first_supplier, b.l_suppkey AS second_supplier
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
    JOIN orders ON o_orderkey = a.l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier s ON s.s_suppkey = a.l_suppkey JOIN nation ON n_nationkey = s.s_nationkey
    WHERE c_nationkey = n_nationkey AND a.l_quantity > 30""",
)
def self_join_relation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    a, b = li.where("l_quantity > 30").alias("a"), li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("second_supplier"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    return pairs.join(o, "l_orderkey").join(c, "c_custkey").join(s, ["l_suppkey", "nation"]).join(n, "nation").select("c_custkey", F.col("l_suppkey").alias("first_supplier"), "second_supplier").distinct()


@query(
    "orphan_audit",
    """SELECT 'lineitem' AS fact, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
    UNION ALL SELECT 'events', count(*) FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)
    UNION ALL SELECT 'labels', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id)""",
)
def orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for fact, key, source, source_key in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")):
        n = R.orphans(table(spark, d, fact), key, table(spark, d, source), source_key).agg(F.count("*").alias("orphans")).select(F.lit(fact).alias("fact"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "batch_verdict",
    """WITH c AS (SELECT (SELECT count(*) FROM customer) n, (SELECT count(DISTINCT o_custkey) FROM orders) covered,
      (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) orphans,
      (SELECT count(*) FROM customer WHERE c_name IS NULL OR c_name = '') blanks)
    SELECT n AS persons, covered, orphans, blanks, orphans = 0 AND blanks = 0 AND covered = n AS passed FROM c""",
)
def batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Counts, coverage, mandatory fields and orphans of a batch as one row with the verdict."""
    c = table(spark, d, "customer")
    people = c.agg(F.count("*").alias("persons"), F.count_if(F.col("c_name").isNull() | (F.col("c_name") == "")).alias("blanks"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    covered = o.agg(F.countDistinct("c_custkey").alias("covered"))
    lost = o.join(c, "c_custkey", "left_anti").agg(F.count("*").alias("orphans"))
    row = people.crossJoin(covered).crossJoin(lost)  # three rows of one
    return row.select("persons", "covered", "orphans", "blanks", ((F.col("orphans") == 0) & (F.col("blanks") == 0) & (F.col("covered") == F.col("persons"))).alias("passed"))


@query(
    "owners_of_source",
    """SELECT count(*) AS owners, count(DISTINCT owner) AS kinds FROM (SELECT DISTINCT owner, k FROM (
      SELECT 'order' AS owner, o_custkey AS k FROM orders UNION ALL SELECT 'event', user_id FROM events UNION ALL
      SELECT 'item', o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = k)""",
)
def owners_of_source(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(o, "o_orderkey")
    rows = [o.select(F.lit("order").alias("owner"), F.col("o_custkey").alias("c_custkey")), table(spark, d, "events").select(F.lit("event").alias("owner"), F.col("user_id").alias("c_custkey")), items.select(F.lit("item").alias("owner"), F.col("o_custkey").alias("c_custkey"))]
    found = rows[0].distinct().unionByName(rows[1].distinct()).unionByName(rows[2].distinct()).join(table(spark, d, "customer"), "c_custkey", "left_semi")
    return found.agg(F.count("*").alias("owners"), F.countDistinct("owner").alias("kinds"))


@query(
    "unresolved_union",
    """SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'item', l_orderkey * 10 + l_linenumber, l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('F'))
    ORDER BY kind, id LIMIT 100""",
)
def unresolved_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose status is known and not final; a null status is left out. Ordered, so that the limit is defined."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus") != "F").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    i = table(spark, d, "lineitem").where(~F.col("l_linestatus").isin("F")).select(F.lit("item").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("status"))
    return o.unionByName(i).orderBy("kind", "id").limit(100)


@query(
    "scope_reconcile",
    """WITH a AS (SELECT c_custkey k FROM customer WHERE c_acctbal > 5000), b AS (SELECT s_suppkey k, s_acctbal > 0 AS active FROM supplier)
    SELECT coalesce(a.k, b.k) AS person_id, CASE WHEN b.k IS NULL THEN 'INSERT' WHEN a.k IS NULL THEN CASE WHEN active THEN 'DEACTIVATE' ELSE 'NONE' END
    WHEN active THEN 'KEEP' ELSE 'ACTIVATE' END AS action FROM a FULL JOIN b ON a.k = b.k""",
)
def scope_reconcile(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("person_id"))
    have = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), (F.col("s_acctbal") > 0).alias("active"))
    return R.reconcile(want, have, "person_id")


@query(
    "completeness_score",
    """SELECT c_custkey, CAST(25 + CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 25 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 25 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') THEN 25 ELSE 0 END AS INTEGER) AS score FROM customer""",
)
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    """25 for each dimension that has rows; the person always counts."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(1).alias("o"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.lit(1).alias("e"), F.max((F.col("event_type") == "purchase").cast("int")).alias("p"))
    rows = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return rows.select("c_custkey", (25 + 25 * (F.coalesce("o", F.lit(0)) + F.coalesce("e", F.lit(0)) + F.coalesce("p", F.lit(0)))).cast("int").alias("score"))


@query(
    "property_merge",
    """SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation, c_mktsegment AS segment
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
)
def property_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keyed upsert: given properties replace, absent ones stay."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return R.merge(old, new, "id")


@query(
    "section_cap",
    """SELECT l_orderkey, l_linenumber, position, truncated FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS position,
    count(*) OVER (PARTITION BY l_suppkey) > 20 AS truncated FROM lineitem) WHERE position <= 20""",
)
def section_cap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return R.capped(li, "l_suppkey", 20, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "position", "truncated")


@query(
    "business_dedupe",
    """SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""",
)
def business_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First row of each content, whatever its source reference: a minimum, combined before the shuffle."""
    li = table(spark, d, "lineitem")
    least = li.groupBy("l_partkey", "l_quantity", "l_returnflag").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("x"))
    return least.select("x.l_orderkey", "x.l_linenumber")


@query(
    "dup_conflict_detect",
    """SELECT l_suppkey AS key, count(*) AS copies, CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) > 1 THEN 'CONFLICT' ELSE 'IDENTICAL' END AS verdict
    FROM lineitem WHERE l_quantity > 49 GROUP BY 1 HAVING count(*) > 1""",
)
def dup_conflict_detect(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("key"), "l_returnflag", "l_linestatus")
    return R.duplicates(li, "key", ["l_returnflag", "l_linestatus"])


@query(
    "ordinal_alias",
    """SELECT l_orderkey, l_linenumber, concat(l_returnflag, '_', row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber)) AS alias FROM lineitem""",
)
def ordinal_alias(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit("_"), F.row_number().over(w).cast("string")).alias("alias"))


@query(
    "alias_numbers",
    """SELECT DISTINCT l_orderkey, l_suppkey, concat('E-', dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey)) AS alias FROM lineitem""",
)
def alias_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Aliases in a stable order within each customer record."""
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey"))
    return keys.select("l_orderkey", "l_suppkey", F.concat(F.lit("E-"), n.cast("string")).alias("alias"))


@query(
    "profile_columns",
    """SELECT 'p_brand' AS "column", count(*) AS rows, count(*) FILTER (p_brand IS NULL) AS nulls, count(DISTINCT p_brand) AS "distinct", max(length(p_brand)) AS longest FROM part
    UNION ALL SELECT 'p_type', count(*), count(*) FILTER (p_type IS NULL), count(DISTINCT p_type), max(length(p_type)) FROM part
    UNION ALL SELECT 'p_size', count(*), count(*) FILTER (p_size IS NULL), count(DISTINCT p_size), max(length(CAST(p_size AS VARCHAR))) FROM part""",
)
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    """Counts in one pass over the rows, distinct values exactly."""
    part, columns = table(spark, d, "part"), ["p_brand", "p_type", "p_size"]
    found = R.sketched(part, columns).join(R.exact_distinct(part, columns), "column")
    return found.select("column", "rows", "nulls", "distinct", F.col("longest").cast("long").alias("longest"))


@query("segment_histogram", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def segment_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query(
    "distinct_sorted_lists",
    """SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1""",
)
def distinct_sorted_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))
