"""A stored inverted index: BM25 over documents that are indexed once, replaced or deleted one by one, and searched by bounds.

A commit (`put`) writes a segment: postings in blocks, the terms and length of each document, and changes of the number of documents of
each term. A segment counts once its last part, the commit, is complete, so a killed write leaves the index as it was, and the next one
takes its number. A document that is put again, or deleted, hides its postings in all earlier segments.

A block holds the postings of one term in one shard of documents (documents are dealt to shards by hash, about `SHARD` in each), with its
greatest frequency and least length, which bound its scores whatever the mean length has become. No block is larger than a shard, so
terms that nearly all documents hold are many blocks. A shard lies in one folder, its blocks in order of terms: footers rule out row
groups without a query's terms, and a task that reads a shard has all parts of its documents' scores, which it adds up before they move.

`top` finds the k best documents of each query in three steps. Rare terms of a query give partial scores; the k-th best is a floor. Terms whose
bounds together stay below the floor can't bring a document in by themselves: only the other terms' blocks are read in full,
less those that can't reach the floor. The rest is read in the shards that still hold a candidate. Scores equal those of search.bm25.

Edge cases. Null ids are left out. Of rows that share an id in one `put` all texts together are the document. Null and empty texts
count as documents without terms. Queries without a term found have no rows. An empty `put` is a segment without documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.search import K1, B, terms
from quarrystone.sources import shared

#: Documents of a shard, about, the least number of shards (each is written by one task), and folders that shards are dealt to.
SHARD, LEAST, BUCKETS = 2048, 8, 32
#: Postings of rare terms that a query's floor is taken from, in multiples of k.
FIRST = 20
#: Room for scores that are rounded to six digits.
ROOM = 1e-5
#: Terms of all queries together, and candidates, up to which they are broadcast to the blocks.
BROADCAST_ROWS = 50_000
POSTINGS = "segment long, term string, shard long, n long, most long, least long, postings array<struct<doc_id long, tf long, length long>>, bucket int"
DOCS = "segment long, doc_id long, length long, terms array<string>, counts array<int>"
TERMS = "term string, df long"
GONE = "segment long, doc_id long"


def _counted(rows: DataFrame) -> DataFrame:
    """doc_id, length, terms, counts of rows (doc_id, words): sorted words are cut where they change, so no shuffle counts them."""
    ordered = rows.select("doc_id", F.size("words").cast("long").alias("length"), F.sort_array("words").alias("words"))
    changes = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == F.size("words")) | (F.get("words", i) != F.get("words", i - 1)))
    ordered = ordered.withColumn("ends", F.when(F.size("words") > 0, changes).otherwise(F.array().cast("array<int>")))
    counts = F.transform("ends", lambda e, i: e - F.coalesce(F.get("ends", i - 1), F.lit(0)))
    return ordered.select("doc_id", "length", F.transform("ends", lambda e: F.get("words", e - 1)).alias("terms"), counts.alias("counts"))


class Index:
    """An index at a path; shards: how many shards documents are dealt to, fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, shards: int) -> None:
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    @staticmethod
    def made(spark: SparkSession, path: str, docs: DataFrame) -> Index:
        """A new index of docs (doc_id, text)."""
        found = Index(spark, path, max(LEAST, -(-docs.count() // SHARD)))
        found.put(docs)
        return found

    def segments(self) -> list[int]:
        """Numbers of the segments whose commit is complete."""
        names = [n for n in shared.names(self.spark, f"{self.path}/commits") if "_SUCCESS" in shared.names(self.spark, f"{self.path}/commits/{n}")]
        return sorted(int(n) for n in names)

    def _read(self, part: str, schema: str) -> DataFrame:
        at = self.segments()
        if not at:
            return self.spark.createDataFrame([], schema)
        out = None
        for n in at:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}/{n}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _gone(self) -> DataFrame:
        """doc_id, last: the last segment that replaced or deleted a document."""
        return self._read("gone", GONE).groupBy("doc_id").agg(F.max("segment").alias("last"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, segment) of documents as they are now."""
        gone = self._gone().withColumnRenamed("doc_id", "_doc")
        if not gone.limit(1).count():
            return rows
        hidden = (F.col("doc_id") == F.col("_doc")) & (F.col("segment") < F.col("last"))
        return rows.join(gone, hidden, "left_anti")

    def docs(self) -> DataFrame:
        """segment, doc_id, length, terms of the documents as they are now."""
        return self._live(self._read("docs", DOCS))

    def put(self, docs: DataFrame, deleted: DataFrame | None = None) -> int:
        """Adds docs (doc_id, text) in place of earlier versions and takes out deleted (doc_id); returns the segment's number."""
        at = [*self.segments(), -1]
        n = max(at) + 1
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.coalesce("text", F.lit(""))).alias("words"))
        if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():  # ids alone are cheap to compare
            rows = rows.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("words"))).alias("words"))
        one = self._put("docs", n, _counted(rows).select(F.lit(n).cast("long").alias("segment"), "doc_id", "length", "terms", "counts"))
        # documents move to their shards as they are; grouping by term and shard needs no further shuffle then
        dealt = one.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(self.shards))).repartition("shard")
        posted = dealt.select("shard", "doc_id", "length", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("shard", "doc_id", "length", F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("tf"))
        blocks = posted.groupBy("shard", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("postings"))
        blocks = blocks.select(F.lit(n).cast("long").alias("segment"), "term", "shard", "n", "most", "least", "postings", F.pmod("shard", F.lit(BUCKETS)).cast("int").alias("bucket"))
        blocks.sortWithinPartitions("bucket", "term", "shard").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{n}")
        ids = one.select("doc_id")
        if deleted is not None:
            ids = ids.unionByName(deleted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))).distinct()
        old = self.docs().join(ids, "doc_id", "left_semi")
        change = one.select(F.explode("terms").alias("term"), F.lit(1).alias("x")).unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("x")))
        self._put("terms", n, change.groupBy("term").agg(F.sum("x").alias("df")).where("df <> 0"))
        self._put("gone", n, old.select(F.lit(n).cast("long").alias("segment"), "doc_id").distinct())
        lost = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        got = one.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._put("commits", n, self.spark.createDataFrame([(got[0] - lost[0], got[1] - lost[1])], "docs long, length long"))
        return n

    def _put(self, part: str, n: int, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{part}/{n}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def top(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, score, rank of queries (query_id, text); step, blocks and postings read, with all of the queries' terms as step 'all')."""
        docs, length = self._read("commits", "docs long, length long").agg(F.sum("docs"), F.sum("length")).first()
        mean = (length or 0) / (docs or 1) or 1.0
        wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        df = self._read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (F.lit(docs or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))

        def gain(tf: Column, size: Column) -> Column:
            return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean)))

        asked = shared.stored(wanted.join(df, "term").withColumn("idf", idf), "asked")
        posted = self._read("postings", POSTINGS).drop("bucket")
        heads = posted.drop("postings").join(asked.select("term", "idf").distinct(), "term")
        # bounds and sizes of the blocks of the queries' terms: what to read is decided on these
        heads = shared.stored(heads.select("term", "segment", "shard", "n", gain(F.col("most"), F.col("least")).alias("bound")), "heads")
        own = Window.partitionBy("query_id")
        rarer = own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        weaker = own.orderBy("strongest", "term").rowsBetween(Window.unboundedPreceding, 0)
        asked = asked.join(heads.groupBy("term").agg(F.max("bound").alias("strongest")), "term")
        asked = asked.withColumn("first", F.coalesce(F.sum("df").over(rarer), F.lit(0)) < FIRST * k)
        asked = shared.stored(asked.withColumn("below", F.sum("strongest").over(weaker)).withColumn("whole", F.sum("strongest").over(own)), "asked")

        few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        no_end = F.lit(True)

        def near(rows: DataFrame, shards: DataFrame | None) -> DataFrame:
            """Blocks of a query in some shards only, if shards (query_id, shard) says which."""
            return rows if shards is None else rows.join(shards, ["query_id", "shard"], "left_semi")

        def parts(some: DataFrame, reach: Column = no_end, shards: DataFrame | None = None) -> DataFrame:
            """query_id, doc_id, shard, part: what the postings in the blocks of a step's terms add to their documents' scores.

            The queries' terms go to the blocks if a count has shown them to be few; postings aren't shuffled then, only sums are.
            """
            rows = posted.join(F.broadcast(some) if few else some, "term").withColumn("bound", gain(F.col("most"), F.col("least"))).where(reach)
            rows = near(rows.select("query_id", "segment", "shard", "idf", "postings"), shards)
            rows = rows.select("query_id", "segment", "shard", "idf", F.explode("postings").alias("p")).select("query_id", "segment", "shard", "idf", "p.*")
            return self._live(rows).select("query_id", "doc_id", "shard", gain(F.col("tf"), F.col("length")).alias("part"))

        def summed(some: DataFrame) -> DataFrame:
            return some.groupBy("query_id", "doc_id", "shard").agg(F.sum("part").alias("part"))

        def floor(some: DataFrame) -> DataFrame:
            """The k-th best of partial scores, which no result falls below."""
            ranked = some.withColumn("rank", F.row_number().over(own.orderBy(F.desc("part"), "doc_id"))).where(F.col("rank") == k)
            return ranked.select("query_id", (F.col("part") - ROOM).alias("floor"))

        start = asked.where("first")
        early = shared.stored(summed(parts(start)), "early")
        facts = asked.join(floor(early), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        facts = shared.stored(facts.withColumn("strong", F.col("first") | (F.col("below") >= F.col("floor"))), "facts")
        # a document in a block that can't reach the floor, even with all other terms at their best, is no result
        strong, weak = facts.where("strong and not first"), facts.where("not strong")
        reach = F.col("bound") + F.col("whole") - F.col("strongest") >= F.col("floor")
        known = shared.stored(summed(parts(strong, reach).unionByName(early)), "known")
        rest = weak.groupBy("query_id").agg(F.sum("strongest").alias("rest"))
        sums = known.join(rest, "query_id", "left").join(floor(known), "query_id", "left")
        candidates = sums.where(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0)))
        candidates = shared.stored(candidates.select("query_id", "doc_id", "shard", "part"), "candidates")
        pairs, held = candidates.select("query_id", "doc_id"), candidates.select("query_id", "shard").distinct()
        if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            added = parts(weak, shards=F.broadcast(held)).join(F.broadcast(pairs), ["query_id", "doc_id"], "left_semi")
        else:  # shards would be joined by moving whole blocks: postings alone are smaller
            added = parts(weak).join(pairs, ["query_id", "doc_id"], "left_semi")
        scores = candidates.unionByName(added).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
        out = scores.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        counts = None
        for step, some, most, shards in (("first", start, no_end, None), ("main", strong, reach, None), ("late", weak, no_end, held), ("all", asked, no_end, None)):
            read = near(some.join(heads, "term").where(most), shards).agg(F.lit(step).alias("step"), F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
            counts = read if counts is None else counts.unionByName(read)
        return out.select("query_id", "doc_id", "score", "rank"), counts
