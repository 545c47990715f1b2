"""Filters, joins, windows and set operations that customer queries are made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.records import canonical_json


def in_scope(df: DataFrame, column: str, allowed: Sequence | None) -> DataFrame:
    """Rows whose column is allowed; no list allows all, an empty list none."""
    if allowed is None:
        return df
    return df.where(F.col(column).isin(*allowed)) if allowed else df.where(F.lit(False))


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters, each applied only if its value is given."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [kv for kv in equal.items() if kv[1] is not None], df)


def containing(df: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Rows of which a column contains the trimmed keyword, whatever its case and accents; all rows without one."""
    word = (keyword or "").strip()
    if not word:
        return df
    hits = [F.collate(F.col(c), "UNICODE_CI_AI").contains(F.collate(F.lit(word), "UNICODE_CI_AI")) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def latest(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key and value of each key's last row by order: an aggregate, so that rows shrink before they are dealt out."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str, most: int = 1) -> DataFrame:
    """The first rows of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def capped(df: DataFrame, key: str, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each key with position; `truncated` tells whether the key has more. One row beyond the cap is looked at."""
    own = Window.partitionBy(key)
    df = df.withColumn("position", F.row_number().over(own.orderBy(*order)).cast("long")).where(F.col("position") <= most + 1)
    return df.withColumn("truncated", F.max("position").over(own) > most).where(F.col("position") <= most)


def page(df: DataFrame, number: int, size: int, *order: Column | str, most: int = 100) -> DataFrame:
    """A page from 1 of at most `most` rows; order must be total."""
    size = min(max(1, size), most)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def orphans(facts: DataFrame, key: str, sources: DataFrame, source_key: str) -> DataFrame:
    """Facts without a source, a null key included."""
    return facts.join(sources.select(F.col(source_key).alias(key)), key, "left_anti")


def reconcile(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """key and action: INSERT what is wanted only, ACTIVATE and KEEP what is there, DEACTIVATE what is not wanted. existing has `active`."""
    a, b = desired.select(key, F.lit(True).alias("wanted")), existing.select(key, "active", F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "INSERT").when(F.col("wanted").isNull(), F.when(F.col("active"), "DEACTIVATE").otherwise("NONE")).when(F.col("active"), "KEEP").otherwise("ACTIVATE")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def index_check(expected: DataFrame, stored: DataFrame, key: str, payload: Sequence[str], buckets: int = 4_096) -> DataFrame:
    """key and verdict of whatever differs between rows that should be in an index and rows that are: MISSING, EXTRA, MISMATCH, DUPLICATE.

    Keys are dealt to buckets; count, sum and exclusive or of 64-bit row hashes tell buckets that differ, and only their
    rows are compared, so payloads move as far as both sides disagree. 0 buckets: all rows are compared.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.max(F.to_json(F.struct(*payload))).alias(f"{name}_body"))

    def digests(df: DataFrame, name: str) -> DataFrame:
        """Of each bucket of keys what its rows add up to; a row a bucket is all that is shuffled."""
        row = F.xxhash64(F.col(key), F.to_json(F.struct(*payload)))
        sums = (F.count("*"), F.sum(row.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(row, F.lit(1))))
        return df.groupBy(bucket.alias("_bucket")).agg(*[s.alias(f"{name}{i}") for i, s in enumerate(sums)])

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    if buckets:
        pairs = digests(expected, "_a").join(digests(stored, "_b"), "_bucket", "full_outer")
        unlike = pairs.where(~F.struct("_a0", "_a1", "_a2").eqNullSafe(F.struct(F.col("_b0").alias("_a0"), F.col("_b1").alias("_a1"), F.col("_b2").alias("_a2")))).select("_bucket")
        # at most one row a bucket, so it may be broadcast; copies of a key on one side only make a bucket unlike as well
        twice = expected.groupBy(key).count().where("count > 1").select(bucket.alias("_bucket")).distinct()
        unlike = F.broadcast(unlike.unionByName(twice).distinct())
        expected, stored = (df.withColumn("_bucket", bucket).join(unlike, "_bucket", "left_semi") for df in (expected, stored))
    both = side(expected, "want").join(side(stored, "have"), key, "full_outer")
    verdict = F.when(F.col("have_n").isNull(), "MISSING").when(F.col("want_n").isNull(), "EXTRA").when((F.col("have_n") > 1) | (F.col("want_n") > 1), "DUPLICATE").when(F.col("want_body") != F.col("have_body"), "MISMATCH")
    return both.select(key, verdict.alias("verdict")).where("verdict is not null")


def duplicates(df: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """key, copies, and CONFLICT or IDENTICAL for keys that occur more than once."""
    found = df.groupBy(key).agg(F.count("*").alias("copies"), F.countDistinct(canonical_json(F.struct(*content), df.select(*content).schema)).alias("kinds")).where("copies > 1")
    return found.select(key, "copies", F.when(F.col("kinds") > 1, "CONFLICT").otherwise("IDENTICAL").alias("verdict"))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: columns that new sets (not null) replace old ones, others stay, new keys are added."""
    columns = [c for c in old.columns if c != key]
    right = new.select(key, *[F.col(c).alias(f"_{c}") if c in new.columns else F.lit(None).alias(f"_{c}") for c in columns])
    return old.join(right, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def sketched(df: DataFrame, columns: Sequence[str], bits: int = 12) -> DataFrame:
    """column, rows, nulls, longest, blanks, numbers, dates, sketch for each column: one pass, one row a task, whatever the number of columns.

    Sketches (HyperLogLog of values as text, 2**bits registers) of parts of a table can be put together with `merged`;
    their relative error is about 1.04 / sqrt(2**bits).
    """
    out = []
    for c in columns:
        t = F.col(c).cast("string")
        seen = (F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.max(F.length(t)).alias("longest"), F.count_if(F.trim(t) == "").alias("blanks"))
        formats = (F.count_if(t.rlike(r"^[+-]?\d+(\.\d+)?$")).alias("numbers"), F.count_if(t.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("dates"))
        out.append(F.struct(F.lit(c).alias("column"), *seen, *formats, F.hll_sketch_agg(t, F.lit(bits)).alias("sketch")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of parts of a table, a row a column."""
    sums = [F.sum(c).alias(c) for c in ("rows", "nulls", "blanks", "numbers", "dates")]
    return sketches.groupBy("column").agg(*sums, F.max("longest").alias("longest"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """The same with `distinct`, about, in place of the sketch."""
    return sketches.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct, exactly: values are deduplicated once, as rows of (column, value), after a partial pass in each task."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = pairs.where("value is not null").distinct().groupBy("column").agg(F.count("*").alias("distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(counts, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, nulls, distinct, longest for each column: one pass over the rows."""
    out = []
    for c in columns:
        t = F.col(c).cast("string")
        out.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(F.col(c)).alias("distinct"), F.max(F.length(t)).alias("longest")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")
