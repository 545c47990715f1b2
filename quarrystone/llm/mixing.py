"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: sources, ordered by code point with null last, weigh 3, 1, 2 and so on; together they get `share` of all words. A
source gets at most `most` times its own; what is beyond is shared again by weight. The end of that resharing is the fill
level of `targets`, found from one running sum.

Rates: each document of a source gets a rate between 0 and `most`. Of all rates that meet the source's token constraint,
those nearest to `most` / 2 in the entropy r log r + (most - r) log(most - r) are most * sigmoid(tilt * size / mean size).
The tilt of each source solves the convex dual; Newton steps, guarded by an interval that only shrinks, run for all sources
at once over counts of equal sizes.

Copies: floor and ceiling of the rates, decided by running sums over documents in order of size within strata of a source
(`strata`), so that sums stay near and no task gets a source whole. Each stratum then moves its smallest documents by one
copy while that brings it nearer to its sum: first from floor to ceiling or back, then, where one document outweighs all
that, any that can still be moved.

Edge cases. Null text: size 0, no words taken. A null source is a source of its own. A source of size 0 has target 0.
Repeated rows count each. Empty tables give empty results. Results depend on the rows alone, not on their partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import WORD, documents, is_small, small_join, stored

#: Documents of a stratum, about.
STRATUM = 4_000
#: The relative error at which Newton steps end, and steps after which something is wrong: an interval is halved 1,100 times at most.
CLOSE, LOOKS = 1e-6, 1_200


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size -> target: min(most * source_size, level * weight), where the targets add up to share * all sizes.

    One row per source goes through two windows without a partition; documents never do.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ratio = Window.orderBy("ratio", "at")
    before, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (F.col("at") % len(pattern) + 1).cast("int"))
    df = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", weight)
    df = df.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("try", left / weights)  # the level if exactly the sources before this one are full
    level = F.coalesce(F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(every), F.max("ratio").over(every))
    return df.withColumn("target", F.least("cap", level * F.col("weight"))).drop("at", "weight", "cap", "ratio", "try")


def tilts(histogram: DataFrame, wanted: DataFrame, most: float, fits: bool) -> DataFrame:
    """Of each source the tilt at which its rates meet its target. histogram: source, size, n (sizes above 0); wanted: source, n, source_size, target."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    facts = wanted.where("source_size > 0").select("source", (F.col("source_size") / F.col("n")).alias("mean"), "target", full.alias("full"), (F.col("target") / F.col("source_size")).alias("rate"))
    start = F.log(F.col("rate") / (most - F.col("rate")))  # the solution if all sizes were equal
    now = facts.where("not full").select("source", "mean", "target", F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), start.alias("tilt"), F.lit(1.0).alias("error"))
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))
    got = F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("got")
    slope = F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * F.col("rate") * (most - F.col("rate")) / most).alias("slope")
    for _ in range(LOOKS):  # one plan for all steps, so that its code is compiled once
        rows = small_join(histogram, now.drop("error"), "source", "inner", fits).withColumn("rate", most / (1 + F.exp(-x)))
        sums = rows.groupBy("source", "mean", "target", "low", "high", "tilt").agg(got, slope).withColumn("off", F.col("got") - F.col("target"))
        sums = sums.withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.col("off") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        middle = F.when(F.col("low") <= -1e4, 2 * F.col("tilt") - 1).when(F.col("high") >= 1e4, 2 * F.col("tilt") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        tilt = F.when(F.col("off") == 0, F.col("tilt")).when(inside, step).otherwise(middle)
        now = stored(sums.select("source", "mean", "target", "low", "high", tilt.alias("tilt"), (F.abs("off") / F.greatest("target", F.lit(1.0))).alias("error")), "tilts")
        # an interval that has closed holds no nearer tilt in float64
        closed = F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high"))
        if (now.where(~closed).agg(F.max("error")).first()[0] or 0.0) < CLOSE:
            break
    else:
        raise ArithmeticError("the tilts don't settle")
    return now.select("source", "mean", F.lit(False).alias("full"), "tilt").unionByName(facts.where("full").select("source", "mean", "full", F.lit(0.0).alias("tilt")))


def strata(rated: DataFrame, most: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Copies from rates: see the module. rated: id, source, size, rate, part; returns it with copies."""
    own = Window.partitionBy("source", "part")
    order = ("size", "tie", "doc_id", *extra)
    running = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    low = F.floor("rate")
    df = rated.withColumn("fraction", F.col("rate") - low).withColumn("sum", F.round(F.sum("fraction").over(running), 9))
    df = df.withColumn("up", F.floor(F.col("sum") + 0.5) > F.floor(F.col("sum") - F.col("fraction") + 0.5))
    df = df.withColumn("up", F.col("up") & (F.col("fraction") > 1e-9)).withColumn("copies", low + F.col("up").cast("long"))
    for rounding in (True, False):
        df = df.withColumn("off", F.sum((F.col("rate") - F.col("copies")) * F.col("size")).over(own))
        more, less = (F.col("copies") < F.ceil("rate"), F.col("copies") > F.floor("rate")) if rounding else (F.col("copies") < most, F.col("copies") > 0)
        df = df.withColumn("may", F.when(F.col("off") > 0, more).otherwise(less) & (F.col("fraction") > 1e-9 if rounding else F.abs("off") >= 1))
        moved = Window.partitionBy("source", "part", "may").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        move = F.col("may") & (F.sum("size").over(moved) <= F.abs("off") + F.col("size") / 2)
        df = df.withColumn("copies", F.col("copies") + F.when(move, F.signum("off").cast("long")).otherwise(0))
    return df


def mix(docs: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (columns doc_id, text, source), with its columns `extra`."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words("text").alias("size"), *extra)
    slim = stored(slim.withColumn("tie", F.xxhash64("doc_id", "size")), "sizes")
    histogram = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = stored(targets(sizes, pattern, share, most), "targets")
    fits = is_small(wanted)
    tilt = tilts(histogram.where("size > 0"), wanted, most, fits)
    t = tilt.withColumnRenamed("source", "_t")
    facts = stored(wanted.join(t, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t"), "rates")
    rated = small_join(slim, facts, "source", "left", fits)
    rate = most / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))))
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, 0.0).when(F.col("full"), F.lit(float(most))).otherwise(rate))
    rated = rated.withColumn("part", F.pmod("tie", F.greatest(F.lit(1), F.ceil(F.col("n") / STRATUM))))
    return strata(rated, most, extra).select("doc_id", "source", "size", *extra, "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
