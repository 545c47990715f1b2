"""URL filters: rules judge the pages that they fit; trust and distrust spread over the links between hosts judge the rest.

Trust starts at hosts in proportion to their pages that rules allow and follows links; distrust starts at hosts in
proportion to their pages that rules block and runs against the links, towards hosts that point at blocked ones. Both are
personalised PageRanks, computed together as two kinds of mass: each step keeps `1 - damping` of the seeds and passes
`damping` of each host's mass along its links in proportion to their counts. Links within a host pass nothing; mass at a
host without links ends there. A host is blocked if its share of distrust, distrust / (trust + distrust), exceeds
`threshold`; a host that neither reaches is allowed. Steps go on until five of them change less than a millionth of the mass.

Everything is DataFrame operations. Links are counted per pair of hosts before any join, ranks are joined by host, and
pages of one host are never gathered. A host with very many links makes long partitions only on the side of the edges of
inner joins, which adaptive execution splits; sums over links are partial before they are shuffled.

A link is the `href` of an `a` tag, of any length, that names a host; other attributes whose names end in href are none.

Edge cases. A null URL, or one without `://`, has empty host and path, fits no rule and is allowed. Null HTML has no links.
Equally long rules cannot fit the same URL unless they are the same rule. Repeated pages count each, extra columns are left
out, an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, forget, is_small, small_join, stored

#: (action, host, start of the path) of op1's contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?(?<=[\s"'/])href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Steps of the ranking between two looks at its change, and the change, as a share of all mass, at which it ends.
STEPS, CLOSE = 5, 1e-6


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: str) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits columns host and path, as text, and its action; the longest wins."""
    name = action = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, action = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(action)
    return name, action


def links(pages: DataFrame) -> DataFrame:
    """src, dst, share: of each host's links to other hosts, the part that leads to dst."""
    found = pages.select(host_of("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    pairs = found.select("src", lowered(F.col("to")).alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").count()
    out = pairs.groupBy("src").agg(F.sum("count").alias("all"))
    return pairs.join(out, "src").select("src", "dst", (F.col("count") / F.col("all")).alias("share"))


def reversed_links(links: DataFrame) -> DataFrame:
    """The same, against the links: dst passes to src in proportion to src's share."""
    into = links.groupBy("dst").agg(F.sum("share").alias("all"))
    return links.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("all")).alias("share"))


def ranks(seeds: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """kind, host, mass. seeds: the same, its masses the restarts; edges: kind, src, dst, share. Each kind has its own graph."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and less than 1")
    start = seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("mass"))
    now = seeds
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    while True:  # the change shrinks by damping at least in every step, so this ends: after about 85 steps at 0.85
        before = now
        for _ in range(STEPS):
            passed = now.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("mass")).alias("mass"))
            now = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        now = stored(now, "ranks")
        change = now.withColumnRenamed("mass", "new").join(before, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0))))).first()[0] or 0.0
        if before is not seeds:
            forget(before)
        if change <= CLOSE * total:
            return now


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's distrust, a share of 0 to 1, for every row of pages (page_id, url, html)."""
    name, action = ruled(rules)
    seen = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).select("page_id", "host", "path", name.alias("rule"), action.alias("action"))
    marked = seen.where("action is not null").groupBy(F.col("action").alias("kind"), "host").agg(F.count("*").cast("double").alias("mass"))
    seeds = stored(marked, "seeds")
    forward = stored(links(pages), "links")
    if forward.limit(1).count():
        edges = stored(forward.select(F.lit("allow").alias("kind"), "*").unionByName(reversed_links(forward).select(F.lit("block").alias("kind"), "*")), "edges")
        mass = ranks(seeds, edges, damping)
    else:
        mass = seeds
    of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)) for k in ("allow", "block")}
    hosts = stored(mass.groupBy("host").agg((of["block"] / F.greatest(of["allow"] + of["block"], F.lit(1e-300))).alias("distrust")), "hosts")
    out = small_join(seen, hosts, "host", "left", is_small(hosts)).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    own = F.when(F.col("distrust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), "distrust")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"))
