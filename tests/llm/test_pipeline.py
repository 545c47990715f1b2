"""The pipeline's stages on a small corpus, and that every query runs."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quarrystone.llm import mixing, neardup, registry, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "x y", "en", "s", 3)], docs.schema)).unionByName(docs.limit(3))
    scorer = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out = spark.createDataFrame(out.collect(), out.schema)
        if name == "toxicity":
            bad = toxicity.score(docs, scorer).where("score >= 0.7").count()
            assert out.count() == docs.count() - bad
        elif name == "near_duplicates":
            want = {r.doc_id for r in neardup.near_duplicates(docs).where("kept and doc_id is not null").collect()}
            assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(want)
            assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()
        elif name == "secrets":
            assert out.count() == docs.count() and not any(secrets.spans(r.text or "") for r in out.collect() if "[" not in (r.text or ""))
        else:
            taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
            assert out.count() == taken
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_near_copies_of_rows_that_share_an_id(spark):
    """All texts of a kept id stay, once each and the same ones in every run, whatever the order of rows."""
    a, b, c = ("one two three four five six seven eight nine ten", "eleven twelve thirteen fourteen fifteen sixteen", "some other text of more than five words")
    rows = [(2, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "de", "r", 2), (1, c, None, None, None), (1, c, "en", None, 3), (5, b, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1), (9, None, "en", "s", 0)]
    want = sorted(map(str, [(2, a, "de", "r", 2), (2, b, "en", "s", 1), (1, c, None, None, None), (None, a, "en", "s", 1), (None, a, "en", "s", 1), (9, None, "en", "s", 0)]))
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert sorted(str(tuple(r)) for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()) == want
        rows = rows[::-1]


def test_mix_takes_no_more_than_its_copies(spark):
    """Rows that share id, source and size get together what the mix takes, unlike texts or not."""
    rng = random.Random(1)
    for rows in (
        [(None, " ".join(rng.choice("abcdef") for _ in range(9)), None, "s", 9) for _ in range(301)],
        [(i // 2, " ".join(rng.choice("abcdef") for _ in range(12)), "en", "sr"[i % 7 < 2], 12) for i in range(400)],
        [(7, "one two three", lang, "s", n) for lang in ("de", "en") for n in (1, None) for _ in range(37)] + [(8, "x y", None, "r", 3), (8, None, None, "r", 3)],
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        want = {(r.doc_id, r.source): r.n for r in mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r.n}
        out = corpus_pipeline.mixed(spark, docs, SF).collect()
        got: dict = {}
        for r in out:
            got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len((r.text or "").split())
        assert got == want
        times = Counter(map(tuple, out))
        assert all(times[r] <= 2 * n for r, n in Counter(rows).items()) and set(times) <= set(rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    assert name in __spark_entry__.queries()
    df = registry.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
