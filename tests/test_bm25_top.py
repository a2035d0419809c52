import random

from pyspark.sql import functions as F
from quarrylight.operators import lexical

DOCS = "prop string, text string"


def test_top_equals_all_pairs(spark, monkeypatch):
    """The best of each query are those of all pairs, with ties by key, repeated keys, and indexes of any size."""
    rng = random.Random(5)
    words = ["graph", "node", "index", "chapter", "lesson", "archive", "the", "of"]
    rows = [(f"{i}:{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, *rows[:30], *((k, t + " node") for k, t in rows[30:40]), ("n", None)], DOCS)
    queries = spark.createDataFrame([(1, "the graph node"), (2, "lesson lesson archive"), (3, "unseen"), (4, ""), (5, "chapter"), (6, "of it")], "query_id long, query string")
    every = lexical.bm25(docs, queries, key="prop").withColumn("score", F.round("score", 6))
    want = {tuple(r) for r in lexical.top(every, 12, "query_id", [F.desc("score"), F.col("prop")]).select("query_id", "prop", "score", "rank").collect()}
    assert {q for q, *_ in want} == {1, 2, 5}
    get = lambda: {tuple(r) for r in lexical.bm25_top(docs, queries, 12, key="prop").select("query_id", "prop", "score", "rank").collect()}
    assert get() == want
    monkeypatch.setattr(lexical, "SCORED_ROWS", 20)
    assert get() == want
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert get() == want
    assert lexical.bm25_top(docs.limit(0), queries, 12, key="prop").count() == 0
