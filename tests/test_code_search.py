import math
import random
import re
from collections import Counter

from quarrylight.functions.text import bucket_of
from quarrylight.operators import lexical

CHUNKS = "generation_id int, id string, path string, kind string, heading string, line_start int, line_end int, content string, query string"


def terms_of(spark, query):
    return spark.createDataFrame([(query,)], "q string").select(lexical.query_terms(__import__("pyspark").sql.functions.col("q")).alias("t")).first()["t"]


def test_terms(spark):
    assert terms_of(spark, "how does the offline flow work") == ["does", "offline", "outbox", "enqueue", "queue", "pending", "retry", "sync", "flow", "route", "handler", "service", "processor", "projector", "work"]
    assert terms_of(spark, "the of") == ["the", "of"] and terms_of(spark, "") == [] and terms_of(spark, None) == []
    assert terms_of(spark, "-src/app.py:") == ["src/app.py", "src", "app", "py"] and terms_of(spark, "Ventas ventas")[:2] == ["Ventas", "sale"]


def corpus():
    rng = random.Random(2)
    words = ["merge", "merged", "token", "tokens", "limit", "cursor", "page", "order"]
    rows = []
    for i in range(120):
        path = rng.choice(["apps/a/b", "docs", "src/x", "packages/p/q/tests"]) + f"/f{rng.randrange(25)}.py"
        rows.append((1, f"c{i}", path, rng.choice(["symbol", "file"]), rng.choice([None, "merge"]), i, i + 3, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), "x"))
    return rows + rows[:3] + [(1, None, "n", "file", None, 1, 2, "merge", None), (1, "e", "e.py", None, None, 1, 2, None, None)]


def brute(rows, query, terms, top_k, bucket):
    seen = {r[1]: r for r in rows if r[1]}
    body = {i: " ".join([r[2], r[4] or "", r[7] or ""]).lower() for i, r in seen.items()}
    held = {i: re.findall(r"\w+", b) for i, b in body.items()}
    bare = {t: re.sub(r"\W", "", t.lower()) for t in terms}
    tf = {i: {t: sum(w.startswith(bare[t]) for w in ws) for t in terms} for i, ws in held.items()}
    matched = [i for i in tf if any(tf[i].values())]
    mean = sum(len(held[i]) for i in matched) / max(1, len(matched))
    df = {t: sum(tf[i][t] > 0 for i in matched) for t in terms}
    hits = []
    for i in matched:
        w = round(sum(math.log(1 + (len(matched) - df[t] + 0.5) / (df[t] + 0.5)) * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * len(held[i]) / mean)) for t in terms if tf[i][t]), 9)
        path, low = seen[i][2], [t.lower() for t in terms]
        test = "/tests/" in path
        score = sum(t in body[i] for t in low) / len(low) * 4 + sum(t in path.lower() for t in low) / len(low) * 8 + w / (1 + w) + all(tf[i].values())
        score += (0.4 if seen[i][3] == "symbol" else 0.2) - 2.25 * test - 0.25 * path.startswith("docs/") + 0.25 * (path.startswith(("apps/", "packages/")) and not test)
        hits.append((round(score, 9), path, seen[i][5], seen[i][3] or "", bucket[path]))
    out, of_path, of_bucket = [], Counter(), Counter()
    while hits and len(out) < top_k:
        open_ = [h for h in hits if not of_path[h[1]]] or [h for h in hits if of_path[h[1]] < 3]
        if not open_:
            break
        best = min(open_, key=lambda h: (-h[0] / (1 + 0.08 * of_bucket[h[4]]), h[1], h[2], h[3]))
        hits.remove(best)
        out.append(best[:4])
        of_path[best[1]] += 1
        of_bucket[best[4]] += 1
    return out


def test_search_equals_brute_force(spark):
    rows = corpus()
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(1, "merge token"), (2, "cursor"), (3, "nothingness"), (4, None), (2, "cursor"), (5, "limit page order")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    bucket = {r.path: r.b for r in chunks.select("path", bucket_of(chunks.path).alias("b")).distinct().collect()}
    for k in (3, 20, 60):
        got = {}
        for r in lexical.search_code(chunks, None, queries, top_k=k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 6), r.path, r.line_start, r.kind))
        for q, text in {1: "merge token", 2: "cursor", 5: "limit page order"}.items():
            assert got[q] == [(round(a, 6), *x) for a, *x in brute(rows, text, text.split(), k, bucket)], (q, k)
        assert set(got) == {1, 2, 5}
    assert lexical.search_code(chunks.limit(0), None, queries).count() == 0 and lexical.search_code(chunks, None, queries.limit(0)).count() == 0


def test_literal_hits(spark):
    files = spark.createDataFrame([(1, "a.py", "x\nlimit(limit)\nLimit", "q"), (1, "a.py", "x\nlimit(limit)\nLimit", "q"), (2, "b.py", "", "q"), (3, "c.py", None, "q")], "generation_id int, path string, text string, query string")
    queries = spark.createDataFrame([(1, "limit"), (2, "limit("), (3, "none"), (4, ""), (5, None), (6, "Limit")], "query_id long, query string")
    assert {tuple(r) for r in lexical.literal_hits(files, queries).collect()} == {(1, 1, "a.py", 2, 2), (2, 1, "a.py", 1, 2), (6, 1, "a.py", 1, 3)}
    assert lexical.literal_hits(files.limit(0), queries).count() == 0


def test_plans_in_any_number_of_indexes(spark, monkeypatch):
    """One index, several, and the joins hand on the same; a matched pair that is not handed on is nowhere written."""
    rows = corpus() + [(1, "c1", "docs/f1.py", "file", None, 7, 9, "merge token token", "x"), (None, "z", "z.py", None, None, 1, 2, "limit", None)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(1, "merge token"), (2, "cursor"), (3, "nothingness"), (4, None), (5, "limit page order"), (6, "token merge"), (7, "Merge merge the"), (8, "-- ??")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    monkeypatch.setattr(lexical, "CUT_LEAST", 20)
    get = lambda: sorted((r.query_id, r.generation_id or 0, r.id, round(r.weight, 6), r.strict) for r in lexical.matching_ids(chunks, queries, top_k=1).collect())
    one = get()
    assert {q for q, *_ in one} == {1, 2, 5, 6, 7} and [x[1:] for x in one if x[0] == 1] == [x[1:] for x in one if x[0] == 6]
    assert max(Counter(q for q, *_ in one).values()) > 20
    monkeypatch.setattr(lexical, "INDEX_MOST", 30)
    assert get() == one
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert get() == one
