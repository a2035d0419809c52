import random
from math import comb

from quarrylight.llm import rank_merge

KEY = "query_id long, generation_id int, path string"


def brute(entries, hits, asked):
    clean = lambda v: None if v is None or v != v else v
    best = {}
    for q, g, p, *s in entries:
        old = best.get((q, g, p), [None] * 4)
        best[q, g, p] = [max((x for x in (a, clean(b)) if x is not None), default=None) for a, b in zip(old, [*s, None])]
    for q, g, p, s in hits:
        if (q, g, p) in best and clean(s) is not None:
            best[q, g, p][3] = max(s, best[q, g, p][3]) if best[q, g, p][3] is not None else s
    out = set()
    for q, k in asked.items():
        rows = [(key, v) for key, v in best.items() if key[0] == q]
        n = len(rows)
        scored = []
        for key, v in rows:
            r = []
            for i in range(4):
                low = lambda x: float("-inf") if x is None else x
                r.append(sum(low(o[i]) >= low(v[i]) for _, o in rows) / n)
            r.sort()
            p = min(1, 4 * min(sum(comb(4, j) * r[m - 1] ** j * (1 - r[m - 1]) ** (4 - j) for j in range(m, 5)) for m in range(1, 5)))
            scored.append((round(p, 12), round(sum(r) / 4, 12), key[1], key[2], key))
        out |= {x[-1] for x in sorted(scored)[:k]}
    return out


def test_equal_brute_force(spark):
    rng = random.Random(3)
    entries, hits, asked = [], [], {}
    for q in range(6):
        asked[q] = rng.randrange(1, 6)
        for i in range(rng.randrange(1, 40)):
            s = [rng.choice([None, float("nan"), 0.0, 0.0, rng.random(), -rng.random() * 5, rng.random() * 1e6]) for _ in range(3)]
            entries.append((q, i % 3, f"p{i}", *s))
            hits += [(q, i % 3, f"p{i}", rng.choice([None, rng.random() * 10**q])) for _ in range(rng.randrange(3))]
    entries += entries[:5]
    e = spark.createDataFrame([(*x, "x") for x in entries], KEY + ", score double, centrality double, focus_score double, hit_score string")
    h = spark.createDataFrame(hits, KEY + ", score double")
    k = spark.createDataFrame([(q, n) for q, n in asked.items()] * 2, "query_id long, top_k int")
    got = {(r.query_id, r.generation_id, r.path) for r in rank_merge.top_candidates(e, h, k).collect()}
    assert got == brute(entries, hits, asked)


def test_empty(spark):
    e = spark.createDataFrame([], KEY + ", score double, centrality double, focus_score double")
    h = spark.createDataFrame([], KEY + ", score double")
    assert rank_merge.top_candidates(e, h, spark.createDataFrame([], "query_id long, top_k int")).count() == 0
