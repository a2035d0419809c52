import random

import numpy as np

from quarrylight.llm import leaks

PASSAGE = "Why did the café's keeper say that every single lantern near harbour nine must be lit before seven?"


def brute(doc, passages, words=14, changed=1):
    d = leaks.words_of(doc)
    out = set()
    for item, p in passages:
        q = leaks.words_of(p)
        for i in range(len(d) - words + 1):
            for j in range(len(q) - words + 1):
                if sum(a != b for a, b in zip(d[i : i + words], q[j : j + words])) <= changed:
                    out.add(item)
    return out


def test_normal_form():
    want = "el cafe rapido".split()
    for t in ("El café, rápido", "EL CAFE\u0301\nra\u0301pido!", "<b>El</b> caf&eacute; r&#225;pido", r"El caf\u00e9\nr\u00e1pido", "*El* __café__ r\u00adápido", "1\n00:00:01,000 --> 00:00:02,000\nEl café\n2\n00:00:02,000 --> 00:00:03,000\nrápido"):
        assert leaks.words_of(t) == want


def test_suffix_array():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 300)
    order = leaks.suffix_array(words, 7)
    keys = [tuple(words[i : i + 7]) for i in order]
    assert keys == sorted(keys)


def test_found_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    passages = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(10, 40)))) for i in range(12)] + [(99, PASSAGE), (98, None)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        p = leaks.words_of(rng.choice(passages)[1])
        take = p[rng.randrange(3) :][: rng.randrange(10, 20)]
        for _ in range(rng.randrange(3)):
            if take:
                take[rng.randrange(len(take))] = "changed"
        docs.append((d, " ".join(words[:20] + take + words[20:]), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, PASSAGE.upper(), "x"), (102, PASSAGE.upper(), "x"), (103, PASSAGE * 300, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    want = {(d, i) for d, t, _ in docs for i in brute(t if len(t or "") < 9000 else t[:400], [p for p in passages if p[1]])}
    for block in (10, 10**6):
        got = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, items, block_words=block).collect()}
        assert got == want
    found = leaks.leaked_passages(df, items)
    assert leaks.without_leaks(df, found).where("doc_id = 102").count() == 0


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leaks.leaked_passages(docs, items).count() == 0


def test_runs_are_whole_and_placed(spark):
    words = [f"x{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, "zero one two " + " ".join(words) + " end"), (2, "<b " + "a " * 300 + ">" + " ".join(words[50:80]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, "start " + " ".join(words))], "item_id long, passage string")
    got = {r.doc_id: (r.longest_run, r.doc_word, r.item_word) for r in leaks.leaked_passages(docs, items).collect()}
    assert got == {1: (200, 3, 1), 2: (30, 0, 51)}
