from datetime import datetime

from quarrylight.llm import scans

T = datetime(2025, 1, 1)
NODES = "id string, document_id string, node_type string, page_number int, raw_text string, ingested_at timestamp_ntz, text string, head boolean"
LINES = ["the notebook describes the archive of the library", "nobody had read the chapter with margin notes", "the answer explains the meeting of the students"]


def corpus():
    rows = [(f"n{i}", f"plain{i % 7}", "paragraph", i % 9, LINES[i % 3] + ".", T, None, None) for i in range(120)]
    for page in range(6):
        rows.append((f"h{page}", "book", "paragraph", page, f"THE LONG CHAPTER     {page + 3}\nthe notebook describes the\narchive of the library", T, None, None))
    rows += [
        ("cut", "book", "paragraph", 9, "nobody had read the chap-\nter with margin notes", T, None, None), ("wrong", "book", "paragraph", 9, "the n0tebook describes the archive", T, None, None), ("letters", "book", "paragraph", 9, "nobody had read the chaptcr with rnargin notes", T, None, None),
        ("number", "book", "paragraph", 9, "the answer explains the meeting\n      — 12 —", T, None, None), ("roman", "book", "paragraph", 9, "the answer explains the meeting\n  xiv", T, None, None), ("cell", "book", "table_cell", 9, "12", T, None, None), ("null", "book", "paragraph", 9, None, T, None, None), ("empty", "book", "paragraph", None, "", T, None, None),
        ("clean", "book", "paragraph", 9, "the H2O of room B12 and v2-bis", T, None, None), ("once", "book", "paragraph", 9, "A TITLE SEEN ONCE\nthe answer explains the meeting of the students", T, None, None), ("cut", "book", "paragraph", 9, "nobody had read the chap-\nter with margin notes", T, None, None),
        ("new", "book", "paragraph", 9, "clean text now.", datetime(2025, 2, 1), None, None), ("new", "book", "paragraph", 9, "old bro-\nken text", T, None, None), ("tail", "book", "paragraph", 9, "the answer explains the meet-\n13", T, None, None), ("long", "book", "paragraph", 9, "the answer explains the meeting. " * 3000 + "chap-\nter", T, None, None),
    ]
    return rows


def test_kinds_and_texts(spark):
    nodes = spark.createDataFrame(corpus(), NODES)
    got = {r.id: r for r in scans.repair(nodes).collect()}
    kinds = {k: set(v.kinds) for k, v in got.items() if v.kinds and not k.startswith("h")}
    assert kinds == {"cut": {"hyphenation"}, "wrong": {"misread"}, "letters": {"misread"}, "number": {"page_number"}, "roman": {"page_number"}, "tail": {"hyphenation", "page_number"}, "long": {"hyphenation"}}
    assert all(set(got[f"h{i}"].kinds) == {"running_head", "page_number"} for i in range(6))
    assert got["cut"].text == "nobody had read the chapter with margin notes"
    assert got["letters"].text == "nobody had read the chapter with margin notes"
    assert got["wrong"].text == "the notebook describes the archive"
    assert got["h1"].text == "the notebook describes the archive of the library"
    assert "cell" not in got and "null" not in got


def test_compounds_keep_their_hyphen():
    import numpy as np

    lexicon = scans.Lexicon({}, {"well-known"}, [], np.zeros((0, 1)), np.zeros((0, 1)))
    plain, open_end = scans.joined(["a well-", "known case of a chap-", "ter"])
    assert not open_end and lexicon.whole(plain) == ("a well-known case of a chapter", True)
    assert lexicon.whole(scans.joined(["a well-", "known case"])[0]) == ("a well-known case", False)
    assert lexicon.whole(scans.joined(["in the li\u00ad", "brary"])[0]) == ("in the library", True)
    assert scans.joined(["the meet-"]) == ("the meet-", True) and scans.joined(["", " "]) == ("", False)


def test_large_tables_give_the_same(spark, monkeypatch):
    nodes = spark.createDataFrame(corpus(), NODES)
    rows = lambda: {(r.id, tuple(sorted(r.kinds)), r.text) for r in scans.repair(nodes).collect()}
    small = rows()
    monkeypatch.setattr(scans, "BROADCAST_WORDS", 0)
    assert rows() == small


def bounded(monkeypatch, **bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(scans, name, value, raising=False)


def test_every_word_and_pair_is_trained(spark, monkeypatch):
    """More words and pairs than one task trains are trained in blocks; none is left out, in a model given whole or as a table."""
    marked = spark.createDataFrame([(f"{a} {b} {c}",) for k in range(40) for a, b, c in (("sea", "ship", "sail"), ("ship", "sail", "sea"), ("oven", "bread", "flour"), ("bread", "flour", "oven"))] + [("sail again " * 9,)], "plain string")
    counted = spark.createDataFrame([(w, 80) for w in ("sea", "ship", "sail", "oven", "bread", "flour")] + [("again", 9), ("rare", 2)], "word string, n long")
    bounded(monkeypatch, VOCABULARY=3, BLOCK_WORDS=3, TRAINING_PAIRS=8, BLOCK_PAIRS=8)
    words, inner, outer, usual = scans.learn_vectors(marked, counted)
    assert words == ["again", "bread", "flour", "oven", "sail", "sea", "ship"] and len(inner) == len(outer) == len(usual) == 7
    assert abs((inner**2).sum(axis=1) - 1).max() < 1e-3 and abs((outer**2).sum(axis=1) - 1).max() < 1e-3
    bounded(monkeypatch, BROADCAST_WORDS=0)
    rows = {r.word: r for r in scans.learn_vectors(marked, counted).collect()}
    assert sorted(rows) == words
    for i, w in enumerate(words):
        assert rows[w].inner == inner[i].tobytes() and rows[w].outer == outer[i].tobytes() and abs(rows[w].usual - usual[i]) < 1e-6


def test_blocks_learn_what_one_task_learns(spark):
    """Words of one topic fit each other and not those of another, in whatever blocks they lie."""
    import numpy as np
    import pandas as pd

    topic = np.arange(1000) // 100
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1000), np.arange(1000)))
    kept = topic[a] == topic[b]
    pairs = pd.DataFrame({"a": a[kept], "b": b[kept], "n": 20})
    inner, outer = scans.start_vectors(1000)
    scans.train_vectors(pairs, inner, outer, np.full(1000, 1 / 1000))
    x, y = np.zeros((1000, scans.DIMENSIONS)), np.zeros((1000, scans.DIMENSIONS))
    for r in scans.train_in_blocks(spark.createDataFrame(pairs), 1000, 3).collect():
        (y if r.side else x)[r.block :: 3] = scans._matrix(r.data, scans.DIMENSIONS + r.side)[:, : scans.DIMENSIONS]
    for own, other in ((inner, outer), (x, y)):
        fit = scans._unit(own) @ scans._unit(other).T
        assert fit[a[kept], b[kept]].mean() > fit[a[~kept], b[~kept]].mean() + 0.3


def test_models_in_blocks_and_tables_give_the_same(spark, monkeypatch):
    nodes = spark.createDataFrame(corpus(), NODES)
    rows = lambda: {(r.id, tuple(sorted(r.kinds)), r.text) for r in scans.repair(nodes).collect()}
    small = rows()
    bounded(monkeypatch, BLOCK_WORDS=12)
    assert rows() == small
    bounded(monkeypatch, BROADCAST_WORDS=0)
    assert rows() == small


def test_rule_is_the_same_at_every_size(spark):
    """A form is suspect by its share of the word's count, however often both occur."""
    for times in (1, 50):
        counted = spark.createDataFrame([("graphe", 300 * times), ("graplie", 6 * times), ("perdent", 60 * times), ("perdcnt", 6 * times)], "word string, n long")
        got = {r.form: [o["word"] for o in r.options] for r in scans.suspects_of(counted).collect()}
        assert got == {"graplie": ["graphe"]}


def test_words_cut_between_nodes(spark):
    rows = [("a", "d", 1, "the long chap-", True), ("b", "d", 2, "ter of the book", False), ("c", "d", 3, "ends here-", True), ("d", "e", 1, "other document", False), ("e", "e", 2, "in the li-", True), ("f", "e", 3, "12", False)]
    rows += [(f"x{i:03}", "long", i, "one two-" if i % 2 == 0 else "fold three", i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, d, o, [], t, x) for i, d, o, t, x in rows], scans.REPAIRED)
    got = {r.id: r.text for r in scans.continuous(df.repartition(5)).collect()}
    assert got["a"] == "the long chapter" and got["b"] == "of the book" and got["c"] == "ends here-" and got["d"] == "other document" and got["e"] == "in the li-"
    assert len(got) == len(rows) and all(got[f"x{i:03}"] == ("one twofold" if i % 2 == 0 else "three") for i in range(400))
    assert scans.continuous(df.limit(0)).count() == 0


def test_empty(spark):
    assert scans.repair(spark.createDataFrame([], NODES)).count() == 0
