import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import chunking, enrich, packing
from quarrylight.sources import admission, documents


def test_collection_memory_reduces_neighbours_in_order(spark, monkeypatch):
    rows = [("g", i, f"The sentence number {i} speaks of subject{i % 7} and of matter{i % 5} at length.") for i in range(300)] + [("h", 1, "A lone one."), ("h", 2, ""), (None, 3, "Of no group.")]
    df = spark.createDataFrame(rows, "g string, doc_id long, summary string")

    def level(texts):
        return [enrich.summarise(texts[i : i + 4], 2)[0] if len(texts[i : i + 4]) > 1 else texts[i] for i in range(0, len(texts), 4)]

    want = [t for g, _, t in rows if g == "g"]
    while len(want) > 1:
        want = level(want)
    got = {r.g: (r.summary, r.sources) for r in enrich.collection_memory(df, "g", batch=4, most=2).collect()}
    assert got == {"g": (want[0], 300), "h": ("A lone one.", 1), None: ("Of no group.", 1)}
    monkeypatch.setattr(enrich, "BATCHES_PER_TASK", 2)
    spread = {r.g: r.sources for r in enrich.collection_memory(df, "g", batch=4, most=2).collect()}
    assert spread == {"g": 300, "h": 1, None: 1}
    assert enrich.collection_memory(df.limit(0), "g").count() == 0
    with pytest.raises(ValueError):
        enrich.collection_memory(df, "g", batch=1)


def test_section_summaries(spark):
    schema = "id string, document_id string, order_index int, raw_text string, normalized_text string, ingested_at timestamp_ntz, metadata struct<heading_path array<string>>"
    rows = [("a", "d", 2, "Second text of one.", None, None, (["One"],)), ("b", "d", 1, "First text of one.", None, None, (["One", "x"],)), ("c", "d", 3, "", "Text of two.", None, (["Two"],)), ("e", None, None, "Loose text.", None, None, None), ("n", "d", 1, None, None, None, None)]
    got = {(r.document_id, r.section): (r.summary, r.sources) for r in enrich.section_summaries(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("d", "One"): ("First text of one. Second text of one.", 2), ("d", "Two"): ("Text of two.", 1), ("", ""): ("Loose text.", 1)}


def test_synthesis_groups(spark):
    rows = [(1, i, f"d{i % 9}", f"T{i % 9}") for i in range(20)] + [(2, 1, "x", None), (2, 2, "", "Y"), (2, 3, "x", None)]
    df = spark.createDataFrame(rows, "query_id long, position int, document_id string, title string")
    found = packing.synthesis_groups(df).collect()
    first = [r for r in found if r.query_id == 1]
    assert len(first) == 6 and sorted(p for r in first for p in r.positions) == list(range(20)) and max(len(r.positions) for r in first) <= 6
    for d in range(9):
        assert sum(any(p % 9 == d for p in r.positions) for r in first) == 1
    assert {(r.label, tuple(r.positions)) for r in found if r.query_id == 2} == {("x", (1, 3)), ("Y", (2,))}


def test_lexical_chunks(spark):
    long = "x" * 15_000
    df = spark.createDataFrame([(1, "a.txt", "a\n" * 100), (1, "b.txt", long), (1, "c.txt", ""), (1, "d.txt", None)], "generation_id int, path string, text string")
    got = {(r.path, r.line_start, r.line_end, len(r.content)) for r in chunking.lexical_chunks(df).collect()}
    assert got == {("a.txt", 1, 80, 159), ("a.txt", 81, 101, 40), ("b.txt", 1, 1, 12_000)}


def test_source_admission(spark):
    names = {"../x.py": "excluded_path_escape", "C:\\x.py": "excluded_path_escape", "node_modules/x.js": "excluded_path", "a/.env.local": "excluded_secret", "k.pem": "excluded_secret", "lcov.info": "excluded_generated", "a/b.PNG": "excluded_binary", "src/a.py": None}
    df = spark.createDataFrame([(p, 10, "x = 1", None) for p in names] + [("big.py", 3_000_000, "", None), ("key.py", 9, "AKIA" + "A" * 16, None), ("nul.py", 9, "\0" * 9, None), ("l.py", 1, "x", "inside"), ("m.py", 1, "x", "outside"), ("none.py", None, None, None)], "path string, size long, text string, link string")
    got = {r.path: r.reason for r in admission.source_admission(df).collect()}
    assert got == names | {"big.py": "excluded_large_file", "key.py": "excluded_secret_content", "nul.py": "excluded_binary_content", "l.py": "excluded_symlink", "m.py": "excluded_symlink_escape", "none.py": None}


def test_blobs_vectors_and_audit(spark, tmp_path):
    blobs = spark.createDataFrame([("a\\./b.txt", bytearray(b"x")), ("../up", bytearray(b"y")), ("/abs", bytearray(b"z")), ("n", None)], "name string, content binary")
    assert [(r.name, r.size) for r in documents.write_blobs(blobs, str(tmp_path / "b")).collect()] == [("a/b.txt", 1)]
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "vec_id long, embedding array<double>")
    store = documents.upsert_vectors(None, v, str(tmp_path / "v1"), 2)
    fresh = spark.createDataFrame([(5, [9.0, 9.0]), (700, [1.0, 2.0])], "vec_id long, embedding array<double>")
    once = documents.upsert_vectors(store, fresh, str(tmp_path / "v2"), 2)
    again = documents.upsert_vectors(once, fresh, str(tmp_path / "v3"), 2)
    assert once.count() == again.count() == 601 and again.where("vec_id = 5").first()["embedding"] == [9.0, 9.0]
    with pytest.raises(ValueError):
        documents.upsert_vectors(store, fresh.select("vec_id", F.array(F.lit(1.0)).alias("embedding")), str(tmp_path / "v4"), 2)
    assert not (tmp_path / "v4").exists()


def test_envelope_lines_leave(spark):
    df = spark.createDataFrame([("Title: x\r\n-----\n  body one \u2028Kind: y\n\n body two",), ("",)], "t string")
    assert [r[0] for r in df.select(text.without_envelope(F.col("t"))).collect()] == ["body one body two", ""]
