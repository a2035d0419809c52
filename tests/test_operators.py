import numpy as np
import pandas as pd

from quarrylight.operators import chunking, enrich, packing, vectors
from quarrylight.sources import admission, documents


def test_split_text_bounds_and_covers():
    text = ("A sentence of some words. " * 90 + "x" * 500).strip()
    spans = chunking.split_text(text, 40, 5)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(chunking.tokens_of(text[a:b]) <= 40 for a, b in spans)
    assert all(b1 >= a2 > a1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))
    assert chunking.split_text("") == []


def test_keyword_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    words = [f"keyword{i}" for i in range(12)] + ["and", "the"]
    rows = pd.DataFrame({"pos": range(40), "sentence": [" ".join(rng.choice(words, 5)) for _ in range(40)]})
    sets = [{w for w in s.split() if len(w) >= 5} for s in rows["sentence"]]
    counts = {w: sum(w in s for s in sets) for w in words}
    sets = [{w for w in s if counts[w] <= max(2, 10)} for s in sets]
    degree, want = [0] * 40, []
    for i in range(40):
        for j in range(i + 2, 40):
            if degree[i] < 5 and degree[j] < 5 and sets[i] & sets[j]:
                want.append((i, j))
                degree[i] += 1
                degree[j] += 1
    assert [tuple(x) for x in enrich.keyword_links(rows).to_numpy()] == want


def test_summary_restores_order_and_drops_repeats():
    text, places = enrich.summarise(["Short one. The archive keeps every notebook of the team. The archive keeps every notebook of the team! Nothing else here matters much."], 2)
    assert places == sorted(places) and len(places) == 2
    assert enrich.summarise(["", None]) == ("", [])


def test_packing_respects_caps():
    rows = pd.DataFrame(
        {"query_id": 1, "id": [str(i) for i in range(30)], "position": range(1, 31), "route": "factual_local", "source_type": ["chunk"] * 20 + ["graph_edge"] * 10, "document_id": ["d1"] * 10 + [f"d{i}" for i in range(20)],
         "tokens": 300, "utility": 1.0, "citable": True, "low": False}
    )
    out = packing.choose(rows)
    assert out["tokens"].sum() <= 3200 and len(out) <= 12
    assert (rows[rows["id"].isin(out["id"])].groupby("document_id").size() <= 4).all()


def test_quantizer_keeps_neighbours():
    rng = np.random.default_rng(5)
    data = rng.standard_normal((1000, 384))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    code = vectors.encode(data)
    q = data[:20]
    estimate, exact = vectors.estimate(q, *code), q @ data.T
    assert np.abs(estimate - exact).mean() < 0.2
    best = [set(np.argsort(-e)[:10]) for e in exact]
    close = [set(np.argsort(-e)[:40]) for e in estimate]
    assert np.mean([len(a & b) / 10 for a, b in zip(best, close)]) >= 0.9
    back = vectors.decode(*code, 384)
    assert ((back * data).sum(axis=1) / np.linalg.norm(back, axis=1)).min() > 0.75
    codes = rng.integers(0, 8, (7, 10))
    assert (vectors.unpack(vectors.pack(codes, 3), 10, 3) == codes).all()


def test_parsers():
    kinds = [(k, t) for k, t, *_ in documents.blocks("# Title\n\nSome text\nmore\n\n- item one\n\n## Sub\nbody")]
    assert kinds == [("heading", "Title"), ("paragraph", "Some text\nmore"), ("list_item", "- item one"), ("heading", "Sub"), ("paragraph", "body")]
    text = "a\n\nb"
    assert [text[a:b] for _, _, a, b, _ in documents.blocks(text)] == ["a", "b"]
    parts = documents.transcript("title: x\n[00:01] hello there\n[00:02] again.")
    assert parts == [("metadata", "title: x", None, None), ("body", "hello there again.", "00:01", "00:02")]


def test_git_statuses():
    assert admission.git_statuses("R  new\0old\0 M a.py\0?? b\0") == [("new", "R"), ("a.py", "M"), ("b", "??")]


def test_scan_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\0" * 100)
    rows = admission.scan_directory(spark, str(tmp_path)).collect()
    assert [(r.path, r.language, r.text) for r in rows] == [("src/a.py", "python", "x = 1\n")]


def test_config():
    from quarrylight.operators import config

    assert config.plain_json('{"a": "// no", /* x */ "b": [1, 2,], // y\n}') == '{"a": "// no",   "b": [1, 2],  \n}'.replace("],  \n", "]  \n")
    assert config.flat({"a": {"b": [1, {"c": None}]}, "d": "x"}) == [("a.b[0]", "1"), ("a.b[1].c", "null"), ("d", '"x"')]
    assert config.focus_queries("offline store") == ["offline store", config.FACETS[0][1], config.FACETS[3][1]]


def test_quantized_search_serves_the_exact_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((400, 64))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id % 10 = 0")
    got = vectors.search_quantized(vectors.quantized(rows), asked, 10, exact=rows, block=7).collect()
    want = vectors.search(rows, asked, 10).collect()
    assert len(got) == len(want) == 400
    assert len({(r.query_id, r.vec_id) for r in got} & {(r.query_id, r.vec_id) for r in want}) >= 0.9 * 400
    exact = {(r.query_id, r.vec_id): r.score for r in want}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-8 for r in got if (r.query_id, r.vec_id) in exact)
    assert [r.rank for r in sorted(got, key=lambda r: (r.query_id, -r.score, r.vec_id))] == [*range(1, 11)] * 40
