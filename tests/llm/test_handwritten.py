import itertools
import math

from quarrylight.llm import handwritten as H

FILES = "generation_id int, repository_id string, path string, language string, content_hash string, text string, label string"
CODE = "def run(x):\n    return x + 1\n\n\ndef walk(items):\n    for item in items:\n        yield run(item)\n"


def label(spark, rows):
    df = spark.createDataFrame([(1, "r", p, lang, None, t, "x") for p, lang, t in rows], FILES)
    return {r.path: r.label for r in H.beliefs(df).collect()}


def test_kinds(spark):
    mini = "var a=1;" + "function f(b,c){return b>3?c.size(b):!1};" * 40
    got = label(
        spark,
        [
            ("src/a.py", "python", CODE), ("src/gen.py", "python", "# Code generated by toolgen 1.2. DO NOT EDIT.\n" + CODE), ("src/note.py", "python", "# the report is generated by this script\n" + CODE), ("src/m.js", "javascript", mini),
            ("src/s.py", "python", "H = '# Code generated by x. DO NOT EDIT.'\n" + CODE), ("src\\vendor\\lib.py", "python", CODE), ("./src/package-lock.json", "lockfile", '{"lockfileVersion": 3}'), ("vendor_api/b.py", "python", CODE), ("src/none.py", "python", None), ("src/empty.py", "python", ""),
            ("src/lic.js", "javascript", "/* thing v1.2.3\nCopyright (c) the thing contributors\nReleased under the MIT license */\nexport const a = 1;\n"), ("src/dump.sql", "sql", "INSERT INTO t VALUES (1, 'a');\n" * 30),
        ],
    )
    assert got == {
        "src/a.py": "handwritten", "src/gen.py": "generated", "src/note.py": "handwritten", "src/m.js": "minified", "src/s.py": "handwritten", "src\\vendor\\lib.py": "vendored", "./src/package-lock.json": "blob",
        "vendor_api/b.py": "handwritten", "src/none.py": "handwritten", "src/empty.py": "handwritten", "src/lic.js": "vendored", "src/dump.sql": "blob",
    }


def test_marginals_equal_enumeration(spark):
    """Two sweeps give the marginals that summing over all labellings gives."""
    rows = [("d/a.py", "python", CODE), ("d/e/b.py", "python", "# @generated by tool 3\n" + CODE), ("d/e/vendor.js", "javascript", "/* MIT license */\nx")]
    df = spark.createDataFrame([(1, "r", p, lang, None, t, "x") for p, lang, t in rows], FILES)
    got = {r.path: r.handwritten for r in H.beliefs(df).collect()}
    leaf = {p: [a + b for a, b in zip(H.PRIOR, H.text_evidence(t, lang)[0])] for p, lang, t in rows}
    leaf["d/e/vendor.js"][H.V] += H.LICENCE
    total, mass = 0.0, dict.fromkeys(leaf, 0.0)
    for root, d, e, *ls in itertools.product(range(5), repeat=6):
        w = H.LOG_COMPATIBLE[root][d] + H.LOG_COMPATIBLE[d][e] + H.LOG_COMPATIBLE[d][ls[0]] + H.LOG_COMPATIBLE[e][ls[1]] + H.LOG_COMPATIBLE[e][ls[2]]
        w = math.exp(w + sum(leaf[p][k] for (p, _, _), k in zip(rows, ls)))
        total += w
        for (p, _, _), k in zip(rows, ls):
            mass[p] += w if k == 0 else 0
    for p in leaf:
        assert abs(got[p] - mass[p] / total) < 1e-9


def test_marks_anywhere(spark):
    long = "".join(f"import module_{i}\n" for i in range(30))
    got = label(spark, [
        ("src/a.py", "python", "#!/usr/bin/env python\n" + "# a line\n" * 40 + "# Code generated by toolgen 1.2. DO NOT EDIT.\n" + CODE), ("src/b.py", "python", long + "\n# Code generated by toolgen 1.2. DO NOT EDIT.\n" + CODE),
        ("src/c.py", "python", CODE + "\n# generated by whoever calls this\n" + CODE), ("src/d.json", "json", "{\n" + " " * 900 + "\n  \"lockfileVersion\": 3\n}"), ("src/e.js", "javascript", "// a\n" * 20 + "// Copyright (c) 2019 the thing contributors\nexport const a = 1;\n"),
    ] + [(f"src/k{i}.py", "python", CODE) for i in range(8)])
    assert {p: x for p, x in got.items() if x != "handwritten"} == {"src/a.py": "generated", "src/b.py": "generated", "src/d.json": "blob", "src/e.js": "vendored"}


def test_own_licence_is_no_copy(spark):
    own = "# SPDX-License-Identifier: MIT\n# Copyright 2024 the project\n"
    other = "# Copyright (c) 2011 somebody else, released under the BSD license\n"
    got = label(spark, [(f"src/a{i}.py", "python", own + CODE + f"\n\nX = {i}\n") for i in range(8)] + [(f"src/b{i}.py", "python", CODE + f"\n\nY = {i}\n") for i in range(8)] + [("src/c.py", "python", other + CODE)])
    assert {p for p, x in got.items() if x != "handwritten"} == {"src/c.py"}


def test_subtrees_and_wholes_agree(spark):
    import random

    rng = random.Random(4)
    rows = {}
    for i in range(400):
        path = "/".join(rng.choice("abcv") for _ in range(rng.randrange(6))) + f"/f{i}"
        rows[f"{rng.randrange(2)}\0" + path.strip("/").rpartition("/")[0]] = [rng.gauss(0, 3) for _ in range(5)]
    schema = "node string, " + ", ".join(f"l{k} double" for k in range(5))
    dirs = H._directories(spark.createDataFrame([(n, *v) for n, v in rows.items()], schema))
    whole = {r.node: r[1:] for r in H.directory_beliefs(dirs).collect()}
    for limit in (40, 5, 1):
        parts = H.directory_beliefs(dirs, limit).collect()
        assert len(parts) == len(whole) == len({r.node for r in parts})
        assert all(abs(x - y) < 1e-8 for r in parts for x, y in zip(r[1:], whole[r.node]))


def test_copies_and_empty(spark):
    body = "export class Thing {\n  run(a) {\n    return this.values.filter((v) => v !== a && v.size > 3);\n  }\n}\n"
    df = spark.createDataFrame([(1, "r", "lib/t.js", "javascript", None, body, "x"), (2, "q", "w/u.js", "javascript", None, "// other\n" + body, "x"), (1, "r", "lib/t.js", "javascript", None, body, "x")], FILES)
    assert {r.path: r.label for r in H.beliefs(df).collect()}["lib/t.js"] in H.LABELS
    assert H.beliefs(df.limit(0)).count() == 0
