import random

import pandas as pd
from quarrylight.operators import chunking

NODES = "id string, document_id string, order_index int, node_type string, page_number int, raw_text string, normalized_text string, metadata struct<content_role: string>, ingested_at timestamp"


def rows_of(document, n, spacing, rng):
    kinds = ["paragraph"] * 6 + ["heading", "table"]
    text = lambda: rng.choice(["", None, "word " * rng.randrange(1, 400), "A sentence. " * rng.randrange(1, 900)])
    return [(f"{document}{i:04}", document, i // 2 * spacing, rng.choice(kinds), rng.choice([None, i]), text(), None, None, None) for i in range(n)]


def found(df):
    return {(r.document_id, r.position): (r.block, list(r.node_ids), r.text, r.tokens, r.page) for r in df.collect()}


def test_blocks_do_not_end_chunks(spark):
    """A wide document has the chunks of its whole fold, however small its blocks and however wide its places."""
    rng = random.Random(3)
    rows = [*rows_of("a", 90, 40_000_000, rng), *rows_of("b", 70, 0, rng), *rows_of("c", 9, 10, rng), *((f"n{i}", *r[1:]) for i, r in enumerate(rows_of(None, 40, 3, rng)))]
    df = spark.createDataFrame(rows, NODES)
    whole = {}
    for document in ("a", "b", "c", None):
        frame = pd.DataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in rows if r[1] == document], columns=["id", "order_index", "node_type", "page_number", "text"])
        for c in chunking.assemble(frame).itertuples():
            whole[document, c.position] = (0, c.node_ids, c.text, c.tokens, None if pd.isna(c.page) else c.page)
    assert len(whole) > 40
    for most in (1, 20, 50, 50_000):
        assert found(chunking.document_chunks(df, most_nodes=most)) == whole, most
