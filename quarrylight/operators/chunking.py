"""Bounded pieces of text and code with their source spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import cut, spread

_BOUNDARY = re.compile(r"[.!?…][\"'»”)]*\s+|\n+")
BOUNDARY_TYPES = ("heading", "table", "caption", "image", "formula", "page_break")
CODE_LINES, CODE_CHARS = 80, 12_000


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def split_text(text: str, most: int = 800, overlap: int = 80) -> list[tuple[int, int]]:
    """Spans of at most ``most`` tokens (a quarter of the characters), each overlapping the one before.

    A span ends at a sentence or line end in its last 40 %, else at a space.
    """
    if most < 1 or overlap < 0 or overlap >= most:
        raise ValueError("overlap must be smaller than the size, and both positive")
    if not text:
        return []
    n, widest = len(text), most * 4 + 3
    out, start = [], 0
    while start < n:
        hard = min(n, start + widest)
        end = hard
        if hard < n:
            least = start + max(1, int((hard - start) * 0.6))
            marks = [m.end() + start for m in _BOUNDARY.finditer(text[start:hard]) if m.end() + start >= least]
            space = max(text.rfind(" ", least, hard), text.rfind("\t", least, hard))
            end = marks[-1] if marks else space + 1 if space >= least else hard
        out.append((start, end))
        if end >= n:
            break
        back = max(start + 1, end - (overlap * 4 + 3)) if overlap else end
        if overlap and back < end and not text[back - 1].isspace() and not text[back].isspace():
            gap = text.find(" ", back, end)
            back = gap + 1 if gap >= 0 else back
        start = min(end, max(start + 1, back))
    return out


def split_documents(docs: DataFrame, *, most: int = 800, overlap: int = 80, key: str = "doc_id") -> DataFrame:
    """key, position, char_start, char_end, tokens, text of every piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b, tokens_of(t[a:b]), t[a:b]) for k, t in zip(batch[key], batch["text"]) if t for i, (a, b) in enumerate(split_text(t, most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "position", "char_start", "char_end", "tokens", "text"])

    return spread(docs.select(key, "text")).mapInPandas(run, f"`{key}` long, position int, char_start int, char_end int, tokens int, text string")


#: Tokens of a chunk: from so many on it ends at a structural boundary, and never has more; pieces of a longer node overlap.
LEAST, MOST, OVERLAP = 400, 800, 80
#: Rows of a document up to which one task folds it whole.
NODES_PER_TASK = 50_000


def _pieces(rows: pd.DataFrame, most: int, overlap: int) -> Iterator[tuple]:
    """Node, piece of its text and the piece's tokens, in order."""
    for x in rows.sort_values(["order_index", "id"]).itertuples():
        if x.text and x.text.strip():
            for a, b in split_text(x.text, most, overlap):
                yield x, x.text[a:b], tokens_of(x.text[a:b])


def assemble(rows: pd.DataFrame, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP, *, size: int = 0, position: int = 0) -> pd.DataFrame:
    """Chunks of a document's nodes in order; metadata nodes are left out.

    A chunk ends before it would exceed ``most`` tokens, and at a structural
    boundary once it holds ``least``. ``size`` are the tokens that the chunk at
    ``position`` already has from nodes before these.
    """
    chunks, nodes, held, parts, pages = [], [], 0, [], []

    def close() -> None:
        nonlocal nodes, size, held, parts, pages, position
        if parts:
            chunks.append((position, nodes, "\n".join(parts), held, min(pages, default=None)))
        position += size > 0
        nodes, size, held, parts, pages = [], 0, 0, [], []

    for x, piece, t in _pieces(rows, most, overlap):
        if size and (size + t > most or x.node_type in BOUNDARY_TYPES and size >= least):
            close()
        nodes.append(x.id)
        parts.append(piece)
        size += t
        held += t
        if x.page_number == x.page_number and x.page_number is not None:
            pages.append(int(x.page_number))
    close()
    return pd.DataFrame(
        {"position": [c[0] for c in chunks], "node_ids": [list(dict.fromkeys(c[1])) for c in chunks], "text": [c[2] for c in chunks], "tokens": [c[3] for c in chunks], "page": pd.array([c[4] for c in chunks], dtype="Int64")}
    )


def passage(rows: pd.DataFrame, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """For each number of tokens (0 to ``most``) that the open chunk has before these nodes: its tokens behind them, and the chunks closed between."""
    size = np.arange(most + 1)
    closed = np.zeros(most + 1, dtype=int)
    for x, _, t in _pieces(rows, most, overlap):
        ends = (size > 0) & (size + t > most)
        if x.node_type in BOUNDARY_TYPES:
            ends |= (size > 0) & (size >= least)
        closed += ends
        size = np.where(ends, t, size + t)
    return size.tolist(), closed.tolist()


#: Nodes of a wide document whose places are looked at for each border between its blocks.
PER_BORDER = 16


def document_chunks(nodes: DataFrame, *, most_nodes: int = NODES_PER_TASK) -> DataFrame:
    """Chunks of each document; ``block`` is always 0.

    A document of more than ``most_nodes`` rows is folded in blocks of about so
    many nodes. What a block does to an open chunk of any size is found first,
    so each block knows what it goes on with, and no chunk ends where a block does.
    """
    kept = nodes.where(F.col("id").isNotNull())
    latest = kept.groupBy("id").agg(F.max(F.struct("ingested_at", "document_id", "order_index", "node_type", "page_number", F.coalesce("normalized_text", "raw_text").alias("text"), F.col("metadata.content_role").alias("role"))).alias("r")).select("id", "r.*")
    rows = latest.where("role IS NULL OR role <> 'metadata'").select("id", "document_id", F.coalesce("order_index", F.lit(0)).alias("order_index"), "node_type", "page_number", "text")
    schema = "document_id string, block int, position int, node_ids array<string>, text string, tokens int, page int"

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = assemble(frame)
        out.insert(0, "block", 0)
        out.insert(0, "document_id", key[0])
        return out

    # At most a most_nodes-th of the rows.
    wide = cut(kept.groupBy(F.col("document_id").alias("wide_id")).agg(F.count("*").alias("n")).where(F.col("n") > most_nodes).select("wide_id"))
    if wide.isEmpty():
        return rows.groupBy("document_id").applyInPandas(whole, schema)
    is_wide = F.col("document_id").eqNullSafe(F.col("wide_id"))
    few = rows.join(wide, is_wide, "left_anti").groupBy("document_id").applyInPandas(whole, schema)

    place = F.struct(F.coalesce("order_index", F.lit(0)).alias("order_index"), "id")
    seen = kept.where(F.pmod(F.xxhash64("id"), F.lit(max(1, most_nodes // PER_BORDER))) == 0).join(wide, is_wide).groupBy("wide_id").agg(F.sort_array(F.collect_set(place)).alias("p"))
    borders = cut(wide.join(seen.withColumnRenamed("wide_id", "seen_id"), F.col("wide_id").eqNullSafe(F.col("seen_id")), "left").select("wide_id", F.coalesce(F.filter("p", lambda _, i: i % PER_BORDER == PER_BORDER - 1), F.array().cast("array<struct<order_index:int,id:string>>")).alias("borders")))
    # All that follows is one plan with few, so the rows are shuffled by id once.
    placed = rows.join(borders, is_wide).withColumn("block", F.size(F.filter("borders", lambda x: x <= place))).drop("wide_id", "borders")

    def pass_through(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sizes, closed = passage(frame)
        return pd.DataFrame({"document_id": [key[0]], "block": [key[1]], "sizes": [sizes], "closed": [closed]})

    def go_on(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out, size, position = [], 0, 0
        for x in frame.sort_values("block").itertuples():
            out.append((key[0], x.block, size, position))
            size, position = int(x.sizes[size]), position + int(x.closed[size])
        return pd.DataFrame(out, columns=["document_id", "block", "size", "position"])

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = assemble(frame, size=int(frame["size"].iloc[0]), position=int(frame["position"].iloc[0]))
        out.insert(0, "block", key[1])
        out.insert(0, "document_id", key[0])
        return out

    begins = placed.groupBy("document_id", "block").applyInPandas(pass_through, "document_id string, block int, sizes array<int>, closed array<int>")
    begins = begins.groupBy("document_id").applyInPandas(go_on, "document_id string, block int, size int, position int")
    begins = begins.select(F.col("document_id").alias("wide_id"), F.col("block").alias("at"), "size", "position")
    parts = placed.join(begins, is_wide & (F.col("block") == F.col("at"))).drop("wide_id", "at").groupBy("document_id", "block").applyInPandas(part, schema)
    ordered = F.array_sort(F.collect_list(F.struct("block", "node_ids", "text", "tokens", "page")))
    merged = parts.groupBy("document_id", "position").agg(ordered.alias("p"), F.sum("tokens").cast("int").alias("tokens"), F.min("page").alias("page"))
    joined = merged.select("document_id", F.lit(0).alias("block"), "position", F.flatten("p.node_ids").alias("node_ids"), F.array_join("p.text", "\n").alias("text"), "tokens", "page")
    return few.unionByName(joined)


def code_spans(text: str, lines: int = CODE_LINES, chars: int = CODE_CHARS) -> list[tuple[int, int]]:
    """Line spans (from 1) of at most ``lines`` lines and ``chars`` characters; a longer line stands alone."""
    out, start, size = [], 1, 0
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        if i > start and (i - start >= lines or size + len(row) + 1 > chars):
            out.append((start, i - 1))
            start, size = i, 0
        size += len(row) + 1
    out.append((start, len(rows)))
    return out


def code_chunks(files: DataFrame) -> DataFrame:
    """generation_id, path, line_start, line_end, chars of the bounded pieces of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, p, t in zip(batch["generation_id"], batch["path"], batch["text"]):
                if t:
                    held = t.split("\n")
                    rows += [(g, p, a, b, sum(map(len, held[a - 1 : b])) + b - a) for a, b in code_spans(t)]
            yield pd.DataFrame(rows, columns=["generation_id", "path", "line_start", "line_end", "chars"])

    held = files.select("generation_id", "path", "text").where("text IS NOT NULL").distinct()
    return spread(held).mapInPandas(run, "generation_id int, path string, line_start int, line_end int, chars int")


def lexical_chunks(files: DataFrame) -> DataFrame:
    """Bounded pieces of files that no parser reads: id, generation_id, path, line_start, line_end, content.

    A single line beyond the bound is cut to it; the id is a digest of path, text and place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, p, t in zip(batch["generation_id"], batch["path"], batch["text"]):
                held = t.split("\n")
                rows += [(g, p, a, b, "\n".join(held[a - 1 : b])[:CODE_CHARS]) for a, b in code_spans(t)] if t else []
            yield pd.DataFrame(rows, columns=["generation_id", "path", "line_start", "line_end", "content"])

    held = files.where("text IS NOT NULL").select("generation_id", "path", "text").distinct()
    cuts = spread(held).mapInPandas(run, "generation_id int, path string, line_start int, line_end int, content string")
    return cuts.select(F.sha2(F.concat_ws("\x00", "path", "line_start", "line_end", F.sha2("content", 256)), 256).alias("id"), "*")
