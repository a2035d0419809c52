"""Parsers of plain text, Markdown and transcripts; readers and sinks of evaluation data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.runtime import spread

_STAMP = re.compile(r"^\s*(?:\[?(\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?\]?)(?:\s*-->\s*(\S+))?")
_ENVELOPE = re.compile(r"^(title|source|url|date|author|language|channel|kind|duration)\s*:\s*(.*)$", re.I)
TRANSCRIPT_LINES, SHORT_LINE = 8, 180
FLUSH_LINES, FLUSH_CHARS, FLUSH_SENTENCE = 8, 1200, 400


def blocks(text: str) -> list[tuple[str, str, int, int, list[str]]]:
    """node type, text, start, end and heading path of the blocks of a plain or Markdown text."""
    out, headings, at = [], [], 0
    for m in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", text):
        block = m[0].strip("\n")
        if not block.strip():
            continue
        start = m.start() + (len(m[0]) - len(m[0].lstrip("\n")))
        lines = block.split("\n")
        at = start
        held: list[str] = []
        held_at = at

        def flush() -> None:
            if held:
                body = "\n".join(held)
                kind = "list_item" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", body) else "code" if body.lstrip().startswith("```") else "table" if body.lstrip().startswith("|") else "paragraph"
                out.append((kind, body.strip(), held_at, held_at + len(body), list(headings)))

        for line in lines:
            mark = re.match(r"(#{1,6})\s+(.*)", line)
            if mark:
                flush()
                held = []
                del headings[len(mark[1]) - 1 :]
                headings.append(mark[2].strip())
                out.append(("heading", mark[2].strip(), at, at + len(line), list(headings)))
            else:
                if not held:
                    held_at = at
                held.append(line)
            at += len(line) + 1
        flush()
    return out


def looks_like_transcript(text: Column) -> Column:
    """A time stamp on a line, or many short lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    stamped = F.exists(lines, lambda x: x.rlike(r"^\s*\[?(\d{1,2}:)?\d{1,2}:\d{2}([.,]\d+)?\]?"))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= SHORT_LINE))
    return stamped | (F.size(lines) >= TRANSCRIPT_LINES) & (short >= 0.8 * F.size(lines))


def transcript(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """role, text, first and last time stamp of the paragraphs of a transcript."""
    out, held, first, last, now = [], [], None, None, None
    started = False

    def flush() -> None:
        nonlocal held, first, last
        if held:
            out.append(("body", " ".join(held), first, last))
        held, first, last = [], None, None

    for line in text.split("\n"):
        plain = line.strip()
        if not plain or plain.isdigit():
            continue
        envelope = _ENVELOPE.match(plain)
        if envelope and not started:
            out.append(("metadata", plain, None, None))
            continue
        stamp = _STAMP.match(line)
        if stamp:
            now = re.sub(r"[\[\]]", "", stamp[0].split("-->")[0].strip())
            plain = line[stamp.end() :].strip()
            if not plain:
                continue
        started = True
        first = first or now
        last = now or last
        held.append(plain)
        size = sum(map(len, held))
        if len(held) >= FLUSH_LINES or size >= FLUSH_CHARS or len(held) >= 2 and size >= FLUSH_SENTENCE and plain[-1:] in ".!?":
            flush()
    flush()
    return out


NODE = "doc_id long, position int, node_type string, text string, char_start int, char_end int, heading_path array<string>, timestamp_start string, timestamp_end string, content_role string"


def parse_documents(docs: DataFrame) -> DataFrame:
    """Nodes of every document: transcripts by time, other texts by blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, timed in zip(batch["doc_id"], batch["text"], batch["timed"]):
                if not text:
                    continue
                if timed:
                    rows += [(doc, i, "paragraph", t, None, None, [], a, b, role) for i, (role, t, a, b) in enumerate(transcript(text))]
                else:
                    rows += [(doc, i, kind, t, a, b, path, None, None, "body") for i, (kind, t, a, b, path) in enumerate(blocks(text))]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])
            yield out.astype({"char_start": "Int32", "char_end": "Int32"})

    held = docs.select("doc_id", "text", looks_like_transcript(F.col("text")).alias("timed"))
    return spread(held).mapInPandas(run, NODE)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON, missing fields filled."""
    schema = "id string, category string, question string, expected_answer string, expected_keywords array<string>, route_mode string, mode string, min_distinct_documents int, min_citations int"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(
        "id", F.coalesce("category", F.lit("general")).alias("category"), "question", F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
        F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("expected_keywords"), F.coalesce("route_mode", F.lit("auto")).alias("route_mode"), F.coalesce("mode", F.lit("strict")).alias("mode"),
        F.coalesce("min_distinct_documents", F.lit(1)).alias("min_distinct_documents"), F.coalesce("min_citations", F.lit(1)).alias("min_citations"),
    )


def write_generation(df: DataFrame, folder: str, generation_id: int) -> None:
    """Write one generation's rows as a partition, then its manifest; readers look for the manifest first."""
    df.write.mode("overwrite").parquet(f"{folder}/generation_id={generation_id}")
    spark = df.sparkSession
    spark.createDataFrame([(generation_id,)], "generation_id int").write.mode("overwrite").json(f"{folder}/_manifest/{generation_id}")


def answer_markdown(question: Column, answer: Column, citations: Column) -> Column:
    """A Markdown report of an answer with its numbered sources."""
    sources = F.array_join(F.transform(citations, lambda c, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), c)), "")
    return F.concat(F.lit("# "), question, F.lit("\n\n"), answer, F.lit("\n\n## Sources\n"), sources)


def audit_events(steps: DataFrame) -> DataFrame:
    """Audit rows with their duration in milliseconds and their metrics as JSON."""
    ms = F.round((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000, 2)
    return steps.select("stage", "status", ms.alias("duration_ms"), F.to_json("metrics").alias("metrics"))


def blob_path(name: Column) -> Column:
    """The place of a blob below its store: a plain relative path, null for one that would leave it."""
    plain = F.array_join(F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda p: (p != "") & (p != ".")), "/")
    return F.when((plain != "") & ~F.array_contains(F.split(plain, "/"), "..") & ~name.rlike(r"^[/\\]|^[A-Za-z]:"), plain)


def write_blobs(rows: DataFrame, folder: str) -> DataFrame:
    """Write blobs (name, content) with their digest and size, by the first two digits of the digest; returns what was written."""
    kept = rows.select(blob_path(F.col("name")).alias("name"), "content", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("size")).where("name IS NOT NULL AND content IS NOT NULL")
    kept.withColumn("part", F.substring("digest", 1, 2)).write.mode("overwrite").partitionBy("part").parquet(folder)
    return rows.sparkSession.read.parquet(folder).drop("part")


#: Vectors that one batch of an upsert writes.
UPSERT_BATCH = 256


def upsert_vectors(store: DataFrame | None, incoming: DataFrame, folder: str, dimensions: int, *, key: str = "vec_id", value: str = "embedding", batch: int = UPSERT_BATCH) -> DataFrame:
    """Write a store of vectors with the incoming ones in place of those of equal key, in ordered batches.

    The same call again writes the same rows. A vector of another length fails
    the whole call before anything is written.
    """
    wrong = incoming.where(F.col(value).isNull() | (F.size(value) != dimensions))
    if not wrong.isEmpty():
        raise ValueError(f"a vector does not have {dimensions} dimensions")
    fresh = incoming.groupBy(key).agg(F.max(F.struct(value)).alias("v")).select(key, f"v.{value}")
    rows = fresh if store is None else store.select(key, value).join(fresh.select(key), key, "left_anti").unionByName(fresh)
    rows.withColumn("batch", F.floor(F.col(key) / batch)).repartition("batch").sortWithinPartitions("batch", key).write.mode("overwrite").parquet(folder)
    return incoming.sparkSession.read.parquet(folder)


def append_audit(steps: DataFrame, folder: str) -> None:
    """Append audit rows to a table of theirs."""
    audit_events(steps).write.mode("append").json(folder)
