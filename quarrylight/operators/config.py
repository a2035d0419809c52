"""Configuration files: comments, trailing commas, flat keys; landmarks of a repository."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import looks_like_test
from quarrylight.runtime import distinct_texts

_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)
#: Files by which a repository is entered.
PREFERRED = ("readme.md", "agents.md", "pyproject.toml", "package.json", "cargo.toml", "go.mod", "main.py", "app.py", "index.ts", "index.tsx", "main.ts")
#: Words of a focus and the search they open.
FACETS = (
    ({"offline", "desconectado", "cola"}, "offline outbox enqueue queue pending retry sync"),
    ({"flow", "flujo", "pipeline", "recorrido", "trace"}, "flow route endpoint handler service processor projector sync"),
    ({"persistence", "persistencia", "persist", "database", "db"}, "persistence database repository transaction insert projector"),
    ({"isolation", "aislamiento", "tenant", "tienda", "store", "authorization"}, "tenant store isolation auth authorization guard rls policy"),
)


def plain_json(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    bare = _PIECES.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return _TRAILING.sub(lambda m: m[1] or "", bare)


def flat(value, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted keys and scalar values of a nested configuration, without recursion."""
    out, todo = [], [(prefix, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}".lstrip("."), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            out.append((at, json.dumps(v, ensure_ascii=False, default=str)))
    return out


def flat_config(files: DataFrame) -> DataFrame:
    """text_key, language, key, value of every readable JSON and TOML text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, language, text in zip(batch["text_key"], batch["language"], batch["text"]):
                try:
                    value = json.loads(plain_json(text)) if language == "json" else tomllib.loads(text)
                except (ValueError, RecursionError):
                    continue
                rows += [(key, language, k, v) for k, v in flat(value)]
            yield pd.DataFrame(rows, columns=["text_key", "language", "key", "value"])

    # Few distinct texts are left behind the partial aggregation, however many copies there are.
    texts = distinct_texts(files.where(F.col("language").isin("json", "toml")).select("language", "text"), "text", "language", salt=(), hot=[])
    return texts.mapInPandas(run, "text_key string, language string, key string, value string").distinct()


def landmarks(files: DataFrame, limit: int = 20) -> DataFrame:
    """The files to read first per generation: manifests and entries, then sources, tests last."""
    from quarrylight.operators.lexical import top

    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    preferred, test = name.isin(*PREFERRED), looks_like_test(F.col("path"))
    role = F.when(test, "test").when(preferred, "entry_or_manifest").otherwise("source")
    rows = files.select("generation_id", "path").distinct().select("generation_id", "path", role.alias("role"), (~preferred).cast("int").alias("a"), test.cast("int").alias("b"))
    return top(rows, limit, "generation_id", [F.col("a"), F.col("b"), F.col("path")]).drop("a", "b")


def focus_queries(focus: str) -> list[str]:
    """The focus itself and the searches that its words open."""
    plain = " ".join(focus.split())
    words = {w.casefold() for w in re.findall(r"\w+", plain)}
    return list(dict.fromkeys([plain, *[q for cues, q in FACETS if words & cues]])) if plain else []


def duplicate_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
