"""Which source files every dialect of their language's grammar rejects.

Token kinds, not texts, decide. The parser keeps each distinct bracketed part
(and in Python each distinct statement) of the texts it has seen as a node of
its stack graph, so what recurs between files is parsed once per worker.

Defined cases: null text has no verdict of its own (its content hash may have
one); empty and blank texts are valid except as JSON; languages without a
grammar are never flagged; duplicate names are no errors; repeated rows count
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import canonical_digest
from quarrylight.llm.syntax.grammars import LANGUAGES, grammar, lexer
from quarrylight.llm.syntax.lexers import BAD
from quarrylight.runtime import distinct_texts, hot_keys, spread_join



class Checker:
    """Verdicts of one worker; ``more`` names dialects that count besides the usual ones."""

    def __init__(self, more: tuple[str, ...] = ()) -> None:
        self.more = more

    def valid(self, text: str, language: str) -> bool:
        if not text.strip("\ufeff \t\r\n"):
            return language != "json"
        kinds, fresh = lexer(language, self.more)(text)
        return BAD not in kinds and grammar(language, self.more).parse(kinds, fresh or None) < 0


@lru_cache(maxsize=1)
def _checker() -> Checker:
    """One per Python worker, which serves many tasks."""
    return Checker()


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    checker = _checker()
    for batch in batches:
        bad = [not checker.valid(t, lang) for t, lang in zip(batch["text"], batch["language"])]
        yield batch.loc[bad, ["text_key", "language"]]


def _keyed(files: DataFrame) -> DataFrame:
    """The rows of supported languages with the key of their text."""
    key = F.coalesce(F.sha2("text", 256), canonical_digest(F.col("content_hash"), F.lit(None).cast("string")))
    return files.where(F.col("language").isin(*LANGUAGES)).select("generation_id", "repository_id", "path", "language", "text", key.alias("text_key"))


def rejected_texts(keyed: DataFrame, hot: list[int]) -> DataFrame:
    """text_key and language of every distinct text that is invalid in its language."""
    texts = distinct_texts(keyed, "text", "language", salt=("generation_id", "path"), hot=hot)
    bad = texts.mapInPandas(_judge, "text_key string, language string")
    return bad.distinct() if hot else bad


def _judged(files: DataFrame, how: str) -> DataFrame:
    keyed = _keyed(files)
    hot = hot_keys(keyed, "text_key")
    bad = rejected_texts(keyed, hot)
    if how == "left":
        bad = bad.withColumn("bad", F.lit(1))
    return spread_join(keyed.drop("text").distinct(), bad, ["text_key", "language"], how, hot, ("generation_id", "path"))


def invalid_files(files: DataFrame) -> DataFrame:
    """The rows of ``files`` whose text is invalid; distinct generation_id, repository_id, path, language."""
    return _judged(files, "left_semi").drop("text_key").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files and share of invalid ones per repository and language."""
    return _judged(files, "left").groupBy("repository_id", "language").agg(
        F.count("*").alias("files"), F.count("bad").alias("invalid"), F.avg(F.coalesce("bad", F.lit(0))).alias("rate")
    )
