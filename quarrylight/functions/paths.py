"""Canonical spellings of repository paths and digests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode composition; null stays null."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def canonical_path(path: Column) -> Column:
    """Plain relative path: single "/", no "." parts, composed letters."""
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    return nfc(F.array_join(parts, "/"))


def canonical_digest(digest: Column, text: Column) -> Column:
    """Lower-case hex SHA-256 without algorithm prefix; a null one is computed from ``text``."""
    plain = F.regexp_replace(F.lower(F.trim(digest)), r"^sha-?256[:=\-]\s*", "")
    return F.coalesce(plain, F.sha2(text, 256))
