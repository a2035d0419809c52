"""Evaluation passages that appear in the corpus.

Each shard of the corpus gets a suffix array over its words. Every suffix of
the evaluation passages is looked up in it by binary search: the interval of
suffixes that begin with the same ``SEED_WORDS`` words. A window of ``words``
words with at most one of them changed always holds a verbatim run of half its
remaining words, so no window escapes this search; each hit is then checked on
the window itself.

Defined cases: letter case, accents, punctuation, spacing, markup and escapes
are ignored on both sides; null and empty texts hold nothing; passages shorter
than the window cannot leak; null passages and items without an id are ignored; repeated rows count
once; an item leaks through its question and its answer separately.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import spread

WINDOW_WORDS = 14
MAX_CHANGED = 1
#: Words of corpus text in one suffix array; bounds a worker's memory.
SHARD_WORDS = 500_000
#: Hits whose windows are compared at once.
HIT_BLOCK = 50_000
#: Words of evaluation text sent to the executors at once; more are taken in blocks.
BLOCK_WORDS = 1_000_000

_ESCAPES = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\x([0-9a-fA-F]{2})|\\([nrtfvb0\"'/\\])")
_TAGS = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<!--(?:(?!<!--).)*?-->", re.S)
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_CUES = re.compile(r"(?m)(?:^[ \t]*\d+[ \t]*\r?\n)?^[ \t]*\d+:\d\d:\d\d[.,]\d+[ \t]*-->.*$|^[ \t]*\[\d+:\d\d(?::\d\d)?\]")
_WORDS = re.compile(r"[^\W_]+")


def _unescape(found: re.Match) -> str:
    code = found[1] or found[2]
    if code:
        value = int(code, 16)
        return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else " "
    return found[3] if found[3] in "\"'/" else " "


def _percent(found: re.Match) -> str:
    return bytes.fromhex(found[0].replace("%", "")).decode("utf-8", "replace")


def words_of(text: str | None) -> list[str]:
    """The bare words of a text: no case, accents, punctuation, markup or escapes."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPES.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "-->" in text or "[" in text:
        text = _CUES.sub(" ", text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORDS.findall(text.casefold())


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first ``depth`` words from each, by prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        pair = rank * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_pair[1:] != sorted_pair[:-1])))
        if rank.max(initial=0) == n - 1:
            break
        width *= 2
    return order


def _compare(words: np.ndarray, starts: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sign of corpus suffix minus query row, over the query's width."""
    n, width = len(words), query.shape[1]
    sign = np.zeros(len(starts), dtype=np.int8)
    for k in range(width):
        at = starts + k
        mine = np.where(at < n, words[np.minimum(at, n - 1)], -1)
        sign = np.where(sign == 0, np.sign(mine - query[:, k]).astype(np.int8), sign)
    return sign


def search(words: np.ndarray, order: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of ``order`` whose suffixes begin with each row of ``query``."""
    ends = []
    for upper in (False, True):
        low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(order), dtype=np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            sign = _compare(words, order[np.minimum(mid, len(order) - 1)], query)
            right = (sign < 0) | ((sign == 0) & upper)
            go = low < high
            low = np.where(go & right, mid + 1, low)
            high = np.where(go & ~right, mid, high)
        ends.append(low)
    return ends[0], ends[1]


def longest_runs(words: np.ndarray, at: np.ndarray, tests: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Verbatim words from each pair of positions on; a passage's end closes its runs."""
    run = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        a, b = at[open_] + run[open_], q[open_] + run[open_]
        ok = (a < len(words)) & (b < len(tests))
        mine = words[np.minimum(a, len(words) - 1)]
        open_ = open_[ok & (mine > 0) & (mine == tests[np.minimum(b, len(tests) - 1)])]
        run[open_] += 1
    return run


class Passages:
    """The words of the evaluation items, numbered, with 0 between passages."""

    def __init__(self, items: list[tuple[int, str | None]], words: int, changed: int):
        self.words, self.changed = words, changed
        self.seed = -(-(words - changed) // (changed + 1))
        self.number: dict[str, int] = {}
        flat, owner, first = [0], [-1], [0]
        for item, text in items:
            found = words_of(text)
            if len(found) < words:
                continue
            begin = len(flat)
            for w in found:
                flat.append(self.number.setdefault(w, len(self.number) + 1))
                owner.append(item)
                first.append(begin)
            flat.append(0)
            owner.append(-1)
            first.append(begin)
        self.flat, self.owner, self.first = (np.array(x, dtype=np.int64) for x in (flat, owner, first))
        if len(self.flat) > self.seed:
            view = np.lib.stride_tricks.sliding_window_view(self.flat, self.seed)
            self.starts = np.nonzero((view > 0).all(axis=1))[0]
            self.rows = view[self.starts]
        else:
            self.starts, self.rows = np.zeros(0, dtype=np.int64), np.zeros((0, self.seed), dtype=np.int64)

    def find(self, words: np.ndarray, doc_of: np.ndarray) -> pd.DataFrame:
        """Leaks in one shard: doc (row number), item, the longest verbatim run, and the words at which it begins in both."""
        none = pd.DataFrame({"doc": [], "item_id": [], "run": [], "doc_word": [], "item_word": []}).astype("int64")
        if not len(self.rows) or not len(words):
            return none
        order = suffix_array(words, self.seed)
        order = order[words[order] > 0]
        if not len(order):
            return none
        low, high = search(words, order, self.rows)
        many = np.cumsum(high - low)
        found = []
        for block in range(0, int(many[-1]) if len(many) else 0, HIT_BLOCK):
            # Hits are numbered through; only those of one block exist at a time.
            number = np.arange(block, min(block + HIT_BLOCK, int(many[-1])))
            h = np.searchsorted(many, number, side="right")
            p = order[high[h] - (many[h] - number)]
            q = self.starts[h]
            span = self.words - self.seed
            steps = np.arange(-span, self.words)
            a, b = p[:, None] + steps, q[:, None] + steps
            inside = (a >= 0) & (a < len(words)) & (b >= 0) & (b < len(self.flat))
            mine, test = words[np.clip(a, 0, len(words) - 1)], self.flat[np.clip(b, 0, len(self.flat) - 1)]
            inside &= (test > 0) & (doc_of[np.clip(a, 0, len(words) - 1)] == doc_of[p][:, None]) & (mine >= 0)
            cost = np.where(inside, (mine != test).astype(np.int64), self.words + 1)
            total = np.concatenate((np.zeros((len(p), 1), dtype=np.int64), np.cumsum(cost, axis=1)), axis=1)
            good = ((total[:, self.words :] - total[:, : -self.words]) <= self.changed).any(axis=1)
            if good.any():
                p, q = p[good], q[good]
                begins = np.searchsorted(doc_of, doc_of[p])
                part = pd.DataFrame({"doc": doc_of[p], "item_id": self.owner[q], "run": longest_runs(words, p, self.flat, q), "doc_word": p - begins, "item_word": q - self.first[q]})
                found.append(_longest(part))
        return _longest(pd.concat(found)) if found else none


def _longest(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each document and item the longest run, of equal ones the first."""
    rows = rows.sort_values(["doc", "item_id", "run", "doc_word", "item_word"], ascending=[True, True, False, True, True])
    return rows.drop_duplicates(["doc", "item_id"])


def _shards(batches: Iterator[pd.DataFrame], number: dict[str, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents of one shard: their ids, their words (0 unknown, -1 border) and owners."""
    ids, flat, sizes = [], [], []
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist()):
            # Words that no evaluation item holds can be part of no match; they are all one number.
            found = [number.get(w, 0) for w in words_of(text)]
            if not found:
                continue
            ids.append(doc_id)
            flat.append(np.array([*found, -1], dtype=np.int64))
            sizes.append(len(found) + 1)
            total += sizes[-1]
            if total >= SHARD_WORDS:
                yield ids, np.concatenate(flat), np.repeat(np.arange(len(ids)), sizes)
                ids, flat, sizes, total = [], [], [], 0
    if ids:
        yield ids, np.concatenate(flat), np.repeat(np.arange(len(ids)), sizes)


def leaked_passages(
    docs: DataFrame, items: DataFrame, *, words: int = WINDOW_WORDS, changed: int = MAX_CHANGED, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, item_id of every leak, its longest verbatim run of words, and the words of document and passage at which that begins.

    ``docs``: doc_id, text. ``items``: item_id, passage (one row per passage).
    The held-out items are a stated query set: they go over all documents in
    blocks of bounded size.
    """
    narrow = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    blocks, block, size = [], [], 0
    for row in items.where("passage IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "passage").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        size += row[1].count(" ") + 1
        if size >= block_words:
            blocks.append(block)
            block, size = [], 0
    blocks.append(block)
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast((sorted(block), words, changed))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = Passages(*shared.value)
            for ids, flat, doc_of in _shards(batches, passages.number):
                found = passages.find(flat, doc_of)
                if len(found):
                    yield pd.DataFrame(
                        {"doc_id": [ids[d] for d in found["doc"]], "item_id": found["item_id"], **{n: found[c].astype("int32") for n, c in (("longest_run", "run"), ("doc_word", "doc_word"), ("item_word", "item_word"))}}
                    )

        part = narrow.mapInPandas(run, "doc_id long, item_id long, longest_run int, doc_word int, item_word int")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("longest_run", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best"))
    return best.select("doc_id", "item_id", "best.longest_run", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def golden_passages(golden: DataFrame) -> DataFrame:
    return golden.select("item_id", F.explode(F.array("question", "expected_answer")).alias("passage"))


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no evaluation passage."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
