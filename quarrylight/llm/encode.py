"""Exact byte-pair encoding by dynamic programming over prefixes.

Every prefix of a piece has exactly one encoding, and that encoding is the one
of a shorter prefix followed by one token. So the table of the last tokens of
all prefixes describes all encodings at once: a token may end a prefix if it is
compatible with the last token before it, meaning that no merge of higher
priority would have joined bytes across their border. Filling the table takes
time linear in the piece, however long a run without white space may be.

Defined cases: null and empty text give an empty list; special tokens are never
produced, their spelling is ordinary text; unpaired surrogates cannot occur in
Spark strings; repeated rows keep their own result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
#: Pieces whose result a worker remembers, and the longest such piece in characters.
CACHE_PIECES, CACHE_LENGTH = 200_000, 64
MAX_VOCABULARY_BYTES = 64 << 20
#: A piece's end depends on at most this many characters behind it.
LOOKAHEAD = 3


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE and the merge that builds each of them."""

    def __init__(self, source: bytes):
        model = json.loads(source)["model"]
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        # Merge priority is the position in the list; it orders the tokens, bytes first.
        self.rank_of: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        names = [bytes([b]) for b in range(256)]
        for left, right in merges:
            a, b = spell(left), spell(right)
            pair = (self.rank_of[a], self.rank_of[b])
            rank = len(self.halves)
            self.halves.append(pair)
            self.joined[pair] = rank
            names.append(a + b)
            self.rank_of[a + b] = rank
        own = {v: k for k, v in letters.items()}
        self.ids = [ids["".join(own[x] for x in name)] for name in names]
        self.longest = max(map(len, names))
        self.known: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two neighbouring tokens."""
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the border, latest first. A merge across the
        # border that comes before the one just undone would have taken its bytes.
        ceiling = len(self.halves)
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < ceiling:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                ceiling, left = left, self.halves[left][1]
            else:
                # Of equal merges the left one comes first, so one across the border may equal it.
                ceiling, right = right + 1, self.halves[right][0]

    def last_tokens(self, piece: bytes, table: list[int] | None = None) -> list[int]:
        """For each prefix of ``piece`` its last token; ``table``, of a shorter prefix, is extended."""
        table = [-1] if table is None else table
        rank_of, longest, fits = self.rank_of, self.longest, self.fits
        for end in range(len(table), len(piece) + 1):
            found = -1
            for start in range(max(0, end - longest), end):
                token = rank_of.get(piece[start:end])
                if token is not None and (start == 0 and self._whole(token, piece[:end]) or start and fits(table[start], token)):
                    found = token
                    break
            table.append(found)
        return table

    def _whole(self, token: int, spelt: bytes) -> bool:
        # A token stands for its own bytes if its two halves meet at a kept border below it.
        if token < 256:
            return True
        left, right = self.halves[token]
        return self.rank_of[spelt] == token and self._reaches(left, right, token)

    def _reaches(self, left: int, right: int, token: int) -> bool:
        key = (-1 - left, right)
        found = self.known.get(key)
        if found is None:
            self.known[key] = True
            ceiling, a, b = token, left, right
            found = True
            while a >= 256 or b >= 256:
                if a > b:
                    ceiling, a = a, self.halves[a][1]
                else:
                    ceiling, b = b + 1, self.halves[b][0]
                across = self.joined.get((a, b))
                if across is not None and across < ceiling:
                    found = False
                    break
            self.known[key] = found
        return found

    def read(self, piece: bytes, table: list[int]) -> list[int]:
        """The encoding of the whole piece, read off its table from the end."""
        out, at = [], len(piece)
        sizes = self.sizes
        while at:
            token = table[at]
            out.append(self.ids[token])
            at -= sizes[token]
        return out[::-1]

    @property
    def sizes(self) -> list[int]:
        if not hasattr(self, "_sizes"):
            self._sizes = [0] * len(self.halves)
            for name, rank in self.rank_of.items():
                self._sizes[rank] = len(name)
        return self._sizes

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            found = tuple(self.read(raw, self.last_tokens(raw)))
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            cache, piece_ids = self.cache, self.piece_ids
            for piece in SPLIT.findall(text):
                out.extend(cache.get(piece) or piece_ids(piece))
        return out


class Encoded:
    """An encoded text that takes appends and edits without starting over."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.ends: list[int] = []
        self.pieces: list[tuple[int, ...]] = []
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace text[start:stop]; only pieces near the edit are encoded anew."""
        from bisect import bisect_right

        text = self.text[:start] + replacement + self.text[stop:]
        keep = bisect_right(self.ends, start - LOOKAHEAD)
        at = self.ends[keep - 1] if keep else 0
        shift = len(replacement) - (stop - start)
        old = {end + shift: i for i, end in enumerate(self.ends) if end >= stop}
        ends, pieces = self.ends[:keep], self.pieces[:keep]
        while at < len(text):
            piece = SPLIT.match(text, at)[0]
            at += len(piece)
            ends.append(at)
            pieces.append(self.vocabulary.piece_ids(piece))
            if at in old and at > start + len(replacement):
                same = old[at]
                ends += [e + shift for e in self.ends[same + 1 :]]
                pieces += self.pieces[same + 1 :]
                break
        self.text, self.ends, self.pieces = text, ends, pieces


@lru_cache(maxsize=2)
def _vocabulary(source: bytes) -> Vocabulary:
    return Vocabulary(source)


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str = BYTE_BPE_50K) -> DataFrame:
    """Ids of each row's whole text; columns ``id_column`` and ids."""
    source = Path(tokenizer_path).read_bytes()
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} is too large to be sent to every executor")
    shared = docs.sparkSession.sparkContext.broadcast(source)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            ids = [vocabulary.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    narrow = docs.select(F.col(id_column), F.col(text_column))
    return spread(narrow).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
