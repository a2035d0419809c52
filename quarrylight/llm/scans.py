"""Damage in text from scanned pages: found, corrected, reflowed.

Skip-gram vectors are learnt from the corpus itself. A form is linked to the
frequent words that plausible glyph edits turn it into and that are many times
as usual; the vectors of the words around it decide which of them is meant, or
none. Furniture (running heads, printed page numbers) is recognised from its
repetition within a document and from its shape, and removed before the lines
flow together again; a word cut at a node's end is made whole with the next
node's first word.

All statistics cover the whole corpus, and the rules are ratios, the same at
every size. Every frequent word has a vector, trained on every pair that is
counted PAIR_LEAST times; what is more than one task may hold is trained in
blocks of words.

Defined cases: the row with the latest ingested_at stands for a node; null and
empty texts have no damage; code, formulas, images and table cells are left as
they are; repeated rows count once; a head must occur twice in its document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quarrylight.runtime import cut, hot_keys, parallelism, partitions_for, spread_join

BODY = ("paragraph", "list_item", "footnote", "caption")
#: A word is frequent from so many occurrences on, and a candidate for a form if it is so many times as usual.
FREQUENT_LEAST, TIMES_AS_USUAL = 8, 15
PAIR_LEAST = 3
DIMENSIONS, WINDOW, EPOCHS = 24, 3, 6
#: Words and pairs, each in both directions, that one task trains at once; more are cut into blocks.
BLOCK_WORDS, BLOCK_PAIRS = 30_000, 2_000_000
#: Words up to which a table goes to every executor.
BROADCAST_WORDS = 500_000
#: Tokens that a worker remembers as needing nothing.
MOST_CALM = 300_000
#: From this many times as usual on, the form is no word of its own, whatever its vector says.
SURE_TIMES = 60
#: Below, the correction must fit its surroundings so much better than the form it replaces.
FIT_MARGIN = 0.2
#: A correction that fits its surroundings so much less than it fits any is none.
FIT_LESS = 0.3
#: Share of a document's pages from which a repeated first line is a head whatever its shape.
HEAD_SHARE = 0.15
#: The same for lines shaped like heads.
SHAPED_SHARE = 0.01

#: What scanning turns a letter or pair of letters into.
GLYPHS = {
    "@": "a", "0": "o", "1": "li", "5": "s", "!": "il", "+": "t", "6": "óboéè", "|": "li", "8": "b", "9": "g", "2": "z", "$": "s", "3": "e", "4": "a", "7": "t", "€": "e",
    "\\/": "v", "rn": "m", "m": ("rn", "in", "ni"), "ri": "n", "n": ("ri", "u", "h"), "cl": "d", "d": ("cl",), "ii": "u", "u": ("ii", "n"), "fi": "ñ", "c": ("e",), "e": ("c",), "li": "h", "h": ("li", "b", "n"), "b": ("h", "6"), "vv": "w",
    "l": ("i", "t", "1"), "i": ("l", "í"), "f": ("t",), "t": ("f", "l"), "ﬁ": ("fi", "i"), "ﬂ": ("fl",), "ſ": "s", "nn": "m", "lc": "k", "ä": ("á", "à"), "ö": ("ó", "ò"), "ë": ("é", "è"), "ï": ("í",), "ü": ("ú",), "q": ("g",), "g": ("q",), "y": ("v",), "v": ("y",), "j": ("i",), "o": ("c",), "a": ("o",),
}
_HYPHEN = "-‐­¬"
_CUT = re.compile(rf"([^\W\d_]+)[{_HYPHEN}][ \t]*$")
_ROMAN = r"(?:(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_PAGE_WORD = r"(?:página|pagina|pàgina|page|seite|pág\.|pag\.|pàg\.|p\.|s\.)"
_NUMBER = rf"(?:\d{{1,5}}|{_ROMAN})"
_PAGE = re.compile(rf"^\s*(?:[\[(\-–—·•]\s*)?(?:{_PAGE_WORD}\s*)?{_NUMBER}(?:\s*(?:de|of|sur|von|di|da|/)\s*\d{{1,5}})?\s*(?:[\])\-–—·•])?\s*$", re.I)
_HEAD_NUMBER = re.compile(rf"(?:\s{{3,}}|\s*[·•|]\s*|\t+)(?:[\[(\-–—]\s*)?(?:{_PAGE_WORD}\s*)?{_NUMBER}(?:\s*(?:de|of|sur|von|di|/)\s*\d{{1,5}})?\s*[\])\-–—]?\s*$|^\s*(?:{_PAGE_WORD}\s*)?{_NUMBER}(?:\s{{3,}}|\s*[·•|]\s*)(?=\S)", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_COMPOUND = re.compile(r"(?<![\w\-])[^\W\d_]{2,}-[^\W\d_]{2,}(?![\w\-])")
_TOKEN = re.compile(r"\S+")
_SIGNED = re.compile(r"\S*(?:[@0-9!+|$€ﬁﬂſ]|\\/)\S*")
_JOINTS = re.compile(r"(['’\-])")
#: Signs among the letters of a word.
_INSIDE = re.compile(r"[^\W\d_]+(?:(?:[@01569!+|$]|\\/)+[^\W\d_]+)+")
_SPACES = re.compile(r"[ \t]+")
#: Stands where a line end had cut a word.
CUT_MARK = "\x01"
_CUT_HERE = re.compile(r"([^\W\d_]+)\x01([^\s\x01]*)")
_EDGE = "\"'“”‘’«»()[]{}¿¡.,;:…–—"
_FOLD = (("\\/", "v"), ("@", "a"), ("0", "o"), ("6", "o"), ("1", "l"), ("!", "l"), ("|", "l"), ("5", "s"), ("+", "t"), ("ﬁ", "fi"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("fi", "n"), ("i", "l"), ("c", "e"), ("b", "o"))


def fold(line: str) -> str:
    """A line's key: the same for a head and its misread copies."""
    s = "".join(c for c in unicodedata.normalize("NFKD", line.lower()) if not unicodedata.combining(c))
    for seen, meant in _FOLD:
        s = s.replace(seen, meant)
    return re.sub(r"[^a-z]+", "", s)


def head_line(text: str) -> tuple[str, bool] | None:
    """Key of a node's first line, if it may be a head, and whether its shape speaks for one."""
    lines = text.split("\n")
    if len(lines) < 2 or not lines[0].strip():
        return None
    first, rest = lines[0].rstrip(), [x for x in lines[1:] if x.strip() and not _PAGE.match(x)]
    title = _HEAD_NUMBER.sub("", first).strip()
    key = fold(title)
    if len(key) < 5:
        return None
    numbered = title != first.strip()
    letters = [c for c in title if c.isalpha()]
    capitals = len(letters) > 4 and sum(c.isupper() for c in letters) > 0.85 * len(letters)
    # A line that breaks although the next word would have fitted was not broken by wrapping.
    width = max((len(x.rstrip()) for x in rest), default=0)
    after = rest[0].split()[0] if rest and rest[0].split() else ""
    loose = bool(rest) and title[-1:] not in ".!?:;,…" and (len(first) + 1 + len(after) <= width or len(first) > width + 2)
    return key, numbered or capitals or loose


def body_lines(text: str, head: bool) -> tuple[list[str], bool, bool]:
    """The lines without furniture; whether a page number was in a line or in the head."""
    lines = text.split("\n")
    number = False
    if head:
        number = bool(_HEAD_NUMBER.search(lines[0]))
        lines = lines[1:]
    while len(lines) > 1 and not lines[-1].strip():
        lines = lines[:-1]
    for at in (-1, 0):
        if lines and _PAGE.match(lines[at]) and lines[at].strip():
            number = True
            del lines[at]
    return lines, head, number


def joined(lines: list[str]) -> tuple[str, bool]:
    """One line of text with CUT_MARK where a line end had cut a word; whether the text's end cuts one."""
    out, open_end = "", False
    last = len(lines) - 1
    for i, line in enumerate(lines):
        line = line.strip()
        if not line:
            continue
        out += line if not out or out[-1] == CUT_MARK else " " + line
        if line[-1] in _HYPHEN and _CUT.search(line):
            if i < last and any(x.strip() for x in lines[i + 1 :]):
                out = out[:-1] + CUT_MARK
            else:
                open_end = True
    return out, open_end


# ---- words -----------------------------------------------------------------


@lru_cache(maxsize=200_000)
def readings(word: str) -> tuple[str, ...]:
    """What a misread lower-case word may have been: one edit, or two of which one is of a sign."""
    once: dict[str, None] = {}
    signs = [s for s in ("\\/", "@", "!", "+", "|", "$", "€", *"0123456789") if s in word]
    for seen, meant in GLYPHS.items():
        at = word.find(seen)
        while at >= 0:
            for m in meant:
                once[word[:at] + m + word[at + len(seen) :]] = None
            at = word.find(seen, at + 1)
    if not signs:
        return tuple(once)
    twice: dict[str, None] = dict(once)
    for first in list(once):
        if not first.isalpha():
            for seen, meant in GLYPHS.items():
                at = first.find(seen)
                while at >= 0:
                    for m in meant:
                        twice[first[:at] + m + first[at + len(seen) :]] = None
                    at = first.find(seen, at + 1)
    if any(len(s) and word.count(s) > 1 for s in signs):
        # The same sign usually stands for the same letter throughout a word.
        for s in signs:
            for m in GLYPHS[s]:
                twice[word.replace(s, m)] = None
    return tuple(twice)


class Lexicon:
    """What a worker needs to correct texts: suspect forms with their candidates, compounds, and the vectors."""

    def __init__(self, suspects: dict[str, tuple[int, tuple[tuple[str, int], ...]]], compounds: set[str], words: list[str], inner: np.ndarray, outer: np.ndarray, usual: np.ndarray | None = None):
        self.usual = usual
        self.suspects, self.compounds = suspects, compounds
        self.index = {w: i for i, w in enumerate(words)}
        self.inner, self.outer = inner, outer
        #: Tokens that were seen to need nothing, as they are written.
        self.calm: set[str] = set()

    def whole(self, plain: str) -> tuple[str, bool]:
        """The text with the words that line ends had cut, and whether there were any; known compounds keep their hyphen."""
        if CUT_MARK not in plain:
            return plain, False
        cut_word = False

        def join(m: re.Match) -> str:
            nonlocal cut_word
            if f"{m[1]}-{m[2].strip(_EDGE)}".lower() in self.compounds:
                return f"{m[1]}-{m[2]}"
            cut_word = True
            return m[1] + m[2]

        while CUT_MARK in plain:
            plain = _CUT_HERE.sub(join, plain, count=1)
        return plain, cut_word

    def correct(self, text: str) -> tuple[str, int]:
        """The text with misread words replaced, and how many there were."""
        tokens = _TOKEN.findall(text)
        calm = self.calm
        if all(t in calm for t in tokens):
            return text, 0
        spots = list(_TOKEN.finditer(text))
        plain: list[str] | None = None
        out, last, wrong = [], 0, 0
        for i, raw in enumerate(tokens):
            if raw in calm:
                continue
            core = raw.strip(_EDGE)
            left = len(raw) - len(raw.lstrip(_EDGE))
            if core.endswith("!") and core[:-1].isalpha():
                core = core[:-1]
            parts = _JOINTS.split(core)
            if len(core) < 2 or not any(self._doubtful(p, "-" in core) for p in parts):
                if len(calm) < MOST_CALM:
                    calm.add(raw)
                continue
            if plain is None:
                plain = [t.strip(_EDGE).lower() for t in tokens]
            starts = i == 0 or tokens[i - 1].rstrip("\"'»)”")[-1:] in ".!?:…¿¡" or raw[:1] in "¿¡"
            around = plain[max(0, i - WINDOW) : i] + plain[i + 1 : i + 1 + WINDOW]
            fixed = [self._part(p, around, "-" in core, starts) if k % 2 == 0 else p for k, p in enumerate(parts)]
            if fixed != parts:
                wrong += 1
                at = spots[i].start() + left
                out += [text[last:at], "".join(fixed)]
                last = at + len(core)
        return "".join([*out, text[last:]]), wrong

    def _doubtful(self, part: str, compound: bool) -> bool:
        """Whether a part of a token may be misread, whatever stands around it."""
        low = part.lower()
        if len(low) < 2 or low.isdigit():
            return False
        if low in self.suspects:
            return True
        return not low.isalpha() and bool(_INSIDE.fullmatch(part))

    def asked(self, text: str) -> set[str]:
        """The words whose vectors decide on the suspect forms of a text."""
        tokens = [t.strip(_EDGE).lower() for t in _TOKEN.findall(text)]
        words: set[str] = set()
        for i, core in enumerate(tokens):
            for part in {*_JOINTS.split(core), *_JOINTS.split(core.rstrip("!"))}:
                if part in self.suspects:
                    words |= {part, *(w for w, _ in self.suspects[part][1]), *tokens[max(0, i - WINDOW) : i + 1 + WINDOW]}
        return words

    def fit(self, word: str, around: list[str]) -> float | None:
        """How well a word goes with those around it; None if nothing is known."""
        near = [self.index[w] for w in around if w in self.index]
        at = self.index.get(word)
        return None if at is None or not near else float(self.inner[at] @ self.outer[near].mean(axis=0))

    def _part(self, part: str, around: list[str], compound: bool, starts: bool) -> str:
        low = part.lower()
        if len(low) < 2 or low.isdigit():
            return part
        signs = sum(not c.isalpha() for c in low)
        letters = len(low) - signs
        if letters < 2 or compound and (letters < 4 if signs else len(low) < 6):
            return part
        if not signs and (len(low) < 3 or part[:1].isupper() and not part.isupper() and not starts):
            # A capital inside a sentence marks a name, which is no misreading of a common word.
            return part
        own, options = self.suspects.get(low, (0, ()))
        if options:
            word = self._chosen(low, own, options, around, bool(signs))
            if word is None:
                return part
        elif signs and letters >= 3 and _INSIDE.fullmatch(part) and not part.isupper():
            # No word of the corpus is meant; a sign inside letters is read as the letter it stands for.
            word = low
            for seen in ("\\/", "@", "0", "1", "5", "6", "9", "!", "+", "|", "$"):
                word = word.replace(seen, GLYPHS[seen][0])
        else:
            return part
        if part.isupper() and len(part) > 1:
            return word.upper()
        return word[:1].upper() + word[1:] if part[:1].isupper() else word

    def _chosen(self, low: str, own: int, options: tuple[tuple[str, int], ...], around: list[str], signs: bool) -> str | None:
        """The candidate that the vectors and its frequency speak for; None if the surroundings speak against all."""
        mine = None if signs else self.fit(low, around)
        best, most = None, -np.inf
        for word, n in options:
            fit = self.fit(word, around)
            if mine is not None and n < SURE_TIMES * own and (fit or 0.0) < mine + FIT_MARGIN:
                # A form that has a vector of its own may be a word of another language.
                continue
            if fit is not None and self.usual is not None and fit < self.usual[self.index[word]] - FIT_LESS:
                continue
            score = np.log(n) + 2 * (fit or 0.0)
            if (score, word) > (most, best or ""):
                best, most = word, score
        return best


def start_vectors(size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    return (np.random.default_rng(seed).random((size, DIMENSIONS)) - 0.5) / DIMENSIONS, np.zeros((size, DIMENSIONS))


def train_epoch(a: np.ndarray, b: np.ndarray, weight: np.ndarray, inner: np.ndarray, outer: np.ndarray, chance: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
    """One pass of skip-gram with negative sampling over weighted pairs, in place."""
    order = rng.permutation(len(a))
    rate = 0.2 * (1 - epoch / EPOCHS)
    for at in range(0, len(order), 4096):
        k = order[at : at + 4096]
        x, w = inner[a[k]], weight[k][:, None]
        grad = np.zeros_like(x)
        drawn = np.minimum(np.searchsorted(chance, rng.random((2, len(k)))), len(chance) - 1)
        for target, label in ((b[k], 1.0), (drawn[0], 0.0), (drawn[1], 0.0)):
            y = outer[target]
            g = rate * w * (label - 1 / (1 + np.exp(-np.clip((x * y).sum(axis=1, keepdims=True), -30, 30))))
            grad += g * y
            np.add.at(outer, target, np.clip(g * x, -0.5, 0.5))
        np.add.at(inner, a[k], np.clip(grad, -0.5, 0.5))


def train_vectors(pairs: pd.DataFrame, inner: np.ndarray, outer: np.ndarray, share: np.ndarray, seed: int = 8) -> None:
    """All epochs over (a, b, n) pair counts, in place."""
    rng = np.random.default_rng(seed)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    weight = np.log1p(pairs["n"].to_numpy(dtype=float))
    chance = np.cumsum(share)
    for epoch in range(EPOCHS):
        train_epoch(a, b, weight, inner, outer, chance, epoch, rng)


# ---- over the corpus -------------------------------------------------------


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id with text of a body type."""
    rows = nodes.where(F.col("id").isNotNull()).select("id", "ingested_at", "raw_text", "document_id", "page_number", "node_type", F.col("order_index") if "order_index" in nodes.columns else F.lit(0).alias("order_index"))
    return (
        rows.repartition(partitions_for(rows), "id")
        .groupBy("id")
        .agg(F.max(F.struct("ingested_at", F.coalesce("raw_text", F.lit("")).alias("text"), "document_id", "page_number", "node_type", "order_index")).alias("row"))
        .select("id", F.coalesce("row.document_id", F.lit("")).alias("document_id"), F.col("row.page_number").alias("page_number"), F.col("row.node_type").alias("node_type"), F.col("row.order_index").alias("order_index"), F.col("row.text").alias("text"))
        .where(F.col("node_type").isin(*BODY) & (F.trim("text") != ""))
    )


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [head_line(t) for t in batch["text"]]
        out = batch[["id", "document_id", "page_number"]].copy()
        out["key"] = [f[0] if f else None for f in found]
        out["shaped"] = [bool(f and f[1]) for f in found]
        yield out


def titles_of(nodes: DataFrame) -> DataFrame | None:
    """document_id and title: the first heading that the nodes of a document stand under, if that is recorded."""
    if "metadata" not in nodes.columns:
        return None
    path = F.col("metadata.heading_path")
    return nodes.where(F.size(path) > 0).select(F.coalesce("document_id", F.lit("")).alias("document_id"), path[0].alias("title")).distinct()


@pandas_udf(StringType())
def _fold_titles(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: fold(t) if t else "")


PLAIN = "id string, document_id string, order_index int, plain string, head boolean, number boolean, open boolean"


def _plain_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node's text in one line without furniture, with a mark where a line end had cut a word."""
    for batch in batches:
        plain, heads, numbers, opens = [], [], [], []
        for text, head in zip(batch["text"], batch["head"]):
            lines, is_head, number = body_lines(text, head)
            line, open_end = joined(lines)
            plain.append(line)
            heads.append(is_head)
            numbers.append(number)
            opens.append(open_end)
        out = batch[["id", "document_id", "order_index"]].copy()
        out["plain"], out["head"], out["number"], out["open"] = plain, heads, numbers, opens
        yield out


def with_heads(body: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Nodes with their plain text and what furniture it had: a line that is a repeated page head or the document's title."""
    # Only keys and flags are kept; the texts are read again and joined where they lie, by id.
    keyed = cut(body.select("id", "document_id", "page_number", "text").mapInPandas(_heads, "id string, document_id string, page_number int, key string, shaped boolean"))
    pages = keyed.groupBy("document_id").agg(F.greatest(F.count_distinct("page_number"), F.lit(1)).alias("pages"))
    titled = titles.withColumn("key", _fold_titles("title")).select("document_id", "key").distinct() if titles is not None else None
    known = keyed.where(F.col("key").isNotNull()).groupBy("document_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("shaped").cast("int")).alias("s")).where("n >= 2")
    # Mostly shaped like a head, or on so many pages that it can be nothing else.
    heads = (
        known.join(pages, "document_id")
        .where((F.col("s") * 2 >= F.col("n")) & (F.col("s") >= 2) & (F.col("s") >= F.col("pages") * SHAPED_SHARE) | (F.col("n") >= 3) & (F.col("n") >= F.col("pages") * HEAD_SHARE))
        .select("document_id", "key", F.lit(True).alias("known"))
    )
    if titled is not None:
        heads = heads.unionByName(titled.where("key <> ''").withColumn("known", F.lit(True))).distinct()
    marked = keyed.join(heads, ["document_id", "key"], "left_semi").select("id", F.lit(True).alias("head"))
    rows = body.join(marked, "id", "left").select("id", "document_id", "order_index", "text", F.coalesce("head", F.lit(False)).alias("head"))
    return cut(rows.mapInPandas(_plain_texts, PLAIN))


def _frame(found: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(found), "n": list(found.values())})


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words, forms with signs among their letters, and compounds."""
    found: Counter = Counter()
    for batch in batches:
        for text in batch["plain"]:
            plain = text.replace(CUT_MARK, "").lower()
            found.update(_WORD.findall(plain))
            if "-" in plain:
                found.update(_COMPOUND.findall(plain))
            if not plain.isalpha():
                for token in _SIGNED.findall(plain):
                    found.update(p for p in _JOINTS.split(token.strip(_EDGE))[::2] if not p.isalpha() and not p.isdigit() and len(p) > 1)
        if len(found) > 500_000:
            yield _frame(found)
            found = Counter()
    if found:
        yield _frame(found)


def suspects_of(counted: DataFrame) -> DataFrame:
    """form, n, and the candidates (word, n) it may be a misreading of: frequent words that one reading of its glyphs gives, many times as usual as itself.

    The rule is one of ratios and so the same at every size. The frequent words
    go to the executors up to BROADCAST_WORDS of them, counted first; more are
    joined with the readings.
    """
    forms = counted.where(~F.col("word").contains("-"))
    frequent = forms.where((F.col("n") >= FREQUENT_LEAST) & F.col("word").rlike(r"^[\p{L}'’]+$"))
    if frequent.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        shared = counted.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in frequent.toLocalIterator()})

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for batch in batches:
                rows = [(w, n, c, known[c]) for w, n in zip(batch["word"], batch["n"]) for c in readings(w) if known.get(c, 0) >= max(FREQUENT_LEAST, TIMES_AS_USUAL * n) and c != w]
                yield pd.DataFrame(rows, columns=["form", "n", "word", "many"])

        met = forms.mapInPandas(look_up, "form string, n long, word string, many long")
    else:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(w, n, c) for w, n in zip(batch["word"], batch["n"]) for c in readings(w) if c != w]
                yield pd.DataFrame(rows, columns=["form", "n", "word"])

        met = forms.mapInPandas(read, "form string, n long, word string").join(frequent.withColumnRenamed("n", "many"), "word").where(F.col("many") >= TIMES_AS_USUAL * F.col("n"))
    return met.groupBy("form").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("word", "many"))).alias("options"))


def _frequent(counted: DataFrame) -> DataFrame:
    return counted.where((F.col("n") >= FREQUENT_LEAST) & F.col("word").rlike(r"^[\p{L}'’]+$"))


def _pair_counts(number: dict[str, int] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of pairs of words at most WINDOW apart: of numbered words by their numbers; without numbers, of all words as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        gap = [-1] * WINDOW
        met: dict[str, int] = {}

        def counts() -> pd.DataFrame:
            ids = np.array(held, dtype=np.int64)
            size = int(ids.max(initial=0)) + 1
            keys = []
            for d in range(1, WINDOW + 1):
                a, b = ids[:-d], ids[d:]
                ok = (a >= 0) & (b >= 0)
                keys.append(np.minimum(a, b)[ok] * size + np.maximum(a, b)[ok])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            a, b = key // size, key % size
            if number is None:
                words = np.array(list(met), dtype=object)
                a, b = words[a], words[b]
            return pd.DataFrame({"a": a, "b": b, "n": n})

        for batch in batches:
            for text in batch["plain"]:
                words = _WORD.findall(text.replace(CUT_MARK, "").lower())
                held += [met.setdefault(w, len(met)) for w in words] if number is None else [number.get(w, -1) for w in words]
                held += gap
            if len(held) > 1_000_000:
                yield counts()
                held, met = [], {}
        if len(held) > WINDOW:
            yield counts()

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """word and at, its place in the order of all words, counted range by range."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(words.select("word").repartitionByRange(partitions_for(words), "word").sortWithinPartitions("word").select("word", F.spark_partition_id().alias("part"), row.alias("row")))
    before, total = [], 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    return cut(ranged.join(F.broadcast(words.sparkSession.createDataFrame(before, "part int, before long")), "part").select("word", (F.col("row") + F.col("before")).alias("at")))


def _joined_pairs(marked: DataFrame, numbers: DataFrame) -> DataFrame:
    """a, b, n of pairs of numbered words, for more words than every executor can hold."""
    pairs = marked.select("plain").mapInPandas(_pair_counts(None), "a string, b string, n long").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n")).where(F.col("n") >= PAIR_LEAST)
    for side, other in (("a", "b"), ("b", "a")):
        pairs = cut(pairs)
        known = numbers.select(F.col("word").alias(side), F.col("at").alias("at_" + side))
        pairs = spread_join(pairs, known, [side], "inner", hot_keys(pairs, side), (other,))
    return pairs.select(F.col("at_a").alias("a"), F.col("at_b").alias("b"), "n")


def _blocks_for(both: DataFrame, size: int) -> int:
    """Into how many blocks the words are cut so that no cell, the pairs of one block with another, has more than BLOCK_PAIRS; they are counted."""
    blocks = max(1, -(-size // BLOCK_WORDS), int(np.ceil(np.sqrt(both.count() / BLOCK_PAIRS))))
    while blocks < size and (both.groupBy(F.col("a") % blocks, F.col("b") % blocks).count().agg(F.max("count")).first()[0] or 0) > BLOCK_PAIRS:
        blocks = min(size, blocks + max(1, blocks // 2))
    return blocks


HELD = "side int, block long, data binary"


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, width).astype(np.float64)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.float32).tobytes()


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)


def train_in_blocks(both: DataFrame, size: int, blocks: int) -> DataFrame:
    """The trained vectors of all words in rows of one block each: side 0 inner, side 1 outer with the words' share as last column.

    Word ``w`` is row ``w div blocks`` of block ``w mod blocks``. In each round
    every task takes one block of inner and another of outer vectors and the
    pairs between them, so no two tasks touch the same vectors; an epoch is a
    round for each distance between the blocks, and covers every pair.
    """
    words = both.sparkSession.range(size).withColumnRenamed("id", "b").join(both.groupBy("b").agg(F.sum("n").alias("n")), "b", "left").withColumn("block", F.col("b") % blocks)

    def start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = start_vectors(len(rows), seed=[7, int(key[0])])
        share = 1e-9 + rows.sort_values("b")["n"].fillna(0).to_numpy(dtype=float) ** 0.75
        return pd.DataFrame({"side": [0, 1], "block": key[0], "data": [_bytes(x), _bytes(np.column_stack((y, share)))]})

    held = cut(words.groupBy("block").applyInPandas(start, HELD))
    cells = both.select((F.col("a") % blocks).alias("cell"), F.pmod(F.col("b") - F.col("a"), F.lit(blocks)).alias("round"), F.expr(f"a div {blocks}").alias("a"), F.expr(f"b div {blocks}").alias("b"), "n")
    rounds = [cut(cells.where(F.col("round") == r).drop("round")) for r in range(blocks)]

    def trainer(epoch: int, distance: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("side").reset_index(drop=True)
            if len(pairs):
                pairs = pairs.sort_values(["a", "b"])
                x, y = _matrix(rows["data"][0], DIMENSIONS), _matrix(rows["data"][1], DIMENSIONS + 1)
                outer, share = y[:, :-1].copy(), y[:, -1]
                rng = np.random.default_rng([8, epoch, distance, int(key[0])])
                train_epoch(pairs["a"].to_numpy(), pairs["b"].to_numpy(), np.log1p(pairs["n"].to_numpy(dtype=float)), x, outer, np.cumsum(share / share.sum()), epoch, rng)
                rows["data"] = [_bytes(x), _bytes(np.column_stack((outer, share)))]
            return rows[["side", "block", "data"]]

        return run

    for epoch in range(EPOCHS):
        for distance, pairs in enumerate(rounds):
            cell = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - distance, F.lit(blocks)))
            held = cut(pairs.groupBy("cell").cogroup(held.withColumn("cell", cell).groupBy("cell")).applyInPandas(trainer(epoch, distance), HELD))
    return held


def _mean_outer(held: DataFrame) -> np.ndarray:
    """The mean of all outer vectors by share; one row a block comes here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                y = _matrix(data, DIMENSIONS + 1)
                yield pd.DataFrame({"total": [(y[:, -1] @ _unit(y[:, :-1])).tolist()], "share": [y[:, -1].sum()]})

    rows = held.where("side = 1").mapInPandas(run, "total array<double>, share double").collect()
    return np.sum([r["total"] for r in rows], axis=0) / sum(r["share"] for r in rows)


def _vector_table(held: DataFrame, numbers: DataFrame, blocks: int) -> DataFrame:
    """word, inner, outer, usual: one row a word."""
    mean = _mean_outer(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for side, block, data in zip(batch["side"], batch["block"], batch["data"]):
                v = _unit(_matrix(data, DIMENSIONS + side)[:, :DIMENSIONS])
                yield pd.DataFrame({"at": np.arange(len(v)) * blocks + block, "side": side, "v": [_bytes(x) for x in v], "usual": v @ mean})

    each = held.mapInPandas(run, "at long, side int, v binary, usual double")
    one = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    return cut(numbers.join(each.groupBy("at").agg(one(0, "v").alias("inner"), one(1, "v").alias("outer"), one(0, "usual").alias("usual")), "at").drop("at"))


def learn_vectors(marked: DataFrame, counted: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | DataFrame:
    """Skip-gram vectors of all frequent words, from all pairs of the corpus, and how well each word fits any surroundings.

    Up to BLOCK_WORDS words and BLOCK_PAIRS pairs one task trains; more are
    trained in blocks. Up to BROADCAST_WORDS words the model is given whole,
    with more as a table with a row a word.
    """
    spark = marked.sparkSession
    usual = _frequent(counted)
    size = usual.count()
    few = size <= max(BROADCAST_WORDS, BLOCK_WORDS)
    words = sorted(r["word"] for r in usual.select("word").toLocalIterator()) if few else []
    inner, outer = start_vectors(size if few else 0)
    if not size:
        return words, inner, outer, np.zeros(0)
    if few:
        shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
        pairs = marked.select("plain").mapInPandas(lambda batches: _pair_counts(shared.value)(batches), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= PAIR_LEAST)
    else:
        numbers = _numbered(usual)
        pairs = cut(_joined_pairs(marked, numbers))
    both = cut(pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    blocks = _blocks_for(both, size)
    if blocks > 1 or not few:
        held = train_in_blocks(both, size, blocks)
        if not few:
            return _vector_table(held, numbers, blocks)
        for r in held.toLocalIterator():
            (outer if r["side"] else inner)[r["block"] :: blocks] = _unit(_matrix(r["data"], DIMENSIONS + r["side"])[:, :DIMENSIONS])
        return words, inner.astype(np.float32), outer.astype(np.float32), inner @ _mean_outer(held)
    weights = both.groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    share = np.full(size, 1e-9)
    share[weights["b"].to_numpy()] += weights["n"].to_numpy(dtype=float) ** 0.75
    share /= share.sum()
    columns = [f"v{i}" for i in range(2 * DIMENSIONS)]

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for x in batches if len(x)]
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            x, y = start_vectors(size)
            train_vectors(rows, x, y, share)
            yield pd.DataFrame(np.concatenate((x, y), axis=1), columns=columns).assign(word=np.arange(size))

    trained = both.repartition(1).sortWithinPartitions("a", "b").mapInPandas(train, ", ".join(f"{c} float" for c in columns) + ", word long").toPandas()
    if len(trained):
        values = trained.sort_values("word")[columns].to_numpy(np.float64)
        inner, outer = values[:, :DIMENSIONS], values[:, DIMENSIONS:]
    inner, outer = _unit(inner), _unit(outer)
    return words, inner.astype(np.float32), outer.astype(np.float32), inner @ (share @ outer)


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and each form or compound of a node's text that may have to be looked up."""
    for batch in batches:
        rows = []
        for node, text in zip(batch["id"], batch["plain"]):
            low = text.lower()
            found = {p for t in _TOKEN.findall(low.replace(CUT_MARK, "")) for p in _JOINTS.split(t.strip(_EDGE).rstrip("!"))[::2] if len(p) > 1}
            found |= {f"{a}-{b.strip(_EDGE)}" for a, b in _CUT_HERE.findall(low)}
            rows += [(node, f) for f in found]
        yield pd.DataFrame(rows, columns=["id", "form"])


REPAIRED = "id string, document_id string, order_index int, kinds array<string>, text string, open boolean"


def repair(nodes: DataFrame) -> DataFrame:
    """id, kinds of damage, and the repaired text of each body node."""
    marked = with_heads(latest_nodes(nodes), titles_of(nodes))
    counted = cut(marked.select("plain").mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    suspects = cut(suspects_of(counted))
    compounds = counted.where((F.col("n") >= FREQUENT_LEAST) & F.col("word").contains("-") & ~F.col("word").rlike(r"[^\p{L}\-]")).select(F.col("word").alias("form"))
    model = learn_vectors(marked, counted)
    context = nodes.sparkSession.sparkContext
    given = isinstance(model, DataFrame)
    if not given and suspects.unionByName(compounds.select("form", F.lit(0).cast("long").alias("n"), F.array().cast(suspects.schema["options"].dataType).alias("options"))).limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        held = {r["form"]: (r["n"], tuple((o["word"], o["many"]) for o in r["options"])) for r in suspects.toLocalIterator()}
        shared = context.broadcast(Lexicon(held, {r["form"] for r in compounds.toLocalIterator()}, *model))
        return marked.mapInPandas(lambda batches: _repair(batches, shared.value), REPAIRED)
    # Too many for every executor: each text gets those of its own forms, and the vectors that they need.
    asked = marked.select("id", "plain").mapInPandas(_forms, "id string, form string")
    known = suspects.unionByName(compounds.select("form", F.lit(-1).cast("long").alias("n"), F.array().cast(suspects.schema["options"].dataType).alias("options")))
    own = asked.join(known, "form").groupBy("id").agg(F.collect_list(F.struct("form", "n", "options")).alias("own"))
    if given:
        own = cut(own)
        words = cut(marked.join(own, "id").mapInPandas(_asked_words, "id string, word string"))
        near = spread_join(words, model, ["word"], "inner", hot_keys(words, "word"), ("id",)).groupBy("id").agg(F.collect_list(F.struct("word", "inner", "outer", "usual")).alias("near"))
        return marked.join(own, "id", "left").join(near, "id", "left").mapInPandas(lambda batches: _repair_each(batches, None), REPAIRED)
    shared = context.broadcast(model)
    return marked.join(own, "id", "left").mapInPandas(lambda batches: _repair_each(batches, shared.value), REPAIRED)


def _take_own(lexicon: Lexicon, own: Iterable | None) -> None:
    own = own if own is not None else ()
    lexicon.calm = set()
    lexicon.suspects = {x["form"]: (x["n"], tuple((o["word"], o["many"]) for o in x["options"])) for x in own if x["n"] >= 0}
    lexicon.compounds = {x["form"] for x in own if x["n"] < 0}


def _take_near(lexicon: Lexicon, near: Iterable | None) -> None:
    near = near if near is not None else ()
    lexicon.index = {x["word"]: i for i, x in enumerate(near)}
    lexicon.inner, lexicon.outer = (np.frombuffer(b"".join(x[side] for x in near), np.float32).reshape(-1, DIMENSIONS) for side in ("inner", "outer"))
    lexicon.usual = np.array([x["usual"] for x in near])


def _empty() -> Lexicon:
    return Lexicon({}, set(), [], np.zeros((0, DIMENSIONS)), np.zeros((0, DIMENSIONS)))


def _asked_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and each word whose vector a node's text needs."""
    lexicon = _empty()
    for batch in batches:
        rows = []
        for node, plain, own in zip(batch["id"], batch["plain"], batch["own"]):
            _take_own(lexicon, own)
            rows += [(node, w) for w in lexicon.asked(lexicon.whole(plain)[0])]
        yield pd.DataFrame(rows, columns=["id", "word"])


def _repair_each(batches: Iterator[pd.DataFrame], model: tuple | None) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon({}, set(), *model) if model else _empty()
    for batch in batches:
        rows = []
        for i, own in enumerate(batch["own"]):
            _take_own(lexicon, own)
            if model is None:
                _take_near(lexicon, batch["near"].iloc[i])
            rows += list(_repair(iter([batch.iloc[i : i + 1]]), lexicon))
        if rows:
            yield pd.concat(rows, ignore_index=True)


def _repair(batches: Iterator[pd.DataFrame], lexicon: Lexicon) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kinds, texts = [], []
        for plain, head, number, open_end in zip(batch["plain"], batch["head"], batch["number"], batch["open"]):
            whole, hyphen = lexicon.whole(plain)
            fixed, wrong = lexicon.correct(whole)
            found = [k for k, yes in (("hyphenation", hyphen or open_end), ("misread", wrong), ("running_head", head), ("page_number", number)) if yes]
            kinds.append(found)
            texts.append(_SPACES.sub(" ", fixed).strip())
        out = batch[["id", "document_id", "order_index", "open"]].copy()
        out["kinds"], out["text"] = kinds, texts
        yield out[["id", "document_id", "order_index", "kinds", "text", "open"]]


# ---- words cut at a node's end ---------------------------------------------

EDGE_ROW = "id string, taken string, dropped boolean"


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([\p{L}]+\S*)", 1)


def continuous(repaired: DataFrame) -> DataFrame:
    """id and text, in which a word that a node's end had cut is whole, and gone from the next node.

    Nodes follow each other by order_index and id within their document. They
    are looked through in ranges of equal size, so no document is gathered;
    where a range ends, the first node of the next one is told to it.
    """
    rows = repaired.select("id", "document_id", "order_index", "open", _first_word(F.col("text")).alias("first"))
    ranged = cut(rows.repartitionByRange(max(2, parallelism(repaired.sparkSession)), "document_id", F.coalesce("order_index", F.lit(0)), "id").withColumn("part", F.spark_partition_id()))
    order = (F.coalesce("order_index", F.lit(0)), F.col("id"))
    # One row a range: its first node.
    heads = ranged.groupBy("part").agg(F.min(F.struct("document_id", F.coalesce("order_index", F.lit(0)).alias("at"), "id", "first")).alias("h")).select("part", "h.document_id", "h.id", "h.first").collect()
    after = repaired.sparkSession.sparkContext.broadcast(sorted((r["part"], r["document_id"], r["id"], r["first"]) for r in heads))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            found = []
            for node, doc, part, opened, first in zip(batch["id"], batch["document_id"], batch["part"], batch["open"], batch["first"]):
                if waiting and waiting[1] == doc and first:
                    found += [(waiting[0], first, False), (node, first, True)]
                waiting = (node, doc, part) if opened else None
            yield pd.DataFrame(found, columns=["id", "taken", "dropped"])
        if waiting:
            following = next((h for h in after.value if h[0] > waiting[2]), None)
            if following and following[1] == waiting[1] and following[3]:
                yield pd.DataFrame([(waiting[0], following[3], False), (following[2], following[3], True)], columns=["id", "taken", "dropped"])

    edges = cut(ranged.sortWithinPartitions("document_id", *order).mapInPandas(run, EDGE_ROW))
    taken = edges.where("NOT dropped").groupBy("id").agg(F.min("taken").alias("taken"))
    dropped = edges.where("dropped").groupBy("id").agg(F.min("taken").alias("gone"))
    moved = taken.join(dropped, "id", "full_outer")
    text = F.when(F.col("gone").isNotNull(), F.regexp_replace(F.col("text"), r"^\s*[\p{L}]+\S*\s*", "")).otherwise(F.col("text"))
    text = F.when(F.col("taken").isNotNull(), F.concat(F.regexp_replace(text, "[" + _HYPHEN + r"]\s*$", ""), F.col("taken"))).otherwise(text)
    return repaired.join(moved, "id", "left").select("id", text.alias("text"))
