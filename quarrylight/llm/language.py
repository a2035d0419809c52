"""Languages of documents and of their sentences, with confidence.

A bit-sliced Bloom filter holds, for each hashed n-gram, one bit per language.
A lookup ANDs a few cells and so returns, at once, all languages that contain
the n-gram. Per sentence the set bits are counted for each language, corrected
for the filter's false positives, and the counts decide.

The filter is fitted on a bounded sample of labelled documents (parameters
``sample_docs`` and ``sample_grams``). A wrong label in the sample does little:
an n-gram enters a language only if it is about as usual there as in the
language where it is most usual.

Defined cases: null, empty and blank texts and texts without natural language
(code, numbers) have no language; labels are compared by the language they
name, in any usual code or name; extra columns are ignored; repeated rows count
once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import cut, spread

#: ISO 639 codes and usual names of the supported languages.
NAMES = {
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian"),
    "en": ("en", "eng", "english", "inglés", "ingles"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugués"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francés", "frances"),
    "de": ("de", "deu", "ger", "german", "deutsch", "alemán", "aleman"),
    "it": ("it", "ita", "italian", "italiano"),
    "ca": ("ca", "cat", "catalan", "català", "catala", "catalán", "valencian", "valencià"),
}
LANGUAGES = tuple(NAMES)
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_GRAMS = 700, 4_000, 60_000
GRAM_SIZES = (3, 4, 5)
CELLS, HASHES = 1 << 21, 2
#: A language holds an n-gram whose rate there is at least this part of its highest rate.
SHARE = 0.35
MIN_WORDS, MIN_LETTERS = 5, 20
MIN_RATE, MIN_MARGIN = 0.72, 0.10
#: Confidence of the surest full sentence from which a further language of a text counts.
SECOND_CONFIDENCE = 0.93

_SENTENCE = re.compile(r"[^.!?…;\n。]+[.!?…;。]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTERS_ASCII = re.compile(r"[A-Za-z]+")
_QUOTES = re.compile("[«“„\"‹]")


def label_language(label: Column) -> Column:
    """The supported language that a label names; null for any other label."""
    plain = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_replace(plain, r"[-_@.].*$", "")))


# ---- n-grams ---------------------------------------------------------------


def _points(text: str) -> np.ndarray:
    """Code points in lower case, as many as the text has characters."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else c[0] for c in (x.lower() for x in text))
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _codes(*texts: str) -> np.ndarray:
    """Code points of all texts, a space before and after each, every non-letter as a space."""
    space = np.array([32], dtype=np.uint32)
    codes = np.concatenate([space, *(x for t in texts for x in (_points(t), space))]).astype(np.uint64)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & (codes < 0x250)) | (codes == 0x2019)
    return np.where(letter, codes, 32)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per size: where an n-gram lies within one word and its borders, and its hash there.

    Each size goes on from the one below it.
    """
    space = codes == 32
    value, inside = codes.astype(np.uint64), np.ones(len(codes), bool)
    for size in range(2, max(GRAM_SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            return
        value = value[:n] * np.uint64(1099511628211) + codes[size - 1 :]
        inside = inside[:n]
        if size > 2:
            inside = inside & ~space[size - 2 : size - 2 + n]
        if size in GRAM_SIZES:
            at = np.nonzero(inside)[0]
            yield size, at, _mix(value[at] + np.uint64(size))


#: Bits of one count.
FIELD = 21
#: For every three languages (the last stands for any of them): which a byte of the filter names, a field each.
_TABLES = {
    g: np.array(
        [sum(int(v > 0 if b == len(LANGUAGES) else v >> b & 1) << FIELD * (b - g) for b in range(g, min(g + 3, len(LANGUAGES) + 1))) for v in range(256)],
        dtype=np.uint64,
    )
    for g in range(0, len(LANGUAGES) + 1, 3)
}


class LanguageFilter:
    """Bit-sliced Bloom filter over n-gram hashes."""

    def __init__(self, cells: int = CELLS, hashes: int = HASHES):
        self.bits = np.zeros(cells, dtype=np.uint8)
        self.hashes = hashes
        self._false: np.ndarray | None = None

    def _cell(self, values: np.ndarray, k: int) -> np.ndarray:
        moved = values >> np.uint64(21 * k)
        cells = len(self.bits)
        return (moved & np.uint64(cells - 1) if cells & (cells - 1) == 0 else moved % np.uint64(cells)).view(np.int64)

    def add(self, values: np.ndarray, masks: np.ndarray) -> None:
        self._false = None
        for k in range(self.hashes):
            np.bitwise_or.at(self.bits, self._cell(values, k), masks)

    def masks(self, values: np.ndarray) -> np.ndarray:
        out = self.bits[self._cell(values, 0)]
        for k in range(1, self.hashes):
            out &= self.bits[self._cell(values, k)]
        return out

    def false_rates(self) -> np.ndarray:
        """Chance that an n-gram of no language seems to be in each of them."""
        if self._false is None:
            fill = np.array([((self.bits >> b) & 1).mean() for b in range(len(LANGUAGES))])
            self._false = fill**self.hashes
        return self._false

    @staticmethod
    def _add(count: np.ndarray, total: np.ndarray, b: int, more: np.ndarray) -> None:
        if b < len(LANGUAGES):
            count[:, b] += more
        else:
            total += more

    def rates(self, texts: list[str], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each span's n-grams that each language contains, and their number.

        Spans count characters over all texts, with one more after each text.
        """
        codes = _codes(*texts)
        count = np.zeros((len(starts), len(LANGUAGES)))
        total = np.zeros(len(starts))
        ends = ends + 1
        for size, at, values in grams(codes):
            bits = self.masks(values)
            # The border before a word belongs to it.
            low, high = np.searchsorted(at, starts), np.searchsorted(at, np.maximum(starts, ends - size + 2))
            # Three counts in the fields of one sum; a field holds the count of any span of this many n-grams.
            wide = (high - low).max(initial=0) >= 1 << FIELD
            for group in range(0, len(LANGUAGES) + 1, 3):
                fields = range(group, min(group + 3, len(LANGUAGES) + 1))
                if wide:
                    for b in fields:
                        run = np.concatenate(([0], np.cumsum((_TABLES[group][bits] >> np.uint64(FIELD * (b - group))) & np.uint64(1))))
                        self._add(count, total, b, (run[high] - run[low]).astype(float))
                    continue
                run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLES[group][bits])))
                sums = run[high] - run[low]
                for b in fields:
                    self._add(count, total, b, (sums >> np.uint64(FIELD * (b - group)) & np.uint64((1 << FIELD) - 1)).astype(float))
        fp = self.false_rates()
        many = np.maximum(total, 1)[:, None]
        return np.clip((count / many - fp) / (1 - fp), 0, 1), total


# ---- fitting ---------------------------------------------------------------


def _count_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, Counter] = {code: Counter() for code in LANGUAGES}
    for batch in batches:
        for code, text in zip(batch["label"], batch["text"]):
            for _, _, values in grams(_codes(text)):
                # One vote per document, so that a long or repetitive one does not prevail.
                found[code].update(np.unique(values).view(np.int64).tolist())
    rows = [(code, gram, n) for code, c in found.items() for gram, n in c.items()]
    if rows:
        yield pd.DataFrame(rows, columns=["label", "gram", "n"])


#: Documents of a label are looked at until, at this share of fitting lengths, the sample is full.
OVERSAMPLE = 3


def sample_of(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """label, text, doc_id of at most ``sample_docs`` labelled documents per language, drawn by a hash of their id.

    The labels alone are counted first, so the one pass over the texts keeps
    only hashes below a threshold of their language, however large the corpus.
    """
    label = label_language(F.col("lang"))
    many = {r["label"]: r["n"] for r in docs.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect() if r["label"]}
    low = F.xxhash64("doc_id")
    keep = F.lit(False)
    for code, n in many.items():
        part = sample_docs * OVERSAMPLE / n
        most = (1 << 63) - 1 if part >= 1 else int(part * (1 << 64)) - (1 << 63)
        keep = keep | ((F.col("label") == code) & (F.col("low") <= F.lit(most)))
    fit = docs.select(label.alias("label"), "text", "doc_id", low.alias("low")).where(keep & F.length("text").between(80, SAMPLE_CHARS))
    place = F.row_number().over(Window.partitionBy("label").orderBy("low", "text"))
    return fit.withColumn("place", place).where(F.col("place") <= sample_docs).select("label", "text", "doc_id")


def fit_filter(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_grams: int = SAMPLE_GRAMS) -> LanguageFilter:
    """Fit on at most ``sample_docs`` labelled documents per language, each of at most
    SAMPLE_CHARS characters, keeping the ``sample_grams`` most usual n-grams of each."""
    sample = cut(sample_of(docs, sample_docs))
    counted = (
        sample.repartition(len(LANGUAGES) * 2, F.xxhash64("doc_id"))
        .mapInPandas(_count_batch, "label string, gram long, n long")
        .groupBy("label", "gram")
        .agg(F.sum("n").alias("n"))
        .where("n >= 3")
    )
    rows = counted.toPandas()
    held = LanguageFilter()
    if rows.empty:
        return held
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = rows.sort_values(["n", "gram"], ascending=[False, True]).groupby("label").head(sample_grams)
    rows["rate"] = rows["n"] / rows["label"].map(sizes)
    rows["best"] = rows.groupby("gram")["rate"].transform("max")
    rows = rows[rows["rate"] >= SHARE * rows["best"]]
    rows["mask"] = rows["label"].map({code: 1 << b for b, code in enumerate(LANGUAGES)})
    masks = rows.groupby("gram")["mask"].sum()
    held.add(masks.index.to_numpy(dtype=np.int64).view(np.uint64), masks.to_numpy(dtype=np.uint8))
    return held


# ---- decision --------------------------------------------------------------

_CODE = re.compile(r"[{}=<>|\\$#@_`~^]|\w\(|\)\s*[:;{]|::|->|\s--|\bdef\b|\bimport\b|\b(?:SELECT|FROM|WHERE|GROUP BY|INSERT|UPDATE|JOIN)\b")
#: What a line holds if _CODE can match in it.
_MAY_BE_CODE = re.compile(r"[{}=<>|\\$#@_`~^()\-:]|def|import|SELECT|FROM|WHERE|GROUP BY|INSERT|UPDATE|JOIN")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|‹[^‹›]*›")
_CUE = re.compile(r"^\s*(?:\d+\s*$|\d+:\d\d:\d\d[.,]\d+\s*-->|\[\d+:\d\d(?::\d\d)?\]\s*|[-*+]\s+|\d+[.)]\s+|>\s*)")
_HEADING = re.compile(r"^\s*#+\s")


def _words(piece: str) -> list[str]:
    return (_LETTERS_ASCII if piece.isascii() else _LETTERS).findall(piece)


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """Spans that may be sentences, and whether each is a full one (not a heading or fragment)."""
    out = []
    at = 0
    in_code = False
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if "```" in line and line.lstrip().startswith("```"):
            in_code = not in_code
            continue
        if in_code or not line:
            continue
        # Only what begins a line with a sign or number is a heading or cue.
        plain = line[0].isalpha()
        heading = not plain and bool(_HEADING.match(line))
        coded = bool(_MAY_BE_CODE.search(line))
        if coded and not heading and len(_CODE.findall(line)) * 8 > len(_words(line)):
            continue
        cue = None if plain else _CUE.match(line)
        skip = cue.end() if cue else 0
        for found in _SENTENCE.finditer(line, skip):
            piece = found[0]
            words = _words(piece)
            if len(words) < 3:
                continue
            noise = len(_CODE.findall(piece)) if coded else 0
            if noise * 3 > len(words):
                continue
            # A quoted title is no sentence of the text that quotes it.
            bare = _words(_QUOTED.sub(" ", piece)) if _QUOTES.search(piece) else words
            full = not heading and len(bare) >= MIN_WORDS and sum(map(len, bare)) >= MIN_LETTERS
            ended = piece.rstrip()[-1] in ".!?…;。" or len(words) >= 9
            out.append((begin + found.start(), begin + found.end(), full and ended and noise == 0))
    return out


#: Characters that are looked up together.
BLOCK_CHARS = 400_000


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in blocks of about BLOCK_CHARS characters, with the place of each block's first."""
    block, size, first = [], 0, 0
    for i, text in enumerate(texts):
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield first, block
            block, size, first = [], 0, i + 1
    if block:
        yield first, block


def _sure(held: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Text, start, end, fullness, language and confidence of each recognised sentence."""
    found = [(i, a, b, full) for i, t in enumerate(texts) if t for a, b, full in sentences(t)]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at, a, b, full = (np.array(x, dtype=np.int64) for x in zip(*found))
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    rates, total = held.rates(texts, begins[at] + a, begins[at] + b)
    top = np.argsort(-rates, axis=1, kind="stable")
    rows = np.arange(len(found))
    best, second = rates[rows, top[:, 0]], rates[rows, top[:, 1]]
    # Margin against the spread that chance alone would give a count of this size.
    deviation = np.sqrt(np.maximum(best * (1 - best), 0.02) / np.maximum(total, 1))
    confidence = 1 / (1 + np.exp(-(best - second) / deviation)) * best
    sure = (best >= MIN_RATE) & (best - second >= MIN_MARGIN) & (total >= 12)
    return at[sure], a[sure], b[sure], full[sure], top[sure, 0], confidence[sure]


def _segments(held: LanguageFilter, texts: list[str]) -> list[list[tuple[int, int, str, float, bool]]]:
    """Per text: start, end, language, confidence and fullness of each recognised sentence."""
    out: list[list] = [[] for _ in texts]
    for first, block in _blocks(texts):
        for i, a, b, full, lang, confidence in zip(*(x.tolist() for x in _sure(held, block))):
            out[first + i].append((a, b, LANGUAGES[lang], confidence, bool(full)))
    return out


SEGMENT = "start int, end int, lang string, confidence double, full boolean"


def _read(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), label_language(F.col("lang")).alias("label"), "text"))


def segments(docs: DataFrame, held: LanguageFilter) -> DataFrame:
    """One row per document: its id, label and recognised sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filt = shared.value
        for batch in batches:
            marked = _segments(filt, [t or "" for t in batch["text"]])
            batch["segments"] = [
                [dict(zip(("start", "end", "lang", "confidence", "full"), m)) for m in row] for row in marked
            ]
            yield batch[["doc_id", "label", "segments"]]

    return _read(docs).mapInPandas(run, f"doc_id long, label string, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")


PER_LANGUAGE = "doc_id long, label string, lang string, sentences long, chars long, confidence double, surest double"


def languages(docs: DataFrame, held: LanguageFilter) -> DataFrame:
    """doc_id, label, lang, sentences, chars and confidence of each language of each document.

    The language of most text counts; a further one does if a full sentence is
    surely in it, since neighbouring languages share many short sentences.
    Sentences are summed up per document where they are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(held)
    many = len(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filt = shared.value
        for batch in batches:
            ids, labels = batch["doc_id"].to_numpy(), batch["label"].to_numpy()
            for first, block in _blocks([t or "" for t in batch["text"]]):
                at, a, b, full, lang, confidence = _sure(filt, block)
                key, inverse = np.unique(at * many + lang, return_inverse=True)
                n = len(key)
                surest = np.full(n, -1.0)
                np.maximum.at(surest, inverse[full > 0], confidence[full > 0])
                at = first + key // many
                yield pd.DataFrame(
                    {
                        "doc_id": ids[at], "label": labels[at], "lang": [LANGUAGES[k] for k in (key % many).tolist()], "sentences": np.bincount(inverse, weights=full, minlength=n).astype(np.int64), "chars": np.bincount(inverse, weights=b - a, minlength=n).astype(np.int64),
                        "confidence": np.bincount(inverse, weights=confidence, minlength=n) / np.maximum(np.bincount(inverse, minlength=n), 1), "surest": surest,
                    }
                )

    per = _read(docs).mapInPandas(run, PER_LANGUAGE)
    doc = Window.partitionBy("doc_id", "label")
    return (
        per.withColumn("most", F.max("sentences").over(doc))
        .withColumn("rank", F.row_number().over(doc.orderBy(F.desc("chars"), "lang")))
        .where((F.col("rank") == 1) & ((F.col("sentences") > 0) | (F.col("most") == 0)) | (F.col("sentences") > 0) & (F.col("surest") >= SECOND_CONFIDENCE))
        .drop("most", "rank", "surest")
    )


def wrong_labels(found: DataFrame) -> DataFrame:
    """Languages of the documents whose label is missing, unknown or wrong, or that mix languages."""
    per = found.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))
    cases = per.where(F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label")))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
