"""Which source files nobody wrote by hand.

Every file and directory of a snapshot is a variable with five labels. Files
carry evidence from their text and name, directories from their name; a
directory and what lies in it are tied by compatibilities, so siblings speak
for each other through their parent. On a tree two sweeps of belief propagation
give exact marginals. The messages of files are sums grouped by directory; the
directories are solved in whole subtrees of bounded size, and where a tree is
larger, what remains above these subtrees is solved in the same way first.

Texts are read once each, however many paths hold them; blocks that several
repositories hold are evidence of a copy. A licence in a file's head speaks for
a copy unless so large a part of the repository has it that it is its own.

Defined cases: null text is looked up by its content hash, else the path alone
decides; empty text is handwritten unless its path says otherwise; separators
and "./" in paths don't matter; null paths are ignored; repeated rows count
once; of several deliveries of a file any that was not handwritten counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import canonical_digest
from quarrylight.runtime import HOT_KEYS, HOT_ROWS, cut, distinct_texts, hot_keys, parallelism, spread_join

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
H, G, M, V, B = range(5)
#: Log odds of a file without any evidence.
PRIOR = (0.0, -3.0, -3.0, -2.4, -3.0)
#: Rows: the directory's label; columns: the label of what lies in it.
COMPATIBLE = (
    (0.940, 0.015, 0.015, 0.015, 0.015),
    (0.400, 0.560, 0.010, 0.010, 0.020),
    (0.400, 0.010, 0.560, 0.020, 0.010),
    (0.012, 0.010, 0.030, 0.938, 0.010),
    (0.400, 0.020, 0.010, 0.010, 0.560),
)
LOG_COMPATIBLE = [[math.log(p) for p in row] for row in COMPATIBLE]

#: Names by which tools and people mark directories and files.
DIRECTORIES = {
    V: (("vendor", "vendors", "vendored", "node_modules", "third_party", "third-party", "thirdparty", "external", "externals", "bower_components", "jspm_packages", "site-packages", "pods"), 7.0),
    "lib": (("lib", "libs"), 1.0),
    G: (("generated", "__generated__", "autogen", "codegen"), 2.0),
    M: (("dist", "static", "minified", "bundles"), 0.7),
    B: (("fixtures", "testdata", "__snapshots__", "dumps", "seeds", "blobs"), 0.7),
}
FILE_NAMES = {
    M: ((r"\.min\.(?:js|css|mjs|cjs)$", 6.0), (r"[.\-]bundle\.(?:js|css|mjs)$", 5.0), (r"\.[0-9a-f]{6,20}\.(?:js|css|mjs)$", 4.0)),
    G: ((r"_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h)$|\.g\.(?:dart|cs|ts)$|[._]generated\.|\.designer\.cs$|\.gen\.\w+$", 5.0),),
    B: ((r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|composer\.lock|go\.sum|uv\.lock)$", 9.0), (r"[._\-](?:dump|seed|backup)\.(?:sql|json)$|\.csv$", 2.5)),
}

_COMMENT = re.compile(r"^\s*(?:/\*+!?|//+!?|#+!?|--+|<!--+|\*+|;+|%+|\"\"\")\s*(.*)")
_GENERATED = re.compile(
    r"(?:(?:the |this )?(?:code|file|source|module|class)s?\b)?\s*(?:is|was|has been)?\s*(?:auto(?:matically)?[- ]?)?(?:generated|produced|created)\s+(?:by|from|with|using)\b(?! (?:this|hand))"
    r"|(?:this (?:file|code) )?(?:is|was|has been) (?:auto(?:matically)?[- ]?)(?:generated|produced)"
    r"|@generated\b|<auto-?generated|auto-?generated\b\s*(?:file|code|source|by|from|with|[:(.;]|$)|autogenerated\b"
    r"|generado (?:automáticamente|por)|(?:archivo|fichero|código) generado|do not (?:edit|modify)[.!]*\s*(?:\*/|-->)?$",
    re.I,
)
_LICENCE = re.compile(
    r"copyright (?:\(c\)|©|\d{4})|\(c\) .{1,60}(?:authors|contributors)|released under the|licensed under|permission is hereby granted|spdx-license-identifier|this file is part of .{1,60}(?:release|version|\bv?\d)|\b(?:MIT|BSD-[23]-Clause|Apache-2\.0|MPL-2\.0|ISC)\b (?:license|licence)?|^!?\s*[\w.\-]+ v?\d+\.\d+\.\d+\s*(?:\||$)",
    re.I,
)
_INSERT = re.compile(r"^\s*(?:INSERT INTO\s+\S+\s+(?:\([^)]*\)\s*)?VALUES\s*\(|\(\s*\d+,.*\)[,;]\s*$)", re.I)
_BASE64 = re.compile(r"[A-Za-z0-9+/_\-]{40,}={0,2}")
_WORD = re.compile(r"[A-Za-z_]\w*")
_DATA = re.compile(r"^\s*(?:export default|module\.exports\s*=|(?:const|let|var)\s+\w+\s*=|\w+\s*=)?\s*[\[{]\s*[\[{\"\-\d]")
_MINIFIED_LANGUAGES = {"javascript", "typescript", "css", "html", "json", "python", "java", "shell", "sql"}


def _shape(line: str) -> str:
    line = re.sub(r"\"[^\"]*\"|'[^']*'", "S", line)
    return re.sub(r"\d+(?:\.\d+)?", "0", _WORD.sub("w", line)).strip()


_STRONG = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated (?:file|code|source)|(?:this |the )?(?:code|file|source|module)s? (?:(?:is|was|has been) )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using)\b(?! hand)|do not (?:edit|modify)[.!]*\s*(?:\*/|-->)?$",
    re.I,
)
#: Lines that may stand before or among the comments of a file's head.
_OPENING = re.compile(r"""^\s*(?:#!|<\?xml|<!doctype|package\s|import\s|from\s+\S+\s+import\s|['\"]use strict['\"]|@charset)""", re.I)
_BLOCK_OPENS, _BLOCK_CLOSES = ("/*", "<!--", '"""'), re.compile(r"\*/|-->|\"\"\"")
_LOCKED = re.compile(r'^\s*"lockfileVersion"\s*:', re.M)
_BYTES = re.compile(r"\b0x[0-9a-fA-F]{2}\s*,")
_MAPPED = re.compile(r"^\s*(?://|/\*)[#@]\s*sourceMappingURL=", re.M)
_CODE_LANGUAGES = {"python", "javascript", "typescript", "java", "go", "c", "rust"}


def comments_of(lines: list[str]) -> tuple[list[str], list[str], list[str]]:
    """The comments of the head, those further down, and the lines that are none."""
    head: list[str] = []
    below: list[str] = []
    code: list[str] = []
    inside, in_head = False, True
    for line in lines:
        if inside:
            # A header of several lines goes on without a mark in block comments.
            (head if in_head else below).append(line.strip().lstrip("* "))
            inside = not _BLOCK_CLOSES.search(line)
            continue
        found = _COMMENT.match(line)
        if not found:
            code.append(line)
            in_head = in_head and bool(_OPENING.match(line))
            continue
        (head if in_head else below).append(found[1])
        bare = line.lstrip()
        if in_head and bare.startswith(_BLOCK_OPENS) and not _BLOCK_CLOSES.search(bare, 3):
            inside = True
    return head, below, code


def text_evidence(text: str, language: str | None) -> tuple[list[float], str | None]:
    """Log odds of the five labels that the whole text speaks for, and the licence that its head names."""
    score = [0.0] * 5
    if not text.strip():
        return score, None
    lines = [x for x in text.split("\n") if x.strip()]
    language = (language or "").lower()
    size = len(text)
    spaces = sum(map(text.count, " \t\n\r")) / size
    head, below, code = comments_of(lines)
    if any(map(_GENERATED.match, head)) or any(map(_STRONG.match, below)):
        score[G] += 11
    licence = next((c for c in head if _LICENCE.search(c)), None)
    if any("by hand" in c for c in head) and not score[G]:
        score[H] += 1
    # Lines that all look alike were written by a loop.
    if language in _CODE_LANGUAGES and len(code) >= 8 and sum("(" in x for x in code) >= 0.7 * len(code):
        shapes = Counter(map(_shape, code))
        shape, most = shapes.most_common(1)[0]
        if most >= 0.7 * len(code) and len(shape) > 12 and "w(" in shape:
            score[G] += 8
    encoded = sum(len(m) for m in _BASE64.findall(text) if sum(c.isdigit() for c in m) >= 3 and not m.islower())
    if encoded > 0.55 * size and size > 400:
        score[B] += 11
    if "values" in text or "VALUES" in text or "Values" in text:
        rows = sum(bool(_INSERT.match(x)) for x in lines)
        if rows >= 10 and rows > 0.7 * len(lines):
            score[B] += 11
    if size > 1200 and _DATA.match(text):
        digits = sum(map(text.count, "0123456789"))
        marks = sum(map(text.count, "[]{},:\"'"))
        if (digits + marks) > 0.45 * size and (language != "json" or digits > 0.3 * size):
            score[B] += 11
    if language == "lockfile" or "lockfileVersion" in text and _LOCKED.search(text):
        score[B] += 12
    if language in _MINIFIED_LANGUAGES or not language:
        wide = "".join(x for x in lines if len(x) > 200)
        if len(wide) > 0.6 * size and spaces < 0.12 and size > 300 and sum(map(wide.count, ";{}()=,:.")) > 0.12 * len(wide):
            score[M] += 10
    if size > 400 and "0x" in text and len(_BYTES.findall(text)) * 5 > 0.5 * size:
        score[B] += 11
    if "sourceMappingURL" in text and _MAPPED.search(text):
        score[M] += 2
    return score, licence


MIN_BLOCK = 45
#: Share of pairs of blocks held by several repositories from which a text counts as a copy.
COPIED = 0.5
_MARKS = re.compile(r"^(?:\s*(?:/\*.*?\*/|<!--.*?-->|(?://|#|--)[^\n]*(?:\n|$)))+", re.S)


_BLANK = re.compile(r"\n[ \t]*\r?\n")


def blocks_of(text: str) -> list[str]:
    """Paragraphs of code without leading comments, spaces evened; short ones say nothing."""
    blocks = (" ".join(_MARKS.sub("", b).split()) for b in _BLANK.split(text) if len(b) >= MIN_BLOCK)
    return list(dict.fromkeys(b for b in blocks if len(b) >= MIN_BLOCK))


READ = "text_key string, language string, ra long, rb long, " + ", ".join(f"t{k} double" for k in range(5)) + ", licence long, blocks array<long>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [text_evidence(t, lang) for t, lang in zip(batch["text"], batch["language"])]
        # Two blocks in a row: single ones, such as a usual loop, recur by chance.
        blocks = [[xxhash.xxh64_intdigest(f"{a}\0{b}") - (1 << 63) for a, b in pairwise(blocks_of(t))] for t in batch["text"]]
        out = batch[["text_key", "language", "ra", "rb"]].copy()
        for k in range(5):
            out[f"t{k}"] = [s[k] for s, _ in found]
        # Years and names of versions aside, one licence is one line.
        named = [None if x is None else xxhash.xxh64_intdigest(re.sub(r"[\W\d_]+", " ", x).strip().lower()) - (1 << 63) for _, x in found]
        out["licence"] = pd.array(named, dtype="Int64")
        out["blocks"] = blocks
        yield out


def _log_sum(values: list[Column]) -> Column:
    top = F.greatest(*values)
    return top + F.log(sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top)))


def _upward(prefix: str) -> list[Column]:
    """Message to the parent: for each of its labels, the sum over the child's labels."""
    return [_log_sum([F.col(f"{prefix}{k}") + F.lit(LOG_COMPATIBLE[p][k]) for k in range(5)]) for p in range(5)]


def _evidence(label: int, tests: list[tuple[Column, float]]) -> Column:
    return sum((F.when(test, F.lit(w)).otherwise(F.lit(0.0)) for test, w in tests), F.lit(0.0))


#: Log odds that a licence in the head gives to a copy.
LICENCE = 9.0
#: Share of a repository's files, and their number, from which a licence is the repository's own.
OWN_SHARE, OWN_FILES = 0.2, 5


def _leaves(files: DataFrame) -> DataFrame:
    """Each delivery of a file with its directory as ``node``, its evidence l0..l4 and the licence in its head."""
    known = files.where(F.col("path").isNotNull())
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    keyed = known.select(
        "generation_id",
        "path",
        F.coalesce("repository_id", F.lit("")).alias("repository_id"),
        F.coalesce("language", F.lit("")).alias("language"),
        "text",
        F.coalesce(F.sha2("text", 256), canonical_digest(F.col("content_hash"), F.col("text"))).alias("text_key"),
    )
    hot, salt = hot_keys(keyed, "text_key"), ("generation_id", "path")
    held = F.xxhash64("repository_id")
    texts = distinct_texts(keyed, "text", "language", salt=salt, hot=hot, more={"ra": F.min(held), "rb": F.max(held)})
    read = cut(texts.mapInPandas(_read, READ))
    # Share of a text's pairs of blocks that several repositories hold.
    pieces = read.select("text_key", "language", "ra", "rb", F.explode("blocks").alias("block"))
    usual = hot_keys(pieces, "block")
    shared = pieces.groupBy("block").agg(F.min("ra").alias("a"), F.max("rb").alias("b")).where("a < b").select("block", F.lit(1).alias("shared"))
    if hot:
        pieces, read = pieces.select("text_key", "language", "block").distinct(), read.dropDuplicates(["text_key", "language"])
    copied = (
        spread_join(pieces.select("text_key", "language", "block"), shared, ["block"], "left", usual, ("text_key",))
        .groupBy("text_key", "language")
        .agg(F.avg(F.coalesce("shared", F.lit(0))).alias("copied"), F.count("shared").alias("shared_blocks"))
    )
    evidence = read.drop("blocks", "ra", "rb").join(copied, ["text_key", "language"], "left")
    rows = spread_join(keyed.drop("text").distinct(), evidence, ["text_key", "language"], "left", hot, salt).withColumn("parts", parts)
    low = F.lower(F.array_join("parts", "/"))
    scores = []
    for k in range(5):
        name = _evidence(k, [(low.rlike(pattern), w) for pattern, w in FILE_NAMES.get(k, ())])
        score = F.lit(PRIOR[k]) + F.coalesce(F.col(f"t{k}"), F.lit(0.0)) + name
        if k == V:
            score = score + F.when(F.col("copied") >= COPIED, F.least(F.lit(9.0), 1.5 * F.col("shared_blocks"))).otherwise(F.lit(0.0))
        if k == B:
            score = score + F.when(F.col("language") == "lockfile", F.lit(5.0)).otherwise(F.lit(0.0))
        scores.append(score.alias(f"l{k}"))
    directory = F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/")
    node = F.concat_ws("\0", F.coalesce(F.col("generation_id").cast("string"), F.lit("")), directory)
    found = cut(rows.select("generation_id", "path", "repository_id", node.alias("node"), "licence", *scores))
    # A licence that a good part of the repository has is its own.
    per = found.groupBy("repository_id", "licence").agg(F.count("*").alias("n"))
    whole = per.groupBy("repository_id").agg(F.sum("n").alias("files"))
    own = per.where("licence IS NOT NULL").join(whole, "repository_id").where((F.col("n") >= OWN_SHARE * F.col("files")) & (F.col("n") >= OWN_FILES)).select("repository_id", "licence", F.lit(True).alias("own"))
    copy = F.when(F.col("licence").isNotNull() & F.col("own").isNull(), F.lit(LICENCE)).otherwise(F.lit(0.0))
    return found.join(own, ["repository_id", "licence"], "left").withColumn(f"l{V}", F.col(f"l{V}") + copy).select("generation_id", "path", "node", *[f"l{k}" for k in range(5)])


# ---- the tree --------------------------------------------------------------

#: Directories with files in a subtree that one task solves.
SUBTREE = 20_000
_COMPATIBLE = np.array(LOG_COMPATIBLE)
NODE = "node string, " + ", ".join(f"b{k} double" for k in range(5))
RAISED = "top string, " + NODE


def _log_sums(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(values - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def _up(evidence: np.ndarray) -> np.ndarray:
    """Messages to the parents: for each label there, the sum over the labels here."""
    return _log_sums(evidence[:, None, :] + _COMPATIBLE[None, :, :], 2)


def _down(cavity: np.ndarray) -> np.ndarray:
    """Messages to the children, from what their parents believe without them."""
    return _log_sums(cavity[:, :, None] + _COMPATIBLE[None, :, :], 1)


def _parent(node: str) -> str:
    """The directory above; the root's is no directory."""
    return node.rpartition("/")[0] if "/" in node else node.partition("\0")[0] + "\0" if not node.endswith("\0") else ""


def solve(nodes: list[str], evidence: np.ndarray, from_above: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of the directories of whole subtrees, and what each heard from below with its own evidence.

    ``from_above`` are the messages that the tops of the subtrees get.
    """
    index = {n: i for i, n in enumerate(nodes)}
    parent = np.array([index.get(_parent(n), -1) for n in nodes], dtype=np.int64)
    depth = np.array([0 if n.endswith("\0") else n.count("/") + 1 for n in nodes], dtype=np.int64)
    heard, up = evidence.copy(), np.zeros_like(evidence)
    levels = [np.nonzero((depth == d) & (parent >= 0))[0] for d in range(int(depth.max(initial=0)) + 1)]
    for at in reversed(levels):
        up[at] = _up(heard[at])
        np.add.at(heard, parent[at], up[at])
    beliefs = heard.copy()
    for n, message in (from_above or {}).items():
        beliefs[index[n]] += message
    for at in levels:
        beliefs[at] += _down(beliefs[parent[at]] - up[at])
    return beliefs, heard


def _frame(nodes: list[str], values: np.ndarray, **first: list) -> pd.DataFrame:
    return pd.DataFrame({**first, "node": nodes, **{f"b{k}": values[:, k] for k in range(5)}})


def _solve_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if rows:
        rows = pd.concat(rows, ignore_index=True)
        nodes = rows["node"].tolist()
        yield _frame(nodes, solve(nodes, rows[[f"e{k}" for k in range(5)]].to_numpy(float))[0])


def _raise_tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The message of each subtree's top to the directory above."""
    rows = [b for b in batches if len(b)]
    if rows:
        rows = pd.concat(rows, ignore_index=True)
        nodes = rows["node"].tolist()
        tops = (rows["node"] == rows["top"]).to_numpy()
        heard = solve(nodes, rows[[f"e{k}" for k in range(5)]].to_numpy(float))[1]
        yield _frame([n for n, t in zip(nodes, tops) if t], _up(heard[tops]), top=[_parent(n) for n, t in zip(nodes, tops) if t])


def _solve_below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Subtrees whose tops' rows carry, as a second row without evidence, what the directory above believes."""
    rows = [b for b in batches if len(b)]
    if rows:
        rows = pd.concat(rows, ignore_index=True)
        above = rows["above"].to_numpy(bool)
        values = rows[[f"e{k}" for k in range(5)]].to_numpy(float)
        nodes = rows.loc[~above, "node"].tolist()
        heard = solve(nodes, values[~above])[1]
        index = {n: i for i, n in enumerate(nodes)}
        told = {n: _down((v - _up(heard[[index[n]]])[0])[None, :])[0] for n, v in zip(rows.loc[above, "node"], values[above])}
        yield _frame(nodes, solve(nodes, values[~above], told)[0])


def _directories(leaves: DataFrame) -> DataFrame:
    """Every directory: its depth, evidence e0..e4 of its name and of the files in it, files in it, and directories with files below."""
    inside = leaves.groupBy("node").agg(*[F.sum(m).alias(f"f{k}") for k, m in enumerate(_upward("l"))], F.count("*").alias("files"))
    part = F.split(F.split("node", "\0")[1], "/")
    depth = F.when(F.split("node", "\0")[1] == "", F.lit(0)).otherwise(F.size(part))
    prefix = lambda n: F.concat(F.split("node", "\0")[0], F.lit("\0"), F.array_join(F.slice(part, 1, n), "/"))
    each = inside.withColumn("depth", depth)
    each = each.select("node", *[f"f{k}" for k in range(5)], "files", "depth", F.explode(F.sequence(F.lit(0), "depth")).alias("at"))
    here = F.col("at") == F.col("depth")
    merged = (
        each.select(prefix(F.col("at")).alias("dir"), F.col("at").alias("level"), *[F.when(here, F.col(f"f{k}")).otherwise(F.lit(0.0)).alias(f"f{k}") for k in range(5)], F.when(here, F.col("files")).otherwise(F.lit(0)).alias("files"))
        .groupBy("dir", "level")
        .agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in range(5)], F.sum("files").alias("files"), F.count("*").alias("below"))
    )
    name = F.lower(F.element_at(F.split(F.split("dir", "\0")[1], "/"), -1))
    tests = {k: [(name.isin(*DIRECTORIES[k][0]), DIRECTORIES[k][1])] for k in DIRECTORIES}
    tests[V] += tests.pop("lib")
    return cut(
        merged.select(
            F.col("dir").alias("node"), F.col("level").alias("depth"), "files", "below", *[(F.col(f"f{k}") + _evidence(k, tests.get(k, []))).alias(f"e{k}") for k in range(5)]
        )
    )


def _snapshot() -> Column:
    return F.split("node", "\0")[0]


def directory_beliefs(dirs: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """node and beliefs b0..b4 of directories (node, depth, below, e0..e4), which are materialised."""
    tasks = max(parallelism(dirs.sparkSession), 2 * dirs.rdd.getNumPartitions())
    evidence = [f"e{k}" for k in range(5)]
    # The depth from which every subtree of a snapshot is small enough.
    cuts = dirs.groupBy(_snapshot().alias("snapshot")).agg(F.coalesce(F.max(F.when(F.col("below") > subtree, F.col("depth") + 1)), F.lit(0)).alias("cut"))
    if (cuts.agg(F.max("cut")).first()[0] or 0) == 0:
        return dirs.select("node", *evidence).repartition(tasks, _snapshot()).mapInPandas(_solve_whole, NODE)
    placed = dirs.withColumn("snapshot", _snapshot()).join(cuts, "snapshot")
    part = F.split(F.split("node", "\0")[1], "/")
    top = F.concat("snapshot", F.lit("\0"), F.array_join(F.slice(part, 1, "cut"), "/"))
    lower = placed.where(F.col("depth") >= F.col("cut")).select(top.alias("top"), "node", *evidence)
    raised = cut(lower.repartition(tasks, "top").mapInPandas(_raise_tops, RAISED))
    sums = raised.groupBy(F.col("top").alias("node")).agg(*[F.sum(f"b{k}").alias(f"s{k}") for k in range(5)], F.count("*").alias("small"))
    upper = cut(
        placed.where(F.col("depth") < F.col("cut"))
        .join(sums, "node", "left")
        .select("node", "depth", *[(F.col(f"e{k}") + F.coalesce(F.col(f"s{k}"), F.lit(0.0))).alias(f"e{k}") for k in range(5)])
    )
    # Of the upper part every directory counts, with or without files.
    up_part = F.split(F.split("node", "\0")[1], "/")
    counted = upper.select(F.explode(F.transform(F.sequence(F.lit(0), "depth"), lambda n: F.concat(_snapshot(), F.lit("\0"), F.array_join(F.slice(up_part, 1, n), "/")))).alias("node")).groupBy("node").agg(F.count("*").alias("below"))
    above = cut(directory_beliefs(cut(upper.join(counted, "node")), subtree))
    seeds = raised.select(F.col("top").alias("parent"), "node").join(above.withColumnRenamed("node", "parent"), "parent").select(F.col("node").alias("top"), "node", *[F.col(f"b{k}").alias(f"e{k}") for k in range(5)], F.lit(True).alias("above"))
    both = lower.withColumn("above", F.lit(False)).unionByName(seeds)
    return above.unionByName(both.repartition(tasks, "top").mapInPandas(_solve_below, NODE))


LABEL = "generation_id int, path string, label string, handwritten double"


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own, held = batch[[f"l{k}" for k in range(5)]].to_numpy(float), batch[[f"b{k}" for k in range(5)]].to_numpy(float)
        score = own + _down(held - _up(own)) if len(batch) else own
        out = batch[["generation_id", "path"]].copy()
        out["label"] = [LABELS[i] for i in score.argmax(axis=1)] if len(batch) else []
        out["handwritten"] = np.exp(score[:, H] - _log_sums(score, 1)) if len(batch) else []
        yield out


def beliefs(files: DataFrame) -> DataFrame:
    """generation_id, path, label and its probability, one row per delivery of a file."""
    leaves = _leaves(files)
    dirs = _directories(leaves)
    full = [r["hash"] for r in dirs.where(F.col("files") >= HOT_ROWS).orderBy(F.desc("files"), "node").limit(HOT_KEYS).select(F.xxhash64("node").alias("hash")).collect()]
    held = directory_beliefs(dirs)
    final = spread_join(leaves, held, ["node"], "inner", full, ("path",))
    return final.drop("node").mapInPandas(_label, LABEL)


def not_handwritten(files: DataFrame) -> DataFrame:
    """Files with more than even odds of not having been written by hand."""
    return beliefs(files).where("handwritten < 0.5")
