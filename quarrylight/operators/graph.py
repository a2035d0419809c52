"""Relations: resolution, expansion, centrality, repository map, impact."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import bucket_of, code_terms, looks_like_test, top_directory
from quarrylight.runtime import cut

DAMPING, ITERATIONS, CUT_EVERY = 0.85, 30, 5
#: Graphs up to this size are ranked in one task; larger ones by joins.
ONE_TASK_NODES, ONE_TASK_LINKS = 1_000_000, 5_000_000
#: Weight of a symbol kind; others weigh 0.5.
SYMBOL_WEIGHTS = {"enum": 1.3, "function": 1.2, "method": 0.75, "table": 1.35, "view": 1.25, "heading": 0.45, "config_key": 0.18}
MANIFESTS = ("readme.md", "agents.md", "pyproject.toml", "package.json", "cargo.toml", "go.mod", "docker-compose.yml", "docker-compose.yaml")
ENTRIES = ("main.py", "app.py", "index.ts", "index.tsx", "main.ts", "main.java")


def unresolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose target symbol does not exist."""
    return edges.join(symbols.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_anti")


def resolve_names(edges: DataFrame, symbols: DataFrame, scope: str = "generation_id") -> DataFrame:
    """Targets of unresolved edges: by qualified name, by name, by last part; only where exactly one symbol fits.

    A resolved edge keeps 0.95 of its confidence. Names are reduced to unique
    ones before the join, so no common name multiplies rows.
    """

    def unique(column: str, alias: str) -> DataFrame:
        one = symbols.where(F.col(column).isNotNull()).groupBy(scope, F.col(column).alias("target_name")).agg(F.count("*").alias("n"), F.min("id").alias(alias))
        return one.where("n = 1").drop("n")

    last = F.element_at(F.split("target_name", r"\."), -1)
    tiers = edges.join(unique("qualified_name", "by_qualified"), [scope, "target_name"], "left").join(unique("name", "by_name"), [scope, "target_name"], "left")
    tiers = tiers.withColumn("last", last).join(unique("name", "by_last").withColumnRenamed("target_name", "last"), [scope, "last"], "left")
    target = F.coalesce("by_qualified", "by_name", "by_last")
    return tiers.select(*edges.columns, target.alias("resolved_id"), F.when(target.isNotNull(), F.round(F.col("confidence") * 0.95, 6)).otherwise(F.col("confidence")).alias("resolved_confidence"))


def containing_symbol(points: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """The smallest span of ``symbols`` (line_start, line_end, name) around each point (id, line)."""
    spans = symbols.select(*scope, "name", "line_start", "line_end")
    pairs = points.join(spans, scope).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    order = Window.partitionBy(*scope, "id", "line").orderBy(F.col("line_end") - F.col("line_start"), F.desc("line_start"), "name")
    return pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*scope, "id", "line", "name", "line_start", "line_end")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, *, per_hop: int | None = None) -> DataFrame:
    """node and distance of everything within ``depth`` steps, in either direction.

    ``edges``: source, target, weight. ``per_hop`` keeps the strongest edges of a
    hop, by weight and ends. The frontier is cut after each hop.
    """
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next"), "weight").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("next"), "weight"))
    seen = seeds.select("node", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        steps = frontier.select("node").join(both, "node").select(F.col("next").alias("node"), "weight", F.col("node").alias("via"))
        if per_hop is not None:
            steps = steps.orderBy(F.desc("weight"), "via", "node").limit(per_hop)
        fresh = steps.select("node").distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _rank_arrays(names: np.ndarray, source: np.ndarray, target: np.ndarray, iterations: int, damping: float) -> np.ndarray:
    a, b = np.searchsorted(names, source), np.searchsorted(names, target)
    n = len(names)
    degree = np.bincount(a, minlength=n)
    rank = np.full(n, 1.0 / max(1, n))
    for _ in range(iterations):
        share = damping * rank / np.maximum(degree, 1)
        rank = (1 - damping) / n + damping * rank[degree == 0].sum() / n + np.bincount(b, weights=share[a], minlength=n)
    return rank


def _page_rank_in_tasks(nodes: DataFrame, links: DataFrame, iterations: int, damping: float) -> DataFrame:
    """The same iteration over arrays, for graphs that each fit one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows.loc[rows["target"].isna(), "source"].to_numpy(dtype=str))
        held = rows[rows["target"].notna()]
        rank = _rank_arrays(names, held["source"].to_numpy(dtype=str), held["target"].to_numpy(dtype=str), iterations, damping)
        return pd.DataFrame({"graph": key[0], "node": names, "rank": rank})

    rows = nodes.select("graph", F.col("node").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(links.select("graph", "source", "target"))
    return rows.groupBy("graph").applyInPandas(run, "graph string, node string, rank double")


def traverse(edges: DataFrame, root: str, *, direction: str = "dependencies", depth: int = 3, relations: list[str] | None = None, most: int = 200) -> DataFrame:
    """Symbols reached from ``root`` with their distance, the nearest first; at most ``most``.

    ``edges``: source, target, relation. callees and dependencies follow edges,
    callers and dependents go against them, both does either.
    """
    held = edges.where(F.col("relation").isin(*relations)) if relations else edges
    if direction in ("callers", "callees"):
        held = held.where("relation = 'calls'")
    along = held.select(F.col("source").alias("node"), F.col("target").alias("next"))
    against = held.select(F.col("target").alias("node"), F.col("source").alias("next"))
    steps = {"dependencies": along, "callees": along, "dependents": against, "callers": against, "both": along.unionByName(against)}[direction].distinct()
    seen = edges.sparkSession.createDataFrame([(root, 0)], "node string, distance int")
    frontier = seen
    for hop in range(1, depth + 1):
        fresh = frontier.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(fresh.withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0").orderBy("distance", "node").limit(most)


def page_rank(nodes: DataFrame, edges: DataFrame, *, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """node and rank, in one graph for each value of ``graph`` if there is such a column.

    Mass of nodes without links is spread evenly over their graph; loops and
    repeated links are ignored. A graph within ONE_TASK_NODES and
    ONE_TASK_LINKS is ranked over arrays, a larger one by joins; both give the
    same ranks.
    """
    grouped = "graph" in nodes.columns
    if not grouped:
        nodes, edges = nodes.withColumn("graph", F.lit("")), edges.withColumn("graph", F.lit(""))
    ids = cut(nodes.where("node IS NOT NULL").select(F.col("graph").cast("string").alias("graph"), "node").distinct())
    links = edges.where("source <> target").select(F.col("graph").cast("string").alias("graph"), "source", "target").distinct()
    for end in ("source", "target"):
        links = links.join(ids.withColumnRenamed("node", end), ["graph", end], "left_semi")
    links = cut(links)
    sizes = ids.groupBy("graph").agg(F.count("*").alias("count")).join(links.groupBy("graph").agg(F.count("*").alias("many")), "graph", "left")
    sizes = cut(sizes.select("graph", "count", ((F.col("count") > ONE_TASK_NODES) | (F.coalesce("many", F.lit(0)) > ONE_TASK_LINKS)).alias("large")))
    large = sizes.where("large")
    out = _page_rank_in_tasks(ids.join(large, "graph", "left_anti"), links.join(large, "graph", "left_anti"), iterations, damping)
    if not large.isEmpty():
        out = out.unionByName(_page_rank_by_joins(ids.join(large.select("graph", "count"), "graph"), links.join(large, "graph", "left_semi"), iterations, damping))
    return out if grouped else out.drop("graph")


def _page_rank_by_joins(ids: DataFrame, links: DataFrame, iterations: int, damping: float) -> DataFrame:
    out = links.groupBy("graph", F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    base = cut(ids.join(out, ["graph", "node"], "left"))
    ranks = base.withColumn("rank", 1.0 / F.col("count"))
    for i in range(iterations):
        given = ranks.where("degree IS NOT NULL").select("graph", F.col("node").alias("source"), (F.lit(damping) * F.col("rank") / F.col("degree")).alias("share"))
        received = given.join(links, ["graph", "source"]).groupBy("graph", F.col("target").alias("node")).agg(F.sum("share").alias("received"))
        loose = ranks.groupBy("graph").agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        ranks = base.join(received, ["graph", "node"], "left").join(loose, "graph").select(
            "graph", "node", "degree", "count", ((1 - damping) / F.col("count") + damping * F.col("loose") / F.col("count") + F.coalesce("received", F.lit(0.0))).alias("rank")
        )
        if (i + 1) % CUT_EVERY == 0:
            ranks = cut(ranks)
    return ranks.select("graph", "node", "rank")


def landmark(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    low = F.lower(path)
    return (
        F.when(name.isin(*MANIFESTS), 2.2).otherwise(0.0)
        + F.when(name.isin(*ENTRIES), 1.25).otherwise(0.0)
        + F.when(low.rlike(r"(^|/)tests/|\.test\.|\.spec\."), 0.6).otherwise(0.0)
        + F.when(F.startswith(low, F.lit("docs/")), 0.35).otherwise(0.0)
    )


def repository_map(files: DataFrame, symbols: DataFrame, ranks: DataFrame, focus: list[str]) -> DataFrame:
    """Score of each path of each graph: centrality, its strongest symbols, focus, landmark, status.

    ``files``: graph, path, git_status. ``symbols``: graph, path, name, kind. ``ranks``: graph, node, rank.
    """
    weight = F.lit(0.5)
    for kind, w in SYMBOL_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    at = ["graph", "path"]
    strongest = Window.partitionBy(*at).orderBy(F.desc("w"), "name")
    held = symbols.select(*at, "name", weight.alias("w")).withColumn("nth", F.row_number().over(strongest))
    per = held.groupBy(*at).agg(
        F.least(F.lit(8.0), F.sum(F.when(F.col("nth") <= 8, F.col("w")).otherwise(0.0))).alias("s"),
        F.least(F.lit(1.5), F.log1p(F.count("*")) * 0.25).alias("density"),
    )
    total = files.groupBy("graph").agg(F.count_distinct("path").alias("total"))
    rows = files.groupBy(*at).agg(F.max(F.coalesce("git_status", F.lit("clean"))).alias("status")).join(per, at, "left").join(ranks.withColumnRenamed("node", "path"), at, "left").join(total, "graph")
    if focus:
        wanted = F.array(*map(F.lit, sorted(focus)))
        named = symbols.select(*at, F.explode(code_terms(F.col("name"))).alias("t")).where(F.col("t").isin(*focus)).groupBy(*at).agg(F.count_distinct("t").alias("named"))
        rows = rows.join(named, at, "left")
        focused = 0.45 * F.size(F.array_intersect(wanted, code_terms(F.col("path")))) / len(focus) + 0.75 * F.coalesce("named", F.lit(0)) / len(focus)
    else:
        focused = F.lit(0.0)
    weight_of_focus = F.greatest(F.lit(24.0), F.least(F.lit(240.0), F.col("total") * 0.3))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (
        1 + zero("rank") * F.col("total") * (1.5 if focus else 3.0) + zero("s") + zero("density") + focused * weight_of_focus + landmark(F.col("path"))
        + F.when(~F.trim("status").isin("clean", ""), 1.25).otherwise(0.0)
    )
    return rows.select(*at, F.round(score, 6).alias("score"), F.round(zero("rank"), 9).alias("centrality"), F.round(focused, 6).alias("focus_score"))


def choose_map(entries: DataFrame, budget: int, *, focused: bool = False) -> DataFrame:
    """Paths of each graph chosen for a token budget; each chosen one lowers the score of its directory.

    A directory's own order never changes, so only as many of its best entries
    matter as could fill the budget; the fold runs over these.
    """
    if "graph" not in entries.columns:
        return choose_map(entries.withColumn("graph", F.lit("")), budget, focused=focused).drop("graph")
    bucket = bucket_of(F.col("path")) if focused else top_directory(F.col("path"))
    rows = entries.withColumn("bucket", bucket).withColumn("tokens", F.greatest(F.lit(1), F.ceil(F.octet_length("path") / 3).cast("int")))
    fits = rows.withColumn("k", F.row_number().over(Window.partitionBy("graph", "bucket").orderBy(F.desc("score"), "path"))).where(F.col("k") <= max(1, budget))
    fall = 0.1 if focused else 0.4

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left = {b: g.sort_values(["score", "path"], ascending=[False, True]).to_dict("records") for b, g in frame.groupby("bucket")}
        taken, used, counts = [], 0, Counter()
        while any(left.values()):
            b = min((b for b in left if left[b]), key=lambda b: (-left[b][0]["score"] / (1 + fall * counts[b]), left[b][0]["path"]))
            x = left[b].pop(0)
            cost = x["tokens"] + (1 if taken else 0)
            if used + cost > budget:
                continue
            taken.append((key[0], x["path"], x["score"], len(taken) + 1, x["tokens"]))
            used += cost
            counts[b] += 1
        return pd.DataFrame(taken, columns=["graph", "path", "score", "position", "tokens"]).astype({"position": "int32", "tokens": "int32"})

    # Damped scores only fall along a directory, so this keeps every entry that the fold can reach.
    damped = F.col("score") / (1 + fall * (F.col("k") - 1))
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc(damped), "path"))
    reachable = fits.withColumn("place", place).where(F.col("place") <= max(1, budget))
    return reachable.groupBy("graph").applyInPandas(fold, "graph string, path string, score double, position int, tokens int")


def impact(edges: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """graph, target, path, distance, is_test of what depends on each target file (columns graph, target)."""
    back = edges.select("graph", F.col("target").alias("node"), F.col("source").alias("next")).distinct()
    seen = cut(targets.select("graph", "target", F.col("target").alias("node"), F.lit(0).alias("distance")).distinct())
    frontier, key = seen, ["graph", "target", "node"]
    for hop in range(1, depth + 1):
        steps = frontier.select(*key).join(back, ["graph", "node"]).select("graph", "target", F.col("next").alias("node")).distinct()
        frontier = cut(steps.join(seen.select(*key), key, "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("graph", "target", F.col("node").alias("path"), "distance", looks_like_test(F.col("node")).alias("is_test"))


def affected(impacts: DataFrame) -> DataFrame:
    """graph, target and the other files that a change of it reaches, those nearest first (position from 1)."""
    order = Window.partitionBy("graph", "target").orderBy("distance", "path")
    return impacts.where("distance > 0").select("graph", "target", "path", "distance", F.row_number().over(order).alias("position"))


#: Characters from which a stem that lies within another one says something.
LEAST_STEM = 3


def stem(path: Column) -> Column:
    """A file's name without its directory, suffix and marks of a test."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(name, "^test_", ""), "_test$", "")


def related_tests(files: DataFrame, edges: DataFrame, targets: DataFrame, mentions: DataFrame | None = None, *, top_k: int = 20) -> DataFrame:
    """Test files of each target (graph, target): path, line, confidence, reason; one row a test, the surest.

    Tiers: an edge that says so (1.0), any other edge from a test (0.9), a
    literal mention (0.8), a mention by terms (0.65), names of which one lies
    within the other (0.55). Names meet by the pieces of the longer one, so no
    pair of unlike names is formed; ``mentions``: graph, target, path, line, exact.
    """
    test = looks_like_test(F.col("path"))
    found = (
        edges.join(targets, ["graph", "target"])
        .select("graph", "target", F.col("source").alias("path"), F.col("line").cast("int").alias("line"), F.when(F.col("relation") == "tests", 1.0).otherwise(0.9).alias("confidence"), F.col("relation").alias("reason"))
        .where(test)
    )
    if mentions is not None:
        said = mentions.where(test).select("graph", "target", "path", F.col("line").cast("int").alias("line"), F.when(F.col("exact"), 0.8).otherwise(0.65).alias("confidence"), F.lit("lexical_reference").alias("reason"))
        found = found.unionByName(said)
    wanted = targets.select("graph", "target", stem(F.col("target")).alias("wanted")).where("wanted <> ''").distinct()
    known = files.select("graph", "path").where(test).distinct().withColumn("own", stem(F.col("path"))).where("own <> ''")
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n)))))
    wide = known.select("graph", "own").distinct().withColumn("wanted", F.explode(pieces(F.col("own"))))
    inside = wide.join(wanted.select("graph", "wanted").distinct(), ["graph", "wanted"], "left_semi")
    narrow = wanted.select("graph", "wanted").distinct().withColumn("own", F.explode(pieces(F.col("wanted"))))
    around = narrow.join(known.select("graph", "own").distinct(), ["graph", "own"], "left_semi")
    alike = inside.unionByName(around.select("graph", "own", "wanted")).distinct()
    named = alike.join(wanted, ["graph", "wanted"]).join(known, ["graph", "own"]).select("graph", "target", "path", F.lit(1).alias("line"), F.lit(0.55).alias("confidence"), F.lit("naming_convention").alias("reason"))
    each = Window.partitionBy("graph", "target", "path").orderBy(F.desc("confidence"), "line", "reason")
    once = found.unionByName(named).where("path <> target").withColumn("nth", F.row_number().over(each)).where("nth = 1").drop("nth")
    place = Window.partitionBy("graph", "target").orderBy(F.desc("confidence"), "path", "line")
    return once.withColumn("position", F.row_number().over(place)).where(F.col("position") <= top_k)
