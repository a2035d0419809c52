"""Evidence packing under a token budget."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import estimate_words

#: Quality of a source type, and bonuses by route.
QUALITY = {"chunk": 1.0, "visual_page": 1.0, "proposition": 0.94, "summary": 0.9, "graph_edge": 0.72}
BONUS = {
    "global": {"summary": 0.08, "chunk": 0.05},
    "argumentative": {"proposition": 0.06, "chunk": 0.05},
    "multi_hop": {"proposition": 0.05, "chunk": 0.05},
    "visual": {"visual_page": 0.12},
}
#: Fixed values by route: items, items per document, tokens.
LIMITS = {
    "exact": (10, 4, 2400), "factual_local": (12, 4, 3200), "multi_hop": (24, 4, 6000), "global": (24, 4, 6000), "argumentative": (24, 4, 6000), "visual": (10, 3, 3600),
}
DEFAULT = (12, 4, 3200)
ITEM = "query_id long, id string, position int, tokens int, utility double"


def order_items(items: DataFrame) -> DataFrame:
    """Items with utility, tokens and their order; repeated snippets of one document dropped.

    Columns: query_id, route, id, source_type, document_id, title, snippet, score, citable.
    """
    quality, bonus = F.lit(0.85), F.lit(0.0)
    for kind, q in QUALITY.items():
        quality = F.when(F.col("source_type") == kind, q).otherwise(quality)
    for route, kinds in BONUS.items():
        for kind, b in kinds.items():
            bonus = F.when((F.col("route") == route) & (F.col("source_type") == kind), b).otherwise(bonus)
    utility = F.col("score") * quality + bonus + F.when(F.col("citable") & F.col("document_id").isNotNull(), 0.04).otherwise(0.0)
    signature = F.concat_ws(":", "source_type", "document_id", F.regexp_replace(F.lower(F.trim(F.substring("snippet", 1, 160))), r"\s+", " "))
    low = (F.length(F.trim("snippet")) < 24) & (F.col("source_type") != "graph_edge") | (F.col("source_type") == "summary") & (F.size(F.split(F.trim("snippet"), r"\s+")) < 6)
    rows = items.select("*", F.round(utility, 9).alias("utility"), estimate_words(F.col("snippet"), F.col("title")).alias("tokens"), signature.alias("signature"), low.alias("low"))
    order = [F.desc("utility"), F.desc("score"), F.desc(F.col("document_id").isNotNull()), "id"]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "signature").orderBy(*order))).where("nth = 1").drop("nth", "signature")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def choose(rows: pd.DataFrame) -> pd.DataFrame:
    """Fold over one query's items, best first: coverage of documents, one chunk, then by utility.

    An item over the budget is passed over, so the choice is no prefix.
    """
    rows = rows.sort_values("position")
    most, per_document, budget = LIMITS.get(rows["route"].iloc[0], DEFAULT)
    wide = rows["route"].iloc[0] == "global"
    taken: list[int] = []
    used, documents, kinds = 0, Counter(), Counter()
    items = rows.to_dict("records")

    def take(i: int) -> bool:
        nonlocal used
        x = items[i]
        document = x["document_id"] or x["source_type"]
        cap = 2 if x["source_type"] == "graph_edge" else (8 if wide else 4) if x["source_type"] == "summary" else most
        if i in taken or x["low"] or len(taken) >= most or documents[document] >= per_document or kinds[x["source_type"]] >= cap or used + x["tokens"] > budget:
            return False
        taken.append(i)
        used += x["tokens"]
        documents[document] += 1
        kinds[x["source_type"]] += 1
        return True

    covered: set[str] = set()
    for i, x in enumerate(items):
        if x["document_id"] and x["document_id"] not in covered and x["citable"] and x["source_type"] != "graph_edge" and take(i):
            covered.add(x["document_id"])
    if not any(items[i]["source_type"] == "chunk" for i in taken):
        first = next((i for i, x in enumerate(items) if x["source_type"] == "chunk"), None)
        if first is not None:
            take(first)
    for i in range(len(items)):
        take(i)
    return pd.DataFrame(
        {"query_id": [items[i]["query_id"] for i in taken], "id": [items[i]["id"] for i in taken], "position": range(1, len(taken) + 1), "tokens": [items[i]["tokens"] for i in taken], "utility": [items[i]["utility"] for i in taken]}
    ).astype({"query_id": "int64", "position": "int32", "tokens": "int32", "utility": "float64"})


def pack(items: DataFrame, candidates: int = 500) -> DataFrame:
    """Chosen items per query with their position.

    At most 24 items fit any pack, at most 4 of one document; the fold sees the
    ``candidates`` best of a query, which bounds its group.
    """
    ordered = order_items(items).where(F.col("position") <= candidates)
    return ordered.groupBy("query_id").applyInPandas(choose, ITEM)


def pack_summary(packed: DataFrame, items: DataFrame) -> DataFrame:
    """Per query: chosen items, tokens, documents, contradictions."""
    rows = packed.join(items.select("query_id", "id", "document_id", "snippet"), ["query_id", "id"])
    clash = F.lower("snippet").rlike("however|but|sin embargo|contradict|no obstante")
    return rows.groupBy("query_id").agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.count_distinct("document_id").alias("documents"), F.sum(clash.cast("int")).alias("contradictions")
    )


def evidence_groups(packed: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of the chosen items by source type and title, in order of choice."""
    rows = packed.join(items.select("query_id", "id", "source_type", "title", "document_id"), ["query_id", "id"])
    label = F.concat_ws(":", "source_type", F.coalesce("title", "document_id", "source_type"))
    return rows.groupBy("query_id", label.alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("ids"))


#: Calls that the evidence of one answer is spread over.
MAP_CALLS = 6


def synthesis_groups(items: DataFrame, calls: int = MAP_CALLS) -> DataFrame:
    """query_id, group, label and the positions of the items in it: one group a document, at most ``calls`` of them.

    ``items``: query_id, position, document_id, title, of packs of bounded size.
    More documents are dealt to the group with the fewest items, in their order.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        document = rows["document_id"].where(rows["document_id"].fillna("") != "", "title:" + rows["title"].fillna(""))
        groups: dict[str, list[int]] = {}
        labels: dict[str, str] = {}
        for d, title, position in zip(document, rows["title"], rows["position"]):
            groups.setdefault(d, []).append(int(position))
            labels.setdefault(d, title or d)
        if len(groups) <= calls:
            out = [(labels[d], p) for d, p in groups.items()]
        else:
            dealt: list[list[str]] = [[] for _ in range(calls)]
            sizes = [0] * calls
            for d, p in groups.items():
                k = sizes.index(min(sizes))
                dealt[k].append(d)
                sizes[k] += len(p)
            named = lambda ds: " | ".join(labels[d] for d in ds[:3]) + (f" | +{len(ds) - 3} documentos" if len(ds) > 3 else "")
            out = [(named(ds), sorted(p for d in ds for p in groups[d])) for ds in dealt if ds]
        return pd.DataFrame({"query_id": key[0], "group": range(len(out)), "label": [x for x, _ in out], "positions": [p for _, p in out]})

    return items.select("query_id", "position", "document_id", "title").groupBy("query_id").applyInPandas(run, "query_id long, group int, label string, positions array<int>")
