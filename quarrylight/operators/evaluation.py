"""Metrics of retrieval and answers, claim support, grounding, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import answer_tokens, citation_indices, claims, fold_accents, support_tokens

SUPPORTED = 0.18
CITATION = r"\[\d+(?:\s*,\s*\d+)*\]"


def retrieval_metrics(hits: DataFrame, keywords: DataFrame, *, top_k: int = 20) -> DataFrame:
    """Per query: keyword recall, reciprocal rank, gain, distinct documents.

    ``hits``: query_id, rank, document_id, blob (title and snippet, folded).
    ``keywords``: query_id, position, keyword (folded). The reciprocal rank is
    that of the first listed keyword that is found at all.
    """
    top = hits.where(F.col("rank") <= top_k)
    found = keywords.join(top, "query_id", "left").groupBy("query_id", "position", "keyword").agg(
        F.min(F.when(F.contains("blob", F.col("keyword")), F.col("rank"))).alias("at")
    )
    per = found.groupBy("query_id").agg(
        F.avg(F.col("at").isNotNull().cast("double")).alias("recall"),
        F.min(F.when(F.col("at").isNotNull(), F.struct("position", "at"))).alias("first"),
        F.sum(F.coalesce(1 / F.log2(F.col("at") + 1), F.lit(0.0))).alias("gain"),
        F.count("*").alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(2), F.col("n") + 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double")))
    documents = top.groupBy("query_id").agg(F.count_distinct("document_id").alias("documents"))
    return per.join(documents, "query_id", "left").select(
        "query_id",
        F.round("recall", 6).alias("recall_at_k"),
        F.round(F.coalesce(1 / F.col("first.at"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.least(F.lit(1.0), F.col("gain") / ideal), 6).alias("ndcg"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )


def answer_claims(answers: DataFrame) -> DataFrame:
    """query_id, claim number, text, weighty tokens, cited numbers; claims with three tokens or more."""
    each = answers.select("query_id", F.posexplode(claims(F.col("answer"))).alias("n", "claim"))
    rows = each.select("query_id", "n", "claim", support_tokens(F.regexp_replace("claim", CITATION, " ")).alias("tokens"), citation_indices(F.col("claim")).alias("cited"))
    return rows.where(F.size("tokens") >= 3)


def claim_support(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim the best support over its cited evidence: 0.75 recall + 0.25 F1.

    ``evidence``: query_id, rank, text, citable.
    """
    cited = answer_claims(answers)
    held = evidence.where("citable").select("query_id", F.col("rank").alias("ref"), support_tokens(F.col("text")).alias("known"))
    pairs = cited.select("query_id", "n", "tokens", F.explode_outer("cited").alias("ref")).join(held, ["query_id", "ref"], "left")
    shared = F.size(F.array_intersect("tokens", "known"))
    recall, precision = shared / F.greatest(F.size("tokens"), F.lit(1)), shared / F.greatest(F.size("known"), F.lit(1))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    support = F.when(F.col("known").isNotNull(), F.round(0.75 * recall + 0.25 * f1, 3)).otherwise(0.0)
    return pairs.groupBy("query_id", "n").agg(F.max(support).alias("support"), F.count("known").alias("citable"), F.count("ref").alias("referenced"))


def grounding(answers: DataFrame, evidence: DataFrame, *, floor: float = 0.0) -> DataFrame:
    """Score and verdict of each answer from coverage, citations, support."""
    per = claim_support(answers, evidence).groupBy("query_id").agg(
        F.count("*").alias("claims"),
        F.avg((F.col("citable") > 0).cast("double")).alias("cited"),
        F.avg(((F.col("citable") > 0) & (F.col("support") >= SUPPORTED)).cast("double")).alias("supported"),
        F.avg("support").alias("mean"),
    )
    texts = evidence.groupBy("query_id").agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_list("text")))).alias("all_text"))
    words = F.filter(F.regexp_extract_all(F.lower("answer"), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0)), lambda w: F.length(w) > 2)
    covered = answers.join(texts, "query_id", "left").select(
        "query_id", (F.size(F.filter(words, lambda w: F.contains(F.coalesce("all_text", F.lit("")), w))) / F.greatest(F.size(words), F.lit(1))).alias("coverage")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.least(F.lit(1.0), F.lit(floor) + 0.20 * F.col("coverage") + 0.35 * F.round(zero("cited"), 3) + 0.25 * F.round(zero("supported"), 3) + 0.20 * F.round(zero("mean"), 3))
    rows = covered.join(per, "query_id", "left").select("query_id", F.coalesce("claims", F.lit(0)).alias("claims"), zero("cited").alias("cited"), zero("supported").alias("supported"), score.alias("score"))
    weak = (F.col("claims") > 0) & ((F.col("cited") < 1) | (F.col("supported") < F.col("cited")))
    capped = F.when(weak, F.least(F.col("score"), F.lit(0.74))).otherwise(F.col("score"))
    verdict = F.when((F.col("cited") == 0) | (F.col("score") < 0.35), "unverified").when(weak | (F.col("score") < 0.7), "partially_verified").otherwise("verified")
    return rows.select("query_id", "claims", F.round(capped, 3).alias("grounding"), verdict.alias("verdict"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Lexical relevance of answers: share of the expected answer's tokens (columns query_id, answer, expected)."""
    rows = answers.select("query_id", answer_tokens(fold_accents(F.coalesce("answer", F.lit("")))).alias("a"), answer_tokens(fold_accents(F.coalesce("expected", F.lit("")))).alias("e"))
    return rows.select("query_id", F.round(F.size(F.array_intersect("e", "a")) / F.greatest(F.size("e"), F.lit(1)), 3).alias("relevance"))


def answer_scores(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relevance, support, citations, grounding and overall score of each answer.

    ``answers``: query_id, answer, expected, citations, min_citations, forbidden
    (array of phrases). ``evidence``: query_id, text. A claim has three tokens or
    more; it is supported if some evidence holds 18 % of them.
    """
    folded = lambda c: fold_accents(F.coalesce(F.col(c), F.lit("")))
    each = answers.select("query_id", F.posexplode(claims(F.col("answer"))).alias("n", "claim"))
    said = each.select("query_id", "n", answer_tokens(fold_accents(F.regexp_replace("claim", CITATION, " "))).alias("tokens"), citation_indices(F.col("claim")).alias("cited")).where(F.size("tokens") >= 3)
    held = evidence.select("query_id", answer_tokens(fold_accents(F.coalesce("text", F.lit("")))).alias("known"))
    best = said.join(held, "query_id", "left").groupBy("query_id", "n", "cited").agg(F.max(F.coalesce(F.size(F.array_intersect("tokens", "known")) / F.size("tokens"), F.lit(0.0))).alias("support"))
    per = best.groupBy("query_id").agg(
        F.count("*").alias("claims"), F.sum((F.col("support") >= SUPPORTED).cast("int")).alias("held"), F.sum((F.size("cited") > 0).cast("int")).alias("marked"), F.size(F.array_distinct(F.flatten(F.collect_list("cited")))).alias("referenced")
    )
    forbidden = F.filter(F.coalesce("forbidden", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    rows = answers.select("query_id", "citations", "min_citations", folded("answer").alias("a"), folded("expected").alias("e"), forbidden.alias("forbidden"))
    hits = F.size(F.filter("forbidden", lambda x: F.contains(F.col("a"), F.lower(x))))
    rows = rows.join(per, "query_id", "left").select(
        "query_id",
        (F.size(F.array_intersect(answer_tokens(F.col("e")), answer_tokens(F.col("a")))) / F.greatest(F.size(answer_tokens(F.col("e"))), F.lit(1))).alias("relevance"),
        F.coalesce(F.col("held") / F.col("claims"), F.lit(0.0)).alias("support"),
        F.when(F.col("citations") < F.greatest(F.lit(0), F.coalesce("min_citations", F.lit(0))), 0.0).otherwise(F.coalesce(F.col("marked") / F.col("claims") * F.least(F.lit(1.0), F.col("citations") / F.greatest("referenced", F.lit(1))), F.lit(0.0))).alias("citation"),
        F.when(F.size("forbidden") > 0, hits / F.size("forbidden")).otherwise(0.0).alias("broken"),
    )
    # A half of the last place goes up, however its sum was added.
    unit = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 1000 + 0.5 + 1e-9) / 1000
    return rows.select(
        "query_id", F.round("relevance", 3).alias("relevance"), F.round("support", 3).alias("support_coverage"), F.round("citation", 3).alias("citation_coverage"), F.round("broken", 3).alias("forbidden_rate"),
        unit(0.45 * F.col("support") + 0.30 * F.col("citation") + 0.25 * F.col("relevance") - 0.35 * F.col("broken")).alias("grounding"), unit(0.35 * F.col("relevance") + 0.35 * F.col("support") + 0.20 * F.col("citation") + 0.10 * (1 - F.col("broken"))).alias("overall"),
    )


def run_summary(hits: DataFrame, expected: DataFrame, *, top_k: int = 20) -> DataFrame:
    """One row over all queries with expected paths: hits, failures, rates and means, queries without a result."""
    per = ranked_paths(hits, expected, top_k=top_k).join(hits.groupBy("query_id").agg(F.count("*").alias("results")), "query_id", "left")
    return per.agg(
        F.count("*").alias("queries"), F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("failures"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.sum(F.col("results").isNull().cast("int")).alias("without_result"),
    )


def ranked_paths(hits: DataFrame, expected: DataFrame, *, top_k: int = 20) -> DataFrame:
    """Per query: hit, reciprocal rank, recall of the expected paths (hits: query_id, path, rank)."""
    found = expected.join(hits.where(F.col("rank") <= top_k), ["query_id", "path"], "left")
    return found.groupBy("query_id").agg(
        F.max(F.col("rank").isNotNull().cast("int")).alias("hit"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall")
    )


def macro_means(cases: DataFrame, group: str, metrics: list[str], passed: Column) -> DataFrame:
    """Mean of each metric and share of passed cases."""
    return cases.groupBy(group).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics], F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"), F.count("*").alias("cases"))


def metric_deltas(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Current minus previous value of every metric either run has; a missing one is 0."""
    a, b = previous.select(*key, F.col("value").alias("previous")), current.select(*key, F.col("value").alias("current"))
    both = a.join(b, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(*key, F.round(zero("current") - zero("previous"), 6).alias("delta"))


def previous_run(runs: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Each run with the value of the run before it in its group."""
    return runs.withColumn("previous", F.lag(value).over(Window.partitionBy(*group).orderBy(order)))
