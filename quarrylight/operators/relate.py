"""Lookups over versioned tables: names, lines, layers, claims of work, verified excerpts, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import overlap
from quarrylight.operators.catalog import first_per

#: The verb of a relation, and the relations that an intent asks for (others ask for all).
VERBS = {"contradicts": "contradice a", "supports": "respalda/apoya a", "elaborates": "se detalla/elabora en", "defines": "define a", "appears_in": "aparece en", "mentions": "menciona a"}
ASKED_RELATIONS = {"argumentative": ("contradicts", "supports"), "factual": ("defines", "elaborates", "appears_in")}
#: Fields of an envelope that a snippet leaves out.
ENVELOPE_FIELDS = ("title", "video id", "video url", "channel", "kind", "language")
FUSION_CONSTANT = 60


def pieces_of(value: Column, lengths: list[int]) -> Column:
    """The distinct substrings of a string that have one of the lengths."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(n)))

    each = [of(n) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*each))) if each else F.array().cast("array<string>")


def symbol_search(symbols: DataFrame, queries: DataFrame, *, limit: int = 20) -> DataFrame:
    """Per query the symbols whose name or qualified name holds it, case ignored: exact names first.

    ``symbols``: generation_id, id, name, qualified_name, path, line_start.
    Names meet queries by their pieces of the lengths that queries have, so no
    pair that does not match is formed.
    """
    asked = queries.where("query <> ''").select("query_id", "query", F.lower("query").alias("low")).distinct()
    lengths = [r[0] for r in asked.select(F.length("low").alias("n")).distinct().orderBy("n").collect()]
    named = symbols.where("name IS NOT NULL").select("generation_id", "id", "name", "qualified_name", "path", "line_start").distinct()
    held = F.array_distinct(F.concat(pieces_of(F.lower("name"), lengths), pieces_of(F.lower("qualified_name"), lengths)))
    met = named.withColumn("low", F.explode(held)).join(asked, "low")
    tier = F.when(F.col("name") == F.col("query"), 0).when(F.col("qualified_name") == F.col("query"), 1).when(F.lower("name") == F.col("low"), 2).otherwise(3)
    order = Window.partitionBy("query_id").orderBy(tier, F.length("qualified_name"), "path", "line_start", "generation_id", "id")
    return met.withColumn("tier", tier).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("query_id", "generation_id", "id", "name", "tier", "position")


def resolve_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: exact with its symbol if one id has that id, qualified name or name; ambiguous if several; else none."""
    keys = symbols.select("generation_id", "id", F.explode(F.array_distinct(F.array("id", "qualified_name", "name"))).alias("query")).where("query IS NOT NULL").distinct()
    one = keys.groupBy("query").agg(F.count_distinct("generation_id", "id").alias("n"), F.min("id").alias("id"))
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return queries.select("query_id", "query").distinct().join(one, "query", "left").select("query_id", state.alias("state"), F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).alias("candidates"))


def first_layer(hits: DataFrame, tier: Column) -> DataFrame:
    """Of each query only the hits of its best layer that has any (a ladder of fallbacks)."""
    ranked = hits.withColumn("tier", tier)
    best = ranked.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return ranked.join(best, ["query_id", "tier"])


def variant_fusion(hits: DataFrame, variant: str, key: list[str]) -> DataFrame:
    """Reciprocal ranks over the variants of each query, and which variant gave which rank.

    ``hits``: query_id, the variant, the key, score. A key counts once a variant, by its best score.
    """
    once = hits.groupBy("query_id", variant, *key).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", variant).orderBy(F.desc_nulls_last("score"), *key))
    ranked = once.withColumn("rank", place)
    given = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(variant).alias("v"), "rank"))), lambda x: F.concat(x["v"], F.lit(":"), x["rank"].cast("string"))), ",")
    return ranked.groupBy("query_id", *key).agg(F.round(F.sum(1 / (FUSION_CONSTANT + F.col("rank"))), 9).alias("score"), F.count("*").cast("int").alias("variants"), given.alias("contributions"))


def payload_score(score: Column, query: Column, text: Column) -> Column:
    """A vector hit's score and a fifth of the query's terms that its text holds."""
    return F.coalesce(score, F.lit(0.0)) + 0.2 * overlap(query, text)


def graph_evidence(edges: DataFrame, texts: DataFrame, intent: str) -> DataFrame:
    """Relations as evidence in words, with their score; an intent keeps its own relations.

    ``edges``: doc_id, pos, to (null: the document), relation, weight. ``texts``: doc_id, pos, sentence, title.
    """
    asked = ASKED_RELATIONS.get(intent)
    kept = edges.where(F.col("relation").isin(*asked)) if asked else edges
    source = texts.select("doc_id", "pos", F.col("sentence").alias("said"), "title")
    target = texts.select("doc_id", F.col("pos").alias("to"), F.col("sentence").alias("other"))
    verb = F.col("relation")
    for name, words in VERBS.items():
        verb = F.when(F.col("relation") == name, words).otherwise(verb)
    end = F.when(F.col("to").isNull(), F.concat(F.lit("Documento '"), F.coalesce("title", F.lit("")), F.lit("'"))).otherwise(F.concat(F.lit("'"), F.coalesce("other", F.lit("")), F.lit("'")))
    joined = kept.join(source, ["doc_id", "pos"]).join(target, ["doc_id", "to"], "left")
    text = F.concat(F.lit("Relación: la afirmación '"), "said", F.lit("' "), verb, F.lit(" "), end, F.lit("."))
    return joined.select("doc_id", "pos", "to", "relation", text.alias("snippet"), F.greatest(F.lit(0.1), F.col("weight") * 0.8).alias("score"))


def claim_next(jobs: DataFrame, queue: str, order: list[Column], state: str = "state") -> DataFrame:
    """The oldest waiting job of each queue, as running: the rows that a compare-and-set would write."""
    waiting = jobs.where(F.col(state) == "PENDING")
    return first_per(waiting, [queue], order).withColumn(state, F.lit("RUNNING"))


def scoped_union(rows: DataFrame, key: list[str], scopes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows that lie in any of several scopes, each a table and the columns it is joined on."""
    out = None
    for scope, columns in scopes:
        part = rows.join(scope.select(*columns).distinct(), columns, "left_semi")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(key)


def clean_layers(gone: DataFrame, layers: dict[str, DataFrame], column: str) -> DataFrame:
    """Per layer: rows, and rows that are left when those derived from ``gone`` are dropped."""
    out = None
    for name, layer in layers.items():
        left = layer.join(gone.select(column).distinct(), column, "left_anti").agg(F.count("*").alias("left"))
        part = layer.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(left)).select(F.lit(name).alias("layer"), "rows", "left")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def verified_excerpts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of each chunk from its file, unless the file's text is not the one that was hashed.

    ``chunks``: id, generation_id, path, line_start, line_end. ``files``: generation_id, path, digest, text.
    """
    rows = chunks.join(files, ["generation_id", "path"], "left")
    fresh = F.coalesce(F.sha2("text", 256) == F.col("digest"), F.lit(False))
    first = F.greatest(F.lit(1), F.col("line_start"))
    last = F.greatest(first, F.col("line_end"))
    lines = F.array_join(F.slice(F.split("text", "\n"), first, last - first + 1), "\n")
    return rows.select("id", "generation_id", "path", (~fresh).alias("stale"), F.when(fresh, lines).otherwise("").alias("excerpt"))


def code_upsert(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What becomes of each incoming key: accepted, or rejected for standing twice in the batch or in the store."""
    many = incoming.groupBy(key).agg(F.count("*").alias("n"))
    known = store.select(key, F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("n") > 1, "twice_in_batch").when(F.col("known"), "in_store").otherwise("accepted")
    return many.join(known, key, "left").select(key, reason.alias("outcome"))


def compact_snippet(snippet: Column, most: int = 220) -> Column:
    """A snippet in one line without envelope fields, cut at a word with dots."""
    even = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"(?U)\s+", " "))
    fields = "|".join(f.replace(" ", r"\s*") for f in ENVELOPE_FIELDS)
    bare = F.regexp_replace(even, rf"(?i)(?:^|[;|])\s*(?:{fields})\s*:\s*[^;|]+", " ")
    clean = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .;\-]+|[ .;\-]+$", "")
    head = F.substring(clean, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.trim(cut), F.lit("...")))


def corpus_language(detected: Column, profile: Column) -> Column:
    """The language that a collection's profile fixes, else the detected one."""
    plain = F.lower(F.trim(F.coalesce(profile, F.lit(""))))
    return F.when(~plain.isin("", "auto"), F.split_part(plain, F.lit("-"), F.lit(1))).otherwise(detected)


def citable(candidate: Column, document: Column, source_type: Column, span: Column, page_anchor: Column) -> Column:
    """Whether an item can be cited: a candidate with a document and a place in its text or on a page; graph edges cannot."""
    return F.coalesce(candidate & (F.coalesce(document, F.lit("")) != "") & (source_type != "graph_edge") & (span.isNotNull() | page_anchor), F.lit(False))


def final_text(text: Column, language: Column) -> Column:
    """An answer's text as it is shown; an empty one becomes the language's excuse."""
    spanish = F.startswith(F.lower(language), F.lit("es"))
    none_es, none_en = "No pude producir una respuesta fundamentada con la evidencia disponible.", "I could not produce a grounded answer."
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    low = F.regexp_replace(F.lower(plain), r"\.$", "")
    said = (
        F.when(low == "i could not find grounded evidence for this query", "No encontre evidencia suficiente para esta consulta.")
        .when(low == "i could not produce a grounded answer", none_es)
        .otherwise(F.regexp_replace(plain, r"(?i)^the evidence supports\s*:\s*", "Evidencia principal: "))
    )
    return F.when(plain == "", F.when(spanish, none_es).otherwise(none_en)).when(spanish, said).otherwise(plain)


def strict_violations(answers: DataFrame, least: float) -> DataFrame:
    """The first strict rule that each answer breaks (columns query_id, answer, citations, unresolved, grounding)."""
    code = (
        F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "EMPTY_ANSWER").when(F.col("citations") == 0, "MISSING_CITATIONS").when(F.col("unresolved") > 0, "UNRESOLVED_CITATION_BINDING").when(F.col("grounding") < least, "LOW_GROUNDING_SCORE")
    )
    return answers.select("query_id", code.alias("code"))


def unchanged(before: DataFrame, after: DataFrame) -> None:
    """Raise if the active generation of any repository moved while a reader was at work."""
    a, b = before.select("repository_id", "generation_id"), after.select("repository_id", "generation_id")
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise RuntimeError("the active generation changed during the query")
