"""Query features, routes and intents as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import TOKEN

#: Cues of the router, by feature. Single words match tokens, phrases match with word borders.
CUES = {
    "exact": ("id", "uuid", "code", "codigo", "fecha", "date", "reference"),
    "comparison": ("vs", "versus", "compare", "comparison", "difference", "diferencia", "mejor"),
    "contradiction": ("but", "however", "although", "sin embargo", "contradict", "contradicts", "contradicted", "contradiction", "contradictions", "contradictory", "contradice", "contradiccion", "contradicción", "contradicciones", "contra", "conflict"),
    "argument": ("analiza", "analice", "argumento", "argumentos", "conclusion", "conclusión", "critica", "critique", "evalua", "evalúa", "evaluate", "implica", "infiere", "infer", "objecion", "objeción", "premisa", "por eso", "por lo tanto", "razona", "tiene razon", "tiene razón"),
    "stance": ("afirma", "argumenta", "considera", "defiende", "dice que", "dicen que", "opinion", "opinión", "plantea", "postura", "que decia", "que dice", "qué decía", "qué dice", "segun", "según", "sostiene", "tesis"),
    "global": ("overall", "summary", "resumen", "global", "general", "corpus", "vision", "panorama"),
    "visual": ("table", "tabla", "figure", "figura", "chart", "layout", "page", "pagina", "diagram", "scan"),
}
SPANISH = ("a", "al", "de", "del", "el", "ella", "en", "es", "esta", "este", "la", "las", "lo", "los", "para", "por", "se", "sin", "son", "un", "una", "y", "que", "como", "con", "cual", "donde", "explica", "resume", "analiza", "compara", "porque", "cita", "citas", "documento", "documentos", "respuesta", "evidencia", "evidencias", "idioma", "pagina", "sobre")
ENGLISH = ("a", "an", "are", "for", "in", "is", "of", "the", "to", "with", "without", "what", "why", "how", "which", "where", "explain", "summarize", "summarise", "analyze", "analyse", "compare", "because", "citation", "citations", "document", "documents", "answer", "evidence", "language", "page")
SPANISH_ENDINGS = r"(ción|ciones|mente|idad|ario|aria)$"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(TOKEN), F.lit(0))


def has_cue(text: Column, feature: str) -> Column:
    single = [c for c in CUES[feature] if " " not in c]
    phrases = [c for c in CUES[feature] if " " in c]
    out = F.arrays_overlap(words_of(text), F.array(*map(F.lit, single)))
    if phrases:
        out |= normalised(text).rlike(r"(?<![\p{L}\p{N}_])(" + "|".join(map(re.escape, phrases)) + r")(?![\p{L}\p{N}_])")
    return out


def features(text: Column) -> dict[str, Column]:
    """Eight boolean features of a query."""
    out = {name: has_cue(text, name) for name in CUES}
    out["exact"] |= F.exists(words_of(text), lambda w: (F.length(w) >= 8) & w.rlike(r"\d"))
    low = normalised(text)
    out["clauses"] = low.contains(" and ") | low.contains(" y ") | low.contains(",") | low.contains(";")
    return out


def route(f: dict[str, Column]) -> Column:
    return (
        F.when(f["visual"], "visual").when(f["global"], "global").when(f["contradiction"] | f["argument"], "argumentative").when(f["stance"], "multi_hop")
        .when(f["exact"], "exact").when(f["comparison"] | f["clauses"], "multi_hop").otherwise("factual_local")
    )


def intent(f: dict[str, Column]) -> Column:
    return (
        F.when(f["visual"], "visual").when(f["global"], "global").when(f["contradiction"] | f["argument"] | f["stance"], "argumentative")
        .when(f["comparison"], "comparative").when(f["exact"], "exact").otherwise("factual")
    )


def question_language(text: Column) -> Column:
    """Spanish or English by marker words; Spanish where nothing speaks for either."""
    low, words = F.lower(text), F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    hits = lambda markers: F.size(F.filter(words, lambda w: w.isin(*markers)))
    spanish = hits(SPANISH) + F.exists(words, lambda w: w.rlike(SPANISH_ENDINGS)).cast("int")
    return F.when(low.rlike("[áéíóúñ¿¡]"), "es").when(spanish >= hits(ENGLISH), "es").otherwise("en")
