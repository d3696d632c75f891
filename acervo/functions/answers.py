"""Answer-side rules: grading routes, validation, reflection, cited sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, trim_ws

# Phrases, patterns, thresholds and messages.
GENERIC_PHRASES = [
    r"estos\s+principios\s+buscan",
    r"en\s+conclusi[oó]n[,\s]",
    r"en\s+resumen[,\s]",
    r"de\s+esta\s+manera\s+se\s+garantiza",
    r"esto\s+garantiza\s+que",
    r"es\s+fundamental\s+para",
    r"es\s+importante\s+destacar",
    r"cabe\s+resaltar\s+que",
    r"resulta\s+evidente\s+que",
]
NUMERAL = r"^\s*(\d+)\.\s+\S"
NOT_FOUND = "no encontré información relevante"
SOURCE_PATTERNS = {
    "article": r"[Aa]rt[íi]culo\s+([\d.]+[\w]*)",
    "section": r"[Ss]ecci[óo]n\s+([\d.]+[\w]*)",
    "chapter": r"[Cc]ap[íi]tulo\s+([\w\s]+?)(?:\n|$)",
}
MAX_RETRIES = 2
EMPTY_ANSWER = "No encontré información relevante en los documentos."
NO_DOCUMENTS = "No encontré documentos relevantes para responder tu consulta."
INCOMPLETE_NOTE = "\n\n⚠️ Nota: Esta respuesta puede estar incompleta."


def grade_quality(score: Column | str) -> Column:
    """correct above 0.7, ambiguous from 0.3, else incorrect."""
    return F.when(col(score) > 0.7, "correct").when(col(score) >= 0.3, "ambiguous").otherwise("incorrect")


def grade_route(quality: Column | str, retries: Column | str) -> Column:
    """struct(route, retries): generate when correct or out of retries, else search again."""
    done = (col(quality) == "correct") | (col(retries) >= MAX_RETRIES)
    return F.struct(
        F.when(done, "generation").otherwise("retrieval").alias("route"),
        (col(retries) + F.when(done, 0).otherwise(1)).cast("int").alias("retries"),
    )


def generation_mode(score: Column | str, n_docs: Column | str) -> Column:
    return (
        F.when(col(n_docs) == 0, "no_docs")
        .when(col(score) > 0.8, "direct")
        .when(col(score) >= 0.5, "rethinking")
        .otherwise("rethinking_low_confidence")
    )


def low_confidence_note(score: Column | str) -> Column:
    return F.concat(
        F.lit("\n\n⚠️ *Nota: Los documentos recuperados tienen relevancia limitada (score: "),
        F.format_string("%.2f", col(score)),
        F.lit("). Verifica la información con fuentes adicionales.*"),
    )


def max_numeral(text: Column | str) -> Column:
    """Largest number that opens a list line; null without one."""
    found = F.regexp_extract_all(col(text), F.lit(f"(?mdU){NUMERAL}"), F.lit(1))
    return F.array_max(F.transform(found, lambda n: n.cast("long")))


def generic_phrases(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit("(?iuU)" + "|".join(GENERIC_PHRASES)), F.lit(0))


def validate_answer(answer: Column | str, context: Column | str) -> Column:
    """struct(is_valid, violations, sanitized_answer, confidence) by rules alone."""
    text = F.coalesce(col(answer), F.lit(""))
    empty = trim_ws(text) == ""
    generic = F.slice(generic_phrases(text), 1, 3)
    ours, theirs = max_numeral(text), max_numeral(context)
    quoted = F.transform(generic, lambda g: F.concat(F.lit("'"), g, F.lit("'")))
    violations = F.filter(
        F.array(
            F.when(F.size(generic) > 0, F.concat(
                F.lit("Conclusiones genéricas detectadas: ["), F.array_join(quoted, ", "), F.lit("]"))),
            F.when(ours > theirs + 2, F.concat(
                F.lit("Numerales inventados: respuesta tiene hasta "), ours.cast("string"),
                F.lit(", contexto solo hasta "), theirs.cast("string"))),
            F.when(F.lower(text).contains(NOT_FOUND) & (F.length(trim_ws(text)) > len(NOT_FOUND) + 20),
                   "Respuesta mixta: declara no encontrar pero agrega información"),
        ),
        lambda v: v.isNotNull(),
    )
    return F.when(
        empty,
        F.struct(
            F.lit(False).alias("is_valid"),
            F.array(F.lit("Respuesta vacía")).alias("violations"),
            F.lit(EMPTY_ANSWER).alias("sanitized_answer"),
            F.lit(1.0).alias("confidence"),
        ),
    ).otherwise(
        F.element_at(
            F.transform(
                F.array(violations),
                lambda v: F.struct(
                    (F.size(v) == 0).alias("is_valid"),
                    v.alias("violations"),
                    text.alias("sanitized_answer"),
                    F.when(F.size(v) == 0, 0.9).otherwise(0.4).alias("confidence"),
                ),
            ),
            1,
        )
    )


def reflect(verdict: Column, draft: Column | str, iteration: Column | str, max_iterations: Column | str) -> Column:
    """Final, retry, or final with a note; struct with the reflection fields."""
    valid = verdict["is_valid"]
    retry = ~valid & (col(iteration) < col(max_iterations))
    found = F.size(verdict["violations"]) > 0
    return F.struct(
        F.when(retry, "retrieval").otherwise("END").alias("route"),
        F.when(valid, col(draft)).when(~retry, F.concat(col(draft), F.lit(INCOMPLETE_NOTE))).alias("final_answer"),
        verdict["confidence"].alias("score"),
        valid.alias("is_grounded"),
        (retry & found).alias("has_hallucination"),
        valid.alias("cites_source"),
        F.when(valid, "Respuesta válida")
        .when(retry, F.coalesce(F.get(verdict["violations"], F.lit(0)), F.lit("Respuesta inválida")))
        .otherwise("Iteraciones agotadas")
        .alias("feedback"),
        (col(iteration) + 1).alias("iteration_count"),
    )


def extract_sources(answer: Column | str, documents: Column | None = None) -> Column:
    """array<struct(type, value, article, page)> of sections the answer names.

    Where it names none: the distinct sources of the first three ``documents``
    (array of structs with source, article_number, page).
    """
    def typed(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(col(answer), F.lit(f"(?dU){pattern}"), F.lit(1))
        return F.transform(found, lambda m: _source(F.lit(kind), trim_ws(m), F.lit(""), F.lit("")))

    named = F.array_distinct(F.concat(*[typed(k, p) for k, p in SOURCE_PATTERNS.items()]))
    if documents is None:
        return named
    first = F.filter(F.slice(documents, 1, 3), lambda d: F.coalesce(d["source"], F.lit("")) != "")
    firsts = F.filter(
        first, lambda d, i: F.array_position(F.transform(first, lambda e: e["source"]), d["source"]) == i + 1
    )
    listed = F.transform(
        firsts,
        lambda d: _source(
            F.lit("source"),
            d["source"],
            F.coalesce(d["article_number"], F.lit("")),
            F.coalesce(d["page"].cast("string"), F.lit("")),
        ),
    )
    return F.when(F.size(named) > 0, named).otherwise(listed)


def _source(kind: Column, value: Column, article: Column, page: Column) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), article.alias("article"), page.alias("page"))
