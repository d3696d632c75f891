"""Semantic routing: category centroids and the nearest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.vectors import cosine
from acervo.session import at_most

# Example questions per category, in order of precedence.
CATEGORY_EXAMPLES: dict[str, list[str]] = {
    "fact_query": [
        "¿Qué dice el artículo 5?",
        "¿Cuál es el contenido de la sección 3.2?",
        "¿Qué establece la cláusula primera?",
        "¿Qué es el sistema de gestión?",
    ],
    "obligation_query": [
        "¿Cuáles son las obligaciones del empleador?",
        "¿Qué requisitos debo cumplir?",
        "¿Qué debo hacer para implementar el sistema?",
        "¿Cuáles son los deberes del responsable?",
    ],
    "comparison_query": [
        "¿Cuál es la diferencia entre X e Y?",
        "¿En qué se diferencia el enfoque A del B?",
        "¿Qué es mejor, X o Y?",
        "¿Cuáles son las similitudes entre X e Y?",
    ],
    "procedure_query": [
        "¿Cuáles son los pasos para implementar?",
        "¿Cómo se realiza el proceso de evaluación?",
        "¿Cuál es el procedimiento para solicitar?",
        "¿Qué pasos debo seguir?",
    ],
    "consequence_query": [
        "¿Qué pasa si no cumplo?",
        "¿Cuáles son las sanciones por incumplimiento?",
        "¿Cuáles son las consecuencias de no implementar?",
        "¿Qué multa aplica?",
    ],
    "general_query": [
        "¿Puedes ayudarme con una consulta?",
        "Necesito información sobre el tema",
        "¿Me puedes explicar?",
        "¿Qué sabes sobre esto?",
    ],
}
FALLBACK = "general_query"
MAX_CATEGORIES = 1000


def centroids(examples: DataFrame, category: str = "category", vector: str = "embedding") -> DataFrame:
    """(category, centroid): mean vector.  Sums combine on the map side, so a hot category does not matter."""
    parts = examples.select(category, F.posexplode(vector).alias("_pos", "_x"))
    means = parts.groupBy(category, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    gathered = means.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_rows"))
    return gathered.select(category, F.transform("_rows", lambda r: r["_mean"]).alias("centroid"))


def semantic_route(queries: DataFrame, centers: DataFrame, *, category: str = "category", vector: str = "embedding",
                   order: str | None = None) -> DataFrame:
    """Queries with category, confidence and all_scores (four places).

    ``centers`` is a small table (at most ``MAX_CATEGORIES`` rows, checked) that
    becomes one array in a scalar subquery; ``order`` names its precedence column
    (the category itself by default).  Without centers: general_query, 0.
    """
    if not at_most(centers, MAX_CATEGORIES):
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    rank = F.col(order or category)
    listed = centers.agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("position"), F.col(category).alias("name"), "centroid"))).alias("c")
    ).scalar()
    similarity = F.transform(
        "_centers", lambda c, i: F.struct(cosine(F.col(vector), c["centroid"]).alias("score"), (-i).alias("nth"), c["name"].alias("name"))
    )
    scored = queries.withColumn("_centers", listed).withColumn("_scores", similarity)
    # scores are compared at 9 places so that equal ones go to the first category
    best = F.array_max(F.transform("_scores", lambda s: F.struct(F.round(s["score"], 9).alias("score"), s["nth"], s["name"])))
    routed = scored.withColumn("_best", best)
    ready = F.size("_scores") > 0
    return routed.select(
        *queries.columns,
        F.when(ready, F.col("_best.name")).otherwise(FALLBACK).alias("category"),
        F.when(ready, F.round("_best.score", 4)).otherwise(0.0).alias("confidence"),
        F.when(ready, F.map_from_entries(F.transform("_scores", lambda s: F.struct(s["name"], F.round(s["score"], 4)))))
        .otherwise(F.create_map(F.lit(FALLBACK), F.lit(0.0))).alias("all_scores"),
    )
