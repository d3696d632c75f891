"""Query-side rules: validation, complexity, strategy, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, contains_any, trim_ws, word_count

# Patterns, keywords and limits.
ARTICLE_MENTION = r"(?:art(?:ículo)?\.?\s*)?(\d+(?:\.\d+)+|\d+)"
COMPARISON = ["diferencia", "diferencias", "comparar", "comparación", "versus", "vs", "entre", "mientras", "a diferencia"]
COMPOUND = ["y", "además", "también", "asimismo", "igualmente", "por otro lado", "adicionalmente"]
MIN_QUERY, MAX_QUERY = 3, 4000
MIN_ITERATIONS, MAX_ITERATIONS = 1, 4
SEMANTIC_TOP_K, HYBRID_TOP_K = 20, 15
LONG_QUERY_WORDS = 20


def clamp(k: Column | str, limit: int) -> Column:
    """``k`` moved into 1…limit."""
    return F.greatest(F.lit(1), F.least(col(k), F.lit(limit)))


def reject_reason(text: Column | str, max_iterations: Column | str) -> Column:
    """Why a query row is refused; null when it is fine."""
    size = F.length(trim_ws(text))
    return (
        F.when(col(text).isNull() | (size == 0), "blank")
        .when(size < MIN_QUERY, "too short")
        .when(size > MAX_QUERY, "too long")
        .when(~col(max_iterations).between(MIN_ITERATIONS, MAX_ITERATIONS), "max_iterations out of range")
    )


def article_mentions(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"(?iuU){ARTICLE_MENTION}"), F.lit(1))


def distinct_articles(text: Column | str, limit: int = 5) -> Column:
    """Mentioned article numbers, in order, each once, at most ``limit``; lone digits dropped."""
    numbers = F.filter(article_mentions(text), lambda m: m.contains(".") | (F.length(m) >= 2))
    return F.slice(F.array_distinct(numbers), 1, limit)


def assess_complexity(text: Column | str) -> Column:
    """simple, compound or complex.  Keywords match as substrings."""
    lower = F.lower(col(text))
    n_words = word_count(text)
    n_articles = F.size(article_mentions(text))
    comparison = contains_any(lower, COMPARISON)
    compound = contains_any(lower, COMPOUND)
    return (
        F.when((n_words <= 15) & (n_articles <= 1) & ~comparison, "simple")
        .when(comparison | (n_articles >= 2) | (compound & (n_words > 20)), "compound")
        .when(n_words > 30, "complex")
        .otherwise("simple")
    )


def select_strategy(text: Column | str) -> Column:
    """hybrid for queries that name a dotted number or are short; full from 20 words."""
    dotted = col(text).rlike(r"(?U)\d+\.\d+")
    return F.when(~dotted & (word_count(text) >= LONG_QUERY_WORDS), "full").otherwise("hybrid")


def variant_set(query: Column | str, rewritten: Column | str, broader: Column | str) -> Column:
    """The query, its rewrite and its step-back, without repeats, order kept."""
    given = F.filter(F.array(col(query), col(rewritten), col(broader)), lambda v: v.isNotNull())
    return F.array_distinct(given)
