"""Readers for what a chat model writes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, trim_ws

BATCH_REPLY = "results array<struct<chunk_id:int, questions:array<string>>>"
PLAN_REPLY = "sub_queries array<string>, strategy string, expected_sources array<string>, complexity string"
PLACEHOLDER = "no especificada"


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    A lambda's body is evaluated for every element, and with it each expression that it names.
    """
    return F.get(F.transform(F.array(value), use), 0)


def outer_json(reply: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; the whole text when there is no such pair."""

    def cut(text: Column) -> Column:
        first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
        paired = (first > 0) & text.contains("}") & (first < last)
        return F.when(paired, F.substring(text, first, last - first + 1)).otherwise(text)

    return _held(trim_ws(reply), cut)


def parse_batch_json(reply: Column | str) -> Column:
    """map<chunk_id, questions>: blank questions removed; bad JSON gives an empty map."""
    results = F.coalesce(
        F.from_json(outer_json(reply), BATCH_REPLY)["results"],
        F.array().cast("array<struct<chunk_id:int, questions:array<string>>>"),
    )

    def entry(result: Column) -> Column:
        questions = F.coalesce(result["questions"], F.array().cast("array<string>"))
        return F.struct(result["chunk_id"].alias("key"), F.filter(F.transform(questions, trim_ws), lambda q: q != "").alias("value"))

    def entries(kept: Column) -> Column:
        # the last entry of a repeated chunk id wins: it ends the id's run in the sorted places
        places = F.sort_array(F.transform(kept, lambda r, i: F.struct(r["chunk_id"].alias("id"), i.alias("at"))))
        last = _held(places, lambda p: F.filter(
            p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1)["id"] != x["id"])))
        return F.transform(F.array_sort(F.transform(last, lambda x: x["at"])), lambda at: entry(F.get(kept, at)))

    return F.map_from_entries(_held(F.filter(results, lambda r: r["chunk_id"].isNotNull()), entries))


def strip_fence(reply: Column | str) -> Column:
    return trim_ws(F.regexp_replace(col(reply), r"```json\s?|```", ""))


def parse_fenced_json(reply: Column | str, schema: str = PLAN_REPLY) -> Column:
    """Struct from JSON that may stand in a code fence; bad JSON gives null fields."""
    return F.from_json(strip_fence(reply), schema)


def parse_list_lines(reply: Column | str, query: Column | str, limit: int = 4) -> Column:
    """One item per line, bullets and numbering removed; fewer than two items → [query]."""
    lines = F.filter(F.transform(F.split(trim_ws(reply), "\n"), trim_ws), lambda s: F.length(s) > 5)
    items = F.filter(
        F.transform(lines, lambda s: trim_ws(F.ltrim(s, F.lit("0123456789.-*• ")))), lambda s: s != ""
    )
    kept = F.slice(items, 1, limit)
    return F.when(F.size(kept) <= 1, F.array(col(query))).otherwise(kept)


def parse_key_points(reply: Column | str, limit: int = 5) -> Column:
    """Text of the lines that open with a bullet, at most ``limit``."""
    lines = F.filter(F.transform(F.split(col(reply), "\n"), trim_ws), lambda s: F.left(s, F.lit(1)).isin("-", "•", "*"))
    return F.slice(F.transform(lines, lambda s: F.ltrim(s, F.lit("-•* "))), 1, limit)


def parse_obligations(reply: Column | str) -> Column:
    """Bulleted ``key: value`` lines as structs; one default struct when there is none."""
    lines = F.filter(
        F.transform(F.split(col(reply), "\n"), trim_ws),
        lambda s: (s.startswith("-") | s.startswith("*")) & F.ltrim(s, F.lit("-* ")).contains(":"),
    )

    def obligation(line: Column) -> Column:
        body = F.ltrim(line, F.lit("-* "))
        key = F.lower(trim_ws(F.substring_index(body, ":", 1)))
        value = trim_ws(F.regexp_replace(body, r"(?s)^[^:]*:", ""))
        field = lambda word, default: F.when(key.contains(word), value).otherwise(default)
        return _obligation(3, field("sujeto", ""), field("obligacion", ""), field("plazo", ""), field("sancion", PLACEHOLDER))

    parsed = F.transform(lines, obligation)
    fallback = F.array(_obligation(0, F.lit(""), col(reply), F.lit(""), F.lit(PLACEHOLDER)))
    return F.when(F.size(parsed) > 0, parsed).otherwise(fallback)


def _obligation(level: int, subject: Column, duty: Column, term: Column, sanction: Column) -> Column:
    return F.struct(
        F.lit("N/A").alias("articulo"),
        F.lit(level).alias("nivel_criticidad"),
        subject.alias("sujeto_obligado"),
        duty.alias("obligacion"),
        term.alias("plazo"),
        sanction.alias("sancion"),
    )
