"""Text cleaning: ordered regex rules folded into one column expression.

``(?d)`` limits line ends to ``\\n`` and ``(?U)`` makes ``\\w \\s \\d`` Unicode, so
the patterns mean in Java what they mean in Python.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, trim_ws


class Rule(NamedTuple):
    """One cleaning step; users may add their own."""

    name: str
    pattern: str
    replacement: str = ""
    enabled: bool = True


# Rule names, patterns and replacements.
LINE_ENDINGS = Rule("normalize_line_endings", r"\r\n?", "\n")
BLANK_LINES = Rule("collapse_blank_lines", r"\n{3,}", "\n\n")
TRAILING_SPACE = Rule("strip_trailing_ws", r"(?md)[ \t]+$", "")
BROKEN_WORDS = Rule("join_broken_words", r"(?U)(\w)-\n(\w)", "$1$2")
SPACES = Rule("normalize_spaces", r" {2,}", " ")
CONTROL_CHARS = Rule("remove_control_chars", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
PAGE_NUMBERS = Rule("remove_page_numbers", r"(?mdU)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$", "")
REPEATED_HEADERS = Rule("remove_repeated_headers", r"(?md)^(.{10,}?)\n\1$", "$1")
CODE_BLOCKS = Rule("normalize_code_blocks", r"\n```[a-z]*\n", "\n```")
HEADING_SPACING = Rule("normalize_heading_spacing", r"(?U)\n(#{1,6})\s+", "\n$1 ")
OCR_SYMBOLS = Rule("remove_ocr_artifacts", r"[|¡£¢§¦¨©ª«¬­®¯°±²³´µ¶·¸¹º»¼½¾¿]", "")
OCR_L = Rule("fix_ocr_l_to_1", r"(?U)(?<!\w)l(?!\w)", "1")
REPEATED_LETTERS = Rule("squeeze_repeated_letters", r"([a-zA-Z])\1{4,}", "$1")
LOWERCASE_LINES = Rule("join_lowercase_lines", r"(?U)\n\s*([a-z])", " $1")
CLAUSE_SPACING = Rule(
    "normalize_clause_spacing", r"(?iuU)(CL[AÁ]USULA|PAR[AÁ]GRAFO|ANEXO)\s*([\d\w]+)", "$1 $2"
)

UNIVERSAL = [LINE_ENDINGS, BLANK_LINES, TRAILING_SPACE, BROKEN_WORDS, SPACES, CONTROL_CHARS]
PROFILES: dict[str, list[Rule]] = {
    "default": [PAGE_NUMBERS, REPEATED_HEADERS],
    "technical": [PAGE_NUMBERS, CODE_BLOCKS, HEADING_SPACING],
    "ocr_output": [OCR_SYMBOLS, OCR_L, PAGE_NUMBERS, REPEATED_LETTERS, LOWERCASE_LINES],
    "contract": [PAGE_NUMBERS, REPEATED_HEADERS, CLAUSE_SPACING],
}


def apply_rule(c: Column | str, rule: Rule) -> Column:
    return F.regexp_replace(col(c), rule.pattern, rule.replacement) if rule.enabled else col(c)


def apply_rules(c: Column | str, rules: list[Rule]) -> Column:
    return reduce(apply_rule, rules, col(c))


def clean(
    text: Column | str,
    profile: Column | str = "default",
    extra: dict[str, list[Rule]] | None = None,
) -> Column:
    """Universal rules, then the rules of the row's profile, then strip.

    ``profile`` is a name or a Column; an unknown name gets the universal rules
    only.  ``extra`` adds or replaces profiles.
    """
    profiles = {**PROFILES, **(extra or {})}
    base = apply_rules(text, UNIVERSAL)
    if isinstance(profile, str):
        return trim_ws(apply_rules(base, profiles.get(profile, [])))
    cleaned = None
    for name, rules in profiles.items():
        branch = apply_rules(base, rules)
        cleaned = F.when(profile == name, branch) if cleaned is None else cleaned.when(profile == name, branch)
    return trim_ws(cleaned.otherwise(base))
