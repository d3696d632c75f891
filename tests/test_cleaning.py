import pytest
from pyspark.sql import functions as F

from acervo.functions import cleaning
from acervo.functions.cleaning import Rule, apply_rule, apply_rules, clean

PAIRS = [
    (cleaning.LINE_ENDINGS, "a\r\nb\rc", "a\nb\nc"),
    (cleaning.BLANK_LINES, "a\n\n\n\nb", "a\n\nb"),
    (cleaning.TRAILING_SPACE, "a  \t\nb ", "a\nb"),
    (cleaning.BROKEN_WORDS, "cami-\nón, a -\nb", "camión, a -\nb"),
    (cleaning.SPACES, "a   b  c", "a b c"),
    (cleaning.CONTROL_CHARS, "a\x00b\x7fc\td", "abc\td"),
    (cleaning.PAGE_NUMBERS, "uno\n- 12 -\ndos 3", "uno\n\ndos 3"),
    (cleaning.REPEATED_HEADERS, "Encabezado largo\nEncabezado largo\ntexto", "Encabezado largo\ntexto"),
    (cleaning.REPEATED_HEADERS, "corto\ncorto\ntexto", "corto\ncorto\ntexto"),
    (cleaning.CODE_BLOCKS, "x\n```python\ncode", "x\n```code"),
    (cleaning.HEADING_SPACING, "x\n##   Título", "x\n## Título"),
    (cleaning.OCR_SYMBOLS, "a|b¢c", "abc"),
    (cleaning.OCR_L, "l de l, al último l", "1 de 1, al último 1"),
    (cleaning.OCR_L, "él l", "él 1"),
    (cleaning.REPEATED_LETTERS, "aaaaab bbbb ccccccc", "ab bbbb c"),
    (cleaning.LOWERCASE_LINES, "línea\n  sigue\nOtra", "línea sigue\nOtra"),
    (cleaning.CLAUSE_SPACING, "CLÁUSULA12 y anexo   B", "CLÁUSULA 12 y anexo B"),
]


@pytest.mark.parametrize("rule,given,expected", PAIRS, ids=lambda v: v.name if isinstance(v, Rule) else None)
def test_rule(value, rule, given, expected):
    assert value(apply_rule("t", rule), t=given) == expected


def test_profiles_and_unknown_profile(value):
    text = "Hola  mundo\r\n\r\n\r\n\r\n- 7 -\r\nfin  "
    assert value(clean("t", "default"), t=text) == "Hola mundo\n\nfin"
    assert value(clean("t", "none such"), t=text) == "Hola mundo\n\n- 7 -\nfin"


def test_profile_per_row(spark):
    rows = spark.createDataFrame([("ocr_output", "a|b"), ("default", "a|b"), (None, " a|b ")], "p string, t string")
    assert [r[0] for r in rows.select(clean("t", F.col("p"))).collect()] == ["ab", "a|b", "a|b"]


def test_custom_rules_apply_in_order_and_can_be_disabled(value):
    rules = [Rule("one", "a", "b"), Rule("two", "b", "c"), Rule("off", "c", "d", enabled=False)]
    assert value(apply_rules("t", rules), t="ab") == "cc"
