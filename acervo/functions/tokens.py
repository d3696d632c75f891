"""Word tokens for keyword search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col

# Token patterns and the Spanish stop words.
TOKEN_PATTERN = r"(?U)\b[a-záéíóúüñA-ZÁÉÍÓÚÜÑ0-9\.]+\b"
PLAIN_TOKEN_PATTERN = r"[a-záéíóúüñ0-9](?:[a-záéíóúüñ0-9.]*[a-záéíóúüñ0-9])?"  # no \b, for other engines
STOPWORDS = """
a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante
e el ella ellas ellos en entre era es esa esas ese eso esos esta estas este esto estos
fue hay la las le les lo los más me mi mismo muy ni no nos o otra otras otro otros
para pero por que sea ser si sin sobre son su sus también tanto te tiene tienen todo todos
una unas uno unos ya y yo
""".split()


def raw_tokens(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(pattern), F.lit(0))


def is_term(token: Column) -> Column:
    """Longer than one character and not a stop word."""
    return (F.length(token) > 1) & ~token.isin(STOPWORDS)


def tokenize(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """array<string> of terms in order, repeats kept."""
    return F.filter(raw_tokens(text, pattern), is_term)


def normalizer(fn: Callable[[list[str]], list[str]]):
    """Wrap a token normaliser (a lemmatiser, say) as an Arrow function on token arrays."""

    @F.pandas_udf("array<string>")
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in batches:
            yield tokens.map(lambda row: None if row is None else list(fn(list(row))))

    return normalize
