"""Personal data: exact base patterns, and further spans by boosted trees over candidates.

Base spans (email, ip, card, phone) are the leftmost, non-overlapping matches of fixed
patterns that pass a check.  Beside them, high-recall generators propose overlapping
candidate spans; gradient-boosted trees judge each from its format and its context, and
those at or over a threshold calibrated on held-out candidates are added where they do not
touch a span already there.  The trees are fitted on the driver on the candidates of a
bounded sample of texts: whole base spans, and phones without their prefix, are the positive
examples, so that the form of a number is learned apart from its prefix; other parts of base
spans and candidates that touch none are the negative ones.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import hash_sample, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16_384
#: Share of accepted held-out candidates that must be right; the threshold is the lowest that gives it.
PRECISION = 0.995
ROUNDS, RATE, DEPTH = 24, 0.3, 3

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The candidate generators.
#: Digits of a number of any kind.
FEWEST, MOST = 7, 19
DIGITS = re.compile("[0-9]+")
DIGIT_RUN = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
SPELLED_AT = (
    re.compile(r" at (?=[A-Za-z0-9-]+(?:\.| dot )[A-Za-z0-9])"),
    re.compile(r"[\[({](?:at|AT)[\])}]\x20?(?=[A-Za-z0-9-]+(?:\.|\x20?[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9])"),
)
SPELLED_LOCAL = re.compile(r"([A-Za-z0-9._%+-]{1,64})\x20?$")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?| dot )[A-Za-z0-9-]{2,63})+", re.IGNORECASE)
ANY_DIGIT = re.compile("[0-9]")
#: How base emails are written out to become examples of spelled-out ones: for the @, for a dot of the domain.
SPELLED_FORMS = ((" at ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."))
CONTEXT = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "account"), "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """From each @ outwards, which finds the same spans as a search from the left in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    out = emails(text)
    if not ANY_DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans between group boundaries of a run of digits, with FEWEST to MOST digits; at most MOST for each start."""
    groups = [(g.start() - (g.start() > start and text[g.start() - 1] == "("), *g.span()) for g in DIGITS.finditer(text, start, end)]
    for i, (left, _, _) in enumerate(groups):
        count = 0
        for _, s, e in groups[i:i + MOST]:
            count += e - s
            if count > MOST:
                break
            if count >= FEWEST:
                yield left, e


def candidates(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be personal data: parts of runs of digits between group boundaries, and spelled-out addresses."""
    out = set()
    for m in DIGIT_RUN.finditer(text) if ANY_DIGIT.search(text) else ():
        out.update(numbers(text, *m.span()))
    for pattern in SPELLED_AT:
        for m in pattern.finditer(text):
            before, after = SPELLED_LOCAL.search(text[max(0, m.start() - 65):m.start()]), SPELLED_DOMAIN.match(text, m.end())
            if before and after:
                out.add((m.start() - len(before[0]), after.end()))
    return sorted(out)


NAMES = ("digits", "length", "letters", "spaces", "dashes", "dots", "brackets", "slashes", "groups", "longest", "last", "luhn",
         "card_length", "spelled", "before", "after", "bracket_first", *(f"near_{k}" for k in KINDS))


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, in the order of NAMES."""
    own = text[start:end]
    digits = digits_of(own)
    groups = re.findall(r"[0-9]+", own)
    kind = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0 if c in ".,;:!?)" else 4.0
    near = text[max(0, start - 24):start].lower()
    return [
        len(digits), len(own), sum(c.isalpha() for c in own), own.count(" "), own.count("-"), own.count("."), sum(c in "([{" for c in own), own.count("/"),
        len(groups), max(map(len, groups), default=0), len(groups[-1]) if groups else 0, float(len(digits) > 1 and luhn(digits)),
        float(13 <= len(digits) <= 19), float("at" in own.lower() and not digits == own), kind(text[start - 1:start]) if start else 0.0,
        kind(text[end:end + 1]), float(own.startswith("(")), *(float(any(w in near for w in CONTEXT[k])) for k in KINDS),
    ]


@dataclass
class Trees:
    """One boosted model: trees as nested (feature, cut, below, above) or a leaf value."""

    prior: float
    trees: list
    threshold: float = 2.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            out += RATE * leaf_values(tree, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def leaf_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, below, above = tree
    left = x[:, feature] <= cut
    out = np.empty(len(x))
    out[left], out[~left] = leaf_values(below, x[left]), leaf_values(above, x[~left])
    return out


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on the gradients, by the usual second-order gain."""
    gain = lambda g, h: g * g / (h + 1.0)
    leaf = float(slope.sum() / (curve.sum() + 1.0))
    best = (1e-6, None)
    if depth and len(x) >= 8:
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))):
                left = x[:, f] <= cut
                if 3 <= left.sum() <= len(x) - 3:
                    g, h = slope[left].sum(), curve[left].sum()
                    won = gain(g, h) + gain(slope.sum() - g, curve.sum() - h) - gain(slope.sum(), curve.sum())
                    if won > best[0]:
                        best = (won, (f, float(cut), left))
    if best[1] is None:
        return leaf
    f, cut, left = best[1]
    return f, cut, grow(x[left], slope[left], curve[left], depth - 1), grow(x[~left], slope[~left], curve[~left], depth - 1)


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [])
    raw = np.full(len(x), model.prior)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(x, y - p, p * (1 - p), DEPTH)
        model.trees.append(tree)
        raw += RATE * leaf_values(tree, x)
    return model


def touching(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps one of ``spans``."""
    ends: list[int] = []
    starts: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return lambda start, end: (k := bisect_left(starts, end)) > 0 and ends[k - 1] > start


def passes_alone(text: str, start: int, end: int) -> bool:
    """Whether a part of a run of digits is a card or a phone by the base checks when it stands alone."""
    digits = digits_of(own := text[start:end])
    if 13 <= len(digits) <= 19 and CARD.fullmatch(own) and luhn(digits):
        return True
    return 9 <= len(digits) <= 15 and text[start - 1:start] == "+" and bool(PHONE.fullmatch(text, start - 1, end))


def examples(texts: list[str]) -> list[tuple[list[float], str | None]]:
    """(features, kind of the base span that the candidate is, or None).

    A phone may lack its prefix.  What touches a number that passes a base check only when
    cut out of a longer run, or an address, is no example of either.
    """
    out = []
    for text in texts:
        base, found = base_spans(text), candidates(text)
        whole = {(s, e): k for k, s, e in reversed(base)}
        phones = {e: s for k, s, e in base if k == "phone"}
        in_base, in_email = touching([(s, e) for _, s, e in base]), touching([(s, e) for k, s, e in base if k == "email"])
        unsure = touching([c for c in found if not in_base(*c) and passes_alone(text, *c)])
        for start, end in found:
            if in_email(start, end) or unsure(start, end):
                continue
            kind = whole.get((start, end)) or ("phone" if phones.get(end, start + 1) <= start else None)
            out.append((features(text, start, end), kind))
        out += spelled_examples(text, base)
    return out


def spelled_examples(text: str, base: list[Span]) -> list[tuple[list[float], str | None]]:
    """Per base email, in its context: spelled out in one of the forms, and a word "at" its domain, which is none."""
    out = []
    for _, start, end in (s for s in base if s[0] == "email"):
        local, domain = text[start:end].rsplit("@", 1)
        before, after = text[max(0, start - 100):start], text[end:end + 40]
        at, dot = SPELLED_FORMS[zlib.crc32(text[start:end].encode("utf-8", "replace")) % len(SPELLED_FORMS)]
        for own, kind in ((local + at + domain.replace(".", dot), "email"), (f"at {domain}", None)):
            made = before + own + after
            for s, e in candidates(made):
                if e == len(before) + len(own) and (s == len(before) if kind else s < len(before)):
                    out.append((features(made, s, e), kind))
    return out


def fit(texts: list[str], least: int = 20) -> dict[str, Trees]:
    """A model per kind with at least ``least`` examples of it and of the rest, calibrated on every third example."""
    found = examples(texts)
    models = {}
    if not found:
        return models
    x = np.array([f for f, _ in found])
    held = np.arange(len(x)) % 3 == 0
    for kind in KINDS:
        y = np.array([k == kind for _, k in found], float)
        if y.sum() < least or (1 - y).sum() < least:
            continue
        model = boosted(x[~held], y[~held])
        scored, right = model.score(x[held]), y[held]
        order = np.argsort(-scored, kind="stable")
        cuts = scored[order]
        last = np.append(cuts[1:] < cuts[:-1], True)  # where a group of equal scores ends
        precise = last & (np.cumsum(right[order]) >= PRECISION * np.arange(1, len(cuts) + 1))
        if precise.any():
            model.threshold = max(0.5, float(cuts[precise].min()) - 1e-9)
        models[kind] = model
    return models


def added_spans(models: dict[str, Trees], text: str, base: list[Span]) -> list[Span]:
    """Candidates that a model accepts, the longest first so that no part of a number stays, where they touch nothing chosen before."""
    if not models:
        return []
    in_base = touching([(s, e) for _, s, e in base])
    found = [c for c in candidates(text) if not in_base(*c)]
    if not found:
        return []
    x = np.array([features(text, *c) for c in found])
    offers = sorted(
        (start - end, -float(s), (start, end), kind)
        for kind, model in models.items() for s, (start, end) in zip(model.score(x), found, strict=True) if s >= model.threshold
    )
    out: list[tuple[int, int, str]] = []
    for _, _, (start, end), kind in offers:
        if kind == "phone" and text[start - 1:start] == "+" and not in_base(start - 1, end):
            start -= 1
        k = bisect_left(out, (end,))
        if not k or out[k - 1][1] <= start:
            insort(out, (start, end, kind))
    return [(kind, start, end) for start, end, kind in out]


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def trained(docs: DataFrame, rows: int = SAMPLE_ROWS, largest: int = SAMPLE_BYTES) -> dict[str, Trees]:
    """Models from about ``rows`` texts, with a digit run in them, of ``largest`` bytes at most, chosen by a hash."""
    text = text_or_empty()
    usable = docs.where((F.octet_length(text) <= largest) & text.rlike("[0-9]{3}")).select("doc_id", text.alias("text"))
    return fit(sorted(r["text"] for r in hash_sample(usable, rows, "doc_id", "text").collect()))


def spans(models: dict[str, Trees], text: Column) -> Column:
    """Struct of the base spans and of all spans, as strings."""

    @F.pandas_udf("struct<base:string,spans:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts.fillna(""):
                base = base_spans(t)
                rows.append((joined(base), joined(base + added_spans(models, t, base))))
            yield pd.DataFrame(rows, columns=["base", "spans"])

    return run(text)


def found(docs: DataFrame) -> DataFrame:
    """Spans per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts and the
    hash are of the base spans.  Null counts as an empty text; an empty text has no spans;
    repeated rows give equal rows; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", spans(trained(docs), F.col("text")).alias("found"))
    count = lambda kind: F.regexp_count("found.base", F.lit(f"(^|,){kind}:")).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256"), F.col("found.spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans replaced in ``text``, and ``n_chars`` counted anew where there is such a column; null stays null."""
    models = trained(docs)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts.fillna(""):
                base = base_spans(t)
                out.append(redact(t, base + added_spans(models, t, base)))
            yield pd.Series(out)

    docs = docs.withColumn("text", F.when(F.col("text").isNotNull(), run("text")))
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
