"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and each clause is read by five small transducers that run side
by side over its words: insult, threat, target, negation and reported speech.  What the
clause scores depends on which of them have accepted, not on isolated words: an insult
with a target in reach weighs more, a negated or reported one less, and a threat counts
only when a verb of harm meets a target.  Weights of insults start from a word list and
are learned, with further words, from the labels; clause scores of a text become a
probability by a logistic fit on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import in_fold
from acervo.llm.quality import sample

SAMPLE_ROWS, SAMPLE_BYTES = 6000, 16_384
THRESHOLD = 0.3
STEM = 6

# The classes of words that the transducers read.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic clown clowns fool fools imbecile "
    "jerk bastard bitch asshole creep pig filth vermin disgusting retard psycho coward liar ugly useless "
    "idiota estúpido estúpida imbécil basura inútil idiote imbécile stupide ordure connard salaud "
    "dumm dummkopf trottel abschaum wertlos dreck arschloch"
).split()
THREATS = (
    "kill hurt destroy beat punch stab shoot burn hang crush smash murder slaughter die "
    "matar golpear tuer frapper töten umbringen schlagen"
).split()
TARGETS = (
    "you your yours yourself u ur he him his she her they them their these those people everyone someone "
    "tú usted ustedes te ti tu toi vous votre du dich dir euch sie ihr"
).split()
NEGATIONS = "not no never neither nor none without isn't aren't wasn't don't doesn't didn't nunca ne pas jamais nicht kein keine nie".split()
REPORTS = (
    "said says say wrote writes called calls claimed claims quoted quotes reported reportedly according told alleged "
    "dijo dice a-dit déclare sagte sagt schrieb"
).split()
INTENSIFIERS = "very such so really total totally complete completely utter utterly absolute absolutely fucking damn".split()
#: How many words a target, a negation or a report reaches.
TARGET_REACH, NEGATION_REACH, REPORT_REACH = 6, 3, 12

SENTENCE = re.compile(r"[.!?;\n]+")
WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


@dataclass
class Grammar:
    """Word classes with weights, and the logistic fit over the clause scores of a text."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 2.0))
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 2.0))
    #: First STEM bytes of inflected and compound insults.
    stems: dict[bytes, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-2.5, 0.8, 0.5, 0.3, 0.0)

    def insult(self, word: str) -> float:
        return self.insults.get(word) or self.stems.get(word.encode("utf-8", "replace")[:STEM], 0.0)

    def triggers(self) -> tuple[frozenset[str], frozenset[bytes]]:
        """Words, and stems as bytes, of which a text needs one for its clauses to be read."""
        return frozenset((*self.insults, *self.threats)), frozenset(self.stems)


def matched_clauses(grammar: Grammar, text: str) -> list[tuple[str, float]]:
    """(clause, weight) of every clause that the grammar accepts."""
    out = []
    for clause in SENTENCE.split(text.lower()):
        words = WORDS.findall(clause)
        if words and (weight := clause_weight(grammar, words)) > 0:
            out.append((clause.strip(), weight))
    return out


def clause_weight(grammar: Grammar, words: list[str]) -> float:
    """Output of the composed transducers: each keeps the distance since it last accepted."""
    far = 1 << 30
    target = negation = report = strong = far
    insults: list[list[float]] = []
    threats: list[list[float]] = []
    total = 0.0
    for at, word in enumerate(words):
        target, negation, report, strong = target + 1, negation + 1, report + 1, strong + 1
        if word in NEGATION_SET:
            negation = 0
        if word in REPORT_SET:
            report = 0
        if word in INTENSIFIER_SET:
            strong = 0
        damp = (0.35 if negation <= NEGATION_REACH else 1.0) * (0.5 if report <= REPORT_REACH else 1.0)
        if insult := grammar.insult(word):
            near = target <= TARGET_REACH
            weight = insult * damp * (1.2 if strong <= 2 else 1.0)
            total += weight * (1.3 if near else 1.0)
            if not near:
                insults.append([at, weight])
        if word in grammar.threats:
            if target <= TARGET_REACH:
                total += grammar.threats[word] * damp
            else:
                threats.append([at, grammar.threats[word] * damp])
        if word in TARGET_SET:
            target = 0
            total += sum(0.3 * w for p, w in insults if at - p <= TARGET_REACH) + sum(w for p, w in threats if at - p <= TARGET_REACH)
            insults, threats = [], []
    return total


NEGATION_SET, REPORT_SET, INTENSIFIER_SET, TARGET_SET = map(frozenset, (NEGATIONS, REPORTS, INTENSIFIERS, TARGETS))


def summary(grammar: Grammar, triggers: tuple[frozenset[str], frozenset[bytes]], text: str) -> tuple[float, float, float, float]:
    """(log of the sum, maximum, log of the number, sum per hundred words) of the clause scores of a text."""
    words = WORDS.findall(text.lower())  # no word holds the end of a sentence, so these are the words of all clauses
    own = set(words)
    if triggers[0].isdisjoint(own) and triggers[1].isdisjoint([w.encode("utf-8", "replace")[:STEM] for w in own]):
        return 0.0, 0.0, 0.0, 0.0
    found = [w for _, w in matched_clauses(grammar, text)]
    return (math.log1p(sum(found)), max(found), math.log1p(len(found)), 100 * sum(found) / (len(words) + 50)) if found else (0.0, 0.0, 0.0, 0.0)


def probability(grammar: Grammar, triggers: tuple[frozenset[str], frozenset[bytes]], texts: list[str]) -> np.ndarray:
    x = np.array([summary(grammar, triggers, t) for t in texts]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(grammar.coefficients[0] + x @ np.array(grammar.coefficients[1:]), -30, 30)))


def learned(texts: list[str], wanted: list[int], least: int = 4, word_odds: float = 3.0, least_stem: int = 8, stem_odds: float = 2.0) -> Grammar:
    """Weights from labelled texts: smoothed log odds of having a word or a stem, by document.

    Listed words take their log odds where they occur.  A word joins them when ``least``
    toxic texts have it and its log odds reach ``word_odds``; a stem at ``least_stem`` and
    ``stem_odds``.
    """
    grammar = Grammar()
    n = [sum(wanted), len(wanted) - sum(wanted)]
    if not all(n):
        return grammar
    toxic, clean, toxic_stems, clean_stems = Counter(), Counter(), Counter(), Counter()
    for text, label in zip(texts, wanted, strict=True):
        words = set(WORDS.findall(text.lower()))
        (toxic if label else clean).update(words)
        (toxic_stems if label else clean_stems).update({w.encode("utf-8", "replace")[:STEM] for w in words})
    odds = lambda a, b: min(6.0, math.log((a + 0.5) / (n[0] + 1)) - math.log((b + 0.5) / (n[1] + 1)))
    for word in [*grammar.insults]:
        if toxic[word] + clean[word] >= 4:
            grammar.insults[word] = max(0.0, odds(toxic[word], clean[word]))
    for word, count in toxic.items():
        if count >= least and odds(count, clean[word]) >= word_odds and word not in grammar.threats:
            grammar.insults[word] = odds(count, clean[word])
    for stem, count in toxic_stems.items():
        if count >= least_stem and len(stem) == STEM and odds(count, clean_stems[stem]) >= stem_odds:
            grammar.stems[stem] = odds(count, clean_stems[stem])
    triggers = grammar.triggers()
    x = np.array([(1.0, *summary(grammar, triggers, t)) for t in texts])
    y, w = np.array(wanted, float), np.array(grammar.coefficients)
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(5)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * w * np.array([0, 1, 1, 1, 1]))
    grammar.coefficients = tuple(float(v) for v in w)
    return grammar


def score(grammar: Grammar, text: Column) -> Column:
    triggers = grammar.triggers()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(probability(grammar, triggers, texts.fillna("").tolist()))

    return run(text)


def toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no clauses and get the score of none; repeated rows score
    alike; without labels of both kinds the listed weights hold; an empty table gives an
    empty result.
    """
    grammar = learned(*sample(docs, labels, "toxic", 4, 2, rows, SAMPLE_BYTES))
    return (
        docs.select("doc_id", in_fold(4, 2).alias("held_out"), score(grammar, F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
