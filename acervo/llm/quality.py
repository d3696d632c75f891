"""Quality classifier: a small convolutional network over bytes, in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole document in steps of ``STRIDE``.
Their strongest answer in each of the overlapping chunks (two hops of ``HOP`` bytes) passes
a rectifier, beside one fixed channel, the share of four-byte runs that stood in the hop
before; the maximum and the mean over chunks are combined into one probability.
A filter is a byte embedding followed by a kernel, so at run time it is ``WIDTH`` table
look-ups per position.  The network is fitted on the driver on a bounded sample of
labelled rows (``SAMPLE_ROWS`` texts of ``SAMPLE_BYTES`` at most) and sent with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import hash_sample, in_fold, text_or_empty

WIDTH, STRIDE, HOP, FILTERS, EMBED = 8, 4, 256, 16, 8
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 32_768
SLICE_BYTES = 1_000_000
PER_HOP = HOP // STRIDE


@dataclass
class Network:
    embed: np.ndarray  # 256 × EMBED, row 0 (padding) stays zero
    kernel: np.ndarray  # WIDTH × EMBED × FILTERS
    bias: np.ndarray  # FILTERS
    combine: np.ndarray  # 2 × (FILTERS + 1): of the maximum and of the mean over chunks
    offset: np.ndarray  # 1

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.kernel).astype(np.float32)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded with zeros to whole hops, and the hops of each."""
    hops = np.array([(len(t) + WIDTH - STRIDE) // HOP + 1 for t in texts])
    data = np.zeros(int(hops.sum()) * HOP + WIDTH, np.uint8)
    at = 0
    for text, n in zip(texts, hops, strict=True):
        data[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * HOP
    return data, hops


def hop_maxima(tables: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest answer of each filter in each hop, and the position in the hop where it stands."""
    n = (len(data) - WIDTH) // STRIDE
    answers = np.take(tables[0], data[:n * STRIDE:STRIDE], axis=0)
    for w in range(1, WIDTH):
        answers += np.take(tables[w], data[w:w + n * STRIDE:STRIDE], axis=0)
    answers = answers.reshape(-1, PER_HOP, FILTERS)
    return answers, answers.max(axis=1)


def chunked(hop: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum per chunk (a hop and the next hop of the same text), and whether the next hop gave it."""
    last = np.zeros(len(hop), bool)
    last[np.cumsum(hops) - 1] = True
    following = np.vstack([hop[1:], hop[-1:]])
    from_next = (following > hop) & ~last[:, None]
    return np.where(from_next, following, hop), from_next


def repetition(data: np.ndarray, texts: list[bytes], hops: np.ndarray) -> np.ndarray:
    """Share of each hop's four-byte runs that stood in it before."""
    n = len(data) - WIDTH
    keys = sum(data[i:i + n].astype(np.uint32) << np.uint32(8 * i) for i in range(4)).reshape(-1, HOP)
    real = np.clip(np.repeat([len(t) - 3 for t in texts], hops) - HOP * (np.arange(len(keys)) - np.repeat(np.cumsum(hops) - hops, hops)), 0, HOP)
    keys[np.arange(HOP) >= real[:, None]] = 0
    keys.sort(axis=1)
    distinct = (keys[:, 1:] != keys[:, :-1]).sum(axis=1) + (real == HOP)
    return np.where(real >= 32, 1 - distinct / np.maximum(real, 1), 0.0)


def features(net: Network, chunk: np.ndarray, repeat: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    active = np.hstack([np.maximum(chunk + net.bias, 0), 4 * repeat[:, None]])
    starts = np.cumsum(hops) - hops
    return active, np.maximum.reduceat(active, starts), np.add.reduceat(active, starts) / hops[:, None]


def probability(net: Network, tables: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """One probability per text, from all its bytes."""
    out = np.empty(len(texts))
    start = held = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or (held and held + len(texts[k]) > SLICE_BYTES):
            if k > start:
                data, hops = laid_out(texts[start:k])
                hop = np.vstack([hop_maxima(tables, data[i:i + (1 << 20) + WIDTH])[1] for i in range(0, len(data) - WIDTH, 1 << 20)])
                _, most, mean = features(net, chunked(hop, hops)[0], repetition(data, texts[start:k], hops), hops)
                logit = most @ net.combine[0] + mean @ net.combine[1] + net.offset[0]
                out[start:k] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            start, held = k, 0
        if k < len(texts):
            held += len(texts[k])
    return out


def gradient(net: Network, tables: np.ndarray, texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """Gradient of the log loss, in the order of the fields of the network."""
    data, hops = laid_out(texts)
    answers, hop = hop_maxima(tables, data)
    chunk, from_next = chunked(hop, hops)
    active, most, mean = features(net, chunk, repetition(data, texts, hops), hops)
    logit = most @ net.combine[0] + mean @ net.combine[1] + net.offset[0]
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - wanted) / len(texts)
    combine = np.stack([error @ most, error @ mean])
    owner = np.repeat(np.arange(len(texts)), hops)
    top = active == most[owner]
    shared = np.add.reduceat(top, np.cumsum(hops) - hops).astype(float)
    back = (error[owner, None] * (net.combine[0] * top / shared[owner] + net.combine[1] / hops[owner, None])) * (active > 0)
    back = back[:, :FILTERS]
    rows, filters = np.nonzero(back)
    values = back[rows, filters]
    source = rows + from_next[rows, filters]
    place = answers[source, :, filters].argmax(axis=1) + source * PER_HOP
    table = np.zeros((WIDTH, 256 * FILTERS))
    for w in range(WIDTH):
        table[w] = np.bincount(data[place * STRIDE + w].astype(np.int64) * FILTERS + filters, values, 256 * FILTERS)
    table = table.reshape(WIDTH, 256, FILTERS)
    embed = np.einsum("wbf,wef->be", table, net.kernel)
    embed[0] = 0
    return [embed, np.einsum("be,wbf->wef", net.embed, table), back.sum(axis=0), combine, np.array([error.sum()])]


def fit(texts: list[bytes], labels: list[int], epochs: int = 20, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss; without two classes the network answers the share of ones."""
    rng = np.random.default_rng(seed)
    wanted = np.array(labels, float)
    share = (wanted.sum() + 1) / (len(wanted) + 2)
    net = Network(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS),
                  rng.normal(0, 0.1, (2, FILTERS + 1)), np.array([np.log(share / (1 - share))]))
    net.embed[0] = 0
    if len(set(labels)) < 2:
        net.combine[:] = 0
        return net
    state = [net.embed, net.kernel, net.bias, net.combine, net.offset]
    first, second, step = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            step += 1
            slope = rate * (1 - epoch / epochs)
            for p, g, m, v in zip(state, gradient(net, net.tables(), [texts[k] for k in own], wanted[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= slope * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + 1e-4 * p)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
           rows: int = SAMPLE_ROWS, largest: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold: about ``rows``, of ``largest`` bytes at most, chosen by a hash of the id.

    A document with several labels takes the rounded mean; null ids and labels are left out.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold(modulus, held_out))
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("wanted"))
    )
    chosen = F.broadcast(hash_sample(ids, rows, "doc_id"))
    found = docs.where(F.octet_length(text_or_empty()) <= largest).select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id")
    got = sorted((r["doc_id"], r["text"], r["wanted"]) for r in found.limit(2 * rows).collect())
    return [r[1] for r in got], [r[2] for r in got]


def score(net: Network, text: Column) -> Column:
    """Probability that a text is of good quality; null counts as empty."""
    tables = net.tables()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(probability(net, tables, [t.encode("utf-8", "replace") for t in texts.fillna("")]))

    return run(text)


def trained(docs: DataFrame, labels: DataFrame, **options) -> Network:
    texts, wanted = sample(docs, labels, "quality", 3, 1, **options)
    return fit([t.encode() for t in texts], wanted)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts get the score of no bytes; repeated rows score alike; without
    usable labels every score is the prior; an empty table gives an empty result.
    """
    net = trained(docs, labels)
    return (
        docs.select("doc_id", in_fold(3, 1).alias("held_out"), score(net, F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    return docs.where(score(trained(docs, labels), F.col("text")) >= 0.5)
