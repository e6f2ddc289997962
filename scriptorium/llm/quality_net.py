"""A byte-level convolutional quality classifier in numpy.

Bytes have learned vectors; learned filters run over six bytes each. Their activations are max-pooled over overlapping
chunks of 512 bytes that cover the whole text, and the chunks' mean and maximum are combined into one probability. The
vectors and filters fold into one table a position, so scoring is six table look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches
from scriptorium.llm.shingles import blocks, utf8

WIDTH, FILTERS, VECTOR = 6, 16, 8
#: Chunks are two neighbouring blocks, so each overlaps the next by half.
BLOCK = 256
#: Training: about so many labelled rows, none above so many bytes, so many rounds over them.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 1_200, 30_000, 24
#: Bytes convolved at once.
PIECE = 1 << 20


@dataclass
class Net:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH x VECTOR x FILTERS
    offset: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    top: np.ndarray  # FILTERS
    bias: float

    def tables(self) -> np.ndarray:
        return np.einsum("bv,kvf->kbf", self.vectors, self.filters).astype(np.float32)


def start_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    return Net(r.normal(0, 0.5, (256, VECTOR)), r.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)), np.zeros(FILTERS), np.zeros(FILTERS), np.zeros(FILTERS), 1.0)


def block_maxima(tables: np.ndarray, data: np.ndarray, arg: bool = False):
    """blocks x FILTERS: the largest filter response that starts in each block (and where, if asked). data: one text."""
    padded = np.concatenate((data, np.zeros(WIDTH - 1, np.uint8)))
    out, places = [], []
    for begin in range(0, max(len(data), 1), PIECE):
        n = min(PIECE, len(data) - begin) if len(data) else 1
        piece = padded[begin : begin + n + WIDTH - 1]
        if not len(data):
            piece = np.zeros(WIDTH, np.uint8)
        response = tables[0].take(piece[:n], axis=0)
        for k in range(1, WIDTH):
            response += tables[k].take(piece[k : k + n], axis=0)
        starts = np.arange(0, n, BLOCK)
        if arg:
            for a in starts:
                places.append(begin + a + response[a : a + BLOCK].argmax(axis=0))
        out.append(np.maximum.reduceat(response, starts, axis=0))
    maxima = np.concatenate(out)
    return (maxima, np.array(places)) if arg else maxima


def _chunks(maxima: np.ndarray) -> np.ndarray:
    return np.maximum(maxima[:-1], maxima[1:]) if len(maxima) > 1 else maxima


def combine(net: Net, maxima: np.ndarray) -> float:
    pooled = np.maximum(_chunks(maxima) + net.offset, 0)
    z = float(pooled.mean(0) @ net.mean + pooled.max(0) @ net.top + net.bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Net:
    """Adam on the log loss, eight texts a step; the gradient passes through the pooled maxima only."""
    net, r = start_net(seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    names = ("vectors", "filters", "offset", "mean", "top", "bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for turn in range(rounds):
        order = r.permutation(len(data))
        for at in range(0, len(order), 8):
            grad = {n: np.zeros_like(np.asarray(getattr(net, n), float)) for n in names}
            by_table = np.zeros((WIDTH, 256, FILTERS))
            tables = net.tables()
            group = order[at : at + 8]
            for i in group:
                maxima, places = block_maxima(tables, data[i], arg=True)
                c = _chunks(maxima)
                which = np.arange(len(c))[:, None] + (maxima[1:] > maxima[:-1] if len(maxima) > 1 else np.zeros(c.shape, int))
                pooled = np.maximum(c + net.offset, 0)
                best = pooled.argmax(0)
                z = pooled.mean(0) @ net.mean + pooled.max(0) @ net.top + net.bias
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) / len(group)
                grad["bias"] += d
                grad["mean"] += d * pooled.mean(0)
                grad["top"] += d * pooled.max(0)
                back = np.repeat(d * net.mean[None] / len(c), len(c), axis=0)
                back[best, np.arange(FILTERS)] += d * net.top
                back *= c + net.offset > 0
                grad["offset"] += back.sum(0)
                spots = np.take_along_axis(places, which, axis=0)
                padded = np.concatenate((data[i], np.zeros(WIDTH, np.uint8)))
                f = np.broadcast_to(np.arange(FILTERS), spots.shape)
                for k in range(WIDTH):
                    np.add.at(by_table[k], (padded[spots + k], f), back)
            grad["vectors"] += np.einsum("kbf,kvf->bv", by_table, net.filters)
            grad["filters"] += np.einsum("kbf,bv->kvf", by_table, net.vectors)
            step += 1
            rate = 0.02 * min(1, 2 * (1 - turn / rounds))
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.99 * second[n] + 0.01 * grad[n] ** 2
                update = rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                setattr(net, n, getattr(net, n) * (1 - 1e-4) - update)
    net.bias = float(net.bias)
    return net


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS, largest: int = SAMPLE_BYTES, rounds: int = ROUNDS) -> Net:
    """Learns from a hash sample of about `rows` labelled rows that are not held out, each at most `largest` bytes long."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").where(~held_out("k"))
    share = min(1.0, rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    drawn = F.broadcast(known.where(draw < share))  # about `rows` rows
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= largest)
    got = sorted(((r.k, r.t.encode(), int(r.y)) for r in texts.join(drawn, "k").collect()), key=lambda x: x[:2])
    if not got:
        return start_net()
    return fit([t for _, t, _ in got], np.array([float(y) for _, _, y in got]), rounds)


def score(docs: DataFrame, net: Net, *, text: str = "text"):
    """A Column of probabilities for the given frame's text column."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some tens of KB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        tables = own.tables()
        for texts in batches:
            column = pa.array(texts, pa.large_string())
            out = []
            for start, stop in blocks(column):
                data, at = utf8(column.slice(start, stop - start))
                out += [combine(own, block_maxima(tables, data[a:b])) for a, b in zip(at, at[1:])]
            yield pd.Series(out, dtype="float64")

    return run(F.coalesce(F.col(text), F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Key, held_out, score and predicted of every row.

    Null texts are scored as empty ones. Null keys are not held out; null labels are not learned from. Without labels
    the untrained net scores all texts alike in kind. Repeated rows get equal scores; empty tables give empty results;
    other columns are not carried. Texts are scored whole.
    """
    net = train(docs, labels, text=text, key=key, label=label)
    scored = docs.select(F.col(key), held_out(key).alias("held_out"), score(docs, net, text=text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
