"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of the hashes of its words, of its word pairs and of the pairs that
skip one word.  Per-coordinate rates let a rare word learn as fast as it needs, and L1
leaves most coordinates at exactly zero, so that the model is a short list of weights
that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm import flat

_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    """``bits``: 2**bits coordinates.  ``rows``: at most so many labelled rows are learnt
    from, chosen by the hash of their key.  ``shard``: rows that one task learns from;
    the shards' weights are averaged.  The others are those of FTRL-proximal."""

    bits: int = 20
    rows: int = 40_000
    shard: int = 10_000
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    bias: float = -3.0


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, coordinate) of every n-gram, one block after the other."""
    for owners, held in flat.blocks(texts):
        cps, fill = flat.laid_out([t.lower() for t in held])
        kind = flat.classes()[cps]
        word = (kind == flat.LETTER) | (kind == flat.NUMBER)
        word[fill] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        owner = owners[np.searchsorted(fill, start)]
        name = flat.names(cps, start, end)
        found, of = [name], [owner]
        for gap, by in ((1, _PAIR), (2, _SKIP)):
            same = owner[gap:] == owner[:-gap]
            found.append(flat.mix(name[:-gap][same] * by + name[gap:][same]))
            of.append(owner[gap:][same])
        yield np.concatenate(of), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def sets(texts: list[str | None], bits: int) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    out = [np.zeros(0, np.int64)] * len(texts)
    for of, at in features(texts, bits):
        both = np.unique((of << bits) | at)
        edge = np.flatnonzero(np.concatenate([[True], (both[1:] >> bits) != (both[:-1] >> bits)])) if len(both) else []
        for part in np.split(both, edge[1:]) if len(both) else []:
            i = int(part[0] >> bits)
            out[i] = np.union1d(out[i], part & ((1 << bits) - 1)) if len(out[i]) else part & ((1 << bits) - 1)
    return out


def ftrl(examples: list[np.ndarray], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``epochs`` passes in an order that depends on the epoch."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb, nb = -s.bias * s.beta / s.alpha, 0.0
    for epoch in range(s.epochs):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(examples)).tolist():
            x, y = examples[i], labels[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= s.l1, 0.0, (np.sign(zx) * s.l1 - zx) / ((s.beta + np.sqrt(nx)) / s.alpha + s.l2))
            wb = -zb * s.alpha / (s.beta + nb**0.5)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - y
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / s.alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w, float(-zb * s.alpha / (s.beta + nb**0.5))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text: str = "text", key: str = "doc_id",
        label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero; the last one, 2**bits, is the bias.

    At most ``s.rows`` labelled keys are chosen by hash, so the table of labels that
    every task gets is bounded, and so is the model that the driver gets.  Rows whose
    key or label is null teach nothing; of repeated labels the larger one counts.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    total = known.count()
    share = min(1.0, 0.97 * s.rows / max(total, 1))
    chosen = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    shards = max(1, -(-int(total * share) // s.shard))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.select("_key", "_text", "_label", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(shards)).cast("int").alias("_shard"))
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("weight", T.DoubleType())])

    def learn(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, y, keys = [], [], []
        for batch in batches:
            examples += [x.astype(np.int32) for x in sets(batch.column(1).to_pylist(), s.bits)]
            y += batch.column(2).to_pylist()
            keys += batch.column(0).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (str(keys[i]), len(examples[i])))  # whatever order the rows came in
        w, b = ftrl([examples[i] for i in order], [y[i] for i in order], s)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << s.bits)), pa.array(np.append(w[at], b))], ["at", "weight"])

    parts = rows.groupBy("_shard").applyInArrow(learn, schema)
    model = parts.groupBy("at").agg((F.sum("weight") / shards).alias("weight")).toPandas().sort_values("at")
    if not len(model):
        return np.array([1 << s.bits]), np.array([s.bias])
    return model["at"].to_numpy(), model["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings(), text: str = "text", out: str = "score") -> DataFrame:
    """All rows of ``docs`` with ``out``, the probability that the text is toxic.  Null
    and empty texts have that of the bias alone.  A column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    kept = [c for c in docs.columns if c != out]
    at_column = [docs.columns.index(c) for c in kept]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((1 << s.bits) + 1)
        weight[held.value[0]] = held.value[1]
        bias = weight[1 << s.bits]
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            hits = []
            for of, at in features(batch.column(place).to_pylist(), s.bits):
                used = weight[at] != 0
                hits.append(np.unique((of[used] << s.bits) | at[used]))
            both = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            total += np.bincount(both >> s.bits, weight[both & ((1 << s.bits) - 1)], batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at_column] + [pa.array(p)], [*kept, out])

    return docs.mapInArrow(run, schema)
