"""Quality rules: gradient-boosted trees over statistics of a document.

Every text becomes a short row of statistics: the counts that the fixed rules use and
shares that do not depend on its length.  A text is looked at as bytes inside arrays;
words, lines and windows of words are compared as what they are, by numbers that an
Arrow dictionary gave them, so that no two of them can be taken for one another.

The trees are grown on histograms of a bounded sample of labelled rows and are kept as
flat numpy node arrays, so that a batch walks one level of all trees at a time.  On
features where more can only be worse, splits that would raise the score are refused,
and both sides of a split are held apart by its middle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as symbols, the ends of sentences, ASCII punctuation.
SYMBOLS = "#*$%&|<>"
STOPS = ".!?"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see; -1: more of it never raises the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "longest_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "digit_share": 0, "upper_share": 0, "punctuation_share": 0, "exclaim_share": -1, "bar_share": -1, "symbol_word_share": -1,
    "stop_share": 0, "words_per_line": 0, "wide_share": 0, "distinct_share": 0, "brief_share": 0,
}
#: Bytes that one block of texts holds, unless one text alone is longer.
BLOCK = 1 << 21
_BITS = {"gap": 1, "symbol": 2, "digit": 4, "upper": 8, "punctuation": 16, "tail": 32, "stop": 64}


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[32, *range(9, 14)]] |= _BITS["gap"]
    for name, letters in (("symbol", SYMBOLS), ("digit", "0123456789"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("punctuation", PUNCTUATION), ("stop", STOPS)):
        kind[list(letters.encode())] |= _BITS[name]
    kind[0x80:0xC0] |= _BITS["tail"]
    return kind


KIND = _kinds()


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes, the same for equal stretches only."""
    size = end - start
    edges = np.append(0, np.cumsum(size))
    inside = np.repeat(start - edges[:-1], size) + np.arange(edges[-1])
    held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[inside])])
    return held.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs only."""
    if not len(a):
        return a
    return pa.array(a * (int(b.max()) + 1) + b).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of True, which places in ``cut`` end as well."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    more = cut[(cut > 0) & (cut < len(inside))]
    more = more[inside[more] & inside[more - 1]]
    return np.sort(np.concatenate([start, more])), np.sort(np.concatenate([end, more]))


def _block(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts data[edges[i]:edges[i+1]]."""
    n = len(edges) - 1
    kind = KIND[data]
    has = lambda name: (kind & _BITS[name]) != 0
    before = lambda flags: np.append(0, np.cumsum(flags))
    each = lambda total: total[edges[1:]] - total[edges[:-1]]
    of = lambda owner, weights=None: np.bincount(owner, weights, n)

    gap, tail = has("gap"), has("tail")
    start, end = _stretches(~gap, edges)
    owner = np.searchsorted(edges, start, "right") - 1
    points = before(~gap & ~tail)
    length = points[end] - points[start]
    words = of(owner)
    chars = of(owner, length)

    # lines: a newline ends one, and so does the end of a text
    newline = data == 10
    line_start, line_end = _stretches(~newline, edges)
    line_owner = np.searchsorted(edges, line_start, "right") - 1
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_owner = line_start[filled], line_end[filled], line_owner[filled]
    lines = of(line_owner)
    same = _pair(_numbers(data, line_start, line_end), line_owner)
    _, first = np.unique(same, return_index=True)
    dup_lines = lines - of(line_owner[first])

    # windows of three words that occur twice in a text
    name = _numbers(data, start, end)
    repeated = np.zeros(len(name), bool)
    if len(name) > 2:
        held = owner[2:] == owner[:-2]
        window = _pair(_pair(_pair(name[:-2], name[1:-1]), name[2:])[held], owner[:-2][held])
        at = np.flatnonzero(held)[np.bincount(window)[window] > 1]
        for k in range(3):
            repeated[at + k] = True
    repeats = of(owner[repeated])
    _, first = np.unique(_pair(name, owner), return_index=True)
    distinct = of(owner[first])

    symbols = each(before(has("symbol")))
    all_points = np.maximum(each(before(~tail)), 1)
    symbol_word = before(has("symbol"))
    some_w, some_l = np.maximum(words, 1), np.maximum(lines, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    stops = has("stop")
    with_symbol = of(owner[symbol_word[end] > symbol_word[start]])
    counts = np.stack([words, chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    features = np.stack([
        np.log1p(words), chars / some_w, np.log1p(longest), symbols / all_points, dup_lines / some_l, repeats / some_w,
        each(before(has("digit"))) / all_points, each(before(has("upper"))) / all_points, each(before(has("punctuation"))) / all_points,
        each(before(data == 33)) / some_w, each(before(data == 124)) / some_w, with_symbol / some_w,
        each(before(stops)) / some_w, words / some_l, each(before(data >= 0xC0)) / all_points, distinct / some_w,
        of(owner[length <= 2]) / some_w], 1)
    return counts, features.astype(np.float32)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of every text of a string array; a null counts as empty.

    Texts are taken in blocks of about ``BLOCK`` bytes; a longer one is a block alone.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    counts, features = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)), np.float32)
    if not len(texts):
        return counts, features
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK, "right")) - 1)
        counts[low:high], features[low:high] = _block(data[edges[low] : edges[high]], edges[low : high + 1] - edges[low])
        low = high
    return counts, features


@dataclass(frozen=True)
class Settings:
    """``rows``: at most so many labelled rows are learnt from, chosen by the hash of
    their key.  The others are those of gradient boosting with second-order leaves."""

    rows: int = 40_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    l2: float = 1.0
    least: float = 4.0


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees behind each other.  Node i asks whether ``feature[i]`` is at
    most ``limit[i]`` and goes on to ``left[i]`` or else to ``left[i] + 1``; a leaf goes on
    to itself, as its limit is infinite.  ``root`` are the first nodes of the trees."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        """Sum of the leaves of every row, one level of all trees at a time."""
        total = np.full(len(features), self.base)
        for low in range(0, len(features), 4096):
            part = features[low : low + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.repeat(self.root[None, :], len(part), 0)
            for _ in range(self.depth):
                node = self.left[node] + (part[rows, self.feature[node]] > self.limit[node])
            total[low : low + 4096] += self.value[node].sum(1)
        return total

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features), -30, 30)))


def grow(features: np.ndarray, labels: np.ndarray, s: Settings = Settings(), signs: list[int] | None = None) -> Trees:
    """Boosted trees for log-loss; ``signs`` gives the direction of each feature (0: none).

    A split is taken where its gain is largest, the first feature and the lowest limit
    among equals.  Under a constraint the children's values must not be in the wrong
    order, and what grows below stays on its side of their middle.  Without rows or
    with one label only, there are no trees and the base alone decides.
    """
    signs = [0] * features.shape[1] if signs is None else signs
    n, width = features.shape
    rate = (labels.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate / (1 - rate)))
    nodes: list[tuple[int, float, int, float]] = []
    roots: list[int] = []
    limits = [np.unique(np.quantile(features[:, j], np.linspace(0, 1, s.bins + 1)[1:-1], method="lower")).astype(np.float32) if n else np.zeros(0, np.float32) for j in range(width)]
    binned = np.stack([np.searchsorted(limits[j], features[:, j], "left") for j in range(width)], 1) if n else np.zeros((0, width), np.int64)
    margin = np.full(n, base)
    if n and 0 < labels.sum() < n:
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - labels, p * (1 - p)
            roots.append(len(nodes))
            nodes.append((0, np.inf, len(nodes), 0.0))
            waiting = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
            while waiting:
                at, rows, level, low, high = waiting.pop()
                g, h = gradient[rows].sum(), weight[rows].sum()
                value = float(np.clip(-g / (h + s.l2), low, high))
                found = _split(binned[rows], gradient[rows], weight[rows], limits, signs, s, low, high) if level < s.depth else None
                if found is None:
                    nodes[at] = (0, np.inf, at, s.rate * value)
                    margin[rows] += s.rate * value
                    continue
                j, cut, a, b = found
                middle = (a + b) / 2
                child = len(nodes)
                nodes[at] = (j, float(limits[j][cut]), child, 0.0)
                nodes += [(0, np.inf, child, 0.0), (0, np.inf, child + 1, 0.0)]
                goes = binned[rows, j] <= cut
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
                waiting += [(child, rows[goes], level + 1, *bounds[0]), (child + 1, rows[~goes], level + 1, *bounds[1])]
    column = lambda i, kind: np.array([x[i] for x in nodes], kind)
    return Trees(column(0, np.int64), column(1, np.float32), column(2, np.int64), column(3, np.float64), np.array(roots, np.int64), s.depth, base)


def _split(binned, gradient, weight, limits, signs, s, low, high):
    """(feature, bin, left value, right value) of the best split, or None."""
    g, h = gradient.sum(), weight.sum()
    score = lambda g, h, v: -(g * v + 0.5 * (h + s.l2) * v * v)
    best, found = 1e-6, None
    here = score(g, h, np.clip(-g / (h + s.l2), low, high))
    for j, limit in enumerate(limits):
        if not len(limit):
            continue
        gl = np.cumsum(np.bincount(binned[:, j], gradient, len(limit) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], weight, len(limit) + 1))[:-1]
        a, b = np.clip(-gl / (hl + s.l2), low, high), np.clip(-(g - gl) / (h - hl + s.l2), low, high)
        gain = score(gl, hl, a) + score(g - gl, h - hl, b) - here
        gain[(hl < s.least) | (h - hl < s.least) | (signs[j] * (b - a) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, k, float(a[k]), float(b[k]))
    return found


_TREES = T.StructType([
    T.StructField("feature", T.ArrayType(T.LongType())), T.StructField("limit", T.ArrayType(T.FloatType())), T.StructField("left", T.ArrayType(T.LongType())),
    T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("root", T.ArrayType(T.LongType())), T.StructField("base", T.DoubleType())])


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, the counts, ``features``) of every row; nothing is shuffled.

    A null text counts as empty; null and repeated keys stay rows of their own; other
    columns are not looked at.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = statistics(batch.column(1))
            edges = np.arange(len(features) + 1, dtype=np.int32) * features.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.ListArray.from_arrays(pa.array(edges), pa.array(features.reshape(-1)))], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def fit(measured: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from the labelled rows of ``measured``.

    At most ``s.rows`` labelled keys are chosen by hash, whatever the size of the
    tables: that bounds what is spread, what the one learning task holds (17 numbers a
    row) and how long it takes.  Rows whose key or label is null teach nothing; of
    repeated labels the larger one counts.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label"))
    share = min(1.0, 0.97 * s.rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # repeated documents would break the bound: of equal keys one row teaches
    rows = measured.select(F.col(key).alias("_key"), "features").join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key").agg(F.max("features").alias("features"), F.max("_label").alias("_label"))

    def learn(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("_key")
        x = held["features"].combine_chunks().flatten().to_numpy().reshape(len(held), -1)
        t = grow(x, held["_label"].to_numpy(), s, list(FEATURES.values()))
        yield pa.RecordBatch.from_pylist([{**{c: getattr(t, c).tolist() for c in ("feature", "limit", "left", "value", "root")}, "base": t.base}],
                                         schema=pa.schema([("feature", pa.list_(pa.int64())), ("limit", pa.list_(pa.float32())), ("left", pa.list_(pa.int64())),
                                                           ("value", pa.list_(pa.float64())), ("root", pa.list_(pa.int64())), ("base", pa.float64())]))

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(learn, _TREES).first()
    if found is None:
        return grow(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), s)
    return Trees(np.array(found["feature"], np.int64), np.array(found["limit"], np.float32), np.array(found["left"], np.int64),
                 np.array(found["value"]), np.array(found["root"], np.int64), s.depth, found["base"])


def judge(measured: DataFrame, trees: Trees, limit: float = 0.5) -> DataFrame:
    """``measured`` without its features, with ``base_failed`` (fewer than 50 words, or
    more than half of the words in repeated windows), ``score`` (probability of a good
    text) and ``kept`` (not failed, and the score is at least ``limit``)."""
    held = measured.sparkSession.sparkContext.broadcast(trees)
    names = [c for c in measured.columns if c not in ("features", "score", "base_failed", "kept")]
    at = [measured.columns.index(c) for c in names]
    place = measured.columns.index("features")
    schema = T.StructType([measured.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(place).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(held.value.probability(x))], schema.names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = measured.mapInArrow(run, schema).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))
