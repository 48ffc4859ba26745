"""Language-model scores: the marginal probability of a text over all segmentations.

A text is its words, each behind a space, and an end.  The pieces of an existing
vocabulary have unigram probabilities; a word's probability is the sum over all ways to
cut it into pieces, found by a forward recursion in log space.  The probabilities start
from the order of the vocabulary and are refined by expectation-maximisation over the
counted words of the training texts, so they are learnt from every training text.

Words are counted in tasks and added up by a shuffle.  A text's word-frequency score
takes the counts of the most frequent words, a bounded list, in its task, and those of
the others by a join of (text, word) rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm import flat
from lexlake.llm.bpe import load_ranks
from lexlake.llm.shared import stored

#: Words whose counts every task holds.
FREQUENT = 200_000
#: Refinements of the piece probabilities, and what is added to every expected count.
PASSES, ADDED = 2, 0.01
_BASE = 0x9E3779B97F4A7C15
_BLANK = set(b" \t\n\v\f\r")
NONE = -1e300
#: Bytes of a word whose pieces are looked up at once; the recursion goes on across them.
BLOCK = 4096


class Pieces:
    """The pieces that can occur in words behind a space, with log probabilities."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.lengths = np.array(sorted({len(p) for p in pieces}))
        value = [self.name(np.frombuffer(p, np.uint8)) for p in pieces]
        self.order = np.argsort(np.array(value, np.uint64))
        self.names = np.array(value, np.uint64)[self.order]
        self.log_p = np.append(log_p[self.order], NONE)
        # most stretches are no piece: the first bits of a name tell, without a search
        self.starts = np.zeros(1 << 22, bool)
        self.starts[(self.names >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def name(data: np.ndarray) -> int:
        return int(np.sum((data.astype(np.uint64) + np.uint64(1)) * flat.powers(_BASE, len(data)), dtype=np.uint64))

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length, as rows of bytes: (end and length of every stretch
        that a piece may have, number of the piece of every word there, or the last)."""
        n, size = data.shape
        total = np.zeros((n, size + 1), np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * flat.powers(_BASE, size), axis=1, out=total[:, 1:])
        down = flat.powers(pow(_BASE, -1, 1 << 64), size + 1)
        lengths = self.lengths[self.lengths <= size]
        end = np.repeat(np.arange(1, size + 1), len(lengths))
        at = np.stack([end, np.tile(lengths, size)], axis=1)
        at = at[at[:, 1] <= end]
        end, start = at[:, 0], at[:, 0] - at[:, 1]
        name = (total[:, end] - total[:, start]) * down[start]
        out = np.full(name.shape, len(self.names))
        maybe = np.nonzero(self.starts[(name >> np.uint64(42)).view(np.int64)])
        name = name[maybe]
        row = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        out[maybe] = np.where(self.names[row] == name, row, len(self.names))
        return at, out

    def forward(self, data: np.ndarray, whole: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Log probability of the first e bytes of every word, for all e.  Long words are
        looked up ``BLOCK`` ends at a time, with the bytes that pieces reach back;
        ``whole`` is what was found in words of one block, if that is known."""
        n, size = data.shape
        alpha = np.full((n, size + 1), NONE)
        alpha[:, 0] = 0
        for first in range(0, size, BLOCK):
            base, last = max(0, first - int(self.lengths[-1])), min(first + BLOCK, size)
            at, row = whole or self.found(data[:, base:last])
            score = self.log_p[row]
            edge = np.searchsorted(at[:, 0] + base, np.arange(first + 1, last + 2))
            for e in range(first + 1, last + 1):
                part = slice(edge[e - first - 1], edge[e - first])
                alpha[:, e] = log_sum(alpha[:, e - at[part, 1]] + score[:, part])
        return alpha

    def expected(self, data: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Adds to ``into`` how often each piece is expected in the weighted words."""
        n, size = data.shape
        whole = self.found(data) if size <= BLOCK else None
        alpha = self.forward(data, whole)
        beta = np.full((n, size + 1), NONE)
        beta[:, size] = 0
        for first in reversed(range(0, size, BLOCK)):
            # the stretches that start in this block; what is behind it is known already
            last = min(first + BLOCK, size)
            at, row = whole or self.found(data[:, first : last + int(self.lengths[-1])])
            if not whole:
                mine = at[:, 0] - at[:, 1] < last - first
                at, row = at[mine], row[:, mine]
            end, start = at[:, 0] + first, at[:, 0] - at[:, 1] + first
            score = self.log_p[row]
            by_start = np.argsort(start, kind="stable")
            edge = np.searchsorted(start[by_start], np.arange(first, last + 1))
            for s in range(last - 1, first - 1, -1):
                part = by_start[edge[s - first] : edge[s - first + 1]]
                beta[:, s] = log_sum(beta[:, end[part]] + score[:, part])
            share = np.exp(np.maximum(alpha[:, start] + score + beta[:, end] - alpha[:, size][:, None], -700))
            share *= weight[:, None]
            into += np.bincount(row.ravel(), share.ravel(), len(self.log_p))


def log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of what each row has the logs of."""
    top = x.max(axis=1)
    return np.where(top > NONE / 2, top + np.log(np.exp(np.maximum(x - top[:, None], -700)).sum(axis=1)), NONE)


def by_length(data: list[bytes], cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of bytes) of words of the same length, some at a time."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[part[0]])
        step = max(1, cells // (n * min(n, 32)))
        for k in range(0, len(part), step):
            some = part[k : k + step]
            yield some, np.frombuffer(b"".join(data[i] for i in some), np.uint8).reshape(len(some), n)


def spaced(words: list[str]) -> list[bytes]:
    """The bytes of every word behind a space."""
    return [b" " + w.encode("utf-8", "surrogatepass") for w in words]


def log_marginals(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural log of the probability of each word behind a space."""
    out = np.zeros(len(words))
    for places, rows in by_length(spaced(words)):
        out[places] = pieces.forward(rows)[:, -1]
    return out


def lower_words(held: list[str], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points with A-Z in lower case, starts, ends, number of the text) of words."""
    cps, fill = flat.laid_out(held)
    cps = np.where((cps >= 65) & (cps <= 90), cps + 32, cps).astype(np.uint32)
    start, end = flat.words(cps, fill)
    return cps, start, end, owners[np.searchsorted(fill, start)]


def _count(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(name, word, n) of the words of a task, and (null, null, n): its texts, that is
    ends.  A word may come more than once."""
    seen: dict[int, list] = {}
    texts = 0

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(seen), pa.int64()), pa.array([v[0] for v in seen.values()], pa.string()), pa.array([v[1] for v in seen.values()], pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(columns, ["name", "word", "n"])

    for batch in batches:
        texts += batch.num_rows
        for owners, held in flat.blocks(batch.column(0).to_pylist()):
            cps, start, end, _ = lower_words(held, owners)
            name, one, count = np.unique(flat.names(cps, start, end), return_index=True, return_counts=True)
            for k, i, n in zip(name.view(np.int64).tolist(), one.tolist(), count.tolist(), strict=True):
                old = seen.get(k)
                if old is None:
                    seen[k] = [cps[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass"), n]
                else:
                    old[1] += n
            if len(seen) > most:
                yield out()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([texts], pa.int64())], ["name", "word", "n"])


def usable(ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces without white space but for a first space, in the order of the vocabulary."""
    return [p for p, _ in sorted(ranks.items(), key=lambda x: x[1]) if p and not _BLANK & set(p[1:]) and (p[0] == 32 or p[0] not in _BLANK)]


def learn(counts: DataFrame, ranks: dict[bytes, int], ends: int) -> tuple[list[bytes], np.ndarray, float]:
    """(pieces, log probabilities, that of the end) from the words (word, n)."""
    pieces = usable(ranks)
    start = 1 / (np.arange(len(pieces)) + 10.0)
    log_p = np.log(start / start.sum())
    log_end = math.log(1e-3)
    context = counts.sparkSession.sparkContext
    for _ in range(PASSES):
        held = context.broadcast((pieces, log_p))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = Pieces(*held.value)
            total = np.zeros(len(model.log_p))
            for batch in batches:
                weight = np.asarray(batch.column(1), np.float64)
                for places, rows in by_length(spaced(batch.column(0).to_pylist())):
                    model.expected(rows, weight[places], total)
            some = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(model.order[some]), pa.array(total[some])], ["piece", "n"])

        # one number for each piece of the vocabulary, however many words there are
        rows = counts.select("word", "n").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(len(pieces), ADDED)
        total[rows["piece"].to_numpy(np.int64)] += rows["n"].to_numpy()
        every = total.sum() + ends + ADDED
        log_p, log_end = np.log(total / every), math.log((ends + ADDED) / every)
    return pieces, log_p, log_end


def scores(docs: DataFrame, training: Column, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows for which ``training`` is true are learnt from.  ``base_score`` adds, over the
    words and one end, log10((c + 0.1) / (N + 0.1 (V + 1))) with the training count c
    of the token, N of all and V of distinct ones.  ``score`` is the model's log10
    probability of the text.  Null and empty texts are an end.  Equal rows are learnt
    and scored as often as they occur.  Without training rows all counts are 0 and the
    pieces keep the order of the vocabulary.
    """
    spark = docs.sparkSession
    counted = docs.filter(training).select(F.col(text).alias("__text")).mapInArrow(_count, "name long, word string, n long")
    counts = stored(counted.groupBy("name", "word").agg(F.sum("n").alias("n")).filter("n > 0"), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("n"))), F.lit(0))).first()
    words = counts.filter("name IS NOT NULL")
    ranks = load_ranks(path)
    pieces, log_p, log_end = learn(words, ranks, ends)

    # the least count such that at most FREQUENT words have it: over counts, not words
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(FREQUENT).collect()
    cutoff, so_far = None, 0
    for row in sizes:
        so_far += row["words"]
        if so_far > FREQUENT:
            break
        cutoff = row["n"]
    often = words.filter(F.col("n") >= (cutoff if cutoff is not None else (1 << 62))).select("name", "n").toPandas()
    name = often["name"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(name)
    model = spark.sparkContext.broadcast((pieces, log_p, log_end, name[order], often["n"].to_numpy(np.int64)[order], ends))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p, log_end, names, n, ends = model.value
        held_pieces = Pieces(pieces, log_p)
        known = flat.Known(lambda w: (log_marginals(w, held_pieces), np.ones(len(w), np.int64)))
        for batch in batches:
            rows = batch.num_rows
            tokens = np.ones(rows, np.int64)
            met = np.full(rows, int(ends > 0))
            base = np.full(rows, math.log10(ends + 0.1))
            lattice = np.full(rows, log_end)
            rest_of, rest_name = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for owners, held in flat.blocks(batch.column(1).to_pylist()):
                cps, start, end, of = lower_words(held, owners)
                if not len(start):
                    continue
                word = flat.names(cps, start, end)
                row = known.rows(cps, start, end, word)
                tokens += np.bincount(of, minlength=rows)
                lattice += np.bincount(of, known.values[known.first[row]], rows)
                at = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
                hit = names[at] == word if len(names) else np.zeros(len(word), bool)
                met += np.bincount(of[hit], minlength=rows)
                base += np.bincount(of[hit], np.log10(n[at[hit]] + 0.1), rows)
                rest_of.append(of[~hit])
                rest_name.append(word[~hit])
            of, word = np.concatenate(rest_of), np.concatenate(rest_name)
            order = np.lexsort((word, of))
            of, word = of[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])])) if len(of) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(of)))
            edge = pa.array(np.searchsorted(of[first], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(tokens), pa.array(met.astype(np.int64)), pa.array(base), pa.array(lattice / math.log(10)),
                pa.ListArray.from_arrays(edge, pa.array(word[first].view(np.int64))),
                pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32)))],
                ["key", "n_tokens", "met", "base", "score", "names", "times"])

    scanned = docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).mapInArrow(score, T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("met", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("names", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType()))]))
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    rest = scanned.select("row", F.explode(F.arrays_zip("names", "times")).alias("z")).select("row", F.col("z.names").alias("name"), F.col("z.times").alias("times"))
    rare = words.filter(F.col("n") < (cutoff if cutoff is not None else (1 << 62))).select("name", "n")
    summed = rest.join(rare, "name").groupBy("row").agg(
        F.sum("times").alias("rest_met"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("rest_base"))
    # what is in neither list has the count 0 and adds log10(0.1), that is -1
    unlisted = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = scanned.join(summed, "row", "left")
    log_all = math.log10(total + 0.1 * (distinct + 1))
    return whole.select(
        F.col("key").alias(key), "n_tokens", (F.col("met") + F.coalesce("rest_met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - unlisted + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"), "score")
