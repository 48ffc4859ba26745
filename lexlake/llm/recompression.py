"""Repeated passages by recompression.

Rounds name runs of one symbol and then pairs of two symbols: a bit of a symbol's name
says whether it may stand left or right in a pair, so that every text of the corpus is
parsed alike, and a name is a hash of what it stands for, so that it is the same name
everywhere without asking anyone.  For each symbol the parse also knows which stretch
of words decided it.  A window of words that contains this stretch contains the symbol
wherever the window occurs: equal windows have the same interior symbols.  Each window
elects the one of least hash as its anchor; a window without one is its own anchor.

Anchors that occur in two documents lead to the windows that may repeat.  Neighbouring
windows of one anchor are compared as a whole first, and only what is left of them
window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm import flat
from lexlake.llm.shared import stored

ROUNDS = 4
#: Words that an anchor takes in on either side of what decided its symbol.
MARGIN = 4
_RUN, _LEFT, _ALONE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_TURN = [np.uint64((int(_LEFT) * (k + 1)) % (1 << 64)) for k in range(64)]
_WORD, _OTHER = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def parse(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first word, end) of the symbols after some rounds; first word and end are
    those of the words that decided the symbol.  What the edge of a document decided
    reaches beyond the edge, so that no window contains it.  ``doc`` is not falling."""
    s = name
    low = np.arange(len(s))
    high = low + 1
    for turn in range(rounds):
        if not len(s):
            break
        head = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(s)) - 1
        times = last - first + 1
        low, high = _seen(low, high, doc, first, last, True, True)
        s = np.where(times > 1, flat.mix(s[first] + times.astype(np.uint64) * _RUN), s[first])
        doc = doc[first]

        right = (flat.mix(s + _TURN[turn]) & np.uint64(1)).astype(bool)
        joins = np.append((doc[1:] == doc[:-1]) & ~right[:-1] & right[1:], False)
        joined = np.concatenate([[False], joins[:-1]])
        first = np.flatnonzero(~joined)
        last = first + joins[first]
        pair = flat.mix(s[first] * _LEFT + flat.mix(s[last]))
        whole = joins[first]
        low, high = _seen(low, high, doc, first, last, right[first] & ~whole, ~right[first] & ~whole)
        s = np.where(whole, pair, s[first])
        doc = doc[first]
    return s, low, high


def _seen(low, high, doc, first, last, left, right):
    """The stretches that decided the symbols made of first..last, of which those marked
    looked at the neighbour on the left or right."""
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(doc) - 1)
    edge_left = (first == 0) | (doc[before] != doc[first])
    edge_right = (last == len(doc) - 1) | (doc[after] != doc[last])
    new_low, new_high = low[first], high[last]
    new_low = np.where(left, np.where(edge_left, new_low - 1, low[before]), new_low)
    new_high = np.where(right, np.where(edge_right, new_high + 1, high[after]), new_high)
    # a stretch never ends before that of the symbol to its left
    return np.minimum.accumulate(new_low[::-1])[::-1], np.maximum.accumulate(new_high)


def sums(name: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and factors for ``stretch``."""
    total = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(name * flat.powers(base, max(len(name), 1))[: len(name)], out=total[1:])
    return total, flat.powers(pow(base, -1, 1 << 64), len(name) + 1)


def stretch(held: tuple[np.ndarray, np.ndarray], first: np.ndarray, size) -> np.ndarray:
    """A name of the words first..first+size-1."""
    total, factor = held
    return flat.mix((total[first + size] - total[first]) * factor[first] + np.asarray(size).astype(np.uint64))


def anchors(name: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, name of the stretch, first window, number of windows) for every group of
    neighbouring windows that elect the same symbol; windows are numbered by their
    first word."""
    at = np.flatnonzero(doc[: max(len(doc) - window + 1, 0)] == doc[window - 1 :])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, low, high = parse(name, doc)
    held = sums(name, _WORD)
    # a short symbol is common where its words are: what decided it, and a margin, make
    # an anchor of two dozen words and more
    low, high = low - MARGIN, high + MARGIN
    inside = (low >= 0) & (high <= len(name))
    a, b = np.where(inside, low, 0), np.where(inside, high, 1)
    key = flat.mix(s ^ stretch(held, a, b - a) ^ _ALONE)
    start = np.searchsorted(low, at, "left")
    stop = np.searchsorted(high, at + window, "right")
    size = stop - start
    elected = np.full(len(at), -1)
    # leftmost least key of start..stop-1: of each power of two of symbols, the best
    best = np.arange(len(s))
    step = 1
    while step <= size.max(initial=0):
        fits = (size >= step) & (size < 2 * step)
        a, b = best[start[fits]], best[stop[fits] - step]
        elected[fits] = np.where(key[b] < key[a], b, a)
        later = best[step:]
        now = best[: len(later)]
        best = np.concatenate([np.where(key[later] < key[now], later, now), best[len(later) :]])
        step *= 2
    alone = elected < 0
    anchor = np.where(alone, stretch(held, at, window), key[elected])
    new = np.concatenate([[True], (elected[1:] != elected[:-1]) | alone[1:] | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return anchor[first], stretch(held, at[first], count + window - 1), at[first], count


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(names of all words, number of the text of each); words are taken unchanged."""
    names, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for owners, held in flat.blocks(texts):
        cps, fill = flat.laid_out(held)
        start, end = flat.words(cps, fill)
        names.append(flat.names(cps, start, end))
        of.append(owners[np.searchsorted(fill, start)])
    return np.concatenate(names), np.concatenate(of)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space


def joined_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _survey(window: int, at_once: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                batch = whole.slice(k, at_once)
                texts = batch.column(1).to_pylist()
                name, of = word_names(texts)
                base = np.searchsorted(of, np.arange(len(texts) + 1))
                anchor, region, first, count = anchors(name, of, window)
                doc = of[first]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.diff(base)), pa.array([joined_hash(words_of(t)) for t in texts]),
                    _lists(anchor.view(np.int64), doc, len(texts)), _lists(region.view(np.int64), doc, len(texts)),
                    _lists((first - base[doc]).astype(np.int32), doc, len(texts)), _lists(count.astype(np.int32), doc, len(texts))],
                    ["node", "n_words", "whole", "anchors", "regions", "firsts", "counts"])
    return run


def _windows(window: int, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            ready = 0

            def out(rows=rows, batch=batch):
                node = batch.column(0).take(pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])))
                at, v, w = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
                rows.clear()
                return pa.RecordBatch.from_arrays(
                    [node, pa.array(at.astype(np.int32)), pa.array(v.view(np.int64)), pa.array(w.view(np.int64))], ["node", "at", "v", "w"])

            for i in range(batch.num_rows):
                name, _ = word_names([batch.column(1)[i].as_py()])
                first, count = (np.array(batch.column(c)[i].as_py(), np.int64) for c in (2, 3))
                at = np.unique(flat.ragged(first, count))
                at = at[at + window <= len(name)]
                if len(at):
                    rows.append((i, at, stretch(sums(name, _WORD), at, window), stretch(sums(name, _OTHER), at, window)))
                    ready += len(at)
                if ready >= most:
                    yield out()
                    ready = 0
            if rows:
                yield out()
    return run


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, hashes = [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column(1)[i].as_py())
                first, count = (np.array(batch.column(c)[i].as_py(), np.int64) for c in (2, 3))
                at = flat.ragged(first, count)
                at = at[at + window <= len(words)]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(gone.sum()))
                kept.append(b" ".join(left))
                hashes.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()),
                pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], ["node", "n_removed", "hash", "kept"])
    return run


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, kept_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]) of every row.

    A window is ``window`` consecutive words of one text.  Every word that is covered
    by a window whose words also start in a text with a smaller key is removed, judged
    on the texts as they came.  ``kept`` are the words that stay, joined by one space,
    null where none is removed and the text may stay as it is.

    Null, empty and shorter texts have no windows.  Rows with a null key are not
    compared: they keep all words and take none from others.  Rows go by key and text:
    those that share a key are not smaller than each other, and each keeps what its own
    text leaves.  An empty table gives no rows.
    """
    node = T.StructField("node", T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("text", T.LongType())]))
    texts = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text")).alias("node"), F.col(text).alias("__text"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    survey = stored(texts.mapInArrow(_survey(window), T.StructType([
        node, T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("anchors", longs),
        T.StructField("regions", longs), T.StructField("firsts", ints), T.StructField("counts", ints)])), "survey")
    usable = survey.filter("node.key IS NOT NULL")

    each = usable.select("node", F.explode(F.array_distinct("anchors")).alias("anchor"))
    # written first, here and below: a join next to its own aggregation cannot be split,
    # and a passage of very many documents has very many rows of one anchor
    shared = stored(each.groupBy("anchor").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("anchor"), "shared")
    zipped = F.explode(F.arrays_zip("anchors", "regions", "firsts", "counts")).alias("z")
    places = usable.select("node", zipped).select("node", F.col("z.anchors").alias("anchor"), F.col("z.regions").alias("region"),
                                                  F.col("z.firsts").alias("first"), F.col("z.counts").alias("count"))
    places = stored(places.join(shared, "anchor"), "places")

    # equal stretches of windows: all but those of the least key are removed
    regions = places.groupBy("anchor", "region").agg(F.min("node").alias("least"))
    several = regions.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("several"))
    regions = stored(regions.join(several, "anchor", "left"), "regions")
    judged = stored(places.join(regions, ["anchor", "region"]).select(
        "node", "first", "count", (F.col("node.key") > F.col("least.key")).alias("gone"), F.coalesce("several", F.lit(False)).alias("open")), "judged")
    gone = judged.filter("gone").select("node", "first", "count")
    open_ = judged.filter("NOT gone AND open")

    # what differs somewhere is compared window by window
    wanted = judged.filter("gone OR open").select("node").distinct()
    held = stored(texts.filter("node.key IS NOT NULL").join(wanted, "node", "left_semi"), "texts")
    ranges = lambda df: df.groupBy("node").agg(F.collect_list(F.struct("first", "count")).alias("r")).select(
        "node", F.col("r.first").alias("firsts"), F.col("r.count").alias("counts"))
    windows = stored(held.join(ranges(open_), "node").mapInArrow(_windows(window), T.StructType([
        node, T.StructField("at", T.IntegerType()), T.StructField("v", T.LongType()), T.StructField("w", T.LongType())])), "windows")
    least = stored(windows.groupBy("v", "w").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "least")
    single = windows.join(least, ["v", "w"]).filter("node.key > low.key").select("node", F.col("at").alias("first"), F.lit(1).alias("count"))

    cleaned = held.join(ranges(gone.union(single)), "node").mapInArrow(_cleaned(window), T.StructType([
        node, T.StructField("n_removed", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("kept", T.StringType())]))
    if not kept_text:
        cleaned = cleaned.drop("kept")
    out = survey.select("node", "n_words", "whole").join(cleaned.dropDuplicates(["node", "hash"]), "node", "left")
    return out.select(F.col("node.key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("hash", "whole").alias("kept_sha256"), *(["kept"] if kept_text else []))
