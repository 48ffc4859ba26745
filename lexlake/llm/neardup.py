"""Near-duplicates by DartMinHash: sparse weighted signatures, banded joins, exact links.

The weight of a shingle is how often it occurs.  Hashed darts fall on the plane
(weight, rank) of every element at rate one; a text keeps those below its own weights.
Of the darts with a rank of at most t / total weight, about t for every text, the
earliest in each of k coordinates is the signature.  Two texts agree in a coordinate
with the probability of their weighted Jaccard similarity, and only the few darts that
a text keeps are ever made.

Texts with the same words are folded first.  Bands of the signature make buckets; in a
small bucket all texts are compared, in a large one each with the bucket's leader.  A
second pass gives the texts of large buckets other leaders, chosen anew in every band,
and compares them where the first pass has not joined them yet.  What is still apart
after that is compared in full: texts of one bucket meet in blocks of bounded size, and
no pair of different classes is left out.  Links are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm import flat
from lexlake.llm.graph import components
from lexlake.llm.shared import stored

WORDS = 5
BANDS, ROWS = 26, 5
#: A pair of similarity 0.8 misses all of 26 bands of 5 with probability 3e-5.
SIMILARITY = 0.8
#: Buckets of more texts are compared by leaders.
SMALL = 8
#: Texts and weight units of a block; two blocks of a large bucket meet in one task.
MEET, MEET_UNITS = 256, 2_000_000
#: Shared weight units that are counted at once.
COLUMNS = 4096
#: Texts whose darts are thrown at once.
AT_ONCE = 256
_STEP, _OCCURRENCE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9


def word_names(texts: list[str | None]) -> list[np.ndarray]:
    """The names of the lower-case words of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for owners, held in flat.blocks(texts):
        cps, fill = flat.laid_out([t.lower() for t in held])
        start, end = flat.words(cps, fill)
        name = flat.names(cps, start, end)
        edge = np.searchsorted(start, fill)
        for i, owner in enumerate(owners.tolist()):
            out[owner].append(name[edge[i - 1] if i else 0 : edge[i]])
    return [np.concatenate(x) for x in out]


def elements(words: np.ndarray) -> np.ndarray:
    """Sorted names of the weight units of a text: the n-th occurrence of a shingle is a
    unit of its own, so that weighted similarity is that of these sets.  A text of
    fewer than five words is one shingle."""
    if not len(words):
        return words
    size = min(WORDS, len(words))
    power = flat.powers(_WORD, size)
    n = len(words) - size + 1
    shingle = np.sort(flat.mix(sum(words[k : k + n] * power[k] for k in range(size)) + np.uint64(size)))
    first = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.sort(flat.mix(shingle + nth.astype(np.uint64) * _OCCURRENCE))


def signatures(units: list[np.ndarray], k: int) -> np.ndarray:
    """k names of darts for each text; none of the texts is empty."""
    out = np.zeros((len(units), k), np.uint64)
    left = np.arange(len(units))
    darts = k * math.log(k) + 2 * k  # then one text in seven has to throw again
    while len(left):
        size = np.fromiter((len(units[i]) for i in left), np.int64, len(left))
        most = darts / size
        owner = np.repeat(np.arange(len(left)), size)
        seed = np.concatenate([units[i] for i in left])
        rank = np.zeros(len(seed))
        best = np.full(len(left) * k, np.inf)
        slots, ranks, names = [], [], []
        while len(seed):
            seed = seed + _STEP
            h = flat.mix(seed)
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            keep = rank <= most[owner]
            owner, seed, rank = owner[keep], seed[keep], rank[keep]
            dart = flat.mix(h[keep] ^ _OCCURRENCE)
            slots.append(owner * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            names.append(dart)
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        made = np.zeros(len(left) * k, np.uint64)
        made[slot[won]] = name[won]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        out[left[full]] = made.reshape(-1, k)[full]
        left = left[~full]
        darts *= 2
    return out


def banded(signature: np.ndarray) -> np.ndarray:
    """One name for each band of a signature."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        out = flat.mix(out * _STEP + signature[:, r::ROWS])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            words = word_names(part.column(1).to_pylist())
            some = [i for i, w in enumerate(words) if len(w)]
            content: list[bytes | None] = [None] * len(words)
            bands: list[np.ndarray | None] = [None] * len(words)
            for i in some:
                content[i] = hashlib.blake2b(words[i].tobytes(), digest_size=16).digest()
            if some:
                for i, row in zip(some, banded(signatures([elements(words[i]) for i in some], BANDS * ROWS)), strict=True):
                    bands[i] = row.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(content, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["node", "content", "bands"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [elements(w).view(np.int64) for w in word_names(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.int64()))], ["node", "units"])


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weight units agree well enough."""
    mine, theirs = F.col("x.units"), F.col("y.units")
    joined = pairs.join(units.alias("x"), F.col("a") == F.col("x.node")).join(units.alias("y"), F.col("b") == F.col("y.node"))
    # lists of very different lengths cannot be similar
    fits = F.least(F.size(mine), F.size(theirs)) >= SIMILARITY * F.greatest(F.size(mine), F.size(theirs))
    both = F.size(F.array_intersect(mine, theirs))
    scored = joined.filter(fits).select("a", "b", (both / (F.size(mine) + F.size(theirs) - both)).alias("similarity"))
    return scored.filter(F.col("similarity") >= SIMILARITY)


def shared_units(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many weight units each text of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)))
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    sides = []
    for texts in (x, y):
        units = np.concatenate(texts)
        at = np.minimum(np.searchsorted(both, units), max(len(both) - 1, 0))
        hit = both[at] == units if len(both) else np.zeros(len(units), bool)
        at, row = at[hit], np.repeat(np.arange(len(texts)), [len(t) for t in texts])[hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], len(texts)))
    for first in range(0, len(both), COLUMNS):
        tables = []
        for at, row, n in sides:
            part = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            table = np.zeros((n, COLUMNS), np.float32)
            table[row[part], at[part] - first] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _meet(cell: pa.Table) -> pa.Table:
    """Links (a, b) that join all classes of a cell that have similar texts: its first
    side against its second one, or against itself where there is no second."""
    node, root = cell.column("node").combine_chunks(), cell.column("root").combine_chunks()
    units = [np.asarray(u.values) for u in cell.column("units").combine_chunks()]
    size = np.fromiter(map(len, units), np.int64, len(units))
    root = np.unique(np.asarray(root.to_pylist()), return_inverse=True)[1]
    x, y = (np.flatnonzero(np.asarray(cell.column("side")) == side) for side in (0, 1))
    if np.all(np.asarray(cell.column("i")) == np.asarray(cell.column("j"))):
        y = x
    # lists of very different lengths cannot be similar
    fits = (root[x][:, None] != root[y]) & (np.minimum(size[x][:, None], size[y]) >= SIMILARITY * np.maximum(size[x][:, None], size[y]))
    x, y, fits = x[fits.any(axis=1)], y[fits.any(axis=0)], fits[np.ix_(fits.any(axis=1), fits.any(axis=0))]
    a, b = [], []
    if len(x):
        both = shared_units([units[i] for i in x], [units[i] for i in y])
        found = np.argwhere(fits & (both / (size[x][:, None] + size[y] - both) >= SIMILARITY))
        # one link for two classes that others have not joined yet
        top = np.arange(len(root))
        for p, q in zip(x[found[:, 0]].tolist(), y[found[:, 1]].tolist(), strict=True):
            one, two = top[root[p]], top[root[q]]
            if one != two:
                top[top == two] = one
                a.append(p)
                b.append(q)
    return pa.table([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])


def _across(open_: DataFrame, units: DataFrame) -> DataFrame:
    """Links (a, b) between all texts (bucket, node, root) of one bucket and different
    roots.  Those of the bucket's most frequent root meet only the others, and the
    others each other, both in blocks; every two blocks are a group of their own."""
    sized = stored(open_.join(units.groupBy("node").agg(F.sum(F.size("units")).alias("size")), "node"), "sized")
    groups = sized.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    most = groups.groupBy("bucket").agg(F.max(F.struct("n", "w", "root")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / MEET), F.ceil(w / MEET_UNITS)).cast("int")
    n, w = F.col("most.n"), F.col("most.w")
    plan = most.select("bucket", F.col("most.root").alias("main"), blocks(n, w).alias("mains"), blocks(F.col("n") - n, F.col("w") - w).alias("others"))
    main = F.col("root") == F.col("main")
    salted = sized.join(plan, "bucket").withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    salt = F.col("salt")
    of_main = each("others", lambda x: cell(x, -1 - salt, 1))
    of_other = F.concat(
        each("others", lambda x: cell(F.least(x, salt), F.greatest(x, salt), F.when(x < salt, 1).otherwise(0))),
        each("mains", lambda x: cell(salt, -1 - x, 0)))
    dealt = salted.select("bucket", "node", "root", F.explode(F.when(main, of_main).otherwise(of_other)).alias("c"))
    dealt = dealt.select("bucket", "node", "root", "c.i", "c.j", "c.side").join(units, "node")
    kind = units.schema["node"].dataType
    return dealt.groupBy("bucket", "i", "j").applyInArrow(_meet, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The (bucket, node, root) of the buckets whose texts are not all of one root."""
    large = large.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = large.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return stored(large.join(mixed, "bucket"), "open")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) of every row: texts of weighted similarity 0.8 or more over five
    lower-case words, and whoever is joined to them by others, form a class, named by
    its least key.

    Texts without words and rows with a null key stand alone; a null key has a null
    class.  Of rows with one key and several texts each has the class of its own text.
    An empty table gives no rows.
    """
    node = T.StructField("node", docs.schema[key].dataType)
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("__text"))
    signed = stored(texts.mapInArrow(_sign, T.StructType([
        node, T.StructField("content", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])), "signatures")
    usable = signed.filter("node IS NOT NULL AND content IS NOT NULL")
    # equal content has equal bands, any of them will do
    folded = stored(usable.groupBy("content").agg(F.min("node").alias("node"), F.first("bands").alias("bands")), "folded")

    entries = folded.select("node", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
    shared = stored(entries.join(sizes, "bucket"), "buckets")
    small = shared.filter(F.col("n") <= SMALL).select("bucket", "node")
    within = small.join(small.withColumnRenamed("node", "other"), "bucket").filter("node < other").select(*_pair("node", "other"))
    led = shared.filter((F.col("n") > SMALL) & (F.col("node") != F.col("leader"))).select(*_pair("node", "leader"))
    pairs = stored(within.union(led).distinct(), "pairs")

    involved = stored(shared.select("node").distinct(), "involved")
    held = texts.filter("node IS NOT NULL").join(involved, "node", "left_semi")
    units = stored(held.mapInArrow(_unite, T.StructType([node, T.StructField("units", T.ArrayType(T.LongType()))])), "units")
    links = stored(_verified(pairs, units).select("a", "b"), "verified")
    roots = components(links)

    # large buckets once more: leaders of each band's own, across what is not joined yet
    large = shared.filter(F.col("n") > SMALL).select("bucket", "node")
    open_ = _open(large, roots).withColumn("h", F.xxhash64("bucket", "node"))
    own = F.struct("h", "node", "root")
    leaders = open_.groupBy("bucket").agg(F.array(F.min(own), F.max(own)).alias("leaders")).select("bucket", F.explode("leaders").alias("l"))
    again = open_.join(leaders, "bucket").filter(F.col("root") != F.col("l.root")).select("node", F.col("l.node").alias("other"))
    more = _verified(again.select(*_pair("node", "other")).distinct().join(pairs, ["a", "b"], "left_anti"), units).select("a", "b")
    links = stored(links.union(more), "verified")
    roots = components(links)

    # and all that is still apart in one bucket
    apart = _open(large, roots)
    if not apart.isEmpty():
        roots = components(links.union(_across(apart, units)))

    named = folded.select("content", "node").join(roots, "node", "left").select("content", F.coalesce("root", "node").alias("class_id"))
    return signed.select("node", "content").join(named, "content", "left").select(
        F.col("node").alias(key), F.when(F.col("node").isNotNull(), F.coalesce("class_id", "node")).alias("class_id"))
