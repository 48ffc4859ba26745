"""The trie of all conversations, as balanced parentheses.

Every conversation is rebuilt from the head of its base conversation and its own rest.
A prefix is named by a 128-bit sum of hashes of (depth, turn), so that equal prefixes
meet in one aggregation without any conversation being held as a whole.

The smallest member of a node owns it.  Along a conversation owners only grow, so each
conversation owns at most one path, which hangs on a node of a smaller one.  The chain of
(depth, owner) where a path hangs on the next is a key: sorted by it, the nodes stand in
preorder, whatever the shape of the trie.  The nodes are cut into shards of that order.
A shard writes its nodes as parentheses and keeps the least and the largest excess of
blocks of 1, 2, 4, ... of them; *findclose* climbs those blocks and delimits every
subtree, ranks of "()" count its leaves and cumulative sums give its savings.

The nodes still open at the end of a shard are the spine that it shares with later ones:
their subtrees end in the first shard that comes up to their depth, at the step where it
does so, and the totals of the shards between are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.llm.shared import stored

#: Nodes that a shard holds at most, by and large.
SHARD = 1 << 19
#: Turns of a conversation whose sums one task works out.
STRETCH = 1 << 14
_LANES = [f"s{i}" for i in range(4)]
_FAR = np.iinfo(np.int64).max


class Parentheses:
    """A stretch of a preorder as parentheses, with the excess of its blocks."""

    def __init__(self, depth: np.ndarray, last_is_leaf: bool):
        """``depth`` of the nodes in preorder; the first one may be at any depth."""
        n = len(depth)
        closes = np.zeros(n, np.int64)
        closes[1:] = depth[:-1] + 1 - depth[1:]
        self.open = np.arange(n) + np.cumsum(closes)
        self.bits = np.zeros(int(self.open[-1]) + 1 + last_is_leaf if n else 0, bool)
        self.bits[self.open] = True
        self.opens_before = np.append(0, np.cumsum(self.bits))
        pair = self.bits.copy()
        pair[:-1] &= ~self.bits[1:]
        pair[-1:] = False
        self.pairs_before = np.append(0, np.cumsum(pair))
        excess = np.cumsum(np.where(self.bits, 1, -1))
        size = 1 << max(len(excess) - 1, 0).bit_length()
        low, high = np.full(size, _FAR), np.full(size, -_FAR)
        low[: len(excess)] = high[: len(excess)] = excess
        self.low, self.high = [low], [high]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low.append(low)
            self.high.append(high)

    def find_close(self) -> np.ndarray:
        """Place of the parenthesis that closes each node; the number of parentheses
        where it is still open at the end.

        Excess changes by one, so a block holds a value if it lies between its least
        and its largest one: climb until a block holds the wanted one, then descend.
        """
        out = np.full(len(self.open), len(self.bits))
        who = np.arange(len(self.open))
        wanted = self.low[0][self.open] - 1
        at = self.open + 1
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for level in range(len(self.low)):
            inside = at < len(self.low[level])
            who, at = who[inside], at[inside]
            holds = (self.low[level][at] <= wanted[who]) & (wanted[who] <= self.high[level][at])
            found.append((level, who[holds], at[holds]))
            who, at = who[~holds], at[~holds]
            left = np.flatnonzero((at & 1) == 0)  # the sibling of a left block comes next
            if len(left) and level < len(self.low) - 1:
                sibling = at[left] + 1
                holds = (self.low[level][sibling] <= wanted[who[left]]) & (wanted[who[left]] <= self.high[level][sibling])
                found.append((level, who[left[holds]], sibling[holds]))
                who, at = np.delete(who, left[holds]), np.delete(at, left[holds])
            at = (at >> 1) + 1
        for level, who, at in found:
            for lower in range(level - 1, -1, -1):
                at = at * 2
                at = at + ~((self.low[lower][at] <= wanted[who]) & (wanted[who] <= self.high[lower][at]))
            out[who] = at
        return out


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (c, d, digest, words, last) of every turn of every rebuilt
    conversation, d from 1; (c, length) of every conversation.

    Turns are ordered by turn (null first), then by role and the SHA-256 of role and
    text.  They are dealt by ranges of that order, so that one conversation can be many
    tasks; a position is the place within a range behind the ranges before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    # equal rows can stand in any order: the last column lets ranges part them
    turns = stored(turns, "turns").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, n = None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            at = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
            if c[0] == last:
                at[: first[1] if len(first) > 1 else len(c)] += n
            last, n = c[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(c), part, np.int32)), pa.array(at)],
                                             ["c", "digest", "words", "part", "at"])

    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "words")
    placed = stored(dealt.mapInArrow(place, "c long, digest binary, words long, part int, at long"), "placed")

    # (conversation, range): few rows for each conversation, and few turns for each of them
    ranges = placed.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("c", "part", before.alias("before"), F.sum("n").over(W.partitionBy("c")).alias("n"))
    base = F.col("c") - F.col("c") % 20
    head = F.when(F.col("c") == base, F.lit(0)).otherwise(F.pmod(F.crc32(F.col("c").cast("string")), F.lit(4)))
    sizes = ranges.groupBy("c").agg(F.max("n").alias("n")).withColumns({"base": base, "h": head})
    bases = sizes.filter("c = base").select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    whole = sizes.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0))))
    whole = stored(whole.select("c", "n", "base", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")

    shift = ranges.select("c", "part", "before").join(whole.select("c", "h", "take", "length"), "c")
    own = placed.join(shift, ["c", "part"]).withColumn("p", F.col("before") + F.col("at"))
    heads = stored(own.filter("c = c - c % 20 AND p < 3").select(F.col("c").alias("base"), "p", "digest", "words"), "heads")
    own = own.filter("p >= h").withColumn("d", F.col("p") - F.col("h") + F.col("take") + 1)
    lent = heads.join(whole.filter("take > 0"), "base").filter("p < take").withColumn("d", F.col("p") + 1)
    columns = ["c", "d", "digest", "words", (F.col("d") == F.col("length")).alias("last")]
    return own.select(*columns).union(lent.select(*columns)), whole.select("c", "length")


def named(turns: DataFrame) -> DataFrame:
    """(c, d, words, last, k0, k1): the name of every prefix, a sum over its turns.
    Sums are taken within stretches of a conversation, and those of earlier stretches
    added."""
    term = F.sha2(F.concat(F.col("d").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    lanes = {s: F.conv(F.substring(F.col("_term"), 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(_LANES)}
    cut = turns.withColumn("_term", term).select("c", "d", "words", "last", F.floor(F.col("d") / STRETCH).cast("long").alias("cut"), *[v.alias(s) for s, v in lanes.items()])
    inside = W.partitionBy("c", "cut").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({s: F.sum(s).over(inside) for s in _LANES})
    totals = cut.groupBy("c", "cut").agg(*[F.sum(s).alias(s) for s in _LANES])
    earlier = W.partitionBy("c").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("c", "cut", *[F.sum(s).over(earlier).alias(f"{s}_before") for s in _LANES]).filter("cut > 0")
    mask = F.lit((1 << 32) - 1)
    whole = lambda s: (F.col(s) + F.coalesce(f"{s}_before", F.lit(0))).bitwiseAND(mask)
    pair = lambda a, b: F.shiftleft(whole(a), 32).bitwiseOR(whole(b))
    return local.join(carried, ["c", "cut"], "left").select("c", "d", "words", "last", pair("s0", "s1").alias("k0"), pair("s2", "s3").alias("k1"))


def _ends(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256) of the nodes where conversations end.  SHA-256 goes from
    front to back, so the ids of one node pass one task, sorted outside of memory and
    hashed as they come; only ids do."""
    zero = F.lit(0).cast("long")
    at = names.filter("last").select("k0", "k1", "c").union(sizes.filter("length = 0").select(zero.alias("k0"), zero.alias("k1"), "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            k0, k1, c = (batch.column(i).to_numpy() for i in range(3))
            if not len(c):
                continue
            edge = np.append(np.flatnonzero(np.append(True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]))), len(c)).tolist()
            done = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                ids = ",".join(map(str, c[a:b].tolist())).encode()
                if held == (k0[a], k1[a]):
                    digest.update(b"," + ids)
                else:
                    if held is not None:
                        done.append((*held, digest.hexdigest()))
                    held, digest = (k0[a], k1[a]), hashlib.sha256(ids)
            yield _batch(done)
        if held is not None:
            yield _batch([(*held, digest.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["k0", "k1", "ends_sha256"])

    return at.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "c").mapInArrow(run, "k0 long, k1 long, ends_sha256 string")


_SHARED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, k0 long, k1 long"
_SHARD = f"{_SHARED}, shard long, leaf long, saved long, n_leaves long, saved_tokens long, open boolean, step_high long, leaves_before long, saved_before long"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard with what their subtrees hold there."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    depth, children, saved = (whole[c].to_numpy() for c in ("depth", "n_children", "saved"))
    tree = Parentheses(depth, bool(children[-1] == 0))
    close = tree.find_close()
    cum = np.append(0, np.cumsum(saved))
    leaves = np.append(0, np.cumsum(children == 0))
    n_leaves = tree.pairs_before[close] - tree.pairs_before[tree.open]
    inside = cum[tree.opens_before[close]] - cum[:-1]
    lowest = np.append(_FAR, np.minimum.accumulate(depth)[:-1])
    step = (depth < lowest) & (np.arange(len(depth)) > 0)
    table = whole.select(_names(_SHARED))
    for name, values in (("shard", np.full(len(depth), TaskContext.get().partitionId(), np.int64)), ("leaf", (children == 0).astype(np.int64)), ("saved", saved),
                         ("n_leaves", n_leaves), ("saved_tokens", inside), ("open", close == len(tree.bits)), ("step_high", pa.array(lowest - 1, mask=~step)),
                         ("leaves_before", leaves[:-1]), ("saved_before", cum[:-1])):
        table = table.append_column(name, pa.array(values) if isinstance(values, np.ndarray) else values)
    yield from table.to_batches(max_chunksize=1 << 16)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _merged(shards: DataFrame, number: int) -> DataFrame:
    """The nodes of all shards with whole subtrees.  The driver gets three numbers for
    each shard."""
    out = [*_names(_SHARED), "n_leaves", "saved_tokens"]
    least, leaves, saved = np.full(number, _FAR), np.zeros(number + 1, np.int64), np.zeros(number + 1, np.int64)
    for r in shards.groupBy("shard").agg(F.min("depth").alias("depth"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).collect():
        least[r["shard"]], leaves[r["shard"] + 1], saved[r["shard"] + 1] = r["depth"], r["leaf"], r["saved"]
    leaves, saved = np.cumsum(leaves), np.cumsum(saved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, depth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.full(len(shard), number)
            for s in np.unique(shard).tolist():
                of = np.flatnonzero(shard == s)
                falling = np.minimum.accumulate(least[s + 1 :]) if s + 1 < number else np.zeros(0, np.int64)
                ends[of] = s + 1 + np.searchsorted(-falling, -depth[of], "left")
            add = [pa.array(total[ends] - total[shard + 1]) for total in (leaves, saved)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends), *add],
                                             ["shard", "depth", "conv_id", "ends", "leaves_between", "saved_between"])

    still = shards.filter("open")
    between = still.select("shard", "depth", "conv_id").mapInArrow(run, "shard long, depth long, conv_id long, ends long, leaves_between long, saved_between long")
    steps = shards.filter("step_high IS NOT NULL").select(F.col("shard").alias("ends"), F.explode(F.sequence("depth", "step_high")).alias("depth"), "leaves_before", "saved_before")
    rest = between.join(steps, ["ends", "depth"], "left").select(
        "conv_id", "depth", (F.col("leaves_between") + F.coalesce("leaves_before", F.lit(0))).alias("more_leaves"),
        (F.col("saved_between") + F.coalesce("saved_before", F.lit(0))).alias("more_saved"))
    grown = still.drop("leaves_before", "saved_before").join(rest, ["conv_id", "depth"]).withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("more_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("more_saved")})
    return shards.filter("NOT open").select(*out).union(grown.select(*out))


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for every node: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation; a null role or text is an empty
    one; a null turn comes first.  Repeated rows are turns of their own.  Very long
    texts are read whole, but only their digest and number of words are passed on.  An
    empty table gives no node, not even a root.  Other columns are not looked at.
    """
    spark = conversations.sparkSession
    turns, sizes = rebuilt(conversations)
    names = stored(named(turns), "prefixes")
    first = sizes.agg(F.min("c").alias("c"), F.count("*").alias("n")).first()
    if first["c"] is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = int(first["c"])

    nodes = names.groupBy("k0", "k1").agg(F.min("c").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = stored(nodes, "nodes")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.min_by(F.struct("k0", "k1"), "depth").alias("k"))
    paths = stored(paths.select("conv_id", "top", "end", "k.*"), "paths")

    # where the paths above it hang on each other, for every owner
    hangs = paths.filter(F.col("conv_id") != root).select("k0", "k1", F.col("conv_id").alias("owner"), "top")
    met = names.select("c", "k0", "k1").join(hangs, ["k0", "k1"]).join(paths.select(F.col("conv_id").alias("c")), "c", "left_semi")
    links = F.array_sort(F.collect_list(F.struct(F.col("top") - 1, "owner")))
    chains = met.groupBy("c").agg(F.flatten(F.transform(links, lambda x: F.array(x["col1"], x["owner"]))).alias("chain"))
    chains = paths.drop("k0", "k1").join(chains.withColumnRenamed("c", "conv_id"), "conv_id", "left")
    chains = chains.withColumn("chain", F.coalesce("chain", F.array().cast("array<bigint>")))
    above = F.when(F.size("chain") >= 4, F.get("chain", F.size("chain") - 3)).otherwise(F.lit(root))
    chains = stored(chains.withColumn("above", above), "chains")

    hung = chains.filter(F.col("conv_id") != root).groupBy(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    zero = F.lit(0).cast("long")
    top = spark.range(1).select(zero.alias("k0"), zero.alias("k1"), F.lit(root).cast("long").alias("conv_id"), zero.alias("depth"),
                                F.lit(first["n"]).cast("long").alias("n_convs"), zero.alias("words"))
    placed = nodes.select(*top.columns).union(top).join(chains, "conv_id", "left").join(hung, ["conv_id", "depth"], "left")
    parent: Column = F.when(F.col("depth") == 0, F.lit(None)).when((F.col("depth") == F.col("top")), F.col("above")).otherwise(F.col("conv_id"))
    children = F.coalesce("hung", F.lit(0)) + F.coalesce(F.col("depth") < F.col("end"), F.lit(False)).cast("long")
    placed = placed.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", children.alias("n_children"), "k0", "k1",
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                           F.concat(F.coalesce("chain", F.array().cast("array<bigint>")), F.array("depth")).alias("key"))
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // shard))
    dealt = stored(placed, "placed").repartitionByRange(number, "key").sortWithinPartitions("key").drop("key")
    shards = stored(dealt.mapInArrow(_shard, _SHARD), "shards")
    ends = _ends(names, sizes)
    done = _merged(shards, max(number, 1 + (shards.agg(F.max("shard")).first()[0] or 0))).join(ends, ["k0", "k1"], "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same rows in SQL.  CRC-32 goes bit by bit: a byte is mixed in, then eight steps follow.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
 coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, c - c % 20 AS b, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 END AS h FROM t GROUP BY c),
r AS (SELECT n.c, 0 AS part, p, role, text FROM n JOIN t ON t.c = n.b WHERE p < h UNION ALL SELECT n.c, 1, p, role, text FROM n JOIN t ON t.c = n.c WHERE p >= h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, sha256(length(role)::VARCHAR || ':' || role || text) AS g,
 len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM r),
k AS (SELECT c, d, w, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS k, count(*) OVER (PARTITION BY c) AS n FROM o
 UNION ALL SELECT n.c, 0, 0, '', (SELECT count(*) FROM o WHERE o.c = n.c) FROM n),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w FROM k GROUP BY k, d),
kids AS (SELECT k[:64 * (d - 1)] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT k[:64 * e] AS k, sum((n_convs - 1) * w) AS saved, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves
 FROM (SELECT *, unnest(range(d + 1)) AS e FROM node LEFT JOIN kids USING (k)) GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM k WHERE d = n GROUP BY k)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM node LEFT JOIN kids USING (k) JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.k = node.k[:64 * (node.d - 1)]
"""
