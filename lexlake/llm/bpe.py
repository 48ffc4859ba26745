"""Byte-level BPE by recursive DuckDB queries inside the partitions.

Encoding: the distinct pre-tokens that a task meets become rows (word, place, next
place, token, next token).  A recursive query joins them with the merge table, picks
for each word the leftmost pair of minimum rank and contracts it, until no word has a
pair left.  Decoding: the ids join the vocabulary, and an ordered aggregation puts the
bytes of a text together.  No shuffle; a task keeps what it knows about at most some
hundred thousand words, and a block of texts.

A recursion keeps all its rounds, so a query takes as many words as keep the sum of
their squared lengths small; the few words that are longer than that allows are
contracted by a heap, and DuckDB never writes to the worker's disk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexlake.llm import flat

#: Words of more bytes contract all places of the minimum pair in one round.
LONG = 64
#: Words of more bytes are contracted by a heap instead.
LONGEST = 1024
#: Words, and their squared lengths summed up, that one query takes: what bounds its memory.
AT_ONCE, SQUARES = 50_000, 1 << 24

_ONE = """
WITH RECURSIVE s AS (
 SELECT w, i, q, t, nt, 0 AS r FROM start_rows
 UNION ALL
 (WITH k AS (SELECT w, min((c::BIGINT << 32) | i) AS k, arg_min(q, (c::BIGINT << 32) | i) AS hq
             FROM s JOIN merges m ON m.a = s.t AND m.b = s.nt GROUP BY w),
  d AS (SELECT k.w, (k & 4294967295)::INTEGER AS hi, hq, (k >> 32)::INTEGER AS hc, s.q AS dq, s.nt AS dnt FROM s JOIN k ON s.i = k.hq)
  SELECT s.w, s.i, CASE WHEN s.i = hi THEN dq ELSE s.q END, CASE WHEN s.i = hi THEN hc ELSE s.t END,
         CASE WHEN s.i = hi THEN dnt WHEN s.q = hi THEN hc ELSE s.nt END, r + 1
  FROM s JOIN d ON s.w = d.w WHERE s.i <> d.hq))
SELECT s.w, s.t FROM s JOIN (SELECT w, max(r) AS r FROM s GROUP BY w) USING (w, r) ORDER BY s.i
"""
# The same for long words: every place of the minimum pair, from the left and without overlaps.
_ALL = """
WITH RECURSIVE s AS (
 SELECT w, i, t, 0 AS r FROM start_rows
 UNION ALL
 SELECT w, i, t, r + 1 FROM (
  SELECT w, i, r, CASE WHEN hit THEN c ELSE t END AS t, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY i), FALSE) AS gone FROM (
   SELECT *, c = least_c AND (n - coalesce(max(CASE WHEN c = least_c THEN NULL ELSE n END) OVER (PARTITION BY w ORDER BY i), 0)) % 2 = 1 AS hit FROM (
    SELECT x.*, c, min(c) OVER (PARTITION BY w) AS least_c FROM (
     SELECT w, i, t, r, lead(t) OVER (PARTITION BY w ORDER BY i) AS nt, row_number() OVER (PARTITION BY w ORDER BY i) AS n FROM s) x
    LEFT JOIN merges m ON m.a = x.t AND m.b = x.nt)
   WHERE least_c IS NOT NULL))
 WHERE NOT gone)
SELECT s.w, s.t FROM s JOIN (SELECT w, max(r) AS r FROM s GROUP BY w) USING (w, r) ORDER BY s.i
"""
_DECODE = "SELECT doc, string_agg(h, '' ORDER BY pos) AS h FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """DuckDB tables of one vocabulary, for one task."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '600MB'; SET temp_directory = ''")
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a = np.array(merges, np.int32).reshape(-1, 3)
        self.pairs = {left << 32 | right: (made, made) for left, right, made in merges}
        self._table("merges", {"a": a[:, 0], "b": a[:, 1], "c": a[:, 2]})
        self._table("vocabulary", {"id": np.array(list(ranks.values()), np.int32), "h": [t.hex() for t in ranks]})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("new_rows", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM new_rows")
        self.con.unregister("new_rows")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words behind each other, how many each has)."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        ids: list[np.ndarray] = []
        of: list[np.ndarray] = []
        for which, query in ((np.flatnonzero(size <= LONG), _ONE), (np.flatnonzero((size > LONG) & (size <= LONGEST)), _ALL)):
            squares = np.cumsum(size[which] ** 2)
            k = 0
            while k < len(which):
                most = int(np.searchsorted(squares, (squares[k - 1] if k else 0) + SQUARES, "right"))
                part = which[k : max(k + 1, min(k + AT_ONCE, most))]
                w, t = self._merged([data[x] for x in part], query)
                ids.append(t)
                of.append(part[w])
                k += len(part)
        for x in np.flatnonzero(size > LONGEST).tolist():
            left = flat.merged(self.byte[np.frombuffer(data[x], np.uint8)].tolist(), self.pairs)
            ids.append(np.array(left, np.int32))
            of.append(np.full(len(left), x))
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, token = np.concatenate(of), np.concatenate(ids)
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _merged(self, data: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, data), np.int64, len(data))
        token = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(data), dtype=np.int32), size)
        place = np.arange(len(token), dtype=np.int32)
        after = np.full(len(token), -1, np.int32)
        same = word[1:] == word[:-1]
        after[:-1][same] = token[1:][same]
        self.con.register("start_rows", pa.table({"w": word, "i": place, "q": place + np.int32(1), "t": token, "nt": after}))
        out = self.con.execute(query).fetchnumpy()
        self.con.unregister("start_rows")
        return np.asarray(out["w"]), np.asarray(out["t"])

    def decode(self, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(texts that have ids, their bytes); ``ids`` are in the order of each text."""
        self.con.register("ids", pa.table({"doc": doc.astype(np.int32), "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        out = self.con.execute(_DECODE).fetchnumpy()
        self.con.unregister("ids")
        return np.asarray(out["doc"]), [bytes.fromhex(h) for h in out["h"]]


def _encoded(texts: list[str | None], known: flat.Known) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block after the other: (text of each pre-token, its row in ``known``,
    how many ids it has)."""
    for owners, held in flat.blocks(texts):
        cps, fill = flat.laid_out(held)
        start, end = flat.pretokens(cps, fill)
        row = known.rows(cps, start, end)
        yield owners[np.searchsorted(fill, start)], row, known.count[row]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True, rows: int = 1000) -> DataFrame:
    """All rows of ``df`` with the array ``ids`` of their texts; null and empty texts
    have an empty one.  A column of that name is replaced, others are left alone, but
    for the text if ``keep_text`` is false.  A task gives out ``rows`` rows at a time."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    place = df.columns.index(text)
    kept = [c for c in df.columns if c != ids and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    at = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flat.Known(Bpe(ranks.value).encode)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                n = batch.num_rows
                count = np.zeros(n, np.int64)
                found = [np.zeros(0, np.int32)]
                for owner, row, size in _encoded(batch.column(place).to_pylist(), known):
                    count += np.bincount(owner, size, n).astype(np.int64)
                    found.append(known.values[flat.ragged(known.first[row], size)])
                edge = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
                lists = pa.ListArray.from_arrays(edge, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [lists], [*kept, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """All rows of ``df`` with the bytes ``data`` of their ids; no ids, or a null array,
    give no bytes.  A column of that name is replaced."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    place = df.columns.index(ids)
    kept = [c for c in df.columns if c != data]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(data, T.BinaryType())])
    at = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks.value)
        for batch in batches:
            lists = batch.column(place).fill_null([])
            size = np.asarray(lists.value_lengths(), np.int64)
            out = [b""] * batch.num_rows
            for doc, found in zip(*bpe.decode(np.repeat(np.arange(batch.num_rows), size), np.asarray(lists.flatten())), strict=True):
                out[doc] = found
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [pa.array(out, pa.binary())], [*kept, data])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: its text encoded, and
    its ids decoded again.  The ids and bytes stay in the task, a block at a time.
    Null and empty texts have no ids and the hash of nothing."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks.value)
        known = flat.Known(bpe.encode)
        for batch in batches:
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            written = [hashlib.sha256() for _ in range(n)]
            decoded = [hashlib.sha256() for _ in range(n)]
            for owner, row, size in _encoded(batch.column(1).to_pylist(), known):
                ids = known.values[flat.ragged(known.first[row], size)]
                doc = np.repeat(owner, size)
                for d, found in zip(*bpe.decode(doc, ids), strict=True):
                    decoded[d].update(found)
                edge = np.flatnonzero(np.concatenate([doc[:1] >= 0, doc[1:] != doc[:-1]]))
                for a, b in zip(edge.tolist(), np.append(edge[1:], len(doc)).tolist()[: len(edge)], strict=True):
                    d = int(doc[a])
                    written[d].update((b"," if count[d] else b"") + ",".join(map(str, ids[a:b].tolist())).encode())
                    count[d] += b - a
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array([h.hexdigest() for h in written]), pa.array([h.hexdigest() for h in decoded])],
                schema.names)

    return df.select(key, text).mapInArrow(run, schema)
