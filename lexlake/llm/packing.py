"""Packed token ids: best-fit-decreasing bins of a fixed length, as binary rows.

Every task encodes its texts, cuts those longer than a row into full stretches and a
rest, and packs the stretches of a window, longest first, each into the row with the
least room that still holds it.  A segment tree over the rooms 0..length finds that
row in log(length) steps.  Nothing is shuffled: where a row's stretches come from does
not matter for training, and a window of some million tokens fills rows as well as
the whole corpus would.  Each row names the document and offset of its stretches, so
that the ids of every document can be put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm import flat
from lexlake.llm.bpe import load_ranks


class Rooms:
    """Which rooms (free places of open rows) exist: a segment tree over 0..most."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.used[i]:
            self.used[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of a row with the smallest room of at least ``least``."""
        i = least + self.size
        if not self.used[i]:
            while i > 1 and (i & 1 or not self.used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.used[2 * i])
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.used[i] = 0
            i >>= 1
            while i and not (self.used[2 * i] or self.used[2 * i + 1]):
                self.used[i] = 0
                i >>= 1
        return room, row


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of item numbers: items by falling length, earlier ones first among equals,
    each into the fullest row that still holds it."""
    rooms = Rooms(length)
    rows: list[list[int]] = []
    order = np.argsort(-lengths, kind="stable")
    for item, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = rooms.take(n) if n < length else None
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > n:
            rooms.put(room - n, row)
    return rows


class Window:
    """The stretches that wait to be packed."""

    def __init__(self, length: int, pad: int, kind: np.dtype):
        self.length, self.pad, self.kind = length, pad, kind
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.offsets: list[int] = []
        self.tokens = 0

    def add(self, doc, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.length):
            part = ids[at : at + self.length]
            self.ids.append(part.astype(self.kind))
            self.docs.append(doc)
            self.offsets.append(at)
            self.tokens += len(part)

    def batch(self, names: list[str], doc_type: pa.DataType) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        rows = best_fit(lengths, self.length)
        order = np.fromiter((i for r in rows for i in r), np.int64, len(self.ids))
        per_row = np.fromiter(map(len, rows), np.int64, len(rows))
        edge = np.append(0, np.cumsum(per_row))
        size = lengths[order]
        total = np.append(0, np.cumsum(size))
        used = total[edge[1:]] - total[edge[:-1]]
        matrix = np.full((len(rows), self.length), self.pad, self.kind)
        row = np.repeat(np.arange(len(rows)), per_row)
        inside = total[:-1] - total[edge[row]]
        matrix.reshape(-1)[flat.ragged(row * self.length + inside, size)] = np.concatenate([self.ids[i] for i in order])
        # cumulative lengths: 0 and the end of every segment, so one more than segments
        ends = np.zeros(len(order) + len(rows), np.int32)
        ends[np.arange(len(order)) + row + 1] = inside + size
        lists = lambda values, edges: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
        width = self.length * self.kind.itemsize
        binary = pa.Array.from_buffers(pa.large_binary(), len(rows), [
            None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * width), pa.py_buffer(matrix)]).cast(pa.binary())
        out = pa.RecordBatch.from_arrays([
            binary, pa.array(used.astype(np.int32)), lists(pa.array(ends), edge + np.arange(len(edge))),
            lists(pa.array(inside.astype(np.int32)), edge), lists(pa.array([self.docs[i] for i in order], doc_type), edge),
            lists(pa.array(np.array(self.offsets, np.int64)[order]), edge)], names)
        self.clear()
        return out


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", length: int = 2048, end: int = 50256,
         window: int = 1 << 22) -> DataFrame:
    """Rows of ``length`` token ids.

    ``ids``: little-endian, two bytes each, or four where the vocabulary needs them,
    filled up with ``end``; ``n_tokens``: places that are not filling; ``cu_seqlens``:
    0 and the end of every segment; ``position_resets``: where a segment starts, that
    is where positions start from 0; ``doc_ids`` and ``doc_offsets``: the document of
    every segment and its first token there.

    Every document ends with ``end``; a null or empty text is that token alone.  Equal
    rows are packed as often as they occur, null keys are null in ``doc_ids``.  An
    empty table gives no rows.  ``window`` bounds the tokens that a task packs at once.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    wide = np.dtype("<u2") if max([end, *ranks.value.values()]) < 1 << 16 else np.dtype("<u4")
    whole = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([
        T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("cu_seqlens", whole),
        T.StructField("position_resets", whole), T.StructField("doc_ids", T.ArrayType(df.schema[key].dataType)),
        T.StructField("doc_offsets", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        tokenizer = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [tokenizer.encode_ordinary(w) for w in words]
            return np.fromiter((i for x in lists for i in x), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

        known, waiting = flat.Known(encode), Window(length, end, wide)
        last = np.array([end], np.int32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            held: list[np.ndarray] = []
            doc = 0

            def close(waiting=waiting, keys=keys, held=held):
                waiting.add(keys[doc], np.concatenate([*held, last]))
                held.clear()

            for owners, texts in flat.blocks(batch.column(1).to_pylist()):
                cps, fill = flat.laid_out(texts)
                start, stop = flat.pretokens(cps, fill)
                row = known.rows(cps, start, stop)
                size = known.count[row]
                ids = known.values[flat.ragged(known.first[row], size)]
                piece = np.append(0, np.cumsum(np.bincount(np.searchsorted(fill, start), size, len(texts)))).astype(np.int64)
                for i, owner in enumerate(owners.tolist()):
                    if owner != doc:
                        close()
                        doc = owner
                    held.append(ids[piece[i] : piece[i + 1]])
                if waiting.tokens >= window:
                    yield waiting.batch(schema.names, batch.schema.field(0).type)
            if keys:
                close()
        if waiting.tokens:
            yield waiting.batch(schema.names, batch.schema.field(0).type)

    return df.select(key, text).mapInArrow(run, schema)


def positions(resets: Column, length: int) -> Column:
    """Position of every place of a row; they start anew at each reset, and the filling
    counts on behind the last segment."""
    nth = F.transform(resets, lambda at, i: F.sequence(F.lit(0), F.coalesce(F.get(resets, i + 1), F.lit(length)) - at - 1))
    return F.flatten(nth)


def write(packed: DataFrame, path: str) -> None:
    """The rows as Parquet files; the id matrix of a file is its column ``ids``."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)
