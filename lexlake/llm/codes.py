"""Vector codes: product quantization in integers, searched in the Walsh-Hadamard domain.

Components become integers, a vector is cut into equal parts, and each part is padded
with zeros to a power of two and transformed by additions and subtractions alone.  The
transform keeps squared distances up to the factor of its length, and most of a
difference tends to lie in few coefficients: distances are accumulated one coefficient
at a time, in sequency order (by the number of sign changes), and an entry leaves as
soon as what it has so far is more than the whole distance of another one.  All
numbers are integers, so that codes and codebooks are the same on every cluster.

The vectors are transformed once and stored; each round is one pass over that table.
Tasks give sums and counts by part and entry, so the driver holds the codebooks, whose
size does not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.shared import stored

#: Components beyond this magnitude (in steps of 1/4096) are refused: distances must fit into 64 bits.
LARGEST = 1 << 25
#: Rows that are compared with all entries at once.
ROWS = 8192


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, a power of two long, with the
    coefficients in sequency order."""
    size = x.shape[-1]
    x = x.astype(np.int64)
    step = 1
    while step < size:
        y = x.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        step *= 2
    return x[..., sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Natural place of the coefficients with 0, 1, 2, ... sign changes: the bits of the
    Gray code, in reverse."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(size, np.int64))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, scaled squared distance) of the nearest entry of every part, the lower
    number among equals.  Both are transformed; the distance is ``size`` times the true
    one.

    The first coefficient is taken of all; then the entry that leads has its distance
    completed, which is the bound, and entries beyond it leave after every coefficient.
    """
    n, size = parts.shape
    chosen, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for low in range(0, n, ROWS):
        x = parts[low : low + ROWS]
        sofar = (x[:, :1] - entries[None, :, 0]) ** 2
        lead = np.argmin(sofar, 1)
        bound = ((x - entries[lead]) ** 2).sum(1)
        row, entry = np.nonzero(sofar <= bound[:, None])
        held = sofar[row, entry]
        for k in range(1, size):
            held = held + (x[row, k] - entries[entry, k]) ** 2
            stays = held <= bound[row]
            if not stays.all():
                row, entry, held = row[stays], entry[stays], held[stays]
        # rows are in order and entries within them, so the first of the least is the lower number
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(held, first) if len(row) else held
        best = np.flatnonzero(held == least[np.cumsum(np.append(True, row[1:] != row[:-1])) - 1]) if len(row) else first
        _, one = np.unique(row[best], return_index=True)
        chosen[low : low + len(x)], distance[low : low + len(x)] = entry[best[one]], held[best[one]]
    return chosen, distance


class Book:
    """The entries of all parts, as they are and transformed."""

    def __init__(self, entries: np.ndarray, padded: int):
        """``entries``: part x entry x position."""
        self.entries = entries
        whole = np.zeros((*entries.shape[:2], padded), np.int64)
        whole[..., : entries.shape[2]] = entries
        self.walsh = walsh(whole)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _parts(column: pa.Array, rows: int, n_parts: int) -> np.ndarray:
    """Part x row x coefficient."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, n_parts, -1).transpose(1, 0, 2)


def _sums(kept: DataFrame, book: Book, n_parts: int) -> list:
    """(part, entry, sums of the coefficients, count) over the parts that each entry is nearest to."""
    schema = "part int, entry int, coefficient int, total long, n long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_entries, size = book.entries.shape[1], book.walsh.shape[2]
        total, n = np.zeros((n_parts, n_entries, size), np.int64), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch.column(0), batch.num_rows, n_parts)):
                entry, _ = nearest(x, book.walsh[p])
                n[p] += np.bincount(entry, minlength=n_entries)
                order = np.argsort(entry, kind="stable")
                found, first = np.unique(entry[order], return_index=True)
                if len(found):
                    total[p, found] += np.add.reduceat(x[order], first, 0)
        used = np.argwhere(n > 0)
        if len(used):
            p, e = np.repeat(used[:, 0], size), np.repeat(used[:, 1], size)
            k = np.tile(np.arange(size), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (p.astype(np.int32), e.astype(np.int32), k.astype(np.int32), total[p, e, k], n[p, e])], names)

    # a table of parts x entries x coefficients, whatever the number of rows
    found = kept.select("_walsh").mapInArrow(run, schema).groupBy("part", "entry", "coefficient")
    return found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()


def _moved(book: Book, found: list) -> Book:
    """Every entry at the floor of the mean of its parts; unused ones stay."""
    entries, size = book.entries.copy(), book.walsh.shape[2]
    sums: dict[tuple[int, int], list[int]] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in found:
        sums.setdefault((r["part"], r["entry"]), [0] * size)[r["coefficient"]] = int(r["total"])
        counts[r["part"], r["entry"]] = int(r["n"])
    back = np.zeros((size, size), np.int64)
    back[np.arange(size), np.arange(size)] = 1
    back = walsh(back).T.tolist()  # row k: signs of coefficient k; its own inverse up to the factor size
    for (p, e), total in sums.items():
        plain = [sum(sign * t for sign, t in zip(column, total, strict=True)) // size for column in zip(*back, strict=True)]
        entries[p, e] = [x // counts[p, e] for x in plain[: entries.shape[2]]]
    return Book(entries, size)


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", n_parts: int = 8, n_entries: int = 16,
             rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Rows whose vector is null or has null or non-finite components are left out.  The
    components are floor(scale x); vectors are filled up with zeros to a multiple of
    ``n_parts`` not below the longest one.  The codebooks start with the vectors of the
    smallest keys (null keys never; of equal keys the vector that sorts first) and
    have fewer entries where there are fewer of those; without any key at all, no codes
    can be learnt, and ``code`` and ``error`` are null.  Equal vectors get equal
    codes.  Rows with equal or null keys stay rows of their own.  ``label_error`` is
    the sum of ``error`` over the rows of that label, nulls together.  Empty tables
    give none.  Magnitudes from ``LARGEST / scale`` on are refused with an error, as
    squared distances would leave 64 bits.  ``n_entries`` is at most 256.
    """
    spark = df.sparkSession
    flat = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), F.col(label).alias("_label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    flat = flat.filter(F.col("_vector").isNotNull() & F.forall("_vector", finite))
    seen = flat.agg(F.max(F.size("_vector")).alias("width"), F.max(F.array_max(F.transform("_vector", F.abs))).alias("most")).first()
    if (seen["most"] or 0) * scale >= LARGEST:
        raise ValueError(f"components from {LARGEST / scale} on cannot be coded in 64 bits")
    width = max(1, -(-(seen["width"] or 0) // n_parts))
    padded = 1 << (width - 1).bit_length()

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.zeros((batch.num_rows, n_parts * width), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            whole[row, at] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64)
            parts = np.zeros((batch.num_rows, n_parts, padded), np.int64)
            parts[..., :width] = whole.reshape(-1, n_parts, width)
            done = walsh(parts).astype(np.int32 if padded * LARGEST < 1 << 31 else np.int64)
            edges = np.arange(batch.num_rows + 1, dtype=np.int32) * (n_parts * padded)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(edges), pa.array(done.reshape(-1)))], ["_key", "_label", "_walsh"])

    number = T.IntegerType() if padded * LARGEST < 1 << 31 else T.LongType()
    kinds = T.StructType([T.StructField("_key", flat.schema["_key"].dataType), T.StructField("_label", flat.schema["_label"].dataType), T.StructField("_walsh", T.ArrayType(number))])
    kept = stored(flat.mapInArrow(transform, kinds), "walsh")

    # the vectors of the smallest keys: a fixed number of rows
    start = flat.filter(F.col("_key").isNotNull()).orderBy("_key", "_vector").limit(n_entries).collect()
    if not start:
        return kept.select(F.col("_key").alias(key), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                           F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    entries = np.zeros((len(start), n_parts * width), np.int64)
    for i, r in enumerate(start):
        entries[i, : len(r["_vector"])] = np.floor(np.array(r["_vector"], np.float64) * scale).astype(np.int64)
    book = Book(entries.reshape(-1, n_parts, width).transpose(1, 0, 2).copy(), padded)
    for _ in range(rounds):
        book = _moved(book, _sums(kept, book, n_parts))

    coded = stored(_codes(kept, book, n_parts), "codes")
    errors = coded.groupBy("_label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    out = coded.join(errors.withColumnRenamed("_label", "_of"), F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def _codes(kept: DataFrame, book: Book, n_parts: int) -> DataFrame:
    """The key, label, code and error of every row."""
    schema = T.StructType([kept.schema["_key"], kept.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((batch.num_rows, n_parts), "S2"), np.zeros(batch.num_rows, np.int64)
            for p, x in enumerate(_parts(batch.column(2), batch.num_rows, n_parts)):
                entry, distance = nearest(x, book.walsh[p])
                code[:, p] = digits[entry]
                error += distance // book.walsh.shape[2]
            text = pa.array(code.reshape(-1).view(f"S{2 * n_parts}").astype(f"U{2 * n_parts}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error)], schema.names)

    return kept.select("_key", "_label", "_walsh").mapInArrow(run, schema)


def oracle(n_parts: int = 8, n_entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rows in SQL, for vectors whose length is a multiple of ``n_parts``."""
    sql = [f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, q[p * (len(q) // {n_parts}) + 1 : (p + 1) * (len(q) // {n_parts})] AS v FROM kept, range({n_parts}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts JOIN (SELECT r, vec_id FROM kept ORDER BY vec_id LIMIT {n_entries}) USING (r))"""]
    for k in range(rounds + 1):
        sql.append(f"""a{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
 FROM parts JOIN b{k} USING (p)) GROUP BY r, p)""")
        if k < rounds:
            sql.append(f"""m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
 FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts JOIN a{k} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, list_transform(coalesce(m{k}.c, b{k}.c), lambda x: CAST(x AS BIGINT)) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return ",\n".join(sql) + f""",
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (r)"""
