"""Token counts of whole texts by rank-synchronous merging of arrays.

The pre-tokens of a block are one ragged array of symbols.  In every round each
sequence finds its lowest-rank pair, all sequences apply theirs at once, and the
sequences without a pair leave; what survives is counted.  A pre-token is merged once
per task, texts only add up the counts.  The work is narrow: no shuffle, and memory
depends on the block, not on the longest text.

Applying a pair at all its places at once equals one merge after the other, as a pair
that contains a new symbol always has a higher rank than the symbol itself.  A round goes
over all of a word, so the few words of more than ``LONGEST`` bytes, which have very many
ranks, take one pair after the other from a heap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexlake.llm import flat

NONE = np.iinfo(np.int64).max
LONGEST = 1024


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary files: printable ones for
    themselves, the others for the letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def load(path: str) -> dict:
    """Merges of a byte-level ``tokenizers`` file as sorted arrays."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    order = np.argsort(key)
    return {
        "key": key[order], "rank": order.astype(np.int64), "made": made[order],
        "byte": np.array([ids[c] for c in byte_letters()], np.int64),
        "special": [t["content"] for t in spec["added_tokens"] if t["special"]],
    }


def survivors(words: list[str], model: dict) -> np.ndarray:
    """How many symbols of each word are left when no pair can be merged."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    left = np.fromiter(map(len, data), np.int64, len(data))
    for i in np.flatnonzero(left > LONGEST).tolist():
        if "pairs" not in model:
            model["pairs"] = dict(zip(model["key"].tolist(), zip(model["rank"].tolist(), model["made"].tolist(), strict=True), strict=True))
        left[i] = len(flat.merged(model["byte"][np.frombuffer(data[i], np.uint8)].tolist(), model["pairs"]))
        data[i] = b""
    symbol = model["byte"][np.frombuffer(b"".join(data), np.uint8)]
    word = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)))
    while len(symbol):
        key = (symbol[:-1] << 32) | symbol[1:]
        at = np.minimum(np.searchsorted(model["key"], key), len(model["key"]) - 1)
        rank = np.full(len(symbol), NONE)
        rank[:-1] = np.where((model["key"][at] == key) & (word[1:] == word[:-1]), model["rank"][at], NONE)
        at = np.append(at, 0)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        live = lowest != NONE
        symbol, word, rank, lowest, at = symbol[live], word[live], rank[live], lowest[live], at[live]
        hit = rank == lowest
        # of places that overlap, as in a run of one symbol, every second one counts
        place = np.arange(len(hit))
        hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
        symbol[hit] = model["made"][at[hit]]
        gone = np.flatnonzero(hit) + 1
        left -= np.bincount(word[gone], minlength=len(left))
        symbol, word = np.delete(symbol, gone), np.delete(word, gone)
    return left


def counts_of(texts: list[str | None], known: flat.Known, special: list[str]) -> np.ndarray:
    """Tokens of each text; a special string counts as one and parts the text."""
    total = np.zeros(len(texts), np.int64)
    owner: list[int] = []
    parts: list[str] = []
    for i, text in enumerate(texts):
        cut = [text or ""]
        for s in special:
            cut = [p for c in cut for p in c.split(s)]
        total[i] += len(cut) - 1
        owner += [i] * len(cut)
        parts += cut
    part_owner = np.array(owner, np.int64)
    for owners, held in flat.blocks(parts):
        cps, fill = flat.laid_out(held)
        start, end = flat.pretokens(cps, fill)
        if len(start):
            row = known.rows(cps, start, end)
            tokens = known.count[row]
            total += np.bincount(part_owner[owners[np.searchsorted(fill, start)]], tokens, len(texts)).astype(np.int64)
    return total


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``df``.

    Null and empty texts have no bytes and no tokens.  Rows with equal or null keys
    stay apart rows; other columns are not looked at, whatever their names.
    """
    model = df.sparkSession.sparkContext.broadcast(load(path))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def encode(words):
            left = survivors(words, m)
            return np.zeros(0, np.int32), left

        known = flat.Known(encode)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counts_of(texts, known, m["special"])
            size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, schema)
