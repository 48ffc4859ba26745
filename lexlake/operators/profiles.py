"""Language identification by profiles of character trigrams.

Profiles are learnt from labelled texts: every task counts the trigrams of its batches,
and one aggregation adds them up.  For each language the most frequent ones are kept, so
the model is a bounded table that goes to every task, where a text is scored in one pass
over its trigrams, whether it is a document or a short sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trigrams that are kept of each language, and languages at most.
MOST, LANGUAGES = 3000, 64
SMOOTHING = 0.5


@dataclass(frozen=True)
class Profiles:
    """The log-probability of every kept trigram in every language."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray

    def best(self, texts: list[str | None]) -> list[str | None]:
        """The likeliest language of each normalized text, the first one by name among
        equals; null where no trigram is known."""
        at, of = grams(texts)
        place = np.minimum(np.searchsorted(self.keys, at), max(len(self.keys) - 1, 0))
        known = self.keys[place] == at if len(self.keys) else np.zeros(len(at), bool)
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(of[known], self.weights[place[known], k], len(texts))
        seen = np.bincount(of[known], minlength=len(texts))
        return [self.languages[i] if n else None for i, n in zip(total.argmax(1).tolist(), seen.tolist(), strict=True)] if self.languages else [None] * len(texts)

    def detector(self) -> Callable[[Column], Column]:
        """An expression from an array of texts to the array of their languages."""

        @F.pandas_udf("array<string>")
        def detect(lists: pd.Series) -> pd.Series:
            flat = [t for texts in lists for t in texts]
            found = self.best(flat)
            edge = np.cumsum([0, *(len(x) for x in lists)]).tolist()
            return pd.Series([found[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], dtype=object)

        return lambda texts: detect(F.transform(texts, normalized))


def normalized(text: Column) -> Column:
    """Lower-case words between single blanks, one in front and one behind."""
    words = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all texts as numbers, number of the text of each)."""
    size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    cps = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    if len(cps) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = of[2:] == of[:-2]
    return ((cps[:-2] << 42) | (cps[1:-1] << 21) | cps[2:])[inside], of[2:][inside]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST) -> Profiles:
    """Profiles of docs(text, lang).  Rows without a language teach nothing, null texts
    are empty.  The driver gets ``most`` trigrams of each of ``LANGUAGES`` languages."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), normalized(F.col(text)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            number = names.indices.to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for k, name in enumerate(names.dictionary.to_pylist()):
                found, n = np.unique(grams([texts[i] for i in np.flatnonzero(number == k).tolist()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    totals = {r["lang"]: (r["total"], r["kinds"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    kept = counted.filter(F.col("place") <= most).select("gram").distinct()
    found = counted.join(kept, "gram").select("lang", "gram", "n").toPandas()
    languages = sorted(totals)
    keys = np.unique(found["gram"].to_numpy(np.int64))
    n = np.zeros((len(keys), len(languages)))
    n[np.searchsorted(keys, found["gram"].to_numpy(np.int64)), np.searchsorted(languages, found["lang"].to_numpy(str)) if len(found) else []] = found["n"]
    size = np.array([totals[x][0] + SMOOTHING * totals[x][1] for x in languages])
    return Profiles(languages, keys, np.log((n + SMOOTHING) / size) if len(languages) else n)


def detected(docs: DataFrame, profiles: Profiles, text: str = "text", out: str = "detected") -> DataFrame:
    """``docs`` with the language of every whole text."""
    return docs.withColumn(out, F.get(profiles.detector()(F.array(F.col(text))), F.lit(0)))
