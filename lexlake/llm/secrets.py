"""Secrets in texts, judged by who else has them: DataFrame operations only.

One scan finds candidate spans.  Their values are hashed and counted over the corpus by
distinct repositories and owners: a value that several owners or very many repositories
carry is an example that was copied around, one of few that looks random is live.  Counting goes over
(value, owner) pairs first, so that neither a widely copied value nor an owner of a
third of all rows meets in one task, and only rows with candidates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.shared import stored

#: Kind, pattern, group that holds the value, least length of that group.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
#: Kinds that the method adds where a value belongs to few owners and looks random.
ADDED = [
    ("bearer", r"((?i:bearer))\x20+([A-Za-z0-9+/_.=-]{20,})", 2, 20),
    ("url", r"([A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]+):([^\s/:@]{8,})@", 2, 8),
    ("bare", r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-]))", 1, 24),
]
KINDS = [k for k, *_ in BASE + ADDED]
_SPAN = "array<struct<start:int, kind:int, end:int, value:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of all leftmost matches that do not overlap, short ones dropped.  The text
    between the matches and the matches themselves alternate, so offsets are sums."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    # a fold over the matches: (next start, spans so far); texts have few matches
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        kept = F.when(F.char_length(x["value"]) >= least, F.array(span)).otherwise(F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.concat(state["spans"], kept.cast(_SPAN)).alias("spans"))

    zipped = F.transform(found, lambda f, i: F.struct(F.get(gaps, i).alias("gap"), f.alias("found"), F.get(value, i).alias("value")))
    spans = F.aggregate(zipped, start, step, lambda state: state["spans"])
    # most texts have no match: one search finds that out
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def random_looking(value: Column, digit: Column | bool = True) -> Column:
    """Letters and (where ``digit`` is true) digits mixed, and many different ones: not a
    word or a path."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = (value.rlike("[0-9]") | (~digit if isinstance(digit, Column) else F.lit(not digit))) & value.rlike("[A-Za-z]")
    return mixed & (distinct >= 8) & ~value.rlike(r"(.)\1{5}")


def identity(key: str, text: str) -> Column:
    """What rows of equal key and text have in common, and no others."""
    return F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``_spans``: candidate spans by start, then kind.  Offsets are code
    points, the end is exclusive; a null or empty text has none."""
    held = F.coalesce(F.col(text), F.lit(""))
    each = [_matches(held, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(BASE)]
    for k, (_, pattern, group, least) in enumerate(ADDED, len(BASE)):
        spans = _matches(held, k, pattern, group, least)
        each.append(F.filter(spans, lambda s: random_looking(s["value"])))
    return df.withColumn("_spans", F.array_sort(F.concat(*each)))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """(_value, repositories, owners) of every candidate value: distinct ones that have
    it.  A null repository or owner is one of its own kind."""
    each = found.select(F.explode("_spans").alias("s"), F.col(repository).alias("_r"), F.col(owner).alias("_o"))
    each = each.select(F.sha2(F.col("s.value"), 256).alias("_value"), F.struct("_r").alias("_r"), F.struct("_o").alias("_o"))
    pairs = each.groupBy("_value", "_o", "_r").count()
    by_owner = pairs.groupBy("_value", "_o").agg(F.count("_r").alias("_n"), F.min("_r").alias("_one"))
    # a repository may have several owners; then it is counted for each of them
    return by_owner.groupBy("_value").agg(F.sum("_n").alias("repositories"), F.count("_o").alias("owners"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", repository: str | None = None, owner: str = "source",
         owners: int = 3, repositories: int = 50) -> DataFrame:
    """(key, spans, row_id) of every row: spans as array of (start, kind, end,
    repositories, owners, verdict) by start, then kind; row_id is ``identity``.

    A value of more than ``owners`` owners or ``repositories`` repositories was copied
    around: its verdict is ``example``.  Of the others those that look random are
    ``live``, the rest ``weak``; keys that start with AKIA need no digit for that.  Base
    kinds are kept whatever the verdict, added ones only where they are live.

    Rows go by key and text: those that share a key but not the text, or have no key,
    have spans of their own.  Only rows with candidates are shuffled.
    """
    found = stored(candidates(df, text).select(
        F.col(key).alias("_key"), identity(key, text).alias("_id"), F.col(repository or key).alias("_repository"), F.col(owner).alias("_owner"), "_spans"), "secrets")
    counts = ownership(found.filter(F.size("_spans") > 0), "_repository", "_owner")
    each = found.filter(F.size("_spans") > 0).select("_id", F.explode("_spans").alias("s"))
    each = each.withColumn("_value", F.sha2(F.col("s.value"), 256)).join(counts, "_value")
    spread = (F.col("owners") > owners) | (F.col("repositories") > repositories)
    live = ~spread & random_looking(F.col("s.value"), F.col("s.kind") != KINDS.index("access"))
    verdict = F.when(live, "live").when(spread, "example").otherwise("weak")
    each = each.withColumn("verdict", verdict).filter((F.col("s.kind") < len(BASE)) | (F.col("verdict") == "live"))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "repositories", "owners", "verdict")
    # equal rows have equal spans
    judged = each.groupBy("_id").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    out = found.select("_key", "_id").join(judged, "_id", "left")
    return out.select(F.col("_key").alias(key), F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans"), F.col("_id").alias("row_id"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", verdict: str = "live", by: str = "[SECRET]") -> DataFrame:
    """``df`` with every live span of its texts replaced; spans that overlap become one.
    Texts without one are not touched, and every row stays one row: spans belong to
    rows by key and text."""
    live = spans.select(F.col("row_id").alias("__row_id"), F.filter("spans", lambda s: s["verdict"] == verdict).alias("__live_spans")).filter(F.size("__live_spans") > 0)
    # written first, so that Spark knows how few they are and need not shuffle the texts
    live = stored(live.dropDuplicates(["__row_id"]), "live")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        keep = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(F.when(fresh, F.concat(state["out"], keep, F.lit(by))).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    whole = F.aggregate("__live_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, 1 << 30)))
    joined = df.join(live, identity(key, text) == F.col("__row_id"), "left")
    return joined.withColumn(text, F.when(F.col("__live_spans").isNull(), F.col(text)).otherwise(whole)).select(*df.columns)
