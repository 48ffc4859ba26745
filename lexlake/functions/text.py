"""String expressions shared by the operators.

Everything here is a ``Column -> Column`` builder on native Spark expressions.
Regular expressions are written once with ``(?U)`` so that ``\\b``, ``\\d`` and
``\\s`` follow Unicode, and with ``(?md)`` where ``^``/``$`` must mean "next to a
line feed" and nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a Unicode strip removes (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

SENTINEL, FENCE = "\x01", "\x02"
# Elements that a fold with a growing result runs over at once.
BLOCK = 64


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def opening(c: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all of them."""
    return c if chars is None else F.substring(c, 1, chars)


def flatten_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def is_upper(c: Column) -> Column:
    """At least one cased character and no lower-case one."""
    return (c == F.upper(c)) & (c != F.lower(c))


_LEADING_WORD = re.compile(r"\\b([a-z][a-z ]*[a-z])(?![?*+{])")


def word_start_last(pattern: str) -> str:
    """``\\bword...`` as ``word(?<=\\bword)...``: same matches, but the regex engine can
    search for the literal first and test the Unicode word boundary only there."""
    m = _LEADING_WORD.match(pattern)
    return f"{m[1]}(?<=\\b{m[1]}){pattern[m.end():]}" if m else pattern


def count_matches(c: Column, pattern: str, needs: str | None = None) -> Column:
    """Number of non-overlapping matches; ``needs`` is a literal every match
    contains, tested first because a byte search is far cheaper than a regex."""
    n = F.regexp_count(c, F.lit(pattern))
    return n if needs is None else F.when(F.contains(c, F.lit(needs)), n).otherwise(F.lit(0))


def has_match(c: Column, pattern: str, needs: str | None = None) -> Column:
    hit = c.rlike(pattern)
    return hit if needs is None else F.contains(c, F.lit(needs)) & hit


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def in_blocks(values: Column) -> Column:
    """The array cut into arrays of ``BLOCK`` elements."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(values) > 0, cut).otherwise(F.filter(F.array(values), lambda x: F.lit(False)))


def _sums(lengths: Column, start: Column) -> Column:
    zero = F.struct(F.array().cast("array<int>").alias("sums"), start.cast("int").alias("at"))

    def step(acc: Column, n: Column) -> Column:
        at = (acc["at"] + n).cast("int")
        return F.struct(F.concat(acc["sums"], F.array(at)).alias("sums"), at.alias("at"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["sums"])


def running_total(lengths: Column) -> Column:
    """Inclusive running sums of an int array.

    A fold copies what it has so far at every step, so it runs inside blocks, and once
    over the sums of the blocks."""

    def summed(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: (a + n).cast("int")))
        starts = F.concat(F.array(F.lit(0)), _sums(whole, F.lit(0)))
        return bound(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: _sums(b, F.get(at, i)))))

    return bound(in_blocks(lengths), summed)


def scan(values: Column, zero: Column, step) -> Column:
    """The states ``step(state, value)`` after each element, from ``zero`` on.

    As in ``running_total``, results grow inside blocks and once over the blocks: what a
    block starts with comes from a fold that keeps one state only."""
    grown = lambda start: F.struct(F.filter(F.array(start), lambda x: F.lit(False)).alias("states"), start.alias("at"))

    def inside(acc: Column, v: Column) -> Column:
        return bound(step(acc["at"], v), lambda at: F.struct(F.concat(acc["states"], F.array(at)).alias("states"), at.alias("at")))

    def over(acc: Column, block: Column) -> Column:
        at = F.aggregate(block, acc["at"], step)
        return F.struct(F.concat(acc["states"], F.array(acc["at"])).alias("states"), at.alias("at"))

    def states(blocks: Column) -> Column:
        starts = F.aggregate(blocks, grown(zero), over, lambda acc: acc["states"])
        each = lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, grown(F.get(at, i)), inside, lambda acc: acc["states"])))
        return bound(starts, each)

    return bound(in_blocks(values), states)


def matches(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Array of struct(pos, <groups...>) for every match of ``pattern``.

    One pass of the pattern writes a sentinel, the groups and the match itself in place
    of each match.  The lengths of the text between sentinels, summed up, are the
    offsets."""
    clean = F.translate(text, SENTINEL + FENCE, "\x03\x03")
    template = SENTINEL + "".join(f"${g}{FENCE}" for g in groups.values()) + "$0"
    pieces = F.split(F.regexp_replace(clean, pattern, template), SENTINEL)

    def opened(p: Column) -> Column:
        ends = running_total(F.transform(p, lambda x: F.length(F.substring_index(x, FENCE, -1))))

        def row(ends: Column) -> Column:
            def fields(x: Column, i: Column) -> Column:
                parts = [F.split_part(x, F.lit(FENCE), F.lit(n)).alias(name) for n, name in enumerate(groups, 1)]
                return F.struct(F.get(ends, i).alias("pos"), *parts)

            return F.transform(F.slice(p, F.lit(2), F.size(p)), fields)

        return bound(ends, row)

    return bound(pieces, opened)


def match_groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def before_first(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, 1)


def after_first(c: Column, sep: str) -> Column:
    """Text behind the first ``sep``; null when there is none."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substring(c, at + len(sep), F.length(c)))


def chars(c: Column, start: Column | int, length: Column | int) -> Column:
    """0-based substring."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(c, start + 1, length)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(strip(c), r"(?U)\s+")))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def first_when(rules: list[tuple[Column, Column | str]], default: Column | None = None) -> Column:
    """Ordered rules: the value of the first true condition."""
    cond, value = rules[0]
    out = F.when(cond, value)
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def half_even(c: Column, digits: int) -> Column:
    """Banker's rounding of a double, returned as a double."""
    return F.bround(c.cast("double"), digits).cast("double")
