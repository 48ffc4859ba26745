"""Texts as flat numpy arrays inside a task: words and pre-tokens with 64-bit names.

Several texts are laid behind each other as code points.  A word or pre-token is a
stretch ``[start, end)`` and a *name*, a 64-bit hash of its code points; what a task
keeps about words (``Known``) goes by the words themselves.  Work is done
in blocks of about ``BLOCK`` code points, and a longer text is cut between two words,
so that memory does not grow with the longest text.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20
SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: The code points that ``\s`` matches.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern takes behind an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = 0x9E3779B97F4A7C15
_made: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if "value" not in _made:
        rng = np.random.Generator(np.random.PCG64(20240229))
        _made["value"] = rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        _made["place"] = _places(BLOCK + 4096)
    return _made


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(n: int) -> np.ndarray:
    """A value for each place inside a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD))


def classes() -> np.ndarray:
    """The class of every code point, for the pattern of the byte-level tokenizers."""
    if "class" not in _made:
        kind = {"L": LETTER, "N": NUMBER}
        c = np.full(0x110000, OTHER, np.uint8)  # beyond the third plane there are no letters or numbers
        c[:0x34000] = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x34000)), np.uint8, 0x34000)
        c[WHITE] = SPACE
        _made["class"] = c
    return _made["class"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(text: str, limit: int = BLOCK) -> Iterator[str]:
    """The text, cut before single spaces between two words where it is longer than
    ``limit``; no word or pre-token is cut unless it is longer than that itself."""
    at = 0
    while len(text) - at > limit:
        cut = -1
        for m in _CUT.finditer(text, at + limit // 2, at + limit):
            cut = m.start()
        if cut < 0:
            m = _CUT.search(text, at + limit)
            if m is None:
                break
            cut = m.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


def blocks(texts: Iterable[str | None], limit: int = BLOCK) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(number of the text of each piece, pieces), about ``limit`` code points at a time.
    A null text counts as an empty one; every text has at least one piece."""
    owners: list[int] = []
    held: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text or "", limit):
            if held and size + len(piece) > limit:
                yield np.array(owners), held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(owners), held


def laid_out(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all pieces, each followed by one filler; places of the fillers)."""
    cps = np.frombuffer("\0".join([*held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1


def names(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each stretch, equal for equal code points wherever it lies.

    The sum of one hash for each (code point, place in the stretch): no pattern of two
    letters cancels out, as it would in a polynomial of the code points."""
    t = _tables()
    n = len(cps)
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.zeros(n, np.int64)
    first[start] = np.diff(start, prepend=0)
    at = np.arange(n) - np.cumsum(first)
    place = t["place"] if n <= len(t["place"]) else _places(n)
    h = (t["value"][cps] ^ place[at]) * np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64))


def words(cps: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches without the six white-space characters of ASCII."""
    word = ~((cps == 32) | ((cps >= 9) & (cps <= 13)))
    word[fill] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def pretokens(cps: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the matches of the pattern of the byte-level tokenizers.

    Runs of one class are matches, but a last space before a run belongs to that run,
    another last white-space character stands alone, and an apostrophe at the start of
    a match takes one of ``ENDINGS`` with it.
    """
    c = classes()[cps]
    c[fill] = END
    c = np.concatenate([c, [END, END, END]])
    start = np.ones(len(c), bool)
    start[1:] = c[1:] != c[:-1]
    last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & (c[1:] != END))
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    quote = np.flatnonzero((cps == 39) & start[: len(cps)] & (c[1 : len(cps) + 1] == LETTER) & (c[: len(cps)] == OTHER))
    if len(quote):
        padded = np.concatenate([cps, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        two_in = c[quote + 2] != END
        size = np.zeros(len(quote), np.int64)
        for ending in reversed(ENDINGS):
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= (two == ord(ending[1])) & two_in
            size[hit] = len(ending)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[c[after] == LETTER]] = True
    at = np.flatnonzero(start[: len(cps)])
    end = np.append(at[1:], len(cps))
    keep = c[at] != END
    return at[keep], end[keep]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[0], start[0]+1, ..., of all stretches behind each other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - first, length)


def strings(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The stretches as strings."""
    return [cps[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def merged(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """What is left of one long word when its leftmost pair of least rank is contracted
    until there is none: ``pairs`` gives rank and new symbol of ``left << 32 | right``.
    A heap of the pairs over a linked list, so that time is n log n."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in pairs]
    heapq.heapify(heap)
    symbols = [*symbols]
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i]
        # a pair that is not there any more is passed over
        if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != key:
            continue
        symbols[i], symbols[j] = pairs[key][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (k := symbols[left] << 32 | symbols[right]) in pairs:
                heapq.heappush(heap, (pairs[k][0], left, k))
    return [s for s in symbols if s >= 0]


class Known:
    """What a task has worked out for the words it met: a few numbers for each.  Words are
    found by their names and compared with what was found, so that two of one name stay
    two.  Beyond ``most`` words or ``letters`` code points it starts anew, so that its
    memory is bounded."""

    def __init__(self, encode, most: int = 600_000, letters: int = 1 << 23):
        """encode(words) -> (numbers of all words behind each other, how many each has)."""
        self.encode = encode
        self.most, self.letters = most, letters
        self.clear()

    def clear(self) -> None:
        self.name = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        # the words themselves, and those whose name another word has
        self.held = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.others: dict[bytes, int] = {}

    def _add(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        values, count = self.encode(strings(cps, start, end))
        row = len(self.count) + np.arange(len(start))
        self.first = np.concatenate([self.first, len(self.values) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.values = np.concatenate([self.values, values])
        size = end - start
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        more = cps[ragged(start, size)]
        if self.used + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(self.used + 2 * len(more), np.uint32)])
        self.held[self.used : self.used + len(more)] = more
        self.used += len(more)
        return row

    def rows(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray | None = None) -> np.ndarray:
        """The row of each stretch; row r has ``values[first[r]:first[r]+count[r]]``.
        ``name`` are the names of the stretches, if they are known."""
        if len(self.count) > self.most or self.used > self.letters:
            self.clear()
        if not len(start):
            return np.zeros(0, np.int64)
        found, one, back = np.unique(names(cps, start, end) if name is None else name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.name, found)
        old = np.zeros(len(found), bool)
        inside = at < len(self.name)
        old[inside] = self.name[at[inside]] == found[inside]
        row = np.zeros(len(found), np.int64)
        row[old] = self.row[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            row[new] = self._add(cps, start[one[new]], end[one[new]])
            self.name = np.insert(self.name, at[new], found[new])
            self.row = np.insert(self.row, at[new], row[new])
        row = row[back]
        size = end - start
        wrong = self.size[row] != size
        length = np.where(wrong, 0, size)
        differs = self.held[ragged(self.at[row], length)] != cps[ragged(start, length)]
        if differs.any():
            wrong[np.repeat(np.arange(len(row)), length)[differs]] = True
        for i in np.flatnonzero(wrong).tolist():
            word = cps[start[i] : end[i]].tobytes()
            if word not in self.others:
                self.others[word] = int(self._add(cps, start[i : i + 1], end[i : i + 1])[0])
            row[i] = self.others[word]
        return row
