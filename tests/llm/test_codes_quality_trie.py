"""Vector codes, quality trees and the conversation trie: next to brute force, on odd rows
and on skewed ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexlake.llm import codes, quality, trie
from lexlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# vector codes


def test_transform_is_in_sequency_order_and_keeps_distances():
    for size in (1, 2, 8, 16):
        matrix = codes.walsh(np.eye(size, dtype=np.int64)).T
        assert [int((np.diff(row) != 0).sum()) for row in matrix] == list(range(size))
        assert (matrix @ matrix.T == size * np.eye(size)).all()
    rng = np.random.default_rng(1)
    x, y = rng.integers(-9000, 9000, (2, 50, 8))
    assert (((codes.walsh(x) - codes.walsh(y)) ** 2).sum(1) == 8 * ((x - y) ** 2).sum(1)).all()


@pytest.mark.parametrize("spread", [3, 9000, 1 << 24])
def test_nearest_is_exact_with_ties(spread):
    rng = np.random.default_rng(spread)
    x, e = rng.integers(-spread, spread, (3000, 8)), rng.integers(-spread, spread, (16, 8))
    e[5] = e[2]
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    entry, distance = codes.nearest(codes.walsh(x), codes.walsh(e))
    assert (entry == d.argmin(1)).all() and (distance == 8 * d.min(1)).all()


def coded(rows, n_parts=8, n_entries=16, rounds=6):
    """(code, error) by row and all entries, in plain Python."""
    kept = [(k, v) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=0) // n_parts))
    cut = [[([math.floor(4096 * x) for x in v] + [0] * (n_parts * width - len(v)))[p * width : (p + 1) * width] for p in range(n_parts)] for _, v in kept]
    start = sorted((i for i in range(len(kept)) if kept[i][0] is not None), key=lambda i: (kept[i][0], kept[i][1]))[:n_entries]
    books = [[cut[i][p] for i in start] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(n_parts)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(n_parts):
            for e in range(len(books[p])):
                of = [v[p] for v, a in zip(cut, found, strict=True) if a[p] == e]
                if of:
                    books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    out = [("".join(f"{e:02x}" for e in a), sum(far(v[p], books[p][e]) for p, e in enumerate(a))) for v, a in zip(cut, assign(), strict=True)]
    return [k for k, _ in kept], out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, _key long, _walsh int"


def test_codes_next_to_brute_force(spark):
    rng = random.Random(3)
    value = lambda: float(np.float32(rng.gauss(0, 0.3)))
    rows = [(i, [value() for _ in range(20)], i % 3 or None) for i in range(120)]
    rows += [(3, rows[3][1], 1), (None, [value() for _ in range(20)], None), (200, [value() for _ in range(11)], 1), (201, [], 2), (-5, rows[9][1], 2)]
    odd = [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")], 1), (303, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows + odd], VECTORS).repartition(5)
    keys, exp, sha = coded([r[:2] for r in rows])
    got = codes.compress(df).collect()
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == Counter((k, *e) for k, e in zip(keys, exp, strict=True))
    assert {r["codebooks_sha256"] for r in got} == {sha}
    total = defaultdict(int)
    label = {(k, e): l for (k, _, l), e in zip(rows, exp, strict=True)}
    for (k, _, l), (_, e) in zip(rows, exp, strict=True):
        total[l] += e
    assert all(r["label_error"] in set(total.values()) for r in got) and len(label) <= len(rows)
    assert {r["label_error"] for r in got} == set(total.values())


def test_codes_of_few_or_no_vectors(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    one = codes.compress(spark.createDataFrame([(4, [0.5] * 8, None, None, None, None, None)], VECTORS)).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 8, 0, 0)
    no_key = codes.compress(spark.createDataFrame([(None, [0.5] * 8, 1, None, None, None, None)], VECTORS)).first()
    assert no_key["code"] is None and no_key["error"] is None
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1e30], 1, None, None, None, None)], VECTORS))


def test_codes_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op12_vector_codes"](spark, sf)
    rel = con.execute(codes.oracle())
    assert [d[0] for d in rel.description] == got.columns
    assert sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))


# quality


def counted(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            marked |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)]


def odd_texts():
    rng = random.Random(5)
    bits = ["a", "b", "ab", "é", "字", " ", " ", " ", "\n", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "#", "|", "\r", "🙂", "1", "A."]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 300))) for _ in range(200)]
    return ["", None, " ", "\n\n", "x", "a b c", "a b c a b c", "a\na\na", "a a a a", "x y z\nx y z", "z" * 70_000, "w " * 5000, *made, *made[:3]]


def test_statistics_next_to_brute_force(monkeypatch):
    texts = odd_texts()
    for block in (1 << 21, 500):
        monkeypatch.setattr(quality, "BLOCK", block)
        counts, features = quality.statistics(pa.array(texts))
        assert counts.tolist() == [counted(t) for t in texts]
        assert np.isfinite(features).all()
    part = pa.array(["skipped", *texts])[1:]  # a slice has an offset
    assert quality.statistics(part)[0].tolist() == [counted(t) for t in texts]
    assert np.allclose(quality.statistics(pa.array(["aa b!\nC 1 #x"]))[1][0], [
        math.log1p(5), 8 / 5, math.log1p(2), 1 / 12, 0, 0, 1 / 12, 1 / 12, 2 / 12, 1 / 5, 0, 1 / 5, 1 / 5, 5 / 2, 0, 1, 5 / 5], atol=1e-6)


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(7)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) < 0.6) ^ (rng.random(4000) < 0.05)).astype(float)
    s = quality.Settings(trees=40)
    plain, tied = quality.grow(x, y, s), quality.grow(x, y, s, [-1, 0, 1])
    fresh = rng.random((2000, 3)).astype(np.float32)
    truth = fresh[:, 0] + 0.4 * np.sin(9 * fresh[:, 1]) < 0.6
    for trees in (plain, tied):
        assert ((trees.probability(fresh) > 0.5) == truth).mean() > 0.95
    line = np.linspace(0, 1, 200, dtype=np.float32)
    for row in fresh[:50]:
        many = np.repeat(row[None], 200, 0)
        many[:, 0] = line
        assert (np.diff(tied.margin(many)) <= 1e-12).all()
        many = np.repeat(row[None], 200, 0)
        many[:, 2] = line
        assert (np.diff(tied.margin(many)) >= -1e-12).all()

    def walk(t, row):
        total = t.base
        for node in t.root:
            while t.left[node] != node:
                node = t.left[node] + (row[t.feature[node]] > t.limit[node])
            total += t.value[node]
        return total

    assert np.allclose(tied.margin(fresh[:100]), [walk(tied, r) for r in fresh[:100]])
    for labels in (np.zeros(10), np.ones(10)):
        assert len(quality.grow(x[:10], labels, s).root) == 0
    assert len(quality.grow(x[:0], y[:0], s).root) == 0


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, features int, score string, n_words int"
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, 1, "x", 2) for i, t in enumerate(texts)] + [(1, "other text of a repeated key", 1, "x", 2)]
    measured = quality.measure(spark.createDataFrame(rows, schema))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99_999, 1)], "doc_id long, quality int")
    got = quality.judge(measured, quality.fit(measured, labels)).collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in got) == Counter((r[0], *counted(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)
    empty = quality.measure(spark.createDataFrame([], schema))
    assert quality.judge(empty, quality.fit(empty, labels.limit(0))).collect() == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    held = QUERIES["op13_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = held.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).collect()
    assert len(held) > 50 and sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


# trie


def nodes_of(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), x))
    convs = {c: [(r, x) for _, r, _, x in sorted(v, key=lambda a: a[:3])] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = set(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, c long, d long, words string, key string"


def same_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], CONVERSATIONS).repartition(6)
    got = [tuple(r) for r in trie.trie(df, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == nodes_of(rows)


def test_parentheses_next_to_a_stack():
    rng = random.Random(11)
    for _ in range(300):
        depth = [rng.randrange(0, 5)]
        while len(depth) < rng.randrange(1, 80):
            depth.append(rng.randrange(0, depth[-1] + 2))
        leaf = rng.random() < 0.5
        tree = trie.Parentheses(np.array(depth), leaf)
        close = tree.find_close()
        for i, d in enumerate(depth):
            end = next((j for j in range(i + 1, len(depth)) if depth[j] <= d), None)
            ended = end is not None or (leaf and i == len(depth) - 1)
            assert (close[i] < len(tree.bits)) == ended
            assert tree.opens_before[close[i]] == (end if end is not None else len(depth))
            inside = range(i, end if end is not None else len(depth))
            leaves = sum(depth[j + 1] <= depth[j] if j + 1 < len(depth) else leaf for j in inside)
            assert tree.pairs_before[close[i]] - tree.pairs_before[tree.open[i]] == leaves


def test_trie_of_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(c, t or None, rng.choice(["a", None, "b"]), rng.choice(["x", "y y", None, "x y z"])) for c in [*range(150), -40, -35, -21] for t in range(rng.randrange(0, 9)) if rng.random() < 0.9]
    rows += [(7, None, None, None)] * 3 + [(None, 1, "a", "x"), (1000, 1, "a", "word " * 20_000), (1001, 1, "a", "字\x1c字\x85")]
    same_trie(spark, rows)
    monkeypatch.setattr(trie, "STRETCH", 3)
    same_trie(spark, rows, shard=40)  # a spine that many shards share


def test_trie_of_one_long_and_many_equal_conversations(spark):
    long = [(400, i, "a", "deep") for i in range(700)]
    comb = [(401 + k, i, "a", "deep") for k in range(19) for i in range(60 + 20 * k)]
    equal = [(c, t, "user", f"t{t}") for c in range(1000, 1300) for t in range(3)]
    fan = [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(2000, 2200, 20) for t in range(3)]
    same_trie(spark, long + comb + equal + fan, shard=100)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    same_trie(spark, [(5, 1, "a", "x")])


def test_trie_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = QUERIES["op11_conversation_trie"](spark, sf)
    rel = con.execute(trie.ORACLE)
    assert sorted(d[0] for d in rel.description) == sorted(got.columns)
    assert set(rel.fetchall()) == {tuple(r) for r in got.select(*[d[0] for d in rel.description]).collect()}
