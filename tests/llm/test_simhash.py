import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import simhash as S, words as W
from tickerloom.llm.queries import op13


def lowered(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text, k=4):
    w = lowered(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def brute_prints(spark, texts, k=4):
    """Fingerprints bit by bit, from hashes that Spark's own function gives (seed 42)."""
    parts = sorted({s for t in texts for s in shingles(t, k)})
    rows = spark.createDataFrame([(s,) for s in parts], "s string").select("s", F.xxhash64("s").alias("h"))
    known = {r.s: r.h % 2**64 for r in rows.collect()} if parts else {}
    out = []
    for t in texts:
        own = [known[s] for s in shingles(t, k)]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return out


def brute_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            root[find(a)] = find(b)
    least = {}
    for i, name in enumerate(ids):
        least[find(i)] = min(least.get(find(i), name), name)
    return [least[find(i)] for i in range(len(ids))]


def near_texts(seed, groups=8, size=8, words=120):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 400, words)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, 3)):
                own[at] = f"N{rng.integers(0, 9)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("m", "distance"), [(2, 4), (3, 4), (4, 4), (3, 3), (5, 4), (2, 1)])
def test_every_pair_within_the_distance_meets_in_a_table(m, distance):
    rng = np.random.default_rng(m)
    parts = S.cut(m, distance)
    assert sum(p.width for p in S.cut(m, 64)) == 64
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) << 1
        b = a
        for bit in rng.choice(64, rng.integers(1, distance + 1), replace=False):
            b ^= 1 << int(bit)
        meets = False
        for p in parts:
            x, y = (int(p.values(np.array([v], dtype=np.uint64))[0]) for v in (a, b))
            meets |= x == y or (x ^ y) in p.ball()
        assert meets


@pytest.mark.parametrize("block", [3, 8192])
def test_links_join_what_all_links_join(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "STEP", 50)
    rng = np.random.default_rng(block)
    prints = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        for _ in range(12):
            own = centre
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                own ^= 1 << int(bit)
            prints.add(own)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print bigint").repartition(3)
    joined = {(r.a % 2**64, r.b % 2**64) for r in S.links(rows, len(prints), 4).collect()}
    place = {p: i for i, p in enumerate(prints)}
    label = S.united(np.arange(len(prints)), np.array([place[a] for a, _ in joined]), np.array([place[b] for _, b in joined]))
    want = brute_components(list(range(len(prints))), prints)
    assert label.tolist() == want and len(set(want)) < len(want)


def test_long_texts_are_taken_in_portions(monkeypatch):
    text = ("Alpha beta\tgamma  delta\n" * 500 + "x" * 300 + " y z").encode()
    whole = S.fingerprint(text)
    assert [w for part in W.portions(text, 64) for w in part] == text.lower().split()
    monkeypatch.setattr(S, "portions", lambda t: W.portions(t, 7))
    assert S.fingerprint(text) == whole


@pytest.mark.parametrize("block", [4, 8192])
def test_components_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = near_texts(5) + ["", "  ", "one", "One", "one two three", "one two three four"]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_copies(docs(*rows)).collect()}
    prints = brute_prints(spark, texts)
    want = brute_components([i for i, _ in rows], prints)
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True)}
    assert len(set(want)) < len({p for p in prints})


def test_cases(spark, docs):
    long = " ".join(f"l{i % 5000}" for i in range(60_000))
    rows = docs((5, None), (4, ""), (9, "\t\n"), (7, long), (6, long + " more"), (3, "a b"), (3, "a b"), (None, "A  B"), (8, "a b c d"))
    frame = rows.withColumns({c: F.lit("mine") for c in ("fingerprint", "component_id", "print", "id", "key", "root")})
    got = S.near_copies(frame).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [
        (0, 3), (3, 3), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 4)]
    assert {r.fingerprint for r in got if r.doc_id in (4, 5, 9)} == {"0" * 16}
    assert S.near_copies(rows.limit(0)).count() == 0
    alone = S.near_copies(docs((None, "x y z"), (None, None))).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints = brute_prints(spark, [t for _, t in rows])
    want = brute_components([i for i, _ in rows], prints)
    got = {tuple(r) for r in op13(spark, folder).collect()}
    assert got == {(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True)}
