import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import ngram_join as J
from tickerloom.llm.queries import op2


def shingles(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """{doc_id: (set size, least doc_id of its component)} by comparing all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return [(name, len(sets[i]), least[find(i)]) for i, (name, _) in enumerate(rows)]


def near_copies(seed, groups=6, size=9, words=60):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 40 if g % 2 else 4000, words)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, 4)):
                own[at] = f"n{rng.integers(0, 9)}"
            out.append(" ".join(own[: words - rng.integers(0, 8)]))
    rng.shuffle(out)
    return out


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_linked_sets_share_a_key(monkeypatch, percent):
    monkeypatch.setattr(J, "RARE", 3)
    monkeypatch.setattr(J, "PAIR_SIZE", 40)
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(12):
        base = rng.choice(200, rng.integers(2, 60), replace=False)
        for _ in range(5):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 400, rng.integers(0, 4))]).astype(np.uint64))
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    texts = dict(zip(every.tolist(), counts.tolist(), strict=True))
    keys = []
    for s in sets:
        own = sorted((t for t in s.tolist() if texts[t] > 1), key=lambda t: (texts[t], t))
        part = np.array(own, dtype=np.uint64), np.array([texts[t] for t in own])
        keys.append(set(J.keys_of(len(s), *part, percent).tolist()))
    linked = 0
    for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2):
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both) and len(x) != both:
            linked += 1
            assert keys[a] & keys[b]
    assert linked or percent == 100


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_bitmaps_rule_out_no_link_and_most_others(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**62, rng.integers(5, 700))
        for _ in range(4):
            sets.append(np.unique(np.r_[base[rng.random(len(base)) > 0.06], rng.integers(0, 2**62, rng.integers(0, 9))]))
    # Every set shares one key with all others, and holds some tokens that no other has.
    frame = J.pd.DataFrame({"key": 1, "node": np.arange(len(sets)), "n": [len(s) for s in sets], "held": [len(s) for s in sets],
                            "bits": [J.bitmap(s) for s in sets]})
    told = J._may_link(frame, percent)
    label = J.united(np.arange(len(sets)), told["a"].to_numpy(), told["b"].to_numpy())
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            assert label[a] == label[b]
    assert len(set(label.tolist())) >= 12


@pytest.mark.parametrize("crowd", [1, 256])
def test_clusters_hold_all_links(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(J, "KEY_TEXTS", crowd)  # with 1 every key joins all its texts
    monkeypatch.setattr(J, "MAP_PAIRS", 7)
    rows = list(enumerate(near_copies(9)))
    assert pairs(J.joined(docs(*rows), words=3, percent=70).select("doc_id", "n_shingles", "component_id")) == sorted(brute(rows, 3, 70))


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(5)
    tokens = [np.unique(rng.integers(0, 30, 14)) for _ in range(60)]
    sizes = np.array([len(t) for t in tokens])
    links = J.linked_pairs(sizes, tokens, None, 50)
    want = {frozenset((a, b)) for a, b in itertools.combinations(range(60), 2)
            if 2 * len(np.intersect1d(tokens[a], tokens[b])) >= len(np.union1d(tokens[a], tokens[b]))}
    assert {frozenset(x) for x in links} <= want and len(links) < 60

    def parts(edges):
        root = list(range(60))
        for a, b in (tuple(e) for e in edges):
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    assert parts(links) == parts(want)
    side = np.arange(60) % 2
    across = J.linked_pairs(sizes, tokens, side, 50)
    assert all(side[a] != side[b] for a, b in across)
    assert parts(across) == parts([e for e in want if len({side[i] for i in e}) == 2])


@pytest.mark.parametrize("small_blocks", [False, True])
def test_components_equal_brute_force(spark, docs, monkeypatch, small_blocks):
    if small_blocks:  # clusters of several blocks, many counting buckets
        monkeypatch.setattr(J, "BLOCK_TEXTS", 4)
        monkeypatch.setattr(J, "BLOCK_TOKENS", 400)
    texts = near_copies(3)
    rows = [(100 + 7 * i % 101, t) for i, t in enumerate(texts)]
    got = J.joined(docs(*rows), words=3, percent=70).select("doc_id", "n_shingles", "component_id")
    assert pairs(got) == sorted(brute(rows, 3, 70))


def test_cases(spark, docs):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(5, "One two THREE four"), (3, "one\ttwo three\nfour"), (9, "a b"), (8, "A  b"), (7, "a b c"), (1, None), (2, ""),
            (4, " \n"), (11, long), (10, long + " more"), (5, "One two THREE four")]
    frame = docs(*rows).withColumns({"component_id": F.lit("x"), "node": F.lit(1), "n": F.lit(2), "prefix": F.lit("p")})
    got = J.joined(frame, words=4, percent=85).select("doc_id", "n_shingles", "component_id")
    assert pairs(got) == sorted(brute(rows, 4, 85))
    assert J.joined(frame.limit(0)).count() == 0
    nulls = J.joined(docs((None, "a b c d e"), (6, "a b c d e"), (None, None))).collect()
    assert sorted((r.component_id or 0, r.n_shingles) for r in nulls) == [(0, 0), (6, 2), (6, 2)]


def test_one_of_each_component_stays(spark, docs):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(4, base), (2, base + " x"), (3, base), (9, "other words are here now"), (9, "other words are here now"),
            (7, None), (8, ""), (6, "w1 w2 w3")]
    frame = docs(*rows).withColumn("component", F.lit("mine"))
    left = J.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 6, 7, 8, 9]
    assert J.one_of_each(frame.limit(0)).count() == 0


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert pairs(op2(spark, folder)) == sorted(brute(rows, 4, 85))
