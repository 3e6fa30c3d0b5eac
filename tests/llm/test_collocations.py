import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import collocations as C, registry

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, longest=4, least=30, subsumed=80, best=2000):
    """(lang, rank, phrase, a, l, r, n, score), phrase by phrase."""
    count, total = {}, Counter()
    for lang, text in rows:
        own = count.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in count.items():
        able = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        found = []
        for p, a in able.items():
            holds = [b for q, b in able.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= subsumed * a for b in holds):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(seed, count=120):
    rng = np.random.default_rng(seed)
    fixed = [[f"P{i}", f"q{i}", f"r{i % 3}", "s", f"é{i}"][: 2 + i % 4] for i in range(9)]
    for i in range(count):
        words = []
        for _ in range(rng.integers(0, 14)):
            words += fixed[rng.integers(0, 9)] if rng.random() < 0.6 else [f"w{min(rng.integers(1, 99), rng.integers(1, 99)) // 9}"]
            words += [rng.choice([".", ",", "\n", "\t", "?!", ""])]
        yield (["en", "fr", None][i % 3], " ".join(words))


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("shape", ["plain", "small chunks", "many filters", "many buckets"])
def test_equals_brute_force(spark, docs, monkeypatch, shape):
    if shape == "small chunks":  # phrases across chunks, and texts across portions
        monkeypatch.setattr(C, "CHUNK", 7)
        monkeypatch.setattr(C, "portions", lambda raw, real=C.portions: real(raw, 20))
    elif shape == "many filters":
        monkeypatch.setattr(C, "FILTER_KEYS", 5)
    elif shape == "many buckets":  # so nearly all stripes are cut
        monkeypatch.setattr(C, "BUCKET_BYTES", 20)
    rows = list(texts(len(shape)))
    frame = docs(*[(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)]).coalesce(2)
    want = brute(rows, least=4, best=25)
    assert got(C.collocations(frame, least=4, best=25)) == want
    assert len(want) > 30 and max(len(w[2].split()) for w in want) == 4


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths(spark, docs, longest):
    rows = list(texts(longest))
    frame = docs(*[(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    assert got(C.collocations(frame, longest=longest, least=5)) == brute(rows, longest=longest, least=5)


def test_cases(spark, docs):
    long = "alpha beta " * 40_000
    rows = [(None, None), ("en", ""), ("en", " . , "), ("xx", long), ("en", "a b c d. " * 31), ("en", "A B\tc d; " * 31), (None, "a b " * 31)]
    frame = docs(*[(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    odd = frame.withColumns({c: F.lit("mine") for c in ("words", "n", "a", "rank", "phrase", "key", "number", "word")})
    assert got(C.collocations(odd)) == brute(rows) != []
    assert C.collocations(frame.limit(0)).count() == 0
    assert C.collocations(frame.limit(1)).count() == 0


def test_query_equals_sql_where_phrases_are(spark):
    import os

    import check

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are not here")
    frame = registry.QUERIES["op11_collocations"](spark, folder)
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in frame.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    result = check.compare(frame, check.duck(folder).sql(registry.ORACLES["op11_collocations"]))
    assert result.startswith("ok"), result
