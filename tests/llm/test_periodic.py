import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import periodic as P
from tickerloom.llm.queries import op12

RNG = np.random.default_rng


def brute(words):
    """(start, length, period) of all runs, period by period, each word looked at."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                # The same stretch has been found with its smallest period if that is less.
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def left_over(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_texts(seed, count=60):
    rng = RNG(seed)
    for _ in range(count):
        parts = []
        for _ in range(rng.integers(1, 6)):
            p = int(rng.integers(1, 12 if rng.random() < 0.7 else 60))
            root = rng.integers(0, rng.integers(1, 5), p).tolist()
            parts += (root * 12)[: int(p * rng.uniform(0.5, 9))]
            parts += rng.integers(0, 4, rng.integers(0, 6)).tolist()
        yield parts


def numbers(words):
    return np.array(words, dtype=np.uint64)


@pytest.mark.parametrize("portion", [1, 7, 64, 10_000])
def test_runs_equal_brute_force_however_words_are_appended(portion):
    for words in random_texts(portion):
        catchers = P.Catchers(len(words))
        for at in range(0, len(words), portion):
            catchers.append(numbers(words[at : at + portion]))
        assert [tuple(r) for r in catchers.runs().tolist()] == brute(words)


@pytest.mark.parametrize(("short", "portion"), [(2048, 65_536), (20, 50), (0, 16)])
def test_texts_of_a_batch_equal_brute_force(monkeypatch, short, portion):
    monkeypatch.setattr(P, "SHORT", short)
    monkeypatch.setattr(P, "PORTION", portion)
    texts = [*random_texts(77, 80), [], [1], [1] * 5, [1] * 6, [1] * 7, [2, 2, 2], [2] * 40]
    got = P.runs_of([numbers(t) for t in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t) for t in texts]


def test_all_short_texts_of_two_words():
    for n in range(1, 15):
        texts = [[x >> i & 1 for i in range(n)] for x in range(1 << n)]
        for text, got in zip(texts, P.runs_of([numbers(t) for t in texts]), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute(text)


def test_long_texts_take_linear_time_and_whole_periods():
    one = P.runs_of([np.zeros(1_000_000, dtype=np.uint64)])[0]
    assert one.tolist() == [[0, 1_000_000, 1]]
    rng = RNG(1)
    root = rng.integers(0, 1 << 40, 70_000).astype(np.uint64)
    tail = rng.integers(0, 1 << 40, 50_000).astype(np.uint64)
    text = np.concatenate([tail[:1234], np.tile(root, 5)[:290_000], tail])
    assert P.runs_of([text])[0].tolist() == [[1234, 290_000, 70_000]]


def test_collapsed_text_and_cases(spark, docs):
    long = " ".join(["same"] * 200_000 + ["other"])
    texts = ["a b a b a b a b c", "x  x\tx x x x\ny", None, "", " \n", "é é é é é é", "A a A a A a A a", "1 2 3", long]
    rows = docs(*enumerate(texts), (None, "q q q q q q q"), (1, texts[1]))
    frame = rows.withColumns({c: F.lit("mine") for c in ("runs", "collapsed", "n_words", "id", "raw", "by")})
    got = P.periodic_runs(frame).collect()
    assert got[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed"] and len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 200_000, 1)] if text == long else brute(words)
        assert by_id[i].n_words == len(words) and [tuple(r) for r in by_id[i].runs] == runs
        assert by_id[i].collapsed == ("same other" if text == long else " ".join(left_over(words, runs)))
    assert by_id[None].collapsed == "q"
    assert P.periodic_runs(rows.limit(0)).count() == 0


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, folder):
    want, some = set(), 0
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    for r in rows:
        words = planted(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), r.doc_id)
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        some += bool(runs)
        want.add((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                  sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(left_over(words, runs)))))
    got = op12(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want and some > 10
    assert {t for _, t in got.dtypes[1:6]} == {"bigint"}
