import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import decontamination as D

ITEMS = "item_id bigint, text string"


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, raw in items:
        w = words(raw)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def got_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.counted(frame).collect()), key=str)


@pytest.mark.parametrize("most", [400_000, 7])
def test_hits_equal_brute_force(spark, docs, most):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 9, 10, 11, 14, 0, 10])] + [(20, None), (21, "w1-W2.w3")]
    rows = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 30))]
    rows += [(100, "A " + items[8][1] + " B"), (101, items[6][1].upper() + "," + items[7][1].replace(" ", "\n")), (102, None),
             (103, "é " + items[6][1] + "é"), (104, "w1 w2w3")]
    got = got_of(D.benchmark_hits(docs(*rows), spark.createDataFrame(items, ITEMS), window=10, most_windows=most))
    assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=str)


@pytest.mark.parametrize("most", [400_000, 2])
def test_cases(spark, docs, most):
    item = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(7, item), (7, item), (12, item), (None, item)], ITEMS).withColumn("words", F.lit("x"))
    long = " ".join(f"l{i}" for i in range(60_000)) + " " + item
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, long), (5, " ".join(item.split()[:9])), (6, "..")]
    frame = docs(*rows).withColumns({"items": F.lit("x"), "n_words": F.lit("x"), "_text": F.lit("x")})
    hits = got_of(D.benchmark_hits(frame, items.filter("item_id IS NOT NULL"), most_windows=most))
    assert [h[1:] for h in hits if h[0] in (1, 2, 6)] == [(0, 0, [])] * 3
    assert [h[2:] for h in hits if h[0] in (3, None)] == [(14, ["12", "7"])] * 3
    assert [h[1:] for h in hits if h[0] == 4] == [(60_014, 14, ["12", "7"])]
    assert [h[2] for h in hits if h[0] == 5] == [0]
    left = D.decontaminate(frame, items, most_windows=most)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6]
    assert D.decontaminate(frame, items.limit(0)).count() == len(rows)
    assert D.decontaminate(frame.limit(0), items).count() == 0
