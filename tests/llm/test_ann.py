import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import ann as A
from tickerloom.llm.queries import op3

SCHEMA = "vec_id bigint, embedding array<float>, rank int"


def brute(ids, vectors, asked, k):
    """{query: [(score, id)]} over all other items."""
    out = {}
    for q in np.unique(ids[asked]):
        mine = vectors[(ids == q) & asked]
        best = {}
        for i, v in zip(ids, vectors, strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), *((v * m).sum() for m in mine))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def got_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_cases(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((60, 8)).astype(np.float32)
    vectors[10:40] = vectors[10]  # one vector many times: ties
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    bad = [(100, None, 1), (120, [0.0] * 8, 1), (140, [float("nan")] * 8, 1), (160, [1.0] * 7 + [None], 1),
           (180, [float("inf")] * 8, 1), (200, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (220, [], 1)]
    frame = spark.createDataFrame(rows + bad + rows[:1], SCHEMA)
    got = got_of(A.nearest(frame, F.col("vec_id") % 20 == 0, k=20))
    ids = np.arange(60)
    want = brute(ids, vectors.astype(float), ids % 20 == 0, 20)
    assert got == want
    few = got_of(A.nearest(frame.filter("vec_id < 5"), F.col("vec_id") % 2 == 0, k=20))
    assert {q: len(v) for q, v in few.items()} == {0: 4, 2: 4, 4: 4}
    assert A.nearest(frame.limit(0), F.lit(True)).collect() == []
    assert A.nearest(frame.filter("vec_id >= 100"), F.lit(True)).collect() == []
    alone = spark.createDataFrame(rows[:1], SCHEMA)
    assert A.nearest(alone, F.lit(True)).collect() == []


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_SLICE", 7)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((700, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA)
    got = got_of(A.nearest(frame, F.col("vec_id") % 20 == 0, k=5, probes=1.0, deviations=50.0, block=50, sample=200))
    ids = np.arange(700)
    want = brute(ids, vectors.astype(float), ids % 20 == 0, 5)
    assert got == want  # all lists, and tests that abandon nothing: the exact answer


def test_tests_abandon_most_and_lose_few():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((4000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    scans = [A.Scan.of(np.arange(n), v, rotation, 16) for n, v in ((50, vectors[:50]), (4000, vectors))]
    products = vectors[:50] @ vectors.T
    floors = np.sort(products, axis=1)[:, -21]
    q, v = scans[1].survivors(scans[0], floors, A.DEVIATIONS)
    good = products >= floors[:, None]
    kept = np.zeros_like(good)
    kept[q, v] = True
    assert kept.sum() < 0.2 * kept.size and (kept & good).sum() > 0.97 * good.sum()


def test_clustered_vectors_visit_few_lists_and_plain_ones_most():
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((4000, 32))
    centres = rng.standard_normal((60, 32))
    clustered = centres[rng.integers(0, 60, 4000)] + 0.15 * rng.standard_normal((4000, 32))
    ids = np.arange(4000)
    visits = [A.visits_for(A.Index.fitted(ids, v, 50, 500), ids, v, 20) for v in (clustered, plain)]
    assert visits[0] <= 5 and 20 < visits[1] <= 50
    assert A.visits_for(A.Index.fitted(ids[:1], plain[:1], 1, 1), ids[:1], plain[:1], 20) == 1


def test_query_recall(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(frame["embedding"]).astype(float), frame["vec_id"].to_numpy()
    want = brute(ids, vectors, ids % 20 == 0, 20)
    got = got_of(op3(spark, folder))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    place = {i: n for n, i in enumerate(ids)}
    for q, own in got.items():
        assert own == sorted(own)
        for score, i in own:
            assert -score == pytest.approx((vectors[place[q]] * vectors[place[i]]).sum(), abs=1e-14)


def test_rows_come_from_the_scan_alone(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((1200, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA)
    got = got_of(A.nearest(frame, F.col("vec_id") % 20 == 0, k=10, probes=0.01))
    want = brute(np.arange(1200), vectors.astype(float), np.arange(1200) % 20 == 0, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert all(len(got[q]) == 10 for q in want) and hits < 0.7 * 10 * len(want)  # one list of 17


def test_recall_of_the_index_beyond_the_sample(spark, tmp_path):
    rng, n = np.random.default_rng(10), 30_000
    vectors = rng.standard_normal((n, 32)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(vectors)}).to_parquet(tmp_path / "v.parquet")
    got = got_of(A.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 100 == 0))
    hits = 0
    for q in range(0, n, 100):
        products = vectors @ vectors[q]
        products[q] = -np.inf
        hits += len({i for _, i in got[q]} & set(np.argpartition(-products, 20)[:20].tolist()))
        assert len(got[q]) == 20
    assert hits >= 0.9 * 20 * (n // 100)


def test_repeated_rows_leave_room_for_others(spark):
    vectors = np.random.default_rng(12).standard_normal((40, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    got = got_of(A.nearest(spark.createDataFrame(rows + rows * 30, SCHEMA), F.col("vec_id") == 0, k=5, probes=1.0, deviations=50.0))
    assert got == brute(np.arange(40), vectors.astype(float), np.arange(40) == 0, 5)
