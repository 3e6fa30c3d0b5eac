import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import bloom, url_filter as U


def test_hosts_and_paths(spark):
    urls = ["http://A.Example.ORG:80/es/x?y#z", "no scheme/x", None, "", "x://", "ftp://h", "http://h?q://i/j", "http://h#f/g",
            "a://b//c://d", "HTTP://É.com/é", "http://h/p\nq"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select(U.host_of("url"), U.path_of("url"))
    assert [tuple(r) for r in frame.collect()] == [
        ("a.example.org:80", "/es/x"), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("h", ""),
        ("b", "//c://d"), ("É.com", "/é"), ("h", "/p\nq")]


def test_the_longest_rule_that_fits_wins(spark):
    rules = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("allow", "a.example.org", "/es/ok")]
    rows = [("x.org", "/"), ("org", "/a"), ("xorg", "/a"), ("x.org", ""), ("example.org", "/es/1"), ("b.example.org", "/es/"),
            ("a.example.org", "/es/ok/1"), ("a.example.org", "/es/no"), ("notexample.org", "/es/")]
    frame = spark.createDataFrame(rows, "host string, path string").withColumns(U.rule_columns(rules))
    assert [r.rule for r in frame.collect()] == [
        "org/", "org/", None, None, "example.org/es/", "example.org/es/", "a.example.org/es/ok", "example.org/es/", "org/"]


def universe(spark, n, listed):
    frame = spark.range(n).select(F.concat(F.lit("h"), "id").alias("key"))
    return frame.withColumn("listed", F.expr(listed))


def test_membership_is_exact_in_several_segments(spark, monkeypatch):
    monkeypatch.setattr(U, "SEGMENT_KEYS", 300)
    keys = universe(spark, 4000, "crc32(key) % 5 = 0")
    rows = keys.withColumnRenamed("listed", "truth").withColumn("_key", F.lit("own")).unionByName(
        spark.createDataFrame([(None, False, "own")], "key string, truth boolean, _key string"))
    got = U.with_listed(rows, "key", keys).collect()
    assert len(got) == 4001 and all(r.listed == r.truth for r in got)
    assert 3 <= sum(r.truth for r in got) // 300 + 1


def test_levels_alternate(spark):
    hashed = universe(spark, 3000, "id % 3 = 0".replace("id", "crc32(key)")).select(
        F.xxhash64("key").alias("_key"), F.col("listed").alias("_listed"))
    levels = U.build_cascade(hashed)
    frame = hashed.toPandas()
    keys, truth = frame["_key"].to_numpy(), frame["_listed"].to_numpy()
    assert len(levels) >= 2
    assert (bloom.lets_through(keys, levels[0]) != truth).any()  # one filter alone lets wrong keys through
    assert (U.listed_by(keys, levels) == truth).all()
    assert sum(len(x.words) for x in levels) * 64 < 12 * truth.sum()


def test_cases(spark):
    none = universe(spark, 50, "false")
    assert not any(r.listed for r in U.with_listed(none.select("key"), "key", none).collect())
    every = universe(spark, 50, "true")
    assert all(r.listed for r in U.with_listed(every.select("key"), "key", every).collect())
    assert U.with_listed(every.select("key").limit(0), "key", every.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, True), (1, False)], "_key bigint, _listed boolean")
    assert U.build_cascade(clash) is None
    assert not U.listed_by(np.arange(5), []).any()
