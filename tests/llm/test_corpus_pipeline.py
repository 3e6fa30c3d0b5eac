import re

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tickerloom.llm import language, mixing, registry
from tickerloom.llm.work import stage

CLASHING = ["size", "shard", "slot", "node", "lang_pred", "score", "block", "items", "_key", "_source", "_id", "_hash", "_size", "_lang",
            "_text", "_bad_id", "_block", "row", "id", "hash", "component", "entry", "at", "placed", "spread", "gone_id", "text2"]
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, folder, name):
    result = check.compare(registry.QUERIES[name](spark, folder), check.duck(folder).sql(registry.ORACLES[name]))
    assert result.startswith("ok"), result


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]


def words(text, pattern):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(pattern, low)


def shingles(text):
    w = words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def first_of_each(rows):
    """Ids that stay of a list of (id, text), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def clean_of(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for text in items:
        w = words(text, pattern)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    out = set()
    for i, text in rows:
        w = words(text, pattern)
        if not any(tuple(w[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(w) - n + 1)):
            out.add(i)
    return out


def test_stages_equal_brute_force(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, apply in P.STAGES:
        result, _ = stage(apply(spark, docs, folder), name)
        rows = [(r.doc_id, r.text) for r in before]
        after = result.collect()
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after) and {(r.doc_id, r.text) for r in after} <= set(rows)
        if name != "shards":
            assert result.columns == DOC_COLUMNS
        if name == "language":
            assert ids == {i for i, t in rows if t and re.search(r"[^\W\d_]", t)}
        elif name == "near_duplicates":
            assert ids == first_of_each(rows)
        elif name == "decontamination":
            assert ids == clean_of(rows, items) and len(ids) < len(rows)
        elif name == "shards":
            assert ids == {i for i, _ in rows} and result.columns == [*DOC_COLUMNS, "size", "shard", "slot"]
        docs, before = result, after
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_rows_pass_all_stages(spark, docs, tmp_path):
    long = " ".join(f"l{i}" for i in range(40_000))
    rows = docs((1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7),
                (4, long, None, "b", 1), (None, "words without an id", "fr", None, 1), (5, "12 34", "en", "a", 5),
                (6, "q0 q1 q2 q3", "en", "b", 1)).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(0)).cast("string"))
                                                       for c in CLASHING})
    folder = str(tmp_path)
    spark.createDataFrame([(1, "q0 q1 q2 q3"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, table in (("odd", rows), ("none", rows.limit(0))):
        table.write.parquet(f"{folder}/{name}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{folder}/{name}/benchmark.parquet")
        got = P.run(spark, f"{folder}/{name}").collect()
        assert {r.doc_id for r in got} == ({3, 4, None} if name == "odd" else set()) and len(got) in (0, 3)
        for r in got:
            kept = [c for c in CLASHING if c not in ("size", "shard", "slot")]
            assert [r[c] for c in kept] == [f"{c} of {r.doc_id or 0}" for c in kept]
            assert r.size == len(r.text.encode()) + 8 and 0 <= r.shard < 24 and r.slot == 0


def test_language_stage_rejects_only_what_has_no_letter(spark, folder, docs):
    rows = docs((1, "x"), (2, "%%% 123"), (3, "ñ"), (4, "mixed 中文 text"), (5, None))
    assert {r.doc_id for r in P.languages(spark, rows.withColumn("lang", F.lit("en")), folder).collect()} == {1, 3, 4}
    assert language.UNKNOWN == "und"


@pytest.mark.parametrize("label", [None, "und"])
def test_language_stage_keeps_lettered_rows_without_a_usable_label(spark, folder, docs, label):
    rows = docs(*[(i, f"some words {i}") for i in range(20)], (21, "%%% 123"), (22, None))
    rows = rows.withColumn("lang", F.lit(label).cast("string"))
    assert {r.doc_id for r in P.languages(spark, rows, folder).collect()} == set(range(20))


def test_shards_keep_the_order_of_the_mixture(spark, folder, docs):
    rows = docs(*[(i, f"{i} " + "t" * 9_000, "en", "big" if i % 8 else f"s{i % 3}", 0) for i in range(400)])
    slots = {r.doc_id: r.slot for r in mixing.schedule(rows, until_first=False).collect()}
    mixed, _ = stage(P.mixture(spark, rows, folder), "mixed")
    got = {}
    for r in sorted(P.shards(spark, mixed, folder).collect(), key=lambda r: (r.shard, r.slot)):
        got.setdefault(r.shard, []).append(slots[r.doc_id])
        assert r.slot == len(got[r.shard]) - 1
    assert all(own == sorted(own) for own in got.values()) and len(set(slots.values())) > 40 and len(got) == 24
