import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import warc as A
from tickerloom.llm.queries import op5
from tickerloom.session import work_path

PAGES = "page_id bigint, url string, html string"


def files(path):
    import glob

    return [gzip.open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    big, breaks = "x" * 1500, "a\r\n\r\nWARC/1.0\r\nb\n\n1 2 3 4 5\n" * 60
    rows = [(1, "http://a.b/", big), (2, "http://a.b/?q=1", big), (3, "http://c d/\n", breaks), (4, None, None),
            (5, "http://e/", ""), (6, "http://f/", "é" * 40), (7, "http://f/", "é" * 40), (2, "http://again/", big),
            (8, "http://g/", "z" * 2_000_000), (None, "http://n/", big), (9, "http://n/", breaks)]
    frame = spark.createDataFrame(rows, PAGES).withColumns({"key": F.lit("x"), "digest": F.lit("y")}).repartition(3)
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    A.write_arc(frame, arc, "page_id", "url", "html", version=version)
    read = A.read_arc(spark, arc).collect()
    assert {r.version for r in read} == {version} and all(r.problem is None for r in read)
    assert sorted((r.key or "", bytes(r.payload).decode()) for r in read) == sorted(
        (str(i) if i else "", h or "") for i, _, h in rows)
    A.convert(spark, arc, warc)
    back = A.read_warc(spark, warc).collect()
    assert len(back) == len(rows) and len({r.record_id for r in back}) == len(back)
    for r in back:
        assert r.problem is None and (r.record_type == "revisit") == (r.payload is None)
        assert r.digest_ok is (None if r.record_type == "revisit" else True)
    got = sorted((int(r.key or 0), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i or 0)
    want = []
    for i, _, h in rows:
        raw, kept = (h or "").encode(), max(groups[h or ""])
        again = len(raw) >= 1000 and (i or 0) != kept
        want.append((i or 0, "revisit" if again else "response", str(kept) if again else None, len(raw),
                     hashlib.sha1(raw).hexdigest()))
    assert got == sorted(want)
    text = files(warc)[0].decode()
    assert text.startswith("WARC/1.0\r\nWARC-Type: warcinfo\r\n") and text.endswith("\r\n\r\n")
    one = next(r for r in back if r.payload and bytes(r.payload) == big.encode())
    digest = base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()
    every = "".join(f.decode() for f in files(warc))
    assert f"WARC-Payload-Digest: sha1:{digest}" in every and f"WARC-Refers-To: {one.record_id}" in every
    assert one.date == "2024-01-01T00:00:00Z"


def test_foreign_records():
    other = b"http://x/ 1.2.3.4 19970102030405 image/gif 4\nGIF!\n"
    assert [(r["url"], r["payload"], r["http"], r["date"]) for r in A.arc_records(other)] == [
        ("http://x/", b"GIF!", b"", "19970102030405")]
    two = b"http://x/ 1.2.3.4 19970102030405 text/plain 200 - - 17 f.arc 3\nabc\n"
    assert [r["version"] for r in A.arc_records(two)] == [2]
    broken = list(A.arc_records(other + b"no header here\n" + other))
    assert [r["problem"] is None for r in broken] == [True, False, True] and "no header" in broken[1]["problem"]
    assert broken[1]["problem_at"] == len(other)
    short = list(A.arc_records(other[:-3]))
    assert "of 4 bytes" in short[0]["problem"]
    assert list(A.arc_records(b"")) == [] and list(A.warc_records(b"")) == []
    assert "no record" in next(A.warc_records(b"junk"))["problem"]
    blank = b"http://x/a b 1.2.3.4 19970102030405 text/html 2\nok\n"
    named = b"filedesc://f 0.0.0.0 19970101000000 text/plain 65\n1 0 us\nURL IP-address Archive-date Content-type Archive-length\n\n"
    assert [r["url"] for r in A.arc_records(named.replace(b" 65\n", b" %d\n" % (len(named.split(b"\n", 1)[1]) - 1)) + blank)] == [
        "http://x/a b"]


def record(name, body, size=None):
    return f"http://{name}/ 1.2.3.4 19970102030405 text/plain {len(body) if size is None else size}\n".encode() + body + b"\n"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("bad", [
    b"a bad line\n", b"junk 1\nmore junk 2 3 4\n\n", record("long", b"some text", 9_999), record("short", b"one\ntwo\nthree", 5),
    record("over", b"xyz", len(record("b", b"1 2 3 4 5\n")) - 4), b"http://x/ 1.2.3.4 notadate text/plain 3\nabc\n", b"\xff\xfe\n" * 50,
])
def test_reading_goes_on_behind_damage(bad, packed):
    a, b, c = record("a", b"first"), record("b", b"1 2 3 4 5\n"), record("c", b"")
    content = a + bad + b + c
    got = list(A.arc_records(gzip.compress(content) if packed else content))
    urls = [r["url"] for r in got if not r["problem"]]
    assert urls[0] == "http://a/" and urls[-1] == "http://c/" and "http://b/" in urls
    problems = [r for r in got if r["problem"]]
    assert problems and all(len(a) <= r["problem_at"] < len(a + bad) + len(b) for r in problems)


def test_many_damaged_records_take_linear_time():
    import time

    content = gzip.compress((record("short", b"q " * 500 + b"\nend", 100) + record("fine", b"w" * 900)) * 5_000)
    start = time.process_time()
    got = list(A.arc_records(content))
    assert sum(r["problem"] is None for r in got) == 5_000 and time.process_time() - start < 20


def test_a_cut_gzip_file_gives_its_records_and_the_problem():
    raw = gzip.compress(b"".join(record(f"p{i}", bytes(str(i * i), "ascii") * 50) for i in range(4_000)))
    got = list(A.arc_records(raw[: len(raw) // 2]))
    assert len(got) > 500 and "damaged file" in got[-1]["problem"] and sum(r["problem"] is None for r in got) >= len(got) - 2
    assert "damaged file" in list(A.warc_records(raw[:40]))[-1]["problem"]


def test_conversion_gives_the_problems_out(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(record("a", b"first") + b"a bad line\n" + record("b", b"second") + record("c", b"cut", 10))
    warc = work_path(spark, "warc")
    problems, _ = A.convert(spark, f"file://{tmp_path}", warc)
    assert sorted((r.file.rsplit("/", 1)[1], r.problem.split(":")[0]) for r in problems.collect()) == [
        ("part-0", "3 of 10 bytes"), ("part-0", "no header of version 1")] or problems.count() == 2
    back = A.read_warc(spark, warc).collect()
    assert sorted(r.url for r in back) == ["http://a/", "http://b/"] and all(r.digest_ok for r in back)


def test_empty_table(spark):
    back, _ = A.archived(spark.createDataFrame([], PAGES))
    assert back.collect() == []


def test_a_page_twice_is_stored_twice(spark):
    back, _ = A.archived(spark.createDataFrame([(1, "http://a/", "y" * 1200)] * 2, PAGES))
    assert [r.record_type for r in back.collect()] == ["response"] * 2


def test_query_counts_every_page(spark, folder):
    assert op5(spark, folder).count() == spark.read.parquet(f"{folder}/pages.parquet").count()
