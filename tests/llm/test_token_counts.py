import numpy as np
import pytest

from tickerloom.llm import token_counts as K
from tickerloom.llm.queries import op1

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return K.read_vocabulary(VOCABULARY)


@pytest.mark.parametrize("text", ["plain words", "é ß 你好 🙂🙂 x", "a\n\n\nb  c", "x" * 30000, "​́"])
def test_spans_cover_the_text(ranks, text):
    starts, ends = K.token_spans(text, ranks)
    ids = K._encoder(ranks)[0].encode_ordinary(text)
    assert len(ids) == len(starts) and starts[0] == 0 and ends[-1] == len(text)
    assert (starts[1:] <= ends[:-1]).all() and (starts[1:] >= starts[:-1]).all() and (ends > starts).all()
    covered = np.zeros(len(text), bool)
    for a, b in zip(starts, ends, strict=True):
        covered[a:b] = True
    assert covered.all()
    if text.isascii():
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [K._encoder(ranks)[0].decode([i]) for i in ids]


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u3000", "\xa0 \r\n"])
def test_runs_of_white_space_have_the_same_tokens_apart(ranks, blank):
    encoder = K._encoder(ranks)[0]
    for size in (999, 1000, 1001, 5000):
        run = (blank * size)[:size]
        for text in (run, "a" + run, run + "b", "a" + run + "b c", f"{run}é\n{run}1{run}", f"x{run}\x1c{run}y"):
            assert K.encoded(text, ranks, 1000).tolist() == K.encoded(text, ranks).tolist() == encoder.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\t" * 5_000_000 + "x", "a" + "\n" * 5_000_000, "q" * 5_000_000, "a " * 2_500_000])
def test_very_long_runs(ranks, text):
    starts, ends = K.token_spans(text, ranks)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all()


def test_lines_cover_the_text():
    for text in ("", "\n", "a", "a\n", "\na", "a\n\nb"):
        parts = K.lines_of(text)
        assert "".join(text[a:b] for a, b in parts) == text and parts
    assert K.lines_of("a\n\nb") == [(0, 2), (2, 3), (3, 4)]


def brute(starts, ends, sections, rule):
    counts, crossing, outside = [0] * len(sections), [0] * len(sections), 0
    for s, e in zip(starts, ends, strict=True):
        touched = [i for i, (a, b) in enumerate(sections) if a < e and b > s]
        if not touched:
            outside += 1
            continue
        overlap = [min(e, sections[i][1]) - max(s, sections[i][0]) for i in touched]
        own = {"first": touched[0], "last": touched[-1], "majority": touched[overlap.index(max(overlap))]}[rule]
        counts[own] += 1
        crossing[own] += len(touched) > 1
    return counts, crossing, outside


@pytest.mark.parametrize("rule", K.RULES)
def test_tokens_are_shared_out_by_the_rule(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        edges = np.r_[0, np.cumsum(rng.integers(1, 6, 12))]
        cuts = np.sort(rng.choice(edges[-1] + 1, 8, replace=False))
        sections = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        counts, crossing, outside = K.shared_out(edges[:-1], edges[1:], sections, rule)
        assert (list(counts), list(crossing), outside) == brute(edges[:-1], edges[1:], sections, rule)


def test_cases(spark, docs, ranks):
    rows = docs((1, None), (2, ""), (3, "one\ntwo two\n"), (3, "one\ntwo two\n"), (None, "x"))
    rows = rows.withColumn("section", rows.source).withColumn("text2", rows.text)
    got = sorted(tuple(r) for r in K.section_tokens(rows, ranks).filter("doc_id IS NOT NULL").collect())
    assert got[:2] == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)]
    assert [r[:4] for r in got[2:]] == [(3, 0, 0, 4)] * 2 + [(3, 1, 4, 12)] * 2
    assert K.section_tokens(rows, ranks).filter("doc_id IS NULL").count() == 1
    assert K.section_tokens(rows.limit(0), ranks).count() == 0
    with pytest.raises(ValueError):
        K.section_tokens(rows, ranks, rule="half")


def test_given_sections_leave_the_rest_outside(spark, ranks):
    frame = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5)]), (2, "alpha", None)],
                                  "doc_id bigint, text string, parts array<struct<start: int, end: int>>")
    got = K.section_tokens(frame, ranks, sections="parts").collect()
    every = {r.doc_id: r.doc_tokens for r in got}
    assert {i: sum(r.n_tokens for r in got if r.doc_id == i) for i in every} == every
    assert {r.section for r in got if r.doc_id == 2} == {-1}


def test_query_equals_brute_force(spark, folder, ranks):
    encoder, want = K._encoder(ranks)[0], set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        begins = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
        spans, at = [], 0
        for token in encoder.encode_ordinary(text):
            size = len(encoder.decode_single_token_bytes(token))
            spans.append((begins[at], begins[at + size - 1] + 1))
            at += size
        lines = text.split("\n")
        edges = np.cumsum([0, *[len(x) + 1 for x in lines[:-1]], len(lines[-1])]).tolist()
        sections = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b] or [(0, 0)]
        owner = [[] for _ in sections]
        first = 0
        for s, e in spans:
            while sections[first][1] <= s:
                first += 1
            own = [i for i in range(first, len(sections)) if sections[i][0] < e] if sections[first][1] < e else [first]
            best = max(own, key=lambda i: (min(e, sections[i][1]) - max(s, sections[i][0]), -i))
            owner[best].append(len(own) > 1)
        want |= {(r.doc_id, i, a, b, len(owner[i]), sum(owner[i]), len(spans)) for i, (a, b) in enumerate(sections)}
    assert {tuple(r) for r in op1(spark, folder).collect()} == want


def test_query_adds_up(spark, folder, ranks):
    got = op1(spark, folder).toPandas()
    sums = got.groupby("doc_id").agg(n=("n_tokens", "sum"), doc=("doc_tokens", "first"), end=("char_end", "max"))
    assert (sums["n"] == sums["doc"]).all()
    texts = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")["text"]
    encoder = K._encoder(ranks)[0]
    assert {i: len(encoder.encode_ordinary(t)) for i, t in texts.items()} == sums["doc"].to_dict()
    assert texts.map(len).to_dict() == sums["end"].to_dict()
