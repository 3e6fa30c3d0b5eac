import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import language as L
from tickerloom.llm.queries import op4


def test_held_out_accuracy(spark, folder):
    truth = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")
    got = op4(spark, folder).toPandas().set_index("doc_id")
    assert set(got.index) == set(truth.index)
    assert {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index} == got["held_out"].to_dict()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == truth.loc[held.index, "lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_only_text_decides_and_held_out_rows_do_not_teach(spark, docs):
    rows = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        held = zlib.crc32(str(i).encode()) % 4 == 2
        word = {"aa": "vava", "bb": "kiki"}[lang]
        rows.append((i, f"{word} {word}" if not held else "zzzz", "zz" if held else lang, "s", 0))
    rows += [(1000, None, "aa", "s", 0), (1001, "", None, None, None), (1002, "12 !?", "aa", "s", 0),
             (1003, "vava " * 50_000, None, "s", 0), (1004, "кот", None, "s", 0), (1004, "кот", None, "s", 0),
             (None, "kika", "qq", "s", 0), (1005, "vavaki", None, "s", 0)]
    frame = docs(*rows).withColumns({"score": F.lit("old"), "held_out": F.lit(1)})
    model = L.fit(frame)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r for r in L.with_language(frame, model).collect() if r.doc_id is None or r.doc_id >= 1000}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [got[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert got[1003].lang_pred == "aa" and got[1003].score > 0.99
    assert got[1004].lang_pred == "aa" and abs(got[1004].score - 0.5) < 1e-9  # nothing known: even, first by name
    assert got[None].lang_pred == "bb"
    nothing = L.fit(frame.limit(0))
    assert nothing.languages == []
    assert {r.lang_pred for r in L.with_language(frame, nothing).collect()} == {"und"}
    assert L.with_language(frame.limit(0), model).count() == 0


def test_unknown_words_fall_back_to_shorter_grams():
    kinds = np.array([b"abcd", b"xy"], dtype=object)
    import pandas as pd

    known = lambda keys, scores: (np.sort(keys), scores[np.argsort(keys)])
    empty = (np.zeros(0, np.uint64), np.zeros((0, 2)))
    word = pd.util.hash_array(np.array([b"abcd"], dtype=object), categorize=False)
    four, _ = L.grams(np.array([b"abce"], dtype=object), 4)
    one, _ = L.grams(np.array([b"x"], dtype=object), 1)
    model = L.Model(["p", "q"], {
        0: known(word, np.array([[-1.0, -2.0]])), 1: known(one, np.array([[-7.0, -3.0]])), 2: empty, 3: empty,
        4: known(four, np.tile([-5.0, -4.0], (len(four), 1)))})
    scores = model.word_scores(np.array([b"abcd", b"abcx", b"xy", b"zz"], dtype=object))
    assert scores.tolist() == [[-1.0, -2.0], [-5.0, -4.0], [-7.0, -3.0], [0.0, 0.0]]
    assert len(kinds) == 2


def brute_model(rows):
    """Counts of words and n-grams as plain strings: {size: ({key: log frequency by language}, ...)}."""
    langs = sorted({lang for lang, _ in rows})
    counts = {size: {} for size in range(5)}
    for lang, text in rows:
        for word in letters(text):
            for size in range(5):
                for key in [word] if size == 0 else strings(word, size):
                    counts[size].setdefault(key, dict.fromkeys(langs, 0))[lang] += 1
    counts[0] = {k: v for k, v in counts[0].items() if sum(v.values()) > 1}
    out = {}
    for size, own in counts.items():
        down = {lang: sum(v[lang] for v in own.values()) + 0.5 * max(1, len(own)) for lang in langs}
        out[size] = {k: np.array([math.log((v[lang] + 0.5) / down[lang]) for lang in langs]) for k, v in own.items()}
    return langs, out


def letters(text):
    return re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())


def strings(word, size):
    marked = f" {word} "
    return [g for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) != " "]


def brute_prediction(model, text):
    langs, known = model
    total = np.zeros(len(langs))
    for word in letters(text):
        if word in known[0]:
            total += known[0][word]
            continue
        for size in (4, 3, 2, 1):
            found = [known[size][g] for g in strings(word, size) if g in known[size]]
            if found:
                total += np.mean(found, axis=0)
                break
    return langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_query_equals_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(L, "PER_LANGUAGE", 12)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in L.training_rows(frame, "text", "lang", "doc_id", 12).collect()]
    model, near = brute_model(rows), 0
    fitted = L.fit(frame, per_language=12)
    got = {r.doc_id: r for r in L.with_language(frame, fitted).collect()}
    for r in frame.collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        lang, score = brute_prediction(model, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6
        near += score < 0.999
    assert len(got) == frame.count() and near


def test_any_number_of_labels(spark, docs, monkeypatch):
    rows = [(i, f"word{i % 1500} only", f"l{i % 1500:04}", "s", 0) for i in range(3000)]
    model = L.fit(docs(*rows))
    assert len(model.languages) == 1000
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    common = L.fit(docs(*[(i, "x y", "rare" if i % 9 == 0 else f"often{i % 2}", "s", 0) for i in range(300)]))
    assert common.languages == ["often0", "often1"]


def test_training_bytes_are_bounded_and_rows_teach_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "TRAINING_BYTES", 4_000)
    rows = [(i, "ab " * 30, "aa", "s", 0) for i in range(200)] + [(1000 + i, "cd " * 5_000, "bb", "s", 0) for i in range(9)]
    taught = L.training_rows(docs(*rows), "text", "lang", "doc_id", 1000).collect()
    assert 0 < len(taught) <= 2000 // 90 and {r.text for r in taught} == {"ab " * 30}


def test_long_texts_are_scored_in_pieces(spark, docs, monkeypatch):
    rows = [(i, "vava vavi" if i % 2 else "kiki kika", "aa" if i % 2 else "bb", "s", 0) for i in range(60)]
    model = L.fit(docs(*rows))
    text = "\n".join(["vava vax", "zz", "kiki", " "] * 3_000) + "x" * 9_000
    assert "".join(L.pieces(text, 4_000)) == text
    whole = L.Model(model.languages, model.tables)
    monkeypatch.setattr(L, "ROUND_CHARS", 1)
    small = model.predict([text, None, "kiki", ""])
    monkeypatch.setattr(L, "ROUND_CHARS", 10**9)
    large = whole.predict([text, None, "kiki", ""])
    assert small[0] == large[0] and np.allclose(small[1], large[1])


def test_the_sample_is_bounded(spark, docs):
    frame = docs(*[(i, "a b", "aa", "s", 0) for i in range(3000)])
    assert 0 < L.training_rows(frame, "text", "lang", "doc_id", 50).count() <= 50
    assert L.training_rows(frame, "text", "lang", "doc_id", 5000).count() == frame.filter(~L.held_out(F.col("doc_id"))).count()
