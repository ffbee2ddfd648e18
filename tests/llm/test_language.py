import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import language as L

SF = "/root/testdata/sf0.1"


def plain_model(words, order):
    """Interpolated Kneser-Ney by dictionaries of strings; words: word -> count."""
    occurs = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        text = f" {word} "
        for end in range(1, len(text)):
            for size in range(1, min(order, end + 1) + 1):
                occurs[size][text[end - size + 1 : end + 1]] += n
    counts = [Counter() for _ in range(order + 1)]
    for size in range(1, order + 1):
        for gram, n in occurs[size].items():
            if size == order or (gram[0] == " " and len(gram) > 1):
                counts[size][gram] = n
        if size < order:
            for gram in occurs[size + 1]:
                counts[size][gram[1:]] += 1
    discounts, totals, kinds = [0.0], [{}], [{}]
    for size in range(1, order + 1):
        once, twice = (sum(a == k for a in counts[size].values()) for k in (1, 2))
        discounts.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)
        total, taken = defaultdict(float), defaultdict(float)
        for gram, a in counts[size].items():
            total[gram[:-1]] += a
            taken[gram[:-1]] += min(discounts[-1], a)
        totals.append(total)
        kinds.append(taken)

    def chance(text):  # of the last character after the ones before it
        p = 1 / L.ALPHABET
        for size in range(1, min(order, len(text)) + 1):
            gram = text[-size:]
            context = gram[:-1]
            if context in totals[size]:
                p = (max(counts[size][gram] - discounts[size], 0) + kinds[size][context] * p) / totals[size][context]
        return p

    def cost(word):
        text = f" {word} "
        return sum(-math.log2(chance(text[max(0, end + 1 - order) : end + 1])) for end in range(1, len(text)))

    return cost


TEXTS = {
    "aa": "banana bandana ananas band and an ab bb ba nab naan banana",
    "bb": "zürich über züge überzug rügen zug ürz zzz über",
    "cc": "да нет дата данет вода вода",
}


def test_costs_equal_plain_kneser_ney(spark):
    docs = spark.createDataFrame([(lang, t) for lang, t in TEXTS.items()], "lang string, text string")
    model = L.count_model(docs.union(docs))
    assert model.languages == sorted(TEXTS)
    words = ["banana", "an", "b", "zug", "überall", "вода", "qqq", "banbanabandnana" * 20, "日本"]
    costs = model.costs(words)
    for i, lang in enumerate(model.languages):
        cost = plain_model(Counter(2 * TEXTS[lang].split()), L.ORDER)
        assert np.allclose(costs[:, i], [cost(w) for w in words], rtol=1e-4)


def test_words_may_be_cut_anywhere(spark, monkeypatch):
    docs = spark.createDataFrame([(lang, t) for lang, t in TEXTS.items()], "lang string, text string")
    model = L.count_model(docs)
    words = ["banana", "über", "an" * 40, "b", "вода"]
    whole = model.costs(words)
    for size in (1, 3, 7, 16):
        monkeypatch.setattr(L, "SLICE", size)
        assert np.allclose(model.costs(words), whole)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words_hold_letters(text):
    words = L.words_of(text.encode("utf-8", "replace"))
    assert bool(words) == any(c.isalpha() for c in text.encode("utf-8", "replace").decode())
    assert all(any(c.isalpha() for c in w) for w in words)


def test_size_does_not_follow_the_corpus():
    for languages in (1, 4, 30, 1000):
        assert languages * L.ORDER << L.model_bits(languages) <= L.MODEL_ENTRIES


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("text is not null").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 2000
    right = [r.lang_pred == r.lang for r in held]
    assert np.mean(right) > 0.98
    assert np.mean([r.accepted for r in held]) > 0.98
    # The score is the chance of being right.
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.02
    strangers = ["вся счастливые семьи похожи друг на друга " * 5, "xkcd qwrt zzvb pfft grrr mnbv lkjh " * 8]
    costs = L.Costs(model)
    _, _, accepted, _ = L.predicted(model, [t.encode() for t in strangers], costs)
    assert not accepted.any()


def test_awkward_rows(spark):
    rows = [(i, t, lang, "x", "en") for i, (lang, t) in enumerate(60 * list(TEXTS.items()))]
    rows += [(None, TEXTS["aa"], "aa", "x", "en"), (1000, None, "aa", None, None), (1001, "", "bb", "x", "x"), (1002, "12 ½ ² --- \n", None, "x", "x")]
    rows += [(1003, "banana " * 200_000, None, "x", "x"), (1004, "an" * 1_000_000, None, "x", "x"), (1003, "banana", "zz", "x", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string")
    found = L.language_id(frame).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    for i in (1000, 1001, 1002):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].accepted) == ("und", 0.0, False)
    assert {r.lang_pred for r in by[1003]} == {"aa"} and by[1004][0].lang_pred == "aa" and by[None][0].lang_pred == "aa"
    assert [by[i][0].lang_pred for i in range(3)] == ["aa", "bb", "cc"]
    assert {r.lang_pred for r in L.language_id(frame.filter("lang = 'bb' or lang is null")).collect()} == {"bb", "und"}
    assert {(r.lang_pred, r.score) for r in L.language_id(frame.withColumn("lang", frame.lang.substr(9, 1)).filter("lang is null")).collect()} <= {("und", 0.0)}
    assert L.language_id(frame.limit(0)).count() == 0


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string")
    model = L.calibrate(L.count_model(docs), np.zeros((0, 2)), np.zeros(0, dtype=np.int64), [])
    langs, score, _, _ = L.predicted(model, [b"same", b"words"], L.Costs(model))
    assert langs == ["a", "a"] and score == pytest.approx([0.5, 0.5], abs=0.05)


def test_all_training_documents_count_and_the_whole_tenth_calibrates(spark):
    rows = [(i, " ".join(f"{w}" for w in text.split()) + " " + "abcdefghij"[i % 10] * (1 + i % 7), lang) for i, (lang, text) in enumerate(400 * list(TEXTS.items()))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = frame.filter(f"{L.HELD_OUT} <> 2")
    model = L.train(frame)
    whole = L.count_model(learned)
    words = ["banana", "über", "вода", "qqq"]
    assert np.array_equal(model.costs(words), whole.costs(words))
    # The same curve and limit from all spared documents at once.
    spared = f"pmod(xxhash64(doc_id), {L.CALIBRATION_SHARE}) = 0"
    kept = L.count_model(learned.filter(f"not {spared}"))
    texts = learned.filter(spared).collect()
    bits, size = L.Costs(kept).of([L.words_of(r.text.encode()) for r in texts])
    same = L.calibrate(kept, bits, size, [r.lang for r in texts])
    assert len(texts) > 60 and model.limit < math.inf
    assert np.allclose([model.slope, model.shift, *model.mean, *model.spread, model.limit], [same.slope, same.shift, *same.mean, *same.spread, same.limit], rtol=1e-6)
    t = L.measured_texts(kept, bits, size, [r.lang for r in texts])
    off = ((t.entropy - np.array(same.mean)[t.own]) / np.sqrt(same.spread[0] / t.size + same.spread[1]))[t.best == t.own]
    assert same.limit == pytest.approx(np.sort(off)[math.ceil(L.ACCEPTED_SHARE * len(off)) - 1], abs=1e-9)


def test_only_spared_documents(spark):
    frame = spark.range(200).selectExpr("id AS doc_id", "'banana' AS text", "'aa' AS lang").filter(f"pmod(xxhash64(doc_id), {L.CALIBRATION_SHARE}) = 0")
    assert {r.lang_pred for r in L.language_id(frame).collect()} == {"aa"}
