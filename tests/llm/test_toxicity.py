import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import toxicity as T
from pagelens.llm.queries import LLM_QUERIES


def plain_segments(scores, low=0, high=None):
    """By definition: the best-scoring run (longest positive extension left out), then both sides."""
    high = len(scores) if high is None else high
    best, place = 0.0, None
    for i in range(low, high):
        total = 0.0
        for j in range(i, high):
            total += scores[j]
            if total > best + 1e-12:
                best, place = total, (i, j + 1)
    if place is None:
        return []
    return [*plain_segments(scores, low, place[0]), (*place, best), *plain_segments(scores, place[1], high)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1000, 1000), max_size=25), st.integers(0, 2**31))
def test_segments_equal_the_definition(numbers, seed):
    scores = (np.array(numbers, float) + np.random.default_rng(seed).random(len(numbers))).tolist()
    got = T.maximal_segments(scores)
    assert [g[:2] for g in got] == [w[:2] for w in plain_segments(scores)]
    assert np.allclose([g[2] for g in got], [w[2] for w in plain_segments(scores)])


def test_segments_are_linear():
    assert len(T.maximal_segments([1.0, -2.0] * 300_000)) == 300_000
    assert len(T.maximal_segments([2.0, -1.0] * 300_000)) == 1


def test_extreme_value_law_is_recovered():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 5000, 20_000)
    best = (np.log(0.2 * n) - np.log(rng.exponential(size=len(n)))) / 0.7
    decay, scale = T.extreme_value_law(best, n)
    assert abs(decay - 0.7) < 0.05 and 0.1 < scale < 0.4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = LLM_QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    clean = [p for p, t in held if not t]
    assert sum(clean) / len(clean) < 0.015


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    calm, rude = [f"calm{i}" for i in range(60)], ["vile1", "vile2", "vile3"]
    docs, labels = [], []
    for i in range(300):
        words = rng.choice(calm, 40).tolist()
        if i % 4 == 0:
            words[10:16] = rng.choice(rude, 6).tolist()
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(400, None), (401, ""), (None, "vile1 vile2 vile3 vile1 vile2"), (402, "calm1 " * 50_000), (3, docs[3][1]), (403, "x" * 200_000)]
    labels += [(400, 0), (5, 1), (None, 1), (6, 7), (6, None)]
    return (spark.createDataFrame([(*d, 0.9, "toxic") for d in docs], "doc_id long, text string, score double, toxic string"),
            spark.createDataFrame([(*x, "u") for x in labels], "doc_id long, toxic int, text string"), docs)


def test_awkward_rows(spark, small):
    docs, labels, plain = small
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == len(plain)
    by = {r.doc_id: r for r in rows}
    assert by[400].score == by[401].score < 0.5 and by[402].score < 0.5 and by[403].score < 0.5
    assert by[None].predicted == 1 and not by[None].held_out
    assert by[8].predicted == 1 and by[9].predicted == 0
    assert any(p.start <= 12 < p.end for p in by[8].passages) and not by[9].passages
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted == 0)


def test_without_labels_or_documents(spark, small):
    docs, labels, plain = small
    assert len({r.score for r in T.toxicity(docs, labels.limit(0)).collect()}) == 1
    assert {r.predicted for r in T.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0}
    assert T.toxicity(docs.limit(0), labels).count() == 0
