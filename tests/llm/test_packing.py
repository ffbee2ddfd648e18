import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelens.llm import packing as P
from pagelens.llm.queries import LLM_QUERIES

FILES = P.tokenizer_path("byte_bpe_50k.json"), P.tokenizer_path("byte_bpe_50k.tiktoken")


REFERENCE = Tokenizer.from_file(FILES[0])


@pytest.fixture
def reference():
    return REFERENCE


def expected(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


AWKWARD = ["", " ", "  ", "a  b", "a \n b", " a ", "a\n\nb c", " x y z", "it's  'll <|endoftext|> ok", "<|endoftext|>",
           "don't  stop 123 456!?  \t x", "é à  ñ 日本語 😀 x", "a\r\n b\x1c c\x85 d"]


def test_ids_equal_the_tokenizer(reference):
    ids = P.ids_of(*FILES)
    for text in AWKWARD:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == expected(reference, text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t  \x1c'sab1.é日"), max_size=30))
def test_ids_equal_the_tokenizer_on_any_text(text):
    assert np.frombuffer(P.ids_of(*FILES).of(text), "<u4").tolist() == expected(REFERENCE, text)


def test_long_runs_of_blanks_take_linear_time(reference):
    ids = P.ids_of(*FILES)
    for n in (20_000, 99_999, 100_000, 150_000, 1_200_000):
        for blank in " \n":
            text = "start" + blank * n + "end  of a " * 3
            assert np.frombuffer(ids.of(text), "<u4").tolist() == expected(reference, text)
    begun = time.process_time()
    ids.of(" " * 2_000_000 + "a")
    assert time.process_time() - begun < 10


def test_best_fit_takes_the_fullest_bin():
    bins = P.best_fit([6, 5, 3, 4, 2], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 3], [1, 2, 4]]


def check(rows, docs, reference, capacity):
    """Pieces rebuild the documents, sequences are gapless and full at most."""
    want = []
    for doc_id, text in docs:
        ids = np.array([*expected(reference, text), 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing_small(spark, reference, monkeypatch):
    monkeypatch.setattr(P, "ROUND_ITEMS", 3)
    docs = [(1, None), (2, ""), (2, "again"), (None, "no id"), (5, "word " * 5000), (6, "x" * 100_000), (7, "word " * 8)]
    docs += [(100 + i, "a b c d e" * (i % 13)) for i in range(200)]
    frame = spark.createDataFrame([(*d, "extra", 1) for d in docs], "doc_id long, text string, sequence_id string, offset int")
    rows = P.pack_documents(frame.repartition(7), capacity=64).collect()
    n, total = check(rows, docs, reference, 64)
    assert n <= -(-total // 64) + 12


def test_packing_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_the_tokenizer(spark, reference):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = LLM_QUERIES["op10_best_fit_packing"](spark, sf).collect()
    n, total = check(rows, docs, reference, P.CAPACITY)
    assert n <= 1.01 * total / P.CAPACITY + 1
