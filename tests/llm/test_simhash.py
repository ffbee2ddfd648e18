import re

import numpy as np
import xxhash

from pagelens.llm import simhash as S
from pagelens.llm.queries import LLM_QUERIES


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: different fingerprints; the smallest one joined with each."""
    values = np.array(sorted(prints), np.uint64)
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return {int(v): root(i) for i, v in enumerate(values)}


def expected(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(set(prints))
    least = {}
    for (doc_id, _), p in zip(docs, prints, strict=True):
        if doc_id is not None:
            least[label[p]] = min(doc_id, least.get(label[p], doc_id))
    return [(d, f"{p:016x}", least.get(label[p])) for (d, _), p in zip(docs, prints, strict=True)]


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = LLM_QUERIES["op5_simhash_near_dedup"](spark, sf).collect()
    assert key(rows) == key(expected(docs))
    assert len({r.component_id for r in rows}) < len(rows)


def test_linked_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 9), dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ flips[:, k] ^ flips[:, k - 1] for k in range(9))]))
    want = {(i, j) for i, j in np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3).tolist()}
    i, j = S.linked(values)
    assert {p for x, y in zip(i.tolist(), j.tolist()) for p in ((x, y), (y, x))} == want
    i, j = S.linked(values[:150], values[150:])
    assert set(zip(i.tolist(), (j + 150).tolist())) == {(x, y) for x, y in want if x < 150 <= y}


def test_crowded_keys_are_split_and_whole(spark):
    """Thousands of fingerprints around one value: leaves and upper nodes of one key over several tasks."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k % 3 + 1, 500), dtype=np.uint64), axis=0) for k, c in enumerate(centre)]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(5)
    roots = {r.a: r.b for r in S.components(S.links(frame, 16, 3)).collect()}
    want = plain_components(values.tolist())
    groups = {}
    for v, label in want.items():
        groups.setdefault(label, []).append(int(np.uint64(v).view(np.int64)))
    for group in groups.values():
        assert {roots.get(v, v) for v in group} == {min(group)}
    assert max(map(len, groups.values())) > 100


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([((i * 7919) % 3001, ((i + 1) * 7919) % 3001) for i in range(3000)], "a long, b long")
    assert {r.b for r in S.components(edges).collect()} == {0}


def test_awkward_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(5, text), (3, text.upper()), (3, text), (None, text), (8, None), (7, ""), (9, " \n\t"), (None, "only words"), (1, "x" * 300_000), (2, "a b " * 60_000)]
    frame = spark.createDataFrame([(*d, "c", 4) for d in docs], "doc_id long, text string, component_id string, fp int")
    rows = S.near_duplicates(frame).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0')", "component_id").collect()
    assert key(rows) == key(expected(docs))
    kept = S.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 7]
    empty = frame.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.one_of_each(empty).count() == 0


def test_one_document_of_each_component_stays_whatever_its_doc_id(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "der die das und oder aber",
             "uno dos tres cuatro cinco seis", "red green blue black white grey", "un deux trois quatre cinq"]
    # Four components without doc_id; id 5 names two texts and is the smallest of the first one's only.
    docs = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[1], "b2"), (None, texts[2], "c"), (None, texts[3], "d"),
            (5, texts[4], "e"), (5, texts[5], "f"), (3, texts[5], "g"), (5, texts[4], "e2"), (None, texts[4], "e3")]
    prints = [plain_fingerprint(t) for _, t, _ in docs]
    assert len(set(plain_components(set(prints)).values())) == len(texts)
    kept = S.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, row_key string")).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    assert {r.text: r.doc_id for r in kept} == dict(zip(texts, [None, None, None, None, 5, 3], strict=True))
    # A doc_id that is the smallest of two components stays in both.
    both = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[0])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.one_of_each(both).collect()) == [(1, texts[0]), (1, texts[1])]
