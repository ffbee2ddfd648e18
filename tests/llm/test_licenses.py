import math
import random
import re

from pagelens.llm import licenses as L
from pagelens.llm.license_texts import TEMPLATES
from pagelens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


PLAIN = {name: shingles(words(text)) for name, text in TEMPLATES.items()}


def plain(text):
    """Every window of every template, shingle by shingle."""
    own, out = shingles(words(text)), []
    for name, template in PLAIN.items():
        kinds, reach, runs = set(template), math.ceil(1.25 * len(template)), []
        if kinds.isdisjoint(own):
            continue
        for i in range(len(own)):
            places = [j for j in range(i, min(len(own), i + reach)) if own[j] in kinds]
            if len({own[j] for j in places}) >= 0.8 * len(kinds) - 1e-9:
                if runs and places[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], places[-1] + 1)
                else:
                    runs.append([places[0], places[-1] + 1])
        out += [(name, a, b + 4) for a, b in runs]
    return len(words(text)), sorted(out, key=lambda s: (s[1], s[0]))


def test_bands_are_enough():
    assert L.miss_chance(1 / 3) < 1e-4 and L.miss_chance(0.8) < 1e-16


def varied(rng):
    """Templates among other words, some with changed words, alone, repeated and at the ends."""
    filler = [f"w{i}" for i in range(500)]
    texts = []
    for name, text in TEMPLATES.items():
        for change in (0, 0, 0.02, 0.05, 0.15):
            body = [x if rng.random() >= change else rng.choice(filler) for x in text.split(" ")]
            texts.append(" ".join([*rng.choices(filler, k=rng.randrange(60)), *body * rng.choice((1, 1, 2)), *rng.choices(filler, k=rng.randrange(60))]))
    texts += [" ".join(rng.choices(filler, k=3000)), " ".join(TEMPLATES.values()), "released under the mit", TEMPLATES["mit-notice"]]
    return texts


def test_scan_equals_brute_force():
    texts = varied(random.Random(5))
    got = L.scan_texts([t.encode() for t in texts], L.Index(TEMPLATES), L.Hashes())
    assert got == [plain(t) for t in texts]
    assert sum(len(s) for _, s in got) > len(TEMPLATES)


def test_chunks_join(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 64)
    texts = varied(random.Random(6))
    assert L.scan_texts([t.encode() for t in texts], L.Index(TEMPLATES), L.Hashes()) == [plain(t) for t in texts]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = LLM_QUERIES["op3_license_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, spans = plain(docs[r.doc_id])
        assert (r.n_words, r.spans) == (n, ",".join(f"{t}:{a}:{b}" for t, a, b in spans))
        assert r.licenses == ",".join(sorted({t for t, _, _ in spans}))
    assert sum(r.n_licenses > 0 for r in rows) > 5


def test_awkward_rows(spark):
    texts = [None, "", "one two", TEMPLATES["mit"], TEMPLATES["mit"], "x " * 200_000 + TEMPLATES["isc"], "y" * 300_000, "released under the MIT\nlicense " * 3]
    frame = spark.createDataFrame([(i % 3 or None, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = sorted((r.n_words, r.spans) for r in L.digest(L.find_licenses(frame)).collect())
    fast = [plain(t) for t in texts if len(t or "") < 10_000] + [(200_000 + len(words(TEMPLATES["isc"])), [("isc", 200_000, 200_000 + len(words(TEMPLATES["isc"])))]), (1, [])]
    assert got == sorted((n, ",".join(f"{t}:{a}:{b}" for t, a, b in s)) for n, s in fast)
    assert L.find_licenses(frame.limit(0)).count() == 0
