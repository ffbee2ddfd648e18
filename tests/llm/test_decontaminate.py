import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import decontaminate as D
from pagelens.llm.words import plain_words

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item) if item is not None else "")
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        joined = ",".join(sorted(found)).encode()
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(joined).hexdigest(), bool(hit)


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ITEMS = [(1, TEN + " lambda mu"), (2, "Short item"), (3, None), (4, "  "), (2, "x1 é-日本"), (None, "no id here"), (5, TEN), (6, "b b b b b b b b b b")]
DOCS = [
    (1, f"before {TEN.upper()}, lambda mu after"), (2, "short ITEM and short-item"), (3, None), (4, ""), (None, "x1/é 日本"),
    (2, "no id here"), (7, "b " * 25), (8, TEN[:-5]), (9, "z" * 200_000 + " " + TEN * 3), (10, "!!! \n"),
]


def test_words_follow_the_definition():
    text = "A-b_c\x00d[é]É9~x y Ⅷ"
    assert [w.decode() for w in plain_words(text.encode())] == words(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.sampled_from("abc"), max_size=60))
def test_search_equals_brute_force(items, doc):
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    rows = [(b" ".join(w), str(i)) for i, t in items for w in D.item_windows(plain_words(t.encode()))]
    n, spans, found = D.scan(" ".join(doc).encode(), D.searches(rows))
    want = next(plain([(0, " ".join(doc))], items))
    assert (n, sum(b - a for a, b in spans), len(found)) == want[1:4]


def test_awkward_rows_and_parts(spark):
    docs = spark.createDataFrame([(*d, "x", "y") for d in DOCS], "doc_id long, text string, spans string, n_words string")
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, window string")
    want = key(plain(DOCS, ITEMS))
    assert key(D.digest(D.contamination(docs, items)).collect()) == want
    assert key(D.digest(D.contamination(docs, items, part=4)).collect()) == want
    clean = [d for d, w in zip(DOCS, plain(DOCS, ITEMS), strict=True) if not w[-1]]
    for part in (D.PART, 4):
        kept = D.drop_contaminated(docs, items, part)
        assert kept.columns == docs.columns
        assert key((r.doc_id, r.text) for r in kept.collect()) == key(clean)
    assert key(D.digest(D.contamination(docs, items.limit(0))).collect()) == key(plain(DOCS, []))
    assert D.contamination(docs.limit(0), items).count() == 0
