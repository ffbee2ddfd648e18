"""Benchmark passages in documents: Wu-Manber multi-pattern search over words.

A pattern is a window of ``WINDOW`` consecutive words of a benchmark item (a shorter item
is one pattern). Patterns of full length and short ones are two searches, so short items
don't shorten the steps of the others. A search looks at a block of two words at the end
of a window of the document: the shift table tells how far the window may move without
missing an occurrence (most blocks occur in no pattern, and the window moves almost its
whole length); at shift zero the suffix bucket gives the patterns that end in the block,
and each is compared with the document word by word.

Patterns are sent to the tasks in parts of about ``PART`` rows (window, item). With more
of them the documents go through further parts in the same task, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import as_bytes, place_of, plain_words, rows_of, small_batches

WINDOW = 10
PART = 100_000


class WuManber:
    """All occurrences of word patterns: patterns with their items, none of them empty."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.items = patterns
        self.length = length = min(map(len, patterns))  # of the window that moves
        self.block = block = min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in patterns:
            for end in range(block, length + 1):
                words = pattern[end - block : end]
                self.shift[words] = min(length - end, self.shift.get(words, length))
            self.buckets[pattern[length - block : length]].append(pattern)

    def find(self, words: list[bytes]):
        """(start, pattern) of every occurrence, by start."""
        length, block, most = self.length, self.block, self.length - self.block + 1
        shift, n, end = self.shift.get, len(words), self.length
        while end <= n:
            at = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift(at, most)
            if step:
                end += step
                continue
            start = end - length
            for pattern in self.buckets[at]:
                if tuple(words[start : start + len(pattern)]) == pattern:
                    yield start, pattern
            end += 1


def item_windows(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def searches(rows: Iterable[tuple[bytes, str]]) -> list[WuManber]:
    """rows: window as words joined by blanks, item."""
    patterns: dict[bool, dict] = {True: defaultdict(list), False: defaultdict(list)}
    for window, item in rows:
        words = tuple(window.split(b" "))
        patterns[len(words) == WINDOW][words].append(item)
    return [WuManber(p) for p in patterns.values() if p]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def scan(text: bytes, matchers: list[WuManber], spans=(), items=()) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit spans and items, with those of earlier parts."""
    words = plain_words(text)
    spans, items = list(spans), set(items)
    for matcher in matchers:
        for start, pattern in matcher.find(words):
            spans.append((start, start + len(pattern)))
            items.update(matcher.items[pattern])
    return len(words), merged(spans), items


def window_rows(benchmark: DataFrame) -> DataFrame:
    """Different pairs of window (words joined by blanks) and item."""

    def cut(batches):
        for item, text in rows_of(batches, "item_id", "text"):
            windows = [b" ".join(w) for w in item_windows(plain_words(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.binary()), pa.array([item] * len(windows), pa.string())], names=["window", "item_id"]
            )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), as_bytes("text"))
    return small_batches(items).mapInArrow(cut, "window binary, item_id string").distinct()


def pattern_parts(benchmark: DataFrame, part: int = PART):
    """Broadcast matchers' rows, about ``part`` to a part; one part even without patterns."""
    spark = benchmark.sparkSession
    rows = window_rows(benchmark)
    total = rows.count()
    parts = max(1, -(-total // part))
    place = F.pmod(F.xxhash64("window", "item_id"), F.lit(parts))
    for i in range(parts):
        chosen = [(bytes(r.window), r.item_id) for r in rows.filter(place == i).collect()]
        yield spark.sparkContext.broadcast(chosen)


def contamination(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, n_words, spans (word positions of hit runs), items (item_ids with an occurring window).

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Null texts
    have no words, and an item without words has no windows. An item_id that is null counts
    as the empty string; rows that repeat an item_id are one item with the windows of all.
    Every row of docs gives a row, repeated ones too. Without items nothing is hit.
    """
    state = "doc_id bigint, text binary, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for sent in pattern_parts(benchmark, part):

        def search(batches, sent=sent):
            matchers = searches(sent.value)
            for batch in batches:
                texts, spans, items = (batch.column(n).to_pylist() for n in ("text", "spans", "items"))
                found = [
                    scan(t, matchers, [(s["start"], s["end"]) for s in old], seen)
                    for t, old, seen in zip(texts, spans, items, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], span),
                        pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                    ],
                    names=batch.schema.names,
                )

        rows = small_batches(rows).mapInArrow(search, state)
    return rows.select("doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of contamination()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """docs, all columns, without the rows in which a window occurs."""
    text = place_of(docs, "text")
    for sent in pattern_parts(benchmark, part):

        def keep(batches, sent=sent):
            matchers = searches(sent.value)
            for batch in batches:
                clean = [
                    not any(True for m in matchers for _ in m.find(plain_words((t or "").encode())))
                    for t in batch.column(text).to_pylist()
                ]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = small_batches(docs).mapInArrow(keep, docs.schema)
    return docs


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS p FROM (
    SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(p) AS n FROM p),
dw AS (
  SELECT r, i, n, w[i : i + n - 1] AS p FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
o AS (SELECT r, i, n, item_id FROM dw JOIN p USING (p)),
hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM o) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM o) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
