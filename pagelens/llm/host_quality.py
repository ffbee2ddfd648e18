"""Quality rules judged by host: failures counted by domain, shrunken, and joined back.

Every document gets the counts that the rules read. A document that breaks any rule is a
failure of its host. A host's failure rate is drawn towards the mean rate of hosts by a beta
prior that is fitted to the hosts by moments, every host counting once, so one host with very
many documents moves neither parameter: the mean of rates, and the mean of
f (f - 1) / (n (n - 1)), which is free of the spread that sampling adds. Hosts whose shrunken
rate exceeds ``HOST_LIMIT`` are rejected with all their documents. The prior weighs at least as
much as an even one, so one or two bad documents alone never condemn a host of mostly good company.

The documents' counts are written once, narrow; hosts are summed on the map side, and a row
for each host is joined back, so a host with a third of all rows is no task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import as_bytes, blank_words, small_batches, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.6
# Bounds of the prior's weight in documents; the least is that of the even prior.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0

_SPACES = bytes((0x20, *range(0x09, 0x0E)))
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))  # and the later bytes of a character
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, place, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The values of COUNTS."""
    words = blank_words(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and COUNTS of every row."""

    def scan(batches):
        for batch in batches:
            rows = [counts(t) for t in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "host", *COUNTS],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("host"), as_bytes("text"))
    schema = ", ".join(["doc_id bigint", "host string", *(f"{c} bigint" for c in COUNTS)])
    return small_batches(rows).mapInArrow(scan, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule: the base ones, symbols above a tenth of the words' characters, more repeated lines than a tenth of the
    words, or words that are too short or too long on average."""
    words = F.col("n_words")
    return (
        base_failed() | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > words)
        | (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failures, rate (shrunken) of rows with host and failed."""
    hosts = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("bigint")).alias("failures")), "hosts")
    raw = F.col("failures") / F.col("n")
    pairs = F.when(F.col("n") > 1, F.col("failures") * (F.col("failures") - 1) / (F.col("n") * (F.col("n") - 1)))
    # One row, whatever the number of hosts.
    s = hosts.agg(
        F.sum(raw).alias("rates"), F.count(F.lit(1)).alias("hosts"),
        F.avg(F.when(F.col("n") > 1, raw)).alias("centre"), F.avg(pairs).alias("square"),
    ).first()
    mean = ((s.rates or 0.0) + 0.5) / (s.hosts + 1)
    spread = s.square - s.centre**2 if s.square is not None else 0.0
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, s.centre * (1 - s.centre) / spread - 1)) if spread > 0 else MOST_WEIGHT
    return hosts.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("n") + weight))


def host_quality(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, host_kept for every row of docs.

    docs: doc_id, text, source (the host); other columns are not read. A null text has no
    words and fails; null sources are one host, the empty source is another. Repeated rows
    count as often as they occur. No rows, no result rows.
    """
    rows = written(document_counts(docs).withColumn("base_failed", base_failed()).withColumn("failed", rule_failed()), "quality")
    rejected = host_rates(rows).filter(F.col("rate") > HOST_LIMIT).select(F.col("host").alias("bad_host"), F.lit(True).alias("rejected"))
    joined = rows.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    host_kept = F.col("rejected").isNull()
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & host_kept).alias("kept"), host_kept.alias("host_kept"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (
  SELECT r, i, w[i : i + 2] AS p FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, p) > 1),
repeated AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM again) GROUP BY r),
counted AS (
  SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words
      OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM counted),
hosts AS (SELECT source, count(*) AS n, sum(failed::INT) AS failures FROM judged GROUP BY source),
fitted AS (
  SELECT (sum(failures / n) + 0.5) / (count(*) + 1) AS mean, avg(failures / n) FILTER (n > 1) AS centre,
    avg(failures * (failures - 1) / (n * (n - 1))) FILTER (n > 1) AS square FROM hosts),
prior AS (
  SELECT mean, CASE WHEN square - centre * centre > 0
    THEN least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, centre * (1 - centre) / (square - centre * centre) - 1))
    ELSE {MOST_WEIGHT} END AS weight FROM fitted),
bad AS (SELECT source, true AS rejected FROM hosts, prior WHERE (failures + mean * weight) / (n + weight) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected IS NULL AS kept, rejected IS NULL AS host_kept
FROM judged LEFT JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source
"""
