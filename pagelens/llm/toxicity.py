"""Toxic passages by maximum-scoring segment search.

* Every word has features: itself, and its first and last four to six bytes, each hashed to
  one of ``BUCKETS`` buckets, so the model has the same size for any corpus. Spark counts
  the buckets of the training documents by label, and those of all documents.
* A feature's score is its log-odds between toxic and clean documents under an informative
  Dirichlet prior (its weights follow the counts of all documents), drawn towards zero by its
  standard error. A word takes its strongest feature, less a drift that makes the expected
  score of a clean word negative.
* One linear pass over the words finds all maximal-scoring segments. A segment's score is
  calibrated by the extreme-value law: E = K n exp(-lambda S) segments of at least that
  score are expected in a clean text of n words, with lambda and K fitted by maximum
  likelihood on clean training documents. Segments with E below ``SIGNIFICANT`` are passages.
* A document's evidence, the sum of -ln E over its passages (or -ln of the chance of its best
  segment), is turned into a probability by a logistic curve. Curve and extreme-value law are fitted
  on scores of documents that took no part in the counts (two folds).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import as_bytes, place_of, plain_words, small_batches, written

BUCKETS = 1 << 18
EDGES = (4, 5, 6)
# Labelled rows that train the model, about; chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
PRIOR_MASS = 2000.0
SIGNIFICANT = 0.01
FOLDS = 5
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"
CACHE_WORDS = 200_000


def features(word: bytes) -> list[int]:
    """Buckets of the word, its beginnings and its ends."""
    found = [zlib.crc32(word) % BUCKETS]
    for n in EDGES:
        if len(word) > n:
            found.append(zlib.crc32(b"^" + word[:n]) % BUCKETS)
            found.append(zlib.crc32(b"$" + word[-n:]) % BUCKETS)
    return found


class Features:
    """Feature buckets of words, with those met lately remembered."""

    def __init__(self):
        self.known: dict[bytes, list[int]] = {}

    def of(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = features(word)
        return found


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket, drawn towards zero by two standard errors; corpus: counts of all documents."""
    prior = PRIOR_MASS * (corpus + 0.01) / (corpus + 0.01).sum()
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) by Ruzzo and Tompa's linear scan."""
    # Candidates: start, end, total before it, total up to its end, and the last candidate
    # before it that begins at a lower total, so that the search back skips the others.
    held: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, left, k = at, before, len(held) - 1
        while k >= 0 and held[k][2] >= left:
            k = held[k][4]
        while k >= 0 and held[k][3] < total:
            start, _, left, _, back = held[k]
            del held[k:]
            k = back
        held.append((start, at + 1, left, total, k))
    return [(s, e, right - left) for s, e, left, right, _ in held]


@dataclass(frozen=True)
class Model:
    """Bucket scores, drift, extreme-value law and curve."""

    odds: np.ndarray
    drift: float
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def word_score(self, buckets: list[int]) -> float:
        found = self.odds[buckets]
        return float(found[np.argmax(np.abs(found))]) - self.drift

    def segments(self, words: list[bytes], known: dict[bytes, float]) -> list[tuple[int, int, float]]:
        if len(known) > CACHE_WORDS:
            known.clear()
        scores, last = [], None
        for word in words:
            score = known.get(word)
            if score is None:
                score = known[word] = self.word_score(features(word))
            # A word said again at once says nothing new.
            scores.append(-self.drift if word == last else score)
            last = word
        return maximal_segments(scores)

    def surprise(self, score: float, n: int) -> float:
        """-ln of the expected number of clean segments with at least this score."""
        return self.decay * score - math.log(self.scale * n)

    def passages(self, segments, n: int) -> list[tuple[int, int, float]]:
        least = -math.log(SIGNIFICANT)
        rated = ((s, e, self.surprise(score, n)) for s, e, score in segments)
        return [p for p in rated if p[2] > least]

    def evidence(self, segments, n: int) -> float:
        """How much the segments of a text of n words speak for toxicity, 0 at least."""
        if not segments:  # no word speaks for it, or there is none
            return 0.0
        significant = sum(p[2] for p in self.passages(segments, n))
        if significant:
            return math.log1p(significant)
        # -ln of the chance of such a best segment in a clean text
        best = self.surprise(max(s[2] for s in segments), n)
        return math.log1p(-math.log(-math.expm1(-math.exp(min(-best, 30.0)))))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * evidence + self.shift))))


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K that make the best scores of clean texts of n words likeliest."""
    best, n = best.astype(float), np.maximum(n, 1).astype(float)
    if not len(best) or best.std() == 0:
        return 1.0, 1.0

    def likelihood(decay):
        scale = len(best) / (n * np.exp(-decay * best)).sum()
        return (math.log(decay * scale) * len(best) + np.log(n).sum() - decay * best.sum() - len(best)), scale

    decays = np.geomspace(0.02, 20, 200)
    decay = max(decays, key=lambda d: likelihood(d)[0])
    return float(decay), float(likelihood(decay)[1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge."""
    design, weights = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * weights
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(weights[0], 0.0)), float(weights[1])


def word_model(clean: np.ndarray, toxic: np.ndarray, corpus: np.ndarray) -> Model:
    """Bucket scores and drift from the counts of each label and of all documents."""
    odds = log_odds(toxic, clean, corpus)
    share = clean / max(clean.sum(), 1.0)
    # Clean words lose at least half a unit each.
    return Model(odds, drift=0.5 + max(0.0, float((share * odds).sum())))


def _curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    if len(evidence) and 0 < label.sum() < len(label):
        return logistic(evidence, label)
    # One label only: its share, whatever the text.
    return 0.0, math.log((label.sum() + 0.5) / (len(label) - label.sum() + 1.5))


def _bucket_rows(counts: np.ndarray) -> pa.RecordBatch:
    """Counts other than zero as place, bucket, n."""
    place, bucket = np.nonzero(counts)
    columns = [pa.array(c) for c in (place.astype(np.int32), bucket.astype(np.int32), counts[place, bucket])]
    return pa.RecordBatch.from_arrays(columns, names=["place", "bucket", "n"])


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents a word of each bucket occurs, words counted one by one; whole table, no labels."""

    def count(batches):
        counts, words, find = np.zeros((1, BUCKETS), dtype=np.int64), Counter(), Features()

        def enter():
            found = [find.of(w) for w in words]
            times = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), [len(f) for f in found])
            np.add.at(counts[0], np.fromiter(chain.from_iterable(found), dtype=np.int64, count=len(times)), times)
            words.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(set(plain_words(text)))
            if len(words) > CACHE_WORDS:
                enter()
        enter()
        yield _bucket_rows(counts)

    found = small_batches(docs.select(as_bytes("text"))).mapInArrow(count, "place int, bucket int, n bigint")
    # At most BUCKETS rows, whatever the corpus.
    sums = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    corpus = np.zeros(BUCKETS)
    corpus[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return corpus


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """fold, label, text of about ``rows`` labelled documents outside the held-out fifth.

    A labelled doc_id is used if all its labels agree. The chosen ids are few enough to be
    broadcast, so that the documents' texts aren't shuffled.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(f"{HELD_OUT} <> 0")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    known = written(known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")), "labelled")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod("h", F.lit(1_000_003)) < F.lit(int(share * 1_000_003) if share < 1 else 1_000_003))
    chosen = chosen.select(F.col("doc_id").alias("known_id"), "toxic", F.pmod(F.shiftright("h", 24), F.lit(FOLDS)).cast("int").alias("fold"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).select("fold", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """The model of docs and labels; a share for every text if they have one label or none."""
    spark = docs.sparkSession
    # Copies of a text count once.
    chosen = training_rows(docs, labels, rows).groupBy(F.xxhash64("text").alias("h")).agg(
        F.min("fold").alias("fold"), F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.first("text").alias("text")
    )
    texts = written(chosen.filter("toxic = most").select("h", "fold", "toxic", "text"), "training-texts")
    # Many texts may share a doc_id; as many as were asked for, about, are used.
    share = min(1.0, 2 * rows / max(1, texts.count()))
    texts = texts.filter(F.pmod(F.shiftright("h", 24), F.lit(1_000_003)) < math.ceil(share * 1_000_003)).drop("h")

    def count(batches):
        counts = np.zeros((FOLDS * 2, BUCKETS), dtype=np.int64)
        find = Features()
        for batch in batches:
            for fold, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in set(plain_words(text)):
                    counts[2 * fold + label][find.of(word)] += 1
        yield _bucket_rows(counts)

    counted = small_batches(texts).mapInArrow(count, "place int, bucket int, n bigint")
    # At most 2 FOLDS BUCKETS rows, whatever the corpus.
    sums = counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FOLDS * 2, BUCKETS))
    counts[sums.column("place").to_numpy(), sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()

    counts = counts.reshape(FOLDS, 2, BUCKETS)
    total, corpus = counts.sum(axis=0), corpus_counts(docs)
    # Texts are scored by models that did not count them.
    others = spark.sparkContext.broadcast([word_model(*(total - counts[fold]), corpus) for fold in range(FOLDS)])

    def rate(batches):
        known: list[dict] = [{} for _ in range(FOLDS)]
        for batch in batches:
            n, scores = [], []
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = plain_words(text)
                n.append(len(words))
                scores.append([s[2] for s in others.value[fold].segments(words, known[fold])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["toxic", "n", "scores"]
            )

    # All segments of the training texts, of which there are about ``rows``, stay in Spark; a few numbers of each text leave it.
    segments = written(small_batches(texts).mapInArrow(rate, "toxic int, n bigint, scores array<double>"), "segments")
    clean = segments.filter("toxic = 0").select("n", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best")).toArrow()
    decay, scale = extreme_value_law(clean.column("best").to_numpy(), clean.column("n").to_numpy())
    model = word_model(*total, corpus)
    law = Model(np.zeros(0), model.drift, decay, scale)

    def weigh(batches):
        for batch in batches:
            columns = batch.column("scores").to_pylist(), batch.column("n").to_pylist()
            found = [law.evidence([(0, 0, s) for s in scores], n) for scores, n in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "evidence"])

    weighed = small_batches(segments).mapInArrow(weigh, "toxic int, evidence double").toArrow()
    slope, shift = _curve(weighed.column("evidence").to_numpy(), weighed.column("toxic").to_numpy().astype(float))
    return Model(model.odds, model.drift, decay, scale, slope, shift)


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (word positions and -ln E) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def rate(batches):
        model, known = sent.value, {}
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                words = plain_words(text)
                segments = model.segments(words, known)
                scores.append(model.probability(model.evidence(segments, len(words))))
                passages.append([{"start": s, "end": e, "surprise": x} for s, e, x in model.passages(segments, len(words))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, passage)], names=["doc_id", "score", "passages"]
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"))
    schema = "doc_id bigint, score double, passages array<struct<start:int,end:int,surprise:double>>"
    return small_batches(texts).mapInArrow(rate, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of docs.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; others aren't used); other columns are
    not read. A null text is empty; empty texts get the score of a text without a toxic
    segment. A null doc_id is not held out and trains nothing. Repeated rows are scored alike;
    copies of a text train once, and not at all if their labels differ. Without labels, or
    with one label only, every text gets the toxic share, smoothed to a third if there are none.
    """
    found = toxic_passages(docs, train(docs, labels))
    held = F.coalesce(F.expr(f"{HELD_OUT} = 0"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose score is 0.5 or more."""
    text = place_of(docs, "text")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        model, known = sent.value, {}
        for batch in batches:
            clean = []
            for value in batch.column(text).to_pylist():
                words = plain_words((value or "").encode())
                clean.append(model.probability(model.evidence(model.segments(words, known), len(words))) < 0.5)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
