"""Language identification by interpolated Kneser-Ney character models, one for each language.

* A text is its words: runs of letters (and their marks), in lower case. A model predicts a
  word's characters and its end, each from up to ``ORDER - 1`` characters before it.
* Spark counts the words of every training document by language, then the grams of the
  distinct words. Grams of the highest order, and those that begin a word, count how often
  they occur; all others in how many different grams they are the ending. The discount of each
  language and order comes from its counts of one and two.
* A gram's and a context's hash is cut to a number of bits that follows from the number of
  languages, so all models together have at most ``MODEL_ENTRIES`` entries whatever the corpus
  (grams that share a slot are counted as one). Slots are stored as sorted arrays with the
  discounted count, or the total and the weight of the next lower order, beside them.
* The language with the least cross-entropy a character is predicted. Two things are
  calibrated: a logistic curve from the lead over the second language to the probability of
  being right (a text without a lead is right by chance), and the limit of cross-entropy, by
  text length, beyond which a text is in no known language. A model counted without a tenth
  of the documents measures that whole tenth, in sums that Spark adds up; the model
  that predicts is then counted over all of them.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import as_bytes, narrow_batches, small_batches, written

ORDER = 4
# Entries of all models, for grams and again for contexts: about 80 MB at most.
MODEL_ENTRIES = 1 << 22
MOST_BITS = 20
# An unknown character has one in so many chances.
ALPHABET = 1 << 16
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4"
# One of so many training documents measures the model that is counted without it.
CALIBRATION_SHARE = 10
# Share of texts in known languages that the limit of cross-entropy lets pass.
ACCEPTED_SHARE = 0.999
UNKNOWN = "und"

BOUNDARY = " "
_FACTOR = 0x9E3779B97F4A7C15
# Positions hashed together, characters of remembered words, distinct words counted together.
SLICE, CACHE_CHARS, COUNTED_WORDS = 1 << 17, 4_000_000, 200_000
# Bins of a round, and rounds, in which the limit is found.
LIMIT_BINS, LIMIT_ROUNDS = 1024, 5


@functools.cache
def _in_words() -> np.ndarray:
    """Which characters are letters or marks."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=bool, count=0x110000)


def words_of(text: bytes) -> list[str]:
    symbols = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32)
    words = np.where(_in_words()[symbols], symbols, np.uint32(ord(BOUNDARY))).tobytes().decode("utf-32-le").split(BOUNDARY)
    # Marks alone are no word.
    return [w for w in words if w and (w.isalpha() or any(map(str.isalpha, w)))]


def _mixed(h: np.ndarray, order: int) -> np.ndarray:
    """Hashes of sums of weighted characters."""
    h = (h + np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Grams:
    """Grams of one order that end at predicted characters; positions count from the word's boundary."""

    order: int
    at: np.ndarray  # index of the gram's last character
    h: np.ndarray
    context: np.ndarray  # the gram without its last character
    ending: np.ndarray  # the gram without its first character, and that one's context
    ending_context: np.ndarray
    begins: np.ndarray  # whether the gram begins with the word


def slices(words: list[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, list[Grams]]]:
    """Word numbers of the predicted characters of a slice, and its grams of orders 1 to ``order``.

    Words are cut at any place, with the characters before the cut repeated, so the memory
    needed doesn't follow a word's length.
    """
    symbols = np.frombuffer("".join(f"{BOUNDARY}{w}{BOUNDARY}" for w in words).encode("utf-32-le"), dtype=np.uint32)
    length = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    start = np.concatenate([[0], np.cumsum(length)])
    for first in range(0, len(symbols), SLICE):
        back = min(order, first)
        part = symbols[first - back : first + SLICE].astype(np.uint64)
        index = np.arange(first - back, first - back + len(part))
        word = np.searchsorted(start, index, side="right") - 1
        place = index - start[word]
        sums, sum_ = [], np.zeros(len(part), dtype=np.uint64)
        with np.errstate(over="ignore"):
            weight = np.uint64(1)
            for n in range(order):
                shifted = np.zeros_like(part)
                shifted[n:] = part[: len(part) - n]
                sum_ = sum_ + (shifted + np.uint64(1)) * weight
                weight *= np.uint64(_FACTOR)
                sums.append(_mixed(sum_, n + 1))
        empty = np.zeros(len(part), dtype=np.uint64)
        levels = [empty, *sums]

        def before(h):
            return np.concatenate([h[:1], h[:-1]])

        predicted = place >= 1
        predicted[:back] = False
        grams = []
        for n in range(1, order + 1):
            at = np.flatnonzero(predicted & (place >= n - 1))
            grams.append(Grams(
                n, at, levels[n][at], before(levels[n - 1])[at], levels[n - 1][at],
                before(levels[n - 2])[at] if n > 1 else empty[at], place[at] == n - 1,
            ))
        yield word, grams


@dataclass
class Hashed:
    """Values by slot, in a sorted array of slots."""

    slots: np.ndarray
    values: list[np.ndarray]

    def find(self, slots: np.ndarray, missing: list[float]) -> list[np.ndarray]:
        at = np.searchsorted(self.slots, slots)
        at[at == len(self.slots)] = 0
        known = (self.slots[at] == slots) if len(self.slots) else np.zeros(len(slots), dtype=bool)
        return [np.where(known, v[at], m) if len(v) else np.full(len(slots), m) for v, m in zip(self.values, missing, strict=True)]


@dataclass
class Model:
    """Gram and context arrays of each language and order, and what calibration found."""

    languages: list[str]
    bits: int
    grams: list[list[Hashed]]
    contexts: list[list[Hashed]]
    slope: float = 0.0
    shift: float = 0.0
    mean: list[float] = field(default_factory=list)
    spread: tuple[float, float] = (0.0, 0.0)
    limit: float = math.inf

    def costs(self, words: list[str]) -> np.ndarray:
        """Bits that each word takes under each language's model, words by languages."""
        cost = np.zeros((len(words), len(self.languages)))
        cut = np.uint64(64 - self.bits)
        for word, levels in slices(words):
            at = levels[0].at
            # Equal grams are looked up once.
            found = []
            for g in levels:
                slot, where = np.unique(g.h >> cut, return_inverse=True)
                context, where_context = np.unique(g.context >> cut, return_inverse=True)
                found.append((np.searchsorted(at, g.at), slot, where, context, where_context))
            for number in range(len(self.languages)):
                p = np.full(len(at), 1 / ALPHABET)
                for n, (here, slot, where, context, where_context) in enumerate(found):
                    (mass,) = self.grams[number][n].find(slot, [0.0])
                    total, lower = self.contexts[number][n].find(context, [1.0, 1.0])
                    p[here] = np.minimum(mass[where] / total[where_context] + lower[where_context] * p[here], 1.0)
                cost[:, number] += np.bincount(word[at], weights=-np.log2(p), minlength=len(words))
        return cost


class Costs:
    """Words' costs under a model, with those met lately remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.chars = model, {}, 0
        self.table = np.zeros((0, len(model.languages)))

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text by language, and its number of predicted characters."""
        if self.chars > CACHE_CHARS:
            self.known, self.chars, self.table = {}, 0, self.table[:0]
        fresh = list({w for words in texts for w in words if w not in self.known})
        if fresh:
            self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, self.model.costs(fresh)])
            self.chars += sum(map(len, fresh))
        bits = np.zeros((len(texts), len(self.model.languages)))
        size = np.zeros(len(texts), dtype=np.int64)
        for i, words in enumerate(texts):
            bits[i] = self.table[[self.known[w] for w in words]].sum(axis=0)
            size[i] = sum(map(len, words)) + len(words)
        return bits, size


def _count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n, kept of rows with lang, text and spared: kept counts the rows that aren't spared."""

    def flush(counts: dict[tuple[str, bool], Counter]):
        rows = [(lang, word, n, 0 if spared else n) for (lang, spared), words in counts.items() for word, n in words.items()]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "word", "n", "kept"])

    def count(batches):
        counts: dict[tuple[str, bool], Counter] = {}
        for batch in batches:
            for lang, spared, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "spared", "text")), strict=True):
                counts.setdefault((lang, spared), Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield from flush(counts)
                counts = {}
        yield from flush(counts)

    counted = small_batches(docs.select("lang", "spared", as_bytes("text"))).mapInArrow(count, "lang string, word string, n bigint, kept bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))


GRAM = "lang string, ord int, h bigint, context bigint, ending bigint, ending_context bigint, begins boolean, n bigint"


def _count_grams(words: DataFrame, order: int) -> DataFrame:
    """Grams of distinct words with how often they occur."""

    def count(batches):
        for batch in batches:
            langs, times = batch.column("lang"), np.asarray(batch.column("n"))
            for word, levels in slices(batch.column("word").to_pylist(), order):
                for g in levels:
                    at = word[g.at]
                    columns = [pa.array(c.view(np.int64)) for c in (g.h, g.context, g.ending, g.ending_context)]
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(at)), pa.array(np.full(len(at), g.order, np.int32)), *columns, pa.array(g.begins), pa.array(times[at])],
                        names=["lang", "ord", "h", "context", "ending", "ending_context", "begins", "n"],
                    )

    found = small_batches(words).mapInArrow(count, GRAM)
    return found.groupBy("lang", "ord", "h", "context", "ending", "ending_context", "begins").agg(F.sum("n").alias("n"))


def adjusted_counts(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, ord, h, context, a: how often a gram of the highest order or at a word's beginning occurs,
    and in how many longer grams any other is the ending."""
    own = grams.filter((F.col("ord") == order) | F.col("begins")).select("lang", "ord", "h", "context", F.col("n").alias("a"))
    endings = grams.filter("ord > 1").groupBy(
        "lang", (F.col("ord") - 1).alias("ord"), F.col("ending").alias("h"), F.col("ending_context").alias("context")
    )
    return own.unionByName(endings.agg(F.count(F.lit(1)).alias("a")))


def _slot(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def model_bits(languages: int, order: int = ORDER) -> int:
    return max(1, min(MOST_BITS, int(math.log2(MODEL_ENTRIES / (max(1, languages) * order)))))


def _hashed(rows: pa.Table, languages: list[str], order: int, *values: str) -> list[list[Hashed]]:
    lang, ord_, slot = rows.column("lang").to_numpy(), rows.column("ord").to_numpy(), rows.column("slot").to_numpy().astype(np.uint64)
    columns = [rows.column(v).to_numpy() for v in values]
    number = np.searchsorted(np.array(languages, dtype=object), lang)
    found = []
    for i in range(len(languages)):
        found.append([])
        for n in range(1, order + 1):
            at = np.flatnonzero((number == i) & (ord_ == n))
            at = at[np.argsort(slot[at])]
            found[-1].append(Hashed(slot[at], [c[at].astype(np.float32) for c in columns]))
    return found


def count_model(docs: DataFrame, order: int = ORDER) -> Model:
    """The models of all languages of rows with lang and text, not calibrated."""
    return word_model(written(_count_words(docs.withColumn("spared", F.lit(False))), "words").select("lang", "word", "n"), order)


def word_model(words: DataFrame, order: int = ORDER) -> Model:
    """The models of all languages of counted words (lang, word, n), not calibrated."""
    grams = written(_count_grams(words, order), "grams")
    counts = written(adjusted_counts(grams, order), "adjusted")
    # A row for each language and order.
    once, twice = (F.count_if(F.col("a") == k).alias(name) for k, name in ((1, "once"), (2, "twice")))
    rows = counts.groupBy("lang", "ord").agg(once, twice).collect()
    languages = sorted({r.lang for r in rows}, key=str.encode)
    bits = model_bits(len(languages), order)
    # The discount that Kneser and Ney take from every count; a half where nothing is known.
    discounts = [(r.lang, r.ord, min(0.95, max(0.1, r.once / (r.once + 2 * r.twice))) if r.once else 0.5) for r in rows]
    known = F.broadcast(words.sparkSession.createDataFrame(discounts, "lang string, ord int, discount double"))
    counts = counts.join(known, ["lang", "ord"])
    mass = counts.groupBy("lang", "ord", _slot(F.col("h"), bits).alias("slot")).agg(F.sum(F.greatest(F.col("a") - F.col("discount"), F.lit(0.0))).alias("mass"))
    taken = F.sum(F.least(F.col("discount"), F.col("a").cast("double")))
    contexts = counts.groupBy("lang", "ord", _slot(F.col("context"), bits).alias("slot")).agg(
        F.sum("a").cast("double").alias("total"), (taken / F.sum("a")).alias("lower")
    )
    # At most 2 ** bits rows for each language and order.
    languages_utf8 = sorted(languages)
    return Model(
        languages_utf8, bits, _hashed(mass.toArrow(), languages_utf8, order, "mass"), _hashed(contexts.toArrow(), languages_utf8, order, "total", "lower")
    )


def ranked(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, its bits a character, and the lead in bits over the next one.

    The first of equal languages is taken. Chance, with equally likely characters, is a
    competitor too, so one language alone has a lead as well.
    """
    rows = np.arange(len(bits))
    best = bits.argmin(axis=1)
    least = bits[rows, best]
    others = np.hstack([bits, (size * math.log2(ALPHABET))[:, None]])
    others[rows, best] = np.inf
    return best, least / np.maximum(size, 1), np.maximum(others.min(axis=1) - least, 0)


@dataclass
class Texts:
    """Measured texts of known language: its number, the best one's, bits a character, the lead in bits, and characters."""

    own: np.ndarray
    best: np.ndarray
    entropy: np.ndarray
    lead: np.ndarray
    size: np.ndarray


# Sums (or what the other function merges) of a function's values over all parts of the texts.
Over = Callable[..., np.ndarray]


def measured_texts(model: Model, bits: np.ndarray, size: np.ndarray, langs: list[str]) -> Texts:
    """The texts that have characters and a language of the model."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    own = np.array([number.get(lang, -1) for lang in langs], dtype=np.int64)
    used = np.flatnonzero((own >= 0) & (size > 0))
    best, entropy, lead = ranked(bits[used], size[used])
    return Texts(own[used], best, entropy, lead, size[used])


def _curve(over: Over, languages: int) -> tuple[float, float]:
    """Slope and shift of the probability of being right by log lead: Newton's method with a small ridge."""
    weights = np.zeros(2)

    def parts(x: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(weights[0] * x + weights[1], -30, 30)))
        off, bend = times * (y - p), times * p * (1 - p)
        return np.array([off @ x, off.sum(), bend @ (x * x), bend @ x, bend.sum()])

    # Texts without a lead: one of each language, and the first is always said.
    chance = np.zeros(2), np.array([1.0, 0.0]), np.array([1.0, languages - 1.0])
    for _ in range(50):
        now = weights.copy()
        sums = parts(*chance, now) + over(lambda t: parts(np.log1p(t.lead), (t.best == t.own).astype(float), np.ones(len(t.own)), now))  # noqa: B023
        step = np.linalg.solve(np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + 1e-3 * np.eye(2), sums[:2] - 1e-3 * now)
        weights = now + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(weights[0], 0.0)), float(weights[1])


def _share_limit(over: Over, values: Callable[[Texts], np.ndarray], count: int) -> float:
    """The value that ACCEPTED_SHARE of the texts don't exceed, by counts in ever narrower bins."""
    low, high = -over(lambda t: np.max(-values(t), initial=-np.inf)[None], np.maximum)[0], over(lambda t: np.max(values(t), initial=-np.inf)[None], np.maximum)[0]
    wanted = math.ceil(ACCEPTED_SHARE * count)
    for _ in range(LIMIT_ROUNDS):
        edges = np.linspace(low, high, LIMIT_BINS + 1)
        if not (np.diff(edges) > 0).all():
            break
        # Texts at or below each edge.
        below = over(lambda t: np.searchsorted(np.sort(values(t)), edges, side="right"))  # noqa: B023
        at = int(np.searchsorted(below, wanted))
        if at == 0:
            return float(low)
        low, high = edges[at - 1], edges[min(at, LIMIT_BINS)]
    return float(high)


def fit(model: Model, over: Over) -> Model:
    """The curve and the limit, from sums over measured texts."""
    languages = len(model.languages)
    model.slope, model.shift = _curve(over, languages)
    known = over(lambda t: np.concatenate([np.bincount(t.own, w, languages) for w in (t.entropy * t.size, t.size)]))
    mean = np.where(known[languages:] > 0, known[:languages] / np.maximum(known[languages:], 1), math.log2(ALPHABET))
    model.mean = mean.tolist()

    def right(t: Texts) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(t.best == t.own)
        return t.entropy[at] - mean[t.own[at]], t.size[at]

    count = int(over(lambda t: np.array([(t.best == t.own).sum()]))[0])
    if count >= 20:

        def normal(t: Texts) -> np.ndarray:
            off, size = right(t)
            # Variance by text length: a part that falls with it, and one that stays.
            design = np.stack([1 / size, np.ones(len(size))], axis=1)
            weight = (size / (1 + size / 500)) ** 2  # short texts scatter more
            return np.concatenate([(design.T * weight @ design).ravel(), design.T @ (weight * off**2)])

        sums = over(normal)
        falls, stays = np.linalg.lstsq(sums[:4].reshape(2, 2), sums[4:], rcond=None)[0]
        model.spread = falls, stays = max(float(falls), 1e-3), max(float(stays), 1e-6)

        def scaled(t: Texts) -> np.ndarray:
            off, size = right(t)
            return off / np.sqrt(falls / size + stays)

        model.limit = _share_limit(over, scaled, count)
    return model


def calibrate(model: Model, bits: np.ndarray, size: np.ndarray, langs: list[str]) -> Model:
    """The curve and the limit, from a few texts of known language."""
    texts = measured_texts(model, bits, size, langs)
    return fit(model, lambda part, merge=np.add: part(texts))


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    """The numbers of ``Texts`` for rows with lang and text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["own", "best", "entropy", "lead", "size"]

    def measure(batches):
        costs = Costs(sent.value)
        for batch in batches:
            bits, size = costs.of([words_of(t) for t in batch.column("text").to_pylist()])
            texts = measured_texts(sent.value, bits, size, batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(getattr(texts, n)) for n in names], names=names)

    return small_batches(docs.select("lang", as_bytes("text"))).mapInArrow(measure, "own bigint, best bigint, entropy double, lead double, size bigint")


def _over(measured: DataFrame) -> Over:
    """Sums over a table of measured texts: every task gives one row."""

    def over(part: Callable[[Texts], np.ndarray], merge: np.ufunc = np.add) -> np.ndarray:
        empty = Texts(*(np.zeros(0, dtype=np.int64) if n in ("own", "best", "size") else np.zeros(0) for n in ("own", "best", "entropy", "lead", "size")))

        def merged(batches):
            found = part(empty)
            for batch in batches:
                found = merge(found, part(Texts(*(np.asarray(batch.column(n)) for n in ("own", "best", "entropy", "lead", "size")))))
            yield pa.RecordBatch.from_arrays([pa.array([found.astype(float).tolist()], pa.list_(pa.float64()))], names=["found"])

        rows = narrow_batches(measured).mapInArrow(merged, "found array<double>").collect()
        return merge.reduce([np.array(r.found) for r in rows], axis=0) if rows else part(empty).astype(float)

    return over


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The calibrated model of the rows outside the held-out quarter that have a language."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).filter(f"{HELD_OUT} <> 2")
    rows = rows.withColumn("spared", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE)) == 0)
    words = written(_count_words(rows), "words")
    model = word_model(words.select("lang", "word", "n"), order)
    if not model.languages:
        return model
    kept = word_model(words.filter("kept > 0").select("lang", "word", F.col("kept").alias("n")), order)
    if not kept.languages:
        return calibrate(model, np.zeros((0, len(model.languages))), np.zeros(0, dtype=np.int64), [])
    kept = fit(kept, _over(written(_measured(rows.filter("spared"), kept), "measured")))
    # A language that only spared documents have was not measured.
    mean = dict(zip(kept.languages, kept.mean, strict=True))
    means = [mean.get(lang, math.log2(ALPHABET)) for lang in model.languages]
    return replace(model, slope=kept.slope, shift=kept.shift, mean=means, spread=kept.spread, limit=kept.limit)


def predicted(model: Model, texts: Iterable[bytes], costs: Costs) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, probability, whether it is accepted and bits a character of each text."""
    words = [words_of(t) for t in texts]
    if not model.languages:
        none = np.zeros(len(words))
        return [UNKNOWN] * len(words), none, none > 0, none
    bits, size = costs.of(words)
    best, entropy, lead = ranked(bits, size)
    some = size > 0
    score = 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(lead) + model.shift, -30, 30)))
    off = (entropy - np.array(model.mean)[best]) / np.sqrt(model.spread[0] / np.maximum(size, 1) + model.spread[1] + 1e-12)
    langs = [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
    return langs, np.where(some, score, 0.0), some & (off <= model.limit) & (score >= 0.5), np.where(some, entropy, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted, entropy for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        costs = Costs(sent.value)
        for batch in batches:
            langs, *columns = predicted(sent.value, batch.column("text").to_pylist(), costs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), *map(pa.array, columns)], names=["doc_id", "lang_pred", "score", "accepted", "entropy"]
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"))
    return small_batches(texts).mapInArrow(predict, "doc_id bigint, lang_pred string, score double, accepted boolean, entropy double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, entropy for every row of docs.

    docs: doc_id, text, lang; other columns are not read. A text that is null or has no letter is
    ``und`` with score 0, as is every text if no document with a language trains. ``accepted``
    is false for texts that are more likely in none of the languages, and for leads that
    are as likely wrong as right. A null doc_id is not held out and trains nothing. Repeated rows count
    as often as they occur and are judged alike; of languages that cost the same, the first by name
    is taken. Texts and words may have any length.
    """
    held = F.coalesce(F.expr(f"{HELD_OUT} = 2"), F.lit(False))
    found = identify(docs, train(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted", "entropy")
