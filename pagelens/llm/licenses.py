"""Licence texts and notices in documents: MinHash bands find them, exact shingle containment decides.

A template is the set of its five-word shingles. It occurs in a document where ``SIMILARITY``
of them stand within 1.25 times its length. Candidates come from MinHash: windows of four
blocks of 1, 2, 4, ... shingles, each beginning one block after the last, so a template always
has a window of at least its length and at most twice that; ``BANDS`` bands of one row each,
with which a window that shares a third of its shingles with the template (union) is missed
with a chance of 7e-5. One row is enough to be selective: minima are equal only if a shingle
is shared. Each candidate's surroundings are then compared shingle by shingle.

The texts of a batch are hashed as one sequence in numpy; shingles that would reach across two
texts never are a minimum. Minima of a block size are made from those of half the size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.license_texts import TEMPLATES
from pagelens.llm.words import as_bytes, plain_words, small_batches

SHINGLE, SIMILARITY, STRETCH = 5, 0.8, 1.25
BANDS, BLOCKS = 24, 4
# Shingles whose minima are held at once.
CHUNK = 1 << 15
FILTER_BITS = 18
CACHE_WORDS = 200_000
_NEVER = np.uint64(2**64 - 1)

_rng = np.random.default_rng(2024)
_SHINGLE_FACTORS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND_FACTORS = (_rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1))[:, None]
_BAND_SHIFTS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)[:, None]


def miss_chance(similarity: float, bands: int = BANDS, rows: int = 1) -> float:
    """Chance that no band of a window of this similarity collides."""
    return (1 - similarity**rows) ** bands


class Hashes:
    """Hashes of words, with those met lately remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.array([known[w] for w in words], dtype=np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ (words[k : k + n] * _SHINGLE_FACTORS[k])) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def band_values(shingles: np.ndarray) -> np.ndarray:
    """Bands by shingles."""
    return (shingles[None, :] * _BAND_FACTORS + _BAND_SHIFTS) ^ (shingles[None, :] >> np.uint64(31))


@dataclass(frozen=True)
class Template:
    name: str
    shingles: frozenset[int]
    length: int  # in shingles
    block: int

    @property
    def needed(self) -> int:
        return -(-len(self.shingles) * int(SIMILARITY * 10) // 10)

    @property
    def reach(self) -> int:
        """Shingles within which the needed ones must stand."""
        return int(np.ceil(STRETCH * self.length))


class Index:
    """Templates by block size, band and minimum."""

    def __init__(self, texts: dict[str, str]):
        self.templates, self.tables = [], {}
        hashes = Hashes()
        for name, text in sorted(texts.items()):
            shingles = shingle_hashes(hashes.of(plain_words(text.encode())))
            if not len(shingles):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            block = 1
            while BLOCKS * block < len(shingles):
                block *= 2
            self.templates.append(Template(name, frozenset(shingles.tolist()), len(shingles), block))
            maybe, found = self.tables.setdefault(block, (np.zeros((BANDS, 1 << FILTER_BITS), dtype=bool), [{} for _ in range(BANDS)]))
            for band, value in enumerate(band_values(shingles).min(axis=1).tolist()):
                maybe[band, value >> (64 - FILTER_BITS)] = True
                found[band].setdefault(value, []).append(len(self.templates) - 1)

    def candidates(self, shingles: np.ndarray, valid: np.ndarray) -> set[tuple[int, int]]:
        """(template, first shingle of a window) with a colliding band."""
        out: set[tuple[int, int]] = set()
        largest = max(self.tables)
        overlap = BLOCKS * largest
        for start in range(0, len(shingles), CHUNK):
            part = slice(start, start + CHUNK + overlap)
            values = np.where(valid[part][None, :], band_values(shingles[part]), _NEVER)
            block = 1
            while True:
                if block in self.tables:
                    out.update(self._collisions(block, values, start))
                if block == largest:
                    break
                if values.shape[1] % 2:
                    values = np.concatenate([values, np.full((BANDS, 1), _NEVER)], axis=1)
                values = np.minimum(values[:, ::2], values[:, 1::2])
                block *= 2
        return out

    def _collisions(self, block: int, minima: np.ndarray, start: int):
        maybe, found = self.tables[block]
        padded = np.concatenate([minima, np.full((BANDS, BLOCKS - 1), _NEVER)], axis=1)
        n = minima.shape[1]
        window = padded[:, :n]
        for k in range(1, BLOCKS):
            window = np.minimum(window, padded[:, k : k + n])
        high = (window >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        for band in range(BANDS):
            for place in np.flatnonzero(maybe[band][high[band]]).tolist():
                for template in found[band].get(int(window[band, place]), ()):
                    yield template, start + place * block


def occurrences(template: Template, shingles: list[int], at: int) -> list[tuple[int, int]]:
    """Runs (first shingle, end of the last one) that hold enough of the template; ``at`` is the first one's place."""
    places = [i for i, s in enumerate(shingles) if s in template.shingles]
    held: Counter[int] = Counter()
    out: list[tuple[int, int]] = []
    right = 0
    for left in places:
        while right < len(places) and places[right] < left + template.reach:
            held[shingles[places[right]]] += 1
            right += 1
        if len(held) >= template.needed:
            first, last = at + left, at + places[right - 1] + 1
            if out and first <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], last)
            else:
                out.append((first, last))
        held[shingles[left]] -= 1
        if not held[shingles[left]]:
            del held[shingles[left]]
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def scan_texts(texts: list[bytes], index: Index, hashes: Hashes) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """Number of words of each text, and its licences (name, first word, end) by place and name."""
    split = [plain_words(t) for t in texts]
    sizes = [len(w) for w in split]
    shingles = shingle_hashes(hashes.of([w for words in split for w in words]))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(starts[1:], sizes)[: len(shingles)] - np.arange(len(shingles))  # words up to the text's end
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for number, at in sorted(index.candidates(shingles, left >= SHINGLE)):
        template = index.templates[number]
        # A window may reach into the next texts; each is looked at by itself.
        first_text = int(np.searchsorted(starts, at, side="right")) - 1
        last_text = int(np.searchsorted(starts, min(at + BLOCKS * template.block, starts[-1]) - 1, side="right")) - 1
        for text in range(first_text, last_text + 1):
            low, high = int(starts[text]), int(starts[text + 1]) - SHINGLE + 1
            a, b = max(low, at - template.reach), min(high, at + BLOCKS * template.block + template.reach)
            if a < b:
                runs = occurrences(template, shingles[a:b].tolist(), a - low)
                if runs:
                    found.setdefault((text, number), []).extend(runs)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (text, number), runs in found.items():
        out[text] += [(index.templates[number].name, a, b + SHINGLE - 1) for a, b in merged(runs)]
    return [(n, sorted(o, key=lambda s: (s[1], s[0]))) for n, o in zip(sizes, out, strict=True)]


@cache
def built_index(texts: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(texts))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, licenses (name, start, end in words, end exclusive) for every row of docs.

    docs: doc_id, text; other columns are not read. A null text has no words and no licences.
    Occurrences of a template that touch are one; those of different templates may overlap,
    and are ordered by start, then name. Repeated rows give repeated rows, no rows none.
    A template needs five words or more.
    """
    texts = tuple(sorted((templates or TEMPLATES).items()))
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        index, hashes = built_index(texts), Hashes()
        for batch in batches:
            found = scan_texts(batch.column(1).to_pylist(), index, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[{"name": t, "start": a, "end": b} for t, a, b in s] for _, s in found], kind)],
                names=["doc_id", "n_words", "licenses"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"))
    return small_batches(rows).mapInArrow(scan, "doc_id bigint, n_words bigint, licenses array<struct<name:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_licenses, licenses (different names, sorted) and spans (name:start:end) as text."""
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.col("licenses.name")))
    return found.select(
        "doc_id", "n_words", F.size(names).cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
