"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each task tokenizes its documents, cuts the long ones, packs the pieces that are
   shorter than a sequence best-fit (longest first) and calls a bin closed when at
   most ``SLACK`` tokens are free.
2. Open bins become items of the next round: they are dealt to fewer tasks, where
   best-fit joins whole bins. Rounds go on until one task holds all open bins or the
   number of tasks no longer falls, which closes what is left.

Only open bins move, and a bin holds at most ``capacity`` pieces, so no row grows
with the input. Token ids never move: a piece is carried as its place, its length
and the CRC-32 of its ids.
"""

from __future__ import annotations

import base64
import functools
import importlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import small_batches, written

CAPACITY = 2048
# Tokens that may stay free in a bin that is no longer offered to others.
SLACK = 8
# Pieces that a task holds before it packs them, and open bins dealt to one task of a round.
LOCAL_ITEMS = 100_000
ROUND_ITEMS = 20_000
# Different words whose ids a task remembers.
CACHE_WORDS = 150_000
# Characters without a place to cut, as a run of blanks, beyond which the JSON file's tokenizer is
# used: the patterns of the other stop at a million blanks.
LONG_PART = 100_000
SPECIAL = "<|endoftext|>"

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BINS = f"closed boolean, used int, members array<{MEMBER}>"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
           "ids_crc32": pa.int64(), "offset": pa.int64()}


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The byte-level vocabulary splits a text before tokenizing, and never across a single
    blank that stands between two characters that aren't white space. So the ids of a text
    are those of its blank-separated parts, most of which occur again and again.
    ``ranks_file`` holds the vocabulary as ranks, ``tokenizer_file`` the same one with its
    special token, for texts in which that token's string occurs.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import tiktoken

        module = importlib.import_module("public_tokenizers")
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("bytes", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer_file = tokenizer_file
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_file)

    def part(self, part: str) -> bytes:
        if len(part) > LONG_PART:
            return np.array(self.whole.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = np.array(self.encoder.encode_ordinary(part), dtype="<u4").tobytes()
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        if len(part) < 64:
            self.known[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        # A part that is empty or has white space at an end belongs to a longer run of white space.
        if any(not p or p[0].isspace() or p[-1].isspace() for p in (first, *rest)):
            return self._uneven(text, first, rest)
        known = self.known.get
        return b"".join([known(p) or self.part(p) for p in chain((first,), [f" {p}" for p in rest])])

    def _uneven(self, text: str, first: str, rest: list[str]) -> bytes:
        """The same, with parts that touch a run of white space taken together, as one slice of the text."""
        ids, start, end, glued = [], 0, len(first), not first or first[-1].isspace()
        for part in rest:
            if not glued and part and not part[0].isspace():
                held = text[start:end]
                ids.append(self.known.get(held) or self.part(held))
                start = end
            end += 1 + len(part)
            glued = not part or part[-1].isspace()
        held = text[start:end]
        ids.append((self.known.get(held) or self.part(held)) if held else b"")
        return b"".join(ids)


@functools.cache
def ids_of(tokenizer_file: str, ranks_file: str) -> Ids:
    return Ids(tokenizer_file, ranks_file)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of a document; only its first piece may be shorter than the rest."""
    total = len(ids) // 4
    end = total if total <= capacity else total % capacity or capacity
    start = piece = 0
    while start < total:
        yield piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, end, piece = end, min(end + capacity, total), piece + 1


def best_fit(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin that has room."""
    sizes = np.asarray(sizes, dtype=np.int64)
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r free
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        left = room - size
        by_room[left].append(chosen)
        rooms |= 1 << left
    return bins


def _bin_batch(bins: list[tuple[int, list[tuple]]], capacity: int, last: bool) -> pa.RecordBatch:
    """bins: tokens used, members. A closed bin leaves the rounds."""
    used = [u for u, _ in bins]
    offsets = np.concatenate([[0], np.cumsum([len(m) for _, m in bins])]).astype(np.int32)
    flat = list(zip(*chain.from_iterable(m for _, m in bins), strict=True)) or [[] for _ in _FIELDS]
    members = pa.StructArray.from_arrays(
        [pa.array(values, kind) for values, kind in zip(flat, _FIELDS.values(), strict=True)], names=list(_FIELDS)
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([last or u >= capacity - SLACK for u in used], pa.bool_()),
            pa.array(used, pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members),
        ],
        names=["closed", "used", "members"],
    )


def _batches(bins: list[tuple[int, list[tuple]]], capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(bins), 4096):
        yield _bin_batch(bins[i : i + 4096], capacity, last)


def _joined(items: list[tuple[int, list[tuple]]], group: list[int]) -> tuple[int, list[tuple]]:
    """One bin of several: the places of later members move by what stands before them."""
    used, members = 0, []
    for i in group:
        size, own = items[i]
        members += [(*m[:5], m[5] + used) for m in own] if used else own
        used += size
    return used, members


def _packed(items: list[tuple[int, list[tuple]]], capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    groups = best_fit([size for size, _ in items], capacity)
    yield from _batches([_joined(items, g) for g in groups], capacity, last)


def token_pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str, capacity: int = CAPACITY) -> DataFrame:
    """The first round: bins of each task's pieces."""

    def pack(batches):
        ids = ids_of(tokenizer_file, ranks_file)
        end = bytes(4)
        held: list[tuple[int, list[tuple]]] = []
        for batch in batches:
            full: list[tuple[int, list[tuple]]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, start, length, crc in cut(ids.of(text) + end, capacity):
                    (held if length < capacity else full).append((length, [(doc_id, piece, start, length, crc, 0)]))
            if full:
                yield from _batches(full, capacity, False)
            if len(held) >= LOCAL_ITEMS:
                yield from _packed(held, capacity, False)
                held = []
        if held:
            yield from _packed(held, capacity, False)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return small_batches(texts).mapInArrow(pack, BINS)


def merge_round(bins: DataFrame, tasks: int, capacity: int = CAPACITY, last: bool = False) -> DataFrame:
    """Open bins dealt to ``tasks`` tasks, where best-fit joins them; ``last`` closes all of them."""

    def pack(batches):
        held = []
        for batch in batches:
            members = [
                [tuple(m.values()) for m in own] for own in batch.column("members").to_pylist()
            ]
            held += zip(batch.column("used").to_pylist(), members, strict=True)
            if len(held) >= LOCAL_ITEMS:
                yield from _packed(held, capacity, last)
                held = []
        if held:
            yield from _packed(held, capacity, last)

    return bins.filter(~F.col("closed")).repartition(tasks).mapInArrow(pack, BINS)


def pack_documents(
    docs: DataFrame, tokenizer_file: str | None = None, ranks_file: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text; other columns are not read. A null text is empty: it is one piece
    with the closing id only. Null and repeated doc_ids are packed row by row. No rows, no
    pieces. Texts of equal length keep the order in which their task read them. The
    vocabulary files default to those installed on the machine.
    """
    tokenizer_file = tokenizer_file or tokenizer_path("byte_bpe_50k.json")
    ranks_file = ranks_file or tokenizer_path("byte_bpe_50k.tiktoken")
    bins = token_pieces(docs, tokenizer_file, ranks_file, capacity)
    closed, tasks, last = [], None, False
    while True:
        done = written(bins, "bins")
        closed.append(done.filter("closed"))
        left = 0 if last else done.filter("not closed").count()
        if not left:
            break
        fewer = -(-left // ROUND_ITEMS)
        # With one task, or no fewer than before, this round is the last one.
        last = fewer == 1 or (tasks is not None and fewer > 0.7 * tasks)
        bins, tasks = merge_round(done, fewer, capacity, last), fewer
    rows = functools.reduce(DataFrame.unionByName, closed)
    # Numbered before the members are unfolded.
    numbered = rows.withColumn("sequence_id", F.monotonically_increasing_id())
    pieces = numbered.select("sequence_id", F.explode("members").alias("m"))
    return pieces.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
