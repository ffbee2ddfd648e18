"""Vector compression: each part of a vector becomes the number of its nearest codebook entry.

Components lie on an integer grid, so few different values occur in a dimension. For every
dimension a dictionary holds the distinct values of the vectors at hand, and a table the
squared difference of each of them to each entry of the codebook. The distance of a part to
all entries is then a sum of table rows: one gather for each component by the vector's
dictionary code, and no multiplication for each vector. Dictionaries are those of an Arrow batch,
so their size is bounded whatever values the whole table holds.

Codebooks are trained over all vectors: tasks sum the parts of each entry, Spark adds the sums
up, and one row for each component and entry, a fixed number, meets the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.vectors import as_matrix, digest, grid_vectors, totals
from pagelens.llm.words import narrow_batches, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower number) and its squared distance, vectors by parts.

    v: vectors by components; books: parts by entries by components of a part.
    """
    parts, entries, width = books.shape
    nearest, error = np.empty((len(v), parts), dtype=np.int64), np.empty((len(v), parts), dtype=np.int64)
    rows = np.arange(len(v))
    for part in range(parts):
        distance = None
        for place in range(width):
            values, code = np.unique(v[:, part * width + place], return_inverse=True)
            table = (values.astype(np.int64)[:, None] - books[part, :, place][None, :]) ** 2
            # Half the memory to move where the sum of the part's tables fits.
            if int(table.max(initial=0)) * width < 2**31 and (distance is None or distance.dtype == np.int32):
                table = table.astype(np.int32)
            gathered = table[code]
            distance = gathered if distance is None else distance + gathered
        nearest[:, part] = distance.argmin(axis=1)
        error[:, part] = distance[rows, nearest[:, part]]
    return nearest, error


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Sums of each component (and, behind the components, counts of each part) by entry: place, slot, total."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        sums = np.zeros((parts * width + parts, entries), dtype=np.int64)
        for batch in batches:
            v = as_matrix(batch.column("v"), parts * width)
            nearest, _ = assign(v, sent.value)
            for part in range(parts):
                np.add.at(sums[parts * width + part], nearest[:, part], 1)
                for d in range(part * width, (part + 1) * width):
                    np.add.at(sums[d], nearest[:, part], v[:, d])
        place, slot = np.nonzero(sums)
        columns = [pa.array(c) for c in (place.astype(np.int32), slot.astype(np.int32), sums[place, slot])]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "slot", "total"])

    return narrow_batches(vectors.select("v")).mapInArrow(add, "place int, slot int, total bigint")


def trained_books(vectors: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, parts by entries by components: the parts of the first vectors by vec_id, then ``rounds`` rounds."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    width = dims // parts
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        sums = np.zeros((parts * width + parts, len(first)), dtype=object)
        for place, slot, total in totals(_sums(vectors, books)):
            sums[place, slot] = total
        books = books.copy()
        for part in range(parts):
            count = sums[parts * width + part]
            for entry in np.flatnonzero(count):
                books[part, entry] = [s // count[entry] for s in sums[part * width : (part + 1) * width, entry]]
    return books


def vector_dims(rows: DataFrame, parts: int = PARTS) -> int:
    """The commonest length of a vector that ``parts`` divides, the smaller of two equally common ones; 0 if there is none."""
    size = F.size("embedding")
    sizes = rows.select(size.alias("n")).filter((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count()
    found = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0].n if found else 0


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for every kept row.

    rows: vec_id, embedding, label; other columns are not read. Dropped are vectors that are
    null, hold a null or a component that is not finite (or beyond ``grid_limit``, where squared
    distances would not fit a long), or have another length than ``vector_dims``. Repeated rows
    are vectors of their own. Null labels are one group. The first vectors are those of the
    smallest vec_ids, nulls last, ties to the smaller vector; fewer than ``entries`` make smaller
    codebooks, none make no rows. A label's sum beyond a long is null.
    """
    spark = rows.sparkSession
    dims = vector_dims(rows, parts) or parts
    vectors = written(grid_vectors(rows, dims, "label"), "grid")
    books = trained_books(vectors, dims, parts, entries, rounds)
    sent = spark.sparkContext.broadcast(books)
    kind = vectors.schema["label"].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            nearest, error = assign(as_matrix(batch.column("v"), dims), sent.value)
            text = nearest.astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    found = written(narrow_batches(vectors).mapInArrow(encode, f"vec_id bigint, label {kind}, code string, error bigint"), "codes")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.drop("of").withColumn("codebooks_sha256", F.lit(digest(books.reshape(-1).tolist())))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The plain algorithm, for vectors of one length."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, x, d, d // (n // {parts}) AS p FROM (SELECT r, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS d FROM v)),
c0 AS MATERIALIZED (
  SELECT e, c, d, d // (n // {parts}) AS p FROM (
    SELECT e, len(v) AS n, unnest(v) AS c, unnest(range(len(v))) AS d FROM (
      SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS e, v FROM v) WHERE e < {entries}))"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (s, e)) AS e, min(s) AS s FROM (
    SELECT r, x.p, e, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c{t} USING (d) GROUP BY r, x.p, e) GROUP BY r, p)""")
        if t < rounds:
            steps.append(f"""
m{t} AS MATERIALIZED (SELECT e, d, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} USING (r, p) GROUP BY e, d),
c{t + 1} AS MATERIALIZED (SELECT e, d, p, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{t} LEFT JOIN m{t} USING (e, d))""")
    return "WITH" + ",".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, d)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (r)"""
