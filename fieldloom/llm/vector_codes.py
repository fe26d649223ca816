"""Vector code compression: product codes by integer codebooks, refined in rounds.

A component x becomes the integer floor(256 x), and a vector is cut into equal consecutive parts. Codebooks are small
arrays of integers, so they are broadcast; in Arrow batches the distances of all parts to all entries are one exact int64
matrix product (the norm of a part is the same for all its entries, so it joins only the smallest sum), and the first
least entry is a part's code. Each round a task adds up the parts of each entry that it has seen, a grouped shuffle merges
these sums, and the floors of their means are the next codebooks. What reaches the driver is as large as the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_side, stage

#: Vectors whose distances are worked out at once.
CHUNK = 2048
#: An integer component's size from which on squared distances of long vectors might leave 64 bits.
LARGEST = 1 << 24


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position] as integers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (ties: the first) of every part, and its squared distance; both [vector, part]."""
        parts, _, width = self.entries.shape
        x = vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2)
        from_part = (self.entries**2).sum(2)[:, None, :] - 2 * np.matmul(x, self.entries.transpose(0, 2, 1))
        nearest = from_part.argmin(2)
        least = np.take_along_axis(from_part, nearest[..., None], 2)[..., 0] + (x**2).sum(2)
        return nearest.T, least.T


def usable(vector: Column) -> Column:
    """True for an array without nulls and non-finite numbers; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 x) of every component; 256 x is exact, as 256 is a power of two."""
    return F.transform(vector, lambda x: F.floor(x * F.lit(256.0)).cast("long"))


def fits(vector: Column, width: int | None) -> Column:
    """Whether a usable vector has the table's length, and components whose distances stay exact in 64 bits."""
    if width is None:
        return F.lit(False)
    return (F.size(vector) == width) & F.forall(vector, lambda x: F.abs(x) * F.lit(256.0) < F.lit(float(LARGEST)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def refine(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The next codebooks: each entry the floor of the mean of the parts assigned to it; an entry without parts stays.
    kept has the integer vectors in a column q."""
    parts, size, width = books.entries.shape
    held = kept.sparkSession.sparkContext.broadcast(books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(held.value)
        total = np.zeros((parts, size, width + 1), np.int64)  # the last position counts
        entry_of_part = np.arange(parts) * size
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width)
            for at in range(0, len(vectors), CHUNK):
                some = vectors[at : at + CHUNK]
                nearest, _ = own.assign(some)
                places = (nearest + entry_of_part).reshape(-1)
                total[..., -1] += np.bincount(places, minlength=parts * size).reshape(parts, size)
                for position, components in enumerate(some.reshape(-1, width).T):  # a chunk's sums are exact as doubles
                    total[..., position] += np.bincount(places, components, parts * size).astype(np.int64).reshape(parts, size)
        part, entry = np.nonzero(total[..., -1])
        found = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(found), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    spread = kept.select("q").mapInArrow(sums, "part int, entry int, sums array<bigint>").select("part", "entry", F.posexplode("sums").alias("position", "total"))
    merged = spread.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = np.zeros((parts, size, width + 1), object)
    for r in merged.collect():  # as large as the codebooks
        total[r.part, r.entry, r.position] = int(r.total)
    entries = books.entries.copy()
    for part, entry in zip(*np.nonzero(total[..., -1])):
        entries[part, entry] = [t // total[part, entry, -1] for t in total[part, entry, :-1]]
    held.destroy()
    return Codebooks(entries)


def learn(vectors: DataFrame, parts: int, size: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Codebooks | None, int | None]:
    """Codebooks and the vectors' length. They start as the parts of the `size` smallest ids (nulls last; equal ids by
    content), of as many rows as there are if fewer. The length is that of the smallest id whose vector is usable, isn't
    empty and can be cut into parts; None for both if there is no such row."""
    vector = F.col(vector_col)
    given = vectors.select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("v")).where(usable(F.col("v")))
    order = [F.col("id").asc_nulls_last(), "v"]
    first = given.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).limit(1).collect()
    if not first:
        return None, None
    width = len(first[0].v)
    kept = given.where(fits(F.col("v"), width)).select("id", "v", integers(F.col("v")).alias("q"))
    start = [r.q for r in kept.orderBy(*order).limit(size).collect()]
    if not start:
        return None, None
    books = Codebooks(np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = refine(kept, books)
    return books, width


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: id_col, code (two hex digits for each part), error (squared distances to the code's entries, summed),
    label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped. Null and repeated ids pass through, a row
    each. A kept row whose vector has another length than the table's (see learn), or a component of 65536 or more in size,
    has null code and error and takes no part in the codebooks; where all labels' rows are such, label_error is null.
    An empty table gives no rows. Other columns are neither read nor returned.
    """
    if not 1 <= size <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    books, width = learn(vectors, parts, size, rounds, id_col, vector_col)
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    ready = given.select("id", "label", F.when(fits(F.col("v"), width), integers(F.col("v"))).alias("q"))
    if books is None:
        coded = ready.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        held = vectors.sparkSession.sparkContext.broadcast(books.entries)
        digits = np.array([f"{i:02x}" for i in range(256)])

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Codebooks(held.value)
            for batch in batches:
                there = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
                code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
                for at in range(0, len(there), CHUNK):
                    rows = there[at : at + CHUNK]
                    nearest, least = own.assign(_matrix(batch.column(2).take(pa.array(rows)), width))
                    code[rows] = ["".join(x) for x in digits[nearest]]
                    error[rows] = least.sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

        out = T.StructType([T.StructField("id", kinds[id_col]), T.StructField("label", kinds[label_col]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        coded = ready.mapInArrow(codes, out)
    coded = stage(coded, "vector-codes")
    labels = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels").withColumnRenamed("label", "of")
    joined = coded.join(small_side(labels), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books and books.sha256).cast("string").alias("codebooks_sha256"))


def compress_sql(parts: int = 16, size: int = 64, rounds: int = 2) -> str:
    """DuckDB SQL for compress() over `embeddings` whose vectors all have one length."""
    nearest = """p{n} AS (SELECT v.rn, v.part, v.q, c.entry, list_sum(list_transform(generate_series(1, len(v.q)), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d
      FROM cut v JOIN c{n} c ON v.part = c.part),
    a{n} AS (SELECT rn, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM p{n} GROUP BY rn, part)"""
    step = """m{n} AS (SELECT a.part, a.entry, s.pos, CAST(floor(sum(v.q[s.pos])::DOUBLE / count(*)) AS BIGINT) AS x
      FROM a{n} a JOIN cut v USING (rn, part), LATERAL (SELECT unnest(generate_series(1, len(v.q))) AS pos) s GROUP BY a.part, a.entry, s.pos),
    l{n} AS (SELECT part, entry, list(x ORDER BY pos) AS q FROM m{n} GROUP BY part, entry),
    c{next} AS (SELECT c.part, c.entry, coalesce(l.q, c.q) AS q FROM c{n} c LEFT JOIN l{n} l USING (part, entry))"""
    rows = f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS (SELECT rn, p.part, q[p.part * (len(q) // {parts}) + 1 : (p.part + 1) * (len(q) // {parts})] AS q FROM kept, (SELECT unnest(range({parts})) AS part) p),
    c0 AS (SELECT part, rn - 1 AS entry, q FROM cut WHERE rn <= {size})"""
    all_rounds = ",\n    ".join(f"{nearest.format(n=n)},\n    {step.format(n=n, next=n + 1)}" for n in range(rounds))
    return f"""WITH {rows},
    {all_rounds},
    {nearest.format(n=rounds)},
    coded AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
    books AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
    SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256
    FROM kept k JOIN coded c USING (rn), books b"""
