"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint becomes the vector of its segments' bit counts. The Manhattan distance of two vectors is never
more than the Hamming distance of the fingerprints, so a range join on the integer grid of vectors finds every link.
Two vectors at distance up to 2 have a grid point in common that is at distance up to 1 from both: each fingerprint is
sent to its own point and the points beside it, and only points that several fingerprints reach hold candidates. Those
are verified exactly: fingerprints differ in at most 2 bits exactly if some 64-bit value is at most one bit from both.
Both steps send a fixed number of rows per distinct fingerprint; no pairs within a group are made, however large.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, identified, lookup_side, pieces, shuffle_width, small_batches, small_side, stage, staging

SEED, SHINGLE = 42, 3
BITS, SEGMENTS = 64, 32


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of the 3-word shingles, in order, of a text in which A-Z are lower-cased; one hash for a text of fewer words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and the white space of the contract
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes; 0 of none."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of a text in which A-Z are lower-cased."""
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and fp, the fingerprint as a signed 64-bit integer. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def grid_points(fp: str, segments: int = SEGMENTS) -> Column:
    """Numbers of the fingerprint's point on the grid of bit counts, and of the points at distance 1.

    A point's number is a weighted sum of its coordinates. With fixed random weights different points seldom share one;
    where they do, there is a candidate more to verify. Many narrow segments keep chance candidates rare at any size:
    with 32 segments two random fingerprints meet with a probability of about 2e-11."""
    width = BITS // segments
    rng = random.Random(64)
    weights = [rng.randrange(1 << 50, 1 << 56) | 1 for _ in range(segments)]  # 64 bits in all: sums stay below 2^63
    mask = (1 << width) - 1
    point = " + ".join(f"bit_count(shiftrightunsigned({fp}, {width * i}) & {mask}L) * {w}L" for i, w in enumerate(weights))
    beside = ", ".join(f"{w}L, -{w}L" for w in weights)
    return F.expr(f"transform(array(0L, {beside}), d -> d + ({point}))")


def links(nodes: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Edges (a, b) that connect the fingerprints as all links of 2 or fewer bits do: each fingerprint to the least one
    that shares a 64-bit value at most one bit away from both. nodes has a row for each distinct fp."""
    # each fingerprint becomes 65 rows: few tasks would read so small a table
    nodes = nodes.repartition(4 * shuffle_width(nodes.sparkSession))
    reached = nodes.select("fp", F.explode(grid_points("fp", segments)).alias("cell"))
    shared_cells = stage(reached.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "grid-cells")
    candidates = stage(reached.join(small_side(shared_cells), "cell").select("fp").distinct(), "grid-candidates")
    flips = ", ".join(str(v - (1 << 64) if v >= 1 << 63 else v) + "L" for v in (1 << i for i in range(BITS - 1)))
    near = candidates.select("fp", F.explode(F.expr(f"transform(array(0L, {flips}, shiftleft(1L, 63)), m -> fp ^ m)")).alias("middle"))
    hubs = stage(near.groupBy("middle").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1").select("middle", "least"), "hubs")
    return near.join(small_side(hubs), "middle").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label): the least `node` value reachable from each fingerprint; nodes has fp and node.

    Each round takes the least label among a fingerprint and its neighbours, then the label of its label's fingerprint;
    rounds end when nothing changes. Every round's labels are a written table."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    touched = stage(both.select(F.col("a").alias("fp")).distinct(), "touched")
    labels = stage(nodes.join(small_side(touched), "fp").select("fp", F.col("node").alias("label"), F.col("fp").alias("root")), "labels")
    # labels only fall, so their sum stays only if all stay
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    last = total(labels)
    while True:
        # a label travels with the fingerprint that it belongs to, so that the next step can ask there
        own = F.struct("label", "root").alias("best")
        heard = both.join(small_side(labels), both["a"] == labels["fp"]).select(both["b"].alias("fp"), own)
        best = stage(heard.unionByName(labels.select("fp", own)).groupBy("fp").agg(F.min("best").alias("best")), "heard")
        jump = small_side(best).select(F.col("fp").alias("root"), F.col("best").alias("further"))
        after = best.select("fp", F.col("best.root").alias("root"), "best").join(jump, "root").select("fp", F.least("best", "further").alias("best"))
        after = stage(after.select("fp", "best.label", "best.root"), "labels")
        if (now := total(after)) == last:
            return after.select("fp", "label")
        labels, last = after, now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """Per row: id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of 2 or fewer bits.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id take part; a component
    of null ids only has a null component_id. Repeated rows fall in one component; no rows give no rows. Other columns
    are neither read nor returned.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes")
    # a component of null ids is named null at the end; until then the largest number stands for it
    named = nodes.select("fp", F.coalesce(F.col("node").cast("long"), F.lit((1 << 63) - 1)).alias("node"))
    found = components(links(nodes.select("fp"), segments), named)
    labels = nodes.join(small_side(found), "fp", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    labels = labels.withColumn("component_id", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")))
    return prints.join(small_side(stage(labels, "labels")), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, at_rest: bool = False) -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their component: exactly one row of each. at_rest: docs is
    read from Parquet files as they are (see identified()).

    Links are those of near_duplicates(), and with a similarity also those of jaccard.labels(). Rows are told apart by a
    number of their own, so repeated and null ids decide nothing for other rows; a null id comes after all ids, and
    among rows with one id the text's hash decides."""
    spark = docs.sparkSession
    rows = identified(docs, "near", at_rest)
    with staging() as own:
        prints = fingerprints(rows, "_row", text_col) if similarity is None else jaccard.sketches(rows, "_row", text_col)
        prints = stage(prints, "fingerprints")
        nodes = stage(prints.select("fp").distinct(), "nodes")
        edges = stage(links(nodes), "links")
        if similarity is None:
            found = components(edges, nodes.withColumn("node", F.col("fp")))
        else:
            found = jaccard.labels(rows, prints, edges, similarity, "_row", text_col)
        order = rows.select("_row", F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), "_row").alias("_order"))
        found = prints.select("_row", "fp").join(small_side(found), "fp", "left").select("_row", F.coalesce("label", "fp").alias("label"))
        found = stage(found.join(order.hint("merge"), "_row"), "near-labels")
        first = found.groupBy("label").agg(F.min("_order").getField("_row").alias("_first"))
        gone = stage(found.join(first, "label").where("_row <> _first").select("_row"), "near-copies")
        drop_staged(spark, set(own) - {gone.staged_at})
    return rows.join(lookup_side(gone), "_row", "left_anti").select(*docs.columns)


from . import jaccard  # noqa: E402 - it uses the fingerprints above
