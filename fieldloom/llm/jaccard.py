"""Near copies by the Jaccard likeness of their 5-word shingles: candidates by shared numbers, an exact check for links.

Each text gives BANDS numbers, each made of ROWS minima of its shingles under random functions. Two texts of likeness s
share a number with a probability of 1 - (1 - s^ROWS)^BANDS: all but 3e-6 at 0.8. In the group of texts that share one,
all are checked with a hub. Where a group isn't connected by that, as with short texts around one long passage, its texts
go on by their rarest shingles, counted among these texts: of two sets so much alike, the rarest few of the larger one (a
share of 1 - likeness) and the rarest fewer of the smaller one (about half as many) have a shingle in common. What many
texts share is hardly ever in both, so these groups are small; they are checked with hubs, ever more of them, until each is
connected or all that can be hubs have been. So no pair is left out, and a passage that many documents share makes no
square.

A check first compares the texts' minima (MARGIN below the wanted likeness, 6 standard errors, rules a pair out), then
their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .shared import pieces, release, small_batches, small_side, stage

WORDS, SEED = 5, 43
BANDS, ROWS = 24, 4
#: How far below the wanted share of equal minima a pair is still checked on its whole sets. Among BANDS * ROWS minima the
#: share's standard error is 0.04 at 0.8.
MARGIN = 0.25
#: Shingles whose values under all functions are in memory at once.
_CHUNK = 4096
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 64, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(narrow: np.ndarray) -> np.ndarray:
    """The set, sorted, of 5-word shingles as 64-bit hashes, of the 3-word shingles in order. A text of fewer than 5 words
    is one shingle. A 5-word shingle is its first and its last 3 words."""
    if len(narrow) <= WORDS - simhash.SHINGLE:
        return np.array([xxhash.xxh64_intdigest(narrow.tobytes(), SEED)] if len(narrow) else [], np.uint64)
    first, last = narrow[: simhash.SHINGLE - WORDS], narrow[WORDS - simhash.SHINGLE :]
    return np.unique(_mixed(first * np.uint64(0xC2B2AE3D27D4EB4F) + _mixed(last)))


def minima(found: np.ndarray) -> np.ndarray:
    """The least values of a set of shingles, which isn't empty, under BANDS * ROWS functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _CHUNK):
        values = found[i : i + _CHUNK, None] * _FACTORS[None, :, 0] + _FACTORS[None, :, 1]
        np.minimum(least, values.min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """BANDS numbers of a set's minima."""
    least, out = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + _mixed(least[:, k]))
    return out


def signature(least: np.ndarray) -> bytes:
    """Two bytes of each of the minima, which are equal where they are (and once in 65536 times where they aren't)."""
    return (_mixed(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def sketches(rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """Per row: row_col, the fingerprint fp, n shingles in the set, the set's bands and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints, counts, numbers, signs = [], [], [], []
            for text in batch.column(1):
                narrow = simhash.shingle_hashes(text.as_py())
                wide = shingles(narrow)
                least = minima(wide) if len(wide) else None
                prints.append(simhash.majority(narrow))
                counts.append(len(wide))
                numbers.append(wide if least is None else bands(least))
                signs.append(b"" if least is None else signature(least))
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array(counts, pa.int32()), _lists(numbers), pa.array(signs, pa.binary())], names=[row_col, "fp", "n", "bands", "sign"])

    return small_batches(rows).select(row_col, text_col).mapInArrow(run, f"`{row_col}` long, fp long, n int, bands array<long>, sign binary")


def shingle_sets(rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """Per row: row_col and its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i in range(0, len(batch), 100):
                part = batch.slice(i, 100)
                found = [shingles(simhash.shingle_hashes(text.as_py())) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(found)], names=[row_col, "shingles"])

    return small_batches(rows).select(row_col, text_col).mapInArrow(run, f"`{row_col}` long, shingles array<long>")


def _asked(pairs: DataFrame, row_col: str) -> DataFrame:
    return stage(pairs.select(F.col("first").alias(row_col)).union(pairs.select("second")).distinct(), "near-asked")


def likely(pairs: DataFrame, prints: DataFrame, similarity: float, row_col: str) -> DataFrame:
    """The pairs (first, second, a, b) whose minima agree often enough for sets that are so much alike."""
    least = int((similarity - MARGIN) * BANDS * ROWS)
    signs = stage(prints.join(small_side(_asked(pairs, row_col)), row_col, "left_semi").select(row_col, "sign"), "near-signs")
    side = lambda name: signs.select(F.col(row_col).alias(name), F.col("sign").alias(f"of_{name}")).hint("merge")
    both = pairs.join(side("first"), "first").join(side("second"), "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in (4, 5))
            yield batch.select(["first", "second", "a", "b"]).filter(pa.array((x == y).sum(1) >= least))
        release()

    return both.select("first", "second", "a", "b", "of_first", "of_second").mapInArrow(run, "first long, second long, a long, b long")


def alike(rows: DataFrame, prints: DataFrame, pairs: DataFrame, similarity: float, row_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) of fingerprints of the pairs (first, second, a, b) whose sets are at least that much alike."""
    pairs = stage(likely(pairs, prints, similarity, row_col), "near-pairs")
    sets = stage(shingle_sets(rows.join(small_side(_asked(pairs, row_col)), row_col, "left_semi"), row_col, text_col), "shingle-sets")
    side = lambda name: sets.select(F.col(row_col).alias(name), F.col("shingles").alias(f"of_{name}")).hint("merge")
    both = F.size(F.array_intersect("of_first", "of_second"))
    found = pairs.join(side("first"), "first").join(side("second"), "second").withColumn("both", both)
    either = F.size("of_first") + F.size("of_second") - F.col("both")
    return stage(found.where(F.col("both") / either >= similarity).select("a", "b").distinct(), "near-links")


def composed(moves: DataFrame | None, joined: DataFrame) -> DataFrame:
    """Moves of labels (label, to) after one more step (label, to): labels that moved before follow where theirs went. A label
    that has moved is nobody's any more, so no label is in both."""
    if moves is None:
        return joined
    after = joined.select(F.col("label").alias("to"), F.col("to").alias("_on"))
    followed = moves.join(small_side(after), "to", "left").select("label", F.coalesce("_on", "to").alias("to"))
    return stage(followed.unionByName(joined), "near-moves")


def connect(members: DataFrame, rows: DataFrame, prints: DataFrame, similarity: float, row_col: str, text_col: str, rounds: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Where labels go (label, to; None: nowhere) when the texts of each group that are so much alike are linked, and what of
    members (group, row, label, fp, n, first, rest) is in a group that isn't connected and hasn't been asked. Of a pair the
    smaller text, or either of equal ones, is `first`: only those are hubs, and a hub asks the larger texts, and the smaller
    ones that are first. rest is the most that a text may share with others of its group.

    Sets that are so much alike have sizes that differ by no more: a group's texts meet in neighbouring size classes. A text
    is a hub in the round in which the expected number of hubs first exceeds a number that its hash gives it; that number
    is 1 at first (a text with the group's least fingerprint is a hub too) and grows fourfold. Between rounds texts are known
    by the labels of what they are connected with, and only labels that have moved are written again."""
    size_class = F.floor(F.log("n") / F.lit(-math.log(similarity)))
    own = ["row", "label", "fp", "n", "first", "rest"]
    members = members.select(*own, "group", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    members = members.select(*own, F.xxhash64("group", "class").alias("group"))
    hub = F.min(F.when(F.col("first"), F.struct("fp", "row")))["row"].alias("hub")
    groups = members.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most"), hub, F.count_if("first").alias("size")).where("least <> most AND size > 0").drop("least", "most")
    turn = F.when(~F.col("first"), F.lit(math.inf)).when(F.col("row") == F.col("hub"), 0.0).otherwise(F.shiftrightunsigned(F.xxhash64("row", "group"), 11) / F.lit(float(1 << 53)) * F.col("size"))
    members = members.join(stage(groups, "near-groups").hint("merge"), "group").select("group", *own, turn.alias("turn"))
    members, moves = stage(members, "near-members"), None
    wanted, done = 1.0, 0
    share = similarity / (1 + similarity)  # of both sizes: what two texts that are so much alike have in common at least
    while True:
        # groups in which something isn't connected yet
        apart = members.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("first").alias("some")).where("x <> y AND some").select("group")
        members = stage(members.join(small_side(stage(apart, "near-apart")), "group"), "near-members")
        if done == rounds or not members.limit(1).count():
            return moves, members.select("group", *own)
        hubs = members.where(F.col("turn") <= wanted).select("group", F.col("row").alias("second"), F.col("n").alias("m"), F.col("label").alias("b"), F.col("turn").alias("at"), F.col("rest").alias("left"))
        fits = (F.least("n", "m") >= F.greatest("n", "m") * similarity) & (F.col("first") | (F.col("n") >= F.col("m"))) & (F.least("rest", "left") >= (F.col("n") + F.col("m")) * F.lit(share) - 1e-9)
        # of two hubs of a round one asks the other; those of earlier rounds have asked all
        asks = (F.col("turn") > F.col("at")) | (F.col("turn") == F.col("at")) & (F.col("row") > F.col("second"))
        pairs = members.withColumnRenamed("label", "a").join(hubs.hint("merge"), "group").where((F.col("a") != F.col("b")) & asks & fits)
        turned = F.col("row") > F.col("second")
        pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
        pairs = stage(pairs.select(pick("row", "second", "first"), pick("second", "row", "second"), pick("a", "b", "a"), pick("b", "a", "b")).distinct(), "near-candidates")
        members = members.where(F.col("turn") > wanted)
        if pairs.limit(1).count():
            new = alike(rows, prints, pairs, similarity, row_col, text_col)
            if new.limit(1).count():
                ends = new.select(F.col("a").alias("fp")).union(new.select("b")).distinct()
                joined = simhash.components(new, ends.withColumn("node", F.col("fp"))).select(F.col("fp").alias("label"), F.col("label").alias("to")).where("label <> to")
                joined = stage(joined, "near-moved")
                moves = composed(moves, joined)
                members = members.join(small_side(joined), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        wanted, done = 4 * wanted, done + 1


def moved(names: DataFrame, moves: DataFrame | None) -> DataFrame:
    """names (fp, label) after the moves of labels."""
    if moves is None:
        return names
    return stage(names.join(small_side(moves), "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "near-names")


def rarest(rows: DataFrame, asked: DataFrame, similarity: float, row_col: str, text_col: str) -> DataFrame:
    """(group, row, first, rest): for each asked row (row) its rarest shingles, as groups, of which it must share one with any asked
    row that is so much alike, where one of the two, the smaller, has it `first`; groups that can have no pair are left out.
    rest: how many shingles the row has from this one on, in the order of all. Where this is the rarest that two rows share,
    they share no more than that.

    Sets x, y of likeness t with |x| <= |y| share at least t |y| and at least 2 t / (1 + t) |x| shingles. So the rarest of all
    that they share is among the |y| - t |y| + 1 rarest of y and the |x| - 2 t / (1 + t) |x| + 1 rarest of x, rounded down."""
    sets = stage(shingle_sets(rows.join(small_side(asked.withColumnRenamed("row", row_col)), row_col, "left_semi"), row_col, text_col), "rare-sets")
    every = sets.select(F.col(row_col).alias("row"), F.size("shingles").alias("n"), F.explode("shingles").alias("group"))
    shared = stage(every.groupBy("group").agg(F.count("*").alias("f")).where("f > 1"), "rare-counts")
    found = every.join(shared.hint("merge"), "group")
    place = F.row_number().over(Window.partitionBy("row").orderBy("f", "group"))  # of one text's shingles
    found = found.withColumn("place", place + F.col("n") - F.count("*").over(Window.partitionBy("row")))
    rarest_of = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1
    found = found.where(F.col("place") <= rarest_of(similarity)).select("group", "row", (F.col("place") <= rarest_of(2 * similarity / (1 + similarity))).alias("first"), (F.col("n") - F.col("place") + 1).alias("rest"))
    found = stage(found, "rare-places")
    of_use = found.groupBy("group").agg(F.max("first").alias("some"), F.count("*").alias("f")).where("some AND f > 1").select("group")
    return found.join(of_use.hint("merge"), "group")


def labels(rows: DataFrame, prints: DataFrame, known: DataFrame, similarity: float, row_col: str, text_col: str) -> DataFrame:
    """(fp, label): the least fingerprint that each is connected with by the known edges (a, b) of fingerprints and by all
    pairs of texts that are at least that much alike. prints is the staged result of sketches(); texts with one fingerprint
    count as linked."""
    nodes = prints.select("fp").distinct()
    found = simhash.components(known, nodes.withColumn("node", F.col("fp")))
    names = stage(nodes.join(small_side(found), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "near-names")
    known_as = prints.where("n > 0").join(small_side(names), "fp")
    members = known_as.select(F.col(row_col).alias("row"), "label", "fp", "n", F.explode("bands").alias("group"), F.lit(True).alias("first"), F.col("n").alias("rest"))
    groups = members.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("group")
    members = stage(members.join(stage(groups, "bands").hint("merge"), "group"), "band-members")
    moves, rest = connect(members, rows, prints, similarity, row_col, text_col, rounds=1)
    names = moved(names, moves)
    asked = stage(rest.select("row").distinct(), "near-rest")
    if asked.limit(1).count():
        known_as = prints.join(small_side(asked), prints[row_col] == asked["row"]).select("row", "fp", "n").join(small_side(names), "fp")
        members = stage(rarest(rows, asked, similarity, row_col, text_col).join(known_as, "row"), "rare-members")
        moves, _ = connect(members, rows, prints, similarity, row_col, text_col)
        names = moved(names, moves)
    return names
