"""Document fingerprints by an invertible Bloom lookup sketch.

A text is the set of its paragraph digests. Each digest goes into one cell in each of three subtables; a cell keeps a
count, the XOR of its digests and the XOR of their check hashes. The sketches of two versions are subtracted cell by
cell, what they share cancels, and peeling recovers the digests that differ: a cell that holds one digest gives it away,
and taking it out of its other cells frees more. If cells are left over, it is tried again with twice the cells.

A published fingerprint is a sketch large enough to be peeled whole by itself, so two fingerprints alone give the digests
of both texts, the difference and the likeness. Cells are rows, dealt by document, and only those that aren't zero exist;
a round of peeling is an aggregation in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width, small_side, stage

#: A paragraph ends at a line end, or after a sentence if the next one begins with certain letters; what is longer than
#: LONGEST characters is cut there.
PARAGRAPH_END = r"\n+|(?<=[.!?]) +(?=[A-M])"
LONGEST = 160
TABLES = 3
#: Cells of a subtable: for each digest, and besides.
PER_DIGEST, LEAST = 0.6, 4
#: Peeling steps of one attempt; each step looks at one subtable, in turn.
STEPS = 9
#: Text of neighbouring documents that is handled in one group, roughly.
GROUP_BYTES = 32 << 20
#: Digests whose sketches one task makes, roughly.
TASK_DIGESTS = 50_000
_CHECK = 9


def paragraph_digests(text: Column) -> Column:
    """The set of 64-bit digests of the paragraphs of a text."""
    short = lambda x: F.when(F.char_length(x) <= LONGEST, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0)))
    pieces = F.flatten(F.transform(F.split(text, PARAGRAPH_END), short))
    return F.array_distinct(F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK))


def _cell(key: Column, table: Column, width: Column) -> Column:
    return table * width + F.pmod(F.xxhash64(key, table), width).cast("int")


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells with the same number added up; empty ones go. What is recovered stands in cells -1 and -2."""
    out = rows.groupBy(*by, "cell").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.where("cell < 0 OR c <> 0 OR k <> 0 OR h <> 0")


def _sketch(items: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the signed digests: items has by (with width), c (the sign) and k (the digest)."""
    placed = items.withColumn("t", F.explode(F.array(*map(F.lit, range(TABLES)))))
    return _summed(placed.select(*by, "c", "k", _check(F.col("k")).alias("h"), _cell(F.col("k"), F.col("t"), F.col("width")).alias("cell")), by)


def _peel_step(cells: DataFrame, by: list[str], table: int) -> DataFrame:
    """Takes out the digests that are alone in a cell of one subtable. They are counted in cell -1 (only in the first text)
    or -2; where `named`, each stays as a row of its own, with the digest in d."""
    width, key, count = F.col("width"), F.col("k"), F.col("c")
    alone = (F.col("cell") >= 0) & (F.floor(F.col("cell") / width) == table) & (F.abs(count) == 1) & (F.col("h") == _check(key))
    row = lambda d, cell, c: F.struct(d.cast("long").alias("d"), cell.cast("int").alias("cell"), c.cast("int").alias("c"), key.alias("k"), F.col("h").alias("h"))
    others = [row(F.lit(None), _cell(key, F.lit(t), width), -count) for t in range(TABLES) if t != table]
    found = row(F.when(F.col("named"), key), F.when(count > 0, -1).otherwise(-2), F.lit(1))
    out = cells.select(*by, F.explode(F.when(alone, F.array(*others, found)).otherwise(F.array(row(F.col("d"), F.col("cell"), count)))).alias("x"))
    return _summed(out.select(*by, "x.*"), [*by, "d"])


def _width(size: Column, factor: float) -> Column:
    return (F.ceil(size * F.lit(factor)) + LEAST).cast("int")


def reconcile(pairs: DataFrame, factor: float = PER_DIGEST) -> DataFrame:
    """(pair, kind, width, attempt, only_first, only_second, first_digests, second_digests): how many digests are in one of two sets only,
    and which, by subtracting and peeling sketches.

    pairs has pair and kind (a key of integers), named (whether the digests are wanted, not only their numbers), first
    and second (arrays of distinct digests); it is best dealt by pair. Pairs of equal sets give no row. width is that of the sketch that could be peeled.
    Attempts go on, each with twice the cells, until every pair is recovered whole: two digests that share all their cells
    at one width are told apart at a larger one."""
    by, done, attempt = ["pair", "kind", "named", "width"], None, 0
    while True:
        signed = lambda c, sign: F.transform(c, lambda k: F.struct(F.lit(sign).alias("c"), k.alias("k")))
        items = pairs.select("pair", "kind", "named", _width(F.size("first") + F.size("second"), factor).alias("width"), F.explode(F.concat(signed("first", 1), signed("second", -1))).alias("x"))
        left = _sketch(items.select(*by, "x.*"), by).withColumn("d", F.lit(None).cast("long"))
        for step in range(STEPS):
            left = _peel_step(left, by, step % TABLES)
        count = lambda cell: F.coalesce(F.sum(F.when(F.col("cell") == cell, F.col("c"))), F.lit(0))
        list_of = lambda cell: F.array_sort(F.collect_list(F.when(F.col("cell") == cell, F.col("d"))))
        counts = [count(-1).alias("only_first"), count(-2).alias("only_second"), list_of(-1).alias("first_digests"), list_of(-2).alias("second_digests"), F.count_if(F.col("cell") >= 0).alias("open")]
        result = stage(left.groupBy("pair", "kind", "width").agg(*counts), "peeled")
        whole = result.where("open = 0").drop("open").withColumn("attempt", F.lit(attempt))
        done = whole if done is None else done.unionByName(whole)
        failed = result.where("open > 0").select("pair", "kind")
        if not failed.limit(1).count():
            return done
        pairs, factor = stage(pairs.join(failed, ["pair", "kind"], "left_semi"), "unpeeled"), factor * 2
        attempt += 1


def published(sets: DataFrame) -> DataFrame:
    """(pair, cells): of each set (pair, kind, width, first) the cells of its sketch, in hex and in order, for kind 0 and 1."""
    by = ["pair", "kind", "width"]
    cells = _sketch(sets.select(*by, F.lit(1).alias("c"), F.explode("first").alias("k")), by)
    text = F.concat(F.lpad(F.hex("cell"), 6, "0"), F.lpad(F.hex("c"), 4, "0"), F.lpad(F.hex("k"), 16, "0"), F.right(F.lpad(F.hex("h"), 16, "0"), F.lit(8)))
    of = lambda n: F.concat_ws("-", F.max(F.when(F.col("kind") == n, F.hex("width"))), F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == n, text))), ""))
    return cells.groupBy("pair").agg(of(0).alias("own_cells"), of(1).alias("edited_cells"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and digests of each row, and text and digests of the row that follows it by id (after the last: the first).

    Rows are dealt into groups, ranges of (id, hash of the text) of some GROUP_BYTES; the first row of a group is also put
    at the end of the group before, so each group finds its rows' successors by itself. Groups begin where a range
    partitioning of keys alone has its partitions begin; those first keys, one for a group, are a one-row table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(shuffle_width(docs.sparkSession), -(-total // GROUP_BYTES))
    key = F.struct("none", "id", "h")
    ranged = rows.select("none", "id", "h").repartitionByRange(groups, "none", "id", "h")
    firsts = stage(ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first")), "first-keys")
    count = firsts.count()
    side = max(1, int(count**0.5))
    table = stage(firsts.agg(F.array_sort(F.collect_list("first")).alias("keys")).select("keys", F.filter("keys", lambda x, i: i % side == 0).alias("outer")), "group-keys")
    # the table reaches each row as a column first: lambdas take no subqueries
    rows = rows.withColumns({"key": key, "keys": table.select("keys").scalar(), "outer": table.select("outer").scalar()})
    keys, outer = F.col("keys"), F.col("outer")
    below = lambda xs: F.size(F.filter(xs, lambda e: e <= F.col("key")))
    # two steps of looking up, as there may be many groups
    rows = rows.withColumn("block", F.greatest(F.lit(1), below(outer)))
    rows = rows.withColumn("group", (F.col("block") - 1) * side + F.greatest(F.lit(1), below(F.slice(keys, (F.col("block") - 1) * side + 1, F.lit(side)))) - 1)
    is_first = F.get(keys, F.col("group")) == F.col("key")
    real, ghost = F.struct(F.col("group").alias("group"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("group") - 1, F.lit(max(1, count))).alias("group"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("at", F.explode(F.when(is_first, F.array(real, ghost)).otherwise(F.array(real)))).select("at.group", "at.ghost", "none", "id", "h", "text")
    own = Window.partitionBy("group").orderBy("ghost", "none", "id", "h")
    rows = rows.repartitionById(groups, F.col("group").cast("int")).withColumn("own", paragraph_digests(F.col("text")))
    rows = rows.withColumns({"next_text": F.lead("text").over(own), "next": F.lead("own").over(own)})
    return rows.where("ghost = 0").select("id", "text", "own", "next_text", "next")


def likeness(own: str, other: str, only_own: str) -> Column:
    """Twice the shared digests over those of the one and those of the other; 1 for two empty sets."""
    total = F.col(own) + F.col(other)
    return F.when(total == 0, 1.0).otherwise(2 * (F.col(own) - F.coalesce(only_own, F.lit(0))) / total)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lost and gained.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the text with
    the next id; after the last comes the first. A fingerprint is a hash of the text, the sketch's width and its cells
    (number, count, XOR of digests, low half of the XOR of check hashes). lost and gained are the digests that the edit
    took away and brought, as peeled from the difference. A null text is empty. Rows that repeat an id follow each other
    in the order of a hash of the text; rows without an id come last. No rows give no rows; other columns are neither read
    nor returned.
    """
    id_type = docs.schema[id_col].dataType
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs, id_col, text_col).withColumn("edit", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    made = pairs.select(
        F.monotonically_increasing_id().alias("pair"), F.col("id"), n.cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), F.xxhash64("text").alias("sum"), F.xxhash64("edit").alias("edited_sum"), "own", paragraph_digests(F.col("edit")).alias("edited"), "next"
    )
    made = stage(made.withColumns({"n_own": F.size("own"), "n_edited": F.size("edited"), "n_next": F.size("next")}), "digests")
    width = max(shuffle_width(docs.sparkSession), -(-(made.agg(F.sum("n_own")).first()[0] or 0) // TASK_DIGESTS))
    none = F.array().cast("array<long>")
    # the two published sketches, and what they are compared with
    kind = lambda n, first, second: F.struct(F.lit(n).alias("kind"), F.lit(n == 2).alias("named"), F.col(first).alias("first"), (none if second is None else F.col(second)).alias("second"))
    dealt = made.select("pair", "own", "edited", "next").repartition(width, "pair")
    sets = dealt.select("pair", F.explode(F.array(kind(0, "own", None), kind(1, "edited", None), kind(2, "own", "edited"), kind(3, "own", "next"))).alias("x")).select("pair", "x.*")
    peeled = reconcile(sets)
    # sketches that had to be larger than others of their size: few
    larger = peeled.where("kind < 2").groupBy("pair").agg(F.max(F.when(F.col("kind") == 0, F.col("width"))).alias("w0"), F.max(F.when(F.col("kind") == 1, F.col("width"))).alias("w1"), F.max("attempt").alias("a"))
    larger = stage(larger.where("a > 0").drop("a"), "larger-sketches")
    wide = made.select("pair", "own", "edited", "n_own", "n_edited").repartition(width, "pair").join(small_side(larger), "pair", "left")
    sketch = lambda n, c, w: F.struct(F.lit(n).alias("kind"), F.coalesce(w, _width(F.size(c), PER_DIGEST)).alias("width"), F.col(c).alias("first"))
    cells = published(wide.select("pair", F.explode(F.array(sketch(0, "own", "w0"), sketch(1, "edited", "w1"))).alias("x")).select("pair", "x.*"))
    pick = lambda n, c: F.max(F.when(F.col("kind") == n, F.col(c)))
    found = peeled.where("kind >= 2").groupBy("pair").agg(pick(2, "only_first").alias("e"), pick(3, "only_first").alias("x"), pick(2, "first_digests").alias("lost"), pick(2, "second_digests").alias("gained"))
    out = made.drop("own", "edited", "next").join(found, "pair", "left").join(cells, "pair", "left")
    hexed = lambda s, cells: F.lower(F.concat(F.lpad(F.hex(s), 16, "0"), F.lit("-"), F.coalesce(cells, F.lit(""))))
    return out.select(
        F.col("id").cast(id_type).alias(id_col), "n_chars", "edited_sha256", hexed("sum", F.col("own_cells")).alias("fingerprint"), hexed("edited_sum", F.col("edited_cells")).alias("edited_fingerprint"),
        likeness("n_own", "n_edited", "e").alias("near_edited"), likeness("n_own", "n_next", "x").alias("near_next"), F.coalesce("lost", none).alias("lost"), F.coalesce("gained", none).alias("gained")
    )
