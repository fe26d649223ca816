"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary A overlap which of a piece vocabulary B.

Both tokenizers cover the same bytes, a space and the text. The ends of the tokens of both, as sorted byte offsets, are
united (union1d); between neighbouring offsets lies an elementary interval, which has one owner in A and one in B, found by
searchsorted. An interval is thus an overlapping pair, and every pair has one interval. Ends that both share close groups;
the product of a group's sides is what a many-to-many alignment takes (expand_groups).

Neither tokenizer has a token that goes on past a solitary space between two solid characters, so a text is cut there, and
what has been found for a segment is kept for the next text: the offsets of all new segments of a batch are aligned as one
array. Where a vocabulary doesn't allow this, a segment is the whole text.

How often an id pair is linked in the corpus is summed with partial sums in every task. The counts come back to the texts
in two joins: the most frequent pairs, a counted and bounded number, are broadcast, so that hot pairs meet no shuffle, and
the many rare ones are shuffled by pair. Every pair is in one of the two.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, pieces, small_side, stage
from .token_counts import byte_symbols

#: Where neither tokenizer has a token across: a space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)").split
#: Segments that a task keeps at most (two generations of half as many each), and the longest that it keeps.
KEPT, LONGEST = 240_000, 48
#: A piece's stand-in for a space.
BLANK = "▁"

Aligned = tuple[int, int, str, bytes]
#: Two counts share a number: the second is shifted by so many bits.
HIGH = 31
LOW = (1 << HIGH) - 1


class Aligner:
    """Tokens, groups and overlaps of segments by a byte-level BPE file for tokenizers and a model for sentencepiece."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(self.a.get_vocab(True).values()) + 1)
        for token, i in self.a.get_vocab(False).items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces_of_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces_of_b)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")
        spaced = any(p.rstrip(BLANK).lstrip(BLANK).find(BLANK) >= 0 or (p.endswith(BLANK) and p.strip(BLANK)) for p in pieces_of_b)
        self.cuts = plain and not spaced
        # ids as text, with a comma behind them or with the sign that ends a group's side
        self.a_text, self.b_text = (tuple(np.array([f"{i}{sign}" for i in range(len(x))], object) for sign in signs) for x, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.kept: dict[str, Aligned | None] = {}
        self.before: dict[str, Aligned | None] = {}

    def segments(self, text: str) -> list[str]:
        """The text in pieces; each stands after a space that isn't written."""
        return CUT(text) if self.cuts else [text]

    def tokens(self, segments: Sequence[str]) -> tuple[list[str], list[int], list[int]]:
        """The segments whose tokens' bytes are theirs, and the A and B ids of all of them, one after the other."""
        plain = [s for s in segments if s and not s[0].isspace() and not s[-1].isspace()] if self.cuts else []
        if plain:  # where texts are cut they can be put together
            joined = " ".join(plain)
            a, b = self.a.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, self.b.encode(joined)
            if not self._same(joined, a, b):
                plain, a, b = [], [], []
        else:
            a, b = [], []
        there = set(plain)
        odd = [s for s in segments if s not in there]
        for s, x, y in zip(odd, self.a.encode_batch_fast([" " + s for s in odd], add_special_tokens=False), self.b.encode(odd, num_threads=1)):
            if self._same(s, x.ids, y):
                plain.append(s)
                a += x.ids
                b += y
        return plain, a, b

    def _same(self, segment: str, a: list[int], b: list[int]) -> bool:
        data = b" " + segment.encode()
        return all(b"".join(map(of.__getitem__, ids)) == data for of, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def align(self, segments: Sequence[str]) -> dict[str, Aligned | None]:
        """Each segment's (A and B tokens as one number, groups and pairs of their products as one, groups as text, links as
        packed int64 a * B's size + b in the order of places); all are aligned as one array."""
        out: dict[str, Aligned | None] = dict.fromkeys(segments)
        segments, a, b = self.tokens(segments)
        if not segments:
            return out
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_ends, b_ends)  # one for each elementary interval
        links = a[np.searchsorted(a_ends, ends)] * len(self.b_bytes) + b[np.searchsorted(b_ends, ends)]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = (np.searchsorted(x, shared) + 1 for x in (a_ends, b_ends))  # tokens up to each group's end
        products = np.cumsum(np.diff(a_to, prepend=0) * np.diff(b_to, prepend=0))
        # the groups' text: each side's ids with what stands behind them, A's before B's in each group
        signed = [np.where(np.isin(np.arange(len(x)), to - 1), of[1][x], of[0][x]) for x, to, of in ((a, a_to, self.a_text), (b, b_to, self.b_text))]
        place = np.concatenate([2 * np.searchsorted(shared, a_ends), 2 * np.searchsorted(shared, b_ends) + 1])
        text = np.concatenate(signed)[np.argsort(place, kind="stable")].tolist()
        # a segment's last token ends where it does, in A and in B
        last = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in segments), np.int64, len(segments)))
        group_to, link_to = np.searchsorted(shared, last) + 1, np.searchsorted(ends, last) + 1
        a_last, b_last = a_to[group_to - 1], b_to[group_to - 1]
        a_count, b_count, text_to = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0), a_last + b_last
        packed, g, l, t, p = links.tobytes(), 0, 0, 0, 0
        for s, n_a, n_b, g_to, l_to, t_to, p_to in zip(segments, a_count.tolist(), b_count.tolist(), group_to.tolist(), (8 * link_to).tolist(), text_to.tolist(), products[group_to - 1].tolist()):
            out[s] = (n_a + (n_b << HIGH), g_to - g + (p_to - p << HIGH), "".join(text[t:t_to])[:-1], packed[l:l_to])
            g, l, t, p = g_to, l_to, t_to, p_to
        return out

    def batch(self, texts: Sequence[str | None]) -> Iterator[Aligned | None]:
        """What align() says of whole texts; None for those without tokens."""
        cut = [self.segments(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cut))
        if len(self.kept) + len(wanted) > KEPT // 2:
            self.kept, self.before = {}, self.kept
        now = {s: self.before[s] for s in wanted if s in self.before}
        now |= {s: self.kept[s] for s in wanted if s in self.kept}
        new = [s for s in wanted if s not in now]
        for at in range(0, len(new), 5000):
            now |= self.align(new[at : at + 5000])
        room = KEPT // 2 - len(self.kept)
        self.kept |= islice(((s, x) for s, x in now.items() if len(s) <= LONGEST), room)
        for segments in cut:
            found = list(map(now.__getitem__, segments))
            if not found or None in found:
                yield None
            else:
                tokens, groups, text, links = zip(*found)
                yield sum(tokens), sum(groups), ";".join(text), b"".join(links)


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker; what it keeps serves the worker's next tasks too."""
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "groups") -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_products (pairs that the groups' products expand to), links (array of distinct
    pair: a id * size of B + b id), times (how often each), and groups (keep="groups") as `a1,a2|b1;a3|b2,b3`, or
    groups_sha256 (keep="digests").

    Texts that are null or empty, or whose joined tokens of A or B differ from a space and the text, have no tokens: zeros,
    empty arrays, and ''. Null and repeated ids pass through, a row each; an empty table gives no rows; other columns are
    neither read nor returned. Whole texts are aligned.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text_name = "groups" if keep == "groups" else "groups_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in pieces(batches):
            counts, texts, links, times = [], [], [], []
            for found in own.batch(batch.column(1).to_pylist()):
                tokens, groups, text, packed = found or (0, 0, "", b"")
                pair, n = np.unique(np.frombuffer(packed, np.int64), return_counts=True)
                counts.append((tokens & LOW, tokens >> HIGH, groups & LOW, groups >> HIGH))
                texts.append(text if keep == "groups" or not found else hashlib.sha256(text.encode()).hexdigest())
                links.append(pair)
                times.append(n)
            offsets = pa.array(np.cumsum([0, *map(len, links)]), pa.int32())
            columns = [pa.array(c, pa.int64()) for c in np.array(counts, np.int64).reshape(-1, 4).T]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.empty(0, np.int64)]), kind)) for x, kind in ((links, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.string()), *lists], names=[id_col, "n_a", "n_b", "n_groups", "n_products", text_name, "links", "times"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_products long, {text_name} string, links array<bigint>, times array<int>")


def expand_groups(aligned: DataFrame, id_col: str = "doc_id", groups: str = "groups") -> DataFrame:
    """The products of align()'s groups: id_col, group (its place), a and b, a row for each pair of a group's two sides."""
    sides = aligned.select(id_col, F.posexplode(F.split(F.when(F.col(groups) != "", F.col(groups)), ";")).alias("group", "sides"))
    side = lambda k: F.transform(F.split(F.split("sides", r"\|")[k], ","), lambda x: x.cast("int"))
    return sides.select(id_col, "group", F.explode(side(0)).alias("a"), side(1).alias("right")).select(id_col, "group", "a", F.explode("right").alias("b"))


def pair_counts(staged: DataFrame, b_size: int) -> DataFrame:
    """pair, n (its links in the corpus) and best (whether n is the highest of its b), staged."""
    counts = stage(staged.select(F.inline(F.arrays_zip("links", "times")).alias("pair", "times")).groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts").withColumn("b", F.col("pair") % b_size)
    highest = stage(counts.groupBy("b").agg(F.max("n").alias("highest")), "pair-highest")
    return stage(counts.join(small_side(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-ranks")


def frequent_from(ranks: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs are linked that often; worked out from counts by size."""
    sizes = {r.bits: r.pairs for r in ranks.groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()}
    left, cutoff = most, 64
    for bits in sorted(sizes, reverse=True):
        left -= sizes[bits]
        if left < 0:
            break
        cutoff = bits
    return 1 << min(cutoff, 62)


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links (overlapping pairs), n_best (links whose pair is the most frequent of its B
    id in the corpus, ties included), count_sum (the pair's links in the corpus, summed over links), groups_sha256, n_products.
    What align() says of nulls, empty texts, ids and columns holds."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = align(docs, a_path, b_path, id_col, text_col, "digests")
    staged = stage(aligned.withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id()), "alignments")
    ranks = pair_counts(staged, b_size)
    cutoff = frequent_from(ranks, broadcast_rows)
    frequent = F.broadcast(ranks.where(F.col("n") >= cutoff))
    links = staged.select("row", F.inline(F.arrays_zip("links", "times")).alias("pair", "times"))

    def summed(joined: DataFrame) -> DataFrame:
        best: Column = F.when(F.col("best"), F.col("times")).otherwise(0)
        return joined.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    sums = summed(links.join(frequent, "pair"))
    if not ranks.where(F.col("n") < cutoff).isEmpty():
        rare = ranks.where(F.col("n") < cutoff)
        sums = sums.unionByName(summed(links.join(F.broadcast(ranks.where(F.col("n") >= cutoff).select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair")))
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return staged.drop("links", "times").join(sums.hint("merge"), "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256", "n_products")
