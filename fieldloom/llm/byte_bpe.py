"""Byte-level BPE encoding and decoding, with pre-tokenisation over arrays of code-point classes.

A text becomes an array of code points and, by table, an array of classes. Each place stands for a transition of the
splitting automaton: "a token starts here" or "nothing changes". Such transitions compose associatively (the later
start wins), so one running maximum gives for each place the start of the run that it is in; from that follows which
apostrophes open a contraction, and then where tokens start. The slices go through a cache of merged pieces. Byte
offsets of the tokens are kept, and decoding fills a buffer by them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import Bounded, pieces, small_batches

OTHER, LETTER, NUMBER, SPACE, BLANK = 0, 1, 2, 3, 4
#: Code points with the property White_Space, but for the space itself (fixed values of Unicode).
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the splitting pattern, after the apostrophe (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, by the newest Unicode data at hand; splitting itself uses no pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for m in regex.finditer(rf"\p{{{name}}}+", points):
            table[[ord(c) for c in m[0]]] = kind
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def piece_starts(text: str) -> np.ndarray:
    """The code-point places at which the pieces of the splitting pattern start."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = class_table()[points]
    before = np.empty_like(kind)
    before[0], before[1:] = 255, kind[:-1]
    white = kind >= SPACE
    white_before = np.concatenate(([False], white[:-1]))
    after_solid = np.concatenate((~white[1:], [False]))
    # a solid character starts a piece unless it goes on with its class or has a space in front that it takes along;
    # white space starts one after a solid character, and before one, where the last of a run stands apart
    start = np.where(white, ~white_before | after_solid, (kind != before) & (before != SPACE))
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        run = np.maximum.accumulate(np.where(start, np.arange(n), 0))  # the composed transitions: where each place's run started
        quotes = quotes[run[quotes] == quotes]
        at = lambda k: points[np.minimum(quotes + k, n - 1)] * (quotes + k < n)
        one, two = at(1), at(2)
        free = np.ones(len(quotes), bool)
        for end in CONTRACTIONS:
            hit = free & (one == ord(end[0])) & ((two == ord(end[1])) if len(end) == 2 else True)
            free &= ~hit
            places = quotes[hit]
            start[places + 1] = False
            past = places + len(end) + 1
            start[past[past < n]] = True  # what follows a contraction is a piece of its own
    start[0] = True
    return np.flatnonzero(start)


class ByteBpe:
    """Encodes as tiktoken does with these ranks and no special tokens, and decodes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * size
        for piece, rank in self.ranks.items():
            self.vocabulary[rank] = piece
        lengths = np.fromiter(map(len, self.vocabulary), np.int64, size)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.packed = Bounded(self.piece)

    def piece(self, text: str) -> bytes:
        """The identifiers of one piece, as little-endian unsigned 32-bit integers."""
        data = text.encode()
        ids = [self.ranks[data]] if data in self.ranks else self.merge(data)
        return np.array(ids, "<u4").tobytes()

    def merge(self, data: bytes) -> list[int]:
        import heapq

        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: none does any more
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := left[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        starts = piece_starts(text).tolist()
        starts.append(len(text))
        packed = self.packed
        return b"".join([packed[text[a:b]] for a, b in zip(starts, starts[1:])])

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the text's bytes, and where the last ends."""
        return np.concatenate(([0], np.cumsum(self.offsets[ids + 1] - self.offsets[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, by the offsets that encoding has kept."""
        shift = np.repeat(self.offsets[ids] - offsets[:-1], np.diff(offsets))
        shift += np.arange(len(shift))
        return self.blob[shift].tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), pa.int32()))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "digests") -> DataFrame:
    """Encodes whole texts and decodes them again by the kept offsets.

    keep="digests" returns id_col, n_tokens, ids_sha256 and decoded_sha256; keep="ids" returns id_col, n_tokens, ids
    (array<int>), offsets (array<int>, one more than ids: byte places) and decoded (binary).
    A null text is empty: no tokens. Null and repeated ids pass through, a row each; no rows give no rows; other
    columns are neither read nor returned.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    digests = keep == "digests"
    extra = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, offsets array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(ranks)
        for batch in pieces(batches):
            n, a, b, c = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = coder.encode(text)
                ids = np.frombuffer(packed, "<u4").astype(np.int64)
                offsets = coder.token_offsets(ids)
                decoded = coder.decode(ids, offsets)
                n.append(len(ids))
                if digests:
                    a.append(hashlib.sha256(packed).hexdigest())
                    b.append(hashlib.sha256(decoded).hexdigest())
                else:
                    a.append(ids)
                    b.append(offsets)
                    c.append(decoded)
            if digests:
                rest = {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            else:
                rest = {"ids": _lists(a), "offsets": _lists(b), "decoded": pa.array(c, pa.binary())}
            columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64())} | rest
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, {extra}")
