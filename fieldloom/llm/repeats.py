"""Repeated passages across documents, by depth-limited radix sort of suffixes.

A suffix counts only through its first WINDOW bytes, its window. Windows are ordered by passes from the most significant
digit on; a group that lies in one document drops out after each pass, and the groups that are left after the last, equal
in all bytes, are exactly the repeated windows.

1. The first digit of a window is the least, by a hash, of the grams in it, and decides where the window is dealt. What
   neighbouring windows have in common is dealt once: windows with one digit go on as a run, a string of up to
   2 * WINDOW - 1 bytes. Only digits are exchanged, and those that one document has alone drop out.
2. The strings of the runs that are left are exchanged, each distinct one once for each part, and in a bucket windows
   are ordered by their bytes, eight to a digit, until WINDOW bytes are equal. Hashes only deal and rule out: equality is
   equality of bytes.

A digit with over HOT_RUNS different runs, as at the edges of a passage that very many documents share, would make one
bucket large. Its windows are dealt one by one, by a hash of their own, and ordered in the same way.

Texts are dealt once into parts of some PART_BYTES by a hash of id and text; there are as many buckets as parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, small_batches, shuffle_width

WINDOW, GRAM = 50, 20
#: Bytes of text in a part, roughly; a part is the unit of work.
PART_BYTES = 16 << 20
#: Different runs with one first digit, over all parts, from which on its windows are dealt one by one.
HOT_RUNS = 4096
#: Text that a task collects before it is packed by parts.
PACKED_BYTES = 32 << 20
#: Windows whose digits are worked out at once.
SEGMENT = 1 << 15
#: The place of rows without an id in the order of documents: after all others.
NO_ID = np.iinfo(np.int64).max

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW48 = np.uint64((1 << 48) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def first_digits(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window the least hash of the grams in it."""
    hashes, now, size, done = None, _BYTE[data], 1, 0
    while size <= gram:  # hashes of 1, 2, 4, ... bytes make up those of a gram
        if gram & size:
            tail = now[: len(data) - gram + 1] if hashes is None else now[done : done + len(data) - gram + 1]
            hashes = tail if hashes is None else hashes * np.uint64(pow(_BASE, size, 1 << 64)) + tail
            done += size
        if size * 2 <= gram:
            now = now[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + now[size:]
        size *= 2
    least, size, width = _mixed(hashes), 1, window - gram + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (width - size)], least[width - size :]) if size < width else least


def runs(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, digit) of the runs of windows with one first digit, at most `window` to a run. data holds documents one
    after the other, which end at bounds; no window crosses one."""
    first, end, digit = [], [], []
    inner = np.ones(len(data) + 1, bool)  # whether a window may start here
    for back in range(1, window):
        inner[np.maximum(bounds - back, 0)] = False
    for at in range(0, len(data) - window + 1, SEGMENT):
        part = first_digits(data[at : at + SEGMENT + window - 1], window)
        valid = inner[at : at + len(part)]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (valid[1:] != valid[:-1])))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(part))
        keep = valid[begin]
        first.append(begin[keep] + at), end.append(stop[keep] + at), digit.append(part[begin[keep]] & _LOW48)
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    first, end, digit = map(np.concatenate, (first, end, digit))
    pieces = -(-(end - first) // window)
    at = np.repeat(first, pieces) + window * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return at, np.minimum(at + window, np.repeat(end, pieces)), np.repeat(digit, pieces)


def least_of_equal(data: np.ndarray, at: np.ndarray, ids: np.ndarray, label: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window (its place in data) the least id among the windows with its label and the same bytes.

    Each pass orders what is left by eight more bytes; groups with one id drop out."""
    least, label, live = ids.copy(), label.copy(), np.arange(len(at))
    eight = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), ">u8", eight, strides=(1,))
    for depth in range(0, window, 8):
        if not len(live):
            break
        key = eight[at[live] + depth].astype(np.uint64) >> np.uint64(8 * max(0, depth + 8 - window))
        order = np.lexsort((key, label[live]))
        live, key = live[order], key[order]
        old = label[live]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        low, high = np.minimum.reduceat(ids[live], start), np.maximum.reduceat(ids[live], start)
        label[live] = group
        several = (low < high)[group]
        if depth + 8 >= window:
            least[live[several]] = low[group[several]]
        live = live[several]
    return least


def _expanded(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each count."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


# ---- packing


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    k = len(kinds)
    sizes = np.frombuffer(data, np.int64, k + 1)[1:]
    out, at = [], 8 * (k + 1)
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").ravel()


def _ids_packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each entry's number in them as two or four bytes (given as bytes)."""
    known, at = np.unique(ids, return_inverse=True)
    return known, at.astype("<u2" if len(known) <= 0xFFFF else "<u4").view(np.uint8)


def _ids_unpacked(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return known[at.view("<u2" if len(known) <= 0xFFFF else "<u4")]


def _dealt(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places of its rows, in order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
    return list(zip(b[cuts].tolist(), np.split(order, cuts[1:]))) if len(b) else []


class Strings:
    """Distinct byte strings in the order in which they first appear, and which of them each given one is."""

    def __init__(self, given: pa.Array):
        coded = given.dictionary_encode()
        self.of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary
        self.head = np.empty(len(self.values), np.int64)
        self.head[self.of[::-1]] = np.arange(len(self.of))[::-1]

    def packed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the strings at these places, and their bytes."""
        offsets, data = spread(self.values.take(pa.array(at)))
        return np.diff(offsets), data[: offsets[-1]]


def spread(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of binary that starts at its buffers' start."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(strings) + 1).astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def gathered(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """The array of binary with these lengths and bytes."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *arrays]).astype(kind, copy=False)


class Part:
    """The documents of one part, in order of id (then of text, so that the order never depends on how they came), and their runs."""

    def __init__(self, table: pa.Table):
        ids, nulls, texts = [], [], []
        expand = zstandard.ZstdDecompressor().decompress
        for blob in table.column("data").to_pylist():
            own, null, sizes, text = _unpack(expand(blob), "i8", "u1", "i8", "u1")
            ids.append(own), nulls.append(null)
            ends, text = np.cumsum(sizes).tolist(), text.tobytes()
            texts += [text[a:b] for a, b in zip([0, *ends], ends)]
        ids, nulls = np.concatenate(ids), np.concatenate(nulls)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], nulls[i], texts[i]))
        self.ids, self.nulls = ids[order], nulls[order]
        self.raw = b"".join([texts[i] for i in order])
        self.bounds = np.cumsum(np.fromiter((len(texts[i]) for i in order), np.int64, len(order)))
        self.first, self.end, self.digit = runs(np.frombuffer(self.raw, np.uint8), self.bounds)
        self.doc = np.searchsorted(self.bounds, self.first, "right")

    def strings(self, at: np.ndarray) -> Strings:
        """The strings of these runs: all bytes of their windows."""
        raw = self.raw
        return Strings(pa.array([raw[a:b] for a, b in zip(self.first[at].tolist(), (self.end[at] + WINDOW - 1).tolist())], pa.binary()))

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digit, how many different runs have it, whether several documents have it), each digit once."""
        order = np.argsort(self.digit, kind="stable")  # runs are in order of documents
        ordered, doc = self.digit[order], self.doc[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), ordered[1:] != ordered[:-1])))
        last = np.append(start[1:], len(order)) - 1
        count = last - start + 1
        if (several := np.flatnonzero(count > 1)).size:
            at = order[_expanded(start[several], count[several])]
            group = np.repeat(np.arange(len(several)), count[several])
            kept = np.unique(np.stack((group, self.strings(at).of)), axis=1)[0]
            count[several] = np.bincount(kept, minlength=len(several))
        return ordered[start], count, doc[start[: len(last)]] != doc[last] if len(last) else np.empty(0, bool)

    def told(self, replies: pa.Table) -> None:
        """From the first replies: which runs go on, as strings or, of hot digits, window by window."""
        shared, hot = [], []
        for kind, blob in zip(replies.column("kind").to_pylist(), replies.column("data").to_pylist()):
            if kind == 0:
                a, b = _unpack(blob, "u1", "u1")
                shared.append(_from_six(a)), hot.append(_from_six(b))
        is_hot = np.isin(self.digit, _joined(hot, np.uint64))
        self.at = np.flatnonzero(np.isin(self.digit, _joined(shared, np.uint64)) | is_hot)
        self.runs = self.strings(self.at)
        self.least = self.ids[self.doc[self.at[self.runs.head]]]
        #: runs that an earlier document of this part has too are repeated throughout
        self.earlier = self.least[self.runs.of] < self.ids[self.doc[self.at]]
        run_hot = is_hot[self.at[self.runs.head]]
        self.sent = np.flatnonzero(~run_hot)
        single = self.at[is_hot[self.at] & ~self.earlier]
        counts = self.end[single] - self.first[single]
        self.place = _expanded(self.first[single], counts)
        self.place_doc = np.repeat(self.doc[single], counts)
        raw = self.raw
        self.windows = Strings(pa.array([raw[p : p + WINDOW] for p in self.place.tolist()], pa.binary()))
        self.window_least = self.ids[self.place_doc[self.windows.head]]

    def deal(self, buckets: int) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
        """The strings and the windows that go to each bucket."""
        by_digit = (self.digit[self.at[self.runs.head[self.sent]]] % np.uint64(buckets)).astype(np.int64)
        _, data = spread(self.windows.values)
        rows = data[: len(self.windows.values) * WINDOW].reshape(-1, WINDOW)
        hashes = np.zeros(len(rows), np.uint64)
        for k in range(WINDOW):
            hashes = hashes * np.uint64(_BASE) + _BYTE[rows[:, k]]
        return [(b, self.sent[at]) for b, at in _dealt(by_digit)], _dealt((_mixed(hashes) % np.uint64(buckets)).astype(np.int64))

    def spans(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, begin, end) of the removed runs of bytes, maximal and in order."""
        masks = np.zeros(len(self.runs.values), np.uint64)
        repeated = np.zeros(len(self.windows.values), bool)
        sent = [dict(x) for x in self.deal(buckets)]
        for kind, bucket, blob in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            if kind == 1:
                k, mask = _unpack(blob, "u4", "u8")
                masks[sent[0][bucket][k]] = mask
            elif kind == 2:
                repeated[sent[1][bucket][_unpack(blob, "u4")[0]]] = True
        whole = self.at[self.earlier]
        some = np.flatnonzero(~self.earlier & (masks[self.runs.of] > 0))
        counts = self.end[self.at[some]] - self.first[self.at[some]]
        bit = _expanded(np.zeros(len(some), np.int64), counts)
        hit = (np.repeat(masks[self.runs.of[some]], counts) >> bit.astype(np.uint64)) & np.uint64(1) > 0
        place, owner = (np.repeat(self.first[self.at[some]], counts) + bit)[hit], np.repeat(self.doc[self.at[some]], counts)[hit]
        lone = (self.window_least[self.windows.of] < self.ids[self.place_doc]) | repeated[self.windows.of]
        doc = np.concatenate((self.doc[whole], owner, self.place_doc[lone]))
        begin = np.concatenate((self.first[whole], place, self.place[lone]))
        end = np.concatenate((self.end[whole] - 1, place, self.place[lone])) + WINDOW
        if not len(doc):
            return doc, begin, end
        order = np.argsort(begin, kind="stable")  # documents stand one after the other, so this orders them too
        doc, begin, end = doc[order], begin[order], np.maximum.accumulate(end[order])
        new = np.concatenate(([True], (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])))
        start = np.flatnonzero(new)
        return doc[start], begin[start], end[np.append(start[1:], len(doc)) - 1]


def part_count(docs: DataFrame, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-total // PART_BYTES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS, digit_bits: int = 48) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if some WINDOW bytes around it also start in a document with a smaller id. Matches never cross documents
    and are judged on the input. A null text is empty. Ids are integers. Rows that repeat an id don't remove from each
    other; rows without an id come after all others (2^63-1 counts as none in this order) and remove nothing from each
    other. No rows give no rows; other columns are neither read nor returned. digit_bits is how much of a first digit
    counts: fewer bits only mean more work.
    """
    parts = part_count(docs, text_col)
    low = np.uint64((1 << digit_bits) - 1)

    def read(table: pa.Table) -> Part:
        own = Part(table)
        own.digit = own.digit & low
        return own

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts: list[bytes] = []

        def packed() -> pa.RecordBatch:
            part, ids, nulls = (np.concatenate(x) for x in zip(*held))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            dealt = _dealt(part)
            blobs = [squeeze(_pack(ids[at], nulls[at], sizes[at], np.frombuffer(b"".join([texts[i] for i in at]), np.uint8))) for _, at in dealt]
            held.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in dealt], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])

        size = 0
        for batch in pieces(batches):
            nulls = np.array(batch.column(1).is_null().to_numpy(zero_copy_only=False), np.uint8)
            ids = batch.column(1).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), ids, nulls))
            texts += (own := [t.encode() if t else b"" for t in batch.column(2).to_pylist()])
            size += sum(map(len, own))
            if size >= PACKED_BYTES:
                yield packed()
                size = 0
        if held:
            yield packed()

    def rows(columns: dict[str, str], found: list[tuple]) -> pa.Table:
        kinds = {"int": pa.int32(), "binary": pa.binary()}
        return pa.table({n: pa.array([r[i] for r in found], kinds[k]) for i, (n, k) in enumerate(columns.items())})

    to_bucket = {"bucket": "int", "part": "int", "kind": "int", "data": "binary"}
    to_part = {"part": "int", "bucket": "int", "kind": "int", "data": "binary"}
    schema = lambda columns: ", ".join(f"{n} {k}" for n, k in columns.items())

    def send_digits(table: pa.Table) -> pa.Table:
        digit, count, several = read(table).digits()
        number, one = table.column("part")[0].as_py(), (count == 1) & ~several
        out = []
        for bucket, at in _dealt((digit % np.uint64(parts)).astype(np.int64)):
            a, b = at[one[at]], at[~one[at]]
            out.append((bucket, number, 0, _pack(_six(digit[a]), _six(digit[b]), count[b].astype("<u4"), several[b])))
        return rows(to_bucket, out)

    def compare_digits(table: pa.Table) -> pa.Table:
        digit, count, several, part = [], [], [], []
        for p, blob in zip(table.column("part").to_pylist(), table.column("data").to_pylist()):
            a, b, n, s = _unpack(blob, "u1", "u1", "<u4", "u1")
            digit += [_from_six(a), _from_six(b)]
            count += [np.ones(len(a) // 6, np.int64), n.astype(np.int64)]
            several += [np.zeros(len(a) // 6, np.uint8), s]
            part.append(np.full((len(a) + len(b)) // 6, p, np.int64))
        digit, count, several, part = map(np.concatenate, (digit, count, several, part))
        order = np.argsort(digit, kind="stable")
        digit, count, several, part = digit[order], count[order], several[order], part[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(digit)), bool), digit[1:] != digit[:-1])))
        size = np.diff(np.append(start, len(digit)))
        shared = (size > 1) | (np.maximum.reduceat(several, start) > 0) if len(digit) else np.empty(0, bool)
        hot = shared & (np.add.reduceat(count, start) > hot_runs) if len(digit) else shared
        at = np.flatnonzero(np.repeat(shared, size))
        is_hot = np.repeat(hot, size)
        return rows(to_part, [(p, -1, 0, _pack(_six(digit[own[~is_hot[own]]]), _six(digit[own[is_hot[own]]]))) for p, k in _dealt(part[at]) for own in (at[k],)])

    def send_strings(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(to_bucket, [])
        own, number, squeeze = read(table), table.column("part")[0].as_py(), zstandard.ZstdCompressor(level=1).compress
        own.told(replies)
        strings, windows = own.deal(parts)
        digit, out = own.digit[own.at[own.runs.head]], []
        for bucket, at in strings:
            lengths, data = own.runs.packed(at)
            out.append((bucket, number, 1, squeeze(_pack(_six(digit[at]), *_ids_packed(own.least[at]), (lengths - WINDOW + 1).astype(np.uint8), data))))
        for bucket, at in windows:
            out.append((bucket, number, 2, squeeze(_pack(*_ids_packed(own.window_least[at]), own.windows.packed(at)[1]))))
        return rows(to_bucket, out)

    def compare_strings(table: pa.Table) -> pa.Table:
        bucket, expand, out = table.column("bucket")[0].as_py(), zstandard.ZstdDecompressor().decompress, []
        blobs = {1: [], 2: []}
        for p, kind, blob in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "data"))):
            blobs[kind].append((p, _unpack(expand(blob), *(["u1"] if kind == 1 else []), "i8", "u1", *(["u1"] if kind == 1 else []), "u1")))
        if blobs[1]:
            out += _runs_answered(bucket, blobs[1])
        if blobs[2]:
            out += _windows_answered(bucket, blobs[2])
        return rows(to_part, out)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    id_type = docs.schema[id_col].dataType

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if table.num_rows:
            own = read(table)
            own.told(replies)
            doc, begin, end = own.spans(replies, parts)
            edges = np.searchsorted(doc, np.arange(len(own.ids) + 1)).tolist()
            begin, end, bounds, raw = begin.tolist(), end.tolist(), [0, *own.bounds.tolist()], memoryview(own.raw)
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                kept, at = hashlib.sha256(), bounds[i]
                for x, y in zip(begin[a:b], end[a:b]):
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at : bounds[i + 1]])
                found.append((None if own.nulls[i] else int(own.ids[i]), bounds[i + 1] - bounds[i], sum(end[a:b]) - sum(begin[a:b]), b - a, kept.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({n: pa.array([r[i] for r in found], k) for i, (n, k) in enumerate(zip(names, kinds))})

    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int")
    dealt = small_batches(docs).select(part.alias("part"), F.col(id_col), F.col(text_col)).mapInArrow(pack, "part int, data binary").repartitionById(parts, "part")
    to = lambda sent: sent.repartitionById(parts, "part").groupBy("part")
    digits = dealt.groupBy("part").applyInArrow(send_digits, schema(to_bucket)).repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(compare_digits, schema(to_part))
    strings = dealt.groupBy("part").cogroup(to(digits)).applyInArrow(send_strings, schema(to_bucket)).repartitionById(parts, "bucket")
    strings = strings.groupBy("bucket").applyInArrow(compare_strings, schema(to_part))
    # replies of both kinds share one exchange: a union of exchanged tables would be exchanged again, and the texts with it
    out = dealt.groupBy("part").cogroup(to(digits.unionByName(strings))).applyInArrow(remove, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn(id_col, F.col(id_col).cast(id_type))


def _runs_answered(bucket: int, blobs: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    """For each part's strings a mask of the windows that an earlier document of any part has."""
    digit = np.concatenate([_from_six(b[0]) for _, b in blobs])
    ids = np.concatenate([_ids_unpacked(b[1], b[2]) for _, b in blobs])
    counts = np.concatenate([b[3] for _, b in blobs]).astype(np.int64)
    every = Strings(gathered(counts + WINDOW - 1, np.concatenate([b[4] for _, b in blobs])))
    least = np.full(len(every.values), NO_ID)
    np.minimum.at(least, every.of, ids)
    digit, count = digit[every.head], counts[every.head]
    # windows of strings that share a digit with other strings are compared byte by byte
    _, group, size = np.unique(digit, return_inverse=True, return_counts=True)
    apart = np.flatnonzero(size[group] > 1)
    offsets, data = spread(every.values)
    place = _expanded(offsets[apart], count[apart])
    owner = np.repeat(apart, count[apart])
    hit = least_of_equal(data, place, least[owner], group[owner]) < least[owner]
    masks = np.zeros(len(count), np.uint64)
    np.bitwise_or.at(masks, owner[hit], np.uint64(1) << (place - offsets[owner])[hit].astype(np.uint64))
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    answer = np.where(ids > least[every.of], full[every.of], masks[every.of])
    out, at = [], 0
    for part, b in blobs:
        own = answer[at : at + len(b[3])]
        at += len(b[3])
        k = np.flatnonzero(own)
        if len(k):
            out.append((part, bucket, 1, _pack(k.astype("<u4"), own[k])))
    return out


def _windows_answered(bucket: int, blobs: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    """For each part's windows those that an earlier document of any part has."""
    ids = [_ids_unpacked(b[0], b[1]) for _, b in blobs]
    every, data = np.concatenate(ids), np.concatenate([b[2] for _, b in blobs])
    hit = least_of_equal(data, np.arange(len(every)) * WINDOW, every, np.zeros(len(every), np.int64)) < every
    ends = np.cumsum(list(map(len, ids)))
    found = [(part, np.flatnonzero(own)) for (part, _), own in zip(blobs, np.split(hit, ends[:-1]))]
    return [(part, bucket, 2, _pack(k.astype("<u4"))) for part, k in found if len(k)]


REPEATS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n) GROUP BY doc_id, k),
e AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS s, a AS t, z - a AS gone FROM g
      UNION ALL SELECT d.doc_id, coalesce(max(z), 1), octet_length(any_value(b)) + 1, NULL FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, octet_length(any_value(b))::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(gone) AS n_spans,
       sha256(unhex(string_agg(hex(array_slice(b, s, t - 1)), '' ORDER BY s))) AS kept_sha256
FROM d JOIN e USING (doc_id) GROUP BY doc_id
"""
