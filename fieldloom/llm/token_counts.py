"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of symbols. A heap holds the adjacent pairs that have a merge rank; the
lowest rank (then the leftmost place) is popped, and the pair becomes one symbol. A word has as many tokens as
symbols at first, less one for each merge; identifiers are never looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import Bounded, pieces, small_batches


#: Below this code point (the end of Latin and combining marks) all tables agree on classes.
STABLE = "\u0370"


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in one word."""
    n = len(symbols)
    symbols = list(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if symbols[i] != a or (j := right[i]) >= n or symbols[j] != b:
            continue  # one of its sides has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        merges += 1
    return merges


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordCounter:
    """Counts tokens as the tokenizers library does for a BPE file with this shape: NFC, white space to a space, lower case; a
    splitting pattern; byte-level symbols with a word-end suffix; special strings in the text are one token each."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a word-level BPE file of the kind that this operator counts")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.seen = Bounded(self.word)
        # composition, case and classes by the library's own tables, which may be older than Python's
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.normalized = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior="removed", invert=True).pre_tokenize_str

    def word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return len(symbols) - merge_count(symbols, self.ranks)

    def plain(self, text: str) -> int:
        text = text.lower() if text.isascii() else self.normalized(text)
        words = self.words(text) if not text or max(text) < STABLE else [word for word, _ in self.split(text)]
        return sum(map(self.seen.__getitem__, words))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); null and repeated ids pass through, a row each; an empty table
    gives no rows; other columns are neither read nor returned. Whole texts are counted, of any length.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(tokenizer)
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            counts = list(map(counter.count, texts))
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
