"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of 2s words, and blocks start every s words, so that s + 1 words in a row always share a block; a
template of n words is looked for in blocks of the least s = 4, 8, 16, ... that is no less than n. A block meets a template
if it holds at least the template's threshold of its distinct words. The join is the usual one for set containment: all
words of templates are put in one order by how often they occur in the whole corpus, rarest first. Of a template of n
words, a of which must be there, one of the first n - a + 1 words (its prefix) must stand in the block, so only places
of such words lead to candidates; a block with fewer than a template words falls by its length, one whose remaining words
after the first common one can't make up a, by that word's positions in both. What is left is counted exactly.

Templates are a parameter, checked to be small, so their prefix index goes to the tasks, and the texts stay where they are;
only word counts are shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces

#: Bytes that end a word: ASCII but for digits and letters. A-Z are lower-cased on the way; all other bytes stay.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Template words at most, all templates taken together: the bound of what goes to each task.
MOST_WORDS = 50_000


def words_of(text: str | None) -> list[bytes]:
    """The text's words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, in UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


@dataclass(frozen=True)
class Template:
    """A label for the blocks that hold at least `threshold` of the words in `text`. A phrase must stand there as it is, word
    after word; `needs` are words without which the label isn't given, as they tell it from its kin."""

    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False
    needs: tuple[str, ...] = ()


#: The phrases that are always looked for.
BASE = (Template("cc-by", "cc by", 1.0, True), Template("gpl", "general public license", 1.0, True), Template("reserved", "all rights reserved", 1.0, True))
#: Opening words of well-known notices.
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version", 1.0),
    Template("apache-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", needs=("license", "compliance")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", needs=("redistribution",)),
    Template("cc-attribution", "This work is licensed under a Creative Commons Attribution International License", needs=("creative", "commons", "attribution")),
    Template("cc-nc", "Licensed under CC BY NC", 1.0),
    Template("gnu-notice", "This work is licensed under the GNU General Public License, version", 0.9, needs=("gnu",)),
    Template("gnu-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", needs=("gnu", "redistribute")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", needs=("fee", "granted")),
    Template("mit", "Released under the MIT License", 1.0),
    Template("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", needs=("charge", "granted")),
    Template("mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License", needs=("mozilla",)),
    Template("public-domain", "This is free and unencumbered software released into the public domain", needs=("unencumbered",)),
)


@dataclass(frozen=True)
class _Ready:
    """A template in the corpus order of words: ranks ascending, so the rarest word first."""

    at: int
    ranks: tuple[int, ...]
    least: int
    step: int
    needs: frozenset[int]
    phrase: tuple[int, ...]


class TemplateJoin:
    """Blocks of a text joined with templates; `counts` says how often each template word occurs in the corpus."""

    def __init__(self, templates: Sequence[Template], counts: dict[bytes, int]):
        vocabulary = sorted({w for t in templates for w in words_of(t.text)}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = templates
        self.prefix: dict[int, list[_Ready]] = defaultdict(list)
        for at, t in enumerate(templates):
            words = words_of(t.text)
            ranks = tuple(sorted({self.rank[w] for w in words}))
            least = max(1, math.ceil(t.threshold * len(ranks) - 1e-9))
            step = max(4, 1 << (len(words) - 1).bit_length())
            needs = frozenset(self.rank[w] for x in t.needs for w in words_of(x))
            ready = _Ready(at, ranks, least, step, needs, tuple(self.rank[w] for w in words) if t.phrase else ())
            for r in ranks[: len(ranks) - least + 1]:
                self.prefix[r].append(ready)

    def blocks(self, ranks: list[int]) -> Iterator[tuple[_Ready, int, int]]:
        """(template, block's first word, common words) of every block that meets a template. ranks: of the text's words in
        the corpus order, -1 for words of no template."""
        prefix, sets, seen = self.prefix, {}, set()
        for place, r in enumerate(ranks):
            if r in prefix:
                for t in prefix[r]:
                    for start in range(max(0, place // t.step - 1) * t.step, place + 1, t.step):
                        if (t.at, start) in seen:
                            continue
                        seen.add((t.at, start))
                        block = sets.get((t.step, start))
                        if block is None:
                            block = sets[t.step, start] = sorted({x for x in ranks[start : start + 2 * t.step] if x >= 0})
                        if len(block) < t.least:
                            continue
                        held = set(block)
                        # the first common word, and the most that can come with it
                        i = next(k for k, x in enumerate(t.ranks) if x in held)
                        if min(len(t.ranks) - i, len(block) - bisect_left(block, t.ranks[i])) < t.least:
                            continue
                        common = len(held.intersection(t.ranks))
                        if common >= t.least and t.needs <= held:
                            yield t, start, common

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, whether it is a phrase, first word, words, containment), each phrase where it stands, each other template by
        its blocks; in the order of places."""
        get = self.rank.get
        ranks = [get(w, -1) for w in words]
        found = set()
        for t, start, common in self.blocks(ranks):
            template = self.templates[t.at]
            if not t.phrase:
                found.add((start, template.label, False, min(2 * t.step, len(words) - start), common / len(t.ranks)))
                continue
            n, phrase = len(t.phrase), list(t.phrase)
            for k in range(start, min(start + 2 * t.step, len(words)) - n + 1):
                if ranks[k : k + n] == phrase:
                    found.add((k, template.label, True, n, 1.0))
        return [(label, phrase, start, n, share) for start, label, phrase, n, share in sorted(found)]


def corpus_counts(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[bytes, int]:
    """How often each template word stands in all texts."""
    wanted = {w for t in templates for w in words_of(t.text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                seen.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return {bytes(r.word): r.n for r in docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


MATCH = "array<struct<label:string,phrase:boolean,start:int,words:int,containment:double>>"


def find_licenses(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words and matches, an array of (label, phrase, start, words, containment) in the order of places:
    every place of a phrase, and every block that meets another template.

    A null text counts as empty: no words, no matches. Null and repeated ids pass through, a row each; an empty table gives
    no rows; other columns are neither read nor returned. Whole texts are read; windows never cross documents.
    """
    if sum(len(words_of(t.text)) for t in templates) > MOST_WORDS:
        raise ValueError(f"the templates hold over {MOST_WORDS} words; they go to every task")
    if empty := [t.label for t in templates if not words_of(t.text)]:
        raise ValueError(f"templates without words: {empty}")
    counts = corpus_counts(docs, templates, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())]))
    names = ["label", "phrase", "start", "words", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = TemplateJoin(templates, counts)
        for batch in pieces(batches):
            sizes, matches = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                matches.append([dict(zip(names, m)) for m in join.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(matches, kind)], names=[id_col, "n_words", "matches"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_words long, matches {MATCH}")


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_licenses() in one line a row: id_col, n_words, n_base (places of phrases), first_word and last_word (the smallest
    and largest place of a phrase, else null), base_labels, labels (distinct, sorted, joined by commas), and score, the
    highest containment of a template that was met (0: none)."""
    base = F.filter("matches", lambda m: m["phrase"])
    places = F.transform(base, lambda m: m["start"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return find_licenses(docs, templates, id_col, text_col).select(id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("matches")).alias("labels"), score.alias("score"))


def scan_sql(templates: Sequence[Template] = BASE + NOTICES) -> str:
    """DuckDB SQL for scan() over `documents`: every block against every template, without filters."""
    rows, words, needs, phrases = [], [], [], []
    for at, t in enumerate(templates):
        own = [w.decode() for w in words_of(t.text)]
        distinct = sorted(set(own))
        step = max(4, 1 << (len(own) - 1).bit_length())
        rows.append(f"({at}, '{t.label}', {str(t.phrase).lower()}, {len(distinct)}, {max(1, math.ceil(t.threshold * len(distinct) - 1e-9))}, {step})")
        words += [f"({at}, '{w}', {str(w in t.needs).lower()})" for w in distinct]
        needs.append(f"({at}, {len(t.needs)})")
        if t.phrase:
            phrases.append("SELECT rn, '{}' AS label, i - 1 AS place FROM (SELECT rn, words, unnest(range(1, len(words) - {} + 2)) AS i FROM texts) WHERE {}".format(t.label, len(own), " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(own))))
    return f"""WITH texts AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    templates(t, label, phrase, size, least, step) AS (VALUES {', '.join(rows)}),
    template_words(t, word, needed) AS (VALUES {', '.join(words)}),
    needs(t, n) AS (VALUES {', '.join(needs)}),
    tokens AS (SELECT rn, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts),
    hits AS (SELECT k.rn, k.word, w.needed, t.*, k.place // t.step - d.back AS block FROM tokens k JOIN template_words w USING (word) JOIN templates t USING (t), (VALUES (0), (1)) d(back) WHERE k.place // t.step >= d.back),
    blocks AS (SELECT rn, label, count(DISTINCT word) / any_value(size) AS share FROM hits JOIN needs USING (t) WHERE NOT phrase GROUP BY rn, t, label, block, n HAVING count(DISTINCT word) >= any_value(least) AND count(DISTINCT CASE WHEN needed THEN word END) = n),
    phrases AS ({' UNION ALL '.join(phrases)}),
    base AS (SELECT rn, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases GROUP BY rn),
    found AS (SELECT rn, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT rn, label, share FROM blocks UNION ALL SELECT rn, label, 1.0 FROM phrases) GROUP BY rn)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM texts LEFT JOIN base USING (rn) LEFT JOIN found USING (rn)"""
