"""Search results as they arrive: hits of many sources merged in keyed state, in whatever order they come.

A search is known by its id and asked anew under a higher generation; answers to an older one change nothing. Each book is a
few values that merge in any order: the first name, author and so on by arrival, and how many offers and sources it has.
Books that a batch has changed come out with a version; latest_results() makes the rows of search.merge_search() of them.
What a search holds is dropped when nothing has come for it for a while.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import search_key
from ..operators.search import MOST_PER_SOURCE, MOST_RESULTS, search_rank

#: The first value by arrival, whatever it is, or the first that isn't blank.
FIRST, FILLED = ("name", "author"), ("kind", "intro", "lastChapter")
FIELDS = FIRST + FILLED
RESULT = "search string, generation long, book string, " + ", ".join(f"{f} string" for f in FIELDS) + ", offers long, sources long, arrival long, version long"
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def merged(book: dict, hit: dict) -> None:
    """Takes a hit into a book: the values of its fields with their arrival, the URLs of each source, the first arrival."""
    at = int(hit["arrival"])
    for f in FIELDS:
        value = hit[f] if isinstance(hit[f], str) else None
        old = book["fields"].get(f)
        if (f in FIRST or (value or "").strip()) and (old is None or (at, value or "") < (old[0], old[1] or "")):
            book["fields"][f] = [at, value]
    book["arrival"] = min(at, book.get("arrival", at))
    urls = book["offers"].setdefault(hit["source"], [])
    if (url := hit["url"] if isinstance(hit["url"], str) else "") not in urls:
        urls.append(url)


class MergeSearch(StatefulProcessor):
    """State of a search: its generation and its books. It is one value, as a search holds no more than its sources' first hits, and
    each batch reads and writes it once."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("search", "generation long, books string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current, books = None, {}
        if self.state.exists():
            current, text = self.state.get()
            books = json.loads(text)
        changed: set[str] = set()
        for frame in rows:
            for hit in frame.sort_values("generation", kind="stable").to_dict("records"):
                if current is not None and hit["generation"] < current:
                    continue  # an answer to what isn't asked any more
                if current is None or hit["generation"] > current:
                    current, books, changed = int(hit["generation"]), {}, set()
                merged(books.setdefault(hit["book"], {"fields": {}, "offers": {}, "version": 0}), hit)
                changed.add(hit["book"])
        for name in changed:
            books[name]["version"] += 1
        self.state.update((current, json.dumps(books)))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(int(time.time() * 1000) + self.keep_ms)
        out = []
        for name in sorted(changed):
            book = books[name]
            out.append((key[0], current, name, *((book["fields"].get(f) or [0, None])[1] for f in FIELDS), sum(map(len, book["offers"].values())), len(book["offers"]), book["arrival"], book["version"]))
        yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in ("generation", "offers", "sources", "arrival", "version")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def merged_stream(hits: DataFrame, per_source: int = MOST_PER_SOURCE, keep_ms: int | None = 600_000) -> DataFrame:
    """A stream of changed books (RESULT) of a stream of hits: search, generation, source, place (the hit's number in its source's
    answer, from 0), arrival, name, author, url, kind, intro, lastChapter. Of a source's answer the first per_source hits
    count. For writeStream in update mode; the session needs the RocksDB state store. What a search holds goes keep_ms after its
    last hit; None: it stays, as a run that ends with its input (availableNow) wants it, which would wait for all timers."""
    if "RocksDB" not in hits.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider, which state of this kind needs")
    rows = hits.where(F.col("place") < per_source).withColumn("book", search_key("name", "author", "url")).where("book <> ''")
    rows = rows.select("search", "generation", "book", "source", "url", "arrival", *FIELDS)
    return rows.groupBy("search").transformWithStateInPandas(MergeSearch(keep_ms), RESULT, "Update", "None" if keep_ms is None else "ProcessingTime")


def latest_results(changes: DataFrame, keyword: str, most: int | None = MOST_RESULTS) -> DataFrame:
    """(search, generation, name, author, kind, intro, lastChapter, n_candidates, n_sources, arrival, rank): the books of each
    search's last generation as they stand after all changes, the first `most` to arrive, best first."""
    newest = Window.partitionBy("search")
    rows = changes.withColumn("_g", F.max("generation").over(newest)).where("generation = _g").drop("_g")
    last = rows.groupBy("search", "generation", "book").agg(F.max_by(F.struct(*FIELDS, "offers", "sources", "arrival"), "version").alias("b")).select("search", "generation", "book", "b.*")
    if most is not None:
        last = last.withColumn("_n", F.row_number().over(Window.partitionBy("search").orderBy("arrival", "book"))).where(F.col("_n") <= most).drop("_n")
    last = last.withColumnsRenamed({"offers": "n_candidates", "sources": "n_sources"})
    return last.withColumn("rank", search_rank("name", "author", keyword)).orderBy("search", "rank", F.desc("n_candidates"), "arrival").drop("book")
