import random
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import search
from fieldloom.streaming import history
from fieldloom.streaming import search as streamed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_windows_and_duplicates(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:01:00", 2.0), (1, 7, "2024-01-01 00:01:00", 2.0), (2, 7, "2024-01-01 00:30:00", 3.0), (3, 8, "2024-01-01 05:00:00", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, t string, value double").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    out = history.windowed_history(history.deduplicated(stream), delay=None)
    q = out.writeStream.format("memory").queryName("hist").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.user_id, r.n, r.total) for r in spark.table("hist").collect()] == [(7, 2, 5.0)]


def test_sessions_end_after_a_gap(spark):
    rows = [(7, "00:00"), (7, "00:20"), (7, "00:45"), (7, "02:00"), (8, "00:10")]
    events = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t", F.lit(":00"))).alias("ts"))
    found = sorted((r.user_id, str(r.session_start)[11:16], str(r.session_end)[11:16], r.n) for r in history.reading_sessions(events).collect())
    assert found == [(7, "00:00", "01:15", 3), (7, "02:00", "02:30", 1), (8, "00:10", "00:40", 1)]


HIT = "search string, generation long, source string, place int, arrival long, name string, author string, url string, kind string, intro string, lastChapter string"


def hits_of(rng, name, generation, n):
    rows = []
    for source in range(6):
        for place in range(n):
            rows.append((name, generation, f"s{source}", place, 1000 * source + place, rng.choice(["A b", " a B", "c", "D", ""]), rng.choice(["x", "X ", "y"]), rng.choice(["u1", "u2", "u3"]), rng.choice(["", " ", None, "k1", "k2"]), rng.choice([None, f"i{place}"]), None))
    return rows


def expected_of(spark, rows, generation, most):
    df = spark.createDataFrame([r for r in rows if r[1] == generation], HIT)
    capped = search.cap_per_source(df, most, order="place")
    merged = search.merge_search(capped, "a b", candidates=False).collect()
    return sorted((r.name, r.author, r.kind or "", r.intro or "", r.n_candidates, len(r.source_names), r.arrival, r["rank"]) for r in merged)


def test_results_in_any_order(spark, tmp_path):
    """Batches in any order end in the rows of merge_search(); answers of an older generation change nothing, whenever they come."""
    before, width = spark.conf.get(PROVIDER), spark.conf.get("spark.sql.shuffle.partitions")
    schema = spark.createDataFrame([], HIT).schema
    with pytest.raises(ValueError, match="RocksDB"):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        streamed.merged_stream(spark.createDataFrame([], HIT))
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # each of them starts a worker for each batch
    try:
        rng = random.Random(4)
        one, two = hits_of(rng, "q", 1, 12) + hits_of(rng, "q", 2, 12), hits_of(rng, "other", 1, 5)
        rows = one + two
        rng.shuffle(rows)
        rows.sort(key=lambda r: (r[1] == 2) * rng.random() < 0.3)  # some of the old generation come first, the others in between and last
        for k in range(3):
            spark.createDataFrame(rows[k::3], HIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = streamed.merged_stream(stream, per_source=10, keep_ms=None).writeStream.format("memory").queryName("found").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        changes = spark.table("found")
        assert changes.select("version").distinct().count() > 1
        found = streamed.latest_results(changes, "a b").collect()
        of = lambda name: sorted((r.name, r.author, r.kind or "", r.intro or "", r.n_candidates, r.n_sources, r.arrival, r["rank"]) for r in found if r.search == name)
        assert of("q") == expected_of(spark, one, 2, 10) and of("other") == expected_of(spark, two, 1, 10)
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_what_a_search_holds_expires(spark, tmp_path):
    before, width = spark.conf.get(PROVIDER), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        hit = lambda generation, source: spark.createDataFrame([("q", generation, source, 0, 1, "n", "a", "u", None, None, None)], HIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        hit(5, "s1")
        stream = spark.readStream.schema(spark.createDataFrame([], HIT).schema).parquet(str(tmp_path / "in"))
        run = lambda: streamed.merged_stream(stream, keep_ms=1500).writeStream.format("memory").queryName(f"kept{time.time_ns()}").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        q = run()

        def wait_for(n):
            end = time.time() + 90
            while spark.table(q.name).count() < n and time.time() < end and q.isActive:
                time.sleep(0.5)

        try:
            wait_for(1)
            time.sleep(8)  # nothing comes: the timer runs out
            hit(3, "s2")  # an old generation, of which nothing is known any more
            wait_for(2)
            rows = spark.table(q.name).orderBy("generation").collect()
        finally:
            q.stop()
        assert [(r.generation, r.offers, r.version) for r in rows] == [(3, 1, 1), (5, 1, 1)]
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.set("spark.sql.shuffle.partitions", width)
