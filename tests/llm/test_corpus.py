import bisect
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language_id, mixing, sharding, warc


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


PAGES = "page_id long, url string, html string, digest string, size string, kind string, range string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>é</p>" * 200, "y" * 1000
    rows = [(1, "http://www.B.example:80/x?q=1#f", big), (4, "https://a.example/ü p", big), (2, None, None), (3, "http://b.example/x", other), (7, "x", "z" * 999), (8, "x", "z" * 999), (None, "http://c/", big), (9, "http://b.example/\r\nx", "a\r\n\r\nWARC/1.1\r\n"), (3, "http://b.example/x", other), (5, "http://b.example/x", "")]
    return spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], PAGES)


def test_warc_round_trip(spark, pages):
    rows = warc.capture_histories(pages).collect()
    texts = [(r.page_id, r.html or "") for r in pages.collect()]
    first = defaultdict(lambda: -1)
    for i, h in texts:
        if len(h.encode()) >= 1000:
            first[h] = max(first[h], -1 if i is None else i)
    expected = sorted((-1 if i is None else i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", first[h]) if len(h.encode()) >= 1000 and i != first[h] else ("response", None))) for i, h in texts)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected
    rows.sort(key=lambda r: (r.range, r.place))
    order = [(r.url_key, r.timestamp) for r in rows]
    assert order == sorted(order) and [r.position for r in rows] == list(range(len(rows)))
    assert warc.url_key("http://www.B.example:80/x?q=1#f") == "example,b)/x?q=1"


def test_offsets_of_the_index(spark, pages, tmp_path):
    """An index entry's archive and offset lead to its record; archives end after so many bytes."""
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages.repartition(1), path, archive_bytes=500)
    files = {f.path.rpartition("/")[2]: bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()}
    assert len(files) > 3
    for r in warc.read_captures(spark, path).where("record_type = 'response'").collect():
        payload = warc.payload_at(files[r.archive], r.offset)
        assert (hashlib.sha1(payload).hexdigest(), len(payload)) == (r.payload_digest, r.payload_bytes)


def test_long_payloads(monkeypatch):
    """A record of several members is read in chunks; what is held at once stays far below its size."""
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    body = b"a<p>b" * (40 << 20)  # 200 MB
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    data = warc.gzip_members(head + body + b"\r\n\r\n") * 2
    assert data[-1] == 0
    digest, size = hashlib.sha1(body).hexdigest(), len(body)
    del body
    tracemalloc.start()
    for offset, headers, block in warc.records(warc.members(data)):
        seen, length = hashlib.sha1(), 0
        for part in block:
            seen.update(part)
            length += len(part)
        assert (seen.hexdigest(), length, offset) in ((digest, size, 0), (digest, size, len(data) // 2))
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_hot_payload(spark):
    """A payload that most pages share, some of them without an id or with the same id and another URL."""
    rows = [(None if i % 50 == 0 else i % 700, f"http://h/{i}", "hot" * 400 if i % 3 else f"{i} " * 300) for i in range(2000)]
    out = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 2000
    hot = [r for r in out if r.payload_digest == hashlib.sha1(b"hot" * 400).hexdigest()]
    largest = max(r.page_id for r in hot if r.page_id is not None)
    assert all((r.record_type, r.refers_to) == (("response", None) if r.page_id == largest else ("revisit", largest)) for r in hot)


def test_warc_of_nothing(spark, pages):
    assert warc.capture_histories(pages.limit(0)).count() == 0


def sizes_of(edge):
    return sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge.collect())


def check_shards(rows, shards, slack):
    total = Counter()
    slots = defaultdict(list)
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    assert all(abs(total[k] - mean) <= slack(mean) for k in range(shards))


def test_shards_of_edges(edge):
    rows = sharding.shard(edge, shards=4).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sizes_of(edge)
    largest = max(r.size for r in rows)
    check_shards(rows, 4, lambda mean: 2 * largest)


def test_splitters_of_many_ranges(spark, monkeypatch):
    """However many ranges: the sums that reach the driver are those of the open quantiles' cells; empty texts make no large range."""
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 5)
    rows = spark.range(20_000).selectExpr("shiftrightunsigned(xxhash64(id), 4) AS hi", "shiftrightunsigned(xxhash64(id, 1), 4) AS lo", "id % 90 + 8 AS size")
    rows = rows.withColumn("hi", F.when(F.col("size") < 40, F.lit(77)).otherwise(F.col("hi")))  # a hot text
    total, counted, quantiles = rows.agg(F.sum("size")).first()[0], [], 4000
    wanted = [total * i / quantiles for i in range(1, quantiles)]
    splitters = sharding.find_splitters(rows, "size", wanted, [total / quantiles / 4] * len(wanted), counted)
    assert splitters == sorted(splitters) and max(counted) <= max(1 << sharding.FIRST, len(wanted) << sharding.MORE)
    keys = sorted((r.hi, r.lo, r["size"]) for r in rows.collect())
    sums = np.concatenate(([0], np.cumsum([k[2] for k in keys])))
    found = sums[[bisect.bisect_left(keys, (*s, 0)) for s in splitters]]
    assert np.abs(found - wanted).max() <= total / quantiles / 4 + 98
    docs = spark.createDataFrame([(i, "" if i % 2 else "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    check_shards(sharding.shard(docs, shards=4).collect(), 4, lambda mean: 0.004 * mean + 2 * 58)


def test_cut_groups(spark):
    """A group of equal texts is cut only at a boundary that it reaches over by more than the tolerance."""
    rows = [(i, f"text {i % 97} " + "x" * (i % 97)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    total = sum(r["size"] for r in out)
    shards, sizes = defaultdict(set), Counter()
    for r in out:
        shards[r.text_crc32].add(r.shard)
        sizes[r.text_crc32] += r["size"]
    cut = [c for c in shards if len(shards[c]) > 1]
    assert len(cut) <= 3 and all(sizes[c] > 2 * 0.002 * total / 4 for c in cut)


def test_shards_with_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(i, "the same text" if i % 3 == 0 else "x" * rng.randint(0, 300)) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).collect()
    check_shards(out, 24, lambda mean: 0.004 * mean + 2 * 308)
    again = sharding.shard(spark.createDataFrame(rows[::-1], "doc_id long, text string"), shards=24).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_shards_of_repeated_rows(spark):
    """Half the rows are one repeated id and text; or no row has an id; or all have the same: sizes stay near equal."""
    rng = random.Random(5)
    texts = ["the same text" * 8 if i % 2 else "x" * rng.randint(0, 120) for i in range(6000)]
    for ids in ([7 if i % 2 else i for i in range(6000)], [None] * 6000, [3] * 6000):
        out = sharding.shard(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5), shards=24).collect()
        assert {r.shard for r in out} == set(range(24)) and len(out) == 6000
        check_shards(out, 24, lambda mean: 0.004 * mean + 2 * 128)


def brute_targets(sizes, weights, wanted, cap):
    stopped = set()
    while True:
        rest = [s for s in sizes if s not in stopped]
        level = (wanted - cap * sum(sizes[s] for s in stopped)) / max(1e-9, sum(weights[s] for s in rest)) if rest else float("inf")
        over = {s for s in rest if level * weights[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in stopped else level * weights[s] for s in sizes}
        stopped |= over


def test_mix(spark, edge):
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 0 else " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "a", "b", "é", "Z", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = brute_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    taken = Counter()
    for r in out:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 60 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(edge).count() == edge.count()
    repeated = mixing.take_mix(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in out)


def test_take_mix_without_ids(spark):
    """Rows of null and repeated ids are taken as often as each of them is due."""
    rows = [(None if i % 2 else i % 10, f"t{i} " + "w " * (i % 40), "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    due = Counter()
    for r in mixing.mix(df.withColumn("_text", F.xxhash64("text")), carry=("_text", "text")).collect():
        due[r.text] += r.copies
    assert len(set(due.values())) > 1
    assert Counter(r.text for r in mixing.take_mix(df).collect()) == +due
    assert sorted(r.text for r in mixing.take_mix(df.repartition(5)).collect()) == sorted(r.text for r in mixing.take_mix(df).collect())


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    for name in ("in_w", "rec_w", "out_w", "out_b"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows, target = rng.integers(60, 130, (7, 5)), np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.probabilities(net.states(rows)[0].astype(np.float64))
        letters = language_id.LETTER[rows]
        return -(np.log(p[:, target, np.arange(5)]) * letters).sum() / letters.sum()

    grads = net.gradients(rows, target)
    for values, grad in zip((net.in_w, net.rec_w, net.out_w, net.out_b), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        step = 1e-2
        values[at] += step
        up = loss()
        values[at] -= 2 * step
        down = loss()
        values[at] += step
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.05)


def test_language_id(spark, edge):
    rng = random.Random(6)
    words = {"en": "the and that with this from have".split(), "de": "über größe für schön und nicht".split(), "fr": "élève être où garçon très forêt".split()}
    rows = [(i, " ".join(rng.choices(words[lang := list(words)[i % 3]], k=rng.randint(1, 80))), lang) for i in range(240)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 --- 中", None), (1003, "456 ...", "de"), (None, "the and that", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows[:240])
    assert sum(out[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1000, 1001, 1003)) and out[1002].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = language_id.keep_identified(df, 0.35)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {1000, 1001, 1003}
    assert all(r.lang is not None for r in kept.collect())
    chosen = language_id.keep_identified(df, 0.35, ("de",)).collect()
    assert {r.doc_id for r in chosen} - {1002} == {i for i in out if i != 1002 and out[i].lang_pred == "de"}
    assert {r.doc_id for r in language_id.keep_identified(df, 2.0, least_letters=0).collect()} == set()
    assert language_id.identify(edge).count() == edge.count()


@pytest.mark.parametrize("ids", ["none", "one", "repeated"])
def test_language_whatever_the_ids(spark, monkeypatch, ids):
    """All ids null, all equal, or rows that repeat: what is learned is as good, from a sample within its bound."""
    monkeypatch.setattr(language_id, "DOCS", 60)
    rng = random.Random(7)
    words = {"en": "the and that with this from have".split(), "de": "über größe für schön und nicht".split()}
    rows = [(" ".join(rng.choices(words[lang], k=rng.randint(5, 40))), lang) for lang in ("en", "de") for _ in range(600)]
    rows = rows + rows[:1] * 3000 if ids == "repeated" else rows
    number = {"none": None, "one": 10, "repeated": 10}[ids]
    df = spark.createDataFrame([(number, *r) for r in rows], "doc_id long, text string, lang string").repartition(4)
    windows = language_id.sample_windows(df, F.lit(False), "doc_id", "text", "lang")
    counts = Counter(lang for lang, _ in windows)
    assert set(counts) == {"en", "de"} and all(60 <= n <= 60 * language_id.WINDOWS for n in counts.values())
    assert windows == language_id.sample_windows(df.repartition(7), F.lit(False), "doc_id", "text", "lang")
    found = language_id.identify(df).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == dict(Counter(lang for _, lang in rows))


def test_language_without_labels(edge):
    """Nothing to learn from: every text with a letter stays."""
    rows = edge.withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.keep_identified(rows, 0.4).collect()
    assert sorted(r.text for r in kept) == sorted(r.text for r in edge.collect() if r.text and any(map(str.isalpha, r.text)))


def test_language_of_documents(spark):
    """Held-out documents of the given table, in all its languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    right = Counter(r.lang for r in rows if r.lang == r.lang_pred)
    assert len(rows) > 300 and sum(right.values()) >= 0.98 * len(rows)
    assert all(right[lang] >= 0.9 * n for lang, n in Counter(r.lang for r in rows).items())


def test_empty(none):
    assert sharding.shard(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.take_mix(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert language_id.keep_identified(none, 0.3).count() == 0
