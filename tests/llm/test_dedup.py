import hashlib
import random
import re
import struct
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup, fingerprints, jaccard, repeats, shared, simhash


def lowered(text):
    return (text or "").encode().lower().decode()  # of bytes: A-Z only


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("bits", [None, 1])
def test_block_names(edge, block, bits):
    rows = edge.where("doc_id IS NULL OR doc_id NOT IN (6, 7, 8)") if block == 7 else edge
    weak = {} if bits is None else {"hash_of": lambda c: F.pmod(F.xxhash64(c), F.lit(2))}
    named = exact_dedup.document_names(rows, exact_dedup.ascii_lower(F.col("text")), block_bytes=block, **weak).collect()
    by_name = defaultdict(set)
    for r in named:
        by_name[(r.level, r.name)].add(r.text_sha256)
    assert all(len(v) == 1 for v in by_name.values())
    assert len(by_name) == len({lowered(r.text) for r in rows.collect()})
    assert len(named) == rows.count()


def test_deduplicate(edge):
    rows = edge.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    found = exact_dedup.deduplicate(edge).collect()
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns and sorted(lowered(r.text) for r in left.collect()) == sorted(groups)


def test_unique_ids(edge):
    rows = edge.where("doc_id <> 16")
    assert exact_dedup.drop_copies(rows).count() == len({lowered(r.text) for r in rows.collect()})


def test_simhash(edge):
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B")
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    prints = {i: simhash.fingerprint(t) for i, t in [(r.doc_id, r.text) for r in edge.collect()] if i is not None}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))
    left = simhash.drop_near_copies(edge.where("doc_id NOT IN (16, 17)"))
    assert {r.doc_id for r in left.collect()} == {find(i) for i in prints if i not in (16, 17)}


def test_links_of_families(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    x = rng.getrandbits(64)
    for i in range(20):  # a chain
        x ^= 3 << (2 * i)
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, node long")
    found = {r.fp: r.label for r in simhash.components(simhash.links(nodes.select("fp")), nodes).collect()}
    label = list(range(len(prints)))
    array, changed = np.array(prints, np.uint64), True
    while changed:
        changed = False
        for i, p in enumerate(array):
            least = min(label[j] for j in np.flatnonzero(np.bitwise_count(array ^ p) <= 2))
            changed, label[i] = changed or least < label[i], min(least, label[i])
    assert [found.get(s, i) for i, s in enumerate(signed)] == label


def wide_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_by_likeness(spark):
    """Planted copies with more than 2 differing bits, a chain, and pairs below the limit."""
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (8, 40, 120, 400):
        for edits in (1, 1, 2, 5, 12):
            base = draw(n)
            copy = list(base)
            for k in rng.sample(range(n), min(edits, n)):
                copy[k] = "edited"
            texts += [base, copy]
    x = draw(200)
    for k in range(12):
        x = [*x[6:], *draw(6)]
        texts.append(x)
    texts += [draw(3), draw(4), [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, label = [wide_shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                either = len(sets[i] | sets[j])
                if not either or len(sets[i] & sets[j]) / either >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    bits = [bin(simhash.fingerprint(t) ^ simhash.fingerprint(rows[label[i]][1])).count("1") for i, t in rows]
    assert sum(b > 2 for b in bits) > 5  # copies that the fingerprints' limit leaves
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similarity=0.8)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label))


def test_near_copies_around_a_passage(spark):
    """Short texts around one long passage are alike in many bands, but not enough; the few copies among them are found, also
    where the first hub is none of theirs, and the pairs that are checked don't grow with the square of their number."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(16, 30))]
        texts.append(" ".join(own) + " " + passage)
        if i % 20 == 0:
            texts.append(" ".join(["other", *own[1:]]) + " " + passage)
    rows = list(enumerate(texts))
    sets, label = [wide_shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similarity=0.8)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label)) and len(set(label)) <= 300


def test_near_copies_without_ids(spark):
    """A null or repeated id that is dropped once takes no other text along, and exactly one row of each group stays."""
    rng = random.Random(12)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, d), (7, a), (7, e), (None, f), (None, f)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()), key=str)
    assert left == sorted([(1, a), (None, b), (None, c), (2, d), (7, e), (None, f)], key=str)


def brute_repeats(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            key = data[k : k + 50]
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < (float("inf") if i is None else i):
                gone[k : k + 50] = True
        keep = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((-1 if i is None else i, len(data), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def removed(found):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


#: As it is; every shared digit hot; digits of so few bits that nearly all collide.
WAYS = [{}, {"hot_runs": 0}, {"digit_bits": 3, "hot_runs": 1 << 30}, {"digit_bits": 3, "hot_runs": 5}]


@pytest.mark.parametrize("way", WAYS)
def test_repeats(edge, way):
    rows = edge.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    assert removed(repeats.remove_repeats(rows, **way)) == brute_repeats([(r.doc_id, r.text) for r in rows.collect()])


@pytest.mark.parametrize("way", WAYS)
def test_repeats_in_many_contexts(spark, way):
    """Passages in many contexts, texts of one sign, texts around the window's length, repeated ids and rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 70)))
    shared = ["".join(rng.choice("xyzé ") for _ in range(90)) for _ in range(3)]
    rows = [(i, word() + rng.choice(shared)[rng.randint(0, 20) : rng.randint(60, 90)] + word()) for i in range(300)] + [(1000 + i, "=" * rng.randint(40, 400)) for i in range(20)]
    rows += [(5, shared[0]), (5, shared[0]), (2000, shared[1][:49]), (2001, shared[1][:50]), (-7, shared[2])]
    rng.shuffle(rows)
    assert removed(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **way)) == sorted(brute_repeats(rows))


def test_least_of_equal():
    """Passes over bytes against a table of windows, with labels that keep equal windows apart."""
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2, 3000, dtype=np.uint8)
    data[1000:1100] = data[2000:2100] = data[:100]
    at, ids, label = rng.integers(0, 2950, 4000), rng.integers(0, 9, 4000), rng.integers(0, 2, 4000)
    first = {}
    for k, i, x in zip(at.tolist(), ids.tolist(), label.tolist()):
        key = (x, data[k : k + 50].tobytes())
        first[key] = min(first.get(key, i), i)
    assert repeats.least_of_equal(data, at, ids, label).tolist() == [first[x, data[k : k + 50].tobytes()] for k, x in zip(at.tolist(), label.tolist())]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def digests(text):
    pieces = [p[i : i + fingerprints.LONGEST] for p in re.split(fingerprints.PARAGRAPH_END, text) for i in range(0, len(p), fingerprints.LONGEST)]
    return {signed(xxhash.xxh64_intdigest(p.encode(), 42)) for p in pieces}


def hashed(key, number):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", number), seed))


def peeled_alone(fingerprint):
    """The digests of a text, from its published fingerprint alone."""
    _, width, cells = ([*fingerprint.split("-"), "", ""])[:3]
    if not cells:
        return set()
    width, table = int(width, 16), {}
    for k in range(0, len(cells), 34):
        one = cells[k : k + 34]
        table[int(one[:6], 16)] = [int(one[6:10], 16), int(one[10:26], 16), int(one[26:], 16)]
    found, more = set(), True
    while more:
        more = False
        for c, k, h in list(table.values()):
            key = signed(k)
            check = hashed(key, fingerprints._CHECK) & 0xFFFFFFFF
            if c == 1 and h == check and key not in found:
                found.add(key)
                more = True
                for t in range(fingerprints.TABLES):
                    cell = table[t * width + hashed(key, t) % width]
                    cell[0], cell[1], cell[2] = cell[0] - 1, cell[1] ^ k, cell[2] ^ check
    assert all(cell == [0, 0, 0] for cell in table.values())
    return found


def alike(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(edge):
    """Rows against their definition, and both likenesses from the two columns of fingerprints alone."""
    edge = edge.where("doc_id IS NOT NULL")
    order = sorted((r.doc_id, r.text or "") for r in edge.collect())
    found = sorted(fingerprints.fingerprint(edge).collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert [r.doc_id for r in found] == [i for i, _ in order]
    by_text = defaultdict(set)
    own = [peeled_alone(r.fingerprint) for r in found]
    for k, ((i, text), f) in enumerate(zip(order, found)):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (f.n_chars, f.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert own[k] == digests(text) and peeled_alone(f.edited_fingerprint) == digests(edited)
        assert f.near_edited == pytest.approx(alike(own[k], peeled_alone(f.edited_fingerprint))) and f.near_next == pytest.approx(alike(own[k], own[(k + 1) % len(order)]))
        assert (set(f.lost), set(f.gained)) == (digests(text) - digests(edited), digests(edited) - digests(text))
        by_text[text].add(f.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_fingerprints_of_documents(spark):
    """Half of each edited text is kept, also of one without line ends and sentences."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = fingerprints.fingerprint(docs).where("n_chars > 500").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.4 and np.mean([r.near_edited > 0 for r in rows]) > 0.97


def test_fingerprints_without_ids(edge):
    rows = fingerprints.fingerprint(edge.where("doc_id IS NULL")).collect()
    assert len(rows) == 2 and {r.doc_id for r in rows} == {None}
    assert fingerprints.fingerprint(edge).count() == edge.count()


def test_neighbours_across_groups(spark, monkeypatch):
    """Groups of a few rows, repeated ids among them: each text is followed by the next in order of id and hash."""
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 64)
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, 5, rng.randrange(1000)]), f"text {i} " + "x" * rng.randint(0, 30)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    found = {r.text: r.next_text for r in fingerprints.with_next(df, "doc_id", "text").collect()}
    assert found == {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]])}


def test_reconcile(spark):
    """Differences of random sets, with too few cells at first."""
    rng = random.Random(1)
    draw = lambda n: [rng.getrandbits(63) for _ in range(n)]
    pairs = []
    for i in range(40):
        both, a, b = draw(rng.randint(0, 60)), draw(rng.randint(0, 40)), draw(rng.randint(0, 40))
        pairs.append((i, i % 3, i % 2 == 0, both + a, both + b))
    pairs += [(100, 0, True, [], []), (101, 0, True, [7], [7])]
    df = spark.createDataFrame(pairs, "pair long, kind int, named boolean, first array<long>, second array<long>")
    found = {(r.pair, r.kind): r for r in fingerprints.reconcile(df, factor=0.05).collect()}
    for i, kind, named, a, b in pairs:
        a, b, r = set(a), set(b), found.get((i, kind))
        assert (r is None and a == b) or (r.only_first, r.only_second) == (len(a - b), len(b - a))
        assert r is None or (r.first_digests, r.second_digests) == ((sorted(a - b), sorted(b - a)) if named else ([], []))


def test_empty(none):
    assert exact_dedup.deduplicate(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert fingerprints.fingerprint(none).count() == 0


def test_rows_by_their_place(spark, edge, tmp_path):
    """Rows numbered by where they stand in Parquet files, or by a staged copy: the same rows stay, and nothing is copied."""
    edge.unionByName(edge).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    placed = shared.identified(docs, "placed", True)
    assert not hasattr(placed, "staged_at") and placed.columns == [*docs.columns, "_row"]
    numbers = [r._row for r in placed.select("_row").collect()]
    assert len(set(numbers)) == len(numbers) == docs.count() and numbers == [r._row for r in placed.select("_row").collect()]
    assert hasattr(shared.identified(docs.limit(5).union(docs.limit(3)), "copied", False), "staged_at")
    made = spark.range(3).withColumn("text", F.lit("x"))
    assert shared.identified(made, "made", True).select("_row").distinct().count() == 3
    key = lambda df: sorted(str(r) for r in df.collect())
    same = [simhash.drop_near_copies(docs, similarity=0.8, at_rest=flag).select("doc_id", "text").distinct() for flag in (True, False)]
    assert key(same[0]) == key(same[1])


def test_scopes_of_two_threads(spark, edge):
    """Two operators at once in one session: each drops its own tables only."""
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: sorted(str(r) for r in exact_dedup.drop_copies(edge).collect()), range(2)))
    assert found[0] == found[1] == sorted(str(r) for r in exact_dedup.drop_copies(edge).collect())
    with shared.staging() as outer:
        kept = shared.stage(edge, "outer")
        with shared.staging() as own:
            inner, gone = shared.stage(edge, "inner"), shared.stage(edge, "gone")
            shared.drop_staged(spark, set(own) - {inner.staged_at})
            assert own == [inner.staged_at]
        assert outer == [kept.staged_at, inner.staged_at] and kept.count() == inner.count() == edge.count()
        with pytest.raises(Exception):
            gone.count()


def test_moves_of_labels(spark):
    """Labels that move more than once end where their last step leads."""
    step = lambda pairs: shared.stage(spark.createDataFrame(pairs, "label long, to long"), "moves")
    moves = jaccard.composed(None, step([(5, 3), (6, 3), (9, 8)]))
    moves = jaccard.composed(moves, step([(3, 1), (8, 2)]))
    moves = jaccard.composed(moves, step([(2, 1), (7, 4)]))
    names = spark.createDataFrame([(10 + i, i) for i in range(1, 11)], "fp long, label long")
    assert {r.fp - 10: r.label for r in jaccard.moved(names, moves).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1, 7: 4, 8: 1, 9: 1, 10: 10}
    assert jaccard.moved(names, None) is names
