import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldloom.llm import alignment, licenses, vector_codes
from fieldloom.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def by_hand(text, libraries, a_bytes, b_bytes):
    """(A ids, B ids, groups as text, links) of a whole text by the libraries, comparing every range with every other."""
    a, b = libraries
    a, b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    full = (" " + (text or "")).encode()
    if not text or b"".join(a_bytes[i] for i in a) != full or b"".join(b_bytes[i] for i in b) != full:
        return [], [], "", []
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    a_ends, b_ends = ends(a, a_bytes), ends(b, b_bytes)
    links, first = [], 0
    for i, (start, stop) in enumerate(zip([0, *a_ends], a_ends)):
        while first < len(b) and b_ends[first] <= start:
            first += 1
        j = first
        while j < len(b) and (b_ends[j - 1] if j else 0) < stop:
            links.append((a[i], b[j]))
            j += 1
    groups, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return a, b, ";".join(groups), links


ALPHABET = ["a", "b", "the", "tion", " ", "  ", "\n", "\t", " ", "é", "中", "文", "▁", "<|endoftext|>", "<s>", "<0x41>", "'s", "12", "!", "😀", "\x00", "\x1f", "\x85", "　", "ﬁ", "Ünï"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, 30))) for _ in range(n)]


def test_alignment_of_segments(libraries):
    """What is cut into segments and kept equals the alignment of whole texts."""
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    texts = [*random_texts(1500), "word " * 400, "x" * 3000, " lead", "trail ", "a b", "", None]
    some = 0
    for text, found in zip(texts, aligner.batch(texts), strict=True):
        a, b, groups, links = by_hand(text, libraries, aligner.a_bytes, aligner.b_bytes)
        size = len(aligner.b_bytes)
        if found is None:
            assert not a, text
        else:
            some += 1
            assert (found[0] & alignment.LOW, found[0] >> alignment.HIGH) == (len(a), len(b)) and found[2] == groups and found[1] & alignment.LOW == groups.count(";") + 1
            assert np.frombuffer(found[3], np.int64).tolist() == [x * size + y for x, y in links]
    assert 300 < some < len(texts) - 2


def test_kept_segments_are_bounded(monkeypatch):
    """However many different segments there are, an aligner keeps few; what it says doesn't change."""
    monkeypatch.setattr(alignment, "KEPT", 40)
    small, large = alignment.Aligner(A, B), alignment.Aligner(A, B)
    texts = [f"w{i % 97} and w{i} " * 3 for i in range(300)]
    monkeypatch.setattr(alignment, "KEPT", 10**6)
    expected = list(large.batch(texts))
    monkeypatch.setattr(alignment, "KEPT", 40)
    assert [x for at in range(0, 300, 7) for x in small.batch(texts[at : at + 7])] == expected
    assert len(small.kept) <= 20 and len(small.before) <= 20


def test_alignments(spark, edge, none, libraries):
    """The whole operator over nulls, ties, repeated rows and long texts, with all pairs broadcast, some, and none."""
    aligner = alignment.Aligner(A, B)
    hand = [(r.doc_id, by_hand(r.text, libraries, aligner.a_bytes, aligner.b_bytes)) for r in edge.collect()]
    counts = Counter(x for _, (_, _, _, links) in hand for x in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    expected = sorted(str((i, len(a), len(b), groups.count(";") + 1 if a else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else "")) for i, (a, b, groups, links) in hand)
    for most in (100_000, 20, 0):
        rows = alignment.alignments(edge, A, B, broadcast_rows=most).collect()
        assert sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in rows) == expected
    assert alignment.alignments(none, A, B).count() == 0


def test_groups_expand(spark):
    aligned = spark.createDataFrame([(1, "1,2|3;4|5,6"), (2, "")], "doc_id long, groups string")
    assert sorted((r.doc_id, r.group, r.a, r.b) for r in alignment.expand_groups(aligned).collect()) == [(1, 0, 1, 3), (1, 0, 2, 3), (1, 1, 4, 5), (1, 1, 4, 6)]
    whole = alignment.align(spark.createDataFrame([(7, "unbelievable  tokenisation")], "doc_id long, text string"), A, B)
    assert alignment.expand_groups(whole).count() == whole.first().n_products


def test_shared_pairs_meet_their_counts(spark, libraries):
    """A text that a third of all rows repeat, among others with pairs of their own."""
    texts = ["the same old text"] * 300 + [f"row{i} has its own wörds {i * 7919}" for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    split, whole = (sorted(alignment.alignments(docs, A, B, broadcast_rows=most).collect()) for most in (16, 10**6))
    assert split == whole and len(split) == 900
    ids = [r for r in whole if r.doc_id < 300]
    assert len({tuple(r)[1:] for r in ids}) == 1 and ids[0].count_sum >= 300 * ids[0].n_links


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def licenses_by_hand(text, templates):
    """(n_words, places of phrases, base labels, labels, score): every block against every template."""
    own, places, base, labels, score = words(text), [], set(), set(), 0.0
    for t in templates:
        wanted = words(t.text)
        if t.phrase:
            here = [i for i in range(len(own)) if own[i : i + len(wanted)] == wanted]
            places += here
            if here:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
            continue
        step = 4
        while step < len(wanted):
            step *= 2
        for start in range(0, len(own), step):
            common = set(own[start : start + 2 * step]) & set(wanted)
            if len(common) >= math.ceil(t.threshold * len(set(wanted)) - 1e-9) and set(t.needs) <= common:
                labels.add(t.label)
                score = max(score, len(common) / len(set(wanted)))
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses(spark, edge, none):
    rng = random.Random(3)
    vocabulary_ = [w for t in licenses.BASE + licenses.NOTICES for w in words(t.text)] + ["lorem", "ipsum", "naïve", "ÀB"]
    texts = [" ".join(rng.choices(vocabulary_, k=rng.randint(0, 60))) for _ in range(400)]
    for t in licenses.BASE + licenses.NOTICES:
        own = words(t.text)
        for lost in range(0, 4):
            kept = list(own)
            for _ in range(min(lost, len(kept) - 1)):
                kept.pop(rng.randrange(len(kept)))
            texts.append("Lorem ipsum. " * rng.randint(0, 9) + " ".join(kept).upper() + "; dolor")
        texts.append("x " * rng.randint(0, 70) + t.text.replace(" ", "\n-- ") + " y")
    texts += ["CC\x00BY cc-by CC BYé ccby", "all rights reserved " * 5000, "cc by general public license", "allrights reserved", "K ſ"]
    docs = spark.createDataFrame([(i, t, "7", "8") for i, t in enumerate(texts)], "doc_id long, text string, n_words string, labels string").repartition(4)
    every = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    templates = licenses.BASE + licenses.NOTICES
    expected = sorted(str((r.doc_id, *licenses_by_hand(r.text, templates))) for r in every.collect())
    found = licenses.scan(every).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in found) == expected
    assert sorted(r.doc_id for r in licenses.scan(docs).where("labels != ''").collect())
    assert licenses.scan(none).count() == 0
    labels = {x for r in found for x in r.labels.split(",")}
    assert labels >= {t.label for t in templates}


def test_license_templates(spark, edge):
    """The operator takes templates of its user, finds spans, and refuses ones that can't be looked for."""
    own = (licenses.Template("words", "word1 word3 word2 missing", 0.75),)
    rows = {r.doc_id: r.matches for r in licenses.find_licenses(edge.where("doc_id in (6, 5)"), own).collect()}
    assert rows[5] == [] and {m.containment for m in rows[6]} == {0.75}
    for m in rows[6]:
        assert {"word1", "word2", "word3"} <= set(words(edge.where("doc_id = 6").first().text)[m.start : m.start + m.words])
    with pytest.raises(ValueError, match="without words"):
        licenses.find_licenses(edge, (licenses.Template("none", "-- !"),))
    with pytest.raises(ValueError, match="over 50000 words"):
        licenses.find_licenses(edge, (licenses.Template("long", "w " * 50_001),))


def test_prefix_filter_follows_the_corpus(spark):
    """Rarest words come first, by counts over all texts."""
    docs = spark.createDataFrame([("rights " * 50 + "all " * 20 + "reserved",), (None,), ("All-Rights",)], "text string").repartition(3)
    counts = licenses.corpus_counts(docs, licenses.BASE[2:])
    assert counts == {b"rights": 51, b"all": 21, b"reserved": 1}
    join = licenses.TemplateJoin(licenses.BASE[2:], counts)
    assert list(join.prefix) == [0] and join.rank[b"reserved"] == 0


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, id string"


def codes_by_hand(rows, parts, size, rounds):
    """{place: (code, error)}, and the last codebooks, in plain Python."""
    kept = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    books = [[list(cut(kept[k][1], p)) for k in order[:size]] for p in range(parts)]

    def nearest(v, p):
        d = [sum((x - y) ** 2 for x, y in zip(cut(v, p), c)) for c in books[p]]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            for p in range(parts):
                groups[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, c), members in groups.items():
            books[p][c] = [sum(x) // len(members) for x in zip(*members)]
    out = [[nearest(v, p) for p in range(parts)] for _, v in kept]
    return [("".join(f"{c:02x}" for _, c in x), sum(d for d, _ in x)) for x in out], hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()


def test_vector_codes(spark):
    rng = random.Random(1)
    vectors = [[float(np.float32(rng.choice([rng.uniform(-2, 2), 0.0, 0.25, -0.001]))) for _ in range(8)] for _ in range(300)]
    rows = [(None if k % 40 == 3 else k % 250, vectors[k] if k % 3 else vectors[0], None if k % 5 == 0 else k % 4) for k in range(300)]
    bad = [(500, None, 1), (0, [float("nan")] * 8, 1), (1, [None] * 8, 2), (2, [float("inf"), *[0.0] * 7], 2), (3, [float("-inf"), *[0.0] * 7], None)]
    odd = [(-5, [], 1), (600, [1.0] * 4, 1), (601, [1.0, 2.0, 3.0], 9), (602, [1e30, *[0.0] * 7], 9)]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows + bad + odd], VECTORS).repartition(5)
    for size, rounds in ((16, 2), (200, 1), (256, 0)):
        expected, digest = codes_by_hand([r[:2] for r in rows], 4, min(size, 256), rounds)
        totals = defaultdict(int)
        for (_, _, label), (_, error) in zip(rows, expected):
            totals[label] += error
        wanted = [(i, code, error, totals[label], digest) for (i, _, label), (code, error) in zip(rows, expected)]
        wanted += [(i, None, None, totals.get(label), digest) for i, _, label in odd]
        found = vector_codes.compress(table, parts=4, size=size, rounds=rounds).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_vector_codes_of_little(spark):
    for rows in ([], [(1, None, 2)], [(1, [float("nan")] * 16, 2)]):
        assert vector_codes.compress(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)).count() == 0
    (only,) = vector_codes.compress(spark.createDataFrame([(1, [], 2, "a", "b", "c")], VECTORS)).collect()
    assert tuple(only) == (1, None, None, None, None)
    rows = [(7, [0.5] * 32, None, "a", "b", "c")] * 3 + [(None, [0.25] * 32, None, "a", "b", "c")]
    found = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.error for r in found} == {0, 0} and {r.label_error for r in found} == {0} and len(found) == 4
    assert len({r.code for r in found}) == 1 or {r.code[:2] for r in found} <= {"00", "03"}


def test_distances_are_exact():
    rng = np.random.default_rng(0)
    books = vector_codes.Codebooks(rng.integers(-(1 << 24), 1 << 24, (4, 50, 3)))
    x = rng.integers(-(1 << 24), 1 << 24, (200, 12))
    nearest, least = books.assign(x)
    full = ((x.reshape(200, 4, 1, 3) - books.entries[None]) ** 2).sum(3)
    assert (nearest == full.argmin(2)).all() and (least == full.min(2)).all()
