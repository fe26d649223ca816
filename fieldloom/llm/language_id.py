"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrences (minimal gated units: one gate mixes the old state with a candidate) read a row of bytes, one from
each end. Every position gets class probabilities from both states; a document's probabilities are the mean over its
letter positions. The network is trained in numpy by backpropagation through time, on a bounded sample of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pieces, small_batches, stage

UNKNOWN = "und"
PAD = 256
#: The sample: different texts per language (by a hash), windows of so many characters per document. It bounds what
#: reaches the driver to languages * DOCS * WINDOWS * WINDOW_CHARS characters.
DOCS, WINDOWS, WINDOW_CHARS = 800, 4, 160
HIDDEN, STEPS, BATCH, SPAN, RATE, SEED = 8, 220, 320, 72, 0.03, 11
#: Texts are read in rows of ROW bytes, ROWS at a time; every byte is in one row.
ROW, ROWS = 128, 2048

_byte = np.arange(PAD + 1)
LETTER = ((_byte | 0x20) >= ord("a")) & ((_byte | 0x20) <= ord("z")) | (_byte >= 0x80) & (_byte < PAD)


@dataclass
class Network:
    """in_w[d]: byte -> gate and candidate inputs; rec_w[d]: the same from the state; out_w, out_b: classes. d: direction."""

    labels: list[str]
    in_w: np.ndarray
    rec_w: np.ndarray
    out_w: np.ndarray
    out_b: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        h, k = HIDDEN, len(labels)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(labels, draw(2, PAD + 1, 2 * h), draw(2, h, 2 * h), draw(2 * h, k), np.zeros(k, np.float32))

    def states(self, rows: np.ndarray, keep: bool = False):
        """rows: time x batch of byte numbers. The states of both directions at each time, time x feature x batch; with keep also gates and candidates."""
        span, n = rows.shape
        h = HIDDEN
        out = np.empty((span, 2 * h, n), np.float32)
        kept = np.empty((2, span, 2 * h, n), np.float32) if keep else None
        for d in (0, 1):
            state = np.zeros((h, n), np.float32)
            # sigmoid(x) = (1 + tanh(x / 2)) / 2, so that one tanh serves the gate and the candidate
            half = np.r_[np.full(h, 0.5), np.ones(h)].astype(np.float32)
            in_w, rec_w = self.in_w[d] * half, np.ascontiguousarray((self.rec_w[d] * half).T)
            for t in range(span) if d == 0 else range(span - 1, -1, -1):
                x = rec_w @ state
                x += in_w.take(rows[t], axis=0).T
                np.tanh(x, out=x)
                gate, candidate = x[:h], x[h:]
                gate *= 0.5
                gate += 0.5
                step = candidate - state
                step *= gate
                state += step
                out[t, d * h : (d + 1) * h] = state
                if keep:
                    kept[d, t] = x
        return out, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """time x class x batch."""
        scores = np.ascontiguousarray(self.out_w.T) @ states
        scores += self.out_b[:, None]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over letter positions, by backpropagation through time."""
        h, (span, n) = HIDDEN, rows.shape
        states, kept = self.states(rows, keep=True)
        letters = LETTER[rows]
        error = self.probabilities(states)
        error[:, target, np.arange(n)] -= 1
        error *= (letters / max(1, letters.sum())).astype(np.float32)[:, None, :]
        g_out = np.einsum("tin,tkn->ik", states, error, optimize=True)
        from_out = self.out_w @ error
        g_in, g_rec = np.zeros_like(self.in_w), np.zeros_like(self.rec_w)
        for d in (0, 1):
            own = states[:, d * h : (d + 1) * h]
            delta = np.empty((2 * h, span, n), np.float32)
            carried = np.zeros((h, n), np.float32)
            zero = np.zeros((h, n), np.float32)
            for t in range(span - 1, -1, -1) if d == 0 else range(span):
                before = t - 1 if d == 0 else t + 1
                old = own[before] if 0 <= before < span else zero
                gate, candidate = kept[d, t, :h], kept[d, t, h:]
                carried = carried + from_out[t, d * h : (d + 1) * h]
                delta[:h, t] = carried * (candidate - old) * gate * (1 - gate)
                delta[h:, t] = carried * gate * (1 - candidate * candidate)
                g_rec[d] += old @ delta[:, t].T
                carried = carried * (1 - gate) + self.rec_w[d] @ delta[:, t]
            at = rows.reshape(-1)
            for j in range(2 * h):
                g_in[d, :, j] = np.bincount(at, delta[j].reshape(-1), PAD + 1)
        return [g_in, g_rec, g_out, error.sum((0, 2))]


def _rows(chunks: list[bytes], span: int) -> np.ndarray:
    """time x batch of byte numbers; short chunks are padded."""
    rows = np.full((len(chunks), span), PAD, np.int64)
    for i, c in enumerate(chunks):
        rows[i, : len(c)] = np.frombuffer(c, np.uint8)
    return rows.T


def train(windows: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> Network:
    """A network from (lang, text) windows, each language as often as the others; Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in windows})
    # a window is learned from in rows of SPAN bytes, all but a last one of a few bytes
    rows_of = lambda data: [data[i : i + SPAN] for i in range(0, max(1, len(data) - SPAN // 4), SPAN)]
    by = [[row for lang, t in windows if lang == name for row in rows_of(t.encode())] for name in labels]
    net = Network.fresh(labels, rng)
    values = [net.in_w, net.rec_w, net.out_w, net.out_b]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), BATCH)
        rows = _rows([by[k][rng.integers(len(by[k]))] for k in target], SPAN)
        rate = RATE * (1 - 0.95 * step / steps)
        for v, g, a, b in zip(values, net.gradients(rows, target), first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def classify(net: Network, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
    """The language, its probability and the number of letter positions for each whole text; UNKNOWN and 0 without letters."""
    pooled = np.zeros((len(texts), len(net.labels)))
    weight = np.zeros(len(texts))
    ascii_letters = np.zeros(len(texts), bool)
    pending: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        rows, owner = np.concatenate(pending), np.concatenate(owners)
        pending.clear(), owners.clear()
        held = 0
        for i in range(0, len(rows), ROWS):
            part, own = np.ascontiguousarray(rows[i : i + ROWS].T), owner[i : i + ROWS]
            letters = LETTER[part]
            p = net.probabilities(net.states(part)[0])
            p *= letters[:, None, :]
            p = p.sum(0, dtype=np.float64)
            for k in range(len(p)):
                pooled[:, k] += np.bincount(own, p[k], len(texts))
            weight[:] += np.bincount(own, letters.sum(0), len(texts))

    for i, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        ascii_letters[i] = bool((LETTER[data] & (data < 0x80)).any())
        n = -(-len(data) // ROW)
        rows = np.full(n * ROW, PAD, np.int16)
        rows[: len(data)] = data
        pending.append(rows.reshape(n, ROW))
        owners.append(np.full(n, i))
        held += n
        if held >= 4 * ROWS:
            flush()
    if pending:
        flush()
    langs, scores = [], []
    for i, text in enumerate(texts):
        if not text or not (ascii_letters[i] or any(map(str.isalpha, text))):
            langs.append(UNKNOWN), scores.append(0.0)
            continue
        p = pooled[i] / max(1.0, weight[i])
        best = int(p.argmax())
        langs.append(net.labels[best]), scores.append(min(1.0, float(p[best])))
    return langs, scores, weight.astype(int).tolist()


def sample_windows(docs: DataFrame, held_out, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Training windows of the documents that aren't held out, in a fixed order: WINDOWS of each of DOCS different texts a
    language, or of all if there are fewer, those with the smallest hashes. Ids have no say in it, so repeated rows, equal ids
    and missing ones neither fill nor empty the sample."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    texts = stage(rows.select("lang", "h").distinct(), "language-texts")
    counts = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a few times as many draws as are wanted, of which the smallest count: nothing here grows with the corpus
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * DOCS / n))]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("h", F.lit("sample")), 11) / F.lit(float(1 << 53))
    drawn = texts.withColumn("draw", draw).where(F.col("draw") < chance)
    chosen = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h"))).where(F.col("n") <= DOCS).select("lang", "h")
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    windows = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))))
    start = F.pmod(F.xxhash64("h", "k"), F.greatest(F.lit(1), F.char_length("text") - WINDOW_CHARS + 1)).cast("int") + 1
    windows = windows.select("lang", F.substring(F.col("text"), start, F.lit(WINDOW_CHARS)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    return sorted((r.lang, r.text) for r in windows.collect())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id_col, held_out, lang_pred and score.

    held_out: crc32 of the id as text leaves 1 when divided by 3; those rows never train. Only the text decides a
    prediction. A null text or one without letters is "und" with score 0; without any labelled row all are. A null id
    counts as the text "". Repeated rows are predicted each; no rows give no rows; other columns are neither read nor
    returned. Training looks at a bounded sample (see DOCS); predicting reads whole texts.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    windows = sample_windows(docs, held_out, id_col, text_col, lang_col)
    net = train(windows) if windows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            langs, scores, _ = classify(net, texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts), [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return small_batches(docs).select(id_col, held_out.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float, languages: tuple[str, ...] | None = None, least_letters: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, with a text in one of the languages (None: any that was learned); a null language is
    replaced by the predicted one.

    Null, empty and letterless texts go, and texts of least_letters letters or more in which no language reaches min_score:
    shorter ones say too little to be turned away. The network is trained as in identify(); where no row is labelled
    there is nothing to learn or to judge by, and all rows with letters stay as they are. Rows are judged where they are,
    without a shuffle; repeated and null ids are rows like any other."""
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    windows = sample_windows(docs, held_out, id_col, text_col, lang_col)
    if not windows:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    net, at, lang_at = train(windows), docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores, letters = classify(net, batch.column(at).to_pylist())
            kept = [lang != UNKNOWN and (languages is None or lang in languages) and (s >= min_score or n < least_letters) for lang, s, n in zip(langs, scores, letters)]
            named = pc.coalesce(batch.column(lang_at), pa.array(langs, pa.string()))
            yield batch.set_column(lang_at, batch.schema.field(lang_at), named).filter(pa.array(kept, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
