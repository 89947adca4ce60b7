"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line gets shares of letters, capitals, digits, symbols, bars, blanks and so on, how much it repeats words and
earlier lines, and the same of its neighbours. The chain labels every line good or bad; forward-backward gives each
line's probability of being good, and the mean of these, weighted by the lines' lengths, is the document's quality.
Weights are learned from labelled documents (every line takes its document's label) by gradient ascent on the chains'
conditional log-likelihood, each document counting once and both classes alike.

Features are made from the bytes of many documents at once; the recursions run over all documents of a chunk at once.

Defined results: a null or empty text is one empty line. A null id is scored, never learned from, and not held out.
Labels that are null are not used; a document labelled both ways counts as good; where no label is left, every score is
0.5. A very long text is scored whole; of its lines at most LINES, one stretch, are learned from. Repeated rows score
alike. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm.common import crc_mod, least, table, text_of

#: Bounds of the sample learned from: documents of each label, and lines of each of them (40 numbers a line reach the
#: driver: 96 MB at most). Steps and rate of the ascent; weight decay.
SAMPLE, LINES, STEPS, RATE, DECAY = 1500, 200, 150, 0.1, 1e-3
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SYMBOL, _BAR, _STOP, _BANG = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&<>@^~=+\\/{}[]_", b"|", b".,;:", b"!?"))
OWN = 13
WIDTH = 3 * OWN + 1


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', the lines' lengths, and the first line of each document."""
    # A line end is put after every document, so that every document has a line.
    n = len(offs) - 1
    out = np.empty(len(buf) + n, np.uint8)
    place = np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offs))
    out[place] = buf
    ends_at = offs[1:] + np.arange(n)
    out[ends_at] = 10
    stops = np.flatnonzero(out == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    first = np.searchsorted(stops, np.concatenate(([-1], ends_at)), "right")
    first = np.concatenate(([0], first[1:]))
    size = (stops - starts).astype(np.float64)
    ink = out != 10

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return (c[stops] - c[starts]).astype(np.float64)

    ws, we, wf = K.words(out, np.concatenate((starts, [len(out)])))
    h = K.word_hashes(out, ws, we)
    line = K.owners(wf)
    count = np.diff(wf).astype(np.float64)
    # Words met before in the line, and lines met before in the document.
    again = np.zeros(len(h), bool)
    order = np.lexsort((np.arange(len(h)), h, line))
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    repeats = np.bincount(line, again, len(stops)) if len(h) else np.zeros(len(stops))
    key = np.zeros(len(stops), np.uint64)
    some = np.flatnonzero(count > 0)
    if len(some):
        where = np.arange(len(h)) - np.repeat(wf[:-1], np.diff(wf))
        key[some] = np.add.reduceat(K.mix(h + where.astype(np.uint64) * K.U(0x9E3779B97F4A7C15)), wf[:-1][some])
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((np.arange(len(key)), key, doc))
    seen = np.zeros(len(key))
    seen[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (count[order[1:]] > 0)
    chars, w = np.maximum(size, 1), np.maximum(count, 1)
    upper, lower = total(_UPPER[out]), total(_LOWER[out])
    own = np.stack([
        (upper + lower + total(_HIGH[out])) / chars, upper / np.maximum(upper + lower, 1), total(_DIGIT[out]) / chars,
        np.minimum(total(_SYMBOL[out]) / w, 3), np.minimum(total(_BAR[out]) / w, 1), np.minimum(total(_STOP[out]) / w, 2), np.minimum(total(_BANG[out]) / w, 3),
        np.minimum(size / w, 20) / 10, np.log1p(count) / 5, repeats / w, seen, (count == 0).astype(float), np.minimum(total(_HIGH[out]) / chars, 1),
    ], 1)
    del ink
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), size + 1, first


class Chain:
    """Scores of the label good (bad has 0) are features @ w; trans[a, b] scores b after a."""

    @staticmethod
    def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, and the log of forward and backward sums (lines x 2), for many chains at once."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        phi = np.stack([np.zeros_like(unary), unary], 1)
        alpha, beta = np.zeros_like(phi), np.zeros_like(phi)
        alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths.max(initial=0)))]
        for t, live in enumerate(alive):
            at = begin[:live] + t
            alpha[at] = phi[at]
            if t:
                prev = alpha[at - 1]
                alpha[at] += np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        for t in range(len(alive) - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            nxt = beta[at + 1] + phi[at + 1]
            beta[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        joint = alpha + beta
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500))), alpha, beta


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from chains all of whose lines have their document's label."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(label):
        return w, trans
    lengths = np.diff(first)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) / lengths
    each, gold = np.repeat(share, lengths), np.repeat(label, lengths).astype(float)
    inner = np.ones(len(gold), bool)
    inner[first[1:] - 1] = False
    left = np.flatnonzero(inner)
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        u = x @ w
        p, alpha, beta = Chain.marginals(u, trans, first)
        g_w = x.T @ (each * (gold - p)) - DECAY * w
        g_t = -DECAY * trans
        if len(left):
            phi = np.stack([np.zeros_like(u), u], 1)
            pair = alpha[left][:, :, None] + trans[None] + (beta[left + 1] + phi[left + 1])[:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            pair /= pair.sum((1, 2), keepdims=True)
            for a in (0, 1):
                for b in (0, 1):
                    here = (gold[left] == a) & (gold[left + 1] == b)
                    g_t[a, b] += (each[left] * (here - pair[:, a, b])).sum()
        for k, g in enumerate((g_w, g_t)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if k:
                trans = trans + move
            else:
                w = w + move
    return w, trans


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """(text, quality) of at most `each` labelled rows of either label, by the hash of their ids and then of their texts."""
    ok = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(labels["doc_id"], 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = least(ok.withColumn("_h", F.xxhash64("doc_id", F.lit("quality-sample"))), "quality", "_h", each).select("doc_id", "quality")
    # At most 2 * each ids: bounded by the parameter.
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    # An id may have any number of rows.
    return least(rows.withColumn("_t", F.xxhash64("doc_id", "text")), "quality", "_t", each).select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            x, _, first = line_features(buf, offs)
            start, size = first[:-1], np.diff(first)
            # Of longer texts a stretch of lines at a place that depends on nothing but their number.
            over = np.maximum(size - LINES, 0)
            start = start + (K.mix(size.astype(np.uint64)) % (over + 1).astype(np.uint64)).astype(np.int64)
            cells = [x[a : a + min(n, LINES)].astype(np.float32).tobytes() for a, n in zip(start, size)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), rows.column(1)], ["x", "quality"])

    got = sample(docs, labels, each).mapInArrow(run, "x binary, quality int").toPandas()
    blocks = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    first = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.int64)
    x = np.concatenate(blocks).astype(np.float64) if blocks else np.zeros((0, WIDTH))
    return fit(x, first, got["quality"].to_numpy(int) if blocks else np.zeros(0, int))


def score(docs: DataFrame, w: np.ndarray, trans: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            x, size, first = line_features(buf, offs)
            p, _, _ = Chain.marginals(x @ w, trans, first)
            s = np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod(docs["doc_id"], 5) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w, trans = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, w, trans)
