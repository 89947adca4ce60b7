"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public model. Each language has a probability for every piece, learned by expectation
maximisation over all segmentations of the words of labelled texts. A text's probability under a language is the
product over its words of the sum over all segmentations of the product of piece probabilities; the sum is made by a
forward algorithm that runs over all words of a length at once. Words are runs of letters, in lower case, with the
marker in front. As a word's probability does not depend on its text, a worker keeps it for the words it has seen.

Defined results: `und` with score 0 where the text is null or has no letter (digits, fractions, superscripts and letter
numerals are none), or where no language could be learned. Languages that are equally likely go by their names' order. A
null id is never learned from and counts as not held out. A very long text is scored whole, in a chunk of its own.
Repeated rows are scored alike. An empty table gives an empty table. Other columns, whatever their names, are not read.
The model has a column for each value of lang that is learned from, so its size is pieces times languages.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm.common import crc_mod, least, spill, table
from curatrix.llm.sentencepiece_codec import MARK, MODEL, NORMAL, parse

#: Bounds of what is learned from: labelled texts a language, and rounds of expectation maximisation.
SAMPLE, ROUNDS, SMOOTH = 3000, 3, 0.05
#: Most languages whose limits go by broadcast.
SMALL = 10_000
#: Longest piece in characters, longest word taken whole (longer runs of letters are cut), words a worker remembers.
LONGEST, WORD_CUT, CACHE = 12, 40, 500_000
#: A letter as str.isalpha() has it: a word character that is neither a digit, a mark of its own, nor any other numeral.
LETTER = f"[^\\W\\d_{re.escape(''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()))}]"
LETTERS = re.compile(f"{LETTER}+")
#: Runs of letters and other numerals than digits, which is quicker; the few with a numeral are cut again.
_RUNS = re.compile(r"[^\W\d_]+")


def vocabulary(model: str = MODEL) -> list[str]:
    """Pieces that are letters with at most one marker in front, in lower case."""
    with open(model, "rb") as f:
        m = parse(f.read())
    shape = re.compile(f"{MARK}?{LETTER}+|{MARK}")
    return [p for p, t in zip(m.pieces, m.types) if t == NORMAL and len(p) <= LONGEST and shape.fullmatch(p) and p == p.lower()]


class Lattice:
    """All pieces that can stand at each place of each word; unknown letters share one piece.

    Substrings are looked up by hash for all words of a length at once: two direct tables hold the pieces, and the
    full hash is compared.
    """

    BITS = 22

    def __init__(self, pieces: list[str]):
        self.size, self.unknown = len(pieces) + 1, len(pieces)
        self.hashes = np.zeros(len(pieces) + 1, np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for n, at in by_length.items():
            codes = self._codes([pieces[i] for i in at], n)
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = self._step(h, codes[:, j])
            self.hashes[at] = h
        self.first, self.second = (np.full(1 << self.BITS, len(pieces), np.int32) for _ in range(2))
        ids = np.arange(len(pieces), dtype=np.int32)
        self.first[self._slot(self.hashes[:-1])] = ids
        lost = ids[self.first[self._slot(self.hashes[:-1])] != ids]
        self.second[self._slot(self.hashes[lost] * K.U(0x9E3779B97F4A7C15))] = lost
        if (self._find(self.hashes[:-1]) != ids).any():
            raise ValueError("pieces repeat or their hashes collide")

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n)

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return K.mix(h * K.U(0xC2B2AE3D27D4EB4F) + code.astype(np.uint64) + K.U(1))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> K.U(64 - self.BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        got = self.first[self._slot(h)]
        wrong = np.flatnonzero(self.hashes[got] != h)
        again = self.second[self._slot(h[wrong] * K.U(0x9E3779B97F4A7C15))]
        got[wrong] = np.where(self.hashes[again] == h[wrong], again, -1)
        return got

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
        """Words of one length at a time: their places in `words`, the length, and for (start, end) the piece or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            codes = self._codes([words[i] for i in at], int(n))
            found = {}
            for i in range(n):
                h = np.zeros(len(at), np.uint64)
                for j in range(i + 1, min(n, i + LONGEST) + 1):
                    h = self._step(h, codes[:, j - 1])
                    ids = self._find(h)
                    if j == i + 1:
                        ids[ids < 0] = self.unknown
                    if (ids >= 0).any():
                        found[i, j] = ids
            yield at, int(n), found

    def forward(self, n: int, found: dict, p: np.ndarray, count: int) -> list[np.ndarray]:
        """Sums over all segmentations of the prefixes; p has a row for each piece and a last row of zeros."""
        alpha = [np.ones((count, p.shape[1]))] + [np.zeros((count, p.shape[1])) for _ in range(n)]
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                if (i, j) in found:
                    alpha[j] += alpha[i] * p[found[i, j]]
        return alpha

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        for at, n, found in self.spans(words):
            out[at] = np.log(np.maximum(self.forward(n, found, p, len(at))[n], 1e-300))
        return out

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under the posterior over segmentations, for one language."""
        out = np.zeros(self.size)
        for at, n, found in self.spans(words):
            alpha = self.forward(n, found, p, len(at))
            beta = [np.zeros((len(at), 1)) for _ in range(n)] + [np.ones((len(at), 1))]
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, min(n, i + LONGEST) + 1):
                    if (i, j) in found:
                        beta[i] += p[found[i, j]] * beta[j]
            scale = weight[at] / np.maximum(alpha[n][:, 0], 1e-300)
            for (i, j), ids in found.items():
                use = alpha[i][:, 0] * p[ids][:, 0] * beta[j][:, 0] * scale
                ok = ids >= 0
                out += np.bincount(ids[ok], use[ok], self.size)
        return out


_lattices: dict[str, Lattice] = {}


def lattice_of(key: str, pieces: list[str]) -> Lattice:
    """The lattice of a training run, built once for each worker."""
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def letter_runs(text: str) -> list[str]:
    found = _RUNS.findall(text)
    return found if all(map(str.isalpha, found)) else [y for x in found for y in ([x] if x.isalpha() else LETTERS.findall(x))]


def split_words(text: str) -> list[str]:
    return [MARK + x[i : i + WORD_CUT] for x in letter_runs(text.lower()) for i in range(0, len(x), WORD_CUT)]


def sample(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE) -> DataFrame:
    """At most `per_language` labelled texts of each language (more only where one id repeats), by the hash of their ids."""
    ok = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (crc_mod(df["doc_id"], 4) != 2)).withColumn("_h", F.xxhash64("doc_id", F.lit("language-sample")))
    # One row for each language; joined in place unless there are very many.
    limits = spill(least(ok.select(lang, "_h"), lang, "_h", per_language).groupBy(lang).agg(F.max("_h").alias("_m")), "language-limits")
    if limits.limit(SMALL + 1).count() <= SMALL:
        limits = F.broadcast(limits)
    return ok.join(limits, lang).where("_h <= _m").select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def train(df: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", per_language: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and a table of piece probabilities with a column for each (rows: pieces, unknown letter, zeros).

    Workers count words and then make the expected counts; the driver gets one number for each language and piece.
    """
    lattice = Lattice(pieces)
    known, key = df.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got: dict[tuple[str, str], int] = {}
            for la, tx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in split_words(tx):
                    got[la, w] = got.get((la, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "word", "n"])

    counts = spill(sample(df, text, lang, per_language).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    p = np.zeros((lattice.size + 1, max(1, len(langs))))
    p[: lattice.size] = 1 / lattice.size
    for _ in range(rounds if langs else 0):
        now = df.sparkSession.sparkContext.broadcast(p)

        def expect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, table_now = lattice_of(key, known.value), now.value
            total = np.zeros((lattice.size, len(langs)))
            for batch in it:
                frame = batch.to_pandas()
                for la, part in frame.groupby("lang"):
                    k = langs.index(la)
                    total[:, k] += lattice.expected(part["word"].tolist(), part["n"].to_numpy(float), table_now[:, [k]])
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[i, k])], ["k", "i", "x"])

        got = counts.mapInArrow(expect, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()
        new = np.full((lattice.size, len(langs)), SMOOTH)
        new[got["i"].to_numpy(int), got["k"].to_numpy(int)] += got["x"].to_numpy(float)
        p = np.vstack([new / new.sum(0), np.zeros((1, len(langs)))])
    return langs, p


class Scorer:
    """Log probabilities of words under every language, remembered."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray):
        self.lattice, self.langs, self.p = Lattice(pieces), langs, p
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, self.p.shape[1]))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Best language (-1: none) and its probability, for each text."""
        if len(self.known) > CACHE:
            self.forget()
        flat: list[str] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            found = letter_runs(t.lower()) if t else []
            if found and max(map(len, found)) > WORD_CUT:
                found = [x[k : k + WORD_CUT] for x in found for k in range(0, len(x), WORD_CUT)]
            counts[i + 1] = len(found)
            flat += found
        fresh = list(dict.fromkeys(w for w in flat if w not in self.known))
        if fresh:
            rows = self.lattice.log_likelihood([MARK + w for w in fresh], self.p)
            n = len(self.known)
            while n + len(fresh) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(fresh)] = rows
            self.known.update(zip(fresh, range(n, n + len(fresh))))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        edge = np.cumsum(counts)
        total = np.zeros((len(texts), self.p.shape[1]))
        full = np.flatnonzero(np.diff(edge) > 0)
        if len(full):
            total[full] = np.add.reduceat(self.rows[at], edge[:-1][full], axis=0)
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        score = odds[np.arange(len(texts)), best] / odds.sum(1)
        none = np.ones(len(texts), bool)
        none[full] = not self.langs
        return np.where(none, -1, best), np.where(none, 0.0, score)


_scorers: dict[str, Scorer] = {}


def predict(df: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row. The model (pieces by languages) goes as one broadcast."""
    model, key = df.sparkSession.sparkContext.broadcast((pieces, langs, p)), uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model.value)
        scorer = _scorers[key]
        names = np.array([*langs, "und"], object)
        for rows, _, _ in K.chunks(it, "_text"):
            best, score = scorer.score(rows.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod(df["doc_id"], 4) == 2, F.lit(False))
    return df.select("doc_id", held.alias("held_out"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = vocabulary()
    langs, p = train(docs, pieces)
    return predict(docs.select("doc_id", "text"), pieces, langs, p)
