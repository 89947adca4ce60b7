"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read by hand: pieces with scores and types, the trainer's kind and byte fallback, the
normaliser's flags and character map. From these a tokenizers pipeline is rebuilt: normaliser, metaspace marker, the
model (Unigram with its scores, or BPE with merges ranked by score) with byte fallback, and the decoder. Texts are cut
where no piece can cross (before a run of markers; in BPE models whose pieces allow it, also between ASCII letters and
other ASCII), so each distinct part is encoded once per worker, in multithreaded batches. Parts are found and told apart
by their bytes, many texts at once. The ids are the pipeline's own, and its decoder turns them into text again;
sentencepiece only encodes each whole text for comparison (`parity`), so a wrong rebuild or a wrong cut shows there.

Defined results: a null text is encoded as '', which has no ids and decodes to ''. A text that holds the marker
character itself decodes to a space there, so its round_trip is false. A very long text is encoded whole, in a chunk of
its own. Ties between segmentations are broken as the model's library breaks them. Ids, repeated rows and other columns
are untouched (input columns named as the four results are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm.common import table

MARK = "▁"
#: The vocabulary file of the query: a parameter, never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct parts that a worker remembers; bytes of parts that are encoded as one text; ids that are verified at once.
CACHE, LINES, STEP = 500_000, 1 << 15, 1 << 18
# Fixed values of the format: model kinds and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_BLANK, _LETTER, _OTHER, _HIGH = 0, 1, 2, 10
_KIND = np.full(256, _HIGH, np.uint8)
_KIND[:128] = _OTHER
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[32] = _BLANK
_MARK_BYTES = MARK.encode()
#: Told from other parts: the first of a text, which has the dummy prefix.
_FIRST = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model(NamedTuple):
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    byte_fallback: bool
    unk: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool


def parse(data: bytes) -> Model:
    pieces, scores, types = [], [], []
    trainer: dict = {}
    normaliser: dict = {}
    for field, value in _fields(data):
        if field == 1:
            one = dict(_fields(value))
            pieces.append(one.get(1, b"").decode())
            scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            types.append(one.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    return Model(pieces, scores, types, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that form a piece, best score first."""
    known = {p for p, t in zip(model.pieces, model.types) if t in (NORMAL, USER)}
    ids = {p: i for i, p in enumerate(model.pieces)}
    found = []
    for i, (p, t) in enumerate(zip(model.pieces, model.types)):
        if t == NORMAL:
            found += [(-model.scores[i], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(a, b) for *_, a, b in sorted(found)]


def backend(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, p in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), model.unk, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk], byte_fallback=model.byte_fallback, fuse_unk=True, cache_capacity=0)
    else:
        raise ValueError(f"model kind {model.kind} is not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Replace(" ", MARK)] + ([normalizers.Prepend(MARK)] if model.dummy_prefix else [])
    out.normalizer = normalizers.Sequence(steps)
    out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


class Codec:
    """A model with a memory of parts. encode() gives the ids of many texts, decode() the texts of ids, parity() compares."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse(data)
        self.tokenizer = backend(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        bodies = [p.lstrip(MARK) for p, t in zip(self.model.pieces, self.model.types) if t in (NORMAL, USER)]
        if any(MARK in p or "\n" in p and p != "\n" for p in bodies):
            raise ValueError("a piece crosses a marker or a line end; parts can't be encoded alone")
        #: Whether ASCII letters and other ASCII never stand side by side in a piece, so that parts end between them too.
        self.fine = self.model.kind == BPE and not any(re.search(r"[A-Za-z][\x00-@\[-`{-\x7f]|[\x00-@\[-`{-\x7f][A-Za-z]", p) for p in bodies)
        #: The pipeline for parts of normalised texts: without normalising again, and without the dummy prefix.
        self.inner = backend(self.model._replace(charsmap=b"", squeeze=False, dummy_prefix=False))
        #: The id of a line end, which byte fallback or a piece of its own gives; None where it has none.
        self.line = next((x for x in self.inner.encode("\n", add_special_tokens=False).ids if x != self.model.unk), None)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.begin, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def parts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the parts and, for each text, the index of its first part (one more at the end)."""
        kind = _KIND[buf]
        cut = np.zeros(len(buf) + 1, bool)
        left, right = kind[:-1], kind[1:]
        cut[1:-1] = (right == _BLANK) & (left != _BLANK)
        if self.fine:
            cut[1:-1] |= left + right == _LETTER + _OTHER
        cut[offs] = True
        starts = np.flatnonzero(cut[:-1])
        return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)

    def _ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts and how many each has, from multithreaded batches of lines: a part stands between two line ends,
        which no piece crosses and each of which has an id of its own. Without such an id, parts are encoded one by one."""
        size = ends - starts + lead
        at = np.cumsum(size + 1) - size
        text = np.full(int(size.sum()) + len(size) + 1, 10, np.uint8)
        text[at[lead]] = 32
        where = np.repeat(at + lead - starts, ends - starts)
        from_ = np.arange(len(where)) + np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts)
        text[from_ + where] = buf[from_]
        if self.line is None:
            mine = [e.ids for e in self.inner.encode_batch_fast([text[x : x + n].tobytes().decode("utf-8", "surrogatepass") for x, n in zip(at, size)], add_special_tokens=False)]
            counts = np.fromiter(map(len, mine), np.int64, len(mine))
            return np.fromiter(chain.from_iterable(mine), np.int32, int(counts.sum())), counts
        # Lines are joined into texts of about LINES bytes; each text begins and ends with a line end.
        last = np.flatnonzero(np.diff((at + size) // LINES, append=-1))
        cut = np.concatenate(([0], (at + size)[last]))
        texts = [text[x : y + 1].tobytes().decode("utf-8", "surrogatepass") for x, y in zip(cut[:-1], cut[1:])]
        flat, ends_in = [], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), ends - starts), buf[from_] == 10, len(size)).astype(np.int64) + 1)
        gone = 0
        counts = np.zeros(len(size), np.int64)
        for i, (e, hi) in enumerate(zip(self.inner.encode_batch_fast(texts, add_special_tokens=False), last + 1)):
            lo = last[i - 1] + 1 if i else 0
            ids = np.array(e.ids, np.int32)
            lines = np.flatnonzero(ids == self.line)
            stop = lines[ends_in[lo:hi] - gone]
            begin = np.concatenate((lines[:1], stop[:-1])) + 1
            counts[lo:hi] = stop - begin
            flat.append(K.gather(ids, begin, stop - begin))
            gone = int(ends_in[hi - 1])
        return np.concatenate(flat), counts

    def _learn(self, keys: list[int], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> None:
        found, sizes = self._ids(buf, starts, ends, lead)
        n = len(self.known)
        while n + len(keys) > len(self.begin):
            self.begin, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.sizes))
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(found)] = found
        at = slice(n, n + len(keys))
        self.begin[at], self.sizes[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.used += len(found)

    def encode_bytes(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of normalised texts one after the other, and the number of ids of each.

        Parts are told apart by 64-bit hashes of their bytes, so only the distinct ones of a chunk are looked up.
        """
        if len(self.known) > CACHE:
            self.forget()
        starts, ends, first = self.parts(buf, offs)
        keys = K.word_hashes(buf, starts, ends)
        lead = np.zeros(len(starts), bool)
        lead[first[:-1][np.diff(first) > 0]] = self.model.dummy_prefix
        keys[lead] ^= _FIRST
        distinct, one, back = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        fresh = [i for i, k in enumerate(names) if k not in self.known]
        if fresh:
            new = one[fresh]
            self._learn([names[i] for i in fresh], buf, starts[new], ends[new], lead[new])
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[back]
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))[first]
        return K.gather(self.ids, self.begin[at], sizes), np.diff(total)

    def flat(self, texts: list[str], buf: np.ndarray | None = None, offs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text. `buf` and `offs` hold the texts' bytes, if the
        caller has them."""
        if buf is None or self.model.charsmap or self.model.squeeze or _MARK_BYTES in buf.tobytes():
            raw = [self._normal(t).encode("utf-8", "surrogatepass") for t in texts]
            buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, raw)), dtype=np.int64)))
        return self.encode_bytes(buf, offs)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """As flat(), with the ids text by text."""
        ids, n = self.flat(texts)
        return ids, n, _lists(ids, n)

    def verified(self, texts: list[str], ids: np.ndarray, counts: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """parity of each text, and whether its ids decode to it; some texts at a time, as lists of ids are large."""
        edge, parity, same = np.concatenate(([0], np.cumsum(counts))), [], []
        cut = np.flatnonzero(np.diff(edge[1:] // step, prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:]):
            lists = _lists(ids[edge[a] : edge[b]], counts[a:b])
            parity.append(self.parity(texts[a:b], lists))
            same += map(eq, self.decode(lists), texts[a:b])
        return np.concatenate(parity) if parity else np.zeros(0, bool), np.array(same, bool)

    def parity(self, texts: list[str], lists: list[list[int]]) -> np.ndarray:
        """Whether sentencepiece gives each whole text the same ids."""
        return np.fromiter(map(eq, lists, self.reference.encode(texts, num_threads=1)), bool, len(texts))

    def _normal(self, text: str) -> str:
        """The normalised text with blanks for markers, without the dummy prefix."""
        if text and (self.model.charsmap or self.model.squeeze):
            text = self.tokenizer.normalizer.normalize_str(text)
            text = text[1:] if self.model.dummy_prefix and text[:1] == MARK else text
        return text.replace(MARK, " ")

    def decode(self, lists: list[list[int]]) -> list[str]:
        """The texts that the pipeline's decoder makes of ids; the dummy prefix is taken off."""
        # One by one: as a batch over all cores it took 2.6 times the CPU.
        return [self.tokenizer.decode(x, skip_special_tokens=False) for x in lists]


def _lists(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    flat, ends = ids.tolist(), np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(4)
def codec(data: bytes) -> Codec:
    """One codec for each worker and model."""
    return Codec(data)


def encode(df: DataFrame, model: str = MODEL, text: str = "text", carry: bool = True) -> DataFrame:
    """df with n_tokens, token_ids, parity and round_trip; the text is left out unless carried. The model's bytes (about
    0.5 MB) go with the task."""
    with open(model, "rb") as f:
        data = f.read()
    new = {"n_tokens": "long", "token_ids": "array<int>", "parity": "boolean", "round_trip": "boolean"}
    sent = [c for c in df.columns if c not in new]
    keep = [c for c in sent if carry or c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", {k} {v}" for k, v in new.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data)
        for rows, buf, offs in K.chunks(batches, text, 1 << 22):
            texts = [x or "" for x in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            ids, counts = c.flat(texts, buf, offs)
            parity, same = c.verified(texts, ids, counts)
            edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            made = [pa.array(counts), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)), pa.array(parity), pa.array(same)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(k)) for k in keep] + made, [*keep, *new])

    return df.select(*sent).mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids; the text is left out, as the ids hold it."""
    return encode(docs, carry=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return encode(docs.select("doc_id", chars.alias("n_chars"), "text"), carry=False)
