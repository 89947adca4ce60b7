"""Substring dedup by repeated-phrase automata.

A window is 35 consecutive words. Words that lie in a window whose word sequence starts anywhere else are removed.

Equal texts are one text with its number of rows. Of the 8-word phrases in a window the one with the least hash is its
anchor, so equal windows have equal anchors, and a text has far fewer anchors than windows.

1. Anchors are counted over all documents. A window can only recur if its anchor does, so of every document only the
   stretches whose windows have a repeated anchor are of interest: nothing outside them can hold an occurrence.
2. Confirmation: equal stretches are added up and meet by anchor; windows that occur twice or more (as text, not as hash)
   are confirmed, and runs of confirmed windows are the passages. Only the passages' texts go on, each once an anchor.
   Stretches of very frequent anchors are cut into their windows, which then have groups of their own.
3. Automata: passages are packed into shards of bounded size, each compiled once into an Aho-Corasick automaton
   (pyahocorasick). All documents are streamed through the shards of their stretches' anchors to locate every occurrence;
   very frequent windows have copies of their shard, among which the documents are dealt.
4. Places go back to the texts, whose other words are kept, and from these to the rows.

Every step's work grows with the texts: an automaton only meets stretches that share an anchor with it.

Defined results: a null text has no words. Words are cut at the six ASCII blanks and kept unchanged. A very long text is
read in one piece. Rows go by their texts, so ids may repeat or be null; a repeated row counts as another occurrence. An
empty table gives an empty table. Other columns are carried by `stage` only, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm.common import fresh_path, join_counted, packed, partitions, spill, table, text_of
from curatrix.llm.near_dedup import NO_ID, _edges, _groups, text_key

WINDOW, ANCHOR = 35, 8
#: An anchor with more stretches is split by window. Characters of the passages of a shard.
FREQUENT, SHARD = 2_000, 1 << 19


class Text:
    """Words and anchors of the documents of a chunk."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        starts, ends, self.first = K.words(buf, offs)
        self.hashes = K.word_hashes(buf, starts, ends)
        # The texts' words, each followed by one space.
        size = ends - starts + 1
        padded = np.append(buf, np.uint8(32))
        self.plain = K.gather(padded, starts, size)
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.plain[self.at[1:] - 1] = 32
        grams = K.grams(self.hashes, anchor)
        width = window - anchor + 1
        value, place, have = grams, np.arange(len(grams)), 1
        while have < width and len(value):
            step = min(have, width - have)
            right = value[step:] <= value[:-step] if step < len(value) else np.zeros(0, bool)
            n = len(right)
            value, place = np.where(right, value[step : step + n], value[:n]), np.where(right, place[step : step + n], place[:n])
            have += step
        windows = K.within(self.first, window)
        doc = K.owners(self.first)[windows]
        spot = place[windows] if len(windows) else windows
        new = np.ones(len(windows), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        last = np.concatenate((head[1:], [len(windows)])) - 1
        #: For each segment: its document, the anchor's hash, and its first and last window (as words of the chunk).
        self.doc, self.anchor = doc[head], (grams[spot[head]] if len(head) else grams[:0]).view(np.int64)
        self.from_, self.to = windows[head], windows[last] if len(head) else windows[:0]

    def words(self, a: int, b: int) -> bytes:
        return self.plain[self.at[a] : self.at[b] - 1].tobytes() if b > a else b""


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, tk (the text's md5), n_words, full_sha256 and the anchors of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            t = Text(buf, offs)
            n = rows.num_rows
            sha = [hashlib.sha256(t.words(a, b)).hexdigest() for a, b in zip(t.first[:-1], t.first[1:])]
            cut = np.searchsorted(t.doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(t.first)), pa.array(sha), pa.ListArray.from_arrays(pa.array(cut), pa.array(t.anchor))], ["doc_id", "tk", "n_words", "full_sha256", "anchors"])

    t = text_of(docs)
    return docs.select("doc_id", text_key(t).alias("tk"), t.alias("text")).mapInArrow(run, "doc_id long, tk binary, n_words long, full_sha256 string, anchors array<long>")


def repeated(texts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """texts: tk, rid, n (rows), anchors. For each: `found`, its repeated anchors, and those among them that are very
    frequent, `hot`, with the number of shards' copies among which their windows are dealt, `slices`."""
    each = texts.select("tk", "rid", F.col("n").alias("copies"), F.explode("anchors").alias("anchor"))
    counts = spill(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all")).where("all > 1").drop("all"), "phrase-counts")
    hot = F.collect_set(F.when(F.col("n") > frequent, F.struct("anchor", F.ceil(F.col("n") / max(1, frequent)).cast("int").alias("slices"))))
    held = join_counted(each, counts, ["anchor"], frequent).groupBy("tk", "rid", "copies").agg(F.collect_set("anchor").alias("found"), hot.alias("hot"))
    return held.select("tk", "rid", F.col("copies").alias("n"), "found", F.transform("hot", lambda x: x["anchor"]).alias("hot"), F.transform("hot", lambda x: x["slices"]).alias("slices"))


def stretches(held: DataFrame) -> DataFrame:
    """held: tk, n, text, found, hot, slices. For each repeated anchor of a text the words of all windows that it stands for
    (or each of these windows, where the anchor is hot): gkey, slice, slices, tk, n, at (the first word), seg."""
    spec = "gkey long, slice int, slices int, tk binary, n long, at int, seg string"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary())

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        columns[6] = columns[6].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in spec.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            t = Text(buf, offs)
            tk, n = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            cut = np.searchsorted(t.doc, np.arange(rows.num_rows + 1))
            out: list[tuple] = []
            for d in range(rows.num_rows):
                found = np.asarray(rows.column(3)[d].values.to_numpy(zero_copy_only=False), np.int64)
                hot = dict(zip(rows.column(4)[d].as_py(), rows.column(5)[d].as_py()))
                mine = np.arange(cut[d], cut[d + 1])
                for s in mine[np.isin(t.anchor[mine], found)]:
                    a, b, key, first = int(t.from_[s]), int(t.to[s]), int(t.anchor[s]), int(t.first[d])
                    if key in hot:
                        deal = int.from_bytes(tk[d][:4], "little") % hot[key]
                        for i in range(a, b + 1):
                            text = t.words(i, i + t.window)
                            split = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                            out.append((split, deal, hot[key], tk[d], n[d], i - first, text))
                    else:
                        out.append((key, 0, 1, tk[d], n[d], a - first, t.words(a, b + t.window)))
                    if len(out) >= 20_000:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    return held.select("tk", "n", "text", "found", "hot", "slices").mapInArrow(run, spec)


def confirm(group: list[tuple[str, int]], window: int = WINDOW) -> set[str]:
    """The passages of a group of (stretch, occurrences): runs of windows that occur twice or more."""
    cuts, seen = [], {}
    for text, n in group:
        ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
        begins = [0, *(e + 1 for e in ends[:-1])]
        spans = [(begins[i], ends[i + window - 1]) for i in range(len(begins) - window + 1)]
        cuts.append(spans)
        if len(group) > 1 or n == 1:
            for a, b in spans:
                w = text[a:b]
                seen[w] = seen.get(w, 0) + n
    out = set()
    for (text, n), spans in zip(group, cuts):
        start = end = -1
        for a, b in spans:
            if n > 1 or seen[text[a:b]] > 1:
                start, end = (a if start < 0 else start), b
            elif start >= 0:
                out.add(text[start:end])
                start = -1
        if start >= 0:
            out.add(text[start:end])
    return out


def passages(parts: DataFrame) -> DataFrame:
    """gkey, slices and the texts of the confirmed passages of each group, as seg."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(it, 1, 4 << 20, lambda b: b.column(2).nbytes):
            gkey, slices, seg, n = (part.column(k).to_pylist() for k in ("gkey", "slices", "seg", "n"))
            edge = _edges(part)
            rows = [(gkey[a], slices[a], x) for a, b in zip(edge[:-1], edge[1:]) for x in confirm(list(zip(seg[a:b], n[a:b])))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], ["gkey", "slices", "seg"])

    counted = parts.groupBy("gkey", "seg").agg(F.max("slices").alias("slices"), F.sum("n").alias("n")).select("gkey", "slices", "seg", "n")
    n = partitions(parts.sparkSession)
    return counted.repartition(n, "gkey").sortWithinPartitions("gkey").mapInArrow(run, "gkey long, slices int, seg string")


def locate(automaton, text: str) -> list[int]:
    """Word ranges (from, to, from, to, ...) that the passages in a text cover; matches within a word don't count."""
    spans: list[list[int]] = []
    for end, size in automaton.iter(text):
        i, j = end + 1 - size, end + 1
        if (i and text[i - 1] != " ") or (j < len(text) and text[j] != " "):
            continue
        while spans and spans[-1][0] >= i:
            spans.pop()
        if spans and spans[-1][1] >= i:
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    return [x for i, j in spans for x in (text.count(" ", 0, i), text.count(" ", 0, j) + 1)]


def automata(texts: set[str], shard: int = SHARD) -> Iterator:
    """The automata of passages, each of at most `shard` characters (or one passage)."""
    import ahocorasick

    made, size = ahocorasick.Automaton(), 0
    for x in sorted(texts):
        if size and size + len(x) > shard:
            made.make_automaton()
            yield made
            made, size = ahocorasick.Automaton(), 0
        made.add_word(x, len(x))
        size += len(x)
    if size:
        made.make_automaton()
        yield made


def occurrences(found: DataFrame, parts: DataFrame, shard: int = SHARD) -> DataFrame:
    """Streams all stretches through the shards of their groups' passages: tk and spans (words of the text from, to, ...)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(it, 2, 4 << 20, lambda b: b.column(4).nbytes):
            gkey, slice_, tk, at, seg = (part.column(k).to_pylist() for k in range(5))
            texts, held, size = set(), [], 0
            for i in range(len(seg) + 1):
                # A shard ends with a group, once it has its characters.
                if i == len(seg) or size >= shard and (gkey[i], slice_[i]) != (gkey[i - 1], slice_[i - 1]):
                    rows = [(tk[j], [x + at[j] for x in spans]) for automaton in automata(texts, shard) for j in held if (spans := locate(automaton, seg[j]))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.list_(pa.int32())))], ["tk", "spans"])
                    texts, held, size = set(), [], 0
                if i < len(seg):
                    if tk[i] is not None:
                        held.append(i)
                    elif seg[i] not in texts:
                        texts.add(seg[i])
                        size += len(seg[i])

    each = found.select("gkey", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("binary").alias("tk"), F.lit(0).alias("at"), "seg")
    both = each.unionByName(parts.select("gkey", "slice", "tk", "at", "seg"))
    n = partitions(parts.sparkSession)
    # The passages of a group come first, as they have no tk.
    dealt = both.repartition(n, "gkey", "slice").sortWithinPartitions("gkey", "slice", F.col("tk").asc_nulls_first())
    return dealt.mapInArrow(run, "tk binary, spans array<int>")


def removals(docs: DataFrame, marks: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """tk, n (rows), n_removed and kept (the other words, joined by one space) of the texts that lose words."""
    rid = F.coalesce("doc_id", F.lit(NO_ID))
    texts = spill(marks.where(F.size("anchors") > 0).groupBy("tk").agg(F.min(rid).alias("rid"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors")), "phrase-rows")
    t = text_of(docs)
    source = docs.select(text_key(t).alias("tk"), rid.alias("rid"), t.alias("text"))
    held = _packed(source.join(repeated(texts, frequent), ["tk", "rid"]).dropDuplicates(["tk", "rid"]), "phrase-texts")
    parts = _packed(stretches(held), "phrase-stretches")
    places = occurrences(spill(passages(parts), "phrase-passages"), parts)
    by_text = places.groupBy("tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            starts, ends, first = K.words(buf, offs)
            lost, kept = [], []
            for d in range(rows.num_rows):
                n = int(first[d + 1] - first[d])
                pairs = np.asarray(rows.column(3)[d].values.to_numpy(zero_copy_only=False), np.int64).reshape(-1, 2)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, pairs[:, 0], 1)
                np.add.at(step, pairs[:, 1], -1)
                gone = np.cumsum(step)[:n] > 0
                stay = np.flatnonzero(~gone) + first[d]
                lost.append(int(gone.sum()))
                kept.append(b" ".join(buf[a:b].tobytes() for a, b in zip(starts[stay], ends[stay])))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["tk", "n", "n_removed", "kept"])

    return held.select("tk", "n", "text").join(by_text, "tk").select("tk", "n", "text", "spans").mapInArrow(run, "tk binary, n long, n_removed long, kept string")


def _packed(df: DataFrame, name: str) -> DataFrame:
    """As spill(), with the stronger compression that overlapping texts are worth."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    marks = spill(anchors(docs), "phrase-anchors")
    lost = spill(removals(docs, marks, frequent).select("tk", "n", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha")), "phrase-kept")
    joined = join_counted(marks.drop("anchors"), lost, ["tk"], frequent, how="left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "full_sha256").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring passages. Texts that lose nothing stay as they are; texts that lose every word go."""
    marks = spill(anchors(docs), "phrase-anchors")
    lost = spill(removals(docs, marks), "phrase-kept")
    # What is kept of a text with copies is '' (all its windows recur), so the broadcast part of the join is small.
    keyed = docs.select(packed(docs).alias("row"), text_key(text_of(docs)).alias("tk"))
    joined = join_counted(keyed, lost, ["tk"], FREQUENT, how="left").where("n_removed IS NULL OR kept <> ''")
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(F.when(F.col("kept").isNull(), F.col(f"row.`{c}`")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
t AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, i + j AS i FROM t, (SELECT unnest(range(0, {WINDOW})) AS j)),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
k AS (SELECT d.r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN g USING (r, i) WHERE g.r IS NULL GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
