"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are five words, weighted by how often they occur. Every shingle sends exponential arrivals at a rate of its
weight to random registers, in rounds; a shingle stops once its next arrival is later than every register of its
document (early termination). Two signatures agree in a register with the probability Jaccard of the weighted sets.

1. Exact copies (equal texts) become one vertex before anything else, so groups of copies cost one text.
   Texts in which a shingle recurs are signed a second time as plain sets (all weights 1), as verification is by sets and
   very unequal counts would hide a link; for all other texts the two signatures are the same.
2. Bands of five registers give buckets. Within a bucket only pairs whose signatures agree enough are kept, and of these
   only a spanning forest: no list of pairs is made. Texts connected by such links form a cell.
3. Cells are verified on their whole texts: a document is compared with all others of its cell at once by an inverted
   index of shingles; documents that the most central text has already joined are not compared with each other, as that
   can't change a class. Links (Jaccard of the shingle sets of at least 0.8) make the classes.
4. Large buckets and cells are dealt out in blocks with a few pivots; only members that these don't connect with most of
   their group meet all its blocks (`links`).

A text with fewer than five words is one shingle. Defined results: a null text is '', and texts without words are
equal only to texts equal to them. The class is the smallest id in it (null where no row of the class has an id). Rows
of one id are told apart by their texts; repeated rows are copies. A very long text is signed and compared whole. An
empty table gives an empty table. Other columns are carried by `stage` only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm import kernels as K
from curatrix.llm.common import components, packed, partitions, row_hash, spill, table, text_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Signatures that agree less than this (over four standard deviations under 0.8) are not verified.
ESTIMATE = 0.65
#: Members of a block of a bucket; documents and characters of a block of a cell; blocks that give a pivot each.
BUCKET, BLOCK, BLOCK_CHARS, PIVOTS = 512, 2048, 16 << 20, 4
NO_ID = -(1 << 63)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document and shingle."""
    starts, ends, first = K.words(buf, offs)
    h = K.word_hashes(buf, starts, ends)
    at = K.within(first, k)
    doc, value = K.owners(first)[at], K.grams(h, k)[at]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        mixed = h + (np.arange(len(h)) - np.repeat(first[:-1], counts)).astype(np.uint64) * K.U(0x9E3779B97F4A7C15)
        one = np.array([K.mix(np.array([K.mix(mixed[first[i] : first[i + 1]]).sum()], np.uint64))[0] for i in short], np.uint64)
        doc, value = np.concatenate((doc, short)), np.concatenate((value, one))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate((at, [len(doc)])))


def prob_min_hash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The winning element of each register: n rows of m."""
    time, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    arrival = np.zeros(len(doc))
    live, round_ = np.arange(len(doc)), 0
    limit = np.full(n, np.inf)
    while len(live):
        s = K.mix(value[live] + K.U((round_ * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        arrival[live] -= np.log(K.uniform(s)) / weight[live]
        register = ((K.mix(s ^ K.U(0xA0761D6478BD642F)) >> K.U(32)) * K.U(m) >> K.U(32)).astype(np.int64)
        cell, now = doc[live] * m + register, arrival[live]
        better = np.flatnonzero(now < time[cell])
        np.minimum.at(time, cell[better], now[better])
        won = better[time[cell[better]] == now[better]]
        winner[cell[won]] = value[live[won]]
        touched = np.unique(doc[live])
        limit[touched] = time.reshape(n, m)[touched].max(1)
        live = live[arrival[live] < limit[doc[live]]]
        round_ += 1
    return winner.reshape(n, m)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tk (the text's md5), chars and the signatures of every row: bands and sig by counts, and as a plain set where
    that differs (else null: plain_bands and plain_sig). All are null for texts without words."""

    def signed(w: np.ndarray, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Bands and shortened registers of the rows `at`, null elsewhere."""
        band = np.zeros((len(at), BANDS), np.uint64)
        for j in range(ROWS):
            band = K.mix(band * K.U(0xC2B2AE3D27D4EB4F) + w[:, j::ROWS])
        bands, sigs = [None] * n, [None] * n
        for i, b, s in zip(at.tolist(), band.view(np.int64).tolist(), (K.mix(w) >> K.U(48)).astype(np.uint16)):
            bands[i], sigs[i] = b, s.tobytes()
        return pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in K.chunks(it):
            n = rows.num_rows
            doc, value, count = shingles(buf, offs)
            some, again = np.unique(doc), np.unique(doc[count > 1])
            mine = np.isin(doc, again)
            full = signed(prob_min_hash(np.searchsorted(some, doc), value, count.astype(np.float64), len(some)), some, n)
            plain = signed(prob_min_hash(np.searchsorted(again, doc[mine]), value[mine], np.ones(int(mine.sum())), len(again)), again, n)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(offs)), *full, *plain], ["doc_id", "tk", "chars", "bands", "sig", "plain_bands", "plain_sig"])

    t = text_of(docs)
    return docs.select("doc_id", text_key(t).alias("tk"), t.alias("text")).mapInArrow(run, "doc_id long, tk binary, chars long, bands array<long>, sig binary, plain_bands array<long>, plain_sig binary")


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins i with others; gives those that weren't in its tree before, one for each tree."""
        roots = self.roots()
        new, pick = np.unique(roots[others], return_index=True)
        other = new != roots[i]
        self.up[new[other]] = roots[i]
        return others[pick[other]]


def _groups(it: Iterator[pa.RecordBatch], keys: int, limit: int, weigh) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first `keys` columns, which are sorted), of about `limit` by weigh(batch)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in it:
        if not batch.num_rows:
            continue
        if size >= limit and held:
            last = [held[-1].column(k)[-1] for k in range(keys)]
            cut = 0
            while cut < batch.num_rows and all(batch.column(k)[cut] == last[k] for k in range(keys)):
                cut += 1
            if cut < batch.num_rows:
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += weigh(batch)
    if held:
        yield pa.Table.from_batches(held)


def _edges(of: pa.Table) -> np.ndarray:
    """Starts of the runs of equal keys (first column), and the end."""
    key = np.asarray(of.column(0).to_pandas().to_numpy())
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def links_of_buckets(members: DataFrame) -> DataFrame:
    """members: key, tk, load (signatures). A spanning forest of the pairs of each key whose signatures agree in at least
    ESTIMATE of the registers."""
    least = int(np.ceil(ESTIMATE * REGISTERS))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, 1, 20_000, lambda b: b.num_rows):
            tk = group.column("tk").to_pylist()
            sig = np.frombuffer(b"".join(group.column("load").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            edge = _edges(group)
            out: list[tuple[bytes, bytes]] = []
            for a, b in zip(edge[:-1], edge[1:]):
                n = b - a
                if n == 2:
                    if (sig[a] == sig[a + 1]).sum() >= least and tk[a] != tk[a + 1]:
                        out.append((tk[a], tk[a + 1]))
                    continue
                # Members that the first has joined are not compared with each other.
                forest, todo = Forest(n), [0]
                for i in todo:
                    hit = np.flatnonzero((sig[a:b] == sig[a + i]).sum(1) >= least)
                    out += [(tk[a + i], tk[a + j]) for j in forest.join(i, hit)]
                    if i == 0:
                        roots = forest.roots()
                        todo.extend(np.flatnonzero(roots != roots[0]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    n = partitions(members.sparkSession)
    return members.select("key", "tk", "load").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary").distinct()


def verified(first: np.ndarray, value: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs with a Jaccard of at least SIMILAR; first: where each set starts in value."""
    n = len(first) - 1
    size = np.diff(first)
    _, ids = np.unique(value, return_inverse=True)
    doc = np.repeat(np.arange(n), size)
    spread = np.bincount(ids)[ids] if len(ids) else ids
    order = np.argsort(-np.bincount(doc, spread, n), kind="stable")
    forest, out = Forest(n), []

    def index(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(keep[doc])
        at = at[np.argsort(ids[at], kind="stable")]
        return doc[at], np.searchsorted(ids[at], np.arange(ids.max(initial=-1) + 2))

    outside = np.ones(n, bool)
    held, begin = index(outside)
    for turn, i in enumerate(order):
        mine = ids[first[i] : first[i + 1]]
        met = K.gather(held, begin[mine], begin[mine + 1] - begin[mine])
        if not len(met):
            continue
        common = np.bincount(met, minlength=n)
        other = np.flatnonzero(common)
        hit = other[(common[other] >= SIMILAR * (size[i] + size[other] - common[other])) & (other != i)]
        if len(hit):
            out += [(int(i), int(j)) for j in forest.join(int(i), hit)]
        if turn == 0 and n > 8:
            roots = forest.roots()
            outside = roots != roots[i]
            if not outside.any():
                break
            held, begin = index(outside)
    return out


def links_of_cells(texts: DataFrame) -> DataFrame:
    """texts: key, tk, load (the text). Verified links of the texts of each key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, 1, 4 << 20, lambda b: b.column(2).nbytes):
            tk = group.column("tk").to_pylist()
            edge = _edges(group)
            buf, offs = K.utf8(group.column("load"))
            out: list[tuple[bytes, bytes]] = []
            for a, b in zip(edge[:-1], edge[1:]):
                doc, value, _ = shingles(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                first = np.searchsorted(doc, np.arange(b - a + 1))
                out += [(tk[a + i], tk[a + j]) for i, j in verified(first, value)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    n = partitions(texts.sparkSession)
    return texts.select("key", "tk", "load").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def links(meta: DataFrame, load: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], most: int, most_chars: int, name: str) -> DataFrame:
    """Links (a, b) that connect all similar members of each group, whatever the groups' sizes.

    meta: g (the group), tk, chars; load() adds `load` to such rows; compare() links the rows of equal `key`. A group of
    more than `most` members or `most_chars` characters is dealt out in blocks, each of which also gets one pivot of each
    of the first PIVOTS blocks. What that connects with most of its group is done: near copies of one text are, so they
    cost as many comparisons as they are. The others, in chunks, then meet every block and every chunk of their group.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("chars") / most_chars)).cast("int")
    large = spill(meta.groupBy("g").agg(size.alias("blocks")).where("blocks > 1"), f"{name}-large")
    keyed = lambda df, *of: df.select(F.xxhash64(*of).alias("key"), "tk", "load")
    if not large.limit(1).count():
        return compare(keyed(load(meta), "g"))
    small = compare(keyed(load(meta.join(large.select("g"), "g", "left_anti")), "g"))
    placed = meta.join(large, "g").withColumn("block", F.pmod(F.xxhash64("tk"), F.col("blocks")).cast("int"))
    big = spill(load(placed).select("g", "blocks", "block", "tk", "load"), f"{name}-big")
    pivot = big.where(F.col("block") < PIVOTS).groupBy("g", "blocks", "block").agg(F.min(F.struct(F.xxhash64("tk").alias("h"), "tk", "load")).alias("p"))
    everywhere = pivot.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "p.tk", "p.load")
    near = spill(compare(keyed(big.select("g", "block", "tk", "load").unionByName(everywhere), "g", "block")), f"{name}-near")
    # The members that are not connected with the most of their group.
    joined = components(near, f"{name}-joined").withColumnRenamed("v", "tk")
    trees = spill(big.select("g", "blocks", "block", "tk").join(joined, "tk", "left").withColumn("c", F.coalesce("c", "tk")), f"{name}-trees")
    counts = trees.groupBy("g", "c").agg(F.countDistinct("tk").alias("m"))
    main = counts.groupBy("g").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("all")).where("x.m < all")
    split = main.select("g", F.col("x.c").alias("main"), F.ceil((F.col("all") - F.col("x.m")) / most).cast("int").alias("chunks"))
    rest = spill(trees.join(split, "g").withColumn("chunk", F.when(F.col("c") != F.col("main"), F.pmod(F.xxhash64("tk", F.lit("chunk")), F.col("chunks")).cast("int"))), f"{name}-rest")
    if not rest.limit(1).count():
        return small.unionByName(near)
    out, inside = F.col("chunk").isNotNull(), F.col("chunk").isNull()
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("to")
    met = rest.where(inside).select("g", "tk", "block", to("chunks")).select("g", "tk", F.col("block").alias("x"), F.col("to").alias("y"), F.lit("block").alias("with"))
    met = met.unionByName(rest.where(out).select("g", "tk", "chunk", to("blocks")).select("g", "tk", F.col("to").alias("x"), F.col("chunk").alias("y"), F.lit("block").alias("with")))
    met = met.unionByName(rest.where(out).select("g", "tk", "chunk", to("chunks")).select("g", "tk", F.least("chunk", "to").alias("x"), F.greatest("chunk", "to").alias("y"), F.lit("chunk").alias("with")))
    loads = big.dropDuplicates(["g", "tk"]).select("g", "tk", "load")
    far = compare(keyed(met.distinct().join(loads, ["g", "tk"]), "g", "x", "y", "with"))
    return small.unionByName(near).unionByName(far)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tk) of docs, and for each text (tk) its class: class_id, class_tk, class_size, n_copies."""
    rows = spill(signatures(docs.select("doc_id", "text")), "near-signatures")
    texts = spill(rows.groupBy("tk").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("n_copies"), F.first("chars").alias("chars"), *(F.first(c).alias(c) for c in ("bands", "sig", "plain_bands", "plain_sig"))), "near-texts")
    signed = texts.select("tk", F.explode(F.array(F.struct(F.lit(False).alias("plain"), "bands", "sig"), F.struct(F.lit(True).alias("plain"), F.col("plain_bands").alias("bands"), F.col("plain_sig").alias("sig")))).alias("s")).select("tk", "s.*").where("bands is not null")
    banded = signed.select("tk", "plain", F.posexplode("bands").alias("band", "value")).select("tk", "plain", F.xxhash64("band", "value").alias("key"))
    # Buckets of two texts or more; the two signatures of one text don't make one.
    who = F.xxhash64("tk")
    shared = banded.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo < hi").select("key")
    members = spill(banded.join(shared, "key", "left_semi").select(F.col("key").alias("g"), "tk", "plain", F.lit(0).alias("chars")), "near-members")
    signature = signed.select("tk", "plain", F.col("sig").alias("load"))
    cells = components(links(members, lambda m: m.join(signature, ["tk", "plain"]), links_of_buckets, BUCKET, 1, "near-buckets"), "near-cells")
    # Cells, then the texts of their members (one row for each text).
    inside = cells.join(texts.select(F.col("tk").alias("v"), F.coalesce("rid", F.lit(NO_ID)).alias("rid"), "chars"), "v").select(F.xxhash64("c").alias("g"), F.col("v").alias("tk"), "rid", "chars")
    t = text_of(docs)
    source = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), text_key(t).alias("tk"), t.alias("load"))
    found = links(inside, lambda m: source.join(m, ["rid", "tk"]), links_of_cells, BLOCK, BLOCK_CHARS, "near-blocks")
    links_ = components(found, "near-classes")
    labelled = texts.join(links_.withColumnRenamed("v", "tk"), "tk", "left").select("tk", "rid", "n_copies", F.coalesce("c", "tk").alias("c"))
    best = F.min(F.struct(F.col("rid").isNull().alias("none"), F.col("rid").alias("rid"), F.col("tk").alias("tk")))
    heads = labelled.groupBy("c").agg(best.alias("best"), F.sum("n_copies").alias("class_size"))
    return rows.select("doc_id", "tk"), labelled.join(heads, "c").select("tk", F.col("best.rid").alias("class_id"), F.col("best.tk").alias("class_tk"), "class_size", "n_copies")


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size (rows) and n_copies (rows with the same text) of each row."""
    rows, by_text = classes(docs)
    return rows.join(by_text, "tk").select("doc_id", "class_id", "class_size", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, that with the smallest id; of rows with one id and text that with the least hash of its
    other columns. All columns are carried, whatever their names."""
    _, by_text = classes(docs)
    kept = by_text.where("tk = class_tk").select(F.coalesce("class_id", F.lit(NO_ID)).alias("rid"), "tk")
    keyed = docs.select(packed(docs).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), text_key(text_of(docs)).alias("tk"), row_hash(docs, ("doc_id", "text")).alias("rank"))
    one = Window.partitionBy("rid", "tk").orderBy("rank")
    return keyed.join(kept, ["rid", "tk"]).withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(table(spark, sf_dir, "documents"))


# Shingles as text; equal texts are one, and so are two sets of a Jaccard of at least SIMILAR, step by step.
SQL = f"""
WITH RECURSIVE d AS (SELECT coalesce(text, '') AS x, min(doc_id) AS rid, count(*) AS n FROM documents GROUP BY 1),
v AS (SELECT row_number() OVER (ORDER BY rid NULLS LAST, x) AS v, x, rid, n, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
s AS (SELECT DISTINCT v, g FROM (SELECT v, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM v)),
z AS (SELECT v, count(*) AS z FROM s GROUP BY v),
c AS (SELECT a.v AS a, b.v AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.v < b.v GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN z x ON x.v = a JOIN z y ON y.v = b WHERE c >= {SIMILAR} * (x.z + y.z - c)),
twoway AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT v AS a, v AS b FROM v UNION SELECT r.a, twoway.b FROM r JOIN twoway ON r.b = twoway.a),
k AS (SELECT a AS v, min(b) AS c FROM r GROUP BY a),
g AS (SELECT c, min(rid) AS class_id, CAST(sum(n) AS BIGINT) AS class_size FROM k JOIN v USING (v) GROUP BY c)
SELECT doc_id, class_id, class_size, v.n AS n_copies FROM documents JOIN v ON coalesce(text, '') = x JOIN k USING (v) JOIN g USING (c)"""
