"""Edge cases and brute force for the ten operators and the pipeline's stages."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm import hash_tree, language_id, line_crf, merkle, near_dedup, phrase_automata, poisson_mix, quality_rules, sentencepiece_codec, warc_index

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
EN, DE = "the of and ring light stone water house".split(), "der die und nicht haus wasser stein licht".split()


def sentence(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "en"]) + str(rng.randrange(400)) for _ in range(n)) + "."


def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties, repeated rows and a very long text."""
    texts = [sentence(EN if i % 2 else DE, 40 + i) for i in range(40)]
    passage = sentence(EN, 60)
    texts += [texts[0]] * 5 + [texts[1].replace(" ", "\n")] + [t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :] for t in texts[2:6]]
    words = texts[7].split(" ")
    texts += [" ".join(words[:20] + ["new"] + words[20:]), " ".join(words[:-1])]
    texts += [None, "", "   \n", "one", "one", "é ü\tß", "a b c d", "Of Of Of Of Of " * 30, sentence(EN, 30_000)]
    rows = [(i, t, "de" if t and i < 40 and i % 2 == 0 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], None, None, None), (None, None, None, None, None), (7, "another text with an id that is taken", "en", "s0", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pieces = language_id.vocabulary()
    model = language_id.train(empty, pieces)
    w, trans = line_crf.train(empty, labels)
    makers = [
        lambda d: language_id.predict(d, pieces, *model), merkle.edited, quality_rules.judge, near_dedup.membership, lambda d: line_crf.score(d, w, trans),
        lambda d: poisson_mix.replicate(d, {"s1": 2.0}), phrase_automata.report, hash_tree.assign, sentencepiece_codec.encode,
    ]
    for make in makers:
        assert make(empty).count() == 0
        extra = docs.limit(8).selectExpr("*", "1 as score", "2 as key", "3 as part", "'x' as shard", "4 as n_words", "5 as copy", "6 as tk", "7 as v", "8 as n_tokens", "9 as kept")
        assert make(extra).count() >= 0
    for stage in (quality_rules.stage, near_dedup.stage, phrase_automata.stage, poisson_mix.stage):
        assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").count() == 0
    assert sentencepiece_codec.stage(spark, empty, "").count() == 0
    assert warc_index.history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_id(docs):
    pieces = language_id.vocabulary()
    langs, p = language_id.train(docs, pieces)
    got = language_id.predict(docs, pieces, langs, p).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r[0]: r for r in docs.collect()}
    assert all(r.lang_pred == by[r.doc_id].lang for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id not in (7,))
    assert {r.lang_pred for r in got if r.doc_id is not None and not re.search(r"[^\W\d_]", by[r.doc_id].text or "")} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_lattice_sums_all_segmentations():
    import numpy as np

    lattice = language_id.Lattice(["a", "b", "ab", "ba"])
    p = np.array([[0.3], [0.2], [0.1], [0.25], [0.01], [0.0]])
    want = 0.3 * 0.2 * 0.3 + 0.1 * 0.3 + 0.3 * 0.25
    assert np.exp(lattice.log_likelihood(["aba"], p))[0, 0] == pytest.approx(want)


def test_merkle(docs):
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (doc, t) in enumerate(rows):
        k, n = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want[doc, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest(), merkle.fingerprint(t)] += 1
    for parts in (1, 4):
        got = merkle.edited(docs) if parts == 4 else merkle.edited(docs.coalesce(1))
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got.collect()) == want
    a, b = "first line.\nsecond line.\nthird", "first line.\nsecond row.\nthird"
    assert merkle.locate(merkle.fingerprint(a), merkle.fingerprint(b)) and 0 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1


def repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_rules(spark, docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeats(w)
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    assert got == want
    assert quality_rules.stage(spark, docs, "").columns == docs.columns


def components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (texts[i] or "") == (texts[j] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_near_dedup(spark, docs):
    rows = docs.collect()
    label = components([r.text for r in rows])
    groups = defaultdict(list)
    for r, g in zip(rows, label):
        groups[g].append(r.doc_id)
    want = Counter((r.doc_id, min((x for x in groups[g] if x is not None), default=None), len(groups[g])) for r, g in zip(rows, label))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.membership(docs).collect()) == want
    assert near_dedup.stage(spark, docs, "").count() == len(groups)


def test_links_hold_however_often_shingles_recur(spark):
    """Sets that agree although the counts of a few shingles differ a hundredfold; and classes of several sizes."""
    base = [sentence(EN, 60) for _ in range(30)]
    loop = " ".join(sentence(EN, 9) for _ in range(1))
    texts = [t + " " + loop for t in base] + [t + (" " + loop) * 120 for t in base]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    label = components(texts)
    size = Counter(label)
    assert size[label[0]] > 1
    assert Counter((r.doc_id, r.class_size) for r in near_dedup.membership(docs).collect()) == Counter((i, size[g]) for i, g in enumerate(label))


def kept_words(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield w, [x for x, g in zip(w, gone) if not g]


def test_phrase_automata(spark, docs):
    rows = docs.collect()
    want = Counter((r.doc_id, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, (w, k) in zip(rows, kept_words([r.text for r in rows])))
    assert Counter(map(tuple, phrase_automata.report(docs).collect())) == want
    texts = Counter(r.text for r in phrase_automata.stage(spark, docs, "").collect())
    assert texts == Counter(r.text if len(w) == len(k) else " ".join(k) for r, (w, k) in zip(rows, kept_words([r.text for r in rows])) if k or not w)


def test_stretches_hold_every_occurrence(docs):
    """All passages in one automaton, whole documents streamed through it: the same words as from the stretches."""
    rows = docs.collect()
    marks = phrase_automata.anchors(docs)
    texts = marks.groupBy("tk").agg(F.lit(0).cast("long").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"))
    whole = docs.select(near_dedup.text_key(F.coalesce("text", F.lit(""))).alias("tk"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["tk"])
    parts = phrase_automata.stretches(whole.join(phrase_automata.repeated(texts, 3), "tk"))
    (automaton,) = phrase_automata.automata({r.seg for r in phrase_automata.passages(parts).collect()}, 1 << 24)
    lost = []
    for r in rows:
        words = WORD.findall(r.text or "")
        spans = phrase_automata.locate(automaton, " ".join(words))
        lost.append(len({i for a, b in zip(spans[::2], spans[1::2]) for i in range(a, b)}))
    assert lost == [len(w) - len(k) for w, k in kept_words([r.text for r in rows])] and sum(lost)


def test_frequent_anchors_are_split_exactly(docs):
    rows = docs.collect()
    want = Counter(len(w) - len(k) for w, k in kept_words([r.text for r in rows]))
    for frequent in (0, 2, 5):
        assert Counter(r.n_removed for r in phrase_automata.report(docs, frequent).collect()) == want


def test_warc(spark):
    rows = [(i, f"http://a{i % 3}.example.com/x?{i % 5}#f" if i % 7 else None, ["<p>é</p>", "", None, f"<b>{i}</b>"][i % 4]) for i in range(40)] + [(None, "http://b.org/\n", "<p>é</p>"), (4, "http://a.org", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc_index.history(pages).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in rows:
        f = first[h or ""]
        want[i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == f else "revisit", None if i == f else f] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: (r.part, r.position))]
    assert keys == sorted(keys)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc_index.loser_tree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_line_crf(spark):
    good = [(i, "\n".join(sentence(EN, 12) for _ in range(3)), 1) for i in range(80)]
    bad = [(100 + i, "\n".join(sentence(DE, 3).replace(" ", "$$$ ") for _ in range(4)), 0) for i in range(80)]
    rows = good + bad + [(300, None, None), (301, "", 1), (None, "x", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = line_crf.score(docs, *line_crf.train(docs, labels)).collect()
    truth = {i: q for i, _, q in good + bad}
    assert all(0 <= r.score <= 1 for r in got) and all(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)


def test_chain_marginals_by_enumeration():
    import itertools

    import numpy as np

    u, trans = np.array([0.3, -1.0, 0.7]), np.array([[0.2, -0.4], [0.1, 0.9]])
    total, good = 0.0, np.zeros(3)
    for y in itertools.product((0, 1), repeat=3):
        s = np.exp(sum(u[i] * y[i] for i in range(3)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += s
        good += s * np.array(y)
    assert line_crf.Chain.marginals(u, trans, np.array([0, 3]))[0] == pytest.approx(good / total)


def test_poisson_mix(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "case when id < 3000 then 'a' when id < 3990 then 'b' else 'c' end as source")
    got = poisson_mix.replicate(docs, {"a": 1.0, "b": 1.0, "c": 2.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert all(abs(n[k] - w) < 5 * w**0.5 * (20 if k == "c" else 1) for k, w in (("a", 1000), ("b", 1000), ("c", 2000)))


def test_hash_tree(docs):
    got = hash_tree.assign(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert len(got) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def test_sentencepiece(docs):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for r in sentencepiece_codec.encode(docs).collect():
        assert r.parity and r.round_trip and list(r.token_ids) == ref.encode(r.text or "") and r.n_tokens == len(r.token_ids)


def test_sentencepiece_reports_a_wrong_rebuild():
    """Ids and texts are the pipeline's own: with a wrong one they differ from sentencepiece's, and parity says so."""
    from pathlib import Path

    texts = ["the water of the stone house", "", " two  blanks ", "é ü\tß\n😀"]
    good, bad = (sentencepiece_codec.Codec(Path(sentencepiece_codec.MODEL).read_bytes()) for _ in range(2))
    ids, _, lists = good.encode(texts)
    assert good.parity(texts, lists).all() and good.decode(lists) == texts and ids.tolist() == [x for t in good.reference.encode(texts) for x in t]
    bad.inner = sentencepiece_codec.backend(bad.model._replace(types=[sentencepiece_codec.UNUSED if p == "▁water" else t for p, t in zip(bad.model.pieces, bad.model.types)], dummy_prefix=False))
    other, _, lists = bad.encode(texts)
    parity = bad.parity(texts, lists)
    assert not parity[0] and parity[1] and bad.decode(lists) == texts and other.tolist() != ids.tolist()
    good.tokenizer.decoder = sentencepiece_codec.backend(good.model._replace(dummy_prefix=False)).decoder
    assert good.decode(good.encode(texts)[2])[0] == " " + texts[0]


def field(number, value):
    """A protobuf field: bytes, an int, or a float of 32 bits."""
    import struct

    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(byte_fallback, squeeze):
    """A model of given pieces and scores (nothing is trained): letters, some words, and byte pieces."""
    mark = sentencepiece_codec.MARK
    plain = sorted({mark, *"abcdefghijklmnopqrstuvwxyz.,éß", *(mark + w for w in EN), *EN, "st", "one", "er", mark + "s", mark * 2})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256 * byte_fallback)]
    pieces += [(p, -1.5 - 0.37 * (len(plain) - i) / (1 + len(p)), 1) for i, p in enumerate(plain)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, 1) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize(("byte_fallback", "squeeze"), [(True, False), (True, True), (False, False), (False, True)])
def test_unigram_models_take_the_same_path(byte_fallback, squeeze):
    codec = sentencepiece_codec.Codec(unigram(byte_fallback, squeeze))
    texts = [sentence(EN, 50).lower(), "", "  the  stones of light ", "waterhouse é ß 😀 \n\n the\tring", "stonestonestone", "\n", " ", "the" + " " * 7 + "of"]
    ids, counts, lists = codec.encode(texts)
    assert codec.parity(texts, lists).all() and counts.sum() == len(ids) and len(set(ids.tolist())) >= 10
    if byte_fallback and not squeeze:
        assert codec.decode(lists) == texts
