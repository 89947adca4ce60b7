"""Clashing columns, large groups, very long texts, and independent versions of what SQL can't tell."""

import base64
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, EN, components, corpus, kept_words, sentence

from curatrix.llm import hash_tree, language_id, line_crf, merkle, near_dedup, phrase_automata, poisson_mix, quality_rules, sentencepiece_codec, warc_index

#: Names that the operators use inside, in any case a user might have them.
INSIDE = "row tk rid rank n v c g key load chars block plain sig kid th _n _kept _id _tk kept n_removed spans parts cdf name name_of who rate copy n_copies mix_key spread _source score part guest home head m b slot shard _row _w _t n_words base_failed token_id all sum w p".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.mark.parametrize("stage", [quality_rules.stage, near_dedup.stage, phrase_automata.stage, poisson_mix.stage], ids=lambda f: f.__module__)
def test_stages_carry_columns_of_any_name(spark, docs, stage):
    """Every extra column says which row it belongs to; it must come out beside that row."""
    tag = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("-")))
    wide = docs.select("*", tag.alias("tag"), *(F.concat(F.lit(f"{c}:"), tag.cast("string")).alias(c) for c in INSIDE))
    got = stage(spark, wide, "")
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}:{r.tag}" for r in rows for c in INSIDE)
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    plain = Counter(map(key, stage(spark, docs, "").collect()))
    if stage is not poisson_mix.stage:
        assert Counter(map(key, rows)) == plain
    else:
        assert {k: n for k, n in Counter(map(key, rows)).items() if k[0] is not None} == {k: n for k, n in plain.items() if k[0] is not None}


def test_near_dedup_keeps_the_same_row_of_equal_ids_and_texts(spark):
    rows = [(1, "some words of a text", "en", f"s{i}", i) for i in range(20)]
    kept = {near_dedup.stage(spark, spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(4), "").collect()[0].source for k in (0, 7, 13)}
    assert len(kept) == 1


@pytest.mark.parametrize(("bucket", "block"), [(4, 1000), (1000, 3), (3, 2)])
def test_large_groups_in_blocks_equal_brute_force(spark, monkeypatch, bucket, block):
    """Groups of near copies, chains of them, and texts around one common passage, all far over the blocks' sizes."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    base = sentence(EN, 80).split(" ")
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 75, 5)]
    chain = sentence(EN, 160).split(" ")
    texts += [" ".join(chain[i : i + 90]) for i in range(0, 60, 5)]
    common = sentence(EN, 30)
    texts += [common + " " + sentence(EN, 20) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    label = components(texts)
    first = {g: min(i for i, x in enumerate(label) if x == g) for g in label}
    size = Counter(label)
    assert max(size.values()) >= 12
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.membership(docs).collect()) == Counter((i, first[g], size[g]) for i, g in enumerate(label))


def test_very_long_texts(spark):
    """Texts over the two million bytes of a chunk, next to short ones."""
    long = sentence(EN, 260_000)
    assert len(long) > 2 << 20
    rows = [(0, "short text of few words", "en", "s0", 0), (1, long, "en", "s0", len(long)), (2, "another short one", "en", "s1", 0), (3, long + " end", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    assert {r.doc_id: r.class_id for r in near_dedup.membership(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    want = {i: len(w) - len(k) for i, (w, k) in enumerate(kept_words([r[1] for r in rows]))}
    assert {r.doc_id: r.n_removed for r in phrase_automata.report(docs).collect()} == want
    assert all(r.parity and r.round_trip for r in sentencepiece_codec.encode(docs).select("parity", "round_trip").collect())
    assert {r.doc_id: r.n_chars for r in merkle.edited(docs).collect()} == {r[0]: len(r[1]) for r in rows}
    pages = spark.createDataFrame([(i, "http://a.org/", t) for i, t, *_ in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc_index.history(pages).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for i, t, *_ in rows}


def test_frequent_payloads_and_escaped_keys(spark):
    rows = [(i, f"http://x.org/a%41b%2F{i % 3}?q=%E9", "same page" if i % 2 else f"page {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc_index.history(pages).collect()}
    assert all(got[i].refers_to == (1 if i % 2 and i > 1 else None) for i in range(300))
    assert all(got[i].url_key == f"org,x)/a%41b%2f{i % 3}?q=%e9" for i in range(300))
    assert sorted(r.place for r in got.values()) == list(range(300))


def test_hash_tree_places_by_hand(spark, docs):
    """The draws of every node, made again from md5."""
    root, more = hash_tree.topology(), hash_tree.grown(hash_tree.topology())

    def by_hand(node, who):
        while node.shard is None:
            draw = lambda c: -math.log((int(hashlib.md5(f"tree:{c.name}:{who}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / c.total
            node = min(node.children, key=draw) if len(node.children) > 1 else node.children[0]
        return node.shard

    rows = hash_tree.assign(docs.unionByName(docs.where("doc_id = 3"))).collect()
    for r in rows:
        who = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (by_hand(root, who), by_hand(more, who))
    order = lambda r: ((m := hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest())[:3], r.text_crc32, m, r.size)
    for s in range(8):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and [order(r) for r in mine] == sorted(map(order, mine))


def test_mixing_of_rows_without_an_id(spark):
    rows = [(None, f"text {i}", "en", "a", i) for i in range(3000)] + [(5, "same", "en", "b", 0)] * 50
    got = poisson_mix.copies(spark.createDataFrame(rows, DOCS), {"a": 1.0, "b": 1.0}).select("row.*", "rate", "n_copies", "mix_key").collect()
    a = [r for r in got if r.source == "a"]
    assert abs(len(a) - 1525) < 200 and len({r.mix_key for r in a}) > 1000
    assert len({r.n_copies for r in got if r.source == "b"}) <= 1


def test_numerals_are_no_letters(spark):
    assert language_id.LETTERS.findall("a½b ② Ⅻ x² ٣ 12 _ word’s ß 中一") == ["a", "b", "x", "word", "s", "ß", "中一"]
    assert language_id.letter_runs("a½b ② Ⅻ x² ٣ 12 _ word’s ß 中一") == ["a", "b", "x", "word", "s", "ß", "中一"]
    assert all(bool(language_id.LETTERS.fullmatch(c)) == c.isalpha() for c in map(chr, range(0x3000)))
    docs = spark.createDataFrame([(0, "½ ② Ⅻ"), (1, "²"), (2, "12 _"), (3, None), (4, "the")], "doc_id long, text string")
    pieces = language_id.vocabulary()
    p = np.vstack([np.full((len(pieces) + 1, 2), 0.5), np.zeros((1, 2))])
    assert [r.lang_pred for r in language_id.predict(docs, pieces, ["de", "en"], p).orderBy("doc_id").collect()] == ["und"] * 4 + ["de"]


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield [pieces.get(word[:k], len(pieces)), *rest]


def test_training_and_scores_by_enumeration(spark):
    """Expectation maximisation and predictions over every segmentation, written out."""
    mark = language_id.MARK
    names = [mark, "a", "b", "c", "ab", "bc", mark + "a", "ca"]
    pieces = {x: i for i, x in enumerate(names)}
    rows = [(i, "abc cab Ab", "x") for i in range(12)] + [(100 + i, "bca cc zab", "y") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = language_id.train(docs, names, rounds=2)
    import zlib

    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = np.full((len(names) + 1, 2), 1 / (len(names) + 1))
    for _ in range(2):
        new = np.full_like(want, language_id.SMOOTH)
        for _, text, lang in used:
            k = langs.index(lang)
            for word in text.lower().split():
                ways = list(segmentations(mark + word, pieces))
                odds = np.array([math.prod(want[i, k] for i in w) for w in ways])
                for w, o in zip(ways, odds / odds.sum()):
                    for i in w:
                        new[i, k] += o
        want = new / new.sum(0)
    assert langs == ["x", "y"] and np.allclose(p[:-1], want, rtol=1e-6)
    for r in language_id.predict(docs, names, langs, p).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        total = np.array([sum(math.log(sum(math.prod(want[i, k] for i in w) for w in segmentations(mark + word, pieces))) for word in text.lower().split()) for k in (0, 1)])
        odds = np.exp(total - total.max())
        assert r.lang_pred == langs[int(total.argmax())] and r.score == pytest.approx(odds.max() / odds.sum())


def plain_features(text):
    """The thirteen numbers of each line, in plain Python."""
    lines, seen, out = text.split("\n"), set(), []
    for line in lines:
        data = line.encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        n, count = len(data), len(words)
        share = lambda chars: sum(b in chars for b in data)
        upper, lower, high = share(range(65, 91)), share(range(97, 123)), sum(b >= 128 for b in data)
        chars, w = max(n, 1), max(count, 1)
        key = tuple(words)
        out.append([
            (upper + lower + high) / chars, upper / max(upper + lower, 1), share(range(48, 58)) / chars, min(share(b"#*$%&<>@^~=+\\/{}[]_") / w, 3), min(share(b"|") / w, 1),
            min(share(b".,;:") / w, 2), min(share(b"!?") / w, 3), min(n / w, 20) / 10, math.log1p(count) / 5, (count - len(set(words))) / w, float(count > 0 and key in seen), float(count == 0), min(high / chars, 1),
        ])
        seen.add(key)
    zero = [0.0] * 13
    return [a + (out[i - 1] if i else zero) + (out[i + 1] if i + 1 < len(out) else zero) + [1.0] for i, a in enumerate(out)]


def test_line_features_in_plain_python():
    texts = ["Some line of TEXT, with words.\nSome line of TEXT, with words.\n\n#### $$$ 12 34!?", "", "é ü | a a a\n", "one"]
    data = [t.encode() for t in texts]
    x, size, first = line_crf.line_features(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, data))))))
    want = [row for t in texts for row in plain_features(t)]
    assert np.allclose(x, np.array(want)) and size.tolist() == [len(line.encode()) + 1 for t in texts for line in t.split("\n")]
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in texts]


def test_one_step_follows_the_numeric_gradient():
    """The first step of the ascent has the sign of the derivative of the likelihood, which is written out over all labels."""
    rng = np.random.default_rng(3)
    x, first, label = rng.normal(size=(7, 4)), np.array([0, 3, 7]), np.array([1, 0])

    def likelihood(w, trans):
        total = 0.0
        for a, b, y, n in ((0, 3, 1, 1), (3, 7, 0, 1)):
            u = x[a:b] @ w
            score = lambda s: sum(u[i] * s[i] for i in range(len(u))) + sum(trans[p, q] for p, q in zip(s, s[1:]))  # noqa: B023, E731
            total += 0.5 / n / (b - a) * (score([y] * (b - a)) - math.log(sum(math.exp(score(s)) for s in itertools.product((0, 1), repeat=b - a))))
        return total

    w, trans = line_crf.fit(x, first, label, 1)
    zero_w, zero_t, step = np.zeros(4), np.zeros((2, 2)), 1e-6
    slope = [(likelihood(zero_w + step * e, zero_t) - likelihood(zero_w - step * e, zero_t)) for e in np.eye(4)]
    assert np.array_equal(np.sign(w), np.sign(slope))
    for i, j in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[i, j] = step
        assert np.sign(trans[i, j]) == np.sign(likelihood(zero_w, zero_t + e) - likelihood(zero_w, zero_t - e))
    w, trans = line_crf.fit(x, first, label, 60)
    assert likelihood(w, trans) > likelihood(zero_w, zero_t)


def by_hand(text):
    """Root, leaves and the tree's labels, with hashlib only."""
    h = lambda b, n=16: hashlib.blake2b(b, digest_size=n).digest()
    short = lambda b: base64.urlsafe_b64encode(b[:6]).decode()
    sections, leaves = [[]], Counter()
    for line in text.split("\n") if text else []:
        cut, part = [], ""
        for i, ch in enumerate(line):
            part += ch
            stop, nxt = ch in ".!?。！？", line[i + 1 : i + 2]
            ends = stop and (not nxt or nxt not in ".!?。！？" or sum(c in ".!?。！？" for c in part) == 64)
            if ends or part[-2:] in ("d ", "y ") or (not stop and len(part) == 64 and not (nxt and nxt in ".!?。！？")) or not nxt:
                cut.append(part)
                part = ""
        sections[-1].append([h(x.encode()) for x in cut])
        leaves.update(short(x) for x in sections[-1][-1])
        if cut and h(b"".join(sections[-1][-1]))[0] % 8 == 0:
            sections.append([])
    nodes = [[h(b"p" + b"".join(p)) for p in s] for s in sections]
    root = h(b"".join(h(b"s" + b"".join(s)) for s in nodes))
    return root.hex(), leaves


def test_merkle_by_hand():
    texts = ["", "a", "first line.\nsecond lady and body.\n\nthird!?! x", "and " * 40 + "y" * 200, "\n\n", "día. 。x", "word " * 30 + "end."]
    texts += [t or "" for _, t, *_ in corpus()[:45]]
    marks = [merkle.fingerprint(t) for t in texts]
    hands = [by_hand(t) for t in texts]
    assert [m.partition("|")[0] for m in marks] == [r for r, _ in hands]
    for (a, (ra, x)), (b, (rb, y)) in itertools.product(list(zip(marks, hands))[::3], zip(marks, hands)):
        want = 1.0 if ra == rb else 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))
        assert merkle.likeness(a, b) == pytest.approx(want)
    old = "\n".join(f"line {i} of a text." for i in range(60))
    new = old.replace("line 30 of", "line 30 off").replace("line 7 of", "line seven of")
    found = merkle.locate(merkle.fingerprint(old), merkle.fingerprint(new))
    tree = merkle.tree(old)
    starts = np.cumsum([0] + [len(s) for s in tree])
    assert sorted(int(starts[i] + j) for i, j in found) == [7, 30]


def test_merkle_order_with_many_rows_without_id(spark):
    rows = [(None, f"text {i:03}") for i in range(60)] + [(i // 3, f"row {i}") for i in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = Counter()
    for k, (i, t) in enumerate(want):
        n = want[(k + 1) % len(want)][1]
        half = len(t) // 2
        expected[i, hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    for n in (1, 3, 8, 40):
        plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        assert merkle.in_order(plain, n).where("not guest").count() == len(rows)
    assert Counter((r.doc_id, r.edited_sha256) for r in merkle.edited(docs).collect()) == expected


def test_places_of_groups_are_shared_fairly(spark):
    """A shard of automata ends with a group; several groups share one, and a group may need several."""
    texts = {sentence(EN, 40) for _ in range(30)}
    for shard in (1, 500, 1 << 20):
        made = list(phrase_automata.automata(texts, shard))
        held = defaultdict(int)
        for a in made:
            for w in a.keys():
                held[w] += 1
        assert dict(held) == dict.fromkeys(texts, 1)
