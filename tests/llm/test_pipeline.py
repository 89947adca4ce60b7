"""The whole pipeline on the smallest tables against brute force, and the operators that have SQL against it."""

import hashlib
import math
import os
from collections import Counter

import pytest
from test_operators import components, kept_words

import corpus_pipeline
from curatrix.llm import poisson_mix, quality_rules, sentencepiece_codec
from tests import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def draw(key, digits):
    return int(hashlib.md5(key.encode()).hexdigest()[:digits], 16)


def copies(doc, rate):
    """Poisson numbers by inversion, large rates as a sum of smaller ones."""
    parts, n = max(1, math.ceil(rate / poisson_mix.PART)), 0
    for i in range(1, parts + 1):
        u, p, k = draw(f"{poisson_mix.SEED}:{i}:{doc}", 13) / (1 << 52), math.exp(-rate / parts), 0
        total = p
        while u >= total:
            k += 1
            p *= rate / parts / k
            total += p
        n += k
    return n


def by_hand():
    import duckdb
    import sentencepiece

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.SQL}) where kept").fetchall()}
    read = con.execute("select doc_id, text, lang, source, n_chars from documents order by doc_id").fetchall()
    assert len({r[0] for r in read}) == len(read)
    rows = [r for r in read if r[0] in good]
    first = {}
    for r, g in zip(rows, components([r[1] for r in rows])):
        first.setdefault(g, r)
    unique = list(first.values())
    cut = []
    for r, (words, kept) in zip(unique, kept_words([r[1] for r in unique])):
        if len(kept) == len(words):
            cut.append(r)
        elif kept:
            cut.append((r[0], " ".join(kept), *r[2:4], len(" ".join(kept))))
    counts = Counter(r[3] for r in cut)
    weight = {s: poisson_mix.WEIGHTS.get(s, 1.0) for s in counts}
    rate = {s: weight[s] / sum(weight.values()) * len(cut) / counts[s] for s in counts}
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    done = Counter()
    for r in cut:
        if n := copies(r[0], rate[r[3]]):
            done[r[0], r[2], r[3], r[4], tuple(model.encode(r[1] or ""))] += n
    assert 0 < len(unique) < len(rows) < len(read) and any(r not in unique for r in cut) and max(done.values()) > 1
    return done


def test_pipeline_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.token_ids)) for r in got) == by_hand()
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.token_ids) for r in got)


def test_operators_with_sql(spark):
    assert compare.run(spark, SF, ("op3_quality_rules", "op7_poisson_mix")) == {}
