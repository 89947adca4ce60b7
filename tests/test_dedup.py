"""Near duplicates on small tables against all pairs."""

from curatrix.plans import registry

WORDS = [f"w{i}" for i in range(30)]
ROWS = [
    (1, " ".join(WORDS), "en"), (2, " ".join(WORDS + ["x"]), "fr"), (3, " ".join(WORDS + ["y"]), None), (4, " ".join(WORDS + ["z"]), None),
    (5, " ".join(reversed(WORDS)).upper(), "de"), (6, " ".join(WORDS), "es"), (7, " ".join(f"v{i}" for i in range(30)), "en"), (8, "?!", "en"), (9, None, None),
]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def all_pairs(rows):
    sets = {i: set(t.lower().split()) for i, t, _ in rows if t and i != 8}
    return {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.92}


def test_links_ignore_language(spark, tmp_path):
    got = {(r.a, r.b): r.jaccard for r in registry.queries()["near_duplicate_links"](spark, folder(spark, tmp_path)).collect()}
    want = {p: round(j, 6) for p, j in all_pairs([r for r in ROWS if r[0] not in (5, 6)]).items()}
    assert got == want and {(1, 2), (1, 3), (3, 4)} <= set(got)


def test_members_and_links_give_every_pair(spark, tmp_path):
    """Texts that differ only in order or case (1 and 5) too; copies of one text (1 and 6) are told apart from them."""
    sf = folder(spark, tmp_path)
    links = {(r.a, r.b) for r in registry.queries()["near_duplicate_links"](spark, sf).collect()}
    rows = {r.doc_id: r for r in registry.queries()["near_duplicate_members"](spark, sf).collect()}
    near = lambda a, b: a.text_head != b.text_head and (a.head == b.head or (min(a.head, b.head), max(a.head, b.head)) in links)
    texts = {i: t for i, t, _ in ROWS}
    got = {(a, b) for a in rows for b in rows if a < b and near(rows[a], rows[b])}
    assert got == {(a, b) for a, b in all_pairs(ROWS) if texts[a] != texts[b]} and (1, 5) in got and (1, 6) not in got
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7} and (rows[5].head, rows[5].n_texts, rows[5].n_links, rows[7].n_links) == (1, 2, 3, 0)
