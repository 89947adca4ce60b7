"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into lines (paragraphs), and each line into leaves where its own characters say so: after a blank that
follows one of two letters, after sentence ends, and after 64 characters without either, so an edit moves no border
behind the next such place. A paragraph's hash is made of its leaves, a section's of its paragraphs; a section ends after
a paragraph whose own hash says so (one in eight). The root is made of all sections.

The fingerprint holds the root and the short hashes of all nodes in their places: `root|section;section`, a section being
`hash(paragraph,paragraph)` and a paragraph `hash:leaf+leaf` (an empty line is empty). Equal roots mean equal texts.
Where roots differ, only the branches that differ are descended to tell likeness and the edited paragraphs.

Likeness is the Dice coefficient of the multisets of leaves, 1 for two empty trees. It is found from the top: sections
that both trees have, then paragraphs that the other sections share, then leaves, which gives the same number.

Defined results: a null text is ''; the empty text has a root and no leaf. Ids are ordered ascending, nulls first,
rows of one id by their text; repeated rows follow one another. A single row is its own next document. A very long text is
hashed whole. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import partitions, table, text_of

#: A leaf; the pattern covers every line without gaps.
LEAF = re.compile(r"[^.!?。！？]{1,64}?(?:(?<=[dy] )|[.!?。！？]{1,64}|$)|[^.!?。！？]{64}|[.!?。！？]{1,64}", re.S)
#: Bytes of a short hash: eight characters of the fingerprint.
SHORT = 6


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short(data: bytes) -> str:
    return urlsafe_b64encode(data[:SHORT]).decode()


def tree(text: str) -> list[list[list[bytes]]]:
    """Sections of paragraphs of leaf hashes."""
    sections: list[list[list[bytes]]] = [[]]
    if text:
        for line in text.split("\n"):
            leaves = [_hash(x.encode("utf-8", "surrogatepass")) for x in LEAF.findall(line)]
            sections[-1].append(leaves)
            if leaves and _hash(b"".join(leaves))[0] % 8 == 0:
                sections.append([])
    return sections


def fingerprint(text: str) -> str:
    root, body = hashlib.blake2b(digest_size=16), []
    for section in tree(text):
        level = [_hash(b"p" + b"".join(p)) for p in section]
        node = _hash(b"s" + b"".join(level))
        root.update(node)
        inner = ",".join(f"{_short(h)}:{'+'.join(map(_short, p))}" if p else "" for h, p in zip(level, section))
        body.append(f"{_short(node)}({inner})")
    return f"{root.hexdigest()}|{';'.join(body)}"


def _differing(a: list[str], b: list[str], cut: str) -> tuple[list[str], list[str], list[str]]:
    """Nodes (strings that begin with their hash, up to `cut`) of a and of b that the other doesn't hold, and those of a
    that it does."""
    names = [Counter(x.partition(cut)[0] for x in side) for side in (a, b)]
    rest = [names[0] - names[1], names[1] - names[0]]
    out: list[list[str]] = [[], [], []]
    for k, side in enumerate((a, b)):
        for x in side:
            name = x.partition(cut)[0]
            if rest[k][name] > 0:
                rest[k][name] -= 1
                out[k].append(x)
            elif not k:
                out[2].append(x)
    return out[0], out[1], out[2]


def _paragraphs(sections: list[str]) -> list[str]:
    return [p for s in sections for p in s.partition("(")[2][:-1].split(",") if p]


def _leaves(nodes: list[str]) -> int:
    return sum(x.count(":") + x.count("+") for x in nodes)


def compare(a: str, b: str) -> tuple[float, int]:
    """Likeness, and how many of a's paragraphs b doesn't hold; only differing branches are descended."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0, 0
    x, y = (m.partition("|")[2].split(";") for m in (a, b))
    total = _leaves(x) + _leaves(y)
    x, y, same = _differing(x, y, "(")
    common = _leaves(same)
    p, q, same = _differing(_paragraphs(x), _paragraphs(y), ":")
    common += _leaves(same)
    u, v = (Counter(leaf for n in side for leaf in n.partition(":")[2].split("+")) for side in (p, q))
    common += sum((u & v).values())
    return 2 * common / max(1, total), len(p)


def likeness(a: str, b: str) -> float:
    return compare(a, b)[0]


def locate(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a's paragraphs that b doesn't hold, from the fingerprints alone."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    x, y = (m.partition("|")[2].split(";") for m in (a, b))
    mine, other, _ = _differing(x, y, "(")
    gone = Counter(p.partition(":")[0] for p in _differing(_paragraphs(mine), _paragraphs(other), ":")[0])
    open_ = Counter(mine)
    out = []
    for i, s in enumerate(x):
        if open_[s] > 0:
            open_[s] -= 1
            for j, p in enumerate(s.partition("(")[2][:-1].split(",")):
                if p and gone[p.partition(":")[0]] > 0:
                    gone[p.partition(":")[0]] -= 1
                    out.append((i, j))
    return out


def _below(axis: Column, borders: Sequence[int]) -> Column:
    """How many of the (sorted) borders are at most axis, by two steps of about the square root of their number."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    all_ = F.lit(list(borders))
    coarse = F.size(F.filter(F.lit(list(borders[step - 1 :: step])), lambda b: b <= axis)) * step
    return coarse + F.size(F.filter(F.slice(all_, coarse + 1, F.lit(step)), lambda b: b <= axis))


def in_order(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows dealt by ranges of the id, each range followed by the first row of the next (guest), the last by the first.

    One shuffle of the texts. Rows without an id, which come first, have ranges of their own, by the first bytes of their
    texts. Borders are values that occur, so the first row of a range is the least of those at its border.
    """
    n = n or partitions(df.sparkSession)
    none = F.col("doc_id").isNull()
    start = F.conv(F.hex(F.substring(F.rpad(F.col("text").cast("binary"), 7, F.lit(b"\x00")), 1, 7)), 16, 10).cast("long")
    axes = (F.when(none, start), F.when(~none, F.col("doc_id")))
    shares = [i / n for i in range(1, n)] or [0.5]
    told = df.agg(*(f(axis).alias(f"{k}{i}") for i, axis in enumerate(axes) for k, f in (("q", lambda c: F.percentile_approx(c, shares, 100 * n)), ("lo", F.min), ("n", F.count)))).first()
    # At most n borders for each kind of row reach the driver.
    ranges: list[tuple[int, int, list[int]]] = []
    for i in (0, 1):
        if told[f"n{i}"]:
            want = max(1, round(n * told[f"n{i}"] / (told["n0"] + told["n1"])))
            chosen = [told[f"q{i}"][len(shares) * k // want] for k in range(1, want)] if want < n else told[f"q{i}"]
            before = sum(len(b) + 1 for _, _, b in ranges)
            ranges.append((i, before, sorted({x for x in chosen if x > told[f"lo{i}"]})))
    if not ranges:
        return df.withColumn("part", F.lit(0)).withColumn("guest", F.lit(False))
    total = sum(len(b) + 1 for _, _, b in ranges)
    home, border = F.lit(0), F.lit(False)
    for i, before, borders in ranges:
        at = _below(axes[i], borders)
        first = F.get(F.lit([told[f"lo{i}"], *borders]), at) == axes[i]
        home, border = F.when(axes[i].isNotNull(), at + before).otherwise(home), F.when(axes[i].isNotNull(), first).otherwise(border)
    least = df.where(border).groupBy(home.cast("int").alias("home")).agg(F.min(F.struct("doc_id", "text")).alias("x"))
    guests = least.select("x.doc_id", "x.text", F.pmod(F.col("home") - 1, F.lit(total)).alias("part"), F.lit(True).alias("guest"))
    dealt = df.select("doc_id", "text", home.cast("int").alias("part"), F.lit(False).alias("guest")).unionByName(guests)
    return dealt.repartitionById(total, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")


def edited(df: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and the number of paragraphs of the text that
    the edited one doesn't hold (n_edited)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edited long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        before: tuple | None = None

        def row(now: tuple, after: tuple) -> tuple:
            (i, text, mark), (_, other, other_mark) = now, after
            k = len(text) // 2
            new = text[: len(text) - k] + other[:k]
            new_mark = fingerprint(new)
            near, paragraphs = compare(mark, new_mark)
            return i, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark, near, likeness(mark, other_mark), paragraphs

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], [x.split()[0] for x in schema.split(", ")])
            rows.clear()
            return made

        done = False
        for batch in batches:
            for j in range(batch.num_rows):
                i, text, guest = (batch.column(c)[j].as_py() for c in range(3))
                if done:
                    continue
                now = (i, text, fingerprint(text))
                if before is not None:
                    rows.append(row(before, now))
                before, done = now, guest
                if len(rows) >= 256:
                    yield out()
        if rows:
            yield out()

    plain = df.select("doc_id", text_of(df).alias("text"))
    return in_order(plain).select("doc_id", "text", "guest").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
