"""Sharding by a hierarchical weighted hash tree: region, rack and shard are chosen one after the other, each by
weighted hash draws (the smallest -ln(u)/weight wins), so a key descends the tree with a few hashes however many
shards there are. A changed weight moves keys only into or out of the subtree that holds it. A new shard becomes a
region of its own (`grown`), so it takes keys only into itself: the law is `key`.

The draws are made from md5 of the node's path and the key, so any engine can repeat them. Places within a shard are
numbered without gaps in two steps: rows are counted in small buckets, and the counts of all buckets (shards times
65,536, a bounded table) give each bucket its start.

Defined results: a null id is the key 'null'; a null text has size 1 and the crc of ''. Rows of one id share a shard
and get places of their own: places go by the first digits of the key's md5, then by crc, md5 and size, and equal rows
may change places. The length of a text doesn't matter. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import spill, table, text_of


class Node(NamedTuple):
    """A subtree: its name, and either children or a shard's number; `weight` is that of a leaf."""

    name: str
    children: tuple = ()
    shard: int | None = None
    weight: float = 1.0

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def topology(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """Shards 0, 1, 2, ... in racks in regions, all of weight 1."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(Node(f"region{r}", tuple(Node(f"rack{r}.{k}", tuple(Node(f"shard{(n := next(number))}", shard=n) for _ in range(shards))) for k in range(racks))) for r in range(regions)))


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region of its own; no other subtree's weight changes."""
    n = 1 + max(x.shard for x in leaves(root))
    return root._replace(children=(*root.children, Node(f"region+{n}", (Node(f"shard{n}", shard=n, weight=weight),))))


def _draw(node: Node, key: Column, seed: str) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(node.name), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / node.total


def place(root: Node, key: Column, seed: str = "tree") -> Column:
    """The shard of a key. Draws are made only for the children of nodes on its path."""
    if root.shard is not None:
        return F.lit(root.shard)
    if len(root.children) == 1:
        return place(root.children[0], key, seed)
    best = F.array_min(F.array(*(F.struct(_draw(c, key, seed).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(root.children))))
    inner = [place(c, key, seed) for c in root.children]
    # A one-element array binds the winner, so the draws of a node are made once.
    chosen = F.transform(F.array(best["i"]), lambda i: _choose(i, inner))
    return F.element_at(chosen, 1)


def _choose(i: Column, inner: list[Column]) -> Column:
    out = F.when(i == 0, inner[0])
    for k, x in enumerate(inner[1:], 1):
        out = out.when(i == k, x)
    return out


#: Buckets of a shard: by the first three hex digits of the key's md5 and the first four bits of the text's crc.
HEADS, CRCS = 4096, 16


def number(rows: DataFrame) -> DataFrame:
    """rows: shard, head, text_crc32, m, size, n (how many rows are equal to this one) and others. A row for each of the n,
    with `slot`: places 0, 1, 2, ... within each shard, in the order of head, text_crc32, m and size.

    No task gets a whole shard: places are numbered within buckets, which follow one another in that order.
    """
    bucket = rows.withColumn("b", (F.col("head") * CRCS + F.shiftright("text_crc32", 28)).cast("int"))
    order = Window.partitionBy("shard", "b").orderBy("text_crc32", "m", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = bucket.withColumn("i", F.sum("n").over(order) - F.col("n"))
    counts = bucket.groupBy("shard", "b").agg(F.sum("n").alias("c"))
    starts = counts.select("shard", "b", (F.sum("c").over(Window.partitionBy("shard").orderBy("b")) - F.col("c")).alias("at"))
    placed = inside.join(starts, ["shard", "b"])
    # Equal rows were one until here; they are dealt out a million at a time.
    million = F.lit(1_000_000).cast("long")
    some = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / million).cast("long"))))
    each = some.withColumn("k", F.explode(F.sequence(F.col("part") * million, F.least((F.col("part") + 1) * million, F.col("n")) - 1)))
    return each.withColumn("slot", (F.col("at") + F.col("i") + F.col("k")).cast("long"))


def assign(df: DataFrame, root: Node | None = None, seed: str = "tree") -> DataFrame:
    root = root or topology()
    text = text_of(df)
    key = F.coalesce(df["doc_id"].cast("string"), F.lit("null"))
    rows = df.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(key.cast("binary")).alias("m"),
        place(root, key, seed).cast("int").alias("shard"),
        place(grown(root), key, seed).cast("int").alias("grown_shard"),
    )
    # Written, so that the draws are made once. Equal rows are added up.
    known = spill(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "tree-rows")
    head = F.conv(F.substring("m", 1, 3), 16, 10).cast("int")
    return number(known.withColumn("head", head)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _place_sql(root: Node, seed: str) -> str:
    """The shard of the key `who`, as SQL."""
    if root.shard is not None:
        return str(root.shard)
    if len(root.children) == 1:
        return _place_sql(root.children[0], seed)
    draws = ", ".join(f"-ln((CAST('0x' || substr(md5('{seed}:{c.name}:' || who), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)}) / {c.total}" for c in root.children)
    inner = " ".join(f"WHEN {i} THEN {_place_sql(c, seed)}" for i, c in enumerate(root.children, 1))
    return f"(CASE list_position([{draws}], list_min([{draws}])) {inner} END)"


# The table of the CRC's polynomial (a fixed value) and the CRC of bytes, as SQL.
_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))"
_BYTES = "list_filter(list_transform(string_split(regexp_replace(hex(encode(x)), '(..)', '\\1 ', 'g'), ' '), lambda y: CASE WHEN y <> '' THEN CAST('0x' || y AS BIGINT) END), lambda y: y IS NOT NULL)"
SQL = f"""
WITH t AS ({_TABLE}), d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS who, coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, who, md5(who) AS m, octet_length(encode(x)) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, z: xor(a >> 8, t[(xor(a, z) & 255) + 1]))) AS text_crc32 FROM d, t),
p AS (SELECT *, CAST({_place_sql(topology(), "tree")} AS INTEGER) AS shard, CAST({_place_sql(grown(topology()), "tree")} AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(m, 1, 3), text_crc32, m, size) - 1 AS slot, grown_shard FROM p"""
