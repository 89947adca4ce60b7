"""WARC archives and their external index merge.

Every task writes its captures, sorted by URL key and timestamp, to an archive of its own in the shared folder (one
gzip member a record; written under a temporary name and renamed, so a task that runs again does no harm). Reading an
archive back gives a sorted run of index entries. The runs are merged: key ranges (URL key, timestamp, id, so a hot
URL is split) of about RANGE entries each get their slice of every run, and a k-way loser tree merges the slices, which
wait as Arrow batches and are opened a few entries at a time. The result is the globally ordered capture history.

Of records with equal payloads of at least `least` bytes, that with the smallest id is a response and the others
revisit it; a revisit holds the HTTP head, with the full payload's length, and the digest, but no payload.

Defined results: a null payload is ''; a null URL is ''. Rows that repeat the smallest id with an equal payload are all
responses; null ids come last, and are responses only where no row of that payload has an id. A very long payload is one
record, read whole. Entries of one key, time and id keep any order. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import fresh_path, join_counted, partitions, spill, table

LEAST = 0
#: A digest of more records meets them by broadcast. Entries of a key range.
FREQUENT, RANGE = 1_000, 250_000
#: The first capture time of the query; page_id seconds are added (modulo 10^8).
EPOCH = 1_704_067_200
INDEX = "run string, offset long, length long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _schema(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query, in lower case and without fragment."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def captures(pages: DataFrame, least: int = LEAST, epoch: int = EPOCH) -> DataFrame:
    """page_id, url, payload, url_key, captured and `first`, the smallest id with that payload (null: it is short)."""
    payload = F.coalesce(pages["html"], F.lit(""))
    seconds = F.lit(epoch) + F.pmod(F.coalesce(pages["page_id"], F.lit(0)), F.lit(100_000_000))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"), url_key(pages["url"]).alias("url_key"), F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss").alias("captured"))
    # Digests and ids are aggregated before the payloads move; only digests that recur are joined, frequent ones in place.
    long = F.octet_length("payload") >= least
    firsts = spill(rows.where(long).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-digests")
    found = join_counted(rows, firsts, ["sha"], FREQUENT, how="left")
    return found.withColumn("first", F.when(long, F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("first")))).drop("sha", "n")


def _clean(x: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in x)


def record(page_id: int | None, url: str | None, payload: str, key: str, captured: str, first: int | None) -> bytes:
    body = payload.encode("utf-8", "surrogatepass")
    revisit = first is not None and page_id != first
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + (b"" if revisit else body)
    t = captured
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"X-Url-Key: {_clean(key.replace('%', '%25'))}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of the partitions of rows; a table of their paths (written, so the archives are made once)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"captures-{task.partitionId():06d}.warc.gz"
        system, root = _open(folder)
        out, count, done = None, 0, 0
        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(*row)) + z.flush()
                out.write(data)
                count, done = count + 1, done + len(data)
        if out is not None:
            out.close()
            system.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [done]}, _schema("path string, records long, bytes long"))

    ordered = rows.select("page_id", "url", "payload", "url_key", "captured", "first").sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_last())
    return spill(ordered.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of the gzip members of a file, one at a time."""
    at, data = 0, b""
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                return
        z, parts, start = zlib.decompressobj(31), [], at
        while not z.eof:
            if not data:
                data = stream.read(size)
                if not data:
                    raise EOFError("the archive ends within a record")
            parts.append(z.decompress(data))
            at += len(data) - len(z.unused_data)
            data = z.unused_data
        yield start, at - start, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read(manifest: DataFrame) -> DataFrame:
    """Index entries of the archives; those of an archive are a sorted run. Payloads are held against their digests."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in it:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                rows: list[tuple] = []
                with system.open_input_stream(name, compression=None) as f:
                    for offset, length, data in members(f):
                        h, http, payload = parse(data)
                        full = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != full):
                            raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                        number = lambda k: int(x) if (x := h.get(k, "").removeprefix("<urn:x-page:").rstrip(">")) else None
                        rows.append((path, offset, length, unquote(h["X-Url-Key"]), "".join(c for c in h["WARC-Date"] if c.isdigit()), number("WARC-Record-ID"), full, digest, kind, number("WARC-Refers-To")))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(INDEX).types)], NAMES)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(INDEX).types)], NAMES)

    spark = manifest.sparkSession
    return manifest.select("path").repartition(max(1, partitions(spark))).mapInArrow(run, INDEX)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a new entry replays one path."""
    k = len(runs)
    if k == 0:
        return
    ends = (1,)
    heads: list = [next(r, None) for r in runs]
    keys = [ends if h is None else (0, key(h), i) for i, h in enumerate(heads)]
    losers = [-1] * k
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node > 0:
            if losers[node] == -1:
                losers[node], winner = winner, -1
                break
            if keys[losers[node]] < keys[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        if winner != -1:
            losers[0] = winner
    while keys[losers[0]] is not ends:
        i = losers[0]
        yield heads[i]
        heads[i] = next(runs[i], None)
        keys[i] = ends if heads[i] is None else (0, key(heads[i]), i)
        winner, node = i, (i + k) // 2
        while node > 0:
            if keys[losers[node]] < keys[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def merge(index: DataFrame) -> DataFrame:
    """The runs as one history: `part` numbers the key ranges, `position` the entries of a range."""
    spec = INDEX + ", part int, position long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices: dict[str, list[pa.RecordBatch]] = {}
        for batch in it:
            runs = pc.run_end_encode(batch.column(0))
            at = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                slices.setdefault(name, []).append(batch.slice(at, end - at))
                at = end

        def entries(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(lo, 256).columns))

        part, rows, position = TaskContext.get().partitionId(), [], 0
        for row in loser_tree([entries(x) for x in slices.values()], lambda r: (r[3].encode("utf-8", "surrogatepass"), r[4], r[5] is None, r[5] or 0, r[1])):
            rows.append((*row, part, position))
            position += 1
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(spec).types)], [*NAMES, "part", "position"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(spec).types)], [*NAMES, "part", "position"])

    keys = ["url_key", "captured", F.col("page_id").asc_nulls_last()]
    # Entries are about 200 bytes, so a range is about 50 MB. The sort within a range only restores each run's own order
    # after the shuffle.
    ranges = max(partitions(index.sparkSession), -(-index.count() // RANGE))
    dealt = index.repartitionByRange(ranges, *keys).sortWithinPartitions("run", *keys, "offset")
    return dealt.mapInArrow(run, spec)


def history(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The merged index, with `place`, the position in the whole history."""
    spark = pages.sparkSession
    manifest = write(captures(pages, least), fresh_path(spark, "warc"))
    merged = spill(merge(spill(read(manifest), "warc-runs")), "warc-history")
    # One row for each range.
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return merged.join(starts, "part").withColumn("place", F.col("start") + F.col("position")).drop("start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


SQL = f"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, coalesce(html, '') AS x FROM pages),
h AS (SELECT page_id, octet_length(encode(x)) AS payload_bytes, sha1(x) AS h, strftime(make_timestamp(({EPOCH} + coalesce(page_id, 0) % 100000000) * 1000000), '%Y%m%d%H%M%S') AS captured,
 array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '.')), ',') || ')' || regexp_replace(regexp_replace(u, '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS url_key FROM p),
f AS (SELECT h, min(page_id) AS first FROM h WHERE payload_bytes >= {LEAST} GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url_key, captured,
 row_number() OVER (ORDER BY url_key, captured, page_id NULLS LAST) - 1 AS place FROM h LEFT JOIN f USING (h)"""
