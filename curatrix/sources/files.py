"""Readers and writers: CSV as text, JSON lines with their bad lines, vocabularies, result files, tables in prose, xlsx.

Folders are listed and read by Spark's readers, so every path that Spark can open will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Spellings that the lenient NA policy reads as null.
NA = ("", "NA", "N/A", "NaN", "nan", "null", "None")


def read_csv(spark: SparkSession, path: str, sep: str = ",", na: Sequence[str] | None = None) -> DataFrame:
    """Every cell as text, byte for byte. Empty cells are '' unless `na` names the spellings that become null."""
    raw = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=False, maxCharsPerColumn=-1, nullValue="\x00", emptyValue="").csv(path)
    cell = (lambda c: F.coalesce(F.col(c), F.lit(""))) if na is None else (lambda c: F.when(~F.col(c).isin(*na), F.col(c)))
    return raw.select(*(cell(f"`{c}`").alias(c) for c in raw.columns))


def read_delimited(spark: SparkSession, path: str, seps: Sequence[str] = (",", "\t"), na: Sequence[str] | None = None) -> DataFrame:
    """The first separator under which the header has two columns or more; else the first."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    return read_csv(spark, path, next((s for s in seps if s in head), seps[0]), na)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that aren't JSON objects (path, line). Blank lines are neither."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path")).where(F.trim("value") != "")
    parsed = lines.select("path", "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*"), parsed.where("not ok").select("path", F.col("value").alias("line"))


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """A vocabulary: pos and entry, trimmed; blank and comment lines left out. Positions follow the file."""
    ids = spark.read.text(path).select(F.monotonically_increasing_id().alias("_i"), F.trim("value").alias("entry"))
    kept = ids.where((F.col("entry") != "") & ~F.startswith("entry", F.lit(comment)))
    return kept.select((F.row_number().over(Window.orderBy("_i")) - 1).alias("pos"), "entry")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def find_split(spark: SparkSession, folder: str, aliases: Sequence[str], endings: Sequence[str] = (".csv",)) -> str:
    """The first file that is there, of a split's names in order."""
    for name in aliases:
        for ending in endings:
            if exists(spark, path := f"{folder.rstrip('/')}/{name}{ending}"):
                return path
    raise FileNotFoundError(f"none of {', '.join(aliases)} in {folder}")


def path_columns(path: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """A column for each group of a pattern over a path; null where it doesn't match."""
    return [F.when(F.regexp_like(path, F.lit(pattern)), F.regexp_extract(path, pattern, i + 1)).alias(n) for i, n in enumerate(names)]


def read_results(spark: SparkSession, glob: str, families: Sequence[tuple[str, Sequence[str]]], fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Result files, whole JSON documents, as one row each: dimensions from the first path pattern that fits, and every
    field from the first of its JSON paths that holds a value, so that differing layouts come out alike."""
    raw = spark.read.text(glob, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    found: dict[str, list[Column]] = {}
    for pattern, names in families:
        for c, n in zip(path_columns(F.col("path"), pattern, names), names):
            found.setdefault(n, []).append(c)
    dims = [F.coalesce(*cs).alias(n) for n, cs in found.items()]
    return raw.select("path", *dims, *(F.coalesce(*(F.get_json_object("value", p) for p in ps)).alias(n) for n, ps in fields.items()))


def list_files(spark: SparkSession, glob: str, min_bytes: int = 0, name: str = ".*") -> DataFrame:
    """path and bytes of the files under a folder whose name fits; contents are not read."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", F.col("length").alias("bytes"))
    return meta.where((F.col("bytes") >= min_bytes) & F.regexp_like(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(name)))


def with_rows(files: DataFrame, least: int) -> DataFrame:
    """Those of the listed text files (path) that have so many lines or more, with `rows`."""
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").collect()]  # a listing: as many as there are files
    lines = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return files.join(lines, "path").where(F.col("rows") >= least)


def sibling(path: Column, ending: str, other: str) -> Column:
    """The path of a prediction file beside its metrics file."""
    return F.regexp_replace(path, re.escape(ending) + "$", other)


def table_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Cells of the Markdown and LaTeX tables in a text: keys, row (from 0) and cells. Rules are left out; LaTeX marks
    around a value (bold, underline, math signs, escaped per cent) are taken off."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "_l")).withColumn("_l", F.trim("_l"))
    md = F.col("_l").rlike(r"^\|.*\|$")
    tex = F.col("_l").rlike(r"(?<!\\)&.*\\\\")
    body = F.when(md, F.regexp_replace("_l", r"^\||\|$", "")).when(tex, F.regexp_replace("_l", r"\\\\.*$", ""))
    cells = F.when(md, F.split(body, r"(?<!\\)\|")).when(tex, F.split(body, r"(?<!\\)&"))
    plain = F.transform(cells, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\\(?:textbf|underline|textit|emph|mathbf)\{([^{}]*)\}", "$1"), r"\$|\*\*|\\(?=[%&_#])", "")))
    rows = lines.select(*keys, "_p", plain.alias("cells")).where("cells is not null").where(~F.forall("cells", lambda x: x.rlike(r"^:?-+:?$")))
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("_p")) - 1).alias("row"), "cells")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet(data: bytes, sheet: int) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers (from 1) and cells by column (from 0) of a worksheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in root.iterfind("m:si", _NS)]
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", _NS):
            cells = {}
            for c in row.iterfind("m:c", _NS):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r")).group():
                    column = column * 26 + ord(letter) - 64
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[column - 1] = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
                elif v is not None and v.text is not None:
                    cells[column - 1] = shared[int(v.text)] if kind == "s" else v.text
            yield int(row.get("r")), cells


def read_xlsx(spark: SparkSession, path: str, columns: Sequence[str], sheet: int = 1, header: int = 1) -> DataFrame:
    """Workbooks by header text: path, row (the sheet's number) and the named columns as text, null where a cell or a
    column is absent. A task parses one workbook at a time; header texts are compared without case and outer blanks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, data in zip(frame["path"], frame["content"]):
                names: dict[str, int] = {}
                out = []
                for number, cells in _sheet(data, sheet):
                    if number == header:
                        names = {v.strip().lower(): k for k, v in cells.items()}
                    elif number > header and cells:
                        out.append((at, number, *(cells.get(names.get(c.strip().lower(), -1)) for c in columns)))
                yield pd.DataFrame(out, columns=["path", "row", *columns])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Columns in their order; floating numbers with fixed digits."""
    fixed = [F.format_string(f"%.{digits}f", f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*fixed).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, null keys kept, no escapes for letters outside ASCII."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def round_trip(df: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with `side`; empty after a faithful write. Counts of equal rows matter."""
    return df.exceptAll(again).withColumn("side", F.lit("written")).unionByName(again.exceptAll(df).withColumn("side", F.lit("read")))


def replace(df: DataFrame, path: str, backup: bool = True) -> None:
    """Writes beside `path`, then renames twice: readers see the old table, for the moment between the renames none, then the
    new one, and never a part of one. The old one stays as path.bak. Where readers may never miss a table, write versions
    (streaming.incremental)."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.bak"), True)
        fs.rename(at(path), at(f"{path}.bak"))
    fs.rename(at(f"{path}.new"), at(path))
    if not backup:
        fs.delete(at(f"{path}.bak"), True)


def merge_shards(shards: DataFrame, key: str, path: str = "path") -> DataFrame:
    """A row for each key; the row of the later file name wins."""
    return shards.groupBy(key).agg(F.max_by(F.struct(*(c for c in shards.columns if c != key)), path).alias("_r")).select(key, "_r.*")
