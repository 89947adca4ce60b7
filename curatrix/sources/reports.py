"""A paged REST source of event reports as a Spark data source, and the reports' projection."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_REPORT = (
    "safetyreportid string, receivedate string, primarysourcecountry string, serious string, seriousnessdeath string, seriousnesshospitalization string, seriousnesslifethreatening string, "
    "patient struct<patientonsetage:string,patientonsetageunit:string,patientsex:string,patientweight:string,reaction:array<struct<reactionmeddrapt:string>>,"
    "drug:array<struct<drugcharacterization:string,medicinalproduct:string,drugindication:string,drugdosagetext:string,drugadministrationroute:string>>>"
)


class Window(InputPartition):
    def __init__(self, first: str, last: str):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """A partition for each month; pages of it are read one after the other, with waits that double after errors."""

    def __init__(self, options: dict):
        self.url, self.field = options["url"], options.get("field", "receivedate")
        self.first, self.last = options["first"], options["last"]
        self.size, self.tries = int(options.get("size", "100")), int(options.get("tries", "5"))
        self.wait = float(options.get("wait", "1"))

    def partitions(self):
        import calendar

        year, month = map(int, self.first.split("-"))
        out = []
        while f"{year:04d}-{month:02d}" <= self.last:
            out.append(Window(f"{year:04d}{month:02d}01", f"{year:04d}{month:02d}{calendar.monthrange(year, month)[1]:02d}"))
            year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        return out

    def _get(self, query: dict) -> dict:
        for turn in range(self.tries):
            try:
                with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return {"results": []}
                if turn == self.tries - 1:
                    raise
            except OSError:
                if turn == self.tries - 1:
                    raise
            time.sleep(self.wait * 2**turn)
        raise ValueError("tries must be at least 1")

    def read(self, partition: Window) -> Iterator[tuple]:
        at = 0
        while True:
            found = self._get({"search": f"{self.field}:[{partition.first} TO {partition.last}]", "limit": self.size, "skip": at}).get("results", [])
            for one in found:
                yield partition.first[:6], json.dumps(one, ensure_ascii=False)
            if len(found) < self.size:
                return
            at += len(found)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_reports").options(url=, first="2024-01", last="2024-12")."""

    @classmethod
    def name(cls) -> str:
        return "paged_reports"

    def schema(self) -> str:
        return "month string, value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def compact(df: DataFrame, value: str = "value") -> DataFrame:
    """Reports flattened, one for each id (the latest received, ties by text); those without a numeric age in years and
    weight are left out."""
    r = df.select(value, F.from_json(value, _REPORT).alias("r")).select(value, "r.*")
    drugs = F.transform("patient.drug", lambda d: F.struct(d["drugcharacterization"].alias("role"), F.lower(F.trim(d["medicinalproduct"])).alias("product"), d["drugindication"].alias("indication"), d["drugdosagetext"].alias("dose"), d["drugadministrationroute"].alias("route")))
    flags = F.create_map(*(x for k in ("death", "hospitalization", "lifethreatening") for x in (F.lit(k), F.coalesce(F.col(f"seriousness{k}") == "1", F.lit(False)))))
    age = F.when(F.col("patient.patientonsetageunit") == "801", F.expr("try_cast(patient.patientonsetage AS double)"))
    flat = r.select(
        "safetyreportid", "receivedate", F.col("primarysourcecountry").alias("country"), (F.col("serious") == "1").alias("serious"), flags.alias("seriousness"),
        age.alias("age"), F.col("patient.patientsex").alias("sex"), F.expr("try_cast(patient.patientweight AS double)").alias("weight"),
        F.transform("patient.reaction", lambda x: x["reactionmeddrapt"]).alias("reactions"), drugs.alias("drugs"), F.col(value).alias("_v"),
    ).where("safetyreportid is not null and age is not null and weight is not null")
    best = F.max_by(F.struct(*(c for c in flat.columns if c not in ("safetyreportid", "_v"))), F.struct("receivedate", "_v"))
    return flat.groupBy("safetyreportid").agg(best.alias("_r")).select("safetyreportid", "_r.*")
