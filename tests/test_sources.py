"""Readers and writers on small files, and the paged source against a local server."""

import json
import threading
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

from curatrix.sources import files, reports


def test_csv_policies_and_separator(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('k\tv\n1\t"x ""y""\nz"\n2\t\n3\tNA\n')
    rows = files.read_delimited(spark, str(tmp_path / "a.tsv")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("1", 'x "y"\nz'), ("2", ""), ("3", "NA")]
    assert [r.v for r in files.read_csv(spark, str(tmp_path / "a.tsv"), "\t", files.NA).orderBy("k").collect()] == ['x "y"\nz', None, None]


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1,"b":"é"}\n\n{"a":\n[1]\n{"b":null}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "é"), (None, None)]
    assert sorted(r.line for r in bad.collect()) == ['[1]', '{"a":']
    files.write_jsonl(good, str(tmp_path / "out"))
    again, none = files.read_jsonl(spark, str(tmp_path / "out"), "a int, b string")
    assert files.round_trip(good, again).count() == 0 and none.count() == 0
    assert "é" in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_lines_splits_and_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# words\nb \n\n a\n")
    assert [tuple(r) for r in files.read_lines(spark, str(tmp_path / "v.txt")).orderBy("pos").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "val.csv").write_text("a\n1\n")
    assert files.find_split(spark, str(tmp_path), ("validation", "val")).endswith("/val.csv")
    assert [r.bytes for r in files.list_files(spark, str(tmp_path), 1, r".*\.csv").collect()] == [4]


def test_results_of_two_layouts(spark, tmp_path):
    for name, doc in (("m1-base", {"verdict": {"acc": 0.5}}), ("m2-tuned", {"acc": 0.75})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps(doc))
    got = files.read_results(spark, str(tmp_path / "*/r.json"), [(r"/([^/-]+)-([^/]+)/r\.json$", ("model", "arm"))], {"acc": ("$.verdict.acc", "$.acc")})
    assert sorted(map(tuple, got.select("model", "arm", "acc").collect())) == [("m1", "base", "0.5"), ("m2", "tuned", "0.75")]


def test_tables_in_prose(spark):
    text = "x\n| A | B |\n|---|:-:|\n| 1 | **2** |\ny\nM & \\textbf{91.4} & 5\\% \\\\ \\hline\n"
    got = files.table_rows(spark.createDataFrame([(1, text)], "k int, t string"), "t", "k").orderBy("row").collect()
    assert [(r.row, r.cells) for r in got] == [(0, ["A", "B"]), (1, ["1", "2"]), (2, ["M", "91.4", "5%"])]


def test_xlsx_by_header(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>Score</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3"><v>4</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Id</t></si><si><r><t>s</t></r><r><t>7</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ("id", "score", "gone")).collect()
    assert [tuple(r)[1:] for r in got] == [(3, "s7", "4", None)]


def test_replace_and_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace(spark.range(2), path)
    files.replace(spark.range(3), path)
    assert (spark.read.parquet(path).count(), spark.read.parquet(path + ".bak").count()) == (3, 2)
    shards = spark.createDataFrame([(1, "a", "f1"), (1, "b", "f2"), (2, "c", "f1")], "k int, v string, path string")
    assert sorted(tuple(r) for r in files.merge_shards(shards, "k").select("k", "v").collect()) == [(1, "b"), (2, "c")]


def test_paged_source(spark):
    reported = [{"safetyreportid": str(i), "receivedate": f"2024{1 + i % 2:02d}05", "patient": {"patientonsetage": "40" if i else "x", "patientonsetageunit": "801", "patientweight": "70", "drug": [{"medicinalproduct": " ASPIRIN "}]}} for i in range(7)]
    failed = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            if not failed:
                failed.append(1)
                self.send_error(500)
                return
            month = q["search"][0].split("[")[1][:6]
            found = [r for r in reported if r["receivedate"].startswith(month)][int(q["skip"][0]) :][: int(q["limit"][0])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": found}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(reports.PagedSource)
        raw = spark.read.format("paged_reports").options(url=f"http://127.0.0.1:{server.server_port}/", first="2024-01", last="2024-03", size="2", wait="0.01").load().collect()
    finally:
        server.shutdown()
    assert sorted(json.loads(r.value)["safetyreportid"] for r in raw) == [str(i) for i in range(7)]
    flat = reports.compact(spark.createDataFrame(raw + raw, "month string, value string")).orderBy("safetyreportid").collect()
    assert [r.safetyreportid for r in flat] == [str(i) for i in range(1, 7)]
    assert flat[0].drugs[0].product == "aspirin" and flat[0].age == 40.0
