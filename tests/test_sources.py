"""Study text, files, paged sources and log streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from orestrata.sources import files as FS
from orestrata.sources import soft
from orestrata.sources.paged import FolderTransport, PagedCatalog, fetch
from orestrata.streaming import logs as L
from orestrata.streaming.sinks import LedgerSink, bulk_report

GOOD = """^DATABASE = GeoMiame
!Database_name = x
^SERIES = GSE1
!Series_geo_accession = GSE1
!Series_title = table-bearing study of 10x Genomics cells
!Series_summary = one
!Series_summary = two
!Series_type = Expression profiling by array
!Series_submission_date = Jan 01 2024
!Series_last_update_date = 2024-01-02
!Series_sample_id = GSM11
!Series_sample_id = GSM2
!series_table_begin = Comparison values
ID_REF\tlog fold change
!Series_title = not this
!series_table_end
ignored line
^SAMPLE = GSM11
!Sample_geo_accession = GSM11
!Sample_title = first
!Sample_organism_ch1 = Homo sapiens
!Sample_characteristics_ch1 = sex: female
!Sample_characteristics_ch1 = disease: status: active
!Sample_characteristics_ch1 = plain
^SAMPLE = GSM2
!Sample_geo_accession = GSM2
!Sample_title = second
!Sample_organism_ch1 = Homo sapiens
!Sample_characteristics_ch1 = gender: F
"""


def _parse(spark, tmp_path, files):
    for name, text in files.items():
        data = text if isinstance(text, bytes) else text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return {r.file.rsplit("/", 1)[1]: r for r in soft.parse_records(soft.read_files(spark, str(tmp_path))).collect()}


def test_golden_record(spark, tmp_path):
    r = _parse(spark, tmp_path, {"GSE1_family.soft.gz": GOOD})["GSE1_family.soft.gz"]
    assert r.error is None and r.gse == "GSE1" and r.n_samples == 2 and r.summary == "one\ntwo"
    assert r.sample_accessions == ["GSM2", "GSM11"] and r.organism_ids == ["NCBITaxon:9606"] and r.sex_ids == ["PATO:0000383"]
    assert str(r.submission_date) == "2024-01-01" and str(r.last_update_date) == "2024-01-02"
    assert r.assay_categories == ["expression (array)"] and r.assay_labels == ["10x Chromium"] and r.assay_status == "detailed"
    named = {c["name"]: c["values"] for c in r.characteristics}
    assert named["disease"] == ["status: active"] and named[""] == ["plain"]
    assert r.embed_text.startswith("Title: table-bearing") and "not this" not in r.embed_text


def test_errors_stay_with_their_file(spark, tmp_path):
    got = _parse(spark, tmp_path, {
        "GSE1_ok.soft": GOOD, "GSE2_x.soft": GOOD, "GSE3_x.soft": "^SERIES = GSE3\n!Series_sample_id = GSM1\n", "GSE4_x.soft": GOOD.replace("!series_table_end\n", ""),
        "GSE5_x.soft": b"\xff\xfe", "GSE6_x.soft": "\n", "GSE7_x.soft": "^SERIES = GSE7\n!Sample_title = t\n", "GSE8_x.soft": "^SERIES = GSE8\n!Series_submission_date = someday\n",
        "GSE9_x.soft": "^SERIES = GSE9\n!Series_sample_id = GSM1\n!Series_sample_id = GSM1\n^SAMPLE = GSM1\n^SAMPLE = GSM1\n"})
    said = {k[:4]: v.error for k, v in got.items()}
    assert said == {"GSE1": None, "GSE2": "file names another study", "GSE3": "declared samples differ", "GSE4": "unterminated table", "GSE5": "unreadable: UnicodeDecodeError",
                    "GSE6": "not exactly one study block", "GSE7": "attribute outside its block", "GSE8": "unknown date form", "GSE9": "repeated sample"}
    assert got["GSE2_x.soft"].title is None


@pytest.mark.parametrize(("old", "new", "error"), [
    ("^SAMPLE = GSM2", "^SAMPLE", "malformed header"), ("^SAMPLE = GSM2", "^THING = GSM2", "unknown block"), ("!Series_summary = one", "! = one", "malformed attribute"),
    ("!Series_geo_accession = GSE1\n", "", "no series accession"), ("!Series_geo_accession = GSE1", "!Series_geo_accession = GSE7", "series accession differs"),
    ("!Series_title = table", "!Series_other = table", "no series title"), ("!Sample_geo_accession = GSM2\n", "", "no sample accession"),
    ("!Sample_geo_accession = GSM2", "!Sample_geo_accession = GSM3", "sample accession differs"), ("!Sample_title = second", "!Sample_title = ", "sample without title"),
    ("!Series_sample_id = GSM2", "!Series_sample_id = GSM2\n!Series_sample_id = GSM2", "declared samples differ"),
    ("^SAMPLE = GSM11", "^PLATFORM = GPL1\n!Platform_title = x\n^SAMPLE = GSM11", "no platform accession"), ("^SAMPLE = GSM11", "^SERIES = GSE1\n^SAMPLE = GSM11", "not exactly one study block")])
def test_kinds_of_errors(spark, old, new, error):
    assert old in GOOD
    files = spark.createDataFrame([("GSE1_family.soft.gz", GOOD.replace(old, new, 1), None)], "file string, text string, error string")
    assert soft.parse_records(files).first().error == error


def test_files_are_streamed(spark, tmp_path):
    big = GOOD + "^SAMPLE = GSM2\n" + "row\n" * 300_000
    (tmp_path / "GSE1_family.soft.gz").write_bytes(gzip.compress(GOOD.encode()))
    (tmp_path / "GSE2_family.soft.gz").write_bytes(gzip.compress(big.encode()))
    (tmp_path / "GSE3_family.soft.gz").write_bytes(gzip.compress(GOOD.encode() + b"\xff\n"))
    got = {r.file.rsplit("/", 1)[1][:4]: r for r in soft.records_of(soft.stream_blocks(spark, str(tmp_path))).collect()}
    assert got["GSE1"].error is None and got["GSE1"].n_samples == 2
    assert got["GSE2"].error == "file names another study" and got["GSE3"].error == "not UTF-8"


def test_reconstruction(spark):
    raw = "^SERIES = GSE1\n!Series_title = t\n^SAMPLE = GSM1\n!sample_table_begin\nx\n!sample_table_end"
    good = raw.split("!sample_table_begin")[0].rstrip("\n")
    stripped = spark.createDataFrame([("GSE1", good), ("GSE2", good), ("GSE3", "x")], "gse string, text string")
    kept = spark.createDataFrame([("GSE1", raw), ("GSE3", raw)], "gse string, text string")
    got = soft.reconstruction(stripped, kept)
    assert {(r.gse, r.checked, r.differs) for r in got.collect()} == {("GSE1", True, False), ("GSE2", False, False), ("GSE3", True, True)}
    assert tuple(soft.validation_outcomes(got).first()) == (3, 2, 2, 1)


def test_long_files_take_linear_time(spark):
    text = "!sample_table_begin\n" + "a\tb\n" * 200_000 + "!sample_table_end\nkept\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(soft.strip_tables(F.col("t"))).first()[0] == "kept\n"


def test_strip_tables(spark):
    text = "a\n!sample_table_begin\nx\n!platform_table_begin\n!series_matrix_table_end\nb\n!sample_table_end\n!series_table_begin\nkeep\n!series_table_end"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(soft.strip_tables(F.col("t"))).first()[0] == "a\nb\n!sample_table_end\n!series_table_begin\nkeep\n!series_table_end"
    assert df.select(soft.problems(F.col("t"), F.lit("GSE1"))).first()[0] == ["no_series", "no_sample", "no_title", "leftover_table", "other_accession"]
    ok = spark.createDataFrame([(GOOD,)], "t string")
    assert ok.select(soft.problems(F.col("t"), F.lit("GSE1"))).first()[0] == []


def test_record_tree(spark, tmp_path):
    df = spark.createDataFrame([("GSE1234", "t")], "gse string, title string")
    FS.write_records(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "bucket=GSE1nnn").is_dir()
    tree = tmp_path / "tree" / "GSE1nnn"
    tree.mkdir(parents=True)
    (tree / "GSE1.json").write_text(json.dumps({"gse": "GSE1", "title": "t"}))
    (tree / "GSE2.json").write_text(json.dumps({"gse": "GSE9", "title": "t"}))
    got = {r.gse: r.error for r in FS.read_records(spark, str(tmp_path / "tree")).collect()}
    assert got == {"GSE1": None, "GSE9": "file name differs"}


def test_vectors(spark, tmp_path):
    rows = [("GSE10", 1, [1.0, 2.0]), ("GSE2", 0, [0.0, 1.0]), ("GSE3", 2, [1.0]), ("GSE4", 3, [float("nan"), 1.0]), ("GSE2", 4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, row int, vector array<float>")
    FS.write_vectors(df, str(tmp_path / "v"))
    got = sorted((r.id, r.error or "") for r in FS.read_vectors(spark, str(tmp_path / "v"), 2).collect())
    assert got == [("GSE10", ""), ("GSE2", "repeated id"), ("GSE2", "repeated id"), ("GSE3", "wrong dimension"), ("GSE4", "not finite")]


def test_cases(tmp_path, spark):
    p = tmp_path / "c.jsonl"
    p.write_text('{"query_id": "a", "query": "x", "judgments": {"GSE1": 3}}\n\n')
    cases = FS.load_cases(str(p))
    q, qrels = FS.cases_frame(spark, cases)
    assert q.count() == 1 and qrels.first().grade == 3
    for bad in ('{"query_id": "a", "query": "x", "extra": 1}', '{"query_id": "a", "query": " "}', '{"query_id": "a", "query": "x", "judgments": {"g": 4}}',
                '{"query_id": "a", "query": "x"}\n{"query_id": "a", "query": "y"}'):
        p.write_text(bad)
        with pytest.raises(ValueError):
            FS.load_cases(str(p))


def test_jsonl_and_batch_results(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"accession": "GSE1"}\nnot json\n{"other": 1}\n')
    schema = spark.createDataFrame([], "accession string").schema
    assert [r.accession for r in FS.read_jsonl(spark, str(tmp_path / "c.jsonl"), schema, "accession").collect()] == ["GSE1"]
    asked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "key string, pos int")
    said = spark.createDataFrame([("a", [1.0, 2.0], None), ("b", [1.0], None), ("c", None, "boom"), ("c", None, "boom"), ("z", [1.0, 1.0], None)], "key string, vector array<float>, error string")
    got = {r.key: r.error for r in FS.batch_results(said, asked, 2).collect()}
    assert got == {"a": None, "b": "wrong dimension", "c": "repeated", "d": "missing", "z": "unasked"}


def test_reports(spark, tmp_path):
    FS.write_report({"b": 1, "a": "ü"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": "ü", "b": 1}
    md = FS.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string"))
    assert md.splitlines()[-1] == "| a\\|b |  |"


def test_paged_source(spark, tmp_path):
    records = [{"uid": i, "accession": f"GSE{i}", "entrytype": "GSE", "title": f"liver {i}", "oversized": i == 5} for i in range(23)] + [{"uid": 99, "title": "brain"}]
    (tmp_path / "catalog.json").write_text(json.dumps(records))
    t = FolderTransport({"folder": str(tmp_path), "most": "3"})
    assert [r["uid"] for r in fetch(t, "liver", 0, 23)] == [i for i in range(23) if i != 5]
    spark.dataSource.register(PagedCatalog)
    df = spark.read.format("paged_catalog").option("folder", str(tmp_path)).option("term", "liver").option("page_size", "10").option("most", "3").load()
    assert sorted(r.uid for r in df.collect()) == [i for i in range(23) if i != 5]
    none = spark.read.format("paged_catalog").option("folder", str(tmp_path)).option("term", "zzz").load()
    assert none.count() == 0


def test_log_parse(spark):
    lines = ['{"event":"a","level":"info","logger":"svc.x","message":"password=hunter2 ok","event_id":"1","timestamp":"2024-01-01T00:00:00Z"}',
             "Bearer abc plain", '{"event":"request.completed","method":"GET","route":"/healthz","status_code":200}',
             '{"event":"request.completed","method":"GET","route":"/healthz","status_code":500}', '{"event":"x","method":"POST","route":"/ready","status_code":201}', '{"logger":"noise.a"}', "{broken", "x" * 100]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    got = L.parse(df, excluded=("noise.",), most_bytes=200).collect()
    messages = {r.message for r in got}
    assert "password=[REDACTED] ok" in messages and "Bearer [REDACTED] plain" in messages and "{broken" in messages
    assert all(r.event_id and r.level for r in got) and not any(r.logger == "noise.a" for r in got)
    assert sum(r.route == "/healthz" for r in got) == 1 and sum(r.route == "/ready" for r in got) == 1


def test_nested_secrets_and_unknown_fields(spark):
    event = {"request": {"Authorization": "x", "list": [{"Set-Cookie": "sid=1"}, "api-key: k1, left"], "n": 3}, "note": 'password="a b" end', "extra": None}
    df = spark.createDataFrame([(json.dumps(event),), ("{}",), ('{"p\\u0061ssword": "zz"}',)], "value string")
    bodies = [json.loads(r.body) for r in L.parse(df).collect()]
    assert bodies[0]["request"] == {"Authorization": "[REDACTED]", "list": [{"Set-Cookie": "[REDACTED]"}, "api-key: [REDACTED], left"], "n": 3}
    assert bodies[0]["note"] == "password=[REDACTED] end" and bodies[0]["extra"] is None
    assert all({"event_id", "timestamp", "level", "logger"} <= set(b) for b in bodies)
    assert bodies[2]["password"] == "[REDACTED]"


def test_queue_and_retries():
    now = [0.0]
    q = L.EventQueue(2, 10, clock=lambda: now[0])
    assert [q.put(x) for x in (b"aaaa", b"bbbb", b"c")] == [True, True, False] and q.drops() == 1
    q.put(b"cccc")
    assert q.drops() == 0 and q.take(1) == [b"aaaa"]
    now[0] = 61.0
    assert q.drops() == 1 and q.take() == [b"bbbb"] and q.take() == []
    waits, left = [], [2]

    def send(payload):
        left[0] -= 1
        if left[0] >= 0:
            raise ConnectionError()

    assert L.with_retries(send, wait=waits.append)(b"x") and waits == [1.0, 2.0]
    left[0] = 99
    assert not L.with_retries(send, attempts=3, wait=waits.append)(b"x")
    payloads = list(L.NdjsonSink(print, 2, 12).payloads(["a" * 4, "b" * 4, "c" * 4, "d" * 50]))
    assert [p.count(b"\n") for p in payloads] == [2, 1, 1]
    for bad in ("ftp://x/y", "x"):
        with pytest.raises(ValueError):
            L.http_sender(bad)



def test_ledger_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    sink = LedgerSink(str(tmp_path / "s"))
    assert sink.read(spark, df.schema).count() == 0
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert sink.read(spark, df.schema).count() == 4
    assert {r.status: r.retry for r in bulk_report(spark.createDataFrame([(200,), (429,)], "status int")).collect()} == {200: False, 429: True}
