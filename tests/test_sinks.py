import json

from pyspark.sql import functions as F

from quarrylight.operators.scan import scan_rules
from quarrylight.sinks import reports
from quarrylight.sinks.store import Store, load_settings, save_settings
from quarrylight.streaming.ingest import landing_stream, scan_stream

from .test_scan import code


def test_csv_and_json(spark, tmp_path):
    f = scan_rules(code(spark, 'x = "a\'b.sql" , "/v1/é,x"; e("f.sql")'))
    reports.write_csv(f, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"')
    assert sorted(r.Value for r in back.collect()) == sorted(r.value for r in f.collect())
    reports.write_json(f, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == f.count()


def test_html_report_escapes(spark):
    page = reports.report_html(scan_rules(code(spark, '<b dangerouslySetInnerHTML={x}> "a<b.sql"')), "<t>")
    assert "&lt;t&gt;" in page and "a&lt;b.sql" in page and "Emails" not in page


def test_html_report_has_every_finding(spark):
    f = scan_rules(code(spark, " ".join(f'"f{i}.sql"' for i in range(1200))))
    page = reports.report_html(f)
    assert f.count() >= 1200 and page.count("<tr><td>") == f.count() and all(f"f{i}.sql" in page for i in range(1200))


def test_collections(spark):
    f = scan_rules(code(spark, '"/u/:id/x" "https://h.example.org/a" "/u/:id/x"'))
    c = json.loads(reports.postman(f).first().collection)
    assert [i["request"]["url"]["raw"] for i in c["item"]] == ["https://h.example.org/a", "{{baseUrl}}/u/:id/x"]
    d = json.loads(reports.openapi(f, "https://h.example.org/b?c").first().document)
    assert d["servers"] == [{"url": "https://h.example.org"}] and d["paths"]["/u/{id}/x"]["get"]["parameters"][0]["name"] == "id"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a, b = s.create("one"), s.create("two")
    f = scan_rules(code(spark, "a@b.com"))
    x = s.save_analysis(a, "f.js", "a@b.com", f)
    y = s.save_analysis(b, "g.js", "", f.limit(0))
    assert s.get_analysis(x).first().summary == {"emails": 1} and s.get_analysis(y).first().total_findings == 0
    s.rename(a, "uno")
    s.rename_analysis(x, "h.js")
    assert s.analyses(a).first().file_name == "h.js"
    s.delete(a)
    assert [r.name for r in s.workspaces().collect()] == ["two"] and [r.id for r in s.analyses().collect()] == [y]
    s.delete_analysis(y)
    assert s.analyses().count() == 0


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    assert load_settings(p) == ({}, 4.5)
    save_settings(p, {"emails": False}, 0)
    assert load_settings(p) == ({"emails": False}, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a.js", "a@b.com a@b.com"), ("b.js", "c@d.org")], "path string, content string").withColumn("landed_at", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    q = scan_stream(landing_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.source_file, r.value) for r in spark.table("found").collect()) == [("a.js", "a@b.com"), ("b.js", "c@d.org")]
