import io
import json
import zipfile

from pyspark.sql import functions as F

from quillgraph.sources import readers, sinks
from quillgraph.streaming import eventlog


def test_page_labels(spark, tmp_path):
    lines = ['{"document_id": "d", "page_index": 1, "label": "a"}', "", "{bad", '{"document_id": "d", "page_index": null, "label": "x"}', '{"document_id": "d", "page_index": 1, "label": "b", "confidence": 0.5}', '{"document_id": "d", "page_index": "two", "label": "c"}']
    (tmp_path / "labels.jsonl").write_text("\n".join(lines))
    got = readers.page_labels(spark, str(tmp_path / "labels.jsonl")).collect()
    assert [(r.page_index, r.label) for r in got] == [(1, "b")]


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nx".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbfok")
    (tmp_path / "d.txt").write_bytes(b"a\x00b")
    (tmp_path / "e.txt").write_bytes("zwei".encode("utf-16"))
    got = {r.path[-5]: r.text for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "é\nx", "b": "é", "c": "ok", "d": None, "e": "zwei"}


def test_zips(spark, tmp_path):
    for name in ("one", "two"):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("docs/My Report.txt", name)
            z.writestr("../evil.txt", "no")
        (tmp_path / f"{name}.zip").write_bytes(raw.getvalue())
    got = readers.zips(spark, str(tmp_path)).collect()
    assert sorted(r.document_id for r in got if r.content is not None) == ["my_report", "my_report__2"]
    assert {r.reason for r in got if r.content is None} == {"unsafe path"}


def test_folders_and_arrays(spark, tmp_path):
    for d, n in (("b", 2), ("a", 1)):
        (tmp_path / "docs" / d).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "docs" / d / f"{i}.json").write_text(json.dumps([{"x": i}, {"x": i + 1}]))
    assert [(r.document_id, r.n_files) for r in readers.folders(spark, str(tmp_path / "docs")).collect()] == [("a", 1), ("b", 2)]
    assert readers.json_array(spark, str(tmp_path / "docs/b"), "x int").count() == 4


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, seq int")
    sinks.write_upsert(old, new, ["k"], "seq", str(tmp_path / "v2"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "v2")).select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    pages = spark.createDataFrame([("d", 1, "memo", "A"), ("d", 2, "memo", "B"), ("e", 1, None, "C")], "document_id string, page int, label string, text string")
    catalog = spark.createDataFrame([("d", "Title", "2018 January 04")], "document_id string, title string, dd string")
    got = {r.document_id: r for r in sinks.search_documents(pages, catalog).collect()}
    assert (got["d"].family, got["d"].body, got["d"].date, got["e"].family) == ("MEMO", "A\nB", "2018-01-04", "DOCUMENT")
    points = sinks.page_points(pages, pages.select("document_id", "page", F.array(F.lit(1.0), F.lit(2.0)).alias("vector")), 2)
    assert {(r.document_id, r.label) for r in points.collect()} == {("d", "memo"), ("e", "unknown")}


def test_event_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"event_id": "1", "run_id": "r", "operator": "o", "kind": "k", "severity": "INFO", "ts": "2024-01-01T00:00:00Z", "payload": "{}"}
    lines = [event, event, event | {"event_id": "2", "severity": "WHAT"}, event | {"event_id": "3"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    rows = eventlog.unique(eventlog.valid(eventlog.events(spark, str(tmp_path / "in"))))
    eventlog.append(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]
