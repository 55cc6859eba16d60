"""The stream of batches, and stored JSON."""

import json

from gritmill.sources.reports import merged_settings, newest_export, read_baseline, read_catalog, read_reviews
from gritmill.streaming.batches import start_classification
from helpers import finding, frame


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = frame(spark, []).schema

    def run():
        q = start_classification(spark.readStream.schema(schema).parquet(src), str(tmp_path / "base"), str(tmp_path / "out"), str(tmp_path / "cp"), "2025-01-01T00:00:00Z")
        q.awaitTermination()
        return {(r.findingId, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    frame(spark, [finding(1, rule="A", findingId="X"), finding(2, rule="B", findingId="Y")]).coalesce(1).write.parquet(src)
    assert run() == {("X", "NEW"), ("Y", "NEW")}
    frame(spark, [finding(3, rule="A", findingId="X2", line=99), finding(4, rule="C", findingId="Z")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == {("X", "NEW"), ("Y", "NEW"), ("X2", "EXISTING"), ("Z", "NEW")}


def test_stored_json(spark, tmp_path):
    assert read_catalog(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "b.json").write_text(json.dumps({"tests": [{"id": "B-1", "stack": "both"}]}))
    (tmp_path / "cat" / "a.json").write_text(json.dumps({"tests": [{"id": "A-1"}, {"id": "A-2"}]}))
    (tmp_path / "cat" / "c.json").write_text("{bad")
    assert [r.id for r in read_catalog(spark, str(tmp_path / "cat")).collect()] == ["A-1", "A-2", "B-1"]
    for n, ids in (("findings2.json", ["z"]), ("findings1.json", ["x", "y"])):
        (tmp_path / n).write_text(json.dumps({"findings": [{"findingId": i, "severity": "LOW"} for i in ids]}))
    rows = read_reviews(spark, [str(tmp_path / "findings2.json"), str(tmp_path / "findings1.json")]).orderBy("seq").collect()
    assert [r.findingId for r in rows] == ["x", "y", "z"]
    (tmp_path / "base.json").write_text(json.dumps({"entries": [{"fingerprint": "f", "suppressed": {"justification": "j"}}]}))
    assert read_baseline(spark, str(tmp_path / "base.json")).first().suppressed.justification == "j"


def test_settings_and_exports(tmp_path):
    assert merged_settings({"a": {"x": 1}, "b": None}, {"a": {"x": 2, "y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    for n in ("run1", "run2"):
        (tmp_path / ".sonarqube" / n).mkdir(parents=True)
    (tmp_path / "p" / "q").mkdir(parents=True)
    assert newest_export(str(tmp_path / "p" / "q")).endswith("run2") and newest_export(str(tmp_path), name=".none") is None
