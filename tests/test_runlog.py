"""Run logs written as files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowdrift.operators import runlog
from flowdrift.sources import readers, sinks

RUN = """12:00 INFO start modelVariant=RandomForest ceType=APPROX_TCE
12:01 INFO [==OVERALL SIM STATS==] Total simulate time: 12.5s
12:02 INFO === CE Model Calibration Summary ===
12:02 INFO [==OVERALL SIM STATS==] Avg Accuracy: 0.9100
12:03 INFO === Classifier Model Performance Summary ===
12:03 INFO [==OVERALL SIM STATS==] Avg Accuracy: 0.8800
12:03 INFO [==OVERALL SIM STATS==] Average Chunk Size: 12.00
12:03 INFO [==OVERALL SIM STATS==] Timing — Count: 3 | Mean: 0.1s
12:04 INFO __main__: Full performance stats: perf_stats = PerformanceStats(iteration_times=[], ce_stats=ModelStats(accuracies=[0.1], precisions=[], recalls=[], f1s=[]), classifier_stats=ModelStats(accuracies=[], precisions=[], recalls=[], f1s=[]))
12:05 INFO __main__: Full performance stats: perf_stats = PerformanceStats(iteration_times=[0.1], ce_stats=ModelStats(accuracies=[90%, nan, , 95.0], precisions=[0.5, x, 0.25], recalls=[], f1s=[1]), classifier_stats=ModelStats(accuracies=[0.7], precisions=[], recalls=[], f1s=[]))
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    for folder, text in {"svm_runs": RUN.replace("modelVariant=RandomForest ", ""), "cce": RUN, "old_runs": RUN}.items():
        (base / folder).mkdir()
        (base / folder / "one.log").write_text(text, encoding="utf-8")
    (base / "cce" / "notes.txt").write_text("ignored")
    return readers.read_run_logs(spark, str(base)).cache()


def test_lines_keep_their_order(lines):
    assert lines.select("path").distinct().count() == 2
    texts = [r["text"] for r in lines.filter("folder = 'cce'").orderBy("line_no").collect()]
    assert texts == [t.strip() for t in RUN.splitlines()]
    assert {r["file"] for r in lines.select("file").collect()} == {"one.log"}


def test_special_characters_in_paths(spark, tmp_path):
    (tmp_path / "a+b c%41").mkdir()
    (tmp_path / "a+b c%41" / "x.log").write_text("one")
    row = readers.read_run_logs(spark, str(tmp_path)).first()
    assert row["folder"] == "a+b c%41" and row["path"] == str(tmp_path / "a+b c%41" / "x.log")


def test_a_split_file_keeps_its_order(spark, tmp_path):
    (tmp_path / "big.log").write_text("\n".join(f"line {i}" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = readers.read_run_logs(spark, str(tmp_path))
    rows = got.orderBy("line_no").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in rows] == [f"line {i}" for i in range(4000)]
    assert [r["line_no"] for r in rows] == list(range(1, 4001))


def test_stats(lines):
    stats = {r["stat"]: (r["raw"], r["value"]) for r in runlog.extract_stats(lines.filter("folder = 'cce'")).collect()}
    assert stats["Total simulate time"] == ("12.5s", 12.5)
    assert stats["[CE Model] Avg Accuracy"] == ("0.9100", 0.91)
    assert stats["[Classifier Model] Avg Accuracy"][1] == 0.88
    assert stats["Average Chunk Size"][1] == 12.0
    assert stats["[Classifier Model] Timing — Count"][1] is None


def test_names(lines):
    got = {r["path"].split("/")[-2]: (r["classifier"], r["ce_type"]) for r in runlog.run_names(lines).collect()}
    # the spelling "cce" is not in "approx_tce", "tce" is, and it comes first in the list
    assert got == {"cce": ("rf", "tce"), "svm_runs": ("svm", "tce")}


@pytest.mark.parametrize(("token", "name"), [("APPROX_CCE", "approx-cce"), ("cce", "cce"), ("service", "ice"), ("baseline", "none"), ("zzz", None)])
def test_first_spelling_wins(spark, token, name):
    assert spark.range(1).select(runlog.canonical_name(F.lit(token), runlog.CE_NAMES)).first()[0] == name


def test_last_series_and_export(spark, lines, tmp_path):
    table = runlog.runs_by_group(lines)
    mine = table.filter("classifier = 'rf'")
    got = {(r["series"], r["metric"]): [] for r in mine.collect()}
    for r in mine.orderBy("step").collect():
        got[(r["series"], r["metric"])].append((r["step"], r["value"]))
    assert got[("ce", "accuracies")] == [(1, 90.0), (2, 95.0)]
    assert got[("ce", "precisions")] == [(1, 0.5), (2, 0.25)]
    assert got[("classifier", "accuracies")] == [(1, 0.7)]
    scaled = {(r["series"], r["metric"], r["step"]): r["value"] for r in runlog.rescale_percent(mine).collect()}
    assert scaled[("ce", "accuracies", 2)] == 0.95 and scaled[("classifier", "accuracies", 1)] == 0.7 / 100
    assert scaled[("ce", "f1s", 1)] == 1.0
    sinks.write_metrics_long(table, str(tmp_path / "m"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "m"))
    assert back.columns == sinks.METRIC_COLUMNS and back.count() == table.count()


def test_listed_evaluators_only(lines):
    assert runlog.runs_by_group(lines, ["cce"]).count() == 0


def test_maxima_are_not_broadcast(spark):
    """One maximum per classifier may be millions: they are shuffled, however small Spark takes them to be."""
    rows = [("a", "f1s", 40.0), ("a", "f1s", 0.5), ("b", "f1s", 0.5), (None, "f1s", 2.0)]
    scaled = runlog.rescale_percent(spark.createDataFrame(rows, "classifier string, metric string, value double"))
    assert sorted((r["classifier"] or "", r["value"]) for r in scaled.collect()) == [("", 0.02), ("a", 0.005), ("a", 0.4), ("b", 0.5)]
    assert "Broadcast" not in scaled._jdf.queryExecution().executedPlan().toString()


def test_folder_names_are_taken_without_a_search(spark, tmp_path):
    (tmp_path / "kind=a b").mkdir()
    (tmp_path / "kind=a b" / "x.log").write_text("one\ntwo\n")
    got = readers.read_run_logs(spark, str(tmp_path))
    assert [(r["folder"], r["line_no"], r["text"]) for r in got.orderBy("line_no").collect()] == [("kind=a b", 1, "one"), ("kind=a b", 2, "two")]
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()
