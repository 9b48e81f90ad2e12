"""Artifact versions, repeated and late requests, scored history and cost scenarios."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import impact as IM
from riskloom.plans import registry as R
from riskloom.session import shared_path
from riskloom.sources import artifacts as ART
from riskloom.sources.requests import requests_from_transactions
from riskloom.sources.transactions import fixture_cities
from riskloom.streaming import scoring as ST
from sf_paths import SF_SMALL


def test_versions_are_appended_and_whole(spark):
    path = shared_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        ART.load_version(spark, path)
    one, two = spark.range(3), spark.range(5).withColumn("x", F.lit("b"))
    assert ART.write_version(spark, path, {"t": one}) == 1
    held = ART.load_version(spark, path)["tables"]["t"]
    assert ART.write_version(spark, path, {"t": two, "Other one": one}) == 2
    assert held.count() == 3                             # a reader keeps its version
    new = ART.load_version(spark, path)
    assert new["version"] == 2 and new["tables"]["t"].count() == 5 and new["tables"]["Other one"].count() == 3
    assert ART.load_version(spark, path, 1)["tables"]["t"].count() == 3
    # a version whose manifest names fewer parts than it has is no version
    row = (3, "run-z", "now", 2, "table", "t", "t", "parquet", 0)
    spark.createDataFrame([row], ART._MANIFEST).write.mode("append").parquet(f"{path}/manifest")
    assert ART.load_version(spark, path)["version"] == 2
    log = {r.version: (r.complete, r.newest) for r in ART.versions(spark, path).collect()}
    assert log == {1: (True, False), 2: (True, True), 3: (False, False)}
    for v in (3, 7):
        with pytest.raises(FileNotFoundError):
            ART.load_version(spark, path, v)
    with pytest.raises(FileNotFoundError, match="lacks"):
        ART.load_artifacts(spark, path)


def _batch(spark, rows):
    return spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, m in rows],
                                 "request_id string, scored_at timestamp")


def test_history_reads_the_last_folders_only(spark):
    sink = shared_path(spark, "scored")
    with pytest.raises(FileNotFoundError):
        ST.history(spark, sink, 5)
    rows = []
    for b in range(12):
        part = [(100 * b + i, 10 * b + i) for i in range(8)]
        if b == 9:
            part = []                                     # an empty batch
        if b == 2:
            part.append((7777, 10 ** 6))                  # an early batch with the newest row
        ST.write_scored(_batch(spark, part), sink, b)
        rows += part
    ST.write_scored(_batch(spark, [(100 * 11 + i, 110 + i) for i in range(8)]), sink, 11)      # repeated batch
    for n in (1, 5, 9, 20, 500):
        got = [(int(r.request_id)) for r in ST.history(spark, sink, n).collect()]
        want = [i for i, _ in sorted(rows, key=lambda r: (r[1], str(r[0])), reverse=True)[:n]]
        assert got == want
    calm = shared_path(spark, "calm")
    read = []
    for b in range(30):
        ST.write_scored(_batch(spark, [(10 * b + i, 10 * b + i) for i in range(6)]), calm, b)
        if b in (9, 29):
            h = ST.history(spark, calm, 10)
            read.append(len({os.path.dirname(f) for f in h.inputFiles()}))
            assert [int(r.request_id) for r in h.collect()][0] == 10 * b + 5
    assert read == [2, 2]


def test_repeats_are_scored_once_and_late_requests_are_found(spark):
    req = requests_from_transactions(R.txh(spark, SF_SMALL)).drop("Transaction_ID")
    first, rest = req.where("request_id % 2 = 0"), req.where("request_id % 2 = 1")
    src, sink, bad = (shared_path(spark, n) for n in ("src", "sink", "bad"))

    def run():
        queries, _, _ = ST.start_scoring_stream(
            spark, src, fixture_cities(spark, SF_SMALL), R.surrogate_probability, 0.35, sink_dir=sink,
            quarantine_dir=bad, merchant_cats=R.FIXTURE_MERCHANTS, repeat_window="10 minutes")
        for q in queries:
            q.awaitTermination()
        both = spark.read.parquet(sink).select("request_id").union(spark.read.parquet(bad).select("request_id"))
        return both.count(), both.distinct().count()
    first.union(first).write.json(src)
    n = first.count()
    assert run() == (n, n)
    req.write.mode("append").json(src)                    # everything again, and the rest for the first time
    assert run() == (n + rest.count(),) * 2
    assert ST.unscored_requests(spark, src, sink, bad).count() == 0
    late = shared_path(spark, "late")
    first.limit(5).withColumn("request_id", F.concat(F.lit("late-"), "request_id")).coalesce(1).write.json(late)
    folder = src.removeprefix("file:")
    for i, f in enumerate(sorted(os.listdir(late.removeprefix("file:")))):
        if f.endswith(".json"):
            target = os.path.join(folder, f"late-{i}.json")
            with open(os.path.join(late.removeprefix("file:"), f)) as src_file, open(target, "w") as out:
                out.write(src_file.read())
            os.utime(target, (1_000_000_000, 1_000_000_000))       # a file of long ago
    assert run() == (n + rest.count(),) * 2
    found = ST.unscored_requests(spark, src, sink, bad)
    assert {r.request_id[:5] for r in found.collect()} == {"late-"} and found.count() == 5


def test_scenarios_take_the_cheapest_threshold(spark):
    sweep = spark.createDataFrame([("m", 0.1, 9, 50, 1), ("m", 0.5, 7, 10, 3), ("m", 0.9, 2, 0, 8)],
                                  "model string, threshold double, tp long, fp long, fn long")
    sc = spark.createDataFrame([("rich", 100.0, 1.0, 60.0), ("poor", 1.0, 10.0, 60.0), ("free", 0.0, 0.0, 60.0),
                                ("none", None, 1.0, 60.0)], "scenario string, cost_fn double, cost_fp double, monthly double")
    got = {r.scenario: r for r in IM.cheapest_thresholds(sweep, sc, 60).collect()}
    assert got["rich"].threshold == 0.1 and got["rich"].total == 150.0 and got["rich"].savings == 1000.0 - 150.0
    assert got["poor"].threshold == 0.9 and got["poor"].total == 8.0
    assert got["free"].threshold == 0.9 and got["free"].total == 0.0          # last on ties
    assert got["none"].total is None
    assert IM.cheapest_thresholds(sweep.limit(0), sc, 60).count() == 0


def test_only_the_line_is_exchanged_for_repeats(spark, monkeypatch):
    parse, seen = ST.parse_requests, []
    monkeypatch.setattr(ST, "parse_requests", lambda lines: (seen.append(lines.columns), parse(lines))[1])
    src, sink, bad = (shared_path(spark, n) for n in ("line-src", "line-sink", "line-bad"))
    spark.createDataFrame([('{"request_id": "1"}',), ('{"request_id": "1"}',)], "value string").write.text(src)
    cities = spark.createDataFrame([("a", "b", 0.0, 0.0)], "city string, country string, lat double, lon double")
    queries, _, _ = ST.start_scoring_stream(spark, src, cities, R.surrogate_probability, 0.35, sink_dir=sink,
                                            quarantine_dir=bad, repeat_window="10 minutes")
    queries[0].awaitTermination()
    assert seen == [["value"]]
    assert [r.request_id for r in spark.read.parquet(bad).collect()] == ["1"]
