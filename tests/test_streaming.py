import datetime as dt

from corpuslode.rules import FAMILIES
from corpuslode.streaming import live


def _drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_live_scan_equals_batch(spark, files, tmp_path):
    rows = files(("p", "a.ts", "eval(x)", "node"), ("p", "b.ts", "fine", "node"))
    rows.write.parquet(str(tmp_path / "in"))
    got = _drain(live.live_scan(live.arriving_files(spark, str(tmp_path / "in")), FAMILIES["injection"]).select("path", "title"), "live_scan")
    assert [tuple(r) for r in got] == [("a.ts", "Code Injection via eval()")]


def _events(spark, tmp_path, minutes):
    base = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, k string"
    for i, m in enumerate(minutes):
        spark.createDataFrame([(base + dt.timedelta(minutes=m), "x")], schema).write.parquet(str(tmp_path / "ev" / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "ev"))


def test_live_dedupe_and_windows(spark, tmp_path):
    stream = _events(spark, tmp_path, [1, 2, 3, 700])
    assert len(_drain(live.live_dedupe(stream, keys=["k"], delay="1 day"), "live_dedupe")) == 1
    windows = _drain(live.counts_per_window(stream, "k"), "live_windows")
    assert [r.n for r in windows] == [3]  # the last window is still open
    sessions = _drain(live.counts_per_session(stream, "k"), "live_sessions")
    assert [r.n for r in sessions] == [3]
