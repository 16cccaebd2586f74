from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from urlloom.functions import params, urls
from urlloom.kernel.pattern import URLPattern
from urlloom.streaming import urls as stream


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def visits(spark, folder):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), u, url) for m, u, url in [(0, 1, "http://A.b/x#1"), (1, 1, "http://a.b/x#2"), (4, 2, "http://a.b/y"), (20, 1, "http://ü.c/"), (21, 2, "nonsense"), (22, 2, None), (300, 9, "http://last.d/")]]
    spark.createDataFrame(rows, "ts timestamp, user long, url string").coalesce(1).write.parquet(f"{folder}/in")
    return spark.readStream.schema("ts timestamp, user long, url string").parquet(f"{folder}/in")


def test_windows_sessions_and_first_seen(spark, tmp_path):
    source = visits(spark, str(tmp_path))
    got = drained(stream.host_windows(source, "url", "ts", "10 minutes", "1 minute"), "w")
    assert sorted((r.start.minute, r.hostname, r.n) for r in got) == [(0, "a.b", 3), (20, "xn--tda.c", 1)]
    got = drained(stream.host_windows(source, "url", "ts", "10 minutes", "1 minute", slide="5 minutes"), "s")
    assert len(got) == 4
    got = drained(stream.host_sessions(source, "url", "ts", "user", "5 minutes", "1 minute"), "v")
    assert sorted((r.user, r.hostname, r.n) for r in got) == [(1, "a.b", 2), (1, "xn--tda.c", 1), (2, "a.b", 1)]
    got = drained(stream.first_seen(source, "url", "ts", "1 hour"), "f")
    assert sorted(r.canonical for r in got) == ["http://a.b/x", "http://a.b/y", "http://last.d/", "http://xn--tda.c/"]


def test_routes_and_columns_on_streams(spark, tmp_path):
    source = visits(spark, str(tmp_path))
    rules = [("ab", URLPattern("http://a.b/*")), ("any", URLPattern({"protocol": "http"}))]
    got = drained(stream.routed(source.select("user", "url"), "url", rules), "r")
    assert sorted(r.pattern_id for r in got) == ["ab"] * 3 + ["any"] * 5
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.txt").write_text("http://a.b/?x=1&y=2\nhttp://a.b/?x=3\nnone\n")
    lines = stream.stream_lines(spark, str(tmp_path / "lines"), max_files=1)
    rows = drained(lines.select(urls.url_part("url", "host").alias("host"), params.params_get(params.params_parse(urls.url_part("url", "search")), "x").alias("x")).where(F.col("host").isNotNull()), "l")
    assert sorted((r.host, r.x) for r in rows) == [("a.b", "1"), ("a.b", "3")]
