import json

from transcriptlab.streaming import jobs
from transcriptlab.streaming.drafts import stabilise


def test_drafts(spark, tmp_path):
    batches = [
        [("a", 2, "We will meet at"), ("a", 1, "we will"), ("b", 1, None), (None, 1, "x")],
        [("a", 3, "we will meet at noon"), ("a", 2, "replayed"), ("b", 2, "one two three")],
        [("a", 4, "we will meet later"), ("b", 3, "one two three four")],
    ]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        lines = [json.dumps({"session": s, "seq": k, "text": t, "event_time": f"2024-01-01T00:00:{n:02}Z"}) for s, k, t in rows]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema("session string, seq int, text string, event_time timestamp").json(str(tmp_path / "in"))
        stabilise(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        ("a", 1, 0, False, ""), ("a", 2, 2, False, ""), ("a", 3, 4, True, "we will meet at"), ("a", 4, 3, True, "we will meet at"),
        ("b", 1, 0, False, ""), ("b", 2, 0, False, ""), ("b", 3, 3, True, "one two three"),
    }


def test_rolling_and_unique_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("r1", 0, "00:10"), ("r1", 0, "00:11"), ("r1", 1, "00:12"), ("r2", 0, "59:00")]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"run_id": r, "index": i, "event_time": f"2024-01-01T00:{t}Z"}) for r, i, t in rows))
    stream = spark.readStream.schema("run_id string, index int, event_time timestamp").json(str(tmp_path / "in"))
    jobs.unique_chunks(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start(str(tmp_path / "o1")).awaitTermination(120)
    assert sorted((r["run_id"], r["index"]) for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [("r1", 0), ("r1", 1), ("r2", 0)]
    (tmp_path / "log").mkdir()
    log = [{"run_id": str(n), "created_at": f"2024-01-01T{h:02}:00:00Z", "status": s} for n, (h, s) in enumerate([(0, "failed"), (0, "paste_attempted"), (1, "failed"), (5, "failed")])]
    (tmp_path / "log" / "0.json").write_text("\n".join(map(json.dumps, log)))
    jobs.rolling(jobs.attempt_stream(spark, str(tmp_path / "log"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start(str(tmp_path / "o2")).awaitTermination(120)
    got = sorted((r["start"].hour, r["n"], r["successes"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect())
    assert got[:2] == [(0, 2, 1), (1, 1, 0)]
