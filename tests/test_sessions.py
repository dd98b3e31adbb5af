import json

from transcriptlab.streaming.sessions import finish_sessions

SCHEMA = "session string, kind string, index int, text string, reason string, event_time timestamp"


def run(spark, tmp_path, *batches):
    for n, rows in enumerate(batches):
        names = ("session", "kind", "index", "text", "reason")
        lines = [json.dumps(dict(zip(names, r[:5])) | {"event_time": f"2024-01-01T00:{r[5] // 60:02}:{r[5] % 60:02}Z"}) for r in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        finish_sessions(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_sessions(spark, tmp_path):
    first = [
        ("clean", "start", None, None, None, 0), ("clean", "chunk", 0, None, None, 1), ("clean", "finish", None, None, None, 3), ("clean", "done", 0, "hello", None, 2),
        ("risky", "chunk", 1, None, None, 1), ("risky", "chunk", 0, None, None, 1), ("risky", "done", 1, "world", "language", 2), ("risky", "finish", None, None, None, 3),
        ("slow", "chunk", 0, None, None, 1), ("slow", "chunk", 1, None, None, 1), ("slow", "done", 0, "part", "repeat", 2), ("slow", "finish", None, None, None, 3),
        ("again", "done", 0, "old", "language", 1), ("again", "start", None, None, None, 2), ("again", "done", 0, "new", None, 3), ("again", "finish", None, None, None, 4),
        ("gone", "done", 0, "never", None, 1), ("gone", "cancel", None, None, None, 2), ("gone", "odd", None, None, None, 3), (None, "finish", None, None, None, 3),
    ]
    second = [("risky", "done", 0, "hello", None, 5), ("other", "chunk", 0, None, None, 120)]
    got = run(spark, tmp_path, first, second, [("other", "chunk", 1, None, None, 121)])
    assert got == {("clean", "clean", "", 1, "hello"), ("risky", "complete", "language", 2, "hello world"), ("slow", "late", "repeat", 1, "part"), ("again", "clean", "", 1, "new")}
