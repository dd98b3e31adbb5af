import json
import time

import numpy as np

from transcriptlab.streaming import holding


def write(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{n}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{n}").rename(folder / f"{n}.json")


def test_chunks_go_once_and_in_time(spark, tmp_path):
    """A running query: late, repeated and negative chunks; the newest goes only after it has been still."""
    source = tmp_path / "in"
    write(source, 0, [{"run_id": "a", "index": i} for i in (0, 1, 3, 3)] + [{"run_id": "b", "index": 5}, {"run_id": None, "index": 1}, {"run_id": "c", "index": -1}, {"run_id": "c"}])
    stream = spark.readStream.schema("run_id string, index int").json(str(source))
    query = holding.hold_newest(stream, hold_ms=4_000).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        got = lambda: [tuple(r) for r in spark.table("held").collect()]

        def wait(n, most=90):
            ends = time.time() + most
            while len(got()) < n and time.time() < ends:
                time.sleep(0.1)
            return got()

        assert sorted(wait(2)) == [("a", 0, "followed", True), ("a", 1, "followed", True)]
        write(source, 1, [{"run_id": "a", "index": i} for i in (2, 1, 4)])  # one late, one repeated, one newer
        first = wait(6)
        assert {r[:3] for r in first} == {("a", i, "followed") for i in range(4)} | {("a", 4, "still"), ("b", 5, "still")} and len(first) == 6
        write(source, 2, [{"run_id": "a", "index": 4}, {"run_id": "b", "index": 2}, {"run_id": "b", "index": 5}])
        last = wait(7)
        time.sleep(1)
        assert got() == last and last[-1] == ("b", 2, "followed", False)
    finally:
        query.stop()


def test_chunks_in_any_order_go_once():
    rng = np.random.default_rng(1)
    for _ in range(200):
        known, out, seen = holding.fresh(), [], set()
        for _ in range(8):
            indices = [int(i) for i in rng.integers(0, 12, rng.integers(1, 4))]
            seen |= set(indices)
            gone = holding.arrived(known, indices)
            out += [i for i, _ in gone]
            assert set(out) >= {i for i in seen if i < max(seen)} and (known["held"] or max(seen) in out)
            if known["held"] and rng.random() < 0.3:
                holding.put_out(known, known["newest"])
                out.append(known["newest"])
                known["held"] = False
        assert len(out) == len(set(out))


def test_repeats_within_a_cool_down(spark, tmp_path):
    rng = np.random.default_rng(2)
    batches = [[(str(rng.choice(["a", "b", "c"])), int(60 * n + rng.integers(-20, 80))) for _ in range(25)] for n in range(4)]
    stamp = lambda s: f"2024-01-01T{1 + s // 3600:02}:{s % 3600 // 60:02}:{s % 60:02}Z"
    want, last = [], {}
    for n, rows in enumerate(batches):
        write(tmp_path / "in", n, [{"key": k, "at": stamp(s + 600)} for k, s in rows] + [{"key": None, "at": stamp(0)}, {"key": "a"}])
        stream = spark.readStream.schema("key string, at timestamp").json(str(tmp_path / "in"))
        holding.cool_down(stream, 12.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
        for k in "abc":
            for s in sorted(s for q, s in rows if q == k):
                if k not in last or s - last[k] >= 12:
                    last[k] = s
                    want.append((k, stamp(s + 600)))
    got = sorted((r.key, r.at.strftime("%Y-%m-%dT%H:%M:%SZ")) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(want) and 10 < len(got) < 90
