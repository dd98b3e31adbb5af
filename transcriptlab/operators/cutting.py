"""Recordings cut into chunks at their quietest places.

Where a chunk ends depends on where it begins, so a recording's frames are read in order, once.  Frames are dealt by
recording and sorted; a task reads them as a stream of batches and holds no more of them than the longest chunk has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percentiles

CHUNKS = "clip string, chunk int, start long, stop long"


class Cutter:
    """Cuts one recording; takes its frames' energies in order."""

    def __init__(self, total: int, median: float, rate: int, seconds: tuple[float, float, float, float], frame: int, hop: int) -> None:
        self.total, self.median, self.rate, self.frame, self.hop = total, median, rate, frame, hop
        target, least, most, around = seconds
        self.least = max(1, int(least * rate))
        self.most = max(self.least, int(most * rate))
        self.target = max(self.least, int(target * rate))
        self.around = max(0, int(around * rate))
        self.start, self.first, self.held, self.out = 0, 0, np.zeros(0), []

    def window(self) -> tuple[int, int, int]:
        """Where the next chunk would best end, and the least and greatest place it may."""
        ideal = self.start + self.target
        return ideal, max(self.start + self.least, ideal - self.around), min(self.start + self.most, ideal + self.around, self.total - self.least)

    def take(self, energies: np.ndarray, last: bool = False) -> None:
        """More frames; those before the next window go."""
        self.held = np.concatenate([self.held, energies])
        while self.total - self.start > self.most:
            ideal, lower, upper = self.window()
            if upper <= lower:
                end = min(ideal, self.total)
            else:
                if not last and (self.first + len(self.held)) * self.hop <= upper:
                    break  # frames of the window are still to come
                end = self.quietest(ideal, lower, upper)
            self.out.append((self.start, end))
            self.start = end
            gone = min(max((end + self.least) // self.hop - self.first, 0), len(self.held))
            self.first, self.held = self.first + gone, self.held[gone:]
        if last and self.start < self.total:
            self.out.append((self.start, self.total))

    def quietest(self, ideal: int, lower: int, upper: int) -> int:
        """The middle of the frame that is quietest for its distance from the ideal place, the first on ties."""
        i = max(lower // self.hop, self.first)
        own = self.held[i - self.first : upper // self.hop + 1 - self.first]
        place = (i + np.arange(len(own))) * self.hop + self.frame // 2
        inside = (place > lower) & (place < upper)
        if not inside.any():
            return ideal
        score = own[inside] / (self.median + 1e-9) + 0.10 * (np.abs(place[inside] - ideal) / self.rate)
        return int(place[inside][score.argmin()])


def quiet_chunks(frames: DataFrame, totals: DataFrame, rate: int, target: float, least: float, most: float, around: float) -> DataFrame:
    """(clip, chunk, start, stop) in samples: chunks of each clip, numbered from 0, each but the last ended at a quiet place.

    frames: clip, frame (from 0, each 20 ms long, 10 ms after the one before), energy; totals: clip, total (samples).  A chunk ends at the
    frame of least energy over the clip's median plus a tenth of its distance in seconds from ``target``, at most ``around`` away; between
    ``least`` and ``most`` seconds, and ``least`` before the end.  A clip without frames is cut at ``target``; frames with a
    null energy count as silent.
    """
    frame, hop = max(1, int(0.020 * rate)), max(1, int(0.010 * rate))
    own = frames.select("clip", "frame", F.coalesce("energy", F.lit(0.0)).cast("double").alias("energy"))
    middle = percentiles(own, "clip", "energy", 0.5, ("floor", "half_up")).select("clip", ((F.col("floor") + F.col("half_up")) / 2).alias("median"))
    known = totals.select("clip", "total").join(middle, "clip", "left").select("clip", "total", F.coalesce("median", F.lit(1.0)).alias("median"))
    # a row before the frames of each clip says how long it is
    heads = known.select("clip", F.lit(-1).cast("long").alias("frame"), F.col("median").alias("energy"), "total")
    rows = own.select("clip", F.col("frame").cast("long").alias("frame"), "energy", F.lit(None).cast("long").alias("total")).unionByName(heads.withColumn("total", F.col("total").cast("long")))
    seconds = (target, least, most, around)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, number = None, None, 0

        def done(clip: str | None, of: Cutter | None, last: bool) -> pa.RecordBatch:
            nonlocal number
            if of is not None and last:
                of.take(np.zeros(0), True)
            out = of.out if of is not None else []
            numbers = np.arange(number, number + len(out))
            number += len(out)
            if of is not None:
                of.out = []
            return pa.record_batch({"clip": pa.array([clip] * len(out), pa.string()), "chunk": pa.array(numbers, pa.int32()), "start": pa.array([s for s, _ in out], pa.int64()), "stop": pa.array([e for _, e in out], pa.int64())})

        for batch in batches:
            clips = batch["clip"].to_pylist()
            energy, total = batch["energy"].to_numpy(zero_copy_only=False), batch["total"]
            edges = [0, *[i for i in range(1, len(clips)) if clips[i] != clips[i - 1]], len(clips)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if cutter is None or clips[i] != now:
                    yield done(now, cutter, True)
                    now, cutter, number = clips[i], None, 0
                if cutter is None and total[i].is_valid:
                    cutter = Cutter(total[i].as_py(), float(energy[i]), rate, seconds, frame, hop)
                    i += 1
                if cutter is not None:  # a clip that totals doesn't have isn't cut
                    cutter.take(energy[i:j])
                    yield done(now, cutter, False)
        yield done(now, cutter, True)

    dealt = rows.repartition("clip").sortWithinPartitions("clip", "frame")
    return dealt.select(F.col("clip").cast("string").alias("clip"), "frame", "energy", "total").mapInArrow(cut, CHUNKS)
