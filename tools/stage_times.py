"""Dev tool: per-stage wall time, task time and shuffle volume from a Spark event log folder.

Usage: python tools/stage_times.py <eventLog.dir>
"""

from __future__ import annotations

import glob
import io
import json
import sys

import zstandard


def lines(path: str):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    return raw.decode("utf-8", "replace").splitlines()


def main(folder: str) -> None:
    stages, tasks = {}, {}
    for f in sorted(glob.glob(folder + "/*/events_*")) + sorted(glob.glob(folder + "/app*")):
        for line in lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e["Event"] == "SparkListenerStageCompleted":
                i = e["Stage Info"]
                wall = (i.get("Completion Time", 0) - i.get("Submission Time", 0)) / 1000
                stages[i["Stage ID"]] = (round(wall, 2), i["Number of Tasks"], i["Stage Name"][:40])
            elif e["Event"] == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                sw, sr = m.get("Shuffle Write Metrics", {}), m.get("Shuffle Read Metrics", {})
                tasks.setdefault(e["Stage ID"], []).append(
                    (m.get("Executor Run Time", 0), sw.get("Shuffle Records Written", 0), sr.get("Total Records Read", 0))
                )
    for sid in sorted(stages):
        ts = tasks.get(sid, [])
        run = [t[0] for t in ts]
        print(sid, stages[sid], "task_ms max", max(run or [0]), "sum", sum(run),
              "shuffle_w", sum(t[1] for t in ts), "shuffle_r", sum(t[2] for t in ts))


if __name__ == "__main__":
    main(sys.argv[1])
