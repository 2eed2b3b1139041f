"""Streams with event time: late exits, timeouts, decisions in any order or never, windows and late rows."""

import random

import pytest
from pyspark.sql import functions as F

from webtext.operators import agent as A
from webtext.streaming.answers import decided_requests, split_decided
from webtext.streaming.sessions import BLOCK, CHANGES, kept_lines, rocksdb_state, session_changes
from webtext.streaming.streams import file_stream, late_rows, state_rows, write_epochs

LINES = "conv_id long, turn long, text string, at string"


def feed(spark, path, rows, schema):
    """One more file of a stream's folder; strings named *at are times."""
    df = spark.createDataFrame(rows, schema)
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in df.columns if c.endswith("at")})
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def sessions(spark, tmp, batches, **options):
    """Runs the stream once for every batch; (changes, state rows after every run, rows dropped as late)."""
    path, out, states, late = f"{tmp}/in", f"{tmp}/out", [], 0
    for rows in batches:
        schema = feed(spark, path, rows, LINES)
        with rocksdb_state(spark):
            q = write_epochs(session_changes(file_stream(spark, path, schema), "at", **options), lambda b, e: b, out, f"{tmp}/ckpt", "update")
            q.awaitTermination()
        states.append(state_rows(q)[-1])
        late += late_rows(q)
    return spark.read.schema(CHANGES + ", epoch_id long").parquet(out), states, late


def rows(df):
    return sorted((r.conv_id, r.turn, r.text) for r in df.collect())


def test_late_exits_retract_lines(spark, tmp_path):
    t = "2024-01-01 00:00:{:02d}"
    one = [(1, i, f"l{i}", t.format(i)) for i in range(6)] + [(2, 2**53 + i, f"m{i}", t.format(i)) for i in range(3)] + [(3, 0, " \t", t.format(0))]
    two = [(1, 4, " Exit ", t.format(20)), (1, 7, "after", t.format(21)), (2, 2**53 + 1, "QUIT", t.format(22)), (1, 3, "l3", t.format(23))]
    three = [(1, 1, "quit", t.format(30)), (1, 0, "zero again", t.format(31)), (2, 5, "early", t.format(32)), (4, 1, "d", t.format(33))]
    changes, _, late = sessions(spark, tmp_path, [one, two, three])
    batch = A.session_turns(spark.createDataFrame(one + two + three, LINES).select("conv_id", "turn", "text"))
    assert late == 0 and rows(kept_lines(changes)) == rows(batch)
    assert {(r.conv_id, r.turn) for r in changes.where("change = 'retracted'").collect()} == {(1, 4), (1, 5), (2, 2**53 + 1), (2, 2**53 + 2), (1, 1), (1, 2), (1, 3)}


def test_late_exit_over_many_blocks(spark, tmp_path):
    n = 3 * BLOCK
    one = [(1, i, "x", "2024-01-01 00:00:00") for i in range(n)]
    changes, _, _ = sessions(spark, tmp_path, [one, [(1, 5, "exit", "2024-01-01 00:00:01")]])
    assert rows(kept_lines(changes)) == [(1, i, "x") for i in range(5)]


def test_state_is_removed_when_a_session_times_out(spark, tmp_path):
    one = [(c, i, "x", "2024-01-01 00:00:00") for c in range(4) for i in range(3)] + [(0, 9, "exit", "2024-01-01 00:00:00")]
    later = [(7, 0, "y", "2024-01-09 00:00:00")]  # moves the watermark past all of them
    again = [(0, 12, "a new session", "2024-01-09 00:00:01"), (1, 0, "too late", "2024-01-01 00:00:00")]
    changes, states, late = sessions(spark, tmp_path, [one, later, again], delay="1 day", gap_seconds=3600)
    assert states[0] > 6 and states[1] <= 4  # conversation 7 alone is left
    assert late == 1 and (0, 12, "a new session") in rows(kept_lines(changes)) and (1, 0, "too late") not in rows(kept_lines(changes))


DECISIONS = "request_id string, n_choices int, content string, model string, prompt_tokens long, completion_tokens long, total_tokens long, error string, decided_at string"


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_in_any_order_or_never(spark, tmp_path, seed):
    rng = random.Random(seed)
    req = [(f"{i}:0", f"say {i}", f"2024-01-01 00:{i:02d}:00") for i in range(12)]
    dec = [(f"{i}:0", 1, f"d{i}", None, 0, 0, 0, None, f"2024-01-01 00:{i + 10:02d}:00") for i in range(12) if i % 4] + [("lost:0", 1, "x", None, 0, 0, 0, None, "2024-01-01 00:30:00")]
    rng.shuffle(req)
    rng.shuffle(dec)
    end = "2024-02-01 00:00:00"
    out, states = [], []
    for k in range(4):
        r_schema = feed(spark, f"{tmp_path}/r", req[k * 4:k * 4 + 4] if k < 3 else [("beat", "", end)], "request_id string, user_text string, asked_at string")
        d_schema = feed(spark, f"{tmp_path}/d", dec[k * 4:k * 4 + 4] if k < 3 else [("beat", 0, None, None, 0, 0, 0, None, end)], DECISIONS)
        joined = decided_requests(file_stream(spark, f"{tmp_path}/r", r_schema), file_stream(spark, f"{tmp_path}/d", d_schema), "1 day", "1 hour")
        q = write_epochs(joined, lambda b, e: b, f"{tmp_path}/out", f"{tmp_path}/ckpt")
        q.awaitTermination()
        states.append(state_rows(q)[-1])
    got = spark.read.parquet(f"{tmp_path}/out").where("request_id <> 'beat'")
    assert {r.request_id: r.decision and r.decision.content for r in got.collect()} == {f"{i}:0": f"d{i}" if i % 4 else None for i in range(12)}
    assert got.count() == 12 and states[-2] > 12 and states[-1] <= 2  # nothing but the beats is left
    own, came = split_decided(got)
    assert own.count() == 12 and came.count() == 9 and came.columns[:3] == ["request_id", "n_choices", "content"]
