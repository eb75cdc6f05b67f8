"""Event-time windows, deduplication and state on real streams."""

import json
import time

import pytest

from quillstone.streaming import ingest

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream that reads one file a batch, in the order in which they are given."""

    def make(*batches):
        folder = tmp_path / "in"
        folder.mkdir()
        for n, rows in enumerate(batches):
            lines = [json.dumps(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), r))) for r in rows]
            (folder / f"{n:03d}.json").write_text("\n".join(lines))
            time.sleep(0.02)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))

    return make


def drain(spark, df, mode, tmp_path, name):
    """Rows of each batch."""
    out = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def at(hour, minute=0):
    return f"2024-01-01T{hour:02d}:{minute:02d}:00Z"


def test_tumbling_windows_close_behind_the_watermark(spark, stream, tmp_path):
    events = stream(
        [(1, at(1), 1, "a", 1.0), (2, at(1, 30), 1, "a", 2.0)],
        [(3, at(5), 1, "a", 4.0)],
        [(5, at(5, 10), 2, "b", 1.0)],
        # the window of one o'clock is closed by now
        [(4, at(1, 10), 1, "a", 100.0)],
        [(6, at(9), 1, "a", 8.0)],
    )
    rows = [r for batch in drain(spark, ingest.tumbling(events, "1 hour", "30 minutes"), "append", tmp_path, "ck") for r in batch]
    got = sorted((r[0].hour, *r[1:]) for r in rows)
    assert got == [(1, "a", 2, 3.0), (5, "a", 1, 4.0), (5, "b", 1, 1.0)]


def test_sliding_windows_and_sessions(spark, stream, tmp_path):
    events = stream([(1, at(1), 1, "a", 1.0), (2, at(1, 20), 1, "a", 1.0), (3, at(3), 1, "a", 1.0)], [(4, at(20), 9, "z", 0.0)])
    rows = [r for b in drain(spark, ingest.sessions(events, "1 hour", "10 minutes"), "append", tmp_path, "s") for r in b]
    assert sorted((u, a.hour, b.hour, b.minute, n) for u, a, b, n in rows) == [(1, 1, 2, 20, 2), (1, 3, 4, 0, 1)]
    rows = [r for b in drain(spark, ingest.sliding(events, "2 hours", "1 hour", "10 minutes"), "append", tmp_path, "w") for r in b]
    assert {a.hour: n for a, n in rows} == {0: 2, 1: 2, 2: 1, 3: 1}


def test_repeated_events_count_once_within_the_watermark(spark, stream, tmp_path):
    events = stream([(1, at(1), 1, "a", 1.0), (1, at(1, 1), 1, "a", 1.0)], [(1, at(1, 5), 1, "a", 1.0), (2, at(1, 6), 1, "a", 1.0)])
    rows = [r for b in drain(spark, ingest.deduplicated(events, "1 hour"), "append", tmp_path, "d") for r in b]
    assert sorted(r[0] for r in rows) == [1, 2]


def test_latest_row_of_each_key(spark, stream, tmp_path):
    events = stream(
        [(1, at(1), 7, "a", 1.0), (4, at(2), 7, "b", 2.0), (2, at(1), 8, "c", 3.0)],
        [(3, at(1), 7, "late", 0.0), (6, at(3), 8, "d", 4.0)],
        [(5, at(4), 7, "e", 5.0)],
    ).drop("ts")
    batches = [sorted((r[1], r[0], r[2]) for r in b) for b in drain(spark, ingest.latest(events, "user_id", "event_id"), "update", tmp_path, "l")]
    assert [b for b in batches if b] == [[(7, 4, "b"), (8, 2, "c")], [(8, 6, "d")], [(7, 5, "e")]]
