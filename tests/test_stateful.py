"""Stateful streams against plain versions, over restarts."""

import datetime
import random

import pytest

from lodestone.operators import answers
from lodestone.streaming import stateful as S

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, task_id long, ts timestamp, status string"


def streamed(spark, tmp_path, schema, batches, build, name):
    """Rows that a stream gives of batches, with a restart from its checkpoint after each."""
    source, sink = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        frame = build(spark.readStream.schema(schema).parquet(str(source)))
        frame.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(str(sink)).collect()


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_tasks_follow_legal_transitions(spark, tmp_path):
    one = [(1, 1, at(0), "pending"), (2, 1, at(1), "processing"), (3, 2, at(1), "processing"), (4, 3, at(2), "pending"), (5, 4, at(2), "pending"), (6, 4, at(2), "completed")]
    two = [(7, 1, at(3), "completed"), (8, 1, at(4), "failed"), (5, 4, at(2), "pending"), (9, 4, at(3), "processing"), (10, 9, at(200), "pending"), (None, None, at(1), "pending")]
    three = [(11, 9, at(201), "failed"), (12, 3, at(201), "processing")]
    got = streamed(spark, tmp_path, EVENTS, [one, two, three], lambda s: S.task_machine(s, late="1 minute"), "tasks")
    found = sorted((r.task_id, r.event_id or 0, r.status, r.outcome) for r in got)
    assert found == sorted([
        (1, 1, "pending", "applied"), (1, 2, "processing", "applied"), (1, 7, "completed", "applied"), (1, 8, "failed", "set aside"), (4, 5, "pending", "set aside"),
        (2, 3, "processing", "set aside"), (3, 4, "pending", "applied"), (4, 5, "pending", "applied"), (4, 6, "completed", "set aside"), (4, 9, "processing", "applied"),
        (9, 10, "pending", "applied"), (9, 11, "failed", "applied"), (3, 0, "failed", "expired"), (4, 0, "failed", "expired"), (3, 12, "processing", "set aside"),
    ])
    expired = {r.task_id: r.ts for r in got if r.outcome == "expired"}
    assert expired == {3: at(62), 4: at(63)}


def plain(events):
    """The last state of each task, its events taken in order."""
    state, last = {}, {}
    for event_id, task, ts, status in sorted(events, key=lambda e: (e[2], e[0])):
        if not S.step(state.get(task, ""), last.get(task), (ts, event_id, status)):
            state[task], last[task] = status, (ts, event_id)
    return state


def test_restarts_give_the_same_states(spark, tmp_path):
    rng = random.Random(4)
    events = [(i, rng.randrange(12), at(i / 10), rng.choice(["pending", "processing", "completed", "failed"])) for i in range(200)]
    for name, cuts in (("once", [200]), ("often", [40, 90, 91, 200])):
        parts = [events[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        got = [r for r in streamed(spark, tmp_path, EVENTS, parts, S.task_machine, name) if r.outcome == "applied"]
        latest = {}
        for r in sorted(got, key=lambda r: (r.ts, r.event_id)):
            latest[r.task_id] = r.status
        assert latest == plain(events)


BODY = '0:"a b"\n0:"é🦆\\n"\n\nnoise\n3:"oops é"\n0:7\nd:{"finishReason":"stop"}\n0:"open'
PIECES = "body_id long, piece long, data binary, last boolean, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_of_a_body_gives_the_batch_result(spark, tmp_path, seed):
    rng, raw = random.Random(seed), BODY.encode()
    pieces = []
    for body in range(8):
        cuts = sorted(rng.sample(range(1, len(raw)), rng.randint(0, 12)))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)] + ([b""] if body % 2 else [])
        pieces += [(body, i, bytearray(p), i == len(parts) - 1, at(rng.random())) for i, p in enumerate(parts)]
    rng.shuffle(pieces)
    pieces += pieces[:9]  # some arrive again
    third = len(pieces) // 3
    got = streamed(spark, tmp_path, PIECES, [pieces[:third], pieces[third : 2 * third], pieces[2 * third :]], S.arriving_frames, "pieces")
    want = answers.parsed_frames(spark.createDataFrame([(b, BODY) for b in range(8)], "body_id long, body string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_body_that_stops_ends_after_a_while(spark, tmp_path):
    first = [(1, 0, bytearray(b'0:"a"\n0:"b"'), False, at(0)), (1, 2, bytearray(b'\n0:"lost"\n'), True, at(0)), (2, 0, None, None, at(0))]
    later = [(3, 0, bytearray(b"d:{}"), True, at(90))]
    got = streamed(spark, tmp_path, PIECES, [first, later, [(4, 0, bytearray(b"d:1"), True, at(91))]], S.arriving_frames, "stops")
    assert sorted((r.body_id, r.seq, r.kind, r.payload) for r in got) == [(1, 0, "0", "a"), (1, 1, "0", "b"), (3, 0, "d", "{}"), (4, 0, "d", "1")]
