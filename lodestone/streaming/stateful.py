"""Keyed state over streams: a state machine for tasks, and bodies put together from pieces that arrive in any order."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.answers import frames_of_lines

#: From each state to those that may follow; "" is before the first event.
NEXT = {"": {"pending"}, "pending": {"processing", "failed"}, "processing": {"completed", "failed"}, "completed": set(), "failed": set()}
_STEP = "task_id long, event_id long, ts timestamp, status string, outcome string, reason string"


def step(status: str, last: tuple[pd.Timestamp, int] | None, event: tuple[pd.Timestamp, int, str]) -> str:
    """Why an event can't be applied to a task in a state with a last event (ts, id), or "" if it can."""
    ts, event_id, new = event
    if last is not None and (ts, event_id) <= last:
        return "an earlier or repeated event"
    return "" if new in NEXT[status] else f"{status or 'none'} to {new}"


def task_machine(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes", keep: str = "7 days") -> DataFrame:
    """(task_id, event_id, ts, status, outcome, reason) of a stream of (event_id, task_id, ts, status), for the append mode.

    outcome: "applied" for a legal transition; "set aside" with a reason for any other event, which changes nothing; "expired"
    where a task that isn't finished has had no legal event for idle of event time: it has become failed, with a null
    event_id. Events of a task are taken by (ts, event_id) within a batch; one that comes after a newer one, or again, is set
    aside, so a replayed batch changes no state. Finished tasks are forgotten after keep, and by then count as new. Events
    without a task or a time are left out, as are those that come later than the watermark allows."""
    gap, rest = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, keep))
    milli = lambda ts: int(ts.timestamp() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        status, ts, event_id = state.get if state.exists else ("", None, None)
        last = (pd.Timestamp(ts), event_id) if ts is not None else None
        if state.hasTimedOut:
            if not NEXT[status]:
                state.remove()
                return
            failed = last[0] + pd.Timedelta(milliseconds=gap)
            out.append((key[0], None, failed, "failed", "expired", f"no event after {status}"))
            status, last = "failed", (failed, -1)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
            for t, i, s in zip(rows["ts"], rows["event_id"], rows["status"], strict=True):
                why = step(status, last, (t, int(i), s))
                out.append((key[0], int(i), t, s, "set aside" if why else "applied", why or None))
                if not why:
                    status, last = s, (t, int(i))
        if last is not None:
            state.update((status, last[0].to_pydatetime(), int(last[1])))
            due = milli(last[0]) + (gap if NEXT[status] else rest)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "ts", "status", "outcome", "reason"]).astype({"event_id": "Int64"})

    timed = events.filter("task_id IS NOT NULL AND ts IS NOT NULL").select(F.col("task_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    return timed.groupBy("task_id").applyInPandasWithState(run, _STEP, "status string, ts timestamp, event_id long", "append", GroupStateTimeout.EventTimeTimeout)


def arriving_lines(pieces: DataFrame, late: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """(body_id, seq, line) of a stream of pieces (body_id, piece, data binary, last boolean, ts), for the append mode: the lines of
    each body, as splitting the whole body at newlines gives them.

    Pieces are numbered from 0; the one with last ends its body. A line is given once it is complete, whatever pieces it and its
    characters are cut into; pieces that come early wait, those that come again are ignored. Pieces without a body, a number or a time are left out. A body without a piece for idle
    of event time ends with what it has up to the first missing piece. Waiting pieces are the state, and only they."""
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, number, tail, held = state.get if state.exists else (0, 0, b"", "{}")
        if due < 0:  # the body has ended: what comes again is ignored, until it is forgotten
            if state.hasTimedOut:
                state.remove()
            else:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + gap)
            return
        waiting = {int(k): (base64.b64decode(v[0]), v[1]) for k, v in json.loads(held).items()}
        parts, ended, first, newest = [bytes(tail)], state.hasTimedOut, number, 0
        if not ended:
            for rows in batches:
                for piece, data, last, ts in zip(rows["piece"], rows["data"], rows["last"], rows["ts"], strict=True):
                    newest = max(newest, int(ts.timestamp() * 1000))
                    if int(piece) >= due:
                        waiting.setdefault(int(piece), (bytes(data) if data is not None else b"", bool(last)))
            while due in waiting and not ended:
                data, ended = waiting.pop(due)
                parts.append(data)
                due += 1
        *lines, tail = b"".join(parts).split(b"\n")
        if ended:
            lines.append(tail)
        if state.hasTimedOut:
            state.remove()
        elif ended:
            state.update((-1, 0, b"", "{}"))
            state.setTimeoutTimestamp(max(newest + gap, state.getCurrentWatermarkMs() + 1))
        else:
            held = json.dumps({k: (base64.b64encode(d).decode(), e) for k, (d, e) in waiting.items()})
            state.update((due, number + len(lines), tail, held))
            state.setTimeoutTimestamp(max(newest + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"body_id": [key[0]] * len(lines), "seq": range(first, first + len(lines)), "line": [x.decode("utf-8", "replace") for x in lines]})

    timed = pieces.filter("body_id IS NOT NULL AND piece IS NOT NULL AND ts IS NOT NULL").select("body_id", F.col("piece").cast("long").alias("piece"), "data", F.coalesce("last", F.lit(False)).alias("last"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("body_id").applyInPandasWithState(run, "body_id long, seq int, line string", "due long, number long, tail binary, held string", "append", GroupStateTimeout.EventTimeTimeout)


def arriving_frames(pieces: DataFrame, late: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """(body_id, seq, kind, payload) of a stream of pieces: what answers.parsed_frames gives for the whole bodies."""
    return frames_of_lines(arriving_lines(pieces, late, idle))
