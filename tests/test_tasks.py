"""The life of tasks: a table replayed against a plain model, and a stream under processing time."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import tasks

SCHEMA = "desk string, task_id string, kind string, message string, at timestamp, seq long, stage string, tasks int"
T0 = datetime(2024, 5, 1)


def plain(rows, rules):
    """The tasks each desk holds at last: (desk, task): (status, message, created)."""
    held: dict = {}
    out = []
    for desk, task, kind, message, at, seq, *_ in sorted((r for r in rows if None not in (r[0], r[1], r[2], r[4])), key=lambda r: (r[4], r[5])):
        own = held.setdefault(desk, {})
        for t in [t for t, v in own.items() if (at - v[2]).total_seconds() > rules.ttl]:
            out.append((desk, t, "expired"))
            del own[t]
        if kind == "submit":
            if rules.refuse and task not in own and len(own) >= rules.most:
                out.append((desk, task, "rejected"))
                continue
            own[task] = ("queued", message, at)
        elif kind in tasks.STATES and task in own:
            own[task] = (kind, message, own[task][2])
        else:
            continue
        out.append((desk, task, own[task][0]))
        while len(own) > rules.most:
            t = min(own, key=lambda t: (own[t][2], t))
            out.append((desk, t, "evicted"))
            del own[t]
    return {(d, t): v for d, own in held.items() for t, v in own.items()}, sorted(out)


def made(n=1500):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        kind = rnd.choice(["submit", "submit", "running", "done", "error", "unheard of"])
        rows.append((rnd.choice("abc"), f"t{rnd.randrange(90)}", kind, rnd.choice([None, "said"]), T0 + timedelta(seconds=i * 100 - i % 3 * 150), i, "x", 1))
    return rows + [(None, "t", "submit", "", T0, 1, "", 1), ("a", None, "submit", "", T0, 1, "", 1), ("a", "t", None, "", T0, 1, "", 1), ("a", "t", "submit", "", None, 1, "", 1)]


@pytest.mark.parametrize("rules", [tasks.Desk(), tasks.Desk(most=5), tasks.Desk(most=5, refuse=True), tasks.Desk(ttl=500)])
def test_replay(spark, rules):
    rows = made()
    got = tasks.changes(spark.createDataFrame(rows, SCHEMA).repartition(3), rules).persist()
    held, log = plain(rows, rules)
    assert sorted((r["desk"], r["task_id"], r["status"]) for r in got.collect()) == log
    assert {(r["desk"], r["task_id"]): (r["status"], r["message"], r["created"]) for r in tasks.current(got).collect()} == held
    assert all(sum(d == desk for d, _ in held) <= rules.most for desk in "abc")
    done = {r["status"]: (r["stage"], r["pct"]) for r in got.collect()}
    assert done["queued"] == ("排队中", 0) and done.get("done", ("完成", 100)) == ("完成", 100)
    got.unpersist()


def test_no_events(spark):
    none = tasks.changes(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and tasks.current(none).count() == 0


def test_stream_expires_by_processing_time(spark, tmp_path):
    """Tasks run, the oldest makes room, and a timer drops what is left though nothing more arrives."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    put = lambda name, *rows: (inbox / name).write_text("".join(json.dumps(dict(zip(("desk", "task_id", "kind", "message", "at", "seq"), r, strict=True))) + "\n" for r in rows))
    put("1.json", *(("d", f"t{i}", "submit", "", "2020-01-01T00:00:00Z", i) for i in range(4)), ("d", "t3", "running", "", "2020-01-01T00:00:00Z", 9))
    stream = spark.readStream.schema("desk string, task_id string, kind string, message string, at timestamp, seq long").json(str(inbox))
    query = tasks.changes(stream, tasks.Desk(ttl=25, most=3)).writeStream.format("memory").queryName("task_changes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        seen = lambda: [(r["task_id"], r["status"]) for r in spark.table("task_changes").orderBy("at").collect()]
        for wanted in (("t3", "running"), ("t3", "expired")):
            until = time.time() + 150
            while wanted not in seen() and time.time() < until:
                time.sleep(0.5)
            if wanted == ("t3", "running"):
                put("2.json", ("d", "t2", "done", "all well", "2020-01-01T00:00:00Z", 10), ("d", "t0", "done", "too late", "2020-01-01T00:00:00Z", 11))
        log = seen()
    finally:
        query.stop()
    assert ("t0", "evicted") in log and ("t0", "done") not in log  # four tasks, room for three
    assert ("t2", "done") in log and {t for t, s in log if s == "expired"} == {"t1", "t2", "t3"}
    at = {(r["task_id"], r["status"]): r for r in spark.table("task_changes").collect()}
    waited = at["t3", "expired"]["at"] - at["t3", "queued"]["at"]
    assert waited > timedelta(seconds=25)
    assert tasks.current(spark.table("task_changes")).count() == 0
    assert spark.table("task_changes").where(F.col("status") == "done").first()["message"] == "all well"


def test_a_tables_rows_are_not_held():
    """Rows of a table are taken one by one: the first change comes before the second row has been asked for."""
    from datetime import datetime, timedelta
    from types import SimpleNamespace

    from pyspark.sql import Row

    state: dict = {}
    life = tasks.Lifecycle(tasks.Desk(), False)
    life.tasks = SimpleNamespace(iterator=lambda: iter([]), updateValue=lambda k, v: state.__setitem__(k[0], v), removeKey=lambda k: state.pop(k[0], None))
    taken = []

    def rows(order):
        for i in order:
            taken.append(i)
            yield Row(task_id=str(i % 30), kind="submit", message=None, at=datetime(2024, 1, 1) + timedelta(seconds=i), seq=i)

    made = life.handleInputRows(("d",), rows(range(1000)), None)
    assert next(made)["task_id"] == "0" and taken == [0]
    list(made)
    assert len(taken) == 1000 and len(state) == tasks.MOST
    try:
        list(life.handleInputRows(("d",), rows([2, 1]), None))
    except ValueError:
        return
    raise AssertionError("rows out of order were taken")
