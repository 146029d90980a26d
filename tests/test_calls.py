"""Calls of a model: a window of open ones, a shared pace, order, and usage counted while they run."""

import threading
import time

from pyspark.sql import functions as F

from tesserae.operators import grading
from tesserae.sources import model


def test_window_and_order():
    open_now, most, made = [0], [0], []
    lock = threading.Lock()

    def client():
        made.append(threading.get_ident())

        def answer(prompt):
            with lock:
                open_now[0] += 1
                most[0] = max(most[0], open_now[0])
            time.sleep(0.02 if int(prompt) % 3 else 0.06)
            with lock:
                open_now[0] -= 1
            if prompt == "7":
                raise RuntimeError("x" * 400)
            return prompt + "!"

        return answer

    got = list(model.answers([*map(str, range(20)), None], client, open_calls=4))
    assert [a.reply for a in got] == [None if i == 7 else f"{i}!" for i in range(20)] + [None]
    assert got[7].error == "x" * 300 and got[20] == model.Answer() and sum(a.error is not None for a in got) == 1
    assert 1 < most[0] <= 4 and len(made) <= 4 and open_now[0] == 0
    assert [a.reply for a in model.answers(["1"], client)] == ["1!"] and list(model.answers([], client, open_calls=3)) == []


def test_pace_is_shared():
    now, slept = [100.0], []
    pace = model.Pace(2.0, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        pace.wait()
    now[0] = 200.0
    pace.wait()
    assert slept == [2.0, 4.0]
    starts = []
    list(model.answers(["a"] * 5, lambda: lambda p: starts.append(time.monotonic()), open_calls=5, pace=model.Pace(0.05)))
    assert len(starts) == 5 and max(starts) - min(starts) >= 0.18


def test_usage_while_running(spark):
    def make():
        class Own:
            usage = None

            def __call__(self, prompt):
                self.usage = {"prompt_tokens": len(prompt), "completion_tokens": 1, "requests": 1}
                if prompt == "bad":
                    raise ValueError("no")
                return prompt

        return Own()

    rows = spark.createDataFrame([(i, "bad" if i == 3 else None if i == 5 else "p" * i) for i in range(40)], "i int, p string").repartition(3)
    calls, seen = grading.observed(grading.asked(rows, F.col("p"), make, open_calls=3))
    stored = calls.collect()
    expected = {"prompt_tokens": sum(range(40)) - 3 - 5 + 3, "completion_tokens": 39, "requests": 39, "calls": 40, "failed": 1}
    assert seen.get == expected
    assert sorted((r["i"], r["reply"]) for r in stored) == [(i, None if i in (3, 5) else "p" * i) for i in range(40)]
    again = spark.createDataFrame([r.asDict(recursive=True) for r in stored], calls.schema)
    used = grading.token_usage(again).first()
    assert (used["prompt_tokens"], used["requests"]) == (expected["prompt_tokens"], 39)
