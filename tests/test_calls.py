"""Calls to a model: once for each distinct prompt, several at a time, given up after a deadline."""

import threading
import time
import uuid

from trivet.operators import triage
from trivet.operators.triage import called


def test_calls_overlap_and_never_exceed_the_limit():
    live, most, lock = 0, 0, threading.Lock()

    def fn(x):
        nonlocal live, most
        with lock:
            live += 1
            most = max(most, live)
        time.sleep(0.02)
        with lock:
            live -= 1
        if x == 13:
            raise ValueError
        return x * x

    begun = time.perf_counter()
    got = {i: (a, ms) for i, a, ms in called(fn, range(60), at_once=12)}
    assert time.perf_counter() - begun < 0.7 and 6 <= most <= 12
    assert {i: a for i, (a, _) in got.items()} == {i: None if i == 13 else i * i for i in range(60)} and all(ms >= 19 for _, ms in got.values())
    assert list(called(fn, [], 4)) == []


def test_a_call_that_hangs_is_given_up():
    begun = time.perf_counter()
    got = {i: a for i, a, _ in called(lambda x: time.sleep(30 if x < 3 else 0.01) or "ok", range(20), at_once=2, deadline=0.3)}
    assert time.perf_counter() - begun < 5 and got == {i: None if i < 3 else "ok" for i in range(20)}


def rows_of(spark, n):
    return spark.createDataFrame([(i, "f", "s", "P", f"v{i % 4}", "c") for i in range(n)] + [(n, "f", "s", "P", None, None)], "id long, file_path string, source string, pattern_name string, matched_value string, context string")


def test_each_distinct_prompt_is_asked_once(spark):
    model = triage.callable_provider(lambda *_: f'{{"status": "REVIEW", "confidence": 0.9, "reasoning": "{uuid.uuid4()}"}}')
    got = triage.ask(rows_of(spark, 40), model).collect()
    answers = {}
    for r in got:
        answers.setdefault(r.matched_value, set()).add(r.decision.reasoning)
    assert len(got) == 41 and len(answers) == 5 and all(len(a) == 1 for a in answers.values()) and all(r.latency_ms >= 0 for r in got)


def test_samples_of_a_prompt_are_calls_of_their_own(spark):
    model = triage.callable_provider(lambda *_: f'{{"status": "REVIEW", "confidence": 0.5, "reasoning": "{uuid.uuid4()}"}}')
    got = triage.self_consistency(rows_of(spark, 8), "id", model).collect()
    assert len(got) == 9 and all(r.escalated and len(r.sample_statuses) == 5 for r in got)


def test_failures_are_reviews(spark):
    def fn(prompt, *_):
        if "v1" in prompt:
            raise OSError
        return "no object" if "v2" in prompt else '{"status": "REAL", "is_credentials": 1}'

    got = {r.matched_value: r.decision for r in triage.ask(rows_of(spark, 4), triage.callable_provider(fn)).collect()}
    assert {v: d.status for v, d in got.items()} == {"v0": "REAL", "v1": "REVIEW", "v2": "REVIEW", "v3": "REAL", None: "REAL"}
    assert not got["v1"].json_valid and not got["v2"].json_valid
