"""Resumable completion: what the log holds is never asked again."""

import os
import subprocess
import sys
from collections import Counter

import pytest

from sigeval.operators.complete import ExampleClient
from sigeval.operators.reply_log import complete_logged, log_rows, logged_replies

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "id string, messages array<struct<role:string,content:string>>"


def prompts(spark, ids):
    return spark.createDataFrame([(i, [("user", f"say {i}")]) for i in ids], SCHEMA)


def counting(calls, refuse=()):
    """A client that notes each call in the folder ``calls``."""
    class Client:
        def predict(self, messages, max_tokens=500):
            word = messages[-1]["content"].split()[-1]
            with open(os.path.join(calls, f"{word}-{os.urandom(6).hex()}"), "w"):
                pass
            if word in refuse:
                raise TimeoutError(word)
            return f"reply {word}"
    return Client


def called(calls):
    return Counter(name.split("-")[0] for name in os.listdir(calls))


def test_logged_prompts_are_not_asked_again(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    os.mkdir(calls)
    assert log_rows(spark, log).count() == 0
    complete_logged(prompts(spark, "abc"), counting(calls), log, "r1", rows_per_task=1)
    got = complete_logged(prompts(spark, "abcde"), counting(calls), log, "r1", rows_per_task=2)
    assert {r.id: r.raw_response for r in got.collect()} == {c: f"reply {c}" for c in "abcde"}
    assert called(calls) == Counter("abcde")
    # another run pays for its own replies, and sees only them
    other = complete_logged(prompts(spark, "ab"), counting(calls), log, "r2")
    assert {(r.run, r.id) for r in other.collect()} == {("r2", "a"), ("r2", "b")}
    assert called(calls) == Counter("abcdeab")


def test_failed_calls_are_asked_again_and_replies_win(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    os.mkdir(calls)
    with pytest.raises(RuntimeError, match="TimeoutError"):
        complete_logged(prompts(spark, "abcd"), counting(calls, refuse="bd"), log, "r", fail_fast=True)
    half = {r.id: (r.raw_response, r.error) for r in logged_replies(spark, log, "r").collect()}
    assert half["a"] == ("reply a", None) and half["b"][0] is None and "TimeoutError" in half["b"][1]
    got = complete_logged(prompts(spark, "abcd"), counting(calls), log, "r")
    assert {r.id: (r.raw_response, r.error) for r in got.collect()} == {c: (f"reply {c}", None) for c in "abcd"}
    assert called(calls) == Counter("aabbccdd".replace("aa", "a").replace("cc", "c"))


def test_no_prompts(spark, tmp_path):
    assert complete_logged(prompts(spark, ""), counting(str(tmp_path)), str(tmp_path / "log"), "r").count() == 0


JOB = """
import os, signal, sys, time
from sigeval.session import local_session
from sigeval.operators.reply_log import complete_logged
from test_reply_log import prompts, counting
calls, log, kill_at, driver = sys.argv[1], sys.argv[2], int(sys.argv[3]), os.getpid()
def factory():
    if kill_at and len(os.listdir(calls)) >= kill_at:
        os.kill(driver, signal.SIGKILL)     # the whole job dies as this task starts
        time.sleep(30); os._exit(1)
    return counting(calls)()
spark = local_session(cores=1, shuffle_partitions=2, driver_memory="1g")
spark.sparkContext.setLogLevel("OFF")
got = complete_logged(prompts(spark, [f"p{i}" for i in range(24)]), factory, log, "run", rows_per_task=1)
print(sorted((r.id, r.raw_response) for r in got.collect()) == sorted((f"p{i}", f"reply p{i}") for i in range(24)))
"""


def test_a_killed_job_never_pays_twice(tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(calls)
    run = lambda kill_at: subprocess.run([sys.executable, "-c", JOB, calls, log, str(kill_at)],
                                         capture_output=True, text=True, timeout=240,
                                         env={**os.environ, "PYTHONPATH": f"{ROOT}:{ROOT}/tests"})
    killed = run(11)
    assert killed.returncode == -9 and 11 <= len(os.listdir(calls)) < 20
    resumed = run(0)
    assert resumed.stdout.split()[-1] == "True", resumed.stderr[-2000:]
    assert called(calls) == Counter({f"p{i}": 1 for i in range(24)})


def test_example_client_learns_from_its_prompt():
    ask = lambda text: ExampleClient().predict([{"role": "user", "content": text}])
    shots = "Example 1:\nSequence: ||....\nWide peaks (:): 0\nClassification: Brady\n\nExample 2:\nSequence: |||||:|||\nClassification: Tachy\n"
    assert "Brady" in ask(shots + "\nStrip: |||...") and "Tachy" in ask(shots + "\nStrip: ||||||||")
    assert "Normal" in ask("Strip: ||||||||")
