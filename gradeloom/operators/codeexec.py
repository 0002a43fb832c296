"""Running generated code against tests, in a child process per generation.

The child gets an isolated interpreter, an empty environment, its own folder,
limits on CPU time, memory and file size, and a wall-clock limit; it is killed
with its process group. Nothing generated is run in the worker, and test cases
are JSON: packed ones may be base64 of zlib of JSON, but never pickles.
"""

from __future__ import annotations

import base64
import json
import os
import signal
import subprocess
import sys
import tempfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Status codes of a test besides true and false.
GLOBAL_TIMEOUT, WRONG, TIMEOUT, RUNTIME_ERROR, HARNESS_ERROR = -1, -2, -3, -4, -5

_CHILD = r"""
import contextlib, io, json, resource, signal, sys
from decimal import Decimal, InvalidOperation
job = json.load(sys.stdin)
def limit(what, n):
    try:
        resource.setrlimit(what, (n, n))
    except (ValueError, OSError):
        pass
limit(resource.RLIMIT_AS, job["memory"])
limit(resource.RLIMIT_FSIZE, 1 << 20)
limit(resource.RLIMIT_CPU, int(job["wall"]) + 2)
import os, shutil, subprocess
for module, names in ((os, "kill system fork forkpty killpg rename renames truncate replace unlink remove rmdir removedirs chmod chown execv execve posix_spawn"), (shutil, "rmtree move chown"), (subprocess, "Popen run call check_output")):
    for name in names.split():
        if hasattr(module, name):
            setattr(module, name, None)
class Late(BaseException):
    pass
def late(*_):
    raise Late
signal.signal(signal.SIGALRM, late)
def timed(f, seconds):
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
def same_line(a, b):
    if a == b:
        return True
    try:
        return [Decimal(x) for x in a.split()] == [Decimal(x) for x in b.split()]
    except InvalidOperation:
        return False
def lines(text):
    return [x.strip() for x in text.strip().split("\n")]
out, said = [], sys.stdout
def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
if job["kind"] == "program":
    space = {"__name__": "__main__"}
    try:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            timed(lambda: exec(compile(job["code"], "solution", "exec"), space), job["wall"])
        out = [True]
    except Late:
        out = [-3]
    except BaseException as e:
        out, job["error"] = [False], type(e).__name__
else:
    space, f = {"__name__": "solution"}, None
    try:
        code = compile(job["code"], "solution", "exec")
        if job["fn"]:
            with contextlib.redirect_stdout(io.StringIO()):
                timed(lambda: exec(code, space), job["each"])
            f = getattr(space["Solution"](), job["fn"]) if "Solution" in space else space[job["fn"]]
    except Late:
        out = [-3]
    except BaseException as e:
        out, job["error"] = [-4], repr(e)[:300]
    for given, want in [] if out else zip(job["inputs"], job["outputs"]):
        try:
            if job["fn"]:
                args = [json.loads(x) for x in given.split("\n")]
                with contextlib.redirect_stdout(io.StringIO()):
                    got = timed(lambda: f(*args), job["each"])
                out.append(plain(got) == json.loads(want))
            else:
                stdin, sink = sys.stdin, io.StringIO()
                sys.stdin = io.TextIOWrapper(io.BytesIO(given.encode()), "utf-8")
                try:
                    with contextlib.redirect_stdout(sink):
                        timed(lambda: exec(code, {"__name__": "__main__"}), job["each"])
                except SystemExit:
                    pass
                finally:
                    sys.stdin = stdin
                a, b = lines(sink.getvalue()), lines(want)
                out.append(True if len(a) == len(b) and all(map(same_line, a, b)) else -2)
        except Late:
            out.append(-3)
        except BaseException as e:
            out.append(-4)
            job["error"] = repr(e)[:300]
        if out[-1] is not True:
            break
said.write(json.dumps({"statuses": out, "error": job.get("error")}))
"""


def run_child(job: dict, wall: float, memory: int = 2 << 30) -> dict | None:
    """The child's report; null if it had to be killed or died."""
    with tempfile.TemporaryDirectory() as folder:
        child = subprocess.Popen([sys.executable, "-I", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=folder, env={}, start_new_session=True, text=True)
        try:
            said, _ = child.communicate(json.dumps(job | {"wall": wall, "memory": memory}), timeout=wall + 2)
        except subprocess.TimeoutExpired:
            return None
        finally:
            try:
                os.killpg(child.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            child.wait()
    try:
        return json.loads(said)
    except ValueError:
        return {"statuses": [], "error": "the child died"}


def run_program(code: str, timeout: float = 20.0) -> str:
    """``pass``, ``fail`` or ``timeout`` of a program with its assertions; 0.1 s at least."""
    report = run_child({"kind": "program", "code": code}, max(0.1, timeout))
    if report is None or report["statuses"] == [TIMEOUT]:
        return "timeout"
    return "pass" if report["statuses"] == [True] else "fail"


def run_tests(code: str, inputs: list[str], outputs: list[str], fn: str | None, timeout: float = 6.0) -> tuple[list, str | None]:
    """(statuses, runtime_error) of the tests up to the first that fails: calls of ``fn``, or a program on stdin without one."""
    wall = min(600.0, (timeout + 1) * len(inputs) + 5)
    report = run_child({"kind": "tests", "code": code, "inputs": list(inputs), "outputs": list(outputs), "fn": fn, "each": timeout}, wall)
    if report is None:
        return [GLOBAL_TIMEOUT] * len(inputs), "Global Timeout"
    statuses = [s if isinstance(s, (bool, int)) else HARNESS_ERROR for s in report["statuses"]] or [HARNESS_ERROR]
    bad = any(not isinstance(s, bool) and s in (GLOBAL_TIMEOUT, TIMEOUT, RUNTIME_ERROR, HARNESS_ERROR) for s in statuses)
    return statuses, (report.get("error") or "time limit or harness error") if bad else None


def decode_cases(text: str | None) -> list[dict]:
    """Test cases from JSON, or from base64 of zlib of JSON; [] for anything else."""
    raw = (text or "").strip()
    for read in (lambda: json.loads(raw), lambda: json.loads(zlib.decompress(base64.b64decode(raw, validate=True)))):
        try:
            found = read()
        except (ValueError, zlib.error):
            continue
        return [c for c in found if isinstance(c, dict)] if isinstance(found, list) else []
    return []


PROGRAM_TYPE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("is_pass", T.BooleanType()), T.StructField("status", T.StringType())])
STATUS_TYPE = T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("code", T.IntegerType())])
TESTS_TYPE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("num_tests", T.IntegerType()), T.StructField("passed_tests", T.IntegerType()), T.StructField("statuses", T.ArrayType(STATUS_TYPE)), T.StructField("runtime_error", T.StringType())])


@F.pandas_udf(PROGRAM_TYPE)
def run_program_udf(code: pd.Series, timeout: pd.Series) -> pd.DataFrame:
    status = [run_program(c or "", t) for c, t in zip(code, timeout)]
    return pd.DataFrame({"score": [float(s == "pass") for s in status], "is_pass": [s == "pass" for s in status], "status": status})


@F.pandas_udf(TESTS_TYPE)
def run_tests_udf(code: pd.Series, inputs: pd.Series, outputs: pd.Series, fn: pd.Series, timeout: pd.Series) -> pd.DataFrame:
    rows = []
    for c, i, o, f, t in zip(code, inputs, outputs, fn, timeout):
        i, o = list(i) if i is not None else [], list(o) if o is not None else []
        statuses, error = run_tests(c, i, o, f or None, t) if c else ([], None)
        good = sum(s is True for s in statuses)
        rows.append((float(bool(i) and good == len(i)), len(i), good, [{"passed": s if isinstance(s, bool) else None, "code": None if isinstance(s, bool) else s} for s in statuses], error))
    return pd.DataFrame(rows, columns=TESTS_TYPE.names)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())])))
def decode_cases_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[{"input": str(c.get("input", "")), "output": str(c.get("output", ""))} for c in decode_cases(t)] for t in text])
