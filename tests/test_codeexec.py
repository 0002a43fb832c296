import base64
import json
import pickle
import zlib

from pyspark.sql import functions as F

from gradeloom.operators import codeexec as C


def test_program():
    check = "def check(f):\n    assert f(1, 2) == 3\n    assert f(0, 0) == 0\n"
    assert C.run_program("def add(a, b):\n    return a + b\n" + check + "check(add)") == "pass"
    assert C.run_program("def add(a, b):\n    return a - b\n" + check + "check(add)") == "fail"
    assert C.run_program("while True: pass", 0.3) == "timeout"
    assert C.run_program("syntax error(") == "fail"
    assert C.run_program("import os\nos.system('echo x')") == "fail"
    assert C.run_program("raise SystemExit(0)") == "fail"


def test_stdin_tests():
    assert C.run_tests("print(42)", [""], ["42\n"], None) == ([True], None)
    assert C.run_tests("print(int(input()) + 1)", ["1", "5"], ["2", "7"], None) == ([True, -2], None)
    assert C.run_tests("print('1.50 2')", [""], ["1.5 2.0"], None)[0] == [True]
    assert C.run_tests("print(1)\nprint(2)", [""], ["1"], None)[0] == [-2]
    statuses, error = C.run_tests("1/0", ["", ""], ["", ""], None)
    assert statuses == [-4] and "ZeroDivision" in error
    assert C.run_tests("while 1: pass", [""], [""], None, 0.3)[0] == [-3]
    assert C.run_tests("import sys\nprint(sys.stdin.read().strip())\nsys.exit()", ["q"], ["q"], None)[0] == [True]


def test_call_tests():
    code = "class Solution:\n    def f(self, a, b):\n        return (a, b)"
    assert C.run_tests(code, ["1\n[2]"], ["[1, [2]]"], "f") == ([True], None)
    assert C.run_tests("def f(x): return x", ["1", "2"], ["1", "3"], "f")[0] == [True, False]
    assert C.run_tests("def g(x): return x", ["1"], ["1"], "f")[0] == [-4]


def test_cases():
    cases = [{"input": "1", "output": "2"}]
    assert C.decode_cases(json.dumps(cases)) == cases
    assert C.decode_cases(base64.b64encode(zlib.compress(json.dumps(cases).encode())).decode()) == cases
    assert C.decode_cases(base64.b64encode(zlib.compress(pickle.dumps(json.dumps(cases)))).decode()) == []
    assert C.decode_cases("") == C.decode_cases(None) == C.decode_cases("{}") == []


def test_udfs(spark):
    df = spark.createDataFrame([("print(input())", ["a", "b"], ["a", "c"], None), ("", ["a"], ["a"], None)], "code string, i array<string>, o array<string>, fn string")
    rows = [r.r for r in df.select(C.run_tests_udf("code", "i", "o", "fn", F.lit(2.0)).alias("r")).collect()]
    assert [(r.score, r.num_tests, r.passed_tests) for r in rows] == [(0.0, 2, 1), (0.0, 1, 0)]
    assert [tuple(s) for s in rows[0].statuses] == [(True, None), (None, -2)]
    assert df.select(C.run_program_udf(F.lit("x = 1"), F.lit(2.0)).alias("r")).first().r.status == "pass"
    assert df.select(C.decode_cases_udf(F.lit('[{"input": 1}]')).alias("r")).first().r[0].output == ""
