import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import extract as X
from gradeloom.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "text, letter, method",
    [
        ("Final answer: (C).", "C", "final_answer"),
        ("I think the correct option is B.", "B", "option_anchor"),
        ("Answer: because of uncertainty.", None, "none"),
        ("My answer is gamma option.", None, "none"),
        ("the answer is a good one", "A", "answer_anchor"),
        ("Answer: A\nAnswer: D", "D", "answer_colon"),
        ("so we pick (b)", "B", "select_anchor"),
        ("**C**\n", "C", "line_start"),
        ("final answer：Ｄ final answer： d", "D", "final_answer"),
        ("because " * 2500 + "\nFinal answer: (C).", "C", "final_answer"),
        ("Answer: C\n" + "because " * 2500, None, "none"),
        ("", None, "none"),
    ],
)
def test_choice(spark, text, letter, method):
    r = one(spark, X.score_choice(F.col("t"), F.lit(" c ")), t=text)
    assert (r.prediction, r.extract_method, r.score) == (letter, method, float(letter == "C"))


@pytest.mark.parametrize("text, letter, form", [("Therefore, the answer is (D).", "D", 1.0), ("therefore the answer is: (b)", "B", 1.0), ("The answer is (D).", "D", 0.5), ("(A) or maybe (C)", "C", 0.5), ("xDx", "D", 0.2), ("nonE", "E", 0.2), ("zzz", None, 0.0)])
def test_template(spark, text, letter, form):
    r = one(spark, X.score_template(F.col("t"), F.lit("D")), t=text)
    assert r.prediction == letter and r.answer_format_correct == form


@pytest.mark.parametrize(
    "text, subset, gold, score, prediction",
    [
        ("We reason it out. So the answer is B.", "date_understanding", "(B)", 1.0, "(B)"),
        ("We reason it out. So the answer is dearth, wind, & fire.", "ruin_names", "dearth, wind, & fire", 1.0, "dearth, wind, & fire"),
        ("So the answer is True.", "boolean_expressions", "true", 1.0, "True"),
        ("answer is -12 or so", "multistep_arithmetic_two", "-12", 1.0, "-12"),
        ("So the answer is ] ) }.", "dyck_languages", "] ) }", 1.0, "] ) }"),
        ("nothing", "object_counting", "4", 0.0, ""),
        ("So the answer is (C).", "hyperbaton", "(B)", 0.0, "(C)"),
        ("we know: `yes`", "navigate", "Yes", 1.0, "yes"),
    ],
)
def test_subset(spark, text, subset, gold, score, prediction):
    r = one(spark, X.score_subset(F.col("t"), F.col("s"), F.col("g")), t=text, s=subset, g=gold)
    assert (r.score, r.prediction) == (score, prediction)


def test_fences(spark):
    assert tuple(one(spark, F.struct(*X.last_fence(F.col("t"))), t="a\n```py\nx\n```\nb\n```python\nprint(42)\n\n```")) == ("print(42)\n", "fenced_code")
    assert tuple(one(spark, F.struct(*X.last_fence(F.col("t"))), t="print(42)\n```")) == ("", "no_fenced_code")


def test_complete_function(spark):
    prompt = "def add(a, b):\n"
    run = lambda t: tuple(one(spark, F.struct(*X.complete_function(F.col("p"), F.lit("add"), F.col("t"))), p=prompt, t=t))
    assert run("```python\ndef add(a, b):\n    return a + b\n```") == (prompt + "    return a + b", True)
    assert run("    return a + b\n") == (prompt + "    return a + b", False)
    assert run("Here is the completed function:\n```python\n    return 1\n```\n```python\nno\n```")[0] == prompt + "    return 1"
    assert run("```python\nimport x\ndef add (a, b): return 1\n```")[1] is True
    assert run("  \n") == (prompt, False)


def test_json_grid():
    gold = json.dumps({"House 1": {"Name": "Alice"}})
    reply = json.dumps({"reasoning": "uses {A} and {B}", "solution": {"House 1": {"Name": " ALICE "}}})
    assert X.grid_score("prose {A} " + reply + " end", gold, 1)[:5] == (1.0, 1.0, 1.0, 1, "json_solution")
    assert X.grid_score('{"solution": {"House 1": {"Name": {"x": ["alice", 2]}}}}', gold, 1)[0] == 1.0
    assert X.grid_score('{"solution": 3}', gold, 1)[3:5] == (0, "json_no_solution")
    assert X.grid_score("none {", gold, 1)[1:5] == (0.0, 0.0, 0, "no_json")
    assert X.grid_score("{}", "[]", 1)[5] and X.grid_score(None, None, None)[5]
    assert X.last_json_object('{"a": {"b": 1}} {"c": 2') == {"a": {"b": 1}}
    assert X.last_json_object('{"a": 1} x {"b": {"c": 2}}') == {"b": {"c": 2}}


def test_json_grid_udf(spark):
    df = spark.createDataFrame([('{"solution": {"House 1": {"Name": "bob"}}}', '{"House 1": {"Name": "Bob", "Pet": "cat"}}', 2)], "t string, g string, n int")
    r = df.select(X.grid_score_udf("t", "g", "n").alias("r")).first().r
    assert (r.score, r.cell_accuracy, r.correct_cells) == (0.0, 0.5, 1)


@pytest.mark.parametrize("text, gold, ok", [("so \\boxed{025}", "25", True), ("\\boxed{\\frac{1}{2}} ", "0.5", True), ("the answer is 1,024.", "1024", True), ("\\boxed{3} then \\boxed{4}", "3", True), ("no number", "5", False), ("answer: 7", "8", False), ("\\boxed{x^{2}}", "x^{2}", True), ("", "", False)])
def test_math(spark, text, gold, ok):
    r = one(spark, X.math_score_udf(F.col("t"), F.col("g")), t=text, g=gold)
    assert r.score == float(ok)


def test_text(spark):
    assert one(spark, T.slugify(F.col("t")), t="  Sat-EN (x) ") == "sat_en_x"
    assert one(spark, T.run_id(F.col("t")), t="Org/My Model@v1.5/") == "my-model-v1.5"
    assert one(spark, T.run_id(F.col("t")), t="///") == "model"
    assert one(spark, T.strip(F.col("t")), t="\n  a b\t") == "a b"
    assert one(spark, T.words(F.col("t")), t="naïve café_1, 2") == ["naïve", "café_1", "2"]
    assert one(spark, T.collapse(F.col("t")), t=" A  b\nC ") == "a b c"


def test_scorers_never_raise():
    """Huge numbers, odd arguments and zero divisors are scored, not raised."""
    from gradeloom.functions import instructions_python as P

    assert X.canonical("9" * 5000) == "9" * 5000 and not X.math_equal("9" * 400, "1") and not X.math_equal("9" * 6000, "1")
    assert X.canonical("1/0") == "1/0" and not X.math_equal("1/0", "1")
    assert X.math_equal("1/3", "0.33333333")
    assert P.follow("words:keywords_specific_position", "a b.", '{"keyword": "a", "n": -3, "m": 1}') is False
    assert P.follow("words:keywords_specific_position", "a b.", "[1]") is None and P.follow("sentence:keyword", "a", '{"word": [], "N": {}}') is None


def test_letters_of_the_row(spark):
    df = spark.createDataFrame([("Final answer: M", "ABCDEFGHIJKLM"), ("Final answer: M", "ABCD"), ("The answer is (B).", "AB")], "t string, letters string")
    from pyspark.sql import functions as F

    got = [r.p for r in df.select(X.extract_choice(F.col("t"), F.col("letters"))[0].alias("p")).collect()]
    assert got == ["M", None, "B"]
    got = [r.p for r in df.select(X.extract_template(F.col("t"), F.col("letters"))[0].alias("p")).collect()]
    assert got[0] == "M" and got[2] == "B"
