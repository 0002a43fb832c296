"""Answer extraction and scoring as columns; Python only where a grammar has to be parsed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import drop_punctuation, last_match, strip, tail

# --- multiple choice ---------------------------------------------------------------

#: Anchors before a choice letter, in order of priority; {L} stands for the letter's pattern.
CHOICE_ANCHORS = [
    ("final_answer", r"final\s+answer(?:\s+is)?\s*[:：]?\s*{L}"),
    ("answer_colon", r"\banswer\s*[:：]\s*{L}"),
    ("answer_anchor", r"\banswer\b.{{0,80}}?{L}"),
    ("option_anchor", r"\b(?:option|choice)\b(?:\s+is)?\s*{L}\b"),
    ("select_anchor", r"\b(?:choose|chosen|select|selected|pick|picked)\b.{{0,40}}?{L}"),
    ("line_start", r"(?m)^\s*(?:\*\*)?\s*{L}(?:\*\*)?\s*(?:[\)\].,:]|$)"),
]


def ladder(text: Column, steps: Sequence[tuple[str, Column | str]], group: int = 1) -> tuple[Column, Column]:
    """(value, method): the last match of the first pattern that matches."""
    found = [(name, last_match(text, p, group)) for name, p in steps]
    value = F.coalesce(*[v for _, v in found])
    method = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in found], F.lit("none"))
    return value, method


def _filled(pattern: str, letters: str | Column) -> str | Column:
    """The pattern with the letters for ``{letters}``: a text, or a column if the letters are one."""
    if isinstance(letters, str):
        return pattern.replace("{letters}", letters)
    parts = pattern.split("{letters}")
    return F.concat(*[x for i, part in enumerate(parts) for x in ([letters] if i else []) + [F.lit(part)]])


def choice_ladder(letters: str | Column = "ABCD") -> list[tuple[str, str | Column]]:
    letter = r"(?<![A-Za-z0-9])\(?([{letters}])\)?(?![A-Za-z0-9])"
    return [(name, _filled("(?iUd)" + p.format(L=letter), letters)) for name, p in CHOICE_ANCHORS]


def extract_choice(text: Column, letters: str | Column = "ABCD") -> tuple[Column, Column]:
    """(letter, method) from the last 1,000 characters; the letter is null if no anchor matches."""
    value, method = ladder(tail(text), choice_ladder(letters))
    return F.upper(value), method


def score_choice(text: Column, gold: Column, letters: str | Column = "ABCD") -> Column:
    """struct(score, is_pass, prediction, gold, extract_method)."""
    letter, method = extract_choice(text, letters)
    want = F.upper(strip(gold))
    hit = F.coalesce(letter == want, F.lit(False))
    return F.struct(hit.cast("double").alias("score"), hit.alias("is_pass"), letter.alias("prediction"), want.alias("gold"), method.alias("extract_method"))


# --- template ladder with a format score --------------------------------------------

#: The exact closing sentence, and templates tried after it; $ANS$ stands for the letter.
EXACT_SENTENCE = r"Therefore, the answer is \(([{letters}])\)"
ANSWER_TEMPLATES = [
    r"(?i)therefore,?\s*the\s*answer\s*is:?\s*\(?($ANS$)\b",
    r"(?i)so\s+the\s+answer\s+is\s+($ANS$)\.?",
    r"(?i)the\s+correct\s+answer\s+is:?\s*($ANS$)",
    r"(?i)the\s+answer\s+is\s+($ANS$)\.?",
    r"(?i)a:\s*($ANS$)",
    r"(?i)answer:\s*($ANS$)",
    r"(?i)\b($ANS$)\)?\s+is\s+correct",
    r"(?i)\(($ANS$)\)",
    r"(?i)\b($ANS$)\b",
    r"(?i)\b($ANS$)\b",
    r"(?i).*\b($ANS$)\b",
]


def extract_template(text: Column, letters: str | Column = "ABCDE") -> tuple[Column, Column, Column]:
    """(letter, method, format): format 1 for the exact sentence or the first template, 0.5 for others, 0.2 for a bare letter, 0 for none."""
    answer = r"\(?([{letters}])\)?"
    steps = [("answer_format_regex", _filled("(?Ud)" + EXACT_SENTENCE, letters))]
    scanned = tail(text)
    value, method = ladder(scanned, steps)
    templates = [(f"template_{i}", _filled("(?Ud)" + t.replace("($ANS$)", rf"(?:{answer})"), letters)) for i, t in enumerate(ANSWER_TEMPLATES)]
    v2, m2 = ladder(scanned, [*templates, ("raw_answer_regex", _filled("(?Ud)" + answer, letters))])
    letter = F.upper(F.coalesce(value, v2))
    how = F.when(value.isNotNull(), method).otherwise(m2)
    form = F.when(how.isin("answer_format_regex", "template_0"), 1.0).when(how == "none", 0.0).when(how == "raw_answer_regex", 0.2).otherwise(0.5)
    ok = (F.lit(letters) if isinstance(letters, str) else letters).contains(letter)
    return F.when(ok, letter), how, form


def score_template(text: Column, gold: Column, letters: str | Column = "ABCDE") -> Column:
    letter, method, form = extract_template(text, letters)
    want = F.upper(strip(gold))
    hit = F.coalesce(letter == want, F.lit(False))
    return F.struct(hit.cast("double").alias("score"), hit.alias("is_pass"), letter.alias("prediction"), want.alias("gold"), method.alias("extract_method"), form.alias("answer_format_correct"))


# --- answers by subset --------------------------------------------------------------

#: Answer patterns by subset; every other subset is multiple choice.
SUBSET_PATTERNS = {
    "boolean_expressions": r"[tT]rue|[fF]alse",
    "causal_judgement": r"[yY]es|[nN]o",
    "dyck_languages": r"[\]\)\}\> ]+",
    "formal_fallacies": r"[iI]nvalid|[vV]alid",
    "multistep_arithmetic_two": r"-?\d+",
    "navigate": r"[nN]o|[yY]es",
    "object_counting": r"\d+",
    "sports_understanding": r"[yY]es|[nN]o",
    "web_of_lies": r"[yY]es|[nN]o",
    "word_sorting": r"[a-z'&,-]+(?: [a-z'&,-]+)*",
}
#: Answer templates in order, and delimiter pairs to strip from the result.
SUBSET_TEMPLATES = [r"(?i)So the answer is ($ANS$)\.?", r"(?i)answer is ($ANS$)", r"(?i)answer:.*?($ANS$)", r"(?i)answer\b.*?($ANS$)", r"($ANS$)"]
DELIMITERS = [("$", "$"), ("\\(", "\\)"), ("(", ")"), ("**", "**"), ("***", "***"), ("\\[", "\\]"), ("'", "'"), ("`", "`"), ('"', '"')]


def _strip_delimiters(value: Column, pattern: str | None) -> Column:
    """Strip pairs around the value, except those that the answer's own pattern begins with."""
    for left, right in DELIMITERS:
        if pattern is None or not re.match(pattern, left):
            value = strip(F.regexp_replace(value, f"^{re.escape(left)}(.*){re.escape(right)}$", "$1"))
    return value


def extract_subset_answer(text: Column, subset: Column, gold: Column) -> tuple[Column, Column]:
    """(answer, method) by the subset's pattern; multiple choice asks for a bracketed capital, or for the gold text itself where it is free-form."""
    branches: list[tuple[Column, Column, Column]] = []

    def branch(when: Column, pattern: str | Column, choice: bool, strip_by: str | None) -> None:
        templates = [*SUBSET_TEMPLATES, *([r"\b([A-Z])\b"] if choice else []), "(?i)($ANS$)"]
        steps: list[tuple[str, Column | str]] = []
        for i, t in enumerate(templates):
            if isinstance(pattern, str):
                steps.append((f"template_{i}", "(?Ud)" + t.replace("$ANS$", pattern)))
            else:
                before, _, after = t.partition("$ANS$")
                steps.append((f"template_{i}", F.concat(F.lit("(?Ud)" + before), pattern, F.lit(after)) if "$ANS$" in t else "(?Ud)" + t))
        nonblank = [(n, F.nullif(last_match(text, p), F.lit(""))) for n, p in steps]
        value = F.coalesce(*[v for _, v in nonblank], F.lit(""))
        method = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in nonblank], F.lit("none"))
        value = _strip_delimiters(value, strip_by)
        if choice:
            value = F.when(F.length(value) == 1, F.concat(F.lit("("), value, F.lit(")"))).otherwise(value)
        branches.append((when, value, method))

    for name, pattern in SUBSET_PATTERNS.items():
        branch(subset == name, pattern, False, pattern)
    bracketed = F.regexp_like(gold, F.lit(r"^\([A-Z]\)$"))
    branch(bracketed, r"\([A-Z]\)", True, r"\([A-Z]\)")
    # every pattern character of the gold text is taken literally
    literal = F.regexp_replace(gold, r"([\\^$.|?*+()\[\]{}#&~\- ])", r"\\$1")
    branch(F.lit(True), literal, True, None)
    value = method = None
    for when, v, m in branches:
        value = F.when(when, v) if value is None else value.when(when, v)
        method = F.when(when, m) if method is None else method.when(when, m)
    return value, method


def normalise_answer(text: Column, keep_punctuation: Column | None = None) -> Column:
    low = F.lower(strip(text))
    return drop_punctuation(low) if keep_punctuation is None else F.when(keep_punctuation, low).otherwise(drop_punctuation(low))


def score_subset(text: Column, subset: Column, gold: Column) -> Column:
    value, method = extract_subset_answer(text, subset, gold)
    keep = subset == "dyck_languages"
    p, g = normalise_answer(value, keep), normalise_answer(gold, keep)
    hit = F.coalesce((p == g) & (g != ""), F.lit(False))
    return F.struct(hit.cast("double").alias("score"), hit.alias("is_pass"), value.alias("prediction"), p.alias("prediction_norm"), gold.alias("gold"), g.alias("gold_norm"), method.alias("extract_method"))


# --- code blocks --------------------------------------------------------------------


def last_fence(text: Column) -> tuple[Column, Column]:
    """(code, method): the lines between the last two lines that hold a fence."""
    lines = F.split(text, "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("```"), i)), lambda i: i.isNotNull())
    n = F.size(at)
    code = F.array_join(F.slice(lines, F.get(at, n - 2) + 2, F.greatest(F.get(at, n - 1) - F.get(at, n - 2) - 1, F.lit(0))), "\n")
    return F.when(n >= 2, code).otherwise(F.lit("")), F.when(n >= 2, "fenced_code").otherwise("no_fenced_code")


#: Fixed value: the phrase after which a completed function is looked for first.
COMPLETED = "here is the completed function"


def python_candidate(text: Column) -> Column:
    """The code of a reply: the fenced block after the phrase, else the last fenced block, else what follows the phrase, else all."""
    block = r"```(?:python|py)?[^\S\n]*\n(.*?)```"
    answer = F.nullif(F.regexp_extract(text, rf"(?is){COMPLETED}:?\s*{block}", 1), F.lit(""))
    blocks = F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?is){block}"), 1), F.lit(-1))
    after = F.nullif(F.regexp_extract(text, rf"(?is){COMPLETED}:(.*)", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(answer, blocks, after, text), r"(?U)\s+$", "")


def complete_function(prompt: Column, entry_point: Column, text: Column) -> tuple[Column, Column]:
    """(solution, is_full): the prompt continued by the reply's code, without an echo of the prompt."""
    code = python_candidate(text)
    stripped = strip(code)
    body = F.regexp_replace(stripped, r"^```[^\n]*\n?", "")
    code = F.when(F.startswith(stripped, F.lit("```")), F.regexp_replace(body, r"(?U)\n?\s*```\s*$", "")).otherwise(code)
    at = F.instr(code, prompt)
    echoed = (at > 0) & (F.length(prompt) > 0)
    rest = F.when(echoed, F.substring(code, at + F.length(prompt), F.length(code))).otherwise(code)
    defined = F.regexp_like(code, F.concat(F.lit(r"\bdef\s+\Q"), entry_point, F.lit(r"\E\s*\(")))
    rest = F.regexp_replace(rest, r"^\n+", "")
    joiner = F.when(F.endswith(prompt, F.lit("\n")), "").otherwise("\n")
    empty = (strip(code) == "") | (rest == "")
    return F.when(empty, prompt).otherwise(F.concat(prompt, joiner, rest)), (strip(code) != "") & (echoed | defined)


# --- grids in JSON ------------------------------------------------------------------


def last_json_object(text: str) -> dict | None:
    """The JSON object that ends last; of those that end together, the outermost.

    Objects are disjoint or nested, so a scan from the left that jumps behind each
    object it reads meets the outermost ones only.
    """
    decode, at, found = json.JSONDecoder().raw_decode, text.find("{"), None
    while at >= 0:
        try:
            value, end = decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            found = value
        at = text.find("{", end)
    return found


def cell(value: object) -> str:
    """A cell as text: of a map its first value, of a list its first item; lower case, single spaces."""
    while isinstance(value, (dict, list)):
        value = next(iter(value.values() if isinstance(value, dict) else value), None)
    return "" if value is None else " ".join(str(value).lower().split())


def grid_score(text: str | None, gold: str | None, total: int | None) -> tuple[float, float, float, int, str, str | None]:
    """(score, parsed, cell_accuracy, correct_cells, method, error) of a reply against a gold table in JSON."""
    try:
        want = json.loads(gold or "")
    except ValueError:
        want = None
    if not isinstance(want, dict) or not total or total < 1:
        return 0.0, 0.0, 0.0, 0, "none", "invalid gold solution"
    reply = last_json_object(text or "")
    if reply is None:
        return 0.0, 0.0, 0.0, 0, "no_json", None
    solution = reply.get("solution", {})
    method = "json_solution" if isinstance(solution, dict) else "json_no_solution"
    rows = solution if isinstance(solution, dict) else {}
    correct = 0
    for house, columns in want.items():
        own = rows.get(house)
        if isinstance(columns, dict) and isinstance(own, dict):
            correct += sum(1 for c, v in columns.items() if cell(v) and cell(v) == cell(own.get(c)))
    return float(correct == total), 1.0, correct / total, correct, method, None


GRID_TYPE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("parsed", T.DoubleType()), T.StructField("cell_accuracy", T.DoubleType()), T.StructField("correct_cells", T.IntegerType()), T.StructField("extract_method", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(GRID_TYPE)
def grid_score_udf(text: pd.Series, gold: pd.Series, total: pd.Series) -> pd.DataFrame:
    rows = [grid_score(*r) for r in zip(text, gold, total)]
    return pd.DataFrame(rows, columns=["score", "parsed", "cell_accuracy", "correct_cells", "extract_method", "error"])


# --- mathematical answers ------------------------------------------------------------

_NUMBER = re.compile(r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)")


def boxed(text: str) -> list[str]:
    """Contents of every \\boxed{...}, braces balanced."""
    out, at = [], text.find("\\boxed")
    while at >= 0:
        begin = text.find("{", at)
        if begin < 0 or text[at + 6 : begin].strip():
            at = text.find("\\boxed", at + 6)
            continue
        depth, end = 0, begin
        while end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            if not depth:
                out.append(text[begin + 1 : end])
                break
            end += 1
        at = text.find("\\boxed", begin)
    return out


#: Longer numbers are compared as texts.
MOST_DIGITS = 2000


def canonical(answer: str) -> str:
    """A number as a reduced fraction, anything else without TeX spacing, in lower case."""
    a = re.sub(r"\\(?:left|right|,|;|!|\s|displaystyle|mathrm|text)|\$|\s|^\\\(|\\\)$", "", answer).strip(".")
    a = re.sub(r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)", a).replace("^\\circ", "").replace("\\%", "").replace("%", "")
    a = re.sub(r"\((-?\d+)\)", r"\1", a)
    m = re.fullmatch(r"([-+]?[\d,]*\.?\d+)(?:/([-+]?\d+))?", a)
    if m and len(a) <= MOST_DIGITS:
        below = Fraction(m[2] or 1)
        if below:
            return str(Fraction(m[1].replace(",", "")) / below)
    return a.strip("{}").lower()


def math_answers(text: str) -> list[str]:
    """Candidate answers: boxed ones, else the last number after an answer phrase, else the last number."""
    found = boxed(text)
    if not found:
        tail_ = re.split(r"(?i)answer(?:\s+is)?\s*:?", text)[-1]
        numbers = _NUMBER.findall(tail_) or _NUMBER.findall(text)
        found = numbers[-1:]
    return [canonical(x) for x in found]


def math_equal(a: str, b: str, digits: int = 6) -> bool:
    if a == b:
        return True
    try:
        return max(len(a), len(b)) <= 2 * MOST_DIGITS + 1 and round(Fraction(a) - Fraction(b), digits) == 0
    except (ArithmeticError, ValueError):
        return False


MATH_TYPE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("prediction_extracted", T.ArrayType(T.StringType())), T.StructField("gold_extracted", T.ArrayType(T.StringType()))])


@F.pandas_udf(MATH_TYPE)
def math_score_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, gold in parts:
        rows = []
        for t, g in zip(text, gold):
            want, got = [canonical(str(g or "").strip())], math_answers(t or "")
            rows.append((float(bool(want[0]) and any(math_equal(w, p) for w in want for p in got)), got, want))
        yield pd.DataFrame(rows, columns=["score", "prediction_extracted", "gold_extracted"])

