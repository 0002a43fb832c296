"""The registered tasks: how each reads samples, prompts, scores and aggregates.

A task maps raw rows to samples (sample_id, gold, meta, and typed columns), checks
them by rules that yield a table of errors, and gives a prompt column, a score
column and a metrics table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import extract as X
from gradeloom.functions import prompts as P
from gradeloom.functions.text import strip
from gradeloom.operators import codeexec as C
from gradeloom.operators import following
from gradeloom.operators import metrics as M

Rules = dict[str, Column]


@dataclass(frozen=True)
class Task:
    name: str
    raw: str  # schema of the raw rows
    samples: Callable[[DataFrame], DataFrame]
    rules: Callable[[], Rules]  # conditions on raw rows that must hold
    prompt: Callable[[], Column]
    score: Callable[[DataFrame], DataFrame]  # adds score, is_pass, parsed (JSON), error
    aggregate: Callable[[DataFrame, dict[str, Any]], DataFrame]
    primary: str = "accuracy"
    defaults: dict[str, Any] = field(default_factory=dict)

    def errors(self, rows: DataFrame) -> DataFrame:
        """(sample, rule) for every broken rule."""
        bad = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in self.rules().items()]), lambda x: x.isNotNull())
        ident = next(c for c in rows.columns if c in ("id", "task_id", "key"))
        return rows.select(F.col(ident).cast("string").alias("sample"), F.explode(bad).alias("rule"))


TASKS: dict[str, Task] = {}
#: The tasks' default settings.
GREEDY = {"n": 1, "max_new_tokens": 4096, "temperature": 0.0, "top_p": 1.0}
SAMPLED = {"max_new_tokens": 4096, "temperature": 1.0, "top_p": 0.7}
CODE = {"n": 10, "max_new_tokens": 4096, "temperature": 0.6, "top_p": 0.95}


def register(task: Task) -> Task:
    """Add a task; its name must be new and not blank."""
    if not task.name.strip() or task.name in TASKS:
        raise ValueError(f"task name is blank or taken: {task.name!r}")
    TASKS[task.name] = task
    return task


def filled(*names: str) -> Rules:
    return {f"{n} is empty": F.length(strip(F.col(n).cast("string"))) > 0 for n in names}


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def choice_list(choices: Column) -> Column:
    """A map letter -> text as options in the order of the alphabet, as far as letters follow each other from A."""
    every = F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.struct(x.alias("letter"), strip(F.try_element_at(choices, x)).alias("text")))
    gap = F.array_position(F.transform(every, lambda c: c.text.isNull()), True)
    return F.slice(every, F.lit(1), F.when(gap > 0, gap - 1).otherwise(len(LETTERS)).cast("int"))


def choice_rules(least: int) -> Callable[[], Rules]:
    def rules() -> Rules:
        own = choice_list(F.col("choices"))
        return filled("id", "question", "answer") | {
            f"fewer than {least} choices": F.size(own) >= least,
            "a choice is empty": F.forall(own, lambda c: c.text != ""),
            "answer is no choice": F.array_contains(F.transform(own, lambda c: c.letter), F.upper(strip(F.col("answer")))),
        }

    return rules


def meta(*names: str) -> Column:
    return F.to_json(F.struct(*[F.coalesce(strip(F.col(n).cast("string")), F.lit("")).alias(n) for n in names]))


def from_meta(name: str) -> Column:
    return F.get_json_object("meta", f"$.{name}")


def _scored(rows: DataFrame, result: Column) -> DataFrame:
    out = rows.withColumn("__r", result)
    fields = out.schema["__r"].dataType.names
    rest = [f for f in fields if f not in ("score", "is_pass", "error")]
    parsed = F.to_json(F.struct(*[F.col(f"__r.{f}").alias(f) for f in rest]), {"ignoreNullFields": "false"})
    return out.select(*rows.columns, F.coalesce(F.col("__r.score"), F.lit(0.0)).alias("score"), (F.col("__r.score") >= 1.0).alias("is_pass"), parsed.alias("parsed"), (F.col("__r.error") if "error" in fields else F.lit(None).cast("string")).alias("error"))


def parsed(path: str) -> Column:
    return F.get_json_object("parsed", f"$.{path}")


def _choice_task(name: str, more: str, group: str | None, prompt: Callable[[Column, Column], Column], kept: tuple[str, ...], defaults: dict, least: int, wide: bool = False) -> None:
    """Multiple-choice tasks differ in their groups, layouts and extractors."""

    def samples(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("sample_id"), F.upper(strip(F.col("answer"))).alias("gold"), meta(*kept).alias("meta"), strip(F.col("question")).alias("question"), choice_list(F.col("choices")).alias("choices"))

    def score(rows: DataFrame) -> DataFrame:
        text, gold = F.coalesce("generation", F.lit("")), F.col("gold")
        f = X.score_template if wide else X.score_choice
        letters = F.substring(F.lit(LETTERS), F.lit(1), F.size("choices")) if least == 2 else LETTERS[:4]  # of the row's own options
        return _scored(rows, f(text, gold, letters))

    def aggregate(records: DataFrame, options: dict) -> DataFrame:
        flag = F.length(F.coalesce(parsed("prediction"), F.lit(""))) > 0
        return M.binary_metrics(records, n=options.get("n"), ks=options.get("pass_k_values"), parsed=flag, group=from_meta(group) if group else None)

    schema = f"id string, question string, choices map<string,string>, answer string, {more}"
    register(Task(name, schema, samples, choice_rules(least), lambda: P.user(prompt(F.col("question"), F.col("choices"))), score, aggregate, defaults=defaults))


_choice_task("agieval_en", "subset string, query string, source string", "subset", P.choice_sentence, ("subset", "source"), GREEDY, 2, wide=True)
_choice_task("gpqa_diamond", "record_id string, correct_answer string, domain string, subdomain string, source string", "domain", P.choice_line, ("domain", "subdomain", "record_id"), SAMPLED | {"n": 32}, 4)
_choice_task("mmlu_pro", "question_id int, category string, src string, source string", "category", P.choice_line, ("category", "src", "question_id"), GREEDY, 2)


def _math(name: str) -> None:
    ask = "\n\nPlease think step by step, and put your final answer within \\boxed{}."

    def samples(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("sample_id"), strip(F.col("answer")).alias("gold"), meta("year", "url").alias("meta"), "problem", "solution")

    def aggregate(records: DataFrame, options: dict) -> DataFrame:
        found = F.get_json_object("parsed", "$.prediction_extracted[0]").isNotNull()
        return M.binary_metrics(records, n=options.get("n"), ks=options.get("pass_k_values"), parsed=found)

    register(Task(name, "id string, problem string, answer string, solution string, url string, year string, source string", samples, lambda: filled("id", "problem", "answer"), lambda: P.user(F.concat(F.col("problem"), F.lit(ask))), lambda rows: _scored(rows, X.math_score_udf("generation", "gold")), aggregate, "accuracy", SAMPLED | {"n": 16}))


_math("aime24")
_math("aime25")

#: The description of each subset.
SUBSETS = {
    "boolean_expressions": "Evaluate the result of a random Boolean expression.",
    "causal_judgement": "Answer questions about causal attribution.",
    "date_understanding": "Infer the date from context.",
    "disambiguation_qa": "Clarify the meaning of sentences with ambiguous pronouns.",
    "dyck_languages": "Correctly close a Dyck-n word.",
    "formal_fallacies": "Distinguish deductively valid arguments from formal fallacies.",
    "geometric_shapes": "Name geometric shapes from their SVG paths.",
    "hyperbaton": "Order adjectives correctly in English sentences.",
    "logical_deduction_five_objects": "A logical deduction task which requires deducing the order of a sequence of objects.",
    "logical_deduction_seven_objects": "A logical deduction task which requires deducing the order of a sequence of objects.",
    "logical_deduction_three_objects": "A logical deduction task which requires deducing the order of a sequence of objects.",
    "movie_recommendation": "Recommend movies similar to the given list of movies.",
    "multistep_arithmetic_two": "Solve multi-step arithmetic problems.",
    "navigate": "Given a series of navigation instructions, determine whether one would end up back at the starting point.",
    "object_counting": "Questions that involve enumerating objects and asking the model to count them.",
    "penguins_in_a_table": "Answer questions about a table of penguins and their attributes.",
    "reasoning_about_colored_objects": "Answer extremely simple questions about the colors of objects on a surface.",
    "ruin_names": "Select the humorous edit that ruins the input movie or musical artist name.",
    "salient_translation_error_detection": "Detect the type of error in an English translation of a German source sentence.",
    "snarks": "Determine which of two sentences is sarcastic.",
    "sports_understanding": "Determine whether an artificially constructed sentence relating to sports is plausible or not.",
    "temporal_sequences": "Answer questions about which times certain events could have occurred.",
    "tracking_shuffled_objects_five_objects": "Determine final positions of objects after a sequence of swaps.",
    "tracking_shuffled_objects_seven_objects": "Determine final positions of objects after a sequence of swaps.",
    "tracking_shuffled_objects_three_objects": "Determine final positions of objects after a sequence of swaps.",
    "web_of_lies": "Evaluate a random boolean function expressed as a word problem.",
    "word_sorting": "Sort a list of words.",
}


def subset_description(subset: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUBSETS.items() for x in kv]), subset), F.lit(""))


def _bbh_samples(rows: DataFrame) -> DataFrame:
    subset = strip(F.col("subset"))
    return rows.select(strip(F.col("id")).alias("sample_id"), strip(F.col("answer")).alias("gold"), meta("subset", "source").alias("meta"), subset.alias("subset"), strip(F.col("input")).alias("input"), strip(F.coalesce("description", subset_description(subset))).alias("description"))


def _bbh_metrics(records: DataFrame, options: dict) -> DataFrame:
    flag = F.length(F.coalesce(parsed("prediction_norm"), F.lit(""))) > 0
    return M.aliased(M.binary_metrics(records, n=options.get("n"), ks=options.get("pass_k_values"), parsed=flag, group=from_meta("subset")), {"accuracy": "exact_match"})


register(
    Task(
        "bbh",
        "id string, subset string, input string, target string, answer string, description string, source string",
        _bbh_samples,
        lambda: filled("id", "subset", "input", "target", "answer"),
        lambda: P.user(P.step_by_step(F.col("description"), F.col("input"))),
        lambda rows: _scored(rows, X.score_subset(F.coalesce("generation", F.lit("")), F.get_json_object("meta", "$.subset"), F.col("gold"))),
        _bbh_metrics,
        "exact_match",
        GREEDY,
    )
)


def _function_samples(rows: DataFrame) -> DataFrame:
    return rows.select(strip(F.col("task_id")).alias("sample_id"), F.lit(None).cast("string").alias("gold"), meta("entry_point").alias("meta"), "prompt", strip(F.col("entry_point")).alias("entry_point"), "test")


def _function_score(rows: DataFrame) -> DataFrame:
    solution, full = X.complete_function(F.col("prompt"), F.col("entry_point"), F.coalesce("generation", F.lit("")))
    test = F.regexp_replace(F.coalesce("test", F.lit("")), r"(?U)\s+$", "")
    code = F.when(test != "", F.concat(solution, F.lit("\n\n"), test, F.lit("\ncheck("), F.col("entry_point"), F.lit(")\n"))).otherwise(solution)
    ran = rows.withColumn("__x", C.run_program_udf(code, F.lit(20.0))).withColumn("__full", full)
    ok, status = F.col("__x.is_pass"), F.col("__x.status")
    result = F.struct(F.col("__x.score").alias("score"), ok.alias("base_pass"), ok.alias("plus_pass"), status.alias("base_status"), status.alias("plus_status"), status.alias("exec_result"), F.col("__full").alias("is_full_solution"))
    return _scored(ran, result).drop("__x", "__full")


def _function_metrics(records: DataFrame, options: dict) -> DataFrame:
    plus = F.coalesce(parsed("plus_pass").cast("boolean").cast("double"), (F.col("score") >= 1.0).cast("double"))
    base = F.coalesce(parsed("base_pass").cast("boolean").cast("double"), plus)
    out = M.binary_metrics(records, n=options.get("n"), ks=options.get("pass_k_values"), score=plus, parsed=F.col("parsed").isNotNull())
    own = M.accuracy(M.per_sample(records, score=base)).where("metric <> 'parsed_rate'").withColumn("metric", F.replace("metric", F.lit("accuracy"), F.lit("accuracy_base")))
    copies = out.where(F.col("metric").isin("accuracy", "accuracy_stderr")).withColumn("metric", F.replace("metric", F.lit("accuracy"), F.lit("accuracy_plus")))
    return out.unionByName(copies).unionByName(own)


register(
    Task(
        "humaneval_plus",
        "task_id string, prompt string, entry_point string, test string, canonical_solution string, base_input string, plus_input string, atol double, contract string",
        _function_samples,
        lambda: filled("task_id", "prompt", "entry_point") | {"base_input is no list": F.col("base_input").startswith("["), "plus_input is no list": F.col("plus_input").startswith("["), "atol is missing": F.col("atol").isNotNull()},
        lambda: P.function_task(F.col("prompt")),
        _function_score,
        _function_metrics,
        "pass@1",
        CODE,
    )
)


def _instruction_samples(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("sample_id"), F.lit(None).cast("string").alias("gold"), F.to_json(F.struct("instruction_id_list")).alias("meta"), "prompt", F.col("instruction_id_list").alias("instruction_ids"), F.col("kwargs"))


def _instruction_score(rows: DataFrame) -> DataFrame:
    judged = following.evaluate(rows)
    out = rows.join(judged, ["sample_id", "gen_idx"])
    levels = F.struct(F.col("strict").cast("double").alias("prompt_level_strict_acc"), F.col("loose").cast("double").alias("prompt_level_loose_acc"), F.col("strict_flags").alias("inst_level_strict_acc"), F.col("loose_flags").alias("inst_level_loose_acc"))
    error = F.when(F.size("errors") > 0, F.concat(F.lit("missing arguments: "), F.array_join("errors", ", ")))
    return out.select(*rows.columns, F.col("loose").cast("double").alias("score"), F.col("loose").alias("is_pass"), F.to_json(levels).alias("parsed"), error.alias("error"))


def _instruction_metrics(records: DataFrame, options: dict) -> DataFrame:
    flags = lambda name: F.from_json(parsed(name), "array<boolean>")
    expected = F.size(F.from_json(from_meta("instruction_id_list"), "array<string>"))
    own = records.select("sample_id", "score", (parsed("prompt_level_strict_acc").cast("double") >= 1).alias("strict"), (parsed("prompt_level_loose_acc").cast("double") >= 1).alias("loose"), flags("inst_level_strict_acc").alias("strict_flags"), flags("inst_level_loose_acc").alias("loose_flags"), expected.alias("expected"))
    return M.instruction_metrics(own)


for _name in ("ifeval", "ifbench"):
    register(
        Task(
            _name,
            "key string, prompt string, instruction_id_list array<string>, kwargs array<string>",
            _instruction_samples,
            lambda: filled("key", "prompt") | {"no instructions": F.size("instruction_id_list") > 0},
            lambda: P.user(F.col("prompt")),
            _instruction_score,
            _instruction_metrics,
            "prompt_level_loose_acc",
            GREEDY,
        )
    )


def _program_samples(rows: DataFrame) -> DataFrame:
    cases = rows.withColumn("__public", C.decode_cases_udf("public_test_cases")).withColumn("__private", C.decode_cases_udf("private_test_cases"))
    every = F.concat("__public", "__private")
    return cases.select(
        strip(F.col("id")).alias("sample_id"),
        F.lit(None).cast("string").alias("gold"),
        meta("question_id", "platform", "difficulty", "contest_id", "contest_date", "source_subset").alias("meta"),
        strip(F.col("question_content")).alias("question_content"),
        F.coalesce("starter_code", F.lit("")).alias("starter_code"),
        F.nullif(strip(F.get_json_object("metadata", "$.func_name")), F.lit("")).alias("fn_name"),
        F.transform(every, lambda c: c.input).alias("inputs"),
        F.transform(every, lambda c: c.output).alias("outputs"),
        F.size("__public").alias("num_public_tests"),
        F.size("__private").alias("num_private_tests"),
    )


def _program_score(rows: DataFrame) -> DataFrame:
    code, method = X.last_fence(F.coalesce("generation", F.lit("")))
    ran = rows.withColumn("__code", code).withColumn("__m", method).withColumn("__x", C.run_tests_udf("__code", "inputs", "outputs", "fn_name", F.lit(6.0)))
    result = F.struct(F.col("__x.score").alias("score"), F.col("__m").alias("extract_method"), (F.col("__code") != "").alias("had_code"), F.col("__x.num_tests").alias("num_tests"), F.col("__x.passed_tests").alias("passed_tests"), F.col("__x.statuses").alias("statuses"), F.col("__x.runtime_error").alias("runtime_error"))
    return _scored(ran, result).drop("__code", "__m", "__x")


register(
    Task(
        "livecodebench",
        "id string, question_id string, question_title string, question_content string, starter_code string, platform string, difficulty string, contest_id string, contest_date string, public_test_cases string, private_test_cases string, metadata string, source_repo string, source_subset string, source_split string",
        _program_samples,
        lambda: filled("id", "question_content"),
        lambda: P.program_task(F.col("question_content"), F.col("starter_code")),
        _program_score,
        lambda records, options: M.binary_metrics(records, n=options.get("n"), ks=options.get("pass_k_values"), parsed=parsed("had_code").cast("boolean"), group=from_meta("platform")),
        "pass@1",
        CODE,
    )
)

#: The sizes that count as easy.
EASY = ("2*2", "2*3", "2*4", "2*5", "2*6", "3*2", "3*3")


def _puzzle_samples(rows: DataFrame) -> DataFrame:
    columns = F.transform(F.slice("solution.header", F.lit(2), F.greatest(F.size("solution.header") - 1, F.lit(0))), strip)
    table = F.map_from_entries(F.transform("solution.rows", lambda row, i: F.struct(F.concat(F.lit("House "), (i + 1).cast("string")).alias("k"), F.map_from_arrays(columns, F.transform(F.slice(row, F.lit(2), F.size(columns)), strip)).alias("v"))))
    own = rows.withColumn("difficulty", F.when(strip(F.col("size")).isin(*EASY), "easy").otherwise("hard"))
    return own.select(strip(F.col("id")).alias("sample_id"), F.to_json(table).alias("gold"), meta("difficulty", "size", "source_dataset").alias("meta"), strip(F.col("puzzle")).alias("puzzle"), columns.alias("columns"), F.size("solution.rows").alias("houses"), (F.size("solution.rows") * F.size(columns)).alias("total_cells"))


def _puzzle_rules() -> Rules:
    header, rows = F.col("solution.header"), F.col("solution.rows")
    return filled("id", "size", "puzzle") | {
        "solution.header is too short": F.size(header) >= 2,
        "solution.header does not begin with House": F.lower(strip(F.get(header, F.lit(0)))) == "house",
        "solution.rows is empty": F.size(rows) > 0,
        "a solution row is too short": F.forall(rows, lambda r: F.size(r) >= F.size(header)),
        "a solution cell is empty": F.forall(rows, lambda r: F.forall(r, lambda x: strip(x) != "")),
    }


def _puzzle_metrics(records: DataFrame, options: dict) -> DataFrame:
    own = records.select("sample_id", "gen_idx", "score", F.coalesce(parsed("cell_accuracy").cast("double"), F.lit(0.0)).alias("cell_accuracy"), F.coalesce(parsed("parsed").cast("double"), F.lit(0.0)).alias("parsed"), from_meta("difficulty").alias("difficulty"))
    return M.grid_metrics(own, F.col("difficulty"))


register(
    Task(
        "zebralogic",
        "id string, size string, puzzle string, solution struct<header:array<string>,rows:array<array<string>>>, created_at string, source_dataset string, subset string",
        _puzzle_samples,
        _puzzle_rules,
        lambda: P.user(P.puzzle(F.col("puzzle"), F.col("columns"), F.col("houses"))),
        lambda rows: _scored(rows, X.grid_score_udf("generation", "gold", "total_cells")),
        _puzzle_metrics,
        "puzzle_accuracy",
        GREEDY,
    )
)
