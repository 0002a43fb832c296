"""Prompts as columns: chat messages, multiple-choice, code and puzzle layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import is_blank, strip

Choices = Column  # array<struct<letter, text>> in the order of the options


def user(content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def system_user(system: str, content: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def normalise(messages: Column) -> Column:
    """Blank roles become ``user``, null contents empty."""
    role = lambda m: F.coalesce(F.nullif(strip(F.coalesce(m.role, F.lit(""))), F.lit("")), F.lit("user"))
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), F.coalesce(m.content, F.lit("")).alias("content")))


def render(messages: Column) -> Column:
    """The plain rendering: a line ``role: content`` a message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n")


def letters_of(choices: Choices) -> Column:
    return F.transform(choices, lambda c: c.letter)


def lines(choices: Choices, layout: str) -> Column:
    """One line an option; ``layout`` has {letter} before {text}."""
    before, _, rest = layout.partition("{letter}")
    middle, _, after = rest.partition("{text}")
    return F.array_join(F.transform(choices, lambda c: F.concat(F.lit(before), c.letter, F.lit(middle), c.text, F.lit(after))), "\n")


def choice_sentence(question: Column, choices: Choices) -> Column:
    """Asks for a closing sentence with the letter in brackets."""
    block = F.array_join(F.transform(letters_of(choices), lambda x: F.concat(F.lit("("), x, F.lit(")"))), ", ")
    head = (
        "Answer the following multiple-choice question by giving the correct answer letter in parentheses. Provide CONCISE reasoning for the answer, and make sure to finish the "
        'response with "Therefore, the answer is (ANSWER_LETTER)" where (ANSWER_LETTER) is one of '
    )
    foot = 'Answer the above question and REMEMBER to finish your response with the exact phrase "Therefore, the answer is (ANSWER_LETTER)" where (ANSWER_LETTER) is one of '
    return F.concat(F.lit(head), block, F.lit(".\n\nQuestion: "), strip(question), F.lit("\n"), lines(choices, " ({letter}) {text}"), F.lit("\n\n" + foot), block, F.lit("."))


def choice_line(question: Column, choices: Choices) -> Column:
    """Asks for a last line ``Answer: $LETTER``."""
    head = "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of "
    return F.concat(F.lit(head), F.array_join(letters_of(choices), ", "), F.lit(". Think step by step before answering.\n\n"), strip(question), F.lit("\n\n"), lines(choices, "{letter}) {text}"))


def step_by_step(description: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", F.when(~is_blank(F.coalesce(description, F.lit(""))), strip(description)), F.concat(F.lit("Question: "), strip(question)), F.lit("Answer: Let's think step by step."))


CODER = "You are an expert Python programmer. "


def function_task(prompt: Column) -> Column:
    system = CODER + "You will be given a function specification and must return a correct completed Python function that passes all tests."
    form = "Provide a SHORT reasoning on how to solve the task, then return the completed function enclosed in a Python code block as:\n```python\n# YOUR CODE HERE\n```"
    return system_user(system, F.concat(F.lit("### Question:\n"), prompt, F.lit(f"\n\n### Format:\n{form}\n\n### Answer: (use the provided format with backticks)\n\n")))


def program_task(question: Column, starter: Column) -> Column:
    system = CODER + "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests."
    own = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n"
    free = (
        "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. "
        "Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.\n```python\n# YOUR CODE HERE\n```"
    )
    starter = F.coalesce(starter, F.lit(""))
    form = F.when(starter != "", F.concat(F.lit(own), starter, F.lit("\n```"))).otherwise(F.lit(free))
    head = F.concat(F.lit("### Question:\n"), question, F.lit("\n\n### Format:\nProvide CONCISE reasoning on how to arrive at the answer.\n"))
    return system_user(system, F.concat(head, form, F.lit("\n\n### Answer: (use the provided format with backticks)\n\n")))


#: Fixed value: the worked example before each puzzle.
PUZZLE_EXAMPLE = """
# Example Puzzle 

There are 3 houses, numbered 1 to 3 from left to right, as seen from across the street. Each house is occupied by a different person. Each house has a unique attribute for each of the following characteristics:
 - Each person has a unique name: `Peter`, `Eric`, `Arnold`.
 - Each person has a unique favorite drink: `tea`, `water`, `milk`

## Clues for the Example Puzzle

1. Peter is in the second house.
2. Arnold is directly left of the one who only drinks water.
3. The one who only drinks water is directly left of the person who likes milk.

## Answer to the Example Puzzle

{
    "reasoning": "Given Clue 1, we know Peter is in House 2. According to Clue 2, Arnold is directly left of the one who only drinks water. The person in House 3 cannot be on the left of anyone, so Arnold must be in House 1. Thus, Peter drinks water, and Eric lives in House 3. Then, according to Clue 3, Eric drinks milk. Therefore, Arnold drinks tea.",
    "solution": {
        "House 1": {
            "Name": "Arnold",
            "Drink": "tea"
        },
        "House 2": {
            "Name": "Peter",
            "Drink": "water"
        },
        "House 3": {
            "Name": "Eric",
            "Drink": "milk"
        }
    }
}

# Puzzle to Solve 

"""


def puzzle(text: Column, columns: Column, houses: Column) -> Column:
    """A puzzle with a JSON form to fill in: ``columns`` of each of ``houses`` houses."""
    quoted = lambda c: F.concat(F.lit(" " * 12 + '"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('": "___"'))
    cells = F.array_join(F.transform(columns, quoted), ",\n")
    house = lambda i: F.concat(F.lit(" " * 8 + '"House '), i.cast("string"), F.lit('": {\n'), cells, F.lit("\n" + " " * 8 + "}"))
    form = F.concat(F.lit('{\n    "reasoning": "___",\n    "solution": {\n'), F.array_join(F.transform(F.sequence(F.lit(1), houses), house), ",\n"), F.lit("\n    }\n}"))
    ask = "\n\n\n# Instruction\n\nNow please solve the above puzzle. Present your reasoning and solution in the following json format:\n\n"
    return F.concat(F.lit(PUZZLE_EXAMPLE), strip(text), F.lit(ask), form, F.lit("\n\n"))
