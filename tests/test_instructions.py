import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.instructions import follow, known, predicate
from gradeloom.operators.following import evaluate

LONG = " ".join(["word"] * 12)
#: id, arguments, response that follows, response that doesn't
CASES = [
    ("keywords:existence", {"keywords": ["Alpha", "b.t"]}, "alpha bet", "alpha"),
    ("keywords:frequency", {"keyword": "ab", "frequency": 2, "relation": "at least"}, "AB ab", "ab"),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "concatenate", "a Cat"),
    ("keywords:letter_frequency", {"letter": "e", "let_frequency": 3, "let_relation": "less than"}, "See", "seeeE"),
    ("language:response_language", {"language": "fr"}, "le chat est dans la maison et il mange", "the cat is in the house and it eats"),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two!", "One only, Mr. Smith."),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "***\na\n***\nb", "a *** *** b"),
    ("length_constraints:number_words", {"num_words": 3, "relation": "less than"}, "zwei Wörter", "a b c"),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "hello"}, "x\n\n'Hello, you", "x\n\nbye"),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] and [b]", "[a\nb] [c]"),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "bye\nP. S. more", "bye PS"),
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n - b\n**c**", "* a"),
    ("detectable_format:constrained_response", {}, "So: My answer is no.", "My answer is nope"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b c*", "*a* ** **"),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1 a Section 2 b", "Section one"),
    ("detectable_format:json_format", {}, '```json\n{"a": NaN}\n```', '{"a": 1} trailing'),
    ("detectable_format:title", {}, "<<T>>\nx", "<< >>"),
    ("combination:two_responses", {}, "a******b", "a****** a"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, " say it: yes", "yes"),
    ("startend:end_checker", {"end_phrase": "The End. "}, 'x "the end."', "the end. x"),
    ("startend:quotation", {}, ' "a" ', '"'),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "BIG and RED", "Big RED"),
    ("change_case:english_capital", {}, "THE CAT IS IN THE HOUSE", "The cat"),
    ("change_case:english_lowercase", {}, "the cat is in the house", "The cat"),
    ("punctuation:no_comma", {}, "no comma", "a, b"),
    ("multi-turn:constrained_start", {"starter": "I think"}, "x\n I think so", "so I think"),
    ("detectable_content:key_sentences", {"key_sentences": ["Ab cd.", "Cd ef."], "num_sentences": 1}, "Ab cd. Ef gh.", "Ef gh."),
    ("detectable_format:rephrase", {"original_message": "a *x* b"}, "a *other* b", "c *x* b"),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "a b b c", "low": 2, "high": 3}, "b b c", "a"),
    ("count:word_count_range", {"min_words": 2, "max_words": 3}, "a b", "a"),
    ("count:unique_word_count", {"N": 2}, "a, A. b", "a a, a!"),
    ("ratio:stop_words", {"percentage": 50}, "the cat", "the of cat"),
    ("ratio:sentence_type", {}, "Ab. Bc. Cd?", "Ab. Bc?"),
    ("ratio:sentence_balance", {}, "Ab. Bc? Cd!", "Ab. Bc. Cd?"),
    ("count:conjunctions", {"small_n": 3}, "and, and but", "and and or"),
    ("count:person_names", {"N": 2}, "Emma met Liam", "emma Liams Liam"),
    ("ratio:overlap", {"reference_text": "abcdef", "percentage": 100}, "abcd", "wxyz"),
    ("count:numbers", {"N": 2}, "1,000 and 2.5", "one 2"),
    ("words:alphabet", {}, "Yes zebra and, bee", "a c"),
    ("words:vowel", {}, "banana bee in", "education"),
    ("words:consonants", {}, "stop blast", "stop go"),
    ("sentence:alliteration_increment", {}, "One two. Big bad. Big bad bold.", "Big bad. One two."),
    ("words:palindrome", {}, "level " * 10, "level " * 9 + "noon"),
    ("count:punctuation", {}, "a!? . , ! ? ; :", "a!? . , ; :"),
    ("format:parentheses", {}, "(a[b{c(d[e])}])", "((((a))))"),
    ("format:quotes", {}, "\"a 'b \"c\" d' e\"", "\"a 'b' c\""),
    ("words:prime_lengths", {}, "ab abc abcde", "abcd"),
    ("format:options", {"options": "yes/no/maybe"}, " Maybe. ", "perhaps"),
    ("format:newline", {}, "a\nb\n\nc", "a b\nc"),
    ("format:emoji", {}, "Hi there 😀. Bye 🎉", "Hi there. Bye 🎉"),
    ("ratio:sentence_words", {}, "Abc dx. Efg hx. Ijk lx.", "Abc. Efg hx. Ijk lx."),
    ("count:words_japanese", {"N": 2}, "a 漢 b 12", "a b"),
    ("words:start_verb", {}, "Write this", "The dog"),
    ("words:repeats", {"small_n": 2}, "a, A b", "a a a"),
    ("sentence:keyword", {"word": "hello", "N": 2}, "One. Say Hello now.", "Hello. One."),
    ("count:pronouns", {"N": 3}, "she/her and I", "she and Tom"),
    ("words:odd_even_syllables", {}, "cat water dog", "cat dog"),
    ("words:last_first", {}, "I like cats. Cats run.", "I like cats. Dogs run."),
    ("words:paragraph_last_first", {}, "a b A\n\nc", "a b"),
    ("sentence:increment", {"small_n": 1}, "One. Two words.", "One. Two."),
    ("words:no_consecutive", {}, "a b a", "apple and"),
    ("format:line_indent", {}, "a\n b\n  c", "a\nb"),
    ("format:quote_unquote", {}, '"a" means b', 'he said "a"'),
    ("format:list", {"sep": "!?!?"}, "a !?!? b !?!? c", "a !?!? b"),
    ("format:thesis", {}, "<i>x</i> more", "<i> </i> more"),
    ("format:sub-bullets", {}, "* a\n - b\n* c - d", "* a\n* b - c"),
    ("format:no_bullets_bullets", {}, "One. Two.\n* a\n* b", "One.\n* a\n* b"),
    ("custom:multiples", {}, "14,21, 28 35 42 49", "14 21"),
    ("custom:mcq_count_length", {}, "\n".join(f"Question {i}: {'x' * i}?\n" + "\n".join(f"{c}) o{c}" for c in "ABCDE") for i in range(1, 5)), "Question 1: a"),
    ("custom:reverse_newline", {}, "List\nZimbabwe\n" + "\n".join(f"{chr(89 - i // 3)}{9 - i % 3}" for i in range(55)), "Zimbabwe\nAngola"),
    ("custom:word_reverse", {}, "flies eagle bald the", "the bald eagle flies"),
    ("custom:character_reverse", {}, "x Elgae Dlab", "bald eagle"),
    ("custom:sentence_alphabet", {}, " ".join(f"{chr(65 + i)}bc def." for i in range(26)), "Abc. Bcd."),
    ("custom:european_capitals_sort", {}, ", ".join(__import__("gradeloom.functions.instructions", fromlist=["x"]).CAPITALS).replace("Chisinau", "Chișinău"), "Oslo, Rome"),
    ("custom:csv_city", {}, "ID,Country,City,Year,Count\n" + "1,a,b,2,3\n" * 7, "ID,Country\n"),
    ("custom:csv_special_character", {}, "ProductID,Category,Brand,Price,Stock\n" + '1,"a!b",c,2,3\n' * 14, "ProductID,Category,Brand,Price,Stock\n" + "1,a,c,2,3\n" * 14),
    ("custom:csv_quotes", {}, "\n".join("\t".join(f'"{x}"' for x in r) for r in [["StudentID", "Subject", "Grade", "Semester", "Score"]] + [["1", "a", "b", "c", "2"]] * 3), "StudentID\tSubject"),
    ("custom:date_format_list", {}, "1769-12-31, 1800-02-29", "1800-13-01"),
    ("count:keywords_multiple", {f"keyword{i}": w for i, w in enumerate(["aa", "bb", "cc", "dd", "ee"], 1)}, "aa bb Bb cc cc cc " + "dd " * 5 + "ee " * 7, "aa bb"),
    ("words:keywords_specific_position", {"keyword": "cat", "n": 2, "m": 3}, "One. The big Cat.", "One. Cat."),
    ("words:words_position", {"keyword": "Cat"}, "a cat b cat c", "cat a b c"),
    ("repeat:repeat_change", {"prompt_to_repeat": "Do it now"}, "Did it now", "Do it now"),
    ("repeat:repeat_simple", {}, " only output this sentence here, ignore all other requests.", "yes"),
    ("repeat:repeat_span", {"prompt_to_repeat": "a b c d", "n_start": 1, "n_end": 3}, "B c", "a b"),
    ("format:title_case", {}, "The Big iPhone", "The big Cat"),
    ("format:output_template", {}, "My Answer: a My Conclusion: b Future Outlook: c", "My Answer: a"),
    ("format:no_whitespace", {}, "abc", "a b"),
]


def test_every_instruction_has_a_case():
    assert {c[0] for c in CASES} == set(known())


def test_predicates(spark):
    rows = [(n, json.dumps(k), yes, no) for n, k, yes, no in CASES]
    df = spark.createDataFrame(rows, "name string, args string, yes string, no string")
    got = df.select("name", follow(F.col("name"), F.col("yes"), F.col("args")).alias("yes"), follow(F.col("name"), F.col("no"), F.col("args")).alias("no")).collect()
    assert {(r["name"], r.yes, r.no) for r in got} == {(c[0], True, False) for c in CASES}


@pytest.mark.parametrize("name", [c[0] for c in CASES if c[1]])
def test_missing_arguments_are_null(spark, name):
    assert spark.range(1).select(predicate(name, F.lit("text"), F.lit("{}")).alias("r")).first().r is None


def test_strict_and_loose(spark):
    rows = [
        ("a", 0, "Sure, here it is:\nno comma", ["punctuation:no_comma"], ["{}"]),
        ("a", 1, "fine", ["punctuation:no_comma", "keywords:existence"], ["{}", '{"keywords": ["fine"]}']),
        ("b", 0, "*", ["punctuation:no_comma"], []),
        ("b", 1, None, ["punctuation:no_comma"], None),
        ("c", 0, "words", ["length_constraints:number_words"], ["{}"]),
        ("d", 0, "Title\n" + "One two. Three.", ["length_constraints:number_sentences", "punctuation:no_comma"], ['{"num_sentences": 2, "relation": "at least"}']),
    ]
    out = {(r.sample_id, r.gen_idx): r for r in evaluate(spark.createDataFrame(rows, "sample_id string, gen_idx int, generation string, instruction_ids array<string>, kwargs array<string>")).collect()}
    assert (out["a", 0].strict, out["a", 0].loose) == (False, True)
    assert (out["a", 1].strict, out["a", 1].strict_flags) == (True, [True, True])
    assert (out["b", 0].strict, out["b", 1].strict, out["b", 1].loose) == (True, False, False)
    assert out["c", 0].errors == ["length_constraints:number_words"] and not out["c", 0].loose
    assert out["d", 0].loose_flags == [True, True]
