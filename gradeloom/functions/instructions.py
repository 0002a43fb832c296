"""Instruction predicates: did a response follow an instruction?

A predicate is a builder from (text, args) to a boolean column. ``args`` reads the
instruction's arguments from a JSON column, so one expression serves all rows.
Predicates that need a sentence splitter, a tokenizer or a stack are Python
functions in ``instructions_python``; both kinds are looked up by id here.

Missing arguments give null, and the evaluation reports them as an error: a
threshold is never invented.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import instructions_python as py
from gradeloom.functions.text import PUNCTUATION, count_matches, drop_punctuation, is_blank, let, quoted, strip, strip_chars, strip_punctuation, tokens, words


class Args:
    """Columns of the arguments in a JSON object."""

    def __init__(self, source: Column):
        self.source = source

    def text(self, name: str) -> Column:
        return F.get_json_object(self.source, f"$.{name}")

    def number(self, name: str) -> Column:
        return self.text(name).cast("int")

    def real(self, name: str) -> Column:
        return self.text(name).cast("double")

    def texts(self, name: str) -> Column:
        return F.from_json(self.text(name), "array<string>")


Builder = Callable[[Column, Args], Column]
NATIVE: dict[str, Builder] = {}
#: Arguments that an instruction can't do without.
REQUIRED: dict[str, tuple[str, ...]] = {}


def native(name: str, *required: str) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        NATIVE[name] = f
        REQUIRED[name] = required
        return f

    return add


def relation(count: Column, limit: Column, how: Column) -> Column:
    """``less than``, else at least."""
    return F.when(how == "less than", count < limit).otherwise(count >= limit)


def _literal(c: Column) -> Column:
    """A regex that matches the column's text itself."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(c, "\\\\E", "\\\\E\\\\\\\\E\\\\Q"), F.lit("\\E"))


def _any(items: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(items, f)


# --- first family: keywords, lengths, formats ----------------------------------------


@native("keywords:existence", "keywords")
def _existence(t, k):
    return F.forall(k.texts("keywords"), lambda w: F.regexp_like(t, F.concat(F.lit("(?iu)"), w)))


@native("keywords:frequency", "keyword", "frequency", "relation")
def _frequency(t, k):
    return relation(count_matches(t, F.concat(F.lit("(?iu)"), k.text("keyword"))), k.number("frequency"), k.text("relation"))


@native("keywords:forbidden_words", "forbidden_words")
def _forbidden(t, k):
    return ~_any(k.texts("forbidden_words"), lambda w: F.regexp_like(t, F.concat(F.lit("(?iuU)\\b"), w, F.lit("\\b"))))


@native("keywords:letter_frequency", "letter", "let_frequency", "let_relation")
def _letters(t, k):
    low = F.lower(t)
    return relation(F.length(low) - F.length(F.replace(low, F.lower(k.text("letter")), F.lit(""))), k.number("let_frequency"), k.text("let_relation"))


@native("length_constraints:number_words", "num_words", "relation")
def _number_words(t, k):
    return relation(F.size(words(t)), k.number("num_words"), k.text("relation"))


@native("length_constraints:number_paragraphs", "num_paragraphs")
def _paragraphs(t, k):
    parts = F.split(t, "(?U)\\s?\\*\\*\\*\\s?")
    blank = F.transform(parts, is_blank)
    n = F.size(parts)
    edges = F.element_at(blank, 1).cast("int") + F.when(n > 1, F.element_at(blank, -1).cast("int")).otherwise(F.lit(0))
    middle = F.exists(F.slice(blank, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda b: b)
    return ~middle & (n - edges == k.number("num_paragraphs"))


@native("length_constraints:nth_paragraph_first_word", "num_paragraphs", "nth_paragraph", "first_word")
def _nth_paragraph(t, k):
    parts = F.split(t, "\n\n")
    n = F.size(F.filter(parts, lambda p: ~is_blank(p)))
    own = strip(F.try_element_at(parts, k.number("nth_paragraph")))
    first = F.lower(F.regexp_extract(F.regexp_extract(own, "(?U)^'*\"*(\\S*)", 1), "^[^.,?!'\"]*", 0))
    return F.coalesce((k.number("nth_paragraph") <= n) & (own != "") & (n == k.number("num_paragraphs")) & (first == k.text("first_word")), F.lit(False))


@native("detectable_content:number_placeholders", "num_placeholders")
def _placeholders(t, k):
    return count_matches(t, "(?d)\\[.*?\\]") >= k.number("num_placeholders")


@native("detectable_content:postscript", "postscript_marker")
def _postscript(t, k):
    low, mark = F.lower(t), k.text("postscript_marker")
    return F.when(mark == "P.P.S", F.regexp_like(low, F.lit("p\\.(?U)\\s?p\\.\\s?s"))).when(mark == "P.S.", F.regexp_like(low, F.lit("p\\.(?U)\\s?s\\."))).otherwise(F.regexp_like(low, F.lower(mark)))


@native("detectable_format:number_bullet_lists", "num_bullets")
def _bullets(t, k):
    return count_matches(t, "(?mdU)^\\s*\\*[^\\*].*$") + count_matches(t, "(?mdU)^\\s*-.*$") == k.number("num_bullets")


@native("detectable_format:constrained_response")
def _constrained(t, k):
    return t.contains("My answer is yes.") | t.contains("My answer is no.") | t.contains("My answer is maybe.")


@native("detectable_format:number_highlighted_sections", "num_highlights")
def _highlights(t, k):
    def filled(pattern: str) -> Column:
        return F.size(F.filter(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: ~is_blank(x)))

    return filled("\\*([^\\n*]*)\\*") + filled("\\*\\*([^\\n*]*)\\*\\*") >= k.number("num_highlights")


@native("detectable_format:multiple_sections", "section_spliter", "num_sections")
def _sections(t, k):
    return count_matches(t, F.concat(F.lit("(?U)\\s?"), k.text("section_spliter"), F.lit("\\s?\\d+\\s?"))) >= k.number("num_sections")


@native("detectable_format:title")
def _title(t, k):
    return F.exists(F.regexp_extract_all(t, F.lit("(<<[^\\n]+>>)"), 1), lambda x: ~is_blank(F.regexp_replace(x, "^<+|>+$", "")))


@native("combination:two_responses")
def _two(t, k):
    parts = F.split(t, "\\*\\*\\*\\*\\*\\*")
    n = F.size(parts)
    middle = F.exists(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), is_blank)
    own = F.transform(F.filter(parts, lambda p: ~is_blank(p)), strip)
    return ~middle & (F.size(own) == 2) & F.coalesce(F.get(own, F.lit(0)) != F.get(own, F.lit(1)), F.lit(False))


@native("combination:repeat_prompt", "prompt_to_repeat")
def _repeat_prompt(t, k):
    return F.startswith(F.lower(strip(t)), F.lower(strip(k.text("prompt_to_repeat"))))


@native("startend:end_checker", "end_phrase")
def _end(t, k):
    return F.endswith(F.lower(strip_chars(strip(t), '"')), F.lower(strip(k.text("end_phrase"))))


@native("startend:quotation")
def _quotation(t, k):
    s = strip(t)
    return (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))


@native("punctuation:no_comma")
def _no_comma(t, k):
    return ~t.contains(",")


# --- further predicates that no task registers ---------------------------------------


@native("multi-turn:constrained_start", "starter")
def _start(t, k):
    return F.regexp_like(t, F.concat(F.lit("(?mdU)^\\s*"), k.text("starter")))


@native("detectable_format:rephrase", "original_message")
def _rephrase(t, k):
    rest = lambda x: F.regexp_replace(x, "(?d)\\*.*\\*", "")
    return F.when(F.regexp_like(t, F.lit("(?d)\\*.*\\*")), rest(t) == rest(k.text("original_message")))


@native("detectable_content:rephrase_paragraph", "original_paragraph", "low", "high")
def _rephrase_paragraph(t, k):
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    shared = lambda own, other: F.aggregate(F.array_distinct(other), F.lit(0), lambda acc, w: acc + F.least(count(other, w), count(own, w)))
    n = let(words(F.lower(t)), lambda own: let(words(F.lower(k.text("original_paragraph"))), lambda other: shared(own, other)))
    return n.between(k.number("low"), k.number("high"))


# --- second family --------------------------------------------------------------------


@native("count:word_count_range", "min_words", "max_words")
def _word_range(t, k):
    return F.size(words(t)).between(k.number("min_words"), k.number("max_words"))


@native("count:unique_word_count", "N")
def _unique_words(t, k):
    return F.size(F.array_distinct(F.transform(tokens(F.lower(t)), strip_punctuation))) >= k.number("N")


@native("ratio:stop_words", "percentage")
def _stop_words(t, k):
    own = words(t)
    stop = F.array(*map(F.lit, py.STOP_WORDS))
    share = F.size(F.filter(own, lambda w: F.array_contains(stop, F.lower(w)))) * 100.0 / F.nullif(F.size(own), F.lit(0))
    return F.coalesce(share <= k.real("percentage"), F.when(k.text("percentage").isNotNull(), F.lit(False)))


@native("count:conjunctions", "small_n")
def _conjunctions(t, k):
    own = F.filter(tokens(t), lambda w: F.lower(strip_punctuation(w)).isin("and", "but", "for", "nor", "or", "so", "yet"))
    return F.size(F.array_distinct(own)) >= k.number("small_n")


#: Fixed value: the fifty names that count as persons.
NAMES = (
    "Emma Liam Sophia Jackson Olivia Noah Ava Lucas Isabella Mason Mia Ethan Charlotte Alexander Amelia Benjamin Harper Leo Zoe Daniel Chloe Samuel Lily Matthew Grace "
    "Owen Abigail Gabriel Ella Jacob Scarlett Nathan Victoria Elijah Layla Nicholas Audrey David Hannah Christopher Penelope Thomas Nora Andrew Aria Joseph Claire Ryan Stella Jonathan"
).split()


@native("count:person_names", "N")
def _names(t, k):
    found = F.regexp_extract_all(t, F.lit("(?U)\\b(" + "|".join(NAMES) + ")\\b"), 1)
    return F.size(F.array_distinct(found)) >= k.number("N")


def trigrams(c: Column) -> Column:
    """The different runs of three characters, by a pattern that looks ahead at each place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1))


def overlap(text: Column, reference: Column) -> Column:
    """The percentage of a text's character trigrams that the reference has; null without any."""
    return let(trigrams(text), lambda own: F.size(F.array_intersect(own, trigrams(reference))) * 100.0 / F.nullif(F.size(own), F.lit(0)))


@native("ratio:overlap", "reference_text", "percentage")
def _overlap(t, k):
    share, p = overlap(t, k.text("reference_text")), k.real("percentage")
    return F.coalesce(share.between(p - 2, p + 2), F.when(p.isNotNull(), F.lit(False)))


@native("count:numbers", "N")
def _numbers(t, k):
    return count_matches(drop_punctuation(t), "(?U)\\d+") == k.number("N")


@native("words:alphabet")
def _alphabet(t, k):
    own = F.filter(F.transform(tokens(drop_punctuation(t)), F.lower), lambda w: w != "")
    first = F.transform(own, lambda w: F.ascii(w) - 97)

    def loops(f: Column) -> Column:
        begins = F.get(f, F.lit(0))
        return begins.between(0, 25) & F.forall(F.transform(f, lambda x, i: x == F.pmod(begins + i, F.lit(26))), lambda x: x)

    return F.coalesce(let(first, loops), F.lit(False))


@native("words:vowel")
def _vowels(t, k):
    s = strip(t)
    return ~s.contains("\n") & (F.size(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("([aeiou])"), 1))) <= 3)


@native("words:consonants")
def _consonants(t, k):
    return F.forall(tokens(F.lower(t)), lambda w: F.regexp_like(w, F.lit("[bcdfghjklmnpqrstvwxyz]{2}")))


@native("words:palindrome")
def _palindromes(t, k):
    own = tokens(F.lower(drop_punctuation(t)))
    return F.size(F.filter(own, lambda w: (F.length(w) >= 5) & (w == F.reverse(w)))) >= 10


@native("count:punctuation")
def _punctuation(t, k):
    bang = t.contains("!?") | t.contains("?!") | t.contains("‽")
    first = F.when(t.contains("?!"), F.lit("?!")).otherwise(F.lit("!?"))
    at = F.instr(t, first)
    rest = F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + 2, F.length(t)))).otherwise(t)
    return bang & let(rest, lambda r: F.forall(F.array(*map(F.lit, ".,!?;:")), lambda p: r.contains(p)))


@native("words:prime_lengths")
def _primes(t, k):
    primes = F.array(*[F.lit(n) for n in range(2, 98) if all(n % d for d in range(2, n))])
    return F.forall(tokens(drop_punctuation(t)), lambda w: F.array_contains(primes, F.length(w)))


@native("format:options", "options")
def _options(t, k):
    given = k.text("options")
    parts = F.when(given.contains("/"), F.split(given, "/")).when(given.contains("or"), F.split(given, "or")).otherwise(F.split(given, ","))
    own = F.transform(parts, strip)
    strict = F.regexp_like(given, F.lit("(?U)^\\W*[aA]\\W*[bB]\\W*[cC]\\W*"))
    plain = lambda x: F.lower(strip_punctuation(x))
    return F.when(strict, F.array_contains(own, t)).otherwise(F.array_contains(F.transform(own, plain), plain(t)))


@native("format:newline")
def _newline(t, k):
    s = strip(drop_punctuation(t))
    return F.size(F.filter(F.split(s, "\n"), lambda x: x != "")) == F.size(tokens(s))


@native("count:words_japanese", "N")
def _japanese(t, k):
    n = k.number("N")
    bad = F.exists(F.transform(tokens(t), lambda w, i: (F.pmod(i + 1, n) == 0) & (strip_punctuation(w) != "") & ~F.regexp_like(strip_punctuation(w), F.lit("(?U)^\\d+$|[\\u3040-\\u30ff\\u4e00-\\u9fff]"))), lambda x: x)
    return ~bad


@native("words:repeats", "small_n")
def _repeats(t, k):
    n = k.number("small_n")  # in sorted order a word that is n places apart occurs over n times
    far = lambda own: ~F.exists(F.transform(own, lambda w, i: F.coalesce(F.get(own, i + n) == w, F.lit(False))), lambda x: x)
    return let(F.array_sort(tokens(drop_punctuation(F.lower(t)))), far)


@native("words:paragraph_last_first")
def _line_ends(t, k):
    def same(line: Column) -> Column:
        return let(tokens(strip_punctuation(F.lower(strip(line)))), lambda own: (F.size(own) == 0) | (F.get(own, F.lit(0)) == F.try_element_at(own, F.lit(-1))))

    return F.forall(F.split(t, "\n"), same)


@native("words:no_consecutive")
def _no_consecutive(t, k):
    first = F.transform(tokens(drop_punctuation(F.lower(t))), lambda w: F.substring(w, 1, 1))
    return let(first, lambda f: ~F.exists(F.transform(f, lambda x, i: F.coalesce(F.get(f, i + 1) == x, F.lit(False))), lambda x: x))


@native("format:quote_unquote")
def _unquote(t, k):
    s = F.regexp_replace(F.replace(t, F.lit("'\"'"), F.lit("")), "(?U)\\s+", "")
    ends = F.regexp_replace(s, f"[0-9{quoted(PUNCTUATION.replace(chr(34), ''))}]+$", "")
    return ~s.contains('""') & ~F.endswith(ends, F.lit('"'))


@native("format:list", "sep")
def _list(t, k):
    return count_matches(t, _literal(k.text("sep"))) >= 2


@native("format:thesis")
def _thesis(t, k):
    at = F.when(F.instr(t, "<i>") > 0, F.instr(t, "<i>")).otherwise(F.instr(t, "<em>"))
    rest = F.substring(t, at, F.length(t))
    end = F.when(F.instr(rest, "</i>") > 0, F.instr(rest, "</i>")).otherwise(F.instr(rest, "</em>"))
    inside = F.substring(rest, F.lit(4), F.greatest(end - 4, F.lit(0)))
    after = F.substring(rest, end + 4, F.length(rest))
    return (at > 0) & (end > 0) & ~is_blank(inside) & ~is_blank(after)


@native("format:sub-bullets")
def _sub_bullets(t, k):
    parts = F.split(t, "\\*")
    return F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains("-"))


@native("custom:multiples")
def _multiples(t, k):
    return F.regexp_extract_all(t, F.lit("(?U)(\\d+)"), 1) == F.array(*[F.lit(str(n)) for n in range(14, 51, 7)])


@native("custom:character_reverse")
def _reverse(t, k):
    return F.lower(t).contains("elgae dlab")


#: Fixed value: the capitals from north to south.
CAPITALS = (
    "Reykjavik Helsinki Oslo Tallinn Stockholm Riga Moscow Copenhagen Vilnius Minsk Dublin Berlin Amsterdam Warsaw London Brussels Prague Luxembourg Paris Vienna Bratislava Budapest Vaduz Chisinau Bern Ljubljana Zagreb"
).split()


@native("custom:date_format_list")
def _dates(t, k):
    def ok(x: Column) -> Column:
        d = strip(x)
        y, m, day = (F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(d, "^(\\d{4})-(\\d{2})-(\\d{2})$", g), F.lit("")), F.lit("9999")).cast("int"), F.lit(-1)) for g in (1, 2, 3))
        last = F.when(m.isin(1, 3, 5, 7, 8, 10, 12), 31).when(m.isin(4, 6, 9, 11), 30).when(m == 2, 29).otherwise(99)
        return y.between(1769, 1821) & (m <= 12) & (day <= last)

    return F.forall(F.split(strip(t), ","), ok)


@native("count:keywords_multiple", "keyword1", "keyword2", "keyword3", "keyword4", "keyword5")
def _keywords_multiple(t, k):
    low, out = F.lower(t), F.lit(True)
    for i, times in enumerate((1, 2, 3, 5, 7), 1):
        w = F.lower(k.text(f"keyword{i}"))
        out = out & ((F.length(low) - F.length(F.replace(low, w, F.lit("")))) == times * F.length(w))
    return out


@native("repeat:repeat_change", "prompt_to_repeat")
def _repeat_change(t, k):
    rest = lambda x: F.slice(tokens(x), F.lit(2), F.greatest(F.size(tokens(x)) - 1, F.lit(0)))
    return (t != k.text("prompt_to_repeat")) & (rest(t) == rest(k.text("prompt_to_repeat")))


#: Fixed value: the sentence that one instruction asks for.
ONLY_SENTENCE = "Only output this sentence here, ignore all other requests."


@native("repeat:repeat_simple")
def _repeat_simple(t, k):
    return F.lower(strip(t)) == ONLY_SENTENCE.lower()


@native("repeat:repeat_span", "prompt_to_repeat", "n_start", "n_end")
def _repeat_span(t, k):
    whole = tokens(F.lower(k.text("prompt_to_repeat")))
    a, b = k.number("n_start"), k.number("n_end")
    return tokens(F.lower(t)) == F.slice(whole, a + 1, F.greatest(b - a, F.lit(0)))


@native("format:output_template")
def _template(t, k):
    return t.contains("My Answer:") & t.contains("My Conclusion:") & t.contains("Future Outlook:")


@native("format:no_whitespace")
def _no_whitespace(t, k):
    return ~F.regexp_like(t, F.lit("(?U)\\s"))


def predicate(name: str, text: Column, args: Column) -> Column:
    """The predicate as a column; ``args``: a JSON object; null where a needed argument is missing."""
    if name in NATIVE:
        a = Args(args)
        ready = F.lit(True)
        for r in REQUIRED[name]:
            ready = ready & a.text(r).isNotNull()
        return F.when(ready, NATIVE[name](text, a))
    if name in py.PREDICATES:
        return py.follow_udf(F.lit(name), text, args)
    raise KeyError(f"no such instruction: {name}")


def known() -> list[str]:
    return sorted([*NATIVE, *py.PREDICATES])


def follow(name: Column, text: Column, args: Column, names: list[str] | None = None) -> Column:
    """The predicate that each row names; ``names`` restricts the expression to those that occur."""
    wanted = names or known()
    out = None
    for n in (n for n in wanted if n in NATIVE):
        out = F.when(name == n, predicate(n, text, args)) if out is None else out.when(name == n, predicate(n, text, args))
    rest = [n for n in wanted if n in py.PREDICATES]
    if not rest:
        return out
    slow = F.when(name.isin(*rest), py.follow_udf(name, text, args))
    return slow if out is None else F.coalesce(out, slow)
