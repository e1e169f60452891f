"""Scalar functions over answers and predictions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a chat message, and the answer's prefix.
CUT_MARKS = r"<\|im_end\|>|<\|end_of_text\|>"
ANSWER = r"(?d)Answer: (.*)\.?"
DONT_KNOW = "i don't know"
#: Patterns of numbers in answers.
NUMBER, MARKED_NUMBER = r"(-?[0-9.,]+)", r"#### (-?[0-9.,]+)"


def extract_answer(full: Column) -> Column:
    """What stands before the first cut mark, without one final dot, and of that what follows the first `Answer: ` in its line; null if there is none."""
    head = F.split(full, CUT_MARKS, 2)[0]
    head = F.when(head.endswith("."), F.substring(head, F.lit(1), F.char_length(head) - 1)).otherwise(head)
    return F.when(head.rlike(ANSWER), F.regexp_extract(head, ANSWER, 1))


def exact_match(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)).cast("int")


def inclusion_match(a: Column, b: Column) -> Column:
    """Whether one contains the other, whatever the case; the empty text is in every text."""
    a, b = F.lower(a), F.lower(b)
    return (F.contains(a, b) | F.contains(b, a)).cast("int")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words, both as lower-case sets; null without any word."""
    a, b = word_set(a), word_set(b)
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def dont_know(prediction: Column) -> Column:
    return F.startswith(F.lower(prediction), F.lit(DONT_KNOW))


def reached_max(prediction: Column, full: Column, pad: str) -> Column:
    """No prediction, and the output does not begin with the padding pattern."""
    return (F.coalesce(prediction, F.lit("")) == "") & ~full.rlike(f"^(?:{pad})")


def fix_judge(full_answer: Column) -> Column:
    return F.when(F.startswith(F.lower(full_answer), F.lit("yes")), "yes").otherwise("no")


def model_name(path: Column) -> Column:
    """A file's base name without .json and _model, underscores as spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.json$", ""), "_model", ""), "_", " ")


def last_number(text: Column) -> Column:
    """The last number of a text as it stands there, with its commas; null if there is none. A single dot is a number only where nothing else is."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: x != "."), F.lit(-1)), F.try_element_at(found, F.lit(1)))


def marked_number(text: Column) -> Column:
    """The number after the first ####, without commas and dollar signs; null if there is none."""
    return F.nullif(F.translate(F.regexp_extract(text, MARKED_NUMBER, 1), ",$", ""), F.lit(""))


def list_text(raw: Column) -> Column:
    """`['a', 'b']` as `a, b`; any other text as it is."""
    parsed = F.from_json(F.translate(raw, "'", '"'), "array<string>")
    return F.when(raw.startswith("["), F.coalesce(F.array_join(parsed, ", "), raw)).otherwise(raw)


def reward(prediction: Column, truth: Column, n_triples: Column, reasoning: list[Column]) -> Column:
    """0 without triples; 0.1 for "don't know", 0.8 for an exact answer, else 0.8 times the word Jaccard; plus up to 0.1 for each reasoning term; 1 at most."""
    answer = F.when(dont_know(prediction), F.lit(0.1)).when(exact_match(prediction, truth) == 1, F.lit(0.8)).otherwise(0.8 * F.coalesce(word_jaccard(prediction, truth), F.lit(0.0)))
    total = answer
    for r in reasoning:
        total = total + F.least(F.coalesce(r, F.lit(0.0)), F.lit(0.1))
    return F.when(n_triples > 0, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))


def question_overlap(question: Column, triples: Column, weight: float = 0.1, aggregate: Callable[[Column], Column] = F.array_max, extract: Callable[[Column], Column] = lambda t: t) -> Column:
    """The word Jaccard of the question with what extract takes from each of the triples, as aggregate has it (the greatest), times weight; 0 without triples."""
    return F.coalesce(aggregate(F.transform(triples, lambda t: word_jaccard(question, extract(t)))), F.lit(0.0)) * weight


def utc_stamp(ts: Column) -> Column:
    """dd/mm/YYYY HH:MM:SS UTC of a timestamp, in a session whose zone is UTC."""
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss 'UTC'")


def same_run(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether two metadata structs agree in fields; nulls agree with nulls."""
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out


def chat(template: Column, question: Column | None = None) -> Column:
    """The prompt's messages, with the user's question as the last one if given. template: array of struct(role, content)."""
    if question is None:
        return template
    return F.concat(template, F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))))


def fill(template: str, **slots: Column) -> Column:
    """A template text with {slots} filled in."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def judge_prompt(question: Column, truth: Column, predicted: Column) -> Column:
    return fill("Question: {question}\nCorrect answer: {truth}\nPredicted answer: {predicted}\nIs the predicted answer correct? Answer yes or no.", question=question, truth=truth, predicted=predicted)
