"""Question-answering datasets: adapters to one shape, exact samples, prompts, export rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Schemas of the sources, never inferred.
MINTAKA = "question string, answer struct<mention:string,answerType:string,answer:array<string>>, complexityType string, category string"
TWO_WIKI = "question string, answer string, type string"
WEB_QSP = (
    "Version string, FreebaseVersion string, Questions array<struct<RawQuestion:string,Parses:array<struct<Answers:array<struct<AnswerType:string,EntityName:string,AnswerArgument:string>>>>>>"
)


def mintaka(df: DataFrame) -> DataFrame:
    kind = F.concat(F.col("answer.answerType"), F.when(F.size("answer.answer") > 1, ",list").otherwise(""))
    return _shape(df, F.col("question"), F.col("answer.mention"), F.col("complexityType"), kind)


def two_wiki(df: DataFrame) -> DataFrame:
    return _shape(df, F.col("question"), F.col("answer"), F.col("type"), F.lit("unknown"))


def plain(df: DataFrame) -> DataFrame:
    return _shape(df, F.col("question"), F.col("answer"), F.lit("simple"), F.lit("unknown"))


def web_qsp(df: DataFrame) -> DataFrame:
    """Answers of all parses in order: entity names, or arguments that are values; their types, lower-cased and sorted, with `list` if there are several answers."""
    q = df.select(F.explode("Questions").alias("q"))
    answers = F.flatten(F.transform("q.Parses", lambda p: F.coalesce(p["Answers"], F.expr("cast(array() as array<struct<AnswerType:string,EntityName:string,AnswerArgument:string>>)"))))
    told = F.transform(answers, lambda a: F.when(a["AnswerType"] == "Entity", a["EntityName"]).otherwise(a["AnswerArgument"]))
    kinds = F.array_sort(F.array_distinct(F.transform(answers, lambda a: F.lower(a["AnswerType"]))))
    kind = F.array_join(F.when(F.size(answers) > 1, F.concat(kinds, F.array(F.lit("list")))).otherwise(kinds), ", ")
    return _shape(q, F.col("q.RawQuestion"), F.array_join(told, ", "), F.lit("simple"), kind)


def bi(df: DataFrame) -> DataFrame:
    """Columns `query_type:`, `question:` and `answer:`; lists in answers become `, `-joined."""
    raw = F.col("`answer:`")
    kind = F.when(raw.startswith("["), "list").otherwise("unknown")
    return _shape(df, F.col("`question:`"), T.list_text(raw), F.col("`query_type:`"), kind)


def _shape(df: DataFrame, question: Column, answer: Column, question_type: Column, answer_type: Column) -> DataFrame:
    idx = [F.col("idx")] if "idx" in df.columns else []
    return df.select(*idx, question.alias("question"), answer.alias("answer"), question_type.alias("question_type"), answer_type.alias("answer_type"))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"mintaka": mintaka, "2wiki": two_wiki, "webqsp": web_qsp, "bi": bi, "plain": plain}


def wrap_web_qsp(questions: DataFrame, version: str, freebase: str) -> DataFrame:
    """The source envelope again, one row: Version, FreebaseVersion, Questions. For exports of evaluation sets, which are small."""
    q = F.struct(F.col("question").alias("RawQuestion"), F.array(F.struct(F.array(F.struct(F.lit("Value").alias("AnswerType"), F.lit(None).cast("string").alias("EntityName"), F.col("answer").alias("AnswerArgument"))).alias("Answers"))).alias("Parses"))
    return questions.agg(F.lit(version).alias("Version"), F.lit(freebase).alias("FreebaseVersion"), F.collect_list(q).alias("Questions"))


def questions_only(qa: DataFrame) -> DataFrame:
    return qa.select("idx", "question")


def describe(qa: DataFrame, **attributes: str) -> DataFrame:
    """One row: how many questions there are, and the set's attributes as JSON, sorted by name."""
    told = json.dumps(attributes, sort_keys=True)
    return qa.agg(F.count("*").alias("n"), F.lit(told).alias("config"))


def start_from(qa: DataFrame, k: int, stop: int | None = None) -> DataFrame:
    rows = qa.where(F.col("idx") >= k)
    return rows if stop is None else rows.where(F.col("idx") < stop)


def lot(seed: int, key: Column) -> Column:
    """A portable random order: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: How many parts a stratum's lots are counted in, and a lot's rows by their contents, to find where the sample ends.
PARTS = 1 << 16


def _until(rows: DataFrame, strata: list[str], digit: str) -> tuple[DataFrame, DataFrame]:
    """Of the first __take rows of each stratum by digit: those that belong for certain, and those of the digit at which a stratum's quota ends, with what is left of it as __take.

    Counts of digits are summed before they move, and one row for each stratum comes back to the rows. A stratum with no more rows than its quota has no end.
    """
    w = Window.partitionBy(*strata).orderBy(digit)
    counts = rows.groupBy(*strata, digit).agg(F.count("*").alias("__n"), F.max("__take").alias("__take")).withColumn("__upto", F.sum("__n").over(w))
    end = counts.where("__upto - __n <= __take and __upto > __take").select(*[F.col(s).alias(f"{s}e") for s in strata], F.col(digit).alias("__end"), (F.col("__take") - F.col("__upto") + F.col("__n")).alias("__left"))
    on = F.lit(True)
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"{s}e"))
    met = rows.join(end, on, "left")
    certain = F.col("__end").isNull() | (F.col(digit) < F.col("__end"))
    open_ = met.where((F.col(digit) == F.col("__end")) & (F.col("__left") > 0)).withColumn("__take", F.col("__left"))
    return met.where(certain & (F.col("__take") > 0)).select(*rows.columns), open_.select(*rows.columns)


def _bottom(rows: DataFrame, strata: list[str], columns: list[str], key: str, seed: int) -> DataFrame:
    """Of each stratum exactly the first __take rows (all, if there are fewer) by lot, then contents; rows that repeat are taken as often as it needs.

    The end is sought in counts, ever more finely: by the lot's first bits, the lot, the bits of the row's hash, at last the distinct rows. So nothing is sorted but the rows of one cell of a stratum,
    however large the quota is and however often keys or rows repeat.
    """
    of = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    rows = rows.where("__take > 0").withColumn("__lot", F.coalesce(lot(seed, F.col(key)), F.lit("")))
    rows = rows.withColumn("__part", F.coalesce(F.conv(F.substring("__lot", 1, 4), 16, 10).cast("int"), F.lit(0))).withColumn("__cell", F.pmod(of, F.lit(PARTS)))
    out, rest = None, rows
    for digit in ("__part", "__lot", "__cell"):
        certain, rest = _until(rest, strata, digit)
        out = certain.select(*columns) if out is None else out.unionByName(certain.select(*columns))
    cells = rest.groupBy(*strata, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("__n"), F.max("__take").alias("__take"))
    before = F.sum("__n").over(Window.partitionBy(*strata).orderBy(*[f"__v{i}" for i in range(len(columns))])) - F.col("__n")
    taken = cells.withColumn("__copies", F.least(F.col("__n"), F.col("__take") - before)).where("__copies > 0")
    return out.unionByName(taken.select(*[F.col(f"__v{i}").alias(c) for i, c in enumerate(columns)], F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*columns))


def uniform_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), without replacement: the first by their lots. Null keys have a lot too, rows may repeat; columns must be comparable."""
    return _bottom(df.withColumns({"__s0": F.lit(0), "__take": F.lit(n).cast("long")}), ["__s0"], df.columns, key, seed)


def quotas(counts: dict, size: int | None = None, fraction: float | None = None) -> dict:
    """Rows to take of each stratum, size in all: exact shares rounded down, then one more for the largest remainders (of equals, the first in order)."""
    if (size is None) == (fraction is None):
        raise ValueError("give exactly one of size and fraction")
    total = sum(counts.values())
    size = min(total, int(total * fraction + 0.5) if size is None else size)
    shares = {k: divmod(n * size, total) if total else (0, 0) for k, n in counts.items()}
    rest = size - sum(q for q, _ in shares.values())
    first = sorted(counts, key=lambda k: (-shares[k][1], tuple((x is not None, str(x)) for x in k)))[:rest]
    return {k: shares[k][0] + (k in first) for k in counts}


def stratified_sample(df: DataFrame, columns: list[str], key: str, size: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A sample of exactly the size, its strata in proportion, as quotas() has it. Null values are a stratum of their own. Keys may repeat or be null, rows may repeat; columns must be comparable.

    Quotas come from the counts of the strata by windows, as many rows as there are strata; of each stratum its first rows by lot come, as _bottom() finds them.
    """
    if (size is None) == (fraction is None):
        raise ValueError("give exactly one of size and fraction")
    names = [f"__s{i}" for i in range(len(columns))]
    strata = df.withColumns({n: F.col(c) for c, n in zip(columns, names, strict=True)})
    every = Window.partitionBy(F.lit(0))
    total = F.sum("__n").over(every)
    wanted = F.floor(total * F.lit(fraction) + 0.5) if size is None else F.lit(size)
    shares = strata.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__size", F.least(total, wanted.cast("long"))).withColumn("__all", total)
    shares = shares.withColumn("__product", F.col("__n").cast("decimal(38,0)") * F.col("__size"))
    shares = shares.withColumn("__base", F.expr("cast(__product div __all as bigint)")).withColumn("__left", F.expr("cast(__product % __all as bigint)"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__left"), *[F.asc_nulls_first(n) for n in names]))
    shares = shares.withColumn("__take", F.col("__base") + (rank <= F.col("__size") - F.sum("__base").over(every)).cast("long")).where("__take > 0")
    shares = shares.select(*[F.col(n).alias(f"{n}q") for n in names], "__take")
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}q"))
    return _bottom(strata.join(shares, on).select(*strata.columns, "__take"), names, df.columns, key, seed)


#: The prompt's slots, in the order in which they are filled.
PROMPT = "{answer_type}\n{description}\n{few_shot}"


def prompt(question: Column, system: str, few_shot: list[tuple[str, str]] = (), template: str = PROMPT, **slots: str) -> Column:
    """array of (role, content): the system message, examples as user and assistant messages, then the question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head = template
    for name in ("answer_type", "description", "few_shot"):
        head = head.replace("{" + name + "}", slots.get(name, ""))
    first = [message("system", F.lit(f"{system}\n{head}".strip()))]
    shots = [m for q, a in few_shot for m in (message("user", F.lit(q)), message("assistant", F.lit(a)))]
    return T.chat(F.array(*first, *shots), question)


def rl_rows(qa: DataFrame, name: str, prompt_of: Callable[[Column], Column] | None = None, ability: str = "qa") -> DataFrame:
    """Nested training rows: data_source, prompt, ability, reward_model(style, ground_truth), extra_info(index, question)."""
    prompt_of = prompt_of or (lambda q: F.array(F.struct(F.lit("user").alias("role"), q.alias("content"))))
    return qa.select(
        F.lit(name).alias("data_source"), prompt_of(F.col("question")).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"), F.struct(F.col("idx").alias("index"), "question").alias("extra_info"),
    )
