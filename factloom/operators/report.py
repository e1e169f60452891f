"""Evaluation reports: answered metrics, grouped reports, distributions, pivots, judge tables, alignment of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def answered_flags(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """predictions with answered (not empty), dontknow, and final (answered, and not a "don't know"); a null prediction is empty."""
    p = F.coalesce(prediction, F.lit(""))
    return predictions.withColumns({"answered": p != "", "dontknow": (p != "") & T.dont_know(p), "final": (p != "") & ~T.dont_know(p)})


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def flag_sum(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long"))


def where_avg(value: Column, flag: Column) -> Column:
    return F.avg(F.when(flag, value.cast("double")))


def answer_frame(rows: DataFrame, judge: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """One line for each answer, as a report's first table: rows of question, answer, prediction, flags and scores, under the report's headings.

    rows has idx, question, answer, prediction, full_prediction, final, dontknow, em, im, bleu1, bleu4, meteor, rouge_f, new_tokens, triples; judge and the groups where they are asked for.
    """
    names = {
        "idx": "Idx", "question": "Question", "answer": "Answer", "prediction": "Prediction", "em": "EM", "im": "IM", "bleu1": "BLEU-1", "bleu4": "BLEU-4", "meteor": "METEOR", "rouge_f": "ROUGE-L",
        "final": "Final", "dontknow": "DontKnow", "new_tokens": "Tokens", "triples": "Triples", "full_prediction": "FullPrediction",
    }
    order = list(names.items())
    if judge:
        order.insert(6, ("judge", "Judge"))
    order += list(zip(groups, ("Type", "AnsType"), strict=False))
    return rows.select(*[F.col(k).alias(v) for k, v in order])


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """All frames' rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def report_columns(tokens: str = "new_tokens", triples: str = "n_triples", scores: tuple[str, ...] = ()) -> list[Column]:
    """The aggregates of a report: counts, ratios, token statistics and score means, of all rows and of final answers (`_final`)."""
    n, final, answered = F.count("*"), F.col("final"), F.col("answered")
    out = [
        n.alias("total"), flag_sum(answered).alias("answered"), flag_sum(F.col("dontknow")).alias("dontknow"), flag_sum(final).alias("final"),
        ratio(flag_sum(answered), n).alias("answered_ratio"), ratio(flag_sum(F.col("dontknow")), n).alias("dontknow_ratio"), ratio(flag_sum(final), n).alias("final_ratio"),
        flag_sum(F.col(triples) == 0).alias("no_triples"), ratio(flag_sum(final & (F.col(triples) == 0)), flag_sum(final)).alias("final_no_triples_ratio"),
    ]
    for name, of in (("", F.col(tokens)), ("_final", F.when(final, F.col(tokens)))):
        out += [F.min(of).alias(f"min_tokens{name}"), F.avg(of).alias(f"avg_tokens{name}"), F.max(of).alias(f"max_tokens{name}")]
    for s in scores:
        out += [F.avg(F.col(s).cast("double")).alias(s), where_avg(F.col(s), final).alias(f"{s}_final")]
    return out


def overall(flagged: DataFrame, **options) -> DataFrame:
    return flagged.agg(*report_columns(**options))


def grouped(flagged: DataFrame, groups: list[str], **options) -> DataFrame:
    """One report row for each value of each of groups, in one pass: grouping (its name), value, share of all rows, and the report's columns."""
    key = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups]))
    rows = flagged.withColumn("__key", key)
    sums = rows.groupBy(F.col("__key.grouping").alias("grouping"), F.col("__key.value").alias("value")).agg(*report_columns(**options))
    return sums.withColumn("share", ratio(F.col("total"), F.sum("total").over(Window.partitionBy("grouping"))))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of a column's values."""
    sums = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("__all"))  # one row
    return sums.join(F.broadcast(whole), F.lit(True)).select("value", "n", ratio(F.col("n"), F.col("__all")).alias("share"))


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """ids, metric and value for each of the value columns."""
    return df.unpivot(ids, values, "metric", "value")


def pivot_first(df: DataFrame, row: str, column: str, value: str, order: str, columns: list[str] | None = None, scale: float = 1.0) -> DataFrame:
    """One row for each row value, one column for each column value: the first non-null value by order, scaled."""
    best = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(row).pivot(column, columns).agg(best * scale)


def pivot_last(df: DataFrame, row: str, column: str, value: str, order: str, columns: list[str] | None = None, missing: str = "--") -> DataFrame:
    """Likewise the last value, as text, with a mark where there is none."""
    out = df.groupBy(row).pivot(column, columns).agg(F.max_by(F.col(value), F.col(order)).cast("string"))
    return out.na.fill(missing, [c for c in out.columns if c != row])


def ranked_columns(names: list[str], datasets: list[str], metrics: list[str], mark: str = "|") -> list[str]:
    """Pivot columns `dataset|metric` by the rank of dataset, then metric; unknown ones last."""
    rank = lambda x, known: known.index(x) if x in known else len(known)
    return sorted(names, key=lambda n: (rank(n.split(mark)[0], datasets), rank(n.split(mark)[-1], metrics)))


def rename_known(df: DataFrame, column: str, names: dict[str, str | None], keep_unknown: bool) -> DataFrame:
    """Rename the values of a column; a value that maps to None goes; unknown ones stay or go."""
    if not names:
        return df if keep_unknown else df.where("false")
    mapped = F.create_map(*[F.lit(x) for kv in names.items() if kv[1] is not None for x in kv]) if any(names.values()) else F.lit(None)
    gone = [k for k, v in names.items() if v is None]
    out = df.where(~F.col(column).isin(gone)) if gone else df
    if not any(names.values()):
        return out if keep_unknown else out.where("false")
    new = mapped[F.col(column)]
    return out.withColumn(column, F.coalesce(new, F.col(column))) if keep_unknown else out.withColumn(column, new).where(F.col(column).isNotNull())


def aligned(a: DataFrame, b: DataFrame, index: str, same: list[str]) -> DataFrame:
    """a and b joined by index; raises ValueError if an index lacks its partner or one of the columns same differs."""
    right = b.select(F.col(index).alias("__i"), *[F.col(c).alias(f"__{c}") for c in same], *[c for c in b.columns if c not in a.columns])
    both = a.join(right, F.col(index) == F.col("__i"), "full_outer")
    wrong = F.col(index).isNull() | F.col("__i").isNull()
    for c in same:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    n = both.where(wrong).count()
    if n:
        raise ValueError(f"{n} rows are not aligned")
    return both.drop("__i", *[f"__{c}" for c in same])


def judge_flag(decision: Column) -> Column:
    """1 for yes, 0 for anything else, a skipped row included."""
    return F.when(decision == "yes", 1).otherwise(0)


def judge_skips(rows: DataFrame, needed: list[str]) -> DataFrame:
    """rows with missing, the names of the needed columns that are null or empty, joined by `, `; empty where the row can be judged."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in needed]))
    return rows.withColumn("missing", F.array_join(lacks, ", "))


def resume(todo: DataFrame, done: DataFrame, index: str) -> DataFrame:
    """What hasn't been done yet."""
    return todo.join(done.select(index), index, "left_anti")


def resume_run(todo: DataFrame, done: DataFrame, index: str, header: DataFrame, now: dict[str, str], fields: list[str]) -> DataFrame:
    """What a run still has to do: todo without the rows of its log, whose header(header) must agree with the run's own metadata in fields; raises ValueError if it doesn't."""
    own = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
    if not header.where(~T.same_run(F.col("header"), own, fields)).isEmpty():
        raise ValueError("the log is of another run")
    return resume(todo, done, index)


def by_model(df: DataFrame, column: str = "model") -> DataFrame:
    """Rows in the order of their model, each with its place from 0, for reports; models are few."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(column)) - 1).orderBy("place")


def latex(df: DataFrame, caption: str = "") -> str:
    """A small result as a LaTeX table. Collects it."""
    rows = [df.columns, *[["" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]]
    escape = lambda s: str(s).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(escape, r)) + r" \\" for r in rows]
    body = "\n".join([lines[0], r"\hline", *lines[1:]])
    return f"\\begin{{table}}\n\\begin{{tabular}}{{{'l' + 'r' * (len(df.columns) - 1)}}}\n{body}\n\\end{{tabular}}\n\\caption{{{escape(caption)}}}\n\\end{{table}}"
