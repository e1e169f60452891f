"""Tokens of a fact: words, or UTF-8 bytes; ids by dense rank where a vocabulary is asked for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import lineage


def words(text: Column | str) -> Column:
    """The words between single spaces. A fact's final ` .` becomes a token of its own, which makes facts prefix-free."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def utf8(text: Column | str) -> Column:
    """The bytes of the text as integers 0 to 255."""
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def subwords(text: Column | str, path: str) -> Column:
    """Ids of the tokenizer in a JSON file that every executor has, without special tokens; null of a null text. In Arrow batches, as the library is no JVM code."""
    def ids(texts: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(path)
        known = texts.fillna("").tolist()
        found = [e.ids for e in tokenizer.encode_batch(known, add_special_tokens=False)]
        return pd.Series([None if missing else x for missing, x in zip(texts.isna(), found, strict=True)])

    return F.pandas_udf(ids, "array<int>")(F.col(text) if isinstance(text, str) else text)


_tokenizers: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Tokenizers by name: functions from a text column to a column of tokens. Other names are files for subwords(); others can be registered.
TOKENIZERS: dict[str, Callable[[Column | str], Column]] = {"words": words, "utf8": utf8}


def tokenizer(name: str) -> Callable[[Column | str], Column]:
    return TOKENIZERS.get(name) or (lambda text: subwords(text, name))


def vocabulary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """word and id of the distinct words, ids dense in the order of words.

    Ids come from ranges of the sorted words: each partition's offset is the number of words in those before it, so no single task sorts them all.
    """
    distinct = tokens.select(F.explode(column).alias("word")).distinct()
    ranged = distinct.repartitionByRange("word").sortWithinPartitions("word").select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono"))
    local = lineage.cut(ranged.select("word", "part", (F.col("mono") - (F.col("part").cast("long") * F.lit(1 << 33))).alias("at")))  # ranges hold only as long as rows don't move
    counts = local.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "part").select("word", (F.col("at") + F.col("before")).alias("id"))


def joined(tokens: Column | str, mark: str = ".") -> Column:
    """A key for a token sequence: its tokens as text, joined by a mark."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), mark)
