"""Prefix expansion as a SQL table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class _TokenPrefixes:
    def eval(self, tokens: list):
        for k, t in enumerate(tokens or ()):
            yield tokens[:k], k, t


def register(spark: SparkSession) -> None:
    """Make token_prefixes(array of strings) a table function: prefix, depth and next_token of each step. Plans that need no SQL explode a sequence instead, which stays in the JVM."""
    spark.udtf.register("token_prefixes", udtf(_TokenPrefixes, returnType="prefix array<string>, depth int, next_token string"))
