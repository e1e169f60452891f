"""spark-submit this to walk through facts at random, each once, from initial tokens if given."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from factloom.functions import tokens
from factloom.operators import decode, trie
from factloom.session import session
from factloom.sources import readers


def main(args: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("facts", help="text file of facts")
    p.add_argument("--initial", default="", help="words that every fact begins with")
    p.add_argument("--n", type=int, default=1, help="facts to walk")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--steps", type=int, default=200, help="tokens in all, at most")
    a = p.parse_args(args)
    spark = session()
    leaves = trie.maximal_leaves(readers.fact_lines(spark, a.facts).select(tokens.words("fact").alias("tokens")))
    states = spark.range(1).select(F.col("id").alias("state"), F.lit(a.n).alias("n"), F.array(*[F.lit(w) for w in a.initial.split()]).cast("array<string>").alias("initial"))
    below = trie.prefix_leaves(trie.edges(leaves, leaves=True), states.select(F.col("initial").alias("probe"))).first()["numleaves"]
    print(f"{below} facts below the initial tokens")
    out = [f"{r['status']}: {' '.join(r['tokens'])}" for r in decode.constrained_decode(states, leaves, a.steps, a.seed).orderBy("ordinal").collect()]
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
