"""spark-submit this to build a stored index from a file of facts."""

from __future__ import annotations

import argparse

from factloom.functions import tokens
from factloom.session import session
from factloom.sources import readers, writers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("facts", help="text file of facts, plain, gzip or bzip2")
    p.add_argument("index", help="folder of the index; replaced if it is there")
    p.add_argument("--prefix", default="", help="put before every fact")
    p.add_argument("--switch", type=int, default=6, help="tokens of the longest stored key")
    p.add_argument("--tokenizer", default="words", help="words, utf8, or a tokenizer's JSON file")
    p.add_argument("--limit", type=int, help="facts to read at most, to try things out")
    a = p.parse_args(args)
    lines = readers.fact_lines(session(), a.facts, a.prefix, limit=a.limit)
    writers.build_index(lines.select(tokens.tokenizer(a.tokenizer)("fact").alias("tokens")), a.index, a.switch, {"tokenizer": a.tokenizer})


if __name__ == "__main__":
    main()
