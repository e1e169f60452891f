"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

1. quality: documents that the quality classifier rejects go.
2. lines: lines that at least three documents hold stay in the last of them only.
3. near_duplicates: of each group of near copies (five-word shingles, Jaccard 0.8), the document with the smallest doc_id stays.
4. secrets: every secret in a text becomes a mark.
5. packing: texts become token sequences; the pieces are the result.
All stages but the last return the columns of documents, with n_chars kept in step with text. Rows with a null doc_id pass the
first four stages. Where rows share a doc_id, each is judged by its own text; of those that also share the text, the near-duplicate stage keeps one.
Other columns of documents go through the stages as they are, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, lines, packing, quality, queries, secrets
from factloom.llm.common import map_arrow, materialize, release, tracked


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Only columns, n_chars that of text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def _digest(frame: str, *columns: str) -> F.Column:
    """A hash that tells rows of one doc_id apart."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"{frame}.{c}").isNull(), F.col(f"{frame}.{c}"))])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Each row is judged by its own text, source and lang."""
    of = ("text", "source", "lang")
    narrow = docs.select("doc_id", *of).alias("d")
    scored = quality.score(narrow, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(_digest("d", *of).alias("digest"),))
    rejected = scored.where("not kept and doc_id is not null").select("doc_id", "digest").distinct()
    same = (F.col("d.doc_id") == F.col("r.doc_id")) & (_digest("d", *of) == F.col("r.digest"))
    return docs.alias("d").join(rejected.hint("shuffle_hash").alias("r"), same, "left_anti").select("d.*")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines."""
    return _with_text(lines.drop_repeated_lines(docs)[0], docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id, of rows that share it the one whose text has the least hash. Rows without words, and those with a null doc_id, stay."""
    rows = jaccard.jaccard_groups(docs.select("doc_id", "text"), jaccard.Similarity(words=5, num=80, den=100)).where("doc_id is not null")
    counted = materialize(rows.groupBy("doc_id", "digest", "component", "component_id").agg(F.count("*").alias("n")), "groups")
    # only rows of their component's smallest doc_id can stay, so no component's rows have to meet
    alone = F.col("component").isNull()
    leads = counted.where(~alone & (F.col("doc_id") == F.col("component_id")))
    lead = leads.groupBy("component").agg(F.min("digest").alias("lead"))
    marked = leads.join(lead, "component").select("doc_id", "digest", "n", (F.col("digest") == F.col("lead")).alias("kept"))
    marked = marked.unionByName(counted.where(alone | (F.col("doc_id") != F.col("component_id"))).select("doc_id", "digest", "n", alone.alias("kept")))
    marked = materialize(marked.where("n > 1 or not kept"), "marked")
    same = (F.col("d.doc_id") == F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.digest"))
    kept = docs.alias("d").join(marked.select("doc_id", "digest").hint("shuffle_hash").alias("m"), same, "left_anti").select("d.*")
    repeated = marked.where("kept").select("doc_id", "digest")
    if repeated.isEmpty():
        return kept
    once = docs.alias("d").join(repeated.hint("shuffle_hash").alias("m"), same, "left_semi").select("d.*").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are marks. A null text stays null."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t if t is None else secrets.redact(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], names=names)

    return _with_text(map_arrow(docs, run, docs.schema), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, in sequences of 2048."""
    return packing.pack(docs, queries.byte_bpe_files(), 2048)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the tokenizer and the packing; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of sf_dir; each stage's result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tracked() as made:
            kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs, *[t for t in made if t is not kept])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
