"""Readers: fact files, dumps, logs with a header line, question sets, tables by URL."""

from __future__ import annotations

import io
import itertools
import os
import zipfile
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import qa

#: Columns of the files read here, and the parts of a stored analysis.
PROPERTIES = "id string, label string, datatype string, types array<string>"
PREDICTION = (
    "idx long, question string, answer_complete string, prediction string, full_prediction string, prompt string, full_sample string, triples array<string>, new_tokens_generated long, reached_max_tokens boolean"
)
JUDGE = "index long, question string, correct_answer string, predicted_answer string, prompt string, llm_decision string, llm_full_answer string"
LABEL_LINE = r'(rdf-schema#label|core#altLabel|schema\.org/description)> ".*"@en'


def fact_lines(spark: SparkSession, path: str, prefix: str = "", partitions: int | None = None, limit: int | None = None) -> DataFrame:
    """fact of each line of a text file, plain, gzip or bzip2, behind a prefix. gzip files can't be split: give partitions to deal their lines out."""
    lines = spark.read.text(path).select(F.concat(F.lit(prefix), "value").alias("fact"))
    lines = lines.repartition(partitions) if partitions else lines
    return lines if limit is None else lines.limit(limit)


def statement_lines(spark: SparkSession, path: str, tolerant: bool = False, only_labels: bool = False) -> DataFrame:
    """value of each line of a dump (bzip2 splits). tolerant: a stream that breaks off ends there. only_labels: English labels, alternative labels and descriptions."""
    reader = spark.read.option("ignoreCorruptFiles", str(tolerant).lower())
    lines = reader.text(path)
    return lines.where(F.col("value").rlike(LABEL_LINE)) if only_labels else lines


def properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROPERTIES).json(path, multiLine=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (its number from 0 within the file) and value of each line of text files, which may be split.

    A block of a file is read in order by one task, so a line's number is the number of lines in the blocks before, plus its place within its own.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("path", "start", "first", before.alias("before")), ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def log(spark: SparkSession, path: str, schema: str, header: str = "map<string,string>") -> tuple[DataFrame, DataFrame]:
    """Header and rows of a JSON-lines log whose first line is the run's metadata: (path, header), (path, idx, columns of schema). idx counts rows from 0 within a file."""
    lines = numbered_lines(spark, path)
    head = lines.where("line = 0").select("path", F.from_json("value", header).alias("header"))
    names = [f.split()[0] for f in schema.split(", ")]
    rows = lines.where("line > 0 and value <> ''").select("path", (F.col("line") - 1).cast("long").alias("idx"), F.from_json("value", schema).alias("row"))
    return head, rows.select("path", "idx", *[F.col(f"row.{n}").alias(n) for n in names if n not in ("idx", "path")])


def questions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A question set in the one shape of factloom.operators.qa; idx is its position where the file is one JSON array."""
    schemas = {"mintaka": qa.MINTAKA, "2wiki": qa.TWO_WIKI, "webqsp": qa.WEB_QSP, "plain": "question string, answer string"}
    if kind == "bi":
        return qa.ADAPTERS[kind](spark.read.option("header", "true").csv(path))
    return qa.ADAPTERS[kind](spark.read.schema(schemas[kind]).json(path, multiLine=True))


def dataset_path(name: str, spark: SparkSession | None = None) -> str:
    """A dataset's file below the folder that DATA_PATH names; it must be there. With a session, on any file system that Spark reads."""
    path = f"{os.environ.get('DATA_PATH', '.').rstrip('/')}/{name}"
    if spark is None:
        there = os.path.exists(path)
    else:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not there:
        raise FileNotFoundError(path)
    return path


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """model, dataset, setting, metric and value of stored analyses (JSON files): their answered, exact/inclusion and other metrics. A metric that a file lacks has no row."""
    maps = "map<string,double>"
    parts = {"answered_metrics": "answered", "em_im_metrics": "matches", "other_metrics_all": "all", "other_metrics_answered": "final"}
    schema = "metadata struct<experiment_name:string,model_config_path:string,dataset_config_path:string>, " + ", ".join(f"{p} {maps}" for p in parts)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("a"))
    each = F.array(*[F.struct(F.lit(n).alias("setting"), F.col(f"a.{p}").alias("m")) for p, n in parts.items()])
    rows = whole.select("path", "a.metadata", F.explode(each).alias("s")).select("path", "metadata", "s.setting", F.explode("s.m").alias("metric", "value"))
    base = lambda c: T.model_name(F.col(f"metadata.{c}"))
    return rows.select("path", base("model_config_path").alias("model"), base("dataset_config_path").alias("dataset"), "setting", "metric", "value")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], password: str | None = None) -> DataFrame:
    """Rows of the CSV files in ZIP archives, which a password may protect; all columns are strings."""
    import csv

    def rows(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if name.endswith(".csv"):
                            with z.open(name, pwd=password.encode() if password else None) as f:
                                lines = csv.DictReader(io.TextIOWrapper(f, "utf-8", newline=""))
                                while found := list(itertools.islice(lines, 10_000)):
                                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], pa.string()) for c in columns], names=columns)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def parse_url(url: str) -> dict:
    """kind (file, postgresql or http), and of the latter two the bare url and flat options; a postgresql URL needs a tablename."""
    parts = urlsplit(url)
    if parts.scheme in ("postgres", "postgresql"):
        options = {k: v[0] if len(v) == 1 else v for k, v in parse_qs(parts.query).items()}
        if "tablename" not in options:
            raise ValueError("the URL needs a tablename")
        return {"kind": "postgresql", "url": f"postgresql://{parts.netloc}{parts.path}", "options": options}
    if parts.scheme in ("http", "https"):
        return {"kind": "http", "url": url, "options": {}}
    if parts.scheme in ("", "file", "hdfs", "s3a", "viewfs", "gs", "abfss"):
        return {"kind": "file", "url": url, "options": {}}
    raise ValueError(f"can't read {url}")


def open_index(spark: SparkSession, url: str) -> DataFrame:
    """Edges (prefix, depth, next_token, numleaves) of a stored index: a table of factloom.sources.writers, or rows of (key, children, childrenleaves) over JDBC."""
    at = parse_url(url)
    if at["kind"] == "file":
        return spark.read.parquet(f"{url}/edges").select("prefix", "depth", "next_token", "numleaves")
    if at["kind"] == "http":
        raise ValueError("an HTTP index answers single look-ups: see factloom.sources.served")
    return edges_of_rows(spark.read.format("jdbc").options(url="jdbc:" + at["url"], dbtable=at["options"]["tablename"]).load())


def edges_of_rows(rows: DataFrame) -> DataFrame:
    """Edges of rows of (key, children, childrenleaves), whose keys begin with a root token; rows of a key that several batches wrote are added up."""
    child = rows.select("key", F.explode(F.arrays_zip("children", "childrenleaves")).alias("c"))
    prefix = F.slice("key", F.lit(2), F.size("key"))
    return child.groupBy(prefix.alias("prefix"), (F.size("key") - 1).alias("depth"), F.col("c.children").alias("next_token")).agg(F.sum("c.childrenleaves").alias("numleaves"))
