"""Knowledge dumps to facts: N-Triples statements and labels, property filters, titles, verbalised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IRIs and patterns of the dump format.
_E, _P = r"<http://www\.wikidata\.org/entity/", r"<http://www\.wikidata\.org/prop/direct/"
STATEMENT = rf'^{_E}Q(\d+)> {_P}P(\d+)> (?:{_E}Q(\d+)>|"([^"]*)"@en|"([^"]*)"\^\^<[^>]*>)'
LABEL = r'^<http://www\.wikidata\.org/entity/([QP])(\d+)> <([^>]*)> "(.*)"@en'
LABEL_KINDS = {
    "http://www.w3.org/2000/01/rdf-schema#label": "label", "http://www.w3.org/2004/02/skos/core#altLabel": "alt_label", "http://schema.org/description": "description",
}
DATATYPES = ("globe-coordinate", "quantity", "string", "time", "wikibase-item")


def statements(lines: DataFrame, pattern: str = STATEMENT, value: str = "value") -> DataFrame:
    """sub, prop, obj_ent and obj_lit of the lines that match; a literal with a quote inside does not. An English literal goes before a typed one."""
    g = lambda k: F.nullif(F.regexp_extract(value, pattern, k), F.lit(""))
    rows = lines.where(F.col(value).rlike(pattern))
    return rows.select(g(1).cast("long").alias("sub"), g(2).cast("long").alias("prop"), g(3).cast("long").alias("obj_ent"), F.coalesce(g(4), g(5)).alias("obj_lit"))


def label_statements(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind (Q or P), id, what (label, alt_label, description) and text of English label lines."""
    g = lambda k: F.regexp_extract(value, LABEL, k)
    what = F.create_map(*[F.lit(x) for kv in LABEL_KINDS.items() for x in kv])[g(3)]
    return lines.where(F.col(value).rlike(LABEL)).select(g(1).alias("kind"), g(2).cast("long").alias("id"), what.alias("what"), g(4).alias("text"), *[c for c in lines.columns if c != value]).where("what is not null")


def label_records(labels: DataFrame, order: str) -> DataFrame:
    """For each (kind, id): its label, sorted alternative labels, and last description in the order of a column."""
    of = lambda w: F.when(F.col("what") == w, F.col("text"))
    return labels.groupBy("kind", "id").agg(
        F.max(of("label")).alias("label"), F.sort_array(F.collect_set(of("alt_label"))).alias("alt_labels"),
        F.max_by(of("description"), F.when(F.col("what") == "description", F.col(order))).alias("description"),
    )


def keep_properties(props: DataFrame, keep_types: list[str], datatypes: tuple[str, ...] = DATATYPES) -> DataFrame:
    """Properties of a wanted datatype, without a type outside keep_types; untyped ones stay."""
    wanted = F.array(*[F.lit(t) for t in keep_types]) if keep_types else F.array().cast("array<string>")
    return props.where(F.col("datatype").isin(*datatypes) & (F.size(F.array_except(F.coalesce("types", F.array().cast("array<string>")), wanted)) == 0))


def without_ids(props: DataFrame, label: str = "label", word: str = "ID") -> DataFrame:
    """Properties whose label doesn't speak of an ID."""
    return props.where(~F.coalesce(F.contains(F.col(label), F.lit(word)), F.lit(False)))


def title(wiki_title: Column, label: Column, description: Column) -> Column:
    """The encyclopedia's title, else `label (description)` where both are there, else null."""
    return F.coalesce(wiki_title, F.when((label != "") & (description != ""), F.concat(label, F.lit(" ("), description, F.lit(")"))))


def clean_title(raw: Column) -> Column:
    return F.translate(raw, "_", " ")


def page_titles(page: DataFrame, props: DataFrame) -> DataFrame:
    """qid, title and short description: pages of the main namespace joined with two of their properties."""
    item = props.where("pp_propname = 'wikibase_item'").select(F.col("pp_page").alias("page_id"), F.col("pp_value").alias("item"))
    short = props.where("pp_propname = 'wikibase-shortdesc'").select(F.col("pp_page").alias("page_id"), F.col("pp_value").alias("short_desc"))
    rows = page.where("page_namespace = 0").join(item, "page_id").join(short, "page_id")
    prefix = F.substring("item", 1, 1)
    return rows.where(prefix == "Q").select(F.expr("try_cast(substring(item, 2) as bigint)").alias("qid"), clean_title(F.col("page_title")).alias("title"), "short_desc")


def fact(subject: Column, prop: Column, obj: Column) -> Column:
    return F.concat(F.lit("<"), subject, F.lit("> <"), prop, F.lit("> <"), obj, F.lit("> ."))


def verbalise(triples: DataFrame, titles: DataFrame, props: DataFrame, descriptions: DataFrame | None = None, keep_untitled: bool = False) -> DataFrame:
    """fact lines of triples(sub, prop, obj_ent, obj_lit), with titles(id, title) and props(id, label).

    A triple needs a subject with a title, a property with a label, and a literal or an object with a title. descriptions(id, what, text), if given, adds one
    fact for each description of each matched subject, and of each object whose subject and property were verbalised; of entities without a title only on demand,
    which prints a null title as None.
    """
    t, p = titles.select(F.col("id").alias("t_id"), "title"), props.select(F.col("id").alias("p_id"), F.col("label").alias("p_label"))
    subjects = triples.join(t.toDF("s_id", "s_title"), F.col("sub") == F.col("s_id"), "left")
    named = subjects.where("s_title is not null").join(p, F.col("prop") == F.col("p_id"))
    full = named.join(t.toDF("o_id", "o_title"), F.col("obj_ent") == F.col("o_id"), "left")
    lines = full.withColumn("o", F.coalesce(F.when(F.col("obj_ent").isNotNull(), F.col("o_title")).otherwise(F.col("obj_lit")))).where("o is not null")
    out = lines.select(fact(F.col("s_title"), F.col("p_label"), F.col("o")).alias("fact"))
    if descriptions is None:
        return out
    seen = triples.select(F.col("sub").alias("id")).union(named.where("obj_ent is not null").select("obj_ent")).distinct()
    told = seen.join(descriptions, "id").join(t, F.col("id") == F.col("t_id"), "left").select("id", "what", "text", "title").distinct()
    if not keep_untitled:
        told = told.where("title is not null")
    return out.unionByName(told.select(fact(F.coalesce("title", F.lit("None")), F.col("what"), F.col("text")).alias("fact")))
