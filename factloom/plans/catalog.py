"""Every registered query: name to Spark function, and name to the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scores, tokens, udtf
from factloom.functions import text as T
from factloom.operators import decode, facts, lineage, lookup, qa, report, series, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fact_table(spark: SparkSession, sf: str) -> DataFrame:
    """fact and nation of the facts that the dimension tables tell."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    line = lambda s, p, o: facts.fact(F.col(s), F.lit(p), F.col(o)).alias("fact")
    one = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(line("n_name", "in region", "r_name"), F.col("n_name").alias("nation"))
    two = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(line("c_name", "lives in", "n_name"), F.col("n_name").alias("nation"))
    three = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(line("s_name", "located in", "n_name"), F.col("n_name").alias("nation"))
    return one.unionByName(two).unionByName(three)


FACTS = """facts AS (
  SELECT '<' || n_name || '> <in region> <' || r_name || '> .' AS fact, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT '<' || c_name || '> <lives in> <' || n_name || '> .', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT '<' || s_name || '> <located in> <' || n_name || '> .', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
leaves AS (SELECT DISTINCT string_split(fact, ' ') AS tok, nation FROM facts)"""
#: prefix p, depth d, next token t of every step of every leaf
STEPS = FACTS + """, steps AS (SELECT tok[1:d] AS p, d, tok[d + 1] AS t, nation, tok FROM (SELECT tok, nation, unnest(range(len(tok))) AS d FROM leaves))"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return fact_table(spark, sf).select(tokens.words("fact").alias("tokens"), "nation")


def spaced(column: str) -> F.Column:
    return F.array_join(column, " ")


def edge_text(edge: DataFrame) -> DataFrame:
    return edge.select(spaced("prefix").alias("prefix"), F.col("depth").cast("long").alias("depth"), "next_token", "numleaves")


@query(f"WITH {STEPS} SELECT t AS next_token, count(*) AS numleaves FROM steps WHERE d = 0 GROUP BY t")
def root_next_tokens(spark, sf):
    return trie.edges(sequences(spark, sf), depth=1).select("next_token", "numleaves")


@query(f"WITH {FACTS} SELECT fact FROM facts")
def verbalize_facts(spark, sf):
    return fact_table(spark, sf).select("fact")


@query("SELECT '<' || p_name || '> <short description> <' || p_type || '> .' AS fact FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def verbalize_descriptions_distinct(spark, sf):
    """One description fact for each part that a line item has, however many have it."""
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem").select("l_partkey")
    return part.join(line, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(facts.fact(F.col("p_name"), F.lit("short description"), F.col("p_type")).alias("fact"))


_TRIPLES = """
SELECT '<' || c_name || '> <lives in> <' || n_name || '> .' AS fact FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0
UNION ALL SELECT '<' || c_name || '> <segment> <' || c_mktsegment || '> .' FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT DISTINCT '<' || c_name || '> <description> <customer of ' || c_mktsegment || '> .' FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT DISTINCT '<' || n_name || '> <description> <nation ' || n_nationkey || '> .' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal >= 0)"""


@query(_TRIPLES)
def verbalise_triples(spark, sf):
    """Triples with entity and literal objects through titles, property labels and descriptions; customers in debt have no title."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    person = (F.col("c_custkey") + 1000).alias("sub")
    place = c.select(person, F.lit(1).cast("long").alias("prop"), F.col("c_nationkey").cast("long").alias("obj_ent"), F.lit(None).cast("string").alias("obj_lit"))
    segment = c.select(person, F.lit(2).cast("long").alias("prop"), F.lit(None).cast("long").alias("obj_ent"), F.col("c_mktsegment").alias("obj_lit"))
    lost = c.select(person, F.lit(3).cast("long").alias("prop"), F.lit(None).cast("long").alias("obj_ent"), F.lit("x").alias("obj_lit"))
    titles = c.where("c_acctbal >= 0").select((F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("title")).unionByName(n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title")))
    props = spark.createDataFrame([(1, "lives in"), (2, "segment")], "id long, label string")
    told = c.select((F.col("c_custkey") + 1000).alias("id"), F.lit("description").alias("what"), F.concat(F.lit("customer of "), "c_mktsegment").alias("text"))
    told = told.unionByName(n.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("description").alias("what"), F.concat(F.lit("nation "), F.col("n_nationkey")).alias("text")))
    return facts.verbalise(place.unionByName(segment).unionByName(lost), titles, props, told)


@query(f"WITH {STEPS} SELECT array_to_string(p, ' ') AS prefix, d AS depth, t AS next_token, count(*) AS numleaves FROM steps GROUP BY p, d, t")
def trie_edges(spark, sf):
    return edge_text(trie.edges(sequences(spark, sf)))


_DOC_LEAVES = """docs AS (SELECT DISTINCT string_split(text, ' ') AS tok, text FROM documents WHERE text <> ''),
leaves AS (SELECT tok, text FROM (SELECT tok, text, lead(tok) OVER (ORDER BY tok) AS nxt FROM docs) WHERE nxt IS NULL OR len(nxt) < len(tok) OR nxt[1:len(tok)] <> tok)"""


@query(f"""WITH {_DOC_LEAVES}
SELECT array_to_string(tok[1:d], ' ') AS prefix, d AS depth, tok[d + 1] AS next_token, count(*) AS numleaves
FROM (SELECT tok, unnest(range(least(len(tok), 4))) AS d FROM leaves) GROUP BY tok[1:d], d, tok[d + 1]""")
def trie_edges_docs_depth4(spark, sf):
    docs = table(spark, sf, "documents").where("text <> ''")
    return edge_text(trie.edges(docs.select(tokens.words("text").alias("tokens")), depth=4))


@query(f"WITH {_DOC_LEAVES} SELECT md5(text) AS text_md5, len(tok)::BIGINT AS n_tokens FROM leaves")
def maximal_leaves(spark, sf):
    docs = table(spark, sf, "documents").where("text <> ''")
    return trie.maximal_leaves(docs.select(tokens.words("text").alias("tokens"))).select(F.md5(spaced("tokens")).alias("text_md5"), F.size("tokens").cast("long").alias("n_tokens"))


@query(f"""WITH {STEPS}, e AS (SELECT p, d, t, count(*) AS n FROM steps GROUP BY p, d, t)
SELECT array_to_string(p, ' ') AS key, d AS depth, sum(n)::BIGINT AS numleaves, string_agg(t || ':' || n, ',' ORDER BY t) AS next FROM e GROUP BY p, d""")
def trie_nodes(spark, sf):
    n = trie.nodes(trie.edges(sequences(spark, sf)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("next")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return n.select(spaced("key").alias("key"), F.col("depth").cast("long").alias("depth"), "numleaves", text.alias("next"))


@query(f"WITH {FACTS} SELECT array_to_string(tok[1:3], ' ') AS key, array_to_string(tok[4:], ' ') AS suffix FROM leaves WHERE len(tok) > 3")
def trie_suffixes(spark, sf):
    return trie.depth_cut(sequences(spark, sf), 3)[1].select(spaced("key").alias("key"), spaced("suffix").alias("suffix"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes of all lengths of each nation's facts, past their ends, unknown ones, and the root."""
    own = sequences(spark, sf).where(F.element_at("tokens", 2) == "<in")
    upto = own.select("tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("k")).select(F.slice("tokens", F.lit(1), F.col("k")).alias("probe"))
    past = own.select(F.concat("tokens", F.array(F.lit("more"))).alias("probe"))
    odd = own.select(F.array(F.element_at("tokens", 1), F.lit("nowhere")).alias("probe"))
    root = spark.range(1).select(F.expr("slice(array(''), 1, 0)").alias("probe"))
    return upto.union(past).union(odd).union(root).distinct()


PROBES = """own AS (SELECT tok FROM leaves WHERE tok[2] = '<in'),
probes AS (SELECT DISTINCT q FROM (SELECT tok[1:k] AS q FROM (SELECT tok, unnest(range(1, len(tok) + 1)) AS k FROM own)
  UNION ALL SELECT list_append(tok, 'more') FROM own UNION ALL SELECT [tok[1], 'nowhere'] FROM own UNION ALL SELECT []::VARCHAR[]))"""
_NEXT = "array_join(transform(array_sort(map_entries(next)), e -> concat_ws(':', e.key, e.value)), ',')"


@query(f"""WITH {STEPS}, {PROBES}, e AS (SELECT p, t, count(*) AS n FROM steps GROUP BY p, t), m AS (SELECT p, string_agg(t || ':' || n, ',' ORDER BY t) AS nxt FROM e GROUP BY p)
SELECT array_to_string(q, ' ') AS probe, len(q)::BIGINT AS length, coalesce(nxt, '') AS next,
  CASE WHEN nxt IS NOT NULL THEN 'OK' WHEN EXISTS (SELECT 1 FROM leaves WHERE q[1:len(tok)] = tok) THEN 'COMPLETE' ELSE 'NOT_FOUND' END AS status
FROM probes LEFT JOIN m ON p = q""")
def next_tokens_status(spark, sf):
    leaves = lineage.cut(trie.maximal_leaves(sequences(spark, sf)))
    found = lookup.next_tokens(probes(spark, sf), leaves)
    return found.select(spaced("probe").alias("probe"), F.size("probe").cast("long").alias("length"), F.expr(_NEXT).alias("next"), "status")


@query(f"""WITH {STEPS}, {PROBES}, e AS (SELECT p, t, count(*) AS n FROM steps GROUP BY p, t), m AS (SELECT p, string_agg(t || ':' || n, ',' ORDER BY t) AS nxt FROM e GROUP BY p)
SELECT array_to_string(q, ' ') AS probe, len(q)::BIGINT AS length, coalesce(nxt, '') AS next FROM probes LEFT JOIN m ON p = q""")
def persisted_next_tokens(spark, sf):
    upper, lower = trie.depth_cut(sequences(spark, sf), 3)
    found = lookup.persisted_next_tokens(probes(spark, sf), upper, lower, 3)
    return found.select(spaced("probe").alias("probe"), F.size("probe").cast("long").alias("length"), F.expr(_NEXT).alias("next"))


@query("""WITH seqs AS (SELECT DISTINCT string_split(text, ' ') AS tok FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) WHERE text <> ''),
leaves AS (SELECT tok FROM (SELECT tok, lead(tok) OVER (ORDER BY tok) AS nxt FROM seqs) WHERE nxt IS NULL OR len(nxt) < len(tok) OR nxt[1:len(tok)] <> tok)
SELECT tok[1] AS first, tok[2] AS second, count(*) AS numleaves FROM leaves GROUP BY 1, 2""")
def trie_merge(spark, sf):
    """Leaves of the merged trees of documents and benchmark items, by their first two tokens."""
    of = lambda t: table(spark, sf, t).where("text <> ''").select(tokens.words("text").alias("tokens"))
    merged = trie.merge(of("documents"), of("benchmark"))
    return merged.groupBy(F.element_at("tokens", 1).alias("first"), F.try_element_at("tokens", F.lit(2)).alias("second")).agg(F.count("*").alias("numleaves"))


_SEGMENTS = """seqs AS (SELECT DISTINCT c_custkey % 4 AS batch, string_split('<' || c_mktsegment || '> <segment of> <' || n_name || '> .', ' ') AS tok FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def segment_sequences(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    line = facts.fact(F.col("c_mktsegment"), F.lit("segment of"), F.col("n_name"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") % 4).alias("batch"), tokens.words(line).alias("tokens"))


@query(f"""WITH {_SEGMENTS} SELECT array_to_string(tok[1:d], ' ') AS prefix, d AS depth, tok[d + 1] AS next_token, count(*) AS numleaves
FROM (SELECT batch, tok, unnest(range(len(tok))) AS d FROM seqs) GROUP BY tok[1:d], d, tok[d + 1]""")
def trie_batch_sum(spark, sf):
    return edge_text(trie.batch_summed(segment_sequences(spark, sf)))


@query("""WITH seqs AS (SELECT string_split('<' || c_mktsegment || '> <segment of> <' || n_name || '> .', ' ') AS tok FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT array_to_string(tok[1:d], ' ') AS prefix, d AS depth, tok[d + 1] AS next_token, count(*) AS numleaves
FROM (SELECT tok, unnest(range(len(tok))) AS d FROM seqs) GROUP BY tok[1:d], d, tok[d + 1]""")
def trie_multiplicity(spark, sf):
    return edge_text(trie.edges_multiplicity(segment_sequences(spark, sf)))


@query("""WITH seqs AS (SELECT string_split('<' || c_mktsegment || '> <segment of> <' || n_name || '> .', ' ') AS tok FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT array_to_string(tok[1:d], ' ') AS prefix, d AS depth, count(*) FILTER (WHERE d < len(tok)) AS visits
FROM (SELECT tok, unnest(range(len(tok) + 1)) AS d FROM seqs) GROUP BY tok[1:d], d""")
def raw_visits(spark, sf):
    return trie.raw_visits(segment_sequences(spark, sf)).select(spaced("prefix").alias("prefix"), F.col("depth").cast("long").alias("depth"), "visits")


@query("""WITH seqs AS (SELECT DISTINCT string_split('<' || c_mktsegment || '> <segment of> <' || n_name || '> .', ' ') AS tok FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (SELECT DISTINCT tok[1:d] AS p, d FROM (SELECT tok, unnest(range(len(tok) + 1)) AS d FROM seqs)),
trees AS (SELECT level, p[1:level] AS root, count(*) * 64 + (count(*) - 1) * 16 AS bytes FROM (SELECT p, unnest(range(d + 1)) AS level FROM nodes) GROUP BY level, p[1:level])
SELECT level, count(*) AS nodes, min(bytes)::BIGINT AS min, max(bytes)::BIGINT AS max, round(avg(bytes), 6) AS mean, round(quantile_cont(bytes, 0.75), 6) AS q75, round(quantile_cont(bytes, 0.9), 6) AS q90, round(quantile_cont(bytes, 0.99), 6) AS q99
FROM trees GROUP BY level""")
def level_sizes(spark, sf):
    out = trie.level_sizes(trie.raw_visits(segment_sequences(spark, sf)))
    return out.select(F.col("level").cast("long").alias("level"), "nodes", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "q75", "q90", "q99")])


@query(f"""WITH {STEPS}, e AS (SELECT p, d, t, count(*) AS n FROM steps GROUP BY p, d, t), s AS (SELECT p, sum(n) AS n FROM e GROUP BY p)
SELECT array_to_string(e.p, ' ') AS prefix, t AS next_token, e.n AS numleaves, coalesce(s.n, 1)::BIGINT AS counted, e.n <> coalesce(s.n, 1) AS wrong
FROM e LEFT JOIN s ON s.p = list_append(e.p, e.t)""")
def trie_count_invariant(spark, sf):
    return trie.recount(trie.edges(sequences(spark, sf))).select(spaced("prefix").alias("prefix"), "next_token", "numleaves", "counted", "wrong")


@query(f"""WITH {FACTS}, {PROBES} SELECT array_to_string(q, ' ') AS probe, len(q)::BIGINT AS length, (SELECT count(*) FROM leaves WHERE len(tok) > len(q) AND tok[1:len(q)] = q) AS numleaves FROM probes""")
def prefix_leaf_count(spark, sf):
    found = trie.prefix_leaves(trie.edges(sequences(spark, sf)), probes(spark, sf))
    return found.select(spaced("probe").alias("probe"), F.size("probe").cast("long").alias("length"), "numleaves")


_USED = "(SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"


@query(f"""WITH {STEPS}, e AS (SELECT p, t, count(*) AS n, count(*) FILTER (WHERE nation IN {_USED}) AS used FROM steps GROUP BY p, t)
SELECT array_to_string(p, ' ') AS prefix, t AS next_token, n - used AS numleaves FROM e WHERE n - used > 0""")
def subtract_used(spark, sf):
    """What is left of each edge when the facts of one region's nations are used up."""
    seqs = sequences(spark, sf)
    used = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"))
    gone = trie.edges(seqs.join(used, "nation", "left_semi"))
    return lookup.subtract_used(trie.edges(seqs), gone, ["prefix"]).select(spaced("prefix").alias("prefix"), "next_token", "numleaves")


@query(f"""WITH {STEPS}, e AS (SELECT p, t, count(*) AS n, count(*) FILTER (WHERE nation IN {_USED}) AS used FROM steps GROUP BY p, t)
SELECT array_to_string(p, ' ') AS prefix, coalesce(string_agg(t || ':' || (n - used), ',' ORDER BY t) FILTER (WHERE n - used > 0), '') AS next FROM e GROUP BY p""")
def subtract_maps(spark, sf):
    """The same on maps of next tokens, node by node."""
    seqs = sequences(spark, sf)
    used = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"))
    gone = trie.nodes(trie.edges(seqs.join(used, "nation", "left_semi"))).select("key", F.col("next").alias("gone"))
    all_nodes = trie.nodes(trie.edges(seqs)).join(gone, "key", "left")
    return all_nodes.select(spaced("key").alias("prefix"), lookup.subtract("next", "gone").alias("next")).select("prefix", F.expr(_NEXT).alias("next"))


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as scores: state, label, token, score."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("state"), "label", F.posexplode("embedding").alias("token", "score")).withColumn("token", F.col("token").cast("long"))


_SCORES = "s AS (SELECT vec_id AS state, label, unnest(range(len(embedding))) AS token, unnest(embedding) AS score FROM embeddings)"


@query(f"WITH {_SCORES} SELECT state, arg_max(token, (score, -token)) AS token, max(score) AS score FROM s WHERE token % 10 = label GROUP BY state")
def masked_argmax(spark, sf):
    """The best token of each state among those allowed for its label."""
    s = score_rows(spark, sf)
    allowed = s.where(F.col("token") % 10 == F.col("label")).select("state", "token")
    return decode.argmax(decode.mask(s.select("state", "token", "score"), allowed, ["state"]), ["state"])


@query(f"""WITH {_SCORES}, r AS (SELECT state // 4 AS batch, state % 4 AS parent, token, score, row_number() OVER (PARTITION BY state // 4 ORDER BY score DESC, state % 4, token) AS rn FROM s)
SELECT batch::BIGINT AS batch, (rn - 1)::BIGINT AS beam, parent::BIGINT AS parent, token, score FROM r WHERE rn <= 4""")
def beam_topk(spark, sf):
    batch, beam = decode.grid(F.col("state"), 4)
    top = decode.top_beams(score_rows(spark, sf).select(batch.alias("batch"), beam.alias("beam"), "token", "score"), "batch", 4)
    return top.withColumn("beam", F.col("beam").cast("long"))


@query("""WITH p AS (SELECT vec_id // 4 AS batch, vec_id % 4 AS beam, (vec_id + label) % 4 AS parent, label FROM embeddings)
SELECT a.batch::BIGINT AS batch, a.beam::BIGINT AS beam, b.label FROM p a JOIN p b ON a.batch = b.batch AND a.parent = b.beam""")
def beam_permutation(spark, sf):
    batch, beam = decode.grid(F.col("vec_id"), 4)
    states = table(spark, sf, "embeddings").select(batch.alias("batch"), beam.alias("beam"), ((F.col("vec_id") + F.col("label")) % 4).alias("parent"), "label")
    return decode.permute_beams(states.select("batch", "beam", "label"), states)


@query(f"""WITH RECURSIVE {STEPS}, e AS (SELECT p, t, count(*) AS n FROM steps GROUP BY p, t), c AS (SELECT p, arg_min(t, (-n, t)) AS t, max(n) AS n FROM e GROUP BY p),
walk AS (SELECT 1 AS step, [t] AS tok, n FROM c WHERE len(p) = 0 UNION ALL SELECT step + 1, list_append(tok, t), c.n FROM walk JOIN c ON c.p = tok)
SELECT step::BIGINT AS step, array_to_string(tok, ' ') AS tokens, n AS numleaves FROM walk""")
def greedy_walk(spark, sf):
    walk = decode.greedy_walk(trie.edges(sequences(spark, sf)))
    return walk.select(F.col("step").cast("long").alias("step"), spaced("tokens").alias("tokens"), "numleaves")


@query(f"""WITH RECURSIVE {FACTS},
live AS (
  SELECT 0 AS step, n_nationkey::BIGINT AS state, []::VARCHAR[] AS prefix, []::VARCHAR[][] AS done, NULL::VARCHAR[] AS emitted FROM nation
  UNION ALL
  SELECT step + 1, state, CASE WHEN emitted IS NULL THEN grown ELSE []::VARCHAR[] END, CASE WHEN emitted IS NULL THEN done ELSE list_append(done, emitted) END, emitted
  FROM (SELECT o.step, o.state, o.done, list_append(o.prefix, o.t) AS grown, (SELECT tok FROM leaves WHERE tok = list_append(o.prefix, o.t) LIMIT 1) AS emitted
    FROM (SELECT l.step, l.state, l.prefix, l.done, arg_min(tok[len(prefix) + 1], md5('3:' || state || ':' || step || ':' || tok[len(prefix) + 1])) AS t
      FROM live l JOIN leaves ON len(tok) > len(l.prefix) AND tok[1:len(l.prefix)] = l.prefix AND NOT list_contains(l.done, tok)
      WHERE len(l.done) < 2 AND l.step < 40 GROUP BY ALL) o))
SELECT state, (len(done) - 1)::INT AS ordinal, array_to_string(emitted, ' ') AS tokens, 'COMPLETE' AS status FROM live WHERE emitted IS NOT NULL""")
def constrained_decode(spark, sf):
    """Two facts for each nation's state out of all facts, none twice; scores are hashes."""
    states = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("state"), F.lit(2).alias("n"))
    leaves = trie.maximal_leaves(sequences(spark, sf)).select("tokens")
    return decode.constrained_decode(states, leaves, 40, seed=3).select("state", "ordinal", spaced("tokens").alias("tokens"), "status")


@query(f"WITH {_SCORES} SELECT state, CASE WHEN arg_max(token, (score, -token)) IN (1, 2) THEN 'yes' ELSE 'no' END AS decision FROM s WHERE token IN (1, 2, 3, 4) GROUP BY state")
def yes_no_choice(spark, sf):
    return decode.yes_no(score_rows(spark, sf).select("state", "token", "score"), ["state"], [1, 2], [3, 4]).select("state", "decision")


_WORDS = "w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS seq, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS place FROM conversations))"


@query(f"""WITH {_WORDS}, m AS (SELECT conv_id, seq, seq > 1 AND ends_with(string_agg(word, ' ') OVER (PARTITION BY conv_id ORDER BY seq ROWS 9 PRECEDING), 'the') AS starts FROM w),
r AS (SELECT conv_id, seq, starts, sum(starts::BIGINT) OVER (PARTITION BY conv_id ORDER BY seq)::BIGINT AS run, max(CASE WHEN starts THEN seq END) OVER (PARTITION BY conv_id ORDER BY seq) AS began FROM m)
SELECT conv_id, seq, starts, run, coalesce(seq - began, -1) AS "cursor" FROM r""")
def mode_switch(spark, sf):
    """Where the last ten words of a conversation end with a pattern, and how far each word is behind."""
    w = conversation_words(spark, sf)
    return decode.mode_switch(w, ["conv_id"], "seq", "word", "the").select("conv_id", "seq", "starts", "run", F.coalesce("cursor", F.lit(-1)).alias("cursor"))


def conversation_words(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("at", "word"))
    return words.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "at")).cast("long").alias("seq"), "word")


@query(r"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Answer: ' || replace(text, chr(10), ' ') || '.' WHEN 1 THEN 'x' || chr(10) || 'Answer: ' || split_part(text, chr(10), 1) || '<|im_end|>' || text ELSE text END AS full_text FROM conversations),
h AS (SELECT conv_id, turn, regexp_replace(string_split_regex(full_text, '<\|im_end\|>|<\|end_of_text\|>')[1], '\.\z', '') AS head FROM t)
SELECT conv_id, turn, CASE WHEN regexp_matches(head, 'Answer: ') THEN regexp_extract(head, 'Answer: ([^\n]*)', 1) END AS answer FROM h""")
def extract_answer(spark, sf):
    c = table(spark, sf, "conversations")
    full = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Answer: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("."))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("x\nAnswer: "), F.split("text", "\n", -1)[0], F.lit("<|im_end|>"), "text")
    ).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.extract_answer(full).alias("answer"))


_PAIRS = "p AS (SELECT doc_id, d.text AS a, b.text AS b FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with one benchmark item: doc_id, a (the document), b (the item)."""
    items = table(spark, sf, "benchmark")
    sized = items.join(F.broadcast(items.agg(F.count("*").alias("n"))), F.lit(True))  # one row
    d = table(spark, sf, "documents")
    n = F.broadcast(items.agg(F.count("*").alias("n")))
    keyed = d.join(n, F.lit(True)).select("doc_id", F.col("text").alias("a"), (F.col("doc_id") % F.col("n")).alias("item"))
    return keyed.join(sized.select("item_id", F.col("text").alias("b")), F.col("item") == F.col("item_id")).select("doc_id", "a", "b")


@query(f"WITH {_PAIRS} SELECT doc_id, (lower(a) = lower(b))::INT AS em, (contains(lower(a), lower(b)) OR contains(lower(b), lower(a)))::INT AS im FROM p")
def exact_inclusion_match(spark, sf):
    return pairs(spark, sf).select("doc_id", T.exact_match(F.col("a"), F.col("b")).alias("em"), T.inclusion_match(F.col("a"), F.col("b")).alias("im"))


_SETS = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> ''))"


@query(f"""WITH {_PAIRS}, s AS (SELECT doc_id, {_SETS.format('a')} AS x, {_SETS.format('b')} AS y FROM p)
SELECT doc_id, round(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0), 9) AS jaccard FROM s""")
def word_jaccard(spark, sf):
    return pairs(spark, sf).select("doc_id", F.round(T.word_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query()
def metrics_bleu_rouge(spark, sf):
    """BLEU, METEOR and ROUGE-L of each document against its benchmark item; SQL can't express them."""
    s = scores.answer_scores("b", "a")
    return pairs(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.*")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as predictions: a label's absence is an empty one, quality 0 a "don't know"; tokens are characters, triples labels of toxicity."""
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = F.when(F.col("quality").isNull(), "").when(F.col("quality") == 0, F.concat(F.lit("I don't know "), "source")).otherwise(F.col("lang"))
    rows = d.join(y, "doc_id", "left").select("doc_id", "lang", "source", p.alias("prediction"), F.col("n_chars").alias("new_tokens"), F.coalesce(F.col("toxic"), F.lit(0)).cast("long").alias("n_triples"), (F.col("quality") == 1).cast("int").alias("good"))
    return report.answered_flags(rows)


_FLAGS = """f AS (SELECT doc_id, lang, source, n_chars AS tok, coalesce(toxic, 0) AS tri, (quality = 1)::INT AS good, quality IS NOT NULL AS answered, coalesce(quality = 0, false) AS dk, coalesce(quality <> 0, false) AS fin FROM documents LEFT JOIN labels USING (doc_id))"""
_REPORT = """count(*) AS total, coalesce(sum(answered::BIGINT), 0)::BIGINT AS answered, coalesce(sum(dk::BIGINT), 0)::BIGINT AS dontknow, coalesce(sum(fin::BIGINT), 0)::BIGINT AS final,
  round(coalesce(sum(answered::BIGINT) / nullif(count(*), 0), 0), 9) AS answered_ratio, round(coalesce(sum(dk::BIGINT) / nullif(count(*), 0), 0), 9) AS dontknow_ratio, round(coalesce(sum(fin::BIGINT) / nullif(count(*), 0), 0), 9) AS final_ratio,
  coalesce(sum((tri = 0)::BIGINT), 0)::BIGINT AS no_triples, round(coalesce(sum((fin AND tri = 0)::BIGINT) / nullif(sum(fin::BIGINT), 0), 0), 9) AS final_no_triples_ratio,
  min(tok) AS min_tokens, round(avg(tok), 6) AS avg_tokens, max(tok) AS max_tokens, min(tok) FILTER (WHERE fin) AS min_tokens_final, round(avg(tok) FILTER (WHERE fin), 6) AS avg_tokens_final, max(tok) FILTER (WHERE fin) AS max_tokens_final,
  round(avg(good), 9) AS good, round(avg(good) FILTER (WHERE fin), 9) AS good_final"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6 if c.startswith("avg_tokens") else 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_FLAGS} SELECT {_REPORT} FROM f")
def answered_metrics(spark, sf):
    return rounded(report.overall(predictions(spark, sf), scores=("good",)))


@query(f"""WITH {_FLAGS}, g AS (SELECT 'lang' AS grouping, lang AS value, * FROM f UNION ALL SELECT 'source', source, * FROM f)
SELECT grouping, value, {_REPORT}, round(count(*) / (SELECT count(*) FROM f), 9) AS share FROM g GROUP BY grouping, value""")
def grouped_report(spark, sf):
    return rounded(report.grouped(predictions(spark, sf), ["lang", "source"], scores=("good",)))


@query("SELECT lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def distribution(spark, sf):
    return rounded(report.distribution(table(spark, sf, "documents"), "lang"))


@query("SELECT doc_id, 'n_chars' AS metric, n_chars AS value FROM documents UNION ALL SELECT doc_id, 'n_words', len(string_split(text, ' '))::BIGINT FROM documents")
def unpivot_metrics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ", -1)).cast("long").alias("n_words"))
    return report.unpivot(d, ["doc_id"], ["n_chars", "n_words"])


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark, sf):
    return qa.uniform_sample(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("""WITH c AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang, source),
s AS (SELECT *, floor(total * 0.2 + 0.5)::BIGINT AS size FROM c),
q AS (SELECT lang, source, (n * size) // total AS base, row_number() OVER (ORDER BY (n * size) % total DESC, lang NULLS FIRST, source NULLS FIRST) AS rk, size - sum((n * size) // total) OVER () AS rest FROM s),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, r.lang, r.source FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source WHERE rn <= base + (rk <= rest)::BIGINT""")
def stratified_sample(spark, sf):
    return qa.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", fraction=0.2)


#: Columns that a pivot may have.
COLUMNS = 10_000


def event_types(spark: SparkSession, sf: str) -> list[str]:
    """All event types, which become columns; more than COLUMNS are an error."""
    found = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(COLUMNS + 1).collect()]
    if len(found) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} event types can't be columns")
    return found


#: The event types of the tables, for SQL that can't find out its columns.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"round(arg_min(value, event_id) FILTER (WHERE event_type = '{t}') * 100, 6) AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def pivot_first(spark, sf):
    out = report.pivot_first(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id", event_types(spark, sf), 100.0)
    return out.select(*[F.round(c, 6).alias(c) if c != "user_id" else F.col(c) for c in out.columns])


@query("SELECT user_id, " + ", ".join(f"coalesce((max(event_id) FILTER (WHERE event_type = '{t}'))::VARCHAR, '--') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def pivot_last(spark, sf):
    return report.pivot_last(table(spark, sf, "events"), "user_id", "event_type", "event_id", "event_id", event_types(spark, sf))


@query("""SELECT user_id, event_id, (epoch_us(ts) - epoch_us(before)) / 1e6 AS seconds
FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL""")
def elapsed(spark, sf):
    out = series.elapsed(table(spark, sf, "events"), ["user_id"], "ts", ["ts", "event_id"])
    return out.select("user_id", "event_id", "seconds")


@query("""SELECT user_id, event_id, round(m, 6) AS moving_avg FROM (SELECT user_id, event_id, avg(value) OVER w AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)) WHERE n >= 10""")
def moving_avg_10(spark, sf):
    out = series.moving_average(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 10)
    return out.select("user_id", "event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("""SELECT user_id, event_id, row_number() OVER w - 1 AS position, round(sum(value) OVER w, 5) AS cumsum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumsum(spark, sf):
    out = series.running_sum(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", "event_id", "position", F.round("cumsum", 5).alias("cumsum"))


@query("""SELECT event_type, max(value) AS max, min(value) AS min, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum, count(value) AS num,
  round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY event_type""")
def timing_summary(spark, sf):
    out = series.summary(table(spark, sf, "events"), "value", ["event_type"], (0.75, 0.9, 0.99))
    return out.select("event_type", "max", "min", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"), "num", *[F.round(c, 6).alias(c) for c in ("q75", "q90", "q99")])


@query("""WITH page AS (SELECT c_custkey AS page_id, c_nationkey % 3 AS ns, replace(c_name, '#', '_') AS title, (CASE WHEN c_custkey % 5 = 0 THEN 'P' ELSE 'Q' END) || c_custkey AS item, c_mktsegment AS short FROM customer)
SELECT page_id AS qid, replace(title, '_', ' ') AS title, short AS short_desc FROM page WHERE ns = 0 AND item LIKE 'Q%'""")
def wiki_self_join(spark, sf):
    """Pages joined twice with their properties: item ids and short descriptions."""
    c = table(spark, sf, "customer")
    page = c.select(F.col("c_custkey").alias("page_id"), (F.col("c_nationkey") % 3).alias("page_namespace"), F.translate("c_name", "#", "_").alias("page_title"))
    item = c.select(F.col("c_custkey").alias("pp_page"), F.lit("wikibase_item").alias("pp_propname"), F.concat(F.when(F.col("c_custkey") % 5 == 0, "P").otherwise("Q"), F.col("c_custkey")).alias("pp_value"))
    short = c.select(F.col("c_custkey").alias("pp_page"), F.lit("wikibase-shortdesc").alias("pp_propname"), F.col("c_mktsegment").alias("pp_value"))
    return facts.page_titles(page, item.unionByName(short))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'time' WHEN 2 THEN 'quantity' WHEN 3 THEN 'url' WHEN 4 THEN 'wikibase-item' ELSE 'external-id' END AS dt, string_split(p_type, ' ') AS types FROM part)
SELECT p_partkey FROM p WHERE dt IN ('globe-coordinate', 'quantity', 'string', 'time', 'wikibase-item')
AND NOT list_has_any(types, ['COPPER', 'ECONOMY', 'SMALL'])""")
def prop_filter(spark, sf):
    """Parts as properties: by datatype, and without a type outside those kept."""
    p = table(spark, sf, "part")
    kinds = ["string", "time", "quantity", "url", "wikibase-item", "external-id"]
    datatype = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_size") % 6 + 1).cast("int"))
    props = p.select("p_partkey", datatype.alias("datatype"), F.split("p_type", " ").alias("types"))
    unwanted = F.array(*[F.lit(t) for t in ("COPPER", "ECONOMY", "SMALL")])
    left = props.withColumn("types", F.array_intersect("types", unwanted))
    return facts.keep_properties(left, []).select("p_partkey")


_LABEL_ROWS = """l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Q' ELSE 'P' END AS kind, doc_id // 6 AS id, CASE (doc_id // 2) % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'alt_label' ELSE 'description' END AS what, source AS text FROM documents)"""


@query(f"""WITH {_LABEL_ROWS} SELECT kind, id, max(text) FILTER (WHERE what = 'label') AS label, coalesce(array_to_string(list_sort(list_distinct(list(text) FILTER (WHERE what = 'alt_label'))), ','), '') AS alt_labels,
arg_max(text, doc_id) FILTER (WHERE what = 'description') AS description FROM l GROUP BY kind, id""")
def label_record(spark, sf):
    """Documents as label statements, three for each entity."""
    what = F.element_at(F.array(F.lit("label"), F.lit("alt_label"), F.lit("description")), (F.floor(F.col("doc_id") / 2) % 3 + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Q").otherwise("P").alias("kind"), F.floor(F.col("doc_id") / 6).alias("id"), what.alias("what"), F.col("source").alias("text"))
    return facts.label_records(rows, "doc_id").withColumn("alt_labels", F.array_join("alt_labels", ","))


@query("""SELECT c_custkey AS sub, 27::BIGINT AS prop, c_nationkey::BIGINT AS obj_ent, NULL::VARCHAR AS obj_lit FROM customer
UNION ALL SELECT c_custkey, 1448, -1, c_name FROM customer UNION ALL SELECT c_custkey, 2218, -1, c_acctbal::DECIMAL(18, 2)::VARCHAR FROM customer""")
def ntriples_parse(spark, sf):
    """Statements written as N-Triples lines, good and bad ones, and read back."""
    c = table(spark, sf, "customer")
    e, p = "<http://www.wikidata.org/entity/", "<http://www.wikidata.org/prop/direct/"
    line = lambda prop, obj: F.concat(F.lit(f"{e}Q"), F.col("c_custkey"), F.lit(f"> {p}P{prop}> "), obj, F.lit(" ."))
    good = [
        line(27, F.concat(F.lit(f"{e}Q"), F.col("c_nationkey"), F.lit(">"))), line(1448, F.concat(F.lit('"'), F.col("c_name"), F.lit('"@en'))),
        line(2218, F.concat(F.lit('"'), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#decimal>'))),
    ]
    bad = [line(1448, F.lit('"ein Name"@de')), line(1448, F.lit('"a \\"quoted\\" name"@en')), F.concat(F.lit("# "), good[0])]
    return facts.statements(c.select(F.explode(F.array(*good, *bad)).alias("value"))).withColumn("obj_ent", F.coalesce("obj_ent", F.lit(-1)))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti(spark, sf):
    """Orders that are still to do: those without a returned line."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return report.resume(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT 'conversations' AS data_source, 'user' AS role, text AS content, 'qa' AS ability, 'rule' AS style, role AS ground_truth, conv_id * 1000 + turn AS index, text AS question FROM conversations")
def rl_export(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("question"), F.col("role").alias("answer"))
    r = qa.rl_rows(c, "conversations")
    return r.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style", "reward_model.ground_truth", "extra_info.index", "extra_info.question")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN rf = 'A' THEN 'question' WHEN rf = 'N' THEN '' ELSE 'question, prediction' END AS missing FROM (SELECT *, l_returnflag AS rf FROM lineitem)""")
def judge_skips(spark, sf):
    """Which of the columns that a judge needs are missing."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")).alias("question"), F.col("l_linestatus").alias("answer"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus")).alias("prediction"),
    )
    return report.judge_skips(rows, ["question", "answer", "prediction"]).select("l_orderkey", "l_linenumber", "missing")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', ' || c_mktsegment ELSE c_name END AS answer FROM customer""")
def list_answers(spark, sf):
    """Answers that are lists in text form, read as lists."""
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("['"), "c_name", F.lit("', '"), "c_mktsegment", F.lit("']"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", T.list_text(raw).alias("answer"))


@query("""SELECT n_name AS question, string_agg(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_suppkey::VARCHAR END, ', ' ORDER BY s_suppkey) AS answer,
array_to_string(list_concat(list_sort(list_distinct(list(CASE WHEN s_suppkey % 2 = 0 THEN 'entity' ELSE 'value' END))), CASE WHEN count(*) > 1 THEN ['list'] ELSE [] END), ', ') AS answer_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def qa_web_answers(spark, sf):
    """Suppliers of a nation as the answers of one question: names of entities, and values."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    even = F.col("s_suppkey") % 2 == 0
    answer = F.struct("s_suppkey", F.when(even, "Entity").otherwise("Value").alias("AnswerType"), F.when(even, F.col("s_name")).alias("EntityName"), F.when(even, "id").otherwise(F.col("s_suppkey").cast("string")).alias("AnswerArgument"))
    grouped = s.groupBy("n_name").agg(F.array_sort(F.collect_list(answer)).alias("all"))
    answers = F.transform("all", lambda a: F.struct(a["AnswerType"].alias("AnswerType"), a["EntityName"].alias("EntityName"), a["AnswerArgument"].alias("AnswerArgument")))
    q = F.array(F.struct(F.col("n_name").alias("RawQuestion"), F.array(F.struct(answers.alias("Answers"))).alias("Parses")))
    return qa.web_qsp(grouped.select(q.alias("Questions"))).select("question", "answer", "answer_type")


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, round(CASE k WHEN 0 THEN 0.1 WHEN 1 THEN 0.8 WHEN 2 THEN 0 ELSE 0.8 / 3 END + CASE k WHEN 2 THEN 0 ELSE 0.1 END, 9) AS score FROM c""")
def reward_scores(spark, sf):
    """Rewards: a "don't know", an exact answer, no triples, one word of three shared."""
    k = F.col("c_custkey") % 4
    truth = F.concat(F.lit("alpha "), F.col("c_custkey").cast("string"))
    said = F.when(k == 0, "I don't know").when(k == 1, F.upper(truth)).when(k == 2, truth).otherwise(F.lit("alpha none"))
    score = T.reward(said, truth, F.when(k == 2, 0).otherwise(3), [F.lit(0.25), F.lit(0.0)])
    return table(spark, sf, "customer").select("c_custkey", F.round(score, 9).alias("score"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, TRY_CAST('0x' || substr(hex(encode(text)), 1, 2) AS INT) AS head FROM documents")
def utf8_tokens(spark, sf):
    """Byte tokens of every document: how many, and the first; of an empty text none, of a null one neither."""
    t = tokens.utf8("text")
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(t)).cast("long").alias("n_bytes"), F.get(t, F.lit(0)).alias("head"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM w")
def vocabulary(spark, sf):
    return tokens.vocabulary(table(spark, sf, "benchmark").select(F.split("text", " ", -1).alias("tokens")))


@query("""WITH a AS (SELECT word, row_number() OVER (ORDER BY word) AS r FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark)),
b AS (SELECT word, row_number() OVER (ORDER BY word) AS r FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM conversations))
SELECT (SELECT count(*) FROM a WHERE word NOT IN (SELECT word FROM b)) AS only_a, (SELECT count(*) FROM b WHERE word NOT IN (SELECT word FROM a)) AS only_b,
(SELECT min(coalesce(a.r, b.r)) - 1 FROM a FULL JOIN b ON a.r = b.r WHERE a.word IS DISTINCT FROM b.word) AS same_prefix""")
def vocabulary_difference(spark, sf):
    """Words of two vocabularies that the other lacks, and how many first ids agree."""
    v = {t: tokens.vocabulary(table(spark, sf, t).select(F.split("text", " ", -1).alias("tokens"))) for t in ("benchmark", "conversations")}
    a, b = v["benchmark"].toDF("a", "id"), v["conversations"].toDF("b", "id")
    joined = a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    only = lambda x, y: x.toDF("w", "i").join(y.toDF("w", "j"), "w", "left_anti").agg(F.count("*").alias("n"))
    one, two, same = only(a, b).toDF("only_a"), only(b, a).toDF("only_b"), joined.agg(F.min("id").alias("same_prefix"))
    return one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(same), F.lit(True))  # one row each


@query("""SELECT vec_id, coalesce(list_max(list_transform(range(len(embedding)), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN i ELSE -1 END)), -1)::INT AS last,
CASE WHEN list_position(list_transform(embedding, lambda x: x < -0.2), true) > 0 THEN list_position(list_transform(embedding, lambda x: x < -0.2), true) - 1 ELSE len(embedding) END::BIGINT AS new_tokens FROM embeddings""")
def token_positions(spark, sf):
    """The last filled entry of an array, and how many stand before the first pad."""
    e = table(spark, sf, "embeddings")
    filled, padded = F.transform("embedding", lambda x: F.when(x >= 0, 1).otherwise(-1)), F.transform("embedding", lambda x: F.when(x < F.lit(-0.2).cast("float"), 0).otherwise(1))
    return e.select("vec_id", decode.last_filled(filled).cast("int").alias("last"), decode.new_tokens(padded, 0).cast("long").alias("new_tokens"))


@query(r"""SELECT p_partkey, regexp_extract(p_name, '(\d+)\D*$', 1) AS last_number, 'model ' || p_partkey AS name FROM part""")
def number_and_name(spark, sf):
    """The last number in a text, and a model's name from its file's path."""
    path = F.concat(F.lit("/runs/model_"), F.col("p_partkey"), F.lit("_model.json"))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(T.last_number(F.col("p_name")), F.lit("")).alias("last_number"), T.model_name(path).alias("name"))


@query("""SELECT event_type, n, coalesce(CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN NULL ELSE event_type END, '') AS renamed FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) WHERE event_type <> 'view'""")
def rename_known(spark, sf):
    sums = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("renamed", F.col("event_type"))
    return report.rename_known(sums, "renamed", {"click": "Click", "view": None}, keep_unknown=True)


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S UTC') AS stamp FROM orders")
def utc_stamps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.utc_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@query("""SELECT c_custkey, 'system|Quote facts.' || chr(10) || 'Answer briefly.;user|Who?;assistant|Me.;user|' || c_name AS prompt FROM customer""")
def prompts(spark, sf):
    p = qa.prompt(F.col("c_name"), "Quote facts.", [("Who?", "Me.")], template="{answer_type}", answer_type="Answer briefly.")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(p, lambda m: F.concat_ws("|", m["role"], m["content"])), ";").alias("prompt"))


@query(f"""WITH {_PAIRS} SELECT doc_id AS "Idx", b AS "Question", length(a) AS "Tokens", (lower(a) = lower(b))::INT AS "EM", source_type AS "Type" FROM p JOIN (SELECT doc_id, lang AS source_type FROM documents) USING (doc_id)""")
def answer_frame(spark, sf):
    """A report's first table over documents as predictions."""
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    none = F.lit(None).cast("string")
    rows = pairs(spark, sf).join(lang, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("b").alias("question"), F.col("b").alias("answer"), F.col("a").alias("prediction"), F.col("a").alias("full_prediction"), F.lit(True).alias("final"), F.lit(False).alias("dontknow"),
        T.exact_match(F.col("a"), F.col("b")).alias("em"), T.inclusion_match(F.col("a"), F.col("b")).alias("im"), *[none.alias(c) for c in ("bleu1", "bleu4", "meteor", "rouge_f", "triples")], F.char_length("a").cast("long").alias("new_tokens"), "lang",
    )
    return report.answer_frame(rows, groups=("lang",)).select("Idx", "Question", "Tokens", "EM", "Type")


@query(f"""WITH {STEPS}, e AS (SELECT p, t, count(*) AS n, count(*) FILTER (WHERE nation IN {_USED}) AS used FROM steps GROUP BY p, t)
SELECT array_to_string(p, ' ') AS prefix, string_agg(t || ':' || (n + used), ',' ORDER BY t) AS next FROM e GROUP BY p HAVING sum(used) > 0""")
def merged_maps(spark, sf):
    """Maps of next tokens of two trees added up, where both have the node."""
    seqs = sequences(spark, sf)
    used = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"))
    two = trie.nodes(trie.edges(seqs.join(used, "nation", "left_semi"))).select("key", F.col("next").alias("more"))
    both = trie.nodes(trie.edges(seqs)).join(two, "key")
    return both.select(spaced("key").alias("prefix"), lookup.merge_maps("next", "more").alias("next")).select("prefix", F.expr(_NEXT).alias("next"))


@query("""SELECT doc_id, array_to_string(string_split(text, ' ')[1:k], ' ') AS prefix, k AS depth FROM (SELECT item_id AS doc_id, text, unnest(range(0, len(string_split(text, ' ')))) AS k FROM benchmark)""")
def prefix_function(spark, sf):
    """Prefixes of each item by the SQL table function."""
    udtf.register(spark)
    view = f"factloom_items_{uuid.uuid4().hex}"
    table(spark, sf, "benchmark").select("item_id", F.split("text", " ", -1).alias("tokens")).createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT item_id AS doc_id, array_join(p.prefix, ' ') AS prefix, cast(p.depth AS bigint) AS depth FROM {view}, LATERAL token_prefixes(tokens) p")
    finally:
        spark.catalog.dropTempView(view)  # the plan holds what it read
