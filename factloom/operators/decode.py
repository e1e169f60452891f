"""Constrained decoding over given scores: mode switch, masks, greedy steps, walks, beams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage, trie

#: Edges of one prefix that a join may bring together, about; taken edges up to which they are sent to all tasks.
WIDE, FEW = 20_000, 100_000


def mode_switch(tokens: DataFrame, keys: list[str], order: str, token: str, pattern: str, width: int = 10, joiner: str = " ") -> DataFrame:
    """keys, order, token, starts (the last width tokens, this one included, end with the pattern), run (how many starts so far) and cursor (tokens since the last start).

    The first token of a key, its prompt, never starts a run. cursor is null before the first start.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    tail = F.array_join(F.collect_list(token).over(w.rowsBetween(1 - width, 0)), joiner)
    marked = tokens.withColumn("place", F.row_number().over(w))
    marked = marked.withColumn("starts", F.when(F.col("place") == 1, F.lit(False)).otherwise(tail.endswith(pattern)))
    marked = marked.withColumn("run", F.sum(F.col("starts").cast("long")).over(w))
    began = F.max(F.when(F.col("starts"), F.col("place"))).over(w)
    return marked.select(*keys, order, token, "starts", "run", (F.col("place") - began).cast("long").alias("cursor"))


def constrained_part(tokens: Column, cursor: Column) -> Column:
    """The last cursor tokens of an array."""
    return F.when(cursor > 0, F.slice(tokens, F.greatest(F.size(tokens) - cursor + 1, F.lit(1)), F.greatest(cursor, F.lit(0)))).otherwise(F.slice(tokens, 1, 0))


def mask(scores: DataFrame, allowed: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """Scores of allowed tokens only."""
    return scores.join(allowed.select(*keys, token), [*keys, token], "left_semi")


def argmax(scores: DataFrame, keys: list[str], token: str = "token", score: str = "score") -> DataFrame:
    """The best token of each state; of equal scores the smallest token. Partial maxima before the shuffle."""
    best = F.max(F.struct(F.col(score), (-F.col(token)).alias("t")))
    return scores.groupBy(*keys).agg(best.alias("best")).select(*keys, (-F.col("best.t")).alias(token), F.col(f"best.{score}").alias(score))


def top_beams(scores: DataFrame, batch: str, beams: int, token: str = "token", score: str = "score") -> DataFrame:
    """The best beams continuations of each batch over all its beams: batch, beam (the rank), parent, token, score. scores has batch, beam, token, score."""
    w = Window.partitionBy(batch).orderBy(F.desc(score), "beam", token)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beams).select(batch, (F.col("rank") - 1).alias("new_beam"), F.col("beam").alias("parent"), token, score).withColumnRenamed("new_beam", "beam")


def permute_beams(states: DataFrame, parents: DataFrame, batch: str = "batch") -> DataFrame:
    """Each beam takes over its parent's state, within its batch. states(batch, beam, ...), parents(batch, beam, parent)."""
    rest = [c for c in states.columns if c not in (batch, "beam")]
    old = states.select(F.col(batch), F.col("beam").alias("parent"), *rest)
    return parents.select(batch, "beam", "parent").join(old, [batch, "parent"]).select(batch, "beam", *rest)


def grid(index: Column, beams: int) -> tuple[Column, Column]:
    """Batch and beam of a flat state index."""
    return F.floor(index / beams).cast("long"), F.pmod(index, F.lit(beams)).cast("long")


def reset(states: DataFrame, batch: int | str) -> DataFrame:
    """States of a new batch: the same beams, nothing generated, no pattern met, no fact used. Batches are keys, so no state of an earlier one is touched."""
    return states.select(F.lit(batch).alias("batch"), "beam", F.lit(-1).cast("long").alias("cursor"), F.lit(0).cast("long").alias("run"), F.expr("slice(array(''), 1, 0)").alias("used"))


def last_filled(array: Column, empty: int = -1) -> Column:
    """Position (from 0) of the last entry that isn't empty; -1 if there is none."""
    at = F.transform(array, lambda x, i: F.when(x != empty, i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(at), F.lit(-1))


def new_tokens(tokens: Column, pad: int) -> Column:
    """Tokens before the first pad."""
    at = F.array_position(tokens, F.lit(pad))
    return F.when(at > 0, at - 1).otherwise(F.size(tokens).cast("long"))


def yes_no(scores: DataFrame, keys: list[str], yes: list[int], no: list[int], token: str = "token") -> DataFrame:
    """yes or no for each state, by the best of the allowed tokens."""
    best = argmax(scores.where(F.col(token).isin(*yes, *no)), keys, token)
    return best.withColumn("decision", F.when(F.col(token).isin(*yes), "yes").otherwise("no"))


def greedy_walk(edge: DataFrame) -> DataFrame:
    """From the root, always to the child with the most leaves (of equals the smallest token): tokens of the walk, one row for each step, down to a leaf.

    One child of each node survives the first aggregation; each step is then one equi-join over all walks.
    """
    best = edge.groupBy("prefix", "depth").agg(F.max("numleaves").alias("top"))
    child = lineage.cut(edge.join(best, ["prefix", "depth"]).where("numleaves = top").groupBy("prefix", "depth").agg(F.min("next_token").alias("next_token"), F.max("top").alias("numleaves")))
    spark = edge.sparkSession
    steps = (child.agg(F.max("depth")).first()[0] or 0) + 1
    view = f"factloom_child_{uuid.uuid4().hex}"
    child.createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
        WITH RECURSIVE walk(step, tokens, numleaves) MAX RECURSION LEVEL {steps + 2} AS (
          SELECT 1, array(next_token), numleaves FROM {view} WHERE depth = 0
          UNION ALL
          SELECT step + 1, array_append(tokens, next_token), c.numleaves
          FROM walk w JOIN {view} c ON c.prefix = w.tokens)
        SELECT step, tokens, numleaves FROM walk""")
    finally:
        spark.catalog.dropTempView(view)  # the plan holds what it read


def _in_lots(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edge with lot, so that no prefix and lot have many more than WIDE edges; and lots of each prefix that has several: a row for every WIDE edges at most."""
    sizes = edge.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > WIDE)
    wide = lineage.cut(sizes.select("prefix", F.ceil(F.col("n") / WIDE).cast("int").alias("lots")))
    lot = F.pmod(F.xxhash64("next_token"), F.coalesce("lots", F.lit(1))).cast("int")
    return lineage.cut(edge.join(F.broadcast(wide), "prefix", "left").withColumn("lot", lot).drop("lots")), wide


def constrained_decode(states: DataFrame, leaves: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """Decode facts for every state(state, n) at once: up to n facts each, without repeats, scores from the md5 of seed, state, step and token (the least is best).

    If states has initial, an array of tokens, each fact of the state begins with them; a token of it that isn't allowed ends the state as REFUSED.

    All states advance one token a step by an equi-join of their prefix with the edges, less what their own emitted facts take away;
    a fact that ends is emitted and its state starts anew. What an emitted fact takes is added to a table of its own, so that a step reads each fact's edges only once;
    options meet only the edges that are taken up. Prefixes with many edges, such as the root, are met in lots.
    Stops after steps at most, or when no state is left. Returns state, ordinal, tokens, status: COMPLETE, EXHAUSTED for a state that has no continuation left,
    REFUSED, or UNFINISHED for what a state still live after the last step has got so far.
    """
    edge, wide = _in_lots(lineage.cut(trie.edges(leaves, leaves=True).select("prefix", "next_token", "numleaves")))
    whole = leaves.select(F.col("tokens").alias("grown"), F.lit(True).alias("whole"))
    nothing = F.expr("slice(array(''), 1, 0)")
    initial = F.coalesce("initial", nothing) if "initial" in states.columns else nothing
    live = states.select("state", "n", initial.alias("initial"), nothing.alias("prefix"), F.lit(0).alias("done")).where("n > 0")
    forced = F.when(F.size("prefix") < F.size("initial"), F.get("initial", F.size("prefix")))
    out: list[DataFrame] = []
    taken = closed = None
    for step in range(steps):
        spread = live.join(F.broadcast(wide), "prefix", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
        options = spread.join(edge, ["prefix", "lot"]).where(forced.isNull() | (forced == F.col("next_token")))
        if closed is not None:
            options = options.join(closed, ["state", "prefix", "next_token"], "left_anti")
        score = F.md5(F.concat_ws(":", F.lit(seed), "state", F.lit(step), "next_token"))
        chosen = options.groupBy("state").agg(F.min_by("next_token", F.struct(score.alias("s"), F.col("next_token").alias("t"))).alias("token"))
        moved = live.join(chosen, "state", "left").withColumn("grown", F.when(F.col("token").isNotNull(), F.concat("prefix", F.array("token"))).otherwise(F.col("prefix")))
        moved = lineage.cut(moved.join(whole, "grown", "left").withColumn("ends", F.coalesce(F.col("whole") & F.col("token").isNotNull(), F.lit(False))))
        status = F.when(F.col("token").isNotNull(), "COMPLETE").when(forced.isNotNull(), "REFUSED").otherwise("EXHAUSTED")
        out.append(moved.where("ends or token is null").select("state", F.col("done").alias("ordinal"), F.col("grown").alias("tokens"), status.alias("status")))
        emitted = moved.where("ends").select("state", F.col("grown").alias("tokens"))
        if not emitted.isEmpty():
            steps_of = emitted.select("state", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("k"))
            new = steps_of.select("state", F.slice("tokens", F.lit(1), F.col("k")).alias("prefix"), F.element_at("tokens", F.col("k") + 1).alias("next_token"), F.lit(1).cast("long").alias("gone"))
            taken = lineage.cut((new if taken is None else taken.unionByName(new)).groupBy("state", "prefix", "next_token").agg(F.sum("gone").alias("gone")))
            closed = lineage.cut(taken.join(edge, ["prefix", "next_token"]).where("gone >= numleaves").select("state", "prefix", "next_token"))
            if closed.count() <= FEW:
                closed = F.broadcast(closed)
        live = moved.where("token is not null").select("state", "n", "initial", F.when(F.col("ends"), nothing).otherwise(F.col("grown")).alias("prefix"), (F.col("done") + F.col("ends").cast("int")).alias("done")).where("done < n")
        if live.isEmpty():
            break
    rest = live.select("state", F.col("done").alias("ordinal"), F.col("prefix").alias("tokens"), F.lit("UNFINISHED").alias("status"))
    for part in out:
        rest = rest.unionByName(part)
    return rest
