"""The path-compressed prefix tree: nodes only where facts part or end, so its size is linear in the facts whatever their length.

Facts are sorted by ranges. How many tokens neighbours share tells all branch nodes: a stack of open nodes goes through the shared lengths of a range, a node closes when a shorter length
comes. What a range needs to know of the others is little: at which lengths nodes are open at its left and right border. These come from one short summary for each range, folded from either side; laid before and
behind the range's own lengths, they make its stack see every node that one of its facts lies under. Facts below a node are counted in each range and added up.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def shared(a: list[str], b: list[str]) -> int:
    """How many parts two facts begin with alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nodes_of(facts: Iterable[list], before: list[int], behind: list[int]) -> Iterator[tuple[int, int, list, int]]:
    """depth, parent's depth, a fact below it and facts below it, of each node that facts of a range lie under; as nodes close, so that only open ones are held.

    facts are sorted. before and behind: lengths at which nodes are open at the borders, ascending. The root has depth 0 and no parent (-1).
    """
    stack = [[0, 0], *([d, 0] for d in before if d)]  # depth and facts of open nodes
    last: list = []

    def close(least: int) -> Iterator[tuple[int, int, list, int]]:
        carried = 0
        while stack[-1][0] > least:
            depth, n = stack.pop()
            n += carried
            if n:
                yield depth, max(stack[-1][0], least), last, n
            carried = n
        if stack[-1][0] < least:
            stack.append([least, 0])
        stack[-1][1] += carried

    for k, fact in enumerate(facts):
        if k:
            yield from close(shared(last, fact))
        last = fact
        stack.append([len(fact), 1])  # a fact ends below all that it shares
    for depth in [*reversed(behind), 0]:
        yield from close(depth)
    if stack[0][1]:
        yield 0, -1, last, stack[0][1]


def written(tokens: Column) -> Column:
    """A sequence as one text, each token closed by character 0, so that texts sort with all that share a beginning side by side, and a text begins with another just if its sequence does. See read()."""
    code = lambda t: F.concat(F.coalesce(F.replace(F.replace(t, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1")), F.lit("\1\3")), F.lit("\0"))
    return F.array_join(F.transform(tokens.cast("array<string>"), code), "")


def read(parts: list[str]) -> list[str | None]:
    """Tokens of the parts of a written text."""
    return [p if "\1" not in p else None if p == "\1\3" else p.replace("\1\1", "\0").replace("\1\2", "\1") for p in parts]


def maximal(texts: Iterable[str], continued: bool) -> Iterator[list[str]]:
    """The distinct ones of sorted written texts that no other continues, in parts. continued: the first text of the next range continues or repeats the last one here."""
    held = None
    for text in texts:
        if held is not None and not text.startswith(held):
            yield held.split("\0")[:-1]
        held = text
    if held is not None and not continued:
        yield held.split("\0")[:-1]


def compressed(sequences: DataFrame) -> DataFrame:
    """node and parent (16-byte digests of the tokens from the root; the root has no parent), depth, label (the tokens from the parent to the node) and numleaves.

    Of sequences(tokens) those count that no other continues, repeats once; null and empty ones are none. A fact is a node with numleaves 1 and nothing below. At most twice as many nodes as facts; without facts none.
    Tokens are text, or of a type that goes into text and back. Sequences move once, each as one text: sorted by ranges, in which repeats and beginnings of a successor are left out. Copies of a sequence may lie in
    several ranges, so none is larger for them. Nodes deeper than
    what a range shares with its neighbours are whole; only the others are added up over ranges.
    """
    kind = sequences.schema["tokens"].dataType.simpleString()
    rows = sequences.where(F.size("tokens") > 0).select(written(F.col("tokens")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    local = lineage.cut(rows.repartitionByRange("text", "copy").sortWithinPartitions("text").select("text", F.spark_partition_id().alias("part")))

    def opened(batches):
        """The part of a range and its texts; None and nothing where it is empty."""
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        return (None, iter(())) if head is None else (head.column(1)[0].as_py(), (x for b in itertools.chain([head], batches) for x in b.column(0).to_pylist()))

    def borders(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                first = b.slice(0, 1) if first is None else first
                last = b.column(0).slice(b.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column(1), first.column(0), last], names=["part", "first", "last"])

    place = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each range
    ends = local.mapInArrow(borders, "part int, first string, last string").withColumn("next", F.lead("first").over(place))
    continued = {r["part"] for r in ends.where(F.startswith("next", "last")).select("part").collect()}

    def summary(batches):
        part, texts = opened(batches)
        first = last = None
        low: list[int] = []  # lengths that none before undercuts, descending
        tail: list[int] = []  # lengths that none behind undercuts, ascending
        for fact in maximal(texts, part in continued):
            if first is None:
                first = fact
            else:
                n = shared(last, fact)
                if not low or n < low[-1]:
                    low.append(n)
                while tail and tail[-1] >= n:
                    tail.pop()
                tail.append(n)
            last = fact
        if first is not None:
            types = {"part": pa.int32(), "low": pa.list_(pa.int32()), "tail": pa.list_(pa.int32()), "first": pa.list_(pa.string()), "last": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, low, tail, first, last), types.values(), strict=True)], names=list(types))

    told = local.mapInArrow(summary, "part int, low array<int>, tail array<int>, first array<string>, last array<string>")
    alike = F.array_position(F.zip_with("last", F.lead("first").over(place), lambda x, y: x.eqNullSafe(y)), False)
    ranges = told.select("part", "low", "tail", (alike - 1).cast("int").alias("border")).orderBy("part").collect()
    before, behind, reach = {}, {}, {}  # reach: no deeper node of a range goes on beyond it
    open_: list[int] = []
    left = 0
    for r in ranges:
        before[r["part"]] = open_
        reach[r["part"]], left = max(left, r["border"] or 0), r["border"] or 0
        least = r["low"][-1] if r["low"] else None
        open_ = sorted({d for d in open_ if least is None or d <= least} | set(r["tail"]))
        open_ = [d for d in open_ if d < (r["border"] or 0)] + ([r["border"]] if r["border"] else [])
    open_ = []
    for r in reversed(ranges):
        behind[r["part"]] = open_ = sorted({d for d in open_ if r["border"] is not None and d < r["border"]} | ({r["border"]} if r["border"] else set()))
        least = r["low"][-1] if r["low"] else None
        open_ = sorted({d for d in open_ if least is None or d <= least} | set(r["low"]))
    digest = lambda parts: hashlib.blake2b("".join(p + "\0" for p in parts).encode(), digest_size=16).digest()

    def scan(at_borders: bool):
        def run(batches):
            part, texts = opened(batches)
            if part not in before:  # all of its facts go on elsewhere
                return
            nodes = (x for x in nodes_of(maximal(texts, part in continued), before[part], behind[part]) if (x[0] <= reach[part]) == at_borders)
            found = ((digest(fact[:d]), digest(fact[:p]) if p >= 0 else None, d, read(fact[max(p, 0) : d]), n) for d, p, fact, n in nodes)
            while some := list(itertools.islice(found, 1000)):
                columns = zip(zip(*some, strict=True), (pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["node", "parent", "depth", "label", "numleaves"])

        return local.mapInArrow(run, "node binary, parent binary, depth int, label array<string>, numleaves long")

    spread = scan(True).groupBy("node", "depth").agg(F.max("parent").alias("parent"), F.first("label").alias("label"), F.sum("numleaves").alias("numleaves"))
    return scan(False).unionByName(spread).withColumn("label", F.col("label").cast(kind))


def expanded(tree: DataFrame) -> int:
    """How many nodes the tree has without compression: the tokens of all labels."""
    return tree.agg(F.coalesce(F.sum(F.size("label")), F.lit(0))).first()[0]


def common(a: str, b: str) -> int:
    """How many characters two texts begin with alike, by comparing slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    high = min(low + step, n)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def widths(sequences: DataFrame) -> DataFrame:
    """depth and edges: how many edges the prefix tree of sequences(tokens) has at each depth. Null and empty sequences are none.

    In sorted order a sequence has edges of its own from where it parts with the one before to its end, so repeats and beginnings of others add nothing. Sequences move once, each as one text, sorted by ranges; what leaves a
    range is where edges begin and end, added up, and its first and last text. No row is made for a token.
    """
    rows = sequences.where(F.size("tokens") > 0).select(written(F.col("tokens")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    local = rows.repartitionByRange("text", "copy").sortWithinPartitions("text").select("text", F.spark_partition_id().alias("part"))
    kind = "part int, first string, last string, depth long, n long"

    def steps(batches):
        part = first = last = None
        change: dict[int, int] = {}  # how many more edges than one depth before
        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                if last is None:
                    part, first, alike = b.column(1)[0].as_py(), text, 0
                else:
                    alike = text.count("\0", 0, common(last, text))
                size = text.count("\0")
                change[alike] = change.get(alike, 0) + 1
                change[size] = change.get(size, 0) - 1
                last = text
        if first is not None:
            k = len(change)
            columns = ([part] * (k + 1), [first] + [None] * k, [last] + [None] * k, [None, *change], [None, *change.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "first", "last", "depth", "n"])

    def borders(batches):
        for b in batches:
            alike = [a.count("\0", 0, common(a, x)) for a, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d for n in alike for d in (0, n)], pa.int64()), pa.array([-1, 1] * len(alike), pa.int64())], names=["depth", "n"])

    told = lineage.cut(local.mapInArrow(steps, kind))
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part"))  # one row for each range
    met = told.where("first is not null").select(before.alias("before"), "first").where("before is not null").mapInArrow(borders, "depth long, n long")
    change = told.where("depth is not null").select("depth", "n").unionByName(met).groupBy("depth").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("depth")  # as many rows as the longest sequence has tokens at most
    level = change.select("depth", F.sum("n").over(order).alias("edges"), F.lead("depth").over(order).alias("end")).where("edges > 0")
    return level.select(F.explode(F.sequence("depth", F.col("end") - 1)).alias("depth"), "edges")
