"""Mixing sources to target weights by a min-cost flow over membership patterns.

1. Documents are summed by *membership pattern* (the set of sources that a document
   belongs to), with map-side combine. Up to ``max_patterns`` pattern totals are routed on
   the driver. Beyond, quotas are shared out by running sums over the table of sources, and
   patterns that overlap, directly or through others, are routed together in one task: no
   capacity can flow between two such groups, so the flow is the same.
2. Token capacity flows from patterns to source quotas. The r-th copy of a document
   costs more than the one before it (convex), whatever the source. As cost depends on
   the copy number alone, shortest augmenting paths open the copies level by level:
   a max-flow with first copies, extended by one with second copies, and so on.
3. A pattern's flow is spent on its documents in a seeded order: copy r of a document
   covers the words r * pattern size + [start, end) of the pattern's stream; it is taken
   if its midpoint lies inside the flow, and belongs to the source whose part it is in.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlane.llm.common import cut, named, others, ranged, read, running, saved, seeded_digest, word_count
from pairlane.llm.components import components

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_COPIES = 2
SEED = 17


def share(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Split ``budget`` by weight; a share stops at ``most`` times its size, the excess goes on by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    out, full, weight = [0.0] * len(sizes), 0.0, float(sum(weights))
    for n, i in enumerate(order):
        level = (budget - full) / weight
        if most * sizes[i] > level * weights[i]:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        full, weight = full + out[i], weight - weights[i]
    return out


def _taken(amount: float, available: np.ndarray) -> np.ndarray:
    """``amount`` taken from the first entries on."""
    before = np.cumsum(available) - available
    return np.clip(amount - before, 0.0, available)


def route(capacity: list[float], members: list[list[int]], quota: list[float], copies: int) -> list[dict[int, float]]:
    """Min-cost flow from patterns to source quotas; copy level r opens after level r - 1 is exhausted.

    Augmenting paths are searched breadth first over sources, from those that are short of words
    backwards: a source hands on what patterns that belong to both hold in it. One path moves all
    that its narrowest step allows, over any number of patterns at once, so the number of paths
    depends on the sources and not on the patterns.
    """
    sizes = np.array([len(m) for m in members], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    source = np.array([s for m in members for s in m], np.int64)
    pattern = np.repeat(np.arange(len(members)), sizes)
    flow = np.zeros(len(source))
    entries = [np.flatnonzero(source == s) for s in range(len(quota))]
    short, tiny = np.array(quota, np.float64), 1e-9 * max([1.0, *quota])

    def shared(s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the patterns that belong to both sources, in either."""
        _, i, j = np.intersect1d(pattern[entries[s]], pattern[entries[t]], assume_unique=True, return_indices=True)
        return entries[s][i], entries[t][j]

    for _ in range(copies):
        left = np.array(capacity, np.float64)
        while True:
            onto: dict[int, int | None] = {s: None for s in np.flatnonzero(short > tiny).tolist()}
            queue, end = deque(onto), None
            while queue and end is None:
                s = queue.popleft()
                own = pattern[entries[s]]
                if (left[own] > tiny).any():
                    end = s
                    break
                n = sizes[own]
                all_entries = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for t in np.unique(source[all_entries[flow[all_entries] > tiny]]).tolist():
                    if t not in onto:
                        onto[t] = s
                        queue.append(t)
            if end is None:
                break
            path = [end]
            while (following := onto[path[-1]]) is not None:
                path.append(following)
            steps = [shared(s, t) for s, t in zip(path, path[1:], strict=False)]
            own = entries[end]
            amount = min([left[pattern[own]].sum(), short[path[-1]], *[flow[i].sum() for i, _ in steps]])
            took = _taken(amount, left[pattern[own]])
            left[pattern[own]] -= took
            flow[own] += took
            for i, j in steps:
                took = _taken(amount, flow[i])
                flow[i] -= took
                flow[j] += took
            short[path[-1]] -= amount
    return [{s: f for s, f in zip(source[a:b].tolist(), flow[a:b].tolist(), strict=True) if f > 0} for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _order(x: str | None) -> tuple[bool, str]:
    return x is None, x or ""


def spend(patterns: list[tuple[list[str | None], int]], sizes: dict[str | None, int], quota: dict[str | None, float], copies: int) -> list[tuple]:
    """Route the patterns; per pattern: its sources, its size, where each source's part of its flow ends, and its sources' sizes and quotas."""
    patterns = sorted(patterns, key=lambda r: [_order(x) for x in r[0]])
    names = sorted(quota, key=_order)
    index = {x: i for i, x in enumerate(names)}
    flow = route([float(n) for _, n in patterns], [[index[x] for x in p] for p, _ in patterns], [quota[x] for x in names], copies)
    out = []
    for (p, n), f in zip(patterns, flow, strict=True):
        ends, at = [], 0.0
        for x in p:
            at += f.get(index[x], 0.0)
            ends.append((x, at))
        out.append((p, n, ends, [float(sizes[x]) for x in p], [float(quota[x]) for x in p]))
    return out


_KIND = "p array<string>, n long, ends array<struct<source:string,upto:double>>, source_sizes array<double>, targets array<double>"


def _routed_on_driver(patterns: DataFrame, weights: tuple[float, ...], budget: float, copies: int) -> DataFrame:
    got = [(r["_pattern"], r["n"]) for r in patterns.collect()]
    names = sorted({x for p, _ in got for x in p}, key=_order)
    sizes = {x: sum(n for p, n in got if x in p) for x in names}
    weight = [weights[i % len(weights)] for i in range(len(names))]
    quota = dict(zip(names, share([sizes[x] for x in names], weight, budget * sum(n for _, n in got), copies), strict=True)) if names else {}
    return patterns.sparkSession.createDataFrame(spend(got, sizes, quota, copies), _KIND)


def quotas(patterns: DataFrame, weights: tuple[float, ...], budget: float, copies: int) -> DataFrame:
    """(source, size, quota): ``share`` by running sums, for any number of sources."""
    size = patterns.select(F.explode("_pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").cast("double").alias("size"))
    named = running(ranged(size.select("source", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "size"), ["none", "name"]), [], "_part", ["none", "name"], F.lit(1).cast("long"), "nth").drop("_part")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    capped = named.select("source", "size", "nth", weight.alias("w"), (F.lit(float(copies)) * F.col("size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("w"))
    capped = ranged(capped, ["ratio", "nth"])
    capped = running(running(capped, [], "_part", ["ratio", "nth"], F.col("cap"), "full"), [], "_part", ["ratio", "nth"], F.col("w"), "weight")
    whole = patterns.agg((F.sum("n") * F.lit(float(budget))).alias("budget")).crossJoin(named.select(weight.alias("w")).agg(F.sum("w").alias("all")))  # one row
    capped = cut(capped.crossJoin(F.broadcast(whole)))
    level = (F.col("budget") - (F.col("full") - F.col("cap"))) / (F.col("all") - (F.col("weight") - F.col("w")))
    stop = capped.where(F.col("cap") > level * F.col("w")).agg(F.min(F.struct("ratio", "nth", level.alias("level"))).alias("stop"))  # one row
    before = F.col("stop").isNull() | (F.struct("ratio", "nth") < F.struct(F.col("stop.ratio"), F.col("stop.nth")))
    return capped.crossJoin(F.broadcast(stop)).select("source", "size", F.when(before, F.col("cap")).otherwise(F.col("stop.level") * F.col("w")).alias("quota"))


def _routed_by_group(patterns: DataFrame, weights: tuple[float, ...], budget: float, copies: int) -> DataFrame:
    """The routed patterns, each group of overlapping ones in one task."""
    node = lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("null"))
    ends = patterns.select("_pattern", "n", F.explode("_pattern").alias("source")).withColumn("name", node(F.col("source")))
    edges = ends.select(F.concat(F.lit("p"), F.to_json(F.struct("_pattern"))).alias("a"), F.col("name").alias("b"))
    roots = cut(components(edges))
    quota = cut(quotas(patterns, weights, budget, copies).withColumn("name", node(F.col("source"))).drop("source"))
    full = cut(ends.join(quota, "name").join(roots, F.col("name") == F.col("node")))

    def solve(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = spend([(list(p), n) for p, n in {tuple(r["_pattern"]): r["n"] for r in rows}.items()], {r["source"]: int(r["size"]) for r in rows}, {r["source"]: r["quota"] for r in rows}, copies)
        kinds = [pa.list_(pa.string()), pa.int64(), pa.list_(pa.struct([("source", pa.string()), ("upto", pa.float64())])), pa.list_(pa.float64()), pa.list_(pa.float64())]
        columns = [pa.array([[{"source": x, "upto": u} for x, u in r[i]] if i == 2 else r[i] for r in found], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=["p", "n", "ends", "source_sizes", "targets"])

    return full.select("root", "_pattern", "n", "source", "size", "quota").groupBy("root").applyInArrow(solve, _KIND)


def mix_sources(
    docs: DataFrame,
    sources: str = "source",
    size: str = "size",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    max_patterns: int = 4096,
) -> DataFrame:
    """Add ``source_sizes``, ``targets``, ``copies`` and ``parts`` to every document.

    ``sources`` is a string column or an array of strings (overlapping sources); NULL is a
    source of its own and comes last. ``weights`` repeat over the sources by code point.
    ``parts`` lists the source each taken copy counts for; ``copies`` is its length.
    NULL sizes count as 0. A document without any source (empty array) is never taken.
    Rows that agree in key and size are interchangeable; reruns take the same rows. An
    empty table gives an empty result. Up to ``max_patterns`` pattern totals go to the driver;
    more are routed in tasks, one for each group of overlapping patterns, with the same result.
    """
    added = ("source_sizes", "targets", "copies", "parts")
    member = F.col(sources) if isinstance(docs.schema[sources].dataType, T.ArrayType) else F.array(F.col(sources))
    pattern = F.array_sort(F.array_distinct(F.coalesce(member, F.array(F.lit(None).cast("string")))))
    rows = docs.select(F.struct(*map(named, others(docs, *added))).alias("row"), seeded_digest(seed, F.col(key)).alias("_digest"), pattern.alias("_pattern"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()))
    patterns = cut(rows.groupBy("_pattern").agg(F.sum("_size").alias("n")))
    few = patterns.limit(max_patterns + 1).count() <= max_patterns
    table = (_routed_on_driver if few else _routed_by_group)(patterns, weights, budget, max_copies)
    # row numbers split the rows of one key
    order = ["_digest", "_size", "_row"]
    placed = running(ranged(rows.select("_pattern", *order), order), ["_pattern"], "_part", order, F.col("_size"), "_upto")
    rows = rows.join(placed.select("_row", "_upto"), "_row").drop("_row")
    # broadcast only what the driver has counted
    rows = rows.join(F.broadcast(table) if few else table, F.col("_pattern").eqNullSafe(F.col("p")), "left")

    def part(copy):
        middle = copy * F.col("n") + F.col("_upto") - F.col("_size") / 2
        return F.get(F.filter(F.col("ends"), lambda e: (middle <= e["upto"]) & (e["upto"] > 0)), F.lit(0))

    taken = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_copies - 1)), part), lambda e: e.isNotNull())
    rows = rows.withColumn("parts", F.coalesce(F.transform(taken, lambda e: e["source"]), F.array().cast("array<string>")))
    none = F.array().cast("array<double>")
    return rows.select("row.*", F.coalesce("source_sizes", none).alias("source_sizes"), F.coalesce("targets", none).alias("targets"), "parts", F.size("parts").alias("copies"))


def op1_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix_sources(slim)
    return mixed.select(
        "doc_id",
        "size",
        F.col("source_sizes")[0].cast("long").alias("source_size"),
        F.col("targets")[0].alias("target"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, {BUDGET}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source)) AS n FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), f AS (
  SELECT min(n) AS n FROM l WHERE cap > level * w
), t AS (
  SELECT l.source, l.source_size, CASE WHEN f.n IS NULL OR l.n < f.n THEN l.cap ELSE (SELECT level FROM l AS x, f AS y WHERE x.n = y.n) * l.w END AS target FROM l, f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('{SEED}|', coalesce(d.doc_id::VARCHAR, ''))), d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * ((middle <= target AND target > 0)::BIGINT + (source_size + middle <= target AND target > 0)::BIGINT))::BIGINT AS taken
FROM c
"""

QUERIES = {"op1_flow_mix": op1_flow_mix}
ORACLES = {"op1_flow_mix": OP1_SQL}
