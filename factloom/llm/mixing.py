"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network routes
each pattern's words to the quotas of its sources. A pattern offers its words once for nothing, a second
time at a cost and a third time at a higher one (convex repetition costs), so no document is used a second
time while another that could serve is unused. What the flow takes from a pattern is then drawn from its documents:
all of them as often as fits whole, and the rest in the order of a seeded digest of the key, with one
more document that closes the gap best. Reruns draw the same documents.

Since repetition costs lie on the patterns alone, the cheapest flow is found tier by tier: first uses are routed
as far as they go, then second ones are added, then third ones, each by blocking flows over levels (an augmenting path never takes
a use back, it only moves it to another source). The network is solved on the driver, which holds a row for each pattern. Sums, cuts and draws
are Spark aggregations; no document passes through the driver. What was decided has a row for each pattern; it is
broadcast up to `BROADCAST_ROWS` of them, beyond that Spark joins it as it sees fit.

Defined results: null or blank texts have size 0 and take 0; a null source is a source of its own, last in
order; rows with the same key are drawn together or not at all; of rows that differ as little from a gap, the one with the first
digest fills it; an empty table gives an empty result; extra columns are kept, except that `mix` replaces those named as
its outputs (pattern, pattern_size, flow, copies, taken); `repeat` keeps every column as it is.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words

SEED = "mix-1"
REPEATS = 3
#: Cost of a word's first, second and third use.
COSTS = (0, 1, 3)
WEIGHTS = (1, 2, 3)
#: Hex digits of the digest that number the buckets in which sums are kept.
BUCKET_DIGITS = 3
BROADCAST_ROWS = 100_000
LEAST = 1e-6


def with_size(df: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """df without `text`, with the number of its words."""
    keep, body = [c for c in df.columns if c not in (text, size)], shared.fresh(df, "__text")

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        _, _, before = words.bounds(*words.flat(part.column(body)))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(before), pa.int64())], names=[*keep, size])

    def run(batches):
        for part in shared.chunks(batches, body):
            yield count(part)

    return shared.in_arrow(df.select(*shared.columns(keep), *(c.alias(body) for c in shared.columns([text]))), run, f"{shared.ddl(df, keep)}`{size}` long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares by weight of all words; a source stops at `repeats` times its size and the others share the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > repeats * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


class Network:
    """Patterns and sources with the arcs between them (a pattern reaches its sources without limit), and the flow on each arc."""

    def __init__(self, patterns: list[tuple], quotas: dict):
        number = {s: k for k, s in enumerate(quotas)}
        self.pattern = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        self.source = np.array([number[s] for p in patterns for s in p], np.int64)
        self.first = np.searchsorted(self.pattern, np.arange(len(patterns) + 1)).tolist()  # arcs of each pattern
        self.into = np.argsort(self.source, kind="stable")
        self.into_first = np.searchsorted(self.source[self.into], np.arange(len(quotas) + 1)).tolist()  # in `into`: arcs of each source
        self.flow = np.zeros(len(self.source))
        self.need = np.array([float(q) for q in quotas.values()])

    def levels(self, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Steps from patterns with room to each pattern and source, and to the nearest source in need (-1: none is reached)."""
        of_pattern, of_source = np.where(room > LEAST, 0, -1), np.full(len(self.need), -1)
        step = 0
        while True:
            reached = np.unique(self.source[of_pattern[self.pattern] == step])
            reached = reached[of_source[reached] < 0]
            of_source[reached] = step + 1
            if (self.need[reached] > LEAST).any() or not len(reached):
                return of_pattern, of_source, step + 1 if len(reached) else -1
            back = self.pattern[(of_source[self.source] == step + 1) & (self.flow > LEAST)]
            of_pattern[back[of_pattern[back] < 0]] = step + 2
            step += 2

    def block(self, room: np.ndarray, of_pattern: np.ndarray, of_source: np.ndarray, last: int) -> None:
        """Adds a blocking flow: along shortest paths until each has an arc that is used up."""
        start, room, need, flow = np.flatnonzero(room > LEAST).tolist(), room.tolist(), self.need.tolist(), self.flow.tolist()
        pattern, source, into = self.pattern.tolist(), self.source.tolist(), self.into.tolist()
        of_pattern, of_source = of_pattern.tolist(), of_source.tolist()
        at, into_at = self.first[:-1], self.into_first[:-1]  # copies: the next arc that each has to try
        for p0 in start:
            while room[p0] > LEAST:
                path, p = [], p0
                while True:
                    s = -1
                    for e in range(at[p], self.first[p + 1]):
                        if of_source[source[e]] == of_pattern[p] + 1:
                            s = source[e]
                            break
                        at[p] = e + 1
                    if s < 0:  # p leads nowhere; its source has to try another pattern
                        if not path:
                            break
                        into_at[source[path.pop()]] += 1
                        p = pattern[path.pop()]
                        continue
                    path.append(at[p])
                    if of_source[s] == last:
                        if need[s] > LEAST:
                            break
                        at[p] += 1
                        path.pop()
                        continue
                    for k in range(into_at[s], self.into_first[s + 1]):
                        e = into[k]
                        if flow[e] > LEAST and of_pattern[pattern[e]] == of_source[s] + 1:
                            break
                        into_at[s] = k + 1
                    else:
                        at[p] += 1
                        path.pop()
                        continue
                    path.append(into[into_at[s]])
                    p = pattern[path[-1]]
                if not path:
                    break
                s = source[path[-1]]
                push = min(room[p0], need[s], *(flow[e] for e in path[1::2]))
                room[p0] -= push
                need[s] -= push
                for k, e in enumerate(path):
                    flow[e] += -push if k % 2 else push
        self.need, self.flow = np.array(need), np.array(flow)
        self.room = np.array(room)


def min_cost_flow(supply: dict, quotas: dict, costs=COSTS) -> dict:
    """supply: {pattern (a tuple of sources): words}. Returns {(pattern, source): words} of the largest flow at the least cost;
    a pattern's words may be used len(costs) times, at costs that don't fall."""
    if any(a > b for a, b in zip(costs, costs[1:], strict=False)):
        raise ValueError("costs of repetition must not fall")
    patterns = list(supply)
    net = Network(patterns, quotas)
    for _ in costs:
        net.room = np.array([float(supply[p]) for p in patterns])
        while len(patterns):
            of_pattern, of_source, last = net.levels(net.room)
            if last < 0:
                break
            net.block(net.room, of_pattern, of_source, last)
    return {(patterns[p], s): x for p, s, x in zip(net.pattern.tolist(), (s for p in patterns for s in p), net.flow.tolist(), strict=True)}


def pattern_of(sources: Column) -> Column:
    name = F.transform(F.array_sort(F.array_distinct(sources)), lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null")))
    return F.array_join(name, "\x1f")


def digest_of(key: Column, seed: str) -> Column:
    """The seeded digest that orders the rows of a pattern."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def decide(df: DataFrame, key: str = "doc_id", size: str = "size", sources: str = "sources", quotas=None, seed: str = SEED, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """For each pattern: pattern_size, flow (the words it should give), whole (how often all of its rows are taken),
    and which rows are taken once more: those whose digest is up to `cut`, and the one at `fill`. `sources` is
    an array column; `quotas` maps source to words, or is None for shares by weight. df is read several times
    and should be a written table."""
    spark = df.sparkSession
    k, n, of = shared.columns([key, size, sources])
    rows = df.select(n.alias("size"), of.alias("of"), pattern_of(of).alias("pattern"), digest_of(k, seed).alias("h")).withColumn("b", F.substring("h", 1, bucket_digits))
    sums = shared.written(rows.groupBy("pattern", "b").agg(F.sum("size").alias("s"), F.first("of").alias("of")), "mix-sums")
    total = sums.groupBy("pattern").agg(F.sum("s").alias("n"), F.first("of").alias("of")).collect()  # a row for each pattern
    known = {r["pattern"]: (tuple(sorted(set(r["of"]), key=lambda s: (s is None, s or ""))), r["n"] or 0) for r in total}
    if quotas is None:
        of_source: dict = defaultdict(int)
        for names, words_ in known.values():
            for s in names:
                of_source[s] += words_
        quotas = targets(of_source)
    flow: dict = defaultdict(float)
    for (names, _), x in min_cost_flow({names: words_ for names, words_ in known.values()}, quotas).items():
        flow[names] += x
    plan = []
    for name, (names, words_) in known.items():
        whole = min(int(flow[names] / words_ + 1e-9), len(COSTS)) if words_ else 0
        plan.append((name, words_, float(flow[names]), whole, max(0.0, flow[names] - whole * words_)))
    small = F.broadcast if len(plan) <= BROADCAST_ROWS else lambda x: x
    plan = spark.createDataFrame(plan, "pattern string, pattern_size long, flow double, whole long, want double")
    # the bucket in which the running sum passes what is wanted, then the cut inside it
    along = Window.partitionBy("pattern").orderBy("b")
    run = sums.select("pattern", "b", "s", (F.sum("s").over(along) - F.col("s")).alias("before")).join(small(plan), "pattern")
    edge = run.where((F.col("before") <= F.col("want")) & (F.col("before") + F.col("s") > F.col("want"))).select("pattern", "b", "before", "want")
    inside = rows.join(small(edge), ["pattern", "b"]).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("h")))
    last = inside.where(F.col("upto") <= F.col("want")).groupBy("pattern").agg(F.max("h").alias("last"))
    cut = plan.join(edge.select("pattern", F.col("b").alias("edge")), "pattern", "left").join(last, "pattern", "left")
    cut = shared.written(cut.withColumn("cut", F.coalesce("last", "edge", F.lit("g"))), "mix-cuts")  # "g" is after every digest: the whole pattern is wanted
    taken = rows.join(small(cut.select("pattern", "cut", "want")), "pattern")
    gap = taken.groupBy("pattern").agg(F.first("want").alias("want"), F.sum(F.when(F.col("h") <= F.col("cut"), F.col("size")).otherwise(0)).alias("got"))
    gap = gap.select("pattern", (F.col("want") - F.col("got")).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    fill = taken.join(small(gap), "pattern").where((F.col("h") > F.col("cut")) & (off < F.col("gap")))
    fill = fill.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "h")).alias("fill")).select("pattern", F.col("fill.h").alias("fill"))
    return shared.written(cut.join(fill, "pattern", "left").select("pattern", "pattern_size", "flow", "whole", "cut", "fill"), "mix-decided")


def drawn(df: DataFrame, decided: DataFrame, key: str, sources: str, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """df with what was decided on each row's pattern and `copies`, under names that df doesn't have; and these names."""
    made = {c: shared.fresh(df, f"__mix_{c}") for c in (*decided.columns, "h", "copies")}
    k, of = shared.columns([key, sources])
    small = F.broadcast if decided.count() <= BROADCAST_ROWS else lambda x: x
    out = df.withColumns({made["pattern"]: pattern_of(of), made["h"]: digest_of(k, seed)})
    out = out.join(small(decided.select([F.col(c).alias(made[c]) for c in decided.columns])), made["pattern"])
    extra = (F.col(made["h"]) <= F.col(made["cut"])) | F.coalesce(F.col(made["h"]) == F.col(made["fill"]), F.lit(False))
    copies = F.least(F.col(made["whole"]) + F.when(extra, 1).otherwise(0), F.lit(len(COSTS))).cast("long")
    return out.withColumn(made["copies"], copies), made


def mix(df: DataFrame, key: str = "doc_id", size: str = "size", sources: str = "sources", quotas=None, seed: str = SEED, **how) -> DataFrame:
    """df with `pattern`, `pattern_size`, `flow`, `copies` (how often the row is taken) and `taken` (words)."""
    out, made = drawn(df, decide(df, key, size, sources, quotas, seed, **how), key, sources, seed)
    names = ["pattern", "pattern_size", "flow", "copies"]
    taken = (F.col(made["copies"]) * shared.columns([size])[0]).alias("taken")
    return out.select(*shared.columns([c for c in df.columns if c not in (*names, "taken")]), *[F.col(made[c]).alias(c) for c in names], taken)


def repeat(df: DataFrame, decided: DataFrame, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of df, each as often as it is taken, with df's columns as they are. Each row belongs to one source."""
    of = shared.fresh(df, "__mix_sources")
    out, made = drawn(df.withColumn(of, F.array(*shared.columns([source]))), decided, key, of, seed)
    copy = F.explode(F.sequence(F.lit(1), F.col(made["copies"]).cast("int")))
    return out.where(F.col(made["copies"]) > 0).withColumn(made["copies"], copy).select(*shared.columns(df.columns))


def sized(df: DataFrame) -> DataFrame:
    """The keys, sources and sizes of documents, written once because mix() reads them several times."""
    return shared.written(with_size(df.select("doc_id", "text", "source")).withColumn("sources", F.array("source")), "mix-sizes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized(shared.documents(spark, sf_dir)))
    return out.select("doc_id", "size", F.col("pattern_size").alias("source_size"), F.round("flow", 3).alias("target"), "taken")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w FROM d GROUP BY source
), ratio AS (
  SELECT *, {REPEATS} * source_size / w AS r, row_number() OVER (ORDER BY {REPEATS} * source_size / w, source) AS k FROM s
), level AS (  -- the common share a weight, once the first k-1 sources are full
  SELECT k, r, ((SELECT sum(source_size) FROM s) - coalesce(sum({REPEATS} * source_size) OVER before, 0))
              / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0)) AS share
  FROM ratio WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least({REPEATS} * source_size, w * (SELECT share FROM level WHERE share <= r ORDER BY k LIMIT 1))::DOUBLE AS target FROM ratio
), plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size + 1e-9) END AS whole,
         greatest(0, target - (CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size + 1e-9) END) * source_size) AS want FROM t
), run AS (
  SELECT d.doc_id, d.size, d.h, p.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) <= p.want AS hit
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), gap AS (
  SELECT source, any_value(want) - coalesce(sum(size) FILTER (hit), 0) AS gap FROM run GROUP BY source
), fill AS (
  SELECT r.source, min_by(r.h, {{'a': abs(r.size - g.gap), 'h': r.h}}) AS fill
  FROM run r JOIN gap g ON r.source IS NOT DISTINCT FROM g.source
  WHERE NOT r.hit AND abs(r.size - g.gap) < g.gap GROUP BY r.source
)
SELECT r.doc_id, r.size, r.source_size, round(r.target, 3) AS target,
       (r.size * least(r.whole + CASE WHEN r.hit OR coalesce(r.h = f.fill, false) THEN 1 ELSE 0 END, {REPEATS}))::BIGINT AS taken
FROM run r LEFT JOIN fill f ON r.source IS NOT DISTINCT FROM f.source
"""
