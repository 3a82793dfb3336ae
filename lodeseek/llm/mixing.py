"""Mixing sources to target weights (problem 9).

Documents are aggregated by the set of sources they belong to. A min-cost flow routes each set's
tokens to the quotas of its sources; every further repetition of the same tokens costs more than the
one before, so documents are repeated only where new ones run out. The flow is then turned into
documents: each set's documents are laid out on a line in a seeded order, and each source takes its
passes and its interval of that line.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.vocabulary import DEFAULT, encoding, shipped
from lodeseek.session import staged

MAX_PATTERNS, BUCKETS = 1_000_000, 4096


def clean_source(source: Column) -> Column:
    """A source's one spelling: lower case, without blanks around it, underscores for hyphens and inner blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str, vocabulary: str | None) -> DataFrame:
    """id, source (one spelling) and tokens of each document and source, once; code points without a vocabulary. Null texts have none."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), clean_source(F.col(f"`{source}`")).alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where("id is not null")
    if vocabulary is None:
        sized = rows.select("id", "source", F.length("t").cast("bigint").alias("tokens"))
    else:
        kind, ranks = dict(rows.dtypes)["id"], shipped(docs.sparkSession, vocabulary)

        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            enc = encoding(ranks.value)
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) for t in b["t"]]})

        sized = rows.mapInPandas(op, f"id {kind}, source string, tokens bigint")
    return sized.groupBy("id", "source").agg(F.max("tokens").alias("tokens"))


class _Network:
    """A flow network with Dinic's algorithm: levels by breadth, then blocking flow by depth."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.cap: list[float] = []

    def arc(self, a: int, b: int, cap: float) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0.0)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.cap.append(c)
        return len(self.head) - 2

    def push(self, source: int, sink: int, eps: float = 1e-6) -> None:
        """Send as much as can be sent."""
        head, cap, out = self.head, self.cap, self.out
        while True:
            level = [-1] * len(out)
            level[source], queue = 0, deque([source])
            while queue:
                x = queue.popleft()
                for e in out[x]:
                    if cap[e] > eps and level[head[e]] < 0:
                        level[head[e]] = level[x] + 1
                        queue.append(head[e])
            if level[sink] < 0:
                return
            at, path, x = [0] * len(out), [], source
            while True:
                if x == sink:
                    least = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= least
                        cap[e ^ 1] += least
                    path, x = [], source
                    continue
                while at[x] < len(out[x]) and not (cap[out[x][at[x]]] > eps and level[head[out[x][at[x]]]] == level[x] + 1):
                    at[x] += 1
                if at[x] < len(out[x]):
                    path.append(out[x][at[x]])
                    x = head[path[-1]]
                elif path:
                    x = head[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def min_cost_flow(supply: list[int], reach: list[dict[int, int]], quota: list[float], layers: list[int]) -> list[dict[int, float]]:
    """Tokens sent from each pattern to each source.

    Pattern p has supply[p] tokens, usable layers[p] times; the j-th time costs j*j a token. It reaches
    source s with at most reach[p][s] tokens; source s takes at most quota[s]. As much as possible is
    sent, as cheaply as possible: only the arcs that feed a pattern cost anything, and a path from the
    feed never comes back to it, so cheapest paths first means one maximum flow for each j in turn.
    """
    n, m = len(supply), len(quota)
    source, sink, net = n + m, n + m + 1, _Network(n + m + 2)
    to = [{s: net.arc(p, n + s, float(c)) for s, c in reach[p].items()} for p in range(n)]
    for s in range(m):
        net.arc(n + s, sink, quota[s])
    for j in range(1, max(layers, default=0) + 1):
        for p in range(n):
            if layers[p] >= j:
                net.arc(source, p, float(supply[p]))
        net.push(source, sink)
    return [{s: net.cap[e ^ 1] for s, e in arcs.items() if net.cap[e ^ 1] > 1e-6} for arcs in to]


class Mix(NamedTuple):
    report: DataFrame
    selection: DataFrame


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_source: str = "source", target_share: str = "target_share", max_repeats: str = "max_repeats", size: int | None = None, seed: int = 7, vocabulary: str | None = DEFAULT, rebalance: bool = False, max_patterns: int = MAX_PATTERNS
) -> Mix:
    """A mix of `size` tokens (as many as all documents have, unless given) in which each source has its target share.

    selection: doc_id, source, times (how often the document is used for that source), tokens.
    report, a row for each target: source (as in `targets`), target_share, max_repeats, documents,
    target_tokens, available_tokens, capacity_tokens (all documents `max_repeats` times), planned_tokens,
    short (the flow can't fill the target, and neither could all the source's documents `max_repeats`
    times by themselves) and, once the selection is read, actual_tokens, actual_share (of the mix) and
    share_of_wanted (of `size`). Sizes are tokens of `vocabulary`, or code points if it is None.

    Where sources fall short the mix is smaller than `size`, and the others keep their share of `size`;
    with `rebalance` they fill what is missing instead, in proportion to their shares, as far as their
    documents reach.

    A document of several sources counts for each; it is used at most the largest `max_repeats` of its
    sources in all. Documents of a source without a target, or without a source, only count towards
    the total. Repeated rows count once; null ids are left out, null texts have no tokens; targets with
    null share or repeats get none. Empty tables give an empty selection and zero figures.

    The driver holds one row for each set of sources that occurs and one for each target, not one for
    each document; more than `max_patterns` of either are an error, nothing is left out.
    """
    spark = docs.sparkSession
    counts = staged(token_counts(docs, doc_id, text, source, vocabulary), "tokens")
    wanted = [(r[0], r[1], float(r[2] or 0), int(r[3] or 0)) for r in targets.select(F.col(f"`{target_source}`"), clean_source(F.col(f"`{target_source}`")), F.col(f"`{target_share}`"), F.col(f"`{max_repeats}`")).where(F.col(f"`{target_source}`").isNotNull()).distinct().orderBy(F.col(f"`{target_source}`")).limit(max_patterns + 1).collect()]
    if len(wanted) > max_patterns:
        raise ValueError(f"there are more than {max_patterns} targets")
    place = {w[1]: k for k, w in enumerate(wanted)}
    known = F.create_map(*(x for k, w in enumerate(wanted) for x in (F.lit(w[1]), F.lit(k)))) if wanted else F.create_map().cast("map<string,int>")
    member = F.try_element_at(known, F.coalesce("source", F.lit("")))
    units = staged(counts.withColumn("m", member).groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("pattern"), F.max("tokens").alias("tokens")), "units")
    sets = units.groupBy("pattern").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
    if len(sets) > max_patterns:
        raise ValueError(f"documents belong to more than {max_patterns} different sets of sources")
    total = size if size is not None else sum(int(r.tokens or 0) for r in sets)
    sets = [r for r in sets if r.pattern]
    quota = [w[2] * total for w in wanted]
    supply, limit = [int(r.tokens) for r in sets], [max(wanted[s][3] for s in r.pattern) for r in sets]
    reach = [{s: int(r.tokens) * wanted[s][3] for s in r.pattern} for r in sets]
    flow = min_cost_flow(supply, reach, quota, limit)
    planned = [sum(f.get(k, 0.0) for f in flow) for k in range(len(wanted))]
    unfilled = [planned[k] < quota[k] - 1e-3 for k in range(len(wanted))]
    room = list(quota)
    while rebalance and (missing := total - sum(planned)) > 1 and any(open_ := [w[2] > 0 and planned[k] >= room[k] - 1e-3 for k, w in enumerate(wanted)]):
        whole = sum(w[2] for k, w in enumerate(wanted) if open_[k])
        room = [room[k] + missing * w[2] / whole if open_[k] else planned[k] for k, w in enumerate(wanted)]
        flow = min_cost_flow(supply, reach, room, limit)
        planned = [sum(f.get(k, 0.0) for f in flow) for k in range(len(wanted))]
    rows, intervals = [], []
    for k, w in enumerate(wanted):
        own = [r for r in sets if k in r.pattern]
        have = sum(int(r.tokens) for r in own)
        rows.append((w[0], w[2], w[3], sum(int(r.docs) for r in own), quota[k], have, have * w[3], float(planned[k]), unfilled[k] and have * w[3] < quota[k]))
    for r, f in zip(sets, flow, strict=True):
        at, tokens = 0.0, float(r.tokens)
        for s, x in sorted(f.items()):
            passes, rest = divmod(x, tokens)
            if tokens - rest < 0.5:
                passes, rest = passes + 1, 0.0
            intervals.append((r.pattern, s, int(passes), at % tokens, rest, tokens))
            at += rest
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents bigint, target_tokens double, available_tokens bigint, capacity_tokens bigint, planned_tokens double, short boolean")
    selection = _select(units, spark.createDataFrame(intervals, "pattern2 array<int>, s int, passes int, at double, rest double, whole double"), seed)
    names = spark.createDataFrame([(k, w[0]) for k, w in enumerate(wanted)], "s int, source string")
    selection = selection.join(names, "s").select(F.col("id").alias(doc_id), "source", "times", (F.col("times") * F.col("tokens")).alias("tokens"))
    actual = selection.groupBy(F.col("source").alias("source2")).agg(F.sum("tokens").alias("actual_tokens"))
    report = report.join(actual, F.col("source") == F.col("source2"), "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0))).drop("source2")
    report = report.withColumn("actual_share", F.when(F.lit(total) > 0, F.col("actual_tokens") / F.greatest(F.sum("actual_tokens").over(Window.partitionBy()), F.lit(1))).otherwise(0.0)).withColumn("share_of_wanted", F.col("actual_tokens") / F.lit(max(float(total), 1.0)))
    return Mix(report, selection)


def _select(units: DataFrame, intervals: DataFrame, seed: int) -> DataFrame:
    """How often each document is used for each source. Positions on a pattern's line are prefix sums over buckets of the seeded order, so a large pattern is many small tasks."""
    h = F.xxhash64("id", F.lit(seed))
    lined = units.where(F.size("pattern") > 0).withColumns({"h": h, "bucket": F.pmod(F.shiftrightunsigned(h, 20), F.lit(BUCKETS))})
    sums = lined.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select(F.col("pattern").alias("p3"), F.col("bucket").alias("b3"), (F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = lined.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, (F.col("pattern") == F.col("p3")) & (F.col("bucket") == F.col("b3")))
    placed = placed.withColumn("x", F.col("before") + F.col("inside") + F.col("tokens") / 2)
    turned = F.pmod(F.col("x") - F.col("at") + F.col("whole"), F.col("whole"))
    joined = placed.join(intervals, F.col("pattern") == F.col("pattern2"))
    return joined.withColumn("times", F.col("passes") + F.when(turned < F.col("rest"), 1).otherwise(0)).where("times > 0").select("id", "s", "times", "tokens")
