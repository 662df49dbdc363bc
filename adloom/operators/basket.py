"""Basket mining on weighted distinct baskets: frequency, co-occurrence, similarity, rules, stacks, networks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.session import checkpointed


def item_frequency(baskets: DataFrame) -> DataFrame:
    """``(skill, jobs, pct)``: baskets with each item and their share of all baskets in percent."""
    total = baskets.agg(F.sum("weight")).scalar()
    return (
        baskets.select(F.explode("basket").alias("skill"), "weight")
        .groupBy("skill")
        .agg(F.sum("weight").alias("jobs"))
        .withColumn("pct", F.round(F.col("jobs") * 100.0 / total, 2))
    )


def _pairs(items: Column) -> Column:
    return F.flatten(
        F.transform(
            items,
            lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )


def pair_frequency(baskets: DataFrame) -> DataFrame:
    """``(skill_a, skill_b, jobs)`` for the unordered pairs that occur, ``skill_a < skill_b``."""
    return (
        baskets.select(F.explode(_pairs(F.col("basket"))).alias("_p"), "weight")
        .groupBy(F.col("_p.a").alias("skill_a"), F.col("_p.b").alias("skill_b"))
        .agg(F.sum("weight").alias("jobs"))
    )


def vocabulary_pairs(baskets: DataFrame) -> DataFrame:
    """``(skill_a, skill_b)``: all unordered pairs of the vocabulary, also those that never meet.

    The vocabulary is a taxonomy's and held in one row.
    """
    words = baskets.select(F.explode("basket").alias("_w")).agg(F.array_sort(F.collect_set("_w")).alias("_v"))
    return words.select(F.explode(_pairs(F.col("_v"))).alias("_p")).select(
        F.col("_p.a").alias("skill_a"), F.col("_p.b").alias("skill_b")
    )


def cooccurrence_matrix(baskets: DataFrame) -> DataFrame:
    """Long symmetric matrix ``(skill_a, skill_b, jobs)``: the diagonal holds frequencies, absent pairs zero."""
    diagonal = item_frequency(baskets).select(F.col("skill").alias("skill_a"), F.col("skill").alias("skill_b"), "jobs")
    upper = vocabulary_pairs(baskets).join(pair_frequency(baskets), ["skill_a", "skill_b"], "left").select(
        "skill_a", "skill_b", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs")
    )
    lower = upper.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"), "jobs")
    return diagonal.unionByName(upper).unionByName(lower)


def _with_singles(pairs: DataFrame, baskets: DataFrame) -> DataFrame:
    single = item_frequency(baskets)
    left = single.select(F.col("skill").alias("skill_a"), F.col("jobs").alias("jobs_a"))
    right = single.select(F.col("skill").alias("skill_b"), F.col("jobs").alias("jobs_b"))
    return pairs.join(left, "skill_a").join(right, "skill_b")


def jaccard(baskets: DataFrame) -> DataFrame:
    """``(skill_a, skill_b, jaccard)`` over all pairs of the vocabulary, six digits."""
    met = vocabulary_pairs(baskets).join(pair_frequency(baskets), ["skill_a", "skill_b"], "left")
    both = F.coalesce("jobs", F.lit(0))
    return _with_singles(met, baskets).select(
        "skill_a", "skill_b", F.round(both / (F.col("jobs_a") + F.col("jobs_b") - both), 6).alias("jaccard")
    )


def pmi(baskets: DataFrame, min_jobs: int = 1, singles: bool = False) -> DataFrame:
    """PMI (base 2) and NPMI clipped to [-1, 1] of the pairs seen at least ``min_jobs`` times; ``singles`` adds both single counts."""
    n = baskets.agg(F.sum("weight").cast("double")).scalar()
    p = _with_singles(pair_frequency(baskets).filter(F.col("jobs") >= min_jobs), baskets)
    score = F.log2(F.col("jobs") * n / (F.col("jobs_a") * F.col("jobs_b")))
    surprise = -F.log2(F.col("jobs") / n)
    npmi = F.when(surprise > 0, F.greatest(F.least(score / surprise, F.lit(1.0)), F.lit(-1.0))).when(score > 0, 1.0).otherwise(0.0)
    more = ["jobs_a", "jobs_b"] if singles else []
    return p.select("skill_a", "skill_b", "jobs", *more, F.round(score, 6).alias("pmi"), F.round(npmi, 6).alias("npmi"))


def adaptive_support(baskets: DataFrame) -> Column:
    """Support threshold by the number of baskets: one in a hundred, or one (two) baskets where that is more."""
    n = baskets.agg(F.sum("weight").cast("double")).scalar()
    return F.when(n < 20, F.greatest(F.lit(0.01), 1 / n)).otherwise(F.greatest(F.lit(0.01), 2 / n))


def association_rules(baskets: DataFrame, min_support: float = 0.01) -> DataFrame:
    """Both directions of every pair: support, confidence, lift; ``min_support`` as a share of baskets."""
    n = baskets.agg(F.sum("weight").cast("double")).scalar()
    p = _with_singles(pair_frequency(baskets), baskets).filter(F.col("jobs") / n >= min_support)

    def direction(x: str, y: str) -> DataFrame:
        return p.select(
            F.col(f"skill_{x}").alias("antecedent"),
            F.col(f"skill_{y}").alias("consequent"),
            (F.col("jobs") / n).alias("support"),
            (F.col("jobs") / F.col(f"jobs_{x}")).alias("confidence"),
            (F.col("jobs") * n / (F.col("jobs_a") * F.col("jobs_b"))).alias("lift"),
        )

    return direction("a", "b").unionByName(direction("b", "a"))


def frequent_stacks(baskets: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), min_support: float = 0.05) -> DataFrame:
    """``(stack, size, jobs, support, class)``: item sets of the given sizes that reach the support.

    Items that miss the support are dropped from the baskets first, as no set
    that holds them can reach it.
    """
    n = baskets.agg(F.sum("weight").cast("double")).scalar()
    keep = item_frequency(baskets).filter(F.col("jobs") / n >= min_support).agg(F.collect_set("skill")).scalar()
    slim = (
        baskets.select(F.array_intersect("basket", keep).alias("basket"), "weight")
        .groupBy("basket")
        .agg(F.sum("weight").alias("weight"))
    )

    def grown(sets: Column) -> Column:
        """Every set with every later item of the basket added."""
        return F.flatten(
            F.transform(
                sets,
                lambda s: F.transform(
                    F.filter(F.col("basket"), lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x))
                ),
            )
        )

    sets, levels = F.transform("basket", lambda x: F.array(x)), {}
    for size in range(2, max(sizes) + 1):
        sets = grown(sets)
        levels[size] = sets
    every = F.flatten(F.array(*(levels[k] for k in sizes)))
    return (
        slim.select(F.explode(every).alias("_s"), "weight")
        .groupBy("_s")
        .agg(F.sum("weight").alias("jobs"))
        .filter(F.col("jobs") / n >= min_support)
        .select(
            F.array_join("_s", " + ").alias("stack"),
            F.size("_s").alias("size"),
            "jobs",
            F.round(F.col("jobs") / n, 6).alias("support"),
            F.when(F.col("jobs") >= 2, "recurring").otherwise("single").alias("class"),
        )
    )


def relationship_table(baskets: DataFrame) -> DataFrame:
    """Pair counts with Jaccard, PMI, NPMI and strength = Jaccard * max(PMI, 0)."""
    # Only pairs that occur have a strength; the vocabulary's other pairs are never made.
    shared = F.col("jobs") / (F.col("jobs_a") + F.col("jobs_b") - F.col("jobs"))
    return (
        pmi(baskets, singles=True)
        .withColumn("jaccard", F.round(shared, 6))
        .withColumn("strength", F.round(F.col("jaccard") * F.greatest("pmi", F.lit(0.0)), 6))
        .select("skill_a", "skill_b", "jobs", "jaccard", "pmi", "npmi", "strength")
    )


def network_edges(baskets: DataFrame, min_jobs: int = 2) -> DataFrame:
    """Edges seen ``min_jobs`` times or more; all pairs where none is."""
    edges = relationship_table(baskets)
    most = pair_frequency(baskets).agg(F.max("jobs")).scalar()
    return edges.filter((F.col("jobs") >= min_jobs) | (most < min_jobs))


def node_degrees(edges: DataFrame) -> DataFrame:
    """``(skill, degree, weighted_degree, density)``; the density is the graph's."""
    ends = edges.select(F.explode(F.array("skill_a", "skill_b")).alias("skill"), "jobs")
    nodes = ends.agg(F.countDistinct("skill").cast("double")).scalar()
    links = edges.agg(F.count("*").cast("double")).scalar()
    return ends.groupBy("skill").agg(
        F.count("*").alias("degree"),
        F.sum("jobs").alias("weighted_degree"),
        F.round(F.when(nodes > 1, 2 * links / (nodes * (nodes - 1))).otherwise(0.0), 6).alias("density"),
    )


def components(edges: DataFrame) -> DataFrame:
    """``(skill, component)``: the smallest name within reach labels each component.

    Labels move along all edges and then jump to the label of their label, so the
    number of rounds grows with the logarithm of the longest path; lineage is cut
    every round until no label moves.
    """
    both = edges.select(F.col("skill_a").alias("x"), F.col("skill_b").alias("y"))
    both = checkpointed(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(both.groupBy(F.col("x").alias("skill")).agg(F.least(F.min("y"), F.col("x")).alias("component")))
    while True:
        near = (
            both.join(labels, both["y"] == labels["skill"])
            .groupBy("x")
            .agg(F.min("component").alias("seen"))
        )
        hop = labels.select(F.col("skill").alias("h"), F.col("component").alias("jump"))
        moved = (
            labels.join(near, labels["skill"] == near["x"])
            .join(hop, F.col("component") == F.col("h"))
            .select("skill", F.least("component", "seen", "jump").alias("component"), F.col("component").alias("before"))
        )
        moved = checkpointed(moved)
        settled = moved.filter(F.col("component") < F.col("before")).limit(1).count() == 0
        labels = moved.drop("before")
        if settled:
            break
    return labels


_CENTRAL = T.StructType(
    [
        T.StructField("component", T.StringType()),
        T.StructField("skill", T.StringType()),
        T.StructField("betweenness", T.DoubleType()),
        T.StructField("closeness", T.DoubleType()),
    ]
)


def _central(pdf: pd.DataFrame) -> pd.DataFrame:
    """Brandes' betweenness (co-occurrence as distance) and closeness by hops within one component."""
    import heapq
    from collections import defaultdict, deque

    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in zip(pdf["skill_a"], pdf["skill_b"], pdf["jobs"]):
        near[a][b] = near[b][a] = float(w)
    nodes = sorted(near)
    between = dict.fromkeys(nodes, 0.0)
    close = {}
    for s in nodes:
        order, pred = [], {v: [] for v in nodes}
        sigma = dict.fromkeys(nodes, 0.0)
        sigma[s] = 1.0
        dist: dict[str, float] = {}
        seen = {s: 0.0}
        heap = [(0.0, s, s)]
        while heap:
            d, p, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, cost in near[v].items():
                alt = d + cost
                if w not in dist and (w not in seen or alt < seen[w] - 1e-12):
                    seen[w] = alt
                    sigma[w] = sigma[v]
                    pred[w] = [v]
                    heapq.heappush(heap, (alt, v, w))
                elif w in seen and abs(alt - seen[w]) <= 1e-12 and v not in pred[w]:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
        hops, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in hops:
                    hops[w] = hops[v] + 1
                    queue.append(w)
        far = sum(hops.values())
        close[s] = (len(hops) - 1) / far if far else 0.0
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return pd.DataFrame(
        [(pdf["component"].iloc[0], v, round(between[v] * scale, 6), round(close[v], 6)) for v in nodes],
        columns=["component", "skill", "betweenness", "closeness"],
    )


#: Edges up to which a component is small enough for one task.
GRAPH_LIMIT = 1_000_000


def _component_edges(edges: DataFrame) -> DataFrame:
    """``(component, skill_a, skill_b, jobs)``; fails where a component has more than :data:`GRAPH_LIMIT` edges."""
    labels = components(edges)
    own = edges.join(labels, edges["skill_a"] == labels["skill"]).select("component", "skill_a", "skill_b", "jobs")
    size = own.groupBy("component").agg(F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > GRAPH_LIMIT, F.raise_error(F.lit("component too large for one task"))).otherwise(F.col("component"))
    return own.join(size, "component").select(checked.cast("string").alias("component"), "skill_a", "skill_b", "jobs")


def centrality(edges: DataFrame) -> DataFrame:
    """``(component, skill, betweenness, closeness)``, one task for each component.

    A component is a part of a taxonomy's vocabulary; larger ones than
    :data:`GRAPH_LIMIT` are refused.
    """
    return _component_edges(edges).groupBy("component").applyInPandas(_central, _CENTRAL)


def modular(edges: list[tuple[str, str, float]]) -> list[set[str]]:
    """Communities by greedy modularity: the pair of groups whose union gains most is merged until none gains.

    Ties go to the smallest names, so the result does not depend on the order of the edges.
    """
    total = sum(w for _, _, w in edges)
    degree: dict[str, float] = {}
    between: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0.0) + w
            own = between.setdefault(x, {})
            own[y] = own.get(y, 0.0) + w
    groups = {v: {v} for v in degree}
    while True:
        best = None
        for a in sorted(between):
            for b, w in between[a].items():
                if a < b:
                    gain = w / total - degree[a] * degree[b] / (2 * total * total)
                    if gain > 1e-12 and (best is None or (-round(gain, 12), a, b) < best):
                        best = (-round(gain, 12), a, b)
        if best is None:
            return sorted(groups.values(), key=lambda g: (-len(g), min(g)))
        _, a, b = best
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + w


def communities(edges: DataFrame) -> DataFrame:
    """``(component, community, skill)``: greedy modularity communities weighted by jobs, largest first, one task for each component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = modular(list(zip(pdf["skill_a"], pdf["skill_b"], pdf["jobs"].astype(float))))
        rows = [(pdf["component"].iloc[0], k, v) for k, group in enumerate(found) for v in sorted(group)]
        return pd.DataFrame(rows, columns=["component", "community", "skill"])

    return _component_edges(edges).groupBy("component").applyInPandas(run, "component string, community int, skill string")


def ego_edges(edges: DataFrame, focal: str, top: int) -> DataFrame:
    """The ``top`` strongest edges of one item."""
    own = edges.filter((F.col("skill_a") == focal) | (F.col("skill_b") == focal))
    return own.orderBy(F.desc("strength"), "skill_a", "skill_b").limit(top)


def method_overlap(mentions: DataFrame, methods: tuple[str, str] = ("lexical", "semantic")) -> DataFrame:
    """``(skill, side, jobs)``: jobs that have a skill by one method only or by both."""
    sides = [F.max(F.when(F.col("method") == m, 1).otherwise(0)) for m in methods]
    per_job = mentions.groupBy("job_id", "skill").agg(sides[0].alias("x"), sides[1].alias("y"))
    side = (
        F.when((F.col("x") == 1) & (F.col("y") == 1), "both")
        .when(F.col("x") == 1, f"{methods[0]}_only")
        .when(F.col("y") == 1, f"{methods[1]}_only")
    )
    return per_job.withColumn("side", side).filter("side is not null").groupBy("skill", "side").agg(F.count("*").alias("jobs"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)
