"""Filling containers of fixed capacity with texts, by conflict-constrained best fit.

Items are spread evenly over groups of bounded size by a hash of their id; each
group is packed on its own, largest items first. Bitmaps over the bins of a
group tell those of every residual, source and duplicate cluster. An item goes
into the tightest bin that holds no copy of it; among equally tight bins one
without the item's source is taken wherever there is one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import ref
from adloom.llm.tokens import token_counts

#: Mean number of texts packed together. A group leaves about one bin unfilled.
GROUP_ITEMS = 20_000


def best_fit(
    items: Iterable[tuple[object, int, int, object, object]], capacity: int
) -> list[tuple[object, int, int, int]]:
    """``(item, piece, size, bin)`` for items ``(id, piece, size, source, cluster)`` no larger than ``capacity``.

    Items of one cluster never share a bin, unless the cluster has more copies
    than the group needs bins by volume; then each bin takes as few as possible.
    A cluster of None conflicts with nothing.
    """
    items = list(items)
    # Only what has copies here needs a bit of its own.
    times = Counter(x[4] for x in items)
    items = [x if times[x[4]] > 1 else (*x[:4], None) for x in items]
    ordered = sorted(items, key=lambda x: (-x[2], str(x[4]), str(x[0]), x[1]))
    needed = max(1, math.ceil(sum(x[2] for x in ordered) / capacity))
    residual: list[int] = []
    # Bit b of a bitmap stands for bin b: those that hold the source, those that hold a copy, those with a residual.
    with_source: dict[object, int] = {}
    with_copy: dict[tuple[object, int], int] = {}
    level: dict[int, int] = {}
    filled = 0  # bit r is set where level has bins with residual r

    def shelve(b: int) -> None:
        nonlocal filled
        level[residual[b]] = level.get(residual[b], 0) | 1 << b
        filled |= 1 << residual[b]

    out: list[tuple[object, int, int, int]] = []
    aside: list[int] = []  # bins that took a copy of the running cluster, hidden until it is done
    running, copies = object(), 0
    for item, piece, size, source, cluster in ordered:
        key = (cluster, size)
        if cluster is None or key != running or copies % needed == 0:
            for b in aside:
                shelve(b)
            aside.clear()
        copies = copies + 1 if key == running and cluster is not None else 1
        running = key
        lap = (cluster, (copies - 1) // needed)
        same = 0 if cluster is None else with_copy.get(lap, 0)
        chosen = -1
        r = size
        while chosen < 0:
            above = filled >> r
            if not above:
                break
            r += (above & -above).bit_length() - 1
            free = level[r] & ~same
            if free:
                chosen = (free & ~with_source.get(source, 0) or free).bit_length() - 1
            else:
                r += 1
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
        else:
            level[r] ^= 1 << chosen
            if not level[r]:
                del level[r]
                filled ^= 1 << r
        residual[chosen] -= size
        with_source[source] = with_source.get(source, 0) | 1 << chosen
        if cluster is not None:
            with_copy[lap] = same | 1 << chosen
        if cluster is None:
            shelve(chosen)
        else:
            aside.append(chosen)
        out.append((item, piece, size, chosen))
    return out


_OUT = "limit_id int, doc_id long, piece_no int, tokens int, container_id long"


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    limit, group = key
    capacity = int(rows["capacity"].iloc[0])
    # A group holds all rows of an id.
    rows = rows.sort_values(["doc_id", "tokens", "cluster"]).drop_duplicates("doc_id")
    items = []
    for doc, tokens, source, cluster in zip(rows["doc_id"], rows["tokens"], rows["source"], rows["cluster"]):
        tokens = int(tokens)
        same = None if tokens == 0 or pd.isna(cluster) else int(cluster)
        whole, rest = divmod(tokens, capacity)
        if tokens <= capacity:
            whole, rest = 0, tokens
        for k in range(whole):
            items.append((int(doc), k, capacity, source, None))
        if rest or not whole:
            items.append((int(doc), whole, rest, source, same))
    packed = best_fit(items, capacity)
    base = int(group) << 32
    return pd.DataFrame(
        [(int(limit), d, piece, size, base + b) for d, piece, size, b in packed],
        columns=["limit_id", "doc_id", "piece_no", "tokens", "container_id"],
    )


def packed(
    documents: DataFrame, limits: DataFrame, vocabulary: str | None = None, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """``(limit_id, doc_id, piece_no, tokens, container_id)``: the container of every text, for every capacity.

    Sizes are tokens of the vocabulary. A text larger than a capacity is cut
    into full containers and a rest (pieces from 0); no other text is split.
    Null, empty texts have size 0 and lie in some container. Exact copies lie in
    different containers. ``container_id`` is unique within a limit. Limits
    without a positive capacity are left out; every document id counts once.
    """
    count = documents.count()
    groups = max(1, math.ceil(count / group_items))
    sizes = token_counts(documents.select("doc_id", "text", "source"), out="tokens", vocabulary=vocabulary).select(
        "doc_id", "tokens", "source", F.xxhash64("text").alias("cluster")
    )
    capacities = (
        limits.filter(F.col("capacity_tokens") > 0)
        .agg(F.collect_set(F.struct(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("int").alias("capacity"))))
        .scalar()
    )
    spread = (
        sizes.withColumn("_group", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(groups)))
        .withColumn("_limit", F.explode(capacities))
        .select("doc_id", "tokens", "source", "cluster", "_group", "_limit.limit_id", "_limit.capacity")
    )
    return spread.groupBy("limit_id", "_group").applyInPandas(_pack, _OUT)


def fill_report(containers: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, used tokens and the share of space used, for every limit."""
    used = containers.groupBy("limit_id", "container_id").agg(
        F.sum("tokens").alias("used"), F.countDistinct("doc_id").alias("docs")
    )
    return (
        used.groupBy("limit_id")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(limits.select(ref("limit_id").cast("int").alias("limit_id"), "capacity_tokens"), "limit_id")
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
