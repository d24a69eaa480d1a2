"""Shards by balanced label propagation.

Rows start in shards of equal size, dealt by a hash. In each round every linked row counts the
shards of its neighbours (Spark joins over the links), and wants to move where most of them are.
Moves from one shard to another are held to a quota: the room left in the target under its capacity,
plus what leaves it in the same round. Half of the rows, chosen by a hash that changes with the
round, may move in a round, so two neighbours do not swap places for ever. Rounds go on until no row
wants to move or ``STILL`` rounds in a row leave the cut as it is. Then groups of copies are seated
whole, the largest first, at the shard that holds most of the group if it has room, else where most
room is; only a group larger than every room that is left is divided, over as few shards as can be.
Rows without links fill the rooms exactly, so the cut of the global order into equal stretches falls
between groups.

The law of the query is ``rows``: counts of any two shards differ by one at most.

Defined cases: a NULL text has size 1 and links to other NULL texts as the empty text does not:
NULL and empty are different texts. Rows that repeat an id are rows of their own. A group of copies
larger than a shard fills whole shards and a rest. An empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptally.functions.numbering import numbered
from shoptally.functions.parts import with_positions
from shoptally.llm.common import SALTS, apart, columns_apart, salted, table, written

SHARDS = 16
#: rounds without a smaller cut after which propagation has settled; by lot half of the rows rest in each
STILL = 4
#: links of one row beyond which they are spread over ``SALTS`` tasks
HOT = 4096


def propagate(nodes: DataFrame, links: DataFrame, capacity: float) -> DataFrame:
    """``nodes`` (``node``, ``shard``) after propagation over ``links`` (``a``, ``b``: each
    link in one direction, ``node`` values, no loops) has settled. Both frames should be tables already.
    No shard takes more than about ``capacity`` nodes: lots decide who moves within a quota."""
    both = links.select(F.col("a").alias("of"), F.col("b").alias("node")).union(
        links.select(F.col("b").alias("of"), F.col("a").alias("node")))
    sizes = {r[0]: r[1] for r in nodes.groupBy("shard").count().collect()}  # one row per shard
    hot = written(both.groupBy("node").count().where(F.col("count") > HOT).select(
        "node", F.lit(SALTS).alias("copies")), "shard-hot")  # of HOT links each, so few
    copies = F.coalesce("copies", F.lit(1)).alias("copies")
    both = written(both.join(hot, "node", "left").select(
        "of", "node", F.pmod(F.xxhash64("of"), copies).cast("int").alias("salt")), "shard-both")
    now = written(nodes.join(hot, "node", "left").select("node", "shard", copies), "shard-now")
    lowest, still = None, 0
    for turn in count():
        votes = (
            both.join(apart(now.select("node", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))),
                      ["node", "salt"])
            .groupBy(F.col("of").alias("node"), F.col("shard").alias("near"))
            .agg(F.count("*").alias("links"))
            .groupBy("node")
            .agg(F.map_from_entries(F.collect_list(F.struct("near", "links"))).alias("votes"))
        )  # at most one entry per shard in the map
        here = F.coalesce(F.try_element_at("votes", F.col("shard")), F.lit(0))
        best = F.array_max(F.transform(
            F.map_entries("votes"),
            lambda e: F.struct(e["value"].alias("links"), (-e["key"]).alias("minus"))))
        wish = F.when(best["links"] > here, -best["minus"]).otherwise(F.col("shard"))
        coin = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2))
        met = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda total, n: total + n)
        want = written(
            now.join(apart(votes), "node", "left")
            .withColumn("hope", F.when(F.col("votes").isNotNull(), wish).otherwise(F.col("shard")))
            .withColumn("wish", F.when(coin == 0, F.col("hope")).otherwise(F.col("shard")))
            .select("node", "shard", "copies", "hope", "wish", F.coalesce(met - here, F.lit(0)).alias("apart")), "shard-wishes")
        cut, hopes = want.agg(F.sum("apart"), F.count_if(F.expr("hope <> shard"))).first()
        still = 0 if lowest is None or (cut or 0) < lowest else still + 1
        lowest = min(cut or 0, cut or 0 if lowest is None else lowest)
        if not hopes or still >= STILL:
            break
        flows = {(r[0], r[1]): r[2] for r in want.where("wish <> shard")
                 .groupBy("shard", "wish").count().collect()}  # at most shards**2 rows
        if not flows:
            continue  # all who want to move rest by lot in this round
        taken = quotas(sizes, flows, capacity)
        wide = 1 + max(max(pair) for pair in taken)
        part = picked([taken.get((a, b), 0.0) for a in range(wide) for b in range(wide)],
                      F.col("shard") * wide + F.col("wish"))
        lot = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 30)) / (1 << 30)
        now = want.select("node", F.when(lot < part, F.col("wish")).otherwise(
            F.col("shard")).alias("shard"), "copies")
        for (source, target), fraction in taken.items():
            moved = fraction * flows[source, target]
            sizes[source] = sizes.get(source, 0) - moved
            sizes[target] = sizes.get(target, 0) + moved
    return now.select("node", "shard")


def quotas(sizes: dict[int, float], flows: dict[tuple[int, int], int],
           capacity: float) -> dict[tuple[int, int], float]:
    """The fraction of every wished flow that may move: into a shard goes what its capacity leaves
    over after what leaves it. Fractions are halved towards a fixed point from above."""
    taken = {pair: 1.0 for pair in flows}
    for _ in range(20):
        for target in {t for _, t in flows}:
            out = sum(taken[p] * flows[p] for p in flows if p[0] == target)
            come = sum(taken[p] * flows[p] for p in flows if p[1] == target)
            room = max(0.0, capacity - sizes.get(target, 0) + out)
            if come > room:
                for p in flows:
                    if p[1] == target:
                        taken[p] *= room / come
    return taken


def picked(values: list[float], at: Column) -> Column:
    """The value at a place of a short list; 0 beyond it."""
    array = F.from_json(F.lit(json.dumps(values)), "array<double>")
    return F.coalesce(F.get(array, at.cast("int")), F.lit(0.0))


def seats(classes: list[tuple[int, int, int]], rooms: list[int]) -> tuple[dict, dict, list[int]]:
    """Where groups go, the largest first. ``classes`` has (size, home, how many groups). Returns per
    (size, home) the stretches [shard, groups] in which its whole groups are seated, then the
    divided groups per (size, home) as lists of [shard, rows] (each uses up the room of a shard at
    least, so there are fewer of them than shards), and the rooms left for rows without links."""
    rooms, whole, divided = list(rooms), {}, {}
    for size, home, groups in sorted(classes, key=lambda c: (-c[0], c[1])):
        while groups:
            best = max(range(len(rooms)), key=lambda s: (rooms[s], -s))
            at = home if rooms[home] >= size else best
            if rooms[at] >= size:
                # the home takes what it can; beside it one at a time, so that rooms stay alike
                n = min(groups, rooms[at] // size) if at == home else 1
                taken = whole.setdefault((size, home), [])
                if taken and taken[-1][0] == at:
                    taken[-1][1] += n
                else:
                    taken.append([at, n])
                rooms[at] -= n * size
                groups -= n
                continue
            left, parts = size, []
            while left:
                fits = [s for s in range(len(rooms)) if rooms[s] >= left]
                at = fits[0] if fits else max(range(len(rooms)), key=lambda s: (rooms[s], -s))
                parts.append([at, min(left, rooms[at])])
                rooms[at] -= parts[-1][1]
                left -= parts[-1][1]
            divided.setdefault((size, home), []).append(parts)
            groups -= 1
    return whole, divided, rooms


def at_place(stretches: list[list[int]], place: Column) -> Column:
    """The shard of a place in consecutive stretches of [shard, length]."""
    ends = list(accumulate(n for _, n in stretches))
    passed = F.filter(F.from_json(F.lit(json.dumps(ends)), "array<bigint>"), lambda e: place >= e)
    return F.get(F.from_json(F.lit(json.dumps([s for s, _ in stretches])), "array<int>"), F.size(passed))


def seated(rows: DataFrame, moved: DataFrame, total: int, shards: int) -> DataFrame:
    """``node`` and ``home`` of all ``rows`` (``node``, ``hub``, NULL without links): every shard gets
    its exact number. ``moved`` (``node``, ``shard``) is what propagation says."""
    starts = [max(0, -((shards - 1 - s * total) // shards)) for s in range(shards + 1)]
    rooms = [min(total, b) - min(total, a) for a, b in zip(starts, starts[1:], strict=False)]
    held = moved.join(apart(rows.where("hub IS NOT NULL")), "node").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    groups = written(held.groupBy("hub").agg(
        F.sum("n").alias("size"), (-F.max(F.struct("n", (-F.col("shard")).alias("s")))["s"]).alias("home")),
        "shard-groups")
    # different sizes are few: their sum is at most the number of rows
    classes = [tuple(r) for r in groups.groupBy("size", "home").count().collect()]
    whole, divided, left = seats(classes, rooms)
    # groups that leave, ranked in their class, and groups that are divided, ranked behind them
    plan = [(size, home, [*whole.get((size, home), []), *[[-1 - i, 1] for i in range(len(parts))]])
            for (size, home) in {*whole, *divided} for parts in [divided.get((size, home), [])]
            if parts or [s for s, _ in whole.get((size, home), [])] != [home]]
    spark = rows.sparkSession
    away = spark.createDataFrame(plan, "size bigint, home int, stretches array<array<bigint>>").selectExpr(
        "size", "home", "transform(stretches, x -> cast(x[0] AS int)) AS targets",
        "transform(sequence(1, size(stretches)), i -> aggregate(slice(stretches, 1, i), 0L, (t, x) -> t + x[1])) AS ends")
    ranked = with_positions(groups.join(away.select("size", "home"), ["size", "home"], "left_semi"),
                            ["size", "home"], "hub")
    target = ranked.join(away, ["size", "home"]).selectExpr(
        "hub", "size", "home", "get(targets, size(filter(ends, e -> pos >= e))) AS target")
    target = written(target, "shard-targets")
    placed = groups.join(apart(target.select("hub", "target")), "hub", "left").select(
        "hub", F.coalesce("target", "home").alias("home"))
    linked = salted(rows.where("hub IS NOT NULL"), placed, ["hub"], F.col("node"), broadcast=False).select(
        "node", "hub", "home")
    out = linked.where("home >= 0").select("node", "home")
    few = target.where("target < 0").collect()  # fewer than shards
    for row in few:
        parts = divided[row["size"], row["home"]][-1 - row["target"]]
        one = numbered(linked.where(F.col("hub") == row["hub"]).select("node"), ["node"], "pos", 0)
        out = out.union(one.select("node", at_place(parts, F.col("pos")).alias("home")))
    loose = numbered(rows.where("hub IS NULL").select("node"), ["node"], "pos", 0)
    return out.union(loose.select("node", at_place([[s, n] for s, n in enumerate(left)], F.col("pos")).alias("home")))


def even(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot``: the rows in ``order`` cut into stretches whose lengths differ by
    one at most. Positions come from counts per range partition, not from one global window."""
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).count().select(
        "_part", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    total = starts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.expr(f"cast((_place * {shards} + {shards - 1}) div {max(total, 1)} as int)")
    # shard s begins at the first place p with p * shards >= s * total - (shards - 1)
    first = F.expr(f"cast(greatest(0, ceil((shard * {max(total, 1)}D - {shards - 1}) / {shards})) as bigint)")
    if total * shards >= 1 << 52:
        raise ValueError("positions beyond the exact range of doubles")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts.select("_part", "_start")), "_part")  # one row per partition
        .withColumn("_place", place).withColumn("shard", F.least(shard, F.lit(shards - 1)))
        .withColumn("slot", F.col("_place") - first)
        .drop("_at", "_part", "_start", "_place")
    )


def text_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``node`` and ``hub``, and the links: every row of a group of equal texts to the
    group's first row. ``rows`` has ``doc_id size text_crc32 k1 k2`` (two hashes of the text)."""
    hubs = (
        rows.groupBy("k1", "k2", "size", "text_crc32")
        .agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    linked = salted(rows, hubs, ["k1", "k2", "size", "text_crc32"], F.col("node"), broadcast=False)
    linked = written(linked.select("node", "hub"), "shard-links")
    links = linked.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return linked, links


def shards_of_copies(docs: DataFrame, shards: int = SHARDS,
                     text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows in ``shards`` shards, equal texts together as far as even counts allow."""
    raw = columns_apart(docs, [doc_id, text]).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("_raw"))
    body = F.coalesce("_raw", F.lit(""))
    rows = written(raw.select(
        F.monotonically_increasing_id().alias("node"), "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64("_raw").alias("k1"), F.xxhash64(F.lit(1), "_raw", F.isnull("_raw")).alias("k2"),
    ), "shard-rows")
    linked, links = text_links(rows)
    start = linked.join(apart(rows.select("node")), "node", "left_semi").select(
        "node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    total = rows.count()
    moved = written(propagate(written(start, "shard-start"), links, total / shards), "shard-moved")
    grouped = written(rows.join(apart(linked), "node", "left").select("node", "hub"), "shard-grouped")
    homes = seated(grouped, moved, total, shards)
    placed = rows.join(apart(homes), "node").join(apart(grouped), "node").select(
        "node", "doc_id", "size", "text_crc32", "home", F.coalesce("hub", "node").alias("hub"))
    order = [F.col(c) for c in ("home", "hub", "node")]
    return even(placed, order, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8(spark, sf_dir: str) -> DataFrame:
    return shards_of_copies(table(spark, sf_dir, "documents"))
