"""Shards by balanced label propagation, on DataFrame operations alone.

Documents of a group (equal texts) are linked through the group, so edges grow with rows, not pairs.  Every document
starts in a shard by hash.  In each round a join brings each linked document the places of its neighbours; it moves
towards the shards that hold most of them, as far as those shards' quotas allow.  A last exact step evens out the shards
to row counts at most one apart, giving up unlinked documents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import hot_values, salted_join, written

SHARDS = 40
ROUNDS = 5
#: Rows that are numbered in one task.
NUMBERED = 20_000
_SCALE = 1 << 30


def _share(*columns: str | Column) -> Column:
    """A hash of the columns, evenly in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(_SCALE)) / F.lit(float(_SCALE))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _longs(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def propagate(linked: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` rows ``(node, group, shard)`` after ``rounds`` rounds of label propagation.

    A group ranks the shards that hold some of it, and the few with most room, by how much of it each could hold; the
    shortest run that could hold all of it are its targets.  Rows elsewhere ask for one of these, by hash.  A shard takes
    what its capacity leaves beside the rows that stay there; where more ask, a hash picks the quota's share of them.
    """
    hot = hot_values(linked, "group")
    for r in range(rounds):
        load = _loads(linked, shards)
        room = [max(0, capacity - x) for x in load]
        rooms = _longs(room)
        roomy = [] if r == 0 else sorted(range(shards), key=lambda s: (-room[s], s))[:3]
        held = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
        groups = held.groupBy("group").agg(F.sum("n").alias("total"), F.collect_list(F.struct("shard", "n")).alias("at")).where(F.size("at") > 1)
        for s in roomy:
            empty = F.array(F.struct(F.lit(s).alias("shard"), F.lit(0).cast("long").alias("n")))
            groups = groups.withColumn("at", F.when(F.array_contains(F.transform("at", lambda x: x["shard"]), F.lit(s)), F.col("at")).otherwise(F.concat("at", empty)))
        beside = (lambda x: F.lit(capacity) - x["n"]) if r == 0 else (lambda x: F.element_at(rooms, x["shard"] + 1))
        could = lambda x: x["n"] + F.greatest(F.lit(0), F.least(F.col("total") - x["n"], beside(x)))
        ranked = F.sort_array(F.transform("at", lambda x: F.struct((-could(x)).alias("c"), (-x["n"]).alias("n"), F.xxhash64("group", x["shard"]).alias("tie"), x["shard"].alias("shard"))))
        groups = groups.withColumn("at", ranked)
        # sums over the first i shards; at most one entry a shard
        upto = F.transform(F.sequence(F.lit(1), F.size("at")), lambda i: F.aggregate(F.slice("at", 1, i), F.lit(0).cast("long"), lambda a, x: a - x["c"]))
        k = F.least(F.size("at"), F.size(F.filter(upto, lambda x: x < F.col("total"))) + 1)
        groups = groups.select("group", F.transform(F.slice("at", 1, k), lambda x: x["shard"]).alias("targets"))
        wish = salted_join(linked, groups, ["group"], "left", hot)
        to = F.get("targets", F.pmod(F.xxhash64("node", F.lit(r)), F.size("targets")).cast("int"))
        stays = F.col("targets").isNull() | F.array_contains("targets", F.col("shard"))
        wish = written(wish.select("node", "group", "shard", F.when(~stays, to).alias("to")))
        asked = {x["to"]: x["n"] for x in wish.where(F.col("to").isNotNull()).groupBy("to").agg(F.count("*").alias("n")).collect()}
        if not asked:
            break
        stay = _loads(wish.where(F.col("to").isNull()), shards)
        taken = _longs([min(1.0, max(0, capacity - stay[s]) / asked[s]) if s in asked else 0.0 for s in range(shards)])
        moves = F.col("to").isNotNull() & (_share("node", F.lit(-1 - r)) < F.element_at(taken, F.col("to") + 1))
        linked = written(wish.select("node", "group", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return linked


def numbered(rows: DataFrame, by: str, first: str, n: int, groups: int) -> DataFrame:
    """``rows`` with a gapless number ``slot`` from 0 within ``by``, rows of small ``first`` before others.

    Rows are numbered within hash parts of bounded size, then parts are shifted by the sizes of those before.
    """
    parts = max(1, -(-n // (NUMBERED * groups)))
    rows = rows.withColumn("part", F.col(first) * parts + F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy(by, "part").agg(F.count("*").alias("n"))
    shifts = sizes.select(by, "part", (F.sum("n").over(W.partitionBy(by).orderBy("part")) - F.col("n")).alias("shift"))
    own = F.row_number().over(W.partitionBy(by, "part").orderBy("node")) - 1
    return rows.withColumn("own", own).join(shifts, [by, "part"]).withColumn("slot", F.col("own") + F.col("shift")).drop("own", "shift", "part")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row: row counts of shards differ by at most one.

    size is the text's UTF-8 bytes plus 16, text_crc32 its checksum; null text counts as empty for both and makes a
    group of its own.  Rows that repeat an id are rows of their own, even where their texts differ; texts of any length only
    give a hash.  Ties between shards go by a hash of group and shard.  A group larger than a shard fills as few as can hold
    it.  An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text), text.isNull()).alias("group"),
    )
    rows = written(slim.withColumn("node", F.monotonically_increasing_id()))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    n = rows.count()
    capacity = -(-n // shards)
    shared = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    linked = written(salted_join(rows.select("node", "group", "shard"), shared, ["group"]).select("node", "group", "shard"))
    moved = propagate(linked, shards, capacity, rounds).select("node", F.col("shard").alias("_to"))
    placed = rows.join(moved, "node", "left").withColumn("loose", F.col("_to").isNull().cast("int")).withColumn("shard", F.coalesce("_to", "shard"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "node", "shard", "loose"))
    load = _loads(placed, shards)
    quota = [n // shards + (rank < n % shards) for rank in _ranks(load)]
    over = [max(0, x - q) for x, q in zip(load, quota, strict=True)]
    free = [max(0, q - x) for x, q in zip(load, quota, strict=True)]
    given = _longs([sum(over[:s]) for s in range(shards)])
    taken = [sum(free[: s + 1]) for s in range(shards)]
    slots = numbered(placed, "shard", "loose", n, shards)
    at = F.element_at
    s1 = F.col("shard") + 1
    extra = F.when(F.col("slot") >= at(_longs(quota), s1), at(given, s1) + F.col("slot") - at(_longs(quota), s1))
    slots = slots.withColumn("extra", extra)
    new = F.size(F.filter(_longs(taken), lambda x: x <= F.col("extra")))
    slots = slots.withColumn("new", F.when(F.col("extra").isNotNull(), new))
    moved_slot = at(_longs(load), F.col("new") + 1) + F.col("extra") - (at(_longs(taken), F.col("new") + 1) - at(_longs(free), F.col("new") + 1))
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.coalesce("new", "shard").cast("int").alias("shard"),
        F.when(F.col("extra").isNotNull(), moved_slot).otherwise(F.col("slot")).cast("long").alias("slot"),
    )


def _ranks(load: list[int]) -> list[int]:
    """Place of each shard by falling load: the fullest take the odd rows."""
    order = sorted(range(len(load)), key=lambda s: (-load[s], s))
    out = [0] * len(load)
    for rank, s in enumerate(order):
        out[s] = rank
    return out
