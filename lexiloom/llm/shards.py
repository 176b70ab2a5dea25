"""Sharding by balanced label propagation, with iterative Spark joins.

Native: DataFrame functions only.

Documents are linked through groups (here: equal texts).  Every document
starts with a shard by hash.  In a round the members of each group claim the
shard that most of them have; a shard admits claims, large groups first, while
its quota lasts, and their members move there.  Groups that find no room claim
a shard that still has room for all of them, drawn in proportion to the room,
and take part in the next round.  Documents without links, and groups that no
shard can hold any more or that found no room in ``rounds`` rounds, then fill
the shards up to their quotas, in the order of their groups, so that a group is
cut only where a shard ends.

The law is ``rows``: the counts of any two shards differ by at most one.  Groups
of more than a ``SHARE``-th of a quota, of which there can only be a few, go
through their rounds before the others, until each has a shard or none has room
for it.  A group of more than a quota claims in parts of a quota each.

The result depends on the rows alone, not on how they are split into tasks:
all order is by a hash of doc_id, text and the row's number among equal rows.

Null texts have no group, size 8 and checksum 0.  Empty texts are equal texts.
Very long texts count by their size alone, as only digests move.  Repeated rows
are members of the same group; which of them takes which of their places is
the same.  With fewer rows than shards some shards are empty, and an empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import RANK_BLOCK, ranked, small_or_shuffled, stored

#: Groups of more than this part of a quota take part before the others.
SHARE = 8
#: Blocks in which the members of a large group are numbered, at least.
BLOCKS = 256


def propagate(nodes: DataFrame, shards: int, rounds: int = 3) -> DataFrame:
    """row, shard for nodes (row, tie, unit): exact quotas by rows, members of a unit together.

    ``row`` is a hash that tells rows apart, ``tie`` a second one that orders
    them, ``unit`` the linked group or null.
    """
    n = nodes.count()
    low, high = n // shards, -(-n // shards)
    room = [low + (s < n % shards) for s in range(shards)]
    sizes = nodes.where("unit is not null").groupBy("unit").agg(F.count("*").alias("members"))
    huge = F.broadcast(stored(sizes.where(F.col("members") > high).select("unit")))  # fewer than there are shards
    held = ranked(nodes.join(huge, "unit", "left_semi"), ["unit"], F.col("tie"), [F.col("tie"), F.col("row")], n, "member", BLOCKS)
    parts = held.select("row", "tie", F.concat_ws(":", "unit", F.expr(f"member div {max(low, 1)}").cast("string")).alias("unit"))
    nodes = stored(nodes.join(huge, "unit", "left_anti").select("row", "tie", "unit").unionByName(parts))
    # votes: the shard that most members have; ties go to a shard drawn by the unit
    votes = nodes.where("unit is not null").groupBy("unit", F.pmod("tie", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("unit").agg(F.sum("votes").alias("members"), F.max(F.struct("votes", F.xxhash64("unit", "shard").alias("draw"), "shard")).alias("best")).where("members > 1")
    claims = stored(best.select("unit", "members", "best.shard", "best.votes"))
    large = F.col("members") > high // SHARE
    # a round admits one unit at least, and there are at most shards * SHARE large ones
    first, room = _rounds(claims.where(large), room, shards * SHARE + 1)
    others, room = _rounds(claims.where(~large), room, rounds)
    placed = stored(_union([*first, *others], claims))
    placed = small_or_shuffled(placed)
    done = nodes.join(placed, "unit").select("row", "shard")
    # the rest fills the shards up, units next to each other
    rest = nodes.join(placed, "unit", "left_anti")
    spread = F.xxhash64(F.coalesce("unit", F.col("tie").cast("string")))
    filled = ranked(rest.withColumn("spread", spread), [], F.col("spread"), [F.col("spread"), F.col("tie"), F.col("row")], n, "place")
    ends = [sum(room[: s + 1]) for s in range(shards)]
    spans = F.broadcast(nodes.sparkSession.createDataFrame([(s, e - r, e) for s, (r, e) in enumerate(zip(room, ends, strict=True))], "shard int, lo long, hi long"))
    return done.unionByName(filled.join(spans, (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("row", "shard"))


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("unit", "shard").limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def _rounds(claims: DataFrame, room: list[int], most: int) -> tuple[list[DataFrame], list[int]]:
    """Tables (unit, shard) of the units admitted in up to ``most`` rounds, and the room that is left in each shard."""
    spark, out = claims.sparkSession, []
    for turn in range(most):
        units = claims.count()
        if not units:
            break
        admitted = stored(_admit(claims, spark.createDataFrame(list(enumerate(room)), "shard int, room long"), units))
        taken = {r["shard"]: r["taken"] for r in admitted.groupBy("shard").agg(F.sum("members").alias("taken")).collect()}  # a row for each shard
        room = [r - taken.get(s, 0) for s, r in enumerate(room)]
        out.append(admitted.select("unit", "shard"))
        claims = stored(_asking(claims.join(admitted.select("unit"), "unit", "left_anti"), room, turn))
    return out, room


def _asking(claims: DataFrame, room: list[int], turn: int) -> DataFrame:
    """The claims with another shard that has room for the unit, drawn in proportion to the room; without those that no shard can hold."""
    rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(r).cast("long").alias("room")) for s, r in enumerate(room)])
    even = lambda r: (F.pmod(F.xxhash64("unit", r["shard"], F.lit(turn)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    fits = F.filter(rooms, lambda r: r["room"] >= F.col("members"))
    drawn = F.array_min(F.transform(fits, lambda r: F.struct((-F.log(even(r)) / r["room"]).alias("draw"), r["shard"].alias("shard"))))
    return claims.withColumn("shard", drawn["shard"]).where("shard is not null")


def _admit(claims: DataFrame, room: DataFrame, units: int) -> DataFrame:
    """unit, shard of the claims that fit: each shard takes units, large ones first, until its room ends.

    Claims are ordered in blocks by hash, and blocks start where those before
    them end, so no window holds all claims of a shard.
    """
    blocks = max(1, -(-units // RANK_BLOCK))
    keyed = claims.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)))
    inner = W.partitionBy("shard", "block").orderBy(F.desc("members"), F.desc("votes"), "unit").rowsBetween(W.unboundedPreceding, 0)
    within = keyed.withColumn("upto", F.sum("members").over(inner))
    sums = keyed.groupBy("shard", "block").agg(F.sum("members").alias("rows"))
    before = sums.withColumn("start", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("shard", "block", "start")
    placed = within.join(before, ["shard", "block"]).join(F.broadcast(room), "shard")
    return placed.where(F.col("start") + F.col("upto") <= F.col("room")).select("unit", "shard", "members")


def _numbered(facts: DataFrame, n: int) -> DataFrame:
    """facts with row and tie made of the row's hash and its number among equal rows.

    Equal rows, which may be a third of all, are numbered in blocks.
    """
    many = stored(facts.groupBy("tie").agg(F.count("*").alias("equal")).where("equal > 1").select("tie"))
    if many.isEmpty():
        numbered = facts.withColumn("number", F.lit(0).cast("long"))
    else:
        many = small_or_shuffled(many)
        again = ranked(facts.join(many, "tie", "left_semi"), ["tie"], F.xxhash64("row"), [F.col("row")], n, "number", BLOCKS)
        numbered = facts.join(many, "tie", "left_anti").withColumn("number", F.lit(0).cast("long")).unionByName(again)
    return stored(numbered.withColumn("row", F.xxhash64("tie", "number")).withColumn("tie", F.xxhash64("row", F.lit(1))).drop("number"))


def assign(docs: DataFrame, shards: int = 24, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    facts = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(text)).alias("group"),
        F.xxhash64("doc_id", F.md5(text), F.col("text").isNull()).alias("tie"),
    )
    facts = stored(facts)
    n = facts.count()
    facts = _numbered(facts, n)
    placed = stored(propagate(facts.select("row", "tie", F.col("group").alias("unit")), shards, rounds))
    joined = facts.join(placed, "row")
    slotted = ranked(joined, ["shard"], F.col("tie"), [F.col("tie"), F.col("row")], max(1, n // shards), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
