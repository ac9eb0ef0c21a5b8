"""Sharding by balanced label propagation: equal texts gather, shard sizes stay as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, ranked

#: Members of a group that share one salt where a group meets its plan.
GROUP_SALT = 512


def _counts(df: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: a number a shard for the driver."""
    got = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    return [got.get(k, 0) for k in range(shards)]


def _pick(values: list[int], at):
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def _among(ends: list[int], at):
    """How many of the ascending ends are at or before a place: the shard that holds it."""
    return F.aggregate(F.array(*[F.lit(int(e)) for e in ends]), F.lit(0), lambda a, e: a + (e <= at).cast("int"))


def _salts(members):
    return F.floor((members - 1) / GROUP_SALT).cast("int") + 1


def _in_a_row(linked: DataFrame, n: int, block: int = 20_000) -> DataFrame:
    """Rows (row, gid, members) with a place from 0 to n - 1 each, a group's rows one after another.

    Groups are dealt by hash over blocks, and a hot group over salts: a salt's rows are counted in
    their block, and rows are ranked within their salt.
    """
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("row"), _salts(F.col("members"))).cast("int"))
    blocks = max(1, -(-n // block))
    parts = salted.groupBy("gid", "salt").agg(F.count(F.lit(1)).alias("cnt")).withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int"))
    parts = cut(parts, "shard-parts")
    sofar = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("block").agg(F.sum("cnt").alias("n")).select("block", sofar(Window.partitionBy(F.lit(0)).orderBy("block"), "n").alias("start"))
    parts = parts.withColumn("before", sofar(Window.partitionBy("block").orderBy("gid", "salt"), "cnt")).join(starts, "block")
    parts = parts.select("gid", "salt", (F.col("start") + F.col("before")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("gid", "salt").orderBy("row")) - 1
    return salted.withColumn("inside", inside).join(parts, ["gid", "salt"]).select("row", "gid", "members", (F.col("start") + F.col("inside")).alias("place"))


def _propagate(linked: DataFrame, loose: DataFrame, shards: int, rnd: int) -> tuple[DataFrame, DataFrame, int]:
    """One round: linked rows move to the shard where most of their group is and where unlinked
    rows can make place; as many unlinked rows fill the shards that were left. The number is that of
    the rows that wished to; where there are any, some moved, and groups are less cut."""
    room = _counts(loose, shards)
    counts = linked.groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("cnt"), F.first("members").alias("members"))
    # A group has at most one row per shard here.
    group = Window.partitionBy("gid")
    open_to = F.when(_pick(room, F.col("shard")) > 0, F.struct("cnt", F.xxhash64("gid", "shard"), "shard"))
    plan = counts.withColumn("best", F.max(open_to).over(group)).where("best IS NOT NULL AND best.shard <> shard")
    # A shard that holds more of the group than the best open one is full of it: its rows stay.
    plan = plan.where(F.struct("cnt", F.xxhash64("gid", "shard")) < F.struct("best.cnt", F.xxhash64("gid", "best.shard")))
    plan = plan.select("gid", "shard", F.col("best.shard").alias("to"), F.explode(F.sequence(F.lit(0), _salts(F.col("members")) - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("row"), _salts(F.col("members"))).cast("int")
    wishes = cut(linked.withColumn("salt", salt).join(plan, ["gid", "shard", "salt"], "left").drop("salt"), f"shard-wishes{rnd}")
    n = wishes.where("to IS NOT NULL").count()
    if not n:
        discard(wishes)
        return linked, loose, 0
    # Capacity: a shard takes as many as it has unlinked rows to give away.
    placed = ranked(wishes.where("to IS NOT NULL"), "to", [F.col("gid"), F.col("row")], n, F.col("row"), block=1000, name="place")
    placed = placed.withColumn("new", F.when(F.col("place") < _pick(room, F.col("to")), F.col("to")).otherwise(F.col("shard")))
    moved = cut(placed.select("row", "gid", "members", F.col("shard").alias("from"), F.col("new").alias("shard")), f"shard-moved{rnd}")
    change = [0] * shards
    for r in moved.where("from <> shard").groupBy("from", "shard").count().collect():  # at most shards * shards rows
        change[r["from"]] -= r["count"]
        change[r["shard"]] += r["count"]
    linked = cut(moved.drop("from").unionByName(wishes.where("to IS NULL").drop("to")), f"shard-linked{rnd}")
    # Unlinked rows of shards that gained fill the gaps of those that lost, in order of shard.
    before, gaps, at, hole = [], [], 0, 0
    for k in range(shards):
        before.append(at)
        at += max(0, change[k])
        hole += max(0, -change[k])
        gaps.append(hole)
    gained = _pick(change, F.col("shard")) > 0
    seats = ranked(loose.where(gained), "shard", [F.col("row")], max(1, sum(x for x, c in zip(room, change, strict=True) if c > 0)), F.col("row"), name="place")
    hole_no = F.col("place") + _pick(before, F.col("shard"))
    to = _among(gaps, hole_no)
    seats = seats.select("row", F.when(F.col("place") < _pick(change, F.col("shard")), to).otherwise(F.col("shard")).cast("int").alias("shard"))
    loose = cut(seats.unionByName(loose.where(~gained)), f"shard-loose{rnd}")
    discard(wishes, moved)
    return linked, loose, n


def assign_shards(docs: DataFrame, shards: int = 40, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the numbers of rows of two shards differ by one at most. Documents with equal texts
    are linked (empty texts too; null texts are linked with nothing) and should share a shard, as
    far as a group is no larger than a shard. Repeated rows and null ids each take a place of their
    own. Size is the text's UTF-8 bytes (null: none) plus 16. slot counts a shard's rows from 0.
    An empty table gives an empty result; other columns are dropped.

    Only small rows are shuffled, never texts. The first deal lays groups one after another and gives
    each shard its part of that row, so at most shards - 1 ends fall within groups, however few
    rows aren't linked; each shard has its part of these too. Then each round moves linked rows towards
    the shard that holds most of their group, until none can move (rounds: or so many at most). No round
    cuts a whole group. What stays cut are groups at these ends, larger than their shard's part or not,
    for which the unlinked rows make no place. A hot group is salted where it is laid out and where it
    meets its plan, and ranks within a shard are taken in blocks. The driver reads a few numbers per shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.unhex(F.md5(F.encode(text, "UTF-8")))).alias("gid"),
    )
    small = cut(small.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    rows = small.count()
    groups = small.where("gid IS NOT NULL").groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = cut(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), "shard-groups")
    linked = small.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int")).join(groups.hint("merge"), ["gid", "salt"], "left").select("row", "gid", F.coalesce("members", F.lit(1)).alias("members"), F.col("members").isNotNull().cast("int").alias("linked"))
    state = cut(linked, "shard-state")
    n = state.where("linked = 1").count()
    # Even to a row: shards end where their parts of all rows do, and linked rows take their part of each.
    ends = [(k + 1) * (rows // shards) + min(k + 1, rows % shards) for k in range(shards)]
    taken = [n * e // max(1, rows) for e in ends]
    linked = _in_a_row(state.where("linked = 1").select("row", "gid", "members"), n)
    linked = cut(linked.select("row", "gid", "members", _among(taken[:-1], F.col("place")).cast("int").alias("shard")), "shard-first-linked")
    loose = ranked(state.where("linked = 0").select("row", F.lit(0).alias("_all")), "_all", [F.xxhash64("row"), F.col("row")], rows - n, F.col("row"), name="place")
    loose = cut(loose.select("row", _among([e - t for e, t in zip(ends[:-1], taken[:-1], strict=True)], F.col("place")).cast("int").alias("shard")), "shard-first-loose")
    rnd = 0
    while rounds is None or rnd < rounds:
        old = linked, loose
        linked, loose, moved = _propagate(linked, loose, shards, rnd)
        if not moved:
            break
        discard(*old)
        rnd += 1
    both = linked.select("row", "gid", "shard").unionByName(loose.withColumn("gid", F.lit(None).cast("binary")))
    placed = ranked(both, "shard", [F.col("gid"), F.col("row")], rows, F.col("row"), name="slot").drop("gid")
    out = small.drop("gid").join(placed, "row")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
