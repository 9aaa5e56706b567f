"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents (rows with one link key) form groups. Documents start dealt
evenly over the shards. In every round each group looks at the shards of its
members, and members move towards the shard that most of them are in: against members that
move the opposite way, and beyond that as long as the shard's quota has room. When no member can move, documents without
links fill every shard up to its quota, so the numbers of rows differ by one at
most. A group is cut only where it is larger than the room that is left.

Members of a group in one shard are interchangeable, so rounds run over the
counts of (group, shard) and not over documents; ranks inside groups turn the
counts back into documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordered_scan, rank_rows
from ..session import cut_lineage, drop_table
from .rows import text_of

LAW = "rows"
#: Rounds in which room counts before the number of members. From then on every
#: move gathers a group further (the sum of its squared counts rises), so rounds end.
ROOM_ROUNDS = 6


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _pick(shard: str, values: list[int]):
    """The value of a shard from a list with one number per shard."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard))


def _grant(wanted: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """How many members may move from each shard to each other one: as many as come
    the opposite way, and the room of the target beyond that."""
    shards, free = len(room), list(room)
    out = [0] * (shards * shards)
    for (a, b), c in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        swap = min(c, wanted.get((b, a), 0))
        more = max(0, min(c - swap, free[b]))
        free[b] -= more
        out[a * shards + b] = swap + more
    return out


def propagate(groups: DataFrame, shards: int, quotas: list[int]) -> DataFrame:
    """(g, shard, c): how many members of each group end in which shard.

    ``groups`` is (g, n). Members are dealt in the order of g over the shards at
    first; no shard ever holds more members than its quota.
    """
    dealt = ordered_scan(groups, ["g"], {"upto": F.col("n")})
    begin = F.col("upto") - F.col("n")
    shard = F.col("shard")
    # Numbers begin .. upto-1 that leave ``shard`` when divided by ``shards``.
    count = F.floor((F.col("upto") - 1 - shard) / shards) - F.floor((begin - 1 - shard) / shards)
    state = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("c", count.cast("long")).filter("c > 0")
    state = cut_lineage(state.select("g", "n", "shard", "c", F.lit(False).alias("done")))
    turn = 0
    while True:
        load = {r.shard: r.c for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # one row per shard
        room = [q - load.get(s, 0) for s, q in enumerate(quotas)]
        open_ = state.filter("not done")
        # The members' own votes: the shard that most of them are in, ties by a
        # hash so that equal votes spread over the shards. At first a shard with
        # room for all of them goes before, so that small groups leave full shards.
        fits = (_pick("shard", room) >= F.col("n") - F.col("c")) & F.lit(turn < ROOM_ROUNDS)
        turn += 1
        vote = F.max(F.struct(fits.alias("fits"), "c", F.xxhash64("g", "shard").alias("tie"), shard.alias("to"))).alias("v")
        votes = open_.groupBy("g").agg(vote, F.count("*").alias("parts")).filter("parts > 1").select("g", F.col("v.to").alias("to"))
        movers = open_.join(votes, "g").filter("shard <> to")
        wanted = {(r.shard, r.to): r.c for r in movers.groupBy("shard", "to").agg(F.sum("c").alias("c")).collect()}  # at most shards x shards rows
        granted = _grant(wanted, room)
        movers = movers.withColumn("room", F.get(F.array(*[F.lit(v).cast("long") for v in granted]), F.col("shard") * shards + F.col("to"))).filter("room > 0")
        # Larger groups first; the running total cuts the last move to the quota.
        asked = ordered_scan(movers.select("to", (-F.col("n")).alias("late"), "g", "shard", "c", "room"), ["late", "g"], {"upto": F.col("c")}, ["shard", "to"])
        moved = F.least(F.col("c"), F.greatest(F.lit(0).cast("long"), F.col("room") - F.col("upto") + F.col("c")))
        moves = cut_lineage(asked.withColumn("m", moved).filter("m > 0").select("g", "shard", "to", "m"))
        if moves.limit(1).count() == 0:
            # Full targets may keep members from gathering elsewhere: settle them.
            full = F.col("room") <= 0
            stuck = open_.join(votes, "g").filter("shard = to").withColumn("room", _pick("to", room)).filter(full).select("g", "shard", F.lit(True).alias("settle"))
            settled = cut_lineage(state.join(stuck, ["g", "shard"], "left").select("g", "n", "shard", "c", (F.col("done") | F.coalesce("settle", F.lit(False))).alias("done")))
            changed = settled.filter("done").count() > state.filter("done").count()
            drop_table(state, moves)
            state = settled
            if not changed:
                return state.select("g", "shard", "c")
            continue
        change = moves.select("g", "shard", (-F.col("m")).alias("d")).unionAll(moves.select("g", F.col("to").alias("shard"), F.col("m").alias("d"))).groupBy("g", "shard").agg(F.sum("d").alias("d"))
        after = state.join(change, ["g", "shard"], "left").withColumn("c", F.col("c") + F.coalesce("d", F.lit(0))).filter("c > 0")
        old, state = state, cut_lineage(after.select("g", "n", "shard", "c", "done"))
        drop_table(old, moves)


def assign_shards(docs: DataFrame, shards: int = 16, ident: str = "doc_id", text: str = "text", link=None) -> DataFrame:
    """(ident, size, text_crc32, law, shard, slot, grown_shard): one row per input row.

    Rows with the same ``link`` (an expression; by default the text) are linked;
    null texts are empty texts. The numbers of rows per shard differ by one at
    most (law ``rows``); ``slot`` counts from 0 inside a shard. ``size`` is the
    UTF-8 length plus one. Rows with equal ids are placed apart or together like
    any others; an empty table gives an empty table.
    """
    t = text_of(text)
    narrow = docs.select(
        F.col(ident).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        (F.sha2(t, 256) if link is None else F.sha2(link.cast("string"), 256)).alias("g"), F.monotonically_increasing_id().alias("row"),
    )
    rows = cut_lineage(narrow)  # without texts; the row numbers stay as written
    n = rows.count()
    quotas = _quotas(n, shards)
    groups = rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    counts = cut_lineage(propagate(groups, shards, quotas))
    load = {r.shard: r.c for r in counts.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # one row per shard
    # Members: the rank inside the group falls into one of its shards' intervals.
    member = rows.join(groups.select("g"), "g", "left_semi").select("g", "row", "id", "size", "text_crc32")
    ranked = rank_rows(member, ["row"], ["g"], "rank")
    upto = F.aggregate(F.col("parts"), F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<upto:bigint,shard:int>>").alias("cuts")), lambda a, p: F.struct(
        (a["sum"] + p["c"]).alias("sum"), F.concat(a["cuts"], F.array(F.struct((a["sum"] + p["c"]).alias("upto"), p["shard"].alias("shard")))).alias("cuts")), lambda a: a["cuts"])
    cuts = counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "c"))).alias("parts")).select("g", upto.alias("cuts"))  # at most one entry per shard
    linked = ranked.join(cuts, "g").withColumn("shard", F.get(F.filter("cuts", lambda c: F.col("rank") <= c["upto"]), F.lit(0))["shard"])
    # The others fill the rest: their rank falls into the intervals of free rows.
    single = rank_rows(rows.join(groups.select("g"), "g", "left_anti").select("g", "row", "id", "size", "text_crc32"), ["g"], (), "rank", F.conv(F.substring("g", 1, 3), 16, 10).cast("int"))
    free, total = [], 0
    for s, q in enumerate(quotas):
        total += q - load.get(s, 0)
        free.append(total)
    placed = single.withColumn("shard", F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in free]), lambda v: v < F.col("rank"))))
    columns = ["id", "size", "text_crc32", "g", "row", "shard"]
    every = linked.select(*columns).unionByName(placed.select(*columns))
    slots = rank_rows(every, ["g", "row"], ["shard"], "slot", F.conv(F.substring("g", 1, 3), 16, 10).cast("int"))
    return slots.select(
        F.col("id").alias(ident), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
