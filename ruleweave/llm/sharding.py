"""Sharding by balanced label propagation.

Linked documents start in shards that a hash picks. In each round a group of linked documents finds the
shard that most of its members are in (several, if it is larger than a shard), and members elsewhere
move there as far as the shards' quotas allow, where rows that leave make room: the driver works out
swaps, cycles and moves into room from a table of shards by shards. When no round gains any more, what
is left joins its group, and shards that are too full pass whole groups on, the smallest first.
Documents without links fill the shards up, so that their counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, ranked

#: Groups of more rows are ranked in buckets of about so many.
LARGE = 20_000


def _unit(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)).cast("double") / float(1 << 30)


def flows(want: dict[tuple[int, int], int], held: list[int], quota: int) -> dict[tuple[int, int], int]:
    """Rows to move for each (from, to) of `want`: no shard grows beyond `quota`, or beyond what it holds.

    Cycles (a swap is one of two) leave every count as it is, so all are taken, shortest first. Then
    rows move into shards with room, and leave room behind for others.
    """
    shards = range(len(held))
    left = {e: n for e, n in want.items() if n and e[0] != e[1]}
    room = [quota - h for h in held]

    def take(edge: tuple[int, int], n: int) -> None:
        left[edge] -= n
        if not left[edge]:
            del left[edge]

    def cycle() -> list[tuple[int, int]] | None:
        best = None
        for start in shards:
            back, queue = {}, [start]
            for at in queue:
                for to in shards:
                    if (at, to) in left and to not in back:
                        back[to] = at
                        queue.append(to)
                if start in back:
                    break
            if start in back:
                path = [(back[start], start)]
                while path[-1][0] != start:
                    path.append((back[path[-1][0]], path[-1][0]))
                if best is None or len(path) < len(best):
                    best = path
        return best

    while path := cycle():  # each takes an edge out
        n = min(left[e] for e in path)
        for e in path:
            take(e, n)
    while edge := next((e for e in sorted(left) if room[e[1]] > 0), None):  # no cycles are left, so room only moves on
        n = min(left[edge], room[edge[1]])
        take(edge, n)
        room[edge[0]] += n
        room[edge[1]] -= n
    return {e: n - left.get(e, 0) for e, n in want.items() if e[0] != e[1]}


def propagate(members: DataFrame, shards: int, quota: int) -> DataFrame:
    """uid, label, group, size of linked rows (uid, key, group, label at first), moved to the shards of their
    groups. key: a hash of the row.

    A group larger than `quota` is led to as many shards as it needs. Rounds keep to the quota, and end
    when one gains nothing; then the rest moves whatever the quota. Groups are counted by shard before
    any shuffle, so one of any size is cheap.
    """
    size = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(size, "sizes")
    state, before = members, None
    while True:
        here = state.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        order = F.sort_array(F.collect_list(F.struct("n", F.xxhash64("group", "label").alias("tie"), "label")), asc=False)  # at most `shards` entries
        hubs = here.groupBy("group").agg(order.alias("o")).join(sizes, "group")
        led = F.slice("o", F.lit(1), F.ceil(F.col("size") / quota).cast("int"))
        hubs = materialize(hubs.select("group", "size", F.transform(led, lambda x: x["label"]).alias("led")), "hubs")
        choice = F.get("led", F.pmod(F.xxhash64("key"), F.size("led")).cast("int"))
        want = F.when(F.array_contains("led", F.col("label")), F.col("label")).otherwise(choice)
        wants = materialize(state.join(hubs, "group").select("uid", "key", "group", "size", "label", want.alias("want")), "wants")
        flow = {(r["label"], r["want"]): r["n"] for r in wants.groupBy("label", "want").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards x shards
        held = [sum(n for (a, _), n in flow.items() if a == s) for s in range(shards)]
        asked = sum(n for (a, b), n in flow.items() if a != b)
        moves = flows(flow, held, quota)
        if not any(moves.values()) or (before is not None and asked >= before):
            return wants.select("uid", F.col("want").alias("label"), "group", "size")
        before = asked
        share = F.lit(0.0)
        for (a, b), n in moves.items():
            share = F.when((F.col("label") == a) & (F.col("want") == b), n / flow[a, b]).otherwise(share)
        # A group's members that leave one shard for another go together, but for groups that fill shards.
        unit = F.when(F.col("size") > quota // 8, _unit("key", F.lit(before))).otherwise(_unit("group", F.lit(before)))
        state = wants.select("uid", "key", "group", F.when(unit < share, F.col("want")).otherwise(F.col("label")).alias("label"))


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Rows with equal texts (null counts as empty) are linked. Law `rows`: the shards' counts of rows
    differ by one at most; slots count from 0 in each shard without gaps. Repeated rows, and rows with
    null ids, are placed each for itself. An empty table gives no rows. Only doc_id and text are read, and
    they alone decide: the order of rows and the files that they come in change nothing.
    """
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"))
    # uid tells rows apart; key, which hangs on id and text alone, decides where they go.
    base = materialize(source.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("doc_id", "sha")), "base")
    total = base.count()
    quota = max(1, total // shards)
    start = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int")

    groups = base.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("sha", F.xxhash64("sha").alias("group")), "groups")
    members = materialize(base.join(groups, "sha").select("uid", "key", "group", start.alias("label")), "members")
    labels = materialize(propagate(members, shards, quota), "labels") if not members.isEmpty() else members.select("uid", "label", "group", F.lit(0).cast("long").alias("size"))

    labels = labels.withColumnRenamed("size", "alike")
    rows = base.join(labels, "uid", "left").select("uid", "key", "doc_id", "size", "text_crc32", F.coalesce("label", start).alias("label"), "group", "alike")
    placed = materialize(rows, "placed")
    count = [0] * shards
    for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a shard
        count[r["label"]] = r["n"]
    fuller = sorted(range(shards), key=lambda s: -count[s])[: total % shards]
    target = [total // shards + (s in fuller) for s in range(shards)]
    # Linked rows rank first in their shard, group by group, larger ones before: what overflows is
    # without links, then whole small groups, that stay together in the shard that takes them.
    wide = bucket_count(total)
    large = F.col("alike") > LARGE
    kind = F.lit(63) - F.floor(F.log2("alike"))
    place = F.pmod(F.xxhash64("group"), F.when(large, 1 << 20).otherwise(wide))
    part = F.when(large, F.pmod(F.xxhash64("key"), F.ceil(F.col("alike") / LARGE))).otherwise(0)
    alone = F.lit(64 << 40) + F.pmod(F.xxhash64("key"), F.lit(wide))
    bucket = F.when(F.col("group").isNull(), alone).otherwise(F.shiftleft(kind.cast("long"), 40) + F.shiftleft(place.cast("long"), 18) + part)
    order = ranked(placed, ["label"], bucket, [F.col("group"), F.col("key"), F.col("uid")], "rank")
    over = [max(0, c - t) for c, t in zip(count, target)]
    lack = [max(0, t - c) for c, t in zip(count, target)]
    before = [sum(over[:s]) for s in range(shards)]
    filled = [sum(lack[: s + 1]) for s in range(shards)]  # overflowing rows that shards up to s take
    at = lambda values, i: F.get(F.array(*(F.lit(v).cast("long") for v in values)), i)
    spill = F.col("rank") - at(target, F.col("label")) + at(before, F.col("label"))
    order = order.withColumn("over", F.when(F.col("rank") >= at(target, F.col("label")), spill))
    other = F.size(F.filter(F.array(*(F.lit(v).cast("long") for v in filled)), lambda v: v <= F.col("over")))
    order = order.withColumn("shard", F.when(F.col("over").isNull(), F.col("label")).otherwise(other))
    taken = [f - n for f, n in zip(filled, lack)]
    slot = F.when(F.col("over").isNull(), F.col("rank")).otherwise(at(count, F.col("shard")) + F.col("over") - at(taken, F.col("shard")))
    return order.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
