"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidates.

Documents with the same shingle set form a class; classes are the nodes. A sketch has BINS bins, each
the least hash of its share of the hash range; an empty bin takes the value of a bin that a hash of
its number picks. BANDS bands of equal bins give buckets. A bucket proposes a star: one hub against
all other members, so pairs grow with members, not with their square. The hub is the member whose buckets
have most members in all: it is nearest to the others. Proposed pairs are confirmed on full shingle sets, at first
with one hub a member, of most such weight, which links most and gives each member a profile: what it shares with
that hub, and masks of what either has alone. Two profiles of one hub bound what their members share, exactly.
Then the stars of buckets that are still in several components follow, as far as they go between these.
A star can miss a link between two members that are not the hub's. So such buckets are sorted by their
members' sketches, from several bins on, and neighbours from two components are proposed, if their sizes, their
profiles and two bits of each bin allow a link: at first next ones, which leaves few components, then farther ones.
What is left meets in finer buckets that two bands make together: a pair at similarity 0.8 shares some 30
of these, each of which picks a hub of its own and proposes a star between components. Rounds of this, with
new hubs, go on in a bucket until one links nothing there. Proposals grow with memberships, and none that an
earlier round has confirmed or refuted is tested; no bucket, pair or partner is dropped for its size. Sets
too small to reach the similarity with any other set are classes only.
Members are confirmed by family (the least hub of a member's buckets), each with all its hubs at once: a
round sends a member's set once however many pairs it is in, and a hub's once to each group of members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitions import spread
from . import bloom
from .common import forget, in_tasks, keep_rows, materialize, partition, slices, texts
from .components import components, extended

#: 25 bands of 5 bins (three bins are in none): a pair at similarity 0.8 shares none with probability 5e-5.
BINS, BANDS, BAND_BINS = 128, 25, 5
#: Pairs whose sketches agree in a share of bins that is so many standard deviations below what the
#: similarity gives are dropped unconfirmed. Copied bins don't count; small sets are as good as all confirmed.
DEVIATIONS = 5
#: Shingles in the pairs that one group confirms, about; larger families are dealt to several groups.
GROUP_SHINGLES = 2_000_000
#: Orders in which a round sorts a bucket, bins that an order looks at, and how far apart neighbours are there
#: at most (next to each other in the first such round, which joins most of the components).
ORDERS, ORDER_BINS, REACH = 4, 32, 24
#: Bits that a member's shingles beside its hub's set, and as many that the hub's shingles it lacks set.
PROFILE_BITS = 256
#: Rounds among neighbours, before those in buckets of two bands.
NEAR_ROUNDS = 2

_MIX1, _MIX2, _MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Orders null ids last.
_LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits (splitmix64)."""
    x = x + _MIX1
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased. (A cache of words takes longer than hashing them.)"""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are what white space (space, tab to
    carriage return) separates, A-Z lower-cased; fewer than `width` words are one shingle."""
    out = []
    for text in docs:
        h = word_hashes(text)
        if not len(h):
            out.append(h)
            continue
        k = min(width, len(h))
        s = h[: len(h) - k + 1]
        for i in range(1, k):
            s = mix(s) + h[i : len(h) - k + 1 + i]
        s = np.sort(mix(s + np.uint64(k)))
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _probes(tries: int = 1024) -> np.ndarray:
    n = np.arange(tries * BINS, dtype=np.uint64).reshape(tries, BINS)
    return (mix(n * _MIX3) % np.uint64(BINS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for row, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        values[row, bins[first]] = s[first]
        full[row, bins[first]] = True
    row, col = np.nonzero(~full)
    for probe in _probes():
        if not len(row):
            break
        source = probe[col]
        hit = full[row, source]
        values[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col):  # no probe hit: the next full bin
        values[r, c] = values[r, (c + 1 + np.argmax(np.roll(full[r], -c - 1))) % BINS]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values[:, : BANDS * BAND_BINS].reshape(len(values), BANDS, BAND_BINS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        key = mix(key) + rows[:, :, i]
    return mix(key).view(np.int64)


def linkable(n: int, percent: int) -> bool:
    """Whether a set of n can reach the similarity with a different one: at best it has one element less."""
    return n > 0 and 100 * n >= percent * (n + 1)


def _sketch(width: int, percent: int):
    def run(batches):
        uid, task = 0, partition() << 40
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts(batch["text"]), width)
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            cids = [int.from_bytes(m[:8], "little", signed=True) if m else None for m in marks]
            some = [i for i, s in enumerate(sets) if linkable(len(s), percent)]
            values = sketches([sets[i] for i in some])
            keys, low = band_keys(values), values.astype(np.uint8)
            bits = np.packbits(np.concatenate([low & 1, low >> 1 & 1], axis=1), axis=1).view(np.int64)
            signs: list[bytes | None] = [None] * len(sets)
            twos: list[list[int] | None] = [None] * len(sets)
            count = np.zeros(len(sets), np.int32)
            for row, i in enumerate(some):
                signs[i], twos[i], count[i] = low[row].tobytes(), bits[row].tolist(), BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["row_hash"], pa.array(np.arange(uid, uid + len(sets)) + task, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()), pa.array(cids, pa.int64()), pa.array(signs, pa.binary()), pa.array(twos, pa.list_(pa.int64())), bands,
                ],
                ["doc_id", "row_hash", "uid", "n", "mark", "cid", "sign", "bits", "bands"],
            )
            uid += len(sets)

    return run


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _likely(percent: int):
    def run(batches):
        for b in batches:
            na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
            low = np.minimum(na, nb)
            ok = 100 * low >= percent * np.maximum(na, nb)
            filled = BINS * (1 - (1 - 1 / BINS) ** low)
            least = percent / 100 - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) / filled)
            ok &= (_signs(b["sa"]) == _signs(b["sb"])).mean(axis=1) >= least
            yield b.select(["a", "b", "host", "family", "na", "nb"]).filter(pa.array(ok))

    return run


def _confirm(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {c: np.frombuffer(s, np.uint64) for c, s in zip(sets["cid"].to_pylist(), sets["shingles"].to_pylist())}
        ok = []
        for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = held[x], held[y]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _mask(shingles: np.ndarray) -> list[int]:
    bits = np.zeros(PROFILE_BITS, bool)
    bits[(shingles & np.uint64(PROFILE_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _profile(percent: int):
    """As _confirm, for pairs of one hub a member: whether full sets confirm each, and the member's profile, which
    is what it shares with the hub, and masks of what only the member and only the hub has."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {c: np.frombuffer(s, np.uint64) for c, s in zip(sets["cid"].to_pylist(), sets["shingles"].to_pylist())}
        out: dict[str, list] = {"ok": [], "cid": [], "both": [], "added": [], "lacked": []}
        for a, b, host in zip(*(pairs[c].to_pylist() for c in ("a", "b", "host"))):
            cid = b if a == host else a
            x, y = held[cid], held[host]
            both = np.intersect1d(x, y, assume_unique=True)
            ok = 100 * len(both) >= percent * (len(x) + len(y) - len(both))
            masks = [_mask(np.setdiff1d(s, both, assume_unique=True)) for s in (x, y)]
            for column, value in zip(out.values(), (ok, cid, len(both), *masks)):
                column.append(value)
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array(column, kind) for column, kind in zip(out.values(), kinds)]
        return pa.Table.from_arrays([pairs["a"], pairs["b"], pairs["host"], *columns], ["a", "b", "ref", *out])

    return run


def _key_positions(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """Bit positions of the hashes in column `key`."""
    keys = batch["key"].to_numpy().view(np.uint64)
    parts = (keys, mix(keys), mix(keys ^ _MIX2))
    return np.stack([p & np.uint64(bits - 1) for p in parts], axis=1).astype(np.int64)


def _sets(width: int, bits: int, shared):
    def run(batches):
        met = set()
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(bloom.held(seen, _key_positions(batch, bits))))
            again = np.ones(batch.num_rows, bool)
            for i, key in enumerate(batch["key"].to_pylist()):  # a repeated row is sent once
                again[i] = key not in met
                met.add(key)
            for part in slices([batch.filter(pa.array(again))], "text", 1 << 20):
                found = shingle_sets(texts(part["text"]), width)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_hash"], pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "row_hash", "shingles"])

    return run


class _Links:
    """Confirms proposed pairs and keeps what has been proposed and linked."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> None:
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.labels: DataFrame | None = None  # node, component of all that is linked so far
        self.new: DataFrame | None = None  # links of the last round
        self.profiles: DataFrame | None = None  # cid, ref (a hub), both, added, lacked of members that were tested with ref
        self.tested: list[DataFrame] = []  # pairs that were confirmed or refuted

    def star(self, proposed: DataFrame, profiled: bool = False) -> bool:
        """Confirm pairs of members and hubs (cid, hub) that have not been tested; true if there are new links.
        With `profiled`, for one hub a member, their profiles are kept."""
        pairs = proposed.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"), "hub", F.lit(0).alias("old"))
        for done in self.tested:
            pairs = pairs.unionByName(done.select("a", "b", F.col("host").alias("hub"), F.lit(1).alias("old")))
        pairs = pairs.groupBy("a", "b").agg(F.min("hub").alias("host"), F.max("old").alias("old")).where("old = 0").select("a", "b", "host")
        sides = [self.classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}"), F.col("family").alias(f"f{c}")) for c in "ab"]
        family = F.when(F.col("a") == F.col("host"), F.col("fb")).otherwise(F.col("fa")).alias("family")
        likely = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "host", family, "na", "sa", "nb", "sb")
        likely = materialize(in_tasks(likely, _likely(self.percent), "a long, b long, host long, family long, na long, nb long"), "likely")
        if likely.isEmpty():
            forget(likely)
            return False
        self.tested.append(likely)
        if profiled:
            self.profiles = materialize(self.confirm(likely, _profile, "a long, b long, ref long, ok boolean, cid long, both long, added array<long>, lacked array<long>"), "profiles")
            self.new = found = self.profiles.where("ok").select("a", "b")
        else:
            self.new = found = materialize(self.confirm(likely, _confirm, "a long, b long"), "links")
        gained = not found.isEmpty()
        if gained:
            self.labels = components(found) if self.labels is None else extended(self.labels, found)
        return gained

    def confirm(self, likely: DataFrame, judge, schema: str) -> DataFrame:
        """What `judge` tells of the pairs by their full sets. Members of a family meet in one group, or in several if their pairs
        hold more than GROUP_SHINGLES, with all their hubs: a member's set is sent once, a hub's once a group."""
        other = F.when(F.col("a") == F.col("host"), F.col("b")).otherwise(F.col("a"))
        dealt = likely.select("a", "b", "host", "family", other.alias("cid"), F.lit(0).cast("long").alias("part"))
        groups = F.ceil(F.sum(F.col("na") + F.col("nb")) / GROUP_SHINGLES).alias("groups")
        large = materialize(likely.groupBy("family").agg(groups).where("groups > 1"), "large")
        if not large.isEmpty():
            part = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("groups")), F.lit(0)).alias("part")
            dealt = materialize(dealt.join(F.broadcast(large), "family", "left").select("a", "b", "host", "family", "cid", part), "dealt")
        group = [F.col("family").alias("h"), F.col("part").alias("p")]
        needed = dealt.select("cid", *group).unionByName(dealt.select(F.col("host").alias("cid"), *group)).distinct()
        return dealt.groupBy("family", "part").cogroup(self.sets_of(needed).groupBy("h", "p")).applyInArrow(judge(self.percent), schema)

    def sets_of(self, needed: DataFrame) -> DataFrame:
        """needed (cid, h, p) with the shingles of the class, from the text of one of its rows. A filter of
        bounded size keeps other rows from being shingled or moved."""
        wanted = materialize(needed.join(self.classes, "cid").select("cid", "h", "p", "doc_id", "row_hash"), "wanted")
        key = F.xxhash64(F.coalesce("doc_id", F.lit(_LAST)), "row_hash").alias("key")
        bits = bloom.bits_for(wanted.count())
        seen = bloom.fold(wanted.select(key), _key_positions, bits, "seen")
        shared = wanted.sparkSession.sparkContext.broadcast(seen.tobytes())
        rows = self.docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).select("doc_id", "text", "row_hash", key)
        found = in_tasks(rows, _sets(self.width, bits, shared), "doc_id long, row_hash long, shingles binary")
        same = found["doc_id"].eqNullSafe(wanted["doc_id"]) & (found["row_hash"] == wanted["row_hash"])
        return found.join(wanted, same).select("cid", "h", "p", "shingles")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, cid, hub, size) of buckets in several components, with their component."""
    known = labels.withColumnRenamed("node", "cid")
    placed = materialize(members.join(known, "cid", "left").select("bucket", "cid", "hub", "size", F.coalesce("component", "cid").alias("component")), "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("cid") == F.col("hub"), F.col("component"))).alias("home")).where("low < high").select("bucket", "home")
    found = materialize(placed.join(split, "bucket"), "open")
    forget(placed)
    return found


def _overlap(x, y):
    """What two structs (n, ref, both, added, lacked) of one ref share at most. Each bit that only one of them has
    is from a shingle, at least, that the other has not: one beside the hub's, or one of the hub's."""

    def only(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)

    beside = F.least(x["n"] - x["both"] - only(x["added"], y["added"]), y["n"] - y["both"] - only(y["added"], x["added"]))
    inside = F.least(x["both"] - only(y["lacked"], x["lacked"]), y["both"] - only(x["lacked"], y["lacked"]))
    return beside + inside


def _may_link(x, y, percent: int):
    """Whether two structs (n, bits) can be linked: by their sizes, and by two bits of each bin. Two bins that
    differ have half of their bits in common; the limit is DEVIATIONS from what the similarity gives, as in _likely."""
    low, high = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    apart = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    filled = F.lit(BINS) * (F.lit(1.0) - F.pow(F.lit(1 - 1 / BINS), low))
    differ = 1 - percent / 100
    most = differ + F.lit(DEVIATIONS) * F.sqrt(F.lit(1.5 * differ - differ * differ) / filled)
    # By their profiles, if these are of one hub; this bound is exact.
    shared = F.coalesce(F.when(x["ref"] == y["ref"], _overlap(x, y)), low)
    return (100 * low >= percent * high) & (100 * shared >= percent * (x["n"] + y["n"] - shared)) & (apart <= BINS * most)


def _nearer(still: DataFrame, links: _Links, salt: int) -> DataFrame:
    """cid, hub of neighbours from two components in a bucket, its members sorted by their sketches: members
    that agree in the first bins of an order stand together, in as many as it takes to part them. Each bucket
    and salt has ORDERS orders, that start at bins of their own. A pair comes once an end, however many buckets
    and orders it is near in."""
    profile = ["ref", "both", "added", "lacked"]
    signed = still.join(links.classes.select("cid", "n", "sign", "bits"), "cid")
    if links.profiles is None:  # nothing has been tested
        signed = signed.select("*", *(F.lit(None).cast("long" if c in profile[:2] else "array<long>").alias(c) for c in profile))
    else:
        signed = signed.join(links.profiles.select("cid", *profile), "cid", "left")
    orders = [F.expr(f"substring(concat(sign, sign), cast(pmod(xxhash64(bucket, {salt}, {i}), {BINS}) as int) + 1, {ORDER_BINS})").alias(f"o{i}") for i in range(ORDERS)]
    keyed = signed.select("bucket", F.struct("cid", "component", "n", "bits", *profile).alias("own"), *orders)
    reach = REACH if salt > 1 else 1
    before = [F.collect_list("own").over(Window.partitionBy("bucket").orderBy(f"o{i}", "own.cid").rowsBetween(-reach, -1)) for i in range(ORDERS)]
    others = F.filter(F.concat(*before), lambda p: p["component"] != F.col("own.component"))
    near = keyed.select("own", others.alias("others"))
    likely = F.filter("others", lambda p: _may_link(p, F.col("own"), links.percent))
    near = near.where("size(others) > 0").select("own.cid", F.array_distinct(F.transform(likely, lambda p: p["cid"])).alias("hubs")).where("size(hubs) > 0")
    return near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs")).select("cid", F.explode("hubs").alias("hub"))


def _finer(still: DataFrame, salt: int) -> DataFrame:
    """cid, hub of stars between components, in buckets that two bands make together."""
    buckets = F.sort_array(F.collect_set("bucket"))  # at most BANDS
    later = lambda b, i: F.transform(F.slice("buckets", i + 2, BANDS), lambda c: F.xxhash64(b, c))
    fine = still.groupBy("cid", "component").agg(buckets.alias("buckets")).select("cid", "component", F.explode(F.flatten(F.transform("buckets", later))).alias("fine"))
    fine = materialize(fine, "fine")
    order = F.xxhash64("cid", "fine", F.lit(salt))
    hubs = fine.groupBy("fine").agg(F.min_by("cid", order).alias("hub"), F.min_by("component", order).alias("home"), F.min("component").alias("low"), F.max("component").alias("high"))
    return fine.join(hubs.where("low < high").select("fine", "hub", "home"), "fine").where("component <> home").select("cid", "hub")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    One row per row: doc_id, row_hash, n_shingles, component_id (the least doc_id reachable), kept
    (doc_id = component_id), row_kept (one row of each component). Null, empty and white texts have no
    shingles and are linked with nothing: component_id is their own doc_id, and they stay. Rows of one
    doc_id are nodes of their own; null ids are never a component's least unless all are null. An
    empty table gives no rows. Only doc_id and text are read. Classes are told apart by 128 bits of their
    sets' hashes, and by 64 of these while links are looked for.
    """
    docs = spread(docs.select("doc_id", "text"))
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    found = materialize(in_tasks(source, _sketch(width, percent), "doc_id long, row_hash long, uid long, n long, mark binary, cid long, sign binary, bits array<long>, bands array<long>"), "sketches")
    order = F.coalesce("doc_id", F.lit(_LAST))
    classes = found.where("n > 0").groupBy("mark").agg(F.min("cid").alias("cid"), F.min("doc_id").alias("least"), F.min_by("uid", order).alias("best"))
    classes = materialize(classes, "classes")

    bands = found.select(F.explode("bands").alias("bucket"), "cid")
    hubs = bands.groupBy("bucket").agg(F.min("cid").alias("low"), F.max("cid").alias("top"))
    hubs = materialize(hubs.where("low < top").select("bucket"), "hubs")
    met = materialize(bands.join(hubs, "bucket").select("bucket", "cid").distinct(), "met")
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    weights = met.join(sizes, "bucket").groupBy("cid").agg(F.sum("size").alias("weight"))
    central = F.max_by("cid", F.struct("weight", F.bitwise_not("cid"))).alias("hub")
    centres = met.join(weights, "cid").groupBy("bucket").agg(central, F.max("weight").alias("weight"), F.count(F.lit(1)).alias("size"))
    members = materialize(met.join(centres, "bucket"), "members")
    forget(hubs, met)
    families = members.groupBy("cid").agg(F.min("hub").alias("family"))
    chosen = families.join(classes, "cid").select(F.col("best").alias("uid"), "family")
    partnered = found.join(chosen, "uid").select("cid", "n", "sign", "bits", "family", "doc_id", "row_hash")
    links = _Links(docs, materialize(partnered, "partnered"), width, percent)
    nearest = members.where("cid <> hub").groupBy("cid").agg(F.max_by("hub", F.struct("weight", F.bitwise_not("hub"))).alias("hub"))
    nearest = materialize(nearest, "nearest")
    gained, salt, active = links.star(nearest, profiled=True), 0, members
    while gained or salt <= NEAR_ROUNDS + 1:
        # Without any link so far, every member is a component of its own.
        labels = links.labels if links.labels is not None else nearest.select(F.col("cid").alias("node"), F.col("cid").alias("component"))
        still = _open(active, labels)
        if not salt:
            proposed = still.where("component <> home").select("cid", "hub")
        else:
            proposed = _nearer(still, links, salt) if salt <= NEAR_ROUNDS else _finer(still, salt)
        gained = links.star(proposed)
        active = still.where("size > 2").select("bucket", "cid", "hub", "size")
        if gained and salt > 1:  # neighbours next to each other are too few to give a bucket up
            linked = links.new.select(F.explode(F.array("a", "b")).alias("cid"))
            active = active.join(active.join(linked, "cid", "left_semi").select("bucket").distinct(), "bucket", "left_semi")
        salt += 1
    forget(members, nearest, *links.tested, *([links.profiles] if links.profiles is not None else []))

    if links.labels is None:
        classed = classes.select("mark", F.col("least").alias("component_id"), "best")
    else:
        joined = links.labels.withColumnRenamed("node", "cid")
        together = classes.join(joined, "cid").select("mark", "component", "least", "best")
        lowest = together.groupBy("component").agg(F.min("least").alias("lowest"), F.min_by("best", F.coalesce("least", F.lit(_LAST))).alias("first"))
        better = together.join(lowest, "component").select("mark", "lowest", "first")
        classed = classes.join(better, "mark", "left").select("mark", F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"), F.coalesce("first", "best").alias("best"))
        classed = materialize(classed, "classed")
        forget(classes)
    rows = found.select("doc_id", "row_hash", "uid", "n", "mark")
    linked = rows.where("n > 0").join(classed, "mark").select("doc_id", "row_hash", "uid", "n", "component_id", "best")
    alone = rows.where("n = 0").select("doc_id", "row_hash", "uid", "n", F.col("doc_id").alias("component_id"), F.col("uid").alias("best"))
    return linked.unionByName(alone).select(
        "doc_id", "row_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("uid") == F.col("best")).alias("row_kept")
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component left, the one with the least doc_id; all columns."""
    return keep_rows(docs, near_duplicates(docs, width, percent), "row_kept")
