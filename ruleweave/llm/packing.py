"""Best-fit packing by bin completion.

How well pieces pack depends on their lengths alone, and there are at most `capacity` different
lengths. So the search runs on the driver over a histogram of bounded size: it fills a sequence around
the longest piece left, tries undominated fillings, prunes by a bound on waste, and repeats a filling
while its lengths last. It can be stopped at any time: the best plan so far is kept, from best fit at
first, and the search ends when that meets a lower bound, or after NODE_LIMIT steps. The plan says how
often each filling is used; pieces find their sequence by their rank among pieces of equal length, in a
join and a distributed rank.
"""

from __future__ import annotations

import bisect
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.partitions import spread
from .common import bucket_count, in_tasks, materialize, ranked, slices

CAPACITY = 2048
END_ID = 0
#: Search steps in all, steps that list the fillings of one sequence, and fillings tried at each step.
NODE_LIMIT, FILLING_STEPS, WIDTH = 800, 400, 6


# -- tokens ---------------------------------------------------------------------------------


#: Texts with so many characters in a row that are all white, or none, go to `tokenizers`, which takes time
#: in proportion to them; the other's regular expressions overflow on some.
LONG_RUN = 4096
_RUNS = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
#: Fixed: how the `ByteLevel` pre-tokenizer cuts a text.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token and its rank, if the file says what ranks can: a byte-level vocabulary without
    normalizer whose merges give tokens in the order of their ids."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not (spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if model.get("type", "BPE") != "BPE" or not plain or any(cut.get(k) != v for k, v in _BYTE_LEVEL.items()):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [vocab.get(c) for c in byte_of]
    if None in merged or None in single or any(a >= b for a, b in zip(merged, merged[1:])) or (merged and max(single) >= merged[0]):
        return None
    made = set(merged) | set(single)
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i in made}


def load_encoder(vocabulary: str):
    """text -> ids, as tokenizers.Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).

    Runs the vocabulary's merges, by their ranks, in tiktoken, which is several times faster. A text that
    spells a special token or has a very long run goes to the tokenizer itself, which is loaded when the
    first such text comes; so does every text if ranks cannot stand for the file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens") or ()]
    ranks = _ranks(spec)
    del spec
    fast = tiktoken.Encoding("ranks", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}) if ranks else None
    exact: list = []

    def encode(text: str) -> np.ndarray:
        if fast and not any(s in text for s in specials) and not (len(text) >= LONG_RUN and _RUNS.search(text)):
            return np.array(fast.encode_ordinary(text), "<u4")
        if not exact:
            exact.append(Tokenizer.from_file(vocabulary))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _pieces(vocabulary: str, capacity: int, with_ids: bool):
    def pieces(batches):
        encode = None
        for batch in slices(batches, "text"):
            encode = encode or load_encoder(vocabulary)
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if not piece else start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of at most `capacity` tokens."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_tasks(spread(docs.select("doc_id", "text")), _pieces(vocabulary, capacity, with_ids), schema)


# -- search ---------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces that cannot share."""
    best = -(-sum(n * k for n, k in counts.items()) // capacity)
    lengths = sorted(counts)
    for low in [n for n in lengths if n <= capacity // 2][:64] + [capacity // 2]:
        large = sum(k for n, k in counts.items() if n > capacity - low)
        middle = [(n, k) for n, k in counts.items() if capacity // 2 < n <= capacity - low]
        small = sum(n * k for n, k in counts.items() if low <= n <= capacity // 2)
        room = sum((capacity - n) * k for n, k in middle)
        best = max(best, large + sum(k for _, k in middle) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: (times, filling)."""
    plan: dict[tuple[int, ...], int] = {}
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                fit = min(left, max(1, left))
                filling, times, room = (n,), fit, capacity - n
                # A run of equal pieces opens bins that take as many of them as fit.
                each = min(capacity // n, left)
                times, filling, room = left // each, (n,) * each, capacity - n * each
                left -= times * each
            else:
                room = rooms[i]
                filling, have = next(iter(open_bins[room].items()))
                times = min(have, left)
                if times == have:
                    del open_bins[room][filling]
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(i)
                else:
                    open_bins[room][filling] = have - times
                filling, room, left = (*filling, n), room - n, left - times
            if room and room >= 1:
                if room not in open_bins:
                    bisect.insort(rooms, room)
                    open_bins[room] = {}
                open_bins[room][filling] = open_bins[room].get(filling, 0) + times
            else:
                plan[filling] = plan.get(filling, 0) + times
    for group in open_bins.values():
        for filling, times in group.items():
            plan[filling] = plan.get(filling, 0) + times
    return [(times, filling) for filling, times in plan.items()]


def _widened(sums: int, by: int) -> int:
    """Bits n to n + by for each bit n."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def dominated(chosen: tuple[int, ...], waste: int, free: int) -> bool:
    """Whether a free piece (bits of `free`: lengths) could stand for several chosen ones that are as long
    together, or for one or more that are shorter by the waste at most: that filling is as good at least."""
    one = two = 0  # sums of one piece, and of two or more
    for n in chosen:
        two |= two << n | one << n
        one |= 1 << n
    longer = _widened(one << 1, waste - 1) if waste else 0
    return bool((_widened(two, waste) | longer) & free)


def completions(counts: dict[int, int], largest: int, capacity: int, most: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings around one piece of the largest length, least waste first.

    Fillings are listed from the longest pieces on, until there are `most` without waste or for
    FILLING_STEPS; greedy filling and one without waste, if there is any, are looked at besides.
    """
    room = capacity - largest
    lengths = [n for n in sorted(counts, reverse=True) if n <= room and counts[n] - (n == largest) > 0]
    have = {n: counts[n] - (n == largest) for n in lengths}
    found: dict[tuple[int, ...], int] = {}
    steps, exact = 0, 0

    def add(chosen: tuple[int, ...]) -> None:
        nonlocal exact
        chosen = tuple(sorted(chosen, reverse=True))
        waste = room - sum(chosen)
        free = sum(1 << n for n in lengths if chosen.count(n) < have[n])
        if chosen not in found and not dominated(chosen, waste, free):
            found[chosen] = waste
            exact += not waste

    todo: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while todo and steps < FILLING_STEPS and exact < most:
        steps += 1
        i, left, chosen = todo.pop()
        if i < len(lengths) and lengths[i] == (chosen[-1] if chosen else 0) and chosen.count(lengths[i]) >= have[lengths[i]]:
            i += 1
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i == len(lengths):
            add(chosen)
            continue
        todo.append((i + 1, left, chosen))  # then those without this length
        todo.append((i, left - lengths[i], (*chosen, lengths[i])))
    full = _exact_sum(have, room)
    if full is not None:
        add(full)
    greedy = _greedy(have, lengths, room)
    add(greedy)
    if not found:
        found[greedy] = 0
    return [(largest, *c) for c in sorted(found, key=lambda c: (found[c], len(c), [-n for n in c]))[:most]]


def _greedy(have: dict[int, int], lengths: list[int], room: int) -> tuple[int, ...]:
    out: list[int] = []
    for n in lengths:
        take = min(have[n], room // n)
        out += [n] * take
        room -= n * take
    return tuple(out)


def _exact_sum(have: dict[int, int], room: int) -> tuple[int, ...] | None:
    """A filling without waste, made of the longest pieces that allow one."""
    full = (1 << (room + 1)) - 1
    lengths = sorted(have)  # each layer adds a longer length
    layers = [1]
    for n in lengths:
        reach, extra = layers[-1], min(have[n], room // n)
        step = 1
        while extra > 0:  # counts in powers of two
            take = min(step, extra)
            reach |= (reach << (n * take)) & full
            extra -= take
            step <<= 1
        layers.append(reach)
    if not layers[-1] >> room & 1:
        return None
    out, rest = [], room
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        take = next(k for k in range(min(have[n], rest // n), -1, -1) if layers[i] >> (rest - n * k) & 1)
        out += [n] * take
        rest -= n * take
    return tuple(out)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """Fillings and how often each is used; every piece of the histogram has a place.

    Half of the steps go to depth-first bin completion, which branches from the back, where fillings
    have the fewest pieces to choose from. The others go to descents that now and then take another than
    the first filling, or fewer repeats of it, at any depth. A branch ends when its waste so far shows
    that it cannot beat the incumbent, the search when the incumbent meets the lower bound.
    """
    counts = {n: k for n, k in counts.items() if k}
    if not counts:
        return []
    bound, total = lower_bound(counts, capacity), sum(n * k for n, k in counts.items())
    incumbent = best_fit(counts, capacity)
    best, nodes, rng = sum(t for t, _ in incumbent), node_limit, random.Random(0)

    def after(left: dict[int, int], filling: tuple[int, ...], share: float = 1.0) -> tuple[int, dict[int, int]]:
        need = Counter(filling)
        times = max(1, int(share * min(left[n] // k for n, k in need.items())))
        return times, {n: r for n, k in left.items() if (r := k - need.get(n, 0) * times)}

    # Depth first: the path so far, and at each depth the choices left and what they start from.
    path: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[list[tuple[int, ...]], dict[int, int], int]] = []
    left, waste = counts, 0
    while nodes > node_limit // 2 and best > bound:
        nodes -= 1
        if not left:
            if (used := sum(t for t, _ in path)) < best:
                best, incumbent = used, list(path)
        elif waste <= (best - 1) * capacity - total:
            stack.append((completions(left, max(left), capacity), left, waste))
        while stack and not stack[-1][0]:
            stack.pop()
        if not stack:
            return incumbent  # all has been tried
        options, base, before = stack[-1]
        del path[len(stack) - 1 :]
        filling = options.pop(0)
        times, left = after(base, filling)
        waste = before + times * (capacity - sum(filling))
        path.append((times, filling))
    while nodes > 0 and best > bound:
        path, left, waste = [], counts, 0
        while left and nodes > 0 and waste <= (best - 1) * capacity - total:
            nodes -= 1
            options = completions(left, max(left), capacity)
            other = rng.random() < 0.15
            filling = options[rng.randrange(len(options)) if other else 0]
            times, left = after(left, filling, rng.random() if rng.random() < 0.15 else 1.0)
            waste += times * (capacity - sum(filling))
            path.append((times, filling))
        if not left and (used := sum(t for t, _ in path)) < best:
            best, incumbent = used, path
    return incumbent


# -- assignment -----------------------------------------------------------------------------


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A document's ids are followed by id 0. Only documents longer than `capacity` are cut; their first
    piece takes the remainder. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids). Null and empty texts are one piece of one token; rows with equal or null doc_id
    are packed each for itself; an empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for times, filling in plan_sequences(counts, capacity):
        offset = 0
        for n in filling:
            slots.append((n, taken[n], taken[n] + times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(bucket_count(sum(counts.values()))))
    ordered = ranked(pieces, ["length"], bucket, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    # Slots of a length, cut at the ranks where one ends: a piece finds its slot by binary search.
    starts: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in counts}
    for n, low, _, first, offset in slots:
        for column, value in zip(starts[n], (low, first, offset)):
            column.append(value)
    shared = spark.sparkContext.broadcast({n: tuple(np.array(c, np.int64) for c in cols) for n, cols in starts.items()})

    def place(batches):
        table = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            where, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                low, first, at = table[int(n)]
                mine = length == n
                slot = np.searchsorted(low, rank[mine], "right") - 1
                where[mine], offset[mine] = first[slot] + rank[mine] - low[slot], at[slot]
            kept = batch.drop_columns(["_rank"])
            yield kept.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return in_tasks(ordered.select(*pieces.columns, "_rank"), place, schema)
