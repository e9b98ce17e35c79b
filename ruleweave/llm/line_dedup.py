"""Line dedup by pairwise alignment.

A short line is common by chance, so documents are linked through rarer hashes: of windows, the shortest
runs of lines that have LEAST_WORDS words. Every holder of a window is paired with the window's first
holder, a star, so pairs grow with holders and not with their square. Each pair is aligned with patience
diff: lines that are unique in both anchor the alignment, the longest rising run of anchors is kept, and
the stretches between are aligned alike. Aligned blocks of enough words are deleted from the later
document, and wherever else it has them. What a pair still shares after that, in another order, is
aligned again; after ROUNDS alignments the windows that are left are deleted as their hashes match.

So no run of LEAST_WORDS words is left that an earlier document has: such a run is the union of its
windows, and each of these is aligned with its first holder.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.partitions import spread
from .common import fresh, in_tasks, materialize, partition, slices

#: Blocks of fewer words stay: they are common by chance.
LEAST_WORDS = 5
#: Alignments of one pair.
ROUNDS = 3
#: Lines of later documents that one group of pairs holds, about.
GROUP_LINES = 20_000

_SHORT, _LONG = pa.list_(pa.int32()), pa.list_(pa.int64())


def windows(words: np.ndarray, least: int) -> np.ndarray:
    """First and last number of the shortest runs, from each line on and up to each, of `least` words.

    words: of each line, at least one. Any run of `least` words is the union of the windows inside it: a
    line is in the window that ends at it, or else in the one from the run's start.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.flatnonzero(total[1:] >= least)
    starts = np.flatnonzero(total[:-1] + least <= total[-1])
    upto = np.column_stack([np.searchsorted(total, total[ends + 1] - least, "right") - 1, ends])
    onto = np.column_stack([starts, np.searchsorted(total, total[starts] + least, "left") - 1])
    return np.unique(np.concatenate([upto, onto]).astype(np.int64), axis=0)


def _lines(least: int):
    """Of each text: its lines that aren't white (hash, number, words) and its windows (hash, first, last)."""

    def run(batches):
        uid, task = 0, partition() << 40
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(7)]
            for text in batch["text"].to_pylist():
                lines = [x.strip() for x in (text or "").split("\n")]
                at = [i for i, x in enumerate(lines) if x]
                digests = [xxhash.xxh64_digest(lines[i]) for i in at]
                words = np.array([len(lines[i].split()) for i in at], np.int64)
                found = windows(words, least)
                keys = [xxhash.xxh64_intdigest(b"".join(digests[a : b + 1])) - (1 << 63) for a, b in found.tolist()]
                for col, value in zip(cols, (len(lines) if text else 0, np.frombuffer(b"".join(digests), ">i8"), at, words, keys, found[:, 0], found[:, 1])):
                    col.append(value)
            n = batch.num_rows
            kinds = [pa.int64(), _LONG, _SHORT, _SHORT, _LONG, _SHORT, _SHORT]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_hash"], pa.array(np.arange(uid, uid + n) + task, pa.int64()), *(pa.array([np.asarray(x).astype(k.value_type.to_pandas_dtype()) for x in c] if i else c, k) for i, (c, k) in enumerate(zip(cols, kinds)))],
                ["doc_id", "row_hash", "uid", "n_lines", "hashes", "places", "words", "keys", "begins", "ends"],
            )
            uid += n

    return run


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned places of two sequences of (place, line), in rising order of both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0][1] == b[b0][1]:
            out.append((a[a0][0], b[b0][0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1][1] == b[b1 - 1][1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a[a1][0], b[b1][0]))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _unique(a, a0, a1), _unique(b, b0, b1)
        anchors = sorted((j, once_a[h]) for h, j in once_b.items() if h in once_a)
        if not anchors:
            # No line is unique in both: go on at the first line of b that a still has.
            following = {h: i for i, h in reversed([(i, a[i][1]) for i in range(a0, a1)])}
            skip = next((j for j in range(b0, b1) if b[j][1] in following), None)
            if skip is not None:
                todo.append((following[b[skip][1]], a1, skip, b1))
            continue
        run = _rising(anchors)
        i, j = a0, b0
        for y, x in run:
            todo.append((i, x, j, y))
            out.append((a[x][0], b[y][0]))
            i, j = x + 1, y + 1
        todo.append((i, a1, j, b1))
    return sorted(out)


def _unique(s: list[tuple[int, int]], low: int, high: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for i in range(low, high):
        h = s[i][1]
        found[h] = -1 if h in found else i
    return {h: i for h, i in found.items() if i >= 0}


def _rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors that rises in both places."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, x) in enumerate(anchors):
        k = bisect.bisect_left(tails, x)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x)
            ends.append(n)
        else:
            tails[k], ends[k] = x, n
    out, n = [], ends[-1]
    while n >= 0:
        out.append(anchors[n])
        n = back[n]
    return out[::-1]


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Places in the later document of aligned runs without a gap on either side."""
    out: list[list[int]] = []
    before = None
    for x, y in pairs:
        if before == (x - 1, y - 1):
            out[-1].append(y)
        else:
            out.append([y])
        before = (x, y)
    return out


def _partners(batches):
    """A row for each later document and first holder: the windows that they share, with their lines."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            first_of = {x["hash"]: x["first"] for x in row["shared"]}
            by: dict[int, list[int]] = {}
            for n, key in enumerate(row["keys"]):
                if key in first_of:
                    by.setdefault(first_of[key], []).append(n)
            for first, mine in by.items():
                lines = sorted({i for n in mine for i in range(row["begins"][n], row["ends"][n] + 1)})
                number = {i: k for k, i in enumerate(lines)}
                # Lines keep their neighbours: a gap between two that are apart is a number left out.
                rows.append((first, row["uid"], lines, *([row[c][i] for i in lines] for c in ("hashes", "places", "words")), [row["keys"][n] for n in mine], [number[row["begins"][n]] for n in mine], [number[row["ends"][n]] for n in mine]))
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), _SHORT, _LONG, _SHORT, _SHORT, _LONG, _SHORT, _SHORT]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["first", "uid", "lines", "hashes", "places", "words", "keys", "begins", "ends"])


def shared_lines(first: dict, later: dict, least: int) -> list[int]:
    """Numbers in the later document of the lines to delete, of a pair. first: `hashes` of its lines, and
    `windows`, a hash's first run. later: `lines`, `hashes`, `places`, `words`, and windows in `keys`, `begins`, `ends`."""
    line, drop = later["lines"], set()
    runs: dict[int, list[range]] = {}
    for key, a, b in zip(later["keys"], later["begins"], later["ends"]):
        runs.setdefault(key, []).append(range(a, b + 1))
    todo = list(runs)
    for _ in range(ROUNDS):
        a = sorted({i for key in todo for i in first["windows"][key]})
        b = sorted({j for key in todo for j in runs[key][0]})
        aligned = patience([(i, first["hashes"][i]) for i in a], [(line[j], later["hashes"][j]) for j in b])
        held = {line[j]: j for j in b}
        gone = set()
        for block in blocks(aligned):
            if sum(later["words"][held[i]] for i in block) >= least:
                gone.update(held[i] for i in block)
        drop |= gone
        left = []
        for key in todo:
            if drop.issuperset(runs[key][0]):
                drop.update(j for run in runs[key] for j in run)
            else:
                left.append(key)
        if not left or len(left) == len(todo):
            todo = left
            break
        todo = left
    drop.update(j for key in todo for run in runs[key] for j in run)
    return sorted(later["places"][j] for j in drop)


def _align(least: int):
    def run(later: pa.Table, firsts: pa.Table) -> pa.Table:
        row = firsts.slice(0, 1).to_pylist()[0]
        first = {"hashes": row["hashes"], "windows": {}}
        for key, a, b in zip(row["keys"], row["begins"], row["ends"]):
            first["windows"].setdefault(key, range(a, b + 1))
        gone = [shared_lines(first, x, least) for batch in later.to_batches(1024) for x in batch.to_pylist()]
        return pa.table({"uid": later["uid"], "deleted": pa.array(gone, _SHORT)})

    return run


def deletions(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, row_hash, n_lines, deleted of every row: the numbers of the lines to delete, from 0.

    Lines end at newlines and are compared without white space around; white lines don't count and are
    never deleted. Of two documents the one with the larger doc_id is later; null ids come last, and rows
    of one id are ordered too, so that copies of a row lose their lines to one. Null and empty texts have
    no lines. An empty table gives no rows. Only doc_id and text are read.
    """
    source = spread(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    sequence = "hashes array<long>, places array<int>, words array<int>, keys array<long>, begins array<int>, ends array<int>"
    found = materialize(in_tasks(source, _lines(least), f"doc_id long, row_hash long, uid long, n_lines long, {sequence}"), "lines")
    window = found.select("doc_id", "uid", F.explode(F.array_distinct("keys")).alias("hash"))
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "uid")
    firsts = window.groupBy("hash").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("hash", F.col("at.uid").alias("first")), "firsts")
    shared = window.join(firsts, "hash").where("uid <> first").groupBy("uid").agg(F.collect_list(F.struct("first", "hash")).alias("shared"))  # at most a document's windows
    pairs = in_tasks(found.join(shared, "uid").select("uid", "hashes", "places", "words", "keys", "begins", "ends", "shared"), _partners, f"first long, uid long, lines array<int>, {sequence}")
    pairs = materialize(pairs, "pairs")
    parts = materialize(pairs.groupBy("first").agg(F.ceil(F.sum(F.size("lines")) / GROUP_LINES).alias("parts")), "parts")
    dealt = pairs.join(parts, "first").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    holders = parts.select(F.col("first").alias("uid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")).join(found, "uid")
    holders = holders.select(F.col("uid").alias("f"), "p", "hashes", "keys", "begins", "ends")
    aligned = dealt.groupBy("first", "part").cogroup(holders.groupBy("f", "p")).applyInArrow(_align(least), "uid long, deleted array<int>")
    gone = aligned.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))  # at most a document's lines
    none = F.array().cast("array<int>")
    return found.select("doc_id", "row_hash", "uid", "n_lines").join(gone, "uid", "left").select("doc_id", "row_hash", "n_lines", F.coalesce("deleted", none).alias("deleted"))


def spans(deleted: str) -> Column:
    """Line numbers as text, runs joined: 3-5,9-9."""
    far = F.array(F.lit(-2))
    n = F.size(deleted)
    before = F.concat(far, F.slice(deleted, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(deleted, F.lit(2), F.greatest(n - 1, F.lit(0))), far)
    starts = F.filter(F.zip_with(deleted, before, lambda i, b: F.when(i != b + 1, i)), lambda i: i.isNotNull())
    ends = F.filter(F.zip_with(deleted, after, lambda i, b: F.when(i != b - 1, i)), lambda i: i.isNotNull())
    return F.when(n > 0, F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat_ws("-", a, b)), ",")).otherwise("")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, deleted: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(text, deleted):
        if t is not None and gone is not None and len(gone):
            gone = set(gone.tolist())
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append(t)
    return pd.Series(out)


def clean(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the deleted lines taken out of text; all rows and other columns stay."""
    # Copies of a row differ in what they lose: rows of one id and text are numbered on both sides.
    names = {c: fresh(docs, c) for c in ("_id", "_hash", "_deleted", "_n", "_key", "_m")}
    i, h, d, n, key, m = names.values()
    every = deletions(docs, least).select(F.col("doc_id").alias(i), F.col("row_hash").alias(h), F.col("deleted").alias(d))
    every = every.withColumn(n, F.row_number().over(Window.partitionBy(i, h).orderBy(F.size(d))))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    keyed = keyed.withColumn(m, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(1))))
    both = keyed.join(every, keyed["doc_id"].eqNullSafe(every[i]) & (keyed[key] == every[h]) & (keyed[m] == every[n]), "left")
    return both.withColumn("text", _without("text", d)).select(*docs.columns)
