"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edits.

Texts are sequences of words. The CGK walk reads a sequence with a pointer that a random bit of
(step, word) moves or holds; close sequences give outputs that differ in few steps. A repetition
samples some steps of one walk; a window and an item that agree in all of them are candidates. Each
repetition is rejected step by step: a window goes on only while what it has shown so far is a prefix
of some item's samples. Before, places are left out around which every stretch of item size holds more
words that no item of that size has than edits are allowed, which loses nothing. Candidates are
confirmed by the exact least edit distance of the item to any part of the text around.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.partitions import spread
from ..shipping import Shared
from .common import in_tasks, keep_rows, slices
from .near_dedup import mix

#: Items, and words of items, that are handled in one pass over the documents; more take more passes. An
#: index of so many is some 10 MB for each of the two.
BLOCK_ITEMS, BLOCK_WORDS = 5_000, 1_000_000
#: 1 - edits / words of the item that counts as a leak.
SIMILARITY = 0.8
#: Walks of each item, sampled steps of each, and most steps of one (a step is half a word). Walks start
#: at three places of an item, of longer ones every PLACE_WORDS words: edits are a fifth of the words at
#: most, so some stretch of any length has no larger share, and there the walks are as likely to agree as
#: in a short item. Recall with a fifth of the words edited is over 0.99, for all kinds of edits (tests).
REPEATS, SAMPLES, MOST_STEPS, PLACE_WORDS = 72, 3, 63, 50
SEED = 5
#: Words of candidate regions that are looked at together, about.
CONFIRM_WORDS = 2_000_000

_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII signs and white space separate."""
    return (text or "").lower().encode().translate(_SPACES).split()


@dataclass
class _Group:
    """Items of nearly one length, with their samples for each repetition."""

    most: int  # words of the longest item
    window: int  # the least words of a match
    edits: int  # the most edits of a match
    known: np.ndarray  # for each word number whether an item of the group has it
    starts: list[tuple[int, int]]  # least and most place of each start
    steps: np.ndarray  # [repetition, sample]: sampled steps, rising
    prefixes: list[list[list[np.ndarray]]]  # [start][repetition][sample]: sorted keys so far
    owners: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # [start][repetition]: last keys, sorted, and their items and places


class Index:
    """The benchmark's items as number sequences, and their LSH tables."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float, repeats: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.allowed = [int((1 - similarity) * len(x) + 1e-9) for x in self.items]
        size = len(self.vocabulary) + 1
        # Random bits of (repetition, word), one for each step.
        base = np.arange(size, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        self.bits = [mix(base + mix(np.uint64([SEED + r]))) for r in range(repeats)]
        self.members = np.unique(np.concatenate([i * np.int64(size) + x for i, x in enumerate(self.items)])) if self.items else np.zeros(0, np.int64)
        self.size, self.repeats = size, repeats
        by_length = defaultdict(list)
        for i, x in enumerate(self.items):
            if len(x):
                by_length[int(np.log(len(x)) / np.log(1.2))].append(i)
        self.groups = [self._group(members) for _, members in sorted(by_length.items())]

    def _group(self, members: list[int]) -> _Group:
        sizes = [len(self.items[i]) for i in members]
        least, most = min(sizes), max(sizes)
        samples = min(SAMPLES, least)
        reach = min(MOST_STEPS, max(samples, int(least * 0.6)))
        places = max(3, -(-least // PLACE_WORDS))
        shares = (0.0, 0.3, 0.6) if places == 3 else np.linspace(0, 1 - MOST_STEPS / 2 / least, places)
        repeats = max(1, -(-self.repeats // places))
        rng = np.random.default_rng([SEED, least, most])
        edges = np.linspace(0, reach, samples + 1).astype(int)
        steps = np.stack([rng.integers(a, max(b, a + 1), repeats) for a, b in zip(edges, edges[1:])], axis=1)
        pad = np.zeros(2 * most + 2, np.int64)
        flat = np.concatenate([part for i in members for part in (self.items[i], pad)])
        offset = dict(zip(members, np.cumsum([0, *(len(self.items[i]) + len(pad) for i in members)])))
        known = np.zeros(self.size, bool)
        known[np.concatenate([self.items[i] for i in members])] = True
        spans, prefixes, owners = [], [], []
        item = np.array(members)
        for share in shares:
            place = np.array([int(share * len(self.items[i])) for i in members])
            at = np.array([offset[i] for i in members]) + place
            spans.append((int(place.min()), int(place.max())))
            prefixes.append([])
            owners.append([])
            for r in range(repeats):
                keys = self.walk(flat, at, r, steps[r])
                prefixes[-1].append([np.unique(k) for k in keys])
                order = np.argsort(keys[-1], kind="stable")
                owners[-1].append((keys[-1][order], item[order], place[order]))
        window = min(len(self.items[i]) - self.allowed[i] for i in members)
        return _Group(most, window, max(self.allowed[i] for i in members), known, spans, steps, prefixes, owners)

    def walk(self, x: np.ndarray, at: np.ndarray, r: int, steps: np.ndarray, prefixes: list[np.ndarray] | None = None):
        """Keys after each sample for walks from `at`; with prefixes, (places left, last keys)."""
        pointer, key, keys, sample = at.copy(), np.zeros(len(at), np.uint64), [], 0
        bits = self.bits[r]
        for j in range(int(steps[-1]) + 1):
            word = x[pointer]
            if j == steps[sample]:
                key = mix(key + word.astype(np.uint64) + np.uint64(1))
                keys.append(key)
                if prefixes is not None:
                    known = prefixes[sample]
                    hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    at, pointer, key, word = at[hit], pointer[hit], key[hit], word[hit]
                    if not len(at):
                        return at, key
                sample += 1
            pointer = pointer + ((bits[word] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        return (at, key) if prefixes is not None else keys

    def search(self, docs: list[list[bytes]]) -> list[tuple[int, int, int, int, int, float]]:
        """(document, item, first word, end word, edits, similarity) of the best match of each leaked item."""
        if not self.groups:
            return []
        gap = np.zeros(2 * max(g.most for g in self.groups) + 2, np.int64)
        get = self.vocabulary.get
        parts, begins, total = [], [], 0
        for ws in docs:
            begins.append(total)
            parts += [np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)), gap]
            total += len(ws) + len(gap)
        x = np.concatenate(parts)
        begin = np.array(begins)
        end = begin + [len(ws) for ws in docs]
        items, starts = [], []
        for g in self.groups:
            foreign = np.cumsum(~g.known[x], dtype=np.int32)
            good = np.flatnonzero(foreign[g.window - 1 :] - foreign[: len(foreign) - g.window + 1] <= g.edits - 1 + g.known[x[: len(foreign) - g.window + 1]])
            if not len(good):
                continue
            for start, (low, high) in enumerate(g.starts):
                near = np.zeros(total + 1, np.int32)  # places from `low` to `high` after a good one, give or take edits
                np.add.at(near, np.clip(good + low - g.edits, 0, total), 1)
                np.add.at(near, np.clip(good + high + 1, 0, total), -1)
                at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                for r, (keys, item, place) in enumerate(g.owners[start]):
                    left, key = self.walk(x, at, r, g.steps[r], g.prefixes[start][r])
                    if len(left):
                        first = np.searchsorted(keys, key, "left")
                        n = np.searchsorted(keys, key, "right") - first
                        hit = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                        items.append(item[hit])
                        starts.append(np.repeat(left, n) - place[hit])
        if not items:
            return []
        pairs = np.unique(np.column_stack([np.concatenate(items), np.concatenate(starts)]), axis=0)
        return self._confirm(x, begin, end, pairs[:, 0], pairs[:, 1])

    def _confirm(self, x, begin, end, item, start):
        size = np.array([len(i) for i in self.items])[item]
        slack = np.array(self.allowed)[item]
        doc = np.searchsorted(begin, np.maximum(start + size // 2, 0), "right") - 1
        low, high = np.maximum(start - slack, begin[doc]), np.minimum(start + size + slack, end[doc])
        # Candidates that overlap are one region.
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > slack[1:])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(new)]]) - 1
        item, doc, size, slack, low, high = item[first], doc[first], size[first], slack[first], low[first], high[last]
        # Words of the region that the item has at all: fewer than it needs rules a candidate out.
        shared = np.zeros(len(first), np.int64)
        width = np.maximum(high - low, 0)
        part = np.cumsum(width) // CONFIRM_WORDS
        for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part)) + 1):
            own = np.repeat(some, width[some])
            at = np.arange(len(own)) - np.repeat(np.cumsum(width[some]) - width[some], width[some]) + low[own]
            code = item[own] * np.int64(self.size) + x[at]
            known = self.members[np.minimum(np.searchsorted(self.members, code), len(self.members) - 1)] == code
            shared[some] = np.bincount(own[known] - some[0], minlength=len(some))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in np.flatnonzero(shared >= size - slack):
            near = best_match(self.items[item[i]], x[low[i] : high[i]])
            if near[0] <= slack[i]:
                key = (int(doc[i]), int(item[i]))
                base = int(low[i] - begin[doc[i]])
                value = (near[0], base + near[1], base + near[2])
                best[key] = min(best.get(key, value), value)
        return [(d, self.ids[i], a, b, e, 1 - e / len(self.items[i])) for (d, i), (e, a, b) in sorted(best.items())]


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end): the part of region with the least edit distance to item; of these, the one with
    the least end, and from the least first word."""
    edit = np.int64(1 << 32)  # a cell holds edits * `edit` + the place where its part begins
    row = np.arange(len(region) + 1, dtype=np.int64)
    along = row * edit
    for w in item:
        new = row + edit
        new[1:] = np.minimum(new[1:], row[:-1] + np.where((region != w) | (region == 0), edit, np.int64(0)))
        row = np.minimum.accumulate(new - along) + along
    end = int(np.argmin(row >> 32))
    return int(row[end] >> 32), int(row[end] & (edit - 1)), end


def _search(shared):
    def run(batches):
        index = shared.value
        for batch in slices(batches, "text"):
            hits = index.search([words_of(t) for t in batch["text"].to_pylist()])
            if hits:
                doc, item, first, last, edits, similar = zip(*hits)
                rows = batch.select(["doc_id", "row_hash"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["row_hash"], pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(edits, pa.int64()), pa.array(similar, pa.float64())],
                    ["doc_id", "row_hash", "item_id", "first_word", "end_word", "edits", "similarity"],
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repeats: int = REPEATS) -> DataFrame:
    """Items found in documents: doc_id, row_hash, item_id, first_word, end_word, edits, similarity.

    An item is found where some run of a text's words has an edit distance of at most (1 - similarity)
    times the item's words; the best run is given, once per row and item. Items without words, and null,
    empty and white texts, match nothing; repeated rows and items match each for itself. Either table
    empty gives no rows. Only doc_id, text and item_id, text are read. Items are searched in blocks of
    BLOCK_ITEMS or BLOCK_WORDS, each a pass over the documents, so that one pass's index has a bound; an
    item of more words is a block of its own.
    """
    spark = docs.sparkSession
    schema = "doc_id long, row_hash long, item_id long, first_word long, end_word long, edits long, similarity double"
    source = spread(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    out, block, words = None, [], 0

    def search(block):
        found = in_tasks(source, _search(Shared(spark.sparkContext, Index(block, similarity, repeats))), schema)
        return found if out is None else out.unionByName(found)

    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        ws = words_of(row["text"])
        if block and (len(block) == BLOCK_ITEMS or words + len(ws) > BLOCK_WORDS):
            out, block, words = search(block), [], 0
        if ws:
            block.append((row["item_id"], ws))
            words += len(ws)
    return search(block) if block or out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which an item is found; all columns."""
    found = leaks(docs, benchmark)
    return keep_rows(docs, found.select("doc_id", "row_hash", F.lit(False).alias("kept")), "kept")
