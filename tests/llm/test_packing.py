import json
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ruleweave.llm import packing as P
from ruleweave.llm.queries import vocabulary

from .conftest import EDGES, make

TOKENIZER = Tokenizer.from_file(vocabulary())
ENCODE = P.load_encoder(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab 's\n\t<|endoftext|>é漢\u00a0\u2003 1²", max_size=40), st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "don't  we'LL\n\n x"])))
def test_same_ids_as_the_tokenizer(text):
    assert ENCODE(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "!", "\u2003", "\x1c", " \n"])
def test_very_long_runs(unit):
    for text in (unit * (2_000_000 if unit in " a" else 300_000), "start" + unit * 50_000 + " end"):
        assert ENCODE(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_files_that_ranks_cannot_stand_for(tmp_path):
    spec = json.load(open(vocabulary()))
    assert P._ranks(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        assert P._ranks(spec | change) is None
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))
    assert P.load_encoder(str(path))("Some WORDS").tolist() == TOKENIZER.encode("some words").ids


def test_pieces_and_sequences(spark, edges, empty):
    rng = random.Random(2)
    rows = EDGES + [(100 + i, " ".join(rng.choices(["the", "packing", "of", "sequences", "is", "x"], k=rng.randint(0, 3000)))) for i in range(60)]
    got = P.pack(make(spark, rows), vocabulary(), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    want = Counter((d, tuple(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    whole = Counter()
    for d, ids in want:
        first = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            whole[d, n, a, ids[a:b]] += want[d, ids]
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == whole
    for rows_ in by_sequence.values():
        rows_.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows_] == [sum(x.length for x in rows_[:i]) for i in range(len(rows_))]
        assert sum(r.length for r in rows_) <= 2048
    lengths = Counter(r.length for r in got)
    assert len(by_sequence) <= P.lower_bound(lengths, 2048) + 1
    assert P.pack(empty, vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 6), max_size=12))
def test_plan_holds_every_piece(counts):
    plan = P.plan_sequences(counts, 50, 300)
    held = Counter()
    for times, filling in plan:
        assert times > 0 and sum(filling) <= 50
        for n in filling:
            held[n] += times
    assert held == Counter(counts)
    used = sum(t for t, _ in plan)
    assert P.lower_bound(counts, 50) <= used <= sum(t for t, _ in P.best_fit(counts, 50))


def fewest(items, capacity):
    """Exact bin packing of a few items by trying all places."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i]:
                go(i + 1, bins[:j] + [bins[j] - items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_fewest_sequences_on_small_cases(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(3, 30) for _ in range(9)), reverse=True)
    plan = P.plan_sequences(dict(Counter(items)), 40)
    assert sum(t for t, _ in plan) == fewest(items, 40)


def test_search_beats_best_fit():
    counts = {7: 2, 6: 2, 5: 2, 4: 2, 3: 4, 8: 1, 12: 1}
    assert sum(t for t, _ in P.plan_sequences(counts, 20)) == P.lower_bound(counts, 20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.integers(1, 20))
def test_undominated_fillings(pieces, room):
    """Swapping pieces for longer ones within the capacity never turns a filling into another that is kept out."""
    capacity = 12 + room
    counts = dict(Counter([12, *pieces]))
    got = P.completions(counts, 12, capacity, 1000)
    rest = Counter(pieces)
    every = {tuple(sorted(c, reverse=True)) for n in range(len(pieces) + 1) for c in combinations(pieces, n) if sum(c) <= room}

    def beats(a, b):
        """Whether each piece of a can take pieces of b that are no longer together, so that all of b have a place."""
        if not b:
            return True
        return any(x >= b[0] and beats(tuple(sorted((*a[:i], x - b[0], *a[i + 1 :]), reverse=True)), b[1:]) for i, x in enumerate(a))

    kept = {c[1:] for c in got}
    assert kept <= every and all(not Counter(c) - rest for c in kept)
    assert all(any(beats(k, c) for k in kept) for c in every)


@pytest.mark.parametrize("seed", range(3))
def test_search_where_most_pieces_are_over_a_quarter(seed):
    """Planted triples that fill sequences: the search is closer to the bound than best fit is."""
    rng = random.Random(seed)
    pieces = []
    for _ in range(300):
        a = rng.randint(520, 760)
        b = rng.randint(520, 760)
        pieces += [a, b, 2048 - a - b]
    counts = dict(Counter(pieces))
    began = time.time()
    used = sum(t for t, _ in P.plan_sequences(counts, node_limit=3000))
    print(seed, used, P.lower_bound(counts, 2048), sum(t for t, _ in P.best_fit(counts, 2048)), time.time() - began)
    assert P.lower_bound(counts, 2048) <= 300 <= used <= 306 < sum(t for t, _ in P.best_fit(counts, 2048))
