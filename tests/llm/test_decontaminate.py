import random

import numpy as np
import pytest

from ruleweave.llm import decontaminate as D

from .conftest import EDGES, make


def distance(item, region):
    """Least edits of item to any part of region, by the textbook."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def noisy(rng, words, edits, pool):
    out = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(out)), rng.randrange(3)
        if how == 0:
            out[at] = rng.choice(pool)
        elif how == 1:
            out.insert(at, rng.choice(pool))
        elif len(out) > 1:
            del out[at]
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    pool = common * 20 + [f"r{i}" for i in range(3000)]
    items = [(i, rng.choices(pool, k=rng.choice([6, 12, 20, 35, 60]))) for i in range(60)]
    docs = []
    for i in range(400):
        ws = rng.choices(pool, k=rng.randint(0, 200))
        if i % 2:
            item = items[rng.randrange(60)][1]
            part = noisy(rng, item, rng.randint(0, int(0.25 * len(item))), pool)
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, " ".join(ws)))
    return items, docs


def test_recall_and_precision_against_brute_force(spark, case):
    items, docs = case
    want = {}
    for d, text in docs:
        ws = D.words_of(text)
        for i, item in items:
            e = distance([w.encode() for w in item], ws)
            if e <= int(0.2 * len(item) + 1e-9):
                want[d, i] = e
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(make(spark, docs), bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 100
    assert all(r.edits == want[k] for k, r in got.items())
    texts = dict(docs)
    for (d, i), r in got.items():
        region = D.words_of(texts[d])[r.first_word : r.end_word]
        assert distance([w.encode() for w in items[i][1]], region) == r.edits
    left = {r.doc_id for r in D.drop_leaks(make(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_items_and_case(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame([(1, "Alpha, beta; gamma delta"), (2, "one two three"), (3, None), (4, "..."), (5, "epsilon zeta eta theta iota"), (5, "epsilon zeta eta theta iota")], "item_id long, text string")
    docs = make(spark, [(1, "x ALPHA-beta gamma   delta y"), (2, "zero one two three"), (3, "epsilon zeta eta zap iota"), (4, "alpha beta"), (None, "one two three"), (6, None), (7, "")])
    got = sorted(((r.doc_id or -1, r.item_id, r.edits) for r in D.leaks(docs, bench).collect()))
    assert got == [(-1, 2, 0), (1, 1, 0), (2, 2, 0), (3, 5, 1), (3, 5, 1)]


def test_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.leaks(edges, bench).collect()) == [1, 1, 7]
    assert D.drop_leaks(edges, bench).count() == len(EDGES) - 3
    assert D.leaks(edges, bench.limit(0)).count() == 0 and D.leaks(empty, bench).count() == 0
    assert D.drop_leaks(edges, bench.limit(0)).count() == len(EDGES)


def test_walk_reads_close_sequences_alike():
    """The share of equal steps falls with edits, and is high for few."""
    rng = random.Random(5)
    items = [(i, [f"w{rng.randrange(500)}".encode() for _ in range(40)]) for i in range(40)]
    index = D.Index(items, 0.8, 4)
    agree = {0: [], 1: [], 20: []}
    for _, ws in items:
        for edits in agree:
            a, b = (np.array([index.vocabulary.get(w, 0) for w in x] + [0] * 90) for x in (ws, noisy(rng, ws, edits, [w for _, v in items for w in v])))
            steps = np.arange(60)
            ka, kb = (index.walk(x, np.array([0]), 0, steps) for x in (a, b))
            agree[edits].append(np.mean([p[0] == q[0] for p, q in zip(ka, kb)]))
    assert np.mean(agree[0]) == 1 and np.mean(agree[1]) > np.mean(agree[20]) + 0.2


@pytest.mark.parametrize("size", [80, 200, 500, 1500])
@pytest.mark.parametrize("kind", ["delete", "insert", "replace", "mixed"])
def test_recall_of_long_items(size, kind):
    """A fifth of the words edited, all in one way or another."""
    rng = random.Random(size)
    pool = [f"w{i}".encode() for i in range(5000)]
    items = [(i, rng.choices(pool, k=size + rng.randrange(9))) for i in range(12)]
    index = D.Index(items, 0.8, D.REPEATS)
    docs = []
    for i, ws in items:
        out = list(ws)
        for n in range(int(0.2 * len(ws) + 1e-9)):
            how = kind if kind != "mixed" else ("delete", "insert", "replace")[n % 3]
            at = rng.randrange(len(out))
            out[at : at + (how != "insert")] = [] if how == "delete" else [rng.choice(pool)]
        docs.append(rng.choices(pool, k=50) + out + rng.choices(pool, k=50))
    found = {(d, i) for d, i, *_ in index.search(docs)}
    assert found == {(i, i) for i, _ in items}


def test_items_of_one_id_and_other_lengths():
    rng = random.Random(3)
    short, long = ([f"{c}{i}".encode() for i in range(n)] for c, n in (("a", 10), ("b", 40)))
    index = D.Index([(1, short), (1, long)], 0.8, D.REPEATS)
    docs = [short[:4] + [b"zzz"] + short[5:], long[:20] + [b"zzz"] + long[21:]]
    assert [(d, e, round(s, 3)) for d, _, _, _, e, s in index.search(docs)] == [(0, 1, 0.9), (1, 1, 0.975)]


def test_large_items_and_texts_take_little():
    rng = random.Random(8)
    pool = [f"w{i}".encode() for i in range(20000)]
    items = [(0, rng.choices(pool, k=5000)), *((i, rng.choices(pool, k=30)) for i in range(1, 300))]
    index = D.Index(items, 0.8, D.REPEATS)
    assert sum(b.nbytes for b in index.bits) < 20e6
    text = rng.choices(pool, k=600_000)
    text[300_000:305_000] = [w for w in items[0][1] if rng.random() > 0.1]
    text[100:130] = items[7][1]
    assert {i for _, i, *_ in index.search([text])} == {0, 7}
    assert D.best_match(np.arange(1, 5001), np.arange(500, 7000))[:1] == (499,)
