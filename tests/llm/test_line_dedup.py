import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import line_dedup as L

from .conftest import EDGES, make


def sequence(text):
    return [(n, x.strip()) for n, x in enumerate((text or "").split("\n")) if x.strip()]


def brute(rows, least=5):
    """Lines in a run of `least` words that an earlier row has as well, by trying all runs of all pairs of rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    out = {}
    for n, g in enumerate(order):
        b, drop = sequence(rows[g][1]), set()
        for e in order[:n]:
            a = sequence(rows[e][1])
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k][1] == b[j + k][1]:
                        k += 1
                    if sum(len(x.split()) for _, x in b[j : j + k]) >= least:
                        drop |= {m for m, _ in b[j : j + k]}
        out[g] = sorted(drop)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    lines = [" ".join(f"{n}w{k}" for k in range(rng.randint(1, 9))) for n in range(60)]
    return [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"only {i} {k} here and now" for k in range(rng.randint(1, 12)))) for i in range(80)]


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.deleted for r in L.deletions(make(spark, rows)).collect()}
    want = brute(rows)
    assert got == {rows[i][0]: d for i, d in want.items()} and any(want.values())


def test_clean_texts_and_spans(spark, edges, empty):
    rows = [(1, "a b c d e f\nown one"), (2, "own two\n a b c d e f \ng\nown three"), (3, "x")]
    left = {r.doc_id: r.text for r in L.clean(make(spark, rows)).collect()}
    assert left == {1: rows[0][1], 2: "own two\ng\nown three", 3: "x"}
    spans = {r.doc_id: r.s for r in L.deletions(make(spark, rows)).select("doc_id", L.spans("deleted").alias("s")).collect()}
    assert spans == {1: "", 2: "1-1", 3: ""}
    cleaned = L.clean(edges)
    assert cleaned.columns == edges.columns and cleaned.count() == len(EDGES)
    texts = [r.text for r in cleaned.collect()]
    assert texts.count("one two three four five six") == 1  # its copy lost the line
    assert L.deletions(empty).count() == 0 and L.clean(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = L.patience(list(enumerate(a)), list(enumerate(b)))
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)
    once = set(a) & set(b)
    if all(a.count(v) == b.count(v) == 1 for v in once):  # then patience finds a longest one
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert len(pairs) == longest[-1][-1]


def test_all_pairs_of_overlapping_documents(spark):
    """Short lines first held elsewhere and white lines cut no block; repeated lines and other orders go too."""
    rng = random.Random(4)
    block = "a b c\nok\nd e f\n\nyes sir\nend"
    rows = [(0, "ok\nyes sir"), (1, block), (2, f"own line\n{block}")]
    rows += [(3 + i, "\n".join(rng.choice(["", "ok", "yes sir", "end", *(f"l{k} w" for k in range(6)), f"own {i}"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 3)]
    lines = [f"line {k} of five words" for k in range(40)]
    rows += [(200, "\n".join(lines)), (201, "\n".join(lines[::-1])), (202, "\n".join([lines[3]] * 500 + lines[20:]))]
    rows += [(300, "x1\nx2\nx3"), (301, "b1 b2\nb3 b4\nb5 b6"), (302, "x1\nb1 b2\nb3 b4\n \nb5 b6")]
    rows += [(303, "one two three\n\nfour five six"), (304, "one two three\n\nfour five six")]
    got = {r.doc_id: r.deleted for r in L.deletions(make(spark, rows)).collect()}
    want = {rows[g][0]: d for g, d in brute(rows).items()}
    assert got == want and got[2] == [1, 2, 3, 5, 6] and got[302] == [1, 2, 4] and got[304] == [0, 2]
    assert {r.doc_id: r.text for r in L.clean(make(spark, rows)).collect()}[2] == "own line\n"


def test_one_holder_of_many_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP_LINES", 20)
    text = "\n".join(f"license line {k} says this" for k in range(7))
    rows = [(i, f"own {i}\n{text}\nmore {i}") for i in range(200)]
    got = {r.doc_id: r.deleted for r in L.deletions(make(spark, rows)).collect()}
    assert got == {i: list(range(1, 8)) if i else [] for i in range(200)}


def test_repeated_lines_take_linear_time():
    line = [7] * 30_000
    later = {"lines": list(range(30_000)), "hashes": line, "places": list(range(30_000)), "words": [5] * 30_000, "keys": [1] * 30_000, "begins": list(range(30_000)), "ends": list(range(30_000))}
    assert L.shared_lines({"hashes": [7], "windows": {1: range(1)}}, later, 5) == list(range(30_000))


def test_names_of_the_input_stay(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f\nx", 8, 9, 10)], "doc_id long, text string, _key long, _m long, _row_hash long")
    assert {tuple(r) for r in L.clean(rows).collect()} == {(1, "a b c d e f", 5, 6, 7), (2, "x", 8, 9, 10)}
