import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.errors import ConditionSyntaxError
from ruleweave.lang import condition as C
from ruleweave.plans import condition as plan

CASES = [
    ("$s1 or $s2 and $s3", {"$s1": 1}, True),
    ("$s1 or $s2 and $s3", {"$s2": 1}, False),
    ("$s1 or $s2 and $s3", {"$s2": 1, "$s3": 1}, True),
    ("$s1 and ($s2 or $s3)", {"$s1": 1}, False),
    ("$s1 and ($s2 or $s3)", {"$s1": 1, "$s3": 1}, True),
    ("any of them", {}, False),
    ("all of them", {}, False),
    ("all of them", {"$s1": 1, "$s2": 0}, False),
    ("all of them", {"$s1": 1, "$s2": 1}, True),
    ("any of ($dan*)", {"$dan1": 1, "$dan2": 1}, True),
    ("all of ($dan*)", {"$dan1": 1, "$dan2": 0}, False),
    ("all of ($*)", {"$a": 1, "$b": 2}, True),
    ("any of ($s1, $s2)", {"$s2": 1}, True),
    ("any of ($s1, $s2)", {"$s3": 1}, False),
    ("not $s1", {}, True),
    ("not (not $s1)", {}, False),
    ("#s1 == 3", {"$s1": 3}, True),
    ("#s1 >= 2", {"$s1": 3}, True),
    ("#s1 < 5", {"$s1": 3}, True),
    ("#s1 != 0", {"$s1": 3}, True),
    ("#s1 > 10", {"$s1": 3}, False),
    ("(#a + #b) >= 2", {"$a": 1, "$b": 1}, True),
    ("(#a + #b) >= 2", {"$a": 1, "$b": 0}, False),
    ("$s1 and #s2 >= 2", {"$s1": 1, "$s2": 2}, True),
    ("$s1 and #s2 >= 2", {"$s1": 0, "$s2": 2}, False),
    ("#s1 >= -1", {}, True),
    ("#s1 == 0", {}, True),
    ("--1 == 1", {}, True),
    ("9223372036854775807 + 1 < 0", {}, True),
    ("#a + 9223372036854775807 < 0", {"$a": 1}, True),
    ("-9223372036854775807 - 1 - #a > 0", {"$a": 1}, True),
]
ERRORS = [
    ("", "end"), ("$s1 $s2", "after the condition"), ("$s1 and $s2 not", "after the condition"), ("$s1 and $s2)", "after the condition"), ("not not $s1", "not"),
    ("$s1 and @foo", "unexpected character"), ("#", "unexpected character"), ("# s1", "unexpected character"), ("#a < #b < #c", "after"), ("#a +", "end"), ("= 1", "unexpected"),
    ("$s1 + 2", "type error"), ("#s1 and $s2", "type error"), ("#s1", "type error"), ("9223372036854775808 == 1", "range"), ("any of ($a*, $b)", "expected"), ("any of (#a)", "set holds"),
]


@pytest.mark.parametrize("text, hits, expect", CASES)
def test_evaluate(text, hits, expect):
    assert C.evaluate(C.parse(text), hits) is expect


@pytest.mark.parametrize("text, message", ERRORS)
def test_errors(text, message):
    with pytest.raises(ConditionSyntaxError, match=message):
        C.parse(text)


@pytest.mark.parametrize(
    "text, hits, expect",
    [
        ("$s1 and $llm1", {"$s1": 1}, True),
        ("$s1 and $s2 and $llm1", {"$s1": 1}, False),
        ("$s1 or $llm1", {"$s1": 1}, True),
        ("not $llm1", {}, False),
        ("#llm1 >= 2 or $s1", {}, True),
        ("$llm1 and #s1 >= 2", {"$s1": 0}, False),
        ("$llm1 or #s1 >= 2", {"$s1": 3}, True),
        ("$llm1 and $llm2", {}, False),
    ],
)
def test_is_needed(text, hits, expect):
    assert C.is_needed("$llm1", C.parse(text), {"$llm1": 0, **hits}) is expect


def test_references_keep_sigils():
    assert C.references("$a and #b > 1 or any of ($c*)") == ["$a", "#b"]


IDS = ["$a", "$ab", "$b"]
integers = st.deferred(lambda: st.one_of(st.integers(0, 4).map(C.Number), st.just(C.Number((1 << 63) - 1)), st.sampled_from(IDS).map(C.Count), integers.map(C.Negative), st.tuples(integers, st.sampled_from("+-"), integers).map(lambda t: C.Sum(*t))))
booleans = st.deferred(
    lambda: st.one_of(
        st.sampled_from(IDS).map(C.Has),
        st.builds(C.Members, st.booleans(), st.one_of(st.none(), st.lists(st.sampled_from(IDS), min_size=1, max_size=2).map(tuple)), st.sampled_from(["$", "$a", "$z"])),
        booleans.map(C.Not),
        st.tuples(booleans, booleans).map(lambda t: C.Both(*t)),
        st.tuples(booleans, booleans).map(lambda t: C.Either(*t)),
        st.tuples(integers, st.sampled_from(C.COMPARISONS), integers).map(lambda t: C.Compare(*t)),
    )
)


@settings(max_examples=25, deadline=None)
@given(st.lists(booleans, min_size=8, max_size=8))
def test_lowering_agrees_with_evaluator(spark, nodes):
    """Random conditions, as columns and in Python, over all small hit counts."""
    rows = [(a, b, c) for a in (0, 1, 3) for b in (0, 2) for c in (0, 1)]
    df = spark.createDataFrame(rows, "a long, ab long, b long").coalesce(1)
    count = {"$" + c: F.col(c) for c in ("a", "ab", "b")}
    has = {i: c > 0 for i, c in count.items()}
    out = df.select("a", "ab", "b", *(plan.lower(n, has, count, IDS).alias(f"r{k}") for k, n in enumerate(nodes))).collect()
    for r in out:
        for k, n in enumerate(nodes):
            assert r[f"r{k}"] == C.evaluate(n, {"$a": r.a, "$ab": r.ab, "$b": r.b}), n


def test_undecided_is_sound(spark):
    """Where a condition counts as decided, no answer of a pending pattern changes it."""
    df = spark.createDataFrame([(0,), (1,), (3,)], "a long")
    has, count = {"$a": F.col("a") > 0}, {"$a": F.col("a")}
    for text in ("$a and $x", "$a or $x", "$x and $y", "not $x", "#x > 1 or $a", "any of ($x, $a)", "all of ($x, $a)", "#a > 2 and $x"):
        node = C.parse(text)
        for r in df.select("a", plan.undecided(node, has, count, ["$a", "$x", "$y"], {"$x", "$y"}).alias("u")).collect():
            values = {C.evaluate(node, {"$a": r.a, "$x": x, "$y": y}) for x in (0, 1, 5) for y in (0, 1)}
            assert r.u == (len(values) > 1), text


def test_long_chains_and_deep_nesting():
    names = [f"$p{i}" for i in range(1200)]
    node = C.parse(" or ".join(names) + " or " + " and ".join(names))
    assert C.evaluate(node, dict.fromkeys(names, 0) | {"$p777": 1}) and not C.evaluate(node, dict.fromkeys(names, 0))
    with pytest.raises(ConditionSyntaxError):
        C.parse("(" * 5000 + "$a" + ")" * 5000)
