import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.errors import InvalidPattern
from ruleweave.lang.model import StringPattern
from ruleweave.plans import strings
from ruleweave.plans.regex import translate


def p(pattern, *mods, regex=False):
    return StringPattern("$p", pattern, frozenset(mods), regex)


CASES = [
    (p("hello"), "say hello world", [(4, 9)]),
    (p("ab"), "ab cd ab ef ab", [(0, 2), (6, 8), (12, 14)]),
    (p("a.b"), "axb", []),
    (p("a.b"), "a.b", [(0, 3)]),
    (p("cat", "fullword"), "the cat sat", [(4, 7)]),
    (p("cat", "fullword"), "concatenate", []),
    (p("cat", "fullword"), "xécat écat", []),
    (p("cat"), "concatenate", [(3, 6)]),
    (p("err(or)?", "fullword", regex=True), "an error occurred", [(3, 8)]),
    (p("err(or)?", "fullword", regex=True), "erroneous", []),
    (p("hello", "nocase"), "say HELLO there", [(4, 9)]),
    (p("strasse", "nocase"), "ſtraſſe", [(0, 10)]),
    (p(r"\d{3}-\d{4}", regex=True), "call 555-1234 now", [(5, 13)]),
    (p(r"\d+", regex=True), "٣٤ 5", [(0, 4), (5, 6)]),
    (p("start.*end", "dotall", regex=True), "start\nmiddle\nend", [(0, 16)]),
    (p("start.*end", regex=True), "start\nend", []),
    (p("AB", "wide"), "A\0B\0", [(0, 4)]),
    (p("AB", "wide"), "prefix AB suffix", []),
    (p("he.lo", "wide", regex=True), "h\0e\0l\0l\0o\0", [(0, 10)]),
    (p("he.lo", "wide", regex=True), "hello", [(0, 5)]),
    (p("he.lo", "wide", "ascii", regex=True), "hello", [(0, 5), (0, 5)]),
    (p("AB", "wide", "ascii"), "AB and A\0B\0", [(0, 2), (7, 11)]),
    (p("AB", "wide", "fullword"), "A\0B\0x A\0B\0 ", [(0, 4)]),
    (p("(?m)^foo", regex=True), "bar\nfoo", [(4, 7)]),
    (p("(?m)^foo", regex=True), "barfoo", []),
    (p("(?m)^", regex=True), "a\n", [(0, 0), (2, 2)]),
    (p("a*", regex=True), "aaa", [(0, 3)]),
    (p("a*", regex=True), "baac", [(0, 0), (1, 3), (4, 4)]),
    (p("x/y", regex=True), "x/y", [(0, 3)]),
    (p("a$", regex=True), "a\n", []),
    (p("a.", regex=True), "a\r", [(0, 2)]),
    (p("é"), "aé é", [(1, 3), (4, 6)]),
    (p("(?i)a(?-i)b|c", regex=True), "Ab AB c C", [(0, 2), (6, 7)]),
    (p("(?U)a+b", regex=True), "aab", [(0, 3)]),
    (p("(?U)a+", regex=True), "aa", [(0, 1), (1, 2)]),
    (p(r"\p{Greek}+", regex=True), "aαβ", [(1, 5)]),
    (p(r"[[:digit:]a-c&&[^b]]+", regex=True), "1abc", [(0, 2), (3, 4)]),
    (p(r"[a-z--b]+", regex=True), "abc", [(0, 1), (2, 3)]),
    (p(r"\x{e9}A", regex=True), "éA", [(0, 3)]),
    (p("(?P<n>a)(?<m>b)", regex=True), "ab", [(0, 2)]),
    (p(""), "ab", [(0, 0), (1, 1), (2, 2)]),
    (p(r"a|ab", regex=True), "ab", [(0, 1)]),
    (p("\U0001f600!"), "x\U0001f600!", [(1, 6)]),
]


@pytest.fixture(scope="module")
def results(spark):
    """All cases as columns of one query."""
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string").coalesce(1)
    out = {}
    for i, (pattern, _, _) in enumerate(CASES):
        t = F.col("t")
        out[i] = df.where(f"i = {i}").select(strings.exists(pattern, t).alias("e"), strings.count(pattern, t).alias("n"), strings.details(pattern, t).alias("d"))
    rows = out[0]
    for i in range(1, len(CASES)):
        rows = rows.unionAll(out[i])
    return rows.collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_matching(results, i):
    pattern, text, spans = CASES[i]
    assert [(d.start_pos, d.end_pos) for d in strings.find(pattern, text)] == spans
    row = results[i]
    assert (row.e, row.n, [(d.start_pos, d.end_pos) for d in row.d]) == (bool(spans), len(spans), spans)
    raw = text.encode()
    if not (pattern.is_regex and "wide" in pattern.modifiers):
        assert [d.matched_text.encode() for d in row.d] == [raw[a:b] for a, b in spans]


@pytest.mark.parametrize("bad", ["(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", r"\Qa", "a{3,2}", "[a", "(a", "a)", "*a", r"\h", "(?q)", "[[:no:]]", "\\", r"\x{110000}", "a|*"])
def test_outside_the_dialect(bad):
    with pytest.raises(InvalidPattern):
        translate(bad)


@settings(max_examples=60, deadline=None)
@given(st.text("ab é\0\n.", max_size=12), st.text("ab .é", min_size=1, max_size=3))
def test_literals_are_found_as_python_finds_them(text, literal):
    hits = strings.find(p(literal), text)
    assert len(hits) == text.count(literal)
    assert all(text.encode()[h.start_pos : h.end_pos].decode() == literal for h in hits)


@pytest.mark.parametrize("pattern, want", [("key7[a-z]+", "key7"), ("(?:abc)def", "abcdef"), (r"\bword\b", "word"), ("(?i)abcd", None), ("(?i:abc)defg", "defg"), ("abcd|efgh", None), ("(abcd|x)yz", None), ("abcd?", "abc"), ("(abcd)*", None), ("(abcd){2}", None), ("a.cdef", "cdef"), ("ab", None), ("(?s)a.*xyz$", "xyz"), ("[a]bcd", "abcd")])
def test_required_literals(pattern, want):
    assert translate(pattern).required == want
    assert translate(pattern, nocase=True).required is None
