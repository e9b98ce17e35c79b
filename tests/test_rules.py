import pytest

from ruleweave import compile, compile_str
from ruleweave.errors import ConditionSyntaxError, DuplicateIdentifier, FileReadError, InvalidPattern, RuleFileNotFound, RuleSyntaxError, UndefinedIdentifier
from ruleweave.lang.rules import parse, unescape


def only(source, **kw):
    (rule,) = parse(source, **kw)
    return rule


def test_header_meta_and_sections():
    r = only('rule a : x y { meta: author = "me" n = "1" author = "you"\n strings: $a = "q" nocase wide,\n condition: $a }')
    assert (r.name, r.tags, r.meta, r.condition) == ("a", ["x", "y"], {"author": "you", "n": "1"}, "$a")
    assert r.strings[0].modifiers == {"nocase", "wide"}


def test_parameters_and_defaults():
    r = only('rule a { similarity: $s = "p q" threshold=0.9 cleaner=no_op chunker="word_chunking" matcher=m\n $t = "d"\n phash: $h = "x.png" threshold=0.5 hasher=videohash\n classifier: $c = "p" threshold=bad\n llm: $l = "q" llm=ollama\n condition: any of them }')
    s, t = r.similarity
    assert (s.threshold, s.cleaner, s.chunker, s.matcher) == (0.9, "no_op", "word_chunking", "m")
    assert (t.threshold, t.cleaner, t.chunker, t.matcher) == (0.8, "default_cleaning", "no_chunking", "sbert")
    assert (r.phash[0].file_path, r.phash[0].threshold, r.phash[0].hasher) == ("x.png", 0.5, "videohash")
    assert (r.classifier[0].threshold, r.classifier[0].classifier) == (0.7, "tuned-sbert")
    assert (r.chat[0].llm, r.chat[0].cleaner) == ("ollama", "no_op")


def test_blocks():
    r = only('rule a {\n classifier:\n $c = {\n pattern: "do it"\n threshold: 0.65\n chunker: paragraph_chunking\n classifier: own\n }\n condition:\n $c\n}')
    c = r.classifier[0]
    assert (c.pattern, c.threshold, c.chunker, c.classifier, r.condition) == ("do it", 0.65, "paragraph_chunking", "own", "$c")


def test_regex_literals():
    r = only("rule a { strings: $a = /x{2,3}\\/y/i dotall\n $b = /a\\d/ fullword\n condition: $a and $b }")
    assert [(s.pattern, s.is_regex, s.modifiers) for s in r.strings] == [("x{2,3}/y", True, {"nocase", "dotall"}), (r"a\d", True, {"fullword"})]


def test_comments_and_literals_do_not_mix():
    r = only('// rule no { }\nrule a { /* $z = "q" */ strings: $a = "http://x/*y*/ condition: }" // end\n $b = /a\\/\\/b/\n condition: $a /* or */ or $b }')
    assert [s.pattern for s in r.strings] == ["http://x/*y*/ condition: }", "a//b"]
    assert r.condition.split() == ["$a", "or", "$b"]


def test_escapes():
    assert unescape(r"\" \\ \n \t \r \q") == '" \\ \n \t \r \\q'


def test_several_rules_text_outside_and_open_end():
    assert [r.name for r in parse('junk rule a { condition: 1 == 1 } junk rule b { condition: 1 == 2')] == ["a", "b"]
    assert parse("") == [] and compile_str("").rule_count == 0
    many = parse("".join(f'rule r{i} {{ strings: $a = "{i}" condition: $a }}\n' for i in range(200)))
    assert len(many) == 200 and many[7].strings[0].pattern == "7"


def test_missing_condition():
    with pytest.raises(RuleSyntaxError, match="no condition"):
        parse('rule a { strings: $a = "x" }')
    assert only('rule a { meta: k = "v" }').condition == ""


def test_strictness():
    lax = 'rule a { strings: $a = "x" nocas\n nonsense\n condition: $a }'
    assert only(lax).strings[0].modifiers == set()
    with pytest.raises(RuleSyntaxError):
        parse(lax, strict=True)


def test_checks():
    with pytest.raises(DuplicateIdentifier):
        compile_str('rule a { strings: $a = "x"\n similarity: $a = "y"\n condition: $a }')
    with pytest.raises(UndefinedIdentifier, match=r"\$b"):
        compile_str('rule a { strings: $a = "x"\n condition: $a and $b }')
    with pytest.raises(UndefinedIdentifier, match="#b"):
        compile_str('rule a { strings: $a = "x"\n condition: #b > 1 }')
    with pytest.raises(ConditionSyntaxError, match="rule 'a'"):
        compile_str('rule a { strings: $a = "x"\n condition: $a and }')
    assert compile_str('rule a { strings: $a = "x"\n condition: any of ($q*) or $a }').rule_names == ["a"]


def test_invalid_patterns():
    source = "rule a { strings: $a = /(?=x)/\n condition: $a }"
    assert compile_str(source).invalid
    with pytest.raises(InvalidPattern):
        compile_str(source, on_invalid="error")


def test_files(tmp_path, spark):
    path = tmp_path / "r.rules"
    path.write_text("rule a { condition: 1 == 1 }")
    assert compile(str(path)).rule_names == compile(str(path), spark).rule_names == ["a"]
    for session in (None, spark):
        with pytest.raises(RuleFileNotFound):
            compile(str(tmp_path / "none"), session)
    with pytest.raises(FileReadError):
        compile(str(tmp_path))


def test_odd_headers_meta_and_parameters():
    rules = parse('overrule x { } rule rule: a  b_1 { meta: a = "1" b="" c = 3 d= "x=y" strings: $s = "rule z {" condition: $s } rule no-name { } rule t : { } rule\nlast\n{ }')
    assert [(r.name, r.tags) for r in rules] == [("rule", ["a", "b_1"]), ("last", [])]
    assert rules[0].meta == {"a": "1", "b": "", "d": "x=y"} and rules[0].strings[0].pattern == "rule z {"
    (p,) = parse('rule r { similarity: $s = "p" threshold=0.5 matcher="my m" cleaner = "no" chunker=word_chunking\n condition: $s }')[0].similarity
    assert (p.threshold, p.matcher, p.chunker) == (0.5, "my m", "word_chunking") and p.cleaner != "no"
