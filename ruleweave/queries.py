"""Catalogue of queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import RuleSet, compile_str
from .functions import chunkers, cleaners
from .functions.chat_text import answer_explanation, answer_matches
from .functions.hashing import video_hash
from .functions.vectors import cosine, hamming, hash_similarity, vector
from .lang.model import StringPattern
from .operators import reports, scoring
from .operators.models import FunctionChat, HashingEmbedder, TableClassifier, TableEmbedder
from .plans import strings
from .plans.partitions import spread
from .sources.rule_files import transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


FLAGSHIP = compile_str(r"""
rule credential : secret high {
    meta: owner = "security"
    strings: $token = /token = "[0-9a-f]{40}"/
    condition: $token
}
rule licensed : legal {
    strings:
        $mit = "Released under the MIT License"
        $apache = "Licensed under the Apache License"
    condition: any of them
}
rule contact : privacy {
    strings:
        $mail = /[A-Za-z0-9._]+@[A-Za-z0-9.]+/
        $phone = /\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}/
    condition: $mail or $phone
}
rule wordy : style {
    strings: $the = "the"
    condition: #the >= 20 and not (#the > 200)
}
""")


@query(r"""
WITH d AS (SELECT doc_id, regexp_matches(text, 'token = "[0-9a-f]{40}"') AS a,
  contains(text, 'Released under the MIT License') OR contains(text, 'Licensed under the Apache License') AS b,
  regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS c,
  (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents)
SELECT doc_id, 0 AS rule_idx, 'credential' AS rule_name, 'secret,high' AS tags, a AS matched FROM d
UNION ALL SELECT doc_id, 1, 'licensed', 'legal', b FROM d
UNION ALL SELECT doc_id, 2, 'contact', 'privacy', c FROM d
UNION ALL SELECT doc_id, 3, 'wordy', 'style', n >= 20 AND NOT (n > 200) FROM d
""")
def flagship_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FLAGSHIP.scan(docs(spark, sf_dir))
    return found.select("doc_id", "rule_idx", "rule_name", F.array_join("tags", ",").alias("tags"), "matched")


@query(r"""
SELECT doc_id, regexp_matches(text, 'token = "[0-9a-f]{40}"') AS credential,
  contains(text, 'Released under the MIT License') OR contains(text, 'Licensed under the Apache License') AS licensed,
  regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS contact,
  (length(text) - length(replace(text, 'the', ''))) // 3 BETWEEN 20 AND 200 AS wordy FROM documents
""")
def wide_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP.scan(docs(spark, sf_dir), output="wide").drop("text")


@query(r"""
SELECT doc_id, 'credential' AS rule_name FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')
UNION ALL SELECT doc_id, 'licensed' FROM documents WHERE contains(text, 'Released under the MIT License') OR contains(text, 'Licensed under the Apache License')
UNION ALL SELECT doc_id, 'contact' FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')
UNION ALL SELECT doc_id, 'wordy' FROM documents WHERE (length(text) - length(replace(text, 'the', ''))) // 3 BETWEEN 20 AND 200
""")
def matched_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP.scan(docs(spark, sf_dir), output="matched").select("doc_id", "rule_name")


# -- string patterns --------------------------------------------------------------------------


def counted(pattern: str, *modifiers: str, is_regex: bool = True, table: str = "documents", key: str = "doc_id", column: str = "text") -> Query:
    p = StringPattern("$p", pattern, frozenset(modifiers), is_regex)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(key, strings.count(p, F.col(column)).alias("hits"), strings.exists(p, F.col(column)).alias("matched"))

    return run


def _counting(name: str, run: Query, hits: str, table: str = "documents", key: str = "doc_id") -> None:
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, CAST(h AS BIGINT) AS hits, h > 0 AS matched FROM (SELECT {key}, {hits} AS h FROM {table})"


def _extracted(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_counting("str_literal_count", counted("the", is_regex=False), "(length(text) - length(replace(text, 'the', ''))) // 3")
_counting("str_nocase", counted("license", "nocase", is_regex=False), _extracted("(?i)license"))
_counting("str_regex_secret", counted(r'token = "[0-9a-f]{40}"'), _extracted('token = "[0-9a-f]{40}"'))
_counting("str_regex_email", counted(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), _extracted("[A-Za-z0-9._]+@[A-Za-z0-9.]+"))
_counting("str_regex_phone", counted(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), _extracted(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"))
_counting("str_dotall", counted("the.{1,40}?of", "dotall"), _extracted("(?s)the.{1,40}?of"))
_counting("str_multiline", counted("(?m)^The"), _extracted("(?m)^The"))
_counting("str_inline_flags", counted("(?i)license|(?-i)The"), _extracted("(?i:license)|The"))
_counting("str_line_end", counted(r"(?m)\.$"), _extracted(r"(?m)\.$"))
_counting("str_posix_class", counted("[[:upper:]][[:lower:]]+[[:digit:]]"), _extracted("[[:upper:]][[:lower:]]+[[:digit:]]"))
_counting("str_unicode_class", counted(r"\p{Lu}\p{Ll}{9,}"), _extracted(r"\p{Lu}\p{Ll}{9,}"))
_counting("str_swapped_greed", counted("(?U)th.*e"), _extracted("th[^\n]*?e"))
_counting("str_nullable", counted("q*"), "1 + length(replace(text, 'q', ''))")
_counting("html_rules", counted("<script", "nocase", is_regex=False, table="pages", key="page_id", column="html"), _extracted("(?i)<script", "html"), "pages", "page_id")
_counting("events_props_rule", counted(r'"k": 9\d', table="events", key="event_id", column="props"), _extracted(r'"k": 9\d', "props"), "events", "event_id")


@query(r"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: w = 'the')) AS BIGINT) AS the,
  CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w = 'für')) AS BIGINT) AS fuer FROM documents
""")
def str_fullword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boundaries are Unicode's: the hits of a word are the equal ones among all words."""
    hits = lambda word, *m: strings.count(StringPattern("$p", word, frozenset({"fullword", *m})), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", hits("the").alias("the"), hits("für", "nocase").alias("fuer"))


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(^|[^\p{L}\p{N}_\p{M}])der([^\p{L}\p{N}_\p{M}]|$)')) > 0 AS BOOLEAN) AS matched FROM documents
""")
def str_fullword_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", strings.exists(StringPattern("$p", "der", frozenset({"fullword"})), F.col("text")).alias("matched"))


@query("""
SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS plain, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS wide,
  CAST(2 * ((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS wide_regex FROM documents
""")
def str_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is put after its own wide form: `wide` finds the one, `ascii` the other, a wide regular
    expression (which ignores NUL characters) both."""
    rows = docs(spark, sf_dir)
    both = F.concat(F.regexp_replace("text", r"(?s)(.)", "$1\0"), F.lit("\n"), F.col("text"))
    count = lambda regex, *m: strings.count(StringPattern("$p", "the", frozenset(m), regex), both)
    return rows.select("doc_id", count(False, "ascii").alias("plain"), count(False, "wide").alias("wide"), count(True, "wide").alias("wide_regex"))


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(text, 'the'), lambda x: strlen(x)) AS gaps FROM documents),
h AS (SELECT doc_id, gaps, unnest(range(1, len(gaps))) AS i FROM d)
SELECT doc_id, CAST(list_sum(gaps[1 : i]) + 3 * (i - 1) AS BIGINT) AS start_pos, CAST(list_sum(gaps[1 : i]) + 3 * i AS BIGINT) AS end_pos FROM h
""")
def str_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 byte offsets of all hits."""
    hits = strings.details(StringPattern("$p", "the"), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.start_pos", "h.end_pos")


@query("""
WITH p AS (SELECT * FROM (VALUES ('$mit', 'Released under the MIT License'), ('$apache', 'Licensed under the Apache License')) AS t(identifier, line)),
d AS (SELECT doc_id, identifier, line, list_transform(string_split(text, line), lambda x: strlen(x)) AS gaps FROM documents, p),
h AS (SELECT *, unnest(range(1, len(gaps))) AS i FROM d)
SELECT doc_id, identifier, line AS matched_text, CAST(list_sum(gaps[1 : i]) + strlen(line) * (i - 1) AS BIGINT) AS start_pos FROM h
""")
def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of matching rows, from the full map of hits."""
    found = FLAGSHIP.scan(docs(spark, sf_dir), output="matched", detail=True).where("rule_name = 'licensed'")
    entries = found.select("doc_id", F.explode("matched_patterns").alias("identifier", "hits"))
    return entries.select("doc_id", "identifier", F.explode("hits").alias("h")).select("doc_id", "identifier", "h.matched_text", "h.start_pos")


# -- conditions -------------------------------------------------------------------------------

LICENSES = '''
        $mit = "Released under the MIT License"
        $apache = "Licensed under the Apache License"
        $gpl = "GNU General Public License"
        $re = "the"
        $rf = "of"
'''
HAS = {"$mit": "contains(text, 'Released under the MIT License')", "$apache": "contains(text, 'Licensed under the Apache License')", "$gpl": "contains(text, 'GNU General Public License')", "$re": "contains(text, 'the')", "$rf": "contains(text, 'of')"}
N_THE, N_OF = "((length(text) - length(replace(text, 'the', ''))) // 3)", "((length(text) - length(replace(text, 'of', ''))) // 2)"
#: Conditions and what they mean in SQL.
CONDITIONS = {
    "cond_and_or_not": ("$re and not $rf or $mit", f"({HAS['$re']} AND NOT {HAS['$rf']}) OR {HAS['$mit']}"),
    "cond_any_them": ("any of them", " OR ".join(HAS.values())),
    "cond_all_them": ("all of them", " AND ".join(HAS.values())),
    "cond_wildcard": ("all of ($r*) or any of ($m*)", f"({HAS['$re']} AND {HAS['$rf']}) OR {HAS['$mit']}"),
    "cond_explicit_set": ("any of ($mit, $gpl) or all of ($apache, $rf)", f"{HAS['$mit']} OR {HAS['$gpl']} OR ({HAS['$apache']} AND {HAS['$rf']})"),
    "cond_empty_set": ("all of ($nothing*) or any of ($none*) or $gpl", HAS["$gpl"]),
    "cond_precedence": ("$mit or $apache and $re", f"{HAS['$mit']} OR ({HAS['$apache']} AND {HAS['$re']})"),
    "cond_grouping": ("($mit or $apache) and not (not $re)", f"({HAS['$mit']} OR {HAS['$apache']}) AND {HAS['$re']}"),
    "cond_count_eq": ("#re == 3", f"{N_THE} = 3"),
    "cond_count_ne": ("#re != 0", f"{N_THE} <> 0"),
    "cond_count_lt": ("#re < 5", f"{N_THE} < 5"),
    "cond_count_le": ("#re <= 5", f"{N_THE} <= 5"),
    "cond_count_gt": ("#re > 40", f"{N_THE} > 40"),
    "cond_count_ge": ("#re >= 40", f"{N_THE} >= 40"),
    "cond_count_arith": ("#re - #rf + 2 >= 10 and $rf", f"{N_THE} - {N_OF} + 2 >= 10 AND {HAS['$rf']}"),
    "cond_neg": ("--#re > - -10 and -#rf < -1", f"{N_THE} > 10 AND -{N_OF} < -1"),
    "cond_constant": ("1 + 1 == 2", "true"),
    "cond_wrapping": ("#re + 9223372036854775807 < 0", f"{N_THE} > 0"),
}


def _condition(name: str, text: str, sql: str) -> None:
    rules = compile_str(f"rule r {{ strings: {LICENSES} condition: {text} }}")
    QUERIES[name] = lambda spark, sf_dir: rules.scan(docs(spark, sf_dir), output="wide").select("doc_id", F.col("r").alias("matched"))
    SQL[name] = f"SELECT doc_id, {sql} AS matched FROM documents"


for _name, (_text, _sql) in CONDITIONS.items():
    _condition(_name, _text, _sql)


@query("""
WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, (length(text) - length(replace(text, 'user:', ''))) // 5 >= 2 AND (length(text) - length(replace(text, 'assistant:', ''))) // 10 >= 1 AS matched FROM t
""")
def multi_turn_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = compile_str('rule r { strings: $user = "user:"\n $assistant = "assistant:"\n condition: #user >= 2 and #assistant >= 1 }')
    return rules.scan(transcripts(read(spark, sf_dir, "conversations")), output="wide").select("conv_id", F.col("r").alias("matched"))


# -- cleaners and chunkers --------------------------------------------------------------------


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def clean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no NFKC; the documents are their own NFKC."""
    return docs(spark, sf_dir).select("doc_id", F.md5(cleaners.default_cleaning(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def clean_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(cleaners.aggressive_cleaning(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def clean_no_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(cleaners.no_op(F.col("text")).cast("binary")).alias("digest"))


def chunked(chunker) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = docs(spark, sf_dir).select("doc_id", F.posexplode(chunker(F.col("text"))).alias("pos", "chunk"))
        return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("chunk").cast("binary")).alias("digest"))

    return run


def _chunking(name: str, chunker, parts: str) -> None:
    QUERIES[name] = chunked(chunker)
    SQL[name] = f"""
WITH c AS (SELECT doc_id, text, {parts} AS parts FROM documents),
k AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN [text] ELSE parts END AS parts FROM c)
SELECT doc_id, CAST(i AS BIGINT) AS pos, md5(parts[i + 1]) AS digest FROM k, LATERAL (SELECT unnest(range(len(parts))) AS i)"""


def _kept(parts: str) -> str:
    trimmed = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    return f"list_filter(list_transform({parts}, lambda x: {trimmed}), lambda x: x <> '')"


def _windows(size: int, step: int) -> str:
    words = r"regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
    return f"list_transform(range(0, len({words}), {step}), lambda i: array_to_string(list_slice({words}, i + 1, i + {size}), ' '))"


_chunking("chunk_none", chunkers.no_chunking, "[text]")
_chunking("chunk_sentence", chunkers.sentence_chunking, _kept("regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+')"))
_chunking("chunk_paragraph", chunkers.paragraph_chunking, _kept("string_split(text, chr(10) || chr(10))"))
_chunking("chunk_word", chunkers.word_chunking, _windows(100, 100))
_chunking("chunk_fixed", chunkers.fixed_size_chunking, _windows(512, 462))


# -- similarity, classifiers, chat ---------------------------------------------------------------


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 4) AS score FROM embeddings, q
WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) >= 0.2
""")
def similarity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    pattern = rows.where("vec_id = 0").select("embedding").first()[0]
    score = cosine(F.col("embedding"), vector(pattern))
    return rows.select("vec_id", score.alias("s")).where("s >= 0.2").select("vec_id", F.round("s", 4).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS pattern_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 5)
SELECT e.vec_id, q.pattern_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 4) AS score
FROM embeddings e, q WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) >= 0.2
""")
def similarity_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five patterns as constants, compared in one pass over the vectors."""
    rows = read(spark, sf_dir, "embeddings")
    patterns = rows.where("vec_id < 5").select("vec_id", "embedding").collect()  # five patterns
    scores = F.array(*(F.struct(F.lit(p["vec_id"]).alias("pattern_id"), cosine(F.col("embedding"), vector(p["embedding"])).alias("s")) for p in patterns))
    found = rows.select("vec_id", F.inline(scores)).where("s >= 0.2")
    return found.select("vec_id", "pattern_id", F.round("s", 4).alias("score"))


@query("""
SELECT d.doc_id, '$c' AS identifier, CAST(l.toxic AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic >= 0.5
""")
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of scores as the classifier."""
    scored = docs(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("score")), "doc_id")
    return scored.where("score >= 0.5").select("doc_id", F.lit("$c").alias("identifier"), "score")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x = 'Released under the MIT License.') AS hits FROM documents)
SELECT doc_id, CAST(len(hits) AS BIGINT) AS hits, 0.75 AS score FROM s WHERE len(hits) > 0
""")
def classifier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of scores by pattern and sentence, as the classifier of a rule."""
    rules = compile_str('rule r { classifier: $c = "license" threshold=0.7 cleaner=no_op chunker=sentence_chunking classifier=table\n condition: $c }')
    line = "Released under the MIT License."
    rules.register_classifier("table", TableClassifier({("license", line): 0.75, ("other", line): 1.0, ("license", "No."): 0.6}))
    hits = F.col("matched_patterns")["$c"]
    return rules.scan(docs(spark, sf_dir), output="matched", detail=True).select("doc_id", F.size(hits).cast("bigint").alias("hits"), F.get(hits, F.lit(0))["score"].alias("score"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
p AS (SELECT doc_id, list_filter(parts, lambda x: x IN ('Released under the MIT License.', 'Licensed under the Apache License, Version 2.')) AS hits FROM s)
SELECT doc_id, CAST(len(hits) AS BIGINT) AS hits FROM p WHERE len(hits) > 0
""")
def similarity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by text, as the matcher of a rule: sentences whose vector is close to the pattern's."""
    rules = compile_str('rule r { similarity: $s = "licenses" threshold=0.9 cleaner=no_op chunker=sentence_chunking matcher=table\n condition: $s }')
    rules.register_semantic_matcher("table", TableEmbedder({"licenses": [1.0, 1.0], "Released under the MIT License.": [2.0, 1.5], "Licensed under the Apache License, Version 2.": [1.0, 1.2]}, 2))
    found = rules.scan(docs(spark, sf_dir), output="matched", detail=True)
    return found.select("doc_id", F.size(F.col("matched_patterns")["$s"]).cast("bigint").alias("hits"))


@query(r"""
WITH d AS (SELECT doc_id, text || chr(10) || replace(regexp_replace('The License', '(.)', '\1' || chr(1), 'g'), chr(1), chr(0)) AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, 'License')) + 1 AS BIGINT) AS hits, len(regexp_extract_all(t, 'License')) >= 2 AS matched FROM d
""")
def str_wide_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modifiers as a rule spells them: `wide ascii` finds the plain hits and the one wide hit at the end."""
    rules = compile_str('rule r { strings: $p = "License" wide ascii\n condition: #p >= 3 }')
    text = F.concat("text", F.lit("\n"), F.lit("".join(c + "\0" for c in "The License")))
    rows = docs(spark, sf_dir).select("doc_id", text.alias("text"))
    p = rules.rules[0].strings[0]
    return rules.scan(rows, output="wide").select("doc_id", strings.count(p, F.col("text")).alias("hits"), F.col("r").alias("matched"))


@query("""
SELECT doc_id, CAST(i AS INT) AS rule_idx, 'security' AS owner, 'v' || i AS version, contains(text, 'License') AS matched FROM documents, range(2) AS t(i)
""")
def rule_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules say about themselves, on every row."""
    rules = compile_str("".join(f'rule r{i} {{ meta: owner = "security" version="v{i}"\n strings: $l = "License"\n condition: $l }}\n' for i in range(2)))
    return rules.scan(docs(spark, sf_dir)).select("doc_id", "rule_idx", F.col("meta")["owner"].alias("owner"), F.col("meta")["version"].alias("version"), "matched")


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(replace(replace(text, 'f', 'fi'), ' ', ' 1 ')), '\s+', ' ', 'g'))) AS digest FROM documents
""")
def clean_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with signs that NFKC takes apart: a ligature for each f, wide digits and spaces between words."""
    text = F.replace(F.replace(F.col("text"), F.lit("f"), F.lit("\ufb01")), F.lit(" "), F.lit("\u3000\uff11\u00a0"))
    return docs(spark, sf_dir).select("doc_id", F.md5(cleaners.default_cleaning(text).cast("binary")).alias("digest"))


@query("""
SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND contains(d.text, 'License')
""")
def classifier_and_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = compile_str('rule r { strings: $l = "License"\n condition: $l }')
    found = rules.scan(docs(spark, sf_dir), output="matched")
    return found.join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


class _KeywordScore:
    """The share of a pattern's words that a text has."""

    def score(self, pattern, texts):
        words = set(pattern.split())
        return [len(words & set(t.split())) / len(words) for t in texts]


@query(r"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
p AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN [text] ELSE parts END AS parts FROM s)
SELECT doc_id, CAST(len(list_filter(parts, lambda x: list_contains(regexp_split_to_array(x, '\s+'), 'the') AND list_contains(regexp_split_to_array(x, '\s+'), 'and'))) AS BIGINT) AS hits FROM p
WHERE len(list_filter(parts, lambda x: list_contains(regexp_split_to_array(x, '\s+'), 'the') AND list_contains(regexp_split_to_array(x, '\s+'), 'and'))) >= 3
""")
def classifier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that have both words, counted by the condition."""
    rules = compile_str('rule r { classifier: $c = "the and" threshold=1.0 cleaner=no_op chunker=sentence_chunking classifier=words\n condition: #c >= 3 }')
    rules.register_classifier("words", _KeywordScore())
    found = rules.scan(docs(spark, sf_dir), output="matched", detail=True)
    return found.select("doc_id", F.size(F.col("matched_patterns")["$c"]).cast("bigint").alias("hits"))


def _says(pattern: str, text: str) -> tuple[bool, str]:
    return (pattern in text, f"has {pattern}")


def chat_rules(condition: str) -> RuleSet:
    rules = compile_str(f'rule r {{ strings: $s = "License"\n llm: $a = "MIT" llm=contains\n $b = "General" llm=contains\n condition: {condition} }}')
    rules.register_llm_evaluator("contains", FunctionChat(_says))
    return rules


@query("SELECT doc_id, 'has MIT' AS explanation FROM documents WHERE contains(text, 'License') AND contains(text, 'MIT')")
def llm_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_rules("$s and $a").scan(docs(spark, sf_dir), output="matched", detail=True)
    return found.select("doc_id", F.get(F.col("matched_patterns")["$a"], F.lit(0))["explanation"].alias("explanation"))


@query("""
SELECT doc_id, contains(text, 'License') AND contains(text, 'MIT') OR contains(text, 'License') AND contains(text, 'General') AS either, false AS both_compat,
  contains(text, 'MIT') AND contains(text, 'General') AS both_sound FROM documents
""")
def llm_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chat patterns joined by `and` are never asked about in the compatible mode, and are in the sound one."""
    rows = docs(spark, sf_dir)
    either = chat_rules("$s and ($a or $b)").scan(rows, output="wide").withColumnRenamed("r", "either")
    both = chat_rules("$a and $b")
    compat = both.scan(either, output="wide").withColumnRenamed("r", "both_compat")
    return both.scan(compat, output="wide", short_circuit="sound").withColumnRenamed("r", "both_sound").drop("text")


@query("""
WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' yes: because' WHEN 1 THEN 'NO' WHEN 2 THEN 'Yesterday: x' WHEN 3 THEN 'No : a: b' ELSE 'YES' END AS answer FROM events)
SELECT event_id, event_id % 5 IN (0, 4) AS matches, CASE event_id % 5 WHEN 0 THEN 'because' WHEN 1 THEN 'LLM did not match' WHEN 2 THEN 'Ambiguous LLM response: Yesterday: x' WHEN 3 THEN 'a: b' ELSE 'LLM matched' END AS explanation FROM a
""")
def llm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading of answers as columns."""
    k = F.col("event_id") % 5
    answer = F.when(k == 0, " yes: because").when(k == 1, "NO").when(k == 2, "Yesterday: x").when(k == 3, "No : a: b").otherwise("YES")
    return read(spark, sf_dir, "events").select("event_id", answer_matches(answer).alias("matches"), answer_explanation(answer).alias("explanation"))


@query()
def similarity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity rule with a hashing embedder over sentences; tested against the plain evaluator."""
    rules = compile_str('rule r { similarity: $s = "the and attion" threshold=0.55 chunker=sentence_chunking matcher=hashing\n condition: #s >= 1 }')
    rules.register_semantic_matcher("hashing", HashingEmbedder())
    found = rules.scan(docs(spark, sf_dir), output="matched", detail=True)
    return found.select("doc_id", F.size(F.col("matched_patterns")["$s"]).alias("hits"))


@query()
def embed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all page addresses' hosts, each distinct one embedded once; tested on a fixture."""
    hosts = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    found = scoring.embed_distinct(hosts, "host", HashingEmbedder(16))
    return found.select("page_id", "host", F.size("embedding").alias("size"))


# -- perceptual hashes ------------------------------------------------------------------------


@query("""
SELECT a.vec_id, CAST(bit_count(xor(a.vec_id, CAST(255 AS BIGINT))) AS BIGINT) AS distance, 1 - bit_count(xor(a.vec_id, CAST(255 AS BIGINT))) / 64.0 AS score
FROM embeddings a WHERE 1 - bit_count(xor(a.vec_id, CAST(255 AS BIGINT))) / 64.0 >= 0.95
""")
def phash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "embeddings").select("vec_id", hamming(F.col("vec_id"), F.lit(255).cast("bigint")).cast("bigint").alias("distance"), hash_similarity(F.col("vec_id"), F.lit(255).cast("bigint")).alias("score"))
    return found.where("score >= 0.95")


@query("""
WITH b AS (SELECT doc_id, encode(text) AS t, strlen(text) AS n FROM documents),
s AS (SELECT doc_id, list_transform(range(65), lambda i: ('0x' || hex(t[CAST(i * (n - 1) // 64 AS BIGINT) + 1 : CAST(i * (n - 1) // 64 AS BIGINT) + 1]))::INT) AS s FROM b WHERE n > 0)
SELECT doc_id, CASE WHEN s IS NOT NULL THEN array_to_string(list_transform(range(64), lambda i: CASE WHEN s[64 - i] > s[65 - i] THEN '1' ELSE '0' END), '') END AS bits FROM documents LEFT JOIN s USING (doc_id)
""")
def phash_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-sampling hash of texts as files, highest bit first; null for empty ones."""
    found = docs(spark, sf_dir).select("doc_id", scoring.hashed(F.col("text").cast("binary"), video_hash).alias("h"))
    return found.select("doc_id", F.lpad(F.bin(F.col("h.hash")), 64, "0").alias("bits"))


# -- reports ----------------------------------------------------------------------------------


@query(r"""
WITH m AS (
  SELECT unnest(['secret', 'high']) AS tag, 'credential' AS rule_name FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')
  UNION ALL SELECT 'legal', 'licensed' FROM documents WHERE contains(text, 'Released under the MIT License') OR contains(text, 'Licensed under the Apache License')
  UNION ALL SELECT 'privacy', 'contact' FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')
  UNION ALL SELECT 'style', 'wordy' FROM documents WHERE (length(text) - length(replace(text, 'the', ''))) // 3 BETWEEN 20 AND 200)
SELECT tag, rule_name, count(*) AS matches FROM m GROUP BY ROLLUP (tag, rule_name)
""")
def tags_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_tag(FLAGSHIP.scan(docs(spark, sf_dir), output="matched"))


@query(r"""
SELECT 0 AS rule_idx, 'credential' AS rule_name, count(*) AS scanned, CAST(count_if(regexp_matches(text, 'token = "[0-9a-f]{40}"')) AS BIGINT) AS matches FROM documents
UNION ALL SELECT 1, 'licensed', count(*), CAST(count_if(contains(text, 'Released under the MIT License') OR contains(text, 'Licensed under the Apache License')) AS BIGINT) FROM documents
UNION ALL SELECT 2, 'contact', count(*), CAST(count_if(regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS BIGINT) FROM documents
UNION ALL SELECT 3, 'wordy', count(*), CAST(count_if((length(text) - length(replace(text, 'the', ''))) // 3 BETWEEN 20 AND 200) AS BIGINT) FROM documents
""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_rule(FLAGSHIP.scan(docs(spark, sf_dir)))
