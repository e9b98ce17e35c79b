import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ruleweave import compile_str
from ruleweave.engine import any_match, display
from ruleweave.errors import ComponentNotFound
from ruleweave.evaluate import scan_text
from ruleweave.operators import models, scoring
from ruleweave.sources.rule_files import content_files
from ruleweave.sql import create_scan_view, register_table_function
from ruleweave.streaming.scan import alert_counts, for_each_batch, scan_stream

from test_functions import RAMP, SAMPLES, png, wav

RULES = r"""
rule injection : security { meta: level = "high"
    strings: $a = "ignore previous" nocase
             $b = /system prompt/i
    condition: any of them }
rule greeting { strings: $h = "hello" fullword  $n = "x"
    condition: #h >= 2 }
rule nothing { meta: k = "v" }
rule never { strings: $bad = /(?=x)/
    condition: $bad }
"""


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def as_plain(patterns):
    return {k: [(d["matched_text"], d["start_pos"], d["end_pos"], round(d["score"], 4), d["explanation"]) for d in v] for k, v in patterns.items()}


def plain(match):
    return {k: [(d.matched_text, d.start_pos, d.end_pos, round(d.score, 4), d.explanation) for d in v] for k, v in match.matched_patterns.items()}


def agree(spark, rules, texts, **options):
    for r in rules.scan(table(spark, *texts), detail=True, **options).collect():
        m = scan_text(rules, texts[r.id])[r.rule_idx]
        assert (r.rule_name, r.tags, r.meta, r.matched, as_plain(r.matched_patterns)) == (m.rule_name, m.tags, m.meta, m.matched, plain(m)), (texts[r.id], r.rule_name)


def test_long_output(spark):
    rules = compile_str(RULES)
    texts = ["Please IGNORE previous orders", "hello hello", "helloworld", "", "the System Prompt; hello x hello"]
    agree(spark, rules, texts)
    got = rules.scan(table(spark, *texts, None))
    assert got.count() == 6 * 4 and got.columns == ["id", "text", "rule_idx", "rule_name", "tags", "meta", "matched", "matched_patterns", "errors"]
    never = got.where("rule_name = 'never'").first()
    assert not never.matched and "look-around" in never.errors[0]


def test_other_outputs(spark):
    rules = compile_str(RULES)
    df = table(spark, "ignore previous", "hello hello")
    assert rows(rules.scan(df, output="wide").drop("text")) == [(0, True, False, False, False), (1, False, True, False, False)]
    assert rows(rules.scan(df, output="matched").select("id", "rule_name")) == [(0, "injection"), (1, "greeting")]
    found = rules.scan(df, output="array", detail=True)
    assert [r[0] for r in found.orderBy("id").select(any_match(F.col("matches"))).collect()] == [True, True]
    assert found.orderBy("id").select(display(F.col("matches")[0])).first()[0] == "Match(rule='injection', matched=true, patterns=1)"
    assert str(scan_text(rules, "ignore previous")[0]) == "Match(rule='injection', matched=true, patterns=1)"
    with pytest.raises(ValueError):
        rules.scan(df, output="odd")


def test_duplicate_rule_names_and_clashing_columns(spark):
    rules = compile_str('rule a { strings: $a = "x"\n condition: $a } rule a { strings: $a = "y"\n condition: $a }')
    df = table(spark, "x").withColumn("_scan_text", F.lit("mine"))
    assert rules.scan(df, output="wide").columns == ["id", "text", "_scan_text", "a_0", "a_1"]
    assert [r.matched for r in rules.scan(df).orderBy("rule_idx").collect()] == [True, False]


def test_empty_rule_set_and_table(spark):
    assert compile_str("").scan(table(spark, "x")).count() == 0
    assert compile_str(RULES).scan(table(spark, "x").limit(0)).count() == 0


def test_nothing_is_shuffled_and_patterns_are_shared(spark):
    rules = compile_str('rule a { strings: $a = /ab+c/\n condition: $a } rule b { strings: $z = /ab+c/\n condition: #z > 1 }')
    plan = rules.scan(table(spark, "abc"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("ab+c") == 1


def test_similarity(spark):
    rules = compile_str('rule s { similarity: $s = "hello" threshold=0.7 cleaner=no_op matcher=t\n condition: $s }')
    rules.register_semantic_matcher("t", models.TableEmbedder({"hello": [1, 0, 0], "hi": [0.95, 0.1, 0], "bye": [0, 1, 0]}))
    agree(spark, rules, ["hi", "bye", "unknown", ""])
    row = rules.scan(table(spark, "hi"), detail=True).first()
    assert as_plain(row.matched_patterns) == {"$s": [("hi", None, None, 0.9945, "Semantic similarity: 0.995")]}


def test_classifier_counts_chunks(spark):
    rules = compile_str('rule c { classifier: $c = "p" threshold=0.5 cleaner=no_op chunker=sentence_chunking classifier=t\n condition: #c == 2 }')
    rules.register_classifier("t", models.TableClassifier({("p", "a."): 0.92, ("p", "b."): 0.5, ("p", "c."): 0.1}))
    agree(spark, rules, ["a. b. c.", "a. c.", "z", "a. b. a."])
    assert rows(rules.scan(table(spark, "a. b. c.", "a."), output="wide").select("id", "c")) == [(0, True), (1, False)]


CALLS = []


def chat_rules(condition):
    rules = compile_str(f'rule r {{ strings: $s = "s"\n llm: $x = "x" llm=f\n $y = "y" llm=f\n condition: {condition} }}')
    rules.register_llm_evaluator("f", models.FunctionChat(lambda p, t: (p in t, f"{p}!")))
    return rules


@pytest.mark.parametrize("condition", ["$s and $x", "$x and $y", "$x or $y", "not $x", "#x + #y > 1", "$s or $x", "all of them", "any of ($x, $y) and not $s"])
def test_chat_compatible_mode(spark, condition):
    agree(spark, chat_rules(condition), ["s", "x", "y", "sx", "xy", "sxy", ""])


def test_chat_sound_mode(spark):
    texts = ["s", "x", "xy", "sxy", ""]
    for condition, want in (("$x and $y", [False, False, True, True, False]), ("not $x", [True, False, False, False, True]), ("$s or $x", [True, True, True, True, False])):
        found = chat_rules(condition).scan(table(spark, *texts), output="wide", short_circuit="sound").orderBy("id")
        assert [r.r for r in found.collect()] == want, condition


def test_chat_is_asked_only_where_needed(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(pattern, text):
        calls.add(1)
        return True, ""

    rules = compile_str('rule r { strings: $s = "s"\n llm: $x = "x" llm=f\n condition: $s and $x }')
    rules.register_llm_evaluator("f", models.FunctionChat(ask))
    rules.scan(table(spark, "s1", "a", "b", "s2", "c"), output="wide").collect()
    assert calls.value == 2


def test_errors_are_reported_and_do_not_match(spark):
    class Broken:
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0] for _ in texts]

    rules = compile_str('rule r { similarity: $s = "p" cleaner=no_op chunker=sentence_chunking matcher=b\n condition: $s } rule m { similarity: $s = "p" matcher=missing\n condition: not $s }')
    rules.register_semantic_matcher("b", Broken())
    got = {(r.id, r.rule_name): r for r in rules.scan(table(spark, "good. bad.", "good."), detail=True).collect()}
    assert not got[0, "r"].matched and "RuntimeError: no" in got[0, "r"].errors[0]
    assert got[1, "r"].matched and got[1, "r"].errors == []
    assert got[1, "m"].matched and "missing" in got[1, "m"].errors[0]
    strict = compile_str('rule m { similarity: $s = "p" matcher=missing\n condition: $s }', strict=True)
    with pytest.raises(ComponentNotFound):
        strict.scan(table(spark, "x"))
    with pytest.raises(ComponentNotFound):
        rules.registry.register("odd", "x", None)


def test_own_cleaner_and_chunker(spark):
    rules = compile_str('rule r { classifier: $c = "p" threshold=1 cleaner=up chunker=bars classifier=t\n condition: $c }')
    rules.register_cleaner("up", F.upper)
    rules.register_chunker("bars", lambda t: F.split(t, r"\|"))
    rules.register_classifier("t", models.TableClassifier({("p", "B"): 1.0}))
    assert rows(rules.scan(table(spark, "a|b", "a"), output="wide").select("id", "r")) == [(0, True), (1, False)]


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(RAMP))
    (tmp_path / "b.png").write_bytes(png(RAMP[:, ::-1]))
    (tmp_path / "c.wav").write_bytes(wav(SAMPLES))
    (tmp_path / "d.txt").write_bytes(b"hello \xff hello")
    ref = tmp_path / "a.png"
    rules = compile_str(f'rule img {{ phash: $p = "{ref}" threshold=0.95\n condition: $p }} rule text {{ strings: $h = "hello"\n condition: #h == 2 }} rule gone {{ phash: $p = "{tmp_path}/none.png"\n condition: not $p }}')
    files = content_files(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.rule_name): r for r in rules.scan_files(files, detail=True).collect()}
    assert got["a.png", "img"].matched and got["a.png", "img"].matched_patterns["$p"][0].score == 1.0
    assert not got["b.png", "img"].matched and not got["c.wav", "img"].matched
    assert "unknown image format" in got["c.wav", "img"].errors[0]
    assert got["a.png", "gone"].matched and "FileReadError" in got["a.png", "gone"].errors[0]
    assert ("d.txt", "text") not in got
    both = rules.scan_files(files, output="matched", all_rules=True)
    assert ("text",) in [(r.rule_name,) for r in both.where("path like '%d.txt'").collect()]
    assert not rules.scan(table(spark, "x")).where("rule_name = 'img' and matched").count()


def test_http_backends(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/e":
                out = {"data": [{"embedding": [float(len(body["input"])), 1.0]}]}
            elif self.path == "/o":
                out = {"embeddings": [[1.0, 0.0]]}
            elif self.path == "/fail":
                self.send_response(500)
                self.end_headers()
                return
            else:
                assert self.headers["Authorization"] == "Bearer k"
                yes = "<input>s" in body["messages"][1]["content"]
                out = {"choices": [{"message": {"content": "YES: s" if yes else "NO"}, "finish_reason": "stop"}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert models.HttpEmbedder(f"{url}/e").embed(["ab", "", "ab"]) == [[2.0, 1.0], [], [2.0, 1.0]]
        assert models.HttpEmbedder(f"{url}/o", style="ollama").embed(["x"]) == [[1.0, 0.0]]
        chat = models.HttpChat(models.ChatConfig(f"{url}/c", api_key="k"))
        assert chat.ask("p", ["s", "t", ""]) == [(True, "s"), (False, "LLM did not match"), (False, "Empty input")]
        rules = compile_str('rule r { similarity: $s = "p" matcher=down\n condition: not $s }')
        rules.register_semantic_matcher("down", models.HttpEmbedder(f"{url}/fail"))
        row = rules.scan(table(spark, "x")).first()
        assert row.matched and "500" in row.errors[0]
    finally:
        server.shutdown()


def test_distinct_helpers(spark):
    df = table(spark, "a", "b", "a", None)
    got = scoring.embed_distinct(df, "text", models.HashingEmbedder(4))
    assert got.count() == 4 and got.where("embedding is null").count() == 1
    asked = scoring.answer_distinct(df, "text", models.FunctionChat(lambda p, t: (p == t, "w")), "a")
    assert sorted(r.id for r in asked.where("answer.matches").collect()) == [0, 2]


def test_sql_surface(spark):
    register_table_function(spark, RULES)
    assert spark.sql("select matched from rule_scan('hello hello') where rule_name = 'greeting'").first()[0]
    create_scan_view(table(spark, "hello hello", "x"), compile_str(RULES), "scanned", output="matched")
    assert spark.sql("select count(*) from scanned").first()[0] == 1


def test_streams(spark, tmp_path):
    table(spark, "hello hello", "x", "ignore previous").withColumn("ts", F.timestamp_seconds(F.col("id") * 100)).write.parquet(str(tmp_path / "in"))
    schema = "id int, text string, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rules = compile_str(RULES)
    q = scan_stream(rules, stream(), output="matched").writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("hits").select("id", "rule_name")) == [(0, "greeting"), (2, "injection")]
    seen = []
    q = for_each_batch(rules, stream(), lambda df, n: seen.extend(df.where("matched").select("id").collect()), output="long").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in seen) == [0, 2]
    q = alert_counts(rules, stream(), "ts", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("alerts").select("rule_name", "matches")) == [("greeting", 1), ("injection", 1)]


def test_small_inputs_are_dealt_to_all_cores(spark, sf_dir):
    from ruleweave.plans.partitions import spread

    few = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert few.rdd.getNumPartitions() < cores and spread(few).count() == few.count()
    assert "Repartition" in spread(few)._jdf.queryExecution().logical().toString()
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
    shuffled = few.groupBy("lang").count()
    assert spread(shuffled) is shuffled
