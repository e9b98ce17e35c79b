from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ruleweave.llm import language_id as L

from .conftest import EDGES, make


def model_of(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"), "doc_id", most=200)


def test_held_out_accuracy(spark):
    model = model_of(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1")
    got = L.identify(docs.select("doc_id", "text", "source"), model, ["doc_id"], F.col("source")).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() >= 0.99 * got.count()
    assert got.where("kept").count() >= 0.99 * got.count()
    short = docs.select("doc_id", "lang", F.substring("text", 1, 40).alias("text"))
    got = L.identify(short, model, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() >= 0.85 * got.count()


def test_pages_by_all_evidence(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", L.host_of(F.col("url")).alias("h"), L.declared_language(F.col("html")).alias("m"), L.page_text(F.col("html")).alias("text"))
    got = L.identify(rows, model_of(spark), ["page_id"], F.col("h"), F.col("m")).join(rows.select("page_id", "m"), "page_id")
    assert got.where("language = m").count() >= 0.98 * got.count()


def test_hosts_and_declarations_decide_texts_that_could_be_either(spark):
    """A text without letters of any language leans to its host's language, or to what it declares."""
    model = model_of(spark)
    french = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr'").select("text").limit(40).collect()]
    english = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("text").limit(40).collect()]
    rows = [(i, t, "a.site.com", None) for i, t in enumerate(french)] + [(100 + i, t, "b.site.org", None) for i, t in enumerate(english)]
    rows += [(200, "a e", "a.site.com", None), (201, "a e", "b.site.org", None), (202, "a e", "c.site.com", None)]
    df = spark.createDataFrame(rows, "k long, text string, h string, m string")
    got = {r.k: r.language for r in L.identify(df, model, ["k"], F.col("h"), F.col("m")).where("k >= 200").collect()}
    assert got == {200: "fr", 201: "en", 202: "fr"}  # 202: by its parent domain
    declared = [(i, t, None, "fr-FR") for i, t in enumerate(french)] + [(100 + i, t, None, "en") for i, t in enumerate(english)] + [(200, "a e", None, "FR"), (201, "a e", None, "xx")]
    df = spark.createDataFrame(declared, "k long, text string, h string, m string")
    got = {r.k: r.language for r in L.identify(df, model, ["k"], F.col("h"), F.col("m")).where("k = 200").collect()}
    assert got == {200: "fr"}


def test_noise_is_rejected_and_edges(spark, edges, empty):
    model = model_of(spark)
    rng = np.random.default_rng(1)
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 300)))
    rows = [*EDGES, (50, noise), (51, "The and of the with that this")]
    got = L.identify(make(spark, rows), model, ["doc_id"], F.col("source")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[50].kept and by[50].language == "und" and by[51].kept and by[51].language == "en"
    assert not any(by[i].kept for i in (2, 3, 4)) and by[3].confidence == 0
    left = L.drop_unidentified(edges, model, F.col("source"))
    assert left.columns == edges.columns and {r.doc_id for r in left.collect()} >= {1, 5, 6}
    assert L.identify(empty, model, ["doc_id"]).count() == 0
    assert L.drop_unidentified(empty, L.fit(empty, "doc_id")).count() == 0
    assert L.fit(edges.withColumn("lang", F.lit(None).cast("string")), "doc_id").languages == ()


def test_grams_stay_inside_a_text():
    code, at = L.gram_buckets([b"ab", b"", b"xyz"])
    one, _ = L.gram_buckets([b"xyz"])
    assert at.tolist() == [0, 2, 2, 5] and code[2:].tolist() == one.tolist()


def test_rare_languages_are_answers(spark):
    """A language far from the sample's size, and one of hundreds, are modelled and found."""
    greek = ["η γλώσσα αυτή έχει λίγα κείμενα και πολλές λέξεις", "τα κείμενα αυτά είναι λίγα αλλά η γλώσσα έχει λέξεις", "πολλές λέξεις και λίγα κείμενα έχει αυτή η γλώσσα"]
    rows = [(i, f"the cat and the dog number {i} went to the market with their friends", "en") for i in range(3000)] + [(5000 + i, t, "el") for i, t in enumerate(greek)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.fit(docs, "doc_id", most=40)
    assert model.languages == ("el", "en")
    got = L.identify(docs, model, ["doc_id"]).where("doc_id >= 5000").collect()
    assert [(r.language, r.kept) for r in got] == [("el", True)] * 3
    many = spark.createDataFrame([(i, f"word{i} of a language", f"x{i % 230:03}") for i in range(460)], "doc_id long, text string, lang string")
    assert len(L.fit(many, "doc_id").languages) == 230


def test_even_quota():
    assert L.even_quota([3, 3000], 40) == 37 and L.even_quota([5, 5], 40) >= 5 and L.even_quota([9] * 50, 40) == 1
    assert L.even_quota([100, 100, 100], 90) == 30


def posterior(rows, model):
    """(language, confidence) of each (text, host, markup), by the formulas one by one."""
    names = [*model.languages, "und"]
    size = len(names)
    parent = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    suffix = lambda h: L.SUFFIXES.get(h.split(".")[-1]) if "." in h else None
    scores, grams = L.likelihoods(model, [(t or "").encode() for t, _, _ in rows])
    scores = scores * L.TEMPER
    share = np.exp(scores - scores.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    own = share * (grams > 0)[:, None]
    by_host, by_parent = defaultdict(lambda: np.zeros(size)), defaultdict(lambda: np.zeros(size))
    for (_, host, _), x in zip(rows, own):
        by_host[host or ""] += x
        by_parent[parent(host or "")] += x
    overall = (own.sum(axis=0) + 1) / (own.sum() + size)
    sure = []
    for told in (lambda r: r[2], lambda r: suffix(r[1] or "")):
        mine = [share[i][names.index(told(r))] for i, r in enumerate(rows) if grams[i] >= 50 and told(r) in names]
        sure.append(min(0.99, max(1 / size, np.mean(mine) if mine else 0.5)))
    out = []
    for i, (_, host, markup) in enumerate(rows):
        host, seen = host or "", float(grams[i] > 0)
        prior = overall
        if host:
            up = (np.maximum(by_parent[parent(host)] - own[i], 0) + L.HOST_WEIGHT * overall) / (max(by_parent[parent(host)].sum() - seen, 0) + L.HOST_WEIGHT)
            prior = (np.maximum(by_host[host] - own[i], 0) + L.HOST_WEIGHT * up) / (max(by_host[host].sum() - seen, 0) + L.HOST_WEIGHT)
        total = scores[i] + np.append(np.log(prior[:-1]), np.log(L.UNKNOWN))
        for told, s in zip((markup, suffix(host)), sure):
            if told in names:
                total = total + np.where(np.array(names) == told, np.log(s), np.log((1 - s) / (size - 1)))
        weight = np.exp(total - total.max())
        out.append((names[int(np.argmax(total))], weight.max() / weight.sum()) if seen else ("und", 0.0))
    return out


def test_posteriors_against_brute_force(spark):
    model = model_of(spark)
    rng = np.random.default_rng(7)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    hosts = ["a.site.de", "b.site.de", "www.other.fr", "x.com", "com", "", None, "src1", "y.co.uk"]
    marks = ["en", "de", None, "xx", "fr"]
    rows = [(t[:n] if t else t, hosts[rng.integers(len(hosts))], marks[rng.integers(len(marks))]) for t in texts for n in (5, 30, 400)] + [(None, "x.com", "en"), ("", "", "de"), ("  ", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, text string, h string, m string").repartition(3)
    got = {r.k: r for r in L.identify(df, model, ["k"], F.col("h"), F.col("m")).collect()}
    want = posterior(rows, model)
    assert all(np.isclose(got[i].confidence, c, rtol=1e-6) for i, (_, c) in enumerate(want))
    assert all(got[i].language == x for i, (x, _) in enumerate(want))
