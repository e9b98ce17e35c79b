"""Language ID by Bayesian evidence fusion.

Hypotheses are the languages of the model and "und", uniform noise. The log posterior adds: the text's
n-gram log likelihood (tempered, as neighbouring n-grams overlap), the language that the markup
declares, the one that the address suffix suggests, and a host prior. The host prior comes from grouped
sums of text posteriors, smoothed from host to parent domain to all hosts, without the row's own share.
How far declarations can be trusted is estimated from the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitions import spread
from ..shipping import Shared
from .common import in_tasks, keep_rows, materialize, slices, texts

BUCKETS = 1 << 15
#: Languages are counted over all labelled rows. The model is fitted on at most so many of them, dealt
#: evenly to languages (one row each at least): those with the least hash in each.
MAX_LABELLED = 20_000
TEMPER, SMOOTH, HOST_WEIGHT, UNKNOWN = 0.2, 0.5, 20.0, 1e-4
#: Share of any text that is numbers, names and the like: a language draws so much of it from noise.
FOREIGN = 0.1
#: Fixed: country suffixes that suggest a language.
SUFFIXES = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en",
    "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "se": "sv",
}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # log probability of each bucket, by language


def gram_buckets(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of " text ", A-Z lower-cased, and where each text's begin."""
    data = np.frombuffer(b" " + b"  ".join(docs).lower() + b" ", np.uint8).astype(np.uint32)
    size = np.fromiter((len(d) + 2 for d in docs), np.int64, len(docs))
    ends = np.cumsum(size)
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return code[inside[:-2]], np.concatenate([[0], np.cumsum(size - 2)])


def _count(languages: tuple[str, ...]):
    def run(batches):
        counts: dict[int, np.ndarray] = {}  # of the languages that this task meets
        number = {x: i for i, x in enumerate(languages)}
        for batch in slices(batches, "text"):
            code, at = gram_buckets(texts(batch["text"]))
            for i, lang in enumerate(batch["lang"].to_pylist()):
                mine = counts.setdefault(number[lang], np.zeros(BUCKETS, np.int64))
                np.add.at(mine, code[at[i] : at[i + 1]], 1)
        for lang, mine in counts.items():
            bucket = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang), pa.int32()), pa.array(bucket, pa.int32()), pa.array(mine[bucket])], ["lang", "bucket", "n"])

    return run


def even_quota(counts: list[int], most: int) -> int:
    """Rows that each language may give, so that all give `most` at most; one at least."""
    left, quota = most, 1
    for i, n in enumerate(sorted(counts)):
        quota = max(1, left // (len(counts) - i))
        left -= min(n, quota)
    return quota


def fit(labelled: DataFrame, key: str, text: str = "text", lang: str = "lang", most: int = MAX_LABELLED) -> Model:
    """Fit every language of the rows, on at most `most` rows (or one each). Without any, the model has no language."""
    rows = labelled.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy("lang").collect()  # one row a language
    languages = tuple(sorted(r["lang"] for r in known))
    if not languages:
        return Model((), np.zeros((0, BUCKETS), np.float32))
    quota = even_quota([r["n"] for r in known], most)
    # Hashes up to `last` hold the quota and some more; the exact cut is made among those.
    wide = lambda n: min(1.0, (quota + 4 * quota**0.5 + 10) / n)
    last = [(r["lang"], max(r["least"], int(wide(r["n"]) * ((1 << 64) - 1)) - (1 << 63)) if wide(r["n"]) < 1 else (1 << 63) - 1) for r in known]
    near = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(last, "lang string, last long")), "lang").where("h <= last")
    sample = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_n") <= quota)
    counted = in_tasks(sample.select("text", "lang"), _count(languages), "lang int, bucket int, n long")
    counts = np.full((len(languages), BUCKETS), SMOOTH)
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # at most languages x buckets
        counts[r["lang"], r["bucket"]] += r["n"]
    share = (1 - FOREIGN) * counts / counts.sum(axis=1, keepdims=True) + FOREIGN / BUCKETS
    return Model(languages, np.log(share).astype(np.float32))


def likelihoods(model: Model, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text (row) for each language and, last, for noise; n-grams of each."""
    code, at = gram_buckets(docs)
    n = np.diff(at)
    out = np.zeros((len(docs), len(model.languages) + 1))
    some = np.flatnonzero(n)
    for i, w in enumerate(model.weights):
        if len(some):
            out[some, i] = np.add.reduceat(w[code].astype(np.float64), at[:-1][some])
    out[:, -1] = n * -np.log(BUCKETS)
    blank = np.array([not d.strip() for d in docs], bool)
    out[blank] = 0
    return out, np.where(blank, 0, n)


def _score(shared, keys: list[str]):
    def run(batches):
        model = shared.value
        for batch in slices(batches, "text"):
            ll, n = likelihoods(model, texts(batch["text"]))
            ll = ll * TEMPER
            post = np.exp(ll - ll.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (ll, post)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(n, pa.int64()), *lists], [*keys, "n_grams", "ll", "post"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def identify(rows: DataFrame, model: Model, keys: list[str], host: Column | None = None, markup: Column | None = None, least: float = 0.5) -> DataFrame:
    """keys, language, confidence, n_grams, kept of every row; rows needs a `text` and the keys.

    host: a column with the host or source, null or empty where unknown; its last label is the address
    suffix. markup: the declared language, null where none. A row is rejected (kept false) when "und"
    wins or no language has a posterior of `least`; null, empty and white texts are "und". Repeated
    rows give a row each; an empty table gives none.
    """
    spark = rows.sparkSession
    names = [*model.languages, "und"]
    size = len(names)
    host = F.coalesce(host, F.lit("")) if host is not None else F.lit("")
    markup = F.substring_index(F.substring_index(F.lower(markup), "-", 1), "_", 1) if markup is not None else F.lit(None).cast("string")
    source = spread(rows.select(*keys, "text", host.alias("_host"), markup.alias("_markup")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    shared = Shared(spark.sparkContext, model)
    scored = in_tasks(source, _score(shared, [*keys, "_host", "_markup"]), f"{kinds}, n_grams long, ll array<double>, post array<double>")
    scored = materialize(scored.withColumn("_parent", F.when(F.col("_host").contains("."), F.substring_index("_host", ".", -2)).otherwise(F.lit(""))), "scored")

    # Host priors: sums of posteriors by host, of those by parent, of those over all.
    sums = [F.sum(F.when(F.col("n_grams") > 0, F.col("post")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(size)]
    hosts = materialize(scored.groupBy("_host", "_parent").agg(*sums), "hosts")
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    parents = hosts.groupBy("_parent").agg(*add).select("_parent", F.array(*(F.col(f"s{i}") for i in range(size))).alias("_p"))
    total = hosts.agg(*add).first()
    overall = np.array([total[f"s{i}"] or 0.0 for i in range(size)]) + 1.0
    overall = overall / overall.sum()
    # Trust in declarations: the mean text posterior of what is declared.
    suffix = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[F.substring_index("_host", ".", -1)]
    scored = scored.withColumn("_suffix", F.when(F.col("_host").contains("."), suffix))
    place = lambda c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    agree = lambda c: F.avg(F.when(F.coalesce(place(c), F.lit(0)) > 0, F.get("post", (place(c) - 1).cast("int"))))
    trust = scored.where("n_grams >= 50").agg(agree("_markup").alias("m"), agree("_suffix").alias("s")).first()
    declared = []
    for column, mean in (("_markup", trust["m"]), ("_suffix", trust["s"])):
        sure = min(0.99, max(1 / size, mean if mean is not None else 0.5))
        right, wrong = float(np.log(sure)), float(np.log((1 - sure) / max(1, size - 1)))
        declared.append([F.when(F.coalesce(place(column), F.lit(0)) == 0, 0.0).when(F.col(column) == name, right).otherwise(wrong) for name in names])

    table = hosts.select("_host", "_parent", F.array(*(F.col(f"s{i}") for i in range(size))).alias("_h")).join(parents, "_parent").drop("_parent")
    both = scored.join(table, "_host", "left")
    own = lambda i: F.when(F.col("n_grams") > 0, F.col("post")[i]).otherwise(0.0)

    def smoothed(counts: str, i: int, below: Column | float) -> Column:
        got = F.greatest(F.col(counts)[i] - own(i), F.lit(0.0))
        n = F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) - F.when(F.col("n_grams") > 0, 1.0).otherwise(0.0), F.lit(0.0))
        return (got + HOST_WEIGHT * below) / (n + HOST_WEIGHT)

    scores = []
    for i, name in enumerate(names):
        prior = smoothed("_h", i, smoothed("_p", i, float(overall[i])))
        prior = F.when(F.col("_host") == "", float(overall[i])).otherwise(prior)
        base = F.lit(float(np.log(UNKNOWN))) if name == "und" else F.log(prior)
        scores.append(F.col("ll")[i] + base + declared[0][i] + declared[1][i])
    both = both.withColumn("_score", F.array(*scores)).withColumn("_top", F.array_max("_score"))
    weight = F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    language = F.when(F.col("n_grams") == 0, "und").otherwise(F.element_at(F.array(*map(F.lit, names)), F.array_position("_score", F.col("_top")).cast("int")))
    out = both.select(*keys, language.alias("language"), F.when(F.col("n_grams") == 0, 0.0).otherwise(1.0 / weight).alias("confidence"), "n_grams")
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("confidence") >= least))


def drop_unidentified(docs: DataFrame, model: Model, host: Column | None = None) -> DataFrame:
    """docs without the rejected rows; all columns."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"), (host if host is not None else F.lit("")).alias("host"))
    return keep_rows(docs, identify(rows, model, ["doc_id", "row_hash"], F.col("host")), "kept")


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return bare


def declared_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(found != "", found)
