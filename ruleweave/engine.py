"""Rule sets: compiled on the driver, run as one lazy Spark plan.

A scan adds, in order of cost: string counts or tests as native expressions, each distinct pattern once
for all rules that share it; one column per distinct cleaner and chunker; similarity, hash and classifier
patterns as Arrow functions; chat patterns one after the other, each only where its rule still needs it.
Conditions are then plain boolean columns, and results an array of structs that is unfolded in place.
Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ComponentNotFound, FileReadError, InvalidPattern, RuleFileNotFound, RuleweaveError
from .functions.vectors import hash_similarity
from .lang import condition as C
from .lang import rules as R
from .lang.model import Rule
from .operators import scoring
from .operators.registry import Registry
from .plans import condition as plan
from .plans import strings


def compile_str(source: str, strict: bool = False, on_invalid: str = "never_match") -> RuleSet:
    """A rule set from source. Regular expressions outside the dialect never match, or are errors with
    on_invalid="error"."""
    return RuleSet([R.check(r) for r in R.parse(source, strict)], strict=strict, on_invalid=on_invalid)


def compile(path: str, spark: SparkSession | None = None, **options) -> RuleSet:  # noqa: A001
    """A rule set from a file; with a session, from any path that Spark reads."""
    from .sources.rule_files import read_rules

    return compile_str(read_rules(path, spark), **options)


class RuleSet:
    def __init__(self, rules: list[Rule], registry: Registry | None = None, strict: bool = False, on_invalid: str = "never_match") -> None:
        self.rules, self.registry, self.strict = rules, registry or Registry(), strict
        self.invalid: dict[tuple[int, str], str] = {}
        for n, rule in enumerate(rules):
            for p in rule.strings:
                try:
                    strings.searches(p)
                except InvalidPattern as e:
                    if on_invalid == "error":
                        raise
                    self.invalid[n, p.identifier] = str(e)

    # -- registration and facts --

    def register_cleaner(self, name: str, cleaner) -> None:
        """cleaner: a function from a text column to a text column."""
        self.registry.register("cleaner", name, cleaner)

    def register_chunker(self, name: str, chunker) -> None:
        """chunker: a function from a text column to an array<string> column."""
        self.registry.register("chunker", name, chunker)

    def register_semantic_matcher(self, name: str, embedder) -> None:
        self.registry.register("matcher", name, embedder)

    def register_classifier(self, name: str, classifier) -> None:
        self.registry.register("classifier", name, classifier)

    def register_llm_evaluator(self, name: str, chat) -> None:
        self.registry.register("llm", name, chat)

    def register_phash_matcher(self, name: str, hasher) -> None:
        """hasher: a function from file contents to a 64-bit integer."""
        self.registry.register("hasher", name, hasher)

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    @property
    def rule_names(self) -> list[str]:
        return [r.name for r in self.rules]

    # -- scanning --

    def scan(self, df: DataFrame, text: str = "text", output: str = "long", detail: bool = False, short_circuit: str = "compat") -> DataFrame:
        """Scan a column of texts; null counts as empty.

        output: "long" gives a row per input row and rule (columns of df, then rule_idx, rule_name, tags,
        meta, matched, matched_patterns, errors), "matched" only the rows that match, "wide" the input
        with one boolean column per rule, "array" the input with an array `matches`. detail: fill
        matched_patterns, for matching rows, with all hits of every identifier. short_circuit: "compat"
        asks a chat model only if the rule holds with its answer yes and those of later ones no; "sound"
        asks unless the rule is decided whatever the pending answers.
        """
        return _Scan(self, df, F.coalesce(F.col(text), F.lit("")), None, list(enumerate(self.rules)), detail, short_circuit).result(output)

    def scan_files(self, files: DataFrame, output: str = "long", detail: bool = False, short_circuit: str = "compat", all_rules: bool = False) -> DataFrame:
        """Scan files (path, content: as of Spark's binaryFile source). Only rules with hash patterns are
        run, or all with all_rules. Contents are also read as UTF-8 text, with malformed bytes replaced."""
        chosen = [(n, r) for n, r in enumerate(self.rules) if all_rules or r.phash]
        text = F.coalesce(F.expr("make_valid_utf8(cast(content as string))"), F.lit(""))
        files = files.select(*[c for c in files.columns if c in ("path", "modificationTime", "length", "content")])
        return _Scan(self, files, text, F.col("content"), chosen, detail, short_circuit).result(output, drop="content")

    def reference_hash(self, spark: SparkSession, path: str, hasher) -> int:
        """The hash of a reference file, read through Spark so that any store will do."""
        try:
            found = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
        except Exception as e:
            raise FileReadError(f"{path}: {e}") from None
        if not found:
            raise RuleFileNotFound(path)
        return hasher(bytes(found[0][0]))


class _Scan:
    """One plan in the making. Added columns have a common prefix and are dropped in the end."""

    def __init__(self, rules: RuleSet, df: DataFrame, text: Column, content: Column | None, chosen, detail: bool, short_circuit: str) -> None:
        if short_circuit not in ("compat", "sound"):
            raise ValueError(f"short_circuit is compat or sound, not {short_circuit!r}")
        self.rules, self.source, self.columns = rules, df, df.columns
        self.chosen, self.detail, self.short = chosen, detail, short_circuit
        self.tag = "_scan"
        while any(c.lower().startswith(self.tag) for c in df.columns):
            self.tag += "_"
        self.df = df.withColumn(self.name("text"), text)
        self.text, self.content = F.col(self.name("text")), content
        self.memo: dict[object, Column] = {}
        self.n = 0
        self.errors: dict[int, list[Column]] = {n: [] for n, _ in chosen}
        self.has: dict[int, dict[str, Column]] = {n: {} for n, _ in chosen}
        self.count: dict[int, dict[str, Column]] = {n: {} for n, _ in chosen}
        self.hits: dict[tuple[int, str], Column] = {}
        self.declared = {n: r.identifiers() for n, r in chosen}

    def name(self, x) -> str:
        return f"{self.tag}_{x}"

    def keep(self, key, columns) -> Column:
        """The column of a key, added to the plan once."""
        if key not in self.memo:
            column = columns()  # may itself keep columns
            self.n += 1
            self.df = self.df.withColumn(self.name(self.n), column)
            self.memo[key] = F.col(self.name(self.n))
        return self.memo[key]

    # -- tiers --

    def strings(self) -> None:
        wanted: dict[tuple, str] = {}
        uses = []
        for n, rule in self.chosen:
            asked = plan.demand(rule.expression, self.declared[n]) if rule.expression is not None else {}
            for p in rule.strings:
                if (n, p.identifier) in self.rules.invalid or p.identifier not in asked:
                    continue
                key = (p.pattern, p.modifiers, p.is_regex)
                uses.append((n, p, key))
                if wanted.get(key) != "count":
                    wanted[key] = asked[p.identifier]
        if not uses:
            return
        first = {key: p for _, p, key in reversed(uses)}
        make = {"count": strings.count, "exists": strings.exists}
        box = F.struct(*(make[how](first[key], self.text).alias(f"p{i}") for i, (key, how) in enumerate(wanted.items())))
        self.df = self.df.withColumn(self.name("found"), box)
        place = {key: i for i, key in enumerate(wanted)}
        for n, p, key in uses:
            found = F.col(f"{self.name('found')}.p{place[key]}")
            if wanted[key] == "count":
                self.count[n][p.identifier], self.has[n][p.identifier] = found, found > 0
            else:
                self.has[n][p.identifier] = found

    def chunks(self, p) -> Column:
        get = self.rules.registry.get
        cleaner, chunker = get("cleaner", p.cleaner), get("chunker", p.chunker)
        clean = self.keep(("clean", p.cleaner), lambda: cleaner(self.text))
        return self.keep(("chunks", p.cleaner, p.chunker), lambda: chunker(clean))

    def model(self, n: int, p, key, score) -> None:
        """Add a model-backed pattern; a component that is missing is an error of the rule, no match."""
        try:
            found = self.keep(key, lambda: score())
        except ComponentNotFound as e:
            if self.rules.strict:
                raise
            self.errors[n].append(F.lit(f"{p.identifier}: {e}"))
            return
        size = F.size(found["hits"])
        self.has[n][p.identifier], self.count[n][p.identifier] = size > 0, size
        self.hits[n, p.identifier] = found["hits"]
        self.errors[n].append(F.when(found["error"].isNotNull(), F.concat(F.lit(p.identifier + ": "), found["error"])))

    def similarity(self) -> None:
        for n, rule in self.chosen:
            for p in rule.similarity:
                key = ("similarity", p.pattern, p.threshold, p.cleaner, p.chunker, p.matcher)
                self.model(n, p, key, lambda p=p: scoring.similar(self.chunks(p), self.rules.registry.get("matcher", p.matcher), p.pattern, p.threshold))

    def classifiers(self) -> None:
        for n, rule in self.chosen:
            for p in rule.classifier:
                key = ("classifier", p.pattern, p.threshold, p.cleaner, p.chunker, p.classifier)
                self.model(n, p, key, lambda p=p: scoring.classified(self.chunks(p), self.rules.registry.get("classifier", p.classifier), p.pattern, p.threshold))

    def hashes(self) -> None:
        if self.content is None:
            return
        for n, rule in self.chosen:
            for p in rule.phash:
                self.model(n, p, ("phash", p.file_path, p.threshold, p.hasher), lambda p=p: self.hash_hits(p))

    def hash_hits(self, p) -> Column:
        hasher = self.rules.registry.get("hasher", p.hasher)
        try:
            wanted = self.rules.reference_hash(self.source.sparkSession, p.file_path, hasher)
        except RuleweaveError as e:
            return scoring.nothing(f"{type(e).__name__}: {e}")
        found = self.keep(("hash", p.hasher), lambda: scoring.hashed(self.content, hasher))
        score = hash_similarity(found["hash"], F.lit(wanted).cast("bigint"))
        hit = F.struct(F.col("path").alias("matched_text"), score.alias("score"), F.format_string("PHash similarity: %.3f", score).alias("explanation"))
        none = F.array().cast("array<struct<matched_text:string,score:double,explanation:string>>")
        return F.struct(F.when(score >= p.threshold, F.array(hit)).otherwise(none).alias("hits"), found["error"].alias("error"))

    def chats(self) -> None:
        """Each pattern's answers decide whether later ones of its rule are asked for."""
        for n, rule in self.chosen:
            pending = {p.identifier for p in rule.chat}
            for p in rule.chat:
                try:
                    chat, chunks = self.rules.registry.get("llm", p.llm), self.chunks(p)
                except ComponentNotFound as e:
                    if self.rules.strict:
                        raise
                    self.errors[n].append(F.lit(f"{p.identifier}: {e}"))
                    pending.discard(p.identifier)
                    continue
                if rule.expression is None:
                    continue
                needed = self.needed(n, rule, p.identifier, pending)
                self.model(n, p, ("chat", n, p.identifier), lambda: scoring.asked(F.when(needed, chunks), chat, p.pattern))  # noqa: B023
                pending.discard(p.identifier)

    def needed(self, n: int, rule: Rule, identifier: str, pending: set[str]) -> Column:
        args = self.has[n], self.count[n], self.declared[n]
        if self.short == "sound":
            return plan.undecided(rule.expression, *args, pending)
        if identifier in C.counted(rule.expression):
            return F.lit(True)
        return plan.lower(rule.expression, self.has[n] | {identifier: F.lit(True)}, self.count[n], self.declared[n])

    # -- results --

    def result(self, output: str, drop: str | None = None) -> DataFrame:
        for tier in (self.strings, self.similarity, self.hashes, self.classifiers, self.chats):
            tier()
        verdicts = {}
        for n, rule in self.chosen:
            value = plan.lower(rule.expression, self.has[n], self.count[n], self.declared[n]) if rule.expression is not None else F.lit(False)
            verdicts[n] = value
        columns = [c for c in self.columns if c != drop]
        if output == "wide":
            names = [r.name for _, r in self.chosen]
            label = lambda n, r: r.name if names.count(r.name) == 1 else f"{r.name}_{n}"
            return self.df.select(*columns, *(verdicts[n].alias(label(n, r)) for n, r in self.chosen))
        box = F.struct(*(v.alias(f"r{n}") for n, v in verdicts.items())) if verdicts else F.lit(None)
        self.df = self.df.withColumn(self.name("verdicts"), box)
        matches = [self.match(n, rule) for n, rule in self.chosen]
        kind = "array<struct<rule_idx:int,rule_name:string,tags:array<string>,meta:map<string,string>,matched:boolean,matched_patterns:map<string,array<struct<identifier:string,matched_text:string,start_pos:bigint,end_pos:bigint,score:double,explanation:string>>>,errors:array<string>>>"
        found = F.array(*matches).cast(kind) if matches else F.array().cast(kind)
        if output == "array":
            return self.df.select(*columns, found.alias("matches"))
        if output == "matched":
            found = F.filter(found, lambda m: m["matched"])
        elif output != "long":
            raise ValueError(f"output is long, matched, wide or array, not {output!r}")
        return self.df.select(*columns, F.inline(found))

    def match(self, n: int, rule: Rule) -> Column:
        matched = F.col(f"{self.name('verdicts')}.r{n}")
        tags = F.array(*map(F.lit, rule.tags)) if rule.tags else F.array().cast("array<string>")
        meta = F.create_map(*(F.lit(x) for kv in rule.meta.items() for x in kv)) if rule.meta else F.create_map().cast("map<string,string>")
        errors = [*self.errors[n], *(F.lit(f"{i}: {e}") for (k, i), e in self.rules.invalid.items() if k == n)]
        errors = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")
        patterns = F.create_map().cast("map<string,array<struct<identifier:string,matched_text:string,start_pos:bigint,end_pos:bigint,score:double,explanation:string>>>")
        if self.detail and rule.patterns():
            ids = self.declared[n]
            full = F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*(self.detail_of(n, rule, i, matched) for i in ids)))
            patterns = F.when(matched, full).otherwise(patterns)
        return F.struct(F.lit(n).alias("rule_idx"), F.lit(rule.name).alias("rule_name"), tags.alias("tags"), meta.alias("meta"), matched.alias("matched"), patterns.alias("matched_patterns"), errors.alias("errors"))

    def detail_of(self, n: int, rule: Rule, identifier: str, matched: Column) -> Column:
        for p in rule.strings:
            if p.identifier == identifier and (n, identifier) not in self.rules.invalid:
                return strings.details(p, F.when(matched, self.text))
        if (n, identifier) in self.hits:
            none = F.lit(None).cast("bigint")
            return F.transform(self.hits[n, identifier], lambda h: strings.detail(F.lit(identifier), h["matched_text"], none, none, h["score"], h["explanation"]))
        return strings.empty_details()


def any_match(matches: Column) -> Column:
    """Whether any rule of an array `matches` matched."""
    return F.exists(matches, lambda m: m["matched"])


def display(match: Column) -> Column:
    """A match struct as text: its rule, verdict and number of hits."""
    hits = F.aggregate(F.map_values(match["matched_patterns"]), F.lit(0), lambda s, h: s + F.size(h))
    return F.format_string("Match(rule='%s', matched=%s, patterns=%d)", match["rule_name"], match["matched"].cast("string"), hits)
