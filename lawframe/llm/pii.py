"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of identifiers they don't know.

Seeds are what the four base patterns find. Every token with a digit or an @ is an instance of its value; the words before
and after it (letters only, lower case) are its lexical patterns. On the graph of patterns and values, scored for `rounds`
rounds: a pattern's confidence is the mean score of its values (seeds count 1, others their score so far), if at least
`least_seeds` different seed values support it; a value's score is 1 - product of (1 - confidence) over its patterns of at least
`confident`. Tokens whose value reaches `accept` and that stand in such a pattern, outside the base spans, are added
as kind `id`.

Only DataFrame operations. Places come from cutting a text at the matches: the lengths of the pieces between and of the matches
add up to the places in code points. The graph has a row per value and pattern, made by partial aggregation, so a common
word is a hot key only in counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

KINDS = ("email", "ip", "card", "phone")

# Base patterns. A start within a run of like characters is tried only where the run begins or the last match ended: no other can match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SPAN = "array<struct<start:int,stop:int,value:string>>"


def places(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap, as (start, stop, value); places in code points, stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.filter(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), g.alias("g"))), lambda s: s["v"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["g"], a["at"] + x["g"] + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), e.alias("stop"), x["v"].alias("value")))).alias("out"))

    return F.aggregate(steps, start, step, lambda a: a["out"])


def luhn(digits: Column) -> Column:
    def add(c: Column, i: Column) -> Column:
        n = c.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), add), F.lit(0), lambda s, x: s + x) % 10 == 0


def fits(kind: str, value: Column) -> Column:
    """What a match must meet beyond its pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def only_fitting(kind: str) -> Column:
    return F.filter(kind, lambda s: F.coalesce(fits(kind, s["value"]), F.lit(False)))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text, email, ip, card, phone): base spans of each row, arrays of SPAN; null text as empty."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({k: F.when(F.col("text").rlike(GATES[k]), places(F.col("text"), PATTERNS[k])).otherwise(F.array().cast(SPAN)) for k in KINDS})
    return d.withColumns({k: only_fitting(k) for k in KINDS if k != "email"}).withColumn("row_key", F.xxhash64("text"))


def instances(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, stop, value, left, right, seed): a row per token with a digit or an @.

    start and stop leave out punctuation at the token's ends; left and right are the words beside it, null where they aren't
    letters only; seed: the token meets a base span. Values of under four characters are left out: too many things are written so.
    """
    has = F.col("text").rlike("[0-9@]")
    words = lambda s: F.regexp_replace(F.lower(s), r"^[^\p{L}]+|[^\p{L}]+$", "")
    only = lambda s: F.when(s.rlike(r"^\p{L}+$"), s)
    spans = F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    # the tokens in order, and in the same order the places among all words of those words that hold a digit or an @
    d = found.select("doc_id", "row_key", spans.alias("spans"), F.when(has, places(F.col("text"), TOKEN)).alias("tokens"), F.when(has, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w")).where("tokens IS NOT NULL")
    d = d.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.rlike("[0-9@]"), i)), lambda i: i.isNotNull()))
    beside = F.zip_with("tokens", "at", lambda t, i: F.struct(t.alias("t"), F.get(F.col("w"), i - 1).alias("left"), F.get(F.col("w"), i + 1).alias("right")))
    d = d.select("doc_id", "row_key", "spans", F.explode(beside).alias("x")).select("doc_id", "row_key", "spans", "x.t", "x.left", "x.right")
    core = F.regexp_replace(F.col("t.value"), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    lead = F.length(F.regexp_extract("t.value", r"^([^A-Za-z0-9]*)", 1))
    d = d.select("doc_id", "row_key", (F.col("t.start") + lead).alias("start"), (F.col("t.start") + lead + F.length(core)).alias("stop"), core.alias("value"), only(words(F.col("left"))).alias("left"), only(words(F.col("right"))).alias("right"), F.exists("spans", lambda s: (s["start"] < F.col("t.stop")) & (s["stop"] > F.col("t.start"))).alias("seed"))
    return d.where(F.length("value") >= 4)


def bootstrap(tokens: DataFrame, rounds: int = 3, least_seeds: int = 3, confident: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(value, score) of values no seed has, and (pattern, confidence) of the patterns at `confident` or more."""
    sides = F.array(F.concat(F.lit("l:"), F.col("left")), F.concat(F.lit("r:"), F.col("right")))
    edges = tokens.select("value", "seed", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("pattern"))
    edges = written(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = written(tokens.groupBy("value").agg(F.max("seed").alias("seed")).where("seed").select("value"), "pii-seeds")
    others = written(edges.select("pattern", "value").join(seeds, "value", "left_anti"), "pii-others")
    known = edges.join(seeds, "value", "left_semi").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    fresh = others.groupBy("pattern").agg(F.count("*").alias("others"))
    counts = written(known.join(fresh, "pattern", "left").select("pattern", "seeds", F.coalesce("others", F.lit(0)).alias("others")), "pii-patterns")
    others = written(others.join(counts.select("pattern"), "pattern", "left_semi"), "pii-graph")
    scores = None
    for _ in range(rounds):
        gained = counts.withColumn("gained", F.lit(0.0)) if scores is None else counts.join(others.join(scores, "value").groupBy("pattern").agg(F.sum("score").alias("gained")), "pattern", "left").withColumn("gained", F.coalesce("gained", F.lit(0.0)))
        patterns = written(gained.select("pattern", ((F.col("seeds") + F.col("gained")) / (F.col("seeds") + F.col("others"))).alias("confidence")).where(F.col("confidence") >= confident), "pii-scores")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        scores = written(others.join(patterns, "pattern").groupBy("value").agg((1 - doubt).alias("score")), "pii-values")
    return scores, patterns


def find(docs: DataFrame, accept: float = 0.9, **options) -> DataFrame:
    """(doc_id, email, ip, card, phone, id): arrays of (start, stop, value) per row of docs, in order of start.

    Null or empty text: no spans. Rows with one doc_id and one text are found alike; nothing of base is ever dropped.
    """
    spans = base(docs.select("doc_id", "text"))
    tokens = written(instances(spans), "pii-tokens")
    scores, patterns = bootstrap(tokens, **options)
    good = scores.where(F.col("score") >= accept).select("value")
    free = tokens.where(~F.col("seed")).join(good, "value", "left_semi")
    names = F.array(F.concat(F.lit("l:"), F.col("left")), F.concat(F.lit("r:"), F.col("right")))
    placed = free.select("doc_id", "row_key", "start", "stop", "value", F.explode(names).alias("pattern")).join(patterns.select("pattern"), "pattern", "left_semi")
    added = placed.select("doc_id", "row_key", F.struct("start", "stop", "value").alias("s")).distinct().groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list("s")).alias("id"))
    added = added.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "id")
    out = spans.drop("text").join(added, spans["doc_id"].eqNullSafe(added["_d"]) & (F.col("row_key") == F.col("_k")), "left")
    return out.select("doc_id", *KINDS, F.coalesce("id", F.array().cast(SPAN)).alias("id"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op6 contract from the spans of `find`."""
    said = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"], F.lit(":"), s["stop"]))
    whole = F.array_join(F.concat(*map(said, KINDS)), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(whole, 256).alias("base_sha256"), F.array_join(F.concat(*map(said, [*KINDS, "id"])), ",").alias("spans"), F.size("id").cast("long").alias("n_id"))
