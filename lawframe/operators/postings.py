"""Search on a positional index: a row per (document, field, term) with the term's positions.

`indexed` makes the rows, `saved` writes them in ranges of terms, so that a search reads the files of its terms only (the
terms' predicates reach the scan). A search is one plan: rows of its terms; phrases as windows over gaps between
positions; per document the atoms it holds, on which the boolean tree is one expression; scores of the best field.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import searchquery
from .searchquery import Atom, Search, Tree

TERM = r"[\p{L}\p{N}]+"
# Weights of the fields.
WEIGHTS = {"short_titles": 10.0, "official_title": 4.0, "heading": 2.0, "text": 1.0}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """rows: (key, field, length, term, positions); stats: (field, n, mean): documents with terms in the field, and their mean length."""

    rows: DataFrame
    stats: DataFrame
    key: str


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"))


def indexed(docs: DataFrame, key: str, fields: dict[str, Column]) -> Index:
    """The index of documents with distinct keys; null and empty fields have no rows."""
    each = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms_of(c).alias("terms")) for f, c in fields.items()))).alias("f"))
    each = each.select(key, "f.field", F.size("f.terms").alias("length"), "f.terms").where("length > 0")
    places = each.select(key, "field", "length", F.posexplode("terms").alias("place", "term"))
    rows = places.groupBy(key, "field", "length", "term").agg(F.array_sort(F.collect_list("place")).alias("positions"))
    return Index(rows, each.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean")), key)


def saved(index: Index, path: str, files: int) -> None:
    """Writes an index, sorted by term over `files` files; a frequent term is spread over several."""
    index.rows.repartitionByRange(files, "term", index.key).sortWithinPartitions("term", index.key).write.parquet(f"{path}/rows")
    index.stats.write.parquet(f"{path}/stats")


def opened(spark: SparkSession, path: str, key: str) -> Index:
    return Index(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/stats"), key)


def term_test(atom: Atom) -> Column:
    """Whether a row is of a term that the atom asks for."""
    term, words = F.col("term"), atom.words
    if atom.kind == "prefix":
        said = term.startswith(words[0])
    elif atom.kind == "near":
        said = F.length(term).between(len(words[0]) - atom.most, len(words[0]) + atom.most) & (F.levenshtein(term, F.lit(words[0]), atom.most) >= 0)
    else:
        said = term.isin(*set(words))
    return said & (F.col("field") == atom.within) if atom.within else said


def phrase_rows(index: Index, phrases: dict[int, Atom]) -> DataFrame:
    """(key, field, length, atom, tf): how often the words of each phrase stand together in a field.

    A word's place less its place in the phrase is the same for all words of an exact phrase. Words stand together but
    for `most` moves if these differences lie within `most` of each other and each word has a place of its own. Counted
    is every smallest difference of such a set.
    """
    asked = F.array(*(F.struct(F.lit(a).alias("atom"), F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(p.within).cast("string").alias("f")) for a, p in phrases.items() for i, w in enumerate(p.words)))
    rows = index.rows.where(reduce(Column.__or__, map(term_test, phrases.values())))
    rows = rows.select(index.key, "field", "length", "positions", F.explode(F.filter(asked, lambda x: (x["w"] == F.col("term")) & F.coalesce(x["f"] == F.col("field"), F.lit(True)))).alias("x"))
    rows = rows.select(index.key, "field", "length", "x.atom", "x.i", F.explode("positions").alias("place")).withColumn("gap", F.col("place") - F.col("i"))
    out = []
    for most in sorted({p.most for p in phrases.values()}):
        w = Window.partitionBy(index.key, "field", "length", "atom").orderBy("gap").rangeBetween(0, most)
        mine = {a: p for a, p in phrases.items() if p.most == most}
        near = rows.where(F.col("atom").isin(*mine)).withColumn("near", F.collect_set(F.struct("i", "place")).over(w))
        tests = F.lit(False)
        for a, p in mine.items():
            tests = tests | ((F.col("atom") == a) & placed(p.words))
        out.append(near.where(tests).groupBy(index.key, "field", "length", "atom").agg(F.countDistinct("gap").alias("tf")))
    return reduce(DataFrame.unionByName, out)


def placed(words: tuple[str, ...]) -> Column:
    """The row's word stands at its place and each other word of the phrase at one of its own in `near`.

    A word's places for its repeats in a phrase are runs of a line, so it is enough that any neighbouring repeats have as many places as they are.
    """

    def places(of: list[int]) -> Column:
        free = F.filter("near", lambda x: x["i"].isin(*of) & (x["place"] != F.col("place")))
        return F.size(F.array_distinct(F.transform(free, lambda x: x["place"]))) >= len(of)

    def others(k: int) -> Column:
        spots = [[i for i, x in enumerate(words) if x == w and i != k] for w in dict.fromkeys(words)]
        return reduce(Column.__and__, [places(s[a:b]) for s in spots for a in range(len(s)) for b in range(a + 1, len(s) + 1)])

    return reduce(Column.__or__, [(F.col("i") == k) & others(k) for k in range(len(words))])


def atom_rows(index: Index, atoms: list[Atom]) -> DataFrame:
    """(key, field, length, atom, tf): where each atom stands."""
    single, phrases = {a: x for a, x in enumerate(atoms) if x.kind != "phrase"}, {a: x for a, x in enumerate(atoms) if x.kind == "phrase"}
    out = []
    if single:
        rows = index.rows.where(reduce(Column.__or__, map(term_test, single.values())))
        met = F.filter(F.array(*(F.when(term_test(x), F.lit(a)) for a, x in single.items())), lambda x: x.isNotNull())
        out.append(rows.select(index.key, "field", "length", F.explode(met).alias("atom"), F.size("positions").cast("long").alias("tf")))
    if phrases:
        out.append(phrase_rows(index, phrases))
    return reduce(DataFrame.unionByName, out)


def rarity(index: Index, atoms: list[Atom]) -> DataFrame:
    """(field, atom, idf, mean): summed over an atom's words; a row per field and atom that is a word or a phrase."""
    words = {(a, w) for a, x in enumerate(atoms) if x.kind in ("word", "phrase") for w in x.words}
    asked = index.rows.sparkSession.createDataFrame(sorted(words), "atom int, term string")
    df = index.rows.where(F.col("term").isin(*{w for _, w in words})).groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(asked), "term").join(F.broadcast(index.stats), "field").groupBy("field", "atom").agg(F.sum(idf).alias("idf"), F.first("mean").alias("mean"))


def condition(tree: Tree, held: Column) -> Column:
    if tree.op == "atom":
        return F.array_contains(held, tree.at)
    below = [condition(t, held) for t in tree.below]
    return ~below[0] if tree.op == "not" else reduce(Column.__and__ if tree.op == "and" else Column.__or__, below)


def hits(index: Index, search: Search, keys: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, score) of the documents that the search's text and headings ask for; keys: all documents, read only where a search matches those without any of its words.

    An atom counts with its best field: BM25 there times the field's weight (a prefix or near word: the weight alone), and
    a phrase that isn't needed with its boost in place of the weight. Without text and headings all match, with score 0.
    """
    tree, atoms = searchquery.plan(search)
    key = index.key
    if tree is None:
        return keys.select(key, F.lit(0.0).alias("score"))
    count = searchquery.needed(tree) | {a for a, x in enumerate(atoms) if x.boost is not None}
    steady = [a for a, x in enumerate(atoms) if x.kind in ("prefix", "near")]
    rows = atom_rows(index, atoms)
    if len(steady) < len(atoms):  # fields x atoms rows
        rows = rows.join(F.broadcast(rarity(index, atoms)), ["field", "atom"], "left")
    else:
        rows = rows.withColumns({"idf": F.lit(None).cast("double"), "mean": F.lit(None).cast("double")})
    tf = F.col("tf")
    bm25 = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()), F.lit(1.0))
    for a, x in enumerate(atoms):
        weight = F.when(F.col("atom") == a, F.lit(x.boost)).otherwise(weight) if x.boost is not None else weight
    part = F.when(F.col("atom").isin(*steady), F.lit(1.0)).otherwise(bm25) * weight if steady else bm25 * weight
    best = rows.groupBy(key, "atom").agg(F.max(part).alias("part"))
    docs = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("atom", "part"))).alias("held"))
    if searchquery.holds(tree, lambda _: False):
        docs = keys.select(key).join(docs, key, "left")
    held = F.coalesce("held", F.array().cast("array<struct<atom:int,part:double>>"))
    docs = docs.where(condition(tree, F.transform(held, lambda x: x["atom"])))
    return docs.select(key, F.aggregate(F.filter(held, lambda x: x["atom"].isin(*count)), F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def found(index: Index, docs: DataFrame, search: Search, scopes: dict[str, Column], asked_view: str | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """docs' rows that the search asks for, with `score`. scopes: the column of each scope word, `view` too; any value of a scope, all scopes."""
    d = docs
    for scope, values in search.values().items():
        d = d.where(scopes[scope].cast("string").isin(*values))
    view = searchquery.view_of(search, asked_view)
    if view != "all":
        d = d.where(scopes["view"] == view)
    return d.join(hits(index, search, docs, weights), index.key)


def ranked(rows: DataFrame, key: str, by: Column | None = None, descending: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows with `place`, from 1: by a column, its nulls last, or by score alone; then by score, then by key."""
    first = [] if by is None else [by.desc_nulls_last() if descending else by.asc_nulls_last()]
    order = [*first, F.desc("score"), F.col(key)]
    page = rows.orderBy(*order).limit(offset + limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def facets(rows: DataFrame, names: list[str], most: int = 30) -> DataFrame:
    """(facet, value, n): the commonest values of each column over all rows, ties by value."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in names))).alias("p")).select("p.*").where("value IS NOT NULL")
    counted = pairs.groupBy("facet", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def fragments(text: Column, tests: str, chars: int = 220, most: int = 2) -> Column:
    """Up to `most` pieces of a text that hold a hit, those with most hits first, then in order, with <em> around each hit.

    The whole text is cut between words into pieces of at most `chars`; tests: a regular expression of the hits, one group.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([\s\S]{{1,{chars}}}(?:\s|\z)|[\s\S]{{1,{chars}}})"))
    counted = F.transform(pieces, lambda p, i: F.struct((-F.regexp_count(p, F.lit(tests))).alias("n"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(F.filter(counted, lambda c: c["n"] < 0)), 1, most)
    return F.transform(best, lambda c: F.regexp_replace(F.trim(c["p"]), tests, "<em>$1</em>"))


def hit_test(atoms: list[Atom]) -> str:
    """A regular expression of the words, prefixes and phrases' words of a search, for `fragments`."""
    whole = sorted({w for x in atoms if x.kind in ("word", "phrase", "near") for w in x.words}, key=len, reverse=True)
    starts = sorted({x.words[0] for x in atoms if x.kind == "prefix"})
    return r"(?i)(?<![\p{L}\p{N}])((?:" + "|".join([*whole, *(rf"{p}[\p{{L}}\p{{N}}]*" for p in starts)]) + r"))(?![\p{L}\p{N}])"


