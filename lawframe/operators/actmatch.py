"""Acts by a written name: misspelt words put right by shared deletions, whole words of titles, two sources merged.

No name is compared with all titles. A word of a request that no title has meets the titles' words in an equi-join on what
is left of each when some letters are left out; only pairs that share such a rest have their distance taken. A name then
meets the titles in an equi-join on its rarest word. Words, names and hits are read more than once and are written tables in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import osa_distance
from ..session import written

#: Words in most acts' names; a request of these and of numbers names none.
GENERIC = ("a", "act", "acts", "an", "and", "for", "in", "law", "laws", "of", "on", "the", "to")
#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}\p{M}_]+"
#: Letters of a word that is corrected; longer ones, which have too many rests, are taken as they are.
LONGEST = 40


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def edits(word: Column) -> Column:
    """Edits that leave words similar by 0.75 or more, at most 2: none below 4 letters, one below 8."""
    return F.least(F.lit(2), F.floor(F.length(word) / 4)).cast("int")


def without_one(words: Column) -> Column:
    """All words of an array and all that are left of them without one letter."""
    rests = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, rests))))


def rests(words: DataFrame) -> DataFrame:
    """(word, rest): the word without up to `edits` of its letters. At most 1 + n + n (n - 1) / 2 rows for a word of n letters."""
    word = F.array("word")
    some = F.when(edits(F.col("word")) == 0, word).when(edits(F.col("word")) == 1, without_one(word)).otherwise(without_one(without_one(word)))
    return words.select("word", F.explode(some).alias("rest"))


def corrections(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right, distance): for words of `unknown` (word) the nearest of `known` (word, n), then that with the largest n, then by text.

    Distance counts letters put in, left out, changed, and neighbours swapped. A pair must be within `edits` of both words,
    so that its similarity, by the longer one, is 0.75 or more. Two words within d edits always share a rest without
    d letters, so none is missed; words without a near one have no row.
    """
    asked = unknown.select("word").distinct().where((edits(F.col("word")) > 0) & (F.length("word") <= LONGEST))
    vocabulary = known.where(F.length("word") <= LONGEST)
    right = rests(vocabulary.select("word").distinct()).select(F.col("word").alias("right"), "rest")
    pairs = rests(asked).join(right, "rest").select("word", "right").distinct()
    # a swap is two edits of the built-in distance, which drops most pairs before the exact one
    bound = F.least(edits(F.col("word")), edits(F.col("right")))
    near = pairs.where(F.levenshtein("word", "right") <= 2 * bound).withColumn("distance", osa_distance("word", "right")).where(F.col("distance") <= bound)
    counted = known.groupBy("word").agg(F.sum("n").alias("n")).withColumnRenamed("word", "right")
    best = near.join(counted, "right").groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("rarity"), "right")).alias("m"))
    return best.select("word", "m.right", "m.distance")


def scores(needle: Column, title: Column) -> Column:
    """How a name (lower case) meets a title: 0 it is it, 1 its first words, 2 whole words in it, 3 a part that cuts a word, 4 not at all."""
    text = F.lower(F.trim(title))
    edge = F.concat(F.lit(r"(?<![\p{L}\p{N}\p{M}_])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}\p{M}_])"))
    first = F.regexp_instr(text, edge)
    return F.when(text == needle, 0).when(first == 1, 1).when(first > 1, 2).when(F.contains(text, needle), 3).otherwise(4)


def matches(requests: DataFrame, comps: DataFrame, laws: DataFrame, limit: int = 5) -> DataFrame:
    """(request, needle, place, score, source, id, title): up to `limit` acts for each distinct request, best first.

    requests (request); comps (id, prefix, title, titles, partial, law_id), laws (id, titles); titles are arrays of names, and
    ids are numbers. Blanks and quotes around a request go; words that no title has are corrected, and where that changes
    it the needle is the words with one blank between them. A title counts if it has the needle's words whole (score 2 or
    less). Of comps of one prefix the best stands: by score, files of whole acts (partial is null) before others, title,
    id; then come laws that no listed comp is of, by score and id; comps go first on a tie. Requests of generic words and
    numbers only, or without words, have no rows. Null titles and ids say nothing.
    """
    generic = lambda w: w.isin(*GENERIC) | w.rlike(r"^\p{Nd}+$")
    asked = requests.select("request").distinct().withColumn("plain", F.trim(F.regexp_replace(F.trim("request"), "^['\"]+|['\"]+$", "")))
    asked = asked.withColumn("words", words_of(F.col("plain"))).where(F.exists("words", lambda w: ~generic(w)))
    named = comps.where("id IS NOT NULL").select(F.lit("comp").alias("source"), "id", F.explode(F.concat(F.array("title"), F.coalesce("titles", F.array().cast("array<string>")))).alias("t"))
    named = named.unionByName(laws.where("id IS NOT NULL").select(F.lit("law").alias("source"), "id", F.explode("titles").alias("t"))).where("t IS NOT NULL").distinct()
    # each distinct title is searched once, however many acts bear it
    titles = named.groupBy("t").agg(F.count("*").alias("n"))
    known = written(titles.select("t", "n", F.explode(F.array_distinct(words_of(F.col("t")))).alias("word")), "title_words")
    vocabulary = written(known.groupBy("word").agg(F.sum("n").alias("n")), "title_vocabulary")

    parts = asked.select("request", "plain", F.posexplode("words").alias("i", "word"))
    missing = parts.select("word").distinct().join(vocabulary, "word", "left_anti")
    right = corrections(missing, vocabulary)
    read = parts.join(right, "word", "left").withColumn("now", F.coalesce("right", "word")).join(vocabulary.select(F.col("word").alias("now"), "n"), "now", "left")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "now"))), lambda x: x["now"]), " ")
    # a word that no title has makes the request vain: its n is 0 and it meets nothing
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "now"))
    needles = read.groupBy("request", "plain").agg(F.count("right").alias("mended"), words.alias("mend"), rarest["now"].alias("word"))
    needles = written(needles.select("request", F.when(F.col("mended") > 0, F.col("mend")).otherwise(F.lower("plain")).alias("needle"), "word"), "needles")
    asked_words = needles.select("needle", "word").distinct()
    hits = asked_words.join(known.select("word", "t"), "word").withColumn("score", scores(F.col("needle"), F.col("t"))).where("score <= 2").select("needle", "t", "score")

    of = written(hits.join(named, "t").groupBy("needle", "source", "id").agg(F.min("score").alias("score")), "title_hits")
    facts = comps.select("id", "prefix", "title", F.col("partial").isNotNull().alias("part"), "law_id")
    place = F.struct("score", "part", F.lower(F.coalesce("title", F.lit(""))).alias("sort"), "id", "title", "law_id")
    per_prefix = of.where("source = 'comp'").join(facts, "id").groupBy("needle", "prefix").agg(F.min(place).alias("c"))
    best = _first(per_prefix, "c", limit)
    listed = best.select("needle", F.lit(0).alias("after"), "c.score", F.col("k"), F.lit("comp").alias("source"), "c.id", "c.title", "c.law_id")
    listed = written(listed, "listed_comps")
    taken = listed.where("law_id IS NOT NULL").select("needle", F.col("law_id").alias("id")).distinct()
    law_hits = of.where("source = 'law'").join(taken, ["needle", "id"], "left_anti").select("needle", F.struct("score", "id").alias("c"))
    first_laws = _first(law_hits, "c", limit).select("needle", "c.score", "k", "c.id")
    law_titles = laws.groupBy("id").agg(F.min(F.get("titles", F.lit(0))).alias("title"))
    others = first_laws.join(law_titles, "id").select("needle", F.lit(1).alias("after"), "score", "k", F.lit("law").alias("source"), "id", "title")
    both = listed.drop("law_id").unionByName(others)
    w = Window.partitionBy("needle").orderBy("score", "after", "k")  # at most 2 limit rows
    final = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return needles.select("request", "needle").join(final, "needle").select("request", "needle", "place", "score", "source", "id", "title")


def _first(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first `limit` of each needle with their place `k`; Spark keeps that many per task before it shuffles."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("needle").orderBy(order))).where(F.col("k") <= limit)
