"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

An element is a shingle of five words (lower case, runs without ASCII white space), its weight how often the text has it.
Element x with weight w is the strip [0, w) of a weight axis, cut in regions [0, 1), [1, 2), [2, 4), ...; into each region
darts are thrown along a rank axis as a Poisson process whose gaps, places and coordinates are hashes of (x, region, n).
A text with total weight W keeps the darts in its strips up to rank t / W, about t in all, and of each of the K coordinates
the earliest. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity
(sum of minima / sum of maxima). Where a coordinate stays empty, the text's ranks are doubled until none is.

Bands of R coordinates propose candidates; every link is confirmed by the exact weighted Jaccard of the whole texts. With
24 bands of 4, a pair at 0.8 is missed with probability 4e-6, and less above. No bucket is joined with itself:

1. Centres. The member of a bucket that meets most texts over all its buckets is the centre; the others are compared with
   it, which makes one pair per member. Members that don't reach it pick a centre of their own, as long as that still links
   many (`rounds`).
2. The rest. What is in different components of one bucket after that goes through an exact prefix and position filter:
   shingles are ordered by how many of these texts hold them, rarest first; two texts at `least` share a shingle
   in the rarest part of both, at places from which enough weight is left for the overlap that they need. Variants of one
   template share only their common shingles, which come last, so that few of their pairs are left to compare.

Shingle sets, not texts, travel to the comparisons: once for each member of a pair and once for each thousand of a centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, removed, small, written

SHINGLE = 5
BANDS, ROWS = 24, 4
K = BANDS * ROWS
DARTS = K * (np.log(K) + 3)
_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)
#: Ids (of 8 bytes, or short strings) up to which those of texts in buckets may be broadcast.
MOST_IDS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.atleast_1d(x) + _G
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their counts, from its word hashes. Under five words: all its words are one shingle."""
    w = words.astype(np.uint64, copy=False)
    n = min(SHINGLE, len(w))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w) - n + 1
    s = np.full(m, n, np.uint64)
    for i in range(n):
        s = mixed(s * _P + w[i : i + m])
    return np.unique(s, return_counts=True)


def darts(x: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc * K + coordinate, rank, dart's hash) of the darts within each element's strip and its text's rank limit."""
    keys, ranks, ids = [], [], []
    region, low, width = 0, 0.0, 1.0
    while len(x):
        seed = mixed(x + np.uint64(region * int(_M) % 2**64))
        at, rank, n = np.arange(len(x)), np.zeros(len(x)), 0
        while len(at):
            h = mixed(seed[at] + np.uint64(n * int(_N) % 2**64))
            rank = rank - np.log(unit(h)) / width
            inside = rank <= reach[at]
            at, rank, h = at[inside], rank[inside], h[inside]
            g = mixed(h)
            hit = low + width * (unit(g) - 2.0**-54) < weight[at]
            keys.append(doc[at[hit]] * K + (mixed(g[hit]) % np.uint64(K)).astype(np.int64))
            ranks.append(rank[hit])
            ids.append(h[hit])
            n += 1
        low, width, region = (low + width), max(1.0, low + width), region + 1
        more = weight > low
        x, weight, doc, reach = x[more], weight[more], doc[more], reach[more]
    return np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(ranks or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0, np.uint64)])


def signatures(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of K hashes for each text, given as (elements, weights); a text without elements gets zeros."""
    out = np.zeros((len(texts), K), np.uint64)
    todo = np.array([i for i, t in enumerate(texts) if len(t[0])], np.int64)
    factor = 1.0
    while len(todo):
        x = np.concatenate([texts[i][0] for i in todo])
        w = np.concatenate([texts[i][1] for i in todo]).astype(np.float64)
        d = np.repeat(np.arange(len(todo)), [len(texts[i][0]) for i in todo])
        total = np.bincount(d, w, len(todo))
        key, rank, ident = darts(x, w, d, (factor * DARTS / total)[d])
        order = np.lexsort((rank, key))
        key, ident = key[order], ident[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        key, ident = key[first], ident[first]
        full = np.bincount(key // K, minlength=len(todo)) == K
        use = full[key // K]
        out[todo[key[use] // K], key[use] % K] = ident[use]
        todo, factor = todo[~full], factor * 2
    return out


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, h, key, bands): h tells a doc_id's texts apart, key the word sequences (128 bits), bands are BANDS hashes, none for a text without words."""
    words = docs.select("doc_id", text_hash(F.col("text")).alias("h"), word_hashes(F.col("text")).alias("w"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                lists = part.column("w")
                flat, cut = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                texts = [flat[cut[i] : cut[i + 1]] for i in range(len(lists))]
                sig = signatures([shingles(t) for t in texts]).reshape(-1, BANDS, ROWS)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
                for r in range(ROWS):
                    h = mixed(h * _P + sig[:, :, r])
                place = [np.arange(1, len(t) + 1, dtype=np.uint64) for t in texts]
                key = [np.array([mixed(t * _G + mixed(p)).sum(), mixed(t * _N + mixed(p + _M)).sum()], np.uint64).tobytes() if len(t) else None for t, p in zip(texts, place, strict=True)]
                bands = [r.view(np.int64) if len(t) else np.zeros(0, np.int64) for r, t in zip(np.ascontiguousarray(h), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "key", "bands"])

    return words.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, key binary, bands array<long>")


#: Members of one centre that are compared in one group of rows.
SHARE = 1000


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, n, s, c) of texts (id, text): a text's shingles, sorted, as 64-bit integers; their counts as 32-bit integers, null if all are 1; n is the sum of counts."""
    words = docs.select("id", word_hashes(F.col("text")).alias("w"))
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                found = [shingles(w.values.to_numpy(zero_copy_only=False).view(np.uint64)) for w in b.column("w")]
                counts = [c.astype(np.int32).tobytes() if len(c) and c.max() > 1 else None for _, c in found]
                columns = [b.column("id"), pa.array([int(c.sum()) for _, c in found], pa.int64()), pa.array([x.tobytes() for x, _ in found], pa.large_binary()).cast(pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s", "c"])

    return words.mapInArrow(cut, f"id {kind}, n long, s binary, c binary")


def _counts(c: bytes | None, n: int) -> np.ndarray:
    return np.ones(n, np.int64) if c is None else np.frombuffer(c, np.int32).astype(np.int64)


def links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard is at least `least`; sets as by `shingle_sets`.

    A centre a comes once per group of about SHARE of its pairs, ahead of them, so that a hot centre is dealt over many tasks.
    """
    kind = sets.schema["id"].dataType.simpleString()
    centres = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")
    asked = pairs.join(centres, "a").select("a", group.alias("g"), F.col("b").alias("id"))
    members = asked.join(sets, "id").select("a", "g", F.col("id").alias("b"), "n", "s", "c")
    ahead = centres.withColumnRenamed("a", "id").join(sets, "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast(kind).alias("b"), "n", "s", "c")
    dealt = members.unionByName(ahead).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa, ca, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            b, n, s, c = (batch.column(x) for x in ("b", "n", "s", "c"))
            for i in range(batch.num_rows):
                sb = np.frombuffer(s[i].as_buffer(), np.uint64)
                cb = _counts(c[i].as_py(), len(sb))
                if not b[i].is_valid:
                    sa, ca, total = sb.copy(), cb, n[i].as_py()
                    continue
                at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
                common = int(np.minimum(ca[at], cb)[sa[at] == sb].sum())
                keep[i] = common >= least * (total + n[i].as_py() - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), b], ["a", "b"]).filter(pa.array(keep))

    return dealt.select("a", "b", "n", "s", "c").mapInArrow(check, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each node's component, for edges (a, b); a written table.

    In a step each node takes the smallest label among itself and its neighbours, then the label of that label.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("lower"))
        new = written(step.join(jump, "low", "left").select("id", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved")), "labels")
        removed(labels)
        labels = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            removed(both)
            return labels


class Labels:
    """The components found so far: (id, label), without rows for texts that no link has yet."""

    def __init__(self):
        self.table: DataFrame | None = None

    def add(self, hits: DataFrame) -> None:
        """Joins the components that the links (a, b) meet. Their labels stand for them, so old links aren't walked again."""
        if not hits.limit(1).count():
            return
        old = self.table
        if old is None:
            self.table = components(hits)
            return
        named = self.of(self.of(hits, "a", "a"), "b", "b").where("a <> b")
        merged = components(named)
        moved = old.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        fresh = merged.join(old.select("id"), "id", "left_anti")
        self.table = written(moved.unionByName(fresh), "labels")
        removed(old), removed(merged)

    def of(self, rows: DataFrame, at: str, name: str) -> DataFrame:
        """rows with the label of column `at` as column `name`; a text without links is its own label."""
        if self.table is None:
            return rows.withColumn(name, F.col(at))
        own = self.table.select(F.col("id").alias("_of"), F.col("label").alias("_label"))
        return rows.join(own, rows[at] == own["_of"], "left").withColumn(name, F.coalesce("_label", at)).drop("_of", "_label")


def _centre_rounds(buckets: DataFrame, sets: DataFrame, labels: Labels, least: float, rounds: int, worth: float) -> None:
    """Compares the members of each bucket (bucket, rep, deg) with its centres, as long as a round links a share `worth` of its pairs."""
    rest = buckets
    for _ in range(rounds):
        named = labels.of(rest, "rep", "label")
        centres = named.groupBy("bucket").agg(F.max(F.struct("deg", "rep", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        centres = centres.select("bucket", F.col("m.rep").alias("centre"), F.col("m.label").alias("centre_label"))
        facing = written(named.join(centres, "bucket").where("label <> centre_label"), "facing")
        pairs = written(facing.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
        hits = written(links(pairs, sets, least), "links")
        asked, found = pairs.count(), hits.count()
        labels.add(hits)
        removed(pairs), removed(hits)
        if rest is not buckets:
            removed(rest)
        if found <= worth * asked:
            removed(facing)
            return
        # who still isn't with the centre goes on
        now = labels.of(labels.of(facing.select("bucket", "rep", "deg", "centre"), "rep", "label"), "centre", "centre_label")
        rest = written(now.where("label <> centre_label").select("bucket", "rep", "deg"), "rest")
        removed(facing)


def prefix_pairs(sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of sets (id, n, s, c) that can reach `least` and whose labels (id, label) differ, by prefixes and positions.

    Shingles are ordered by (texts that hold them, shingle). An entry of a text is a shingle with `rem`, the weight from
    it to the end of the text's order; entries with rem < least * n can't be the first that a pair at `least` shares.
    """
    kind = sets.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column("s")[i].as_buffer(), np.int64)
                c = _counts(batch.column("c")[i].as_py(), len(s))
                ids, n = pa.array([batch.column("id")[i].as_py()] * len(s), batch.column("id").type), pa.array(np.full(len(s), c.sum()))
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(s), pa.array(c)], ["id", "n", "t", "c"])

    tokens = written(sets.mapInArrow(rows, f"id {kind}, n long, t long, c long"), "tokens")
    # a shingle of one text joins nothing and comes first in every order: only its weight counts
    held = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(held, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t", "c"))).alias("x"), F.sum("c").alias("weight"))
    start = F.struct(F.col("weight").alias("rem"), F.array().cast("array<struct<t:long,rem:long>>").alias("out"))
    step = lambda a, x: F.struct((a["rem"] - x["c"]).alias("rem"), F.when(a["rem"] >= F.lit(least) * F.col("n") - 1e-9, F.concat(a["out"], F.array(F.struct(x["t"].alias("t"), a["rem"].alias("rem"))))).otherwise(a["out"]).alias("out"))
    # the lists end within the first tenths of a text's shingles
    most = F.col("weight") - F.lit(least) * F.col("n") + 1
    front = F.slice("x", F.lit(1), F.least(F.size("x"), F.greatest(F.ceil(most), F.lit(0)).cast("int")))
    entries = shared.withColumn("x", front).select("id", "n", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("e")).select("id", "n", "e.t", "e.rem")
    entries = written(entries.join(labels, "id"), "entries")
    removed(tokens)
    reach = lambda rem, n: (1 + least) * rem >= least * n - 1e-9
    bounds = entries.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("rem").alias("top"), F.min("n").alias("short")).where("lo <> hi").drop("lo", "hi")
    live = entries.join(bounds, "t").where(reach(F.least("rem", "top"), F.col("n") + F.col("short"))).select("t", "id", "n", "rem", "label")
    live = written(live, "live")
    mixed_ = live.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("t")
    live = live.join(mixed_, "t", "left_semi")
    other = live.select("t", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rem").alias("rem_b"), F.col("label").alias("label_b"))
    joined = live.withColumnRenamed("id", "a").join(other, "t").where((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & reach(F.least("rem", "rem_b"), F.col("n") + F.col("n_b")))
    out = written(joined.select("a", "b").distinct(), "rest-pairs")
    removed(entries)
    return out


def classes(docs: DataFrame, least: float = 0.8, rounds: int = 6, worth: float = 0.05) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the document's class, a row per doc_id.

    Classes are the connected components of links at `least` or more; texts with the same words in the same order are in
    one class, whatever their case and white space. A text without words (null, empty) is a class of its own. Rows that
    repeat a doc_id are one document: each of its different texts is compared, and all that they link to is one class.
    A null doc_id has no class and no row. Other columns are not read. No rows: no rows.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    signed = written(banded(docs), "bands")
    keyed = signed.where(F.col("key").isNotNull())
    # a word sequence is one node, with a number of its own and the text that has its smallest (doc_id, h) to read it from
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.min_by("bands", F.struct("doc_id", "h")).alias("bands"))
    reps = written(first.select("key", F.monotonically_increasing_id().alias("rep"), F.col("at.doc_id").alias("doc_id"), F.col("at.h").alias("h"), "bands"), "reps")
    places = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(places.join(sizes, "bucket"), "members")
    met = written(members.groupBy("rep").agg(F.sum("size").alias("deg")), "met")
    buckets = written(members.join(met, "rep").select("bucket", "rep", "deg"), "buckets")
    removed(members)
    wanted = written(reps.join(met, "rep", "left_semi").select(F.col("rep").alias("id"), "doc_id", "h"), "wanted")
    involved = docs.withColumn("h", text_hash(F.col("text"))).join(small(wanted, MOST_IDS), ["doc_id", "h"]).select("id", "text").dropDuplicates(["id"])
    sets = written(shingle_sets(involved), "sets")
    labels = Labels()
    # several texts under one doc_id are tied
    tied = keyed.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    numbers = reps.select("key", "rep")
    ties = keyed.join(tied, "doc_id").where("key <> lo").select("lo", "key").distinct().join(numbers, "key").select("lo", F.col("rep").alias("b"))
    labels.add(written(ties.join(numbers, ties["lo"] == numbers["key"]).select(F.col("rep").alias("a"), "b"), "ties"))
    _centre_rounds(buckets, sets, labels, least, rounds, worth)
    named = labels.of(buckets, "rep", "label")
    mixed_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    open_ = written(named.join(mixed_, "bucket", "left_semi").select(F.col("rep").alias("id"), "label").distinct(), "open")
    pairs = prefix_pairs(sets.join(open_.select("id"), "id", "left_semi"), open_, least)
    labels.add(written(links(pairs, sets, least), "links"))
    removed(sets), removed(buckets)
    # labels are numbers of nodes; a class is named by its smallest doc_id
    named = labels.of(reps.select("key", "rep", "doc_id"), "rep", "label")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classed = named.join(smallest, "label").select("key", "class_id")
    out = signed.select("doc_id", "key").join(classed, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is their class's smallest, with the columns of docs; repeated rows of it come once.

    Rows with a null doc_id belong to no class and all stay. Texts without words are classes of their own and stay.
    """
    kept = classes(docs, least).where("doc_id = class_id").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return one.unionByName(docs.where("doc_id IS NULL"))
