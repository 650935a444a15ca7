"""One document of each group of near duplicates, nominated by SimHash and a prefix filter.

First, SimHash fingerprints of the shingle sets go through the byte-position index with
count filtering (``simhash.links``), and pairs that it retains (at most ``BITS`` bits) are verified by
their Jaccard similarity. No number of bits guarantees a similarity, so a prefix filter,
which misses none, completes this.

Pairs are those whose sets of ``words``-word shingles have a Jaccard similarity of at least
``similarity``. All shingles have one order, the same in every text; two sets of that
similarity t share one of the first n - ceil(t n) + 1 shingles of each, so these are a text's
postings and no pair is missed. Of a pair's first common shingle, at positions i and j of n
and n', it is also known that at most min(n - i, n' - j) are in common: pairs for which that
isn't enough don't meet there. The order is by the number of sampled texts that hold a shingle,
then by its hash; the sample decides how long postings get, not what is found.

Of two sets the shorter one has its first common shingle among fewer of its own, the first
n - ceil(2 t n / (1 + t)) + 1 (no longer set can share enough with it otherwise): these lead, and a pair meets only where its
shorter set leads. Postings that nobody leads are dropped, so texts that share a template, but each begin their order with
several shingles of their own, don't meet at all.

No posting's pairs are all made. First every text meets, beside those that SimHash nominates,
one other, the smallest of the first members of its postings. Members that this (and what it connects) hasn't joined to
the largest component in a posting then meet the rest of it, but for pairs that the
positions rule out. Two members that aren't compared are connected already or known to be
apart.

Before texts are read again, and in the join of a posting's members itself, pairs are looked at by parities: 1,024 bits a set, each the parity
of its shingles in one part of the hash range. Bits that differ between two sets are at most as
many as the shingles in one of them only, so pairs with more than ``similarity`` allows are known to be apart.

Texts of equal words are one node. Defined cases: null and wordless texts are equal to
each other; texts of fewer than ``words`` words are one shingle; rows with null
``doc_id`` stay; of rows that repeat the ``doc_id`` that stays, one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.llm import simhash
from hopsmith.llm.common import bounded_fraction, connected_components, discard, hash_sampled, map_arrow, utf8_list, written

#: Keeps divisions from ruling out a pair at the limit.
SLACK = 1e-9
PARITIES = [f"p{i}" for i in range(16)]
#: Fingerprints that differ in at most so many bits are nominated.
BITS = 2
#: Members of postings whose pairs meet without a look at their parities.
FEW = 16
#: Bits of the bitmap that picks texts to verify: 4 MB.
BITMAP = 1 << 25


def _same(text: bytes) -> bytes:
    return xxhash.xxh128_digest(b" ".join(text.lower().split()))


def _keys(docs: DataFrame) -> DataFrame:
    """(doc_id, same): a hash of the words in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = list(map(_same, utf8_list(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.binary())], ["doc_id", "same"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), run, "doc_id long, same binary")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    parts = text.lower().split()
    spans = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(0)), np.uint64, len(spans)).view(np.int64))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [shingle_set(text, words) for text in utf8_list(batch.column("text"))]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows or [np.empty(0, np.int64)])))], ["node", "shingles"])

    return map_arrow(texts.select("node", "text"), run, "node long, shingles array<long>")


def _common(texts: DataFrame, words: int, share: float = 0.1, least: int = 5000, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample hold (sorted), and how many hold each.

    The sample is a ``share`` of the texts, ``least`` at least, so that how long the postings of a
    shingle that it doesn't hold get does not grow with the corpus. Only the ``most`` frequent shingles are broadcast.
    """
    some = hash_sampled(texts, F.col("node"), max(share, bounded_fraction(texts.select("node"), least)))
    counted = _shingles(some, words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "s").limit(most).toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Those of a sorted set that a set of ``similarity`` must share one of, rare ones first."""
    known, times = common
    held = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        held = np.where(known[at] == shingles, times[at], 0)
    n = len(shingles)
    return shingles[np.argsort(held, kind="stable")[: n - int(np.ceil(similarity * n - SLACK)) + 1]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Sixteen words of the parities by the first ten bits of the hash."""
    part = (shingles.view(np.uint64) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=1024) & 1).view(np.int64)


def _sets(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, same, n, keys, fp, p0 ...): a hash of the words, and of the set of shingles its size, prefix, SimHash and parities."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                raw = utf8_list(batch.column("text"))
                sets = [shingle_set(text, words) for text in raw]
                keys = [prefix(s, shared.value, similarity) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys or [np.empty(0, np.int64)])))
                bits = np.array([parities(s) for s in sets], np.int64).reshape(-1, len(PARITIES))
                fps = np.array([simhash.majority_bits(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)
                columns = [batch.column("node"), pa.array(list(map(_same, raw)), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array(fps), *map(pa.array, bits.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "same", "n", "keys", "fp", *PARITIES])

    return map_arrow(texts.select("node", "text"), run, "node long, same binary, n int, keys array<long>, fp long, " + ", ".join(f"{p} long" for p in PARITIES))


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every non-null ``doc_id`` of ``docs(doc_id, text)``."""
    keys = written(_keys(docs), "keys")
    same = written(keys.groupBy("same").agg(F.min("doc_id").alias("node")), "same")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL")
    if _repeats(docs):
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    alike = [F.first(c).alias(c) for c in ("n", "keys", "fp", *PARITIES)]  # of equal words
    nodes = written(_sets(texts, words, similarity).groupBy("same").agg(F.min("node").alias("node"), *alike).drop("same"), "nodes")
    # the shorter set of a pair has its first common key among so many of its own
    lead = F.col("at") < F.col("n") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n") - F.lit(SLACK)) + 1
    # place and size travel as one number
    spot = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("spot")
    postings = nodes.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", spot)
    in_key = Window.partitionBy("key")
    met = postings.withColumn("first", F.min(F.struct("node", "spot")).over(in_key)).withColumn("members", F.count("*").over(in_key)).where("members > 1")

    def at_n(spot: str, *names: str):
        return F.col(spot).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias(names[0]), F.shiftright(spot, 32).cast("int").alias(names[1])

    met = met.select("key", "node", *at_n("spot", "at", "n"), "members", F.struct("first.node", *at_n("first.spot", "at", "n")).alias("first"))
    met = written(met.withColumn("lead", lead).withColumn("led", F.max("lead").over(in_key)).where("led").drop("led"), "met")

    def reach(at, n, other_at, other_n):
        both = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
        return both / (F.col(n) + F.col(other_n) - both) >= similarity - SLACK

    def may_agree(one: str, two: str):
        """Parities differ in at most as many bits as sets that are similar enough."""
        differ = sum((F.bit_count(F.col(f"{one}_{p}").bitwiseXOR(F.col(f"{two}_{p}"))) for p in PARITIES), F.lit(0))
        return differ <= (F.col(f"{one}_n") + F.col(f"{two}_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6

    first_met = met.where("node <> first.node").where(reach("at", "n", "first.at", "first.n")).groupBy(F.col("node").alias("b")).agg(F.min("first.node").alias("a")).select("a", "b")
    of_fp = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    by_simhash = simhash.links(of_fp, BITS).toDF("a", "b")
    same_fp = nodes.select("fp", F.col("node").alias("b")).join(of_fp, "fp").where("node < b").select(F.col("node").alias("a"), "b")
    leads = by_simhash.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same_fp).unionByName(first_met).distinct()
    leads = written(leads, "leads")

    used: list[DataFrame] = []  # tables that verifying has written

    def verified(pairs: DataFrame) -> DataFrame:
        sketches = nodes.select("node", "n", *PARITIES)
        one, two = (sketches.toDF(side, *[f"{side}_{c}" for c in ("n", *PARITIES)]).hint("merge") for side in "ab")
        pairs = written(pairs.join(one, "a").join(two, "b").where(may_agree("a", "b")).select("a", "b"), "pairs")
        used.append(pairs)
        members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        members = written(members, "members")
        used.append(members)
        shingles = written(_shingles(_mostly_of(texts, members).join(members.hint("merge"), "node"), words), "shingles")
        used.append(shingles)
        one, two = shingles.toDF("a", "sa"), shingles.toDF("b", "sb")
        both = F.size(F.array_intersect("sa", "sb"))
        jaccard = both / (F.size("sa") + F.size("sb") - both)
        return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(jaccard >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    first = written(verified(leads), "first")
    discard(*used)
    used.clear()
    linked = connected_components(first)
    placed = met.select("key", "node", "at", "n", "lead", "members").join(linked, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
    # dealt by posting once, for both windows below
    placed = placed.repartition("key")
    # a posting's head is the component that most of its members are in
    placed = placed.withColumn("size", F.count("*").over(Window.partitionBy("key", "own")))
    placed = placed.withColumn("head", F.max(F.struct("size", "own")).over(in_key)["own"]).drop("size")
    # postings that have a member apart
    placed = placed.withColumn("open", F.count_if(F.col("own") != F.col("head")).over(in_key))
    placed = written(placed.where("open > 0").drop("open"), "placed")
    def meetings(rows: DataFrame, *sketch: str) -> DataFrame:
        """Members apart meet the rest; the shorter set of a pair (of equal ones the smaller node) is at one of its leading keys."""
        told = ("node", "own", "at", "n", *sketch)
        named = lambda rows, side: rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in told])
        can_be = (F.col("m_own") != F.col("k_own")) & reach("m_at", "m_n", "k_at", "k_n")
        if sketch:
            can_be &= may_agree("m", "k")
        is_shorter = F.struct("m_n", "m_node") < F.struct("k_n", "k_node")
        apart, head = rows.where("own <> head"), rows.where("own = head")
        led = named(apart.where("lead"), "m").join(named(rows, "k").hint("merge"), "key").where(is_shorter & can_be)
        leading = named(apart, "m").join(named(head.where("lead"), "k").hint("merge"), "key").where(~is_shorter & can_be)
        return led.unionByName(leading).select(F.least("m_node", "k_node").alias("a"), F.greatest("m_node", "k_node").alias("b"))

    # members of long postings bring their parities, so that the join itself leaves out pairs that are known to be apart
    long = placed.where(F.col("members") > FEW).join(nodes.select("node", *PARITIES).hint("merge"), "node")
    rest = meetings(placed.where(F.col("members") <= FEW)).unionByName(meetings(long, *PARITIES)).distinct()
    rest = rest.join(leads.hint("merge"), ["a", "b"], "left_anti")
    checked = written(verified(rest), "rest")
    discard(*used, nodes, of_fp, met, leads, linked, placed)
    found = first.unionByName(checked)
    # rows of one doc_id with different words are one document
    ties = keys.join(same, "same").where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    component = connected_components(found.unionByName(ties))
    discard(first, checked, same)
    return keys.select("doc_id").distinct().join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def _mostly_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``node`` is in ``members``, and some others, without a shuffle
    of the texts: nodes are looked up in a bitmap of ``BITMAP`` bits by their hash. Its size,
    that of the broadcast, is fixed; when it fills up, more rows come through."""

    def slot():
        return F.pmod(F.xxhash64("node"), F.lit(BITMAP)) + 1

    bitmap = members.select(slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.bitmap_bit_position(slot()) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("getbit(_byte, _bit)") == 1
    looked_up = texts.withColumn("bucket", F.bitmap_bucket_number(slot())).join(F.broadcast(bitmap), "bucket")
    looked_up = looked_up.withColumn("_byte", byte).withColumn("_bit", (F.bitmap_bit_position(slot()) % 8).cast("int"))
    return looked_up.where(is_set).select("node", "text")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its group."""
    name = "_gone"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    gone = groups(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    if not _repeats(docs):
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
