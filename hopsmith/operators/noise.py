"""Facts among noise of an exact number of tokens.

All samples share one stream of noise sentences. A sample starts at a sentence of its own and takes the
sentences that follow, from the beginning again after the last, until its budget is full; its last one is cut.
Where sentences stand on the axis of tokens is a running sum over the stream (``numbered``), so a sample is an interval
of that axis and meets its sentences by an equi-join of stretches of ``BLOCK`` tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.functions.vectors import hash_uniform
from hopsmith.operators.numbering import numbered

#: Tokens of the axis that meet by one key.
BLOCK = 4096


def tokens_among_noise(samples: DataFrame, noise: DataFrame, size: Column | int, band: tuple[float, float] | None = None, least: int | None = 10, most: int | None = None, start: Column | None = None, draws: Column | None = None, seed: int = 42, order: str = "_pos") -> DataFrame:
    """(id, n_noise, noise_tokens, fact_positions, tokens) for each of ``samples(id, facts, ...)``, whose facts are lists
    of tokens, with sentences of ``noise(tokens, ...)`` in ``order``.

    ``size``: tokens of a whole sample, facts included; without room there is no noise. ``band``: shares of the size
    between which facts may begin (their own tokens fit in before its end); None: anywhere. ``least`` and ``most``: tokens of a usable sentence. ``start`` (0 to 1:
    where in the stream) and ``draws`` (one such number a fact) default to hashes of the id. ``fact_positions``: before which
    noise sentence each fact stands, in order. A band that no sentence begins in is an error, as is noise without a usable sentence.
    """
    usable = noise.select(F.col(order), "tokens", F.size("tokens").alias("_size")).where(F.col("_size") >= max(1, least or 0))
    usable = usable if most is None else usable.where(F.col("_size") <= most)
    stream = numbered(usable, order, into="_n", sums={"_upto": "_size"})
    stream = stream.select("_n", "tokens", "_size", (F.col("_upto") - F.col("_size")).alias("_begin"))
    count, total = stream.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if not count:
        raise ValueError("no usable noise sentence")
    start = hash_uniform(seed, F.col("id")) if start is None else start
    draws = F.transform("facts", lambda f, i: hash_uniform(seed + 1, F.col("id"), i)) if draws is None else draws
    size = F.lit(size) if isinstance(size, int) else size
    fact_tokens = F.aggregate("facts", F.lit(0), lambda n, f: n + F.size(f))
    asked = samples.select("id", "facts", size.cast("long").alias("_whole"), fact_tokens.cast("long").alias("_facts"), draws.alias("_draws"), F.least(F.floor(start * count), F.lit(count - 1)).alias("_first"))
    asked = asked.withColumn("_need", F.greatest(F.col("_whole") - F.col("_facts"), F.lit(0)))
    starts = stream.select(F.col("_n").alias("_first"), F.col("_begin").alias("_from"))
    wanted = asked.where("_need > 0").select("id", "_first", "_need").join(starts, "_first")
    # rounds of the stream, then stretches of its axis
    laps = wanted.select("id", "_from", "_need", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_from") + F.col("_need") - 1) / total))).alias("_lap"))
    low, high = F.greatest(F.col("_from") - F.col("_lap") * total, F.lit(0)), F.least(F.col("_from") + F.col("_need") - F.col("_lap") * total, F.lit(total))
    laps = laps.select("id", "_from", "_lap", low.alias("_low"), high.alias("_high"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    stretches = laps.withColumn("_block", F.explode(F.sequence(block("_low"), F.floor((F.col("_high") - 1) / BLOCK))))
    met = stretches.join(stream.withColumn("_block", block("_begin")), "_block").where((F.col("_begin") >= F.col("_low")) & (F.col("_begin") < F.col("_high")))
    kept = F.slice("tokens", F.lit(1), F.least(F.col("_size"), F.col("_high") - F.col("_begin")).cast("int"))
    before = F.col("_lap") * total + F.col("_begin") - F.col("_from")
    background = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(before.alias("before"), kept.alias("tokens")))).alias("_noise"))
    empty = F.array().cast("array<struct<before: bigint, tokens: " + dict(usable.dtypes)["tokens"] + ">>")
    rows = asked.join(background, "id", "left").withColumn("_noise", F.coalesce("_noise", empty))
    k = F.size("_noise")
    if band is None:
        possible = F.sequence(F.lit(0), k)
    else:
        begins, ends = F.floor(F.col("_whole") * band[0]), F.floor(F.col("_whole") * band[1]) - F.col("_facts")
        inside = F.transform("_noise", lambda s, i: F.when((s["before"] >= begins) & (s["before"] < ends), i))
        possible = F.filter(inside, lambda i: i.isNotNull())
    rows = rows.withColumn("_possible", possible)
    none = (F.size("_possible") == 0) & (F.size("facts") > 0)
    pick = lambda f, j: F.get("_possible", F.floor(F.get("_draws", j) * F.size("_possible")).cast("int"))
    places = F.when(none, F.raise_error(F.lit("no noise sentence begins in the band")).cast("array<int>")).otherwise(F.array_sort(F.transform("facts", pick)))
    rows = rows.withColumn("fact_positions", places)
    noise_tokens = F.aggregate("_noise", F.lit(0), lambda n, s: n + F.size(s["tokens"]))

    def at(i: Column) -> Column:
        own = F.filter(F.arrays_zip(F.col("fact_positions").alias("p"), F.col("facts").alias("f")), lambda z: z["p"] == i)
        return F.concat(F.flatten(F.transform(own, lambda z: z["f"])), F.coalesce(F.get("_noise", i)["tokens"], F.array().cast(dict(usable.dtypes)["tokens"])))

    return rows.select("id", k.alias("n_noise"), noise_tokens.alias("noise_tokens"), "fact_positions", F.flatten(F.transform(F.sequence(F.lit(0), k), at)).alias("tokens"))
