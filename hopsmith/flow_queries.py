"""Named queries that go through files, streams and stores which they fill from the driver's
tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopsmith import backends
from hopsmith.functions import vectors
from hopsmith.operators import aggregates, blocks, noise, numbering
from hopsmith.plans import calls
from hopsmith.queries import _STEPS, query, table
from hopsmith.session import scratch
from hopsmith.sources import arrays, writers
from hopsmith.sources.keyed import KeyedTable
from hopsmith.streaming import steps as stepping
from hopsmith.streaming import tail


def _drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into a table; started again, it goes on."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query("SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def json_array_ranges(spark, sf_dir):
    """Documents as arrays of objects in files, read back by byte ranges."""
    path = scratch(spark, "arrays")
    writers.json_arrays(table(spark, sf_dir, "documents").where("text IS NOT NULL"), path)
    back = arrays.json_array(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))


@query("""
SELECT event_type AS feedback, count(*) AS n, round(avg(round(value, 2)), 6) AS mean, round(min(round(value, 2)), 6) AS min, round(max(round(value, 2)), 6) AS max
FROM events WHERE value >= 0 GROUP BY event_type
""")  # fmt: skip
def tailed_timing(spark, sf_dir):
    """Timing lines of all events from growing logs: a stream reads the first bytes of each file,
    stops, and starts again where it was."""
    folder, out, checkpoint = (scratch(spark, name) for name in ("logs", "lines", "offsets"))
    e = table(spark, sf_dir, "events").where("value >= 0")
    spent = F.round("value", 2).cast("decimal(18,2)").cast("string")
    e.select(F.concat(F.lit("log reward_ms="), spent, F.lit(" feedback="), "event_type", F.lit(" is_final=True reward=1.0"))).write.text(folder)
    for until in (50_000, None):
        _drained(tail.lines(spark, folder, "part-*", range_bytes=1 << 20, until=until), out, checkpoint)
    rows = aggregates.timing_summary(aggregates.timing_rows(spark.read.parquet(out).select("value", F.col("offset").alias("_pos"))))
    return rows.select("feedback", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query(_STEPS + """,
e AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY env_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM s)
SELECT env_id, CAST(episode AS BIGINT) AS episode, round(sum(reward), 4) AS episodic_return, count(*) AS n_steps,
  count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase', 'view')) AS n_found,
  round(0.1 * count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase', 'view')) + CASE WHEN count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase', 'view')) = 3 THEN 1 ELSE 0 END, 4) AS fact_return, CAST(0 AS BIGINT) AS lost
FROM e GROUP BY 1, 2 HAVING bool_or(done)
""")  # fmt: skip
def streamed_episodes(spark, sf_dir):
    """Finished episodes of the steps, which come in no order, some twice, to a stream that is
    stopped and started again."""
    e = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("env_id"), number.alias("step"), F.col("value").alias("reward"), F.col("event_type").alias("fact"), (F.col("event_type") == "purchase").alias("done"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("env_id", "step"), F.lit(2)))
    rows = rows.unionByName(rows.where("step % 7 = 0").withColumn("part", F.lit(1)))
    folder, out, checkpoint = (scratch(spark, name) for name in ("steps", "episodes", "state"))
    with stepping.keyed_state(spark):
        for part in (0, 1):
            rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
            stream = spark.readStream.schema(rows.drop("part").schema).parquet(folder)
            # steps come in no order of time: none is late, and no gap is given up
            _drained(stepping.episodes(stream, ["click", "purchase", "view"], patience_ms=1 << 50, late="36500 days"), out, checkpoint)
    done = spark.read.parquet(out)
    return done.select("env_id", "episode", F.round("episodic_return", 4).alias("episodic_return"), "n_steps", "n_found", F.round("fact_return", 4).alias("fact_return"), "lost")


# --- order without a single task --------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, r, CAST(sum(l_quantity) OVER (ORDER BY r) AS DOUBLE) AS quantity, count(*) OVER () AS n FROM (
  SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS r FROM lineitem)
""")
def numbered_lines(spark, sf_dir):
    """Every line's place by price, and the quantity sold up to it."""
    l = table(spark, sf_dir, "lineitem")
    rows = numbering.numbered(l, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", into="r", sums={"quantity": "l_quantity"}, total="n")
    return rows.select("l_orderkey", "l_linenumber", "r", "quantity", "n")


# --- calls and stores --------------------------------------------------------


@query("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n_tokens, CAST(NULL AS VARCHAR) AS error FROM conversations")
def resumed_calls(spark, sf_dir):
    """Every turn is tokenised by the stub; the run stops after two rounds of four and is started again."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    path = scratch(spark, "calls")

    def ask(backend: backends.StubBackend, row: dict) -> int:
        return len(backend.tokenize([row["text"]])[0])

    for stop in (2, None):
        told = calls.resumable(turns, "id", path, "n_tokens", "bigint", backends.StubBackend, ask, rounds=4, stop_after=stop)
    return turns.join(told, "id").select("conv_id", "turn", "n_tokens", "error")


@query("""
SELECT 1 AS version, c_custkey, c_acctbal, 'old' AS said FROM customer
UNION ALL SELECT 5, c_custkey, CASE WHEN c_acctbal > 0 THEN -c_acctbal ELSE c_acctbal END, CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END FROM customer WHERE c_nationkey <> 3
""")
def keyed_results(spark, sf_dir):
    """A keyed table after an insert, an upsert, a delete, a compaction and one more upsert;
    its first version and its last."""
    c = table(spark, sf_dir, "customer")
    store = KeyedTable(spark, scratch(spark, "keyed"), "c_custkey", "c_custkey bigint, c_acctbal double, said string")
    store.upsert(c.select("c_custkey", "c_acctbal", F.lit("old").alias("said")))
    better = c.where("c_acctbal > 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit("new").alias("said"))
    store.upsert(better.withColumn("said", F.lit("between")))
    store.delete(c.where("c_nationkey = 3"))
    store.compact()
    store.upsert(better.join(c.where("c_nationkey <> 3").select("c_custkey"), "c_custkey"))
    read = lambda version: store.read(version).select(F.lit(version).alias("version"), "c_custkey", "c_acctbal", "said")
    return read(1).unionByName(read(5))


# --- tokens --------------------------------------------------------------------

_NOISE = """
WITH n0 AS (
  SELECT conv_id * 1000 + turn AS p, list_filter(string_split(text, ' '), lambda w: w <> '') AS t FROM conversations
), n AS (SELECT p, t, len(t) AS k, row_number() OVER (ORDER BY p) - 1 AS i, sum(len(t)) OVER (ORDER BY p) - len(t) AS b FROM n0 WHERE len(t) BETWEEN 3 AND 40
), c AS (SELECT count(*) AS m, sum(k) AS total FROM n
), s AS (
  SELECT c_custkey AS id, [[c_name, c_mktsegment], ['nation', CAST(c_nationkey AS VARCHAR)]] AS facts, 200 + c_custkey % 80 AS size,
    CAST(floor((c_custkey % 97) / 97.0::DOUBLE * c.m) AS BIGINT) AS first, [(c_custkey % 13) / 13.0::DOUBLE, (c_custkey % 7) / 7.0::DOUBLE] AS u, c.total, c_custkey FROM customer, c
), w AS (SELECT s.*, n.b AS f, size - 4 AS need FROM s JOIN n ON n.i = s.first
), laps AS (SELECT *, unnest(range(0, 1 + CAST((f + need - 1) // total AS BIGINT))) AS lap FROM w
), g AS (
  SELECT l.id, any_value(facts) AS facts, any_value(u) AS u, any_value(size) AS size,
    list({'o': CAST(lap * total + n.b - f AS BIGINT), 't': n.t[1 : CAST(least(n.k, f + need - lap * total - n.b) AS INTEGER)]} ORDER BY lap, n.b) AS bg
  FROM laps l JOIN n ON n.b >= greatest(f - lap * total, 0) AND n.b < least(f + need - lap * total, total) GROUP BY l.id
), q AS (
  SELECT *, list_filter(range(0, len(bg)), lambda i: bg[i + 1].o >= floor(size * 0.25) AND bg[i + 1].o < floor(size * 0.75) - 4) AS possible FROM g
), z AS (
  SELECT *, list_sort([possible[1 + CAST(floor(u[1] * len(possible)) AS INTEGER)], possible[1 + CAST(floor(u[2] * len(possible)) AS INTEGER)]]) AS places FROM q
)
SELECT id, CAST(len(bg) AS INTEGER) AS n_noise, CAST(list_sum(list_transform(bg, lambda x: len(x.t))) AS INTEGER) AS noise_tokens, array_to_string(places, ' ') AS fact_positions,
  md5(array_to_string(flatten(list_transform(range(0, len(bg) + 1), lambda i:
    list_concat(flatten(list_transform(list_filter([1, 2], lambda j: places[j] = i), lambda j: facts[j])), coalesce(bg[i + 1].t, [])))), ' ')) AS tokens
FROM z
"""


@query(_NOISE)
def facts_among_noise(spark, sf_dir):
    """Two facts a customer in the middle half of a window of noise, to the token."""
    t = table(spark, sf_dir, "conversations")
    sentences = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("_pos"), F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    key = F.col("c_custkey")
    facts = F.array(F.array("c_name", "c_mktsegment"), F.array(F.lit("nation"), F.col("c_nationkey").cast("string")))
    samples = table(spark, sf_dir, "customer").select(key.alias("id"), facts.alias("facts"), (key % 80 + 200).alias("size"), ((key % 97) / 97.0).alias("at"), F.array((key % 13) / 13.0, (key % 7) / 7.0).alias("u"))
    made = noise.tokens_among_noise(samples, sentences, F.col("size"), band=(0.25, 0.75), least=3, most=40, start=F.col("at"), draws=F.col("u"))
    return made.select("id", "n_noise", "noise_tokens", F.array_join(F.col("fact_positions").cast("array<string>"), " ").alias("fact_positions"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


_TOKENS = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT))"


def _token_ids(text: str):
    """Whole numbers for the words of a text, as SQL makes them."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
e AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS a FROM d),
p AS (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM e),
w AS (SELECT item_id, {_TOKENS}[1:2] AS w FROM benchmark)
SELECT doc_id AS id, item_id AS word_id, i // 64 AS block, count(*) AS n FROM p JOIN w ON p.a = w.w[1] AND p.b = w.w[2] GROUP BY 1, 2, 3
""")
def words_in_blocks(spark, sf_dir):
    """The first two tokens of every benchmark item, in blocks of 64 tokens of every document."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _token_ids("text").alias("tokens"))
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("word_id"), F.slice(_token_ids("text"), 1, 2).alias("tokens"))
    return blocks.vocabulary_blocks(texts, words, 64)


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
x AS (SELECT doc_id, t, t[len(t) // 2 + 1 : len(t) // 2 + 2] AS w FROM d),
o AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(range(0, greatest(len(t) - 1, 0)), lambda i: t[i + 1] = w[1] AND t[i + 2] = w[2] AND i // 32 = (i + 1) // 32), lambda i: i // 32))) AS blocks, len(w) AS m FROM x
)
SELECT doc_id, CASE WHEN m = 2 THEN array_to_string(blocks, ' ') END AS blocks, CASE WHEN m = 2 THEN CAST(len(blocks) > 0 AS INTEGER) ELSE 0 END AS first_reward FROM o WHERE m = 2
""")
def word_blocks(spark, sf_dir):
    """Blocks of 32 tokens that hold the two tokens in the middle of their document, and what
    taking the first of them twice gives."""
    t = F.col("t")
    docs = table(spark, sf_dir, "documents").select("doc_id", _token_ids("text").alias("t"))
    rows = docs.select("doc_id", blocks.word_blocks(t, F.slice(t, F.floor(F.size(t) / 2).cast("int") + 1, F.lit(2)), 32).alias("found"), F.size(F.slice(t, F.floor(F.size(t) / 2).cast("int") + 1, F.lit(2))).alias("m")).where("m = 2")
    first = F.coalesce(F.get("found", F.lit(0)), F.lit(0))
    rewards = blocks.new_block_rewards(F.array(first, first), F.col("found"))
    return rows.select("doc_id", F.array_join(F.array_sort("found").cast("array<string>"), " ").alias("blocks"), F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x).cast("int").alias("first_reward"))


@query("""
WITH s AS (SELECT event_id, event_id % 5 AS kind, abs(coalesce(value, 0.0)) AS p FROM events)
SELECT event_id,
  CASE kind WHEN 0 THEN round(-3 * p, 5) END AS strict_value,
  CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'no log-probabilities at token 2' WHEN 2 THEN 'the payload ends before token 2' WHEN 3 THEN 'no log-probability of its own at token 2' ELSE 'no payload' END AS strict_error,
  CASE kind WHEN 0 THEN round(-3 * p, 5) WHEN 3 THEN round(-p - 7, 5) END AS lenient_value,
  CASE WHEN kind = 3 THEN '[unfinished content]' ELSE 'said' END AS text, CASE WHEN kind < 3 THEN round(-1.5 * p, 5) END AS mean_logprob, CASE WHEN kind < 3 THEN round(-3 * p, 5) END AS sum_logprob
FROM s
""")
def aligned_logprobs(spark, sf_dir):
    """Log-probabilities of a prompt by token id: whole, with a gap, cut short, of another token,
    and without a payload; and completions that stopped and that didn't."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("kind"), F.abs(F.coalesce("value", F.lit(0.0))).alias("p"))
    p, entry = F.col("p"), lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    second = entry("12", -p, "99", -p - 1)
    third = F.when(F.col("kind") == 3, entry("77", F.lit(-7.0))).when(F.col("kind") != 1, entry("13", -2 * p))
    payload = F.when(F.col("kind") == 2, F.array(F.lit(None).cast("map<string, double>"), second)).when(F.col("kind") != 4, F.array(F.lit(None).cast("map<string, double>"), second, third))
    ids = F.array(F.lit(11), F.lit(12), F.lit(13))
    strict, lenient = (vectors.aligned_logprob(ids, F.lit(1), payload, mode) for mode in (False, True))
    reason = F.when(F.col("kind") == 3, "length").otherwise("stop")
    tokens = F.when(F.col("kind") != 4, F.array(-p, -2 * p)).otherwise(F.array().cast("array<double>"))
    mean, summed = (vectors.completion(F.lit("said"), reason, tokens, c) for c in (False, True))
    r = lambda c: F.round(c, 5)
    return e.select("event_id", r(strict["value"]).alias("strict_value"), strict["error"].alias("strict_error"), r(lenient["value"]).alias("lenient_value"), mean["text"].alias("text"), r(mean["logprob"]).alias("mean_logprob"), r(summed["logprob"]).alias("sum_logprob"))


@query("""
WITH v AS (SELECT vec_id, len(embedding) // 2 AS h, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT vec_id, h, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x, e FROM v),
a AS (SELECT *, i % h AS k, (vec_id % 5 + 2) * pow(10000.0::DOUBLE, -2.0 * ((i % h) // 2) / h) AS angle, CASE WHEN i % 2 = 0 THEN -e[i + 2] ELSE e[i] END AS other FROM x)
SELECT vec_id, i AS place, round(x * cos(angle) + other * sin(angle), 4) + 0.0 AS turned, true AS composed FROM a
""")
def moved_vectors(spark, sf_dir):
    """Every component of vectors that are cached at one position and moved on to another, at once
    and in two steps."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    to = F.col("vec_id") % 5 + 3
    once = e.select("vec_id", "v", vectors.moved(F.col("v"), F.lit(1), to).alias("turned"), vectors.moved(F.col("v"), F.lit(1), F.lit(9)).alias("on_the_way"))
    both = once.select("vec_id", "turned", vectors.moved(F.col("on_the_way"), F.lit(9), to).alias("again"))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip("turned", "again")).alias("place", "z"))
    return rows.select("vec_id", "place", (F.round(F.col("z.turned"), 4) + 0.0).alias("turned"), (F.abs(F.col("z.turned") - F.col("z.again")) < 1e-9).alias("composed"))
