"""Named queries of loaders, scores, prompts and streams over records made of the driver's
tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopsmith import backends
from hopsmith.functions import prompts, vectors
from hopsmith.operators import aggregates, filters, ranking, rewards
from hopsmith.plans import probe_data
from hopsmith.queries import query, table
from hopsmith.record_queries import _LINES, _PART, _both_rows, _draw, _lines, _literal, _paragraph_json, _part, _uniform, joined
from hopsmith.session import scratch
from hopsmith.sources import readers, writers
from hopsmith.streaming.logs import windowed_values

# --- probe samples ------------------------------------------------------------


@query(_LINES + f"""
, a AS (SELECT r.*, string_split(chunks, '|') AS cl, list_transform(list_filter(string_split(sf_idx, '|'), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS s FROM r),
b AS (SELECT *, list_transform(list_sort(list_transform(s, lambda i: {{'h': {_draw(100, 'id', 'i')}, 'i': i}})), lambda x: x.i) AS s2,
  list_transform(list_sort(list_transform(list_filter(range(0, len(cl)), lambda i: NOT list_contains(s, CAST(i AS INTEGER))), lambda i: {{'h': {_draw(100, 'id', 'i')}, 'i': CAST(i AS INTEGER)}})), lambda x: x.i) AS o2,
  CAST(floor({_uniform(101, 'id')} * (least(len(s), 2) + 1)) AS INTEGER) AS right_n FROM a),
p AS (SELECT 'partial' AS kind, question, array_to_string(list_transform(list_sort(list_concat(s2[1:right_n], o2[1:2 - right_n])), lambda i: cl[i + 1]), ' ') AS context, answer FROM b
  WHERE type <> 'bridge_comparison' ORDER BY {_draw(100, 'id')}, id LIMIT 500),
m AS (SELECT 'paragraphs' AS kind, question, replace(dotted, '|', ' ') AS context, answer FROM r WHERE n_hops = 2)
SELECT 'whole' AS kind, question, replace(chunks, '|', ' ') AS context, answer FROM r UNION ALL SELECT * FROM p UNION ALL SELECT * FROM m
""")
def probe_samples(spark, sf_dir):
    """Samples for a probe: whole contexts, two drawn chunks of 500 random questions, and questions
    of two paragraphs."""
    raw, listed = _both_rows(spark, sf_dir)
    kinds = {"whole": probe_data.multihop(raw, -1), "partial": probe_data.multihop_partial(raw, 500), "paragraphs": probe_data.paragraphs(listed, -1)}
    told = [df.select(F.lit(kind).alias("kind"), "question", "context", "answer") for kind, df in kinds.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query(f"""
WITH p AS (SELECT p_partkey AS k, 'Of ' || p_name || '?' AS q, 'It is ' || p_brand AS s, CAST(p_size AS VARCHAR) AS a FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY {_draw(42, 'k')}, k) AS n FROM p),
pool AS (SELECT q, s, row_number() OVER (ORDER BY k) - 1 AS i FROM r WHERE n <= 20),
rows_ AS (SELECT * FROM r WHERE n > 20 ORDER BY n LIMIT 100),
d AS (SELECT k, pool.q, pool.s, row_number() OVER (PARTITION BY k ORDER BY {_draw(42, 'k', 'i')}, i) AS place FROM rows_, pool)
SELECT CAST(x.k AS VARCHAR) AS id, x.q AS question, x.a AS answer, (SELECT string_agg(d.q || ' -> ' || d.s, '|' ORDER BY d.place) FROM d WHERE d.k = x.k AND d.place <= 2) AS examples FROM rows_ x
""")
def probe_problems(spark, sf_dir):
    """A hundred problems, each with two drawn examples of a pool of twenty others."""
    p = table(spark, sf_dir, "part")
    train = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("Of "), "p_name", F.lit("?")).alias("problem"), F.concat(F.lit("It is "), "p_brand").alias("solution"), F.col("p_size").cast("string").alias("answer"), F.col("p_partkey").alias("_pos"))
    found = probe_data.problems(train, most=100, samples=100, examples=20, shown=2)
    shown = F.transform("examples", lambda e: F.concat(e["question"], F.lit(" -> "), e["answer"]))
    return found.select("id", "question", "answer", F.array_join(shown, "|").alias("examples"))


@query(f"SELECT p_partkey, n || '!' AS answer, 16 AS width FROM ({_PART})")
def probe_inputs(spark, sf_dir):
    """The greedy answer and the features of a prompt with it, from a stub that repeats the prompt."""
    p = _part(spark, sf_dir).withColumn("messages", prompts.messages("s", F.col("n")))
    done = backends.features_and_answer(p, "messages", make=_Echo)
    return done.select("p_partkey", F.col("probe.answer").alias("answer"), F.size("probe.features").alias("width"))


class _Echo(backends.StubBackend):
    def generate(self, messages: list, n: int) -> list[list[str]]:
        return [[m[-1]["content"] + "!"] * n for m in messages]


@query(_LINES + """
, x AS (SELECT r.*, list_transform(range(1, len(string_split(dotted, '|')) + 1), lambda i: 'TITLE: ' || string_split(string_split(dotted, '|')[i], '. ')[1] || chr(10) || 'TEXT: ' || substr(string_split(dotted, '|')[i], 3 + length(string_split(string_split(dotted, '|')[i], '. ')[1])) || chr(10) || chr(10)) AS parts FROM r)
SELECT 'qa' AS type, 'MuSiQue' AS dataset_name, CASE WHEN c % 2 = 0 THEN 'dev' ELSE 'train' END AS dataset_partition, question, answer, CAST(8 * n AS BIGINT) AS context_length, md5(array_to_string(parts, '')) AS context,
  md5('There is a context which is crucial to answer question ''' || question || ''':' || chr(10) || array_to_string(parts, '') || chr(10) || chr(10) || 'Carefully read information above and answer the question: ' || question || chr(10) || 'YOUR ANSWER: ' || answer) AS prompt
FROM x WHERE 8 * n BETWEEN 16 AND 40
""")
def paragraph_tasks(spark, sf_dir):
    """Tasks of two partitions whose contexts have 16 to 40 words."""
    rows = _lines(spark, sf_dir)
    parts = {}
    for name, part in (("dev", rows.where("c % 2 = 0")), ("train", rows.where("c % 2 <> 0"))):
        path = scratch(spark, name)
        writers.jsonl(_paragraph_json(part), path)
        parts[name] = readers.paragraph_qa(spark, path)
    tasks = readers.paragraph_tasks(parts, 16, 40)
    prompt = prompts.task_prompt(F.col("type"), F.col("context"), F.col("question"), F.col("answer"))
    return tasks.select("type", "dataset_name", "dataset_partition", "question", "answer", "context_length", F.md5("context").alias("context"), F.md5(prompt).alias("prompt"))


@query(_LINES + "SELECT 'hotpot' AS kind, id, question, answer FROM r UNION ALL SELECT 'musique', id, question, answer FROM r UNION ALL SELECT '2wiki', id, question, answer FROM r WHERE type <> 'bridge_comparison'")
def question_kinds(spark, sf_dir):
    """Questions of all three families."""
    raw, listed = _both_rows(spark, sf_dir)
    kinds = [readers.question_rows(df, kind).select(F.lit(kind).alias("kind"), "id", "question", "answer") for kind, df in (("hotpot", raw), ("musique", listed), ("2wiki", raw))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


# --- scores ---------------------------------------------------------------------

@query("""
WITH g AS (SELECT c_custkey AS id, c_mktsegment AS answer, ['s' || c_nationkey, 's' || c_custkey % 3] AS t FROM customer),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' x' END AS answer, ['s' || c_nationkey, 'other'] AS t FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT g.*, p.id IS NOT NULL AS there, list_distinct(g.t) AS gt, p.id % 2 = 0 AS same FROM g LEFT JOIN p ON g.id = p.id),
v AS (SELECT there, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS pr, 1.0::DOUBLE AS re, 0.5::DOUBLE AS sp, 1.0::DOUBLE / len(gt) AS sr, len(gt) = 1 AS covered FROM b)
SELECT round(avg(CASE WHEN there THEN em ELSE 0.0::DOUBLE END), 6) AS em, round(avg(CASE WHEN there THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END), 6) AS f1,
  round(avg(CASE WHEN there THEN pr ELSE 0.0::DOUBLE END), 6) AS precision, round(avg(CASE WHEN there THEN re ELSE 0.0::DOUBLE END), 6) AS recall,
  round(avg(CASE WHEN there AND covered THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS support_em, round(avg(CASE WHEN there THEN 2 * sp * sr / (sp + sr) ELSE 0.0::DOUBLE END), 6) AS support_f1,
  round(avg(CASE WHEN there THEN sp ELSE 0.0::DOUBLE END), 6) AS support_precision, round(avg(CASE WHEN there THEN sr ELSE 0.0::DOUBLE END), 6) AS support_recall FROM v
""")
def answer_and_support_scores(spark, sf_dir):
    """Eight means over customers, a fifth of them without a prediction, and predictions of others."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = lambda x: F.concat(F.lit("s"), x.cast("string"))
    gold = c.select(key.alias("id"), F.col("c_mktsegment").alias("answer"), F.array(text(F.col("c_nationkey")), text(key % 3)).alias("support_texts"))
    said = F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" x")))
    pred = c.where(key % 5 != 0).select(key.alias("id"), said.alias("answer"), F.array(text(F.col("c_nationkey")), F.lit("other")).alias("support_texts"))
    unknown = pred.limit(0).unionByName(c.select((-key).alias("id"), F.lit("x").alias("answer"), F.array(F.lit("y")).alias("support_texts")))
    found = aggregates.answer_and_support_scores(gold, pred.unionByName(unknown))
    return found.select(*(F.round(x, 6).alias(x) for x in found.columns))


@query("""
WITH j AS (SELECT l_orderkey, list(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS a, list(CASE WHEN l_quantity > 40 THEN -1 ELSE 1 END) AS b FROM lineitem GROUP BY 1),
t AS (SELECT count(*) AS n, count(*) FILTER (list_min(a) = 1) AS yes, count(*) FILTER (list_min(a) = 0 AND list_max(a) = 0) AS no, CAST(sum(len(list_filter(a, lambda x: x = -1))) AS BIGINT) AS fa, CAST(sum(len(list_filter(b, lambda x: x = -1))) AS BIGINT) AS fb FROM j)
SELECT 'all_correct' AS what, yes AS n FROM t UNION ALL SELECT 'all_wrong', no FROM t UNION ALL SELECT 'mixed', n - yes - no FROM t UNION ALL SELECT 'question_only', fa FROM t UNION ALL SELECT 'with_support', fb FROM t
""")
def judgement_totals(spark, sf_dir):
    """Records by what all their judgements say, and failed judgements of two modes."""
    j = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(j).alias("judgements"), F.collect_list(F.when(F.col("l_quantity") > 40, -1).otherwise(1)).alias("with_support"))
    failed = aggregates.failed_judgements(rows.withColumnRenamed("judgements", "question_only"), ["question_only", "with_support"])
    return aggregates.beta_buckets(rows).unpivot([], ["all_correct", "all_wrong", "mixed"], "what", "n").unionByName(failed.unpivot([], ["question_only", "with_support"], "what", "n"))


@query(f"""
SELECT p_partkey, CASE s % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS judged, 0.0::DOUBLE AS before_the_end,
  md5('user:You are evaluating answer correctness.' || chr(10) || chr(10) || 'Question: ' || b || chr(10) || 'Expected answer: ' || n || chr(10) || 'Proposed answer: ' || t || chr(10) || chr(10)
    || 'Does the proposed answer convey the same meaning as the expected answer in the context of the question? Respond with ONLY ''yes'' or ''no''.') AS asked,
  md5({_literal(prompts.STORY)} || 'Look at ' || b || '.' || chr(10) || 'Example:' || n || chr(10) || 'Be short.' || chr(10) || 'Context: ' || n || ' ' || t || chr(10) || chr(10) || 'Question: Where is ' || b || '??') AS story, 'qa2' AS task
FROM ({_PART})
""")
def judged_rewards(spark, sf_dir):
    """A yes/no judge's question and what its reply is worth; a story prompt by its task's texts."""
    b, n, t, s = F.col("b"), F.col("n"), F.col("t"), F.col("s")
    reply = F.element_at(F.array(F.lit(" Yes."), F.lit("yes, it does"), F.lit("No"), F.lit(None).cast("string")), (s % 4 + 1).cast("int"))
    asked = prompts.yes_no_messages(b, n, t)
    story = prompts.story_task_messages(F.concat(F.lit("Where is "), b, F.lit("?")), F.array(n, t), F.concat(F.lit("Look at "), b, F.lit(".")), F.concat(F.lit("<example>"), n, F.lit("</example>")), F.lit("Be short."))
    whole = lambda m: F.md5(F.concat(F.get(m, F.lit(0))["content"], F.get(m, F.lit(1))["content"]))
    return _part(spark, sf_dir).select("p_partkey", rewards.judged_reward(reply, F.lit(True), 0.5).alias("judged"), rewards.judged_reward(reply, F.lit(False)).alias("before_the_end"), F.md5(F.concat(F.lit("user:"), F.get(asked, F.lit(0))["content"])).alias("asked"), whole(story).alias("story"), prompts.story_task(F.lit("qa2_two-supporting-facts_test")).alias("task"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, vec_id % 3 AS k FROM embeddings)
SELECT vec_id, round((CASE k WHEN 0 THEN v[1] WHEN 1 THEN v[1] + v[5] ELSE v[1] + v[5] + v[9] END) / (k + 1) / 10, 6) + 0.0 AS mean_first, CASE k WHEN 0 THEN v[1] WHEN 1 THEN v[5] ELSE v[9] END AS last_first, v[9] AS padded_first FROM e
""")
def pooled_vectors(spark, sf_dir):
    """Three token vectors of four components, of which one to three are there: their masked mean
    and the last of them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tokens = F.array(*(F.slice("v", 4 * i + 1, 4) for i in range(3)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i <= F.col("vec_id") % 3).cast("int"))
    first = lambda c: F.get(c, F.lit(0))
    return e.select("vec_id", (F.round(first(vectors.mean_pooled(tokens, mask)), 6) + 0.0).alias("mean_first"), first(vectors.last_pooled(tokens, mask, F.lit(False))).alias("last_first"), first(vectors.last_pooled(tokens, mask, F.lit(True))).alias("padded_first"))


# --- files, places, strata --------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), c AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT o_orderkey FROM o LEFT JOIN c USING (i) WHERE coalesce(c_acctbal, -1) <= 0
""")
def resume_by_place(spark, sf_dir):
    """Orders at whose place among them no customer with a balance stands among the customers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("_pos"))
    results = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_custkey").alias("_pos"))
    return filters.not_done_by_place(orders, results, F.col("c_acctbal") > 0).select("o_orderkey")


@query("""
SELECT n_regionkey AS key, string_agg(n_name, '|' ORDER BY half, n_nationkey) AS sentences FROM (SELECT *, CASE WHEN n_nationkey % 2 = 1 THEN 0 ELSE 1 END AS half FROM nation) GROUP BY 1
UNION ALL SELECT 100 + n_nationkey, n_name || ' 1|' || n_name || ' 2' FROM nation WHERE n_nationkey % 3 <> 0
""")
def noise_books(spark, sf_dir):
    """Lists of two sets joined by key, and a corpus of books read back without the empty ones."""
    n = table(spark, sf_dir, "nation")
    part = lambda odd: n.where(F.col("n_nationkey") % 2 == odd).select(F.col("n_regionkey").cast("long").alias("key"), F.array("n_name").alias("values"), F.col("n_nationkey").alias("_pos"))
    path = scratch(spark, "books")
    sentences = F.when(F.col("n_nationkey") % 3 != 0, F.array(F.concat("n_name", F.lit(" 1")), F.concat("n_name", F.lit(" 2")))).otherwise(F.array().cast("array<string>"))
    n.select((F.col("n_nationkey") + 100).cast("long").alias("book_id"), sentences.alias("sentences"), "n_name").write.parquet(path)
    both = readers.merged_lists([part(1), part(0)]).unionByName(readers.books(spark, path).toDF("key", "values"))
    return both.select("key", joined("values").alias("sentences"))


@query(f"""
WITH c AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1),
e AS (SELECT stratum, n * 100.0::DOUBLE / sum(n) OVER () AS q FROM c),
r AS (SELECT stratum, q, row_number() OVER (ORDER BY q - floor(q) DESC, stratum) AS k, 100 - sum(floor(q)) OVER () AS rest FROM e),
t AS (SELECT c_custkey, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_draw(42, 'c_custkey')}, c_custkey) AS place FROM customer)
SELECT c_custkey, place <= floor(q) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS is_test FROM t JOIN r USING (stratum)
""")
def stratified_split_rows(spark, sf_dir):
    """Which customers a split by segment takes."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return ranking.stratified_split(rows, 100, "stratum", "c_custkey").select("c_custkey", "is_test")


# --- late events --------------------------------------------------------------------

_LATE = """
WITH b AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
one AS (SELECT max(ts) AS w FROM events, b WHERE ts < b.middle),
late AS (SELECT e.* FROM events e, b, one WHERE e.ts < b.middle AND e.event_id % 10 = 0 AND date_trunc('hour', e.ts) + INTERVAL 1 HOUR > one.w - INTERVAL 10 MINUTE),
every AS (SELECT event_id, ts, event_type, value FROM events UNION ALL SELECT event_id, ts, event_type, value FROM late)
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM every
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
"""


@query(_LATE)
def late_event_windows(spark, sf_dir):
    """Hourly windows of events that come in three parts, the second of which repeats a tenth of the first: what falls
    into windows that are over by then is dropped, the rest counts; windows come out when they are over."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    middle = F.unix_micros("ts") < F.lit(first + (last - first) // 2)
    folder, out, checkpoint = (scratch(spark, name) for name in ("events", "hours", "state"))
    for part in (e.where(middle), e.where(middle & (F.col("event_id") % 10 == 0)), e.where(~middle)):
        part.write.mode("append").parquet(folder)
        windows = windowed_values(spark.readStream.schema(e.schema).parquet(folder), "1 hour", "10 minutes")
        windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
