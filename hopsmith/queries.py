"""Named queries over the driver's tables, with their SQL.

The tables hold no QA records, so they stand in: vectors of ``embeddings`` are chunks and
queries (label: relevance class), ``labels`` are judgements, ``conversations`` are
predictions and answers, ``events`` are steps of episodes (one a user), ``orders`` and
``lineitem`` carry joins and aggregates of size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopsmith.functions import metrics, prompts, text, uncertainty, vectors
from hopsmith.operators import aggregates, episodes, filters, joins, ranking, rewards
from hopsmith.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- retrieval over vectors ------------------------------------------------

#: Every 50th vector by id is a sample's query, the 49 after it are its chunks.
SAMPLE, K = 50, 10

_SCORED = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (
  SELECT q.vec_id AS sample_id, c.vec_id AS chunk_idx, q.label AS q_label, c.label AS c_label,
    round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 6) AS dot,
    round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))
      / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))), 6) AS cos
  FROM v q JOIN v c ON c.vec_id // {SAMPLE} = q.vec_id // {SAMPLE}
  WHERE q.vec_id % {SAMPLE} = 0 AND c.vec_id % {SAMPLE} <> 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY cos DESC, chunk_idx) AS INTEGER) AS cos_rank,
    CAST(row_number() OVER (PARTITION BY sample_id ORDER BY dot DESC, chunk_idx) AS INTEGER) AS dot_rank FROM p
), log AS (
  SELECT sample_id, any_value(q_label) AS label,
    list(chunk_idx ORDER BY cos_rank) FILTER (cos_rank <= {K}) AS pred_idx,
    list(cos ORDER BY cos_rank) FILTER (cos_rank <= {K}) AS q_values,
    list(chunk_idx ORDER BY chunk_idx) FILTER (q_label = c_label) AS all_gold
  FROM r GROUP BY sample_id
), logged AS (
  SELECT sample_id, label, pred_idx, q_values, coalesce(all_gold, []) AS sf_idx FROM log
)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors: those that are a sample's query, and those that are its chunks."""
    e = table(spark, sf_dir, "embeddings")
    sample, is_query = (F.col("vec_id") - F.col("vec_id") % SAMPLE).alias("sample_id"), F.col("vec_id") % SAMPLE == 0
    queries = e.where(is_query).select(sample, F.col("embedding").alias("query"), F.col("label").alias("q_label"))
    chunks = e.where(~is_query).select(sample, F.col("vec_id").alias("chunk_idx"), F.col("embedding").alias("vector"), F.col("label").alias("c_label"))
    return queries, chunks


@query(_SCORED + f"SELECT sample_id, chunk_idx, cos AS score, cos_rank AS rank FROM r WHERE cos_rank <= {K}")
def topk_cosine_per_query(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return ranking.nearest(queries, chunks, K, "cosine", digits=6)


@query(_SCORED + "SELECT sample_id, chunk_idx, dot AS score, dot_rank AS rank FROM r WHERE dot_rank <= 4")
def masked_greedy_episode(spark, sf_dir):
    """Four greedy steps with a static state: the order in which chunks are taken."""
    rows = _episodes(spark, sf_dir)
    scores = lambda df: F.transform("vectors", lambda v: F.round(vectors.dot(F.col("query"), v), 6))
    done = episodes.greedy_episode(rows, scores, 4)
    taken = done.select(F.col("id").cast("long").alias("sample_id"), F.posexplode(F.arrays_zip("selected", "q_values")).alias("at", "s"), "chunks")
    return taken.select("sample_id", F.get("chunks", F.col("s.selected")).cast("long").alias("chunk_idx"), F.col("s.q_values").alias("score"), (F.col("at") + 1).alias("rank"))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, chunks, vectors) of each sample."""
    queries, chunks = _vectors(spark, sf_dir)
    listed = chunks.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", F.col("vector").cast("array<double>").alias("v")))).alias("c"))
    return queries.join(listed, "sample_id").select(F.col("sample_id").cast("string").alias("id"), F.transform("query", lambda x: x.cast("double")).alias("query"), F.transform("c", lambda x: x["chunk_idx"].cast("string")).alias("chunks"), F.col("c.v").alias("vectors"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retriever log: predicted are the ten nearest, gold all of the query's label."""
    queries, chunks = _vectors(spark, sf_dir)
    near = ranking.nearest(queries, chunks, K, "cosine", digits=6)
    pred = near.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_idx", "score"))).alias("p"))
    gold = chunks.join(queries, "sample_id").where("c_label = q_label").groupBy("sample_id").agg(F.array_sort(F.collect_list("chunk_idx")).alias("sf_idx"))
    none = F.array().cast("array<bigint>")
    rows = queries.join(pred, "sample_id").join(gold, "sample_id", "left")
    return rows.select("sample_id", F.col("q_label").alias("label"), F.transform("p", lambda x: x["chunk_idx"]).alias("pred_idx"), F.transform("p", lambda x: x["score"]).alias("q_values"), F.coalesce("sf_idx", none).alias("sf_idx"))


_FACT = """
m AS (
  SELECT *, len(list_intersect(pred_idx, sf_idx)) AS tp FROM logged
), s AS (
  SELECT *, CASE WHEN len(sf_idx) = 0 AND len(pred_idx) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (len(pred_idx) + len(sf_idx)) END AS f1,
    CASE WHEN tp = len(sf_idx) THEN 1.0 ELSE 0.0 END AS em FROM m
)
"""


@query(_SCORED + "," + _FACT + """
SELECT CASE WHEN grouping(label) = 1 THEN '<all>' ELSE CAST(label AS VARCHAR) END AS label, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em
FROM s GROUP BY GROUPING SETS ((), (label))
""")  # fmt: skip
def fact_f1_em_by_label(spark, sf_dir):
    m = metrics.fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    rows = _log(spark, sf_dir).select(F.col("label").cast("string").alias("label"), m["f1"].alias("f1"), m["em"].alias("em"))
    return aggregates.by_source(rows, ["f1", "em"], "label").select(F.col("source").alias("label"), "n", F.round("f1", 6).alias("f1"), F.round("em", 6).alias("em"))


THRESHOLDS = [-0.2, 0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.1]

_SWEEP = _SCORED + f""",
t AS (SELECT unnest([{', '.join(f'{x}' for x in THRESHOLDS)}]::DOUBLE[]) AS threshold),
w AS (
  SELECT threshold, sample_id, sf_idx, pred_idx,
    coalesce(list_min(list_filter(list_transform(range(1, len(q_values) + 1), lambda i: CASE WHEN q_values[i] < threshold THEN i - 1 END), lambda i: i IS NOT NULL)), len(q_values)) AS stop,
    CASE WHEN len(list_filter(sf_idx, lambda g: NOT list_contains(pred_idx, g))) > 0 THEN NULL
      ELSE list_max(list_transform(sf_idx, lambda g: list_position(pred_idx, g))) END AS covered
  FROM logged CROSS JOIN t
), k AS (
  SELECT *, list_slice(pred_idx, 1, stop) AS kept, CASE WHEN covered IS NULL THEN 'not_found' WHEN stop < covered THEN 'early' WHEN stop = covered THEN 'perfect' ELSE 'late' END AS label FROM w
), c AS (
  SELECT *, len(list_intersect(kept, sf_idx)) AS tp FROM k
), d AS (
  SELECT *, CASE WHEN len(kept) = 0 AND len(sf_idx) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (len(kept) + len(sf_idx)) END AS f1,
    CASE WHEN tp = len(sf_idx) THEN 1.0 ELSE 0.0 END AS em,
    CASE WHEN len(kept) = 0 AND len(sf_idx) = 0 THEN 1.0 WHEN len(sf_idx) = 0 THEN 0.0 ELSE tp * 1.0 / len(sf_idx) END AS tpr,
    (len(kept) - tp) * 1.0 / (100 - len(sf_idx)) AS fpr FROM c
)
"""


def _sweep(spark, sf_dir) -> DataFrame:
    return aggregates.threshold_sweep(_log(spark, sf_dir), THRESHOLDS, total=100)


@query(_SWEEP + """
SELECT threshold, count(*) AS n, round(avg(stop), 6) AS mean_length, round(avg(em), 6) AS coverage, round(avg(f1), 6) AS f1, round(avg(tpr), 6) AS tpr, round(avg(fpr), 6) AS fpr,
  round(avg(CASE WHEN label <> 'not_found' THEN 1.0 ELSE 0.0 END), 6) AS found
FROM d GROUP BY threshold
""")  # fmt: skip
def coverage_vs_threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("threshold", "n", *[F.round(c, 6).alias(c) for c in ("mean_length", "coverage", "f1", "tpr", "fpr", "found")])


@query(_SWEEP + "SELECT threshold, label, count(*) AS n FROM d GROUP BY threshold, label")
def early_stop_label_counts(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    label = filters.stop_label(filters.stop_length(F.col("q_values"), F.col("threshold")), filters.cover_step(F.col("pred_idx"), F.col("sf_idx")))
    return log.groupBy("threshold", label.alias("label")).agg(F.count("*").alias("n"))


@query(_SWEEP + """
, pts AS (SELECT threshold, avg(tpr) AS tpr, round(avg(fpr), 9) AS fpr FROM d GROUP BY threshold),
f AS (SELECT fpr, arg_min(tpr, threshold) AS tpr FROM pts GROUP BY fpr),
l AS (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr)) / 2 AS a FROM f)
SELECT round(coalesce(sum(a), 0), 6) AS auc FROM l
""")  # fmt: skip
def roc_auc_trapezoid(spark, sf_dir):
    points = _sweep(spark, sf_dir).select("threshold", "tpr", F.round("fpr", 9).alias("fpr"))
    return aggregates.roc_area(points).select(F.round("auc", 6).alias("auc"))


@query(_SCORED + """
SELECT sample_id, list_aggregate(list_transform(kept, lambda i: CAST(i AS VARCHAR)), 'string_agg', ' ') AS kept FROM (
  SELECT sample_id, coalesce(list_slice(pred_idx, 1, list_max(list_transform(range(1, len(pred_idx) + 1), lambda i: CASE WHEN list_contains(sf_idx, pred_idx[i]) THEN i END))), pred_idx) AS kept FROM logged)
""")  # fmt: skip
def chunk_filter_early_stop(spark, sf_dir):
    log = _log(spark, sf_dir).withColumns({"pred_texts": F.transform("pred_idx", lambda i: i.cast("string")), "sf_texts": F.transform("sf_idx", lambda i: i.cast("string"))})
    kept = filters.filter_chunks(log, filters.chunk_filter("early_stop"))
    return kept.select("sample_id", F.array_join("filtered_texts", " ").alias("kept"))


@query(_SCORED + """
SELECT sample_id, CAST(coalesce(list_min(list_filter(list_transform(range(1, len(q_values) + 1), lambda i: CASE WHEN q_values[i] <= 0.3 THEN i - 1 END), lambda i: i IS NOT NULL)), len(q_values)) AS INTEGER) AS n_kept FROM logged
""")  # fmt: skip
def chunk_filter_qvalue(spark, sf_dir):
    log = _log(spark, sf_dir).withColumns({"pred_texts": F.transform("pred_idx", lambda i: i.cast("string")), "sf_texts": F.transform("sf_idx", lambda i: i.cast("string"))})
    return filters.filter_chunks(log, filters.chunk_filter("qvalue", threshold=0.3)).select("sample_id", F.size("filtered_idx").alias("n_kept"))


@query(_SCORED + """
SELECT sample_id, list_aggregate(list_transform(list_filter(pred_idx, lambda i: list_contains(sf_idx, i)), lambda i: CAST(i AS VARCHAR)), 'string_agg', ' ') AS kept FROM logged WHERE len(list_intersect(pred_idx, sf_idx)) > 0
""")  # fmt: skip
def chunk_filter_no_noise(spark, sf_dir):
    log = _log(spark, sf_dir).withColumns({"pred_texts": F.transform("pred_idx", lambda i: i.cast("string")), "sf_texts": F.transform("sf_idx", lambda i: i.cast("string"))})
    return filters.filter_chunks(log, filters.chunk_filter("no_noise")).where(F.size("filtered_idx") > 0).select("sample_id", F.array_join("filtered_texts", " ").alias("kept"))


@query(_SCORED + """,
x AS (SELECT sample_id, chunk_idx, dot, dot_rank, exp((dot - max(dot) OVER (PARTITION BY sample_id)) / 0.5) AS e FROM r WHERE dot_rank <= 5)
SELECT sample_id, chunk_idx, round(e / sum(e) OVER (PARTITION BY sample_id), 6) AS p FROM x
""")  # fmt: skip
def topk_softmax_policy(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    best = ranking.nearest(queries, chunks, 5, "dot", digits=6).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "score"))).alias("c"))
    logits = F.transform("c", lambda x: x["score"])
    policy = vectors.top_k_policy(logits, F.transform(logits, lambda _: F.lit(True)), 0.5, 5)
    return best.select("sample_id", F.explode(F.arrays_zip(F.transform("c", lambda x: x["chunk_idx"]).alias("i"), policy.alias("p"))).alias("z")).select("sample_id", F.col("z.i").alias("chunk_idx"), F.round("z.p", 6).alias("p"))


@query(_SCORED + """,
x AS (SELECT sample_id, max(dot) AS m, sum(exp(dot / 0.5)) AS s FROM r WHERE dot_rank <= 5 GROUP BY sample_id)
SELECT sample_id, round(0.5 * ln(s), 6) AS soft_value FROM x
""")  # fmt: skip
def soft_state_value(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    rows = ranking.scored(queries, chunks, "dot", digits=6).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "score"))), lambda s: s["score"]).alias("q"))
    return rows.select("sample_id", F.round(vectors.soft_value(F.col("q"), F.transform("q", lambda _: F.lit(True)), 0.5, 5), 6).alias("soft_value"))


# --- text and answer metrics ----------------------------------------------

_CLEAN = "translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\r]+'), lambda w: w <> '')"
_NORMAL = _WORDS.format(_CLEAN)
_NO_ARTICLES = "list_filter(" + _NORMAL + ", lambda w: w NOT IN ('a', 'an', 'the'))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside the one that follows it."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("pred"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("gold"))


_TURNS = "WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS pred, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS gold FROM conversations)"


@query(f"SELECT doc_id, list_aggregate({_NO_ARTICLES.format('text')}, 'string_agg', ' ') AS normal FROM documents WHERE len({_NO_ARTICLES.format('text')}) > 0")
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalize_answer(F.col("text")).alias("normal")).where("normal <> ''")


_PAIR = _TURNS + f""",
w AS (SELECT conv_id, turn, {_NO_ARTICLES.format('pred')} AS p, {_NO_ARTICLES.format('gold')} AS g FROM t),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS same FROM w)
"""


@query(_PAIR + """
SELECT conv_id, turn, CASE WHEN p = g THEN 1 ELSE 0 END AS em,
  round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN same = 0 THEN 0.0
    ELSE 2 * (same::DOUBLE / len(p)) * (same::DOUBLE / len(g)) / (same::DOUBLE / len(p) + same::DOUBLE / len(g)) END, 6) AS f1 FROM o
""")  # fmt: skip
def token_f1_pairs(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", metrics.exact_match(F.col("pred"), F.col("gold")).alias("em"), F.round(metrics.token_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query(f"SELECT doc_id, CAST(len({_WORDS.format('text')}) AS INTEGER) AS n_words FROM documents")
def whitespace_token_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query(_TURNS + """
SELECT conv_id, turn, 'system' AS r1, 'Answer.' AS c1, 'user' AS r2,
  CASE WHEN gold <> '' THEN 'Below are passages you should use:' || chr(10) || chr(10) || gold || chr(10) || chr(10) || 'Question: ' || pred ELSE 'Question: ' || pred END AS c2 FROM t
""")  # fmt: skip
def prompt_messages(spark, sf_dir):
    t = _turns(spark, sf_dir)
    chunks = F.filter(F.array("gold"), lambda g: g != "")
    m = prompts.passage_messages(F.col("pred"), chunks, "Answer.")
    return t.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.col("m")[0]["role"].alias("r1"), F.col("m")[0]["content"].alias("c1"), F.col("m")[1]["role"].alias("r2"), F.col("m")[1]["content"].alias("c2"))


@query("""
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, CAST(coalesce(list_max(list_transform(p, lambda s: length(s))), 0) AS INTEGER) AS longest FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), '(\\n\\n)', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM documents)
""".replace("\\\\", "\\"))  # fmt: skip
def sentence_pieces(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pieces = F.filter(F.split("text", r"(?<=[.!?])\s+|(?<=\n\n)"), lambda s: s != "")
    return d.select("doc_id", F.size(pieces).alias("n_pieces"), F.coalesce(F.array_max(F.transform(pieces, lambda s: F.length(s))), F.lit(0)).alias("longest"))


@query("""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), '(\\n\\n)', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, 0 AS i, 0 AS k, '' AS cur, CAST(NULL AS VARCHAR) AS done FROM p
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN fits THEN k ELSE k + 1 END, CASE WHEN fits THEN joined ELSE s END, CASE WHEN NOT fits THEN cur END FROM (
    SELECT *, length(joined) <= 500 AS fits FROM (SELECT g.doc_id, i, k, cur, p.p[i + 1] AS s, CASE WHEN cur = '' THEN p.p[i + 1] ELSE cur || ' ' || p.p[i + 1] END AS joined FROM g JOIN p ON g.doc_id = p.doc_id WHERE i < len(p.p)))
)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_idx, done AS chunk FROM g WHERE done IS NOT NULL
UNION ALL SELECT g.doc_id, CAST(k AS INTEGER), cur FROM g JOIN p ON g.doc_id = p.doc_id WHERE i = len(p.p) AND cur <> ''
""")  # fmt: skip
def sentence_chunking(spark, sf_dir):
    """Sentences packed greedily into chunks of at most 500 characters."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.pack_chunks_udf("text", F.lit(500))).alias("chunk_idx", "chunk"))


@query("""
SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN 1 ELSE 0 END AS has_label,
  CASE WHEN len(l) = 0 THEN 0.0 ELSE round(2.0 * len(l) / (len(l) + 3), 6) END AS f1
FROM (SELECT doc_id, text, list_filter(['the', 'and', 'of'], lambda x: strpos(lower(text), x) > 0) AS l FROM documents)
""")  # fmt: skip
def label_f1_in_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.contains("text", F.lit("the")).cast("int").alias("has_label"), F.round(metrics.label_f1(F.col("text"), F.lit("the and of"), ["the", "and", "of"]), 6).alias("f1"))


# --- judgements, rates, ids ------------------------------------------------

_JUDGED = """
WITH j AS (
  SELECT d.source, d.doc_id, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS j FROM documents d LEFT JOIN labels l USING (doc_id)
), g AS (SELECT source || '/' || CAST(doc_id // 5 AS VARCHAR) AS id, source, list(j ORDER BY doc_id) AS judgements FROM j GROUP BY ALL)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with judgements: the labels of a source's documents, five ids apart; -1: no label."""
    d, l = table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(l, "doc_id", "left").withColumn("j", F.coalesce("quality", F.lit(-1)))
    key = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 5).cast("string"))
    return rows.groupBy(key.alias("id"), "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "j"))), lambda s: s["j"]).alias("judgements"))


@query(_JUDGED.replace("GROUP BY ALL", "GROUP BY 1, 2") + """
SELECT count(*) AS total, count(*) FILTER (len(list_filter(judgements, lambda x: x <> 1)) = 0) AS all_correct, count(*) FILTER (len(list_filter(judgements, lambda x: x <> 0)) = 0) AS all_wrong,
  count(*) FILTER (list_contains(judgements, -1)) AS unresolved,
  count(*) - count(*) FILTER (len(list_filter(judgements, lambda x: x <> 1)) = 0) - count(*) FILTER (len(list_filter(judgements, lambda x: x <> 0)) = 0) - count(*) FILTER (list_contains(judgements, -1)) AS mixed FROM g
""")  # fmt: skip
def judgement_buckets(spark, sf_dir):
    return aggregates.judgement_buckets(_judged(spark, sf_dir))


_RATES = _JUDGED.replace("GROUP BY ALL", "GROUP BY 1, 2") + """
, q AS (SELECT id, source, judgements, len(list_filter(judgements, lambda x: x = 1)) * 1.0 / len(judgements) AS rate FROM g)
"""


@query(_RATES + "SELECT id, round(rate, 6) AS success_rate FROM q")
def success_rate(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", F.round(metrics.success_rate(F.col("judgements")), 6).alias("success_rate"))


@query(_RATES + """
SELECT CAST(b.bin AS INTEGER) AS bin, count(q.id) AS n FROM (SELECT unnest(range(0, 11)) AS bin) b LEFT JOIN q ON CAST(round_even(rate * 10, 0) AS INTEGER) = b.bin GROUP BY 1
""")  # fmt: skip
def histogram_zero_filled(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("rate", metrics.success_rate(F.col("judgements")))
    return aggregates.rate_histogram(rows, "rate", 10)


def _two_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-only and supported rates by source: share of quality 1 without and with toxic ones."""
    l = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(l, "doc_id")
    return rows.groupBy("source", "lang").agg(F.avg("toxic").alias("question_only_success_rate"), F.avg("quality").alias("with_support_facts_success_rate"))


_TWO = "WITH t AS (SELECT source, lang, avg(toxic) AS q, avg(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)"


@query(_TWO + " SELECT source, lang, round(q, 6) AS q, round(s, 6) AS s, round(s - q, 6) AS delta FROM t WHERE s >= 0.5 AND q <= 0.5 AND s - q > 0 AND s + q < 1.9")
def delta_filter(spark, sf_dir):
    rows = filters.success_range(_two_rates(spark, sf_dir), q=(None, 0.5), s=(0.5, None), improves=True, expression="s + q < 1.9")
    return rows.select("source", "lang", *[F.round(c, 6).alias(c) for c in ("q", "s", "delta")])


@query(_TWO + " SELECT source, lang FROM t WHERE abs(q - 0) <= 1e-12 AND abs(s - 1) <= 1e-12")
def q0_s1_ids(spark, sf_dir):
    return filters.rates_match(_two_rates(spark, sf_dir)).select("source", "lang")


@query("""
WITH r AS (SELECT o_orderpriority AS source, o_custkey AS id FROM orders),
p AS (SELECT source, id, count(*) AS n FROM r GROUP BY source, id), i AS (SELECT id, count(*) AS n FROM r GROUP BY id)
SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM p) AS by_source_and_id, (SELECT CAST(sum(n - 1) AS BIGINT) FROM i) AS by_id
""")  # fmt: skip
def dup_accounting(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("id"))
    return aggregates.duplicate_counts(rows)


@query("SELECT coalesce(nullif(source, ''), '<empty>') AS value, count(*) AS n FROM documents GROUP BY 1")
def value_distribution(spark, sf_dir):
    return aggregates.value_distribution(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return filters.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def missing_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return joins.missing_ids(ids, table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def id_semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.with_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_record_per_id(spark, sf_dir):
    from hopsmith.sources.readers import latest_by_id

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("_pos"))
    return latest_by_id(rows).drop("_pos")


@query("""
SELECT count(*) AS candidates, count(c.c_custkey) AS found, count(*) - count(c.c_custkey) AS missing
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
""")  # fmt: skip
def merge_counts(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("_id"))
    return joins.merge_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), known)


@query("SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n_chunks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) >= 6")
def min_chunks_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("context"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(rows, "o_orderkey")
    return filters.min_chunks(rows, 6).select("o_orderkey", F.size("context").alias("n_chunks"))


@query("SELECT l_returnflag AS type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY l_returnflag")
def type_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"))
    return aggregates.type_shares(rows).select("type", "n", F.round("percent", 6).alias("percent"))


@query("""
WITH c AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1),
e AS (SELECT stratum, n * 100.0::DOUBLE / sum(n) OVER () AS q FROM c),
r AS (SELECT stratum, q, row_number() OVER (ORDER BY q - floor(q) DESC, stratum) AS k, 100 - sum(floor(q)) OVER () AS rest FROM e)
SELECT stratum, CAST(floor(q) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM r
""")  # fmt: skip
def stratified_split_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return ranking.stratified_split(rows, 100, "stratum", "c_custkey").groupBy("stratum").agg(F.count_if("is_test").alias("n_test"))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length, min(length(text)) AS min_length FROM documents GROUP BY lang")
def dataset_statistics(spark, sf_dir):
    rows = aggregates.dataset_statistics(table(spark, sf_dir, "documents"), "text", "lang")
    return rows.select("lang", "n", F.round("mean_length", 6).alias("mean_length"), F.col("max_length").cast("long").alias("max_length"), F.col("min_length").cast("long").alias("min_length"))


@query("""
SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max
FROM (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem) GROUP BY metric
""")  # fmt: skip
def success_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return aggregates.success_statistics(rows, ["quantity", "discount"]).select("metric", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "min", "max")


# --- episodes over events --------------------------------------------------


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by user in time order; an episode ends with a purchase."""
    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("env_id"), step.alias("step"), F.coalesce("value", F.lit(0.0)).alias("reward"), (F.col("event_type") == "purchase").alias("done"), "event_type")


_STEPS = """
WITH RECURSIVE s AS (
  SELECT user_id AS env_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step, coalesce(value, 0.0) AS reward, event_type = 'purchase' AS done, event_type FROM events
)
"""


@query(_STEPS + """,
e AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY env_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM s)
SELECT env_id, CAST(episode AS BIGINT) AS episode, round(sum(reward), 4) AS episodic_return, count(*) AS n_steps, bool_or(done) AS done FROM e GROUP BY 1, 2
""")  # fmt: skip
def episodic_return(spark, sf_dir):
    return aggregates.episodic_returns(_steps(spark, sf_dir)).withColumns({"episodic_return": F.round("episodic_return", 4), "episode": F.col("episode").cast("long")})


@query(_STEPS + "SELECT env_id, step, round(0.5 * (reward - coalesce(lag(reward) OVER (PARTITION BY env_id ORDER BY step), 1.0)), 6) AS reward FROM s")
def marginal_reward(spark, sf_dir):
    steps = _steps(spark, sf_dir).select(F.col("env_id").alias("episode"), "step", F.col("reward").alias("score"), F.lit(1.0).alias("baseline"))
    return rewards.marginal(steps, scale=0.5).select(F.col("episode").alias("env_id"), "step", F.round("reward", 6).alias("reward"))


@query(_STEPS + """,
v AS (SELECT env_id, step, reward, CASE WHEN done THEN 0.0 ELSE 1.0 END AS nd, coalesce(lead(reward) OVER (PARTITION BY env_id ORDER BY step), 0.0) AS v_next,
  count(*) OVER (PARTITION BY env_id) AS n FROM s),
g AS (
  SELECT env_id, step, reward + nd * 0.99::DOUBLE * v_next AS g FROM v WHERE step = n
  UNION ALL
  SELECT v.env_id, v.step, v.reward + v.nd * 0.99::DOUBLE * (0.5::DOUBLE * v.v_next + 0.5::DOUBLE * g.g) FROM v JOIN g ON v.env_id = g.env_id AND v.step = g.step - 1
)
SELECT env_id, step, round(g, 4) AS lambda_return FROM g
""")  # fmt: skip
def lambda_return(spark, sf_dir):
    s = _steps(spark, sf_dir)
    ahead = F.coalesce(F.lead("reward").over(Window.partitionBy("env_id").orderBy("step")), F.lit(0.0))
    rows = s.select("env_id", "step", F.struct("step", "reward", ahead.alias("v_next"), F.when(F.col("done"), 0.0).otherwise(1.0).alias("not_done")).alias("s"))
    by_env = rows.groupBy("env_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    returns = by_env.select("env_id", F.posexplode(vectors.lambda_returns(F.col("steps"), 0.99, 0.5)).alias("i", "g"))
    return returns.select("env_id", (F.col("i") + 1).alias("step"), F.round("g", 4).alias("lambda_return"))


@query(_STEPS + """,
k AS (SELECT *, ['click', 'purchase', 'view'] AS gold FROM s),
f AS (SELECT env_id, step, CASE WHEN row_number() OVER (PARTITION BY env_id, event_type ORDER BY step) = 1 AND list_contains(gold, event_type) THEN 1 ELSE 0 END AS fresh FROM k),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY env_id ORDER BY step) AS found FROM f)
SELECT env_id, step, round(0.1 * fresh + CASE WHEN fresh = 1 AND found = 3 THEN 1.0 ELSE 0.0 END, 6) AS reward FROM c
""")  # fmt: skip
def gt_feedback_steps(spark, sf_dir):
    """Supports are three event types; what a step has predicted is what its user has done so far."""
    s = _steps(spark, sf_dir)
    so_far = F.collect_set("event_type").over(Window.partitionBy("env_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = s.select(F.col("env_id").alias("episode"), "step", so_far.alias("pred_idx"), F.array(*map(F.lit, ("click", "purchase", "view"))).alias("sf_idx"))
    return rewards.ground_truth(rows, per_fact=0.1).select(F.col("episode").alias("env_id"), "step", F.round("reward", 6).alias("reward"))


# --- rewards and uncertainty over lists ------------------------------------

_CAND = """
WITH c AS (SELECT l_orderkey AS id, list(p ORDER BY l_linenumber, p, f, l_quantity) AS logp, list(f ORDER BY l_linenumber, p, f, l_quantity) AS j,
  list(l_quantity ORDER BY l_linenumber, p, f, l_quantity) AS b FROM (SELECT *, l_extendedprice / 1000 AS p, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS f FROM lineitem) GROUP BY l_orderkey)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as candidates: price as log-probability, return flag as judgement."""
    l = table(spark, sf_dir, "lineitem")
    j = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    rows = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_extendedprice") / 1000).alias("p"), j.alias("j"), F.col("l_quantity").alias("b")))).alias("c"))
    return rows.select("id", F.col("c.p").alias("logp"), F.col("c.j").alias("judgements"), F.col("c.b").alias("betas"))


@query(_CAND + """,
z AS (SELECT id, unnest(logp) - unnest(b) AS shift, unnest(j) AS j FROM c)
SELECT id, round(0.02 * (coalesce(avg(shift) FILTER (j = 1), 0) - coalesce(avg(shift) FILTER (j <> 1), 0)), 10) + 0.0::DOUBLE AS reward FROM z GROUP BY id
""")  # fmt: skip
def candidate_beta_reward(spark, sf_dir):
    reward = rewards.candidate_beta(F.col("logp"), F.col("judgements"), F.col("betas"), 0.02)
    return _candidates(spark, sf_dir).select("id", (F.round(reward, 10) + F.lit(0.0)).alias("reward"))


@query(_CAND + """,
m AS (SELECT id, list_transform(b, lambda x: exp(x - list_max(b))) AS e FROM c),
z AS (SELECT id, unnest(list_transform(e, lambda x: x / list_sum(e))) AS w, unnest(range(0, len(e))) AS i FROM m)
SELECT id, CAST(i AS INTEGER) AS i, round(w, 6) AS w FROM z
""")  # fmt: skip
def softmax_weights(spark, sf_dir):
    w = uncertainty.softmax_weights(F.col("betas"))
    return _candidates(spark, sf_dir).select("id", F.posexplode(w).alias("i", "w")).select("id", "i", F.round("w", 6).alias("w"))


@query("""
WITH s AS (SELECT l_orderkey AS id, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT id, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY id) AS p FROM s)
SELECT id, round(-sum(p * ln(p)), 6) + 0.0::DOUBLE AS entropy, round(-sum(p * ln(p + 1e-12::DOUBLE)), 6) + 0.0::DOUBLE AS count_entropy FROM p GROUP BY id
""")  # fmt: skip
def semantic_entropy(spark, sf_dir):
    c = F.col("judgements")
    even = F.transform(c, lambda _: F.lit(1.0) / F.size(c))
    rows = _candidates(spark, sf_dir)
    return rows.select("id", (F.round(uncertainty.entropy(uncertainty.cluster_weights(even, c)), 6) + F.lit(0.0)).alias("entropy"), (F.round(uncertainty.count_entropy(c), 6) + F.lit(0.0)).alias("count_entropy"))


@query("""
WITH v AS (SELECT l_returnflag AS model, l_quantity AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
t AS (
  SELECT a.model, a.x AS t, sum(b.n) FILTER (b.x < a.x) AS n0, sum(b.n * b.x) FILTER (b.x < a.x) AS s0, sum(b.n * b.x * b.x) FILTER (b.x < a.x) AS q0,
    sum(b.n) FILTER (b.x >= a.x) AS n1, sum(b.n * b.x) FILTER (b.x >= a.x) AS s1, sum(b.n * b.x * b.x) FILTER (b.x >= a.x) AS q1
  FROM v a JOIN v b ON a.model = b.model GROUP BY a.model, a.x
), e AS (SELECT model, t, round(coalesce(q0 - s0 * s0 / n0, 0) + q1 - s1 * s1 / n1, 3) AS error FROM t)
SELECT model, arg_min(t, struct_pack(error := error, t := t)) AS threshold, min(error) AS error FROM e GROUP BY model
""")  # fmt: skip
def optimal_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("se"))
    return aggregates.optimal_threshold(rows).withColumn("error", F.round("error", 3))


@query("SELECT l_orderkey AS id, count(*) * (count(*) - 1) // 2 AS n_pairs FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def answer_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))).alias("answers"))
    return joins.answer_pairs(rows).groupBy("id").agg(F.count("*").alias("n_pairs"))


# --- model stages with the stub backend, and a stream -----------------------


@query()
def reader_with_stub(spark, sf_dir):
    """A retriever log of documents read by the stub: rows only, no model's quality."""
    from hopsmith.plans.evaluate import read_and_score

    d = table(spark, sf_dir, "benchmark")
    log = d.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.substring_index("text", " ", 1).alias("answer"), F.array(F.lit(0)).alias("sf_idx"), F.array(F.lit(0), F.lit(1)).alias("pred_idx"), F.array(F.lit(0.9), F.lit(0.1)).alias("q_values"), F.array("text").alias("sf_texts"), F.array("text", F.lit("noise")).alias("pred_texts"))
    return read_and_score(log, filters.chunk_filter("qvalue", threshold=0.5)).drop("LLM_Judge_Score", "filter_texts", "full_model_output")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    """The event table as a stream of files, in hourly windows by event time."""
    from hopsmith.streaming.logs import windowed_values

    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    path = scratch(spark, "windows")

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)  # a complete result replaces the one before

    run = windowed_values(source).writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


# --- summaries, parsers and step rewards ------------------------------------


@query(_SCORED + """
, m AS (SELECT CASE WHEN len(list_intersect(pred_idx, sf_idx)) = len(sf_idx) THEN 1.0 ELSE 0.0 END AS em, len(pred_idx) AS n FROM logged)
SELECT count(*) AS n, round(avg(em), 6) AS mean_return, round(stddev_pop(em), 6) AS std_return, round(avg(n), 6) AS mean_text_len, round(avg(em), 6) AS em FROM m
""")  # fmt: skip
def retriever_summary(spark, sf_dir):
    m = metrics.fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    rows = _log(spark, sf_dir).withColumns({"return": m["em"], "text_len": F.size("pred_idx").cast("long")})
    return aggregates.retriever_summary(rows).select("n", *[F.round(c, 6).alias(c) for c in ("mean_return", "std_return", "mean_text_len", "em")])


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem")
def beta_summary(spark, sf_dir):
    return aggregates.beta_summary(_candidates(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("""
SELECT count(*) FILTER (j = 1) AS correct, count(*) FILTER (j = 0) AS incorrect, count(*) FILTER (j = -1) AS failed, round(100.0 * count(*) FILTER (j = 1) / count(*), 6) AS accuracy
FROM (SELECT coalesce(l.quality, -1) AS j FROM documents d LEFT JOIN labels l USING (doc_id))
""")  # fmt: skip
def judge_accuracy(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(l, "doc_id", "left").select(F.coalesce("quality", F.lit(-1)).alias("judgement"))
    return aggregates.judge_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


@query(_STEPS + "SELECT env_id, step, round(avg(reward) OVER (PARTITION BY env_id ORDER BY step), 9) AS running_mean FROM s")
def running_mean(spark, sf_dir):
    rows = aggregates.running_mean(_steps(spark, sf_dir), "reward", "step", "env_id")
    return rows.select("env_id", "step", F.round("running_mean", 9).alias("running_mean"))


@query(_STEPS + """
, m AS (SELECT env_id, step, reward, max(reward) OVER (PARTITION BY env_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s)
SELECT env_id AS run, step, reward FROM m WHERE best IS NULL OR reward > best
""")  # fmt: skip
def best_checkpoints(spark, sf_dir):
    return aggregates.best_checkpoints(_steps(spark, sf_dir).select(F.col("env_id").alias("run"), "step", "reward"))


@query(_STEPS + "SELECT env_id, step, round(0.5 * greatest(0.0, coalesce(lag(reward) OVER (PARTITION BY env_id ORDER BY step) - reward, 0.0)), 6) AS reward FROM s")
def uncertainty_drop(spark, sf_dir):
    rows = _steps(spark, sf_dir).select(F.col("env_id").alias("episode"), "step", F.col("reward").alias("p"))
    return rewards.uncertainty(rows, "uncertainty_drop", 0.5).select(F.col("episode").alias("env_id"), "step", F.round("reward", 6).alias("reward"))


@query(_STEPS + """
, v AS (SELECT env_id, step, ln(greatest(abs(reward) / (1 + abs(reward)), 1.0::DOUBLE / 9)) AS v FROM s)
SELECT env_id, step, round(coalesce(v - lag(v) OVER (PARTITION BY env_id ORDER BY step), 0.0), 5) + 0.0::DOUBLE AS reward FROM v
""")  # fmt: skip
def information_gain_steps(spark, sf_dir):
    p = F.abs("reward") / (1 + F.abs("reward"))
    rows = _steps(spark, sf_dir).select(F.col("env_id").alias("episode"), "step", p.alias("p_gold"), F.lit(False).alias("is_final"), F.lit(0.0).alias("exact_share"))
    return rewards.information_gain(rows, n_samples=8).select(F.col("episode").alias("env_id"), "step", (F.round("reward", 5) + F.lit(0.0)).alias("reward"))


@query(_TURNS + """
, u AS (SELECT conv_id, turn, upper(pred) AS u, regexp_replace(string_split_regex(trim(upper(pred)), '[ \\t\\n\\r]+')[1], '[^A-Z]', '', 'g') AS w FROM t)
SELECT conv_id, turn, CAST(CASE WHEN w = 'YES' THEN 1 WHEN w = 'NO' THEN 0 WHEN strpos(u, 'YES') > 0 THEN 1 WHEN strpos(u, 'NO') > 0 THEN 0 END AS INTEGER) AS yes_no FROM u
WHERE w = 'YES' OR w = 'NO' OR strpos(u, 'YES') > 0 OR strpos(u, 'NO') > 0
""")  # fmt: skip
def yes_no_parse(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.yes_no(F.col("pred")).alias("yes_no")).where("yes_no IS NOT NULL")


@query(_TURNS + """
SELECT conv_id, turn, pred AS last_search, gold AS answer FROM (
  SELECT conv_id, turn, regexp_replace(pred, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS pred, regexp_replace(gold, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS gold FROM t)
""")  # fmt: skip
def agent_tags(spark, sf_dir):
    """Tags around the turns are parsed back: the last search, the first answer."""
    t = _turns(spark, sf_dir)
    reply = F.concat(F.lit("<search>old</search> <search> "), "pred", F.lit("</search><answer>"), "gold", F.lit(" </answer><answer>late</answer>"))
    return t.select("conv_id", "turn", text.last_search(reply).alias("last_search"), text.tagged_answer(reply).alias("answer"))


@query(_TURNS + "SELECT conv_id, turn, 'QUESTION: ' || pred || chr(10) || 'OPTIONS:' || chr(10) || 'A) ' || role || chr(10) || 'B) ' || gold AS prompt, pred || chr(10) || 'A) ' || role || chr(10) || 'B) ' || gold AS endings, chr(65 + CAST(turn % 2 AS INTEGER)) AS letter FROM t")
def options_query(spark, sf_dir):
    from hopsmith.sources import readers

    t = _turns(spark, sf_dir).withColumns({"question": F.col("pred"), "ctx": F.col("pred"), "options": F.array("role", "gold"), "endings": F.array("role", "gold"), "label": F.col("turn") % 2})
    return t.select("conv_id", "turn", readers.options_query(t).alias("prompt"), readers.endings_query(t).alias("endings"), readers.endings_answer(t).alias("letter"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || replace(format('{:,}', CAST(o_custkey AS BIGINT)), ',', '') AS answers FROM orders")
def number_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    solution = F.concat(F.lit("so #### "), F.format_number("o_custkey", 0), F.lit(" #### 7"))
    two_step = F.concat(F.lit("<think>1</think> Final Answer: "), F.format_number("o_orderkey", 0), F.lit("."))
    return o.select("o_orderkey", F.concat(text.two_step_answer(two_step), text.gsm_answer(solution)).alias("answers"))


@query(_PAIR.replace(", lambda w: w NOT IN ('a', 'an', 'the'))", ", lambda w: w <> '')").replace("translate(lower(pred)", "translate(regexp_replace(' ' || regexp_replace(lower(pred), '[ \\t\\n\\r]+', '  ', 'g') || ' ', '([^a-z0-9_\\x80-\\x{10FFFF}])(a|an|the)([^a-z0-9_\\x80-\\x{10FFFF}])', '\\1 \\3', 'g')").replace("translate(lower(gold)", "translate(regexp_replace(' ' || regexp_replace(lower(gold), '[ \\t\\n\\r]+', '  ', 'g') || ' ', '([^a-z0-9_\\x80-\\x{10FFFF}])(a|an|the)([^a-z0-9_\\x80-\\x{10FFFF}])', '\\1 \\3', 'g')") + """
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN same = 0 THEN 0.0
    ELSE 2 * (same::DOUBLE / len(p)) * (same::DOUBLE / len(g)) / (same::DOUBLE / len(p) + same::DOUBLE / len(g)) END, 6) AS f1 FROM o
""")  # fmt: skip
def token_f1_articles_first(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.round(metrics.token_f1_articles_first(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query("""
SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE ELSE 0.1 + 0.9 * cos((event_id - 100) / 99900.0::DOUBLE * pi() / 2) END, 6) AS warm,
  round(CASE WHEN event_id <= 50 THEN 1.0::DOUBLE WHEN event_id > 5000 THEN 0.2::DOUBLE ELSE 1.0 + (0.2 - 1.0) * (event_id - 50) / 4950.0::DOUBLE END, 6) AS anneal,
  round(CASE WHEN event_id < 100 THEN 0.9 * event_id / 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 0.9 * (event_id - 100) / 9900.0::DOUBLE) END, 6) AS linear FROM events
""")  # fmt: skip
def schedules(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = F.col("event_id")
    return e.select("event_id", F.round(vectors.cosine_warmup(step, 100, 100000, 0.1), 6).alias("warm"), F.round(vectors.linear_anneal(step, 1.0, 0.2, 5000, 50), 6).alias("anneal"), F.round(vectors.linear_warmup(step, 100, 10000, 0.1), 6).alias("linear"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT t.vec_id, round(list_sum(list_transform(list_zip(t.e, s.e), lambda z: z[1] * 0.9 + z[2] * 0.1)), 5) AS total FROM v t JOIN v s ON s.vec_id = t.vec_id + 1
""")  # fmt: skip
def soft_update(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("s"))
    return e.join(s, "vec_id").select("vec_id", F.round(vectors.total(vectors.soft_update(F.col("e"), F.col("s"), 0.1)), 5).alias("total"))


@query("""
SELECT event_type AS feedback, count(*) AS n, round(avg(round(value, 2)), 6) AS mean, round(min(round(value, 2)), 6) AS min, round(max(round(value, 2)), 6) AS max
FROM events WHERE value >= 0 GROUP BY event_type
""")  # fmt: skip
def reward_timing(spark, sf_dir):
    """Every event as two lines of a timing log: a step on the way, twice as long, and the final one."""
    e = table(spark, sf_dir, "events").where("value >= 0")
    e = e.withColumn("final", F.explode(F.array(F.lit("True"), F.lit("False"))))
    final, spent = F.col("final"), F.when(F.col("final") == "True", F.round("value", 2)).otherwise(2 * F.round("value", 2))
    line = F.concat(F.lit("log reward_ms="), spent.cast("decimal(18,2)").cast("string"), F.lit(" feedback="), "event_type", F.lit(" is_final="), final, F.lit(" reward=1.0"))
    rows = aggregates.timing_summary(aggregates.timing_rows(e.select(line.alias("value"), F.col("event_id").alias("_pos"))))
    return rows.select("feedback", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query("SELECT 'customer' AS source, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations, 0 AS priorities FROM customer UNION ALL SELECT 'orders', count(*), 0, count(DISTINCT o_orderpriority) FROM orders")
def labelled_union(spark, sf_dir):
    from hopsmith.operators.adapt import labelled_union as union

    rows = union({"customer": table(spark, sf_dir, "customer").select("c_nationkey"), "orders": table(spark, sf_dir, "orders").select("o_orderpriority")})
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("c_nationkey"), F.lit(0)).alias("nations"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("SELECT l_returnflag AS type, l_linestatus AS source, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 GROUP BY 1, 2")
def token_window(spark, sf_dir):
    from hopsmith.sources.readers import token_window as window

    rows = window(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), 10, 40)
    return rows.groupBy(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity"))


@query("""
SELECT id, CAST(min(p) AS BIGINT) AS _pos, count(*) - 1 AS repeats FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS p FROM orders) GROUP BY id
""")  # fmt: skip
def ordered_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("_pos"))
    return aggregates.ordered_distinct(rows)


@query("""
WITH g AS (SELECT o_custkey AS id, max(o_totalprice) AS em FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT round(sum(coalesce(g.em, 0)) / count(*), 4) AS em FROM customer c LEFT JOIN g ON g.id = c.c_custkey
""")  # fmt: skip
def prediction_against_gold(spark, sf_dir):
    pred = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("em"))
    return aggregates.answer_scores(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), pred, ["em"]).select(F.round("em", 4).alias("em"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences of every document; see the tests for its rules."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _best(step: int, moved: str) -> str:
    """The best chunk that isn't taken, and its score, for a query that has moved."""
    taken = " AND ".join(f"c.vec_id <> t{step - 1}.c{i}" for i in range(1, step)) or "true"
    return f"""t{step} AS (SELECT * EXCLUDE (r) FROM (
  SELECT t{step - 1}.*, c.vec_id AS c{step}, c.e AS v{step}, {_dot(moved, 'c.e')} AS q{step}, row_number() OVER (PARTITION BY id ORDER BY {_dot(moved, 'c.e')} DESC, c.vec_id) AS r
  FROM t{step - 1} JOIN v c ON c.vec_id // {SAMPLE} = id // {SAMPLE} AND c.vec_id <> id AND {taken}) WHERE r = 1)"""


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
t0 AS (SELECT vec_id AS id, e AS q FROM v WHERE vec_id % {SAMPLE} = 0), {_best(1, 'q')},
{_best(2, 'list_transform(list_zip(q, v1), lambda z: z[1] + 0.5 * z[2])')},
{_best(3, 'list_transform(list_zip(q, v1, v2), lambda z: z[1] + 0.5 * (z[2] + z[3]) / 2)')}
SELECT CAST(id AS VARCHAR) AS id, c1 || '|' || c2 || '|' || c3 AS taken, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3 FROM t3
""")  # fmt: skip
def shifting_query_episode(spark, sf_dir):
    """Three greedy steps whose query moves towards what is selected."""
    done = episodes.greedy_episode(_episodes(spark, sf_dir), episodes.shifting_scores(0.5), 3)
    taken = F.array_join(F.transform("selected", lambda i: F.get("chunks", i)), "|")
    return done.select("id", taken.alias("taken"), *(F.round(F.get("q_values", F.lit(i)), 5).alias(f"q{i + 1}") for i in range(3)))
