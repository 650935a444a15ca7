"""Queries over QA records that are made of the driver's tables, written in each family's
file format and read back.

An order is a question, its lines are passages (those of more than 25 pieces support the
answer); parts, customers, nations and conversations stand in for the other families.
The SQL states from the same tables what must come out. Lists are compared as joined texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopsmith import backends, schemas
from hopsmith.functions import metrics, prompts, text, uncertainty, vectors
from hopsmith.operators import adapt, aggregates, episodes, filters, joins, ranking, rewards
from hopsmith.operators.numbering import numbered
from hopsmith.plans import search_agent
from hopsmith.queries import _SCORED, _episodes, _log, query, table
from hopsmith.session import scratch
from hopsmith.sources import readers, writers


def joined(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def as_sample(df: DataFrame) -> DataFrame:
    return df.select("id", "question", "answer", joined("chunks").alias("chunks"), joined("sf_idx").alias("sf_idx"), "source")


# --- multi-hop records ------------------------------------------------------

_LINES = """
WITH l AS (
  SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS i,
    'Part ' || l_partkey AS title, 'Flag ' || l_returnflag || '.' AS s1, 'Status ' || l_linestatus || '.' AS s2, l_quantity > 25 AS support FROM lineitem
), o AS (
  SELECT o_orderkey AS k, 'Which part of order ' || o_orderkey || '?' AS question, o_orderpriority AS answer,
    CASE o_orderstatus WHEN 'F' THEN 'bridge' WHEN 'O' THEN 'comparison' ELSE 'bridge_comparison' END AS type, o_custkey AS c FROM orders
), t AS (SELECT DISTINCT k, title FROM l WHERE support),
g AS (
  SELECT l.k, string_agg(l.title || ' ' || s1 || ' ' || s2, '|' ORDER BY i) AS chunks, count(*) AS n,
    coalesce(string_agg(CAST(i AS VARCHAR), '|' ORDER BY i) FILTER (t.title IS NOT NULL), '') AS sf_idx, count(*) FILTER (t.title IS NOT NULL) AS n_sf,
    string_agg(l.title || '. ' || s1 || ' ' || s2, '|' ORDER BY i) AS dotted, coalesce(string_agg(CAST(i AS VARCHAR), '|' ORDER BY i) FILTER (support), '') AS hops, count(*) FILTER (support) AS n_hops
  FROM l LEFT JOIN t ON t.k = l.k AND t.title = l.title GROUP BY l.k
), r AS (SELECT CAST(o.k AS VARCHAR) AS id, question, answer, type, c, g.* EXCLUDE (k) FROM o JOIN g ON g.k = o.k)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, question, answer, type, lines): an order with its lines in order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    line = F.struct(place.alias("i"), F.concat(F.lit("Part "), "l_partkey").alias("title"), F.concat(F.lit("Flag "), "l_returnflag", F.lit(".")).alias("s1"), F.concat(F.lit("Status "), "l_linestatus", F.lit(".")).alias("s2"), (F.col("l_quantity") > 25).alias("support"))
    # renamed only after grouping: the window's exchange then serves grouping and join as well
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("l")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("lines")).withColumnRenamed("l_orderkey", "k")
    kind = F.when(F.col("o_orderstatus") == "F", "bridge").when(F.col("o_orderstatus") == "O", "comparison").otherwise("bridge_comparison")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("Which part of order "), "o_orderkey", F.lit("?")).alias("question"), F.col("o_orderpriority").alias("answer"), kind.alias("type"), F.col("o_custkey").alias("c"))
    return orders.join(lines, "k")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _raw(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(_raw_value(*more).alias("value"))


def _raw_value(*more: Column) -> Column:
    """One JSON object a line, nested lists mixed as in the public files. No text needs escapes."""
    context = F.transform("lines", lambda x: F.concat(F.lit("["), _quoted(x["title"]), F.lit(",["), _quoted(x["s1"]), F.lit(","), _quoted(x["s2"]), F.lit("]]")))
    support = F.transform(F.filter("lines", lambda x: x["support"]), lambda x: F.concat(F.lit("["), _quoted(x["title"]), F.lit(",0]")))
    fields = [F.lit('{"_id":'), _quoted(F.col("k").cast("string")), F.lit(',"question":'), _quoted(F.col("question")), F.lit(',"answer":'), _quoted(F.col("answer")), F.lit(',"type":'), _quoted(F.col("type")), F.lit(',"level":"easy"')]
    fields += [F.lit(',"supporting_facts":['), F.array_join(support, ","), F.lit('],"context":['), F.array_join(context, ","), F.lit("]")]
    return F.concat(*fields, *more, F.lit("}"))


def _text(df: DataFrame, path: str) -> str:
    """Compressed: the texts are a multiple of the tables."""
    df.write.option("compression", "gzip").text(path)
    return path


def _array_text(df: DataFrame, path: str) -> str:
    """Whole files that are arrays: a task's rows in each."""
    return _text(writers.array_lines(df), path)


@query(_LINES + "SELECT id, question, answer, chunks, sf_idx, 'hotpotqa' AS source FROM r")
def scan_hotpotqa(spark, sf_dir):
    folder = scratch(spark, "hotpot")
    _array_text(_raw(_lines(spark, sf_dir)), f"{folder}/hotpot_dev_distractor_v1.json")
    return as_sample(adapt.adapt(readers.multihop_split(spark, folder, "eval"), "hotpotqa"))


@query(_LINES + "SELECT id, question, answer, chunks, sf_idx, 'hotpotqa' AS source FROM r WHERE n >= 3")
def scan_hotpotqa_clean(spark, sf_dir):
    """The cleaned training split, by the second of its names; short contexts go."""
    folder = scratch(spark, "hotpot")
    _text(_raw(_lines(spark, sf_dir)), f"{folder}/{readers.HOTPOT_CLEAN[1]}")
    return as_sample(adapt.adapt(filters.min_chunks(readers.multihop_split(spark, folder, "train-clean"), 3), "hotpotqa"))


@query(_LINES + "SELECT id, question, answer, chunks, sf_idx, '2wiki' AS source FROM r WHERE type <> 'bridge_comparison'")
def scan_2wiki(spark, sf_dir):
    folder = scratch(spark, "2wiki")
    _array_text(_raw(_lines(spark, sf_dir)), f"{folder}/dev.json")
    return as_sample(adapt.adapt(readers.two_wiki_split(spark, folder, "dev"), "2WikiMultihopQA"))


@query("SELECT p_partkey, p_partkey % 4 <> 3 AS is_bridge FROM part")
def is_bridge_comparison(spark, sf_dir):
    spelt = F.element_at(F.array(*map(F.lit, ("bridge_comparison", "Bridge Comparison", "BRIDGE-comparison", "bridge"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", readers.is_bridge_comparison(spelt).alias("is_bridge"))


def _paragraph_json(rows: DataFrame) -> DataFrame:
    return rows.select(*_paragraph_columns())


def _paragraph_columns() -> list[Column]:
    paragraphs = F.transform("lines", lambda x: F.struct(x["i"].alias("idx"), x["title"].alias("title"), F.concat(x["s1"], F.lit(" "), x["s2"]).alias("paragraph_text"), x["support"].alias("is_supporting")))
    hops = F.transform(F.filter("lines", lambda x: x["support"]), lambda x: F.struct(x["i"].alias("paragraph_support_idx")))
    return [F.col("k").cast("string").alias("id"), F.col("question"), F.col("answer"), paragraphs.alias("paragraphs"), hops.alias("question_decomposition")]


def _paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "paragraphs")
    writers.jsonl(_paragraph_json(_lines(spark, sf_dir)), path)
    return readers.paragraph_qa(spark, path)


def _both_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw and paragraph records. One pass over the tables writes the files of both, so that the lines are dealt and kept on disk once."""
    path = scratch(spark, "both")
    kinds = {"raw": _raw_value(), "paragraphs": F.to_json(F.struct(*_paragraph_columns()), {"ignoreNullFields": "false"})}
    told = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items())))
    # rows of a compressed file are one task's
    _lines(spark, sf_dir).select(told.alias("r")).select("r.*").write.partitionBy("kind").option("maxRecordsPerFile", 1 << 17).option("compression", "gzip").text(path)
    return readers.multihop(spark, f"{path}/kind=raw"), readers.paragraph_qa(spark, f"{path}/kind=paragraphs")


@query(_LINES + "SELECT id, question, answer, dotted AS chunks, hops AS sf_idx, 'musique' AS source FROM r")
def scan_musique(spark, sf_dir):
    return as_sample(adapt.adapt(_paragraph_rows(spark, sf_dir), "musique"))


@query(_LINES + "SELECT id, hops AS references_idx, hops AS facts_idx FROM r WHERE n_hops = 2")
def musique_eval(spark, sf_dir):
    rows = readers.paragraph_eval(_paragraph_rows(spark, sf_dir), 2)
    return rows.select("id", joined("references_idx").alias("references_idx"), joined("facts_idx").alias("facts_idx"))


@query(_LINES + ", h AS (SELECT k, string_agg(title || ' ' || replace(s1, '.', '.') || ' ' || s2, '|' ORDER BY i) AS chunks FROM l GROUP BY k) SELECT r.id, h.chunks, sf_idx FROM r JOIN h ON CAST(h.k AS VARCHAR) = r.id")
def musique_as_multihop(spark, sf_dir):
    """Sentences lose the stop that they were cut at but for the last; it is put back here."""
    rows = adapt.as_multihop(_paragraph_rows(spark, sf_dir))
    context = F.transform("context", lambda c: F.struct(c["title"].alias("title"), F.transform(c["sentences"], lambda s: F.concat(F.regexp_replace(s, r"\.$", ""), F.lit("."))).alias("sentences")))
    found = adapt.multihop(rows.withColumn("context", context), "musique")
    return found.select("id", joined("chunks").alias("chunks"), joined("sf_idx").alias("sf_idx"))


@query(_LINES + """
SELECT id, question, answer, chunks, sf_idx, CASE WHEN c % 2 = 0 THEN 'hotpotqa' ELSE '2WikiMultihopQA' END AS source FROM r WHERE c % 3 <> 0
UNION ALL SELECT id, question, answer, dotted, hops, 'musique' FROM r WHERE c % 3 = 0
""")  # fmt: skip
def combined_sources(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    source = F.when(F.col("c") % 2 == 0, "hotpotqa").otherwise("2WikiMultihopQA")
    context = F.transform("lines", lambda x: F.struct(x["title"].alias("title"), F.array(x["s1"], x["s2"]).alias("sentences")))
    support = F.transform(F.filter("lines", lambda x: x["support"]), lambda x: F.struct(x["title"].alias("title"), F.lit(0).alias("sent_id")))
    hops = rows.where("c % 3 <> 0").select(F.col("k").cast("string").alias("_id"), "question", "answer", context.alias("context"), support.alias("supporting_facts"), source.alias("source"))
    paragraphs = _paragraph_json(rows.where("c % 3 = 0")).withColumn("source", F.lit("musique"))
    return as_sample(adapt.adapt(hops.unionByName(paragraphs, allowMissingColumns=True), "combined"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS question, p_brand || ', ' || p_type AS answer, '111|222|333' AS chunks, '0' AS sf_idx, 'NQ+HotPotQA' AS source FROM part")
def scan_nq_hotpotqa(spark, sf_dir):
    path = scratch(spark, "open-qa")
    table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("golden_answers"), "p_size").write.parquet(path)
    return as_sample(adapt.adapt(readers.open_qa(spark, path), "NQ+HotPotQA"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS question, p_type AS answer, 'It is ' || p_name || '. It costs much!' AS chunks, '0' AS sf_idx, 'LongBench' AS source FROM part")
def scan_longbench(spark, sf_dir):
    path = scratch(spark, "long")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.col("p_brand").alias("input"), F.concat(F.lit("It is "), "p_name", F.lit(".   It costs much!")).alias("context"), F.array("p_type", "p_name").alias("answers"))
    writers.jsonl(rows, path)
    return as_sample(adapt.adapt(readers.long_context(spark, path), "LongBench"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'What is ' || p_brand || '?' AS question, p_type AS answer, p_name || '|' || p_type AS chunks, '0' AS sf_idx, 'RulerQA' AS source FROM part")
def scan_ruler_qa(spark, sf_dir):
    path = scratch(spark, "ruler")
    told = F.concat(F.lit("Document 1:\n"), "p_name", F.lit("\n\nDocument 2:\n"), "p_type", F.lit(" QUESTION: What is "), "p_brand", F.lit("? "))
    writers.jsonl(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), told.alias("input"), F.array("p_type").alias("outputs"), F.lit(9).alias("length_w_model_temp"), F.lit("A:").alias("answer_prefix")), path)
    return as_sample(adapt.adapt(readers.ruler_qa(spark, path), "RulerQA"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'What number is it?' AS question, CAST(700000000 + c_custkey AS VARCHAR) AS answer, 'The grass is green.|The number is ' || (700000000 + c_custkey) || '.|The sky is blue.' AS chunks, '1' AS sf_idx FROM customer")
def scan_niah(spark, sf_dir):
    folder = scratch(spark, "needle")
    number = F.expr("700000000 + c_custkey").cast("string")
    told = F.concat(F.lit("The grass is green. The number is "), number, F.lit(". The sky is blue. What number is it?"))
    writers.jsonl(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), told.alias("input"), F.array(number).alias("outputs"), F.lit(9).alias("length_w_model_temp"), F.lit("").alias("answer_prefix")), f"{folder}/train.jsonl")
    found = readers.needle_split(spark, folder, "validation")
    return found.select("id", "question", "answer", joined("chunks").alias("chunks"), joined("sf_idx").alias("sf_idx"))


_STORY = """
WITH c AS (SELECT c_nationkey AS n, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer),
s AS (SELECT c.n, n_name, string_agg('Customer ' || c_custkey || ' lives in ' || n_name || '.', '|' ORDER BY i) AS chunks, max(m) AS m, min(c_custkey) AS first FROM c JOIN nation ON n_nationkey = c.n GROUP BY c.n, n_name)
"""


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story a nation: its customers, then where the first of them lives."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list("c_custkey")).alias("c"))
    facts = F.array_join(F.transform("c", lambda k, i: F.concat((i + 1).cast("string"), F.lit(" Customer "), k, F.lit(" lives in "), "n_name", F.lit("."))), "\n")
    asked = F.concat((F.size("c") + 1).cast("string"), F.lit(" Where does Customer "), F.get("c", F.lit(0)), F.lit(" live? \t"), "n_name", F.lit("\t1 2"))
    path = scratch(spark, "stories")
    names.orderBy("n_nationkey").select(F.concat(facts, F.lit("\n"), asked).alias("value")).coalesce(1).write.text(path)
    return readers.stories(readers.story_lines(spark, path))


@query(_STORY + "SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS VARCHAR) AS id, 'Where does Customer ' || first || ' live?' AS question, n_name AS answer, chunks, CASE WHEN m > 1 THEN '0|1' ELSE '0' END AS sf_idx, 'babilong' AS source FROM s")
def scan_babi(spark, sf_dir):
    return as_sample(adapt.adapt(_stories(spark, sf_dir), "babilong"))


@query(_STORY + "SELECT 'Where does Customer ' || first || ' live?' AS question, replace(chunks, '|', ' ') AS context, n_name AS answer FROM s")
def story_contexts(spark, sf_dir):
    return readers.story_contexts(_stories(spark, sf_dir))


# --- in-context sets --------------------------------------------------------

_IN_CONTEXT = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation),
e AS (
  SELECT 'GSM8K' AS source, string_agg('Of ' || n_name || '?' || chr(10) || ' #||# ' || 'So it is.' || chr(10) || 'Final Answer: ' || n_nationkey, '|' ORDER BY n_nationkey) AS chunks FROM nation
  UNION ALL SELECT 'MATH', string_agg('Of ' || n_name || '?' || chr(10) || ' #||# ' || 'It is ' || n_regionkey, '|' ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT 'HellaSwag', string_agg('Of ' || n_name || chr(10) || 'A) x' || chr(10) || 'B) ' || n_name || chr(10) || ' #||# ' || chr(65 + n_nationkey % 2), '|' ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT 'MMLU-Pro', string_agg('QUESTION: Of ' || n_name || '?' || chr(10) || 'OPTIONS:' || chr(10) || 'A) x' || chr(10) || 'B) ' || n_name || chr(10) || ' #||# ' || 'B', '|' ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT 'XL-Sum', string_agg('TEXT:' || chr(10) || 'Of ' || n_name || chr(10) || ' #||# ' || 'SUMMARY:' || chr(10) || 'x', '|' ORDER BY n_nationkey) FROM nation
), q AS (
  SELECT 'GSM8K' AS source, 'Of ' || p_name || '?' AS question, CAST(p_size AS VARCHAR) AS answer, NULL AS id FROM part
  UNION ALL SELECT 'MATH', 'Of ' || p_name || '?', CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'HellaSwag', 'Of ' || p_name || chr(10) || 'A) x' || chr(10) || 'B) ' || p_name, chr(CAST(65 + p_partkey % 2 AS INTEGER)), CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'MMLU-Pro', 'QUESTION: Of ' || p_name || '?' || chr(10) || 'OPTIONS:' || chr(10) || 'A) x' || chr(10) || 'B) ' || p_name, 'B', CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'XL-Sum', 'Of ' || p_name, 'x', CAST(p_partkey AS VARCHAR) FROM part
)
SELECT source, coalesce(id, '') AS id, question, answer, '0' AS sf_idx, md5(chunks) AS chunks FROM q JOIN e USING (source)
"""


@query(_IN_CONTEXT)
def in_context_sets(spark, sf_dir):
    """The five families through files, readers, the split and the dispatcher; nations are the examples."""
    key, name = F.col("key"), F.col("name")
    fields = {
        "GSM8K": (schemas.GSM, lambda: (F.concat(F.lit("Of "), name, F.lit("?")).alias("question"), F.concat(F.lit("So it is.\n#### "), F.col("number").cast("string")).alias("answer"))),
        "MATH": (schemas.MATH, lambda: (key.alias("id"), F.concat(F.lit("Of "), name, F.lit("?")).alias("problem"), F.concat(F.lit("It is "), "number2").alias("solution"), F.col("number").cast("string").alias("answer"))),
        "HellaSwag": (schemas.ENDINGS, lambda: (key.alias("ind"), F.concat(F.lit("Of "), name).alias("ctx"), F.array(F.lit("x"), name).alias("endings"), (key % 2).alias("label"))),
        "MMLU-Pro": (schemas.OPTIONS, lambda: (key.alias("question_id"), F.concat(F.lit("Of "), name, F.lit("?")).alias("question"), F.array(F.lit("x"), name).alias("options"), F.lit("B").alias("answer"))),
        "XL-Sum": (schemas.SUMMARY, lambda: (key.cast("string").alias("id"), F.concat(F.lit("Of "), name).alias("text"), F.lit("x").alias("summary"))),
    }
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("number"), F.col("n_regionkey").alias("number2")).orderBy("key").coalesce(1)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("number"), F.lit(0).alias("number2"))
    out = None
    for source, (schema, columns) in fields.items():
        folder = scratch(spark, source)
        for split, rows in (("train", nations), ("eval", parts)):
            writers.jsonl(rows.select(*columns()), f"{folder}/{split}")
        train, evaluation = (readers.with_position(readers.jsonl(spark, f"{folder}/{split}", schema)) for split in ("train", "eval"))
        samples, shown = readers.in_context_split(train, 0, 25, 7, evaluation)
        found = as_sample(adapt.adapt(samples, source, shown)).select("source", F.lit("").alias("id") if source == "GSM8K" else F.col("id"), "question", "answer", "sf_idx", F.md5("chunks").alias("chunks"))
        out = found if out is None else out.unionByName(found)
    return out


# --- candidates, logs, files ------------------------------------------------

_CANDIDATES = _LINES + """
, b AS (SELECT r.*, answer AS c1, CASE WHEN c % 2 = 0 THEN 'hotpotqa' ELSE '2WikiMultihopQA' END AS source, n % 3 AS j FROM r)
"""


def _candidate_file(spark: SparkSession, sf_dir: str) -> str:
    more = [F.lit(',"candidates":['), _quoted(F.col("answer")), F.lit(',"wrong"],"judgements":[1,'), ((F.size("lines") % 3) - 1).cast("string"), F.lit('],"betas":[-1.0,-2.5],"source":'), _quoted(F.when(F.col("c") % 2 == 0, "hotpotqa").otherwise("2WikiMultihopQA"))]
    return _text(_raw(_lines(spark, sf_dir), *more), scratch(spark, "candidates"))


@query(_CANDIDATES + "SELECT id, chunks, sf_idx, source, answer || '|wrong' AS candidates, '1|' || (j - 1) AS judgements, '-1.0|-2.5' AS betas FROM b WHERE n >= 4")
def candidate_scan(spark, sf_dir):
    rows = adapt.candidates(readers.candidate_rows(spark, _candidate_file(spark, sf_dir), combined=True), 4)
    return rows.select("id", joined("chunks").alias("chunks"), joined("sf_idx").alias("sf_idx"), "source", joined("candidates").alias("candidates"), joined("judgements").alias("judgements"), joined("betas").alias("betas"))


@query(_CANDIDATES + "SELECT id, '1|' || (j - 1) AS judgements FROM b WHERE j <> 2")
def not_all_correct(spark, sf_dir):
    rows = filters.not_all_correct(readers.candidate_rows(spark, _candidate_file(spark, sf_dir)))
    return rows.select(F.col("_id").alias("id"), joined("judgements").alias("judgements"))


@query(_LINES + "SELECT id, CASE WHEN c % 2 = 0 THEN 'again' ELSE type END AS type, 'easy' AS level, n FROM r WHERE c % 5 <> 0")
def originals_with_candidates(spark, sf_dir):
    """Originals of two parts (the later replaces the earlier) behind their candidates."""
    raw = readers.multihop(spark, _text(_raw(_lines(spark, sf_dir)), scratch(spark, "originals"))).drop("_pos")
    chosen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    again = raw.join(chosen.where("o_custkey % 2 = 0"), F.col("_id") == F.col("id"), "left_semi").withColumn("type", F.lit("again"))
    both = joins.merged_candidates(chosen.where("o_custkey % 5 <> 0").select("id"), readers.originals([raw, again]))
    return both.select("id", "type", "level", F.size("context").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS question, c_mktsegment AS answer FROM customer")
def broken_json(spark, sf_dir):
    """Objects that follow one another without line ends, a market segment a file."""
    path = scratch(spark, "broken")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("answer"))).alias("j"))
    rows.groupBy("c_mktsegment").agg(F.array_join(F.collect_list("j"), "  ").alias("value")).select("value").repartition(5).write.text(path)
    return readers.concatenated_json(spark, path, "id string, question string, answer string")


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS f1 FROM orders GROUP BY 1")
def tolerant_log(spark, sf_dir):
    """A log written in two turns with a broken line in each; the last record of an id counts."""
    path = scratch(spark, "log")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").cast("double").alias("f1"))
    last = o.groupBy("id").agg(F.max("f1").alias("f1"))
    ordered = o.withColumn("turn", F.lit(0)).unionByName(last.withColumn("turn", F.lit(1))).withColumn("line", F.to_json(F.struct("id", "f1")))
    broken = spark.createDataFrame([(-1, '{"id": "7", "f1": '), (2, "no json")], "turn int, line string")
    ordered.select("turn", "line").unionByName(broken).orderBy("turn").coalesce(1).select(F.col("line").alias("value")).write.mode("append").text(path)
    return readers.tolerant_log(spark, path, "id string, f1 double").select("id", F.col("f1").cast("long").alias("f1"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def jsonl_round_trip(spark, sf_dir):
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    writers.jsonl(rows.where("o_orderkey % 2 = 0"), path)
    writers.append_log(rows.where("o_orderkey % 2 <> 0"), path)
    return readers.jsonl_strict(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'none' END AS n_regionkey FROM nation")
def json_array_round_trip(spark, sf_dir):
    path = scratch(spark, "array")
    writers.json_array(table(spark, sf_dir, "nation").withColumn("n_regionkey", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END")), path)
    back = readers.json_array(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return back.withColumn("n_regionkey", F.coalesce(F.col("n_regionkey").cast("string"), F.lit("none")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0")
def id_list_round_trip(spark, sf_dir):
    path = scratch(spark, "ids")
    writers.id_list(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", path)
    return spark.read.text(path)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END AS v FROM customer")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return writers.upsert(c.where("c_acctbal > 0").select("c_custkey", F.lit("new").alias("v")), "c_custkey", c.select("c_custkey", F.lit("old").alias("v")))


@query("SELECT vec_id, round(list_sum(embedding)::DOUBLE, 3) + 0.0 AS total, round(embedding[1]::DOUBLE, 6) AS se FROM embeddings")
def probe_file(spark, sf_dir):
    path = scratch(spark, "probe")
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("float")), "embedding").alias("features"), F.get("embedding", F.lit(0)).alias("se"))
    writers.probe_rows(e, path)
    return spark.read.parquet(path).select(F.get("features", F.lit(0)).cast("long").alias("vec_id"), (F.round(F.expr("aggregate(slice(features, 2, size(features) - 1), 0D, (a, x) -> a + x)"), 3) + 0.0).alias("total"), F.round(F.col("se").cast("double"), 6).alias("se"))


@query("SELECT event_id AS step, 'value' AS name, value FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'user_id', user_id FROM events")
def metric_rows(spark, sf_dir):
    return writers.metric_rows(table(spark, sf_dir, "events"), F.col("event_id"), ["value", "user_id"]).where("value IS NOT NULL")


_RATES = _LINES + ", v AS (SELECT r.*, round((c % 3) / 3.0::DOUBLE, 6) AS q, round((c % 4) / 4.0::DOUBLE, 6) AS s FROM r)"


@query(_RATES + """
SELECT id, type, CAST(n AS VARCHAR) AS chunk_count, CAST(n_sf AS VARCHAR) AS sf_count, replace(sf_idx, '|', ' ') AS sf_idx, CAST(c % 3 AS VARCHAR) AS question_only_correct, '3' AS question_only_total,
  CAST(4 - c % 4 AS VARCHAR) AS with_support_facts_failed_judge FROM v
""")  # fmt: skip
def csv_summary(spark, sf_dir):
    """Flat summaries through a CSV file: judgements of c % 3 right ones of 3, and of c % 4 of 4 (others failed)."""
    sample = adapt.with_noise(adapt.multihop(readers.multihop(spark, _text(_raw(_lines(spark, sf_dir)), scratch(spark, "rates"))), "hotpotqa"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderstatus") == "F", "bridge").when(F.col("o_orderstatus") == "O", "comparison").otherwise("bridge_comparison").alias("type"))
    mode = lambda n, rest: F.struct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.col("c") % n, 1).otherwise(rest)).alias("judgements"))
    rows = sample.join(o, "id").withColumns({"dataset": F.lit("hotpotqa"), "split": F.lit("dev"), "level": F.lit("easy"), "question_only": mode(3, 0), "with_support_facts": mode(4, -1), "question_only_success_rate": F.col("c") % 3 / 3, "with_support_facts_success_rate": F.col("c") % 4 / 4})
    path = scratch(spark, "csv")
    writers.csv(writers.success_summary(rows, full=True), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("id", "type", "chunk_count", "sf_count", F.coalesce("sf_idx", F.lit("")).alias("sf_idx"), "question_only_correct", "question_only_total", "with_support_facts_failed_judge")


@query(_LINES + "SELECT id, 'dev' AS split, sf_idx FROM r WHERE n = 4 AND n_sf = 2")
def success_samples(spark, sf_dir):
    folder = scratch(spark, "success")
    _array_text(_raw(_lines(spark, sf_dir)), f"{folder}/hotpot_dev_distractor_v1.json")
    rows = readers.success_samples(spark, folder, "hotpot", "dev", keep_nonstandard=True)
    return filters.standard_shape(rows, 4, 2).select("id", "split", joined("sf_idx").alias("sf_idx"))


@query(_LINES + "SELECT id, question, answer FROM r WHERE type <> 'bridge_comparison'")
def question_rows(spark, sf_dir):
    return readers.question_rows(readers.multihop(spark, _text(_raw(_lines(spark, sf_dir)), scratch(spark, "questions"))), "2wiki")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.multihop(readers.multihop(spark, _text(_raw(_lines(spark, sf_dir)), scratch(spark, "samples"))), "hotpotqa")


@query(_LINES + """
, z AS (SELECT l.k, coalesce(string_agg(CAST(i AS VARCHAR), '|' ORDER BY i) FILTER (t.title IS NULL), '') AS noise_idx, coalesce(string_agg(l.title || ' ' || s1 || ' ' || s2, '|' ORDER BY i) FILTER (t.title IS NOT NULL), '') AS sf_texts
  FROM l LEFT JOIN t ON t.k = l.k AND t.title = l.title GROUP BY l.k)
SELECT id, noise_idx, sf_texts, n AS chunk_count, n_sf AS sf_count FROM r JOIN z ON CAST(z.k AS VARCHAR) = r.id
""")  # fmt: skip
def success_layout(spark, sf_dir):
    return adapt.with_noise(_samples(spark, sf_dir)).select("id", joined("noise_idx").alias("noise_idx"), joined("sf_texts").alias("sf_texts"), "chunk_count", "sf_count")


@query(_LINES + "SELECT id, sf_idx AS pred_idx, n_sf AS n_q, 5 + 6 * n_sf AS text_len, 1.0::DOUBLE AS f1 FROM r WHERE n_sf > 0")
def oracle_log(spark, sf_dir):
    log = adapt.oracle_log(_samples(spark, sf_dir))
    return log.select("id", joined("pred_idx").alias("pred_idx"), F.size("q_values").alias("n_q"), "text_len", "f1")


@query("SELECT p_partkey AS id, '\\frac12' || p_size AS answer FROM part")
def extracted_answers(spark, sf_dir):
    solution = F.concat(F.lit(r"So \boxed{1} or rather \boxed{ \dfrac{1}{2} "), F.col("p_size").cast("string"), F.lit("}."))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("_pos"), solution.alias("solution"))
    return adapt.extracted_answers(rows).select("id", "answer")


@query("""
WITH t AS (SELECT range AS turn FROM range(60)), n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), g AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region)
SELECT turn, 'nation' AS source, n_name AS name FROM t JOIN n ON n.i = ((turn // 3) * 2 + turn % 3) % (SELECT count(*) FROM nation) WHERE turn % 3 < 2
UNION ALL SELECT turn, 'region', r_name FROM t JOIN g ON g.i = (turn // 3) % (SELECT count(*) FROM region) WHERE turn % 3 = 2
""")  # fmt: skip
def round_robin(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_pos"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_pos"), F.col("r_name").alias("name"))
    return adapt.round_robin({"nation": n, "region": r}, 60, {"nation": 2}).select("turn", "source", "name")


# --- text -------------------------------------------------------------------

_PART = "SELECT p_partkey, p_name AS n, p_brand AS b, p_type AS t, p_size AS s FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))


@query(f"""
SELECT p_partkey, lower(n) AS plain, b AS label, b || '. No' AS leading, 'answer: ' || b AS no_leading, n AS final, t AS marker, b AS after_thinking, t || '!' AS thinking,
  CASE WHEN p_partkey % 2 = 0 THEN n ELSE '[incomplete reasoning]' END AS reasoning, left(b, 3) || '...' AS preview, b AS short_preview, 'http://' || p_partkey AS url FROM ({_PART})
""")  # fmt: skip
def answer_parsers(spark, sf_dir):
    p = _part(spark, sf_dir)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) and x not in p.columns else F.col(x) for x in parts])
    return p.select(
        "p_partkey",
        text.normalize_plain(say(" \t", "n", " \n")).alias("plain"),
        text.strip_answer_label(say("Answer: x FINAL ANSWER: ", "b", " ")).alias("label"),
        text.strip_leading_label(say(" Final Answer: ", "b", ". No...")).alias("leading"),
        text.strip_leading_label(say("answer: ", "b", ".")).alias("no_leading"),
        text.final_answer(say("Final answer: x final ANSWER: ", "n", "..")).alias("final"),
        text.after_final_answer_marker(say("final answer: x Final answer: ", "t")).alias("marker"),
        text.after_thinking_final_answer(say("<think>final answer: no</think> Final Answer: ", "b")).alias("after_thinking"),
        text.strip_thinking(say("<think>a", "n", "</think> ", "t", "!<think>more")).alias("thinking"),
        text.discard_reasoning(F.when(F.col("p_partkey") % 2 == 0, say("<think>x</think>", "n")).otherwise(say("<think>", "n"))).alias("reasoning"),
        text.preview(F.col("b"), 3).alias("preview"),
        text.preview(F.col("b"), 100).alias("short_preview"),
        text.base_url(F.concat(F.lit("http://"), F.col("p_partkey").cast("string"), F.lit("/v1//"))).alias("url"),
    )


@query(f"""
SELECT p_partkey, '\\frac{{1}}{{' || s || '}}' AS boxed, CASE WHEN s < 10 THEN '\\frac1' || s ELSE '\\frac1{{' || s || '}}' END AS simple, n || '|' || t AS items, n || '|' || t || '||' AS fitted, t AS section, 'OK' AS status, n AS reasoning,
  b || ' [SEP] ' || n || ' [SEP] ' || t AS by_index, b || ' # ' || t || ' # ' || n AS as_chosen, 'Example: ' || n AS example, concat_ws('|', CASE WHEN s % 3 = 0 THEN 3 ELSE 0 END, CASE WHEN s % 3 <> 0 AND s % 7 = 0 THEN 4 WHEN s % 5 = 0 THEN 2 WHEN s % 2 = 0 THEN 1 END) AS refs
FROM ({_PART})
""")  # fmt: skip
def structured_parsers(spark, sf_dir):
    p = _part(spark, sf_dir)
    size = F.col("s").cast("string")
    listed = F.concat(F.lit("Answers:\n1. "), "n", F.lit(" \n 2) "), "t", F.lit("\nnone"))
    reply = F.concat(F.lit("q<|query_analysis_end|><|reasoning_start|> "), "n", F.lit(" <|reasoning_end|><|status_start|> OK <|status_end|><|answer_start|>"), "t", F.lit("<|answer_end|>"))
    told = backends.answer_status(reply)
    who = lambda n, where: F.concat(F.when(F.col("s") % n == 0, "Mary").otherwise("John"), F.lit(f" went to the {where}"))
    story = F.array(F.lit("Mary took the ball"), who(2, "kitchen"), who(5, "office"), F.when(F.col("s") % 3 == 0, "Mary dropped the ball").otherwise("Mary slept"), who(7, "kitchen"))
    return p.select(
        "p_partkey",
        text.boxed_answer(F.concat(F.lit("\\boxed{0} is \\boxed{\\frac{1}{"), size, F.lit("}} here"))).alias("boxed"),
        text.simple_latex(F.concat(F.lit("\\left \\dfrac 1{"), size, F.lit("}"))).alias("simple"),
        joined(text.numbered_items(listed)).alias("items"),
        joined(text.fitted(text.numbered_items(listed), 4)).alias("fitted"),
        text.section(reply, "<|answer_start|>", "<|answer_end|>").alias("section"),
        told["status"].alias("status"),
        told["reasoning"].alias("reasoning"),
        text.state_text(F.col("b"), F.array("n", "t"), F.array(F.lit(1), F.lit(0))).alias("by_index"),
        text.state_text(F.col("b"), F.array("n", "t"), F.array(F.lit(1), F.lit(0)), " # ", by_index=False).alias("as_chosen"),
        F.trim(text.clean_examples(F.concat(F.lit("<example> "), "n", F.lit("</example>")))).alias("example"),
        joined(text.story_references(story, F.lit("Where is the ball? "), F.array(F.lit("kitchen"), F.lit("office")))).alias("refs"),
    )


@query(f"SELECT p_partkey, 'system|user|assistant|user' AS roles, n AS first, t AS last, b AS passage_question FROM ({_PART})")
def example_turns(spark, sf_dir):
    """Examples with both parts become turns; those without a separator go."""
    p = _part(spark, sf_dir)
    shown = prompts.prepared_examples(F.array(F.concat("n", F.lit(text.SEPARATOR), "b"), F.lit("no separator")))
    m = prompts.example_messages(F.col("t"), shown)
    asked = prompts.passage_messages(F.col("b"), F.array("n"))
    question = F.substring_index(F.element_at(asked, -1)["content"], "Question: ", -1)
    return p.select("p_partkey", F.array_join(F.transform(m, lambda x: x["role"]), "|").alias("roles"), F.get(m, F.lit(1))["content"].alias("first"), F.element_at(m, -1)["content"].alias("last"), question.alias("passage_question"))


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _asked(system: str, user: str) -> str:
    """The md5 of a system and a user turn, in SQL."""
    return f"md5('system:' || {_literal(system)} || '|user:' || {user})"


_SHORT = "'GIVEN PASSAGES:\n' || {} || '\n\nQUESTION:\n' || b || '\n\nReturn only the short answer.'"


@query(f"""
SELECT p_partkey, {_asked(prompts.FACTOID, "'\n' || " + _SHORT.format("n || '\n\n---\n\n' || t"))} AS reader,
  {_asked(prompts.FACTOID, "'\n' || " + _SHORT.format("n || '\n\n' || t"))} AS reward, {_asked(prompts.FACTOID, _SHORT.format("n || '\n\n' || t"))} AS unled,
  {_asked(prompts.QA, "'CONTEXT:\n' || n || '\n' || t || '\n\nQUESTION:\n' || b || '\n\nFinal Answer:'")} AS chat,
  {_asked(prompts.JUDGE, "'QUESTION: ' || b || '\nPREDICTED ANSWER: ' || n || '\nGROUNDTRUTH ANSWER: ' || t")} AS judged,
  {_asked(prompts.CONCISE, _literal(prompts.BY_DOCUMENTS) + " || n || '\n' || t || '\nQuestion: ' || b")} AS documents, {_asked(prompts.CONCISE, _literal(prompts.BY_KNOWLEDGE) + " || 'Question: ' || b")} AS alone,
  {_asked(prompts.QA, "'Below are passages you should use:\n\n' || n || '\n\n' || t || '\n\nQuestion: ' || b")} AS passages,
  {_asked(prompts.STORY, "'From ' || n || ' ' || t || ' tell: ' || b")} AS story, md5({_literal(prompts.SHORT_REASONS)}) AS occ,
  md5(CASE s % 4 WHEN 0 THEN {_literal(prompts.GSM8K)} WHEN 1 THEN {_literal(prompts.MATH)} WHEN 2 THEN {_literal(prompts.QA)} ELSE {_literal(prompts.MMLU_PRO)} END) AS by_task
FROM ({_PART})
""")  # fmt: skip
def prompt_layouts(spark, sf_dir):
    """Every builder's turns, whole."""
    p = _part(spark, sf_dir)
    b, n, t, chunks = F.col("b"), F.col("n"), F.col("t"), F.array("n", "t")
    whole = lambda m: F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))
    task = F.element_at(F.array(*map(F.lit, ("GSM8K", "MATH", "Musique", "MMLU-Pro"))), (F.col("s") % 4 + 1).cast("int"))
    return p.select(
        "p_partkey", whole(prompts.reader_messages(b, chunks)).alias("reader"), whole(prompts.reward_messages(b, chunks, True)).alias("reward"), whole(prompts.reward_messages(b, chunks, False)).alias("unled"),
        whole(prompts.chat_messages(b, chunks)).alias("chat"), whole(prompts.judge_messages(b, n, t)).alias("judged"), whole(prompts.document_messages(b, chunks)).alias("documents"),
        whole(prompts.document_messages(b, F.array().cast("array<string>"))).alias("alone"), whole(prompts.passage_messages(b, chunks)).alias("passages"),
        whole(prompts.story_messages(b, chunks, " From {context} tell: {question}\n")).alias("story"), F.md5(F.lit(prompts.SHORT_REASONS)).alias("occ"), F.md5(prompts.system_text(task)).alias("by_task"),
    )


# --- metrics, filters, rewards ------------------------------------------------


@query(f"""
SELECT p_partkey, round(2.0::DOUBLE / 3, 6) AS f1, 1.0::DOUBLE AS em, 1 AS last_word, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS contains_correct,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS equals_correct, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS starts_yes, 0.0::DOUBLE AS empty_f1 FROM ({_PART})
""")  # fmt: skip
def answer_checks(spark, sf_dir):
    p, k = _part(spark, sf_dir), F.col("p_partkey")
    m = metrics.support_text_metrics(F.array(F.concat(F.lit("The "), "b"), F.lit("other"), F.concat("b", F.lit("!"))), F.array("b"))
    return p.select(
        "p_partkey", F.round(m["f1"], 6).alias("f1"), m["em"].alias("em"),
        metrics.last_word_match(F.concat(F.lit("It is x,"), k.cast("string"), F.lit(".")), F.concat(k.cast("string"), F.lit(",x"))).alias("last_word"),
        metrics.exact_share(F.array(F.concat(F.lit("a "), "b"), F.when(k % 2 == 0, F.upper("b")).otherwise(F.lit("-"))), F.col("b")).alias("share"),
        metrics.judged_contains_correct(F.when(k % 2 == 0, "so correct").otherwise("incorrect")).alias("contains_correct"),
        metrics.judged_equals_correct(F.when(k % 3 == 0, " CORRECT ").otherwise("CORRECT.")).alias("equals_correct"),
        metrics.judged_starts_yes(F.when(k % 5 == 0, " Yes, it is").otherwise("no yes")).alias("starts_yes"),
        metrics.token_scores(F.lit(" "), F.lit("the"), empties="zero")["f1"].alias("empty_f1"),
    )


def _filtered(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:
    log = _log(spark, sf_dir).withColumns({"pred_texts": F.transform("pred_idx", lambda i: i.cast("string")), "sf_texts": F.transform("sf_idx", lambda i: i.cast("string"))})
    kept = filters.filter_chunks(log, filters.chunk_filter(name, **how))
    return kept.select("sample_id", joined("filtered_idx").alias("idx"), F.size("filtered_texts").alias("n"))


@query(_SCORED + "SELECT sample_id, array_to_string(pred_idx, '|') AS idx, len(pred_idx) AS n FROM logged")
def chunk_filter_none(spark, sf_dir):
    return _filtered(spark, sf_dir, "none")


@query(_SCORED + "SELECT sample_id, array_to_string(sf_idx, '|') AS idx, len(sf_idx) AS n FROM logged")
def chunk_filter_gt(spark, sf_dir):
    return _filtered(spark, sf_dir, "gt")


@query(_SCORED + "SELECT sample_id, array_to_string(list_slice(pred_idx, 1, 3), '|') AS idx, least(len(pred_idx), 3) AS n FROM logged")
def chunk_filter_retrieval_step(spark, sf_dir):
    return _filtered(spark, sf_dir, "retrieval_step", steps=3)


@query(_SCORED + "SELECT sample_id, array_to_string(list_sort(pred_idx), '|') AS idx, array_to_string(list_transform(list_sort(pred_idx), lambda i: 't' || i), '|') AS texts FROM logged")
def chunks_by_index(spark, sf_dir):
    both = filters.by_index(F.col("pred_idx"), F.transform("pred_idx", lambda i: F.concat(F.lit("t"), i.cast("string"))))
    return _log(spark, sf_dir).select("sample_id", joined(both["idx"]).alias("idx"), F.array_join(both["texts"], "|").alias("texts"))


@query(_SCORED + "SELECT sample_id, CASE WHEN len(list_filter(sf_idx, lambda g: NOT list_contains(pred_idx, g))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, CASE WHEN sample_id % 100 = 0 THEN 0.0::DOUBLE WHEN len(list_filter(sf_idx, lambda g: NOT list_contains(pred_idx, g))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS at_end FROM logged")
def legacy_ground_truth(spark, sf_dir):
    step = F.when(F.col("sample_id") % 100 == 0, 1).otherwise(5)
    pred, gold = F.col("pred_idx"), F.col("sf_idx")
    return _log(spark, sf_dir).select("sample_id", rewards.ground_truth_at_end(pred, gold, step, 5).alias("hit"), rewards.ground_truth_at_end(pred, gold, step, 5, only_last=True).alias("at_end"))


@query(f"""
SELECT p_partkey, CASE WHEN s % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS facts, round(2.0::DOUBLE * (s - 10), 6) AS shift, 1.0::DOUBLE AS em, 0.0::DOUBLE AS not_final, round(2.0::DOUBLE / 3, 6) AS f1, 1.0::DOUBLE AS matched,
  CASE WHEN s % 3 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS judged, s >= 25 AS completed, CASE WHEN s % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answerable, 1.0::DOUBLE AS legacy, 0.0::DOUBLE AS nothing FROM ({_PART})
""")  # fmt: skip
def answer_rewards(spark, sf_dir):
    p, s = _part(spark, sf_dir), F.col("s")
    status = F.when(s % 2 == 0, " Answerable ").otherwise("UNANSWERABLE")
    return p.select(
        "p_partkey",
        rewards.fact_texts_found(F.concat_ws(" [SEP] ", "b", F.when(s % 2 == 0, F.col("n"))), F.array(F.concat("b", F.when(s % 2 == 0, F.concat(F.lit(" [SEP] "), "n")).otherwise(F.lit("#none#"))))).alias("facts"),
        F.round(rewards.gold_shift(s.cast("double"), F.lit(10.0), 2.0), 6).alias("shift"),
        rewards.answer_match(F.concat(F.lit("<think>x</think>The "), "b"), F.col("b"), F.lit(True)).alias("em"),
        rewards.answer_match(F.col("b"), F.col("b"), F.lit(False)).alias("not_final"),
        F.round(rewards.answer_match(F.lit("red car"), F.lit("red"), F.lit(True), "f1"), 6).alias("f1"),
        rewards.matched_or_judged(F.concat(F.lit("Final answer: "), "b", F.lit(".")), F.lower("b"), F.lit(0)).alias("matched"),
        rewards.matched_or_judged(F.lit("x"), F.lit("y"), F.when(s % 3 == 2, 1).when(s % 3 == 1, 0)).alias("judged"),
        rewards.metric_reward(s.cast("double"), 25.0)["completed"].alias("completed"),
        rewards.answerable(status).alias("answerable"), rewards.answerable(status, legacy=True).alias("legacy"), rewards.nothing().alias("nothing"),
    )


_STEPS = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, abs(coalesce(value, 0)) / (1 + abs(coalesce(value, 0))) AS p, event_type = 'purchase' AS last FROM events"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, size = table(spark, sf_dir, "events"), F.abs(F.coalesce("value", F.lit(0.0)))
    return e.select(F.col("user_id").alias("episode"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), (size / (1 + size)).alias("p"), (F.col("event_type") == "purchase").alias("is_final"))


@query(f"""
SELECT event_id, round(2 * (1 - p), 5) AS penalty, CASE WHEN p < 0.5 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS threshold, CASE WHEN last THEN round(2 * (1 - p), 5) ELSE 0.0::DOUBLE END AS final_only,
  round(CASE WHEN p > 0.5 THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step), 0), 5) AS newly FROM ({_STEPS})
""")  # fmt: skip
def uncertainty_modes(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    a = rewards.uncertainty(steps, "uncertainty_penalty", 2.0).withColumnRenamed("reward", "penalty")
    a = rewards.uncertainty(a, "uncertainty_threshold", 2.0).withColumnRenamed("reward", "threshold")
    a = rewards.uncertainty(a, "uncertainty_penalty", 2.0, only_final=True).withColumnRenamed("reward", "final_only")
    a = rewards.newly_found(a, (F.col("p") > 0.5).cast("int"))
    return a.select("event_id", F.round("penalty", 5).alias("penalty"), "threshold", F.round("final_only", 5).alias("final_only"), F.col("reward").alias("newly"))


@query(f"""
SELECT event_id, round(p + 0.99 * 0.5 * p, 5) AS target, round(0.5 * pow(2 * p - 1, 2) + 0.5 * pow(2 * (1 - p) - 1, 2), 5) AS loss, round(least(p, 1 - p), 5) AS value, round(CASE WHEN p > 0 THEN 2 * p ELSE 0 END, 5) AS summed,
  CASE WHEN event_id % 2 = 0 THEN round(-p - 1.5, 5) ELSE -9.0::DOUBLE END AS prompt_logp, round((-p - 1.5) / 2, 5) AS token_logp FROM ({_STEPS})
""")  # fmt: skip
def value_arithmetic(spark, sf_dir):
    p = F.col("p")
    tokens = F.array(F.array(F.struct(F.lit(1).alias("id"), F.lit(-7.0).alias("logprob"))), F.array(F.struct(F.lit(2).alias("id"), (-p).alias("logprob"))), F.array(F.struct(F.lit(3).alias("id"), F.when(F.col("event_id") % 2 == 0, -1.5).alias("logprob"))))
    return _steps(spark, sf_dir).select(
        "event_id", F.round(vectors.bootstrap_target(p, F.lit(0.5), p, 0.99), 5).alias("target"), F.round(vectors.twin_loss(p, 1 - p, F.lit(1.0)), 5).alias("loss"),
        F.round(vectors.twin_value(p, 1 - p), 5).alias("value"), F.round(vectors.twin_value(p, p, "sum"), 5).alias("summed"),
        F.round(F.coalesce(vectors.prompt_logprob(tokens, F.lit(1)), F.lit(-9.0)), 5).alias("prompt_logp"), F.round(vectors.token_logprob(F.array(-p, F.lit(-1.5))), 5).alias("token_logp"),
    )


@query("SELECT round(avg(CAST(o_totalprice > 150000 AS INTEGER)), 5) AS em, round(avg(o_totalprice / 1000), 5) AS f1, round(avg(CAST(o_totalprice > 250000 AS INTEGER)), 5) AS judge FROM orders")
def reader_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_totalprice") > 150000).cast("int").alias("EM"), (F.col("o_totalprice") / 1000).alias("F1"), (F.col("o_totalprice") > 250000).cast("double").alias("LLM_Judge_Score"))
    return aggregates.reader_summary(rows).select(*[F.round(c, 5).alias(c) for c in ("em", "f1", "judge")])


@query(_SCORED + """
, m AS (SELECT len(list_intersect(pred_idx, sf_idx)) AS tp, * FROM logged)
SELECT round(avg(CASE WHEN sample_id % 100 = 0 THEN 0.25 WHEN len(sf_idx) = 0 AND len(pred_idx) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (len(pred_idx) + len(sf_idx)) END), 6) AS f1,
  round(avg(CASE WHEN sample_id % 100 = 0 THEN 1.0 WHEN tp = len(sf_idx) THEN 1.0 ELSE 0.0 END), 6) AS em FROM m
""")  # fmt: skip
def metric_summary(spark, sf_dir):
    stored = F.col("sample_id") % 100 == 0
    rows = _log(spark, sf_dir).withColumns({"f1": F.when(stored, 0.25), "em": F.when(stored, 1.0)})
    return aggregates.metric_summary(rows).select(F.round("f1", 6).alias("f1"), F.round("em", 6).alias("em"))


@query("SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS correct, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def mode_counts(spark, sf_dir):
    judged = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0)
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(judged).alias("j"))
    return rows.select("id", aggregates.mode_counts(F.col("j")).alias("c")).select("id", "c.*")


# --- ranking and sampling -----------------------------------------------------


@query(_SCORED + "SELECT sample_id, chunk_idx, cos AS score, cos_rank AS rank FROM r WHERE cos_rank <= 3")
def exploring_never(spark, sf_dir):
    """Without exploration the best come out."""
    return ranking.exploring(ranking.top_by_score(_pairs(spark, sf_dir), 49), 0.0, 1, 3)


@query("""
WITH e AS (SELECT vec_id - vec_id % 50 AS sample_id, vec_id AS chunk_idx, CAST('0x' || md5(concat_ws(':', 2, vec_id - vec_id % 50, vec_id))[1:13] AS BIGINT) AS h FROM embeddings
  WHERE vec_id % 50 <> 0 AND vec_id - vec_id % 50 IN (SELECT vec_id FROM embeddings))
SELECT sample_id, chunk_idx, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY h, chunk_idx) AS INTEGER) AS rank FROM e) WHERE rank <= 5
""")  # fmt: skip
def exploring_always(spark, sf_dir):
    """With full exploration five random chunks, none twice."""
    return ranking.exploring(ranking.top_by_score(_pairs(spark, sf_dir), 49), 1.0, 1, 5).select("sample_id", "chunk_idx", "rank")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopsmith.queries import _vectors

    return ranking.scored(*_vectors(spark, sf_dir), "cosine", digits=6)


@query(_SCORED + "SELECT sample_id, chunk_idx, cos AS score FROM r WHERE cos_rank = 2")
def best_remaining(spark, sf_dir):
    """The best chunk once the first is taken."""
    rows = _episodes(spark, sf_dir).withColumn("first", episodes.best_remaining(F.col("query"), F.col("vectors"), F.array().cast("array<int>"))["idx"])
    second = episodes.best_remaining(F.col("query"), F.col("vectors"), F.array("first"))
    return rows.withColumn("s", second).select(F.col("id").cast("long").alias("sample_id"), F.get("chunks", F.col("s.idx")).cast("long").alias("chunk_idx"), F.round("s.score", 6).alias("score"))


@query("SELECT vec_id, round(1.0::DOUBLE / 63, 6) AS each, 0.0::DOUBLE AS masked, CAST(list_position(list_slice(embedding, 2, 64), list_max(list_slice(embedding, 2, 64))) AS INTEGER) AS greedy FROM embeddings")
def policies(spark, sf_dir):
    """A uniform policy and the best action with the first action masked."""
    e = table(spark, sf_dir, "embeddings")
    open_ = F.transform("embedding", lambda x, i: i > 0)
    uniform = vectors.uniform_policy(open_)
    return e.select("vec_id", F.round(F.get(uniform, F.lit(5)), 6).alias("each"), F.get(uniform, F.lit(0)).alias("masked"), vectors.greedy(F.col("embedding"), open_).alias("greedy"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS turned_norm, 1.0::DOUBLE AS unit_norm,
  round(list_sum(list_transform(list_slice(embedding, 1, 32), lambda x: CAST(x AS DOUBLE) * x)), 4) AS q1, round(list_sum(list_transform(list_slice(embedding, 33, 64), lambda x: CAST(x AS DOUBLE) * x)), 4) AS q2, 0.0::DOUBLE AS clamped FROM embeddings
""")  # fmt: skip
def vector_heads(spark, sf_dir):
    """Turning keeps lengths; the halves' products; a negative similarity is no reward."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    twin = vectors.twin_dot(F.col("v"), F.col("v"))
    return e.select("vec_id", F.round(vectors.norm(vectors.rotated(F.col("v"), F.col("vec_id") % 7)), 4).alias("turned_norm"), F.round(vectors.norm(vectors.unit(F.col("v"))), 6).alias("unit_norm"), F.round(twin["q1"], 4).alias("q1"), F.round(twin["q2"], 4).alias("q2"), vectors.similarity_reward(F.col("v"), F.transform("v", lambda x: -x)).alias("clamped"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500 OFFSET 100")
def window_of_rows(spark, sf_dir):
    return ranking.window_of(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, 600, "event_id")


@query("SELECT 'first' AS how, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 40) UNION ALL SELECT 'random', 40, CAST(sum(event_id) AS BIGINT) FROM (SELECT event_id FROM events ORDER BY CAST('0x' || md5(concat_ws(':', 3, event_id))[1:13] AS BIGINT), event_id LIMIT 40) UNION ALL SELECT 'all', count(*), CAST(sum(event_id) AS BIGINT) FROM events UNION ALL SELECT 'none', 0, 0 UNION ALL SELECT 'shuffled', count(*), CAST(sum(event_id) AS BIGINT) FROM events")
def chosen_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    told = lambda how, df, s=None: df.agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.coalesce(F.sum("event_id") if s is None else s, F.lit(0)).alias("s"))
    random = ranking.chosen_rows(e, 40, 3, "event_id")
    parts = [told("first", ranking.chosen_rows(e, 40, None, "event_id")), told("random", random), told("all", ranking.limited(e, 0, True, "event_id")), told("none", ranking.limited(e, 0, False, "event_id")), told("shuffled", ranking.shuffled(e, 5, "event_id"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer),
d AS (SELECT range AS episode, CAST('0x' || md5(concat_ws(':', 9, range))[1:13] AS BIGINT) % (SELECT count(*) FROM customer) AS r FROM range(3000))
SELECT episode, c_custkey FROM d JOIN c USING (r)
""")  # fmt: skip
def drawn_with_replacement(spark, sf_dir):
    return ranking.drawn_with_replacement(table(spark, sf_dir, "customer").select("c_custkey"), 3000, 9, "c_custkey")


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r % 7 = 0")
def every_nth(spark, sf_dir):
    return ranking.every_nth(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 7, "c_custkey")


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total FROM (SELECT l_orderkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) WHERE s <= 90 GROUP BY 1")
def within_budget(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", place)
    return ranking.within_budget(rows, 90, F.col("l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


def _draw(seed: int, *keys: str) -> str:
    """The engine's draw (``vectors.draw``) in SQL."""
    return f"CAST('0x' || md5(concat_ws(':', {seed}, {', '.join(keys)}))[1:13] AS BIGINT)"


def _uniform(seed: int, *keys: str) -> str:
    return f"({_draw(seed, *keys)} / 4503599627370496.0::DOUBLE)"


def _shuffled(values: str, seed: int) -> str:
    """A list's numbers by their draws."""
    return f"list_transform(list_sort(list_transform({values}, lambda i: {{'h': {_draw(seed, 'c_custkey', 'i')}, 'i': i}})), lambda s: s.i)"


@query(f"""
WITH c AS (SELECT c_custkey, c_name, list_sort({_shuffled('range(8)', 3)}[1:3]) AS spots FROM customer),
p AS (SELECT c_custkey, CAST(floor({_uniform(6, 'c_custkey')} * 3) AS INTEGER) AS n, {_shuffled('[1, 4]', 5)} AS support, {_shuffled('[0, 2, 3, 5]', 5)} AS rest FROM customer),
m AS (SELECT c_custkey, list_sort(list_transform(range(1, 6), lambda i: CAST(floor({_uniform(2, 'c_custkey', 'i')} * 28) AS INTEGER))) AS indents, {_shuffled('range(1, 11)', 3)}[1:4] AS cuts FROM customer)
SELECT c_custkey, array_to_string(spots, '|') AS facts_idx,
  array_to_string(list_transform(range(8), lambda i: CASE WHEN list_contains(spots, i) THEN 'f' || len(list_filter(spots, lambda x: x < i)) || ' ' || c_name ELSE 'n' || (i - len(list_filter(spots, lambda x: x < i))) END), '|') AS chunks,
  array_to_string(list_transform(range(12), lambda i: i + indents[1 + len(list_filter(cuts, lambda x: x <= i))]), '|') AS places,
  array_to_string(list_transform(list_sort(list_concat(support[1:n], rest[1:3 - n])), lambda i: chr(97 + CAST(i AS INTEGER))), ' ') AS picked,
  array_to_string(range(c_custkey % 5 + 1), '|') AS absolute
FROM c JOIN p USING (c_custkey) JOIN m USING (c_custkey)
""")  # fmt: skip
def interleaving(spark, sf_dir):
    """Facts at drawn places among noise, positions moved on by drawn indents, and a partial context of three chunks."""
    key = F.col("c_custkey")
    facts, noise = F.array(*[F.concat(F.lit(f"f{i} "), "c_name") for i in range(3)]), F.array(*[F.lit(f"n{i}") for i in range(5)])
    mixed = ranking.interleaved(facts, noise, 3, key)
    moved = ranking.random_positions(F.lit(12), 40, 2, key)
    partial = ranking.partial_context(F.array(*map(F.lit, "abcdef")), F.array(F.lit(1), F.lit(4)), 3, 5, key)
    absolute = vectors.absolute_positions((key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", joined(mixed["facts_idx"]).alias("facts_idx"), joined(mixed["chunks"]).alias("chunks"), joined(moved).alias("places"), partial.alias("picked"), joined(absolute).alias("absolute"))


@query("""
WITH c AS (SELECT c_custkey, c_name, c_custkey % 5 + 3 AS n, [c_custkey % 3, c_custkey % 3 + c_custkey % 2 + 1] AS chosen FROM customer),
e AS (SELECT *, list_concat(list_sort(chosen), [n]) AS ends FROM c)
SELECT c_custkey, array_to_string(list_transform(range(n), lambda i: round(
    coalesce(list_max(list_filter(ends, lambda x: x <= i)) * 0 + (i - list_max(list_filter(ends, lambda x: x <= i))) * 9.0::DOUBLE / nullif(list_min(list_filter(ends, lambda x: x > i)) - list_max(list_filter(ends, lambda x: x <= i)) - 1, 0),
      CASE WHEN len(list_filter(ends, lambda x: x <= i)) = 0 THEN coalesce(i * 9.0::DOUBLE / nullif(list_min(ends) - 1, 0), 0.0::DOUBLE) ELSE 0.0::DOUBLE END)
    + 10.0::DOUBLE * len(list_filter(ends, lambda x: x <= i)), 6)), '|') AS places,
  c_custkey || '|' || c_name || '|x' AS gathered FROM e
""")  # fmt: skip
def relative_positions(spark, sf_dir):
    """Positions between two chosen indices, which differ by customer; texts by index, from the end as well."""
    key = F.col("c_custkey")
    first = (key % 3).cast("int")
    places = vectors.relative_positions((key % 5 + 3).cast("int"), F.array(first, (first + key % 2 + 1).cast("int")))
    gathered = joins.texts_at(F.array(F.col("c_name"), F.lit("x"), key.cast("string")), F.array(F.lit(-1), F.lit(0), F.lit(1)))
    return table(spark, sf_dir, "customer").select("c_custkey", joined(F.transform(places, lambda x: F.round(x, 6))).alias("places"), joined(gathered).alias("gathered"))


@query(f"""
WITH b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS book, n_name FROM nation),
p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, unnest(range(8)) AS d FROM customer),
x AS (SELECT id, d, {_draw(4, 'id', 'd')} % (SELECT count(*) FROM nation) AS book, CAST(floor({_uniform(5, 'id', 'd')} * 40) AS INTEGER) AS start FROM p),
s AS (SELECT id, d, start, n_name, unnest(range(start + 1, least(start + 10, 40) + 1)) AS i FROM x JOIN b USING (book)),
r AS (SELECT id, n_name || ' ' || i AS sentence, row_number() OVER (PARTITION BY id ORDER BY d, i) AS place FROM s)
SELECT id, string_agg(sentence, '|' ORDER BY place) AS noise FROM r WHERE place <= 12 GROUP BY id
""")  # fmt: skip
def noise_sentences(spark, sf_dir):
    """Noise for each customer from books that nations stand for."""
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("book_id"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat("n_name", F.lit(" "), i.cast("string"))).alias("sentences"))
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return ranking.noise_sentences(books, samples, 12, 4, most=10).select("id", joined("noise").alias("noise"))


@query(f"""
WITH p AS (SELECT p_partkey, {_draw(7, 'p_partkey')} AS h FROM part), r AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS k FROM p),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_draw(5, 'o_orderkey')}, o_orderkey) - 1 AS place FROM orders)
SELECT 'example' AS what, p_partkey AS key, CAST(-1 AS BIGINT) AS place FROM r WHERE k <= 7
UNION ALL SELECT 'sample', p_partkey, -1 FROM (SELECT p_partkey FROM r WHERE k > 7 ORDER BY h, p_partkey LIMIT 40)
UNION ALL SELECT 'shuffled', o_orderkey, place FROM o
""")  # fmt: skip
def disjoint_split(spark, sf_dir):
    """Disjoint examples and samples of parts, and orders in a random order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_pos"))
    samples, shown = readers.in_context_split(parts, 40, 7, 7)
    told = lambda df, what: df.select(F.lit(what).alias("what"), F.col("_pos").alias("key"), F.lit(-1).cast("long").alias("place"))
    orders = numbered(ranking.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), 5, "o_orderkey").withColumn("_at", F.monotonically_increasing_id()), "_at", into="place")
    return told(samples, "sample").unionByName(told(shown, "example")).unionByName(orders.select(F.lit("shuffled").alias("what"), F.col("o_orderkey").alias("key"), "place"))


# --- clusters, probes, models -------------------------------------------------


#: Four items of a customer match by their numbers; a match needs both directions.
_CELL = "CASE WHEN i = j THEN 1.0::DOUBLE ELSE ((k * (7 * i + 3 * j + 5)) % 11) / 11.0::DOUBLE END"


@query(f"""
WITH n AS (SELECT c_custkey AS k, unnest(range(4)) AS i FROM customer),
c AS (SELECT a.k, a.i, b.i AS j FROM n a JOIN n b ON a.k = b.k),
s AS (SELECT k, i, j, {_CELL} AS v FROM c),
e AS (SELECT x.k, x.i, x.j FROM s x JOIN s y ON x.k = y.k AND x.i = y.j AND x.j = y.i WHERE x.v > 0.35 AND y.v > 0.35),
r1 AS (SELECT k, i, min(j) AS r FROM e GROUP BY k, i),
r2 AS (SELECT e.k, e.i, min(r.r) AS r FROM e JOIN r1 r ON e.k = r.k AND e.j = r.i GROUP BY e.k, e.i),
r3 AS (SELECT e.k, e.i, min(r.r) AS r FROM e JOIN r2 r ON e.k = r.k AND e.j = r.i GROUP BY e.k, e.i),
g AS (SELECT a.k, a.i, count(DISTINCT b.r) FILTER (b.r < a.r) AS c FROM r3 a JOIN r3 b ON a.k = b.k GROUP BY a.k, a.i),
m AS (SELECT k, bool_or(i = 0 AND j = 1) AS m01, bool_or(i = 0 AND j = 2) AS m02, bool_or(i = 0 AND j = 3) AS m03, bool_or(i = 1 AND j = 2) AS m12, bool_or(i = 1 AND j = 3) AS m13, bool_or(i = 2 AND j = 3) AS m23 FROM e GROUP BY k),
l1 AS (SELECT *, CASE WHEN m01 THEN 0 ELSE 1 END AS c1 FROM m),
l2 AS (SELECT *, CASE WHEN m02 THEN 0 WHEN c1 = 1 AND m12 THEN 1 ELSE 1 + c1 END AS c2, NOT m02 AND NOT (c1 = 1 AND m12) AS lead2 FROM l1),
l3 AS (SELECT *, CASE WHEN m03 THEN 0 WHEN c1 = 1 AND m13 THEN 1 WHEN lead2 AND m23 THEN c2 ELSE 1 + c1 + CAST(lead2 AS INTEGER) END AS c3 FROM l2)
SELECT l3.k AS c_custkey, (SELECT string_agg(CAST(g.c AS VARCHAR), '|' ORDER BY g.i) FROM g WHERE g.k = l3.k) AS mutual, '0|' || c1 || '|' || c2 || '|' || c3 AS leaders FROM l3
""")  # fmt: skip
def answer_clusters(spark, sf_dir):
    """Four items a customer, whose entailments follow from its number, by connected matches and by leaders."""
    items = F.sequence(F.lit(0), F.lit(3))
    value = lambda i, j: F.when(i == j, 1.0).otherwise(((F.col("k") * (7 * i + 3 * j + 5)) % 11) / 11.0)
    square = F.transform(items, lambda i: F.transform(items, lambda j: value(i, j)))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("c_custkey"), square.alias("s"))
    above = F.transform("s", lambda r: F.transform(r, lambda x: x > 0.35))
    return rows.select("c_custkey", joined(uncertainty.mutual_clusters(F.col("s"), F.lit(0.35))).alias("mutual"), joined(uncertainty.leader_clusters(above)).alias("leaders"))


@query("SELECT vec_id, CAST(CASE WHEN CAST(embedding[1] AS DOUBLE) > 0.0 THEN 1 ELSE 0 END AS INTEGER) AS label, CAST(CASE WHEN CAST(embedding[1] AS DOUBLE) > (SELECT quantile_cont(CAST(embedding[1] AS DOUBLE), 0.5) FROM embeddings) THEN 1 ELSE 0 END AS INTEGER) AS by_median FROM embeddings")
def probe_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("se"))
    by_median = aggregates.probe_labels(e, 1e9).select("vec_id", F.col("label").alias("by_median"))
    return aggregates.probe_labels(e, 0.0).join(by_median, "vec_id").select("vec_id", "label", "by_median")


@query("SELECT 1.0::DOUBLE AS auc_reached, true AS better_than_chance")
def probe_fit(spark, sf_dir):
    """A probe of whether the first component is positive, tested on other vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("features"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("label"))
    _, accuracy, auc = aggregates.fit_probe(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"))
    return spark.createDataFrame([(float(auc > 0.8), accuracy > 0.5)], "auc_reached double, better_than_chance boolean")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, len(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS n_tokens, 1.0::DOUBLE AS norm, 1.0::DOUBLE AS entails, 1 AS judgement, round(-0.1::DOUBLE * len(list_filter(string_split(p_name, ' '), lambda w: w <> '')), 6) AS logp, 16 AS n_hidden, 'seen' AS kept FROM part")
def backend_contracts(spark, sf_dir):
    """Every model call of the contract, with the stub: tokens, embedding, entailment, judgement, score, features, results of a table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"))
    p = p.withColumns({"premise": F.col("text"), "hypothesis": F.col("text"), "question": F.col("text"), "prediction": F.col("text"), "answer": F.upper("text"), "messages": prompts.messages("s", F.col("text"))})
    done = backends.judged(backends.entailed(backends.embedded(backends.tokenized(p, "text"), "text")))
    done = backends.hidden_features(backends.text_logp(done, "messages", "text"), "text")
    outputs = p.select("id", F.lit("seen").alias("kept"))
    done = backends.from_table(done, outputs, ["id"])
    return done.select("id", F.size("tokens").alias("n_tokens"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), "entails", "judgement", F.round("logp", 6).alias("logp"), F.size("features").alias("n_hidden"), "kept")


class _Failing(backends.StubBackend):
    def embed(self, texts: list[str]) -> list[list[float]]:
        raise ConnectionError("no model")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, true AS no_result, true AS said_why FROM part")
def failing_backend(spark, sf_dir):
    """Rows of a backend that fails stay, with null results and the reason."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"))
    done = backends.embedded(p, "text", make=_Failing, tries=2, error="why")
    return done.select("id", F.col("embedding").isNull().alias("no_result"), F.contains("why", F.lit("no model")).alias("said_why"))


class _Searching(backends.StubBackend):
    """Searches for the question's words until there is information, then answers."""

    def generate(self, messages: list, n: int) -> list[list[str]]:
        return [["<answer>found</answer>" if "<information>" in m[-1]["content"] else f"<search>{m[-1]['content']}</search>"] * n for m in messages]


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'found' AS generated_answer, '0' AS pred_idx, 1 AS num_steps, p_name AS read FROM part")
def search_agent_run(spark, sf_dir):
    """One search per part, which finds the chunk that holds its name, then the answer."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.array("p_name", F.lit("zzz qqq")).alias("chunks"))
    p = backends.embedded(p.withColumn("first", F.get("chunks", F.lit(0))), "first").withColumnRenamed("embedding", "e0")
    p = backends.embedded(p.withColumn("second", F.get("chunks", F.lit(1))), "second").withColumn("vectors", F.array("e0", "embedding")).drop("e0", "embedding", "first", "second")

    def stored(df: DataFrame) -> DataFrame:
        path = scratch(spark, "turn")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    done = search_agent.run(p, 2, stored, make=_Searching)
    return done.select("id", "generated_answer", joined("pred_idx").alias("pred_idx"), "num_steps", F.get("search_steps", F.lit(0))["chunk_text"].alias("read"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def refuse_duplicates(spark, sf_dir):
    """Unique keys pass; repeated ones are refused."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    try:
        filters.refuse_duplicates(o, ["o_custkey"])
    except ValueError:
        return filters.refuse_duplicates(o, ["o_orderkey"])
    raise AssertionError("repeated keys went through")
