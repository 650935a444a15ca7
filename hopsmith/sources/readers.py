"""Readers of QA records. Schemas are explicit; broken lines fail unless said otherwise.

Readers add ``_pos``, the place of a row, where later steps need an order: files are
ranked by name and rows within a file by where they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopsmith import schemas
from hopsmith.functions import text as T
from hopsmith.functions.vectors import draw
from hopsmith.operators.numbering import numbered
from hopsmith.sources import arrays


def with_position(df: DataFrame) -> DataFrame:
    """``_pos`` rises in reading order; gaps are possible."""
    return df.withColumn("_pos", F.monotonically_increasing_id())


def jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def jsonl_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; a blank line is an error."""
    lines = spark.read.text(path)
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Arrays of objects, one a file, read by byte ranges; anything else is an error."""
    return arrays.json_array(spark, path, schema).drop("_pos")


def concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that follow one another, with or without line ends, read by byte ranges."""
    return arrays.concatenated_json(spark, path, schema).drop("_pos")


def latest_by_id(df: DataFrame, key: Column | str = "id", order: str = "_pos") -> DataFrame:
    """The last record of each id, which is compared as text."""
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(*df.columns)
    return df.groupBy(key.cast("string").alias("_key")).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def tolerant_log(spark: SparkSession, path: str, schema: str = schemas.RETRIEVER_LOG) -> DataFrame:
    """A log whose broken lines are dropped; the last record of an id counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")
    return latest_by_id(with_position(rows)).drop("_pos")


def typed_multihop(df: DataFrame) -> DataFrame:
    """Mixed arrays (title beside sentences or number) as structs."""
    context = F.transform("context", lambda c: F.struct(c[0].alias("title"), F.from_json(c[1], "array<string>").alias("sentences")))
    support = F.transform("supporting_facts", lambda c: F.struct(c[0].alias("title"), c[1].cast("int").alias("sent_id")))
    return df.withColumns({"context": context, "supporting_facts": support})


def multihop(spark: SparkSession, path: str | list[str], array: bool = False, schema: str = schemas.MULTIHOP_RAW) -> DataFrame:
    rows = arrays.json_array(spark, path, schema) if array else with_position(jsonl(spark, path, schema))
    return typed_multihop(rows)


def hash_order(seed: int, *keys: str) -> list[Column]:
    """A repeatable random order of rows."""
    return [draw(seed, *keys), *[F.col(k) for k in keys]]


def first_rows(df: DataFrame, length: int | None, *order: Column | str) -> DataFrame:
    """The first ``length`` rows in an order; None or a negative length: all."""
    return df if length is None or length < 0 else df.orderBy(*order).limit(length)


def token_window(df: DataFrame, n_tokens: Column, least: int | None, most: int | None) -> DataFrame:
    """Rows whose token count lies in a window, both ends included."""
    if least is not None:
        df = df.where(n_tokens >= least)
    return df if most is None else df.where(n_tokens <= most)


# File names of the public data sets, and of cleaned training files.
HOTPOT_FILES = {
    "train": ["hotpot_train_v1.1.json"],
    "eval": ["hotpot_dev_distractor_v1.json"],
    "all": ["hotpot_dev_distractor_v1.json", "hotpot_train_v1.1.json"],
    "fullwiki_eval": ["hotpot_dev_fullwiki_v1.json"],
}
HOTPOT_CLEAN = ["hotpot_candidate_train_q0_s1.jsonl", "hotpot_train_candidates_q0_s1.jsonl"]
TWO_WIKI_FILES = {"train": "train.json", "dev": "dev.json", "test": "test.json"}
TWO_WIKI_CLEAN = ["2wiki_candidate_train_q0_s1.jsonl", "train_candidates_q0_s1.jsonl"]


def first_existing(spark: SparkSession, path: str, names: list[str]) -> str:
    """``path`` if it is a file, else the first of the named files that is there (the
    first name if none is). Works on any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)) and fs.getFileStatus(hadoop(path)).isFile():
        return path
    there = [f"{path}/{n}" for n in names if fs.exists(hadoop(f"{path}/{n}"))]
    return (there or [f"{path}/{names[0]}"])[0]


def multihop_split(spark: SparkSession, folder: str, split: str, length: int | None = None, least: int | None = None, most: int | None = None, seed: int = 52, clean: str | None = None) -> DataFrame:
    """train, eval, all (eval, then train), fullwiki_eval, or train-clean (lines; the
    token bounds don't apply)."""
    if split == "train-clean":
        rows = multihop(spark, first_existing(spark, folder, [clean, *HOTPOT_CLEAN] if clean else HOTPOT_CLEAN))
    elif split in HOTPOT_FILES:
        parts = [multihop(spark, f"{folder}/{f}", array=True).withColumn("_file", F.lit(i)) for i, f in enumerate(HOTPOT_FILES[split])]
        text = F.concat_ws(" ", "question", F.array_join(F.flatten(F.transform("context", lambda c: c["sentences"])), " "))
        rows = token_window(reduce(DataFrame.unionByName, parts), T.word_count(text), least, most)
    else:
        raise ValueError(f"unknown split: {split}")
    return first_rows(rows, length, *hash_order(seed, "_id"))


def without_bridge_comparison(df: DataFrame) -> DataFrame:
    """The exact type name; rows without a type stay."""
    return df.where(F.coalesce("type", F.lit("")) != "bridge_comparison")


def is_bridge_comparison(c: Column) -> Column:
    """Any spelling with spaces, hyphens or underscores."""
    return F.lower(F.translate(c, "-_", "  ")) == "bridge comparison"


def two_wiki_split(spark: SparkSession, folder: str, split: str, skip_bridge: bool = True, length: int = 0, seed: int = 100, clean: str | None = None) -> DataFrame:
    if split == "train-clean":
        rows = multihop(spark, first_existing(spark, folder, [clean, *TWO_WIKI_CLEAN] if clean else TWO_WIKI_CLEAN))
    elif split in TWO_WIKI_FILES:
        rows = multihop(spark, f"{folder}/{TWO_WIKI_FILES[split]}", array=True)
    else:
        raise ValueError(f"unknown split: {split}")
    rows = without_bridge_comparison(rows) if skip_bridge else rows
    return first_rows(rows, length if length > 0 else None, *hash_order(seed, "_id"))


def _paragraph_text() -> Column:
    return F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("TITLE: "), p["title"], F.lit("\nTEXT: "), p["paragraph_text"], F.lit("\n\n"))), "")


def paragraph_qa(spark: SparkSession, path: str | list[str], least: int | None = None, most: int | None = None, length: int | None = None, seed: int = 42, kind: str = "qa", annotation: str = "real") -> DataFrame:
    """Records with paragraphs; nothing unless ``kind`` is qa or any and ``annotation`` real or any."""
    rows = with_position(jsonl(spark, path, schemas.PARAGRAPH_QA))
    if kind not in ("qa", "any") or annotation not in ("real", "any"):
        return rows.limit(0)
    return first_rows(token_window(rows, T.word_count(_paragraph_text()), least, most), length, *hash_order(seed, "id"))


def paragraph_tasks(parts: dict[str, DataFrame], least: int | None = None, most: int | None = None, length: int | None = None, seed: int = 42, n_tokens: Column | None = None) -> DataFrame:
    """Tasks (type, anno_type, context_length, context, answer, question, dataset_name, dataset_partition, options) of
    records with paragraphs by partition, in a random order. ``n_tokens`` counts the tokens of ``context`` (words by
    default); contexts outside the window go."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("dataset_partition", F.lit(name)) for name, df in parts.items()])
    rows = rows.withColumn("context", _paragraph_text()).withColumn("context_length", (T.word_count(F.col("context")) if n_tokens is None else n_tokens).cast("long"))
    rows = first_rows(token_window(rows, F.col("context_length"), least, most), length, *hash_order(seed, "id"))
    fixed = {"type": F.lit("qa"), "anno_type": F.lit("real"), "dataset_name": F.lit("MuSiQue"), "options": F.array().cast("array<string>")}
    names = ["type", "anno_type", "context_length", "context", "answer", "question", "dataset_name", "dataset_partition", "options"]
    return rows.select(*(fixed.get(n, F.col(n)).alias(n) for n in names))


def open_qa(spark: SparkSession, path: str, length: int | None = None, seed: int = 5) -> DataFrame:
    """Parquet, three columns; golden answers joined by a comma."""
    rows = spark.read.parquet(path).select("id", "question", F.array_join("golden_answers", ", ").alias("answer"))
    return first_rows(rows, length, *hash_order(seed, "id"))


def long_context(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    return first_rows(with_position(jsonl(spark, path, schemas.LONG_CONTEXT)), length, "_pos")


def split_documents(df: DataFrame) -> DataFrame:
    """question and documents of a text with numbered documents; three columns go."""
    pieces = F.split("input", "QUESTION:")
    documents = F.filter(F.transform(F.split(F.get(pieces, F.lit(0)), r"Document \d+:"), T.stripped), lambda d: d != "")
    return df.withColumns({"question": T.stripped(F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))), "documents": documents}).drop("input", "length_w_model_temp", "answer_prefix")


def ruler_qa(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    return split_documents(first_rows(with_position(jsonl(spark, path, schemas.RULER)), length, "_pos"))


def needle_split(spark: SparkSession, folder: str, split: str, length: int | None = None, seed: int = 52) -> DataFrame:
    """Needle samples of a split's file; validation is read from the training file."""
    file = "train" if split in ("train", "validation") else split
    rows = with_position(jsonl(spark, f"{folder}/{file}.jsonl", schemas.RULER))
    return needle_samples(first_rows(rows, length, *hash_order(seed, "index")))


def needle_samples(df: DataFrame) -> DataFrame:
    """id, question, answer, chunks, sf_idx of needle records (index, input, outputs); the
    last sentence is the question, and supports that point at it are dropped."""
    told = df.withColumn("_s", T.sentences("input"))
    chunks = F.slice("_s", F.lit(1), F.size("_s") - 1)
    hits = F.flatten(F.transform(chunks, lambda s, i: F.transform(F.filter("outputs", lambda o: F.contains(s, o)), lambda o: i)))
    return told.select(F.col("index").cast("string").alias("id"), F.element_at("_s", -1).alias("question"), F.array_join("outputs", ",").alias("answer"), chunks.alias("chunks"), hits.alias("sf_idx"))


def stories(lines: DataFrame, most_facts: int | None = None, strict: bool = False) -> DataFrame:
    """Samples of ``lines(file, line, value)`` of numbered stories: every question with the
    facts of its story that stand before it. ``strict``: a reference to anything else is an error."""
    number = F.split("value", " ", 2)
    parts = F.split(F.get(number, F.lit(1)), "\t")
    told = lines.select("file", "line", F.get(number, F.lit(0)).cast("int").alias("n"), F.get(parts, F.lit(0)).alias("text"), F.get(parts, F.lit(1)).alias("answer"), F.get(parts, F.lit(2)).alias("refs"))
    # each file begins with a story's first line, so stories are numbered over all files at once
    told = numbered(told.withColumn("_first", (F.col("n") == 1).cast("int")), "file", "line", into="_row", sums={"story": "_first"}).drop("_row", "_first")
    facts = told.where("answer IS NULL").groupBy("file", "story").agg(F.array_sort(F.collect_list(F.struct("line", "n", "text"))).alias("all"))
    asked = told.where("answer IS NOT NULL").join(facts, ["file", "story"])
    before = F.filter("all", lambda f: f["line"] < F.col("line"))
    numbers = F.transform(F.filter(F.split("refs", " "), lambda r: r != ""), lambda r: r.cast("int"))
    rows = asked.select(
        "file", "story", "line",
        F.transform(before, lambda f: T.stripped(f["text"])).alias("facts"),
        T.stripped(F.col("text")).alias("question"),
        "answer",
        F.filter(F.transform(before, lambda f, i: F.when(F.array_contains(numbers, f["n"]), i)), lambda i: i.isNotNull()).alias("references_idx"),
        F.array_distinct(numbers).alias("_asked"),
    )
    if strict:
        known = F.size("references_idx") == F.size("_asked")
        rows = rows.withColumn("references_idx", F.when(known, F.col("references_idx")).otherwise(F.raise_error(F.concat(F.lit("a reference points at no earlier fact: "), "question")).cast("array<int>")))
    rows = rows.drop("_asked")
    return rows if most_facts is None else rows.where(F.size("facts") + 1 <= most_facts)


def story_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that aren't blank, read by byte ranges; line rises over all files."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    rows = spark.read.text(path).select(*place, "value").where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    return numbered(rows, "file", "_block", "_at", into="line").select("file", "line", "value")


def story_contexts(samples: DataFrame, most: int | None = None) -> DataFrame:
    """question, context (facts in one text), answer; the first ``most``."""
    rows = samples.select("question", F.array_join("facts", " ").alias("context"), "answer", "file", "line")
    return first_rows(rows, most, "file", "line").drop("file", "line")


def in_context_split(train: DataFrame, samples: int, examples: int, seed: int, evaluation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Disjoint samples and examples of ``train`` by a hash order (0 samples: all that are
    left), or the first samples of ``evaluation`` and examples of ``train``."""
    if evaluation is None:
        n = train.count()
        if examples + samples > n:
            raise ValueError(f"{examples} examples and {samples} samples of {n} rows")
        shown = first_rows(train, examples, *hash_order(seed, "_pos"))
        rest = train.join(shown.select("_pos"), "_pos", "left_anti").select(train.columns)
        return first_rows(rest, samples or None, *hash_order(seed, "_pos")), shown
    return first_rows(evaluation, samples or None, "_pos"), first_rows(train, examples, *hash_order(seed, "_pos"))


# Formatters of in-context examples: what is asked, what is answered, and both as one text.


def gsm_example(df: DataFrame) -> Column:
    solution, number = F.substring_index("answer", "####", 1), F.substring_index("answer", "####", -1)
    return F.concat("question", F.lit(T.SEPARATOR), T.stripped(solution), F.lit("\nFinal Answer: "), T.stripped(number))


def math_example(df: DataFrame) -> Column:
    return F.concat("problem", F.lit(T.SEPARATOR), "solution")


def endings_query(df: DataFrame) -> Column:
    return F.concat("ctx", T.letters(F.col("endings")))


def endings_answer(df: DataFrame) -> Column:
    return F.char(F.col("label").cast("int") + 65)


def options_query(df: DataFrame) -> Column:
    return F.concat(F.lit("QUESTION: "), "question", F.lit("\nOPTIONS:"), T.letters(F.col("options")))


def summary_example(df: DataFrame) -> Column:
    return F.concat(F.lit("TEXT:\n"), "text", F.lit(T.SEPARATOR + "SUMMARY:\n"), "summary")


def candidate_rows(spark: SparkSession, path: str | list[str], combined: bool = False, seed: int = 42, length: int | None = None) -> DataFrame:
    """Rows with candidates, the first ``length`` in a random order (``_order``); a combined file may
    only hold the two known sources."""
    rows = multihop(spark, path, schema=schemas.CANDIDATE_RAW)
    if combined:
        known = F.col("source").isin("hotpotqa", "2WikiMultihopQA")
        rows = rows.withColumn("source", F.when(known, F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))))
    return first_rows(rows.withColumn("_order", draw(seed, "_id")), length, "_order", "_id", "_pos")


def paragraph_eval(df: DataFrame, exactly: int | None = None) -> DataFrame:
    """Supports by hop (see ``operators.joins.hop_positions``) and their union with marked ones."""
    from hopsmith.operators.joins import hop_positions

    marked = F.filter(F.transform("paragraphs", lambda p, i: F.when(p["is_supporting"], i)), lambda i: i.isNotNull())
    rows = df.withColumn("references_idx", hop_positions(F.col("paragraphs"), F.col("question_decomposition")))
    rows = rows.withColumn("facts_idx", F.array_sort(F.array_union(marked, "references_idx")))
    return rows if exactly is None else rows.where(F.size("references_idx") == exactly)


def books(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(book_id, sentences) of a noise corpus in Parquet; books without a sentence go."""
    rows = spark.read.schema("book_id bigint, sentences array<string>").parquet(path if isinstance(path, str) else path[0], *([] if isinstance(path, str) else path[1:]))
    return rows.where(F.size("sentences") > 0)


def merged_lists(parts: list[DataFrame], key: str = "key", values: str = "values") -> DataFrame:
    """Lists of several sets by key, joined in the order of the sets (a set's rows of one key in the order of ``_pos``, if it has one)."""
    rows = reduce(DataFrame.unionByName, [p.select(key, values, F.lit(i).alias("_part"), (F.col("_pos") if "_pos" in p.columns else F.lit(0)).cast("long").alias("_at")) for i, p in enumerate(parts)])
    lists = F.array_sort(F.collect_list(F.struct("_part", "_at", values)))
    return rows.groupBy(key).agg(F.flatten(F.transform(lists, lambda x: x[values])).alias(values))


def originals(parts: list[DataFrame]) -> DataFrame:
    """Records by id; a later part replaces an earlier one's."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return latest_by_id(rows, "_id", "_part").drop("_part")


# Spellings of data-set names.
ALIASES = {"hotpot": "hotpotqa", "hotpotqa": "hotpotqa", "2wiki": "2wiki", "twowiki": "2wiki", "2wikimultihopqa": "2wiki", "all": "all"}


def dataset_name(name: str) -> str:
    if name.lower() not in ALIASES:
        raise ValueError(f"unknown data set: {name}")
    return ALIASES[name.lower()]


def success_samples(spark: SparkSession, folder: str, dataset: str, split: str, keep_nonstandard: bool = False, skip_bridge: bool = True, limit: int = 0) -> DataFrame:
    """Samples for a success-rate run, each with the split of the file it is from; Hotpot
    samples without exactly 10 chunks and 2 supports go unless kept. ``all``: both sets."""
    from hopsmith.operators.adapt import multihop as adapted
    from hopsmith.operators.filters import standard_shape

    name = dataset_name(dataset)
    if name == "all":
        both = [success_samples(spark, f"{folder}/{d}", d, split, keep_nonstandard, skip_bridge, limit) for d in ("hotpotqa", "2wiki")]
        return both[0].unionByName(both[1])
    files = HOTPOT_FILES[{"dev": "eval"}.get(split, split)] if name == "hotpotqa" else [TWO_WIKI_FILES[split]]
    parts = []
    for f in files:
        rows = multihop(spark, f"{folder}/{f}", array=True)
        rows = without_bridge_comparison(rows) if name == "2wiki" and skip_bridge else rows
        kind = f.removesuffix(".json") if name == "2wiki" else "fullwiki_dev" if "fullwiki" in f else "train" if "train" in f else "dev"
        parts.append(adapted(rows, name).withColumn("split", F.lit(kind)))
    rows = reduce(DataFrame.unionByName, parts)
    rows = standard_shape(rows) if name == "hotpotqa" and not keep_nonstandard else rows
    return first_rows(rows, limit if limit > 0 else None, "split", "id")


def question_rows(df: DataFrame, kind: str) -> DataFrame:
    """id, question, answer of raw records; the 2wiki kind loses bridge comparisons."""
    df = without_bridge_comparison(df) if kind == "2wiki" else df
    return df.select(F.col("id" if kind == "musique" else "_id").cast("string").alias("id"), "question", "answer")
