"""Record adapters: raw records of each family to the one sample layout
(id, question, answer, chunks, sf_idx, source)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopsmith.functions import text as T
from hopsmith.operators.numbering import numbered
from hopsmith.sources import readers


def _where(values: Column, test: Callable[[Column], Column]) -> Column:
    """Indices of the values that pass."""
    return F.filter(F.transform(values, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())


def _fields(id_: Column, question: Column, answer: Column, chunks: Column, sf_idx: Column) -> list[Column]:
    return [id_.cast("string").alias("id"), question.alias("question"), answer.alias("answer"), chunks.alias("chunks"), sf_idx.cast("array<int>").alias("sf_idx")]


def _record(*fields: Column) -> Column:
    return F.struct(*_fields(*fields))


def _sample(df: DataFrame, id_: Column, question: Column, answer: Column, chunks: Column, sf_idx: Column, source: Column | str) -> DataFrame:
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(*_fields(id_, question, answer, chunks, sf_idx), source.alias("source"))


def title_chunks(context: Column) -> Column:
    return F.transform(context, lambda c: F.concat(c["title"], F.lit(" "), F.array_join(c["sentences"], " ")))


def title_support(context: Column, support: Column) -> Column:
    """Every chunk whose title is a supporting one."""
    titles = F.transform(support, lambda s: s["title"])
    return _where(context, lambda c: F.array_contains(titles, c["title"]))


def _multihop() -> Column:
    return _record(F.col("_id"), F.col("question"), F.col("answer"), title_chunks(F.col("context")), title_support(F.col("context"), F.col("supporting_facts")))


def _paragraphs() -> Column:
    chunks = F.transform("paragraphs", lambda p: F.concat(p["title"], F.lit(". "), p["paragraph_text"]))
    return _record(F.col("id"), F.col("question"), F.col("answer"), chunks, F.transform("question_decomposition", lambda d: d["paragraph_support_idx"]))


def _adapted(df: DataFrame, record: Column, source: Column | str) -> DataFrame:
    return df.select(record.alias("r"), (F.lit(source) if isinstance(source, str) else source).alias("source")).select("r.*", "source")


def multihop(df: DataFrame, source: Column | str) -> DataFrame:
    return _adapted(df, _multihop(), source)


def paragraphs(df: DataFrame, source: Column | str = "musique") -> DataFrame:
    """Supports in hop order as given, repeats included."""
    return _adapted(df, _paragraphs(), source)


def stories(df: DataFrame, source: Column | str = "babilong") -> DataFrame:
    """The id is the row's number in reading order."""
    return _sample(numbered(df, "file", "line", into="_n"), F.col("_n"), F.col("question"), F.col("answer"), F.col("facts"), F.col("references_idx"), source)


def long_context(df: DataFrame, source: Column | str = "LongBench", size: int = 2000) -> DataFrame:
    return _sample(df, F.col("_id"), F.col("input"), F.get("answers", F.lit(0)), T.pack_chunks_udf("context", F.lit(size)), F.array(F.lit(0)), source)


def ruler(df: DataFrame, source: Column | str = "RulerQA") -> DataFrame:
    return _sample(df, F.col("index"), F.col("question"), F.get("outputs", F.lit(0)), F.col("documents"), F.array(F.lit(0)), source)


def open_qa(df: DataFrame, source: Column | str = "NQ+HotPotQA") -> DataFrame:
    return _sample(df, F.col("id"), F.col("question"), F.col("answer"), F.array(*map(F.lit, ("111", "222", "333"))), F.array(F.lit(0)), source)


#: Question and answer of each in-context family, and how an example of it reads.
IN_CONTEXT = {
    "GSM8K": (lambda: F.col("question"), lambda: T.gsm_answer(F.col("answer")), readers.gsm_example, None),
    "MATH": (lambda: F.col("problem"), lambda: F.col("answer"), readers.math_example, "id"),
    "HellaSwag": (lambda: readers.endings_query(None), lambda: readers.endings_answer(None), lambda _: F.concat(readers.endings_query(None), F.lit(T.SEPARATOR), readers.endings_answer(None)), "ind"),
    "XL-Sum": (lambda: F.col("text"), lambda: F.col("summary"), readers.summary_example, "id"),
    "MMLU-Pro": (lambda: readers.options_query(None), lambda: F.col("answer"), lambda _: F.concat(readers.options_query(None), F.lit(T.SEPARATOR), "answer"), "question_id"),
}


def in_context(samples: DataFrame, examples: DataFrame, name: str) -> DataFrame:
    """Samples whose chunks are the shared pool of examples, which is a constant of the plan: more
    than ``POOL_EXAMPLES``, or than ``POOL_LETTERS`` letters altogether, are an error."""
    question, answer, example, key = IN_CONTEXT[name]
    pool = examples.select("_pos", example(examples).alias("e"))
    n, letters = pool.agg(F.count("*"), F.coalesce(F.sum(F.length("e")), F.lit(0))).first()
    if n > POOL_EXAMPLES or letters > POOL_LETTERS:
        raise ValueError(f"a pool of {n} examples of {letters} letters; at most {POOL_EXAMPLES} of {POOL_LETTERS}")
    shown = F.array(*(F.lit(r.e) for r in pool.orderBy("_pos").collect())).cast("array<string>")  # bounded above
    return _sample(samples, F.col(key or "_pos"), question(), answer(), shown, F.array(F.lit(0)), name)


#: What a pool of examples may hold.
POOL_EXAMPLES, POOL_LETTERS = 10_000, 8_000_000


#: Sources that a combined set may hold, with the columns that each of them needs.
COMBINED = {
    "hotpotqa": ["_id", "question", "answer", "context", "supporting_facts"],
    "2WikiMultihopQA": ["_id", "question", "answer", "context", "supporting_facts"],
    "musique": ["id", "question", "answer", "paragraphs", "question_decomposition"],
    "babilong": ["question", "answer", "chunks", "references_idx", "_pos"],
}


def combined(df: DataFrame) -> DataFrame:
    """Rows of several sources (those of ``COMBINED``), each adapted in its own way in one pass; any
    other source is an error. Columns of families that don't occur may be missing."""
    records = {"hotpotqa": _multihop, "2WikiMultihopQA": _multihop, "musique": _paragraphs, "babilong": lambda: _record(F.col("_pos"), F.col("question"), F.col("answer"), F.col("chunks"), F.col("references_idx"))}
    unknown = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))
    found = None
    for name, needs in COMBINED.items():
        if set(needs) <= set(df.columns):
            found = (F if found is None else found).when(F.col("source") == name, records[name]())
    kind = "struct<id: string, question: string, answer: string, chunks: array<string>, sf_idx: array<int>>"
    record = unknown.cast(kind) if found is None else found.otherwise(unknown.cast(kind))
    return df.select(record.alias("r"), "source").select("r.*", "source")


ADAPTERS = {"hotpotqa": multihop, "2wiki": multihop, "musique": paragraphs, "babilong": stories, "LongBench": long_context, "RulerQA": ruler, "NQ+HotPotQA": open_qa}


def adapt(df: DataFrame, name: str, examples: DataFrame | None = None) -> DataFrame:
    """By name; in-context sets take their pool of examples as well."""
    if name == "combined":
        return combined(df)
    name = {"2WikiMultihopQA": "2wiki", "gsm8k": "GSM8K"}.get(name, name)
    if name in IN_CONTEXT:
        if examples is None:
            raise ValueError(f"{name} needs examples")
        return in_context(df, examples, name)
    if name not in ADAPTERS:
        raise ValueError(f"unknown data set: {name}")
    return ADAPTERS[name](df, name)


def candidates(df: DataFrame, min_chunks: int = 6) -> DataFrame:
    """Samples with candidates, judgements and betas; short contexts go."""
    rows = df.where(F.size(F.coalesce("context", F.array().cast(dict(df.dtypes)["context"]))) >= min_chunks)
    return rows.select(
        F.col("_id").cast("string").alias("id"), "question", "answer", title_chunks(F.col("context")).alias("chunks"),
        title_support(F.col("context"), F.col("supporting_facts")).cast("array<int>").alias("sf_idx"), "source", "candidates", "judgements", "betas",
    )


def as_multihop(df: DataFrame) -> DataFrame:
    """Paragraph records with title and sentences, supports at sentence 0."""
    context = F.transform("paragraphs", lambda p: F.struct(p["title"].alias("title"), F.filter(F.transform(F.split(p["paragraph_text"], r"\. "), T.stripped), lambda s: s != "").alias("sentences")))
    support = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: F.struct(p["title"].alias("title"), F.lit(0).alias("sent_id")))
    return df.select(F.col("id").alias("_id"), "question", "answer", support.alias("supporting_facts"), context.alias("context"), F.lit("").alias("type"), F.lit("").alias("level"))


def with_noise(sample: DataFrame) -> DataFrame:
    """noise_idx, support texts and counts beside a sample."""
    every = F.when(F.size("chunks") > 0, F.sequence(F.lit(0), F.size("chunks") - 1)).otherwise(F.array().cast("array<int>"))
    return sample.withColumns({
        "noise_idx": F.array_except(every, "sf_idx"),
        "sf_texts": F.transform("sf_idx", lambda i: F.get("chunks", i)),
        "chunk_count": F.size("chunks"),
        "sf_count": F.size("sf_idx"),
    })


def oracle_log(sample: DataFrame) -> DataFrame:
    """A retriever log as if all supports had been found; samples without any go."""
    rows = sample.where(F.size("sf_idx") > 0)
    texts = F.transform("sf_idx", lambda i: F.get("chunks", i))
    length = T.word_count(F.col("question")) + F.aggregate(texts, F.lit(0), lambda n, t: n + T.word_count(t))
    return rows.select(
        "id", "question", "answer", "sf_idx", F.col("sf_idx").alias("pred_idx"), F.transform("sf_idx", lambda _: F.lit(1.0)).alias("q_values"),
        texts.alias("sf_texts"), texts.alias("pred_texts"), F.lit(1.0).alias("return"), length.cast("long").alias("text_len"), F.lit(1.0).alias("f1"), F.lit(1.0).alias("em"),
    )


def extracted_answers(df: DataFrame) -> DataFrame:
    """``answer`` from a boxed solution; ``id`` from the row's place where it is missing."""
    return df.withColumns({"answer": T.boxed_for_comparison("solution"), "id": F.coalesce("id", F.col("_pos"))})


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Data sets under their own names; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in parts.items()])


def round_robin(parts: dict[str, DataFrame], n: int, proportions: dict[str, int] | None = None) -> DataFrame:
    """``n`` turns over data sets, each read in order and again from its start."""
    turns = [name for name in parts for _ in range((proportions or {}).get(name, 1))]
    share = {name: turns.count(name) for name in parts}
    view = []
    for name, df in parts.items():
        size = df.count()
        ranked = numbered(df, "_pos", into="_rank")
        places = [i for i, t in enumerate(turns) if t == name]
        spots = F.element_at(F.array(*map(F.lit, places)), (F.col("_k") % share[name]).cast("int") + 1)
        draws = df.sparkSession.range(-(-n // len(turns)) * share[name]).withColumnRenamed("id", "_k").withColumn("turn", F.floor(F.col("_k") / share[name]) * len(turns) + spots)
        view.append(draws.where(F.col("turn") < n).join(ranked, F.col("_k") % max(size, 1) == F.col("_rank")).drop("_k", "_rank").withColumn("source", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), view)
