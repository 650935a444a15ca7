"""Summaries. Each is one keyed aggregation unless its text says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopsmith.functions.metrics import exact_match, fact_metrics, fact_rates, support_text_metrics, token_scores
from hopsmith.operators.filters import cover_step, stop_label, stop_length
from hopsmith.operators.numbering import running


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def retriever_summary(log: DataFrame) -> DataFrame:
    """Means and the population deviation; f1 and em computed from the indices."""
    m = fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    rows = log.select("return", "text_len", m["f1"].alias("f1"), m["em"].alias("em"))
    return rows.agg(F.count("*").alias("n"), F.avg("return").alias("mean_return"), F.stddev_pop("return").alias("std_return"), F.avg("text_len").alias("mean_text_len"), F.avg("em").alias("em"), F.avg("f1").alias("f1"))


def metric_summary(log: DataFrame) -> DataFrame:
    """Stored f1 and em where both are there, else computed; nothing: zeros."""
    m = fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    stored = F.col("f1").isNotNull() & F.col("em").isNotNull()
    rows = log.select(F.when(stored, F.col("f1")).otherwise(m["f1"]).alias("f1"), F.when(stored, F.col("em")).otherwise(m["em"]).alias("em"))
    return rows.agg(_or_zero(F.avg("f1")).alias("f1"), _or_zero(F.avg("em")).alias("em"))


def reader_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(_or_zero(F.avg("EM")).alias("em"), _or_zero(F.avg("F1")).alias("f1"), F.avg("LLM_Judge_Score").alias("judge"))


def judge_accuracy(rows: DataFrame, judgement: str = "judgement") -> DataFrame:
    """Counts and percentage; failed ones stay in the denominator."""
    j = F.col(judgement)
    return rows.agg(F.count_if(j == 1).alias("correct"), F.count_if(j == 0).alias("incorrect"), F.count_if(j == -1).alias("failed"), _or_zero(100 * F.avg((j == 1).cast("int"))).alias("accuracy"))


def judgement_buckets(rows: DataFrame) -> DataFrame:
    j = F.col("judgements")
    right, wrong, open_ = F.forall(j, lambda x: x == 1), F.forall(j, lambda x: x == 0), F.exists(j, lambda x: x == -1)
    counts = rows.agg(F.count("*").alias("total"), F.count_if(right).alias("all_correct"), F.count_if(wrong).alias("all_wrong"), F.count_if(open_).alias("unresolved"))
    return counts.withColumn("mixed", F.col("total") - F.col("all_correct") - F.col("all_wrong") - F.col("unresolved"))


def beta_buckets(rows: DataFrame) -> DataFrame:
    """Records whose judgements are all 1, all 0, or neither."""
    j = F.col("judgements")
    counts = rows.agg(F.count_if(F.forall(j, lambda x: x == 1)).alias("all_correct"), F.count_if(F.forall(j, lambda x: x == 0)).alias("all_wrong"), F.count("*").alias("_n"))
    return counts.select("all_correct", "all_wrong", (F.col("_n") - F.col("all_correct") - F.col("all_wrong")).alias("mixed"))


def beta_summary(rows: DataFrame) -> DataFrame:
    """Over betas above minus infinity."""
    b = rows.select(F.explode("betas").alias("b")).where(F.col("b") > float("-inf"))
    return b.agg(F.count("*").alias("n"), F.avg("b").alias("mean"), F.median("b").alias("median"), F.min("b").alias("min"), F.max("b").alias("max"))


def mode_counts(judgements: Column) -> Column:
    count = lambda v: F.size(F.filter(judgements, lambda j: j == v))
    return F.struct(count(1).alias("correct"), F.size(judgements).alias("total"), count(-1).alias("failed"))


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """One row: repeats by (source, id) and by id, of rows that have an id."""
    named = rows.where("id IS NOT NULL").select("source", F.col("id").cast("string").alias("id"))
    pairs = named.groupBy("source", "id").count()
    ids = pairs.groupBy("id").agg(F.sum("count").alias("n"), F.sum(F.col("count") - 1).alias("within"))
    return ids.agg(_zero_long("within").alias("by_source_and_id"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("by_id"))


def _zero_long(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def value_distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values, most frequent first; missing and empty are ``<empty>``."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("<empty>"))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def rate_histogram(rows: DataFrame, rate: str, n: int) -> DataFrame:
    """Rows by rounded(rate * n), half to even, with zeros from 0 to ``n``."""
    bins = rows.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("bin"))
    counts = rows.groupBy(F.bround(F.col(rate) * n, 0).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def success_statistics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """mean, median, min and max of each metric, a row each."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))


def failed_judgements(rows: DataFrame, modes: list[str]) -> DataFrame:
    """Over all records, how many judgements of each mode have failed (-1)."""
    failed = lambda m: F.coalesce(F.sum(mode_counts(F.col(m))["failed"]), F.lit(0)).cast("long").alias(m)
    return rows.agg(*map(failed, modes))


def by_source(rows: DataFrame, metrics: list[str], source: str = "source") -> DataFrame:
    """Means over all and by source, in one pass; the total's source is ``<all>``."""
    out = rows.groupingSets([[], [source]], source)
    name = F.when(F.grouping(source) == 1, "<all>").otherwise(F.coalesce(source, F.lit("<null>")))
    return out.agg(name.alias("_source"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics]).drop(source).withColumnRenamed("_source", "source")


def threshold_sweep(log: DataFrame, thresholds: list[float], total: int = 6) -> DataFrame:
    """For each threshold: shares of early, late and perfect stops among found episodes, mean
    length, coverage, f1 and rates. The thresholds are exploded within each row."""
    swept = log.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    stop = stop_length(F.col("q_values"), F.col("threshold"))
    kept = F.slice("pred_idx", F.lit(1), stop)
    rates = fact_rates(kept, F.col("sf_idx"), total)
    covered = cover_step(F.col("pred_idx"), F.col("sf_idx"))
    rows = swept.select("threshold", stop.alias("stop"), stop_label(stop, covered).alias("label"), rates.alias("m"))
    found = F.col("label") != "not_found"
    share = lambda label: F.avg(F.when(found, (F.col("label") == label).cast("double"))).alias(label)
    return rows.groupBy("threshold").agg(
        F.count("*").alias("n"), share("early"), share("late"), share("perfect"), F.avg("stop").alias("mean_length"),
        F.avg(found.cast("double")).alias("found"), F.avg("m.em").alias("coverage"), F.avg("m.f1").alias("f1"), F.avg("m.tpr").alias("tpr"), F.avg("m.fpr").alias("fpr"),
    )


def roc_area(points: DataFrame) -> DataFrame:
    """Trapezoid area over (fpr, tpr): a point per fpr, the first in threshold order. The
    points are those of a sweep, so one task holds them."""
    first = points.groupBy("fpr").agg(F.min_by("tpr", "threshold").alias("tpr"))
    w = Window.orderBy("fpr")
    parts = first.select(((F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2).alias("a"))
    return parts.agg(_or_zero(F.sum("a")).alias("auc"))


def type_shares(rows: DataFrame, column: str = "type") -> DataFrame:
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def dataset_statistics(rows: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    length = F.length(text)
    out = [F.count("*").alias("n"), F.avg(length).alias("mean_length"), F.max(length).alias("max_length"), F.min(length).alias("min_length"), F.sum(F.octet_length(text)).alias("bytes")]
    return rows.groupBy(kind).agg(*out) if kind else rows.agg(*out)


# Fixed value: a reward's timing line.
TIMING = r"reward_ms=([0-9.]+) feedback=(\S+) is_final=(\S+) reward=(\S+)"


def timing_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    part = lambda i: F.regexp_extract(column, TIMING, i)
    return lines.where(F.rlike(column, F.lit(TIMING))).select("*", part(1).cast("double").alias("ms"), part(2).alias("feedback"), (part(3) == "True").alias("is_final"), part(4).cast("double").alias("reward"))


def timing_summary(rows: DataFrame, n: int | None = None, final_only: bool = True) -> DataFrame:
    rows = rows.where("is_final") if final_only else rows
    rows = rows if n is None else rows.orderBy("_pos").limit(n)
    return rows.groupBy("feedback").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.median("ms").alias("median"), F.min("ms").alias("min"), F.max("ms").alias("max"))


def running_mean(rows: DataFrame, column: str, order: str, group: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(column).over(w))


def answer_scores(gold: DataFrame, pred: DataFrame, columns: list[str]) -> DataFrame:
    """Means over all gold rows, unanswered ones as 0."""
    from hopsmith.operators.joins import predictions_against_gold

    return predictions_against_gold(gold, pred, columns).agg(*[F.avg(c).alias(c) for c in columns])


def answer_and_support_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Eight means over all rows of ``gold(id, answer, support_texts)``: em, f1, precision and recall of the
    answers and of the support texts of ``pred(id, answer, support_texts)``. A row without a
    prediction counts as 0; predictions of other ids don't count."""
    both = gold.join(pred.select("id", F.col("answer").alias("_answer"), F.col("support_texts").alias("_texts"), F.lit(True).alias("_there")), "id", "left")
    a = token_scores(F.coalesce("_answer", F.lit("")), F.col("answer"))
    s = support_text_metrics(F.coalesce("_texts", F.array().cast("array<string>")), F.col("support_texts"))
    values = {"em": exact_match(F.coalesce("_answer", F.lit("")), F.col("answer")).cast("double"), "f1": a["f1"], "precision": a["precision"], "recall": a["recall"], **{f"support_{n}": s[n] for n in ("em", "f1", "precision", "recall")}}
    return both.agg(*(F.avg(F.when(F.col("_there"), v).otherwise(0.0)).alias(n) for n, v in values.items()))


def episodic_returns(steps: DataFrame) -> DataFrame:
    """Summed reward of each finished or open episode of an environment: (env_id, episode,
    episodic_return, n_steps, done)."""
    before = Window.partitionBy("env_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    episode = F.coalesce(F.sum(F.col("done").cast("int")).over(before), F.lit(0))
    rows = steps.withColumn("episode", episode)
    return rows.groupBy("env_id", "episode").agg(F.sum("reward").alias("episodic_return"), F.count("*").alias("n_steps"), F.max("done").alias("done"))


def best_checkpoints(evals: DataFrame, metric: str = "reward") -> DataFrame:
    """Evaluations strictly better than all before them. One run's evaluations are few."""
    before = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.max(metric).over(before)
    return evals.withColumn("_so_far", so_far).where(F.col("_so_far").isNull() | (F.col(metric) > F.col("_so_far"))).drop("_so_far")


def ordered_distinct(ids: DataFrame, key: str = "id", order: str = "_pos") -> DataFrame:
    """First place and number of repeats of each id, compared as text."""
    return ids.groupBy(F.col(key).cast("string").alias(key)).agg(F.min(order).alias(order), (F.count("*") - 1).alias("repeats"))


def optimal_threshold(values: DataFrame, column: str = "se", group: str = "model") -> DataFrame:
    """Per group, the value that splits (below, at or above) with the least squared error
    within the two sides, the smallest of equals: (threshold, error).

    Values are counted first and taken from their group's mean, so that squares don't cancel;
    the running sums go over distinct values, in parts (``running``).
    """
    counts = values.groupBy(group, F.col(column).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
    means = counts.groupBy(F.col(group).alias("_g")).agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    off = F.col("x") - F.col("mean")
    rows = counts.join(means, F.col(group).eqNullSafe(F.col("_g"))).select(group, "x", F.col("n").alias("v0"), (F.col("n") * off).alias("v1"), (F.col("n") * off * off).alias("v2"))
    totals = rows.groupBy(F.col(group).alias("_g")).agg(*(F.sum(f"v{p}").alias(f"t{p}") for p in range(3)))
    rows = running(rows, group, "x", {f"b{p}": f"v{p}" for p in range(3)}).join(totals, F.col(group).eqNullSafe(F.col("_g")))
    spread = lambda n, s, s2: F.when(n > 0, s2 - s * s / n).otherwise(0.0)
    error = spread(F.col("b0"), F.col("b1"), F.col("b2")) + spread(F.col("t0") - F.col("b0"), F.col("t1") - F.col("b1"), F.col("t2") - F.col("b2"))
    rows = rows.withColumn("error", F.round(F.greatest(error, F.lit(0.0)), 9))
    return rows.groupBy(group).agg(F.min_by("x", F.struct("error", "x")).alias("threshold"), F.min("error").alias("error"))


def probe_labels(values: DataFrame, threshold: float, column: str = "se") -> DataFrame:
    """label: above the threshold; if that leaves one class, above the median."""
    x = F.col(column)
    kinds = values.agg(F.count_distinct(x > threshold).alias("k"), F.percentile(x, F.lit(0.5)).alias("m")).first()
    return values.withColumn("label", (x > (threshold if kinds["k"] == 2 else kinds["m"])).cast("int"))


def fit_probe(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label"):
    """L2 logistic probe: (model, accuracy, area under ROC on ``test``)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    shaped = [d.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label")) for d in (train, test)]
    model = LogisticRegression(maxIter=1000, regParam=1.0 / max(1, train.count()), elasticNetParam=0.0, standardization=False).fit(shaped[0])
    scored = model.transform(shaped[1])
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return model, accuracy, BinaryClassificationEvaluator().evaluate(scored)
