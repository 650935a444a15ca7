"""The queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopsmith.llm import balls, importance, language, media, notices, packing, quality, rollup, simhash, suffix, tokenfile, topk, unigram
from hopsmith.llm.common import is_held_out, map_arrow, shared_dir, short_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return short_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL = r"[^\x00-\x20]+@[^\x00-\x20]+"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under two tokenizer files: every document is loaded, later exact copies are taken
    back, counts of texts whose e-mail addresses go are revised, and a batch is replayed."""
    docs = _table(spark, sf_dir, "documents")
    masked = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", EMAIL, ""))  # spares most texts the search
    texts = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text", F.when(masked != F.col("text"), masked).alias("masked"))
    versions = {name: public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")}
    counts = rollup.tokenised(texts, versions, ["text", "masked"])
    return _rolled_up(spark, counts.withColumnRenamed("n_text", "n_tokens"), list(versions))


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deltas with counts by regular expressions, which SQL can check."""
    docs = _table(spark, sf_dir, "documents")
    masked = F.regexp_replace("text", EMAIL, "")

    def count(version: str) -> Column:
        after = F.when(F.contains("text", F.lit("@")), rollup.counted(masked, version))
        return F.struct(F.lit(version).alias("tokenizer_version"), rollup.counted(F.col("text"), version).alias("n_tokens"), after.alias("n_masked"))

    rows = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.explode(F.array(*map(count, rollup.COUNTERS))).alias("c"))
    return _rolled_up(spark, rows.select("doc_id", "source", "lang", "digest", "c.*"), list(rollup.COUNTERS))


def _rolled_up(spark: SparkSession, counts: DataFrame, versions: list[str]) -> DataFrame:
    """Totals of (doc_id, source, lang, digest, tokenizer_version, n_tokens, n_masked) after
    loads, deletes of later copies, a compaction, revisions and a replay."""
    rows = written(counts.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long"))).withColumn("n_masked", F.coalesce("n_masked", "n_tokens")), "counts")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    ranked = rows.join(first, "digest")
    copies, kept = ranked.where("doc_id > first_id"), ranked.where("doc_id <= first_id OR doc_id IS NULL")
    revised = kept.where("n_masked <> n_tokens")
    ledger = rollup.TokenRollup(spark, f"{shared_dir(spark)}-rollup")
    load = {v: rollup.signed(rows.where(F.col("tokenizer_version") == v), 1) for v in versions}
    for version, changes in load.items():
        ledger.commit(f"load-{version}", changes)
    ledger.commit("drop-copies", rollup.signed(copies, -1))
    ledger.compact()
    ledger.commit("mask-emails", rollup.signed(revised, -1).unionByName(rollup.signed(revised.withColumn("n_tokens", F.col("n_masked")), 1)))
    ledger.commit(f"load-{versions[0]}", load[versions[0]])  # a replay: no effect
    return ledger.totals()


OP1_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS text, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_copy FROM documents
), m AS (
  SELECT source, lang, regexp_replace(text, '[^\x00-\x20]+@[^\x00-\x20]+', '', 'g') AS text FROM d WHERE is_copy IS NOT TRUE
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^\x00-\x20]+')) AS n FROM m
  UNION ALL
  SELECT source, lang, 'parts-1', len(regexp_extract_all(text, '[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]')) FROM m
)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM c GROUP BY source, lang, tokenizer_version
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components of those that differ in at most two bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, bits=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from four fifths of those that name one."""
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, ~is_held_out(F.col("doc_id")), spread=False)
    return language.predict(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


EDITS = 7


def _plain_picture(html: str) -> tuple[np.ndarray, np.random.Generator]:
    rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(html.encode("utf-8", "replace"))))
    coarse = rng.integers(0, 256, (17, 17)).astype(np.float32)
    steps = np.arange(64) / 4
    low, part = steps.astype(int), (steps % 1).astype(np.float32)
    rows = coarse[low] * (1 - part)[:, None] + coarse[low + 1] * part[:, None]
    return (rows[:, low] * (1 - part) + rows[:, low + 1] * part).astype(np.uint8), rng


def _edited(image: np.ndarray, rng: np.random.Generator, edit: int | None) -> bytes:
    if edit == 0:
        image = image[10:58, 6:54]
    elif edit == 1:
        image = (image * 0.75 + 30).astype(np.uint8)
    elif edit == 2:
        image = np.rot90(image)
    elif edit == 3:
        image = image.copy()
        image[4:20, 40:60] = 128
    elif edit == 4:
        image = image[7:58, 5:54]
    elif edit == 5:
        image = np.rint(media.resized(image[None].astype(np.float32), 48, 48)[0])
    elif edit == 6:
        image = np.clip(image + np.rint(rng.normal(0, 4, image.shape)), 0, 255)
    return media.write_pgm(image)


def drawn(html: str | None, edit: int | None) -> bytes | None:
    """A page's picture: smoothed noise seeded by its HTML; ``edit`` 0 crops it, 1 changes
    contrast and brightness, 2 turns it by a quarter, 3 covers a part, 4 crops it at odd
    offsets, 5 makes it three quarters as large, 6 adds noise."""
    return None if html is None else _edited(*_plain_picture(html), edit)


def page_images(pages: DataFrame) -> DataFrame:
    """(media_id, image): the tables hold no images, so each page is drawn twice, once
    edited; the pictures of page p have the ids 2p and 2p + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                ids, images = [], []
                for page, html in zip(*(whole.slice(at, 256).column(c).to_pylist() for c in ("page_id", "html"))):
                    picture = html is not None and _plain_picture(html)
                    for edit in (None, 0 if page is None else page % EDITS):
                        ids.append(None if page is None else 2 * page + (edit is not None))
                        images.append(_edited(*picture, edit) if picture else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), "html"), run, "media_id long, image binary")


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among the pages' pictures."""
    return media.near_copies(page_images(_table(spark, sf_dir, "pages")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens: where each piece of each document lies."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer, end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and whether decoding gives its text back."""
    model = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    both = unigram.decode(unigram.encode(_table(spark, sf_dir, "documents"), model), model)
    n = (F.length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, learned from four fifths of the labels, and the verdict at 0.3."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id")))
    scored = quality.predict(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 100-byte strings that start earlier."""
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = f"{shared_dir(spark)}-token-files"
    tokenfile.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight centroids over all vectors of 64 components, ten rounds and a last assignment."""
    return balls.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, width=64, seed=3)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's words."""
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target, orders=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op13_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and spoilt licence notices of every document; base columns are of phrases."""
    found = notices.scan(_table(spark, sf_dir, "documents"))
    words, base = F.col("places.word"), F.array_distinct("places.label")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(F.array_union(base, F.col("spans.label"))).alias("labels"), "score")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _lloyd_sql(rounds: int) -> str:
    """Each round is two tables: vectors with their nearest centroid, and the centroids after it."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(w) AS w, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT k.vec_id, k.w, c.c, CAST(list_sum(list_transform(list_zip(k.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k, c{i} c
  ) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS w FROM (
      SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(range(1, 65)) AS j, unnest(w) AS x FROM a{i}) GROUP BY c, j
    ) GROUP BY c) m ON o.c = m.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, w FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8
), {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON best.c = c.c
"""


OP12_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), w AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), words AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || hex(encode(word))[2 * i - 1 : 2 * i] AS BIGINT))),
    lambda a, b: xor(crc.t[xor(a, b) % 256 + 1], a // 256)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), crc
), f AS MATERIALIZED (SELECT side, doc_id, bucket FROM w JOIN words USING (word)
), totals AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((count(*) FILTER (side = 'b') + 1) * (any_value(totals.s) + 10000) AS DOUBLE) / CAST((count(*) FILTER (side = 'd') + 1) * (any_value(totals.t) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM f, totals GROUP BY bucket
), sums AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM f JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    CAST(('0x' || sha256('2024:' || doc_id)[1:8]) AS BIGINT) AS h
  FROM documents LEFT JOIN sums USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "token_rollup_words": token_rollup_words,
        "op2_simhash": op2_simhash,
        "op3_language_id": op3_language_id,
        "op4_media_copies": op4_media_copies,
        "op5_packing": op5_packing,
        "op6_unigram": op6_unigram,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_exact_topk": op9_exact_topk,
        "op10_token_files": op10_token_files,
        "op11_ball_clusters": op11_ball_clusters,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_license_notices": op13_license_notices,
    }


def oracle_sql() -> dict[str, str]:
    return {"token_rollup_words": OP1_SQL, "op9_exact_topk": OP9_SQL, "op11_ball_clusters": _lloyd_sql(10), "op12_importance_resampling": OP12_SQL}
