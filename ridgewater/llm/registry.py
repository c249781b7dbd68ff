"""Queries of this package: name -> (function of a session and a table folder, DuckDB SQL or None)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.llm import (
    automata, cell_cosine, cotraining, derivation_repair, exact_dedup, licences, minhash_dedup, mixing, packing, parsing, pseudonyms, signature_search, syncmers,
)

# The queries' own key; a deployment passes its secret instead.
KEY = "query key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the tokenizer file is on this machine; TOKENIZER_DIR names another folder than the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, sf_dir), KEY).drop("lang", "source", "n_chars")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, draws = mixing.mix_sources(documents(spark, sf_dir))
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken"))
    return docs.join(taken, "row", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s
), w AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS most FROM r
), l AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, rank LIMIT 1
), t AS (
  SELECT l.source, l.rank, l.source_size, least(l.most::DOUBLE, l.weight * f.level) AS target,
    greatest(ceil(l.source_size / {mixing.BLOCK_WORDS}), 1)::BIGINT AS blocks FROM l, f
), p AS (
  SELECT d.doc_id, d.size, t.*, floor(t.target + 0.5)::BIGINT AS wanted, md5('0:' || coalesce(d.doc_id::VARCHAR, 'null')) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), a AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY ('0x' || substr(key, 1, 8))::BIGINT % blocks, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p
)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, wanted - ahead))
  + greatest(0, least(size, wanted - source_size - ahead)) + greatest(0, least(size, wanted - 2 * source_size - ahead)))::BIGINT AS taken
FROM a
"""


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept", "class_id")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document lies at source / language / id; documents that are mostly a licence statement speak for their folder."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return licences.scan(documents(spark, sf_dir), "doc_id", path).withColumnRenamed("id", "doc_id")


def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.without_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = cotraining.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [F.col(f"__{c}").alias(c) for c in ("text_score", "meta_score", "score")]
    return cotraining.scored(docs, model).select("doc_id", *names, (F.col("__score") >= 0.5).alias("kept"))


def op8_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.without_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), d AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), f AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_docs
), r AS (
  SELECT q.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY q.item_id, f.doc_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def op12_cell_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_cosine.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (
  SELECT id, min(reach) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a AS id, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)
"""


def op13_derivation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivation_repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_pseudonyms": (op1_pseudonyms, None),
    "op2_mix_sources": (op2_mix_sources, OP2_SQL),
    "op3_syncmers": (op3_syncmers, None),
    "op4_minmax_hash": (op4_minmax_hash, None),
    "op5_licences": (op5_licences, None),
    "op6_suffix_automata": (op6_suffix_automata, None),
    "op7_cotraining": (op7_cotraining, None),
    "op8_prefix_free_parsing": (op8_prefix_free_parsing, None),
    "op9_pack": (op9_pack, None),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_bit_sliced_search": (op11_bit_sliced_search, OP11_SQL),
    "op12_cell_cosine": (op12_cell_cosine, OP12_SQL),
    "op13_derivation_repair": (op13_derivation_repair, None),
}
