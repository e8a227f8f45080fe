"""Registered queries of the training-data operators: ``(spark, sf_dir)``.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from residuum.llm import conversations_sql, line_dedup, mixing
from residuum.llm.shared import text_batches

#: The vocabulary file's path is a parameter of the operators; the queries use
#: the public tokenizers' word vocabulary.
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Packing uses the byte-level vocabulary; its documents end with id 0.
BYTE_VOCABULARY = "byte_bpe_50k.json"
BYTE_END_ID = 0
TOKEN_LIMIT = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.ngram_join import jaccard_components
    from residuum.llm.shared import Workspace

    return jaccard_components(read(spark, sf_dir, "documents"), Workspace(spark, "ngram-join"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.shared import Workspace
    from residuum.llm.warc import merge_runs, read_archives, resolve_revisits, write_archives

    work = Workspace(spark, "warc")
    captures = merge_runs(write_archives(read(spark, sf_dir, "pages"), work), work)
    return resolve_revisits(work.table(read_archives(captures), "records"), work)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from residuum.llm.decontaminate import contamination, is_contaminated
    from residuum.llm.shared import Workspace

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Workspace(spark, "decontaminate"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from residuum.llm.mixing import mix
    from residuum.llm.shared import Workspace

    mixed = mix(read(spark, sf_dir, "documents"), Workspace(spark, "mixing"))
    return mixed.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.line_dedup import drop_boilerplate
    from residuum.llm.shared import Workspace

    return drop_boilerplate(read(spark, sf_dir, "pages"), Workspace(spark, "line-dedup"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.shared import Workspace
    from residuum.llm.token_files import read_token_files, write_token_files

    work = Workspace(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents"), work, vocabulary_path(), END_ID)
    return read_token_files(manifest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.shared import Workspace
    from residuum.llm.suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), Workspace(spark, "suffix-dedup")).drop("spans")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from residuum.llm.multi_index import search
    from residuum.llm.shared import Workspace

    return search(read(spark, sf_dir, "embeddings"), Workspace(spark, "nearest"), k=20, is_query=F.col("_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from residuum.llm.toxicity import THRESHOLD, UNDECIDED, fit, score

    docs = read(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("null"))) % 3 == 1
    model = fit(docs, read(spark, sf_dir, "labels"), usable=~held_out("_id"), otherwise=UNDECIDED)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.prefix_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary_path(), TOKEN_LIMIT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.conversations import damage, repair_report
    from residuum.llm.shared import Workspace

    rows = read(spark, sf_dir, "conversations")
    return repair_report(rows, damage(rows), Workspace(spark, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.shared import Workspace
    from residuum.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), Workspace(spark, "whitening"), n_components=8)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from residuum.llm.packing import pack
    from residuum.llm.shared import Workspace

    return pack(read(spark, sf_dir, "documents"), Workspace(spark, "packing"), vocabulary_path(BYTE_VOCABULARY), TOKEN_LIMIT, BYTE_END_ID)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, coalesce(k.k, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a) k USING (doc_id)
"""

OP2_SQL = """
WITH h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages)),
f AS (SELECT d, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY d)
SELECT page_id, cast(n AS bigint) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM h LEFT JOIN f USING (d)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH i AS (SELECT coalesce(cast(item_id AS varchar), 'null') AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, k, n FROM g JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL: dict[str, str] = {
    "op1_ngram_join": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_mixing": mixing.oracle_sql(),
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op11_conversation_repair": conversations_sql.ORACLE_SQL,
}
