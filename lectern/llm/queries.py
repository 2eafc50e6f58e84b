"""The driver's queries over these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tokenizer_files
from .bitplanes import read_documents, write_shards
from .decontaminate import decontaminate
from .html_graph import extract
from .language_bloom import held_out, identify, train
from .minhash_dedup import near_dedup
from .mixing import mix, taken_words
from .progressive_jpeg import store_and_describe
from .template_lines import line_report
from .token_counts import count_tokens
from .url_markov import fit, judge, labelled_by_rules
from .workspace import bound_batches, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, cache = _table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"), new_path(spark, "token-counts")
    count_tokens(docs, path, cache=cache)  # fills the cache, which the result then comes from
    return count_tokens(docs, path, cache=cache, limit=512)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op4_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_shards(_table(spark, sf_dir, "documents"), tokenizer_files.path("word_bpe_49k.json"), end_id=2))


def op6_html_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, pieces, _ = mix(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, repeat=2.0)
    return taken_words(plan, pieces)


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_describe(_table(spark, sf_dir, "documents"))


def op9_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge(pages, fit(labelled_by_rules(pages)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_template_lines": op3_template_lines,
    "op4_prefix_decontamination": op4_prefix_decontamination,
    "op5_bit_plane_ids": op5_bit_plane_ids,
    "op6_html_graph": op6_html_graph,
    "op7_block_mixing": op7_block_mixing,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_language_bloom": op9_language_bloom,
    "op10_url_markov": op10_url_markov,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN link ON b = x),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)""",
    "op4_prefix_decontamination": rf"""WITH
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, w[k:k + size - 1] AS win FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, k, w[k:k + size - 1] AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw))),
m AS (SELECT doc_id, item_id, size, k FROM dw JOIN iw USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY 1),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS names FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
