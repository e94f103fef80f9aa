"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granula.llm import baskets, bpe, codes, exact, jaccard, langid, lines, mixing, preference, quality, substring, topk, toxicity
from granula.llm.common import WS


def tokenizer_path() -> str:
    """The vocabulary file of the encoding query; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark, sf_dir):
    return langid.identify(_docs(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.digests(_docs(spark, sf_dir), tokenizer_path())


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(_docs(spark, sf_dir))[0].select("doc_id", "n_shingles", "component_id")


def op4_ngram_jaccard_links(spark, sf_dir):
    """The number of all links of each document."""
    return jaccard.link_counts(_docs(spark, sf_dir))


def op5_substring_dedup(spark, sf_dir):
    return substring.digests(_docs(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return lines.digests(_docs(spark, sf_dir))


def op6_line_dedup_words(spark, sf_dir):
    """Also runs of fewer lines that have MIN_WORDS words."""
    return lines.digests(_docs(spark, sf_dir), lines.MIN_WORDS)


def op7_exact_dedup(spark, sf_dir):
    return exact.dedup(_docs(spark, sf_dir), exact.history_half())


def op8_topk_search(spark, sf_dir):
    return topk.every_50th(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_preference(spark, sf_dir):
    return preference.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_toxicity(spark, sf_dir):
    return toxicity.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_vector_codes(spark, sf_dir):
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality(spark, sf_dir):
    return quality.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_itemsets(spark, sf_dir):
    return baskets.itemsets(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_bpe, op4_ngram_jaccard, op4_ngram_jaccard_links, op5_substring_dedup, op6_line_dedup, op6_line_dedup_words, op7_exact_dedup, op8_topk_search, op9_preference, op10_toxicity, op11_vector_codes, op12_quality, op13_itemsets)}

_WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{WS}]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^{WS}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON a = d.doc_id
""",
    "op4_ngram_jaccard_links": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^{WS}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, count(*) AS c FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i) GROUP BY u)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_links FROM d LEFT JOIN l ON u = d.doc_id
""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f WHERE o < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
m AS (SELECT k.doc_id, count(*) AS n, count(c.j) AS cut, coalesce(string_agg(CASE WHEN c.j IS NULL THEN x END, ' ' ORDER BY k.j), '') AS kept
  FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(cut, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m ON m.doc_id = d.doc_id
""",
    "op6_line_dedup": lines.ORACLE,
    "op7_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[{WS}]+', '', 'g')) AS h FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
""",
    "op8_topk_search": topk.ORACLE,
    "op9_preference": preference.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op13_itemsets": baskets.ORACLE,
}
