"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, jaccard, language, licenses, line_dedup, mixing, sharding, spelling, token_files, url_filter, whitening
from .shared import table

END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, folder, manifest)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs), spans=True)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    kind = "conv_id bigint, turn bigint, role string, text string"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = given.to(spark.createDataFrame([], kind).schema).unionByName(own)
    out = chat.read_back(chat.format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(F.encode(learned, "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# The stated rules.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the last number of its path; that document's label is its URL's: blocked if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/0-9?#]*(?:/?[?#].*|/?)$', 1) AS bigint)").alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return url_filter.judge(pages, labelled, URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_token_files, op2_language_id, op3_ngram_jaccard, op4_decontamination, op5_sharding, op6_mixing, op7_exact_dedup, op8_license_scan, op9_line_dedup, op10_chat_format]
    ops += [op11_embedding_whitening, op12_spelling_variants, op13_url_filter]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS p FROM documents),
g AS (SELECT p, count(*) AS group_size, max(points) AS points FROM d GROUP BY p),
s AS (SELECT d.p, min(d.r) AS r FROM d JOIN (SELECT d.p, g.points, min(d.doc_id) AS doc_id FROM d JOIN g ON g.p = d.p AND g.points = d.points GROUP BY ALL) m
  ON m.p = d.p AND m.points = d.points AND m.doc_id IS NOT DISTINCT FROM d.doc_id GROUP BY d.p)
SELECT d.doc_id, k.doc_id AS keep_id, group_size, d.r = k.r AS kept, sha256(d.p) AS text_sha256 FROM d JOIN g ON g.p = d.p JOIN s ON s.p = d.p JOIN d k ON k.r = s.r
"""

OP9_SQL = r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, 20 + length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op8_sql(least: float = 0.8) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    told = lambda n, i: ", ".join(map(quote, licenses.versions(licenses.normal_words(licenses.TEMPLATES[n][i]))))
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, b))}], [{told(n, i)}]::VARCHAR[])" for n, i, b in licenses.template_rows())
    return rf"""
WITH t(license, b, v) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, trim(unnest(a)) AS s, generate_subscripts(a, 1) - 1 AS i FROM d),
g AS (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS p FROM l),
u AS (SELECT r, doc_id, 'line' AS unit, i AS first_line, i + 1 AS end_line, s FROM l WHERE s <> ''
  UNION ALL SELECT r, doc_id, 'paragraph', min(i), max(i) + 1, string_agg(s, ' ' ORDER BY i) FROM g WHERE s <> '' GROUP BY r, doc_id, p HAVING count(*) > 1
  UNION ALL SELECT g.r, g.doc_id, 'document', 0, any_value(z.n), string_agg(s, ' ' ORDER BY i) FROM g JOIN (SELECT r, len(a) AS n FROM d) z ON z.r = g.r WHERE s <> '' GROUP BY g.r, g.doc_id HAVING count(DISTINCT p) > 1),
w AS (SELECT *, string_split_regex(s, ' +') AS x FROM u WHERE length(s) > length(replace(s, ' ', ''))),
v AS (SELECT r, doc_id, unit, first_line, end_line, list_transform(regexp_extract_all(s, '{licenses.VERSION}', 1), lambda y: CASE WHEN contains(y, ' ') THEN y ELSE y || ' 0' END) AS told, list_distinct(list_transform(list_zip(x[:-2], x[2:]), lambda y: y[1] || ' ' || y[2])) AS b FROM w WHERE len(x) >= 2),
m AS (SELECT r, doc_id, unit, first_line, end_line, license, 2.0::DOUBLE * len(list_intersect(v.b, t.b)) / (len(v.b) + len(t.b)) AS dice
  FROM v JOIN t ON len(t.b) * {least} <= len(v.b) * {2 - least} AND len(v.b) * {least} <= len(t.b) * {2 - least} AND (len(v.told) = 0 OR len(t.v) = 0 OR list_has_any(v.told, t.v)))
SELECT doc_id, unit, first_line::BIGINT AS first_line, end_line::BIGINT AS end_line, license, dice FROM m WHERE dice >= {least}
QUALIFY row_number() OVER (PARTITION BY r, unit, first_line ORDER BY dice DESC, license) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op8_license_scan": _op8_sql(), "op9_line_dedup": OP9_SQL, "op10_chat_format": OP10_SQL}
