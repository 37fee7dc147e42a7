"""One registered query per operator, each over its whole table, and the SQL twin where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import centroids, exact_dedup, language, lm, mixture, packing, pieces, quality, simhash, token_files, toxicity, trie, warc
from claimloom.llm.store import crc32_of, shared_folder, table

WEIGHTS = (5, 2, 1)
MOST = 3.0
MIX_SEED = 20
END_ID = 2
PACK_END_ID = 1
CLUSTERS = 16
CLUSTER_ROUNDS = 3
CLUSTER_SEED = 1
TRIE_FAMILY = 5
TRIE_CYCLE = 9
PACK_LIMITS = packing.Limits(tokens=2048, segments=64, loss_tokens=2047)


def op1_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    plan = mixture.mixture_plan(docs, WEIGHTS, MOST, MIX_SEED)
    mix = plan.columns[-1]
    size = F.col(f"{mix}.size")
    return plan.select(
        "doc_id",
        size.alias("size"),
        F.col(f"{mix}.source_size").alias("source_size"),
        F.col(f"{mix}.target").alias("target"),
        (size * F.col(f"{mix}.copies")).alias("taken"),
    )


OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS ceiling,
         coalesce(sum(3 * source_size) OVER before, 0) AS ceilings, coalesce(sum(weight) OVER before, 0) AS weights,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, ceiling * (all_weights - weights) < (total - ceilings) * weight AS is_full FROM ordered
), level AS (
  SELECT CAST(any_value(total) - coalesce(sum(ceiling) FILTER (is_full), 0) AS DOUBLE)
         / CAST(any_value(all_weights) - coalesce(sum(weight) FILTER (is_full), 0) AS DOUBLE) AS level
  FROM marked
), targets AS (
  SELECT source, source_size, least(CAST(ceiling AS DOUBLE), level * weight) AS target FROM marked, level
), rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rates
"""


def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = token_files.encoded(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", f"{found.columns[-1]}.*")


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(body) AS text_sha256
FROM texts
WINDOW best AS (PARTITION BY body ORDER BY code_points DESC, doc_id)
"""


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    path = shared_folder(spark, "warc")
    warc.write_archives(warc.record_plan(pages), path)
    found = warc.read_archives(spark, path)
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.nullif("page_id", F.lit("")).cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP4_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), firsts AS (
  SELECT *, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc32_of() % 3 != 1))
    found = language.identified(docs, model)
    return found.select("doc_id", (crc32_of() % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf, "documents").select("doc_id", "text"))


def op7_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = crc32_of() % 7 == 2
    found = lm.scored(docs, ~held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(crc32_of() % 3 != 1), table(spark, sf, "labels"))
    found = toxicity.scored(docs, model)
    result = found.columns[-1]
    return found.select(
        "doc_id", (crc32_of() % 3 == 1).alias("held_out"), f"{result}.score", f"{result}.predicted",
        F.col(f"{result}.evidence.doc_id").alias("evidence"),
    )


def op9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        "score", "restored",
    )


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.judged(quality.ledger(table(spark, sf, "documents")), "v1")
    base = F.lit(quality.mask_of("base")).cast("long")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits",
    )


OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts
), line_counts AS (
  SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), failed AS (
  SELECT *, CAST(
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * word_chars < 15 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 4 * n_symbols > n_words THEN 16 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM failed
"""


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_END_ID, PACK_LIMITS)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )



def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found, final = centroids.clustered(vectors, "embedding", CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED)
    return centroids.with_inertia(found, final)


def _op12_sql() -> str:
    """Every round assigns by the least distance * 16 + number and floors the means."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER () AS row_no,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, embedding) - 1 AS c, v
  FROM (SELECT *, sha256('{CLUSTER_SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS mark FROM kept)
  ORDER BY mark, embedding LIMIT {CLUSTERS}
)"""
    ]
    for r in range(CLUSTER_ROUNDS + 1):
        parts.append(f"""assigned{r} AS MATERIALIZED (
  SELECT row_no, any_value(vec_id) AS vec_id, any_value(k.v) AS v,
         min(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {CLUSTERS} + c) AS best
  FROM kept k, centroids{r} m GROUP BY row_no
)""")
        if r < CLUSTER_ROUNDS:
            parts.append(f"""means{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT best % {CLUSTERS} AS c, i, sum(v[i]) AS s, count(*) AS n
        FROM assigned{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c
), centroids{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(list_transform(means{r}.v, lambda x: CAST(x AS BIGINT)), centroids{r}.v) AS v
  FROM centroids{r} LEFT JOIN means{r} USING (c)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(best % {CLUSTERS} AS INTEGER) AS cluster, CAST(best // {CLUSTERS} AS BIGINT) AS distance,
       CAST(sum(best // {CLUSTERS}) OVER (PARTITION BY best % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // {CLUSTERS}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM assigned{CLUSTER_ROUNDS} JOIN centroids{CLUSTER_ROUNDS} m ON best % {CLUSTERS} = c
"""



def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.nodes(table(spark, sf, "conversations"), TRIE_FAMILY, TRIE_CYCLE)


OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
               md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {TRIE_FAMILY} AS base,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
         )) % {TRIE_CYCLE} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, id, bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, i, id, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
), members AS MATERIALIZED (
  SELECT conv_id, row_number() OVER step AS depth, string_agg(id, '') OVER step AS path, bytes FROM rebuilt
  WINDOW step AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
), nodes AS MATERIALIZED (
  SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY path
), children AS (
  SELECT substr(path, 1, len(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), own AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM nodes LEFT JOIN children USING (path)
), subtrees AS (
  SELECT m.path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM own JOIN members m ON m.conv_id = own.conv_id AND m.depth <= own.depth GROUP BY m.path
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS turns FROM members) WHERE depth = turns GROUP BY path
)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own JOIN subtrees USING (path) LEFT JOIN ends USING (path)
LEFT JOIN own above ON own.depth > 0 AND above.path = substr(own.path, 1, len(own.path) - 32)
"""

QUERIES = {
    "op1_mixture": (op1_mixture, OP1_SQL),
    "op2_token_files": (op2_token_files, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_language": (op5_language, None),
    "op6_simhash": (op6_simhash, None),
    "op7_language_model": (op7_language_model, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_pieces": (op9_pieces, None),
    "op10_quality": (op10_quality, OP10_SQL),
    "op11_packing": (op11_packing, None),
    "op12_centroids": (op12_centroids, _op12_sql()),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
