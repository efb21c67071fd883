"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import held_out, score_rows, train_classifier
from .common import inline_rows, read_table, written
from .dominance_pack import pack_documents
from .forest_search import nearest
from .jaccard_matrix import jaccard_components
from .license_scan import NAMES, label_list, scan_licenses
from .piece_codec import encode_documents
from .prefix_trie import conversation_trie
from .ring_shards import ring_shards
from .risk_rules import judge_documents
from .suffix_dedup import removed_bytes, without_repeats
from .token_blocks import token_blocks
from .url_equivalence import judge_pages
from .vector_codes import encode_vectors, train_codebooks


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(spark, read_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), words=5, percent=75)


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), width=2048)


def op5_dominance_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(read_table(spark, sf_dir, "documents"), names=NAMES)
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        label_list(F.col("base_labels")).alias("base_labels"),
        label_list(F.concat("base_labels", "found.label")).alias("labels"),
        F.coalesce(F.array_max("found.containment"), F.lit(0.0)).alias("score"),
    )


# host, path, verdict
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op7_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = json.dumps([dict(zip(("host", "path", "verdict"), r)) for r in URL_RULES])
    rules = inline_rows(spark, rules, "host: string, path: string, verdict: string")
    judged = judge_pages(read_table(spark, sf_dir, "pages"), rules, dots=True)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_classifier(docs, read_table(spark, sf_dir, "labels"))
    return score_rows(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    facts = [f"facts.{f}" for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge_documents(docs, labels).select("doc_id", *facts, "base_failed", "kept")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        removed_bytes(F.col("removed")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    return conversation_trie(read_table(spark, sf_dir, "conversations"), heads, base)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded = encode_vectors(vectors, train_codebooks(vectors)).drop("embedding")
    coded = written(coded)  # assigned once, for the rows and for the sums
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.col("codebooks").alias("codebooks_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_forest_search": op1_forest_search,
        "op2_jaccard_matrix": op2_jaccard_matrix,
        "op3_token_blocks": op3_token_blocks,
        "op4_ring_shards": op4_ring_shards,
        "op5_dominance_pack": op5_dominance_pack,
        "op6_license_scan": op6_license_scan,
        "op7_url_equivalence": op7_url_equivalence,
        "op8_byte_cnn": op8_byte_cnn,
        "op9_risk_rules": op9_risk_rules,
        "op10_piece_codec": op10_piece_codec,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_vector_codes": op13_vector_codes,
    }


_RULE_FITS = "\n    UNION ALL ".join(
    f"SELECT '{host}' AS h, '{path}' AS p, '{verdict}' AS ruled" for host, path, verdict in URL_RULES
)

# the given pages hold no canonical link and no refresh, so aliases are pages equal up to scheme and
# fragment, which share host, path and rule: what no rule fits is allowed
OP7_SQL = f"""
WITH rules AS ({_RULE_FITS}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         row_number() OVER () AS row_no
  FROM pages),
fits AS (
  SELECT row_no, arg_max(h || p, length(h || p)) AS rule, arg_max(ruled, length(h || p)) AS ruled
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (row_no)
"""



# two hex digits a byte; a window is 400 of them
OP11_SQL = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT row_no, s, md5(x[2 * s + 1 : 2 * s + 400]) AS w
  FROM (SELECT row_no, x, unnest(range(0, len(x) // 2 - 199)) AS s FROM texts WHERE len(x) >= 400)),
repeats AS (SELECT row_no, s FROM (SELECT row_no, s, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
runs AS (
  SELECT row_no, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT row_no, s, sum(fresh) OVER (PARTITION BY row_no ORDER BY s) AS run
        FROM (SELECT row_no, s, CASE WHEN s <= lag(s) OVER (PARTITION BY row_no ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh
              FROM repeats))
  GROUP BY row_no, run),
gaps AS (
  SELECT row_no, coalesce(lag(b) OVER (PARTITION BY row_no ORDER BY a), 0) AS g, a AS h, a, b FROM runs),
cut AS (
  SELECT row_no, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(x[2 * g + 1 : 2 * h], '' ORDER BY a) AS front
  FROM gaps JOIN texts USING (row_no) GROUP BY row_no)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front || x[2 * last + 1 :], x))) AS kept_sha256
FROM texts LEFT JOIN cut USING (row_no)
"""

# the unsigned CRC-32 of the decimal conv_id, bit by bit
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                    lambda x, bit: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n, {_CRC32} % 6 AS h, conv_id - conv_id % 100 AS base
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, b.pos, b.t, b.chars FROM convs AS c JOIN turns AS b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.t, o.chars
  FROM convs AS c JOIN turns AS o USING (conv_id) LEFT JOIN convs AS b ON b.conv_id = c.base WHERE o.pos > c.h),
members AS (
  SELECT conv_id, pos AS depth, list(t) OVER (PARTITION BY conv_id ORDER BY pos) AS path, chars FROM rebuilt
  UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '') AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY depth, path),
families AS MATERIALIZED (
  SELECT n.*, (SELECT count(*) FROM nodes AS c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children,
         (SELECT min(p.conv_id) FROM nodes AS p WHERE p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]) AS parent_conv_id
  FROM nodes AS n)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
       count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.chars)::BIGINT AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM families AS n JOIN families AS s ON s.depth >= n.depth AND s.path[:n.depth] = n.path
GROUP BY n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends, n.path
"""


def _op13_round(n: int) -> str:
    """Round ``n``: every part's nearest entry of book ``n``, then book ``n + 1``."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT row_no, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
  FROM (SELECT row_no, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM cells JOIN book{n} USING (p, j) GROUP BY row_no, p, e)
  GROUP BY row_no, p),
book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.y, b.y) AS y
  FROM book{n} AS b LEFT JOIN (
    SELECT p, e, j, floor_mean AS y FROM (
      SELECT p, e, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS floor_mean
      FROM cells JOIN near{n} USING (row_no, p) GROUP BY p, e, j)) AS m USING (p, e, j))"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row_no,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT row_no, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS j, v[i] AS x
  FROM (SELECT row_no, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT p, row_no AS e, j, x AS y FROM cells WHERE row_no < 64),
{_op13_round(0)},
{_op13_round(1)},
{_op13_round(2)},
coded AS (
  SELECT row_no, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row_no),
books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no), books
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_equivalence": OP7_SQL, "op11_suffix_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
