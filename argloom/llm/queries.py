"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.llm._spark import table
from argloom.llm.bpe import token_digests
from argloom.llm.chat_format import conversation_digests, expand
from argloom.llm.cuckoo_dedup import exact_groups
from argloom.llm.gru_lm import score
from argloom.llm.jaccard_join import jaccard_classes
from argloom.llm.license_scan import find_notices, notice_digest
from argloom.llm.pfair_mixing import mix_order
from argloom.llm.quality_rules import quality_report
from argloom.llm.rlz_dedup import parse_against_earlier
from argloom.llm.secret_scan import scan
from argloom.llm.shallot import cluster
from argloom.llm.token_alignment import align
from argloom.llm.virtual_slots import shard_by_bytes

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, o = x.n AND o = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND same), d.doc_id)) AS class_id,
       (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(table(spark, sf_dir, "documents"))


def op4_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_against_earlier(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
v AS (SELECT least(199, 200 * f // n) AS r, sum(least(n, 20)) AS w FROM h GROUP BY 1),
c AS (SELECT r, sum(w) OVER (ORDER BY r) AS c, sum(w) OVER () AS t FROM v),
q AS (SELECT (min(r) FILTER (4 * c >= 2 * t) + 0.5) / 200.0::DOUBLE AS mu,
             ((min(r) FILTER (4 * c >= 3 * t) + 0.5) / 200.0::DOUBLE - (min(r) FILTER (4 * c >= t) + 0.5) / 200.0::DOUBLE) / 1.349::DOUBLE + 0.005::DOUBLE AS s FROM c),
p AS (SELECT mu, s, least(20.0::DOUBLE, greatest(1.0::DOUBLE, mu * (1 - mu) / (s * s) - 1)) AS w FROM q),
k AS (SELECT source, n, (f + w * mu) / (n + w) AS rate, w, mu, s FROM h, p),
j AS (SELECT source, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + w + 1)) > greatest(0.25::DOUBLE, mu + 3 * s) AS rejected FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       coalesce(rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN j ON b.source = j.source
"""


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "map_version", (F.col("shard") != F.col("map_shard")).alias("moved"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversation_digests(expand(turns))


OP7_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             count(*) OVER (PARTITION BY conv_id) AS last,
             23 + length(role) + length(text)
               + len(regexp_extract_all(role || chr(10) || text, '<\\\\*(\\|turn\\|>|\\|text\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>)'))
               + len(regexp_extract_all(role || chr(10) || text, '\\[\\\\*(/?INST\\])')) AS chars
      FROM c),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' OR i = last AS example FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (example))::BIGINT AS formatted_chars, count(*) FILTER (example) AS n_examples
FROM e GROUP BY conv_id
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice_digest(find_notices(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 10) -> str:
    """One step a round: each component of a vector meets each centroid's, the nearest centroid is taken, and the means are rounded down."""
    assign = (
        "a{i} AS MATERIALIZED (SELECT rid, k, dist FROM (SELECT v.rid, c.k, sum((v.x - c.x) * (v.x - c.x)) AS dist, row_number() OVER (PARTITION BY v.rid ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.k) AS place"
        " FROM v JOIN c{i} c ON v.i = c.i GROUP BY v.rid, c.k) WHERE place = 1)"
    )
    means = (
        "c{n} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS x"
        " FROM (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v ON v.rid = a.rid GROUP BY 1, 2)) m ON m.k = c.k AND m.i = c.i)"
    )
    steps = [assign.format(i=0)]
    for i in range(rounds):
        steps += [means.format(i=i, n=i + 1), assign.format(i=i + 1)]
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM e, range(1, 65) r(i)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS k FROM e),
c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN v ON v.rid = f.rid WHERE k < 8),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, a.k::INT AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256,
       count(*) OVER (PARTITION BY a.k) AS size
FROM a{rounds} a JOIN e ON e.rid = a.rid JOIN h ON h.k = a.k
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_rlz_dedup": op4_rlz_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_chat_format": op7_chat_format,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_gru_lm": op9_gru_lm,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_license_scan": op11_license_scan,
    "op12_token_alignment": op12_token_alignment,
    "op13_shallot_clusters": op13_shallot_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op4_rlz_dedup": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op13_shallot_clusters": OP13_SQL,
}
