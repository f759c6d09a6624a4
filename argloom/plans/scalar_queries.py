"""Queries of the text and score expressions over documents, pages, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from argloom.functions import scores as S
from argloom.functions import text as T
from argloom.operators.phrases import find_phrases
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, PREDICTIONS_SQL, edges, nodes, predictions, query, table

_NODE_RAW = "'str:' || CASE c_mktsegment WHEN 'BUILDING' THEN 'TheoreticalHypothesis' WHEN 'MACHINERY' THEN 'core-axiom' WHEN 'FURNITURE' THEN 'Claim' WHEN 'HOUSEHOLD' THEN 'ActualModel' ELSE 'Thing' END"


@query(
    "scl01_node_type",
    f"WITH r AS (SELECT c_custkey, {_NODE_RAW} AS raw FROM customer) SELECT raw, CASE raw WHEN 'str:TheoreticalHypothesis' THEN 'hypothesis' WHEN 'str:core-axiom' THEN 'axiom' WHEN 'str:Claim' THEN 'claim' WHEN 'str:ActualModel' THEN 'actual_model' ELSE 'concept' END AS node_type, count(*) AS n FROM r GROUP BY 1, 2",
)
def _(spark, d):
    raw = F.expr(_NODE_RAW)
    kind = T.parse_label(F.col("raw"), ["axiom", "hypothesis", "claim", "concept", "evidence", "actual_model", "paradigm"], T.NODE_ALIASES, "concept")
    return table(spark, d, "customer").select(raw.alias("raw")).groupBy("raw", kind.alias("node_type")).agg(F.count("*").alias("n"))


@query(
    "scl03_relation_type",
    "WITH r AS (SELECT CASE event_type WHEN 'error' THEN 'Refutes' WHEN 'purchase' THEN 'ex:Entails' WHEN 'view' THEN 'supports' ELSE event_type END AS raw FROM events)"
    " SELECT raw, CASE raw WHEN 'Refutes' THEN 'attacks' WHEN 'ex:Entails' THEN 'supports' WHEN 'supports' THEN 'supports' ELSE 'explains' END AS relation, count(*) AS n FROM r GROUP BY 1, 2",
)
def _(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "error", "Refutes").when(kind == "purchase", "ex:Entails").when(kind == "view", "supports").otherwise(kind)
    parsed = T.parse_label(F.col("raw"), ["attacks", "supports", "explains"], T.RELATION_ALIASES, "explains")
    return table(spark, d, "events").select(raw.alias("raw")).groupBy("raw", parsed.alias("relation")).agg(F.count("*").alias("n"))


@query(
    "scl05_polarity",
    f"WITH {EDGES_SQL} SELECT relation, CASE WHEN l_linenumber = 1 THEN -1 WHEN relation = 'attacks' THEN -1 ELSE 1 END AS sign, count(*) AS n FROM e GROUP BY 1, 2",
)
def _(spark, d):
    explicit = F.when(F.col("l_linenumber") == 1, -3)
    return edges(spark, d).groupBy("relation", T.resolved_polarity(explicit, F.col("relation")).alias("sign")).agg(F.count("*").alias("n"))


@query("scl07_warrant", f"WITH {EDGES_SQL} SELECT relation, 0.75 AS warrant, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return edges(spark, d).groupBy("relation", T.warrant(F.col("relation")).alias("warrant")).agg(F.count("*").alias("n"))


@query(
    "scl08_modal_strength",
    f"WITH {NODES_SQL} SELECT node_type, nation % 4 AS scope_id, CASE WHEN nation % 4 = 0 THEN 0.9 WHEN nation % 4 = 1 THEN 0.75 WHEN node_type = 'axiom' THEN 1.0 WHEN node_type = 'evidence' THEN 0.85 ELSE 0.6 END AS strength, count(*) AS n FROM n GROUP BY 1, 2, 3",
)
def _(spark, d):
    k = F.col("nation") % 4
    scope = F.when(k == 0, "essential").when(k == 1, "statistical").otherwise("none")
    return nodes(spark, d).groupBy("node_type", k.alias("scope_id"), S.modal_strength(scope, F.col("node_type"), F.lit("empirical")).alias("strength")).agg(F.count("*").alias("n"))


@query("scl10_formula", "SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(replace(p_name || '  {' || p_brand || '} \\cdot  X', '\\cdot', '*'), '[{}]', '', 'g'), '\\s+', ' ', 'g'))) AS formula FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normal_formula(F.concat("p_name", F.lit("  {"), "p_brand", F.lit("} \\cdot  X"))).alias("formula"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"


@query("scl11_token_jaccard", f"SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT p_partkey, {_TOK.format('p_name')} AS a, {_TOK.format('p_type')} AS b FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.set_jaccard(T.token_set(F.col("p_name")), T.token_set(F.col("p_type"))), 6).alias("jaccard"))


@query(
    "scl12_span_iou",
    "SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS start, round(greatest(0, least(strpos(d.text, b.text) - 1 + length(b.text), n_chars // 2) - (strpos(d.text, b.text) - 1))"
    " / (greatest(strpos(d.text, b.text) - 1 + length(b.text), n_chars // 2)), 6) AS iou FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def _(spark, d):
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    docs = table(spark, d, "documents")
    hits = find_phrases(docs, passages).join(docs.select("doc_id", "n_chars"), "doc_id").join(passages, "phrase_id").withColumnRenamed("phrase_id", "item_id")
    start = F.col("start")
    return hits.select("item_id", "doc_id", start.cast("bigint").alias("start"), F.round(S.span_iou(start, start + F.length("phrase"), F.lit(0), F.floor(F.col("n_chars") / 2)), 6).alias("iou"))


@query(
    "scl13_box_iou",
    "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y FROM lineitem), i AS (SELECT *, greatest(0, least(x + 10, 30) - greatest(x, 20)) * greatest(0, least(y + 5, 8) - greatest(y, 3)) AS o FROM b)"
    " SELECT l_orderkey, l_linenumber, round(o / (50 + 50 - o), 6) AS iou FROM i WHERE o > 0",
)
def _(spark, d):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    iou = S.box_iou([x, y, x + 10, y + 5], [F.lit(20.0), F.lit(3.0), F.lit(30.0), F.lit(8.0)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(iou, 6).alias("iou")).filter("iou > 0")


@query("scl18_sections", "SELECT page_id, len(regexp_extract_all(html, '<h[12][^>]*>')) AS n_headings FROM pages WHERE len(regexp_extract_all(html, '<h[12][^>]*>')) > 0")
def _(spark, d):
    parts = table(spark, d, "pages").select("page_id", F.explode(T.sections(T.headings_of_html(F.col("html")))).alias("s"))
    return parts.filter("s.title <> 'Preamble'").groupBy("page_id").agg(F.count("*").alias("n_headings"))


@query("scl19_sentences", "SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS n_sentences, len(regexp_split_to_array(text, '\\n{2,}')) AS n_paragraphs FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"), F.size(T.paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))


@query("scl20_token_estimate", "SELECT doc_id, greatest(1, floor(len(regexp_split_to_array(trim(text, ' '), '\\s+')) * 1.35))::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("scl22_typography", "SELECT doc_id, md5(trim(regexp_replace(replace(translate(text, '‘’“”–—', '''''\"\"--'), '…', '...'), '\\s+', ' ', 'g'))) AS plain FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.typography(F.col("text")), "UTF-8")).alias("plain"))


@query("scl24_stable_ids", "SELECT doc_id, left(sha256(lang || '::' || source), 16) AS entity_id, left(sha256(left(text, 200)), 12) AS text_id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id(F.col("lang"), F.col("source")).alias("entity_id"), T.stable_id(F.substring("text", 1, 200), size=12).alias("text_id"))


@query("scl28_name_overlap", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND least(length(a.n_name), length(b.n_name)) >= 4 AND (contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name)))")
def _(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))), F.expr("a < b"))
    return pairs.filter(T.name_overlap(F.col("x"), F.col("y")) == 1.0).select("a", "b")


@query("scl29_redaction", "SELECT event_id, CASE WHEN event_type = 'error' THEN '***' ELSE value::VARCHAR END = '***' AS hidden FROM events")
def _(spark, d):
    props = F.create_map(F.when(F.col("event_type") == "error", "api_key").otherwise(F.lit("amount")), F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", (F.map_values(T.redact(props, "key|token|secret|password"))[0] == "***").alias("hidden"))


@query(
    "scl31_derived_weights",
    f"WITH {EDGES_SQL} SELECT relation, round(sum(coalesce(weight * confidence, weight)), 4) AS effective, round(sum(coalesce(0.75 * confidence, 0.75 * 0.6)), 4) AS active FROM e GROUP BY relation",
)
def _(spark, d):
    effective = F.coalesce(F.col("weight") * F.col("confidence"), F.col("weight"))
    active = 0.75 * F.coalesce(F.col("confidence"), F.lit(0.6))
    return edges(spark, d).groupBy("relation").agg(F.round(F.sum(effective), 4).alias("effective"), F.round(F.sum(active), 4).alias("active"))


EMBED_SQL = (
    "tok AS (SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM {t}),"
    " byt AS (SELECT id, ('0x' || right(md5(token), 2))::INTEGER AS b FROM tok),"
    " slo AS (SELECT id, b % 128 AS slot, sum(CASE WHEN b >= 128 THEN 1 ELSE -1 END) AS x FROM byt GROUP BY 1, 2 HAVING sum(CASE WHEN b >= 128 THEN 1 ELSE -1 END) <> 0),"
    " nor AS (SELECT id, sqrt(sum(x * x)) AS norm FROM slo GROUP BY id),"
    " {name} AS (SELECT slo.id AS id, slot, x / norm AS x FROM slo JOIN nor ON slo.id = nor.id)"
)


@query("scl33_hash_embedding", f"WITH {EMBED_SQL.format(id='doc_id', t='documents', name='v')} SELECT id, count(*) AS n_slots, round(sum(slot * x), 5) AS moment FROM v GROUP BY id")
def _(spark, d):
    v = T.hash_embedding(table(spark, d, "documents"), "doc_id", "text")
    return v.groupBy("id").agg(F.count("*").alias("n_slots"), F.round(F.sum(F.col("slot") * F.col("x")), 5).alias("moment"))


@query("scl34_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS cosine FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = v.filter("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.join(F.broadcast(one), F.lit(True)).select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 5).alias("cosine"))


@query("scl35_score_normalization", "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > 1 OR min(value) OVER (PARTITION BY user_id) < 0 THEN 1 / (1 + exp(-value)) ELSE value END, 6) AS score FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id")
    outside = (F.max("value").over(w) > 1) | (F.min("value").over(w) < 0)
    return table(spark, d, "events").select("event_id", F.round(F.when(outside, 1 / (1 + F.exp(-F.col("value")))).otherwise(F.col("value")), 6).alias("score"))


@query("scl36_evidence_location", "SELECT doc_id, strpos(text, '.') AS at, CASE WHEN strpos(text, '.') > 0 THEN 'substring' ELSE 'whole_chunk' END AS mode FROM documents")
def _(spark, d):
    at = F.locate(".", "text")
    return table(spark, d, "documents").select("doc_id", at.cast("bigint").alias("at"), F.when(at > 0, "substring").otherwise("whole_chunk").alias("mode"))


@query("scl38_token_saving", "SELECT conv_id, turn, (floor(length(text) / 4) + floor(length(role) / 4) + 8 * turn + 50)::BIGINT AS saving FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.token_saving(F.length("text"), F.length("role"), F.col("turn")).cast("bigint").alias("saving"))


@query("mth02_soft_gate", f"WITH {PREDICTIONS_SQL} SELECT doc_id, round(1 / (1 + exp(-least(30, greatest(-30, 20 * (confidence - 0.5))))), 6) AS gate FROM pred")
def _(spark, d):
    return predictions(spark, d).select("doc_id", F.round(S.soft_gate(F.col("confidence"), 0.5), 6).alias("gate"))


@query("mth03_impact", "SELECT c_custkey, round(greatest(c_acctbal / 1000, 0) * greatest(c_acctbal / 1000, 0) / (1 + greatest(c_acctbal / 1000, 0) * greatest(c_acctbal / 1000, 0)), 6) AS impact FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.impact(F.col("c_acctbal") / 1000), 6).alias("impact"))


@query("mth05_degradation", "SELECT user_id, round(CASE WHEN sum(value) FILTER (event_type <> 'error') <= 0 THEN 0 ELSE least(1, greatest(-1, 1 - sum(value) FILTER (event_type = 'view') / sum(value) FILTER (event_type <> 'error'))) END, 6) AS rdf FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type <> 'error') > 0")
def _(spark, d):
    kind = F.col("event_type")
    sums = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(kind != "error", F.col("value"))).alias("clean"), F.sum(F.when(kind == "view", F.col("value"))).alias("perturbed"))
    return sums.filter("clean IS NOT NULL AND perturbed IS NOT NULL").select("user_id", F.round(S.degradation(F.col("clean"), F.col("perturbed")), 6).alias("rdf"))


@query("mth10_expected_modality", "SELECT user_id, round(least(0.95, greatest(0.3, sum(p * l) / sum(p) / 10)), 4) AS modality FROM (SELECT user_id, event_type, count(*) AS p, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 4 WHEN 'view' THEN 6 ELSE 9 END AS l FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(spark, d):
    kind = F.col("event_type")
    level = F.when(kind == "error", 1).when(kind == "click", 4).when(kind == "view", 6).otherwise(9)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.sum(level) / F.count("*") / 10)), 4).alias("modality"))


@query("dat01_duration", "SELECT user_id, greatest(0.0, epoch(max(ts) FILTER (event_type = 'purchase')) - epoch(min(ts) FILTER (event_type = 'view'))) AS seconds FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'view') > 0")
def _(spark, d):
    at = lambda agg, kind: F.unix_micros(agg(F.when(F.col("event_type") == kind, F.col("ts"))).cast("timestamp")) / 1e6
    both = table(spark, d, "events").groupBy("user_id").agg(at(F.max, "purchase").alias("b"), at(F.min, "view").alias("a")).filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select("user_id", F.greatest(F.lit(0.0), F.col("b") - F.col("a")).alias("seconds"))


@query("arr01_last_distinct", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS f_at FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f_at DESC) AS k FROM f) SELECT user_id, string_agg(event_type, ',' ORDER BY f_at) AS recent FROM r WHERE k <= 3 GROUP BY user_id")
def _(spark, d):
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "event_type"))).alias("x"))
    return seen.select("user_id", F.array_join(F.slice("x.event_type", F.greatest(F.lit(1), F.size("x") - 2), 3), ",").alias("recent"))


@query("arr02_shared_chunk", "WITH m AS (SELECT o_custkey AS a, list(DISTINCT l_partkey) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT x.a AS a, coalesce(list_min(list_intersect(x.p, y.p))::VARCHAR, 'global') AS chunk FROM m x JOIN m y ON y.a = x.a + 1")
def _(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("a")).agg(F.collect_set("l_partkey").alias("p"))
    both = m.join(m.select((F.col("a") - 1).alias("a"), F.col("p").alias("q")), "a")
    return both.select("a", F.coalesce(F.array_min(F.array_intersect("p", "q")).cast("string"), F.lit("global")).alias("chunk"))


@query("map01_parameter_merge", "SELECT user_id, max(value) FILTER (event_type = 'purchase') IS NOT NULL AS has_purchase, count(DISTINCT event_type) AS n_keys, round(coalesce(max_by(value, (ts, event_id)) FILTER (event_type = 'click'), -1), 4) AS last_click FROM events GROUP BY user_id")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.map_contains_key("m", "purchase").alias("has_purchase"), F.size("m").cast("bigint").alias("n_keys"), F.round(F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(-1.0)), 4).alias("last_click"))


@query("jsn01_json_property", "SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def _(spark, d):
    parsed = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").cast("bigint").alias("k_sum"))


@query("jsn02_row_as_json", "SELECT r_regionkey, '{\"name\":\"' || r_name || '\",\"n\":' || count(n_nationkey) || '}' AS j FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def _(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "region").join(n, "r_regionkey").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), "n")).alias("j"))


@query("src01_markdown", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.encode(T.markdown(F.col("html")), "UTF-8")).alias("text"))


@query("src03_latex_cleanup", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace('x ' || lang || ' y ' || text, '\\\\[a-zA-Z]+\\*?\\{([^}]*)\\}', '\\1', 'g'), '\\\\[a-zA-Z]+\\*?', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')) AS chars FROM documents")
def _(spark, d):
    raw = F.concat(F.lit("\\emph{x} \\textbf{"), "lang", F.lit("} \\noindent y "), "text")
    return table(spark, d, "documents").select("doc_id", F.length(T.latex(raw)).cast("bigint").alias("chars"))
