"""Every registered query with the SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import exprs, hashing
from weft.operators import dedup, deliver, entities, graph, ingest, resolve
from weft.session import checkpoint_root, cut
from weft.sources.fixture import graph_fixture
from weft.sources.plugins import Echo, read_plugin, registry, replace_tools
from weft.sources.tables import load
from weft.streaming import topics
from weft.streaming.dedup import stream_dedup as deduplicate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql is not None:
            _SQL[query.__name__] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Ingest --------------------------------------------------------------------


@register("""
SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source, coalesce(source, 'default') AS tenant_id,
       'unknown' AS plugin_version, '1.0' AS schema_version, text AS payload FROM documents""")
def envelope_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return ingest.envelope(d, F.col("text"), F.col("source"), F.col("source"), F.col("doc_id").cast("string"), F.lit(""))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("payload"))
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html")).alias("payload"))
    events = load(spark, sf_dir, "events").select(F.lit("events").alias("origin"), F.col("event_id").alias("id"), F.from_json("props", "map<string,string>").alias("payload"))
    return docs.unionByName(pages).unionByName(events)


_ERRORS_SQL = """
WITH p AS (
  SELECT 'documents' AS origin, doc_id AS id, [struct_pack(k := 'text', v := text)] AS kv FROM documents
  UNION ALL SELECT 'pages', page_id, [struct_pack(k := 'url', v := url), struct_pack(k := 'html', v := html)] FROM pages
  UNION ALL SELECT 'events', event_id, list_transform(json_keys(props), lambda x: struct_pack(k := x, v := json_extract_string(props, '$.' || x))) FROM events),
j AS (SELECT origin, id, len(kv) = 0 AS is_empty,
  len(list_filter(kv, lambda x: x.v IS NULL OR x.v = '')) AS n_blank,
  list_transform(list_filter(kv, lambda x: x.v IS NULL OR x.v = ''), lambda x: x.k)[1] AS blank,
  len(list_filter(kv, lambda x: x.k IN ('text','content','data','url'))) = 0 AS lacking FROM p)
"""


@register(_ERRORS_SQL + """
SELECT origin, id, CAST(CASE WHEN is_empty THEN 1 ELSE n_blank + CAST(lacking AS INT) END AS BIGINT) AS n_errors,
  NOT (is_empty OR n_blank > 0 OR lacking) AS valid,
  CASE WHEN is_empty THEN 'payload:payload must not be empty'
       WHEN n_blank > 0 THEN 'payload.' || blank || ':value must not be None or empty string'
       WHEN lacking THEN 'payload:must contain at least one of: text, content, data, url' END AS reason FROM j""")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(_payloads(spark, sf_dir)).select("origin", "id", F.size("errors").cast("long").alias("n_errors"), "valid", "reason")


@register(_ERRORS_SQL + """
, e AS (SELECT origin, CASE WHEN is_empty THEN 'payload must not be empty'
   WHEN lacking THEN 'payload must contain at least one of: text, content, data, url'
   WHEN n_blank > 0 THEN 'payload.' || blank || ' must not be None or empty string' END AS error FROM j)
SELECT origin, coalesce(error, 'ok') AS error, count(*) AS n FROM e GROUP BY ALL""")
def dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _payloads(spark, sf_dir).withColumn("error", F.coalesce(exprs.first_violation(F.col("payload")), F.lit("ok")))
    return deliver.counters(judged, ["origin", "error"])


@register("""
WITH u AS (SELECT url AS source FROM pages UNION ALL SELECT source FROM documents)
SELECT source, regexp_matches(source, '^https?://[^/?#]+') AS valid, count(*) AS n FROM u GROUP BY ALL""")
def validate_source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "pages").select(F.col("url").alias("source")).union(load(spark, sf_dir, "documents").select("source"))
    return u.groupBy("source", exprs.http_url(F.col("source")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT 'documents' AS origin, doc_id AS id, length(coalesce(nullif(text, ''), '')) AS n_chars FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, length(coalesce(nullif(text, ''), nullif(role, ''), '')) FROM conversations""")
def text_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), exprs.pick_text(F.col("text")).alias("t"))
    c = load(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), exprs.pick_text(F.col("text"), F.col("role")).alias("t"))
    return d.union(c).select("origin", "id", F.length("t").cast("long").alias("n_chars"))


@register("""
SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS is_json FROM events""")
def parse_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest.parse_objects(load(spark, sf_dir, "events"), "props")
    return e.select("event_id", F.try_variant_get("payload", "$.k", "string").alias("k"), F.lit(True).alias("is_json"))


@register("""
WITH l AS (SELECT conv_id AS stream, turn AS seq, CASE WHEN turn = 3 THEN 'data: [DONE]' WHEN role = 'user'
  THEN 'data: {"n": ' || CAST(length(text) AS VARCHAR) || '}' ELSE 'event: ping' END AS line FROM conversations),
d AS (SELECT stream, seq, trim(substr(line, 6)) AS body FROM l WHERE line LIKE 'data:%'),
e AS (SELECT stream, min(seq) AS stop FROM d WHERE body = '[DONE]' GROUP BY stream)
SELECT d.stream, d.seq, d.body FROM d LEFT JOIN e USING (stream) WHERE (stop IS NULL OR seq < stop) AND json_valid(body)""")
def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    user = F.concat(F.lit('data: {"n": '), F.length("text").cast("string"), F.lit("}"))
    line = F.when(F.col("turn") == 3, "data: [DONE]").when(F.col("role") == "user", user).otherwise("event: ping")
    return ingest.sse_payloads(c.select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), line.alias("line")))


@register("""
SELECT page_id, ltrim(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '/') AS object_key FROM pages""")
def url_path_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.coalesce(exprs.url_path_key(F.col("url")), F.lit("")).alias("object_key"))


# Deduplication -------------------------------------------------------------


@register("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@register("""SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS content_key FROM events""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", hashing.content_key(F.col("props")).alias("content_key"))


@register("""SELECT event_id, sha256('{"k": ' || json_extract_string(props, '$.k') || '}') AS content_hash FROM events""")
def exact_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", hashing.exact_content_hash(F.col("props")).alias("content_hash"))


@register("SELECT source AS tenant_id, sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    return dedup.first_seen(d, ["tenant_id", "content_hash"], ["doc_id"])


_TTL_SQL = """
WITH g AS (SELECT event_id, user_id, event_type, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events),
f AS (SELECT *, gap IS NULL OR gap > 86400 AS is_new FROM g)
"""


def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.sliding_ttl(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 86_400)


@register(_TTL_SQL + "SELECT event_id, is_new FROM f")
def dedup_sliding_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ttl(spark, sf_dir).select("event_id", "is_new")


@register(_TTL_SQL + """
, r AS (SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM f)
SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, event_type, run""")
def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.clusters(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 86_400)


@register(_TTL_SQL + "SELECT user_id AS tenant_id, count(*) AS n FROM f WHERE NOT is_new GROUP BY 1")
def dedup_drops_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.counters(_ttl(spark, sf_dir).where("not is_new").select(F.col("user_id").alias("tenant_id")), ["tenant_id"])


@register("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE lang = 'en' AND source = 'src7'")
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tenant_id"), "source", F.sha2("text", 256).alias("content_hash"))
    return dedup.find_similar(d, "en", "src7").select("doc_id", "content_hash")


# Confidence and alerts ------------------------------------------------------

_CONF_SQL = """
WITH t AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, user_id, count(*) AS n_entities, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2),
c AS (SELECT *, least(1.0::DOUBLE, 0.1::DOUBLE * n_entities + 0.05::DOUBLE * kinds) AS confidence FROM t)
"""


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    t = e.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n_entities"), F.countDistinct("event_type").alias("kinds"))
    return t.withColumn("confidence", exprs.confidence(F.col("n_entities"), F.col("kinds")))


@register(_CONF_SQL + "SELECT day, user_id, n_entities, kinds, round(confidence, 6) AS confidence FROM c")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def _le_sql(source: str, value: str, bounds: tuple) -> str:
    parts = [f"SELECT '{float(b)}' AS le, count(*) FILTER (WHERE {value} <= {float(b)}::DOUBLE) AS n FROM {source}" for b in bounds]
    return " UNION ALL ".join([*parts, f"SELECT '+Inf', count(*) FROM {source}"])


@register(_CONF_SQL + _le_sql("c", "confidence", exprs.CONFIDENCE_BOUNDS))
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.histogram(_confidence(spark, sf_dir), "confidence", exprs.CONFIDENCE_BOUNDS)


@register(_CONF_SQL + """
SELECT 'tenant:' || user_id AS room, day, n_entities || CASE WHEN n_entities = 1 THEN ' entity' ELSE ' entities' END || ' extracted' AS summary,
  round(confidence, 6) AS confidence FROM c WHERE confidence > 0.5::DOUBLE""")
def alerts_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = deliver.alerts(_confidence(spark, sf_dir))
    return a.select(deliver.room(F.col("user_id").cast("string")).alias("room"), "day", "summary", F.round("confidence", 6).alias("confidence"))


@register("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS alert_count FROM events WHERE event_type = 'error'")
def alert_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return deliver.running_count(e, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "alert_count")


@register("""
SELECT DISTINCT p.event_id FROM events p JOIN events a ON a.user_id = p.user_id AND a.event_type = 'error'
  AND a.ts <= p.ts AND epoch(p.ts) - epoch(a.ts) < 3600""")
def highlight_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return deliver.highlight_active(e.where("event_type = 'error'"), e, "user_id", "ts", 3600).select("event_id")


# Resolution ------------------------------------------------------------------

_TOPK_SQL = """
WITH s AS (SELECT a.vec_id AS id, b.vec_id AS candidate_id,
   round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id) AS rk FROM s),
k AS (SELECT id, candidate_id, score FROM r WHERE rk <= 5 AND id <> candidate_id)
"""


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("default").alias("tenant_id"))
    return resolve.vector_topk(e, e).select("id", "candidate_id", "score")


@register("""
WITH e AS (SELECT 't' || vec_id % 3 AS tenant_id, vec_id // 3 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.tenant_id, a.id, b.id AS candidate_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b USING (tenant_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, id ORDER BY score DESC, candidate_id) AS rk FROM s)
SELECT tenant_id, id, candidate_id, score FROM r WHERE rk <= 5 AND id <> candidate_id""")
def vector_topk_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    e = e.select(F.concat(F.lit("t"), F.col("vec_id") % 3).alias("tenant_id"), F.floor(F.col("vec_id") / 3).alias("id"), "embedding")
    return resolve.vector_topk(e, e)


@register(_TOPK_SQL + "SELECT * FROM k")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir)


@register(_TOPK_SQL + """
, b AS (SELECT e.vec_id AS id, max(score) AS s, min_by(candidate_id, (-score, candidate_id)) AS c FROM embeddings e LEFT JOIN k ON k.id = e.vec_id GROUP BY 1)
SELECT id, CASE WHEN s >= 0.95 THEN 'auto_merge' WHEN s >= 0.5 THEN 'ambiguous' ELSE 'new_entity' END AS decision,
  CASE WHEN s >= 0.5 THEN c END AS matched_entity_id, coalesce(s, 0.0::DOUBLE) AS confidence_score FROM b""")
def vector_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return resolve.decide(e, _topk(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("tenant_id"), F.split("p_name", " ").alias("aliases"))


_NAME_SQL = "SELECT a.p_partkey AS id, b.p_partkey AS candidate_id, 1.0::DOUBLE AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_partkey <> b.p_partkey"


@register(_NAME_SQL)
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return resolve.name_match(p, p, ["tenant_id", "kind"])


@register("""
WITH w AS (SELECT DISTINCT p_partkey AS id, p_brand, p_type, unnest(string_split(p_name, ' ')) AS name FROM part),
a AS (SELECT DISTINCT p_partkey, p_brand, p_type, unnest(string_split(p_name, ' ')) AS alias FROM part)
SELECT DISTINCT w.id, a.p_partkey AS candidate_id, 1.0::DOUBLE AS score FROM w JOIN a ON w.p_brand = a.p_brand AND w.p_type = a.p_type AND w.name = a.alias AND w.id <> a.p_partkey""")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return resolve.alias_match(p.withColumn("name", F.explode("aliases")), p, ["tenant_id", "kind"])


_CO_SQL = """
WITH e AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
c AS (SELECT a.src AS id, b.src AS candidate_id, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2 HAVING count(*) >= 2)
"""


def _buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))


@register(_CO_SQL + "SELECT id, candidate_id, shared, least(shared / 10.0::DOUBLE, 1.0) AS score FROM c")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cooccurrence(_buys(spark, sf_dir))


@register(_CO_SQL + """
, b AS (SELECT c_custkey AS id, max(shared) AS m, min_by(candidate_id, (-least(shared / 10.0::DOUBLE, 1.0), candidate_id)) AS c FROM customer LEFT JOIN c ON id = c_custkey GROUP BY 1),
t AS (SELECT id, c, CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE least(m / 10.0::DOUBLE, 1.0) END AS s FROM b)
SELECT id, CASE WHEN s >= 0.95 THEN 'auto_merge' WHEN s >= 0.5 THEN 'ambiguous' ELSE 'new_entity' END AS decision,
  CASE WHEN s >= 0.5 THEN c END AS matched_entity_id, s AS confidence_score FROM t""")
def cooccurrence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return resolve.decide(c, resolve.cooccurrence(_buys(spark, sf_dir)))


_COPART_SQL = """
WITH e AS (SELECT DISTINCT l_partkey AS src, l_orderkey AS dst FROM lineitem),
c AS (SELECT a.src AS id, b.src AS candidate_id, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2 HAVING count(*) >= 2)
"""
_DECIDE_SQL = _COPART_SQL + f""", u AS ({_NAME_SQL} UNION ALL SELECT id, candidate_id, least(shared / 10.0::DOUBLE, 1.0) FROM c),
m AS (SELECT id, candidate_id, max(score) AS score FROM u GROUP BY 1, 2),
b AS (SELECT p_partkey AS id, coalesce(max(score), 0.0::DOUBLE) AS s, min_by(candidate_id, (-score, candidate_id)) AS c FROM part LEFT JOIN m ON m.id = p_partkey GROUP BY 1),
r AS (SELECT id, CASE WHEN s >= 0.95 THEN 'auto_merge' WHEN s >= 0.5 THEN 'ambiguous' ELSE 'new_entity' END AS decision,
  CASE WHEN s >= 0.5 THEN c END AS matched_entity_id, s AS confidence_score FROM b)
"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    found = resolve.name_match(p, p, ["tenant_id", "kind"]).union(resolve.cooccurrence(li).select("id", "candidate_id", "score"))
    return resolve.decide(p.select("id"), found)


@register(_DECIDE_SQL + "SELECT * FROM r")
def resolution_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@register(_DECIDE_SQL + "SELECT id AS src, matched_entity_id AS dst, 'SAME_AS' AS edge_type, confidence_score AS confidence FROM r WHERE decision = 'ambiguous'")
def same_as_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.same_as_edges(_decisions(spark, sf_dir))


@register(_DECIDE_SQL + "SELECT id, CASE WHEN decision = 'auto_merge' THEN matched_entity_id ELSE id END AS canonical_id FROM r")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.canonical_ids(_decisions(spark, sf_dir))


@register(_DECIDE_SQL + "SELECT decision, count(*) AS n FROM r GROUP BY 1")
def decision_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.counters(_decisions(spark, sf_dir), ["decision"])


@register()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", hashing.hash_embedding(F.col("p_name")).alias("embedding"))


# Graph ---------------------------------------------------------------------


@register("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk, min(ts) OVER (PARTITION BY user_id) AS created_at, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, event_type, round(value, 6) AS value, created_at, CASE WHEN n > 1 THEN ts END AS updated_at FROM r WHERE rk = 1""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    nodes = graph.upsert(e, ["user_id"], ["ts", "event_id"], stamp="ts")
    return nodes.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), "created_at", "updated_at")


@register("""
WITH e AS (SELECT o_custkey AS src, n_nationkey AS dst, max(o_orderkey) AS last_order FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
 JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT src, dst, 'LOCATED_AT' AS edge_type, last_order FROM e""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer")
    rows = load(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("src"), F.col("c_nationkey").alias("dst"), exprs.edge_type(F.lit("located-at")).alias("edge_type"), F.col("o_orderkey").alias("last_order"))
    merged = graph.upsert(rows, ["src", "dst", "edge_type"], ["last_order"])
    heads = cust.where("c_acctbal > 0").select(F.col("c_custkey").alias("_id"))
    ends = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_id"))
    return merged.join(heads, F.col("src") == F.col("_id"), "left_semi").join(ends, F.col("dst") == F.col("_id"), "left_semi").select("src", "dst", "edge_type", "last_order")


@register("SELECT p_type, upper(regexp_replace(p_type, '[^a-zA-Z0-9_]', '_', 'g')) AS edge_type FROM part GROUP BY 1")
def edge_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_type").distinct().withColumn("edge_type", exprs.edge_type(F.col("p_type")))


@register("""
WITH k AS (SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS kind FROM part UNION SELECT DISTINCT event_type FROM events)
SELECT kind, array_to_string(list_transform(string_split(kind, '-'), lambda t: upper(substr(t, 1, 1)) || lower(substr(t, 2))), '') AS label FROM k""")
def label_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = load(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("kind")).union(load(spark, sf_dir, "events").select("event_type")).distinct()
    return k.withColumn("label", exprs.pascal_label(F.col("kind")))


@register("""
WITH s AS (SELECT DISTINCT p_brand AS t FROM part UNION SELECT DISTINCT p_size || '-' || p_type FROM part), c AS (SELECT t, regexp_replace(t, '[^a-zA-Z0-9_]', '_', 'g') AS x FROM s)
SELECT t, CASE WHEN regexp_matches(x, '^[0-9]') THEN 'L_' || x ELSE x END AS label FROM c""")
def safe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    t = p.select(F.col("p_brand").alias("t")).union(p.select(F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_type")))).distinct()
    return t.withColumn("label", exprs.safe_label(F.col("t")))


@register("SELECT 'part--' || p_partkey AS entity_id, CAST(p_partkey AS VARCHAR) AS point_id FROM part UNION ALL SELECT p_name, p_name FROM part")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    ids = p.select(F.concat(F.lit("part--"), F.col("p_partkey").cast("string")).alias("entity_id")).union(p.select("p_name"))
    return ids.withColumn("point_id", exprs.point_id(F.col("entity_id")))


_UNIQUE = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}


@register(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) - count(DISTINCT {k}) AS violations FROM {t}" for t, k in _UNIQUE.items()))
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key in _UNIQUE.items():
        row = load(spark, sf_dir, name).agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("violations")).select(F.lit(name).alias("table_name"), "violations")
        out = row if out is None else out.union(row)
    return out


_LINK_SQL = """
WITH RECURSIVE e0 AS (SELECT DISTINCT l_partkey AS src, l_orderkey AS ord FROM lineitem),
l AS (SELECT a.src AS src, b.src AS dst FROM e0 a JOIN e0 b ON a.ord = b.ord AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 3),
n AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l)
"""
_COMP_SQL = _LINK_SQL + """
, reach(id, r) AS (SELECT src, src FROM n UNION SELECT n.dst, reach.r FROM reach JOIN n ON n.src = reach.id),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return resolve.cooccurrence(li, least=3).where("id < candidate_id").select(F.col("id").alias("src"), F.col("candidate_id").alias("dst"))


@register(_LINK_SQL + """
, o AS (SELECT DISTINCT src AS origin FROM n), h0 AS (SELECT origin, origin AS id FROM o),
h1 AS (SELECT * FROM h0 UNION SELECT origin, n.dst FROM h0 JOIN n ON n.src = h0.id),
h2 AS (SELECT * FROM h1 UNION SELECT origin, n.dst FROM h1 JOIN n ON n.src = h1.id) SELECT origin, id FROM h2""")
def khop_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    links = cut(links)
    return graph.khop(links, links.select(F.col("src").alias("id")).union(links.select("dst")))


@register(_LINK_SQL + "SELECT src, dst FROM l WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = load(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return graph.with_both_ends(_links(spark, sf_dir), small)


@register(_COMP_SQL + "SELECT id, component FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_links(spark, sf_dir))


@register(_COMP_SQL + "SELECT c.id, c.component FROM comp c WHERE component IN (SELECT component FROM comp WHERE id = (SELECT min(src) FROM l))")
def incremental_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(_links(spark, sf_dir))
    origin = links.agg(F.min("src").alias("id"))
    return graph.incremental_components(links, origin, hops=None)


@register(_LINK_SQL + "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM n)")
def component_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolated(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), _links(spark, sf_dir))


_MEMBERS_SQL = _COMP_SQL + ", m AS (SELECT component AS community_id, count(*) AS entity_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS entity_ids FROM comp GROUP BY 1)"


@register(_MEMBERS_SQL + "SELECT * FROM m")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.members(graph.components(_links(spark, sf_dir)))


@register(_MEMBERS_SQL + _le_sql("m", "entity_count", exprs.SIZE_BOUNDS))
def community_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.histogram(graph.members(graph.components(_links(spark, sf_dir))), "entity_count", exprs.SIZE_BOUNDS)


@register(_COMP_SQL + """
, w AS (SELECT component, string_agg(p_name || ' (' || p_type || ')', ', ' ORDER BY p_name || ' (' || p_type || ')') AS entities FROM comp JOIN part ON p_partkey = id GROUP BY 1),
q AS (SELECT a.component, s.p_name || ' --[RELATED_TO]--> ' || t.p_name AS r FROM l JOIN comp a ON a.id = l.src JOIN comp b ON b.id = l.dst JOIN part s ON s.p_partkey = l.src JOIN part t ON t.p_partkey = l.dst WHERE a.component = b.component),
x AS (SELECT component, string_agg(r, ', ' ORDER BY r) AS relations FROM q GROUP BY 1)
SELECT w.component AS community_id, entities, coalesce(relations, 'none') AS relations FROM w LEFT JOIN x USING (component)""")
def community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(_links(spark, sf_dir))
    edges = links.withColumn("edge_type", F.lit("RELATED_TO"))
    return graph.context(graph.components(links), _parts(spark, sf_dir).select("id", "name", "kind"), edges)


_SUMMARY_SQL = _MEMBERS_SQL + ", s AS (SELECT community_id, entity_count, 'Community ' || community_id || ' contains ' || entity_count || CASE WHEN entity_count = 1 THEN ' entity.' ELSE ' entities.' END AS summary FROM m)"


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    assigned = graph.components(_links(spark, sf_dir))
    return assigned, graph.template_summary(graph.members(assigned))


@register(_SUMMARY_SQL + "SELECT community_id, entity_count, summary, 'template' AS model_used FROM s")
def community_template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir)[1].select("community_id", "entity_count", "summary", "model_used")


@register(_SUMMARY_SQL + "SELECT p_partkey AS id, community_id, summary AS community_summary FROM part LEFT JOIN comp ON id = p_partkey LEFT JOIN s ON s.community_id = comp.component")
def community_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, told = _summaries(spark, sf_dir)
    return graph.annotate(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), assigned, told).select("id", "community_id", "community_summary")


@register(_SUMMARY_SQL + "SELECT community_id, summary AS community_summary, entity_count FROM s")
def community_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, told = _summaries(spark, sf_dir)
    nodes = graph.annotate(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), assigned, told)
    kept = nodes.where("community_summary is not null")
    return kept.groupBy("community_id", "community_summary").agg(F.count(F.lit(1)).alias("entity_count")).orderBy("community_id")


@register(_COMP_SQL + "SELECT a.component AS src_community, b.component AS dst_community, count(*) AS n_edges FROM l JOIN comp a ON a.id = l.src JOIN comp b ON b.id = l.dst GROUP BY 1, 2")
def community_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(_links(spark, sf_dir))
    return graph.quotient(links, graph.components(links))


@register(_SUMMARY_SQL + """
, b AS (SELECT p_brand AS tenant_id, community_id, summary, row_number() OVER (PARTITION BY p_brand ORDER BY community_id) AS i FROM s JOIN part ON p_partkey = community_id)
SELECT p.tenant_id, coalesce('Good morning. Here is your intelligence briefing.' || chr(10) || string_agg(chr(10) || 'Section ' || i || ' — Community ' || community_id || ':' || chr(10) || summary, chr(10) ORDER BY i), 'No intelligence data available at this time.') AS script
FROM (SELECT DISTINCT p_brand AS tenant_id FROM part) p LEFT JOIN b ON b.tenant_id = p.tenant_id AND i <= 5 GROUP BY 1""")
def briefing_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _parts(spark, sf_dir).select(F.col("id").alias("community_id"), "tenant_id")
    told = _summaries(spark, sf_dir)[1].join(brands, "community_id")
    return deliver.briefing_script(told.withColumnRenamed("summary", "community_summary"), tenants=brands)


@register(_SUMMARY_SQL + """
, b AS (SELECT p_brand AS tenant_id, community_id, summary, row_number() OVER (PARTITION BY p_brand ORDER BY community_id) AS i FROM s JOIN part ON p_partkey = community_id)
SELECT tenant_id, i AS place, CAST(community_id AS VARCHAR) AS community_id, summary AS community_summary FROM b WHERE i <= 10""")
def briefing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _parts(spark, sf_dir).select(F.col("id").alias("community_id"), "tenant_id")
    told = _summaries(spark, sf_dir)[1].join(brands, "community_id")
    return deliver.briefing_items(told.withColumnRenamed("summary", "community_summary"))


@register(_SUMMARY_SQL + """
, h AS (SELECT community_id, summary AS community_summary, len(list_intersect(string_split(lower(regexp_replace(summary, '[^0-9A-Za-z]+', ' ', 'g')), ' '), ['contains', '3', 'entities'])) AS hits FROM s)
SELECT community_id, community_summary, CAST(hits AS INT) AS hits FROM h WHERE hits > 0 ORDER BY hits DESC, community_id LIMIT 10""")
def summary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _summaries(spark, sf_dir)[1].select("community_id", F.col("summary").alias("community_summary"))
    return graph.search_summaries(told, "Contains 3 entities").select("community_id", "community_summary", F.col("hits").cast("int").alias("hits"))


@register("""
WITH o AS (SELECT event_type AS tenant_id, 'briefings/' || event_type || '/' || strftime(ts, '%Y-%m-%d') || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.mp3' AS object_key, CAST(ts AS DATE) AS day, ts FROM events)
SELECT tenant_id, max(object_key) AS object_key FROM o GROUP BY 1""")
def latest_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    key = deliver.object_key("briefings", F.col("event_type"), F.col("ts"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return deliver.latest_object(e.select(F.col("event_type").alias("tenant_id"), key.alias("object_key")))


@register(_LINK_SQL + "SELECT src, dst FROM l WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def graph_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    return graph.with_both_ends(_links(spark, sf_dir), shown)


@register()
def graph_view_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph_fixture(spark)
    return nodes.withColumn("shown_colour", exprs.colour(F.col("stix_type"), F.col("colour")))


# Extensions ------------------------------------------------------------------


@register("""
WITH w AS (SELECT p_partkey AS id, p_brand, p_type, list_distinct(string_split(p_name, ' ')) AS t FROM part)
SELECT a.id, b.id AS candidate_id, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS score
FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id AND len(list_intersect(a.t, b.t)) > 0""")
def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.word_overlap(_parts(spark, sf_dir), ["tenant_id", "kind"], words="aliases")
    return found.select("id", "candidate_id", F.round("score", 6).alias("score"))


@register()
def phonetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("block", F.array_join(F.transform("aliases", F.soundex), " "))
    return p.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT c_mktsegment AS tenant_id, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)""")
def federated_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup(F.col("c_mktsegment").alias("tenant_id"), "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("""
SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(c_acctbal / 120) / 2), 2)
  + cos(radians(c_acctbal / 120)) * cos(0.0) * pow(sin(radians((c_custkey % 360) - 180) / 2), 2)))), 3) AS km FROM customer""")
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    km = exprs.haversine_km(zero, zero, F.col("c_acctbal") / 120, (F.col("c_custkey") % 360 - 180).cast("double"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(km, 3).alias("km"))


# Entities and envelopes --------------------------------------------------------


_ENTITY_SQL = """
WITH e AS (
  SELECT 'threat-actor--' || lpad(CAST(c_custkey AS VARCHAR), 36, '0') AS id, c_mktsegment AS tenant_id, c_name AS name, [c_name, c_mktsegment] AS aliases, CAST(round(c_acctbal / 50) AS INT) AS confidence, 'threat-actor' AS stix_type, 0 AS list_no FROM customer
  UNION ALL SELECT 'identity--' || s_suppkey, 'default', s_name, NULL, NULL, 'identity', 2 FROM supplier
  UNION ALL SELECT 'location--' || lpad(CAST(n_nationkey AS VARCHAR), 36, '0'), 'default', CASE WHEN n_nationkey % 2 = 0 THEN n_name END, NULL, 50, 'location', 6 FROM nation)
"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ident(kind: str, key: str, width: int = 0) -> F.Column:
        text = F.col(key).cast("string")
        return F.concat(F.lit(f"{kind}--"), F.lpad(text, width, "0") if width else text).alias("id")

    c, s, n = (load(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return entities.all_entities({
        "location": n.select(ident("location", "n_nationkey", 36), F.lit("default").alias("tenant_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.lit(50).alias("confidence")),
        "threat-actor": c.select(ident("threat-actor", "c_custkey", 36), F.col("c_mktsegment").alias("tenant_id"), F.col("c_name").alias("name"), F.array("c_name", "c_mktsegment").alias("aliases"), F.round(F.col("c_acctbal") / 50).cast("int").alias("confidence")),
        "identity": s.select(ident("identity", "s_suppkey"), F.lit("default").alias("tenant_id"), F.col("s_name").alias("name")),
    })


@register(_ENTITY_SQL + "SELECT list_no, stix_type, count(*) AS n, count(name) AS named, count(confidence) AS rated FROM e GROUP BY 1, 2")
def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("list_no", "stix_type").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.count("confidence").alias("rated"))


@register(_ENTITY_SQL + """SELECT id, tenant_id, stix_type, name, CASE WHEN aliases IS NOT NULL THEN '["' || aliases[1] || '", "' || aliases[2] || '"]' END AS aliases, confidence FROM e""")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.flatten(_entities(spark, sf_dir)).select("id", "tenant_id", "stix_type", "name", "aliases", "confidence")


@register(_ENTITY_SQL + "SELECT id, coalesce(name, '') AS name, coalesce(len(aliases), 0) AS n_aliases, stix_type || ' ' || coalesce(name, '') AS blocking FROM e")
def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocking = entities.blocking_text(F.col("stix_type"), F.col("name"))
    return _entities(spark, sf_dir).select("id", entities.name_of(F.col("name")).alias("name"), F.size(entities.aliases_of(F.col("aliases"))).cast("long").alias("n_aliases"), blocking.alias("blocking"))


@register(_ENTITY_SQL + """SELECT id, concat_ws(',', CASE WHEN NOT regexp_matches(id, '^[a-z-]+--[0-9a-f-]{36}$') THEN 'id' END, CASE WHEN confidence < 0 OR confidence > 100 THEN 'confidence' END) AS violations FROM e""")
def entity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.violations(_entities(spark, sf_dir)).select("id", F.concat_ws(",", "violations").alias("violations"))


@register(_ENTITY_SQL + """SELECT tenant_id, 'bundle--' || tenant_id AS bundle_id, '{"id":"' || id || '","type":"' || stix_type || '","spec_version":"2.1"' || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || '}' AS object FROM e""")
def stix_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir).select("tenant_id", "id", F.col("stix_type").alias("type"), F.lit("2.1").alias("spec_version"), "name")
    return entities.bundle(e, ["tenant_id"], F.concat(F.lit("bundle--"), "tenant_id"))


@register("""
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source, 'default' AS tenant_id, 'unknown' AS plugin_version, 'sensor' AS plugin_name, user_id AS ingest_latency_ms, '1.0' AS schema_version, ts AS timestamp FROM events""")
def envelope_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    out = ingest.envelope(e, F.col("props"), F.col("event_type"), F.lit(None).cast("string"), F.col("event_id").cast("string"), F.lit(""), F.lit("sensor"), F.col("ts"), F.col("user_id"))
    return out.select("id", "source", "tenant_id", "plugin_version", "plugin_name", "ingest_latency_ms", "schema_version", "timestamp")


_KEYS_SQL = """
WITH k AS (SELECT event_id, event_id % 5 AS c FROM events)
SELECT event_id, CASE c WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE NULL END AS id,
  CASE c WHEN 1 THEN 't' WHEN 4 THEN NULL ELSE 'default' END AS tenant_id,
  CASE c WHEN 2 THEN 'id must be a string' WHEN 3 THEN 'payload must be an object' WHEN 4 THEN 'envelope must be an object' END AS type_error FROM k"""


@register(_KEYS_SQL)
def envelope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id") % 5
    value = F.when(c == 0, '{"id": "a", "payload": {"text": "x"}}').when(c == 1, '{"tenant_id": "t"}').when(c == 2, '{"id": null}').when(c == 3, '{"payload": 7}').otherwise("[1]")
    rows = load(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return ingest.defaulted(rows).select("event_id", F.when(c < 4, F.col("id")).alias("id"), F.when(c < 4, F.col("tenant_id")).alias("tenant_id"), "type_error")


@register("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'hello' WHEN 1 THEN 'c' WHEN 2 THEN 'c' WHEN 3 THEN '' WHEN 4 THEN '3.5' ELSE 'True' END AS text FROM events""")
def text_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id") % 6
    value = F.when(c == 0, '{"text": "hello", "content": "c"}').when(c == 1, '{"text": 0, "content": "c"}').when(c == 2, '{"text": [], "content": "c"}').when(c == 3, '{"text": false}').when(c == 4, '{"text": 3.5}').otherwise('{"content": true}')
    return load(spark, sf_dir, "events").select("event_id", exprs.truthy_text(value, "text", "content").alias("text"))


@register("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text <> ''")
def usable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "user", "text").otherwise("image"))
    return ingest.usable_blocks(c).select("conv_id", "turn", "text")


# Alerts, topics, plugins ---------------------------------------------------------


@register(_CONF_SQL + """
SELECT sha256('t' || user_id % 7 || ':' || user_id || '-' || strftime(day, '%Y-%m-%d')) AS alert_id, 't' || user_id % 7 AS tenant_id, n_entities AS n_ids, CAST(user_id % 9 AS VARCHAR) AS community_id,
  n_entities || CASE WHEN n_entities = 1 THEN ' entity' ELSE ' entities' END || ' extracted' AS summary, round(confidence, 6) AS confidence, day AS timestamp, user_id || '-' || strftime(day, '%Y-%m-%d') AS source_event_id
FROM c WHERE confidence > 0.5::DOUBLE""")
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    rows = _confidence(spark, sf_dir).select(
        F.concat(user.cast("string"), F.lit("-"), F.date_format("day", "yyyy-MM-dd")).alias("event_id"), F.concat(F.lit("t"), user % 7).alias("tenant_id"),
        F.sequence(F.lit(1), F.col("n_entities")).alias("entity_ids"), (user % 9).cast("string").alias("community_id"), "confidence", "day",
    )
    out = deliver.alert_records(rows, F.col("day"))
    return out.select("alert_id", "tenant_id", F.size("entity_ids").cast("long").alias("n_ids"), "community_id", "summary", F.round("confidence", 6).alias("confidence"), "timestamp", "source_event_id")


@register("SELECT doc_id, left(text, 500) AS summary FROM documents")
def truncated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", deliver.truncated(F.col("text")).alias("summary"))


@register("""SELECT user_id, event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2""")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.gauges(load(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"]).withColumn("value", F.round("value", 6))


@register("""
SELECT CAST(event_id AS VARCHAR) AS key, '{"id":"' || event_id || '","source":"' || event_type || '","user":' || user_id || '}' AS value, event_type AS header_source FROM events""")
def raw_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source"), F.col("user_id").alias("user"))
    return topics.raw_event_records(e).select("key", "value", F.get("headers", F.lit(0))["value"].cast("string").alias("header_source"))


@register("""SELECT 'echo' AS plugin, 'echo' AS tool, '1.0.0' AS version, CAST(i AS INT) AS seq, 'text' AS type, '{"text": "hi", "n": ' || i || '}' AS text FROM generate_series(0, 4) t(i)""")
def plugin_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_plugin(spark, "weft.sources.plugins:Echo", message="hi", times="5")


@register("""SELECT * FROM (VALUES ('http://b', 'echo', 'echo', '1.0.0'), ('http://a', 'echo', 'echo', '1.0.0'), ('manual', 'own', 'fetch', '')) t(url, plugin, tool, version)""")
def tool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("http://a", "old", "gone", "0"), ("http://b", "echo", "echo", "1.0.0")], "url string, plugin string, tool string, version string")
    return replace_tools(old, registry(spark, {"http://a": Echo()}, [("own", "fetch")]))


@register(_TTL_SQL + "SELECT user_id, event_type, event_id, ts, is_new FROM f")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream run to its end and read back."""
    schema = load(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = deduplicate(rows.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id", 86_400)
    folder = f"{checkpoint_root(spark)}/stream-dedup-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


# Tenants ---------------------------------------------------------------------------


_TENANT_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT o_orderpriority AS tenant_id, o_custkey AS src, o_orderkey AS dst FROM orders),
n AS (SELECT tenant_id, src, dst FROM l UNION SELECT tenant_id, dst, src FROM l)
"""


def _tenant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


@register(_TENANT_SQL + """
, reach(tenant_id, id, r) AS (SELECT tenant_id, src, src FROM n UNION SELECT n.tenant_id, n.dst, reach.r FROM reach JOIN n ON n.tenant_id = reach.tenant_id AND n.src = reach.id)
SELECT tenant_id, id, min(r) AS component FROM reach GROUP BY 1, 2""")
def tenant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_tenant_links(spark, sf_dir), by=("tenant_id",))


@register(_TENANT_SQL + """
, h0 AS (SELECT DISTINCT tenant_id, src AS origin, src AS id FROM l),
h1 AS (SELECT * FROM h0 UNION SELECT h0.tenant_id, origin, n.dst FROM h0 JOIN n ON n.tenant_id = h0.tenant_id AND n.src = h0.id),
h2 AS (SELECT * FROM h1 UNION SELECT h1.tenant_id, origin, n.dst FROM h1 JOIN n ON n.tenant_id = h1.tenant_id AND n.src = h1.id) SELECT tenant_id, origin, id FROM h2""")
def tenant_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _tenant_links(spark, sf_dir)
    return graph.khop(links, links.select("tenant_id", F.col("src").alias("id")), by=("tenant_id",))


@register(_TENANT_SQL + """
, b AS (SELECT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 100000 UNION SELECT o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 100000)
SELECT tenant_id, src, dst FROM l WHERE (tenant_id, src) IN (SELECT * FROM b) AND (tenant_id, dst) IN (SELECT * FROM b)""")
def tenant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = load(spark, sf_dir, "orders").where("o_totalprice > 100000")
    nodes = big.select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_custkey").alias("id")).union(big.select("o_orderpriority", "o_orderkey"))
    return graph.with_both_ends(_tenant_links(spark, sf_dir).distinct(), nodes, by=("tenant_id",))


@register(_COMP_SQL + """
SELECT id, component, 'components' AS algorithm FROM comp UNION ALL SELECT p_partkey, p_partkey, 'components' FROM part WHERE p_partkey NOT IN (SELECT id FROM comp)""")
def communities_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An algorithm that is not there falls back to components; isolated nodes are asked for."""
    nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return graph.detect(cut(_links(spark, sf_dir)), nodes, "leiden", include_isolated=True)


_MERGE_SQL = """
WITH old AS (SELECT p_brand AS tenant_id, 'part--' || p_partkey AS id, p_type, p_name, p_partkey AS seq, p_size FROM part WHERE p_partkey % 2 = 0),
inc AS (SELECT p_brand AS tenant_id, 'part--' || p_partkey AS id, p_type, p_name, p_partkey AS seq, p_size FROM part WHERE p_partkey % 2 = 1),
m AS (SELECT inc.*, (SELECT min(old.id) FROM old WHERE old.tenant_id = inc.tenant_id AND old.p_type = inc.p_type AND old.p_name = inc.p_name) AS hit FROM inc),
r AS (SELECT tenant_id, id, p_type, p_name, seq, p_size, 0 AS took FROM old UNION ALL SELECT tenant_id, coalesce(hit, id), p_type, p_name, seq, p_size, CAST(hit IS NOT NULL AS INT) FROM m)
"""


@register(_MERGE_SQL + "SELECT tenant_id, id, arg_max(p_name, seq) AS name, max(seq) AS seq, arg_max(p_size, seq) AS size, CAST(sum(took) AS BIGINT) AS merged FROM r GROUP BY 1, 2")
def resolved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("tenant_id"), F.concat(F.lit("part--"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("size"))
    old, new = p.where("seq % 2 = 0"), p.where("seq % 2 = 1")
    found = resolve.name_match(new, old, ["tenant_id", "kind"]).join(new.select("tenant_id", "id"), "id")
    decided = resolve.decide(new.select("tenant_id", "id"), found, by=("tenant_id",))
    return resolve.resolved_nodes(old, new, decided).select("tenant_id", "id", "name", "seq", "size", "merged")


@register("""
SELECT 'default' AS tenant_id, CAST(vec_id % 50 AS VARCHAR) AS point_id, round(list_sum(CAST(arg_max(embedding, vec_id) AS DOUBLE[])), 3) AS total FROM embeddings GROUP BY 1, 2""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "embeddings").select(F.lit("default").alias("tenant_id"), F.concat(F.lit("vec--"), (F.col("vec_id") % 50).cast("string")).alias("id"), F.col("vec_id").alias("seq"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return resolve.vector_upsert(points).select("tenant_id", "point_id", F.round(total, 3).alias("total"))
