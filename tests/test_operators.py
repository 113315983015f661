"""Table-driven cases of the declared semantics."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions import exprs, hashing
from weft.operators import deliver, extract, graph, ingest, resolve
from weft.operators.components import connected_components
from weft.plans import catalogue
from weft.sources.fixture import graph_fixture
from weft.sources.tables import settings_list
from weft.streaming.dedup import stream_dedup
from weft.sources import plugins
from weft.sources.tables import list_objects
from weft.streaming import topics
from weft.streaming.process import current_version, persist_stream, publish_snapshot, read_snapshot, split_stream


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("scores", "decision", "match", "best"),
    [
        ([(9, 0.97)], "auto_merge", 9, 0.97),
        ([(9, 0.95)], "auto_merge", 9, 0.95),
        ([(9, 0.75)], "ambiguous", 9, 0.75),
        ([(9, 0.50)], "ambiguous", 9, 0.50),
        ([], "new_entity", None, 0.0),
        ([(9, 0.30)], "new_entity", None, 0.30),
        ([(9, 0.80), (9, 0.96), (9, 0.70)], "auto_merge", 9, 0.96),
        ([(8, 0.60), (9, 0.97)], "auto_merge", 9, 0.97),
        ([(8, 0.97), (9, 0.97)], "auto_merge", 8, 0.97),
    ],
)
def test_decision_tiers(spark, scores, decision, match, best):
    found = spark.createDataFrame([(1, c, s) for c, s in scores], "id long, candidate_id long, score double")
    row = resolve.decide(spark.createDataFrame([(1,)], "id long"), found).first()
    assert (row["decision"], row["matched_entity_id"], row["confidence_score"]) == (decision, match, best)


@pytest.mark.parametrize(
    ("payload", "fields"),
    [({}, ["payload"]), ({"ip": "1.2.3.4"}, ["payload"]), ({"text": None}, ["payload.text"]), ({"text": ""}, ["payload.text"]), ({"url": "x"}, []), ({"a": "", "b": None}, ["payload.a", "payload.b", "payload"])],
)
def test_payload_errors(spark, payload, fields):
    rows = spark.createDataFrame([(payload,)], "payload map<string,string>")
    out = ingest.validate(rows).first()
    assert [e["field"] for e in out["errors"]] == fields
    assert out["valid"] == (not fields)


def test_payload_errors_come_in_the_payload_s_order(spark):
    rows = spark.createDataFrame([('{"z": "", "a": null}',)], "raw string").select(F.from_json("raw", "map<string,string>").alias("payload"))
    assert [e["field"] for e in ingest.validate(rows).first()["errors"]] == ["payload.z", "payload.a", "payload"]


@pytest.mark.parametrize(("url", "ok"), [("http://shodan.io", True), ("https://a/b", True), ("shodan", False), ("   ", False), ("ftp://a", False), ("http:///p", False), (None, False)])
def test_http_url(spark, url, ok):
    got = spark.createDataFrame([(url,)], "u string").select(exprs.http_url(F.col("u")).alias("x")).first()["x"]
    assert got is ok


def test_labels(spark):
    assert _one(spark, exprs.pascal_label(F.col("k")), k="threat-actor") == "ThreatActor"
    assert _one(spark, exprs.edge_type(F.col("k")), k="attributed-to") == "ATTRIBUTED_TO"
    assert _one(spark, exprs.safe_label(F.col("k")), k="1-x") == "L_1_x"
    assert _one(spark, exprs.point_id(F.col("k")), k="malware--a--b") == "a--b"
    assert _one(spark, exprs.pick_text(F.col("a"), F.col("b")), a="", b="y") == "y"


def test_hashes(spark):
    want = hashlib.sha256(b'{"a": 1, "b": 2}').hexdigest()
    rows = spark.createDataFrame([('{"b":2,"a":1}',), ('{"a":1,"b":2}',)], "p string")
    assert {r[0] for r in rows.select(hashing.exact_content_hash(F.col("p"))).collect()} == {want}
    assert rows.select(hashing.content_key(F.col("p"))).distinct().count() == 1
    seed = hashlib.sha256(b"malware Emotet").digest()
    block = hashlib.sha256(seed + (1).to_bytes(4, "big")).digest()
    got = _one(spark, hashing.hash_embedding(F.col("t")), t="malware Emotet")
    assert len(got) == 768
    assert got[32] == pytest.approx((block[0] - 127.5) / 127.5)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (999, 999)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([*edges, (1, None)], "src long, dst long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_upsert_keeps_annotations_and_drops_nulled_properties(spark):
    rows = spark.createDataFrame([("a", 1, "x", "c1"), ("a", 2, None, None)], "id string, seq int, name string, community string")
    row = graph.upsert(rows, ["id"], ["seq"], ("community",)).first()
    assert (row["name"], row["community"], row["seq"]) == (None, "c1", 2)


def test_summary_and_briefing(spark):
    sizes = spark.createDataFrame([("t", 3, 1), ("t", 4, 2)], "tenant_id string, community_id long, entity_count long")
    told = graph.template_summary(sizes).withColumnRenamed("summary", "community_summary")
    script = deliver.briefing_script(told).first()["script"]
    assert script.startswith(deliver.GREETING + "\n\nSection 1 — Community 3:\nCommunity 3 contains 1 entity.")
    assert "Community 4 contains 2 entities." in script


def test_extraction_isolates_failures(spark):
    def broken(text):
        raise RuntimeError(text)

    rows = spark.createDataFrame([(1, "APT28 used CVE-2021-44228 from 1.2.3.4"), (2, None)], "id long, text string")
    got = extract.extract(rows, "id", "text", primary=broken).collect()
    assert sorted(r["name"] for r in got) == ["1.2.3.4", "APT28", "CVE-2021-44228"]


def test_fixture_and_settings(spark):
    nodes, edges = graph_fixture(spark)
    assert (nodes.count(), edges.count()) == (20, 15)
    assert settings_list("a, ,b,") == ["a", "b"]
    assert [exprs.backoff_seconds(i) for i in range(5)] == [0.5, 1, 2, 4, 8]


def test_stream_dedup_equals_batch(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    rows = [("k", i, (start + pd.Timedelta(minutes=m)).to_pydatetime()) for i, m in enumerate((0, 8, 16, 27, 36))]
    spark.createDataFrame(rows, "key string, n long, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, n long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    out = stream_dedup(stream, ["key"], "ts", "n", 600)
    query = out.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    query.awaitTermination(60)
    got = {r["n"]: r["is_new"] for r in spark.table("fresh").collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_stream_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"text": "a"}), (2, {"ip": "b"})], "id long, payload map<string,string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    split_stream(stream, good, bad, str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(good).collect()] == [1]
    assert [r["error_type"] for r in spark.read.parquet(bad).collect()] == ["SchemaViolation"]


def test_incremental_components_without_hops_follow_a_long_chain(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 51)], "src long, dst long")
    monkeypatch.setattr(catalogue, "_links", lambda *_: links)
    got = {tuple(r) for r in catalogue.queries()["incremental_components"](spark, "").collect()}
    assert got == {(i, 1) for i in range(1, 13)}


def test_stream_dedup_over_two_batches_and_a_slow_replay(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    parts = [[("k", 0, 0), ("k", 1, 8)], [("k", 2, 16), ("k", 3, 27), ("j", 4, 500)], [("k", 5, 700)]]
    schema = "key string, n long, ts timestamp_ntz"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in parts:
        rows = [(k, n, (start + pd.Timedelta(minutes=m)).to_pydatetime()) for k, n, m in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stream_dedup(stream, ["key"], "ts", "n", 600)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    got = {r["n"]: r["is_new"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True}


def test_a_failed_snapshot_leaves_the_one_before(spark, tmp_path):
    root = str(tmp_path)
    assert current_version(spark, root) is None
    one, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    publish_snapshot(spark, root, "000000000001", {"nodes": one, "edges": one})
    with pytest.raises(Exception, match="broken"):
        publish_snapshot(spark, root, "000000000002", {"nodes": spark.range(9), "edges": bad})
    assert current_version(spark, root) == "000000000001"
    assert read_snapshot(spark, root, "nodes").count() == 3
    publish_snapshot(spark, root, "000000000002", {"nodes": spark.range(9), "edges": one})
    assert read_snapshot(spark, root, "nodes").count() == 9


def test_persist_stream(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    tables = lambda batch: {"nodes": batch, "edges": batch.where("id > 1")}
    persist_stream(stream, str(tmp_path / "root"), str(tmp_path / "cp"), tables).awaitTermination(60)
    assert (read_snapshot(spark, str(tmp_path / "root"), "nodes").count(), read_snapshot(spark, str(tmp_path / "root"), "edges").count()) == (4, 2)


def test_failing_extraction_sets_a_batch_aside(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"text": "a"}), (2, {"ip": "b"})], "id long, payload map<string,string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def broken(batch):
        raise ValueError("no extractor")

    split_stream(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), extract=broken).awaitTermination()
    got = {r["id"]: r["error_type"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert got == {1: "ValueError", 2: "SchemaViolation"}


class Flaky(plugins.Plugin):
    name, tries = "flaky", 0

    def tools(self):
        return ["t"]

    def call(self, tool, options):
        self.tries += 1
        if self.tries < 3:
            raise OSError("not yet")
        return iter([("text", "x")])


def test_plugin_calls_are_repeated():
    flaky = Flaky()
    assert plugins.call_with_retry(flaky, "t", {}, scale=0.0) == [("text", "x")]
    assert flaky.tries == 3
    with pytest.raises(OSError, match="not yet"):
        plugins.call_with_retry(Flaky(), "t", {}, scale=0.0, attempts=2)


def test_topics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "src", "hi")], "id string, source string, text string")
    record = topics.raw_event_records(rows).first()
    assert (record["key"], record["headers"][0]["key"], bytes(record["headers"][0]["value"])) == ("e1", "source", b"src")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(record["value"] + "\nnot json\n")
    feed = topics.feed(spark, {"path": str(tmp_path / "in")}, "id string, text string")
    query = feed.writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["id"] or "", r["text"] or "") for r in spark.table("fed").collect()) == [("", ""), ("e1", "hi")]


def test_objects_are_listed_in_order(spark, tmp_path):
    for name in ("b.mp3", "a.mp3", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in list_objects(spark, str(tmp_path), "*.mp3").collect()] == ["a.mp3", "b.mp3"]


def test_khop_joins_once_a_hop(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)], "src long, dst long")
    out = graph.khop(links, spark.createDataFrame([(1,)], "id long"), hops=6)
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 8))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3


def test_tenants_never_mix(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "tenant_id string, src long, dst long")
    got = graph.components(edges, by=("tenant_id",)).collect()
    assert {(r["tenant_id"], r["id"], r["component"]) for r in got} == {("a", 1, 1), ("a", 2, 1), ("b", 2, 2), ("b", 3, 2)}
    near = graph.khop(edges, spark.createDataFrame([("a", 1)], "tenant_id string, id long"), by=("tenant_id",)).collect()
    assert {r["id"] for r in near} == {1, 2}
    nodes = spark.createDataFrame([("a", 1), ("a", 9)], "tenant_id string, id long")
    alone = graph.detect(edges.limit(0), nodes, "louvain", ("tenant_id",)).collect()
    assert {(r["id"], r["component"], r["algorithm"]) for r in alone} == {(1, 1, "components"), (9, 9, "components")}


def test_label_propagation_finds_two_cliques(spark):
    pairs = [(i, j) for base in (0, 10) for i in range(base, base + 5) for j in range(i + 1, base + 5)] + [(4, 10)]
    got = {r["id"]: r["component"] for r in graph.detect(spark.createDataFrame(pairs, "src long, dst long"), spark.range(20), "label_propagation").collect()}
    assert {got[i] for i in range(5)} == {0}
    assert {got[i] for i in range(10, 15)} == {10}


def test_string_ids_and_merges(spark):
    found = spark.createDataFrame([("t", "x", "part--2", 0.97), ("t", "x", "part--1", 0.97)], "tenant_id string, id string, candidate_id string, score double")
    decided = resolve.decide(spark.createDataFrame([("t", "x"), ("t", "y")], "tenant_id string, id string"), found, by=("tenant_id",))
    got = {r["id"]: (r["decision"], r["matched_entity_id"]) for r in decided.collect()}
    assert got == {"x": ("auto_merge", "part--1"), "y": ("new_entity", None)}
    kind = "tenant_id string, id string, seq int, name string"
    old, new = spark.createDataFrame([("t", "part--1", 1, "old"), ("u", "x", 1, "other")], kind), spark.createDataFrame([("t", "x", 2, "new"), ("t", "y", 2, "why")], kind)
    out = {(r["tenant_id"], r["id"]): (r["name"], r["merged"]) for r in resolve.resolved_nodes(old, new, decided).collect()}
    assert out == {("t", "part--1"): ("new", 1), ("u", "x"): ("other", 0), ("t", "y"): ("why", 0)}


def test_soundex_and_empty_briefing(spark):
    assert _one(spark, F.soundex(F.col("k")), k="Robert") == "R163"
    told = spark.createDataFrame([("a", None, "one")], "tenant_id string, community_id long, community_summary string")
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    got = {r["tenant_id"]: r["script"] for r in deliver.briefing_script(told, tenants=tenants).collect()}
    assert got["b"] == deliver.NOTHING
    assert "Section 1 — Community 1:" in got["a"]


def test_observed_counts(spark):
    rows, told = deliver.observed(spark.range(7))
    rows.collect()
    assert told.get["rows"] == 7


def test_histogram_without_rows_counts_zero(spark):
    none = spark.createDataFrame([], "k string, v long")
    assert [tuple(r) for r in deliver.histogram(none, "v", (1, 2)).collect()] == [("1.0", 0), ("2.0", 0), ("+Inf", 0)]
    assert deliver.histogram(none, "v", (1, 2), ["k"]).count() == 0
    some = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert [tuple(r) for r in deliver.histogram(some, "v", (1, 2)).collect()] == [("1.0", 1), ("2.0", 2), ("+Inf", 3)]


def test_alias_match_makes_each_pair_once(spark):
    rows = [("t", 1, ["a", "b"]), ("t", 2, ["b", "a"]), ("t", 2, ["b", "a"]), ("t", 3, ["b", None]), ("t", 4, None), ("u", 1, ["a"]), ("u", 2, ["a", "c"]), ("u", 5, ["c"]), (None, 6, ["a"]), ("t", None, ["a"])]
    p = spark.createDataFrame(rows, "tenant string, id long, aliases array<string>")
    named = p.withColumn("name", F.explode("aliases"))
    wanted = {(i, j) for s, i, x in rows for t, j, y in rows if s == t and s and i and j and i != j and {*(x or [])} & {*(y or [])} - {None}}
    got = resolve.alias_match(named, p, ["tenant"]).collect()
    assert sorted((r["id"], r["candidate_id"]) for r in got) == sorted(wanted)
    plan = catalogue.queries()["alias_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "candidate_id" in x]  # pairs are not gathered to drop repeats


def test_word_overlap_meets_in_blocks_and_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(resolve, "_LIST", 2)
    words = [["x"], ["x", "y"], ["y", "z"], ["x"], ["z", "z"], [], None, ["x", None]]
    rows = [("t", i, w) for i, w in enumerate(words * 3)]
    got = resolve.word_overlap(spark.createDataFrame(rows, "tenant string, id long, words array<string>"), ["tenant"]).collect()
    sets = [{*(w or [])} - {None} for _, _, w in rows]
    wanted = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a & b}
    assert len(got) == len(wanted) and {(r["id"], r["candidate_id"]): r["score"] for r in got} == wanted
    plan = catalogue.queries()["name_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_vector_topk_by_cells_as_pair_by_pair(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 8)).astype(np.float32)
    rows = [("t" if i % 3 else "u", i, (base[i % 40] if i % 41 else np.zeros(8)).tolist()) for i in range(200)]  # copies tie, some are zero
    rows.append(("t", 999, [float("nan")] * 8))
    e = spark.createDataFrame(rows, "tenant_id string, id long, embedding array<float>")
    got = {}
    for r in resolve.vector_topk(e, e, k=4, block=5).where("id <> 999").collect():
        got.setdefault(r["id"], []).append((-r["score"], r["candidate_id"]))
    vs = {i: (t, np.array(v, np.float64)) for t, i, v in rows if i != 999}
    for i, (t, v) in vs.items():
        told = []
        for j, (u, w) in vs.items():
            if t == u:
                size = (np.linalg.norm(v) or 1) * (np.linalg.norm(w) or 1)
                told.append((-round(float(v @ w / size), 6), j))
        told = sorted(told)[:4]
        assert sorted(got[i]) == [x for x in told if x[1] != i], i


def test_vector_blocks_grow_so_that_cells_stay_few(spark):
    sizes = spark.createDataFrame([(1,), (4096,), (40_000,), (600_000,), (6_000_000,)], "n long")
    assert [r[0] for r in sizes.select(resolve._blocks(F.col("n"), 4096)).collect()] == [1, 1, 8, 10, 92]
    q = pd.DataFrame({"t": "a", "id": range(300), "v": [[1.0, i / 300] for i in range(300)], "side": 0})
    found = resolve._block_topk(3, pd.concat([q, q.assign(side=1)]), strip=64, width=32)
    assert (found.groupby("id").size() == 3).all() and (found.groupby("id")["score"].max() == 1.0).all()
