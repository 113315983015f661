"""Entity resolution: candidate generators, decisions, merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import exprs
from weft.session import stash

#: About how many ids a list holds.
_LIST = 256


def _pack(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("float"))


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def _block_topk(k: int, pdf: pd.DataFrame, strip: int = 256, width: int = 4096) -> pd.DataFrame:
    """The best ``k`` candidates of each query row of a cell, by matrix products of bounded size.

    Products in single precision, whose error has a bound, leave out what cannot be among
    a row's best ``k`` so far; only the rest are scored in double precision, rounded and ranked.
    """
    q, c = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if q.empty or c.empty:
        return pd.DataFrame({"t": [], "id": [], "candidate_id": [], "score": []})
    c = c.sort_values("id", kind="stable")  # ties go to the least id, so to the least place
    ids, names = q["id"].to_numpy(), c["id"].to_numpy()
    left, right = _unit(q["v"]), _unit(c["v"])
    few, many = left.astype(np.float32), right.astype(np.float32)
    slack = 1e-6 + (left.shape[1] + 8) * 1.2e-7  # of such a product of unit vectors, and of rounding to six digits
    odd = not (np.isfinite(few).all() and np.isfinite(many).all())
    found = []
    for at in range(0, len(q), strip):
        mine = few[at : at + strip]
        floor = np.full(len(mine), -np.inf, np.float32)  # of what can still be among the best
        rows, cols = np.empty(0, np.int64), np.empty(0, np.int64)
        scores = np.empty(0)
        for start in range(0, len(c), width):
            near = mine @ many[start : start + width].T
            if odd:
                near[np.isnan(near)] = -np.inf  # ranked last
            if start == 0 and near.shape[1] > k:
                floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - np.float32(2 * slack)
            flat = np.flatnonzero(near >= floor[:, None])
            if not len(flat):
                continue
            r, at_c = np.divmod(flat, near.shape[1])
            at_c += start
            exact = np.round(np.einsum("ij,ij->i", left[at + r], right[at_c]), 6)
            rows, cols, scores = np.concatenate((rows, r)), np.concatenate((cols, at_c)), np.concatenate((scores, exact))
            order = np.lexsort((cols, -scores, rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            first = np.searchsorted(rows, rows)
            best = np.arange(len(rows)) - first < k
            rows, cols, scores = rows[best], cols[best], scores[best]
            last = np.flatnonzero(np.bincount(rows, minlength=len(mine)) == k)
            floor[last] = np.nan_to_num(scores[np.searchsorted(rows, last, "right") - 1] - slack, nan=-np.inf)
        found.append(pd.DataFrame({"id": ids[at + rows], "candidate_id": names[cols], "score": scores}))
    out = pd.concat(found)
    out.insert(0, "t", q["t"].iloc[0])
    return out


def _blocks(rows: Column, block: int) -> Column:
    """Blocks that ``rows`` are dealt into: of at least ``block`` rows, eight if they can be, of at most ``16 * block``."""
    return F.ceil(rows / F.least(F.greatest(rows / 8, F.lit(block)), F.lit(16 * block))).cast("int")


def vector_topk(queries: DataFrame, index: DataFrame, k: int = 5, key: str = "id", vector: str = "embedding", tenant: str = "tenant_id", block: int = 4096) -> DataFrame:
    """``(tenant, id, candidate_id, score)``: the ``k`` most alike of the tenant, then without the row itself.

    Exact. A tenant's queries and its index are dealt into blocks of ``block`` to
    ``16 * block`` rows by hash, eight of them while that is enough; each pair of blocks
    is one task's cell, which gives out ``k`` rows a query, so no tenant meets itself in one task.
    """
    def dealt(rows: DataFrame, side: int) -> DataFrame:
        slim = rows.select(F.col(tenant).alias("t"), F.col(key).alias("id"), _pack(F.col(vector)).alias("v"))
        parts = slim.groupBy("t").agg(F.count(F.lit(1)).alias("rows"))
        parts = parts.select("t", _blocks(F.col("rows"), block).alias("parts"))
        own = slim.join(parts, "t").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        return own.select("t", "id", "v", F.lit(side).alias("side"), "mine", "parts")

    a, b = dealt(queries, 0), dealt(index, 1)
    sizes_a, sizes_b = (x.groupBy("t").agg(F.max("parts").alias("others")) for x in (a, b))
    a = a.join(sizes_b, "t").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    b = b.join(sizes_a, "t").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    cells = a.select("t", "id", "v", "side", F.col("mine").alias("i"), F.col("theirs").alias("j")).union(
        b.select("t", "id", "v", "side", F.col("theirs").alias("i"), F.col("mine").alias("j"))
    )
    kind = queries.schema[key].dataType.simpleString()
    near = cells.groupBy("t", "i", "j").applyInPandas(
        lambda pdf: _block_topk(k, pdf[["t", "id", "v", "side"]]), f"t {queries.schema[tenant].dataType.simpleString()}, id {kind}, candidate_id {kind}, score double"
    )
    best = W.partitionBy("t", "id").orderBy(F.col("score").desc(), "candidate_id")
    top = near.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k} and id <> candidate_id")
    return top.select(F.col("t").alias(tenant), "id", "candidate_id", "score")


def name_match(incoming: DataFrame, existing: DataFrame, by: list[str], key: str = "id", name: str = "name") -> DataFrame:
    """Equal names under equal ``by`` columns; score 1."""
    a = incoming.select(*by, F.col(name).alias("_n"), F.col(key).alias("id")).where("_n is not null and _n <> ''")
    b = existing.select(*by, F.col(name).alias("_n"), F.col(key).alias("candidate_id"))
    return a.join(b, [*by, "_n"]).where("id <> candidate_id").select("id", "candidate_id", F.lit(1.0).alias("score"))


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows without nulls in ``columns``: a null equals nothing."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _classes(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(by, cid, words)`` of each distinct set of words of ``rows (by, id, words)``, and ``(cid, ids)``, its ids in lists.

    ``words`` are sorted sets without nulls. Rows without a word or a ``by`` meet no other row and are left out.
    Lists hold at most about ``_LIST`` ids, so a class of very many rows is many rows here.
    """
    some = _named(rows, *by).where(F.size("words") > 0)
    sizes = some.groupBy(*by, "words").agg(F.count(F.lit(1)).alias("many"))
    classes = stash(sizes.withColumn("cid", F.monotonically_increasing_id()), "word-classes")  # written, so that numbers stay
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / _LIST))
    held = some.hint("merge").join(classes, [*by, "words"]).groupBy("cid", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    return classes.select(*by, "cid", "words"), stash(held.select("cid", "ids"), "word-lists")


def _class_pairs(left: DataFrame, right: DataFrame, by: list[str], block: int = 256) -> DataFrame:
    """``(a, b, shared, n, m)``: classes of ``left`` and ``right`` with a common word under equal ``by``.

    Each pair comes out once, at the least word that both have, so nothing has to be
    gathered afterwards. A word of many classes is dealt into blocks, every two of which meet apart.
    """
    x, y = (c.select(*by, "cid", "words", F.explode("words").alias("d")) for c in (left, right))
    parts = x.union(y).groupBy(*by, "d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    deal = lambda e: e.hint("merge").join(parts, [*by, "d"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = deal(x).select(*by, "d", F.col("cid").alias("a"), F.col("words").alias("wa"), F.col("mine").alias("i"), other.alias("j"))
    b = deal(y).select(*by, "d", F.col("cid").alias("b"), F.col("words").alias("wb"), F.col("mine").alias("j"), other.alias("i"))
    both = F.array_intersect("wa", "wb")
    met = a.hint("merge").join(b, [*by, "d", "i", "j"]).where(F.array_min(both) == F.col("d"))
    return met.select("a", "b", F.size(both).alias("shared"), F.size("wa").alias("n"), F.size("wb").alias("m"))


def _members(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` of classes with ``id`` and ``candidate_id`` of their rows; lists travel, pairs of rows do not."""
    a, b = left.select(F.col("cid").alias("a"), F.col("ids").alias("_x")), right.select(F.col("cid").alias("b"), F.col("ids").alias("_y"))
    met = pairs.hint("merge").join(a.hint("merge"), "a").hint("merge").join(b.hint("merge"), "b")
    return met.withColumn("id", F.explode("_x")).withColumn("candidate_id", F.explode("_y")).drop("a", "b", "_x", "_y")


def alias_match(incoming: DataFrame, existing: DataFrame, by: list[str], key: str = "id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """Names found among the aliases of existing entities; score 1.

    Ids are grouped by their set of names, so only sets are compared and each pair
    of ids is made once. Ids under several ``by`` can meet several times; only
    pairs of two such ids go through a ``distinct``.
    """
    def sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = _named(rows, *by, "_n", "id").groupBy(*by, "id").agg(F.sort_array(F.collect_set("_n")).alias("words"))
        own = stash(own, "name-sets")
        often = own.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("id").alias("_o"))
        return own, stash(often, "names-often")

    a, often_a = sets(incoming.select(*by, F.col(name).alias("_n"), F.col(key).alias("id")))
    b, often_b = sets(existing.select(*by, F.explode(aliases).alias("_n"), F.col(key).alias("id")))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        (cx, lx), (cy, ly) = _classes(x, by), _classes(y, by)
        found = _members(_class_pairs(cx, cy, by).select("a", "b"), lx, ly)
        return found.where("id <> candidate_id").select("id", "candidate_id", F.lit(1.0).alias("score"))

    if often_a.isEmpty() or often_b.isEmpty():
        return met(a, b)
    a, b = (x.hint("merge").join(o, x["id"] == o["_o"], "left").withColumn("_often", F.col("_o").isNotNull()).drop("_o") for x, o in ((a, often_a), (b, often_b)))
    once = met(a.where("not _often"), b).union(met(a.where("_often"), b.where("not _often")))
    return once.union(met(a.where("_often"), b.where("_often")).distinct())


def cooccurrence(edges: DataFrame, src: str = "src", dst: str = "dst", least: int = 2, by: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """``(by, id, candidate_id, shared, score)`` of nodes with at least ``least`` common targets under equal ``by``.

    Nodes with fewer than ``least`` targets can have no partner and go first.
    The sources of a popular target are dealt into blocks; every two of its blocks
    meet in rows of their own, so a hot target spreads over many tasks.
    """
    e = edges.select(*by, F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct()
    busy = e.groupBy(*by, "s").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    e = e.join(busy, [*by, "s"], "left_semi")
    parts = e.groupBy(*by, "d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    own = e.join(parts, [*by, "d"]).withColumn("mine", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    a = own.select(*by, "d", F.col("s").alias("x"), F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    b = own.select(*by, "d", F.col("s").alias("y"), F.col("mine").alias("j"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    half = a.join(b, [*by, "d", "i", "j"]).where("x < y").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    both = F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("candidate_id")), F.struct(F.col("y").alias("id"), F.col("x").alias("candidate_id")))
    score = F.least(F.col("shared").cast("double") / F.lit(10.0), F.lit(1.0))
    return half.select(*by, F.explode(both).alias("p"), "shared").select(*by, "p.id", "p.candidate_id", "shared", score.alias("score"))


def word_overlap(rows: DataFrame, by: list[str], key: str = "id", words: str = "words") -> DataFrame:
    """``(id, candidate_id, score)``: Jaccard likeness of the word sets of pairs that share a word under equal ``by``.

    Rows are grouped by their set of words; only distinct sets are compared, and their likeness is told to the rows.
    """
    own = F.sort_array(F.filter(F.array_distinct(words), lambda x: x.isNotNull()))
    classes, lists = _classes(rows.select(*by, F.col(key).alias("id"), own.alias("words")), by)
    found = _members(_class_pairs(classes, classes, by), lists, lists).where("id < candidate_id")
    return found.select("id", "candidate_id", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("score"))


def decide(entities: DataFrame, candidates: DataFrame, merge: float = 0.95, review: float = 0.50, by: tuple[str, ...] = ()) -> DataFrame:
    """One decision for each entity: highest score, then least candidate id. Ids are of any ordered type."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("candidate_id").alias("c"))).alias("b")
    top = candidates.groupBy(*by, "id").agg(best)
    score = F.coalesce(-F.col("b.s"), F.lit(0.0))
    decision = exprs.tier(score, merge, review)
    return entities.join(top, [*by, "id"], "left").select(
        *by, "id", decision.alias("decision"), F.when(decision != "new_entity", F.col("b.c")).alias("matched_entity_id"), score.alias("confidence_score")
    )


def same_as_edges(decisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return decisions.where("decision = 'ambiguous'").select(*by, F.col("id").alias("src"), F.col("matched_entity_id").alias("dst"), F.lit("SAME_AS").alias("edge_type"), F.col("confidence_score").alias("confidence"))


def canonical_ids(decisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, canonical_id)``: a merged entity takes the id it matched."""
    return decisions.select(*by, "id", F.when(F.col("decision") == "auto_merge", F.col("matched_entity_id")).otherwise(F.col("id")).alias("canonical_id"))


def resolved_nodes(existing: DataFrame, incoming: DataFrame, decisions: DataFrame, by: tuple[str, ...] = ("tenant_id",), order: str = "seq") -> DataFrame:
    """Nodes after resolution: merged rows overwrite their match, ambiguous and new ones are added.

    Both tables have ``by, id, order`` and the same properties; the last row by
    ``order`` wins whole. ``merged`` says how many incoming rows a node took in.
    """
    props = [c for c in existing.columns if c not in (*by, "id")]
    moved = incoming.join(canonical_ids(decisions, by), [*by, "id"], "left")
    moved = moved.select(*by, F.coalesce("canonical_id", "id").alias("id"), *props, (F.coalesce("canonical_id", "id") != F.col("id")).cast("long").alias("_in"))
    rows = existing.select(*by, "id", *props, F.lit(0).cast("long").alias("_in")).union(moved)
    last = F.max(F.struct(order, *[c for c in props if c != order])).alias("r")
    return rows.groupBy(*by, "id").agg(last, F.sum("_in").alias("merged")).select(*by, "id", *[F.col(f"r.{c}").alias(c) for c in props], "merged")


def vector_upsert(points: DataFrame, by: tuple[str, ...] = ("tenant_id",), key: str = "id", order: str = "seq", vector: str = "embedding") -> DataFrame:
    """The last vector of each point of a tenant; a point's id is what follows ``--`` in its entity's id."""
    point = exprs.point_id(F.col(key).cast("string")).alias("point_id")
    return points.select(*by, point, order, vector).groupBy(*by, "point_id").agg(F.max_by(vector, order).alias(vector))
