"""Training-data operators against brute force on small tables with odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import chat, decontam, lm, mixture, neardup, queries, shards, simhash, sketch, substring, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(6000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today again", "en", "a", 1, 0),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today again", "en", "a", 1, 0),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today again", "en", "a", 1, 0),
    (3, "", "en", None, 0, 0),
    (4, None, None, "b", None, None),
    (5, "so the quick brown fox jumps over the lazy dog and runs far away home", "en", "b", 1, 0),
    (6, LONG, "en", "c", 1, 0),
    (7, LONG + " tail", "en", "c", 1, 0),
    (8, "Ä\tß é x \U0001f600 end", "de", "c", 1, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    marks = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert marks == {i: simhash.simhash64(None if t is None else t.encode()) for i, t, *_ in ROWS}
    comp = {i: i for i in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 4:
                    comp[a] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(comp.values()))
    assert simhash.near_duplicates(none).count() == 0


def _brute_components(texts):
    """Least index reachable over pairs of five-word Jaccard similarity 0.8 or more."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a and not b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return [root(i) for i in range(len(sets))]


def test_near_copies(spark, docs, none):
    rng = np.random.default_rng(3)
    texts = [t for _, t, *_ in ROWS]
    for base in range(12):
        words = [f"b{base}x{w}" for w in rng.integers(0, 400, 120)]
        for copy in range(3 + 9 * (base == 0)):
            own = list(words)
            for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                own[at] = f"c{base}y{copy}z{at}"
            texts.append(" ".join(own) + (" one line that very many of the texts have in common" if base % 2 else ""))
    comp = _brute_components(texts)
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"hot": 2, "block_rows": 8, "block_words": 900}):
        got = neardup.components(small, **sizes).collect()
        mine = {}
        for r in got:
            mine.setdefault(r["root"], []).append(r["doc_id"])
        assert sorted(min(m) for m in mine.values()) == sorted(set(comp))
        assert {i: min(m) for m in mine.values() for i in m} == dict(enumerate(comp))
    import corpus_pipeline

    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, small, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(comp))
    assert neardup.keep_one(none).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns


def test_components_with_null_or_shared_ids_each_keep_a_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(None, one), (None, one), (None, two), (7, one), (8, two), (8, three), (8, three), (None, "lonely text")]
    want = sorted([(7, one), (8, two), (8, three), (-1, "lonely text")])
    for keep in (simhash.keep_one, neardup.keep_one):
        got = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in got) == want


def test_substring(docs, none):
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.strip_repeats(docs).collect()}
    words = [(i, (t or "").encode().split()) for i, t, *_ in ROWS]
    first: dict = {}
    for i, w in words:
        for j in range(len(w) - 12):
            first[tuple(w[j : j + 13])] = min(i, first.get(tuple(w[j : j + 13]), i))
    want = set()
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 12):
            gone[j : j + 13] |= first[tuple(w[j : j + 13])] < i
        want.add((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert got == want
    assert substring.strip_repeats(none).count() == 0


def test_sketch(docs, none):
    got = {r["doc_id"]: r for r in sketch.fingerprints(docs).collect()}
    texts = [t or "" for _, t, *_ in ROWS]
    for n, (i, *_) in enumerate(ROWS):
        if i == 2:
            continue  # the order of its equal rows is free
        t, after = texts[n], texts[(n + 1) % len(ROWS)]
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
    assert got[1]["fingerprint"] == got[2]["fingerprint"]
    assert sketch.fingerprints(none).count() == 0


def test_mixture(docs, none):
    got = mixture.mix(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.01)
    assert mixture.targets([10, 10, 0], [1, 3, 2]) == [5.0, 15.0, 0.0]
    assert mixture.apportion([53.0, 24.0, 23.0], 7) == [3, 2, 2]
    taken = mixture.take(docs).select(F.sum(mixture.word_count(F.col("text")))).first()[0]
    once = {(r["doc_id"], r["size"]): r["taken"] for r in got}
    assert taken == pytest.approx(sum(once.values()), rel=0.02)
    uneven = docs.union(docs.sparkSession.createDataFrame([(100 + i, f"only word{i}", "en", "d", 1, 0) for i in range(40)], SCHEMA))
    counts = {r["doc_id"]: r["taken"] for r in mixture.mix(uneven).collect()}
    passes = {r["doc_id"] for r in mixture.take(uneven).where(mixture.word_count(F.col("text")) > 0).collect()}
    assert {r["doc_id"] for r in mixture.take(uneven).collect()} == passes == {i for i, n in counts.items() if n}
    assert 0 in counts.values()
    assert mixture.mix(none).count() == 0


def test_shards(docs, none):
    got = shards.assign(docs).collect()
    assert len(got) == len(ROWS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    many = [(i, f"text {i} " + "y" * (i % 50)) for i in range(600)]
    many += [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(2000 + i, "the hot text") for i in range(400)]
    made = shards.assign(docs.sparkSession.createDataFrame(many, "doc_id long, text string")).collect()
    load = [sum(r["size"] for r in made if r["shard"] == s) for s in range(16)]
    assert sorted(r["doc_id"] for r in made) == sorted(i for i, _ in many)
    assert max(load) - min(load) <= 0.1 * sum(load) / 16
    home = {r["doc_id"]: r["shard"] for r in made}
    assert sum(home[i] == home[i + 1] for i in range(1000, 1200, 2)) >= 80
    assert shards.assign(none).count() == 0


@pytest.mark.parametrize("each, part", [(2, 0.3), (3, 0.3), (2, 0.8)])
def test_shards_keep_groups_whole(spark, each, part):
    """A group of a third of all bytes beside pairs or triples: only the large group is split."""
    n = 1800
    alone = 0 if part > 0.5 else int(n * (1 - part - 1 / 3))
    grouped = int(n * part) // each * each
    many = [(i, f"alone {i:08d}") for i in range(alone)]
    many += [(10_000 + i, f"group {i // each:08d}") for i in range(grouped)]
    many += [(20_000 + i, "large 00000000") for i in range(n - alone - grouped if part < 0.5 else 0)]
    made = shards.assign(spark.createDataFrame(many, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in made) == sorted(i for i, _ in many)
    home = {r["doc_id"]: r["shard"] for r in made}
    assert not [i for i in range(grouped) if home[10_000 + i] != home[10_000 + i // each * each]]
    load = [sum(r["size"] for r in made if r["shard"] == s) for s in range(16)]
    assert max(load) <= 1.05 * sum(load) / 16


def test_decontamination(spark, docs, none):
    item = "A rare benchmark question, about seven purple otters juggling glass marbles!"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (1, "x" * 5)], "item_id long, text string")
    edited = item.upper().replace("PURPLE", "PURPEL").replace(",", " --")
    more = docs.union(spark.createDataFrame([(20, f"{LONG[:900]} {edited} and on", "en", "z", 1, 0), (21, item[:30], "en", "z", 1, 0)], SCHEMA))
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find(more, bench).collect()] == [(20, 1)]
    kept = {r["doc_id"] for r in decontam.keep_clean(more, bench).collect()}
    assert 20 not in kept
    assert 21 in kept
    assert decontam.find(none, bench).count() == 0
    assert decontam.find(more, bench.limit(0)).count() == 0


def test_toxicity(spark, none):
    rows = [(i, f"All is fine here number {i}. " * 3 + ("You are a zorkish fool. " if i % 4 == 0 else "A kind word. ")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i, _ in rows]) > 0.97
    assert got[900]["score"] == got[901]["score"] == 0.0
    at = got[4]
    assert "zorkish" in rows[4][1][at["worst_start"] : at["worst_end"]]
    assert toxicity.scores(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_tokens(docs, none):
    got = tokens.section_tokens(docs).collect()
    for i in {i for i, *_ in ROWS} - {2}:
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]
    assert list(tokens.attribute(np.array([2, 4, 1]), np.array([0, 3]), 7)[0]) == [1, 2]
    assert tokens.section_tokens(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|end|> b"), (2, 0, "user", "hi"), (2, 1, "assistant", "\\<| c"), (3, 0, None, None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.pack(conv)
    got = {r["conv_id"]: r for r in chat.read_back(packs).collect()}
    told = {1: "user\nhi\nassistant\na <|end|> b\n", 2: "user\nhi\nassistant\n\\<| c\n", 3: "\n\n"}
    assert {i: r["turns_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in told.items()}
    assert (got[1]["loss_chars"], got[3]["loss_chars"]) == (11, 0)
    assert chat.read_back(chat.pack(conv.limit(0))).count() == 0


def test_lm(spark, docs, none):
    got = lm.score(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r["score"] < 0 for r in got)
    words = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts: dict = {}
    for i, t, *_ in ROWS:
        for w in [*words(t), None] if not held(i) else []:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"])
        own = [*words(text), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in counts for w in own), total)
        assert r["base_score"] == pytest.approx(base)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert lm.score(none).count() == 0


def test_registered():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.companions()))
def test_companions_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.companion_sql()[name])
    cols = [c[0] for c in want.description]
    got = queries.companions()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    flat = lambda rows: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows)
    assert flat(got.select(*cols).collect()) == flat(want.fetchall())


def test_lm_bits_as_told_one_by_one():
    """The mixing of one short text, bit by bit with plain numbers, and trees whose paths add up to one."""
    words = [b"w%d" % (i * i % 37) for i in range(300)]
    text = b" ".join(words)
    hashes, n = np.unique(lm._hashes(text), return_counts=True)
    code = lm.make_code({int(h): int(c) for h, c in zip(hashes[:20], n[:20])}, 5, 3, np.arange(256), 1 << 10)
    assert sum(0.5 ** int(x) for x in code.length[: len(code.words) + 2]) == pytest.approx(1)
    assert sum(0.5 ** int(x) for x in code.length[len(code.words) + 2 :]) == pytest.approx(1)
    rng = np.random.default_rng(1)
    tables = lm.Tables(rng.integers(-40, 40, code.size).astype(np.int8), rng.integers(0, 4, code.size).astype(np.uint8), rng.normal(0.3, 0.1, (lm.GATES, lm.INPUTS)))
    s = lm.read_slice(code, [text, b"", text[:40]])
    got = lm.slice_bits(code, s, 3, tables)
    for doc in range(3):
        at = np.flatnonzero(s.doc == doc)
        e = s.events(code, at)
        block = lm.blocks(s.place[at])[e.item]
        w, bend, bits, wait = tables.weights.copy(), np.full((lm.GATES, lm.INPUTS), lm.FIRM), 0.0, []
        for k in range(len(e.item)):
            if k and block[k] != block[k - 1]:
                for i in range(lm.INPUTS):
                    for g in {g for g, *_ in wait}:
                        bend[g, i] += sum(c * x[i] ** 2 for h, c, _, x in wait if h == g)
                        w[g, i] -= sum(p * x[i] for h, _, p, x in wait if h == g) / bend[g, i]
                wait = []
            cell = [int(c[k]) for c in e.cells]
            x = [tables.odds[c] / lm.SCALE for c in cell]
            gate = int(tables.known[cell[1]]) * 4 + int(tables.known[cell[3]])
            sign = 1 - 2 * int(e.bit[k])
            chance = 1 / (1 + np.exp(sign * sum(a * b for a, b in zip(x, w[gate]))))
            bits -= np.log2(chance)
            wait.append((gate, chance * (1 - chance), sign * (1 - chance), x))
        assert got[doc] == pytest.approx(bits, rel=1e-4)


def test_mixture_takes_documents_or_spans(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(int(rng.integers(0, 60)))), f"s{i % 4}" if i % 9 else None, i) for i in range(200)]
    rows += [(7, rows[7][1], rows[7][2], 7)] * 3 + [(None, "no id here", "s1", 0), (7, "another text of that id", "s2", 0)]
    small = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long")
    taken = mixture.mix(small).collect()
    out = mixture.take(small, shard_as="_shard").collect()
    texts = {t for _, t, *_ in rows}
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in taken)
    assert sum(r["text"] not in texts for r in out) <= 2 * 5
    assert all(any(r["text"] in t for t in texts) for r in out)
    assert {r["_shard"] for r in out} <= set(range(mixture.SHARDS))
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixture.take(small, shard_as="_shard").collect()), key=repr)
    by_source: dict = {}
    for r in taken:
        by_source.setdefault((r["target"], r["source_size"]), [0, r["target"]])[0] += r["taken"]
    assert all(abs(got - goal) <= 2 * mixture.WIDTH for got, goal in by_source.values())


def test_sketch_merges_and_estimates(spark):
    words = [f"w{i}" for i in range(1200)]
    a, b = " ".join(words[:900]), " ".join(words[300:])
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(
        sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"), sketch.merge(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m")
    ).select("*", sketch.resemblance(F.col("a"), F.col("b")).alias("like"), sketch.distinct_count(F.col("a")).alias("n"))
    r = row.withColumn("part", sketch.containment(F.col("a"), F.col("b"), F.col("like"))).first()
    assert r["like"] == pytest.approx(596 / 1196, abs=0.15)
    assert r["part"] == pytest.approx(596 / 896, abs=0.15)
    assert r["n"] == pytest.approx(896, rel=0.25)
    assert r["m"] == sorted({*r["a"], *r["b"]})[: sketch.K]
    both = sketch.corpus_sketch(spark.createDataFrame([("s", a), ("s", b), ("t", a)], "source string, text string"), ["source"])
    got = {x["source"]: x["sketch"] for x in both.collect()}
    assert (got["s"], got["t"]) == (r["m"], r["a"])


def test_pivots_discard_unrelated_fingerprints():
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    marks = np.concatenate((marks, marks[:50] ^ np.uint64(5)))
    table, radius = simhash.distances(marks), 4
    far = np.bitwise_count(marks[:, None] ^ marks[None, :])
    kept = np.abs(table[:, None, :] - table[None, :, :]).max(axis=2) <= radius
    assert kept[far <= radius].all()
    assert kept[far > radius].mean() < 0.001
    import pandas as pd

    forest = simhash._forest(radius, pd.DataFrame({"fp": marks.view(np.int64)}))
    assert len(forest) == 50


def test_fingerprints_by_hand(spark):
    words = "One two THREE four five two three".lower().split()
    shingled = [" ".join(words[i : i + 4]).encode() for i in range(4)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingled]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    got = simhash.near_duplicates(spark.createDataFrame([(1, "One two\tTHREE  four five two three"), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {1: f"{want:016x}", 2: "0" * 16}


def test_excerpts_and_edits_are_found(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    item = "q" + "".join(rng.choice(letters, 238)) + "z"
    index = decontam.build([(1, item), (2, "tiny"), (3, "a short item of text")])
    noise = lambda n: "".join(rng.choice(letters, n))
    for at in range(0, 240 - 76, 7):
        assert [m[0] for m in decontam.matches(noise(300) + " " + item[at : at + 76] + " " + noise(200), index)] == [1]
    assert decontam.matches(noise(20_000), index) == []
    assert [m[0] for m in decontam.matches("Tiny!", index)] == [2]
    assert decontam.matches("a tiny thing", index) == []
    assert [m[0] for m in decontam.matches("here is a short, item of TEXT. yes", index)] == [3]
    assert decontam.matches("there is a shorts item of text", index) == []
    found = 0
    for _ in range(100):
        copy = list(item)
        for at in rng.choice(240, 5, replace=False):
            copy[at] = rng.choice(letters[:26])
        found += bool(decontam.matches(noise(200) + "".join(copy) + noise(200), index))
    assert found >= 90


def test_offending_sentences(spark):
    rows = [(i, f"All is fine here number {i}. " * 3 + ("You are a zorkish fool. Go. What a zorkish day." if i % 4 == 0 else "A kind word.")) for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:1] * 50, (None, "You are a zorkish fool."), (900, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"), max_docs=60)
    got = toxicity.offending(docs.where("doc_id = 8 or doc_id is null or doc_id = 900"), model).collect()
    told = {(r["doc_id"], rows[8][1][r["start"] : r["end"]].strip()) for r in got if r["doc_id"] == 8}
    assert told == {(8, "You are a zorkish fool."), (8, "What a zorkish day.")}
    assert [r["sentence"] for r in got if r["doc_id"] is None] == [0]


def test_tokens_by_hand(spark):
    from weft.llm import vocab

    text = "line one\nthe second line\n\nÄöü 😀 end"
    encoder, lengths = vocab.encoding(vocab.shared(spark, vocab.RANKS).value)
    ids, data = encoder.encode_ordinary(text), text.encode()
    stops = np.cumsum(lengths[np.array(ids)])
    line = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8)[:-1] == 10)))
    want: dict = {}
    for a, b in zip(np.concatenate(([0], stops[:-1])), stops):
        shares = np.bincount(line[a:b])
        want[int(np.argmax(shares))] = want.get(int(np.argmax(shares)), 0) + 1
    got = tokens.section_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r["section"]: r["n_tokens"] for r in got if r["n_tokens"]} == want


def test_chat_intervals_and_null_conversations(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < 3 else f"c{i}t{t}") for i in range(6) for t in range(5)]
    rows += [(None, 0, "user", "alone"), (None, 1, "assistant", "too"), (9, None, "user", "no turn"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")]
    packs = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), pack_tokens=10_000)
    p = max(packs.collect(), key=lambda p: len(p["tokens"]))
    for n, parent in enumerate(p["turn_parent"]):
        path = chat.ancestors(p["turn_parent"], parent) if parent >= 0 else []
        want = {x for m in path for x in range(p["turn_start"][m], p["turn_end"][m])}
        assert {x for a, b in zip(p["attend_start"][n], p["attend_end"][n]) for x in range(a, b)} == want
    got = chat.read_back(packs).collect()
    assert sorted(-1 if r["conv_id"] is None else r["conv_id"] for r in got) == [-1, -1, 0, 1, 2, 3, 4, 5, 9]
    assert {r["n_turns"] for r in got if r["conv_id"] == 9} == {3}


CLASH = ("_id", "_key", "_text_key", "_spans", "_words", "row", "draw", "tie", "part", "piece", "id", "key", "fp", "copy", "shard")


def test_odd_rows_and_clashing_names(spark):
    rows = [(i, t, lang, src, n) for i, t, lang, src, n, _ in ROWS] + [(None, "no id", "en", "a", 5), (None, None, None, None, None), (5, "another text of id five", "en", "b", 3)]
    wide = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASH))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, "x")], "item_id long, text string")
    model = toxicity.train(wide, labels)
    n = len(rows)
    assert simhash.near_duplicates(wide).count() == n
    assert toxicity.scores(wide, model).count() == toxicity.keep_clean(wide, model).count() == n
    assert substring.strip_repeats(wide).count() == sketch.fingerprints(wide).count() == n
    assert mixture.mix(wide).count() == shards.assign(wide).count() == lm.score(wide).count() == n
    assert tokens.section_tokens(wide).select("doc_id").distinct().count() == 9
    assert {r["doc_id"] for r in decontam.find(wide, bench).collect()} == {1, 2, 5}
    for stage in (neardup.keep_one(wide), simhash.keep_one(wide), decontam.keep_clean(wide, bench), mixture.take(wide), toxicity.keep_clean(wide, model)):
        assert stage.columns == wide.columns
        assert stage.count() > 0
        assert all(r["tie"] == 7 for r in stage.collect())


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{w}" for w in rng.integers(0, 900, int(rng.integers(5, 90)))) + "." for i in range(240)]
    for i in range(0, 240, 3):
        texts[i] += " You are a zorkish fool."
    texts[10], texts[11] = texts[1], texts[4] + " more"
    item = "what do seven purple otters juggle when the marble moon is high above the quiet harbour wall"
    texts[20] += " " + item
    texts += [None, ""]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [i for i, t in enumerate(texts) if not (t and "zorkish" in t)]
    comp = _brute_components([texts[i] for i in clean])
    kept = [clean[j] for j in range(len(clean)) if comp[j] == j]
    kept = [i for i in kept if item not in (texts[i] or "")]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = spark.read.parquet(str(tmp_path / "documents.parquet")).where(F.col("doc_id").isin(kept))
    want = mixture.take(left).select("doc_id", (F.octet_length("text") + 1).alias("size")).collect()
    assert len({r["doc_id"] for r in got}) > 50
    assert sorted(r["doc_id"] for r in got) == pytest.approx(sorted(r["doc_id"] for r in want))
    assert sum(r["size"] for r in got) == sum(r["size"] for r in want)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(loads) <= 1.25 * sum(loads) / 16


def test_near_copy_pivots_discard_and_keys_move_packed(spark):
    draw = np.random.default_rng(5)
    marks = []
    for center in draw.integers(0, 2**64, (6, 2), dtype=np.uint64):
        for _ in range(8):
            flips = [sum(1 << int(b) for b in draw.choice(64, 4, replace=False)) for _ in range(2)]
            marks.append([int(c) ^ f for c, f in zip(center, flips)])
    rows = [(i, 10, *[int(np.uint64(x).astype(np.int64)) for x in m]) for i, m in enumerate(marks)]
    nodes = spark.createDataFrame(rows, "fp long, n long, s0 long, s1 long")
    far = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(marks[i], marks[j]))
    near = {(i, j) for i in range(len(marks)) for j in range(i) if far(i, j) <= neardup.RADIUS}
    table = neardup.pivot_table(nodes).select("fp", "p")
    kept = table.alias("a").join(table.alias("b"), F.col("a.fp") > F.col("b.fp")).where(neardup.within(F.col("a.p"), F.col("b.p"), neardup.RADIUS // 2))
    kept = {(r[0], r[1]) for r in kept.select("a.fp", "b.fp").collect()}
    assert near <= kept and len(kept) < len(marks) * (len(marks) - 1) // 4
    for hot in (2, 100):
        keys = [(i, [-7, i % 3, 1000 + i]) for i in range(len(marks))]
        keys = spark.createDataFrame(keys + keys[:5], "fp long, keys array<long>")
        found = neardup.candidates(nodes, keys, hot=hot).collect()
        assert {tuple(sorted((r["a"], r["b"]), reverse=True)) for r in found} <= near
        reach = {r["id"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(found), "a", "b").collect()}
        assert all(reach[i] == reach[j] for i, j in near)


def test_lm_lexicon_counts_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 2)
    told = []
    make = lm.make_code
    monkeypatch.setattr(lm, "make_code", lambda counts, rare, ends, *rest: told.append((counts, rare, ends)) or make(counts, rare, ends, *rest))
    rows = [(i, f"both w{i // 2} only{i}") for i in range(60)]
    lm.score(spark.createDataFrame(rows, "doc_id long, text string")).count()
    words = [w for i, text in rows if zlib.crc32(str(i).encode()) % 10 for w in text.split()]
    often = {w for w in words if words.count(w) > 1}
    counts, rare, ends = told[0]
    assert len(counts) == len(often) and sum(counts.values()) == sum(w in often for w in words)
    assert rare == sum(w not in often for w in words) and ends == len(words) // 3
