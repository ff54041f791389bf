"""Edge cases that the queries over the supplied tables don't reach."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrane.functions import text as T
from kestrane.functions import vectors as V
from kestrane.functions.stemmer import stem
from kestrane.operators import filters, graph, graph_retrieval, hybrid, knn, records, text_index
from kestrane.plans import parser as P
from kestrane.plans.planner import Store
from kestrane.sources import records_io


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("1", "2"), ("2", "3"), ("1", "4")]
    forward = spark.createDataFrame([(*r, "relates_to", 1.0, False) for r in rows], "src string, dst string, label string, weight double, reverse boolean")
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight", F.lit(True).alias("reverse")))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_breadth_first(edges):
    assert ids(graph.bfs(edges, ["1"], 1)) == {"1", "2", "4"}
    assert ids(graph.bfs(edges, ["1"], 2)) == {"1", "2", "3", "4"}
    assert ids(graph.bfs(edges, ["3"], 2, "reverse")) == {"3", "2", "1"}
    assert ids(graph.bfs(edges, ["1"], 2, labels=["other"])) == {"1"}


def test_depth_first_and_order(spark, edges):
    order = [r["id"] for r in graph.dfs(edges, "1", 5).orderBy("preorder").collect()]
    assert order == ["1", "2", "3", "4"]
    levels, acyclic = graph.topo_levels(edges)
    assert acyclic and {r["id"]: r["level"] for r in levels.collect()} == {"1": 0, "2": 1, "4": 1, "3": 2}
    assert not graph.is_dag(graph.add_edge(edges, "3", "1", "relates_to"))
    nodes = spark.createDataFrame([(x,) for x in "1234"], "id string")
    ranks = [r["rank"] for r in graph.pagerank(edges, nodes, 20).collect()]
    assert sum(ranks) == pytest.approx(1.0)
    with pytest.raises(KeyError):
        graph.traverse(edges, nodes, "9", None, 1, 2)


def _graph(spark, rows):
    forward = spark.createDataFrame([(*r, "to", 1.0, False) for r in rows], "src string, dst string, label string, weight double, reverse boolean")
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight", F.lit(True).alias("reverse")))


def test_preorder_of_diamonds_and_cycles(spark):
    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("c", "f")]
    out = {}
    for x, y in rows:
        out.setdefault(x, []).append(y)
    order = []

    def walk(x):
        if x not in order:
            order.append(x)
            for y in sorted(out.get(x, [])):
                walk(y)

    walk("a")
    got = [r["id"] for r in graph.dfs(_graph(spark, rows), "a", 9).orderBy("preorder").collect()]
    assert got == order
    levels, acyclic = graph.topo_levels(_graph(spark, rows))
    assert not acyclic and {r["id"]: r["level"] for r in levels.collect()} == {"a": 0, "c": 1, "f": 2}


def test_levels_of_a_long_chain(spark, monkeypatch):
    """Levels and depths go on as long as the graph does; merging tables changes nothing."""
    monkeypatch.setattr(graph, "MERGE_EVERY", 2)
    chain = _graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(7)])
    expected = {f"n{i}": i for i in range(8)}
    for roots in (None, ["n0"]):
        levels, acyclic = graph.topo_levels(chain, roots)
        assert acyclic and {r["id"]: r["level"] for r in levels.collect()} == expected
    assert {r["id"]: r["depth"] for r in graph.bfs(chain, ["n0"]).collect()} == expected


def test_snippets(spark):
    accents = "é" * 100 + " término " + "x" * 200
    texts = {"short": "Térm and term", "far": accents, "none": "y" * 300, "null": None}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: r["s"] for r in df.select("k", T.snippet(F.col("t"), ["termino", "term"], True).alias("s")).collect()}
    assert got["short"] == "<strong>Térm</strong> and <strong>term</strong>" and got["null"] is None
    assert got["far"].startswith("..." + "é" * 47) and "<strong>térm</strong>ino" in got["far"] and got["far"].endswith("x...")
    assert got["none"] == "y" * 76 + "..."
    assert df.select(T.snippet(F.col("t"), []).alias("s")).filter("s is not null").isEmpty()


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([("en", "a", "x y"), ("en", "b", "y")], "namespace string, key string, payload string")
    scored = text_index.scored(df, text_index.plan("x y z"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # once for the statistics, once for the hits
    assert {r["key"]: r["doc_len"] for r in scored.collect()} == {"a": 2, "b": 1}


def test_relevance_by_hand(spark):
    """Marginal relevance against a plain loop; Euclidean batches against brute force."""
    x = np.random.default_rng(2).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = x[3] + 0.1
    unit, uq = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q)
    near = sorted(range(60), key=lambda i: (-round(float(unit[i] @ uq), 6), i))[:20]
    taken = []
    while len(taken) < 4:
        def worth(i):
            return 0.5 * (1 - (1 - round(float(unit[i] @ uq), 6)) / 2) - (0.5 * max(float(unit[i] @ unit[j]) for j in taken) if taken else 0)

        taken.append(max((i for i in near if i not in taken), key=lambda i: round(worth(i), 9)))
    assert [r["key"] for r in knn.mmr(df, q.tolist(), 4).orderBy("rank").collect()] == taken
    queries = df.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["key"], r["score"]) for r in knn.batch(df, queries, 3, metric="euclidean", skip_self=True).collect()}
    for i in range(5):
        d = np.linalg.norm(x - x[i], axis=1)
        order = [j for j in np.argsort(d, kind="stable") if j != i][:3]
        assert [got[i, k + 1][0] for k in range(3)] == order and [got[i, k + 1][1] for k in range(3)] == pytest.approx([-d[j] for j in order], abs=1e-6)


def test_context_text(spark):
    best = spark.createDataFrame([("b", "two\n\n lines ", 1, 0.25), ("a", "one", 0, 0.9)], "id string, content string, hop int, score double")
    own = spark.createDataFrame([("a", "knows", "b"), ("a", "also", "b")], "src string, label string, dst string")
    got = graph_retrieval.context(best, own).head()[0]
    assert got == "## Relevant Nodes\n- Node a (score: 0.9000, hop_distance: 0)\n  one\n- Node b (score: 0.2500, hop_distance: 1)\n  two\n  lines\n\n## Graph Relationships\n- Node a --[also]--> Node b"
    assert graph_retrieval.context(best.limit(0), own.limit(0)).head()[0] == ""


def test_filters(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", None, None)], "key string, n int, tags array<string>")
    keys = lambda c: [r["key"] for r in df.filter(c).orderBy("key").collect()]
    assert keys(filters.matches(df, {"n": 1})) == ["a"]
    assert keys(filters.matches(df, {"n": {"$neq": 2}})) == ["a"]
    assert keys(filters.language_compare("n", "!=", 2, df)) == ["a", "b"]
    assert keys(filters.matches(df, {"tags": "y"})) == ["a"]
    assert keys(filters.matches(df, {"n": "1"})) == [] and keys(filters.matches(df, {"missing": 1})) == []
    assert keys(filters.language_compare("missing", "!=", 1, df)) == ["a", "b"]
    with pytest.raises(ValueError):
        filters.parsed('{"a": [1]}')


def test_store_and_versions(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "namespace string, key string, payload string, version int, created_at timestamp, updated_at timestamp")
    one = spark.createDataFrame([("n", "k", "first")], "namespace string, key string, payload string")
    two = spark.createDataFrame([("n", "k", "second")], "namespace string, key string, payload string")
    store = records.put(records.put(empty, one, now), two, F.lit("2024-02-01").cast("timestamp"))
    last = records.latest(store).head()
    assert (last["payload"], last["version"], str(last["created_at"])[:10]) == ("second", 2, "2024-01-01")
    assert records.get(store, "other", "k").isEmpty()
    with pytest.raises(ValueError):
        records.delete_by_filter(store, "n", {})
    for bad in ("", "a b", "x" * 129):
        with pytest.raises(ValueError):
            records.check_namespace(bad)


def test_language_errors_and_changes(spark):
    with pytest.raises(P.ParseError) as e:
        P.parse("FROM nation\nWHERE = 3")
    assert (e.value.line, e.value.column) == (2, 7)
    for bad in ("(programs)", "FROM nation nonsense more", "SELECT FROM x"):
        with pytest.raises(P.ParseError):
            P.parse(bad)
    s = P.parse('FROM a SIGUE 1..3 "knows" TYPE person AS p WHERE x ~ "t", min = 0.5 FETCH p.x RANK BY y DESC WITH TEMPERATURE 0.9')
    assert s.walk == P.Walk(1, 3, "knows", "person", "p") and s.descending and s.temperature == 0.9
    assert P.parse("INSERT NODE#1 TYPE t {age: 28}").fields == {"age": 28.0}
    store = Store.empty(spark)
    assert store.apply('INSERT NODE#1 TYPE t {a: "x"}') == 1 and store.apply("INSERT NODE#2 TYPE t {}") == 1
    assert store.apply('RELATE NODE#1 --"knows"--> NODE#2 WEIGHT 0.5') == 1 and store.edges.count() == 2
    assert store.apply('UPDATE NODE#1 SET a = "y"') == 1 and store.nodes.filter("id = '1'").head()["fields"]["a"] == "y"
    assert store.apply('INSERT MESSAGE USER "hello" TO THREAD#7') == 2
    assert store.apply("DELETE NODE#1") == 1 and store.nodes.filter("type = 'message'").count() == 1 and store.nodes.count() == 2 and store.edges.filter("label = 'knows'").isEmpty()
    with pytest.raises(KeyError):
        store.apply('RELATE NODE#1 --"knows"--> NODE#2')


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in knn.top(df, [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (2, 0.0), (5, 0.0)]
    q = spark.createDataFrame([(9, [0.9, 0.1])], "query_id long, embedding array<double>")
    assert [r["key"] for r in knn.batch(df, q, 2).orderBy("rank").collect()] == [1, 2]
    assert knn.top(df, [1.0, 0.0], 0).isEmpty()
    w = df.filter("vec_id = 1").select(V.fwht(F.col("embedding")).alias("w")).head()["w"]
    assert w == pytest.approx([2**-0.5, 2**-0.5])


def test_text(spark):
    assert [stem(w) for w in ("running", "ponies", "relational", "generously", "hopping")] == ["run", "poni", "relat", "generous", "hop"]
    assert T.advanced_token_list("The Cafés are RUNNING") == ["cafe", "run"]
    rows = [("en", "a", "machine learning is fun"), ("en", "b", "machine and then learning"), ("en", "c", None)]
    df = spark.createDataFrame(rows, "namespace string, key string, payload string")
    assert [r["key"] for r in text_index.bm25(df, '"machine learning"', 5).collect()] == ["a"]
    assert text_index.plan('odd "quote').phrases == ()
    assert text_index.bm25(df, "", 5).isEmpty()
    assert hybrid.route(" ", None) == "empty" and hybrid.budget(10) == 40 and hybrid.budget(500) == 500


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"namespace": "n", "key": "k", "payload": "p"}\n\nnot json\n{"key": "no namespace"}\n')
    schema = spark.createDataFrame([], "namespace string, key string, payload string").schema
    good, bad = records_io.import_jsonl(spark, f"file://{tmp_path}", schema)
    assert good.count() == 1 and bad.count() == 2
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "a.bin").write_bytes(records_io.bundle([{"namespace": "n", "key": "k", "payload": "p"}]))
    assert records_io.import_bundles(spark, f"file://{tmp_path}/bulk", schema).count() == 1


def test_inverted_recall(spark):
    """Over the keys divisible by 20, cells find 0.9 of what brute force finds; all cells find all."""
    x = np.random.default_rng(5).standard_normal((1000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").persist()
    index = knn.Inverted.build(df, cells=60)
    index.table = index.table.persist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for i in range(0, 1000, 20):
        exact = set(np.argsort(-(unit @ unit[i]), kind="stable")[:11].tolist()) - {i}
        shares.append(len(exact & {r["vec_id"] for r in index.search(x[i].tolist(), 11).collect()}) / 10)
    assert np.mean(shares) >= 0.9
    same = index.search(x[7].tolist(), 10, probes=60).select("vec_id", "score").collect()
    assert same == knn.top(df, x[7].tolist(), 10).select("vec_id", "score").collect()


def test_co_access_in_blocks(spark, monkeypatch):
    """Whole keys with a session of a third of all rows: every pair is counted, and no row holds the session."""
    monkeypatch.setattr(records, "SESSION_BLOCK", 10)
    rows = [(0, i) for i in range(100)] + [(1 + i // 4, 7 * i % 100) for i in range(200)] + [(None, 1), (None, 2), (3, None), (0, 5)]
    df = spark.createDataFrame(rows, "s long, x long")
    assert max(len(r["_items"]) for r in records.session_blocks(df, "s", "x").collect()) <= 40
    sets, counts = {}, {}
    for s, x in rows:
        sets.setdefault(s, set()).update(() if x is None else (x,))
    for xs in sets.values():
        for a, b in combinations(sorted(xs), 2):
            counts[a, b] = counts.get((a, b), 0) + 1
    got = {(r["a"], r["b"]): r["n"] for r in records.co_access(df, "s", "x", least=1, most=1000).collect()}
    assert got == counts
    # halving as it is told: step by step, rounded down, in the order of sessions (null first)
    steps, seen = {}, 0
    for s in sorted(sets, key=lambda s: (s is not None, s or 0)):
        if len(sets[s]) > 1:
            if seen and seen % 7 == 0:
                steps = {p: n // 2 for p, n in steps.items() if n > 1}
            seen += 1
            for p in combinations(sorted(sets[s]), 2):
                steps[p] = steps.get(p, 0) + 1
    got = {(r["a"], r["b"]): r["n"] for r in records.co_access(df, "s", "x", least=1, most=1000, halve_every=7).collect()}
    assert got == steps


def test_index_maintenance_by_hand(spark):
    """Upserts win over deletes of the same key; unknown deletes and empty texts do no harm; an empty batch changes nothing."""
    rec = "namespace string, key string, payload string"
    old = spark.createDataFrame([("n", "a", "one two one"), ("n", "b", "two"), ("n", "c", ""), ("m", "a", "one")], rec)
    ups = spark.createDataFrame([("n", "b", "three three"), ("n", "d", None), ("n", "e", "two one")], rec)
    dels = spark.createDataFrame([("n", "a"), ("n", "b"), ("n", "zz")], "namespace string, key string")
    index, docs = text_index.maintained(text_index.postings(old), text_index.doc_stats(old), ups, dels)
    assert sorted((r["namespace"], r["key"], r["token"], r["tf"], r["positions"]) for r in index.collect()) == [
        ("m", "a", "one", 1, [0]), ("n", "b", "three", 2, [0, 1]), ("n", "e", "one", 1, [1]), ("n", "e", "two", 1, [0])
    ]
    assert {r["namespace"]: (r["doc_count"], r["total_doc_len"]) for r in text_index.stats_of(docs).collect()} == {"n": (4, 4), "m": (1, 1)}
    same, _ = text_index.maintained(text_index.postings(old), text_index.doc_stats(old), ups.limit(0), dels.limit(0))
    assert same.exceptAll(text_index.postings(old)).isEmpty() and same.count() == 4


def test_index_kinds_by_name(spark):
    df = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)] + [(60, None)], "vec_id long, embedding array<double>")
    want = knn.top(df, [1.0, 2.0, 0.5], 4, metric="euclidean").select("vec_id", "score").collect()
    for kind in ("flat", "hnsw", "diskann", "scann"):
        assert knn.make_index(kind, df, metric="euclidean").search([1.0, 2.0, 0.5], 4).select("vec_id", "score").collect() == want
    for kind, metric in (("ivf", "euclidean"), ("tree", "cosine")):
        with pytest.raises(ValueError):
            knn.make_index(kind, df, metric=metric)


def _brute(x, q, i, k, metric):
    with np.errstate(all="ignore"):
        if metric == "cosine":
            under = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            s = np.divide(x @ q, under, out=np.zeros(len(x)), where=under != 0)
        else:
            s = -np.sqrt(((x - q) ** 2).sum(1))
    s = np.where(np.isnan(s), np.inf, np.round(s, 6))
    return [(j, s[j]) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:k]]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_in_tiles(metric, monkeypatch):
    """Tiles smaller than the tables, equal rows, zeros, large norms and odd numbers: what brute force finds, with ties by key."""
    monkeypatch.setattr(knn, "TILE", (16, 32))
    x = np.random.default_rng(3).standard_normal((300, 6))
    x[40:90] = x[7]
    x[90:95] = 0.0
    x[100:140] = 1e5 + x[:40] / 1e3
    x[200, 2], x[201, 1], x[202, 0] = np.nan, np.inf, -np.inf
    at = np.arange(0, 300, 3)
    best = knn.Nearest(at, x[at], 8, metric, True)
    for i in range(0, 300, 70):
        best.add(np.arange(i, min(i + 70, 300)), x[i : i + 70])
    got = {}
    for r in best.rows().to_pylist():
        got.setdefault(r["query_id"], []).append((r["key"], np.inf if np.isnan(r["score"]) else r["score"]))
    assert got == {i: _brute(x, x[i], i, 8, metric) for i in at.tolist()}


def test_nearest_takes_bounded_memory():
    """A batch of 4,000 queries and rows of 10,000: all scores of it would take 320 MB."""
    import tracemalloc

    x = np.random.default_rng(4).standard_normal((10_000, 8))
    best = knn.Nearest(np.arange(4000), x[:4000], 5, "euclidean", True)
    tracemalloc.start()
    best.add(np.arange(10_000), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_batches_in_blocks(spark, monkeypatch):
    """Blocks of queries give what one block gives; rows without a key or with a null within are skipped; lengths don't mix."""
    x = np.random.default_rng(6).standard_normal((80, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(None, x[0]), (200, [1.0, None, 1.0, 1.0]), (201, [1.0, 2.0]), (202, [2.0, 1.0]), (203, None), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = df.filter("vec_id % 2 = 0 or vec_id > 80").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, knn.batch(df, queries, 3, skip_self=True).collect()))
    monkeypatch.setattr(knn, "MAX_VALUES", 100)
    blocks = knn.batch(df, queries, 3, skip_self=True)
    assert sorted(map(tuple, blocks.collect())) == whole and len(whole) == 40 * 3 + 2
    assert {(r[0], r[1]) for r in whole if r[0] > 80} == {(201, 202), (202, 201)}
    assert knn.batch(df, queries, 0).isEmpty()


def test_postings_without_a_shuffle_of_tokens(spark):
    """Only keys are shuffled where no key is met twice; rows of a key that is met twice become one record's postings."""
    rec = "namespace string, key string, payload string"
    df = spark.createDataFrame([("n", "a", "b a b"), (None, "a", "x"), ("n", "c", ""), ("n", "d", None)], rec)
    index = text_index.postings(df)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = lambda a: sorted((r["namespace"] or "", r["key"], r["token"], r["tf"], r["positions"]) for r in a.collect())
    assert got(index) == [("", "a", "x", 1, [0]), ("n", "a", "a", 1, [1]), ("n", "a", "b", 2, [0, 2])]
    twice = df.unionByName(spark.createDataFrame([("n", "a", "c b"), (None, "a", "x")], rec))
    assert got(text_index.postings(twice)) == [("", "a", "x", 2, [0, 0]), ("n", "a", "a", 1, [1]), ("n", "a", "b", 3, [0, 1, 2]), ("n", "a", "c", 1, [0])]


def test_packed_postings(spark, monkeypatch):
    """Any rows come back from their packed form, and records in order become a row each; damage of any kind is found."""
    monkeypatch.setattr(text_index, "PACK_ROWS", 50)
    texts = [("n" if i % 3 else None, str(i), " ".join(f"t{j % (i + 1)}" for j in range(40))) for i in range(30)]
    index = text_index.postings(spark.createDataFrame(texts, "namespace string, key string, payload string").coalesce(1))
    odd = spark.createDataFrame([("n", "1", "a\x01b", 1, [1], 2), ("n", "1", None, 1, [1], 2), ("m", None, "z", None, None, None), ("m", "2", "e", 3, [], 1), ("m", "2", "", 1, [4, None], 7)], "namespace string, key string, token string, tf int, positions array<int>, doc_len int")
    for a in (index, odd, index.unionByName(odd), odd.filter("tf = 3")):
        back = text_index.unpacked(text_index.packed(a))
        assert back.exceptAll(a).isEmpty() and a.exceptAll(back).isEmpty()
    assert text_index.packed(index).count() < index.count() / 4
    bad = index.filter("token <> 't0'").unionByName(odd).withColumn("positions", F.when(F.col("token") == "t1", F.reverse("positions")).otherwise(F.col("positions")))
    bad = bad.withColumn("doc_len", F.when((F.col("token") == "t2") & F.col("namespace").isNull(), 1).otherwise(F.col("doc_len")))
    assert tuple(text_index.audit(index, bad).head()) == (30, 5, 0, index.filter("token = 't1' and tf > 1").count(), 9)
    how = {(r["token"], r["repair"]) for r in text_index.repaired(index, bad).collect()}
    assert ("t0", "added") in how and ("t2", "rewritten") in how and ("t3", "kept") in how and ("t3", "rewritten") not in how
    assert text_index.repaired(index, bad).drop("repair").exceptAll(index).isEmpty()


def test_advanced_tokens_in_bounded_batches(spark):
    """A worker gets a bounded number of rows and bytes at once, whatever the session allowed before."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, "10000")
    spark.conf.set(size, "67108864b")
    df = spark.createDataFrame([(1, "The Cafés are RUNNING"), (2, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", T.advanced_tokens(F.col("t")).alias("x")).collect()}
    assert got == {1: ["cafe", "run"], 2: []}
    assert int(spark.conf.get(rows)) <= 500 and int(spark.conf.get(size).rstrip("b")) <= 1 << 20
