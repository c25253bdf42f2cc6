"""Changes, traversals, planning, chunking and ports on small tables, with nulls, ties, repeats and clashing names."""

import pytest
from pyspark.sql import functions as F

from sparkloom.config import Settings
from sparkloom.errors import PortError
from sparkloom.functions import progress, text
from sparkloom.functions.ports import complete_column, embed_column, hashing_embedder, with_retry
from sparkloom.operators import changes, chunking, linking, lookup, ranking, references, traverse, vector
from sparkloom.operators.skew import salted_join
from sparkloom.plans import planner


# -- changes
def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, created int")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 30)], old.schema)
    got = {r["k"]: (r["v"], r["created"]) for r in changes.upsert(old, new, ["k"], keep=("created",)).collect()}
    assert got == {1: ("a", 10), 2: ("B", 20), 3: ("C", 30), None: ("n", 0)}
    again = changes.upsert(changes.upsert(old, new, ["k"]), new, ["k"])
    assert again.count() == 4


def test_last_of_batch_versions_and_deletes(spark):
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "y", 2), (2, "z", 1)], "k int, v string, at int")
    assert {r["k"]: r["v"] for r in changes.last_of_batch(b, ["k"], "at").collect()} == {1: "y", 2: "z"}
    v = changes.versioned(spark.createDataFrame([(1, 4)], "k int, version int"), spark.createDataFrame([(1, 0), (2, 0)], "k int, version int"), ["k"])
    assert {r["k"]: r["version"] for r in v.collect()} == {1: 5, 2: 1}
    assert changes.delete_where(b, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]).count() == 1


def test_difference(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, h string")
    i = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], s.schema)
    assert {r["p"]: r["state"] for r in changes.difference(s, i, "p", "h").collect()} == {"a": "same", "b": "changed", "c": "new", "d": "gone"}


def test_swap(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    changes.swap(spark.range(3), at)
    changes.swap(spark.read.parquet(at).where("id > 0"), at)
    assert sorted(r[0] for r in spark.read.parquet(at).collect()) == [1, 2]


# -- joins and traversals
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_is_the_plain_join(spark, how):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    one = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, w int")
    plain = many.join(one, ["k"], how)
    assert sorted(map(str, salted_join(many, one, ["k"], ["i"], how).select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def trails(edges, hops):
    out = set()

    def walk(origin, at, used):
        if used and origin != at:
            out.add((origin, at, len(used)))
        if len(used) < hops:
            for e in edges - set(used):
                if e[0] == at:
                    walk(origin, e[1], (*used, e))

    for a in {a for a, _ in edges}:
        walk(a, a, ())
    return out


def test_reach_follows_trails(spark):
    edges = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "a")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    for hops in (1, 2, 4):
        assert {tuple(r) for r in traverse.reach(df, hops).collect()} == trails(edges, hops)
    assert {r["origin"] for r in traverse.reach(df, 2, F.col("src") == "c").collect()} == {"c"}
    back = {(r["at"], r["origin"], r["depth"]) for r in traverse.reach(traverse.reverse(df), 3).collect()}
    assert back == {tuple(r) for r in traverse.reach(df, 3).collect()}


def test_paths_between(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "src string, dst string")
    got = traverse.all_paths(df, spark.createDataFrame([("a", "e"), ("e", "a")], "source string, target string"), hops=5)
    assert [(r["length"], r["path"]) for r in got.orderBy("length", "path").collect()] == [(3, "a > b > d > e"), (3, "a > c > d > e"), (5, "a > b > a > c > d > e")][: got.count()]
    assert got.where("length = 3").count() == 2


@pytest.fixture
def stored_calls(spark, tmp_path):
    """Entities in whose calls there are chains of 5 to 12 steps, a circle, a diamond and more than ten ways."""
    calls = {f"m.c{i:02d}": [f"m.c{i + 1:02d}"] for i in range(12)} | {"m.c03": ["m.c04", "m.x"], "m.x": ["m.c05", "m.c02"], "m.h": [f"m.w{i:02d}" for i in range(11)], "m.c12": []} | {f"m.w{i:02d}": ["m.t"] for i in range(11)} | {"m.t": []}
    rows = [(q, q[2:], "function", "m.py", None, [], c, "2026-01-01 00:00:00") for q, c in calls.items()]
    df = spark.createDataFrame(rows, "qualified_name string, name string, type string, file_path string, parent_class string, base_classes array<string>, calls array<string>, indexed_at string")
    df.withColumn("indexed_at", F.col("indexed_at").cast("timestamp")).write.parquet(str(tmp_path / "code_entities.parquet"))
    return str(tmp_path), {(a, b) for a, bs in calls.items() for b in bs}


def brute_paths(edges, hops):
    """The first ten trails of each pair by length and text."""
    found = {}

    def walk(path, used):
        if used:
            found.setdefault((path[0], path[-1]), []).append((len(used), " > ".join(path)))
        if len(used) < hops:
            for e in sorted(edges - set(used)):
                if e[0] == path[-1]:
                    walk([*path, e[1]], (*used, e))

    for a in {a for a, _ in edges}:
        walk([a], ())
    return {k: sorted(v)[:10] for k, v in found.items()}


def test_call_paths_of_more_than_four_calls(spark, stored_calls, monkeypatch):
    at, edges = stored_calls
    want = brute_paths(edges, 10)
    pairs = [("m.c00", "m.c10"), ("m.c00", "m.c12"), ("m.c01", "m.c07"), ("m.h", "m.t")]
    monkeypatch.setattr(traverse, "call_pairs", lambda *_: spark.createDataFrame(pairs, "source string, target string"))
    got = traverse.call_paths(spark, at).collect()
    assert sorted((r["source"], r["target"], r["length"], r["path"]) for r in got) == sorted((*k, *p) for k in pairs for p in want.get(k, []))
    assert {(r["source"], r["target"]): r["length"] for r in traverse.shortest_chains(spark, at).collect()} == {k: want[k][0][0] for k in pairs if k in want}


def test_paths_between_all_connected_pairs(spark, stored_calls):
    at, edges = stored_calls
    want = brute_paths(edges, 10)
    got = traverse.all_call_paths(spark, at).collect()
    assert sorted((r["source"], r["target"], r["length"], r["path"]) for r in got) == sorted((*k, *p) for k, ps in want.items() for p in ps)
    assert {(r["source"], r["target"]): r["length"] for r in traverse.all_shortest_chains(spark, at).collect()} == {k: p[0][0] for k, p in want.items()}
    assert len(want["m.h", "m.t"]) == 10 and ("m.c02", "m.c02") in want and ("m.c00", "m.c12") not in want


def test_mro_of_a_diamond(spark):
    e = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("A", "D", 0)], "src string, dst string, pos int")
    got = {(r["class_name"], r["position"]): r["ancestor"] for r in traverse.linearised(e).collect()}
    assert [got["D", i] for i in (1, 2, 3)] == ["B", "C", "A"] and ("D", 4) not in got


def test_mro_has_no_largest_depth(spark):
    parents = {f"c{i}": [f"c{i + 1}"] for i in range(45)} | {"c3": ["c4", "s0"], "c7": ["c9", "c8"], "c20": ["s1", "c21"], "s0": ["c30", "s1"], "s1": ["c44", "c2"], "own": ["own", "c40"], "c45": ["c38"]}
    got = {}
    for r in traverse.linearised(spark.createDataFrame([(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)], "src string, dst string, pos int")).orderBy("class_name", "position").collect():
        got.setdefault(r["class_name"], []).append(r["ancestor"])

    def walked(c):
        order, queue = [c], list(parents[c])
        while queue:
            p = queue.pop(0)
            if p not in order:
                order.append(p)
                queue += parents.get(p, [])
        return order[1:]

    assert got == {c: walked(c) for c in parents}
    chain = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}", 0) for i in range(42)], "src string, dst string, pos int")
    assert [(r["ancestor"], r["depth"]) for r in traverse.linearised(chain).where("class_name = 'c00'").orderBy("position").collect()] == [(f"c{i:02d}", i) for i in range(1, 43)]


def test_lookups(spark):
    n = spark.createDataFrame([("m.Load", "Load", "Class"), ("m.load", "load", "Function"), ("m.reload", "reload", "Function"), ("m.x", "x", "Method")], "qualified_name string, name string, node_type string")
    assert [r["match_score"] for r in lookup.fuzzy(n, "load").collect()] == [0, 2, 4]
    assert lookup.find_entity(n, "m.load").count() == 1 and lookup.find_entity(n, "load", "Class").count() == 0
    assert lookup.search_by_name(n, "oad", 2).count() == 2
    with pytest.raises(ValueError):
        lookup.find_entity(n, " ")


# -- ranking and vectors
def test_fold_is_in_order(spark):
    df = spark.createDataFrame([(1, "k", 1, 1, 9, 0.5, "f", "e"), (1, "k", 0, 2, 3, 0.2, "f", "e"), (1, "k", 0, 1, 4, 1.0, "f", "e"), (1, "l", 1, 1, 5, 0.7, "f", "e")], "query_id int, key string, side int, depth int, result_id int, score double, file_path string, entity_name string")
    got = {r["key"]: (r["score"], r["source"]) for r in ranking.merged(df).collect()}
    first = (1.0 + 0.2) / 2 * 1.1
    assert got["k"] == (pytest.approx((first + 0.5) / 2 * 1.1), "hybrid") and got["l"] == (0.7, "vector")


def test_caps(spark):
    df = spark.createDataFrame([(1, f"k{i:02d}", "f" if i < 8 else f"g{i}", float(i)) for i in range(20)], "query_id int, key string, file_path string, score double")
    got = ranking.capped(df, per_file=3, total=10)
    assert got.count() == 10 and [r["key"] for r in got.orderBy("rank").limit(2).collect()] == ["k19", "k18"]
    assert ranking.capped(df, per_file=3, total=100).where("file_path = 'f'").count() == 3


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROW_BLOCK", 7)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    rows = [(i, [float(i % 5), float(i % 3), 1.0], i % 2) for i in range(40)] + [(50, [0.0, 0.0, 0.0], 0), (51, None, 1)]
    r = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = r.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")

    def brute(a, k, label=None):
        import math

        va = rows[a][1]
        s = []
        for i, vb, lb in rows:
            if vb and any(vb) and (label is None or lb == label):
                c = sum(x * y for x, y in zip(va, vb)) / math.sqrt(sum(x * x for x in va)) / math.sqrt(sum(x * x for x in vb))
                s.append((-round(c, 9), i))
        return [i for _, i in sorted(s)[:k]]

    got = {}
    for row in vector.knn(q, r, 6).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert got == {a: brute(a, 6) for a in range(5)}
    some = vector.knn(q, r, 4, same="label").where("query_id = 3").orderBy("rank")
    assert [x["vec_id"] for x in some.collect()] == brute(3, 4, 1)
    assert vector.knn(q, r, 3, exclude_self=True).where("query_id = vec_id").count() == 0
    assert vector.knn(q.limit(0), r, 3).count() == 0


def test_knn_sends_by_the_blocks_of_each_value(spark, monkeypatch):
    """Ten values of 20 queries and 20 rows, none of which fills a block, and one of 60 of each: three blocks by three."""
    import pyarrow as pa

    def sent(k, more, least=None):
        return lambda a, b: pa.table({"query_id": pa.array([a.num_rows + b.num_rows], pa.int64()), "vec_id": pa.array([0], pa.int64()), "score": pa.array([1.0])})

    monkeypatch.setattr(vector, "ROW_BLOCK", 25)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 25)
    monkeypatch.setattr(vector, "_block_best", sent)
    rows = [(i, [1.0, float(i)], f"p{i % 10}" if i < 200 else "large") for i in range(260)]
    q, r = (spark.createDataFrame(rows, f"{c} long, embedding array<float>, label string") for c in ("query_id", "vec_id"))
    assert sum(x["query_id"] for x in vector.knn(q, r, 1000, same="label").collect()) == 400 + 2 * 3 * 60
    monkeypatch.setattr(vector, "BLOCK_NUMBERS", 40)  # vectors of two numbers: 20 of them
    assert sum(x["query_id"] for x in vector.knn(q, r, 1000, same="label").collect()) == 400 + 2 * 3 * 60


@pytest.mark.parametrize("least", [None, 0.0, 0.6])
def test_block_best_in_steps_is_exact(least, monkeypatch):
    """Repeated, opposite and zero vectors, many equal scores; both ways of scoring a step."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vector, "QUERY_STEP", 16)
    monkeypatch.setattr(vector, "ROW_STEP", 40)
    rng = np.random.default_rng(5)
    for x in (rng.integers(-1, 2, (230, 4)).astype(np.float32), rng.normal(size=(230, 24)).astype(np.float32)):
        x[7], x[30] = 0, 3 * x[31]
        table = lambda name, v, ids: pa.table({name: pa.array(ids, pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32()))})
        vec = rng.permutation(230)
        got = vector._block_best(5, 1, least)(table("query_id", x[:50], np.arange(50)), table("vec_id", x, vec)).to_pylist()
        for i in range(50):
            n = np.linalg.norm(x.astype(float), axis=1)
            with np.errstate(invalid="ignore"):
                s = np.round(x.astype(float) @ x[i].astype(float) / n / n[i], 9)
            want = sorted((-s[j], vec[j]) for j in range(230) if np.isfinite(s[j]) and (least is None or s[j] >= least))[:6]
            assert sorted((-g["score"], g["vec_id"]) for g in got if g["query_id"] == i) == want
    with pytest.raises(ValueError, match="different lengths"):
        vector._block_best(5, 1)(pa.table({"query_id": [1, 2], "embedding": [[1.0], [1.0, 2.0]]}), table("vec_id", x, vec))


# -- plans and text
@pytest.mark.parametrize(
    "question,intent,kind,hops",
    [("Who calls load_file?", "find_callers", "graph", 1), ("show the call chain via X", "find_call_chain", "graph", 3), ("how does `a.b` work", "explain_implementation", "hybrid", 1), ("anything like it", "find_similar", "vector", 1), ("path from a to b", "search_functionality", "vector", 3), ("", "search_functionality", "vector", 1)],
)
def test_plans(spark, question, intent, kind, hops):
    r = planner.plan(spark.createDataFrame([(question,)], "query_text string")).first()
    assert (r["intent"], r["search_type"], r["max_hops"]) == (intent, kind, hops)


def test_entities_of_a_question(spark):
    r = planner.plan(spark.createDataFrame([("Does OrderBook call load_file or `x y`? None",), (None,)], "query_text string")).collect()
    assert r[0]["entities"] == ["OrderBook", "load_file", "x y"] and r[1]["entities"] == []


@pytest.mark.parametrize("answer,want", [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": "}"}\n``` y', {"a": "}"}), ('so {"a": {"b": [1]}} it is {', {"a": {"b": [1]}}), ("[1]", None), ("none", None), (None, None), ('{"a": "\\"}"} tail }', {"a": '"}'})])
def test_salvage(answer, want):
    assert planner.salvage(answer) == want


def test_judgements():
    assert linking.judgement('{"drift_detected": true, "drift_severity": "major", "drift_score": 0.8}')["severity"] == "major_drift"
    assert linking.judgement('{"drift_detected": false, "drift_severity": "major", "drift_score": 0.8}')["score"] == 0
    assert linking.judgement("drift_detected is True, I think")["score"] == 0.5 and not linking.judgement("no")["drift_detected"]


def test_references(spark):
    t = spark.createDataFrame([("c", "See `A.b` and `run` or OrderBook; call run( now\n```python\ndef run(x):\n  pass\nfrom m import A, zed\n```"), ("d", None), ("e", "")], "chunk_id string, body string")
    m = references.mentions(t.where("body IS NOT NULL"), "chunk_id", "body")
    keys = references.name_keys(spark.createDataFrame([("p.A",), ("p.A.b",), ("q.run",), ("a.run",), ("x.OrderBook",)], "qualified_name string"))
    got = {r["qualified_name"]: (r["pattern"], r["line"]) for r in references.best_references(m.join(keys, "text"), "chunk_id").collect()}
    assert got == {"p.A.b": ("backtick_qualified", 1), "a.run": ("python_def", 0), "x.OrderBook": ("class_name", 1), "p.A": ("import_from", 0)}


def test_nearest_name(spark):
    n = spark.createDataFrame([("p.m.run", "run"), ("p.k.run", "run"), ("z.run", "run"), ("p.m.sub.run", "run"), ("p.m.go", "go")], "qualified_name string, name string")
    asked = spark.createDataFrame([("p.m", "run"), ("p.q", "run"), ("z", "run"), ("z", "none")], "module string, simple string")
    got = {r["module"]: r["nearest"] for r in references.nearest_by_name(asked, n).collect()}
    assert got == {"p.m": "p.m.run", "p.q": "p.k.run", "z": "z.run"}


def test_import_sources(spark):
    from sparkloom.operators.imports import resolved_source

    cases = [("p.a.b", ".m", False, "p.a.m"), ("p.a.b", "..m.n", False, "p.m.n"), ("p.a", ".m", True, "p.a.m"), ("p.a.b", ".", False, "p.a"), ("p.a.b", "./m", False, "p.a.m"), ("p.a.b", "../x/y", False, "p.x.y"), ("p.a.b", "lib", False, "lib"), ("p", "....m", False, "m"), ("p.a", None, False, None)]
    df = spark.createDataFrame(cases, "module string, source string, pkg boolean, want string")
    assert [r["got"] for r in df.select(resolved_source(F.col("module"), F.col("source"), F.col("pkg")).alias("got")).collect()] == [c[3] for c in cases]


def test_text_helpers(spark):
    df = spark.createDataFrame([("order_line", "Map<A, B>[]", ["a", "b"], "```json\nx\n```")], "n string, t string, l array<string>, f string")
    r = df.select(text.class_guess(F.col("n")).alias("a"), text.plain_type(F.col("t")).alias("b"), text.chain_text(F.col("l")).alias("c"), text.strip_fences(F.col("f")).alias("d"), text.truncate(F.col("n"), 5).alias("e"), text.extended_by(F.col("l"), 1).alias("g"), text.relative_module(F.lit("a.b.c"), F.lit(2), F.lit("x")).alias("h")).first()
    assert tuple(r) == ("OrderLine", "Map", "a → b", "x", "order\n... (truncated)", "Extended by a (and 1 more)", "a.x")


# -- chunks
def test_line_windows():
    text_ = "\n".join(f"w{i} x y" for i in range(30))
    got = chunking.line_windows(text_, 12, 3)
    assert got[0] == (0, 4) and got[1][0] == 3 and got[-1][1] == 30
    assert chunking.line_windows("one " * 50, 10, 3) == [(0, 1)] and chunking.line_windows("", 10, 3) == [(0, 1)]


def test_sections():
    got = chunking.markdown_sections("intro\n# A\nx\n## B\ny\n```\n# no\n```\n# C #\nz", 1000, 10)
    assert [(p, l, a, b) for p, l, a, b, _ in got] == [([], 0, 1, 1), (["A"], 1, 2, 3), (["A", "B"], 2, 4, 8), (["C"], 1, 9, 10)]


def test_chunk_code(spark):
    df = spark.createDataFrame([("m.f", 10, "a b\nc"), ("m.g", 1, "\n".join(["w " * 20] * 10)), ("m.n", 1, None)], "name string, start_line int, content string")
    got = chunking.chunk_code(df, 50, 20).orderBy("name", "part").collect()
    assert (got[0]["chunk_name"], got[0]["end_line"]) == ("m.f", 11) and got[1]["chunk_name"] == "m.g_part1" and got[-1]["end_line"] == 10
    assert got[2]["start_line"] == 2


# -- ports, settings, progress
def test_ports(spark):
    df = spark.createDataFrame([("load the file",), ("",), (None,)], "t string")
    v = [r["embedding"] for r in embed_column(df, "t").collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-6) and not any(v[1]) and not any(v[2])
    assert hashing_embedder()(["a b"]) == hashing_embedder()(["b a"])
    a = complete_column(df.withColumn("p", F.lit("One. Two.")), "p", "s").first()["s"]
    assert a == "One. Two."
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x

    assert with_retry(flaky, wait=0)(7) == 7 and len(calls) == 3
    with pytest.raises(PortError):
        with_retry(lambda: 1 / 0, tries=2, wait=0)()


def test_settings():
    with pytest.raises(ValueError):
        Settings(chunk_overlap=2000)
    with pytest.raises(ValueError):
        Settings(search_limit=0)


def test_progress():
    assert progress.percent({"scan": (1, 1), "parse": (1, 2)}) == 12.5 and progress.percent({s: (1, 1) for s in progress.STAGES}) == 100
    assert [progress.status(*x) for x in ((0, 0), (1, 0), (0, 1), (1, 1))] == ["pending", "completed", "failed", "partial"]


def test_index_of_lists_finds_nearly_all(spark):
    import numpy as np

    from sparkloom.operators import vector as V

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    clustered = [(int(i), (centres[i % 12] + 0.3 * rng.normal(size=16)).astype("float32").tolist()) for i in range(900)]
    copies = [(int(i), centres[0].astype("float32").tolist()) for i in range(900, 1400)]
    odd = [(2000, None), (2001, [0.0] * 16)]
    rows = spark.createDataFrame(clustered + copies + odd, "vec_id long, embedding array<float>")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.fit_index(rows, 10)
    assert index[1] < len(index[0])
    exact = {(r["query_id"], r["vec_id"]) for r in V.knn(queries, rows, 10).collect()}
    old, V.ROW_BLOCK = V.ROW_BLOCK, 64  # lists cut into blocks
    try:
        got = {(r["query_id"], r["vec_id"]) for r in V.ivf_search(queries, rows, 10, index).collect()}
    finally:
        V.ROW_BLOCK = old
    assert len(exact & got) / len(exact) >= 0.9 and len(got) == len(exact)
    assert V.ivf_search(queries, rows.limit(0), 10).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_vectors(spark, folder):
    from sparkloom import registry

    r = registry.queries()["ivf_recall"](spark, f"/root/testdata/{folder}").first()
    assert r["n_found"] / r["n_exact"] >= 0.9


def test_literals_chains_and_first_values(spark):
    rows = [('r"""A."""',), ("'b'",), ("plain",), ('"open',), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(text.literal_text(F.col("s"))).collect()] == ["A.", "b", "plain", '"open', "", None]
    calls = spark.createDataFrame([("a(b).c",), ("a.b().d()",), ("plain",), ("a.b",), (None,)], "c string")
    assert [tuple(r) for r in calls.select(text.is_chained(F.col("c")), text.chain_member(F.col("c"))).collect()] == [(True, "c"), (True, "d"), (False, None), (False, "b"), (None, None)]
    pairs = spark.createDataFrame([("", "b"), (None, "c"), ("a", None), (None, "")], "x string, y string")
    assert [r[0] for r in pairs.select(text.first_filled(F.col("x"), F.col("y"))).collect()] == ["b", "c", "a", None]
