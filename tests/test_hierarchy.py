"""Contraction against brute force on random graphs, and on the awkward shapes."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import hierarchy as H


def circles(edges):
    """Nodes reached again from themselves."""
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    found = set()
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        if start in seen:
            found.add(start)
    return found


def frame(spark, edges):
    return spark.createDataFrame([("k", c, p) for c, p in edges], "kind string, child string, parent string")


SHAPES = {
    "none": [],
    "own parent": [("a", "a")],
    "two": [("a", "b"), ("b", "a"), ("c", "a")],
    "eight": [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("d", "c")],
    "core": [(x, y) for x in "abcd" for y in "abcd" if x != y] + [("e", "a"), ("d", "f"), ("f", "g")],
    "between rings": [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "c"), ("c", "d"), ("d", "c"), ("a", "z"), ("z", "c")],
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(60)],
    "long ring": [(f"n{i}", f"n{(i + 1) % 40}") for i in range(40)] + [("m", "n3")],
    "repeated": [("a", "b"), ("a", "b"), ("b", "a")],
}


@pytest.mark.parametrize("name", SHAPES)
def test_circles_of_shapes(spark, name):
    got = {r["node"] for r in H.on_circles(frame(spark, SHAPES[name])).collect()}
    assert got == circles(SHAPES[name])


@pytest.mark.parametrize("seed", range(4))
def test_circles_at_random(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(rnd.choice([15, 25, 40]))]
    got = {r["node"] for r in H.on_circles(frame(spark, edges)).collect()}
    assert got == circles(edges)


def test_paths(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "n0"), ("y", "n5"), ("p", "q"), ("q", "p"), ("r", "p"), ("far", "outside")]
    nodes = spark.createDataFrame([("k", n) for n in [*(f"n{i}" for i in range(31)), "x", "y", "p", "q", "r", "far", "alone"]], "kind string, node string")
    got = {r["node"]: r for r in H.paths(nodes, frame(spark, edges)).collect()}
    assert got["x"]["depth"] == 31 and got["x"]["root"] == "n30" and got["x"]["path"][-2:] == ["n0", "x"]
    assert got["y"]["path"] == [f"n{i}" for i in range(30, 4, -1)] + ["y"]
    assert got["alone"]["path"] == ["alone"] and got["far"]["depth"] == 0
    assert [got[n]["state"] for n in "pqr"] == ["circle", "circle", "leads_to_circle"]
    assert len(got) == nodes.count()


def test_paths_of_nothing(spark):
    nodes = spark.createDataFrame([], "kind string, node string")
    assert H.paths(nodes, frame(spark, [])).count() == 0


def test_null_ends_are_no_links(spark):
    df = spark.createDataFrame([("k", None, "a"), ("k", "a", None), ("k", "a", "b"), ("k", "b", "a")], "kind string, child string, parent string")
    assert H.on_circles(df).count() == 2


def test_descendants(spark):
    got = {(r["ancestor"], r["descendant"]): r["distance"] for r in H.descendants(frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "d")])).collect()}
    assert got == {("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 1, ("d", "d"): 1}


def distances(edges):
    """(ancestor, descendant) to the length of the shortest way; on a circle a node is below itself."""
    up, found = {}, {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    for start in up:
        level, d, seen = {start}, 0, set()
        while level:
            d += 1
            level = {p for x in level for p in up.get(x, ())} - seen
            seen |= level
            found.update({(p, start): d for p in level})
    return found


@pytest.mark.parametrize("name", SHAPES)
def test_descendants_of_shapes(spark, name):
    got = {(r["ancestor"], r["descendant"]): r["distance"] for r in H.descendants(frame(spark, SHAPES[name])).collect()}
    assert got == distances(SHAPES[name])


@pytest.mark.parametrize("seed", range(3))
def test_descendants_at_random(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{i}", f"n{rnd.randrange(60)}") for i in range(60) if rnd.random() < 0.8] + [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(6 * seed)]
    rows = [(r["ancestor"], r["descendant"], r["distance"]) for r in H.descendants(frame(spark, edges)).collect()]
    assert len(rows) == len({r[:2] for r in rows}) and {r[:2]: r[2] for r in rows} == distances(edges)


def test_a_dense_core_makes_no_pairs(spark):
    rnd = random.Random(5)
    n = 20_000
    edges = [(f"n{i}", f"n{(i + 1) % n}") for i in range(n)] + [(f"n{i}", f"n{rnd.randrange(n)}") for i in range(n) for _ in range(2)] + [("tail", "n0"), ("n1", "top"), ("top", "higher")]
    got = {r["node"]: r["ring"] for r in H.on_circles(frame(spark, edges)).collect()}
    assert len(got) == n and len(set(got.values())) == 1 and "tail" not in got and "top" not in got


def test_base_names(spark):
    df = spark.createDataFrame([(" A[T] ",), ("pkg.B<Map<string, X>>",), ("C",), ("D [int]",)], "b string")
    assert [r[0] for r in df.select(H.base_name(F.col("b"))).collect()] == ["A", "pkg.B", "C", "D"]


def test_base_names_with_arguments_of_any_depth(spark):
    df = spark.createDataFrame([("Base[Dict[str, List[Tuple[int, int]]]]",), ("Base<() => void>",), ("Base<(cb: () => Foo<T>) => Map<a, b>>",), ("A" + "[x" * 12 + "]" * 12,), ("a.Outer<P<Q<R<S>>>>.Inner",), ("",), (None,)], "b string")
    assert [r[0] for r in df.select(H.base_name(F.col("b"))).collect()] == ["Base", "Base", "Base", "A", "a.Outer.Inner", "", None]
