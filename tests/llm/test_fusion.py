import random

import pytest

from sparkloom.llm.fusion import list_ranks, reciprocal_rank_fusion, top


def brute(rows, names, k=60):
    best = {}
    for q, i, *s in rows:
        if q is None or i is None:
            continue
        old = best.setdefault((q, i), [None] * len(names))
        best[q, i] = [x if y is None or y != y else y if x is None else max(x, y) for x, y in zip(old, s)]
    out = {}
    for (q, i), s in best.items():
        total = 0.0
        for n, x in enumerate(s):
            if x is not None:
                total += 1 / (k + 1 + sum(1 for (q2, _), t in best.items() if q2 == q and t[n] is not None and t[n] > x))
        out[q, i] = total
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_against_brute_force(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.randrange(3), rnd.randrange(40), *[rnd.choice([None, float("nan"), rnd.randrange(6) * 1.0, rnd.random() * 1e6]) for _ in range(3)]) for _ in range(150)]
    rows += rows[:5] + [(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (2, 99, None, None, None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "q long, i long, a double, b double, c double, rrf string")
    got = {(r["q"], r["i"]): r["rrf"] for r in reciprocal_rank_fusion(df, "q", "i", ["a", "b", "c"], block=block).collect()}
    want = brute(rows, "abc")
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_scale_does_not_matter(spark):
    rows = [(1, i, float(i), 1e9 * i, 1.0 / (i + 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "q long, i long, a double, b double, c double")
    big = spark.createDataFrame([(q, i, a, b * 1e9, c) for q, i, a, b, c in rows], df.schema)
    one, two = (top(reciprocal_rank_fusion(x, "q", "i", ["a", "b", "c"]), "q", "i", 3).select("i", "position").collect() for x in (df, big))
    assert one == two and len(one) == 3


def test_blocks_give_the_same_ranks(spark):
    df = spark.createDataFrame([(1, float(i % 500)) for i in range(5000)], "g long, s double")
    plain = {r["s"]: r["rank"] for r in list_ranks(df, ["g"], "s").collect()}
    cut = {r["s"]: r["rank"] for r in list_ranks(df, ["g"], "s", block=20).collect()}
    assert plain == cut and plain[499.0] == 1 and plain[498.0] == 11


def test_empty(spark):
    df = spark.createDataFrame([], "q long, i long, a double")
    assert reciprocal_rank_fusion(df, "q", "i", ["a"]).count() == 0
