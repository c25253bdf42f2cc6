import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.splitting import IMBALANCE, boundaries, places, split, split_items

TEXTS = st.lists(st.sampled_from(["word ", "longerword ", "End. ", "\n", "\n\n", "# Head\n", "漢字。", "x" * 30, "\r\n", "a,b;"]), max_size=300).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([(40, 8), (100, 20), (64, 0), (10, 9)]))
def test_pieces(text, size):
    limit, overlap = size
    got = split(text, limit, overlap)
    assert "".join(text[f:e] for _, f, e in got) == text
    assert all(e - s <= limit and 0 <= f - s <= overlap for s, f, e in got)
    assert got[0][0] == got[0][1] == 0
    assert all(f < e for _, f, e in got) or not text
    assert overlap == 0 or all(s < f for s, f, _ in got[1:])
    for (_, _, end), (start, fresh, _) in zip(got, got[1:]):
        assert end == fresh and start <= fresh


def price(text, got, limit):
    cost = dict(zip(*map(list, boundaries(text))))
    return sum(IMBALANCE * (1 - (e - s) / limit) ** 2 + cost.get(e, 64.0) for s, _, e in got)


def brute(text, limit, overlap):
    at, cost, start = places(text, limit, min(overlap, limit - 1))
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            size = at[j] - (start[i] if i else 0)
            if size <= limit:
                best[j] = min(best[j], best[i] + IMBALANCE * (1 - size / limit) ** 2 + cost[j])
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([(40, 8), (100, 20), (64, 0), (300, 60), (10, 9)]))
def test_no_cuts_cost_less(text, size):
    limit, overlap = size
    if len(text) > limit:
        assert price(text, split(text, limit, overlap), limit) == pytest.approx(brute(text, limit, overlap))


def test_no_cuts_cost_less_at_the_real_limit():
    import random

    rng = random.Random(3)
    for _ in range(8):
        text = "".join(rng.choice(["word ", "longer-word ", "End. ", "\n", "\n\n", "# Head\n", "漢字。", "x" * 300]) for _ in range(rng.randrange(1200, 2500)))
        assert price(text, split(text), 4000) == pytest.approx(brute(text, 4000, 800))


def test_overlap_without_boundaries():
    got = split("x" * 10_000)
    assert got == [(0, 0, 3200), (2400, 3200, 6400), (5600, 6400, 9600), (8800, 9600, 10_000)]


def test_cuts_at_the_best_break():
    text = "a b c. " * 10 + "\n\n" + "d e f. " * 10
    (_, _, cut), _ = split(text, 80, 0)
    assert text[:cut].endswith("\n\n")
    (_, _, cut), *_ = split("w" * 50 + " " + "v" * 50, 60, 0)
    assert cut == 51


def test_exact_limit_stays_whole():
    assert split("x" * 4000) == [(0, 0, 4000)] and len(split("x" * 4001)) == 2


def test_very_long_text():
    got = split("lorem ipsum dolor. " * 60_000)
    assert max(e - s for s, _, e in got) <= 4000 and got[-1][2] == 60_000 * 19
    assert all(f - s > 700 for s, f, _ in got[1:])


def test_table(spark):
    rows = [("chunk", "a", '["H"]', "x y " * 1500, 1), ("chunk", "a", '["H"]', "x y " * 1500, 1), ("chunk", "b", None, "short", 2), ("entity", "c", "c", None, 3), ("entity", "d", "d", "é" * 4000, 4), ("entity", "e", "e", "é" * 4001, 5)]
    df = spark.createDataFrame(rows, "item_kind string, item_key string, context string, content string, start int").drop("start")
    got = split_items(df).collect()
    assert {(r["item_kind"], r["item_key"]) for r in got} == {("chunk", "a"), ("entity", "e")}
    assert "".join(r["content"][r["fresh"] - r["start"] :] for r in sorted(got, key=lambda r: r["piece"]) if r["item_key"] == "a") == "x y " * 1500
    assert all(r["context"] == '["H"]' for r in got if r["item_key"] == "a")
    assert split_items(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_texts_without_breaks(n):
    got = split("x" * (n * 4000 + 1), 4000, 800)
    assert all(e - s <= 4000 for s, _, e in got)
