import re

import pytest

from sparkloom.llm import repetition as R

TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|(?:(?![぀-ヿ㐀-鿿豈-﫿])\w)+")


def brute(text, n=5):
    text = re.sub(r"(?m)^[ \t>]*(?:\(?[0-9]{1,4}[.):]|[a-z][.)]|[-*+•])[ \t]+", "", text.lower())
    w = TOKEN.findall(text)
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    total = sum(map(len, w))
    return sum(len(x) for x, h in zip(w, hit) if h) / total if total else 0.0


TEXTS = [
    None, "", "   \n ", "one two", "one two three four five", "a b c d e a b c d e", "spam and more spam of eggs. " * 20, "The cat sat on the mat.\nthe  CAT sat on the mat!\n", "1. buy milk and some bread\n2. buy milk and some bread\n3) Buy milk and some bread",
    "发票检查67" * 30 + "结束", "The badge of a unit is red. The badge of a node is blue. The badge of a row is green.", "x " * 20_000, "alpha beta gamma delta epsilon zeta " * 2 + " ".join(f"w{i}" for i in range(100)),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in R.measure(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i]["repeated_share"] == pytest.approx(brute(t or ""), abs=1e-9), t
        assert got[i]["flagged"] == (brute(t or "") >= 0.4)
    assert not got[0]["flagged"] and not got[2]["flagged"] and got[6]["flagged"] and got[9]["flagged"] and not got[10]["flagged"]


def test_shares_of_lines(spark):
    df = spark.createDataFrame([(1, "same line here\nSame line here.\nother"), (2, "a\n\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.measure(df).collect()}
    assert got[1]["repeated_line_share"] == pytest.approx(14 / 33) and got[2]["repeated_line_share"] == 0


def test_no_python_in_the_plan(spark):
    plan = R.measure(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert R.measure(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_sentences_between_others(spark):
    unique = [" ".join(f"w{i}x{k}" for k in range(7)) for i in range(10)]
    lines = "\n".join(x for u in unique for x in (u, f"{len(u) % 3}. Nothing else to REPORT!", "nothing  else to report", "- nothing else to report."))
    spread = " ".join(f"{u}. So it goes." for u in unique)
    df = spark.createDataFrame([(1, lines), (2, spread), (3, "}\n" * 50 + "\n".join(unique))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.measure(df).collect()}
    assert got[1]["flagged"] and got[1]["repeated_unit_share"] > 0.6
    assert 0 < got[2]["repeated_unit_share"] < 0.4 and not got[2]["flagged"]
    assert got[3]["repeated_unit_share"] == 0 and not got[3]["flagged"]


def union_brute(text, n=5):
    """Share of word characters in repeated phrases of n words or in repeated shorter sentences and lines."""
    text = re.sub(r"(?m)^[ \t>]*(?:\(?[0-9]{1,4}[.):]|[a-z][.)]|[-*+•])[ \t]+", "", text.lower())
    w, ends, last = [], [], None
    for m in TOKEN.finditer(text):
        if last is not None:
            gap = text[last : m.start()]
            ends.append(bool(re.search(r"[\r\n。！？]", gap) or re.search(r"[.!?]", gap) and re.search(r"\s", gap)))
        w.append(m[0])
        last = m.end()
    ends.append(True)
    hit, seen, begin = [False] * len(w), set(), 0
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    for i in range(len(w)):
        if ends[i]:
            u = ("unit", *w[begin : i + 1])
            if i + 1 - begin < n:
                if u in seen:
                    hit[begin : i + 1] = [True] * (i + 1 - begin)
                seen.add(u)
            begin = i + 1
    total = sum(map(len, w))
    return sum(len(x) for x, h in zip(w, hit) if h) / total if total else 0.0


def test_the_union_of_all_that_was_said_before(spark):
    import random

    rng = random.Random(1)
    words = ["alpha", "beta", "größe", "x1", "der", "漢", "字", "It", "e.g", "foo_bar"]
    texts = [t or "" for t in TEXTS]
    for _ in range(150):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", ", ", "! ", ".", "\r\n- ", "。", "\n\n3) ", " . "]) for _ in range(rng.randrange(1, 60))))
    short = "\n".join(f"{' '.join(f'w{i}x{k}' for k in range(7))}\nNo more." for i in range(8))
    long = " ".join(["one two three four five six"] * 3)
    texts.append(short + "\n" + long)
    got = {r["doc_id"]: r for r in R.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["said_before_share"] == pytest.approx(union_brute(t), abs=1e-9), t


def test_shares_below_the_threshold_add_up(spark):
    unique = [" ".join(f"w{i}x{k}" for k in range(5)) for i in range(12)]
    lines = "\n".join(x for u in unique for x in (u, "All fine here."))
    phrases = " ".join(f"the very same long phrase of words {i}" for i in range(8))
    text = lines + "\n" + phrases
    r = R.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r["repeated_share"] < 0.4 and r["repeated_unit_share"] < 0.4 and r["said_before_share"] >= 0.4 and r["flagged"]


def test_bounds_of_length_and_symbols_decide(spark):
    df = spark.createDataFrame([(1, "word"), (2, "ok\nok"), (3, "=" * 500 + "\nok\n" + "=" * 500 + "\nok")], "doc_id long, text string")
    assert {r["doc_id"]: r["flagged"] for r in R.measure(df).collect()} == {1: False, 2: True, 3: False}


def test_long_runs_of_signs_and_blanks(spark):
    df = spark.createDataFrame([(1, " " * 300_000 + "a" + "-" * 300_000 + "b" + ". " * 200_000)], "doc_id long, text string")
    assert not R.measure(df).collect()[0]["flagged"]
