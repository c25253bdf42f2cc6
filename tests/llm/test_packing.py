import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.packing import first_fit_decreasing, pack


def plain(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if k is None:
            k = len(room)
            room.append(capacity)
        room[k] -= sizes[i]
        out[i] = k
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_equals_plain_first_fit(sizes):
    assert first_fit_decreasing(np.array(sizes, np.int64), 50).tolist() == plain(sizes, 50)


def test_table(spark):
    rows = [(i, 1 + i * 37 % 900, "x") for i in range(3000)] + [(5000, 5000, "x"), (5001, 2048, "x"), (5002, None, "x"), (5003, 0, "x"), (5004, 4096, "x"), (7, 100, "again")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece string").drop("piece")
    got = pack(df, "doc_id", "n_tokens", 2048, 500).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 2048
    assert got.n_tokens.sum() == sum(r[1] or 0 for r in rows)
    assert sorted(got[got.doc_id == 5000].n_tokens) == [904, 2048, 2048] and sorted(got[got.doc_id == 5000].token_offset) == [0, 2048, 4096]
    assert len(got[got.doc_id == 5004]) == 2 and len(got[got.doc_id == 7]) == 2 and not len(got[got.doc_id.isin([5002, 5003])])
    assert (got.groupby("doc_id").size()[got.groupby("doc_id").n_tokens.sum() <= 900] <= 2).all()
    assert got.n_tokens.sum() / (got.container_id.nunique() * 2048) > 0.97
    assert pack(df.limit(0), "doc_id", "n_tokens").count() == 0
