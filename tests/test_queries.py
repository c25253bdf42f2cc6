"""Every core query equals its SQL on the smallest tables; those without SQL give rows of a stable schema."""

import pytest

from sparkloom import registry

SMALL = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(name, spark):
    df = registry.queries()[name](spark, SMALL)
    assert df.columns and df.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_subpackage():
    from pathlib import Path

    import sparkloom

    root = Path(sparkloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            text = f.read_text()
            assert "sparkloom.llm" not in text and "from .llm" not in text and "from ..llm" not in text, f


def test_the_core_stands_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; from sparkloom import registry; assert set(e.queries()) == set(registry.queries()); assert set(e.oracle_sql()) == set(registry.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)
    missing = code.replace("sys.modules['sparkloom.llm'] = None", "sys.modules['regex'] = None; sys.modules['xxhash'] = None")
    subprocess.run([sys.executable, "-c", missing.replace("==", ">=")], check=True, cwd=Path(__file__).parent.parent, timeout=120)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from sparkloom.errors import ConfigurationError
    from sparkloom.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None), conf=conf)
    with pytest.raises(ConfigurationError):
        shared_folder(far)


def test_cuts_are_removed(spark):
    import os

    from sparkloom.session import cut_folder, cut_lineage, forget_cuts

    cut_lineage(spark.range(3))
    at = cut_folder(spark).removeprefix("file:")
    assert os.listdir(at)
    forget_cuts(spark)
    assert not os.listdir(at) and cut_lineage(spark.range(3)).count() == 3
