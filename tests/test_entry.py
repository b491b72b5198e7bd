import duckdb

from tests.conftest import SF_SMALL

CHEAP = ["lang_distribution", "ner_route_counts", "title_valid", "dominant_lang_clusters", "embed_hash"]


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "sample_count" in df.columns


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.oracle_sql()) >= 40


def test_cheap_queries_match_oracle_at_small_scale(spark):
    import __spark_entry__ as e
    from tools.check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in CHEAP:
        a = e.queries()[name](spark, SF_SMALL).toPandas()
        b = con.sql(e.oracle_sql()[name]).df()
        assert compare(a, b) == "OK", name


def test_absent_parts_are_skipped_but_their_errors_are_not(tmp_path, monkeypatch):
    """The parts that may be deleted: a missing module is nothing, a broken one raises."""
    import sys

    import pytest

    import __spark_entry__ as e

    assert e._optional("tessera.no_such_part") is None
    (tmp_path / "broken_part.py").write_text("import no_such_library\n")
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    with pytest.raises(ModuleNotFoundError):
        e._optional("broken_part")
