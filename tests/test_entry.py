import __spark_entry__ as entry


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.queries()["fts_bm25_topk"] is not None
