"""Registered llm queries with SQL equal it on the small tables; the others run whole."""

import pytest

catalog = pytest.importorskip("barwright.llm.catalog")


def plain(rows):
    fix = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in found.fetchall()]
    assert plain([tuple(r[c] for c in names) for r in df.collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_covers_its_table(name, spark, sf_dir, duck):
    n = catalog.queries()[name](spark, sf_dir).count()
    want = {"op1_hilbert_ann": "SELECT 5 * count(*) FROM embeddings WHERE vec_id % 50 = 0"}.get(name, "SELECT count(*) FROM documents")
    assert n == duck.execute(want).fetchall()[0][0]
