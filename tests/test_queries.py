"""Every registered query with an oracle equals it on the small tables."""

import math

import pytest

from barwright.plans import catalog


def plain(rows):
    fix = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = [tuple(r[columns.index(c)] for c in names) for r in found.fetchall()]
    assert sorted(columns) == names
    assert plain([tuple(r[c] for c in names) for r in df.collect()]) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_shuffle_for_signals_and_fold(spark, sf_dir):
    """Bars aggregate by symbol and time, then everything up to the trades shares one exchange by symbol."""
    df = catalog.trades(catalog._simulated(spark, sf_dir))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 2


def test_scan_reads_used_columns_only(spark, sf_dir):
    plan = catalog.bars_slice(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "PushedFilters: [IsNotNull(o_orderdate)" in plan


def test_random_search_draws_the_suggested_number(spark, sf_dir, monkeypatch):
    from barwright.plans import catalog

    drawn = []
    run = catalog.evaluate
    monkeypatch.setattr(catalog, "evaluate", lambda bars, combos, engine: drawn.append(combos.count()) or run(bars, combos, engine))
    catalog.QUERIES["random_search_top_k"](spark, sf_dir)
    assert drawn == [catalog.MA_SPACE.suggested_samples()] == [163]
