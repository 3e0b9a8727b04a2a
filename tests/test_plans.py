"""Every plan with SQL against DuckDB, over the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from brute import BRUTE

from lingualoom import plans

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cell, r)) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_against_brute_force(spark, name):
    shown = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got, want = shown(plans.queries()[name](spark, DATA).collect()), shown(BRUTE[name]())
    assert got and got == want


def test_every_query_is_held_against_something():
    assert set(plans.queries()) == set(plans.oracle_sql()) | set(BRUTE) | {"mixed_model_summary"}


def test_mixed_model_query_against_a_grid(spark, duck):
    """Posterior means by sums over a grid of deviations, from the rows' own design."""
    t = duck.sql("SELECT l_discount, ln(l_quantity) AS q, l_returnflag AS f, l_linenumber AS k FROM lineitem").df()
    y, n = t.l_discount.to_numpy(), len(t)
    one = lambda c: np.eye(c.nunique())[c.astype("category").cat.codes]
    x = np.column_stack([np.ones(n), t.q - t.q.mean()])
    w = np.column_stack([x, one(t.f), one(t.k)])
    cross, wy, yy, sizes = w.T @ w, w.T @ y, y @ y, (t.f.nunique(), t.k.nunique())
    total, slope, effect = 0.0, 0.0, 0.0
    grid = np.exp(np.linspace(np.log(1e-6), np.log(2), 60))
    best = None
    for sigma in np.linspace(0.97, 1.03, 13) * y.std():
        for a in grid:
            for b in grid:
                prior = np.r_[25.0, 0.01, np.full(sizes[0], a * a), np.full(sizes[1], b * b)]
                inner = np.diag(1 / prior) + cross / sigma**2
                mean = np.linalg.solve(inner, wy) / sigma**2
                log = -n * np.log(sigma) - 0.5 * (np.log(prior).sum() + np.linalg.slogdet(inner)[1] + yy / sigma**2 - wy @ mean / sigma**2) - a - b - sigma
                log += np.log(a) + np.log(b)  # the grid is even in logarithms
                best = log if best is None else best
                v = np.exp(log - best)
                total, slope, effect = total + v, slope + v * mean[1], effect + v * b
    got = {r.parameter: r for r in plans.queries()["mixed_model_summary"](spark, DATA).collect()}
    assert len(got) == 2 + sizes[0] + sizes[1] + 3
    assert got["b_log_quantity"]["mean"] == pytest.approx(slope / total, abs=2e-4)
    assert got["sigma"]["mean"] == pytest.approx(y.std(), rel=0.01)
    assert got["sd_l_linenumber__intercept"]["mean"] == pytest.approx(effect / total, rel=0.25, abs=2e-4)
    assert all(r.rhat < 1.1 for r in got.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(plans.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_part(tmp_path, also):
    home, left = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "left"
    shutil.copytree(home, left, ignore=lambda at, names: {n for n in names if n in ("llm", ".git", *also)})
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=left, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
