"""Values at ranks, held to numpy, with limits so small that every pass is taken."""

import math

import numpy as np
import pytest

from palisade.operators import audit, ranks

SCHEMA = "g string, v double"


def _data():
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 3, 150)] + [("hot", 2.5)] * 90
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 60)] + [("one", 7.0), (None, 1.0), (None, 4.0), ("nothing", None)]
    rows += [("wide", x) for x in (-math.inf, -1.7e308, -1e-320, 0.0, 5e-324, 1e-300, 3.0, 1.7e308, math.inf)]
    return rows


@pytest.fixture(params=[(16, 2), (1024, 4096)])
def limits(request, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", request.param[0])
    monkeypatch.setattr(ranks, "FEW", request.param[1])


def test_many_groups_by_brute_force(spark, limits):
    rows = [r for r in _data() if r[0] != "wide"]
    got = {(r["g"], r["name"]): r["value"] for r in audit.percentiles_by(spark.createDataFrame(rows, SCHEMA), ["g"], "v").collect()}
    groups = {g for g, v in rows if v is not None}
    assert {g for g, _ in got} == groups and len(got) == 4 * len(groups)
    for g in groups:
        v = sorted(x for k, x in rows if k == g and x is not None)
        for name, p in audit.SHARES.items():
            assert math.isclose(got[g, name], np.quantile(v, p), rel_tol=1e-12)
        assert got[g, "nearest_p95"] == v[int(0.95 * (len(v) - 1))] and got[g, "upper_median"] == v[len(v) // 2]


def test_every_rank_of_a_wide_range(spark, limits):
    v = sorted(x for g, x in _data() if g == "wide")
    places = {str(k): lambda n, k=k: n - n + k for k in range(len(v))}
    found = ranks.at_ranks(spark.createDataFrame([("a", x) for x in [*v, math.nan]], SCHEMA), "v", {**places, "last": lambda n: n - 1})
    got = {r["name"]: r["value"] for r in found.collect()}
    assert [got[str(k)] for k in range(len(v))] == v and math.isnan(got["last"])


def test_other_types_and_empty_tables(spark):
    longs = spark.range(5).selectExpr("cast(9007199254740993 + id as bigint) as v")
    assert {r["name"]: r["value"] for r in audit.nearest_ranks(longs, "v").collect()} == {"nearest_p95": 9007199254740996, "upper_median": 9007199254740995}
    none = spark.createDataFrame([(None, None)], SCHEMA)
    assert audit.nearest_ranks(none, "v").count() == 0 and audit.percentiles(none, "v").first().asDict() == {"median": None, "p95": None}


def test_no_group_is_sorted_or_gathered_as_a_whole(spark):
    plan = audit.percentiles_by(spark.createDataFrame(_data(), SCHEMA), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "percentile(" not in plan
