import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.operators import attribution


def tables(spark, z, y, q, target, n_sec):
    n = len(z)
    edges = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(n) for j in range(n)], "i bigint, j bigint, value double")
    demand = spark.createDataFrame([(i, k, float(y[i, k])) for i in range(n) for k in range(y.shape[1])], "i bigint, k bigint, value double")
    account = spark.createDataFrame([(i, float(q[i])) for i in range(n)], "i bigint, value double")
    nodes = spark.createDataFrame([(i, i // n_sec, i % n_sec, i % n_sec in target) for i in range(n)], "i bigint, region bigint, sector bigint, is_target boolean")
    return edges, demand, account, nodes


def total(df):
    return df.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]


def test_two_nodes(spark):
    z, y = np.array([[0, 6.0], [3.0, 0]]), np.array([[9.0], [9.0]])
    edges, demand, account, nodes = tables(spark, z, y, np.array([15.0, 0.0]), {0}, 2)
    a, demand, d, x = attribution.prepare(edges, demand, account)
    assert rows(x) == [(0, 15.0), (1, 12.0)]
    assert rows(a) == [(0, 1, 0.5), (1, 0, 0.2)]
    kw = {"tolerance": 1e-9}
    assert np.isclose(total(attribution.direct_slot(a, demand, nodes, d, **kw)), 10)
    assert np.isclose(total(attribution.indirect_slot(a, demand, nodes, d, **kw)), 5)
    assert total(attribution.remaining(a, demand, nodes, d, **kw)) == 0


def test_matches_dense_solution(spark):
    rng = np.random.default_rng(2)
    n_reg, n_sec, target = 2, 3, {1}
    n = n_reg * n_sec
    z, y, q = rng.random((n, n)), rng.random((n, n_reg)) * 12, rng.random(n)
    z[0] *= 6
    edges, demand, account, nodes = tables(spark, z, y, q, target, n_sec)
    a, demand, d, x = attribution.prepare(edges, demand, account)
    dense_x = z.sum(1) + y.sum(1)
    m, dd = z / dense_x, q / dense_x
    t = [i for i in range(n) if i % n_sec in target]
    o = [i for i in range(n) if i % n_sec not in target]
    full, inner = np.linalg.inv(np.eye(n) - m), np.linalg.inv(np.eye(len(o)) - m[np.ix_(o, o)])
    kw, tol = {"tolerance": 1e-10}, 1e-8
    direct = np.zeros((n, n_reg))
    indirect = np.zeros((n, n_sec, n_reg))
    for s in target:
        cols = [i for i in t if i % n_sec == s]
        direct += dd[:, None] * full[:, cols] @ y[cols]
        step = dd[:, None] * full[:, cols] @ m[np.ix_(cols, o)] @ inner
        for pos, node in enumerate(o):
            indirect[:, node % n_sec] += step[:, [pos]] @ y[[node]]
    got = attribution.direct_slot(a, demand, nodes, d, **kw).collect()
    for r in got:
        assert np.isclose(r["value"], direct[r["preg"] * n_sec + r["psec"], r["k"]], rtol=tol) and r["fssec"] == r["tsec"]
    for r in attribution.indirect_slot(a, demand, nodes, d, **kw).collect():
        assert np.isclose(r["value"], indirect[r["preg"] * n_sec + r["psec"], r["fssec"], r["k"]], rtol=tol)
    supply = attribution.others_supply(a, demand, nodes, **kw)
    rest = attribution.remaining(a, demand, nodes, d, supply)
    verdict = attribution.balance(attribution.footprints(a, demand, nodes, d, supply, **kw), rest, d, x).first()
    assert verdict["ok"] and verdict["rel_error"] < 1e-9 and np.isclose(verdict["expected"], q.sum())


def solved(spark, coefficients, start, rhs=(), **kw):
    a = spark.createDataFrame(coefficients, "i bigint, j bigint, a double")
    b = spark.createDataFrame(start, "i bigint, " + "".join(f"{r} string, " for r in rhs) + "v double")
    return {tuple(r)[:-1]: r["v"] for r in attribution.series(a, b, list(rhs), **kw).select("i", *rhs, "v").collect()}


def test_slow_series_are_exact_after_few_rounds(spark):
    for a in (0.99, 0.9999):
        got = solved(spark, [(0, 1, a), (1, 0, a)], [(0, 1.0)], max_rounds=24)
        assert np.isclose(sum(got.values()), 1 / (1 - a), rtol=1e-9)
        assert np.isclose(got[0,], 1 / (1 - a * a), rtol=1e-9)


def test_growing_series_raises_and_names_its_right_hand_side(spark):
    with pytest.raises(attribution.NotConverged, match="'k': 'bad'"):
        solved(spark, [(0, 0, 1.01), (1, 1, 0.5)], [(1, "good", 1.0), (0, "bad", 1.0)], ["k"], max_rounds=32)
    with pytest.raises(attribution.NotConverged, match="block 1"):
        solved(spark, [(0, 0, 0.5), (10, 10, 1.0)], [(0, 1.0), (10, 1.0)], max_rounds=16, block=F.floor(F.col("i") / 10))


@pytest.mark.parametrize(("sizes", "named"), [((1e15, 1.0), False), ((1e9, 1e-3), True), ((1.0, 1e15), True)])
def test_blocks_do_not_hide_each_other(spark, sizes, named):
    kw = {"block": F.col("i")} if named else {}
    got = solved(spark, [(1, 1, 0.1), (2, 2, 0.99)], [(1, sizes[0]), (2, sizes[1])], **kw)
    assert np.isclose(got[1,], sizes[0] / 0.9, rtol=1e-9) and np.isclose(got[2,], sizes[1] * 100, rtol=1e-9)


def test_right_hand_sides_do_not_hide_each_other(spark):
    """More of them than lanes, of all sizes, some of them negative, on a network with slow and fast parts."""
    rng = np.random.default_rng(7)
    n, k = 12, 21
    m = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    m[:6, 6:] = m[6:, :6] = 0
    m[:6, :6] *= 0.97 / max(abs(np.linalg.eigvals(m[:6, :6])))
    m[6:, 6:] *= 0.2 / max(abs(np.linalg.eigvals(m[6:, 6:])))
    b = rng.random((n, k)) * (rng.random((n, k)) < 0.3) * 10.0 ** rng.integers(-9, 9, k)
    b[:, ::5] *= rng.choice([-1, 1], (n, len(range(0, k, 5))))
    want = np.linalg.solve(np.eye(n) - m, b)
    a = [(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
    start = [(i, str(c), float(b[i, c])) for i in range(n) for c in range(k) if b[i, c]]
    got = solved(spark, a, start, ["k"])
    for c in range(k):
        column = np.array([got.get((i, str(c)), 0.0) for i in range(n)])
        assert np.allclose(column, want[:, c], rtol=1e-9, atol=1e-9 * abs(want[:, c]).max())


def test_chain_is_summed_to_its_end(spark):
    got = solved(spark, [(i + 1, i, 0.5) for i in range(30)], [(0, 1.0)])
    assert np.allclose([got[i,] for i in range(31)], 0.5 ** np.arange(31), rtol=1e-12)


def test_blocks_of_a_network(spark):
    ways = [(i, i + 1) for i in range(40)] + [(101, 100), (102, 101), (200, 200)]
    a = spark.createDataFrame([(*w, 0.1) for w in ways], "i bigint, j bigint, a double")
    got = dict(rows(attribution.network_blocks(a), "i", "_block"))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_producer_groups_match_the_full_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n_reg, n_sec = 3, 4
    n = n_reg * n_sec
    edges, demand, account, nodes = tables(spark, rng.random((n, n)), rng.random((n, 7)) * 12, rng.random(n), {1, 2}, n_sec)
    a, demand, d, _ = attribution.prepare(edges, demand, account)
    full = attribution.footprints(a, demand, nodes, d)
    rest = attribution.remaining(a, demand, nodes, d)
    want = rows(full.groupBy((F.col("preg") % 2).alias("g"), "tsec", "fssec", "k", "slot").agg(F.sum("value").alias("value")))
    want_rest = rows(rest.groupBy((F.col("preg") % 2).alias("g"), "fssec", "k").agg(F.sum("value").alias("value")))
    sides = []
    plain = attribution.series

    def counted(coefficients, start, rhs, **kw):
        sides.append(start.select(*rhs).distinct().count())
        return plain(coefficients, start, rhs, **kw)

    monkeypatch.setattr(attribution, "series", counted)
    producers = d.join(nodes.select("i", (F.col("region") % 2).alias("g")), "i")
    target, remaining = attribution.footprints_by_producer(a, demand, nodes, producers, ["g"])
    got = rows(target, "g", "tsec", "fssec", "k", "slot", "value")
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=1e-9)
    got = rows(remaining, "g", "fssec", "k", "value")
    assert [r[:-1] for r in got] == [r[:-1] for r in want_rest] and np.allclose([r[-1] for r in got], [r[-1] for r in want_rest], rtol=1e-9)
    # Two groups, and two groups times two targets and the rest: the seven consumers and four sectors never meet a coefficient.
    assert sides == [2, 6]


def test_target_union_and_unknown():
    groups = {"a": [1, 2], "b": [2, 5]}
    assert attribution.target_sectors(groups) == [1, 2, 5]
    with pytest.raises(KeyError):
        attribution.target_sectors(groups, ["c"])


def test_zero_output_counts_as_one(frame):
    edges = frame([(0, 1, 2.0), (1, 0, -3.0)], "i bigint, j bigint, value double")
    out = frame([(0, 4.0), (1, 0.0)], "i bigint, x double")
    assert rows(attribution.technical_coefficients(edges, out)) == [(0, 1, 2.0)]


def test_demand_groups(frame):
    d = frame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 4.0)], "i bigint, k bigint, value double")
    assert rows(attribution.demand_groups(d, "all"), "k", "value") == [("all", 7.0)]
    assert rows(attribution.demand_groups(d, {"x": [0, 1], "y": "all"}), "k", "value") == [("x", 3.0), ("y", 7.0)]


def test_dashboard_skips_tiny_and_unknown(frame):
    f = frame([(2000, 0, 0, 1, 1, 5, 0, 2.0), (2000, 0, 0, 1, 2, 5, 1, 3.0), (2000, 1, 0, 1, 1, 5, 0, 1e-12), (2000, 0, 9, 1, 1, 5, 0, 7.0)], "year int, preg int, psec int, tsec int, fssec int, k int, slot int, value double")
    crops = frame([(0, "grain")], "sector int, crop string")
    targets = frame([(1, "food")], "sector int, target_sector string")
    regions = frame([(0, "EU")], "region int, region_group string")
    out = rows(attribution.dashboard(f, crops, targets, regions), "production_country", "consumption_country", "impact_type", "value")
    assert out == [("EU", "Unknown", "direct", 2.0), ("EU", "Unknown", "indirect", 3.0), ("EU", "Unknown", "total", 5.0)]
