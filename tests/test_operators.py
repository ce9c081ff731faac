from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import curves as C
from tessera.operators import layout as L
from tessera.operators import mail as M
from tessera.operators import parts as P
from tessera.operators import resolve as E
from tessera.operators import retrieval as R
from tessera.operators import tables as B
from tessera.plans import numeric
from tests.conftest import SMALL, rows


def test_threshold_keeps_one(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.3, 2), (1, 3, 0.2, 1), (1, 4, 0.1, 2)], "query_id int, vec_id int, score double, rank int")
    assert rows(R.threshold(df, 0.4).select("vec_id"), "vec_id") == [(1,), (3,)]


def test_dedup_and_limits(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 7), (0, 2, 0.5, 7), (0, 3, 0.5, 8), (0, 4, 0.4, None)], "query_id int, vec_id int, score double, w int")
    found = R.top_k(R.dedup(df, "w"), 2)
    assert rows(found.select("vec_id", "rank"), "rank") == [(1, 1), (3, 2)]
    assert R.top_k(df, -1).count() == 0


def test_context_budget(spark):
    df = spark.createDataFrame([(0, 1, 5, "a"), (0, 2, 3, "b"), (0, 3, 9, "c"), (0, 4, 1, "d")], "query_id int, rank int, n int, text string")
    assert rows(R.context(df, "n", 8)) == [(0, "a\n\nb", 2)]
    assert rows(R.context(df, "n", 2)) == [(0, "a", 1)]
    assert rows(R.context(df, "n", 0)) == [(0, "")]


def test_diverse_matches_plain_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ np.array([0.5, -0.5, 0.5, 0.3, 0.4, 0.1])
    order = np.argsort(-s, kind="stable")
    df = spark.createDataFrame([(0, int(i), float(s[i]), k + 1, [float(x) for x in v[i]]) for k, i in enumerate(order)], "query_id long, vec_id long, score double, rank int, embedding array<double>")
    got = [r[0] for r in rows(R.diverse(df, 6, 0.5).orderBy("pick").select("vec_id"))]
    picked = []
    for _ in range(6):
        best = max((i for i in order if i not in picked), key=lambda i: s[i] if not picked else 0.5 * s[i] - 0.5 * max(v[i] @ v[j] for j in picked))
        picked.append(int(best))
    assert got == picked


def newton_loop(k_eta, k_phi, if_max, start, fiv, fil):
    """The solver for one row, step by step."""
    poly = lambda c, x: sum(a * x**i for i, a in enumerate(c))
    slope = lambda c, x: sum(a * i * x ** (i - 1) for i, a in enumerate(c) if i)
    f = lambda x: k_eta * x / 1000 * poly(fiv, x) - k_phi * (poly(fil, x) or 1.0)
    x, done = start, False
    if not (k_eta > 0 and k_phi > 0 and if_max > 0):
        return x, False
    for _ in range(100):
        v = f(x)
        if abs(v) < 1e-4:
            done = True
            break
        d = k_eta * (poly(fiv, x) / 1000 + x / 1000 * slope(fiv, x)) - k_phi * slope(fil, x)
        t = x - v / (d if abs(d) >= 1e-10 else 1e-10)
        x = x + 5 if t < 0 or t > if_max else t
        if x > if_max:
            x = if_max
            break
    return x, done or (x >= if_max and f(if_max) <= 1e-4)


def test_newton_matches_loop():
    rng = np.random.default_rng(1)
    n = 200
    k_eta, k_phi, if_max, start = rng.uniform(-5, 200, n), rng.uniform(50, 200, n), rng.uniform(0, 900, n), rng.uniform(1, 300, n)
    fiv, fil = np.column_stack([rng.uniform(2, 3, n), rng.uniform(0, 0.003, n)]), np.column_stack([rng.uniform(0, 0.1, n), rng.uniform(0.005, 0.012, n), rng.uniform(-8e-6, 0, n)])
    x, ok, _ = P.newton(k_eta, k_phi, if_max, start, fiv, fil)
    for i in range(n):
        a, b = newton_loop(k_eta[i], k_phi[i], if_max[i], start[i], fiv[i], fil[i])
        assert ok[i] == b and math.isclose(x[i], a, rel_tol=1e-9)


def test_bisecting_newton():
    root, ok = P.newton_bisect(lambda x: x**3 - 2, lambda x: 3 * x * x, 0, 5, 4)
    assert ok and abs(root - 2 ** (1 / 3)) < 1e-4
    assert P.newton_bisect(lambda x: x * x + 1, lambda x: 2 * x, -1, 3, 0)[1] is False


def test_topologies_match_loop(spark):
    cases = [(n, vf, vmax) for n in (0, 1, 2, 7, 40) for vf in (0.0, 3.0, 26.0) for vmax in (50.0, 9.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, vf double, vmax double")
    found = dict(df.select("i", P.topologies(F.col("n"), F.col("vf"), F.col("vmax"))).collect())
    for i, (n, vf, vmax) in enumerate(cases):
        wanted = []
        if n > 0 and vf > 0 and (s_max := int(vmax // vf)) >= 2:
            p = math.ceil(n / s_max)
            while len(wanted) < 5:
                wanted.append((p, math.ceil(n / p)))
                p += 1
                if p > n:
                    break
        assert [(w["P"], w["S"]) for w in found[i]] == wanted


def layouts_loop(style, pw, pl, mult, c):
    out, best = [], 0
    ub = lambda m, i, g: 0 if i <= 0 else max(0, math.floor((m + g) / (i + g)))
    for br, sr in itertools.product([False, True], [False, True]):
        cw, cl, ew, el = (c["board_l"], c["board_w"], c["edge_l"], c["edge_w"]) if br else (c["board_w"], c["board_l"], c["edge_w"], c["edge_l"])
        sw, sl = (c["single_l"], c["single_w"]) if sr else (c["single_w"], c["single_l"])
        iw, il = cw - 2 * ew, cl - 2 * el
        for nw, nl in itertools.product(range(1, ub(iw, sw, c["gap_single_w"]) + 1), range(1, ub(il, sl, c["gap_single_l"]) + 1)):
            gw, gl = nw * sw + (nw - 1) * c["gap_single_w"], nl * sl + (nl - 1) * c["gap_single_l"]
            bw, bl = gw + 2 * ew, gl + 2 * el
            ubw, ubl = ub(pw - 2 * c["margin_w"], bw, c["gap_board_w"]), ub(pl - 2 * c["margin_l"], bl, c["gap_board_l"])
            if not ubw or not ubl or ubw * ubl * nw * nl * mult < best:
                continue
            for a, b in itertools.product(range(1, ubw + 1), range(1, ubl + 1)):
                fits = ew + (nw - 1) * (sw + c["gap_single_w"]) + sw <= bw and el + (nl - 1) * (sl + c["gap_single_l"]) + sl <= bl
                if fits:
                    best = max(best, a * b * nw * nl * mult)
                out.append((style, br, sr, nw, nl, a, b))
    return out


def test_layouts_match_search(spark):
    styles = [("A1", 520.0, 410.0, 4), ("B2", 610.0, 520.0, 2)]
    df = spark.createDataFrame(styles, "style string, panel_w double, panel_l double, multiplier int")
    got = rows(L.enumerate_layouts(df, numeric.BOARD).select("style", "board_rot", "single_rot", "nw", "nl", "nbw", "nbl"))
    wanted = [r for s in styles for r in layouts_loop(*s, numeric.BOARD)]
    assert sorted(got) == sorted(wanted)


def test_sweep_evaluates_each_point_once(spark):
    """The curves are evaluated once a point, in arrays; odd coefficients and currents have the results that they had."""
    kind = "id int, lm_test double, if_max double, fiv array<double>, fil array<double>, ftl array<double>, ftv array<double>"
    good = ([2.6, 0.0012], [0.02, 0.0098, -0.000004], [1.0], [1.0])
    rows_ = spark.createDataFrame(
        [(1, 130.0, 500.0, *good), (2, 130.0, 500.0, [2.6, None, 0.0], *good[1:]), (3, 130.0, 500.0, None, *good[1:]), (4, 130.0, 500.0, [float("nan")], *good[1:]), (5, 130.0, 0.0, *good), (6, None, 500.0, *good)], kind
    )
    out = P.sweep(rows_, 330.0, 65.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lambda x_") < 30
    got = {r["id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 6]
    for i, fiv in ((1, (2.6, 0.0012)), (2, (2.6,))):
        f = lambda x: 330 * (x / 1000) * sum(c * x**k for k, c in enumerate(fiv)) - 130 * (0.02 + 0.0098 * x - 0.000004 * x * x)  # noqa: B023, E731
        at = [10 ** (-3 + k * (math.log10(500) + 3) / 599) for k in range(600)]
        assert got[i]["sign_change"] == any(f(a) * f(b) <= 0 for a, b in zip(at, at[1:], strict=False))
        assert math.isclose(got[i]["nearest_if"], min(at, key=lambda x: abs(f(x)))) and math.isclose(got[i]["greatest_f"], max(map(f, at)))
        assert got[i]["root"] is None or abs(f(got[i]["root"])) < 1e-6
    for i in (3, 4):  # no number anywhere counts as 0, so the first two points have a change of sign
        assert got[i]["sign_change"] and got[i]["greatest_f"] == 0 and math.isclose(got[i]["root"], 0.001)
    assert got[6]["greatest_f"] > 0


def test_sweep_agrees_with_the_solver(spark):
    rows_ = numeric.catalogue(spark, SMALL)
    solved = {r["id"]: r for r in P.solve(rows_, 330.0, 20000.0, 65.0).collect()}
    swept = {r["id"]: r for r in P.sweep(rows_, 330.0, 65.0).collect()}
    both = [i for i, r in swept.items() if r["root"] is not None and solved[i]["converged"] and solved[i]["target_if"] < solved[i]["if_max"]]
    assert len(both) > 20 and all(abs(swept[i]["root"] - solved[i]["target_if"]) < 0.05 for i in both)
    none = rows_.limit(3).withColumn("if_max", F.lit(0.0))
    assert P.sweep(none, 120.0, 65.0).count() == 0
    bare = rows_.limit(1).withColumns({c: F.lit(None).cast("array<double>") for c in ("fiv", "ftv", "ftl")})
    assert P.solve(bare, 120.0, 20000.0, 65.0).first()["vf_at_target"] == 3.0


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (1, 1, 1.0, 1.0, 3.0, 3.0), (1, 2, 3.0, 0.0, 4.0, 1.0)], "k int, i int, x0 double, y0 double, x1 double, y1 double")
    assert rows(L.overlapping(df, "k")) == [(1, 0, 1)]


def test_fits(spark):
    xs = np.linspace(0, 3, 40)
    points = [("a", float(x), float(1 + 2 * x + 0.5 * x * x)) for x in xs] + [("b", 1.0, 2.0)]
    df = spark.createDataFrame(points, "curve string, x double, y double")
    got = {r["curve"]: r for r in C.fit(df, "curve", gated=True).collect()}
    assert got["a"]["status"] == "pass" and got["b"]["status"] == "fail"
    low = C.choose_lowest([{"degree": 3, "rmse": 1.00}, {"degree": 2, "rmse": 1.04}, {"degree": 1, "rmse": 1.20}])
    assert low["degree"] == 2
    y = 2 + 3 * xs
    y[5] += 500
    assert np.allclose(C.robust(xs, y, 1), [2, 3], atol=0.2)
    assert C.robust(xs[:10], y[:10], 1) is None


def test_fits_agree_with_numpy(spark):
    """All degrees, far from the origin, with repeated x, noise, few points, missing values; a hot curve is never one group."""
    rng = np.random.default_rng(1)
    curves = {
        "far": (np.linspace(1000, 1010, 300), lambda x: 3 + 0.5 * (x - 1005) ** 3), "noise": (rng.uniform(-2, 5, 500), lambda x: np.sin(x) + rng.normal(0, 0.1, len(x))),
        "repeats": (rng.integers(0, 9, 400).astype(float), lambda x: x**2), "few": (np.array([0.0, 1, 2, 2]), lambda x: x), "skew": (rng.exponential(1, 800), lambda x: np.exp(-x)),
    }
    points, made = [], {}
    for name, (x, f) in curves.items():
        made[name] = (x, f(x))
        points += [(name, float(a), float(b)) for a, b in zip(*made[name], strict=True)]
    df = spark.createDataFrame([*points, ("few", None, 1.0), ("few", float("nan"), 1.0), ("none", None, 2.0)], "curve string, x double, y double")
    for d in (1, 2, 6):
        got = {r["curve"]: r for r in C.fit(df, "curve", least=d, most=d).collect()}
        for name, (x, y) in made.items():
            if len(np.unique(x)) <= d:
                assert got[name]["status"] == "fail" and got[name]["coefficients"] is None
                continue
            fine = np.polynomial.Polynomial.fit(x, y, d)
            at = np.linspace(x.min(), x.max(), 7)
            said = np.polynomial.Polynomial(got[name]["coefficients"])
            tolerance = 1e-6 * max(1, abs(np.asarray(got[name]["coefficients"]) * np.abs(x).max() ** np.arange(d + 1)).max() * 1e-8)
            assert np.allclose(said(at), fine(at), rtol=1e-6, atol=max(tolerance, 1e-6))
            assert np.isclose(got[name]["rmse"], np.sqrt(((y - fine(x)) ** 2).mean()), rtol=1e-6, atol=1e-9)
        assert got["none"]["status"] == "fail"
    plan = C.fit(df, "curve")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


def test_resample(spark):
    rng = np.random.default_rng(3)
    many = np.sort(rng.uniform(5, 6, 500))
    curves = {"a": ([0.0, 1.0, 3.0], [0.0, 2.0, 0.0]), "b": (many, many**2), "one": ([2.0], [7.0])}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, v in curves.items() for x, y in zip(*v, strict=True)], "k string, x double, y double")
    made = C.resample(df, "k", 50)
    for k, (x, y) in curves.items():
        got = [tuple(r) for r in made.where(F.col("k") == k).orderBy("i").select("x", "y").collect()]
        assert len(got) == 50 and np.allclose([v for _, v in got], np.interp([u for u, _ in got], x, y))


def test_runs_and_fills(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, "x")], "k string, t int, v string")
    assert rows(B.runs(df, "k", "t", "v").select("run", "first", "last", "n"), "run") == [(1, 1, 2, 2), (2, 3, 3, 1), (3, 4, 4, 1)]
    assert [r[2] for r in rows(B.forward_fill(df, "k", "t", ["v"]).select("k", "t", "v"), "t")] == ["x"] * 4
    with pytest.raises(ValueError, match="differ"):
        B.upsert(df, df.drop("v"), ["k"])


def test_latest_dated(spark):
    df = spark.createDataFrame([("n_240101.md",), ("n_240301.md",), ("m_231231.md",), ("n.md",)], "name string")
    assert rows(B.latest_dated(df), "prefix") == [("m", "m_231231.md", "231231"), ("n", "n_240301.md", "240301")]


def test_resolve(spark):
    inputs = spark.createDataFrame([(1, "ACME Corp."), (2, "zzz"), (3, "Bolt 5")], "input_id int, value string")
    records = spark.createDataFrame([(10, "Acme Corp"), (11, "Acme Corp Asia"), (12, "bolt-5"), (13, None)], "id int, name string")
    assert rows(E.resolve(inputs, records, ["name"]), "input_id") == [(1, 10), (2, None), (3, 12)]


def brute_match(value: str, names: dict[int, str]) -> tuple[int, set[int]]:
    """Size and records of the first substring, the longest first and from the left, that a record holds."""
    text = value.strip().lower()
    for size in range(len(text), 0, -1):
        for at in range(len(text) - size + 1):
            like = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text[at : at + size]), re.S)
            if found := {i for i, n in names.items() if any(c.isalnum() for c in n) and like.search(n.lower())}:
                return size, found
    return 0, set()


def test_longest_match(spark):
    """Typos, wildcards, patterns, blanks and other scripts against every substring in turn."""
    rng = random.Random(2)
    names = {i: "".join(rng.choice("abc -É5") for _ in range(rng.randint(0, 9))) for i in range(60)} | {90: "a\\Eb[x", 91: "a\nb", 92: "--"}
    values = ["".join(rng.choice("ABc -é5%_x") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["%", "__", "_" * 40, "%a%", " \u3000 ", "A\\eB[", "a_b", "zzz", "a%x"]
    inputs = spark.createDataFrame(list(enumerate(values)), "input_id int, value string")
    records = spark.createDataFrame([*names.items(), (99, None)], "id int, name string")
    found: dict[int, tuple[int, set[int]]] = {}
    for r in E.longest_match(inputs, records, "name").collect():
        found.setdefault(r["input_id"], (r["size"], set()))[1].add(r["id"])
    assert {i: found.get(i, (0, set())) for i in range(len(values))} == {i: brute_match(v, names) for i, v in enumerate(values)}


def test_longest_match_of_long_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcd") for _ in range(10_000))
    inputs = spark.createDataFrame([(1, "Q" + long[2000:9000] + "Q"), (2, "q" * 10_000)], "input_id int, value string")
    records = spark.createDataFrame([(1, long), (2, long[:3000]), (3, "ab")], "id int, name string")
    assert rows(E.longest_match(inputs, records, "name").select("input_id", "id", "size")) == [(1, 1, 7000)]


def test_similar_names_cost_no_pairs(spark):
    """What is looked up grows with the names: the rows that meet for twice as many names are twice as many or so."""
    def met(n: int) -> int:
        names = spark.createDataFrame([(f"common part of the name {i:04d} ltd",) for i in range(n)], "name string")
        asked = E._pieces(names.withColumn("text", F.regexp_replace("name", "of", "off")), "text", F.lit(16), "text")
        return E._matched(asked, names, 40).count()

    assert met(400) <= 2.2 * met(200)


def test_numbered_over_the_whole_table(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    want = {r: i for i, r in enumerate(sorted(((i % 7, -i) for i in range(1000)), reverse=True), 10)}
    made = B.numbered_all(df, [F.desc("a"), "id"], "n", 10)
    assert {(r["a"], -r["id"]): r["n"] for r in made.collect()} == want
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert B.numbered_all(df.where("id < 0"), ["id"], "n").count() == 0 and B.numbered_all(df.where("id = 3"), ["id"], "n").first()["n"] == 1


def test_mail_blocks(spark):
    body = "hi\n> old\n>> older\nback\n-- Forwarded Message --\nFrom: a\nTo: b\nSubject: c\ntext"
    df = spark.createDataFrame([("m", body)], "doc_id string, body string")
    quoted = rows(M.quote_lines(M.lines(df)).select("pos", "depth", "content"), "pos")
    assert [d for _, d, _ in quoted] == [0, 1, 2, 0, 1, 2, 2, 2, 2]
    parts = rows(M.blocks(M.quote_lines(M.lines(df))).select("page", "part", "text"), "page")
    assert parts[:4] == [(1, "body", "hi"), (2, "quote", "old"), (3, "quote", "older"), (4, "body", "back")]


def test_numbers(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(N.whole_price(F.col("v"))).collect()] == [2.0, 4.0, -1.0]
    got = df.limit(1).select(N.thousands(F.lit(1234.5)), N.reindexed(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0)))).first()
    assert got[0] == "1,235" and got[1] == [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0]
    assert df.limit(1).select(N.grid_bound(F.lit(100.0), F.lit(0.0), F.lit(1.0))).first()[0] == 0


def test_plans_push_down(spark):
    """A scan reads the columns and tests the filters that the query names, and no more."""
    from tessera.plans import tabular

    plan = tabular.query.queries["semi_with_solution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan
    assert "o_orderpriority" not in plan


def test_resolve_meets_equal_records_and_values_once(spark, monkeypatch):
    """Copies of records and of values do not meet each other; the least id of equal records wins, and one with several names keeps them all."""
    names = ["Alpha lamp", "Beta lamp", "Gamma"]
    records = spark.createDataFrame([(i, names[i % 3]) for i in range(60)], "id long, name string")
    inputs = spark.createDataFrame([(i, ["alpha  lamp", "~beta*lamp~", "gama", "qqq", None][i % 5]) for i in range(50)], "input_id long, value string")
    seen, whole = [], E.longest_match
    monkeypatch.setattr(E, "longest_match", lambda i, r, f: seen.append((i.count(), r.count())) or whole(i, r, f))
    assert [r for r in rows(E.resolve(inputs, records, ["name"]), "input_id") if r[0] % 5 != 3] == [(i, [0, 1, 2, None, None][i % 5]) for i in range(50) if i % 5 != 3]
    assert set(seen) == {(5, 3)}
    several = records.unionByName(spark.createDataFrame([(0, "Delta"), (1, "Delta")], "id long, name string"))
    delta = spark.createDataFrame([(1, "delta"), (2, "GAMMA")], "input_id long, value string")
    assert rows(E.resolve(delta, several, ["name"]), "input_id") == [(1, 0), (2, 2)]


def test_points_of_a_curve_are_not_gathered(spark):
    """Few curves go to their points, so no task gets all points of a curve."""
    points = spark.range(300).selectExpr("id % 2 as c", "cast(id as double) as x", "cast(3 * id + 1 as double) as y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.fit(points, "c", least=1, most=1)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert all(math.isclose(r["coefficients"][1], 3) and r["status"] == "pass" for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
