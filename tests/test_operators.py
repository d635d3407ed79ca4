"""Operators on hand-written edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import matching, parsing, stats
from sparkloom.functions import text as tx
from sparkloom.operators import checks, evaluate, geometry, joins, ranking, recommend, regression, resolve, runs, sampling, similarity


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr("v").alias("x")).orderBy("i").collect()]


def test_weighted_list_variants(spark):
    cells = ["", None, "nan", "a:1", "a:b:2", "x:notnum", "a:1|b:2.5|a:3|:4"]
    pairs = lambda rows: [[(e["name"], e["strength"]) for e in r] for r in rows]
    assert pairs(column(spark, cells, parsing.weighted_list)) == [[], [], [], [("a", 1.0)], [("a:b", 2.0)], [], [("a", 1.0), ("b", 2.5), ("a", 3.0)]]
    assert pairs(column(spark, ["a:b:2", "a:2"], lambda c: parsing.weighted_list(c, last_colon=False))) == [[], [("a", 2.0)]]
    last = column(spark, ["a:1|b:2.5|a:3"], lambda c: parsing.last_wins(parsing.weighted_list(c)))
    assert pairs(last) == [[("b", 2.5), ("a", 3.0)]]
    assert pairs(column(spark, ["b:2|a:2|c:9"], lambda c: parsing.by_strength(parsing.weighted_list(c)))) == [[("c", 9.0), ("a", 2.0), ("b", 2.0)]]


def test_repaired_split(spark):
    assert column(spark, ["x|a|b|y", "a|b", "a", None, "a|b|a"], lambda c: parsing.repaired_split(c, ["a|b"])) == [["x", "a|b", "y"], ["a|b"], ["a"], [], ["a|b", "a"]]


def test_fenced_json(spark):
    assert [r and r["k"] for r in column(spark, ['```json\n{"k": 1}\n```', 'no', 'x {"k": 2} y', None], lambda c: parsing.fenced_json(c, "k int"))][::2] == [1, 2]


def test_shares_and_availability(spark):
    df = spark.createDataFrame([(0, 0), (10, 9), (10, 10), (None, None)], "a long, b long")
    assert [r[0] for r in df.select(similarity.share(["a", "b"], 20)).collect()] == [None, None, [0.5, 0.5], None]
    pairs = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in pairs.select(similarity.available_mean(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, None]


def test_cap_equals_the_greedy_scan(spark):
    rng = np.random.default_rng(0)
    rows = [(0, int(i), f"b{rng.integers(4)}", int(rng.integers(5))) for i in range(60)]
    df = spark.createDataFrame(rows, "q int, id int, brand string, score int")
    taken, kept = {}, []
    for _, i, b, _s in sorted(rows, key=lambda r: (-r[3], r[1])):
        if taken.get(b, 0) < 2 and len(kept) < 7:
            taken[b] = taken.get(b, 0) + 1
            kept.append(i)
    got = ranking.capped(df, ["q"], "brand", [F.desc("score"), "id"], 2, 7).orderBy("rank").collect()
    assert [r["id"] for r in got] == kept


def test_ties_and_calibration(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])] + [(2, 9, 3.0)], "q int, id int, s double")
    assert {r["q"]: r["tie_at_last"] for r in ranking.ties_at(df, ["q"], "s", [F.desc("s"), "id"], 3).collect()} == {1: 3, 2: 1}
    flat = df.select("q", ranking.min_max("s", ["q"]).alias("m"), ranking.z_score("s", ["q"]).alias("z")).filter("q = 2").first()
    assert (flat["m"], flat["z"]) == (0.5, 0.0)
    assert [r["pct"] for r in ranking.percentile_rank(df.filter("q = 1"), "s").orderBy("id").collect()] == [1.0, 0.6, 0.6, 0.6, 0.2]


def test_one_to_one_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, y int")
    assert joins.one_to_one(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="repeated on the right"):
        joins.one_to_one(a, b, ["k"]).collect()


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "q int, item int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 99), (3, 1)], "q int, item int")
    m = {(r["q"], r["k"]): r for r in evaluate.metrics(ranked, relevant, [2, 3]).collect()}
    assert set(m) == {(1, 2), (1, 3), (2, 2), (2, 3)}
    assert (m[1, 2]["recall"], m[1, 2]["precision"], m[1, 2]["mrr"], m[1, 2]["hit"]) == (0.5, 0.5, 0.5, 1)
    ideal = 1 + 1 / math.log2(3)
    assert m[1, 3]["ndcg"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    assert (m[2, 3]["ndcg"], m[2, 3]["hit"]) == (0.0, 0)


def test_bootstrap_brackets_the_mean(spark):
    d = spark.createDataFrame([(i, 0.1 + (i % 5) / 10) for i in range(100)], "id long, diff double")
    r = evaluate.paired_bootstrap(d, 200).first()
    assert r["low"] < r["mean"] < r["high"] and r["p_above"] == 1.0


def test_quotas():
    assert sum(sampling.root_quota({"a": 100, "b": 9, "c": 1}, 20).values()) == 20
    assert sampling.root_quota({"a": 3}, 10) == {"a": 3}  # the supply ends first
    assert sampling.root_quota({"a": 50, "b": 50}, 7) in ({"a": 4, "b": 3}, {"a": 3, "b": 4})
    assert sampling.root_quota({}, 5) == {}
    assert sampling.water_level_quota({"a": 2, "b": 50, "c": 50}, 20) == {"a": 2, "b": 9, "c": 9}
    assert sampling.water_level_quota({"a": 50, "b": 50}, 100, cap=30) == {"a": 30, "b": 30}


def test_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(1000)
    assert sorted(r["id"] for r in sampling.hashed_sample(df, "id", 20).collect()) == sorted(r["id"] for r in sampling.hashed_sample(df.repartition(13), "id", 20).collect())


def test_text_keys(spark):
    assert column(spark, ["Ａ  b\tÉ", None], tx.folded) == ["a b é", None]
    assert column(spark, ["Crème Brûlée 5", "한국"], tx.latin_key) == ["cremebrulee5", ""]
    assert column(spark, ["한국 서울"], tx.romanised) == ["hanguk seoul"]
    assert column(spark, ["빨래", "빨레"], lambda c: F.char_length(tx.jamo(c))) == [5, 5]
    assert column(spark, ["kitten"], lambda c: tx.bounded_levenshtein(F.lit("sitting"), c, 2)) == [3]
    assert column(spark, ["kitten"], lambda c: tx.bounded_levenshtein(F.lit("sitten"), c, 2)) == [1]


def test_titles(spark):
    t = ["[기획] Brand Rose EDP 30/50ml (+ 증정)", "Rose Eau de Toilette 7.5 ml + EDP", "장미향 EDP", "Cologne parfum", ""]
    assert column(spark, t, lambda c: tx.volumes(F.col(c))) == [[30.0, 50.0], [7.5], [], [], []]
    assert column(spark, t, lambda c: tx.concentrations(F.col(c))) == [["EDP"], ["EDP", "EDT"], ["EDP"], ["Cologne", "Parfum"], []]
    assert column(spark, t, lambda c: tx.cleaned_name(F.col(c), F.lit("Brand"))) == ["rose", "rose", "장미향", "", ""]


def test_spans():
    assert tx.find_spans("red ring, reddish ring", ["red", "red ring", "ring"]) == [(0, 8, "red ring"), (18, 22, "ring")]
    assert tx.find_spans("", ["x"]) == [] and tx.find_spans("x", [""]) == []


def test_label_matching():
    assert matching.greedy(["Roses", "lily"], ["rose", "Lily", "x"]) == [("lily", "Lily"), ("Roses", "rose")]
    assert matching.maximum(["a b", "a"], ["a", "a b"]) == 2
    assert matching.maximum([], ["x"]) == 0


def test_statistics_by_hand(spark):
    d = spark.createDataFrame([(0, 1.0, 0), (0, 2.0, 1), (0, 2.0, 0), (0, 3.0, 1)], "g int, s double, y int")
    assert stats.auc(d, "s", "y", ["g"]).first()["auc"] == pytest.approx(0.875)
    assert stats.spearman(d, "s", "s", ["g"]).first()["rho"] == pytest.approx(1.0)
    same = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, b int")
    assert stats.quadratic_kappa(same, "a", "b", 3).first()["kappa"] == pytest.approx(1.0)


def test_geometry_pieces(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (3, 2), (1, 3)], "row int, col int")
    got = {(r["row"], r["col"]): r["component"] for r in geometry.grid_components(cells).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 3): 2, (2, 2): 3, (3, 2): 3}
    field = spark.createDataFrame([(r, q, float(r == 1 and q == 1)) for r in range(3) for q in range(3)], "row int, col int, density double")
    lines = geometry.contour_segments(field, 0.5).collect()
    assert len(lines) == 4 and {(r["x0"], r["y0"]) for r in lines} | {(r["x1"], r["y1"]) for r in lines} == {(1.0, 0.5), (0.5, 1.0), (1.5, 1.0), (1.0, 1.5)}
    pts = spark.createDataFrame([(i, float(i // 5 * 100 + i % 5), 0.0, 0) for i in range(10)], "id long, x double, y double, label int")
    for linkage in ("average", "complete", "single"):
        groups = {r["id"]: r["cluster"] for r in geometry.agglomerative(geometry.distances(pts), 2, linkage).collect()}
        assert groups == {i: 0 if i < 5 else 5 for i in range(10)}
    turned = pts.select("id", (-F.col("y") * 2).alias("x"), (F.col("x") * 2).alias("y"))
    r = geometry.procrustes(pts, turned).first()
    assert (r["scale"], r["residual"]) == (pytest.approx(0.5), pytest.approx(0.0, abs=1e-9))


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "g int, i int, v string")
    assert [(r["value"], r["n"]) for r in runs.run_lengths(df, ["g"], ["i"], "v").orderBy("run").collect()] == [("a", 2), (None, 2), ("a", 1)]


def test_ladder_relaxes_step_by_step(spark):
    feat = spark.createDataFrame([(i, f, 10.0 * i) for i in range(1, 7) for f in (["a", "b"] if i == 6 else ["a"])], "item int, feature string, strength double")
    items = spark.createDataFrame([(i, 100 * i, f"b{i % 2}") for i in range(1, 7)], "item int, people int, brand string")
    reqs = spark.createDataFrame([(1, ["a", "b"], []), (2, ["a"], ["b"]), (3, ["zzz"], []), (4, [], [])], "q int, core array<string>, avoid array<string>")
    cand = recommend.candidates(reqs, feat, items)
    got = {}
    for r in recommend.ladder(cand, least=500, min_results=2, k=3, cap=2).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["stage"], r["item"], r["candidate_count"], r["tie_at_last"]))
    assert got == {1: [("OR", 6, 2, 1), ("OR", 5, 2, 1)], 2: [("OR_ANY", 5, 5, 1), ("OR_ANY", 4, 5, 1), ("OR_ANY", 3, 5, 1)]}
    answer = {r["q"]: r["status"] for r in recommend.response(recommend.ladder(cand, 500, 2, 3, 2), reqs, feat).collect()}
    assert answer == {1: "OK", 2: "OK", 3: "NO_RESULT", 4: "NO_CONDITION"}


def test_match_decisions(spark):
    left = spark.createDataFrame([(1, "b", "rose water"), (2, "b", "rose watr"), (3, "b", "qqq"), (4, "none", "x")], "left_id int, block string, name string")
    right = spark.createDataFrame([(10, "b", "rose water"), (11, "b", "lily of the valley")], "right_id int, block string, catalogue_name string")
    got = {r["left_id"]: (r["right_id"], r["status"], r["basis"]) for r in resolve.decide(resolve.scored(resolve.blocked_pairs(left, right, "block"))).collect()}
    assert got[1] == (10, "MATCH", "exact") and got[2] == (10, "MATCH", "strong") and got[3][1] == "NO_MATCH" and 4 not in got


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.25), (1, 1.255), (2, None)], "id int, v double")
    rows = {r["check"]: (r["ok"], r["detail"]) for r in checks.suite(checks.unique(df, ["id"], "u"), checks.holds(df, "v < 2", "h"), checks.count_is(df, 3, "c"), checks.references(df, "id", df.filter("id = 1"), "id", "r")).collect()}
    assert rows == {"u": (False, 1), "h": (True, 0), "c": (True, 3), "r": (False, 1)}
    assert [r[0] for r in df.select(checks.fits_decimal("v", 4, 2)).collect()][:2] == [True, False]


def test_ridge_recovers_a_line(spark):
    df = spark.createDataFrame([(i, [float(i % 17), float(i % 5)], 3.0 * (i % 17) - (i % 5) + 2) for i in range(500)], "id long, x array<double>, y double")
    assert all(r["r2"] > 0.999 for r in regression.ridge_cv_r2(df, "id", 5, 1e-3).collect())


def test_every_embedding_gets_a_cluster(spark, sf):
    import __spark_entry__

    ids = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = __spark_entry__.queries()["geo07_agglomerative"](spark, sf).collect()
    assert sorted(r["id"] for r in got) == sorted(ids)
    assert all(ids[r["id"]] == ids[r["cluster"]] for r in got)
    pts = geometry.points(type("C", (), {"table": lambda _, n: spark.read.parquet(f"{sf}/{n}.parquet")})()).filter("label = 3")
    alone = geometry.agglomerative(geometry.distances(pts), 5).collect()
    assert {r["id"]: r["cluster"] for r in alone} == {r["id"]: r["cluster"] for r in got if ids[r["id"]] == 3}
    seen = __spark_entry__.queries()["xtr24_linkages"](spark, sf).select("label", "linkage").collect()
    assert len(seen) == 3 * len(set(ids.values()))
