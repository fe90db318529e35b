"""The masking engine: invariants of the random operators, typed refusals, round trips and detection."""

import datetime as dt
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabclone.errors as errors
from tabclone import card, maskset
from tabclone.functions import patterns, rng
from tabclone.functions.kinds import as_factor, kinds, nan_to_null
from tabclone.functions.special import pnorm, qnorm
from tabclone.mask import mask, with_rid
from tabclone.operators import alias, audit, conditional, copula, design, environment, events, geo, grain, hygiene, incidence, jitter, permute, profile
from tabclone.plans.plan import Plan, default_action, problem, propose, role_options
from tabclone.plans.recipe import Recipe, fingerprint
from tabclone.sources import tables

warnings.simplefilter("ignore")
SEED = "11"


@pytest.fixture(scope="module")
def trial(spark):
    """6 sites x 3 reps x 10 varieties, with an effect, some missing values and a column for each site."""
    rows, g = [], np.random.default_rng(4)
    for s in range(6):
        for r in range(3):
            for v in range(10):
                y = 10 + 3 * (v % 2) + s + float(g.normal())
                rows.append((f"s{s}", r + 1, f"v{v}", None if (s + r + v) % 17 == 0 else round(y, 3), float(100 * s + 50) + s * 0.25, "red" if g.random() < 0.3 else "blue", dt.date(2020, 1, 1) + dt.timedelta(days=int(g.integers(0, 60))), int(g.integers(0, 9))))
    return spark.createDataFrame(rows, "site string, rep int, variety string, yield double, rain double, colour string, sown date, weeds int").coalesce(1)


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_kinds_and_nan(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True, dt.date(2020, 1, 1), [1], float("nan"))], "i int, d double, s string, b boolean, day date, l array<int>, x double")
    assert list(kinds(df).values()) == ["integer", "numeric", "character", "logical", "date", "other", "numeric"]
    assert kinds(as_factor(df, "s", ["a"]))["s"] == "factor" and nan_to_null(df).first()["x"] is None


def test_normal_distribution(spark):
    from statistics import NormalDist

    n = NormalDist()
    us = [i / 1000 for i in range(1, 1000)] + [1e-9, 1 - 1e-9]
    rows = spark.createDataFrame([(u,) for u in us], "u double").selectExpr("u", f"{qnorm('u')} AS z").selectExpr("u", "z", f"{pnorm('z')} AS p").collect()
    assert max(abs(r["z"] - n.inv_cdf(r["u"])) for r in rows) < 1e-7 and max(abs(r["p"] - r["u"]) for r in rows) < 1e-8


def test_seeds():
    assert rng.check_seed(5) == "5" and len(rng.check_seed(None)) == 32
    for bad in (1.5, True, 2**40):
        with pytest.raises(errors.BadSeed):
            rng.check_seed(bad)


def test_permutation_keeps_nulls_and_values_whatever_the_partitions(spark, trial):
    df = with_rid(trial)
    a = permute.permute_rows(df, "yield", "__rid", SEED)
    b = permute.permute_rows(df.repartition(7), "yield", "__rid", SEED)
    key = lambda x: sorted((r["__rid"], r["yield"]) for r in x.select("__rid", "yield").collect() if r["yield"] is not None)
    assert key(a) == key(b) and Counter(col(a, "yield")) == Counter(col(df, "yield")) and key(a) != key(df)
    both = df.alias("o").join(a.alias("c"), "__rid")
    assert both.where("(o.yield IS NULL) <> (c.yield IS NULL)").count() == 0
    within = permute.permute_rows(df, "colour", "__rid", SEED, strata=["site"])
    assert Counter(map(tuple, within.select("site", "colour").collect())) == Counter(map(tuple, df.select("site", "colour").collect()))


def test_alias_is_a_bijection(spark, trial):
    m = alias.alias_map(alias.levels(trial, "variety"), "trt_", SEED, "variety").collect()
    assert sorted(r["alias"] for r in m) == [f"trt_{i:03d}" for i in range(1, 11)] and len({r["original"] for r in m}) == 10
    seen = {alias.alias_map(alias.levels(trial, "variety"), "t", str(s), "v").orderBy("original").first()["alias"] for s in range(12)}
    assert len(seen) > 3
    p = alias.permuted_map(alias.levels(trial, "variety"), SEED, "variety").collect()
    assert {r["alias"] for r in p} == {r["original"] for r in p}


def test_unknown_value_fails(spark, trial):
    m = alias.alias_map(alias.levels(trial.where("variety != 'v3'"), "variety"), "t", SEED, "v")
    with pytest.raises(errors.UnmappedValue):
        alias.check(trial, "variety", m)
    with pytest.raises(Exception, match="not in its map"):
        alias.translate(trial, "variety", m).collect()


def test_copula_draws_observed_values_with_their_correlation(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=1500)
    rows = [(i, float(a), float(a + 0.5 * b), int(c)) for i, (a, b, c) in enumerate(zip(x, g.normal(size=1500), g.integers(0, 5, 1500), strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c int")
    new = copula.resimulate(df, ["a", "b", "c"], "id", SEED)
    got, want = (np.array([[r["a"], r["b"], r["c"]] for r in t.orderBy("id").collect()], float) for t in (new, df))
    for k in range(3):
        assert set(got[:, k]) <= set(want[:, k])
    rank = lambda m: m.argsort(0).argsort(0)
    assert abs(np.corrcoef(rank(got)[:, :2].T)[0, 1] - np.corrcoef(rank(want)[:, :2].T)[0, 1]) < 0.1 and dict(new.dtypes)["c"] == "int"


def test_copula_degenerate_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None, float(i % 3), 2.0 * (i % 3)) for i in range(30)], "id int, k double, n double, x double, y double")
    new = copula.resimulate(df, ["k", "n", "x", "y"], "id", SEED)
    assert set(col(new, "k")) == {5.0} and set(col(new, "n")) == {None} and all(r["y"] == 2 * r["x"] for r in new.collect())


def test_conditional_effect_survives(spark):
    g = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(5 * (i % 2) + g.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, arm string, yield double")
    plan = propose(df, detect=False).set("arm", "treatment", "keep").set("yield", "outcome", "scramble").set("id", "id", "keep")
    effect = lambda d: (lambda m: m["b"] - m["a"])({r["arm"]: r["m"] for r in d.groupBy("arm").agg(F.avg("yield").alias("m")).collect()})
    assert abs(effect(mask(df, plan, seed=1, use_conditional=True, use_grain=False).data) - effect(df)) < 0.6
    assert abs(effect(mask(df, plan, seed=1, use_grain=False).data)) < 2.0


def test_jitter(spark):
    df = spark.createDataFrame([(i, (i % 20) / 4, i % 9, float(i % 2)) for i in range(60)], "id int, a double, n int, two double")
    assert jitter.resolution(df, "a").first()["resolution"] == 0.25 and jitter.resolution(df, "n").first()["resolution"] == 1.0
    moved = jitter.jitter(df, "a", "id", SEED, df).join(df.select("id", F.col("a").alias("o")), "id").collect()
    assert all(abs(r["a"] - r["o"]) <= 0.125 for r in moved) and any(r["a"] != r["o"] for r in moved)
    assert col(jitter.jitter(df, "two", "id", SEED, df).orderBy("id"), "two") == col(df.orderBy("id"), "two")
    assert all(abs(r["n"] - r["o"]) <= 1 for r in jitter.jitter(df, "n", "id", SEED, df).join(df.select("id", F.col("n").alias("o")), "id").collect())


def test_plan_rules(trial):
    assert default_action("treatment", "factor", "collaborate") == "alias" and default_action("covariate", "numeric", "local") == "scramble"
    assert problem("id", "scramble", "integer") and problem("outcome", "alias", "numeric") and not problem("design", "alias", "factor")
    assert all(r["valid"] for r in role_options("factor")) and len(role_options()) == 32
    plan = propose(trial, "collaborate", detect=False)
    assert plan["yield"].role == "outcome" and plan["site"].role == "design" and plan["variety"].role == "treatment" and plan["sown"].role == "date"
    assert plan.set("variety", role="covariate")["variety"].action == "alias"
    with pytest.raises(errors.BadPlan):
        plan.set("nothing", role="design")
    with pytest.raises(errors.BadPlan):
        plan.set("yield", action="alias")
    with pytest.raises(errors.BadPlan):
        Plan(plan.entries[:-1]).validate(trial)
    assert plan.validate(trial, "local")["variety"].action == "keep"
    with pytest.raises(errors.MissingPlan):
        mask(trial, None)


def test_mask_local_end_to_end(spark, trial):
    plan = propose(trial, "local", detect=False)
    one, two = (mask(x, plan, seed=3, use_grain=False) for x in (trial, trial.repartition(5)))
    assert sorted(map(str, one.data.collect())) == sorted(map(str, two.data.collect()))
    assert one.data.columns == trial.columns and Counter(map(tuple, one.data.select("site", "rep", "variety").collect())) == Counter(map(tuple, trial.select("site", "rep", "variety").collect()))
    assert Counter(col(one.data, "colour")) == Counter(col(trial, "colour")) and one.data.where("yield IS NULL").count() == trial.where("yield IS NULL").count()
    assert "11" not in repr(one.recipe) and one.status() == "local"


def test_mask_collaborate_round_trip_and_gate(spark, trial, tmp_path):
    plan = propose(trial, "collaborate", detect=False)
    c = mask(trial, plan, seed=3, alias_names=True)
    assert c.data.columns[0] == "col_001" and {r["alias_status"] for r in c.columns} >= {"aliased", "passthrough"}
    assert "v1" not in set(col(c.data, "col_003")) and c.status() in ("clear", "review")
    there = c.recipe.forward(trial, eager=True)
    assert sorted(map(str, c.recipe.inverse(there).collect())) == sorted(map(str, trial.collect()))
    with pytest.raises(errors.IntegrityMismatch):
        c.recipe.forward(trial.withColumn("yield", F.lit(None).cast("double")))
    with pytest.raises(errors.MissingColumn):
        c.recipe.forward(trial.drop("rain"))
    c.recipe.save(f"file://{tmp_path}/recipe")
    again = Recipe.load(f"file://{tmp_path}/recipe")
    assert sorted(map(str, again.forward(trial).collect())) == sorted(map(str, there.collect()))
    with pytest.raises(errors.BadRecipeFile):
        Recipe.load(f"file://{tmp_path}/nothing")
    kept = mask(trial, plan.set("yield", action="keep"), seed=3)
    assert kept.status() == "blocked" and any(r["check"] == "same_row_joint" for r in kept.joint)
    with pytest.raises(errors.BlockedWrite):
        tables.write_clone(kept, f"file://{tmp_path}/kept.parquet")
    tables.write_clone(kept, f"file://{tmp_path}/kept.parquet", allow_high=True)
    assert kept.recipe.allow_high and spark.read.parquet(f"file://{tmp_path}/kept.parquet").count() == 180


def test_too_few_rows(spark, trial):
    plan = propose(trial, "collaborate", detect=False)
    with pytest.raises(errors.TooFewRows):
        mask(trial.limit(3), plan, seed=1)


def test_grain(spark, trial):
    plan = propose(trial, "local", detect=False).set("rain", "covariate", "scramble")
    found = grain.detect_grain(with_rid(trial), plan)
    assert [(g.unit, g.cols, g.n_units) for g in found if "rain" in g.cols] == [(("site",), ("rain",), 6)]
    c = mask(trial, plan, seed=2).data
    assert c.groupBy("site").agg(F.count_distinct("rain").alias("n")).where("n > 1").count() == 0


def test_events(spark):
    g = np.random.default_rng(2)
    rows = []
    for i in range(300):
        rec = i % 3 == 0
        t = int(g.integers(1, 200))
        rows.append((i, "ab"[i % 2], t, int(rec), t + (int(g.integers(1, 90)) if rec else 0), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "id int, arm string, t1 int, s1 int, t2 int, s2 int")
    spec = events.EventSpec(("t1", "t2"), ("s1", "s2"))
    done, report = events.synthesise(df, spec, "id", SEED, ["arm"])
    out = done.collect()
    assert all(r["t2"] >= r["t1"] for r in out) and max(r["t2"] for r in out) <= max(r[4] for r in rows) and all(r["t1"] == r["t2"] for r in out if r["s1"] == 0)
    assert Counter((r["arm"], r["s1"], r["s2"]) for r in out) == Counter((r[1], r[3], r[5]) for r in rows) and report.patterns == 3
    with pytest.raises(errors.BadEvents):
        events.validate(df.withColumn("t2", F.col("t1") - 1), spec)


def test_geo(spark):
    df = spark.createDataFrame([(i, f"p{i % 6}", -30.0 - (i % 6) * 1.12345, 140.0 + (i % 6) * 0.98765) for i in range(48)] + [(99, "p1", None, 140.0)], "id int, place string, lat double, lon double")
    spec = geo.CoordSpec("lat", "lon", "place")
    a, b = (geo.geomask(x, spec, SEED).orderBy("id").collect() for x in (df, df.repartition(5)))
    assert a == b and len({(r["lat"], r["lon"]) for r in a if r["lat"]}) == 6 and a[-1]["lat"] is None and a[-1]["lon"] is None
    land = geo.geomask(df, geo.CoordSpec("lat", "lon"), SEED, on_land=lambda x, y: x > 141).collect()
    assert all(r["lon"] is None or r["lon"] > 141 for r in land)
    plan = propose(df, detect=False).set(["lat", "lon"], "covariate", "keep")
    with pytest.raises(errors.UnmaskedCoordinates):
        geo.guard(df.withColumnsRenamed({"lat": "gps_s"}), plan.renamed({"lat": "gps_s"}).set("gps_s", action="keep"), [])
    with pytest.raises(errors.BadAnchors):
        geo.reanchor(df, df, "place", "lat", "lon", {"p1": (100.0, 0.0)}, "id", SEED)
    assert profile.coordinate_shaped(df.select("lat", "lon")) == ["lat", "lon"]


def test_hygiene(spark):
    df = spark.createDataFrame([(" NSW",), ("NSW",), ("NSW ",), ("Nsw",), ("VIC",), (None,), ("plot 1",), ("plot 2",), ("Ashfield",), ("Ashfiel",)], "`State Name` string")
    c = hygiene.clean(df, quiet=False)
    assert c.data.columns == ["State_Name"] and set(col(c.data, "State_Name")) >= {"NSW", None} and c.near_count == 2
    assert hygiene.legal_names(["a b", "a.b", "1x", "if"]) == {"a b": "a_b", "a.b": "a_b_1", "1x": "X1x", "if": "if_"}
    with pytest.raises(errors.DuplicateNames):
        hygiene.legal_names(["a", " a"])
    t = spark.createDataFrame([("1.5", "2020-01-02", "x")] * 3 + [("", None, "y"), ("3", "2021-02-03", "x")], "n string, d string, f string")
    done = hygiene.conform(t, merge_labels="apply", types="apply")
    assert [k for _, k in done.data.dtypes][:2] == ["double", "date"] and kinds(done.data)["f"] == "factor"
    assert {r["from"] for r in hygiene.merge_closure(spark.createDataFrame([("c", "a", "b"), ("c", "b", "d"), ("c", "x", "y"), ("c", "x", "z")], "col string, `from` string, `to` string")).where("ambiguous").collect()} == {"x"}


def test_designs(spark, trial):
    assert design.detect_design(trial.drop("rain", "colour", "sown", "weeds")).label == "RCBD"
    crd = spark.createDataFrame([(f"t{i % 3}", float(i)) for i in range(60)], "treatment string, y double")
    assert design.detect_design(crd).label == "CRD"
    split = spark.createDataFrame([(b, f"w{w}", f"s{s}", float(b + w * s)) for b in range(6) for w in range(3) for s in range(4)], "block int, variety string, dose string, out double")
    assert design.detect_design(split).scores["split-plot"] > 0.999
    assert design.pick({"CRD": 0.9, "RCBD": 0.91}) == "CRD" and design.pick({"CRD": 0.2}) == "none"


def test_scope(spark, trial):
    df = trial.select("site", "rep", "variety", "yield")
    s = environment.detect_scope(df)
    assert s.status == "multi" and s.env == ("site",) and s.connectivity["status"] == "connected" and {r["design"] for r in s.per_env} == {"RCBD"}
    assert s.blocks == ["rep"] and {(r["treatment"], r["blocks"]) for r in s.per_env} == {("variety", "rep")}
    assert environment.detect_scope(df, env=False).status == "disabled"
    with pytest.raises(errors.InvalidEnvironment):
        environment.detect_scope(df, env=["nowhere"])
    apart = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "c"), ("e3", "c")], "e string, t string")
    assert environment.connectivity(incidence.incidence(apart, "e", "t"))["components"] == 2


def test_designs_of_environments(spark):
    """Each environment gets its own verdict: full blocks, no blocks, a constant treatment, a single row."""
    rows = [("a", r, f"g{g}", float(g + r)) for r in range(3) for g in range(4)] + [("b", i % 3, f"g{i % 2}", float(i)) for i in range(13)] + [("c", r, "g0", float(r)) for r in range(8)] + [("d", 1, "g1", 0.5), (None, 1, "g1", 0.5)]
    told, hidden = environment.designs(spark.createDataFrame(rows, "site string, rep int, genotype string, height double"), ["site"], ["genotype"])
    got = {r["env"]: (r["design"], r["treatment"], r["blocks"], r["n_rows"], r["n_treatments"]) for r in told}
    assert hidden == 0 and got["a"] == ("RCBD", "genotype", "rep", 12, 4) and got["b"] == ("CRD", "genotype", "", 13, 2)
    assert got["c"] == ("none", "", "", 8, 0) and got["d"] == ("none", "", "", 1, 0)
    assert environment.revised_blocks(["rep"], told) == ("cleared", [])
    assert environment.revised_blocks([], [{"blocks": "rep : row"}]) == ("consensus", ["rep", "row"]) and environment.revised_blocks(["rep"], [{"blocks": "rep"}]) == ("unchanged", ["rep"])


def test_reports_count_what_they_do_not_list(spark, trial, monkeypatch):
    monkeypatch.setattr(environment, "SHOWN", 1, raising=False)
    monkeypatch.setattr(events, "SHOWN", 1, raising=False)
    apart = spark.createDataFrame([("e1", "a"), ("e2", "c"), ("e3", "d")], "e string, t string")
    told = environment.connectivity(incidence.incidence(apart, "e", "t"))
    assert told["components"] == 3 and len(told["sizes"]) == 1 and told["sizes_hidden"] == 2
    s = environment.detect_scope(trial.select("site", "rep", "variety", "yield"))
    assert len(s.per_env) == 1 and s.per_env_hidden == trial.select("site").distinct().count() - 1
    rows = [(i, 5 + i % 7, i % 40 if i < 8 else 50) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t1 int, s1 int")
    report = events.synthesise(df, events.EventSpec(("t1",), ("s1",)), "id", SEED)[1]
    assert report.patterns == 9 and len(report.pooled) == 1 and report.pooled_hidden == 7


def test_ladder_and_shifts(spark, trial):
    r = conditional.ladder(trial, ["site", "rep", "variety"], ["variety"], ["yield"])
    assert r.used[-1] == "variety" and r.fallback == 0.0 and "rep" in r.dropped
    effects, spread = conditional.shift_effects(trial, "yield", ["site"])
    assert effects["site"]["s5"] > 3 and spread > 1


def test_shifts_keep_every_term(spark, monkeypatch):
    monkeypatch.setattr(conditional, "CELLS", 500, raising=False)
    # 2400 rows in as many cells of row and column, with effects of both
    noise = np.random.default_rng(2).normal(0, 0.1, (40, 60))
    at = [(i, j) for i in range(40) for j in range(60)]
    df = spark.createDataFrame([(f"r{i:02}", f"c{j:02}", f"b{(i + j) % 3}", 2.0 * i + 0.5 * j + float(noise[i, j])) for i, j in at], "row string, col string, block string, y double")
    found, spread = conditional.shift_effects(df, "y", ["row", "col", "row:block"])
    assert set(found) == {"row", "col", "row:block"}
    found, spread = conditional.shift_effects(df, "y", ["row", "col"])
    assert abs(found["row"]["r39"] - 78) < 0.5 and abs(found["col"]["c59"] - 29.5) < 0.5 and spread > 1
    # many effects are solved by rounds, with the same result
    dense = conditional.shift_effects(df, "y", ["row", "col", "block"])
    monkeypatch.setattr(conditional, "DENSE", 10, raising=False)
    wide = conditional.shift_effects(df, "y", ["row", "col", "block"])
    assert all(abs(v - wide[0][t][k]) < 1e-4 for t, x in dense[0].items() for k, v in x.items()) and abs(dense[1] - wide[1]) < 1e-4


def test_classifier():
    f = lambda **k: audit.classify(audit.Finding(**({"role": "covariate", "kind": "numeric", "action": "scramble", "mode": "collaborate"} | k)))
    assert f() == "low" and f(mode="local") == "low" and f(pii=True) == "high" and f(pii=True, mode="local") == "medium" and f(coarsened=True) == "medium"
    assert f(role="outcome", action="keep") == "high" and f(role="outcome", action="keep", allow_kept_outcome=True) == "medium"
    assert f(role="treatment", alias="permuted") == "high" and f(kind="factor", freq_min=1) == "high" and f(exact=6.0) == "medium" and f(role="outcome", exact=2.0) == "medium"
    assert f(excess=60.0, sd=1.0, by_excess=True) == "high" and f(excess=20.0, sd=1.0) == "medium" and f(grained=True, value_set=60.0) == "high" and f(action="keep") == "medium"


def test_sets_and_links(spark, trial, tmp_path):
    parents = spark.createDataFrame([(f"v{i}", i * 1.5, "early" if i < 5 else "late") for i in range(10)], "variety string, height double, maturity string")
    assert maskset.detect_links({"trial": trial, "parents": parents}) == ["variety"]
    plans = {"trial": propose(trial, "collaborate", detect=False), "parents": propose(parents, "collaborate", detect=False)}
    done = maskset.mask_set({"trial": trial, "parents": parents}, plans, seed=9)
    a, b = done.clones["trial"].data, done.clones["parents"].data
    assert a.join(b, "variety").count() == 180 and set(col(a, "variety")) == set(col(b, "variety"))
    back = done.inverse(done.forward({"trial": trial, "parents": parents}))
    assert sorted(map(str, back["parents"].collect())) == sorted(map(str, parents.select(back["parents"].columns).collect()))
    with pytest.raises(errors.BadLinks):
        maskset.mask_set({"trial": trial, "parents": parents}, plans, links=["height"], seed=9)
    with pytest.raises(errors.BadInfo):
        maskset.mask_set({"trial": trial}, info=["none"])
    assert maskset.looks_like_info("Dictionary", trial) and not maskset.looks_like_info("trial", trial)


def test_sources(spark, trial, tmp_path):
    for kind in ("csv", "tsv", "parquet", "orc", "json"):
        tables.write_table(trial, f"file://{tmp_path}/{kind}.{kind}")
        assert tables.read_table(spark, f"file://{tmp_path}/{kind}.{kind}").count() == 180
    back = tables.read_table(spark, f"file://{tmp_path}/csv.csv")
    assert dict(back.dtypes)["yield"] == "double" and dict(back.dtypes)["rep"] == "bigint" and back.where("yield IS NULL").count() == trial.where("yield IS NULL").count()
    assert set(tables.read_set(spark, f"file://{tmp_path}", pattern="csv|orc")) == {"csv", "orc"}
    for bad in ({}, {"a": trial.limit(0)}, {"a": trial.withColumnRenamed("rep", "...1")}):
        with pytest.raises(errors.BadSet):
            tables.read_set(spark, bad)
    with pytest.raises(errors.BadSet):
        tables.read_set(spark, f"file://{tmp_path}/none")


def test_card(spark, trial, tmp_path):
    c = mask(trial, propose(trial, "local", detect=False), seed=1, use_grain=False)
    one, two = (card.to_yaml(card.data_card(c, "trial", env="site")) for _ in range(2))
    assert one == two and 'name: "trial"' in one and "environment:" in one
    with pytest.raises(errors.BadCard):
        card.data_card(c, " ")
    assert card.replication_tile(trial, "site", "variety").count() == 60


def test_stream_replay(spark, trial, tmp_path):
    from tabclone.streaming.replay import replay

    c = mask(trial, propose(trial, "collaborate", detect=False), seed=3)
    trial.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(trial.schema).parquet(f"file://{tmp_path}/in")
    replay(stream, c.recipe, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, c.recipe.forward(trial).collect()))


def test_fingerprint_ignores_row_order(spark, trial):
    assert fingerprint(trial) == fingerprint(trial.repartition(3)) != fingerprint(trial.withColumn("rep", F.when(F.col("rep") > 1, F.col("rep"))))


def test_name_patterns():
    assert patterns.matches("Plot", patterns.DESIGN) and patterns.matches("contact_email", patterns.PII) and not patterns.matches("yields", patterns.OUTCOME)


def test_keys_have_to_be_unique(spark):
    df = spark.createDataFrame([(f"k{i % 10}", "x", float(i)) for i in range(30)], "id string, part string, yield double")
    plan = propose(df, "local", detect=False).set(["id", "part"], "id", "keep")
    with pytest.raises(errors.BadTable):
        mask(df, plan, seed=1, key=["id"])
    odd = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 2.0), ("a", None, 3.0), (None, "a", 4.0), ("a\\", "b", 5.0), ("a", "\\b", 6.0)], "id string, part string, yield double")
    assert mask(odd, plan, seed=1, key=["id", "part"]).data.count() == 6
    assert mask(df, plan, seed=1).data.count() == 30


def test_forward_of_a_source_with_nan(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 4 == 0 else float(i), ["a", "b"][i % 2]) for i in range(20)], "id int, yield double, variety string")
    plan = propose(df, "local", detect=False).set("variety", "treatment", "alias").set("id", "id", "keep")
    done = mask(df, plan, seed=1, key=["id"])
    assert done.recipe.forward(df).where("yield IS NULL").count() == 5
    with pytest.raises(errors.IntegrityMismatch):
        done.recipe.forward(df.where("id > 0"))


def test_whole_valued_doubles_stay_whole(spark):
    rows = [(i, f"s{i % 60}", "ab"[i % 2], float(10 * (i % 2) + i % 30 + i * 7 % 5), 0.5 + i * 7 % 5) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, block string, arm string, count double, yield double")
    plan = propose(df, "local", detect=False).set("id", "id", "keep").set("arm", "treatment", "keep").set("block", "design", "keep").set(["count", "yield"], "outcome", "scramble")
    with pytest.warns(errors.ConditionalDegraded):
        done = mask(df, plan, seed=1, key=["id"], use_conditional=True, use_grain=False).data
    assert done.where("count != floor(count)").count() == 0 and done.where("yield != floor(yield)").count() > 0


def test_environments_without_a_treatment(spark):
    rows = [(f"s{i % 3}", f"e{i % 4}", float(i)) for i in range(48)]
    named = environment.detect_scope(spark.createDataFrame(rows, "site string, environment string, height double"))
    assert named.env == ("environment",)
    assert environment.detect_scope(spark.createDataFrame([(s, y) for s, _, y in rows], "site string, height double")).status == "single"


def test_merge_closure_of_long_chains_and_circles(spark):
    chain = [("c", f"v{i:03d}", f"v{i + 1:03d}") for i in range(9)]
    got = {r["from"]: (r["to"], r["ambiguous"]) for r in hygiene.merge_closure(spark.createDataFrame(chain + [("c", "v003", "z")], "col string, `from` string, `to` string")).collect()}
    assert got["v008"] == ("v009", False) and got["v000"] == ("v009 | z", True) and len(got) == 9
    with pytest.raises(errors.BadTable):
        hygiene.merge_closure(spark.createDataFrame([("c", "a", "b"), ("c", "b", "a")], "col string, `from` string, `to` string"))


def test_conform_is_replayed_by_the_recipe(spark, tmp_path):
    rows = [(i, " Hamlet" if i % 7 == 0 else "hamlet" if i % 9 == 1 else ["Hamlet", "Sultan"][i % 2], str(i / 4), f"2024-01-{1 + i % 9:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, variety string, height string, day string")
    conformed = hygiene.conform(df, merge_labels="apply", types="apply")
    assert conformed.levels["variety"] == ["Hamlet", "Sultan"] and dict(conformed.data.dtypes)["height"] == "double"
    plan = propose(conformed.data, "local", detect=False).set("variety", "treatment", "alias").set("id", "id", "keep")
    done = mask(conformed, plan, seed=1, key=["id"])
    assert dict(done.data.dtypes)["day"] == "date" and done.data.schema["variety"].metadata["levels"] == ["trt_001", "trt_002"]
    done.recipe.save(f"file://{tmp_path}/recipe")
    for recipe in (done.recipe, type(done.recipe).load(f"file://{tmp_path}/recipe")):
        forward = recipe.forward(df)
        assert forward.select("variety").distinct().count() == 2 and dict(forward.dtypes)["height"] == "double"
        back = recipe.inverse(forward)
        assert {r[0] for r in back.select("variety").distinct().collect()} == {"Hamlet", "Sultan"} and back.schema["variety"].metadata["levels"] == ["Hamlet", "Sultan"]


def test_factor_levels_of_a_clone(spark):
    df = as_factor(spark.createDataFrame([(i, "lmh"[i % 2]) for i in range(20)], "id int, dose string"), "dose", ["l", "m", "h"], True)
    plan = propose(df, "local", detect=False).set("id", "id", "keep")
    aliased = mask(df, plan.set("dose", "treatment", "alias"), seed=1, key=["id"])
    assert aliased.data.schema["dose"].metadata == {"levels": ["trt_001", "trt_002", "trt_003"], "ordered": True} and aliased.recipe.maps["dose"].count() == 3
    moved = mask(df, plan.set("dose", "treatment", "scramble"), seed=1, key=["id"])
    assert moved.data.schema["dose"].metadata["levels"] == ["l", "m", "h"]


def test_links_keep_their_names_and_count_as_aliased(spark):
    tables = {"a": spark.createDataFrame([(f"f{i}", float(i)) for i in range(12)], "farm string, yield double"), "b": spark.createDataFrame([(float(i), f"f{i}") for i in range(12)], "rain double, farm string")}
    plans = {n: propose(t, "local", detect=False).set("farm", "design", "keep") for n, t in tables.items()}
    plans["b"] = plans["b"].set("farm", "id", "alias")
    done = maskset.mask_set(tables, plans, seed=1, alias_names=True)
    a, b = done.clones["a"], done.clones["b"]
    assert a.data.columns == ["farm", "col_002"] and b.data.columns == ["col_001", "farm"] and a.data.join(b.data, "farm").count() == 12
    assert {r["col"]: r["action"] for r in a.public_roles()}["farm"] == "alias"


def test_audit_on_request(spark, capsys):
    from tabclone.mask import audit_mask

    df = spark.createDataFrame([(i, f"p{i}", ["a", "b", "c"][i % 3], float(i * 7 % 40), "xyz"[i % 3]) for i in range(40)], "id int, plot string, variety string, yield double, note string")
    plan = propose(df, "local", detect=False).set("id", "id", "keep").set("plot", "id", "alias").set("variety", "treatment", "alias").set("note", "covariate", "scramble")
    done = mask(df, plan, seed=1, key=["id"])
    same = mask(df, plan, seed=1, key=["id"], do_audit=True, alias_names=True)
    stored = audit_mask(same, show=False)
    with pytest.raises(errors.AuditMissing):
        audit_mask(done)
    with pytest.raises(errors.BadOriginal):
        audit_mask(done, df, key=["note"])
    # another key draws another baseline for the joint checks
    assert audit_mask(done, df, key=["plot"])[0] == stored[0] and "audit (mode local)" in capsys.readouterr().out
    again = mask(df, plan, seed=1, key=["id"], alias_names=True)
    assert audit_mask(again, df, key=["id"], show=False) == stored


def test_treatments_by_rules_alone_need_evidence(spark):
    rows = [(f"s{s}", r, f"v{v}", f"k{v % 2}", float(s * 7 + r * 3 + v), f"z{s % 2}") for s in range(4) for r in range(3) for v in range(6)]
    df = spark.createDataFrame(rows, "site string, rep int, brand string, colour string, weight double, zone string")
    found = design.candidates(design.rows_of(df))
    told = design.withheld(df, None, found, ["brand", "zone", "weight", "rep"])
    assert "brand" not in told and told["zone"] == "one value for each site" and told["rep"] == "named like a design column" and "measurement" in told["weight"]
    assert set(design.withheld(df.drop("site", "rep"), None, design.candidates(design.rows_of(df.drop("site", "rep"))), ["brand"])) == {"brand"}
    near = design.Design("CRD", {"CRD": 0.9, "RCBD": 0.89, "factorial": 0.1}, {}, ["brand"], [], withheld={"brand": "why"})
    assert near.recommended == [] and near.close == ["CRD", "RCBD"]
    assert design.Design("CRD", {"CRD": 0.9, "RCBD": 0.5}, {}).close == []


def test_environment_recommendations(spark):
    df = spark.createDataFrame([(f"s{s}", f"g{g}", 2000 + s % 2, float(s + g)) for s in range(4) for g in range(5) for _ in range(2)], "site string, genotype string, year int, yield double")
    scope = environment.Scope("multi", ("site",))
    assert [r["action"] for r in environment.recommend(df, scope, "collaborate")] == ["alias"] and [r["action"] for r in environment.recommend(df, scope, "local")] == ["keep"]
    doubt = environment.Scope("ambiguous", candidates=[environment.Candidate(("site",), "site", "high", 4, valid=True), environment.Candidate(("year",), "year", "medium", 4, valid=True)])
    assert {(r["col"], r["action"]) for r in environment.recommend(df, doubt, "collaborate")} == {("site", "keep"), ("year", "keep")}
    plan = propose(df, "collaborate", detect=False)
    assert environment.overlay(plan, df, scope)["site"].action == "alias"
    assert environment.overlay(plan.set("site", action="keep"), df, scope)["site"].action == "keep"
    assert environment.recommend(df, environment.Scope("single"), "local") == []


def test_grain_notes_and_reasons(spark):
    df = spark.createDataFrame([(f"s{s}", float(s) + 0.5, float(i * s) + 0.25) for s in range(6) for i in range(4)], "site string, rain double, height double")
    notes = {e.col: e.notes for e in propose(df, "collaborate", detect=False).entries}
    assert "one value for each site" in notes["rain"] and "one value" not in notes["height"]
    few = propose(df.where("site < 's3'"), "collaborate", detect=False)
    assert "one value" not in few["rain"].notes and "one value for each site" in propose(df.where("site < 's3'"), "local", detect=False)["rain"].notes
    by = {(r["role"], r["action"]): r["notes"] for r in role_options()}
    assert by["design", "keep"] == "" and "can't be given" in by["design", "scramble"] and "needs one of" in by["outcome", "scramble"]


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, label string")
    taken = tmp_path / "taken.xlsx"
    taken.write_text("")
    with pytest.raises(errors.ExistingTarget):
        tables.write_workbook({"one": df}, str(taken))
    with pytest.raises(errors.BadSheets):
        tables.write_workbook({"a/b": df}, str(tmp_path / "new.xlsx"))
    try:
        tables.write_workbook({"one": df}, str(tmp_path / "new.xlsx"))
    except errors.BadSet as e:
        assert "engine" in str(e)
    else:
        assert tables.read_set(spark, str(tmp_path / "new.xlsx"))["one"].collect() == df.collect()
