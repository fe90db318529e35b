"""Queries of the rules for designs, environments, ladders, audits and files, each beside SQL that computes the rule from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import card, maskset
from .functions.rng import digest_sql
from .mask import mask
from .operators import audit, conditional, design, environment, events, incidence
from .plans.plan import propose
from .plans.recipe import Recipe
from .queries import PAIRS, SEED, TIMED, pairs, query, table, timed
from .sources.scratch import folder
from .sources.tables import read_set, read_table, write_table

# --- designs: every rule on rows that it scores


def scored(df, rule: str):
    rows = design.rows_of(df)
    found, _ = design.revised(rows, design.candidates(rows))
    score, _ = design.RULES[rule](rows, found)
    return df.sparkSession.createDataFrame([(rule, round(float(score), 6))], "rule string, score double")


def _balance_sql(rows: str, b: str, t: str, cells: str = "count(DISTINCT b) * count(DISTINCT t)") -> str:
    """1 less the coefficient of variation of the cells, not under 0."""
    return f"(SELECT greatest(0, 1 - sqrt(greatest(0, (sq - c * m * m) / (c - 1))) / m) FROM (SELECT sum(n) / ({cells}) AS m, {cells} AS c, sum(n * n) AS sq FROM (SELECT {b} AS b, {t} AS t, count(*) AS n FROM {rows} GROUP BY 1, 2)))"


@query("SELECT 'CRD' AS rule, round(greatest(0, 1 - stddev_samp(n) / avg(n)), 6) AS score FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
def score_crd(spark, sf_dir):
    return scored(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("treatment"), F.col("c_acctbal").alias("yield")), "CRD")


@query("""
WITH r AS (SELECT CASE WHEN s_acctbal >= 0 THEN s_suppkey END AS g, rep FROM supplier, range(1, 5) t(rep)), c AS (SELECT rep, g, count(*) AS n FROM r WHERE g IS NOT NULL GROUP BY ALL),
s AS (SELECT count(DISTINCT rep) * count(DISTINCT g) AS cells, count(*) AS filled, min(n) AS lo, max(n) AS hi, sum(n) AS inside FROM c)
SELECT 'RCBD' AS rule, round(CASE WHEN filled = cells AND lo = hi THEN least(1, 0.85 * least(1, inside / (SELECT count(*) FROM r)) + 0.1) ELSE 0 END, 6) AS score FROM s
""")
def score_rcbd(spark, sf_dir):
    """Suppliers with a balance under 0 are missing treatments, which lowers the coverage."""
    genotype = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("g"), F.col("s_suppkey").cast("string")))
    rows = table(spark, sf_dir, "supplier").select(genotype.alias("genotype"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rep"), F.col("s_acctbal").alias("yield"))
    return scored(rows, "RCBD")


#: Three arrangements of each fifty customers in blocks of ten; one customer of 150 is missing in the first.
LATTICE = ("c_custkey // 10", "c_custkey // 50 * 5 + c_custkey % 5", "c_custkey // 50 * 5 + (c_custkey % 5 + c_custkey % 50 // 10) % 5")


@query(f"""
WITH r AS ({" UNION ALL ".join(f"SELECT c_custkey AS g, '{i}_' || CAST({b} AS VARCHAR) AS b FROM customer" + (" WHERE c_custkey % 150 <> 0" if i == 0 else "") for i, b in enumerate(LATTICE))}),
k AS (SELECT size AS mode, m / sum(m) OVER () AS share FROM (SELECT size, count(*) AS m FROM (SELECT count(DISTINCT g) AS size FROM r GROUP BY b) GROUP BY size) ORDER BY m DESC, size LIMIT 1),
t AS (SELECT size AS mode, m / sum(m) OVER () AS share FROM (SELECT size, count(*) AS m FROM (SELECT count(DISTINCT b) AS size FROM r GROUP BY g) GROUP BY size) ORDER BY m DESC, size LIMIT 1),
s AS (SELECT count(DISTINCT g) AS n_t, count(DISTINCT b) AS n_b FROM r)
SELECT 'IBD/alpha-lattice' AS rule, round(CASE WHEN n_b >= 3 AND k.mode BETWEEN 2 AND n_t - 1 AND t.mode >= 2 AND k.share >= 0.9 AND t.share >= 0.9
 THEN least(1, 0.65 * (k.share + t.share) / 2 + CASE WHEN k.mode / n_t < 0.9 THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN n_t * t.mode = n_b * k.mode THEN 0.15 ELSE 0 END) ELSE 0 END, 6) AS score FROM s, k, t
""")
def score_ibd(spark, sf_dir):
    blocks = F.array(*(F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{i}_"), F.expr(b.replace("//", "DIV")).cast("string")).alias("b")) for i, b in enumerate(LATTICE)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("yield"), F.explode(blocks).alias("s")).where("s.i > 0 OR c_custkey % 150 <> 0")
    return scored(rows.select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("genotype"), F.col("s.b").alias("block"), "yield"), "IBD/alpha-lattice")


@query(f"""
SELECT 'row-column' AS rule, round(least(1, 0.3 * (SELECT count(DISTINCT (l_linenumber, l_quantity)) / (count(DISTINCT l_linenumber) * count(DISTINCT l_quantity)) FROM lineitem)
 + 0.35 * {_balance_sql('lineitem', 'l_linenumber', 'l_returnflag')} + 0.35 * {_balance_sql('lineitem', 'l_quantity', 'l_returnflag')}), 6) AS score
""")
def score_row_column(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col"), F.col("l_returnflag").alias("treatment"), F.col("l_extendedprice").alias("yield"))
    return scored(rows, "row-column")


@query("""
WITH c AS (SELECT l_linenumber, l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'split-plot' AS rule, round(least(1, 0.6 * count(*) / (count(DISTINCT l_linenumber) * count(DISTINCT l_linestatus) * count(DISTINCT l_returnflag)) + CASE WHEN min(n) = max(n) THEN 0.3 ELSE 0 END + 0.1), 6) AS score FROM c
""")
def score_split_plot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rep"), F.col("l_linestatus").alias("irrigation"), F.col("l_returnflag").alias("nitrogen"), F.col("l_extendedprice").alias("yield"))
    return scored(rows, "split-plot")


@query(f"""
SELECT 'factorial' AS rule, round(CASE WHEN (SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) = count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) FROM orders)
 THEN least(1, 0.7 * {_balance_sql('orders', 'o_orderstatus', 'o_orderpriority', 'count(*)')} + 0.2) ELSE 0 END, 6) AS score
""")
def score_factorial(spark, sf_dir):
    """Both columns are named like treatments."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("treatment"), F.col("o_orderpriority").alias("dose"), F.col("o_totalprice").alias("yield"))
    return scored(rows, "factorial")


FACTORED = "(SELECT c_nationkey AS site, c_mktsegment AS genotype, r_name AS zone, o_orderstatus AS response, o_orderpriority AS class, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
KINDS = {"site": "integer", "genotype": "character", "zone": "character", "response": "character", "class": "character", "price": "numeric"}


@query(f"""
WITH d AS {FACTORED}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS kind, count(DISTINCT {c}) AS levels, count(*) AS n, (SELECT count(*) = 0 FROM (SELECT site FROM d GROUP BY site HAVING count(DISTINCT {c}) > 1)) AS of_site FROM d" for c, k in KINDS.items())}),
f AS (SELECT *, levels BETWEEN 2 AND CASE WHEN kind = 'character' THEN greatest(2, n // 2) ELSE greatest(2, ceil(sqrt(n))) END AS factor FROM l)
SELECT col, levels, factor, factor AND (col IN ('site', 'genotype') OR NOT (col = 'response' OR (of_site AND (SELECT factor AND levels * 2 <= n FROM f WHERE col = 'site')))) AS kept FROM f
""")
def design_candidates(spark, sf_dir):
    """Factors by their number of levels; outcomes by name and columns with one value a site are no candidates."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("genotype"), F.col("r_name").alias("zone"), F.col("o_orderstatus").alias("response"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("price"))
    asked = design.rows_of(rows)
    first = design.candidates(asked)
    left, _ = design.revised(asked, first)
    return spark.createDataFrame([(x, v, x in first.factors, x in left.factors) for x, v in first.levels.items()], "col string, levels long, factor boolean, kept boolean")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS b, o_orderpriority AS t FROM orders), s AS (SELECT 'b' AS side, count(*) AS size FROM e GROUP BY b UNION ALL SELECT 't', count(*) FROM e GROUP BY t), m AS (SELECT side, size, count(*) AS m FROM s GROUP BY ALL)
SELECT side, size AS mode, round(m / total, 6) AS share FROM (SELECT *, sum(m) OVER (PARTITION BY side) AS total, row_number() OVER (PARTITION BY side ORDER BY m DESC, size) AS k FROM m) WHERE k = 1
""")
def modal_partners(spark, sf_dir):
    inc = incidence.incidence(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    parts = [incidence.modal(inc, s).select(F.lit(s).alias("side"), "mode", F.round("share", 6).alias("share")) for s in ("b", "t")]
    return parts[0].unionByName(parts[1])


# --- environments

SITED = "(SELECT CASE WHEN c_custkey % 10 > 0 THEN c_nationkey END AS site, year(o_orderdate) AS year, o_orderpriority AS genotype FROM orders JOIN customer ON o_custkey = c_custkey)"


def _environment_sql(method: str, rank: int, cols: list[str]) -> str:
    full, key = " AND ".join(f"{c} IS NOT NULL" for c in cols), f"({', '.join(cols)})"
    confidence = "'medium'" if method == "year" else "'high'"
    if method == "site":
        confidence = "CASE WHEN valid AND coalesce((SELECT avg(r) FROM (SELECT max(CAST(n >= 2 AS INT)) AS r FROM (SELECT site, genotype, count(*) AS n FROM d WHERE site IS NOT NULL GROUP BY ALL) GROUP BY site)), 0) < 0.5 THEN 'medium' ELSE 'high' END"
    shared = f"(SELECT max(k) FROM (SELECT count(DISTINCT {key}) AS k FROM d WHERE {full} GROUP BY genotype))"
    return f"SELECT '{'+'.join(cols)}' AS cols, '{method}' AS method, {rank} AS rank, round(coverage, 6) AS coverage, n_env, valid, {confidence} AS confidence FROM (SELECT *, coverage >= 0.8 AND n_env >= 2 AND n_env < n_obs AND {shared} >= 2 AS valid FROM (SELECT avg(CAST({full} AS INT)) AS coverage, count_if({full}) AS n_obs, count(DISTINCT CASE WHEN {full} THEN {key} END) AS n_env FROM d))"


@query(f"WITH d AS {SITED} " + " UNION ALL ".join((_environment_sql("site_year", 3, ["site", "year"]), _environment_sql("site", 4, ["site"]), _environment_sql("year", 5, ["year"]))))
def env_candidates(spark, sf_dir):
    """Candidates by name, with what makes them valid."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey")).alias("site"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("genotype"))
    told = [environment.evaluate(rows, x, "genotype") for x in environment.propose_environments(rows.columns, ["genotype"])]
    return spark.createDataFrame([("+".join(x.cols), x.method, x.rank, round(float(x.coverage), 6), x.n_env, x.valid, x.confidence) for x in told], "cols string, method string, rank int, coverage double, n_env long, valid boolean, confidence string")


def _partition_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT {a}) = count(DISTINCT {b}) AND count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) AS same FROM nation"


@query(_partition_sql("n_nationkey", "n_name") + " UNION ALL " + _partition_sql("n_nationkey", "n_regionkey"))
def env_same_partition(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(a, b, environment.same_partition(n, (a,), (b,))) for a, b in (("n_nationkey", "n_name"), ("n_nationkey", "n_regionkey"))], "a string, b string, same boolean")


# --- ladder

LADDERED = '(SELECT month(o_orderdate) AS "row", o_orderpriority AS block, c_mktsegment AS panel, c_nationkey AS site, o_orderstatus AS genotype, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey)'
RUNGS = ["row", "block", "panel", "site", "genotype"]


def _rungs_sql(kind: str, order: list[str], when: str = "TRUE") -> str:
    """The rungs of one order of dropping; the first without small strata, or the last."""
    parts = []
    for k in range(len(order) + 1):
        used = [c for c in RUNGS if c not in order[:k]]
        keys = ", ".join(f'"{c}"' for c in used)
        parts.append(f"SELECT {k} AS k, '{','.join(used)}' AS used, '{','.join(order[:k])}' AS dropped, (SELECT sum(CASE WHEN n < 5 THEN n ELSE 0 END) / sum(n) FROM (SELECT count(*) AS n FROM d GROUP BY {keys})) AS f")
    return f"SELECT '{kind}' AS kind, used, dropped, round(f, 6) AS fallback FROM (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE f <= 0 OR k = {len(order)} ORDER BY k LIMIT 1) WHERE {when}"


def _eta_of(col: str) -> str:
    return f"(SELECT CASE WHEN q - s * s / n > 0 AND k < n THEN greatest(0, 1 - (1 - (b - s * s / n) / (q - s * s / n)) * (n - 1) / (n - k)) ELSE 0 END FROM (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM d GROUP BY {col})))"


@query(f"WITH d AS {LADDERED} " + " UNION ALL ".join((_rungs_sql("hierarchy", ["row", "block", "panel", "site"], f"{_eta_of('block')} <= {_eta_of('panel')}"), _rungs_sql("hierarchy", ["row", "panel", "block", "site"], f"{_eta_of('block')} > {_eta_of('panel')}"))))
def ladder_choice(spark, sf_dir):
    """Coordinates go first, then blocks from the least variance explained, then environments; treatments stay."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.month("o_orderdate").alias("row"), F.col("o_orderpriority").alias("block"), F.col("c_mktsegment").alias("panel"), F.col("c_nationkey").alias("site"), F.col("o_orderstatus").alias("genotype"), F.col("o_totalprice").alias("y"))
    got = conditional.ladder(rows, RUNGS, ["genotype"], ["y"])
    return spark.createDataFrame([("hierarchy", ",".join(got.used), ",".join(got.dropped), round(float(got.fallback), 6))], "kind string, used string, dropped string, fallback double")


# --- audit

DRAWS = 3
DRAWN = f"many AS (SELECT p.*, d, CAST(o_orderkey AS VARCHAR) || '#' || CAST(d AS VARCHAR) AS tag FROM {PAIRS} p, range(1, {DRAWS + 1}) t(d)), " + ", ".join(
    f"p_{x} AS (SELECT a.d, a.o_orderkey, b.v FROM (SELECT d, o_orderkey, row_number() OVER (PARTITION BY d ORDER BY {digest_sql(audit.DRAW_SEED, 'draw-to:' + col, 'tag')}, o_orderkey) AS k FROM many) a JOIN (SELECT d, {x} AS v, row_number() OVER (PARTITION BY d ORDER BY {digest_sql(audit.DRAW_SEED, 'draw-from:' + col, 'tag')}, o_orderkey) AS k FROM many) b USING (d, k))"
    for x, col in (("os", "o_orderstatus"), ("od", "o_orderdate"))
)
DRAWN += ", drawn AS (SELECT m.d, m.op, m.os, m.od, s.v AS ps, t.v AS pd FROM many m JOIN p_os s USING (d, o_orderkey) JOIN p_od t USING (d, o_orderkey))"
GRADED = "round(own, 6) AS observed, round(base, 6) AS baseline, round(own - base, 6) AS excess"


def day_pairs(spark, sf_dir):
    """Pairs of status and day, with the priority as a fixed column."""
    p = pairs(spark, sf_dir)
    days = (F.date_format(F.col(f"`{x}|o_orderdate`"), "yyyy-MM-dd").alias(f"{x}|o_orderdate") for x in "oc")
    return p.select("__rid", *days, *(F.col(f"`{x}|o_orderstatus`") for x in "oc"), F.col("`o|o_orderpriority`"), F.col("`o|o_orderpriority`").alias("c|o_orderpriority"))


def rounded(df):
    return df.select("check", *(F.round(c, 6).alias(c) for c in ("observed", "baseline", "excess", "sd")))


@query(f"""
WITH {DRAWN}, real AS (SELECT os, od FROM {PAIRS} GROUP BY ALL HAVING count(*) = 1), made AS (SELECT d, ps AS os, pd AS od FROM drawn GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT 0, cs, cd FROM {PAIRS} GROUP BY ALL HAVING count(*) = 1),
each AS (SELECT t.d, count(r.os) AS v FROM range(0, {DRAWS + 1}) t(d) LEFT JOIN made m ON t.d = m.d LEFT JOIN real r ON m.os = r.os AND m.od = r.od GROUP BY t.d)
SELECT 'rare_cross' AS "check", {GRADED}, round(sd, 6) AS sd FROM (SELECT max(CASE WHEN d = 0 THEN v END) AS own, avg(CASE WHEN d > 0 THEN v END) AS base, greatest(coalesce(stddev_samp(CASE WHEN d > 0 THEN v END), 0), 0.5) AS sd FROM each)
""")
def audit_rare_cross_draws(spark, sf_dir):
    """Combinations unique in original and clone, against permuted originals."""
    return rounded(audit.rare_cross(day_pairs(spark, sf_dir), ["o_orderstatus", "o_orderdate"], DRAWS))


@query(f"""
WITH {DRAWN}, real AS (SELECT DISTINCT op, os, od FROM {PAIRS}), hits AS (SELECT d, CAST(ps = os AND pd = od AS INT) AS same, CAST((op, ps, pd) IN (SELECT (op, os, od) FROM real) AS INT) AS whole FROM drawn UNION ALL SELECT 0, CAST(cs = os AND cd = od AS INT), CAST((op, cs, cd) IN (SELECT (op, os, od) FROM real) AS INT) FROM {PAIRS}),
each AS (SELECT d, 'same_row_joint' AS k, 100 * avg(same) AS v, count(*) AS n FROM hits GROUP BY d UNION ALL SELECT d, 'whole_row', 100 * avg(whole), count(*) FROM hits GROUP BY d)
SELECT k AS "check", {GRADED}, round(sd, 6) AS sd FROM (SELECT k, max(CASE WHEN d = 0 THEN v END) AS own, avg(CASE WHEN d > 0 THEN v END) AS base, greatest(coalesce(stddev_samp(CASE WHEN d > 0 THEN v END), 0), 100 / max(n)) AS sd FROM each GROUP BY k)
""")
def audit_whole_row(spark, sf_dir):
    """Whole rows of the clone that are real, and rows equal to their own original, against permuted originals."""
    return rounded(audit.joint(day_pairs(spark, sf_dir), ["o_orderstatus", "o_orderdate"], ["o_orderpriority"], draws=DRAWS))


#: Columns with rare missing values, by remainders of keys.
HOLES = {"a": "l_orderkey % 41", "b": "l_orderkey % 43", "c": "l_partkey % 37", "d": "l_partkey % 31", "e": "l_suppkey % 7"}


@query(f"SELECT round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 9) AS na_pattern_uniqueness FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(f'{x} = 0' for x in HOLES.values())})")
def audit_na_uniqueness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*(F.expr(f"CASE WHEN {x} <> 0 THEN l_tax END").alias(c) for c, x in HOLES.items()))
    return audit.na_uniqueness(rows, list(HOLES)).select(F.round("na_pattern_uniqueness", 9).alias("na_pattern_uniqueness"))


# --- events


@query(f"SELECT c_custkey, round(CASE WHEN t2 <= 300 THEN t1 WHEN t2 - t1 > 0 AND t1 >= 300 THEN t1 * 300 / t2 WHEN t2 - t1 > 0 THEN t1 ELSE 300 END, 6) AS t1, round(CASE WHEN t2 <= 300 THEN t2 ELSE 300 END, 6) AS t2 FROM {TIMED}")
def event_cap(spark, sf_dir):
    """No last time over 300: the trailing block after the last gap goes there, or the row is scaled."""
    rows = timed(spark, sf_dir)
    t = [F.col("t1").cast("double"), F.col("t2").cast("double")]
    done = events.cap(t, [t[0], t[1] - t[0]], F.lit(300.0))
    return rows.select("c_custkey", *(F.round(x, 6).alias(n) for x, n in zip(done, ("t1", "t2"), strict=True)))


# --- files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_cols FROM {t}" for t in TABLES))
def read_set_folder(spark, sf_dir):
    """A folder read as a set of tables."""
    parts = [t.agg(F.lit(n).alias("tab"), F.count(F.lit(1)).alias("n")).withColumn("n_cols", F.lit(len(t.columns)).cast("bigint")) for n, t in read_set(spark, sf_dir).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment, c_custkey % 2 = 0 AS even FROM customer")
def text_file_round_trip(spark, sf_dir):
    """A table written as text and read back with its types and missing values."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment", "c_custkey % 2 = 0 AS even")
    path = f"{folder(spark)}/text-{uuid.uuid4().hex}.tsv"
    write_table(rows, path)
    return read_table(spark, path)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def recipe_save_load(spark, sf_dir):
    """A saved recipe, read back, gives the original labels and names for a clone without either."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    plan = propose(o, "local", detect=False).set(["o_orderkey", "o_totalprice"], "id", "keep").set("o_orderpriority", "treatment", "alias")
    done = mask(o, plan, seed=SEED, key=["o_orderkey"], alias_names=True)
    path = f"{folder(spark)}/recipe-{uuid.uuid4().hex}"
    done.recipe.save(path)
    return Recipe.load(path).inverse(done.data)


NARROW = (("documents", "text"), ("part", "p_name"), ("nation", "n_name"), ("benchmark", "text"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, median(length({c})) >= 25 AS info FROM {t}" for t, c in NARROW))
def info_tables(spark, sf_dir):
    """Narrow tables of long texts look like documentation."""
    return spark.createDataFrame([(t, maskset.looks_like_info(t, table(spark, sf_dir, t).select(c))) for t, c in NARROW], "tab string, info boolean")


# --- plot data


@query(f"SELECT CAST(site AS VARCHAR) AS env, count(*) AS n, count(DISTINCT genotype) AS n_treatments FROM {SITED} WHERE site IS NOT NULL GROUP BY 1")
def plot_environments(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey")).alias("site"), F.col("o_orderpriority").alias("genotype"))
    return card.environments(rows, ["site"], "genotype")


@query("SELECT l_linenumber AS y, CAST(l_quantity AS INT) AS x, count(*) AS n, min(l_returnflag) AS treatment, count(DISTINCT l_returnflag) AS n_treatments FROM lineitem GROUP BY 1, 2")
def plot_spatial_tile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("col"), "l_returnflag")
    return card.spatial_tile(rows, "l_linenumber", "col", "l_returnflag")


@query("SELECT a, b, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM (SELECT DISTINCT o_orderstatus AS a FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS b FROM orders) LEFT JOIN (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2) USING (a, b)")
def plot_factorial_tile(spark, sf_dir):
    return card.factorial_tile(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("mean", F.round("mean", 6))
