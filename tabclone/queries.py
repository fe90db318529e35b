"""The registered queries of the masking engine, each beside the SQL that DuckDB runs for it.

Random operators hash (seed, stream, key), which both engines compute alike, so their results are compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import card, maskset
from .functions.rng import digest_sql, uniform_sql
from .functions.special import pnorm, qnorm
from .mask import mask, with_rid
from .operators import alias, audit, conditional, copula, design, environment, events, geo, grain, hygiene, incidence, jitter, permute
from .operators.profile import coordinate_shaped, profile_frame
from .plans.plan import propose, role_options
from .plans.recipe import fingerprint
from .sources.scratch import cut

SEED = "20240101"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EPS = "8.881784197001252e-16"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its six-column key as rid, and l_tax missing on third lines."""
    key = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), date_format(l_shipdate, 'yyyy-MM-dd'))"
    return table(spark, sf_dir, "lineitem").withColumn("rid", F.expr(key)).withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))


LINEITEM = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax), concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), strftime(l_shipdate, '%Y-%m-%d')) AS rid FROM lineitem)"


def permuted_sql(source: str, rid: str, col: str, strata: str = "", stream: str | None = None, seed: str = SEED) -> str:
    """rid and v: the permuted values of rows that have one."""
    stream = stream or col
    by = f"PARTITION BY {strata} " if strata else ""
    keys = f"{strata}, " if strata else ""
    rows = f"(SELECT * FROM {source} WHERE {col} IS NOT NULL)"
    to = f"SELECT {rid} AS rid, {keys}row_number() OVER ({by}ORDER BY {digest_sql(seed, 'permute-to:' + stream, rid)}, {rid}) AS k FROM {rows}"
    source_ = f"SELECT {keys}{col} AS v, row_number() OVER ({by}ORDER BY {digest_sql(seed, 'permute-from:' + stream, rid)}, {rid}) AS k FROM {rows}"
    return f"(SELECT a.rid, b.v FROM ({to}) a JOIN ({source_}) b USING ({keys}k))"


def alias_sql(values: str, col: str, prefix: str, stream: str, seed: str = SEED) -> str:
    """original and alias."""
    return f"(SELECT original, '{prefix}' || lpad(CAST(row_number() OVER (ORDER BY {digest_sql(seed, 'alias:' + stream, 'original')}) AS VARCHAR), greatest(3, length(CAST(count(*) OVER () AS VARCHAR)))::INT, '0') AS alias FROM (SELECT DISTINCT {col} AS original FROM {values} WHERE {col} IS NOT NULL))"


def drawn_sql(source: str, rid: str, col: str, u: str, by: str = "1") -> str:
    """rid and v: the value at each row's quantile u (within by)."""
    ordered = f"SELECT {by} AS g, {col} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {col}) AS k FROM {source} WHERE {col} IS NOT NULL"
    asked = f"SELECT {rid} AS rid, {by} AS g, CAST(greatest(1, least(n, ceil(n * {u} - {EPS}))) AS BIGINT) AS k FROM (SELECT *, count({col}) OVER (PARTITION BY {by}) AS n FROM {source}) WHERE {col} IS NOT NULL"
    return f"(SELECT a.rid, o.v FROM ({asked}) a JOIN ({ordered}) o ON a.g = o.g AND a.k = o.k)"


# --- profile and plan


def _profile_sql(t: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {t}" for c, k in cols)


ORDERS = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "character"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "character")]
LINES = [("l_quantity", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "character"), ("l_shipdate", "datetime"), ("l_linenumber", "integer")]


@query(_profile_sql("orders", ORDERS) + " UNION ALL " + _profile_sql(LINEITEM, LINES))
def profile_columns(spark, sf_dir):
    return profile_frame(table(spark, sf_dir, "orders")).unionByName(profile_frame(lineitem(spark, sf_dir).select(*(c for c, _ in LINES))))


KIND_CASE = "CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date' WHEN data_type = 'BOOLEAN' THEN 'logical' WHEN data_type = 'VARCHAR' THEN 'character' WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer' WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'numeric' ELSE 'other' END"


@query(f"SELECT table_name AS tab, column_name AS col, {KIND_CASE} AS kind FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'events', 'embeddings', 'customer')")
def kind_classification(spark, sf_dir):
    from .functions.kinds import kinds

    rows = [(t, c, k) for t in ("orders", "lineitem", "events", "embeddings", "customer") for c, k in kinds(table(spark, sf_dir, t)).items()]
    return spark.createDataFrame(rows, "tab string, col string, kind string")


@query("""
WITH p AS (SELECT 'c_custkey' AS col, 'integer' AS kind, NULL AS share UNION ALL SELECT 'contact_name', 'character', (SELECT count(DISTINCT c_name) / count(*) FROM customer) UNION ALL SELECT 'site', 'integer', NULL
 UNION ALL SELECT 'yield', 'numeric', NULL UNION ALL SELECT 'genotype', 'character', (SELECT count(DISTINCT c_mktsegment) / count(*) FROM customer) UNION ALL SELECT 'note', 'character', (SELECT count(DISTINCT c_name) / count(*) FROM customer) UNION ALL SELECT 'cust_id', 'integer', NULL)
SELECT col, kind, role, CASE role WHEN 'design' THEN 'keep' WHEN 'treatment' THEN 'alias' WHEN 'outcome' THEN 'scramble' WHEN 'covariate' THEN CASE WHEN kind = 'character' THEN 'alias' ELSE 'scramble' END ELSE 'drop' END AS action FROM (
 SELECT *, CASE WHEN col LIKE '%contact%' THEN 'text' WHEN col LIKE '%\\_id' ESCAPE '\\' THEN 'id' WHEN col = 'site' THEN 'design' WHEN col LIKE '%genotype%' THEN 'treatment' WHEN col = 'yield' THEN 'outcome' WHEN share > 0.5 THEN 'text' ELSE 'covariate' END AS role FROM p)
""")
def propose_roles_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    df = c.select("c_custkey", F.col("c_name").alias("contact_name"), F.col("c_nationkey").alias("site"), F.col("c_acctbal").alias("yield"), F.col("c_mktsegment").alias("genotype"), F.col("c_name").alias("note"), F.col("c_custkey").alias("cust_id"))
    return propose(df, "collaborate", detect=False).to_df(spark).select("col", "kind", "role", "action")


@query("""
SELECT r.role, a.action, k.kind, a.action IN ('keep', 'drop') OR (k.kind <> 'other' AND CASE r.role || '/' || a.action
 WHEN 'design/alias' THEN k.kind IN ('factor', 'character', 'logical') WHEN 'treatment/scramble' THEN k.kind IN ('factor', 'character', 'logical', 'numeric', 'integer') WHEN 'treatment/alias' THEN k.kind IN ('factor', 'character', 'logical', 'numeric', 'integer')
 WHEN 'outcome/scramble' THEN k.kind IN ('numeric', 'integer') WHEN 'covariate/scramble' THEN TRUE WHEN 'covariate/alias' THEN k.kind IN ('factor', 'character', 'logical') WHEN 'date/scramble' THEN k.kind IN ('date', 'datetime')
 WHEN 'id/alias' THEN k.kind IN ('factor', 'character', 'numeric', 'integer') WHEN 'text/scramble' THEN TRUE WHEN 'text/alias' THEN k.kind IN ('factor', 'character') ELSE FALSE END) AS valid
FROM (VALUES ('design'), ('treatment'), ('outcome'), ('covariate'), ('date'), ('id'), ('text'), ('other')) r(role), (VALUES ('keep'), ('scramble'), ('alias'), ('drop')) a(action), (VALUES ('factor'), ('character'), ('logical'), ('numeric'), ('integer'), ('date'), ('datetime'), ('other')) k(kind)
""")
def role_options_grid(spark, sf_dir):
    from .functions.patterns import KINDS

    rows = [(r["role"], r["action"], k, k in r["kinds"].split(", ")) for r in role_options() for k in KINDS]
    return spark.createDataFrame(rows, "role string, action string, kind string, valid boolean")


# --- hygiene

SPACED = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '  ' || p_name || chr(9) WHEN p_partkey % 11 = 0 THEN p_name || ' ' ELSE p_name END AS p_name, p_type FROM part)"


def spaced(spark, sf_dir):
    name = F.expr("CASE WHEN p_partkey % 7 = 0 THEN concat('  ', p_name, char(9)) WHEN p_partkey % 11 = 0 THEN concat(p_name, ' ') ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("p_name"), "p_type")


@query(f"SELECT p_partkey, trim(p_name, ' ' || chr(9)) AS p_name, trim(p_type, ' ' || chr(9)) AS p_type FROM {SPACED}")
def trim_labels(spark, sf_dir):
    return hygiene.clean(spaced(spark, sf_dir)).data


@query(f"SELECT DISTINCT 'p_name' AS col, p_name AS original, trim(p_name, ' ' || chr(9)) AS fixed FROM {SPACED} WHERE p_name <> trim(p_name, ' ' || chr(9))")
def trim_fix_map(spark, sf_dir):
    return hygiene.trim_fixes(spaced(spark, sf_dir), ["p_name", "p_type"])


@query("SELECT p_partkey AS Part_Key, p_name AS X1st_name, p_size AS size__cm_ FROM part")
def legalise_names(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" Part Key"), F.col("p_name").alias("1st name"), F.col("p_size").alias("size (cm)"))
    return df.withColumnsRenamed(hygiene.legal_names(df.columns))


#: Labels of p_name with a changed case, a lost or changed letter and a changed digit on some rows.
DIRTY = "(SELECT p_partkey AS rid, CASE WHEN p_partkey % 13 = 0 THEN upper(p_name) WHEN p_partkey % 17 = 0 THEN substr(p_name, 1, length(p_name) - 1) WHEN p_partkey % 19 = 0 THEN substr(p_name, 1, 2) || 'x' || substr(p_name, 4) WHEN p_partkey % 23 = 0 THEN p_name || '1' WHEN p_partkey % 29 = 0 THEN p_name || '2' ELSE p_name END AS label FROM part)"


def dirty(spark, sf_dir):
    label = "CASE WHEN p_partkey % 13 = 0 THEN upper(p_name) WHEN p_partkey % 17 = 0 THEN substr(p_name, 1, length(p_name) - 1) WHEN p_partkey % 19 = 0 THEN concat(substr(p_name, 1, 2), 'x', substr(p_name, 4)) WHEN p_partkey % 23 = 0 THEN concat(p_name, '1') WHEN p_partkey % 29 = 0 THEN concat(p_name, '2') ELSE p_name END"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("__rid"), F.expr(label).alias("label"))


NEAR = f"""
n AS (SELECT label, count(*) AS n, min(rid) AS first FROM {DIRTY} GROUP BY label),
p AS (SELECT x.label AS a, y.label AS b, x.n AS n_a, y.n AS n_b, x.first AS first_a, y.first AS first_b, CASE WHEN length(x.label) <= length(y.label) THEN x.label ELSE y.label END AS s, CASE WHEN length(x.label) <= length(y.label) THEN y.label ELSE x.label END AS l
 FROM n x JOIN n y ON x.label < y.label AND (lower(x.label) = lower(y.label) OR levenshtein(x.label, y.label) = 1)),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, length(s) + 1), lambda i: substr(s, CAST(i AS INT), 1) <> substr(l, CAST(i AS INT), 1))), length(s) + 1)::INT AS spot FROM p),
near AS (SELECT *, CASE WHEN lower(a) = lower(b) THEN 'case' WHEN NOT (regexp_matches(substr(l, spot, 1), '[0-9]') OR (length(s) = length(l) AND regexp_matches(substr(s, spot, 1), '[0-9]'))) THEN 'edit1' END AS kind FROM q)
"""


@query(f"WITH {NEAR} SELECT 'label' AS col, a, b, kind FROM near WHERE kind IS NOT NULL")
def near_duplicate_labels(spark, sf_dir):
    return hygiene.near_duplicates(hygiene.label_counts(dirty(spark, sf_dir), ["label"]))


DECIDED = f"""{NEAR},
won AS (SELECT *, CASE WHEN kind = 'edit1' AND least(length(a), length(b)) < 4 THEN NULL WHEN kind = 'edit1' AND n_a = n_b THEN NULL WHEN n_a > n_b OR (n_a = n_b AND first_a < first_b) THEN a ELSE b END AS won,
 CASE WHEN kind = 'edit1' AND least(length(a), length(b)) < 4 THEN 'short' WHEN kind = 'edit1' AND n_a = n_b THEN 'tie' ELSE 'merged' END AS reason FROM near WHERE kind IS NOT NULL),
decided AS (SELECT 'label' AS col, a, b, kind, n_a, n_b, CASE WHEN won = a THEN b WHEN won = b THEN a END AS "from", won AS "to", reason FROM won)
"""


@query(f"WITH {DECIDED} SELECT * FROM decided")
def merge_decisions(spark, sf_dir):
    return hygiene.merge_decisions(hygiene.label_counts(dirty(spark, sf_dir), ["label"]))


CLOSURE = f"""RECURSIVE {DECIDED},
edges AS (SELECT DISTINCT "from" AS f, "to" AS t FROM decided WHERE "to" IS NOT NULL),
walk(f, t) AS (SELECT f, t FROM edges UNION SELECT w.f, e.t FROM walk w JOIN edges e ON w.t = e.f),
ends AS (SELECT f, list_sort(list(DISTINCT t)) AS ends FROM walk WHERE t NOT IN (SELECT f FROM edges) GROUP BY f)
"""


@query(f"""WITH {CLOSURE} SELECT 'label' AS col, f AS "from", array_to_string(ends, ' | ') AS "to", len(ends) > 1 AS ambiguous FROM ends""")
def merge_closure(spark, sf_dir):
    decided = hygiene.merge_decisions(hygiene.label_counts(dirty(spark, sf_dir), ["label"]))
    return hygiene.merge_closure(decided.where("to IS NOT NULL"))


@query(f"WITH {CLOSURE} SELECT d.rid AS __rid, coalesce(CASE WHEN len(e.ends) = 1 THEN e.ends[1] END, d.label) AS label FROM {DIRTY} d LEFT JOIN ends e ON d.label = e.f")
def apply_merge_map(spark, sf_dir):
    return hygiene.apply_merges(dirty(spark, sf_dir), "label", merge_closure(spark, sf_dir))


@query("""
WITH t AS (SELECT CAST(o_totalprice AS VARCHAR) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, 'x' || o_orderkey AS code FROM orders),
l AS (SELECT 'price' AS col, price AS v FROM t UNION ALL SELECT 'day', day FROM t UNION ALL SELECT 'status', status FROM t UNION ALL SELECT 'code', code FROM t),
c AS (SELECT col, count(v) AS n, count(DISTINCT v) AS n_values, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AS all_numeric, bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(v AS DATE) IS NOT NULL) AS all_dates FROM l GROUP BY col)
SELECT *, CASE WHEN all_numeric THEN 'numeric' WHEN all_dates THEN 'date' WHEN n_values <= 20 AND n_values < n THEN 'factor' ELSE 'text' END AS type FROM c
""")
def infer_storage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    return hygiene.infer_storage(o.select(price.alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("code")))


SQL["infer_storage"] = SQL["infer_storage"].replace("CAST(o_totalprice AS VARCHAR)", "printf('%.2f', o_totalprice)")

# --- names, aliases and permutations


@query("SELECT c_custkey AS col_001, c_nationkey AS col_002, c_mktsegment AS col_003 FROM customer")
def alias_column_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").drop("c_name", "c_acctbal")
    return c.withColumnsRenamed(alias.alias_names(c.columns, True))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    plan = propose(c, "local", detect=False).set(["c_name", "c_acctbal"], action="drop").set(["c_custkey", "c_nationkey", "c_mktsegment"], action="keep")
    return mask(c, plan, seed=SEED, key=["c_custkey"]).data


def _aliased(spark, sf_dir, col, prefix):
    o = table(spark, sf_dir, "orders").select("o_orderkey", col)
    return alias.translate(o, col, alias.alias_map(alias.levels(o, col), prefix, SEED, col))


def _alias_query(col: str, prefix: str) -> str:
    return f"SELECT o.o_orderkey, m.alias AS {col} FROM orders o LEFT JOIN {alias_sql('orders', col, prefix, col)} m ON o.{col} = m.original"


@query(_alias_query("o_orderpriority", "trt_"))
def alias_treatment(spark, sf_dir):
    return _aliased(spark, sf_dir, "o_orderpriority", "trt_")


@query(_alias_query("o_custkey", "o_custkey_I"))
def alias_id(spark, sf_dir):
    return _aliased(spark, sf_dir, "o_custkey", "o_custkey_I")


@query(f"SELECT o.o_orderkey, m.alias AS o_orderstatus FROM orders o JOIN {permuted_sql('orders', 'o_orderkey', 'o_orderstatus')} p ON o.o_orderkey = p.rid JOIN {alias_sql('orders', 'o_orderstatus', 'o_orderstatus_L', 'o_orderstatus')} m ON p.v = m.original")
def alias_covariate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    moved = permute.permute_rows(o, "o_orderstatus", "o_orderkey", SEED)
    return alias.translate(moved, "o_orderstatus", alias.alias_map(alias.levels(o, "o_orderstatus"), "o_orderstatus_L", SEED, "o_orderstatus"))


@query(f"SELECT o.o_orderkey, p.v AS o_orderdate FROM orders o JOIN {permuted_sql('orders', 'o_orderkey', 'o_orderdate')} p ON o.o_orderkey = p.rid")
def permute_rows(spark, sf_dir):
    return permute.permute_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", SEED)


@query(f"SELECT l.rid, p.v AS l_tax FROM {LINEITEM} l LEFT JOIN {permuted_sql(LINEITEM, 'rid', 'l_tax', 'l_returnflag')} p USING (rid)")
def permute_rows_with_nulls(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("rid", "l_tax", "l_returnflag")
    return permute.permute_rows(rows, "l_tax", "rid", SEED, strata=["l_returnflag"]).drop("l_returnflag")


@query(f"""
WITH v AS (SELECT DISTINCT o_orderpriority AS v FROM orders), a AS (SELECT v, row_number() OVER (ORDER BY {digest_sql(SEED, 'labels-from:o_orderpriority', 'v')}) AS k FROM v), b AS (SELECT v AS w, row_number() OVER (ORDER BY {digest_sql(SEED, 'labels-to:o_orderpriority', 'v')}) AS k FROM v)
SELECT o_orderkey, w AS o_orderpriority FROM orders JOIN a ON o_orderpriority = v JOIN b USING (k)
""")
def permute_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return alias.translate(o, "o_orderpriority", alias.permuted_map(alias.levels(o, "o_orderpriority"), SEED, "o_orderpriority"))


# --- the whole clone and its recipe


def orders_plan(spark, sf_dir, mode="local"):
    o = table(spark, sf_dir, "orders")
    plan = propose(o, mode, detect=False).set("o_orderkey", "id", "keep").set("o_custkey", "design", "keep").set("o_orderpriority", "treatment", "alias")
    return o, plan.set("o_orderstatus", "covariate", "scramble").set("o_orderdate", "date", "scramble").set("o_totalprice", "outcome", "scramble")


CLONE = f"""(SELECT o.o_orderkey, o.o_custkey, s.v AS o_orderstatus, t.v AS o_totalprice, d.v AS o_orderdate, m.alias AS o_orderpriority FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS rid FROM orders) o
JOIN {permuted_sql('(SELECT *, CAST(o_orderkey AS VARCHAR) AS rid FROM orders)', 'rid', 'o_orderstatus')} s USING (rid)
JOIN {permuted_sql('(SELECT *, CAST(o_orderkey AS VARCHAR) AS rid FROM orders)', 'rid', 'o_orderdate')} d USING (rid)
JOIN {drawn_sql('(SELECT *, CAST(o_orderkey AS VARCHAR) AS rid FROM orders)', 'rid', 'o_totalprice', uniform_sql(SEED, 'copula:o_totalprice', 'rid'))} t USING (rid)
JOIN {alias_sql('orders', 'o_orderpriority', 'trt_', 'o_orderpriority')} m ON o.o_orderpriority = m.original)"""


def orders_clone(spark, sf_dir, mode="local"):
    o, plan = orders_plan(spark, sf_dir, mode)
    return mask(o, plan, seed=SEED, key=["o_orderkey"], use_grain=False)


@query(f"SELECT * FROM {CLONE}")
def masked_orders(spark, sf_dir):
    return orders_clone(spark, sf_dir).data


@query(f"SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, m.alias AS o_orderpriority FROM orders o JOIN {alias_sql('orders', 'o_orderpriority', 'trt_', 'o_orderpriority')} m ON o.o_orderpriority = m.original")
def apply_recipe_forward(spark, sf_dir):
    return orders_clone(spark, sf_dir).recipe.forward(table(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def unmask_roundtrip(spark, sf_dir):
    recipe = orders_clone(spark, sf_dir).recipe
    return recipe.inverse(recipe.forward(table(spark, sf_dir, "orders")))


@query(f"SELECT sha2 AS integrity FROM (SELECT sha256(concat_ws(',', 'l_quantity|l_tax', CAST(count(*) AS VARCHAR), CAST(CAST(sum(('0x' || substr(md5(concat_ws('|', '', CASE WHEN l_quantity IS NULL THEN '1' ELSE '0' END || CASE WHEN l_tax IS NULL THEN '1' ELSE '0' END)), 1, 12))::UBIGINT::HUGEINT) AS DECIMAL(38,0)) AS VARCHAR), CAST(count(*) - count(l_quantity) AS VARCHAR), CAST(count(*) - count(l_tax) AS VARCHAR))) AS sha2 FROM {LINEITEM})")
def na_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(fingerprint(lineitem(spark, sf_dir).select("l_quantity", "l_tax")),)], "integrity string")


# --- numeric resimulation


def ranked_sql(source: str, col: str, by: str = "1") -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {col} IS NULL ORDER BY {col}) + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0) / (count({col}) OVER (PARTITION BY {by}) + 1) END"


@query(f"SELECT rid, round({qnorm('u')}, 6) AS z FROM (SELECT rid, {ranked_sql(LINEITEM, 'l_tax')} AS u FROM {LINEITEM})")
def normal_scores(spark, sf_dir):
    z = copula.normal_scores(lineitem(spark, sf_dir).select("rid", "l_tax"), ["l_tax"])
    return z.select("rid", F.round("z_l_tax", 6).alias("z"))


SCORES = f"(SELECT rid, l_returnflag, l_quantity, l_extendedprice, {qnorm('u1')} AS z1, {qnorm('u2')} AS z2 FROM (SELECT rid, l_returnflag, l_quantity, l_extendedprice, {ranked_sql('', 'l_quantity')} AS u1, {ranked_sql('', 'l_extendedprice')} AS u2 FROM {LINEITEM}))"


@query(f"SELECT round(covar_samp(z1, z1), 6) AS v11, round(covar_samp(z1, z2), 6) AS v12, round(covar_samp(z2, z2), 6) AS v22 FROM {SCORES}")
def score_covariance(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice"]
    rows = copula.normal_scores(lineitem(spark, sf_dir).select("rid", *cols), cols).withColumn("g", F.lit(1))
    return copula.score_covariance(rows, cols, ["g"]).select(F.round(F.col("cov")[0], 6).alias("v11"), F.round(F.col("cov")[1], 6).alias("v12"), F.round(F.col("cov")[3], 6).alias("v22"))


@query(f"SELECT o.o_orderkey, t.v AS o_totalprice FROM orders o JOIN {drawn_sql('orders', 'o_orderkey', 'o_totalprice', uniform_sql(SEED, 'copula:o_totalprice', 'o_orderkey'))} t ON o.o_orderkey = t.rid")
def copula_univariate(spark, sf_dir):
    return copula.resimulate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey", SEED)


@query(f"SELECT l.rid, t.v AS l_tax FROM {LINEITEM} l LEFT JOIN {drawn_sql(LINEITEM, 'rid', 'l_tax', uniform_sql(SEED, 'copula:l_tax', 'rid'), 'l_returnflag')} t USING (rid)")
def copula_conditional(spark, sf_dir):
    rows = copula.strata(lineitem(spark, sf_dir).select("rid", "l_tax", "l_returnflag"), ["l_returnflag"])
    return copula.resimulate(rows, ["l_tax"], "rid", SEED, by=["__stratum"]).select("rid", "l_tax")


JOINT = f"""
s AS (SELECT * FROM {SCORES}), r AS (SELECT round(greatest(-1, least(1, covar_samp(z1, z2) / (sqrt(covar_samp(z1, z1)) * sqrt(covar_samp(z2, z2))))), 10) AS r FROM s),
e AS (SELECT rid, l_quantity, l_extendedprice, {qnorm('ua')} AS e1, {qnorm('ub')} AS e2 FROM (SELECT *, {uniform_sql(SEED, 'copula:l_quantity', 'rid')} AS ua, {uniform_sql(SEED, 'copula:l_extendedprice', 'rid')} AS ub FROM s)),
w AS (SELECT rid, l_quantity, l_extendedprice, e1 AS w1, r * e1 + sqrt(1 - r * r) * e2 AS w2 FROM e, r),
n AS (SELECT rid, l_quantity, l_extendedprice, {pnorm('w1')} AS n1, {pnorm('w2')} AS n2 FROM w)
"""


@query(f"WITH {JOINT} SELECT n.rid, a.v AS l_quantity, b.v AS l_extendedprice FROM n JOIN {drawn_sql('n', 'rid', 'l_quantity', 'n1')} a USING (rid) JOIN {drawn_sql('n', 'rid', 'l_extendedprice', 'n2')} b USING (rid)")
def copula_joint(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice"]
    return copula.resimulate(lineitem(spark, sf_dir).select("rid", *cols), cols, "rid", SEED)


@query("SELECT 'status' AS rung, round(sum(CASE WHEN n < 5 THEN n ELSE 0 END) / sum(n), 6) AS fallback FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) UNION ALL SELECT 'customer', round(sum(CASE WHEN n < 5 THEN n ELSE 0 END) / sum(n), 6) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT 'both', round(sum(CASE WHEN n < 5 THEN n ELSE 0 END) / sum(n), 6) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")
def stratum_ladder_counts(spark, sf_dir):
    shares = conditional.fallback_shares(table(spark, sf_dir, "orders"), [["o_orderstatus"], ["o_custkey"], ["o_custkey", "o_orderstatus"]])
    return spark.createDataFrame([(k, round(s, 6)) for k, s in zip(("status", "customer", "both"), shares, strict=True)], "rung string, fallback double")


def _eta_sql(col: str) -> str:
    return f"SELECT '{col}' AS col, round(CASE WHEN q - s * s / n > 0 AND k < n THEN greatest(0, 1 - (1 - (b - s * s / n) / (q - s * s / n)) * (n - 1) / (n - k)) ELSE 0 END, 6) AS eta2 FROM (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM (SELECT count(*) AS n, sum({col}) AS s, sum({col} * {col}) AS q FROM orders GROUP BY o_custkey))"


@query(_eta_sql("o_totalprice") + " UNION ALL " + _eta_sql("o_orderkey"))
def variance_explained(spark, sf_dir):
    return conditional.variance_explained(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"]).select("col", F.round("eta2", 6).alias("eta2"))


@query(f"""
WITH c AS (SELECT l_returnflag AS k, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1),
f AS (SELECT k, n, s, q, s / n - first_value(s / n) OVER (ORDER BY k) AS effect, sum(n) OVER () AS total, count(*) OVER () AS levels, sum(q) OVER () - sum(s * s / n) OVER () AS sse FROM c),
t AS (SELECT *, sse / (total - levels) / (total / levels) AS noise, var_samp(effect) OVER () AS spread FROM f)
SELECT k AS level, round(CASE WHEN spread > noise THEN (spread - noise) / spread ELSE 0 END * effect, 6) AS effect FROM t
""")
def design_shift_effects(spark, sf_dir):
    effects, _ = conditional.shift_effects(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in effects["l_returnflag"].items()], "level string, effect double")


@query(f"""
SELECT 'l_tax' AS col, round(min(g), 6) AS resolution, (SELECT count(DISTINCT l_tax) FROM {LINEITEM}) AS n_distinct FROM (SELECT lead(v) OVER (ORDER BY v) - v AS g FROM (SELECT DISTINCT l_tax AS v FROM {LINEITEM} WHERE l_tax IS NOT NULL))
UNION ALL SELECT 'l_quantity', 1.0, count(DISTINCT l_quantity) FROM lineitem
""")
def resolution(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    parts = [jitter.resolution(rows, c).select(F.lit(c).alias("col"), F.round("resolution", 6).alias("resolution"), "n_distinct") for c in ("l_tax", "l_quantity")]
    return parts[0].unionByName(parts[1])


U_JIT, U_RND = uniform_sql(SEED, "jitter:c_acctbal", "c_custkey"), uniform_sql(SEED, "round:c_acctbal", "c_custkey")


@query(f"WITH r AS (SELECT greatest(min(g), (max(v) - min(v)) * 1e-8) AS res FROM (SELECT v, lead(v) OVER (ORDER BY v) - v AS g FROM (SELECT DISTINCT c_acctbal AS v FROM customer))) SELECT c_custkey, round(c_acctbal + ({U_JIT} - 0.5) * res, 6) AS c_acctbal FROM customer, r")
def jitter_within_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return jitter.jitter(c, "c_acctbal", "c_custkey", SEED, c).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"SELECT c_custkey, CAST(floor(c_acctbal) + CASE WHEN {U_RND} < c_acctbal - floor(c_acctbal) THEN 1 ELSE 0 END AS BIGINT) AS c_acctbal FROM customer")
def stochastic_round(spark, sf_dir):
    return jitter.stochastic_round(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", SEED)


@query(f"SELECT count(*) AS n_rows, TRUE AS same_nulls, TRUE AS same_values FROM {LINEITEM}")
def na_mask_preserved(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("rid", "l_tax", "l_returnflag")
    plan = propose(rows, "local", detect=False).set("rid", "id", "keep").set("l_tax", "outcome", "scramble").set("l_returnflag", "covariate", "scramble")
    done = mask(rows, plan, seed=SEED, key=["rid"], use_grain=False).data
    both = rows.alias("o").join(done.alias("c"), "rid")
    seen = rows.select("l_tax").distinct().withColumnRenamed("l_tax", "seen")
    both = both.join(seen, F.col("c.l_tax") == F.col("seen"), "left")
    return both.agg(F.count("*").alias("n_rows"), F.bool_and(F.col("o.l_tax").isNull() == F.col("c.l_tax").isNull()).alias("same_nulls"), F.bool_and(F.col("c.l_tax").isNull() | F.col("seen").isNotNull()).alias("same_values"))


# --- grain, events, coordinates

GRAINED = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)"


def grained(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "c_mktsegment", "c_acctbal")


def _unit_sql(name: str, keys: str) -> str:
    return f"SELECT '{name}' AS unit, count(*) AS groups, bool_and(a) AS c_mktsegment, bool_and(b) AS c_acctbal, bool_and(c) AS o_totalprice FROM (SELECT min(c_mktsegment) IS NOT DISTINCT FROM max(c_mktsegment) AS a, min(c_acctbal) IS NOT DISTINCT FROM max(c_acctbal) AS b, min(o_totalprice) IS NOT DISTINCT FROM max(o_totalprice) AS c FROM {GRAINED} GROUP BY {keys})"


@query(" UNION ALL ".join((_unit_sql("o_custkey", "o_custkey"), _unit_sql("o_orderstatus", "o_orderstatus"), _unit_sql("o_custkey:o_orderstatus", "o_custkey, o_orderstatus"))))
def grain_units(spark, sf_dir):
    return incidence.constant_within(grained(spark, sf_dir), grain.units_of(["o_custkey", "o_orderstatus"]), ["c_mktsegment", "c_acctbal", "o_totalprice"])


UNITS = f"(SELECT CAST(o_custkey AS VARCHAR) AS rid, any_value(c_acctbal) AS c_acctbal, any_value(c_mktsegment) AS c_mktsegment FROM {GRAINED} GROUP BY o_custkey)"


@query(f"SELECT g.o_orderkey, a.v AS c_acctbal, s.v AS c_mktsegment FROM {GRAINED} g JOIN {drawn_sql(UNITS, 'rid', 'c_acctbal', uniform_sql(SEED, 'grain:o_custkey:c_acctbal', 'rid'))} a ON CAST(o_custkey AS VARCHAR) = a.rid JOIN {permuted_sql(UNITS, 'rid', 'c_mktsegment', '', 'grain:c_mktsegment')} s ON a.rid = s.rid")
def grain_broadcast(spark, sf_dir):
    g = grain.Grain(("o_custkey",), ("c_acctbal", "c_mktsegment"), 0)
    return grain.synthesise(grained(spark, sf_dir), g, "o_orderkey", SEED).select("o_orderkey", "c_acctbal", "c_mktsegment")


def timed(spark, sf_dir):
    """Recurrence and death derived from customers: times in days, statuses 0 and 1."""
    c = table(spark, sf_dir, "customer")
    rec = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 97 + 1).otherwise(F.col("c_custkey") % 401 + 10)
    death = rec + F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 211 + 1).otherwise(F.lit(0))
    return c.select("c_custkey", "c_mktsegment", rec.cast("bigint").alias("t1"), (F.col("c_custkey") % 3 == 0).cast("int").alias("s1"), death.cast("bigint").alias("t2"), (F.col("c_custkey") % 6 == 0).cast("int").alias("s2"))


TIMED = "(SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 + 1 ELSE c_custkey % 401 + 10 END AS t1, CAST(c_custkey % 3 = 0 AS INT) AS s1, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 + 1 + c_custkey % 211 + 1 ELSE c_custkey % 401 + 10 END AS t2, CAST(c_custkey % 6 = 0 AS INT) AS s2 FROM customer)"
SPEC = events.EventSpec(("t1", "t2"), ("s1", "s2"))


@query(f"SELECT c_custkey, t1 AS g1, t2 - t1 AS g2 FROM {TIMED}")
def event_gaps(spark, sf_dir):
    g = events.gaps(timed(spark, sf_dir), SPEC.time)
    return timed(spark, sf_dir).select("c_custkey", g[0].alias("g1"), g[1].alias("g2"))


@query(f"SELECT s1 || '/' || s2 AS pattern, count(*) AS n FROM {TIMED} GROUP BY 1")
def event_patterns(spark, sf_dir):
    done, _ = events.synthesise(timed(spark, sf_dir), SPEC, "c_custkey", SEED, ["c_mktsegment"])
    return done.groupBy(events.pattern(SPEC.status).alias("pattern")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, 0 AS out_of_order, 0 AS over_cap, sum(CAST(s1 = 0 AS INT)) AS no_gap FROM {TIMED}")
def events_resynth_invariants(spark, sf_dir):
    own = timed(spark, sf_dir)
    done, _ = events.synthesise(own, SPEC, "c_custkey", SEED)
    most = own.agg(F.max("t2").alias("most"))
    told = done.crossJoin(F.broadcast(most))
    return told.agg(F.count("*").alias("n"), F.sum((F.col("t2") < F.col("t1")).cast("int")).alias("out_of_order"), F.sum((F.col("t2") > F.col("most")).cast("int")).alias("over_cap"), F.sum((F.col("t1") == F.col("t2")).cast("int")).alias("no_gap"))


def placed(spark, sf_dir):
    """Customers with the coordinates of their nation's two sites."""
    c = table(spark, sf_dir, "customer")
    site = F.concat_ws("-", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 2).cast("string"))
    lat, lon = F.col("c_nationkey") * 2.12345 - 30 + (F.col("c_custkey") % 2) * 0.51234, F.col("c_nationkey") * 5.54321 - 70
    missing = F.col("c_custkey") % 50 == 7
    return c.select("c_custkey", F.col("c_nationkey").cast("string").alias("state"), site.alias("site"), F.when(~missing, F.round(lat, 5)).alias("lat"), F.round(lon, 5).alias("lon"))


PLACED = "(SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS state, concat_ws('-', c_nationkey, c_custkey % 2) AS site, CASE WHEN c_custkey % 50 <> 7 THEN round(c_nationkey * 2.12345 - 30 + (c_custkey % 2) * 0.51234, 5) END AS lat, round(c_nationkey * 5.54321 - 70, 5) AS lon FROM customer)"
GU, GV = uniform_sql(SEED, "geo:lat:lon:radius", "site || '#1'"), uniform_sql(SEED, "geo:lat:lon:bearing", "site || '#1'")
MOVED = f"(SELECT site, lat + r * cos(b) / 111.32 AS y, lon + r * sin(b) / (111.32 * cos(radians(lat))) AS x FROM (SELECT site, avg(lat) AS lat, avg(lon) AS lon, sqrt(25 + {GU} * 375) AS r, {GV} * 6.283185307179586 AS b FROM {PLACED} WHERE lat IS NOT NULL GROUP BY site))"
GEO = geo.CoordSpec("lat", "lon", "site")


@query(f"SELECT p.c_custkey, CASE WHEN lat IS NOT NULL THEN round(y, 3) END AS lat, CASE WHEN lat IS NOT NULL THEN round(x, 3) END AS lon FROM {PLACED} p JOIN {MOVED} m USING (site)")
def geomask_sites(spark, sf_dir):
    return geo.geomask(placed(spark, sf_dir), GEO, SEED).select("c_custkey", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@query("SELECT count(DISTINCT c_nationkey || '-' || c_custkey % 2) AS sites, TRUE AS near_enough, TRUE AS far_enough FROM customer WHERE c_custkey % 50 <> 7")
def geomask_donut_bounds(spark, sf_dir):
    own = placed(spark, sf_dir)
    done = geo.geomask(own, GEO, SEED)
    both = own.alias("o").join(done.alias("c"), "c_custkey").where("o.lat IS NOT NULL")
    north, east = (F.col("c.lat") - F.col("o.lat")) * geo.KM, (F.col("c.lon") - F.col("o.lon")) * geo.KM * F.cos(F.radians(F.col("o.lat")))
    km = F.sqrt(north * north + east * east)
    return both.agg(F.count_distinct("o.site").alias("sites"), F.bool_and(km < 20.01).alias("near_enough"), F.bool_and(km > 4.99).alias("far_enough"))


@query(f"SELECT site, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM {PLACED} WHERE lat IS NOT NULL GROUP BY site")
def geo_consolidate(spark, sf_dir):
    return geo.sites(placed(spark, sf_dir), GEO, None).select(F.col("__site").alias("site"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query("SELECT c_nationkey::VARCHAR AS state, count(*) AS n, sum(CAST(c_custkey % 50 = 7 AS INT)) AS missing, TRUE AS near FROM customer GROUP BY 1")
def reanchor_sites(spark, sf_dir):
    own = placed(spark, sf_dir)
    centres = {str(i): (float(i) - 40, 3.0 * i - 60) for i in range(25)}
    done = geo.reanchor(own, own, "state", "lat", "lon", centres, "c_custkey", SEED)
    near = (F.abs(F.col("lat") - (F.col("state").cast("double") - 40)) <= 0.651) & (F.abs(F.col("lon") - (F.col("state").cast("double") * 3 - 60)) <= 0.651)
    return done.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.col("lat").isNull().cast("int")).alias("missing"), F.bool_and(F.coalesce(near, F.lit(True))).alias("near"))


@query(f"SELECT col FROM (SELECT col, count(DISTINCT v) AS d, max(abs(v)) AS m, bool_and(v = round(v)) AS whole, bool_or(abs(v * 1000 - round(v * 1000)) > 1e-6) AS fine FROM (SELECT 'lat' AS col, lat AS v FROM {PLACED} UNION ALL SELECT 'lon', lon FROM {PLACED}) WHERE v IS NOT NULL GROUP BY col) WHERE d >= 3 AND m > 1 AND m <= 180 AND fine AND NOT whole")
def coord_shape_detect(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in coordinate_shaped(placed(spark, sf_dir))], "col string")


# --- links


def linked(spark, sf_dir):
    return {"documents": table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "labels": table(spark, sf_dir, "labels")}


@query("SELECT 'doc_id' AS col WHERE EXISTS (SELECT 1 FROM documents JOIN labels USING (doc_id))")
def link_detection(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in maskset.detect_links(linked(spark, sf_dir))], "col string")


LINK = alias_sql("(SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)", "doc_id", "doc_id_K", "doc_id", SEED + "#links")


@query(f"SELECT * FROM {LINK}")
def shared_alias_maps(spark, sf_dir):
    return maskset.shared_maps(linked(spark, sf_dir), ["doc_id"], SEED)["doc_id"]


@query(f"SELECT m.alias AS doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id) JOIN {LINK} m ON doc_id = original")
def linked_join_preserved(spark, sf_dir):
    tables = linked(spark, sf_dir)
    plans = {n: propose(t, "local", detect=False).set([c for c in t.columns if c != "doc_id"], action="keep").set("doc_id", "id", "alias") for n, t in tables.items()}
    done = maskset.mask_set(tables, plans, seed=SEED, keys={"documents": ["doc_id"], "labels": ["doc_id"]})
    return done.clones["documents"].data.join(done.clones["labels"].data, "doc_id").select("doc_id", "n_chars", "quality")


# --- designs and environments


def plots(spark, sf_dir):
    """Trials of market segments at nations: three full blocks at the even ones, and as customers fall at the odd ones."""
    c = table(spark, sf_dir, "customer")
    full = c.where("c_nationkey % 2 = 0").select("c_nationkey", "c_mktsegment").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3))))
    rest = c.where("c_nationkey % 2 = 1").select("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 3 + 1).cast("int").alias("rep"))
    return full.unionByName(rest).select(F.col("c_nationkey").alias("site"), "rep", F.col("c_mktsegment").alias("genotype"))


TRIAL = "(SELECT c_nationkey AS site, rep, c_mktsegment AS genotype FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey % 2 = 0), range(1, 4) t(rep) UNION ALL SELECT c_nationkey, c_custkey % 3 + 1, c_mktsegment FROM customer WHERE c_nationkey % 2 = 1)"


def _modal_sql(name: str, side: str, partner: str) -> str:
    return f"{name} AS (SELECT e, size AS mode, m / total AS share FROM (SELECT *, sum(m) OVER (PARTITION BY e) AS total, row_number() OVER (PARTITION BY e ORDER BY m DESC, size) AS i FROM (SELECT e, size, count(*) AS m FROM (SELECT e, count(DISTINCT {partner}) AS size FROM d GROUP BY e, {side}) GROUP BY ALL)) WHERE i = 1)"


def _designs_sql(rows: str) -> str:
    """WITH clauses from rows of e (slice), rep and genotype to judged, which has the scores, the design and its parts for each slice."""
    reps = "SELECT e, min(m) AS lo, greatest(0, 1 - coalesce(stddev_samp(m), 0) / avg(m)) AS balance FROM (SELECT e, {0}, count(*) AS m FROM d GROUP BY ALL) GROUP BY e"
    return f"""
WITH d AS {rows}, f AS (SELECT *, nb BETWEEN 2 AND greatest(2, ceil(sqrt(n))) AS fb, nt BETWEEN 2 AND greatest(2, n // 2) AS ft FROM (SELECT e, count(*) AS n, count(DISTINCT rep) AS nb, count(DISTINCT genotype) AS nt FROM d GROUP BY e)),
x AS (SELECT e, count(*) = count(DISTINCT rep) * count(DISTINCT genotype) AND min(m) = max(m) AS even FROM (SELECT e, rep, genotype, count(*) AS m FROM d GROUP BY ALL) GROUP BY e),
g AS ({reps.format('genotype')}), h AS ({reps.format('rep')}), {_modal_sql('k', 'rep', 'genotype')}, {_modal_sql('r', 'genotype', 'rep')},
scores AS (SELECT e, n, nt,
 CASE WHEN ft AND g.lo >= 2 THEN greatest(0, g.balance - CASE WHEN fb AND even THEN 0.6 ELSE 0 END) WHEN NOT ft AND fb AND h.lo >= 2 THEN h.balance ELSE 0 END AS crd, CASE WHEN ft AND fb AND even THEN 0.95 ELSE 0 END AS rcbd,
 CASE WHEN ft AND fb AND nb >= 3 AND k.mode BETWEEN 2 AND nt - 1 AND r.mode >= 2 AND k.share >= 0.9 AND r.share >= 0.9
  THEN least(1, 0.65 * (k.share + r.share) / 2 + CASE WHEN k.mode / nt < 0.9 THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN nt * r.mode = nb * k.mode THEN 0.15 ELSE 0 END) ELSE 0 END AS ibd
 FROM f JOIN x USING (e) JOIN g USING (e) JOIN h USING (e) JOIN k USING (e) JOIN r USING (e)),
named AS (SELECT *, CASE WHEN best < 0.5 THEN 'none' WHEN crd >= best - 0.02 THEN 'CRD' WHEN rcbd >= best - 0.02 THEN 'RCBD' ELSE 'IBD/alpha-lattice' END AS design FROM (SELECT *, greatest(crd, rcbd, ibd) AS best FROM scores)),
judged AS (SELECT *, CASE design WHEN 'CRD' THEN crd WHEN 'RCBD' THEN rcbd WHEN 'none' THEN best ELSE ibd END AS score, CASE WHEN design IN ('RCBD', 'IBD/alpha-lattice') THEN 'rep' ELSE '' END AS blocks FROM named)"""


POOLED = _designs_sql(f"(SELECT 0 AS e, rep, genotype FROM {TRIAL})")


@query("SELECT l_returnflag AS b, l_linestatus AS t, count(*) AS n FROM lineitem GROUP BY 1, 2")
def incidence_counts(spark, sf_dir):
    return incidence.incidence(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(POOLED + " SELECT 'CRD' AS rule, round(crd, 6) AS score FROM judged UNION ALL SELECT 'RCBD', round(rcbd, 6) FROM judged UNION ALL SELECT 'IBD/alpha-lattice', round(ibd, 6) FROM judged UNION ALL SELECT unnest(['factorial', 'row-column', 'split-plot']), 0 FROM judged")
def score_designs(spark, sf_dir):
    """Of the pooled trials; three rules need more columns than they have."""
    found = design.detect_design(plots(spark, sf_dir).drop("site"))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.scores.items()], "rule string, score double")


@query(POOLED + " SELECT design, CASE WHEN design = 'none' THEN '' ELSE 'genotype' END AS treatment, blocks FROM judged")
def pick_design(spark, sf_dir):
    found = design.detect_design(plots(spark, sf_dir).drop("site"))
    return spark.createDataFrame([(found.label, " + ".join(found.treatment), " : ".join(found.blocks))], "design string, treatment string, blocks string")


def _spread_sql(block: str, treatment: str) -> str:
    return f"SELECT '{block}' AS block, round(sqrt(greatest(0, (sq - c * m * m) / (c - 1))) / m, 6) AS cv FROM (SELECT sum(n) / (count(DISTINCT b) * count(DISTINCT t)) AS m, count(DISTINCT b) * count(DISTINCT t) AS c, sum(n * n) AS sq FROM (SELECT {block} AS b, {treatment} AS t, count(*) AS n FROM lineitem GROUP BY 1, 2))"


@query(_spread_sql("l_returnflag", "l_linestatus") + " UNION ALL " + _spread_sql("l_linenumber", "l_linestatus"))
def score_balance(spark, sf_dir):
    rows = []
    for b in ("l_returnflag", "l_linenumber"):
        r = incidence.cells(incidence.incidence(table(spark, sf_dir, "lineitem"), b, "l_linestatus")).first()
        rows.append((b, round(design.spread(r["n_b"] * r["n_t"], r["n_rows"], r["squares"]), 6)))
    return spark.createDataFrame(rows, "block string, cv double")


@query(f"SELECT 'o_custkey' AS unit, (SELECT count(*) FROM (SELECT o_custkey FROM {GRAINED} GROUP BY o_custkey HAVING count(DISTINCT c_mktsegment) > 1)) = 0 AS constant, (SELECT count(*) FROM (SELECT c_mktsegment FROM {GRAINED} GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)) = 0 AS one_to_one")
def constant_and_crossed(spark, sf_dir):
    rows = grained(spark, sf_dir)
    a = incidence.constant_within(rows, {"o_custkey": ["o_custkey"]}, ["c_mktsegment"]).select("unit", F.col("c_mktsegment").alias("constant"))
    b = incidence.constant_within(rows, {"c_mktsegment": ["c_mktsegment"]}, ["o_custkey"]).select(F.col("o_custkey").alias("one_to_one"))
    return a.crossJoin(F.broadcast(b))


BRANDS = "(SELECT CAST(s_nationkey AS VARCHAR) AS b, p_brand AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"


def brands(spark, sf_dir):
    l, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("s_nationkey").cast("string").alias("site"), F.col("p_brand").alias("brand"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT 'b:' || b AS x, 't:' || t AS y FROM {BRANDS}), both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e), walk(x, y) AS (SELECT x, x FROM both_ UNION SELECT w.x, b.y FROM walk w JOIN both_ b ON w.y = b.x)
SELECT x AS node, min(y) AS component FROM walk GROUP BY x
""")
def env_connectivity(spark, sf_dir):
    return incidence.components(incidence.incidence(brands(spark, sf_dir), "site", "brand"))


@query(f"WITH c AS (SELECT t, count(DISTINCT b) AS k FROM {BRANDS} GROUP BY t) SELECT round(avg(CAST(k = 1 AS INT)), 6) AS one_environment, round(avg(CAST(k = 2 AS INT)), 6) AS two_environments, round(avg(CAST(k >= 3 AS INT)), 6) AS three_or_more, round(1 - sum(k) / (count(*) * (SELECT count(DISTINCT b) FROM {BRANDS})), 6) AS zero_cell_fraction, count(*) AS n_treatments FROM c")
def env_overlap(spark, sf_dir):
    got = environment.overlap(incidence.incidence(brands(spark, sf_dir), "site", "brand"))
    return got.select(*(F.round(c, 6).alias(c) if c != "n_treatments" else F.col(c) for c in got.columns))


@query("WITH c AS (SELECT c_custkey AS t, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1) SELECT 'c_nationkey' AS col, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_groups, count(*) AS n_treatments, round(avg(CAST(k = 1 AS INT)), 6) AS confined_fraction, sum(CAST(k > 1 AS INT)) AS shared_treatments, 'exact_partition' AS status FROM c")
def grouping_diagnostics(spark, sf_dir):
    got = environment.grouping(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")
    return got.withColumn("confined_fraction", F.round("confined_fraction", 6))


@query(_designs_sql(f"(SELECT site AS e, rep, genotype FROM {TRIAL})") + " SELECT CAST(e AS VARCHAR) AS env, design, round(score, 6) AS score, CASE WHEN nt > 1 THEN 'genotype' ELSE '' END AS treatment, blocks, n AS n_rows, CASE WHEN nt > 1 THEN nt ELSE 0 END AS n_treatments FROM judged")
def per_env_design(spark, sf_dir):
    """The whole detector in every environment."""
    told, _ = environment.designs(plots(spark, sf_dir), ["site"], ["genotype"])
    return spark.createDataFrame([(r["env"], r["design"], round(r["score"], 6), r["treatment"], r["blocks"], r["n_rows"], r["n_treatments"]) for r in told], "env string, design string, score double, treatment string, blocks string, n_rows long, n_treatments long")


@query("""
WITH cell AS (SELECT CAST(c_nationkey AS VARCHAR) AS env, o_orderpriority AS t, o_orderstatus AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT env, CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_treatments, CAST(min(r) AS BIGINT) AS min_reps, CAST(max(r) AS BIGINT) AS max_reps, (SELECT count(DISTINCT b) FROM cell c WHERE c.env = s.env) AS n_blocks FROM (SELECT env, t, sum(n) AS r FROM cell GROUP BY ALL) s GROUP BY env
""")
def per_env_orders(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority", "o_orderstatus")
    return environment.per_environment(rows, ["c_nationkey"], "o_orderpriority", "o_orderstatus")


# --- keys, missing values and links of whole clones

MISSING = "(SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"


@query(f"SELECT o_orderkey, m.alias AS o_orderpriority, price FROM {MISSING} o JOIN {alias_sql('orders', 'o_orderpriority', 'trt_', 'o_orderpriority')} m ON o.o_orderpriority = m.original")
def recipe_forward_nan(spark, sf_dir):
    """A source with NaN passes its own recipe; NaN is null on the way."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') ELSE cast(o_totalprice AS double) END").alias("price"))
    plan = propose(o, "local", detect=False).set(["o_orderkey", "price"], "id", "keep").set("o_orderpriority", "treatment", "alias")
    return mask(o, plan, seed=SEED, key=["o_orderkey"]).recipe.forward(o)


@query("SELECT DISTINCT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || CAST(l_quantity AS INT) || '/' || strftime(l_shipdate, '%Y-%m-%d') AS key FROM lineitem")
def composite_keys(spark, sf_dir):
    """Row ids of several key columns: as many as there are keys, each read back from its id."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "day"]
    rows = table(spark, sf_dir, "lineitem").select(*cols[:4], F.col("l_quantity").cast("int").alias("qty"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return with_rid(rows, cols).select(F.array_join(F.from_json("__rid", "array<string>"), "/").alias("key")).distinct()


@query(f"SELECT m.alias AS doc_id, d.n_chars AS col_003, l.quality AS col_002 FROM documents d JOIN labels l USING (doc_id) JOIN {LINK} m ON doc_id = original")
def linked_join_aliased_names(spark, sf_dir):
    """Links keep their names while all other columns lose theirs."""
    tables = linked(spark, sf_dir)
    plans = {n: propose(t, "local", detect=False).set([c for c in t.columns if c != "doc_id"], action="keep").set("doc_id", "id", "alias") for n, t in tables.items()}
    done = maskset.mask_set(tables, plans, seed=SEED, keys={"documents": ["doc_id"], "labels": ["doc_id"]}, alias_names=True)
    return done.clones["documents"].data.select("doc_id", "col_003").join(done.clones["labels"].data.select("doc_id", "col_002"), "doc_id")


CONFORMED = f"WITH {CLOSURE}, read AS (SELECT d.rid, coalesce(CASE WHEN len(e.ends) = 1 THEN e.ends[1] END, d.label) AS label FROM {DIRTY} d LEFT JOIN ends e ON d.label = e.f)"


@query(CONFORMED + f" SELECT r.rid, m.alias AS label, CAST(r.rid AS DOUBLE) / 4 AS size FROM read r JOIN {alias_sql('read', 'label', 'trt_', 'label')} m ON r.label = m.original")
def conform_replay(spark, sf_dir):
    """Merged labels and types that the recipe of a conformed table replays on the table as it came."""
    rows = dirty(spark, sf_dir).select(F.col("__rid").alias("rid"), "label", (F.col("__rid") / 4).cast("string").alias("size"))
    merges = merge_closure(spark, sf_dir)
    cleaning = hygiene.clean(rows)
    data = hygiene.typed(hygiene.merged(cleaning.data, merges), {"size": "numeric"})
    conformed = hygiene.Conformance(data, cleaning, merges, {"size": "numeric"}, {"merges": True, "types": True}, [])
    plan = propose(data, "local", detect=False).set(["rid", "size"], "id", "keep").set("label", "treatment", "alias")
    return mask(conformed, plan, seed=SEED, key=["rid"]).recipe.forward(rows)


@query(f"""
WITH RECURSIVE d AS {TRIAL}, e AS (SELECT DISTINCT 'b:' || site AS x, 't:' || genotype AS y FROM d), both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e), walk(x, y) AS (SELECT x, x FROM both_ UNION SELECT w.x, b.y FROM walk w JOIN both_ b ON w.y = b.x),
parts AS (SELECT count(DISTINCT c) AS n FROM (SELECT min(y) AS c FROM walk GROUP BY x)), shared AS (SELECT max(k) >= 2 AS ok FROM (SELECT count(DISTINCT site) AS k FROM d GROUP BY genotype)),
rep AS (SELECT avg(r) AS r FROM (SELECT max(CAST(n >= 2 AS INT)) AS r FROM (SELECT site, genotype, count(*) AS n FROM d GROUP BY ALL) GROUP BY site))
SELECT CASE WHEN NOT shared.ok THEN 'single' WHEN rep.r >= 0.5 THEN 'multi' ELSE 'review' END AS status, 'site' AS env, CASE WHEN parts.n = 1 THEN 'connected' ELSE 'disconnected' END AS connectivity, (SELECT count(DISTINCT site) FROM d) AS environments FROM parts, shared, rep
""")
def env_scope(spark, sf_dir):
    s = environment.detect_scope(plots(spark, sf_dir))
    return spark.createDataFrame([(s.status, ",".join(s.env), s.connectivity["status"], sum(p["n_env"] for p in s.connectivity["sizes"]))], "status string, env string, connectivity string, environments int")


# --- audit and release

PAIRS = f"(SELECT o.o_orderkey, o.o_orderstatus AS os, c.o_orderstatus AS cs, o.o_totalprice AS ot, c.o_totalprice AS ct, strftime(o.o_orderdate, '%Y-%m-%d') AS od, strftime(c.o_orderdate, '%Y-%m-%d') AS cd, o.o_orderpriority AS op FROM orders o JOIN {CLONE} c USING (o_orderkey))"


def pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return cut(audit.paired(o, orders_clone(spark, sf_dir).data, "o_orderkey"), "pairs")


@query(f"SELECT 'o_totalprice' AS col, count(*) AS comparable_n, round(100 * avg(CAST(ot = ct AS INT)), 6) AS exact_match_pct FROM {PAIRS}")
def audit_exact_match(spark, sf_dir):
    return audit.exact_match(pairs(spark, sf_dir), ["o_totalprice"]).withColumn("exact_match_pct", F.round("exact_match_pct", 6))


@query(f"WITH c AS (SELECT op AS g, os AS x, count(*) AS n, sum(CAST(os = cs AS INT)) AS h FROM {PAIRS} GROUP BY 1, 2), g AS (SELECT g, sum(n) AS n, sum(h) AS h, sum(n * n) AS sq FROM c GROUP BY g), t AS (SELECT sum(n) AS m, sum(h) AS h, sum(sq / n) AS ch FROM g) SELECT round(100 * h / m, 6) AS observed, round(100 * ch / m, 6) AS baseline, round(100 * h / m - 100 * ch / m, 6) AS excess, round(100 * sqrt(ch / m * (1 - ch / m) / m), 6) AS sd, m FROM t")
def audit_same_row_excess(spark, sf_dir):
    got = audit.same_row(pairs(spark, sf_dir), "o_orderstatus", [F.col("`o|o_orderpriority`")])
    return got.select(*(F.round(c, 6).alias(c) if c != "m" else F.col(c) for c in got.columns))


@query("SELECT 'o_orderstatus' AS col, count(*) AS n_unique_levels, min(n) AS freq_min FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def audit_freq_min(spark, sf_dir):
    counts = hygiene.label_counts(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    return counts.groupBy("col").agg(F.count("*").alias("n_unique_levels"), F.min("n").alias("freq_min"))


@query(f"SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN l_tax IS NULL THEN '1' ELSE '0' END || CASE WHEN l_quantity IS NULL THEN '1' ELSE '0' END || CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END AS pattern FROM {LINEITEM}) GROUP BY pattern")
def audit_na_pattern(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("l_discount", F.when(F.col("l_discount") <= 0.05, F.col("l_discount")))
    return audit.na_patterns(rows, ["l_tax", "l_quantity", "l_discount"])


@query(f"WITH u AS (SELECT a.v FROM {drawn_sql(UNITS, 'rid', 'c_acctbal', uniform_sql(SEED, 'grain:o_custkey:c_acctbal', 'rid'))} a) SELECT round(100 * avg(CAST(v IN (SELECT c_acctbal FROM {UNITS}) AS INT)), 6) AS pct, count(*) AS n FROM u")
def audit_value_set(spark, sf_dir):
    own = grained(spark, sf_dir)
    made = grain.synthesise(own, grain.Grain(("o_custkey",), ("c_acctbal",), 0), "o_orderkey", SEED)
    return audit.value_set(own, made, ["o_custkey"], "c_acctbal", "o_orderkey").select(F.round("pct", 6).alias("pct"), "n")


#: The settings of orders_plan: column, role, action.
GIVEN = (("o_orderkey", "id", "keep"), ("o_custkey", "design", "keep"), ("o_orderstatus", "covariate", "scramble"), ("o_totalprice", "outcome", "scramble"), ("o_orderdate", "date", "scramble"), ("o_orderpriority", "treatment", "alias"))


def _kind_sql(col: str) -> str:
    return f"(SELECT CASE WHEN typeof({col}) IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN typeof({col}) IN ('DOUBLE', 'FLOAT') THEN 'numeric' WHEN typeof({col}) LIKE 'TIMESTAMP%' THEN 'datetime' WHEN typeof({col}) = 'DATE' THEN 'date' ELSE 'character' END FROM orders LIMIT 1)"


def _found_sql(col: str, role: str, action: str, o: str, c: str) -> str:
    """What the audit measures of a column, from the pairs and the clone."""
    chance = f"(SELECT sum(n * n) / (sum(n) * sum(n)) FROM (SELECT count(*) AS n FROM pairs GROUP BY {o}))"
    return f"""SELECT '{col}' AS col, '{role}' AS role, '{action}' AS action, {_kind_sql(col)} AS kind, CASE WHEN (SELECT count(*) FROM clone WHERE CAST({col} AS VARCHAR) IN (SELECT CAST({col} AS VARCHAR) FROM orders)) = 0 THEN 'aliased' ELSE 'passthrough' END AS alias_status,
 (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {col})) AS freq_min, (SELECT 100 * avg(CAST({o} = {c} AS INT)) FROM pairs) AS exact, (SELECT 100 * avg(CAST({o} = {c} AS INT)) FROM pairs) - 100 * {chance} AS excess, 100 * sqrt({chance} * (1 - {chance}) / (SELECT count(*) FROM pairs)) AS sd"""


MEASURED = {"o_orderkey": ("o_orderkey", "o_orderkey"), "o_custkey": ("oc", "cc"), "o_orderstatus": ("os", "cs"), "o_totalprice": ("ot", "ct"), "o_orderdate": ("od", "cd"), "o_orderpriority": ("op", "op")}
#: The rules that can hold for these columns: none is personal, displaced, drawn by units, two-valued or scrambled from whole numbers.
CLASSED = f"""
WITH clone AS {CLONE}, pairs AS (SELECT p.*, o.o_custkey AS oc, c.o_custkey AS cc FROM {PAIRS} p JOIN orders o USING (o_orderkey) JOIN clone c USING (o_orderkey)),
found AS ({" UNION ALL ".join(_found_sql(col, role, action, *MEASURED[col]) for col, role, action in GIVEN)}),
classed AS (SELECT *, CASE WHEN role = 'outcome' AND action = 'keep' THEN 'high' WHEN role = 'treatment' AND alias_status = 'passthrough' THEN 'high' WHEN role = 'covariate' AND kind = 'character' AND freq_min = 1 THEN 'high'
 WHEN (role = 'outcome' AND exact > 1) OR (role = 'covariate' AND kind = 'numeric' AND exact > 5) THEN 'medium'
 WHEN role NOT IN ('design', 'treatment', 'id') AND kind IN ('character', 'date', 'datetime') AND excess >= 10 AND excess >= 4 * sd THEN 'medium' WHEN action = 'keep' AND role <> 'design' THEN 'medium' ELSE 'low' END AS leakage_class FROM found)"""


@query(CLASSED + " SELECT col, leakage_class, alias_status FROM classed")
def audit_classes(spark, sf_dir):
    got = orders_clone(spark, sf_dir, "collaborate")
    return spark.createDataFrame([(r["col"], r["leakage_class"], r["alias_status"]) for r in got.columns], "col string, leakage_class string, alias_status string")


@query(f"SELECT 'same_row_joint' AS \"check\", round(100 * avg(CAST(os = cs AND od = cd AS INT)), 6) AS observed FROM {PAIRS} UNION ALL SELECT 'whole_row', round(100 * avg(CAST((op, cs, cd) IN (SELECT (op, os, od) FROM {PAIRS}) AS INT)), 6) FROM {PAIRS}")
def audit_joint(spark, sf_dir):
    p = pairs(spark, sf_dir)
    p = p.select("__rid", *(F.date_format(F.col(f"`{x}|o_orderdate`"), "yyyy-MM-dd").alias(f"{x}|o_orderdate") for x in "oc"), *(F.col(f"`{x}|o_orderstatus`") for x in "oc"), F.col("`o|o_orderpriority`"), F.col("`o|o_orderpriority`").alias("c|o_orderpriority"))
    return audit.joint(p, ["o_orderstatus", "o_orderdate"], ["o_orderpriority"], draws=3).select("check", F.round("observed", 6).alias("observed"))


@query(f"SELECT count(*) AS cells FROM (SELECT os, od FROM {PAIRS} GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT cs, cd FROM {PAIRS} GROUP BY 1, 2 HAVING count(*) = 1) b ON os = cs AND od = cd")
def audit_rare_cross(spark, sf_dir):
    return audit.singletons(pairs(spark, sf_dir), ["o_orderstatus", "o_orderdate"]).select(F.col("cells").cast("bigint").alias("cells"))


@query("SELECT 'o_custkey' AS col, count(*) AS units, min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT 'o_orderstatus', count(*), min(n), max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def audit_unit_sizes(spark, sf_dir):
    return audit.unit_sizes(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query(CLASSED + " SELECT 'collaborate' AS mode, CASE WHEN bool_or(leakage_class = 'high') THEN 'blocked' WHEN bool_or(leakage_class = 'medium') THEN 'review' ELSE 'clear' END AS status FROM classed UNION ALL SELECT 'local', 'local'")
def release_status(spark, sf_dir):
    """By the worst finding; the SQL has those of columns alone, so a high one of whole rows would differ."""
    done = [orders_clone(spark, sf_dir, m) for m in ("collaborate", "local")]
    return spark.createDataFrame([(d.mode, d.status()) for d in done], "mode string, status string")


# --- description


def _card_sql(t: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS kind, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_share, count(DISTINCT {c}) AS n_distinct FROM {t}" for c, k in cols)


@query(_card_sql(LINEITEM, LINES))
def data_card_columns(spark, sf_dir):
    return card.card_columns(lineitem(spark, sf_dir).select(*(c for c, _ in LINES)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, '{role}' AS role, '{action}' AS action, {_kind_sql(c)} AS kind" for c, role, action in GIVEN))
def public_roles(spark, sf_dir):
    rows = orders_clone(spark, sf_dir).public_roles()
    return spark.createDataFrame([(r["col"], r["role"], r["action"], r["kind"]) for r in rows], "col string, role string, action string, kind string")


@query("SELECT b, t, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag AS b FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linestatus AS t FROM lineitem) LEFT JOIN (SELECT l_returnflag AS b, l_linestatus AS t, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (b, t)")
def plot_replication_tile(spark, sf_dir):
    return card.replication_tile(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"SELECT col, n_missing, missing_share FROM ({_card_sql(LINEITEM, LINES)})")
def plot_na_pattern(spark, sf_dir):
    return card.na_panel(lineitem(spark, sf_dir).select(*(c for c, _ in LINES)))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS outer, count(DISTINCT n_nationkey) AS n_inner, count(*) AS n FROM nation GROUP BY 1".replace(" AS outer", ' AS "outer"'))
def plot_nesting(spark, sf_dir):
    return card.nesting(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")


@query("SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1")
def plot_frequencies(spark, sf_dir):
    return card.frequencies(table(spark, sf_dir, "orders"), "o_orderpriority")


# registers its own queries here
from . import rule_queries  # noqa: E402, F401
