"""Cleaning, imputation, encoding, scaling, generated and selected features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.catalog.base import (
    GAP_KEYS, GAP_KEYS_SQL, GAP_SQL, LANG_FEATURES, LANG_SQL, NET_FEATURES, NET_KEYS, NET_SQL,
    gapped, languages, net_prices, query, r4, table,
)
from gridwright.catalog.profile_queries import CORR_SQL, _related
from gridwright.functions.columns import r
from gridwright.operators import features as E
from gridwright.operators import preprocess as R

G = f"({GAP_SQL})"
COLS = ["quantity", "discount", "tax", "price"]


def report(df, columns, digits: int = 4):
    return df.select(*[r(F.col(c), digits).alias(c) if c in columns else c for c in df.columns])


def per_row(exprs: dict[str, str], stats: str = "", source: str = G, keys: str = GAP_KEYS_SQL) -> str:
    body = ", ".join(f"{r4(e)} AS {c}" for c, e in exprs.items())
    return f"SELECT {keys}, {body} FROM {source}" + (f", (SELECT {stats} FROM {source})" if stats else "")


def numbers(spark, sf):
    return gapped(spark, sf).select(*GAP_KEYS, *COLS)


def column_stats(template: dict[str, str], columns=COLS) -> str:
    return ", ".join(f"{e.format(c=c)} AS {c}_{n}" for c in columns for n, e in template.items())


@query("d01_drop_correlated", f"SELECT c, d, k FROM ({CORR_SQL})".replace("SELECT c, d, k", "SELECT a, c, d, k"))
def _(spark, sf):
    df = _related(spark, sf)
    return R.apply_step(df, R.fit_drop_correlated(df, 0.95))


@query("d02_zscore_outliers", f"""SELECT event_id, CASE WHEN abs((value - m) / s) < 3.0 THEN value END AS value
  FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return R.apply_step(df, R.fit_outliers(df, "zscore", 3.0, ["value"]))


CLIP = "CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {hi}), {lo}) END"


@query("d03_iqr_clip", f"""SELECT event_id, {r4(CLIP.format(c='value', hi='q3 + 1.5 * (q3 - q1)', lo='q1 - 1.5 * (q3 - q1)'))} AS value
  FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return report(R.apply_step(df, R.fit_outliers(df, "iqr", columns=["value"])), ["value"])


@query("d04_winsorize", per_row(
    {c: CLIP.format(c=c, hi=f"{c}_hi", lo=f"{c}_lo") for c in COLS},
    column_stats({"lo": "quantile_cont({c}, 0.05)", "hi": "quantile_cont({c}, 0.95)"})))
def _(spark, sf):
    df = numbers(spark, sf)
    return report(R.apply_step(df, R.fit_outliers(df, "winsorize", columns=COLS)), COLS)


FILLS = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "most_frequent": None}


def fill_sql(template: str) -> str:
    return per_row({c: f"coalesce({c}, {c}_f)" for c in COLS}, column_stats({"f": template}))


def _filled(spark, sf, strategy):
    df = numbers(spark, sf)
    return report(R.apply_step(df, R.fit_fill(df, strategy, COLS)), COLS)


@query("d05_mean_fill", fill_sql("avg({c})"))
def _(spark, sf):
    return _filled(spark, sf, "mean")


@query("d06_median_fill", fill_sql("quantile_cont({c}, 0.5)"))
def _(spark, sf):
    return _filled(spark, sf, "median")


def mode_sql(c: str, source: str = G) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("d07_most_frequent_fill", per_row({c: f"coalesce({c}, {mode_sql(c)})" for c in COLS}))
def _(spark, sf):
    return _filled(spark, sf, "most_frequent")


PART_GAPS = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price,
  CAST(p_partkey % 100 AS DOUBLE) AS block FROM part"""


def part_gaps(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("size"),
        F.when(k % 11 != 0, F.col("p_retailprice")).alias("price"), (k % 100).cast("double").alias("block"))


def knn_fill_sql(c: str, columns=("size", "price", "block")) -> str:
    terms = " + ".join(f"coalesce((q.{x} - d.{x}) * (q.{x} - d.{x}), 0)" for x in columns)
    shared = " + ".join(f"(q.{x} IS NOT NULL AND d.{x} IS NOT NULL)::INT" for x in columns)
    return f"""SELECT id, avg(v) AS f FROM (SELECT q.p_partkey AS id, d.{c} AS v, row_number() OVER (PARTITION BY q.p_partkey
      ORDER BY sqrt(({terms}) * ({len(columns)}::DOUBLE / ({shared}))), CAST(d.p_partkey AS VARCHAR)) AS rn
      FROM ({PART_GAPS}) q JOIN ({PART_GAPS}) d ON d.{c} IS NOT NULL WHERE q.{c} IS NULL AND ({shared}) > 0) WHERE rn <= 5 GROUP BY 1"""


@query("d08_nearest_neighbour_fill", f"""SELECT p_partkey, {r4('coalesce(size, s.f)')} AS size, {r4('coalesce(price, p.f)')} AS price,
  block FROM ({PART_GAPS}) LEFT JOIN ({knn_fill_sql('size')}) s ON s.id = p_partkey
  LEFT JOIN ({knn_fill_sql('price')}) p ON p.id = p_partkey""")
def _(spark, sf):
    from gridwright.operators.neighbors import impute_nearest
    out = impute_nearest(part_gaps(spark, sf), ["size", "price", "block"], "p_partkey", 5)
    return report(out, ["size", "price"])


@query("d09_iterative_fill")
def _(spark, sf):
    # quantity is missing and tied to the price
    df = net_prices(spark, sf).select(
        *NET_KEYS, "price", "net", F.when(F.col("l_orderkey") % 17 != 0, F.col("price") * 2 + F.col("tax")).alias("twice"))
    step = R.fit_fill_iterative(df, ["price", "net", "twice"])
    out = R.apply_step(df, step)
    return report(out, ["twice"], 2)


@query("d10_auto_strategy", f"""SELECT 1 AS step, 'filled ' || (SELECT (count(*) > count(size))::INT + (count(*) > count(price))::INT
  + (count(*) > count(block))::INT FROM ({PART_GAPS})) || ' numeric column(s): knn' AS message""")
def _(spark, sf):
    # few gapped columns: nearest neighbours
    df = part_gaps(spark, sf)
    model = R.Preparation(R.PreparationOptions(scaling="none"), key="p_partkey").fit(df)
    return model.log(df)


@query("d11_mode_fill", f"""SELECT {GAP_KEYS_SQL}, coalesce(flag, {mode_sql('flag')}) AS flag, status,
  'Unknown' AS nothing FROM {G}""")
def _(spark, sf):
    df = gapped(spark, sf).select(*GAP_KEYS, "flag", "status", F.lit(None).cast("string").alias("nothing"))
    return R.apply_step(df, R.fit_fill_mode(df, ["flag", "status", "nothing"]))


@query("d12_one_hot", f"""SELECT {GAP_KEYS_SQL}, coalesce((flag = 'N')::INT, 0) AS "flag_N",
  coalesce((flag = 'R')::INT, 0) AS "flag_R" FROM {G}""")
def _(spark, sf):
    df = gapped(spark, sf).select(*GAP_KEYS, "flag")
    return R.apply_step(df, R.fit_one_hot(df, "flag"))


def code_sql(kind: str) -> str:
    return f"""SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS {kind}) AS p_name,
      CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS {kind}) AS p_brand FROM part"""


def _coded(spark, sf, kind):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    for c in ("p_name", "p_brand"):
        df = R.encode(df, c, R.dictionary(df, c), kind)
    return df


@query("d13_label_codes", code_sql("BIGINT"))
def _(spark, sf):
    return _coded(spark, sf, "long")


@query("d14_ordinal_codes", code_sql("DOUBLE"))
def _(spark, sf):
    return _coded(spark, sf, "double")


@query("d15_auto_encoding", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) = 2 THEN 'label'
  WHEN count(DISTINCT {c}) <= 10 THEN 'onehot' ELSE 'label' END AS strategy FROM {t}""" for c, t in (
    ("l_returnflag", "lineitem"), ("l_linestatus", "lineitem"), ("p_brand", "part"), ("p_name", "part"))))
def _(spark, sf):
    from gridwright.operators.profile import distinct_counts
    counts = distinct_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]).unionByName(
        distinct_counts(table(spark, sf, "part"), ["p_brand", "p_name"])).collect()
    rows = [(x["column"], R.auto_encoding(x["n_unique"])) for x in counts]
    return spark.createDataFrame(rows, "column string, strategy string")


SCALES = {
    "d16_standard_scale": ("standard", {"m": "avg({c})", "s": "stddev_pop({c})"}, "({c} - {c}_m) / {c}_s"),
    "d17_minmax_scale": ("minmax", {"m": "min({c})", "s": "max({c}) - min({c})"}, "({c} - {c}_m) / {c}_s"),
    "d18_robust_scale": ("robust", {"m": "quantile_cont({c}, 0.5)",
                                    "s": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}, "({c} - {c}_m) / {c}_s"),
    "d19_maxabs_scale": ("maxabs", {"s": "max(abs({c}))"}, "{c} / {c}_s"),
}
for _name, (_method, _stats, _expr) in SCALES.items():
    def _scaled(spark, sf, method=_method):
        df = numbers(spark, sf)
        return report(R.apply_step(df, R.fit_scale(df, method, COLS)), COLS)

    query(_name, per_row({c: _expr.format(c=c) for c in COLS}, column_stats(_stats)))(_scaled)


@query("d20_power_scale")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return report(R.apply_step(df, R.fit_power(df, ["value"])), ["value"], 2)


@query("d21_no_scale", f"SELECT {GAP_KEYS_SQL}, tax, price, (flag_n)::INT AS \"flag_N\", (flag_r)::INT AS \"flag_R\" FROM "
       f"(SELECT *, coalesce(flag, {mode_sql('flag')}) = 'N' AS flag_n, coalesce(flag, {mode_sql('flag')}) = 'R' AS flag_r FROM {G})")
def _(spark, sf):
    df = gapped(spark, sf).select(*GAP_KEYS, "tax", "price", "flag")
    return R.Preparation(R.PreparationOptions(scaling="none"), passthrough=GAP_KEYS).fit(df).transform(df)


@query("d22_drop_low_variance", f"SELECT a, b, c, d FROM ({CORR_SQL})")
def _(spark, sf):
    df = _related(spark, sf)
    return R.apply_step(df, R.fit_drop_low_variance(df, 0.0))


def preparation_sql() -> str:
    """Winsorize, median fill, mode fill, encode, then standard scaling of everything."""
    clip = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, (SELECT quantile_cont({c}, 0.95) FROM g)), "
        f"(SELECT quantile_cont({c}, 0.05) FROM g)) END AS {c}" for c in COLS)
    fill = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM w)) AS {c}" for c in COLS)
    scaled = ['quantity', 'discount', 'tax', 'price', 'status', '"flag_N"', '"flag_R"']
    out = ", ".join(
        r4(f"({c} - (SELECT avg({c}) FROM e)) / (SELECT stddev_pop({c}) FROM e)") + f" AS {c}" for c in scaled)
    return f"""WITH g AS ({GAP_SQL}), w AS (SELECT {GAP_KEYS_SQL}, {clip}, flag, status FROM g),
      f AS (SELECT {GAP_KEYS_SQL}, {fill}, coalesce(flag, (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY flag
        ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, status FROM w),
      e AS (SELECT {GAP_KEYS_SQL}, {', '.join(COLS)}, dense_rank() OVER (ORDER BY status) - 1 AS status,
        (flag = 'N')::INT AS "flag_N", (flag = 'R')::INT AS "flag_R" FROM f)
      SELECT {GAP_KEYS_SQL}, {out} FROM e"""


def _prepared(spark, sf):
    df = gapped(spark, sf)
    options = R.PreparationOptions(missing_strategy="median", outlier_method="winsorize")
    return df, R.Preparation(options, passthrough=GAP_KEYS).fit(df)


SCALED = [*COLS, "status", "flag_N", "flag_R"]


@query("d23_fit_transform", preparation_sql())
def _(spark, sf):
    df, model = _prepared(spark, sf)
    return report(model.transform(df), SCALED)


@query("d24_transform_new_rows", preparation_sql())
def _(spark, sf):
    # the saved and reloaded model gives the same rows
    from gridwright.session import scratch_path
    df, model = _prepared(spark, sf)
    path = scratch_path(spark, "preparation")
    model.write().save(path)
    return report(R.PreparationModel.load(path).transform(df), SCALED)


def gaps_sql(source: str, columns) -> str:
    """How many of the columns have a gap."""
    return f"SELECT {' + '.join(f'(count(*) > count({c}))::INT' for c in columns)} FROM ({source})"


LOG_SQL = f"""SELECT 1 AS step, 'outliers: winsorize' AS message
  UNION ALL SELECT 2, 'filled ' || ({gaps_sql(GAP_SQL, COLS)}) || ' numeric column(s): median'
  UNION ALL SELECT 3, 'filled text columns with their mode: [''flag'', ''status'']'
  UNION ALL SELECT 4, 'one-hot flag: ' || (SELECT count(DISTINCT flag) - 1 FROM {G}) || ' column(s)'
  UNION ALL SELECT 5, 'label codes for status'
  UNION ALL SELECT 6, 'standard scaling of ' || (SELECT {len(COLS)} + 1 + count(DISTINCT flag) - 1 FROM {G}) || ' column(s)'"""


@query("d26_preparation_log", LOG_SQL)
def _(spark, sf):
    df, model = _prepared(spark, sf)
    return model.log(df)


# -- features ---------------------------------------------------------------------------------

def mi_sql(features, target: str, source: str, numeric_target: bool = False) -> str:
    def binned(c: str) -> str:
        cuts = " + ".join(f"({c} > q{i})::INT" for i in range(1, 10))
        marks = ", ".join(f"quantile_cont({c}, {i / 10}) AS q{i}" for i in range(1, 10))
        # equal cut points count once
        cuts = " + ".join(
            f"({c} > q{i}" + (f" AND q{i} <> q{i - 1}" if i > 1 else "") + ")::INT" for i in range(1, 10))
        return f"(SELECT id, {cuts} AS b FROM s, (SELECT {marks} FROM s))"

    parts = []
    for i, c in enumerate(features):
        y = f"(SELECT id, b AS y FROM {binned('y')})" if numeric_target else "(SELECT id, y FROM s)"
        parts.append(f"""SELECT '{c}' AS feature, {i} AS position, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS score FROM (
          SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (
            SELECT b, y, count(*)::DOUBLE AS n FROM {binned(c)} x JOIN {y} z USING (id) GROUP BY 1, 2))""")
    columns = ", ".join(features)
    return (f"WITH s AS (SELECT row_number() OVER () AS id, {columns}, {target} AS y FROM ({source})) "
            + " UNION ALL ".join(parts))


def scored(frame):
    return frame.select("feature", "position", r(F.col("score")).alias("score"))


def score_sql(body: str) -> str:
    return f"SELECT feature, position, {r4('score')} AS score FROM ({body})"


@query("e01_mutual_information_classes", score_sql(mi_sql(LANG_FEATURES, "lang", LANG_SQL)))
def _(spark, sf):
    return scored(E.mutual_information(languages(spark, sf), LANG_FEATURES, "lang"))


@query("e02_mutual_information_numeric", score_sql(mi_sql(NET_FEATURES, "net", NET_SQL, True)))
def _(spark, sf):
    return scored(E.mutual_information(net_prices(spark, sf), NET_FEATURES, "net", "regression"))


def anova_sql(features, label: str, source: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, {i} AS position, (sum(n * (m - g) * (m - g)) / (count(*) - 1))
      / (sum(n * v) / (sum(n) - count(*))) AS score FROM (SELECT count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v,
      (SELECT avg({c}) FROM ({source})) AS g FROM ({source}) GROUP BY {label})""" for i, c in enumerate(features))


@query("e03_anova_f", score_sql(anova_sql(LANG_FEATURES, "lang", LANG_SQL)))
def _(spark, sf):
    return scored(E.anova_f(languages(spark, sf), LANG_FEATURES, "lang"))


@query("e04_regression_f", score_sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {i} AS position, rr * rr / (1 - rr * rr) * (n - 2) AS score FROM (
    SELECT corr({c}, net) AS rr, count(*) AS n FROM ({NET_SQL}))""" for i, c in enumerate(NET_FEATURES))))
def _(spark, sf):
    return scored(E.regression_f(net_prices(spark, sf), NET_FEATURES, "net"))


@query("e05_forest_selection")
def _(spark, sf):
    df = languages(spark, sf)
    df = R.encode(df, "lang", R.dictionary(df, "lang"))
    out = E.select_features(df, LANG_FEATURES, "lang", "classification", "random_forest", 2)
    return out.select("feature", "rank", "selected")


@query("e06_top_k_selection", f"""SELECT feature, position, {r4('score')} AS score,
  row_number() OVER (ORDER BY score DESC, position) AS rank, row_number() OVER (ORDER BY score DESC, position) <= 2 AS selected
  FROM ({anova_sql(LANG_FEATURES, 'lang', LANG_SQL)})""")
def _(spark, sf):
    out = E.select_features(languages(spark, sf), LANG_FEATURES, "lang", "classification", "f_test", 2)
    return out.select("feature", "position", r(F.col("score")).alias("score"), "rank", "selected")


# two columns have a closed form: rotation angle and both eigenvalues
PCA_SQL = f"""WITH s AS (SELECT * FROM ({NET_SQL})), m AS (SELECT avg(price) AS mx, avg(net) AS my, var_pop(price) AS a,
    var_pop(net) AS d, covar_pop(price, net) AS b FROM s),
  v AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM m),
  u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS uy FROM v)"""


@query("e07_pca_scores", f"""{PCA_SQL} SELECT {', '.join(NET_KEYS)},
  {r4('(price - mx) * ux + (net - my) * uy', 3)} AS "PC1" FROM s, u""")
def _(spark, sf):
    df = net_prices(spark, sf)
    out = E.pca(df, ["price", "net"], 1).transform(df, NET_KEYS)
    return report(out, ["PC1"], 3)


@query("e07_pca_variance", f"""{PCA_SQL} SELECT 'PC1' AS component, {r4('l1 / (a + d)')} AS explained_variance_ratio,
  {r4('l1 / (a + d)')} AS cumulative_variance FROM u UNION ALL
  SELECT 'PC2', {r4('1 - l1 / (a + d)')}, 1.0::DOUBLE FROM u""")
def _(spark, sf):
    out = E.pca(net_prices(spark, sf), ["price", "net"], 5).explained(spark)
    return report(out, ["explained_variance_ratio", "cumulative_variance"])


@query("e08_polynomial", f"""SELECT {', '.join(NET_KEYS)}, price, tax, price * price AS "price^2", price * tax AS "price tax",
  tax * tax AS "tax^2" FROM ({NET_SQL})""")
def _(spark, sf):
    df = net_prices(spark, sf).select(*NET_KEYS, "price", "tax")
    return E.polynomial_features(df, 2, ["price", "tax"])


INTERACTION = ["price", "discount", "tax"]
PAIRS = [("price", "discount"), ("price", "tax"), ("discount", "tax")]


@query("e09_products", f"SELECT {', '.join(NET_KEYS)}, " + ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in PAIRS) + f" FROM ({NET_SQL})")
def _(spark, sf):
    out = E.interaction_features(net_prices(spark, sf).select(*NET_KEYS, *INTERACTION), INTERACTION)
    return out.select(*NET_KEYS, *[f"{a}_x_{b}" for a, b in PAIRS])


@query("e10_ratios", f"SELECT {', '.join(NET_KEYS)}, " + ", ".join(
    f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END AS {a}_div_{b}" for a, b in PAIRS) + f" FROM ({NET_SQL})")
def _(spark, sf):
    out = E.interaction_features(net_prices(spark, sf).select(*NET_KEYS, *INTERACTION), INTERACTION)
    return out.select(*NET_KEYS, *[f"{a}_div_{b}" for a, b in PAIRS])
