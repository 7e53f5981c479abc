"""Splits, metrics and curves on predictions that need no model."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.catalog.base import (
    BINARY_SQL, CLASSES, LINE_KEYS, MULTI_SQL, REG_SQL, binary_predictions, multi_predictions, query, r4,
    reg_predictions, table,
)
from gridwright.catalog.profile_queries import histogram_sql
from gridwright.functions.columns import r
from gridwright.operators import curves as V
from gridwright.operators import metrics as M
from gridwright.operators import splits as S

EVENT_HASH = "md5('42:' || event_id)"


# -- splits -----------------------------------------------------------------------------------

def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type")


def holdout_sql(by: str) -> str:
    return f"""SELECT event_id, event_type, rn <= round(n * 0.2) AS is_test FROM (SELECT event_id, event_type,
      row_number() OVER ({by} ORDER BY {EVENT_HASH}) AS rn, count(*) OVER ({by}) AS n FROM events)"""


def folds_sql(by: str, k: int = 5) -> str:
    return f"""SELECT event_id, event_type, CAST(floor((rn - 1) * {k} / n) AS INTEGER) AS fold FROM (SELECT event_id, event_type,
      row_number() OVER ({by} ORDER BY {EVENT_HASH}) AS rn, count(*) OVER ({by}) AS n FROM events)"""


@query("t01_stratified_holdout", holdout_sql("PARTITION BY event_type"))
def _(spark, sf):
    return S.holdout(_events(spark, sf), ["event_id"], 0.2, "event_type")


@query("t02_random_holdout", holdout_sql(""))
def _(spark, sf):
    return S.holdout(_events(spark, sf), ["event_id"], 0.2)


@query("t03_stratified_folds", folds_sql("PARTITION BY event_type"))
def _(spark, sf):
    return S.folds(_events(spark, sf), ["event_id"], 5, "event_type")


@query("t04_folds", folds_sql(""))
def _(spark, sf):
    return S.folds(_events(spark, sf), ["event_id"], 5)


# -- confusion metrics ------------------------------------------------------------------------

CONFUSION_SQL = f"""WITH p AS ({MULTI_SQL}), k AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
  c AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS t, (SELECT count(*) FROM p WHERE prediction = class) AS q,
    (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS h FROM k),
  m AS (SELECT class, t AS support, q AS predicted, h AS hits, CASE WHEN q = 0 THEN 0 ELSE h::DOUBLE / q END AS precision,
    CASE WHEN t = 0 THEN 0 ELSE h::DOUBLE / t END AS recall, CASE WHEN q + t = 0 THEN 0 ELSE 2.0::DOUBLE * h / (q + t) END AS f1 FROM c)"""
CONFUSION = {
    "c01_accuracy": ("accuracy", "sum(hits) / sum(support)"),
    "c02_f1_weighted": ("f1_weighted", "sum(f1 * support) / sum(support)"),
    "c03_f1_macro": ("f1_macro", "avg(f1)"),
    "c04_precision_weighted": ("precision_weighted", "sum(precision * support) / sum(support)"),
    "c05_recall_weighted": ("recall_weighted", "sum(recall * support) / sum(support)"),
    "c08_matthews": ("mcc", """(sum(hits)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support))
      / (sqrt(sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted))
       * sqrt(sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support)))"""),
    "c09_cohen_kappa": ("cohen_kappa", """(sum(hits)::DOUBLE / sum(support) - sum(predicted::DOUBLE * support) / (sum(support)::DOUBLE * sum(support)))
      / (1 - sum(predicted::DOUBLE * support) / (sum(support)::DOUBLE * sum(support)))"""),
}
for _name, (_metric, _expr) in CONFUSION.items():
    def _score(spark, sf, metric=_metric):
        return M.rounded(M.confusion_scores(M.confusion_counts(multi_predictions(spark, sf))).select(metric))

    query(_name, f"{CONFUSION_SQL} SELECT {r4(_expr)} AS {_metric} FROM m")(_score)


@query("c00_confusion_counts", f"SELECT label AS actual, prediction AS predicted, count(*) AS n FROM ({MULTI_SQL}) GROUP BY 1, 2")
def _(spark, sf):
    return M.confusion_counts(multi_predictions(spark, sf))


SPARSE_SQL = f"SELECT label, CAST((label + prediction % 2) % 3 AS BIGINT) AS prediction FROM ({MULTI_SQL})"


@query("c06_confusion_matrix", f"""{CONFUSION_SQL.replace(MULTI_SQL, SPARSE_SQL)}
  SELECT a.class AS actual, b.class AS predicted, (SELECT count(*) FROM p WHERE label = a.class AND prediction = b.class) AS n
  FROM k a, k b""")
def _(spark, sf):
    # a prediction is the label or the class after it, so some cells are empty
    df = multi_predictions(spark, sf).withColumn("label", F.col("label").cast("long"))
    df = df.withColumn("prediction", (F.col("label") + F.col("prediction") % 2) % 3)
    return M.confusion_matrix(M.confusion_counts(df))


@query("c07_class_report", f"""{CONFUSION_SQL} SELECT class::VARCHAR AS class, {r4('precision')} AS precision, {r4('recall')} AS recall,
    {r4('f1')} AS f1, support FROM m
  UNION ALL SELECT 'accuracy', {r4('sum(hits) / sum(support)')}, {r4('sum(hits) / sum(support)')}, {r4('sum(hits) / sum(support)')}, sum(support)::BIGINT FROM m
  UNION ALL SELECT 'macro avg', {r4('avg(precision)')}, {r4('avg(recall)')}, {r4('avg(f1)')}, sum(support)::BIGINT FROM m
  UNION ALL SELECT 'weighted avg', {r4('sum(precision * support) / sum(support)')}, {r4('sum(recall * support) / sum(support)')},
    {r4('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM m""")
def _(spark, sf):
    return M.class_report(M.confusion_counts(multi_predictions(spark, sf)))


# -- ranking metrics ----------------------------------------------------------------------------

def frame_sql(source: str, hit: str, score: str) -> str:
    """Distinct scores with cumulative hits and misses."""
    return f"""SELECT score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
      FROM (SELECT {score} AS score, count(*) FILTER (WHERE {hit})::DOUBLE AS pos, count(*) FILTER (WHERE NOT ({hit}))::DOUBLE AS neg
        FROM ({source}) GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""


BIN_FRAME = frame_sql(BINARY_SQL, "label = 1", "score")
AUC = "sum(neg * (cp - pos / 2)) / max(tp * tn)"
AP = "sum(pos * cp / (cp + cn)) / max(tp)"


def _frame(spark, sf):
    return M.score_frame(binary_predictions(spark, sf), F.col("label") == 1, "score")


@query("c10_roc_auc", f"SELECT {r4(AUC)} AS roc_auc FROM ({BIN_FRAME})")
def _(spark, sf):
    return M.rounded(M.ranking_scores(_frame(spark, sf)).select("roc_auc"))


OVR_SQL = " UNION ALL ".join(
    f"SELECT {AUC} AS auc, max(tp) AS weight FROM ({frame_sql(MULTI_SQL, f'label = {i}', f'p{i}')})" for i in range(3))


@query("c11_roc_auc_ovr", f"SELECT {r4('sum(auc * weight) / sum(weight)')} AS roc_auc_ovr FROM ({OVR_SQL})")
def _(spark, sf):
    return M.rounded(M.roc_auc_ovr(multi_predictions(spark, sf), "label", "probability", CLASSES))


EPS = "2.220446049250313e-16"
BIN_LOSS = f"avg(-ln(greatest(least(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1 - {EPS}), {EPS})))"
MULTI_LOSS = f"avg(-ln(greatest(least(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END / (p0 + p1 + p2), 1 - {EPS}), {EPS})))"


@query("c12_log_loss", f"""SELECT 'binary' AS kind, {r4(BIN_LOSS)} AS log_loss FROM ({BINARY_SQL})
  UNION ALL SELECT 'multiclass', {r4(MULTI_LOSS)} FROM ({MULTI_SQL})""")
def _(spark, sf):
    one = binary_predictions(spark, sf).agg(M.binary_log_loss("label", "score").alias("log_loss"))
    many = multi_predictions(spark, sf).agg(M.multiclass_log_loss("label", "probability", CLASSES).alias("log_loss"))
    return M.rounded(one.select(F.lit("binary").alias("kind"), "log_loss").unionByName(
        many.select(F.lit("multiclass").alias("kind"), "log_loss")))


BRIER = "avg((score - label) * (score - label))"


@query("c13_brier", f"SELECT {r4(BRIER)} AS brier_score FROM ({BINARY_SQL})")
def _(spark, sf):
    return M.rounded(binary_predictions(spark, sf).agg(M.brier("label", "score").alias("brier_score")))


@query("c14_average_precision", f"SELECT {r4(AP)} AS avg_precision FROM ({BIN_FRAME})")
def _(spark, sf):
    return M.rounded(M.ranking_scores(_frame(spark, sf)).select("avg_precision"))


@query("c15_quick_metrics", f"""WITH b AS ({CONFUSION_SQL} SELECT * FROM m) SELECT {r4('sum(hits) / sum(support)')} AS accuracy,
  {r4('sum(f1 * support) / sum(support)')} AS f1_weighted FROM b""")
def _(spark, sf):
    return M.quick_metrics(multi_predictions(spark, sf), "classification")


def report_sql() -> str:
    binary = CONFUSION_SQL.replace(MULTI_SQL, BINARY_SQL)
    parts = ", ".join(f"{r4(e)} AS {m}" for m, e in CONFUSION.values())
    return f"""SELECT * FROM ({binary} SELECT {parts} FROM m), (SELECT {r4(AUC)} AS roc_auc, {r4(AP)} AS avg_precision FROM ({BIN_FRAME})),
      (SELECT {r4(BIN_LOSS)} AS log_loss, {r4(BRIER)} AS brier_score FROM ({BINARY_SQL}))"""


@query("c16_full_report", report_sql())
def _(spark, sf):
    return M.classification_report(binary_predictions(spark, sf), score="score")


@query("c16_full_report_multiclass", f"""SELECT * FROM ({CONFUSION_SQL} SELECT
  {', '.join(f'{r4(e)} AS {m}' for m, e in CONFUSION.values())} FROM m),
  (SELECT {r4('sum(auc * weight) / sum(weight)')} AS roc_auc_ovr FROM ({OVR_SQL})),
  (SELECT {r4(MULTI_LOSS)} AS log_loss FROM ({MULTI_SQL}))""")
def _(spark, sf):
    return M.classification_report(multi_predictions(spark, sf), probability="probability", classes=CLASSES)


# -- regression metrics -------------------------------------------------------------------------

E_ = "(label - prediction)"
R2 = f"1 - sum({E_} * {E_}) / (count(*) * var_pop(label))"
REGRESSION = {
    "r01_r2": ("r2", R2),
    "r02_adjusted_r2": ("adjusted_r2", f"1 - (1 - ({R2})) * (count(*) - 1) / (count(*) - 3 - 1)"),
    "r03_rmse": ("rmse", f"sqrt(avg({E_} * {E_}))"),
    "r03_mse": ("mse", f"avg({E_} * {E_})"),
    "r04_mae": ("mae", f"avg(abs({E_}))"),
    "r05_mape_floor": ("mape_floor", f"100 * avg(abs({E_}) / greatest(abs(label), {EPS}))"),
    "r06_mape": ("mape", f"100 * avg(abs({E_} / (label + 1e-8)))"),
    "r07_explained_variance": ("explained_variance", f"1 - var_pop({E_}) / var_pop(label)"),
    "r08_residual_mean": ("residuals_mean", f"avg({E_})"),
    "r08_residual_std": ("residuals_std", f"stddev_pop({E_})"),
}
for _name, (_metric, _expr) in REGRESSION.items():
    def _measure(spark, sf, metric=_metric):
        return M.regression_report(reg_predictions(spark, sf), 3, names=[metric])

    query(_name, f"SELECT {r4(_expr)} AS {_metric} FROM ({REG_SQL})")(_measure)


@query("r09_full_report", "SELECT " + ", ".join(
    f"{r4(e)} AS {m}" for m, e in REGRESSION.values() if m in M.REPORT) + f" FROM ({REG_SQL})")
def _(spark, sf):
    return M.regression_report(reg_predictions(spark, sf), 3)


# -- curves ---------------------------------------------------------------------------------------

@query("v01_roc_points", f"SELECT score AS threshold, {r4('cn / tn')} AS fpr, {r4('cp / tp')} AS tpr FROM ({BIN_FRAME})")
def _(spark, sf):
    p = V.roc_points(_frame(spark, sf))
    return p.select("threshold", r(F.col("fpr")).alias("fpr"), r(F.col("tpr")).alias("tpr"))


@query("v01_roc_points_per_class", " UNION ALL ".join(
    f"""SELECT {i}::DOUBLE AS class, score AS threshold, {r4('cn / tn')} AS fpr, {r4('cp / tp')} AS tpr
    FROM ({frame_sql(MULTI_SQL, f'label = {i}', f'p{i}')})""" for i in range(3)))
def _(spark, sf):
    p = V.roc_points_per_class(multi_predictions(spark, sf), "label", "probability", CLASSES)
    return p.select("class", "threshold", r(F.col("fpr")).alias("fpr"), r(F.col("tpr")).alias("tpr"))


@query("v02_precision_recall_points", f"""SELECT score AS threshold, {r4('cp / (cp + cn)')} AS precision, {r4('cp / tp')} AS recall
  FROM ({BIN_FRAME})""")
def _(spark, sf):
    p = V.precision_recall_points(_frame(spark, sf))
    return p.select("threshold", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


@query("v03_calibration", f"""SELECT greatest(CAST(ceil(score * 10) AS BIGINT) - 1, 0) AS bin, {r4('avg(score)')} AS mean_predicted,
  {r4('avg(label)')} AS fraction_positive, count(*) AS n FROM ({BINARY_SQL}) GROUP BY 1""")
def _(spark, sf):
    return V.calibration(binary_predictions(spark, sf), "label", "score")


@query("v05_actual_vs_predicted", f"""SELECT {', '.join(LINE_KEYS)}, label AS actual, prediction AS predicted FROM ({REG_SQL})""")
def _(spark, sf):
    return V.prediction_points(reg_predictions(spark, sf), LINE_KEYS).drop("residual")


@query("v05_diagonal", f"""SELECT least(min(label), min(prediction)) AS lo, greatest(max(label), max(prediction)) AS hi FROM ({REG_SQL})""")
def _(spark, sf):
    return V.diagonal(reg_predictions(spark, sf))


@query("v06_residual_points", f"""SELECT {', '.join(LINE_KEYS)}, prediction AS predicted, label - prediction AS residual FROM ({REG_SQL})""")
def _(spark, sf):
    return V.prediction_points(reg_predictions(spark, sf), LINE_KEYS).drop("actual")


RESIDUAL_SQL = f"(SELECT label - prediction AS residual FROM ({REG_SQL}))"


@query("v07_residual_histogram", f"""SELECT h.*, {r4('m')} AS mean FROM ({histogram_sql('residual', RESIDUAL_SQL, 30)}) h,
  (SELECT avg(residual) AS m FROM {RESIDUAL_SQL})""")
def _(spark, sf):
    return V.residual_histogram(reg_predictions(spark, sf))


DECILES = ", ".join(f"quantile_cont(label, {i / 10}) AS q{i}" for i in range(11))


@query("v08_error_by_decile", f"""SELECT decile, {r4('coalesce(e, 0)')} AS mae FROM (SELECT unnest(range(1, 11)) AS decile) LEFT JOIN (
  SELECT {' + '.join(f'(label >= q{i})::INT' for i in range(10))} AS d, avg(abs(label - prediction)) AS e
  FROM ({REG_SQL}), (SELECT {DECILES} FROM ({REG_SQL})) WHERE label < q10 GROUP BY 1) ON d = decile""")
def _(spark, sf):
    return V.error_by_decile(reg_predictions(spark, sf))
