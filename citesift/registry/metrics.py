"""Metrics, curves and reports on the fixed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators import curves, folds, metrics
from citesift.plans import evaluate
from citesift.registry import views
from citesift.session import scratch_path
from citesift.sources import articles as files

PER_FOLD, OVERALL = ("fold",), ()


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _levels(spark, sf_dir, by, with_length=True) -> DataFrame:
    return curves.score_levels(views.scores(spark, sf_dir, with_length), by)


def _matrix(spark, sf_dir, cutoff=metrics.CUTOFF) -> DataFrame:
    return metrics.confusion(metrics.classify(views.scores(spark, sf_dir), cutoff))


def classify(spark, sf_dir) -> DataFrame:
    return metrics.classify(views.scores(spark, sf_dir, True))


def classify_from(spark, sf_dir) -> DataFrame:
    """Every fold's scores, cut where 95 % of its relevant documents are found."""
    scores = views.scores(spark, sf_dir, True)
    thresholds = curves.select_threshold(curves.score_levels(scores, PER_FOLD))
    return metrics.classify_from(scores, thresholds)


def confusion(spark, sf_dir) -> DataFrame:
    return _matrix(spark, sf_dir)


def cross_table(spark, sf_dir) -> DataFrame:
    return metrics.cross_table(metrics.classify(views.scores(spark, sf_dir)), PER_FOLD)


def precision_recall(spark, sf_dir) -> DataFrame:
    return _round(metrics.precision_recall(_matrix(spark, sf_dir)), "precision", "recall")


def wss(spark, sf_dir) -> DataFrame:
    return _round(metrics.wss(_matrix(spark, sf_dir)), "wss")


def pr_curve(spark, sf_dir) -> DataFrame:
    return _round(curves.pr_curve(_levels(spark, sf_dir, PER_FOLD)), "precision", "recall")


def pr_curve_overall(spark, sf_dir) -> DataFrame:
    curve = curves.pr_curve(_levels(spark, sf_dir, OVERALL, False), OVERALL)
    return _round(curve, "precision", "recall")


def pr_auc(spark, sf_dir) -> DataFrame:
    return _round(curves.pr_auc(_levels(spark, sf_dir, PER_FOLD, False)), "prauc")


def pr_auc_overall(spark, sf_dir) -> DataFrame:
    return _round(curves.pr_auc(_levels(spark, sf_dir, OVERALL), OVERALL), "prauc")


def pr_envelope(spark, sf_dir) -> DataFrame:
    curve = curves.pr_curve(_levels(spark, sf_dir, OVERALL), OVERALL)
    return _round(curves.pr_envelope(curve, OVERALL), "precision", "recall")


def rank_documents(spark, sf_dir) -> DataFrame:
    return curves.rank_documents(views.scores(spark, sf_dir))


def rank_documents_overall(spark, sf_dir) -> DataFrame:
    return curves.rank_documents(views.scores(spark, sf_dir), OVERALL)


def gain_curve(spark, sf_dir) -> DataFrame:
    return _round(curves.gain_curve(_levels(spark, sf_dir, PER_FOLD, False)), "screened", "recall")


def gain_curve_overall(spark, sf_dir) -> DataFrame:
    gain = curves.gain_curve(_levels(spark, sf_dir, OVERALL), OVERALL)
    return _round(gain, "screened", "recall")


def step_points(spark, sf_dir) -> DataFrame:
    gain = curves.gain_curve(_levels(spark, sf_dir, PER_FOLD))
    return _round(curves.step_points(gain), "x", "y")


def screened_at_recall(spark, sf_dir) -> DataFrame:
    reached = curves.screened_at_recall(_levels(spark, sf_dir, PER_FOLD, False))
    return _round(reached, "screened", "work_saved")


def select_threshold(spark, sf_dir) -> DataFrame:
    return curves.select_threshold(_levels(spark, sf_dir, PER_FOLD))


def score_histogram(spark, sf_dir) -> DataFrame:
    return _round(metrics.score_histogram(views.scores(spark, sf_dir, True)), "lower", "upper")


def score_histogram_overall(spark, sf_dir) -> DataFrame:
    bins = metrics.score_histogram(views.scores(spark, sf_dir, True), 50, OVERALL, (0.0, 1.0))
    return _round(bins, "lower", "upper")


def _report(spark, sf_dir) -> DataFrame:
    """The report of the fixed score. Its ``support`` counts the distinct scores of a
    fold, its ``param_C`` is made from that count: both stand in for a fitted model."""
    scores = views.scores(spark, sf_dir)
    levels = curves.score_levels(scores)
    models = levels.groupBy("fold").agg(
        F.count("*").alias("support"), (F.count("*") / 400).alias("param_C")
    )
    matrix = metrics.confusion(metrics.classify(scores))
    return metrics.fold_report(folds.fold_sizes(scores), models, matrix, curves.pr_auc(levels))


def fold_report(spark, sf_dir) -> DataFrame:
    return _round(_report(spark, sf_dir), "param_C", "recall", "precision", "prauc", "wss")


def mean_std(spark, sf_dir) -> DataFrame:
    return metrics.mean_std(_report(spark, sf_dir))


def micro_average(spark, sf_dir) -> DataFrame:
    return _round(metrics.micro_average(_matrix(spark, sf_dir, 0.5)), "precision", "recall")


def write_curves(spark, sf_dir) -> DataFrame:
    """Both curves of every fold and of all folds, written out and read back."""
    path = scratch_path(spark, "curves")
    files.write_curves(evaluate.curve_points(views.scores(spark, sf_dir, True)), path)
    return _round(files.read_curves(spark, path), "x", "y")


QUERIES = {
    "classify": classify,
    "confusion": confusion,
    "cross_table": cross_table,
    "precision_recall": precision_recall,
    "wss": wss,
    "pr_curve": pr_curve,
    "pr_curve_overall": pr_curve_overall,
    "pr_auc": pr_auc,
    "pr_auc_overall": pr_auc_overall,
    "pr_envelope": pr_envelope,
    "rank_documents": rank_documents,
    "rank_documents_overall": rank_documents_overall,
    "gain_curve": gain_curve,
    "gain_curve_overall": gain_curve_overall,
    "step_points": step_points,
    "screened_at_recall": screened_at_recall,
    "select_threshold": select_threshold,
    "classify_from": classify_from,
    "score_histogram": score_histogram,
    "score_histogram_overall": score_histogram_overall,
    "fold_report": fold_report,
    "mean_std": mean_std,
    "micro_average": micro_average,
    "write_curves": write_curves,
}

A, B = views.sql_scores(False), views.sql_scores(True)


def _confusion(cutoff: float) -> str:
    return f"""
matrix as (
  select fold, count(*) filter (label = 0 and relevance <= {cutoff}) as tn,
    count(*) filter (label = 0 and relevance > {cutoff}) as fp,
    count(*) filter (label = 1 and relevance <= {cutoff}) as fn,
    count(*) filter (label = 1 and relevance > {cutoff}) as tp
  from scores group by fold)"""


def _curve(by: str) -> str:
    """Cumulated counts per distinct score, falling; ``by`` is empty or ``fold,``."""
    part = f"partition by {by.rstrip(',')}" if by else ""
    return f"""
levels as (select {by} relevance, count(*) as n, cast(sum(label) as bigint) as pos from scores group by all),
cum as (
  select *, sum(n) over (w rows unbounded preceding) as cn, sum(pos) over (w rows unbounded preceding) as cp,
    sum(n) over ({part}) as an, sum(pos) over ({part}) as ap
  from levels window w as ({part} order by relevance desc)),
points as (
  select {by} relevance as threshold, cp / cn as precision, cp / ap as recall from cum
  union all select distinct {by} cast(null as double), 1.0, 0.0 from cum)"""


def _auc(by: str) -> str:
    part = f"partition by {by.rstrip(',')}" if by else ""
    group = f"group by {by.rstrip(',')}" if by else ""
    return f"""
auc as (
  select {by} sum((recall - pr) * (precision + pp) / 2) as prauc from (
    select *, lag(recall) over w as pr, lag(precision) over w as pp from points
    window w as ({part} order by threshold desc nulls first)) {group})"""


def _gain(by: str) -> str:
    part = f"partition by {by.rstrip(',')}" if by else ""
    return f"""
ranked as (select *, row_number() over ({part} order by relevance desc, label desc, article_id) as k from scores),
gain as (
  select {by} k, k / count(*) over ({part}) as screened,
    sum(label) over ({part} order by k) / sum(label) over ({part}) as recall from ranked)"""


def _steps(by: str) -> str:
    comma = by
    group = f"group by {by} recall"
    return f"""
spans as (select {comma} recall as y, min(screened) as a, max(screened) as b from gain {group}),
steps as (select {comma} a as x, y from spans union all select {comma} b, y from spans
  union all select distinct {comma} 0.0, 0.0 from spans union all select distinct {comma} 1.0, 1.0 from spans)"""


_R = "round(precision, 6) as precision, round(recall, 6) as recall"


def _histogram(bins: int, by: str, lo: str, hi: str) -> str:
    group = f"group by {by.rstrip(',')}" if by else ""
    on = "using (fold)" if by else "on true"
    return f"""
ranges as (select {by} cast({lo} as double) as lo, cast({hi} as double) as hi from scores {group}),
binned as (
  select {by} cast(least(floor((relevance - lo) / ((hi - lo) / {bins})), {bins - 1}) as int) as bin, count(*) as n
  from scores join ranges {on} where relevance between lo and hi group by all)
select {by} bin, round(lo + bin * ((hi - lo) / {bins}), 6) as lower, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) as upper,
  coalesce(n, 0) as n
from (select *, cast(unnest(range({bins})) as int) as bin from ranges) left join binned using ({by} bin)"""


_REPORT = f"""with {A}, {_curve('fold,')}, {_auc('fold,')}, {_confusion(0.26)},
sizes as (
  select fold, t0 - e0 as train_0, t1 - e1 as train_1, e0 as test_0, e1 as test_1 from (
    select fold, count(*) filter (label = 0) as e0, count(*) filter (label = 1) as e1 from scores group by fold),
    (select count(*) filter (label = 0) as t0, count(*) filter (label = 1) as t1 from scores)),
models as (select fold, count(*) as support, count(*) / 400 as param_C from levels group by fold),
report as (
  select fold + 1 as fold, train_0, train_1, test_0, test_1, param_C, support, tp / (tp + fn) as recall,
    case when tp + fp > 0 then tp / (tp + fp) end as precision, prauc,
    (tn + fn) / (tn + fp + fn + tp) - (1 - tp / (tp + fn)) as wss
  from sizes join models using (fold) join matrix using (fold) join auc using (fold))"""


def _spread(column: str) -> str:
    return f"printf('%.2f (%.2f)', avg({column}), stddev_pop({column})) as {column}"


ORACLE = {
    "classify": f"with {B} select *, cast(relevance > 0.26 as int) as pred from scores",
    "confusion": f"with {A}, {_confusion(0.26)} select * from matrix",
    "cross_table": f"""with {A} select fold, label, count(*) filter (relevance <= 0.26) as pred_0,
  count(*) filter (relevance > 0.26) as pred_1 from scores group by fold, label""",
    "precision_recall": f"""with {A}, {_confusion(0.26)}
select *, case when tp + fp > 0 then round(tp / (tp + fp), 6) end as precision,
  case when tp + fn > 0 then round(tp / (tp + fn), 6) end as recall from matrix""",
    "wss": f"""with {A}, {_confusion(0.26)}
select *, round((tn + fn) / (tn + fp + fn + tp) - (1 - tp / (tp + fn)), 6) as wss from matrix""",
    "pr_curve": f"with {B}, {_curve('fold,')} select fold, threshold, {_R} from points",
    "pr_curve_overall": f"with {A}, {_curve('')} select threshold, {_R} from points",
    "pr_auc": f"with {A}, {_curve('fold,')}, {_auc('fold,')} select fold, round(prauc, 6) as prauc from auc",
    "pr_auc_overall": f"with {B}, {_curve('')}, {_auc('')} select round(prauc, 6) as prauc from auc",
    "pr_envelope": f"""with {B}, {_curve('')}
select round(recall, 6) as recall, round(max(precision), 6) as precision from points group by recall""",
    "rank_documents": f"""with {A} select *, row_number() over (
  partition by fold order by relevance desc, label desc, article_id) as rank from scores""",
    "rank_documents_overall": f"""with {A} select *, row_number() over (
  order by relevance desc, label desc, article_id) as rank from scores""",
    "gain_curve": f"with {A}, {_gain('fold,')} select fold, k, round(screened, 6) as screened, round(recall, 6) as recall from gain",
    "gain_curve_overall": f"with {B}, {_gain('')} select k, round(screened, 6) as screened, round(recall, 6) as recall from gain",
    "step_points": f"with {B}, {_gain('fold,')}, {_steps('fold,')} select fold, round(x, 6) as x, round(y, 6) as y from steps",
    "screened_at_recall": f"""with {A}, {_gain('fold,')}
select fold, round(min(screened), 6) as screened, round(0.95 - min(screened), 6) as work_saved
from gain where recall >= 0.95 group by fold""",
    "select_threshold": f"""with {B}, {_curve('fold,')}
select fold, max(threshold) as threshold from points where recall >= 0.95 group by fold""",
    "classify_from": f"""with {B}, {_curve('fold,')},
chosen as (select fold, max(threshold) as threshold from points where recall >= 0.95 group by fold)
select article_id, s.fold, label, relevance, cast(coalesce(relevance >= threshold, false) as int) as pred
from scores s left join chosen c on s.fold = c.fold""",
    "score_histogram": f"with {B}, {_histogram(30, 'fold,', 'min(relevance)', 'max(relevance)')}",
    "score_histogram_overall": f"with {B}, {_histogram(50, '', 'any_value(0)', 'any_value(1)')}",
    "fold_report": f"""{_REPORT} select cast(fold as int) as fold, train_0, train_1, test_0, test_1, round(param_C, 6) as "param_C",
  support, {_R}, round(prauc, 6) as prauc, round(wss, 6) as wss from report""",
    "mean_std": f"""{_REPORT} select 'Mean' as fold,
  {", ".join(f"cast(cast(floor(avg({c})) as bigint) as varchar) as {c}" for c in ("train_0", "train_1", "test_0", "test_1"))},
  printf('%.2f', avg(param_C)) as "param_C",
  printf('%d (%d)', cast(floor(avg(support)) as bigint), cast(floor(stddev_pop(support)) as bigint)) as support,
  {", ".join(_spread(c) for c in ("recall", "precision", "prauc", "wss"))} from report""",
    "micro_average": f"""with {A}, {_confusion(0.5)}
select tn, fp, fn, tp, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall
from (select cast(sum(tn) as bigint) tn, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn,
             cast(sum(tp) as bigint) tp from matrix)""",
    "write_curves": f"""with {B},
{_curve('fold,').replace('levels', 'flevels').replace('cum', 'fcum').replace('points', 'fpoints')},
{_curve('')},
{_gain('fold,').replace('ranked', 'franked').replace('gain', 'fgain')},
{_gain('')},
{_steps('fold,').replace('spans', 'fspans').replace('gain', 'fgain').replace('steps', 'fsteps')},
{_steps('')}
select plot, fold, round(x, 6) as x, round(y, 6) as y from (
  select 'plot1' as plot, 'fold' || (fold + 1) as fold, recall as x, max(precision) as y from fpoints group by fold, recall
  union all select 'plot1', 'overall', recall, max(precision) from points group by recall
  union all select 'plot2', 'fold' || (fold + 1), x, y from fsteps
  union all select 'plot2', 'overall', x, y from steps)""",
}
