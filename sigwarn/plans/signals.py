"""Queries on windows of a sampled signal: the values of events, dealt in turn to three channels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.operators import autoregression as v
from sigwarn.operators import signals as s
from sigwarn.registry import query
from sigwarn.sources.tables import SUBJECTS, read

CHANNELS, LENGTH, FS, ORDER = 3, 64, 64, 2


#: A window is of class 1 if more than a fifth of its events are errors.
ERROR_SHARE = 0.2


def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(win, label, x): windows of the interleaved values, with the class of each."""
    label = (F.avg((F.col("event_type") == "error").cast("double")) > ERROR_SHARE).cast("int").alias("label")
    return s.windows(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), [], "event_id", "value", CHANNELS, LENGTH, label)


def _query(name: str, doc: str, helper) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s.apply(signal_windows(spark, sf_dir).drop("label"), helper, CHANNELS, LENGTH)

    run.__name__, run.__doc__ = name, doc
    query()(run)


def _on_model(view, x):
    return view(v.autoregression(x, ORDER)[0], FS)


for _name, _doc, _helper in (
    ("i2_autoregression", "Coefficients of each window.", lambda x: v.autoregression(x, ORDER)[0]),
    ("i3_granger", "Absolute influence of channels on each other.", partial(v.granger, order=ORDER)),
    ("i4_signed_views", "Signed, absolute and first-lag views.", partial(v.signed_views, order=ORDER)),
    ("i6_directed_coherence", "Partial directed coherence of bands.", partial(_on_model, s.directed_coherence)),
    ("i7_directed_transfer", "Directed transfer of bands.", partial(_on_model, s.directed_transfer)),
    ("i8_transfer_magnitude", "Transfer magnitude of bands.", partial(_on_model, s.transfer_magnitude)),
    ("i13_coherence", "Mean coherence of channels.", partial(s.coherence, segment=32)),
    ("i14_band_power", "Band powers.", partial(s.band_power, fs=FS, segment=32)),
    ("i15_spectrogram", "Log spectrogram.", lambda x: s.log_spectrogram(x, 16, 1, 8)),
):
    _query(_name, _doc, _helper)


@query()
def i1_band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the filtered recording; null where a sample is missing."""
    return s.filter_recordings(read(spark, sf_dir, "events"), [], "event_id", "value", CHANNELS, LENGTH, FS)


#: Orders that are compared.
ORDERS = [1, 2, 3, 4, 5, 7, 10]
CRITERIA = ("log_det", "aic", "bic", "mean_variance")


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, label, p, n_windows, means of CRITERIA) over the windows that have a model of order p.

    One pass over the windows gives all orders: lag products are summed once a window.
    """
    rows = s.apply(signal_windows(spark, sf_dir), partial(v.order_criteria, orders=ORDERS), CHANNELS, LENGTH, whole=False).where("valid")
    size = len(CRITERIA)
    each = rows.select((F.col("win") % SUBJECTS).alias("subject_id"), "label", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.slice("features", size * k + 1, size).alias("c")) for k, p in enumerate(ORDERS)])))
    fitted = each.where(~F.exists("c", lambda x: x.isNull()))
    return fitted.groupBy("subject_id", "label", "p").agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(F.get("c", F.lit(k))).alias(n) for k, n in enumerate(CRITERIA)])


@query()
def i5_order_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual criteria of each order, by subject and class."""
    return criteria(spark, sf_dir)


@query()
def f3_best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that each criterion prefers, by subject and class; of equal orders the smaller one."""
    return best_orders(criteria(spark, sf_dir))


def best_orders(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("subject_id", "label").agg(F.min_by("p", F.struct("aic", "p")).alias("by_aic"), F.min_by("p", F.struct("bic", "p")).alias("by_bic"))


def modal_orders(best: DataFrame) -> DataFrame:
    """(label, subjects, by_aic, by_bic): the order that most subjects of a class prefer; of equally frequent ones the smallest."""
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("subjects"), F.mode("by_aic", True).alias("by_aic"), F.mode("by_bic", True).alias("by_bic"))


@query()
def f3_modal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modal_orders(f3_best_order(spark, sf_dir))
