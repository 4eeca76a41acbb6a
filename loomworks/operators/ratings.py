"""Rating analysis (AGG1-AGG7, FLT16, JN6, SET2) and its report (SNK6-SNK8, FN28)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Dimensions in report order with their titles, and the modes compared.
TITLES = {
    "problem_design": "Problem Design Quality",
    "function_definition": "Function Definition & Naming",
    "correctness": "Algorithmic Correctness",
    "efficiency": "Algorithmic Efficiency",
    "readability": "Code Readability & Structure",
}
MODES = ("FIM", "L2R")
# Headings and lines of the text report.
REPORT, SUMMARY, BY_DIMENSION, AVERAGES = "CODE QUALITY RATING STATISTICS REPORT", "## Overall Summary", "## Dimension-wise Statistics", "## Overall Average Across All Dimensions"
SAMPLES, COUNT, AVERAGE, DIFFERENCE = "{} Total Samples: {}", "  Count:  {}", "{} Overall Average: {:.3f}", "Difference (L2R - FIM): {:+.3f}"


def by_mode(fim: DataFrame, l2r: DataFrame) -> DataFrame:
    """SET2."""
    return fim.withColumn("mode", F.lit("FIM")).unionByName(l2r.withColumn("mode", F.lit("L2R")), allowMissingColumns=True)


def scores(rated: DataFrame) -> DataFrame:
    """AGG2 + FLT16: (mode, dimension, score), each dimension filtered to 1..5 by itself.  rated: mode, ratings."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col("ratings")[d].cast("double").alias("score")) for d in TITLES])
    return rated.select("mode", F.inline(pairs)).where(F.col("score").between(1, 5))


def _frame(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """All combinations of few fixed values, as rows."""
    out = df.sparkSession.range(1).select()
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, items))))
    return out


def statistics(scored: DataFrame) -> DataFrame:
    """AGG1: mean, median (exact), population std and count for each mode and dimension; zeros where there are no scores."""
    found = scored.groupBy("mode", "dimension").agg(F.avg("score").alias("mean"), F.median("score").alias("median"), F.stddev_pop("score").alias("std"), F.count("*").alias("count"))
    frame = _frame(scored, {"mode": list(MODES), "dimension": list(TITLES)})
    return frame.join(found, ["mode", "dimension"], "left").fillna(0)


def comparison(stats: DataFrame) -> DataFrame:
    """JN6, AGG4: a row per dimension with both means and L2R minus FIM."""
    wide = stats.groupBy("dimension").pivot("mode", list(MODES)).agg(F.first("mean"))
    return wide.select("dimension", F.col("FIM").alias("fim_mean"), F.col("L2R").alias("l2r_mean"), (F.col("L2R") - F.col("FIM")).alias("difference"))


def overall(stats: DataFrame) -> DataFrame:
    """AGG3, AGG6: unweighted mean of the dimensions' means, and the samples (those with a problem design score)."""
    samples = F.sum(F.when(F.col("dimension") == "problem_design", F.col("count")).otherwise(0))
    return stats.groupBy("mode").agg(F.avg("mean").alias("overall"), samples.alias("samples"))


def histogram(scored: DataFrame) -> DataFrame:
    """AGG5: counts in five bins of width one around 1..5, zeros included."""
    found = scored.groupBy("mode", "dimension", F.least(F.lit(5), F.floor(F.col("score") + 0.5)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = _frame(scored, {"mode": list(MODES), "dimension": list(TITLES), "bin": [1, 2, 3, 4, 5]})
    return frame.join(found, ["mode", "dimension", "bin"], "left").fillna(0)


def radar(stats: dict) -> dict[str, tuple[list[float], list[float]]]:
    """AGG7, FN28: per mode the closed polygon (angles, means)."""
    angles = [2 * math.pi * i / len(TITLES) for i in range(len(TITLES))]
    return {m: (angles + angles[:1], (v := [stats[m, d]["mean"] for d in TITLES]) + v[:1]) for m in MODES}


def collected(stats: DataFrame) -> dict:
    """The ten rows of statistics()."""
    return {(r["mode"], r["dimension"]): r.asDict() for r in stats.collect()}


def report(stats: dict) -> str:
    """SNK6: the text report of ten rows of statistics."""
    wide, thin = "=" * 80, "-" * 80
    heading = lambda title: [wide, title, wide, ""]
    out = heading(REPORT) + [SUMMARY, ""]
    out += [SAMPLES.format(m, stats[m, "problem_design"]["count"]) for m in MODES] + [""]
    out += heading(BY_DIMENSION)
    difference = lambda values: DIFFERENCE.format(values["L2R"] - values["FIM"])
    for d, title in TITLES.items():
        out += [f"### {title}", ""]
        for m in MODES:
            s = stats[m, d]
            out += [f"{m}:", *(f"  {k.capitalize() + ':':<8}{s[k]:.3f}" for k in ("mean", "median", "std")), COUNT.format(s["count"]), ""]
        out += [difference({m: stats[m, d]["mean"] for m in MODES}), "", thin, ""]
    averages = {m: sum(stats[m, d]["mean"] for d in TITLES) / len(TITLES) for m in MODES}
    out += heading(AVERAGES)
    return "\n".join(out + [AVERAGE.format(m, averages[m]) for m in MODES] + [difference(averages), "", wide])


def plots(stats: dict, bins: DataFrame, folder: str) -> list[str]:
    """SNK7, SNK8: radar and histograms as PNG; needs matplotlib, else nothing is drawn."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    figure, axis = pyplot.subplots(subplot_kw={"projection": "polar"})
    for m, (angles, means) in radar(stats).items():
        axis.plot(angles, means, label=m)
        axis.fill(angles, means, alpha=0.2)
    axis.set_ylim(0, 5)
    axis.legend()
    figure.savefig(f"{folder}/radar_comparison.png")
    counts = {(r["mode"], r["dimension"], r["bin"]): r["count"] for r in bins.collect()}  # fifty rows
    figure, axes = pyplot.subplots(2, 3)
    for axis, d in zip(axes.flat, TITLES):
        for i, m in enumerate(MODES):
            axis.bar([b + 0.4 * i - 0.2 for b in range(1, 6)], [counts[m, d, b] for b in range(1, 6)], 0.4, label=m)
            axis.axvline(stats[m, d]["mean"], linestyle="--")
        axis.set_title(TITLES[d])
    axes.flat[-1].axis("off")
    figure.savefig(f"{folder}/distribution_histograms.png")
    return [f"{folder}/radar_comparison.png", f"{folder}/distribution_histograms.png"]


assert list(TITLES) == list(T.DIMENSIONS)
