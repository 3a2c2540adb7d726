"""Detections and nets against golden ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.geometry import area, box, intersection
from wireloom.operators.greedy import greedy_leader
from wireloom.operators.spatial import spatial_join


def match_components(found: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sheet_id, det_id, truth_id): each detection, in its order, takes the best unused true box of its class.

    Both have sheet_id, an id, a category and a box.  A detection that finds its
    best box taken takes the next best one that is free; of equal overlaps the
    later true box wins.
    """
    a = found.select("sheet_id", "category", F.col("det_id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = truth.select("sheet_id", "category", F.col("truth_id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    shared = intersection(box("a_"), box("b_"))
    union = area(box("a_")) + area(box("b_")) - shared
    pairs = spatial_join(a, b, ["sheet_id", "category"], lambda: (shared > 0) & (shared >= F.lit(threshold) * union), 64)
    pairs = pairs.select("sheet_id", F.col("a_id").alias("det_id"), F.col("b_id").alias("truth_id"), (shared / union).alias("iou"))
    order = [F.col("det_id"), -F.col("iou"), -F.col("truth_id")]
    return greedy_leader(pairs, ["sheet_id"], order, lambda k, x: (k["det_id"] == x["det_id"]) | (k["truth_id"] == x["truth_id"]))


def compare_nets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(sheet_id, refs, verdict): nets as sorted reference lists, matched, missing or extra; nets of one reference don't count."""
    norm = lambda df: df.select("sheet_id", F.sort_array(F.array_distinct("refs")).alias("refs")).where(F.size("refs") >= 2).distinct()
    a, b = norm(found).withColumn("found", F.lit(1)), norm(truth).withColumn("true", F.lit(1))
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("true").isNull(), "extra").otherwise("matched")
    return a.join(b, ["sheet_id", "refs"], "full_outer").select("sheet_id", "refs", verdict.alias("verdict"))


def roll_up(verdicts: DataFrame) -> DataFrame:
    """Counts, recall and precision by sheet and over all (sheet_id null) from (sheet_id, verdict) rows."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return (
        verdicts.rollup("sheet_id")
        .agg(n("matched").alias("matched"), n("missing").alias("missing"), n("extra").alias("extra"))
        .withColumn("recall", F.col("matched") / F.greatest(F.lit(1), F.col("matched") + F.col("missing")))
        .withColumn("precision", F.col("matched") / F.greatest(F.lit(1), F.col("matched") + F.col("extra")))
    )


def recall_by_class(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """(category, found, expected, recall): of the true boxes, by class, those that a match (sheet_id, truth_id) names."""
    hit = matches.select("sheet_id", "truth_id", F.lit(1).alias("hit")).distinct()
    own = truth.join(hit, ["sheet_id", "truth_id"], "left").groupBy("category").agg(F.count("hit").alias("found"), F.count("*").alias("expected"))
    return own.withColumn("recall", F.col("found") / F.greatest(F.lit(1), F.col("expected")))


def false_positives(found: DataFrame, matches: DataFrame, dot: str = "junction_dot") -> DataFrame:
    """(category, n): detections that match nothing, by class; dots don't count."""
    extra = found.where(F.col("category") != dot).join(matches.select("sheet_id", "det_id"), ["sheet_id", "det_id"], "left_anti")
    return extra.groupBy("category").agg(F.count("*").alias("n"))


def sheet_scores(found: DataFrame, truth: DataFrame, matches: DataFrame, nets: DataFrame, dot: str = "junction_dot") -> DataFrame:
    """Of each sheet: components and nets found, expected and detected, recall and precision (denominators of 1 at least), and whether its nets are exact.

    ``nets``: (sheet_id, verdict) rows of :func:`compare_nets`.
    """
    sheets = truth.groupBy("sheet_id").agg(F.count("*").alias("expected"))
    hits = matches.groupBy("sheet_id").agg(F.count_distinct("truth_id").alias("found"), F.count_distinct("det_id").alias("matched"))
    seen = found.where(F.col("category") != dot).groupBy("sheet_id").agg(F.count("*").alias("detected"))
    n = lambda *vs: F.count_if(F.col("verdict").isin(*vs))
    of_nets = nets.groupBy("sheet_id").agg(n("matched").alias("nets_matched"), n("matched", "missing").alias("nets_expected"), n("matched", "extra").alias("nets_found"))
    out = sheets.join(hits, "sheet_id", "left").join(seen, "sheet_id", "left").join(of_nets, "sheet_id", "left").fillna(0)
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.withColumns(
        {
            "recall": share("found", "expected"),
            "precision": share("matched", "detected"),
            "net_recall": share("nets_matched", "nets_expected"),
            "net_precision": share("nets_matched", "nets_found"),
            "exact": (F.col("nets_matched") == F.col("nets_expected")) & (F.col("nets_matched") == F.col("nets_found")) & (F.col("nets_found") > 0),
        }
    )


def bench(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Sums and shares over the sheets, of each mode or model where ``by`` names a column."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    sums = scores.groupBy(*([by] if by else [])).agg(F.count("*").alias("sheets"), *map(total, ("found", "expected", "detected", "nets_matched", "nets_expected")), F.count_if("exact").alias("exact_sheets"))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return sums.withColumns({"recall": share("found", "expected"), "precision": share("found", "detected"), "net_recall": share("nets_matched", "nets_expected")})


def worst_sheets(scores: DataFrame, most: int = 3) -> DataFrame:
    """The sheets with the least net recall (ties: smaller id): a report's top list."""
    return scores.orderBy("net_recall", "sheet_id").limit(most)


def designator_scores(matches: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """Of each sheet: named true components, those whose match carries their name, another one, and the right ones that were read.

    ``found``: designator and its origin; true names that begin with ``_`` are no names.
    """
    true = truth.select("sheet_id", "truth_id", F.col("designator").alias("true_name")).where(~F.col("true_name").startswith("_"))
    own = found.select("sheet_id", "det_id", "designator", "origin")
    named = true.join(matches, ["sheet_id", "truth_id"], "left").join(own, ["sheet_id", "det_id"], "left")
    right = F.col("designator").eqNullSafe(F.col("true_name"))
    met = F.col("det_id").isNotNull()
    return named.groupBy("sheet_id").agg(
        F.count("*").alias("expected"), F.count_if(met & right).alias("correct"), F.count_if(met & ~right).alias("wrong"), F.count_if(met & right & (F.col("origin") == "ocr")).alias("read")
    )


def symmetric_ref(designator: Column, pin: Column, category: Column, symmetric: list[str]) -> Column:
    """``NAME:PIN``, or ``NAME:*`` for classes whose pins may be swapped."""
    return F.concat(designator, F.lit(":"), F.when(category.isin(symmetric), "*").otherwise(pin))
