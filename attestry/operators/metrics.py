"""Ranking, classification, calibration and sampling measures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.relational import ratio

CUTS = (1, 5, 10, 20, 50)


def ranking_metrics(rankings: DataFrame, qrels: DataFrame, query_key: list[str], doc_keys: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Per query with relevant documents: gold, first_rank, reciprocal_rank, hit and recall at each cut (M1).

    A query whose ranking is empty scores 0. Relevant documents count once.
    """
    gold = qrels.select(*query_key, *doc_keys).distinct()
    found = gold.join(rankings.select(*query_key, *doc_keys, "rank"), [*query_key, *doc_keys], "left")
    best = found.groupBy(*query_key, *doc_keys).agg(F.min("rank").alias("rank"))
    out = best.groupBy(*query_key).agg(
        F.count("*").alias("gold"),
        F.min("rank").alias("first_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in cuts],
    )
    return out.select(
        *query_key, "gold", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        *[F.when(F.col(f"_found_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in cuts],
        *[(F.col(f"_found_{k}") / F.col("gold")).alias(f"recall_at_{k}") for k in cuts],
    )


def ranking_summary(per_query: DataFrame, cuts: tuple[int, ...] = CUTS, digits: int = 6) -> DataFrame:
    """One row: queries, mean reciprocal rank, hits and recalls."""
    return per_query.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("reciprocal_rank"), digits).alias("mrr"),
        *[F.round(F.avg(f"{m}_at_{k}"), digits).alias(f"{m}_at_{k}") for m in ("hit", "recall") for k in cuts],
    )


def confusion_matrix(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...], predictions: tuple[str, ...]) -> DataFrame:
    """(gold, predicted, n) for every combination, zeros included (M3)."""
    cells = F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("predicted")) for g in labels for p in predictions])
    grid = df.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...], digits: int = 6) -> DataFrame:
    """(label, support, precision, recall, f1) in one pass, every label present."""
    sums = []
    for i, x in enumerate(labels):
        g, p = F.col(gold) == x, F.col(predicted) == x
        sums += [F.count_if(g & p).alias(f"tp{i}"), F.count_if(p).alias(f"p{i}"), F.count_if(g).alias(f"g{i}")]
    one = df.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"p{i}").alias("p"), F.col(f"g{i}").alias("g")) for i, x in enumerate(labels)]))
    m = one.select(rows.alias("r")).select("r.*")
    m = m.select("label", F.col("g").alias("support"), ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.select("label", "support", F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"), F.round(f1, digits).alias("f1"))


def classification_summary(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...], digits: int = 6) -> DataFrame:
    """One row: accuracy, macro and weighted F1, macro precision and recall."""
    per = class_metrics(df, gold, predicted, labels, 12)
    macro = per.agg(
        F.round(F.avg("f1"), digits).alias("macro_f1"), F.round(F.avg("precision"), digits).alias("macro_precision"), F.round(F.avg("recall"), digits).alias("macro_recall"),
        F.round(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), digits).alias("weighted_f1"),
    )
    whole = df.agg(F.count("*").alias("n"), F.round(ratio(F.count_if(F.col(gold) == F.col(predicted)), F.count("*")), digits).alias("accuracy"))
    return whole.join(macro)


def selective_metrics(df: DataFrame, gold: str, predicted: str, decided: tuple[str, ...], digits: int = 6) -> DataFrame:
    """Coverage, accuracy of decided cases, abstained and conflicting cases (M5). No decided case: accuracy null."""
    d = F.col(predicted).isin(*decided)
    return df.agg(
        F.count("*").alias("total"),
        F.round(ratio(F.count_if(d), F.count("*"), None), digits).alias("decision_coverage"),
        F.round(ratio(F.count_if(d & (F.col(gold) == F.col(predicted))), F.count_if(d), None), digits).alias("decided_accuracy"),
        F.count_if(~d).alias("abstained"),
        F.count_if(F.col(predicted) == "CONFLICT").alias("conflicting"),
    )


def gold_set_hits(gold: DataFrame, observed: DataFrame, case: list[str], set_key: str, page: str, sentence: str) -> DataFrame:
    """(case, any_page, any_sentence, complete_set) of cases with gold sets (M6, U4): all items of any one set observed."""
    seen = observed.select(*case, page, sentence).distinct().withColumn("_s", F.lit(1))
    pages = observed.select(*case, page).distinct().withColumn("_p", F.lit(1))
    x = gold.join(seen, [*case, page, sentence], "left").join(pages, [*case, page], "left")
    sets = x.groupBy(*case, set_key).agg(
        F.bool_or(F.col("_p").isNotNull()).alias("any_page"), F.bool_or(F.col("_s").isNotNull()).alias("any_sentence"), F.bool_and(F.col("_s").isNotNull()).alias("complete_set")
    )
    return sets.groupBy(*case).agg(*[F.bool_or(x).alias(x) for x in ("any_page", "any_sentence", "complete_set")])


def failure_rows(cases: DataFrame, hits: DataFrame, evidence: DataFrame, case: str) -> DataFrame:
    """Cases predicted otherwise than labelled, with a failure type and flags joined by ';' (M8).

    ``cases`` has case, claim, label, predicted; ``hits`` as of gold_set_hits; ``evidence`` one row per screened sentence: case,
    decision of the screening, and for selected ones nli_label and accepted. A decisive label that was not accepted is
    flagged whatever kept it from being accepted.
    """
    decisive, chosen = F.col("nli_label").isin("ENTAILMENT", "CONTRADICTION"), F.col("decision") == "SELECTED"
    e = evidence.groupBy(case).agg(
        F.bool_or(decisive & F.col("accepted")).alias("_yes"), F.bool_or(decisive & ~F.col("accepted")).alias("_no"), F.count_if(chosen).alias("assessed_count"),
        F.count_if(~chosen & (F.col("decision") != "UNUSED")).alias("excluded_count"), F.bool_or(F.col("decision") == "ENTITY_VARIANT_MISMATCH").alias("_variant"),
    )
    x = cases.where(~F.col("label").eqNullSafe(F.col("predicted"))).join(hits, case, "left").join(e, case, "left")
    kind = (
        F.when(F.col("predicted") == "CONFLICT", "CONFLICTING_PREDICTION")
        .when(F.col("predicted").isin("SUPPORTS", "REFUTES"), "WRONG_DECISIVE_VERDICT")
        .when(F.col("label") != "NOT ENOUGH INFO", "ABSTENTION_ON_DECISIVE_GOLD")
        .otherwise("NEI_ABSTENTION")
    )
    flags = F.concat_ws(
        ";",
        F.when(~F.col("any_page"), "GOLD_PAGE_NOT_ASSESSED").when(~F.col("any_sentence"), "GOLD_SENTENCE_NOT_ASSESSED").when(~F.col("complete_set"), "GOLD_SET_INCOMPLETE_IN_ASSESSED"),
        F.when(~F.coalesce("_yes", F.lit(False)), "NO_ACCEPTED_DECISIVE_NLI"),
        F.when(F.col("_no"), "DECISIVE_LABEL_BELOW_THRESHOLD"),
        F.when(F.col("_variant"), "ENTITY_VARIANT_FILTER_APPLIED"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("assessed_count", "excluded_count")]
    return x.select(case, "claim", "label", "predicted", kind.alias("failure_type"), flags.alias("flags"), F.col("any_sentence").alias("gold_sentence_assessed"), F.col("complete_set").alias("gold_set_assessed"), *counts)


def benchmark_summary(cases: DataFrame, hits: DataFrame, evidence: DataFrame, case: str, labels: tuple[str, ...], digits: int = 6) -> DataFrame:
    """One row: the whole of a benchmark (M7). Inputs as of ``failure_rows``; no case: one row of zeros and nulls.

    Distributions and exclusions are maps; per class measures and the confusion are arrays in the order of labels and names.
    """
    as_map = lambda d, k, v, n: d.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(n))
    counted = lambda c, n: as_map(cases.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")), c, "n", n)
    per = class_metrics(cases, "label", "predicted", labels, digits)
    confusion = confusion_matrix(cases, "label", "predicted", labels, (*labels, "CONFLICT"))
    excluded = evidence.where(~F.col("decision").isin("SELECTED", "UNUSED")).groupBy("decision").agg(F.count("*").alias("n"))
    share = lambda c: F.round(ratio(F.count_if(c), F.count("*"), None), digits)
    assessed = cases.select(case).join(evidence.where("decision = 'SELECTED'").groupBy(case).agg(F.count("*").alias("n")), case, "left")
    parts = [
        selective_metrics(cases, "label", "predicted", ("SUPPORTS", "REFUTES"), digits),
        cases.agg(share(F.col("label") == F.col("predicted")).alias("label_agreement")),
        counted("label", "gold_labels"),
        counted("predicted", "predicted_labels"),
        per.agg(F.round(F.avg("f1"), digits).alias("macro_f1"), F.array_sort(F.collect_list(F.struct("label", "support", "precision", "recall", "f1"))).alias("per_class")),
        confusion.agg(F.array_sort(F.collect_list(F.struct("gold", "predicted", "n"))).alias("confusion")),
        as_map(excluded, "decision", "n", "exclusion_reasons"),
        hits.join(cases.select(case), case, "left_semi").agg(
            F.count("*").alias("gold_annotated"), share(F.col("any_page")).alias("any_page_rate"), share(F.col("any_sentence")).alias("any_sentence_rate"), share(F.col("complete_set")).alias("complete_set_rate")
        ),
        assessed.agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 3).alias("mean_assessed")),
    ]
    # Each part is one row.
    return reduce(lambda a, b: a.join(b), parts)


def calibration_bins(df: DataFrame, confidence: str, correct: Column, bins: int = 15) -> DataFrame:
    """(bin, n, accuracy, confidence) of equal-width bins; confidence 1 falls in the last."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))


def expected_calibration_error(binned: DataFrame, digits: int = 6) -> DataFrame:
    whole = F.sum("n")
    return binned.agg(F.round(ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), whole), digits).alias("ece"), whole.alias("n"))


def probability_scores(df: DataFrame, probabilities: list[str], gold_id: str, digits: int = 6) -> DataFrame:
    """One row: mean negative log likelihood (clipped at 1e-15), multiclass Brier score, mean confidence, accuracy."""
    ps = [F.col(p) for p in probabilities]
    of_gold = F.get(F.array(*ps), F.col(gold_id))
    brier = reduce(lambda a, b: a + b, [F.pow(p - F.when(F.col(gold_id) == i, 1.0).otherwise(0.0), 2) for i, p in enumerate(ps)])
    top = F.array_position(F.array(*ps), F.greatest(*ps)) - 1
    return df.agg(
        F.count("*").alias("n"),
        F.round(F.avg(-F.log(F.greatest(of_gold, F.lit(1e-15)))), digits).alias("nll"),
        F.round(F.avg(brier), digits).alias("brier"),
        F.round(F.avg(F.greatest(*ps)), digits).alias("mean_confidence"),
        F.round(F.avg((top == F.col(gold_id)).cast("double")), digits).alias("accuracy"),
    )


def selective_accuracy(df: DataFrame, confidence: str, correct: str, thresholds: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95), digits: int = 6) -> DataFrame:
    """(threshold, accepted, coverage, accuracy) in one pass (M12). None accepted: accuracy null."""
    sums = [F.count("*").alias("n")]
    for i, t in enumerate(thresholds):
        a = F.col(confidence) >= t
        sums += [F.count_if(a).alias(f"a{i}"), F.count_if(a & F.col(correct)).alias(f"c{i}")]
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("a"), F.col(f"c{i}").alias("c"), F.col("n").alias("n")) for i, t in enumerate(thresholds)]
    x = df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return x.select(
        "threshold", F.col("a").alias("accepted"), F.round(ratio(F.col("a"), F.col("n")), digits).alias("coverage"), F.round(ratio(F.col("c"), F.col("a"), None), digits).alias("accuracy")
    )


def fit_temperature(df: DataFrame, logits: list[str], gold_id: str, low: float = 0.05, high: float = 10.0, rounds: int = 8, points: int = 13) -> float:
    """Temperature of least negative log likelihood (M13): grids in log T, narrowed round by round.

    Each round is one aggregate that evaluates all its points in a single pass over the data. Where rows have a
    null or non-finite logit they are left out; without rows the result is 1.
    """
    from attestry.functions.labels import softmax

    a, b = math.log(low), math.log(high)
    best = 1.0
    loss = -F.log(F.greatest(F.get(F.array(*softmax([F.col(x) for x in logits], F.col("_t"))), F.col(gold_id)), F.lit(1e-15)))
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        each = df.select(*logits, gold_id, F.explode(F.array(*map(F.lit, grid))).alias("_t")).groupBy("_t").agg(F.avg(loss).alias("loss"))
        losses = {r["_t"]: r["loss"] for r in each.where("loss is not null").collect()}
        if not losses:
            return best
        k = min(range(points), key=lambda i: losses[grid[i]])
        best = grid[k]
        a, b = math.log(grid[max(0, k - 1)]), math.log(grid[min(points - 1, k + 1)])
    return best


def half_split(df: DataFrame, label: str, row_id: str, seed: int = 0) -> DataFrame:
    """Column ``half`` 0 or 1: halves of each label by hash order (M14); they differ by one row at most."""
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    ranked = exact_rank(df.withColumn("_h", h), [label], ["_h", row_id])
    return ranked.withColumn("half", (F.col("_rank") % 2).cast("int")).drop("_h", "_rank")


def exact_rank(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Column ``_rank`` from 1 within each key in the order of a hash column ``order[0]``, without sorting a key in one task.

    Rows are ranked within 1024 hash ranges; a range's offset is the number of rows in the ranges before it.
    """
    from pyspark.sql import Window

    b = F.shiftright(F.col(order[0]), 54)  # signed: the top ten bits keep the order
    x = df.withColumn("_b", b)
    sizes = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_b"]]
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order[:1], *order[1:]))
    ranked = x.withColumn("_place", place).alias("x").join(before.alias("y"), on)
    return ranked.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x._place") + F.col("y._before")).alias("_rank"))


def balanced_quotas(available: dict[str, int], labels: tuple[str, ...], most: int) -> dict[str, int]:
    """Rows per label: equal shares, the remainder dealt one at a time in label order among labels with rows left."""
    target = min(most, sum(available.get(x, 0) for x in labels))
    quota = {x: min(target // len(labels), available.get(x, 0)) for x in labels}
    while (left := target - sum(quota.values())) > 0:
        for x in [x for x in labels if quota[x] < available.get(x, 0)][:left]:
            quota[x] += 1
    return quota


def balanced_sample(df: DataFrame, label: str, row_id: str, labels: tuple[str, ...], most: int, seed: int = 0) -> DataFrame:
    """A sample of at most ``most`` rows, as even over the labels as their rows allow, by hash order."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isin(*labels)).groupBy(label).count().collect()}
    quota = balanced_quotas(counts, labels, most)
    ranked = exact_rank(df.where(F.col(label).isin(*labels)).withColumn("_h", F.xxhash64(F.lit(seed), F.col(row_id))), [label], ["_h", row_id])
    wanted = reduce(lambda o, x: F.when(F.col(label) == x, quota[x]).otherwise(o), labels, F.lit(0))
    return ranked.where(F.col("_rank") <= wanted).drop("_h", "_rank")


def winner(df: DataFrame, name: str, score: str) -> DataFrame:
    """Name with the greatest score; the smallest name on ties."""
    best = df.where(F.col(score).isNotNull()).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("b"))
    return best.select(F.col("b.n").alias(name), (-F.col("b.s")).alias(score))


def same_rankings(a: DataFrame, b: DataFrame, key: list[str], doc: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Places at which two rankings differ in document or score (M20); none if they are the same."""
    x = a.select(*key, "rank", F.struct(*doc).alias("doc_a"), F.col("score").alias("score_a"))
    y = b.select(*key, "rank", F.struct(*doc).alias("doc_b"), F.col("score").alias("score_b"))
    return x.join(y, [*key, "rank"], "full").where(~F.col("doc_a").eqNullSafe(F.col("doc_b")) | (F.abs(F.col("score_a") - F.col("score_b")) > tolerance))
