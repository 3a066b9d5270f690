"""Scores of predicted labels and agreement of coders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip_bio
from marginalia.operators.pairing import pair_errors

SPAN = ["doc_id", "type", "start_idx", "end_idx"]


def ratio(top: Column, bottom: Column, none: float = 0.0) -> Column:
    return F.when(bottom == 0, none).otherwise(top / bottom)


def _f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def compare_spans(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The spans of both, with in_gold and in_pred."""
    g, p = gold.select(*SPAN).distinct().withColumn("in_gold", F.lit(True)), pred.select(*SPAN).distinct().withColumn("in_pred", F.lit(True))
    return g.join(p, SPAN, "full_outer").select(*SPAN, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


def compare_ways(spans: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The same of one table of spans with a column ``way``, by one aggregate and without a join."""
    return spans.where(F.col("way").isin(gold, pred)).groupBy(*SPAN).agg(F.max(F.col("way") == gold).alias("in_gold"), F.max(F.col("way") == pred).alias("in_pred"))


def entity_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``type, tp, fp, fn, support, precision, recall, f1`` by type; exact span and type."""
    return scores_of(compare_spans(gold, pred))


def scores_of(compared: DataFrame) -> DataFrame:
    """``entity_scores`` of compared spans."""
    both = compared.groupBy("type").agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_pred")).alias("fn"))
    return both.select("type", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def averages(scores: DataFrame) -> DataFrame:
    """``average, precision, recall, f1, support``: micro, macro and weighted by support; 0 where nothing counts."""
    c = F.col
    sums = scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("support").alias("support"), *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *[F.sum(c(m) * c("support")).alias(f"sum_{m}") for m in ("precision", "recall", "f1")])
    p, r, f = _f1(c("tp"), c("fp"), c("fn"))
    rows = [F.struct(F.lit("micro").alias("average"), p, r, f), F.struct(F.lit("macro").alias("average"), *[c(f"macro_{m}").alias(m) for m in ("precision", "recall", "f1")]), F.struct(F.lit("weighted").alias("average"), *[ratio(c(f"sum_{m}"), c("support")).alias(m) for m in ("precision", "recall", "f1")])]
    return sums.select(F.explode(F.array(*rows)).alias("a"), "support").select("a.average", *[F.coalesce(c(f"a.{m}"), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")], F.coalesce("support", F.lit(0)).alias("support"))


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``doc_id, idx, text, gold, pred``: labels side by side; fails if a token is missing or differs on one side."""
    both = gold.select("doc_id", "idx", F.col("text").alias("gt"), F.col("label").alias("gold")).join(pred.select("doc_id", "idx", F.col("text").alias("pt"), F.col("label").alias("pred")), ["doc_id", "idx"], "full_outer")
    same = F.coalesce(F.col("gt") == F.col("pt"), F.lit(False))
    text = F.when(same, F.col("gt")).otherwise(F.raise_error(F.concat(F.lit("labels are not aligned in document "), F.col("doc_id").cast("string"))).cast("string"))
    return both.select("doc_id", "idx", text.alias("text"), "gold", "pred")


def aligned_ways(voted: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``doc_id, idx, text, gold, pred`` of labels with a column ``way``: both stand on the same tokens, so one aggregate puts them side by side."""
    of = lambda way: F.max(F.when(F.col("way") == way, F.col("label")))
    return voted.where(F.col("way").isin(gold, pred)).groupBy("doc_id", "idx").agg(F.min("text").alias("text"), of(gold).alias("gold"), of(pred).alias("pred"))


def misaligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``doc_id, n``: tokens that are missing or differ on one side."""
    both = gold.select("doc_id", "idx", F.col("text").alias("gt")).join(pred.select("doc_id", "idx", F.col("text").alias("pt")), ["doc_id", "idx"], "full_outer")
    return both.where(~F.col("gt").eqNullSafe(F.col("pt"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def token_confusion(pairs: DataFrame) -> DataFrame:
    """``gold, pred, n`` of IO labels."""
    return pairs.groupBy(strip_bio(F.col("gold")).alias("gold"), strip_bio(F.col("pred")).alias("pred")).agg(F.count("*").alias("n"))


def token_scores(confusion: DataFrame, classes: tuple[str, ...] = ("Person", "Location")) -> DataFrame:
    """``type, tp, fp, fn, support, precision, recall, f1, accuracy`` by class, O left out; accuracy with O. One aggregate over the confusion, none of which gives no rows."""
    n, g, p = F.col("n"), F.col("gold"), F.col("pred")
    of = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    rows = [F.struct(F.lit(c).alias("type"), of((g == c) & (p == c)).alias("tp"), of((g != c) & (p == c)).alias("fp"), of((g == c) & (p != c)).alias("fn")) for c in classes]
    one = confusion.agg(F.array(*rows).alias("rows"), ratio(of(g == p), F.sum(n)).alias("accuracy"), F.sum(n).alias("all")).where("all is not null")
    by = one.select(F.explode("rows").alias("r"), "accuracy").select("r.*", "accuracy")
    return by.select("type", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *_f1(F.col("tp"), F.col("fp"), F.col("fn")), "accuracy")


def class_accuracy(confusion: DataFrame, warn: float = 0.95) -> DataFrame:
    """``gold, accuracy, support, pred_o_share, mostly_o``: by gold class, with the share of O among all predictions."""
    n, every = F.col("n"), Window.partitionBy()  # over a row a class
    by = confusion.groupBy("gold").agg(F.sum(F.when(F.col("gold") == F.col("pred"), n).otherwise(0)).alias("hit"), F.sum(n).alias("support"), F.sum(F.when(F.col("pred") == "O", n).otherwise(0)).alias("o"))
    share = ratio(F.sum("o").over(every), F.sum("support").over(every))
    out = by.select("gold", ratio(F.col("hit"), F.col("support")).alias("accuracy"), "support", share.alias("pred_o_share"))
    return out.withColumn("mostly_o", F.col("pred_o_share") > warn)


def distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, share``: counts and percentages."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("label", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # over a row a label


def class_weights(labels: list[str], o_weight: float = 1.0, entity_weight: float = 5.0) -> dict[str, float]:
    return {x: o_weight if x == "O" else entity_weight for x in labels}


def weight_of(label: Column, o_weight: float = 1.0, entity_weight: float = 5.0) -> Column:
    """The weight of a label, as ``class_weights`` gives it."""
    return F.when(label == "O", o_weight).otherwise(entity_weight)


def krippendorff_alpha(codings: DataFrame) -> DataFrame:
    """``alpha, n_units, n_values``: nominal agreement of ``item_id, coder, label``; items with one coding don't count, no disagreement expected is 1."""
    counts = codings.where("label is not null").groupBy("item_id", "label").agg(F.count("*").alias("n"))
    units = counts.groupBy("item_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s")).where("m >= 2")
    observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1)).alias("d_o"), F.sum("m").alias("n_all"), F.count("*").alias("n_units"))
    values = counts.join(units.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    squares = values.agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    both = observed.join(F.broadcast(squares))  # one row each
    expected = (F.col("n_all") * F.col("n_all") - F.col("sq")) / F.greatest(F.col("n_all") - 1, F.lit(1))
    return both.select(F.when(F.coalesce(expected, F.lit(0.0)) == 0, 1.0).otherwise(1 - F.col("d_o") / expected).alias("alpha"), "n_units", F.coalesce("n_all", F.lit(0)).alias("n_values"))


def pairwise_f1(spans: DataFrame, coders: list[str], by_type: bool = False) -> DataFrame:
    """``coder_a, coder_b[, type], tp, n_a, n_b, precision, recall, f1`` for each pair of coders; 1 if both have no spans.

    One aggregate finds the set of coders of each span; what follows runs on the counts
    of the sets. Coders that aren't listed don't count.
    """
    key = ["type"] if by_type else []
    of = {c: F.max(F.col("coder") == c).alias(f"c{i}") for i, c in enumerate(coders)}
    sets = spans.where(F.col("coder").isin(coders)).groupBy(*SPAN).agg(*of.values()).groupBy(*key, *[f"c{i}" for i in range(len(coders))]).agg(F.count("*").alias("n"))
    has = {c: F.col(f"c{i}") for i, c in enumerate(coders)}
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    pairs = [(a, b) for i, a in enumerate(coders) for b in coders[i + 1 :]]
    kinds = ["Person", "Location"] if by_type else [None]
    rows = []
    for k in kinds:
        own = F.lit(True) if k is None else F.col("type") == k
        for a, b in pairs:
            rows.append(F.struct(F.lit(a).alias("coder_a"), F.lit(b).alias("coder_b"), *([F.lit(k).alias("type")] if by_type else []), n(own & has[a] & has[b]).alias("tp"), n(own & has[a]).alias("n_a"), n(own & has[b]).alias("n_b")))
    out = sets.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    tp, na, nb = F.col("tp"), F.col("n_a"), F.col("n_b")
    empty = (na + nb) == 0
    return out.select("coder_a", "coder_b", *key, "tp", "n_a", "n_b", F.when(empty, 1.0).otherwise(ratio(tp, nb)).alias("precision"), F.when(empty, 1.0).otherwise(ratio(tp, na)).alias("recall"), ratio(2.0 * tp, na + nb, 1.0).alias("f1"))


def label_counts(codings: DataFrame, labels: list[str]) -> DataFrame:
    return codings.groupBy("coder").pivot("label", labels).count().na.fill(0)


def error_taxonomy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each missed or invented span once, paired where they touch: ``doc_id, category`` and both spans."""
    return taxonomy_of(compare_spans(gold, pred))


def taxonomy_of(compared: DataFrame) -> DataFrame:
    """``error_taxonomy`` of compared spans."""
    return pair_errors(compared.where("in_gold <> in_pred"))


def error_accounting(errors: DataFrame) -> DataFrame:
    """``category, n, fn, fp``: what each category adds to both counts."""
    rows = errors.groupBy("category").agg(F.count("*").alias("n"))
    return rows.select("category", "n", F.when(F.col("category") == "pure_hallucination", 0).otherwise(F.col("n")).alias("fn"), F.when(F.col("category") == "pure_miss", 0).otherwise(F.col("n")).alias("fp"))


def examples(errors: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors of each category."""
    order = Window.partitionBy("category").orderBy("doc_id", F.coalesce("gold_start", "pred_start"), F.coalesce("gold_end", "pred_end"), F.coalesce("gold_type", "pred_type"), "pred_type")
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def document_scores(pairs: DataFrame) -> DataFrame:
    """``doc_id, tokens, gold_entities, pred_entities, entity_share``."""
    return pairs.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.count_if(F.startswith("gold", F.lit("B-"))).alias("gold_entities"), F.count_if(F.startswith("pred", F.lit("B-"))).alias("pred_entities"),
        F.avg((F.col("gold") != "O").cast("double")).alias("entity_share"),
    )


def report(gold_labels: DataFrame, pred_labels: DataFrame) -> DataFrame:
    """Everything about two labellings in one row of structs and arrays, ready for JSON: entities and tokens by type and on average, confusion, errors."""
    from marginalia.operators.spans import chunk_spans

    gold, pred = chunk_spans(gold_labels), chunk_spans(pred_labels)
    confusion = token_confusion(aligned(gold_labels, pred_labels))
    by_type, tokens = entity_scores(gold, pred), token_scores(confusion)
    parts = {"entities": (by_type, "type"), "entity_averages": (averages(by_type), "average"), "tokens": (tokens, "type"), "token_averages": (averages(tokens), "average"), "confusion": (confusion, "gold"), "errors": (error_accounting(error_taxonomy(gold, pred)), "category")}
    out = None
    for name, (rows, first) in parts.items():
        rest = [c for c in rows.columns if c != first]
        one = rows.agg(F.array_sort(F.collect_list(F.struct(first, *rest))).alias(name))  # a few rows each
        out = one if out is None else out.join(F.broadcast(one))
    return out


def sample_rows(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows for looking at: those whose values have the least hashes with the seed, so always the same ones."""
    values = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    return rows.orderBy(F.md5(values)).limit(k)
