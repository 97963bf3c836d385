"""Root cause and recommendation for alert rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from faultline import fixed
from faultline.functions.levels import severity_label
from faultline.functions.rules import recommended_action, rule_cause, rule_family
from faultline.functions.text import embeddable
from faultline.operators.lookup import lookup
from faultline.operators.features import fit_vocabulary, vectorize
from faultline.operators.filters import is_alert
from faultline.operators.similarity import embed
from faultline.session import cut


def diagnose_by_rules(texts: DataFrame) -> DataFrame:
    """Cause, recommendation and family of every text, by the keyword rules."""
    cause = texts.withColumn("root_cause", rule_cause(F.col("text")))
    return cause.withColumn("recommendation", recommended_action(F.col("root_cause"))).withColumn(
        "cause_family", rule_family(F.col("text"))
    )


def _embedded_scores(documents: DataFrame, patterns: DataFrame, encode) -> DataFrame:
    """(original, scores) by the cosine of embeddings; the patterns' become literals."""
    def unit(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
        return F.element_at(
            F.transform(F.array(norm), lambda n: F.transform(values, lambda x: F.when(n > 0, x / n).otherwise(0.0))), 1
        )

    known = {
        row.original: row.unit
        for row in embed(patterns, encode, "original").select("original", unit(F.col("embedding")).alias("unit")).collect()
    }

    def similarity(pattern: str) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in known[pattern]])
        dot = F.aggregate(F.zip_with("_unit", weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.round(dot, 12)

    units = embed(documents, encode, "original").select("original", unit(F.col("embedding")).alias("_unit"))
    return units.select("original", F.array(*[similarity(p) for _, p, _, _ in fixed.KNOWLEDGE]).alias("scores"))


def diagnose_by_similarity(
    texts: DataFrame,
    threshold: float = fixed.MATCH_THRESHOLD,
    max_terms: int = fixed.TFIDF_SEMANTIC_TERMS,
    encode: Callable[[list[str]], object] | None = None,
) -> DataFrame:
    """Best knowledge-base pattern by cosine; below the threshold, the rules.

    The weights are fitted on the distinct texts and the patterns together, or come
    from ``encode`` (texts -> matrix). The patterns are a fixed handful, so their vectors
    become literals and every text is scored inside its own row: no join and no shuffle.
    """
    spark = texts.sparkSession
    patterns = spark.createDataFrame(
        [(text,) for _, text, _, _ in fixed.KNOWLEDGE], "original string"
    )
    documents = cut(texts.select(F.col("text").alias("original")).distinct())
    corpus = (
        documents.unionByName(patterns)
        .groupBy(embeddable(F.col("original")).alias("text"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    if encode is not None:
        return _picked(_embedded_scores(documents, patterns, encode), threshold)
    vocabulary = cut(fit_vocabulary(corpus, max_terms))
    known = {
        row.text: {x.i: x.w for x in row.vec}
        for row in vectorize(patterns.select(F.col("original").alias("text")), vocabulary).collect()
    }

    def similarity(pattern: str):
        weights = known[pattern]
        if not weights:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(v) for pair in sorted(weights.items()) for v in pair])
        dot = F.aggregate(
            "vec",
            F.lit(0.0),
            lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(table, x["i"]), F.lit(0.0)),
        )
        # Twelve digits: sums that are equal on paper compare as equal.
        return F.round(dot, 12)

    scored = vectorize(
        documents.select(embeddable(F.col("original")).alias("text"), "original"), vocabulary
    ).select("original", F.array(*[similarity(p) for _, p, _, _ in fixed.KNOWLEDGE]).alias("scores"))
    return _picked(scored, threshold)


def _picked(scored: DataFrame, threshold: float) -> DataFrame:
    """The best pattern's labels where it reaches the threshold, else those of the rules."""
    best = F.array_max("scores")
    place = F.array_position("scores", best).cast("int")
    picked = scored.select(
        F.col("original").alias("text"), best.alias("best_score"), place.alias("place")
    )

    def labels(at: int):
        return F.element_at(F.array(*[F.lit(entry[at]) for entry in fixed.KNOWLEDGE]), F.col("place"))

    matched = F.col("best_score") >= threshold
    ruled = diagnose_by_rules(picked)
    return ruled.select(
        "text",
        "best_score",
        F.when(matched, labels(2)).otherwise(F.col("root_cause")).alias("root_cause"),
        F.when(matched, labels(3)).otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(matched, labels(0)).otherwise(F.col("cause_family")).alias("cause_family"),
    )


def attach_diagnosis(logs: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Put the diagnosis of its template on every alert row, defaults on the rest."""
    alert = F.coalesce(is_alert(), F.lit(False))
    # Rows without an alert spread over many keys that match nothing: one null key
    # would gather most of the table in a single task.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("line_id"), F.lit(4096)).cast("string"))
    key = F.when(alert, F.coalesce(F.col("event_template"), F.lit(""))).otherwise(spread)
    table = diagnosis.select("text", F.col("root_cause").alias("_cause"), F.col("recommendation").alias("_action"))
    looked_up = lookup(logs, table, {"text": key})
    cause = F.when(alert, F.col("_cause"))
    action = F.when(alert, F.col("_action"))
    return (
        looked_up.withColumn("root_cause", F.coalesce(cause, F.lit(fixed.NORMAL_CAUSE)))
        .withColumn("recommendation", F.coalesce(action, F.lit(fixed.NORMAL_ACTION)))
        .withColumn("severity_label", severity_label(F.col("level")))
        .drop("_cause", "_action")
    )


def alert_texts(logs: DataFrame) -> DataFrame:
    return (
        logs.where(is_alert())
        .select(F.coalesce(F.col("event_template"), F.lit("")).alias("text"))
        .distinct()
    )


def generate_alerts(
    logs: DataFrame,
    threshold: float = fixed.MATCH_THRESHOLD,
    semantic: bool = True,
    encode: Callable[[list[str]], object] | None = None,
) -> DataFrame:
    """Diagnose the distinct alert templates and map the result back to the rows.

    ``encode`` replaces the TF-IDF vectors by those of a user's embedder.
    """
    texts = alert_texts(logs)
    diagnosis = diagnose_by_similarity(texts, threshold, encode=encode) if semantic else diagnose_by_rules(texts)
    return attach_diagnosis(logs, diagnosis)


def map_semantic(logs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Template -> cluster lookup; templates without a cluster get -1."""
    table = clusters.select("text", F.col("label").alias("_label"))
    looked_up = lookup(logs.drop("semantic_cluster"), table, {"text": F.coalesce(F.col("event_template"), F.lit(""))})
    return looked_up.withColumn(
        "semantic_cluster", F.coalesce(F.col("_label"), F.lit(-1)).cast("int")
    ).drop("_label")
