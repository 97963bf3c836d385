"""TF-IDF over words and word pairs, and the numeric features of a log line.

Texts are reduced to distinct values with a multiplicity before any term is
exploded, so a template that makes up a third of all rows costs one row here.
The vocabulary is at most a few hundred terms by definition, which is the size
bound of everything that is broadcast or turned into literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import fixed
from faultline.functions.levels import severity_weight
from faultline.functions.text import terms
from faultline.operators.lookup import lookup

VECTOR = "array<struct<i:int,w:double>>"


def distinct_texts(rows: DataFrame, text: Column, order: Column | None = None) -> DataFrame:
    """Distinct texts with their number of rows ``m`` and first line."""
    aggregates = [F.count(F.lit(1)).alias("m")]
    if order is not None:
        aggregates.append(F.min(order).alias("first_line"))
    return rows.groupBy(text.alias("text")).agg(*aggregates)


def fit_vocabulary(texts: DataFrame, max_terms: int) -> DataFrame:
    """The most frequent terms with their smoothed inverse document frequency.

    ``texts`` has columns text and m; every text counts m times. Equal totals are
    ordered by term. The result has at most ``max_terms`` rows. Occurrences and
    documents are counted in one aggregation by term, reduced before its shuffle.
    """
    n_rows = texts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    listed = texts.select("m", terms(F.col("text")).alias("all"))
    marks = F.concat(
        F.transform("all", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(
            F.array_distinct("all"),
            lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")),
        ),
    )
    top = (
        listed.select("m", F.explode(marks).alias("x"))
        .groupBy(F.col("x.term").alias("term"))
        .agg(
            F.sum(F.col("x.tf") * F.col("m")).alias("total"),
            F.sum(F.col("x.df") * F.col("m")).alias("df"),
        )
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )
    # A window over at most max_terms rows.
    rank = F.row_number().over(W.partitionBy().orderBy(F.desc("total"), "term")) - 1
    idf = F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("df"))) + 1.0
    return top.select("term", rank.cast("int").alias("i"), "total", "df", idf.alias("idf"))


def vectorize(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``vec``: unit-length sparse weights in term order, empty without terms.

    The vocabulary, a few hundred rows by definition, becomes a literal, so every text is
    weighted inside its own row: no join, no shuffle and no trip to Python.
    """
    known = vocabulary.select("term", "i", "idf").orderBy("i").collect()
    if not known:
        return texts.withColumn("vec", F.array().cast(VECTOR))
    place = F.create_map(*[F.lit(x) for row in known for x in (row.term, row.i)])
    idf = F.array(*[F.lit(row.idf) for row in known])

    # Arrays of one bind what is used twice: sorted places, then weights, then their norm.
    def runs(p: Column) -> Column:
        starts = F.filter(
            F.transform(p, lambda x, k: F.when((k == 0) | (F.get(p, k - 1) != x), F.struct(x.alias("i"), k.alias("k")))),
            lambda r: r.isNotNull(),
        )
        return F.element_at(F.transform(F.array(starts), lambda r: weights(r, F.size(p))), 1)

    def weights(r: Column, size: Column) -> Column:
        times = F.transform(
            r, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(r, k + 1)["k"], size) - x["k"]).alias("n"))
        )
        return F.transform(times, lambda x: F.struct(x["i"].alias("i"), (x["n"] * F.get(idf, x["i"])).alias("w")))

    def scaled(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return F.element_at(
            F.transform(F.array(norm), lambda n: F.transform(raw, lambda x: F.struct(x["i"].alias("i"), (x["w"] / n).alias("w")))), 1
        )

    found = F.array_sort(F.filter(F.transform(terms(F.col("text")), lambda t: F.try_element_at(place, t)), lambda i: i.isNotNull()))
    raw = F.element_at(F.transform(F.array(found), runs), 1)
    vec = F.element_at(F.transform(F.array(raw), scaled), 1)
    return texts.withColumn("vec", F.coalesce(vec, F.array().cast(VECTOR)).cast(VECTOR))


def long_form(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(text, term, weight) rows of the vectors."""
    # The outer form keeps the planner from computing the vectors a second time in a
    # filter on their size; empty vectors find no term below.
    return (
        vectors.select("text", F.explode_outer("vec").alias("x"))
        .select("text", F.col("x.i").alias("i"), F.col("x.w").alias("weight"))
        .join(F.broadcast(vocabulary.select("i", "term")), "i")
        .select("text", "term", "weight")
    )


def row_features(logs: DataFrame) -> DataFrame:
    """Add severity and message_length, which a row tells by itself."""
    length = F.char_length(F.coalesce(F.col("clean_log"), F.col("raw_log"))).cast("double")
    return logs.withColumn("severity", severity_weight(F.col("level"))).withColumn("message_length", length)


def numeric_features(logs: DataFrame) -> DataFrame:
    """Add severity, template_frequency and message_length; a null template counts as a template."""
    template = F.col("event_template")
    # Nulls have a key of their own, which no template has.
    key = F.coalesce(F.concat(F.lit("="), template), F.lit(""))
    frequency = logs.groupBy(key.alias("_template")).agg(F.count(F.lit(1)).cast("double").alias("template_frequency"))
    return row_features(lookup(logs.drop("template_frequency"), frequency, {"_template": key}))


NUMERIC = ["severity", "template_frequency", "message_length"]


def scaled_features(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Standardise the numeric features by population deviation; constants give 0.

    With ``weight`` each row stands for that many rows.
    """
    if weight is None:
        row = rows.agg(
            *[F.avg(c).alias(f"{c}_mean") for c in NUMERIC],
            *[F.stddev_pop(c).alias(f"{c}_spread") for c in NUMERIC],
        ).first()
        mean = {c: row[f"{c}_mean"] for c in NUMERIC}
        spread = {c: row[f"{c}_spread"] for c in NUMERIC}
    else:
        times = F.col(weight).cast("double")
        mean = rows.agg(*[(F.sum(F.col(c) * times) / F.sum(times)).alias(c) for c in NUMERIC]).first()
        away = {c: (F.col(c) - F.lit(mean[c])) * (F.col(c) - F.lit(mean[c])) for c in NUMERIC}
        spread = rows.agg(
            *[F.sqrt(F.sum(away[c] * times) / F.sum(times)).alias(c) for c in NUMERIC]
        ).first()
    scaled = [
        ((F.col(c) - F.lit(mean[c])) / F.lit(spread[c] or 1.0)).alias(f"{c}_scaled")
        for c in NUMERIC
    ]
    return rows.select("*", *scaled)


def semantic_candidates(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Templates with their frequency; those past a limit, if one is set, stay unassigned downstream."""
    texts = distinct_texts(
        logs, F.coalesce(F.col("event_template"), F.lit("")), F.col("line_id")
    )
    return texts if limit is None else texts.orderBy(F.desc("m"), "first_line", "text").limit(limit)
