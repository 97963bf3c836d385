import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import centroids, clusters, density, features, forest, neighbours, quality, similarity

VECTORS = "vec_id long, vec array<struct<i:int,w:double>>, m long"


def vectors(n, dims, most, seed, multiplicity=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        ids = sorted(rng.choice(dims, size=rng.integers(0, most + 1), replace=False).tolist())
        w = rng.random(len(ids)) + 0.1
        w = w / np.linalg.norm(w) if ids else w
        m = int(rng.integers(1, multiplicity + 1)) if ids else 1
        out.append((k * 3 + 1, [(int(i), float(x)) for i, x in zip(ids, w)], m))
    return out


def dense(rows, dims):
    x = np.zeros((len(rows), dims))
    for r, (_, pairs, _) in enumerate(rows):
        for i, w in pairs:
            x[r, i] = w
    return x


def scan_labels(rows, dims, eps, min_samples):
    """Textbook DBSCAN in scan order on the full distance matrix."""
    x = dense(rows, dims)
    distance = 1 - x @ x.T
    np.fill_diagonal(distance, 0)
    near = distance <= eps + 1e-12
    core = near @ np.array([m for _, _, m in rows]) >= min_samples
    labels, current = np.full(len(rows), -1), 0
    for start in range(len(rows)):
        if labels[start] != -1 or not core[start]:
            continue
        waiting = [start]
        labels[start] = current
        while waiting:
            at = waiting.pop()
            if core[at]:
                for other in np.flatnonzero(near[at] & (labels == -1)):
                    labels[other] = current
                    waiting.append(other)
        current += 1
    pairs = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    return {r[0]: int(v) for r, v in zip(rows, labels)}, pairs


@pytest.mark.parametrize("n, dims, most, eps, min_samples, block", [
    (90, 60, 6, 0.35, 1, 1000), (120, 40, 4, 0.5, 4, 13), (80, 15, 5, 0.8, 2, 7),
])
def test_dbscan_and_pairs(spark, n, dims, most, eps, min_samples, block):
    rows = vectors(n, dims, most, n)
    labels, pairs = scan_labels(rows, dims, eps, min_samples)
    df = spark.createDataFrame(rows, VECTORS)
    assert {r.vec_id: r.label for r in density.dbscan(df, eps, min_samples, block).collect()} == labels
    found = [(r.id_a, r.id_b) for r in neighbours.cosine_neighbors(df, eps, block).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_dbscan_edges(spark):
    empty = [(1, [], 1), (2, [], 1)]
    df = spark.createDataFrame(empty, VECTORS)
    assert {r.label for r in density.dbscan(df, 0.8, 2).collect()} == {-1}
    assert sorted(r.label for r in density.dbscan(df, 0.35, 1).collect()) == [0, 1]
    assert [r.label for r in density.dbscan(df.limit(1), 0.8, 2).collect()] == [0]
    assert {r.label for r in density.dbscan(df, 1.0, 2).collect()} == {0}


@pytest.mark.parametrize("kind, min_samples, block, n_blocks", [("float", 1, 7, 13), ("double", 4, 16, 6), ("int", 1, 1000, 1)])
def test_dense_clusters_by_blocks(spark, monkeypatch, kind, min_samples, block, n_blocks):
    rnd = random.Random(min_samples)
    centres = [[rnd.gauss(0, 9) for _ in range(5)] for _ in range(9)]
    rows = [(i * 3, [round(x + rnd.gauss(0, 3)) * 1.0 for x in rnd.choice(centres)], 1) for i in range(91)]
    rows[4] = (rows[4][0], [0.0] * 5, 1)
    short = [(r[0], r[1][:4] if r[1][4] == 0 else r[1], 1) for r in rows]
    unit = [(i, [(k, x / sum(y * y for y in v) ** 0.5) for k, x in enumerate(v) if x], m) for i, v, m in rows]
    labels, pairs = scan_labels(unit, 5, 0.35, min_samples)
    assert 1 < len(set(labels.values())) < 80 and len(pairs) > 100

    def by_terms(*_):
        raise AssertionError("dense vectors are not posted by their terms, which all of them share")

    monkeypatch.setattr(density, "block_sides", by_terms)
    if block < 1000:
        monkeypatch.setattr(neighbours, "DENSE_NUMBERS", 5 * block)
    frame = spark.createDataFrame([(i, v) for i, v, _ in short], "vec_id long, v array<double>")
    frame = frame.selectExpr("vec_id", f"cast(v as array<{kind}>) as embedding")
    assert neighbours.dense_points(frame.withColumn("norm", F.lit(1.0)), []).first()["n_blocks"] == n_blocks
    found = clusters.semantic_clusters_dense(frame, 0.35, min_samples)
    assert found.count() == len(rows) and {r.vec_id: r.label for r in found.collect()} == labels


def test_long_chain_is_one_component(spark):
    n = 60
    vertices = spark.range(n).withColumnRenamed("id", "vec_id")
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a long, b long")
    roots = density.connected_components(vertices, edges).collect()
    assert {r.root for r in roots} == {0} and len(roots) == n


def test_silhouette_and_davies_bouldin(spark):
    dims = 12
    rows = vectors(60, dims, 5, 4)
    labels = [k % 3 - 1 for k in range(60)]
    labels[0] = 7
    x = np.repeat(dense(rows, dims), [m for _, _, m in rows], axis=0)
    y = np.repeat(labels, [m for _, _, m in rows])
    distance = 1 - x @ x.T
    np.fill_diagonal(distance, 0)
    # Copies of a vector are at distance 0, vectors without terms at 1.
    values = []
    for k in range(len(x)):
        own = (y == y[k])
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = distance[k][own].sum() / (own.sum() - 1)
        b = min(distance[k][y == other].mean() for other in set(y) - {y[k]})
        values.append((b - a) / max(a, b))
    points = spark.createDataFrame([(*r, l) for r, l in zip(rows, labels)], VECTORS + ", label int")
    for block, part in ((512, 4096), (1, 7), (2, 60)):
        assert quality.silhouette(points, block, part).first()[0] == pytest.approx(np.mean(values))

    names = sorted(set(y))
    centres = np.array([x[y == n].mean(axis=0) for n in names])
    spread = np.array([np.linalg.norm(x[y == n] - c, axis=1).mean() for n, c in zip(names, centres)])
    ratio = [max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(len(names)) if j != i)
             for i in range(len(names))]
    for block in (512, 1):
        assert quality.davies_bouldin(points, block).first()[0] == pytest.approx(np.mean(ratio))


def test_quality_of_one_cluster_is_zero(spark):
    points = spark.createDataFrame([(*r, 0) for r in vectors(5, 4, 3, 1)], VECTORS + ", label int")
    assert quality.silhouette(points).first()[0] == 0.0
    assert quality.davies_bouldin(points).first()[0] == 0.0


def test_svd(spark):
    rows = vectors(50, 10, 5, 9)
    df = spark.createDataFrame(rows, VECTORS)
    x = dense(rows, 10) * np.sqrt([[m] for _, _, m in rows])
    basis = centroids.svd_basis(df, 10, 4)
    assert np.allclose(basis.T @ basis, np.eye(4))
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(basis.T @ vt[:4].T), np.eye(4), atol=1e-8)
    reduced = {r.vec_id: r.reduced for r in centroids.svd_project(df, basis).collect()}
    assert np.allclose([reduced[r[0]] for r in rows], dense(rows, 10) @ basis)


def test_kmeans_separates_and_numbers_by_first(spark):
    rows = [(i + 1, [(i % 2, 1.0)], 2) for i in range(20)]
    got = clusters.statistical_clusters(spark.createDataFrame(rows, VECTORS), 2, "kmeans", n_clusters=2)
    assert got[1] == "kmeans"
    assert {r.vec_id: r.label for r in got[0].collect()} == {i + 1: i % 2 for i in range(20)}


def test_method_does_not_follow_the_rows(spark):
    rows = [(1, [(0, 1.0)], 2000), (2, [(1, 1.0)], 2000)]
    df = spark.createDataFrame(rows, VECTORS)
    few = df.withColumn("m", F.lit(5).cast("long"))
    labels = [sorted(map(tuple, clusters.statistical_clusters(x, 2)[0].collect())) for x in (df, few)]
    assert labels[0] == labels[1] == [(1, 0), (2, 1)]
    assert clusters.statistical_clusters(df, 2)[1] == clusters.statistical_clusters(few, 2)[1] == "dbscan"
    assert clusters.statistical_clusters(df.limit(1).withColumn("m", F.lit(1).cast("long")), 2)[1] == "single"
    with pytest.raises(ValueError):
        clusters.statistical_clusters(df, 2, "auto")


def test_more_texts_than_the_old_limits(spark):
    word = F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    texts = spark.range(5200).select(
        word.alias("text"), F.lit(1).cast("long").alias("m"), (F.col("id") + 1).alias("first_line")
    )
    assert clusters.semantic_clusters(texts, min_samples=1).count() == 5200


def feature_rows(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(i, [(0, 0.6), (1, 0.8)], [float(v) for v in rng.normal(size=3)], 1) for i in range(n)]
    rows += [(n + i, [(5, 1.0)], [8.0 + i, -9.0, 7.0], 1) for i in range(4)]
    return spark.createDataFrame(rows, "line_id long, vec array<struct<i:int,w:double>>, numeric array<double>, m long")


def test_forest_finds_planted_outliers(spark):
    df = feature_rows(spark)
    model = forest.fit_forest(forest.sample_rows(df, ["line_id"], 300, 42), ["line_id"], 6, 60)
    assert len(model) == 60
    scored = forest.score_forest(df, model, 6, 256).cache()
    top = [r.line_id for r in scored.orderBy(F.desc("outlierness")).limit(4).collect()]
    assert set(top) == {400, 401, 402, 403}
    flagged = {}
    for share in (0.05, 0.15, 0.3):
        rows = forest.detect(scored, "m", share).collect()
        flagged[share] = {r.line_id for r in rows if r.is_anomaly}
        assert len(flagged[share]) == pytest.approx(share * 404, abs=2)
        assert all((r.anomaly_score > 0) <= r.is_anomaly for r in rows)
    assert flagged[0.05] <= flagged[0.15] <= flagged[0.3]
    again = forest.fit_forest(
        forest.sample_rows(df.repartition(7), ["line_id"], 300, 42), ["line_id"], 6, 60)
    assert [t.threshold for t in again] == [t.threshold for t in model]


@pytest.mark.parametrize("share", [0.0, 0.15, 0.5, 0.977, 1.0])
def test_exact_percentile(spark, share):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=300), 3)
    weights = rng.integers(1, 6, size=300)
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)], "v double, w long")
    want = np.percentile(np.repeat(values, weights), 100 * share)
    for bins in (3, 2048):
        assert forest.exact_percentile(df, "v", "w", share, bins) == pytest.approx(want)


def test_tfidf_by_hand(spark):
    texts = spark.createDataFrame([("aa bb", 2), ("aa", 1)], "text string, m long")
    vocabulary = features.fit_vocabulary(texts, 10)
    rows = {r.term: r for r in vocabulary.collect()}
    assert {t: (r.total, r.df) for t, r in rows.items()} == {"aa": (3, 3), "bb": (2, 2), "aa bb": (2, 2)}
    assert rows["aa"].idf == pytest.approx(1.0)
    assert rows["bb"].idf == pytest.approx(math.log(4 / 3) + 1)
    got = {r.text: [x.w for x in r.vec] for r in features.vectorize(texts, vocabulary).collect()}
    assert got["aa"] == [1.0]
    assert np.linalg.norm(got["aa bb"]) == pytest.approx(1.0)
    # A fitted vocabulary serves other texts, too.
    others = spark.createDataFrame([("bb cc", 1), ("zz", 1)], "text string, m long")
    again = {r.text: r.vec for r in features.vectorize(others, vocabulary).collect()}
    assert [x.w for x in again["bb cc"]] == [1.0] and again["zz"] == []


def test_vocabulary_cut_is_by_count_then_term(spark):
    texts = spark.createDataFrame([("bb", 1), ("aa", 1), ("cc", 2)], "text string, m long")
    assert [r.term for r in features.fit_vocabulary(texts, 2).orderBy("i").collect()] == ["cc", "aa"]


def test_constant_features_scale_to_zero(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 2.0, 3), (1.0, 5.0, 4.0, 1)],
                                 "severity double, template_frequency double, message_length double, m long")
    for weight in (None, "m"):
        out = features.scaled_features(rows, weight).collect()
        assert {(r.severity_scaled, r.template_frequency_scaled) for r in out} == {(0.0, 0.0)}
    weighted = features.scaled_features(rows, "m").orderBy("message_length").collect()
    full = np.array([2.0, 2.0, 2.0, 4.0])
    assert weighted[0].message_length_scaled == pytest.approx((2 - full.mean()) / full.std())


def test_similarity_helpers(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])],
                               "vec_id long, embedding array<double>")
    top = similarity.most_similar(df, [2.0, 0.0], 3).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in top] == [(1, 1.0), (2, 0.707107), (3, 0.0)]
    tokens = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))
    row = spark.range(1).select(
        similarity.pool_tokens(tokens).alias("a"),
        similarity.masked_mean(tokens, F.array(F.lit(1), F.lit(0))).alias("b"),
        similarity.masked_mean(tokens, F.array(F.lit(0), F.lit(0))).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ([2.0, 4.0], [1.0, 3.0], [0.0, 0.0])


def test_embed_batches(spark):
    def encode(texts):
        assert len(texts) <= 2
        return [[len(t), texts.index(t)] for t in texts]

    df = spark.createDataFrame([("ab",), (" ",), ("abc",)], "text string").coalesce(1)
    got = {r.text: r.embedding for r in similarity.embed(df, encode, batch_size=2).collect()}
    assert got == {"ab": [2.0, 0.0], " ": [7.0, 1.0], "abc": [3.0, 0.0]}


def test_opposite_vectors_are_apart_at_one_and_a_half(spark):
    rows = [(1, [(0, 1.0)], 3), (2, [(0, -1.0)], 3), (3, [(0, 0.6), (1, 0.8)], 3)]
    df = spark.createDataFrame(rows[:2], VECTORS)
    assert {r.vec_id: r.label for r in density.dbscan(df, 1.5, 2).collect()} == {1: 0, 2: 1}
    assert {r.vec_id: r.label for r in density.dbscan(df, 2.0, 2).collect()} == {1: 0, 2: 0}
    three = spark.createDataFrame(rows, VECTORS)
    assert {r.vec_id: r.label for r in density.dbscan(three, 1.61, 2).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.vec_id: r.label for r in density.dbscan(three, 1.59, 2).collect()} == {1: 0, 2: 1, 3: 0}


def test_null_templates_have_a_frequency(spark):
    rows = spark.createDataFrame([(None, "INFO", "a"), (None, "INFO", "b"), ("t", "INFO", "c")], "event_template string, level string, raw_log string")
    got = features.numeric_features(rows.withColumn("clean_log", F.col("raw_log"))).collect()
    assert sorted(r.template_frequency for r in got) == [1.0, 2.0, 2.0]
