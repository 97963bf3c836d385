import pytest
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.rules import recommended_action, rule_cause, rule_family
from faultline.operators import diagnosis


def rules(spark, message):
    df = spark.createDataFrame([(message,)], "t string")
    return df.select(
        rule_cause(F.col("t")).alias("cause"),
        rule_family(F.col("t")).alias("family"),
        recommended_action(rule_cause(F.col("t"))).alias("action"),
    ).first()


@pytest.mark.parametrize("message, word, family, action", [
    ("SQL query failed", "base de datos", "DB", fixed.ACTION_DB),
    ("Network unreachable", "red", "NET", fixed.ACTION_NET),
    ("Disk full", "disco", "DISK", fixed.ACTION_DISK),
    ("OOM error", "recursos", "RES", fixed.ACTION_RES),
    ("Permission denied", "autenticacion", "AUTH", fixed.ACTION_AUTH),
    ("bad YAML", "configuración", "CONF", fixed.ACTION_CONF),
    ("daemon gone", "servicio", "SVC", fixed.ACTION_SVC),
    ("Unknown error xyz", "anomalia detectada", "OTHER", fixed.UNKNOWN_ACTION),
    # Keywords match inside words, and the first rule wins.
    ("feedback", "base de datos", "DB", fixed.ACTION_DB),
    ("thread support", "red", "NET", fixed.ACTION_NET),
])
def test_rules(spark, message, word, family, action):
    row = rules(spark, message)
    assert word in row.cause.lower()
    assert (row.family, row.action) == (family, action)


def test_recommended_action_of_free_text(spark):
    df = spark.createDataFrame([("Posible caida o saturacion de base de datos",), ("requiere revision",)], "t string")
    got = [r[0] for r in df.select(recommended_action(F.col("t"))).collect()]
    assert got == [fixed.ACTION_DB, fixed.UNKNOWN_ACTION]


def by_hand(texts, threshold):
    """The same decision with plain Python numbers."""
    import math
    import re
    from collections import Counter

    corpus = list(dict.fromkeys(texts)) + [p for _, p, _, _ in fixed.KNOWLEDGE]

    def terms(t):
        words = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counts = [terms(t) for t in corpus]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    vocabulary = sorted(total, key=lambda t: (-total[t], t))[:384]
    idf = {t: math.log((1 + len(corpus)) / (1 + df[t])) + 1 for t in vocabulary}
    vectors = []
    for c in counts:
        v = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / norm for t, w in v.items()} if norm else {})
    out = {}
    for t, v in zip(corpus, vectors[: len(corpus) - 7]):
        scores = [sum(w * p.get(k, 0) for k, w in v.items()) for p in vectors[-7:]]
        best = max(range(7), key=lambda i: (round(scores[i], 12), -i))
        out[t] = (fixed.KNOWLEDGE[best][2] if scores[best] >= threshold else None, round(scores[best], 9))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_similarity_by_hand(spark, threshold):
    texts = ["Database connection timeout", "Network connection refused", "Random unknown thing",
             "Service crashed daemon stopped fatal exit core dumped", "!!", ""]
    rows = diagnosis.diagnose_by_similarity(spark.createDataFrame([(t,) for t in texts], "text string"), threshold)
    got = {r.text: r for r in rows.collect()}
    assert set(got) == set(texts)
    for t, (cause, score) in by_hand([x for x in texts if x.strip()] + ["[EMPTY]"], threshold).items():
        row = got["" if t == "[EMPTY]" else t]
        assert round(row.best_score, 9) == score
        if cause:
            assert row.root_cause == cause
    assert "base de datos" in got["Database connection timeout"].root_cause.lower()


def test_only_alerts_get_a_diagnosis(spark):
    rows = [(1, "INFO", False, "sql one"), (2, "WARN", False, "sql one"), (3, "INFO", True, "odd"),
            (4, "FATAL", False, None)]
    df = spark.createDataFrame(rows, "line_id long, level string, is_anomaly boolean, event_template string")
    got = {r.line_id: r for r in diagnosis.generate_alerts(df, semantic=False).collect()}
    assert len(got) == 4
    assert (got[1].root_cause, got[1].recommendation) == (fixed.NORMAL_CAUSE, fixed.NORMAL_ACTION)
    assert got[2].recommendation == fixed.ACTION_DB and got[2].severity_label == "WARNING"
    assert got[3].root_cause == got[4].root_cause == fixed.UNKNOWN_CAUSE


def test_semantic_map_defaults_to_minus_one(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "line_id long, event_template string")
    clusters = spark.createDataFrame([("a", 4), ("", 2)], "text string, label int")
    got = {r.line_id: r.semantic_cluster for r in diagnosis.map_semantic(df, clusters).collect()}
    assert got == {1: 4, 2: -1, 3: 2}
