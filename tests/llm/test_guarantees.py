"""What the operators promise: the error of certified cutoffs, and stages that leave every other column alone."""

import numpy as np
import pytest
from test_documents import CORPUS

from faultline.llm import mixing, quality_rules, set_join, substrings
from faultline.llm.shared import free_names


@pytest.mark.parametrize("strata", [2, 4])
def test_false_certificates(strata):
    """Strata whose loosest variant is harmless and whose next is at the limit, and one at the limit at once."""
    rnd, runs, n, limit = np.random.default_rng(strata), 4000, 2000, 0.05
    false = 0
    for _ in range(runs):
        loose, at_limit = rnd.binomial(n, 0.01, strata), rnd.binomial(n, limit, strata)
        tested = {f"s{i}": [(int(loose[i]), n), (int(max(loose[i], at_limit[i])), n)] for i in range(1, strata)}
        tested["s0"] = [(int(at_limit[0]), n)]
        found = quality_rules.certify(tested, limit, 0.05)
        false += "s0" in found or any(found.get(f"s{i}", 0) > 0 for i in range(1, strata))
    # Three standard deviations above the promised 5 %.
    assert false / runs <= 0.05 + 3 * (0.05 * 0.95 / runs) ** 0.5


def test_share_is_handed_on_once():
    one = {"a": [(0, 100)] * 2, "b": [(0, 60)], "c": [(0, 45)]}
    assert quality_rules.certify(one) == {"a": 1}
    assert quality_rules.certify(one | {"b": [(0, 80)]}) == {"a": 1, "b": 0}
    assert quality_rules.certify({"a": []}) == {} == quality_rules.certify({})


ODD = ["_hash", "_id", "_digest", "_spans", "_times", "_d", "_h", "_alone", "_one", "_copy", "_other", "_Least", "__hash", "component", "_first"]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_a int, __A int")
    assert free_names(df, "_a", "b", "b") == ["___a", "b", "_b"]


def test_stages_keep_columns_of_any_name(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), *[f"{c}{i}" for c in ODD]) for i, (d, t) in enumerate([*CORPUS, (None, "a b c")])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    docs = spark.createDataFrame(rows, schema)
    given = {tuple(r) for r in docs.collect()}
    for stage in (set_join.one_of_each, mixing.repeated_rows):
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert found and {tuple(r) for r in found} <= given
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns
    others = {r[5:] for r in given}
    assert all(tuple(r)[5:] in others for r in got.collect())
    for stage in (set_join.one_of_each, mixing.repeated_rows, substrings.without_repeats):
        assert stage(docs.where("false")).collect() == []
