"""A minimiser that many texts hold in different surroundings is split by whole windows."""

import random

import brute

from faultline.llm import substrings

FOOTER = "all rights reserved by the makers of this page and their heirs".split()
BUCKETS = 8


def footed(n=400):
    rnd = random.Random(9)
    own = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    texts = [" ".join(own(25) + FOOTER + own(25)) for _ in range(n)]
    # Windows that do repeat, over the footer too.
    again = [" ".join(own(9) + texts[i].split()[15:55] + own(9)) for i in range(0, n, 7)]
    return list(enumerate(texts + again + texts[:5] + ["", None, "few words"]))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def shares(docs, hot):
    """Windows that each bucket gets to hold."""
    packer, got = substrings.Packer(BUCKETS, hot), [0] * BUCKETS
    for doc_id, text in docs:
        packer.add(doc_id, 0, text or "")
    for packed, place in packer.held.items():
        got[place[3]] += packed.count(b" ") + 2 - substrings.WINDOW
    return got


def test_hot_minimisers_do_not_fill_one_bucket(spark, monkeypatch):
    docs = footed()
    assert substrings.hot_slots(frame(spark, docs)) == frozenset()
    monkeypatch.setattr(substrings, "HOT_WINDOWS", 500)
    hot = substrings.hot_slots(frame(spark, docs))
    assert hot
    whole, split = shares(docs, frozenset()), shares(docs, hot)
    mean = sum(split) / BUCKETS
    assert max(whole) > 1.5 * sum(whole) / BUCKETS
    assert max(split) < 1.3 * mean


def test_removal_stays_exact_when_minimisers_are_split(spark, monkeypatch):
    docs = footed()
    want = brute.removal_rows(docs)
    for bound in (500, 0):
        monkeypatch.setattr(substrings, "HOT_WINDOWS", bound)
        assert substrings.hot_slots(frame(spark, docs))
        found = substrings.removal(frame(spark, docs)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want
