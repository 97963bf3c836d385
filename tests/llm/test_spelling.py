"""Spelling variants against a plain version that deletes, inserts and replaces."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_documents import corpus, table

from faultline.llm import queries, spelling


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], [ord(c) for c in x])) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def vocabulary(seed, n, letters="ab"):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 10))) for _ in range(n)}
    words |= {"a" * k for k in range(7, 12)} | {"\xe9" * 8, "\xe9" * 7 + "\xff", "zz" + "\xf7" * 6, "a" * 400, "a" * 401, "b" + "a" * 400}
    return {w: rnd.choice([1, 2, 3, 20, 21, 30, 300, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("seed, n, letters", [(1, 250, "ab"), (2, 200, "abc\xe9"), (3, 1, "a")])
def test_equal_to_plain_version(spark, partitions, seed, n, letters):
    counts = vocabulary(seed, n, letters)
    rows = spark.createDataFrame([(n, w, "x") for w, n in counts.items()], "n int, word string, id string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spelling.variants(rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(counts) and set(map(tuple, got)) == plain_variants(counts)


def test_words_of_texts(spark, tmp_path):
    rnd = random.Random(8)
    stems = ["surrounding", "Difficulty", "\xdcberpr\xfcfung", "caf\xe9teria", "separately", "q" * 5000]
    rows = corpus(4, 20) + [
        (i, " ".join(rnd.choice(stems) + rnd.choice([",", "", "1", "\xd7", "ā"]) for _ in range(60))) for i in range(100, 160)
    ]
    rows += [(None, "surrounding surroundings " * 4), (100, "Difficulty DIFFICULTY"), (100, "Difficulty DIFFICULTY")]
    docs = table(spark, rows)
    want = plain_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    docs.drop("source").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_trie_pairs(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == plain_variants(want)
    assert any(r[1] for r in got.collect())


def test_handing_on(spark, monkeypatch):
    """Counts handed on early add up."""
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 3)
    rows = corpus(4, 20)
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
    found = Counter()
    for part in spelling._counted(iter([batch]), 0, 1):
        for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
            found[word] += n
    want = Counter(re.findall("[a-z\xc0-\xff]+", " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows)))
    assert found == want


def test_empty_tables(spark):
    assert spelling.word_counts(table(spark, [])).collect() == []
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
