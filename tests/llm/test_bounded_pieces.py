"""The registered sketches compare bounded pieces: near versions without sentence ends stay alike."""

import random
import re

import brute
import pytest

from faultline.llm import fingerprints, queries

CHUNK = re.compile(r"\S{1,8}", re.ASCII)


def pieces(text):
    """Up to 12 words, or parts of 8 characters, of one line, to the end of a sentence."""
    out = set()
    for line in text.split("\n"):
        start, n = None, 0
        for m in CHUNK.finditer(line):
            start, n = (m.start(), 1) if start is None else (start, n + 1)
            if n == 12 or m.group()[-1] in ".!?。！？":
                out.add(line[start : m.end()])
                start = None
            end = m.end()
        if start is not None:
            out.add(line[start:end])
    return out


def texts():
    rnd = random.Random(3)
    some = lambda n: [f"{rnd.choice('bcdfg')}{rnd.randrange(10**4)}" for _ in range(n)]
    cjk = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    long = some(2500)
    return {
        "short": " ".join(some(55)), "long": " ".join(long), "code": ";".join(some(900)), "cjk": cjk(700),
        "table": "\n".join("|".join(some(6)) for _ in range(80)), "none": "", "blank": " \n\n ",
        "prose": ". ".join(" ".join(some(9)) for _ in range(60)) + ".",
    }


def run(spark, tmp_path, docs):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    return {r["doc_id"]: r for r in queries.op1_paragraph_sketches(spark, folder).collect()}


def test_near_versions_of_unpunctuated_texts_are_alike(spark, tmp_path):
    docs = texts()
    found = run(spark, tmp_path, list(docs.values()))
    for i, name in enumerate(docs):
        if docs[name].strip():
            assert found[i]["near_edited"] > 0.15, name
            assert found[i]["near_next"] == 0, name


def test_query_against_the_plain_pieces(spark, tmp_path, monkeypatch):
    docs = list(texts().values())
    monkeypatch.setattr(brute, "PARAGRAPH", type("Pieces", (), {"findall": staticmethod(pieces)}))
    want = brute.version_rows(list(enumerate(docs)))
    for i, row in run(spark, tmp_path, docs).items():
        assert (row["n_chars"], row["edited_sha256"]) == want[i][:2]
        assert (row["near_edited"], row["near_next"]) == pytest.approx(want[i][2:], abs=1e-12)


def test_one_changed_character_changes_one_piece():
    for text in texts().values():
        if len(text) > 200:
            found = re.findall(fingerprints.BOUNDED, text, re.ASCII)
            changed = re.findall(fingerprints.BOUNDED, text[:100] + ("x" if text[100] != "x" else "y") + text[101:], re.ASCII)
            if text[100] not in " \n|;.":
                assert len(set(found) - set(changed)) <= 1


def test_versions_that_the_larger_sketch_cannot_tell_are_sketched_again(spark, tmp_path, monkeypatch):
    docs = list(texts().values())
    want = run(spark, tmp_path / "a", docs)
    monkeypatch.setattr(fingerprints, "PEELS", 1)
    cells = fingerprints._all_cells(fingerprints.edited_rows(spark.read.parquet(f"{tmp_path}/a/in/documents.parquet")))
    assert fingerprints._compared(cells).where("not (by_edited.ok and by_next.ok)").count() > 0
    assert run(spark, tmp_path / "b", docs) == want


def test_sketches_are_summed_where_texts_met(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "TASK_BYTES", 1)
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    plan = fingerprints._compared(fingerprints._all_cells(fingerprints.edited_rows(rows)))
    # One shuffle of the texts; the other exchange is the broadcast of the block heads.
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text
