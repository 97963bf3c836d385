"""Fingerprints, rules, classifier, pieces, preferences, removal and the join against plain versions."""

import itertools
import math
import random
import struct

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import (
    classifier, components, fingerprints, labels, preferences, quality_rules, set_join, statistics, substrings, unigram,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, node string, hash string, id string, component string, n_words string"
)


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *["x"] * 6) for d, t in rows], SCHEMA)


def corpus(seed=5, n=90):
    """Texts with copies, near copies, shared passages, repeated lines and odd cases."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(150)]
    texts = [None, "", "   ", "one", "One", "two words", "a b c d", "a b c d e", "x " * 900, "\n\n", "é ü \U0001f600 ß" * 30]
    for i in range(n):
        kind = i % 6
        own = [word() for _ in range(rnd.randint(3, 220))]
        if kind == 1:
            own = own[:40] + passage.split() + own[40:]
        elif kind == 2:
            own = list(base)
            for _ in range(rnd.randint(0, 9)):
                own[rnd.randrange(len(own))] = word()
        elif kind == 3:
            texts.append(rnd.choice(texts))
            continue
        elif kind == 4:
            own = own + own[:30] + own
        text, at = "", 0
        while at < len(own):
            step = rnd.randint(4, 30)
            text += " ".join(own[at : at + step]).capitalize() + rnd.choice([".\n", ". ", "\n", "! "])
            at += step
        texts.append(text)
    return list(enumerate(texts))


CORPUS = corpus()


def test_fingerprints(spark):
    want = brute.version_rows(CORPUS)
    found = fingerprints.compare_versions(table(spark, CORPUS)).collect()
    assert len(found) == len(CORPUS)
    text = dict(CORPUS)
    prints = {}
    for r in found:
        n, digest, edited, other = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert r["near_edited"] == pytest.approx(edited, abs=1e-12)
        assert r["near_next"] == pytest.approx(other, abs=1e-12)
        assert prints.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def test_peeling_finds_the_paragraphs_that_differ(spark):
    rows = spark.createDataFrame(
        [(1, [1, 2, 3], [2, 3, 4]), (2, list(range(300)), list(range(100, 420))), (3, [], [])],
        "row long, own array<long>, other array<long>",
    )
    prints = fingerprints.fingerprints(rows, ["own", "other"])
    first = fingerprints.attempt(prints, ["other"], [])
    found = {r["row"]: {(x["d"], x["s"]) for x in r["found"]} for r in fingerprints.differences(rows, first, ["other"]).collect()}
    assert found[1] == {(1, 1), (4, -1)}
    assert found[2] == {(d, 1) for d in range(100)} | {(d, -1) for d in range(300, 420)}
    assert found[3] == set()


def test_removal(spark):
    found = substrings.removal(table(spark, CORPUS)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute.removal_rows(CORPUS)


def test_removal_when_tasks_hold_little(spark, monkeypatch):
    packer = substrings.Packer(3)
    for doc_id, text in CORPUS:
        packer.add(doc_id, 0, text or "")
    first = packer.rows()
    for doc_id, text in CORPUS:
        packer.add(doc_id + 1000, 0, text or "")
    second = packer.rows()
    spans = {}
    for bucket in range(3):
        bodies = [
            body for rows in (second, first)
            for at, body in zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist())
            if body is not None and at == bucket
        ]
        for id, _, raw in substrings.repeats_in(bodies):
            spans.setdefault(id, []).append(raw)
    for rows in (first, second):
        for id, raw in zip(rows.column("id").to_pylist(), rows.column("spans").to_pylist()):
            if raw is not None:
                spans.setdefault(id, []).append(raw)
    want = brute.removal_rows(CORPUS + [(d + 1000, t) for d, t in CORPUS])
    for doc_id, text in CORPUS:
        for shift in (0, 1000):
            n, kept = substrings.kept_words(text, spans.get(doc_id + shift))
            assert (n, n - len(kept)) == want[doc_id + shift][:2]


def test_texts_without_repeats_stay(spark):
    rows = {r["doc_id"]: r for r in substrings.without_repeats(table(spark, CORPUS)).collect()}
    want = brute.removal_rows(CORPUS)
    for doc_id, text in CORPUS:
        n, gone, _ = want[doc_id]
        if not gone:
            assert rows[doc_id]["text"] == text
        elif gone == n:
            assert doc_id not in rows
        else:
            assert len(rows[doc_id]["text"].split()) == n - gone and rows[doc_id]["n_chars"] == len(rows[doc_id]["text"])


@pytest.mark.parametrize("light", [None, 0, 60])
def test_join(spark, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(set_join, "boundary", lambda sizes, length: light)
    found = set_join.join(table(spark, CORPUS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.component_rows(CORPUS)


def versions():
    """Sixty texts that differ from one in at most three words."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(60)] = f"x{rnd.random()}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_full_bitmap_of_wanted_documents_loses_none(spark, monkeypatch):
    monkeypatch.setattr(set_join, "WANTED_WORDS", 1)
    rows = versions() + [(100 + d, t) for d, t in CORPUS]
    rows += rows[:20]
    found = set_join.join(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.component_rows(rows[:-20])


@pytest.mark.parametrize("light", [0, 60])
@pytest.mark.parametrize("hot", [1, 7])
def test_long_lists_are_dealt_over_tasks(spark, monkeypatch, light, hot):
    monkeypatch.setattr(set_join, "HOT_LIST", hot)
    monkeypatch.setattr(set_join, "BLOCK", 5)
    monkeypatch.setattr(set_join, "boundary", lambda sizes, length: light)
    rows = versions() + [(100 + d, t) for d, t in CORPUS]
    sketch = set_join._sketch(set_join._summaries(table(spark, rows)).where("part is not null").withColumn("salt", F.lit(0)))
    salts = {r["salt"] for r in set_join._postings(table(spark, rows), sketch, light).select("salt").distinct().collect()}
    assert 0 in salts and len(salts) > 3
    found = set_join.join(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.component_rows(rows)


def test_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 3)
    rows = versions()
    found = set_join.join(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.component_rows(rows)


@pytest.mark.parametrize("pivots", [False, True])
def test_signatures_leave_out_no_link(pivots):
    rnd = np.random.default_rng(5)
    base = np.unique(rnd.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = []
    for n in (1, 2, 5, 60, 63, 64, 65, 128, 129, 250, 257, 290):
        for new in (0, 1, n // 10, n // 8, n // 2):
            fresh = rnd.integers(0, 1 << 63, new, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[: n - new], fresh])))
    sizes, parts = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    asked = np.arange(len(sets)) % 7 == 0 if pivots else np.ones(len(sets), bool)
    want = np.zeros(len(sets), bool)
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if set_join.linked(common, len(sets[i]), len(sets[j])) and parts[i] != parts[j] and (asked[i] or asked[j]):
            want[[i, j]] = True
    found = set_join.may_link(sizes, [set_join.signature(s) for s in sets], asked, parts)
    assert want.any() and (found >= want).all() and not found.all()


def test_texts_that_cannot_link_do_not_travel(spark, monkeypatch):
    """Texts that share a passage too short for a link, and two that link."""
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, shared + " " + " ".join(f"w{i}x{k}" for k in range(90))) for i in range(12)]
    rows += [(20, rows[0][1] + " end")]
    asked, texts = [], set_join._texts
    monkeypatch.setattr(set_join, "_texts", lambda docs, own, needed: (asked.append(needed.count()), texts(docs, own, needed))[1])
    monkeypatch.setattr(set_join, "boundary", lambda sizes, length: 0)
    found = set_join.join(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.component_rows(rows)
    assert sum(asked) == 2


def test_one_of_each(spark):
    rows = CORPUS + [(3, "one"), (None, "one"), (None, None)]
    kept = set_join.one_of_each(table(spark, rows)).collect()
    parts = brute.component_rows(CORPUS)
    want = {d for d, (_, c) in parts.items() if d == c}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (-5, 139)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: -5 for i in [-5, *range(100, 140)]}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def proto(number, kind, value):
    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else value)


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """A unigram vocabulary with byte fallback and random scores."""
    rnd = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    parts = {rnd.choice(["", unigram.MARK]) + "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 5))) for _ in range(900)}
    pieces += [(p, -rnd.uniform(2, 12), 1) for p in sorted(parts | {unigram.MARK, unigram.MARK * 2})]
    raw = b"".join(
        proto(1, 2, proto(1, 2, p.encode()) + proto(2, 5, struct.pack("<f", s)) + proto(3, 0, varint(t))) for p, s, t in pieces
    )
    trainer = [(3, 1), (4, len(pieces)), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1)]
    raw += proto(2, 2, b"".join(proto(n, 0, varint(v)) for n, v in trainer))
    raw += proto(3, 2, proto(1, 2, b"identity") + proto(3, 0, varint(1)) + proto(4, 0, varint(0)) + proto(5, 0, varint(1)))
    path = tmp_path_factory.mktemp("pieces") / "unigram.model"
    path.write_bytes(raw)
    return str(path)


def test_pieces_are_those_of_the_library(spark, unigram_file):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram_file)
    odd = ["", "a", " a", "  two  spaces ", "x\ty", f"\U0001f600 mark {unigram.MARK} here", "日本 a", "\n\n", "a\n b", "zzz"]
    texts = [t for _, t in CORPUS if t and len(t) < 400] + odd
    tool = unigram.segmenter(unigram_file)
    for text, ids in zip(texts, tool.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert tool.decode(ids) == text.replace(unigram.MARK, " ")


def test_piece_rows(spark, unigram_file):
    rows = {r["doc_id"]: r for r in unigram.encode_documents(table(spark, CORPUS), unigram_file).collect()}
    assert len(rows) == len(CORPUS)
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows.values())
    assert rows[0]["n_ids"] == rows[1]["n_ids"] == 0


def plain_counts(text):
    of_text = brute.words(text)
    windows = [tuple(of_text[i : i + 5]) for i in range(len(of_text) - 4)]
    twice = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(of_text), sum(map(len, of_text)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_counts(spark):
    extra = [(900, "# a | b <c> $1 & 5%"), (901, "l one\nl one\n \nl two\n \n"), (902, "a\x1cb a\x85c \xa0")]
    for doc_id, text in CORPUS + extra:
        if len(text or "") < 3000:
            assert statistics.counts(text)[:5] == plain_counts(text), doc_id


def labelled(spark, tmp_path, bad=150, good=600):
    rnd = random.Random(9)
    rows, marks = [], []
    for i in range(bad + good):
        own = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(15, 80))]
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "***" if junk else w for w in own)))
        marks.append((i, 0 if junk else 1, 0))
    marks += [(0, 1, 0), (None, 1, 0), (3, None, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_discriminant(spark, tmp_path):
    rows = labelled(spark, tmp_path) + [(5000, None), (5001, ""), (None, "a b")]
    found = classifier.score_documents(spark, table(spark, rows), str(tmp_path)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    right = [(r["score"] >= 0.7) == bool(r["doc_id"] % 5) for r in found if r["doc_id"] is not None and r["doc_id"] < 5000]
    assert np.mean(right) > 0.99
    kept = classifier.keep_good(spark, table(spark, rows), str(tmp_path))
    assert kept.columns == table(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["score"] >= 0.7}


def test_discriminant_ignores_the_held_out_quarter(spark, tmp_path):
    rows = labelled(spark, tmp_path)
    counted = statistics.with_counts(table(spark, rows), ["doc_id"])
    model = classifier.fit_on_labels(spark, str(tmp_path), counted)
    left = labels.quality_labels(spark, str(tmp_path)).where(~labels.held_out())
    left.withColumn("toxic", left["quality"]).write.parquet(f"{tmp_path}/other/labels.parquet")
    again = classifier.fit_on_labels(spark, f"{tmp_path}/other", counted)
    assert np.allclose(model.means, again.means) and model.odds == again.odds


def test_binomial_bound():
    plain = sum(math.comb(30, i) * 0.1**i * 0.9 ** (30 - i) for i in range(3))
    assert quality_rules.binomial_tail(2, 30, 0.1) == pytest.approx(plain)
    assert quality_rules.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    # Each stratum at its share of the error, and what a finished one hands on.
    assert quality_rules.certify({"a": [(0, 100), (4, 100)], "b": [(0, 60)], "c": [(9, 100)]}) == {"a": 0}
    assert quality_rules.certify({"a": [(0, 100), (0, 100)], "b": [(0, 60)]}) == {"a": 1, "b": 0}
    assert "c" not in quality_rules.certify({"a": [(0, 100)], "c": [(9, 100)]})
    assert quality_rules.certify({"a": [(0, 20)]}) == {}


def test_rules(spark, tmp_path):
    rows = labelled(spark, tmp_path)
    found = quality_rules.judge(spark, table(spark, rows + [(None, None)]), str(tmp_path)).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 5) for r in found if r["doc_id"] is not None)
    assert [r["kept"] for r in found if r["doc_id"] is None] == [False]


def test_turns_without_an_id_are_conversations_of_one_turn(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d")]
    turns += [(None, i, "assistant", f"n{i}") for i in range(30)]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    pairs = preferences.with_foreign_replies(preferences.conversations_of(rows)).collect()
    named = {r["conv_id"]: (r["chosen"][-1]["text"], r["rejected"][-1]["text"]) for r in pairs if r["conv_id"]}
    assert named == {1: ("b", "d"), 2: ("d", "b")}
    single = [r for r in pairs if r["conv_id"] is None]
    assert sorted(r["chosen"][0]["text"] for r in single) == sorted(f"n{i}" for i in range(30))
    assert all(r["chosen"] == r["rejected"] and len(r["chosen"]) == 1 for r in single)


def test_preferences(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (2, 0, "user", "u"), (2, 1, "assistant", "v"),
             (3, 0, "user", None), (3, 0, None, "t"), (None, 1, "assistant", "z")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preferences.with_foreign_replies(preferences.conversations_of(rows))
    found = {r["conv_id"]: r for r in preferences.format_preferences(pairs).collect()}
    assert len(found) == 4
    one = found[1]
    assert (one["n_common"], one["prompt"]) == (2, "<|system|>\ns\n<|user|>\nq\n")
    assert one["chosen"] == "<|assistant|>\nr\n" and one["rejected"] in {"<|assistant|>\nv\n", "<|assistant|>\nz\n", "<|assistant|>\nr\n"} or one["n_common"] == 3
    assert [tuple(m) for m in one["chosen_mask"]] == [(14, False), (2, True)]
    assert found[3]["chosen"] == found[3]["rejected"] == ""


def test_empty_tables(spark, tmp_path, unigram_file):
    labelled(spark, tmp_path, 5, 5)
    none = table(spark, CORPUS).where("false")
    assert fingerprints.compare_versions(none).count() == 0
    assert substrings.removal(none).count() == substrings.without_repeats(none).count() == 0
    assert set_join.join(none).count() == set_join.one_of_each(none).count() == 0
    assert unigram.encode_documents(none, unigram_file).count() == 0
    assert classifier.score_documents(spark, none, str(tmp_path)).count() == 0
    assert quality_rules.judge(spark, none, str(tmp_path)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.format_preferences(preferences.with_foreign_replies(preferences.conversations_of(turns))).count() == 0


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (None, long), (2, long), (None, None), (1, None)]
    removed = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.removal(table(spark, rows)).collect())
    assert removed == [(-1, 0), (-1, 0), (1, 0), (1, 40), (1, 40), (2, 40)]
    assert fingerprints.compare_versions(table(spark, rows)).count() == 6
    joined = set_join.join(table(spark, rows)).collect()
    assert sorted(str(r["component_id"]) for r in joined) == ["1", "1", "1", "1", "1", "None"]
