"""Sharding, mixing and token files against plain versions."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest

from faultline.llm import mixing, sharding, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, row string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, None, s, None, "x", "y", "z") for d, t, s in rows], SCHEMA)


ODD = [
    (0, None, None), (1, "", "b"), (2, "one", "a"), (3, "one", "a"), (4, "two words", None),
    (5, "x " * 4000, "b"), (6, "unïcode   odd\xa0blank", "é"), (7, "  lead and trail  ", "Z"),
    (8, "tab\tand\n\n\nlines\n", "a"), (9, "I'm he'll\n it's", "a"), (10, "a\x00b \U0001f600", "c"),
    (11, "\nfirst line", "c"), (12, "<|endoftext|> stays", "c"), (13, "in<|endoftext|>side a text", "c"), (14, "<|endoftext|", "c"),
]
MANY = [(i, " ".join(f"w{i * j % 97}" for j in range(i % 23)), f"s{i * i % 5}") for i in range(300)]


@pytest.mark.parametrize("rows", [ODD, MANY, ODD[:1]], ids=["odd", "many", "one"])
def test_mix(spark, rows):
    taken, target = brute.mix_rows(rows)
    found = {r["doc_id"]: r for r in mixing.mix(table(spark, rows)).collect()}
    assert {d: r["taken"] for d, r in found.items()} == taken
    for d, _, source in rows:
        assert found[d]["target"] == pytest.approx(target[source], rel=1e-12)
        assert found[d]["taken"] <= 3 * found[d]["size"]


def test_mix_of_a_dominant_source(spark):
    rows = [(i, "word " * 5, "big" if i % 3 else f"small{i % 4}") for i in range(600)]
    source = {d: s for d, _, s in rows}
    taken, target = {}, {}
    for r in mixing.mix(table(spark, rows)).collect():
        name = source[r["doc_id"]]
        taken[name], target[name] = taken.get(name, 0) + r["taken"], r["target"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)


def test_mix_keeps_repeated_rows_apart(spark):
    assert mixing.mix(table(spark, [(1, "a b", "s")] * 3 + [(None, "c", "s")] * 2)).count() == 5


@pytest.mark.parametrize("rows", [ODD, MANY, ODD[:1]], ids=["odd", "many", "one"])
def test_shards(spark, rows):
    want = brute.shards_of([r[:2] for r in rows])
    found = sharding.shard_documents(table(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {d: (t or "").encode() for d, t, _ in rows}
    for r in found:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["shard"] == want[hashlib.sha256(raw).hexdigest()]
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_with_a_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "s") for i in range(400)]
    found = sharding.shard_documents(table(spark, rows)).collect()
    want = brute.shards_of([r[:2] for r in rows])
    assert len({r["shard"] for r in found if r["doc_id"] % 3 == 0}) == 1
    sizes = lambda of: sorted(of.values())
    got = {}
    for r in found:
        got[r["shard"]] = got.get(r["shard"], 0) + r["size"]
    plain = {}
    for d, t, _ in rows:
        shard = want[hashlib.sha256(t.encode()).hexdigest()]
        plain[shard] = plain.get(shard, 0) + len(t) + 1
    assert sizes(got) == sizes(plain)


@pytest.mark.parametrize("rows", [ODD, MANY], ids=["odd", "many"])
def test_token_files(spark, tmp_path, rows):
    index = token_files.write_tokens(table(spark, rows), VOCABULARY, f"file://{tmp_path}/t", sequence=16, batch=4)
    found = sorted(tuple(r) for r in token_files.read_tokens(index).collect())
    assert found == sorted(brute.token_rows([r[:2] for r in rows], VOCABULARY))


def test_sequences_are_mapped_without_a_copy(spark, tmp_path):
    index = token_files.write_tokens(table(spark, MANY), VOCABULARY, f"file://{tmp_path}/t", sequence=16, batch=4)
    uri, end = index.groupBy("file").agg({"at": "max"}).orderBy("file").first()
    file = token_files.SequenceFile(uri)
    ids, mask = file.sequence_at(1)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    assert np.concatenate(list(file.span(16, 16))).tolist() == ids.tolist()
    file.close()


def test_empty_tables(spark, tmp_path):
    none = table(spark, ODD).where("false")
    assert mixing.mix(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    index = token_files.write_tokens(none, VOCABULARY, f"file://{tmp_path}/t")
    assert token_files.read_tokens(index).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, None, None)]
    index = token_files.write_tokens(table(spark, rows), VOCABULARY, f"file://{tmp_path}/t")
    assert [r["n_tokens"] for r in token_files.read_tokens(index).orderBy("start").collect()] == [1, 2, 3, 3]
    assert sharding.shard_documents(table(spark, rows)).count() == 4


def test_single_blanks_is_told_of_every_white_space():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert all(token_files.single_blanks(f"a{c}b") and not token_files.single_blanks(f"a{c} b") for c in spaces)
    for text in ["", " ", "\n", " a", "a ", "a\n", "\x1ca", "a  b", "a\n\nb", "a \nb", "a  b", "a b\t"]:
        assert not token_files.single_blanks(text)
    for text in ["a", "a b", "a\nb c\td", "​", "\U0001f600 é　ß"]:
        assert token_files.single_blanks(text)
