"""Token links of two tokenizers against a plain version that walks over byte ranges."""

import hashlib
import os
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from test_documents import corpus, table
from tokenizers import Tokenizer

from faultline.llm import alignment, queries, token_files

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """doc_id, position -> the contract's columns, by ranges of bytes."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    rest = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}

    def cut(raws):
        out, at = [], 0
        for r in raws:
            out.append((at, at + len(r)))
            at += len(r)
        return out

    found = []
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [
            bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()
            for p in map(b.id_to_piece, ids_b)
        ]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        at_a, at_b = cut(raw_a), cut(raw_b)
        links = [
            (x, y) for x, (s, e) in zip(ids_a, at_a) for y, (t, f) in zip(ids_b, at_b) if s < f and t < e
        ] if len(at_a) * len(at_b) < 4_000_000 else None
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(
                ",".join(str(i) for i, (s, e) in zip(ids, at) if before <= s and e <= end)
                for ids, at in ((ids_a, at_a), (ids_b, at_b))
            ))
            before = end
        found.append((doc_id, len(ids_a), len(ids_b), len(ends), links, ";".join(groups)))
    docs = Counter(p for row in found for p in set(row[4]))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (d, n_a, n_b, n_groups, len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, n_a, n_b, n_groups, links, groups in found
    ], docs, Counter(p for row in found for p in row[4])


ODD = [
    "<s> and <|endoftext|> </s>", " leading", "trailing ", "two  blanks", "\n\nlines\n\n \n x\t y\n", "a▁b", "▁",
    " ", "\t", " no break", " wide  space", "ﬁ Å Å é ́", "\U0001f600\U0001f600 ‍ x", "it's we'll I'M",
    "日本語のテキスト 日本", "x" * 300, "a,b.c!d ,e .f", "\x00\x01 \x1c\x1d x", "foo\u0085bar \u0085 baz", "1234567 89,000.5",
]


def rows_of():
    rnd = random.Random(3)
    texts = [t for _, t in corpus(7, 30)] + ODD + ["well known words of a language and more of them " * 3] * 4
    for _ in range(40):
        texts.append("".join(rnd.choice(["\n", " ", "  ", "word", "Ü", ",", "▁", ".", "the", "é", "\t"]) for _ in range(30)))
    return [*enumerate(texts), (None, "no id"), (3, "an id again")]


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def expected():
    return plain(rows_of())


@pytest.mark.parametrize("partitions", [1, 5])
def test_equal_to_plain_version(spark, expected, partitions):
    docs = table(spark, rows_of()).repartition(partitions)
    got = alignment.align(docs, *PATHS, size_b=32000)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected[0], key=key)
    counts = alignment.pair_counts(alignment.spread(docs, *PATHS), 32000)
    assert {(r.id_a, r.id_b): (r.docs, r.links) for r in counts.collect()} == {
        p: (n, expected[2][p]) for p, n in expected[1].items()
    }


def test_small_cache(expected, monkeypatch):
    """Units that come back after the cache was emptied are the same."""
    monkeypatch.setattr(alignment, "CACHED", 50)
    found = alignment.Aligner(*PATHS)
    for (_, text), want in zip(rows_of(), expected[0]):
        (units,) = found.number([text])
        groups = "" if units is None else ";".join(found.texts[u] for u in units)
        assert (hashlib.sha256(groups.encode()).hexdigest() if groups else "") == want[7]


@pytest.mark.parametrize("n", [1, 100, 300, 4096])
def test_planes(n):
    """Containers hold exactly the postings they were made of, as lists and as bitmaps."""
    rnd = np.random.default_rng(n)
    slots = np.sort(rnd.choice(alignment.BLOCK, n, replace=False))
    times = rnd.integers(1, 70, n)
    keys = np.concatenate([(5 << 12) | slots, [(9 << 12) | 7]])
    pair, docs, links, planes = alignment.containers(rnd.permutation(keys), np.ones(n + 1, np.int64))
    assert pair.tolist() == [5, 9] and docs.tolist() == [n, 1] and links.tolist() == [n, 1]
    pair, docs, links, planes = alignment.containers(keys, np.append(times, 64))
    assert docs.tolist() == [n, 1] and links.tolist() == [times.sum(), 64]
    batch = pa.record_batch(
        [pa.array([3, 3]), pa.array([10, 1]), pa.array([True, False]), planes], names=["block", "docs", "best", "planes"]
    )
    (out,) = alignment._scores(iter([batch]))
    want = np.zeros(alignment.BLOCK, np.int64)
    want[slots] = 10 * times
    want[7] += 64
    got = np.zeros(alignment.BLOCK, np.int64)
    got[out.column("slot").to_numpy()] = out.column("count_sum").to_numpy()
    assert (got == want).all()


def test_special_strings_and_blank_marks(spark):
    got = {r.doc_id: r for r in alignment.align(table(spark, list(enumerate(ODD))), *PATHS, 32000, texts=True).collect()}
    assert got[5].n_a == 0 and got[5].groups_sha256 == "" and got[5].groups == ""
    assert got[0].n_a > 5 and "50256" not in got[0].groups.replace("|", ",").replace(";", ",").split(",")


def test_empty_table(spark):
    assert alignment.align(table(spark, []), *PATHS, 32000).collect() == []


def test_query(spark, tmp_path):
    table(spark, rows_of()[:40]).drop("source").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_pair_bitmaps(spark, str(tmp_path))
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    ] and got.count() == 40


@pytest.mark.parametrize("kind", ["aligner", "encoder"])
def test_encoding_keeps_to_the_core_of_its_task(monkeypatch, kind):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    found = alignment.Aligner(*PATHS) if kind == "aligner" else token_files.Encoder(PATHS[0])
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(300)]
    own, every = time.thread_time(), time.process_time()
    found.number(texts) if kind == "aligner" else found.encode(texts)
    own, every = time.thread_time() - own, time.process_time() - every
    assert every < 1.2 * own + 0.05


@pytest.mark.parametrize("text", ["a b", "a  b", " a", "a ", "a\nb", "a\n\nb c", "a \nb", "a\tb c", "a\xa0b c", "x\0y z", "\x1cb c", "é　b c\nd"])
def test_units_by_words_are_those_of_the_pattern(text):
    found = alignment.Aligner(*PATHS)
    parts = alignment._SPLIT.split(text)
    assert found.split(text) == [" " + parts[0], *[p if p[:1] == "\n" else " " + p for p in parts[1:]]]


def test_units_whose_tokens_spell_other_bytes_have_none():
    """Among many good units those of other bytes, or as many other bytes, are still told apart."""
    found = alignment.Aligner(*PATHS)
    units, ids = [" a", " b", " c", " dd"], {}
    all_a = [e.ids for e in found.a.encode_batch_fast(units, add_special_tokens=False)]
    all_b = found.b.encode([u[1:] for u in units])
    assert found._same(units, all_a, all_b) == [0, 1, 2, 3]
    assert found._same(units, [all_a[1], *all_a[1:]], all_b) == [1, 2, 3]
    assert found._same(units, all_a, [*all_b[:3], all_b[0]]) == [0, 1, 2]
    assert found._same(units, [[], *all_a[1:]], all_b) == [1, 2, 3]


def test_texts_whose_units_are_all_known():
    found = alignment.Aligner(*PATHS)
    first, again = found.number(["a b c", None, ""]), found.number(["a b c", "c", None])
    assert first[0].tolist() == again[0].tolist() and first[1:] == [None, None] and again[2] is None
    assert found.number([None, ""]) == [None, None] and found.number([]) == []
