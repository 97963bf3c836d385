"""Personal data: base spans against the plain patterns, EM on simulated votes, held-out spans."""

import hashlib
import random
import re

import numpy as np
import pytest
from test_documents import corpus, table

from faultline.llm import private_data as pd, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def card(rnd, size=16):
    body = "".join(rnd.choice("0123456789") for _ in range(size - 1))
    return next(body + c for c in "0123456789" if checksum(body + c))


def mixed(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        yield "".join(rnd.choice([
            "@", ".", "+", "-", " ", "1", "0", "255", "300", "a", "b.c", "x@y.z", "(", ")", "é", "\n", "+1 (555) 123-4567",
            card(rnd), "4111 1111 1111 1111", "10.0.0.1", "000.1.2.3", "%", "q_", "\U0001f600", ":", "12:30",
        ]) for _ in range(rnd.randint(1, 30)))


ODD = [
    "a@b.c@d.e x@y", "a@b@c.d", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1", "0000000001.1.1.1", "+1-(", "+12345678",
    "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4111-1111-1111-1111", "4111  1111 1111 1111", "x" * 70 + "@" + "y" * 100 + ".de",
    "." * 300 + "@a.b", "1" * 3000, "1." * 3000, "a@" * 2000, "+1 " + "(" * 3000, "", " ", "١٢٣.1.1.1", "a.b+c%d@e-f.g-h.i",
]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    for text in [*mixed(seed, 700), *ODD]:
        assert sorted(pd.base_spans(text)) == sorted(plain(text)), text
        assert pd.candidates(text) is not None


def test_long_texts_are_quick():
    for text in ["a@" * 200_000, "1" * 300_000, "1." * 200_000, "+1 " + "(" * 200_000, "a" * 300_000 + "@", "1 " * 100_000, "dot at " * 50_000, ":a" * 100_000]:
        pd.candidates(text)


def test_reliabilities_of_simulated_labelers():
    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.3
    accuracy, says = np.array([0.95, 0.8, 0.7, 0.9, 0.6]), np.array([0.9, 0.6, 0.8, 0.5, 0.7])
    right = rnd.random((20_000, 5)) < accuracy
    votes = np.where(rnd.random((20_000, 5)) < says, np.where(right == truth[:, None], pd.YES, pd.NO), 0)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    found, share, posterior = pd.reliabilities(patterns, n.astype(float), np.zeros(len(n), int), (0.8,) * 5)
    # The prior pulls each a third of the way to 0.8.
    assert np.abs(found - (2 * accuracy + 0.8) / 3).max() < 0.05 and abs(share[0] - 0.3) < 0.05
    at = {tuple(p): q for p, q in zip(patterns, posterior)}
    guess = np.array([at[tuple(v)] > 0.5 for v in votes])
    majority = (votes == pd.YES).sum(axis=1) > (votes == pd.NO).sum(axis=1)
    assert (guess == truth).mean() > (majority == truth).mean() + 0.02


def held_out(seed, n):
    """(text, spans wanted beyond the base ones); decoys have none."""
    rnd = random.Random(seed)
    words = lambda k: " ".join(rnd.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(k))
    part = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    wrong = lambda: next(x for x in iter(lambda: part(16), None) if not checksum(x))
    out = []
    for i in range(n):
        one, other = card(rnd), card(rnd)
        hidden, prefix = [
            (f"jane.doe{i}[at]mail.example[dot]com", "contact "), (f"{one[:4]}.{one[4:8]}.{one[8:12]}.{one[12:]}", "credit card "),
            (f"({part(3)}) {part(3)}-{part(4)}", "call "), (f"2001:db8::{i + 1:x}", "server "), (f"{one} {other}", ""),
            (f"+1 ({part(3)}) {part(3)}-{part(4)}", ""),
        ][i % 6]
        spans = [one, other] if i % 6 == 4 else [hidden]
        tail = f"{part(16)} " if i % 6 == 5 else ""
        before = f"{words(5)} {prefix}"
        text = f"{before}{hidden} {tail}{words(4)}"
        out.append((text, [(len(before) + hidden.index(s), len(before) + hidden.index(s) + len(s)) for s in spans]))
        decoy = [f"order {wrong()}", f"version 1.2.3.{300 + i}", f"on 2024-01-{i % 28 + 1:02d} at noon", "at 12:30:45 we met", f"look at it dot by dot {i}", f"pi is 3.14159265358{i}"][i % 6]
        out.append((f"{words(5)} {decoy} {words(3)}", []))
    return out


def test_spans_beyond_the_base(spark):
    train, test = held_out(1, 60), held_out(2, 90)
    known = [(i, f"{t} base{i}@mail.example.com 10.1.{i % 200}.7 +1 (555) 010-{1000 + i} {card(random.Random(i))}") for i, (t, _) in enumerate(train)]
    model = pd.fit(table(spark, known))
    hit = wanted = false = 0
    for text, want in test:
        got = {(s, e) for _, s, e, base, _ in pd.judge(text, model) if not base}
        hit += len(got & set(want))
        wanted += len(want)
        false += len(got - set(want))
    assert hit / wanted >= 0.9 and false <= 0.02 * len(test), (hit, wanted, false)


def test_query(spark, tmp_path):
    rows = [*corpus(6, 20), *enumerate([*mixed(9, 150), *ODD], 1000), (None, "me@home.org"), (1000, None), (1000, None)]
    table(spark, rows).drop("source").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_weak_labels(spark, str(tmp_path)).collect()
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    want = sorted(
        (d is not None, d or 0, *[sum(k == kind for k, _, _ in plain(t or "")) for kind in PLAIN],
         hashlib.sha256(joined(plain(t or "")).encode()).hexdigest()) for d, t in rows
    )
    assert sorted((r[0] is not None, r[0] or 0, *r[1:6]) for r in got) == want
    for r in got:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (list(PLAIN).index(x[0]), x[1]))


def test_empty_table(spark):
    docs = table(spark, [])
    assert pd.find(docs, pd.fit(docs)).collect() == []
