"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Base patterns (email, ip, card, phone) always count. Looser patterns find further candidates:
written-out addresses, numbers with other separators, card numbers inside longer runs of
digits, phone numbers without a plus, IPv6. Five labelers of each kind (a pattern or
checksum, a gazetteer, the words before, the shape, the surroundings) vote yes, no or
nothing on every candidate, base ones included. Expectation-maximisation over the counts of
all vote patterns estimates how often each labeler is right; its posteriors then train a
logistic span classifier, which also sees features no labeler votes on. Candidates that the
classifier accepts join the base spans.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.shared import slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape", "surroundings")
YES, NO = 1, 2
# What a labeler is taken to be right in before any vote is seen.
BELIEF = {
    "email": (0.98, 0.9, 0.8, 0.85, 0.8), "ip": (0.9, 0.8, 0.85, 0.8, 0.9),
    "card": (0.97, 0.8, 0.85, 0.8, 0.95), "phone": (0.95, 0.8, 0.9, 0.85, 0.9),
}
FEATURES = ("colon before", "alone in its line", "beside a base span of its kind", "one kind of separator")
ACCEPT = 0.9
BEFORE = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WRITTEN = re.compile(
    r"(?<![\w.%+-])([\w.%+-]{1,64}) ?(@|[\[({<] ?(?:at|AT) ?[\])}>]| (?:at|AT) ) ?"
    r"([A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?(?:dot|DOT) ?[\])}>]| (?:dot|DOT) ) ?[A-Za-z0-9-]{1,63}){1,6})"
)
_DOT = re.compile(r" ?(?:\.|[\[({<] ?(?:dot|DOT) ?[\])}>]| (?:dot|DOT) ) ?")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_RUN = re.compile(r"\(?[0-9](?:[\x20().\-/_ ]{0,2}[0-9])++")
_GROUP = re.compile("[0-9]+")
_NATIONAL = re.compile(
    r"(?<![0-9])(?:\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|0{1,2}[1-9][0-9]{0,4}(?:[ ./-][0-9]{2,8}){1,5}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})(?![0-9])"
)
_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}")
_NORTH = re.compile(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_WORDS = re.compile(r"[^\W\d_]+|§")

# Gazetteers and context words of four languages.
DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it uk eu ch at nl be pt pl us ca mx ar br au jp cn in ru".split())
DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
        "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
ISSUERS = ((("4",), (13, 16, 19)), (("51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27"), (16,)),
           (("34", "37"), (15,)), (("6011", "65", "64"), (16, 19)), (("36", "38", "30"), (14,)), (("35",), (16,)))
CARD_SHAPES = frozenset([(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 6, 4), (13,), (14,), (15,), (16,), (17,), (18,), (19,)])
SAID = {
    "email": ("email mail mails contact write courriel correo adresse address kontakt schreiben".split(), "password token twitter handle user".split()),
    "ip": ("ip ipv host server address addr client node gateway ping dns from".split(), "version ver v release section chapter build kapitel abschnitt §".split()),
    "card": ("card visa mastercard amex credit debit karte kreditkarte carte tarjeta pan payment".split(), "order invoice isbn serial id number hash token ref tracking".split()),
    "phone": ("phone tel telephone telefon telefono teléfono téléphone call fax mobile mobil cell handy ring dial whatsapp".split(), "order invoice isbn serial id hash token ref date page seite".split()),
}
SAID = {k: (frozenset(a), frozenset(b)) for k, (a, b) in SAID.items()}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, non-overlapping for each kind, failing matches dropped."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = _local_start(text, at, end)
            if start < at:
                end = domain.end()
                found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _local_start(text: str, at: int, after: int) -> int:
    """Where the local part before the sign at ``at`` begins, not before ``after``."""
    start, step = at, 64
    while start > after:
        low = max(after, start - step)
        part = _LOCAL.search(text, low, start)
        if part.start() > low:
            return part.start()
        start, step = low, 2 * step
    return start


def _base_votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """Votes of the pattern, the gazetteer and the shape on a span; 0 where a labeler has nothing to say."""
    span = text[start:end]
    if kind == "email":
        written = _WRITTEN.fullmatch(span)
        sign, domain = ("@", span.rpartition("@")[2]) if "@" in span else (written[2], written[3])
        last = re.split(_DOT, domain)[-1].lower()
        pattern = YES if _DOMAIN.fullmatch(span, span.find("@")) and "@" in span else 0
        gazetteer = YES if last in DOMAINS else NO if not last.isalpha() or len(last) < 2 else 0
        shape = 0 if "@" in sign else YES if sign.strip()[0] in "[({<" else NO if "." in domain or last not in DOMAINS else 0
        return [pattern, gazetteer, shape]
    if kind == "ip":
        parts = span.split(".")
        if ":" in span:
            try:
                ipaddress.ip_address(span)
            except ValueError:
                return [NO, 0, 0]
            return [YES, YES if span[:4].lower() in ("2001", "fe80", "2a00", "2606") else 0, YES if len(span) > 12 else 0]
        valid = all(len(p) <= 12 and int(p) <= 255 for p in parts)
        known = span.startswith(("10.", "192.168.", "127.", "172.16."))
        padded = any(len(p) > 1 and p[0] == "0" for p in parts)
        shape = NO if all(len(p) == 1 for p in parts) else YES if sum(map(len, parts)) >= 8 and not padded else 0
        return [YES if valid else NO, YES if known else NO if parts[0].strip("0") == "" or padded else 0, shape]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        groups = tuple(len(g) for g in _GROUP.findall(span))
        issued = any(digits.startswith(first) and len(digits) in sizes for first, sizes in ISSUERS)
        valid = 13 <= len(digits) <= 19 and luhn(digits)
        return [YES if valid else NO, YES if issued else 0, 0 if len(groups) == 1 else YES if groups in CARD_SHAPES else NO]
    dialled = digits[2:] if span[0] != "+" and digits[:2] == "00" else digits if span[0] == "+" else ""
    shape = NO if _DATE.fullmatch(span) else YES if _NORTH.fullmatch(span) else 0
    return [
        YES if span[0] == "+" and 9 <= len(digits) <= 15 else NO if not 7 <= len(digits) <= 15 else 0,
        YES if dialled.startswith(DIAL) else NO if dialled[:1] == "0" else 0, shape,
    ]


def _around(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """Votes of the words before the span and of the characters around it."""
    words = {w.lower() for w in _WORDS.findall(text, max(0, start - BEFORE), start)}
    for_it, against = SAID[kind]
    yes, no = not words.isdisjoint(for_it), not words.isdisjoint(against)
    left, right, after = text[start - 1 : start], text[end : end + 1], text[end + 1 : end + 2]
    joined = left.isalnum() or right.isalnum() or left in ("_", "#", "$") or (right == "." and after.isdigit()) or (left == "." and kind != "email")
    return (YES if yes and not no else NO if no and not yes else 0), (NO if joined else 0)


def _loose(text: str, lower_dot: bool) -> Iterator[tuple[str, int, int]]:
    """Spans of the looser patterns, with those of the base patterns among them."""
    if "@" in text or lower_dot:
        for m in _WRITTEN.finditer(text):
            yield "email", *m.span()
    for m in _IP.finditer(text):
        yield "ip", *m.span()
    if "::" in text or re.search(":[0-9A-Fa-f]{1,4}:", text):
        for m in _IP6.finditer(text):
            if m.end() - m.start() >= 6:
                yield "ip", *m.span()
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span()
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
        sizes = [e - s for s, e in groups]
        for i in range(len(groups)):
            # The shapes have at most five groups.
            for j in range(i + 1, min(i + 5, len(groups)) + 1):
                if tuple(sizes[i:j]) in CARD_SHAPES:
                    yield "card", groups[i][0], groups[j - 1][1]
        for m in _NATIONAL.finditer(text, *run.span()):
            if 7 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span()


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, base, votes, features) of every candidate of a whole text, base spans first."""
    base = base_spans(text)
    has_digit = re.search("[0-9]", text)
    dotted = "dot" in text or "DOT" in text
    if not base and not has_digit and not dotted and "::" not in text and "@" not in text:
        return []
    kinds = {k for k, _, _ in base}
    # Looser spans that touch a base span of any kind add nothing.
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach, ends = 0, []
    for _, e in taken:
        reach = max(reach, e)
        ends.append(reach)

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i == 0 or ends[i - 1] <= start

    out = []
    every = [(k, s, e, True) for k, s, e in base]
    every += [(k, s, e, False) for k, s, e in dict.fromkeys(_loose(text, dotted)) if free(s, e)]
    for kind, start, end, is_base in every:
        pattern, gazetteer, shape = _base_votes(kind, text, start, end)
        context, surroundings = _around(kind, text, start, end)
        before, behind = text[max(0, start - 2) : start], text[end : end + 1]
        separators = {c for c in text[start:end] if not c.isalnum()}
        features = (
            int(":" in before or "=" in before), int(before[-1:] in ("", "\n") and behind in ("", "\n")),
            int(kind in kinds and not is_base), int(len(separators) <= 1),
        )
        out.append((kind, start, end, is_base, (pattern, gazetteer, context, shape, surroundings), features))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, bool, str, str]] = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            for kind, _, _, base, votes, features in candidates(text or ""):
                held[kind, base, "".join(map(str, votes)), "".join(map(str, features))] += 1
    if held:
        columns = list(zip(*held))
        yield pa.record_batch([*map(pa.array, columns), pa.array(list(held.values()))], names=["kind", "base", "votes", "features", "n"])


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, base, votes, features, n: how often each pattern of votes and features stands in all texts.

    At most 4 * 2 * 3**5 * 2**4 rows, as many as there are patterns.
    """
    partial = docs.select("text").mapInArrow(_counted, "kind string, base boolean, votes string, features string, n long")
    return partial.groupBy("kind", "base", "votes", "features").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Reliabilities of the labelers and weights of the classifier, by kind."""

    reliability: dict[str, tuple[float, ...]]
    share: dict[str, tuple[float, ...]]
    weights: dict[str, tuple[float, ...]]

    def score(self, kind: str, base: bool, votes: tuple[int, ...], features: tuple[int, ...]) -> float:
        z = float(_row(base, votes, features) @ np.array(self.weights[kind]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _row(base, votes, features) -> np.ndarray:
    """A constant, whether it is a base span, each labeler's yes and no, and the features."""
    said = [*[v == YES for v in votes], *[v == NO for v in votes]]
    return np.array([True, base, *said, *features], float)


def reliabilities(
    votes: np.ndarray, n: np.ndarray, base: np.ndarray, belief: tuple[float, ...], rounds: int = 200
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how often each labeler is right, share of true looser and base spans, posterior of each pattern) by EM.

    ``votes`` has a row for each pattern, ``n`` its count, ``base`` 1 where it is of base spans,
    whose share of true ones is a number of its own. The prior belief weighs as much as
    half of a labeler's votes and ten more, so that it counts alike at every size; it decides
    where labelers never meet. No labeler is taken to be worse than chance.
    """
    right, share = np.array(belief), np.array([0.5, 0.5])
    belief = np.array(belief)
    yes, no = votes == YES, votes == NO
    voted = n @ (yes | no)
    prior = 0.5 * voted + 10
    for _ in range(rounds):
        gain = np.log(right / (1 - right))
        odds = np.log(share / (1 - share))[base] + (yes.astype(float) - no) @ gain
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        correct = n @ (yes * posterior[:, None] + no * (1 - posterior)[:, None])
        now = np.clip((correct + prior * belief) / (voted + prior), 0.55, 0.999)
        both = [np.bincount(base, weights, minlength=2) for weights in (n * posterior, n)]
        share_now = (both[0] + 5) / (both[1] + 10)
        if np.abs(now - right).max() < 1e-9 and np.abs(share_now - share).max() < 1e-9:
            break
        right, share = now, share_now
    return right, share, posterior


def _logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on grouped rows with target shares, by Newton's method."""
    n = n / n.sum()
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (p - target)) + penalty * weights
        curve = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        weights -= step
        if np.abs(step).max() < 1e-10:
            break
    return weights


def fit(docs: DataFrame) -> Model:
    """Reliabilities and classifier from the candidates of all texts; only pattern counts come to the driver.

    A kind without any candidate keeps the prior beliefs. Every kind's patterns are joined by
    one imagined candidate for each single vote, so that the classifier knows each labeler.
    """
    rows = vote_counts(docs).collect()
    reliability, share, weights = {}, {}, {}
    for kind in KINDS:
        mine = sorted((r.votes, r.features, int(r.base), r.n) for r in rows if r.kind == kind)
        single = ["".join(str(v) if i == j else "0" for i in range(len(LABELERS))) for j in range(len(LABELERS)) for v in (YES, NO)]
        mine += [(v, "0" * len(FEATURES), 0, 1) for v in single]
        votes = np.array([[int(c) for c in v] for v, _, _, _ in mine])
        base, n = np.array([b for _, _, b, _ in mine]), np.array([float(c) for _, _, _, c in mine])
        right, part, posterior = reliabilities(votes, n, base, BELIEF[kind])
        x = np.stack([_row(b, v, [int(c) for c in f]) for v, (_, f, b, _) in zip(votes, mine)])
        reliability[kind], share[kind] = tuple(right.tolist()), tuple(part.tolist())
        weights[kind] = tuple(_logistic(x, posterior, n).tolist())
    return Model(reliability, share, weights)


def judge(text: str, model: Model, accept: float = ACCEPT) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of the final spans by kind and start.

    A looser span is accepted if its score is at least ``accept`` and some labeler votes for it.
    Accepted spans do not overlap: the better score wins, then the longer, then the first.
    """
    found, more = [], []
    for kind, start, end, base, votes, features in candidates(text):
        score = model.score(kind, base, votes, features)
        if base:
            found.append((kind, start, end, True, score))
        elif score >= accept and YES in votes:
            more.append((kind, start, end, False, score))
    kept: list = []
    # Looser spans lie within short stretches of text: only those that overlap are compared.
    stretch: list = []
    for span in [*sorted(more, key=lambda c: (c[1], c[2])), None]:
        if stretch and (span is None or span[1] >= max(c[2] for c in stretch)):
            chosen: list = []
            for c in sorted(stretch, key=lambda c: (-c[4], c[1] - c[2], c[1], KINDS.index(c[0]))):
                if all(c[2] <= o[1] or c[1] >= o[2] for o in chosen):
                    chosen.append(c)
            kept += chosen
            stretch = []
        stretch.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found + kept, key=lambda c: (order[c[0]], c[1], c[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _found(batches: Iterator[pa.RecordBatch], model: Model, accept: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64()),
    ]))
    names = ("kind", "start", "end", "base", "score")
    for batch in slices(batches):
        spans = [[dict(zip(names, s)) for s in judge(t or "", model, accept)] for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])


def find(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base, score) of every row.

    Null texts are empty and have no spans; null ids stay null, repeated rows give a row each
    and other columns are ignored. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(lambda b: _found(b, model, accept), f"doc_id long, spans {SPANS}")


def as_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans and all spans as text."""
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda s: s["base"]), [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
