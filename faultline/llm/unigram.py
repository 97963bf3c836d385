"""Unigram segmentation into vocabulary pieces by Viterbi over a double-array trie.

A text is normalised as the vocabulary's library does: a marker for each space and one
before the text. The best sequence of pieces by summed log scores wins; a character
that no piece covers costs the least score less ten and falls back to its bytes. As no
piece goes on past the start of a marker or line break, texts fall into units that are
segmented alike wherever they stand: each distinct unit is segmented once, many
together in array steps.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.shared import slices

MARK = "▁"
UNKNOWN_COST = 10.0
CACHED = 600_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_IRREGULAR = re.compile(rf"\s\s|^\s|\s$|{MARK}")
_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)


@dataclass
class Vocabulary:
    """Pieces by id: log score, or None for ids that never stand for text; and the ids of the 256 bytes."""

    pieces: list[str]
    scores: list[float | None]
    byte_ids: list[int]


def load_vocabulary(path: str) -> Vocabulary:
    """A SentencePiece file with byte fallback.

    A unigram file's scores are log probabilities. A BPE file's are merge ranks, of
    which the log score is taken by Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    text = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
    raw = [model.get_score(i) for i in ids]
    ranks = all(s == int(s) for s, t in zip(raw, text) if t)
    scores = [(-math.log1p(abs(s)) if ranks else s) if t else None for s, t in zip(raw, text)]
    at = {p: i for i, p in enumerate(pieces)}
    return Vocabulary(pieces, scores, [at[f"<0x{b:02X}>"] for b in range(256)])


@dataclass
class Segmenter:
    """Double-array trie of a vocabulary: node t follows node s on byte b if t = base[s] + b + 1 and check[t] = s."""

    vocabulary: Vocabulary
    base: np.ndarray = field(init=False)
    check: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        words = sorted(
            (p.encode(), i) for i, (p, s) in enumerate(zip(self.vocabulary.pieces, self.vocabulary.scores))
            if s is not None and p
        )
        self._build(words)
        self.score = np.array([s if s is not None else 0.0 for s in self.vocabulary.scores])
        self.unknown = min((s for s in self.vocabulary.scores if s is not None), default=0.0) - UNKNOWN_COST
        self.bytes = np.array(self.vocabulary.byte_ids, np.int32)
        self.longest = max((len(w) for w, _ in words), default=0)
        inner = [p for p, s in zip(self.vocabulary.pieces, self.vocabulary.scores) if s is not None]
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in inner)
        text = [p.replace(MARK, " ").encode() for p in self.vocabulary.pieces]
        for b, i in enumerate(self.vocabulary.byte_ids):
            text[i] = bytes([b])
        self.text = text
        self.known: dict[str, bytes] = {}

    def _build(self, words: list[tuple[bytes, int]]) -> None:
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        free = dense = 257
        queue = [(0, 0, len(words), 0)]
        while queue:
            node, low, high, depth = queue.pop()
            if low < high and len(words[low][0]) == depth:
                value[node] = words[low][1]
                low += 1
            children, at = [], low
            while at < high:
                code, first = words[at][0][depth] + 1, at
                while at < high and words[at][0][depth] + 1 == code:
                    at += 1
                children.append((code, first, at))
            if not children:
                continue
            # An only child fills the first gap; more children look behind what is nearly full.
            while check[free] != -1:
                free += 1
            dense = max(dense, free)
            only, tried = len(children) == 1, 0
            start = (free if only else dense) - children[0][0]
            while True:
                while start + 260 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[start + code] == -1 for code, _, _ in children):
                    break
                start += 1
                tried += 1
            if tried > 64 and not only:
                dense = start + children[0][0]
            base[node] = start
            for code, first, last in children:
                check[start + code] = node
                queue.append((start + code, first, last, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def segment(self, units: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of each non-empty unit."""
        data = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
        length = np.array([len(u) for u in units])
        end = np.cumsum(length)
        begin = end - length
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        unit = np.searchsorted(end, starts, side="right")
        limit = end[unit]
        width = _WIDTH[data[starts]]
        covered = np.zeros(len(starts), bool)
        active, node = np.arange(len(starts)), np.zeros(len(starts), np.int32)
        froms, tos, ids = [], [], []
        for step in range(1, self.longest + 1):
            at = starts[active] + step - 1
            inside = at < limit[active]
            active, node, at = active[inside], node[inside], at[inside]
            follow = self.base[node] + data[at] + 1
            ok = self.check[follow] == node
            active, node = active[ok], follow[ok]
            if not len(active):
                break
            found = self.value[node]
            has = found >= 0
            froms.append(active[has])
            tos.append(starts[active[has]] + step)
            ids.append(found[has])
            covered[active[has & (width[active] == step)]] = True
        bare = np.flatnonzero(~covered)
        edge = np.concatenate([*froms, bare])
        to = np.concatenate([*tos, starts[bare] + width[bare]])
        piece = np.concatenate([*ids, np.full(len(bare), -1, np.int32)])
        # Every unit has one place more than bytes.
        source, target = starts[edge] + unit[edge], to + unit[edge]
        gain = np.where(piece < 0, self.unknown, self.score[piece])
        offset = starts[edge] - begin[unit[edge]]
        order = np.argsort(offset, kind="stable")
        bounds = np.flatnonzero(np.diff(offset[order], prepend=-1, append=-1))
        source, target, gain, piece = source[order], target[order], gain[order], piece[order]
        best = np.full(len(data) + len(units), -np.inf)
        best[begin + np.arange(len(units))] = 0.0
        back, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        for a, b in zip(bounds[:-1], bounds[1:]):
            # Edges that start at one offset of different units, or end at different places of one.
            reached = best[source[a:b]] + gain[a:b]
            better = reached > best[target[a:b]]
            to_here = target[a:b][better]
            best[to_here] = reached[better]
            back[to_here] = source[a:b][better]
            last[to_here] = piece[a:b][better]
        here, who = end + np.arange(len(units)), np.arange(len(units))
        goal = begin + np.arange(len(units))
        steps = []
        while len(who):
            steps.append((who, back[here], here, last[here]))
            here = back[here]
            more = here != goal[who]
            who, here = who[more], here[more]
        who, a, b, piece = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(who, kind="stable")
        who, a, b, piece = who[order], a[order], b[order], piece[order]
        times = np.where(piece < 0, b - a, 1)
        flat = np.repeat(piece, times)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
        raw = flat < 0
        flat[raw] = self.bytes[data[(np.repeat(a - who, times) + inner)[raw]]]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(who, weights=times, minlength=len(units)))]).astype(int)
        out = flat.astype("<i4").tobytes()
        return [out[4 * i : 4 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [MARK + text.replace(" ", MARK)]
        if _IRREGULAR.search(text):
            return _UNIT.findall(MARK + text.replace(" ", MARK))
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty ones."""
        units = [self._units(text or "") for text in texts]
        every = set().union(*units)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = every
        ordered = sorted(new, key=len)
        for start in range(0, len(ordered), 8192):
            part = ordered[start : start + 8192]
            shown = [(u if u[0] in MARK + "\n" else MARK + u).encode("utf-8", "replace") for u in part]
            self.known.update(zip(part, self.segment(shown)))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, u)), "<i4") for u in units]

    def decode(self, ids: np.ndarray) -> str:
        """Markers become spaces, byte ids their bytes; the marker before the text goes."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_SEGMENTERS: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """The worker's segmenter of a vocabulary file, built once."""
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(load_vocabulary(path))
    return _SEGMENTERS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_ids, n_byte_ids, ids, decoded_sha256 and round_trip of every row.

    ids are decoded again: round_trip says that the text came back, but for markers
    in it, which come back as spaces. Null and empty texts have no ids. Repeated rows and null
    ids are rows like any other; an empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = segmenter(path)
        for piece in slices(batches, 128):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            ids = tool.encode(texts)
            back = [tool.decode(i) for i in ids]
            counts = np.array([len(i) for i in ids])
            offsets = np.concatenate([[0], np.cumsum(counts)])
            flat = np.concatenate(ids)
            in_bytes = np.concatenate([[0], np.cumsum(np.isin(flat, tool.bytes))])[offsets]
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(counts.astype(np.int64)),
                    pa.array(np.diff(in_bytes).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]),
                    pa.array([t == b.replace(MARK, " ") for t, b in zip(back, texts)]),
                ],
                names=["doc_id", "n_chars", "n_ids", "n_byte_ids", "ids", "decoded_sha256", "round_trip"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        encode,
        f"doc_id {kind}, n_chars bigint, n_ids bigint, n_byte_ids bigint, ids array<int>, "
        "decoded_sha256 string, round_trip boolean",
    )
