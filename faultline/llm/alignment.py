"""Cross-tokenizer alignment by inverted bitmaps of token pairs.

Two tokenizers cut the same bytes. Byte offsets where both end a token cut the text into
groups; a token of the one is linked to each token of the other whose bytes it overlaps.
For each pair of ids an inverted list says which documents hold it: documents are numbered
in blocks of ``BLOCK`` slots, and a pair has, for each block, one compressed bitmap for each
binary digit of the number of its links (the multiplicity planes). The OR of the planes,
popcounted, gives the pair's documents in the block, the weighted popcounts of the planes
give its links. Sums over blocks give the corpus-wide counts, and the same bitmaps carry
them back to the documents as scores.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from faultline.llm.shared import single_blanks, slices
from faultline.session import cut

SLOT_BITS = 12
BLOCK = 1 << SLOT_BITS
BITMAP = BLOCK // 8
# A block ends earlier when it holds so many (pair, document) postings.
POSTINGS = 1 << 21
CACHED = 400_000
HELD = 64_000_000
# Words of more characters are not kept in the cache.
LONGEST = 64
# Blocks of so many neighbouring tasks are counted together before a pair's total.
TASKS = 64

# A blank or a line break between two other characters: no token of either kind reaches across.
_SPLIT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")

RESULT = (
    "doc_id long, block long, slot int, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, groups string, pair long, docs int, links long, planes array<binary>"
)

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            shown[chr(256 + len(shown) - len(plain))] = b
    return shown


class Aligner:
    """Units of text (words with the blank before them) and how the two tokenizers cut them.

    Each distinct unit is encoded and aligned once and kept by number, until there are
    ``CACHED`` units or ``HELD`` characters of their groups.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # The library would start threads for all cores in every task, which has one.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        self.raw_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            self.raw_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.raw_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in raw]) for raw in (self.raw_a, self.raw_b))
        # Words stand alone only if no piece goes on with a blank or line break after another character.
        self.words = not any("▁" in p.lstrip("▁") or ("\n" in p and p != "\n") for p in pieces)
        self.lead = len(self.b.encode("\n"))
        # An id of a within its group and at its end, then the same for b.
        ids = [(len(self.raw_a), ",", "|"), (len(self.raw_b), ",", ";")]
        self.shown = [f"{i}{mark}" for n, *marks in ids for mark in marks for i in range(n)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of a, of b, groups, first link, links
        self.flat = np.zeros(0, np.int64)
        self.held = 0

    def _aligned(self, all_a: list[list[int]], all_b: list[list[int]]) -> None:
        """Keeps units behind those known; the tokens of both kinds spell the same bytes in every unit."""
        n_a, n_b = np.array([len(x) for x in all_a]), np.array([len(x) for x in all_b])
        ids_a, ids_b = (np.array([i for ids in every for i in ids]) for every in (all_a, all_b))
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        # Bytes between two neighbouring ends belong to one token of each kind: a link.
        ends = np.union1d(end_a, end_b)
        pairs = ids_a[np.searchsorted(end_a, ends)] * self.size_b + ids_b[np.searchsorted(end_b, ends)]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        size = len(self.raw_a)
        codes = np.concatenate([ids_a + size * last_a, ids_b + 2 * size + self.size_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts = [self.shown[c] for c in codes[order].tolist()]
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = ["".join(parts[x:y])[:-1] for x, y in zip(bounds, bounds[1:])]
        unit_end = end_a[np.cumsum(n_a) - 1]
        last_link, last_group = np.searchsorted(ends, unit_end) + 1, np.searchsorted(common, unit_end) + 1
        links, groups = np.diff(last_link, prepend=0), np.diff(last_group, prepend=0)
        rows = np.stack([n_a, n_b, groups, len(self.flat) + last_link - links, links], axis=1)
        self.numbers = np.concatenate([self.numbers, rows])
        self.flat = np.concatenate([self.flat, pairs])
        self.texts += texts
        self.held += sum(map(len, texts))

    def _same(self, units: list[str], all_a: list[list[int]], all_b: list[list[int]]) -> list[int]:
        """Places of the units that both kinds of tokens spell; many are compared at once, as one text."""
        raw = [u.encode() for u in units]
        wanted = np.array([len(r) for r in raw])
        fits = np.ones(len(units), bool)
        for every, length in ((all_a, self.length_a), (all_b, self.length_b)):
            ends = np.concatenate([[0], np.cumsum(length[np.fromiter(chain.from_iterable(every), np.int64)])])
            fits &= np.diff(ends[np.concatenate([[0], np.cumsum([len(x) for x in every])])]) == wanted

        def spelled(places: list[int]) -> bool:
            text = b"".join([raw[i] for i in places])
            return all(
                b"".join([shown[x] for i in places for x in every[i]]) == text
                for every, shown in ((all_a, self.raw_a), (all_b, self.raw_b))
            )

        # Tokens as long as each unit spell all of them if they spell the units joined.
        places, good = np.flatnonzero(fits).tolist(), []
        for start in range(0, len(places), 64):
            part = places[start : start + 64]
            good += part if spelled(part) else [i for i in part if spelled([i])]
        return good

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        all_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # The library puts a blank before a text; a line break keeps it away from units without one.
        all_b = self.b.encode([u[1:] if u[:1] == " " else "\n" + u for u in new], num_threads=1)
        all_b = [ids if u[:1] == " " else ids[self.lead :] for u, ids in zip(new, all_b)]
        good = self._same(new, all_a, all_b)
        self.known.update(dict.fromkeys(new, -1))
        self.known.update(zip([new[i] for i in good], range(len(self.texts), len(self.texts) + len(good))))
        if good:
            self._aligned([all_a[i] for i in good], [all_b[i] for i in good])

    def split(self, text: str) -> list[str]:
        if self.words and "\0" not in text and single_blanks(text):
            return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        parts = _SPLIT.split(text) if self.words else [text]
        units = [p if p[:1] == "\n" else " " + p for p in parts]
        units[0] = " " + parts[0]
        return units

    def number(self, texts: list[str]) -> list[np.ndarray | None]:
        """The units of each text by number; None for a text that has no tokens."""
        split = [self.split(t) if t else [] for t in texts]
        every = set().union(*split)
        new = every.difference(self.known)
        if self.texts and (len(self.texts) + len(new) > CACHED or self.held > HELD):
            self.clear()
            new = every
        self._learn(sorted(new))
        out: list[np.ndarray | None] = []
        for text, units in zip(texts, split):
            found = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            if len(units) > 1 and found.min() < 0:
                # The contract is on whole texts: what is lost within a unit is looked at there.
                self._learn([whole := " " + text])
                found = np.array([self.known[whole]])
                new.add(whole)
            out.append(found if len(found) and found[0] >= 0 else None)
        for unit in new:
            if len(unit) > LONGEST:
                del self.known[unit]
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two vocabularies, loaded once."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def containers(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(pair, docs, links, planes) of the postings of a block.

    ``keys`` are distinct (pair << SLOT_BITS | slot), ``times`` the links of each. A plane
    of fewer than ``BITMAP // 2`` slots is their sorted list of 16-bit numbers, others are bitmaps.
    """
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    pairs, slots = keys >> SLOT_BITS, (keys & (BLOCK - 1)).astype("<u2")
    firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
    of = np.repeat(np.arange(len(firsts)), np.diff(firsts, append=len(pairs)))
    links = np.add.reduceat(times, firsts)
    digits = int(times.max()).bit_length()
    held = [np.flatnonzero(times >> k & 1) for k in range(digits)]
    entry = np.concatenate(held)
    plane = np.repeat(np.arange(digits), [len(h) for h in held])
    container = of[entry] * digits + plane
    order = np.argsort(container, kind="stable")
    container, slots_of = container[order], slots[entry[order]]
    # Empty planes below a pair's highest one are kept, so that a plane's place is its digit.
    highest = np.zeros(len(firsts), np.int64)
    np.maximum.at(highest, of[entry], plane)
    n = np.bincount(container, minlength=len(firsts) * digits)
    wanted = (np.arange(digits)[None, :] <= highest[:, None]).ravel()
    counts = n[wanted]
    sizes = np.where(2 * counts < BITMAP, 2 * counts, BITMAP)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(offsets[-1], np.uint8)
    begin = np.concatenate([[0], np.cumsum(counts)])
    sparse = 2 * counts < BITMAP
    which = np.repeat(np.arange(len(counts)), counts)
    listed = sparse[which]
    inside = np.arange(len(which)) - begin[which]
    data.view("<u2")[(offsets[which] // 2 + inside)[listed]] = slots_of[listed]
    for i in np.flatnonzero(~sparse):
        bits = np.zeros(BLOCK, np.uint8)
        bits[slots_of[begin[i] : begin[i + 1]]] = 1
        data[offsets[i] : offsets[i + 1]] = np.packbits(bits, bitorder="little")
    flat = pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)]
    )
    planes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(highest + 1)]), pa.int32()), flat)
    # The OR of a pair's planes has one bit for each of its documents.
    docs = np.diff(firsts, append=len(pairs))
    return pairs[firsts], docs, links, planes


def _spread(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and behind each block the rows of its pairs."""
    found = aligner(path_a, path_b)
    block, slot, waiting, held = TaskContext.get().partitionId() << 20, 0, [], 0
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = dict(zip(names, [
        pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
        pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()),
    ]))

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = []
        for name in names:
            values = columns.get(name)
            if values is None:
                arrays.append(pa.nulls(n, kinds[name]))
            else:
                arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kinds[name]))
        return pa.record_batch(arrays, names=names)

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            pair, docs, links, planes = containers(*[np.concatenate(w) for w in zip(*waiting)])
            for start in range(0, len(pair), 10_000):
                part = slice(start, start + 10_000)
                yield rows(
                    len(pair[part]), block=np.full(len(pair[part]), block), pair=pair[part], docs=docs[part],
                    links=links[part], planes=planes[start : start + 10_000],
                )

    for batch in slices(batches, 128):
        if slot + batch.num_rows > BLOCK or held > POSTINGS:
            yield from closed()
            block, slot, waiting, held = block + 1, 0, [], 0
        units = found.number(batch.column("text").to_pylist())
        n = len(units)
        numbers, digests, shown = np.zeros((n, 4), np.int64), [], []
        each, times, owner = [], [], []
        for i, unit in enumerate(units):
            if unit is None:
                digests.append("")
                shown.append("")
                continue
            numbers[i] = found.numbers[unit][:, [0, 1, 2, 4]].sum(axis=0)
            text = ";".join([found.texts[u] for u in unit.tolist()])
            digests.append(hashlib.sha256(text.encode()).hexdigest())
            shown.append(text if texts else None)
            distinct, count = np.unique(unit, return_counts=True)
            each.append(distinct)
            times.append(count)
            owner.append(np.full(len(distinct), slot + i))
        if each:
            unit, count, place = np.concatenate(each), np.concatenate(times), np.concatenate(owner)
            links = found.numbers[unit, 4]
            which = np.repeat(np.arange(len(unit)), links)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(links) - links, links)
            keys = found.flat[found.numbers[unit, 3][which] + inside] << SLOT_BITS | place[which]
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], count[which][order]
            firsts = np.flatnonzero(np.diff(keys, prepend=-1))
            waiting.append((keys[firsts], np.add.reduceat(weights, firsts)))
            held += len(firsts)
        yield rows(
            n, doc_id=batch.column("doc_id"), block=np.full(n, block), slot=np.arange(slot, slot + n, dtype=np.int32),
            n_a=numbers[:, 0], n_b=numbers[:, 1], n_groups=numbers[:, 2], n_links=numbers[:, 3],
            groups_sha256=digests, groups=shown,
        )
        slot += n
    yield from closed()


def spread(docs: DataFrame, path_a: str, path_b: str, texts: bool = False) -> DataFrame:
    """Rows of documents (pair null) and rows of inverted bitmaps (pair not null), written and read back.

    A document's row has its block, slot, token, group and link numbers and the digest of its
    groups (with ``texts`` the groups too). Nulls, empty texts and texts whose token bytes are
    not those of the text have zeros and no bitmap. Repeated rows are documents of their own.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return cut(narrow.mapInArrow(lambda b: _spread(b, path_a, path_b, texts), RESULT))


def pair_counts(spread_rows: DataFrame, size_b: int) -> DataFrame:
    """id_a, id_b, docs (documents that link the ids), links (their number) and best of every pair.

    ``best`` says that no other pair of this id_a is in more documents.
    """
    totals = cut(_partial(spread_rows).groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))
    ids = totals.withColumn("id_a", F.expr(f"pair div {size_b}")).withColumn("id_b", F.col("pair") % size_b)
    # An id has at most as many partners as the other vocabulary has pieces.
    most = ids.groupBy("id_a").agg(F.max("docs").alias("most"))
    return ids.join(most, "id_a").select("pair", "id_a", "id_b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def _partial(spread_rows: DataFrame) -> DataFrame:
    """A pair's counts in each range of blocks; a pair in most documents has many ranges."""
    bitmaps = spread_rows.where("pair is not null").withColumn("range", F.shiftright("block", 20 + TASKS.bit_length() - 1))
    return bitmaps.groupBy("pair", "range").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bitmaps sorted by block; returns block, slot, n_best, count_sum of the slots they set."""
    now, sums = None, np.zeros((2, BLOCK))

    def done() -> Iterator[pa.RecordBatch]:
        slots = np.flatnonzero(sums[1])
        if now is not None and len(slots):
            yield pa.record_batch(
                [pa.array(np.full(len(slots), now)), pa.array(slots.astype(np.int32)),
                 pa.array(sums[0, slots].astype(np.int64)), pa.array(sums[1, slots].astype(np.int64))],
                names=["block", "slot", "n_best", "count_sum"],
            )

    for batch in slices(batches, 10_000):
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)).tolist() + [len(blocks)]
        for start, end in zip(cuts, cuts[1:]):
            if blocks[start] != now:
                yield from done()
                now, sums = int(blocks[start]), np.zeros((2, BLOCK))
            part = batch.slice(start, end - start)
            planes = part.column("planes")
            each = planes.value_lengths().to_numpy()
            flat = planes.flatten().cast(pa.large_binary())
            offsets = np.frombuffer(flat.buffers()[1], "<i8")[flat.offset : flat.offset + len(flat) + 1]
            data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            digit = np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)
            count = part.column("docs").to_numpy().astype(float)
            best = part.column("best").to_numpy(zero_copy_only=False).astype(float)
            weights = np.repeat(np.stack([best, count]), each, axis=1) * 2.0**digit
            sizes = np.diff(offsets)
            dense = sizes == BITMAP
            which = np.repeat(np.arange(len(flat)), sizes // 2)
            listed = ~dense[which]
            slots = data.view("<u2")[listed]
            for i in range(2):
                sums[i] += np.bincount(slots, weights[i][which[listed]], minlength=BLOCK)
            full = np.flatnonzero(dense)
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                bits = np.unpackbits(np.stack([data[offsets[i] : offsets[i + 1]] for i in some]), axis=1, bitorder="little")
                sums += weights[:, some] @ bits
    yield from done()


def align(docs: DataFrame, path_a: str, path_b: str, size_b: int, texts: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups``) of every row.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, ``path_b`` a sentencepiece
    model with ``size_b`` pieces. ``n_best`` counts the links whose pair is in as many documents
    as any pair of its first id, ``count_sum`` adds up the documents of the links' pairs. Null
    ids are kept as they are, repeated rows count as documents of their own; an empty table gives no rows.
    """
    rows = spread(docs, path_a, path_b, texts)
    bitmaps = rows.where("pair is not null").withColumn("range", F.shiftright("block", 20 + TASKS.bit_length() - 1))
    scored = pair_counts(rows, size_b).select("pair", "docs", "best")
    # Each range of blocks has its own copy of a pair's score, so no key of this join is in more than a range.
    told = _partial(rows).select("pair", "range").join(scored, "pair")
    back = bitmaps.select("pair", "range", "block", "planes").join(told, ["pair", "range"])
    back = back.select("block", "planes", "docs", "best").repartition("block").sortWithinPartitions("block")
    scores = back.mapInArrow(_scores, "block long, slot int, n_best long, count_sum long")
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    result = rows.where("pair is null").join(scores, ["block", "slot"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return result.select(*shown, *zero, "groups_sha256", *(["groups"] if texts else []))
