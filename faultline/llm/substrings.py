"""Exact removal of repeated 20-word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash of the four-word mers in it. Consecutive
windows of a document with one minimiser form a super-k-mer: their words travel as one
packed string to the bucket of the minimiser, where all equal windows of the corpus
meet and sorting finds the first of each. Super-k-mers that a task sees again travel
once, with their earliest place; the later copies are known to be repeats at once.
Packed strings of a bucket travel compressed, many to a row.

Windows are counted by slots of minimisers first. Where a slot holds too many, its windows
travel one by one to the bucket of a hash of all their words: equal ones still meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from faultline.llm.shared import free_names, slices, words
from faultline.session import cut

WINDOW = 20
MER = 4
HELD_BYTES = 24 << 20
# Minimisers are counted by slot; a slot of more windows than this, or than twice the mean, is split.
SLOTS = 1 << 16
HOT_WINDOWS = 1 << 19

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
PACKED = "bucket int, id bigint, hash bigint, spans binary, packed binary"


def runs(of_text: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end window and minimiser of each super-k-mer of a text of 20 words or more."""
    crc = np.fromiter(map(zlib.crc32, of_text), np.uint64, len(of_text))
    n = len(crc) - MER + 1
    mers = np.zeros(n, np.uint64)
    for i in range(MER):
        mers = (mers ^ crc[i : i + n]) * _ODD[0]
        mers ^= mers >> np.uint64(31)
    least = sliding_window_view(mers, WINDOW - MER + 1).min(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return starts, np.append(starts[1:], len(least)), least[starts]


def _merge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans sorted by start joined where they touch, as flat (start, end) pairs."""
    reach = np.maximum.accumulate(ends)
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(first[1:], True)
    return np.column_stack([starts[first], reach[last]]).astype("<i4").ravel()


class Packer:
    """Super-k-mers waiting to be sent, each distinct one with its earliest place."""

    def __init__(self, buckets: int, hot: frozenset[int] = frozenset()):
        self.buckets = buckets
        self.hot = np.zeros(SLOTS, bool)
        self.hot[list(hot)] = True
        self.held: dict[bytes, tuple[int, int, int, int]] = {}
        self.repeats: dict[tuple[int, int], list[int]] = {}
        self.size = 0

    def add(self, id: int, hash: int, text: str) -> None:
        of_text = words(text)
        if len(of_text) < WINDOW:
            return
        joined = b" ".join(of_text)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, of_text), np.int64, len(of_text)) + 1)])
        starts, ends, least = runs(of_text)
        split = self.hot[least % np.uint64(SLOTS)]
        bucket_of = np.where(split, -1, (least % np.uint64(self.buckets)).astype(np.int64))
        if split.any():
            # Every window of a hot slot on its own.
            times = np.where(split, ends - starts, 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            starts, bucket_of = np.repeat(starts, times) + nth, np.repeat(bucket_of, times)
            ends = np.where(bucket_of < 0, starts + 1, np.repeat(ends, times))
        places = zip(
            starts.tolist(), at[starts].tolist(), (at[ends + WINDOW - 1] - 1).tolist(),
            bucket_of.tolist(), (ends - starts).tolist(),
        )
        held = self.held
        for start, a, b, bucket, windows in places:
            packed = joined[a:b]
            if bucket < 0:
                bucket = zlib.crc32(packed) % self.buckets
            place = (id, hash, start, bucket)
            other = held.setdefault(packed, place)
            if other is place:
                self.size += b - a + 100
            elif other[:3] != place[:3]:
                if place < other:
                    held[packed], place = place, other
                self.repeats.setdefault(place[:2], []).extend((place[2], place[2] + windows + WINDOW - 1))

    def rows(self) -> pa.RecordBatch:
        """Everything held, as rows of ``PACKED``."""
        by_bucket: dict[int, list[tuple[bytes, tuple]]] = {}
        for packed, place in self.held.items():
            by_bucket.setdefault(place[3], []).append((packed, place))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out: list[tuple] = []
        for bucket, items in by_bucket.items():
            head = np.array([p[:3] for _, p in items], "<i8").tobytes()
            body = squeeze(len(items).to_bytes(8, "little") + head + b"\n".join(s for s, _ in items))
            out.append((bucket, None, None, None, body))
        for (id, hash), flat in self.repeats.items():
            spans = np.array(flat).reshape(-1, 2)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            out.append(((id ^ hash) % self.buckets, id, hash, _merge(spans[:, 0], spans[:, 1]).tobytes(), None))
        self.held, self.repeats, self.size = {}, {}, 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) or [()] * 5
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "id", "hash", "spans", "packed"]
        )


def repeats_in(bodies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash, spans) of the windows of a bucket that are not the first of their words."""
    keys, ids, hashes, places, seconds = [], [], [], [], []
    expand = zstandard.ZstdDecompressor().decompress
    for body in bodies:
        raw = expand(body)
        n = int.from_bytes(raw[:8], "little")
        head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3)
        text = raw[8 + 24 * n :]
        lengths = np.array([s.count(b" ") + 1 for s in text.split(b"\n")])
        flat = text.split()
        hashed = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
        of_run = np.repeat(np.arange(n), lengths)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        valid = np.flatnonzero(offset <= np.repeat(lengths, lengths) - WINDOW)
        m = len(flat) - WINDOW + 1
        other = hashed * _ODD[1]
        other ^= other >> np.uint64(32)
        first, second = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        for i in range(WINDOW):
            first = first * _ODD[0] + hashed[i : i + m]
            second = second * _ODD[1] + other[i : i + m]
        run = of_run[valid]
        keys.append(first[valid])
        seconds.append(second[valid])
        ids.append(head[run, 0])
        hashes.append(head[run, 1])
        places.append((head[run, 2] + offset[valid]).astype(np.int32))
    key = np.concatenate(keys)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return
    key, second, id, hash_, place = (np.concatenate(x)[at] for x in (keys, seconds, ids, hashes, places))
    order = np.lexsort((place, hash_, id, second, key))
    key, second, id, hash_, place = (x[order] for x in (key, second, id, hash_, place))
    opens = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])])
    lead = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    # A repeated row stands at the same place as the first: it isn't later.
    later = (id != id[lead]) | (hash_ != hash_[lead]) | (place != place[lead])
    id, hash_, place = id[later], hash_[later], place[later]
    order = np.lexsort((place, hash_, id))
    id, hash_, place = id[order], hash_[order], place[order]
    breaks = np.flatnonzero((id[1:] != id[:-1]) | (hash_[1:] != hash_[:-1])) + 1 if len(id) else []
    bounds = [0, *breaks, len(id)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield int(id[a]), int(hash_[a]), _merge(place[a:b], place[a:b] + WINDOW).tobytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a task by slot of their minimiser: at most one row for each slot."""
    total = np.zeros(SLOTS, np.int64)
    for piece in slices(batches, 64):
        slots, windows = [], []
        for text in piece.column("text").to_pylist():
            of_text = words(text)
            if len(of_text) >= WINDOW:
                starts, ends, least = runs(of_text)
                slots.append((least % np.uint64(SLOTS)).astype(np.int64))
                windows.append(ends - starts)
        if slots:
            np.add.at(total, np.concatenate(slots), np.concatenate(windows))
    slot = np.flatnonzero(total)
    yield pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "windows"])


def hot_slots(rows: DataFrame) -> frozenset[int]:
    """Slots of minimisers that hold too many windows of the texts for one bucket."""
    counts = cut(rows.select("text").mapInArrow(_count, "slot int, windows bigint").groupBy("slot").agg(F.sum("windows").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS
    # Above twice the mean: fewer than half of the slots.
    return frozenset(r["slot"] for r in counts.where(F.col("n") > max(HOT_WINDOWS, 2 * mean)).select("slot").collect())


def _pack(buckets: int, hot: frozenset[int]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, hot)
        for piece in slices(batches, 64):
            for id, hash, text in zip(*(piece.column(c).to_pylist() for c in ("id", "hash", "text"))):
                packer.add(id, hash, text)
                if packer.size >= HELD_BYTES:
                    yield packer.rows()
        yield packer.rows()

    return pack


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket follow each other; spans that are already known pass through."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "hash", "spans"])

    current, bodies = None, []
    for piece in slices(batches, 512):
        packed = piece.column("packed").is_valid()
        known = piece.filter(pa.compute.invert(packed)).select(["id", "hash", "spans"])
        if known.num_rows:
            yield known
        sent = piece.filter(packed)
        for bucket, body in zip(sent.column("bucket").to_pylist(), sent.column("packed").to_pylist()):
            if bucket != current and bodies:
                yield out(list(repeats_in(bodies)))
                bodies = []
            current = bucket
            bodies.append(body)
    if bodies:
        yield out(list(repeats_in(bodies)))


def _identified(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.withColumns(
        {names["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), names["hash"]: F.xxhash64("text")}
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, hash, spans: word ranges covered by repeated windows, for rows that have any.

    id is doc_id, with null as the least long; hash tells rows of one id apart.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _identified(docs.select("doc_id", "text"), {"id": "id", "hash": "hash"}).select("id", "hash", "text")
    packed = rows.mapInArrow(_pack(3 * partitions, hot_slots(rows)), PACKED)
    found = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(_find, "id bigint, hash bigint, spans binary")


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows of ``docs`` with the lists of their repeated word ranges, or null, and the name of that column."""
    id, hash, found = free_names(docs, "_id", "_hash", "_spans")
    spans = cut(repeated_spans(docs)).distinct().groupBy("id", "hash").agg(F.collect_list("spans").alias(found))
    named = _identified(docs, {"id": id, "hash": hash})
    spans = spans.withColumnsRenamed({"id": id, "hash": hash})
    return named.join(spans, [id, hash], "left").drop(id, hash), found


def kept_words(text: str | None, spans: list[bytes] | None) -> tuple[int, list[bytes]]:
    """Number of words and the words outside the spans."""
    of_text = words(text)
    if not spans:
        return len(of_text), of_text
    gone = np.zeros(len(of_text) + 1, np.int32)
    pairs = np.concatenate([np.frombuffer(s, "<i4") for s in spans]).reshape(-1, 2)
    np.add.at(gone, pairs[:, 0], 1)
    np.add.at(gone, pairs[:, 1], -1)
    stays = np.cumsum(gone)[:-1] == 0
    return len(of_text), [w for w, stay in zip(of_text, stays.tolist()) if stay]


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null texts have no words. A window repeats another if that stands in a smaller
    id (null first) or earlier in the same text; among different texts of one id the
    order is that of their hash, and repeated rows don't remove each other's words. An
    empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column("_spans").to_pylist()):
                n, kept = kept_words(text, spans)
                found.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*found)
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    # Two columns clash with no helper's name.
    return _with_spans(docs.select("doc_id", "text"))[0].mapInArrow(
        digest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text`` and ``n_chars`` set anew.

    Texts without repeats, null and empty ones too, stay as they are. Kept words of the others are
    joined by a space; rows that lose every word go. Ids, nulls and repeated rows count as in
    ``removal``; an empty table gives no rows and other columns may have any name.
    """
    schema = docs.schema
    marked, found = _with_spans(docs)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts, stays = [], []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column(found).to_pylist()):
                if spans:
                    text = b" ".join(kept_words(text, spans)[1]).decode("utf-8", "surrogatepass")
                texts.append(text)
                stays.append(bool(text) or not spans)
            columns = []
            for field in schema:
                column = piece.column(field.name)
                if field.name == "text":
                    column = pa.array(texts, pa.string())
                elif field.name == "n_chars":
                    old = column.to_pylist()
                    changed = piece.column(found).is_valid().to_pylist()
                    column = pa.array([len(t) if c else o for t, o, c in zip(texts, old, changed)], column.type)
                columns.append(column)
            yield pa.record_batch(columns, names=schema.names).filter(pa.array(stays))

    return marked.mapInArrow(rewrite, schema)
