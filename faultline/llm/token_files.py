"""Token ids in Arrow files of fixed-size-list batches.

A file holds the ids of consecutive documents cut into sequences of one length:
columns ``ids`` (fixed-size list of uint16, or uint32 for more than 65,536 ids) and
``mask`` (fixed-size list of bits, 0 on the padding that fills the last sequence).
Every batch has the same number of sequences, so that sequence i lies in batch
i // BATCH at row i % BATCH, and a reader that maps the file gets it without a copy. The document index is a Parquet table.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm.shared import single_blanks, slices
from faultline.session import cut, scratch_path

SEQUENCE = 2048
BATCH = 64
END_ID = 0
CACHED = 1_000_000
_ENDINGS = ".,;:!?*$%&#|"

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE ids by the tokenizers library, each distinct spaced word encoded once.

    The vocabulary's pattern never joins characters across a blank between two other
    characters, so such texts fall into words that encode alike wherever they stand.
    Texts with other blanks, and those that hold the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # The library would start threads for all cores in every task, which has one.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_break = int(self._ids("\n")[0])
        self.line_bytes = self._ids("\n").tobytes()
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        """Ids of new words, many in one text: a line break is always a token of its own."""
        for start in range(0, len(new), 64):
            part = new[start : start + 64]
            shown = [u[2:] if u[:2] == "\n\n" else u[1:] if u[:1] == "\n" else " " + u for u in part]
            ids = self._ids("\n".join(shown))
            ends = np.flatnonzero(ids == self.line_break).tolist() + [len(ids)]
            raw, before = ids.tobytes(), 0
            for unit, end in zip(part, ends, strict=True):
                found = raw[4 * before : 4 * end]
                self.known[unit] = self.line_bytes + found if unit[:1] == "\n" != unit[1:2] else found
                before = end + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units: list[list[str] | None] = []
        for text in texts:
            if not single_blanks(text) or any(t in text for t in self.added):
                units.append(None)
            else:
                # A line break goes with the word behind it; two mark the first word, which has no space.
                units.append(("\n\n" + text.replace("\n", " \n")).split(" "))
        every = set().union(*[u for u in units if u])
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = every
        # Endings such as commas are pieces of their own: the word before them is learnt once.
        bare = {u: u.rstrip(_ENDINGS) for u in new if u[-1] in _ENDINGS}
        bare = {u: core for u, core in bare.items() if core[-1:].isalpha()}
        ends = {"\n\n" + u[len(core) :] for u, core in bare.items()}
        self._learn(sorted((new - bare.keys() | set(bare.values()) | ends).difference(self.known)))
        known = self.known
        for u, core in bare.items():
            known[u] = known[core] + known["\n\n" + u[len(core) :]]
        return [
            self._ids(text) if of_text is None else np.frombuffer(b"".join(map(known.__getitem__, of_text)), "<u4")
            for text, of_text in zip(texts, units)
        ]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_schema(sequence: int, ids: int) -> pa.Schema:
    kind = pa.uint16() if ids <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Writes a stream of ids as full batches of equal-length sequences."""

    def __init__(self, sink, sequence: int, batch: int, ids: int = 1 << 32):
        self.schema = file_schema(sequence, ids)
        self.kind = self.schema.field("ids").type.value_type
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.sequence, self.size = sequence, sequence * batch
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.size * self.size
            for start in range(0, full, self.size):
                self._write(flat[start : start + self.size], self.size)
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.kind.to_pandas_dtype())), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += valid

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, np.uint32)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of a file, zero-copy where the file can be mapped."""

    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(filesystem, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else filesystem.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.at: tuple[int, np.ndarray, pa.BooleanArray] | None = None

    def _batch(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if self.at is None or self.at[0] != number:
            batch = self.reader.get_batch(number)
            self.at = (number, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self.at[1], self.at[2]

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence, views of the mapped file."""
        ids, mask = self._batch(i // self.rows)
        row = i % self.rows * self.sequence
        return ids[row : row + self.sequence], mask.slice(row, self.sequence)

    def span(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids from a position of the file on, batch by batch."""
        size = self.rows * self.sequence
        while length > 0:
            ids, mask = self._batch(start // size)
            piece = ids[start % size : start % size + length]
            if not len(piece) or mask.slice(start % size, len(piece)).false_count:
                raise ValueError("the span runs into padding")
            yield piece
            start, length = start + len(piece), length - len(piece)

    def close(self) -> None:
        self.at = None
        self.source.close()


INDEX = "doc_id bigint, part int, file string, at bigint, n_tokens bigint"


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, sequence: int = SEQUENCE, batch: int = BATCH
) -> DataFrame:
    """Write the token files in ascending doc_id order and return their document index.

    Index rows have doc_id, part, file, at (first id in the file), n_tokens and start (all ids
    before it). Null texts are empty: they get the end id alone. Null ids come first;
    rows with one id stand by their text. A retried task writes another file, and only
    files of finished tasks are in the index. An empty table writes no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        writer = sink = None
        at = 0
        encode = encoder(vocabulary).encode
        for piece in slices(batches, 128):
            if writer is None:
                filesystem, path = pafs.FileSystem.from_uri(uri)
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = filesystem.open_output_stream(path)
                writer = SequenceWriter(sink, sequence, batch, encoder(vocabulary).library.get_vocab_size())
            counts = []
            for ids in encode(piece.column("text").to_pylist()):
                writer.add(np.append(ids, np.uint32(END_ID)))
                counts.append(len(ids) + 1)
            ends = at + np.cumsum(counts)
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array([uri] * len(counts)),
                    pa.array(ends - counts),
                    pa.array(np.array(counts, np.int64)),
                ],
                names=["doc_id", "part", "file", "at", "n_tokens"],
            )
            at = int(ends[-1])
        if writer is not None:
            writer.close()
            sink.close()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    index = cut(ordered.mapInArrow(write, INDEX))
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    return index.join(sizes, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = name = None
        for piece in slices(batches, 4096):
            sums = []
            for uri, at, n in zip(*(piece.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if uri != name:
                    if file is not None:
                        file.close()
                    file, name = SequenceFile(uri), uri
                crc = 0
                for ids in file.span(at, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                sums.append(crc)
            yield pa.record_batch(
                [piece.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if file is not None:
            file.close()

    by_file = index.repartition("file").sortWithinPartitions("file", "at")
    return by_file.select("doc_id", "start", "n_tokens", "file", "at").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_folder(docs: DataFrame) -> str:
    """A fresh folder for token files that all executors reach."""
    return scratch_path(docs.sparkSession, "tokens")
