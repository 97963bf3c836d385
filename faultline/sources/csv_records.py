"""CSV records of files that are read in parallel splits, quoted line breaks and all.

Whether a line begins inside quotes depends on everything before it in its file. Each split
is walked once for both answers: where it ends if it began outside quotes or inside, and how
many records start in it. Those are two-state maps, and maps compose, so one pass over the
small table of splits tells each split how it begins and which record it begins with. A second
walk emits the records; the pieces of one that lies over several splits meet by its number.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from faultline.session import cut

# A record of more characters than this is an error: its quote was most likely never closed.
RECORD_CHARS = 256 * 1024 * 1024

_SPLIT = "_file string, _start long, end0 boolean, end1 boolean, n0 long, n1 long, header array<string>, lines long"
_RECORD = "_file string, number long, part long, text string, fields array<string>"
_LIST = pa.list_(pa.string())


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside quotes ends inside them."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            # At the start of a field: only a quote here opens one.
            if line[at : at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            inside, at = True, at + 1
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line[quote + 1 : quote + 2] == '"':
            at = quote + 2
            continue
        inside, at = False, line.find(",", quote + 1) + 1
        if not at:
            return False


def fields_of(texts: list[str]) -> list[list[str]]:
    """The fields of records, one text for each."""
    csv.field_size_limit(2**31 - 1)
    return [next(csv.reader([t]), []) for t in texts]


def _splits_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    keys = list(zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist()))
    at = 0
    for key, rows in groupby(keys):
        n = sum(1 for _ in rows)
        yield key, batch.slice(at, n)
        at += n


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split; the header is the first record if the split begins outside quotes."""
    now, closed, lines = None, False, 0
    ends, counts, first = [False, True], [0, 0], []

    def told() -> pa.RecordBatch:
        # A first record that goes on in the next split is found among the pieces.
        header = fields_of(["\n".join(first)])[0] if closed else None
        columns = [now[0]], [now[1]], [ends[0]], [ends[1]], [counts[0]], [counts[1]]
        names = [f.split()[0] for f in _SPLIT.split(", ")]
        return pa.record_batch([*map(pa.array, columns), pa.array([header], _LIST), pa.array([lines])], names=names)

    for batch in batches:
        for key, part in _splits_of(batch):
            if key != now:
                if now is not None:
                    yield told()
                now, closed, lines = key, False, 0
                ends, counts, first = [False, True], [0, 0], []
            for line in part.column("value").to_pylist():
                for s in (0, 1):
                    # Blank lines between records are no records.
                    counts[s] += not ends[s] and line != ""
                if not closed and (first or line != ""):
                    first.append(line)
                ends = [ends_inside(line, ends[0]), ends_inside(line, ends[1])]
                closed = closed or (bool(first) and not ends[0])
            lines += part.num_rows
    if now is not None:
        yield told()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete records with their fields, and the pieces of those that go on in other splits."""
    now, inside, number, held, part_of = None, False, 0, [], None
    whole: list[tuple[str, int, str]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        if whole:
            files, numbers, texts = zip(*whole)
            n = len(whole)
            yield pa.record_batch(
                [pa.array(files), pa.array(numbers), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(fields_of(list(texts)), _LIST)],
                names=["_file", "number", "part", "text", "fields"],
            )
            whole.clear()

    def piece() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([now[0]]), pa.array([number]), pa.array([now[1]]), pa.array(["\n".join(held)]), pa.array([None], _LIST)],
            names=["_file", "number", "part", "text", "fields"],
        )

    for batch in batches:
        for key, part in _splits_of(batch):
            if key != now:
                if held:
                    yield piece()
                first = part.slice(0, 1)
                now, held = key, []
                inside, number = first.column("inside")[0].as_py(), first.column("before")[0].as_py()
                # A record that began in an earlier split stays in pieces.
                part_of = inside
            for line in part.column("value").to_pylist():
                if not inside:
                    if line == "":
                        continue
                    number += 1
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    if part_of:
                        yield piece()
                        part_of = False
                    else:
                        whole.append((now[0], number, "\n".join(held)))
                    held = []
        yield from rows()
    if held:
        yield piece()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = pa.array(fields_of(batch.column("text").to_pylist()), _LIST)
        yield pa.record_batch([batch.column("_file"), batch.column("number"), fields], names=["_file", "number", "fields"])


def split_table(lines: DataFrame) -> DataFrame:
    """_file, _start, inside, before, header and lines of every split of ``lines`` (_file, _start, value in file order).

    ``inside`` says whether the split begins inside quotes, ``before`` how many records begin before it.
    """
    splits = lines.select("_file", "_start", "value").mapInArrow(_summaries, _SPLIT)
    # A map either forgets how the split began (fixed), keeps it or turns it round.
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int"))
    turned = (fixed.isNull() & F.col("end0")).cast("int")
    earlier = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    turns = splits.withColumns({"fixed": fixed, "turns": F.coalesce(F.sum(turned).over(earlier), F.lit(0))})
    # What a fixed split ends with, and the turns counted up to there: it turns nothing itself.
    since = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(earlier)
    begun = turns.withColumn("since", since).withColumn(
        "inside",
        F.pmod(F.coalesce(F.col("since.fixed"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("since.turns"), F.lit(0)), F.lit(2)) == 1,
    )
    mine = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    counted = begun.withColumn("before", F.coalesce(F.sum(mine).over(earlier), F.lit(0)))
    opens = (F.col("before") == 0) & ~F.col("inside") & (F.col("n0") > 0)
    return cut(counted.select(
        "_file", "_start", "inside", "before", F.when(opens, F.col("header")).alias("header"), "lines",
    ))


def records(lines: DataFrame, splits: DataFrame, broadcast: bool) -> DataFrame:
    """_file, number (from 1, blank lines not counted) and fields of every record.

    ``splits`` comes from ``split_table`` over the same lines; files it leaves out are left out.
    """
    if broadcast:
        told = lines.join(F.broadcast(splits.drop("header", "lines")), ["_file", "_start"])
    else:
        placed = lines.withColumn("_at", F.monotonically_increasing_id())
        told = placed.join(splits.drop("header", "lines"), ["_file", "_start"])
        told = told.repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at")
    found = cut(told.select("_file", "_start", "value", "inside", "before").mapInArrow(_records, _RECORD))
    pieces = found.where("part is not null").groupBy("_file", "number").agg(
        F.sum(F.length("text")).alias("size"), F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p")
    )
    text = F.when(F.col("size") > RECORD_CHARS, F.raise_error(F.lit("a CSV record is too long: a quote may not be closed")).cast("string"))
    joined = pieces.select("_file", "number", text.otherwise(F.array_join("p.text", "\n")).alias("text"))
    return found.where("part is null").select("_file", "number", "fields").unionByName(
        joined.mapInArrow(_parsed, "_file string, number long, fields array<string>")
    )
