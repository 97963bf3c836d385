"""Spelling variants: words one edit apart, found by a dictionary of pairs of trie nodes.

All words are sorted twice, forward and reversed. One pass over each order numbers the nodes
of its trie: a word has a node for every prefix, and in the other trie for every suffix.
The pair (node of the prefix before a character, node of the suffix behind it) says all of
the word but that character. Two words that have the same pair at a skipped character differ
by one replaced character; a word whose pair at a gap between two characters is another
word's at a skipped character is that word with the character deleted. Equal pairs of
integers meet in one shuffle, and no substring travels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.shared import slices
from faultline.session import cut

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
DAMAGED = 31
# Distinct words that a task counts before it hands them on.
HELD = 300_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_NONE = np.iinfo(np.int64).max


def _counted(batches: Iterator[pa.RecordBatch], damaged: int, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def told() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.record_batch([pa.array(part), pa.array([held[w] for w in part])], names=["word", "n"])
        held.clear()

    for batch in slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for doc_id, text in zip(ids, texts):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(LETTERS.findall(text or "")).items():
                if len(run) < least:
                    continue
                run = run.lower() if run.isascii() else run.translate(_LOWER)
                if damaged:
                    mark = zlib.crc32(run.encode(), start)
                    if mark % damaged == 0:
                        at = mark % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                held[run] += n
            if len(held) > HELD:
                yield from told()
    yield from told()


def word_counts(
    docs: DataFrame, damaged: int = DAMAGED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """word, n of the runs of letters of every whole text, A-Z in lower case.

    One of ``damaged`` runs, by a checksum of id and run, loses a character first (0: none does).
    Null texts have no words; a null id counts as an empty one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partial = narrow.mapInArrow(lambda b: _counted(b, damaged, least_length), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _nodes(batches: Iterator[pa.RecordBatch], sorted_by: str, out: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a string, with the numbers of its prefixes' trie nodes; the root is 0.

    The first rows of a task know nothing of the task before: see ``_aliases``.
    """
    task = TaskContext.get().partitionId()
    last, path, number, place = "", [0], task << 40, 0
    for batch in slices(batches, 4096):
        found, lengths = [], []
        for word in batch.column(sorted_by).to_pylist():
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            new = len(word) - shared
            path.extend(range(number + 1, number + new + 1))
            number += new
            last = word
            found.extend(path)
            lengths.append(len(path))
        n = batch.num_rows
        nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(found, pa.int64()))
        extra = {"task": pa.array(np.full(n, task)), "place": pa.array(np.arange(place, place + n)), out: nodes}
        place += n
        columns = {name: batch.column(name) for name in batch.schema.names if name not in extra} | extra
        yield pa.record_batch(list(columns.values()), names=list(columns))


def _numbered(rows: DataFrame, sorted_by: str, out: str) -> DataFrame:
    rows = rows.drop("task", "place")
    schema = f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, task long, place long, {out} array<long>"
    ordered = rows.repartitionByRange(sorted_by).sortWithinPartitions(sorted_by)
    return cut(ordered.mapInArrow(lambda b: _nodes(b, sorted_by, out), schema))


def _aliases(numbered: DataFrame, sorted_by: str, nodes: str) -> dict[int, int]:
    """Nodes of a task's first word that are nodes of the task before too, with their first number.

    Two words of each task come to the driver; at most as many nodes as a task's first word
    shares with the word before it.
    """
    word = F.struct(F.col(sorted_by).alias("word"), F.col(nodes).alias("nodes"))
    ends = numbered.groupBy("task").agg(F.min_by(word, "place").alias("first"), F.max_by(word, "place").alias("last"))
    alias: dict[int, int] = {}
    before = None
    for row in ends.orderBy("task").toLocalIterator():
        if before is not None:
            for depth, (a, b) in enumerate(zip(before.word, row["first"].word), 1):
                if a != b:
                    break
                node = before.nodes[depth]
                alias[row["first"].nodes[depth]] = alias.get(node, node)
        before = row["last"]
    return alias


def _renamed(nodes: np.ndarray, alias: dict[int, int]) -> np.ndarray:
    if not alias:
        return nodes
    old = np.array(sorted(alias))
    new = np.array([alias[x] for x in old.tolist()])
    at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
    return np.where(old[at] == nodes, new[at], nodes)


def _pairs(batches: Iterator[pa.RecordBatch], forward: dict[int, int], backward: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """head, tail (nodes) and said: 4 * id, + 0 at a gap, + 1 at a skipped character, + 2 if it is equal to the next one."""
    for batch in slices(batches, 4096):
        sizes = batch.column("heads").value_lengths().to_numpy()
        heads = _renamed(batch.column("heads").flatten().to_numpy(), forward)
        tails = _renamed(batch.column("tails").flatten().to_numpy(), backward)
        letters = np.frombuffer("".join(w + "\0" for w in batch.column("word").to_pylist()).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = (np.cumsum(sizes) - sizes)[owner]
        depth = np.arange(len(owner)) - begin
        length = sizes[owner] - 1
        ids = 4 * batch.column("id").to_numpy()[owner]
        # The list of a word of L letters has the places 0 to L; all are gaps, all but the last a letter's.
        inner = depth < length
        twin = np.zeros(len(owner), np.int64)
        twin[:-1] = letters[:-1] == letters[1:]
        at = np.flatnonzero(inner)
        columns = [
            np.concatenate([heads, heads[at]]),
            np.concatenate([tails[begin + length - depth], tails[(begin + length - 1 - depth)[at]]]),
            np.concatenate([ids, ids[at] + 1 + twin[at]]),
        ]
        for start in range(0, len(columns[0]), 50_000):
            yield pa.record_batch([pa.array(c[start : start + 50_000]) for c in columns], names=["head", "tail", "said"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head, tail and said; returns id, n_near and near, the least id it meets at a pair.

    The words of a pair differ in one character, so there are no more than the alphabet has.
    """

    def judged(head, tail, said) -> pa.RecordBatch | None:
        firsts = np.flatnonzero(np.concatenate([[True], (np.diff(head) != 0) | (np.diff(tail) != 0)]))
        size = np.diff(firsts, append=len(head))
        keep = np.repeat(size > 1, size)
        said, size = said[keep], size[size > 1]
        if not len(said):
            return None
        firsts = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        ids, kind = said >> 2, said & 3
        gap, canonical = kind == 0, kind == 1
        skip = ~gap

        def least(mask):
            return np.minimum.reduceat(np.where(mask, ids, _NONE), firsts)

        one = least(skip)
        two = least(skip & (ids != one[of]))
        shorter, longer = least(gap), least(canonical)
        n_skip, n_longer = np.add.reduceat(skip.astype(int), firsts), np.add.reduceat(canonical.astype(int), firsts)
        has = canonical & (shorter[of] != _NONE)
        n = np.where(gap, n_longer[of], n_skip[of] - 1 + has)
        other = np.where(ids == one[of], two[of], one[of])
        near = np.where(gap, longer[of], np.where(has, np.minimum(other, shorter[of]), other))
        some = n > 0
        return pa.record_batch(
            [pa.array(ids[some]), pa.array(n[some]), pa.array(near[some])], names=["id", "n_near", "near"]
        )

    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("head", "tail", "said"))]
        if not len(rows[0]):
            continue
        # The last pair may go on in the next batch.
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = [r[end:] for r in rows]
        if end and (found := judged(*[r[:end] for r in rows])) is not None:
            yield found
    if len(rest[0]) and (found := judged(*rest)) is not None:
        yield found


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near (words one edit away) and near (the least of their ids) of the words (id, word) that have any."""
    forward = _numbered(words.select("id", "word"), "word", "heads")
    heads = _aliases(forward, "word", "heads")
    both = _numbered(forward.withColumn("turned", F.reverse("word")), "turned", "tails")
    tails = _aliases(both, "turned", "tails")
    pairs = both.select("id", "word", "heads", "tails").mapInArrow(
        lambda b: _pairs(b, heads, tails), "head long, tail long, said long"
    )
    together = pairs.repartition("head", "tail").sortWithinPartitions("head", "tail", "said")
    met = together.mapInArrow(_met, "id long, n_near long, near long")
    return met.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def _roots(steps: DataFrame) -> DataFrame:
    """id, root of the rows (id, to): each round doubles the steps gone, until all ends are reached."""
    steps = cut(steps.select("id", F.col("to").alias("root")))
    while True:
        further = steps.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        gone = cut(steps.join(further, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("went")))
        if gone.where("went").isEmpty():
            return gone.drop("went")
        steps = gone.drop("went")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``counts`` (word, n; distinct words).

    A word's form is the near word (one edit away) with most occurrences, the first by code point
    among equals, if it has at least ``ratio`` (more than 1) times as many; its root is what following forms ends
    at. An empty table gives no rows; other columns are ignored. Null words are dropped.
    """
    # Ids rise as occurrences fall, then by word: the least id of some words is the one wanted.
    rows = counts.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    ordered = rows.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    words = cut(ordered)
    near = near_words(words)

    def named(prefix: str, id_column: str) -> list[Column]:
        return [F.col("id").alias(id_column), F.col("word").alias(prefix), F.col("n").alias(f"{prefix}_n")]

    found = words.join(near, "id", "left").join(words.select(*named("form", "near")), "near", "left")
    close = F.col("form_n") >= ratio * F.col("n")
    found = cut(found.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, F.col("near")).alias("to"), F.when(close, F.col("form")).alias("form"), F.when(close, F.col("form_n")).alias("form_n"),
    ))
    ends = _roots(found.where("to is not null").select("id", "to"))
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return found.join(ends, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
