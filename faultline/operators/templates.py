"""Template mining with a fixed-depth search tree (Drain, He et al. 2017).

A line is compared only with the groups of its leaf (token count, first tokens),
so leaves are independent and each is an ordered replay by line_id. The emitted
template is the group's template as of that line.

Two exact ways are used, by the size of the leaf:

* A leaf of at most ``hot_rows`` rows is replayed in line order by one task, as a
  stream over sorted Arrow batches.
* A larger leaf is never sent to one task. Almost every line leaves the state of
  its leaf unchanged; only the few lines that open a group or generalise a
  template matter. A small set of candidate lines is replayed into a history of
  state changes. An as-of join, bucketed by leaf and range of lines, tells every
  line how many changes lie before it: its version. Equal texts of one version
  have one answer, so lines are reduced to the first of each (leaf, version,
  text); those are dealt out by blocks of versions, each with the state at the
  start of its block and the changes within. First lines that would have changed
  the state join the candidates. When there are none, the history is the true
  one and the answers go back to the lines, again by ranges of lines, so that no
  key holds more of them than a range. Each round is exact up to the earliest
  new candidate of a leaf, so the loop ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from faultline import fixed
from faultline.functions.levels import level_anywhere
from faultline.functions.text import is_blank, leaf_key, masked_line
from faultline.operators.trend import with_position
from faultline.session import cut

HOT_ROWS = 1_000_000
SLOTS = 256
HISTORY_BYTES = 64 * 1024 * 1024
BUCKET_LINES = 65_536
TASK_ROWS = 50_000
WILDCARD = "<*>"
_BLANK = "blank "
_CHANGE = (
    "leaf long, line long, ordinal long, group_index int, template string, group_line long, until long, span long"
)


class _Leaf:
    """Groups of one leaf; a change is (line, group index, template words)."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.clear()

    def clear(self):
        self.words: list[list[str]] = []
        self.lines: list[int] = []
        self.holders: dict[tuple[int, str], list[int]] = {}
        self.memo: dict[str, tuple[int, list[str], bool]] = {}

    def look(self, text: str) -> tuple[int, list[str], bool]:
        """Group index, template after the line, and whether the state would change."""
        known = self.memo.get(text)
        if known is None:
            known = self.memo[text] = self._search(text.split(" "))
        return known

    def _search(self, words: list[str]) -> tuple[int, list[str], bool]:
        equal: dict[int, int] = {}
        for place in enumerate(words):
            for index in self.holders.get(place, ()):
                equal[index] = equal.get(index, 0) + 1
        if equal:
            index = min(equal, key=lambda i: (-equal[i], i))
            if equal[index] / len(words) >= self.threshold:
                mine = self.words[index]
                merged = [a if a == b else WILDCARD for a, b in zip(mine, words)]
                return index, merged, merged != mine
        return len(self.words), words, True

    def change(self, line: int, index: int, words: list[str]):
        if index == len(self.words):
            self.words.append(words)
            self.lines.append(line)
            for place in enumerate(words):
                self.holders.setdefault(place, []).append(index)
        else:
            for place, (old, new) in enumerate(zip(self.words[index], words)):
                if old != new:
                    self.holders[(place, old)].remove(index)
                    self.holders.setdefault((place, new), []).append(index)
            self.words[index] = words
        self.memo.clear()

    def line_of(self, index: int, line: int) -> int:
        return self.lines[index] if index < len(self.lines) else line


def _prepare(logs: DataFrame, text: str, max_chars: int | None) -> DataFrame:
    blank = F.col(text).isNull() | is_blank(F.col(text))
    masked = F.when(blank, F.lit(None)).otherwise(masked_line(F.col(text), max_chars))
    # Blank lines belong to no leaf; they are spread over many keys.
    spread = F.concat(F.lit(_BLANK), F.pmod(F.xxhash64("line_id"), F.lit(4096)).cast("string"))
    rows = logs.withColumn("_masked", masked)
    return rows.withColumn("_leaf", F.coalesce(F.when(F.col("_masked").isNotNull(), leaf_key(F.col("_masked"))), spread))


def _with_result(schema: T.StructType) -> T.StructType:
    return T.StructType(
        schema.fields
        + [T.StructField("group_line", T.LongType()), T.StructField("event_template", T.StringType())]
    )


def _append(batch: pa.RecordBatch, lines: list, templates: list) -> pa.RecordBatch:
    columns = list(batch.columns) + [pa.array(lines, pa.int64()), pa.array(templates, pa.string())]
    return pa.RecordBatch.from_arrays(
        columns, names=[*batch.schema.names, "group_line", "event_template"]
    )


def _replay_cold(rows: DataFrame, source: str, threshold: float) -> DataFrame:
    def replay(batches):
        current, leaf = None, _Leaf(threshold)
        for batch in batches:
            lines, templates = [], []
            for src, key, line, text in zip(
                batch.column(source).to_pylist(),
                batch.column("_leaf").to_pylist(),
                batch.column("line_id").to_pylist(),
                batch.column("_masked").to_pylist(),
            ):
                if text is None:
                    lines.append(None)
                    templates.append(fixed.EMPTY_TEMPLATE)
                    continue
                if (src, key) != current:
                    current, leaf = (src, key), _Leaf(threshold)
                index, words, changed = leaf.look(text)
                if changed:
                    leaf.change(line, index, words)
                lines.append(leaf.lines[index])
                templates.append(" ".join(words))
            yield _append(batch, lines, templates)

    ordered = rows.repartition(F.col(source), F.col("_leaf")).sortWithinPartitions(
        source, "_leaf", "line_id"
    )
    return ordered.mapInArrow(replay, _with_result(rows.schema))


def _simulate(candidates: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Replay the candidate lines of each leaf and keep the state changes, numbered from 1.

    ``until`` is the next change of the same group. ``span`` is the number of versions in a
    block: as many as the leaf has groups, or as ``limit`` bytes of changes hold if that is more.
    """
    import pandas as pd

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("line").sort_values("line")
        leaf, out = _Leaf(threshold), []
        for line, text in zip(pdf["line"].tolist(), pdf["text"].tolist()):
            index, words, changed = leaf.look(text)
            if changed:
                leaf.change(line, index, words)
                out.append((line, len(out) + 1, index, " ".join(words), leaf.lines[index]))
        found = pd.DataFrame(out, columns=["line", "ordinal", "group_index", "template", "group_line"])
        found.insert(0, "leaf", pdf["leaf"].iloc[0])
        found["until"] = found.groupby("group_index")["ordinal"].shift(-1).fillna(len(out) + 1).astype("int64")
        mean = max(1, int(found["template"].str.len().mean()))
        found["span"] = max(len(leaf.words), limit // mean, 1)
        return found

    return candidates.groupBy("leaf").applyInPandas(play, _CHANGE)


def _first_per_slot(rows: DataFrame, *extra: str) -> DataFrame:
    slot = F.pmod(F.xxhash64("text"), F.lit(SLOTS)).alias("_slot")
    first = F.min(F.struct("line", "text")).alias("first")
    return rows.groupBy("leaf", *extra, slot).agg(first).select("leaf", "first.*")


def _bucket(line: str) -> Column:
    return F.floor(F.col(line) / BUCKET_LINES).alias("bucket")


def _versions(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """leaf, bucket, line, key of every line with ``version``, the changes of its leaf on earlier lines.

    An as-of join: lines and changes meet by leaf and range of lines, sorted by line, and what
    lies before a range comes from the sums over the ranges.
    """
    told = changes.select("leaf", _bucket("line"), "line", F.lit(None).cast("binary").alias("key"), F.lit(1).alias("change"))
    both = lines.select("leaf", "bucket", "line", "key", F.lit(0).alias("change")).unionByName(told)
    earlier = W.partitionBy("leaf").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = both.groupBy("leaf", "bucket").agg(F.sum("change").alias("n")).select(
        "leaf", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    # A line stands before the change that it makes itself.
    inside = W.partitionBy("leaf", "bucket").orderBy("line", "change").rowsBetween(W.unboundedPreceding, 0)
    counted = both.withColumn("inside", F.sum("change").over(inside)).where("change = 0")
    return counted.join(base, ["leaf", "bucket"]).select(
        "leaf", "bucket", "line", "key", (F.col("base") + F.col("inside")).alias("version")
    )


def _states(changes: DataFrame) -> DataFrame:
    """What a block of versions needs: the groups as of its first version (start) and the changes within it."""
    o, u, k = F.col("ordinal"), F.col("until"), F.col("span")
    first, last = F.ceil(o / k), F.ceil(u / k) - 1
    # A group's last template stays to the last block; ``until`` is one past the last change then.
    at_start = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    starts = F.transform(at_start, lambda b: F.struct(b.alias("block"), F.lit(True).alias("start")))
    inside = F.when(o % k != 0, F.array(F.struct(F.floor(o / k).alias("block"), F.lit(False).alias("start"))))
    blocks = F.concat(starts, F.coalesce(inside, F.array().cast("array<struct<block:bigint,start:boolean>>")))
    return changes.withColumn("b", F.explode(blocks)).select(
        "leaf", "b.block", "b.start", "ordinal", "group_index", "template", "group_line"
    )


def _answers(firsts: DataFrame, changes: DataFrame, threshold: float) -> DataFrame:
    """Group line and template of every first line, and whether it would change the state unforeseen (fresh).

    ``firsts`` has leaf, version, key, line, text. A task gets one block of versions, or a share
    of it by text where the block has more than ``TASK_ROWS`` first lines.
    """
    import pandas as pd

    spans = changes.groupBy("leaf").agg(F.max("span").alias("span"))
    own = changes.select("leaf", "line", F.lit(True).alias("own"))
    rows = firsts.join(spans, "leaf").withColumn("block", F.floor(F.col("version") / F.col("span")))
    rows = rows.drop("span").join(own, ["leaf", "line"], "left")
    slots = rows.groupBy("leaf", "block").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("slots"))
    mine = rows.join(slots, ["leaf", "block"]).withColumn("slot", F.pmod(F.xxhash64("key"), F.col("slots")))
    known = _states(changes).join(slots, ["leaf", "block"])
    known = known.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))

    def answer(key, state: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        state = state.sort_values(["start", "ordinal"], ascending=[False, True])
        leaf, out = _Leaf(threshold), []
        # Groups of the start are put in by their number, whatever the order of their last changes.
        begin = state[state["start"]].sort_values("group_index")
        for index, template, line in zip(begin["group_index"], begin["template"], begin["group_line"]):
            leaf.change(int(line), int(index), template.split(" "))
        later = state[~state["start"]].drop_duplicates("ordinal")
        steps = list(zip(later["ordinal"], later["group_index"], later["template"], later["group_line"]))
        at = 0
        asked = asked.sort_values("version")
        for version, line, text, is_own in zip(asked["version"], asked["line"], asked["text"], asked["own"]):
            while at < len(steps) and steps[at][0] <= version:
                leaf.change(int(steps[at][3]), int(steps[at][1]), steps[at][2].split(" "))
                at += 1
            index, words, changed = leaf.look(text)
            out.append((leaf.line_of(index, line), " ".join(words), changed and is_own is not True))
        found = asked[["leaf", "version", "key", "line", "text"]].copy()
        found[["group_line", "template", "fresh"]] = pd.DataFrame(out, index=found.index, columns=["a", "b", "c"])
        return found

    schema = "leaf long, version long, key binary, line long, text string, group_line long, template string, fresh boolean"
    by = ["leaf", "block", "slot"]
    return known.groupBy(*by).cogroup(mine.drop("slots").groupBy(*by)).applyInPandas(answer, schema)


def _label_hot(rows: DataFrame, source: str, threshold: float, limit: int) -> DataFrame:
    """(source, line_id, group_line, event_template) of the lines of hot leaves, which have a ``_number``."""
    lines = cut(rows.select(
        F.col("_number").alias("leaf"), _bucket("line_id"), F.col("line_id").alias("line"),
        F.col("_masked").alias("text"), F.unhex(F.md5("_masked")).alias("key"), F.col(source).alias("source"),
    ))
    texts = cut(lines.groupBy("leaf", "key").agg(F.min("text").alias("text")))
    candidates = cut(_first_per_slot(lines))
    while True:
        changes = cut(_simulate(candidates, threshold, limit))
        versions = cut(_versions(lines, changes))
        firsts = versions.groupBy("leaf", "version", "key").agg(F.min("line").alias("line"))
        answers = cut(_answers(firsts.join(texts, ["leaf", "key"]), changes, threshold))
        fresh = answers.where("fresh")
        if fresh.isEmpty():
            break
        candidates = candidates.unionByName(cut(_first_per_slot(fresh, "version")))
    # Every range of lines gets its own copy of an answer, as one text may be on most lines.
    by = ["leaf", "version", "key"]
    near = versions.select("bucket", *by).distinct().join(answers.select(*by, "group_line", "template"), by)
    told = versions.join(near, ["bucket", *by]).select("leaf", "line", "group_line", F.col("template").alias("event_template"))
    # Leaves of one source share no lines, and a line id is unique within its source.
    places = lines.select("leaf", "line", F.col("source").alias(source))
    return told.join(places, ["leaf", "line"]).select(source, F.col("line").alias("line_id"), "group_line", "event_template")


def mine_templates(
    logs: DataFrame,
    text: str = "clean_log",
    source: str = "log_source",
    threshold: float = 0.5,
    hot_rows: int = HOT_ROWS,
    history_bytes: int = HISTORY_BYTES,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``event_template``, ``level`` and ``event_id`` to every row.

    Event ids count groups per source in order of their first line; blank lines
    take id 0. Line ids must be unique within a source. ``max_chars`` cuts longer
    lines and marks them so; by default lines are read whole. ``history_bytes``
    bounds the state changes that go to one task beyond a leaf's groups. The result is a
    checkpointed table, as everything downstream reads it several times.
    """
    # Masks cost more than all else here. They are written once, as the plan would work them out anew
    # for each use, and several times where a join asks that the leaf is not null.
    rows = cut(_prepare(logs.drop("event_template", "event_id", "level"), text, max_chars))
    hot = cut(
        rows.groupBy(source, "_leaf")
        .agg(F.count("_masked").alias("n"))
        .where(F.col("n") > hot_rows)
        .select(source, "_leaf", F.monotonically_increasing_id().alias("_number"))
    )
    n_hot = hot.count()
    if n_hot == 0:
        mined = _replay_cold(rows, source, threshold)
    else:
        # At most rows / hot_rows keys; small enough lists spare the shuffle.
        keys = F.broadcast(hot) if n_hot <= 50_000 else hot
        hot_side = rows.join(keys, [source, "_leaf"])
        cold_side = rows.join(keys, [source, "_leaf"], "left_anti")
        told = _label_hot(hot_side, source, threshold, history_bytes)
        hot_rows_told = hot_side.drop("_number").join(told, [source, "line_id"])
        mined = _replay_cold(cold_side, source, threshold).unionByName(hot_rows_told)
    mined = cut(mined.drop("_masked", "_leaf"))

    # The line that opened a group is the group's own line, so no distinct is needed.
    openers = mined.where(F.col("line_id") == F.col("group_line")).select(source, "line_id")
    numbers = with_position(openers.withColumn("_one", F.lit(1)), [source], "_one").select(
        F.col(source), F.col("line_id").alias("group_line"), F.col("pos").alias("event_id")
    )
    return (
        mined.join(numbers, [source, "group_line"], "left")
        .withColumn("event_id", F.coalesce(F.col("event_id"), F.lit(0)).cast("long"))
        .withColumn("level", level_anywhere(F.coalesce(F.col(text), F.lit(""))))
        .drop("group_line")
    )
