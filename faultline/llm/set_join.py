"""Exact similarity join of documents by their word shingles: a size-aware heavy-light join.

Two documents link when the Jaccard similarity of their sets is 0.8 or more. Sets are
ordered from rare to frequent shingles, by a sketch of counts over all documents; linked
sets must meet in the rarest fifth. A light (small) set enumerates the pairs of shingles
of its slightly longer prefix and meets light sets there; a heavy one meets all sets in the
inverted lists of its single prefix shingles. Sets near the boundary do both. The
boundary is where enumerating costs as much as scanning.

Equal sets are one node, so copies never meet each other. In every list all nodes are first
compared with one pivot; only lists whose nodes are then in different components are compared
further, block against block, and only across components. So no link between components
is lost and a large group of near copies costs about one comparison per member. A list that may
be long by the sketch is dealt over tasks until its pivot is known.

Before texts travel, candidates are told apart by a signature of each set, the parities of
its hashes' low bits in one to two bits a shingle: two sets differ in at least as many
shingles as their signatures in bits, so what this leaves out can't link.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm.components import components
from faultline.llm.shared import free_names, slices
from faultline.session import cut

SHINGLE = 5
SKETCH_BITS = 20
SKETCH_PARTS = 16
BLOCK = 128
MOST_LIGHT = 60
# Entries of an inverted list, by the sketch, for each part of it that a task may hold.
HOT_LIST = 1 << 20
# Words of 64 bits in the bitmap of the documents whose texts are compared.
WANTED_WORDS = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SHIFT = np.uint64(64 - SKETCH_BITS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles, or of a shorter text's whole word sequence."""
    of_text = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not of_text:
        return np.zeros(0, np.uint64)
    if len(of_text) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(of_text), seed=len(of_text))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, of_text), np.uint64, len(of_text))
    n = len(hashed) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ hashed[i : i + n]) * _ODD[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(found: np.ndarray) -> int:
    """64-bit digest of a set, as a signed long."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    return 100 * common >= 80 * (n + m - common)


def signature(found: np.ndarray) -> bytes:
    """Parities of the set's hashes by their low bits: a power of two of 64 bits, one to two bits a shingle."""
    if not len(found):
        return b""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(sizes: np.ndarray, signatures: list[bytes], asked: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Whether each set may link, by size and signature, with one asked for, or be one that may, in another part.

    Linked sets differ in at most a ninth of the sum of their sizes, so one signature is at
    most twice as long as the other; its halves added bit by bit are the shorter one's kind.
    """
    words = np.array([len(s) // 8 for s in signatures])
    out = np.zeros(len(sizes), bool)
    for width in np.unique(words[words > 0]).tolist():
        at = np.flatnonzero((words == width) | (words == 2 * width))
        own, double = words[at] == width, words[at] == 2 * width
        held = np.zeros((len(at), width), np.uint64)
        held[own] = np.frombuffer(b"".join([signatures[k] for k in at[own]]), np.uint64).reshape(-1, width)
        longer = np.frombuffer(b"".join([signatures[k] for k in at[double]]), np.uint64).reshape(-1, 2, width)
        held[double] = longer[:, 0] ^ longer[:, 1]
        # Two of the longer kind meet at their own width.
        for k in np.flatnonzero(asked[at]).tolist():
            with_it = (own | own[k]) & (parts[at] != parts[at[k]])
            total = sizes[at] + sizes[at[k]]
            with_it &= 10 * np.minimum(sizes[at], sizes[at[k]]) >= 8 * np.maximum(sizes[at], sizes[at[k]])
            some = np.flatnonzero(with_it)
            apart = np.bitwise_count(held[some] ^ held[k]).sum(axis=1, dtype=np.int64)
            some = some[9 * apart <= total[some]]
            if len(some):
                out[at[some]] = out[at[k]] = True
    return out


def _summaries(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, hash, n, node, sig) and, per task, its shingle counts in parts (part, counts)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for piece in slices(batches):
            sets = [shingles(t) for t in piece.column("text").to_pylist()]
            counts += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=len(counts))
            no_part, no_counts = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.record_batch(
                [
                    piece.column("doc_id"), piece.column("hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([signature(s) for s in sets], pa.binary()), no_part, no_counts,
                ],
                names=["doc_id", "hash", "n", "node", "sig", "part", "counts"],
            )
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SKETCH_PARTS)]
        gap = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.record_batch(
            [
                gap, gap, gap, gap, pa.nulls(SKETCH_PARTS, pa.binary()),
                pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary()),
            ],
            names=["doc_id", "hash", "n", "node", "sig", "part", "counts"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(
        summarise, "doc_id bigint, hash bigint, n bigint, node bigint, sig binary, part int, counts binary"
    )


def _sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by the leading bits of their hash; of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for piece in slices(batches, 16):
            for part, raw in zip(piece.column("part").to_pylist(), piece.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())],
            names=["part", "counts"],
        )

    # Two rounds, so that no task adds up the sketches of all others.
    salted = rows.repartition(F.col("part"), F.col("salt")).select("part", "counts")
    first = salted.mapInArrow(add, "part int, counts binary")
    total = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in first.repartition("part").mapInArrow(add, "part int, counts binary").collect():
        total[r["part"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(total, np.iinfo(np.int32).max).ravel().astype(np.int32)


def prefix_length(n: int) -> int:
    """Shingles among which a linked set must share one, in any order common to all sets."""
    return n - -(-4 * n // 5) + 1


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size to enumerate: the cheapest sum of enumerated pairs and scanned list entries."""

    def cost(light: int) -> float:
        pairs = sum(c * math.comb(prefix_length(n) + 1, 2) for n, c in sizes.items() if n <= light)
        scans = sum(c * prefix_length(n) for n, c in sizes.items() if n >= 0.8 * light)
        return pairs + scans * (1 + list_length)

    return min(range(MOST_LIGHT + 1), key=lambda light: (cost(light), light))


def keys(found: np.ndarray, sketch: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """The list keys of a set and a bound of each list's length.

    Keys are pairs of prefix shingles, single ones, or both near the boundary. No list holds more
    sets than the sketch counts for any of its shingles.
    """
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    count = sketch[(found >> _SHIFT).astype(np.int64)]
    order = np.argsort(count, kind="stable")
    ordered, count = found[order], count[order]
    out, bounds = [], []
    if n <= light:
        longer = ordered[: prefix_length(n) + 1]
        i, j = np.triu_indices(len(longer), 1)
        low, high = np.minimum(longer[i], longer[j]), np.maximum(longer[i], longer[j])
        mixed = (low * _ODD[0]) ^ (high * _ODD[1])
        out.append((mixed ^ (mixed >> np.uint64(31))) * _ODD[2])
        bounds.append(np.minimum(count[i], count[j]))
    if n > light or n >= 0.8 * light:
        out.append(ordered[: prefix_length(n)])
        bounds.append(count[: prefix_length(n)])
    return np.concatenate(out), np.concatenate(bounds)


def _postings(docs: DataFrame, sketch: np.ndarray, light: int) -> DataFrame:
    """(key, salt, node, n) of every set; a task sends equal sets once.

    The nodes of a list that may be long are dealt over salts from 1; the salt of all others is 0.
    """
    hot, usual = HOT_LIST, float(sketch.mean())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in slices(batches):
            parts, salts, nodes, sizes = [], [], [], []
            for text in piece.column("text").to_pylist():
                found = shingles(text)
                node = node_of(found)
                if len(found) and node not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(node)
                    listed, bounds = keys(found, sketch, light)
                    # A cell at the mean holds many short lists, whatever the size of the corpus.
                    shares = np.maximum((bounds - usual) // hot, 0).astype(np.int64) + 1
                    parts.append(listed)
                    salts.append(np.where(shares > 1, node % shares + 1, 0).astype(np.int32))
                    nodes.append(node)
                    sizes.append(len(found))
            if parts:
                times = [len(p) for p in parts]
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(parts).view(np.int64)),
                        pa.array(np.concatenate(salts)),
                        pa.array(np.repeat(np.array(nodes, np.int64), times)),
                        pa.array(np.repeat(np.array(sizes, np.int32), times)),
                    ],
                    names=["key", "salt", "node", "n"],
                )

    return docs.select("text").mapInArrow(post, "key bigint, salt int, node bigint, n int")


def _lists(postings: DataFrame) -> DataFrame:
    """key, size_class, node, n, pivot, pivot_n, members of the lists that different nodes share.

    A set stands in its size class and the next, so linked sets meet. Postings travel once; the
    windows keep the partitions of the keys. The parts of a dealt list are added up by
    aggregates that reduce in every task, and joined back.
    """
    classes = F.floor(F.log(F.col("n")) / math.log(1.25) + 1e-9).cast("int")
    together = postings.repartition("key", "salt")
    listed = Window.partitionBy("key", "salt")
    shared = together.withColumn("_a", F.min("node").over(listed)).withColumn("_b", F.max("node").over(listed))
    # Nodes of a part that holds no other may meet those of other parts.
    shared = shared.where("_a != _b or salt > 0")
    shared = shared.select("key", "salt", "node", "n", F.explode(F.array(classes, classes + 1)).alias("size_class"))
    part = Window.partitionBy("key", "salt", "size_class")
    held = (
        shared.withColumn("_p", F.min(F.struct("node", "n")).over(part))
        .withColumn("_last", F.max("node").over(part))
        .withColumn("members", F.count(F.lit(1)).over(part))
        .where("salt > 0 or _p.node != _last")
        .select("key", "salt", "size_class", "node", "n", F.col("_p.node").alias("pivot"), F.col("_p.n").alias("pivot_n"), "members")
    )
    held = cut(held)
    single = held.where("salt = 0").drop("salt")
    dealt = held.where("salt > 0").select("key", "size_class", "node", "n")
    whole = dealt.groupBy("key", "size_class").agg(
        F.min(F.struct("node", "n")).alias("_p"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("members")
    )
    whole = whole.where("_p.node != _last").select(
        "key", "size_class", F.col("_p.node").alias("pivot"), F.col("_p.n").alias("pivot_n"), "members"
    )
    return single.unionByName(dealt.join(whole, ["key", "size_class"]))


def _sift(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows that may link with another of their group: those _compare needs the texts of.

    Rows have node, component, pivot (boolean), n and sig; n and sig are left out.
    """
    shown = [*by, "node", "component", "pivot"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(group: list[tuple]) -> pa.RecordBatch:
            sizes, pivot = np.array([g[-2] for g in group]), np.array([g[-3] for g in group])
            if pivot.any():
                asked, parts = pivot, np.array([g[-5] for g in group])
            else:
                asked, parts = ~pivot, np.array([g[-4] for g in group])
            if (parts == parts[0]).all():
                return pa.RecordBatch.from_pylist([], schema=schema)
            kept = np.flatnonzero(may_link(sizes, [g[-1] for g in group], asked, parts)).tolist()
            columns = list(zip(*[group[k][:-2] for k in kept])) or [()] * len(shown)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        current, group = None, []
        for piece in slices(batches, 1024):
            schema = pa.schema([piece.schema.field(c) for c in shown])
            for row in zip(*(piece.column(c).to_pylist() for c in (*shown, "n", "sig"))):
                if row[: len(by)] != current and group:
                    yield send(group)
                    group = []
                current = row[: len(by)]
                group.append(row)
        if group:
            yield send(group)

    kinds = ", ".join(f"{c} {k}" for c, k in rows.select(*shown).dtypes)
    together = rows.repartition(*by).sortWithinPartitions(*by)
    return together.select(*shown, "n", "sig").mapInArrow(sift, kinds)


def _compare(rows: DataFrame, by: list[str]) -> DataFrame:
    """Links (a, b) among the rows of each group: pivots with all others, else across components.

    Rows have node, component, pivot (boolean) and text. Groups hold a block or two.
    """

    def pairs(group: list[tuple]) -> list[tuple[int, int]]:
        group = list({node: (node, part, pivot, found) for node, part, pivot, found in group}.values())
        out = []
        # A spanning forest of what the components do not join already is enough.
        parent = {g[1]: g[1] for g in group}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        some = any(pivot for _, _, pivot, _ in group)
        sizes = np.array([len(g[3]) for g in group])
        flat = np.concatenate([g[3] for g in group])
        owner = np.repeat(np.arange(len(group)), sizes)
        parts = np.array([g[1] for g in group])
        if len(group) > 1 and not some and (parts == parts[0]).all():
            return out
        for i, (node, part, pivot, found) in enumerate(group):
            if (some and not pivot) or not len(found):
                continue
            at = np.minimum(np.searchsorted(found, flat), len(found) - 1)
            common = np.bincount(owner[found[at] == flat], minlength=len(group))
            ok = linked(common, sizes, len(found)) & (parts != part if not some else np.arange(len(group)) != i)
            for j in np.flatnonzero(ok).tolist():
                a, b = root(part), root(group[j][1])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((node, group[j][0]))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(group: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*found) if (found := pairs(group)) else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        current, group = None, []
        for piece in slices(batches, 64):
            names = zip(*(piece.column(c).to_pylist() for c in by))
            rows = zip(*(piece.column(c).to_pylist() for c in ("node", "component", "pivot", "text")))
            for name, (node, part, pivot, text) in zip(names, rows):
                if name != current and group:
                    yield send(group)
                    group = []
                current = name
                group.append((node, part, pivot, shingles(text)))
        if group:
            yield send(group)

    together = rows.repartition(*by).sortWithinPartitions(*by)
    return together.select(*by, "node", "component", "pivot", "text").mapInArrow(compare, "a bigint, b bigint")


def _texts(docs: DataFrame, rows: DataFrame, needed: DataFrame) -> DataFrame:
    """node and the text of one document of each needed node.

    Before the texts travel, a bitmap of fixed size of the documents wanted leaves out most others; with
    very many wanted it leaves out less, and the join decides alone.
    """
    id = F.coalesce("doc_id", F.lit(-(2**63)))
    place = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(id.alias("id"), "hash")).alias("p"))
    place = cut(place.join(needed, "node").select("node", F.col("p.id").alias("_id"), F.col("p.hash").alias("_hash")))
    spot = F.pmod(F.xxhash64("_id", "_hash"), F.lit(WANTED_WORDS * 64))
    word = F.floor(spot / 64).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))
    wanted = place.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_hash"), "text"
    )
    # At most WANTED_WORDS rows of two longs.
    near = named.withColumn("_word", word).join(F.broadcast(wanted), "_word")
    near = near.where(F.col("_bits").bitwiseAND(bit) != 0).select("_id", "_hash", "text")
    # Repeated rows hold the same text; one of them is enough.
    return place.join(near, ["_id", "_hash"]).groupBy("_id", "_hash", "node").agg(F.any_value("text").alias("text")).select(
        "node", "text"
    )


def similar_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n, node) of every row, and (node, component) of the nodes with links.

    Texts without words and null texts have n = 0 and node of the empty set, which links
    with nothing. Rows of one set are one node, whatever their ids.
    """
    every = cut(_summaries(docs).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))))
    rows = every.where("part is null").select("doc_id", "hash", "n", "node")
    sketch = _sketch(every.where("part is not null"))
    small = rows.where(f"n between 1 and {2 * MOST_LIGHT}").groupBy("n").count().collect()
    taken = float((sketch > 0).mean())
    distinct = -len(sketch) * math.log1p(-min(taken, 1 - 1e-9))
    light = boundary({r["n"]: r["count"] for r in small}, float(sketch.sum()) / max(distinct, 1.0))

    held = _lists(_postings(docs, sketch, light))

    # Sets of too different sizes can't link, whatever they share.
    fits = 10 * F.least("n", "pivot_n") >= 8 * F.greatest("n", "pivot_n")
    stars = cut(held.where(F.col("node") != F.col("pivot")).where(fits).select("pivot", "node").distinct())
    needed = held.where("members > 2").select("node").union(stars.select("node")).union(stars.select("pivot")).distinct()
    sigs = every.where("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    sigs = cut(sigs.join(needed, "node"))

    block = F.pmod(F.xxhash64("node", "pivot"), F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)))
    counts = stars.groupBy("pivot").agg(F.count(F.lit(1)).alias("count"))
    dealt = stars.join(counts, "pivot").withColumn("block", block.cast("int")).select("pivot", "block", "node")
    dealt = dealt.select("pivot", "block", "node", F.lit(False).alias("is_pivot")).union(
        dealt.select("pivot", "block", F.col("pivot").alias("node"), F.lit(True)).distinct()
    )
    dealt = dealt.select(
        F.col("pivot").alias("group"), "block", "node", F.col("node").alias("component"), F.col("is_pivot").alias("pivot")
    )
    near = cut(_sift(dealt.join(sigs, "node"), ["group", "block"]))
    texts = _texts(docs, rows, near.select("node").distinct())
    first = _compare(near.join(texts, "node"), ["group", "block"])
    links = cut(first)
    known = cut(components(links))

    # Lists with nodes of different components: blocks of them against each other.
    # Two nodes of which one is the pivot were compared with it; only lists of three or more can be open.
    named = held.where("members > 2").join(known, "node", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "node")))
    open_lists = named.groupBy("key", "size_class").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b")
    ).where("_a != _b").select("key", "size_class")
    left = named.join(open_lists, ["key", "size_class"])
    # Lists of one pivot and about one length hold much the same nodes: their union is what is cut into blocks.
    length = F.ceil(F.log2(F.greatest(F.col("members") / BLOCK, F.lit(1.0)))).cast("int")
    left = cut(left.select("pivot", "node", "component", length.alias("length")).distinct())
    blocks = left.groupBy("pivot", "length").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    left = left.join(blocks, ["pivot", "length"])
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select(
        "pivot", "length", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "node", "component",
    )
    left = left.withColumnRenamed("pivot", "group").withColumn("pivot", F.lit(False))
    near = cut(_sift(left.join(sigs, "node"), ["group", "length", "i", "j"]))
    texts = _texts(docs, rows, near.select("node").distinct())
    second = _compare(near.join(texts, "node"), ["group", "length", "i", "j"])
    return rows, cut(components(links.union(second)))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the least doc_id reachable by links; equal sets are linked. Null and
    wordless texts have no shingles and are alone. Null ids belong to their set's
    component, which is null only if none of its rows has an id. An empty table gives no rows.
    """
    rows, parts = similar_nodes(docs)
    rows = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("_least"))
    rows = rows.join(least, "component", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the least id of each.

    Of repeated rows one stays; null and wordless texts and rows without an id stay as they are.
    An empty table gives no rows; other columns may have any name.
    """
    rows, parts = similar_nodes(docs)
    rows = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = rows.where("n > 0 and doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("p"))
    own_hash, alone, least, least_hash = free_names(docs, "_hash", "_alone", "_least", "_least_hash")
    kept = kept.select(F.col("p.doc_id").alias(least), F.col("p.hash").alias(least_hash))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.withColumns({own_hash: F.xxhash64("text"), alone: F.col("doc_id").isNull() | wordless})
    same = (F.col("doc_id") == F.col(least)) & (F.col(own_hash) == F.col(least_hash))
    joined = named.join(kept, same, "left")
    single = joined.where(F.col(alone)).select(*docs.columns)
    chosen = joined.where(~F.col(alone) & F.col(least).isNotNull()).dropDuplicates(["doc_id", own_hash])
    return single.unionAll(chosen.select(*docs.columns))
