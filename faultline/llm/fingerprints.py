"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A fingerprint has 30 cells; each distinct paragraph adds its digest to three of them
(count, xor of digests, xor of checks). Subtracting two fingerprints leaves the
paragraphs that differ, and peeling takes them out of cells that hold just one. Where
too many differ to be peeled, the pair is sketched again, larger: digests are spread
over more cells. Only DataFrame functions are used. Cells are rows that are summed by key in
the partition where neighbouring texts met, so texts are shuffled once and cells not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import cut

WIDTH = 10
CELLS = 3 * WIDTH
ROUNDS = 7
# The blocks of larger sketches are narrower, for so many digests each.
BLOCK_WIDTH = 6
LOAD = 4
# A larger sketch has three segments, each of twice as many cells as both versions have
# digests, but at least LEAST; its segments are peeled in turn, PEELS times.
LEAST = 64
PEELS = 6
SEGMENTS = 64
# Blocks of a segment of ids, by the bytes of the texts, and those that one task may hold.
PARTS = (16, 4096)
TASK_BYTES = 1 << 20
# A line, cut after the first end of a sentence behind every 160 characters.
PARAGRAPH = r"[^\n]{160,}?[.!?](?=\s|$)|[^\n]+"
# A piece of a line of at most 12 words, to the end of a sentence. Every 8 characters of a
# longer word count as one, so a piece is short in text without blanks too.
BOUNDED = r"\S{1,8}+(?:(?<![.!?。！？])[^\S\n]*+\S{1,8}+){0,11}+"


def digests(text: Column, paragraph: str = PARAGRAPH) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(paragraph), F.lit(0)), lambda p: F.xxhash64(p))
    )


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(digest: Column, salt: Column, width: int) -> list[Column]:
    return [
        (F.pmod(F.xxhash64(digest, salt, F.lit(i)), F.lit(width)) + i * width).cast("int") for i in range(3)
    ]


def _placed(found: Column, salt: Column, sign: int, width: int, blocks: Column | None = None) -> Column:
    """Digests with their sign, check, three places and, if there are some, their block."""

    def one(d: Column) -> Column:
        p, q, r = _places(d, salt, width)
        fields = [d.alias("d"), F.lit(sign).alias("s"), _check(d).alias("k"), p.alias("p"), q.alias("q"), r.alias("r")]
        if blocks is not None:
            fields.append(F.pmod(F.xxhash64(d, F.lit("block"), salt), blocks).cast("int").alias("b"))
        return F.struct(*fields)

    return F.transform(found, one)


def _cells(placed: Column, width: int) -> Column:
    """All cells, in their order, of an array of placed digests."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))

    def third(field: str, first: int) -> Column:
        def cell(i: Column) -> Column:
            def add(a: Column, e: Column) -> Column:
                more = F.struct(
                    (a["n"] + e["s"]).alias("n"), a["x"].bitwiseXOR(e["d"]).alias("x"), a["c"].bitwiseXOR(e["k"]).alias("c")
                )
                return F.when(e[field] == i, more).otherwise(a)

            def named(t: Column) -> Column:
                return F.struct(i.alias("i"), t["n"].alias("n"), t["x"].alias("x"), t["c"].alias("c"))

            return F.aggregate(placed, start, add, named)

        return F.transform(F.array(*[F.lit(first + k) for k in range(width)]), cell)

    return F.concat(third("p", 0), third("q", width), third("r", 2 * width))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def peel(cells: Column, salt: Column, width: int = WIDTH) -> Column:
    """(cells left, found) of an array of cells, of which only those that are not empty are kept; found has (d, s): digest and side, +1 the first, -1 the second."""

    def pure(of: Column) -> Column:
        alone = F.filter(of, lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(c["x"].alias("d"), c["n"].alias("s"))))

    def placed(found: Column) -> Column:
        def one(p: Column) -> Column:
            a, b, c = _places(p["d"], salt, width)
            return F.struct(
                p["d"].alias("d"), p["s"].alias("s"), a.alias("p"), b.alias("q"), c.alias("r"), _check(p["d"]).alias("k")
            )

        return F.transform(found, one)

    def without(c: Column, p: Column) -> Column:
        here = (c["i"] == p["p"]) | (c["i"] == p["q"]) | (c["i"] == p["r"])
        left = F.struct(
            c["i"].alias("i"), (c["n"] - p["s"]).alias("n"), c["x"].bitwiseXOR(p["d"]).alias("x"),
            c["c"].bitwiseXOR(p["k"]).alias("c"),
        )
        return F.when(here, left).otherwise(c)

    def some(of: Column) -> Column:
        return F.filter(of, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))

    def step(state: Column, _: Column) -> Column:
        # Arrays of one bind what is used twice; pure cells are found once in a round, and
        # when a round finds none the rest have nothing to do.
        def taken(s: Column) -> Column:
            left = some(F.transform(s["cells"], lambda c: F.aggregate(s["pure"], c, without)))
            return F.struct(
                left.alias("cells"),
                F.concat(s["found"], F.transform(s["pure"], lambda p: F.struct(p["d"].alias("d"), p["s"].alias("s")))).alias("found"),
                F.lit(True).alias("on"),
            )

        def last(s: Column) -> Column:
            return F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("on"))

        def tried(s: Column) -> Column:
            held = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), placed(pure(s["cells"])).alias("pure"))
            return _bind(held, lambda h: F.when(F.size(h["pure"]) > 0, taken(h)).otherwise(last(h)))

        return F.when(state["on"] & (F.size(state["cells"]) > 0), tried(state)).otherwise(state)

    start = F.struct(
        some(cells).alias("cells"), F.array().cast("array<struct<d:bigint,s:int>>").alias("found"), F.lit(True).alias("on")
    )
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _clean(state: Column) -> Column:
    return F.size(state["cells"]) == 0


def as_text(cells: Column) -> Column:
    """A fingerprint's cells as hexadecimal text of fixed length."""
    return F.array_join(
        F.transform(
            cells,
            lambda c: F.concat(
                F.lpad(F.hex(c["n"].cast("long").bitwiseAND(F.lit(0xFFFFFF))), 6, "0"),
                F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0"),
            ),
        ),
        "",
    )


def _blocks(docs: DataFrame) -> tuple[Column, int]:
    """A block number rising with ``_id``, of about even blocks, and the number of tasks for them.

    Blocks are segments between percentiles, in equal parts.
    """
    steps = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    bounds, size = docs.agg(F.percentile_approx("_id", steps, 10000), F.sum(F.octet_length("_text"))).first()
    if not bounds:
        return F.lit(0), 1
    bounds = sorted(set(bounds))
    tasks = size // TASK_BYTES + 1
    parts = min(max(tasks * 4 // SEGMENTS, PARTS[0]), PARTS[1])

    def search(low: int, high: int) -> Column:
        if high - low <= 1:
            first, last = bounds[low], bounds[min(low + 1, len(bounds) - 1)]
            part = F.floor((F.col("_id") - F.lit(first)) / F.lit(float(max(last - first, 1))) * parts)
            return F.lit(low * parts) + F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))
        middle = (low + high) // 2
        return F.when(F.col("_id") < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle, high))

    return search(0, len(bounds)).cast("int"), min(tasks, SEGMENTS * parts)


def with_next(docs: DataFrame, paragraph: str = PARAGRAPH) -> DataFrame:
    """Every row with ``_block``, ``_text``, ``_own`` digests and those of the row after it, ``_next_text`` and ``_next``.

    Rows stand by doc_id, null first, and text digest; the first follows the last. Rows
    meet in blocks of neighbouring ids, at most 262,144; the first row of each block also
    goes to the block before. Texts are shuffled once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text.alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("_id"),
        F.xxhash64(text).alias("_hash"),
    )
    block, tasks = _blocks(rows)
    rows = rows.withColumn("_home", block)
    # At most one row for each block.
    heads = rows.groupBy("_home").agg(F.min(F.struct("_id", "_hash")).alias("head")).orderBy("_home").collect()
    if heads:
        goal = [(heads[i]["head"]["_id"], heads[i]["head"]["_hash"], heads[i - 1]["_home"]) for i in range(len(heads))]
        guards = docs.sparkSession.createDataFrame(goal, "_gi long, _gh long, _goal int")
        rows = rows.join(
            F.broadcast(guards), (F.col("_id") == F.col("_gi")) & (F.col("_hash") == F.col("_gh")), "left"
        ).drop("_gi", "_gh")
    else:
        rows = rows.withColumn("_goal", F.lit(None).cast("int"))
    own, guard = F.struct(F.col("_home").alias("b"), F.lit(False).alias("g")), F.struct(
        F.col("_goal").alias("b"), F.lit(True).alias("g")
    )
    sent = rows.withColumn("_own", digests(F.col("_text"), paragraph)).withColumn(
        "_to", F.explode(F.when(F.col("_goal").isNull(), F.array(own)).otherwise(F.array(own, guard)))
    )
    sent = sent.select("doc_id", "_text", "_own", "_id", "_hash", F.col("_to.b").alias("_block"), F.col("_to.g").alias("_guard"))
    order = Window.partitionBy("_block").orderBy("_guard", "_id", "_hash")
    sent = sent.repartition(tasks, "_block").withColumns(
        {"_next_text": F.lead("_text").over(order), "_next": F.lead("_own").over(order)}
    )
    # The last row of the table has the guard of the first behind it, so nothing is missing.
    return sent.where("not _guard").select("_block", "doc_id", "_text", "_own", "_next_text", "_next")


def edited_rows(docs: DataFrame, paragraph: str = PARAGRAPH) -> DataFrame:
    """Rows: _block, row, doc_id, n_chars, edited_sha256 and the digests own, edited and next."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next_text", F.lit(1), half)
    )
    rows = with_next(docs, paragraph).withColumn("n_chars", F.length("_text").cast("long")).withColumn("_edited", edited)
    return rows.select(
        "_block", F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("_own").alias("own"), digests(F.col("_edited"), paragraph).alias("edited"), F.col("_next").alias("next"),
    )


def sketch(found: Column) -> Column:
    """The fingerprint of an array of digests: its cells as an array in their order."""
    return _bind(_placed(found, F.lit(0), 1, WIDTH), lambda placed: _cells(placed, WIDTH))


def fingerprints(rows: DataFrame, roles: list[str]) -> DataFrame:
    """row and, for each role (a column of digests), its cells as an array in their order."""
    return rows.select("row", *[sketch(F.col(r)).alias(r) for r in roles])


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b,
        lambda x, y: F.struct(
            x["i"].alias("i"), (x["n"] - y["n"]).alias("n"), x["x"].bitwiseXOR(y["x"]).alias("x"),
            x["c"].bitwiseXOR(y["c"]).alias("c"),
        ),
    )


def _told(state: Column) -> Column:
    """(found, ok) of a peeled state."""
    return F.struct(state["found"].alias("found"), _clean(state).alias("ok"))


def subtracted(own: Column, other: Column) -> Column:
    """(found, ok): what peeling the difference of two fingerprints gives, and whether it gave all."""
    return _bind(peel(_minus(own, other), F.lit(0)), _told)


def attempt(prints: DataFrame, others: list[str], keep: list[str]) -> DataFrame:
    """row, the fingerprints to ``keep``, and for each other role what peeling its difference to ``own`` gives."""
    return prints.select("row", *keep, *[subtracted(F.col("own"), F.col(o)).alias(f"_{o}") for o in others])


def sketched_again(own: Column, other: Column, level: int) -> Column:
    """(found, ok) of two arrays of digests by a larger sketch: blocks of cells, twice as many with every level.

    Blocks are looked up in two steps, about the square root of their number in each.
    """
    salt = F.lit(level)

    def peeled(entries: Column) -> Column:
        return F.when(F.size(entries) == 0, F.struct(F.array().cast("array<struct<d:bigint,s:int>>").alias("found"), F.lit(True).alias("ok"))).otherwise(
            _bind(peel(_cells(entries, BLOCK_WIDTH), salt, BLOCK_WIDTH), _told)
        )

    def all_blocks(t: Column) -> Column:
        def some_blocks(first: Column) -> Column:
            last = F.least(first + t["step"], t["blocks"]) - 1
            near = F.filter(t["entries"], lambda e: (e["b"] >= first) & (e["b"] <= last))
            return _bind(near, lambda n: F.transform(
                F.sequence(first, last), lambda b: _bind(F.filter(n, lambda e: e["b"] == b), peeled)
            ))

        return F.flatten(F.transform(F.sequence(F.lit(0), t["blocks"] - 1, t["step"]), some_blocks))

    def placed(t: Column) -> Column:
        entries = F.concat(
            _placed(t["own"], salt, 1, BLOCK_WIDTH, t["blocks"]), _placed(t["other"], salt, -1, BLOCK_WIDTH, t["blocks"])
        )
        step = F.ceil(F.sqrt(t["blocks"])).cast("int")
        return _bind(F.struct(entries.alias("entries"), t["blocks"].alias("blocks"), step.alias("step")), all_blocks)

    size = F.size(own) + F.size(other)
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size / LOAD, F.lit(1.0)))) + level - 1).cast("int")
    parts = _bind(F.struct(own.alias("own"), other.alias("other"), blocks.alias("blocks")), placed)
    return _bind(parts, lambda p: F.struct(
        F.flatten(F.transform(p, lambda x: x["found"])).alias("found"), F.forall(p, lambda x: x["ok"]).alias("ok")
    ))


def differences(rows: DataFrame, first: DataFrame, others: list[str]) -> DataFrame:
    """row, pair (name of the other column) and found, the digests (d, s) that differ from ``own``.

    ``first`` is the ``attempt`` with the fingerprints, which decides where they can be
    peeled; the other pairs are sketched again, larger and larger, until all are.
    """
    each = F.array(*[F.struct(F.lit(o).alias("pair"), F.col(f"_{o}.found"), F.col(f"_{o}.ok")) for o in others])
    tried = first.select("row", F.explode(each).alias("p")).select("row", "p.pair", "p.found", "p.ok")
    sides = F.array(*[F.struct(F.lit(o).alias("pair"), F.col(o).alias("other")) for o in others])
    both = rows.select("row", "own", F.explode(sides).alias("p")).select("row", "own", "p.pair", "p.other")
    done, level = [tried.where("ok").select("row", "pair", "found")], 1
    failed = cut(both.join(tried.where("not ok").select("row", "pair"), ["row", "pair"]))
    while not failed.isEmpty():
        again = failed.withColumn("again", sketched_again(F.col("own"), F.col("other"), level))
        again = cut(again)
        done.append(again.where("again.ok").select("row", "pair", "again.found"))
        failed = again.where("not again.ok").drop("again")
        level += 1
    return reduce(DataFrame.unionByName, done)


def likeness(n: Column, m: Column, differ: Column) -> Column:
    """Jaccard similarity of two sets of n and m digests of which ``differ`` are in one only; 1 if both are empty."""
    return F.when(n + m == 0, F.lit(1.0)).otherwise((n + m - differ) / (n + m + differ))


# Sketches of a row: the fingerprints of the three texts, the larger sketches of own minus edited
# and own minus next, and one more row that carries what is known of the texts.
OWN, EDITED, NEXT, BY_EDITED, BY_NEXT, KNOWN = range(6)
KEYS = ["_block", "row", "sketch", "width", "known"]


def _some() -> Column:
    """Whether a cell holds anything."""
    return (F.col("n") != 0) | (F.col("x") != 0) | (F.col("c") != 0)


def _summed(parts: DataFrame) -> DataFrame:
    """Cells of one key and place added up; of larger sketches only those that hold anything."""
    cells = parts.groupBy(*KEYS, "i").agg(
        F.sum("n").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"),
        F.sum("gone").cast("int").alias("gone"),
    )
    return cells.where(~F.col("sketch").isin(BY_EDITED, BY_NEXT) | _some() | (F.col("gone") != 0))


def _all_cells(rows: DataFrame) -> DataFrame:
    """The cells of all sketches of a row: ``KEYS``, place i, n, x, c and gone, the digests peeled so far."""
    def width(other: str) -> Column:
        return F.greatest(F.lit(LEAST), (F.size("own") + F.size(other)) * 2).cast("int")

    known = F.struct("doc_id", "n_chars", "edited_sha256", "own", "edited", "next")
    nothing = F.when(F.lit(False), known)

    def side(of: int, found: Column, tells: Column = nothing) -> Column:
        return F.struct(
            F.lit(of).alias("side"), found.alias("found"), width("edited").alias("w"), width("next").alias("v"),
            tells.alias("known"),
        )

    zero = F.lit(0).cast("long")
    sides = F.array(
        side(OWN, F.col("own")), side(EDITED, F.col("edited")), side(NEXT, F.col("next")), side(KNOWN, F.array(zero), known)
    )
    each = rows.select("_block", "row", F.explode(sides).alias("s")).select(
        "_block", "row", "s.side", "s.w", "s.v", "s.known", F.explode("s.found").alias("d")
    )

    def part(number: int, width: Column, i: Column, n: int) -> Column:
        return F.struct(F.lit(number).alias("sketch"), width.alias("width"), i.cast("int").alias("i"), F.lit(n).alias("n"))

    def placed(number: int, n: int) -> list[Column]:
        if number <= NEXT:
            return [part(number, F.lit(WIDTH), p, n) for p in _places(F.col("d"), F.lit(0), WIDTH)]
        wide = F.col("w" if number == BY_EDITED else "v")
        return [part(number, wide, p, n) for p in _wide_places(F.col("d"), wide)]

    empty = [part(r, F.lit(WIDTH), F.lit(i), 0) for r in (OWN, EDITED, NEXT) for i in range(CELLS)]
    parts = (
        F.when(F.col("side") == OWN, F.array(*placed(OWN, 1), *placed(BY_EDITED, 1), *placed(BY_NEXT, 1)))
        .when(F.col("side") == EDITED, F.array(*placed(EDITED, 1), *placed(BY_EDITED, -1)))
        .when(F.col("side") == NEXT, F.array(*placed(NEXT, 1), *placed(BY_NEXT, -1)))
        .otherwise(F.array(*empty, part(KNOWN, F.lit(WIDTH), F.lit(0), 0)))
    )
    holds = F.col("p.n") != 0
    return _summed(each.select("_block", "row", "known", "d", F.explode(parts).alias("p")).select(
        "_block", "row", "p.sketch", "p.width", F.when(F.col("p.sketch") == KNOWN, F.col("known")).alias("known"), "p.i",
        "p.n", F.when(holds, F.col("d")).otherwise(zero).alias("x"),
        F.when(holds, _check(F.col("d"))).otherwise(zero).alias("c"), F.lit(0).alias("gone"),
    ))


def _wide_places(digest: Column, width: Column) -> list[Column]:
    """The place of a digest in each of the three segments of a larger sketch."""
    return [(F.pmod(F.xxhash64(digest, F.lit(1), F.lit(i)), width) + width * i).cast("int") for i in range(3)]


def _peeled_segment(cells: DataFrame, segment: int) -> DataFrame:
    """Larger sketches without the digests that stand alone in a cell of one segment.

    A digest has one cell in a segment, so none is taken out twice. Taken digests are
    counted in ``gone`` of place -1.
    """
    alone = (
        F.col("sketch").isin(BY_EDITED, BY_NEXT) & (F.floor(F.col("i") / F.col("width")) == segment)
        & (F.abs("n") == 1) & (F.col("c") == _check(F.col("x")))
    )

    def part(i: Column, n: Column, x: Column, c: Column, gone: Column) -> Column:
        return F.struct(i.alias("i"), n.alias("n"), x.alias("x"), c.alias("c"), gone.alias("gone"))

    zero = F.lit(0).cast("long")
    places = _wide_places(F.col("x"), F.col("width"))
    others = [
        part(p, -F.col("n"), F.col("x"), F.col("c"), F.lit(0)) for k, p in enumerate(places) if k != segment
    ]
    taken = F.array(*others, part(F.lit(-1), F.lit(0), zero, zero, F.col("gone") + 1))
    stays = F.array(part(*[F.col(f) for f in ("i", "n", "x", "c", "gone")]))
    return _summed(cells.select(*KEYS, F.explode(F.when(alone, taken).otherwise(stays)).alias("p")).select(*KEYS, "p.*"))


def _compared(cells: DataFrame) -> DataFrame:
    """row, known, the three fingerprints, and of both larger sketches the digests peeled and whether these are all."""
    for turn in range(PEELS):
        cells = _peeled_segment(cells, turn % 3)
    cell = F.struct("sketch", "i", "n", "x", "c")

    def of(number: int) -> Column:
        here = F.col("sketch") == number
        return F.struct(
            F.coalesce(F.sum(F.when(here, F.col("gone"))), F.lit(0)).cast("int").alias("n"),
            F.coalesce(~F.bool_or(here & _some()), F.lit(True)).alias("ok"),
        )

    found = cells.groupBy("_block", "row").agg(
        F.sort_array(F.collect_list(F.when(F.col("sketch") <= NEXT, cell))).alias("cells"),
        of(BY_EDITED).alias("by_edited"), of(BY_NEXT).alias("by_next"), F.first("known", ignorenulls=True).alias("known"),
    )
    return found.select(
        "row", "known", "by_edited", "by_next",
        *[F.slice("cells", 1 + r * CELLS, CELLS).alias(name) for r, name in enumerate(("mine", "changed", "theirs"))],
    )


def compare_versions(docs: DataFrame, paragraph: str = PARAGRAPH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row.

    Null texts are empty; texts without a paragraph have cells of 0, so two such are alike.
    Rows of one id stand by their text's digest and repeated rows behind each other. One row
    is its own next; an empty table gives no rows. ``paragraph`` is the pattern of what is compared.
    Where two fingerprints hide too many differences, the larger sketch of the pair tells them,
    and where that cannot, others of twice as many cells with every level.
    """
    rows = _compared(_all_cells(edited_rows(docs, paragraph)))

    def tried(other: str, larger: str) -> Column:
        def told(t: Column) -> Column:
            return F.when(t["ok"], F.struct(F.size(t["found"]).alias("n"), t["ok"].alias("ok"))).otherwise(F.col(larger))

        return _bind(subtracted(F.col("mine"), F.col(other)), told)

    # The outer form of explode is a step of its own: what it makes is not worked out again for each use.
    once = F.explode_outer(F.array(F.struct(
        tried("changed", "by_edited").alias("_edited"), tried("theirs", "by_next").alias("_next"),
        as_text(F.col("mine")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
    ))).alias("r")
    ok = F.col("r._edited.ok") & F.col("r._next.ok")
    roles = ("own", "edited", "next")
    # Digests are written only for rows that need a still larger sketch.
    rows = cut(rows.select("row", "known", once).select(
        "row", "known.doc_id", "known.n_chars", "known.edited_sha256", "r.*",
        *[F.size(f"known.{c}").alias(f"_n_{c}") for c in roles], *[F.when(~ok, F.col(f"known.{c}")).alias(c) for c in roles],
    ))
    done, level = [rows.where("_edited.ok and _next.ok")], 1
    failed = rows.where("not (_edited.ok and _next.ok)")
    while not failed.isEmpty():
        def larger(other: str) -> Column:
            again = _bind(
                sketched_again(F.col("own"), F.col(other), level),
                lambda t: F.struct(F.size(t["found"]).alias("n"), t["ok"].alias("ok")),
            )
            return F.when(F.col(f"_{other}.ok"), F.col(f"_{other}")).otherwise(again)

        tried_again = cut(failed.withColumns({"_edited": larger("edited"), "_next": larger("next")}))
        done.append(tried_again.where("_edited.ok and _next.ok"))
        failed = tried_again.where("not (_edited.ok and _next.ok)")
        level += 1
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("_n_own"), F.col("_n_edited"), F.col("_edited.n")).alias("near_edited"),
        likeness(F.col("_n_own"), F.col("_n_next"), F.col("_next.n")).alias("near_next"),
    )
