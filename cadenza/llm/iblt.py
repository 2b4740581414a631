"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is cut into paragraphs: lines, cut again after sentences and after ``WORDS`` words. The different
paragraph digests go into one cell of each of three tables; a cell has the number of its digests, their
exclusive or, and that of a check digest. Sketches subtract cell by cell, so that what two versions share
disappears. Peeling takes cells that hold one digest, table after table, and removes it from the other two;
each digest stands once in a table, so a round needs no deduplication. Cells that are left mean failure, and
the pair is tried again with twice the cells and other hashes.

Null and empty texts have no paragraphs and an empty sketch; two of them are alike (1). A repeated paragraph
counts once. Equal texts have equal sketches. A single document is its own next one. Repeated rows give
repeated results; a null key comes last in descending order; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import content, lookup, stored

WORDS = 24
#: Words of a line up to the end of a sentence or the largest number of words.
PARAGRAPH = rf"(?:\S++(?<![.!?])[^\S\n]++){{0,{WORDS - 1}}}\S++"
TABLES = 3
#: Cells of each table of a stored fingerprint.
CELLS = 8
#: Rounds of peeling, each over one table.
ROUNDS = 12
#: Ranges of keys: percentiles, each cut evenly again so that a piece has about this many characters.
PERCENTILES, PIECE_CHARS = 256, 8_000_000


def digests(text: Column) -> Column:
    """Digests of the different paragraphs of a text."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def cell_of(digest: Column, at: int, cells: Column, seed: int) -> Column:
    """Place of a digest in table ``at``; cells are numbered through all tables."""
    return F.lit(at) * cells + F.pmod(F.xxhash64(digest, F.lit(31 * seed + at)), cells)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def sketch_cells(elements: DataFrame, keys: list[str], cells: Column, seed: int) -> DataFrame:
    """(keys, cell, n, sum, check) from rows (keys, digest, sign): signs subtract sketches."""
    each = elements.withColumn("_cells", F.array(*(cell_of(F.col("digest"), t, cells, seed) for t in range(TABLES))))
    each = each.withColumn("_check", check(F.col("digest"))).select(
        *keys, F.explode("_cells").alias("cell"), F.col("sign"), "digest", "_check")
    return _summed(each, keys, F.col("sign"), F.col("digest"), F.col("_check"))


def _summed(rows: DataFrame, keys: list[str], n: Column, total: Column, checks: Column) -> DataFrame:
    summed = rows.groupBy(*keys, "cell").agg(
        F.sum(n).cast("int").alias("n"), F.bit_xor(total).alias("sum"), F.bit_xor(checks).alias("check"))
    return summed.filter("n <> 0 or sum <> 0 or check <> 0")


def peel(cells: DataFrame, keys: list[str], size: Column, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Recovered digests and left cells of subtracted sketches.

    Rows (keys, cell, n, sum): ``cell`` -1 for a digest ``sum`` recovered with sign ``n``; other rows are
    cells that could not be emptied. ``size`` is a column over ``keys``.
    """
    for i in range(rounds):
        table = i % TABLES
        pure = (
            (F.col("cell") >= table * size) & (F.col("cell") < (table + 1) * size) & (F.abs("n") == 1)
            & (F.col("check") == check(F.col("sum")))
        )
        cell = lambda at, n, total, checks: F.struct(
            at.cast("long").alias("cell"), n.alias("n"), total.alias("sum"), checks.alias("check"))
        same = cell(F.col("cell"), F.col("n"), F.col("sum"), F.col("check"))
        others = [t for t in range(TABLES) if t != table]
        # The digest leaves its own cell by becoming a recovered row; from the other two it is taken.
        taken = F.array(
            cell(-1 - F.pmod(F.col("sum"), F.lit(1 << 40)), F.col("n"), F.col("sum"), F.col("check")),
            *(cell(cell_of(F.col("sum"), t, size, seed), -F.col("n"), F.col("sum"), F.col("check")) for t in others),
        )
        moved = cells.select(*keys, F.explode(F.when((F.col("cell") >= 0) & pure, taken).otherwise(F.array(same))).alias("_c"))
        cells = _summed(moved.select(*keys, "_c.*"), keys, F.col("n"), F.col("sum"), F.col("check"))
    return cells


def size_for(a: Column, b: Column, factor: int) -> Column:
    """Cells of a table for two versions with so many paragraphs."""
    need = F.greatest(F.lit(CELLS), a + b)
    return (F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double")))) * factor).cast("long")


def differences(pairs: DataFrame, factor: int, seed: int) -> DataFrame:
    """(row, kind, mine, theirs, failed) from (row, kind, a, b): arrays of digests of two versions.

    mine and theirs count the recovered digests of either side. All rows of a pair stay in the partition
    they are dealt to here, so sketching and peeling shuffle nothing more.
    """
    dealt = pairs.repartition(F.col("row")).withColumn("size", size_for(F.size("a"), F.size("b"), factor))
    keys = ["row", "kind", "size"]
    signed = lambda name, sign: F.transform(name, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))
    elements = dealt.select(*keys, F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("e")).select(*keys, "e.*")
    left = peel(sketch_cells(elements, keys, F.col("size"), seed), keys, F.col("size"), seed)
    return left.groupBy("row", "kind").agg(
        F.count_if((F.col("cell") < 0) & (F.col("n") == 1)).alias("mine"),
        F.count_if((F.col("cell") < 0) & (F.col("n") == -1)).alias("theirs"),
        F.bool_or((F.col("cell") >= 0) | (F.abs("n") != 1)).alias("failed"),
    )


def recovered(pairs: DataFrame, seed: int = 1) -> DataFrame:
    """(row, kind, mine, theirs) of every pair that differs, trying larger sketches until all are decoded."""
    parts, factor = [], 1
    while True:
        tried = stored(differences(pairs, factor, seed), "peeled")
        parts.append(tried.filter("not failed"))
        failed = tried.filter("failed").select("row", "kind")
        if failed.isEmpty():
            break
        pairs = stored(pairs.join(lookup(failed), ["row", "kind"], "left_semi"), "failed")
        factor, seed = 2 * factor, seed + 1
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("failed")


def _deal(docs: DataFrame) -> DataFrame:
    """``docs`` (key, text) with ``piece``: ranges of keys of about PIECE_CHARS characters, in key order."""
    facts = docs.agg(
        F.percentile_approx("key", [i / PERCENTILES for i in range(1, PERCENTILES)], 2000).alias("cuts"),
        F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.length("text")).alias("chars"),
    ).first()
    if facts["low"] is None:
        return docs.withColumn("piece", F.lit(-1).cast("long"))
    cuts = sorted({int(facts["low"]), *map(int, facts["cuts"] or []), int(facts["high"]) + 1})
    fine = max(1, -(-int(facts["chars"] or 0) // (PIECE_CHARS * (len(cuts) - 1))))
    edges = F.array(*(F.lit(c) for c in cuts))
    at = F.size(F.filter(edges, lambda c: c <= F.col("key")))
    low, high = F.get(edges, at - 1), F.get(edges, at)
    inside = F.floor((F.col("key") - low) * F.lit(float(fine)) / (high - low))
    return docs.withColumn("piece", F.coalesce((at * fine + inside).cast("long"), F.lit(-1).cast("long")))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (key, text) with ``next``: the text of the next row by descending key, of the first after the last.

    Texts are shuffled once, by range of keys. The row that begins a range is also sent to the range before
    it, whose last row looks for it there.
    """
    dealt = _deal(docs)
    heads = dealt.groupBy("piece").agg(F.max("key").alias("head"))
    # One row for each range, PERCENTILES times few thousand at most: ordered in one task.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("piece"))
    follow = heads.withColumn("to", F.coalesce(F.lag("piece").over(order), F.min("piece").over(Window.partitionBy(F.lit(0)))))
    follow = follow.select(F.col("piece").alias("_piece"), "head", "to")
    ghosts = dealt.join(
        F.broadcast(follow), (F.col("piece") == F.col("_piece")) & F.col("key").eqNullSafe(F.col("head"))
    ).select("key", "text", F.col("to").alias("piece"), F.lit(1).alias("ghost"))
    both = dealt.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    run = Window.partitionBy("piece").orderBy("ghost", F.desc_nulls_last("key"), F.xxhash64("text"))
    return both.withColumn("next", F.lead("text").over(run)).filter("ghost = 0").drop("ghost", "piece")


def fingerprint_text(cells: Column) -> Column:
    """Cells (cell, n, sum, check) in order, as text: place, number, digests and checks in hexadecimal."""
    return F.array_join(F.transform(F.array_sort(cells), lambda c: F.concat_ws(
        ".", c["cell"].cast("string"), c["n"].cast("string"), F.lower(F.hex(c["sum"])), F.lower(F.hex(c["check"])))), ";")


def fingerprints(pieces: DataFrame, versions: list[str]) -> DataFrame:
    """(row, one text for each version): stored sketches of CELLS cells a table, empty cells left out."""
    dealt = pieces.repartition(F.col("row"))

    def marked(i: int, version: str) -> Column:
        return F.transform(version, lambda d: F.struct(F.lit(i).alias("version"), d.alias("digest"), F.lit(1).alias("sign")))

    elements = dealt.select("row", F.explode(F.concat(*(marked(i, v) for i, v in enumerate(versions)))).alias("e"))
    elements = elements.select("row", "e.*")
    cells = sketch_cells(elements, ["row", "version"], F.lit(CELLS), 0)
    each = F.struct("cell", "n", "sum", "check")
    return cells.groupBy("row").agg(*(
        fingerprint_text(F.collect_list(F.when(F.col("version") == i, each))).alias(v) for i, v in enumerate(versions)))


def likeness(a: Column, b: Column, mine: Column, theirs: Column) -> Column:
    """Shared paragraphs by all paragraphs, from the numbers of both and of what either has alone."""
    alone, other = F.coalesce(mine, F.lit(0)), F.coalesce(theirs, F.lit(0))
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a - alone) / (a + other))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and what is alike in it, its edit and the next text.

    The edit replaces the last third of a text by as many code points from the start of the next document.
    """
    pairs = with_next(docs.select(F.col(key).alias("key"), content(text).alias("text")))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("next", F.lit(1), third))
    facts = pairs.select("key", "text", "next", edited.alias("edited")).select(
        "key", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edit"), digests(F.col("next")).alias("next"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = stored(facts, "paragraphs")  # the row numbers are fixed from here on
    pair = lambda kind, other: F.struct(F.lit(kind).alias("kind"), F.col("own").alias("a"), F.col(other).alias("b"))
    versus = facts.select("row", F.explode(F.array(pair(0, "edit"), pair(1, "next"))).alias("p")).select("row", "p.*")
    found = recovered(versus).groupBy("row").agg(*(
        F.max(F.when(F.col("kind") == kind, F.col(side))).alias(f"{side}{kind}") for kind in (0, 1) for side in ("mine", "theirs")))
    prints = fingerprints(facts.select("row", "own", "edit"), ["own", "edit"]).withColumnsRenamed({"own": "fp", "edit": "edited_fp"})
    sizes = facts.select("row", "key", "n_chars", "edited_sha256", *(F.size(v).alias(v) for v in ("own", "edit", "next")))
    return sizes.join(found, "row", "left").join(prints, "row", "left").select(
        F.col("key").alias(key), "n_chars", "edited_sha256", F.coalesce("fp", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fp", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), F.col("mine0"), F.col("theirs0")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("mine1"), F.col("theirs1")).alias("near_next"),
    )
