"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so 64 hash evaluations
give 128 values; four of them make a band, and documents that agree in a band are candidates. At a similarity of 0.75,
the bound for a link, a pair misses all 32 bands with a probability of 5e-6 in large sets and more in small ones, where
minimum and maximum depend on each other: 1e-4 for 3 of 4 shingles, 8e-6 for 18 of 24. So sets of up to SMALL_SET shingles
are also candidates if they share one of their lowest hashes, as many as two linked sets of that size can't all miss.

Links are used for components only, so not every pair needs a test, but every pair that could join two components gets
one:

1. Texts with the same shingle set are one class, which the SHA-256 of the whole sorted set names, and one document stands
   for it.
2. In small buckets, all pairs of classes are tested; in large ones, each member against a few pivots.
3. Components are formed. In large buckets that still hold several, members of different components are tested in
   blocks of bounded size against each other. A block holds one component's members, or those of several small ones, and
   blocks of the same single component never meet, so a group of any size is spread over tasks and no list of pairs is made.

What is known of a bucket comes to its members over SALTS places, so a bucket of any size is spread over as many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, give_back, map_rows, small_batches
from .shingles import WIDTH, Shingler, _mix, _stream

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
SIMILARITY_PERCENT = 75
#: Pairs of sets of up to this many shingles are all found.
SMALL_SET = 20
#: Up to this many members, all pairs of a bucket are tested at once: at most half as many pairs for each member.
SMALL_BUCKET = 16
PIVOTS = 4
#: Shingles and members in a block of a large bucket, about so many at most, and shared shingles compared at once.
BLOCK_SHINGLES, BLOCK_MEMBERS, TILE = 100_000, 1000, 4096
#: Places over which a bucket's members are dealt; they are the bits of a long.
SALTS = 64


def _sets(shingler: Shingler, texts: list[str | None]):
    """Distinct sorted shingles and all shingles of each block of texts."""
    for first, hashes, counts in shingler.each(texts):
        offsets = np.cumsum(counts) - counts
        yield first, hashes, counts, offsets, [np.unique(hashes[o : o + n]) for o, n in zip(offsets, counts, strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (the SHA-256 of the sorted set, null for an empty set), bands, with a small set's lowest
    shingles after them."""

    def start() -> Callable[[dict], dict]:
        shingler = Shingler(WIDTH)
        factor, shift = _stream(5, PERMUTATIONS) | np.uint64(1), _stream(9, PERMUTATIONS)
        mixers = _stream(13, 2 * PERMUTATIONS).reshape(BANDS, ROWS) | np.uint64(1)

        def apply(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "n_shingles": [0] * len(batch["doc_id"]), "set_key": [None] * len(batch["doc_id"]), "bands": [None] * len(batch["doc_id"])}
            for first, hashes, counts, offsets, sets in _sets(shingler, batch["text"]):
                full = np.flatnonzero(counts)
                values = np.empty((len(full), 2 * PERMUTATIONS), np.uint64)
                for k in range(PERMUTATIONS if len(full) else 0):
                    x = hashes * factor[k] + shift[k]
                    x ^= x >> np.uint64(32)
                    values[:, 2 * k] = np.minimum.reduceat(x, offsets[full])
                    values[:, 2 * k + 1] = np.maximum.reduceat(x, offsets[full])
                bands = _mix((values.reshape(-1, BANDS, ROWS) * mixers).sum(axis=2, dtype=np.uint64)).view(np.int64)
                for row, i in enumerate(full):
                    own = sets[i]
                    at = first + i
                    out["n_shingles"][at] = len(own)
                    out["set_key"][at] = hashlib.sha256(own.tobytes()).digest()
                    lowest = own[: len(own) - -(-len(own) * SIMILARITY_PERCENT // 100) + 1] if len(own) <= SMALL_SET else own[:0]
                    out["bands"][at] = np.concatenate([bands[row], lowest.view(np.int64)])
            return out

        return apply

    return map_rows(docs.select("doc_id", "text"), start, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    def start() -> Callable[[dict], dict]:
        shingler = Shingler(WIDTH)

        def apply(batch: dict) -> dict:
            sets: list[np.ndarray] = []
            for *_, own in _sets(shingler, batch["text"]):
                sets += [x.view(np.int64) for x in own]
            return {"node": batch["doc_id"], "shingles": sets}

        return apply

    return map_rows(docs.select("doc_id", "text"), start, "node long, shingles array<long>")


def _linked(common: Column, a: Column, b: Column) -> Column:
    return common * 100 >= (a + b - common) * F.lit(SIMILARITY_PERCENT)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(_linked(common, F.size("sa"), F.size("sb"))).select("a", "b")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (a, b), by alternating large and small
    stars; each star keeps the components and the rounds are logarithmic in their size."""
    edges = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        found = work.save(small, f"{name}-{step + 1}")
        changed = found.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(found, ["u", "v"], "left_anti").limit(1).count()
        if not changed:
            out = work.save(found.select(F.col("u").alias("node"), F.col("v").alias("component")), name)
            work.drop(f"{name}-{step}", f"{name}-{step + 1}")
            return out
        work.drop(f"{name}-{step}")
        edges, step = found, step + 1


def _test_blocks(blocks: DataFrame) -> DataFrame:
    """Links between members of different components of two blocks of a bucket; a block is (nodes, comps, sizes, all
    shingles one after another). A pair of blocks takes some 100 MB at most, unless a text alone has more shingles than a
    block."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: v[0] for k, v in zip(batch.schema.names, batch.slice(at, 1).columns, strict=True)}
                sides = []
                for s in "xy":
                    nodes, comps, sizes, tokens = (row[f"{s}_{c}"].values.to_numpy(zero_copy_only=False) for c in ("nodes", "comps", "sizes", "all"))
                    sides.append((nodes, comps, sizes.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), tokens))
                shared = np.intersect1d(sides[0][4], sides[1][4])
                common = np.zeros((len(sides[0][0]), len(sides[1][0])), np.float32)
                for low in range(0, len(shared), TILE):
                    part = shared[low : low + TILE]
                    tables = []
                    for nodes, _, _, own, tokens in sides:
                        place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
                        hit = part[place] == tokens
                        table = np.zeros((len(nodes), len(part)), np.float32)
                        table[own[hit], place[hit]] = 1
                        tables.append(table)
                    common += tables[0] @ tables[1].T
                common = common.astype(np.int64)  # exact: a text has fewer than 2^24 shingles in a tile
                union = sides[0][2][:, None] + sides[1][2][None, :] - common
                good = (common * 100 >= union * SIMILARITY_PERCENT) & (sides[0][1][:, None] != sides[1][1][None, :])
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(sides[0][0][i], pa.int64()), pa.array(sides[1][0][j], pa.int64())], ["a", "b"])
        give_back()

    return blocks.mapInArrow(run, "a long, b long")


def _blocks(open_members: DataFrame, work: Workspace) -> DataFrame:
    """The blocks of the members (band, value, salt, node, component, shingles) of buckets that hold several components.
    Where a component has enough for a block of its own in a bucket, it is dealt to such blocks, others share some."""
    # How much of a block a member takes.
    weight = F.greatest(F.size("shingles") / F.lit(float(BLOCK_SHINGLES)), F.lit(1.0 / BLOCK_MEMBERS))
    bucket = ["band", "value"]
    own = open_members.groupBy(*bucket, "component").agg(F.sum(weight).alias("load"))
    pure = F.col("load") >= 0.5
    pool = own.where(~pure).groupBy(*bucket).agg(F.sum("load").alias("load"))
    kinds = own.where(pure).select(*bucket, "component", F.greatest(F.ceil("load"), F.lit(1)).alias("parts"))
    # A block's name: the component and its part, or none and a part of the pool, whose components aren't split.
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = open_members.join(salted(kinds), [*bucket, "salt", "component"], "left").join(salted(pool), [*bucket, "salt"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit(77)), F.col("parts")), F.pmod(F.xxhash64("component", F.lit(78)), F.greatest(F.ceil("load"), F.lit(1))))
    dealt = named.select(*bucket, F.when(F.col("parts").isNotNull(), F.col("component")).alias("owner"), part.alias("part"), "node", "component", "shingles")
    packed = dealt.groupBy(*bucket, "owner", "part").agg(F.sort_array(F.collect_list(F.struct("node", "component", "shingles"))).alias("m"))
    return work.save(
        packed.select(*bucket, "owner", "part", F.col("m.node").alias("nodes"), F.col("m.component").alias("comps"), F.transform("m.shingles", F.size).alias("sizes"), F.flatten("m.shingles").alias("all"))
        .withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "part")),
        "blocks",
    )


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of a bucket's blocks that may hold members of different components, each with both blocks' contents. The pairs
    are found from the blocks' names, and each comes to a place of its own."""
    bucket, contents = ["band", "value"], ("nodes", "comps", "sizes", "all")
    names = blocks.select(*bucket, "owner", "block")
    other = names.select(*bucket, F.col("owner").alias("y_owner"), F.col("block").alias("y_block"))
    pairs = names.withColumnsRenamed({"owner": "x_owner", "block": "x_block"}).join(other, bucket)
    # Both of one component: nothing to test. A pool block meets itself, since it holds several.
    pairs = pairs.where((F.col("x_block") <= F.col("y_block")) & ~F.coalesce(F.col("x_owner") == F.col("y_owner"), F.lit(False)))
    pairs = pairs.select(*bucket, "x_block", "y_block")
    for s in "xy":
        side = blocks.select(*bucket, F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in contents))
        pairs = pairs.join(side.hint("merge"), [*bucket, f"{s}_block"])
    return pairs.select(*(f"{s}_{c}" for s in "xy" for c in contents))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per doc_id of docs (doc_id, text, more): doc_id, n_shingles, component_id, kept.

    A null text or one without words has no shingles and is linked with nothing. Rows that share a doc_id are one
    document, linked where any of its texts is, and n_shingles is of its largest set. Rows without a doc_id come back
    one by one, with a null component and kept. Equal similarity is no tie: 0.75 links. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    with small_batches(spark):
        marks = work.save(signatures(docs), "signatures")
    known = marks.where(F.col("doc_id").isNotNull())
    classes = work.save(known.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")

    salt = F.pmod(F.xxhash64("node", F.lit(55)), F.lit(SALTS)).cast("int")
    entries = classes.select("node", F.posexplode("bands").alias("band", "value")).withColumn("band", F.least("band", F.lit(BANDS))).withColumn("salt", salt)
    shared = entries.groupBy("band", "value").agg(F.count("*").alias("members"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts"), *(F.min_by("node", F.xxhash64("node", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS))).where("members > 1")
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    members = work.save(entries.join(shared.withColumn("salt", F.explode(present)).drop("salts").hint("merge"), ["band", "value", "salt"]), "members")

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    with small_batches(spark):
        sets = work.save(shingle_sets(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")), "sets")

    few, many = members.where(F.col("members") <= SMALL_BUCKET), members.where(F.col("members") > SMALL_BUCKET)
    other = few.select("band", "value", F.col("node").alias("b"))
    pairs = few.withColumnRenamed("node", "a").join(other, ["band", "value"]).where("a < b").select("a", "b")
    stars = many.select("node", F.explode(F.array(*(f"p{j}" for j in range(PIVOTS)))).alias("pivot")).where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = pairs.unionByName(stars).distinct()
    # A document with several texts joins the classes of all of them.
    same = known.where(F.col("set_key").isNotNull()).groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id")
    same = known.join(same, "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = work.save(confirm(pairs, sets).unionByName(same), "links")
    first = components(links, work, "first")

    named = many.select("band", "value", "salt", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = named.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_members = work.save(named.join(apart, ["band", "value", "salt"], "left_semi").join(sets.hint("merge"), "node"), "open")
    with small_batches(spark, 8):
        more = work.save(_test_blocks(_block_pairs(_blocks(open_members, work))).distinct(), "more")
    merged = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), work, "last") if more.limit(1).count() else first

    named = classes.select("set_key", "node").join(merged, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    whole = known.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("set_key").alias("set_key"))
    out = whole.join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = marks.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = work.save(out.unionByName(nameless), "result")
    work.drop("signatures", "classes", "members", "sets", "links", "open", "blocks", "more", "first", "last")
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, with all columns. Rows that share a doc_id but not the text are
    documents of their own, so no text is lost; of rows alike in both, one stays. Rows without a doc_id all stay."""
    named = docs.where(F.col("doc_id").isNotNull())
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    ids = named.select("doc_id", tie.alias("tie")).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("tie").alias("low"), F.max("tie").alias("high")).where("rows > 1")
    repeated, (several,) = ids.select(F.col("doc_id"), (F.col("low") != F.col("high")).alias("several")), fresh(docs, "several")
    if not repeated.limit(1).count():
        found = near_duplicates(docs)
        kept = named.join(found.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", "left_semi")
        return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
    node, number, theirs = fresh(docs, "node", "number", "their_id")
    work = Workspace(docs.sparkSession, "neardup")
    marked = named.join(repeated.withColumnsRenamed({"doc_id": theirs, "several": several}), F.col("doc_id") == F.col(theirs), "left")
    # An id of several texts gives each a number that only doc_id and text decide.
    own = F.when(F.col(several), F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())).otherwise(F.col("doc_id"))
    rows = work.save(marked.withColumn(node, own).withColumn(number, F.when(F.col(several).isNotNull(), F.monotonically_increasing_id())).drop(theirs), "rows")
    found = near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"))
    kept = rows.join(found.where("kept").select(F.col("doc_id").alias(node)), node, "left_semi")
    # Of rows alike the first number stays: one minimum for each, not a window over all.
    first = kept.where(F.col(number).isNotNull()).groupBy(node).agg(F.min(number).alias(number)).select(number)
    out = kept.where(F.col(number).isNull()).unionByName(kept.join(first, number, "left_semi").select(kept.columns))
    return out.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
