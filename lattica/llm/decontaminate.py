"""Benchmark decontamination with DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (all of them, if it has fewer). Words in a row of SEED lie in every
window; of the ten places in a row where a seed can start within one window of 13, exactly one is a multiple of ten. So the
benchmark's seeds, from all places, form a hash set that is broadcast, a document is probed at every tenth word only, and
each hit is verified against the whole windows around it. Nothing is missed, and the full text takes part in no shuffle.
Items with fewer words than a window are probed at every word with all their words as the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, lower_ascii

WINDOW, SEED = 13, 4
#: Contaminated: this many times the hit words are at least all words.
FACTOR = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Seeds are broadcast with their items (some 300 bytes each), about so many at once; the documents are read for each part.
BROADCAST_SEEDS = 200_000


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for a null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash_at(ws: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(ws, at + j) for j in range(n)))


def _seeds(ws: Column, places: Column, n: int, name: str) -> Column:
    """(seed, place) at each of the places, the latter under name."""
    return F.transform(places, lambda p: F.struct(_hash_at(ws, p, n).alias("seed"), p.alias(name)))


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """seed, place, width, item_words, item_ids of each distinct word list; and the window widths that occur."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where("size(item_words) > 0")
    items = items.groupBy("item_words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("width", F.least(F.size("item_words"), F.lit(WINDOW)))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # 13 at most
    parts = []
    for w in widths:
        n = SEED if w == WINDOW else w
        places = F.sequence(F.lit(0), F.size("item_words") - n)
        parts.append(items.where(F.col("width") == w).select(F.explode(_seeds(F.col("item_words"), places, n, "place")).alias("s"), "width", "item_words", "item_ids").select("s.seed", "s.place", "width", "item_words", "item_ids"))
    if not parts:
        return items.select(F.lit(0).cast("long").alias("seed"), F.lit(0).alias("place"), "width", "item_words", "item_ids"), []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, widths


def _probes(ws: Column, widths: list[int]) -> Column:
    """The document's places to probe, as (seed, at); and one without a seed that stands for the document itself."""
    own = F.array(F.struct(F.lit(None).cast("long").alias("seed"), F.lit(-1).alias("at")))
    found = [own]
    for w in widths:
        n, step = (SEED, WINDOW - SEED + 1) if w == WINDOW else (w, 1)
        places = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n, F.lit(step))).otherwise(F.array().cast("array<int>"))
        found.append(_seeds(ws, places, n, "at"))
    return F.concat(*found)


def _windows_hit() -> Column:
    """Starts, in the document, of the item's windows that hold the seed and agree word for word."""
    first = F.greatest(F.lit(0), F.col("place") - F.when(F.col("width") == WINDOW, WINDOW - SEED).otherwise(0))
    last = F.least(F.col("place"), F.size("item_words") - F.col("width"))
    shift = F.col("at") - F.col("place")
    fits = lambda t: (t + shift >= 0) & (t + shift + F.col("width") <= F.size("ws")) & (F.slice("ws", t + shift + 1, F.col("width")) == F.slice("item_words", t + 1, F.col("width")))
    return F.transform(F.filter(F.sequence(first, last), fits), lambda t: t + shift)


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and ws, the words, of docs."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("ws"))


def hits(docs: DataFrame, benchmark: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text, more): row, doc_id, n_words, covered (its hit word places), item_ids.

    Seeds are dealt by a hash of seed, place and item to parts of about BROADCAST_SEEDS, and each part is broadcast in turn; benchmarks that fit in
    one are broadcast at once. base is docs as _numbered makes it, written, so that all parts see the same rows.
    """
    seeds, widths = benchmark_seeds(benchmark)
    parts = max(1, -(-seeds.count() // BROADCAST_SEEDS)) if widths else 1
    if base is None:
        base = _numbered(docs) if parts == 1 else Workspace(docs.sparkSession, "decontaminate").save(_numbered(docs), "words")
    probed = base.withColumn("probes", _probes(F.col("ws"), widths))
    each = probed.select("row", "doc_id", "ws", F.explode("probes").alias("probe")).select("row", "doc_id", "ws", "probe.seed", "probe.at")
    joined = None
    for k in range(parts):
        part = seeds if parts == 1 else seeds.where(F.pmod(F.xxhash64("seed", "place", "item_words"), F.lit(parts)) == k)
        some = each.join(F.broadcast(part), "seed", "left").where("at < 0 or place is not null")
        joined = some if joined is None else joined.unionByName(some)
    found = joined.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), F.when(F.col("at") >= 0, _windows_hit()).alias("starts"), "width", "item_ids")
    spans = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("width") - 1)))
    hit = F.size("starts") > 0
    found = found.select("row", "doc_id", "n_words", F.when(hit, spans).alias("covered"), F.when(hit, F.col("item_ids")).alias("item_ids"))
    return found.groupBy("row", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text, more).

    A null text has no words; it and an empty one hit nothing. Items without words have no windows; item_ids that repeat
    count once, and items alike in words count each. Without a benchmark nothing is hit. Rows that share a doc_id are rows
    of their own; an empty table of documents gives no rows. The words of one document are in memory at once, as its text is.
    """
    found = hits(docs, benchmark)
    n_hit = F.size("covered").cast("long")
    digest = F.sha2(F.concat_ws(",", F.sort_array("item_ids")), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), ((n_hit > 0) & (n_hit * FACTOR >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, with all columns, in any number of rows alike. Rows without a doc_id stay unless
    contaminated, as others do. docs, texts included, are shuffled once, by id and a hash of the text."""
    key, own_id, own_key = fresh(docs, "key", "bad_id", "bad_key")
    marked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    n_hit = F.size("covered")
    bad = hits(marked, benchmark).where((n_hit > 0) & (n_hit * FACTOR >= F.col("n_words"))).select(F.col("doc_id.doc_id").alias(own_id), F.col("doc_id.key").alias(own_key)).distinct()
    rows = docs.withColumn(key, F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left_anti").select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id and clean_text of each row of docs: its words that no window hit, a space between two; the text as it
    is where nothing was hit. The rows' numbers are written before they are used, so a task that is run again, or another
    plan, can't pair a document with another's hits."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", words(F.col("text")).alias("ws"))
    base = Workspace(docs.sparkSession, "decontaminate").save(numbered, "rows")
    found = hits(docs, benchmark, base.drop("text")).select("row", "covered")
    places = F.array_except(F.sequence(F.lit(0), F.size("ws") - 1), F.col("covered"))
    kept = F.transform(places, lambda i: F.get(F.col("ws"), i))
    return base.join(found, "row").select("row", "doc_id", F.when(F.size("covered") > 0, F.concat_ws(" ", kept)).otherwise(F.col("text")).alias("clean_text"))
