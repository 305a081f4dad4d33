"""URL filters: fixed host and path rules first, and rules mined from labelled pages for the rest.

FP-growth mines combinations of all tokens of labelled URLs that go with bad pages, each item's conditional patterns in a
task. A mined rule is kept if its support and its confidence reach the bounds, if its pages are bad so often that chance
doesn't explain it (the lower Wilson bound of its confidence lies above the share of bad pages among all), and if no rule
with fewer of the same tokens is as sure; so a token that a combination implies (as a host does its end) isn't added to it, which Spark's own FP-growth
can't leave out: its combinations double with each token. The kept rules are few, since every supported combination has
the support of many pages, and match by an inverted index: each is filed under its rarest token, and only the rules filed
under a URL's own tokens are compared with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, map_rows

#: (verdict, rule): a rule is a host, /, and how the path must begin.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Standard deviations of the Wilson bound: of a hundred thousand combinations that mean nothing, three pass.
CERTAINTY = 4.0
MAX_RULES = 100_000
#: Of so many parts of the labelled pages, one is held out to try rules mined from the others.
PARTS = 5


def host(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fixed rule that fits columns host and path, as a struct (rule, verdict), or null. Rules of one length
    are tried in the order given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):  # the last is the longest
        own, _, begin = rule.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith("/" + begin)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens of columns url, host and path, by their kind: scheme, host's name, end and parts, path's
    parts and ending, names of the query's fields, fragment."""
    labels = F.split("host", r"\.")
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.rlike(r"^\d+(\.\w+)?$"))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract("url", r"^([^:/?#]*)://", 1)), F.concat(F.lit("host:"), F.col("host"))),
        named("end:", F.slice(labels, -1, 1)),
        named("label:", labels),
        named("dir:", parts),
        named("ending:", F.array(F.regexp_extract("path", r"\.(\w+)$", 1))),
        named("field:", F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])),
        F.when(F.col("url").contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(every)


def split_urls(pages: DataFrame) -> DataFrame:
    named = pages.select("page_id", "url").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    return named.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))


def _conditional(baskets: DataFrame, names: list[str]) -> DataFrame:
    """item, before, n and n_bad: for each item of names (by falling frequency) of each basket the items before it."""

    def start() -> Callable[[dict], dict]:
        place = {t: i for i, t in enumerate(names)}

        def apply(batch: dict) -> dict:
            out = {"item": [], "before": [], "n": [], "n_bad": []}
            for items, n, n_bad in zip(batch["items"], batch["n"], batch["n_bad"], strict=True):
                own = sorted(place[t] for t in items if t in place)
                for k, i in enumerate(own):
                    for c, x in zip(out, (i, own[:k], n, n_bad), strict=True):
                        out[c].append(x)
            return out

        return apply

    every = map_rows(baskets, start, "item int, before array<int>, n long, n_bad long")
    return every.groupBy("item", "before").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))


def surely(n: int, n_bad: int, certainty: float) -> float:
    """The lower Wilson bound of a share of n_bad of n."""
    share, z = n_bad / n, certainty * certainty / n
    return (share + z / 2 - certainty * math.sqrt(max(share * (1 - share) / n + z / (4 * n), 0.0))) / (1 + z)


def _grown(conditional: DataFrame, least: int, confidence: float, rate: float, certainty: float) -> DataFrame:
    """items_ and confidence of the rules that end in each item. An item that all rows of a set have adds nothing to the
    set, and a rule no surer than one it grew from isn't kept: neither is grown further where no kept rule can follow."""

    def grow(items: tuple, n: int, base: dict, surest: float):
        counts: dict[int, list[int]] = {}
        for before, (k, k_bad) in base.items():
            for i in before:
                have = counts.setdefault(i, [0, 0])
                have[0] += k
                have[1] += k_bad
        for i, (k, k_bad) in counts.items():
            if k_bad >= least and k < n:
                yield from rule((*items, i), k, k_bad, {before: v for before, v in base.items() if i in before}, surest)

    def rule(items: tuple, n: int, n_bad: int, rows: dict, surest: float):
        if n_bad / n >= confidence and n_bad / n > surest and surely(n, n_bad, certainty) > rate:
            surest = n_bad / n
            yield [*items], surest
        if surest < 1:
            base: dict[tuple, tuple] = {}
            for before, (k, k_bad) in rows.items():
                own = before[: before.index(items[-1])] if len(items) > 1 else before
                have = base.get(own, (0, 0))
                base[own] = (have[0] + k, have[1] + k_bad)
            yield from grow(items, n, base, surest)

    def run(pdf):
        import pandas as pd

        rows = {tuple(map(int, b)): (int(k), int(k_bad)) for b, k, k_bad in zip(pdf.before, pdf.n, pdf.n_bad, strict=True)}
        found = rule((int(pdf["item"].iloc[0]),), int(pdf.n.sum()), int(pdf.n_bad.sum()), rows, -1.0)
        return pd.DataFrame([*islice(found, MAX_RULES + 1)], columns=["items_", "confidence"])

    return conditional.groupBy("item").applyInPandas(run, "items_ array<int>, confidence double")


def labelled_pages(labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1). A page is bad if the label of its id says it's of low quality or toxic; labels that say
    nothing are left out."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False))) | (F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, certainty: float = CERTAINTY) -> list[tuple[list[str], float]]:
    """(tokens, confidence) of the rules that call a page bad; pages without a label take no part. None are found where
    labels don't go with URLs."""
    known = labelled_pages(labels)
    baskets = split_urls(pages).join(known, "page_id").groupBy(tokens().alias("items")).agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"))
    n, n_bad = baskets.agg(F.sum("n"), F.sum("n_bad")).first()
    if not n_bad:
        return []
    least = max(1, math.ceil(support * n))
    # Tokens that reach the support, at most 1 / support times those of a URL.
    often = baskets.select(F.explode("items").alias("token"), "n", "n_bad").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")).where(F.col("n_bad") >= least)
    names = [r.token for r in often.orderBy(F.desc("n"), "token").collect()]
    rules = _grown(_conditional(baskets, names), least, confidence, n_bad / n, certainty)
    found = [(sorted(names[i] for i in r.items_), r.confidence) for r in rules.orderBy(F.desc("confidence"), F.size("items_"), "items_").limit(MAX_RULES + 1).collect()]
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: raise support or confidence")
    kept: list[tuple[list[str], float]] = []
    by_token: dict[str, list[int]] = {}
    for items, sure in sorted(found, key=lambda x: (len(x[0]), x[0])):
        own = set(items)
        near = {i for t in items for i in by_token.get(t, ())}
        if not any(kept[i][1] >= sure and own.issuperset(kept[i][0]) for i in near):
            by_token.setdefault(items[0], []).append(len(kept))
            kept.append((items, sure))
    return kept


def tried(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, certainty: float = CERTAINTY) -> DataFrame:
    """One row: of labelled pages that are held out (crc32 of the page_id modulo PARTS is 0), n_pages, n_bad, and of those
    that rules mined from the other pages block, n_blocked and n_blocked_bad."""
    out = F.crc32(F.col("page_id").cast("string")) % PARTS == 0
    judged = judge(pages.where(out), labels.where(F.crc32(F.col("doc_id").cast("string")) % PARTS != 0), (), support, confidence, certainty, pages)
    found = judged.join(labelled_pages(labels), "page_id")
    blocked = F.col("verdict") == "block"
    return found.agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"), F.count_if(blocked).alias("n_blocked"), F.count_if(blocked & (F.col("bad") == 1)).alias("n_blocked_bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, certainty: float = CERTAINTY, training: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the surest mined rule's tokens, else null) and confidence for each row of
    pages (page_id, url, more). Rules are mined from the same pages, or from those of training.

    A fixed rule that fits decides; else a mined rule that matches blocks, and all others are allowed. A null url or one
    without :// has an empty host and path, which no fixed rule fits. Without labels only fixed rules block. Repeated rows
    are judged each; an empty table gives no rows.
    """
    mined = mine(pages if training is None else training, labels, support, confidence, certainty)

    def start() -> Callable[[dict], dict]:
        often: dict[str, int] = {}
        for items, _ in mined:
            for t in items:
                often[t] = often.get(t, 0) + 1
        index: dict[str, list[tuple[float, frozenset]]] = {}
        for items, sure in mined:
            index.setdefault(min(items, key=lambda t: (often[t], t)), []).append((sure, frozenset(items)))

        def best(own: list[str]) -> tuple[str | None, float | None]:
            have = set(own)
            found = [(-sure, sorted(items)) for t in own for sure, items in index.get(t, ()) if items <= have]
            return (" ".join(min(found)[1]), -min(found)[0]) if found else (None, None)

        def apply(batch: dict) -> dict:
            rows = [best(x) if r is None else (None, None) for x, r in zip(batch["tokens"], batch["rule"], strict=True)]
            out = {k: batch[k] for k in ("page_id", "host", "path", "rule")}
            out["verdict"] = [v or ("block" if m else "allow") for v, (m, _) in zip(batch["verdict"], rows, strict=True)]
            return out | {"mined": [m for m, _ in rows], "confidence": [c for _, c in rows]}

        return apply

    split = split_urls(pages).withColumn("fixed", fixed_rule(rules)).select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("verdict"), tokens().alias("tokens"))
    return map_rows(split, start, "page_id long, host string, path string, rule string, verdict string, mined string, confidence double")
