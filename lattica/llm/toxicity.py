"""Toxicity by weak supervision.

Many weak voters look at a text. For toxic: a lexicon of insults, words and word beginnings that go with toxicity in labelled
documents, be it that they occur or that many of a text's words begin so, patterns and shouting. For clean: that none of them
says a thing, and prose that nobody objects to. A voter that has nothing to say abstains, which is no evidence.

A generative label model estimates, without looking at labels, how often each voter fires on toxic and on clean documents,
and which voters go together beyond that: the strongest such ties form a forest, in which a voter's rates depend on whether
its parent has fired. So witnesses who repeat each other count once. Its posteriors are the labels that a linear classifier
is fitted to, which scores every document; 0.5 is where the classifier's odds are even.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_rows
from .labelled import TRAINING_ROWS, held_out, training_sample

# Insults of four languages, as seeds of the lexicon.
INSULTS = (
    "asshole bastard bitch clown creep cretin disgusting dumb filth freak garbage idiot imbecile jerk loser lowlife moron pathetic scum stupid trash vermin worthless "
    "arschloch depp dreck idiotin schwachkopf trottel versager abschaum "
    "basura escoria idiota imbécil inútil patético payaso estúpido "
    "abruti connard crétin débile imbécile minable ordure stupide"
).split()
PATTERNS = (r"\byou(?:'re| are) (?:an? |such )?\w+ ?(?:idiot|moron|loser|clown|scum|trash)", r"\bshut up\b", r"\bkill yourself\b", r"\bhate (?:you|them)\b", r"\bgo to hell\b")
BEGINNINGS = (4, 5, 6, 7, 8)
#: A beginning is dense where two words or more have it, and one in so many of all.
DENSITIES = (50, 100, 200)
#: Mined voters: at most so many, each in so many documents and with such a share of toxic ones.
MINED, MINED_DOCS, MINED_SHARE = 400, 4, 0.9
#: Least evidence of a mined voter (log-likelihood ratio) beyond what the best of all candidates reaches by chance.
MINED_EVIDENCE = 4.0
#: Ties of voters within a class are modelled from this correlation on.
TIE = 0.2
_WORD = r"[^\W\d_]+"


def _distinct(sample: DataFrame) -> DataFrame:
    """One document of those that share their lowest three-word shingle hash, as copies of a text do: a word that only one
    text's copies share is no evidence. Texts without words are one document."""

    def start() -> Callable[[dict], dict]:
        from .shingles import Shingler

        shingler = Shingler(3)

        def apply(batch: dict) -> dict:
            lowest = []
            for _, hashes, counts in shingler.each(batch["text"]):
                lowest += [int(hashes[o : o + n].min().astype(np.int64)) if n else 0 for o, n in zip(np.cumsum(counts) - counts, counts, strict=True)]
            return {"doc_id": batch["doc_id"], "lowest": lowest}

        return apply

    # Of the bounded sample's rows, 16 bytes each.
    return sample.join(F.broadcast(map_rows(sample, start, "doc_id long, lowest long").groupBy("lowest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")), "doc_id")


def _keys(text: str | None, word: re.Pattern) -> set[tuple[str, str]]:
    """(kind, key) of all a text's words, their beginnings ("start4") and dense beginnings ("dense4/50")."""
    words = word.findall((text or "").lower())
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    keys = {("word", w) for w in counts}
    for n in BEGINNINGS:
        own: dict[str, int] = {}
        for w, k in counts.items():
            if len(w) > n:
                own[w[:n]] = own.get(w[:n], 0) + k
        keys |= {(f"start{n}", x) for x in own}
        keys |= {(f"dense{n}/{d}", x) for x, k in own.items() if k > 1 for d in DENSITIES if k * d >= len(words)}
    return keys


def _mine(sample: DataFrame, work: Workspace) -> list[tuple[str, str]]:
    """(kind, key) of the best voters, none that a better one's beginning has already."""

    def start() -> Callable[[dict], dict]:
        word = re.compile(_WORD)

        def apply(batch: dict) -> dict:
            out: dict[str, list] = {"kind": [], "key": [], "label": []}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for kind, key in _keys(text, word):
                    out["kind"].append(kind)
                    out["key"].append(key)
                    out["label"].append(label)
            return out

        return apply

    distinct = work.save(_distinct(sample), "distinct")
    total, toxic = distinct.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == total:
        return []
    counted = map_rows(distinct, start, "kind string, key string, label int").groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    counted = counted.where(F.col("n") >= MINED_DOCS)
    tried = counted.count()
    rate = toxic / total
    bits = lambda k, p: F.when(k > 0, k * F.log(k / F.col("n") / p)).otherwise(0.0)
    evidence = 2 * (bits(F.col("t"), rate) + bits(F.col("n") - F.col("t"), 1 - rate))
    least = 2 * np.log(max(tried, 1)) + MINED_EVIDENCE
    best = counted.where(F.col("t") >= MINED_SHARE * F.col("n")).withColumn("evidence", evidence).where(F.col("evidence") >= float(least))
    found: list[tuple[str, str]] = []
    for r in best.orderBy(F.desc("evidence"), "kind", "key").limit(10 * MINED).collect():
        if not any(kind != "word" and r.key.startswith(key) for kind, key in found):
            found.append((r.kind, r.key))
    return found[:MINED]


class Voters:
    """Which voters fire on a text. The first ones vote toxic, the last, from clean on, clean."""

    def __init__(self, mined: list[tuple[str, str]]):
        self.keys = list(dict.fromkeys([("word", w) for w in INSULTS] + mined + [("pattern", p) for p in PATTERNS] + [("rule", "shouting"), ("rule", "two different"), ("clean", "no objection"), ("clean", "calm prose")]))
        self.clean = len(self.keys) - 2
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.words = {k: i for (kind, k), i in self.place.items() if kind == "word"}
        self.starts = {n: own for n in BEGINNINGS if (own := {k: i for (kind, k), i in self.place.items() if kind == f"start{n}"})}
        self.dense: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for (kind, k), i in self.place.items():
            if kind.startswith("dense"):
                n, d = map(int, kind[5:].split("/"))
                self.dense.setdefault(n, {}).setdefault(k, []).append((d, i))
        self.word, self.patterns = re.compile(_WORD), [(re.compile(k), i) for (kind, k), i in self.place.items() if kind == "pattern"]

    def fired(self, text: str | None) -> set[int]:
        low = (text or "").lower()
        every = self.word.findall(low)
        words = set(every)
        out = {self.words[w] for w in words & self.words.keys()}
        different = len(out)
        for n, own in self.starts.items():
            found = {w[:n] for w in words if len(w) > n} & own.keys()
            out |= {own[k] for k in found}
            different = max(different, len(found))
        for n, own in self.dense.items():
            for x in {w[:n] for w in words if len(w) > n} & own.keys():
                k = sum(len(w) > n and w.startswith(x) for w in every)
                out |= {i for d, i in own[x] if k > 1 and k * d >= len(every)}
        for p, i in self.patterns:
            if p.search(low):
                out.add(i)
        objected = bool(out)
        shouted = bool(text) and sum(map(str.isupper, text)) > 0.7 * sum(map(str.isalpha, text)) > 20
        if shouted:
            out.add(self.place["rule", "shouting"])
        if different > 1:
            out.add(self.place["rule", "two different"])
        if not objected:
            out.add(self.place["clean", "no objection"])
            if not shouted and len(every) >= 20 and "!" not in low:
                out.add(self.place["clean", "calm prose"])
        return out


def forest(votes: np.ndarray, posterior: np.ndarray, least: float = TIE) -> np.ndarray:
    """Each voter's parent, -1 for a root: the strongest correlations within the classes that form no circle."""
    p = posterior[:, None].astype(np.float32)
    yes, no = (p * votes).sum(0) / max(float(p.sum()), 1e-6), ((1 - p) * votes).sum(0) / max(float((1 - p).sum()), 1e-6)
    rest = votes - p * yes - (1 - p) * no
    scale = np.sqrt((rest**2).mean(0) + 1e-9)
    together = np.triu(rest.T @ rest / len(rest) / scale[:, None] / scale[None, :], 1)
    a, b = np.nonzero(together >= least)
    order = np.lexsort((b, a, -together[a, b]))
    near: list[list[int]] = [[] for _ in range(votes.shape[1])]
    group = list(range(votes.shape[1]))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, j in zip(a[order].tolist(), b[order].tolist()):
        if top(i) != top(j):
            group[top(j)] = top(i)
            near[i].append(j)
            near[j].append(i)
    parent = np.full(votes.shape[1], -1)
    seen = np.zeros(votes.shape[1], bool)
    for root in np.argsort(-votes.sum(0), kind="stable").tolist():
        held = [] if seen[root] else [root]
        seen[root] = True
        while held:
            i = held.pop()
            for j in near[i]:
                if not seen[j]:
                    parent[j], seen[j] = i, True
                    held.append(j)
    return parent


def label_model(votes: np.ndarray, prior: float, clean: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of being toxic, and each voter's parent, from votes alone (rows by voters; those from clean on vote clean).

    EM on a two-class model. prior, the share of toxic documents, stays fixed, and every voter is held to be better than
    chance, which names the classes. A voter's log odds, where it fires, come from its rates in the classes, given whether
    its parent in the forest has fired; rates start from those of both classes together, as two documents' worth.
    """
    n, m = votes.shape
    odds = np.log(prior / (1 - prior))
    posterior = np.where(votes[:, :clean].sum(1) > 0, 0.9, prior / 4)
    parent = np.full(m, -1)
    sign = np.where(np.arange(m) < clean, 1.0, -1.0)
    for r in range(rounds):
        if r in (2, 6):
            parent = forest(votes, posterior)
        linked = np.flatnonzero(parent >= 0)
        given = np.ones((n, m), np.float32)  # where the parent has fired; all rows for a root
        given[:, linked] = votes[:, parent[linked]]
        weights = []
        for where in (given, 1 - given):
            both = np.maximum(where.sum(0), 1e-6)
            pooled = np.clip((where * votes).sum(0) / both, 1e-6, 1)
            rate = [((p[:, None] * where * votes).sum(0) + 2 * pooled) / ((p[:, None] * where).sum(0) + 2) for p in (posterior, 1 - posterior)]
            weights.append(np.maximum(sign * np.log(rate[0] / rate[1]), 0) * sign)
        evidence = (votes * (given * weights[0] + (1 - given) * weights[1])).sum(1)
        posterior = 1 / (1 + np.exp(-np.clip(odds + evidence, -30, 30)))
    return posterior, parent


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels."""
    w, b = np.zeros(x.shape[1] + 1), None
    full = np.hstack([x, np.ones((len(x), 1))])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) / len(y) + decay * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> dict:
    """The mined voters, their weights and the classifier. Votes and labels of at most bound documents come to the driver."""
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.save(training_sample(docs, labels, "toxic", bound), "sample")
    mined = _mine(sample, work)

    def start() -> Callable[[dict], dict]:
        voters = Voters(mined)
        return lambda batch: {"doc_id": batch["doc_id"], "fired": [sorted(voters.fired(t)) for t in batch["text"]], "label": batch["label"]}

    rows = map_rows(sample, start, "doc_id long, fired array<int>, label int").toPandas().sort_values("doc_id")
    work.drop("sample", "distinct")
    voters = Voters(mined)
    votes = np.zeros((len(rows), len(voters.keys)), np.float32)
    for i, fired in enumerate(rows.fired):
        votes[i, list(fired)] = 1
    labels_ = rows.label.to_numpy()
    lexicon = np.array([kind in ("word", "pattern") for kind, _ in voters.keys])
    if not len(rows) or labels_.min() == labels_.max():
        return {"mined": mined, "w": np.where(lexicon, 3.0, 0.0), "b": -1.5}
    posterior, _ = label_model(votes, float(labels_.mean()), voters.clean)
    w, b = fit_linear(votes, posterior)
    # Voters that never fired in training keep what the lexicon says of them.
    return {"mined": mined, "w": np.where((votes.sum(0) == 0) & lexicon, max(3.0, -b + 1), w), "b": b}


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, more).

    A null text is an empty one, on which no voter for toxic fires. A row without a doc_id isn't held out. Without labels of
    both kinds the fixed lexicon alone decides. An empty table gives no rows, and repeated rows one each. A text's words are
    in memory at once, as the text is.
    """
    model = learn(docs, labels, bound)

    def start() -> Callable[[dict], dict]:
        voters = Voters(model["mined"])

        def apply(batch: dict) -> dict:
            odds = np.array([model["b"] + sum(model["w"][i] for i in voters.fired(t)) for t in batch["text"]])
            return {"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(odds, -30, 30)))}

        return apply

    scored = map_rows(docs.select("doc_id", "text"), start, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
