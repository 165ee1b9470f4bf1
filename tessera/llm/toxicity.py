"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model over their votes, a linear classifier on its posteriors.

1. Lexicons are mined from a bounded sample of labelled rows: words and word beginnings that toxic texts surely hold far
   more often than others. They are dealt to several voters by kind and hash, so that voters err apart from each other.
   Lexicons of common insults and threats and patterns of abuse vote beside them.
2. Votes of all documents are counted by pattern (2^voters patterns at most, with the label of rows that may teach).
   Expectation maximization estimates each voter's firing rates by class and, along a tree of the strongest dependences
   within a class, its rates given another voter's vote: accuracies and correlations. The given label is one more
   voter, which mostly abstains and whose rate of errors is estimated too (at most MOST_ERRORS).
3. A logistic regression over words and beginnings and over the pattern voters is fit to the posteriors of a bounded
   sample of rows, labelled or not. Its features are all whose counts differ beyond chance between the classes; how far
   beyond, and the weight of unlabelled rows, are chosen by a fold of the labelled rows that may teach.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import persist_table, small_enough

WORD = re.compile(r"[^\W\d_]+")
# Common insults, and patterns of abuse.
SEED_WORDS = ("idiot", "moron", "loser", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "filth", "garbage", "imbecile", "hate", "vermin")
THREAT_WORDS = ("kill you", "kill yourself", "hurt you", "destroy you", "shut up", "get lost", "drop dead", "go to hell")
SEED = re.compile(r"\b(?:" + "|".join(SEED_WORDS) + r")\b", re.IGNORECASE)
THREAT = re.compile(r"\b(?:" + "|".join(THREAT_WORDS) + r")\b", re.IGNORECASE)
ADDRESS = re.compile(r"\b(you|your|du|ihr|tu|vous|eres|usted)\b[^.!?\n]{0,40}!", re.IGNORECASE)
SHOUT = re.compile(r"[!?]{2,}")
MASKED = re.compile(r"[^\W\d_][*#@$%]{2,}")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
PREFIXES = (4, 5, 6)
#: Features stand in so many sampled rows at least; G from which a feature counts and the weight of rows without a label are
#: chosen from LEVELS (chances of about 1 in 100, 1,000 and 10,000) and SOFT by a fold of the labelled rows. A voter's words
#: have a G of VOTER_G at least, which chance does not give any of some million words. Labels are wrong in MOST_ERRORS of all
#: rows of a class at most.
LEAST_ROWS, LEVELS, SOFT, VOTER_G, MOST_ERRORS = 3, (6.6, 10.8, 15.1), (1.0, 0.1), 30.0, 0.002
#: Voters by mined words (one group each), by a dense text of them, and those that know no mined feature: a voter's place is its bit.
GROUPS = ("word0", "word1", "begin0", "begin1", "begin2")
PATTERNS = {"seed": SEED, "threat": THREAT, "address": ADDRESS, "shout": SHOUT, "masked": MASKED, "stretched": STRETCHED}
VOTERS = (*GROUPS, "dense", *PATTERNS, "upper")
DENSE, UPPER = VOTERS.index("dense"), VOTERS.index("upper")
#: The voters that are features of the classifier themselves.
OWN = (*PATTERNS, "upper")
OWN_BITS = np.array([VOTERS.index(v) for v in OWN])
ASCII_UPPER, NOT_ASCII = bytes(range(65, 91)), re.compile(r"[^\x00-\x7f]")


def word_features(word: str) -> list[str]:
    """A lower-cased word and its beginnings (marked by a hyphen)."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


class Lookup:
    """Feature numbers of words; what a word gives is found once."""

    def __init__(self, features: dict[str, int]):
        self.features, self.memo = features, {}

    def __call__(self, text: str) -> np.ndarray:
        memo, out = self.memo, set()
        for w in set(WORD.findall(text.lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) > 500_000:
                    memo.clear()
                memo[w] = got = tuple(self.features[f] for f in word_features(w) if f in self.features)
            if got:
                out.update(got)
        return np.fromiter(out, dtype=np.int64, count=len(out))


def _fold(id_col: Column) -> Column:
    """A quarter of the rows, by a hash: cuts are chosen by them."""
    return _rank(id_col, "fold:") < 0.25


def _rank(id_col: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _surprise(n0: Column, n1: Column, rows0: int, rows1: int) -> Column:
    """The likelihood ratio statistic (G) of a feature's counts against equal shares in both classes."""
    def part(n: Column, rows: int) -> Column:
        share = (n0 + n1) / F.lit(float(rows0 + rows1))
        term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        return term(n, share * rows) + term(F.lit(rows) - n, (F.lit(1.0) - share) * rows)

    return 2 * (part(n0, rows0) + part(n1, rows1))


def mine(rows: DataFrame, sample: int) -> pd.DataFrame | None:
    """Features of labelled rows (id, text, toxic) whose shares in toxic and clean texts differ beyond chance, the surest first.

    About `sample` rows of each class are read (by a hash of the id): a bound of the fit, which bounds the features as well. g and odds: G and log odds over these rows; g_fit: G over
    those outside the test fold. None without rows of both classes.
    """
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return None
    part = rows.filter(_rank(F.col("id"), "mine:") <= F.when(F.col("toxic") == 1, min(1.0, sample / size[1])).otherwise(min(1.0, sample / size[0]))).withColumn("fold", _fold(F.col("id")))
    held = {(r["toxic"], r["fold"]): r["n"] for r in part.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    fit = [held.get((y, False), 0) for y in (0, 1)]
    every = [fit[y] + held.get((y, True), 0) for y in (0, 1)]
    names = ("a0", "a1", "b0", "b1")

    def count(batches):
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for t, y, b in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                for f in {f for w in set(WORD.findall(t.lower())) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0, 0, 0])[2 * int(b) + int(y)] += 1
            if seen:
                yield pd.DataFrame({"f": list(seen)} | {c: [v[i] for v in seen.values()] for i, c in enumerate(names)})

    got = part.select("text", "toxic", "fold").mapInPandas(count, "f string, " + ", ".join(f"{c} long" for c in names)).groupBy("f").agg(*[F.sum(c).alias(c) for c in names])
    got = got.filter(F.col("a0") + F.col("a1") + F.col("b0") + F.col("b1") >= LEAST_ROWS)
    got = got.select("f", "a0", "a1", (F.col("a0") + F.col("b0")).alias("n0"), (F.col("a1") + F.col("b1")).alias("n1"))
    got = got.withColumn("g", _surprise(F.col("n0"), F.col("n1"), *every)).withColumn("g_fit", _surprise(F.col("a0"), F.col("a1"), *fit) if min(fit) else F.lit(0.0))
    got = got.withColumn("odds", F.log((F.col("n1") + 0.5) / (every[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (every[0] + 1.0)))
    top = got.filter(F.greatest("g", "g_fit") >= min(LEVELS)).orderBy(F.desc("g"), "f").toPandas()
    # Voters are sure of what they name: fifty times as common in toxic texts as in others, or as near to that as few rows can show.
    top["votes"] = (top["g"] >= VOTER_G) & (top["odds"] >= 3.8) & (top["n0"] * every[1] * 50 <= top["n1"] * every[0])
    return top


def uppers(text: str) -> int:
    """The number of upper-case letters of a whole text."""
    b = text.encode()
    n = len(b) - len(b.translate(None, ASCII_UPPER))
    return n if len(b) == len(text) else n + sum(map(str.isupper, NOT_ASCII.findall(text)))


def votes(text: str, hit: np.ndarray, group: np.ndarray) -> int:
    """The voters that fire, as bits; features of group -1 have no voter. Every voter reads the whole text."""
    out, hit = 0, hit[group[hit] >= 0]
    if hit.size:
        for g in np.unique(group[hit]):
            out |= 1 << int(g)
        out |= int(np.count_nonzero(group[hit] < 2) >= 2 or hit.size >= 4) << DENSE
    for bit, pattern in enumerate(PATTERNS.values(), DENSE + 1):
        out |= int(pattern.search(text) is not None) << bit
    return out | int(2 * uppers(text) > len(text)) << UPPER


class LabelModel:
    """P(votes | class) as a tree: each voter depends on the class and on one other voter at most."""

    def fit(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 30) -> LabelModel:
        """patterns: vote bits; labels: 0, 1 or -1 (unknown); counts: rows of each."""
        m = len(VOTERS)
        v = ((patterns[:, None] >> np.arange(m)) & 1).astype(np.int64)
        known = labels >= 0
        prior = (counts[known & (labels == 1)].sum() + 0.5) / (counts[known].sum() + 1.0) if known.any() else 0.1
        self.prior = float(np.clip(prior, 1e-3, 0.5))
        self.errors = np.full(2, MOST_ERRORS)  # how often rows of a class have the other label
        q = np.where(known, labels == 1, np.where(v[:, : DENSE + 2].any(axis=1), 0.6, 0.05)).astype(float)
        self.parent, self.order = np.full(m, -1), list(range(m))
        for k in range(rounds):
            w = np.stack([counts * (1 - q), counts * q])
            if k == 5:
                self._tree(v, w)
            self.rate = np.zeros((2, m, 2))  # [class, voter, parent's vote]
            for y in (0, 1):
                wrong = w[y][labels == 1 - y].sum()
                self.errors[y] = min(MOST_ERRORS, (wrong + 0.5) / (w[y][known].sum() + 1.0))
                for j in range(m):
                    p = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), dtype=np.int64)
                    own = (w[y] * v[:, j]).sum() / max(w[y].sum(), 1e-9)
                    for s in (0, 1):
                        at = p == s
                        self.rate[y, j, s] = ((w[y] * v[:, j] * at).sum() + 2 * own + 0.01) / ((w[y] * at).sum() + 2 + 0.02)
            q = self.posterior(patterns, labels)
        return self

    def _tree(self, v: np.ndarray, w: np.ndarray) -> None:
        """Maximum spanning tree over the mutual information of two voters within the classes."""
        m = v.shape[1]
        info = np.zeros((m, m))
        for y in (0, 1):
            t = max(w[y].sum(), 1e-9)
            for i in range(m):
                for j in range(i):
                    for a in (0, 1):
                        for b in (0, 1):
                            p = w[y][(v[:, i] == a) & (v[:, j] == b)].sum() / t
                            pi, pj = w[y][v[:, i] == a].sum() / t, w[y][v[:, j] == b].sum() / t
                            if p > 0:
                                info[i, j] += t * p * np.log(p / (pi * pj))
        info += info.T
        self.order, rest = [0], set(range(1, m))
        while rest:
            i, j = max(((i, j) for i in self.order for j in rest), key=lambda x: (info[x], -x[1], -x[0]))
            self.parent[j] = i
            self.order.append(j)
            rest.remove(j)

    def posterior(self, patterns: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes, label); rows without a label (-1) are told by their votes."""
        v = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.int64)
        labels = np.full(len(v), -1) if labels is None else labels
        lp = []
        for y, p0 in ((0, 1 - self.prior), (1, self.prior)):
            s = np.full(len(v), np.log(p0))
            for j in range(v.shape[1]):
                r = self.rate[y, j][v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), dtype=np.int64)]
                s += np.where(v[:, j] == 1, np.log(r), np.log1p(-r))
            lp.append(s + np.where(labels < 0, 0.0, np.where(labels == y, np.log1p(-self.errors[y]), np.log(self.errors[y]))))
        return 1 / (1 + np.exp(np.clip(lp[0] - lp[1], -50, 50)))


class Rows:
    """Rows of features as two arrays: the row and the feature of each hit. Pattern voters are the features after the mined ones."""

    def __init__(self, hits, votes: np.ndarray, features: int):
        n = [len(h) for h in hits]
        fired = (votes[:, None] >> OWN_BITS) & 1
        r, c = np.nonzero(fired)
        self.row = np.concatenate([np.repeat(np.arange(len(n)), n), r])
        self.col = np.concatenate([*[np.asarray(h, dtype=np.int64) for h in hits], features + c])
        self.rows, self.features = len(n), features + len(OWN)

    def fit(self, q: np.ndarray, weight: np.ndarray, use: np.ndarray, steps: int = 60, decay: float = 2e-4, least: float = 1e-7) -> np.ndarray:
        """Logistic regression on soft labels over the features in use; the last weight is the bias.

        Newton's method on the convex loss: each step solves its linear system by conjugate gradients and is halved until the
        loss falls enough. It ends where the gradient's norm is under `least`, so the weights do not depend on the number of steps.
        """
        at = use[self.col] & (weight > 0)[self.row]
        row, col = self.row[at], self.col[at]
        share = weight / max(weight.sum(), 1e-12)
        shrink = np.append(np.full(self.features, decay), 0.0)
        forward = lambda w: np.bincount(row, w[col], self.rows) + w[-1]
        back = lambda d: np.append(np.bincount(col, d[row], self.features), d.sum())
        value = lambda z, w: float((share * (np.logaddexp(0, z) - q * z)).sum() + 0.5 * (shrink * w * w).sum())
        w = np.zeros(self.features + 1)
        z = forward(w)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            g = back((p - q) * share) + shrink * w
            norm = np.linalg.norm(g)
            if norm <= least:
                break
            h = p * (1 - p) * share
            scale = 1 / (back(h) + shrink + 1e-12)
            s, r = np.zeros_like(w), -g
            y = scale * r
            d, rho = y.copy(), r @ y
            for _ in range(200):
                hd = back(h * forward(d)) + shrink * d
                bend = d @ hd
                if bend <= 0:
                    break
                s += rho / bend * d
                r -= rho / bend * hd
                if np.linalg.norm(r) <= min(0.1, norm**0.5) * norm:
                    break
                y = scale * r
                rho, old = r @ y, rho
                d = y + rho / old * d
            if not s.any():
                break
            now, step, dz, slope = value(z, w), 1.0, forward(s), g @ s
            while step > 1e-8 and value(z + step * dz, w + step * s) > now + 1e-4 * step * slope:
                step /= 2
            if step <= 1e-8:
                break
            w, z = w + step * s, z + step * dz
        return w

    def loss(self, w: np.ndarray, q: np.ndarray, at: np.ndarray) -> float:
        """Mean log loss of the rows `at`."""
        p = 1 / (1 + np.exp(-np.clip(np.bincount(self.row, w[self.col], self.rows) + w[-1], -40, 40)))
        return float(-np.mean(q[at] * np.log(p[at] + 1e-9) + (1 - q[at]) * np.log(1 - p[at] + 1e-9)))


def surprise(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """G of counts against equal shares in both classes, as mine() has it for words."""
    share, out = (n0 + n1) / max(rows0 + rows1, 1), np.zeros(len(n0))
    for n, rows in ((n0, rows0), (n1, rows1)):
        for k, e in ((n, share * rows), (rows - n, (1 - share) * rows)):
            out += np.where(k > 0, 2 * k * np.log(np.maximum(k, 1) / np.maximum(e, 1e-9)), 0.0)
    return out


def fit_chosen(x: Rows, q: np.ndarray, label: np.ndarray, fold: np.ndarray, g: np.ndarray, g_fit: np.ndarray) -> np.ndarray:
    """Weights fit to the posteriors q, with the least G (of words as counted, of pattern voters among the labels here) and the weight of
    unlabelled rows (label -1) that do best on the labels of the fold, whose counts choose no feature there."""
    labelled = label >= 0

    def of_patterns(at: np.ndarray) -> np.ndarray:
        n = [np.bincount(x.col[(at & (label == y))[x.row]], minlength=x.features)[len(g) :] for y in (0, 1)]
        return surprise(*n, int((at & (label == 0)).sum()), int((at & (label == 1)).sum()))

    g, g_fit = np.append(g, of_patterns(labelled)), np.append(g_fit, of_patterns(labelled & ~fold))
    use = lambda g, level: g >= level
    level, soft, test = LEVELS[1], SOFT[0], fold & labelled
    if len(np.unique(label[test])) == 2 and len(np.unique(label[labelled & ~fold])) == 2:
        losses = {(lv, u): x.loss(x.fit(q, np.where(labelled, 1.0, u) * ~fold, use(g_fit, lv)), label, test) for lv in LEVELS for u in SOFT}
        level, soft = min(losses, key=losses.get)
    return x.fit(q, np.where(labelled, 1.0, soft), use(g, level))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels has id_col and label_col (0, 1; rows with null in either, and rows of an id with both labels, teach nothing).
    Rows where held_out is true give no labels. Bounds of the fit: `sample` labelled rows of each class that lexicons are mined
    from, and as many of each class that the classifier is fit on (half as many more have no label); every feature whose counts
    in that sample differ beyond chance is used, and votes are counted over all rows. Very long texts are read whole. Null texts are empty. Ids may be of any type, and null; repeated rows get equal
    scores. Without labelled rows of both classes every score is 0; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    y = labels.select(F.col(id_col).cast(id_type).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("id", "toxic")
    y = F.broadcast(y) if small_enough(y, 500_000) else y
    taught = d.filter(~F.col("held_out")).join(y, "id")
    mined = mine(taught, sample)
    nothing = d.select(F.col("id").alias("doc_id"), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    if mined is None:
        return nothing
    names = mined["f"].tolist()
    group = np.array([-1 if not sure else zlib.crc32(f.encode()) % 2 if not f.endswith("-") else 2 + zlib.crc32(f[:4].encode()) % 3 for f, sure in zip(names, mined["votes"], strict=True)], dtype=np.int64)
    model = spark.sparkContext.broadcast((names, group))

    def lookup():
        names, group = model.value
        return Lookup({f: i for i, f in enumerate(names)}), group

    # One pass over all texts: votes and found features of each row. The label travels with rows that may teach, ids travel as text.
    marked = d.join(y, "id", "left").select(F.col("id").cast("string").alias("id"), "held_out", "text", F.when(F.col("held_out"), -1).otherwise(F.coalesce("toxic", F.lit(-1))).alias("y"))

    def vote(batches):
        find, group = lookup()
        for pdf in batches:
            hits = [find(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "y": pdf["y"], "votes": [votes(t, h, group) for t, h in zip(pdf["text"], hits, strict=True)], "hits": [h.astype(np.int32) for h in hits]})

    voted = persist_table(marked.mapInPandas(vote, "id string, held_out boolean, y int, votes int, hits array<int>"), "votes")
    seen = voted.groupBy("votes", "y").agg(F.count("*").alias("n")).toPandas()  # at most 3 * 2^voters rows
    if not len(seen):
        return nothing
    pattern, label, n = (seen[c].to_numpy(dtype=np.int64) for c in ("votes", "y", "n"))
    label_model = LabelModel().fit(pattern, label, n.astype(float))
    q = label_model.posterior(pattern, label)
    # About 3 * sample rows at most: two thirds of them labelled, half of each likely toxic.
    side = 2 * (label >= 0) + (q > 0.5)
    rows = np.bincount(side, weights=n, minlength=4)
    share = np.minimum(1.0, sample / np.where(label >= 0, 1, 2) / rows[side])
    table = spark.createDataFrame(list(zip(pattern.tolist(), label.tolist(), q.tolist(), share.tolist(), strict=True)), "votes int, y int, q double, share double")
    drawn = voted.join(F.broadcast(table), ["votes", "y"]).filter(_rank(F.col("id"), "fit:") < F.col("share"))
    # Rows of one id are drawn together, however many: what reaches the driver is bounded by rank.
    first = F.row_number().over(Window.partitionBy("y", F.col("q") > 0.5).orderBy(_rank(F.col("id"), "fit:"), "votes"))
    drawn = drawn.withColumn("place", first).filter(F.col("place") <= 2 * sample)
    fit = drawn.select("votes", "y", "hits", "q", _fold(F.col("id")).alias("fold")).toPandas()
    x = Rows(fit["hits"].tolist(), fit["votes"].to_numpy(dtype=np.int64), len(names))
    w = fit_chosen(x, fit["q"].to_numpy(), fit["y"].to_numpy(), fit["fold"].to_numpy(dtype=bool), mined["g"].to_numpy(), mined["g_fit"].to_numpy()) if len(fit) else np.zeros(len(names) + len(OWN) + 1)
    weights = spark.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def score(hits: pd.Series, votes: pd.Series) -> pd.Series:
        w = weights.value
        own = ((votes.to_numpy(dtype=np.int64)[:, None] >> OWN_BITS) & 1) @ w[-1 - len(OWN) : -1] + w[-1]
        z = own + np.array([w[np.asarray(h, dtype=np.int64)].sum() for h in hits])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return voted.select(F.col("id").cast(id_type).alias("doc_id"), "held_out", score("hits", "votes").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
