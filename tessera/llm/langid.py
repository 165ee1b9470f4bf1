"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the lowered bytes of a whole text, blanks and marks included, and gives every byte a probability for each
language; a document's probability is the mean over all its letter bytes. It is a network over windows, for texts of any
length alike: every byte belongs to one window of CORE bytes, in which both directions run from CONTEXT bytes before to
CONTEXT bytes after it, as far as the text goes. It was trained on windows of TRAINED bytes and never sees further.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, slices

CORE, CONTEXT, HIDDEN = 192, 32, 8
#: Bytes of a training window.
TRAINED = 64
UND = "und"
#: Bytes of words: ASCII letters and all of non-ASCII UTF-8.
LETTER = np.zeros(256, dtype=np.float32)
LETTER[97:123] = 1
LETTER[128:] = 1


def windows(run: list[bytes], together: int = 1024):
    """(bytes, inside, text) of up to `together` windows of a run of texts at a time: the lowered bytes [window, CONTEXT + CORE + CONTEXT],
    which of them stand in the text, and the text of each window."""
    lens = np.fromiter((len(b) for b in run), dtype=np.int64, count=len(run))
    n = -(-lens // CORE)
    of = np.repeat(np.arange(len(run)), n)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * CORE - CONTEXT
    base = np.cumsum(lens) - lens
    a = LOWER[np.frombuffer(b"".join(run), dtype=np.uint8)]
    for i in range(0, len(of), together):
        some = of[i : i + together]
        at = start[i : i + together, None] + np.arange(CORE + 2 * CONTEXT)
        inside = (at >= 0) & (at < lens[some][:, None])
        at += base[some][:, None]
        at[~inside] = 0
        x = a[at]
        x[~inside] = 0
        yield x, inside, some


class BiGRU:
    """Weights by name: for each direction d in f, b: Wd [256, 3H] (by byte; gates update, reset, new), Ud [H, 3H]; V [2H, C], c [C]."""

    def __init__(self, n_langs: int, hidden: int = HIDDEN, seed: int = 7):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {"V": r.normal(0, 0.3, (2 * h, n_langs)), "c": np.zeros(n_langs)}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.3, (256, 3 * h)), f"U{d}": r.normal(0, 0.4, (h, 3 * h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, inside: np.ndarray, keep: dict[str, list] | None = None) -> np.ndarray:
        """[direction, step, window, H] of both directions, which run side by side; outside of the text the state stays zero. keep gets
        what backpropagation needs."""
        h, (n, steps) = self.h, x.shape
        dtype = self.p["V"].dtype
        # Arrays are [gate, direction, ...], so that all steps but the products work on contiguous memory. Gates are 1 / (1 + exp(v)), new is
        # 2 / (1 + exp(v)) - 1: factors of v go into the weights. The row past the bytes stands for what is outside: it shuts both gates.
        factor = np.array([-1, -1, -2], dtype=dtype)[:, None, None, None]
        w = np.zeros((3, 2, 257, h), dtype=dtype)
        w[:, :, :256] = np.stack([self.p["Wf"], self.p["Wb"]]).reshape(2, 256, 3, h).transpose(2, 0, 1, 3) * factor
        w[:2, :, 256] = 1e4
        u = np.stack([self.p["Uf"], self.p["Ub"]]).reshape(2, h, 3, h).transpose(2, 0, 1, 3) * factor
        xt = x.T.astype(np.intp, order="C")
        xt[~inside.T] = 256
        out = np.empty((2, steps, n, h), dtype=dtype)
        s, new = np.zeros((2, n, h), dtype=dtype), np.empty((2, n, h), dtype=dtype)
        g, k = np.empty((3, 2, n, h), dtype=dtype), np.empty((3, 2, n, h), dtype=dtype)
        zr, tables, gates = g[:2], w.reshape(6, 257, h), g.reshape(6, n, h)
        with np.errstate(over="ignore"):  # exp is infinite where a gate is shut
            for t in range(steps):
                b = steps - 1 - t
                for table, at, to in zip(tables, (t, b) * 3, gates, strict=True):
                    table.take(xt[at], 0, to, "clip")
                np.matmul(s, u, out=k)
                zr += k[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[1], k[2], out=new)
                new += g[2]
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                if keep is not None:
                    for i, d, at in ((0, "f", t), (1, "b", b)):
                        keep[d].append((at, s[i].copy(), zr[0, i].copy(), zr[1, i].copy(), new[i].copy(), k[2, i] * dtype.type(-0.5)))
                s -= new
                s *= zr[0]
                s += new
                out[0, t], out[1, b] = s
        return out

    def _softmax(self, both: np.ndarray) -> np.ndarray:
        """[step, window, C], which lies in memory by language."""
        h, (_, steps, n, _) = self.h, both.shape
        y = self.p["V"][:h].T @ both[0].reshape(-1, h).T
        y += self.p["V"][h:].T @ both[1].reshape(-1, h).T
        y += self.p["c"][:, None]
        y -= y.max(axis=0)
        np.exp(y, out=y)
        y /= y.sum(axis=0)
        return np.moveaxis(y.reshape(-1, steps, n), 0, 2)

    def probabilities(self, x: np.ndarray, inside: np.ndarray | None = None, core: slice = slice(None)) -> np.ndarray:
        """[step, window, C] of the steps in core."""
        return self._softmax(self.states(x, np.ones(x.shape, dtype=bool) if inside is None else inside)[:, core])

    def gradients(self, x: np.ndarray, lang: np.ndarray, inside: np.ndarray | None = None, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions with a weight ([window, step]; without, all)."""
        h, kept, grads = self.h, {"f": [], "b": []}, {}
        inside = np.ones(x.shape, dtype=bool) if inside is None else inside
        weight = np.ones(x.shape) if weight is None else weight
        both = self.states(x, inside, kept)
        y = self._softmax(both)
        y[:, np.arange(len(x)), lang] -= 1
        y *= (weight.T / max(weight.sum(), 1)).astype(y.dtype)[:, :, None]
        grads["V"], grads["c"] = np.concatenate([np.tensordot(side, y, ([0, 1], [0, 1])) for side in both]), y.sum((0, 1))
        back = y @ self.p["V"].T
        for i, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            gw, gu, ds = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(u), np.zeros((len(x), h), dtype=u.dtype)
            for t, s, z, r, n, kn in reversed(kept[d]):
                ds = (ds + back[t][:, i * h : (i + 1) * h]) * inside[:, t : t + 1]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * kn * r * (1 - r)
                pre = np.concatenate([dz, dr, dn], axis=1)
                rec = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gw, x[:, t], pre)
                gu += s.T @ rec
                ds = ds * z + rec @ u.T
            grads[f"W{d}"], grads[f"U{d}"] = gw, gu
        return grads

    def fit(self, x: np.ndarray, inside: np.ndarray, lang: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over random batches of windows; letters alone have a label."""
        r = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        parts = -(-len(x) // batch)
        for _ in range(epochs):
            for some in np.array_split(r.permutation(len(x)), parts):
                step += 1
                lr = rate * (1 - 0.9 * step / (epochs * parts))
                for name, g in self.gradients(x[some], lang[some], inside[some], LETTER[x[some]] * inside[some]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] -= (lr * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(self.p[name].dtype)


def pooled(net: BiGRU, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's probabilities over its letter bytes [text, C], and their number."""
    core = slice(CONTEXT, CONTEXT + CORE)
    total, letters = np.zeros((len(run), len(net.p["c"]))), np.zeros(len(run))
    for x, inside, of in windows(run):
        weight = (LETTER[x[:, core]] * inside[:, core]).T
        y = net.probabilities(x, inside, core)
        y *= weight[:, :, None]
        np.add.at(total, of, y.sum(axis=0))
        np.add.at(letters, of, weight.sum(axis=0))
    return total, letters


def _sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int, windows_each: int) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows of TRAINED bytes of about per_lang documents of each language (chosen by a hash of the id), windows_each spread over each text."""
    rows = docs.filter(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros(0, dtype=np.int64), []
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.2 * per_lang / sizes[k]))])
    u = F.conv(F.substring(F.md5(F.concat(F.lit("langid:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0

    def cut(batches):
        for pdf in batches:
            out = []
            for t, lang, rank in zip(pdf["text"], pdf["lang"], pdf["u"], strict=True):
                b = t.encode()
                for at in np.unique(np.linspace(0, max(0, len(b) - TRAINED), windows_each).astype(np.int64)):
                    w = LOWER[np.frombuffer(b[at : at + TRAINED], dtype=np.uint8)]
                    if LETTER[w].any():
                        out.append((w.tobytes(), lang, rank))
            if out:
                yield pd.DataFrame(out, columns=["w", "lang", "u"])

    got = rows.withColumn("u", u).filter(F.col("u") <= F.element_at(share, F.col("lang"))).select("text", "lang", "u").mapInPandas(cut, "w binary, lang string, u double")
    # Rows of one id are drawn together, however many: what reaches the driver is bounded by rank.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "w"))
    got = got.withColumn("place", place).filter(F.col("place") <= per_lang * windows_each).toPandas().sort_values(["u", "w"])
    return [bytes(b) for b in got["w"]], got["lang"].map(langs.index).to_numpy(dtype=np.int64), langs


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, windows_each: int = 4, steps: int = 300) -> tuple[BiGRU | None, list[str]]:
    """A network fit on at most per_lang * windows_each windows of TRAINED bytes of each language: a bounded sample, whatever the input."""
    w, y, langs = _sample(docs, learn, id_col, text_col, lang_col, per_lang, windows_each)
    if not w:
        return None, []
    lens = np.array([len(b) for b in w])
    x = np.frombuffer(b"".join(b.ljust(TRAINED, b"\0") for b in w), dtype=np.uint8).reshape(len(w), TRAINED)
    net = BiGRU(len(langs))
    net.fit(x, np.arange(TRAINED) < lens[:, None], y, max(2, steps // -(-len(x) // 128)))
    return net, langs


def identify(docs: DataFrame, net: BiGRU | None, langs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns as a struct r, with lang_pred and score.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no language was learned. Other
    texts get the language with the largest mean probability (ties: the first by name), which is the score.
    """
    held = docs.sparkSession.sparkContext.broadcast((net, langs))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.when(text.rlike(r"\p{L}"), text).alias("t"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(t: pd.Series) -> pd.DataFrame:
        net, langs = held.value
        pred, score = np.full(len(t), UND, dtype=object), np.zeros(len(t))
        for start, run in slices(t.tolist()) if langs else ():
            total, letters = pooled(net, run)
            known = np.flatnonzero(letters > 0)
            mean = total[known] / letters[known, None]
            pred[start + known] = np.array(langs, dtype=object)[mean.argmax(axis=1)]
            score[start + known] = np.minimum(mean.max(axis=1), 1.0)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return rows.select("r", predict("t").alias("p")).select("r", "p.lang_pred", "p.score")


def predict_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; rows where held_out is true, or lang or text is null, teach nothing.

    Texts without a letter, null and empty ones are `und` with score 0, and so is everything where nothing was learned. Very long texts
    are read whole, window by window. Repeated rows get equal predictions; null ids are kept; an empty table gives an empty
    result. Other columns of docs, whatever their names, are not read.
    """
    flag = F.coalesce(held_out, F.lit(False))
    net, langs = train(docs, ~flag, id_col, text_col, lang_col, **how)
    d = docs.select(F.col(id_col).alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    return identify(d, net, langs).select("r.doc_id", "r.held_out", "lang_pred", "score")
