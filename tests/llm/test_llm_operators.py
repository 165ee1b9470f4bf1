"""Edge cases and brute-force comparisons of the training-data operators."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, line_dedup, media, mixing, ngram_join, ppm, toxicity, warc
from tessera.llm.common import LOWER_BYTES, crc_mod
from tests.llm.conftest import prose


def table(df, key=0):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


# --- 1 ---------------------------------------------------------------------------------------------------------


def brute_ppm(train, texts, k):
    t = [defaultdict(Counter) for _ in range(k + 1)]
    for x in train:
        y = b"\xff" * k + x + b"\xff"
        for p in range(k, len(y)):
            for j in range(k + 1):
                t[j][y[p - j : p]][y[p]] += 1

    def lp(ctx, sym):
        out, gone = 0.0, set()
        for j in range(k, -1, -1):
            c = t[j].get(ctx[k - j :])
            if not c:
                continue
            n, d = sum(v for s, v in c.items() if s not in gone), sum(1 for s in c if s not in gone)
            if d:
                if sym in c:
                    return out + math.log10((c[sym] - 0.5) / n)
                out += math.log10(0.5 * d / n)
            gone |= set(c)
        return out - math.log10(256 - len(gone))

    return [sum(lp(y[p - k : p], y[p]) for p in range(k, len(y))) for y in (b"\xff" * k + x + b"\xff" for x in texts)]


@pytest.mark.parametrize("order, how", [(3, {}), (5, {"block_bytes": 40_000, "fan_in": 2}), (2, {"block_bytes": 1})])
def test_ppm_equals_brute_force(spark, odd_docs, order, how):
    large = spark.createDataFrame([((1 << 53) + 1 + 2 * i, t, None, None, i, None) for i, t in enumerate(("the large ids", "are not rounded", "the large ids"))], odd_docs.schema)
    docs = odd_docs.filter("doc_id <> 7 or doc_id is null").unionByName(large).coalesce(2)
    held = crc_mod(F.col("doc_id"), 7) == 2
    scored = ppm.ppm_score(docs, held, order=order, **how).collect()
    assert Counter(r["doc_id"] for r in scored) == Counter(r["doc_id"] for r in docs.collect())
    got = {r["doc_id"]: r for r in scored if r["doc_id"] is not None}
    rows = [(r["doc_id"], (r["text"] or "").encode().translate(LOWER_BYTES)) for r in docs.collect()]
    out = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    train = [x for i, x in rows if not out[i]]
    words = Counter(w for x in train for w in [*re.split(rb"[\x20\x09-\x0d]+", x), None] if w != b"")
    n, v = sum(words.values()), len(words)
    for (i, x), s in zip(rows, brute_ppm(train, [x for _, x in rows], order), strict=True):
        if i is None:
            continue
        toks = [w for w in re.split(rb"[\x20\x09-\x0d]+", x) if w] + [None]
        assert got[i]["score"] == pytest.approx(s, abs=1e-6)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in toks), abs=1e-6)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(toks), sum(w in words for w in toks), n, out[i])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ppm_probabilities_sum_to_one(order):
    text = b"abracadabra" * 3
    g, _ = ppm.grams([text], order)
    low = ppm.Low(*np.unique(ppm.grams([text], 2)[0], return_counts=True))
    for ctx in (b"abra", b"zzzz", b"zbra", b"zzra", b"zzzb"):
        every = np.sort(np.array([int.from_bytes(ctx[-order:] + bytes([s]), "big") for s in range(256)], dtype=np.uint64))
        u, n = np.unique(g, return_counts=True)
        keys = np.unique(np.concatenate([u, every]))
        counts = np.zeros(len(keys))
        counts[np.searchsorted(keys, u)] = n
        p = 10 ** ppm.chain(keys, counts, order, low)
        assert p[np.searchsorted(keys, every)].sum() == pytest.approx(1, abs=1e-9)


def test_ppm_of_text_ids(spark):
    d = spark.createDataFrame([("a", "some text"), ("b", "some text"), (None, None)], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in ppm.ppm_score(d, F.lit(False)).collect()) == ["None", "a", "b"]


def test_ppm_empty(spark, no_docs):
    assert ppm.ppm_score(no_docs, F.lit(False)).count() == 0


def test_ppm_without_training_rows(spark, odd_docs):
    r = ppm.ppm_score(odd_docs.filter("doc_id = 8"), F.lit(True), order=2).collect()
    assert len(r) == 2 and r[0]["train_tokens"] == 0 and r[0]["score"] == pytest.approx(-8 * math.log10(256), abs=1e-4)


# --- 2 ---------------------------------------------------------------------------------------------------------

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_license_rules(spark, odd_docs, no_docs):
    rows = [
        (1, "some words without an end\nReleased under the MIT License.\nmore"),
        (2, MIT),
        (3, "All rights reserved. Licensed under the Apache License, Version 2.0."),
        (4, "// SPDX-License-Identifier: Apache-2.0\nint main"),
        (5, "This program is free software: no"),
        (6, "Released under the MIT License. Released under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licences"] for i in (1, 2, 3, 4, 5, 6)] == ["MIT", "MIT", "All-Rights-Reserved,Apache-2.0", "Apache-2.0", "", "MIT"]
    assert got[2]["sentence_ids"] == "<MITperm><MITnotice><MITasis>" and got[2]["n_unmatched"] == 0
    odd = licenses.scan_licenses(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["licences"] == "" and r["n_licences"] == 0 for r in odd)
    assert licenses.scan_licenses(no_docs).count() == 0


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def test_license_references_grants_and_gaps(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    far = MIT.split("\n\n")
    filler = "\n\n" + " ".join(f"Another sentence number {i}." for i in range(8)) + "\n\n"
    rows = {
        "This file is licensed under the MIT license.": "MIT",
        "The contents of this repository are released under the terms of the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "Dual licensed under the GPL v2 or later.": "GPL-2.0",
        "These data are available under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Licensed under the Moon Public License.": "",
        "The wine was released under the apache sun.": "",
        isc: "ISC",
        "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n": "LGPL-2.1",
        "SPDX-License-Identifier: CC-BY-ND-4.0": "CC-BY-ND-4.0",
    }
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, MIT, far[0] + filler + far[1], far[0] + "\n\nOne more.\n\n" + far[1]])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    assert [got[i]["licences"] for i in range(len(rows))] == list(rows.values())
    n = len(rows)
    assert [got[n + i]["sentence_ids"] for i in range(3)] == ["<MITperm><MITnotice><MITasis>", "<MITperm>|<MITnotice>", "<MITperm><MITnotice>"]
    assert got[n + 1]["n_unmatched"] == 1 and got[n]["n_unmatched"] == 0


def test_published_license_headers(spark):
    starred = lambda t: "/*\n" + "\n".join(f" * {x.strip()}".rstrip() for x in t.split("\n")) + "\n */"
    rows = [(1, GPL3), (2, starred(GPL3)), (3, APACHE), (4, starred(APACHE))]
    tags = ["GPL-2.0-or-later", "GPL-3.0-or-later", *licenses.SPDX]
    rows += [(10 + i, f"// SPDX-License-Identifier: {t}\nint main") for i, t in enumerate(tags)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licences"] for i in (1, 2, 3, 4)] == ["GPL-3.0-or-later"] * 2 + ["Apache-2.0"] * 2
    assert [got[i]["n_unmatched"] for i in (1, 2, 3, 4)] == [0] * 4
    assert [got[10 + i]["licences"] for i in range(len(tags))] == tags


# --- 3 ---------------------------------------------------------------------------------------------------------


def brute_contained(docs, items, k=5):
    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    out = set()
    for i, t in docs:
        s = shingles(t)
        for j, u in items:
            q = shingles(u)
            if q and i is not None and 100 * len(q & s) >= 75 * len(q):
                out.add((i, j, len(q), len(q & s)))
    return out


def test_containment_equals_brute_force(spark, odd_docs, no_docs):
    item = prose(50, 30)
    w = item.split()
    broken = " ".join(w[:15] + ["zzz"] + w[16:])  # five shingles of 26 are lost
    gone = " ".join(w[:8] + ["zzz"] + w[9:20] + ["yyy"] + w[21:])
    docs = [(1, prose(51, 400) + " " + item.upper() + ". " + prose(52, 300)), (2, prose(53, 90) + " " + broken), (3, gone), (4, prose(54, 500)), (5, item), (5, item), (6, None), (7, ""), (8, "two words"), (None, item)]
    items = [(10, item), (11, "two words"), (12, None), (13, ""), (14, prose(55, 12)), (10, item)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(d, b).collect()}
    assert got == brute_contained(docs, items) and (1, 10, 26, 26) in got and (2, 10, 26, 21) in got
    clean = decontaminate.decontaminate(d, b)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "6", "7", "None"]
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.contaminated(odd_docs, b.limit(0)).count() == 0


def test_containment_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = [(i, prose(i, 60) + " " + prose(1000 + i % 3, 25)) for i in range(30)]
    items = [(i, prose(1000 + i, 25)) for i in range(3)]
    got = {tuple(r)[:4] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contained(docs, items) and len(got) == 30


# --- 4 ---------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, odd_docs, no_docs):
    rows = [(i, f"own line {i}\n menu \n\nfooter {i % 2}\nmenu", "h", "k") for i in range(10)] + [(20, "menu\nother", "g", None), (21, None, "h", None), (22, "", None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, bad string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(d, ratio=0.6, counts=True).collect()}
    assert got[3]["text"] == "own line 3\n\nfooter 1" and (got[3]["n_lines"], got[3]["n_dropped"]) == (5, 2)
    assert got[20]["text"] == "menu\nother" and got[21]["text"] is None and got[22]["text"] == ""
    assert list(line_dedup.drop_boilerplate(d).columns) == d.columns
    assert table(line_dedup.drop_boilerplate(odd_docs, min_pages=5)) == table(odd_docs) and line_dedup.drop_boilerplate(no_docs).count() == 0
    few = {(r["doc_id"], r["text"] or "") for r in line_dedup.drop_boilerplate(odd_docs).collect()}  # copies on a site of few pages are its boilerplate
    assert {(1, ""), (2, ""), (8, "")} <= few and all(t for i, t in few if i in (3, 7, 9, 10))


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(line_dedup, "HOT_PAGES", 3)
    d = spark.createDataFrame([(i, f"a\nb{i}", "h") for i in range(9)] + [(20, "a\nc", "g"), (21, None, None)], "doc_id long, text string, source string")
    assert {r["text"] for r in line_dedup.drop_boilerplate(d).collect()} == {f"b{i}" for i in range(9)} | {"a\nc", None}


def test_line_dedup_equals_brute_force(spark):
    """Sites of 1 to 40 pages; a line of one page alone stays, however small its site."""
    r = np.random.default_rng(9)
    rows = [(100 * s + i, "\n".join(f" l{x} " for x in r.integers(0, 30, 4)), f"s{s}") for s in range(12) for i in range(int(r.integers(1, 40)))]
    pages, total = Counter(), Counter(s for _, _, s in rows)
    for _, t, s in rows:
        pages.update((s, x.strip()) for x in set(t.split("\n")))
    want = {i: "\n".join(x for x in t.split("\n") if not (pages[s, x.strip()] >= 2 and pages[s, x.strip()] > 0.1 * total[s])) for i, t, s in rows}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_mixing_rates_and_replication(spark, odd_docs, no_docs):
    rows = [(i, "x" * 10, "big" if i % 10 else "small") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(d).collect()}
    assert rates["small"] / rates["big"] == pytest.approx(3) and 36000 * rates["big"] + 4000 * rates["small"] == pytest.approx(40000)
    out = mixing.poisson_mix(d).collect()
    n = Counter(r["doc_id"] for r in out)
    for s in ("big", "small"):
        counts = [n[i] for i, _, x in rows if x == s]
        assert abs(np.mean(counts) - rates[s]) < 5 * math.sqrt(rates[s] / len(counts)) and abs(np.var(counts) - rates[s]) < 0.35 * rates[s]
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out) and max(r["replica"] for r in out if r["doc_id"] == out[0]["doc_id"]) == n[out[0]["doc_id"]]
    assert table(mixing.poisson_mix(d.repartition(7))) == table(mixing.poisson_mix(d))
    assert set(mixing.poisson_mix(odd_docs).columns) == {*odd_docs.columns, "replica", "shuffle_key"} and mixing.poisson_mix(odd_docs).count() >= 0
    assert mixing.poisson_mix(no_docs).count() == 0


def test_mixing_large_rates_and_named_weights(spark):
    d = spark.createDataFrame([(i, "abc", "a" if i else None) for i in range(50)], "doc_id long, text string, source string")
    out = mixing.poisson_mix(d, weights={"a": 1.0}, budget=400.0)
    n = out.count()
    assert abs(n - 50 * 400) < 5 * math.sqrt(50 * 400) and out.filter("source is null").count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    net = langid.BiGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(97, 122, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.probabilities(x)[:, np.arange(5), y]).mean()
    for k, g in net.gradients(x, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        net.p[k][at] += 1e-4
        a = loss()
        net.p[k][at] -= 2e-4
        b = loss()
        net.p[k][at] += 1e-4
        assert (a - b) / 2e-4 == pytest.approx(g[at], rel=1e-3)


def test_gradients_within_a_text_and_over_letters():
    """Positions outside of the text and without weight change nothing."""
    net = langid.BiGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    x, y, inside = r.integers(90, 122, (4, 8)).astype(np.uint8), np.array([0, 1, 2, 0]), np.arange(8) < np.array([8, 5, 1, 7])[:, None]
    weight = langid.LETTER[x] * inside

    def loss():
        p = net.probabilities(x, inside)[:, np.arange(4), y].T
        return float(-(np.log(p) * weight).sum() / weight.sum())

    for k, g in net.gradients(x, y, inside, weight).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        net.p[k][at] += 1e-4
        a = loss()
        net.p[k][at] -= 2e-4
        b = loss()
        net.p[k][at] += 1e-4
        assert (a - b) / 2e-4 == pytest.approx(g[at], rel=1e-3)


def brute_network(net, text):
    """The mean probabilities over the letters of a text, both directions byte by byte from its edges."""
    b, h, p = text.lower() if isinstance(text, bytes) else text.encode().translate(LOWER_BYTES), net.h, net.p
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(data, d):
        s, out = np.zeros(h), []
        for c in data:
            g, k = p[f"W{d}"][c].astype(float), s @ p[f"U{d}"]
            z, r = sig(g[:h] + k[:h]), sig(g[h : 2 * h] + k[h : 2 * h])
            n = np.tanh(g[2 * h :] + r * k[2 * h :])
            s = z * s + (1 - z) * n
            out.append(s)
        return out

    both = np.concatenate([run(b, "f"), run(b[::-1], "b")[::-1]], axis=1) @ p["V"] + p["c"]
    e = np.exp(both - both.max(axis=1, keepdims=True))
    q = e / e.sum(axis=1, keepdims=True)
    return q[[langid.LETTER[c] > 0 for c in b]].mean(axis=0)


def test_network_equals_a_plain_loop():
    net = langid.BiGRU(4)
    texts = ["a", "Some WORDS, été 日本!", prose(80, 25)[: langid.CORE], " x "]
    longer = [prose(81, 300), prose(82, 40)]
    total, letters = langid.pooled(net, [t.encode() for t in texts + longer])
    for i, t in enumerate(texts):  # one window: nothing is cut
        assert total[i] / letters[i] == pytest.approx(brute_network(net, t), abs=1e-5)
    for i, t in enumerate(longer, len(texts)):  # each window starts within the text
        assert total[i] / letters[i] == pytest.approx(brute_network(net, t), abs=1e-3)


def test_language_id(spark, odd_docs, no_docs):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.predict_languages(d, crc_mod(F.col("doc_id"), 3) == 1).join(d, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = langid.predict_languages(odd_docs, F.lit(False), steps=50).collect()
    assert len(odd) == odd_docs.count() and {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (4, 5, 6, 10)} == dict.fromkeys((4, 5, 6, 10), "und")
    assert langid.predict_languages(no_docs, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(odd_docs, F.lit(True)).collect()} == {"und"}


# --- 7 ---------------------------------------------------------------------------------------------------------


def brute_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").encode().translate(LOWER_BYTES).decode()) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    r = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(40):
        base = prose(100 + g, int(r.integers(1, 120))).split()
        for _ in range(int(r.integers(1, 9))):
            w = list(base)
            for _ in range(int(r.integers(0, 1 + len(w) // 25))):
                w[int(r.integers(0, len(w)))] = f"new{n}"
            rows.append((n * 3 % 1009, " ".join(w)))
            n += 1
    passage = prose(7, 60)  # a passage that many texts share, and one group of many near copies
    rows += [(2000 + i, passage + " " + prose(300 + i, int(r.integers(5, 60)))) for i in range(60)]
    base = prose(8, 90).split()
    rows += [(3000 + i, " ".join(w if j != i % 90 else f"edit{i}" for j, w in enumerate(base))) for i in range(120)]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_components_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ngram_join, "LIST_PART", 3)
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_components_without_common_order_and_with_subsets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_COMMON", 50)
    monkeypatch.setattr(ngram_join, "_boundary", lambda *a: 60)
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_odd_rows(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(odd_docs).collect()]
    assert len(got) == odd_docs.count() and {c for i, _, c in got if i in (1, 2, 3)} == {1}
    assert [(n, c) for i, n, c in got if i == 8] == [(1, 8), (1, 8)] and {(i, n, c) for i, n, c in got if i in (4, 5, 6)} == {(i, 0, i) for i in (4, 5, 6)}
    assert all(c is None for i, _, c in got if i is None)
    assert ngram_join.ngram_jaccard_components(no_docs).count() == 0


def test_components_of_large_text_and_repeated_ids(spark):
    big, base, other = (1 << 53) + 1, prose(60, 80), prose(61, 80)
    rows = [(big, base), (big + 2, base + " tail"), (None, base), (None, None), (5, base + " end"), (5, other), (6, other + " end"), (7, other), (7, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(d).collect())
    assert got == Counter([(big, 5), (big + 2, 5), (None, None), (None, None), (5, 5), (5, 5), (6, 5), (7, 5), (7, 5)])
    rows[4] = (9, base + " end")  # now id 5 has the other text alone and the groups stay apart
    rows.append((5, prose(62, 40)))
    named = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(named).collect())
    first = f"d{big}" if f"d{big}" < "d9" else "d9"
    assert got == Counter([(f"d{big}", first), (f"d{big + 2}", first), (None, None), (None, None), ("d9", first), ("d5", "d5"), ("d5", "d5"), ("d6", "d5"), ("d7", "d5"), ("d7", "d5")])


def test_rows_of_one_id_keep_their_own_components(spark):
    base, other = prose(63, 80), prose(64, 80)
    d = spark.createDataFrame([(1, base), (5, base + " end"), (5, other), (2, other + " end")], "doc_id long, text string")
    got = {(r["doc_id"], r["set_id"]): r["component_id"] for r in ngram_join.ngram_jaccard_components(d, signatures=True).collect()}
    assert sorted((i, c) for (i, _), c in got.items()) == [(1, 1), (2, 2), (5, 1), (5, 2)]
    assert ngram_join.ngram_jaccard_components(d, signatures=True).filter("doc_id = component_id and set_id = component_set").count() == 2
    of = {(r["doc_id"], r["s"]) for r in d.select("doc_id", ngram_join.signature(F.col("text")).alias("s")).collect()}
    assert of == set(got)


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>é</p>" * 9000, "", None, "a\r\n\r\nWARC/1.1\r\n", "same", "same", "x" * 32768]
    rows = [(i, f"http://h/{i}" if i % 2 else None, h) for i, h in enumerate(html)] + [(4, "http://h/4", "same")]
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/warc-test"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_records(spark, path)
    assert records.filter("number > 1").count() >= 2 and records.filter("type = 'continuation' and origin like '<urn:page:0:%:0>'").count() >= 2
    got = {r["page_id"]: r for r in warc.page_digests(spark, path).collect()}
    payload = {i: (h or "").encode() for i, h in enumerate(html)}
    for i, p in payload.items():
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if i in (1, 2, 4, 5)} == {1: ("response", None), 2: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4)}
    pages = {r["page_id"]: r["payload"] for r in warc.read_pages(spark, path).collect() if r["record_type"] == "response"}
    assert all(bytes(b) == payload[i] for i, b in pages.items())


def test_warc_repeated_pages_large_ids_and_nulls(spark, no_docs):
    big, n = "y" * 70_000, (1 << 53) + 1
    html = [(n, big), (n, big), (n + 2, big), (7, "z" * 70_000), (7, "w" * 70_000), (7, "w"), (None, big), (None, "alone"), (None, "alone"), (n + 4, None), (n + 4, ""), (1 << 62, "w")]
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/warc-odd"
    warc.write_warc(spark.createDataFrame([(i, "u", h) for i, h in html], "page_id long, url string, html string"), path)
    got = [tuple(r) for r in warc.page_digests(spark, path).collect()]
    least = {}
    for i, h in html:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, h in html:
        p, first = (h or "").encode(), least.get(h or "")
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, got)) == sorted(map(str, want))
    texts = spark.createDataFrame([("a:b c>", "u", "q"), ("!", "u", "q"), ("", "u", "r")], "page_id string, url string, html string")
    warc.write_warc(texts, path + "-text")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.page_digests(spark, path + "-text", "string").collect()) == [("", "response", None), ("!", "response", None), ("a:b c>", "revisit", "!")]
    warc.write_warc(texts.limit(0), path + "-none")
    assert warc.page_digests(spark, path + "-none").count() == 0


def test_warc_broken_segments(spark):
    recs = warc.page_records("1", "u", b"z" * 100_000, None, segment=10_000)
    rows = [(*[h.get(k) for k in ("warc-record-id", "warc-type")], h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0)), int(h.get("warc-segment-total-length", -1)), None, None, None, bytearray(b)) for h, b in warc.parse_records(b"".join(r + b"\r\n\r\n" for r in recs))]
    schema = "record_id string, type string, origin string, number int, total long, uri string, refers_to string, digest string, block binary"
    whole = warc.reassemble(spark.createDataFrame(rows + rows[:2], schema)).collect()
    assert len(whole) == 1 and warc.unframe_chunks(bytes(whole[0]["block"]).partition(b"\r\n\r\n")[2]) == b"z" * 100_000
    for lost in (0, 3, len(rows) - 1):
        part = warc.reassemble(spark.createDataFrame(rows[:lost] + rows[lost + 1 :], schema)).collect()
        assert len(part) == 1 and part[0]["block"] is None
    assert warc.unframe_chunks(b"3;x=1\r\nabc\r\n0\r\nt: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unframe_chunks(bad)


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_images_round_trip():
    r = np.random.default_rng(1)
    for h, w in ((1, 64), (7, 5), (64, 64)):
        a = r.integers(0, 256, (h, w)).astype(np.uint8)
        assert (media.decode(media.encode_pgm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(b"P2 # c\n2 1\n255\n7 200\n") == [[7, 200]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all()
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    for bad in (b"", b"P5\n2 2\n255\n\x00", b"GIF89a", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean():
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert media.area_resize(a, 3, 4) == pytest.approx(a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert media.area_resize(a, 1, 1)[0, 0] == pytest.approx(a.mean()) and media.area_resize(a[:1], 8, 9).shape == (8, 9)
    r = np.random.default_rng(2)
    for shape, h, w in (((5, 7), 8, 9), ((1, 64), 16, 16), ((1000, 64), 16, 16), ((17, 3, 3), 4, 2)):
        x = r.integers(0, 256, shape).astype(np.uint8)
        g = x.astype(float) if x.ndim == 2 else x.astype(float).mean(axis=2)
        big = np.kron(g, np.ones((h, w)))  # every cell of the result is now a whole block
        assert media.area_resize(x, h, w) == pytest.approx(big.reshape(h, g.shape[0], w, g.shape[1]).mean(axis=(1, 3)))


def digests(text):
    b = (text or "").encode()
    p = b + bytes(-len(b) % 64 or (0 if b else 64))
    return (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_media_columns(spark, odd_docs, no_docs, tmp_path):
    many = spark.createDataFrame([((1 << 53) + 1 + 2 * i, t, None, None, i, None) for i, t in enumerate(("x" * 3_000_000, "ab", "ab"))], odd_docs.schema)
    docs = odd_docs.unionByName(many).coalesce(1)  # large and null ids in one batch
    got = media.store_and_read(docs, f"file://{tmp_path}/a").collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == Counter((r["doc_id"], *digests(r["text"])) for r in docs.collect())
    assert len({(r["media_sha256"], r["feature"], r["tile_sha256"]) for r in got if r["n_bytes"] == 2}) == 1
    for r in spark.read.parquet(f"file://{tmp_path}/a/tiles").collect():
        assert media.read_tile(bytes(r["tile"])).shape == (16, 16)
    assert media.store_and_read(no_docs, f"file://{tmp_path}/b").count() == 0
    broken = media.media_features(spark.createDataFrame([(1, 1, bytearray(b"??")), (2, 1, None)], "doc_id long, n_bytes long, media binary")).collect()
    assert all(r["dhash"] is None for r in broken)


# --- 10 --------------------------------------------------------------------------------------------------------


def test_label_model_learns_dependent_voters():
    r = np.random.default_rng(5)
    y = (r.random(20000) < 0.2).astype(int)
    v = np.zeros((20000, len(toxicity.VOTERS)), dtype=int)
    for j, (a, b) in enumerate([(0.8, 0.01), (0.7, 0.05), (0.6, 0.02)]):
        v[:, j] = r.random(20000) < np.where(y == 1, a, b)
    v[:, 3] = np.where(r.random(20000) < 0.95, v[:, 1], 1 - v[:, 1])  # a copy of voter 1
    code = (v << np.arange(v.shape[1])).sum(axis=1)
    label = np.where(np.arange(20000) % 10 == 0, y, -1)
    keys, n = np.unique(np.stack([code, label], axis=1), axis=0, return_counts=True)
    m = toxicity.LabelModel().fit(keys[:, 0], keys[:, 1], n.astype(float))
    assert abs(m.rate[1, 0].mean() - 0.8) < 0.08 and {int(m.parent[3]), int(m.parent[1])} & {1, 3}
    assert ((m.posterior(code) > 0.5) == y).mean() > 0.95


def test_label_model_equals_enumeration():
    """Posteriors by Bayes' rule over both classes, with each voter's table read off one by one; the probabilities of all patterns sum to one."""
    r = np.random.default_rng(6)
    m, k = toxicity.LabelModel(), len(toxicity.VOTERS)
    m.prior, m.errors = 0.3, np.array([0.01, 0.02])
    m.parent = np.array([-1] + [int(r.integers(0, j)) for j in range(1, k)])
    m.rate = r.uniform(0.05, 0.95, (2, k, 2))
    m.rate[:, 0, 1] = m.rate[:, 0, 0]
    every = np.arange(1 << k)

    def joint(code, y, label):
        p = (1 - m.prior, m.prior)[y] * (1.0 if label < 0 else m.errors[y] if label != y else 1 - m.errors[y])
        for j in range(k):
            rate = m.rate[y, j, code >> m.parent[j] & 1 if m.parent[j] >= 0 else 0]
            p *= rate if code >> j & 1 else 1 - rate
        return p

    assert sum(joint(c, y, -1) for c in every for y in (0, 1)) == pytest.approx(1)
    some = r.choice(every, 200)
    for label in (-1, 0, 1):
        want = [joint(c, 1, label) / (joint(c, 0, label) + joint(c, 1, label)) for c in some]
        assert m.posterior(some, np.full(200, label)) == pytest.approx(want)


def test_voters_read_whole_texts():
    """A text and the same text twice over get the same votes, capitals anywhere count alike, and nothing depends on length."""
    none = np.zeros(0, dtype=np.int64)
    bit = lambda t: toxicity.votes(t, none, none) >> toxicity.UPPER & 1
    rare = ("A" + "bcd") * 600
    assert bit(rare) == bit(rare[2:]) == 0 and bit("ABc" * 1000) == 1 and bit("ÀÉ日本" * 600) == 0 and bit("ÀÉß" * 600) == 1 and bit("") == 0
    for t in ("some Text! " * 300, "x" * 5000 + " you are an idiot!!", "SHOUTED " * 200, "a f**k", "noooo"):
        assert toxicity.votes(t, none, none) == toxicity.votes(t + t, none, none)
    assert toxicity.uppers("aBÉ日ßZ") == 3


def test_toxicity(spark, odd_docs, no_docs):
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = prose(i, 60) + (" you rotten zorkling and blargish fool" if bad and i % 12 else " a zorkling grimpface blargish" if bad else "")
        rows.append((i, t, "en"))
        labels.append((i, int(bad), 1))
    d, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(d, y, crc_mod(F.col("doc_id"), 3) == 1).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 900 and sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in out)
    odd = toxicity.toxicity(odd_docs, y.unionByName(spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 0, 0), (2, 1, 0)], y.schema)), F.lit(False)).collect()
    assert len(odd) == odd_docs.count()
    assert toxicity.toxicity(no_docs, y, F.lit(False)).count() == 0 and {r["score"] for r in toxicity.toxicity(odd_docs, y.limit(0), F.lit(False)).collect()} == {0.0}


def brute_scores(x, w, rows):
    """Scores of texts by the fitted weights, feature by feature."""
    return [1 / (1 + math.exp(-max(-40, min(40, w[-1] + sum(w[c] for r, c in zip(x.row, x.col, strict=True) if r == i))))) for i in range(rows)]


def test_classifier_minimizes_the_loss_on_posteriors():
    """The fitted weights equal those of plain gradient descent, row by row, on the same soft labels."""
    r = np.random.default_rng(7)
    hits = [np.flatnonzero(r.random(4) < 0.4) for _ in range(80)]
    votes = r.integers(0, 1 << len(toxicity.VOTERS), 80)
    x = toxicity.Rows(hits, votes, 4)
    q, weight, use = r.random(80), r.uniform(0.1, 1, 80), np.ones(x.features, dtype=bool)
    got = x.fit(q, weight, use, 3000, decay=1e-2)
    dense = np.zeros((80, x.features + 1))
    dense[:, -1] = 1
    for i, h in enumerate(hits):
        dense[i, h] = 1
        for k, v in enumerate(toxicity.OWN_BITS):
            dense[i, 4 + k] = votes[i] >> v & 1
    w = np.zeros(x.features + 1)
    for _ in range(20000):
        g = np.zeros_like(w)
        p = 1 / (1 + np.exp(-dense @ w))
        g = dense.T @ ((p - q) * weight) / weight.sum()
        g[:-1] += 1e-2 * w[:-1]
        w -= 0.5 * g
    assert got == pytest.approx(w, abs=1e-4) and got == pytest.approx(x.fit(q, weight, use, 4000, decay=1e-2), abs=1e-4)
    assert brute_scores(x, got, 80) == pytest.approx((1 / (1 + np.exp(-dense @ got))).tolist())


def test_toxicity_of_large_null_and_text_ids(spark):
    rows = [((1 << 53) + 1 + 2 * i if i % 3 else None, prose(i, 8) + (" blargish" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    got = toxicity.toxicity(d, d, F.lit(False)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    named = d.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert Counter(r["doc_id"] for r in toxicity.toxicity(named, named, F.lit(False)).collect()) == Counter(None if i is None else f"d{i}" for i, _, _ in rows)


def test_toxicity_learns_rare_words(spark):
    """100 rare abusive words of which each stands in 1% of the toxic texts, without a common beginning."""
    rows = []
    for i in range(3000):
        bad = i % 5 == 0
        rare = "abcdefghij"[i // 5 % 10] + "klmnopqrst"[i // 5 % 100 // 10] + "xqy"
        rows.append((i, prose(i, 40) + (f" {rare}" if bad else ""), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = F.col("doc_id") % 7 == 3
    out = d.join(toxicity.toxicity(d, d, held, sample=6000), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.98 * len(out)


def test_toxicity_scores_without_mined_words(spark):
    """Where no word tells the classes, patterns still do."""
    rows = [(i, f"{'!!' if i % 2 else ''} 12 {i}", i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = d.join(toxicity.toxicity(d, d, F.col("doc_id") % 7 == 3), "doc_id").collect()
    assert all((r["score"] > 0.5) == (r["toxic"] == 1) for r in out)
