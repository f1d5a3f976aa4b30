"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, and also a run of lines that are wrapped: up to a blank line or to a line that ends a sentence. A sparse
multinomial logistic regression over word 1-grams to 3-grams gives each paragraph a licence
family or unknown; it is trained on templates, their excerpts and noisy copies, and on paragraphs of the corpus as
unknown. Its scores are calibrated by a temperature fitted on held-out rows, a family is named at a calibrated probability of
ACCEPT or more, and the prediction is confirmed if enough of the nearest template's word pairs are in the paragraph.

Every paragraph of every text is scored. A wrapped run is reported as one where none of its lines is named by itself.
"""

import bisect
import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sample_by_hash, texts

#: Phrases by which licences of each family are declared (publicly known wording).
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is available under the Creative Commons Attribution-ShareAlike License",
        "Licensed under CC BY-SA 4.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
BITS, NGRAM = 16, 3
#: Documents that are sampled for training (by hash of id and text, of SAMPLE_CHARS at most), and lines of them that are taken as unknown.
SAMPLE, SAMPLE_CHARS, UNKNOWN_LINES = 1_000, 20_000, 4_000
ACCEPT, CONFIRM = 0.7, 0.5
#: A paragraph of more words is scored in windows of so many, half of each shared with the next.
WINDOW = 60
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


@cache
def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def codes(ws: list[str]) -> np.ndarray:
    """Numbers of words; a worker remembers those of a million words, then begins anew."""
    if _code.cache_info().currsize > 1_000_000:
        _code.cache_clear()
    return np.fromiter(map(_code, ws), np.uint64, len(ws))


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    """The hashed feature of each n-gram of word numbers."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(x) - n + 1), np.uint64(n) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for k in range(n):
            h = (h ^ x[k : k + len(h)]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(ws: list[str]) -> np.ndarray:
    """Hashed distinct word 1- to NGRAM-grams."""
    x = codes(ws)
    return np.unique(np.concatenate([_mixed(x, n) for n in range(1, NGRAM + 1)]))


class Model:
    """weights: (1 << BITS, families); a paragraph's scores are the sums of its features' rows over the root of their number."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.pairs = [(family, _pairs(words(t))) for family, ts in TEMPLATES.items() for t in ts]

    def scores(self, ws: list[str]) -> np.ndarray:
        f = features(ws)
        return self.weights[f].sum(axis=0) / math.sqrt(max(1, len(f))) + self.bias

    def many(self, x: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """scores() of many paragraphs at once: x has the words' numbers, parts the (start, stop) of each paragraph in it, none empty."""
        n = np.maximum(parts[:, 1] - parts[:, 0], 0)
        pairs = []
        for size in range(1, NGRAM + 1):
            grams, m = _mixed(x, size), np.maximum(n - size + 1, 0)
            own = np.repeat(np.arange(len(parts)), m)
            at = np.repeat(parts[:, 0] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pairs.append((own << BITS) | grams[at])
        pairs = np.unique(np.concatenate(pairs))
        own = pairs >> BITS
        first = np.searchsorted(own, np.arange(len(parts)))
        sums = np.add.reduceat(self.weights[pairs & ((1 << BITS) - 1)], first, axis=0)
        return sums / np.sqrt(np.diff(np.append(first, len(pairs))))[:, None] + self.bias

    def named(self, z: np.ndarray, ws: list[str]) -> tuple[str, float, float]:
        """What predict() gives, of scores and words."""
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(p.argmax())
        if k == 0 or p[k] < ACCEPT:
            return UNKNOWN, float(p[0]), 0.0
        own = _pairs(ws)
        return FAMILIES[k], float(p[k]), max(len(own & t) / len(t) for f, t in self.pairs if f == FAMILIES[k])

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """(family, calibrated probability, share of the nearest of its templates that the paragraph holds)."""
        ws = words(paragraph)
        return self.named(self.scores(ws), ws)


def _pairs(ws: list[str]) -> set:
    return set(zip(ws, ws[1:], strict=False)) or {(w,) for w in ws}


def training_rows(unknown: list[str], seed: int = 0) -> list[tuple[str, int]]:
    """Templates, excerpts and noisy copies of them with words of unknown paragraphs around or inside, and the unknown ones."""
    rng = np.random.default_rng(seed)
    filler = [w for t in unknown for w in t.split()][:20_000] or ["text"]
    rows = [(t, 0) for t in unknown]
    for k, family in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[family]:
            ws = t.split()
            rows += [(t, k)] * 4
            for _ in range(40):
                a = int(rng.integers(0, max(1, len(ws) // 4)))
                b = len(ws) - int(rng.integers(0, max(1, len(ws) // 4)))
                cut = [w for w in ws[a:b] if len(ws) < 6 or rng.random() > 0.1]
                around = [str(w) for w in rng.choice(filler, int(rng.integers(0, 12)))]
                at = int(rng.integers(0, len(around) + 1))
                rows.append((" ".join([*around[:at], *(cut or ws), *around[at:]]), k))
    return rows


def fit(rows: list[tuple[str, int]], rounds: int = 60, seed: int = 0) -> Model:
    """Logistic regression by AdaGrad over shuffled rows, then a temperature that minimises the log loss of a held-out fifth."""
    rng = np.random.default_rng(seed)
    data = [(features(words(t)), k) for t, k in rows]
    order = rng.permutation(len(data))
    held, train = order[: len(data) // 5], order[len(data) // 5 :]
    share = Counter(k for _, k in data)
    weight = {k: len(data) / (len(share) * n) for k, n in share.items()}
    w, b = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    gw, gb = np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    for r in range(rounds // 10):
        for i in rng.permutation(train):
            f, k = data[i]
            s = 1 / math.sqrt(max(1, len(f)))
            z = w[f].sum(axis=0) * s + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            p *= min(5.0, weight[k])
            step = p * s + 1e-4 * w[f]
            gw[f] += step * step
            w[f] -= 0.5 / (1 + r) * step / np.sqrt(gw[f])
            gb += p * p
            b -= 0.1 * p / np.sqrt(gb)
    model = Model(w, b)
    z = np.array([w[data[i][0]].sum(axis=0) / math.sqrt(max(1, len(data[i][0]))) + b for i in held])
    y = np.array([data[i][1] for i in held])
    if len(held):
        losses = {}
        for t in np.geomspace(0.1, 8, 40):
            q = z / t
            q = q - q.max(axis=1, keepdims=True)
            losses[float(t)] = float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(axis=1))).mean())
        model.temperature = min(losses, key=losses.get)
    return model


_ENDS = re.compile(r"[.!?:;|]\s*$")


def paragraphs(text: str) -> list[tuple[int, int, int, int]]:
    """(first line, start, stop, number of lines) of every line with a character that isn't white space, and of every wrapped run of two such lines or more."""
    out, run, at = [], [], 0

    def close():
        if len(run) > 1:
            out.append((run[0][0], run[0][1], run[-1][2], len(run)))
        run.clear()

    for k, line in enumerate(text.split("\n")):
        if line.strip():
            out.append((k, at, at + len(line), 1))
            run.append(out[-1])
            if _ENDS.search(line):
                close()
        else:
            close()
        at += len(line) + 1
    close()
    return out


def pieces(tokens: list, start: int, stop: int) -> list[tuple[int, int]]:
    """A paragraph's words from start to stop, or windows of WINDOW of them, half shared with the next, if there are more."""
    if stop - start <= WINDOW:
        return [(start, stop)] if stop > start else []
    return [(i, min(i + WINDOW, stop)) for i in range(start, stop - WINDOW // 2, WINDOW // 2)]


def unknown_sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """Lines of about most documents that hold no template's word pair run: the classifier's bounded sample of unknown rows; scoring covers all rows."""
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS))
    rows = sample_by_hash(short, F.xxhash64("doc_id", "text"), most).select("text").collect()
    lines = sorted({x for r in rows for x in r.text.split("\n") if x.strip()}, key=lambda x: zlib.crc32(x.encode()))[:UNKNOWN_LINES]
    known = [_pairs(words(t)) for ts in TEMPLATES.values() for t in ts]
    clear = lambda t: all(len(_pairs(words(t)) & p) <= 0.2 * len(p) for p in known)
    return [t for t in lines if clear(t)]


#: Words that are scored at a time.
BATCH = 50_000


def scan_texts(all_texts: list[str], m: Model):
    """(text, line_no, family, probability, similarity, start, stop) of every named paragraph of some texts, in order."""
    x, parts, about, spans, at = [], [], [], [], 0
    for d, t in enumerate(all_texts):
        tokens = [(w.start(), w.end()) for w in _WORD.finditer(t.lower())] if len(t.lower()) == len(t) else [(w.start(), w.end()) for w in _WORD.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in t))]
        begins = [a for a, _ in tokens]
        for line, start, stop, n in paragraphs(t):
            i, j = bisect.bisect_left(begins, start), bisect.bisect_left(begins, stop)
            whole = j - i <= WINDOW
            for a, b in pieces(tokens, i, j):
                parts.append((at + a, at + b))
                about.append((d, line, n, start if whole else tokens[a][0], stop if whole else tokens[b - 1][1]))
        x += [t[a:b].lower() for a, b in tokens]
        at += len(tokens)
    if not parts:
        return []
    z = m.many(codes(x), np.array(parts))
    p = z / m.temperature
    p = p - np.log(np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - p.max(axis=1, keepdims=True)
    found = []
    for k in np.flatnonzero((p.argmax(axis=1) > 0) & (p.max(axis=1) >= math.log(ACCEPT) - 1e-9)).tolist():
        family, sure, like = m.named(z[k], x[parts[k][0] : parts[k][1]])
        if family != UNKNOWN:
            found.append((about[k], family, sure, like))
    lines: dict[int, list[int]] = {}
    for (d, line, n, _, _), _, _, like in found:
        if n == 1 and like >= CONFIRM:
            lines.setdefault(d, []).append(line)
    out = []
    for (d, line, n, a, b), family, sure, like in found:
        if n == 1 or not any(line <= k < line + n for k in lines.get(d, ())):
            out.append((d, line, family, sure, like, a, b))
    return sorted(out, key=lambda r: (r[0], r[5], r[6]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, family, probability, similarity, confirmed, start, stop) of every paragraph of a family, in whole texts.

    line_no counts from 0 and is a wrapped run's first line; start and stop are code points. Null and empty texts have none; repeated rows repeat theirs; a
    null id stays. An empty table gives no rows. Other columns are left out, whatever their names. No shuffle; the model, of a fixed size, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = texts(docs, id_col, text_col)

    def run(frames):
        m = sent.value
        for f in frames:
            ids, whole, size, at = f["doc_id"].astype(object).tolist(), f["text"].tolist(), 0, 0
            for i, t in enumerate(whole):
                size += len(t) // 5
                if size < BATCH and i + 1 < len(whole):
                    continue
                rows = [(None if pd.isna(ids[at + k]) else int(ids[at + k]), line, family, sure, like, like >= CONFIRM, a, b) for k, line, family, sure, like, a, b in scan_texts(whole[at : i + 1], m)]
                out = pd.DataFrame(rows, columns=["doc_id", "line_no", "family", "probability", "similarity", "confirmed", "start", "stop"])
                yield out.astype({"doc_id": "Int64", "line_no": "int64", "start": "int64", "stop": "int64", "probability": float, "similarity": float, "confirmed": bool})
                size, at = 0, i + 1

    return d.mapInPandas(run, "doc_id long, line_no long, family string, probability double, similarity double, confirmed boolean, start long, stop long")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    return fit(training_rows(unknown_sample(texts(docs, id_col, text_col), most)))
