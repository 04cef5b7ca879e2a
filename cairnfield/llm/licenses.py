"""Licence scan: windows of a text's lines against templates, by Dice over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. The bigrams
of all templates form a small hash index; only texts that share a bigram with it go on.
Dice >= t needs ``t / (2 - t) <= n_window / n_template <= (2 - t) / t``. A template's best
window counts. Dice is over multisets of bigrams. A text without line breaks is one line.

Windows of words (the query) start and end at any word, so a notice may share its line with
other words or be reflowed. A best window starts and ends with a bigram of the template, as
cutting others off raises Dice. For all such starts at once the overlap of the longest window
that the size bound allows is counted; only starts where it reaches ``t / (2 - t) * n_template``
are extended word by word. Windows of lines start and end at lines with shared bigrams.

Templates are a bounded reference list (notices here, whole licences in ``license_texts``), read by
the driver and passed to the tasks with the code. Defined cases: a
null, empty or one-word text has no match; ties go to the earliest and then shortest window; repeated
rows get equal answers; very long texts are scanned whole; other columns are carried along, but one called ``licenses`` is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words_py, table
from .vectext import ALNUM, chunks, shingle, strings, word_hashes

#: Short notices of common public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def full_texts() -> dict[str, str]:
    """Whole licences, named ``...-text`` (and longer notices, ``...-header``)."""
    found = {f.name[:-4] if f.name.endswith("-header.txt") else f"{f.name[:-4]}-text": f.read_text("utf-8") for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return dict(sorted(found.items())) | {"MIT-text": f"{TEMPLATES['MIT-grant']} {_MIT_REST}"}


def _bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def best_windows(text: str, templates: dict[str, Counter], threshold: float) -> list[tuple[str, float, int, int]]:
    """(template, dice, first line, last line) of each template's best window at the threshold or above."""
    lines = [alnum_words_py(x) for x in text.split("\n")]
    index: dict[tuple, set[str]] = {}
    for name, grams in templates.items():
        for g in grams:
            index.setdefault(g, set()).add(name)
    marked: dict[str, set[int]] = {}
    prev = None
    for i, words in enumerate(lines):
        for w in words:
            if prev:
                for name in index.get((prev[0], w), ()):
                    marked.setdefault(name, set()).update((prev[1], i))
            prev = (w, i)
    starts = np.cumsum([0, *map(len, lines)])
    out = []
    for name, at in sorted(marked.items()):
        grams, at = templates[name], sorted(at)
        n = grams.total()
        low, high, best = n * threshold / (2 - threshold), n * (2 - threshold) / threshold, None
        for k, first in enumerate(at):
            for last in at[k:]:
                size = starts[last + 1] - starts[first] - 1
                if size > high + 1e-9:
                    break
                if size >= low - 1e-9:
                    d = dice(_bigrams([w for x in lines[first : last + 1] for w in x]), grams)
                    if d >= threshold and (best is None or d > best[1]):
                        best = (name, d, first, last)
        if best:
            out.append(best)
    return out


def hash_templates(templates: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sorted different bigrams of all templates, and how often each template has each."""
    pairs = {name: shingle(word_hashes(strings(pa.array([t])), ALNUM)[0], 2) for name, t in templates.items()}
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs.values()]))
    return known, {name: np.bincount(np.searchsorted(known, p), minlength=len(known)) for name, p in sorted(pairs.items()) if len(p)}


def word_windows(words: np.ndarray, bounds: np.ndarray, known: np.ndarray, caps: dict[str, np.ndarray], threshold: float) -> dict[int, list[tuple[str, float, int, int]]]:
    """By text: (template, dice, first word, last word) of each template's best window at the threshold or above."""
    out: dict[int, list] = {}
    pairs = shingle(words, 2)
    if not len(pairs) or not len(known):
        return out
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    every = np.flatnonzero((known[place] == pairs) & (text_of[1:] == text_of[:-1]))
    for name, cap in caps.items():
        n = int(cap.sum())
        need, high = max(1, int(np.ceil(n * threshold / (2 - threshold) - 1e-9))), int(n * (2 - threshold) / threshold + 1e-9)
        at = every[cap[place[every]] > 0]
        text = text_of[at]
        if len(at) < need:
            continue
        close = (at[need - 1 :] - at[: len(at) - need + 1] < high) & (text[need - 1 :] == text[: len(at) - need + 1])
        inside = np.isin(text, np.unique(text[: len(close)][close]))
        at, text = at[inside], text[inside]
        if not len(at):
            continue
        gram, here = place[at], np.arange(len(at))
        order = np.argsort(gram, kind="stable")
        rank = here - np.searchsorted(gram[order], gram[order])
        # a bigram adds to a window's overlap if the one as many occurrences back as the template has is outside
        back = np.full(len(at), -1)
        more = rank >= cap[gram[order]]
        back[order[more]] = order[here[more] - cap[gram[order]][more]]
        earliest = np.maximum(np.searchsorted(at, at - high + 1), np.searchsorted(text, text))
        longest = np.cumsum(np.bincount(np.maximum(earliest, back + 1), minlength=len(at) + 1) - np.bincount(here + 1, minlength=len(at) + 1))[:-1]
        stop = np.minimum(np.searchsorted(at, at + high), np.searchsorted(text, text, "right"))
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(longest >= need):
            t, o = int(text[k]), int(longest[k])
            if t in best and 2 * o / (n + o) <= best[t][1]:
                continue
            d = 2 * np.cumsum(back[k : stop[k]] < k) / (n + at[k : stop[k]] - at[k] + 1)
            j = int(d.argmax())
            if d[j] >= threshold and (t not in best or d[j] > best[t][1]):
                best[t] = (name, float(d[j]), int(at[k] - bounds[t]), int(at[k + j] + 1 - bounds[t]))
        for t, hit in best.items():
            out.setdefault(t, []).append(hit)
    return out


def most_specific(hits: list[tuple[str, float, int, int]], alike: float = 0.8) -> list[tuple[str, float, int, int]]:
    """The hits by falling dice, then name, without those of a like wording: whose words nearly all lie in the window of a better hit, or whose window is nearly that of an equal one."""
    out: list[tuple[str, float, int, int]] = []
    for hit in sorted(hits, key=lambda h: (-h[1], h[0])):
        _, value, a, b = hit
        if not any(min(b, d) - max(a, c) >= alike * ((b - a) if other > value else (max(b, d) - min(a, c))) for _, other, c, d in out):
            out.append(hit)
    return out


def _with_lines(text: str, hits: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    ends = np.cumsum([len(alnum_words_py(x)) for x in text.split("\n")])
    return [(name, d, int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "right"))) for name, d, a, b in hits]


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.9, windows: str = "lines", specific: bool = False) -> DataFrame:
    """Add licenses: array<struct<license, dice, first_line, last_line>>, by falling dice, then name.

    windows: "words", or "lines" for windows of whole lines. specific: of templates that match nearly the same words only the best counts.
    """
    if windows not in ("words", "lines"):
        raise ValueError(f"windows: {windows}")
    grams = {name: _bigrams(alnum_words_py(t)) for name, t in templates.items()}
    grams = {name: g for name, g in grams.items() if g}
    names = [c for c in docs.columns if c != "licenses"]
    at = names.index(text)
    schema = docs.select(*names).schema.add("licenses", T.ArrayType(T.StructType().add("license", "string").add("dice", "double").add("first_line", "integer").add("last_line", "integer")))
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def listed(hits):
        return [dict(zip(("license", "dice", "first_line", "last_line"), h)) for h in sorted(hits, key=lambda h: (-h[1], h[0]))]

    def find(batches):
        known, caps = hash_templates(templates)
        for batch in batches:
            texts, out = strings(batch.column(at)), []
            for i, j in chunks(texts):
                words, bounds = word_hashes(texts.slice(i, j - i), ALNUM)
                if windows == "words":
                    by_text = word_windows(words, bounds, known, caps, threshold)
                    for k in range(j - i):
                        own = by_text.get(k, [])
                        hits = _with_lines(texts[i + k].as_py(), most_specific(own) if specific else own) if own else []
                        out.append(listed(hits))
                    continue
                pairs = shingle(words, 2)
                found = np.zeros(len(words) + 1, np.int64)
                if len(pairs):
                    place = np.searchsorted(known, pairs)
                    np.cumsum(known[np.minimum(place, len(known) - 1)] == pairs, out=found[1 : len(pairs) + 1])
                    found[len(pairs) + 1 :] = found[len(pairs)]
                ends = np.maximum(bounds[1:] - 1, bounds[:-1])
                for k in range(j - i):
                    hits = best_windows(texts[i + k].as_py(), grams, threshold) if found[ends[k]] > found[bounds[k]] else []
                    out.append(listed(hits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*names, "licenses"])

    return docs.select(*names).mapInArrow(find, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), templates=TEMPLATES | full_texts(), windows="words", specific=True)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"), F.round(F.get("licenses", 0)["dice"], 6).alias("best_dice"))
