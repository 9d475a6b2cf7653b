"""Licence scan by a positional index of rare tokens.

A template is known by where its `rare` words of highest IDF stand in it; a match has to have the share `agree` of
these in their places.  Of n such places at least m have to agree, so of any n - m + 2 of them two do: the index lists
those with the rarest words.  A file's words that are listed are looked up, all of them and in the whole file.  Each
posting votes for the place where its template would have to begin, and the votes of one template meet where the words
keep their relative positions.  Every place with two votes (one where a single word suffices) is verified: enough of
the template's rare words must stand where they belong, and every mandatory key phrase must stand near.  So no place
that passes is missed, whatever stands around it.  Document frequencies are counted over all documents.

Besides, all places of the base phrases are counted; a base phrase gives its label without further conditions.

Texts are read whole, A-Z are lower-cased, and words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  Null text counts as
empty: no words, no labels, score 0.  Repeated rows are judged each on its own; an empty table gives no rows.
Template words of equal IDF are tied by their hash.  Of a template's places in a document the one where most agrees
is reported, the first if several do.  Only text and the columns of `keep` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import ALNUM_WORDS, batches, row_starts, text_bytes, word_hashes

#: Labels and phrases that are counted everywhere.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence texts and notices: label, text, key phrases that a match must hold.  Fixed values.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted", "without warranty of any kind"),
    ),
    "mit-notice": ("Released under the MIT License.", ("mit license",)),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        ("apache license", "version 2 0"),
    ),
    "apache-2.0-notice": ("Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    "gpl-2.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version",
        ("gnu general public license", "version 2"),
    ),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "bsd-2-clause-text": (_BSD_GRANT + _BSD_DISCLAIMER, ("redistributions in binary form must reproduce", "even if advised of the possibility of such damage")),
    "bsd-3-clause-text": (_BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER, ("neither the name", "endorse or promote products", "even if advised of the possibility of such damage")),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        ("apache license", "unless required by applicable law", "limitations under the license"),
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program.",
        ("gnu general public license", "without any warranty"),
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("the author disclaims all warranties", "use or performance of this software"),
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
        "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        ("free and unencumbered software", "overt act of relinquishment"),
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}


def hashed(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(buf, np.array([0, len(buf)]), ALNUM_WORDS, lower=True)[3]


class Index:
    """Words of all templates and phrases, postings of each word, and the words that each template must have."""

    def __init__(self, templates: Mapping[str, tuple[str, Sequence[str]]], base: Mapping[str, str]):
        self.labels = sorted(templates)
        self.bodies = [hashed(templates[x][0]) for x in self.labels]
        self.keys = [[hashed(p) for p in templates[x][1]] for x in self.labels]
        self.base = [(label, hashed(p)) for p, label in base.items()]
        self.words = np.unique(np.concatenate([*self.bodies, *(p for ps in self.keys for p in ps), *(p for _, p in self.base)]))
        number = lambda hs: np.searchsorted(self.words, hs)
        self.bodies, self.keys = [number(b) for b in self.bodies], [[number(p) for p in ps] for ps in self.keys]
        self.base = [(label, number(p)) for label, p in self.base]

    def post(self, rank: np.ndarray, rare: int, agree: float) -> None:
        """Where the `rare` rarest words of each template stand (`own`), the votes a match gets at least, and the postings by word."""
        rarest = [set(sorted(set(b.tolist()), key=lambda w: rank[w])[:rare]) for b in self.bodies]
        self.own = [np.array([(at, w) for at, w in enumerate(b.tolist()) if w in rarest[t]]).reshape(-1, 2) for t, b in enumerate(self.bodies)]
        need = [next(m for m in range(len(o) + 1) if m >= agree * len(o) or m / len(o) >= agree) for o in self.own]
        self.votes = np.array([max(1, min(2, m)) for m in need])
        listed = [o[np.lexsort((o[:, 0], rank[o[:, 1]]))][: len(o) - m + v] for o, m, v in zip(self.own, need, self.votes, strict=True)]
        rows = np.concatenate([np.column_stack([o, np.full(len(o), t)]) for t, o in enumerate(listed)])
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        self.post_at, self.post_template = rows[:, 0], rows[:, 2]
        self.first = np.searchsorted(rows[:, 1], np.arange(len(self.words) + 1))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words in h, and their numbers."""
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        pos = np.flatnonzero(self.words[at] == h)
        return pos, at[pos]


def _places(phrase: np.ndarray, pos: np.ndarray, num: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indices into pos where the phrase's words stand consecutively in one row."""
    n = len(phrase)
    if len(pos) < n:
        return np.zeros(0, np.int64)
    m = len(pos) - n + 1
    ok = (pos[n - 1 :] - pos[:m] == n - 1) & (row[n - 1 :] == row[:m])
    for i, w in enumerate(phrase):
        ok &= num[i : i + m] == w
    return np.flatnonzero(ok)


def frequencies(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each template word occurs."""

    def count(frames):
        for b in batches(frames):
            buf, offs = text_bytes(b.column("text"))
            _, _, row, h = word_hashes(buf, offs, ALNUM_WORDS, lower=True)
            pos, num = index.hits(h)
            seen = np.unique(row[pos] * len(index.words) + num) % len(index.words)
            n = np.bincount(seen, minlength=len(index.words))
            yield pa.RecordBatch.from_pydict({"word": np.append(np.arange(len(n)), -1), "n": np.append(n, b.num_rows)})

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(index.words) + 1, np.int64)  # a row for each template word
    for r in rows:
        out[r["word"]] = r["n"]
    return int(out[-1]), out[:-1]


def scan(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    templates: Mapping[str, tuple[str, Sequence[str]]] = TEMPLATES,
    base: Mapping[str, str] = BASE,
    rare: int = 16,
    agree: float = 0.6,
    slack: int = 8,
) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, matches and score of each document.

    matches: label, start (word), share of the template's rare words that agree.  score: 1 with a base phrase, else
    the largest share.
    """
    index = Index(templates, base)
    n_docs, df = frequencies(docs, index)
    idf = np.array([math.log((1 + n_docs) / (1 + int(x))) for x in df])
    order = np.lexsort((index.words, -idf))  # rarest first
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    index.post(rank, rare, agree)
    total = np.array([len(o) for o in index.own])
    longest = max((len(b) for b in index.bodies), default=0)

    def candidates(row: np.ndarray, at: np.ndarray, num: np.ndarray) -> np.ndarray:
        """Row, template and begin of the places on which enough postings agree."""
        n = index.first[num + 1] - index.first[num]
        hit = np.flatnonzero(n)
        if not len(hit):
            return np.zeros((0, 3), np.int64)
        row, at, num, n = row[hit], at[hit], num[hit], n[hit]
        which = np.repeat(index.first[num] - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, begin = index.post_template[which], np.repeat(at, n) - index.post_at[which]
        span = at.max() + longest + 1
        place, votes = np.unique((np.repeat(row, n) * len(total) + template) * span + begin + longest, return_counts=True)
        template = place // span % len(total)
        some = votes >= index.votes[template]
        place, template = place[some], template[some]
        return np.column_stack([place // span // len(total), template, place % span - longest])

    def matches(found: np.ndarray, starts: np.ndarray, pos: np.ndarray, num: np.ndarray, cut: np.ndarray) -> dict[int, list]:
        """Of the candidates those that are verified: (label, begin, share) by row."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for t in np.unique(found[:, 1]).tolist():
            here = found[found[:, 1] == t]
            at = here[:, 2, None] + index.own[t][:, 0]
            inside = (at >= 0) & (at < np.diff(starts)[here[:, 0]][:, None])
            want = starts[here[:, 0]][:, None] + at
            i = np.searchsorted(pos, want)
            i[i == len(pos)] = 0
            share = (inside & (pos[i] == want) & (num[i] == index.own[t][:, 1])).sum(axis=1) / total[t]
            for (r, _, begin), x in zip(here[share >= agree].tolist(), share[share >= agree].tolist(), strict=True):
                own = slice(cut[r], cut[r + 1])
                local, words = pos[own] - starts[r], num[own]
                end = begin + len(index.bodies[t]) + slack
                phrases = (local[_places(p, local, words, np.zeros(len(local), int))] for p in index.keys[t])
                if all(((p >= begin - slack) & (p <= end)).any() for p in phrases) and ((r, t) not in best or (x, -begin) > (best[r, t][0], -best[r, t][1])):
                    best[r, t] = (x, begin)
        out: dict[int, list] = {}
        for (r, t), (x, begin) in sorted(best.items()):
            out.setdefault(r, []).append((index.labels[t], begin, x))
        return out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*kinds, "n_words long", "n_base long", "first_word long", "last_word long", "base_labels string", "labels string", "score double", "matches array<struct<label:string,start:bigint,share:double>>"])
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))

    def scan_batches(frames):
        for b in batches(frames):
            n_rows = b.num_rows
            buf, offs = text_bytes(b.column("text"))
            _, _, row, h = word_hashes(buf, offs, ALNUM_WORDS, lower=True)
            starts = row_starts(row, n_rows)
            pos, num = index.hits(h)
            prow = row[pos]
            local = pos - starts[prow]
            n_base, first, last = np.zeros(n_rows, np.int64), np.full(n_rows, 2**62), np.full(n_rows, -1)
            labels: list[set[str]] = [set() for _ in range(n_rows)]
            for label, phrase in index.base:
                at = _places(phrase, pos, num, prow)
                np.add.at(n_base, prow[at], 1)
                np.minimum.at(first, prow[at], local[at])
                np.maximum.at(last, prow[at], local[at])
                for r in set(prow[at].tolist()):
                    labels[r].add(label)
            met = matches(candidates(prow, local, num), starts, pos, num, row_starts(prow, n_rows))
            found = [met.get(r, []) for r in range(n_rows)]
            cols = {c: b.column(c) for c in keep} | {
                "n_words": pa.array(np.diff(starts), pa.int64()),
                "n_base": pa.array(n_base),
                "first_word": pa.array(first, pa.int64(), mask=n_base == 0),
                "last_word": pa.array(last, pa.int64(), mask=n_base == 0),
                "base_labels": pa.array([",".join(sorted(x)) for x in labels]),
                "labels": pa.array([",".join(sorted(x | {m[0] for m in f})) for x, f in zip(labels, found, strict=True)]),
                "score": pa.array([1.0 if x else max([m[2] for m in f], default=0.0) for x, f in zip(labels, found, strict=True)]),
                "matches": pa.array([[{"label": m[0], "start": m[1], "share": m[2]} for m in f] for f in found], match_type),
            }
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(*keep, "text").mapInArrow(scan_batches, schema)
