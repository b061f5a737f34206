"""License scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

The templates are a small fixed table, so their inverted index (fingerprint to template and position) goes to every
task with the function. Words are runs of ASCII letters and digits and of non-ASCII characters, without regard to ASCII case. Each
text is cut into words, the words are hashed and every ``GRAM`` neighbouring words looked up in the index - vectorised over the bytes of a
batch. Only texts with a hit are aligned: hits of one template on neighbouring diagonals and near each other in the text make one
candidate, which is aligned with the template inside a band around those diagonals. The words before and behind an occurrence are
searched on, so notices that follow each other closely are all found.

Winnowing keeps the smallest of every ``WINDOW`` neighbouring fingerprints of a template, so any run of GRAM + WINDOW - 1 words
that a text shares with a template is found; templates of up to ``KEEP_ALL`` words keep all. With that every occurrence at
MIN_COVERAGE has a hit, if it has GRAM neighbouring words as they are - only one of five words with another in the middle has not.
An alignment may stray from its diagonals as far as the coverage allows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, quoted

#: Words in a fingerprint, and neighbouring fingerprints of which one is kept.
GRAM, WINDOW = 3, 2
#: Words of the longest template that keeps all its fingerprints: runs of at most three words make up four fifths of no longer one.
KEEP_ALL = 15
#: Words that an alignment may stray from its candidate's diagonals, at least.
BAND = 8
#: Matched words as a share of a template's words and those put between.
MIN_COVERAGE = 0.8
#: Bytes hashed at once.
BLOCK = 1 << 22

# The notices that are looked for.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "mit-short": "Released under the MIT License.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "mit-licensed": "Licensed under the MIT License.",
    "bsd-2-clause-short": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-short": "Licensed under the BSD 3-Clause License.",
    "bsd-no-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "gpl-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-short": "CC0 1.0 Universal",
}

# What tells a template apart: runs of its words that must be found without a word replaced or put between.
IDENTITY = {
    "apache-2.0-short": ("Apache", "2.0"),
    "apache-2.0": ("Apache", "2.0"),
    "mit-short": ("MIT",),
    "gpl-3.0-short": ("GNU General Public License", "3"),
    "gpl-3.0": ("GNU General Public License", "3"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0",),
    "cc-by-nc-4.0-short": ("CC BY-NC 4.0",),
    "cc-by-sa-4.0-short": ("CC BY-SA 4.0",),
    "cc-by-4.0-short": ("CC BY 4.0",),
    "mit-licensed": ("MIT",),
    "bsd-2-clause-short": ("BSD 2-Clause",),
    "bsd-3-clause-short": ("BSD 3-Clause",),
    "mpl-2.0": ("Mozilla Public License v. 2.0",),
    "gpl-2.0-short": ("GNU General Public License", "2"),
    "gpl-2.0": ("GNU General Public License", "2"),
    "lgpl-3.0-short": ("GNU Lesser General Public License", "3"),
    "lgpl-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "agpl-3.0": ("GNU Affero General Public License", "3"),
    "epl-2.0": ("Eclipse Public License 2.0",),
    "bsl-1.0": ("Boost Software License", "1.0"),
    "cc0-1.0-short": ("CC0 1.0 Universal",),
}

# Identifiers of which "SPDX-License-Identifier:" lines are looked for.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-2.0", "MS-PL", "OFL-1.1", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
)
TEMPLATES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
IDENTITY |= {f"spdx-{x.lower()}": (f"SPDX-License-Identifier: {x}",) for x in SPDX}

# The Creative Commons statements follow one form: parts beside Attribution, and versions with their scope.
_PARTS = {"sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
for _kind in ("", "sa", "nc", "nd", "nc-sa", "nc-nd"):
    _code, _title = "-".join(filter(None, ("by", _kind))), "-".join(["Attribution", *[_PARTS[x] for x in _kind.split("-") if x]])
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES.setdefault(f"cc-{_code}-{_version}", f"This work is licensed under a Creative Commons {_title} {_version} {_scope} License.")
        IDENTITY.setdefault(f"cc-{_code}-{_version}", (f"Creative Commons {_title} {_version}",))
        TEMPLATES.setdefault(f"cc-{_code}-{_version}-short", f"Licensed under CC {_code.upper()} {_version}.")
        IDENTITY.setdefault(f"cc-{_code}-{_version}-short", (f"CC {_code.upper()} {_version}",))

_BASE = 0x9E3779B97F4A7C15  # odd, so it can be divided by
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint64) + 1
_FOLD[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IN_WORD[_lo:_hi] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of UTF-8 ``data``; long input is taken in blocks that end between words."""
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + BLOCK)
        raw = np.frombuffer(data, dtype=np.uint8, count=end - start, offset=start)
        if end < len(data):
            outside = np.flatnonzero(~_IN_WORD[raw])
            if len(outside) and outside[-1]:  # a word longer than a block is cut
                end = start + int(outside[-1])
                raw = raw[: end - start]
        edge = np.diff(_IN_WORD[raw].astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_FOLD[raw] * _UP[: len(raw)], dtype=np.uint64)))
        out.append((first + start, last + start, _mix((sums[last] - sums[first]) * _DOWN[first])))
        start = end
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def grams(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of every GRAM neighbouring words."""
    n = max(0, len(hashes) - GRAM + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return _mix(out)


def winnow(prints: np.ndarray) -> np.ndarray:
    """Positions kept: the last smallest fingerprint of every WINDOW neighbours (all of fewer: the smallest)."""
    n = len(prints)
    kept = {max(range(i, min(i + WINDOW, n)), key=lambda j: (-int(prints[j]), j)) for i in range(max(1, n - WINDOW + 1))} if n else set()
    return np.array(sorted(kept), dtype=np.int64)


class Scanner:
    """The templates' inverted index and the alignment."""

    def __init__(self, templates: dict[str, str], identity: dict[str, tuple[str, ...]] | None = None):
        self.names = sorted(templates)
        self.words = [words(templates[x].encode())[2] for x in self.names]
        self.phrases = [[words(p.encode())[2] for p in (identity or {}).get(x, ())] for x in self.names]
        self.marks = [[_places(w, words(p.encode())[2]) for p in (identity or {}).get(x, ())] for x, w in zip(self.names, self.words)]
        rows = [(int(g[p]), t, int(p)) for t, w in enumerate(self.words) for g in [grams(w)] for p in (range(len(g)) if len(w) <= KEEP_ALL else winnow(g))]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], dtype=np.uint64)
        self.where = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 2)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """(template, word of the text, diagonal) of every looked-up fingerprint, ordered."""
        found = grams(hashes)
        lo, hi = np.searchsorted(self.prints, found, "left"), np.searchsorted(self.prints, found, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return np.empty((0, 3), np.int64)
        n = (hi - lo)[at]
        rows = np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.stack([self.where[rows, 0], np.repeat(at, n), np.repeat(at, n) - self.where[rows, 1]], axis=1)
        return np.unique(out, axis=0)

    def matches(self, hashes: np.ndarray, min_coverage: float) -> Iterator[tuple[str, float, int, int]]:
        """Template, coverage, first and last word of each alignment that covers enough.

        Of occurrences that overlap the one with the most matched words counts, then the one with the best coverage, then the first.
        """
        hits = self.hits(hashes)
        edges = [0, *(np.flatnonzero(np.diff(hits[:, 0])) + 1), len(hits)]
        found = []
        for a, b in zip(edges, edges[1:]):
            if b > a:
                found += self._occurrences(int(hits[a, 0]), hits[a:b, 1], hits[a:b, 2], hashes, min_coverage)
        starts, kept = [], {}
        for _, share, first, last, name in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            i = bisect.bisect_right(starts, last)  # of those that start no later than this one ends, the last one ends last
            if not i or kept[starts[i - 1]][3] < first:
                starts.insert(i, first)
                kept[first] = (name, share, first, last)
        yield from (kept[x] for x in starts)

    def _identified(self, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether each mark of the template is matched somewhere by neighbouring words of the text."""
        at = dict(pairs)
        return all(any(all(p + i in at and at[p + i] == at[p] + i for i in range(n)) for p in places) for places, n in self.marks[t])

    def _occurrences(self, t: int, at: np.ndarray, diagonals: np.ndarray, hashes: np.ndarray, min_coverage: float) -> Iterator[tuple[int, float, int, int, str]]:
        """Matched words, coverage, first and last word and name of all occurrences of one template that do not overlap; ``at`` ascends.

        Coverage is the share of matched words among the template's words and those put between. An occurrence thus has at most
        1 / min_coverage times the template's words.

        Around the first hit left, the words that an occurrence with it can reach are aligned. What lies before the occurrence
        found and what lies behind it is searched in turn, until no hit is left.
        """
        template = self.words[t]
        spare = math.ceil(len(template) / max(min_coverage, 1e-9)) - len(template)  # words put between, at most
        band, reach = max(BAND, spare), len(template) + max(BAND, len(template), spare)
        todo = [(0, len(hashes), 0)]  # words from and to, first hit to look at
        while todo:
            lo, hi, k = todo.pop()
            k = max(k, int(np.searchsorted(at, lo)))
            if k == len(at) or at[k] + GRAM > hi:
                continue
            start, end = max(lo, int(at[k]) - reach), min(hi, int(at[k]) + reach)
            near = diagonals[np.searchsorted(at, start) : np.searchsorted(at, end - GRAM, "right")]
            near = self._chain(near, int(diagonals[k]), band)
            text = hashes[start:end]
            pairs, share = [], 0.0
            if all(_holds(text, p) for p in self.phrases[t]) and np.isin(template, text).sum() >= min_coverage * len(template):
                pairs, inserted = _aligned(template, text, int(near[0]) - band - start, int(near[-1]) + band - start)
                share = len(pairs) / (len(template) + inserted)
            if pairs and share >= min_coverage and self._identified(t, pairs):
                first, last = pairs[0][1] + start, pairs[-1][1] + start
                yield len(pairs), share, first, last, self.names[t]
                todo += [(last + 1, hi, k), (lo, first, k)]
            else:
                todo.append((lo, hi, k + 1))

    @staticmethod
    def _chain(diagonals: np.ndarray, own: int, band: int) -> np.ndarray:
        """The diagonals that ``own`` reaches in steps of up to ``band``."""
        found = np.unique(diagonals)
        groups = np.split(found, np.flatnonzero(np.diff(found) > band) + 1)
        return next(g for g in groups if g[0] <= own <= g[-1])


def _holds(text: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the words of the phrase stand in a row somewhere in the text."""
    n = len(text) - len(phrase) + 1
    if n <= 0:
        return False
    found = np.ones(n, dtype=bool)
    for i, x in enumerate(phrase):
        found &= text[i : i + n] == x
    return bool(found.any())


def _places(template: np.ndarray, phrase: np.ndarray) -> tuple[list[int], int]:
    """Where the template holds the phrase, and its words."""
    n = len(phrase)
    return [p for p in range(len(template) - n + 1) if np.array_equal(template[p : p + n], phrase)], n


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment inside the diagonals low..high: matched words, first and last matched word of the text."""
    pairs, _ = _aligned(template, text, low, high)
    return (len(pairs), pairs[0][1], pairs[-1][1]) if pairs else (0, -1, -1)


def _aligned(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[list[tuple[int, int]], int]:
    """Best local alignment inside the diagonals low..high: matched words (of template and text), and words put between.

    A match adds 2; a replaced, an inserted or a skipped word costs 1. Of equally good alignments the one that ends first in the
    template, then in the text, counts. Cells hold (score, matches, words put between, matched pairs from the last).
    """
    none = (0, 0, 0, None)
    best = none
    above: dict[int, tuple] = {}
    for i, w in enumerate(template.tolist()):
        row: dict[int, tuple] = {}
        left = none
        j0, j1 = max(0, i + low), min(len(text), i + high + 1)
        for j, x in enumerate(text[j0:j1].tolist(), j0):
            s, n, more, pairs = above.get(j - 1, none)
            diagonal = (s + 2, n + 1, more, (i, j, pairs)) if x == w else (s - 1, n, more, pairs)
            up = above.get(j, none)
            cell = max(diagonal, (up[0] - 1, *up[1:]), (left[0] - 1, left[1], left[2] + 1, left[3]), key=lambda c: (c[0], c[1]))
            if cell[0] <= 0:
                cell = none
            row[j] = left = cell
            if x == w and cell[0] > best[0]:
                best = cell
        above = row
    out, rest = [], best[3]
    while rest:
        out.append(rest[:2])
        rest = rest[2]
    return out[::-1], best[2]


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs`` and template found: the columns ``keep``, license, coverage (the best), n_matches and spans.

    Where templates overlap only the best one counts, and each of TEMPLATES needs its words of IDENTITY.
    ``spans`` lists start:end of each occurrence in code points (end exclusive), ascending, comma-joined. Null, empty and
    license-free texts give no row; repeated rows give their rows again; a template of fewer than GRAM words is refused.
    Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    scanner = Scanner(templates or TEMPLATES, None if templates else IDENTITY)
    if any(len(w) < GRAM for w in scanner.words):
        raise ValueError(f"a template needs {GRAM} words at least")
    made_names = clear_of(keep, "license", "coverage", "n_matches", "spans")
    kinds = ("string", "double", "int", "string")
    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.select(*quoted(keep)).dtypes, *zip(made_names, kinds)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1)):
                data = data.as_py().encode("utf-8", "surrogatepass")
                first, last, hashes = words(data)
                spans: dict[str, list] = {}
                for name, share, a, b in scanner.matches(hashes, min_coverage):
                    start, end = (len(data[:x].decode("utf-8", "surrogatepass")) for x in (int(first[a]), int(last[b])))
                    spans.setdefault(name, []).append((start, end, share))
                for name, each in sorted(spans.items()):
                    rows.append(i)
                    out.append((name, max(x[2] for x in each), len(each), ",".join(f"{a}:{b}" for a, b in sorted({x[:2] for x in each}))))
            kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(batch.num_columns - 1)]
            made = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(kept + made, [*batch.schema.names[:-1], *made_names])

    text_name = clear_of(keep, "__text")[0]
    return docs.select(*quoted(keep), F.col(f"`{text}`").alias(text_name)).where(F.col(text_name).isNotNull()).mapInArrow(found, schema)
