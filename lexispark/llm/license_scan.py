"""Operator 1, licence scans: passages against licence templates by Dice coefficient.

Texts and templates are normalised to lower-case words of letters, digits and
everything beyond ASCII. A passage is a line, a sentence of a line (up to ``.``, ``!``
or ``?`` and a space), a paragraph (consecutive lines with words) or a whole text;
its set holds its distinct word bigrams. A passage
of size a and a template of size b match if 2 |a & b| / (a + b) reaches the
threshold t, which needs t b / (2 - t) <= a <= (2 - t) b / t and at least
t b / (2 - t) common bigrams. Passages with fewer template bigrams than the
smallest template needs are pruned by a prefix sum, before any set is built;
each template is then compared only within its size bounds. A passage counts for
the licence it is most like, since notices of related licences differ in a few words.

One streamed pass without a shuffle; templates are a fixed list.

Defined results: a null or empty text matches nothing; passages of under two
words have no bigrams and match nothing; ties between licences go to the lesser
id; repeated rows are reported row by row; a null doc_id is carried; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K
from .common import doc_texts, map_batches, table

THRESHOLD = 0.8

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


class Templates:
    def __init__(self, rows: list[tuple[str, str]], threshold: float):
        self.threshold, self.sets = threshold, []
        for name, text in rows:
            for c in K.chunks(pa.array([text])):
                self.sets.append((name, frozenset(c.words(K.ALNUM_WORD, lower=True).grams(2)[0].tolist())))
        self.sets = [x for x in self.sets if x[1]]
        self.all = np.array(sorted({k for _, s in self.sets for k in s}), np.uint64)
        self.least = min((self.needed(len(s)) for _, s in self.sets), default=1 << 60)

    def needed(self, b: int) -> int:
        """Fewest common bigrams, and least size, of a passage that matches a template of size b."""
        return math.ceil(self.threshold * b / (2 - self.threshold) - 1e-9)

    def best(self, a: frozenset[int]) -> tuple[float, str] | None:
        """Greatest coefficient (negative) and its licence, the lesser id of equals."""
        out = []
        for name, b in self.sets:
            if self.needed(len(b)) <= len(a) <= (2 - self.threshold) * len(b) / self.threshold + 1e-9:
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= self.threshold:
                    out.append((-dice, name))
        return min(out, default=None)


def _passages(c: K.Chunk, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one word of lines, sentences, paragraphs and whole texts."""
    start, _, line_offs = c.lines()
    at = np.searchsorted(w.start, np.append(start, len(c.buf)))
    first, last = at[:-1], at[1:]
    blank = first == last
    row_start = np.zeros(len(start), bool)
    row_start[line_offs[:-1]] = True
    begins = np.flatnonzero(~blank & (row_start | np.append(True, blank[:-1])))
    ends = np.flatnonzero(~blank & np.append(row_start[1:] | blank[1:], True))
    stop = np.flatnonzero(np.isin(c.buf[:-1], np.frombuffer(b".!?", np.uint8)) & (c.buf[1:] == 32)) + 1
    cut = np.searchsorted(w.start, np.sort(np.concatenate([start, stop[~np.isin(stop, c.offs)], [len(c.buf)]])))
    return np.concatenate([first, cut[:-1], first[begins], w.offs[:-1]]), np.concatenate([last, cut[1:], last[ends], w.offs[1:]])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, comma-joined), best_license, best_dice for every row of docs."""
    t = Templates(templates, threshold)

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            w = c.words(K.ALNUM_WORD, lower=True)
            gram, at = w.grams(2)
            i = np.searchsorted(t.all, gram)
            i[i == len(t.all)] = 0
            known = np.zeros(len(w.key), bool)
            if len(t.all):
                known[at] = t.all[i] == gram
            key = np.zeros(len(w.key), np.uint64)
            key[at] = gram
            sums = np.append(0, np.cumsum(known))
            first, last = _passages(c, w)
            first, last = first[last - first > 1], last[last - first > 1]
            some = np.flatnonzero(sums[last - 1] - sums[first] >= t.least)
            found: list[dict[str, float]] = [{} for _ in range(c.n)]
            for p in some.tolist():
                row = int(np.searchsorted(w.offs, first[p], "right")) - 1
                if got := t.best(frozenset(key[first[p] : last[p] - 1].tolist())):
                    found[row][got[1]] = max(-got[0], found[row].get(got[1], 0.0))
            best = [min(((-d, n) for n, d in f.items()), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(c.first, c.n), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted(f)) for f in found], pa.string()),
                    pa.array([x and x[1] for x in best], pa.string()), pa.array([x and round(-x[0], 6) for x in best], pa.float64()),
                ],
                names=["doc_id", "n_licenses", "licenses", "best_license", "best_dice"],
            )

    return map_batches(doc_texts(docs), run, "doc_id long, n_licenses long, licenses string, best_license string, best_dice double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle(threshold: float = THRESHOLD) -> str:
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = ", ".join("({}, '{}', '{}')".format(i, n, x.replace("'", "''")) for i, (n, x) in enumerate(TEMPLATES))
    grams = "list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])"
    return f"""
with t0(tid, name, text) as (values {values}),
tw as (select tid, name, {words("text")} as ws from t0), t as (select tid, name, {grams} as gs from tw),
tg as (select tid, name, len(gs) as nb, unnest(gs) as g from t),
src as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
ln as (select rid, generate_subscripts(ls, 1) as k, unnest(ls) as line from (select rid, string_split(text, chr(10)) as ls from src)),
lw as (select rid, k, {words("line")} as ws from ln),
li as (select rid, k, ws, sum((len(ws) = 0)::int) over (partition by rid order by k) as par from lw),
ps as (select rid, 'l' || k as p, ws from li union all select rid, 's' || k || '.' || generate_subscripts(ss, 1) as p, {words("unnest(ss)")} as ws from (select rid, k, regexp_split_to_array(line, '[.!?] ') as ss from ln) union all select rid, 'p' || par, flatten(list(ws order by k)) from li where len(ws) > 0 group by rid, par union all select rid, 'd', {words("text")} from src),
pg as (select rid, p, {grams} as gs from ps where len(ws) > 1),
pd as (select rid, p, len(gs) as na, unnest(gs) as g from pg),
m as (select rid, p, name, 2.0::double * count(*) / (any_value(na) + any_value(nb)) as dice from pd join tg using (g) group by rid, p, tid, name having 2.0::double * count(*) / (any_value(na) + any_value(nb)) >= {threshold}),
b as (select rid, name, max(dice) as dice from (select *, row_number() over (partition by rid, p order by dice desc, name) as r from m) where r = 1 group by rid, name),
f as (select rid, count(*) as n_licenses, string_agg(name, ',' order by name) as licenses, arg_min(name, (-dice, name)) as best_license, round(max(dice), 6) as best_dice from b group by rid)
select doc_id, coalesce(n_licenses, 0) as n_licenses, coalesce(licenses, '') as licenses, best_license, best_dice from src left join f using (rid)"""
