"""Operator 9: licence scan by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z to a-z, words are runs of letters and digits (ASCII, or
any other byte above 127). Compared are the whole text and each of its lines, as sets of bigrams: a
licence may be the text, or a line of it. Dice = 2 |A and B| / (|A| + |B|) >= percent can only be met by
templates with percent |A| <= (200 - percent) |B| and the reverse, which prunes candidates by size;
units that hold too few bigrams of any template are passed over before their sets are built.

A licence that is neither the text nor a line of it (wrapped over lines, or within a line) is found as a window:
a run of words of one text, with up to a quarter more bigrams than the template has. A template's windows are
taken best first and do not overlap each other; of the windows of several templates and of matched texts and
lines that overlap, the one that shares most bigrams with its template is kept, and of these the one of best Dice. MORE and the
full texts in licenses/ are compared as windows alone, as the SQL knows TEMPLATES, texts and lines only;
a window is listed with the line of its first word.

Defined results: null or empty texts, and units of fewer than two words, match nothing; of equal Dice
the template first by name wins; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import arrow_limits, id_and_text

PERCENT = 90

# Names and wording of public licences and of the notices that refer to them.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-line": "Released under the MIT License.",
}

#: More notices, compared as windows.
MORE: dict[str, str] = {
    "agpl-3.0-notice": TEMPLATES["gpl-3.0-notice"].replace("GNU General", "GNU Affero General"),
    "bsd-3-clause": TEMPLATES["bsd-2-clause"].replace(
        "THIS SOFTWARE IS",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS",
        1,
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "lgpl-3.0-notice": TEMPLATES["gpl-3.0-notice"].replace("This program", "This library").replace("this program", "this library").replace("GNU General", "GNU Lesser General"),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def window_templates() -> dict[str, str]:
    """All that is looked for in windows: TEMPLATES, MORE and the full texts."""
    full = {f.stem.lower() + "-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return TEMPLATES | MORE | full


_WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def bigrams(column, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of each text (or of each line), the unit of each, and the text of each unit."""
    data, offsets = t.utf8(column)
    data = t.lower_ascii(data)
    bounds, texts = offsets, np.arange(len(offsets) - 1)
    if lines:
        breaks = np.flatnonzero(data == 10) + 1
        bounds = np.union1d(offsets, breaks)
        texts = t.owner(bounds[:-1], offsets)
    starts, ends = t.spans(_WORD_BYTE[data], bounds)
    of = t.owner(starts, bounds)
    hashes = t.joined(t.span_hashes(data, starts, ends), 2)
    inside = of[1:] == of[: len(hashes)]
    return hashes[inside], of[: len(hashes)][inside], texts


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = [np.unique(bigrams(pa.array([texts[n]]), False)[0]) for n in self.names]
        self.union = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)

    def scan(self, column, percent: int) -> list[tuple[int, int, int, float, int]]:
        """(text, line or -1, template, Dice, shared bigrams) of each unit's best template, in order."""
        found = []
        if not self.sets:
            return found
        for lines in (False, True):
            hashes, of, texts = bigrams(column, lines)
            place = np.minimum(np.searchsorted(self.union, hashes), len(self.union) - 1)
            hit = self.union[place] == hashes
            if not hit.any():
                continue
            # of the distinct bigrams that any template has, a match needs this many at least
            known = np.unique(np.stack([of[hit], place[hit]]), axis=1)[0]
            units, many = np.unique(known, return_counts=True)
            least = min(percent * len(s) / (200 - percent) for s in self.sets)
            first = np.searchsorted(of, units)
            last = np.searchsorted(of, units, side="right")
            line_of = np.zeros(len(texts), np.int64)
            if lines:
                line_of = np.arange(len(texts)) - np.searchsorted(texts, texts)
            for unit, a, b, most in zip(units[many >= least], first[many >= least], last[many >= least], many[many >= least], strict=True):
                own, best = np.unique(hashes[a:b]), None
                for k, template in enumerate(self.sets):
                    if percent * len(own) > (200 - percent) * len(template) or percent * len(template) > (200 - percent) * len(own) or 200 * most < percent * (len(own) + len(template)):
                        continue
                    shared = len(np.intersect1d(own, template, assume_unique=True))
                    if 200 * shared >= percent * (len(own) + len(template)):
                        dice = 2 * shared / (len(own) + len(template))
                        if best is None or dice > best[3]:
                            best = (int(texts[unit]), int(line_of[unit]) if lines else -1, k, dice, shared)
                if best:
                    found.append(best)
        return sorted(found)


def _before(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The place of the same hash before each one in its text, or -1."""
    order = np.lexsort((np.arange(len(hashes)), hashes, text_of[: len(hashes)]))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    out = np.full(len(hashes), -1, np.int64)
    out[order[1:]] = np.where(same, order[:-1], -1)
    return out


class Windows:
    """Templates to be found anywhere within texts."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        found = [bigrams(pa.array([texts[n]]), False)[0] for n in self.names]
        self.sets = [np.unique(x) for x in found]
        self.most = [len(x) + -(-len(x) // 4) for x in found]
        self.union = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def scan(self, column, percent: int, units: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """(text, line of the first word, name, Dice). units: text, line or -1 and shared bigrams of what is matched already."""
        if not len(self.union):
            return []
        data, offsets = t.utf8(column)
        data = t.lower_ascii(data)
        starts, ends = t.spans(_WORD_BYTE[data], offsets)
        hashes = t.joined(t.span_hashes(data, starts, ends), 2)
        if not len(hashes):
            return []
        text_of = t.owner(starts, offsets)
        across = text_of[1:] != text_of[:-1]
        hit = ~across & (self.union[np.minimum(np.searchsorted(self.union, hashes), len(self.union) - 1)] == hashes)
        if not hit.any():
            return []
        where = np.flatnonzero(hit)
        breaks = np.cumsum(data == 10)
        lines = breaks[starts] - np.concatenate([[0], breaks])[offsets[text_of]]
        last = np.searchsorted(text_of, text_of, side="right") - 1  # bigrams of a word's text end before this one
        covered = np.zeros(len(hashes), np.int64)  # the most bigrams shared by a match that a bigram is in
        for text, line, size in units:
            a, b = np.searchsorted(text_of, [text, text + 1])
            if line >= 0:
                a, b = a + np.searchsorted(lines[a:b], [line, line + 1])
            covered[a : b - 1] = np.maximum(covered[a : b - 1], size)
        chosen = []
        before = None
        for own, most, name in zip(self.sets, self.most, self.names, strict=True):
            if not len(own):
                continue
            places = where[np.isin(hashes[where], own)]
            need = -(-percent * len(own) // (200 - percent))
            many = np.searchsorted(places, np.minimum(places + most, last[places])) - np.arange(len(places))
            if not (many >= need).any():
                continue
            if before is None:
                before = _before(hashes, text_of)
            # distinct bigrams of the template in the longest window from each start: a place counts for the starts
            # behind the same bigram before it, so all windows are counted in one pass
            reach = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(reach, np.maximum(np.maximum(before[places], places - most) + 1, np.searchsorted(text_of, text_of[places])), 1)
            np.add.at(reach, places + 1, -1)
            held = np.zeros(len(hashes), bool)
            held[places] = True
            # the best window first: a start waits under the most it can reach, and is measured when its turn comes,
            # unless a window chosen before covers it
            reached = np.cumsum(reach)[places]
            open_ = places[reached >= need]
            reached = reached[reached >= need]
            waiting = list(zip((-2 * reached / (reached + len(own))).tolist(), open_.tolist(), [0] * len(open_), [0] * len(open_), strict=True))
            heapq.heapify(waiting)
            taken = np.zeros(len(hashes) if waiting else 0, bool)
            while waiting:
                least, i, stop, shared = heapq.heappop(waiting)
                if stop:
                    if not taken[i:stop].any():
                        taken[i:stop] = True
                        chosen.append((-shared, least, name, i, stop))
                elif not taken[i]:
                    stop = min(i + most, int(last[i]))
                    first, mine = before[i:stop] < i, held[i:stop]
                    shared, size = np.cumsum(first & mine), np.cumsum(first)
                    good = (200 * shared >= percent * (size + len(own))) & mine
                    if good.any():
                        dice = np.where(good, 2 * shared / (size + len(own)), 0)
                        j = int(np.argmax(dice))
                        heapq.heappush(waiting, (-float(dice[j]), i, i + j + 1, int(shared[j])))
        found = []
        for shared, dice, name, a, b in sorted(chosen):
            if covered[a:b].max() < -shared:
                covered[a:b] = -shared
                found.append((int(text_of[a]), int(lines[a]), name, -dice))
        return sorted(found)


def scan(documents: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, license and dice of its best match (the whole text before lines, earlier lines first), n_matches, matches."""
    arrow_limits(documents.sparkSession)
    known = TEMPLATES if templates is None else templates
    within = window_templates() if templates is None else templates
    schema = "doc_id long, license string, dice double, n_matches long, matches array<struct<line: int, license: string, dice: double>>"

    def run(batches):
        held, windows = Templates(known), Windows(within)
        kind = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))
        for batch in batches:
            for a, b in t.pieces(batch.column(1)):
                matches: list[list[dict]] = [[] for _ in range(b - a)]
                part = batch.column(1).slice(a, b - a)
                units = held.scan(part, percent)
                for text, line, k, dice, _ in units:
                    matches[text].append({"line": line, "license": held.names[k], "dice": dice})
                for text, line, name, dice in windows.scan(part, percent, [(text, line, shared) for text, line, _, _, shared in units]):
                    matches[text].append({"line": line, "license": name, "dice": dice})
                best = [max(m, key=lambda x: (x["dice"], x["line"] < 0, -x["line"])) if m else {"license": None, "dice": None} for m in matches]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x["license"] for x in best], pa.string()), pa.array([x["dice"] for x in best], pa.float64()), pa.array([len(m) for m in matches], pa.int64()), pa.array(matches, kind)], names=["doc_id", "license", "dice", "n_matches", "matches"])

    return id_and_text(documents).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.coalesce("license", F.lit("")).alias("license"), F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"), "n_matches")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LOWER = "translate(TEXT, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[a-z0-9\\x{80}-\\x{10FFFF}]+')"


def oracle(percent: int = PERCENT) -> str:
    """The same scan in DuckDB, every unit against every template."""
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tw AS (SELECT name, {_WORDS.replace("TEXT", "body")} AS w FROM (VALUES {rows}) AS v(name, body)),
t AS (SELECT name, {pairs} AS b FROM tw),
u AS (SELECT doc_id, -1 AS line, coalesce(text, '') AS unit FROM documents
      UNION ALL SELECT doc_id, unnest(range(0, len(parts))) AS line, unnest(parts) AS unit
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
uw AS (SELECT doc_id, line, {_WORDS.replace("TEXT", "unit")} AS w FROM u),
ub AS (SELECT doc_id, line, {pairs} AS b FROM uw WHERE len(w) > 1),
m AS (SELECT doc_id, line, name, 2.0 * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) AS dice FROM ub JOIN t
      ON {percent} * len(ub.b) <= {200 - percent} * len(t.b) AND {percent} * len(t.b) <= {200 - percent} * len(ub.b)
      WHERE 200 * len(list_intersect(ub.b, t.b)) >= {percent} * (len(ub.b) + len(t.b))),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, name) AS r FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, (line < 0) DESC, line) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE r = 1)
SELECT documents.doc_id, coalesce(name, '') AS license, round(coalesce(dice, 0.0), 6)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_matches
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id AND k = 1"""
