"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .bitmaps import bitmap_of, probe

# Labels and phrases that count where their words stand consecutively.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Labels and wordings of public license notices, found also with words changed, added or left out.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
# Whole texts of short public licenses, as they are usually published, without names and years.
WHOLE = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)
TEMPLATES = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES + WHOLE]
#: Words in a k-gram; as long as the shortest phrase, so each place of a phrase has a vote for each of its k-grams.
K = 3
#: Diagonals so near to the one before belong to one place of a notice: words were added or left out there.
DRIFT = 3
#: Percent of a notice's words that must be found on the merged diagonals.
LEAST = 80


def _template_words() -> list[np.ndarray]:
    return [tk.words_list(text, tk.ALNUM, tk.FOLDED) for _, text, _ in TEMPLATES]


_RUN = pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int64())), ("grams", pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())])))])


def template_hits(documents: DataFrame) -> DataFrame:
    """row, doc_id, n_words, runs of every document: stretches around k-grams that a template may have, with all words that a template there could cover.

    All rolling k-gram hashes are made; a bitmap of the templates' spares those
    that can meet none the way to the join, where membership is settled.
    """
    words = _template_words()
    reach = max(map(len, words))
    grams = np.unique(np.concatenate([tk.gram_hashes(w, K) for w in words]))
    bits = bitmap_of(grams, 18)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for i, j, data, offsets in tk.text_chunks(batch.column(2)):
                words, _, _, first = tk.words_of(data, offsets, tk.ALNUM, tk.FOLDED)
                found = tk.gram_hashes(words, K)
                at = np.flatnonzero(probe(table, found))
                text = np.searchsorted(first, at, "right") - 1
                inside = at + K <= first[text + 1]
                at, text = at[inside], text[inside]
                runs: list[list] = [[] for _ in range(j - i)]
                new = np.flatnonzero((np.diff(text) != 0) | (np.diff(at) > 2 * reach)) + 1
                for a, b in zip([0, *new], [*new, len(at)], strict=True) if len(at) else ():
                    begin, stop = int(first[text[a]]), int(first[text[a] + 1])
                    low, high = max(begin, int(at[a]) - reach), min(stop, int(at[b - 1]) + reach)
                    votes = [{"pos": int(p) - begin, "gram": g} for p, g in zip(at[a:b], found[at[a:b]].view(np.int64).tolist(), strict=True)]
                    runs[text[a]].append({"start": low - begin, "words": words[low:high].view(np.int64), "grams": votes})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array(runs, pa.list_(_RUN))],
                    names=["row", "doc_id", "n_words", "runs"],
                )

    schema = "row long, doc_id long, n_words long, runs array<struct<start: long, words: array<long>, grams: array<struct<pos: long, gram: long>>>>"
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.lean(scan), schema)


def template_places(spark: SparkSession) -> DataFrame:
    """(gram, template, at) of every k-gram of the templates; as large as the constants above, whatever the data."""
    rows = [(g, t, at) for t, w in enumerate(_template_words()) for at, g in enumerate(tk.gram_hashes(w, K).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def merge_diagonals(diagonals: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(diagonal, votes) in groups of neighbours."""
    groups: list[list[tuple[int, int]]] = []
    for d in sorted(diagonals):
        if groups and d[0] - groups[-1][-1][0] <= DRIFT:
            groups[-1].append(d)
        else:
            groups.append([d])
    return groups


def verified(words: np.ndarray, start: int, template: np.ndarray, exact: bool, diagonals: list[tuple[int, int]]) -> Iterator[tuple[int, float]]:
    """(first word, share of the template's words found) of the places that hold. words begin at the document's word start."""
    if exact:
        yield from ((d, 1.0) for d, votes in diagonals if votes == len(template) - K + 1)
        return
    for group in merge_diagonals(diagonals):
        found = np.zeros(len(template), bool)
        for d, _ in group:
            low, high = max(0, start - d), min(len(template), start + len(words) - d)
            found[low:high] |= template[low:high] == words[low + d - start : high + d - start]
        if 100 * int(found.sum()) >= LEAST * len(template):
            yield group[0][0], int(found.sum()) / len(template)


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    All rolling k-gram hashes that a template may have are joined with the
    templates' positions; votes are added up by document, template and
    diagonal (document place less template place); neighbouring diagonals of
    a notice are merged, and the words under them compared. Of a phrase every
    k-gram must vote for the same diagonal. score: the largest share of a
    template's words found in a place that holds, 1 for a phrase, 0 for none.
    Null texts are empty; repeated rows each get theirs; a null doc_id is kept.
    Columns other than doc_id and text are not read.
    """
    hits = tk.scanned(template_hits(documents))
    runs = hits.select("row", F.explode("runs").alias("run"))
    votes = (
        runs.select("row", F.col("run.start").alias("start"), F.explode("run.grams").alias("g"))
        .select("row", "start", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
        .join(F.broadcast(template_places(documents.sparkSession)), "gram")
        .groupBy("row", "start", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("row", "start", "template")
        .agg(F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"))
    )
    placed = votes.join(runs.select("row", F.col("run.start").alias("start"), F.col("run.words").alias("words")), ["row", "start"]).select("row", "start", "template", "diagonals", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [w.view(np.int64) for w in _template_words()]
        for batch in batches:
            rows = []
            for i, (row, start, t, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                words = batch.column(4)[i].values.to_numpy()
                label, _, exact = TEMPLATES[t]
                rows += [(row, label, exact, at, share) for at, share in verified(words, start, templates[t], exact, [(d["diagonal"], d["votes"]) for d in diagonals])]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "label", "exact", "at", "share"])

    found = placed.mapInArrow(tk.lean(verify), "row long, label string, exact boolean, at long, share double")
    base = lambda c: F.when(F.col("exact"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_row = found.groupBy("row").agg(
        F.count(base("at")).alias("n_base"), F.min(base("at")).alias("first_word"), F.max(base("at")).alias("last_word"), joined(base("label")).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score")
    )
    out = hits.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op8_license_diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(tk.read(spark, sf_dir, "documents"))


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {quoted(text)})" for t, (label, text, exact) in enumerate(TEMPLATES))
    gram = "w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g"
    return rf"""
WITH tpl(t, label, exact, text) AS (VALUES {rows}),
tw AS (SELECT t, label, exact, unnest(ws) AS w, unnest(range(len(ws))) AS a, len(ws) AS m FROM (SELECT *, regexp_extract_all({low.format('text')}, '{word}') AS ws FROM tpl)),
tg AS (SELECT * FROM (SELECT *, {gram} FROM tw WINDOW o AS (PARTITION BY t ORDER BY a)) WHERE g IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, '{word}') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT * FROM (SELECT *, {gram} FROM w WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE g IS NOT NULL),
v AS (SELECT r, t, label, exact, m, p - a AS diagonal, count(*) AS votes FROM g JOIN tg USING (g) GROUP BY ALL),
grp AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal) AS grp FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS new FROM v)),
cover AS (SELECT grp.r, grp.t, grp.label, grp.m, grp.grp, min(diagonal) AS place, count(DISTINCT tw.a) AS found FROM grp JOIN tw ON tw.t = grp.t JOIN w ON w.r = grp.r AND w.p = tw.a + grp.diagonal AND w.w = tw.w
  WHERE NOT grp.exact GROUP BY ALL),
ok AS (SELECT r, label, true AS exact, diagonal AS place, 1.0::DOUBLE AS share FROM v WHERE exact AND votes = m - {K - 1}
  UNION ALL SELECT r, label, false, place, found::DOUBLE / m FROM cover WHERE 100 * found >= {LEAST} * m),
agg AS (SELECT r, count(*) FILTER (exact) AS n_base, min(place) FILTER (exact) AS first_word, max(place) FILTER (exact) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score FROM ok GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN agg USING (r)
"""


SQL = {"op8_license_diagonal_votes": _sql()}
QUERIES = {"op8_license_diagonal_votes": op8_license_diagonal_votes}
