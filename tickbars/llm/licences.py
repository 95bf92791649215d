"""Licence texts, notices and tags in documents, by the Dice coefficient over word bigrams.

Text and templates are normalised alike: A-Z in lower case, words are runs of ASCII letters and digits and of other
characters. Lines without words don't count, so comment signs and blank lines don't matter. A line's bigrams are those of
its words and the one that leads to the next line. Per document and template:

1. A line is of the template if at least half of its distinct bigrams are. Such lines, with one other line between them
   at most, make a run. (A single word at the very end has no bigram and is in none.)
2. A run, and each line of the template by itself, is compared if its number of bigrams lies within the bounds that
   a match can have: between n*d/(2-d) and n*(2-d)/d for a template of n and a threshold of d. Bigrams count as often as
   they occur.
3. A run is a match if its score reaches the threshold and that of each of its lines; else those of its lines are that
   reach the threshold.

Of templates of one family that match from the same line on, the best is a match, of equal ones that of the smaller id.

Only DataFrame functions are used; everything happens within the row, so there is no shuffle. A match has all but a part of
a template's bigrams, hence one at least of so many first words (anchors) as outweigh that part: a document is compared
with the templates of which it has an anchor, most documents with none.

Defined cases: a null or empty text has no match; units of fewer than two words have no bigrams and never match;
repeated rows get repeated results; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.tools import free_name

THRESHOLD = 0.8

# The wording of public licences' usual notices, and of the shorter licences.
_NOTICES: dict[str, str] = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
        FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT/line": "Released under the MIT License.",
    "MPL-2.0/notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

# Tags of licences, as SPDX-License-Identifier and as they are cited.
_TAGS = (
    "Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC"
    " LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0"
    " CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0"
).split()
_HEADINGS = {
    "GPL-2.0/heading": "GNU General Public License Version 2, June 1991",
    "GPL-3.0/heading": "GNU General Public License Version 3, 29 June 2007",
    "LGPL-2.1/heading": "GNU Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0/heading": "GNU Lesser General Public License Version 3, 29 June 2007",
}


def _published() -> dict[str, str]:
    """The whole texts that come with the package, as they were published."""
    folder = resources.files(__package__) / "licence_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


def _templates() -> dict[str, str]:
    out = {**_NOTICES, **_HEADINGS, **_published()}
    for tag in _TAGS:
        out[f"{tag}/spdx"] = f"SPDX-License-Identifier: {tag}"
        if tag.startswith("CC-"):
            out[f"{tag}/tag"] = f"CC {tag[3:-4]} 4.0"
            out.setdefault(f"{tag}/line", f"Licensed under CC {tag[3:-4]} 4.0.")
    return out


# Id of a licence, and after a slash what of it the text is, to the text.
TEMPLATES = _templates()


def family(template: str) -> str:
    """Licences of one family are versions of one another."""
    name = template.split("/")[0].split("-")[0]
    return "GNU" if name in ("GPL", "LGPL") else name


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII without letters, digits and the line feed.
_SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# Other lines than those of the template that a run may have between them.
GAP = 1
_MATCH = "struct<family:string,first:int,less:double,id:string,last:int>"


def bigrams(text: str) -> list[str]:
    """The word bigrams of a template, in order."""
    folded = re.sub(_SEPARATORS, " ", text.translate(str.maketrans(_CAPITALS, _SMALL)))
    ws = folded.split()
    return [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams that a match of a template of n can have."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


# Words of any English text; they tell nothing about licences.
_COMMON = frozenset(
    "a about all also an and any are as at be been but by can do each for from had has have if in into is it its may more must"
    " no not of on only or other our out shall should so such than that the their them then there these they this those to"
    " under up was we were what when where which who will with would you your".split()
)


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Words, long ones first and common ones last, one of which every match has: more bigrams begin with them than a
    match can lack."""
    firsts = Counter(g.split(" ")[0] for g in grams)
    lacking, out = len(grams) - bounds(len(grams), threshold)[0], []
    for word in sorted(firsts, key=lambda w: (w in _COMMON, -len(w), w)):
        out.append(word)
        lacking -= firsts[word]
        if lacking < 0:
            break
    return out


def _words_literal(words: list[str]) -> Column:
    """An array of words or bigrams as one piece of text, which is cut when the plan is made."""
    return F.split(F.lit("\n".join(words)), "\n") if words else F.expr("cast(array() as array<string>)")


def _literals(templates: dict[str, str], threshold: float) -> Column:
    rows = []
    for name, text in sorted(templates.items()):
        grams = bigrams(text)
        lo, hi = bounds(len(grams), threshold)
        # A match has `lo` of the template's bigrams at least; each one that is missing takes one away at least.
        need = len(set(grams)) - (len(grams) - lo)
        again = sorted((g, n) for g, n in Counter(grams).items() if n > 1)
        times = F.split(F.lit(",".join(str(n) for _, n in again)), ",").cast("array<int>") if again else F.expr("cast(array() as array<int>)")
        values = {"id": F.lit(name), "family": F.lit(family(name)), "lo": F.lit(lo), "hi": F.lit(hi), "need": F.lit(max(need, 1))}
        arrays = {"anchors": _words_literal(anchors(grams, threshold)), "grams": _words_literal(grams), "repeated": _words_literal([g for g, _ in again]), "times": times}
        rows.append(F.struct(*[c.alias(n) for n, c in {**values, **arrays}.items()]))
    return F.array(*rows)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shared(grams: Column, t: Column) -> Column:
    """How many bigrams a list has in common with a template, each as often as in both."""
    often = _let(
        F.array_intersect(t["repeated"], grams),
        lambda known: F.transform(
            F.filter(F.arrays_zip(t["repeated"].alias("gram"), t["times"].alias("times")), lambda r: F.array_contains(known, r["gram"])),
            lambda r: F.least(F.size(F.filter(grams, lambda g: g == r["gram"])), r["times"]) - 1,
        ),
    )
    return F.aggregate(often, F.size(F.array_intersect(grams, t["grams"])), lambda n, more: n + more)


def _bigrams_of(lines: Column) -> Column:
    """The bigrams of each line, with the one that leads to the next line."""

    def of(ws: Column, k: Column) -> Column:
        after = F.coalesce(F.slice(F.get(lines, k + 1), 1, 1), F.expr("cast(array() as array<string>)"))
        seconds = F.concat(F.slice(ws, F.lit(2), F.size(ws)), after)
        return _let(seconds, lambda ys: F.zip_with(F.slice(ws, F.lit(1), F.size(ys)), ys, lambda x, y: F.concat_ws(" ", x, y)))

    return F.transform(lines, of)


def _matches(t: Column, lines: Column, grams: Column, every: Column, threshold: float) -> Column:
    """Matches of one template among lines with their bigrams, `every` being all of these in one array."""
    none = F.expr(f"cast(array() as array<{_MATCH}>)")

    def score(i: Column, j: Column) -> Column:
        """Of the lines from i to j; 0 outside of the bounds."""
        n = F.aggregate(F.slice(lines, i + 1, j - i + 1), F.lit(-1), lambda acc, ws: acc + F.size(ws))
        text = lambda n: F.slice(F.flatten(F.slice(grams, i + 1, j - i + 1)), F.lit(1), n)
        dice = lambda n: _let(text(n), lambda g: F.lit(2.0) * _shared(g, t) / (n + F.size(t["grams"])))
        return _let(n, lambda n: F.when(n.between(t["lo"], t["hi"]), dice(n)).otherwise(F.lit(0.0)))

    def match(score: Column, i: Column, j: Column) -> Column:
        return F.struct(t["family"].alias("family"), i.alias("first"), (-score).alias("less"), t["id"].alias("id"), j.alias("last"))

    def of_run(run: Column, known: Column) -> Column:
        i, j = run["i"], run["j"]
        single = F.transform(
            F.filter(F.sequence(i, j), lambda k: F.get(known, k)), lambda k: match(score(k, k), k, k)
        )
        good = lambda ms: F.filter(ms, lambda m: -m["less"] >= threshold)
        whole = lambda m, ms: (-m["less"] >= threshold) & (m["less"] <= F.array_min(F.transform(ms, lambda x: x["less"])))
        several = lambda ms: _let(match(score(i, j), i, j), lambda m: F.when(whole(m, ms), F.array(m)).otherwise(good(ms)))
        return _let(single, lambda ms: F.when(i == j, good(ms)).otherwise(several(ms)))

    def runs_of(known: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(known) - 1)
        is_known = lambda k: F.coalesce(F.get(known, k), F.lit(False))
        alone = lambda k, step: is_known(k) & ~is_known(k + step) & ~is_known(k + 2 * step)
        ends = F.arrays_zip(
            F.filter(places, lambda k: alone(k, -1)).alias("i"), F.filter(places, lambda k: alone(k, 1)).alias("j")
        )
        return F.flatten(F.transform(ends, lambda run: of_run(run, known)))

    def known_lines(present: Column) -> Column:
        half = lambda g: 2 * F.size(F.array_intersect(g, present)) >= F.size(F.array_distinct(g))
        return F.transform(grams, lambda g: (F.size(g) > 0) & half(g))

    present = F.array_intersect(every, t["grams"])
    return _let(present, lambda p: F.when(F.size(p) >= t["need"], _let(known_lines(p), runs_of)).otherwise(none))


def _best_of_families(matches: Column) -> Column:
    """Of the matches of one family from one line on the first in order."""
    start = lambda m: F.struct(m["family"], m["first"])
    best = lambda ms: F.filter(ms, lambda m, i: (i == 0) | (start(F.get(ms, i - 1)) != start(m)))
    return _let(F.array_sort(matches), best)


def licence_matches(
    df: DataFrame,
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The frame with `matches`: the id of the template, the score, and the first and last line, blank ones not counted.

    A column named `matches` that the frame has is replaced.
    """
    table = {name: text for name, text in (TEMPLATES if templates is None else templates).items() if bigrams(text)}
    kept = [F.col(f"`{c}`") for c in df.columns if c != "matches"]
    shown = "array<struct<id:string,score:double,first:int,last:int>>"
    if not table:
        return df.select(*kept, F.expr(f"cast(array() as {shown})").alias("matches"))
    folded_name, hits_name, found_name = (free_name(df, name) for name in ("folded", "hits", "found"))
    folded = F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), _CAPITALS, _SMALL), _SEPARATORS, " ")
    every = _words_literal(sorted({w for t in table.values() for w in anchors(bigrams(t), threshold)}))
    hits = F.array_intersect(F.split(F.col(folded_name), "[ \n]+"), every)
    words = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    lines = F.filter(F.transform(F.split(F.col(folded_name), "\n"), words), lambda ws: F.size(ws) > 0)
    likely = F.filter(_literals(table, threshold), lambda t: F.arrays_overlap(F.col(hits_name), t["anchors"]))
    of_lines = lambda ls, gs: _let(F.flatten(gs), lambda every: F.flatten(F.transform(likely, lambda t: _matches(t, ls, gs, every, threshold))))
    found = _let(lines, lambda ls: _let(_bigrams_of(ls), lambda gs: of_lines(ls, gs)))
    none = F.expr(f"cast(array() as array<{_MATCH}>)")
    one = lambda m: F.struct(m["id"].alias("id"), (-m["less"]).alias("score"), m["first"].alias("first"), m["last"].alias("last"))
    return (
        df.select(*kept, folded.alias(folded_name))
        .select(*kept, folded_name, hits.alias(hits_name))
        .select(*kept, F.when(F.size(hits_name) > 0, found).otherwise(none).alias(found_name))
        .select(*kept, F.transform(_best_of_families(F.col(found_name)), one).alias("matches"))
    )


def licence_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: the number of matches, the best match and its score, and all licence templates found."""
    found = licence_matches(docs.select("doc_id", "text"), threshold=threshold)
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["score"]).alias("less"), m["id"].alias("id"))))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["id"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        best["id"].alias("licence"),
        (-best["less"]).alias("score"),
        F.array_join(names, ",").alias("licences"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The report in the SQL of DuckDB."""
    rows, sizes = [], []
    for name, text in sorted(TEMPLATES.items()):
        grams = bigrams(text)
        lo, hi = bounds(len(grams), threshold)
        sizes.append(f"('{name}', '{family(name)}', {len(grams)}, {lo}, {hi})")
        rows += [f"('{name}', '{g}', {n})" for g, n in sorted(Counter(grams).items())]
    return f"""
    with known(id, gram, times) as (values {", ".join(rows)}),
    sizes(id, family, n, lo, hi) as (values {", ".join(sizes)}),
    folded as (
      select row_number() over () as r, doc_id,
             regexp_replace(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_SEPARATORS}', ' ', 'g') as t
      from documents),
    cut as (select r, string_split(t, chr(10)) as ls from folded),
    placed as (select r, unnest(range(1, len(ls) + 1)) as place, unnest(ls) as l from cut),
    worded as (select r, place, [w for w in string_split(l, ' ') if w <> ''] as ws from placed),
    numbered as (select r, row_number() over (partition by r order by place) as k, ws from worded where len(ws) > 0),
    lines as (select r, k, ws, len(ws) as nw, lead(ws[1]) over (partition by r order by k) as after,
                     sum(len(ws)) over (partition by r order by k) as total from numbered),
    grams as (
      select r, k, ws[p] || ' ' || ws[p + 1] as gram, false as leads from (select r, k, ws, unnest(range(1, len(ws))) as p from lines)
      union all select r, k, ws[len(ws)] || ' ' || after, true from lines where after is not null),
    of_line as (select r, k, count(distinct gram) as d from grams group by all),
    met as (select g.r, g.k, m.id, count(distinct g.gram) as s from grams g join known m using (gram) group by all),
    flagged as (select r, id, k from met join of_line using (r, k) where 2 * s >= d),
    stepped as (select *, coalesce(k - lag(k) over (partition by r, id order by k) > {GAP + 1}, false)::int as fresh from flagged),
    islands as (select r, id, k, sum(fresh) over (partition by r, id order by k) as island from stepped),
    runs as (
      select r, id, island, min(k) as i, max(k) as j, true as whole from islands group by all having min(k) < max(k)
      union all select r, id, island, k, k, false from islands),
    fitting as (
      select c.*, b.total - a.total + a.nw - 1 as n, z.n as size, z.family
      from runs c join lines a on a.r = c.r and a.k = c.i join lines b on b.r = c.r and b.k = c.j join sizes z on z.id = c.id
      where b.total - a.total + a.nw - 1 between z.lo and z.hi),
    counted as (
      select f.r, f.id, f.family, f.island, f.i, f.j, f.whole, f.n, f.size, g.gram, count(*) as times
      from fitting f join grams g on g.r = f.r and g.k between f.i and f.j and not (g.leads and g.k = f.j) group by all),
    scored as (
      select c.r, c.id, c.family, c.island, c.i, c.j, c.whole, 2.0::double * sum(least(c.times, m.times)) / (any_value(c.n) + any_value(c.size)) as score
      from counted c join known m on m.id = c.id and m.gram = c.gram group by all),
    best_line as (select r, id, island, max(score) as line_score from scored where not whole group by all),
    whole_ones as (
      select s.* from scored s left join best_line b using (r, id, island)
      where s.whole and s.score >= {threshold} and s.score >= coalesce(b.line_score, 0)),
    hits as (
      select r, id, family, i, score from whole_ones
      union all select r, id, family, i, score from (select * from scored where not whole and score >= {threshold}) anti join whole_ones using (r, id, island)),
    kept as (select * from hits qualify row_number() over (partition by r, family, i order by score desc, id) = 1),
    best as (
      select r, count(*) as n_matches, string_agg(distinct id, ',' order by id) as licences,
             arg_min(id, (-score, id)) as licence, max(score) as score
      from kept group by r)
    select f.doc_id, coalesce(b.n_matches, 0)::bigint as n_matches, b.licence, b.score, coalesce(b.licences, '') as licences
    from folded f left join best b using (r)"""
