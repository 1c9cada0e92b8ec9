"""Licence scans: lines and passages against templates by the Dice coefficient of their word bigrams.

Notices are compared with lines of their size. Whole licence texts and notices are also compared with
passages: the windows of a template's length that begin at one of its bigrams, over line breaks and
inside prose. Bounds on sizes and on the number of a template's words that a text must have prune both."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._spark import let

#: Notices by which works name their licence, as published by the licences' stewards or in common use.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Licence texts and longer notices, as published.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""),
)
THRESHOLD = 0.8


def template_words(text: str) -> list[str]:
    """The words of a template, normalised as :func:`line_words` does."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def bigrams(text: str) -> list[str]:
    """The distinct word pairs of a template."""
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def least_words(pairs: list[str], threshold: float) -> int:
    """How many of a template's words a text must have to reach ``threshold`` with it.

    A Dice coefficient of t takes at least t / (2 - t) of the template's pairs. Each pair needs both
    its words, so with any q words there are at most half as many pairs as the q words in most pairs have."""
    degrees, sum_, q = Counter(w for p in pairs for w in p.split()), 0, 0
    for _, n in degrees.most_common():
        if sum_ / 2 >= len(pairs) * threshold / (2 - threshold) - 1e-9:
            break
        sum_, q = sum_ + n, q + 1
    return q


def line_words(line: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+", -1), "")


def line_bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _passages(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """[(dice, name)]: for each template with a passage that reaches ``threshold``, its best."""
    rows = []
    for name, t in templates:
        pairs = bigrams(t)
        rows.append({"name": name, "pairs": pairs, "words": sorted(set(template_words(t))), "n": len(pairs), "length": len(template_words(t)) - 1, "least": least_words(pairs, threshold)})
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<name: string, pairs: array<string>, words: array<string>, n: int, length: int, least: int>>")
    known = F.from_json(F.lit(json.dumps(sorted({w for r in rows for w in r["words"]}))), "array<string>")
    none = F.array().cast("array<struct<dice: double, name: string>>")

    def best(t: Column, b: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.array_contains(t["pairs"], F.get(b, i)))
        dice = lambda i: let(F.array_distinct(F.slice(b, i + 1, t["length"])), lambda m: 2.0 * F.size(F.array_intersect(t["pairs"], m)) / (t["n"] + F.size(m)))
        return F.struct(F.array_max(F.transform(starts, dice)).alias("dice"), t["name"].alias("name"))

    def compare(w: Column, near: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
        return F.when((F.size(near) > 0) & (F.size(w) > 1), let(pairs, lambda b: F.filter(F.transform(near, lambda t: best(t, b)), lambda x: x["dice"] >= threshold))).otherwise(none)

    def judged(w: Column) -> Column:
        near = lambda found: F.filter(table, lambda t: F.size(F.array_intersect(t["words"], found)) >= t["least"])
        return let(F.array_intersect(known, w), lambda found: F.when(F.size(found) < min(r["least"] for r in rows), none).otherwise(let(near(found), lambda n: compare(w, n))))

    return let(line_words(F.coalesce(text, F.lit(""))), judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """(id, license, dice, n_lines, n_passages) for each row of ``docs``: the best match of all its lines
    with ``templates`` and of all its passages with ``templates`` and ``texts`` (null if none reaches
    ``threshold``; ties go to the greater licence name), the number of lines that match any template,
    and the number of templates and texts that a passage matches.

    A Dice coefficient of t needs a set between t / (2 - t) and (2 - t) / t of the template's
    size, so a line is compared only with templates of such sizes, and lines beyond all of
    them (most prose) only have their bigrams counted. A passage has a template's length in words, so
    its size needs no bound; a text is compared only with templates of whose words it has as many as
    any match takes (:func:`least_words`). The templates are a fixed list of the code, not data.
    Everything stays in the row's own task: no shuffle. Null and empty texts have no lines. A very
    long text costs its words once, and its bigrams once for each template of whose words it has
    enough. Repeated rows each get a row; other columns are not read, whatever their names; an
    empty table gives an empty result."""
    named = [(name, bigrams(t)) for name, t in templates]
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("pairs"), F.lit(len(b)).alias("n")) for n, b in named])
    least = min(len(b) for _, b in named) * threshold / (2 - threshold)
    most = max(len(b) for _, b in named) * (2 - threshold) / threshold

    def best(pairs: Column, all_templates: Column) -> Column:
        n = F.size(pairs)
        near = F.filter(all_templates, lambda t: (n >= t["n"] * threshold / (2 - threshold)) & (n <= t["n"] * (2 - threshold) / threshold))
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(t["pairs"], pairs)) / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    def lines(all_templates: Column) -> Column:
        # a line has a space or other break between words, so its length bounds their number before they are split
        short = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1), lambda x: F.length(x) >= 2 * least + 1)
        worded = F.filter(F.transform(short, lambda x: line_words(x)), lambda w: F.size(w) > least)
        paired = F.filter(F.transform(worded, line_bigrams), lambda p: F.size(p).between(least, most))
        return F.filter(F.transform(paired, lambda p: best(p, all_templates)), lambda b: b.isNotNull())

    summed = lambda m: F.struct(F.array_max(m).alias("best"), F.size(m).cast("long").alias("n"))
    judged = docs.select(F.col(f"`{id_col}`").alias("id"), let(let(table, lines), summed).alias("_m"), let(_passages(F.col(f"`{text}`"), (*templates, *texts), threshold), summed).alias("_p"))
    best_of = F.greatest("_m.best", "_p.best")
    return judged.select("id", best_of["name"].alias("license"), F.round(best_of["dice"], 6).alias("dice"), F.col("_m.n").alias("n_lines"), F.col("_p.n").alias("n_passages"))
