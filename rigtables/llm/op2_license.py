"""Licence scan with DataFrame functions only: TF-IDF cosine of statements and passages to templates, then inheritance.

Every sentence or line of every whole text is a statement; its sparse TF-IDF vector is compared with those of
known licence statements. Licence texts and file headers, which are wrapped anyhow and stand behind comment
marks, are compared as passages: windows of the text, as many terms long as the template. SPDX tags are read as
they stand. A file without a licence of its own takes that of the nearest directory above it that holds a
licence file, found by joins on the paths of its ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigtables.llm.common import kept, looked_up, table, written

#: Customary statements of public licences, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "This software is released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This software is released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Texts and headers of public licences.
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details.
You should have received a copy of the GNU {name} General Public License along with this program."""
GPL_OPENING = """GNU {name} GENERAL PUBLIC LICENSE Version {n}
Copyright (C) Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
PASSAGES: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{BSD_2}\n{BSD_END}"),
    ("BSD-3-Clause", f"{BSD_2}\n{BSD_3}\n{BSD_END}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-2.0", GPL_HEADER.format(name="", n=2)),
    ("GPL-3.0", GPL_HEADER.format(name="", n=3)),
    ("AGPL-3.0", GPL_HEADER.format(name="Affero", n=3)),
    ("LGPL-2.1", GPL_HEADER.format(name="Lesser", n="2.1")),
    ("LGPL-3.0", GPL_HEADER.format(name="Lesser", n=3)),
    ("GPL-2.0", GPL_OPENING.format(name="", n="2, June 1991")),
    ("GPL-3.0", GPL_OPENING.format(name="", n="3, 29 June 2007")),
    ("AGPL-3.0", GPL_OPENING.format(name="AFFERO", n="3, 19 November 2007")),
    ("LGPL-2.1", GPL_OPENING.format(name="LESSER", n="2.1, February 1999")),
    ("LGPL-3.0", GPL_OPENING.format(name="LESSER", n="3, 29 June 2007")),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("GPL-1.0", GPL_OPENING.format(name="", n="1, February 1989")),
    ("LGPL-2.0", GPL_OPENING.format(name="LIBRARY", n="2, June 1991")),
    ("GPL-1.0", GPL_HEADER.format(name="", n=1)),
    ("LGPL-2.0", GPL_HEADER.format(name="Library", n=2)),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", """MOZILLA PUBLIC LICENSE Version 1.1
1. Definitions. 1.0.1. "Commercial Use" means distribution or otherwise making the Covered Code available to a third party."""),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/
Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License."""),
    ("MPL-2.0", """Mozilla Public License Version 2.0
1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."""),
    ("Artistic-1.0", """The "Artistic License"
Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"""),
    ("CC0-1.0", """Creative Commons Legal Code CC0 1.0 Universal
CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
#: Terms of whole licence texts; what an opening of one of them begins with.
WHOLE = {"AGPL-3.0": 5590, "Apache-2.0": 1608, "Artistic-1.0": 983, "CC0-1.0": 1088, "GFDL-1.2": 3329, "GFDL-1.3": 3748, "GPL-1.0": 2080, "GPL-2.0": 2989, "GPL-3.0": 5700,
         "LGPL-2.0": 4213, "LGPL-2.1": 4415, "LGPL-3.0": 1241, "MPL-1.1": 3789, "MPL-2.0": 2426}
OPENING = '(?i)(the )?"?(gnu|mozilla|apache|artistic|creative commons)'
#: A term that a licence's passage has and the one nearest to it has not; words of statements that grant, not only name.
TELLING = {"BSD-3-Clause": "endorse", "ISC": "appear"}
GRANTS = {"licensed", "released", "distributed", "governed", "dedicated", "subject", "granted", "unencumbered", "reserved"}
#: Of the whole text only this says nothing of other rights, so it counts where nothing else is stated.
WEAKEST = "Proprietary"
#: A licence expression behind an SPDX tag, and what a reader may choose beyond an identifier.
SPDX = r"(?i:SPDX-License-Identifier:)[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
LATER = r"(?i)(-only|-or-later|\+|-+)($|[ )])"
#: Cosine from which a statement counts; names of licence files.
LEAST, LICENCE_FILE = 0.8, r"(?i)^((un)?licen[cs]es?|copying|notice)([._-].+)?$"
#: A folder that holds the licences of the one above it.
SHELF = "LICENSES/[^/]*$"
#: Terms that a line may have beyond a template that only names a licence.
BESIDE = 3
TERM = r"[^\p{L}\p{N}]+"


def template_terms() -> list[Counter[str]]:
    """Of all statements, then of all passages."""
    return [Counter(re.findall(r"[^\W_]+", text.lower())) for _, text in TEMPLATES + PASSAGES]


def template_sizes() -> list[int]:
    """0 for a statement, the number of its terms for a passage."""
    return [0 if k < len(TEMPLATES) else terms.total() for k, terms in enumerate(template_terms())]


def about() -> list[tuple[int, str, int, int, int, int, int]]:
    """(template, license, size, marks, most, telling, extent) of each template.

    marks: how many terms of it must all be met; most: terms that a statement may have; telling: whether it has a term
    that tells it from the nearest other licence; extent: terms of the licence's text from here, for its opening.
    """
    out = []
    for k, ((name, text), terms, size, marked) in enumerate(zip(TEMPLATES + PASSAGES, template_terms(), template_sizes(), template_marks(), strict=True)):
        most = 1 << 30 if size or GRANTS & set(terms) else terms.total() + BESIDE
        extent = WHOLE[name] * 49 // 50 if size and name in WHOLE and re.match(OPENING, text) else 0  # texts differ in an address or two
        out.append((k, name, size, len(marked), most, int(bool(size) and name in TELLING), extent))
    return out


def template_marks() -> list[set[str]]:
    """Terms of each template without which it isn't met: its version, the date of its title, what tells it from another."""
    out = []
    for (name, text), terms, size in zip(TEMPLATES + PASSAGES, template_terms(), template_sizes(), strict=True):
        version = set() if size and name.startswith("BSD") else set(re.findall(r"\d+", name)) - {"0"}
        dated = {t for t in terms if t.isdigit()} if re.search(r"\b(19|20)\d\d\b", text) else set()
        out.append((version | dated | ({TELLING[name]} if size and name in TELLING else set())) & set(terms))
    return out


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda w: w != "")


def statements(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), "\n")


def weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """(idf of each term of a template, idf of any other term), from the number of files that have it."""
    vocabulary = sorted(set().union(*template_terms()))
    has = F.array_intersect(terms_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    n = files.count()
    found = files.select(F.explode(has).alias("term")).groupBy("term").count().collect()  # the templates' terms at most
    seen = dict(tuple(r) for r in found)
    idf = {t: math.log((n + 1) / (seen.get(t, 0) + 1)) + 1 for t in vocabulary}
    return idf, math.log(n + 1) + 1


def anchors(idf: dict[str, float], least: float) -> list[str]:
    """Terms of which everything has one whose cosine to some template is at least `least`.

    Without a template's heaviest terms, the rest of its vector bounds the cosine by its length.
    """
    out = set()
    for terms in template_terms():
        w = sorted(((n * idf[t]) ** 2, t) for t, n in terms.items())
        whole, rest = sum(x for x, _ in w), 0.0
        for x, t in w:
            rest += x
            if rest >= least**2 * whole * (1 - 1e-9):
                out.add(t)
    return sorted(out)


def expressions(text: Column) -> Column:
    """Of the SPDX tags of a text: expressions with OR whole, in brackets, and what AND joins in others (operators are capitals)."""

    def plain(e: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(e, r"[ \t]+", " "), LATER, "$2"), r"^\(([^()]*)\)$", "$1")

    found = F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), plain)
    parts = F.transform(found, lambda e: F.when(F.contains(e, F.lit(" OR ")), F.array(F.concat(F.lit("("), e, F.lit(")")))).otherwise(F.split(F.regexp_replace(e, "[()]", ""), " AND ")))
    return F.filter(F.flatten(parts), lambda e: e != "")


def windows(terms: Column, size: Column) -> Column:
    """Starts of windows of `size` terms, an eighth of it apart, the last at the end."""
    last = F.greatest(F.size(terms) - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.greatest(F.expr("size div 8"), F.lit(1))), F.array(last)))


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, licenses, score): sorted licences that a file states, joined by ` AND `, and the best cosine (1 for a tag); files with one only."""
    spark = files.sparkSession
    idf, other = weights(files)
    sizes, marks = template_sizes(), template_marks()
    needed = F.array(*map(F.lit, [*anchors(idf, least), "spdx"]))
    some = written(files.withColumn("terms", terms_of(F.col("text"))).where(F.arrays_overlap("terms", needed)), "licensed")
    vectors = []
    for k, terms in enumerate(template_terms()):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        vectors += [(k, sizes[k], t, n * idf[t] / length, int(t in marks[k])) for t, n in sorted(terms.items())]
    templates = spark.createDataFrame(vectors, "template int, size int, term string, w double, mark int")
    rules = F.broadcast(spark.createDataFrame(about(), "template int, license string, size int, marks int, most int, telling int, extent int").drop("size"))

    lines = some.select("id", F.posexplode(statements(F.col("text"))).alias("at", "statement")).select("id", F.lit(0).alias("size"), "at", terms_of(F.col("statement")).alias("terms"))
    lines = lines.where(F.arrays_overlap("terms", needed))
    # a passage can be in a text only if the terms that they share make up enough of the passage's vector
    shared = some.select("id", F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(templates.where("size > 0")), "term")
    likely = shared.groupBy("id", "template", "size").agg(F.sum(F.col("w") * F.col("w")).alias("most")).where(F.col("most") >= least**2 * (1 - 1e-9)).select("id", "size").distinct()
    passages = some.join(likely, "id").select("id", "size", F.explode(windows(F.col("terms"), F.col("size"))).alias("at"), "terms")
    passages = passages.withColumn("terms", F.slice("terms", F.col("at") + 1, F.col("size"))).where(F.arrays_overlap("terms", needed))

    counted = lines.unionByName(passages).select("id", "size", "at", F.explode("terms").alias("term")).groupBy("id", "size", "at", "term").count()
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    inside = templates.groupBy("term").agg(F.collect_list(F.struct("template", "size", "w", "mark")).alias("in"))
    weighed = counted.join(F.broadcast(known), "term", "left").join(F.broadcast(inside), "term", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(other)))
    alike = F.filter(F.coalesce("in", F.array().cast("array<struct<template:int,size:int,w:double,mark:int>>")), lambda t: t["size"] == F.col("size"))
    dots = F.transform(alike, lambda t: F.struct(t["template"].alias("template"), (t["w"] * F.col("x")).alias("dot"), t["mark"].alias("mark")))
    parts = weighed.groupBy("id", "size", "at").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.sum("count").alias("n_terms"), F.flatten(F.collect_list(dots)).alias("dots"))  # of one window
    close = (
        parts.select("id", "size", "at", "square", "n_terms", F.explode("dots").alias("d"))
        .groupBy("id", "size", "at", "d.template", "square", "n_terms")
        .agg((F.sum("d.dot") / F.sqrt("square")).alias("score"), F.sum("d.mark").alias("met"))
        .where(F.col("score") >= least)
        .join(rules, "template")
        .where((F.col("met") == F.col("marks")) & (F.col("n_terms") <= F.col("most")))
    )
    best = kept(close.groupBy("id", "size", "at").agg(F.max_by(F.struct("license", "template", "telling", "extent"), F.struct("score", F.negative("template"))).alias("t"), F.max("score").alias("score")))
    place = F.struct("score", F.negative("at"))
    firm = best.where("size > 0").groupBy("id", "t.template", "t.license", "t.telling", "t.extent", "size").agg(F.max_by("at", place).alias("at"), F.max("score").alias("score"))
    met = firm.groupBy("id").agg(F.collect_list(F.struct("telling", "score", F.negative("template").alias("rank"), "license", "at", (F.col("at") + F.col("size")).alias("end"), "extent")).alias("all"))  # one for each template
    value = lambda g: F.struct(g["telling"], g["score"], g["rank"])
    stands = F.filter("all", lambda h: ~F.exists("all", lambda g: (g["at"] < h["end"]) & (h["at"] < g["end"]) & (value(g) > value(h))))
    met = met.select("id", stands.alias("all")).withColumn("bodies", F.filter("all", lambda g: g["extent"] > 0))
    within = lambda at: F.exists("bodies", lambda g: (g["at"] < at) & (at < g["at"] + g["extent"]))
    kept_passages = met.select("id", F.explode(F.filter("all", lambda h: ~within(h["at"]))).alias("h")).select("id", "h.license", "h.score")
    # lines inside the whole text of a licence state nothing of their own; only files with such a text are looked at again
    texts = met.where(F.size("bodies") > 0).select("id", "bodies")
    sized = some.join(texts.select("id"), "id", "left_semi").select("id", F.posexplode(statements(F.col("text"))).alias("at", "statement")).select("id", "at", F.size(terms_of(F.col("statement"))).alias("n"))
    starts = sized.withColumn("start", F.sum("n").over(Window.partitionBy("id").orderBy("at")) - F.col("n"))
    covered = starts.join(texts, "id").where(within(F.col("start") + 0.5)).select("id", "at")
    kept_lines = best.where("size = 0").join(covered, ["id", "at"], "left_anti").select("id", "t.license", "score")
    tags = some.select("id", F.explode(expressions(F.col("text"))).alias("license")).withColumn("score", F.lit(1.0))
    every = kept_lines.unionByName(kept_passages).unionByName(tags)
    stated = every.groupBy("id").agg(F.collect_set("license").alias("all"), F.max("score").alias("score"))
    firmer = F.filter("all", lambda n: (n != WEAKEST) | (F.size("all") == 1))
    joined = F.array_join(F.sort_array(firmer), " AND ")
    return stated.select("id", F.when(F.size(firmer) == 1, F.regexp_replace(joined, r"^\((.*)\)$", "$1")).otherwise(joined).alias("licenses"), "score")


def license_scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files (path, text, and any other columns) with licenses, score, origin (own, inherited or null), inherited_from.

    A file has the licences that it states (of passages that overlap the nearest; what stands inside the whole text of
    a licence is part of it; versions and dates must be there; templates that only name a licence count as lines of
    their own; SPDX expressions keep OR and WITH; `Proprietary` where it states no other), else those of the nearest directory above it, itself included, in
    which a licence file states any (files of a folder LICENSES/ are those of the folder above it); several there are joined in order of their paths' text. Statements count
    from cosine `least`; of the templates that reach it the nearest names the licence, the first listed if
    equal. Null, empty or unlike texts state nothing; a null path lies in no directory. Repeated rows get the
    same answer each. No files give no rows; columns with the names of the result are replaced. files is
    read once; its rows are written with their ids.
    """
    columns = [c for c in files.columns if c not in ("licenses", "score", "origin", "inherited_from")]
    named = written(files.select(*columns).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    own = kept(own_licenses(named.select(F.col("_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), least))
    directory = F.regexp_replace("path", "[^/]*$", "")
    placed = named.select(F.col("_id").alias("id"), "path", directory.alias("directory")).join(own, "id", "left")
    is_licence = F.rlike(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENCE_FILE)) | F.rlike("path", F.lit(f"(^|/){SHELF}"))
    granted = placed.where("licenses IS NOT NULL").where(is_licence).groupBy(F.regexp_replace("directory", SHELF, "").alias("above")).agg(F.array_join(F.sort_array(F.collect_set("licenses")), " AND ").alias("granted"), F.min("path").alias("inherited_from"))
    steps = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.concat(F.slice(steps, F.lit(1), n - 1), F.array(F.lit(""))), "/"))
    open_ = placed.where("licenses IS NULL AND path IS NOT NULL").select("id", "directory")
    climbing = open_.groupBy("directory").agg(F.count("*").alias("n_files")).select("directory", "n_files", F.posexplode(ancestors).alias("depth", "above"))
    nearest = climbing.join(granted, "above").groupBy("directory", "n_files").agg(F.max_by(F.struct("granted", "inherited_from"), "depth").alias("from"))
    found = looked_up(open_, kept(nearest), ["directory"], "n_files")
    answer = own.select("id", "licenses", "score", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("inherited_from")).unionByName(
        found.select("id", F.col("from.granted").alias("licenses"), F.lit(None).cast("double").alias("score"), F.lit("inherited").alias("origin"), F.col("from.inherited_from").alias("inherited_from"))
    )
    return named.join(answer, F.col("_id") == F.col("id"), "left").select(*columns, "licenses", "score", "origin", "inherited_from")


#: Documents as a tree: source, twenty thousands, two hundreds; twenty neighbours of each two hundred are its licence files.
PATH = """concat(coalesce(source, 'none'), '/', CAST(floor(doc_id / 20000) AS BIGINT), '/',
  CASE WHEN doc_id % 20000 = 19999 THEN 'LICENSE'
       WHEN CAST(floor(doc_id / 20) AS BIGINT) % 10 = 0 THEN concat(CAST(CAST(floor(doc_id / 200) AS BIGINT) % 100 AS STRING), '/LICENSE')
       ELSE concat(CAST(CAST(floor(doc_id / 200) AS BIGINT) % 100 AS STRING), '/', CAST(doc_id AS STRING), '.txt') END)"""


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text")
    return license_scan(files).select("doc_id", "path", "licenses", F.round("score", 6).alias("score"), "origin", "inherited_from")


def _values() -> str:
    marks, sizes = template_marks(), template_sizes()
    rows = [f"({k}, {sizes[k]}, '{t}', {n}, {int(t in marks[k])})" for k, terms in enumerate(template_terms()) for t, n in sorted(terms.items())]
    return ", ".join(rows)


def _rules() -> str:
    return ", ".join(f"({k}, '{name}', {', '.join(map(str, rest))})" for k, name, _, *rest in about())


#: Without one of these no line or text reaches the least cosine to any template.
HINT = "(?i)licen|rights|domain|permission|redistribut|warrant|granted|spdx|public"
ORACLE = f"""
WITH template(template, size, term, n, mark) AS (VALUES {_values()}),
rules(template, license, marks, most, telling, extent) AS (VALUES {_rules()}),
f AS (SELECT doc_id, {PATH} AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM f),
seen AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM f)
  WHERE term IN (SELECT term FROM template) GROUP BY term),
idf AS (SELECT t.term, ln((total.n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM template) t LEFT JOIN seen USING (term), total),
tv AS (SELECT template, size, term, mark, n * idf AS w, sqrt(sum(n * n * idf * idf) OVER (PARTITION BY template)) AS len FROM template JOIN idf USING (term)),
hinted AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS terms FROM f WHERE regexp_matches(text, '{HINT}')),
likely AS (SELECT DISTINCT doc_id, size FROM (SELECT doc_id, template, size FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM hinted) JOIN tv USING (term)
  WHERE size > 0 GROUP BY ALL HAVING sum(w * w / len / len) >= {LEAST**2 * (1 - 1e-9)})),
st AS (SELECT doc_id, pos, statement, regexp_extract_all(lower(statement), '[\\p{{L}}\\p{{N}}]+') AS terms FROM (
    SELECT doc_id, unnest(l) AS statement, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS l FROM hinted))),
u AS (SELECT doc_id, 0 AS size, pos, terms FROM st WHERE regexp_matches(statement, '{HINT}')
  UNION ALL SELECT doc_id, size, pos, list_slice(terms, pos + 1, pos + size) FROM (
    SELECT doc_id, size, terms, unnest(list_distinct(list_append(range(0, greatest(len(terms) - size, 0) + 1, greatest(size // 8, 1)), greatest(len(terms) - size, 0)))) AS pos FROM hinted JOIN likely USING (doc_id))),
w AS (SELECT doc_id, size, pos, term, count(*) AS n FROM (SELECT doc_id, size, pos, unnest(terms) AS term FROM u) GROUP BY ALL),
x AS (SELECT w.*, w.n * coalesce(idf, ln(total.n + 1.0) + 1) AS x FROM w LEFT JOIN idf USING (term), total),
len AS (SELECT doc_id, size, pos, sqrt(sum(x * x)) AS len, sum(n) AS n_terms FROM x GROUP BY ALL),
c AS (SELECT x.doc_id, x.size, x.pos, template, sum(x * w / tv.len) / any_value(len.len) AS score, sum(mark) AS met, any_value(n_terms) AS n_terms
  FROM x JOIN tv ON tv.term = x.term AND tv.size = x.size JOIN len ON len.doc_id = x.doc_id AND len.size = x.size AND len.pos = x.pos GROUP BY ALL),
b AS (SELECT * FROM c JOIN rules USING (template) WHERE score >= {LEAST} AND met = marks AND n_terms <= most QUALIFY row_number() OVER (PARTITION BY doc_id, size, pos ORDER BY score DESC, template) = 1),
firm AS (SELECT * FROM b WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY score DESC, pos) = 1),
stand AS (SELECT * FROM firm h WHERE NOT EXISTS (SELECT 1 FROM firm g WHERE g.doc_id = h.doc_id AND g.pos < h.pos + h.size AND h.pos < g.pos + g.size
    AND (g.telling > h.telling OR (g.telling = h.telling AND (g.score > h.score OR (g.score = h.score AND g.template < h.template)))))),
body AS (SELECT doc_id, pos, pos + extent AS until FROM stand WHERE extent > 0),
start AS (SELECT doc_id, pos, sum(len(terms)) OVER (PARTITION BY doc_id ORDER BY pos) - len(terms) AS start FROM st),
tag AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SPDX}', 1)) AS e FROM hinted),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(e, '[ \\t]+', ' ', 'g'), '{LATER}', '\\2', 'g'), '^\\(([^()]*)\\)$', '\\1') AS e FROM tag),
tags AS (SELECT doc_id, unnest(CASE WHEN contains(e, ' OR ') THEN ['(' || e || ')'] ELSE string_split(regexp_replace(e, '[()]', '', 'g'), ' AND ') END) AS license FROM plain),
every AS (SELECT doc_id, license, score FROM b WHERE size = 0
    AND NOT EXISTS (SELECT 1 FROM start s JOIN body g USING (doc_id) WHERE s.doc_id = b.doc_id AND s.pos = b.pos AND s.start >= g.pos AND s.start < g.until)
  UNION ALL SELECT doc_id, license, score FROM stand h WHERE NOT EXISTS (SELECT 1 FROM body g WHERE g.doc_id = h.doc_id AND g.pos < h.pos AND h.pos < g.until)
  UNION ALL SELECT doc_id, license, 1.0 FROM tags WHERE license != ''),
own AS (SELECT doc_id, CASE WHEN count(DISTINCT license) FILTER (license != '{WEAKEST}' OR alone) = 1 THEN regexp_replace(max(license) FILTER (license != '{WEAKEST}' OR alone), '^\\((.*)\\)$', '\\1')
    ELSE string_agg(DISTINCT license, ' AND ' ORDER BY license) FILTER (license != '{WEAKEST}' OR alone) END AS licenses, max(score) AS score
  FROM (SELECT *, bool_and(license = '{WEAKEST}') OVER (PARTITION BY doc_id) AS alone FROM every) GROUP BY doc_id),
p AS (SELECT f.doc_id, path, licenses, score, regexp_replace(path, '[^/]*$', '') AS dir FROM f LEFT JOIN own USING (doc_id)),
g AS (SELECT dir AS above, string_agg(DISTINCT licenses, ' AND ' ORDER BY licenses) AS granted, min(path) AS inherited_from
  FROM p WHERE licenses IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
h AS (SELECT doc_id, granted, inherited_from FROM p JOIN g ON starts_with(p.dir, g.above) WHERE licenses IS NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(p.licenses, h.granted) AS licenses, round(p.score, 6) AS score,
  CASE WHEN p.licenses IS NOT NULL THEN 'own' WHEN h.granted IS NOT NULL THEN 'inherited' END AS origin, h.inherited_from
FROM p LEFT JOIN h USING (doc_id)
"""
