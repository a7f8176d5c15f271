import os

import pytest
from compare import same

from rigtables.llm import op2_license as op


def test_query_equals_its_oracle(spark, duck, sf_dir):
    got, want = same(op.op2_license(spark, sf_dir), duck, op.ORACLE)
    assert got == want


def scan(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string, score string")
    return {r.path: (r.licenses, r.origin, r.inherited_from) for r in op.license_scan(df).collect()}


def test_own_inherited_and_none(spark):
    mit, gpl = "Released under the MIT License.", "Words.\nThis work is licensed under the GNU General Public License, version 3."
    got = scan(spark, [("a/LICENSE", mit, ""), ("a/x.py", "print", ""), ("a/b/LICENSE.txt", gpl, ""), ("a/b/c/y.py", "y", ""), ("a/b/own.py", "All rights reserved. More words here.", ""), ("z/q.py", None, ""), (None, "", "")])
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/x.py": ("MIT", "inherited", "a/LICENSE"), "a/b/LICENSE.txt": ("GPL-3.0", "own", None), "a/b/c/y.py": ("GPL-3.0", "inherited", "a/b/LICENSE.txt"),
        "a/b/own.py": ("Proprietary", "own", None), "z/q.py": (None, None, None), None: (None, None, None),
    }


def test_several_licences_long_texts_and_no_rows(spark):
    text = "word " * 50_000 + "end. Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0. " + "x" * 100_000
    assert scan(spark, [("f", text, "")]) == {"f": ("Apache-2.0 AND CC-BY-NC-4.0", "own", None)}
    assert scan(spark, []) == {}


def test_anchors_lose_no_statement():
    idf = {t: 1.0 + len(t) for terms in op.template_terms() for t in terms}
    needed = set(op.anchors(idf, 0.8))
    assert len(needed) < len(idf)
    for terms in op.template_terms():
        whole = sum((n * idf[t]) ** 2 for t, n in terms.items())
        rest = sum((n * idf[t]) ** 2 for t, n in terms.items() if t not in needed)
        assert rest < 0.64 * whole


def test_ids_survive_another_split(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"d{k}/f", "Released under the MIT License." if k % 2 else "words " * k, "") for k in range(64)]
    spark.createDataFrame(rows, "path string, text string, score string").repartition(8).write.parquet(path)
    try:
        files = spark.read.parquet(path)
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        out = op.license_scan(files)  # the first jobs run here; the rest is planned under another split
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = {r.path: r.licenses for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"d{k}/f": "MIT" if k % 2 else None for k in range(64)}


def wrapped(text, mark, width=60):
    import textwrap

    return "\n".join(f"{mark}{line}" for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


GPL_2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301, USA."""


def test_texts_and_headers_of_licences(spark):
    texts = {k: dict(op.PASSAGES[::-1])[k] for k, _ in op.PASSAGES}
    mit, two, three, isc = (texts[k] for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"))
    code = "\n\nimport sys\n\ndef main(args):\n    return [sys.path for _ in args]\n" * 30
    notice = "Copyright (c) 2019, Some Body <some@body.org>\nAll rights reserved.\n\n"
    want = {
        "mit/LICENSE": ("MIT License\n\n" + notice + wrapped(mit, ""), "MIT"),
        "b2/LICENSE": (notice + wrapped(two, ""), "BSD-2-Clause"),
        "b3/LICENSE": (notice + wrapped(three, "", 78), "BSD-3-Clause"),
        "b3/x.c": ("/*\n" + wrapped(notice + three, " * ", 70) + "\n */" + code, "BSD-3-Clause"),
        "isc/LICENSE": (notice + wrapped(isc, ""), "ISC"),
        "gpl2.c": (wrapped(GPL_2, "// ", 99) + code, "GPL-2.0"),
        "mpl.js": ("/" + "* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. *" + "/" + code, "MPL-2.0"),
        "apache.py": (wrapped(notice + dict(op.PASSAGES[:5])["Apache-2.0"], "# ") + code, "Apache-2.0"),
        "spdx.c": ("// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception OR MIT)" + code, "GPL-2.0 WITH Classpath-exception OR MIT"),
        "tag.c": ("/* SPDX-License-Identifier: Zlib */" + code, "Zlib"),
        "rights.c": ("// " + notice + code, "Proprietary"),
        "both.txt": (mit + code + isc, "ISC AND MIT"),
        "none.py": (code, None),
    }
    for name, n in (("GPL", 7), ("AGPL", 9), ("LGPL", 11)):
        license_, text = op.PASSAGES[n + 1 if name == "GPL" else n]
        want[f"{name}.py"] = ("#!/usr/bin/python\n" + wrapped(text + " If not, see <https://www.gnu.org/licenses/>.", "# ", 75) + code, license_)
    for k in range(12, 17):
        license_, text = op.PASSAGES[k]
        want[f"{license_}/COPYING"] = (wrapped(text, "   ") + "\n\nPreamble\n\n" + "The licenses for most software are designed to take away your freedom to share and change it. " * 20, license_)
    rows = [(f"f{k}", f"other words number {k} of the rest and a line", "") for k in range(300)]
    got = scan(spark, [*rows, *((p, t, "") for p, (t, _) in want.items())])
    assert {p: got[p][0] for p in want} == {p: x for p, (_, x) in want.items()}


WHOLE = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(WHOLE), reason="no licence texts on this machine")
def test_whole_texts_state_themselves(spark):
    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
            "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = {n: open(f"{WHOLE}/{n}", encoding="utf-8", errors="replace").read() for n in want if os.path.exists(f"{WHOLE}/{n}")}
    rows = [(f"f{k}", f"other words number {k} of the rest and a line", "") for k in range(300)]
    both = [("both", texts["LGPL-3"] + "\n\n" + texts["GPL-3"], "")] if {"LGPL-3", "GPL-3"} <= set(texts) else []
    got = scan(spark, [*rows, *((n, t, "") for n, t in texts.items()), *both])
    assert {n: got[n][0] for n in texts} == {n: want[n] for n in texts}
    assert not both or got["both"][0] == "GPL-3.0 AND LGPL-3.0"


def test_openings_and_short_texts(spark):
    named = {(n, k) for k, (n, _) in enumerate(op.PASSAGES)}
    rows = [(f"f{k}", f"other words number {k} of the rest and a line", "") for k in range(300)]
    got = scan(spark, [*rows, *((f"{n} {k}", "Some Body\n\n" + wrapped(op.PASSAGES[k][1], "  "), "") for n, k in named)])
    assert {x: got[f"{x[0]} {x[1]}"][0] for x in named} == {x: x[0] for x in named}


def test_names_that_are_only_mentioned(spark):
    rows = [(f"f{k}", f"other words number {k} of the rest and a line", "") for k in range(300)]
    said = {
        "a": ("You may combine this with works under version 3 of the GNU Affero General Public License in a larger work.", None),
        "b": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
        "c": ("This work is licensed under the GNU General Public License.", None),
        "d": ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0 WITH Linux-syscall-note"),
        "e": ("// spdx-license-identifier: MIT  OR\tApache-2.0 and more words", "MIT OR Apache-2.0"),
        "f": ("SPDX-License-Identifier: (MIT OR Apache-2.0)\nReleased under the ISC License.", "(MIT OR Apache-2.0) AND ISC"),
        "g": ("<!-- SPDX-License-Identifier: MIT AND Zlib -->", "MIT AND Zlib"),
    }
    got = scan(spark, [*rows, *((p, t, "") for p, (t, _) in said.items())])
    assert {p: got[p][0] for p in said} == {p: x for p, (_, x) in said.items()}


def test_names_of_licence_files(spark):
    mit = "Released under the MIT License."
    paths = ["LICENSE-MIT", "licence.md", "UNLICENSE", "LICENSE_APACHE", "COPYING.LESSER"]
    rows = [r for k, p in enumerate(paths) for r in [(f"d{k}/{p}", mit, ""), (f"d{k}/x/y.py", "code", "")]]
    got = scan(spark, [*rows, ("r/LICENSES/MIT.txt", mit, ""), ("r/a.py", "code", ""), ("s/licensed.py", mit, ""), ("s/b.py", "code", "")])
    assert [got[f"d{k}/x/y.py"][0] for k in range(len(paths))] == ["MIT"] * len(paths)
    assert got["r/a.py"] == ("MIT", "inherited", "r/LICENSES/MIT.txt") and got["s/b.py"][0] is None
