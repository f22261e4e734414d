"""License matches and inheritance by hand, and the anchors against scoring everything."""

import re

from moodtide.llm import licenses
from moodtide.llm.common import table

from .rows import HARD, frame

FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/b/x.py", "# code\nprint(1)"),
    ("a/b/LICENSE.txt", "nothing here"),
    ("a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("a/c/d/e/y.py", None),
    ("a/c/own.py", "// Released under the MIT License.\n\nint main"),
    ("z/none.py", ""),
    ("top.py", "x"),
    (None, "Released under the MIT License."),
]


def test_own_and_inherited(spark):
    files = spark.createDataFrame(FILES, "path string, text string").selectExpr("*", "'kept' AS folder", "1 AS term", "'old' AS license")
    got = {r.path: (r.own_license, r.inherited_license, r.inherited_from, r.license, r.folder) for r in licenses.scanned(files).collect()}
    assert got["a/b/x.py"] == (None, "Apache-2.0", "a", "Apache-2.0", "kept")
    assert got["a/b/LICENSE.txt"][:2] == (None, "Apache-2.0")
    assert got["a/c/d/e/y.py"] == (None, "GPL-3.0", "a/c", "GPL-3.0", "kept")
    assert got["a/c/own.py"][:2] == ("MIT", "GPL-3.0") and got["a/c/own.py"][3] == "MIT"
    assert got["z/none.py"][3] is None and got["top.py"][3] is None
    assert got[None] == ("MIT", None, None, "MIT", "kept")
    assert len(got) == len(FILES)


def test_reserved_rights_are_a_match_and_inherit_nothing(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/own.txt", "Words here.\nAll rights reserved.\n"), ("a/b/other.txt", "Words here."),
        ("c/LICENSE", "Copyright (c). All rights reserved."), ("c/x.txt", "x"),
        ("d/both.py", "All rights reserved.\n\nLicensed under the BSD 3-Clause License for all of this."),
    ]
    got = {r.path: r for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/b/own.txt"].own_license == got["a/b/own.txt"].license == licenses.RESERVED
    assert got["a/b/other.txt"].license == "MIT" and got["c/x.txt"].license == licenses.RESERVED
    assert got["d/both.py"].license == "BSD-3-Clause"


def test_rows_without_a_path_do_not_share_a_licence(spark):
    rows = [(None, "Released under the MIT License."), (None, "Words only."), (None, "Released under the MIT License."), (None, None)]
    got = licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((r.text or "", r.license) for r in got) == [("", None), (rows[0][1], "MIT"), (rows[0][1], "MIT"), (rows[1][1], None)]


def test_files_of_the_tree_inherit_from_every_level(spark):
    """All levels by plain climbing; ids are set so that each level is the nearest for some file."""
    texts = {0: "Licensed under CC BY 4.0.", 2010: "Released under the MIT License.", 2140: "Licensed under the BSD 3-Clause License."}
    rows = [(i, texts.get(i, "words"), "en", "s") for i in (0, 7, 2010, 2013, 2140, 2141, 4001)] + [(None, "words", "en", "s")]
    got = {r.doc_id: r for r in licenses.scanned(licenses.as_files(frame(spark, rows))).collect()}
    assert [got[i].path for i in (0, 2010, 2140, 2141)] == ["s/LICENSE.0", "s/1/LICENSE.2010", "s/1/21/LICENSE.2140", "s/1/21/2141.txt"]
    assert [(got[i].license, got[i].inherited_from) for i in (7, 2013, 2141, 4001)] == [
        ("CC-BY-4.0", "s"), ("MIT", "s/1"), ("BSD-3-Clause", "s/1/21"), ("CC-BY-4.0", "s")
    ]
    assert got[None].path is None and got[None].license is None


def test_anchors_lose_no_match(spark, sf):
    """Every line at the threshold, scored without anchors, is found."""
    weights = licenses.Weights()
    docs = table(spark, sf, "documents").collect()
    want = {}
    for r in docs:
        best = None
        for line in {*re.split(r"\n", r.text or ""), *re.split(r"\n[ \t\r]*\n", r.text or "")}:
            terms = {}
            for t in licenses._terms(line):
                terms[t] = terms.get(t, 0) + 1
            own = {t: n * weights.idf.get(t, weights.unseen) for t, n in terms.items()}
            norm = sum(w * w for w in own.values()) ** 0.5
            for name in {n for n, *_ in weights.rows}:
                for variant in {i for n, i, *_ in weights.rows if n == name}:
                    dot = sum(own.get(t, 0) * w for n, i, t, w in weights.rows if (n, i) == (name, variant))
                    if dot and (best is None or (-round(dot / norm, 6), name) < best):
                        best = (-round(dot / norm, 6), name)
        if best and -best[0] >= licenses.THRESHOLD:
            want[r.doc_id] = best[1]
    files = spark.createDataFrame([(str(r.doc_id), r.text) for r in docs], "path string, text string")
    assert {int(r.path): r.license for r in licenses.matches(files).collect()} == want and want


def test_hard_rows(spark):
    got = licenses.scanned(licenses.as_files(frame(spark, HARD, ("path", "license"))))
    assert got.count() == len(HARD)
    assert licenses.scanned(licenses.as_files(frame(spark, []))).count() == 0
