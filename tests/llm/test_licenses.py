from pathlib import Path

import pytest

from ledgerloom.llm import licenses


def test_headers_files_and_ancestors(spark):
    mit, apache, gpl = (licenses.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    rows = [
        ("r/LICENSE", mit),
        ("r/a/LICENSE.txt", "intro\n" + apache + "\nmore words follow here"),
        ("r/x.py", "print(1)"),
        ("r/a/b/y.py", "code\nmore"),
        ("r/a/z.py", f"# {gpl}\ncode"),
        ("q/lone.py", "nothing"),
        ("q/b/c.py", "This line says licensed fish only"),
        (None, "text"),
        (None, f"// {mit}"),
        ("top.py", None),
        ("r/a/empty.py", ""),
        ("r/long.txt", "filler text\n" * 20000 + mit),
    ]
    files = spark.createDataFrame([(i, p, t, "k", 0) for i, (p, t) in enumerate(rows)], "id int, path string, text string, license_hint string, line int")
    got = {r.id: r for r in licenses.scan(files).collect()}
    assert len(got) == len(rows)
    want = {0: ("MIT", "own"), 1: ("Apache-2.0", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "inherited"), 4: ("GPL-3.0", "own"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none"), 8: ("MIT", "own"), 9: (None, "none"), 10: ("Apache-2.0", "inherited"), 11: ("MIT", "own")}
    assert {i: (r.license, r.how) for i, r in got.items()} == want
    assert got[3].inherited_from == "r/a" and got[2].inherited_from == "r"


def test_near_versions_are_told_apart(spark):
    files = spark.createDataFrame([(k, f"d/{k}.c", t) for k, t in licenses.TEMPLATES.items()], "id string, path string, text string")
    assert all(r.id.split(licenses.LONG_MARK)[0] == r.own_license for r in licenses.scan(files).collect())


def test_headers_of_several_lines_and_files_of_any_length(spark):
    lines = lambda t, mark: "\n".join(f"{mark} {t[i : i + 60]}" for i in range(0, len(t), 60))
    rows = [(k, "x/y.c", f"code here\n\n{lines(t, '//')}\n\nmore code", "n") for k, t in licenses.LONG.items()]
    files = spark.createDataFrame([*rows, ("none", "x/z.c", "a " * 50_000 + "licensed", "n")], "id string, path string, text string, name string")
    assert all(r.own_license == (None if r.id == "none" else r.id) and r.name == "n" for r in licenses.scan(files).collect())
    docs = spark.createDataFrame([(1, licenses.LONG["MIT"], "s"), (2, "my garden grows many tall flowers beside one license plate " * 20, "s")], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.path.endswith("LICENSE") for r in licenses.documents_as_files(docs).collect()} == {1: True, 2: False}


#: How the full texts begin, each in its own lines and with its own blanks; years and names aren't those of a template.
BEGINNINGS = {
    "GPL-2.0": "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\r\n                       Version 3, 29 June 2007\r\n\r\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\r\n",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3,\n19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n[This is the first released version of the Lesser GPL.]\n",
    "LGPL-3.0": "  GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public License.\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
}


def test_full_texts_of_one_family_by_their_titles(spark):
    body = "\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This program is free software under the GNU General Public License, either version 2 of the License or any later version.\n\n" * 40
    files = spark.createDataFrame([(k, f"{k}/COPYING", t + body) for k, t in BEGINNINGS.items()], "id string, path string, text string")
    assert {r.id: r.own_license for r in licenses.scan(files).collect()} == {k: k for k in BEGINNINGS}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").is_file(), reason="no licence texts on this machine")
def test_full_texts_of_this_machine(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    texts = [(spdx, f"{name}/LICENSE", Path(f"/usr/share/common-licenses/{name}").read_text(errors="replace")) for name, spdx in names.items() if Path(f"/usr/share/common-licenses/{name}").is_file()]
    found = {r.id: r.own_license for r in licenses.scan(spark.createDataFrame(texts, "id string, path string, text string")).collect()}
    assert found == {k: k for k in found}


def test_tricky_rows(tricky, nothing):
    assert licenses.scan(licenses.documents_as_files(tricky)).count() == tricky.count()
    assert licenses.scan(licenses.documents_as_files(nothing)).count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_salted_join_is_the_same(spark, limit):
    from ledgerloom.llm.common import join_hot, join_small

    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) AS k")
    right = spark.range(40).selectExpr("id AS k", "id * 2 AS v", "20L AS n")
    want = sorted(left.join(right.select("k", "v"), "k", "left").select("id", "k", "v").collect())
    assert sorted(join_small(left, right.select("k", "v"), ["k"], left["id"], limit=limit).select("id", "k", "v").collect()) == want
    assert sorted(join_hot(left, right, "k", "n", 1000, share=limit or 10).select("id", "k", "v").collect()) == want
