import textwrap

import pytest

from dealtide.llm import licenses
from tests.llm.frames import SF_DIR

TEXTS = {name: text for name, text in licenses.TEMPLATES if len(text) > 250}
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.
"""


def commented(text: str) -> str:
    return "import os\n\n" + textwrap.indent(textwrap.fill(text, 72), "# ") + "\n\nprint(os.name)\n"


@pytest.fixture(scope="module")
def found(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("concat('d/', doc_id) as path", "text")
    files = [(f"{name}/LICENSE", f"Copyright (c) 2020 A. Person\n\n{textwrap.fill(text, 72)}\n") for name, text in TEXTS.items()]
    files += [(f"one/{name}", f"{name} {text}") for name, text in TEXTS.items()]
    files += [("MIT/src/code.py", "print()"), ("lgpl.py", commented(LGPL)), ("gpl.py", commented(GPL))]
    files += [("bsd.py", commented(TEXTS["BSD-3-Clause"])), ("COPYING", HEAD + "\nunheard words " * 400)]
    files += [("tag.c", "/* SPDX-License-Identifier: MIT */"), ("two.c", "// SPDX-License-Identifier: MIT OR Zlib\nint x;")]
    frame = documents.union(spark.createDataFrame(files, "path string, text string"))
    return {r.path: (r.license, r.origin) for r in licenses.license_scan(frame).collect()}


def test_wrapped_headers(found):
    assert found["lgpl.py"] == ("LGPL-2.1-or-later", "own")
    assert found["gpl.py"] == ("GPL-3.0-or-later", "own")
    assert found["bsd.py"] == ("BSD-3-Clause", "own")


def test_whole_license_files(found):
    for name in TEXTS:
        assert found[f"{name}/LICENSE"] == (name, "own")
        assert found[f"one/{name}"] == (name, "own")
    assert found["MIT/src/code.py"] == ("MIT", "inherited")
    assert found["COPYING"] == ("GPL-2.0-only", "own")


def test_tags(found):
    assert found["tag.c"] == ("MIT", "own")
    assert found["two.c"] == ("MIT OR Zlib", "own")


@pytest.mark.parametrize("sent", [1 << 23, 0])
def test_what_grows_with_the_files_is_not_broadcast(spark, monkeypatch, sent):
    """Spark takes every table of this size for small; what is sent to all tasks goes by counted bytes."""
    monkeypatch.setattr(licenses, "SENT", sent, raising=False)
    files = [("LICENSE", "SPDX-License-Identifier: ISC"), ("a/b/LICENSE.txt", "SPDX-License-Identifier: MIT"), (None, "x")]
    files += [("c/COPYING", None), ("c/x.py", "x"), ("a/b/c/d.py", "x"), ("a/b/d.py", ""), ("a/e/f/g.py", "x"), ("h.py", None)]
    frame = spark.createDataFrame(files, "path string, text string").repartition(3)
    scan = licenses.license_scan(frame)
    got = {r.path: (r.license, r.origin, r.directory) for r in scan.collect()}
    assert len(got) == len(files)
    assert got["a/b/c/d.py"] == got["a/b/d.py"] == ("MIT", "inherited", "a/b")
    assert got["c/COPYING"] == got["c/x.py"] == got["a/e/f/g.py"] == got["h.py"] == ("ISC", "inherited", "")
    assert got["LICENSE"] == ("ISC", "own", None) and got[None] == (None, "none", None)
    initial = scan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert initial.count("SortMergeJoin") == (1 if sent else 2)
    assert initial.count("BroadcastExchange") == (1 if sent else 0)
