from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import licences

COMMON = Path("/usr/share/common-licenses")


def scanned(spark, texts):
    rows = list(enumerate(texts))
    return {r.id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_spdx_lines_and_notices(spark):
    names = ["GPL-2.0-only", "BSD-2-Clause", "ISC", "MPL-2.0", "AGPL-3.0-or-later", "LicenseRef-Own-1"]
    texts = [f"x = 1\n# SPDX-License-Identifier: {n}\ny" for n in names] + ["a\nThis work is licensed under the GNU General Public License, version 2.\nb"]
    odd = ["/* spdx-licence-identifier: (MIT OR Apache-2.0) AND ISC */", "SPDX-License-Identifier: MIT and more", "see SPDX-License-Identifier: MIT", "SPDX-License-Identifier:"]
    got = scanned(spark, texts + odd)
    assert [got[i].notices for i in range(len(texts))] == [*names, "GPL-2.0-only"]
    assert [(got[len(texts) + i].notices, got[len(texts) + i].n_notice_lines) for i in range(4)] == [("Apache-2.0,ISC,MIT", 1), ("", 0), ("", 0), ("", 0)]


def test_every_known_text_has_an_anchor(spark):
    """In any spelling: what a replacement brings in, the spelling has too."""
    forms = spark.createDataFrame(licences.known_texts(), "licence string, text string").select(licences.canonical(F.col("text"))).collect()
    assert all(any(a in form for a in licences.ANCHORS) for (form,) in forms)
    assert all(any(a in spelling for a in licences.ANCHORS) for spelling, one in licences.SPELLINGS if any(a in one for a in licences.ANCHORS))


def test_texts_without_titles(spark):
    for name, text in licences.TEXTS:
        title, found, body = text.partition("\n\n")
        if found and len(title) < 60:
            assert scanned(spark, [body])[0].licence == name


def test_copyright_lines_and_spdx_lines_as_sql(spark):
    mit = next(t for n, t in licences.TEXTS if n == "MIT")
    texts = ["# SPDX-License-Identifier: MIT OR (ISC AND Zlib)\nx\nspdx-license-identifier: 0BSD", "Copyright The Authors\ncopyright notice here\nportions copyright 1999 X\n(c) Y\n © Z\ncopyrights", mit.replace("Copyright (c) <year> <copyright holders>", "Copyright Ann Other"), "x\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0.\n"]
    got = scanned(spark, texts)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert {r[0]: tuple(r) for r in db.execute(licences.oracle()).fetchall()} == {k: tuple(r) for k, r in got.items()}


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_whole_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    got = scanned(spark, [(COMMON / f).read_text() for f in files])
    assert [got[i].licence for i in range(len(files))] == list(files.values())


def test_copyright_statements_by_name(spark):
    lines = ["Copyright The Authors", "Copyright Joyent, Inc. and other Node contributors.", "Portions Copyright (c) 2020 X"]
    texts = [t.replace("\n\n", f"\n\n{line}\n", 1) for line in lines for n, t in licences.TEXTS if n in ("MIT", "BSD-3-Clause", "ISC") and "\n\n" in t]
    names = [n for _ in lines for n, t in licences.TEXTS if n in ("MIT", "BSD-3-Clause", "ISC") and "\n\n" in t]
    mit = next(t for n, t in licences.TEXTS if n == "MIT")
    wrapped = mit.replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT") + "\n\nCopyright Ann"
    got = scanned(spark, [*texts, wrapped, mit + "\n\nCopyright license is not granted"])
    assert [got[i].licence for i in range(len(names) + 2)] == [*names, "MIT", None]
