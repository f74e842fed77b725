import hashlib
import re

import duckdb

from millrace.llm import licences
from millrace.llm.licence_texts import TEXTS

SCHEMA = "doc_id bigint, text string, known string, content string"


def test_variants_are_found(spark):
    mit, bsd3 = (next(t for n, t in TEXTS if n == name) for name in ("MIT", "BSD-3-Clause"))
    rows = [
        (1, mit), (2, "The " + mit.replace("<year> <copyright holders>", "2019 Ann É. All rights reserved.").replace("\n", "\r\n").upper()),
        (3, re.sub(r"\s+", " ", mit.replace("Copyright (c) <year> <copyright holders>\n", "")).replace('"', "“").replace("sublicense", "sub-licence")),
        (4, bsd3.replace("1.", "*").replace("2.", "*")), (5, bsd3.replace("\nCopyright", "\n  Copyright (c) 1999 X\n© 2001 Y\nCopyright")),
        (6, mit + " more"), (7, None), (8, ""), (9, "text\nlicensed under the apache licence, version 2.0\nReleased under the MIT License\nLicensed under the MIT License."),
        (9, "text\nlicensed under the apache licence, version 2.0\nReleased under the MIT License\nLicensed under the MIT License."), (None, "Licensed under CC BY-NC 4.0."),
        (10, "word " * 60_000), (11, "x\n" + mit.replace("\n", " ") + "\ny"), (12, "This is not licensed under the MIT License."),
    ]
    got = {str(r.id): (r.licence, r.notices, r.n_notice_lines) for r in licences.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    assert got["1"][0] == got["2"][0] == got["3"][0] == "MIT" and got["5"][0] == "BSD-3-Clause"
    assert [got[k][0] for k in ("4", "6", "7", "8", "10", "12")] == [None] * 6
    assert got["9"] == (None, "Apache-2.0,MIT", 3) and got["None"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)
    assert got["11"][:2] == (None, "MIT") or got["11"][:2] == (None, "")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in dict.fromkeys(rows) if r[0] is not None])
    want = {str(r[0]): r[1:] for r in db.execute(licences.oracle()).fetchall()}
    for r in licences.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).where("id is not null").collect():
        assert tuple(r)[1:] == want[str(r.id)]


def plain_form(text):
    """The canonical form word by word, without patterns."""
    kept = []
    for line in text.lower().split("\n"):
        bare = line
        while bare and not ("a" <= bare[0] <= "z" or "0" <= bare[0] <= "9" or bare[0] in "(©"):
            bare = bare[1:]
        by_sign = bare.startswith(("(c) ", "©", "copyright: ")) or bare.startswith("copyright ") and bare[10:11] in tuple("0123456789<(©")
        if not (by_sign or bare.startswith("copyright the authors") or bare.startswith("copyright ann")):
            kept.append(line)
    gaps = {chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80), *range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2022, 0xA0, 0xA9, 0xAB, 0xBB)}
    words = "".join(" " if c in gaps else c for c in "\n".join(kept)).split(" ")
    words = [w for w in words if w]
    for spelling, one in licences.SPELLINGS:
        old, new, k, out = spelling.split(), one.split(), 0, []
        while k < len(words):
            if words[k : k + len(old)] == old:
                out += new
                k += len(old)
            else:
                out.append(words[k])
                k += 1
        words = out
    return " ".join(words)


def test_canonical_forms_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    mit = TEXTS[0][1]
    odd = ["Licence,licences\nLICENCED — sub-licence; all Rights  reserved\x0b v. 2.0 https://x", mit, mit.replace("Copyright (c) <year>", "Copyright Ann"), "copyright holders\n© 2000\n  (c) X\n* copyright 1999\nCopyright The Authors", "", " \n\t"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-i - 1, t) for i, t in enumerate(odd)]
    got = {r.id: r.canonical_sha256 for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        assert got[i] == hashlib.sha256(plain_form(t).encode()).hexdigest(), t[:200]


def test_known_texts_are_apart_and_empty_table(spark):
    found = licences.known(spark).collect()
    assert len({r.known for r in found}) == len(found)
    assert licences.scan(spark.createDataFrame([], SCHEMA)).collect() == []
