"""Licence headers in comments of several languages against known answers."""

import duckdb
import pytest

from tessera.llm import licenses, queries
from tests.llm.edges import rows as edge_rows

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software
without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED CONDITIONS ARE DISCLAIMED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE."""
KNOWN = [(MIT, ["MIT"], ["GrantMIT", "KeepNotice", "AsIs", "NoLiability"]),
         (BSD, ["BSD-2-Clause"], ["RedistBoth", "AsIsBSD"]), (ISC, ["ISC"], ["GrantISC", "AsIsISC"])]
STYLES = {"plain": ("", "", ""), "slashes": ("", "// ", ""), "hashes": ("", "# ", ""), "stars": ("/*\n", " * ", "\n */"),
          "dashes": ("", "-- ", "")}


@pytest.mark.parametrize("style", STYLES)
def test_headers(spark, style):
    before, mark, after = STYLES[style]
    texts = [before + "\n".join((mark + line).rstrip() for line in text.split("\n")) + after + "\nint main;" for text, *_ in KNOWN]
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["_licenses"], r["_sentences"]) for r in rows] == [(found, ids) for _, found, ids in KNOWN]


def test_spdx_in_a_closed_comment(spark):
    rows = licenses.scanned(spark.createDataFrame([(1, "/* SPDX-License-Identifier: GPL-2.0 */")], "doc_id long, text string"))
    assert rows.first()["_sentences"] == ["SpdxGPL2"]


def test_query_equals_sql(spark, tmp_path):
    headers = [before + "\n".join(mark + line for line in text.split("\n")) + after
               for text, *_ in KNOWN for before, mark, after in STYLES.values()]
    odd = [headers[1].replace("\n", "\r\n"), headers[1].replace("\n", "\r"), headers[3].replace("\n", "\u2028"),
           "rem Licensed under the MIT license.\r\nrem\r\nremarks on a licence", "dnl\tBSD 3-Clause License\ndnlx copyright",
           "<!-- SPDX-License-Identifier: Apache-2.0 -->\n<p>", ".\\\" in the public domain\n\n* All rights reserved */\r x",
           "// Apache\n// License, Version\n// 2.0", "A licence of our own. Copyright nobody!", "the gnu general public licence v2 "]
    texts = [*headers, *odd, *(r[1] for r in edge_rows())]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(licenses.sql()).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "licenses", "sentence_ids", "unknown").collect())) == sorted(want)
    assert sum(bool(r[1]) for r in want) > len(headers)
