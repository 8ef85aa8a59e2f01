"""Licences as their users print them: texts of their own, not those of the module."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import license_scan

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{condition}

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{condition}

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{a} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{b} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {holder} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
{c} Neither the name of {holder} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

{a} The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
{b} Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
{c} This notice may not be removed or altered from any source distribution.
"""
MARKS = {"numbers": ("1.", "2.", "3."), "stars": ("*", "*", "*"), "dashes": ("-", "-", "-"), "letters": ("(a)", "(b)", "(c)"), "round": ("1)", "2)", "3)")}
MIT = MIT_BODY.format(condition=", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.")
ISC = ISC_BODY.format(condition=", provided that the above\ncopyright notice and this permission notice appear in all copies.")
NOTICE = "Copyright (c) 2019-2024 Acme, Inc. and others\n\n"


def bsd(marks, holder="the copyright holder", third=True, liable="THE COPYRIGHT HOLDER OR CONTRIBUTORS"):
    a, b, c = MARKS[marks]
    return BSD.format(a=a, b=b, third=THIRD.format(c=c, holder=holder) if third else "", holder=liable)


def zlib(marks):
    return ZLIB.format(**dict(zip("abc", MARKS[marks], strict=True)))


#: (licence, text); None: another text.
PRINTINGS = [
    *(("MIT", head + MIT) for head in ("", "MIT License\n\n", "The MIT License (MIT)\n\n" + NOTICE, "The MIT License (MIT)\nhttps://opensource.org/licenses/MIT\n\n" + NOTICE)),
    ("MIT", MIT + "\n<https://spdx.org/licenses/MIT.html>\n"), ("MIT", NOTICE + MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "ACME CORPORATION")),
    *(("MIT-0", head + MIT_BODY.format(condition=".")) for head in ("", "MIT No Attribution\n\n" + NOTICE, "MIT-0\n\n")),
    *(("ISC", head + ISC) for head in ("", NOTICE, "ISC License\n\n" + NOTICE, "The ISC License\n\n")), *(("0BSD", head + ISC_BODY.format(condition=".")) for head in ("", NOTICE, "BSD Zero Clause License\n\n")),
    *(("BSD-3-Clause", head + bsd(m)) for m in MARKS for head in ("", "BSD 3-Clause License\n\n" + NOTICE)),
    *(("BSD-3-Clause", NOTICE + bsd("stars", holder)) for holder in ("Acme, Inc.", "the Acme Project", "Google LLC", "the University of California, Berkeley", "Erika Mustermann-Gabler")),
    ("BSD-3-Clause", NOTICE + bsd("numbers", "the author", liable="THE REGENTS OR CONTRIBUTORS")),
    *(("BSD-2-Clause", head + bsd(m, third=False)) for m in MARKS for head in ("", "BSD 2-Clause License\n\n" + NOTICE)), ("BSD-2-Clause", bsd("numbers", third=False, liable="THE AUTHOR")),
    *(("Zlib", head + zlib(m)) for m in MARKS for head in ("", NOTICE, "zlib License\n\n")),
    (None, MIT.replace("free of charge", "for a fee")), (None, bsd("stars").replace("without specific", "with")), (None, bsd("stars").replace("may be used", "must be used")), (None, ISC + "\nNo warranty at all."), (None, zlib("stars").replace("must not", "may")), (None, "https://opensource.org/licenses/MIT"), (None, "1. a) (b)"),
]


def base(name):
    return name and name.partition(" ")[0]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = f"{tmp_path_factory.mktemp('licences')}"
    rows = [(i, t) for i, (_, t) in enumerate(PRINTINGS)] + [(len(PRINTINGS) + i, "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */") for i, (_, t) in enumerate(PRINTINGS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_printings(spark, table):
    got = {r["doc_id"]: r["license_id"] for r in license_scan.op7_license_digest(spark, table).collect()}
    assert [(i, k, got[i]) for i, (k, _) in enumerate(PRINTINGS * 2) if base(got[i]) != k] == []


def test_sql_finds_the_same(spark, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{table}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, digest, license_id, is_license FROM ({license_scan.OP7_SQL})").fetchall()}
    assert {tuple(r) for r in license_scan.op7_license_digest(spark, table).collect()} == want and sum(r[3] for r in want) > 80
