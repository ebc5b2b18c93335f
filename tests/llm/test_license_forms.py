"""Licence texts as they are found in files: wrapped, in comments, with a subject."""

import duckdb
import pytest

from tercet.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = GPL.replace("GNU General", "GNU Affero General")
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace("ISC License", "").replace("granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "granted.")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy"
NAMES = (
    ("Apache-2.0", APACHE), ("Apache-2.0", APACHE.split("\n")[0]), ("MIT", MIT), ("GPL-3.0-or-later", GPL), ("BSD-3-Clause", BSD), ("BSD-2-Clause", BSD_2), ("MPL-2.0", MPL),
    ("LGPL-2.1-or-later", LGPL), ("AGPL-3.0-or-later", AGPL), ("ISC", ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB), ("EPL-2.0", EPL), ("Unlicense", UNLICENSE), ("LGPL-3.0-or-later", LGPL.replace("2.1", "3")),
    # one text of each, in either order, and one within the other's reach
    ("BSD-3-Clause,BSD-2-Clause", BSD + "\n\n" + BSD_2), ("BSD-3-Clause,BSD-2-Clause", BSD_2 + "\n\n" + BSD), ("MIT,BSD-2-Clause", BSD_2 + "\n\n" + MIT), ("BSD-3-Clause", BSD + "\n\n" + BSD),
    ("", BSD.split("\n\n")[0]), ("", "All rights reserved."), ("", ZLIB.split("\n\n")[0]),
)


def by_sql(frame) -> dict:
    """What the SQL gives for rows of doc_id and text."""
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    return {r[0]: (r[2], r[3]) for r in con.execute("SELECT doc_id, n_sentences, sentence_ids, licences FROM (" + licenses.SQL + ")").fetchall()}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "; ", "-- ", "dnl ", "| "])
def test_wrapped_texts(spark, prefix):
    texts = [(k, f"Some words.\n{prefix}" + t.replace("\n", "\n" + prefix)) for k, (_, t) in enumerate(NAMES)]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.report(frame).collect()}
    assert {k: name for k, (_, name) in got.items()} == {k: name for k, (name, _) in enumerate(NAMES)}
    assert by_sql(frame) == got


def test_notices_with_a_subject(spark):
    texts = {
        "This file is licensed under the Apache License, Version 2.0.": ("apache2_notice", "Apache-2.0"),
        "All of these are released under the\nMIT license": ("mit_notice", "MIT"),
        "The library is distributed under the GNU General Public License, version 3.": ("gpl3_notice", "GPL-3.0-only"),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl3_notice", "GPL-3.0-only"),
        "It is not licensed under the Apache License, Version 2.0.": ("", ""),
        "Not licensed under the Apache License, Version 2.0.": ("", ""),
        "licensed under CC BY 4.0 and more": ("", ""),
        'Licensed under the Apache License, Version 2.0 (the "License");': ("apache2_grant", "Apache-2.0"),
    }
    frame = spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.report(frame).collect()}
    assert got == texts and by_sql(frame) == got


def test_rules_name_known_sentences():
    assert {k for _, sentences in licenses.RULES for k in sentences} <= set(licenses.SENTENCES)
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES) >= 60
    assert all(s == " ".join(s.split()) == s.lower() for s in licenses.SENTENCES.values())
