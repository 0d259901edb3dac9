"""The canonical notices as they stand in files: wrapped, in comments, and on one line."""

import textwrap

from parcelgrid.llm import license_scan as ls

APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) [year] [fullname]

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD2 = """Copyright (c) [year], [fullname]
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
CASES = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2}


def test_canonical_texts(spark):
    forms = {
        "as it stands": lambda t: t,
        "windows": lambda t: t.replace("\n", "\r\n"),
        "hash": lambda t: textwrap.indent(t, "# ", lambda line: True),
        "slashes": lambda t: textwrap.indent(t, "// ", lambda line: True),
        "block": lambda t: f"/*\n{textwrap.indent(t, ' * ', lambda line: True)}\n */",
        "narrow": lambda t: "\n\n".join(textwrap.fill(p, 40) for p in t.split("\n\n")),
        "one line": lambda t: " ".join(t.split()),
        "within a text": lambda t: f"Some words before it\n\n{t}\nand some after",
    }
    cases = [(name, form, write(text)) for name, text in CASES.items() for form, write in forms.items()]
    table = spark.createDataFrame([(i, c[2]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {cases[r.doc_id][:2]: r.licenses for r in ls.licenses(table).collect()}
    assert got == {(name, form): [name] for name, form, _ in cases}


def test_sentences_need_cuts_on_both_sides(spark):
    texts = ["unlicensed under the\nmit license", "It was released under the MIT License", "Released under the MIT License for now", "Released under\nthe MIT License"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in ls.licenses(table).collect()} == {0: [], 1: [], 2: [], 3: ["MIT"]}
