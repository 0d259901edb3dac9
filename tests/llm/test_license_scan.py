from parcelgrid.llm import license_scan as ls

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions.\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)


def test_rules(spark):
    bsd2 = ".\n".join(ls.SENTENCES[i] for i in ("bsd-grant", "bsd-source", "bsd-binary"))
    cases = [
        ("Text before. Licensed under the Apache License, Version 2.0.\nmore", ["Apache-2.0"]),
        (MIT, ["MIT"]), (MIT.upper(), ["MIT"]), (bsd2, ["BSD-2-Clause"]),
        (f"{bsd2}.\n{ls.SENTENCES['bsd-endorse']}", ["BSD-3-Clause"]),
        ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
        (ls.SENTENCES["bsd-source"], []), ("unlicensed under the mit license", []), (None, []), ("", []), (" .\n. ", []),
        ("All rights reserved. " * 2000, ["proprietary"]),
    ]
    table = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(cases)], "doc_id long, text string, sentences string")
    got = {r.doc_id: r.licenses for r in ls.licenses(table).collect()}
    assert got == {i: names for i, (_, names) in enumerate(cases)}


def test_odd_and_empty(odd_docs, no_docs):
    assert ls.licenses(odd_docs).count() == odd_docs.count()
    assert ls.licenses(no_docs).count() == 0
