from turfspark.llm import licenses as L

from .test_licenses import brute

LINES = [
    (1, "Some words.\nReleased under the MIT License.\nMore", "MIT"), (2, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (3, "x y\nThis work is licensed under the CC BY-SA 4.0", "CC-BY-SA-4.0"),
    (4, "// SPDX-License-Identifier: MPL-2.0 */", "MPL-2.0"), (5, "It is distributed under the BSD 3-Clause License", "BSD-3-Clause"), (6, "The album was released under a new name.", None),
    (7, "This work is licensed under ABC.\nThis work is licensed under the ABC.\nLicensed under the ABC License.", None),
]


def test_one_line_notices_are_found(spark):
    docs = spark.createDataFrame([x[:2] for x in LINES], "doc_id long, text string")
    rows = L.scan(docs).collect()
    assert sorted(map(tuple, rows)) == brute([x[:2] for x in LINES])
    best = {}
    for r in sorted(rows, key=lambda r: r.dice):
        best[r.doc_id] = r.license
    assert best == {i: x for i, _, x in LINES if x}
