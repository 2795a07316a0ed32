import re

import duckdb

from turfspark.llm import licenses as L


def brute(docs, templates=L.TEMPLATES, t=0.8):
    """Every run of segments against every template, one by one."""
    grams = lambda w: set(zip(w, w[1:], strict=False))
    plain = lambda s: re.findall("[a-z0-9]+", s.lower())
    out = {}
    for d, text in set(docs):
        segments = [w for w in (plain(x) for x in re.split(r"[.!?;:]\s|\n", text or "")) if w]
        whole = grams([x for w in segments for x in w])
        for lic, part, tt in templates:
            b = grams(plain(tt))
            if len(whole & b) < len(b) * 2 / 3 - 1e-9:  # no part can have more
                continue
            for i in range(len(segments)):
                w = []
                for j in range(i, len(segments)):
                    w += segments[j]
                    if len(w) - 1 > len(b) * 1.5 + 1e-9:
                        break
                    a = grams(w)
                    if len(w) - 1 >= len(b) / 1.5 - 1e-9 and a and b:
                        x = round(2 * len(a & b) / (len(a) + len(b)), 6)
                        if x >= t:
                            out[d, lic, part] = max(out.get((d, lic, part), (0, 0)), (x, len(a)))
    return sorted((*k, *v) for k, v in out.items())


APACHE, MIT = L.TEMPLATES[1][2], L.TEMPLATES[4][2]
DOCS = [
    (1, "intro\nLICENSED under the Apache license -- version 2.0!\nmore"), (2, None), (3, ""), (4, "word"), (5, APACHE.replace(" ", "\n", 30)),
    (6, "x\n\n" + MIT.replace("free of charge", "gratis").replace(". ", ".\n") + "\n \ny z"), (7, "Licensed under the"), (8, APACHE + " " + "filler " * 9),
    (1, "intro\nLICENSED under the Apache license -- version 2.0!\nmore"), (9, "été " * 8 + "\n\n" + L.TEMPLATES[11][2]), (10, "a b " * 3000 + "\nLicensed under the MIT License."),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, license string")
    want = brute(DOCS)
    assert len(want) >= 6
    assert sorted(map(tuple, L.scan(docs).collect())) == want
    assert L.scan(docs.limit(0)).count() == 0
    assert "Python" not in L.scan(docs)._jdf.queryExecution().toString()


def test_oracle_agrees(spark):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", DOCS)
    assert sorted(con.sql(L.ORACLE_SQL).fetchall()) == brute(DOCS)


def test_many_templates_take_a_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST", 5)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert sorted(map(tuple, L.scan(docs).collect())) == brute(DOCS)


FULL = next(t for x, p, t in L.TEMPLATES if (x, p) == ("BSD-3-Clause", "full"))


def wrapped(text, lead, width=9):
    w = text.split()
    return "\n".join(lead + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_embedded_notices_are_found(spark):
    """In a comment block, between lines of code, within a line, and wrapped with text before and after."""
    mit = L._MIT + " " + L._MIT_AS_IS
    texts = {
        1: "#include <a.h>\n/*\n * Copyright 2001 A. Uthor\n *\n" + wrapped(mit, " * ") + "\n *\n */\nint main() { return 0; }",
        2: "int a = 1;\n" + wrapped(mit, "// ") + "\nint b = a + 2;\nfor (;;) {}",
        3: "Some words come first. This project is released under the MIT License. And more follow, at length.",
        4: "x = 1\n" + wrapped(FULL, "# ", 7) + "\ny = 2",
        5: "We took nothing of it, no licence at all; permission was never asked.",
        6: "A | b. Licensed under the Apache License, Version 2.0; you know.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = L.scan(docs).collect()
    assert sorted(map(tuple, rows)) == brute(list(texts.items()))
    found = {(r.doc_id, r.license, r.part) for r in rows}
    assert {(1, "MIT", "full"), (2, "MIT", "full"), (3, "MIT", "released"), (4, "BSD-3-Clause", "full"), (6, "Apache-2.0", "short")} <= found
    assert not any(r.doc_id == 5 for r in rows)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(texts.items()))
    assert sorted(con.sql(L.ORACLE_SQL).fetchall()) == brute(list(texts.items()))


def test_long_texts_and_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do as you like with these files.\nOnly keep this note with them, and be kind to others.")
    own = L.read_templates(spark, str(tmp_path))
    assert [x[:2] for x in own] == [("Own-1.0", "full")]
    text = "some words again, and again\n" * 40_000 + "You may do as you like with these files. Only keep this note with them, and be kind to others.\n" + "more words\n" * 40_000
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 5)], "doc_id long, text string, row int")
    assert [tuple(r)[:4] for r in L.scan(docs, own).collect()] == [(1, "Own-1.0", "full", 1.0)]
    assert L.scan(docs, []).count() == 0


def test_rows_without_an_id_stay_apart(spark):
    """Each by its own text; rows equal in id and text count once."""
    a, b = L._MIT + " " + L._MIT_AS_IS, "This project is released under the MIT License. And more follow, at length."
    rows = [(None, a), (None, b), (None, b), (None, None), (7, a), (7, a), (7, b), (8, "nothing")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, *r[1:]) for i, t in [(None, a), (None, b), (7, a), (7, b)] for r in brute([(1, t)])]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len({x[0] for x in want}) == 2
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.sql(L.ORACLE_SQL).fetchall(), key=key) == sorted(want, key=key)
