import random
import re
import textwrap

import pytest

from murmur.llm import licences, queries
from tests.llm.util import SF, frame

PLAIN = ["The weather was fine and the market full of people.", "Der Zug kam mit zwei Stunden an.", "thorea erst inand the oner."]


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    text = lambda: "\n".join(" ".join(r.choice(" ".join(PLAIN).split()) for _ in range(r.randrange(5, 60))) for _ in range(3))
    return licences.fit(frame(spark, [(k, text(), "s") for k in range(300)]))


def scan(spark, model, rows):
    found = licences.scan_paragraphs(frame(spark, rows), *model).collect()
    return sorted((r.key, r.family) for r in found if r.confirmed)


def test_every_template_is_found(spark, model):
    rows, want = [], []
    for f in licences.FAMILIES:
        for t in licences.TEMPLATES[f]:
            rows.append((len(rows), f"{PLAIN[0]}\n{t.upper() if len(rows) % 2 else t}\n{PLAIN[1]}", "s"))
            want.append((len(want), f))
    got = scan(spark, model, rows)
    assert len(set(got) & set(want)) >= .93 * len(want) and not set(got) - set(want)


def test_cue_words_touch_enough_of_every_template():
    cues = set(licences.cue_words())
    for texts in licences.TEMPLATES.values():
        for t in texts:
            w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if x]
            tri = {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
            assert sum(not cues & set(x) for x in tri) < licences.CONFIRM * len(tri), t


def test_talk_and_plain_text_stay_out(spark, model):
    rows = [(k, t, "s") for k, t in enumerate(PLAIN + licences.TALK + ["She got her driving licence and was released.", "a public general in version 3"])]
    assert scan(spark, model, rows) == []


def test_long_paragraph_and_odd_rows(spark, model):
    long = " ".join(PLAIN * 40)
    rows = [(1, long + " Released under the MIT License. " + long, "s"), (2, None, "s"), (3, "", "s"), (4, " \n.", "s"),
            (None, "Licensed under CC BY-NC 4.0.", "s"), (5, "Licensed under CC BY-NC 4.0.", "s"), (5, "Licensed under CC BY-NC 4.0.", "s")]
    got = licences.scan_paragraphs(frame(spark, rows), *model).where("confirmed").collect()
    assert sorted((r.key or 0, r.family) for r in got) == [(0, "CC-BY-NC"), (1, "MIT"), (5, "CC-BY-NC"), (5, "CC-BY-NC")]


def test_query(spark):
    got = queries.op2_licence_scan(spark, SF)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    rows = got.collect()
    assert len(rows) == len(text)
    for r in rows:
        lines = [x for x in text[r.doc_id].split("\n") if re.search(r"\w", x)]
        assert r.families == ",".join(sorted({known[x] for x in lines if x in known})) and r.n_paragraphs == len(lines)
        assert (r.probability > 0) == bool(r.families)


def test_rows_of_odd_tables(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "Released under the MIT License.", "s"), (3, "Released under the MIT License.", "s"),
            (3, "Released under the MIT License.", "s"), (4, "\n".join(PLAIN), "s")]
    got = licences.licences(frame(spark, rows).selectExpr("*", "1 as w", "2 as mark", "3 as families")).collect()
    assert sorted((r.doc_id or 0, r.n_paragraphs, r.families) for r in got) == [(0, 1, "MIT"), (1, 0, ""), (2, 0, ""), (3, 1, "MIT"), (3, 1, "MIT"), (4, 3, "")]
    assert licences.licences(frame(spark, rows).limit(0)).count() == 0


#: Openings of well-known notices as they stand in files (fixed values), wrapped below.
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
               "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                  "copy of the License at the address below.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the address below",
}


def test_wrapped_notices(spark, model):
    rows = []
    for width in (40, 60, 75, 200):
        for f, t in NOTICES.items():
            block = "\n".join(textwrap.wrap(t, width))
            rows += [(len(rows), f"{PLAIN[0]}\n\n{block}\n\n{PLAIN[1]}", "s"), (len(rows) + 1, f"{PLAIN[0]}\n{block}\n{PLAIN[1]}", "s")]
    got = {(k, f) for k, f in scan(spark, model, rows)}
    want = {(2 * i + j, f) for i, f in enumerate(list(NOTICES) * 4) for j in (0, 1)}
    assert not got - want and len(got & want) >= .95 * len(want)


def test_a_blank_line_ends_a_notice(spark, model):
    words = NOTICES["BSD"].split()
    apart = "\n\n".join(" ".join(words[i:i + 4]) for i in range(0, len(words), 4))
    assert scan(spark, model, [(1, apart, "s")]) == []


def shares(text):
    """Share of each template's trigrams that a paragraph holds, by plain sets."""
    def tri(t):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if x]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
    own = tri(text)
    return {f: max(len(tri(t) & own) / len(tri(t)) for t in ts) for f, ts in licences.TEMPLATES.items()}


def test_confirmation_equals_brute_force(spark, model):
    r = random.Random(8)
    rows = []
    for f in licences.FAMILIES:
        for t in licences.TEMPLATES[f]:
            w = t.split()
            for keep in (.5, .8, 1):
                part = [x if r.random() < keep else r.choice(PLAIN[0].split()) for x in w]
                rows.append((len(rows), " ".join(part), "s"))
    found = licences.scan_paragraphs(frame(spark, rows), *model).collect()
    assert len(found) > 60
    for x in found:
        assert x.confirmed == (shares(rows[x.key][1])[x.family] >= licences.CONFIRM)
