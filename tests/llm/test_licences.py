import random

from proplytics.llm import licences
from tests.llm.support import documents, edge_rows


def brute(scanner, templates, text, least):
    """Every run of sentences against every template."""
    parts, at = [], 0
    for gap in licences._BREAK.finditer(text):
        parts.append((at, gap.start()))
        at = gap.end()
    parts.append((at, len(text)))
    best = {}
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            run = licences.bigrams([w for a, b in parts[i : j + 1] for w in licences.normalised(text[a:b])])
            scores = [(-licences.dice(run, licences.bigrams(licences.normalised(t))), n) for n, t in templates]
            score, name = min(scores)
            if -score >= least and (name not in best or -score > best[name][0]):
                best[name] = (-score, parts[i][0], parts[j][1])
    return sorted((n, *v) for n, v in best.items())


def test_scan_equals_all_runs():
    rnd = random.Random(2)
    scanner = licences.Scanner(licences.TEMPLATES, 0.85)
    prose = "the work of a person under this and in the use of all copies".split()
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(licences.TEMPLATES)[1].split() if rnd.random() < 0.5 else [rnd.choice(prose) for _ in range(rnd.randint(1, 12))]
            if rnd.random() < 0.3:
                words[rnd.randrange(len(words))] = "changed"
            parts.append(" ".join(words))
        text = "\n".join(parts)
        got, want = scanner.scan(text), brute(scanner, licences.TEMPLATES, text, 0.85)
        assert [(n, round(s, 9)) for n, s, _, _ in got] == [(n, round(s, 9)) for n, s, _, _ in want], text


def test_full_texts_and_near_misses(spark):
    mit = licences.TEMPLATES[17][1]
    rows = edge_rows() + [(500, f"Words before.\n{mit}\nWords after.", "s"), (501, "Released under the MIT License", "s"), (502, "He was released under the bridge.", "s"),
                          (503, "LICENSED UNDER CC BY-NC 4.0", "s"), (504, "An essay on the GNU project. It has no licence.", "s")]
    got = {(r.doc_id, r.licence): r for r in licences.licence_scan(documents(spark, rows)).collect()}
    assert set(got) == {(500, "MIT"), (501, "MIT"), (503, "CC-BY-NC-4.0")}
    found = got[500, "MIT"]
    assert found.dice > 0.95 and "Permission is hereby granted" in rows[-5][1][found["first"] : found["last"]]
    assert licences.licence_scan(documents(spark, [])).collect() == []
    assert licences.licence_scan(documents(spark, rows), templates=()).collect() == []


def test_ordinary_wordings_inside_sentences_and_every_hit(spark):
    header = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
              "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    want = {
        1: ("Licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), 2: ("This software is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        3: ("This project is released under the MIT License.", ["MIT"]), 4: ("This work is licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        5: ("It is licensed under the GNU General Public License v3.0.", ["GPL-3.0"]), 6: (header, ["GPL-3.0"]), 7: (licences._BSD, ["BSD-2-Clause"]),
        8: ("some words without a stop " * 20 + "licensed under CC BY-NC 4.0 and more words " + "that go on " * 30, ["CC-BY-NC-4.0"]),
        9: ("Released under the MIT License. " + "Other words stand here. " * 9 + "Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "MIT", "Apache-2.0"]),
        10: ("licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]), 11: ("Under the licence of the work. Version 2 of the public.", []),
    }
    rows = licences.licence_scan(documents(spark, [(i, t, "s") for i, (t, _) in want.items()])).collect()
    for i, (_, names) in want.items():
        assert [r.licence for r in sorted(rows, key=lambda r: r["first"]) if r.doc_id == i] == names, i
