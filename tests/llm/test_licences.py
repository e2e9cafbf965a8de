import numpy as np
import pyarrow as pa

from statforge.llm.licences import COVERAGE, TEMPLATES, Compiled, licence_finds
from statforge.llm.textops import Words


def brute(texts):
    out = []
    index = Compiled(TEMPLATES, COVERAGE)
    for d, text in enumerate(texts):
        h = Words(pa.array([text])).hash
        for t, own in enumerate(index.words):
            for r in range(-len(own), len(h)):
                same = np.array([0 <= r + p < len(h) and h[r + p] == w for p, w in enumerate(own)])
                if same.sum() >= index.need[t] and same[index.key[t]].all():
                    out.append((d, t, r))
    return sorted(out)


TEXTS = [
    "Released under the MIT License.",
    "some words first RELEASED!! UNDER!! THE!! MIT!! LICENSE!! then more",
    "Licensed under CC BY-NC 4.0. and also Licensed under CC BY-SA 4.0.",
    "licenced under the apache license, version 2.0",
    "work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 4.",
    "under the terms of the license you may redistribute the mit version",
    "",
    "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files",
]


def test_equals_brute_force(make):
    rows = licence_finds(make(list(enumerate(TEXTS)))).collect()
    assert sorted((r.doc_id, r.template, r.word_pos) for r in rows) == brute(TEXTS)
    assert {(r.doc_id, r.licence) for r in rows} >= {(0, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0"), (2, "CC-BY-SA-4.0"), (3, "Apache-2.0"), (4, "GPL-3.0"), (8, "MIT")}
    assert not {5, 6, 7} & {r.doc_id for r in rows}


def test_odd_rows(odd, empty, make):
    assert licence_finds(odd).count() == 0 and licence_finds(empty).count() == 0
    twice = make([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0])])
    assert sorted(str(r.doc_id) for r in licence_finds(twice).collect()) == ["1", "1", "None"]
    assert licence_finds(make([(1, "pad " * 30000 + TEXTS[0])])).first().word_pos == 30000
