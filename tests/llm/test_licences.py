import re

import pytest

from tessella.llm import licences

MIT = """MIT-like header

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software: do as you like. The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by the FSF, either version 2 of the License.
# It is distributed in the hope that it will be useful."""
BSD = """Redistribution and use in source and binary forms are permitted.
Redistributions of source code must retain this. Redistributions in binary form must reproduce this."""


@pytest.mark.parametrize(
    "text, found",
    [
        ("la de.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3"]),
        ("foo | bar\nReleased under the MIT License.\nbaz", ["MIT"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC 4.0"]),
        ("// SPDX-License-Identifier: MPL-2.0", ["SPDX:mpl-2.0"]),
        (MIT, ["MIT"]),
        (GPL, ["GPL-2"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + " Do not use names to endorse or promote products derived from this software.", ["BSD-3-Clause"]),
        ("GNU Lesser General Public License version 2.1. And Mozilla Public License 2.0!", ["LGPL-2.1", "MPL-2.0"]),
        ("Released under the MIT License. Some words. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("A driving licence and a warranty for the copyright office.", []),
        ("", []),
    ],
)
def test_rules(text, found):
    got = licences.scan(text)
    assert [x for x, _, _ in got] == found
    assert all(0 <= a < b <= len(text) for _, a, b in got)


def test_every_known_sentence_has_a_trigger():
    words = [re.sub("[^a-z]", "", t) for t in licences.TRIGGERS]
    for name, pattern in licences.SENTENCES:
        plain = re.sub("[^a-z]", "", pattern.replace("[sc]", "s"))
        assert any(w in plain for w in words), name


def whole(text):
    """Without the search for triggers: every sentence is identified."""
    cuts = [0, *(m.end() for m in licences._BORDER.finditer(text)), len(text)]
    return [x for a, b in zip(cuts, cuts[1:]) if (x := licences.identify(text[a:b]))]


def test_trigger_search_loses_nothing(prose):
    for seed in range(20):
        text = prose(seed, 30) + ". " + [MIT, GPL, BSD][seed % 3] + "\n\n" + prose(seed + 50, 20) + ". Licensed under the Apache License, Version 2.0. " + prose(seed, 9)
        assert whole(text) == [x for a, b in licences.sentences(text) if (x := licences.identify(text[a:b]))]


def test_table(spark, odd_docs):
    frame = odd_docs.unionByName(odd_docs.limit(1).selectExpr("77L AS doc_id", "'Released under the MIT License.' AS text", "source", "fp", "score", "cell"))
    got = licences.licences(frame).collect()
    assert len(got) == frame.count() and [(r["doc_id"], r["licences"]) for r in got if r["n_matches"]] == [(77, "MIT")]
    assert licences.licences(odd_docs.limit(0)).count() == 0
