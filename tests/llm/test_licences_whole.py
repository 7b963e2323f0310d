import random

import pytest

from tessella.llm import licences

MIT, APACHE = "a is released under the MIT License", "b is licensed under the Apache License, Version 2.0"


@pytest.mark.parametrize(
    "text, found",
    [
        (MIT + "\n" + APACHE, ["MIT", "Apache-2.0"]),
        (APACHE + "; " + MIT, ["Apache-2.0", "MIT"]),
        (MIT + "\n" + MIT, ["MIT", "MIT"]),
        ("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: ISC\nint x", ["SPDX:mit", "SPDX:isc"]),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nor else", ["SPDX:mit", "SPDX:apache-2.0", "SPDX:bsd-3-clause"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["SPDX:gpl-2.0-only with classpath-exception-2.0", "SPDX:mit"]),
        ("SPDX-License-Identifier: MIT and it is short", ["SPDX:mit"]),
        ("GNU Lesser General Public License\nGNU General Public License version 2", ["GPL-2"]),
        ("GNU General Public License version 3\nGNU Affero General Public License v3\nGNU Lesser General Public License, version 2.1", ["GPL-3", "AGPL-3", "LGPL-2.1"]),
        ("GNU General Public License, unlike what is released under the MIT License, version 2", ["GPL-2", "MIT"]),
        ("You should have received a copy of the GNU General Public License version 2", ["GPL-2"]),
        ("This is free and unencumbered software released into the public domain", ["Unlicense"]),
    ],
)
def test_all_in_a_sentence(text, found):
    got = licences.scan(text)
    assert [x for x, _, _ in got] == found
    assert all(a < b for _, a, b in got) and all(b <= a for (_, _, b), (_, a, _) in zip(got, got[1:]))


def test_places(prose):
    r = random.Random(3)
    for _ in range(200):
        s = "".join(r.choice(["aB", "İ", "É", "K", "Σ", " ", "\n", "(", ",", ".", "-", "spdx-license-identifier:", "'", "/"]) for _ in range(20))
        words = [s[a:b].lower() for a, b in licences._places(s)]
        assert len(words) == len(licences.normalise(s).split())
    text = prose(1, 4000) + "\n" + MIT + "\n" + prose(2, 4000) + "\n" + APACHE + "\n" + prose(3, 4000)
    (_, a, b), (_, c, d) = licences.scan(text)
    assert a < text.index("under the MIT") < b <= c <= text.index("licensed under the Apache") < d
