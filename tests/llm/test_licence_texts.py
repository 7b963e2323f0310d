import itertools
import random

import pytest

from tessella.llm import licences

AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
HEAD = """Copyright (c) 2019, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
BSD2, BSD3 = HEAD + "\n" + AS_IS, HEAD + THIRD + "\n" + AS_IS
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
   you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
   required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
      through 9 of this document."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


@pytest.mark.parametrize(
    "text, found",
    [
        (BSD2, ["BSD-2-Clause"]),
        (BSD3, ["BSD-3-Clause"]),
        (BSD3.replace("\n", "\n# "), ["BSD-3-Clause"]),
        (BSD3.replace("\n", " "), ["BSD-3-Clause"]),
        (BSD3 + "\n\n" + ZLIB, ["BSD-3-Clause", "Zlib"]),
        (ZLIB, ["Zlib"]),
        ("zlib License\n\n(C) 1995 Some One\n\n" + ZLIB, ["Zlib", "Zlib"]),
        (MIT, ["MIT"]),
        (GPL, ["GPL-2-or-later"]),
        (MPL, ["MPL-2.0"]),
        ("subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        (APACHE, ["Apache-2.0"]),
        ("Creative Commons Attribution-ShareAlike 4.0", ["CC-BY-SA 4.0"]),
        ("under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ["CC-BY-NC-ND 4.0"]),
        ("Text is available under CC BY-SA 3.0.", ["CC-BY-SA 3.0"]),
        ("To the extent possible, CC0 1.0 Universal applies.", ["CC0-1.0"]),
        ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("MIT License and the Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["SPDX:mit", "SPDX:apache-2.0"]),
        ("GNU Lesser General Public License, version 2.1 or any later version", ["LGPL-2.1-or-later"]),
        ("It is licensed under GPLv3+ or LGPL-2.1.", ["GPL-3-or-later", "LGPL-2.1"]),
        ("AGPL v3 or later", ["AGPL-3-or-later"]),
        ("It is not released under the MIT License.", []),
        ("It is no longer licensed under the Apache License, Version 2.0, but under the MIT License.", ["MIT"]),
        ("unlike what the GNU General Public License, version 3 says", ["GPL-3"]),
        ("This isn't released under the BSD license", []),
        ("Use the 3-clause BSD license, i.e. BSD-3-Clause.", ["BSD-3", "BSD-3"]),
        ("No simple example of a template.", []),
    ],
)
def test_texts(text, found):
    got = licences.scan(text)
    assert [x for x, _, _ in got] == found
    assert all(0 <= a < b <= len(text) for _, a, b in got) and all(b <= a for (_, _, b), (_, a, _) in zip(got, got[1:]))


def forms(rule):
    """All sequences of identifiers that a rule accepts."""
    for kept in itertools.product(*[(True, False) if s.endswith("?") else (True,) for s in rule]):
        yield [s.rstrip("?") for s, k in zip(rule, kept) if k]


def brute(known):
    """The first rule with an accepted sequence here, and its longest; sequences end where a sentence does not follow at once."""
    out, at = [], 0
    while at < len(known):
        end = next((j for j in range(at + 1, len(known)) if not known[j][1]), len(known))
        names = [k[0] for k in known[at:end]]
        for number, (_, rule) in enumerate(licences.RULES):
            fits = [len(f) for f in forms(rule) if f and names[: len(f)] == f]
            if fits:
                out.append((number, at, at + max(fits)))
                at += max(fits)
                break
        else:
            at += 1
    return out


def test_all_identifier_sequences():
    r = random.Random(1)
    names = sorted({s.rstrip("?") for _, rule in licences.RULES for s in rule})
    for _ in range(400):
        known = []
        for _ in range(r.randint(0, 4)):
            part = r.choice(list(forms(r.choice(licences.RULES)[1])))
            if r.random() < 0.3:
                part = part[: r.randint(0, len(part))] + [r.choice(names)]
            known += [(x, r.random() < 0.9) for x in part]
        assert licences.recognise(known) == brute(known)


def test_names_are_known():
    known = {name for name, _ in licences.SENTENCES}
    assert {s.rstrip("?") for _, rule in licences.RULES for s in rule} == known - licences.PASSED and licences.NAMES < known
