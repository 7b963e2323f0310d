"""Licence scans by sentence rules: normalised sentences become identifiers of known licence sentences, and runs of
identifiers are matched against ordered licence rules.

Only sentences with a trigger word can be known (a test holds every pattern to that), so other text is skipped at
the speed of one search. Rows are independent: no shuffle, and a hot source is only more rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that every known licence sentence holds at least one of, in lower case.
TRIGGERS = [
    "licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "public domain", "spdx", "as is", "free software", "unencumbered", "endorse or promote", "advertising material", "liable", "use reproduction",
    "in the hope", "received a copy", "creative commons", "cc by", "cc zero", "cc 0", "cc0", "gpl", "bsd", "copy of the mpl", "misrepresented", "plainly marked", "may not be removed", "acknowledgment in the product", "do what the fuck",
]

# Known sentences, lower case, words parted by one space, punctuation other than . - + / dropped. The last group is the version.
SENTENCES = [
    ("spdx", r"spdx-license-identifier ([a-z0-9.+-]+)"),
    ("apache-grant", r"(?:licensed under (?:either of )?(?:the )?)?apache(?: software)? licen[sc]e (?:version |v\.? ?)?([0-9](?:\.[0-9])?)"),
    ("apache-short", r"apache[ -]([0-9]\.[0-9]) licen[sc]e"),
    ("apache-terms", r"terms and conditions for use reproduction and distribution"),
    ("apache-use", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license"),
    ("apache-basis", r"unless required by applicable law .* distributed on an as is basis"),
    ("apache-see", r"see the license for the specific language governing permissions"),
    ("agpl-grant", r"gnu affero general public license,?(?: .*?)?(?:version|v) ?([0-9](?:\.[0-9])?)"),
    ("lgpl-grant", r"gnu (?:lesser|library) general public license,?(?: .*?)?(?:version|v) ?([0-9](?:\.[0-9])?)"),
    ("gpl-grant", r"gnu general public license,?(?: .*?)?(?:version|v) ?([0-9](?:\.[0-9])?)"),
    ("agpl-short", r"agpl[ -]?v?\.? ?([0-9](?:\.[0-9])?)"),
    ("lgpl-short", r"lgpl[ -]?v?\.? ?([0-9](?:\.[0-9])?)"),
    ("gpl-short", r"gpl[ -]?v?\.? ?([0-9](?:\.[0-9])?)"),
    ("gnu-free", r"(?:is|are) free software.* you can redistribute it"),
    ("gnu-hope", r"in the hope that it will be useful"),
    ("gnu-copy", r"you should have received a copy of the gnu"),
    ("mpl-grant", r"mozilla public license,?(?: version| v\.?)? ?([0-9]\.[0-9])"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file you can obtain one"),
    ("epl-grant", r"eclipse public license,?(?: -)?(?: version| v\.?)? ?([0-9]\.[0-9])"),
    ("cc0-grant", r"(?:creative commons zero|cc0|cc 0)(?: 1\.0)?(?: universal)?"),
    ("cc-name", r"creative commons (attribution(?:[ -]non[ -]?commercial)?(?:[ -]share[ -]?alike|[ -]no[ -]?deriv(?:ative)?s)?(?: licen[sc]e)?(?: (?:version )?[0-9]\.[0-9])?)"),
    ("cc-grant", r"(?:licensed|released|available|distributed) under (?:a |the )?(?:creative commons|cc)[ -]((?:by|zero|0)(?:-nc)?(?:-sa|-nd)?(?: [0-9]\.[0-9])?)"),
    ("cc-short", r"(?:creative commons|cc)[ -](by(?:-nc)?(?:-sa|-nd)? [0-9]\.[0-9])"),
    ("mit-name", r"(?:(?:under|by) )?(?:the )?(?:terms of the )?(?:mit|expat) licen[sc]e"),
    ("bsd-short", r"bsd[ -]([0-9])[ -]clause"),
    ("bsd-name", r"(?:(?:under|by) (?:the|a) )?(?:terms of the )?(?:([0-9])[ -]clause )?bsd(?:-style)? licen[sc]e"),
    ("isc-name", r"(?:(?:under|by) )?(?:the )?(?:terms of the )?isc licen[sc]e"),
    ("zlib-name", r"zlib(?:/libpng)? licen[sc]e"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", r"above copyright notice and this permission notice shall be included"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind"),
    ("mit-liable", r"in no event shall the authors or copyright holders be liable"),
    ("isc-grant", r"permission to use copy modify and/or distribute this software for any purpose"),
    ("isc-as-is", r"the software is provided as is and the author disclaims all warranties"),
    ("isc-liable", r"in no event shall the author be liable"),
    ("bsd-grant", r"redistribution and use in source and binary forms"),
    ("bsd-source", r"redistributions of source code must retain"),
    ("bsd-binary", r"redistributions in binary form must reproduce"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", r"to endorse or promote products derived from this software"),
    ("bsd-as-is", r"this software is provided by .* as is"),
    ("bsd-liable", r"in no event shall .* be liable for any direct"),
    ("zlib-as-is", r"this software is provided as-is without any express or implied warranty"),
    ("zlib-liable", r"in no event will the authors? be held liable"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("zlib-thanks", r"acknowledgment in the product documentation would be appreciated"),
    ("zlib-altered", r"altered source versions must be plainly marked"),
    ("zlib-notice", r"this notice may not be removed or altered"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("copyright", r"copyright(?: c)? [0-9]{4}"),
    ("copyright", r"all rights reserved"),
]

# Ordered rules; the first that fits at a place wins. * takes a version, ? marks an optional sentence.
RULES = [
    ("SPDX:*", ["spdx"]),
    ("Apache-*", ["apache-grant", "apache-terms?", "apache-use?", "apache-copy?", "apache-basis?", "apache-see?"]),
    ("Apache-*", ["apache-short"]),
    ("AGPL-*", ["gnu-free?", "agpl-grant", "gnu-hope?", "gnu-copy?"]),
    ("LGPL-*", ["gnu-free?", "lgpl-grant", "gnu-hope?", "gnu-copy?"]),
    ("GPL-*", ["gnu-free?", "gpl-grant", "gnu-hope?", "gnu-copy?"]),
    ("AGPL-*", ["agpl-short"]),
    ("LGPL-*", ["lgpl-short"]),
    ("GPL-*", ["gpl-short"]),
    ("MPL-*", ["mpl-grant", "mpl-copy?"]),
    ("EPL-*", ["epl-grant"]),
    ("CC0-1.0", ["cc0-grant"]),
    ("CC-*", ["cc-name"]),
    ("CC-*", ["cc-grant"]),
    ("CC-*", ["cc-short"]),
    ("MIT", ["mit-name?", "mit-grant", "mit-notice?", "mit-as-is?", "mit-liable?"]),
    ("MIT", ["mit-name"]),
    ("ISC", ["isc-name?", "isc-grant", "isc-as-is?", "isc-liable?"]),
    ("ISC", ["isc-name"]),
    ("BSD-4-Clause", ["bsd-name?", "bsd-grant", "bsd-source?", "bsd-binary?", "bsd-advert", "bsd-endorse?", "bsd-as-is?", "bsd-liable?"]),
    ("BSD-3-Clause", ["bsd-name?", "bsd-short?", "bsd-grant", "bsd-source?", "bsd-binary?", "bsd-endorse", "bsd-as-is?", "bsd-liable?"]),
    ("BSD-2-Clause", ["bsd-name?", "bsd-short?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "bsd-liable?"]),
    ("BSD-*", ["bsd-short"]),
    ("BSD-*", ["bsd-name"]),
    ("Zlib", ["zlib-name?", "zlib-as-is?", "zlib-liable?", "zlib-grant", "zlib-origin?", "zlib-thanks?", "zlib-altered?", "zlib-notice?"]),
    ("Zlib", ["zlib-name"]),
    ("WTFPL", ["wtfpl"]),
    ("Unlicense", ["unlicense"]),
    ("public-domain", ["public-domain"]),
]

# Sentences that name a licence, which a denial before them takes back.
NAMES = {"apache-grant", "apache-short", "agpl-grant", "lgpl-grant", "gpl-grant", "agpl-short", "lgpl-short", "gpl-short", "mpl-grant", "epl-grant", "cc0-grant", "cc-name", "cc-grant", "cc-short", "mit-name", "bsd-name", "bsd-short", "isc-name", "zlib-name", "wtfpl", "public-domain"}
# Sentences that may stand anywhere between those of a licence.
PASSED = {"copyright"}

_TRIGGER = re.compile("|".join(map(re.escape, TRIGGERS)).replace(r"\ ", r"\W+"), re.I)
#: Ends of sentences: full stops and the like, not of abbreviations, and blank lines but for comment marks.
_BORDER = re.compile(r"(?<!\bv)(?<!\bver)(?<!\binc)(?<!\bltd)(?<!\bcorp)(?<!\be\.g)(?<!\bi\.e)[.!?](?=\s|$)|\n[ \t#/*;-]*\n", re.I)
#: A number or letter that counts the items of a list is no sentence.
_MARK = re.compile(r"(?:^|\n)[ \t#/*;>-]*\(?(?:[0-9]{1,3}|[a-z]|[ivx]{1,5})$", re.I)
_DENIAL = re.compile(r"(?:^| )(?:not|never|neither|nor|no longer|isn t|wasn t|aren t|cannot|can t|without|rather than|instead of|except for)(?: [a-z]+){0,3} ?$")
#: A grant of later versions too, right after a version; the plus sign of short names is part of the version.
_LATER = re.compile(r"(?:\.0)?(?:\+|[ -]or[ -]later| (?:of (?:the|this) license )?or (?:at your option )?(?:any )?(?:later|newer))")
_CC = {"attribution": "BY", "noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND", "noderivs": "ND"}
_GAP = re.compile(r"\(\?: \.\*\?\)\?|\.\*")


def _known(name: str, pattern: str) -> tuple[str, re.Pattern, re.Pattern | None, bool]:
    """Name, pattern, what stands before its gap (None without a gap), and whether its last group is the version."""
    gap = _GAP.search(pattern)
    head = re.compile(rf"(?<![a-z0-9]){pattern[: gap.start()]}") if gap else None
    lazy = re.sub(r"\.\*\??", "(.*?)", pattern) if gap else pattern
    return name, re.compile(rf"(?<![a-z0-9]){lazy}(?![a-z0-9])"), head, re.compile(pattern).groups > 0


_KNOWN = [_known(*x) for x in SENTENCES]
#: Starts of sentences with a version: no gap reaches beyond one, as the version there belongs to another licence.
_VERSIONED = [head or pattern for _, pattern, head, version in _KNOWN if version]
_WORD = re.compile(r"[a-z0-9.+/\-]+")
#: What follows the first identifier of an SPDX expression, on its line.
_OPERATOR = re.compile(r"[ \t)]+(OR|AND|WITH)[ \t(]+([A-Za-z0-9.+-]+)")


def normalise(sentence: str) -> str:
    """Lower case, comment marks and quotes gone, one space between words."""
    return " ".join(re.sub(r"[^a-z0-9.+/,\- ]+", " ", sentence.lower().replace("-license-identifier:", "-license-identifier ")).replace(",", " ").split())


def _matches(text: str) -> list[tuple[str, str, int, int]]:
    """(name, version, start, end) of known sentences in normalised text, in order; where two overlap, the first in the list.

    Gaps do not count as overlap: a sentence that stands in the gap of another is found, too.
    """
    found: list[tuple[str, str, int, int]] = []
    taken: list[tuple[int, int]] = []
    bounds: list[int] | None = None
    for name, pattern, head, version in _KNOWN:
        if head is None:
            hits = list(pattern.finditer(text))
        else:
            starts = list(head.finditer(text))
            if not starts:
                continue
            if bounds is None:
                bounds = sorted({m.start() for v in _VERSIONED for m in v.finditer(text)})
            hits = []
            for i, h in enumerate(starts):
                near = bisect_right(bounds, h.start())
                limit = min(bounds[near] if near < len(bounds) else len(text), starts[i + 1].start() if i + 1 < len(starts) else len(text))
                if m := pattern.match(text, h.start(), limit):
                    hits.append(m)
        for m in hits:
            if name in NAMES and _DENIAL.search(text, max(0, m.start() - 80), m.start()):
                taken.append(m.span())
                continue
            spans = [m.span()] if head is None or m.start(1) < 0 else [(m.start(), m.start(1)), (m.end(1), m.end())]
            if all(b <= x or y <= a for a, b in spans for x, y in taken):
                taken.extend(spans)
                number = m[m.re.groups] or "" if version else ""
                if name == "cc-name":
                    number = _attribution(number)
                elif number and "gpl" in name and (later := _LATER.match(text, m.end())):
                    number += "-or-later"
                    taken.append((m.end(), later.end()))
                found.append((name, number, *m.span()))
    return sorted(found, key=lambda f: f[2])


def _attribution(name: str) -> str:
    """The short form of a spelled-out name: its elements and its version."""
    words = re.sub(r"non[ -]?commercial", "noncommercial", re.sub(r"share[ -]?alike", "sharealike", re.sub(r"no[ -]?deriv", "noderiv", name)))
    parts = [_CC[w] for w in re.split(r"[ -]+", words) if w in _CC]
    number = re.search(r"[0-9]\.[0-9]", name)
    return "-".join(parts) + (f" {number[0]}" if number else "")


def _places(sentence: str) -> list[tuple[int, int]]:
    """Where the words of the normalised sentence stand in the sentence."""
    lower, at = [], []
    for i, c in enumerate(sentence):
        for x in c.lower():
            lower.append(x)
            at.append(i)
    text = "".join(lower).replace("-license-identifier:", "-license-identifier ")
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer(text)]


def identify(sentence: str) -> list[tuple[str, str, int, int]]:
    """(identifier, version, first, end) of the known sentences in a sentence, in order; together they take up all of it.

    An SPDX expression gives one for each identifier; an exception stays with its identifier.
    """
    text = normalise(sentence)
    found = _matches(text)
    if not found:
        return []
    if len(found) == 1 and found[0][0] != "spdx":
        return [(*found[0][:2], 0, len(sentence))]
    places, starts = _places(sentence), [0]
    starts.extend(m.end() for m in re.finditer(" ", text))
    out, done = [], 0
    for name, version, start, end in found:
        if (begin := places[bisect_right(starts, start) - 1][0]) < done:
            continue  # a name within an expression
        out.append((name, version, begin))
        at = places[bisect_right(starts, end - 1) - 1][1]
        while name == "spdx" and (m := _OPERATOR.match(sentence, at)):
            other, at = m[2].lower().rstrip("."), m.end()
            if m[1] == "WITH":
                out[-1] = (name, f"{out[-1][1]} with {other}", out[-1][2])
            else:
                out.append((name, other, m.start(2)))
            done = at
    firsts = [0, *(first for _, _, first in out[1:]), len(sentence)]
    return [(name, version, firsts[i], firsts[i + 1]) for i, (name, version, _) in enumerate(out)]


def _cuts(text: str) -> list[int]:
    """Where sentences begin, and the end of the text."""
    ends = (m for m in _BORDER.finditer(text) if m[0][0] != "." or not _MARK.search(text, text.rfind("\n", 0, m.start()) + 1, m.start()))
    return [0, *(m.end() for m in ends), len(text)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences that hold a trigger word, in order."""
    hits = [m.start() for m in _TRIGGER.finditer(text)]
    if not hits:
        return
    cuts = _cuts(text)
    for i in sorted({bisect_right(cuts, h, hi=len(cuts) - 1) - 1 for h in hits}):
        yield cuts[i], cuts[i + 1]


def recognise(known: list[tuple[str, bool]]) -> list[tuple[int, int, int]]:
    """(rule, first, end) of the licences in a sequence of identifiers; each with whether it follows the one before at once."""
    out, at = [], 0
    while at < len(known):
        for number, (_, rule) in enumerate(RULES):
            i = at
            for step in rule:
                if i < len(known) and (i == at or known[i][1]) and known[i][0] == step.rstrip("?"):
                    i += 1
                elif not step.endswith("?"):
                    i = at
                    break
            if i > at:
                out.append((number, at, i))
                at = i
                break
        else:
            at += 1
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(licence, first, end) of the licences in a text, in order."""
    known: list[tuple[str, str, int, int]] = []
    follows: list[bool] = []
    reach = -1  # end of the last known sentence, and of what may stand behind it
    for a, b in sentences(text):
        for name, version, first, end in identify(text[a:b]):
            near = reach >= 0 and not re.search(r"[^\W_]", _MARKS.sub("", text[reach : a + first]))
            if name not in PASSED:
                known.append((name, version, a + first, a + end))
                follows.append(near)
            if name not in PASSED or near:
                reach = a + end
    out = []
    for number, i, j in recognise([(k[0], f) for k, f in zip(known, follows)]):
        licence, version = RULES[number][0], next((k[1] for k in known[i:j] if k[1]), "")
        out.append((licence.replace("*", version.upper() if licence.startswith("CC") else version).rstrip("-: "), known[i][2], known[j - 1][3]))
    return out


#: Marks of lists at the starts of lines.
_MARKS = re.compile(r"(?:^|(?<=\n))[ \t#/*;>-]*\(?(?:[0-9]{1,3}|[a-z]|[ivx]{1,5})[.)](?=\s|$)", re.I)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (distinct, sorted, comma-joined; empty if none), n_matches and matches (licence, first, end) of every row.

    Null and empty texts have none; repeated rows are scanned alike; an empty table gives none.
    """
    kind = "doc_id long, licences string, n_matches long, matches array<struct<licence: string, first: int, end: int>>"
    arrow = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            rows = [[{"licence": x, "first": a, "end": b} for x, a, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([",".join(sorted({x for x, _, _ in f})) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(rows, arrow)], names=["doc_id", "licences", "n_matches", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, kind)
