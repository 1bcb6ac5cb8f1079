"""Licence recognition by sentences and rules.

A text is cut into sentences, a normalised sentence is mapped to the identifier of a known licence sentence, and
the sequence of identifiers is matched against ordered rules, longer ones first: a licence is what a run of
sentences says, not what one word suggests. Sentences that speak of licences but are not known are counted.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm import common

#: A sentence with one of these that is not known counts as unmatched.
TRIGGERS = ("licen", "copyright", "permission is", "permitted", "warrant", "public domain", "redistribut", "liab", "as is", "provided that", "acknowledg", "endorse", "conditions", "gpl", "cc0", "cc by", "creative commons", "rights reserved", "spdx")
#: A text or sentence without any of these holds no known licence sentence, however its words are spaced.
SEARCHED = (*TRIGGERS, "mpl", "wtfpl", "public", "reserved", "1.0", "2.0", "3.0", "4.0")

# Normalised sentences of public licences, as patterns. {v} stands for a version, which joins the identifier.
SENTENCES = [
    ("SPDX:{v}", r"spdx-license-identifier: ?(?P<v>[\w.+-]+(?: (?:and|or|with) [\w.+-]+)*)"),
    ("ApacheVer:{v}", r"(?:(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the )?apache license,? ?(?:version )?(?P<v>[12](?:\.[01])?)(?: \(the license\))?"),
    ("ApacheMayNot", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("ApacheCopyAt", r"you may obtain a copy of the license at .*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("LGPLVer:{v}", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the gnu (?:lesser|library) general public license,? ?(?:version )?(?P<v>[23](?:\.\d)?(?: or later)?)"),
    ("AGPLVer:{v}", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the gnu affero general public license,? ?(?:version )?(?P<v>3(?:\.0)?(?: or later)?)"),
    ("GPLVer:{v}", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the (?:gnu )?(?:general public license|gpl),? ?(?:version )?(?P<v>[123](?:\.\d)?(?: or later)?)"),
    ("GPLAnyVer", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the gnu (?:general public license|gpl)"),
    ("GPLModify:{v}", r"this (?:program|library|software) is free software[;:]? you can redistribute it and/or modify it under the terms of the gnu (?P<v>(?:lesser |library |affero )?general public license as published by the free software foundation[;,]? (?:either )?version [\d.]+(?: of the license)?(?:,? or \(?at your option\)? any later version)?)"),
    ("GPLNoWarranty", r"this (?:program|library|software) is distributed in the hope that it will be useful, but without any warranty[;:]? without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("GPLCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|software)(?:[;,]? if not, .*)?"),
    ("MPLSubject:{v}", r"this source code form is subject to the terms of the mozilla public license,? ?v\.? ?(?P<v>[12]\.[01])"),
    ("MPLVer:{v}", r"(?:licensed|released|distributed|available) under (?:the terms of )?the mozilla public license,? ?(?:version )?(?P<v>[12]\.[01])"),
    ("MPLCopy", r"if a copy of the mpl was not distributed with this file, you can obtain one at .*"),
    ("MITRef", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the (?:mit|expat)(?: \(mit\))? license"),
    ("MITPermission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction, .*subject to the following conditions"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", r"the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("MITLiability", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability, .*"),
    ("ISCPermission", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BSDRef:{v}", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the (?P<v>[234])-clause bsd license"),
    ("BSDRef:{v}", r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?the bsd (?P<v>[234])-clause license"),
    ("BSDPermitted", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", r"(?:\d\. ?|\* ?|- ?)?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", r"(?:\d\. ?|\* ?|- ?)?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDAdvertise", r"(?:\d\. ?|\* ?|- ?)?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("BSDEndorse", r"(?:\d\. ?|\* ?|- ?)?neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDAsIs", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties, .* are disclaimed"),
    ("BSDLiability", r"in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct, indirect, .*"),
    ("ZlibAsIs", r"this software is provided as-is, without any express or implied warranty"),
    ("ZlibLiability", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibPermission", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BoostVer", r"(?:licensed|released|distributed) under the boost software license,? version 1\.0"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("CC0", r"(?:.* )?(?:licensed|released|distributed|available|dedicated) (?:under|to the public domain under) (?:the )?(?:creative commons )?cc0(?: 1\.0(?: universal)?)?"),
    ("CC:{v}", r"(?:this (?:work|article|text|content) is )?(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons |cc )?(?P<v>(?:cc )?by(?:-(?:nc|sa|nd)){0,2} [1-4]\.0)(?: (?:international|unported))?(?: license)?"),
    ("CC:{v}", r"(?:this (?:work|article|text|content) is )?(?:licensed|released|distributed|available) under (?:a |the )?creative commons (?P<v>attribution(?:[- ](?:noncommercial|non-commercial|sharealike|share alike|noderiv(?:ative)?s)){0,2} [1-4]\.0)(?: (?:international|unported))?(?: license)?"),
    ("PublicDomain", r"this (?:work|file|software|text) (?:is|has been placed|has been released) (?:in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
]

# Licences by name, with what precedes their version in an identifier; and identifiers that stand for themselves.
NAMES = [
    ("eclipse public license", "EPL"), ("sil open font license", "OFL"), ("artistic license", "Artistic"), (r"common development and distribution license(?: \(cddl\))?", "CDDL"),
    (r"european union public license(?: \(eupl\))?", "EUPL"), ("academic free license", "AFL"), ("open software license", "OSL"), (r"open database license(?: \(odbl\))?", "ODbL"),
    (r"microsoft public license(?: \(ms-pl\))?", "MS-PL"), (r"do what the fuck you want to public license(?: \(wtfpl\))?", "WTFPL"), ("wtfpl", "WTFPL"), ("isc license", "ISC"),
    ("zlib license", "Zlib"), ("unlicense", "Unlicense"), ("python software foundation license", "PSF"), ("postgresql license", "PostgreSQL"), ("lppl|latex project public license", "LPPL"),
]
SHORT = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 "
    "CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL ODbL-1.0 OFL-1.1 OSL-3.0 Unlicense WTFPL Zlib"
).split()
_UNDER = r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?"
_LINE, _LINE_END = r"(?:\A|(?<=\n))", r"(?=\Z|\n|,)"
_VERSION = r",?(?: ?[-–])? ?(?:version )?(?P<v>\d(?:\.\d)?)"
SENTENCES += [(f"Named{short}:{{v}}", rf"{_UNDER}(?:{name})(?:{_VERSION})?") for name, short in NAMES]
SENTENCES += [(f"Named{short}:{{v}}", rf"{_LINE}(?:the )?(?:{name})(?:{_VERSION})?{_LINE_END}") for name, short in NAMES]
SENTENCES += [
    ("Short:{v}", rf"(?:{_UNDER}|license ?[:=] ?(?:the )?)(?P<v>{'|'.join(re.escape(i.lower()) for i in sorted(SHORT, key=len, reverse=True))})(?: license)?"),
    ("GPLTitle:{v}", rf"{_LINE}gnu (?P<v>(?:lesser |library |affero )?general public license version [\d.]*\d){_LINE_END}"),
    ("MITTitle", rf"{_LINE}(?:the )?mit license(?: \(mit\))?{_LINE_END}"),
    ("MPLTitle:{v}", rf"{_LINE}mozilla public license(?: \(mpl\))?,? ?(?:version )?(?P<v>[12]\.[01]){_LINE_END}"),
]
#: Words in front of a sentence that deny it, with up to two words between.
_DENIED = re.compile(r"\b(?:not|never|no longer|neither|isnt|arent|wasnt|cannot|rather than|instead of|other than|except)(?:\s\w+){0,2}\s?$")

# Rules, each an ordered run of identifiers (a final * takes any version) and the licence that it says.
RULES = [
    (("MITPermission", "MITNotice", "MITAsIs", "MITLiability"), "MIT"),
    (("MITPermission", "MITNotice", "MITAsIs"), "MIT"),
    (("ISCPermission", "ISCAsIs"), "ISC"),
    (("BSDPermitted", "BSDSource", "BSDBinary", "BSDAdvertise", "BSDEndorse", "BSDAsIs"), "BSD-4-Clause"),
    (("BSDPermitted", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDPermitted", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("ApacheVer:*", "ApacheMayNot", "ApacheCopyAt", "ApacheAsIs", "ApacheSee"), "Apache-{v}"),
    (("ApacheVer:*", "ApacheMayNot"), "Apache-{v}"),
    (("GPLModify:*", "GPLNoWarranty", "GPLSee", "GPLCopy"), "{gpl}"),
    (("GPLModify:*", "GPLNoWarranty"), "{gpl}"),
    (("MPLSubject:*", "MPLCopy"), "MPL-{v}"),
    (("ZlibAsIs", "ZlibLiability", "ZlibPermission"), "Zlib"),
    (("SPDX:*",), "{spdx}"),
    (("ApacheVer:*",), "Apache-{v}"),
    (("LGPLVer:*",), "LGPL-{v}"),
    (("AGPLVer:*",), "AGPL-{v}"),
    (("GPLVer:*",), "GPL-{v}"),
    (("GPLModify:*",), "{gpl}"),
    (("GPLAnyVer",), "GPL"),
    (("MPLSubject:*",), "MPL-{v}"),
    (("MPLVer:*",), "MPL-{v}"),
    (("MITRef",), "MIT"),
    (("MITPermission",), "MIT"),
    (("ISCPermission",), "ISC"),
    (("BSDRef:*",), "BSD-{v}-Clause"),
    (("BoostVer",), "BSL-1.0"),
    (("UnlicenseFree",), "Unlicense"),
    (("CC0",), "CC0-1.0"),
    (("CC:*",), "{cc}"),
    (("PublicDomain",), "Public-Domain"),
    (("GPLTitle:*",), "{gpl}"),
    (("MITTitle", "MITPermission", "MITNotice", "MITAsIs", "MITLiability"), "MIT"),
    (("MITTitle",), "MIT"),
    (("MPLTitle:*",), "MPL-{v}"),
    (("Short:*",), "{short}"),
    *(((f"Named{short}:*",), f"{short}-{{v}}") for short in dict.fromkeys(short for _, short in NAMES)),
]
_SHORT_OF = {i.lower(): i for i in SHORT}


def _searching(pattern: str, i: int) -> str:
    """A sentence's pattern for a search: any white space, names of its own for groups, and no more text than it needs."""
    p = re.sub(r" ?\.\*$", "", pattern.removeprefix("(?:.* )?")).replace(".*", ".*?")
    return p.replace(" ", r"\s").replace("(?P<v>", f"(?P<v{i}>")


#: All known sentences, the first in the list first; words may stand around them, as lines often lack a full stop.
_KNOWN = re.compile(r"(?<![^\s(*#/-])(?:" + "|".join(f"(?P<k{i}>{_searching(p, i)})" for i, (_, p) in enumerate(SENTENCES)) + r")(?![\w-]|\.\d)", re.S)
#: Sentences that end in any words: what follows them up to the next known sentence is theirs.
_OPEN = frozenset(name for name, pattern in SENTENCES if pattern.endswith((".*", ".*)?")))
_END = re.compile(r"(?<=[.!?])(?<! [vV]\.)\s+(?=\S)|(?<=[:;])[ \t]*\n|\n\s*\n|\n(?=\s*(?:\d\.|\*|-) )|(?<=[.!?])(?=[!*#&%$]+(?:\s|$))")
_COMMENT = re.compile(r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|<!--|dnl\b)[ \t]*|-->|\*+/")


def normalised(piece: str) -> str:
    """Lower case, one space, lines kept, plain quotes dropped, British spelling to American, `v2` to `version 2`, no final stop."""
    s = "\n".join(x for x in (" ".join(line.split()) for line in piece.lower().split("\n")) if x)
    s = re.sub(r"[\"'`“”‘’„«»]+", "", s).replace("licence", "license")
    s = re.sub(r"\bv\.?\s?(?=\d)", "version ", s) if not re.search(r"mozilla\spublic\slicense", s) else s
    return s.rstrip(" .;:,!?#*&%$|)\n").lstrip(" .;:,!?&%$|\n")


def pieces(text: str) -> list[str]:
    """Normalised pieces that may hold a licence sentence: cut at stops, blank lines and list items."""
    out = []
    for piece in _END.split(_COMMENT.sub("", text)):
        lower = piece.lower()
        if any(t in lower for t in SEARCHED):
            out.append(normalised(piece))
    return out


def identifiers(piece: str) -> tuple[list[str], int]:
    """Identifiers of the known sentences of a normalised piece in order (those that are denied say so and fit no rule), and how many licence-like lines are not known."""
    ids, unknown, at, theirs = [], 0, 0, False
    licence_like = lambda s: any(t in s for t in TRIGGERS)
    for found in _KNOWN.finditer(piece):
        unknown += 0 if theirs else sum(map(licence_like, piece[at : found.start()].split("\n")))
        i = next(i for i in range(len(SENTENCES)) if found[f"k{i}"] is not None)
        name = SENTENCES[i][0]
        if _DENIED.search(piece[at : found.start()]):
            name = "Denied:" + name.partition(":")[0]
        v = found.groupdict().get(f"v{i}") or ""
        ids.append(name.replace("{v}", " ".join(v.split()).rstrip(".")))
        at, theirs = found.end(), name in _OPEN
    if not ids:  # an unknown sentence is one, whatever its lines
        return ids, int(licence_like(" ".join(piece.split("\n"))))
    return ids, unknown + (0 if theirs else sum(map(licence_like, piece[at:].split("\n"))))


def _licence(says: str, ids: tuple[str, ...]) -> str:
    v = ids[0].partition(":")[2]
    version = v.replace(" or later", "+")
    if says == "{short}":
        return _SHORT_OF[v]
    if says == "{spdx}":
        return "SPDX:" + v
    if says == "{gpl}":
        kind = "LGPL" if re.match("lesser|library", v) else "AGPL" if v.startswith("affero") else "GPL"
        number = re.search(r"version ([\d.]+)", v)
        return f"{kind}-{_full(number[1].rstrip('.')) if number else ''}{'+' if 'any later' in v else ''}"
    if says == "{cc}":
        short = v.removeprefix("cc ")
        for long, abbreviation in (("attribution", "by"), ("non-commercial", "nc"), ("noncommercial", "nc"), ("share alike", "sa"), ("sharealike", "sa"), ("noderivatives", "nd"), ("noderivs", "nd")):
            short = short.replace(long, abbreviation)
        kind, _, number = short.rpartition(" ")
        return f"CC-{kind.replace(' ', '-').upper()}-{number}"
    return says.replace("{v}", version.rstrip("+") if says.startswith("BSD") else _full(version)).rstrip("-")


def _full(version: str) -> str:
    return re.sub(r"^(\d)(?=\+?$)", r"\1.0", version)


def licences(ids: list[str]) -> list[str]:
    """Licences of a sequence of identifiers: at each place the first rule, in order, that fits takes its run."""
    out, at = [], 0
    fits = lambda want, have: have.startswith(want[:-1]) if want.endswith("*") else have == want
    while at < len(ids):
        for run, says in RULES:
            own = tuple(ids[at : at + len(run)])
            if len(own) == len(run) and all(map(fits, run, own)):
                out.append(_licence(says, own))
                at += len(run)
                break
        else:
            at += 1
    return out


def scan(text: str | None) -> tuple[list[str], list[str], int]:
    """Licences (distinct, sorted), identifiers in order, and how many licence-like sentences are not known."""
    lower = (text or "").lower()
    if not any(t in lower for t in SEARCHED):
        return [], [], 0
    found = [identifiers(p) for p in pieces(text)]
    ids = [i for own, _ in found for i in own]
    return sorted(set(licences(ids))), ids, sum(n for _, n in found)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with licences, licence_sentences and n_unmatched; they replace columns of these names.

    Null and empty texts have none; rows are scanned one by one.
    """

    def add(batch: pa.RecordBatch) -> dict:
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        strings = pa.list_(pa.string())
        return {"licences": pa.array([r[0] for r in rows], strings), "licence_sentences": pa.array([r[1] for r in rows], strings), "n_unmatched": pa.array([r[2] for r in rows], pa.int64())}

    strings = T.ArrayType(T.StringType())
    return common.appended(docs, add, [T.StructField("licences", strings), T.StructField("licence_sentences", strings), T.StructField("n_unmatched", T.LongType())])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, licences and licence_sentences joined by commas, n_licences, n_unmatched) of every row of docs."""
    out = scanned(docs.select("doc_id", "text"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("licence_sentences", ",").alias("licence_sentences"), F.size("licences").cast("long").alias("n_licences"), "n_unmatched")
