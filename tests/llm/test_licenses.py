from pyspark.sql import functions as F

from verdigraph.llm import licenses

GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU Lesser General Public License as published by
 * the Free Software Foundation; either version 2.1 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU Lesser General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{endorse}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission."""
CASES = [
    ("words before\nReleased under the MIT License. Words after.", "MIT"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("LICENSED UNDER THE APACHE LICENCE, VERSION 2.0!!", "Apache-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;", "SPDX:apache-2.0 or mit"),
    (GPL, "LGPL-2.1+"),
    (BSD.format(endorse=""), "BSD-2-Clause"),
    (BSD.format(endorse=ENDORSE), "BSD-3-Clause"),
    ("Licensed under the GPL v2 or later. Released under the MIT License.", "GPL-2.0+,MIT"),
    ("All rights reserved.", ""),
    ("He lost his driving license.", ""),
    ("The mit of the license was not clear, released in spring.", ""),
    ("", ""),
    (None, ""),
    ("word " * 200_000 + "Released under the MIT License.", "MIT"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0]), (0, CASES[0][0])], "doc_id long, text string").withColumn("licences", F.lit("clash"))
    got = licenses.digest(df).collect()
    assert len(got) == len(CASES) + 2
    by_id = {r.doc_id: r for r in got}
    assert {i: by_id[i].licences for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert by_id[None].licences == "MIT" and by_id[10].n_unmatched == 1
    assert licenses.digest(df.limit(0)).collect() == []


def test_rules_are_ordered():
    ids = ["BSDPermitted", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs", "MITRef", "CC:by 4.0"]
    assert licenses.licences(ids) == ["BSD-3-Clause", "MIT", "CC-BY-4.0"]
    assert licenses.licences(["BSDSource", "GPLAnyVer"]) == ["GPL"]


def test_every_known_sentence_passes_the_gate():
    cases = {
        "Released under the GPL version 3.": ["GPL-3.0"],
        "Available under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "Distributed under CC0 1.0.": ["CC0-1.0"],
        "Available under CC\nBY 4.0.": ["CC-BY-4.0"],
        "Released under by-nc 3.0.": ["CC-BY-NC-3.0"],
        "Distributed under Creative Commons Attribution 4.0.": ["CC-BY-4.0"],
        "This text is in the public\ndomain.": ["Public-Domain"],
    }
    assert {t: licenses.scan(t)[0] for t in cases} == cases
    assert licenses.scan("If a copy of the MPL was not distributed with this file, you can obtain one at x.")[1] == ["MPLCopy"]
    assert licenses.scan("All rights reserved.")[1] == ["AllRights"]
    assert licenses.scan("Figure 2.0 went public.") == ([], [], 0)
    for name, pattern in licenses.SENTENCES:  # what a pattern always says, or each of its choices where it has some
        assert any(t in pattern for t in licenses.SEARCHED) or name in ("GPLAnyVer", "CC:{v}", "SPDX:{v}"), name


def test_all_sentences_of_a_piece_count():
    mit = "Licensed under the MIT License\nReleased under the Apache License, Version 2.0"
    assert licenses.scan(mit) == (["Apache-2.0", "MIT"], ["MITRef", "ApacheVer:2.0"], 0)
    spdx = "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0"
    assert licenses.scan(spdx)[1] == ["SPDX:mit", "SPDX:apache-2.0"]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    assert licenses.scan(apache) == (["Apache-2.0"], ["ApacheVer:2.0", "ApacheMayNot"], 0)
    assert licenses.scan("Released under the\nMIT License\nSee the licence folder")[::2] == (["MIT"], 1)
    assert licenses.scan("Copyright Someone\nReleased under the MIT License")[::2] == (["MIT"], 1)
    assert licenses.scan("You may obtain a copy of the License at x/licenses/y\nLicensed under CC BY 4.0")[::2] == (["CC-BY-4.0"], 0)


def brute(text):
    """What a sentence of the usual form says, word by word."""
    words = text.lower().rstrip(".").split()
    if any(w in ("not", "never", "isn't") for w in words):
        return []
    names = {
        "eclipse public license": "EPL", "sil open font license": "OFL", "artistic license": "Artistic", "common development and distribution license": "CDDL", "european union public license": "EUPL",
        "do what fuck you want to public license": "WTFPL", "isc license": "ISC", "zlib license": "Zlib", "mit license": "MIT", "apache license": "Apache", "mozilla public license": "MPL",
        "gnu general public license": "GPL", "gnu lesser general public license": "LGPL",
    }
    at = words.index("under") + 1 if "under" in words else 0
    rest = [w for w in words[at:] if w not in ("the", "terms", "of", "version")]
    version = rest.pop() if rest[-1][0].isdigit() else ""
    short = names.get(" ".join(rest))
    return [f"{short}-{version}" if version else short] if short else []


def test_references_against_a_plain_reading():
    for name in ("Eclipse Public License", "SIL Open Font License", "Artistic License", "Common Development and Distribution License", "European Union Public License", "Apache License", "Mozilla Public License", "GNU General Public License", "GNU Lesser General Public License"):
        for verb in ("Licensed", "This work is released", "This file is not licensed", "Never distributed", "It isn't licensed"):
            for version in ("2.0", "1.1"):
                if name.startswith("GNU") and version == "1.1":  # there is no such version
                    continue
                text = f"{verb} under the {name}, version {version}."
                assert licenses.scan(text)[0] == brute(text.replace(",", "")), text
    for name in ("ISC License", "Zlib License", "MIT License", "Do What The Fuck You Want To Public License"):
        for verb in ("Licensed", "This work is released", "This file is not licensed"):
            text = f"{verb} under the {name}."
            assert licenses.scan(text)[0] == brute(text), text


def test_titles_short_forms_and_denials():
    cases = {
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n": ["GPL-3.0"],
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": ["AGPL-3.0"],
        "Eclipse Public License - v 2.0": ["EPL-2.0"],
        "SIL OPEN FONT LICENSE Version 1.1": ["OFL-1.1"],
        "The Artistic License 2.0": ["Artistic-2.0"],
        "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0": ["CDDL-1.0"],
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2": ["WTFPL-2.0"],
        "European Union Public Licence v. 1.2": ["EUPL-1.2"],
        "Mozilla Public License Version 2.0": ["MPL-2.0"],
        "MIT License\n\nCopyright (c) 2020": ["MIT"],
        "License: ISC": ["ISC"],
        "license = MIT-0": ["MIT-0"],
        "Licensed under BSD-3-Clause.": ["BSD-3-Clause"],
        "Released under GPL-2.0-or-later.": ["GPL-2.0-or-later"],
        "Not licensed under the MIT License.": [],
        "This project is no longer released under the Apache License, Version 2.0.": [],
        "Not a toy. Licensed under the MIT License.": ["MIT"],
        "It is licensed under the ISC License rather than licensed under the MIT License.": ["ISC"],
        "He read about the MIT License program in the paper.": [],
    }
    assert {t: licenses.scan(t)[0] for t in cases} == cases
    assert licenses.scan("Not licensed under the MIT License.")[1] == ["Denied:MITRef"]
    assert {licenses.scan(f"License: {i}")[0][0] for i in licenses.SHORT} == set(licenses.SHORT)
