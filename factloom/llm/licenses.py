"""Licence scans by ordered signature rules.

Each licence has hand-written signatures (grants, titles, notices, sentences of
its text) and the common ways to name it (a tag, a statement that something is licensed under it,
a metadata field, a link). A rule is tried only on texts that hold its keyword.
Detections are resolved in order of priority, then length: one that lies inside
an accepted one of at least its priority is suppressed.

The base phrases are found on the words of the text, whatever stands between
them; they are never suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import textkit as tk

#: Phrases of words and their labels that every scan reports.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, how its name is written, and signatures of its own texts.
LICENSES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", r"(?:mit|expat|x11)", (r"permission is hereby granted, free of charge, to any person obtaining a copy", r"the above copyright notice and this permission notice shall be included in all copies", r"mit[ -]style licen[sc]e")),
    ("mit-0", r"mit[ -]?(?:0|no attribution)", (r"mit no attribution",)),
    ("apache-2", r"apache(?: software)?(?: licen[sc]e)?[, -]*(?:version |v)?2(?:\.0)?", (r"apache software foundation \(asf\) under one or more contributor", r"you may not use this file except in compliance with the license", r"www\.apache\.org/licenses/license-2\.0")),
    ("apache-1.1", r"apache(?: software)?(?: licen[sc]e)?[, -]*(?:version |v)?1\.1", (r"this product includes software developed by the apache software foundation",)),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public licen[sc]e)[, -]*(?:version |v)?2(?:\.0)?(?:[ -](?:only|or[ -]later))?", (r"either version 2 of the license, or", r"version 2, june 1991")),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public licen[sc]e)[, -]*(?:version |v)?3(?:\.0)?(?:[ -](?:only|or[ -]later))?", (r"either version 3 of the license, or", r"version 3, 29 june 2007")),
    ("gpl", r"(?:gnu )?(?:gpl|general public licen[sc]e)", (r"gnu general public licen[sc]e", r"this program is free software[:;,] you can redistribute it", r"gpl[ -]compatible")),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)[, -]*(?:version |v)?2\.1", (r"version 2\.1, february 1999",)),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)[, -]*(?:version |v)?3(?:\.0)?", ()),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", (r"gnu (?:lesser|library) general public licen[sc]e",)),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)[, -]*(?:version |v)?3(?:\.0)?", (r"version 3, 19 november 2007",)),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)", (r"gnu affero general public licen[sc]e",)),
    ("bsd-2", r"(?:bsd[ -]2(?:[ -]clause)?|(?:2|two)[ -]clause bsd|simplified bsd|freebsd)", (r"redistribution and use in source and binary forms, with or without modification",)),
    ("bsd-3", r"(?:bsd[ -]3(?:[ -]clause)?|(?:3|three)[ -]clause bsd|(?:new|modified|revised) bsd)", (r"neither the name of .{1,80} nor the names of its contributors",)),
    ("bsd-4", r"(?:bsd[ -]4(?:[ -]clause)?|(?:4|four)[ -]clause bsd|original bsd)", (r"all advertising materials mentioning features or use of this software",)),
    ("0bsd", r"(?:0bsd|bsd[ -]0(?:[ -]clause)?|zero[ -]clause bsd)", ()),
    ("bsd", r"bsd", (r"bsd[ -]style licen[sc]e",)),
    ("isc", r"isc", (r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee",)),
    ("mpl-1.1", r"(?:mozilla public licen[sc]e|mpl)[, -]*(?:version |v)?1\.1", (r"www\.mozilla\.org/mpl/1\.1",)),
    ("mpl-2", r"(?:mozilla public licen[sc]e|mpl)[, -]*(?:version |v)?2(?:\.0)?", (r"this source code form is subject to the terms of the mozilla public license", r"mozilla\.org/mpl/2\.0")),
    ("epl-1", r"(?:eclipse public licen[sc]e|epl)[, -]*(?:version |v)?1(?:\.0)?", (r"eclipse\.org/legal/epl-v10",)),
    ("epl-2", r"(?:eclipse public licen[sc]e|epl)[, -]*(?:version |v)?2(?:\.0)?", (r"eclipse\.org/legal/epl-2\.0",)),
    ("cddl-1", r"(?:common development and distribution licen[sc]e|cddl)(?:[, -]*(?:version |v)?1(?:\.[01])?)?", (r"common development and distribution license",)),
    ("eupl-1.2", r"(?:european union public licen[sc]e|eupl)(?:[, -]*(?:version |v)?1\.[12])?", (r"european union public licen[sc]e",)),
    ("artistic-2", r"artistic(?: licen[sc]e)?[, -]*(?:version |v)?2(?:\.0)?", (r"the artistic license 2\.0",)),
    ("artistic-1", r"artistic(?: licen[sc]e)?[, -]*(?:version |v)?1(?:\.0)?", ()),
    ("boost-1", r"(?:boost software|boost|bsl)(?: licen[sc]e)?[, -]*(?:version |v)?1(?:\.0)?", (r"boost software license - version 1\.0",)),
    ("zlib", r"zlib(?:/libpng)?", (r"the origin of this software must not be misrepresented",)),
    ("unlicense", r"(?:the )?unlicen[sc]e", (r"this is free and unencumbered software released into the public domain",)),
    ("wtfpl", r"(?:wtfpl|do what the f[a-z*]{3} you want to public licen[sc]e)", (r"do what the f[a-z*]{3} you want to public licen[sc]e",)),
    ("cc0-1", r"cc[ -]?0(?:[ -](?:1\.0|universal))*", (r"creative commons zero", r"creativecommons\.org/publicdomain/zero", r"cc0 1\.0 universal")),
    ("cc-by-nc-nd", r"cc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.0)?", (r"attribution[ -]non-?commercial[ -]no[ -]?deriv(?:ative)?s", r"creativecommons\.org/licenses/by-nc-nd")),
    ("cc-by-nc-sa", r"cc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.0)?", (r"attribution[ -]non-?commercial[ -]share[ -]?alike", r"creativecommons\.org/licenses/by-nc-sa")),
    ("cc-by-nc", r"cc[ -]by[ -]nc(?:[ -][1-4]\.0)?", (r"attribution[ -]non-?commercial", r"creativecommons\.org/licenses/by-nc")),
    ("cc-by-nd", r"cc[ -]by[ -]nd(?:[ -][1-4]\.0)?", (r"attribution[ -]no[ -]?deriv(?:ative)?s", r"creativecommons\.org/licenses/by-nd")),
    ("cc-by-sa", r"cc[ -]by[ -]sa(?:[ -][1-4]\.0)?", (r"attribution[ -]share[ -]?alike", r"creativecommons\.org/licenses/by-sa")),
    ("cc-by", r"cc[ -]by(?:[ -][1-4]\.0)?", (r"creative commons attribution", r"creativecommons\.org/licenses/by/")),
    ("odbl-1", r"(?:open database licen[sc]e|odbl)(?:[, -]*(?:version |v)?1(?:\.0)?)?", (r"opendatacommons\.org/licenses/odbl",)),
    ("ofl-1.1", r"(?:sil )?(?:open font licen[sc]e|ofl)(?:[, -]*(?:version |v)?1\.1)?", (r"sil open font license",)),
    ("python-2", r"(?:python software foundation(?: licen[sc]e)?|psf)(?:[, -]*(?:version |v)?2(?:\.0)?)?", (r"psf is making python available to licensee",)),
    ("openssl", r"openssl", (r"developed by the openssl project",)),
    ("postgresql", r"postgresql", (r"postgresql global development group",)),
    ("ms-pl", r"(?:microsoft public licen[sc]e|ms[ -]pl)", (r"microsoft public licen[sc]e",)),
    ("gfdl", r"(?:gnu )?(?:fdl|gfdl|free documentation licen[sc]e)", (r"gnu free documentation licen[sc]e",)),
    ("elastic-2", r"elastic(?: licen[sc]e)?[, -]*(?:version |v)?2(?:\.0)?", ()),
    ("sspl-1", r"(?:server side public licen[sc]e|sspl)(?:[, -]*(?:version |v)?1)?", (r"server side public licen[sc]e",)),
    ("proprietary", r"(?:proprietary|commercial)", (r"all rights reserved\.? (?:unauthorized|no part)", r"proprietary and confidential")),
    ("public-domain", r"public domain", (r"released (?:in)?to the public domain", r"dedicated to the public domain")),
)

#: More signatures: sentences of the licences' own texts, of their notices and of common grants.
TEXTS: dict[str, tuple[str, ...]] = {
    "mit": (
        r"to deal in the software without restriction, including without limitation the rights",
        r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software",
        r"the software is provided [\"']as is[\"'], without warranty of any kind, express or implied",
        r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability",
        r"opensource\.org/licenses/mit-license",
        r"dual[ -]licensed under (?:the )?mit",
    ),
    "mit-0": (r"permission is hereby granted, free of charge, .{1,200} to whom the software is furnished to do so\.\s{1,4}the software is provided",),
    "apache-2": (
        r"terms and conditions for use, reproduction, and distribution",
        r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
        r"unless required by applicable law or agreed to in writing, software distributed under the license",
        r"you must give any other recipients of the work or derivative works a copy of this license",
        r"you must cause any modified files to carry prominent notices stating that you changed the files",
        r"see the notice file distributed with this work for additional information",
        r"the asf licenses this file to you under the apache license",
        r"apache license, version 2\.0",
    ),
    "apache-1.1": (r"the apache software license, version 1\.1", r"the names [\"']apache[\"'] and [\"']apache software foundation[\"'] must not be used", r"products derived from this software may not be called [\"']apache[\"']"),
    "gpl-2": (
        r"gnu general public license as published by the free software foundation; version 2",
        r"51 franklin street, fifth floor, boston, ma 02110-1301",
        r"59 temple place,? (?:-|suite) ?330, boston, ma 02111-1307",
        r"this general public license does not permit incorporating your program into proprietary programs",
        r"you may copy and distribute verbatim copies of the program's source code as you receive it",
        r"activities other than copying, distribution and modification are not covered by this license",
    ),
    "gpl-3": (
        r"the gnu general public license is a free, copyleft license for software and other kinds of works",
        r"you may convey verbatim copies of the program's source code as you receive it",
        r"a [\"']user product[\"'] is either \(1\) a [\"']consumer product[\"']",
        r"no covered work shall be deemed part of an effective technological measure",
    ),
    "gpl": (
        r"but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license",
        r"you should have received a copy of the gnu general public license along with this program",
        r"www\.gnu\.org/(?:copyleft|licenses)/gpl",
        r"special exception to the gpl",
        r"classpath exception",
        r"gpl[ -]licensed",
    ),
    "lgpl-2.1": (
        r"this is the first released version of the lesser gpl",
        r"either version 2\.1 of the license, or \(at your option\) any later version",
        r"the lesser general public license, applies to some specially designated software packages",
        r"a program that contains no derivative of any portion of the library, but is designed to work with the library",
    ),
    "lgpl-3": (
        r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3",
        r"as used herein, [\"']this license[\"'] refers to version 3 of the gnu lesser general public license",
        r"conveying modified versions\. if you modify a copy of the library",
    ),
    "lgpl": (r"you should have received a copy of the gnu lesser general public license", r"www\.gnu\.org/(?:copyleft|licenses)/lgpl", r"terms of the gnu library general public license"),
    "agpl-3": (
        r"specifically designed to ensure cooperation with the community in the case of network server software",
        r"all users interacting with it remotely through a computer network",
        r"remote network interaction; use with the gnu general public license",
    ),
    "agpl": (r"you should have received a copy of the gnu affero general public license", r"www\.gnu\.org/licenses/agpl", r"affero general public license for more details"),
    "bsd-2": (r"1\. redistributions of source code must retain the above copyright notice, this list of conditions", r"2\. redistributions in binary form must reproduce the above copyright notice", r"opensource\.org/licenses/bsd-2-clause"),
    "bsd-3": (r"may be used to endorse or promote products derived from this software without specific prior written permission", r"3\. neither the name of the copyright holder nor", r"opensource\.org/licenses/bsd-3-clause", r"the name of the author may not be used to endorse or promote products"),
    "bsd-4": (r"must display the following acknowledgement", r"this product includes software developed by the university of california, berkeley"),
    "0bsd": (r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.", r"free public license 1\.0\.0", r"opensource\.org/licenses/0bsd"),
    "bsd": (r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) [\"']as is[\"']", r"use of this source code is governed by a bsd-style license", r"the regents of the university of california\. all rights reserved"),
    "isc": (r"provided that the above copyright notice and this permission notice appear in all copies", r"the author disclaims all warranties with regard to this software", r"internet systems consortium disclaims all warranties", r"opensource\.org/licenses/isc"),
    "mpl-1.1": (r"the contents of this file are subject to the mozilla public license version 1\.1", r"the initial developer of the original code is", r"alternatively, the contents of this file may be used under the terms of either"),
    "mpl-2": (r"if a copy of the mpl was not distributed with this file, you can obtain one at", r"exhibit b - [\"']incompatible with secondary licenses[\"'] notice", r"this source code form is [\"']incompatible with secondary licenses[\"']", r"mozilla public license version 2\.0"),
    "epl-1": (r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0", r"eclipse public license - v 1\.0", r"accompanying program is provided under the terms of this eclipse public license"),
    "epl-2": (r"eclipse public license - v 2\.0", r"this source code may also be made available under the following secondary licenses", r"which is available at https?://www\.eclipse\.org/legal/epl-2\.0"),
    "cddl-1": (r"when distributing covered (?:software|code), include this cddl header notice", r"usr/src/opensolaris\.license", r"the contents of this file are subject to the terms of the common development"),
    "eupl-1.2": (r"licensed under the eupl", r"joinup\.ec\.europa\.eu/(?:software/page|collection)/eupl", r"this european union public licence \(the [\"']eupl[\"']\) applies"),
    "artistic-2": (r"this license establishes the terms under which a given free software package may be copied, modified, distributed", r"www\.perlfoundation\.org/artistic_license_2_0"),
    "artistic-1": (r"the intent of this document is to state the conditions under which a package may be copied", r"such that the copyright holder maintains some semblance of artistic control", r"under the same terms as perl itself"),
    "boost-1": (r"distributed under the boost software license, version 1\.0", r"www\.boost\.org/license_1_0\.txt", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", r"unless such copies or derivative works are solely in the form of machine-executable object code"),
    "zlib": (r"this software is provided 'as-is', without any express or implied warranty", r"altered source versions must be plainly marked as such", r"this notice may not be removed or altered from any source distribution", r"jean-loup gailly and mark adler"),
    "unlicense": (r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate", r"(?:www\.)?unlicense\.org"),
    "wtfpl": (r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", r"0\. you just do what the f[a-z*]{3} you want to", r"www\.wtfpl\.net"),
    "cc0-1": (r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives", r"to the extent possible under law, .{1,100} has waived all copyright and related or neighboring rights", r"no copyright: the person who associated a work with this deed"),
    "cc-by-nc-nd": (r"you may not use the material for commercial purposes, and if you remix, transform, or build upon the material, you may not distribute", r"namensnennung[ -]+nicht[ -]?kommerziell[ -]+keine[ -]bearbeitung(?:en)?"),
    "cc-by-nc-sa": (r"namensnennung[ -]+nicht[ -]?kommerziell[ -]+weitergabe unter gleichen bedingungen", r"attribution, non-?commercial, share[ -]?alike"),
    "cc-by-nc": (r"you may not use the material for commercial purposes", r"primarily intended for or directed toward(?:s)? commercial advantage or monetary compensation", r"namensnennung[ -]+nicht[ -]?kommerziell"),
    "cc-by-nd": (r"if you remix, transform, or build upon the material, you may not distribute the modified material", r"produce and reproduce, but not share, adapted material"),
    "cc-by-sa": (r"you must distribute your contributions under the same license as the original", r"text is available under the creative commons attribution-sharealike", r"the adapter's license you apply must be a creative commons license with the same license elements"),
    "cc-by": (r"you must give appropriate credit, provide a link to the license, and indicate if changes were made", r"creative commons attribution [1-4]\.0 international", r"by exercising the licensed rights \(defined below\), you accept and agree", r"some rights reserved\.? creative commons"),
    "odbl-1": (r"any use of this database must be attributed to", r"this .{1,60} is made available under the open database license", r"any rights in individual contents of the database are licensed under the database contents license", r"openstreetmap contributors"),
    "ofl-1.1": (r"this font software is licensed under the sil open font license", r"the goals of the open font license \(ofl\) are to stimulate worldwide development", r"scripts\.sil\.org/ofl", r"neither the font software nor any of its individual components, in original or modified versions, may be sold by itself", r"with reserved font name"),
    "python-2": (r"python software foundation license version 2", r"this license agreement is between the python software foundation", r"beopen python open source license agreement", r"cwi license agreement for python"),
    "openssl": (r"the names [\"']openssl toolkit[\"'] and [\"']openssl project[\"'] must not be used", r"this product includes cryptographic software written by eric young", r"original ssleay license"),
    "postgresql": (r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement", r"in no event shall the university of california be liable to any party for direct, indirect, special"),
    "ms-pl": (r"this license governs use of the accompanying software\. if you use the software, you accept this license", r"no trademark license- this license does not grant you rights to use any contributors' name", r"opensource\.org/licenses/ms-pl"),
    "gfdl": (r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", r"with no invariant sections, no front-cover texts,? and no back-cover texts", r"www\.gnu\.org/(?:copyleft|licenses)/fdl", r"the [\"']invariant sections[\"'] are certain secondary sections"),
    "elastic-2": (r"you may not provide the software to third parties as a hosted or managed service", r"you may not move, change, disable, or circumvent the license key functionality", r"www\.elastic\.co/licensing/elastic-license", r"by using the software, you agree to all of the terms and conditions below\. copyright license the licensor grants"),
    "sspl-1": (r"if you make the functionality of the program or a modified version available to third parties as a service", r"www\.mongodb\.com/licensing/server-side-public-license", r"making the service source code available"),
    "proprietary": (
        r"this software is the confidential and proprietary information of",
        r"may not be copied, reproduced, distributed,? or (?:disclosed|transmitted) without (?:the )?(?:express |prior )*written (?:permission|consent)",
        r"unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|material|document)",
        r"no part of this (?:publication|book|document|website) may be reproduced",
        r"you may not (?:copy, modify|reverse engineer, decompile|sublicense, rent, lease)",
        r"trade secrets? of .{1,60} and (?:is|are) protected by (?:copyright|trade secret) law",
        r"internal use only\. do not (?:distribute|redistribute)",
        r"end[ -]user licen[sc]e agreement",
    ),
    "public-domain": (r"this (?:file|work|code|software|article|text) is (?:hereby )?(?:placed )?in the public domain", r"has been (?:placed|put) in(?:to)? the public domain", r"the author (?:hereby )?disclaims copyright to this (?:source code|work)", r"no copyright is claimed", r"a work of the u(?:nited )?\.?s(?:tates)?\.? government and is not subject to copyright"),
    "artistic-gpl": (r"under the terms of either: a\) the gnu general public license .{1,120} artistic license", r"either the gpl or the artistic license"),
    "afl-3": (r"academic free licen[sc]e,? (?:version |v)?\.? ?3\.0", r"licensed under the academic free license"),
    "osl-3": (r"open software licen[sc]e,? (?:version |v)?\.? ?3\.0", r"licensed under the open software license"),
    "upl-1": (r"universal permissive licen[sc]e,? (?:version |v)?1\.0", r"oss\.oracle\.com/licenses/upl"),
    "bsl-1.1": (r"business source licen[sc]e 1\.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", r"change date: .{1,40} change license:"),
    "ncsa": (r"university of illinois/ncsa open source licen[sc]e", r"to deal with the software without restriction, including"),
    "vim": (r"vim licen[sc]e", r"you must make your changes available to the maintainer of vim"),
    "ruby": (r"you can redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl)", r"ruby's licen[sc]e"),
    "php-3": (r"the php licen[sc]e, version 3\.0[01]?", r"this product includes php software, freely available from"),
    "w3c": (r"w3c(?:\(r\)|®)? software (?:notice and licen[sc]e|and document notice and licen[sc]e)", r"w3\.org/consortium/legal/(?:copyright-software|copyright-documents|2015/copyright-software)"),
    "unicode": (r"unicode,? inc\. licen[sc]e agreement", r"unicode data files and software"),
    "ecl-2": (r"educational community licen[sc]e,? (?:version |v)?2\.0",),
    "blueoak-1": (r"blue oak model licen[sc]e", r"this license gives everyone as much permission to work with this software as possible"),
    "cecill-2": (r"cecill (?:free software )?licen[sc]e", r"ce logiciel est r[eé]gi par la licence cecill", r"this software is governed by the cecill"),
    "openrail": (r"(?:bigscience|creativeml|bigcode) open ?rail(?:-m|\+\+-m|\+\+)?", r"use-based restrictions as referenced in paragraph 5"),
    "llama": (r"llama [234](?:\.[0-9])? community license", r"built with (?:meta )?llama [234]"),
    "ogl-uk-3": (r"open government licen[sc]e(?: v| version )?3\.0", r"contains public sector information licensed under the open government licence"),
    "etalab-2": (r"licence ouverte ?/ ?open licen[sc]e", r"etalab[ -]2\.0"),
    "dl-de-by-2": (r"datenlizenz deutschland[ –-]+(?:namensnennung|zero)", r"www\.govdata\.de/dl-de"),
    "cdla": (r"community data licen[sc]e agreement[ –-]+(?:permissive|sharing)", r"cdla\.dev/(?:permissive|sharing)"),
    "pddl-1": (r"open data commons public domain dedication", r"opendatacommons\.org/licenses/pddl"),
    "gpl-2-linux": (r"linux kernel enforcement statement", r"this copyright does \*not\* cover user programs that use kernel services"),
}

#: Ways to name a licence: pattern around the name, priority, confidence, keyword.
WAYS = (
    (r"spdx-license-identifier:\s{{0,4}}{}(?![\w.-])", 90, 1.0, "spdx-license-identifier"),
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|shared)(?: to you)?\s{{1,4}}under\s{{1,4}}(?:the\s{{1,4}})?(?:terms\s{{1,4}}of\s{{1,4}})?(?:the\s{{1,4}}|an?\s{{1,4}})?{}(?![\w-])", 80, 0.95, "under"),
    (r"[\"']?licen[sc]e[\"']?\s{{0,4}}[=:]\s{{0,4}}[\"']?{}(?![\w-])", 70, 0.9, "licen"),
    (r"(?<![\w-]){}\s{{1,4}}licen[sc]e(?![\w-])", 60, 0.8, "licen"),
    (r"(?:opensource\.org/licenses?|spdx\.org/licenses|choosealicense\.com/licenses)/{}(?![\w-])", 75, 0.95, "license"),
)
SIGNATURE = (65, 0.9)


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


def _longest_literal(pattern: str) -> str:
    """The longest run of plain characters that every match holds, or nothing."""
    plain = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)[?*+]?|\[[^\]]*\][?*+]?|\{[^}]*\}|\\?.\?|\\[wsd.]|\.", "\0", pattern)
    return re.sub(r"\\([()*+])", r"\1", max(plain.split("\0"), key=len, default=""))


def rules() -> list[Rule]:
    """All rules, the highest priority first."""
    out = []
    for label, name, texts in LICENSES:
        for way, priority, confidence, keyword in WAYS:
            out.append(Rule(label, priority, confidence, keyword, re.compile(way.format(name))))
        for text in texts:
            out.append(Rule(label, *SIGNATURE, _longest_literal(text), re.compile(text)))
    for label, texts in TEXTS.items():
        for text in texts:
            out.append(Rule(label, *SIGNATURE, _longest_literal(text), re.compile(text)))
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


#: Line ends and tabs are read as blanks, so a sentence may go on in the next line.
_BLANKS = {c: 0x20 for c in b"\t\n\v\f\r"}
_BLANK_BYTES = bytes(_BLANKS.get(c, c) for c in range(256))


class Keywords:
    """All rules' keywords in one automaton: a text is read once to find which rules can match it."""

    def __init__(self, ordered: list[Rule]) -> None:
        self.always = [i for i, r in enumerate(ordered) if not r.keyword]
        of: dict[str, list[int]] = {}
        for i, r in enumerate(ordered):
            if r.keyword:
                of.setdefault(r.keyword.encode().decode("latin-1"), []).append(i)
        self.rules_of = list(of.values())
        self.automaton = ahocorasick.Automaton()
        for k, word in enumerate(of):
            self.automaton.add_word(word, k)
        self.automaton.make_automaton()

    def rules_in(self, data: bytes, offsets: np.ndarray) -> list[list[int]]:
        """For each text of the bytes, the rules whose keyword stands in it (one that begins in the text before counts too), in order."""
        some: list[set[int]] = [set() for _ in offsets[1:]]
        ends = offsets[1:].tolist()
        for at, k in self.automaton.iter(data.decode("latin-1")):  # a character for each byte
            some[bisect.bisect_right(ends, at)].add(k)
        return [sorted([*self.always, *(i for k in ks for i in self.rules_of[k])]) if ks else self.always for ks in some]


def detect(text: str, ordered: list[Rule]) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, priority, confidence) of the detections of these rules in lower-cased text that stand."""
    text = text.translate(_BLANKS)
    found = [(r.label, m.start(), m.end(), r.priority, r.confidence) for r in ordered if r.keyword in text for m in r.pattern.finditer(text)]
    stands, starts, ends = [], [], []  # starts and ends: of the accepted that lie in no other, both ascending
    for x in sorted(found, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
        i = bisect.bisect_right(starts, x[1])
        if i and ends[i - 1] >= x[2]:
            continue
        stands.append(x)
        i = bisect.bisect_left(starts, x[1])
        j = bisect.bisect_right(ends, x[2])
        starts[i : max(i, j)], ends[i : max(i, j)] = [x[1]], [x[2]]
    return sorted(stands, key=lambda x: (x[1], x[2], x[0]))


def _base_places(w: tk.Words, phrase: str) -> np.ndarray:
    """First words of the phrase's places."""
    buf, offsets = tk.arrays(pa.array([phrase.encode()], pa.binary()))
    p = tk.Words(buf, offsets, tk.NON_ALNUM, lower=True)
    at, h = w.runs(len(p))
    at = at[h == p.runs(len(p))[1][0]]
    words = p.text(0, len(p))
    return np.array([i for i in at if w.text(i, i + len(p)) == words], np.int64)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections array<struct<label:string,start:long,end:long,priority:int,confidence:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (smallest and largest start in words, else null),
    base_labels (distinct, sorted), detections of the rules that stand (places
    in characters of the text with A-Z in lower case) and the carried columns
    in struct ``row``.

    A null or empty text has no words and no detections. Rows are judged one by
    one. A task holds a few MB of text, or one document, at a time.
    """
    rows = tk.narrow(docs, id_col, text_col, carry)
    names = ("doc_id", "row")

    @tk.tidy
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        keywords = Keywords(ordered)
        for rows, buf, offsets in tk.pieces(batches, "text"):
            w = tk.Words(buf, offsets, tk.NON_ALNUM, lower=True)
            places = [_base_places(w, phrase) for phrase, _ in BASE]
            n_base, low, high = np.zeros(w.docs, np.int64), np.full(w.docs, np.iinfo(np.int64).max), np.full(w.docs, -1)
            labels: list[set[str]] = [set() for _ in range(w.docs)]
            of = w.doc
            for at, (_, label) in zip(places, BASE, strict=True):
                d = of[at]
                np.add.at(n_base, d, 1)
                np.minimum.at(low, d, at - w.first[d])
                np.maximum.at(high, d, at - w.first[d])
                for i in set(d.tolist()):
                    labels[i].add(label)
            raw = w.buf.tobytes().translate(_BLANK_BYTES)
            detections = []
            for i, j, able in zip(offsets[:-1], offsets[1:], keywords.rules_in(raw, offsets), strict=True):
                detections.append(detect(raw[i:j].decode("utf-8", "replace"), [ordered[k] for k in able]) if able else [])
            none = n_base == 0
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]))
            yield tk.batch(
                rows, names, n_words=pa.array(w.counts.astype(np.int64)), n_base=pa.array(n_base), first_word=pa.array(low, mask=none), last_word=pa.array(high, mask=none),
                base_labels=pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                detections=pa.array([[dict(zip(("label", "start", "end", "priority", "confidence"), x, strict=True)) for x in d] for d in detections], kind),
            )

    return rows.mapInArrow(found, tk.schema_of(rows, names, RESULT))
