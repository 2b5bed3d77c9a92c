"""License scans by ordered signature rules, in DataFrame functions only.

A text that has no licensing keyword is passed over. In the others every anchor word (license, copyright,
permission, warranties ...) gets as many words of context as the longest rule for such an anchor can
take. To that context the anchor's rules are put: a rule's own keyword comes first, its regular
expression after. Detections are intervals of words; one that lies within another of higher priority (or
of equal priority and greater length) is dropped.

Rules are signatures of license texts, notices and abbreviations written out one by one, and families of
names, each in several forms.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.text import let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All of ASCII but letters, digits and the space itself.
BETWEEN = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and i != 32)

# License families, as label, keyword, and the words that name it (a regular expression).
FAMILIES = [
    ("mit", "mit", "(?:mit|expat)"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("x11", "x11", "x11"),
    ("apache", "apache", "apache(?: software)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version)? (?:2 0|2|v2)"),
    ("gpl", "general", "(?:gnu )?general public"),
    ("gpl-2.0", "2", "(?:gnu )?(?:general public(?: license)?|gpl)(?: version)? (?:2|v2|2 0)"),
    ("gpl-3.0", "3", "(?:gnu )?(?:general public(?: license)?|gpl)(?: version)? (?:3|v3|3 0)"),
    ("lgpl", "lesser", "(?:gnu )?(?:lesser|library) general public"),
    ("lgpl-2.1", "2", "(?:gnu )?(?:lesser general public(?: license)?|lgpl)(?: version)? (?:2 1|v2 1)"),
    ("lgpl-3.0", "3", "(?:gnu )?(?:lesser general public(?: license)?|lgpl)(?: version)? (?:3|v3|3 0)"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl-3.0", "3", "(?:gnu )?(?:affero general public(?: license)?|agpl)(?: version)? (?:3|v3|3 0)"),
    ("fdl", "documentation", "(?:gnu )?free documentation"),
    ("bsd", "bsd", "bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd|2 clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|original bsd|4 clause bsd)"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl-1.1", "1", "(?:mozilla public(?: license)?|mpl)(?: version)? 1 1"),
    ("mpl-2.0", "2", "(?:mozilla public(?: license)?|mpl)(?: version)? 2 0"),
    ("epl", "eclipse", "eclipse public"),
    ("epl-2.0", "2", "(?:eclipse public(?: license)?|epl)(?: version| v)? 2 0"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("eupl", "european", "european union public"),
    ("artistic-2.0", "artistic", "artistic(?: license)?(?: version)? 2 0"),
    ("artistic", "artistic", "artistic"),
    ("boost", "boost", "boost software"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("openssl", "openssl", "openssl"),
    ("python", "python", "python software foundation"),
    ("postgresql", "postgresql", "postgresql"),
    ("ofl", "font", "(?:sil )?open font"),
    ("odbl", "database", "open (?:data commons open )?database"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "by", "(?:creative commons attribution|cc by)(?: \\d \\d)?"),
    ("cc-by-sa", "sa", "cc by sa(?: \\d \\d)?"),
    ("cc-by-nd", "nd", "cc by nd(?: \\d \\d)?"),
    ("cc-by-nc", "nc", "cc by nc(?: \\d \\d)?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-nd", "nd", "cc by nc nd(?: \\d \\d)?"),
    ("cc-by-sa", "sharealike", "creative commons attribution share ?alike(?: \\d \\d)?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution non ?commercial(?: \\d \\d)?"),
    ("proprietary", "proprietary", "(?:proprietary|commercial)"),
]
# What surrounds a family's name, as priority, confidence, words before and words after.
# In each, @ stands before the anchor word.
FORMS = [
    (10, 0.8, "", " @licen[sc]e"),
    (20, 0.9, "", " @licen[sc]e(?: version)?(?: v?\\d+(?: \\d+)?)"),
    (30, 1.0, "@licen[sc]ed under (?:the )?(?:terms of (?:the )?)?", "(?: licen[sc]e)?(?: version \\d+(?: \\d+)?)?"),
    (30, 1.0, "(?:released|distributed|available|covered|published) under (?:the )?(?:terms of (?:the )?)?", " @licen[sc]e"),
    (40, 1.0, "@spdx license identifier ", "(?: only| or later)?"),
    (15, 0.7, "@licen[sc]e ", "(?: license)?"),
]
# Signatures, as label, keyword, priority, confidence, expression; words in lower case with one
# space between them, @ before the anchor word.
SIGNATURES = [
    # notices and rights
    ("copyright", "copyright", 5, 0.3, "@copyright (?:c )?(?:19|20)\\d\\d"),
    ("copyright", "copyright", 5, 0.3, "@copyright (?:holders?|owners?|notice)"),
    ("copyright", "reserved", 5, 0.3, "all rights @reserved"),
    ("copyright", "reserved", 6, 0.4, "@copyright (?:c )?(?:19|20)\\d\\d (?:by )?[^ ]+(?: [^ ]+)? all rights reserved"),
    ("proprietary", "reserved", 4, 0.3, "rights not expressly granted (?:herein )?(?:are )?@reserved"),
    ("proprietary", "copying", 30, 0.9, "unauthorized copying of this file via any medium is strictly prohibited (?:[^ ]+ ){0,9}@copyright"),
    ("proprietary", "confidential", 20, 0.8, "(?:proprietary and confidential|confidential and proprietary) @copyright"),
    ("proprietary", "end user", 25, 0.9, "end user @licen[sc]e agreement"),
    ("proprietary", "without", 20, 0.8, "may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:express )?(?:written )?@permission"),
    ("proprietary", "reverse", 20, 0.7, "@licen[sc]ee? (?:shall|may|must) not (?:decompile|disassemble|reverse engineer)"),
    ("copyleft", "copyleft", 5, 0.4, "@copyleft"),
    # public domain
    ("public-domain", "public", 25, 0.9, "(?:in|into|to) the public @domain"),
    ("public-domain", "dedicat", 30, 1.0, "(?:dedicates?|dedicated|dedicate any and all copyright interest) (?:[^ ]+ )?(?:[^ ]+ )?to the public @domain"),
    ("public-domain", "placed", 30, 1.0, "(?:has been|is|are|was|hereby) placed (?:in|into) the public @domain"),
    ("public-domain", "disclaim", 25, 0.9, "the authors? (?:of this (?:software|code|source code) )?disclaims? @copyright"),
    ("public-domain", "government", 20, 0.8, "work of the (?:united states|u s) government (?:[^ ]+ ){0,9}@copyright"),
    ("unlicense", "unlicense", 30, 1.0, "@unlicense"),
    ("unlicense", "unencumbered", 35, 0.95, "free and unencumbered software released into the public @domain"),
    ("unlicense", "compiled", 34, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means (?:[^ ]+ ){0,9}@domain"),
    ("cc0", "cc0", 30, 1.0, "@cc0"),
    ("cc0", "waives", 35, 0.95, "waives abandons and surrenders all of (?:affirmer s|its|his|her) @copyright"),
    ("cc0", "no rights", 25, 0.9, "no rights @reserved"),
    # MIT and its kin
    ("mit", "hereby", 35, 0.95, "@permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", 35, 0.95, "the above copyright notice and this @permission notice shall be included in all copies or substantial portions"),
    ("mit", "sublicense", 34, 0.9, "publish distribute @sublicense and or sell copies of the software"),
    ("mit", "provided", 20, 0.6, "the software is provided as is without @warranty of any kind"),
    ("mit", "dealings", 33, 0.9, "in no event shall the authors or copyright holders be @liable for any claim damages or other liability"),
    ("mit-0", "restriction", 33, 0.8, "@permission is hereby granted free of charge (?:[^ ]+ ){0,9}without restriction (?:[^ ]+ ){0,9}without attribution"),
    ("x11", "advertising", 36, 0.95, "(?:the )?name of the (?:x consortium|copyright holders?) shall not be used in advertising (?:[^ ]+ ){0,9}@permission"),
    ("isc", "without fee", 36, 0.95, "@permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", 33, 0.9, "the author disclaims all @warranties with regard to this software"),
    ("0bsd", "without fee", 35, 0.9, "@permission to use copy modify and or distribute this software for any purpose with or without fee is granted without notice"),
    ("ntp", "without fee", 34, 0.9, "@permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?with(?:out)? fee is hereby granted"),
    ("hpnd", "documentation", 33, 0.9, "both that copyright notice and this @permission notice appear in supporting documentation"),
    ("postgresql", "agreement", 34, 0.9, "without fee and without a written agreement is hereby granted (?:[^ ]+ ){0,9}@copyright"),
    ("curl", "any purpose", 33, 0.8, "@permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided"),
    # BSD
    ("bsd", "redistribution", 35, 0.95, "@redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "retain", 33, 0.9, "@redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "reproduce", 33, 0.9, "@redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse", 36, 0.95, "may be used to endorse or promote products derived from this software without specific prior written @permission"),
    ("bsd-4-clause", "advertising", 37, 0.95, "all advertising materials mentioning features or use of this software must display (?:[^ ]+ ){0,9}@copyright"),
    ("bsd", "express", 30, 0.8, "any express or implied @warranties including but not limited to the implied warranties of merchantability"),
    ("bsd", "merchantability", 29, 0.7, "implied warranties of @merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "regents", 33, 0.9, "in no event shall the (?:regents|copyright (?:owner|holder)s?) or contributors be @liable"),
    # Apache
    ("apache-2.0", "compliance", 36, 1.0, "you may not use this (?:file|work) except in compliance with the @licen[sc]e"),
    ("apache-2.0", "apache", 37, 1.0, "www apache org @licen[sc]es license 2 0"),
    ("apache-2.0", "obtain", 34, 0.9, "you may obtain a copy of the @licen[sc]e at"),
    ("apache-2.0", "basis", 34, 0.9, "distributed on an as is basis without @warranties or conditions of any kind"),
    ("apache-2.0", "governing", 34, 0.9, "see the @licen[sc]e for the specific language governing permissions and limitations"),
    ("apache-2.0", "irrevocable", 35, 0.95, "perpetual worldwide non exclusive no charge royalty free irrevocable @copyright license"),
    ("apache-2.0", "patent", 35, 0.9, "royalty free irrevocable except as stated in this section patent @licen[sc]e"),
    ("apache-2.0", "contributor", 33, 0.9, "@licen[sc]ed to the apache software foundation asf under one or more contributor"),
    ("apache-2.0", "apache", 30, 0.9, "(?:al|asl) ?(?:2|2 0) @licen[sc]e"),
    ("apache-1.1", "acknowledg", 34, 0.9, "this product includes software developed by the apache software foundation (?:[^ ]+ ){0,9}@redistribution"),
    # GPL family
    ("gpl", "gpl", 26, 0.8, "(?:gnu )?gpl @licen[sc]e"),
    ("gpl", "gpl", 26, 0.8, "@licen[sc]ed under (?:the )?(?:gnu )?gpl"),
    ("gpl", "gpl", 15, 0.6, "@gpl"),
    ("gpl", "gpl", 27, 0.9, "gnu @gpl"),
    ("gpl-2.0", "gpl", 32, 0.95, "@gpl (?:v|version )?2(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gplv2", 32, 0.95, "@gplv2"),
    ("gpl-3.0", "gpl", 32, 0.95, "@gpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gplv3", 32, 0.95, "@gplv3"),
    ("gpl", "redistribute", 34, 0.95, "you can redistribute it and or modify it under the terms of the gnu general public @licen[sc]e"),
    ("gpl", "should have", 34, 0.95, "you should have received a copy of the gnu general public @licen[sc]e"),
    ("gpl", "useful", 25, 0.7, "distributed in the hope that it will be useful but without any @warranty"),
    ("gpl", "everyone", 30, 0.8, "everyone is @permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-2.0-or-later", "later", 38, 1.0, "version 2 of the @licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", "later", 38, 1.0, "version 3 of the @licen[sc]e or at your option any later version"),
    ("gpl-2.0-only", "only", 37, 0.95, "version 2 only of the (?:gnu )?(?:general public )?@licen[sc]e"),
    ("gpl-3.0-only", "only", 37, 0.95, "version 3 only of the (?:gnu )?(?:general public )?@licen[sc]e"),
    ("gpl", "freedom", 33, 0.9, "the gnu general public license is a free copyleft @licen[sc]e"),
    ("gpl", "derived", 30, 0.8, "must cause any work that you distribute or publish (?:[^ ]+ ){0,9}under the terms of this @licen[sc]e"),
    ("lgpl", "lgpl", 26, 0.8, "(?:gnu )?lgpl @licen[sc]e"),
    ("lgpl", "lgpl", 26, 0.8, "@licen[sc]ed under (?:the )?(?:gnu )?lgpl"),
    ("lgpl", "lgpl", 15, 0.6, "@lgpl"),
    ("lgpl-2.1", "lgpl", 32, 0.95, "@lgpl (?:v|version )?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", 32, 0.95, "@lgpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", 32, 0.95, "@lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgplv3", 32, 0.95, "@lgplv3"),
    ("lgpl", "lesser", 36, 0.95, "under the terms of the gnu (?:lesser|library) general public @licen[sc]e"),
    ("lgpl", "lesser", 36, 0.95, "received a copy of the gnu (?:lesser|library) general public @licen[sc]e"),
    ("agpl", "agpl", 26, 0.8, "(?:gnu )?agpl @licen[sc]e"),
    ("agpl", "agpl", 26, 0.8, "@licen[sc]ed under (?:the )?(?:gnu )?agpl"),
    ("agpl", "agpl", 15, 0.6, "@agpl"),
    ("agpl-3.0", "agpl", 32, 0.95, "@agpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agplv3", 32, 0.95, "@agplv3"),
    ("agpl", "affero", 36, 0.95, "under the terms of the (?:gnu )?affero general public @licen[sc]e"),
    ("agpl-3.0", "network", 33, 0.9, "remote network interaction use with the gnu general public @licen[sc]e"),
    ("fdl", "invariant", 36, 0.95, "under the terms of the gnu free documentation @licen[sc]e"),
    ("gpl-classpath", "linking", 35, 0.9, "linking this library statically or dynamically (?:[^ ]+ ){0,9}@permission"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2.0", "mozilla", 37, 1.0, "subject to the terms of the mozilla public @licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-2.0", "mpl was not", 36, 1.0, "if a copy of the mpl was not distributed (?:[^ ]+ ){0,9}@permission"),
    ("mpl-1.1", "mozilla", 36, 0.95, "subject to the mozilla public @licen[sc]e version 1 1"),
    ("mpl", "covered", 28, 0.7, "covered software is provided under this @licen[sc]e on an as is basis"),
    ("epl", "accompanying", 35, 0.95, "accompanying materials are made available under the terms of the eclipse public @licen[sc]e"),
    ("epl-2.0", "eclipse", 36, 0.95, "eclipse public @licen[sc]e (?:v|version )?2 0"),
    ("epl-1.0", "eclipse", 36, 0.95, "eclipse public @licen[sc]e (?:v|version )?1 0"),
    ("cddl", "cddl", 26, 0.8, "@cddl"),
    ("cddl", "distribution", 35, 0.95, "subject to the terms of the common development and distribution @licen[sc]e"),
    ("cpl", "common public", 34, 0.9, "provided under the terms of this common public @licen[sc]e"),
    ("eupl", "eupl", 32, 0.95, "@licen[sc]ed under the eupl"),
    ("cecill", "cecill", 32, 0.95, "cecill(?: [bc])? @licen[sc]e"),
    ("osl-3.0", "open software", 32, 0.9, "open software @licen[sc]e(?: version)? 3 0"),
    ("afl-3.0", "academic", 32, 0.9, "academic free @licen[sc]e(?: version)? 3 0"),
    ("ms-pl", "microsoft", 32, 0.95, "microsoft public @licen[sc]e"),
    ("ms-rl", "microsoft", 32, 0.95, "microsoft reciprocal @licen[sc]e"),
    ("artistic-2.0", "artistic", 34, 0.9, "under the terms of the artistic @licen[sc]e(?: version)? 2 0"),
    ("artistic", "perl", 34, 0.9, "under the same (?:terms|licen[sc]e) as perl itself (?:[^ ]+ ){0,9}@licen[sc]e"),
    ("ruby", "ruby", 30, 0.9, "under the same terms as ruby (?:[^ ]+ ){0,9}@licen[sc]e"),
    # permissive ones with texts of their own
    ("zlib", "express", 35, 0.95, "provided as is without any express or implied @warranty"),
    ("zlib", "altered", 33, 0.9, "altered source versions must be plainly marked as such (?:[^ ]+ ){0,9}@permission"),
    ("zlib", "origin", 34, 0.9, "@permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("boost", "accompanying", 36, 0.95, "@permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("boost", "boost", 36, 1.0, "distributed under the boost software @licen[sc]e"),
    ("wtfpl", "what the", 32, 0.95, "do what the fuck you want to public @licen[sc]e"),
    ("beerware", "beer", 32, 0.9, "beer ?ware @licen[sc]e"),
    ("json", "evil", 34, 0.9, "the software shall be used for good not evil (?:[^ ]+ ){0,9}@warranty"),
    ("openssl", "openssl", 34, 0.9, "this product includes software developed by the openssl project (?:[^ ]+ ){0,9}@redistribution"),
    ("ijg", "independent", 30, 0.9, "independent jpeg group (?:[^ ]+ ){0,9}@permission"),
    ("libpng", "libpng", 32, 0.95, "libpng @licen[sc]e"),
    ("freetype", "freetype", 32, 0.95, "freetype (?:project )?@licen[sc]e"),
    ("imagemagick", "imagemagick", 32, 0.95, "imagemagick @licen[sc]e"),
    ("python", "psf", 32, 0.9, "psf @licen[sc]e(?: agreement)?"),
    ("python", "psf", 34, 0.9, "psf hereby grants licensee a nonexclusive royalty free world wide @licen[sc]e"),
    ("php", "php", 32, 0.9, "php @licen[sc]e(?: version)? 3 0?1?"),
    ("vim", "vim", 30, 0.9, "vim @licen[sc]e"),
    ("tcl", "tcl", 30, 0.9, "tcl tk @licen[sc]e"),
    ("w3c", "w3c", 32, 0.9, "w3c software (?:notice and )?@licen[sc]e"),
    ("unicode", "unicode", 32, 0.9, "unicode (?:inc )?@licen[sc]e(?: agreement)?"),
    ("ncsa", "illinois", 32, 0.95, "university of illinois ncsa open source @licen[sc]e"),
    ("ofl", "reserved font", 34, 0.9, "with reserved font name (?:[^ ]+ ){0,9}@licen[sc]ed"),
    ("ofl", "sil", 36, 0.95, "@licen[sc]ed under the sil open font license version 1 1"),
    ("blueoak", "blue oak", 32, 0.95, "blue oak model @licen[sc]e"),
    ("upl", "universal permissive", 32, 0.95, "universal permissive @licen[sc]e"),
    ("bsl-1.1", "business source", 32, 0.95, "business source @licen[sc]e(?: version)?(?: 1 1)?"),
    ("sspl", "server side", 32, 0.95, "server side public @licen[sc]e"),
    ("elastic-2.0", "elastic", 32, 0.95, "elastic @licen[sc]e(?: version)? 2 0"),
    ("commons-clause", "commons clause", 32, 0.95, "@commons clause (?:license )?condition"),
    ("polyform", "polyform", 32, 0.95, "polyform (?:noncommercial|small business|shield|strict) @licen[sc]e"),
    # Creative Commons and data
    ("creative-commons", "commons", 5, 0.5, "creative @commons"),
    ("cc-by", "attribution", 34, 0.95, "under a creative @commons attribution \\d \\d (?:international|unported|generic) licen[sc]e"),
    ("cc-by-sa", "share", 36, 0.95, "creative @commons attribution share ?alike(?: \\d \\d)?"),
    ("cc-by-nd", "deriv", 36, 0.95, "creative @commons attribution no ?deriv(?:ative)?s?(?: \\d \\d)?"),
    ("cc-by-nc", "commercial", 36, 0.95, "creative @commons attribution non ?commercial(?: \\d \\d)?"),
    ("cc-by-nc-sa", "share", 38, 0.95, "creative @commons attribution non ?commercial share ?alike(?: \\d \\d)?"),
    ("cc-by-nc-nd", "deriv", 38, 0.95, "creative @commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \\d \\d)?"),
    ("cc-by", "creativecommons", 36, 1.0, "creativecommons org @licen[sc]es by(?: \\d \\d)?"),
    ("cc-by-sa", "creativecommons", 38, 1.0, "creativecommons org @licen[sc]es by sa(?: \\d \\d)?"),
    ("cc-by-nc", "creativecommons", 38, 1.0, "creativecommons org @licen[sc]es by nc(?: \\d \\d)?"),
    ("cc-by-nc-sa", "creativecommons", 39, 1.0, "creativecommons org @licen[sc]es by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-nd", "creativecommons", 39, 1.0, "creativecommons org @licen[sc]es by nc nd(?: \\d \\d)?"),
    ("odbl", "open data commons", 36, 0.95, "open data @commons open database licen[sc]e"),
    ("odc-by", "open data commons", 36, 0.95, "open data @commons attribution licen[sc]e"),
    ("pddl", "open data commons", 36, 0.95, "open data @commons public domain dedication"),
    ("cdla", "community data", 34, 0.9, "community data @licen[sc]e agreement(?: permissive| sharing)?"),
    ("ogl", "open government", 34, 0.95, "open government @licen[sc]e(?: v(?:ersion)? ?\\d(?: \\d)?)?"),
    # how a license is referred to
    ("reference", "see the", 3, 0.3, "see (?:the )?(?:file )?@licen[sc]e(?: file| txt| md)?(?: for (?:details|more information|terms))?"),
    ("reference", "found in", 3, 0.3, "that can be found in the @licen[sc]e file"),
    ("dual", "dual", 12, 0.5, "dual @licen[sc]ed"),
    ("dual", "either", 12, 0.5, "@licen[sc]ed under either of"),
    ("warranty-disclaimer", "warrant", 8, 0.3, "(?:without|no) @warranty(?: of any kind)?(?: express or implied)?"),
    ("warranty-disclaimer", "merchantab", 8, 0.3, "@merchantability fitness for a particular purpose and noninfringement"),
    ("warranty-disclaimer", "liab", 8, 0.3, "in no event (?:shall|will) [^ ]+(?: [^ ]+)?(?: [^ ]+)? be @liable"),
]
# Phrases that always count, label and words before the anchor word ``license``.
BASE = [("mit", ["mit"]), ("apache", ["apache"]), ("gpl", ["general", "public"])]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str

    @property
    def anchor(self) -> str:
        """The letters that the anchor word begins with."""
        return re.match("[a-z0-9]+", self.pattern.split("@")[1])[0]

    def reach(self, after: bool) -> int:
        """Words that the expression can take before, or after, its anchor word, at most."""
        part = self.pattern.strip().split("@")[after]
        repeated = sum(int(n) - 1 for n in re.findall(r"\{0,(\d+)\}", part))
        return part.count(" ") - part.count("[^ ]") + repeated


def rules() -> list[Rule]:
    """All signatures, in order: families in all forms, then the ones written out; a rule's place breaks no tie."""
    out = []
    for label, keyword, name in FAMILIES:
        # a name of several words or with a version says more than a short one
        extra = min(4, name.count(" ") + name.count("\\d"))
        for priority, confidence, before, after in FORMS:
            out.append(Rule(label, keyword, priority + extra, confidence, f" {before}{name}{after} "))
        if "(?: license)?" in name:  # the anchor stands within the name: general public license version 3
            spelled = re.sub(r"\(\?:([^()|]*\(\?: license\)\?)\|[^()]*\)", r"\1", name)  # not the abbreviation beside it
            inner = spelled.replace("(?: license)?", " @licen[sc]e")
            out.append(Rule(label, keyword, 25 + extra, 0.9, f" {inner} "))
    return out + [Rule(x, k, p, c, f" {e} ") for x, k, p, c, e in SIGNATURES]


def rules_by_anchor() -> dict[str, list[Rule]]:
    """The rules of each kind of anchor word; kinds are the letters that such words begin with."""
    out: dict[str, list[Rule]] = {}
    for r in rules():
        out.setdefault(r.anchor, []).append(r)
    return out


KIND = "array<struct<label:string,base:boolean,priority:int,confidence:double,start:int,end:int>>"


def _signatures(words: Column, at: Column, own: list[Rule]) -> Column:
    """What the rules of one kind of anchor find around a place (from 0), in as many words as they can take."""
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in own])), "array<struct<label:string,keyword:string,priority:int,confidence:double,pattern:string>>")
    before, after = (max(r.reach(side) for r in own) for side in (False, True))
    left = F.array_join(F.slice(words, F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before))), " ")
    right = F.array_join(F.slice(words, at + 2, F.lit(after)), " ")
    context = F.concat(F.when(left == "", "").otherwise(F.concat(F.lit(" "), left)), F.lit(" @"), F.get(words, at), F.lit(" "), right, F.lit(" "))

    def found(context: Column) -> Column:
        whole = lambda r: F.call_function("regexp_extract", context, r["pattern"], F.lit(0))
        hits = F.filter(table, lambda r: F.contains(context, r["keyword"]) & F.rlike(context, r["pattern"]))

        def interval(r: Column) -> Column:
            text = F.trim(whole(r))
            ahead = F.substring_index(text, "@", 1)
            start = at - (F.length(ahead) - F.length(F.replace(ahead, F.lit(" "), F.lit(""))))
            n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
            return F.struct(r["label"].alias("label"), F.lit(False).alias("base"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), start.alias("start"), (start + n).alias("end"))

        return F.transform(hits, interval)

    return let(context, found)


def _base(words: Column, at: Column) -> Column:
    """The base phrase that ends in the word at a place, if there is one."""
    out = F.array().cast(KIND)
    for label, ahead in reversed(BASE):
        here = F.get(words, at) == "license"
        for k, word in enumerate(ahead):
            here = here & F.coalesce(F.get(words, at - len(ahead) + k) == word, F.lit(False))
        one = F.struct(F.lit(label).alias("label"), F.lit(True).alias("base"), F.lit(0).alias("priority"), F.lit(0.8).alias("confidence"), (at - len(ahead)).alias("start"), (at + 1).alias("end"))
        out = F.when(here, F.array(one)).otherwise(out)
    return out


def _uncontained(by_anchor: Column, reach: int) -> Column:
    """Of the detections of each anchor, in order, those that do not lie within a stronger one.

    A rule takes at most reach words on either side, and no two anchors are one word: what contains a
    detection belongs to one of the reach nearest anchors on either side.
    """

    def stand(own: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        near = F.flatten(F.slice(by_anchor, first + 1, i + reach + 1 - first))
        within = lambda e, d: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ~e["base"]
        stronger = lambda e, d: (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["end"] - e["start"] > d["end"] - d["start"]))
        return let(near, lambda n: F.filter(own, lambda d: d["base"] | ~F.exists(n, lambda e: within(e, d) & stronger(e, d))))

    return F.flatten(F.transform(by_anchor, stand))


def scan(docs: DataFrame) -> DataFrame:
    """docs with license_words (their number) and licenses: label, base, priority, confidence, start, end (words from 0).

    Base phrases are all listed; other detections are those left after suppression, in the order of
    their anchors. A null or empty text has no words and an empty list. Columns of docs with these two
    names are replaced.
    """
    kinds = rules_by_anchor()
    reach = max(r.reach(side) for r in rules() for side in (False, True))
    anchor = "^(?:" + "|".join(sorted(kinds, key=len, reverse=True)) + ")"
    # A-Z in lower case, and a space for all that parts words
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    named = reduce(Column.__or__, (F.contains(F.col("__clean"), F.lit(k)) for k in kinds if not any(o != k and o in k for o in kinds)))
    words = F.filter(F.split("__clean", " "), lambda w: w != "")

    def detections(words: Column, at: Column) -> Column:
        found = F.array().cast(KIND)
        for kind in sorted(kinds, key=len):  # a longer kind is asked first
            found = F.when(F.startswith(F.get(words, at), F.lit(kind)), _signatures(words, at, kinds[kind])).otherwise(found)
        return F.concat(_base(words, at), found)

    anchors = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.rlike(F.get(w, i), F.lit(anchor)))
    found = let(words, lambda w: F.when(F.size(w) > 0, F.transform(anchors(w), lambda i: detections(w, i))))
    none = F.array().cast(KIND)
    gated = F.when(named, F.coalesce(let(found, lambda f: _uncontained(f, reach)), none)).otherwise(none)
    return docs.withColumn("__clean", clean).withColumns({"license_words": F.size(words).cast("bigint"), "licenses": gated}).drop("__clean")
