"""License scan: ordered signature rules over word text, gated by keywords, with overlaps resolved.

A rule is a regular expression over the words of a text joined by one space: rules of their own for notices, headers and
addresses (SINGLES), and the names of licence families (FAMILIES) where the words around them say that one is meant (FORMS) or
where the name is enough (ALONE). Only rules of which a keyword occurs among the text's words run; each match of a rule holds one
of its keywords. Of the places found, a place is suppressed if another
accepted place of the same or a higher priority contains its interval.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from factloom.llm.common import per_row, word_list

#: Fixed values of the contract: phrases whose places are always reported.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Hand-written families: label, keywords, names as they stand in word text (a regular expression).
FAMILIES: list[tuple[str, str, str]] = [
    ("mit", "mit expat", r"mit|expat"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("x11", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? (?:v ?)?1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", r"0bsd"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("gpl-1.0", "gpl gplv gpl1 gplv1", r"(?:gnu )?gpl(?: version)? ?(?:v ?)?1(?: 0)?"),
    ("gpl-2.0", "gpl gplv gpl2 gplv2", r"(?:gnu )?gpl(?: version)? ?(?:v ?)?2(?: 0)?"),
    ("gpl-3.0", "gpl gplv gpl3 gplv3", r"(?:gnu )?gpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version ?)2"),
    ("gpl-3.0", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version ?)3"),
    ("gpl", "gnu", r"gnu general public"),
    ("lgpl-2.1", "lgpl lgplv lgpl2 lgplv2", r"(?:gnu )?lgpl(?: version)? ?(?:v ?)?2 1"),
    ("lgpl-3.0", "lgpl lgplv lgpl3 lgplv3", r"(?:gnu )?lgpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("lgpl-2.1", "gnu", r"gnu (?:lesser|library) general public license version 2(?: 1)?"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license version 3"),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public"),
    ("agpl-3.0", "agpl agplv agpl3 agplv3", r"(?:gnu )?agpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)? ?3"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("gfdl-1.3", "gnu", r"gnu free documentation"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl 2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? 2(?: 0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1.0", "common", r"common development and distribution"),
    ("cpl-1.0", "common", r"common public license"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic(?: license)? 1(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software"),
    ("busl-1.1", "business", r"business source"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("eupl-1.2", "eupl", r"eupl(?: 1 2)?"),
    ("eupl-1.2", "european", r"european union public"),
    ("cecill-2.1", "cecill", r"cecill(?: 2 1)?"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("php-3.01", "php", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa"),
    ("ofl-1.1", "sil", r"sil open font"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database"),
    ("odc-by-1.0", "commons", r"open data commons attribution"),
    ("pddl-1.0", "pddl", r"pddl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?"),
    ("proprietary", "proprietary", r"proprietary"),
]

#: Families whose name alone says enough, without the word licence around it; priority and score of such places.
ALONE = set(
    "apache-1.1 apache-2 bsd-2-clause bsd-3-clause bsd-4-clause 0bsd gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 "
    "artistic-1.0 artistic-2.0 unlicense wtfpl eupl-1.2 cecill-2.1 pddl-1.0 cc0-1.0 cc-by-nc-nd cc-by-nc-sa cc-by-nc cc-by-nd cc-by-sa cc-by".split()
)
ALONE_PRIORITY, ALONE_SCORE = 75, 0.7

#: How a family's name is used: priority, score, pattern around the name. Earlier forms are stronger evidence.
FORMS: list[tuple[int, float, str]] = [
    (90, 1.0, r"spdx license identifier (?:{n})"),
    (80, 0.95, r"(?:licensed|released|distributed|published|available|provided|made available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[cs]e)?"),
    (70, 0.9, r"(?:{n}) (?:public )?licen[cs]e(?:d)?"),
    (60, 0.85, r"licen[cs]e (?:is |type )?(?:the )?(?:{n})"),
]

#: Rules of their own, one a line: label, keywords, priority, score, pattern.
SINGLES: list[tuple[str, str, int, float, str]] = [
    (label, keywords, int(priority), float(score), pattern)
    for label, keywords, priority, score, pattern in (
        map(str.strip, line.split("|", 4))
        for line in r"""
mit | hereby | 85 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | hereby | 84 | 0.9 | permission is hereby granted free of charge to any person obtaining a copy
mit | deal | 55 | 0.7 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit | substantial | 55 | 0.7 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement | 30 | 0.4 | merchantability fitness for a particular purpose and noninfringement
mit | mit | 65 | 0.8 | opensource org licen[cs]es mit(?: license)?(?: php| html)?
mit | mit | 66 | 0.85 | (?:the )?mit style licen[cs]e
mit-0 | mit | 78 | 0.85 | mit no attribution
x11 | x11 | 66 | 0.8 | (?:mit )?x11 (?:style )?licen[cs]e
x11 | consortium | 60 | 0.7 | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-unspecified | bsd | 64 | 0.75 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: licen[cs]e)?
bsd-unspecified | bsd | 62 | 0.7 | bsd(?: style| type)? licen[cs]ed?
bsd-unspecified | bsd | 61 | 0.7 | licen[cs]e (?:is |type )?bsd
bsd-unspecified | redistribution | 74 | 0.8 | redistribution and use in source and binary forms with or without modification are permitted
bsd-unspecified | redistributions | 50 | 0.6 | redistributions of source code must retain the above copyright notice
bsd-unspecified | redistributions | 50 | 0.6 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | 76 | 0.85 | neither the name of (?:the )?(?:\S+ ){1,8}?nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | 77 | 0.85 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | opensource | 65 | 0.8 | opensource org licen[cs]es bsd 2 clause
bsd-3-clause | opensource | 65 | 0.8 | opensource org licen[cs]es bsd 3 clause
apache-2 | apache | 85 | 0.95 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | apache | 68 | 0.85 | (?:www )?apache org licen[cs]es license 2 0(?: html| txt)?
apache-1.1 | apache | 68 | 0.85 | (?:www )?apache org licen[cs]es license 1 1
apache-2 | asf | 66 | 0.8 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | limitations | 35 | 0.5 | see the license for the specific language governing permissions and limitations under the license
apache-2 | asl | 60 | 0.7 | asl 2(?: 0)?
apache-2 | apache2 | 60 | 0.7 | apache2(?: 0)?(?: licen[cs]ed?)?
apache-unspecified | apache | 58 | 0.65 | apache licen[cs]ed?
gpl-2.0 | gnu | 86 | 0.95 | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | gnu | 86 | 0.95 | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 | gnu | 82 | 0.9 | gnu general public license(?: gpl)? version 2 only
gpl-2.0 | gpl gpl2 gplv2 | 79 | 0.85 | gpl ?v?2 (?:only|or later)
gpl-3.0 | gpl gpl3 gplv3 | 79 | 0.85 | gpl ?v?3 (?:only|or later)
gpl-2.0 | gnu | 68 | 0.85 | gnu org licen[cs]es (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl-3.0 | gnu | 68 | 0.85 | gnu org licen[cs]es gpl 3 0(?: html| txt| en html)?
gpl | gnu | 60 | 0.7 | gnu org (?:licen[cs]es|copyleft) gpl(?: html| txt)?
gpl | gnu | 40 | 0.5 | you should have received a copy of the gnu general public license along with this program
gpl | gnu | 59 | 0.65 | gnu gpl
gpl | gpl | 57 | 0.6 | gpl (?:compatible|covered|ed)
gpl | copyleft | 25 | 0.3 | copyleft
lgpl-2.1 | gnu | 86 | 0.95 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3.0 | gnu | 86 | 0.95 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2.1 | gnu | 68 | 0.85 | gnu org licen[cs]es (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | gnu | 68 | 0.85 | gnu org licen[cs]es lgpl 3 0(?: html| txt)?
lgpl | gnu | 59 | 0.65 | gnu lgpl
agpl-3.0 | gnu | 86 | 0.95 | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3.0 | gnu | 68 | 0.85 | gnu org licen[cs]es agpl 3 0(?: html| txt)?
agpl | agpl | 57 | 0.6 | agpl(?: licen[cs]ed)?
gfdl-1.3 | gfdl fdl | 60 | 0.7 | (?:gnu )?g?fdl 1 3
gfdl | gnu | 80 | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl-classpath | classpath | 70 | 0.8 | (?:gnu )?gpl(?: version)? ?v?2 with (?:the )?classpath exception
mpl-2.0 | mozilla | 86 | 0.95 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla | 68 | 0.85 | mozilla org mpl 2 0
mpl-1.1 | mozilla | 86 | 0.95 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | mozilla | 68 | 0.85 | mozilla org mpl mpl 1 1(?: html| txt)?
epl-2.0 | eclipse | 86 | 0.95 | made available under the terms of the eclipse public license(?: v)? 2 0
epl-1.0 | eclipse | 86 | 0.95 | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | 68 | 0.85 | eclipse org legal epl (?:2 0|v20)(?: html)?
epl-1.0 | eclipse | 68 | 0.85 | eclipse org legal epl v10(?: html)?
epl | epl | 57 | 0.6 | epl [12](?: 0)?
cddl-1.0 | cddl | 60 | 0.7 | opensource org licen[cs]es cddl(?: 1 0)?
cddl-1.0 | common | 82 | 0.9 | subject to the terms of the common development and distribution license
isc | permission | 75 | 0.8 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | permission | 74 | 0.75 | permission to use copy modify and or distribute this software for any purpose
isc | isc | 65 | 0.8 | opensource org licen[cs]es isc
historical | permission | 73 | 0.75 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
zlib | misrepresented | 75 | 0.8 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | misrepresented | 74 | 0.75 | the origin of this software must not be misrepresented
zlib | altered | 60 | 0.65 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | png | 66 | 0.75 | the png reference library is supplied as is
bsl-1.0 | boost | 85 | 0.95 | distributed under the boost software license version 1 0
bsl-1.0 | boost | 68 | 0.85 | boost org license 1 0 txt
unlicense | unencumbered | 85 | 0.95 | this is free and unencumbered software released into the public domain
unlicense | unencumbered | 84 | 0.9 | free and unencumbered software released into the public domain
unlicense | unlicense | 66 | 0.8 | unlicense org
wtfpl | what | 82 | 0.9 | do what the fuck you want to public license
public-domain | domain | 50 | 0.7 | (?:released into|dedicated to|placed in|put in|in) the public domain
public-domain | domain | 48 | 0.6 | public domain dedication
cc0-1.0 | creativecommons | 68 | 0.85 | creativecommons org publicdomain zero 1 0
cc0-1.0 | cc0 zero | 60 | 0.7 | cc zero|cc0
cc-pdm | creativecommons | 68 | 0.8 | creativecommons org publicdomain mark 1 0
cc-by | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by [1-4] [05]
cc-by-sa | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by sa [1-4] [05]
cc-by-nd | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-nc | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nc-sa | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | 68 | 0.85 | creativecommons org licen[cs]es by nc nd [1-4] [05]
cc-unspecified | creative | 50 | 0.6 | creative commons licen[cs]ed?
cc-unspecified | creative | 52 | 0.6 | (?:licensed|released|published|available) under (?:a |the )?creative commons
artistic-2.0 | artistic | 68 | 0.85 | opensource org licen[cs]es artistic license 2 0
artistic-unspecified | artistic | 60 | 0.7 | (?:the )?(?:perl )?artistic licen[cs]e
perl | perl | 70 | 0.8 | (?:under the )?same terms as perl(?: itself)?
python-2.0 | python | 80 | 0.9 | python software foundation license(?: agreement)?(?: version 2)?
python-2.0 | psf | 66 | 0.75 | psf licen[cs]e(?: agreement)?(?: 2 0)?
php-3.01 | php | 84 | 0.9 | this source file is subject to version 3 01 of the php license
postgresql | postgresql | 66 | 0.8 | opensource org licen[cs]es postgresql
openssl | openssl | 70 | 0.8 | this product includes software developed by the openssl project
eupl-1.2 | eupl | 82 | 0.9 | licensed under the eupl(?: version| v)? 1 2
cecill-2.1 | cecill | 66 | 0.8 | cecill info licen[cs]es
ofl-1.1 | sil | 84 | 0.9 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | ofl | 60 | 0.7 | ofl 1 1
odbl-1.0 | opendatacommons | 68 | 0.85 | opendatacommons org licen[cs]es odbl(?: 1 0)?
odc-by-1.0 | opendatacommons | 68 | 0.85 | opendatacommons org licen[cs]es by(?: 1 0)?
pddl-1.0 | opendatacommons | 68 | 0.85 | opendatacommons org licen[cs]es pddl(?: 1 0)?
ogl-uk-3.0 | government | 82 | 0.9 | contains public sector information licensed under the open government licen[cs]e v3 0
ogl-uk | government | 70 | 0.8 | open government licen[cs]e
etalab-2.0 | etalab ouverte | 66 | 0.8 | etalab(?: 2 0)?|licence ouverte
busl-1.1 | business | 80 | 0.9 | business source license 1 1
sspl-1.0 | side | 80 | 0.9 | server side public license(?: version 1| v 1)?
sspl-1.0 | sspl | 60 | 0.75 | sspl(?: 1(?: 0)?)?
elastic-2.0 | elastic | 80 | 0.9 | elastic license(?: 2(?: 0)?| v2)?
commons-clause | clause | 80 | 0.9 | commons clause(?: license)? condition|commons clause
polyform | polyform | 70 | 0.8 | polyform (?:noncommercial|small business|strict|shield|perimeter)
openrail | rail responsible | 66 | 0.75 | (?:open )?responsible ai licen[cs]e|bigscience rail
ms-pl | opensource | 68 | 0.85 | opensource org licen[cs]es ms pl
json | evil | 82 | 0.9 | the software shall be used for good not evil
beerware | beerware beer | 66 | 0.8 | (?:the )?beer ?ware licen[cs]e
afl-3.0 | academic | 70 | 0.85 | academic free licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
osl-3.0 | open | 70 | 0.85 | open software licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
upl-1.0 | universal | 70 | 0.85 | universal permissive licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
lppl-1.3c | latex | 70 | 0.85 | latex project public licen[cs]e
vim | vim | 66 | 0.8 | (?:the )?vim licen[cs]e
qpl-1.0 | q | 66 | 0.8 | q public licen[cs]e
sleepycat | sleepycat | 66 | 0.8 | sleepycat(?: public)? licen[cs]e
ecl-2.0 | educational | 70 | 0.85 | educational community licen[cs]e
nasa-1.3 | nasa | 70 | 0.85 | nasa open source agreement
rpl-1.5 | reciprocal | 68 | 0.8 | reciprocal public licen[cs]e
spl-1.0 | sun | 66 | 0.8 | sun public licen[cs]e
ibm-pl-1.0 | ibm | 66 | 0.8 | ibm public licen[cs]e
ijg | jpeg | 70 | 0.8 | this software is based in part on the work of the independent jpeg group
unicode | unicode | 66 | 0.8 | unicode (?:inc )?licen[cs]e agreement
w3c | w3c | 66 | 0.8 | w3c software (?:notice and )?licen[cs]e
mulan-2.0 | mulan | 70 | 0.85 | mulan (?:psl|permissive software licen[cs]e)(?: v?2)?
blueoak-1.0 | blue | 70 | 0.85 | blue oak model licen[cs]e
cpal-1.0 | attribution | 66 | 0.8 | common public attribution licen[cs]e
spdx | spdx | 45 | 0.5 | spdx license identifier \S+
all-rights-reserved | reserved | 40 | 0.6 | all rights reserved
all-rights-reserved | derechos | 40 | 0.6 | todos los derechos reservados
all-rights-reserved | droits | 40 | 0.6 | tous droits réservés
all-rights-reserved | rechte | 40 | 0.6 | alle rechte vorbehalten
no-redistribution | copy modify redistribute reproduce | 45 | 0.6 | (?:you )?may not (?:copy|modify|redistribute|reproduce) (?:or redistribute|or reproduce|or distribute)
no-redistribution | written | 42 | 0.5 | without (?:the )?(?:prior |express )?written (?:permission|consent)
confidential | confidential | 45 | 0.6 | (?:proprietary and confidential|confidential and proprietary)
non-commercial | commercial | 44 | 0.5 | (?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial | noncommercial | 44 | 0.5 | (?:for )?noncommercial (?:use|purposes)(?: only)?
research-only | research academic | 44 | 0.5 | for (?:academic|research|academic and research) (?:use|purposes) only
personal-use | personal | 43 | 0.5 | for (?:your )?personal (?:and non commercial )?use only
as-is | warranty warranties | 20 | 0.3 | without warrant(?:y|ies) of any kind
as-is | provided | 18 | 0.3 | (?:software|document|data) is provided as is
copyright | copyright | 10 | 0.2 | copyright (?:c )?(?:19|20)[0-9][0-9]
"""[1:-1].splitlines()
    )
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: str
    priority: int
    score: float
    pattern: re.Pattern[str]


@lru_cache(1)
def rules() -> dict[str, tuple[Rule, ...]]:
    """The rules by keyword, strongest first."""
    every = [
        Rule(label, keywords, priority, score, re.compile(rf"(?<!\S){form.format(n=name)}(?!\S)"))
        for priority, score, form in FORMS
        for label, keywords, name in FAMILIES
    ]
    alone = [(label, k, ALONE_PRIORITY, ALONE_SCORE, name) for label, k, name in FAMILIES if label in ALONE]
    every += [Rule(l, k, p, s, re.compile(rf"(?<!\S)(?:{x})(?!\S)")) for l, k, p, s, x in SINGLES + alone]
    by: dict[str, list[Rule]] = {}
    for r in sorted(every, key=lambda r: -r.priority):
        for keyword in r.keywords.split():
            by.setdefault(keyword, []).append(r)
    return {k: tuple(v) for k, v in by.items()}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand consecutively."""
    found = []
    for phrase, label in BASE.items():
        want = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(want[0], at + 1)
                if words[at : at + len(want)] == want:
                    found.append((at, label))
        except ValueError:
            pass
    return found


def gates(text: str) -> set[str]:
    """The keywords in a text, between any blanks that the rules take as the end of a word."""
    return rules().keys() & set(text.split())


def detections(words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """(first word, word after the last, label, score) that hold after suppression, in page order."""
    text = b" ".join(words).decode("utf-8", "surrogatepass")
    found = []
    for rule in {id(rule): rule for gate in gates(text) for rule in rules()[gate]}.values():
        found += [(rule.priority, m.end() - m.start(), -m.start(), m, rule) for m in rule.pattern.finditer(text)]
    kept: list[tuple[int, int, str, float]] = []
    found.sort(key=lambda f: (-f[0], -f[1], -f[2], f[4].label))
    reach = max((length for _, length, *_ in found), default=0)  # a containing interval starts at most so far before
    starts = [0, *accumulate(len(w.decode("utf-8", "surrogatepass")) + 1 for w in words)] if found else []
    intervals: list[tuple[int, int]] = []
    for _, _, _, m, rule in found:
        a, b = m.span()
        near = intervals[bisect_left(intervals, (a - reach, 0)) : bisect_right(intervals, (a, 1 << 62))]
        if not any(x <= a and b <= y for x, y in near):
            insort(intervals, (a, b))
            kept.append((bisect_right(starts, a) - 1, bisect_left(starts, b), rule.label, rule.score))
    furthest: dict[str, int] = {}
    whole = []
    for place in sorted(kept, key=lambda p: (p[0], -p[1], p[2])):  # what a longer place of the same label contains goes too
        if place[1] > furthest.get(place[2], -1):
            furthest[place[2]] = place[1]
            whole.append(place)
    return sorted(whole)


SCAN = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", StringType()),
        StructField("labels", StringType()),
        StructField("score", DoubleType()),
    ]
)


def scan_text(doc_id: int | None, text: str | None) -> tuple:
    words = word_list(text)
    base = base_places(words)
    held = detections(words)
    starts = [at for at, _ in base]
    labels = {label for _, label in base}
    score = max([1.0 if base else 0.0, *(s for *_, s in held)])
    return (
        doc_id,
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {label for _, _, label, _ in held})),
        score,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: word count, base places, labels and the strongest rule's score.

    A null or empty text has no words, no labels (empty strings) and score 0. Ids may be null or repeat;
    each row is scanned on its own. Other columns are not read. An empty table gives an empty one.
    """
    return per_row(docs.select("doc_id", "text"), scan_text, SCAN)
