"""Signature rules for licence texts, notices and tags.

Rules are written for words in lower case with one space between them and no other characters, so
"CC BY-NC 4.0" reads ``cc by nc 4 0``. Three kinds, by falling priority: sentences of the licence
texts themselves, tags and notices that name a licence, and full titles. A name that is also
ordinary language ("mit", "cc by") counts only inside a tag or notice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases that are found whatever the other rules say, with their labels. Fixed values.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

_LATER = r"(?: only| or(?: at your option)?(?: any)? later(?: version)?)?"
_GNU = r"(?:the )?(?:gnu )?"
_OF = r"(?: as published by the free software foundation)?(?: either)?"
_INTL = r"(?: \d(?: \d)?)?(?: international| unported| generic| deed)?"

#: label | keyword | name. One line a name; the keyword is part of every text the name matches.
NAMES = rf"""
mit | mit | (?:the )?mit(?: expat| x11)? licen[sc]e
mit | mit | mit
mit-0 | mit | mit (?:no attribution|0)
x11 | x11 | (?:the )?x11(?: licen[sc]e)?
expat | expat | (?:the )?expat(?: licen[sc]e)?
isc | isc | (?:the )?isc(?: licen[sc]e)?
0bsd | 0bsd | 0bsd
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?
bsd-1-clause | bsd | bsd 1 clause(?: licen[sc]e)?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-3-clause-clear | bsd | (?:the )?(?:clear bsd|bsd 3 clause clear)(?: licen[sc]e)?
bsd | bsd | (?:the )?bsd(?: style)?(?: licen[sc]e)?
apache-1 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? 1 [01]
apache-1 | apache | apache 1 [01]
apache-2 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
apache-2 | apache | apache v?2(?: 0)?(?: licen[sc]e)?
apache-2 | asl | asl 2 0
apache-2-llvm-exception | llvm | apache(?: licen[sc]e)?(?: version| v)? ?2 0 with llvm exceptions?
apache | apache | (?:the )?apache(?: software)? licen[sc]e
gpl-1 | gpl | {_GNU}gpl ?v?1(?: 0)?{_LATER}
gpl-1 | general public | {_GNU}general public licen[sc]e{_OF} (?:version |v )?1(?: 0)?{_LATER}
gpl-2 | gpl | {_GNU}gpl ?v?2(?: 0)?{_LATER}
gpl-2 | general public | {_GNU}general public licen[sc]e{_OF} (?:version |v )?v?2(?: 0)?(?: of the licen[sc]e)?{_LATER}
gpl-2-classpath-exception | classpath | {_GNU}(?:gpl|general public licen[sc]e)(?: version)? ?v?2(?: 0)? with(?: the)? classpath exception
gpl-2-linux-syscall-note | syscall | gpl 2 0{_LATER} with linux syscall note
gpl-3 | gpl | {_GNU}gpl ?v?3(?: 0)?{_LATER}
gpl-3 | general public | {_GNU}general public licen[sc]e{_OF} (?:version |v )?v?3(?: 0)?(?: of the licen[sc]e)?{_LATER}
gpl-3-gcc-exception | gcc | gpl 3 0{_LATER} with gcc exception(?: 3 1)?
gpl | gpl | {_GNU}gpl(?: licen[sc]e)?
gpl | general public | (?:the )?gnu general public licen[sc]e
lgpl-2 | lgpl | {_GNU}lgpl ?v?2(?: 0)?{_LATER}
lgpl-2 | library general | {_GNU}library general public licen[sc]e{_OF}(?: version)?(?: v?2(?: 0)?)?{_LATER}
lgpl-2.1 | lgpl | {_GNU}lgpl ?v?2 1{_LATER}
lgpl-2.1 | lesser general | {_GNU}lesser general public licen[sc]e{_OF}(?: version)? v?2 1(?: of the licen[sc]e)?{_LATER}
lgpl-3 | lgpl | {_GNU}lgpl ?v?3(?: 0)?{_LATER}
lgpl-3 | lesser general | {_GNU}lesser general public licen[sc]e{_OF}(?: version)? v?3(?: 0)?(?: of the licen[sc]e)?{_LATER}
lgpl | lgpl | {_GNU}lgpl(?: licen[sc]e)?
lgpl | lesser general | (?:the )?gnu lesser general public licen[sc]e
agpl-1 | affero | (?:the )?affero general public licen[sc]e(?: version)? 1(?: 0)?
agpl-3 | agpl | {_GNU}agpl ?v?3(?: 0)?{_LATER}
agpl-3 | affero | {_GNU}affero general public licen[sc]e{_OF}(?: version)? v?3(?: 0)?(?: of the licen[sc]e)?{_LATER}
agpl | agpl | {_GNU}agpl(?: licen[sc]e)?
agpl | affero | (?:the )?gnu affero general public licen[sc]e
gfdl | gfdl | {_GNU}gfdl(?: v?1 [123])?{_LATER}
gfdl | free documentation | {_GNU}free documentation licen[sc]e(?: version)?(?: 1 [123])?{_LATER}
mpl-1 | mpl | mpl ?v?1 [01]
mpl-1 | mozilla public | (?:the )?mozilla public licen[sc]e(?: version)? v?1 [01]
mpl-2 | mpl | mpl ?v?2(?: 0)?
mpl-2 | mozilla public | (?:the )?mozilla public licen[sc]e(?: version)? v?2(?: 0)?
mpl | mozilla public | (?:the )?mozilla public licen[sc]e
epl-1 | epl | epl ?v?1 0
epl-1 | eclipse public | (?:the )?eclipse public licen[sc]e(?: version)?(?: v)? ?1 0
epl-2 | epl | epl ?v?2 0
epl-2 | eclipse public | (?:the )?eclipse public licen[sc]e(?: version)?(?: v)? ?2 0
epl | eclipse public | (?:the )?eclipse public licen[sc]e
edl-1 | eclipse distribution | (?:the )?eclipse distribution licen[sc]e(?: v)?(?: ?1 0)?
cddl-1 | cddl | cddl(?: ?1 [01])?
cddl-1 | common development | (?:the )?common development and distribution licen[sc]e(?: cddl)?(?: version)?(?: 1 [01])?
cpl-1 | common public | (?:the )?common public licen[sc]e(?: version)?(?: 1 0)?
ipl-1 | ibm public | (?:the )?ibm public licen[sc]e(?: version)?(?: 1 0)?
eupl | eupl | eupl(?: v?1 [012])?
eupl | european union public | (?:the )?european union public licen[sc]e(?: version)?(?: v?1 [012])?
cecill | cecill | (?:the )?cecill(?: [bc])?(?: 2 [01])?(?: free software)?(?: licen[sc]e)?(?: agreement)?
osl-3 | open software | (?:the )?open software licen[sc]e(?: version)?(?: 3 0)?
osl-3 | osl | osl 3 0
afl-3 | academic free | (?:the )?academic free licen[sc]e(?: version)?(?: 3 0)?
afl-3 | afl | afl 3 0
artistic-1 | artistic | (?:the )?(?:perl )?artistic licen[sc]e(?: version)? 1(?: 0)?
artistic-2 | artistic | (?:the )?artistic(?: licen[sc]e)?(?: version)? 2(?: 0)?
artistic | artistic | (?:the )?(?:perl )?artistic licen[sc]e
bsl-1 | boost | (?:the )?boost software licen[sc]e(?: version)?(?: 1 0)?
bsl-1 | bsl | bsl 1 0
busl-1.1 | business source | (?:the )?business source licen[sc]e(?: version)?(?: 1 1)?
busl-1.1 | busl | busl 1 1
sspl-1 | server side public | (?:the )?server side public licen[sc]e(?: version)?(?: v?1)?
sspl-1 | sspl | sspl(?: 1 0)?
elastic-2 | elastic | (?:the )?elastic licen[sc]e(?: version)?(?: v?2(?: 0)?)?
commons-clause | commons clause | commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?
polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)(?: licen[sc]e)?(?: 1 0 [01])?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | (?:the )?wtfpl(?: version)?(?: 2)?
wtfpl | do what the fuck | (?:the )?do what the fuck you want to public licen[sc]e
zlib | zlib | (?:the )?zlib(?: libpng)?(?: licen[sc]e)?
libpng | libpng | (?:the )?libpng(?: licen[sc]e)?(?: version 2)?
openssl | openssl | (?:the )?openssl(?: ssleay)? licen[sc]e
curl | curl | (?:the )?curl licen[sc]e
php-3 | php | (?:the )?php licen[sc]e(?: version)?(?: 3(?: 0| 01)?)?
python-2 | python | (?:the )?(?:python software foundation|psf|python) licen[sc]e(?: version)?(?: 2(?: 0)?)?
ruby | ruby | (?:the )?ruby(?: s)? licen[sc]e
postgresql | postgresql | (?:the )?postgresql licen[sc]e
ncsa | ncsa | (?:the )?(?:university of illinois )?ncsa(?: open source)?(?: licen[sc]e)?
w3c | w3c | (?:the )?w3c(?: software)?(?: notice and)? licen[sc]e
ms-pl | microsoft public | (?:the )?microsoft public licen[sc]e
ms-pl | ms pl | ms pl
ms-rl | microsoft reciprocal | (?:the )?microsoft reciprocal licen[sc]e
ofl-1.1 | open font | (?:the )?(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?
ofl-1.1 | ofl | ofl 1 1
odbl-1 | open database | (?:the )?open(?: data commons)?(?: open)? database licen[sc]e(?: odbl)?(?: v?1 0)?
odbl-1 | odbl | odbl(?: 1 0)?
odc-by-1 | open data commons | (?:the )?open data commons attribution licen[sc]e(?: v?1 0)?
pddl-1 | public domain dedication and | (?:the )?public domain dedication and licen[sc]e
ogl-3 | open government | (?:the )?open government licen[sc]e(?: version)?(?: v?[123](?: 0)?)?
cdla-permissive | community data | (?:the )?community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | community data | (?:the )?community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
lppl | latex project | (?:the )?latex project public licen[sc]e(?: version)?(?: 1 3[abc]?)?
naist | naist | (?:the )?naist licen[sc]e
upl-1 | universal permissive | (?:the )?universal permissive licen[sc]e(?: version)?(?: v?1 0)?
vsl-1 | vovida | (?:the )?vovida software licen[sc]e(?: version)?(?: 1 0)?
rail | openrail | (?:the )?(?:creativeml |bigscience |bigcode )?openrail(?: m| rail m)?(?: licen[sc]e)?
rail | rail | (?:the )?(?:bigscience |responsible ai )rail licen[sc]e(?: v?1 0)?
llama | llama | (?:the )?llama(?: [234])?(?: [123])? community licen[sc]e(?: agreement)?
cc0 | cc0 | (?:the )?cc0(?: 1 0)?(?: universal)?
cc0 | creative commons | creative commons(?: cc0| zero)(?: 1 0)?(?: universal)?
cc-by | cc by | (?:the )?cc by{_INTL}
cc-by | creative commons | (?:the )?creative commons attribution(?: licen[sc]e)?{_INTL}
cc-by-sa | cc by sa | (?:the )?cc by sa{_INTL}
cc-by-sa | creative commons | (?:the )?creative commons attribution share ?alike(?: licen[sc]e)?{_INTL}
cc-by-nd | cc by nd | (?:the )?cc by nd{_INTL}
cc-by-nd | creative commons | (?:the )?creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?{_INTL}
cc-by-nc | cc by nc | (?:the )?cc by nc{_INTL}
cc-by-nc | creative commons | (?:the )?creative commons attribution non ?commercial(?: licen[sc]e)?{_INTL}
cc-by-nc-sa | cc by nc sa | (?:the )?cc by nc sa{_INTL}
cc-by-nc-sa | creative commons | (?:the )?creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?{_INTL}
cc-by-nc-nd | cc by nc nd | (?:the )?cc by nc nd{_INTL}
cc-by-nc-nd | creative commons | (?:the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?{_INTL}
public-domain | public domain | (?:the )?public domain(?: mark)?(?: 1 0)?
"""

#: label | keyword | sentence of the licence's own text or its standard notice.
SENTENCES = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse or promote | neither the name of [\w ]{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
apache-2 | you may not use this file | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | apache org licenses | apache org licenses license 2 0
apache-1 | apache software foundation | this product includes software developed by the apache software foundation
gpl | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl-2 | general public | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3 | general public | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1 | lesser general | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3 | lesser general | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2 | library general | under the terms of the gnu library general public license as published by the free software foundation
agpl-3 | affero | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3 | gnu org licenses | gnu org licenses gpl 3 0
gpl-2 | gnu org licenses | gnu org licenses(?: old licenses)? gpl 2 0
lgpl-2.1 | gnu org licenses | gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-3 | gnu org licenses | gnu org licenses lgpl 3 0
agpl-3 | gnu org licenses | gnu org licenses agpl 3 0
gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1 | mozilla public | the contents of this file are subject to the mozilla public license version 1 [01]
epl-1 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0
epl | eclipse org legal | eclipse org legal epl v?[12]0?
cddl-1 | common development | the contents of this file are subject to the terms of the common development and distribution license
eupl | eupl | licensed under the eupl version 1 [012]
osl-3 | open software | licensed under the open software license version 3 0
afl-3 | academic free | licensed under the academic free license version 3 0
artistic-2 | artistic | under the terms of the artistic license 2 0
perl | same terms as perl | under the same terms as perl itself
bsl-1 | boost org license | boost org license 1 0 txt
bsl-1 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense org | unlicense org
wtfpl | you just do what | you just do what the fuck you want to
zlib | as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
curl | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
php-3 | php | this product includes php software freely available from
python-2 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
postgresql | university of california | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ncsa | documentation files | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
w3c | w3c | copyright [\w ]{1,60}? w3c(?: mit ercim keio(?: beihang)?)?
ms-pl | contributor grants you | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | scripts sil org | scripts sil org ofl
odbl-1 | opendatacommons | opendatacommons org licenses odbl
odc-by-1 | opendatacommons | opendatacommons org licenses by
pddl-1 | opendatacommons | opendatacommons org licenses pddl
ogl-3 | open government | contains public sector information licen[sc]ed under the open government licence
lppl | latex project | this work may be distributed and or modified under the conditions of the latex project public license
commons-clause | right to sell | the license does not include and the license does not grant to you the right to sell the software
sspl-1 | offering the program as a service | offering the program as a service
busl-1.1 | change license | on the change date [\w ]{0,80}?the change license
cc0 | creativecommons org | creativecommons org publicdomain zero(?: 1 0)?
public-domain | creativecommons org | creativecommons org publicdomain mark(?: 1 0)?
cc-by | creativecommons org | creativecommons org licenses by(?: \d \d)?
cc-by-sa | creativecommons org | creativecommons org licenses by sa(?: \d \d)?
cc-by-nd | creativecommons org | creativecommons org licenses by nd(?: \d \d)?
cc-by-nc | creativecommons org | creativecommons org licenses by nc(?: \d \d)?
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd(?: \d \d)?
cc0 | waived all copyright | has waived all copyright and related(?: or| and) neighboring rights to this work
public-domain | public domain | (?:released|placed|dedicated|committed) (?:in|into|to) the public domain
proprietary | proprietary and confidential | proprietary and confidential
proprietary | without the express | may not be (?:copied|reproduced|distributed)[\w ]{0,80}? without the express(?: prior)? written (?:permission|consent) of
"""

#: How a tag or notice names a licence: form | keyword | text around the name.
FORMS = r"""
tag | spdx | spdx license identifier {name}
terms | under the | under the (?:terms|conditions)(?: and conditions)? (?:of|and conditions of) (?:the |a |an )?{name}
licensed | licen | (?:dual |triple )?licen[sc]ed (?:to you )?(?:under|with|by|as)(?: both| either)? (?:the |a |an )?{name}
given | under | (?:released|distributed|published|available|provided|covered|shared|redistributed|offered|contributed|open sourced|governed|used) under (?:the |a |an )?{name}
field | licen | licen[sc]e(?: is| name| type| id)? {name}
title | licen | {name} licen[sc]e
"""

#: Titles that say by themselves that a licence is meant; the others need a form around them.
TITLE_WORDS = ("licen[sc]e", "creative commons", "cc by nc", "cc by sa", "cc by nd", "unlicense", "wtfpl", "cc0")

SENTENCE, NOTICE, TITLE = 3, 2, 1
CONFIDENCE = {SENTENCE: 1.0, NOTICE: 0.9, TITLE: 0.6}

@dataclass(frozen=True)
class Rule:
    """A pattern over normalised words; ``order`` decides between rules equal in all else."""

    name: str
    label: str
    priority: int
    keywords: tuple[bytes, ...]  # all are in every text that matches
    pattern: re.Pattern
    order: int


def _lines(table: str) -> list[list[str]]:
    return [[p.strip() for p in line.split(" | ")] for line in table.strip().splitlines()]


def _bounded(pattern: str) -> re.Pattern:
    """Whole words only; the space behind the last is left for the next match."""
    return re.compile(rf" (?:{pattern})(?= )".encode())


def _required(pattern: str) -> str:
    """The pattern without its optional groups."""
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)\?", "", pattern)) != pattern:
        pattern = shorter
    return pattern


def rules() -> list[Rule]:
    """All rules: every sentence, every name in every form, and the titles that stand alone."""
    found = []

    def add(kind: str, label: str, priority: int, keywords: list[str], pattern: str) -> None:
        held = tuple(k.encode() for k in keywords)
        found.append(Rule(f"{label}:{kind}:{len(found)}", label, priority, held, _bounded(pattern), len(found)))

    for label, keyword, sentence in _lines(SENTENCES):
        add("sentence", label, SENTENCE, [keyword], sentence)
    for label, keyword, name in _lines(NAMES):
        alone = any(w in _required(name) for w in TITLE_WORDS)
        for form, form_keyword, around in _lines(FORMS):
            if form == "title" and (alone or label == "public-domain"):
                continue
            add(form, label, NOTICE, [form_keyword, keyword], around.replace("{name}", f"(?:{name})"))
        if alone:
            add("title", label, TITLE, [keyword], name)
    return found
