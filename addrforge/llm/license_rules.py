"""Signature rules of licence texts, notices and identifiers: hand-written expressions over lower-cased words.

Texts are matched as their words joined by single spaces, so expressions need no punctuation. A rule is
(label, priority, keyword, expression): the keyword is a plain string that every match contains; higher
priorities are more specific. Families that differ in a version or a clause are written as one line with
their variants.
"""

from __future__ import annotations

#: SPDX short identifiers, as words (punctuation is a space).
IDENTIFIERS = """
0bsd|0bsd
aal|aal
afl-2.1|afl 2 1
afl-3.0|afl 3 0
agpl-3.0|agpl 3 0(?: only| or later)?
apache-1.0|apache 1 0
apache-1.1|apache 1 1
apache-2.0|apache 2 0
apsl-2.0|apsl 2 0
artistic-1.0|artistic 1 0(?: perl)?
artistic-2.0|artistic 2 0
blueoak-1.0.0|blueoak 1 0 0
bsd-1-clause|bsd 1 clause
bsd-2-clause|bsd 2 clause(?: patent| views)?
bsd-3-clause|bsd 3 clause(?: clear| attribution| lbnl)?
bsd-4-clause|bsd 4 clause(?: uc)?
bsl-1.0|bsl 1 0
busl-1.1|busl 1 1
cc-by-1.0|cc by 1 0
cc-by-2.0|cc by 2 0
cc-by-2.5|cc by 2 5
cc-by-3.0|cc by 3 0
cc-by-4.0|cc by 4 0
cc-by-nc-3.0|cc by nc 3 0
cc-by-nc-4.0|cc by nc 4 0
cc-by-nc-nd-3.0|cc by nc nd 3 0
cc-by-nc-nd-4.0|cc by nc nd 4 0
cc-by-nc-sa-3.0|cc by nc sa 3 0
cc-by-nc-sa-4.0|cc by nc sa 4 0
cc-by-nd-3.0|cc by nd 3 0
cc-by-nd-4.0|cc by nd 4 0
cc-by-sa-2.0|cc by sa 2 0
cc-by-sa-2.5|cc by sa 2 5
cc-by-sa-3.0|cc by sa 3 0
cc-by-sa-4.0|cc by sa 4 0
cc0-1.0|cc0 1 0
cddl-1.0|cddl 1 0
cddl-1.1|cddl 1 1
cecill-2.1|cecill 2 1
cecill-b|cecill b
cecill-c|cecill c
cpl-1.0|cpl 1 0
ecl-2.0|ecl 2 0
epl-1.0|epl 1 0
epl-2.0|epl 2 0
eupl-1.1|eupl 1 1
eupl-1.2|eupl 1 2
fsl-1.1|fsl 1 1(?: mit| apache 2 0| alv2)?
gfdl-1.2|gfdl 1 2(?: only| or later)?
gfdl-1.3|gfdl 1 3(?: only| or later)?
gpl-1.0|gpl 1 0(?: only| or later)?
gpl-2.0|gpl 2 0(?: only| or later)?
gpl-3.0|gpl 3 0(?: only| or later)?
hpnd|hpnd
isc|spdx license identifier isc
lgpl-2.0|lgpl 2 0(?: only| or later)?
lgpl-2.1|lgpl 2 1(?: only| or later)?
lgpl-3.0|lgpl 3 0(?: only| or later)?
lppl-1.3c|lppl 1 3c
mit|spdx license identifier mit
mit-0|mit 0
mpl-1.1|mpl 1 1
mpl-2.0|mpl 2 0
ms-pl|ms pl
ms-rl|ms rl
mulanpsl-2.0|mulanpsl 2 0
ncsa|spdx license identifier ncsa
odbl-1.0|odbl 1 0
odc-by-1.0|odc by 1 0
ofl-1.1|ofl 1 1(?: rfn| no rfn)?
osl-3.0|osl 3 0
pddl-1.0|pddl 1 0
php-3.01|php 3 01
postgresql|spdx license identifier postgresql
psf-2.0|psf 2 0
python-2.0|python 2 0 1?
qpl-1.0|qpl 1 0
sspl-1.0|sspl 1 0
unlicense|spdx license identifier unlicense
upl-1.0|upl 1 0
vim|spdx license identifier vim
wtfpl|wtfpl
x11|spdx license identifier x11
zlib|spdx license identifier zlib
zpl-2.1|zpl 2 1
"""

#: Titles and addresses that name a licence: label, keyword, expression.
NAMES = r"""
apache-2.0|apache|(?:licensed )?under the apache license version 2 0
apache-2.0|apache|apache (?:software )?license (?:version )?2 0
apache-2.0|apache|www apache org licenses license 2 0(?: txt| html)?
apache-1.1|apache|apache (?:software )?license (?:version )?1 1
apache|apache|apache (?:software )?license
mit|mit|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
mit|mit|the mit license(?: mit)?
mit|mit|mit licen[cs]ed?
mit|mit|licen[cs]ed? (?:is |type |under )?(?:the )?mit
mit|mit|opensource org licenses mit(?: license)?(?: php| html)?
mit|expat|(?:the )?expat license
x11|x11|(?:the )?x11 license
isc|isc|(?:the )?isc license
bsd|bsd|(?:licensed|released|distributed) under (?:the |a )?bsd license
bsd|bsd|(?:the )?bsd license
bsd-2-clause|bsd|(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd license
bsd-2-clause|bsd|opensource org licenses bsd 2 clause
bsd-3-clause|bsd|(?:the )?(?:new|revised|modified|3 clause|three clause) bsd license
bsd-3-clause|bsd|opensource org licenses bsd 3 clause
bsd-4-clause|bsd|(?:the )?(?:original|4 clause|four clause) bsd license
gpl-1.0|general public|gnu general public license (?:as published by the free software foundation )?(?:either )?version 1
gpl-2.0|general public|gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?
gpl-3.0|general public|gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?
gpl-2.0|gpl|(?:gnu )?gpl ?(?:version |v)?2(?: 0)?
gpl-3.0|gpl|(?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl-2.0|gnu|www gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-3.0|gnu|www gnu org licenses gpl 3 0(?: txt| html)?
gpl-any|general public|(?:under the (?:terms of the )?)?gnu general public license
gpl-any|gnu|www gnu org licenses gpl(?: txt| html)?
gpl-any|gnu gpl|(?:the )?gnu gpl
lgpl-2.0|library general|gnu library general public license(?: (?:version |v)2(?: 0)?)?
lgpl-2.1|lesser general|gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2 1
lgpl-3.0|lesser general|gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?
lgpl-any|lesser general|(?:gnu )?lesser general public license
lgpl-any|lgpl|(?:the )?(?:gnu )?lgpl
agpl-3.0|affero|(?:gnu )?affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?
agpl-any|affero|(?:gnu )?affero general public license
gfdl|documentation|gnu free documentation license(?: version 1 [123])?
mpl-1.1|mozilla|mozilla public license (?:version |v )?1 1
mpl-2.0|mozilla|mozilla public license (?:version |v )?2 0
mpl-2.0|mozilla|mozilla org mpl 2 0
mpl|mozilla|mozilla public license
epl-1.0|eclipse|eclipse public license (?:version |v )?1 0
epl-2.0|eclipse|eclipse public license (?:version |v )?2 0
epl|eclipse|eclipse public license
cddl|common development|common development and distribution license(?: version 1 [01])?
cpl-1.0|common public|common public license(?: version 1 0)?
cpal-1.0|common public|common public attribution license(?: version 1 0)?
eupl|european union|european union public licen[cs]e(?: v 1 [012])?
artistic-2.0|artistic|(?:the )?artistic license 2 0
artistic-1.0|artistic|(?:the )?artistic license
perl|perl|(?:under )?the same terms as perl(?: itself)?
bsl-1.0|boost|(?:distributed under the )?boost software license(?: version 1 0)?
bsl-1.0|boost|www boost org license 1 0(?: txt)?
zlib|zlib|(?:the )?zlib(?: libpng)? license
libpng|libpng|(?:the )?libpng license
unlicense|unlicense|(?:the )?unlicense(?: org)?
wtfpl|do what|do what the fuck you want to public license(?: version 2)?
beerware|beer|(?:the )?beer ?ware license
cc0-1.0|cc0|(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0|publicdomain|creativecommons org publicdomain zero 1 0
cc-pd|publicdomain|creativecommons org (?:licenses )?publicdomain
cc-by|creative|creative commons attribution(?: license)?
cc-by-4.0|creative|creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0|creative|creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa|creative|creative commons attribution share ?alike(?: license)?
cc-by-sa-4.0|creative|creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-sa-3.0|creative|creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc|creative|creative commons attribution non ?commercial(?: license)?
cc-by-nc-sa|creative|creative commons attribution non ?commercial share ?alike(?: [34] 0)?
cc-by-nc-nd|creative|creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [34] 0)?
cc-by-nd|creative|creative commons attribution no ?deriv(?:atives|s)(?: [34] 0)?
cc-by|creativecommons|creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa|creativecommons|creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc|creativecommons|creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd|creativecommons|creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa|creativecommons|creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd|creativecommons|creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by|cc by|(?:licensed |released |available )?(?:under )?cc by
cc-by-sa|cc by sa|(?:licensed |released |available )?(?:under )?cc by sa
cc-by-nc|cc by nc|(?:licensed |released |available )?(?:under )?cc by nc
cc-by-nd|cc by nd|(?:licensed |released |available )?(?:under )?cc by nd
cc-by-nc-sa|cc by nc sa|(?:licensed |released |available )?(?:under )?cc by nc sa
cc-by-nc-nd|cc by nc nd|(?:licensed |released |available )?(?:under )?cc by nc nd
odbl-1.0|open database|open database license(?: odbl)?
odc-by-1.0|open data commons|open data commons attribution license
pddl-1.0|public domain dedication|(?:open data commons )?public domain dedication and license
ofl-1.1|open font|sil open font license(?: version 1 1)?
ms-pl|microsoft|microsoft public license
ms-rl|microsoft|microsoft reciprocal license
osl-3.0|open software|open software license(?: version)?(?: v ?3 0| 3 0)?
afl-3.0|academic free|academic free license(?: version)?(?: v ?3 0| 3 0)?
ecl-2.0|educational community|educational community license(?: version 2 0)?
postgresql|postgresql|(?:the )?postgresql licen[cs]e
psf-2.0|python software|python software foundation license(?: version 2)?
php-3.01|php|(?:the )?php license(?: version 3 01?)?
ruby|ruby|(?:under )?(?:the )?(?:same terms as ruby|ruby license)
openssl|openssl|(?:the )?openssl license
ssleay|ssleay|(?:the )?(?:original )?ssleay license
qpl-1.0|q public|(?:the )?q public license(?: version 1 0)?
lppl|latex project|latex project public license(?: version 1 3c?)?
ncsa|ncsa|university of illinois ncsa open source license
sspl-1.0|server side|server side public license(?: version 1)?
busl-1.1|business source|business source license(?: 1 1)?
elastic-2.0|elastic|elastic license(?: version)?(?: 2 0)?
commons-clause|commons clause|commons clause(?: license condition)?
polyform|polyform|polyform (?:noncommercial|shield|perimeter|strict|small business|free trial|internal use) license(?: 1 0 0)?
blueoak-1.0.0|blue oak|blue oak model license
upl-1.0|universal permissive|universal permissive license(?: v ?1 0)?
cecill|cecill|cecill(?: free software)? license(?: agreement)?
w3c|w3c|w3c software (?:notice and|and document) (?:license|notice)
unicode|unicode|unicode (?:license agreement|inc license)
intel|intel|intel (?:open source|simplified software) license
ibm-pl|ibm public|ibm public license(?: version 1 0)?
apsl|apple public|apple public source license(?: version 2 0)?
npl|netscape|netscape public license(?: version 1 [01])?
sissl|sun industry|sun industry standards source license
zpl|zope|zope public license(?: version 2 [01])?
nasa|nasa|nasa open source agreement(?: version 1 3)?
openldap|openldap|openldap public license(?: version 2 8)?
vim|vim license|(?:the )?vim license
mulan|mulan|mulan (?:permissive software license|psl)(?: v2)?
openrail|openrail|(?:creativeml |bigscience )?openrail(?: m)?(?: license)?
rail|responsible ai|responsible ai license
llama|llama|llama [234]? ?(?:community )?license agreement
"""

#: Sentences of licence bodies: label, keyword, expression.
BODIES = r"""
mit|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit|without restriction|to deal in the software without restriction
mit|substantial portions|this permission notice shall be included in all copies or substantial portions of the software
isc|to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd|to use copy modify|permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation
0bsd|to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd|redistributions|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions|redistributions of source code must retain the above copyright notice
bsd|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|endorse|neither the names? of .{1,60}? may be used to endorse or promote products
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display
gpl-any|free software foundation|under the terms of the gnu general public license as published by the free software foundation
gpl-any|redistribute it|this program is free software you can redistribute it and or modify it
gpl-any|implied warranty|without even the implied warranty of merchantability or fitness for a particular purpose
or-later|at your option|(?:either version \d or )?at your option any later version
lgpl-any|redistribute it|this library is free software you can redistribute it and or modify it
mpl-2.0|source code form|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1|subject to the mozilla|the contents of this file are subject to the mozilla public license version 1 1
apache-2.0|except in compliance|you may not use this file except in compliance with the license
apache-2.0|as is|distributed under the license is distributed on an as is basis without warranties or conditions of any kind
epl|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license
zlib|misrepresented|the origin of this software must not be misrepresented
zlib|altered|altered source versions must be plainly marked as such
unlicense|public domain|this is free and unencumbered software released into the public domain
public-domain|public domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain|public domain|public domain
cc-by|attribution|you must give appropriate credit provide a link to the license
cc-by-sa|same license|you must distribute your contributions under the same license as the original
wtfpl|do what|you just do what the fuck you want to
ofl-1.1|font software|the font software may be sold as part of a larger software package
as-is|as is|(?:the software|this software) is provided (?:by .{1,60}? )?as is
as-is|liable|in no event shall the (?:authors?|copyright holders?).{0,60}? be liable
reserved|all rights reserved|all rights reserved
reserved|some rights reserved|some rights reserved
copyright|copyright|copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
proprietary|proprietary|(?:confidential and )?proprietary(?: and confidential)?
proprietary|unauthorized|unauthorized copying(?: of this file)?
proprietary|permission|(?:may not be|no part of this .{1,40}? may be) (?:reproduced|copied|distributed).{0,60}? without .{0,40}?permission
non-commercial|commercial|for non ?commercial (?:use|purposes) only
personal-use|personal|for (?:your )?personal (?:and non ?commercial )?use only
spdx|spdx license identifier|spdx license identifier
"""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression), most specific first; ties in the order written."""
    out = []
    for line in IDENTIFIERS.strip().splitlines():
        label, expression = line.split("|", 1)
        keyword = expression.split("(")[0].replace("1?", "").strip()
        if " " not in expression:  # one word alone may be any word: it must be named as a licence
            expression = rf"(?:spdx license identifier {expression}|licen[cs]ed? (?:identifier |is |under |the )*{expression}|{expression} licen[cs]ed?)"
        out.append((label, 300, keyword, expression))
    for priority, block in ((200, NAMES), (100, BODIES)):
        for line in block.strip().splitlines():
            label, keyword, expression = line.split("|", 2)
            # among names, a version or a clause is more specific
            out.append((label, priority + (10 if any(c.isdigit() for c in label) else 0), keyword, expression))
    return sorted(out, key=lambda r: -r[1])
