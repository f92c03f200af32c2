"""Hand-written signature rules for license texts, notices and names.

One rule a line: label, keywords, and an expression over normalised words (lower case, one
space between words). A text that it matches has one of the keywords as a word. Rules stand from the most telling
to the least; a version wins over a bare name because its interval is longer.
"""

# Sentences of the license texts themselves.
TEXTS = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | hereby | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the names? of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-3 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2 | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version 2(?: 1)?
lgpl-3 | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
agpl | affero | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | affero | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license
agpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
gpl | received | you should have received a copy of the gnu general public license
lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | received | you should have received a copy of the gnu affero general public license
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
apache-2 | compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | apache | you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0
apache-2 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1 | endorse | the names? apache (?:[^ ]+ ){1,8}must not be used to endorse or promote products derived from this software
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2(?: 0)?
mpl-2 | mozilla | obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-1 | mozilla | the contents of this file are subject to the mozilla public license version 1 [01]
mpl | mozilla | the contents of this file are subject to the mozilla public license
epl-1 | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?1(?: 0)?
epl-2 | eclipse | made available under the terms of the eclipse public license v?(?:ersion)? ?2(?: 0)?
epl | eclipse | the accompanying program is provided under the terms of this eclipse public license
cpl-1 | common | the accompanying program is provided under the terms of this common public license
cddl-1 | cddl | the contents of this file are subject to the terms of the common development and distribution license
eupl-1 | eupl | licensed under the eupl version 1 [012]
eupl-1 | eupl | you may not use this work except in compliance with the licence
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1 | machine | solely in the form of machine executable object code generated by a source language processor
bsl-1 | boost | distributed under the boost software license version 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | want | you just do what the (?:fuck|f ?ck) you want to
wtfpl | everyone | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
cc0-1 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0-1 | waived | has waived all copyright and related or neighboring rights
public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | disclaims | the author disclaims copyright to this source code
blessing | blessing | in place of a legal notice here is a blessing
artistic-1 | artistic | the intent of this document is to state the conditions under which a package may be copied
artistic | artistic | under the same terms as perl itself
artistic-2 | artistic | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1 | font | this font software is licensed under the sil open font license version 1 1
ofl-1 | font | the goals of the open font license
openssl | openssl | this product includes software developed by the openssl project
bsd-4-clause | berkeley | this product includes software developed by the university of california berkeley
postgresql | documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | ncsa | university of illinois ncsa open source license
x11 | consortium | the name of the x consortium shall not be used in advertising
curl | holder | except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
python-2 | python | psf is making python (?:available to licensee|(?:[0-9]+ ){1,4}available to licensee)
python-2 | python | this license agreement is between the python software foundation
ruby | ruby | you may make and give away verbatim copies of the source form of the software without restriction
php-3 | php | this product includes php software freely available from
vim | charityware | vim is charityware
beerware | beer beerware | the beer ?ware license
json | evil | the software shall be used for good not evil
afl-3 | academic | licensed under the academic free license version 3 0
osl-3 | software | licensed under the open software license version 3 0
ms-pl | microsoft | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | reciprocal | microsoft reciprocal license
busl-1 | business | use limitation (?:[^ ]+ ){0,12}business source license
sspl-1 | server | server side public license
elastic-2 | elastic | you may not provide the software to third parties as a hosted or managed service
commons-clause | clause | commons clause license condition
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution)(?: or (?:copying|reproduction|distribution))? of this (?:file|software|document|material) (?:via any medium )?is strictly prohibited
proprietary | confidential | proprietary and confidential
proprietary | permission | may not be (?:reproduced|copied|redistributed)(?: or (?:reproduced|copied|redistributed|transmitted))?(?: in any form)?(?: or by any means)? without (?:the )?(?:prior )?(?:express )?(?:written )?permission
all-rights-reserved | rights | all rights reserved
"""

# Notices that name a license with its version, joined or abbreviated.
NOTICES = r"""
gpl-1 | gpl gplv1 | (?:gnu )?gpl ?v1(?: 0)?(?: only| or later| or any later version)?
gpl-2 | gpl gplv2 | (?:gnu )?gpl ?v2(?: 0)?(?: only| or later| or any later version)?
gpl-2 | gpl | (?:gnu )?gpl (?:version )?2(?: 0)?(?: only| or later| or any later version)?
gpl-2 | gpl2 | gpl2
gpl-3 | gpl gplv3 | (?:gnu )?gpl ?v3(?: 0)?(?: only| or later| or any later version)?
gpl-3 | gpl | (?:gnu )?gpl (?:version )?3(?: 0)?(?: only| or later| or any later version)?
gpl-3 | gpl3 | gpl3
gpl-2 | general | gnu general public licen[sc]e ?v(?:ersion )?2(?: 0)?(?: only| or later| or any later version)?
gpl-3 | general | gnu general public licen[sc]e ?v(?:ersion )?3(?: 0)?(?: only| or later| or any later version)?
gpl-2 | general | version 2 of the gnu general public licen[sc]e
gpl-3 | general | version 3 of the gnu general public licen[sc]e
lgpl-2 | lgpl lgplv2 | (?:gnu )?lgpl ?v2(?: [01])?(?: only| or later| or any later version)?
lgpl-2 | lgpl | (?:gnu )?lgpl (?:version )?2(?: [01])?(?: only| or later| or any later version)?
lgpl-3 | lgpl lgplv3 | (?:gnu )?lgpl ?v3(?: 0)?(?: only| or later| or any later version)?
lgpl-3 | lgpl | (?:gnu )?lgpl (?:version )?3(?: 0)?(?: only| or later| or any later version)?
lgpl-2 | general | (?:gnu )?(?:lesser|library) general public licen[sc]e ?v2(?: [01])?
lgpl-3 | general | (?:gnu )?lesser general public licen[sc]e ?v3(?: 0)?
lgpl-2 | general | version 2(?: [01])? of the gnu (?:lesser|library) general public licen[sc]e
lgpl-3 | general | version 3 of the gnu lesser general public licen[sc]e
agpl-3 | agpl agplv3 | (?:gnu )?agpl ?v3(?: 0)?(?: only| or later| or any later version)?
agpl-3 | agpl | (?:gnu )?agpl (?:version )?3(?: 0)?(?: only| or later| or any later version)?
agpl-3 | affero | (?:gnu )?affero general public licen[sc]e ?v(?:ersion )?3(?: 0)?
gfdl-1 | gfdl gfdlv1 gfdl1 fdl fdlv1 fdl1 | (?:gnu )?(?:gfdl|fdl) ?v?1 [123]
apache-2 | apache | apache licen[sc]e ?v2(?: 0)?
apache-2 | apache apachev2 apache2 | apache ?v?2(?: 0)? licen[sc]ed?
apache-2 | apache | apache software licen[sc]e ?v?2(?: 0)?
apache-2 | asl aslv2 asl2 | asl ?v?2(?: 0)?
apache-1 | apache | apache (?:software )?licen[sc]e ?v1 [01]
mpl-1 | mpl mplv1 mpl1 | mpl ?v?1 [01]
mpl-2 | mpl mplv2 mpl2 | mpl ?v?2(?: 0)?
mpl-2 | mozilla | mozilla public licen[sc]e ?v2(?: 0)?
epl-1 | epl eplv1 epl1 | epl ?v?1(?: 0)?
epl-2 | epl eplv2 epl2 | epl ?v?2(?: 0)?
epl-1 | eclipse | eclipse public licen[sc]e ?v1(?: 0)?
epl-2 | eclipse | eclipse public licen[sc]e ?v2(?: 0)?
edl-1 | eclipse | eclipse distribution licen[sc]e(?: ?v(?:ersion )?1(?: 0)?)?
cddl-1 | cddl cddlv1 cddl1 | cddl ?v?1 [01]
eupl-1 | eupl euplv1 eupl1 | eupl ?v?1 [012]
artistic-2 | artistic | artistic licen[sc]e ?v?2(?: 0)?
artistic-1 | artistic | artistic licen[sc]e ?v?1(?: 0)?
bsl-1 | boost | boost software licen[sc]e(?: ?v(?:ersion )?)?(?: ?1(?: 0)?)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | bsd | (?:original|old) bsd licen[sc]e
0bsd | bsd 0bsd | (?:0bsd|zero clause bsd)(?: licen[sc]e)?
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1 | creative | creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?
cc-by | cc | cc by [1234] [05](?: [a-z]{2,4})?
cc-by-sa | cc | cc by sa(?: [1234] [05])?
cc-by-nd | cc | cc by nd(?: [1234] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1234] [05])?
cc-by | creativecommons | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1234] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
gpl-2 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu | gnu org licenses gpl 3 0
lgpl-3 | gnu | gnu org licenses lgpl 3 0
agpl-3 | gnu | gnu org licenses agpl 3 0
mit | opensource | opensource org licenses? mit
apache-2 | opensource | opensource org licenses? apache 2 0
bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
odbl-1 | odbl odblv1 odbl1 | odbl ?v?1(?: 0)?
odc-by-1 | odc | odc by(?: 1 0)?
osl-3 | software | open software licen[sc]e(?: version| v)? ?3(?: 0)?
mulan-2 | mulan | mulan (?:psl|permissive software licen[sc]e)(?: ?v(?:ersion )?2)?
"""

# Names that say no version.
NAMES = r"""
gpl | general | (?:the )?gnu general public licen[sc]e
gpl | gpl | (?:the )?gnu gpl
gpl | gpl | under (?:the )?(?:terms of (?:the )?)?gpl
gpl | gpl | gpl licen[sc]ed?
lgpl | general | (?:the )?gnu (?:lesser|library) general public licen[sc]e
lgpl | lgpl | (?:under (?:the )?(?:terms of (?:the )?)?|gnu )lgpl
lgpl | lgpl | lgpl licen[sc]ed?
agpl | affero | (?:the )?(?:gnu )?affero general public licen[sc]e
agpl | agpl | (?:under (?:the )?(?:terms of (?:the )?)?|gnu )agpl
agpl | agpl | agpl licen[sc]ed?
gfdl | documentation | (?:the )?gnu free documentation licen[sc]e
apache | apache | (?:the )?apache (?:software )?licen[sc]ed?
mpl | mozilla | (?:the )?mozilla public licen[sc]e
mpl | mpl | under (?:the )?(?:terms of (?:the )?)?mpl
epl | eclipse | (?:the )?eclipse public licen[sc]e
cddl | development | (?:the )?common development and distribution licen[sc]e
cpl | common | (?:the )?(?:ibm )?common public licen[sc]e
eupl | european | (?:the )?european union public licen[sc]e
bsd | bsd | (?:the )?bsd (?:style )?licen[sc]ed?
bsd | bsd | under (?:the )?(?:terms of (?:the )?)?bsd
mit | mit | (?:the )?mit (?:style )?licen[sc]ed?
mit | expat | (?:the )?expat licen[sc]e
x11 | x11 | (?:the )?x11 licen[sc]e
isc | isc | (?:the )?isc licen[sc]ed?
zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]ed?
artistic | artistic | (?:the )?(?:perl )?artistic licen[sc]e
openssl | openssl | (?:the )?openssl licen[sc]e
python | python | (?:the )?python software foundation licen[sc]e
ruby | ruby | (?:the )?ruby licen[sc]e
php | php | (?:the )?php licen[sc]e
postgresql | postgresql | (?:the )?postgresql licen[sc]e
ncsa | ncsa | (?:the )?ncsa(?: open source)? licen[sc]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | (?:the )?wtfpl
ofl | font | (?:the )?(?:sil )?open font licen[sc]e
odbl | database | (?:the )?open database licen[sc]e
afl | academic | (?:the )?academic free licen[sc]e
osl | software | (?:the )?open software licen[sc]e
ecl | educational | (?:the )?educational community licen[sc]e
upl | permissive | (?:the )?universal permissive licen[sc]e
ms-pl | microsoft | (?:the )?microsoft public licen[sc]e
busl | business | (?:the )?business source licen[sc]e
elastic | elastic | (?:the )?elastic licen[sc]e
cc-by | creative | creative commons attribution licen[sc]e
cc-by-sa | creative | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nd | creative | creative commons attribution no ?deriv[a-z]*(?: licen[sc]e)?
cc-by-nc | creative | creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv[a-z]*(?: licen[sc]e)?
cc | creative | (?:under |with )?(?:a |the )?creative commons licen[sc]ed?
public-domain | domain | (?:is|are) in the public domain
"""

# Confidence of a rule by its kind.
KINDS = ((TEXTS, 0.95), (NOTICES, 0.85), (NAMES, 0.6))


def written_rules() -> list[tuple[str, str, str, float]]:
    """(label, keywords, expression, confidence) of every rule, in order of priority."""
    lines = [(line, conf) for text, conf in KINDS for line in text.strip().splitlines()]
    return [(*line.split(" | ", 2), conf) for line, conf in lines]
