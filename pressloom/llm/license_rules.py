"""Signature rules of licence notices, written over lower-case words joined by one space.

A line is ``priority | label | keyword | pattern``. The keyword is plain text that every match of the pattern holds, so
a text without it is never searched for the pattern. Priorities: 1 machine-readable tags, 2 sentences of a licence's own
text, 3 addresses, 4 names with a version, 5 names, 6 general hints. ``VERSIONED`` adds the tag and address forms of
licences that differ in their identifier alone.
"""

from __future__ import annotations

from typing import NamedTuple

CONFIDENCE = {1: 1.0, 2: 0.98, 3: 0.95, 4: 0.9, 5: 0.7, 6: 0.4}

# Phrases whose every place counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


SIGNATURES = r"""
2 | mit | free of charge to any person obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 | mit | substantial portions of the software | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
2 | as-is | provided as is without warranty of any kind | the software is provided as is without warranty of any kind
2 | mit-0 | without restriction including without limitation the rights | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,40}without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
2 | isc | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 | isc | and this permission notice appear in all copies | provided that the above copyright notice and this permission notice appear in all copies
2 | 0bsd | with or without fee is hereby granted the software | for any purpose with or without fee is hereby granted the software is provided as is
2 | hpnd | supporting documentation | appear in supporting documentation
2 | hpnd | makes no representations about the suitability | makes no representations about the suitability of this software for any purpose
2 | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that
2 | bsd | redistributions of source code must retain | redistributions of source code must retain the (?:above|accompanying) copyright notice
2 | bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
2 | bsd-3-clause | to endorse or promote products derived | neither the names? of .{1,80} nor the names of (?:its|the|any) (?:copyright holders or )?contributors may be used to endorse or promote products derived
2 | bsd-3-clause | may not be used to endorse or promote products | may not be used to endorse or promote products derived from this software
2 | bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
2 | bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any partys? (?:s )?patent rights are granted by this license
2 | bsd-2-clause-views | the views and conclusions contained | the views and conclusions contained in the software and documentation are those of the authors
2 | apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license
2 | apache-2.0 | unless required by applicable law or agreed to in writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 | apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache software foundation
2 | gpl-any | it under the terms of the gnu general public license | you can redistribute it and or modify it under the terms of the gnu general public license
2 | gpl-2.0-or-later | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
2 | gpl-3.0-or-later | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 | gpl-1.0-or-later | either version 1 or at your option | gnu general public license as published by the free software foundation either version 1 or at your option any later version
2 | gpl-2.0-only | version 2 of the license only | version 2 of the license only
2 | gpl-2.0-only | general public license version 2 only | gnu general public license version 2 only
2 | gpl-3.0-only | version 3 of the license only | version 3 of the license only
2 | lgpl-2.1-or-later | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
2 | lgpl-2.0-or-later | gnu library general public license as published | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
2 | lgpl-3.0-or-later | gnu lesser general public license as published | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 | agpl-3.0-or-later | gnu affero general public license as published | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 | gpl-any | you should have received a copy of the gnu | you should have received a copy of the gnu (?:lesser |library |affero )?general public license
2 | gpl-any | for a particular purpose see the gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license
2 | classpath-exception-2.0 | as a special exception the copyright holders | as a special exception the copyright holders of this library give you permission to link this library with independent modules
2 | gcc-exception-3.1 | gcc runtime library exception | gcc runtime library exception(?: version 3 1)?
2 | mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
2 | mpl-2.0 | this source code form is subject to the terms | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
2 | mpl-2.0 | if a copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
2 | mpl-2.0-no-copyleft-exception | incompatible with secondary licenses | this source code form is incompatible with secondary licenses as defined by the mozilla public license
2 | epl-1.0 | which accompanies this distribution | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution
2 | epl-2.0 | the terms of the eclipse public license | are made available under the terms of the eclipse public license (?:v ?2 0|2 0|version 2 0)
2 | cddl-1.0 | common development and distribution license the | the contents of this file are subject to the terms of the common development and distribution license the
2 | cpl-1.0 | terms of the common public license | terms of the common public license v?(?:ersion )?1 0
2 | eupl-1.2 | licensed under the eupl | licensed under the eupl version 1 2(?: or as soon)?
2 | eupl-1.1 | licensed under the eupl | licensed under the eupl version 1 1
2 | zlib | in no event will the authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
2 | zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2 | zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented
2 | bsl-1.0 | to use reproduce display distribute execute and transmit | and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software
2 | unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
2 | unlicense | anyone is free to copy modify publish use compile | anyone is free to copy modify publish use compile sell or distribute this software
2 | cc0-1.0 | has waived all copyright and related | (?:to the extent possible under law )?.{0,80}has waived all copyright and related or neighboring rights
2 | wtfpl | do what the fuck you want to | do what the fuck you want to(?: public license)?
2 | wtfpl | you just do what the | 0 you just do what the
2 | beerware | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
2 | artistic-1.0 | artistic control over the development | semblance of artistic control over the development of the package
2 | artistic-2.0 | under the terms of the artistic license | under the terms of the artistic license (?:version )?2 0
2 | perl | under the same terms as perl | under the same terms as perl(?: itself| 5)?
2 | ruby | under the same terms as ruby | under the same terms as ruby(?: itself)?
2 | vim | vim users and developers | vim users and developers
2 | vim | vim license | vim license
2 | openssl | for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
2 | ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
2 | curl | curl and libcurl are | curl and libcurl are (?:true open source|licensed under)
2 | libpng | png reference library | the (?:libpng|png reference library) (?:authors|is supplied as is)
2 | ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
2 | freetype | freetype project | portions of this software are copyright .{0,30}the freetype project|freetype project license
2 | ofl-1.1 | sil open font license | this font software is licensed under the sil open font license(?: version 1 1)?
2 | ofl-1.1 | reserved font name | with reserved font name
2 | bitstream-vera | bitstream vera | bitstream vera is a trademark of bitstream
2 | ubuntu-font-1.0 | ubuntu font licence | ubuntu font licence(?: version 1 0)?
2 | ncsa | with the software without restriction | developed by .{1,80}permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
2 | unicode | unicode data files | unicode data files and any associated documentation
2 | icu | icu license | icu license(?: icu 1 8 1 and later)?
2 | w3c | this work is being provided by the copyright holders under | this work is being provided by the copyright holders under the following license
2 | python-2.0 | psf is making python available | psf is making python available to licensee on an as is basis
2 | python-2.0 | python software foundation license | python software foundation license(?: version 2)?
2 | php-3.01 | subject to version 3 01 of the php license | this source file is subject to version 3 01 of the php license
2 | php-3.0 | subject to version 3 0 of the php license | this source file is subject to version 3 0 of the php license
2 | zpl-2.1 | zope public license version 2 1 | subject to the provisions of the zope public license version 2 1
2 | elastic-2.0 | provide the software to third parties as a hosted | you may not provide the software to third parties as a hosted or managed service
2 | busl-1.1 | is not an open source license | the business source license this document or the license is not an open source license
2 | busl-1.1 | change license | change date .{0,40}change license
2 | sspl-1.0 | server side public license | server side public license(?: version 1)?
2 | commons-clause | commons clause | commons clause license condition(?: v1 0)?|commons clause
2 | polyform-noncommercial-1.0.0 | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
2 | polyform-small-business-1.0.0 | polyform small business | polyform small business license(?: 1 0 0)?
2 | gfdl | free documentation license | (?:permission is granted to copy distribute and or modify this document under the terms of the )?gnu free documentation license
2 | gfdl-no-invariants | no invariant sections | with no invariant sections no front cover texts and no back cover texts
2 | odbl-1.0 | open database license | made available under the open database license|open database license(?: odbl)?
2 | odc-by-1.0 | open data commons attribution license | open data commons attribution license(?: odc by)?(?: v1 0)?
2 | pddl-1.0 | public domain dedication and license | (?:open data commons )?public domain dedication and license(?: pddl)?
2 | cdla-permissive-2.0 | community data license agreement | community data license agreement permissive version 2 0
2 | cdla-sharing-1.0 | community data license agreement | community data license agreement sharing version 1 0
2 | cdla-permissive-1.0 | community data license agreement | community data license agreement permissive version 1 0
2 | ogl-uk-3.0 | open government licence | (?:licensed under the )?open government licence v(?:ersion )?3 0
2 | ogl-uk | open government licence | open government licence
2 | etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?: version 2 0)?
2 | dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung version 2 0
2 | dl-de-zero-2.0 | datenlizenz deutschland | datenlizenz deutschland zero version 2 0
2 | cecill | cecill | cecill(?: [abc])? license|licence cecill(?: [abc])?|governed by the cecill
2 | openrail-m | openrail | (?:creativeml )?(?:bigscience )?openrail(?:\+\+)? ?m?(?: license)?
2 | llama-community | community license agreement | llama [2345](?: [0-9])? community license agreement
2 | gemma | gemma terms of use | gemma terms of use
2 | fair-use | fair use | for the purposes of fair use|under (?:the )?fair use
2 | proprietary | proprietary and confidential | (?:this (?:document|file|software) is )?proprietary and confidential
2 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? of this .{1,40}is (?:strictly )?prohibited
2 | proprietary | no part of this | no part of this (?:publication|book|document|work|website) may be (?:reproduced|copied)
2 | proprietary | may not be reproduced | may not be reproduced (?:in whole or in part )?without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)
2 | proprietary | trade secret | (?:contains|constitutes?) (?:confidential )?(?:and )?trade secrets?
2 | proprietary-news | may not be published broadcast | this material may not be published broadcast rewritten or redistributed
2 | noncommercial | non commercial use only | (?:for )?non commercial use only
2 | noncommercial | noncommercial use only | (?:for )?noncommercial use only
2 | noncommercial | personal | (?:for )?(?:your )?personal(?: and| or)?(?: non commercial)? use only
2 | research-only | research purposes only | (?:for )?(?:academic )?research purposes only
2 | evaluation-only | evaluation purposes only | (?:for )?evaluation purposes only
2 | us-government | work of the united states government | work of the united states government
2 | us-government | work of the u s government | work of the u s government
2 | us-government | restricted rights | u s government users? restricted rights
3 | mit | opensource org license | (?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
3 | bsd-3-clause | opensource org licenses bsd 3 | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
3 | bsd-2-clause | opensource org licenses bsd 2 | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
3 | isc | opensource org licenses isc | (?:https? )?(?:www )?opensource org licenses isc(?: license)?
3 | apache-2.0 | opensource org licenses apache 2 0 | (?:https? )?(?:www )?opensource org licenses apache 2 0
3 | apache-2.0 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
3 | apache-2.0 | apache org licenses | (?:https? )?(?:www )?apache org licenses
3 | gpl-3.0 | gnu org licenses gpl 3 0 | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: txt| html| en html)?
3 | gpl-2.0 | gnu org licenses old licenses gpl 2 0 | (?:https? )?(?:www )?gnu org licenses old licenses gpl 2 0(?: txt| html| en html)?
3 | lgpl-3.0 | gnu org licenses lgpl 3 0 | (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: txt| html| en html)?
3 | lgpl-2.1 | gnu org licenses old licenses lgpl 2 1 | (?:https? )?(?:www )?gnu org licenses old licenses lgpl 2 1(?: txt| html| en html)?
3 | agpl-3.0 | gnu org licenses agpl 3 0 | (?:https? )?(?:www )?gnu org licenses agpl 3 0(?: txt| html| en html)?
3 | gfdl | gnu org licenses fdl | (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [0-9])?(?: txt| html)?
3 | gpl-any | gnu org licenses | (?:https? )?(?:www )?gnu org licenses(?: gpl)?
3 | mpl-2.0 | mozilla org mpl 2 0 | (?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0
3 | mpl-1.1 | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl(?: 1 1| mpl 1 1 html)?
3 | epl-2.0 | eclipse org legal epl 2 0 | (?:https? )?(?:www )?eclipse org legal epl 2 0
3 | epl-1.0 | eclipse org legal epl v10 | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
3 | bsl-1.0 | boost org license 1 0 | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
3 | unlicense | unlicense org | (?:https? )?(?:www )?unlicense org
3 | wtfpl | wtfpl net | (?:https? )?(?:www )?wtfpl net
3 | zlib | zlib net zlib license | (?:https? )?(?:www )?zlib net zlib license(?: html)?
3 | ofl-1.1 | scripts sil org ofl | (?:https? )?scripts sil org ofl
3 | cddl-1.0 | opensource org licenses cddl | (?:https? )?(?:www )?opensource org licenses cddl ?1?(?: 0)?(?: php)?
3 | artistic-2.0 | perlfoundation org artistic | (?:https? )?(?:www )?perlfoundation org artistic(?: license)? 2 0
3 | odbl-1.0 | opendatacommons org licenses odbl | (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
3 | odc-by-1.0 | opendatacommons org licenses by | (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?
3 | pddl-1.0 | opendatacommons org licenses pddl | (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?
3 | public-domain-mark-1.0 | publicdomain mark 1 0 | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
3 | cc0-1.0 | publicdomain zero 1 0 | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
3 | ogl-uk-3.0 | nationalarchives gov uk doc open government licence | (?:https? )?(?:www )?nationalarchives gov uk doc open government licence version 3
3 | cc | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses
4 | gpl-3.0 | general public license version 3 | (?:the )?(?:gnu )?general public license version 3(?: 0)?
4 | gpl-3.0 | general public license v3 | (?:the )?(?:gnu )?general public license v3(?: 0)?
4 | gpl-2.0 | general public license version 2 | (?:the )?(?:gnu )?general public license version 2(?: 0)?
4 | gpl-2.0 | general public license v2 | (?:the )?(?:gnu )?general public license v2(?: 0)?
4 | gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: 0)?
4 | gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: 0)?
4 | gpl-3.0 | gpl 3 | (?:gnu )?gpl 3(?: 0)?
4 | gpl-2.0 | gpl 2 | (?:gnu )?gpl 2(?: 0)?
4 | gpl-3.0 | gpl v | (?:gnu )?gpl v(?:ersion )? ?3(?: 0)?
4 | gpl-2.0 | gpl v | (?:gnu )?gpl v(?:ersion )? ?2(?: 0)?
4 | lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license v(?:ersion )?3(?: 0)?
4 | lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license v(?:ersion )?2 1
4 | lgpl-2.0 | library general public license | (?:gnu )?library general public license v(?:ersion )?2(?: 0)?
4 | lgpl-3.0 | lgpl | (?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?
4 | lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v?(?:ersion )?2 1
4 | agpl-3.0 | affero general public license | (?:gnu )?affero general public license v(?:ersion )?3(?: 0)?
4 | agpl-3.0 | agpl | (?:gnu )?agpl ?v?(?:ersion )?3(?: 0)?
4 | apache-2.0 | apache license version 2 | (?:the )?apache license version 2(?: 0)?
4 | apache-2.0 | apache license 2 | (?:the )?apache license 2(?: 0)?
4 | apache-2.0 | apache license v2 | (?:the )?apache license v2(?: 0)?
4 | apache-2.0 | apache 2 0 | apache 2 0(?: license)?
4 | apache-1.1 | apache software license | apache software license version 1 1
4 | mpl-2.0 | mozilla public license | mozilla public license v?(?:ersion )?2(?: 0)?
4 | mpl-1.1 | mozilla public license | mozilla public license v?(?:ersion )?1 1
4 | mpl-2.0 | mpl 2 0 | mpl 2 0
4 | epl-2.0 | eclipse public license | eclipse public license (?:v |version |v)?2 0
4 | epl-1.0 | eclipse public license | eclipse public license (?:v |version |v)?1 0
4 | bsd-3-clause | 3 clause bsd | (?:the )?3 clause bsd(?: license)?
4 | bsd-2-clause | 2 clause bsd | (?:the )?2 clause bsd(?: license)?
4 | bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
4 | bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
4 | bsd-3-clause | new bsd license | (?:the )?new bsd license
4 | bsd-3-clause | modified bsd license | (?:the )?modified bsd license
4 | bsd-2-clause | simplified bsd license | (?:the )?simplified bsd license
4 | bsd-2-clause | freebsd license | freebsd license
4 | mit-0 | mit no attribution | mit no attribution
4 | bsl-1.0 | boost software license | boost software license(?: version)?(?: 1 0)?
4 | artistic-2.0 | artistic license 2 0 | (?:the )?artistic license 2 0
4 | eupl-1.2 | european union public licen | european union public licen[cs]e v?(?:ersion )?1 2
4 | cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
4 | cc0-1.0 | cc0 | cc0
4 | afl-3.0 | academic free license | academic free license v?(?:ersion )?3 0
4 | osl-3.0 | open software license | open software license v?(?:ersion )?3 0
4 | ms-pl | microsoft public license | microsoft public license(?: ms pl)?
4 | ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
4 | busl-1.1 | business source license | business source license v?(?:ersion )?1 1
4 | elastic-2.0 | elastic license | elastic license (?:v |version )?2(?: 0)?
5 | mit | the mit license | (?:(?:released|licensed|distributed|available|published) under )?the mit license
5 | mit | mit license | mit license(?: mit)?
5 | mit | mit licensed | mit licensed
5 | mit | expat license | expat license
5 | apache | apache license | (?:the )?apache license
5 | apache | apache licensed | apache licensed
5 | bsd | bsd license | (?:the )?bsd license
5 | bsd | bsd style license | bsd style license
5 | isc | isc license | (?:the )?isc license
5 | zlib | zlib license | (?:the )?zlib(?: libpng)? license
5 | lgpl | lesser general public license | (?:gnu )?lesser general public license
5 | lgpl | library general public license | (?:gnu )?library general public license
5 | agpl | affero general public license | (?:gnu )?affero general public license
5 | gpl-any | gnu general public license | (?:the )?gnu general public license
5 | gpl-any | gnu gpl | gnu gpl
5 | mpl | mozilla public license | mozilla public license
5 | epl | eclipse public license | eclipse public license
5 | cddl | common development and distribution license | common development and distribution license
5 | artistic | artistic license | (?:the )?artistic license
5 | eupl | european union public licen | european union public licen[cs]e
5 | ofl | open font license | (?:sil )?open font license
5 | unlicense | the unlicense | the unlicense
5 | public-domain | public domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain|public domain
5 | cc | creative commons | creative commons(?: attribution)?(?: licen[cs]e)?
5 | upl-1.0 | universal permissive license | universal permissive license
5 | mulan-psl-2.0 | mulan permissive software license | mulan permissive software license(?: v2)?
6 | copyright | copyright | copyright (?:c |© )?(?:19|20)[0-9][0-9]
6 | copyright | © | ©(?: ?(?:19|20)[0-9][0-9])?
6 | copyright | copyright by | copyright by
6 | copyright | copyrighted | copyrighted (?:material|work)
6 | licensed | licensed under | licensed under
6 | licensed | released under the | released under the(?: terms of)?
6 | licensed | distributed under the | distributed under the terms of
6 | licensed | redistribution | redistribution is (?:permitted|prohibited|not permitted)
6 | permission | permission | (?:used|reprinted|reproduced) with (?:kind )?permission
6 | permission | by permission | (?:used|reprinted|reproduced) by permission
6 | permission | without permission | without (?:the )?permission of
6 | terms | terms of use | (?:subject to )?(?:our |the )?terms of use
6 | terms | terms of service | (?:subject to )?(?:our |the )?terms of service
6 | terms | end user licen | end user licen[cs]e agreement
6 | trademark | registered trademark | (?:is a |are )?registered trademarks?
"""

# Identifier words of licences with a tag form; the label is the identifier with its own signs.
VERSIONED = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause
BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-2.0
GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0
Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def plain_words(identifier: str) -> str:
    return identifier.lower().replace("-", " ").replace(".", " ")


def _cc_name(kind: str) -> str:
    """The long name of a Creative Commons licence as words."""
    parts = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
    return " ".join(parts[p] for p in kind.split("-"))


def rules() -> list[Rule]:
    """All rules; their order breaks ties of priority and place."""
    made = [Rule(label, 5, phrase, phrase, True) for phrase, label in BASE]
    for line in SIGNATURES.strip().splitlines():
        priority, label, keyword, pattern = (part.strip() for part in line.split(" | ", 3))
        made.append(Rule(label, int(priority), keyword, pattern))
    for name in VERSIONED:
        tag = f"spdx license identifier {plain_words(name)}"
        made.append(Rule(name.lower(), 1, tag, tag))
    for kind in CC_KINDS:
        words = plain_words(kind)
        for version in CC_VERSIONS:
            label, number = f"cc-{kind}-{version}", plain_words(version)
            made.append(Rule(label, 1, f"spdx license identifier cc {words} {number}", f"spdx license identifier cc {words} {number}"))
            made.append(Rule(label, 3, f"creativecommons org licenses {words} {number}",
                             f"(?:https? )?(?:www )?creativecommons org licenses {words} {number}"))
            made.append(Rule(label, 4, f"cc {words} {number}", f"cc {words} {number}"))
            made.append(Rule(label, 4, "attribution", f"(?:creative commons )?{_cc_name(kind)} {number}"))
        made.append(Rule(f"cc-{kind}", 5, f"cc {words}", f"cc {words}(?: licen[cs]e)?"))
    return made
