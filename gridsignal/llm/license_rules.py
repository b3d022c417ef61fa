"""Signature rules of the license scan: ``kind label pattern``, one to a line, in the order of their priority.

Patterns are regular expressions over the words of a text in lower case; a space stands between two words, and every
word matches as a whole. A space that belongs to an optional part stands inside its group: ``license(?: version)? 2``.

Kinds, by falling priority: ``notice`` (sentences of a grant and addresses of license texts), ``id`` (tags that name an
identifier), ``version`` (names with a version), ``name`` (names without one), ``loose`` (short forms in context).
"""

from __future__ import annotations

import re
from typing import NamedTuple

# The phrases that count as base detections, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

CONFIDENCE = {"notice": 1.0, "id": 0.95, "version": 0.9, "name": 0.75, "loose": 0.5}

RULES = r"""
notice mit              permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
notice mit              https? (?:www )?opensource org licen[cs]es? mit(?: licen[cs]e)?(?: php| html)?
notice mit-0            https? (?:www )?opensource org licen[cs]es? mit 0
notice isc              permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
notice isc              permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
notice 0bsd             permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: the software)
notice isc              https? (?:www )?opensource org licen[cs]es? isc(?: licen[cs]e)?(?: txt)?
notice apache-2.0       licensed under the apache licen[cs]e version 2 0
notice apache-2.0       you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?
notice apache-2.0       https? (?:www )?apache org licen[cs]es license 2 0(?: txt| html)?
notice apache-1.1       https? (?:www )?apache org licen[cs]es license 1 1(?: txt| html)?
notice apache-1.0       https? (?:www )?apache org licen[cs]es license 1 0(?: txt| html)?
notice apache-2.0       https? (?:www )?opensource org licen[cs]es? apache 2 0(?: php)?
notice gpl-3.0-or-later under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
notice gpl-2.0-or-later under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
notice gpl-2.0-only     under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation
notice gpl-3.0-only     under the terms of the gnu general public licen[cs]e version 3 as published by the free software foundation
notice lgpl-3.0-or-later under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
notice lgpl-2.1-or-later under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
notice lgpl-2.0-or-later under the terms of the gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
notice agpl-3.0-or-later under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
notice gpl-3.0          licensed under the gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
notice gpl-2.0          licensed under the gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
notice gpl-1.0          https? (?:www )?gnu org licen[cs]es old licenses gpl 1 0(?: en)?(?: html| txt)?
notice gpl-2.0          https? (?:www )?gnu org licen[cs]es(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?
notice gpl-3.0          https? (?:www )?gnu org licen[cs]es gpl 3 0(?: en)?(?: html| txt)?
notice gpl              https? (?:www )?gnu org (?:licen[cs]es|copyleft) gpl(?: html| txt)?
notice lgpl-2.1         https? (?:www )?gnu org licen[cs]es(?: old licenses)? lgpl 2 1(?: en)?(?: html| txt)?
notice lgpl-3.0         https? (?:www )?gnu org licen[cs]es lgpl 3 0(?: en)?(?: html| txt)?
notice lgpl             https? (?:www )?gnu org (?:licen[cs]es|copyleft) (?:lgpl|lesser)(?: html| txt)?
notice agpl-3.0         https? (?:www )?gnu org licen[cs]es agpl 3 0(?: en)?(?: html| txt)?
notice agpl             https? (?:www )?gnu org licen[cs]es agpl(?: html| txt)?
notice gfdl-1.1         https? (?:www )?gnu org licen[cs]es(?: old licenses)? fdl 1 1(?: en)?(?: html| txt)?
notice gfdl-1.2         https? (?:www )?gnu org licen[cs]es(?: old licenses)? fdl 1 2(?: en)?(?: html| txt)?
notice gfdl-1.3         https? (?:www )?gnu org licen[cs]es fdl 1 3(?: en)?(?: html| txt)?
notice gfdl             permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
notice bsd              redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
notice bsd-3-clause     neither the name of (?:the |its )?(?:copyright holders?|organization|university|author|contributors|[^ ]+) nor the names of its contributors may be used to endorse or promote products
notice bsd-4-clause     all advertising materials mentioning features or use of this software must display the following acknowledge?ment
notice bsd-2-clause     https? (?:www )?opensource org licen[cs]es? bsd 2 clause(?: php)?
notice bsd-3-clause     https? (?:www )?opensource org licen[cs]es? bsd 3 clause(?: php)?
notice bsd              https? (?:www )?opensource org licen[cs]es? bsd licen[cs]e(?: php| html)?
notice mpl-2.0          this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
notice mpl-1.1          the contents of this file are subject to the mozilla public licen[cs]e version 1 1
notice mpl-1.0          the contents of this file are subject to the mozilla public licen[cs]e version 1 0
notice mpl-2.0          https? (?:www )?mozilla org (?:en us )?mpl 2 0
notice mpl-1.1          https? (?:www )?mozilla org (?:en us )?mpl(?: mpl)? 1 1(?: html| txt)?
notice mpl              https? (?:www )?mozilla org (?:en us )?mpl
notice epl-1.0          https? (?:www )?eclipse org legal epl v10(?: html)?
notice epl-2.0          https? (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
notice edl-1.0          https? (?:www )?eclipse org org documents edl v10(?: html| php)?
notice epl-2.0          this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0
notice epl-1.0          this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
notice cddl-1.0         the contents of this file are subject to the terms of the common development and distribution licen[cs]e
notice boost-1.0        distributed under the boost software licen[cs]e version 1 0
notice boost-1.0        https? (?:www )?boost org license 1 0 txt
notice unlicense        this is free and unencumbered software released into the public domain
notice unlicense        https? (?:www )?unlicense org
notice wtfpl            everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed
notice wtfpl            https? (?:www )?wtfpl net
notice zlib             this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
notice cc0-1.0          https? (?:www )?creativecommons org publicdomain zero 1 0
notice cc-pdm-1.0       https? (?:www )?creativecommons org publicdomain mark 1 0
notice cc-by-nc-nd-4.0  https? (?:www )?creativecommons org licen[cs]es by nc nd 4 0
notice cc-by-nc-nd-3.0  https? (?:www )?creativecommons org licen[cs]es by nc nd 3 0
notice cc-by-nc-nd-2.5  https? (?:www )?creativecommons org licen[cs]es by nc nd 2 5
notice cc-by-nc-nd-2.0  https? (?:www )?creativecommons org licen[cs]es by nc nd 2 0
notice cc-by-nc-sa-4.0  https? (?:www )?creativecommons org licen[cs]es by nc sa 4 0
notice cc-by-nc-sa-3.0  https? (?:www )?creativecommons org licen[cs]es by nc sa 3 0
notice cc-by-nc-sa-2.5  https? (?:www )?creativecommons org licen[cs]es by nc sa 2 5
notice cc-by-nc-sa-2.0  https? (?:www )?creativecommons org licen[cs]es by nc sa 2 0
notice cc-by-nc-4.0     https? (?:www )?creativecommons org licen[cs]es by nc 4 0
notice cc-by-nc-3.0     https? (?:www )?creativecommons org licen[cs]es by nc 3 0
notice cc-by-nc-2.5     https? (?:www )?creativecommons org licen[cs]es by nc 2 5
notice cc-by-nc-2.0     https? (?:www )?creativecommons org licen[cs]es by nc 2 0
notice cc-by-nd-4.0     https? (?:www )?creativecommons org licen[cs]es by nd 4 0
notice cc-by-nd-3.0     https? (?:www )?creativecommons org licen[cs]es by nd 3 0
notice cc-by-nd-2.5     https? (?:www )?creativecommons org licen[cs]es by nd 2 5
notice cc-by-nd-2.0     https? (?:www )?creativecommons org licen[cs]es by nd 2 0
notice cc-by-sa-4.0     https? (?:www )?creativecommons org licen[cs]es by sa 4 0
notice cc-by-sa-3.0     https? (?:www )?creativecommons org licen[cs]es by sa 3 0
notice cc-by-sa-2.5     https? (?:www )?creativecommons org licen[cs]es by sa 2 5
notice cc-by-sa-2.0     https? (?:www )?creativecommons org licen[cs]es by sa 2 0
notice cc-by-4.0        https? (?:www )?creativecommons org licen[cs]es by 4 0
notice cc-by-3.0        https? (?:www )?creativecommons org licen[cs]es by 3 0
notice cc-by-2.5        https? (?:www )?creativecommons org licen[cs]es by 2 5
notice cc-by-2.0        https? (?:www )?creativecommons org licen[cs]es by 2 0
notice proprietary      all rights reserved(?: [^ ]+)? unauthori[sz]ed copying of this file via any medium is strictly prohibited
notice proprietary      this software is (?:the )?confidential and proprietary information of
notice public-domain    (?:released|placed|dedicated) (?:into|in|to) the public domain
notice ms-pl            this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
notice openssl          this product includes software developed by the openssl project for use in the openssl toolkit
notice ssleay           this product includes cryptographic software written by eric young
notice python-2.0       psf is making python available to licensee on an as is basis
notice artistic-2.0     https? (?:www )?(?:perlfoundation org|opensource org licen[cs]es?) artistic licen[cs]e 2 0(?: php)?
notice ofl-1.1          this font software is licensed under the sil open font licen[cs]e version 1 1
notice ofl-1.1          https? scripts sil org ofl
notice odbl-1.0         https? (?:www )?opendatacommons org licen[cs]es odbl(?: 1 0)?
notice odc-by-1.0       https? (?:www )?opendatacommons org licen[cs]es by(?: 1 0)?
notice pddl-1.0         https? (?:www )?opendatacommons org licen[cs]es pddl(?: 1 0)?
notice ogl-uk-3.0       contains public sector information licensed under the open government licen[cs]e v3 0
notice busl-1.1         https? (?:www )?mariadb com bsl11
notice elastic-2.0      https? (?:www )?elastic co licensing elastic licen[cs]e
id     0bsd             spdx license identifier 0bsd
id     afl-3.0          spdx license identifier afl 3 0
id     agpl-3.0-only    spdx license identifier agpl 3 0 only
id     agpl-3.0-or-later spdx license identifier agpl 3 0 or later
id     agpl-3.0         spdx license identifier agpl 3 0
id     apache-1.1       spdx license identifier apache 1 1
id     apache-2.0       spdx license identifier apache 2 0
id     artistic-1.0     spdx license identifier artistic 1 0
id     artistic-2.0     spdx license identifier artistic 2 0
id     bsd-2-clause     spdx license identifier bsd 2 clause
id     bsd-3-clause     spdx license identifier bsd 3 clause
id     bsd-4-clause     spdx license identifier bsd 4 clause
id     boost-1.0        spdx license identifier bsl 1 0
id     busl-1.1         spdx license identifier busl 1 1
id     cc0-1.0          spdx license identifier cc0 1 0
id     cc-by-3.0        spdx license identifier cc by 3 0
id     cc-by-4.0        spdx license identifier cc by 4 0
id     cc-by-nc-4.0     spdx license identifier cc by nc 4 0
id     cc-by-nd-4.0     spdx license identifier cc by nd 4 0
id     cc-by-sa-3.0     spdx license identifier cc by sa 3 0
id     cc-by-sa-4.0     spdx license identifier cc by sa 4 0
id     cddl-1.0         spdx license identifier cddl 1 0
id     cddl-1.1         spdx license identifier cddl 1 1
id     cecill-2.1       spdx license identifier cecill 2 1
id     ecl-2.0          spdx license identifier ecl 2 0
id     elastic-2.0      spdx license identifier elastic 2 0
id     epl-1.0          spdx license identifier epl 1 0
id     epl-2.0          spdx license identifier epl 2 0
id     eupl-1.2         spdx license identifier eupl 1 2
id     gfdl-1.3         spdx license identifier gfdl 1 3(?: only| or later)?
id     gpl-1.0-or-later spdx license identifier gpl 1 0 or later
id     gpl-2.0-only     spdx license identifier gpl 2 0 only
id     gpl-2.0-or-later spdx license identifier gpl 2 0 or later
id     gpl-2.0          spdx license identifier gpl 2 0
id     gpl-3.0-only     spdx license identifier gpl 3 0 only
id     gpl-3.0-or-later spdx license identifier gpl 3 0 or later
id     gpl-3.0          spdx license identifier gpl 3 0
id     isc              spdx license identifier isc
id     lgpl-2.0         spdx license identifier lgpl 2 0(?: only| or later)?
id     lgpl-2.1-only    spdx license identifier lgpl 2 1 only
id     lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
id     lgpl-2.1         spdx license identifier lgpl 2 1
id     lgpl-3.0-only    spdx license identifier lgpl 3 0 only
id     lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
id     lgpl-3.0         spdx license identifier lgpl 3 0
id     mit              spdx license identifier mit
id     mit-0            spdx license identifier mit 0
id     mpl-1.1          spdx license identifier mpl 1 1
id     mpl-2.0          spdx license identifier mpl 2 0
id     ms-pl            spdx license identifier ms pl
id     ms-rl            spdx license identifier ms rl
id     mulan-psl-2.0    spdx license identifier mulanpsl 2 0
id     ncsa             spdx license identifier ncsa
id     odbl-1.0         spdx license identifier odbl 1 0
id     ofl-1.1          spdx license identifier ofl 1 1
id     openssl          spdx license identifier openssl
id     osl-3.0          spdx license identifier osl 3 0
id     postgresql       spdx license identifier postgresql
id     python-2.0       spdx license identifier (?:python|psf) 2 0
id     sspl-1.0         spdx license identifier sspl 1 0
id     unlicense        spdx license identifier unlicense
id     upl-1.0          spdx license identifier upl 1 0
id     vim              spdx license identifier vim
id     wtfpl            spdx license identifier wtfpl
id     zlib             spdx license identifier zlib
id     zpl-2.1          spdx license identifier zpl 2 1
version gpl-3.0-or-later gnu general public licen[cs]e(?: gpl)?(?: version| v)? 3(?: 0)? or (?:any )?later
version gpl-3.0-or-later gnu general public licen[cs]e v3(?: 0)? or (?:any )?later
version gpl-3.0         gnu general public licen[cs]e(?: gpl)?(?: version| v)? 3(?: 0)?
version gpl-3.0         gnu general public licen[cs]e(?: gpl)? (?:v3|gplv3)(?: 0)?
version gpl-2.0-or-later gnu general public licen[cs]e(?: gpl)?(?: version| v)? 2(?: 0)? or (?:any )?later
version gpl-2.0         gnu general public licen[cs]e(?: gpl)?(?: version| v)? 2(?: 0)?
version gpl-2.0         gnu general public licen[cs]e(?: gpl)? (?:v2|gplv2)(?: 0)?
version gpl-1.0         gnu general public licen[cs]e(?: gpl)?(?: version| v)? 1(?: 0)?
version lgpl-3.0        gnu lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 3(?: 0)?
version lgpl-3.0        gnu lesser general public licen[cs]e(?: lgpl)? (?:v3|lgplv3)(?: 0)?
version lgpl-2.1        gnu lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 2 1
version lgpl-2.1        gnu lesser general public licen[cs]e(?: lgpl)? (?:v2|lgplv2) 1
version lgpl-2.0        gnu library general public licen[cs]e(?: lgpl)?(?: version| v)? 2(?: 0)?
version agpl-3.0        gnu affero general public licen[cs]e(?: agpl)?(?: version| v)? 3(?: 0)?
version agpl-3.0        gnu affero general public licen[cs]e(?: agpl)? (?:v3|agplv3)(?: 0)?
version agpl-1.0        affero general public licen[cs]e(?: version| v)? 1(?: 0)?
version gfdl-1.1        gnu free documentation licen[cs]e(?: version| v)? 1 1
version gfdl-1.2        gnu free documentation licen[cs]e(?: version| v)? 1 2
version gfdl-1.3        gnu free documentation licen[cs]e(?: version| v)? 1 3
version apache-2.0      apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?
version apache-2.0      apache (?:software )?licen[cs]e v2(?: 0)?
version apache-1.1      apache (?:software )?licen[cs]e(?: version| v)? 1 1
version apache-1.0      apache (?:software )?licen[cs]e(?: version| v)? 1 0
version mpl-2.0         mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
version mpl-2.0         mozilla public licen[cs]e v2(?: 0)?
version mpl-1.1         mozilla public licen[cs]e(?: version| v)? 1 1
version mpl-1.0         mozilla public licen[cs]e(?: version| v)? 1 0
version epl-2.0         eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
version epl-2.0         eclipse public licen[cs]e v2(?: 0)?
version epl-1.0         eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
version epl-1.0         eclipse public licen[cs]e v1(?: 0)?
version eupl-1.2        european union public licen[cs]e(?: version| v)? 1 2
version eupl-1.1        european union public licen[cs]e(?: version| v)? 1 1
version cddl-1.0        common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 0
version cddl-1.1        common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 1
version cpl-1.0         common public licen[cs]e(?: version| v)? 1 0
version ipl-1.0         ibm public licen[cs]e(?: version| v)? 1 0
version artistic-2.0    artistic licen[cs]e(?: version| v)? 2(?: 0)?
version artistic-1.0    artistic licen[cs]e(?: version| v)? 1(?: 0)?
version afl-3.0         academic free licen[cs]e(?: version| v)? 3 0
version afl-2.1         academic free licen[cs]e(?: version| v)? 2 1
version osl-3.0         open software licen[cs]e(?: version| v)? 3 0
version osl-2.1         open software licen[cs]e(?: version| v)? 2 1
version ecl-2.0         educational community licen[cs]e(?: version| v)? 2 0
version boost-1.0       boost software licen[cs]e(?: version| v)? 1 0
version ofl-1.1         sil open font licen[cs]e(?: version| v)? 1 1
version ofl-1.0         sil open font licen[cs]e(?: version| v)? 1 0
version upl-1.0         universal permissive licen[cs]e(?: version| v)? 1 0
version zpl-2.1         zope public licen[cs]e(?: version| v)? 2 1
version zpl-2.0         zope public licen[cs]e(?: version| v)? 2 0
version sspl-1.0        server side public licen[cs]e(?: version| v)? 1
version busl-1.1        business source licen[cs]e(?: version| v)? 1 1
version elastic-2.0     elastic licen[cs]e(?: version| v)? 2 0
version php-3.01        php licen[cs]e(?: version| v)? 3 01
version php-3.0         php licen[cs]e(?: version| v)? 3 0
version lppl-1.3c       latex project public licen[cs]e(?: version| v)? 1 3c?
version lppl-1.2        latex project public licen[cs]e(?: version| v)? 1 2
version mulan-psl-2.0   mulan permissive software licen[cs]e(?: version| v)? 2
version cecill-2.1      cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 1
version cecill-2.0      cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 0
version ogl-uk-3.0      open government licen[cs]e(?: version| v)? 3(?: 0)?
version ogl-uk-2.0      open government licen[cs]e(?: version| v)? 2(?: 0)?
version odbl-1.0        open (?:data commons open )?database licen[cs]e(?: odbl)?(?: version| v)? 1 0
version odc-by-1.0      open data commons attribution licen[cs]e(?: version| v)? 1 0
version 0bsd            bsd (?:zero|0) clause(?: licen[cs]e)?
version 0bsd            (?:zero|0) clause bsd(?: licen[cs]e)?
version bsd-2-clause    bsd (?:2|two) clause(?: licen[cs]e)?
version bsd-2-clause    (?:2|two) clause bsd(?: licen[cs]e)?
version bsd-2-clause    (?:simplified bsd|freebsd) license
version bsd-3-clause    bsd (?:3|three) clause(?: licen[cs]e)?
version bsd-3-clause    (?:3|three) clause bsd(?: licen[cs]e)?
version bsd-3-clause    (?:new|revised|modified) bsd licen[cs]e
version bsd-4-clause    bsd (?:4|four) clause(?: licen[cs]e)?
version bsd-4-clause    (?:4|four) clause bsd(?: licen[cs]e)?
version bsd-4-clause    (?:original|old) bsd licen[cs]e
version mit-0           mit no attribution(?: licen[cs]e)?
version cc0-1.0         cc0 1 0(?: universal)?
version cc0-1.0         creative commons (?:zero|cc0)(?: v)? ?1 0(?: universal)?
version cc-by-nc-nd-4.0 cc by nc nd 4 0
version cc-by-nc-nd-3.0 cc by nc nd 3 0
version cc-by-nc-nd-2.5 cc by nc nd 2 5
version cc-by-nc-nd-2.0 cc by nc nd 2 0
version cc-by-nc-nd-1.0 cc by nc nd 1 0
version cc-by-nc-sa-4.0 cc by nc sa 4 0
version cc-by-nc-sa-3.0 cc by nc sa 3 0
version cc-by-nc-sa-2.5 cc by nc sa 2 5
version cc-by-nc-sa-2.0 cc by nc sa 2 0
version cc-by-nc-sa-1.0 cc by nc sa 1 0
version cc-by-nc-4.0    cc by nc 4 0
version cc-by-nc-3.0    cc by nc 3 0
version cc-by-nc-2.5    cc by nc 2 5
version cc-by-nc-2.0    cc by nc 2 0
version cc-by-nc-1.0    cc by nc 1 0
version cc-by-nd-4.0    cc by nd 4 0
version cc-by-nd-3.0    cc by nd 3 0
version cc-by-nd-2.5    cc by nd 2 5
version cc-by-nd-2.0    cc by nd 2 0
version cc-by-sa-4.0    cc by sa 4 0
version cc-by-sa-3.0    cc by sa 3 0
version cc-by-sa-2.5    cc by sa 2 5
version cc-by-sa-2.0    cc by sa 2 0
version cc-by-4.0       cc by 4 0
version cc-by-3.0       cc by 3 0
version cc-by-2.5       cc by 2 5
version cc-by-2.0       cc by 2 0
version cc-by-1.0       cc by 1 0
version cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 4 0
version cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0
version cc-by-nc-4.0    creative commons attribution non ?commercial 4 0
version cc-by-nd-4.0    creative commons attribution no ?deriv(?:ative)?s?(?: works)? 4 0
version cc-by-sa-4.0    creative commons attribution share ?alike 4 0
version cc-by-4.0       creative commons attribution 4 0
version cc-by-nc-nd-3.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 3 0
version cc-by-nc-sa-3.0 creative commons attribution non ?commercial share ?alike 3 0
version cc-by-nc-3.0    creative commons attribution non ?commercial 3 0
version cc-by-nd-3.0    creative commons attribution no ?deriv(?:ative)?s?(?: works)? 3 0
version cc-by-sa-3.0    creative commons attribution share ?alike 3 0
version cc-by-3.0       creative commons attribution 3 0
name   lgpl             gnu lesser general public licen[cs]e
name   lgpl             gnu library general public licen[cs]e
name   agpl             (?:gnu )?affero general public licen[cs]e
name   gpl              gnu general public licence
name   gpl              gnu public licen[cs]e
name   gpl              general public licen[cs]e
name   gfdl             (?:gnu )?free documentation licen[cs]e
name   apache           apache (?:software|public) licen[cs]e
name   apache           apache licence
name   mit              mit licence
name   mit              expat licen[cs]e
name   mit              (?:mit )?x11 licen[cs]e
name   bsd              berkeley software distribution licen[cs]e
name   bsd              bsd(?: style)? licen[cs]e
name   isc              isc licen[cs]e
name   isc              internet systems consortium licen[cs]e
name   mpl              mozilla public licen[cs]e
name   npl              netscape public licen[cs]e
name   epl              eclipse public licen[cs]e
name   edl              eclipse distribution licen[cs]e
name   eupl             european union public licen[cs]e
name   cddl             common development and distribution licen[cs]e
name   cpl              common public licen[cs]e
name   ipl              ibm public licen[cs]e
name   artistic         (?:perl )?artistic licen[cs]e
name   afl              academic free licen[cs]e
name   osl              open software licen[cs]e
name   ecl              educational community licen[cs]e
name   boost            boost software licen[cs]e
name   ofl              (?:sil )?open font licen[cs]e
name   upl              universal permissive licen[cs]e
name   zpl              zope public licen[cs]e
name   sspl             server side public licen[cs]e
name   busl             business source licen[cs]e
name   elastic          elastic licen[cs]e
name   php              php licen[cs]e
name   python           python (?:software foundation )?licen[cs]e
name   postgresql       postgresql licen[cs]e
name   openssl          openssl licen[cs]e
name   zlib             zlib(?: libpng)? licen[cs]e
name   ncsa             university of illinois ncsa open source licen[cs]e
name   ms-pl            microsoft public licen[cs]e
name   ms-rl            microsoft reciprocal licen[cs]e
name   lppl             latex project public licen[cs]e
name   mulan-psl        mulan permissive software licen[cs]e
name   wtfpl            do what the fuck you want to public licen[cs]e
name   beerware         beer ?ware licen[cs]e
name   unlicense        the unlicense
name   vim              vim licen[cs]e
name   qpl              q public licen[cs]e
name   ogl-uk           open government licen[cs]e
name   odbl             open database licen[cs]e
name   odc-by           open data commons attribution licen[cs]e
name   pddl             public domain dedication and licen[cs]e
name   commons-clause   commons clause licen[cs]e condition
name   sleepycat        sleepycat licen[cs]e
name   ruby             ruby licen[cs]e
name   curl             curl licen[cs]e
name   cc0              creative commons zero
name   cc0              cc0
name   cc-by-nc-nd      cc by nc nd
name   cc-by-nc-sa      cc by nc sa
name   cc-by-nc         cc by nc
name   cc-by-nd         cc by nd
name   cc-by-sa         cc by sa
name   cc-by-nc-nd      creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
name   cc-by-nc-sa      creative commons attribution non ?commercial share ?alike
name   cc-by-nc         creative commons attribution non ?commercial
name   cc-by-nd         creative commons attribution no ?deriv(?:ative)?s?(?: works)?
name   cc-by-sa         creative commons attribution share ?alike
name   cc-by            creative commons attribution
name   public-domain    public domain dedication
loose  gpl-3.0          gplv3
loose  gpl-3.0          gpl v?3(?: 0)?
loose  gpl-2.0          gplv2
loose  gpl-2.0          gpl v?2(?: 0)?
loose  lgpl-3.0         lgplv3
loose  lgpl-3.0         lgpl v?3(?: 0)?
loose  lgpl-2.1         lgplv2 1
loose  lgpl-2.1         lgpl v?2 1
loose  agpl-3.0         agplv3
loose  agpl-3.0         agpl v?3(?: 0)?
loose  apache-2.0       apache v?2 0
loose  mpl-2.0          mpl v?2 0
loose  epl-2.0          epl v?2 0
loose  gpl              (?:under|gnu) (?:the )?gpl
loose  lgpl             (?:under|gnu) (?:the )?lgpl
loose  agpl             (?:under|gnu) (?:the )?agpl
loose  bsd              under (?:the |a )?bsd
loose  bsd              license bsd
loose  mit              licensed under (?:the )?mit
loose  mit              license mit
loose  wtfpl            wtfpl
loose  creative-commons creative commons licen[cs]e
loose  public-domain    in the public domain
loose  proprietary      all rights reserved
loose  copyleft         copyleft
"""


#: the begin of words that most patterns hold in one form or another
STEM = " licen"

#: parts that prose often holds: no rule is opened by one if it has another
ORDINARY = {f" {w} " for w in "by clause conditions contributors developed distribute documents met permitted provided scripts software the under without".split()}


class Rule(NamedTuple):
    order: int
    kind: str
    label: str
    pattern: str
    parts: list[str]
    gate: str


def required_parts(pattern: str) -> list[str]:
    """Words between spaces that every match of ``pattern`` holds: those outside groups and without special signs. Forms of
    "license" count as their common begin."""

    def beside(group: re.Match) -> str:
        # a group parts words where all its forms begin, or end, with a space; elsewhere it is a part of the word beside it
        forms = group[1].split("|")
        return " " * all(f.startswith(" ") for f in forms) + "#" + " " * all(f.endswith(" ") for f in forms)

    flat = pattern.replace(" ?", "#")
    while "(" in flat:
        flat = re.sub(r"\(\?:([^()]*)\)\??", beside, flat)
    words = flat.split()
    plain = {f" {w} " for w in words if re.fullmatch("[a-z0-9]+", w) and not w.startswith("licen")}
    return sorted(plain | {STEM for w in words if w.startswith("licen")})


def gate_part(parts: list[str]) -> str:
    """The part of a rule that must be there before the others are looked for."""
    return max(parts, key=lambda w: (w == STEM, w not in ORDINARY, len(w)))


def in_word_text(pattern: str) -> str:
    """``pattern`` for texts in which a space stands before and after each word."""
    return " " + pattern.replace(" ?", "(?:\t)?").replace(" ", "  ").replace("\t", "  ") + " "


def rules() -> list[Rule]:
    """The base phrases as the first rules, then the others."""
    lines = [("name", label, phrase) for phrase, label in BASE.items()]
    lines += [tuple(line.split(None, 2)) for line in RULES.strip().splitlines()]
    held = [(kind, label, in_word_text(p), required_parts(p)) for kind, label, p in lines]
    return [Rule(i, kind, label, p, parts, gate_part(parts)) for i, (kind, label, p, parts) in enumerate(held)]
