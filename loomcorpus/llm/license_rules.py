"""The signature rules of the license scan.

Texts are matched as lower-case words with single spaces between them, so a full stop in "2.0" is a
space here. A row of FAMILIES is written by hand: label, the words of which one must occur before
any regex of the row is tried (every match of the name holds one; a test tries all alternatives),
and the license's name as a regex. Each gives four rules of falling priority:
the identifier tag, the grant ("licensed under ..."), the address, and the bare name. PHRASES are
single rules for wording of license texts themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_V = r"(?: license)?(?: version| v)? ?"

# label, keywords, name, identifier tag, address (words)
FAMILIES: list[tuple[str, str, str, str, str]] = [
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[cs]e", r"mit", r"opensource org licenses mit"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)(?: licen[cs]e)?", r"mit 0", r"github com aws mit 0"),
    ("x11", "x11", r"x11 licen[cs]e", r"x11", r"xfree86 org 3 3 6 copyright2"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e", r"isc", r"opensource org licenses isc"),
    ("bsd-2-clause", "bsd freebsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[cs]e)?", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", r"bsd 4 clause", r"directory fsf org wiki license bsd 4clause"),
    ("bsd-zero", "bsd 0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", r"0bsd", r"opensource org licenses 0bsd"),
    ("apache-1.0", "apache apache1", rf"apache{_V}1 0", r"apache 1 0", r"apache org licenses license 1 0"),
    ("apache-1.1", "apache apache1", rf"apache(?: software)?{_V}1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2.0", "apache apache2", rf"apache(?: software)?{_V}2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public{_V}1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public{_V}2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public{_V}3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl", "gpl gpl2 gpl3 gplv gplv2 gplv3", r"gpl ?v?[23]?", r"gpl", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2.0", "lesser library", rf"(?:gnu )?(?:library|lesser) general public{_V}2(?: 0)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public{_V}2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public{_V}3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public{_V}(?:3(?: 0)?)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl"),
    ("gfdl-1.1", "documentation documentation1", rf"(?:gnu )?free documentation{_V}1 1", r"gfdl 1 1(?: only| or later)?", r"gnu org licenses old licenses fdl 1 1"),
    ("gfdl-1.2", "documentation documentation1", rf"(?:gnu )?free documentation{_V}1 2", r"gfdl 1 2(?: only| or later)?", r"gnu org licenses old licenses fdl 1 2"),
    ("gfdl-1.3", "documentation documentation1", rf"(?:gnu )?free documentation{_V}(?:1 3)?", r"gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl"),
    ("mpl-1.0", "mozilla", rf"mozilla public{_V}1 0", r"mpl 1 0", r"mozilla org mpl mpl 1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public{_V}1 1", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public{_V}2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public{_V}1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", rf"eclipse public{_V}2(?: 0)?", r"epl 2 0", r"eclipse org legal epl (?:2 0|v20)"),
    ("cpl-1.0", "common", rf"common public{_V}1(?: 0)?", r"cpl 1 0", r"opensource org licenses cpl1 0"),
    ("cddl-1.0", "distribution distribution1", rf"common development and distribution{_V}1(?: 0)?", r"cddl 1 0", r"opensource org licenses cddl1"),
    ("cddl-1.1", "distribution distribution1", rf"common development and distribution{_V}1 1", r"cddl 1 1", r"glassfish java net public cddl"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-1.0", "cc attribution", r"(?:creative commons attribution|cc by)(?: licen[cs]e)? 1 0", r"cc by 1 0", r"creativecommons org licenses by 1 0"),
    ("cc-by-2.0", "cc attribution", r"(?:creative commons attribution|cc by)(?: licen[cs]e)? 2 0", r"cc by 2 0", r"creativecommons org licenses by 2 0"),
    ("cc-by-2.5", "cc attribution", r"(?:creative commons attribution|cc by)(?: licen[cs]e)? 2 5", r"cc by 2 5", r"creativecommons org licenses by 2 5"),
    ("cc-by-3.0", "cc attribution", r"(?:creative commons attribution|cc by)(?: licen[cs]e)? 3 0", r"cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "cc attribution", r"(?:creative commons attribution|cc by)(?: licen[cs]e)? 4 0", r"cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-2.0", "sa attribution", r"(?:creative commons attribution share ?alike|cc by sa)(?: licen[cs]e)? 2 0", r"cc by sa 2 0", r"creativecommons org licenses by sa 2 0"),
    ("cc-by-sa-2.5", "sa attribution", r"(?:creative commons attribution share ?alike|cc by sa)(?: licen[cs]e)? 2 5", r"cc by sa 2 5", r"creativecommons org licenses by sa 2 5"),
    ("cc-by-sa-3.0", "sa attribution", r"(?:creative commons attribution share ?alike|cc by sa)(?: licen[cs]e)? 3 0", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "sa attribution", r"(?:creative commons attribution share ?alike|cc by sa)(?: licen[cs]e)? 4 0", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-3.0", "nd attribution", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: licen[cs]e)? 3 0", r"cc by nd 3 0", r"creativecommons org licenses by nd 3 0"),
    ("cc-by-nd-4.0", "nd attribution", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: licen[cs]e)? 4 0", r"cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-2.0", "nc attribution", r"(?:creative commons attribution non ?commercial|cc by nc)(?: licen[cs]e)? 2 0", r"cc by nc 2 0", r"creativecommons org licenses by nc 2 0"),
    ("cc-by-nc-3.0", "nc attribution", r"(?:creative commons attribution non ?commercial|cc by nc)(?: licen[cs]e)? 3 0", r"cc by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "nc attribution", r"(?:creative commons attribution non ?commercial|cc by nc)(?: licen[cs]e)? 4 0", r"cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-3.0", "nc attribution", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: licen[cs]e)? 3 0", r"cc by nc sa 3 0", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "nc attribution", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: licen[cs]e)? 4 0", r"cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", "nc attribution", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: licen[cs]e)? 3 0", r"cc by nc nd 3 0", r"creativecommons org licenses by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "nc attribution", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: licen[cs]e)? 4 0", r"cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl fuck", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)", r"wtfpl", r"wtfpl net"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib", r"zlib net zlib license"),
    ("libpng", "libpng", r"libpng licen[cs]e", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("bsl-1.0", "boost", rf"boost software{_V}(?:1(?: 0)?)?", r"bsl 1 0", r"boost org license 1 0"),
    ("artistic-1.0", "artistic artistic1", rf"artistic{_V}1(?: 0)?", r"artistic 1 0", r"opensource org licenses artistic 1 0"),
    ("artistic-2.0", "artistic artistic2", rf"artistic{_V}2(?: 0)?", r"artistic 2 0", r"perlfoundation org artistic license 2 0"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e", r"(?:psf|python) 2 0", r"opensource org licenses python 2 0"),
    ("php-3.01", "php php3", rf"php{_V}3(?: 01?)?", r"php 3 01?", r"php net license 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", r"ruby lang org en about license"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl org source license"),
    ("ofl-1.1", "font font1", rf"(?:sil )?open font{_V}(?:1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1.0", "database database1", rf"open database{_V}(?:1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "data", rf"open data commons attribution{_V}(?:1 0)?", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", "domain", rf"public domain dedication(?: and)?{_V}(?:1 0)?", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("eupl-1.1", "european", rf"european union public{_V}1 1", r"eupl 1 1", r"joinup ec europa eu software page eupl licence eupl 1 1"),
    ("eupl-1.2", "european", rf"european union public{_V}1 2", r"eupl 1 2", r"joinup ec europa eu page eupl text 11 12"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl", r"opensource org licenses ms rl"),
    ("afl-3.0", "academic", rf"academic free{_V}(?:3(?: 0)?)?", r"afl 3 0", r"opensource org licenses afl 3 0"),
    ("osl-3.0", "open", rf"open software{_V}(?:3(?: 0)?)?", r"osl 3 0", r"opensource org licenses osl 3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", r"ncsa", r"opensource org licenses ncsa"),
    ("upl-1.0", "permissive permissive1", rf"universal permissive{_V}(?:1 0)?", r"upl 1 0", r"oss oracle com licenses upl"),
    ("vim", "vim", r"vim licen[cs]e", r"vim", r"vimdoc sourceforge net htmldoc uganda"),
    ("ecl-2.0", "educational", rf"educational community{_V}(?:2 0)?", r"ecl 2 0", r"opensource org licenses ecl 2 0"),
    ("mulan-psl-2.0", "mulan", r"mulan psl(?: v?2)?|mulan permissive software licen[cs]e", r"mulanpsl 2 0", r"license coscl org cn mulanpsl2"),
    ("sspl-1.0", "server", rf"server side public{_V}(?:1)?", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("busl-1.1", "business", rf"business source{_V}(?:1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("elastic-2.0", "elastic elastic2", rf"elastic{_V}2(?: 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("openrail", "rail openrail", r"(?:creativeml )?open ?rail(?: [ms])?(?: licen[cs]e)?", r"openrail(?: m)?", r"huggingface co spaces compvis stable diffusion license"),
]

# label, keywords, priority, confidence, words of a license's own text
PHRASES: list[tuple[str, str, int, float, str]] = [
    ("mit", "permission", 6, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 6, 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 6, 0.8, r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "neither", 6, 0.9, r"neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd-4-clause", "advertising", 6, 0.9, r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "unless", 6, 0.9, r"unless required by applicable law or agreed to in writing software"),
    ("gpl", "redistribute", 6, 0.8, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "subject", 6, 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", 6, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "provided", 6, 0.9, r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("bsl-1.0", "permission", 6, 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "fuck", 6, 0.9, r"you just do what the fuck you want to"),
    # grants
    ("apache-2.0", "apache", 6, 0.95, r"you may not use this file except in compliance with the license you may obtain a copy of the license at .{1,60}? apache org"),
    ("apache-2.0", "derivative", 5, 0.8, r"a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works"),
    ("apache-2.0", "patent", 5, 0.85, r"if you institute patent litigation against any entity including a cross claim or counterclaim"),
    ("apache-2.0", "conditions", 5, 0.9, r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "acknowledgment", 6, 0.9, r"this product includes software developed by the apache software foundation .{1,60}? alternately this acknowledgment"),
    ("apache", "apache", 3, 0.6, r"this product includes software developed (?:at|by) the apache software foundation"),
    ("mit", "substantial", 5, 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", 5, 0.85, r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", "attribution", 6, 0.9, r"mit no attribution (?:.{1,60}? )?permission is hereby granted"),
    ("x11", "consortium", 6, 0.9, r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "advertising", 5, 0.7, r"except as contained in this notice the names? of .{1,60}? shall not be used in advertising or otherwise to promote"),
    ("hpnd", "permission", 6, 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ntp", "permission", 6, 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", "consortium", 4, 0.7, r"copyright (?:.{1,40}? )?internet (?:software|systems) consortium"),
    ("zlib", "misrepresented", 5, 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 5, 0.85, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("bsl-1.0", "executable", 5, 0.85, r"in the form of machine executable object code generated by a source language processor"),
    ("curl", "curl", 6, 0.9, r"copyright and permission notice .{1,80}? daniel stenberg (?:.{1,40}? )?curl"),
    ("unlicense", "dedicate", 5, 0.9, r"dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "heirs", 5, 0.85, r"to the detriment of our heirs and successors"),
    ("cc0-1.0", "affirmer", 6, 0.9, r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", "waived", 5, 0.85, r"to the extent possible under law .{1,60}? has waived all copyright and related or neighboring rights"),
    ("public-domain", "disclaims", 4, 0.8, r"the author disclaims copyright to this source code"),
    ("blessing", "blessing", 6, 0.9, r"in place of a legal notice here is a blessing"),
    ("beerware", "beer", 6, 0.95, r"you can buy me a beer in return"),
    ("wtfpl", "everyone", 4, 0.7, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("json", "evil", 6, 0.95, r"the software shall be used for good not evil"),
    ("postcardware", "postcard", 5, 0.8, r"(?:send me a|please send a) postcard"),
    # copyleft
    ("gpl-2.0", "version", 7, 0.95, r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "version", 7, 0.95, r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "version", 7, 0.9, r"gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3.0", "version", 7, 0.9, r"gnu general public license version 3 (?:only )?as published by the free software foundation"),
    ("lgpl-2.1", "lesser", 7, 0.95, r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "lesser", 7, 0.95, r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.0", "library", 7, 0.95, r"gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("agpl-3.0", "affero", 7, 0.95, r"gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "remotely", 6, 0.85, r"all users interacting with it remotely through a computer network"),
    ("gpl", "details", 4, 0.6, r"see the gnu general public license for more details"),
    ("lgpl", "lesser", 4, 0.6, r"see the gnu lesser general public license for more details"),
    ("gpl", "franklin", 4, 0.6, r"write to the free software foundation inc (?:51|59) franklin street"),
    ("gpl-3.0", "tivoization", 3, 0.5, r"anti tivoization"),
    ("gpl-2.0", "freedom", 4, 0.7, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", 5, 0.85, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("classpath-exception", "linking", 7, 0.9, r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "runtime", 7, 0.9, r"gcc runtime library exception"),
    ("linking-exception", "exception", 6, 0.8, r"as a special exception .{1,120}? gives? permission to link"),
    ("font-exception", "font", 6, 0.85, r"as a special exception if you create a document which uses this font"),
    ("autoconf-exception", "configure", 6, 0.85, r"as a special exception .{1,80}? configure script"),
    ("bison-exception", "bison", 6, 0.85, r"as a special exception .{1,80}? bison parser skeleton"),
    ("mpl-1.1", "mozilla", 6, 0.9, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "incompatible", 6, 0.85, r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-tri", "alternatively", 6, 0.85, r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl-1.0", "eclipse", 6, 0.9, r"are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", 6, 0.9, r"are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "distribution", 6, 0.9, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "union", 6, 0.9, r"licensed under the eupl (?:.{1,80}? )?european union"),
    ("osl-3.0", "open", 6, 0.85, r"licensed under the open software license version 3 0"),
    ("ms-pl", "microsoft", 6, 0.9, r"this license governs use of the accompanying software (?:.{1,200}? )?microsoft public license"),
    ("artistic-1.0", "artistic", 6, 0.85, r"the intent of this document is to state the conditions under which a package may be copied (?:.{1,200}? )?artistic"),
    ("artistic-2.0", "package", 6, 0.85, r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", 6, 0.9, r"(?:you can redistribute it and or modify it|may be used and distributed) under the same terms as perl(?: 5)?(?: itself)?"),
    ("python-2.0", "psf", 6, 0.9, r"psf license agreement for python"),
    ("python-2.0", "beopen", 6, 0.85, r"beopen com license agreement for python"),
    ("openssl", "openssl", 6, 0.9, r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", 6, 0.9, r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", 6, 0.85, r"this product includes php software freely available from"),
    ("w3c", "w3c", 6, 0.85, r"w3c software (?:and document )?notice and license"),
    ("unicode", "unicode", 6, 0.85, r"unicode (?:inc )?license agreement data files and software"),
    ("ofl-1.1", "font", 6, 0.9, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved", 5, 0.75, r"with reserved font names?"),
    ("gfdl", "invariant", 6, 0.85, r"with no invariant sections no front cover texts and no back cover texts"),
    # disclaimers and notices, which many licenses share
    ("bsd", "copyright", 5, 0.8, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "binary", 5, 0.8, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "regents", 5, 0.8, r"this software is provided by the (?:regents|regents of the university) and contributors"),
    ("bsd", "holders", 4, 0.7, r"this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", "endorse", 5, 0.85, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledgement", 5, 0.85, r"must display the following acknowledgement this product includes software developed by"),
    ("bsd-patent", "patent", 6, 0.85, r"each copyright holder and contributor hereby grants (?:.{1,120}? )?patent license"),
    ("mit", "noninfringement", 3, 0.5, r"fitness for a particular purpose and noninfringement"),
    # terms that restrict
    ("cc-by", "attribution", 4, 0.6, r"you must give appropriate credit provide a link to the license and indicate if changes were made (?:.{1,200}? )?attribution"),
    ("cc-by-nc", "noncommercial", 4, 0.7, r"you may not use the material for commercial purposes (?:.{1,200}? )?noncommercial"),
    ("cc-by-nd", "derivatives", 4, 0.7, r"if you remix transform or build upon the material you may not distribute the modified material (?:.{1,200}? )?derivatives"),
    ("bsl-1.1", "licensor", 6, 0.85, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl-1.0", "service", 6, 0.85, r"making the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", 6, 0.85, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", 6, 0.85, r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", 6, 0.85, r"polyform (?:noncommercial|small business|shield|strict|perimeter) license"),
    ("responsible-ai", "restrictions", 5, 0.75, r"use based restrictions as referenced in paragraph 5"),
    ("proprietary", "unauthorized", 3, 0.7, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade", 3, 0.7, r"contains (?:confidential information and )?trade secrets of"),
    ("proprietary", "evaluation", 3, 0.6, r"for evaluation purposes only"),
    ("proprietary", "reverse", 3, 0.6, r"you may not reverse engineer decompile or disassemble"),
    ("proprietary", "eula", 3, 0.6, r"end user licen[cs]e agreement eula"),
    ("proprietary", "permission", 2, 0.5, r"may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:express )?written permission"),
    ("non-commercial", "commercial", 2, 0.5, r"for non commercial use only"),
    ("academic", "research", 2, 0.5, r"for (?:academic|educational) and research purposes only"),
    ("public-domain", "domain", 2, 0.6, r"(?:released|placed|dedicated|is) (?:in ?to|in|to) the public domain"),
    ("proprietary", "reserved", 1, 0.4, r"all rights reserved"),
    ("proprietary", "confidential", 2, 0.6, r"proprietary and confidential"),
    ("cc", "creative", 1, 0.5, r"creative commons(?: licen[cs]e)?"),
    ("mit", "mit", 1, 0.6, r"mit licen[cs]e"),
    ("apache", "apache", 1, 0.6, r"apache licen[cs]e"),
    ("gpl", "public", 1, 0.6, r"general public licen[cs]e"),
]

_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered)(?: to you)?(?: under| by| with)(?: the)?(?: terms of)?(?: the)? "
_BARE = {"x11", "isc", "ruby", "vim", "gpl"}


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    pattern: re.Pattern[str]


def _rule(label: str, keywords: str, priority: int, confidence: float, words: str) -> Rule:
    return Rule(label, tuple(keywords.split()), priority, confidence, re.compile(rf"(?<!\S)(?:{words})(?!\S)"))


def rules() -> list[Rule]:
    """All rules in order of falling priority; ties keep the order of the tables."""
    out = []
    for label, keywords, name, tag, address in FAMILIES:
        out.append(_rule(label, "spdx", 9, 0.99, rf"spdx license identifier (?:{tag})"))
        out.append(_rule(label, keywords, 8, 0.95, rf"{_GRANT}(?:{name})"))
        out.append(_rule(label, address.split()[0].strip("(?:"), 7, 0.85, rf"(?:https? )?(?:www )?(?:{address})"))
        if label not in _BARE:
            out.append(_rule(label, keywords, 4, 0.7, name))
    out += [_rule(*row) for row in PHRASES]
    return sorted(out, key=lambda r: -r.priority)
