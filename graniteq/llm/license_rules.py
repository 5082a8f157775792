"""Hand-written patterns for license mentions, as text.

A line has a label, words of which whatever the pattern matches has one, and the
pattern, a regular expression over words that stand one space apart. Everything
is lowered, and only letters, digits and characters beyond ASCII are words, so
"v2.0" reads "v2 0" and "author's" reads "author s".
"""

#: Wording of the licenses' own texts, and of the notices that they ask for.
TEXTS = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | restriction | to deal in the software without restriction
mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | noninfringement | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | consortium | x window system is a trademark of x consortium
ncsa | restriction | to deal with the software without restriction
ncsa | urbana | neither the names of( [^ ]+){1,20} urbana champaign nor the names of its contributors may be used to endorse
isc | permission | permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | the software is provided as is and( [^ ]+){1,6} disclaims all warranties with regard to this software
0bsd | disclaims | with or without fee is hereby granted the software is provided as is and the author disclaims all warranties
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | contributors | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-2-clause | freebsd | the views and conclusions contained in the software( [^ ]+){1,20} official policies either expressed or implied of the freebsd project
bsd-3-clause | endorse | neither the name of( [^ ]+){1,30} may be used to endorse or promote products
bsd-3-clause | endorse | the names? of( [^ ]+){1,12} may not be used to endorse or promote products derived from this software
bsd-3-clause | regents | this software is provided by the regents and contributors as is
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
bsd-3-clause-lbnl | enhancements | you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code enhancements
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-4-clause | berkeley | this product includes software developed by the university of california berkeley and its contributors
apache-1.1 | apache | this product includes software developed by the apache software foundation
apache-1.1 | apache | products derived from this software may not be called apache
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | apache | apache org licenses license 2 0
apache-2.0 | applicable | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | governing | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | reproduction | terms and conditions for use reproduction and distribution
gpl-1.0 | option | either version 1( of the license)? or at your option any later version
gpl-2.0 | option | either version 2( of the license)? or at your option any later version
gpl-3.0 | option | either version 3( of the license)? or at your option any later version
lgpl-2.1 | option | either version 2 1( of the license)? or at your option any later version
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | gnu | you should have received a copy of the gnu general public license along with this program
gpl | hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2.0 | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0 | june | gnu general public license version 2 june 1991
gpl-3.0 | june | gnu general public license version 3 29 june 2007
gpl-3.0 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | freedom | the licenses for most software and other practical works are designed to take away your freedom
lgpl | gnu | this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
lgpl | gnu | you should have received a copy of the gnu (lesser|library) general public license along with this library
lgpl | hope | this library is distributed in the hope that it will be useful but without any warranty
lgpl-2.0 | june | gnu library general public license version 2 june 1991
lgpl-2.1 | february | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | june | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | affero | you should have received a copy of the gnu affero general public license along with this program
agpl-3.0 | copyleft | the gnu affero general public license is a free copyleft license
agpl-3.0 | november | gnu affero general public license version 3 19 november 2007
agpl-3.0 | interaction | remote network interaction use with the gnu general public license
gfdl-1.3 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | invariant | with no invariant sections no front cover texts and no back cover texts
classpath-exception-2.0 | statically | linking this library statically or dynamically with other modules is making a combined work based on this library
fsfap | royalty | copying and distribution of this file with or without modification are permitted in any medium without royalty
fsful | unlimited | the free software foundation gives unlimited permission to copy and or distribute it
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | governing | see the license for the specific language governing rights and limitations under the license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible | this source code form is incompatible with secondary licenses
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license (v )?2 0
epl-1.0 | accompanying | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | accompanying | the accompanying program is provided under the terms of this common public license
cddl-1.0 | distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | opensolaris | you can obtain a copy of the license at usr src opensolaris license
cc-by-4.0 | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-4.0 | medium | share copy and redistribute the material in any medium or format
cc-by-sa-4.0 | remix | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd-4.0 | remix | if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc-4.0 | commercial | you may not use the material for commercial purposes
cc-by | creativecommons | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1234] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
cc0-1.0 | waived | to the extent possible under law( [^ ]+){1,12} has waived all copyright and related or neighboring rights
cc0-1.0 | deed | the person who associated a work with this deed has dedicated the work to the public domain
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl | fuck | you just do what the fuck you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
zlib | damages | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | anyone | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | the origin of this software must not be misrepresented
libpng | png | the png reference library is supplied as is
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | organization | granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | boost | boost org license 1 0 txt
artistic-1.0 | intent | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | artistic | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed the intent is that the artistic
perl | perl | (under|on) the same terms as perl( itself)?
ruby | ruby | (under|on) the same terms as ruby( itself)?
psf-2.0 | psf | psf license agreement for python
psf-2.0 | python | this license agreement is between the python software foundation psf and the individual or organization
postgresql | agreement | for any purpose without fee and without a written agreement is hereby granted
hpnd | documentation | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ntp | documentation | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
tcl | authors | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ofl-1.1 | font | this font software is licensed under the sil open font license
ofl-1.1 | fonts | the fonts and derivatives however cannot be released under any other type of license
ofl-1.1 | font | with reserved font name
openssl | openssl | this product includes software developed by the openssl project
ssleay | eric | this product includes cryptographic software written by eric young
json | evil | the software shall be used for good not evil
vim | charityware | vim is charityware
sleepycat | accompanied | redistributions in any form must be accompanied by information on how to obtain complete source code
w3c | licensee | by obtaining( using)?( and or copying)? this work you the licensee agree that you have read understood
ms-pl | governs | this license governs use of the accompanying software if you use the software you accept this license
lppl-1.3c | latex | this work may be distributed and or modified under the conditions of the latex project public license
lppl-1.3c | lppl | this work has the lppl maintenance status
php-3.01 | php | this product includes php software freely available from
php-3.01 | php | products derived from this software may not be called php
unicode-3.0 | unicode | unicode inc license agreement data files and software
ijg | jpeg | this software is based in part on the work of the independent jpeg group
busl-1.1 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
"""

#: Names of licenses that have no identifier in the operator's list, or whose name tells no version.
NAMES = """
bsd | bsd | bsd (style|like|type) licen[cs]e
cc | creative | creative commons licen[cs]e
cc | rights | some rights reserved
npl-1.1 | netscape | netscape public license( version)?( 1)?( 1)?
ipl-1.0 | ibm | ibm public license( version)?( 1 0)?
apsl-2.0 | apple | apple public source license( version)?( 2)?( 0)?
spl-1.0 | sun | sun public license( version)?( 1 0)?
qpl-1.0 | qpl q | (qpl|q public license)( version)?( 1 0)?
rpsl-1.0 | realnetworks | realnetworks public source license
cpal-1.0 | attribution | common public attribution license( version)?( 1 0)?
nasa-1.3 | nasa | nasa open source agreement( version)?( 1 3)?
nokia | nokia | nokia open source license
intel | intel | intel open source license
mulan-2.0 | mulan | mulan (psl|permissive software license)( v2)?( version 2)?
blueoak-1.0.0 | blueoak blue | (blueoak|blue oak) model license( 1 0 0)?
miros | miros | miros licen[cs]e
nethack | nethack | nethack general public license
apl-1.0 | adaptive | adaptive public license
aal | assurance | attribution assurance license
entessa | entessa | entessa public license
eudatagrid | datagrid | eu datagrid software license
lpl-1.02 | lucent | lucent public license( version)?( 1 02)?
rscpl | ricoh | ricoh source code public license
watcom-1.0 | watcom | sybase open watcom public license
vsl-1.0 | vovida | vovida software license
sleepycat | sleepycat | sleepycat( public)? license
ruby | ruby | ruby( s)? license
beerware | beerware beer | (beerware|beer ware license)
imagemagick | imagemagick | imagemagick license
tcl | tcl | tcl tk license
zend-2.0 | zend | zend( engine)? license
edl-1.0 | eclipse | eclipse distribution license( v| version)?( 1 0)?
pddl-1.0 | dedication | (open data commons )?public domain dedication and license
odc-by-1.0 | commons | open data commons attribution license
odbl-1.0 | commons | open data commons open database license
cdla-permissive-2.0 | community | community data license agreement permissive( version)?( 2 0)?
cdla-sharing-1.0 | community | community data license agreement sharing( version)?( 1 0)?
gcc-exception-3.1 | gcc | gcc runtime library exception
classpath-exception-2.0 | classpath | classpath exception
linux-syscall-note | syscall | linux syscall note
llama-community | llama | llama( 2| 3| 3 1| 3 2)? community license
openrail | openrail rail | (creativeml |bigscience |bigcode )?(openrail|open rail)( m)?( license)?
gemma | gemma | gemma terms of use
polyform | polyform | polyform (noncommercial|shield|strict|small business|internal use|perimeter)( license)?
prosperity | prosperity | prosperity public license
parity | parity | parity public license
cal-1.0 | autonomy | cryptographic autonomy license
hippocratic | hippocratic | hippocratic license( 2 1| 3 0)?
redis | redis | redis source available license
confluent | confluent | confluent community license
timescale | timescale | timescale license
commons-clause | clause | commons clause( license)? condition
oracle-bcl | oracle | oracle binary code license agreement
microsoft | microsoft | microsoft software license terms
nvidia | nvidia | nvidia( software)? license agreement
"""

#: Notices that restrict or free a work without a license's name.
NOTICES = """
proprietary | rights | all rights reserved
proprietary | confidential | (proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | unauthorized copying( of this (file|software|document))?( via any medium)? is strictly prohibited
proprietary | proprietary | is the (confidential and )?proprietary (information|property) of
proprietary | reproduced | no part of this (publication|book|document|work) may be reproduced
proprietary | written | without( the)?( prior)?( express)? written (permission|consent)
proprietary | internal | for internal use only
eula | agreement | end user licen[cs]e agreement
noncommercial | commercial noncommercial | (non commercial|noncommercial) use only
noncommercial | commercial resale redistribution | not for (commercial use|resale|redistribution)
restricted | personal academic educational research evaluation | for (personal|academic|educational|research|evaluation) use only
freeware | freeware | (this (program|software) is )?freeware
shareware | shareware | (this (program|software) is )?shareware
dual | dual dually | (dual|dually) licen[cs]ed under
public-domain | domain | (dedicated|released|placed|donated|contributed) (in( )?to|in) the public domain
public-domain | domain | this (file|work|code|software|program) is( hereby)? in the public domain
public-domain | protection | (is )?not subject to( domestic)? copyright protection
public-domain | claimed | no copyright is claimed
"""
