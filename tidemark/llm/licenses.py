"""License statements in texts, found by ordered signature rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import portions, texts

# Label, SPDX identifier, name and keyword of each license, as regular expressions over lower-cased text.
# The keywords, parted by |, are plain texts without one of which the name can't match.
LICENSES = [
    ("mit", "mit", r"(?:the\s+)?mit(?:/x11)?", "mit"),
    ("mit-0", "mit-0", r"mit[\s-](?:0|no\s+attribution)", "mit"),
    ("apache-2.0", r"apache-2\.0", r"apache(?:\s+software)?(?:\s+license)?,?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?", "apache"),
    ("apache-1.1", r"apache-1\.1", r"apache(?:\s+software)?(?:\s+license)?,?\s*(?:version\s+|v\.?\s?)?1\.1", "apache"),
    ("bsd-2-clause", "bsd-2-clause(?:-[a-z]+)?", r"(?:simplified\s+bsd|freebsd|bsd[\s-]2[\s-]clause|2[\s-]clause\s+bsd|two[\s-]clause\s+bsd)", "bsd"),
    ("bsd-3-clause", "bsd-3-clause(?:-[a-z]+)?", r"(?:new\s+bsd|revised\s+bsd|modified\s+bsd|bsd[\s-]3[\s-]clause|3[\s-]clause\s+bsd|three[\s-]clause\s+bsd)", "bsd"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:original\s+bsd|bsd[\s-]4[\s-]clause|4[\s-]clause\s+bsd|four[\s-]clause\s+bsd)", "bsd"),
    ("0bsd", "0bsd", r"(?:zero[\s-]clause\s+bsd|bsd\s+zero[\s-]clause|0bsd)", "bsd"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gpl|gnu\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?1(?:\.0)?", "gpl|gnu"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gpl|gnu\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?", "gpl|gnu"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gpl|gnu\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?3(?:\.0)?", "gpl|gnu"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:lgpl|gnu\s+(?:lesser|library)\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?(?!\.1)", "lgpl|gnu"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:lgpl|gnu\s+(?:lesser|library)\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?2\.1", "lgpl|gnu"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:lgpl|gnu\s+(?:lesser|library)\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?3(?:\.0)?", "lgpl|gnu"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:agpl|gnu\s+affero\s+general\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?3(?:\.0)?", "agpl|affero"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"(?:gfdl|gnu\s+free\s+documentation\s+license)(?:,?\s*(?:version\s+|v\.?\s?)?1\.[123])?", "gfdl|gnu"),
    ("mpl-1.1", r"mpl-1\.1", r"(?:mpl|mozilla\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?1\.1", "mpl|mozilla"),
    ("mpl-2.0", r"mpl-2\.0", r"(?:mpl|mozilla\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?", "mpl|mozilla"),
    ("epl-1.0", r"epl-1\.0", r"(?:epl|eclipse\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?1(?:\.0)?", "epl|eclipse"),
    ("epl-2.0", r"epl-2\.0", r"(?:epl|eclipse\s+public\s+license),?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?", "epl|eclipse"),
    ("cddl-1.0", r"cddl-1\.[01]", r"(?:cddl|common\s+development\s+and\s+distribution\s+license)(?:,?\s*(?:version\s+|v\.?\s?)?1\.[01])?", "cddl|development"),
    ("cpl-1.0", r"cpl-1\.0", r"common\s+public\s+license(?:,?\s*(?:version\s+|v\.?\s?)?1\.0)?", "common"),
    ("eupl-1.1", r"eupl-1\.1", r"(?:eupl|european\s+union\s+public\s+licen[cs]e),?\s*(?:version\s+|v\.?\s?)?1\.1", "eu"),
    ("eupl-1.2", r"eupl-1\.2", r"(?:eupl|european\s+union\s+public\s+licen[cs]e),?\s*(?:version\s+|v\.?\s?)?1\.2", "eu"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "zlib"),
    ("libpng", "libpng(?:-2\\.0)?", "libpng", "libpng"),
    ("bsl-1.0", r"bsl-1\.0", r"boost\s+software\s+license(?:,?\s*(?:version\s+|v\.?\s?)?1\.0)?", "boost"),
    ("busl-1.1", r"busl-1\.1", r"business\s+source\s+license(?:,?\s*(?:version\s+|v\.?\s?)?1\.1)?", "business"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"(?:wtfpl|do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+license)", "wtfpl|want"),
    ("artistic-1.0", r"artistic-1\.0(?:-perl)?", r"artistic\s+license,?\s*(?:version\s+|v\.?\s?)?1(?:\.0)?", "artistic"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic\s+license,?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?", "artistic"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil\s+)?open\s+font\s+license(?:,?\s*(?:version\s+|v\.?\s?)?1\.1)?", "font"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"(?:psf|python\s+software\s+foundation)(?:\s+license)?(?:,?\s*(?:version\s+|v\.?\s?)?2(?:\.0)?)?", "psf|python"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ms-pl", "ms-pl", r"(?:ms-pl|microsoft\s+public\s+license)", "ms-pl|microsoft"),
    ("ms-rl", "ms-rl", r"(?:ms-rl|microsoft\s+reciprocal\s+license)", "ms-rl|microsoft"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?", "ncsa"),
    ("upl-1.0", r"upl-1\.0", r"universal\s+permissive\s+license(?:,?\s*(?:version\s+|v\.?\s?)?1\.0)?", "permissive"),
    ("sspl-1.0", r"sspl-1\.0", r"(?:sspl|server\s+side\s+public\s+license)(?:,?\s*(?:version\s+|v\.?\s?)?1)?", "sspl|server"),
    ("odbl-1.0", r"odbl-1\.0", r"(?:odbl|open\s+database\s+license)(?:,?\s*(?:version\s+|v\.?\s?)?1\.0)?", "odbl|database"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:cc0|creative\s+commons\s+zero)(?:\s*1\.0)?", "cc0|creative"),
    ("cc-by", r"cc-by-[1-4]\.[05]", r"(?:cc[\s-]by|creative\s+commons\s+attribution)(?![\s-](?:nc|nd|sa|non|no|share))(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
    ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", r"(?:cc[\s-]by[\s-]sa|creative\s+commons\s+attribution[\s-]share[\s-]?alike)(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
    ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", r"(?:cc[\s-]by[\s-]nd|creative\s+commons\s+attribution[\s-]no[\s-]?deriv\w+)(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
    ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", r"(?:cc[\s-]by[\s-]nc|creative\s+commons\s+attribution[\s-]non[\s-]?commercial)(?![\s-](?:nd|sa|no|share))(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", r"(?:cc[\s-]by[\s-]nc[\s-]sa|creative\s+commons\s+attribution[\s-]non[\s-]?commercial[\s-]share[\s-]?alike)(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", r"(?:cc[\s-]by[\s-]nc[\s-]nd|creative\s+commons\s+attribution[\s-]non[\s-]?commercial[\s-]no[\s-]?deriv\w+)(?:\s*(?:version\s+|v\.?\s?)?[1-4]\.[05])?", "cc|creative"),
]

# The forms in which a license is named, most telling first: form, how its pattern begins, the rest of it,
# keywords, confidence. A text in which the beginning isn't found holds no match of the form.
FORMS = [
    ("tag", "", r"spdx-license-identifier:\s*{id}\b", "spdx-license-identifier", 0.99),
    ("grant", r"(?:re)?(?:licensed|released|distributed|published|available|provided|covered|redistributed?|use[d]?)\s+(?:by|under)\s+", r"(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?{name}\b", "by|under", 0.95),
    ("title", "", r"\b{name}\s+licen[cs]e\b", "licen", 0.8),
    ("field", "", r"\blicen[cs]e[sd]?\s*[:=(]\s*[\"']?(?:the\s+)?{name}\b", "licen", 0.85),
    ("pointer", r"\b(?:see|copy\s+of|conditions\s+of|subject\s+to|compatible\s+with|governed\s+by)\s+", r"(?:the\s+)?{name}\b", "see|copy|conditions|subject|compatible|governed", 0.6),
]

# Statements with wording of their own: label, pattern, keywords, confidence.
STATEMENTS = [
    ("mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", "hereby", 0.97),
    ("mit", r"\bmit[^a-z0-9]+license\b", "license", 0.8),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", "permission", 0.95),
    ("bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", "redistribution", 0.9),
    ("bsd-3-clause", r"neither\s+the\s+names?\s+of\s+(?s:.{1,120}?)\s+may\s+be\s+used\s+to\s+endorse", "endorse", 0.9),
    ("bsd-4-clause", r"all\s+advertising\s+materials\s+mentioning\s+features", "advertising", 0.95),
    ("apache", r"\bapache[^a-z0-9]+license\b", "apache", 0.8),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org", 0.97),
    ("gpl", r"\bgeneral[^a-z0-9]+public[^a-z0-9]+license\b", "public", 0.8),
    ("gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl", "gnu.org", 0.9),
    ("lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", "gnu.org", 0.9),
    ("agpl", r"gnu\.org/licenses/agpl", "gnu.org", 0.9),
    ("lgpl", r"\b(?:lesser|library)\s+general\s+public\s+license\b", "lesser|library", 0.85),
    ("agpl", r"\baffero\s+general\s+public\s+license\b", "affero", 0.85),
    ("gpl-2.0", r"either\s+version\s+2\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)", "option)", 0.9),
    ("gpl-3.0", r"either\s+version\s+3\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)", "option)", 0.9),
    ("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla.org", 0.97),
    ("bsl-1.0", r"boost\.org/license_1_0\.txt", "boost.org", 0.97),
    ("unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", "unencumbered", 0.99),
    ("public-domain", r"\b(?:dedicated|released|placed)\s+(?:in)?to\s+the\s+public\s+domain\b", "domain", 0.9),
    ("public-domain", r"\bin\s+the\s+public\s+domain\b", "domain", 0.6),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org", 0.97),
    ("cc-by", r"creativecommons\.org/licenses/by/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", "creativecommons.org", 0.97),
    ("proprietary", r"\ball\s+rights\s+reserved\b", "reserved", 0.5),
    ("proprietary", r"\b(?:unauthori[sz]ed\s+(?:copying|reproduction|distribution)|may\s+not\s+be\s+(?:copied|reproduced|redistributed)\s+without)\b", "unauthori|copied|reproduced|redistributed", 0.7),
    ("copyright", r"\bcopyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d\b", "copyright", 0.4),
]

# Sentences of license texts and notices: label, words, confidence. Between words may stand white space and
# the marks that begin lines of comments.
SENTENCES = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge", 0.97),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability", 0.7),
    ("mit", "dual licensed under the mit and gpl", 0.9),
    ("mit", "dual licensed under the mit or gpl", 0.9),
    ("mit", "use of this source code is governed by an mit-style license", 0.95),
    ("x11", "in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization", 0.9),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", 0.97),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("ncsa", "to deal with the software without restriction, including without limitation the rights to use, copy, modify, merge", 0.9),
    ("json", "the software shall be used for good, not evil", 0.99),
    ("apache-2.0", "you may not use this file except in compliance with the license", 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing, software distributed under the license", 0.9),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", 0.85),
    ("apache-2.0", "licensed to the apache software foundation (asf) under one or more contributor license agreements", 0.95),
    ("apache-2.0", "each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license", 0.95),
    ("apache", "this product includes software developed by the apache software foundation", 0.8),
    ("bsd", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", 0.9),
    ("bsd", "use of this source code is governed by a bsd-style license", 0.95),
    ("bsd", "this software is provided by the copyright holders and contributors", 0.7),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors", 0.8),
    ("bsd-4-clause", "this product includes software developed by the university of california", 0.9),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 0.97),
    ("gpl", "you can redistribute it and/or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "you should have received a copy of the gnu general public license along with this", 0.95),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.7),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", 0.6),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", 0.97),
    ("gpl-3.0", "the gnu general public license is a free, copyleft license for software and other kinds of works", 0.97),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the gnu lesser general public license", 0.95),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this", 0.95),
    ("lgpl-2.0", "you can redistribute it and/or modify it under the terms of the gnu library general public license", 0.95),
    ("lgpl-2.1", "this license, the lesser general public license, applies to some specially designated software packages", 0.97),
    ("lgpl-3.0", "lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 0.97),
    ("agpl", "you can redistribute it and/or modify it under the terms of the gnu affero general public license", 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this", 0.95),
    ("agpl-3.0", "the gnu affero general public license is a free, copyleft license for software and other kinds of works", 0.97),
    ("gpl-with-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", 0.9),
    ("gpl-with-exception", "give you permission to link this library with independent modules to produce an executable", 0.9),
    ("gpl-with-exception", "the gcc runtime library exception", 0.9),
    ("gfdl", "the purpose of this license is to make a manual, textbook, or other functional and useful document", 0.97),
    ("gfdl", "with no invariant sections, no front-cover texts, and no back-cover texts", 0.97),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1.1", 0.97),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0", 0.99),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file, you can obtain one at", 0.95),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license", 0.97),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", 0.97),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", 0.97),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 0.97),
    ("eupl", "licensed under the eupl", 0.95),
    ("osl-3.0", "licensed under the open software license version 3.0", 0.97),
    ("afl-3.0", "licensed under the academic free license version 3.0", 0.97),
    ("ecl-2.0", "licensed under the educational community license, version 2.0", 0.97),
    ("apsl", "apple public source license", 0.85),
    ("ipl-1.0", "ibm public license", 0.85),
    ("zpl", "zope public license", 0.85),
    ("mulanpsl-2.0", "mulan psl v2", 0.95),
    ("cecill", "this software is governed by the cecill", 0.97),
    ("lppl", "under the conditions of the latex project public license", 0.97),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "the origin of this software must not be misrepresented; you must not claim that you wrote the original software", 0.95),
    ("zlib", "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", 0.95),
    ("libpng", "the png reference library is supplied", 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 0.95),
    ("bsl-1.0", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.97),
    ("bsl-1.0", "solely in the form of machine-executable object code generated by a source language processor", 0.97),
    ("busl-1.1", "create derivative works, redistribute, and make non-production use of the licensed work", 0.97),
    ("unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", 0.97),
    ("unlicense", "dedicate any and all copyright interest in the software to the public domain", 0.95),
    ("wtfpl", "verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", 0.99),
    ("beerware", "you can buy me a beer in return", 0.97),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic-2.0", "the terms under which a given free software package may be copied, modified, distributed, and/or redistributed", 0.95),
    ("artistic", "under the same terms as perl itself", 0.9),
    ("artistic", "either the gnu general public license or the artistic license", 0.9),
    ("ofl-1.1", "this font software is licensed under the sil open font license", 0.99),
    ("ofl-1.1", "can be bundled, embedded, redistributed and/or sold with any software", 0.95),
    ("python-2.0", "python software foundation license version 2", 0.95),
    ("python-2.0", "psf is making python available to licensee on an", 0.95),
    ("postgresql", "for any purpose, without fee, and without a written agreement is hereby granted", 0.95),
    ("hpnd", "this software and its documentation for any purpose and without fee is hereby granted", 0.95),
    ("hpnd", "this software and its documentation for any purpose is hereby granted without fee", 0.95),
    ("ms-pl", "this license governs use of the accompanying software. if you use the software, you accept this license", 0.9),
    ("upl-1.0", "the software, associated documentation and/or data (collectively the", 0.9),
    ("openssl", "this product includes software developed by the openssl project", 0.95),
    ("openssl", "this product includes cryptographic software written by eric young", 0.95),
    ("php-3.01", "this product includes php software, freely available from", 0.97),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", 0.9),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", 0.97),
    ("w3c", "by obtaining, using and/or copying this work, you (the licensee) agree", 0.95),
    ("unicode", "to any person obtaining a copy of the unicode data files", 0.97),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", 0.97),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", 0.97),
    ("commons-clause", "does not grant to you, the right to sell the software", 0.97),
    ("odbl-1.0", "is a license agreement intended to allow users to freely share, modify, and use this database", 0.97),
    ("cc", "you accept and agree to be bound by the terms and conditions of this creative commons", 0.95),
    ("cc", "is provided under the terms of this creative commons public license", 0.95),
    ("cc", "some rights reserved", 0.5),
    ("cc0-1.0", "has dedicated the work to the public domain by waiving all", 0.97),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights", 0.95),
    ("public-domain", "not subject to copyright protection", 0.6),
    ("public-domain", "this software was developed at the national institute of standards and technology", 0.7),
    ("openrail", "creative ml openrail-m", 0.97),
    ("llama", "llama 2 community license", 0.95),
    ("llama", "llama 3 community license", 0.95),
    ("noncommercial", "for non-commercial use only", 0.7),
    ("noncommercial", "for noncommercial use only", 0.7),
    ("noncommercial", "for personal and non-commercial use", 0.7),
    ("noncommercial", "for academic and research use only", 0.7),
    ("eula", "end user license agreement", 0.8),
    ("eula", "end-user license agreement", 0.8),
    ("eula", "by installing, copying, or otherwise using the software", 0.8),
    ("eula", "you may not reverse engineer, decompile, or disassemble", 0.8),
    ("proprietary", "microsoft software license terms", 0.8),
    ("proprietary", "no part of this publication may be reproduced", 0.9),
    ("proprietary", "without the prior written permission of the publisher", 0.8),
    ("proprietary", "this software is confidential and proprietary", 0.9),
    ("proprietary", "confidential and proprietary information of", 0.8),
]
#: What may stand between the words of a sentence.
GAP = r"[\s*#/%;]+"

# The phrases that name the three base labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Rule:
    """Smaller priorities win. The pattern matches only texts that hold a keyword (parted by |) of each set and, somewhere,
    the head."""

    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    head: str
    pattern: re.Pattern
    confidence: float


def sentence(words: str) -> tuple[tuple[str, ...], str]:
    """Keywords and pattern of a sentence: its three longest words are plain parts of each match."""
    parts = words.split()
    edge = r"\b" if parts[-1][-1].isalnum() else ""
    return tuple(sorted(set(parts), key=lambda x: (-len(x), x))[:3]), r"\b" + GAP.join(map(re.escape, parts)) + edge


@functools.cache
def rules() -> list[Rule]:
    """In order of priority, the surer first; of equally sure ones statements and sentences with their own wording, then every license in every form."""
    found = [(f"statement-{k}", label, (keyword,), "", pattern, confidence) for k, (label, pattern, keyword, confidence) in enumerate(STATEMENTS)]
    for k, (label, words, confidence) in enumerate(SENTENCES):
        keys, pattern = sentence(words)
        found.append((f"sentence-{k}", label, keys, "", pattern, confidence))
    for form, head, rest, keyword, confidence in FORMS:
        for label, spdx, name, own in LICENSES:
            keys = (keyword,) if form == "tag" else (keyword, own)
            found.append((f"{form}-{label}", label, keys, head, head + rest.replace("{id}", spdx).replace("{name}", name), confidence))
    order = sorted(range(len(found)), key=lambda k: (-found[k][5], k))
    return [Rule(name, label, place, keys, head, re.compile(pattern), confidence) for place, (name, label, keys, head, pattern, confidence) in enumerate(found[k] for k in order)]


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that stay, by start. First those go that lie in a longer one, or in an equal one of
    smaller priority: taken by start, and the longer first, one lies in an earlier one when its end isn't beyond the
    furthest end so far. What is left overlaps in part at most; of two such with different labels the one of smaller
    priority stays, judged from the smallest priority on, so that one that goes suppresses none."""
    outer, furthest = [], -1
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], x[2].priority)):
        if end > furthest:
            outer.append((start, end, rule))
            furthest = end
    stays = [False] * len(outer)
    for k in sorted(range(len(outer)), key=lambda k: (outer[k][2].priority, k)):
        start, end, rule = outer[k]
        # Starts and ends both rise, so those that overlap stand next to it on either side.
        left, right = k - 1, k + 1
        free = True
        while free and left >= 0 and outer[left][1] > start:
            free = not stays[left] or outer[left][2].label == rule.label
            left -= 1
        while free and right < len(outer) and outer[right][0] < end:
            free = not stays[right] or outer[right][2].label == rule.label
            right += 1
        stays[k] = free
    return [x for x, stay in zip(outer, stays, strict=True) if stay]


def detect(lowered: str) -> list[tuple[int, int, Rule]]:
    """What the rules find in an A-Z lower-cased text and isn't suppressed: rules whose keywords or head the text lacks aren't tried."""
    has: dict[str, bool] = {}
    begins: dict[str, bool] = {"": True}
    found = []
    for rule in rules():
        for key in rule.keywords:
            if key not in has:
                has[key] = any(x in lowered for x in key.split("|"))
            if not has[key]:
                break
        else:
            if rule.head not in begins:
                begins[rule.head] = re.search(rule.head, lowered) is not None
            if begins[rule.head]:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(lowered)]
    return suppress(found)


IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
EDGE = rb"[0-9a-z\x80-\xff]"
BASE = [(re.compile(rb"(?<!" + EDGE + rb")" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(phrase.encode().split()) + rb"(?!" + EDGE + rb")"), label) for phrase, label in PHRASES]


def scan_text(text: str) -> dict:
    """n_words, the places of base phrases in words, detections (in characters), labels and confidence of one text."""
    data = text.encode("utf-8", "surrogatepass").lower()
    word = IS_WORD[np.frombuffer(data, np.uint8)]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    base = [(m.start(), label) for pattern, label in BASE for m in pattern.finditer(data)] if b"license" in data else []
    places = []
    if base:
        before = np.cumsum(starts)
        places = [int(before[at]) - 1 for at, _ in base]
    found = detect(data.decode("utf-8", "surrogatepass"))
    names = {label for _, label in base}
    doubt = 1.0
    for _, _, rule in found:
        doubt *= 1 - rule.confidence
    return {
        "n_words": int(np.count_nonzero(starts)),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(names)),
        "labels": ",".join(sorted(names | {rule.label for _, _, rule in found})),
        "score": max(1 - doubt, 0.9 if base else 0.0),
        "detections": [{"start": a, "end": b, "rule": rule.name, "label": rule.label, "confidence": rule.confidence} for a, b, rule in found],
    }


DETECTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("label", pa.string()), ("confidence", pa.float64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", DETECTIONS)])


def scan(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections. Null and empty
    texts have no words, labels '' and score 0; repeated rows and rows without doc_id are scanned like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [{"doc_id": i} | scan_text(x) for i, x in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, OUT)

    kind = "array<struct<start:long,end:long,rule:string,label:string,confidence:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections {kind}")
