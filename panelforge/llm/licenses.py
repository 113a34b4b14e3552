"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z only) and read as UTF-8 bytes, where every byte of a non-ASCII character
is a word byte. Base phrases are found first. Then come two sets of regular expressions: 217
signatures written one by one, and the names of each license in several ways of stating them. A rule
runs only where its keyword occurs. Detections are taken in order of priority, then length, then place;
one whose interval lies within an accepted one is suppressed, so that "gnu lesser general public license
version 3" does not also count as the plain GPL.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import documents, map_arrow

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
EDGE, END = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
#: Phrases whose labels are always reported.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: label | names ("/" between alternatives, a name is a regular expression over lower case, blank = any gap)
FAMILIES = """
mit|mit/expat
apache-2.0|apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?/asl 2(?: 0)?
apache-1.1|apache(?: software)?(?: license)? (?:version |v )?1 1
gpl-3.0|gnu general public license (?:version |v )?3(?: 0)?/gnu gpl ?(?:version |v)?3(?: 0)?/gpl ?v?3(?: 0)?
gpl-2.0|gnu general public license (?:version |v )?2(?: 0)?/gnu gpl ?(?:version |v)?2(?: 0)?/gpl ?v?2(?: 0)?
lgpl-3.0|gnu lesser general public license (?:version |v )?3(?: 0)?/lgpl ?v?3(?: 0)?
lgpl-2.1|gnu lesser general public license (?:version |v )?2 1/lgpl ?v?2 1
agpl-3.0|gnu affero general public license(?: (?:version |v )?3(?: 0)?)?/agpl ?v?3(?: 0)?
gfdl|gnu free documentation license/gfdl
bsd-2-clause|bsd 2 clause/simplified bsd/freebsd
bsd-3-clause|bsd 3 clause/new bsd/modified bsd/revised bsd
bsd-4-clause|bsd 4 clause/original bsd
bsd-0-clause|0bsd/zero clause bsd
isc|isc
mpl-2.0|mozilla public license (?:version |v )?2(?: 0)?/mpl 2(?: 0)?
mpl-1.1|mozilla public license (?:version |v )?1 1/mpl 1 1
epl-2.0|eclipse public license (?:version |v )?2(?: 0)?/epl 2(?: 0)?
epl-1.0|eclipse public license (?:version |v )?1(?: 0)?/epl 1(?: 0)?
cddl-1.0|common development and distribution license/cddl
cpl-1.0|common public license/cpl 1 0
artistic-2.0|artistic license 2(?: 0)?/perl artistic
zlib|zlib/zlib libpng
boost-1.0|boost software license/bsl 1 0
unlicense|unlicense
wtfpl|do what the fuck you want to public license/wtfpl
eupl-1.2|european union public licen[cs]e/eupl
ofl-1.1|sil open font license/ofl 1 1
openssl|openssl
python-2.0|python software foundation license/psf license
php-3.01|php license
ruby|ruby license
postgresql|postgresql license
ms-pl|microsoft public license/ms pl
ms-rl|microsoft reciprocal license/ms rl
upl-1.0|universal permissive license
ncsa|university of illinois ncsa/ncsa open source
afl-3.0|academic free license
osl-3.0|open software license
qpl-1.0|q public license
lppl|latex project public license/lppl
vim|vim license
beerware|beer ?ware
json|json license
odbl-1.0|open database license/odbl
pddl-1.0|public domain dedication and license/pddl
odc-by-1.0|open data commons attribution
cc0-1.0|cc0(?: 1 0)?/creative commons zero
cc-by-nc-nd|cc by nc nd(?: [1-4] 0)?/creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)
cc-by-nc-sa|cc by nc sa(?: [1-4] 0)?/creative commons attribution non ?commercial share ?alike
cc-by-nc|cc by nc(?: [1-4] 0)?/creative commons attribution non ?commercial
cc-by-nd|cc by nd(?: [1-4] 0)?/creative commons attribution no ?deriv(?:ative|s|atives)
cc-by-sa|cc by sa(?: [1-4] 0)?/creative commons attribution share ?alike
cc-by|cc by(?: [1-4] 0)?/creative commons attribution
""".strip()
#: Ways of stating a license: (pattern around the name, priority, weight); fixed here.
FORMS = (
    ("spdx license identifier {}", 0, 0.99),
    ("licensed under (?:the )?(?:terms of (?:the )?)?{}", 1, 0.95),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}", 1, 0.95),
    ("licen[cs]e (?:is )?{}", 2, 0.8),
    ("{} licen[cs]e", 2, 0.85),
    ("under (?:the )?{}", 3, 0.7),
)
#: Signatures written one by one, of texts, links, headers and short names, in the order in which equal ones win:
#: label | keyword that every match holds | weight | pattern (blank = any gap); fixed here.
SIGNATURES = """
mit|granted|0.95|permission is hereby granted free of charge to any person obtaining a copy
mit|deal|0.6|to deal in the software without restriction
mit|sublicense|0.6|rights to use copy modify merge publish distribute sublicense and or sell
mit|portions|0.6|shall be included in all copies or substantial portions of the software
mit|noninfringement|0.5|merchantability fitness for a particular purpose and noninfringement
mit|opensource|0.95|opensource org licenses mit
mit|mit|0.6|dual licensed under (?:the )?mit
mit|mit|0.7|mit style licen[cs]e
mit|mit|0.6|x11 ?mit
mit-0|mit|0.9|mit no attribution
x11|x11|0.7|x11 licen[cs]e
x11|consortium|0.7|except as contained in this notice the name of the x consortium
isc|permission|0.9|permission to use copy modify and or distribute this software for any purpose
isc|isc|0.9|opensource org licenses isc
isc|disclaims|0.6|the author disclaims all warranties with regard to this software
bsd-3-clause|redistribution|0.85|redistribution and use in source and binary forms with or without modification
bsd-3-clause|contributors|0.8|nor the names of its contributors may be used to endorse
bsd-3-clause|endorse|0.7|may be used to endorse or promote products derived from this software
bsd-3-clause|opensource|0.95|opensource org licenses bsd 3 clause
bsd-3-clause|clause|0.8|3 clause bsd
bsd-2-clause|clause|0.8|2 clause bsd
bsd-2-clause|opensource|0.95|opensource org licenses bsd 2 clause
bsd-2-clause|redistributions|0.5|redistributions of source code must retain the above copyright notice
bsd-4-clause|advertising|0.8|all advertising materials mentioning features or use of this software
bsd-4-clause|acknowledgement|0.6|must display the following acknowledgement
bsd-0-clause|clause|0.85|zero clause bsd
bsd|bsd|0.6|bsd (?:style )?licen[cs]e
bsd|regents|0.7|the regents of the university of california
bsd|bsd|0.6|dual licensed under (?:the )?bsd
apache-2.0|apache|0.95|www apache org licenses license 2 0
apache-2.0|compliance|0.7|you may not use this file except in compliance with the license
apache-2.0|apache|0.9|opensource org licenses apache 2 0
apache-2.0|licensed|0.8|licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0|asf|0.7|the asf licenses this file to you
apache-2.0|apache|0.8|apache 2(?: 0)? licen[cs]ed
apache-2.0|apache|0.85|apache license version 2 0 january 2004
apache-1.1|apache|0.8|the apache software license version 1 1
apache-1.1|developed|0.7|this product includes software developed by the apache software foundation
apache-1.0|apache|0.7|apache license 1 0
gpl-3.0|foundation|0.9|free software foundation either version 3
gpl-3.0|gnu|0.9|www gnu org licenses gpl 3 0
gpl-3.0|gpl|0.9|opensource org licenses gpl 3 0
gpl-3.0|version|0.8|gnu general public license version 3 29 june 2007
gpl-3.0|gplv3|0.8|gplv3(?: or later)?
gpl-3.0|gpl3|0.7|gpl3
gpl-2.0|foundation|0.9|free software foundation either version 2
gpl-2.0|gnu|0.9|www gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0|gpl|0.9|opensource org licenses gpl 2 0
gpl-2.0|version|0.8|gnu general public license version 2 june 1991
gpl-2.0|gplv2|0.8|gplv2(?: or later)?
gpl-2.0|gpl2|0.7|gpl2
gpl|gpl|0.5|(?:gnu )?gpl
gpl|gnu|0.7|you should have received a copy of the gnu general public license
gpl|redistribute|0.6|you can redistribute it and or modify it under the terms of the gnu general public license
gpl|gnu|0.6|see the gnu general public license for more details
gpl|gnu|0.7|www gnu org licenses gpl
gpl|gpl|0.6|gpl compatible
gpl|copyleft|0.4|copyleft
lgpl|lgpl|0.5|lgpl
lgpl|lesser|0.7|gnu lesser general public licen[cs]e
lgpl|library|0.7|gnu library general public licen[cs]e
lgpl|gnu|0.7|www gnu org licenses lgpl
lgpl|lesser|0.6|you should have received a copy of the gnu lesser general public license
lgpl-2.0|library|0.8|gnu library general public license version 2
lgpl-2.1|lesser|0.85|gnu lesser general public license version 2 1 february 1999
lgpl-2.1|lgplv2|0.8|lgplv2 1
lgpl-3.0|lgplv3|0.8|lgplv3
lgpl-3.0|lesser|0.85|gnu lesser general public license version 3 29 june 2007
agpl|agpl|0.5|agpl
agpl|affero|0.7|affero general public licen[cs]e
agpl|gnu|0.8|www gnu org licenses agpl
agpl-3.0|affero|0.85|gnu affero general public license version 3 19 november 2007
agpl-3.0|agplv3|0.8|agplv3
agpl-3.0|remotely|0.5|users interacting with it remotely through a computer network
gfdl|invariant|0.7|with no invariant sections no front cover texts and no back cover texts
gfdl|documentation|0.8|gnu free documentation license version 1 [1-3]
gfdl|gnu|0.8|www gnu org licenses fdl
gpl-exception|classpath|0.7|classpath exception
gpl-exception|exception|0.6|as a special exception the copyright holders (?:of this library )?give you permission to link
gpl-exception|font|0.6|font embedding exception
mpl-2.0|mozilla|0.9|mozilla org mpl 2 0
mpl-2.0|source|0.9|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0|incompatible|0.6|incompatible with secondary licenses
mpl-1.1|mozilla|0.85|the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1|mozilla|0.9|www mozilla org mpl mpl 1 1
mpl|mozilla|0.6|mozilla public licen[cs]e
epl-2.0|eclipse|0.9|www eclipse org legal epl 2 0
epl-2.0|eclipse|0.9|www eclipse org legal epl v20
epl-1.0|eclipse|0.9|www eclipse org legal epl v10
epl-1.0|accompanying|0.6|this program and the accompanying materials are made available under the terms of the eclipse public license
epl|eclipse|0.6|eclipse public licen[cs]e
edl-1.0|eclipse|0.8|eclipse distribution licen[cs]e
cddl-1.0|cddl|0.7|cddl(?: version| v)? 1 0
cddl-1.1|cddl|0.7|cddl(?: version| v)? 1 1
cpl-1.0|common|0.8|common public license version 1 0
ipl-1.0|ibm|0.8|ibm public license version 1 0
apsl-2.0|apple|0.8|apple public source license version 2 0
apsl|apple|0.7|apple public source licen[cs]e
artistic-1.0|artistic|0.8|artistic license 1 0
artistic-2.0|artistic|0.85|www perlfoundation org artistic license 2 0
artistic|artistic|0.6|artistic licen[cs]e
perl|perl|0.8|under the same terms as perl itself
zlib|misrepresented|0.8|the origin of this software must not be misrepresented
zlib|altered|0.7|altered source versions must be plainly marked as such
zlib|held|0.5|in no event will the authors be held liable for any damages arising from the use of this software
libpng|libpng|0.7|libpng licen[cs]e
libpng|png|0.7|png reference library
boost-1.0|boost|0.9|www boost org license 1 0
boost-1.0|boost|0.85|boost software license version 1 0 august 17th 2003
unlicense|unencumbered|0.95|free and unencumbered software released into the public domain
unlicense|unlicense|0.9|unlicense org
wtfpl|wtfpl|0.9|www wtfpl net
public-domain|domain|0.8|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|domain|0.6|(?:is|are) in the public domain
public-domain|domain|0.7|public domain dedication
public-domain|copyright|0.5|no copyright is claimed
public-domain|disclaims|0.7|the author disclaims copyright to this source code
eupl-1.1|european|0.8|european union public licen[cs]e v(?:ersion)? ?1 1
eupl-1.2|eupl|0.8|eupl(?: v)? ?1 2
ofl-1.1|font|0.85|sil open font license version 1 1
ofl-1.1|scripts|0.8|scripts sil org ofl
ofl|reserved|0.5|with reserved font name
openssl|openssl|0.8|this product includes software developed by the openssl project
openssl|openssl|0.8|openssl license
ssleay|eric|0.8|this product includes cryptographic software written by eric young
python-2.0|python|0.8|psf license agreement for python
python-2.0|python|0.7|python software foundation license version 2
cnri-python|cnri|0.7|cnri open source license agreement
php-3.01|php|0.85|the php license version 3 01
php-3.0|php|0.8|the php license version 3 0
php|php|0.7|this product includes php software
ruby|ruby|0.7|under the same terms as ruby
postgresql|postgresql|0.8|postgresql global development group
postgresql|postgresql|0.7|postgresql database management system
ms-pl|microsoft|0.85|microsoft public license ms pl
ms-rl|microsoft|0.85|microsoft reciprocal license ms rl
ms-lpl|microsoft|0.7|microsoft limited public licen[cs]e
ncsa|illinois|0.8|university of illinois ncsa open source license
afl-2.1|academic|0.8|academic free license (?:version |v )?2 1
afl-3.0|academic|0.85|licensed under the academic free license version 3 0
osl-3.0|osl|0.8|osl 3 0
osl-3.0|open|0.85|licensed under the open software license version 3 0
qpl-1.0|trolltech|0.7|q public license version 1 0 (?:copyright )?(?:c )?(?:[0-9]+ )*trolltech
sleepycat|sleepycat|0.8|sleepycat licen[cs]e
w3c|w3c|0.8|w3c software (?:notice and |and document )?licen[cs]e
zpl-2.1|zope|0.8|zope public license (?:zpl )?(?:version |v )?2 1
zpl|zope|0.6|zope public licen[cs]e
curl|curl|0.7|curl licen[cs]e
ijg|jpeg|0.7|this software is based in part on the work of the independent jpeg group
unicode|unicode|0.7|unicode (?:inc )?licen[cs]e agreement
icu|icu|0.7|icu licen[cs]e
fsfap|permitted|0.6|copying and distribution of this file with or without modification are permitted
fsf-verbatim|verbatim|0.6|everyone is permitted to copy and distribute verbatim copies
hpnd|historical|0.8|historical permission notice and disclaimer
ntp|ntp|0.7|ntp licen[cs]e
naist|nara|0.7|nara institute of science and technology
nasa-1.3|nasa|0.8|nasa open source agreement
ecl-2.0|educational|0.8|educational community license(?: version)? 2 0
motosoto|motosoto|0.8|motosoto open source licen[cs]e
mulan-2|mulan|0.85|mulan psl v2
mulan|mulan|0.7|mulan permissive software licen[cs]e
cecill-2.1|cecill|0.8|cecill(?: version| v)? 2 1
cecill-b|cecill|0.8|cecill b
cecill-c|cecill|0.8|cecill c
cecill|cecill|0.6|cecill
etalab-2.0|ouverte|0.8|licence ouverte(?: etalab)? 2 0
ogl-3.0|government|0.85|open government licence v(?:ersion )?3 0
ogl|government|0.7|open government licen[cs]e
odbl-1.0|opendatacommons|0.9|opendatacommons org licenses odbl
odc-by-1.0|opendatacommons|0.9|opendatacommons org licenses by
pddl-1.0|opendatacommons|0.9|opendatacommons org licenses pddl
cdla-permissive|cdla|0.8|cdla permissive(?: 1 0| 2 0)?
cdla-sharing|cdla|0.8|cdla sharing(?: 1 0)?
cdla|data|0.7|community data license agreement
cc0-1.0|creativecommons|0.9|creativecommons org publicdomain zero
cc0-1.0|cc0|0.8|cc0
cc0-1.0|affirmer|0.6|affirmer offers the work as is
cc-pdm|creativecommons|0.9|creativecommons org publicdomain mark
cc-by-nc-nd|creativecommons|0.92|creativecommons org licenses by nc nd(?: [1-4] 0)?
cc-by-nc-sa|creativecommons|0.92|creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc|creativecommons|0.9|creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nd|creativecommons|0.9|creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-sa|creativecommons|0.9|creativecommons org licenses by sa(?: [1-4] 0)?
cc-by|creativecommons|0.85|creativecommons org licenses by(?: [1-4] 0)?
cc-by-4.0|creative|0.85|creative commons attribution 4 0 international
cc-by-sa-4.0|creative|0.85|creative commons attribution share ?alike 4 0 international
cc-by-nc-4.0|creative|0.85|creative commons attribution non ?commercial 4 0 international
cc-by-3.0|creative|0.85|creative commons attribution 3 0 (?:unported|united states|germany)
cc|creative|0.5|creative commons licen[cs]e
cc|reserved|0.4|some rights reserved
busl-1.1|business|0.85|business source license(?: version)? 1 1
sspl-1.0|side|0.85|server side public licen[cs]e
sspl-1.0|sspl|0.7|sspl(?: v)? ?1(?: 0)?
elastic-2.0|elastic|0.85|elastic license(?: version)? 2 0
commons-clause|clause|0.8|commons clause license condition
polyform-nc|polyform|0.85|polyform noncommercial licen[cs]e
polyform|polyform|0.7|polyform (?:strict|small business|shield|perimeter) licen[cs]e
confluent|confluent|0.8|confluent community licen[cs]e
hippocratic|hippocratic|0.8|hippocratic licen[cs]e
parity|parity|0.7|parity public licen[cs]e
openrail|rail|0.8|(?:creativeml )?open rail(?: m)?
bigscience|rail|0.8|bigscience (?:open )?rail licen[cs]e
llama|llama|0.7|llama [23](?: [0-9])? community license agreement
gemma|gemma|0.7|gemma terms of use
non-commercial|commercial|0.5|for non ?commercial use only
non-commercial|research|0.5|for research purposes only
proprietary|reserved|0.4|all rights reserved
proprietary|license|0.6|end user license agreement
proprietary|eula|0.5|eula
proprietary|confidential|0.5|proprietary and confidential
proprietary|copying|0.6|unauthorized copying of this file via any medium is strictly prohibited
proprietary|reproduced|0.4|may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission
proprietary|redistribution|0.5|redistribution is (?:strictly )?prohibited
proprietary|shareware|0.4|shareware
freeware|freeware|0.4|freeware
spdx|spdx|0.3|spdx filecopyrighttext
copyright|copyright|0.2|copyright c
""".strip()
SENTENCES = [(label, keyword, pattern, float(weight)) for label, keyword, weight, pattern in (line.split("|", 3) for line in SIGNATURES.split("\n"))]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    weight: float


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(EDGE + pattern.encode().replace(b" ?", b"\0").replace(b" ", GAP).replace(b"\0", b"(?:" + GAP + b")?") + END)


def _keyword(name: str) -> bytes:
    """The longest plain word that every match of ``name`` holds."""
    plain = re.sub(r"\[[^]]*\][?+*]?|.\?", " ", re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", " ", name))
    return max(re.findall(r"[a-z0-9]+", plain), key=len).encode()


def _rules() -> list[Rule]:
    out = []
    for line in FAMILIES.split("\n"):
        label, names = line.split("|", 1)
        for name in names.split("/"):
            for form, priority, weight in FORMS:
                out.append(Rule(label, _keyword(name), _compiled(form.format(name)), priority, weight))
            if "licen" in name:
                out.append(Rule(label, _keyword(name), _compiled(name), 3, 0.75))
    out += [Rule(label, keyword.encode(), _compiled(p), 4, weight) for label, keyword, p, weight in SENTENCES]
    return out


RULES = _rules()
KEYWORDS = ahocorasick.Automaton()
for _rule in RULES:
    KEYWORDS.add_word(_rule.keyword.decode(), _rule.keyword)
KEYWORDS.make_automaton()
BASE_FORMS = [(re.compile(EDGE + p.replace(b" ", GAP) + END), label) for p, label in BASE.items()]


@dataclass(frozen=True)
class Found:
    label: str
    start: int
    end: int
    priority: int
    weight: float


def scan(data: bytes) -> list[Found]:
    """Surviving detections in lower-cased UTF-8 ``data``, by place."""
    here = {k for _, k in KEYWORDS.iter(data.decode("latin-1"))}
    hits = {Found(r.label, m.start(), m.end(), r.priority, r.weight) for r in RULES if r.keyword in here for m in r.pattern.finditer(data)}
    kept: list[Found] = []
    # accepted intervals that lie in no other: their starts and their ends both ascend
    starts: list[int] = []
    ends: list[int] = []
    for h in sorted(hits, key=lambda h: (h.priority, h.start - h.end, h.start, h.label)):
        at = bisect.bisect_right(starts, h.start)
        if at and ends[at - 1] >= h.end:
            continue
        kept.append(h)
        first, last = bisect.bisect_left(starts, h.start), bisect.bisect_right(ends, h.end)
        starts[first : max(first, last)], ends[first : max(first, last)] = [h.start], [h.end]
    return sorted(kept, key=lambda h: (h.start, h.end))


def base_places(data: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every place of a base phrase."""
    if b"license" not in data:
        return []
    return sorted((m.start(), label) for form, label in BASE_FORMS for m in form.finditer(data))


def license_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """License labels of each whole text; no shuffle, Arrow batches of bounded bytes.

    Per input row: id_col, n_words, n_base, first_word and last_word (words counted from 0; null
    without a base phrase), base_labels, labels, score (1 - product of (1 - weight) over surviving
    detections, base phrases with 0.9), detections (label:start:end in bytes of the lower-cased
    text). A null text counts as empty (no words, empty labels, score 0); very long texts are scanned
    whole; of detections of one interval the first by priority, then label, stays; repeated rows and null
    ids stay; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_row((t.as_py() or "").encode().translate(LOWER)) for t in batch.column(1)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *NAMES])

    return map_arrow(docs.select(id_col, text), run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def _row(data: bytes) -> tuple:
    inside = WORD[np.frombuffer(data, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    places, found = base_places(data), scan(data)
    words = [int(np.count_nonzero(starts[:at])) for at, _ in (places[:1] + places[-1:])]
    base = {label for _, label in places}
    miss = 1.0
    for w in [f.weight for f in found] + [0.9] * len(base):
        miss *= 1 - w
    n = int(np.count_nonzero(starts))
    shown = [f"{f.label}:{f.start}:{f.end}" for f in found]
    return n, len(places), *(words or [None, None]), ",".join(sorted(base)), ",".join(sorted(base | {f.label for f in found})), round(1 - miss, 9), shown


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("detections")


