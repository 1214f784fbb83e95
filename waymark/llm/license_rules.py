"""Signature rules of the license scan.

A rule is a regular expression over the words of a text (lower-cased, one blank between words and
at both ends), a label, a priority and a weight. Expressions are Java and RE2 syntax alike, match
whole words and never an empty string. Higher priorities: 4 license identifiers, 3 full names with
a version, 2 names, 1 generic wording. The second column of NAMES says under which gate a rule is
found; keywords() derives from an expression the words of which one at least stands in any match.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    gate: str
    pattern: str


#: A text without any of these has no rule to try; every gate below contains one of them.
GATES = ["licen", "copyright", "rights", "public domain", "cc by", "cc0", "cc zero", "spdx", "gpl", "creative commons", "creativecommons", "copyleft", "warrant", "proprietary", "confidential", "permission", "redistribut", "trademark", "all wrongs", "patent", "terms as perl", "good not evil", "gemma terms", "droits reserves", "commercial use only", "for research", "released under", "distributed under"]

NAMES = """
mit | mit license | (?:the )?mit licen[cs]e | 2
mit | spdx | spdx license identifier mit | 4
mit | permission | permission is hereby granted free of charge to any person obtaining a copy | 3
mit-0 | licen | mit (?:0|no attribution) licen[cs]e | 3
x11 | licen | x11 licen[cs]e | 2
expat | licen | expat licen[cs]e | 2
isc | isc licen | (?:the )?isc licen[cs]e | 2
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee | 3
0bsd | licen | (?:zero clause bsd|0bsd|bsd zero clause) licen[cs]e | 3
bsd | licen | bsd(?: style)? licen[cs]e | 2
bsd | redistribut | redistribution and use in source and binary forms with or without modification | 2
bsd-1-clause | licen | (?:1 clause|one clause) bsd licen[cs]e | 3
bsd-2-clause | licen | (?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e | 3
bsd-2-clause | licen | bsd 2 clause(?: simplified)? licen[cs]e | 3
bsd-3-clause | licen | (?:3 clause|three clause|new|revised|modified) bsd licen[cs]e | 3
bsd-3-clause | licen | bsd 3 clause(?: new or revised)? licen[cs]e | 3
bsd-4-clause | licen | (?:4 clause|four clause|original|old) bsd licen[cs]e | 3
bsd-4-clause | licen | bsd 4 clause(?: original or old)? licen[cs]e | 3
apache | licen | apache (?:software )?licen[cs]e | 2
apache | licen | apache (?:software )?foundation licen[cs]e | 2
unlicense | unlicen | (?:the )?unlicen[cs]e | 2
unlicense | public domain | this is free and unencumbered software released into the public domain | 3
wtfpl | licen | do what the fuck you want to public licen[cs]e | 3
beerware | licen | beer ?ware licen[cs]e | 3
zlib | licen | zlib(?: libpng)? licen[cs]e | 2
zlib | warrant | this software is provided as is without any express or implied warranty | 2
libpng | licen | libpng licen[cs]e(?: version 2)? | 2
boost | licen | boost software licen[cs]e | 2
boost-1.0 | licen | boost software licen[cs]e(?: version)? 1 0 | 3
artistic | licen | artistic licen[cs]e | 2
artistic-1.0 | licen | artistic licen[cs]e(?: version)? 1 0 | 3
artistic-2.0 | licen | artistic licen[cs]e(?: version)? 2 0 | 3
perl | licen | (?:same terms as perl|perl licen[cs]e) | 2
python | licen | python (?:software foundation )?licen[cs]e | 2
psf-2.0 | licen | psf licen[cs]e(?: agreement)?(?: version)? 2 | 3
php | licen | php licen[cs]e | 2
php-3.0 | licen | php licen[cs]e(?: version)? 3 0 | 3
php-3.01 | licen | php licen[cs]e(?: version)? 3 01 | 3
ruby | licen | ruby licen[cs]e | 2
openssl | licen | openssl licen[cs]e | 2
ssleay | licen | (?:original )?ssleay licen[cs]e | 2
curl | licen | curl licen[cs]e | 2
postgresql | licen | postgresql licen[cs]e | 2
ntp | licen | ntp licen[cs]e | 2
unicode-dfs | licen | unicode (?:data files and software|inc) licen[cs]e(?: agreement)? | 3
unicode-3.0 | licen | unicode licen[cs]e v?3 | 3
icu | licen | icu licen[cs]e | 2
w3c | licen | w3c (?:software )?(?:notice and )?licen[cs]e | 2
vim | licen | vim licen[cs]e | 2
sleepycat | licen | sleepycat licen[cs]e | 2
qpl-1.0 | licen | q public licen[cs]e(?: version)?(?: 1 0)? | 3
ncsa | licen | (?:university of illinois )?ncsa open source licen[cs]e | 3
ecl-2.0 | licen | educational community licen[cs]e(?: version)? 2 0 | 3
ecl-1.0 | licen | educational community licen[cs]e(?: version)? 1 0 | 3
afl-2.1 | licen | academic free licen[cs]e(?: version| v)? 2 1 | 3
afl-3.0 | licen | academic free licen[cs]e(?: version| v)? 3 0 | 3
afl | licen | academic free licen[cs]e | 2
osl-1.0 | licen | open software licen[cs]e(?: version| v)? 1 0 | 3
osl-2.0 | licen | open software licen[cs]e(?: version| v)? 2 0 | 3
osl-2.1 | licen | open software licen[cs]e(?: version| v)? 2 1 | 3
osl-3.0 | licen | open software licen[cs]e(?: version| v)? 3 0 | 3
osl | licen | open software licen[cs]e | 2
ms-pl | licen | microsoft public licen[cs]e | 2
ms-rl | licen | microsoft reciprocal licen[cs]e | 2
ms-lpl | licen | microsoft limited public licen[cs]e | 3
ms-eula | licen | microsoft software licen[cs]e terms | 3
cddl | licen | common development and distribution licen[cs]e | 2
cddl-1.0 | licen | common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 0 | 3
cddl-1.1 | licen | common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 1 | 3
cpl-1.0 | licen | common public licen[cs]e(?: version| v)?(?: 1 0)? | 3
cpal-1.0 | licen | common public attribution licen[cs]e(?: version)?(?: 1 0)? | 3
epl | licen | eclipse public licen[cs]e | 2
epl-1.0 | licen | eclipse public licen[cs]e(?: version| v)? 1 0 | 3
epl-2.0 | licen | eclipse public licen[cs]e(?: version| v)? 2 0 | 3
edl-1.0 | licen | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)? | 3
eupl | licen | european union public licen[cs]e | 2
eupl-1.1 | licen | european union public licen[cs]e(?: version| v)? 1 1 | 3
eupl-1.2 | licen | european union public licen[cs]e(?: version| v)? 1 2 | 3
mpl | licen | mozilla public licen[cs]e | 2
mpl-1.0 | licen | mozilla public licen[cs]e(?: version| v)? 1 0 | 3
mpl-1.1 | licen | mozilla public licen[cs]e(?: version| v)? 1 1 | 3
mpl-2.0 | licen | mozilla public licen[cs]e(?: version| v)? 2 0 | 3
npl | licen | netscape public licen[cs]e | 2
spl-1.0 | licen | sun public licen[cs]e(?: version)?(?: 1 0)? | 3
sissl | licen | sun industry standards source licen[cs]e | 3
ipl-1.0 | licen | ibm public licen[cs]e(?: version)?(?: 1 0)? | 3
apsl-1.0 | licen | apple public source licen[cs]e(?: version)? 1 0 | 3
apsl-2.0 | licen | apple public source licen[cs]e(?: version)? 2 0 | 3
apsl | licen | apple public source licen[cs]e | 2
rpl-1.5 | licen | reciprocal public licen[cs]e(?: version)?(?: 1 5)? | 3
nasa-1.3 | licen | nasa open source agreement(?: version)?(?: 1 3)? licen[cs]e | 3
watcom | licen | sybase open watcom public licen[cs]e | 3
intel | licen | intel (?:open source )?licen[cs]e | 2
oracle-bcl | licen | oracle binary code licen[cs]e(?: agreement)? | 3
upl-1.0 | licen | universal permissive licen[cs]e(?: version| v)?(?: 1 0)? | 3
blueoak-1.0 | licen | blue oak model licen[cs]e(?: version)?(?: 1 0 0)? | 3
mulan-2.0 | licen | mulan psl (?:v2|version 2) licen[cs]e | 3
mulan-2.0 | licen | mulan permissive software licen[cs]e(?: version| v)?(?: ?2)? | 3
hippocratic | licen | hippocratic licen[cs]e | 3
json | licen | json licen[cs]e | 2
json | rights | the software shall be used for good not evil | 2
sspl-1.0 | licen | server side public licen[cs]e(?: version| v)?(?: 1)? | 3
elastic-2.0 | licen | elastic licen[cs]e(?: version| v)?(?: 2 0)? | 3
busl-1.1 | licen | business source licen[cs]e(?: version)?(?: 1 1)? | 3
polyform-nc | licen | polyform noncommercial licen[cs]e | 3
polyform-small | licen | polyform small business licen[cs]e | 3
polyform-shield | licen | polyform (?:shield|perimeter) licen[cs]e | 3
commons-clause | licen | commons clause licen[cs]e(?: condition)? | 3
prosperity | licen | prosperity public licen[cs]e | 3
parity | licen | parity public licen[cs]e | 3
rail | licen | (?:open )?(?:responsible ai|rail m?) licen[cs]e | 2
openrail | licen | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e | 3
llama-2 | licen | llama 2 community licen[cs]e | 3
llama-3 | licen | llama 3 community licen[cs]e | 3
gemma | licen | gemma (?:terms|licen[cs]e) | 2
odbl-1.0 | licen | open (?:data commons open )?database licen[cs]e | 3
odc-by | licen | open data commons attribution licen[cs]e | 3
pddl | licen | (?:open data commons )?public domain dedication and licen[cs]e | 3
cdla-permissive | licen | community data licen[cs]e agreement permissive | 3
cdla-sharing | licen | community data licen[cs]e agreement sharing | 3
ogl-uk | licen | open government licen[cs]e | 2
ogl-uk-3.0 | licen | open government licen[cs]e(?: version| v)? ?3(?: 0)? | 3
dl-de-by | licen | datenlizenz deutschland namensnennung licen[cs]e | 3
etalab | licen | (?:etalab )?licence ouverte(?: 2 0| open licence)? | 3
cecill | licen | cecill(?: b| c)? (?:free software )?licen[cs]e | 2
cern-ohl | licen | cern open hardware licen[cs]e | 3
tapr-ohl | licen | tapr open hardware licen[cs]e | 3
solderpad | licen | solderpad hardware licen[cs]e | 3
ofl-1.1 | licen | (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)? | 3
ubuntu-font | licen | ubuntu font licen[cs]e | 3
bitstream-vera | licen | bitstream vera (?:fonts? )?licen[cs]e | 3
free-art | licen | (?:free art licen[cs]e|licence art libre) | 3
opl | licen | open (?:publication|content) licen[cs]e | 3
public-domain | public domain | (?:dedicated to|released (?:in)?to|placed in|is in) the public domain | 2
public-domain | public domain | public domain | 1
reserved | rights | all rights (?:are )?reserved | 2
reserved | rights | (?:tous droits reserves|alle rechte vorbehalten rights) | 2
some-rights | rights | some rights reserved | 2
no-rights | rights | no rights reserved | 2
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9] | 1
copyright | copyright | (?:protected by|under) copyright(?: law)? | 1
copyleft | copyleft | copyleft | 1
proprietary | proprietary | proprietary (?:and confidential|licen[cs]e|software) | 2
confidential | confidential | (?:strictly|company) confidential | 1
no-redistribution | redistribut | (?:redistribution is (?:not permitted|prohibited)|do not redistribute|may not be redistributed) | 2
non-commercial | licen | (?:for non ?commercial use only|non ?commercial licen[cs]e) | 2
research-only | licen | (?:for research (?:use|purposes) only|research only licen[cs]e) | 2
evaluation-only | licen | evaluation licen[cs]e | 2
commercial | licen | commercial licen[cs]e | 1
freeware | licen | freeware licen[cs]e | 2
shareware | licen | shareware licen[cs]e | 2
patent-grant | patent | (?:grant of patent licen[cs]e|patent licen[cs]e grant) | 2
trademark | trademark | registered trademarks? of | 1
as-is | warrant | without warrant(?:y|ies) (?:or conditions )?of any kind | 1
as-is | warrant | provided as is without warranty | 1
unspecified | licen | (?:licen[cs]ed|released|distributed) under (?:the|a|an) | 1
unspecified | licen | see (?:the )?licen[cs]e(?: file| txt| md)? for details | 1
unspecified | licen | licen[cs]e agreement | 1
permission | permission | (?:used|reprinted|reproduced) (?:by|with) permission | 1
written-permission | permission | without (?:prior )?written permission | 2
"""


def _named() -> list[Rule]:
    found = []
    for line in NAMES.strip().splitlines():
        label, keyword, pattern, priority = (x.strip() for x in line.split(" | "))
        found.append(Rule(label, int(priority), 0.25 * int(priority), keyword, pattern))
    return found


def _creative_commons() -> list[Rule]:
    found = []
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        short, long = kind.replace("-", " "), " ".join(parts[x] for x in kind.split("-"))
        found.append(Rule(f"cc-{kind}", 2, 0.5, "cc by", f"cc {short}"))
        found.append(Rule(f"cc-{kind}", 2, 0.5, "creative commons", f"creative commons {long}"))
        for major, minor in ((1, 0), (2, 0), (2, 5), (3, 0), (4, 0)):
            label = f"cc-{kind}-{major}.{minor}"
            found.append(Rule(label, 3, 0.75, "cc by", f"cc {short} {major} {minor}"))
            found.append(Rule(label, 3, 0.75, "creative commons", f"creative commons {long}(?: {major} {minor})(?: international| unported| generic)?"))
            found.append(Rule(label, 4, 1.0, "creativecommons", f"creativecommons org licenses {short} {major} {minor}"))
    found.append(Rule("cc0-1.0", 3, 0.75, "cc0", "cc0(?: 1 0)?(?: universal)?"))
    found.append(Rule("cc0-1.0", 3, 0.75, "cc zero", "cc zero"))
    found.append(Rule("cc0-1.0", 4, 1.0, "creativecommons", "creativecommons org publicdomain zero 1 0"))
    return found


def _gnu() -> list[Rule]:
    found = []
    families = {"gpl": ("general public", "1 2 3"), "lgpl": ("(?:lesser|library) general public", "2 2.1 3"), "agpl": ("affero general public", "1 3"), "gfdl": ("free documentation", "1.1 1.2 1.3")}
    for short, (name, versions) in families.items():
        found.append(Rule(short, 2, 0.5, "licen", f"(?:gnu )?{name} licen[cs]e"))
        for v in versions.split():
            number = v.replace(".", " ")
            found.append(Rule(f"{short}-{v}", 3, 0.75, "licen", f"(?:gnu )?{name} licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?{number}(?: 0)?"))
            found.append(Rule(f"{short}-{v}-or-later", 3, 0.75, "licen", f"(?:gnu )?{name} licen[cs]e(?: version| v) ?{number}(?: 0)? or (?:any )?later(?: version)?"))
            found.append(Rule(f"{short}-{v}", 4, 1.0, "spdx", f"spdx license identifier {short} {number}(?: 0)?(?: only)?"))
            found.append(Rule(f"{short}-{v}-or-later", 4, 1.0, "spdx", f"spdx license identifier {short} {number}(?: 0)? or later"))
            if short != "gfdl":
                first, *rest = number.split()
                written = "|".join(f"{short}{x}{first}" for x in (" v", " ", "v", ""))
                found.append(Rule(f"{short}-{v}", 2, 0.5, "gpl", " ".join([f"(?:{written})", *rest]) + "(?: 0)?"))
    return found


def _identifiers() -> list[Rule]:
    """SPDX identifiers of licenses whose other rules are above."""
    known = "Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 Unlicense Zlib BSL-1.0 Artistic-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 OFL-1.1 MS-PL EUPL-1.2 PostgreSQL UPL-1.0 0BSD MIT-0 AFL-3.0 OSL-3.0 ECL-2.0 NCSA"
    return [Rule(x.lower(), 4, 1.0, "spdx", f"spdx license identifier {x.lower().replace('-', ' ').replace('.', ' ')}") for x in known.split()]


def _apache() -> list[Rule]:
    return [Rule(f"apache-{v}", 3, 0.75, "licen", f"apache (?:software )?licen[cs]e(?: version| v)? ?{v.replace('.', ' ')}") for v in ("1.0", "1.1", "2.0")] + [Rule("apache-2.0", 4, 1.0, "licen", "apache org licenses license 2 0")]


#: In the order that breaks ties.
RULES: list[Rule] = [*_identifiers(), *_creative_commons(), *_gnu(), *_apache(), *_named()]


#: Words that many texts have; a rule goes by others where it can.
FREQUENT = frozenset("a agreement and any as by c cc clause code commons copyright creative data do for foundation free general in is license licence licenses licensed model new no not of open or org other private public purpose rights see software source terms the this to under use version with without work works".split())


def _split_top(pattern: str, at: str) -> list[str]:
    """pattern cut at a character outside groups and classes."""
    parts, depth = [""], 0
    for ch in pattern:
        depth += (ch in "([") - (ch in ")]")
        if ch == at and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def _groups(pattern: str) -> list[tuple[int, int, bool]]:
    """Start, stop (with its mark) and whether it may be left out, of each outer group."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(pattern):
        if ch == "(":
            start, depth = (start if depth else k), depth + 1
        elif ch == ")":
            depth -= 1
            if not depth:
                mark = pattern[k + 1 : k + 2]
                out.append((start, k + 1 + (mark in ("?", "*", "+") and bool(mark)), mark in ("?", "*") and bool(mark)))
    return out


@lru_cache(maxsize=None)
def keywords(pattern: str) -> tuple[str, ...]:
    """Words of which every match holds one at least, rare ones by preference; empty if none is certain."""
    choices: list[list[tuple[str, ...]]] = []
    for branch in _split_top(pattern, "|"):
        found, plain, last = [], "", 0
        for start, stop, optional in _groups(branch):
            inner = branch[start + 3 : branch.rindex(")", start, stop)]
            ways = _split_top(inner, "|")
            if not optional:
                found += [keywords(inner)] if all(w.strip() == w for w in ways) and branch[start - 1 : start] in ("", " ") and (branch[stop : stop + 1] in ("", " ") or branch[stop : stop + 4] == "(?: ") else []
            # a word that touches a group is certain only where every way of the group has a blank there
            plain += branch[last:start] + (" " if all(w[:1] == " " for w in ways) else "") + "~" + (" " if all(w[-1:] == " " for w in ways) else "")
            last = stop
        plain += branch[last:]
        for word in plain.replace(" ?", "~").split():
            if re.fullmatch(r"[a-z0-9]+\[cs\][a-z0-9]+", word):
                found.append((word.replace("[cs]", "c"), word.replace("[cs]", "s")))
            elif re.fullmatch("[a-z0-9]+", word):
                found.append((word,))
        choices.append([f for f in found if f])
    if any(not c for c in choices):
        return ()
    common = lambda ws: (sum(w in FREQUENT or len(w) < 2 or w.isdigit() for w in ws), len(ws), -min(map(len, ws)))
    return tuple(dict.fromkeys(w for c in choices for w in min(c, key=common)))
