"""The signature rules of the license scan, as data.

A rule is (label, tier, keyword, pattern). Patterns are regular expressions over words that one space
separates; they need neither look-around nor word boundaries. A keyword is a literal that every match
contains: a rule is tried only on texts that have it. Tier 0 is the most specific (an explicit notice),
3 the most general (a mere mention); the order of the list breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    tier: int
    keyword: str
    pattern: str
    base: bool = False


#: Phrases whose every place counts, whatever else is found there.
BASE = [
    Rule("cc-by", 3, " cc ", "cc by", True),
    Rule("gpl", 3, " general ", "general public license", True),
    Rule("reserved", 3, " reserved ", "all rights reserved", True),
]

_V = "(?: (?:version|v))?"
_LIC = "(?: software)?(?: public)? licen[cs]e"

#: label, keyword, how the license is named (its version included).
NAMED = [
    ("apache-1.0", "apache", f"apache(?: software)? license{_V} 1 0"),
    ("apache-1.1", "apache", f"apache(?: software)? license{_V} 1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: license)?{_V} 2(?: 0)?"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("mit", " mit ", "mit(?: x11)? licen[cs]e"),
    ("mit", "expat", "expat(?: x11)? licen[cs]e"),
    ("mit-0", "attribution", "mit no attribution"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("bsd-4-clause", "clause", "(?:bsd )?(?:4|four) clause(?: bsd)? licen[cs]e"),
    ("bsd-4-clause", "original", "original bsd licen[cs]e"),
    ("bsd-3-clause", "clause", "(?:bsd )?(?:3|three) clause(?: bsd)? licen[cs]e"),
    ("bsd-2-clause", "clause", "(?:bsd )?(?:2|two) clause(?: bsd)? licen[cs]e"),
    ("bsd-0-clause", "clause", "(?:bsd )?(?:0|zero) clause(?: bsd)? licen[cs]e"),
    ("bsd", " bsd ", "(?:(?:new|simplified|modified|revised|free) )?bsd(?: style)? licen[cs]e"),
    ("gpl-1.0", "general", f"(?:gnu )?general public license{_V} 1(?: 0)?"),
    ("gpl-2.0", "general", f"(?:gnu )?general public license{_V} 2(?: 0)?"),
    ("gpl-3.0", "general", f"(?:gnu )?general public license{_V} 3(?: 0)?"),
    ("gpl-2.0-or-later", "general", f"(?:gnu )?general public license{_V} 2(?: 0)? or(?: at your option)?(?: any)? later"),
    ("gpl-3.0-or-later", "general", f"(?:gnu )?general public license{_V} 3(?: 0)? or(?: at your option)?(?: any)? later"),
    ("gpl", "general", "gnu general public license"),
    ("gpl-1.0", "gpl", f"(?:gnu )?gpl{_V} 1(?: 0)?"),
    ("gpl-2.0", "gpl", f"(?:gnu )?(?:gpl{_V} 2(?: 0)?|gplv2)"),
    ("gpl-3.0", "gpl", f"(?:gnu )?(?:gpl{_V} 3(?: 0)?|gplv3)"),
    ("lgpl-2.0", "library", f"(?:gnu )?library general public license{_V} 2(?: 0)?"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public license{_V} 2 1"),
    ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public license{_V} 3(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{_V} 2 1"),
    ("lgpl-3.0", "lgpl", f"(?:gnu )?(?:lgpl{_V} 3(?: 0)?|lgplv3)"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public license{_V} 3(?: 0)?"),
    ("agpl-1.0", "affero", f"affero general public license{_V} 1(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("agpl-3.0", "agpl", f"(?:gnu )?(?:agpl{_V} 3(?: 0)?|agplv3)"),
    ("gfdl-1.1", "documentation", f"(?:gnu )?free documentation license{_V} 1 1"),
    ("gfdl-1.2", "documentation", f"(?:gnu )?free documentation license{_V} 1 2"),
    ("gfdl-1.3", "documentation", f"(?:gnu )?free documentation license{_V} 1 3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license"),
    ("mpl-1.0", "mozilla", f"mozilla public license{_V} 1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public license{_V} 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public license{_V} 2 0"),
    ("mpl", "mozilla", "mozilla public license"),
    ("mpl-2.0", " mpl ", f"mpl{_V} 2 0"),
    ("epl-1.0", "eclipse", f"eclipse public license{_V} 1 0"),
    ("epl-2.0", "eclipse", f"eclipse public license{_V} 2 0"),
    ("epl", "eclipse", "eclipse public license"),
    ("edl-1.0", "eclipse", "eclipse distribution license"),
    ("eupl-1.1", "european", f"european union public licence{_V} 1 1"),
    ("eupl-1.2", "european", f"european union public licence{_V} 1 2"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("cddl-1.0", "common", f"common development and distribution license{_V} 1 0"),
    ("cddl-1.1", "common", f"common development and distribution license{_V} 1 1"),
    ("cddl", "common", "common development and distribution license"),
    ("cpl-1.0", "common", "common public license"),
    ("cpal-1.0", "common", "common public attribution license"),
    ("boost-1.0", "boost", f"boost software license{_V}(?: 1 0)?"),
    ("isc", " isc ", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", f"wtfpl{_V}(?: 2)?"),
    ("artistic-1.0", "artistic", f"artistic license{_V} 1 0"),
    ("artistic-2.0", "artistic", f"artistic license{_V} 2 0"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("psf", "python", "python software foundation license"),
    ("python-2.0", "python", f"python license{_V} 2 0"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("php-3.01", " php ", f"php license{_V} 3 01"),
    ("php-3.0", " php ", f"php license{_V} 3 0"),
    ("ofl-1.1", "font", f"(?:sil )?open font license{_V}(?: 1 1)?"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license"),
    ("odc-by-1.0", "commons", "open data commons attribution license"),
    ("pddl-1.0", "dedication", "public domain dedication and license"),
    ("ogl-3.0", "government", f"open government licence{_V} 3 0"),
    ("ogl", "government", "open government licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("json", " json ", "json license"),
    ("unicode", "unicode", "unicode license(?: agreement)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("osl-3.0", "open software", f"open software license{_V}(?: 3 0)?"),
    ("afl-3.0", "academic", f"academic free license{_V}(?: 3 0)?"),
    ("ecl-2.0", "educational", f"educational community license{_V}(?: 2 0)?"),
    ("upl-1.0", "permissive", "universal permissive license"),
    ("blueoak-1.0", "blue", "blue oak model license"),
    ("cecill-2.1", "cecill", f"cecill{_V}(?: free software license agreement)?(?: 2 1)?"),
    ("mulan-2.0", "mulan", f"mulan psl{_V}(?: 2)?"),
    ("mulan-2.0", "mulan", f"mulan permissive software license{_V}(?: 2)?"),
    ("bsl-1.1", "business", f"business source license{_V}(?: 1 1)?"),
    ("sspl-1.0", "server", f"server side public license{_V}(?: 1)?"),
    ("elastic-2.0", "elastic", f"elastic license{_V}(?: 2 0)?"),
    ("polyform-nc", "polyform", "polyform noncommercial license"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
    ("openrail", " rail ", "(?:creativeml |bigscience )?open rail(?: m)?(?: license)?"),
    ("llama-community", "community", "llama (?:[0-9]+ )*community license(?: agreement)?"),
    ("ipa", " ipa ", "ipa font license"),
    ("lppl-1.3", "latex", f"latex project public license{_V}(?: 1 3c?)?"),
    ("qpl-1.0", " q ", f"q public license{_V}(?: 1 0)?"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("vim", " vim ", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c software(?: notice and)? license"),
    ("wxwindows", "wxwindows", "wxwindows library licen[cs]e"),
    ("zpl-2.1", "zope", f"zope public license{_V}(?: 2 1)?"),
    ("beerware", "beer", "beer ?ware licen[cs]e"),
    ("proprietary", "proprietary", "proprietary licen[cs]e"),
    ("commercial", "commercial", "commercial licen[cs]e"),
]

#: Short identifiers as they stand after an SPDX tag, words apart.
SPDX = [
    ("apache-2.0", "apache 2 0"), ("mit", "mit"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("gpl-2.0", "gpl 2 0(?: only)?"), ("gpl-3.0", "gpl 3 0(?: only)?"), ("gpl-2.0-or-later", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gpl 3 0 or later"), ("lgpl-2.1", "lgpl 2 1(?: only)?"), ("lgpl-3.0", "lgpl 3 0(?: only)?"),
    ("agpl-3.0", "agpl 3 0(?: only)?"), ("mpl-2.0", "mpl 2 0"), ("epl-2.0", "epl 2 0"), ("isc", "isc"),
    ("cc0-1.0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("boost-1.0", "bsl 1 0"),
    ("artistic-2.0", "artistic 2 0"), ("ofl-1.1", "ofl 1 1"), ("eupl-1.2", "eupl 1 2"), ("0bsd", "0bsd"),
    ("ncsa", "ncsa"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("ms-pl", "ms pl"), ("upl-1.0", "upl 1 0"),
]

#: Creative Commons: elements, their words in full, versions.
CC = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Notices that name no license.
GENERIC = [
    ("copyright", 3, "copyright", "copyright(?: c)?(?: by)? [12][0-9]{3}"),
    ("copyright", 3, "copyright", "copyright notice"),
    ("reserved", 3, "reserved", "(?:some|no) rights reserved"),
    ("public-domain", 2, "domain", "(?:in|into|to) the public domain"),
    ("public-domain", 2, "domain", "dedicated to the public domain"),
    ("no-warranty", 2, "warrant", "without warrant(?:y|ies) of any kind"),
    ("no-warranty", 2, "warrant", "without any warranty"),
    ("no-warranty", 2, "merchantability", "(?:implied )?warranties of merchantability"),
    ("as-is", 2, "provided", "provided as is"),
    ("permission", 1, "permission", "permission is hereby granted free of charge to any person"),
    ("permission", 1, "permission", "permission to use copy modify and or distribute this software"),
    ("redistribution", 1, "redistribution", "redistribution and use in source and binary forms"),
    ("free-software", 2, "free software", "this (?:program|library) is free software"),
    ("licensed", 3, "licensed", "licensed under the terms of"),
    ("confidential", 2, "confidential", "confidential and proprietary"),
    ("no-derivatives", 2, "reproduced", "no part of this (?:publication|work|book) may be reproduced"),
    ("see-license", 3, "license", "see (?:the )?license(?: file)? for (?:details|more information)"),
]

_GRANT = "(?:(?:is|are) )?(?:licensed|released|distributed|available|published|provided|made available) under(?: the)?(?: terms of(?: the)?)?"


def rules() -> list[Rule]:
    """All rules in order of priority within a tier."""
    out = list(BASE)
    for label, keyword, name in NAMED:
        out.append(Rule(label, 0, keyword, f"{_GRANT} {name}"))
        out.append(Rule(label, 1 if any(c.isdigit() for c in label) else 2, keyword, name))
    for label, words in SPDX:
        out.append(Rule(label, 0, " spdx ", f"spdx license identifier {words}"))
    for short, words, full in CC:
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            out.append(Rule(f"cc-{short}-{version}", 0, " cc ", f"{_GRANT} cc {words} {v}"))
            out.append(Rule(f"cc-{short}-{version}", 1, " cc ", f"cc {words} {v}"))
            out.append(Rule(f"cc-{short}-{version}", 1, "creative", f"creative commons {full} {v}"))
        out.append(Rule(f"cc-{short}", 2, "creative", f"creative commons {full}"))
        out.append(Rule(f"cc-{short}", 2, " cc ", f"cc {words}"))
    out.append(Rule("cc0-1.0", 1, "cc0", "cc0(?: 1 0)?"))
    out.append(Rule("cc0-1.0", 1, "creative", "creative commons zero"))
    out += [Rule(label, tier, keyword, pattern) for label, tier, keyword, pattern in GENERIC]
    return out
