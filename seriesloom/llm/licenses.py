"""License scans: ordered signature rules behind a keyword prefilter, with suppression of contained detections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import Words, byte_table, text_pieces
from seriesloom.llm.tables import in_batches, lean, unused

#: Phrases of consecutive words that always count, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Kinds of signature in order of priority, with the confidence that one detection gives.
KINDS = {"text": 0.99, "notice": 0.95, "tag": 0.9, "url": 0.85, "title": 0.6, "mention": 0.3}
PRIORITY = {kind: k for k, kind in enumerate(KINDS)}
GRANT = (
    r"(?:licen[cs]ed|released|distributed|published|available|provided|redistributed|made available|covered|governed|used|offered|issued|sublicensed|"
    r"free software|relicensed|dual licensed)(?: to you| as is| freely| for use| by [^ ]+)? (?:under|by|with|according to|subject to)"
    r"(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"
)

# Signatures run over texts in canonical form: words in lower case, one space between them.
# label; keywords, of which one must occur; title; identifier; address
_FAMILIES = [
    ("mit", "mit expat x11", r"(?:mit|expat|mit expat|mit x11|x11)(?: style| open source)? licen[cs]es?", r"mit", r"opensource org licenses mit(?: license)?(?: php| html)?"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0", r"opensource org licenses mit 0|github com aws mit 0"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e (?:v|version |v )?1(?: 0)?", r"apache 1 0", r"apache org licenses license 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:v|version |v )?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", "apache asl", r"(?:apache(?: software)?(?: foundation)? licen[cs]e (?:v|version |v |)2(?: 0)?|asl 2 0|apache 2 0 licen[cs]e)", r"apache 2(?: 0)?", r"apache org licenses license 2 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: simplified)? licen[cs]e", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: new| revised)? licen[cs]e", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd)(?: original)? licen[cs]e", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd) licen[cs]e", r"0bsd", r"opensource org licenses 0bsd"),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[cs]e", r"bsd", r"opensource org licenses bsd license(?: php)?"),
    ("isc", "isc", r"(?:isc|internet systems consortium|openbsd) licen[cs]e", r"isc", r"opensource org licenses isc"),
    ("zlib", "zlib libpng", r"(?:zlib|zlib libpng|libpng) licen[cs]e", r"zlib", r"zlib net zlib license html|opensource org licenses zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicen[cs]e", r"unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl fuck", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", r"wtfpl", r"wtfpl net"),
    ("cc0", "cc0 cc creative", r"(?:cc0(?: 1 0)?|cc zero|creative commons(?: cc0| zero)(?: 1 0)?)(?: universal)?(?: public domain dedication| licen[cs]e)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc creative", r"(?:creative commons attribution|cc by)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)? licen[cs]e", r"cc by(?: (?:1|2|3|4) [05])", r"creativecommons org licenses by (?:1|2|3|4) [05]"),
    ("cc-by-sa", "cc creative", r"(?:creative commons attribution share ?alike|cc by sa)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", r"cc by sa(?: (?:1|2|3|4) [05])?", r"creativecommons org licenses by sa(?: (?:1|2|3|4) [05])?"),
    ("cc-by-nd", "cc creative", r"(?:creative commons attribution no ?deriv(?:ative|ative work)?s?|cc by nd)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", r"cc by nd(?: (?:1|2|3|4) [05])?", r"creativecommons org licenses by nd(?: (?:1|2|3|4) [05])?"),
    ("cc-by-nc", "cc creative", r"(?:creative commons attribution non ?commercial|cc by nc)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", r"cc by nc(?: (?:1|2|3|4) [05])?", r"creativecommons org licenses by nc(?: (?:1|2|3|4) [05])?"),
    ("cc-by-nc-sa", "cc creative", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", r"cc by nc sa(?: (?:1|2|3|4) [05])?", r"creativecommons org licenses by nc sa(?: (?:1|2|3|4) [05])?"),
    ("cc-by-nc-nd", "cc creative", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?|cc by nc nd)(?: (?:1|2|3|4) [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", r"cc by nc nd(?: (?:1|2|3|4) [05])?", r"creativecommons org licenses by nc nd(?: (?:1|2|3|4) [05])?"),
    ("creative-commons", "creative", r"creative commons(?: public)? licen[cs]es?", r"cc", r"creativecommons org licenses"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: (?:v|version )?1(?: 0)?)?", r"artistic 1 0", r"opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:v|version |)2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("epl-1.0", "eclipse epl", r"eclipse public licen[cs]e(?: (?:v|version |v )?1(?: 0)?)?", r"epl 1 0", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse epl", r"eclipse public licen[cs]e (?:v|version |v |)2(?: 0)?", r"epl 2 0", r"eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:v|version |v )?1 0)?", r"edl 1 0", r"eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl common", r"common development and distribution licen[cs]e(?: cddl)?(?: (?:v|version )?1 0)?", r"cddl(?: 1 0)?", r"opensource org licenses cddl 1 0|opensource org licenses cddl1"),
    ("cddl-1.1", "cddl common", r"common development and distribution licen[cs]e (?:v|version |)1 1", r"cddl 1 1", r"glassfish (?:dev )?java net public cddl"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: (?:v|version |)1 0)?", r"cpl 1 0", r"opensource org licenses cpl1 0"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: (?:v|version |)1 0)?", r"ipl 1 0", r"opensource org licenses ibmpl"),
    ("boost-1.0", "boost bsl", r"boost software licen[cs]e(?: (?:v|version |)1 0)?", r"bsl 1 0", r"boost org license 1 0(?: txt)?"),
    ("busl-1.1", "busl business", r"business source licen[cs]e(?: (?:v|version |)1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:v|version |)2 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("sspl-1.0", "sspl server", r"server side public licen[cs]e(?: (?:v|version |)1)?", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("python-2.0", "python psf", r"(?:python|python software foundation|psf) licen[cs]e(?: agreement)?(?: (?:v|version )?2)?", r"(?:python|psf) 2 0", r"docs python org 3 license html|python org psf license"),
    ("php-3.0", "php", r"php licen[cs]e(?: (?:v|version )?3 0[01]?)?", r"php 3 0[01]?", r"php net license 3 0[01]?(?: txt)?"),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e", r"ruby", r"ruby lang org en license txt"),
    ("perl", "perl", r"same terms as perl(?: itself)?|perl licen[cs]e", r"perl", r"dev perl org licenses"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql org about licence"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl org source license html"),
    ("vim", "vim", r"vim licen[cs]e", r"vim", r"vimdoc sourceforge net htmldoc uganda html"),
    ("zpl-2.1", "zope zpl", r"zope public licen[cs]e(?: zpl)?(?: (?:v|version )?2 [01])?", r"zpl 2 [01]", r"zope org resources zpl"),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? licen[cs]e", r"w3c", r"w3 org consortium legal 2002 copyright software"),
    ("ofl-1.1", "sil ofl", r"sil open font licen[cs]e(?: (?:v|version )?1 1)?|open font licen[cs]e", r"ofl 1 1", r"scripts sil org ofl"),
    ("ncsa", "ncsa illinois", r"(?:university of illinois(?: ncsa)?|ncsa)(?: open source)? licen[cs]e", r"ncsa", r"opensource org licenses ncsa"),
    ("ms-pl", "microsoft ms", r"microsoft public licen[cs]e", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal licen[cs]e", r"ms rl", r"opensource org licenses ms rl"),
    ("osl-3.0", "open osl", r"open software licen[cs]e(?: (?:v|version )?3 0)?", r"osl 3 0", r"opensource org licenses osl 3 0"),
    ("afl-3.0", "academic afl", r"academic free licen[cs]e(?: (?:v|version )?[23] [01])?", r"afl [23] [01]", r"opensource org licenses afl 3 0"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: (?:v|version )?2 0)?", r"ecl 2 0", r"opensource org licenses ecl 2 0"),
    ("eupl-1.1", "eupl european", r"european union public licen[cs]e (?:v|version |)1 1", r"eupl 1 1", r"joinup ec europa eu software page eupl"),
    ("eupl-1.2", "eupl european", r"european union public licen[cs]e(?: (?:v|version |)1 2)?", r"eupl(?: 1 2)?", r"joinup ec europa eu collection eupl eupl text eupl 12"),
    ("cecill", "cecill", r"cecill(?: [abc])? licen[cs]e|licence cecill", r"cecill(?: [abc])?(?: [12] [01])?", r"cecill info licences"),
    ("upl-1.0", "universal upl", r"universal permissive licen[cs]e(?: (?:v|version )?1 0)?", r"upl 1 0", r"oss oracle com licenses upl"),
    ("blueoak-1.0.0", "blue", r"blue oak model licen[cs]e(?: 1 0 0)?", r"blueoak 1 0 0", r"blueoakcouncil org license 1 0 0"),
    ("odbl-1.0", "odbl open", r"open (?:data commons open )?database licen[cs]e(?: (?:v|version )?1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open odc", r"open data commons attribution licen[cs]e(?: (?:v|version )?1 0)?", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", "pddl open", r"open data commons public domain dedication(?: and)? licen[cs]e", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("ogl-3.0", "government ogl", r"open government licen[cs]e(?: (?:v|version )?[123] 0)?", r"ogl uk [123] 0", r"nationalarchives gov uk doc open government licence"),
    ("openrail", "rail", r"(?:creativeml )?(?:bigscience |bigcode )?open ?rail(?: m| \+\+)? licen[cs]e", r"openrail", r"huggingface co spaces bigscience license"),
]

# copyleft families whose versions follow one rule: label, keywords, title, short name, versions, address
_VERSIONED = [
    ("gpl", "gnu gpl general", r"(?:gnu )?(?:general public licen[cs]e|gpl)", "gpl", ("1", "2", "3"), "gnu org licenses(?: old licenses)? gpl"),
    ("lgpl", "gnu lgpl lesser library", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", "lgpl", ("2", "2 1", "3"), "gnu org licenses(?: old licenses)? lgpl"),
    ("agpl", "gnu agpl affero", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)", "agpl", ("1", "3"), "gnu org licenses agpl"),
    ("gfdl", "gnu gfdl documentation", r"(?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)", "gfdl", ("1 1", "1 2", "1 3"), "gnu org licenses(?: old licenses)? fdl"),
    ("mpl", "mozilla mpl", r"(?:mozilla public licen[cs]e|mpl)", "mpl", ("1 0", "1 1", "2 0"), "mozilla org mpl"),
]

# sentences of license texts and further hints: label, kind, keyword, signature
_SENTENCES = [
    ("mit", "text", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "text", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "text", "granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "text", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "text", "endorse", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "text", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "text", "licensed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "text", "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "text", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "text", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("mpl-2.0", "text", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "text", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("zlib", "text", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "text", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost-1.0", "text", "boost", r"distributed under the boost software license version 1 0"),
    ("epl-1.0", "text", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "text", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "text", "cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("public-domain", "notice", "domain", r"(?:released|placed|dedicated|put|is|are)(?: in| into| to)? (?:the )?public domain"),
    ("public-domain", "mention", "domain", r"public domain"),
    ("proprietary", "notice", "rights", r"all rights(?: are)? reserved"),
    ("proprietary", "notice", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "notice", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)[^ ]* (?:of|is|and|or)"),
    ("proprietary", "mention", "eula", r"end user licen[cs]e agreement(?: eula)?"),
    ("non-commercial", "mention", "commercial", r"(?:for|personal and|research and) non ?commercial (?:use|purposes)(?: only)?"),
    ("see-license", "mention", "licen", r"see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file)?(?: for| in)"),
    ("unknown-license", "mention", "licen", r"licen[cs]ed under (?:the )?(?:terms|licen[cs]e)"),
]


@dataclass(frozen=True)
class Rule:
    """A signature over canonical text; ``keywords``: one of them must occur for it to be tried."""

    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern


#: Bars of an address outside its brackets.
_ALTERNATIVES = re.compile(r"\|(?![^()]*\))")


def rules() -> list[Rule]:
    """All rules in order: those that come first win where detections of equal kind and length lie on each other."""
    made = []

    def add(label, kind, keywords, pattern):
        made.append(Rule(label, kind, tuple(keywords.split()), re.compile(rf"(?<= )(?:{pattern})(?= )")))

    def family(label, keywords, title, tag, address):
        add(label, "notice", keywords, rf"{GRANT} (?:{title})")
        add(label, "tag", keywords + " " + tag.split()[0] if tag[0].isalnum() and "(" not in tag.split()[0] else keywords, rf"(?:spdx license identifier|license|licence) (?:{tag})")
        add(label, "url", " ".join(re.match("[0-9a-z]+", x)[0] for x in _ALTERNATIVES.split(address)), rf"(?:https? )?(?:www )?(?:{address})")
        add(label, "title", keywords, rf"(?:the )?(?:{title})")

    for label, kind, keyword, pattern in _SENTENCES:
        if kind == "text":
            add(label, kind, keyword, pattern)
    for row in _FAMILIES:
        family(*row)
    for label, keywords, title, short, versions, address in _VERSIONED:
        for v in versions:
            name = f"{label}-{v.replace(' ', '.')}" + ("" if " " in v else ".0")
            number = v if " " in v else rf"{v}(?: 0)?"
            family(
                name, keywords, rf"{title}(?: {short})? ?(?:v|version |v |ver |)(?:{number})(?! [0-9])(?: (?:only|or(?: at your option)?(?: any)? later(?: version)?|or newer))?",
                rf"{short} ?v?{number}(?: only| or later)?", rf"{address} (?:v ?)?{number}(?: html| txt)?",
            )
        family(label, keywords, title, short, address)
    for label, kind, keyword, pattern in _SENTENCES:
        if kind != "text":
            add(label, kind, keyword, pattern)
    return made


_SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_LOWER = {k: k + 32 for k in range(65, 91)}


def canonical(text: str) -> str:
    """Words in lower case (A-Z only) with one space between them and at both ends."""
    return " " + _SPLIT.sub(" ", text.translate(_TO_LOWER)).strip(" ") + " "


def word_numbers(line: str) -> list[int]:
    """Places of the blanks of canonical text: the word after blank k is word k."""
    return [m.start() for m in re.finditer(" ", line)]


def base_places(line: str, blanks: list[int] | None = None) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase in canonical text, in order."""
    found, blanks = [], word_numbers(line) if blanks is None else blanks
    for phrase, label in BASE.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            found.append((bisect_left(blanks, at), label))
            at = line.find(f" {phrase} ", at + 1)
    return sorted(found)


class Taken:
    """Detections that were taken: whether a further one lies within one of them, or overlaps one of its label."""

    def __init__(self) -> None:
        # none of these lies within another, so their ends rise with their starts
        self.starts, self.ends = [], []
        self.by_label: dict[str, tuple[list[int], list[int]]] = {}

    def add(self, label: str, a: int, b: int) -> bool:
        """Take [a, b) unless it is suppressed."""
        k = bisect_right(self.starts, a)
        if k and self.ends[k - 1] >= b:
            return False
        starts, ends = self.by_label.setdefault(label, ([], []))  # disjoint
        own = bisect_right(starts, a)
        if own and ends[own - 1] > a or own < len(starts) and starts[own] < b:
            return False
        starts.insert(own, a)
        ends.insert(own, b)
        lo = bisect_left(self.starts, a)
        hi = max(lo, bisect_right(self.ends, b))
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]
        return True


def detections(line: str, all_rules: list[Rule], blanks: list[int] | None = None) -> list[tuple[str, str, int, int]]:
    """(label, kind, first word, last word) of what the rules find in canonical text, in order of place.

    Only rules with an occurring keyword are tried.  Detections are taken by priority of kind,
    then length, then order of the rules; one that lies within a taken one, or overlaps one of the
    same label, is suppressed.
    """
    blanks = word_numbers(line) if blanks is None else blanks
    present: dict[str, bool] = {}
    found = []
    for k, rule in enumerate(all_rules):
        for word in rule.keywords:
            if word not in present:
                present[word] = word in line
        if any(present[word] for word in rule.keywords):
            for m in rule.pattern.finditer(line):
                found.append((PRIORITY[rule.kind], m.start() - m.end(), k, m.start(), m.end()))
    so_far = Taken()
    taken = [(k, a, b) for _, _, k, a, b in sorted(found) if so_far.add(all_rules[k].label, a, b)]
    out = []
    for k, a, b in sorted(taken, key=lambda t: (t[1], t[2], t[0])):
        first = bisect_left(blanks, a) - 1
        out.append((all_rules[k].label, all_rules[k].kind, first, first + bisect_left(blanks, b) - bisect_left(blanks, a)))
    return out


_WORD = byte_table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)


def shortest(pattern) -> set[str]:
    """The texts that a parsed pattern matches with nothing optional, one for each choice; what is no single character is a NUL."""
    out = {""}
    for op, value in pattern:
        name = str(op)
        if name == "LITERAL":
            some = {chr(value)}
        elif name == "SUBPATTERN":
            some = shortest(value[-1])
        elif name == "BRANCH":
            some = set().union(*map(shortest, value[1]))
        elif name == "MAX_REPEAT":
            some = shortest(value[2]) if value[0] else {""}
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            some = {""}
        else:
            some = {"\0"}
        out = {x + y for x in out for y in some}
    return out


def gate(every: list[Rule]) -> str:
    """What a text must hold, in any case, to be looked at word by word, from the base phrases and the rules' own patterns.

    Of each way in which a rule can match, ``licen`` or else the longest run of letters and digits
    must be there, of runs that hold a keyword if there are any; a run of up to 3 must begin a word.
    No run goes over a gap between words, so whatever stands in the gap passes.
    """
    titles = {way for rule in every if rule.kind == "title" for way in shortest(re._parser.parse(rule.pattern.pattern))}
    runs = {max(phrase.split(), key=len) if "licen" not in phrase else "licen" for phrase in BASE if not phrase.startswith("cc ")} | {"cc"}
    for rule in every:
        for way in shortest(re._parser.parse(rule.pattern.pattern)):
            if "licen" in way:
                runs.add("licen")
            elif rule.kind != "notice" or not any(way.endswith(f" {t}") for t in titles):  # a notice with a title passes by the title
                words = re.findall("[0-9a-z]+", way)
                runs.add(max([w for w in words if any(k in w for k in rule.keywords)] or words, key=lambda w: (len(w), w)))
    runs = {w for w in runs if not any(v != w and len(v) > 3 and v in w for v in runs)}
    return "|".join([*sorted(w for w in runs if len(w) > 3), rf"(?:^|[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}])(?:{'|'.join(sorted(w for w in runs if len(w) <= 3))})"])


DETECTED = "array<struct<label:string,kind:string,first_word:int,last_word:int>>"


def scan(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row and n_words long, base array<struct<word,label>>, found array<struct<label,kind,first_word,last_word>>.

    Whole texts.  Most texts are passed over by one pattern on the bytes; the rest is brought
    into canonical words and the rules run over it.  Base phrases are always reported; the rules
    add detections.

    Null and empty texts: no words, empty lists.  Very long texts: words are counted in pieces;
    rules need the whole text in the memory of its task, and time in proportion to it.  Repeated rows and null ids: a row each.  Empty table: no rows.
    An added column whose name is carried already gets an underscore.
    """
    names = [unused(x, docs.select(*carry)) for x in ("n_words", "base", "found")]
    text = unused("whole text", docs.select(*carry))
    base_type = pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def task(batches):
        every = rules()
        pattern = gate(every)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = np.zeros(batch.num_rows, np.int64)
            for row, offsets, data in text_pieces(column):
                n[row : row + len(offsets) - 1] += np.diff(Words(offsets, data, _WORD[data]).first)
            base, found = [[] for _ in n], [[] for _ in n]
            hit = pc.fill_null(pc.match_substring_regex(column, pattern, ignore_case=True), False)
            for k in np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist():
                line = canonical(column[k].as_py())
                blanks = word_numbers(line)
                base[k] = [{"word": w, "label": x} for w, x in base_places(line, blanks)]
                found[k] = [dict(zip(("label", "kind", "first_word", "last_word"), d, strict=True)) for d in detections(line, every, blanks)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n), pa.array(base, base_type), pa.array(found, found_type)], [*batch.schema.names[:-1], *names]
            )

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    schema = f"{kinds}{', ' if kinds else ''}`{names[0]}` long, `{names[1]}` array<struct<word:int,label:string>>, `{names[2]}` {DETECTED}"
    return in_batches(docs).select(*carry, F.col(text_col).cast("string").alias(text)).mapInArrow(lean(task), schema)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in columns]))), ",")
    doubt = F.aggregate("found", F.lit(1.0), lambda p, d: p * (1 - F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), d["kind"])))
    doubt = doubt * F.when(F.size("base") > 0, 1 - KINDS["notice"]).otherwise(1.0)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["word"])).cast("long").alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), (1 - doubt).alias("score"), F.col("found").alias("detections"),
    )

