"""The signature rules of the license scan: hand-written names, addresses and sentences, and the forms in which they are cited.

Patterns are over lower-case words with one space between them, as punctuation separates words: `4.0` reads `4 0`."""

from __future__ import annotations

import re
from dataclasses import dataclass

# fixed values: label, name as a pattern, words of which one must occur, address as a pattern (or none), identifier as a pattern
FAMILIES: list[tuple[str, str, str, str | None, str]] = [
    ("0bsd", "zero clause bsd|bsd zero clause|0bsd", "bsd 0bsd", "opensource org licenses? 0bsd", "0bsd"),
    ("afl-3", "academic free license(?: version| v)? 3(?: 0)?", "academic", None, "afl 3 0"),
    ("agpl-3", "(?:gnu )?affero (?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?3?(?: 0)?|agpl ?v?3(?: 0)?", "affero agpl agplv3 agpl3", "gnu org licenses agpl(?: 3 0)?", "agpl 3 0(?: only| or later)?"),
    ("apache-1.1", "apache (?:software )?license(?: version| v)? 1 1", "apache", "apache org licenses license 1 1", "apache 1 1"),
    ("apache-2", "apache (?:software |public )?licen[cs]e(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?|asl ?2(?: 0)?", "apache asl asl2", "apache org licenses license 2 0", "apache 2 0"),
    ("artistic-1", "artistic license(?: version| v)? ?1(?: 0)?", "artistic", None, "artistic 1 0"),
    ("artistic-2", "artistic license(?: version| v)? ?2(?: 0)?", "artistic", "opensource org licenses? artistic(?: license)? 2 0", "artistic 2 0"),
    ("beerware", "beer ?ware license(?: revision 42)?", "beer beerware", None, "beerware"),
    ("blueoak-1", "blue oak model license(?: 1 0 0)?", "oak", "blueoakcouncil org license 1 0 0", "blueoak 1 0 0"),
    ("bsl-1", "boost software license(?: version| v)? ?1(?: 0)?|boost software license", "boost", "boost org license 1 0", "bsl 1 0"),
    ("bsd-2", "(?:2 clause|two clause|simplified|freebsd) bsd|bsd (?:2 clause|two clause|simplified)|freebsd license", "bsd freebsd", "opensource org licenses? bsd 2 clause", "bsd 2 clause"),
    ("bsd-3", "(?:3 clause|three clause|new|revised|modified) bsd|bsd (?:3 clause|three clause|new|revised)", "bsd", "opensource org licenses? bsd 3 clause", "bsd 3 clause(?: new)?"),
    ("bsd-4", "(?:4 clause|four clause|original) bsd|bsd (?:4 clause|four clause|original)", "bsd", None, "bsd 4 clause"),
    ("business-source-1.1", "business source license(?: 1 1)?", "business", "mariadb com bsl11", "busl 1 1"),
    ("cc0-1", "cc0(?: 1 0)?|cc zero|creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", "cc0 cc creative", "creativecommons org publicdomain zero(?: 1 0)?", "cc0 1 0"),
    ("cc-by", "cc by|creative commons attribution", "cc creative", "creativecommons org licenses by", "cc by"),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc creative", "creativecommons org licenses by nc", "cc by nc"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "cc creative", "creativecommons org licenses by nc nd", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc creative", "creativecommons org licenses by nc sa", "cc by nc sa"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "cc creative", "creativecommons org licenses by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc creative", "creativecommons org licenses by sa", "cc by sa"),
    ("cc-sampling", "creative commons sampling(?: plus)?", "creative", "creativecommons org licenses sampling", "cc sampling"),
    ("cddl-1", "common development and distribution license(?: version| v)? ?1?(?: [01])?", "development", "opensource org licenses? cddl 1 0", "cddl 1 [01]"),
    ("cecill", "cecill(?: [bc])?(?: free software)?(?: license)?(?: agreement)?(?: version| v)? ?(?:2 1|2|1)?", "cecill", "cecill info licenses", "cecill(?: [bc12](?: [01])?)?"),
    ("coml-1", "computational use of data agreement(?: version| v)? ?1?(?: 0)?", "computational", None, "c uda 1 0"),
    ("cpal-1", "common public attribution license(?: version| v)? ?1?(?: 0)?", "attribution", "opensource org licenses? cpal 1 0", "cpal 1 0"),
    ("cpl-1", "common public license(?: version| v)? ?1?(?: 0)?", "common", "opensource org licenses? cpl 1 0", "cpl 1 0"),
    ("cdla-permissive", "community data license agreement permissive(?: version| v)? ?[12]?(?: 0)?", "community", "cdla (?:dev|io) permissive", "cdla permissive [12] 0"),
    ("cdla-sharing", "community data license agreement sharing(?: version| v)? ?1?(?: 0)?", "community", "cdla (?:dev|io) sharing", "cdla sharing 1 0"),
    ("ecl-2", "educational community license(?: version| v)? ?2?(?: 0)?", "educational", "opensource org licenses? ecl 2 0", "ecl 2 0"),
    ("efl-2", "eiffel forum license(?: version| v)? ?2?(?: 0)?", "eiffel", None, "efl 2 0"),
    ("elastic-2", "elastic license(?: version| v)? ?2?(?: 0)?", "elastic", "elastic co licensing elastic license", "elastic 2 0"),
    ("epl-1", "eclipse public license(?: version| v)? ?1(?: 0)?", "eclipse", "eclipse org legal epl v10", "epl 1 0"),
    ("epl-2", "eclipse public license(?: version| v)? ?2(?: 0)?", "eclipse", "eclipse org legal epl 2 0", "epl 2 0"),
    ("eupl-1.2", "european union public licen[cs]e(?: version| v)? ?1?(?: [12])?", "european", "joinup ec europa eu collection eupl", "eupl 1 [12]"),
    ("fdl", "(?:gnu )?free documentation license(?: version| v)? ?1?(?: [123])?", "documentation", "gnu org (?:licenses|copyleft) fdl(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("ftl", "freetype (?:project )?license", "freetype", None, "ftl"),
    ("gpl-1", "(?:gnu )?general public license(?: version| v) ?1(?: 0)?|gpl ?v?1(?: 0)?", "general gpl gplv1 gpl1", "gnu org licenses (?:old licenses )?gpl 1 0", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "(?:gnu )?general public license(?: version| v) ?2(?: 0)?|gpl ?v?2(?: 0)?", "general gpl gplv2 gpl2", "gnu org licenses (?:old licenses )?gpl 2 0", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?general public license(?: version| v) ?3(?: 0)?|gpl ?v?3(?: 0)?", "general gpl gplv3 gpl3", "gnu org licenses gpl 3 0", "gpl 3 0(?: only| or later)?"),
    ("gpl", "(?:gnu )?general public license|gnu gpl", "gnu general gpl", "gnu org (?:licenses|copyleft) gpl", "gpl"),
    ("hpnd", "historical permission notice and disclaimer", "historical", "opensource org licenses? hpnd", "hpnd"),
    ("icu", "icu license", "icu", None, "icu"),
    ("ijg", "independent jpeg group(?: s)? license", "jpeg", None, "ijg"),
    ("ipl-1", "ibm public license(?: version| v)? ?1?(?: 0)?", "ibm", "opensource org licenses? ipl 1 0", "ipl 1 0"),
    ("isc", "isc license|internet systems consortium license", "isc consortium", "opensource org licenses? isc", "isc"),
    ("lgpl-2", "(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?|lgpl ?v?2(?: 0)?", "library lgpl lgplv2", "gnu org licenses (?:old licenses )?lgpl 2 0", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: version| v)? ?2 1|lgpl ?v?2 1", "lesser lgpl lgplv2", "gnu org licenses (?:old licenses )?lgpl 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?|lgpl ?v?3(?: 0)?", "lesser lgpl lgplv3", "gnu org licenses lgpl 3 0", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license|gnu lgpl", "lesser library lgpl", "gnu org (?:licenses|copyleft) lgpl", "lgpl"),
    ("libpng", "(?:libpng|png reference library) license(?: version 2)?", "libpng png", "libpng org pub png src libpng license", "libpng(?: 2 0)?"),
    ("lpl-1", "lucent public license(?: version| v)? ?1?(?: 0[12])?", "lucent", None, "lpl 1 0[12]?"),
    ("lppl", "latex project public license(?: version| v)? ?1?(?: 3[ac]?)?", "latex", "latex project org lppl", "lppl 1 [0123][ac]?"),
    ("mit", "mit licen[cs]e|mit x11 license|expat license|massachusetts institute of technology license", "mit expat massachusetts", "opensource org licenses? mit(?: license)?", "mit"),
    ("mit-0", "mit no attribution(?: license)?|mit 0 license", "mit", "opensource org licenses? mit 0", "mit 0"),
    ("mpl-1.1", "mozilla public license(?: version| v)? ?1(?: [01])?", "mozilla", "mozilla org mpl (?:mpl )?1 1", "mpl 1 [01]"),
    ("mpl-2", "mozilla public license(?: version| v)? ?2(?: 0)?", "mozilla", "mozilla org (?:en us )?mpl 2 0", "mpl 2 0(?: no copyleft exception)?"),
    ("ms-pl", "microsoft public license|ms pl", "microsoft ms", "opensource org licenses? ms pl", "ms pl"),
    ("ms-rl", "microsoft reciprocal license|ms rl", "microsoft ms", "opensource org licenses? ms rl", "ms rl"),
    ("mulan-2", "mulan (?:psl|permissive software license)(?: version| v)? ?2?", "mulan", "license coscl org cn mulanpsl2", "mulanpsl 2 0"),
    ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa illinois", "opensource org licenses? ncsa", "ncsa"),
    ("odbl-1", "open database license(?: version| v)? ?1?(?: 0)?|odbl", "database odbl", "opendatacommons org licenses odbl(?: 1 0)?", "odbl 1 0"),
    ("odc-by-1", "open data commons attribution(?: license)?(?: version| v)? ?1?(?: 0)?|odc by", "odc commons", "opendatacommons org licenses by(?: 1 0)?", "odc by 1 0"),
    ("ofl-1.1", "(?:sil )?open font license(?: version| v)? ?1?(?: 1)?", "font", "scripts sil org ofl", "ofl 1 1(?: rfn| no rfn)?"),
    ("ogl-3", "open government licen[cs]e(?: version| v)? ?[123]?(?: 0)?", "government", "nationalarchives gov uk doc open government licence", "ogl uk [123] 0"),
    ("openldap", "openldap public license(?: version| v)? ?2?(?: 8)?", "openldap", None, "oldap 2 8"),
    ("openssl", "openssl license", "openssl", None, "openssl"),
    ("osl-3", "open software license(?: version| v)? ?3?(?: 0)?", "software", "opensource org licenses? osl 3 0", "osl 3 0"),
    ("pddl-1", "public domain dedication and licen[cs]e|pddl", "dedication pddl", "opendatacommons org licenses pddl(?: 1 0)?", "pddl 1 0"),
    ("php-3", "php license(?: version| v)? ?3?(?: 0[01]?)?", "php", "php net license", "php 3 0[01]?"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses? postgresql", "postgresql"),
    ("psf-2", "python software foundation license(?: version| v)? ?2?|psf license", "python psf", "python org (?:psf )?license", "psf 2 0"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license(?: 1 0 0)?", "polyform", "polyformproject org licenses", "polyform [a-z]+ 1 0 0"),
    ("qpl-1", "q public license(?: version| v)? ?1?(?: 0)?", "q", "opensource org licenses? qpl 1 0", "qpl 1 0"),
    ("rail", "(?:creative ml )?open ?rail(?: m)?(?: license)?|responsible ai license", "openrail rail responsible", None, "openrail(?: m)?"),
    ("ruby", "ruby license", "ruby", "ruby lang org en about license", "ruby"),
    ("sspl-1", "server side public license(?: version| v)? ?1?", "server", "mongodb com licensing server side public license", "sspl 1 0"),
    ("unicode", "unicode license(?: agreement)?(?: v3)?", "unicode", "unicode org (?:copyright|license)", "unicode (?:3 0|dfs 201[56])"),
    ("unlicense", "the unlicense|unlicense", "unlicense", "unlicense org", "unlicense"),
    ("upl-1", "universal permissive license(?: version| v)? ?1?(?: 0)?", "universal", "opensource org licenses? upl", "upl 1 0"),
    ("vim", "vim license", "vim", None, "vim"),
    ("w3c", "w3c (?:software|document)(?: and document| notice and)? (?:license|notice)", "w3c", "w3 org consortium legal", "w3c(?: 20150513)?"),
    ("wtfpl", "wtfpl|do what the [a-z]+ you want to public license", "wtfpl want", "wtfpl net", "wtfpl"),
    ("x11", "x11 license|x consortium license", "x11 consortium", None, "x11"),
    ("zlib", "zlib(?: libpng)? license", "zlib", "opensource org licenses? zlib", "zlib"),
    ("zpl-2", "zope public license(?: version| v)? ?2?(?: [01])?", "zope", None, "zpl 2 [01]"),
]

# fixed values: label, sentence of a license's text as a pattern, words of which one must occur
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("bsd", "redistributions? of source code must retain the above copyright notice", "redistributions redistribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3", "neither the names? of .{1,120}? nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl-2", "either version 2 of the license or at your option any later version", "option"),
    ("gpl-3", "either version 3 of the license or at your option any later version", "option"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:dedicated|released|placed|donated) (?:in)?to the public domain|in the public domain", "domain"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim"),
    ("beerware", "you can buy me a beer in return", "beer"),
    ("all-rights-reserved", "all rights reserved|alle rechte vorbehalten|tous droits reserves|todos los derechos reservados", "rights rechte droits derechos"),
    ("proprietary", "(?:this is )?(?:confidential and proprietary|proprietary and confidential)|unauthorized (?:copying|use|reproduction)(?: or distribution)? (?:of this [a-z]+ )?(?:via any medium )?is (?:strictly )?prohibited", "proprietary unauthorized"),
    ("non-commercial", "for non ?commercial (?:use|purposes) only|not for commercial use", "commercial noncommercial"),
    ("no-redistribution", "may not be (?:reproduced|redistributed|copied)(?: or [a-z]+)?(?: in any form)? without (?:the )?(?:prior |express )?(?:written )?permission", "permission"),
]

# fixed values: the kinds of evidence, first the ones that win; how sure a detection of each is; its form around a name
KINDS = {"sentence": 0.95, "identifier": 1.0, "address": 0.9, "notice": 0.95, "name": 0.7}
VERSION = "(?: (?:international|unported|generic|universal))?(?: (?:license|licence))?(?: (?:version|v))?(?: v?[1-4](?: [0-9])?)?(?: (?:international|unported|generic|universal|license|licence))*"
FORMS = {
    "identifier": "(?:spdx )?license identifier (?:{})",
    "address": "(?:https? )?(?:www )?(?:{})(?: [1-4](?: [0-9])?)?(?: (?:html|txt|php|legalcode|deed [a-z]+))*",
    "notice": "(?:re)?(?:licen[cs]ed|released|distributed|published|provided|available|covered|governed|used|shared|offered)(?: to you)? (?:under|by|with)(?: an?| the)?(?: terms of(?: the)?)?(?: an?| the)? (?:{})" + VERSION,
    "name": "(?:{})" + VERSION,
}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern
    keywords: frozenset[bytes]          # one must occur
    also: frozenset[bytes]              # and one of these, where there are any

    @property
    def confidence(self) -> float:
        return KINDS[self.kind]


def _rule(label: str, kind: str, body: str, keywords: str, also: str = "") -> Rule:
    return Rule(label, kind, re.compile(f"(?<= )(?:{body})(?= )".encode()), *(frozenset(k.encode() for k in ks.split()) for ks in (keywords, also)))


def rules() -> list[Rule]:
    """All rules, in their order: by kind, then as listed."""
    out = [_rule(label, "sentence", body, keywords) for label, body, keywords in SENTENCES]
    out += [_rule(label, "identifier", FORMS["identifier"].format(ident), "identifier") for label, _, _, _, ident in FAMILIES]
    out += [_rule(label, "address", FORMS["address"].format(url), url.split()[0], "org info com io dev co net cn eu uk")
            for label, _, _, url, _ in FAMILIES if url]
    for kind, also in (("notice", "licensed licenced released relicensed distributed published provided available covered governed used shared offered"), ("name", "")):
        out += [_rule(label, kind, FORMS[kind].format(name), keywords, also) for label, name, keywords, _, _ in FAMILIES]
    return out
