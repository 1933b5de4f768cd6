"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice
phrases in one pass over each text; a shunting-yard parser evaluates the
licence expressions that follow the tags.

A document's licences are what its notices name together with its tags'
expressions; all of them hold at once.  The verdict is the strictest class
that the document can be used under: in an expression OR takes the most
permissive side, AND the strictest, and WITH softens a strong copyleft
licence to weak when the exception is a known linking exception.  A notice that
reserves all rights, or claims copyright, and no more makes a text proprietary;
beside a licence it takes nothing away, as licences' own headers hold it.

A family's notice ('GNU General Public License') names the version that follows
it; without one, or with one that there isn't, the family's usual version.

Defined cases: a null or empty text has no licences (class 'none'); a tag with
a malformed expression, or an unknown name, is of class 'unknown', the tag NONE
of class 'none'; a licence named twice counts once; every row
of the table gives one row, repeated or without id alike.
Texts of any length are scanned whole; a null doc_id stays null; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: From the most permissive to the strictest.
CLASSES = ("none", "public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "non-commercial", "proprietary", "unknown")
NAMES = {
    "public-domain": "CC0-1.0 CC-PDDC Unlicense 0BSD PDDL-1.0 WTFPL SAX-PD libtiff-PD NIST-PD NIST-PD-fallback blessing LZMA-SDK-9.22",
    "permissive": """MIT MIT-0 MIT-CMU MIT-Modern-Variant MIT-Wu MIT-advertising MIT-enna MIT-feh MIT-open-group MITNFA X11 X11-distribute-modifications-variant ISC ISC-Veillard Zlib zlib-acknowledgement libpng
        libpng-2.0 Libpng NCSA Apache-1.0 Apache-1.1 Apache-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL
        BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-Protection BSD-Source-Code BSL-1.0 BlueOak-1.0.0 PSF-2.0 Python-2.0 Python-2.0.1 CNRI-Python
        PostgreSQL PHP-3.0 PHP-3.01 Ruby-pty Artistic-2.0 AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AML Adobe-2006 Adobe-Glyph Afmparse Beerware Bahyph Borceux bzip2-1.0.5 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0
        CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 Crossword curl DOC DSDP ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 Entessa FSFAP FSFUL FSFULLR FTL Fair Giftware HPND HPND-sell-variant HTMLTIDY
        IBM-pibs ICU IJG ImageMagick Info-ZIP Intel JasPer-2.0 Leptonica Linux-OpenIB MirOS MS-PL MulanPSL-1.0 MulanPSL-2.0 Multics NAIST-2003 NTP Naumen Net-SNMP NetCDF Newsletr OFL-1.0 OFL-1.1 OGTSL OLDAP-2.8
        OML OpenSSL ODC-By-1.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 Plexus PIL Rdisc RSA-MD SGI-B-2.0 SMLNJ SSH-OpenSSH SSH-short SWL Spencer-86 Spencer-94 Spencer-99 StandardML-NJ TCL TCP-wrappers TU-Berlin-1.0
        TU-Berlin-2.0 UPL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-TOU VSL-1.0 W3C W3C-19980720 W3C-20150513 Wsuipa Xerox Xnet XFree86-1.1 Xdebug-1.03 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed Zend-2.0 diffmark
        dvipdfm eGenix gnuplot mpich2 psfrag psutils xinetd xpp""",
    "weak-copyleft": """LGPL-2.0 LGPL-2.1 LGPL-3.0 LGPLLR MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 ErlPL-1.1
        NPL-1.0 NPL-1.1 SPL-1.0 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 ClArtistic LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c QPL-1.0 CeCILL-C CERN-OHL-W-2.0 OCLC-2.0 SISSL Nokia MotosotoA gSOAP-1.3b
        Interbase-1.0 CATOSL-1.1 BitTorrent-1.0 BitTorrent-1.1 Condor-1.1 LPL-1.0 LPL-1.02 NOSL Ruby YPL-1.1 Vim ODbL-1.0""",
    "copyleft": """GPL-1.0 GPL-2.0 GPL-3.0 GPL-2.0-with-GCC-exception GFDL-1.1 GFDL-1.2 GFDL-1.3 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 OSL-1.0 OSL-1.1 OSL-2.0
        OSL-2.1 OSL-3.0 MS-RL CeCILL-1.0 CeCILL-1.1 CeCILL-2.0 CeCILL-2.1 CERN-OHL-S-2.0 CDLA-Sharing-1.0 C-UDA-1.0 Sleepycat CPOL-1.02 LAL-1.2 LAL-1.3 FreeImage RSCPL Watcom-1.0 SimPL-2.0 copyleft-next-0.3.1""",
    "network-copyleft": "AGPL-1.0 AGPL-3.0 SSPL-1.0 RPL-1.1 RPL-1.5 CPAL-1.0 CAL-1.0 CAL-1.0-Combined-Work-Exception Parity-6.0.0 Parity-7.0.0 Watcom-2.0",
    "non-commercial": " ".join(
        f"CC-BY-{kind}-{version}" for kind in ("NC", "NC-SA", "NC-ND", "ND") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")
    ) + " CC-BY-NC-SA-2.0-FR CC-BY-NC-SA-2.0-UK BUSL-1.1 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 Elastic-2.0 JSON Hippocratic-2.1 TAPR-OHL-1.0 Aladdin NCGL-UK-2.0 OPUBL-1.0",
    "proprietary": "All-Rights-Reserved Copyright-Notice LicenseRef-Proprietary",
}
CLASS_OF = {n.lower(): (n, c) for c, ns in NAMES.items() for n in ns.split()}
LINKING = {x.lower() for x in "Classpath-exception-2.0 GCC-exception-3.1 GCC-exception-2.0 Bison-exception-2.2 Autoconf-exception-3.0 LLVM-exception Linux-syscall-note Font-exception-2.0 OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0".split()}
#: Notice phrases, in lower case with single spaces.
PHRASES = {
    "licensed under the apache license, version 2.0": "Apache-2.0",
    "under the apache license, version 2.0": "Apache-2.0",
    "under the apache license version 2.0": "Apache-2.0",
    "under the apache license 2.0": "Apache-2.0",
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "licensed under the bsd license": "BSD-3-Clause",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "dedicated to the public domain": "CC0-1.0",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "licensed under cc by-nd 4.0": "CC-BY-ND-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0",
    "creative commons attribution 4.0": "CC-BY-4.0",
    "licensed under cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0",
    "creative commons attribution-noncommercial-sharealike 4.0": "CC-BY-NC-SA-4.0",
    "creative commons attribution-noderivatives 4.0": "CC-BY-ND-4.0",
    "creative commons attribution-noderivs 4.0": "CC-BY-ND-4.0",
    "creative commons attribution-noncommercial-noderivatives 4.0": "CC-BY-NC-ND-4.0",
    "creative commons attribution-noncommercial-noderivs 4.0": "CC-BY-NC-ND-4.0",
    "licensed under cc by 3.0": "CC-BY-3.0",
    "licensed under cc by-sa 3.0": "CC-BY-SA-3.0",
    "licensed under cc by-nc 3.0": "CC-BY-NC-3.0",
    "licensed under cc by-nc-sa 3.0": "CC-BY-NC-SA-3.0",
    "licensed under cc by-nd 3.0": "CC-BY-ND-3.0",
    "licensed under cc by-nc-nd 3.0": "CC-BY-NC-ND-3.0",
    "creative commons attribution 3.0": "CC-BY-3.0",
    "creative commons attribution-sharealike 3.0": "CC-BY-SA-3.0",
    "creative commons attribution-noncommercial 3.0": "CC-BY-NC-3.0",
    "creative commons attribution-noncommercial-sharealike 3.0": "CC-BY-NC-SA-3.0",
    "creative commons attribution-noderivatives 3.0": "CC-BY-ND-3.0",
    "creative commons attribution-noderivs 3.0": "CC-BY-ND-3.0",
    "creative commons attribution-noncommercial-noderivatives 3.0": "CC-BY-NC-ND-3.0",
    "creative commons attribution-noncommercial-noderivs 3.0": "CC-BY-NC-ND-3.0",
    "boost software license - version 1.0": "BSL-1.0",
    "all rights reserved": "All-Rights-Reserved",
    "all rights are reserved": "All-Rights-Reserved",
    "alle rechte vorbehalten": "All-Rights-Reserved",
    "tous droits réservés": "All-Rights-Reserved",
    "todos los derechos reservados": "All-Rights-Reserved",
    "copyright (c)": "Copyright-Notice",
    "copyright ©": "Copyright-Notice",
}
#: Families that are named by a phrase and, within VERSION_WITHIN characters, a version; the second is for a mention without one,
#: which leaves the choice to whoever uses the text, so the most permissive version stands.  Where the text offers a choice
#: ('version 2 or later'), the first version named counts.
FAMILIES = {
    "gnu general public license": ("GPL", "2.0"), "gnu gpl": ("GPL", "2.0"), "gnu lesser general public license": ("LGPL", "2.1"), "gnu library general public license": ("LGPL", "2.0"),
    "gnu lgpl": ("LGPL", "2.1"), "gnu affero general public license": ("AGPL", "3.0"), "gnu agpl": ("AGPL", "3.0"), "gnu free documentation license": ("GFDL", "1.3"),
    "mozilla public license": ("MPL", "2.0"), "eclipse public license": ("EPL", "2.0"), "european union public licence": ("EUPL", "1.2"), "open software license": ("OSL", "3.0"),
    "common development and distribution license": ("CDDL", "1.0"), "academic free license": ("AFL", "3.0"), "artistic license": ("Artistic", "2.0"), "open font license": ("OFL", "1.1"),
}
VERSION_WITHIN = 120
_VERSION = re.compile(r"\bversion (\d+(?:\.\d+)?)|\bv\.? ?(\d+(?:\.\d+)?)|^[ ,(-]*(\d+\.\d+)")
#: A family names the text's licence only near one of these: 'the history of the GNU General Public License' is no notice.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of", "published by the free software foundation", "redistribute it and/or modify")
TAGS = ("spdx-license-identifier:", "license-expression:", "packagelicenseconcluded:", "packagelicensedeclared:", "licenseconcluded:", "licenseinfoinfile:")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_RANK = {c: i for i, c in enumerate(CLASSES)}
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_SPACE = re.compile(r"\s+")
#: Copyright claims by their year, in lower case: 'copyright 2020', '(c) 1999', '© 2020'.
_CLAIM = re.compile(r"(?:\bcopyright:?|\(c\)|©) ?(?:19|20)\d\d(?!\d)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: WITH binds tightest, then AND, then OR.  ValueError if malformed."""
    out: list[str] = []
    waiting: list[str] = []
    at, operand_next = 0, True
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no licence expression: {expression!r}")
        at, token = m.end(), m.group(1)
        word = token.lower()
        if word in _BINDS or token == ")":
            if operand_next:
                raise ValueError(f"{token} without a left side: {expression!r}")
            while waiting and waiting[-1] != "(" and (token == ")" or _BINDS[waiting[-1]] >= _BINDS[word]):
                out.append(waiting.pop())
            if token == ")":
                if not waiting:
                    raise ValueError(f"unopened bracket: {expression!r}")
                waiting.pop()
            else:
                waiting.append(word)
                operand_next = True
        elif not operand_next:
            raise ValueError(f"two names without an operator: {expression!r}")
        elif token == "(":
            waiting.append(token)
        else:
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError(f"it ends early: {expression!r}")
    while waiting:
        if waiting[-1] == "(":
            raise ValueError(f"unclosed bracket: {expression!r}")
        out.append(waiting.pop())
    return out


def _named(name: str) -> tuple[str, str]:
    plain = name.lower().removesuffix("+").removesuffix("-or-later").removesuffix("-only")
    return CLASS_OF.get(plain, (name, "unknown"))


def evaluate(expression: str) -> tuple[str, list[str]]:
    """The class of an expression and the licences it names; 'unknown' if malformed."""
    names: list[str] = []
    stack: list[tuple[str, str]] = []
    try:
        for token in to_postfix(expression):
            if token not in _BINDS:
                stack.append((token, ""))
                continue
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if left[1] or right[1]:
                    raise ValueError("WITH takes a licence and an exception")
                name, kind = _named(left[0])
                names.append(name)
                known = right[0].lower() in LINKING
                stack.append(("", "weak-copyleft" if known and kind == "copyleft" else kind if known else "unknown"))
                continue
            kinds = []
            for name, kind in (left, right):
                if not kind:
                    name, kind = _named(name)
                    names.append(name)
                kinds.append(kind)
            stack.append(("", (min if token == "or" else max)(kinds, key=_RANK.__getitem__)))
        name, kind = stack.pop()
    except ValueError:
        return "unknown", []
    if not kind:
        name, kind = _named(name)
        names.append(name)
    return kind, names


def _automaton(phrases: dict[str, str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, (len(tag), "tag", None))
    for phrase in FAMILIES:
        found.add_word(phrase, (len(phrase), "family", phrase))
    for phrase, name in phrases.items():
        found.add_word(phrase, (len(phrase), "notice", name))
    found.make_automaton()
    return found


def _member(flat: str, start: int, end: int, family: str) -> str | None:
    """The licence that a family's mention at flat[start:end] grants, if it does."""
    after = flat[end : end + VERSION_WITHIN]
    near = flat[max(0, start - VERSION_WITHIN) : start] + flat[start:end] + after
    if not any(g in near for g in GRANTS):
        return None
    stem, version = FAMILIES[family]
    if m := _VERSION.search(after):
        given = next(g for g in m.groups() if g)
        name = f"{stem}-{given if '.' in given else given + '.0'}"
        version = version if name.lower() not in CLASS_OF else name.removeprefix(f"{stem}-")
    return f"{stem}-{version}"


def _expression(line: str) -> str:
    """The longest start of the line that reads as tokens of an expression, without comment ends."""
    at, depth, operand = 0, 0, True
    end = 0
    while m := _TOKEN.match(line, at):
        word = m.group(1)
        low = word.lower()
        if word == "(":
            if not operand:
                break
            depth += 1
        elif word == ")":
            if depth == 0:
                break
            depth -= 1
        elif low in _BINDS:
            operand = True
        elif not operand:
            break
        else:
            operand = False
        at = end = m.end()
    return line[:end].strip()


def scan_text(text: str | None, automaton, claims: bool = True) -> tuple[list[str], list[str], str]:
    """Licences, tag expressions and the class of one text; claims: whether copyright claims by year, and families, are notices."""
    names, expressions, kind = set(), [], "none"
    # White space runs count as one space, so a notice may be broken over lines.
    lines = (text or "").replace("\r", "\n")
    flat = _SPACE.sub(" ", lines).lower()
    tagged = False
    for end, (length, what, name) in automaton.iter(flat):
        start = end + 1 - length
        if start and flat[start - 1].isalnum() and flat[start].isalnum():
            continue
        if what == "tag":
            tagged = True
        elif end + 1 == len(flat) or not (flat[end].isalnum() and flat[end + 1].isalnum()):
            name = name if what == "notice" else _member(flat, start, end + 1, name) if claims else None
            if name:
                names.add(name)
    if claims and _CLAIM.search(flat):
        names.add("Copyright-Notice")
    granted = [k for n in names if (k := CLASS_OF[n.lower()][1]) != "proprietary"]  # notices name known licences
    kind = max(granted, default="none", key=_RANK.__getitem__)
    if tagged:  # an expression ends with its line, so tags are sought in the text as it is
        plain = lines.translate(_ASCII_LOWER)
        for end, (length, what, _) in automaton.iter(plain):
            if what != "tag" or (end >= length and plain[end - length].isalnum()):
                continue
            stop = lines.find("\n", end)
            expression = _expression(lines[end + 1 : stop if stop >= 0 else len(lines)])
            expressions.append(expression)
            if expression.upper() == "NONE":
                continue
            k, found = evaluate(expression)
            names.update(found)
            kind = max(kind, k, key=_RANK.__getitem__)
    if names and not granted and not expressions:
        kind = "proprietary"
    return sorted(names), expressions, kind


def scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, allowed: tuple[str, ...] = ("none", "public-domain", "permissive")) -> DataFrame:
    """One row for each row: doc_id, licences, expressions, class, allowed."""
    given = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(given)
        for batch in batches:
            found = [scan_text(t, automaton, phrases is None) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "licences": pa.array([f[0] for f in found], pa.list_(pa.string())),
                "expressions": pa.array([f[1] for f in found], pa.list_(pa.string())),
                "class": pa.array([f[2] for f in found], pa.string()),
                "allowed": pa.array([f[2] in allowed for f in found], pa.bool_()),
            })

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, licences array<string>, expressions array<string>, class string, allowed boolean"
    )
