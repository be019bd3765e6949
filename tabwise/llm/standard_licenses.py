"""The table of standard licence texts: full texts, their standard headers, titles and notices.

Full texts are the files of ``license_texts``, named by SPDX id; a further number marks
another edition of one text.  BSD texts, headers and one-line notices are written here.
"""

from __future__ import annotations

import re
from pathlib import Path

TEXTS = Path(__file__).parent / "license_texts"

#: SPDX id: names by which notices and titles call it.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1"),
    "Unicode-3.0": ("Unicode License V3", "Unicode-3.0"),
    "Unlicense": ("Unlicense",),
    "Artistic-1.0": ("Artistic License", "Artistic License 1.0"),
} | {
    f"{short}-{version}": (f"{name}, version {version}", f"{name} version {version}", f"{name} v{version}", f"{short} {version}", f"{short}v{version}")
    + ((f"{name}, version {version[0]}", f"{name} version {version[0]}", f"{name} v{version[0]}", f"{short} {version[0]}", f"{short}v{version[0]}") if version.endswith(".0") else ())
    for short, name, versions in (
        ("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")),
        ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
        ("LGPL", "GNU Library General Public License", ("2.0",)),
        ("AGPL", "GNU Affero General Public License", ("3.0",)),
        ("GFDL", "GNU Free Documentation License", ("1.2", "1.3")),
    )
    for version in versions
} | {
    f"CC-{kind}-{version}": tuple(
        f"{name} {version}{tail}" for name in (f"CC {kind}", f"CC-{kind}", f"Creative Commons {long}") for tail in ("", " License", " International License")
    )
    for kind, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for version in ("3.0", "4.0")
} | {"CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0")}

#: Openings of one-line notices, before the name; each also with "the" and "the terms of the".
SUBJECTS = ("", *(f"This {x} is " for x in ("work", "software", "program", "project", "file", "code", "library", "document", "text")), "All content is ")
VERBS = ("licensed", "released", "distributed", "available", "published")
LINKS = ("under ", "under the ", "under a ", "under the terms of the ")

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
GNU_HEADER = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
GNU_COPY = "\n\nYou should have received a copy of the {name} along with this {what}. If not, see <{url}://www.gnu.org/licenses/>."
GNU_MAIL = "\n\nYou should have received a copy of the {name} along with this {what}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301{usa}."

BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)


def _full_texts() -> list[tuple[str, str]]:
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        license = re.sub(r"(\.[0-9])\.[0-9]$", r"\1", path.stem)
        text = path.read_text(encoding="utf-8")
        out.append((license, text))
        if license in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1") and "END OF TERMS AND CONDITIONS" in text:
            out.append((license, text[: text.index("END OF TERMS AND CONDITIONS")]))
            out.append((license, text[: text.index("END OF TERMS AND CONDITIONS")] + "END OF TERMS AND CONDITIONS"))
        if license in ("MIT", "ISC"):
            out.append((license, text[text.index("Permission") :]))
    disclaimer = next(t for n, t in out if n == "BSD-2-Clause")
    disclaimer = disclaimer[disclaimer.index("THIS SOFTWARE IS") :]
    for count in (2, 3):
        for mark in ("", "{}. "):
            for gap in ("\n", "\n\n"):
                clauses = [mark.format(i + 1) + c for i, c in enumerate(BSD_CLAUSES[:count])]
                out.append((f"BSD-{count}-Clause", gap.join([BSD_HEAD, *clauses]) + "\n\n" + disclaimer))
    return out


def _headers() -> list[tuple[str, str]]:
    out = [("Apache-2.0", APACHE_HEADER)]
    out += [("MPL-2.0", MPL_HEADER.format(x)) for x in ("http", "https")]
    for license, name, number in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ):
        for what in ("program", "library", "file", "software"):
            either = f"either version {number} of the License, or (at your option) any later version"
            for version in (f", {either}", f"; {either}", f", version {number}", f"; version {number} of the License"):
                text = GNU_HEADER.format(what=what, mark=":", name=name, version=version)
                ends = ["", *(GNU_COPY.format(name=name, what=what, url=u) for u in ("http", "https"))]
                ends += [GNU_MAIL.format(name=name, what=what, usa=u) for u in ("", " USA", ", USA")]
                out += [(license, text + end) for end in ends]
    return out


def _notices() -> list[tuple[str, str]]:
    return [
        (license, f"{subject}{verb} {link}{name}{tail}")
        for license, names in NAMES.items()
        for name in names
        for tail in (("",) if re.search("license", name, re.I) else ("", " license"))
        for subject in SUBJECTS
        for verb in VERBS
        for link in LINKS
    ] + [(license, f"SPDX-License-Identifier: {license}{tail}") for license in NAMES for tail in ("", "-only", "-or-later")]


def titles() -> list[str]:
    """What stands above a text and names it."""
    return sorted({x for names in NAMES.values() for n in names if " " in n for x in (n, f"The {n}")} | {"The MIT License (MIT)", "MIT License (MIT)"})


def standard_texts() -> list[tuple[str, str]]:
    """(license, text) of every standard text, each with a title too where it has none."""
    full = _full_texts()
    titled = [
        (license, f"{title}\n\n{text}")
        for license, text in full
        if license in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")
        for title in titles()
        if title.removeprefix("The ").removesuffix(" (MIT)") in NAMES[license]
    ]
    found = {}
    for license, text in full + titled + _headers() + _notices():
        found.setdefault((license, " ".join(re.findall(r"\w+", text.lower())), text.count("\n\n")), (license, text))
    return list(found.values())
