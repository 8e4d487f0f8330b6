"""Templates of public licenses: fixed texts, and notices made by rule from license names.

Words in braces name the license. All words of a pair of braces must be found in a text, one right
after the other; of the others a share may differ.
"""

from __future__ import annotations

from itertools import product

# Short names of licenses, by SPDX identifier.
NAMES = {
    "MIT": ["{MIT} License"],
    "Apache-1.0": ["{Apache} License, Version {1.0}", "{Apache} Software License, Version {1.0}"],
    "Apache-1.1": ["{Apache} License, Version {1.1}", "{Apache} Software License, Version {1.1}"],
    "Apache-2.0": ["{Apache} License, Version {2.0}", "{Apache License 2.0}", "{Apache-2.0} License"],
    "BSD-2-Clause": ["{BSD 2-Clause} License", "{2-Clause BSD} License", "{Simplified BSD} License"],
    "BSD-3-Clause": [
        "{BSD 3-Clause} License", "{3-Clause BSD} License", "{New BSD} License", "{Modified BSD} License",
    ],
    "BSD-4-Clause": ["{BSD 4-Clause} License", "{4-Clause BSD} License", "{Original BSD} License"],
    "ISC": ["{ISC} License"],
    "Zlib": ["{zlib} License", "{zlib/libpng} License"],
    "BSL-1.0": ["{Boost Software License}, Version {1.0}", "{Boost Software License 1.0}"],
    "MPL-1.0": ["{Mozilla Public License}, Version {1.0}"],
    "MPL-1.1": ["{Mozilla Public License}, Version {1.1}", "{Mozilla Public License 1.1}"],
    "MPL-2.0": ["{Mozilla Public License}, Version {2.0}", "{Mozilla Public License 2.0}"],
    "EPL-1.0": ["{Eclipse Public License}, Version {1.0}", "{Eclipse Public License 1.0}"],
    "EPL-2.0": ["{Eclipse Public License}, Version {2.0}", "{Eclipse Public License 2.0}"],
    "Artistic-1.0": ["{Artistic License 1.0}"],
    "Artistic-2.0": ["{Artistic License 2.0}"],
    "Unlicense": ["{Unlicense}"],
}

# The GNU licenses, the versions that each has, and when these were published.
GNU = {
    "GPL": ("GNU General Public", {"1": "February 1989", "2": "June 1991", "3": "29 June 2007"}),
    "LGPL": ("GNU Lesser General Public", {"2.1": "February 1999", "3": "29 June 2007"}),
    "LGPL ": ("GNU Library General Public", {"2": "June 1991"}),
    "AGPL": ("GNU Affero General Public", {"3": "19 November 2007"}),
}

# The Creative Commons licenses and their versions.
CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_VERSIONS = {"1.0": "", "2.0": "", "2.5": "", "3.0": "Unported", "4.0": "International"}

# How a text says under which license it is.
NOTICES = (
    "Licensed under the", "Released under the", "Distributed under the", "Available under the",
    "This work is licensed under the", "This software is licensed under the terms of the",
)
LATER = ("or {later}", "or any {later} version", "or (at your option) any {later} version")

# Texts of licenses, and what files say by custom.
TEXTS = [
    (
        "MIT",
        "Permission is hereby {granted, free of charge, to any person} obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and {this permission notice shall be included} in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software {is furnished to do so. THE SOFTWARE IS PROVIDED} \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, {provided that the above copyright notice} and this "
        "permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is {hereby granted. THE SOFTWARE IS PROVIDED} \"AS IS\"",
    ),
    *[
        (
            name,
            "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met: Redistributions of source "
            "code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. Redistributions in binary form must {reproduce the above copyright notice}, "
            "this list of conditions and the following disclaimer in the documentation and/or other "
            f"materials provided with the distribution. {more}",
        )
        for name, more in (
            ("BSD-2-Clause", ""),
            (
                "BSD-3-Clause",
                "{Neither the name of} the copyright holder nor the names of its contributors may "
                "be used to {endorse or promote products} derived from this software without "
                "specific prior written permission.",
            ),
            (
                "BSD-4-Clause",
                "{All advertising materials} mentioning features or use of this software must "
                "display the following acknowledgement: This product includes software developed "
                "by the organization. Neither the name of the copyright holder nor the names of its "
                "contributors may be used to {endorse or promote products} derived from this "
                "software without specific prior written permission.",
            ),
        )
    ],
    (
        "Zlib",
        "This software is provided {as-is}, without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: {The origin of this software must not be misrepresented}",
    ),
    (
        "BSL-1.0",
        "{Boost Software License} - Version {1.0} - August 17th, 2003 Permission is hereby granted, "
        "free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
    ),
    (
        "Apache-1.1",
        "The end-user documentation included with the redistribution, if any, must include the "
        "following acknowledgment: This product includes software {developed by the Apache Software "
        "Foundation}",
    ),
    (
        "Apache-2.0",
        "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "{Apache License Version 2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND "
        "CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean "
        "the terms and conditions for use, reproduction, and distribution as defined by Sections 1 "
        "through 9 of this document.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the {Mozilla Public License}, v. {2.0}. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-1.1",
        "The contents of this file are subject to the {Mozilla Public License} Version {1.1} (the "
        "\"License\"); you may not use this file except in compliance with the License.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has {waived all copyright} and related or "
        "neighboring rights to this work.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has {waived all copyright}."),
    ("CC0-1.0", "Licensed under {CC0 1.0}"),
    ("CC0-1.0", "{CC0 1.0 Universal} Public Domain Dedication"),
    ("Unlicense", "This is {free and unencumbered software} released into the public domain."),
]


def _notices() -> list[tuple[str, str]]:
    made = [
        (name, f"{notice} {written}")
        for name, texts in NAMES.items()
        for notice, written in product(NOTICES, texts)
    ]
    return made + [(name, f"{{SPDX-License-Identifier {name}}}") for name in (*NAMES, "CC0-1.0", "0BSD")]


def _gnu() -> list[tuple[str, str]]:
    made = []
    for short, (written, versions) in GNU.items():
        short = short.strip()
        for version, published in versions.items():
            name = f"{short}-{version if '.' in version else version + '.0'}"
            spelled = {version, f"{version}.0" if "." not in version else version, f"v{version}"}
            for spelling in sorted(spelled):
                for notice in NOTICES:
                    text = f"{notice} {{{written}}} License, version {{{spelling}}}"
                    made.append((name, text.replace("version {v", "{v")))
                    made += [(f"{name}-or-later", f"{text} {later}".replace("version {v", "{v")) for later in LATER]
            made += [(name, f"{notice} {{{short}v{version}}}") for notice in NOTICES]
            made += [(f"{name}-or-later", f"{notice} {{{short}v{version}+}}") for notice in NOTICES]
            terms = (
                "This program is free software: you can redistribute it and/or modify it under the "
                f"terms of the {{{written}}} License as published by the Free Software Foundation"
            )
            made.append((name, f"{terms}, version {{{version}}} of the License."))
            made.append(
                (
                    f"{name}-or-later",
                    f"{terms}, either version {{{version}}} of the License, or (at your option) any "
                    "{later} version.",
                )
            )
            made.append((name, f"{{{written} LICENSE Version {version}}}, {published} Copyright (C) Free Software Foundation"))
            made.append((name, f"{{SPDX-License-Identifier {name}}}"))
            made.append((name, f"{{SPDX-License-Identifier {name}-only}}"))
            for ending in ("-or-later", "+"):
                made.append((f"{name}-or-later", f"{{SPDX-License-Identifier {name}{ending}}}"))
    return made


def _creative() -> list[tuple[str, str]]:
    made = []
    for (short, written), (version, scope) in product(CREATIVE.items(), CREATIVE_VERSIONS.items()):
        name = f"CC-{short}-{version}"
        for spelled in {written, written.replace("-", " "), written.replace("NoDerivatives", "NoDerivs")}:
            named = f"{{Creative Commons {spelled} {version}}} {scope} License"
            made.append((name, f"This work is licensed under a {named}"))
            made.append((name, f"Licensed under the {named}"))
        made += [(name, f"{verb} under {{CC {short} {version}}}") for verb in ("Licensed", "Released")]
        made += [(name, f"{verb} under {{{name}}}") for verb in ("Licensed", "Released")]
        made.append((name, f"{{SPDX-License-Identifier {name}}}"))
    return made


#: (SPDX identifier, text with its naming words in braces)
TEMPLATES = [*TEXTS, *_notices(), *_gnu(), *_creative()]
