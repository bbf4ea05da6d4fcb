"""Templates of the license scan.

Fixed values: notices, headers, titles and opening paragraphs of public
licenses, by name.  Whole license bodies are found by their titles or opening
paragraphs only.  A template of ``DISTINCT`` gives its name only if its
distinguishing words and version stand in the text; else its family's name.
"""

TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words and versions that have to stand in the text one behind the other, and the name to be given without them.
DISTINCT: dict[str, tuple[tuple[str, ...], str]] = {
    "apache-2.0-notice": (("apache license version 2.0",), "apache-license"),
    "apache-2.0-header": (("apache license version 2.0",), "apache-license"),
    "gpl-3.0-notice": (("gnu general public license version 3",), "gnu-license"),
    "gpl-header": (("gnu general public license", "version 3 of the license"), "gnu-license"),
    "mit-notice": (("mit license",), "license-notice"),
    "mpl-2.0-notice": (("mozilla public license version 2.0",), "mozilla-license"),
}


def _add(name: str, text: str, family: str, *words: str) -> None:
    TEMPLATES[name] = text
    DISTINCT[name] = (words, family)


for _name, _kind, _version in [("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.0", "Library ", "2"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0", "Lesser ", "3"), ("agpl-3.0", "Affero ", "3")]:
    _license = f"GNU {_kind}General Public License"
    if _name != "gpl-3.0":
        _add(f"{_name}-notice", f"This work is licensed under the {_license}, version {_version}.", "gnu-license", f"{_license} version {_version}")
        _add(
            f"{_name}-header",
            f"This {'library' if _version.startswith('2') and _kind else 'program'} is free software: you can redistribute it and/or modify it under the terms of the {_license} as published by "
            f"the Free Software Foundation, either version {_version} of the License, or (at your option) any later version.",
            "gnu-license",
            _license,
            f"version {_version} of the license",
        )
    _add(
        f"{_name}-only-header",
        f"you can redistribute it and/or modify it under the terms of the {_license} version {_version} as published by the Free Software Foundation.",
        "gnu-license",
        f"{_license} version {_version}",
    )
for _name, _title, _date in [
    ("gpl-2.0", "GNU General Public License Version 2", "June 1991"),
    ("gpl-3.0", "GNU General Public License Version 3", "29 June 2007"),
    ("lgpl-2.0", "GNU Library General Public License Version 2", "June 1991"),
    ("lgpl-2.1", "GNU Lesser General Public License Version 2.1", "February 1999"),
    ("lgpl-3.0", "GNU Lesser General Public License Version 3", "29 June 2007"),
    ("agpl-3.0", "GNU Affero General Public License Version 3", "19 November 2007"),
]:
    _add(f"{_name}-title", f"{_title}, {_date}", "gnu-license", _title)
_add("apache-2.0-title", "Apache License Version 2.0, January 2004", "apache-license", "apache license version 2.0")
_add("mpl-2.0-title", "Mozilla Public License Version 2.0", "mozilla-license", "mozilla public license version 2.0")
_add("mpl-1.1-header", "The contents of this file are subject to the Mozilla Public License Version 1.1", "mozilla-license", "mozilla public license version 1.1")

_PARTS = {"by": "Attribution", "sa": "ShareAlike", "nd": "NoDerivatives", "nc": "NonCommercial"}
for _kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    _full = "-".join(_PARTS[x] for x in _kind.split("-"))
    for _version, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _short = f"CC {_kind.upper()} {_version}"
        if f"cc-{_kind}-{_version}-notice" not in TEMPLATES:
            TEMPLATES[f"cc-{_kind}-{_version}-notice"] = f"Licensed under {_short}."
        DISTINCT[f"cc-{_kind}-{_version}-notice"] = ((_short.replace("-", " "),), "creative-commons-license")
        _add(
            f"cc-{_kind}-{_version}-statement",
            f"This work is licensed under a Creative Commons {_full} {_version} {_port} License.",
            "creative-commons-license",
            f"creative commons {_full} {_version}".replace("-", " "),
        )
_add("cc0-1.0-notice", "Licensed under CC0 1.0.", "creative-commons-license", "cc0 1.0")
TEMPLATES["cc0-dedication"] = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
    "to the public domain worldwide. This software is distributed without any warranty."
)
_add("bsd-notice", "Released under the BSD License.", "license-notice", "bsd license")
_add("bsd-2-clause-notice", "Released under the BSD 2-Clause License.", "license-notice", "bsd 2 clause")
_add("bsd-3-clause-notice", "Released under the BSD 3-Clause License.", "license-notice", "bsd 3 clause")
