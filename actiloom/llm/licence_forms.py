"""Full texts, standard headers, usual sentences and SPDX forms by which works name their licence.

Licences of several pages are named by their titles and the headers they ask for.
"""

from __future__ import annotations

#: Per licence: its SPDX identifiers' stem, names in running text, words that a form must not lack.
NAMES = {
    "apache-2.0": ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "apache 2.0"),
    "mit": ("MIT", ["MIT License"], "mit"),
    "bsd-3-clause": ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License"], "bsd 3"),
    "bsd-2-clause": ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License"], "bsd 2"),
    "mpl-2.0": ("MPL-2.0", ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"], "mozilla mpl 2.0"),
    "unlicense": ("Unlicense", [], "unlicense"),
    "cc0-1.0": ("CC0-1.0", ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal license"], "cc0 1.0"),
}
_GNU = {"gpl": "", "lgpl": "Lesser ", "agpl": "Affero "}
for _kind, _versions in (("gpl", "23"), ("lgpl", "3"), ("agpl", "3")):
    for _v in _versions:
        _name = f"GNU {_GNU[_kind]}General Public License"
        NAMES[f"{_kind}-{_v}.0"] = (
            f"{_kind.upper()}-{_v}.0",
            [f"{_name}, version {_v}", f"{_name} v{_v}", f"{_name} v{_v}.0", f"{_name} {_v}.0", f"{_kind.upper()}v{_v}", f"{_kind.upper()} v{_v}"],
            f"{_GNU[_kind].lower()}{_kind} {_v} v{_v} {_v}.0 v{_v}.0 {_kind}v{_v}",
        )
_PARTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
CREATIVE = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
for _kind in CREATIVE:
    _long = "-".join(_PARTS[x] for x in _kind.split("-"))
    NAMES[f"cc-{_kind}-4.0"] = (
        f"CC-{_kind.upper()}-4.0",
        [f"Creative Commons {_long} 4.0 International License", f"Creative Commons {_long} 4.0 License", f"CC {_kind.upper()} 4.0 license"],
        f"{_kind.replace('-', ' ')} {_long.replace('-', ' ')} 4.0".lower(),
    )

_AS_IS = (
    'PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
    "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
    "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "bsd-2-clause": [f"{_BSD}THIS SOFTWARE IS {_AS_IS}"],
    "bsd-3-clause": [
        f"{_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. THIS SOFTWARE IS {_AS_IS}"
    ],
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
        "all present and future rights to this software under copyright law.",
        "licensed under the Unlicense",
        "released under the Unlicense",
    ],
    "cc0-1.0": ["CC0 1.0 Universal Statement of Purpose", "creativecommons.org/publicdomain/zero/1.0"],
}
for _kind, _v, _date in (("gpl", "2", "June 1991"), ("gpl", "3", "29 June 2007"), ("lgpl", "3", "29 June 2007"), ("agpl", "3", "19 November 2007")):
    _name = f"GNU {_GNU[_kind]}General Public License"
    _terms = (
        f"is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software "
        f"Foundation, either version {_v} of the License, or (at your option) any later version."
    )
    TEXTS[f"{_kind}-{_v}.0"] = [
        f"This program {_terms} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_name} for more details. You should have received "
        f"a copy of the {_name} along with this program. If not, see https://www.gnu.org/licenses/.",
        _terms,
        f"{_name} Version {_v}, {_date}",
    ]
for _kind in CREATIVE:
    _long = "-".join(_PARTS[x] for x in _kind.split("-"))
    TEXTS[f"cc-{_kind}-4.0"] = [
        f"Creative Commons {_long} 4.0 International Public License",
        f"creativecommons.org/licenses/{_kind}/4.0",
        f"Licensed under CC {_kind.upper()} 4.0.",
    ]


def forms() -> list[tuple[str, str, str]]:
    """Licence, wording and the words of a name or version, in lower case, that must not differ, of each form."""
    out = []
    for licence, (spdx, names, needed) in NAMES.items():
        texts = [f"SPDX-License-Identifier: {spdx}"]
        texts += [f"{verb} under {article} {name}" for name in names for verb in ("licensed", "released") for article in ("the", "a")]
        # A name that holds a version says by itself which licence is meant.
        texts += [name for name in names if "License" in name and any(x.isdigit() for x in name)]
        out += ((licence, text, needed) for text in texts + TEXTS.get(licence, []))
    return out
