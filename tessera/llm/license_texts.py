"""Texts of well-known licences; short ones here, without their copyright lines.

Fixed values: the wording is that of the licences' publishers. Long texts are whole files
in ``licenses``, by name; a name with words in brackets is another printing of the same.
"""

from importlib.resources import files

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

LICENSES = {
    "MIT": "MIT License\n\n" + _MIT_GRANT + """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _MIT_END,
    "MIT (untitled)": _MIT_GRANT + """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _MIT_END,
    "MIT-0": "MIT No Attribution\n\n" + _MIT_GRANT + ".\n\n" + _MIT_END,
    "ISC": "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": _ISC_GRANT + ".\n\n" + _ISC_END,
    "BSD-2-Clause": _BSD_TERMS + _BSD_END,
    "BSD-3-Clause": _BSD_TERMS + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + _BSD_END,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "Apache-2.0 (notice)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
    "GPL-3.0-or-later (notice)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.
""",
}

_END_OF_TERMS = "END OF TERMS AND CONDITIONS"
for _file in sorted((f for f in (files("tessera.llm") / "licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name):
    _name, _text = _file.name.removesuffix(".txt"), _file.read_text("utf-8")
    LICENSES[_name] = _text
    if _END_OF_TERMS in _text:  # the appendix is often left out, sometimes with this line
        _terms = _text.partition(_END_OF_TERMS)[0]
        LICENSES[f"{_name} (terms)"] = _terms + _END_OF_TERMS
        LICENSES[f"{_name} (terms, no end line)"] = _terms

#: Texts without a title, and titles that they are often printed under.
TITLED = {
    "MIT": (LICENSES["MIT (untitled)"], ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License", "License: MIT")),
    "MIT-0": (_MIT_GRANT + ".\n\n" + _MIT_END, ("MIT-0", "MIT No Attribution License", "MIT-0 License")),
    "ISC": (LICENSES["ISC"].partition("\n\n")[2], ("The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC", "License: ISC")),
    "0BSD": (LICENSES["0BSD"], ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD License", "BSD Zero Clause License (0BSD)")),
    "BSD-2-Clause": (LICENSES["BSD-2-Clause"], ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License")),
    "BSD-3-Clause": (LICENSES["BSD-3-Clause"], ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "BSD License", "New BSD License", "Modified BSD License", "Revised BSD License")),
    "Unlicense": (LICENSES["Unlicense"], ("The Unlicense", "Unlicense", "The Unlicense (Public Domain)")),
    "Zlib": (LICENSES["Zlib"], ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng license")),
}

#: Parts of words that count as equal wherever they stand: the first is read as the second.
STEMS = (
    ("licenc", "licens"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
)

#: Spellings that count as equal, as whole words: the first is read as the second.
SPELLINGS = (
    ("fulfil", "fulfill"), ("programme", "program"), ("artefact", "artifact"), ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"), ("merchantibility", "merchantability"), ("https", "http"), ("copyrights", "copyright"), ("owner", "holder"),
)

#: Words that follow "copyright" in the wording of a licence, not in a copyright line.
AFTER_COPYRIGHT = (
    "and", "act", "claim", "control", "disclaimer", "for", "holder", "holders", "in", "infringement", "interest", "interests", "is", "law", "laws", "licence", "license",
    "notice", "notices", "on", "or", "owner", "owners", "ownership", "patent", "permission", "permissions", "protection", "related", "rights", "statement", "status", "then", "to",
    "trademark", "treaty",
)
