"""Licence scanning by canonical digest, in DataFrame operations.

A text is brought to canonical form (A-Z lower-cased, copyright lines gone, spellings that licence
matching holds equivalent made one, runs of anything but letters and digits made one space), and the
digest of the whole form is hash-joined to the digests of known licences: short ones below with their
usual titles, long ones from ``license_texts``. The list is finite: other licences have a digest and no name.

Cases: null text has no digest and no licence; text that is empty in canonical form has a digest and no
licence; texts of any length are read whole; repeated rows repeat their result; an empty table gives an
empty result; other input columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licences, as published, without their copyright lines.
KNOWN = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE"""
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE", _BSD_3, 1)
# Titles under which a text is published, besides the one above. The empty one is no title.
TITLES = {
    "MIT": ["", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
_OWN_TITLE = {"MIT": "MIT License", "ISC": "ISC License"}
_LAST_LINE = "END OF TERMS AND CONDITIONS"


def _variants() -> dict[str, str]:
    """Further forms, named licence|form: other titles, and the long texts of the data folder, whole, and up
    to the last line of their terms with and without that line."""
    out = {}
    for name, titles in TITLES.items():
        body = KNOWN[name].removeprefix(_OWN_TITLE.get(name, "")).strip()
        out |= {f"{name}|{title}": f"{title}\n\n{body}" for title in titles}
    for file in sorted(resources.files("pagelumen.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        out[f"{name}|text"] = text
        terms, last, rest = text.partition(_LAST_LINE)
        if last:
            out |= {f"{name}|terms": terms, f"{name}|terms and last line": terms + last}
    return out


KNOWN |= _variants()
# Spellings held equivalent, after punctuation has gone. Each is replaced where it stands as a whole word.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("organisation", "organization"), ("recognise", "recognize"), ("authorisation", "authorization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"), ("per cent", "percent"), ("analogue", "analog"), ("fulfil", "fulfill"), ("programme", "program"),
]
#: A line that states a copyright, or reserves rights, rather than speaking of "the copyright notice".
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9][0-9][0-9][0-9]|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
SEPARATORS = r"[^\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form, as a column."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, SEPARATORS, " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_text(text: str) -> str:
    """The same, of a string: for the known texts."""
    out = text.translate(str.maketrans(_UPPER, _LOWER))
    out = re.sub(COPYRIGHT_LINE, " ", out)
    out = " " + re.sub(r"[\W_]+", " ", out) + " "
    for a, b in SPELLINGS:
        out = out.replace(f" {a} ", f" {b} ")
    return out.strip(" ")


def known_digests(texts: dict[str, str] = KNOWN) -> list[tuple[str, str]]:
    """(licence, digest) of each text; of a name with a bar, what is before it is the licence."""
    return [(name.split("|")[0], hashlib.sha256(canonical_text(t).encode()).hexdigest()) for name, t in sorted(texts.items())]


def scan(df: DataFrame, texts: dict[str, str] = KNOWN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, digest, license_id``, one row per input row; license_id is null for an unknown text.

    The known licences are a local table of a size fixed by ``texts``; Spark chooses the join by it.
    """
    known = df.sparkSession.createDataFrame(known_digests(texts), "license_id string, digest string")
    digests = df.select(F.col(f"`{key}`").alias(key), F.sha2(F.encode(canonical(F.col(text).cast("string")), "utf-8"), 256).alias("digest"))
    return digests.join(known, "digest", "left").select(key, "digest", "license_id")


def scan_sql(texts: dict[str, str] = KNOWN) -> str:
    """The same as DuckDB SQL over ``documents``."""
    form = f"regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{COPYRIGHT_LINE}', ' ', 'g')"
    form = f"' ' || regexp_replace({form}, '{SEPARATORS}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    rows = ", ".join(f"('{name}', '{digest}')" for name, digest in known_digests(texts))
    return f"""WITH known(license_id, digest) AS (VALUES {rows}),
d AS (SELECT doc_id, sha256(trim({form}, ' ')) AS digest FROM documents)
SELECT d.doc_id, d.digest, known.license_id FROM d LEFT JOIN known USING (digest)"""
