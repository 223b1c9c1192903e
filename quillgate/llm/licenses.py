"""License scans: Dice coefficient over word bigrams between text units and licence templates.

Units are the single lines of a text, its paragraphs (runs of lines between blank ones) of more than one line, and the whole text if it has several paragraphs. A
unit that names versions, none of them a template's own, is no match of that template, however like it is. A unit and
a template are normalised alike: lower case, every run outside [a-z0-9] one blank. With |A| and |B| distinct bigrams,
Dice >= t needs |A| t / (2 - t) <= |B| <= |A| (2 - t) / t, which prunes most templates before any comparison. It also needs |A| t / (2 - t)
or more of a template's bigrams in the unit, so of any |A| less that number, plus one, of its bigrams a unit holds one: texts, then units,
that hold none of those bigrams (`keys`) of any template are refused, and texts without one of a few words that stand in them all (`marks`)
even before they are normalised. Neither refuses a unit that reaches t.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column



def _gnu(name: str, version: str) -> list[str]:
    """The headers that the GNU licences ask for, as programs, libraries and files carry them."""
    terms = f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    ends = (f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License.")
    return [f"{what} is free software{sep} {terms}{sep2} {end}" for what in ("This program", "This library") for sep, sep2 in ((":", ","), (";", ";")) for end in ends]


# Identifiers that stand in SPDX lines.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "Unlicense", "BSL-1.0", "EUPL-1.2", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
_FREE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
# Licences as whole texts.
WHOLE = {
    "MIT": _FREE + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
# Notices by which texts state their licence.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License. See LICENSE in the project root for license information."],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0.", *_gnu("General Public License", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License v2.0.", *_gnu("General Public License", "2")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License v2.1.", *_gnu("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License v3.0.", *_gnu("Lesser General Public License", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License v3.0.", *_gnu("Affero General Public License", "3")],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL, Version 1.2 or later."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


for _name in SPDX:
    TEMPLATES.setdefault(re.sub("-(only|or-later)$", "", _name), []).append(f"SPDX-License-Identifier: {_name}")
for _name, _text in WHOLE.items():
    TEMPLATES.setdefault(_name, []).append(_text)

# Numbers that name a version in normalised words; one without a second part has 0 there.
VERSION = r"\b(?:version|v|gpl|apache|mpl|bsl|eupl|attribution|sharealike|noncommercial|by|sa|nc) ?([0-9]{1,2}(?: [0-9]\b)?)\b"


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def versions(words: list[str]) -> list[str]:
    return sorted({v if " " in v else f"{v} 0" for v in re.findall(VERSION, " ".join(words))})


def template_rows(templates: dict[str, list[str]] | None = None) -> list[tuple[str, int, list[str]]]:
    """(licence, variant, bigrams) of every template that has a bigram."""
    return [(name, i, b) for name, texts in sorted((templates or TEMPLATES).items()) for i, t in enumerate(texts) if (b := bigrams(normal_words(t)))]


# Words too frequent in running text to tell licences from it.
COMMON = set("a an and any are as at be by can for from has in is it its may not of on or other that the this to under was which with without you".split())


def _weight(word: str) -> int:
    return 0 if word in COMMON or word.isdigit() else len(word)


def _least(template: list[str], least: float) -> int:
    """How many of a template's bigrams stand in every unit that reaches `least`."""
    return max(1, math.ceil(len(template) * least / (2 - least) - 1e-9))


def keys(template: list[str], least: float) -> list[str]:
    """Bigrams of a template, those with the most telling words, of which every unit that reaches `least` holds one."""
    return sorted(template, key=lambda b: (-max(map(_weight, b.split())), b))[: len(template) - _least(template, least) + 1]


def marks(templates: list[list[str]], least: float) -> list[str]:
    """Words of which every text that holds a unit reaching `least` holds one: enough for each template that fewer bigrams than such a
    unit shares with it are without any of them; chosen greedily, words of many bigrams and long ones first."""
    chosen: list[str] = []
    open_ = [list(t) for t in templates]
    while any(len(t) >= _least(a, least) for t, a in zip(open_, templates)):
        gain: dict[str, int] = {}
        for t, a in zip(open_, templates):
            if len(t) >= _least(a, least):
                for word in {w for b in t for w in b.split()}:
                    gain[word] = gain.get(word, 0) + 1 + 100 * _weight(word) ** 2
        chosen.append(max(sorted(gain), key=gain.get))
        open_ = [[b for b in t if chosen[-1] not in b.split()] for t in open_]
    return [w for w in chosen if not any(o != w and o in w for o in chosen)]


def _let(value, body):
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(lines):
    """Units (unit, a, b, t) of an array of lines: each line that isn't blank, and each paragraph of several lines."""
    single = F.filter(F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("a"), (i + 1).alias("b"), F.trim(x).alias("t"))), lambda u: u["t"] != "")

    def paragraphs(blank):
        index = F.sequence(F.lit(0), F.size(blank) - 1)
        starts = F.filter(index, lambda i: ~F.get(blank, i) & F.coalesce(F.get(blank, i - 1), F.lit(True)))
        ends = F.filter(index, lambda i: ~F.get(blank, i) & F.coalesce(F.get(blank, i + 1), F.lit(True)))
        spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b"))), lambda s: s["b"] > s["a"] + 1)
        return F.transform(spans, lambda s: F.struct(F.lit("paragraph").alias("unit"), s["a"].alias("a"), s["b"].alias("b"), F.array_join(F.transform(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), lambda x: F.trim(x)), " ").alias("t")))

    def whole(groups):
        filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
        return F.concat(groups, F.when(parted, F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("a"), F.size(lines).alias("b"), F.array_join(filled, " ").alias("t")))).otherwise(F.slice(groups, 1, 0)))

    parted = F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit(" ")).otherwise(F.lit("x"))), "").rlike("x +x")
    return F.concat(single, _let(_let(F.transform(lines, lambda x: F.trim(x) == ""), paragraphs), whole))


def _pairs(words):
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, unit, first_line, end_line, license, dice) of docs(doc_id, text, ...): the best template of each unit (line,
    paragraph or document) that reaches `least` and whose versions, if it and the unit name any, the unit names one of; among equals the first licence by name.

    Null and empty texts and units of fewer than two words give nothing. A null doc_id stays null; repeated rows repeat their
    results; an empty table gives an empty result; other columns are ignored. The templates are a fixed, small list.
    """
    known = template_rows(templates)
    slip = 1e-9  # sizes are whole numbers; bounds met exactly must not fail by rounding
    low, high = min(len(b) for *_, b in known) * least / (2 - least) - slip, max(len(b) for *_, b in known) * (2 - least) / least + slip
    told = {(n, i): versions(normal_words(t)) for n, texts in (templates or TEMPLATES).items() for i, t in enumerate(texts)}
    strings = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    fixed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("size"), strings(b).alias("bigrams"), strings(told[n, i]).alias("versions")) for n, i, b in known])
    held = f"(?<![a-z0-9])(?:{'|'.join(sorted({k for *_, b in known for k in keys(b, least)}))})(?![a-z0-9])"
    lower = F.lower(column(docs, "text", "string"))
    marked = reduce(lambda x, y: x | y, [F.contains("lower", F.lit(w)) for w in marks([b for *_, b in known], least)])
    base = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), lower.alias("lower")).where(marked)
    base = base.select("doc_id", F.regexp_replace("lower", "[^a-z0-9\\n]+", " ").alias("text"))
    base = base.where(F.regexp_replace("text", "[ \n]+", " ").rlike(held)).select("doc_id", F.split("text", "\n").alias("lines"))
    units = base.select("doc_id", F.explode(_let(F.col("lines"), _units)).alias("u")).select("doc_id", "u.*")
    blanks = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))  # words less one, so at least as many as bigrams
    units = units.where((blanks >= F.lit(low)) & F.col("t").rlike(held)).select("doc_id", "unit", "a", "b", F.explode(F.array(_let(F.split("t", " +"), _pairs))).alias("bigrams"), F.regexp_extract_all("t", F.lit(VERSION), 1).alias("versions"))
    units = units.withColumn("versions", F.transform("versions", lambda v: F.when(F.contains(v, F.lit(" ")), v).otherwise(F.concat(v, F.lit(" 0")))))
    units = units.where(F.size("bigrams").between(F.lit(low), F.lit(high)))
    agree = lambda t: (F.size("versions") == 0) | (F.size(t["versions"]) == 0) | F.arrays_overlap("versions", t["versions"])
    near = F.filter(fixed, lambda t: agree(t) & (t["size"] * least <= F.size("bigrams") * (2 - least) + slip) & (F.size("bigrams") * least <= t["size"] * (2 - least) + slip))
    scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect("bigrams", t["bigrams"])) / (F.size("bigrams") + t["size"])).alias("d"), t["license"].alias("license")))
    units = units.select("doc_id", "unit", "a", "b", F.explode(F.array(F.array_min(F.filter(scored, lambda s: s["d"] <= -least)))).alias("best"))
    return units.where("best is not null").select(
        "doc_id", "unit", F.col("a").cast("bigint").alias("first_line"), F.col("b").cast("bigint").alias("end_line"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice")
    )
