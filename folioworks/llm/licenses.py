"""Operator 4: license scans.

Files are (path, text). Headers are single lines, and runs of lines that follow each other
and may belong to a notice; the file as a whole may be a licence file. Headers are compared
with the notices, whole files with the licences' texts, by the cosine of sparse TF-IDF vectors;
document frequencies are counted over all files. A header must have a term without which
the cosine cannot reach the threshold (what the other terms could add is bounded by their
share of the template's norm), so most lines are never scored, and none is lost.

A file's own license is that of its whole text, if this is a licence's, else of its best header. A
whole text must hold the title of a long licence (of those only excerpts are compared), and
beat the next license by a margin. Licence files (by their whole texts, or by a name such as
LICENSE or COPYING and a notice) license their directory; in a file of such a name a notice counts
only if it fills a fifth of it or its licence's title is there too, so that a notice in the
text of an unknown licence is not taken for that. Files without a license of their own
take that of the nearest ancestor directory, by joins on directory paths: first for distinct
directories, then for files.

Edge cases: null and empty texts have no license of their own and may inherit; a null path
neither gives nor inherits; ties go to the template that sorts first, of headers to the first;
of several licence files in a directory the best counts; repeated rows repeat their result; an
empty table gives an empty table; very long texts are read as a whole; other columns stay,
those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, unused, utf8
from .decontaminate import hashes_of, token_hashes

#: Public notices by SPDX identifier, as headers have them; a license may have several.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("BSD-2-Clause", "Use of this source code is governed by the 2-clause BSD license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2."),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Texts of short licences, and what is typical of the long ones, as licence files have them.
TEXTS = [
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", "BSD Zero Clause License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. " + _AS_IS + ", TITLE AND NON-INFRINGEMENT."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " AND NONINFRINGEMENT."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION. 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION. 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. \"Work\" shall mean the work of authorship, whether in Source or Object form, made available under the License. \"Derivative Works\" shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work. \"Contribution\" shall mean any work of authorship that is intentionally submitted to Licensor for inclusion in the Work. \"Contributor\" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor. 2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. 4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications. 5. Submission of Contributions. 6. Trademarks. 7. Disclaimer of Warranty. 8. Limitation of Liability. 9. Accepting Warranty or Additional Liability."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users. To \"convey\" a work means any kind of propagation that enables other parties to make or receive copies. A \"covered work\" means either the unmodified Program or a work based on the Program. The \"Corresponding Source\" for a work in object code form means all the source code needed to generate, install, and run the object code and to modify the work. You may convey verbatim copies of the Program's source code as you receive it. You may convey a work based on the Program, or the modifications to produce it from the Program. User Product Installation Information. Additional permissions are terms that supplement the terms of this License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software, to make sure the software is free for all its users. This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License. The \"Program\" refers to any such program or work, and a \"work based on the Program\" means either the Program or any derivative work under copyright law. You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium. You may modify your copy or copies of the Program or any portion of it, thus forming a work based on the Program. You may copy and distribute the Program in object code or executable form provided that you also accompany it with the complete corresponding machine-readable source code."),
    ("MPL-2.0", "Mozilla Public License Version 2.0. 1. Definitions. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. \"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form. \"Larger Work\" means a work that combines Covered Software with other material. \"Secondary License\" means either the GNU General Public License, the GNU Lesser General Public License, the GNU Affero General Public License, or any later versions of those licenses. Incompatible With Secondary Licenses."),
    ("CC0-1.0", "CC0 1.0 Universal. Statement of Purpose. The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship and/or a database (each, a \"Work\"). Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever. Affirmer Waiver. Public License Fallback. Limitations and Disclaimers."),
]
#: Titles with which long licences begin; their texts above are excerpts, so a match must hold the title.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "CC0-1.0": "CC0 1.0 Universal",
}
#: By how much a whole file's best licence must beat the next one's; the share of a licence file that its notice fills.
MARGIN, NOTICE_SHARE = 0.01, 0.2
NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"


class Templates:
    """TF-IDF vectors of length one of notices and texts."""

    def __init__(self, notices: list[tuple[str, str]], texts: list[tuple[str, str]], df: dict[int, int], n: int, threshold: float):
        every = [*notices, *texts]
        self.names, self.notices = [k for k, _ in every], len(notices)
        tokens = [hashes_of(t) for _, t in every]
        self.titles = {k: hashes_of(t) for k, t in TITLES.items()}
        self.terms = np.unique(np.concatenate(tokens))
        idf = lambda d: np.log((n + 1) / (d + 1)) + 1
        self.idf = np.array([idf(df.get(int(t.view(np.int64)), 0)) for t in self.terms])
        self.unknown = float(idf(0))  # a term of no template counts as a rare one
        self.matrix = np.zeros((len(self.terms), len(every)))
        #: Terms without which nothing reaches the threshold, for notices and for texts.
        self.essential = np.zeros((2, len(self.terms)), bool)
        for j, h in enumerate(tokens):
            for t, tf in Counter(np.searchsorted(self.terms, h).tolist()).items():
                self.matrix[t, j] = tf * self.idf[t]
            column = self.matrix[:, j] / np.linalg.norm(self.matrix[:, j])
            self.matrix[:, j] = column
            order = np.argsort(column)
            self.essential[int(j >= self.notices), order[np.sqrt(np.cumsum(column[order] ** 2)) >= threshold - 1e-9]] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def cosine(self, h: np.ndarray, whole: bool = False) -> tuple[float, int]:
        """(best cosine, its template) of a header's tokens, or a whole file's."""
        terms, tf = np.unique(h, return_counts=True)
        at = self.lookup(terms)
        weight = tf * np.where(at >= 0, self.idf[at], self.unknown)
        got = (weight[at >= 0] @ self.matrix[at[at >= 0]]) / np.linalg.norm(weight)
        order = sorted(range(self.notices, len(got)) if whole else range(self.notices), key=lambda j: (-round(float(got[j]), 12), self.names[j], j))
        if whole:
            order = [j for j in order if self.titled(h, self.names[j], True)]
            if any(self.names[j] != self.names[order[0]] and got[j] > got[order[0]] - MARGIN for j in order[1:]):
                return 0.0, -1
        return (float(got[order[0]]), order[0]) if order else (0.0, -1)

    def titled(self, h: np.ndarray, name: str, default: bool) -> bool:
        """Whether a file's tokens hold the title of a license; the default for those without."""
        title = self.titles.get(name)
        if title is None:
            return default
        at = np.flatnonzero(h[: max(0, len(h) - len(title) + 1)] == title[0])
        return any(np.array_equal(h[a : a + len(title)], title) for a in at)


def document_frequencies(files: DataFrame, terms: np.ndarray, text: str) -> tuple[dict[int, int], int]:
    """In how many files each of the terms is, and the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                h, first = token_hashes(*utf8(b.column(0)))
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = terms[at] == h
                of = np.repeat(np.arange(b.num_rows), np.diff(first))[hit]
                count += np.bincount(np.unique(of * len(terms) + at[hit]) % len(terms), minlength=len(terms))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms.view(np.int64), 0)), pa.array(np.append(count, n)), pa.array([False] * len(terms) + [True])], ["term", "n", "total"])

    rows = files.select(F.col(text).cast("string")).mapInArrow(run, "term long, n long, total boolean").groupBy("total", "term").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows if not r.total}, next((r.n for r in rows if r.total), 0)


def headers(x: Templates, h: np.ndarray, first: np.ndarray, lines: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(first line, after the last, cosine, notice) of each of the lines, and of those that follow each other as one."""
    runs = np.split(lines, np.flatnonzero(np.diff(lines) > 1) + 1)
    for a, b in [(ln, ln + 1) for ln in lines] + [(r[0], r[-1] + 1) for r in runs if len(r) > 1]:
        yield int(a), int(b), *x.cosine(h[first[a] : first[b]])


def scan(files: DataFrame, threshold: float = 0.6, path: str = "path", text: str = "text", notices: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """files without text, with own, own_score, header (its line, 1-based), own_speaks, file_license and file_score.

    own_speaks: the header fills NOTICE_SHARE of the file, or its licence's title is there too.
    """
    notices, texts = NOTICES if notices is None else notices, TEXTS if texts is None else texts
    terms = np.unique(np.concatenate([hashes_of(t) for _, t in [*notices, *texts]]))
    shared = files.sparkSession.sparkContext.broadcast(Templates(notices, texts, *document_frequencies(files, terms, text), threshold))
    added = ("own", "own_score", "header", "own_speaks", "file_license", "file_score")  # these replace columns of their names
    names = [n for n in files.columns if n not in (text, *added)]
    rows = files.select(*(F.col(f"`{n}`") for n in names), F.col(text).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Templates = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                data, off = utf8(b.column(len(names)))
                # every line is a text of its own; lines and files share their tokens
                cuts = np.union1d(np.flatnonzero(data == 10) + 1, off)
                h, first = token_hashes(data, cuts)
                at = x.lookup(h)
                line = np.repeat(np.arange(len(cuts) - 1), np.diff(first))
                base = np.searchsorted(cuts, off)
                file_of = lambda ln: np.searchsorted(base, ln, side="right") - 1  # noqa: B023, E731
                own: list = [None] * b.num_rows
                whole: list = [None] * b.num_rows
                hit = np.unique(line[(at >= 0) & x.essential[0, at]])
                for f in np.unique(file_of(hit)):
                    tokens = h[first[base[f]] : first[base[f + 1]]]
                    for a, z, score, j in headers(x, h, first, hit[file_of(hit) == f]):
                        if score >= threshold and (own[f] is None or (-round(score, 12), x.names[j]) < (-round(own[f][0], 12), x.names[own[f][1]])):
                            own[f] = (score, j, int(a - base[f]) + 1, int(first[z] - first[a]))
                    if own[f] is not None:
                        score, j, at_line, n = own[f]
                        own[f] = score, j, at_line, n >= NOTICE_SHARE * len(tokens) or x.titled(tokens, x.names[j], False)
                for f in np.unique(file_of(line[(at >= 0) & x.essential[1, at]])):
                    score, j = x.cosine(h[first[base[f]] : first[base[f + 1]]], True)
                    whole[f] = (score, j) if score >= threshold else None
                pick = lambda rows, k: [None if r is None else x.names[r[1]] if k == 1 else r[k] for r in rows]
                cols = [pa.array(pick(own, 1), pa.string()), pa.array(pick(own, 0), pa.float64()), pa.array(pick(own, 2), pa.int64()), pa.array([None if r is None else bool(r[3]) for r in own], pa.bool_()), pa.array(pick(whole, 1), pa.string()), pa.array(pick(whole, 0), pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{schema}, own string, own_score double, header long, own_speaks boolean, file_license string, file_score double")


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """scanned with license and origin: ``file``, ``header``, ``directory`` (inherited) or null."""
    folder = F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull(), F.lit("")))
    scanned = scanned.drop("license", "origin", "dir")  # results replace columns of their names
    # what a licence file is as a whole comes before the notices in it; one of an unknown licence has none by a notice
    named = F.coalesce(F.col(path).rlike(NAMES), F.lit(False))
    by_header = F.when(F.col("file_license").isNull() & (~named | F.col("own_speaks")), F.col("own"))
    mine, header = unused("mine", scanned), unused("by_header", scanned)
    rows = scanned.withColumn("dir", folder).withColumn(header, by_header).withColumn(mine, F.coalesce("file_license", header))
    gives = rows.where(F.col("dir").isNotNull() & F.col(mine).isNotNull() & (F.col("file_license").isNotNull() | named))
    gives = gives.select("dir", F.col(mine).alias("license"), F.when(F.col("file_license").isNotNull(), F.col("file_score")).otherwise(F.col("own_score")).alias("score"))
    best = gives.groupBy("dir").agg(F.min(F.struct(-F.round("score", 12), F.col("license"))).alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.license").alias("given"))
    dirs = rows.where(F.col("dir").isNotNull() & F.col(mine).isNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("ancestor", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("depth"), F.lit(1))), "/")))
    of, given = unused("of", rows), unused("given", rows)
    near = up.join(best, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "given")).alias("m")).select(F.col("dir").alias(of), F.col("m.given").alias(given))
    out = rows.join(bounded(cut(near)), F.col("dir") == F.col(of), "left")
    origin = F.when(F.col("file_license").isNotNull(), "file").when(F.col(header).isNotNull(), "header").when(F.col(given).isNotNull(), "directory")
    return out.select(*(F.col(f"`{c}`") for c in scanned.columns), F.coalesce(mine, given).alias("license"), origin.alias("origin"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: a file's path is source/lang/hundred/doc_id.txt, null without an id."""
    docs = documents(spark, sf_dir)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select("doc_id", path.alias("path"), "text")
    return inherit(cut(scan(files))).select("doc_id", "path", "license", "origin", "own", "header", F.round("own_score", 9).alias("own_score"), "file_license")
