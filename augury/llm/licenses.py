"""Licence texts by sparse TF-IDF cosine, and inheritance from the nearest directory above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, saved

# Standard licence texts and headers (fixed values).
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
APACHE_OPENING = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control
with that entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management
of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii)
beneficial ownership of such entity."""
GNU_COPY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
GPL_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
GPL_COPY = "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
GPL2_OPENING = """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street,
Fifth Floor, Boston, MA 02110-1301 USA """ + GNU_COPY + """ Preamble The licenses for most software are designed to take away your freedom to
share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make
sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any
other program whose authors commit to using it."""
GPL3_OPENING = """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
""" + GNU_COPY + """ Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for
most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its
users."""
LGPL21_OPENING = """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51
Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA """ + GNU_COPY + """ [This is the first released version of the Lesser GPL. It also counts
as the successor of the GNU Library Public License, version 2, hence the version number 2.1.] Preamble The licenses for most software are designed
to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and
change free software--to make sure the software is free for all its users."""
LGPL3_OPENING = """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
""" + GNU_COPY + """ This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General
Public License, supplemented by the additional permissions listed below. 0. Additional Definitions. As used herein, "this License" refers to
version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
MPL_OPENING = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any)
used by a Contributor and that particular Contributor's Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor."""
CC_STATEMENT = "This work is licensed under a Creative Commons {name} 4.0 International License."
CC_TITLE = "Creative Commons {name} 4.0 International Public License"


def _gnu(name: str, version: str) -> tuple[str, ...]:
    paragraphs = [p.format(name=name, version=version) for p in (GPL_HEADER, GPL_REST, GPL_COPY)]
    return paragraphs[0], "\n\n".join(paragraphs), f"This work is licensed under the GNU {name}, version {version}."


def _creative_commons(code: str, name: str) -> tuple[str, ...]:
    return CC_STATEMENT.format(name=name), CC_TITLE.format(name=name), f"Licensed under CC {code} 4.0."


#: Licence: its statements, headers, and whole text or (long licences) opening.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", APACHE_HEADER, APACHE_HEADER + "\n\n" + APACHE_REST, APACHE_OPENING),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", BSD_TERMS + "\n\n" + BSD_REST),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", BSD_TERMS + "\n" + BSD_NAME + "\n\n" + BSD_REST),
    "CC-BY-4.0": _creative_commons("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "GPL-2.0": (*_gnu("General Public License", "2"), GPL2_OPENING),
    "GPL-3.0": (*_gnu("General Public License", "3"), GPL3_OPENING),
    "ISC": (ISC_GRANT, ISC_GRANT + "\n\n" + ISC_REST),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "2.1"), LGPL21_OPENING),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "3"), LGPL3_OPENING),
    "MIT": ("Released under the MIT License.", MIT_GRANT, MIT_GRANT + "\n\n" + MIT_REST),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, version 2.0.", MPL_HEADER, MPL_OPENING),
}
CUE = "(?i)licen[sc]|copyright|permission is hereby|redistribut|free software"
LICENCE_FILE = "(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
WORD = "[a-z0-9]+"
#: Comment marks and blanks around a line, and the start of a line that is no comment; every line on its own.
MARKS = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|<!--)?[ \t]*|[ \t\r]+$"
CODE = r"(?m)^[ \t\r]*[^ \t\r\n/#*;<\-]"
#: Words of a licence file's opening, and salts of a folder in the last join.
OPENING, SALTS = 100, 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def opening(text: Column) -> Column:
    return F.array_join(F.slice(words(text), 1, OPENING), " ")


def _unix(pattern: str) -> str:
    """Only line feeds end lines, as in other engines."""
    return pattern.replace("(?m)", "(?md)")


def blocks_of(text: Column, licence_file: Column) -> Column:
    """Array of (block, top, least_of): the parts of a text that are compared with templates."""
    plain = F.regexp_replace(text, _unix(MARKS), "")
    part = lambda kind, top: lambda b, i: F.struct(
        b.alias("block"), (i == 0 if top is None else F.lit(top)).alias("top"), F.lit(kind).alias("kind"))
    header = F.regexp_replace(F.get(F.split(text, _unix(CODE), 2), 0), _unix(MARKS), "")
    none = F.array().cast("array<string>")
    return F.concat(
        F.transform(F.split(text, "\n"), part("line", None)),
        F.transform(F.split(plain, "\n{2,}"), part("block", None)),
        F.transform(F.array(header), part("block", True)),
        F.transform(F.array(plain), part("block", False)),
        F.transform(F.when(licence_file, F.array(opening(text))).otherwise(none), part("block", False)))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.6, least_block: float = 0.75,
                  path_col: str = "path", text_col: str = "text", cue: str = CUE, licence_file: str = LICENCE_FILE) -> DataFrame:
    """path, license, score, origin (own, inherited or null), declared_by, one row per input row.

    Compared are, wherever they hold a licence cue: every line, every paragraph (comment marks taken off), the leading run of
    comment lines, the whole text, and of a licence file (by name) also its first OPENING words. These blocks and the templates
    are compared as TF-IDF vectors over the words of all blocks; only words of a template are joined. A file's own licence is
    its best block: a line needs a cosine of ``least``, larger blocks ``least_block``. A licence file, or a file that begins with
    such a line, paragraph or header, declares its licence for its directory; a file without its own inherits from the nearest
    directory above that has one.

    Equal blocks are counted once and travel as a digest of 128 bits. Ties go to the smaller licence name, then path. Null text has no
    block; a null path has no directory. Rows that repeat a path share the best licence found in any of them and each is
    returned. Very long texts are compared whole. An empty table gives no row; other columns are ignored. A directory that
    holds most files is dealt to SALTS parts before files meet its licence.
    """
    spark = files.sparkSession
    rows = files.select(col(path_col).alias("path"), col(text_col).alias("text"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    blocks = rows.where(F.col("text").rlike(cue)).select(
        "path", F.inline(blocks_of(F.col("text"), F.coalesce(name.rlike(licence_file), F.lit(False)))))
    stated = saved(blocks.where(F.col("block").rlike(cue)).withColumn("digest", F.unhex(F.substring(F.sha2("block", 256), 1, 32))), "blocks")
    counted = stated.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("block"))
    terms = counted.select("digest", "n", F.explode(words(F.col("block"))).alias("term")).groupBy("digest", "n", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    frequency = terms.groupBy("term").agg(F.sum("n").alias("df"))
    listed = [(licence, f"{licence} {i}", t) for licence, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    model = spark.createDataFrame(listed, "license string, template string, body string")
    model = model.select("license", "template", F.explode(words(F.col("body"))).alias("term")).groupBy("license", "template", "term").agg(
        F.count(F.lit(1)).alias("tf"))

    def weighted(counts: DataFrame) -> DataFrame:
        known = counts.join(frequency, "term", "left").crossJoin(F.broadcast(total))  # one row
        idf = F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
        return known.withColumn("w", F.col("tf") * idf)

    own, base = saved(weighted(terms).select("digest", "term", "w"), "block-terms"), weighted(model)
    size = own.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    base_size = base.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("base_size"))
    dot = own.join(base.select("license", "template", "term", F.col("w").alias("v")), "term").groupBy(
        "digest", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("size") * F.col("base_size")), 6)
    best = dot.join(size, "digest").join(base_size, "template").withColumn("score", score).where(
        F.col("score") >= min(least, least_block)).groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    enough = F.when(F.col("kind") == "line", least).otherwise(least_block)
    named = stated.select("path", "top", "kind", "digest").join(best, "digest").where(-F.col("b.less") >= enough)
    licensed = saved(named.where("path is not null").groupBy("path").agg(
        F.min("b").alias("b"), F.min(F.when(F.col("top"), F.col("b"))).alias("top")), "licensed")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    declared = licensed.withColumn("d", F.when(name.rlike(licence_file), F.col("b")).otherwise(F.col("top"))).where("d is not null")
    by_folder = declared.groupBy(folder.alias("up")).agg(F.min(F.struct("d.less", "d.license", "path")).alias("f"))
    # distinct folders, each with the folders above it: the nearest one that declares wins
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt")
    salted = rows.where("path is not null").select(folder.alias("folder"), salt).distinct()
    parts = F.split("folder", "/")
    above = salted.select("folder").distinct().select("folder", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "up"))
    nearest = above.join(by_folder, "up").groupBy("folder").agg(F.max_by("f", "depth").alias("f"))
    dealt = salted.join(nearest, "folder")
    out = rows.select("path", folder.alias("folder"), salt).join(licensed.select("path", "b"), "path", "left").join(dealt, ["folder", "salt"], "left")
    mine = F.col("b").isNotNull()
    return out.select(
        "path", F.coalesce("b.license", "f.license").alias("license"), F.coalesce(-F.col("b.less"), -F.col("f.less")).alias("score"),
        F.when(mine, "own").when(F.col("f").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("f.path")).alias("declared_by"))
