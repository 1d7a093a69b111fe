"""Licence scan by canonical digests (operator 5), in DataFrame functions.

A text, and each of its lines, is brought to a canonical form: lower case, copyright lines out, equivalent spellings
unified, punctuation and white space to single spaces. The digests of whole forms are hash-joined to those of known
licence texts and notices, a table of fixed size.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import cut

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

#: Known licence texts and one-line notices. More may be passed to scan().
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Fixed values, in order: (pattern over the lower-cased text, what stands for it). The patterns mean the same in Java, RE2 and Python.
FORMS: tuple[tuple[str, str], ...] = (
    ("(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$", ""),
    ("(?m)^[^a-z0-9\\n]*all rights reserved[^\\n]*$", ""),
    ("https?://(www\\.)?", ""),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("&", " and "),
    ("copyright owner", "copyright holder"),
    ("[^a-z0-9]+", " "),
    (" version | v ", " "),
)


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in FORMS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def canonical_text(text: str) -> str:
    """The same form of a known text."""
    out = text.lower()
    for pattern, to in FORMS:
        out = re.sub(pattern, to, out)
    return out.strip(" ")


def digests(spark: SparkSession, known) -> DataFrame:
    rows = sorted({(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name) for name, text in known})
    return spark.createDataFrame(rows, "digest string, license string")


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """license (the file's name without its ending) and text of a folder of licence files, for scan()."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[A-Za-z]+$", "")
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, more: DataFrame | None = None) -> DataFrame:
    """doc_id, whole_license, n_notices, licenses: a row for each row of ``docs`` (doc_id, text; other columns play no part).

    whole_license: the licence whose text the whole document is, else null. n_notices: lines that are a known text.
    licenses: names of both, distinct, sorted, comma-joined; empty for none. A null, empty or blank text has none;
    rows that repeat have the same result each; an empty table gives no rows. ``known`` is broadcast: it is code, not data.
    more: further known texts (license, text), a table of any size, of which Spark sees how to join it; null texts know nothing.
    """
    table = F.broadcast(digests(docs.sparkSession, known))
    if more is not None:
        own = more.filter(F.length("text") > 0).select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").join(table, "digest", "left_anti")
        table = cut(digests(docs.sparkSession, known).unionByName(own.groupBy("digest").agg(F.min("license").alias("license"))))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Every text and line is digested: a canonical form has no bound on what it leaves out.
    lines = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.length("line") > 0)
    found = lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(table, "digest").select("doc_id", "text_hash", "at", "license").distinct()
    notices = found.groupBy("doc_id", "text_hash").agg(F.count_distinct("at").alias("n"), F.collect_set("license").alias("names"))
    whole = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.length("text") > 0, F.sha2(canonical(F.col("text")), 256)).alias("digest")).join(table, "digest", "left").select("doc_id", "text_hash", F.col("license").alias("whole_license"))
    notices = cut(notices).withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    joined = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    own = F.when(F.col("whole_license").isNotNull(), F.array("whole_license")).otherwise(F.expr("cast(array() as array<string>)"))
    names = F.array_join(F.sort_array(F.array_union(own, F.coalesce("names", F.expr("cast(array() as array<string>)")))), ",")
    return joined.select("doc_id", "whole_license", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), names.alias("licenses"))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """DuckDB SQL of scan() over the table documents."""
    form = "lower({})"
    for pattern, to in FORMS:
        form = f"regexp_replace({form}, '{pattern}', '{to}', 'g')".replace("{}", "{0}")
    form = f"trim({form})"
    values = ", ".join(f"('{form_}', '{name}')" for form_, name in sorted({(canonical_text(t), n) for n, t in known}))
    return f"""
WITH known(form, license) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT doc_id, pos, license FROM lines JOIN known ON {form.replace("{0}", "line")} = form WHERE length(line) > 0),
notices AS (SELECT doc_id, count(DISTINCT pos) AS n FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, license FROM docs LEFT JOIN known ON {form.replace("{0}", "text")} = form AND length(text) > 0),
names AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT doc_id, license FROM found UNION SELECT doc_id, license FROM whole WHERE license IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, w.license AS whole_license, coalesce(n.n, 0) AS n_notices, coalesce(m.licenses, '') AS licenses
FROM whole w LEFT JOIN notices n USING (doc_id) LEFT JOIN names m USING (doc_id)"""
