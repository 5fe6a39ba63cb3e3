"""License scans: sparse TF-IDF cosine of word windows to templates, and inheritance from directories.

Templates are short notices, headers and whole licence texts; those of long licences lie beside this module, as
published. A file that speaks of licences or rights, and every licence file, is read in windows as long as each
template, across line breaks: from each word that a short template has too, and at every eighth of a long one. Windows
are told apart by their text, so a notice that a third of all files share is scored once. A file without a licence of its own takes that of the nearest ancestor directory
with a licence file; directories, not files, are joined to their ancestors. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, text_of

# Short notices of well-known licences.
TEMPLATES = {
    "AGPL-3.0": "licensed under the GNU Affero General Public License version 3",
    "Apache-2.0": "licensed under the Apache License Version 2.0",
    "BSD-2-Clause": "redistribution and use in source and binary forms with or without modification are permitted BSD 2 clause license",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted neither the name BSD 3 clause license",
    "CC-BY-4.0": "licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0",
    "CC-BY-NC-4.0": "licensed under CC BY NC 4.0",
    "CC-BY-SA-4.0": "licensed under the Creative Commons Attribution ShareAlike 4.0 International License CC BY SA 4.0",
    "CC0-1.0": "dedicated to the public domain under the CC0 1.0 Universal license",
    "GPL-2.0": "licensed under the GNU General Public License version 2",
    "GPL-3.0": "licensed under the GNU General Public License version 3",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee ISC license",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License version 3",
    "MIT": "released under the MIT License permission is hereby granted free of charge",
    "MIT-short": "released under the MIT License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License v 2.0",
    "Unlicense": "free and unencumbered software released into the public domain unlicense",
}
#: Words that a window must have to match a short notice: without them it names another licence, or none.
NAMES = {
    "AGPL-3.0": "affero", "Apache-2.0": "apache", "BSD-2-Clause": "redistribution", "BSD-3-Clause": "redistribution", "CC-BY-4.0": "by", "CC-BY-NC-4.0": "nc", "CC-BY-SA-4.0": "sa",
    "CC0-1.0": "cc0", "GPL-2.0": "gnu", "GPL-3.0": "gnu", "ISC": "fee", "LGPL-3.0": "lesser", "MIT": "mit", "MIT-short": "mit", "MPL-2.0": "mozilla", "Unlicense": "unencumbered",
}
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_COPIES = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
_HEADER = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} license as published by the free software foundation either version {} of the license or at your option any later version"
#: Whole texts of short licences, headers of files, and the opening of the AGPL.
TEXTS = {
    "AGPL-3.0 header": _HEADER.format("affero general public", 3),
    "AGPL-3.0 text": f"gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc {_COPIES} preamble the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "Apache-2.0 header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "BSD-2-Clause text": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause text": f"{_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "BSD-4-Clause text": f"{_BSD} 3 all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by the organization 4 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "BSL-1.0 header": "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
    "BSL-1.0 text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "EUPL-1.2 header": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence you may not use this work except in compliance with the licence you may obtain a copy of the licence at",
    "GPL-1.0 header": _HEADER.format("general public", 1),
    "GPL-2.0 header": _HEADER.format("general public", 2),
    "GPL-3.0 header": _HEADER.format("general public", 3),
    "ISC text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "LGPL-2.0 header": _HEADER.format("library general public", 2),
    "LGPL-2.1 header": _HEADER.format("lesser general public", "2 1"),
    "LGPL-3.0 header": _HEADER.format("lesser general public", 3),
    "MIT text": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}",
    "MPL-2.0 header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "Unlicense text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "Zlib text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}
#: Folder of whole texts of long licences, one file each, named by the licence.
WHOLE = str(Path(__file__).with_name("license_texts"))
HINT = r"(?i)licen[cs]e|copyright|spdx|public\s+domain|redistribution"
#: A passage of a hinted line: the hint, with up to 200 characters before it and 300 behind.
PASSAGE = r"(?i).{0,200}?(?:licen[cs]e|copyright|spdx|public domain|redistribution).{0,300}"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)(?:[.-][^/]*)?$"
TERM = "[a-z0-9]+"


@dataclass(frozen=True)
class Scan:
    """least: cosine from which a passage has the licence of a template; least_whole: of a long template, as texts of
    that length share more words by chance; long: words from which a template is long; texts: folder of whole texts."""

    least: float = 0.6
    least_whole: float = 0.75
    long: int = 400
    texts: str = WHOLE


def whole_texts(folder: str) -> dict[str, str]:
    """Licence and text of every .txt file of a folder, which the driver reads: a fixed set of templates."""
    return {f"{p.stem} whole": p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).glob("*.txt"))}


def _terms(passage: Column) -> Column:
    return F.regexp_extract_all(F.lower(passage), F.lit(TERM), F.lit(0))


def scored(hinted: DataFrame, passages: DataFrame, scan: Scan | None = None) -> DataFrame:
    """__row, license, score, licenses of hinted (__row, text): the best template of each row whose cosine to a window is
    at least the scan's bound, and every licence with such a template, best first.

    Document frequencies are counted over all distinct passages and the templates. Ties go to the name that
    sorts first.
    """
    s = scan or Scan()
    spark = hinted.sparkSession
    every = TEMPLATES | TEXTS | whole_texts(s.texts)
    size = {k: len(re.findall(TERM, v.lower())) for k, v in every.items()}
    rows = [(k, v, size[k], max(size[k] // 8, 1) if size[k] >= s.long else 1, s.least_whole if size[k] >= s.long else s.least, [NAMES[k]] if k in NAMES else []) for k, v in every.items()]
    tmpl = spark.createDataFrame(rows, "name string, passage string, length int, hop int, least double, names array<string>")
    tf = lambda d, key: d.select(key, F.explode(_terms(F.col("passage"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    p = cut(tf(passages.select("passage", F.xxhash64("passage").alias("h")), "h"))
    t = cut(tf(tmpl, "name"))
    n = p.select("h").distinct().count() + len(every)
    df = p.groupBy("term").agg(F.count("*").alias("df")).unionByName(t.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = cut(df.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    # A window may have words that no passage has.
    weigh = lambda d: d.join(idf, "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1))
    tw = cut(weigh(t))
    # The templates are the lists above: a fixed, small table.
    square = F.col("w") * F.col("w")
    norms = tw.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("term", square))).alias("squares"), F.sum(square).alias("total"))
    shape = tmpl.drop("passage").join(norms, "name").withColumns({"need": (F.col("least") * F.col("least") - 1e-9) * F.col("total"), "terms": F.map_keys("squares")})
    # Fewer common words than that can't reach the bound, were they the heaviest.
    heavy = F.reverse(F.array_sort(F.map_values("squares")))
    summed = F.aggregate(heavy, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")), lambda a, x: F.when(a["sum"] < F.col("need"), F.struct((a["sum"] + x).alias("sum"), (a["k"] + 1).alias("k"))).otherwise(a))
    shape = cut(shape.withColumn("few", summed["k"]))

    def may(words: Column) -> Column:
        """False only where no window within words can reach the bound: a cosine is at most the share of the template's norm on common words."""
        common = F.array_intersect(words, F.col("terms"))
        weight = F.aggregate(common, F.lit(0.0), lambda a, x: a + F.col("squares")[x])
        return F.forall("names", lambda x: F.array_contains(words, x)) & F.when(F.size(common) >= F.col("few"), weight >= F.col("need")).otherwise(False)

    texts = hinted.select("__row", _terms(F.col("text")).alias("words")).withColumn("set", F.array_distinct("words"))
    pairs = texts.crossJoin(F.broadcast(shape)).filter(F.size("set") >= F.col("few")).filter(may(F.col("set")))
    near = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("terms", F.element_at("words", i)))
    apart = F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("length") + F.col("hop"), F.lit(1)), "hop")
    starts = F.when(F.col("hop") == 1, near).otherwise(apart)
    found = F.filter(F.transform(starts, lambda i: F.slice("words", i, F.col("length"))), may)
    wins = cut(pairs.select("__row", "name", F.explode(F.array_distinct(F.transform(found, lambda x: F.array_join(x, " ")))).alias("win")).withColumn("h", F.xxhash64("name", "win")))
    each = wins.select("h", "name", "win").distinct().select("h", "name", F.explode(F.split("win", " ")).alias("term")).groupBy("h", "name", "term").agg(F.count("*").alias("tf"))
    ww = weigh(each).join(F.broadcast(tw.select("name", "term", F.col("w").alias("v"))), ["name", "term"], "left")
    norm_t = shape.select("name", "least", F.sqrt("total").alias("nt"))
    cos = ww.groupBy("h", "name").agg(F.sqrt(F.sum(square)).alias("np"), F.sum(F.col("w") * F.col("v")).alias("dot")).join(F.broadcast(norm_t), "name")
    cos = cos.withColumn("score", F.col("dot") / (F.col("np") * F.col("nt"))).filter(F.col("score") >= F.col("least"))
    same = F.when(F.col("name") == "MIT-short", "MIT").otherwise(F.split("name", " ")[0])
    # Sums in another order differ in the last digits: equal scores are told by ten.
    hits = wins.select("__row", "h").join(cos.select("h", same.alias("license"), (-F.round("score", 10)).alias("neg")), "h")
    each = hits.groupBy("__row", "license").agg(F.min("neg").alias("neg"))
    best = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("neg", "license"))).alias("b"))  # a licence once: as many as there are licences
    return best.select("__row", F.col("b")[0]["license"].alias("license"), (-F.col("b")[0]["neg"]).alias("score"), F.transform("b", lambda x: x["license"]).alias("licenses"))


def parent(path: Column) -> Column:
    """The directory of a path; empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", scan: Scan | None = None) -> DataFrame:
    """files with own_license, own_score, own_licenses (all that reach the bound, best first; null without one), license
    and from_dir (the directory that license is inherited from, or null).

    Null text: no licence of its own. Null path: nothing is inherited. Of several windows the highest score
    counts, ties go to the name that sorts first; of several licence files in a directory likewise. Repeated rows
    stay. An empty table gives no rows. Columns of files that clash with the new ones are replaced.
    """
    s = scan or Scan()
    new = ("own_license", "own_score", "own_licenses", "license", "from_dir")
    cols = [c for c in files.columns if c not in new]
    t = text_of(F.col(text))
    is_file = F.coalesce(F.rlike(F.col(path), F.lit(LICENCE_FILE)), F.lit(False))
    found = F.when(is_file & (F.length(t) > 0), F.array(t)).when(F.rlike(t, F.lit(HINT)), F.flatten(F.transform(F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(HINT))), lambda x: F.regexp_extract_all(x, F.lit(PASSAGE), F.lit(0))))).otherwise(F.array().cast("array<string>"))
    rows = files.select(*cols).withColumns({"__row": F.monotonically_increasing_id(), "__passages": F.array_distinct(F.transform(found, lambda x: F.trim(x))), "__hinted": F.when((is_file & (F.length(t) > 0)) | F.rlike(t, F.lit(HINT)), t)})
    slim = cut(rows.select("__row", F.col(path).alias("path"), "__passages", "__hinted", is_file.alias("is_file"), *[F.col(c).alias(f"__own_{i}") for i, c in enumerate(cols) if c not in (path, text)]))
    passages = slim.select(F.explode("__passages").alias("passage")).distinct()
    own = cut(scored(slim.filter("__hinted is not null").select("__row", F.col("__hinted").alias("text")), passages, s).select("__row", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.col("licenses").alias("own_licenses")))
    told = slim.filter("is_file and path is not null").join(own, "__row").groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("neg"), F.col("own_license"))).alias("b"))
    told = told.select(F.col("dir").alias("anc"), F.col("b.own_license").alias("dir_license"))
    dirs = slim.filter("path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("anc")))
    near = dirs.select("dir", F.explode(ups).alias("u")).select("dir", "u.depth", "u.anc").join(told, "anc").groupBy("dir").agg(F.max(F.struct("depth", "anc", "dir_license")).alias("b")).select("dir", F.col("b.anc").alias("from_dir"), F.col("b.dir_license").alias("dir_license"))
    out = slim.join(own, "__row", "left").withColumn("dir", parent(F.col("path"))).join(near, "dir", "left")
    keep = [F.col("path").alias(path) if c == path else F.col(f"__own_{i}").alias(c) for i, c in enumerate(cols) if c != text]
    mine = F.col("own_license").isNotNull()
    return out.select(*keep, "own_license", "own_score", "own_licenses", F.coalesce("own_license", "dir_license").alias("license"), F.when(~mine, F.col("from_dir")).alias("from_dir"))


