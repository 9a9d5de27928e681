"""License scan by ordered signature rules, with built-in functions only.

Several hundred regexes come from the tables below: signatures of notices, each
written by hand, and each licence's names put into sentence templates.  A rule has two keywords that must occur in the
lower-cased text before its regex runs, and documents without any first keyword
stop there.  Overlapping detections are resolved by suppression: one whose
interval lies inside another's goes when the other has the higher priority, or
the same and the longer interval (then the lower rule number).

Base labels are counted separately, by words: runs of ASCII digits, letters and
non-ASCII characters, A-Z lower-cased.

Everything happens inside a row; there is no shuffle and no Python.

Defined cases: null and empty texts have no words and no labels; equal places
of one rule in repeated rows are reported in each; ties between detections go to
the lower rule number; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty
from .spans import match_spans

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (words, label) of the base phrases.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

# Licence identifiers and the names that texts use for them.
LICENSES = (
    ("MIT", ("mit", "expat", "x11")),
    ("Apache-1.1", ("apache software license 1.1", "apache license version 1.1")),
    ("Apache-2.0", ("apache 2.0", "apache license 2.0", "apache license version 2.0", "apache-2.0", "asl 2.0")),
    ("GPL-1.0", ("gpl 1.0", "gplv1", "gnu general public license version 1")),
    ("GPL-2.0", ("gpl 2.0", "gplv2", "gpl-2.0", "gnu general public license version 2", "gnu gpl v2")),
    ("GPL-3.0", ("gpl 3.0", "gplv3", "gpl-3.0", "gnu general public license version 3", "gnu gpl v3")),
    ("LGPL-2.1", ("lgpl 2.1", "lgplv2.1", "lgpl-2.1", "gnu lesser general public license version 2.1")),
    ("LGPL-3.0", ("lgpl 3.0", "lgplv3", "lgpl-3.0", "gnu lesser general public license version 3")),
    ("AGPL-3.0", ("agpl 3.0", "agplv3", "agpl-3.0", "gnu affero general public license version 3")),
    ("BSD-2-Clause", ("bsd 2-clause", "2-clause bsd", "simplified bsd", "freebsd", "bsd-2-clause")),
    ("BSD-3-Clause", ("bsd 3-clause", "3-clause bsd", "new bsd", "modified bsd", "bsd-3-clause")),
    ("BSD-4-Clause", ("bsd 4-clause", "4-clause bsd", "original bsd")),
    ("MPL-1.1", ("mpl 1.1", "mozilla public license 1.1", "mozilla public license version 1.1")),
    ("MPL-2.0", ("mpl 2.0", "mpl-2.0", "mozilla public license 2.0", "mozilla public license version 2.0")),
    ("EPL-1.0", ("epl 1.0", "eclipse public license 1.0", "eclipse public license version 1.0")),
    ("EPL-2.0", ("epl 2.0", "eclipse public license 2.0", "eclipse public license version 2.0")),
    ("CDDL-1.0", ("cddl", "common development and distribution license")),
    ("CPL-1.0", ("common public license 1.0", "common public license version 1.0")),
    ("ISC", ("isc",)),
    ("Zlib", ("zlib", "zlib/libpng")),
    ("BSL-1.0", ("boost software license 1.0", "boost software license version 1.0", "bsl-1.0")),
    ("Artistic-1.0", ("artistic license 1.0", "perl artistic")),
    ("Artistic-2.0", ("artistic license 2.0", "artistic-2.0")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0", "cc0 1.0", "cc0-1.0", "creative commons zero")),
    ("CC-BY-4.0", ("cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0")),
    ("CC-BY-3.0", ("cc by 3.0", "cc-by-3.0", "creative commons attribution 3.0")),
    ("CC-BY-SA-4.0", ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0")),
    ("CC-BY-SA-3.0", ("cc by-sa 3.0", "cc-by-sa-3.0", "creative commons attribution-sharealike 3.0")),
    ("CC-BY-NC-4.0", ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0")),
    ("CC-BY-ND-4.0", ("cc by-nd 4.0", "cc-by-nd-4.0", "creative commons attribution-noderivatives 4.0")),
    ("OFL-1.1", ("ofl 1.1", "sil open font license", "open font license 1.1")),
    ("EUPL-1.2", ("eupl 1.2", "eupl-1.2", "european union public licence")),
    ("PSF-2.0", ("psf", "python software foundation")),
    ("PHP-3.01", ("php 3.01", "php license version 3.01")),
    ("Ruby", ("ruby",)),
    ("Vim", ("vim",)),
    ("PostgreSQL", ("postgresql",)),
    ("OpenSSL", ("openssl",)),
    ("curl", ("curl",)),
    ("NCSA", ("ncsa", "university of illinois/ncsa open source")),
    ("MS-PL", ("ms-pl", "microsoft public license")),
    ("Beerware", ("beerware", "beer-ware")),
    ("ODbL-1.0", ("odbl", "open database license")),
    ("SSPL-1.0", ("sspl", "server side public license")),
    ("BUSL-1.1", ("busl-1.1", "business source license 1.1")),
    ("Elastic-2.0", ("elastic license 2.0",)),
)
#: For names that hold the word licence themselves.
NAMED = r"\b{}\b"
#: (priority, first keyword, template).  ``{}`` stands for a name.
TEMPLATES = (
    (55, "licen", NAMED),
    (90, "spdx-license-identifier", r"spdx-license-identifier:\s*{}(?:-only|-or-later)?\b"),
    (60, "licen", r"\blicen[sc]ed\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{}\b(?:\s+licen[sc]e)?"),
    (50, "licen", r"\b(?:the\s+)?{}(?:\s+(?:style|software|open\s+source|public))?\s+licen[sc]e\b(?:,?\s+version\s+[0-9.]+)?"),
    (40, "licen", r"\blicen[sc]e\s*[:=]\s*[\"']?{}\b"),
)
#: Signatures of whole notices: (label, priority, first keyword, second keyword, regex); a keyword is one word, as lines break anywhere.
NOTICES = (
    ("MIT", 80, "hereby", "granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("ISC", 80, "permission", "distribute", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    ("BSD", 70, "redistribution", "binary", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification"),
    ("GPL", 70, "licen", "general", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser\s+|affero\s+)?general\s+public\s+licen[sc]e"),
    ("GPL", 30, "licen", "general", r"\b(?:gnu\s+)?general\s+public\s+licen[sc]e\b"),
    ("Apache", 30, "licen", "apache", r"\bapache\s+licen[sc]e\b"),
    ("Public-Domain", 40, "domain", "public", r"\b(?:in(?:to)?|to)\s+the\s+public\s+domain\b"),
    ("All-Rights-Reserved", 20, "reserved", "rights", r"\ball\s+rights\s+reserved\b"),
    ("Copyright", 10, "copyright", "copyright", r"\bcopyright\s+(?:\(c\)\s+|©\s*)?[12][0-9]{3}\b"),
    ("Warranty-Disclaimer", 20, "warrant", "provided", r"\bprovided\s+[\"']?as\s+is[\"']?,?\s+without\s+warranty\b"),
    ("Apache-2.0", 85, "licen", "compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[sc]e"),
    ("Apache-2.0", 60, "licen", "implied", r"without\s+warranties\s+or\s+conditions\s+of\s+any\s+kind,\s+either\s+express\s+or\s+implied"),
    ("Apache-1.1", 75, "apache", "foundation", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation"),
    ("MIT", 60, "licen", "substantial", r"shall\s+be\s+included\s+in\s+all\s+copies\s+or\s+substantial\s+portions\s+of\s+the\s+software"),
    ("MIT-0", 75, "licen", "attribution", r"\bmit\s+no\s+attribution\b"),
    ("BSD-3-Clause", 75, "endorse", "promote", r"\bnames?\s+of\s+(?:its|the|their|any)?\s*[a-z ,]{0,80}may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products"),
    ("BSD-4-Clause", 75, "advertising", "mentioning", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("0BSD", 75, "licen", "zero", r"\b(?:bsd\s+zero[\s-]+clause|zero[\s-]+clause\s+bsd)\b"),
    ("GPL-2.0-or-later", 82, "licen", "either", r"either\s+version\s+2\s+of\s+the\s+licen[sc]e,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("GPL-3.0-or-later", 82, "licen", "either", r"either\s+version\s+3\s+of\s+the\s+licen[sc]e,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("LGPL-2.1-or-later", 82, "licen", "2.1", r"either\s+version\s+2\.1\s+of\s+the\s+licen[sc]e,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("AGPL", 65, "licen", "affero", r"\baffero\s+general\s+public\s+licen[sc]e\b"),
    ("LGPL", 65, "licen", "lesser", r"\blesser\s+general\s+public\s+licen[sc]e\b"),
    ("LGPL", 65, "licen", "library", r"\blibrary\s+general\s+public\s+licen[sc]e\b"),
    ("GPL-Linking-Exception", 70, "licen", "exception", r"as\s+a\s+special\s+exception,[^.]{0,200}\b(?:link|linking)\b"),
    ("Classpath-Exception", 70, "licen", "classpath", r"\bclasspath\s+exception\b"),
    ("GFDL", 65, "licen", "documentation", r"\bgnu\s+free\s+documentation\s+licen[sc]e\b"),
    ("MPL", 65, "licen", "mozilla", r"subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[sc]e"),
    ("EPL", 65, "licen", "accompanying", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[sc]e"),
    ("CDDL", 65, "licen", "development", r"subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+licen[sc]e"),
    ("Zlib", 75, "misrepresented", "origin", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("BSL-1.0", 75, "hereby", "organization", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("Unlicense", 80, "unencumbered", "domain", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("WTFPL", 75, "licen", "want", r"\bwant\s+to\s+public\s+licen[sc]e\b"),
    ("CC0-1.0", 75, "waived", "neighb", r"has\s+waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights"),
    ("CC", 35, "licen", "creative", r"\bcreative\s+commons\b[^.]{0,80}\blicen[sc]e\b"),
    ("Artistic", 35, "licen", "artistic", r"\b(?:the\s+)?artistic\s+licen[sc]e\b"),
    ("Perl", 65, "licen", "perl", r"under\s+the\s+same\s+terms\s+as\s+perl\s+itself"),
    ("OpenSSL", 75, "openssl", "product", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project"),
    ("OFL-1.1", 75, "licen", "font", r"this\s+font\s+software\s+is\s+licen[sc]ed\s+under\s+the\s+sil\s+open\s+font\s+licen[sc]e"),
    ("Beerware", 75, "beer", "return", r"you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return"),
    ("JSON", 75, "evil", "good", r"shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("ODbL-1.0", 65, "licen", "database", r"made\s+available\s+under\s+the\s+open\s+database\s+licen[sc]e"),
    ("SSPL-1.0", 65, "licen", "server", r"\bserver\s+side\s+public\s+licen[sc]e\b"),
    ("BUSL-1.1", 65, "licen", "business", r"\bbusiness\s+source\s+licen[sc]e\b"),
    ("Commons-Clause", 65, "licen", "commons", r"\bcommons\s+clause\b[^.]{0,80}\bcondition\b"),
    ("Elastic-2.0", 65, "hosted", "managed", r"may\s+not\s+provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service"),
    ("EUPL", 65, "licen", "eupl", r"licen[sc]ed\s+under\s+the\s+eupl\b"),
    ("PSF-2.0", 65, "licen", "psf", r"\bpsf\s+licen[sc]e\s+agreement\b"),
    ("NCSA", 65, "licen", "illinois", r"\buniversity\s+of\s+illinois(?:\s*/\s*|\s+)ncsa\s+open\s+source\s+licen[sc]e\b"),
    ("Proprietary", 60, "proprietary", "confidential", r"\b(?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)\b"),
    ("Proprietary", 40, "licen", "proprietary", r"\bproprietary\s+licen[sc]e\b"),
    ("Dual-License", 20, "licen", "dual", r"\bdual[\s-]+licen[sc]ed\b"),
    ("License-File", 10, "licen", "file", r"\bsee\s+(?:the\s+)?(?:accompanying\s+)?licen[sc]e\s+file\b"),
)


def rules() -> list[dict]:
    """Every rule in order: label, priority, two keywords, regex."""
    out = []
    for label, priority, first, second, regex in NOTICES:
        out.append({"label": label, "p": priority, "k1": first, "k2": second, "re": "(?i)" + regex})
    for label, names in LICENSES:
        for priority, first, template in TEMPLATES:
            for name in names if first == "licen" else (label.lower(),):
                if template == NAMED and "licen" not in name:
                    continue
                body = r"[\s,-]+".join(re.escape(w) for w in re.split(r"[\s-]+", name))
                body = re.sub(r"version\b", r"(?:version|v\\.?)", body)
                second = max(re.split(r"[\s-]+", name), key=len)
                out.append({"label": label, "p": priority, "k1": first, "k2": second, "re": "(?i)" + template.replace("{}", body)})
    for i, r in enumerate(out):
        r["i"] = i
    return out


def _places(words: Column, phrase: tuple[str, ...], label: str) -> Column:
    """array<struct<w: start word, label>>: where the phrase's words stand one after another."""
    last = len(phrase) - 1

    def here(i: Column) -> Column:
        ok = i >= last
        for k in range(last):
            ok = ok & F.coalesce(F.get(words, i - (last - k)) == phrase[k], F.lit(False))
        return ok

    # The last word of every phrase is its rarest: only its places are looked at.
    ends = F.filter(F.transform(words, lambda x, i: F.when(x == phrase[-1], i)), lambda i: i.isNotNull())
    return F.transform(
        F.filter(ends, here),
        lambda i: F.struct((i - last).cast("bigint").alias("w"), F.lit(label).alias("label")),
    )


def _detections(text: Column, low: Column) -> Column:
    """All detections of the rules whose keywords occur."""
    known = F.from_json(
        F.lit(json.dumps(rules())), "array<struct<i:int,label:string,p:int,k1:string,k2:string,re:string>>"
    )
    live = F.filter(known, lambda r: F.contains(low, r["k1"]) & F.contains(low, r["k2"]))
    return F.flatten(
        F.transform(
            live,
            lambda r: F.transform(
                match_spans(text, r["re"]),
                lambda m: F.struct(
                    m["s"].alias("s"), m["e"].alias("e"), r["p"].alias("p"), r["i"].alias("i"), r["label"].alias("label")
                ),
            ),
        )
    )


def _surviving(all_: Column) -> Column:
    """Detections that no detection of higher rank contains."""

    def beats(o: Column, d: Column) -> Column:
        inside = (o["s"] <= d["s"]) & (o["e"] >= d["e"])
        longer = (o["e"] - o["s"]) > (d["e"] - d["s"])
        same = (o["e"] - o["s"]) == (d["e"] - d["s"])
        return inside & ((o["p"] > d["p"]) | ((o["p"] == d["p"]) & (longer | (same & (o["i"] < d["i"])))))

    return F.filter(all_, lambda d: ~F.exists(all_, lambda o: beats(o, d)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words, base places and surviving detections of each document.

    Columns: doc_id, n_words, base (array of struct<w: start word, label>) and
    detections (array of struct<s, e: code points, p: priority, i: rule, label>).
    """
    raw = docs.select(F.col(id_column), text_or_empty(text_column).alias("text"))
    low = raw.withColumn("low", F.lower("text"))
    keywords = sorted({r["k1"] for r in rules()})
    gate = F.lit(False)
    for k in keywords:
        gate = gate | F.contains("low", F.lit(k))
    gated = low.select(
        id_column,
        "text",
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"),
        F.when(gate, F.col("low")).alias("low"),
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    has_phrase = F.contains("low", F.lit("license"))
    words = gated.withColumn(
        "words",
        F.when(has_phrase, F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(WORD), F.lit(0))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    places = [_places(F.col("words"), phrase, label) for phrase, label in PHRASES]
    empty = F.array().cast("array<struct<s:int,e:int,p:int,i:int,label:string>>")
    found = words.select(
        id_column,
        "n_words",
        F.concat(*places).alias("base"),
        F.when(F.col("low").isNotNull(), _detections(F.col("text"), F.col("low"))).otherwise(empty).alias("found"),
    )
    return found.select(id_column, "n_words", "base", _surviving(F.col("found")).alias("detections"))


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's row for each document."""
    starts = F.transform("base", lambda b: b["w"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    own = F.array_distinct(F.transform("detections", lambda d: F.lower(d["label"])))
    both = F.array_distinct(F.concat(base, own))
    return scanned.select(
        id_column,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("detections") + F.size("base"))).cast("double").alias("score"),
    )
