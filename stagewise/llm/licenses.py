"""License scans with ordered signature rules, in DataFrame operations only.

Texts become words (lower-case, separated by one space). A keyword prefilter
picks the texts that any rule can match, and for each the rules whose keyword it
holds; rules are a small constant table, joined by keyword, and each regex runs
over the whole normalised text. Of overlapping detections, one that lies within
another of higher priority, or of equal priority and greater length, is
suppressed: in the order of starts, longer ones first, it is one whose end does
not pass the furthest end met so far among those of its priority or a higher one.

Rules come from a table of license names, versions and wordings (about 400
regexes). Besides them, three fixed phrases are counted at all their places.

Edge cases: null text has no words; repeated rows are scanned each; a null
doc_id is kept; an empty table gives no rows; ties between equal detections go
to the rule that comes first; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import matches
from .storage import keep_columns, materialize

# Phrases that are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Keyword, label, name as a regex over words, versions.
VERSIONED = [
    ("general public", "gpl", "(?:gnu )?(?:gpl|general public license)", "1 0|2 0|2|3 0|3"),
    ("gpl", "gpl", "(?:gnu )?gpl ?v?", "1|2|3"),
    ("lesser general", "lgpl", "(?:gnu )?lesser general public license", "2 1|3 0|3"),
    ("library general", "lgpl", "(?:gnu )?library general public license", "2 0|2"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl ?v?", "2|2 1|3"),
    ("affero", "agpl", "(?:gnu )?affero general public license", "1 0|3 0|3"),
    ("agpl", "agpl", "(?:gnu )?agpl ?v?", "1|3"),
    ("free documentation", "gfdl", "(?:gnu )?free documentation license", "1 1|1 2|1 3"),
    ("apache", "apache", "apache(?: software)?(?: license)?", "1 0|1 1|2 0|2"),
    ("mozilla", "mpl", "mozilla public license", "1 0|1 1|2 0"),
    ("mpl", "mpl", "mpl ?v?", "1 0|1 1|2 0"),
    ("eclipse", "epl", "eclipse public license", "1 0|2 0"),
    ("cddl", "cddl", "cddl", "1 0|1 1"),
    ("common development", "cddl", "common development and distribution license", "1 0|1 1"),
    ("common public", "cpl", "common public license", "1 0"),
    ("european union", "eupl", "european union public licen[cs]e", "1 0|1 1|1 2"),
    ("open software", "osl", "open software license", "1 0|2 0|2 1|3 0"),
    ("academic free", "afl", "academic free license", "1 1|1 2|2 0|2 1|3 0"),
    ("artistic", "artistic", "artistic license", "1 0|2 0"),
    ("cecill", "cecill", "cecill(?: free software license agreement)?", "1 0|2 0|2 1"),
    ("boost", "bsl", "boost software license", "1 0"),
    ("open font", "ofl", "(?:sil )?open font license", "1 0|1 1"),
    ("zope", "zpl", "zope public license", "1 1|2 0|2 1"),
    ("php license", "php", "php license", "3 0|3 01"),
    ("latex project", "lppl", "latex project public license", "1 0|1 1|1 2|1 3"),
    ("python", "python", "python(?: software foundation)? license", "2 0|2"),
    ("netscape", "npl", "netscape public license", "1 0|1 1"),
    ("microsoft", "ms-pl", "microsoft public license", "1 0"),
    ("creative commons", "cc0", "creative commons zero", "1 0"),
    ("cc0", "cc0", "cc0", "1 0"),
]
# Parts and versions of the attribution licenses.
CC_PARTS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = "1 0|2 0|2 5|3 0|4 0"
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
# Keyword, label, wording, confidence.
PLAIN = [
    ("mit license", "mit", "mit license", 0.9),
    ("permission is hereby granted", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "mit", "(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?mit(?: license)?", 1.0),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", 0.8),
    ("redistribution and use", "bsd", "redistribution and use in source and binary forms with or without modification", 1.0),
    *[("bsd", f"bsd-{n}-clause", f"(?:bsd {n}(?: clause)?|{w} clause bsd|{n} clause bsd)(?: license)?", 0.9) for n, w in ((0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four"))],
    ("bsd", "bsd-2-clause", "simplified bsd license", 0.9),
    ("bsd", "bsd-3-clause", "(?:new|modified|revised) bsd license", 0.9),
    ("isc license", "isc", "isc license", 0.9),
    ("zlib", "zlib", "zlib(?: libpng)? license", 0.9),
    ("unlicense", "unlicense", "unlicense", 0.8),
    ("public domain", "public-domain", "(?:released |dedicated |placed )?(?:in|into|to) the public domain", 0.9),
    ("public domain", "public-domain", "public domain", 0.5),
    ("wtfpl", "wtfpl", "wtfpl", 0.8),
    ("x11 license", "x11", "x11 license", 0.9),
    ("postgresql license", "postgresql", "postgresql license", 0.9),
    ("openssl license", "openssl", "openssl license", 0.9),
    ("apache", "apache", "apache license", 0.6),
    ("mozilla", "mpl", "mozilla public license", 0.6),
    ("eclipse", "epl", "eclipse public license", 0.6),
    ("lesser general", "lgpl", "(?:gnu )?lesser general public license", 0.7),
    ("affero", "agpl", "(?:gnu )?affero general public license", 0.7),
    ("creative commons", "cc", "creative commons(?: license)?", 0.5),
    ("spdx", "spdx", "spdx license identifier [a-z0-9]+(?: [0-9]+){0,2}", 1.0),
    ("all rights", "reserved", "all rights reserved", 0.4),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 0.3),
    ("proprietary", "proprietary", "proprietary and confidential", 0.6),
]


def signature_rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, label, regex, priority, confidence) in order of the table."""
    rules = []
    grant = "(?:licensed|released|distributed|available|made available) under (?:the )?(?:terms of (?:the )?)?"
    named = [(k, label, name, v) for k, label, name, versions in VERSIONED for v in versions.split("|")]
    for part in CC_PARTS:
        words = " ?".join(CC_WORDS[w] for w in part.split())
        for v in CC_VERSIONS.split("|"):
            named.append(("cc " + part, "cc-" + part.replace(" ", "-"), "cc " + part, v))
            named.append(("creative commons", "cc-" + part.replace(" ", "-"), f"creative commons {words}", v))
    for keyword, label, name, v in named:
        full = f"{label}-{v.replace(' ', '.')}"
        versioned = f"{name}(?: international| unported)?(?: license)?(?: version| v)? ?{v}(?: international| unported)?"
        rules.append((keyword, full + "-or-later", versioned + " or (?:at your option )?(?:any )?later(?: version)?", 30, 1.0))
        rules.append((keyword, full, grant + versioned, 20, 1.0))
        rules.append((keyword, full, versioned, 10, 0.9))
    for keyword, label, wording, confidence in PLAIN:
        rules.append((keyword, label, wording, int(confidence * 10) - 1, confidence))
    return rules


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(row, doc_id, n_words, held, words): words, padded with spaces, where a keyword is held."""
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    out = keep_columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", joined.alias("joined")).withColumn("lowered", F.lower("joined"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)]))
    ascii_only = F.octet_length("joined") == F.char_length("joined")
    exact = F.when(ascii_only, F.col("lowered")).otherwise(F.translate("joined", _UPPER, _LOWER))
    out = out.withColumn("held", held)
    return out.select("row", "doc_id", F.when(F.col("joined") == "", 0).otherwise(_spaces(F.col("joined")) + 1).cast("bigint").alias("n_words"), "held", F.when(F.size("held") > 0, F.concat(F.lit(" "), exact, F.lit(" "))).alias("words"))


def detections(words: DataFrame, keywords: list[str]) -> DataFrame:
    """(row, label, confidence, start, end) of the detections that are not suppressed; in characters."""
    table = [(keywords.index(k), i, label, f"(?<= ){pattern}(?= )", priority, confidence) for i, (k, label, pattern, priority, confidence) in enumerate(signature_rules())]
    rules = words.sparkSession.createDataFrame(table, "keyword int, rule int, label string, pattern string, priority int, confidence double")
    pairs = words.where("words is not null").select("row", "words", F.explode("held").alias("keyword")).join(F.broadcast(rules), "keyword").where(F.rlike("words", F.col("pattern")))
    spans = F.explode(matches(F.col("words"), F.col("pattern"))).alias("span")
    found = pairs.select("row", "rule", "label", "priority", "confidence", spans).select("row", "rule", "label", "priority", "confidence", "span.start", "span.end")
    return unsuppressed(found)


def unsuppressed(found: DataFrame) -> DataFrame:
    """The detections (row, rule, label, priority, confidence, start, end) that lie within no stronger one."""
    # a container comes before what it contains; of equal spans the stronger, then the earlier rule
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({rule[3] for rule in signature_rules()})
    reach = [F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before) for level in levels]
    own = F.coalesce(*[F.when(F.col("priority") == level, end) for level, end in zip(levels, reach)])
    return found.withColumn("reach", own).where("reach is null or reach < end").select("row", "label", "confidence", "start", "end")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Word and phrase counts, labels and a score for every document."""
    rule_keywords = list(dict.fromkeys(r[0] for r in signature_rules()))
    keywords = list(dict.fromkeys([*rule_keywords, *BASE_PHRASES]))
    words = materialize(normalised(docs, keywords), "words")
    counts, first, last, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        size = len(phrase.split())
        pieces = F.split("words", f" {phrase}(?= )", -1)
        n = F.when(F.col("words").isNotNull(), F.size(pieces) - 1).otherwise(0)
        counts.append(n)
        first.append(F.when(n > 0, _spaces(F.element_at(pieces, 1))))
        last.append(F.when(n > 0, _spaces(F.col("words")) - _spaces(F.element_at(pieces, -1)) - size))
        labels.append(F.when(n > 0, F.lit(label)))
    base = words.select(
        "row", "doc_id", "n_words",
        sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*first).cast("bigint").alias("first_word"), F.greatest(*last).cast("bigint").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )
    found = detections(words, keywords).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("confidence"))
    joined = base.join(found, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.4).otherwise(0.0))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
