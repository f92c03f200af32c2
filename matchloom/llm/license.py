"""License scans by ordered signature rules.

A rule is a regular expression over normalised words, gated by keywords of which the text
must have one as a word: written rules for texts, notices and names (``license_rules``), and common
forms of every versioned family. Hits become word intervals. An interval inside another one is suppressed;
of two equal intervals the rule with the better (smaller) priority stays. Everything is
a row-local column expression, so a scan needs no shuffle.

Defined cases: a null text is empty and gives no hits; repeated rows give repeated
results; texts of any length are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.license_rules import written_rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are always reported, wherever their words stand together.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Label, keywords, the license's names and its versions as expressions
# over normalised words. Names stand without the word license.
FAMILIES = (
    ("mit", "mit expat", r"mit|expat|mit x11", ""),
    ("apache-1", "apache", r"apache(?: software)?", r"1 [01]"),
    ("apache-2", "apache asl", r"apache(?: software)?|asl", r"2(?: 0)?"),
    ("bsd-2-clause", "bsd freebsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd", ""),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", ""),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|4 clause bsd|original bsd", ""),
    ("gpl-1", "general gpl", r"gnu general public|gnu gpl|gpl", r"1(?: 0)?"),
    ("gpl-2", "general gpl", r"gnu general public|gnu gpl|gpl", r"2(?: 0)?"),
    ("gpl-3", "general gpl", r"gnu general public|gnu gpl|gpl", r"3(?: 0)?"),
    ("lgpl-2", "lesser library lgpl", r"gnu (?:lesser|library) general public|gnu lgpl|lgpl", r"2(?: [01])?"),
    ("lgpl-3", "lesser lgpl", r"gnu lesser general public|gnu lgpl|lgpl", r"3(?: 0)?"),
    ("agpl-3", "affero agpl", r"gnu affero general public|gnu agpl|agpl", r"3(?: 0)?"),
    ("mpl-1", "mozilla mpl", r"mozilla public|mpl", r"1 [01]"),
    ("mpl-2", "mozilla mpl", r"mozilla public|mpl", r"2(?: 0)?"),
    ("epl-1", "eclipse epl", r"eclipse public|epl", r"1(?: 0)?"),
    ("epl-2", "eclipse epl", r"eclipse public|epl", r"2(?: 0)?"),
    ("cddl-1", "development cddl", r"common development and distribution|cddl", r"1 [01]"),
    ("cpl-1", "common", r"common public", r"1(?: 0)?"),
    ("eupl-1", "european eupl", r"european union public|eupl", r"1 [012]"),
    ("artistic-1", "artistic", r"artistic", r"1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic", r"2(?: 0)?"),
    ("bsl-1", "boost bsl", r"boost software|bsl", r"1(?: 0)?"),
    ("busl-1", "business busl", r"business source|busl", r"1 1"),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("isc", "isc", r"isc", ""),
    ("unlicense", "unlicense", r"unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", ""),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("openssl", "openssl", r"openssl", ""),
    ("python-2", "python psf", r"python(?: software foundation)?|psf", r"2(?: 0)?"),
    ("ruby", "ruby", r"ruby", ""),
    ("php-3", "php", r"php", r"3(?: [01]){0,2}"),
    ("ofl-1", "font ofl", r"sil open font|open font|ofl", r"1 [01]"),
    ("odbl-1", "database odbl", r"open data commons open database|open database|odbl", r"1(?: 0)?"),
    ("ecl-2", "educational", r"educational community", r"2(?: 0)?"),
    ("afl-3", "academic afl", r"academic free|afl", r"3(?: 0)?"),
    ("ms-pl", "microsoft ms", r"microsoft public|ms pl", ""),
    ("upl-1", "universal upl", r"universal permissive|upl", r"1(?: 0)?"),
    ("gfdl-1", "documentation gfdl", r"gnu free documentation|gfdl", r"1 [123]"),
    ("cc0-1", "cc0 creative", r"cc0|creative commons zero", r"1(?: 0)?"),
    ("cc-by", "cc creative", r"creative commons attribution|cc by", r"[1234](?: [05])?"),
    ("cc-by-sa", "cc creative", r"creative commons attribution share ?alike|cc by sa", r"[1234](?: [05])?"),
    ("cc-by-nd", "cc creative", r"creative commons attribution no ?deriv[a-z]*|cc by nd", r"[1234](?: [05])?"),
    ("cc-by-nc", "cc creative", r"creative commons attribution non ?commercial|cc by nc", r"[1234](?: [05])?"),
    ("cc-by-nc-sa", "cc creative", r"creative commons attribution non ?commercial share ?alike|cc by nc sa", r"[1234](?: [05])?"),
    ("cc-by-nc-nd", "cc creative", r"creative commons attribution non ?commercial no ?deriv[a-z]*|cc by nc nd", r"[1234](?: [05])?"),
)

# Name, confidence, form, and what the form needs besides the name, from
# the most telling to the least. {n} is a family's names, {v} its version.
FORMS = (
    ("identifier", 1.0, r"spdx license identifier (?:{n})(?: {v})?(?: only| or later)?", "spdx"),
    ("grant", 1.0, r"(?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})(?: public)?(?: licen[sc]e)?(?: version| v)?(?: {v})", "under"),
    ("under", 0.95, r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n}) licen[sc]e(?:(?: version| v)? {v})", "under"),
    ("versioned", 0.9, r"(?:{n}) licen[sc]e(?: version| v)? {v}", "licen"),
    ("header", 0.8, r"licen[sc]ed? (?:{n})(?:(?: version| v)? {v})", "licen"),
)


def _rules() -> list[dict]:
    """Base phrases, every family in every form, and the written rules; best priority first."""
    rules = [
        {"kw": p.split()[0], "kw2": p.split()[-1], "rx": p, "label": label, "base": True, "conf": 0.9}
        for p, label in BASE_PHRASES
    ]
    for name, conf, form, need in FORMS:
        for label, kw, names, version in FAMILIES:
            rx = form.replace("{n}", names)
            # A family with versions is told apart by them; the others have none.
            rx = rx.replace("(?: {v})?", f"(?: {version})?" if version else "")
            rx = rx.replace("(?:(?: version| v)? {v})", f"(?:(?: version| v)? {version})" if version else "")
            rx = rx.replace("(?: version| v)?(?: {v})", f"(?: version| v)? {version}" if version else "")
            rx = rx.replace("(?: version| v)? {v}", f"(?: version| v)? {version}" if version else "")
            rules.append({"kw": need, "kw2": kw, "rx": rx, "label": label, "base": False, "conf": conf})
    rules += [
        {"kw": "", "kw2": kw, "rx": rx, "label": label, "base": False, "conf": conf}
        for label, kw, rx, conf in written_rules()
    ]
    return [r | {"prio": i} for i, r in enumerate(rules)]


RULES = _rules()
# No rule matches more words.
MOST_WORDS = 64
_RULE = "struct<kw:string,rx:string,label:string,base:boolean,conf:double,prio:int>"


def _by_keyword(rules: list[dict]) -> Column:
    """Each keyword with the rules it lets through, as a literal."""
    groups: dict[str, list] = {}
    for rule in rules:
        for word in rule["kw2"].split():
            groups.setdefault(word, []).append({k: v for k, v in rule.items() if k != "kw2"})
    table = [{"word": word, "rules": own} for word, own in groups.items()]
    return F.from_json(F.lit(json.dumps(table)), f"array<struct<word:string,rules:array<{_RULE}>>>")


def _place(rule: Column) -> Column:
    """Where a rule matches whole words, as an expression that takes up no text."""
    return F.concat(F.lit("(?<= )(?=(?:"), rule["rx"], F.lit(") )"))


def _hits(rule: Column, norm: Column, words: Column) -> Column:
    """Intervals (in words, end exclusive) at which a rule matches.

    A marker is put before each match; marked words give the starts, and the words from
    there on each match's length. Matches of one rule may overlap.
    """
    place = _place(rule)
    marked = F.split(F.trim(F.regexp_replace(norm, place, F.lit("\x01"))), " ")
    starts = F.filter(
        F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)),
        lambda i: i.isNotNull(),
    )
    found = F.concat(F.lit("^(?:"), rule["rx"], F.lit(")(?= )"))
    return F.transform(
        starts,
        lambda s: F.struct(
            s.cast("bigint").alias("start"),
            # Negated, so that the natural order puts the longer of two first.
            (-(s + F.size(F.split(F.call_function(
                "regexp_extract", _text_from(words, s), found, F.lit(0)), " "))
            )).cast("bigint").alias("minus_end"),
            rule["prio"].alias("prio"),
            rule["label"].alias("label"),
            rule["conf"].alias("conf"),
            rule["base"].alias("base"),
        ),
    )


def _text_from(words: Column, start: Column) -> Column:
    return F.concat(F.array_join(F.slice(words, start + 1, F.lit(MOST_WORDS)), " "), F.lit(" "))


def scan_licenses(docs: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Licenses of every text; see the module for the method and the defined cases.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base
    phrase, null without one. ``score`` is the confidence of the best rule that stayed.
    """
    rules = RULES if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r["kw2"].split()})])
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("_lower", NOT_WORD, " ")), F.lit(" "))
    none = "array<struct<start:bigint,minus_end:bigint,prio:int,label:string,conf:double,base:boolean>>"
    groups = F.filter(_by_keyword(rules), lambda g: F.array_contains("_present", g["word"]))
    active = F.filter(
        F.array_distinct(F.flatten(F.transform(groups, lambda g: g["rules"]))),
        # The second keyword, if any, starts a word.
        lambda r: F.contains(F.col("_norm"), F.concat(F.lit(" "), r["kw"])) & F.rlike(F.col("_norm"), _place(r)),
    )
    sweep = F.aggregate(
        F.col("_hits"),
        F.struct(
            F.lit(0).cast("bigint").alias("end"),
            F.array().cast("array<string>").alias("labels"),
            F.lit(0.0).alias("conf"),
            F.lit(0).cast("bigint").alias("kept"),
        ),
        # Sorted by start, then longest first: inside an earlier one means suppressed.
        lambda s, h: F.when(
            -h["minus_end"] > s["end"],
            F.struct(
                (-h["minus_end"]).alias("end"),
                F.array_union(s["labels"], F.array(h["label"])).alias("labels"),
                F.greatest(s["conf"], h["conf"]).alias("conf"),
                (s["kept"] + 1).alias("kept"),
            ),
        ).otherwise(s),
    )
    scanned = (
        docs.select("doc_id", lower.alias("_lower"))
        .withColumn("_norm", norm)
        .withColumn("_words", F.filter(F.split(F.trim("_norm"), " "), lambda w: w != ""))
        .withColumn("_present", F.array_intersect("_words", keywords))
        .withColumn("_active", F.when(F.size("_present") > 0, active))
        .withColumn(
            "_hits",
            F.when(
                F.size("_active") > 0,
                F.array_sort(
                    F.flatten(F.transform(F.col("_active"), lambda r: _hits(r, F.col("_norm"), F.col("_words"))))
                ),
            ).otherwise(F.array().cast(none)),
        )
        .withColumn("_base", F.filter("_hits", lambda h: h["base"]))
        .withColumn("_sweep", sweep)
        .withColumn("_base_labels", F.array_distinct(F.transform("_base", lambda h: h["label"])))
    )
    starts = F.transform("_base", lambda h: h["start"])
    return scanned.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort("_base_labels"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("_base_labels", F.col("_sweep.labels"))), ","
        ).alias("labels"),
        F.col("_sweep.conf").alias("score"),
        F.col("_sweep.kept").alias("n_detections"),
    )
