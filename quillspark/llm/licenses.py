"""License scans by ordered signature rules.

Hundreds of regular expressions over a text's words, each gated by a keyword:
a cheap test lets most texts pass untouched, then only the rules whose keyword
occurs are run. Overlapping detections are settled by priority and by interval
containment. One projection, no shuffle: a row needs nothing but itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is neither digit nor letter.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Certainty of a detection by priority.
CERTAINTY = {1: 0.3, 2: 0.6, 3: 0.8, 4: 0.9, 5: 0.98}
BASE_PRIORITY = 3
#: A detection, and the detections that one piece of a long list holds.
HIT, RUN = "struct<start:int,end:int,priority:int,base:boolean,label:string>", 256

#: License names: label, words of the name, versions.
NAMED = [
    ("apache", "apache", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla public", ["1.0", "1.1", "2.0"]),
    ("gpl", "(?:gnu )?general public", ["1.0", "2.0", "3.0"]),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", ["2.0", "2.1", "3.0"]),
    ("agpl", "(?:gnu )?affero general public", ["1.0", "3.0"]),
    ("gfdl", "(?:gnu )?free documentation", ["1.1", "1.2", "1.3"]),
    ("epl", "eclipse public", ["1.0", "2.0"]),
    ("cddl", "common development and distribution", ["1.0", "1.1"]),
    ("cpl", "common public", ["1.0"]),
    ("eupl", "european union public", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", ["1.0", "2.0"]),
    ("osl", "open software", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic free", ["1.2", "2.0", "2.1", "3.0"]),
    ("ofl", "(?:sil )?open font", ["1.0", "1.1"]),
    ("bsl", "boost software", ["1.0"]),
    ("busl", "business source", ["1.1"]),
    ("mspl", "microsoft public", []),
    ("msrl", "microsoft reciprocal", []),
    ("zpl", "zope public", ["2.0", "2.1"]),
    ("psf", "python software foundation", ["2.0"]),
    ("lppl", "latex project public", ["1.0", "1.3"]),
    ("qpl", "q public", ["1.0"]),
    ("mit", "mit", []),
    ("isc", "isc", []),
    ("zlib", "zlib", []),
    ("ncsa", "ncsa", []),
    ("wtfpl", "do what the fuck you want to public", ["2.0"]),
    ("odbl", "open database", ["1.0"]),
    ("odc-by", "open data commons attribution", ["1.0"]),
    ("ogl", "open government", ["1.0", "2.0", "3.0"]),
    ("cecill", "cecill", ["1.0", "2.0", "2.1"]),
    ("cc0", "cc0", ["1.0"]),
    ("sspl", "server side public", ["1.0"]),
    ("elastic", "elastic", ["2.0"]),
    ("rpl", "reciprocal public", ["1.1", "1.5"]),
    ("apsl", "apple public source", ["1.0", "2.0"]),
    ("ipl", "ibm public", ["1.0"]),
    ("lpl", "lucent public", ["1.0"]),
    ("spl", "sun public", ["1.0"]),
    ("npl", "netscape public", ["1.0", "1.1"]),
    ("ecl", "educational community", ["1.0", "2.0"]),
    ("efl", "eiffel forum", ["1.0", "2.0"]),
    ("php", "php", ["3.0"]),
    ("ruby", "ruby", []),
    ("vim", "vim", []),
    ("postgresql", "postgresql", []),
    ("openssl", "openssl", []),
    ("openldap", "openldap public", ["2.8"]),
    ("w3c", "w3c software", []),
    ("unicode", "unicode", ["3.0"]),
    ("x11", "x11", []),
    ("blue-oak", "blue oak model", ["1.0"]),
    ("mulan", "mulan permissive software", ["2.0"]),
    ("polyform-nc", "polyform noncommercial", ["1.0"]),
    ("hippocratic", "hippocratic", ["2.1", "3.0"]),
    ("openrail", "(?:creativeml )?open rail m", []),
    ("cern-ohl", "cern open hardware", ["1.2", "2.0"]),
    ("solderpad", "solderpad hardware", ["2.1"]),
    ("fal", "free art", ["1.3"]),
    ("opl", "open publication", ["1.0"]),
    ("cpal", "common public attribution", ["1.0"]),
    ("nasa", "nasa open source", ["1.3"]),
]
#: Short names that carry their version: label, letters, versions.
SHORT = [
    ("gpl", "gpl", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lgpl", ["2.0", "2.1", "3.0"]),
    ("agpl", "agpl", ["1.0", "3.0"]),
    ("mpl", "mpl", ["1.1", "2.0"]),
    ("epl", "epl", ["1.0", "2.0"]),
    ("eupl", "eupl", ["1.1", "1.2"]),
    ("apache", "apache", ["1.1", "2.0"]),
    ("cddl", "cddl", ["1.0", "1.1"]),
    ("ofl", "ofl", ["1.1"]),
]
CC_PARTS = [("by", ""), ("by-sa", "sharealike"), ("by-nd", "noderivatives"), ("by-nc", "noncommercial"), ("by-nc-sa", "noncommercial sharealike"), ("by-nc-nd", "noncommercial noderivatives")]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Single phrases: label, pattern, keyword, priority.
PHRASES = [
    ("cc0", "cc0", "cc0", 4),
    ("cc0", "creative commons zero", "commons", 4),
    ("public-domain", "(?:dedicated to|released into|in) the public domain", "domain", 3),
    ("public-domain", "public domain", "domain", 2),
    ("unlicense", "unlicense", "unlicense", 4),
    ("bsd-0-clause", "(?:0|zero) clause bsd", "bsd", 4),
    ("bsd-1-clause", "(?:1|one) clause bsd", "bsd", 4),
    ("bsd-2-clause", "(?:(?:2|two) clause bsd|(?:simplified|freebsd) bsd license|bsd 2 clause)", "bsd", 4),
    ("bsd-3-clause", "(?:(?:3|three) clause bsd|(?:new|revised|modified) bsd license|bsd 3 clause)", "bsd", 4),
    ("bsd-4-clause", "(?:(?:4|four) clause bsd|(?:original|old) bsd license|bsd 4 clause)", "bsd", 4),
    ("bsd", "bsd licen[sc]ed?", "bsd", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 5),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 5),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 5),
    ("apache", "licensed under the apache", "apache", 3),
    ("copyright", "copyright(?: c)? [0-9]{4}", "copyright", 2),
    ("copyright", "copyright", "copyright", 1),
    ("proprietary", "proprietary and confidential", "proprietary", 3),
    ("proprietary", "unauthorized (?:copying|reproduction|distribution)", "unauthorized", 2),
    ("no-redistribution", "may not be (?:reproduced|redistributed|republished)", "may not be", 2),
    ("used-with-permission", "(?:used|reprinted|reproduced) with permission", "with permission", 2),
    ("personal-use", "for personal use only", "personal use", 2),
    ("non-commercial", "for non ?commercial (?:use|purposes)", "for non", 2),
    ("spdx", "spdx license identifier", "spdx", 2),
    ("beerware", "beerware license", "beerware", 3),
    ("beerware", "buy me a beer in return", "me a beer", 3),
    ("commons-clause", "commons clause license condition", "commons", 4),
    ("json", "the software shall be used for good not evil", "evil", 4),
    ("all-permissive", "copying and distribution of this file with or without modification are permitted", "permitted", 5),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it", 5),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute it", 5),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied warranty", 5),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy", "organization obtaining", 5),
    ("isc", "permission to use copy modify and distribute this software for any purpose", "permission to use", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 5),
    ("ofl", "this font software is licensed under", "font software", 4),
    ("no-derivatives", "no derivative works(?: permitted)?", "derivative works", 2),
    ("share-alike", "under the same license as the original", "same license", 2),
    ("attribution", "with attribution to the (?:author|source|original)", "attribution to", 2),
    ("fair-use", "fair (?:use|dealing)", "fair", 1),
    ("educational-use", "for educational (?:use|purposes) only", "educational", 2),
    ("internal-use", "for internal use only", "internal use", 2),
    ("confidential", "(?:strictly|company) confidential", "confidential", 1),
    ("trademark", "(?:is a|are) (?:registered )?trademarks? of", "trademark", 1),
    ("crown-copyright", "crown copyright", "crown", 3),
    ("us-government", "work of the (?:united states|us|u s) government", "government", 3),
    ("copyleft", "copyleft", "copyleft", 2),
    ("license", "licensed under", "licensed under", 1),
    ("license", "released under", "released under", 1),
    ("license", "terms of (?:use|service)", "terms of", 1),
]


def _version(v: str) -> str:
    major, minor = v.split(".")
    return f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def rules() -> list[dict]:
    """All rules in order: label, pattern (over words joined by one space), the
    keyword that gates it, priority, and whether it is a base rule."""
    out = [{"label": label, "pattern": phrase, "keyword": phrase, "priority": BASE_PRIORITY, "base": True} for phrase, label in BASE_PHRASES.items()]

    def add(label, pattern, keyword, priority):
        out.append({"label": label, "pattern": pattern, "keyword": keyword, "priority": priority, "base": False})

    for part, long in CC_PARTS:
        code = part.replace("-", " ")
        name = f"creative commons attribution{' ' + long if long else ''}".replace("noncommercial", "non ?commercial").replace("sharealike", "share ?alike").replace("noderivatives", "no ?deriv(?:ative)?s?(?:works)?")
        for v in CC_VERSIONS:
            add(f"cc-{part}-{v}", f"cc {code} {_version(v)}", "cc", 5)
            add(f"cc-{part}-{v}", f"{name}(?: license)? {_version(v)}(?: international| unported| generic)?", "commons", 5)
        add(f"cc-{part}", f"cc {code}", "cc", 2 + len(part.split("-")))
        add(f"cc-{part}", name, "commons", 2 + len(part.split("-")))
    add("cc", "creative commons", "commons", 1)
    for label, name, versions in NAMED:
        key = name.rsplit(" ", 1)[-1]
        for v in versions:
            add(f"{label}-{v}", f"{name} licen[sc]e(?: version| v)? v?{_version(v)}", key, 5)
            add(f"{label}-{v}", f"{name}(?: version)? v?{_version(v)} licen[sc]e", key, 5)
        add(label, f"{name} licen[sc]e", f"{key} licen", 4 if label not in BASE_PHRASES.values() else 2)
    for label, short, versions in SHORT:
        for v in versions:
            add(f"{label}-{v}", f"(?:gnu )?{short} ?v? ?{_version(v)}(?: or later| only)?", short, 5)
        add(label, f"(?:gnu )?{short}", short, 2)
    for label, pattern, keyword, priority in PHRASES:
        add(label, pattern, keyword, priority)
    return out


def gate_pattern(words) -> str:
    """A pattern that matches where any of ``words`` begins: common beginnings are
    tried once, so a text's word fails at its first letter that no keyword has."""
    tree = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def shown(node):
        if "" in node:  # longer words with this beginning match here too
            return ""
        parts = [letter + shown(rest) for letter, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return shown(tree)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _running(items: Column, state: Column, step, kind: str) -> Column:
    """``step(state, item) -> (state, result)`` over an array: the results in order,
    as array<``kind``>. Pieces of RUN items are collected apart, so the cost of a
    long array is not that of its square."""
    none = F.array().cast(f"array<{kind}>")

    def piece(state, i):
        def one(acc, item):
            after, result = step(acc["state"], item)
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

        return F.aggregate(F.slice(items, i + 1, F.lit(RUN)), F.struct(state.alias("state"), none.alias("out")), one)

    first = F.array(F.struct(state.alias("state"), none.alias("out")))
    pieces = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1, F.lit(RUN)), first, lambda acc, i: F.concat(acc, F.array(piece(F.element_at(acc, -1)["state"], i))))
    return F.when(F.size(items) > 0, F.flatten(F.transform(pieces, lambda p: p["out"]))).otherwise(none)


def _matches(words: str, listed: list[dict]) -> Column:
    """What every rule finds in the column ``words`` and what stands between. Patterns
    are constants, and run only where their keyword begins a word. (One SQL text: so
    many rules are slow to build call by call. Patterns hold no quotes.)"""
    groups = {}
    for rule in listed:
        groups.setdefault(rule["keyword"], []).append(rule)

    def found(rule):
        pattern = f"r'(?<= )(?:{rule['pattern']})(?= )'"
        return (f"IF({words} RLIKE {pattern}, named_struct('found', regexp_extract_all({words}, {pattern}, 0), 'gaps', split({words}, {pattern}, -1), "
                f"'priority', {rule['priority']}, 'base', {str(rule['base']).lower()}, 'label', '{rule['label']}'), NULL)")

    each = [f"IF(contains({words}, ' {keyword}'), array({', '.join(map(found, mine))}), array())" for keyword, mine in groups.items()]
    return F.expr(f"filter(flatten(array({', '.join(each)})), m -> m IS NOT NULL)")


def _places(match: Column) -> Column:
    """Intervals of words [start, end) of one rule's matches, with the rule."""
    def step(at, i):
        begin = at + _spaces(F.get(match["gaps"], i))
        end = begin + _spaces(F.get(match["found"], i))
        return end, F.struct((begin - 1).alias("start"), end.alias("end"), match["priority"].alias("priority"), match["base"].alias("base"), match["label"].alias("label"))

    return _running(F.sequence(F.lit(0), F.size(match["found"]) - 1), F.lit(0), step, HIT)


def _settled(hits: Column) -> Column:
    """The detections that stay, by one sweep over the places in order: the state
    holds, for every priority, how far its detections reach so far."""
    ordered = F.array_sort(F.transform(hits, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("mild"), d["label"].alias("label"), d["base"].alias("base"))))
    levels = sorted(CERTAINTY)

    def step(reach, d):
        end, priority = -d["back"], -d["mild"]
        beaten = F.exists(F.sequence(priority, F.lit(levels[-1])), lambda p: F.element_at(reach, p) >= end)
        after = F.transform(reach, lambda r, i: F.when(i + 1 == priority, F.greatest(r, end)).otherwise(r))
        return after, F.struct(d["start"].alias("start"), end.alias("end"), priority.alias("priority"), d["base"].alias("base"), d["label"].alias("label"), (d["base"] | ~beaten).alias("stays"))

    swept = _running(ordered, F.array(*[F.lit(-1) for _ in levels]), step, HIT[:-1] + ",stays:boolean>")
    return F.transform(F.filter(swept, lambda d: d["stays"]), lambda d: d.dropFields("stays"))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to ``docs`` n_words, n_base, first_word, last_word, base_labels,
    labels, score and ``detections`` (label, start, end, priority, base).

    A detection goes if another of higher priority contains it, or one of the
    same priority that is longer (of equals: the smaller label stays). Base
    detections always stay. Null and empty texts have 0 words, no labels, score
    0 and null places. Score is the certainty of the best detection kept.
    Columns of ``docs`` with these names are replaced; all others are kept,
    whatever their names; repeated rows are each scanned; an empty table gives no
    rows. Texts are scanned whole, in time that grows with their length and the
    number of detections, not with its square.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    listed = rules()
    gate = gate_pattern({r["keyword"] for r in listed})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    plain = docs.select(row.alias("row"), F.concat(F.lit(" "), F.trim(F.regexp_replace(text_or_empty(F.col(text)), GAP, " ")), F.lit(" ")).alias("words"))
    gated = plain.select(
        "row",
        F.when(F.col("words") == "  ", 0).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
        F.when(F.col("words").rlike(f"(?i) {gate}"), F.translate("words", UPPER, LOWER)).alias("words"),
    )
    empty = F.array().cast(f"array<{HIT}>")
    scanned = gated.select("row", "n_words", F.when(F.col("words").isNotNull(), F.flatten(F.transform(_matches("words", listed), _places))).otherwise(empty).alias("hits"))
    settled = scanned.select("row", "n_words", F.filter("hits", lambda d: d["base"]).alias("base"), F.when(F.size("hits") > 0, _settled(F.col("hits"))).otherwise(empty).alias("detections"))
    certainty = F.create_map(*[F.lit(x) for kv in CERTAINTY.items() for x in kv])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    return settled.select(
        "row.*",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        names("base").alias("base_labels"),
        names("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: F.element_at(certainty, d["priority"]))), F.lit(0.0)).alias("score"),
        "detections",
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """The scan of every row of ``documents``; see :func:`scan_licenses` for nulls,
    empty texts and repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "detections")
