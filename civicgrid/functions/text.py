"""Text rules as column expressions over whole texts.

A word character is a letter, a digit or an underscore; vowel signs of Indic scripts are not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import CATEGORIES
from .emergency_text import contains_any, emergency_label  # noqa: F401
from .rounding import portable_round

WORD = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
EDGE_MARKS = r"^[.,!?;:]+|[.,!?;:]+$"


def quoted(words) -> str:
    """Alternation of literal words, longest first."""
    return "|".join("\\Q" + w + "\\E" for w in sorted(words, key=len, reverse=True))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    t = F.regexp_replace(text, rf"(?iu){START}(?:{quoted(vocab.FILLERS)}){END}", " ")
    for target in dict.fromkeys(vocab.SPELLINGS.values()):
        variants = [w for w, right in vocab.SPELLINGS.items() if right == target]
        t = F.regexp_replace(t, rf"(?iu){START}(?:{quoted(variants)}){END}", target)
    return strip_space(F.regexp_replace(t, rf"{SPACE}+", " "))


def hits(text: Column, words) -> Column:
    """How many of the words occur in the text (a word listed twice counts twice)."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]),
               F.contains(text, F.lit(words[0])).cast("int"))


def detect_language(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    deva = t.rlike(f"[{vocab.DEVANAGARI}]")
    # one pass over the text where it holds none of the other scripts
    script = F.lit(None).cast("string")
    for code, block in reversed(vocab.OTHER_SCRIPTS):
        script = F.when(t.rlike(f"[{block}]"), code).otherwise(script)
    other = t.rlike("[" + "".join(block for _, block in vocab.OTHER_SCRIPTS) + "]")
    return (
        F.when(~t.rlike(f"[^{SPACE[1:]}"), "en").when(other, script)
        .when(deva & t.rlike("[a-zA-Z]{2,}"), "mixed")
        .when(deva & (hits(t, vocab.MARATHI) > hits(t, vocab.HINDI)), "mr-Deva")
        .when(deva, "hi-Deva")
        .when(contains_any(low, vocab.HINDI_LATIN), "hi-Latn").otherwise("en")
    )


def supported_language(language: Column) -> Column:
    return language.isin(*vocab.SUPPORTED)


def _shared_hits(low: Column, words) -> Column:
    """``hits`` that looks for the Devanagari words only in texts with a letter of that script."""
    deva = [w for w in words if re.search(f"[{vocab.DEVANAGARI}]", w)]
    latin = [w for w in words if w not in deva]
    found = F.when(low.rlike(f"[{vocab.DEVANAGARI}]"), hits(low, deva)).otherwise(0) if deva else F.lit(0)
    return found + hits(low, latin) if latin else found


def category_of(low: Column) -> Column:
    """Category with the most keyword hits in lower-cased text; the earlier category wins ties; no hit gives NULL.

    Hits and place in the order are one number, which stands here once: its remainder names the category.
    """
    n = len(CATEGORIES)
    counts = [_shared_hits(low, [w.lower() for w in vocab.CATEGORY_WORDS[c]]) for c in CATEGORIES]
    most = F.greatest(*[x * n + (n - 1 - i) for i, x in enumerate(counts)])
    names = [None] * n + list(reversed(CATEGORIES)) * max(len(vocab.CATEGORY_WORDS[c]) for c in CATEGORIES)
    return F.get(F.array(*[F.lit(c).cast("string") for c in names]), most)


def extract_category(text: Column) -> Column:
    """Category with the most keyword hits; the earlier category wins ties; no hit gives NULL."""
    return category_of(F.lower(text))


def severity_of(low: Column, duplicates: Column) -> Column:
    high = contains_any(low, vocab.SEVERITY_HIGH)
    return (
        F.when((F.coalesce(duplicates, F.lit(0)) > 5) | high, "high")
        .when(contains_any(low, vocab.SEVERITY_LOW), "low").otherwise("medium"))


def extract_severity(text: Column, duplicates: Column) -> Column:
    return severity_of(F.lower(text), duplicates)


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, EDGE_MARKS, "")


def _looks_like_place(token: Column) -> Column:
    word = _bare(token)
    noise = sorted({*vocab.PHRASE_NOISE, *vocab.DOMAIN_NOISE})
    latin = word.rlike("^[A-Z][a-zA-Z]{2,}$")
    deva = word.rlike(f"^[{vocab.DEVANAGARI}]+$") & ~word.isin(*vocab.DEVANAGARI_STOPWORDS) & (F.length(word) >= 3)
    return (word != "") & ~F.lower(word).isin(*noise) & (latin | deva)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def _clean_phrase(phrase: Column) -> Column:
    kept = F.filter(_tokens(phrase), lambda w: ~F.lower(_bare(w)).isin(*vocab.PHRASE_NOISE))
    joined = F.array_join(kept, " ")
    return F.when(joined == "", phrase).otherwise(joined)


def with_location_phrase(df: DataFrame, text: str, name: str = "location_raw") -> DataFrame:
    """Most likely place name: the best window around a trigger word, else a capitalised run, else a first word that
    looks like a name, else an unusual Devanagari word, else the first trigger window as it stands.

    The word list and the windows are columns of their own, so a long text is split once and not once per window.
    """
    t, words = F.col(text), F.col("_words")
    staged = df.withColumn("_words", _tokens(t))
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    trigger = F.filter(indexed, lambda x: F.lower(_bare(x["w"])).isin(*vocab.TRIGGERS))

    def window(x: Column) -> Column:
        first = F.greatest(x["i"] - 2, F.lit(0))
        part = F.array_join(F.slice(words, first + 1, x["i"] + 4 - first), " ")
        phrase = F.regexp_replace(part, r"^[.,!?;: ]+|[.,!?;: ]+$", "")
        return F.struct((-x["i"]).alias("pos"), phrase.alias("phrase"))

    staged = staged.withColumn("_windows", F.filter(F.transform(trigger, window), lambda x: x["phrase"] != ""))
    staged = staged.withColumn("_windows", F.transform(
        "_windows", lambda x: F.struct(x["pos"].alias("pos"), _clean_phrase(x["phrase"]).alias("cleaned"))))
    staged = staged.withColumn("_windows", F.transform("_windows", lambda x: F.struct(
        x["pos"].alias("pos"), x["cleaned"].alias("cleaned"), _tokens(x["cleaned"]).alias("tokens"))))
    staged = staged.withColumn("_windows", F.transform("_windows", lambda x: F.struct(
        x["pos"].alias("pos"), x["cleaned"].alias("cleaned"), F.size(x["tokens"]).alias("n"),
        F.filter(x["tokens"], _looks_like_place).alias("names"))))
    scored = F.transform(
        F.filter("_windows", lambda x: F.size(x["names"]) > 0),
        lambda x: F.struct((-x["n"]).alias("score"), x["pos"].alias("pos"), F.array_join(x["names"], " ").alias("names")))
    strong = F.array_max(scored)["names"]
    weak = F.try_element_at(F.col("_windows"), F.lit(1))["cleaned"]
    run = F.nullif(F.regexp_extract(t, r"(?<!\A)(?<!\. )([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1), F.lit(""))
    first = F.try_element_at(words, F.lit(1))
    opening = F.when(first.rlike("^[A-Z][a-z]{2,}$") & ~F.lower(first).isin(*vocab.PHRASE_NOISE), first)
    unusual = F.filter(
        F.regexp_extract_all(t, F.lit(f"([{vocab.DEVANAGARI}]+)"), 1),
        lambda w: ~w.isin(*vocab.DEVANAGARI_STOPWORDS) & (F.length(w) >= 3))
    found = F.coalesce(strong, _clean_phrase(run), opening, F.try_element_at(unusual, F.lit(1)), weak)
    return staged.withColumn(name, found).drop("_words", "_windows")


def self_naming(name_word: str, start: str = START, end: str = END) -> str:
    """Pattern of someone giving one or two names; the three groups are what stays."""
    whose = "|".join(w + r"\s+" for w in vocab.SELF_POSSESSIVE_DEVANAGARI)
    verb = "|".join(r"\s+" + w for w in vocab.SELF_VERB_DEVANAGARI)
    return (rf"((?i:{start}(?:{vocab.SELF_POSSESSIVE}){end})\s+|{whose})"
            rf"((?i:{start}(?:{vocab.SELF_NOUN}){end})|{vocab.SELF_NOUN_DEVANAGARI})"
            rf"((?i:\s+(?:{vocab.SELF_VERB}))|{verb})?\s+{name_word}(?:\s+{name_word})?")


# The look-ahead keeps the verb of a sentence out of the name.
SELF_NAMING = self_naming(rf"(?:[A-Z][a-zA-Z]*|(?!{vocab.NOT_A_NAME})[{vocab.DEVANAGARI}]+)")


def redact(text: Column) -> Column:
    """Mobile numbers, titled names and self-given names out of the analytic copy."""
    phone = vocab.PHONE.replace(r"\b", START, 1).replace(r"\b", END)
    titled = vocab.TITLED_NAME.replace(r"\b", START, 1).replace(r"\b", END)
    t = F.regexp_replace(F.regexp_replace(text, phone, "[PHONE]"), titled, "[NAME]")
    return F.regexp_replace(t, SELF_NAMING, "$1$2$3 [NAME]")


def _literals(pattern: str) -> tuple[list[str], list[str]]:
    """The words that the alternatives of a pattern hold: plain ones, and those that stand between word boundaries."""
    plain, bounded = [], []
    for part in pattern.split("|"):
        found = [part.replace(r"\b", "")]
        if " ?" in found[0]:
            found = [found[0].replace(" ?", x) for x in (" ", "")]
        if ends := re.search(r"\[([^\]]+)\]", found[0]):
            found = [w.replace(ends[0], c) for w in found for c in ends[1]]
        (bounded if r"\b" in part else plain).extend(found)
    return plain, bounded


# Characters that a pattern takes for i, k or s whatever the case, and that lower() does not turn into them alone.
FOLDED = "İıſ\u212a"


def _worded(text: Column, pattern: str) -> Column:
    """``text.rlike("(?iu)" + pattern)`` by substrings of the lower-cased text; the pattern itself runs where those leave it open."""
    low = F.lower(text)
    plain, bounded = _literals(pattern)
    exact = text.rlike("(?iu)" + pattern)
    found = contains_any(low, plain)
    if bounded:
        found = found | (contains_any(low, bounded) & exact)
    for c in FOLDED:
        found = found | (F.contains(text, F.lit(c)) & exact)
    return found


def photo_structure(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(vocab.PHOTO_STRUCTURE.items()):
        out = F.when(_worded(t, pattern), name).otherwise(out)
    return out


def photo_grade(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for name in ("crack", "partial", "collapse"):
        out = F.when(_worded(t, vocab.PHOTO_GRADE[name]), name).otherwise(out)
    return out


def edited_with_software(software: Column) -> Column:
    return F.coalesce(software, F.lit("")).rlike("(?i)" + vocab.EDITING_SOFTWARE)


def road_endpoint_place(raw: Column) -> Column:
    """Place behind a road endpoint: the bracketed name, else the text without its road prefix; road codes give NULL."""
    value = F.trim(raw)
    bracket = F.trim(F.regexp_extract(value, r"\(([^)]+)\)", 1))
    bare = F.trim(F.regexp_replace(value, vocab.ROAD_PREFIX, ""))
    place = F.regexp_replace(F.when(value.rlike(r"\([^)]+\)"), bracket).otherwise(bare), r"^[ .,\-–]+|[ .,\-–]+$", "")
    good = (place != "") & ~place.rlike(vocab.ROAD_REFERENCE) & (F.length(place) >= 3)
    return F.when(good, place)


def last_path_part(label: Column) -> Column:
    return F.trim(F.element_at(F.split(label, "/"), -1))


def before_comma(text: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.trim(text), ","), 1), F.lit(""))


def name_contains(name: Column, needle: str) -> Column:
    return F.contains(F.lower(name), F.lit(needle.lower()))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def intake_errors(c: dict[str, Column]) -> Column:
    """All problems of a form joined by ``; ``, NULL for a clean one.

    ``c``: full_name, gender, mobile, email, address, pincode, district, block, village, department.
    """
    def blank(x: Column) -> Column:
        return F.coalesce(F.trim(x), F.lit("")) == ""

    def bad(x: Column, pattern: str) -> Column:
        return ~F.coalesce(F.trim(x), F.lit("")).rlike(pattern)

    gender = F.lower(F.trim(F.coalesce(c["gender"], F.lit(""))))
    checks = [
        (blank(c["full_name"]), "Name is required"),
        (~gender.isin(*vocab.GENDERS), "Gender must be male, female or transgender"),
        (bad(c["mobile"], vocab.MOBILE), "Mobile must be 10 digits starting 6-9"),
        (bad(c["email"], vocab.EMAIL), "A valid e-mail address is required"),
        (blank(c["address"]), "Address is required"),
        (bad(c["pincode"], vocab.PINCODE), "Pincode must be 6 digits"),
        (blank(c["district"]), "District is required"),
        (blank(c["block"]), "Block is required"),
        (blank(c["village"]), "Village is required"),
        (~blank(c["department"]) & ~F.trim(c["department"]).isin(*vocab.DEPARTMENTS), "Unknown department"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in checks]))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def hex_distance(a: Column, b: Column) -> Column:
    """Differing bits of two equal-length 64-bit hex hashes."""
    def number(x: Column) -> Column:
        return F.conv(x, 16, -10).cast("bigint")

    return F.when(F.length(a) == F.length(b), F.bit_count(number(a).bitwiseXOR(number(b))))


def _looked_up(values: dict[str, float], key: Column, other: float) -> Column:
    """The value of a key that is costly to find, which stands here once."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def language_confidence(language: Column) -> Column:
    return _looked_up(vocab.LANGUAGE_CONFIDENCE, language, 0.15)


def severity_confidence(severity: Column) -> Column:
    return _looked_up({"high": 0.90, "low": 0.85}, severity, 0.70)


def category_confidence(category: Column) -> Column:
    return F.when(category.isNotNull(), 0.90).otherwise(0.30)


def overall_confidence(scores: list[Column]) -> Column:
    """Mean of the field scores, cut by a tenth when more than half are weak."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    low = sum((F.when(s < 0.60, 1).otherwise(0) for s in scores[1:]), F.when(scores[0] < 0.60, 1).otherwise(0))
    return portable_round(mean * F.when(low > len(scores) / 2, 0.90).otherwise(1.0), 2)


def department_category(department: Column) -> Column:
    pairs = [F.lit(x) for pair in vocab.DEPARTMENTS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), department)


def digits_only(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def loose_number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")


def safe_int(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))


def safe_float(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def safe_bool(text: Column) -> Column:
    return safe_int(text) == 1


def amount_and_percent(text: Column) -> tuple[Column, Column]:
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, "&nbsp;", " "), "%", ""))
    pattern = r"^([0-9.]+)(?:\s*\(\s*([0-9.]+)\s*\))?"
    return tuple(
        F.nullif(F.regexp_extract(clean, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
