"""Language policy: script families, plausibility, and what language a document is in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Code-point ranges of script families, and the languages each makes plausible.
SCRIPTS = {
    "cjk": r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "greek": r"\x{0370}-\x{03FF}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
}
PLAUSIBLE = {
    "cjk": ("zh", "ja", "ko"),
    "cyrillic": ("ru", "uk", "bg", "sr", "mk", "be"),
    "arabic": ("ar", "fa", "ps", "ur"),
    "greek": ("el",),
    "hebrew": ("he",),
    "devanagari": ("hi", "mr", "ne"),
    "thai": ("th",),
}
IMPLAUSIBLE = ("la", "eo", "vo")
MIN_CHARS, MIN_CONFIDENCE, MIN_SHARE = 40, 0.7, 0.15


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def script_family(text: Column) -> Column:
    """The family with most letters if it has a significant share of all; ties go to the one met first. Null for Latin or mixed text."""
    counted = F.array(
        *[
            F.struct(
                F.regexp_count(text, F.lit(rf"[\p{{L}}&&[{ranges}]]")).alias("n"),
                (-F.regexp_instr(text, F.lit(rf"[\p{{L}}&&[{ranges}]]"))).alias("first"),
                F.lit(name).alias("family"),
            )
            for name, ranges in SCRIPTS.items()
        ]
    )
    # The family is decided by its count, then by the earlier first letter.
    best = F.array_max(F.filter(counted, lambda c: c["n"] > 0))
    found = F.when(best["n"] / letters(text) >= MIN_SHARE, best["family"])
    # One look for any of the scripts spares most texts the counts.
    return F.when(text.rlike(f"[{''.join(SCRIPTS.values())}]"), found)


def is_plausible(code: Column, family: Column) -> Column:
    """Whether a detected code goes with the text's script family (null: any)."""
    table = F.create_map(*[x for name, codes in PLAUSIBLE.items() for x in (F.lit(name), F.array(*map(F.lit, codes)))])
    return ~code.isin(*IMPLAUSIBLE) & (family.isNull() | F.coalesce(F.array_contains(F.try_element_at(table, family), code), F.lit(False)))


def declared(meta: Column) -> Column:
    """The first language of the metadata, or null if there is none."""
    m = strip(F.coalesce(meta, F.lit("")))
    return F.when(m != "", strip(F.split_part(m, F.lit(","), F.lit(1))))


def decision(meta: Column, text: Column, code: Column, confidence: Column) -> Column:
    """(lang, flag): the metadata's language without a flag; a detected one that is long, sure and
    plausible enough; else English, assumed."""
    bare = strip(F.coalesce(text, F.lit("")))
    accepted = (F.length(bare) >= MIN_CHARS) & (confidence >= MIN_CONFIDENCE) & is_plausible(code, script_family(bare))
    return (
        F.when(declared(meta).isNotNull(), F.struct(declared(meta).alias("lang"), F.lit(None).cast("string").alias("flag")))
        .when(F.coalesce(accepted, F.lit(False)), F.struct(code.alias("lang"), F.lit("LANG_DETECTED").alias("flag")))
        .otherwise(F.struct(F.lit("en").alias("lang"), F.lit("LANG_ASSUMED").alias("flag")))
    )
