"""Text predicates and repairs.

Java's \\s and \\d are ASCII unless (?U) is set, and trim() strips blanks alone, so every pattern
here asks for Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, phrases and formats that results depend on.
BULLET = r"(?U)^[•‣◦⁃∙·\-–]\s+"
NUMBERED = r"(?U)^(\d{1,3}|[a-zA-Z])[.\)]\s+"
SPACE = r"[\s\x1c-\x1f]"
#: A list prefix where the stripped text begins with it: something else than space has to follow its blank.
IN_STRIPPED = r"(?U)^[\s\x1c-\x1f]*+{}[\s\x1c-\x1f]*+[^\s\x1c-\x1f]"
WORD_TITLE = r"(?Ui)^Microsoft Word - (.+?)(\.docx?|\.rtf)?$"
FILENAME_ALT = r"(?Ui)^(img|image|pic|picture|photo|graphic|figure)[\s_-]*\d*\.\w+$"
NUMBERED_ALT = r"(?Ui)^(img|image|pic|dsc)[_\s-]?\d+$"
BARE_URL = r"(?Ui)^(https?://|www\.)\S+$"
GENERIC_PHRASES = ("click here", "here", "read more", "more", "link", "learn more", "this link", "more info", "more information")
ALT_PLACEHOLDER = "[ALT TEXT NEEDED: description of image]"
MIME_TYPES = {
    "png": "image/png",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
    "jp2": "image/jp2",
    "jpx": "image/jp2",
    "webp": "image/webp",
}
UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def strip(text: Column) -> Column:
    """Without white space (Unicode, and the four ASCII separators) at either end. Most texts have none there, and aren't searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(rf"(?U){SPACE}"), F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")).otherwise(text)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")


def half_points(size: Column) -> Column:
    """A font size rounded to half points, half to even."""
    return F.bround(size * 2, 0) / 2


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def clean_runs(runs: Column) -> Column:
    """Without empty runs; white space stays."""
    return F.filter(runs, lambda r: r["text"] != "")


def is_bullet(text: Column) -> Column:
    return text.rlike(IN_STRIPPED.format(BULLET.removeprefix("(?U)^").removesuffix("+")))


def is_numbered(text: Column) -> Column:
    return text.rlike(IN_STRIPPED.format(NUMBERED.removeprefix("(?U)^").removesuffix("+")))


def is_list_item(text: Column) -> Column:
    return is_bullet(text) | is_numbered(text)


def strip_list_prefix(text: Column) -> Column:
    """Without a bullet, or else without a number; leading blanks block both."""
    bare = F.regexp_replace(text, BULLET, "")
    return F.when(bare != text, bare).otherwise(F.regexp_replace(text, NUMBERED, ""))


def strip_runs_prefix(runs: Column) -> Column:
    """The runs with the list prefix off the first one, unless that one is linked."""
    first = F.element_at(runs, 1)
    new = first.withField("text", strip_list_prefix(first["text"]))
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when((F.size(runs) > 0) & first["link_href"].isNull(), F.concat(F.array(new), rest)).otherwise(runs)


def is_filename_like(alt: Column) -> Column:
    """Blank, or named like a file or a numbered picture."""
    a = strip(F.coalesce(alt, F.lit("")))
    return (a == "") | a.rlike(FILENAME_ALT) | a.rlike(NUMBERED_ALT)


def generic_reason(link_text: Column) -> Column:
    """Why a link's text says nothing of its purpose: a stock phrase, a bare URL, or null."""
    bare = strip(link_text)
    return F.when(F.lower(bare).isin(*GENERIC_PHRASES), "generic link text").when(bare.rlike(BARE_URL), "a bare URL as link text")


def cleaned_title(title: Column) -> Column:
    """What an editor-generated title holds, or null if it isn't one."""
    inner = strip(F.regexp_extract(strip(title), WORD_TITLE, 1))
    return F.when(strip(title).rlike(WORD_TITLE) & (inner != ""), inner)


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(base.rlike(r"^\.[^.]*$"), base).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))


def sanitised_stem(name: Column) -> Column:
    """A stem that is safe as a file name; "document" if nothing is left."""
    stem = F.btrim(F.regexp_replace(file_stem(name), "[^A-Za-z0-9._ -]+", "_"), F.lit(" ."))
    return F.when(stem == "", "document").otherwise(stem)


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def escaped(text: Column) -> Column:
    """HTML-escaped, quotes included; the ampersand goes first."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def quoted(text: Column) -> Column:
    """Quoted as a Python string literal: single quotes, or double if it holds only single ones."""
    inner = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        inner = F.replace(inner, F.lit(raw), F.lit(shown))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), inner, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), inner, F.lit("'")))
    )


def mime_of(extension: Column) -> Column:
    """The MIME type of a file extension; an unknown one is an image of that name, none is a PNG."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.concat(F.lit("image/"), F.coalesce(extension, F.lit("png"))))


def shortened(text: Column, length: int = 60) -> Column:
    return F.substring(text, 1, length)
