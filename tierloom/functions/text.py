"""Text, label, id and file-name functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GLOSS_PATTERN = "^[A-Z][A-Z0-9_-]+$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def blank(text: Column | str) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def normalise_label(label: Column | str) -> Column:
    """Trim, lower, drop a trailing ``_digits``; null becomes empty."""
    return F.coalesce(F.regexp_replace(F.lower(strip(label)), r"_\d+$", ""), F.lit(""))


def derive_label(reviewed: Column | str, text: Column | str) -> Column:
    """Reviewed text unless it is blank; a null reviewed text stays null."""
    reviewed = _col(reviewed)
    return F.when(strip(reviewed) == "", _col(text)).otherwise(reviewed)


def plain_label(label: Column | str) -> Column:
    """Lower case and trimmed, suffix kept."""
    return F.lower(strip(label))


def normalise_word(word: Column | str) -> Column:
    """Lower case without edge punctuation; letters keep their accents."""
    return F.regexp_replace(F.lower(_col(word)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def tokens(text: Column | str) -> Column:
    """Words between white space, empty ones left out."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def is_gloss(value: Column) -> Column:
    return value.rlike(GLOSS_PATTERN)


# -- ids --------------------------------------------------------------------------

def segment_id(stem: Column | str, start_ms: Column | str) -> Column:
    return F.format_string("%s_%08d", _col(stem).cast("string"), _col(start_ms))


def pairing_id(stem: Column | str, start_ms: Column | str, hand: Column | str,
               tag: Column | None = None) -> Column:
    """``{stem}_{start}_{hand letter}`` and an optional ``_{tag}``."""
    parts = [segment_id(stem, start_ms), F.substring(_col(hand), 1, 1)]
    return F.concat_ws("_", *parts, *([tag] if tag is not None else []))


def parse_pairing_id(pid: Column | str) -> Column:
    """Struct of stem, start_ms, hand and tag; the stem may hold underscores."""
    pattern = r"^(.*)_(\d+)_([rl])(?:_(E|R|C|N|M\d+))?$"

    def group(i: int) -> Column:
        return F.regexp_extract(_col(pid), pattern, i)

    return F.struct(group(1).alias("stem"), group(2).try_cast("long").alias("start_ms"),
                    F.when(group(3) == "r", "right").when(group(3) == "l", "left").alias("hand"),
                    group(4).alias("tag"))


def file_stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


# -- similarity and cue text ------------------------------------------------------

def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters at equal positions, over the longer length."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y),
                            lambda same: same))
    return (F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(equal / F.greatest(F.length(a), F.length(b))))


def text_changed(a: Column, b: Column, threshold: float = 0.80) -> Column:
    return positional_similarity(a, b) < threshold


def clean_recognised(text: Column | str) -> Column:
    """White space collapsed; texts of fewer than two characters become empty."""
    tidy = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return F.when(F.length(tidy) < 2, "").otherwise(tidy)


# -- pages ------------------------------------------------------------------------

def _reference(code: Column) -> Column:
    """Character of a numeric reference; invalid ones follow the HTML rules."""
    windows = F.split(F.lit("\x00".join(
        bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))), "\x00")
    broken = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    silent = (code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
              | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int")))
            .when(broken, "\ufffd").when(silent, "").otherwise(char))


def _entity(piece: Column) -> Column:
    """Decode the entity at the start of a piece that followed an ampersand.

    Names come from the HTML 5 table: with a semicolon any name, without one the longest
    of the old names that may stand so.
    """
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    full = F.nullif(F.regexp_extract(piece, "^([0-9A-Za-z]{1,31};)", 1), F.lit(""))
    short = F.nullif(F.regexp_extract(piece, f"^({old})", 1), F.lit(""))
    number = F.regexp_extract(piece, "^#([xX][0-9A-Fa-f]+|[0-9]+);?", 1)
    bare = F.regexp_replace(number, "^[xX]?0*(?=[0-9A-Fa-f])", "")
    hexadecimal = F.when(F.length(bare) <= 8, F.conv(bare, 16, 10)).otherwise("9999999999")
    digits = F.when(number.rlike("^[xX]"), hexadecimal).otherwise(bare)
    # More digits than any code point has mean an invalid one.
    code = F.when(F.length(digits) > 9, 0x110000).otherwise(digits.try_cast("long"))
    by_full, by_short = F.try_element_at(named, full), F.try_element_at(named, short)
    return (F.when(number != "", F.concat(_reference(code), F.regexp_replace(piece, "^#([xX][0-9A-Fa-f]+|[0-9]+);?", "")))
            .when(by_full.isNotNull(), F.concat(by_full, F.substring(piece, F.length(full) + 1, F.length(piece))))
            .when(by_short.isNotNull(), F.concat(by_short, F.substring(piece, F.length(short) + 1, F.length(piece))))
            .otherwise(F.concat(F.lit("&"), piece)))


def decode_entities(text: Column | str) -> Column:
    """Text with named and numeric HTML entities decoded."""
    text = _col(text)
    pieces = F.split(text, "&")
    decoded = F.concat(F.slice(pieces, 1, 1),
                       F.transform(F.slice(pieces, 2, 2_000_000_000), _entity))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def strip_html(html: Column | str) -> Column:
    """Text of a page: block ends become new lines, tags go, blank lines go."""
    text = F.regexp_replace(_col(html), LINE_ENDS, "\n")
    text = decode_entities(F.regexp_replace(text, ANY_TAG, ""))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), strip)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def video_id(html: Column | str) -> Column:
    """First video id: embedded player, then watch link, then short link."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_col(html), p, 1), F.lit("")) for p in VIDEO_LINKS])


def repair_latin2(text: Column | str) -> Column:
    """Latin-2 text that was read as Latin-1; text with wider characters is left alone."""
    text = _col(text)
    wrong = "".join(chr(b) for b in range(0xA0, 0x100))
    right = bytes(range(0xA0, 0x100)).decode("iso-8859-2")
    return F.when(text.rlike(r"^[\x00-\xFF]*$"), F.translate(text, wrong, right)).otherwise(text)


def clean_title(title: Column | str) -> Column:
    """Title without the leading ``Posunok:``."""
    return F.regexp_replace(_col(title), r"(?iU)^Posunok:\s*", "")


# -- file names and sources -------------------------------------------------------

def angle_by_position(index: Column) -> Column:
    return F.when(index == 1, "side").otherwise("front")


def angle_by_prefix(stem: Column | str) -> Column:
    stem = _col(stem)
    return F.when(stem.startswith("A_"), "front").when(stem.startswith("B_"), "side").otherwise("unknown")


def angle_by_degrees(stem: Column | str) -> Column:
    stem = _col(stem)
    return F.when(stem.contains("_60_"), "front").when(stem.contains("_90_"), "side").otherwise("unknown")


def dictionary_label(name: Column, translation: Column, stem: Column, tag: str) -> Column:
    """Entry name unless it is a number tag (``tag-123``), else translation, else the file stem."""
    tail = F.when(stem.contains("_"), F.regexp_replace(stem, "^[^_]*_", "")).otherwise(stem)
    return plain_label(F.when(~blank_text(name) & ~name.rlike(rf"^{tag}-\d+$"), name)
                       .when(~blank_text(translation), translation).otherwise(tail))


def blank_text(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


# File-name parts that mark a video as not Slovak, one list per language.
HUNGARIAN = [
    "Adathalaszat", "Vasarloero", "Inflacio", "Deflacio", "Koezponti", "Ketlepcsos", "Szemelyes",
    "Penzuegyi", "Szemelyi", "Joevede", "Szemelyazonossag", "Refinanszirozas", "Jelzalog", "Hitel",
    "Lakasbiztositas", "kamat", "Fedezet", "Reszveny", "Befektet", "Koetveny", "Koetvany",
    "Kiegeszito", "Koetelezo", "Magan-fele", "Biztositasi", "Jogi-koelt", "Adossag", "Koeltseg",
    "Kamatlab", "Valtozo", "Tartalek", "Kolcson", "Haztartas", "joevedelem", "Csaladi", "Egyenleg",
    "Vasarlasi", "magatartas", "Ber", "Passziv", "Aktiv", "Tokejoevedelem", "Afa"]
GERMAN = ["die-", "das-", "der-", "einen-", "kreditwuerdig"]
ENGLISH = [
    "income_", "balance_", "bond_", "budget_", "budgeting_", "credit_", "debt_", "household",
    "interest_", "investment_", "legal-", "mutual-", "passive-", "premium_", "private-", "rate_",
    "reserves_", "statutory-", "supplementary-", "variable-", "wage_", "Purchasing-",
    "active-income", "Household-"]
ITALIAN = ["_FS_", "Potere-dacquisto"]
SLOVAK_LETTERS = "áéíóúýčďľňřšťžô"
# Shapes of numbered file names outside the financial vocabulary.
NUMBERED_NAMES = [r"^\d+_\d+_", r"^\d+_\d+\.mp4$", r"^\d{2}-[A-Z]"]
# Marks, beginnings and trades of file names outside the career vocabulary, and what precedes its words.
CAREER_MARKS = ["_DGS", "_dgs"]
CAREER_BEGINNINGS = ["Video-"]
CAREER_TRADES = ["gastgewerbe", "tourismus"]
CAREER_PREFIX = r"^(\d+|0[^-]*)(-|$)"
# Tags that end a line of a page, any tag, and the links that name a video, in the order they are tried.
LINE_ENDS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li)[^>]*>"
ANY_TAG = "<[^>]+>"
VIDEO_LINKS = [r"youtube\.com/embed/([A-Za-z0-9_-]{11})", r"youtube\.com/watch\?v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})"]


def is_financial_vocabulary(name: Column | str) -> Column:
    """A Slovak video of the financial vocabulary, judged by its file name."""
    name = _col(name)
    foreign = "|".join(p.lower() for p in HUNGARIAN + GERMAN + ENGLISH + ITALIAN)
    return ~(F.lower(name).rlike(foreign) | name.rlike("|".join(NUMBERED_NAMES)))


def is_career_vocabulary(name: Column | str) -> Column:
    """A Slovak video of the career vocabulary: its name has dashes and none of the signs of another video.

    Those are the marks and beginnings of other series, underscores alone, trades of another course, and at most
    two dashes before a final 1 without a Slovak letter, which is an English name.
    """
    name = _col(name)
    stem = F.replace(name, F.lit(".mp4"), F.lit(""))
    english = stem.rlike(rf"^(?!.*[{SLOVAK_LETTERS}])[^-]*(-[^-]*){{0,2}}(?<=1)$")
    signs = [*[name.contains(m) for m in CAREER_MARKS], *[name.startswith(b) for b in CAREER_BEGINNINGS],
             F.lower(name).rlike("|".join(CAREER_TRADES)), english]
    # Without a dash a name is out in any case, underscores or not.
    return reduce(lambda seen, sign: seen & ~sign, signs, name.contains("-"))


def label_from_file(name: Column | str, source: Column | str, title: Column | str) -> Column:
    """Label of a vocabulary video, by the rule of its source."""
    name, source, title = _col(name), _col(source), _col(title)
    stem = F.replace(name, F.lit(".mp4"), F.lit(""))
    spaced = strip(F.replace(stem, F.lit("-"), F.lit(" ")))
    parts = F.split(F.replace(title, F.lit("&#8211;"), F.lit("–")), "–")
    words = F.regexp_replace(stem, CAREER_PREFIX, "")
    career = F.when(F.size(parts) >= 2, strip(F.element_at(parts, -1))).otherwise(
        strip(F.replace(words, F.lit("-"), F.lit(" "))))
    return (F.when(source.isin("fin-vocab", "climate-vocabaction"), spaced)
            .when(source == "career-vocab", career).otherwise(stem))


@F.pandas_udf(StringType())
def _ascii_rest(texts: pd.Series) -> pd.Series:
    """ASCII part of the compatible decomposition; Spark has no such function of its own."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def safe_file_name(name: Column | str) -> Column:
    """ASCII file name: accents off, full-width and other compatible letters plain, spaces as underscores, at
    most 80 characters."""
    text = F.regexp_replace(_ascii_rest(strip(name)), r"[^A-Za-z0-9_\s\-.]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"^[_.]+|[_.]+$", "")
    return F.coalesce(F.substring(text, 1, 80), F.lit(""))
