"""Column expressions over Japanese listing text: prices, areas, years, addresses."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proplytics.sources.dimensions import PREFECTURE_NAMES, PREFECTURES

FULL_WIDTH_DIGITS = "".join(chr(c) for c in range(0xFF10, 0xFF1A))
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

# First year of each era is base + 1
ERA_BASE = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}

# Words of the vacant-house dialect
FREE_WORDS = "無料|無償|0円|譲渡"
UNDECIDED_WORDS = "未定|要相談|応相談|お問[い合]合わせ"

KANJI_DIGITS = "〇一二三四五六七八九"
KANJI_UNITS = {"十": 10, "百": 100, "千": 1000}
KANJI_NUMERALS = KANJI_DIGITS + "".join(KANJI_UNITS)


def ascii_digits(c: Column) -> Column:
    """Full-width digits as ASCII, so that the regex class \\d finds them."""
    return F.translate(c, FULL_WIDTH_DIGITS, "0123456789")


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null (not empty) where the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _long(c: Column, pattern: str, group: int = 1) -> Column:
    return first_group(c, pattern, group).try_cast("bigint")


def _strip(c: Column, drop: str) -> Column:
    """ASCII digits, and the characters of ``drop`` gone, in one pass over the text."""
    return F.translate(c, FULL_WIDTH_DIGITS + drop, "0123456789")


def _scaled_price(text: Column, oku: str, man: str, *plain: str) -> Column:
    """Yen from 億/万 amounts, else the first plain pattern that matches."""
    oku_part = _long(text, oku, 1)
    oku_man = F.coalesce(_long(text, oku, 2), F.lit(0).cast("bigint"))
    # most prices hold neither unit, or only 万: look for the character before the pattern
    tries = [
        F.when(text.contains("億"), oku_part * 100_000_000 + oku_man * 10_000),
        F.when(text.contains("万"), _long(text, man) * 10_000),
    ]
    tries += [_long(text, p) for p in plain]
    return F.coalesce(*tries)


def parse_price_portal(c: Column) -> Column:
    """Price text of the three commercial portals. ``1.5万円`` reads as 5万, as there."""
    text = _strip(c, ", 　")
    return _scaled_price(text, r"(\d+)億(?:(\d+)万)?円?", r"(\d+)万円?", r"(\d{4,})円")


def parse_price_akiya(c: Column, strict: bool = False) -> Column:
    """Vacant-house price text; free words come first, so ``1500000円`` (holding ``0円``) is 0.

    ``strict=True`` asks for a ``0円`` that no digit precedes.
    """
    text = F.trim(_strip(c, ", 　"))
    free = FREE_WORDS.replace("0円", r"(?<!\d)0円") if strict else FREE_WORDS
    amount = _scaled_price(
        text, r"(\d+)\s*億(?:\s*(\d+)\s*万)?円?", r"(\d+)\s*万\s*円?", r"(\d{3,})円", r"(\d{4,})"
    )
    return (
        F.when(text.rlike(free), F.lit(0).cast("bigint"))
        .when(text.rlike(UNDECIDED_WORDS), F.lit(None).cast("bigint"))
        .otherwise(amount)
    )


def parse_price_auction(c: Column) -> Column:
    """Court auction price text: also bare digits and full-width commas."""
    text = _strip(c, ",， 　")
    return _scaled_price(text, r"(\d+)億(?:(\d+)万)?円?", r"(\d+)万円?", r"(\d{4,})円", r"(\d{4,})")


def parse_price(source: Column, c: Column) -> Column:
    return (
        F.when(source == "akiya", parse_price_akiya(c))
        .when(source == "bit", parse_price_auction(c))
        .otherwise(parse_price_portal(c))
    )


def _double(c: Column) -> Column:
    return F.translate(c, ",", "").try_cast("double")


def parse_area_portal(c: Column) -> Column:
    """Square metres; thousands are not understood (``1,234.5㎡`` is 234.5)."""
    return first_group(ascii_digits(c), r"([\d.]+)\s*[m㎡²]").try_cast("double")


def parse_area_akiya(c: Column) -> Column:
    return _double(first_group(ascii_digits(c), r"([\d,.]+)\s*[m㎡²]"))


def parse_area_auction(c: Column) -> Column:
    return first_group(_strip(c, ","), r"([\d.]+)\s*(?:m[²2]|㎡|平米|平方メートル)").try_cast("double")


def parse_area(source: Column, c: Column) -> Column:
    return (
        F.when(source == "akiya", parse_area_akiya(c))
        .when(source == "bit", parse_area_auction(c))
        .otherwise(parse_area_portal(c))
    )


def _era_years(text: Column, eras: list[str]) -> list[Column]:
    return [(F.lit(ERA_BASE[e]) + first_group(text, rf"{e}(\d+)年").try_cast("int")) for e in eras]


def parse_year_portal(c: Column) -> Column:
    """Four digits before 年 unchecked, else 令和/平成/昭和/大正 in that order."""
    text = ascii_digits(c)
    western = first_group(text, r"(\d{4})年").try_cast("int")
    return F.coalesce(western, *_era_years(text, ["令和", "平成", "昭和", "大正"]))


def _sane_year(text: Column, pattern: str) -> Column:
    year = first_group(text, pattern).try_cast("int")
    return F.when(year.between(1868, 2100), year)


def era_to_year(c: Column, spaces: bool = False, closed: bool = False) -> Column:
    """Western year of the first era date in the text; 元年 is not a number and gives null."""
    gap = r"\s*" if spaces else ""
    end = "年" if closed else "年?"
    pattern = rf"(令和|平成|昭和|大正|明治){gap}(\d+){gap}{end}"
    text = ascii_digits(c)
    era, number = F.regexp_extract(text, pattern, 1), first_group(text, pattern, 2).try_cast("int")
    bases = F.create_map(*[F.lit(x) for pair in ERA_BASE.items() for x in pair])
    return F.try_element_at(bases, era) + number


def parse_year_akiya(c: Column) -> Column:
    return F.coalesce(_sane_year(ascii_digits(c), r"(\d{4})\s*年"), era_to_year(c, spaces=True, closed=True))


def parse_year_auction(c: Column) -> Column:
    text = ascii_digits(c)
    return F.coalesce(_sane_year(text, r"(\d{4})年"), *_era_years(text, list(ERA_BASE)))


def parse_year(source: Column, c: Column) -> Column:
    return (
        F.when(source == "akiya", parse_year_akiya(c))
        .when(source == "bit", parse_year_auction(c))
        .otherwise(parse_year_portal(c))
    )


def parse_float(c: Column) -> Column:
    """First number; thousands commas end it, as on the portals."""
    return first_group(ascii_digits(c), r"([\d.]+)").try_cast("double")


def parse_float_commas(c: Column) -> Column:
    """First number with thousands commas dropped (vacant houses)."""
    return _double(first_group(ascii_digits(c), r"([\d,.]+)"))


def parse_float_auction(c: Column) -> Column:
    return first_group(_strip(c, ","), r"([\d.]+)").try_cast("double")


def parse_int(c: Column) -> Column:
    return first_group(ascii_digits(c), r"(\d+)").try_cast("int")


def parse_floors(c: Column) -> Column:
    return first_group(ascii_digits(c), r"(\d+)\s*階").try_cast("int")


# --- addresses -------------------------------------------------------------

PORTAL_PREFECTURE = r"^(東京都|北海道|(?:大阪|京都)府|.{2,3}県)"


def prefecture_portal(c: Column) -> Column:
    return first_group(c, PORTAL_PREFECTURE)


def municipality_portal(c: Column) -> Column:
    return first_group(c, PORTAL_PREFECTURE + r"(.+?[市区町村郡])", 2)


def prefecture_akiya(c: Column) -> Column:
    return first_group(c, r"^(北海道|.{2,3}[都道府県])")


def municipality_akiya(c: Column) -> Column:
    """Text up to the first 市区町村郡 after the first 都道府県 (京都府京都市 gives 府京都市)."""
    return first_group(c, r"[都道府県](.*?[市区町村郡])")


def municipality_auction(c: Column) -> Column:
    return first_group(c, PORTAL_PREFECTURE + r"((?:[^市区町村郡]+?[市区町村郡](?:[^市区町村]+?[市区町村])?))?", 2)


def extract_prefecture(c: Column) -> Column:
    """One of the 47 names at the start of the address."""
    return first_group(c, "^(" + "|".join(PREFECTURE_NAMES) + ")")


def prefecture_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for p in PREFECTURES for x in (p[1], p[0])])
    return F.try_element_at(codes, name)


def normalize_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space to half width (JVM side)."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


@F.pandas_udf(StringType())
def normalize_nfkc(texts: pd.Series) -> pd.Series:
    """Full NFKC where compatibility forms beyond full-width ASCII matter."""
    return texts.str.normalize("NFKC")


def kanji_to_arabic(c: Column) -> Column:
    """Each run of kanji numerals becomes its value; a run worth zero stays as it is."""
    run = f"[{KANJI_NUMERALS}]+"

    def step(acc: Column, ch: Column) -> Column:
        digit = F.instr(F.lit(KANJI_DIGITS), ch) - 1
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        held = F.greatest(acc["held"], F.lit(1))
        return F.struct(
            F.when(unit.isNull(), acc["total"]).otherwise(acc["total"] + held * unit).cast("bigint").alias("total"),
            F.when(unit.isNull(), digit).otherwise(0).cast("bigint").alias("held"),
        )

    def done(acc: Column) -> Column:
        worth = acc["total"] + acc["held"]
        return F.when(worth > 0, worth.cast("string"))

    def value(segment: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("held"))
        number = F.aggregate(F.split(segment, ""), start, step, done)
        return F.coalesce(F.when(segment.rlike(f"^{run}$"), number), segment)

    segments = F.regexp_extract_all(c, F.lit(f"({run}|[^{KANJI_NUMERALS}]+)"), 1)
    # only the rows that hold a numeral pay for the array round trip
    return F.when(c.rlike(run), F.array_join(F.transform(segments, value), "")).otherwise(c)


def normalize_address(c: Column) -> Column:
    """Canonical block notation for matching: widths, numerals, 丁目番号, dashes, building cut."""
    text = F.regexp_replace(normalize_width(F.coalesce(c, F.lit(""))), r"\s+", "")
    text = kanji_to_arabic(text)
    text = F.regexp_replace(text, r"(\d+)丁目(\d+)番地?(\d+)号?", "$1-$2-$3")
    text = F.regexp_replace(text, r"(\d+)丁目(\d+)番地?", "$1-$2")
    text = F.translate(text, "ー‐−―", "----")
    # where a digit is followed by other text, cut after the last digit (one pass, so ``text`` is built once)
    return F.regexp_replace(text, r"^(?=.*\d[^\d\-])(.*\d)\D*$", "$1")


def simplify_address(c: Column) -> Column:
    """Address without brackets, room, floor and building, for a second gazetteer try."""
    space = r"[\s　]"
    text = F.regexp_replace(c, r"[（(].*?[）)]", "")
    text = F.regexp_replace(text, space + r"*\d+号室.*$", "")
    text = F.regexp_replace(text, space + r"*\d+F.*$", "")
    text = F.regexp_replace(text, r"(\d+-\d+-\d+)" + space + r"+.*$", "$1")
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def has_control_space(c: Column) -> Column:
    return c.rlike(r"[\n\r\t]")


def clean_whitespace(c: Column) -> Column:
    """Collapse whitespace of the rows that hold a newline or tab; leave others alone."""
    return F.when(has_control_space(c), F.trim(F.regexp_replace(c, r"\s+", " "))).otherwise(c)


def bigrams(c: Column) -> Column:
    """Distinct character pairs; a text of one character is its own token, an empty one has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))
    return (
        F.when(F.length(c) >= 2, F.array_distinct(pairs))
        .when(F.length(c) == 1, F.array(c))
        .otherwise(F.array().cast("array<string>"))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Share of common bigrams: 1 for equal texts, 0 when one is empty."""
    x, y = bigrams(a), bigrams(b)
    shared = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        shared / F.size(F.array_union(x, y))
    )


def truncate(c: Column, limit: int = 5000) -> Column:
    return F.substring(c, 1, limit)


# Stored file extension per image content type
IMAGE_EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/webp": ".webp",
    "image/gif": ".gif",
    "image/avif": ".avif",
}


def storage_path(property_id: Column, ordinal: Column, content_type: Column) -> Column:
    """Object path of an image: properties/{id}/{ordinal}{extension}, .jpg by default."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    table = F.create_map(*[F.lit(x) for pair in IMAGE_EXTENSIONS.items() for x in pair])
    extension = F.coalesce(F.try_element_at(table, kind), F.lit(".jpg"))
    return F.concat(F.lit("properties/"), property_id.cast("string"), F.lit("/"), ordinal.cast("string"), extension)


def risk_label(c: Column) -> Column:
    """very_high → Very High."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def merge_pairs(first: Column, second: Column) -> Column:
    """Union of two label → value maps: the second wins a shared label, blank values are dropped."""
    blank = F.lit("")
    both = F.map_zip_with(first, second, lambda _, a, b: F.coalesce(F.nullif(b, blank), F.nullif(a, blank)))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def distinct_capped(values: Column, limit: int) -> Column:
    """Distinct values in order of first appearance, at most ``limit`` of them."""
    return F.slice(F.array_distinct(values), 1, limit)
