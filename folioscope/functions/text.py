"""Text columns: normalisation, tokens, shingles, hashes, tolerant parsing. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin-1 characters that stand for mis-decoded Cyrillic ones, and what they are repaired to.
BROKEN, REPAIRED = "ÐðÖöÞþ", "РрЦцЮю"
#: White space as str.split() has it, which includes the separators U+001C to U+001F.
SPACES = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"[\p{L}\p{N}_]+"
#: What becomes one space: a run of SPACES, unless it is one plain space already, which most are.
RUNS = SPACES.replace(r"\x1C-\x20", r"\x1C-\x1F").removesuffix("+") + SPACES.removesuffix("+") + "*| " + SPACES


def normalize_text(text: Column) -> Column:
    """Repaired, lower-cased, yo written as ye, every run of white space one space, none at the ends."""
    lowered = F.replace(F.lower(F.translate(text, BROKEN, REPAIRED)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(lowered, RUNS, " "))


def is_blank(text: Column) -> Column:
    """Whether normalize_text() leaves nothing of a text, without making it."""
    return ~text.rlike(SPACES.replace("[", "[^", 1).removesuffix("+"))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscores of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD.removesuffix("+") + "{%d,}" % least), F.lit(0))


def word_shingles(words: Column, size: int = 5) -> Column:
    """Every ``size`` consecutive words joined by spaces; none of a shorter list."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, windows).otherwise(F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def binary_hash(text: Column) -> Column:
    """text_hash() in 20 bytes, for what is shuffled; hex_of() gives the text."""
    return F.unhex(text_hash(text))


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """The prefix and 16 hex digits of the SHA-1 of the parts joined by |."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(prefix), F.substring(text_hash(F.concat_ws("|", *columns)), 1, 16))


def safe_double(text: Column, missing: float | None = 0.0) -> Column:
    """A number with a comma or a point; ``missing`` (or null) for anything else."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return value if missing is None else F.coalesce(value, F.lit(missing))


def safe_int(text: Column) -> Column:
    """safe_double() cut to whole numbers, towards zero."""
    return safe_double(text).cast("bigint")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def excel_date(serial: Column) -> Column:
    """The day of a spreadsheet's serial number (day 0 is 1899-12-30)."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def page_ranges(text: Column) -> Column:
    """The distinct page numbers of "1;3-5", sorted; parts that are no range are left out."""
    def pages(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        low, high = ends[0].try_cast("int"), F.try_element_at(ends, F.size(ends)).try_cast("int")
        return F.when(low.isNotNull() & high.isNotNull() & (low <= high) & (F.size(ends) <= 2), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, "[;,]"), pages))))


def quoted_name(text: Column) -> Column:
    """What stands between the first pair of quotation marks; empty without."""
    return F.regexp_extract(text, "[«\"“]([^»\"”]+)[»\"”]", 1)


def archive_id(text: Column) -> Column:
    """An object's id as NNNN_YY from its number and year in one text (12345, 123_2045, 123.0); empty where there is none."""
    raw = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.0$", "")
    parts = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
    flat = digits(raw)
    wide = lambda n: F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0"))
    made = lambda number, year: F.concat(wide(number.try_cast("bigint").cast("string")), F.lit("_"), F.lpad(year, 2, "0"))
    split = F.contains(raw, F.lit("_")) & (F.size(parts) >= 2)
    by_parts = made(F.try_element_at(parts, F.lit(1)), F.pmod(F.try_element_at(parts, F.lit(-1)).try_cast("bigint"), F.lit(100)).cast("string"))
    by_place = made(F.substring(flat, F.lit(1), F.length(flat) - 2), F.substring(flat, -2, 2))
    return F.when(split, by_parts).when(F.length(flat) >= 3, by_place).otherwise("")


#: Legal forms of organisations, with what they are found by.
LEGAL_FORMS = (("ПАО", r"(?<![\p{L}\p{N}_])пао(?![\p{L}\p{N}_])"), ("ОАО", r"(?<![\p{L}\p{N}_])оао(?![\p{L}\p{N}_])"), ("ЗАО", r"(?<![\p{L}\p{N}_])зао(?![\p{L}\p{N}_])"), ("ООО", r"(?<![\p{L}\p{N}_])(ооо|000)(?![\p{L}\p{N}_])|общество с ограниченной ответственностью"), ("АО", r"(?<![\p{L}\p{N}_])ао(?![\p{L}\p{N}_])|акционерное общество"), ("ИП", r"(?<![\p{L}\p{N}_])ип(?![\p{L}\p{N}_])"))


def legal_form(text: Column) -> Column:
    """The first legal form that an organisation's name holds; empty without."""
    low = normalize_text(text)
    out = F.when(F.lit(False), "")
    for name, pattern in LEGAL_FORMS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("")


def file_url(path: Column) -> Column:
    """A file's path as a file URL."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.concat(F.when(slashed.startswith("/"), "file://").otherwise("file:///"), F.replace(F.replace(F.url_encode(slashed), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def signature_areas(source: Column) -> Column:
    """The areas of a page signature's groups (...|groups:name:count:area:...;...) as a map from name to area."""
    groups = F.split(F.when(F.contains(source, F.lit("|groups:")), F.substring_index(source, "|groups:", -1)).otherwise(""), ";")
    parts = F.filter(F.transform(groups, lambda g: F.split(g, ":")), lambda p: F.size(p) >= 3)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(p[0], safe_double(p[2]))))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
