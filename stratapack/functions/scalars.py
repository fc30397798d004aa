"""Scalar functions of the archiver as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of data that is compressed already.
PRECOMPRESSED = {
    "video": ["mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "mpg", "mpeg", "3gp", "ts"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "avif"],
    "audio": ["mp3", "aac", "ogg", "opus", "m4a", "flac", "wma"],
    "archive": ["zip", "7z", "rar", "gz", "tgz", "bz2", "tbz", "xz", "zst", "br", "lz4", "lzma", "cab"],
    "document": ["pdf", "docx", "xlsx", "pptx", "apk", "jar", "epub", "crx", "whl"],
}
# Mode numbers, Brotli levels, deflate levels, format extensions.
MODE_IDS = {"ultra": 0, "max": 1, "fast": 2, "store": 3}
BROTLI = {"ultra": 11, "max": 9, "fast": 6}
LEVELS = {"store": 0, "fast": 6, "max": 9, "ultra": 9}
FORMAT_EXT = {"drk": ".drk", "zip": ".zip", "7z": ".7z", "rar": ".rar"}
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def _pick(key: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in reversed(list(table.items())):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def ext_of(path: Column) -> Column:
    """Lower-cased extension without the dot, or ''."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_precompressed(path: Column) -> Column:
    return ext_of(path).isin([x for group in PRECOMPRESSED.values() for x in group])


def is_archive_name(path: Column) -> Column:
    return path.rlike(r"(?i)\.drk$")


def permission_bits(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o777))


def mode_id(mode: Column) -> Column:
    return _pick(mode, MODE_IDS, MODE_IDS["ultra"])


def mode_name(number: Column) -> Column:
    return _pick(number, {v: k for k, v in MODE_IDS.items()}, "ultra")


def mode_level(mode: Column) -> Column:
    return _pick(mode, LEVELS, 9)


def deflate_level(level: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(9), level))


def rar_level(level: Column) -> Column:
    return F.least(level, F.lit(5))


def ratio_mode(ratio: Column) -> Column:
    return F.when(ratio <= 1, "store").when(ratio <= 3, "fast").when(ratio <= 6, "max").otherwise("ultra")


def factor(raw: Column, comp: Column) -> Column:
    return F.when(comp <= 0, F.lit(float("inf"))).otherwise(raw.cast("double") / F.when(comp > 0, comp.cast("double")))


def saved_percent(raw: Column, comp: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise((1 - comp.cast("double") / F.when(raw != 0, raw.cast("double"))) * 100)


def percentage(part: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(part.cast("double") / F.when(total > 0, total.cast("double")) * 100)


def humanize_bytes(n: Column) -> Column:
    """'0 B', '1.00 KB', '100 KB': two decimals below 100 of a unit, else whole; halves up, in integers throughout."""
    n = n.cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i in range(1, len(UNITS)):
        bits = 10 * i
        whole, rest = F.shiftright(n, bits), n.bitwiseAND(F.lit((1 << bits) - 1))
        low = max(0, bits - 50)  # bits that are beyond what 64 have room for
        hundredths = whole * 100 + F.shiftright(F.shiftright(rest, low) * 200 + F.lit(1 << (bits - low)), bits - low + 1)
        decimals = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad(F.pmod(hundredths, F.lit(100)).cast("string"), 2, "0"))
        rounded = (whole + F.shiftright(rest, bits - 1)).cast("string")
        out = F.when(n >= 1 << bits, F.concat(F.when(whole >= 100, rounded).otherwise(decimals), F.lit(f" {UNITS[i]}"))).otherwise(out)
    return out


def humanize_rate(n: Column) -> Column:
    return F.concat(humanize_bytes(n), F.lit("/s"))


def elapsed(ms: Column) -> Column:
    """'999ms', '1.0s', '1m 60s': of whole milliseconds; tenths and seconds are rounded, minutes are not."""
    ms = ms.cast("bigint")
    tenths = F.floor((ms + 50) / 100)
    rest = F.floor((F.pmod(ms, F.lit(60_000)) + 500) / 1000)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("s"))
    long = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, short).otherwise(long)


def compress_note(saved: Column, precompressed_share: Column) -> Column:
    """Null from 3 % on, else why so little was saved."""
    packed = "already compressed: media and archives hardly shrink further, and were stored as they are"
    dense = "near maximum density: the data looks random, encrypted or packed"
    return F.when(saved >= 3, F.lit(None).cast("string")).when(precompressed_share >= 0.5, packed).when(saved <= 0.5, dense).otherwise("low compressibility: little redundant data to remove")


def default_name(target: Column, fmt: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(target, r"[/\\]$", ""), r"[/\\]"), -1)
    return F.concat(F.when(base == "", "archive").otherwise(base), _pick(fmt, FORMAT_EXT, ".drk"))


def strip_known_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(drk|zip|7z|rar)$", "")


def extract_dir_name(path: Column) -> Column:
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.concat(F.regexp_replace(base, r"(?i)\.drk$", ""), F.lit("_extracted"))


def progress_bar(pct: Column, width: int = 28) -> Column:
    filled = F.greatest(F.lit(0), F.floor(pct / 100 * width + 0.5).cast("int"))
    empty = F.greatest(F.lit(0), F.lit(width) - filled)
    shown = F.floor(pct + 0.5).cast("string")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), empty), F.lit("] "), F.when(F.length(shown) < 3, F.lpad(shown, 3, " ")).otherwise(shown), F.lit("%"))


def last_percentage(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3})%"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def entry_bytes(rel_path: Column) -> Column:
    return F.octet_length(rel_path) + 26
