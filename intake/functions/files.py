"""File names, paths, MIME types, container signatures and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CONTAINER_EXTENSIONS = (".zip", ".rar", ".7z")
PACKAGED_EXTENSIONS = (".docx", ".docm", ".dotx", ".dotm", ".xlsx", ".xlsm", ".xltx", ".xltm", ".pptx", ".pptm", ".potx", ".potm", ".ppsx", ".ppsm", ".odt", ".ods", ".odp")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
CONTAINER_MIMES = ("application/zip", "application/x-zip-compressed", "application/vnd.rar", "application/x-rar-compressed", "application/x-7z-compressed")
MIMES = {
    ".pdf": "application/pdf", ".zip": "application/zip", ".rar": "application/vnd.rar", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".png": "image/png", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".7z": "application/x-7z-compressed",
}
#: Stand-ins for what is missing.
NO_REASON, NO_NAME = "Error de contenedor", "documento"
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
INVALID = r'["<>|:*?/\\\x00-\x1f]'


def base_name(c: Column) -> Column:
    """What follows the last separator (either slash, or a drive's colon)."""
    return F.regexp_extract(c, r"(?s)([^\\/:]*)$", 1)


def file_ext(c: Column) -> Column:
    """The extension with its dot; empty if there is none or the dot is last."""
    return F.coalesce(F.regexp_extract(c, r"(?s)(\.[^.\\/:]+)$", 1), F.lit(""))


def file_stem(c: Column) -> Column:
    """The base name without what follows its last dot."""
    return F.regexp_replace(base_name(c), r"(?s)\.[^.]*$", "")


def guess_mime(c: Column) -> Column:
    ext, out = F.lower(file_ext(c)), F.lit(None).cast("string")
    for known, mime in MIMES.items():
        out = F.when(ext == known, mime).otherwise(out)
    return out


def container_magic(head: Column) -> Column:
    """'zip', 'rar', '7z' by the first bytes, else NULL."""
    h = F.hex(F.substring(head, 1, 8))
    return F.when(h.rlike("^504B0[357]0[468]"), "zip").when(h.rlike("^526172211A07(00|0100)"), "rar").when(h.startswith("377ABCAF271C"), "7z")


def is_container(name: Column, mime: Column, head: Column) -> Column:
    """Extension first, then packaged documents (never), MIME type, first bytes."""
    ext = F.lower(file_ext(name))
    by_mime = F.coalesce(F.lower(mime).isin(*CONTAINER_MIMES), F.lit(False))
    return F.when(ext.isin(*CONTAINER_EXTENSIONS), True).when(ext.isin(*PACKAGED_EXTENSIONS), False).when(by_mime, True).otherwise(container_magic(head).isNotNull())


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def origin_hash(content: Column, chain: Column | None = None) -> Column:
    """Of a direct document its bytes; of an entry its chain and the hash of its bytes."""
    own = F.sha2(content, 256)
    return own if chain is None else F.when(chain.isNull(), own).otherwise(F.sha2(F.concat(chain, F.lit("|"), own), 256))


def safe_reason(c: Column) -> Column:
    return F.substring(F.translate(F.coalesce(c, F.lit(NO_REASON)), "\r\n", "  "), 1, 300)


def safe_original_name(c: Column) -> Column:
    return F.substring(F.when(F.coalesce(F.trim(F.regexp_replace(c, r"\s", " ")), F.lit("")) == "", NO_NAME).otherwise(c), 1, 500)


def safe_segment(c: Column) -> Column:
    """A path segment: invalid characters replaced, blanks and dots at the ends cut, reserved names marked, 120 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), INVALID, "_"), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(F.upper(clean).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean), 1, 120)


def safe_extension(c: Column) -> Column:
    bad = F.coalesce(F.trim(c), F.lit("")).eqNullSafe("") | (F.length(c) > 20) | c.rlike(INVALID)
    return F.when(bad, "").otherwise(F.lower(c))


def safe_segment_fallback(c: Column, fallback: str) -> Column:
    """The older variant: a blank or reserved name (up to its first dot) becomes the fallback."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), INVALID, "_"), r"^\s+|\s+$", "")
    clean = F.regexp_replace(clean, r"^\.+|\.+$", "")
    reserved = F.upper(F.substring_index(clean, ".", 1)).rlike(r"^(CON|PRN|AUX|NUL|COM\p{Nd}|LPT\p{Nd})$")
    blank = F.regexp_replace(clean, r"\s", "") == ""
    return F.substring(F.when(blank | reserved, fallback).otherwise(clean), 1, 120)


def safe_extension_strict(c: Column) -> Column:
    return F.when(F.coalesce(F.length(F.trim(c)), F.lit(0)).isin(0) | (F.length(c) > 16), "").otherwise(F.regexp_replace(c, r"[^\p{L}\p{Nd}.]", ""))


def safe_file_name(name: Column, identity: Column) -> Column:
    """Stem (100 characters at most), twelve digits of the identity's hash, extension."""
    base = base_name(F.coalesce(name, F.lit("")))
    stem = F.substring(safe_segment_fallback(file_stem(base), "adjunto"), 1, 100)
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(identity, 256), 1, 12), safe_extension_strict(file_ext(base)))


def date_path(ts: Column, message_id: Column) -> Column:
    return F.concat_ws("/", F.date_format(ts, "yyyy"), F.date_format(ts, "MM"), F.date_format(ts, "dd"), safe_segment(message_id))
