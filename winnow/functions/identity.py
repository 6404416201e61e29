"""Paths, times, formats and content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c

# Extension to media format.
FORMATS = {
    "jpg": "jpeg",
    "jpeg": "jpeg",
    "png": "png",
    "webp": "webp",
    "heic": "heic",
    "heif": "heic",
    "dng": "raw",
    "cr2": "raw",
    "cr3": "raw",
    "nef": "raw",
    "nrw": "raw",
    "arw": "raw",
    "srw": "raw",
    "orf": "raw",
    "rw2": "raw",
    "pef": "raw",
    "raf": "raw",
    "rwl": "raw",
    "raw": "raw",
}

# Colour label to the text other tools display.
COLOR_LABELS = {
    "none": "",
    "red": "Red",
    "yellow": "Yellow",
    "green": "Green",
    "blue": "Blue",
    "purple": "Purple",
}


def _lookup(mapping: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.create_map(*pairs)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1))


def media_format(path) -> Column:
    """Supported format of a path, NULL when unsupported."""
    return F.try_element_at(_lookup(FORMATS), extension(path))


def variant_key(path) -> Column:
    """Path without its last extension; names that start with a dot keep it."""
    return F.regexp_replace(_c(path), r"(?<=[^/])\.[^./]*$", "")


def unix_path(path) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def safe_relative(path) -> Column:
    """Relative, non-empty and free of parent segments, drive letters and NULs."""
    p = unix_path(path)
    return (
        p.isNotNull()
        & (F.length(p) > 0)
        & ~p.startswith("/")
        & ~p.rlike(r"(^|/)\.\.(/|$)")
        & ~p.rlike(r"^[A-Za-z]:")
    )


def under(path, root) -> Column:
    """Component-wise prefix test."""
    p, r = _c(path), _c(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def capture_seconds(text) -> Column:
    """Epoch seconds of RFC 3339 text, 'Y-m-d H:M:S' or 'Y:m:d H:M:S' (both read as UTC)."""
    t = _c(text)
    rfc = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    iso = F.when(t.rlike(rfc), F.try_to_timestamp(F.upper(t)))
    dashed = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    colons = F.when(
        t.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"),
        F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")),
    )
    return F.unix_timestamp(F.coalesce(iso, dashed, colons))


def is_sha256(text) -> Column:
    return F.coalesce(_c(text).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def scene_id(project, ids) -> Column:
    """Deterministic id of an ordered member list."""
    listed = F.array_join(F.transform(_c(ids), lambda i: i.cast("string")), ", ")
    text = F.concat(F.lit("scene-v1:"), _c(project).cast("string"), F.lit(":["), listed, F.lit("]"))
    return F.concat(F.lit("scene-"), F.sha2(text, 256))


def members_key(ids) -> Column:
    """Digest of the sorted member ids as compact JSON."""
    return F.sha2(F.to_json(F.array_sort(_c(ids))), 256)


def content_key(*columns) -> Column:
    """Digest of the canonical JSON of the given columns, keys in the given order."""
    return F.sha2(
        F.to_json(F.struct(*[_c(c) for c in columns]), {"ignoreNullFields": "false"}), 256
    )


def space_key(*parts) -> Column:
    """Digest naming a vector space by model, preprocessing and dimension identity."""
    return F.sha2(F.concat_ws(":", *[_c(p).cast("string") for p in parts]), 256)


def xml_escape(text) -> Column:
    out = _c(text)
    for raw, escaped in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def color_text(label) -> Column:
    return F.try_element_at(_lookup(COLOR_LABELS), _c(label))
