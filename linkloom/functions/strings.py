"""Text columns: slugs, trimming, hashing, link labels. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the white space that Java's \s matches
JAVA_SPACE = r" \t\n\x0B\f\r"


def java_trim(c: Column) -> Column:
    """Trim every character up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def utf16_left(c: Column, n: int) -> Column:
    """First ``n`` UTF-16 units, never splitting a surrogate pair."""
    head = F.substring(c, 1, n)
    units = F.substring(F.encode(head, "UTF-16BE"), 1, 2 * n)
    # a high surrogate (D8..DB) in the last unit lost its partner
    split_pair = (F.length(units) == 2 * n) & F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    astral = F.length(F.encode(head, "UTF-16BE")) > 2 * F.length(head)
    cut = F.when(split_pair, F.substring(units, 1, 2 * n - 2)).otherwise(units)
    return F.when(astral, F.decode(cut, "UTF-16BE")).otherwise(head)


# ---- slugs: four forms, differences kept on purpose -------------------------------------------

def _ascii_words(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(kept, r"\s+", "-")


def _tidy_dashes(c: Column) -> Column:
    one = F.regexp_replace(c, "-{2,}", "-")
    return F.regexp_replace(F.regexp_replace(one, "^-", ""), "-$", "")


def wikilink_slug(title: Column) -> Column:
    """Slug used in wikilinks, tag files and downloads: dashes are neither collapsed nor trimmed."""
    return F.substring(_ascii_words(title), 1, 80)


def path_slug(c: Column) -> Column:
    """Slug of one path segment, uncut."""
    return _tidy_dashes(_ascii_words(c))


def note_slug(c: Column) -> Column:
    return F.substring(path_slug(c), 1, 80)


def file_stem(name: Column) -> Column:
    """Slug of a note's file: a trailing .md is dropped, nothing left becomes 'untitled'."""
    stem = note_slug(F.regexp_replace(java_trim(name), r"(?i)\.md$", ""))
    return F.when(stem == "", F.lit("untitled")).otherwise(stem)


def collection_slug(name: Column) -> Column:
    """Slug of a collection: keeps letters and digits of every script, at most 100 units."""
    words = F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}\s-]", " ")
    return utf16_left(_tidy_dashes(F.regexp_replace(words, r"\s+", "-")), 100)


# ---- vault paths -------------------------------------------------------------------------------

def normalize_directory(raw: Column) -> Column:
    """Slug every segment of a path; empty, '.' and '..' segments vanish; nothing left is null."""
    segments = F.transform(F.split(raw, r"[/\\]+"), java_trim)
    real = F.filter(segments, lambda s: ~s.isin("", ".", ".."))
    slugs = F.filter(F.transform(real, note_slug), lambda s: s != "")
    return F.nullif(F.array_join(slugs, "/"), F.lit(""))


def collection_directory(collection: Column) -> Column:
    return F.coalesce(normalize_directory(collection), F.lit("unsorted"))


def _lexical_normalize(path: Column) -> Column:
    """Normal form of an absolute path: '.' dropped, '..' removes the segment before it."""
    parts = F.filter(F.split(path, "/+"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def note_directory(export_directory: Column, collection: Column, allow_absolute: bool = False) -> Column:
    """Folder of a note below the vault root (an absolute one only where that is allowed)."""
    explicit = F.concat(F.lit("collections/"), normalize_directory(java_trim(export_directory)))
    if allow_absolute:
        trimmed = java_trim(export_directory)
        explicit = F.when(trimmed.startswith("/"), _lexical_normalize(trimmed)).otherwise(explicit)
    return F.coalesce(explicit, F.concat(F.lit("collections/"), collection_directory(collection)))


def note_path(export_directory: Column, export_file_name: Column, title: Column, collection: Column,
              allow_absolute: bool = False) -> Column:
    stem = file_stem(F.coalesce(export_file_name, title))
    return F.concat(note_directory(export_directory, collection, allow_absolute), F.lit("/"), stem, F.lit(".md"))


# ---- hashes ------------------------------------------------------------------------------------

def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def java_string_hash(c: Column) -> Column:
    """31-polynomial over UTF-16 units with 32-bit wrap-around, as a signed integer."""
    hexed = F.hex(F.encode(c, "UTF-16BE"))
    starts = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(4))).otherwise(
        F.array().cast("array<int>"))
    units = F.transform(starts, lambda i: F.conv(F.substring(hexed, i, F.lit(4)), 16, 10).cast("bigint"))
    unsigned = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % F.lit(1 << 32))
    return F.when(unsigned >= (1 << 31), unsigned - (1 << 32)).otherwise(unsigned).cast("int")


def image_extension(content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit("image/png"))
    return (
        F.when(kind.contains("jpeg") | kind.contains("jpg"), "jpg")
        .when(kind.contains("png"), "png")
        .when(kind.contains("gif"), "gif")
        .when(kind.contains("webp"), "webp")
        .when(kind.contains("svg"), "svg")
        .otherwise("png")
    )


def image_filename(link_id: Column, url: Column, content_type: Column) -> Column:
    h = java_string_hash(url).cast("bigint")
    # the 32-bit absolute value of the smallest integer is itself
    size = F.when(h == -(1 << 31), h).otherwise(F.abs(h))
    return F.concat(link_id.cast("string"), F.lit("_"), size.cast("string"), F.lit("."), image_extension(content_type))


# ---- small helpers -----------------------------------------------------------------------------

def reading_minutes(content: Column) -> Column:
    """Words / 200, at least 1. Trailing empty pieces do not count, a leading one does."""
    words = F.size(F.split(F.regexp_replace(content, rf"[{JAVA_SPACE}]+$", ""), r"\s+"))
    return F.greatest(F.lit(1), F.floor(words / 200).cast("int"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(java_trim(c), F.lit(""))


# fixed value: the white space that a browser trims
BROWSER_SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


# the same characters, one by one
BROWSER_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def browser_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BROWSER_SPACES))


def parse_tag_list(text: Column, trim: Callable[[Column], Column] = browser_trim) -> Column:
    """Comma list to trimmed, non-empty names."""
    return clean_tag_array(F.split(text, ","), trim)


def clean_tag_array(tags: Column, trim: Callable[[Column], Column] = browser_trim) -> Column:
    return F.filter(F.transform(tags, lambda t: trim(t)), lambda t: t != "")


def default_tags(own: Column, defaults: Column) -> Column:
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(defaults)


def link_domain(url: Column) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit("external"))


def link_file_label(export_file_name: Column, title: Column, url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")
    empty = F.lit("")
    return F.coalesce(F.nullif(export_file_name, empty), F.nullif(title, empty), bare)


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    first = java_trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), remote)


# fixed values: admission limits (requests, window seconds) per bucket
RATE_LIMITS = {"auth": (10, 300), "general": (100, 60), "search": (30, 60)}


def rate_bucket(path: Column) -> Column:
    """Limit bucket of a request path; null where no limit applies."""
    return (
        F.when(path.isin("/health", "/metrics"), F.lit(None).cast("string"))
        .when(path.startswith("/auth/"), "auth")
        .when(path.startswith("/links/search"), "search")
        .otherwise("general")
    )


def rate_key(path: Column, ip: Column) -> Column:
    return F.concat(F.lit("rate-limit:"), rate_bucket(path), F.lit(":"), ip)


# ---- escaping and snippets ---------------------------------------------------------------------

# fixed values: HTML escapes, ampersand first
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, escaped in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def safe_highlight(c: Column) -> Column:
    """Escape everything, then let the highlight marks back in."""
    opened = F.replace(escape_html(c), F.lit("&lt;mark&gt;"), F.lit("<mark>"))
    return F.replace(opened, F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def quote_regex(text: str) -> str:
    special = set(r".*+?^${}()|[]\/-#&~")
    return "".join("\\" + ch if ch in special else ch for ch in text)


def search_snippet(content: Column, title: Column, url: Column, term: str) -> Column:
    """First 220 units of the best source, escaped, with each match of the term marked."""
    empty = F.lit("")
    source = F.coalesce(F.nullif(content, empty), F.nullif(title, empty), F.nullif(url, empty), empty)
    safe = escape_html(utf16_left(source, 220))
    if not term:
        return safe
    return F.regexp_replace(safe, "(?iu)(" + quote_regex(term) + ")", "<mark>$1</mark>")
