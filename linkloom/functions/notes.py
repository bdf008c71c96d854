"""Markdown text of notes, tag pages and indexes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_list_yaml(tags: Column) -> Column:
    quoted = F.transform(tags, lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def iso_instant(ts: Column) -> Column:
    """ISO-8601 in UTC: no fraction, or 3 or 6 digits, whichever the value needs."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros == "000000", "")
        .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(base, fraction, F.lit("Z"))


def frontmatter(title: Column, url: Column, tags: Column, collection_dir: Column, as_of: Column,
                minutes: Column, link_id: Column, id_key: str = "link_id") -> Column:
    """YAML header of a vault note. ``id_key`` is the name of the last field."""
    at = iso_instant(as_of)
    return F.concat(
        F.lit('---\ntitle: "'), title, F.lit('"\nurl: "'), url, F.lit('"\ntags: '), tag_list_yaml(tags),
        F.lit("\ncollection: "), collection_dir, F.lit("\nsaved_at: "), at, F.lit("\nparsed_at: "), at,
        F.lit("\nreading_time: "), minutes.cast("string"), F.lit(f"min\n{id_key}: "), link_id.cast("string"),
        F.lit("\n---"),
    )


def related_section(slugs: Column) -> Column:
    lines = F.array_join(F.transform(slugs, lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), "\n")
    return F.when(F.coalesce(F.size(slugs), F.lit(0)) > 0,
                  F.concat(F.lit("\n\n## Related\n"), lines, F.lit("\n"))).otherwise("")


def rewrite_images(content: Column, images: Column) -> Column:
    """Replace each image URL (map key) by its file below assets/ (map value)."""
    entries = F.map_entries(F.coalesce(images, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, content, lambda text, e: F.replace(text, e["key"], F.concat(F.lit("assets/"), e["value"])))


def strip_margin(c: Column) -> Column:
    """Drop white space up to and including a '|' at the start of each line."""
    return F.regexp_replace(c, r"(^|\n)[\x00-\x09\x0B\x0D-\x20]*\|", "$1")


def note_markdown(header: Column, title: Column, body: Column, related: Column) -> Column:
    """Whole note. The margin rule reaches the body too: later body lines lose a leading '|'."""
    return strip_margin(F.concat(header, F.lit("\n|\n|# "), title, F.lit("\n|\n|"), body, F.lit("\n|"), related))


def download_markdown(title: Column, url: Column, tags: Column, saved_at: Column, parsed_at: Column,
                      minutes: Column, content: Column) -> Column:
    """Stand-alone form of a note: stored times, no collection, no id."""
    empty = F.lit("")
    return strip_margin(F.concat(
        F.lit('---\n|title: "'), title, F.lit('"\n|url: "'), url, F.lit('"\n|tags: '), tag_list_yaml(tags),
        F.lit("\n|saved_at: "), F.coalesce(iso_instant(saved_at), empty),
        F.lit("\n|parsed_at: "), F.coalesce(iso_instant(parsed_at), empty),
        F.lit("\n|reading_time: "), minutes.cast("string"), F.lit("min\n|---\n|\n|# "), title, F.lit("\n|\n|"),
        content, F.lit("\n|"),
    ))


def clean_markdown(c: Column) -> Column:
    """Collapse blank lines, drop lines of white space and empty links, trim."""
    out = F.regexp_replace(c, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?m)^\s+$", "")
    out = F.regexp_replace(out, r"\[\s*\]\(\)", "")
    return F.regexp_replace(out, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
