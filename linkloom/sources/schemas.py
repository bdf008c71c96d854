"""Fixed schemas of the stored entities."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, TS = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


USERS = _schema(id=L, email=S, name=S, created_at=TS, updated_at=TS)
LINKS = _schema(
    id=L, url=S, url_hash=S, title=S, content_md=S, reading_time_min=I, status=S, collection_id=L, user_id=L,
    export_directory=S, export_file_name=S, saved_at=TS, parsed_at=TS, indexed_at=TS,
)
COLLECTIONS = _schema(id=L, name=S, slug=S, user_id=L, created_at=TS)
TAGS = _schema(id=L, name=S)
LINK_TAGS = _schema(link_id=L, tag_id=L)
EXPORT_JOBS = _schema(id=L, link_id=L, status=S, vault_path=S, error_msg=S, created_at=TS, completed_at=TS)
PAGES = _schema(page_id=L, url=S, html=S)
NOTES = _schema(link_id=L, path=S, slug=S, collection=S, updated_at=S)

ENTITIES = {
    "users": USERS, "links": LINKS, "collections": COLLECTIONS, "tags": TAGS, "link_tags": LINK_TAGS,
    "export_jobs": EXPORT_JOBS,
}

# one note of the vault manifest, keyed by link id as text
MANIFEST_NOTE = T.StructType([
    T.StructField("linkId", L), T.StructField("path", S), T.StructField("slug", S),
    T.StructField("collection", S), T.StructField("updatedAt", S),
])
MANIFEST = T.StructType([T.StructField("notes", T.MapType(S, MANIFEST_NOTE))])
