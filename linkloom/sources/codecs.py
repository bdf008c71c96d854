"""JSON records in and out: every entity, ISO instants, checked states, bad records kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import status as st
from linkloom.functions.notes import iso_instant

# fixed values: JSON names and kinds of each entity; '?' marks a field that may be missing or null
RECORDS = {
    "link": "id:long url:string urlHash:string title:string? contentMd:string? readingTimeMin:int? status:linkState "
            "collectionId:long? exportDirectory:string? exportFileName:string? savedAt:instant parsedAt:instant? indexedAt:instant?",
    "new_link": "url:string tags:strings collectionId:long? exportDirectory:string? exportFileName:string?",
    "collection": "id:long name:string slug:string userId:long createdAt:instant",
    "new_collection": "name:string",
    "tag": "id:long name:string",
    "link_tag": "linkId:long tagId:long",
    "export_job": "id:long linkId:long status:exportState vaultPath:string? errorMsg:string? createdAt:instant completedAt:instant?",
    "parse_job": "linkId:long url:string",
    "parse_result": "linkId:long title:string contentMd:string readingTime:int imageCount:int",
}
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "strings": T.ArrayType(T.StringType())}
_INSTANT = r"^[+-]?\d{4,10}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}(:\d{2}(:\d{2})?)?)$"


def _fields(entity: str) -> list[tuple[str, str, bool]]:
    out = []
    for item in RECORDS[entity].split():
        name, kind = item.split(":")
        out.append((name, kind.rstrip("?"), kind.endswith("?")))
    return out


def parse_instant(text: Column) -> Column:
    """ISO-8601 instant with a zone, or null."""
    return F.when(text.rlike(_INSTANT), F.try_to_timestamp(text))


def decode(texts: DataFrame, entity: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, bad): typed rows of valid JSON texts, and the texts with the reason they were refused."""
    judged = judge(texts, entity, column)
    good = judged.where(F.col("error").isNull()).select("r.*")
    return good, judged.where(F.col("error").isNotNull()).select(column, "error")


def judge(texts: DataFrame, entity: str, column: str = "value") -> DataFrame:
    """Each JSON text with its typed fields ``r`` and the reason why it is refused (``error``, null for a valid one)."""
    fields = _fields(entity)
    schema = T.StructType([T.StructField(name, _TYPES.get(kind, T.StringType())) for name, kind, _ in fields]
                          + [T.StructField("_corrupt", T.StringType())])
    rows = texts.select(column, F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rows = rows.select(column, "r.*")
    values, reasons = {}, [F.when(F.col("_corrupt").isNotNull(), "not a JSON record of this kind")]
    for name, kind, optional in fields:
        raw, value = F.col(name), F.col(name)
        if kind == "instant":
            value = parse_instant(raw)
            reasons.append(F.when(raw.isNotNull() & value.isNull(), F.concat(F.lit("Invalid instant: "), raw)))
        elif kind in ("linkState", "exportState"):
            allowed, label = (st.LINK_STATES, "LinkStatus") if kind == "linkState" else (st.EXPORT_STATES, "ExportStatus")
            value = st.parse_state(raw, allowed)
            reasons.append(F.when(raw.isNotNull(), st.state_error(raw, allowed, label)))
        if not optional:
            reasons.append(F.when(raw.isNull(), f"missing field {name}"))
        values[name] = value
    typed = F.struct(*[v.alias(n) for n, v in values.items()])
    return rows.select(column, typed.alias("r"), F.coalesce(*reasons).alias("error"))


def encode(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One JSON object per row; ``names`` maps columns to JSON names in order, nulls are written, times are instants."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cells = []
    for column, name in names.items():
        is_time = isinstance(kinds[column], (T.TimestampType, T.TimestampNTZType))
        cells.append((iso_instant(F.col(column)) if is_time else F.col(column)).alias(name))
    return rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))
