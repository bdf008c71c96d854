"""Stand-in entity views over the benchmark tables, as SQL that Spark and DuckDB share.

orders act as links, parts as tags, documents as searchable links, events as captures and requests.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the five order priorities, filed as collection names
COLLECTION_NAMES = [
    (1, "Work/1-URGENT"), (2, "Work/2-HIGH"), (3, "Reading/Later/3-MEDIUM"),
    (4, "Reading/Later/4-NOT SPECIFIED"), (5, "5-LOW"),
]

VIEW_SQL: dict[str, str] = {
    "v_users": """
SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_name AS name
FROM customer""",
    "v_collections": """
SELECT c.c_custkey * 10 + p.k AS id, p.name AS name,
       lower(replace(replace(p.name, '/', '-'), ' ', '-')) AS slug, c.c_custkey AS user_id
FROM customer c CROSS JOIN (
  SELECT DISTINCT CAST(substring(o_orderpriority, 1, 1) AS INT) AS k,
         CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) <= 2 THEN 'Work/'
              WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) <= 4 THEN 'Reading/Later/'
              ELSE '' END || o_orderpriority AS name
  FROM orders) p""",
    "v_links": """
SELECT o_orderkey AS id, 'https://www.example.com/o/' || CAST(o_orderkey AS STRING) AS url,
       o_custkey AS user_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE 'Order ' || o_orderpriority || ' - No. ' || CAST(o_orderkey AS STRING) END AS title,
       CAST(1 + o_orderkey % 12 AS INT) AS reading_time_min,
       CASE WHEN o_orderstatus = 'F' THEN 'parsed' WHEN o_orderstatus = 'O' THEN 'pending'
            WHEN o_orderkey % 3 = 0 THEN 'parsing' WHEN o_orderkey % 3 = 1 THEN 'failed'
            ELSE 'parsed' END AS status,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            ELSE o_custkey * 10 + CAST(substring(o_orderpriority, 1, 1) AS INT) END AS collection_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Sales/../Q' || CAST(1 + o_orderkey % 4 AS STRING) END AS export_directory,
       CASE WHEN o_orderkey % 22 = 0 THEN 'Report ' || CAST(o_orderkey AS STRING) || '.MD' END AS export_file_name,
       o_orderdate AS saved_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 150) * INTERVAL '1' SECOND END AS parsed_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '10' MINUTE END AS indexed_at
FROM orders""",
    "v_tags": """
SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS name FROM part""",
    "v_link_tags": """
SELECT DISTINCT l_orderkey AS link_id, l_partkey AS tag_id FROM lineitem""",
    "v_export_jobs": """
SELECT o_orderkey AS id, o_orderkey AS link_id,
       CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 2 THEN 'pending' WHEN 4 THEN 'exporting' ELSE 'done' END AS status,
       CASE WHEN o_orderkey % 10 IN (2, 6, 8) THEN 'collections/c' || CAST(o_orderkey % 9 AS STRING) || '/n'
            || CAST(o_orderkey AS STRING) || '.md' END AS vault_path,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 10 IN (0, 6, 8) THEN o_orderdate + INTERVAL '15' MINUTE END AS completed_at
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""",
    "v_doc_links": """
SELECT doc_id AS id, 'https://docs.example.org/' || CAST(doc_id AS STRING) AS url,
       trim(split_part(text, chr(10), 1)) AS title, text AS content,
       source AS collection, doc_id % 50 AS user_id, doc_id AS saved_seq
FROM documents""",
    "v_doc_tags": """
SELECT doc_id AS link_id, lang AS tag FROM documents
UNION ALL SELECT doc_id AS link_id, source AS tag FROM documents""",
    "v_captures": """
SELECT event_id, ts, user_id, 'https://example.com/' || event_type AS url FROM events""",
    "v_requests": """
SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN '/auth/login'
                          WHEN event_type = 'view' THEN '/links/search'
                          WHEN event_type = 'error' THEN '/health' ELSE '/links' END AS path,
       '10.0.0.' || CAST(user_id % 20 AS STRING) || ', 172.16.0.1' AS x_forwarded_for
FROM events""",
    "v_attempts": """
SELECT event_id, ts, user_id AS link_id,
       CASE event_type WHEN 'click' THEN 'link_created' WHEN 'view' THEN 'export_success'
                       WHEN 'purchase' THEN 'export_success' WHEN 'signup' THEN 'export_failed'
                       ELSE 'parse_failed' END AS kind,
       CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'convert'
            WHEN 2 THEN 'index' ELSE 'export' END END AS failure_type
FROM events""",
}

_BASE = "customer|orders|part|lineitem|documents|events|pages|benchmark|labels|conversations"


class Tables:
    """Lazy access to the base tables of a folder and to the stand-in views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEW_SQL[name]
        used = set(re.findall(rf"\b(?:FROM|JOIN)\s+({_BASE})\b", text))
        for table in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)
        return self.spark.sql(text, **{table: self.base(table) for table in used})

    links = cached_property(lambda self: self.view("v_links"))
    tags = cached_property(lambda self: self.view("v_tags"))
    link_tags = cached_property(lambda self: self.view("v_link_tags"))
    #: The rows of v_link_tags with their copies, for operators that look at some links only and drop copies then.
    tag_edges = cached_property(lambda self: self.base("lineitem").select(
        F.col("l_orderkey").alias("link_id"), F.col("l_partkey").alias("tag_id")))

    @cached_property
    def collections(self) -> DataFrame:
        """Five collections per customer, exploded per row instead of a cross join with orders."""
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")) for k, name in COLLECTION_NAMES])
        rows = self.base("customer").select("c_custkey", F.explode(cells).alias("c"))
        slug = F.lower(F.replace(F.replace(F.col("c.name"), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("-")))
        return rows.select((F.col("c_custkey") * 10 + F.col("c.k")).alias("id"), F.col("c.name").alias("name"),
                           slug.alias("slug"), F.col("c_custkey").alias("user_id"))

    @cached_property
    def full_links(self) -> DataFrame:
        """Links with their parsed content: the text of the document with the link's number."""
        content = self.base("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content_md"))
        return self.links.join(content, "id", "left")

    users = cached_property(lambda self: self.view("v_users"))
    export_jobs = cached_property(lambda self: self.view("v_export_jobs"))
    doc_links = cached_property(lambda self: self.view("v_doc_links"))
    doc_tags = cached_property(lambda self: self.view("v_doc_tags"))
    captures = cached_property(lambda self: self.view("v_captures"))
    requests = cached_property(lambda self: self.view("v_requests"))
    attempts = cached_property(lambda self: self.view("v_attempts"))
    pages = cached_property(lambda self: self.base("pages"))


def with_views(body: str) -> str:
    """Prefix a DuckDB query with the view definitions it mentions."""
    used = [name for name in VIEW_SQL if re.search(rf"\b{name}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name].strip()})" for name in used)
    stripped = body.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", stripped)
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{stripped[recursive.end():]}"
    plain = re.match(r"(?i)with\s+", stripped)
    if plain:
        return f"WITH {ctes},\n{stripped[plain.end():]}"
    return f"WITH {ctes}\n{stripped}"
