"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from linkloom.plans import catalog
from linkloom.session import build_session
from linkloom.sources.views import Tables

HEADLINE = os.environ["BENCH_ONLY"].split(",") if os.environ.get("BENCH_ONLY") else [
    "related_top5", "related_weighted_top8", "backlinks_for_link", "backlinks_map", "related_hot_tags", "join_link_tags",
    "selfjoin_shared_tags", "collections_with_counts", "collection_tree", "links_for_user", "tag_upsert", "link_mark",
    "search_postings", "search_fulltext", "search_highlight", "search_advanced", "search_suggest", "resync_docs",
    "parse_pages", "page_images", "markdown_blocks", "slug_collection", "export_notes", "sink_notes", "tag_page",
    "index_document", "sink_manifest", "ttl_dedup", "ttl_dedup_hot", "rate_limit", "links_per_hour", "queue_depth",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM and of Python workers is not what is measured
    tables = Tables(spark, folder)
    tables.links.write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        # every row is computed and dropped: no collect to the driver
        catalog()[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
