"""A stored search index that follows changes: immutable segments, tombstones, tiered merges.

A batch of documents becomes one segment; what it replaces or deletes in older segments is marked by tombstones (segment,
id). Nothing that is written is changed; a small manifest with versions names the segments, the tombstones and the field
statistics, which each batch moves by what it adds and takes away. When a tier of segments of like size is full, it is
merged into one segment of the next tier, and the tombstones of its segments go. Each document is thus rewritten once per
tier.

Postings lie in blocks of one term, field and user. A block knows its number of postings and their largest BM25 share, so a
ranked search first reads the best block of each term, takes the score of the k-th document found as a bound, and then reads
only blocks that could lift a document to it. Blocks are stored by a hash of the term and by level of share, as partitions:
whole levels that no query needs are not opened. Positions answer phrases; a sorted dictionary of terms answers prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators import search
from linkloom.operators.relational import page_per_key
from linkloom.session import ensure_checkpoint_dir
from linkloom.sources.versions import Versions

FIELDS = tuple(search.BOOSTS)
BLOCK_KIND = ("field string, term string, user_id bigint, salt int, block int, n bigint, top double, "
              "entries array<struct<id:bigint,tf:bigint,dl:int,positions:array<int>>>, segment string, bucket int, level int")
KEYS = ["segment", "bucket", "level", "field", "term", "user_id", "salt", "block"]
GROUP = ["bucket", "level", "salt", "field", "term", "user_id"]
TASK_TOKENS = 1_000_000  # tokens whose postings one task sorts, about


class SearchIndex:
    """An index below ``folder``, shared by all machines.

    Documents have id and user_id (whole numbers), title, content and tags, and any other columns, which are stored as they
    are; all batches have the same columns. ``buckets``: partitions by term; ``levels``: partitions by share; ``block``:
    postings of a block; ``fanout``: segments of a tier that are merged; ``tier_docs``: size of the first tier;
    ``task_docs``: documents whose postings of one term one task may sort.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, levels: int = 4, block: int = 128, fanout: int = 4,
                 tier_docs: int = 1000, task_docs: int = 1_000_000):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, folder)
        self.buckets, self.levels, self.block = buckets, levels, block
        self.fanout, self.tier_docs, self.task_docs = fanout, tier_docs, task_docs

    def state(self) -> tuple[int, dict]:
        number = self.versions.latest()
        return number, self.versions.content(number) or {
            "segments": {}, "dead": {}, "stats": {f: [0, 0] for f in FIELDS}, "schema": None, "epoch": -1}

    # ---- reading the parts ---------------------------------------------------------------------

    def _docs(self, state: dict, parts: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.folder}/docs").schema(state["schema"]).parquet(
            *[f"{self.folder}/docs/segment={s}" for s in state["segments"]])
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def _blocks(self, segments: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/postings").schema(BLOCK_KIND).parquet(
            *[f"{self.folder}/postings/segment={s}" for s in segments])

    def _terms(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema("field string, term string").parquet(*[f"{self.folder}/terms/segment={s}" for s in segments])

    def _dead(self, state: dict) -> DataFrame | None:
        """Tombstones of the live segments, if there are any."""
        if not state["dead"]:
            return None
        rows = self.spark.read.schema("segment string, id bigint").parquet(*[f"{self.folder}/dead/{d}" for d in state["dead"]])
        return rows.where(F.col("segment").isin(list(state["segments"])))

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        dead = self._dead(state)
        return rows if dead is None else rows.join(dead, ["segment", "id"], "left_anti")

    def documents(self) -> DataFrame:
        """The stored documents, one per id: those of the last batch that wrote them."""
        _, state = self.state()
        rows = self._alive(self._docs(state), state)
        return rows.drop("segment", "part", *[f"dl_{f}" for f in FIELDS])

    # ---- writing -------------------------------------------------------------------------------

    def _part(self) -> Column:
        return F.pmod(F.hash("id"), F.lit(self.buckets))

    def apply(self, docs: DataFrame, gone: DataFrame | None = None, epoch: int | None = None, merge: bool = True) -> None:
        """Write documents (one row per id) over those of the same ids, and delete the ids of ``gone``.

        A batch with a known ``epoch`` changes nothing, so a stream may repeat it. Ids in both are written. An empty batch
        only moves the epoch. Another writer's commit in between is a ``Conflict``, and the batch has no effect.
        """
        base, state = self.state()
        if epoch is not None and epoch <= state["epoch"]:
            return
        name = f"s{uuid4().hex}"
        sizes = [F.size(search.tokens(F.col(f))).alias(f"dl_{f}") for f in ("title", "content")]
        sizes.append(F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("dl_tags"))
        docs.select("*", *sizes, self._part().alias("part")).hint("rebalance", "part").write.partitionBy("part").parquet(
            f"{self.folder}/docs/segment={name}")
        state["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(
            f"dl_{f} int" for f in FIELDS) + ", segment string, part int"
        new = self._docs(state | {"segments": {name: 0}})
        before = state["stats"]
        added, state["stats"] = self._moved(new, before, 1)
        tokens = sum(state["stats"][f][1] - before[f][1] for f in FIELDS)
        touched = new.select("id")
        if gone is not None:
            touched = touched.unionByName(gone.select(F.col("id").cast("long").alias("id"))).distinct()
        if state["segments"]:
            self._bury(touched, state)
        if added:
            self._write_segment(search.postings(new.select("id", "user_id", "title", "content", "tags")), name, added, tokens, state)
            state["segments"][name] = {"docs": added, "avgdl": self._avgdl(state)}
        if epoch is not None:
            state["epoch"] = epoch
        self.versions.commit(base, state)
        if merge:
            self.merge()

    def _moved(self, rows: DataFrame, stats: dict, sign: int) -> tuple[int, dict]:
        """Number of rows, and the statistics moved by them."""
        sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[
            a for f in FIELDS for a in (F.count_if(F.col(f"dl_{f}") > 0).alias(f"n_{f}"),
                                        F.coalesce(F.sum(f"dl_{f}"), F.lit(0)).alias(f"t_{f}"))]).first()
        return sums["rows"], {f: [stats[f][0] + sign * sums[f"n_{f}"], stats[f][1] + sign * sums[f"t_{f}"]] for f in FIELDS}

    def _avgdl(self, state: dict) -> dict[str, float]:
        return {f: total / n if n else 1.0 for f, (n, total) in state["stats"].items()}

    def _bury(self, touched: DataFrame, state: dict) -> None:
        """Tombstones for the live documents among ``touched``; only the id partitions that they fall into are read."""
        parts = [r[0] for r in touched.select(self._part().alias("part")).distinct().collect()]  # no more than buckets
        old = self._alive(self._docs(state, parts), state).join(touched, "id", "left_semi")
        name = uuid4().hex
        old.select("segment", "id", *[f"dl_{f}" for f in FIELDS]).write.parquet(f"{self.folder}/dead/{name}")
        dead = self.spark.read.parquet(f"{self.folder}/dead/{name}")
        hit = {r["segment"]: r["n"] for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        if hit:
            state["dead"][name] = hit
            _, state["stats"] = self._moved(dead, state["stats"], -1)

    def _write_segment(self, postings: DataFrame, name: str, n_docs: int, tokens: int, state: dict) -> None:
        """Blocks of a segment, and its dictionary."""
        mean = F.create_map(*[x for f, a in self._avgdl(state).items() for x in (F.lit(f), F.lit(a))])[F.col("field")]
        share = F.col("tf") / (F.col("tf") + _norm(F.col("field"), F.col("dl"), mean))
        level = F.least(F.lit(self.levels - 1), F.floor((1 - share) * self.levels)).cast("int")
        salts = max(1, -(-n_docs // self.task_docs))
        kinds = {c: F.col(c).cast("bigint").alias(c) for c in ("id", "user_id", "tf")}
        rows = postings.select("field", "term", *kinds.values(), "dl", F.col("positions").cast("array<int>").alias("positions"))
        place = [search._bucket(self.buckets).alias("bucket"), level.alias("level"), F.pmod(F.hash("id"), F.lit(salts)).cast("int").alias("salt")]
        # one shuffle, into as many tasks as the tokens need: all of a block's postings have the same group
        tasks = max(1, -(-tokens // TASK_TOKENS))
        spread = F.pmod(F.xxhash64("field", "term", "user_id"), F.lit(-(-tasks // self.buckets)))
        rows = rows.repartition(tasks, *place, spread).select("*", share.alias("share"), *place)
        # groups are told apart by a hash first, so that the sort seldom compares strings
        rows = rows.withColumn("h", F.xxhash64(*GROUP)).sortWithinPartitions("h", *GROUP, F.desc("share"), "id").drop("h")
        blocks = rows.mapInArrow(_blocked(self.block), BLOCK_KIND.replace(", segment string", ""))
        blocks.write.partitionBy("bucket", "level").parquet(f"{self.folder}/postings/segment={name}")
        self._blocks([name]).select("field", "term").distinct().repartitionByRange("field", "term").sortWithinPartitions(
            "field", "term").write.parquet(f"{self.folder}/terms/segment={name}")

    def tier(self, docs: int) -> int:
        return int(math.log(max(docs, self.tier_docs) / self.tier_docs, self.fanout) + 1e-9)

    def merge(self) -> None:
        """Merge full tiers, the smallest first, until none is full."""
        while True:
            base, state = self.state()
            tiers: dict[int, list[str]] = {}
            for name, segment in state["segments"].items():
                tiers.setdefault(self.tier(segment["docs"]), []).append(name)
            full = next((names for _, names in sorted(tiers.items()) if len(names) >= self.fanout), None)
            if not full:
                return
            self._merge(base, state, full)

    def _merge(self, base: int, state: dict, names: list[str]) -> None:
        new = f"s{uuid4().hex}"
        some = state | {"segments": {n: state["segments"][n] for n in names}}
        docs = self._alive(self._docs(some), some).drop("segment")
        docs.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.folder}/docs/segment={new}")
        count, sizes = self._moved(self._docs(state | {"segments": {new: 0}}), {f: [0, 0] for f in FIELDS}, 1)
        entries = self._blocks(names).select("segment", "field", "term", "user_id", F.explode("entries").alias("e")).select(
            "segment", "field", "term", "user_id", "e.*")
        if count:
            tokens = sum(total for _, total in sizes.values())
            self._write_segment(self._alive(entries, some).drop("segment"), new, count, tokens, state)
        for name in names:
            del state["segments"][name]
        if count:
            state["segments"][new] = {"docs": count, "avgdl": self._avgdl(state)}
        live = set(state["segments"])
        state["dead"] = {d: hit for d, hit in state["dead"].items() if live & set(hit)}
        self.versions.commit(base, state)

    def vacuum(self, keep: int = 2) -> None:
        """Remove segments and tombstones that none of the last ``keep`` versions names; no older reader may be at work."""
        kept = self.versions.forget(keep)
        segments = {f"segment={s}" for state in kept for s in state["segments"]}
        for kind, used in (("docs", segments), ("postings", segments), ("terms", segments), ("dead", {d for s in kept for d in s["dead"]})):
            for name in set(self.versions.files.names(f"{self.folder}/{kind}")) - used:
                self.versions.files.remove(f"{self.folder}/{kind}/{name}")

    # ---- ranked search -------------------------------------------------------------------------

    def search(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Best documents of each query for every user: (query_id, user_id, id, score, pos), as ``search.search_fulltext``."""
        return self._search(queries, limit)[0]

    def blocks_read(self, queries: DataFrame, limit: int = 20) -> tuple[int, int]:
        """Blocks that a search scores, and blocks of its terms."""
        _, read, heads = self._search(queries, limit)
        return read.select(*KEYS).distinct().count(), heads.select(*KEYS).distinct().count()

    def _search(self, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        _, state = self.state()
        if not state["segments"]:
            empty = self.spark.createDataFrame([], "query_id int, user_id bigint, id bigint, score double, pos int")
            return empty, self._none(), self._none()
        terms = search.query_terms(queries)
        wanted = terms.select("field", "term", search._bucket(self.buckets).alias("bucket")).distinct()
        asked = [r[0] for r in wanted.select("bucket").distinct().collect()]  # no more than buckets
        stored = self._blocks(list(state["segments"])).where(F.col("bucket").isin(asked))
        # heads of blocks: their entries are not read
        heads = stored.select(*KEYS, "n", "top").join(wanted, ["bucket", "field", "term"], "left_semi")
        if "user_id" in queries.columns:
            heads = heads.join(queries.select("user_id").distinct(), "user_id", "left_semi")
        weights = self._weights(state, terms, stored, wanted)
        bound = self._bounds(heads, weights, state)
        if "user_id" in queries.columns:
            bound = bound.join(queries.select("query_id", "user_id"), ["query_id", "user_id"], "left_semi")
        ensure_checkpoint_dir(self.spark)
        bound = bound.checkpoint()  # heads of the asked terms, read by all that follows
        # the best block of each term gives a score that the k-th document has at least
        per_term = Window.partitionBy("query_id", "user_id", "field", "term")
        order = per_term.orderBy(F.desc("bound"), "segment", "level", "salt", "block")
        first = bound.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        seen = self._scores(first, weights, state, limit)
        least = seen.where(F.col("pos") == limit).select("query_id", "user_id", F.col("score").alias("least")).checkpoint()
        most = F.max("bound").over(per_term)
        one = bound.withColumn("most", most)
        per_field = one.groupBy("query_id", "user_id", "field", "term").agg(F.max("most").alias("most")).groupBy(
            "query_id", "user_id", "field").agg(F.sum("most").alias("all"))
        boost = F.create_map(*[x for f, b in search.BOOSTS.items() for x in (F.lit(f), F.lit(b))])[F.col("field")]
        reach = (F.col("bound") + F.col("all") - F.col("most")) * boost
        read = one.join(per_field, ["query_id", "user_id", "field"]).join(least, ["query_id", "user_id"], "left").where(
            F.col("least").isNull() | (reach >= F.col("least") - 1e-5))  # scores are rounded to six digits
        return self._scores(read, weights, state, limit), read, heads

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], BLOCK_KIND)

    def _weights(self, state: dict, terms: DataFrame, stored: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, field, term, idf) with the numbers of live documents."""
        df = stored.select("segment", "bucket", "field", "term", "n").join(wanted, ["bucket", "field", "term"], "left_semi").groupBy(
            "field", "term").agg(F.sum("n").alias("n"))
        dead = self._dead(state)
        if dead is not None:
            # ids are read in segments with tombstones only
            hit = [s for s in state["segments"] if any(s in h for h in state["dead"].values())]
            ids = stored.where(F.col("segment").isin(hit)).select(
                "segment", "bucket", "field", "term", F.explode(F.col("entries.id")).alias("id")).join(
                wanted, ["bucket", "field", "term"], "left_semi")
            gone = ids.join(dead, ["segment", "id"], "left_semi").groupBy("field", "term").agg(F.count(F.lit(1)).alias("gone"))
            df = df.join(gone, ["field", "term"], "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
        total = F.create_map(*[x for f, (n, _) in state["stats"].items() for x in (F.lit(f), F.lit(n))])[F.col("field")]
        return terms.join(df, ["field", "term"]).where("n > 0").select("query_id", "field", "term", (
            F.col("qtf") * F.log(1 + (total - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("idf"))

    def _bounds(self, heads: DataFrame, weights: DataFrame, state: dict) -> DataFrame:
        """Blocks with the most that a posting in them can give a query.

        A share is tf / (tf + norm). If documents have become longer on average since the segment was written, norms have
        shrunk, by no more than the ratio r of the averages; a share s is then at most s / (s + r (1 - s)).
        """
        now = self._avgdl(state)
        ratios = [(s, f, min(1.0, segment["avgdl"][f] / now[f])) for s, segment in state["segments"].items() for f in FIELDS]
        ratio = self.spark.createDataFrame(ratios, "segment string, field string, ratio double")  # three rows a segment
        best = F.col("top") / (F.col("top") + F.col("ratio") * (1 - F.col("top")))
        return heads.join(F.broadcast(ratio), ["segment", "field"]).join(weights, ["field", "term"]).select(
            "query_id", *KEYS, (F.col("idf") * (search.K1 + 1) * best * (1 + 1e-9)).alias("bound"))

    def _scores(self, read: DataFrame, weights: DataFrame, state: dict, limit: int) -> DataFrame:
        """Ranked documents from the blocks in ``read`` (query_id and KEYS)."""
        places = [(r[0], r[1]) for r in read.select("bucket", "level").distinct().collect()]  # no more than buckets x levels
        rows = self._blocks(list(state["segments"]))
        rows = rows.where(F.concat_ws(" ", "bucket", "level").isin([f"{b} {v}" for b, v in places]))
        found = rows.join(read.select("query_id", *KEYS), KEYS).select(
            "query_id", "segment", "field", "term", "user_id", F.explode("entries").alias("e")).select(
            "query_id", "segment", "field", "term", "user_id", "e.id", "e.tf", "e.dl")
        found = self._alive(found, state)
        mean = F.create_map(*[x for f, a in self._avgdl(state).items() for x in (F.lit(f), F.lit(a))])[F.col("field")]
        part = F.col("idf") * F.col("tf") * (search.K1 + 1) / (F.col("tf") + _norm(F.col("field"), F.col("dl"), mean))
        hits = found.join(weights, ["query_id", "field", "term"]).withColumn("part", part)
        fields = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("part"))), F.lit(0.0)) * b for f, b in search.BOOSTS.items()]
        scored = hits.groupBy("query_id", "user_id", "id").agg(F.round(F.greatest(*fields), 6).alias("score"))
        return search.top_per_user(scored, limit)

    # ---- phrases with a prefix -----------------------------------------------------------------

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        """Each user's titles that hold the words in order, the last as a prefix; as ``search.search_suggest``."""
        _, state = self.state()
        words = search._split_words(prefix)
        if not words or not state["segments"]:
            return self.spark.createDataFrame([], "id bigint, user_id bigint, title string, n_words int, pos int")
        names = list(state["segments"])
        # sorted files: only those whose range holds the prefix are read
        ends = self._terms(names).where((F.col("field") == "title") & F.col("term").startswith(words[-1])).select(
            "term", F.lit(len(words) - 1).alias("offset")).distinct()
        if words[:-1]:
            fixed = self.spark.createDataFrame(list(zip(words, range(len(words) - 1))), "term string, offset int")
            ends = ends.unionByName(fixed)
        wanted = ends.withColumn("bucket", search._bucket(self.buckets))
        asked = [r[0] for r in wanted.select("bucket").distinct().collect()]  # no more than buckets
        rows = self._blocks(names).where(F.col("bucket").isin(asked) & (F.col("field") == "title"))
        spots = rows.join(wanted, ["bucket", "term"]).select("segment", "user_id", "offset", F.explode("entries").alias("e")).select(
            "segment", "user_id", "e.id", "e.dl", "offset", F.explode("e.positions").alias("at"))
        starts = self._alive(spots, state).groupBy("id", "user_id", "segment", "dl", (F.col("at") - F.col("offset")).alias("start")).agg(
            F.count_distinct("offset").alias("met")).where(F.col("met") == len(words))
        hits = starts.select("id", "user_id", "segment", F.col("dl").alias("n_words")).distinct()
        top = page_per_key(hits, "user_id", [F.col("n_words"), F.col("id")], limit)
        titles = self._docs(state).select("segment", "id", "title")
        return top.join(titles, ["segment", "id"]).select("id", "user_id", "title", "n_words", "pos")


def _blocked(size: int):
    """Blocks of postings that come by group, largest share first."""
    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for name in GROUP:
            codes = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def made(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lengths = np.diff(np.append(first, rows.num_rows))
        number = -(-lengths // size)
        block = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        at = np.repeat(first, number) + block * size
        bounds = np.append(at, rows.num_rows)
        fields = ["id", "tf", "dl", "positions"]
        struct = pa.StructArray.from_arrays([rows.column(c).chunk(0) for c in fields], fields)
        heads = rows.take(pa.array(at))
        columns = {c: heads.column(c).combine_chunks() for c in GROUP} | {
            "block": pa.array(block.astype(np.int32)), "n": pa.array(np.diff(bounds)), "top": heads.column("share").combine_chunks(),
            "entries": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), struct)}
        names = ["field", "term", "user_id", "salt", "block", "n", "top", "entries", "bucket", "level"]
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held else rows
            first = starts(rows)
            if first[-1]:
                yield made(rows.slice(0, first[-1]), first[:-1])
            held = rows.slice(first[-1])
        if held:
            yield made(held, np.zeros(1, np.int64))
    return blocked


def _norm(field: Column, dl: Column, mean: Column) -> Column:
    return F.when(field == "tags", F.lit(search.K1)).otherwise(search.K1 * (1 - search.B + search.B * dl / mean))
