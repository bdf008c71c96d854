"""Main text of web pages by deducing the template of each host.

A page is a row of tokens: its elements, told apart by their path, and its pieces of text, told apart by path and wording.
Over all pages of a host, tokens with the same occurrence vector (how often in which page) form an equivalence class, valid
if its tokens keep their order on all pages. The class that occurs once in every page is the root. Its tokens cut each page
into slots, and the roles of all other tokens are told apart by their slot, so that a text that stands twice on a page is
two tokens. Tokens that are now once in every page join the root; other classes (parts of some pages only, or repeated
parts) are nested in the slot in which they stand and cut it further. This goes on until a round finds nothing. Text in a
valid class is fixed. What is left of a page's main region, and in no region of another kind, is its text.

Vectors are never built: hashes over (page, count) taken together stand for one, so a host with a third of all pages is
summed up inside each task first. Python scans single pages only.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.tables import stored
from linkloom.llm.urls import parts

# Element names of the HTML standard by the part they play.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
OTHER = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
ENDED_BY_LIKE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # a new one ends an open one
OTHER_NAME = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumb\w*|header|masthead|footer|"
    r"sidebar|side|aside|widget\w*|related|share|sharing|social|comment\w*|disqus\w*|reply|replies|cookie\w*|consent|"
    r"notice\w*|popup|modal|newsletter|subscribe|signup|login|search|pagination|pager|skip)(?:$|[-_\s])", re.I)
OTHER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
SPECIAL = re.compile("[>\"']")
TEXT = re.compile(r"[^<]+")
PLAIN_TAG = re.compile(r"<(?!!--)[a-zA-Z/!?][^<>\"']*(?:(?:\"[^\"<]*\"|'[^'<]*')[^<>\"']*)*>")  # looks no further than the next <
NAME = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumb\w*|header|masthead|footer|"
    r"sidebar|side|aside|widget\w*|related|share|sharing|social|comment\w*|disqus\w*|reply|replies|cookie\w*|consent|"
    r"notice\w*|popup|modal|newsletter|subscribe|signup|login|search|pagination|pager|skip)(?:$|[-_\s])", re.I)
OTHER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
PIECE = re.compile(r"<!--.*?(?:-->|$)|<(?=[a-zA-Z/!?])[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|<|[^<]+", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


@lru_cache(1 << 16)
def _path(parent: str, name: str, label: str) -> str:
    path = f"{parent}/{name}" + (f".{label}" if label else "")
    return path if len(path) <= 500 else hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=12).hexdigest()


class Pieces:
    """Tags, comments and text of a page, in time linear in its length however malformed it is.

    A tag ends at the first ``>`` outside quotes; a ``<`` whose tag never ends is text. Where a search for that end has failed,
    the places that it passed outside quotes are known to fail, so no part of the page is searched twice in vain.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.special = (0, -1)  # from here on, the next special character is there

    def _next_special(self, at: int) -> int:
        start, found = self.special
        if not start <= at <= found:
            match = SPECIAL.search(self.page, at)
            found = match.start() if match else len(self.page)
            self.special = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """The place after the tag that begins at ``at``, or 0."""
        passed, here = [], at
        while here not in self.dead:
            passed.append(here)
            found = self._next_special(here)
            if found == len(self.page):
                break
            if self.page[found] == ">":
                return found + 1
            closing = self.page.find(self.page[found], found + 1)
            if closing < 0:
                break
            here = closing + 1
        self.dead.update(passed)
        return 0

    def __iter__(self) -> Iterator[str]:
        """All pieces; the reader may move on by setting ``at``."""
        page, self.at = self.page, 0
        while self.at < len(page):
            at = self.at
            if page[at] != "<":
                self.at = TEXT.match(page, at).end()
            elif plain := PLAIN_TAG.match(page, at):
                self.at = plain.end()
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = end + 3 if end >= 0 else len(page)
            else:
                after = page[at + 1:at + 2]
                tag = after and (after in "/!?" or after.isascii() and after.isalpha())
                self.at = (self.tag_end(at) if tag else 0) or at + 1
            yield page[at:self.at]


def blocks_of(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """Elements as (path, "", ...) and blocks of text as (path, text, in another region, in a main region), in page order.

    A path names the elements that are open, with their labels; a long one is a digest, so that deep pages stay linear.
    """
    opened: list[tuple[str, str, bool, bool]] = []  # name, path, other, main
    names: Counter = Counter()  # how many elements of a name are open
    words: list[str] = []
    path, other, main = "", False, False

    def block():
        text = SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        return [(path, text, other, main)] if text else []

    def close():
        name = opened.pop()[0]
        names[name] -= 1
        return name

    pieces = Pieces(page)
    for piece in pieces:
        if piece[0] != "<" or piece == "<":
            words.append(piece)
            continue
        named = NAME.match(piece)
        if not named:
            continue  # a comment, a declaration or an empty tag
        name = named.group(1).lower()
        if name in INLINE:
            continue
        if name in VOID:
            words.append(" ")
            continue
        yield from block()
        if piece[1] == "/":
            if names[name]:
                while close() != name:
                    pass
        else:
            if name in ENDED_BY_LIKE and opened and opened[-1][0] == name:
                close()
            elif opened and opened[-1][0] == "p":
                close()
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pieces.at)
                pieces.at = end.end() if end else len(page)
            elif not piece.endswith("/>"):
                marks = {m[0].lower(): m[1] or m[2] or m[3] for m in MARKS.findall(piece[named.end():])}
                label = f"{marks.get('class', '')} {marks.get('id', '')}".strip()
                _, path, other, main = opened[-1] if opened else ("", "", False, False)
                other = other or name in OTHER or "hidden" in marks or marks.get("role", "").lower() in OTHER_ROLE or (
                    name not in MAIN and name not in {"body", "html"} and bool(OTHER_NAME.search(label)))
                path = _path(path, name, label)
                opened.append((name, path, other, main or name in MAIN or marks.get("role", "").lower() == "main"))
                names[name] += 1
                yield path, "", other, main
        _, path, other, main = opened[-1] if opened else ("", "", False, False)
    yield from block()


def token(path: str, text: str) -> str:
    return f"{path}\n{text}" if text else path


def identity(path: str, text: str = "") -> int:
    """The first role of a token: a 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(token(path, text).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_element = lru_cache(1 << 16)(identity)


def _main(blocks: list[tuple[str, str, bool, bool]], fixed: list[bool]) -> str:
    has_main = any(t and main and not other for _, t, other, main in blocks)  # a comment or teaser may be an <article> too
    return "\n".join(t for (_, t, other, main), gone in zip(blocks, fixed)
                     if t and not other and (main or not has_main) and not gone)


def main_text(page: str, fixed: set[str]) -> str:
    """The blocks of the main regions, or of all of the page without one, that are neither fixed nor in another region."""
    blocks = [*blocks_of(page)]
    return _main(blocks, [token(p, t) in fixed for p, t, _, _ in blocks])


def members_of(roles: list[int], rounds: list[dict[int, int]]) -> list[bool]:
    """Which tokens of a page belong to its host's template; ``rounds`` has the roles that each round found, with their marks.

    Between two rounds the role of every other token is told apart by the mark before it, as ``_told_apart`` does in Spark.
    """
    roles, marks = list(roles), [None] * len(roles)
    for found in rounds:
        at = 0
        for place, role in enumerate(roles):
            if marks[place] is None:
                marks[place] = found.get(role)
                if marks[place] is None:
                    roles[place] = role ^ _turned(at)
            if marks[place] is not None:
                at = marks[place]
    return [mark is not None for mark in marks]


TURN = 23


def _turned(mark: int) -> int:
    """A signed 64-bit mark with its bits turned by TURN."""
    bits = mark & (1 << 64) - 1
    bits = (bits << TURN | bits >> 64 - TURN) & (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _identities(blocks: list[tuple[str, str, bool, bool]]) -> list[int]:
    return [identity(path, text) if text else _element(path) for path, text, _, _ in blocks]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"row": pa.int64(), "host": pa.string(), "page": pa.int64(), "place": pa.int32(), "n": pa.int32(), "id": pa.int64(),
             "own": pa.int64()}
    for batch in batches:
        out = {name: [] for name in kinds}
        for row, host, page in zip(*[batch.column(c).to_pylist() for c in ("row", "host", "html")]):
            blocks = [*blocks_of(page)]
            ids = _identities(blocks)
            same = hashlib.blake2b(np.array(ids, np.int64).tobytes(), digest_size=8).digest()
            counts = Counter(ids)  # with the first token of an identity
            out["row"] += [row] * len(ids)
            out["host"] += [host] * len(ids)
            out["page"] += [int.from_bytes(same, "little", signed=True)] * len(ids)
            out["place"] += range(len(ids))
            out["n"] += [counts.pop(one, None) for one in ids]
            out["id"] += ids
            out["own"] += [_element(path) if text else 0 for path, text, _, _ in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], [*kinds])


def _told_apart(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """The tokens after a round: those of its classes have their mark, the others a role by the mark that stands before them."""
    marked = tokens.join(found.select("host", "role", F.col("mark").alias("new")), ["host", "role"], "left").withColumn(
        "mark", F.coalesce("mark", "new")).drop("new")
    before = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0).cast("long"))
    turned = F.shiftleft("at", TURN).bitwiseOR(F.shiftrightunsigned("at", 64 - TURN))
    return marked.withColumn("at", at).withColumn(
        "role", F.when(F.col("mark").isNull(), F.col("role").bitwiseXOR(turned)).otherwise(F.col("role")))


def _frequent(counts: DataFrame, pages: DataFrame, min_pages: int) -> DataFrame:
    """The roles on ``min_pages`` pages or more, with their vectors; ``counts`` has host, role, row, n.

    Roles are only ever told further apart, so one that is not frequent now never will be.
    """
    vectors = counts.groupBy("host", "role").agg(F.bit_xor(F.xxhash64("row", "n")).alias("vector"), F.count(F.lit(1)).alias("on"))
    root = (F.col("vector") == F.col("once")) & (F.col("on") == F.col("pages"))
    return stored(vectors.where(F.col("on") >= min_pages).join(pages, "host").select("host", "role", "vector", "on", "least", root.alias("root")))


def _nested(tokens: DataFrame, frequent: DataFrame) -> DataFrame:
    """Classes that may be nested: tokens with the same vector and the same mark before them, so they lie in one slot."""
    some = frequent.where("NOT root AND on >= least").drop("root")
    # different pages are told apart before they meet, so a host's roles have no task of their own
    once = tokens.where("mark IS NULL").join(some, ["host", "role"]).groupBy("host", "role", "vector", "on", "least", "page").agg(
        F.first("at").alias("at"), F.first("own").alias("own"))
    facts = once.groupBy("host", "role", "vector", "on", "least").agg(
        F.first("at").alias("at"), F.first("own").alias("own"), F.count(F.lit(1)).alias("support")).where("support >= least")
    named = stored(facts.select("host", "role", F.xxhash64("vector", "on", "at").alias("class"), "own", "on"))
    few = named.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("own") == 0).alias("elements"))
    return named.join(few.where("size > 1 AND elements > 0"), ["host", "class"], "left_semi").select(
        "host", "role", "class", F.lit(False).alias("root"), "on")


def _ordered(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """Of classes (host, role, class, root, on) the new tokens that follow the same token of their class on all pages."""
    w = Window.partitionBy("row", "class").orderBy("place")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = tokens.join(members, ["host", "role"]).select(
        "host", "class", "role", "root", "on", "id", "own", "at", "mark", F.lead("role").over(w).isNull().alias("ends"),
        # the tokens of a class that stands several times in a page follow each other in a ring
        F.coalesce(F.lag("role").over(w), F.when(F.col("root"), 0).otherwise(F.last("role").over(whole))).alias("before"))
    return placed.groupBy("host", "class", "role").agg(
        F.min("before").alias("least"), F.max("before").alias("most"), F.max("ends").alias("ends"),
        *[F.first(c).alias(c) for c in ("root", "on", "id", "own", "at", "mark")]).where(
        "least = most AND mark IS NULL")


def _classes(tokens: DataFrame, frequent: DataFrame, first: bool) -> DataFrame:
    """The valid classes of a round: host, role, mark of the tokens that are new in them.

    The root grows first; where it does not, each slot gets the class of the most pages, since others may lie within it.
    """
    root = frequent.where("root").select("host", "role", F.lit(0).cast("long").alias("class"), "root", "on")
    if first:
        return _ordered(tokens, root).select("host", "role", F.col("role").alias("mark"))
    growing = tokens.where("mark IS NULL").join(root, ["host", "role"], "left_semi").select("host").distinct()
    rooted = stored(_ordered(tokens, root.join(growing, "host", "left_semi")).select("host", "role", F.col("role").alias("mark")))
    others = stored(_ordered(tokens, _nested(tokens, frequent).join(rooted.select("host").distinct(), "host", "left_anti")))
    # a text is part of a class in a slot only with the element that holds it
    elements = others.where("own = 0")
    texts = others.where("own <> 0").join(elements.select("host", "class", F.col("id").alias("own")).distinct(),
                                          ["host", "class", "own"], "left_semi")
    others = stored(elements.unionByName(texts.select(elements.columns)))
    sizes = others.groupBy("host", "at", "class").agg(F.max("on").alias("on"), F.count(F.lit(1)).alias("size")).where("size > 1")
    outer = sizes.groupBy("host", "at").agg(F.min_by("class", F.struct(-F.col("on"), "class")).alias("class")).select("host", "class")
    # behind the last token of a class its slot goes on
    return rooted.unionByName(others.join(outer, ["host", "class"], "left_semi").select(
        "host", "role", F.when(F.col("ends"), F.col("at")).otherwise(F.col("role")).alias("mark")))


def templates(rows: DataFrame, min_pages: int, share: float = 0.1) -> DataFrame:
    """Of each host with ``min_pages`` pages or more, its template: columns host, fixed (array of round, role, mark).

    Rounds go on while they find tokens, only for hosts that had some in the round before. A class in a slot of another needs
    ``min_pages`` different pages and this share of the host's.
    """
    named = stored(rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("once")).where(F.col("pages") >= min_pages))
    pages = named.select(F.xxhash64("host").alias("host"), "pages", "once",
                         F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * share)).alias("least"))
    tokens = stored(rows.join(named, "host", "left_semi").mapInArrow(
        _tokens, "row long, host string, page long, place int, n int, id long, own long").withColumn("host", F.xxhash64("host")))
    counts = tokens.where("n IS NOT NULL").select("host", F.col("id").alias("role"), "row", "n")
    tokens = tokens.drop("n").withColumns({"role": F.col("id"), "at": F.lit(0).cast("long"), "mark": F.lit(None).cast("long")})
    rounds = []
    while True:
        frequent = _frequent(counts, pages, min_pages)
        tokens = tokens.join(frequent.select("host", "role"), ["host", "role"], "left_semi")
        rounds.append(found := stored(_classes(tokens, frequent, not rounds)))
        if found.isEmpty():
            break
        tokens = stored(_told_apart(tokens.join(found.select("host").distinct(), "host", "left_semi"), found))
        counts = tokens.groupBy("host", "role", "row").agg(F.count(F.lit(1)).cast("int").alias("n"))
    every = [found.select("host", F.struct(F.lit(n).alias("round"), "role", "mark").alias("one")) for n, found in enumerate(rounds)]
    fixed = reduce(DataFrame.unionByName, every).groupBy("host").agg(F.collect_list("one").alias("fixed"))
    return named.select("host", F.xxhash64("host").alias("hash")).join(fixed.withColumnRenamed("host", "hash"), "hash").drop("hash")


def _fixed(blocks: list[tuple[str, str, bool, bool]], template: list[dict] | None) -> list[bool]:
    if not template:
        return [False] * len(blocks)
    rounds = [{} for _ in range(1 + max(one["round"] for one in template))]
    for one in template:
        rounds[one["round"]][one["role"]] = one["mark"]
    return members_of(_identities(blocks), rounds)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, template in zip(batch.column("html").to_pylist(), batch.column("fixed").to_pylist()):
            blocks = [*blocks_of(page)]
            texts.append(_main(blocks, _fixed(blocks, template)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "url")], pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_pages: int = 10) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; empty pages have no part in a template. Pages with a null URL, or of a host with less than ``min_pages`` pages,
    have no template: regions alone decide. Rows may repeat keys or pages; whole pages are read whatever their length; an
    empty table gives an empty table.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url"),
                        F.coalesce(parts(F.col(url))[0], F.lit("")).alias("host"),
                        F.coalesce(F.col(page), F.lit("")).alias("html"))
    fixed = stored(templates(rows.select("row", "host", "html").where("host <> '' AND html <> ''"), min_pages))
    kind = dict(rows.dtypes)
    return rows.select("key", "url", "host", "html").join(fixed, "host", "left").select("key", "url", "html", "fixed").mapInArrow(
        _extract, f"key {kind['key']}, url string, text string, n_chars long").withColumnRenamed("key", "page_id")
