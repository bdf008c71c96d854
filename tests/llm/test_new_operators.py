"""Hard negatives, filter interactions and byte-level BPE against brute-force versions."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkloom.llm import audit, bytepairs, bytetext, markup, nearsets, negatives, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "a", LONG, LONG + " end", "same same same " * 40, "x" * 5000 + " " + "ab" * 3000, "'s 't 're've x'll ''d '",
         " \n\n  two\t\tthree  \n", "né à ▁ \x0b\x0c ü€😀 <|endoftext|> 12 ٣４ don't I'm we'd", " " * 4000 + "end", "A#B " * 250, "\x1c\x85 x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and keys, clashing and dotted names."""
    rows = [(i, t, "src", "k", 1, "h", "x") for i, t in enumerate(TEXTS)] + [(3, "a", None, "k", 1, "h", "x"), (None, "a", "", None, None, None, "x"),
                                                                    (None, LONG, "other", None, None, None, "x"), (3, "a", None, "k", 1, "h", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, row long, part string, `x.y` string").repartition(3).cache()


# --- hard negatives

def brute_negatives(rows, is_anchor, positives=5, negatives_=5, lower=80, upper=100):
    used = [(k, y, [math.floor(256 * x) for x in v]) for k, v, y in rows if k is not None and y is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (k, y, v) in enumerate(used):
        if not is_anchor(k):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), other, label == y) for j, (other, label, w) in enumerate(used) if j != i)
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            fit = [(n, s) for s, n, alike in scored if not alike and lower * -ps <= 100 * -s <= upper * -ps][:negatives_]
            out += [(k, p, rank, n, -ps, -s) for rank, (n, s) in enumerate(fit, 1)]
    return Counter(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_negatives(spark, block_bytes):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 50 else None, [float(x) for x in rng.normal(0.3, 0.4, 6 if i % 9 else 4)], int(rng.integers(0, 3))) for i in range(240)]
    rows += [(7, rows[8][1], 1)] * 30 + [(20, rows[21][1], 2)] * 3  # ties, repeated rows and anchors
    rows += [(301, None, 1), (302, [0.1, None], 1), (303, [float("nan")] * 3, 1), (304, [float("inf")], 2), (305, [], 1), (306, [0.5], None),
             (310, [3e6, -2e6, 1.0], 1), (311, [3e6, 1e6, 0.25], 1), (312, [2.9e6, 1e5], 2)]  # products beyond 2 ** 53
    frame = spark.createDataFrame([(k, v, y, "x") for k, v, y in rows], "vec_id long, embedding array<double>, label int, anchor string").repartition(5)
    got = negatives.mine(frame, F.col("id") % 10 == 0, block_bytes=block_bytes)
    want = brute_negatives(rows, lambda k: k % 10 == 0)
    assert Counter(tuple(r) for r in got.select(COLUMNS).collect()) == want and len(want) > 100
    assert negatives.mine(frame.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(frame, F.col("id") < 0).count() == 0


def test_keys_sort_as_they_should():
    rng = np.random.default_rng(2)
    a, s, i = rng.integers(0, 5, 500), rng.integers(-3, 3, 500) * (2 ** 62 // 2), rng.integers(-2 ** 63, 2 ** 63 - 1, 500)
    keys = negatives.packed(a, s, 1, i).to_pylist() + negatives.packed(a, s, 0, i).to_pylist()
    told = [negatives.unpacked(k) for k in sorted(keys)]
    assert told == sorted(told, key=lambda k: (k[0], -k[1], k[2], k[3]))
    assert {(x, y, z) for x, y, _, z in told} == set(zip(a.tolist(), s.tolist(), i.tolist()))


def test_score_beyond_a_long_is_an_error(spark):
    frame = spark.createDataFrame([(0, [1e17], 1), (1, [1e17], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="OverflowError"):
        negatives.mine(frame, F.col("id") == 0).count()


# --- filter interactions

def fails_of(rows):
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    for key, text, part in rows:
        text = text or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        yield key, part or "", (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                                100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text),
                                key is not None and first[text] < key)


def brute_audit(rows, labels):
    labels = [r for r in labels if r[0] is not None]  # no row without a key has a label
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    out, parts = {}, defaultdict(list)
    for key, part, fails in fails_of(rows):
        parts[part].append((key, fails))
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations(range(5)):
            left = docs
            for step, i in enumerate(order, 1):
                here = [d for d in left if d[1][i]]
                left = [d for d in left if not d[1][i]]
                shapley[i] += len(here)
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    len(left), len(here), sum(d[1][i] for d in docs) - len(here), sum(d[1][i] and sum(d[1]) == 1 for d in docs),
                    sum(d[0] in good for d in here), sum(d[0] in toxic for d in here), i]
        for (p, *_), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(frame):
    return {tuple(r)[:3]: tuple(r)[3:] for r in frame.select("part", "filter_order", "step", *audit.COUNTS).collect()}


def test_audit(spark, odd):
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    assert audited(audit.interactions(audit.tally(odd, table))) == brute_audit(rows, labels)
    docs, real = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert audited(audit.interactions(audit.tally(docs, real))) == brute_audit(rows, [tuple(r) for r in real.collect()])
    assert audit.interactions(audit.tally(odd.limit(0), table)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_shares_are_shapley_values(n):
    rng = np.random.default_rng(n)
    value = [0, *map(int, rng.integers(-50, 90, (1 << n) - 1))]
    want = [Fraction(0)] * n
    for order in permutations(range(n)):
        before = 0
        for i in order:
            want[i] += value[before | 1 << i] - value[before]
            before |= 1 << i
    assert audit.Shares(n).of(value) == [w / math.factorial(n) for w in want]


# --- byte-level BPE

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bytepairs.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken")))


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 30_000])
def test_byte_pairs(spark, odd, library, chunk_bytes, monkeypatch):
    for frame in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = bytepairs.decode(bytepairs.encode(frame, chunk_bytes=chunk_bytes))
        got = Counter((r["key"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows.collect())
        want = Counter((r["doc_id"], np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode())
                       for r in frame.select("doc_id", "text").collect())
        assert got == want
    assert bytepairs.decode(bytepairs.encode(odd.limit(0))).count() == 0


def test_pre_tokens(library, monkeypatch):
    """Every cut of made-up texts, long ones cut into pieces too."""
    import random

    monkeypatch.setattr(bytepairs, "PIECE_BYTES", 16)
    rnd = random.Random(1)
    signs = ["a", "b", "s", "t", "r", "e", "v", "l", "d", "m", "'", " ", " ", "\n", "\t", "1", "2", "!", "é", "٣", " ", "中", "😀", "\x1c", "\x85", "'s", "'ll", " '"]
    whole = {bytes([i]): i for i in range(256)}
    for _ in range(1500):
        texts = ["".join(rnd.choices(signs, k=rnd.randrange(30))) for _ in range(rnd.randrange(1, 5))]
        bounds = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        chunk = bytepairs.Chunk()
        cuts = bytepairs._pieces(data, bounds, 16)
        got = [int(s + cuts[lo]) for lo, hi in bytetext.shares(cuts, 16) for s in bytepairs.pre_tokens(data[cuts[lo]:cuts[hi]], cuts[lo:hi + 1] - cuts[lo])]
        # a vocabulary of single bytes tells where the library cuts: it encodes each match on its own
        want = []
        for text, at in zip(texts, bounds):
            for match in __import__("regex").finditer(public_tokenizers.PATTERN, text):
                want.append(int(at) + len(text[:match.start()].encode()))
        assert got == want, texts
    assert chunk.size == 0 and whole


def test_decoding_of_odd_ids(spark):
    kind = "n int, ids binary, decoded2 string"
    pack = lambda *ids: np.array(ids, "<u4").tobytes()
    frame = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, pack(50255, 0), "x")], kind)
    got = {r["n"]: r["decoded"] for r in bytepairs.decode(frame).collect()}
    table, at, size = bytepairs.token_table(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spelled = b"".join(table[at[i]:at[i] + size[i]].tobytes() for i in (50255, 0))
    assert got == {1: None, 2: b"", 3: spelled}
    with pytest.raises(Exception, match="an id that the vocabulary does not have"):
        bytepairs.decode(spark.createDataFrame([(1, pack(60000), "x")], kind)).count()


def test_long_words_are_kept_apart():
    """Two long strings that a polynomial hash modulo 2 ** 64 cannot tell apart."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    data, n = np.frombuffer((a + b).encode(), np.uint8), len(a)
    starts, ends = np.array([0, n]), np.array([n, 2 * n])
    plain = bytetext.range_hash(bytetext.prefix_hash(data), starts, ends)
    assert plain[0] == plain[1]
    assert len(set(bytetext.sure_hash(data, starts, ends).tolist())) == 2


def test_full_tables(spark, library):
    """op13 over its whole table, against the library."""
    got = {tuple(r) for r in queries.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode_ordinary(r["text"])
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert got == want


def test_clashing_column_names(spark, tmp_path):
    """Columns with dots, and with the names that operators use inside, pass through; from files and from memory."""
    from linkloom.llm import naming, windows

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 7, 1, "a", 5), (2, text, 7, 2, "b", 5), (3, "other", 7, 3, "c", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __linkloom_row long, row long, `x.y` string, doc long")
    frame.write.parquet(str(tmp_path / "t"))
    for docs in (frame, spark.read.parquet(str(tmp_path / "t"))):
        kept = naming.drop_copies(docs)
        assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
        cut = windows.drop_repeats(docs).select("doc.doc_id", "doc.`x.y`", "n_removed").collect()
        assert sorted(tuple(r) for r in cut) == [(1, "a", 0), (2, "b", 30), (3, "c", 0)]


def test_template_classes_are_told_apart_by_slot_and_nested(spark):
    """Text that stands twice on a page, in repeated items or on one page type is found; copies of an article stay."""
    page = ("<body><div class=top>Hot news</div><div class=main><p>Own {0} a.</p><p>Own {0} b.</p></div>"
            "<div class=top>Hot news</div>{1}</body>")
    items = "".join("<div class=item><div class=more>Read on</div><div class=what>thing {0} %d</div></div>" % n for n in range(2))
    typed = "<div class=type><div class=say>Only on this type</div><div class=of>kind {0}</div></div>"
    copied = "<p>Copied text.</p><p>More copied text.</p>"
    rows = []
    for i in range(60):
        extra = items if i % 2 else ""
        extra += typed.format(i) if i % 3 == 0 else ""
        extra += copied if i % 5 == 0 else ""
        rows.append((i, f"http://a.com/{i}", page.format(i, extra.format(i))))
    got = {r[0]: r[2].split("\n") for r in markup.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        want = [f"Own {i} a.", f"Own {i} b."] + ([f"thing {i} 0", f"thing {i} 1"] if i % 2 else [])
        want += ([f"kind {i}"] if i % 3 == 0 else []) + (["Copied text.", "More copied text."] if i % 5 == 0 else [])
        assert got[i] == want


def test_nodes_that_stay_large_lose_no_pair(spark, monkeypatch):
    """All documents share the coordinate that the only node branches by; only the two of a pair are near each other."""
    monkeypatch.setattr(nearsets, "DEPTH", 1)
    monkeypatch.setattr(nearsets, "LEAF", 8)
    monkeypatch.setattr(nearsets, "PIVOTS", 1)
    monkeypatch.setattr(nearsets, "BLOCK", 16, raising=False)
    taken = spark.range(1).select(F.pmod(F.xxhash64(F.lit(1).cast("long"), F.lit(0)), F.lit(64))).first()[0]
    rows = []
    for pair in range(24):
        own = np.random.default_rng(pair).integers(1, 1 << 30, 64)
        own[(taken + np.arange(30)) % 64] = 7
        rows += [(2 * pair, own.tolist()), (2 * pair + 1, own.tolist())]
    signed = spark.createDataFrame(rows, "row long, signature array<int>")
    got = {(r.a, r.b) for r in nearsets._candidates(signed, 1, 1.0).collect()}
    assert {(max(p), min(p)) for p in got} == {(2 * i + 1, 2 * i) for i in range(24)}


def test_crowd_gives_each_document_one_link(spark, monkeypatch):
    """A crowd meets in every node of every tree; what is known of it is one link a document, not one of each meeting."""
    monkeypatch.setattr(nearsets, "DEPTH", 2)
    monkeypatch.setattr(nearsets, "LEAF", 8)
    monkeypatch.setattr(nearsets, "BLOCK", 16)
    rows = [(row, [*range(40), *np.random.default_rng(row).integers(1000, 1 << 30, 24).tolist()]) for row in range(60)]
    rows += [(100 + row, np.random.default_rng(100 + row).integers(1000, 1 << 30, 64).tolist()) for row in range(5)]
    signed = spark.createDataFrame(rows, "row long, signature array<int>")
    got = nearsets._candidates(signed, 6, 0.85).collect()
    assert sorted((r.a, r.b) for r in got) == [(row, 0) for row in range(1, 60)]
