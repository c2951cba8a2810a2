"""Long exact spans shared between records (problem 9).

A token is a shingle of ``K`` characters, hashed at every position.  The
Cartesian tree over the hashes of a text yields its compact windows: a node
with centre c and extent [l, r] stands for every run of tokens in [l, r] that
holds c, all of which have the min-hash of c.  A verbatim span of ``min_chars``
characters is the same run of at least ``width`` tokens in each text that has
it, so its windows share their centre's hash: one hash function finds every
such span.  Windows are joined on that hash, and the texts around the centres
are compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import pairs_within, spread
from quaymark.session import cut_table

MIN_CHARS = 200
K = 100

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """Hash of chars[i : i + k] for every i: sums over powers of two are doubled, then put together by k's binary digits."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        block = _mix(chars.astype(np.uint64) + np.uint64(0x51ED270B))  # hash of 1 << j characters from i on
        power, size = _BASE, 1
        out, done = np.zeros(n, np.uint64), 0
        while size <= k:
            if k & size:
                out = out * power + block[done : done + n]
                done += size
            if size * 2 <= k:
                block = block[: len(block) - size] * power + block[size:]
                power = power * power
            size *= 2
        return _mix(out)


def compact_windows(hashes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, further) of all compact windows of at least ``width`` tokens; of equal hashes the first one is the centre.

    All places of a segment's smallest hash are taken at once.  In a periodic
    text they are equally far apart, nearer than a token is long, and those
    whose surroundings lie inside the period are all alike: such a run is one
    centre, the first of them, and ``further`` is how far the last one lies
    behind it (0 for any other centre).
    """
    stack = [(0, len(hashes))]
    if len(np.unique(hashes)) == len(hashes):
        single: list[int] = []
        while stack:
            lo, hi = stack.pop()
            if hi - lo >= width:
                c = lo + int(hashes[lo:hi].argmin())
                single.append(c)
                stack.append((lo, c))
                stack.append((c + 1, hi))
        return np.array(single, np.int64), np.zeros(len(single), np.int64)
    out: list[np.ndarray] = []
    more: list[np.ndarray] = []
    while stack:
        lo, hi = stack.pop()
        if hi - lo < width:
            continue
        part = hashes[lo:hi]
        c = np.flatnonzero(part == part.min()) + lo
        # the segment that each place is the smallest of begins behind the place before it
        begin = np.r_[lo, c[:-1] + 1]
        stack += [(int(a), int(z)) for a, z in zip(begin, c) if z - a >= width]
        if hi - c[-1] - 1 >= width:
            stack.append((int(c[-1]) + 1, hi))
        c = c[hi - begin >= width]
        at, further = _runs(c, k, width - 1)
        out.append(at)
        more.append(further)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(more)


def _runs(c: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres with the inner ones of a periodic run as one."""
    if len(c) < 3:
        return c, np.zeros(len(c), np.int64)
    gap = np.diff(c)
    edge = np.flatnonzero(np.r_[True, (gap[1:] != gap[:-1]) | (gap[1:] > k)])  # a run of equal gaps from c[edge] on
    last = np.r_[edge[1:], len(gap)]  # and to c[last]
    keep, further = np.ones(len(c), bool), np.zeros(len(c), np.int64)
    for i, j in zip(edge, last):
        if j - i >= 2 and gap[i] <= k:
            inner = i + np.flatnonzero((c[i : j + 1] >= c[i] + reach) & (c[i : j + 1] <= c[j] - reach))
            if len(inner) > 1:
                keep[inner[1:]] = False
                further[inner[0]] = c[inner[-1]] - c[inner[0]]
    return c[keep], further[keep]


def text_classes(docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, rep_id, n_chars: documents of equal text have the smallest id of them as representative.

    Null texts and texts shorter than a span are left out: they share nothing.
    So are null ids.  Equal texts are told by two 64-bit hashes and the length.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), F.reverse(F.col(text))).alias("h2"), F.length(text).alias("n_chars")).where(f"doc_id is not null and n_chars >= {min_chars}")
    reps = d.groupBy("h1", "h2", "n_chars").agg(F.min("doc_id").alias("rep_id"))
    return d.join(reps, ["h1", "h2", "n_chars"]).select("doc_id", "rep_id", "n_chars").distinct()


def window_table(docs: DataFrame, k: int, min_chars: int) -> DataFrame:
    """h, doc_id, pos, further of all compact windows of (doc_id, text)."""
    width = min_chars - k + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs, ids, at, more = [], [], [], []
            for doc, t in zip(pdf["doc_id"], pdf["text"]):
                h = shingle_hashes(code_points(t), k)
                c, further = compact_windows(h, width, k)
                more.append(further)
                hs.append(h[c])
                ids.append(np.full(len(c), doc, np.int64))
                at.append(c)
            if hs:
                yield pd.DataFrame({"h": np.concatenate(hs).view(np.int64), "doc_id": np.concatenate(ids), "pos": np.concatenate(at).astype(np.int32), "further": np.concatenate(more).astype(np.int32)})

    return docs.mapInPandas(run, "h long, doc_id long, pos int, further int")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _extents(pa: pd.Series, oa: pd.Series, pb: pd.Series, ob: pd.Series) -> pd.DataFrame:
    """Characters that two parts have in common before and from their centres on."""
    left = [_common(x[:i][::-1], y[:j][::-1]) for x, i, y, j in zip(pa, oa, pb, ob)]
    right = [_common(x[i:], y[j:]) for x, i, y, j in zip(pa, oa, pb, ob)]
    return pd.DataFrame({"left": np.array(left, np.int32), "right": np.array(right, np.int32)})


class SharedSpans:
    """Verified spans of at least ``min_chars`` characters that documents of different text have in common.

    ``members``: cid, doc_id, pos, start, size, further: a window's
    surroundings, at least ``min_chars`` characters; members of one cid have
    them in common.  ``further`` > 0: the same again up to so many characters
    behind, as a periodic text has it.
    ``links``: cid_a, cid_b, left, right: what the surroundings of two classes
    have in common around their centres, ``min_chars`` characters at least.
    ``copies``: doc_id, rep_id, n_chars of equal texts; only representatives
    have members.  A pair of different texts shares a span exactly if it shares
    a class or its classes are linked.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, k: int = K, min_chars: int = MIN_CHARS, hot: int = 64, block: int = 2048) -> None:
        reach = min_chars - k
        self.copies = cut_table(text_classes(docs, key, text, min_chars))
        surplus = self.copies.where("doc_id <> rep_id").select("doc_id")
        # one row for an id: a repeated id with other text would be two documents of one name
        src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(f"doc_id is not null and length(text) >= {min_chars}").join(surplus, "doc_id", "left_anti")
        windows = cut_table(window_table(src, k, min_chars))
        shared = windows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
        per_doc = windows.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "further")).alias("hits"))  # about a hit for 50 characters, runs as one
        around = (
            src.join(per_doc, "doc_id")
            .select("doc_id", "text", F.explode("hits").alias("w"))
            .select("doc_id", "w.h", "w.pos", "w.further", F.greatest(F.col("w.pos") - reach, F.lit(0)).alias("start"), "text")
            .withColumn("part", F.expr(f"substring(text, start + 1, pos - start + {k + reach})"))
            .select("doc_id", "h", "pos", "further", "start", F.length("part").alias("size"), F.xxhash64("h", F.col("pos") - F.col("start"), "part").alias("cid"), "part")
        )
        around = cut_table(around)
        self.members = around.select("cid", "doc_id", "pos", "start", "size", "further")
        classes = around.groupBy("cid").agg(F.first("h").alias("h"), F.first(F.col("pos") - F.col("start")).alias("off"), F.first("part").alias("part"))
        many = classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
        classes = classes.join(many, "h")
        # where very many classes share a hash, they must also share some 3/4 of what is to be found around it
        q = reach // 4
        keys = F.when(F.col("m") <= hot, F.array(F.col("h"))).otherwise(
            F.array(*[F.xxhash64("h", F.lit(j), F.expr(f"substring(part, off + 1 - {j}, {j})"), F.expr(f"substring(part, off + {k} + 1, {3 * q - j})")) for j in (0, q, 2 * q, 3 * q)])
        )
        salts = F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int")
        side = classes.withColumn("salts", salts).select("cid", "off", "part", "salts", F.explode(keys).alias("g"))
        a = side.select("g", F.pmod("cid", F.col("salts").cast("long")).cast("int").alias("s"), F.col("cid").alias("cid_a"), F.col("off").alias("off_a"), F.col("part").alias("part_a"))
        b = side.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.col("cid").alias("cid_b"), F.col("off").alias("off_b"), F.col("part").alias("part_b"))
        pairs = a.join(b, ["g", "s"]).where("cid_a < cid_b").withColumn("e", F.pandas_udf(_extents, "struct<left:int,right:int>")("part_a", "off_a", "part_b", "off_b"))
        self.links = cut_table(pairs.where(f"e.left + e.right >= {min_chars}").select("cid_a", "cid_b", "e.left", "e.right").distinct())

    def text_pairs(self, block: int = 2048) -> DataFrame:
        """rep_a, rep_b, cid_a, cid_b of representatives that share a span; several rows for a pair with several windows."""
        one = self.members.select("cid", "doc_id").distinct()
        same = pairs_within(cut_table(one), "cid", "doc_id", "rep_a", "rep_b", block).select("rep_a", "rep_b", F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"))
        linked = self._linked("doc_id", block=block).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), "cid_a", "cid_b").where("x <> y").distinct()
        return same.unionByName(linked.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "cid_a", "cid_b"))

    def _linked(self, *columns: str, block: int = 2048) -> DataFrame:
        """links with a and b, members of their classes; a large class is dealt out on one side and copied on the other."""
        m = self.members.withColumnRenamed("cid", "cid_a").select("cid_a", F.struct(*columns).alias("a"))
        n = self.members.withColumnRenamed("cid", "cid_b").select("cid_b", F.struct(*columns).alias("b"))
        sizes = self.members.groupBy("cid").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
        if (sizes.agg(F.max("salts").alias("s")).first()["s"] or 0) <= 1:
            return self.links.join(m, "cid_a").join(n, "cid_b")
        large = sizes.where("salts > 1")
        salts = lambda df, cid: df.join(large.withColumnRenamed("cid", cid), cid, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        copied = lambda df: df.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        dealt = lambda df, *by: df.withColumn("s", F.pmod(F.xxhash64(*by), F.col("salts")).cast("int")).drop("salts")
        left = copied(salts(self.links, "cid_a")).join(dealt(salts(m, "cid_a"), "a"), ["cid_a", "s"]).drop("s")
        return dealt(salts(left, "cid_b"), "a", "cid_a").join(copied(salts(n, "cid_b")), ["cid_b", "s"]).drop("s")

    def document_pairs(self) -> DataFrame:
        """doc_id_a, doc_id_b (the smaller first): every pair of documents with a common span, copies included."""
        reps = self.text_pairs().select("rep_a", "rep_b").distinct()
        a, b = self.copies.select(F.col("rep_id").alias("rep_a"), F.col("doc_id").alias("x")), self.copies.select(F.col("rep_id").alias("rep_b"), F.col("doc_id").alias("y"))
        other = reps.join(a, "rep_a").join(b, "rep_b")
        equal = pairs_within(self.copies, "rep_id", "doc_id", "x", "y")
        return other.select("x", "y").unionAll(equal.select("x", "y")).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def passage_classes(self) -> DataFrame:
        """cid, n_docs, n_chars, first_doc, first_start, n_links: every shared window class with its size, without pairs.

        ``n_links`` is the number of other classes with which its surroundings
        share a span; together with ``copies`` and ``links`` this is what the
        pairs are made from.
        """
        both = self.links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        m = self.members.groupBy("cid").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("size").alias("n_chars"), F.min(F.struct("doc_id", "start")).alias("f"))
        out = m.join(both, "cid", "left").where("n_docs > 1 or n_links is not null")
        return out.select("cid", "n_docs", F.col("n_chars").cast("long").alias("n_chars"), F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_start"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def passages(self) -> DataFrame:
        """doc_id_a, doc_id_b, start_a, start_b, n_chars: the longest common spans of representatives, doc_id_a < doc_id_b.

        A window's surroundings are bounded; those of one pair that overlap on
        the same diagonal belong to one passage.  Periodic runs are held against
        each other from their first places on, not at every shift of the period.
        """
        m = self.members.select("cid", "doc_id", "start", (F.col("size") + F.col("further")).alias("n"))
        x, y = spread(m, "cid", ["doc_id", "start"])
        x, y = x.select("cid", "__s", F.col("doc_id").alias("da"), F.col("start").alias("sa"), F.col("n").alias("na")), y.select("cid", "__s", F.col("doc_id").alias("db"), F.col("start").alias("sb"), F.col("n").alias("nb"))
        same = x.join(y, ["cid", "__s"]).where("da < db").select("da", "db", "sa", "sb", F.least("na", "nb").alias("n"))
        linked = self._linked("doc_id", "pos").select(F.col("a.doc_id").alias("da"), F.col("b.doc_id").alias("db"), (F.col("a.pos") - F.col("left")).alias("sa"), (F.col("b.pos") - F.col("left")).alias("sb"), (F.col("left") + F.col("right")).alias("n")).where("da <> db")
        swap = F.col("da") > F.col("db")
        linked = linked.select(F.least("da", "db").alias("da"), F.greatest("da", "db").alias("db"), F.when(swap, F.col("sb")).otherwise(F.col("sa")).alias("sa"), F.when(swap, F.col("sa")).otherwise(F.col("sb")).alias("sb"), "n")
        pieces = same.unionByName(linked).withColumn("diag", F.col("sa") - F.col("sb"))
        by = W.partitionBy("da", "db", "diag").orderBy("sa")
        reach = F.max(F.col("sa") + F.col("n")).over(by.rowsBetween(W.unboundedPreceding, -1))
        merged = pieces.withColumn("reach", reach).withColumn("island", F.sum(F.coalesce((F.col("sa") > F.col("reach")).cast("int"), F.lit(1))).over(by))
        return merged.groupBy("da", "db", "diag", "island").agg(F.min("sa").alias("start_a"), F.min("sb").alias("start_b"), (F.max(F.col("sa") + F.col("n")) - F.min("sa")).alias("n_chars")).select(
            F.col("da").alias("doc_id_a"), F.col("db").alias("doc_id_b"), "start_a", "start_b", F.col("n_chars").cast("long").alias("n_chars")
        )

    def coverage(self) -> DataFrame:
        """doc_id, n_chars, shared_chars, shared_share: how much of each document stands in another one.

        A text with a copy is shared as a whole.  Documents shorter than a span
        are not listed.  The union is taken over windows, never over pairs, so
        a passage in very many documents costs no more than its rows.
        """
        m = self.members
        wide = m.groupBy("cid").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("cid")
        whole = m.join(wide, "cid", "left_semi").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("size") + F.col("further")).alias("e"))
        # per class the documents on the other side: one with another id is enough
        both = self.links.select(F.col("cid_a").alias("cid"), F.col("cid_b").alias("other"), "left", "right").unionByName(self.links.select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("other"), "left", "right"))
        ends = m.groupBy("cid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumnRenamed("cid", "other")
        part = m.join(both.join(ends, "other"), "cid").where("doc_id <> lo or doc_id <> hi").select("doc_id", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right") + F.col("further")).alias("e"))
        spans = whole.unionByName(part).distinct()
        by = W.partitionBy("doc_id").orderBy("s", "e")
        upto = F.coalesce(F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        fresh = spans.withColumn("upto", upto).select("doc_id", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "upto")).alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("fresh"))
        size = self.copies.groupBy("rep_id").agg(F.count("*").alias("same"))
        docs = self.copies.join(size, "rep_id").join(fresh.withColumnRenamed("doc_id", "rep_id"), "rep_id", "left")
        shared = F.when(F.col("same") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("fresh", F.lit(0).cast("long")))
        return docs.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), (shared / F.col("n_chars")).alias("shared_share"))
