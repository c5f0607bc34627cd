"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are word n-grams. The
product of the matrix with its transpose counts overlaps; it is never formed
as a whole:

* rows with equal n-gram sets are one class, kept once;
* columns are ordered from rare to common. Two sets of similarity t share
  t * size of either, so they share one of the size - ceil(t * size) + 1
  rarest columns of each: rows enter the product through these alone, and
  rows that share none of them are never compared. N-grams of passages that
  many documents have come last, so they bring no rows together;
* rows so connected form candidate groups. A large group's rows are ordered by
  the least document they are connected through, then by the size of their
  sets, and cut into row blocks in that order, so that blocks hold rows that
  are alike. Two row blocks are multiplied where rows of theirs have such an
  n-gram in common and sets of sizes that may link;
* per such pair, overlap counts are accumulated over column blocks, and rows
  whose size-derived bound is out of reach are discarded on the way.

Each pair of row blocks returns a spanning forest of its links, so the
output is linear however many rows are alike.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import materialize, text_bytes
from batida.llm.components import components, with_least
from batida.llm.decontamination import slices
from batida.llm.repeats import BLOCK, REPLY, REQUEST, bucket_rows, column, mix, reply, send
from batida.llm.substring_dedup import words
from batida.operators.order import row_index

ROWS = 256  # documents of a row block
COLUMNS = 4096  # n-grams of a column block
COMMON = 255  # counts of blocks are told apart up to this
MET = 64  # row blocks with an n-gram in common that one task pairs with the others


def ngram_sets(texts: list[bytes], n: int) -> list:
    """A sorted array of distinct n-gram hashes per text; a text of fewer words is one n-gram, one without words has none."""
    import numpy as np

    sym, off = words([t.lower() for t in texts])
    size = np.diff(off)
    grams = sym.copy()
    for k in range(1, n):
        grams = mix(grams[: len(sym) - k] * np.uint64(0xA24BAED4963EE407) + sym[k : k + len(grams)]) if len(sym) > k else sym[:0]
    out = []
    for i in range(len(texts)):
        a, b = off[i], off[i + 1]
        if size[i] >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif size[i]:
            whole = sym[a : a + 1].copy()
            for k in range(1, int(size[i])):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + sym[a + k : a + k + 1])
            out.append(mix(whole + np.uint64(size[i])))
        else:
            out.append(sym[:0])
    return out


class Names:
    """The n-grams of a block of documents: each once, in a fixed order, dealt into buckets."""

    def __init__(self, docs: pa.Table, n: int, buckets: int):
        import numpy as np

        texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
        self.sets = [s for _, part in slices(texts) for s in ngram_sets(part, n)]
        names, times = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]), return_counts=True)
        bucket = ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.sorted, self.times, self.order = names, times, np.argsort(bucket, kind="stable")
        self.names, self.bucket = names[self.order], bucket[self.order]

    def rarest(self, replies: dict[int, bytes], percent: int) -> list:
        """For each document, those of its rarest n-grams that another document has too."""
        import numpy as np

        spread = np.zeros(len(self.sorted), np.uint8)
        answers = [np.frombuffer(replies[b], np.uint8) for b in np.unique(self.bucket).tolist()]
        spread[self.order] = np.concatenate([*answers, np.zeros(0, np.uint8)])
        shared = (spread > 1) | (self.times > 1)
        out = []
        for s in self.sets:
            at = np.searchsorted(self.sorted, s)
            few = len(s) - -(-percent * len(s) // 100) + 1
            first = np.lexsort((s, spread[at]))[:few]
            out.append(s[first[shared[at[first]]]])
        return out


def how_common(table: pa.Table) -> pa.Table:
    """One byte per entry of 4 bytes: how many blocks have it, up to COMMON. It is the same for all blocks, so it orders n-grams."""
    import numpy as np

    parts, sizes = bucket_rows(table, 4)
    _, of, times = np.unique(column(parts, sizes, np.uint32, 0), return_inverse=True, return_counts=True)
    spread, cuts = np.minimum(times, COMMON).astype(np.uint8)[of], np.r_[0, np.cumsum(sizes)]
    return reply(table, 0, [spread[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def features(docs: DataFrame, n: int, percent: int, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, key (of the set), sigs (the shared ones of its rarest n-grams) and text; null texts where no sigs are left.

    Of a block's rows with equal sets, the one with the least doc_id alone has
    sigs and text. Null and empty texts have no n-grams and take no part.

    Blocks of documents ask the buckets of their n-grams how many blocks have
    them, by 4 bytes each; n-grams that are taken for one another so cost
    time only, as they are alike for all documents.
    """
    kind = dict(docs.dtypes)["doc_id"]
    none = docs.where("coalesce(text, '') = ''").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("array<long>").alias("sigs"), F.lit(None).cast("string").alias("text"))
    docs = docs.where("text <> ''")
    total = text_bytes(docs)
    n_blocks, n_buckets = max(8, math.ceil(total / block_bytes)), max(16, math.ceil(total / (16 << 20)))
    by_block = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "doc_id", "text").groupBy("block")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        names = Names(table, n, n_buckets)
        out = send(names.bucket, names.names.astype(np.uint32))
        return out.add_column(0, "block", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    def sift(table: pa.Table, said: pa.Table) -> pa.Table:
        import numpy as np
        import xxhash

        names = Names(table, n, n_buckets)
        replies = dict(zip(said.column("bucket").to_pylist(), said.column("payload").to_pylist(), strict=True))
        left = [s.astype(np.int64) for s in names.rarest(replies, percent)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in names.sets]
        # of rows with equal sets, the one with the least doc_id stands for all
        least: dict[bytes, tuple] = {}
        for k, (i, key) in enumerate(zip(table.column("doc_id").to_pylist(), keys, strict=True)):
            if i is not None and (key not in least or i < least[key][0]):
                least[key] = (i, k)
        first = {k for _, k in least.values()}
        left = [s if k in first else s[:0] for k, s in enumerate(left)]
        copied = pa.array([len(s) > 0 for s in left], pa.bool_())
        text = table.column("text").combine_chunks()
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "n_shingles": pa.array([len(s) for s in names.sets], pa.int64()), "key": pa.array(keys, pa.binary()),
                "sigs": pa.array(left, pa.list_(pa.int64())), "text": pc.if_else(copied, text, pa.scalar(None, text.type)),
            }
        )

    said = by_block.applyInArrow(ask, REQUEST).groupBy("bucket").applyInArrow(how_common, REPLY)
    return by_block.cogroup(said.groupBy("block")).applyInArrow(sift, f"doc_id {kind}, n_shingles long, key binary, sigs array<long>, text string").unionByName(none)


def overlaps(left, right, percent: int):
    """Boolean matrix: which sets of left link with which of right; sets are sorted arrays.

    The incidence of the n-grams that both sides have is multiplied column
    block by column block; a row that can no longer reach its bound with any
    other side's set is left out of the blocks that follow.
    """
    import numpy as np

    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    place = lambda sets: [np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in sets]
    at_l, at_r = place(left), place(right)
    need = -(-percent * (size_l[:, None] + size_r[None, :]) // (100 + percent))  # least overlap that links
    left_over = np.minimum(np.array([len(p) for p in at_l])[:, None], np.array([len(p) for p in at_r])[None, :])
    live_l, live_r = (left_over >= need).any(1), (left_over >= need).any(0)
    count = np.zeros(need.shape, np.float32)
    flat = lambda places: (np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places) if places else np.zeros(0, int))
    (row_l, col_l), (row_r, col_r) = flat(at_l), flat(at_r)
    rest_l, rest_r = np.bincount(row_l, minlength=len(left)), np.bincount(row_r, minlength=len(right))
    for begin in range(0, len(both), COLUMNS):
        if not live_l.any() or not live_r.any():
            break
        end = min(len(both), begin + COLUMNS)
        tiles = []
        for row, col, live, n in ((row_l, col_l, live_l, len(left)), (row_r, col_r, live_r, len(right))):
            own = (col >= begin) & (col < end) & live[row]
            tile = np.zeros((n, end - begin), np.float32)
            tile[row[own], col[own] - begin] = 1
            tiles.append(tile)
        count += tiles[0] @ tiles[1].T
        rest_l = rest_l - np.bincount(row_l[(col_l >= begin) & (col_l < end)], minlength=len(left))
        rest_r = rest_r - np.bincount(row_r[(col_r >= begin) & (col_r < end)], minlength=len(right))
        reach = count + np.minimum(rest_l[:, None], rest_r[None, :]) >= need
        live_l, live_r = live_l & reach.any(1), live_r & reach.any(0)
    count = count.astype(np.int64)
    union = size_l[:, None] + size_r[None, :] - count
    return (100 * count >= percent * union) & (count > 0)


def block_links(n: int, percent: int):
    """One pair of row blocks: doc_id, root, n_links for its documents."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        ids = table.column("doc_id").to_numpy()
        copies, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, copies, side = ids[order], copies[order], side[order]
        texts = [(table.column("text")[int(i)].as_py() or "").encode() for i in order]
        sets = ngram_sets(texts, n)
        row, col = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        parent, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(row) and len(col):
            linked = overlaps([sets[i] for i in row], [sets[i] for i in col], percent)
            if same:
                np.fill_diagonal(linked, False)
            links[row] += linked @ copies[col]
            if not same:
                links[col] += linked.T @ copies[row]
            changed = True
            while changed:  # least label over the links, to the end
                was = parent.copy()
                reach = np.where(linked, parent[col][None, :], len(ids)).min(1, initial=len(ids))
                parent[row] = np.minimum(parent[row], reach)
                reach = np.where(linked, parent[row][:, None], len(ids)).min(0, initial=len(ids))
                parent[col] = np.minimum(parent[col], reach)
                changed = bool((was != parent).any())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "root": pa.array(ids[parent], pa.int64()), "n_links": pa.array(links, pa.int64())})

    return run


def block_pairs(sig: DataFrame, dealt: DataFrame, percent: int, most: int = MET) -> DataFrame:
    """component, lo, hi: the pairs of a group's row blocks, a block and itself included, that may hold a link.

    They have a sig in common, in rows whose sets' sizes are within the bound:
    100 * the smaller >= percent * the larger. A sig of more than `most`
    blocks is paired by several tasks.
    """
    held = sig.join(dealt.select("doc_id", "component", "own", "n_shingles"), "doc_id").groupBy("sig", "component", "own").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    parts = held.groupBy("sig", "component").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    held = held.join(parts, ["sig", "component"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    low = held.select("sig", "component", F.col("own").alias("lo"), F.col("least").alias("least_lo"), F.col("most").alias("most_lo"), F.pmod(F.xxhash64("own"), F.col("parts")).cast("int").alias("part"))
    high = held.select("sig", "component", F.col("own").alias("hi"), "least", "most", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = low.join(high, ["sig", "component", "part"]).where("lo <= hi")
    fits = (100 * F.col("most") >= percent * F.col("least_lo")) & (100 * F.col("most_lo") >= percent * F.col("least"))
    return pairs.where(fits).select("component", "lo", "hi").distinct()


def row_blocks(member: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """member (rep, component, n_shingles, size, ...) with own, its row block: of `rows` rows at most, alike ones together.

    Groups of up to `rows` rows are one block. The rows of larger ones are
    numbered in order, without a task that sees a whole group.
    """
    few = member.where(F.col("size") <= rows).withColumn("own", F.lit(0).cast("long"))
    through = edges.groupBy(F.col("b").alias("rep")).agg(F.min("m").alias("through"))
    many = member.where(F.col("size") > rows).join(through, "rep", "left").withColumn("through", F.coalesce("through", "rep"))
    placed = row_index(many, ["component", "through", "n_shingles", "rep"], "at").withColumn("own", F.floor(F.col("at") / rows))
    return few.unionByName(placed.drop("through", "at"))


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs.

    A link joins two documents with 100 * intersection >= percent * union of
    their sets of distinct word n-grams; component_id is the least doc_id
    reached by links, n_links the number of other documents linked directly.
    A text with fewer than n words is one n-gram; null texts and texts
    without words link with nothing. A null doc_id links with nothing and
    keeps a null component. Rows that repeat a doc_id count as one document
    each, joined in one component. Other columns are ignored; an empty table
    gives no rows. doc_id must be an integer. Texts are read in whole: a block
    of about BLOCK bytes, or one longer text, and about thirty times its size
    fit a task's memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(features(docs, n, percent))
    usable = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"))
    sig = usable.select("doc_id", F.explode("sigs").alias("sig"))
    # each sig leads to the least document that has it
    edges = with_least(sig.select(F.col("sig").alias("a"), F.col("doc_id").alias("b"))).where("b > m").select("b", "m")
    edges = materialize(edges.distinct())
    candidate = components(edges.select(F.col("b").alias("a"), F.col("m").alias("b")))
    member = candidate.withColumnRenamed("node", "rep").join(classes, "rep")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = materialize(row_blocks(member.join(sizes, "component"), edges, ROWS).withColumnRenamed("rep", "doc_id"))
    texts = known.where(F.col("text").isNotNull()).select("doc_id", "key", "text").join(dealt, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    tasks = texts.where(F.col("size") <= ROWS).select("doc_id", "text", "copies", "component", F.col("own").alias("lo"), F.col("own").alias("hi"), F.lit(0).alias("side"))
    large = texts.where(F.col("size") > ROWS)
    near = materialize(block_pairs(sig, dealt.where(F.col("size") > ROWS), percent))
    for side, place in ((0, "lo"), (1, "hi")):
        met = near if side == 0 else near.where("lo < hi")
        tasks = tasks.unionByName(large.withColumn(place, F.col("own")).join(met, ["component", place]).select("doc_id", "text", "copies", "component", "lo", "hi", F.lit(side).alias("side")))
    found = materialize(tasks.groupBy("component", "lo", "hi").applyInArrow(block_links(n, percent), "doc_id long, root long, n_links long"))
    joined = components(found.where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_links").alias("near"))
    of_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(F.col("key").alias("class_key"), F.coalesce("component", "rep").alias("component"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("near"))
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("key"))
    return known.withColumn("own_key", own).join(of_class, F.col("own_key") == F.col("class_key"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("near", F.lit(0)).alias("n_links")
    )
