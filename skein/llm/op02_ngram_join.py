"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the matrix are the distinct shingle sets (exact copies are one row),
columns are shingle hashes, cut into column blocks. A pair of rows links when
100 * overlap >= 80 * union.

1. Every text gives a key of its whole set and the set's size; a table of classes
   (equal sets) follows.
2. The incidence matrix goes to its column blocks, packed. A block counts each
   column; columns held by one row alone can't add to any overlap and only
   shrink the bound of what is left: they end here.
3. Each row orders its remaining columns from rare to common. By the size bound
   (overlap >= 0.8 * size) two linked rows share one of the first
   size - ceil(0.8 * size) + 1 columns of that order, those of one row included;
   only these name pairs whose product is wanted.
4. In such a column short lists give all their pairs; long ones, in parts of
   bounded size, the pairs with a few pivots (rows with the fewest columns of
   their own first). The bound on sizes and places drops what can't link.
5. Wanted pairs are dealt to row blocks by one of their rows, and every row goes
   once to each block that asks for it. A row block multiplies its sparse rows
   column block after column block: overlaps accumulate for all its pairs at
   once, and a pair is discarded as soon as what is left of either row can't
   lift it to its bound.
6. Linked rows are joined to components. Long lists whose rows are not yet in one
   component name more pairs, two pivots of a list a round, then the rest of
   their pairs across components, block by block: no link is lost, and a group of
   copies needs pairs in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, clustered, cut, fields, packed, partitions, quoted, ship, small_join, table
from skein.llm.components import connected_components
from skein.llm.words import chunks, mix64, shingle_hashes, word_hashes

WIDTH = 5
PERCENT = 80
#: Incidences that a column block holds about.
BLOCK_ITEMS = 2_000_000
#: Incidences that a task gathers before it sends blocks.
FLUSH_ITEMS = 3_000_000
#: Lists up to this length give all pairs; longer ones give pairs with this many pivots a round.
SHORT, PIVOTS = 12, 2
ROUNDS = 4
#: Rows of a part of a long list, and of a block of the last round.
PART, BLOCK_ROWS = 4096, 512
#: Bytes of columns that the pairs of a row block name about; pairs of one row that are dealt alike.
PRODUCT_BYTES, HUB_PAIRS = 8 << 20, 512


def _needs(n: np.ndarray | int, percent: int):
    """Least overlap that a set of n has with any partner: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(texts, their distinct shingles, number for each text), a chunk of texts at a time."""
    for batch in batches:
        for first, raw, offsets in chunks(batch.column(batch.num_columns - 1)):
            docs = len(offsets) - 1
            words, counts = word_hashes(raw, offsets)
            items, many = shingle_hashes(words, counts, width)
            doc = np.repeat(np.arange(docs), many)
            order = np.lexsort((items, doc))
            items, doc = items[order], doc[order]
            new = np.ones(len(items), bool)
            new[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
            items, doc = items[new], doc[new]
            yield batch.slice(first, docs), items, np.bincount(doc, minlength=docs)


def _set_keys(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums that name a set."""
    ends = np.cumsum(counts)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return mix64(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))

    return total(items).view(np.int64), total(mix64(items ^ np.uint64(0x5DEECE66D1234567))).view(np.int64)


def set_keys(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(_row, k, k2, n): names and size of each text's set; null and wordless texts have n = 0."""
    others = docs.select(packed(docs, text).alias("_row"), F.col(quoted(text)).alias("text"))
    kind = fields(others.schema["_row"].dataType, "k long, k2 long, n long")

    def run(batches):
        for part, items, counts in _sets(batches, width):
            k, k2 = _set_keys(items, counts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k), pa.array(k2), pa.array(counts.astype(np.int64))], names=["_row", "k", "k2", "n"])

    return others.mapInArrow(run, kind)


def _blocked(docs: DataFrame, text: str, width: int, blocks: int) -> DataFrame:
    """The incidence matrix packed by column block: (b, rows: keys, counts, items), copies within a task once."""

    def run(batches):
        seen: set = set()
        keys: list = []
        sizes: list = []
        parts: list = []
        held = 0

        def flush():
            items = np.concatenate(parts)
            count = np.concatenate(sizes)
            row = np.repeat(np.arange(len(count), dtype=np.int32), count)
            block = (items >> np.uint64(32)) % np.uint64(blocks)
            order = np.lexsort((row, block))
            block, row, full = block[order], row[order], items[order]
            edge = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            name = np.concatenate(keys)
            for b in range(blocks):
                a, e = edge[b], edge[b + 1]
                if a < e:
                    rows, many = np.unique(row[a:e], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([name[rows].tobytes()]), pa.array([many.astype(np.uint32).tobytes()]), pa.array([full[a:e].tobytes()])],
                        names=["b", "keys", "counts", "items"],
                    )

        for _, items, counts in _sets(batches, width):
            k, _ = _set_keys(items, counts)
            new = np.array([n > 0 and x not in seen and not seen.add(x) for x, n in zip(k.tolist(), counts.tolist(), strict=True)], bool)
            keys.append(k[new])
            sizes.append(counts[new])
            parts.append(items[np.repeat(new, counts)])
            held += len(parts[-1])
            if held > FLUSH_ITEMS:
                yield from flush()
                keys, sizes, parts, held = [], [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "b int, keys binary, counts binary, items binary")


def _unpack(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]


def _count_columns(rows_blocks: int):
    """A column block -> its columns held by two rows or more, sent to the rows: (q, keys, counts, items, ranks)."""

    def run(group: pa.Table) -> pa.Table:
        keys = np.concatenate(_unpack(group.column("keys"), np.int64))
        counts = np.concatenate(_unpack(group.column("counts"), np.uint32)).astype(np.int64)
        items = np.concatenate(_unpack(group.column("items"), np.uint64))
        _, one = np.unique(keys, return_index=True)  # a set that several tasks sent is one row
        first = np.zeros(len(keys), bool)
        first[one] = True
        items, keys, counts = items[np.repeat(first, counts)], keys[first], counts[first]
        row = np.repeat(np.arange(len(keys)), counts)
        order = np.argsort(items, kind="stable")
        got, row = items[order], row[order]
        edge = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
        held = np.repeat(np.diff(np.append(edge, len(got))), np.diff(np.append(edge, len(got))))
        many = held > 1
        got, row, held = got[many], row[many], held[many]
        rank = np.minimum(255, 8 * np.log2(held)).astype(np.uint8)
        q = (mix64(keys.view(np.uint64)) % np.uint64(rows_blocks)).astype(np.int32)[row]
        order = np.lexsort((row, q))
        q, row, got, rank = q[order], row[order], got[order], rank[order]
        out: dict = {"q": [], "keys": [], "counts": [], "items": [], "ranks": []}
        for at in np.unique(q):
            a, e = np.searchsorted(q, [at, at + 1])
            rows, n = np.unique(row[a:e], return_counts=True)
            for name, x in zip(out, (int(at), keys[rows].tobytes(), n.astype(np.uint32).tobytes(), got[a:e].tobytes(), rank[a:e].tobytes()), strict=True):
                out[name].append(x)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(x, t) for (n, x), t in zip(out.items(), kinds, strict=True)})

    return run


def _order_rows(percent: int):
    """Rows with what is left of their columns -> those that may have a partner.

    (k, n, alone, cols, ranks): columns in global order, rare first, and the rank
    of each leading one; alone: how many columns the row has for itself, all
    before those.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"k": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "cols": pa.binary(), "ranks": pa.binary()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        keys = np.concatenate([np.repeat(k, c) for k, c in zip(_unpack(left.column("keys"), np.int64), _unpack(left.column("counts"), np.uint32), strict=True)])
        cols = np.concatenate(_unpack(left.column("items"), np.uint64))
        ranks = np.concatenate(_unpack(left.column("ranks"), np.uint8))
        order = np.lexsort((cols, ranks, keys))  # the global order: by rank, then by the column's number
        keys, cols, ranks = keys[order], cols[order], ranks[order]
        sizes = dict(zip(right.column("k").to_pylist(), right.column("n").to_pylist(), strict=True))
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out: dict = {n: [] for n in kinds}
        for a, e in zip(edge, np.append(edge[1:], len(keys)), strict=True):
            n = sizes[int(keys[a])]
            alone = n - int(e - a)
            if e - a >= _needs(n, percent):
                lead = max(0, n - _needs(n, percent) + 1 - alone)
                for name, x in zip(out, (int(keys[a]), n, alone, cols[a:e].tobytes(), ranks[a : a + lead].tobytes()), strict=True):
                    out[name].append(x)
        return pa.table({n: pa.array(out[n], t) for n, t in kinds.items()})

    return run


def _prefixes(blocks: int):
    """Rows -> their leading columns, packed by column: (c, col, part, k, n, alone, place).

    A column of very many rows is a list in parts: its rank, which all its rows
    know, tells how many; part -1 is the whole list.
    """

    def run(batches):
        for batch in batches:
            k, n, alone = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(3))
            if not len(k):
                continue
            ranks = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(4)]
            lead = np.array([len(x) for x in ranks], np.int64)
            col = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64)[:m] for x, m in zip(batch.column(3), lead, strict=True)])
            row = np.repeat(np.arange(len(k)), lead)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lead) - lead, lead) + alone[row]
            parts = np.ceil(2.0 ** (np.concatenate(ranks) / 8) / PART).astype(np.int64)
            part = np.where(parts > 1, (mix64(k.view(np.uint64))[row] % parts.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)
            c = (mix64(mix64(col) + part.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(c, kind="stable")
            c, row, col, place, part = c[order], row[order], col[order], place[order], part[order]
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
            out = [[] for _ in range(7)]
            for a, e in zip(edge, np.append(edge[1:], len(c)), strict=True):
                r = row[a:e]
                values = (int(c[a]), col[a:e].tobytes(), part[a:e].tobytes(), k[r].tobytes(), n[r].astype(np.int32).tobytes(), alone[r].astype(np.int32).tobytes(), place[a:e].astype(np.int32).tobytes())
                for x, v in zip(out, values, strict=True):
                    x.append(v)
            names = ["c", "col", "part", "k", "n", "alone", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=names)

    return run


def _possible(na, nb, pa_, pb, percent: int):
    """May sets of na and nb, whose first common column has these places, overlap enough?"""
    need = -(-(na + nb) * percent // (100 + percent))
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return fits & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def _lists(group: pa.Table):
    """A block of leading columns as arrays in list order: rows with the fewest columns of their own first."""
    kinds = (("col", np.uint64), ("part", np.int32), ("k", np.int64), ("n", np.int32), ("alone", np.int32), ("place", np.int32))
    col, part, k, n, alone, place = (np.concatenate(_unpack(group.column(c), t)) for c, t in kinds)
    n, place = n.astype(np.int64), place.astype(np.int64)
    own = alone / n
    order = np.lexsort((k, own, part, col))
    col, part, k, n, own, place = col[order], part[order], k[order], n[order], own[order], place[order]
    new = np.ones(len(col), bool)
    new[1:] = (col[1:] != col[:-1]) | (part[1:] != part[:-1])
    edge = np.flatnonzero(new)
    size = np.diff(np.append(edge, len(col)))
    return col, part, k, n, own, place, np.repeat(edge, size), np.repeat(size, size)


PAIRS = "ka long, kb long, na long, nb long"


def _pairs_table(a, b, k, n) -> pa.Table:
    turned = k[a] > k[b]
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    both = np.stack([k[a], k[b]], 1)
    _, one = np.unique(both, axis=0, return_index=True)
    a, b = a[one], b[one]
    return pa.table({"ka": pa.array(k[a]), "kb": pa.array(k[b]), "na": pa.array(n[a]), "nb": pa.array(n[b])})


LISTED = "list long, k long, n long, place long, own double, at long"


def _propose(percent: int):
    """Column lists -> pairs wanted (ka, kb, na, nb): all of short lists, those with pivots of long ones and of parts.

    The rows of lists that gave no more than their pivots' pairs follow with
    null pairs: (list, k, n, place, own, at), at: the place in the list's part.
    """

    def run(group: pa.Table) -> pa.Table:
        col, part, k, n, own, place, start, size = _lists(group)
        i = np.arange(len(k))
        a, b = [], []
        for d in range(1, SHORT):  # all pairs of short lists, one distance at a time
            x = i[(size <= SHORT) & (i + d < start + size)]
            a.append(x)
            b.append(x + d)
        for p in range(PIVOTS):
            x = i[(size > SHORT) & (i > start + p)]
            a.append(start[x] + p)
            b.append(x)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = (k[a] != k[b]) & _possible(n[a], n[b], place[a], place[b], percent)
        pairs = _pairs_table(a[ok], b[ok], k, n)
        x = np.flatnonzero((size > SHORT) | (part >= 0))
        listed = pa.table({"list": col[x].view(np.int64), "k": k[x], "n": n[x], "place": place[x], "own": own[x], "at": x - start[x]})
        return pa.concat_tables([pairs, listed], promote_options="default")

    return run


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``size[0]`` of them, then those from first[1] on, ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def overlaps(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, need: np.ndarray, blocks: int = 16) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) of sparse rows share need[i] columns or more.

    The product of the rows with each other, for these pairs alone, one column
    block after another; a pair leaves when what it has and what is left of its
    shorter row don't reach its bound.
    """
    size = np.array([len(x) for x in rows], np.int64)
    names, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]), return_inverse=True)
    width = len(names) + 1
    entry = np.sort(np.repeat(np.arange(len(rows)), size) * width + column)  # the non-zero places, row by row
    ends = np.linspace(0, width, blocks + 1).astype(np.int64)
    edge = np.searchsorted(entry, np.arange(len(rows))[:, None] * width + ends[None, :])
    got = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for s in range(blocks):
        first, many = edge[:, s], edge[:, s + 1] - edge[:, s]
        short = many[a[alive]] <= many[b[alive]]
        x, y = np.where(short, a[alive], b[alive]), np.where(short, b[alive], a[alive])
        cuts = np.searchsorted(np.cumsum(many[x]), np.arange(0, int(many[x].sum()) + 4_000_000, 4_000_000))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(x)), strict=True):
            if lo == hi:
                continue
            each = np.repeat(np.arange(lo, hi), many[x[lo:hi]])
            wanted = entry[_spread(first[x[lo:hi]], many[x[lo:hi]])] + (y[each] - x[each]) * width
            hit = entry[np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)] == wanted
            got[alive[lo:hi]] += np.bincount(each[hit] - lo, minlength=hi - lo)
        left = np.minimum(edge[a[alive], -1] - edge[a[alive], s + 1], edge[b[alive], -1] - edge[b[alive], s + 1])
        alive = alive[got[alive] + left >= need[alive]]
    done = np.zeros(len(a), bool)
    done[alive] = True
    return done


def _multiply(percent: int):
    """A row block: its pairs and the rows that they name -> the pairs that link."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ka, kb, na, nb = (left.column(c).to_numpy() for c in ("ka", "kb", "na", "nb"))
        if not len(ka):
            return pa.table({"ka": pa.array(ka, pa.int64()), "kb": pa.array(kb, pa.int64())})
        k = right.column("k").to_numpy()
        order = np.argsort(k)
        rows = _unpack(right.column("cols"), np.uint64)
        a, b = (np.searchsorted(k[order], x) for x in (ka, kb))
        keep = overlaps([rows[i] for i in order], a, b, -(-(na + nb) * percent // (100 + percent)))
        return pa.table({"ka": pa.array(ka[keep]), "kb": pa.array(kb[keep])})

    return run


def product(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(ka, kb) of those pairs, stored, whose rows (k, cols) overlap enough; a row goes once to each block that asks for it."""
    spark = rows.sparkSession
    total = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    blocks = max(partitions(spark), math.ceil(8 * total / PRODUCT_BYTES))
    heavy = cut(pairs.groupBy("ka").agg(F.count("*").alias("n")).filter(F.col("n") > HUB_PAIRS).select("ka", F.ceil(F.col("n") / HUB_PAIRS).alias("salts")), "heavy")
    salted = small_join(pairs, heavy, "ka", "left")
    salt = F.pmod(F.xxhash64("kb"), F.coalesce("salts", F.lit(1)))
    dealt = salted.select("ka", "kb", "na", "nb", F.pmod(F.xxhash64("ka", salt), F.lit(blocks)).alias("g"))
    asked = dealt.select(F.col("g").alias("to"), F.explode(F.array("ka", "kb")).alias("k")).distinct()
    sent = rows.select("k", "cols").join(asked, "k").select("to", "k", "cols")
    return dealt.groupBy("g").cogroup(sent.groupBy("to")).applyInArrow(_multiply(percent), "ka long, kb long")


def links_of_sets(docs: DataFrame, classes: DataFrame, text: str, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """-> (links (ka, kb) that join every component, components (k, comp)) of distinct sets."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("n")).first()[0] or 0
    blocks = max(partitions(spark), math.ceil(total / BLOCK_ITEMS))
    kept = _blocked(docs, text, width, blocks).groupBy("b").applyInArrow(_count_columns(blocks), "q int, keys binary, counts binary, items binary, ranks binary")

    def to_block(batches):
        for batch in batches:
            q = (mix64(np.array(batch.column(0).to_pylist(), np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q)], names=["k", "n", "q"])

    named = classes.select("k", "n").mapInArrow(to_block, "k long, n long, q int")
    rows = kept.groupBy("q").cogroup(named.groupBy("q")).applyInArrow(_order_rows(percent), "k long, n long, alone long, cols binary, ranks binary")
    # in buckets by k: every product finds its rows without moving the others
    rows = clustered(rows.repartition(partitions(spark), "k"), "k", "rows")
    lead = rows.mapInArrow(_prefixes(blocks), "c int, col binary, part binary, k binary, n binary, alone binary, place binary")

    proposed = cut(lead.groupBy("c").applyInArrow(_propose(percent), f"{PAIRS}, {LISTED}"), "proposed")
    pairs = cut(proposed.filter("ka is not null").select("ka", "kb", "na", "nb").distinct(), "pairs")
    links = cut(product(rows, pairs, percent), "links")
    comps = connected_components(links, "ka", "kb")
    lists = proposed.filter("ka is null").select("list", "k", "n", "place", "own", "at")
    for at in range(1, ROUNDS + 1):
        held = lists.join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        # lists of which all rows are in one component have nothing to add
        mixed = held.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"))
        mixed = cut(mixed.filter("low < high").select("list", "rows"), "mixed")
        lists = cut(_by_list(held, mixed).select("list", "k", "n", "place", "own", "at", "comp", "rows"), "lists")
        if lists.isEmpty():
            break
        more = _with_pivots(lists, percent, at) if at < ROUNDS else _across_blocks(lists, percent)
        more = cut(more.distinct().join(pairs, ["ka", "kb"], "left_anti"), "more")
        lists = lists.drop("comp", "rows")
        if more.isEmpty():
            continue
        found = cut(product(rows, more, percent), "links")
        pairs = pairs.unionByName(more)
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = connected_components(links, "ka", "kb")
    return links, comps


def _by_list(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of lists with a fact of their list: broadcast while small, else with long lists in salted parts."""
    few = facts.count()
    if few <= BROADCAST_ROWS:
        return small_join(rows, facts, "list", rows=few)
    salts = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_salt")
    return rows.withColumn("_salt", F.pmod(F.xxhash64("k"), F.lit(32)).cast("int")).join(facts.select("*", salts), ["list", "_salt"]).drop("_salt")


def _wanted(both: DataFrame, percent: int) -> DataFrame:
    """Of pairs of rows of a list, those of two components that sizes and places allow."""
    need = F.ceil((F.col("n") + F.col("p_n")) * percent / (100 + percent))
    fits = 100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")
    bound = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")) >= need
    both = both.filter((F.col("comp") != F.col("p_comp")) & fits & bound)
    ends = [F.when(F.col("k") < F.col("p_k"), F.struct("k", "n")).otherwise(F.struct(F.col("p_k").alias("k"), F.col("p_n").alias("n"))), F.when(F.col("k") < F.col("p_k"), F.struct(F.col("p_k").alias("k"), F.col("p_n").alias("n"))).otherwise(F.struct("k", "n"))]
    return both.select(*[e[c].alias(f"{c}{x}") for c in ("k", "n") for e, x in zip(ends, "ab", strict=True)])


def _with_pivots(lists: DataFrame, percent: int, at: int) -> DataFrame:
    """Pairs across components with two pivots of each list, of the parts' next best."""
    best = lists.filter((F.col("at") >= PIVOTS * at) & (F.col("at") < PIVOTS * (at + 1)))
    best = best.groupBy("list").agg(F.slice(F.array_sort(F.collect_list(F.struct("own", "k", "n", "place", "comp"))), 1, PIVOTS).alias("p"))  # two of each part
    pivots = cut(best.select("list", F.explode("p").alias("p")).select("list", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("k", "n", "place", "comp")]), "pivots")
    return _wanted(_by_list(lists, pivots), percent)


def _across_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that are left in a list, a pair of blocks of its rows at a time."""
    count = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = lists.withColumn("_b", F.pmod(F.xxhash64("k"), count).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), count - 1)))
    own = own.select("list", "k", "n", "place", "comp", "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    low = own.filter(F.col("_b") == F.col("_lo")).drop("_b")
    high = own.filter(F.col("_b") == F.col("_hi")).select("list", "_lo", "_hi", *[F.col(c).alias(f"p_{c}") for c in ("k", "n", "place", "comp")])
    return _wanted(low.join(high, ["list", "_lo", "_hi"]), percent)


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """All columns of ``docs`` but the text in ``_row``, with n_shingles, component_id and n_copies (rows of the same set).

    component_id is the smallest key that links reach. Null, empty and wordless
    texts have no shingle and link with nothing; fewer words than ``width`` make
    one shingle. Repeated rows have equal sets and so link. A null key counts as
    the largest one. Very long texts are whole. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    named = cut(set_keys(docs, text, width).withColumn("_key", F.col("_row")[key]), "sets")
    full = named.filter("n > 0")
    classes = cut(full.groupBy("k", "k2", "n").agg(F.min("_key").alias("least"), F.count("*").alias("n_copies")), "classes")
    _, comps = links_of_sets(docs, classes, text, width, percent)
    comp = classes.join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    small = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = comp.join(small, "comp").select("k", "component_id", "n_copies")
    out = full.join(of_set, "k").select("_row", F.col("n").alias("n_shingles"), "component_id", "n_copies")
    lone = named.filter("n = 0").select("_row", F.lit(0).cast("long").alias("n_shingles"), F.col("_key").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(lone)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, that with the smallest key; all columns of ``docs``, whatever their names.

    Texts without words have no partners and stay. Of repeated rows one stays,
    that of the least text hash where equal keys have different texts. A null
    key counts as the largest; documents of one component that have none are
    told apart by their text.
    """
    body = F.col(quoted(text))
    rows = docs.select(packed(docs).alias("_doc"), F.col(quoted(key)).alias("_key"), F.xxhash64(body).alias("_hash"), body.alias("_text"))
    joined = join(rows.select("_key", "_hash", "_text"), "_text", "_key").select(F.col("_row._key").alias("_key"), F.col("_row._hash").alias("_hash"), "component_id")
    joined = cut(joined, "joined")
    groups = joined.groupBy("component_id", F.when(F.col("_key").isNull(), F.col("_hash")).alias("_null"))
    first = groups.agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_hash")).alias("f"))
    first = cut(first.select(F.col("f._key").alias("_k"), F.col("f._hash").alias("_h")).distinct(), "first")
    kept = rows.join(first, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_hash").eqNullSafe(F.col("_h")), "left_semi")
    repeats = joined.groupBy("_key", "_hash").count().filter("count > 1").isEmpty()
    return (kept if repeats else kept.dropDuplicates(["_key", "_hash"])).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_shingles", "component_id", "n_copies")
