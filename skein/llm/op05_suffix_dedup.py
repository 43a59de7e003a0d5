"""Suffix-array dedup: every byte of a long string that starts somewhere else too goes.

1. Each start of a ``length``-byte string belongs to the minimizer of its window:
   the k-gram with the least hash, the first of equal ones. Equal strings have
   equal minimizers at equal distances, so they meet under the same minimizer;
   a run of starts with one minimizer is a segment. Counting minimizers leaves
   the segments whose minimizer occurs again.
2. Of these alone the text is cut out. Equal segments become one with a count
   before anything meets: a passage in many documents is one segment.
3. The segments under a minimizer (split by the distance to it where there are
   many) get one suffix array by two-stage sorting: only suffixes smaller than
   their successors are sorted directly, the others are induced by scanning the
   buckets of first bytes upwards; then the common prefixes of adjacent suffixes
   are computed. A prefix of ``length`` marks both starts.
   Where a part still has very many different segments, it is split again: its
   segments are cut to starts in a narrower range of distances, and by a hash of
   the bytes that all windows of that range share. Equal strings agree in both,
   so they stay together; in the end a part has the starts of one distance whose
   windows are equal. Every part is sorted in the same way.
4. Marked starts go back to their texts, where they cover bytes.

Texts are handled by digest: exact copies are one text here, and all their
strings occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, clustered, cut, fields, packed, partitions, quoted, ship, small_join, table
from skein.llm.words import mix64

LENGTH = 400
#: Bytes of a minimizer's k-gram.
GRAM = 128
#: Segments under one minimizer beyond which their starts are split by distance, and parts at most.
SPLIT_AT, SPLITS = 4096, 16
#: Different segments that a task sorts together at most: larger parts are split again.
CROWD = 4096
#: Suffixes that a task sorts at once about.
BATCH = 500_000

_P = np.uint64(0xD6E8FEB86659FD93)


def _inverse(p: int) -> np.uint64:
    return np.uint64(pow(p, -1, 1 << 64))


_cache: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_cache.get(name, ())) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _cache[name] = np.multiply.accumulate(x)
    return _cache[name][:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _P, n), out=sums[1:])
    return mix64((sums[gram:] - sums[: n - gram + 1]) * _powers("down", _inverse(int(_P)), n)[: n - gram + 1])


def segments(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one minimizer: (its hash, first start, last start, its place)."""
    if len(raw) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    hashes = gram_hashes(raw, gram)
    w = length - gram + 1
    low = np.uint64((1 << 21) - 1)  # room for a place in a piece, the same for every text
    value = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # equal hashes: the first place is least
    blocks = -(-len(value) // w)
    square = np.full(blocks * w, ~np.uint64(0), np.uint64)
    square[: len(value)] = value
    square = square.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(value) - w + 1
    place = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], count) - 1
    return (hashes[place[first]]).view(np.int64), first, last, place[first]


#: A longer text is cut into overlapping pieces: memory doesn't follow its length.
PIECE = 1 << 20


def _pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a == 0 or a + length <= n:
        yield a, min(n, a + PIECE + length - 1)
        a += PIECE


def _find(length: int, gram: int):
    """(uid, text) -> (h, uid, first, last, place) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(1)):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                for a, e in _pieces(len(raw), length):
                    h, first, last, place = segments(raw[a:e], length, gram)
                    out[0].append(h)
                    out[1].append(np.full(len(h), i))
                    for x, v in zip(out[2:], (first, last, place), strict=True):
                        x.append(v + a)
            if out[0]:
                h, i, first, last, place = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(i)), pa.array(first), pa.array(last), pa.array(place)], names=["h", "uid", "first", "last", "place"])

    return run


def _cut_out(length: int):
    """(uid, text, found) -> the segments with their bytes and the first start's distance to the minimizer; those of crowded minimizers split by distance."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                uid = batch.column(0)[row].as_py()
                raw = batch.column(1)[row].as_buffer()
                out: list[list] = [[] for _ in range(6)]
                for f in batch.column(2)[row].as_py():
                    parts = min(SPLITS, -(-f["held"] // SPLIT_AT))
                    step = -(-length // parts)
                    a = f["first"]
                    while a <= f["last"]:
                        salt = (f["place"] - a) // step  # by distance to the minimizer, alike for all its segments
                        e = min(f["last"], f["place"] - salt * step)
                        for x, v in zip(out, (f["h"], salt, raw[a : e + length].to_pybytes(), a, e, f["place"] - a), strict=True):
                            x.append(v)
                        a = e + 1
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * n, pa.binary()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), *(pa.array(x, pa.int64()) for x in out[3:])],
                    names=["uid", "h", "salt", "seg", "first", "last", "back"],
                )

    return run


def _narrow(length: int, width: int):
    """Segments of crowded parts -> the same starts in segments of ``width`` distances at most, under a new key.

    The key is a hash of the old one and of the bytes that all windows at these
    distances have in common, the same bytes for every segment of the part.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for uid, h, salt, seg, first, last, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = 0
                while i <= last - first:
                    bucket = (back - i) // width
                    e = min(last - first, back - bucket * width)
                    # common to the windows from the farthest start of the bucket to the nearest
                    core = seg[back - bucket * width : back - (bucket + 1) * width + 1 + length]
                    key = hashlib.blake2b(core, digest_size=8, key=h.to_bytes(8, "little", signed=True) + salt.to_bytes(4, "little", signed=True)).digest()
                    row = (uid, int.from_bytes(key, "little", signed=True), bucket * 1024 + width, seg[i : e + length], first + i, first + e, back - i)
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
                    i = e + 1
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["uid", "h", "salt", "seg", "first", "last", "back"])

    return run


def suffix_array(texts: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage sort of the starts of segments, group by group.

    texts: segments, each with ``length`` - 1 bytes after its last start; groups:
    the group of each, ascending. -> (places in the joined bytes, in suffix order
    by group; the common prefix with the one before, 0 between groups; segment of
    each place; where the segments start).

    A suffix is direct (smaller than its successor) or induced (larger). Behind a
    segment's last start, places up to the next direct one are sorted too, so the
    successor of each induced suffix is there; they leave at the end. Suffixes
    are compared over ``length`` bytes; equal ones are adjacent in any order.
    """
    joined = b"".join(texts)
    t = np.frombuffer(joined, np.uint8)
    n = len(t)
    lens = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(lens) - lens
    seg = np.repeat(np.arange(len(texts)), lens)
    inner = np.arange(n) - begin[seg]
    starts = inner <= (lens - length)[seg]
    # direct: the next byte that differs is larger; a run up to the end of its segment counts as direct
    differs = np.ones(n, bool)
    differs[:-1] = (t[1:] != t[:-1]) | (seg[1:] != seg[:-1])
    end = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    nxt = np.minimum(end + 1, n - 1)
    direct = (seg[nxt] != seg) | (end + 1 >= n) | (t[nxt] > t)
    # each segment's places: its starts and on to the first direct place
    after = np.minimum.accumulate(np.where(direct, np.arange(n), n)[::-1])[::-1]
    stop = after[begin + lens - length]
    held = np.arange(n) <= stop[seg]
    induced = held & ~direct
    group = groups[seg]

    # stage one: direct suffixes, sorted as strings within their group
    places = np.flatnonzero(held & direct)
    g = group[places]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    stops = (begin + lens)[seg[places]].tolist()
    plain = places.tolist()
    ordered: list[int] = []
    for a, e in zip(edge.tolist(), [*edge[1:].tolist(), len(plain)], strict=True):
        keys = [joined[p : min(p + length, s)] for p, s in zip(plain[a:e], stops[a:e], strict=True)]
        ordered.extend(plain[a + i] for i in sorted(range(e - a), key=keys.__getitem__))
    ordered_at = np.array(ordered, np.int64)
    of_byte = np.argsort(t[ordered_at], kind="stable")
    direct_of = ordered_at[of_byte]
    cuts = np.searchsorted(t[direct_of], np.arange(257))

    # stage two: bucket after bucket, each place gives its induced predecessor to a bucket above or its own
    before = np.zeros(n, bool)
    before[1:] = induced[:-1] & (seg[1:] == seg[:-1])
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets: list[np.ndarray] = []

    def by_group(x: np.ndarray) -> np.ndarray:
        return x[np.argsort(group[x], kind="stable")]

    for c in range(256):
        runs = [by_group(np.concatenate(pending[c]))] if pending[c] else []
        while runs and len(runs[-1]):
            last = runs[-1]
            back = last[before[last]] - 1
            runs.append(back[t[back] == c])
        bucket = np.concatenate([*runs, direct_of[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        bucket = by_group(bucket)
        buckets.append(bucket)
        back = bucket[before[bucket]] - 1
        byte = t[back]
        back, byte = back[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        back, byte = back[order], byte[order]
        for d in np.unique(byte):
            a, e = np.searchsorted(byte, [d, int(d) + 1])
            pending[d].append(back[a:e])
    array = by_group(np.concatenate(buckets)) if buckets else np.zeros(0, np.int64)
    array = array[starts[array]]

    # common prefixes of neighbours
    common = np.zeros(len(array), np.int64)
    if len(array) > 1:
        window = np.lib.stride_tricks.sliding_window_view(t, length)
        for a in range(1, len(array), 4096):
            e = min(len(array), a + 4096)
            other = window[array[a:e]] != window[array[a - 1 : e - 1]]
            common[a:e] = np.where(other.any(1), other.argmax(1), length)
        common[1:][group[array[1:]] != group[array[:-1]]] = 0
    return array, common, seg, begin


def _mark(length: int):
    """Segments by group -> those with marked starts: (h, salt, dg, marks: first and last start of each run)."""

    def flush(keys, texts, copies):
        groups = np.cumsum([0, *(a[:2] != b[:2] for a, b in zip(keys, keys[1:], strict=False))])
        array, common, seg, begin = suffix_array(texts, groups, length)
        marked = np.zeros(len(seg), bool)
        twice = np.flatnonzero(common >= length)
        marked[array[twice]] = True
        marked[array[twice - 1]] = True
        lens = np.array([len(x) for x in texts], np.int64)
        starts = np.arange(len(seg)) - begin[seg] <= (lens - length)[seg]
        marked |= (np.array(copies) > 1)[seg] & starts  # every string of a segment that occurs again does
        edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        own = seg[first]
        inside = np.stack([first - begin[own], last - begin[own]], 1).astype(np.int32)
        where = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
        chosen = [keys[i] for i in own[where]]
        marks = [inside[a:e].tobytes() for a, e in zip(where, [*where[1:], len(own)], strict=False)]  # none where nothing is marked
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in chosen], pa.int64()), pa.array([k[1] for k in chosen], pa.int32()), pa.array([k[2] for k in chosen], pa.binary()), pa.array(marks, pa.binary())],
            names=["h", "salt", "dg", "marks"],
        )

    def run(batches):
        keys: list = []
        texts: list = []
        copies: list = []
        size = 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for h, salt, dg, seg, n in rows:
                if size > BATCH and (h, salt) != keys[-1][:2]:
                    yield flush(keys, texts, copies)
                    keys, texts, copies, size = [], [], [], 0
                keys.append((h, salt, dg))
                texts.append(seg)
                copies.append(n)
                size += len(seg)
        if keys:
            yield flush(keys, texts, copies)

    return run


def _distinct(segs: DataFrame) -> DataFrame:
    return segs.groupBy("h", "salt", "dg").agg(F.first("seg").alias("seg"), F.count("*").alias("copies"))


SEGMENTS = "uid binary, h long, salt int, seg binary, first long, last long, back long"


def _bounded(segs: DataFrame, length: int) -> DataFrame:
    """Segments in parts (h, salt) of at most CROWD different ones: larger parts are narrowed, again and again, until none is left or their windows are equal."""
    width, parts = -(-length // SPLITS), []
    while width > 1:
        # equal segments are one in each task before they are counted
        different = segs.groupBy("h", "salt", "dg").agg(F.count("*").alias("copies")).groupBy("h", "salt").agg(F.count("*").alias("n"))
        crowded = cut(different.filter(F.col("n") > CROWD).select("h", "salt"), "crowded")
        many = crowded.count()
        if not many:
            break
        width = max(1, width // 2)
        parts.append(small_join(segs, crowded, ["h", "salt"], "left_anti", many))
        narrow = small_join(segs, crowded, ["h", "salt"], "left_semi", many).select("uid", "h", "salt", "seg", "first", "last", "back").mapInArrow(_narrow(length, width), SEGMENTS)
        segs = cut(narrow.withColumn("dg", F.unhex(F.md5("seg"))), "narrowed")
    for part in parts:
        segs = segs.unionByName(part)
    return segs


def _gather(length: int):
    """(uid, spans of marked starts) -> (uid, spans of covered bytes as pairs of 64-bit integers)."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.column(1):
                at = np.concatenate([np.frombuffer(x["marks"].as_buffer(), np.int32).reshape(-1, 2).astype(np.int64) + x["first"].as_py() for x in row])
                at = at[np.argsort(at[:, 0], kind="stable")]
                a, e = at[:, 0], at[:, 1] + length
                top = np.maximum.accumulate(e)
                new = np.concatenate([[True], a[1:] > top[:-1]])
                out.append(np.stack([a[new], np.append(top[:-1][new[1:]], top[-1])], 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uid", "spans"])

    return run


def _with_counts(found: DataFrame, again: DataFrame) -> DataFrame:
    """Segments whose minimizer is in ``again``, with its count; those of minimizers of very many are not moved, as no key may gather them."""
    crowds = again.filter(F.col("held") > SPLIT_AT)
    if crowds.count() > BROADCAST_ROWS:  # a crowd has SPLIT_AT segments: then no few of them hold a large share
        return found.join(again, "h")
    marked = found.join(F.broadcast(crowds), "h", "left")
    calm = marked.filter("held is null").drop("held").join(again.filter(F.col("held") <= SPLIT_AT), "h")
    return marked.filter("held is not null").unionByName(calm)


def covered(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, text), distinct and clustered by uid -> (uid, spans): covered bytes [a, e) of texts of which strings start again."""
    spark = texts.sparkSession
    found = cut(texts.mapInArrow(_find(length, gram), "h long, uid binary, first long, last long, place long"), "found")
    # a minimizer that occurs twice or more; its segments by text
    again = cut(found.groupBy("h").agg(F.count("*").alias("held")).filter("held > 1"), "again")
    marked = _with_counts(found, again)
    repeated = marked.groupBy("uid").agg(F.collect_list(F.struct("h", "first", "last", "place", F.least("held", F.lit(SPLITS * SPLIT_AT)).alias("held"))).alias("found"))
    segs = texts.join(repeated, "uid").select("uid", "text", "found").mapInArrow(_cut_out(length), SEGMENTS)
    segs = _bounded(cut(segs.withColumn("dg", F.unhex(F.md5("seg"))), "segments"), length)
    sorted_ = _distinct(segs).repartition(partitions(spark), "h", "salt").sortWithinPartitions("h", "salt").select("h", "salt", "dg", "seg", "copies")
    marks = sorted_.mapInArrow(_mark(length), "h long, salt int, dg binary, marks binary")
    at = segs.select("uid", "h", "salt", "dg", "first").join(cut(marks, "marks"), ["h", "salt", "dg"])
    return at.groupBy("uid").agg(F.collect_list(F.struct("first", "marks")).alias("at")).mapInArrow(_gather(length), "uid binary, spans binary")


#: Texts that are rewritten at once.
STRIP_ROWS = 256


def _strip(schema_names: list[str], characters: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP_ROWS):
                part = batch.slice(at, STRIP_ROWS)
                size, removed, spans, kept = [], [], [], []
                for text, span in zip(part.column(1), part.column(2), strict=True):
                    body = text.as_buffer()
                    size.append(body.size)
                    pairs = np.frombuffer(span.as_buffer(), np.int64).reshape(-1, 2).tolist() if span.is_valid else []
                    removed.append(sum(e - a for a, e in pairs))
                    spans.append(len(pairs))
                    edges = [0, *(x for pair in pairs for x in pair), body.size]
                    left = b"".join(body[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                    kept.append(left.decode("utf-8", "ignore").encode() if characters and pairs else left)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=schema_names,
                )

    return run


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text in ``_row``, with n_bytes, n_removed, n_spans and kept (bytes).

    Every byte goes that a ``length``-byte string covers which also starts
    elsewhere, in the same text or another; the first occurrence too. With
    ``characters``, the rest of a character that a cut splits goes too. Null and
    shorter texts lose nothing (null counts as empty). Exact copies lose all if
    they are long enough. Repeated rows are copies. An empty table gives an empty
    result.

    The distinct long texts are shuffled once, into buckets by digest; whatever
    else meets them is narrow. Copies are resolved by their digest's count alone.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    named = docs.select(packed(docs, text).alias("_row"), body.alias("text"), F.unhex(F.md5(body)).alias("uid"))
    named = named.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = named.filter(F.col("n_bytes") >= length)
    texts = clustered(long.select("uid", "text").dropDuplicates(["uid"]), "uid", "texts")
    spans = covered(texts, length, gram)

    copies = long.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").select("uid", F.lit(True).alias("copied"))
    rows = cut(long.select("_row", "uid", "n_bytes").join(copies, "uid", "left"), "rows")
    names = ["_row", "n_bytes", "n_removed", "n_spans", "kept"]
    kind = fields(named.schema["_row"].dataType, "n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    short = named.filter(F.col("n_bytes") < length).select("_row", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    gone = rows.filter("copied").select("_row", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    single = texts.join(rows.filter("copied is null").select("uid", "_row"), "uid").join(cut(spans, "spans"), "uid", "left").select("_row", "text", "spans")
    single = single.mapInArrow(_strip(names, characters), kind)
    return single.unionByName(gone).unionByName(short)


def strip_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without the strings of ``length`` bytes that repeat; a character that a cut splits goes too.

    Nulls become empty texts, shorter texts stay as they are, repeated rows stay
    as many rows, with what is left of their text. All columns keep their names.
    """
    done = dedup(docs, text, length, gram, characters=True)
    return done.select(*[(F.col("kept").cast("string") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
