"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenised once and dealt by a hash to groups of bounded size, so
each group holds a mixture of all sources. In a group, every source is a queue
with a deficit counter. A window (sequence) adds each source's share of its
length to the source's counter and serves the queues, largest counter first, up
to what their counters hold; what is left open by empty queues goes to the
fullest ones, on credit. Counters carry on from window to window, and from group
to group: a group starts with what the groups before it owe each source, which
is known from their token counts. Documents are cut freely. A group's last
tokens fill sequences of power-of-two lengths, so no sequence needs padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, partitions, ship, small_join, sum_before, table

LENGTH = 2048
END_ID = 1
#: Tokens that a group holds about: its memory in a task, whatever the input.
GROUP_TOKENS = 2_000_000
#: A queue is served once its counter reaches this many tokens (or its last ones).
MIN_PIECE = 64
#: Distinct words whose ids a worker remembers, and as many from before them.
REMEMBERED = 500_000
#: Bytes of texts whose words are looked up together.
SLICE = 8 << 20
SEED = 6

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)]


class _Known(dict):
    """Ids of words as bytes, found when first asked for.

    White space separates words and is dropped, so words between blanks are
    encoded apart. A word of Latin letters, with or without punctuation behind
    it, is one piece to the vocabulary's own splitting: its model is asked
    directly, without normalisation and pattern matching, and once for the word
    in small letters, whatever follows it. All others take the whole way. What
    was known when it came to REMEMBERED words is kept as ``older`` until the next
    time, so frequent words stay.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = 1 + max(end_id, *self.tokenizer.get_vocab().values())
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        #: Each id as bytes.
        self.written = [x.tobytes() for x in np.arange(size, dtype=self.kind)]
        self.end = self.written[end_id]
        self.letters = _byte_letters()
        # the direct way is taken for vocabularies for which it is the same
        probe = ["Probe", "straße", "ÉTÉ,", "añoÑ.", "the", "x!", "Þing?!", "ÿ", "zzyzxqw;", "the***", "A.$$$", "ça'", "o&#"]
        self.direct = True
        self.direct = all(self.ask(w) == self.whole(w) for w in probe)
        self.clear()

    def whole(self, word: str) -> bytes:
        return b"".join(map(self.written.__getitem__, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def ask(self, word: str) -> bytes:
        stem = word.rstrip(punctuation)
        plain = stem.isascii()
        if not (self.direct and stem.isalpha() and (plain or max(stem) < "\u0250" and "\u0130" not in stem)):
            return self.keep(word, self.older.get(word) or self.whole(word))
        small = stem.lower()
        ids = self.get(small) or self.older.get(small)
        if ids is None:
            spelled = small if plain else "".join(map(self.letters.__getitem__, small.encode()))
            ids = b"".join([self.written[t.id] for t in self.model.tokenize(spelled)])
        self.keep(small, ids)
        return ids if len(stem) == len(word) else ids + self[word[len(stem) :]]

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    __missing__ = ask

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts as bytes, null being empty; each different word of them is looked up once."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        named = words.flatten().dictionary_encode()
        # the different words as one string: no word has a blank
        different = pc.binary_join(pa.ListArray.from_arrays([0, len(named.dictionary)], named.dictionary), " ")[0].as_py().split(" ")
        ids = pa.array(map(self.__getitem__, different), pa.binary()).take(named.indices)
        _, offsets, data = ids.buffers()
        data = memoryview(data or b"")
        at = np.frombuffer(offsets, np.int32, len(ids) + 1)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [b"".join((data[a:e], self.end)) for a, e in zip(at, at[1:], strict=False)]


_encoders: dict[tuple, _Known] = {}


def _encoder(path: str, end_id: int) -> _Known:
    """One encoder for all tasks of a worker: what it knows stays."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = _Known(path, end_id)
    return _encoders[path, end_id]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have SLICE bytes or so; a longer text is one alone."""
    upto = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy().astype(np.int64))
    a = 0
    while a < batch.num_rows:
        e = max(a + 1, int(np.searchsorted(upto, SLICE + (upto[a - 1] if a else 0), "right")))
        yield batch.slice(a, e - a)
        a = e


def tokenise(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, tokens, ids): ids as little-endian unsigned integers of 2 (or 4) bytes; null text is empty."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for batch in batches:
            for part in _slices(batch):
                ids = encoder.encode(part.column(2))
                count = [len(x) // encoder.width for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.width] * len(ids), pa.int32())], names=["doc_id", "source", "tokens", "ids", "width"])

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return plain.mapInArrow(encode, "doc_id long, source string, tokens long, ids binary, width int")


def fill(lengths: dict, deficits: dict, shares: dict, length: int = LENGTH, least: int = MIN_PIECE) -> Iterator[tuple[int, object, int]]:
    """Deficit round-robin over queues of so many tokens -> (window, source, tokens), in order.

    Every token is served exactly once; windows are full, the last ones having
    the powers of two that add up to what is left.
    """
    left = {s: n for s, n in lengths.items() if n}
    owed = {s: deficits.get(s, 0.0) for s in left}
    rest = sum(left.values())
    sizes = [length] * (rest // length) + [1 << b for b in range(length.bit_length(), -1, -1) if rest % length >> b & 1]
    for window, size in enumerate(sizes):
        room = size
        served: dict = {}
        for s in owed:
            owed[s] += shares[s] * size
        for s in sorted(left, key=owed.__getitem__, reverse=True):
            take = min(int(owed[s]), left[s], room)
            if take > 0 and (take >= least or take == left[s] or take == room):
                served[s] = take
                room -= take
                if not room:
                    break
        while room:  # queues ran dry or hold back: the largest counters with tokens lend
            s = max((s for s in left if left[s] > served.get(s, 0)), key=lambda s: owed[s] - served.get(s, 0))
            take = min(room, left[s] - served.get(s, 0), max(least, math.ceil(owed[s] - served.get(s, 0))))
            served[s] = served.get(s, 0) + take
            room -= take
        for s, take in served.items():
            owed[s] -= take
            left[s] -= take
            if not left[s]:
                del left[s]
            yield window, s, take
        if len(owed) > len(left):
            owed = {s: owed[s] for s in left}


def _pack_group(length: int, least: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at = group.column("g")[0].as_py()
        source = group.column("source").to_pylist()
        tokens = group.column("tokens").to_pylist()
        doc = group.column("doc_id").to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (group_order[i], doc[i] is None, doc[i] or 0, tokens[i])) if (group_order := group.column("ord").to_pylist()) else []
        share, owed = group.column("share").to_pylist(), group.column("owed").to_pylist()
        ids, width = group.column("ids"), group.column("width").to_pylist()
        queues: dict = {}
        for i in order:
            queues.setdefault(source[i], []).append(i)
        lengths = {s: sum(tokens[i] for i in q) for s, q in queues.items()}
        first = {s: q[0] for s, q in queues.items()}
        names = sorted(queues, key=lambda s: (s is None, s or ""))
        steps = fill({s: lengths[s] for s in names}, {s: owed[i] for s, i in first.items()}, {s: share[i] for s, i in first.items()}, length, least)
        cursor = dict.fromkeys(queues, 0)  # the queue's next document
        used = dict.fromkeys(queues, 0)  # tokens of it that are out
        whole: dict = {}
        out: list[list] = [[] for _ in range(8)]
        window, offset = -1, 0
        for w, s, take in steps:
            if w != window:
                window, offset = w, 0
            while take:
                i = queues[s][cursor[s]]
                if s not in whole:
                    whole[s] = np.frombuffer(ids[i].as_buffer(), f"<u{width[i]}").astype("<u4")
                n = min(take, tokens[i] - used[s])
                row = (doc[i], used[s], n, whole[s][used[s] : used[s] + n].tobytes(), tokens[i], (at << 32) + w, offset, s)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                take -= n
                offset += n
                used[s] += n
                if used[s] == tokens[i]:
                    cursor[s] += 1
                    used[s] = 0
                    whole.pop(s)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"])

    return pack


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", length: int = LENGTH,
         group_tokens: int = GROUP_TOKENS, least: int = MIN_PIECE, path: str | None = None, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents: ids as bytes of little-endian unsigned 32-bit integers, the sequence and the place there.

    Null and empty texts have their end id alone. Null sources are one source.
    Repeated rows are packed each; every stored row has a number of its own that
    deals it, so equal rows lie in different groups and places. Very long texts
    cross sequences. An empty table gives an empty result.

    ``targets`` gives weights of sources (None: of null; those not named have 0):
    windows keep to their shares while the sources last, the rest follows on
    credit, as every token is packed once. Without it, shares are the sources'
    shares of all tokens, so that the queues end together.
    """
    spark = docs.sparkSession
    tokens = cut(tokenise(docs, text, key, source, path).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    groups = max(partitions(spark), math.ceil(total / group_tokens))
    order = F.xxhash64(F.lit(SEED), "doc_id", "tokens", "uid")
    dealt = tokens.withColumn("ord", order).drop("uid").withColumn("g", F.pmod(F.xxhash64(F.lit(SEED + 1), "ord"), F.lit(groups)))
    counts = cut(dealt.groupBy("g", "source").agg(F.sum("tokens").alias("n")), "counts")
    sums = counts.groupBy("source").agg(F.sum("n").alias("of_source"))
    stats = sum_before(counts.groupBy("g").agg(F.sum("n").alias("of_group")), "of_group", "g", "all_before").select("g", "all_before")
    # each source's tokens before each group, also where a group has none of it
    owed = sum_before(counts, "n", "g", "own_before", by="source")
    owed = owed.join(stats, "g").join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    share = F.col("of_source") / F.lit(float(max(total, 1)))
    if targets is not None:
        weight = F.lit(0.0)
        for name, value in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value) / sum(targets.values()))).otherwise(weight)
        share = weight
    owed = owed.select(F.col("g").alias("_g"), F.col("source").alias("_source"), share.alias("share"), (share * F.col("all_before") - F.col("own_before")).alias("owed"))
    joined = small_join(dealt, owed, (F.col("g") == F.col("_g")) & F.col("source").eqNullSafe(F.col("_source")), rows=counts.count()).drop("_g", "_source")
    return joined.groupBy("g").applyInArrow(_pack_group(length, least), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
