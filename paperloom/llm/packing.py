"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Best-fit decreasing over a histogram. Documents are sorted by length in ranges, and each gets its rank
among the pieces of its length from counts by partition. How many pieces have each length goes to the driver, at
most `capacity` numbers whatever the input, and a sequential loop there sweeps from the longest length
down: the pieces of a length go to the smallest gaps that take them, rank decides which piece gets
which of equal gaps, filled gaps shrink, and what finds no gap opens sequences. This replaces distributed rounds
with conflicts and gap updates, and gives best-fit decreasing exactly. Placements are intervals of ranks, a
few for each length, and pieces find theirs by a join on (length, interval); documents never leave the executors.

Defined results: null text is empty, which is one piece of the end token alone; only documents of
more than `capacity` tokens are cut; rows that repeat a doc_id are packed each on their own; an
empty table gives no sequences; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, END = 4096, 1
#: Different word parts whose ids a worker remembers; beyond that it starts anew.
MOST_KNOWN = 600_000
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII letters, digits and other marks; between two of different kinds the tokenizer's splitter always cuts. Apostrophes (contractions) and other characters are left to it.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Token ids of texts by a `tokenizers` file, with each different part of a word encoded once.

    Parts are runs of non-space bytes, cut where the splitter cuts in any case; they are known again
    by all their bytes. A text with the opening of a special token in it is cut at white space alone.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.at, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, words: list[str]) -> None:
        plain = [i for i, w in enumerate(words) if w.isascii() and (w.isalpha() or not (any(map(str.isalnum, w)) or "'" in w))]
        found: list = [None] * len(words)
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.array(self.tok.encode(" ".join(words[k] for k in part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                for k, own in zip(part, np.split(ids, ends[:-1]), strict=True):
                    found[k] = own
        rest = [i for i, x in enumerate(found) if x is None]
        for i in range(0, len(rest), 5000):
            part = rest[i : i + 5000]
            for k, e in zip(part, self.tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, np.uint32)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([*found, np.zeros(0, np.uint32)])
        while self.used + len(n) > len(self.n):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.at[self.used : self.used + len(n)] = self.filled + np.cumsum(n) - n
        self.n[self.used : self.used + len(n)] = n
        self.used, self.filled = self.used + len(n), self.filled + len(flat)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and where each row begins."""
        lo, hi, row = C.word_bounds(data, at)
        if b"<|" not in data.tobytes():
            data = _LOWER[data]
            kind = _KIND[data]
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            cut[at] = False  # between rows there is no word to cut
            cut = np.flatnonzero(cut)
            lo, hi = np.sort(np.concatenate((lo, cut))), np.sort(np.concatenate((hi, cut)))
            row = np.searchsorted(at, lo, "right") - 1
        parts = C.word_array(data, lo, hi).dictionary_encode()
        body = parts.dictionary.to_pylist()
        if self.used + len(body) > MOST_KNOWN:
            self.forget()
        new = [w for w in body if w not in self.slot]
        slot = self.used
        if new:
            self._learn([w.decode() for w in new])
            self.slot.update(zip(new, range(slot, self.used), strict=True))
        own = np.fromiter((self.slot[w] for w in body), np.int64, len(body))[parts.indices.to_numpy(zero_copy_only=False)]
        n = self.n[own]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.at[own] - (ends - n), n)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(row, np.arange(len(at)))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer or tokenizer_path())
        for batch in batches:
            for rows, data, at in C.slices(batch):
                ids, begins = encode(data, at)
                out: list[list] = [[], [], [], [], []]
                for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    whole = np.append(ids[begins[i] : begins[i + 1]], np.uint32(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(whole), capacity)):
                        part = whole[s : s + capacity]
                        for column, v in zip(out, (doc_id, k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (length, first rank, pieces, first sequence, pieces per sequence, offset) for so many pieces of each length.

    Gaps of one size are intervals of sequence numbers. Pieces of equal length fill a sequence as
    often as they fit, as best fit would: what is left of the smallest gap that takes a piece is
    itself the smallest gap that takes the next one.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, opened = [], 0

    def leave(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                size = sizes[i]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(i)
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            fit = size // length
            full = min(n, left // fit)
            rest = left - full * fit if full < n else 0
            if full:
                out.append((length, rank, full * fit, first, fit, capacity - size))
                leave(size - fit * length, first, full)
            if rest:
                out.append((length, rank + full * fit, rest, first + full, rest, capacity - size))
                leave(size - rest * length, first + full, 1)
            leave(size, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * fit + rest, left - full * fit - rest
    return out


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = made.sparkSession
    order = ["length", "doc_id", "piece", "ids_crc32"]
    made = C.written(made)  # range bounds are sampled: without this, texts would be encoded for the sample too
    ranged = C.written(made.repartitionByRange(F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), *order[1:]).withColumn("part", F.spark_partition_id()), release=True)
    C.forget(made)
    held = ranged.groupBy("length", "part").count()
    from pyspark.sql import Window

    before = held.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` lengths
    rows = sweep(counts, capacity)
    matches = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, first long, n long, sequence long, fit long, at long")
    local = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranged.withColumn("local", F.row_number().over(local) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "part")
    # a match holds many ranks: pieces look it up in the sorted list of their length's matches
    listed = matches.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "fit", "at"))).alias("m"))
    found = ranked.join(F.broadcast(listed), "length").withColumn("m", F.expr("filter(m, x -> rank >= x.first AND rank < x.first + x.n)[0]"))
    k = F.col("rank") - F.col("m.first")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("m.sequence") + F.floor(k / F.col("m.fit"))).cast("long").alias("sequence_id"), (F.col("m.at") + (k % F.col("m.fit")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(pieces(docs, capacity, tokenizer), capacity)


def query(spark, sf_dir):
    return pack(C.table(spark, sf_dir, "documents"))
