"""Best-fit packing of tokenized documents into fixed-length sequences.

``tokenize`` cuts every document into pieces of at most ``capacity`` tokens.
``pack`` places the pieces best-fit decreasing: longest first, each into the
open sequence with the least room that still fits, which a segment tree over
the remaining capacities finds in logarithmic time.

Pieces of one length are interchangeable, and so are open sequences with the
same room left. The plan is therefore made on counts: one histogram row per
length (``capacity`` rows at most, whatever the corpus) goes to the driver, and
what comes back is a list of runs "the pieces of length L ranked a..b go to the
sequences s..s+n at offset o". That is the very result of best-fit decreasing
over the whole corpus, not of each part of it. Executors then rank the pieces
of each length, salted so that no length is ranked in a single task, and look
their runs up.

Defined cases: a null text is packed as an empty one (its end token alone);
repeated rows are packed each; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .arrow import slices
from .shipping import ship

CAPACITY = 4096
END = 1
#: Salts over which the pieces of one length are ranked, at least.
SALTS = 64
#: Pieces of one length that a salt ranks, about, once there are more than so many for each.
RANKED = 500_000
#: Chunks that a worker's memory of tokenized chunks holds before it starts anew.
REMEMBERED = 1_000_000


#: How the known vocabulary of whole words splits a lower-cased chunk, for printable characters below U+0250.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


class Chunks(dict):
    """Remembers the token ids (little-endian unsigned 32-bit) of white-space separated chunks.

    A vocabulary of lower-cased whole words never joins across white space, so a
    text's ids are those of its chunks in turn; Latin words go straight to the
    merges, and any other chunk goes through the tokenizer whole, as does one that
    holds an added token. Texts of other kinds of vocabularies are tokenized whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        made = json.loads(self.whole.to_str())
        normal, split = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        self.added = [x["content"] for x in made["added_tokens"]]
        apart = not any(x[k] for x in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(re.search(r"\s", x) for x in self.added)
        self.by_word = apart and [x["type"] for x in normal.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split.get("pretokenizers", ())] == ["Split", "ByteLevel"] and split["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        self.words: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: How byte-level vocabularies spell each byte.
        self.spelled = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.raw = [k.to_bytes(4, "little") for k in range(self.whole.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            spelled = word.encode().decode("latin-1").translate(self.spelled)
            got = self.words[word] = b"".join([self.raw[t.id] for t in self.model.tokenize(spelled)])
        return got

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        if any(x in chunk for x in self.added):
            got = self.encode(chunk)
        elif low.isalpha() and (low.isascii() or max(low) < "\u0250"):
            got = self.word(low)
        elif low.isprintable() and (low.isascii() or max(low) < "\u0250"):
            got = b"".join(map(self.word, WORDS.findall(low)))
        else:
            got = self.encode(chunk)
        self[chunk] = got
        return got

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text. Each distinct chunk among the texts is looked up once."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            yield from map(self.encode, texts.to_pylist())
            return
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        known = np.empty(len(coded.dictionary), object)
        known[:] = [self[c] for c in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy(zero_copy_only=False)
        at = 0
        for n in pc.list_value_length(chunks).to_pylist():
            yield b"".join(known[which[at : at + n]].tolist())
            at += n


_chunks: dict[str, Chunks] = {}


def _tokenized(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _chunks:
            _chunks[path] = Chunks(path)
        end, step = END.to_bytes(4, "little"), 4 * capacity
        for part in slices(batches, size=8 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), _chunks[path].texts(part.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows))[: len(names)], kinds)], names=names)

    return run


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32, and their ids as little-endian bytes if asked for."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenized(tokenizer, capacity, with_ids), schema)


class Rooms:
    """A segment tree over 0..capacity that finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room >= size that some open sequence has."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: runs (length, first rank, pieces, first sequence, offset)."""
    rooms, groups = Rooms(capacity), {}  # groups: room -> list of (first sequence, number)
    runs, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # Sequences of their own, each for as many pieces as fit: best fit would fill one before it opens the next.
                each = capacity // length
                full, rest = divmod(left, each)
                for n, pieces in ((full, each), (1, rest)):
                    if not n or not pieces:
                        continue
                    for k in range(pieces):
                        runs.append((length, rank, n, used, k * length))
                        rank += n
                    if over := capacity - pieces * length:
                        groups.setdefault(over, []).append((used, n))
                        rooms.add(over, n)
                    used += n
                left = 0
            else:
                first, n = groups[room].pop()
                took = min(n, left)
                rooms.add(room, -took)
                if n > took:
                    groups[room].append((first + took, n - took))
                runs.append((length, rank, took, first, capacity - room))
                if room > length:
                    groups.setdefault(room - length, []).append((first, took))
                    rooms.add(room - length, took)
                rank, left = rank + took, left - took
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]]):
    """Looks runs up by length and rank: a search in sorted arrays."""
    runs = sorted(runs)
    length, rank, _, first, offset = (np.array(c, np.int64) for c in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 5
    top = {int(x): bisect_right(length, x) for x in set(length.tolist())}
    low = {}
    for k, x in enumerate(length.tolist()):
        low.setdefault(x, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank_in_length"))
            at = np.empty(len(lengths), np.int64)
            for x in np.unique(lengths).tolist():
                own = lengths == x
                at[own] = low[x] + np.searchsorted(rank[low[x] : top[x]], ranks[own], side="right") - 1
            names = batch.schema.names[:5]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + ranks - rank[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, gapless from 0 within a sequence.

    ``pieces`` is read three times and should be a written table.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = max(SALTS, max(totals.values(), default=0) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("salt")
    starts = counts.withColumn("before", F.sum("n").over(by_length) - F.col("n"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("rank_here", F.row_number().over(within) - 1)
        .join(starts.drop("n"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank_here")).alias("rank_in_length"))
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(totals, capacity)), schema) if totals else spark.createDataFrame([], schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize once into a written table, then pack."""
    return pack(scratch.cut(tokenize(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, ids (little-endian bytes, in order of offset).

    Tokens are made again from the texts, so that only this last step moves them.
    """
    ids = tokenize(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    here = packed.alias("p").join(ids.alias("i"), F.col("p.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("p.piece") == F.col("i.piece")) & (F.col("p.ids_crc32") == F.col("i.ids_crc32")))
    joined = F.array_sort(F.collect_list(F.struct("p.offset", "i.ids")))
    return here.groupBy("p.sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("parts")).select("sequence_id", "n_pieces", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
