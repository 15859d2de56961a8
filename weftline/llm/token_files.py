"""Operator 7: token ids in files of static range asymmetric numeral systems (rANS), and back.

A file is a Parquet table, so that any store Spark reaches can hold it; a row is a segment: the ids of successive
documents in order of doc_id, coded by one frequency table that the segment's independent blocks share.

    segment := magic, crc32 of what follows, length of the JSON header, header, sections
    header  := documents, tokens, block and lane counts, lengths of the sections, and per block a checkpoint:
               first token, first word of the stream, crc32 of its words, crc32 of its ids
    sections := frequency table (symbols and frequencies), document table (doc_id, null flag, tokens),
                final states of the lanes by block, words of all blocks
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .packing import in_order, with_end
from .shared import documents, runs, slices, written

MAGIC = b"WLR1"
#: Frequencies sum to 2**SCALE; states lie in [LOW, LOW << 32) and give out words of 32 bits.
SCALE, LOW = 20, np.uint64(1 << 31)
#: Interleaved coders of a block, tokens of a block, and tokens after which a segment ends.
LANES, BLOCK, SEGMENT = 128, 1 << 17, 1 << 22

_S, _32 = np.uint64(SCALE), np.uint64(32)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, and frequencies of at least 1 in proportion to their counts that sum to 2**SCALE."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("too many symbols for the frequency scale")
    spare = (1 << SCALE) - len(symbols)
    freq = 1 + (counts * spare) // counts.sum()
    freq[np.argmax(freq)] += (1 << SCALE) - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint64)


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, block: int = BLOCK, lanes: int = LANES):
    """Final states (blocks x lanes) and the words of each block. Token i of a block belongs to lane i mod lanes.

    The last block is filled up with the first symbol; its true length is in the checkpoint. All lanes of all blocks
    are stepped at once.
    """
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    blocks = -(-len(ids) // block)
    rows = block // lanes if blocks > 1 else -(-len(ids) // lanes)
    index = np.zeros(blocks * rows * lanes, np.int32)
    index[: len(ids)] = np.searchsorted(symbols, ids)
    index = index.reshape(blocks, rows, lanes)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words, owners = [], []
    owner = np.repeat(np.arange(blocks, dtype=np.int32), lanes).reshape(blocks, lanes)
    for r in range(rows - 1, -1, -1):
        s = index[:, r]
        f = freq[s]
        full = state >= f << np.uint64(63 - SCALE)
        if full.any():
            words.append(state[full].astype(np.uint32))
            owners.append(owner[full])
            state[full] >>= _32
        q, rest = np.divmod(state, f)
        state = (q << _S) + rest + start[s]
    words, owners = words[::-1], owners[::-1]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    of = np.concatenate(owners) if owners else np.zeros(0, np.int32)
    order = np.argsort(of, kind="stable")
    return state, np.split(flat[order], np.cumsum(np.bincount(of, minlength=blocks))[:-1]), rows


def decode_blocks(states: np.ndarray, streams: list[np.ndarray], rows: int, symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Ids of the given blocks, whole; any selection of a segment's blocks can be decoded apart from the others."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot_symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
    state = states.copy()
    words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in streams])[:-1]]).astype(np.int64)
    out = np.empty((len(streams), rows, state.shape[1]), np.int32)
    mask = np.uint64((1 << SCALE) - 1)
    for r in range(rows):
        slot = state & mask
        s = slot_symbol[slot.astype(np.int64)]
        out[:, r] = s
        state = freq[s] * (state >> _S) + slot - start[s]
        low = state < LOW
        taken = low.cumsum(axis=1)
        place = (at[:, None] + taken - 1)[low]
        state[low] = (state[low] << _32) | words[place]
        at += taken[:, -1]
    if not (state == LOW).all():
        raise ValueError("a block's lanes don't end in the starting state")
    return symbols[out.reshape(len(streams), -1)]


def write_segment(doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bytes of a segment. ids: uint32 tokens of all documents; lengths: tokens of each."""
    symbols, freq = frequencies(ids)
    states, streams, rows = encode_blocks(ids, symbols, freq)
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    known = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    docs = zlib.compress(np.diff(known, prepend=0).astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), 1)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    checkpoints = [[b * BLOCK, int(begins[b]), zlib.crc32(s.astype("<u4").tobytes()), tokens.crc32(ids[b * BLOCK : (b + 1) * BLOCK])] for b, s in enumerate(streams)]
    sections = [table, docs, states.astype("<u8").tobytes(), np.concatenate(streams).astype("<u4").tobytes()]
    header = json.dumps({"documents": len(lengths), "tokens": len(ids), "symbols": len(symbols), "rows": rows, "lanes": LANES, "sections": [len(s) for s in sections], "checkpoints": checkpoints}).encode()
    body = struct.pack("<I", len(header)) + header + b"".join(sections)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Segment:
    """A segment's tables; blocks are decoded on demand."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[8:]) != struct.unpack_from("<I", data, 4)[0]:
            raise ValueError("not a segment, or a damaged one")
        (size,) = struct.unpack_from("<I", data, 8)
        self.header = json.loads(data[12 : 12 + size])
        at, parts = 12 + size, []
        for n in self.header["sections"]:
            parts.append(memoryview(data)[at : at + n])
            at += n
        n, d = self.header["symbols"], self.header["documents"]
        table = zlib.decompress(parts[0])
        self.symbols = np.cumsum(np.frombuffer(table, "<u4", n), dtype=np.uint32)
        self.freq = np.frombuffer(table, "<u4", n, 4 * n).astype(np.uint64)
        docs = zlib.decompress(parts[1])
        null = np.unpackbits(np.frombuffer(docs, np.uint8, offset=16 * d), count=d).astype(bool)
        self.doc_ids = pa.array(np.cumsum(np.frombuffer(docs, "<i8", d)), mask=null)
        self.lengths = np.frombuffer(docs, "<i8", d, 8 * d)
        self.states = np.frombuffer(parts[2], "<u8").reshape(-1, self.header["lanes"])
        self.words = np.frombuffer(parts[3], "<u4")

    def blocks(self, which: list[int] | None = None) -> np.ndarray:
        """Ids of the given blocks (all of them by default), checked against their checkpoints."""
        marks, total = self.header["checkpoints"], self.header["tokens"]
        which = list(range(len(marks))) if which is None else which
        ends = [m[1] for m in marks[1:]] + [len(self.words)]
        streams = [self.words[marks[b][1] : ends[b]] for b in which]
        for b, s in zip(which, streams, strict=True):
            if zlib.crc32(s.tobytes()) != marks[b][2]:
                raise ValueError(f"block {b} is damaged")
        ids = decode_blocks(self.states[which], streams, self.header["rows"], self.symbols, self.freq).reshape(len(which), -1)
        out = [x[: min(BLOCK, total - marks[b][0])] for b, x in zip(which, ids, strict=True)]
        for b, x in zip(which, out, strict=True):
            if tokens.crc32(x) != marks[b][3]:
                raise ValueError(f"block {b} doesn't decode to its ids")
        return np.concatenate(out)


FILE_SCHEMA = "part int, segment int, first long, n_tokens long, data binary"


def _writer(path: str | None, segment: int):
    def write(batches):
        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        held, size, number, first = [], 0, 0, 0

        def flush():
            nonlocal size, number, first
            ids, lengths = np.concatenate([x for x, _, _ in held]), np.concatenate([x for _, x, _ in held])
            data = write_segment(pa.concat_arrays([x for _, _, x in held]), ids, lengths)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([data], pa.binary())], ["part", "segment", "first", "n_tokens", "data"])
            held.clear()
            size, number, first = 0, number + 1, first + len(ids)
            return row

        for batch in batches:
            for rows, _ in slices(batch, most=1 << 20):
                ids, lengths = with_end(encoder, rows.column("text"))
                held.append((ids, lengths, rows.column("doc_id")))
                size += len(ids)
                if size >= segment:
                    yield flush()
        if size:
            yield flush()

    return write


def encode(docs: DataFrame, path: str | None = None, n: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Segments (FILE_SCHEMA) of docs (doc_id long, text) in ascending order of doc_id, null ids first, equal ids by their texts' hashes.

    A null text counts as empty; each document ends with the end id. `part` numbers ranges of ids, `segment` those of a
    part, `first` is the number of its part's ids before it. A task holds one segment's ids at a time.
    """
    return in_order(docs, n).mapInArrow(_writer(path, segment), FILE_SCHEMA)


def _read(batches):
    for batch in batches:
        for data, base in zip(batch.column("data"), batch.column("base").to_pylist(), strict=True):
            part = Segment(data.as_py())
            ids, lengths = part.blocks(), part.lengths
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.doc_ids, pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the segments of `files`.

    Segments are decoded apart from one another. The only thing gathered is a total by part (as many rows as tasks wrote).
    """
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = np.cumsum([0] + [n for _, n in totals]).tolist()
    bases = files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "part int, before long")
    placed = files.join(F.broadcast(bases), "part").select("data", (F.col("before") + F.col("first")).alias("base"))
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all documents' ids, read back. A null or empty text is its end id; null ids come first, repeated rows
    stand each."""
    return read(written(encode(documents(spark, sf_dir)), "token-files"))
