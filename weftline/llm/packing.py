"""Operator 5: pack token sequences in document order, with window cuts chosen by dynamic programming."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import bounded_batches, documents, partitions, slices

#: Tokens of a sequence at most. Cuts inside a document cost as much as so many padded tokens: after a sentence, or anywhere.
LENGTH, SENTENCE_CUT, PLAIN_CUT = 1024, 4.0, 16.0
#: Where no sentence ends for so many tokens, plain cuts may be made that far apart.
GAP = 128
#: Documents are gathered until they have so many tokens; cuts are chosen within such a block, in a task's memory.
BLOCK = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def padding(lengths: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Padded tokens of sequences: none where the length is a power of two, else up to `most`."""
    lengths = np.asarray(lengths)
    return np.where(lengths & (lengths - 1) == 0, 0, most - lengths)


def choose_cuts(at: np.ndarray, penalty: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Indices of the chosen cuts among candidate positions `at` (ascending from 0, the last one the end).

    They minimise the padding of all windows plus the penalties of the chosen cuts. A window of length l costs
    most - l, so the best start of a window that ends at j has the least cost[i] + at[i] within reach: it stands at the
    head of a monotone queue. Windows of a power of two cost nothing; there are few pairs of candidates so far apart,
    found for all at once. Neighbouring candidates must lie at most `most` apart.
    """
    n = len(at)
    ends, begins, size = [], [], 1
    while size < most:
        before = np.searchsorted(at, at - size)
        hit = np.flatnonzero(at[before] == at - size)
        ends.append(hit)
        begins.append(before[hit])
        size *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    many = np.bincount(ends, minlength=n).tolist()
    begins, next_ = begins[order].tolist(), 0
    place, price = at.tolist(), penalty.tolist()
    cost, last = [0.0] * n, [0] * n
    queue, value, head, tail = [0] * n, [0.0] * n, 0, 1  # the queue is queue[head:tail]
    for j in range(1, n):
        p = place[j]
        while place[queue[head]] < p - most:
            head += 1
        best, i = value[head] + most - p, queue[head]
        if many[j]:
            for k in begins[next_ : next_ + many[j]]:
                if cost[k] < best:
                    best, i = cost[k], k
            next_ += many[j]
        best += price[j]
        cost[j], last[j] = best, i
        best += p
        while tail > head and value[tail - 1] >= best:
            tail -= 1
        queue[tail], value[tail] = j, best
        tail += 1
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = last[j]
    return np.array(cuts[::-1], np.int64)


def sentence_ends(path: str | None = None) -> np.ndarray:
    """Whether a token ends a sentence, by id: it ends in a stop, an exclamation or question mark, or a line feed."""
    with open(path or public_tokenizers.path(tokens.VOCABULARY), encoding="utf-8") as f:
        stored = json.load(f)
    vocabulary, added = stored["model"]["vocab"], [t["id"] for t in stored.get("added_tokens", [])]
    out = np.zeros(max([*vocabulary.values(), *added]) + 1, bool)
    out[[i for t, i in vocabulary.items() if t[-1] in ".!?Ċ"]] = True
    return out


def pack_block(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, most: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Window ends (token positions) of a block of documents. ids: tokens; ends: end of each document, ascending."""
    n = len(ids)
    kind = np.zeros(n + 1, np.int8)  # 1 a sentence's end, 2 a document's end
    kind[1:][is_end[ids]] = 1
    kind[ends] = 2
    at = np.flatnonzero(kind)
    at = np.concatenate([[0], at])
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > GAP)
    if len(wide):
        extra = [np.arange(at[i] + GAP, at[i + 1], GAP) for i in wide]
        at = np.sort(np.concatenate([at, *extra]))
    kinds = kind[at]
    price = np.where(kinds == 2, 0.0, np.where(kinds == 1, SENTENCE_CUT, PLAIN_CUT))
    return at[choose_cuts(at, price, most)], price


def _pieces(ids: np.ndarray, lengths: np.ndarray, windows: np.ndarray):
    """Columns start, length, crc, doc_tokens, window, offset and the document's row of each piece."""
    ends = np.cumsum(lengths)
    cuts = np.union1d(ends, windows)
    opens = np.concatenate([[0], cuts[:-1]])
    row = np.searchsorted(ends, opens, "right")
    window = np.searchsorted(windows, opens, "right")
    begin = (ends - lengths)[row]
    window_begin = np.concatenate([[0], windows])[window]
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    crc = [tokens.zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(opens.tolist(), cuts.tolist(), strict=True)]
    return row, opens - begin, cuts - opens, np.array(crc, np.int64), lengths[row], window, opens - window_begin


def _packer(path: str | None):
    def pack(batches):
        encoder, is_end = tokens.encoder(path), sentence_ends(path)
        sequence = TaskContext.get().partitionId() << 32
        held_ids, held_lengths, held_docs, size = [], [], [], 0

        def flush():
            nonlocal sequence, size
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            docs = pa.concat_arrays(held_docs)
            windows, _ = pack_block(ids, np.cumsum(lengths), is_end)
            row, *columns, window, offset = _pieces(ids, lengths, windows)
            made = [docs.take(pa.array(row))] + [pa.array(c.astype(np.int64)) for c in (*columns, window + sequence, offset)]
            sequence += len(windows)
            held_ids.clear(), held_lengths.clear(), held_docs.clear()
            size = 0
            return pa.RecordBatch.from_arrays(made, NAMES)

        for batch in batches:
            for part, _ in slices(batch, most=1 << 20):
                ids, lengths = with_end(encoder, part.column("text"))
                held_ids.append(ids), held_lengths.append(lengths), held_docs.append(part.column("doc_id"))
                size += len(ids)
                if size >= BLOCK:
                    yield flush()
        if size:
            yield flush()

    return pack


def with_end(encoder: tokens.Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, each followed by the end id, and lengths with it."""
    ids, lengths = encoder.encode_many(texts)
    return np.insert(ids, np.cumsum(lengths), np.uint32(tokens.END)), lengths + 1


def in_order(docs: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id and text in ascending order of doc_id, over partitions that hold successive ranges of ids.

    Rows with one id, or without any, stand in order of their texts' hashes, so that many of them spread over ranges.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    return docs.repartitionByRange(n or partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")


def pack(docs: DataFrame, path: str | None = None, n: int | None = None) -> DataFrame:
    """Pieces (SCHEMA) of docs (doc_id long, text) in sequences of at most LENGTH tokens.

    Documents follow one another in order of doc_id, null ids first, equal ids by their texts' hashes; repeated rows are packed each.
    A null text counts as empty: it is its end id. Each range of ids is packed in blocks of BLOCK tokens (a longer
    document makes its block longer), so no task holds more than that. sequence_id is the partition's number times
    2**32 plus the sequence's number within it.
    """
    return in_order(docs, n).mapInArrow(_packer(path), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents. A null or empty text is its end id; repeated rows are packed each, null ids first."""
    return pack(documents(spark, sf_dir))
