"""Byte-level BPE over a corpus: each distinct word is encoded once.

Encoding:

1. Texts are cut into pre-tokens.  A task gathers consecutive documents into
   blocks of bounded size and keeps, per block, its distinct pre-tokens and the
   position sequence over them.  The blocks are written, bucketed by block.
2. The distinct pre-tokens of all blocks are exploded with their index in the
   block and shuffled by word.  Sorted by word, every distinct word of the
   corpus is met as one run and encoded once; the run's rows carry the ids back
   to their blocks.  A word has at most one row per block, so no word is hot.
3. The ids come back to their block, which is bucketed already and does not
   move, and each document is reassembled by position.

Decoding gathers the bytes of every id from the token-byte table, whose size is
that of the vocabulary.

Defined cases: NULL and empty texts give no ids; NULL or repeated document ids
are carried along, one output row per input row; an empty table gives no rows;
columns other than the two named are ignored, whatever their names.  A text has
to fit a task.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import gather, whole
from opinara.sources.state import store_bucketed

#: Text of a block in UTF-8; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Encoded rows that a task gathers before it sends them back in packed form.
PACK_ROWS = 200_000

_BLOCKS = "block bigint, doc_ids array<bigint>, n_words array<int>, positions binary, words array<string>"
_PACKED = "block bigint, packed binary"


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit integers, by byte planes, compressed."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack_ints(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<u8", 1)[0])
    lengths = np.frombuffer(raw, "<u8", count, 8)
    at, out = 8 * (count + 1), []
    for n in map(int, lengths):
        plane = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(plane.T).view("<u4").reshape(-1))
        at += 4 * n
    return out


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def _piece_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and the start and length of each id's."""
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    lengths = np.zeros(size, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint8)
    for token, rank in ranks.items():
        flat[starts[rank] : starts[rank] + len(token)] = np.frombuffer(token, np.uint8)
    return flat, starts, lengths


def _numbered(pattern, text: str, index: dict, at_once: int = 1 << 18) -> Iterator[np.ndarray]:
    """The words' numbers in the index; a long text's words are never all there at the same time."""
    if len(text) <= at_once:
        yield np.array([index[w] for w in pattern.findall(text)], np.uint32)
        return
    words = (index[m.group()] for m in pattern.finditer(text))
    while len(part := np.fromiter(islice(words, at_once), np.uint32)):
        yield part


def _cut_into_blocks(pattern: str, block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        first = TaskContext.get().partitionId() << 32
        schema = pa.schema(
            [
                ("block", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())),
                ("n_words", pa.list_(pa.int32())),
                ("positions", pa.binary()),
                ("words", pa.list_(pa.string())),
            ]
        )
        blocks = 0

        def fresh():
            index = defaultdict()
            index.default_factory = index.__len__
            return index, [], [], []

        def flush():
            # Frequent words first, for short positions; the many of equal number by name, for words that compress.
            words = sorted(index)
            codes = np.fromiter((index[w] for w in words), np.int64, len(words))
            sequence = np.concatenate(sequences) if sequences else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(sequence, minlength=len(words))[codes], kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[codes[order]] = np.arange(len(words), dtype=np.uint32)
            positions = pack_ints(rank[sequence])
            columns = [[first + blocks], [ids], [counts], [positions], [[words[i] for i in order]]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        (index, ids, counts, sequences), held = fresh(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size = text.as_buffer().size if text.is_valid else 0
                if ids and held + size > block_bytes:
                    yield flush()
                    blocks += 1
                    (index, ids, counts, sequences), held = fresh(), 0
                before = len(sequences)
                sequences.extend(_numbered(compiled, text.as_py(), index))
                ids.append(doc_id)
                counts.append(sum(map(len, sequences[before:])))
                held += size
        if ids:
            yield flush()

    return cut


def _encode_runs(path: str, pattern: str, pack_rows: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _piece_encoder(path, pattern)._core_bpe.encode_single_piece
        blocks, indexes, lengths, flat = [], [], [], []
        last, ids, rows = None, [], 0

        def flush():
            block, index = np.concatenate(blocks), np.concatenate(indexes)
            length, ids = np.array(lengths, np.int64), np.array(flat, np.uint32)
            starts = np.cumsum(length) - length
            order = np.lexsort((index, block))
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            out = []
            for part in np.split(order, cuts):
                steps = np.diff(index[part], prepend=0)
                out.append((int(block[part[0]]), pack_ints(steps, length[part], gather(ids, starts[part], length[part]))))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["block", "packed"]
            )

        for batch in batches:
            blocks.append(batch.column(1).to_numpy())
            indexes.append(batch.column(2).to_numpy())
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, ids = word, piece(word.encode())
                lengths.append(len(ids))
                flat += ids
            rows += batch.num_rows
            if rows >= pack_rows:
                yield flush()
                blocks, indexes, lengths, flat, rows = [], [], [], [], 0
        if rows:
            yield flush()

    return encode


def _reassemble(path: str | None):
    """Documents of a block from its positions and the ids of its words; with ``path`` also the bytes of their ids."""

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack_ints(p.as_py()) for p in right.column("packed")]
        size = 1 + max((int(steps.sum(dtype=np.int64)) for steps, _, _ in parts), default=-1)
        starts, lengths, at = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for steps, length, ids in parts:
            index, length = np.cumsum(steps, dtype=np.int64), length.astype(np.int64)
            starts[index] = at + np.cumsum(length) - length
            lengths[index] = length
            at += len(ids)
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, "<u4")
        out: dict[str, list] = {"doc_id": [], "ids": []} | ({"decoded": []} if path else {})
        for row in left.to_pylist():
            (positions,), begin = unpack_ints(row["positions"]), 0
            for doc_id, count in zip(row["doc_ids"], row["n_words"]):
                at_words = positions[begin : begin + count]
                ids = gather(flat, starts[at_words], lengths[at_words]).astype("<u4")
                out["doc_id"].append(doc_id)
                out["ids"].append(ids.tobytes())
                if path:
                    out["decoded"].append(_bytes_of(ids, path))
                begin += count
        kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()}
        return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})

    return reassemble


def _bytes_of(ids: np.ndarray, path: str) -> bytes:
    flat, starts, lengths = token_bytes(path)
    return gather(flat, starts[ids], lengths[ids]).tobytes()


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    decoded: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids``, the little-endian unsigned 32-bit ids of each text.

    ``path`` is a rank file that every machine can read, ``pattern`` cuts texts into pre-tokens.
    ``decoded`` adds the bytes of the ids, as ``decode`` does, but in the tasks that have just
    reassembled them: a pair of Python workers a slot would need twice the memory.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = store_bucketed(
        docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(
            _cut_into_blocks(pattern, block_bytes), _BLOCKS
        ),
        "bpe_blocks",
        "block",
        parts,
    ).frame
    packed = (
        blocks.select("block", F.posexplode("words").alias("position", "word"))
        .select("word", "block", "position")
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_encode_runs(path, pattern, PACK_ROWS), _PACKED)
    )
    return (
        blocks.select("block", "doc_ids", "n_words", "positions")
        .groupBy("block")
        .cogroup(packed.groupBy("block"))
        .applyInArrow(_reassemble(path if decoded else None), "doc_id bigint, ids binary" + ", decoded binary" * decoded)
    )


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns, and ``decoded``, the bytes of the ids; unknown ids raise."""
    schema = encoded.withColumn("decoded", F.lit(b"")).schema

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_bytes_of(np.frombuffer(row.as_py() or b"", "<u4"), path) for row in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join_bytes, schema)
