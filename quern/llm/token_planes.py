"""Token-ID output in bit-plane shuffled blocks.

Documents are encoded in ascending order of their id and every document ends with one end id.
The ids of a shard (one Spark partition of the id-ordered corpus) form a stream that is cut into
blocks of a fixed number of ids. A block is transposed into byte planes (all lowest bytes, all
second bytes, ...) or bit planes, and each plane is compressed with zstandard. The upper planes
are nearly constant and all but vanish.

The files are Parquet files that Spark writes, so a lost executor's work is redone and committed
once, on any store that Spark can write. A row is a block::

    shard int, block int          place in the corpus: shards and blocks in ascending order
    first long, n_ids int         first id's place in the shard's stream, number of ids
    planes array<binary>          zstandard frames, lowest plane first
    doc_ids array<long>           documents with ids in this block, in order
    doc_starts array<long>        where each of them starts in the shard's stream

All but ``planes`` is the chunk index: Parquet keeps columns apart, so reading the index does not
read ids. Any block can be decoded alone.

Defined cases: a null text is an empty one; an empty text has only the end id; a null doc_id sorts
first and is kept; rows that share a doc_id are separate documents, in order of their text's hash;
a very long text spans blocks and is split into words a piece at a time; an empty table makes no block and reads back as no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import release
from .tokenize import word_encoder

BLOCK_IDS = 65_536
LEVEL = 3
SCHEMA = "shard int, block int, first long, n_ids int, planes array<binary>, doc_ids array<long>, doc_starts array<long>"
#: Rows of an Arrow batch, and about so many bytes of text, that are encoded together; bounds the memory that texts take.
ROWS, TEXT_BYTES = 256, 4 << 20


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of little-endian uint32 ids: 4 of bytes, or 32 of bits (eight ids a byte)."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(rows, axis=1, bitorder="little").T]
    return [np.ascontiguousarray(p).tobytes() for p in rows.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        cols = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        rows = np.packbits(np.stack(cols, axis=1), axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def _block(shard: int, block: int, first: int, ids: np.ndarray, docs: list, bits: bool, compress) -> tuple:
    planes = [compress(p) for p in to_planes(ids, bits)]
    return shard, block, first, len(ids), planes, [d for d, _ in docs], [s for _, s in docs]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``ROWS`` rows whose texts (the second column) take about ``TEXT_BYTES`` together, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        before = ends[lo] - sizes[lo]
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS, bits: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``: the corpus in ascending ``doc_id`` order as compressed blocks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        encoder, shard = word_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        block, first, waiting, held, at, open_docs = 0, 0, [], 0, 0, []

        def cut(data: bytes, last: bool) -> tuple[list[tuple], bytes]:
            """Full blocks of ``data``, and the rest (none if ``last``)."""
            nonlocal block, first, open_docs
            ids, made, k = np.frombuffer(data, "<u4"), [], 0
            while len(ids) - k >= block_ids or last and k < len(ids):
                part = ids[k : k + block_ids]
                till = first + len(part)
                inside = [d for d in open_docs if d[1] < till]
                made.append(_block(shard, block, first, part, inside, bits, compress))
                rest = [d for d in open_docs if d[1] >= till]
                # the last document of this block goes on in the next one unless one starts just there
                open_docs = rest if rest and rest[0][1] == till else inside[-1:] + rest
                block, first, k = block + 1, till, k + len(part)
            return made, data[4 * k :]

        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_pylist()
                for key, ids in zip(keys, encoder.encode(part.column(1).to_pylist()), strict=True):
                    open_docs.append((key, at))
                    waiting += (ids, end)
                    at += len(ids) // 4 + 1
                    held += len(ids) + 4
                if held >= 4 * block_ids:
                    made, rest = cut(b"".join(waiting), False)
                    waiting, held = [rest], len(rest)
                    for row in made:
                        yield _arrow([row])
        made, _ = cut(b"".join(waiting), True)
        for row in made:
            yield _arrow([row])
        release()

    key = F.col(doc_id).cast("long").alias("doc_id")
    ordered = docs.select(key, F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Encode ``docs`` and write the blocks to the folder ``path``."""
    encode_blocks(docs, tokenizer, **options).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: rows of (shard, first, doc_ids, doc_starts, ids array<long>), one a block."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _blocks(batch):
                ids = pa.array([row["ids"].astype(np.int64)], pa.list_(pa.int64()))
                rest = [pa.array([row["shard"]], pa.int32()), pa.array([row["first"]], pa.int64()), *(pa.array([row[k].to_pylist()], pa.list_(pa.int64())) for k in ("doc_ids", "doc_starts"))]
                yield pa.RecordBatch.from_arrays([*rest, ids], ["shard", "first", "doc_ids", "doc_starts", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(decode, "shard int, first long, doc_ids array<long>, doc_starts array<long>, ids array<long>")


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row: its scalars, the documents' ids and starts as Arrow arrays, and the decoded ids."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        row = {k: column[k][i].as_py() for k in ("shard", "first", "n_ids")} | {k: column[k][i].values for k in ("doc_ids", "doc_starts")}
        yield row | {"ids": from_planes([expand(p.as_buffer()) for p in column["planes"][i].values], row["n_ids"])}


def shift_crc(crc: int, n_bytes: int) -> int:
    """The CRC-32 register ``crc`` after ``n_bytes`` zero bytes: times x^(8n) modulo the polynomial."""

    def times(a: int, b: int) -> int:
        product = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                product ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    square, n = 1 << 23, n_bytes  # x^8, bits mirrored
    while n:
        if n & 1:
            crc = times(square, crc)
        square, n = times(square, square), n >> 1
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    Each block is decoded on its own and gives, for every document in it, that part's length and
    CRC-32; the parts of a document that crosses blocks are put together by CRC arithmetic.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _blocks(batch):
                first, n = row["first"], row["n_ids"]
                lo = np.maximum(row["doc_starts"].to_numpy() - first, 0)
                hi = np.append(lo[1:], n)
                data = memoryview(row["ids"].astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * lo).tolist(), (4 * hi).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lo), row["shard"], np.int32)), row["doc_starts"], row["doc_ids"], pa.array(np.full(len(lo), first, np.int64)), pa.array(hi - lo), pa.array(crc, pa.int64())],
                    ["shard", "at", "doc_id", "part", "n", "crc"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The register of a document's only part is its CRC-32; others are shifted by the parts that follow them."""
        for batch in batches:
            found, names = batch.column(4), batch.schema.names
            lengths, items = pc.list_value_length(found).to_numpy(), found.flatten()
            n, crc = items.field("n").to_numpy(), items.field("crc").to_numpy()
            ends = np.cumsum(lengths)
            out = crc[ends - lengths].copy()
            for k in np.flatnonzero(lengths > 1).tolist():
                whole = int(out[k])
                for at in range(int(ends[k] - lengths[k]) + 1, int(ends[k])):
                    whole = shift_crc(whole, 4 * int(n[at])) ^ int(crc[at])
                out[k] = whole
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], [*names[:4], "ids_crc32"])

    stored = spark.read.schema(SCHEMA).parquet(path)
    # one row a shard comes to the driver: as many as there were write tasks
    totals = sorted((r.shard, r.n) for r in stored.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("n")).collect())
    offsets, total = [], 0
    for shard, n in totals:
        offsets.append((shard, total))
        total += n
    found = stored.mapInArrow(parts, "shard int, at long, doc_id long, part long, n long, crc long")
    found = found.groupBy("shard", "at", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
    whole = found.select("shard", "at", "doc_id", "n_tokens", "parts").mapInArrow(joined, "shard int, at long, doc_id long, n_tokens long, ids_crc32 long")
    shards = spark.createDataFrame(offsets, "shard int, offset long")
    # a row a shard
    return whole.join(F.broadcast(shards), "shard").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
