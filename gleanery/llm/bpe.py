"""Byte-level BPE over a corpus: every distinct word is encoded once.

One pass splits texts into pre-tokens, in blocks of some megabytes, and writes each block: its documents as positions in the
block's own word list, and that list, cut by word hash. The lists are dealt out, so that equal words of all blocks meet in one
group, where each is encoded once. The ids go back to their blocks (a word crosses the network once per block,
not once per occurrence) and documents are reassembled by position. Blocks are bucketed where they are written and aren't
shuffled; as positions and lists come of the same pass, rows that come in another order when a task is run again do no harm.
What travels is packed.

Decoding looks the ids up in the table of token bytes. That table has as many rows as the vocabulary, which is
what bounds the broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bucketed, few_rows, parts_for

BLOCK_CHARS = 16 << 20
RUN_BITS = 2  # blocks of a run, that is of a group when ids come back: 4
CHUNK_TOKENS = 1 << 18
ROWS = 512  # documents that a worker holds as text at a time


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a file of ``base64 id`` lines. Ids must be gapless."""
    with open(path, "rb") as lines:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines))
    if [i for i, _ in pairs] != list(range(len(pairs))):
        raise ValueError("token ids have gaps")
    return [token for _, token in pairs]


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(raw, count * 4, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


SPLIT = "run long, block long, ids array<long>, lengths array<int>, codes binary, n_words long, lists array<struct<part int, n long, size long, sizes binary, words binary>>"


class _Block:
    """Documents as codes into the words that occur in them."""

    def __init__(self):
        self.ids, self.codes, self.words, self.chars = [], [], {}, 0

    def add(self, doc: int | None, text: str | None, found: Callable) -> None:
        got, words = found(text) if text else (), self.words
        number_of = words.setdefault
        self.ids.append(doc)
        self.codes.append(np.fromiter((number_of(w, len(words)) for w in got), np.uint32, len(got)))
        self.chars += len(text or "")

    def row(self, number: int, parts: int) -> pa.RecordBatch:
        raw = [w.encode("utf-8", "surrogatepass") for w in self.words]
        part = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        flat = place[np.concatenate(self.codes)] if len(raw) else np.zeros(0, np.uint32)
        start = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(raw) else np.zeros(0, np.int64)
        lists = []
        for a, b in zip(start, np.concatenate([start[1:], [len(raw)]]), strict=True):
            own = [raw[i] for i in order[a:b]]
            joined = b"".join(own)
            lists.append({"part": int(part[order[a]]), "n": len(own), "size": len(joined), "sizes": _packed(np.fromiter(map(len, own), np.uint32, len(own))), "words": pa.compress(joined, "zstd", asbytes=True)})
        kinds = {
            "run": pa.int64(), "block": pa.int64(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "codes": pa.large_binary(), "n_words": pa.int64(),
            "lists": pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary())])),
        }
        values = (number >> RUN_BITS, number, self.ids, [len(c) for c in self.codes], _packed(flat), len(raw), lists)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values(), strict=True)], list(kinds))


def _split(pattern: str, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        found = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 24
        block = _Block()
        for batch in few_rows(batches, ROWS):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block.ids and block.chars + len(text or "") > BLOCK_CHARS:
                    yield block.row(number, parts)
                    number, block = number + 1, _Block()
                block.add(doc, text, found)
        if block.ids:
            yield block.row(number, parts)

    return run


CODED = "run long, block long, part int, n long, total long, sizes binary, ids binary"


def _encode_words(tokens, pattern: str) -> Callable:
    """Encode the distinct words of one part; give each block the ids of its words, in its order."""

    def run(group: pa.Table) -> pa.Table:
        import tiktoken

        coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens.value)}, special_tokens={})
        n, size = (group.column(c).to_numpy() for c in ("n", "size"))
        lengths = np.concatenate([_unpacked(z.as_py(), k) for z, k in zip(group.column("sizes"), n, strict=True)])
        joined = b"".join(pa.decompress(z.as_py(), int(k), "zstd", asbytes=True) for z, k in zip(group.column("words"), size, strict=True))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined)])
        # One dictionary over all blocks: each distinct word once.
        coded = words.dictionary_encode()
        ids = [np.asarray(coder._core_bpe.encode_single_piece(w), np.uint32) for w in coded.dictionary.to_pylist()]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        index, ends = coded.indices.to_numpy(), np.cumsum(n)
        own = [index[a:b] for a, b in zip(ends - n, ends, strict=True)]
        return pa.table(
            {
                **{c: group.column(c) for c in ("run", "block", "part", "n")},
                "total": pa.array([int(count[x].sum()) for x in own], pa.int64()),
                "sizes": pa.array([_packed(count[x]) for x in own], pa.binary()),
                "ids": pa.array([_packed(np.concatenate([ids[i] for i in x])) for x in own], pa.binary()),
            }
        )

    return run


def _reassembled(blocks: pa.Table, coded: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """``id, token ids`` of each document of a run of blocks."""
    coded = coded.sort_by([("block", "ascending"), ("part", "ascending")])
    of = coded.column("block").to_numpy()
    for row in range(blocks.num_rows):
        number, ids, lengths, n_words = (blocks.column(c)[row] for c in ("block", "ids", "lengths", "n_words"))
        a, b = np.searchsorted(of, number.as_py()), np.searchsorted(of, number.as_py(), "right")
        mine = coded.slice(a, b - a)
        sizes = np.concatenate([np.zeros(0, np.uint32), *[_unpacked(z.as_py(), n.as_py()) for z, n in zip(mine.column("sizes"), mine.column("n"), strict=True)]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[_unpacked(z.as_py(), n.as_py()) for z, n in zip(mine.column("ids"), mine.column("total"), strict=True)]])
        if len(sizes) != n_words.as_py():
            raise RuntimeError("a block's words did not all come back")
        starts = np.cumsum(sizes) - sizes
        length = lengths.values.to_numpy()
        codes = _unpacked(blocks.column("codes")[row].as_py(), int(length.sum()))
        at = 0
        for doc, n in zip(ids.values.to_pylist(), length.tolist(), strict=True):
            pieces = []
            for first in range(at, at + n, CHUNK_TOKENS):
                c = codes[first : min(first + CHUNK_TOKENS, at + n)]
                s = sizes[c]
                shift = np.repeat(starts[c] - (np.cumsum(s) - s), s)
                pieces.append(flat[shift + np.arange(len(shift))])
            at += n
            yield doc, np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)


def _bytes_of(table: pa.Array, ids: np.ndarray) -> memoryview:
    """Joined entries of a table of bytes, by id: the lookup that a join on the id makes."""
    got = table.take(pa.array(ids, pa.int32()))
    first, last = got.offset, got.offset + len(got)
    offsets = np.frombuffer(got.buffers()[1], np.int32, last + 1)
    return memoryview(got.buffers()[2])[offsets[first] : offsets[last]]


def _digests(tokens) -> Callable:
    def run(key: tuple, block: pa.Table, parts: pa.Table) -> pa.Table:
        table = pa.array(tokens.value, pa.binary())
        names = pa.array([b"%d," % i for i in range(len(tokens.value))], pa.binary())
        out: tuple[list, ...] = ([], [], [], [])
        for doc, ids in _reassembled(block, parts) if block.num_rows else ():
            listed, text = hashlib.sha256(), hashlib.sha256()
            for a in range(0, len(ids), CHUNK_TOKENS):
                part = ids[a : a + CHUNK_TOKENS]
                text.update(_bytes_of(table, part))
                listed.update(_bytes_of(names, part)[: None if a + CHUNK_TOKENS < len(ids) else -1])
            for column, value in zip(out, (doc, len(ids), listed.hexdigest(), text.hexdigest()), strict=True):
                column.append(value)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return run


def _id_lists(key: tuple, block: pa.Table, parts: pa.Table) -> pa.Table:
    rows = list(_reassembled(block, parts)) if block.num_rows else []
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "ids": pa.array([i.astype(np.int32) for _, i in rows], pa.list_(pa.int32()))})


def _encoded(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str, text_col: str, finish: Callable, schema: str) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tokens)
    parts = parts_for(docs, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(spark, ROWS):
        blocks = bucketed(texts.mapInArrow(_split(pattern, parts), SPLIT), "split", "run", parts)
    lists = blocks.select("run", "block", F.explode("lists").alias("own")).select("run", "block", "own.*")
    coded = lists.groupBy("part").applyInArrow(_encode_words(held, pattern), CODED)
    return blocks.drop("lists").groupBy("run").cogroup(coded.groupBy("run")).applyInArrow(finish(held) if finish is _digests else finish, schema)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each row's whole text; null and empty texts have no ids.

    Null ids and repeated rows pass through, each row once. Extra columns are ignored.
    """
    return _encoded(docs, tokens, pattern, id_col, text_col, _id_lists, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes], ids_col: str = "ids") -> DataFrame:
    """Add ``decoded binary`` to rows with a column of ids, by looking ids up in the table of token bytes.

    Null lists decode to null, empty ones to no bytes; an id outside the table raises.
    """
    held = encoded.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        table = pa.array(held.value, pa.binary())
        return pa.array([None if x is None else bytes(_bytes_of(table, np.asarray(x, np.int32))) for x in lists.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", joined(F.col(ids_col)))


def encode_digests(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, then decoded, in one pass."""
    return _encoded(docs, tokens, pattern, id_col, text_col, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    tokens = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens, public_tokenizers.PATTERN)
