"""Encoding of a corpus by a public byte-level tokenizer, each distinct word once.

Texts are cut to pre-tokens with their positions. A chunk of texts keeps its tokens as one packed
array of word numbers in position order, beside one row per word of the chunk. Words are made distinct
over the whole corpus and encoded once each; their ids are joined back to the chunks, and the chunk's
texts reassembled by position. Only words, and the packed positions once, are shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from attestry.llm.pretokens import cut, text_chunks
from attestry.session import scratch_path

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> bytes:
    """The rank file as it is: below 1 MB whatever the corpus, so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}


_made: dict[int, tiktoken.Encoding] = {}


def encoder(file: bytes) -> tiktoken.Encoding:
    """One encoder per worker process and vocabulary."""
    key = zlib.crc32(file)
    if key not in _made:
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse_ranks(file), special_tokens={})
    return _made[key]


CHUNKS = "chunk long, part int, word binary, number int, stream binary, docs array<long>, counts array<int>"
CHUNK_SCHEMA = pa.schema(
    [
        ("chunk", pa.int64()), ("part", pa.int32()), ("word", pa.binary()), ("number", pa.int32()),
        ("stream", pa.binary()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
    ]
)


def _chunk_rows(id_column: str, text_column: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = batch[text_column], batch[id_column]
            for a, b in text_chunks(texts):
                part = texts.slice(a, b - a)
                t = cut(part)
                counts = np.where(part.is_null().to_numpy(zero_copy_only=False), -1, t.counts).astype("int32")
                packed = zlib.compress(t.index.astype("uint16" if len(t.words) < 65536 else "uint32").tobytes(), 1)
                n = len(t.words)
                nothing = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, chunk)), pa.array(np.full(n, 0, "int32")), t.words, pa.array(np.arange(n, dtype="int32")),
                        nothing(n, pa.binary()), nothing(n, pa.list_(pa.int64())), nothing(n, pa.list_(pa.int32())),
                    ],
                    schema=CHUNK_SCHEMA,
                )
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": chunk, "part": 1, "word": None, "number": n, "stream": packed, "docs": ids.slice(a, b - a).to_pylist(), "counts": counts.tolist()}],
                    schema=CHUNK_SCHEMA,
                )
                chunk += 1

    return rows


def _encode_words(vocab):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            ids = [enc.encode_ordinary(w.decode()) for w in batch["word"].to_pylist()]
            yield pa.record_batch([batch["word"], pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return rows


def _reassemble(empty_ids: list[int], null_ids: list[int], id_column: str):
    def of_chunk(words: pa.Table, streams: pa.Table) -> pa.Table:
        kind = pa.list_(pa.int32())
        docs, lists = [], []
        number = words["number"].to_numpy()
        coded = words["ids"].combine_chunks()
        for s in streams.to_pylist():
            size = np.zeros(s["n_words"] + 1, "int64")
            place = np.zeros(s["n_words"], "int64")
            flat = np.zeros(0, "int32")
            if len(number):
                offsets = coded.offsets.to_numpy()
                flat = coded.values.to_numpy(zero_copy_only=False)
                place[number] = offsets[:-1]
                size[number] = np.diff(offsets)
            stream = np.frombuffer(zlib.decompress(s["stream"]), "uint16" if s["n_words"] < 65536 else "uint32").astype("int64")
            each = size[stream]
            ends = np.cumsum(each)
            out = flat[np.repeat(place[stream] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
            counts = np.array(s["counts"], "int64")
            token_ends = np.cumsum(np.maximum(counts, 0))
            id_ends = np.concatenate([[0], ends])[token_ends]
            bounds = np.concatenate([[0], id_ends]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(out, pa.int32()))
            if (counts <= 0).any() and (empty_ids or null_ids):
                ids = pa.array([null_ids if c < 0 else empty_ids if c == 0 else i for c, i in zip(counts, ids.to_pylist())], kind)
            docs.append(pa.array(s["docs"], pa.int64()))
            lists.append(ids)
        return pa.table({id_column: pa.chunked_array(docs, pa.int64()), "ids": pa.chunked_array(lists, kind)})

    return of_chunk


def encode_corpus(
    docs: DataFrame,
    vocab_file: bytes,
    id_column: str = "doc_id",
    text_column: str = "text",
    empty_ids: tuple[int, ...] = (),
    null_ids: tuple[int, ...] = (),
) -> DataFrame:
    """(``id_column``, ``ids``) of every row, repeated and null ids included, without special tokens.

    An empty text gets ``empty_ids``, a null text ``null_ids``; both are the empty list unless given.
    White space is text like any other. Extra columns are dropped. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocab_file)
    folder = scratch_path(spark, "encode")
    cut_up = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(_chunk_rows(id_column, text_column), CHUNKS)
    # Both readers below need the same chunks: written once, as a table in the shared folder.
    cut_up.write.partitionBy("part").option("compression", "zstd").parquet(folder)
    words = spark.read.schema(CHUNKS).parquet(folder).where("part = 0").select("chunk", "word", "number")
    streams = spark.read.schema(CHUNKS).parquet(folder).where("part = 1").select("chunk", F.col("number").alias("n_words"), "stream", "docs", "counts")
    table = words.select("word").distinct().mapInArrow(_encode_words(vocab), "word binary, ids array<int>")
    back = words.join(table, "word").select("chunk", "number", "ids")
    return (
        back.groupBy("chunk")
        .cogroup(streams.groupBy("chunk"))
        .applyInArrow(_reassemble(list(empty_ids), list(null_ids), id_column), f"{id_column} long, ids array<int>")
    )


def token_table(spark: SparkSession, vocab_file: bytes) -> DataFrame:
    """(token_id, token_bytes) of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in parse_ranks(vocab_file).items()], "token_id int, token_bytes binary")


def decode_corpus(encoded: DataFrame, vocab_file: bytes, id_column: str = "doc_id") -> DataFrame:
    """(``id_column``, ``text``): each id joined with the token-byte table, the bytes of a row put together by position.

    The table has a fixed number of rows and is broadcast, so ids are joined where they lie and a row's tokens stay
    together; nothing is shuffled. Null lists give null, empty ones the empty text; bytes that are no UTF-8 come out as
    U+FFFD; an id the table lacks is an error.
    """
    tokens = token_table(encoded.sparkSession, vocab_file)
    # A null list is the one mark -1, which has no bytes; an empty list has no position.
    each = encoded.select(F.col(id_column).alias("id_"), F.posexplode_outer(F.coalesce("ids", F.array(F.lit(-1)))).alias("pos_", "token_id"))
    known = F.col("token_bytes").isNotNull() | F.col("pos_").isNull() | (F.col("token_id") == -1)
    data = F.when(known, F.col("token_bytes")).otherwise(F.raise_error(F.lit("an id is not in the token table")).cast("binary"))
    joined = each.join(F.broadcast(tokens), "token_id", "left").select("id_", "pos_", data.alias("token_bytes"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kind = None, None  # (id, whether null, bytes) of the row that the last batch ended in
        for batch in batches:
            pos, data, kind = batch["pos_"], batch["token_bytes"], batch["id_"].type
            none = pc.and_(pc.is_valid(pos), pc.is_null(data))
            data = pc.fill_null(data, b"")
            opens = np.flatnonzero(pc.fill_null(pc.equal(pos, 0), True).to_numpy(zero_copy_only=False))
            ends = np.concatenate([opens, [len(pos)]])
            at = np.frombuffer(data.buffers()[1], "int32")[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, "int32")
            whole = data.buffers()[2].to_pybytes() if len(data) and data.buffers()[2] else b""
            pieces = [whole[at[x] : at[y]] for x, y in zip(ends[:-1], ends[1:])]
            if kept is not None:
                kept = (kept[0], kept[1], kept[2] + whole[at[0] : at[ends[0]]])
            found = [] if kept is None or not len(opens) else [kept]
            found += list(zip(batch["id_"].take(pa.array(opens)).to_pylist(), none.take(pa.array(opens)).to_pylist(), pieces))
            if len(opens):
                kept = found.pop()
            if found:
                yield _texts(found, id_column, kind)
        if kept is not None:
            yield _texts([kept], id_column, kind)

    return joined.mapInArrow(rows, f"{id_column} {dict(encoded.dtypes)[id_column]}, text string")


def _texts(rows: list[tuple], id_column: str, kind: pa.DataType) -> pa.RecordBatch:
    texts = [None if none else data.decode(errors="replace") for _, none, data in rows]
    return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array(texts, pa.string())], names=[id_column, "text"])


def token_counts(docs: DataFrame, vocab_file: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id_column``, ``n_tokens``) of every row; null and empty texts have 0. No shuffle: words are
    encoded once per chunk."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocab_file)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            texts, ids = batch[text_column], batch[id_column]
            for a, b in text_chunks(texts):
                t = cut(texts.slice(a, b - a))
                if len(known) > 500_000:  # memory only: words left out are encoded again
                    known.clear()
                sizes = np.zeros(len(t.words), "int64")
                for k, w in enumerate(t.words.to_pylist()):
                    size = known.get(w)
                    if size is None:
                        size = known[w] = len(enc.encode_ordinary(w.decode()))
                    sizes[k] = size
                total = np.concatenate([[0], np.cumsum(sizes[t.index])])
                ends = np.concatenate([[0], np.cumsum(t.counts)])
                yield pa.record_batch([ids.slice(a, b - a), pa.array(np.diff(total[ends]))], names=[id_column, "n_tokens"])

    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(rows, f"{id_column} long, n_tokens long")


