"""Token counts by a separator scan over flat, unindexed token files.

A token stream is a run of ids of a fixed width, little-endian, in which an
end-of-document id closes every document. Streams come as a table of blocks
(stream, block, tokens); nothing says where documents begin. Each block is
searched for the id in one numpy pass. A prefix scan over the blocks' summaries
(size, number and last place of separators; one row for each block) then
stitches what crosses borders: a running sum of separators numbers the
documents, and a running maximum of the last separator's place tells how many
tokens of an open document lie before a block.

A document that no separator closes counts as the last one of its stream, if it
has tokens. An empty document between two separators has 0 tokens. Repeated rows
and null or repeated doc_ids are documents of their own in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.llm.bpe import _text_and_id, encoded_rows, vocabulary
from crewlens.llm.shared import stored

#: Tokens of a block, and blocks of a flat file that a task reads.
BLOCK, RUN = 1 << 16, 256


def token_type(n: int) -> str:
    """The type of stored ids: the narrowest that holds n of them."""
    return "<u2" if n <= 1 << 16 else "<u4"


def write_streams(docs: DataFrame, path: str, separator: int, lexicon: str | None = None, block: int = BLOCK) -> DataFrame:
    """The documents as token streams, one for each partition: a table of blocks, and of doc_id by stream and ordinal.

    Special tokens' strings are ordinary text here, so that only separators are separators.
    """
    rows = encoded_rows(path, lexicon, specials=False)
    kind = token_type(max(len(vocabulary(path).token), separator + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, number, ordinal, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def out(blocks: list[bytes], ids: list, first: int) -> pa.RecordBatch:
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([stream] * (n + m), pa.int32()), pa.array([*range(number, number + n), *[None] * m], pa.int32()), pa.array([*blocks, *[None] * m], pa.binary()), pa.array([*[None] * n, *range(first, first + m)], pa.int64()), pa.array([*[None] * n, *ids], pa.int64())],
                names=["stream", "block", "tokens", "ordinal", "doc_id"],
            )

        ids: list = []
        for (doc_id,), tokens in rows(batches):
            held += [tokens.astype(kind), np.array([separator], kind)]
            ids.append(doc_id)
            size += len(tokens) + 1
            if size >= block:
                flat = np.concatenate(held)
                full = [flat[i : i + block].tobytes() for i in range(0, size - block + 1, block)]
                yield out(full, ids, ordinal)
                number, ordinal, ids = number + len(full), ordinal + len(ids), []
                held = [flat[len(full) * block :]]
                size = len(held[0])
        yield out([np.concatenate(held).tobytes()] if size else [], ids, ordinal)

    return _text_and_id(docs).mapInArrow(run, "stream int, block int, tokens binary, ordinal long, doc_id long")


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """Blocks of flat token files of any size: tasks read ranges of bytes, which are planned from the files' lengths.

    Files are opened by pyarrow, so that their scheme must be one that it knows on every executor.
    """
    width = np.dtype(kind).itemsize * block
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    runs = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {width * RUN}"))).alias("run")).repartition("path", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as file:
                    for i in range(at * RUN, min((at + 1) * RUN, -(-length // width))):
                        data = file.read_at(min(width, length - i * width), i * width)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([data], pa.binary())], names=["stream", "block", "tokens"])

    return runs.mapInArrow(run, "stream string, block long, tokens binary")


def _scan(separator: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, places = [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), kind)
                size.append(len(tokens))
                places.append(np.flatnonzero(tokens == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["stream", "block", "size", "places"])

    return run


def count_tokens(blocks: DataFrame, separator: int, kind: str = "<u2") -> DataFrame:
    """stream, ordinal (from 0) and n_tokens of every document of the streams. kind: the type of the ids."""
    blocks = blocks.select("stream", F.col("block").cast("long").alias("block"), "tokens")
    of = blocks.schema["stream"].dataType.simpleString()
    seen = stored(blocks.mapInArrow(_scan(separator, kind), f"stream {of}, block long, size long, places array<int>"), "scanned")
    # Of each block only three numbers pass the windows.
    sums = seen.select("stream", "block", "size", F.size("places").alias("n"), F.when(F.size("places") > 0, F.element_at("places", -1)).alias("last"))
    before = "over (partition by stream order by block rows between unbounded preceding and 1 preceding)"
    sums = sums.withColumn("start", F.expr(f"coalesce(sum(size) {before}, 0)")).withColumn("first", F.expr(f"coalesce(sum(n) {before}, 0)"))
    sums = sums.withColumn("last", F.col("start") + F.col("last")).withColumn("open", F.expr(f"coalesce(max(last) {before}, -1)"))
    carried = sums.where("n > 0").select(F.col("stream").alias("of"), F.col("block").alias("at"), "start", "first", "open")
    ends = seen.join(carried, (F.col("stream") == F.col("of")) & (F.col("block") == F.col("at")))
    ends = ends.select("stream", "first", "open", "start", F.posexplode("places").alias("i", "place"), "places")
    begin = F.when(F.col("i") > 0, F.col("start") + F.get("places", F.col("i") - 1)).otherwise(F.col("open"))
    closed = ends.select("stream", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("start") + F.col("place") - begin - 1).alias("n_tokens"))
    rest = sums.groupBy("stream").agg(F.sum("n").cast("long").alias("ordinal"), (F.sum("size") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return closed.select("stream", F.col("ordinal").cast("long").alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens")).union(rest)


def document_tokens(docs: DataFrame, path: str, separator: int, lexicon: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of each document, counted in the token streams written of them."""
    table = stored(write_streams(docs, path, separator, lexicon, block), "streams")
    counted = count_tokens(table.where("block is not null"), separator, token_type(max(len(vocabulary(path).token), separator + 1)))
    names = table.where("block is null").select(F.col("stream").alias("of"), F.col("ordinal").alias("at"), "doc_id")
    return names.join(counted, (F.col("stream") == F.col("of")) & (F.col("ordinal") == F.col("at"))).select("doc_id", "n_tokens")
