"""Fill-in-middle transformation of whole texts by block rotation, and its exact inverse.

A text's n units are its lines, each with its line feed. Two counts drawn from
the hash of the doc_id cut it into prefix, middle and suffix. In a bytearray
that holds the text, each part gets its sentinel, and the order wanted is made
by exchanging two neighbouring segments in place: reverse each, then both as
one. The inverse finds the sentinels, exchanges the same segments back and
deletes them.

The draws are DataFrame functions; only the bytes are moved in Arrow batches,
some MB or one longer text at a time. Texts that hold a sentinel, empty and null
texts stay as they are (form ``plain``; null counts as empty). A null doc_id is
hashed as an empty one; rows are made one by one, so that repeated ones each get
theirs. Other columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.shared import as_bytes, fresh
from crewlens.llm.wordseq import by_size

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BLOCK = 1 << 16


def reverse(data: np.ndarray, start: int, end: int) -> None:
    """Turns bytes start to end round, block against block from both ends inwards."""
    while end - start > 1:
        n = min(_BLOCK, (end - start) // 2)
        head = data[start : start + n].copy()
        data[start : start + n] = data[end - n : end][::-1]
        data[end - n : end] = head[::-1]
        start, end = start + n, end - n


def rotate(data: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchanges the segments start to cut and cut to end by three reversals."""
    reverse(data, start, cut)
    reverse(data, cut, end)
    reverse(data, start, end)


def cut_places(text: bytes, *counts: int) -> list[int]:
    """Where the first so many lines end."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    return [0 if not k else int(feeds[k - 1]) if k <= len(feeds) else len(text) for k in counts]


def arrange(text: bytes, first: int, second: int, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text cut at two places: prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``), each behind its sentinel."""
    p, s, m = sentinels
    data = bytearray(text)
    for place, mark in ((second, s), (first, m), (0, p)):
        data[place:place] = mark
    middle, suffix = len(p) + first, len(p) + len(m) + second
    rotate(np.frombuffer(data, np.uint8), middle if form == "psm" else 0, suffix, len(data))
    return bytes(data)


def rearrange(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    p, s, m = sentinels
    data = bytearray(output)
    start = 0 if form == "spm" else data.index(s)
    rotate(np.frombuffer(data, np.uint8), start, data.index(p if form == "spm" else m), len(data))
    for mark in (s, m, p):
        at = data.index(mark)
        del data[at : at + len(mark)]
    return bytes(data)


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, ...]:
    """The inverse finds a sentinel at one place only if none begins as another, or itself, ends."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[:i] == b[len(b) - i :] for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r} and {b!r}")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ")
    return tuple(s.encode() for s in sentinels)


def _chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _made(sentinels: tuple[bytes, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: len(r[1])):
                sizes, outputs = [], []
                for _, text, _, form, one, two in part:
                    if form == "plain":
                        sizes.append((None, None))
                        outputs.append(text)
                    else:
                        first, second = cut_places(text, one, two)
                        sizes.append((_chars(text[:first]), _chars(text[first:second])))
                        outputs.append(arrange(text, first, second, form, sentinels))
                ids, _, n, forms, _, _ = zip(*part, strict=True)
                prefix, middle = zip(*sizes, strict=True)
                columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def draw(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and doc_id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and output of each row.

    ``rate`` of a hundred texts are transformed, ``spm_rate`` of a hundred of these suffix first.
    """
    marks = _checked(sentinels)
    text = F.coalesce(F.col("text"), F.lit(""))
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    n = (feeds + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")).cast("long")
    h = draw(F.col("doc_id"), seed)
    whole = (text == "") | (h[2] % 100 >= rate)
    for s in sentinels:
        whole |= F.contains(text, F.lit(s))
    form = F.when(whole, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("text"), n.alias("n"), form.alias("form"), *(x.alias(f"h{i}") for i, x in enumerate(h)))
    one, two = (F.col(c) % (F.col("n") + 1) for c in ("h0", "h1"))
    cuts = cuts.select("doc_id", "text", "n", "form", F.least(one, two).alias("one"), F.greatest(one, two).alias("two"))
    return cuts.mapInArrow(_made(marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All columns and the text that each row's output and form were made of, as ``restored`` (or a longer free name)."""
    marks, name = _checked(sentinels), fresh(made, "restored")
    names = [*made.columns, name]
    n, form = len(made.columns), made.columns.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(n).to_pylist(), batch.column(form).to_pylist(), strict=True)
            texts = pa.array([None if o is None else rearrange(o, f, marks) for o, f in pairs], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], texts], names=names)

    schema = T.StructType([*made.schema.fields, T.StructField(name, T.StringType())])
    return made.select("*", F.col("output").cast("binary").alias(fresh(made, "output_bytes"))).mapInArrow(run, schema)
