"""Byte-level BPE encoding and decoding of whole texts, equal to a public tokenizer's.

Texts are cut into words by the tokenizer's pattern, in numpy. Frequent words go
through a memory-mapped transducer (``lexicon``) that yields their ids; the rest
are merged exactly, all unseen words of a block at once; words share ids only if
their bytes are equal. The words of the lexicon come from a count over all
documents; the ids don't depend on them. A task holds a block of some MB of text
or one longer text whole.

Null texts count as empty and have no tokens. Rows are encoded one by one, so
that repeated rows and repeated or null doc_ids each get theirs. A special token's string in a
text is that token, as the tokenizer has it, unless ``specials`` is False.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.lexicon import Lexicon, compile_lexicon
from crewlens.llm.shared import as_bytes, write_shared
from crewlens.llm.wordseq import by_size, distinct_words

#: Words in the lexicon; words are counted where they stand LOCAL times or more in a block of some MB.
WORDS, LOCAL = 1 << 17, 4
#: Longer words are merged one by one.
_LONG = 256
_BLOCK = 2 << 20
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
#: Code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = _LETTER
        elif first == "N":
            kinds[code] = _NUMBER
    kinds[_WHITE] = _SPACE
    return kinds


def _byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies spell bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Bytes of each id, ids of single bytes, merges as sorted pair keys with rank and result; special strings."""

    token: list[bytes]
    byte_id: np.ndarray
    pair: np.ndarray
    rank: np.ndarray
    result: np.ndarray
    special: dict[str, int]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = spec["model"]["vocab"], _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token = [b""] * (1 + max([*ids.values(), *special.values()]))
    for text, i in ids.items():
        token[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        token[i] = text.encode()
    byte_id = np.zeros(256, np.int64)
    for c, b in letters.items():
        byte_id[b] = ids[c]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    pair = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    result = np.array([ids[a + b] for a, b in merges], np.int64)
    order = np.argsort(pair)
    return Vocabulary(token, byte_id, pair[order], order, result[order], special)


def _split_specials(text: str, special: dict[str, int]) -> list[str | int]:
    """Pieces of text with the ids of special strings between them."""
    parts: list[str | int] = [text]
    for string, i in special.items():
        if string in text:
            parts = [x for p in parts for x in ([p] if isinstance(p, int) else [y for q in p.split(string) for y in (i, q)][1:])]
    return parts


def cut_words(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, start and end of each word, and the number of words before each piece and at the end.

    Follows the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+:
    words are runs of one kind; the last of several spaces before a run stands
    alone or, if it is U+0020, belongs to the run.
    """
    text = "\n" + "\n".join(pieces) + "\n"
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(text.encode(), np.uint8)
    kind = _kinds()[code]
    edge = np.concatenate(([0], np.cumsum(np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces)))))
    kind[edge] = _EDGE
    start = np.empty(len(kind), bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[edge] = True
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != _EDGE))
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # 's, 't, 'm, 'd and 're, 've, 'll at the start of a word
    at = np.flatnonzero((code[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER))
    if len(at):
        one, two = code[at + 1], code[np.minimum(at + 2, len(code) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cut = at[short | long]
        after = cut + np.where(short, 2, 3)[short | long]
        start[cut + 1] = False
        start[after] = True
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    where = np.flatnonzero(start)
    real = kind[where] != _EDGE
    begin = byte[where]
    end = np.append(begin[1:], len(data))[real]
    before = np.searchsorted(where[real], edge)
    return data, begin[real], end, before


def _merge_long(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Merges one long word with a heap of pairs."""
    n = len(symbols)
    after, prior, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            key = symbols[i] << 32 | symbols[j]
            k = int(np.searchsorted(vocab.pair, key))
            if k < len(vocab.pair) and vocab.pair[k] == key:
                heapq.heappush(heap, (int(vocab.rank[k]), i, symbols[i], symbols[j], int(vocab.result[k])))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], gone[j], after[i] = new, True, after[j]
        if after[j] < n:
            prior[after[j]] = i
        push(i)
        if prior[i] >= 0:
            push(prior[i])
    return [s for s, g in zip(symbols, gone, strict=True) if not g]


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words by exact merging, and how many each has.

    A round merges, in every word at once, its pair of least rank from the left.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(length <= _LONG), np.flatnonzero(length > _LONG)
    symbol = vocab.byte_id[np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)]
    word = np.repeat(short, length[short])
    none, done_words, done_symbols = len(vocab.pair), [], []
    for i in long.tolist():
        done_symbols.append(np.array(_merge_long(vocab.byte_id[np.frombuffer(words[i], np.uint8)].tolist(), vocab)))
        done_words.append(np.full(len(done_symbols[-1]), i))
    while len(symbol):
        rank = np.full(len(symbol), none, np.int64)
        key = symbol[:-1] << 32 | symbol[1:]
        at = np.minimum(np.searchsorted(vocab.pair, key), none - 1)
        hit = np.flatnonzero((vocab.pair[at] == key) & (word[:-1] == word[1:]))
        rank[hit] = vocab.rank[at[hit]]
        head = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(word))))
        done = least == none
        if done.any():
            done_words.append(word[done])
            done_symbols.append(symbol[done])
        live = ~done
        pos = np.flatnonzero(live & (rank == least))
        if len(pos):
            # of overlapping places, as in aaa, every second one
            first = np.diff(pos, prepend=-2) != 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            symbol[pos] = vocab.result[at[pos]]
            live[pos + 1] = False
        symbol, word = symbol[live], word[live]
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word, symbol = np.concatenate(done_words), np.concatenate(done_symbols)
    return symbol[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    def __init__(self, path: str, lexicon: Lexicon | None = None, specials: bool = True) -> None:
        self.vocab, self.lexicon = vocabulary(path), lexicon
        self.special = self.vocab.special if specials else {}

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has."""
        number = self.lexicon.find(data, start, end) if self.lexicon else np.full(len(start), -1, np.int64)
        new = np.flatnonzero(number < 0)
        first, of = distinct_words(data, start[new], end[new])
        flat = data.tobytes()
        merged, sizes = merge_words([flat[s:e] for s, e in zip(start[new[first]].tolist(), end[new[first]].tolist(), strict=True)], self.vocab)
        tail = np.concatenate(([0], np.cumsum(sizes)))
        heads = self.lexicon.first if self.lexicon else np.zeros(1, np.int64)
        known = self.lexicon.ids if self.lexicon else np.zeros(0, np.int32)
        pool = np.concatenate((known, merged))
        seen = np.flatnonzero(number >= 0)
        begin, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        begin[seen], size[seen] = heads[number[seen]], heads[number[seen] + 1] - heads[number[seen]]
        begin[new], size[new] = len(known) + tail[of], tail[of + 1] - tail[of]
        before = np.cumsum(size) - size
        return pool[np.repeat(begin - before, size) + np.arange(int(size.sum()))], size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_split_specials(t, self.special) for t in texts]
        pieces = [p for row in parts for p in row if not isinstance(p, int)]
        data, start, end, before = cut_words(pieces)
        ids, size = self._ids(data, start, end)
        total = np.concatenate(([0], np.cumsum(size)))[before].tolist()
        out, k = [], 0
        for row in parts:
            found = []
            for p in row:
                if isinstance(p, int):
                    found.append(np.array([p], np.int32))
                else:
                    found.append(ids[total[k] : total[k + 1]])
                    k += 1
            out.append(found[0] if len(found) == 1 else np.concatenate(found))
        return out


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    return b"".join([vocab.token[i] for i in ids]).decode("utf-8", "replace")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_size(zip(batch.column(0).to_pylist()), lambda r: len(r[0]), 2 * _BLOCK):
            data, start, end, _ = cut_words([r[0].decode() for r in part])
            first, of = distinct_words(data, start, end)
            count = np.bincount(of, minlength=len(first))
            often = (count >= LOCAL) & (end[first] - start[first] <= 64)
            flat, first = data.tobytes(), first[often]
            words = [flat[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(count[often])], names=["word", "n"])


def build_lexicon(docs: DataFrame, path: str, words: int = WORDS) -> str:
    """Compiles the ``words`` most frequent words of all texts, sends the file to every executor, and returns its name.

    Only the lexicon's words pass the driver: ``words`` of them at most, of at most 64 bytes.
    """
    counted = docs.select(as_bytes(F.col("text")).alias("text")).mapInArrow(_count_words, "word binary, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    found = [bytes(r[0]) for r in top.select("word").collect()]
    ids, sizes = merge_words(found, vocabulary(path))
    entries = zip(found, (x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])), strict=True)
    name = f"lexicon-{uuid.uuid4().hex}"
    file = write_shared(docs.sparkSession, name, compile_lexicon(entries if found else ()))
    docs.sparkSession.sparkContext.addFile(file)
    return name


@functools.cache
def _encoder(path: str, lexicon: str | None, specials: bool) -> Encoder:
    return Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None, specials)


def encoded_rows(path: str, lexicon: str | None, specials: bool = True):
    """From record batches (text as bytes first) to the rows behind the text, each with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        encoder = _encoder(path, lexicon, specials)
        for batch in batches:
            for part in by_size(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: len(r[0]), _BLOCK):
                for row, ids in zip(part, encoder.encode([r[0].decode() for r in part]), strict=True):
                    yield row[1:], ids

    return run


def _grouped(rows: Iterator, size: int = 256) -> Iterator[list]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _text_and_id(docs: DataFrame) -> DataFrame:
    return docs.select(as_bytes(F.col("text")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def encode(docs: DataFrame, path: str, lexicon: str | None = None, specials: bool = True) -> DataFrame:
    """doc_id and ids of each row."""
    rows = encoded_rows(path, lexicon, specials)

    def run(batches):
        for part in _grouped(rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _text_and_id(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids; invalid bytes become U+FFFD and null ids an empty text."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode_ids(ids or [], vocab) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded again, without moving ids between processes."""
    rows = encoded_rows(path, lexicon)

    def run(batches):
        vocab = vocabulary(path)
        digits = [str(i) for i in range(len(vocab.token))]
        for part in _grouped(rows(batches)):
            found = [(row[0], ids.tolist()) for row, ids in part]
            joined = [hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest() for _, ids in found]
            again = [hashlib.sha256(decode_ids(ids, vocab).encode()).hexdigest() for _, ids in found]
            columns = [pa.array([d for d, _ in found], pa.int64()), pa.array([len(i) for _, i in found], pa.int64()), pa.array(joined), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _text_and_id(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
