"""Quality rules by tokeniser fertility, beside rules on words, symbols, lines and repeats.

Public vocabularies spell the words of a text. Each gives three measures: code
points per token, the share of tokens that are bytes and no character (byte
fallback), and the entropy of the tokens in bits. Texts that a vocabulary was
not made for, such as encoded data, wrongly decoded text or endless variation of
symbols, lie far from the other texts of their language.

The bands come from all documents: for each language (or script, where no
language is given) the quartiles of each measure over the documents that the
base rules keep; a document is rejected where a measure lies further outside
than REACH times the distance of the quartiles and its own sampling error, which
shrinks with the root of its words. Measures are counted by small steps before
quartiles are taken, so that a language of a third of all rows is some hundred counts.

Texts pass Arrow batches whole, some MB or one longer text at a time; equal words
of a batch are spelled once, frequent ones once in some batches. A null text has no words; a text without words has
no tokens and fails the base rules. Rows are judged one by one, so that repeated
rows and ids each get theirs; other columns are ignored, whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.bpe import Encoder, Vocabulary
from crewlens.llm.shared import as_bytes, stored
from crewlens.llm.wordseq import IS_SPACE, by_size

MEASURES = ("chars_per_token", "byte_share", "entropy")
#: Steps in which a measure is counted, and the sampling error allowed to a text of one word.
STEP, SPREAD = (1 / 64, 1 / 1024, 1 / 64), (2.0, 0.5, 4.0)
#: Quartile distances beyond the quartiles that a band reaches.
REACH = 3.0
#: A text has so many words, and so many percent of its words in repeated windows, at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
_BLOCK = 2 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First code points of blocks of letters, and the script of each up to the next.
_SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x32000, "other")]
_NAMES = sorted({s for _, s in _SCRIPTS})
_STARTS, _KINDS = np.array([s for s, _ in _SCRIPTS]), np.array([_NAMES.index(n) for _, n in _SCRIPTS])
#: How byte-level vocabularies of this kind cut texts.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a speller keeps, and code points beyond which a word is spelled alone.
KEPT, _LONG = 1 << 18, 200


class Speller:
    """Spells distinct words into ids; keeps what it has spelled, up to KEPT words, then begins anew. ``is_byte``: ids that are bytes and no character."""

    def __init__(self, spell: Callable[[list[bytes]], list], is_byte: np.ndarray) -> None:
        self.spell, self.is_byte = spell, is_byte
        self._clear()

    def _clear(self) -> None:
        self.place, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each word's begin and how many they are."""
        if len(self.place) > KEPT:
            self._clear()
        new = [w for w in words if w not in self.place]
        if new:
            found = self.spell(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.ids, self.ends[at], self.ends[at + 1] - self.ends[at]


def _is_part(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


def _byte_spell(path: str) -> tuple[Callable, Vocabulary]:
    """Words behind a space by a byte-level vocabulary: short ones laid end to end in one call, as no token crosses a space; long ones and those with other white space alone."""
    import tiktoken

    encoder = Encoder(path, specials=False)
    vocab = encoder.vocab
    made = vocab.result[np.argsort(vocab.rank)]
    ids = np.concatenate([vocab.byte_id, made])
    fast = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks={vocab.token[i]: n for n, i in enumerate(ids.tolist())}, special_tokens={})
    size = np.fromiter((len(vocab.token[i]) for i in ids.tolist()), np.int64, len(ids))

    def spell(words: list[bytes]) -> list:
        texts = [w.decode("utf-8", "replace") for w in words]
        alone = [i for i, t in enumerate(texts) if len(t) > _LONG or not (t.isascii() or len(t.split()) == 1 and not t[0].isspace() and not t[-1].isspace())]
        out: list = [None] * len(words)
        for i, found in zip(alone, encoder.encode([" " + texts[i] for i in alone]) if alone else [], strict=True):
            out[i] = found
        rest = [i for i in range(len(words)) if out[i] is None]
        if rest:
            rank = np.array(fast.encode_ordinary("".join([" " + texts[i] for i in rest])), np.int64)
            end = np.cumsum(np.fromiter((len(texts[i].encode()) + 1 for i in rest), np.int64, len(rest)))
            cut = np.searchsorted(np.cumsum(size[rank]), end) + 1
            for i, found in zip(rest, np.split(ids[rank], cut[:-1]), strict=True):
                out[i] = found
        return out

    return spell, vocab


@functools.cache
def speller(path: str) -> Speller:
    """Of a sentencepiece model (``.model``) or a byte-level vocabulary (``.json``)."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        spell = lambda words: model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return Speller(spell, np.array([model.is_byte(i) for i in range(model.get_piece_size())]))
    spell, vocab = _byte_spell(path)
    return Speller(spell, np.array([_is_part(t) for t in vocab.token]))


def repeated_words(number: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each text, the words inside a window of three that it holds twice or more."""
    at = np.flatnonzero(doc[2:] == doc[:-2])
    covered = np.zeros(len(number), bool)
    if len(at):
        size = int(number.max()) + 1
        window = number[at]
        for i in (1, 2):
            window = np.unique(window * size + number[at + i], return_inverse=True)[1]
        _, window, count = np.unique(window * docs + doc[at], return_inverse=True, return_counts=True)
        often = at[count[window] > 1]
        for i in range(3):
            covered[often + i] = True
    return np.bincount(doc[covered], minlength=docs)


def repeated_lines(text: bytes) -> int:
    """The lines with a word that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters; without letters ``none``, of equally frequent ones the first by name."""
    code = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(_KINDS[np.searchsorted(_STARTS, code, side="right") - 1], minlength=len(_NAMES))
    return _NAMES[int(count.argmax())] if len(code) else "none"


def measures(speller: Speller, words: list[bytes], number: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> list[np.ndarray]:
    """The three measures of each text; zeros for one without tokens."""
    docs = len(chars)
    ids, head, sizes = speller(words)
    pair, times = np.unique(doc * (len(words) + 1) + number, return_counts=True)
    of_doc, word = pair // (len(words) + 1), pair % (len(words) + 1)
    size = sizes[word]
    at = np.repeat(head[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    token, weight, own = ids[at], np.repeat(times, size), np.repeat(of_doc, size)
    total = np.bincount(own, weight, docs)
    some = np.maximum(total, 1)
    spelled, of = np.unique(own * len(speller.is_byte) + token, return_inverse=True)
    count = np.bincount(of, weight, len(spelled))
    spread = np.bincount(spelled // len(speller.is_byte), count * np.log2(np.maximum(count, 1)), docs)
    return [np.where(total > 0, chars / some, 0.0), np.bincount(own, weight * speller.is_byte[token], docs) / some, np.where(total > 0, np.maximum(0, np.log2(some) - spread / some), 0.0)]


_FIELDS = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, measures array<double>"


def _measured(paths: tuple[str, ...]):
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: len(r[0]), _BLOCK):
                texts, ids, langs = map(list, zip(*part, strict=True))
                flat = b"\n".join(texts) + b"\n"
                data = np.frombuffer(flat, np.uint8)
                ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
                begins = ends - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
                inside = ~IS_SPACE[data]
                chars = np.add.reduceat(inside & ((data & 0xC0) != 0x80), begins, dtype=np.int64)
                symbols = np.add.reduceat(_SYMBOL[data], begins, dtype=np.int64)
                start = np.flatnonzero(np.diff(inside, prepend=False) & inside)
                doc = np.searchsorted(ends, start, side="right")
                place: dict[bytes, int] = {}
                number = np.fromiter((place.setdefault(w, len(place)) for w in flat.split()), np.int64, len(start))
                words = list(place)
                lines = np.fromiter(map(repeated_lines, texts), np.int64, len(texts))
                columns = [np.bincount(doc, minlength=len(texts)), chars, symbols, lines, repeated_words(number, doc, len(texts))]
                told = np.array([m for p in paths for m in measures(speller(p), words, number, doc, chars)]).T
                arrays = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array([None if (lang or "").strip(" ") else script(t.decode("utf-8", "replace")) for lang, t in zip(langs, texts, strict=True)], pa.string()), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(list(told), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def base_failed() -> Column:
    """Fewer words than LEAST_WORDS, or more than MOST_REPEATED percent of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measured(docs: DataFrame, paths: list[str]) -> DataFrame:
    """Counts of the base rules, ``script`` of texts without a language, ``base_failed``, ``band`` (language or script) and the three measures of each vocabulary, one after another."""
    rows = docs.select(as_bytes(F.col("text")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    found = rows.mapInArrow(_measured(tuple(paths)), _FIELDS)
    return found.withColumn("base_failed", base_failed()).withColumn("band", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), "script"))


def _pick(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def bands(found: DataFrame, reach: float = REACH) -> DataFrame:
    """For each band, ``lows`` and ``highs``: where each measure's accepted values begin and end, sampling errors apart."""
    step = _pick(STEP, F.col("place"))
    steps = found.where(~F.col("base_failed")).select("band", F.posexplode("measures").alias("place", "value"))
    steps = steps.select("band", "place", F.round(F.col("value") / step).alias("step")).groupBy("band", "place", "step").agg(F.count("*").alias("n"))
    sides = steps.groupBy("band", "place").agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    low, high = F.col("q")[0] * step, F.col("q")[1] * step
    off = reach * (high - low)
    sides = sides.select("band", F.struct("place", (low - off).alias("low"), (high + off).alias("high")).alias("side"))
    sides = sides.groupBy("band").agg(F.array_sort(F.collect_list("side")).alias("sides"))
    return sides.select("band", F.transform("sides", lambda s: s["low"]).alias("lows"), F.transform("sides", lambda s: s["high"]).alias("highs"))


def judged(docs: DataFrame, paths: list[str], reach: float = REACH) -> DataFrame:
    """The columns of ``measured``, ``outside`` (the measures outside their band, by name) and ``kept``."""
    found = stored(measured(docs, paths), "fertility")
    limits = bands(found, reach).withColumnRenamed("band", "of_band")
    joined = found.join(limits, F.col("band") == F.col("of_band"), "left")

    def beyond(value: Column, i: Column) -> Column:
        error = _pick(SPREAD, i) / F.sqrt(F.greatest("n_words", F.lit(1)))
        name = F.concat_ws("_", _pick(MEASURES, i), (F.floor(i / len(MEASURES)) + 1).cast("string"))
        return F.when((value < F.col("lows")[i] - error) | (value > F.col("highs")[i] + error), name)

    outside = F.coalesce(F.array_compact(F.transform("measures", beyond)), F.array().cast("array<string>"))
    return joined.withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("of_band", "lows", "highs")
