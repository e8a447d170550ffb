"""Words, beginnings and phrases looked up in many texts by joins of equal strings.

What is asked decides which strings are cut out of the texts: only beginnings and
substrings of a length that some asked string with the same first characters has.
So a join is one of equal strings, every match is found, and a word of a million
letters gives a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.functions import text as T
from crewlens.sources.durable import stored

#: Characters by which the lengths of asked strings are looked up, and of a text from each of its places on.
HEAD, WINDOW = 4, 64
#: Most frequent words that are looked up where they stand; slots that beginnings of phrases are hashed to, and characters of a label kept there.
FREQUENT, SLOTS, LABEL = 1 << 16, 1 << 16, 8
_RUN = r"^[\p{L}\p{N}_]+$"


def _slot(head: Column) -> Column:
    return F.pmod(F.xxhash64(head), F.lit(SLOTS))


def _lengths(asked: DataFrame, column: str) -> DataFrame:
    """For each slot of first HEAD characters (fewer, if the string has) the lengths of the strings that begin so: at most SLOTS rows, however many are asked, so that they may go everywhere."""
    return F.broadcast(asked.groupBy(_slot(F.substring(column, 1, HEAD)).alias("slot")).agg(F.array_sort(F.collect_set(F.length(column))).alias("lengths")))


def shuffled(df: DataFrame, grows: bool = True) -> DataFrame:
    """``df`` for a join that is never a broadcast. What grows with the input is small in files long before it is in the driver's memory."""
    return df.hint("merge") if grows else df


def prefix_hits(words: DataFrame, forms: DataFrame, grows: bool = False) -> DataFrame:
    """form and word of all pairs in which the word begins with the form, of HEAD characters or more. words: word; forms: form; ``grows``: forms do so with the words."""
    asked = forms.select("form").where(F.length("form") >= HEAD).distinct()
    near = words.select("word").distinct().join(_lengths(asked, "form"), _slot(F.substring("word", 1, HEAD)) == F.col("slot"))
    begun = near.select("word", F.explode(F.filter("lengths", lambda n: n <= F.length("word"))).alias("n"))
    return begun.select("word", F.substring("word", F.lit(1), F.col("n")).alias("form")).join(shuffled(asked, grows), "form").select("form", "word")


def substring_hits(texts: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """The key columns and phrase of all pairs in which the text holds the phrase anywhere. texts: key columns (one row for each), text; phrases: phrase.

    Each place of a text gives a row of WINDOW characters. Longer phrases are found by
    their first WINDOW and then held against the text.
    """
    asked = phrases.select("phrase").where("phrase != ''").distinct().withColumn("cut", F.substring("phrase", 1, WINDOW))
    at = F.sequence(F.lit(1), F.length("text"))
    here = texts.where("text != ''")
    grams = F.flatten(F.transform(at, lambda i: F.array(*(F.substring("text", i, F.lit(n)) for n in range(1, HEAD)))))
    few = F.broadcast(asked.where(F.length("cut") < HEAD).select(_slot(F.col("cut")).alias("slot")).distinct())
    short = here.select(*key, F.explode(F.array_distinct(grams)).alias("cut")).where(F.length("cut") < HEAD).join(few, _slot(F.col("cut")) == F.col("slot"), "left_semi")
    rest = here.select(*key, F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("text", i, F.lit(WINDOW))))).alias("rest"))
    near = rest.join(_lengths(asked.where(F.length("cut") >= HEAD), "cut"), _slot(F.substring("rest", 1, HEAD)) == F.col("slot"))
    cut = near.select(*key, "rest", F.explode(F.filter("lengths", lambda n: n <= F.length("rest"))).alias("n")).select(*key, F.substring("rest", F.lit(1), F.col("n")).alias("cut"))
    found = short.union(cut).join(shuffled(asked), "cut").select(*key, "phrase").distinct()
    long = F.length("phrase") > WINDOW
    held = found.where(long).join(shuffled(texts.select(*key, "text")), key).where(F.contains("text", F.col("phrase"))).select(*key, "phrase")
    return found.where(~long).union(held)


def _marked_words(forms: DataFrame, vocabulary: DataFrame, grows: bool) -> DataFrame:
    """token and word of all pairs in which a word with marks inside holds the form, which has marks too, as ``variant_pattern`` has it. forms: token, form; vocabulary: word.

    A form begins where a run or the marks between runs do: from each such place a word gives a row of WINDOW characters, cut at the lengths of forms that begin alike.
    """
    asked = forms.withColumn("cut", F.substring("form", 1, WINDOW))
    pieces = vocabulary.where(~F.col("word").rlike(_RUN)).select("word", F.filter(F.split("word", T.PIECE), lambda p: p != "").alias("pieces"))
    at = F.sequence(F.lit(1), F.size("pieces"))
    rests = F.transform(at, lambda i: F.substring(F.array_join(F.slice("pieces", i, F.lit(WINDOW)), ""), 1, WINDOW))
    rest = pieces.where(F.size("pieces") > 0).select("word", F.explode(F.array_distinct(rests)).alias("rest"))
    heads = F.array(*(F.substring("rest", 1, n) for n in range(1, HEAD)))
    few = F.broadcast(asked.where(F.length("cut") < HEAD).select(_slot(F.col("cut")).alias("slot")).distinct())
    short = rest.select("word", F.explode(heads).alias("cut")).join(few, _slot(F.col("cut")) == F.col("slot"), "left_semi")
    near = rest.join(_lengths(asked.where(F.length("cut") >= HEAD), "cut"), _slot(F.substring("rest", 1, HEAD)) == F.col("slot"))
    cut = near.select("word", "rest", F.explode(F.filter("lengths", lambda n: n <= F.length("rest"))).alias("n")).select("word", F.substring("rest", F.lit(1), F.col("n")).alias("cut"))
    found = short.union(cut).distinct().join(shuffled(asked, grows), "cut")
    return found.where(F.contains("word", F.col("form")) & F.regexp_like("word", T.variant_pattern(F.col("form")))).select("token", "word")


def token_words(asked: DataFrame, words: DataFrame, grows: bool = False) -> DataFrame:
    """token and word of all pairs in which the word is a variant of the token or begins with one of 4 characters or more. asked: token; words: word, as ``word_table`` has them; ``grows``: asked does so with the words.

    Tokens with other marks inside, such as node.js, are found in the words that have such marks too, by a run that both hold.
    """
    forms = asked.select("token").distinct().select("token", F.explode(T.token_variants(F.col("token"))).alias("form"))
    vocabulary, plain = words.select("word").distinct(), F.col("form").rlike(_RUN)
    simple = forms.where(plain)
    same = simple.join(shuffled(vocabulary, grows), F.col("form") == F.col("word")).select("token", "word")
    tail = F.substring("word", F.length("form") + 1, F.length("word"))
    begun = prefix_hits(vocabulary, simple, grows).where(tail.rlike("^[a-z0-9]*$")).join(shuffled(simple, grows), "form").select("token", "word")
    return same.union(begun).union(_marked_words(forms.where(~plain), vocabulary, grows)).distinct()


def asked_heads(asked: DataFrame) -> tuple[Callable[[Column], Column], str]:
    """Whether a run of a word, or the marks between runs, may be or begin what is asked: its first HEAD characters stand in one of SLOTS that an asked token's do; and the parts of a marked word that have to be held against it. asked: token.

    One bit for each slot passes the driver, whatever is asked.
    """
    forms = asked.select("token").distinct().select(F.explode(T.token_variants(F.col("token"))).alias("form"))
    first = F.when(F.col("form").rlike(_RUN), F.col("form")).otherwise(F.get(F.filter(F.split("form", T.PIECE), lambda p: p != ""), F.lit(0)))
    slots = forms.select(_slot(F.substring(first, 1, HEAD)).alias("slot"), (~first.rlike(_RUN)).alias("mark"))
    rows = slots.groupBy(F.floor(F.col("slot") / 32).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits"), F.max("mark").alias("mark")).collect()
    bits = [0] * (SLOTS // 32)
    for r in rows:
        bits[r.at] = r.bits
    table = F.expr(f"array({', '.join(f'{b}L' for b in bits)})")

    def kept(part: Column) -> Column:
        slot = _slot(F.substring(part, 1, HEAD)).cast("int")
        return F.getbit(F.get(table, F.shiftright(slot, 5)), F.pmod(slot, F.lit(32))) == 1

    # Marks between runs matter only where an asked token begins with such.
    return kept, T.PIECE if any(r.mark for r in rows) else T.NO_WORD


def word_table(texts: DataFrame, key: list[str], heads: tuple[Callable[[Column], Column], str] | None = None) -> DataFrame:
    """A row for each distinct word of each text, or only of those that may be asked (``asked_heads``): the inverted index. texts: key columns, text."""
    # The search key of a text is computed once; three expressions read it.
    keyed = texts.select(*key, T.query_key(F.col("text")).alias("text"))
    return keyed.select(*key, F.explode(T.words_of_key(F.col("text"), *(heads or ()))).alias("word"))


def token_hits(asked: DataFrame, texts: DataFrame, key: list[str], most: Column | int | None = None, by: list[str] | None = None, grows: bool = False) -> DataFrame:
    """token and key of every text that holds a token, as ``contains_word`` has it. asked: token; texts: key columns (one row for each), text.

    With ``by``, columns of the key that asked has too, a token is asked of these texts only. With
    ``most``, tokens that more texts hold are left out; those with one word that
    already stands in more never meet the index. Then ``hits`` is how many texts hold one.
    The index is stored, as its words are counted and then looked up; only words that begin as an asked one does are in it.
    ``grows``: asked does so with the texts; then it has all words.
    """
    by = by or []
    index = stored(word_table(texts, key, None if grows else asked_heads(asked)), "words")
    held = index.groupBy("word").agg(F.count("*").alias("texts"))
    pairs = token_words(asked, held, grows)
    if by:
        pairs = pairs.join(shuffled(asked.select(*by, "token").distinct(), grows), "token")
    if most is None:
        return pairs.join(shuffled(index, grows), [*by, "word"]).select("token", *key).distinct()
    common = F.max("texts").over(Window.partitionBy("token", *by))
    pairs = pairs.join(shuffled(held, grows), "word").withColumn("most", common).where(F.col("most") <= most)
    found = pairs.join(shuffled(index, grows), [*by, "word"]).select("token", *key).distinct()
    return found.withColumn("hits", F.count("*").over(Window.partitionBy("token", *by))).where(F.col("hits") <= most)


def token_holders(asked: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """token and key of all pairs in which one of the key's texts, which may be many, holds the token. Words are made distinct by key before they meet a token."""
    index = stored(word_table(texts, key, asked_heads(asked)).distinct(), "words")
    return token_words(asked, index).join(index, "word").select("token", *key).distinct()


def least_tokens(asked: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """The key columns and the least label of the tokens that a text holds, as ``token_hits`` finds them. asked: token (one row for each), label; texts: key columns (one row for each), text.

    The least label is found for each word; only words that aren't among the FREQUENT ones leave their text.
    """
    index = stored(word_table(texts, key), "words")
    held = stored(index.groupBy("word").agg(F.count("*").alias("texts")), "held")
    best = stored(token_words(asked, held).join(asked, "token").groupBy("word").agg(F.min("label").alias("label")), "best")
    frequent = F.broadcast(held.orderBy(F.desc("texts"), "word").limit(FREQUENT).select("word").join(best, "word", "left"))
    here = index.join(frequent, "word").where("label is not null")
    others = index.join(frequent, "word", "left_anti").join(best, "word")
    return here.select(*key, "label").union(others.select(*key, "label")).groupBy(*key).agg(F.min("label").alias("label"))


def _between(lengths: str, least: Column, most: Column, fits: Callable[[Column], Column]) -> Column:
    return F.filter(lengths, lambda x: (x["n"] >= least) & (x["n"] <= most) & fits(x["least"]))


def least_phrases(texts: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """The key columns and the least label of the phrases that a text holds anywhere and whose label comes before ``most`` (null: any). texts: key columns (one row for each), text, most; phrases: phrase, label.

    Beginnings of phrases are hashed to SLOTS, which tell the lengths and the first characters of the least label
    of what begins so; a place of a text gives a row only where that label may come before ``most``.
    """
    asked = phrases.where("phrase != ''").withColumn("cut", F.substring("phrase", 1, WINDOW))
    lengths = asked.groupBy(_slot(F.substring("cut", 1, HEAD)).alias("slot"), F.length("cut").alias("n")).agg(F.substring(F.min("label"), 1, LABEL).alias("least"))
    slots = F.broadcast(lengths.groupBy("slot").agg(F.collect_list(F.struct("n", "least")).alias("lengths")))
    at = F.sequence(F.lit(1), F.length("text"))
    pieces = F.array_distinct(F.transform(at, lambda i: F.substring("text", i, F.lit(WINDOW))))
    rest = texts.where("text != ''").select(*key, "most", F.explode(pieces).alias("rest"))
    fits = lambda least: F.col("most").isNull() | (least < F.col("most"))
    # Phrases of HEAD characters or more by the first HEAD, shorter ones by all of theirs.
    cuts = []
    for size in range(1, HEAD + 1):
        near = rest.where(F.length("rest") >= size).join(slots, _slot(F.substring("rest", 1, size)) == F.col("slot"))
        longest = F.length("rest") if size == HEAD else F.lit(size)
        cuts.append(near.select(*key, "most", F.explode(_between("lengths", F.lit(size), longest, fits)).alias("x"), "rest").select(*key, "most", F.substring("rest", F.lit(1), F.col("x.n")).alias("cut")))
    found = cuts[0]
    for c in cuts[1:]:
        found = found.union(c)
    found = found.join(asked, "cut").where(fits(F.col("label"))).select(*key, "phrase", "label")
    long = F.length("phrase") > WINDOW
    held = found.where(long).join(texts.select(*key, "text"), key).where(F.contains("text", F.col("phrase"))).select(*key, "phrase", "label")
    return found.where(~long).union(held).groupBy(*key).agg(F.min("label").alias("label"))
