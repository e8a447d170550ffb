"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four patterns find the seeds: e-mail and IP addresses, card and phone numbers.
The word and the two words beside an identifier are lexical patterns; other
identifier-like words and runs of spaced numbers, with four digits or more, are
their possible instances. Spark scores this graph of patterns and instances in
rounds, until a round finds no more. A pattern is trusted for a kind if

* FEW or more distinct known instances of the kind stand by it,
* they are at least PURE of the distinct instances that do (F / N), and
* an identifier follows (or precedes) it in at least SHARP of all places where
  the corpus has it, so that common words never become patterns. For two words
  the places of the rarer one count, which are no fewer: pairs of words that are
  both common elsewhere are not trusted.

Instances by trusted patterns become known, if the patterns' confidences F / N
leave a doubt, multiplied over patterns, of at most DOUBT; in the next round they
support the patterns beside them. Their places come on top of the seeds, which
all stay.

Null texts count as empty. Documents are told apart by doc_id and text, so
doc_id may be null or repeat; every row gets its spans. Positions are code
points, ends exclusive. Regular expressions are possessive where that changes
nothing, so that long runs of digits or dots neither backtrack nor recurse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.shared import drop_stored, fresh, row_key, stored

KINDS = ("email", "ip", "card", "phone")
FEW, PURE, SHARP, DOUBT = 4, 0.6, 0.2, 0.5
#: Characters of context that are looked at beside a span, and the longest identifier that contexts add. A longer word is no pattern.
_NEAR = 64
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    # A match begins where a run of its characters begins, or right behind the match before.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: words that hold a digit, with the groups of digits that follow after single spaces.
_ODD = "[0-9A-Za-z.@_+()/-]"
_CANDIDATE = rf"(?<!{_ODD})(?=[A-Za-z.@_+()/-]*+[0-9]){_ODD}++(?:\x20(?=[()./+-]*+[0-9])[0-9()./+-]++(?!{_ODD}))*+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BYTE_PARTS = rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body holds lambdas."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_BYTE_PARTS)
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "other":
        return F.length(match).between(6, _NEAR) & (F.length(_digits(match)) >= 4)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """The valid matches of a pattern: start, end, value, and the text beside them.

    split() and regexp_extract_all() cut a text at the same matches; sums of the
    lengths, in chunks of 256, give the positions in about linear time.
    """

    def found(both: Column) -> Column:
        match, piece = both["match"], both["piece"]
        n = F.size(match)

        def placed(steps: Column) -> Column:
            total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
            chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), lambda c: total(F.slice(steps, c * 256 + 1, F.lit(256))))

            def span(heads: Column) -> Column:
                def one(i: Column) -> Column:
                    part = F.floor(i / 256).cast("int")
                    start = F.get(heads, part) + total(F.slice(steps, part * 256 + 1, i % 256)) + F.length(F.get(piece, i))
                    return F.struct(
                        start.cast("long").alias("start"),
                        (start + F.length(F.get(match, i))).cast("long").alias("end"),
                        F.get(match, i).alias("value"),
                        F.substring(F.get(piece, i), F.lit(-_NEAR), F.lit(_NEAR)).alias("left"),
                        F.substring(F.get(piece, i + 1), F.lit(1), F.lit(_NEAR)).alias("right"),
                    )

                good = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _valid(kind, F.get(match, i)))
                return F.transform(good, one)

            heads = lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda c: total(F.slice(sums, F.lit(1), c)))
            return _let(_let(chunks, heads), span)

        return _let(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.get(piece, i)) + F.length(F.get(match, i))), placed)

    def cut(match: Column) -> Column:
        return F.when(F.exists(match, lambda m: _valid(kind, m)), _let(F.struct(match.alias("match"), F.split(text, pattern, -1).alias("piece")), found))

    hint = {"email": "@", "phone": "+"}.get(kind)
    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)
    spans = F.when(text.contains(hint), spans) if hint else spans
    return F.coalesce(spans, F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string, left: string, right: string>>)"))


def _plain(text: Column) -> Column:
    """Text as context words are compared: lower case, every digit a 9."""
    return F.translate(F.lower(text), "0123456789", "9999999999")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, and for each kind the array of its spans; ``other`` holds what may be an identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), text.alias("text"))
    kinds = [*((k, _PATTERN[k]) for k in KINDS), ("other", _CANDIDATE)]
    return docs.select("doc_id", "key", *(_spans(F.col("text"), k, p).alias(k) for k, p in kinds))


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each span and possible identifier, those that touch a seed left out."""
    kind = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right")))
    rows = found.where(" or ".join(f"size({k}) > 0" for k in (*KINDS, "other")))
    rows = rows.select("key", F.explode(F.concat(*(kind(k) for k in (*KINDS, "other")))).alias("s")).select("key", "s.*").distinct()
    before = F.expr("max(case when kind <> 'other' then end end) over (partition by key order by start, end rows between unbounded preceding and current row)")
    after = F.expr("min(case when kind <> 'other' then start end) over (partition by key order by start, end rows between current row and unbounded following)")
    rows = rows.withColumn("before", before).withColumn("after", after)
    rows = rows.where("kind <> 'other' or (coalesce(before, 0) <= start and coalesce(after, end) >= end)")
    return rows.select("key", "kind", "start", "end", "value", *(_context(_plain(s), s).alias(s) for s in ("left", "right")))


def _context(words: Column, side: str) -> Column:
    """The patterns of one side: the nearest word, and the two nearest. ``words`` is the text beside a span, as it stands."""
    one = {"left": r"(\S+)\s+$", "right": r"^\s+(\S+)(?:\s|$)"}[side]
    two = {"left": r"(\S+\s+\S+)\s+$", "right": r"^\s+(\S+\s+\S+)(?:\s|$)"}[side]
    found = F.array(F.regexp_extract(words, one, 1), F.regexp_replace(F.regexp_extract(words, two, 1), r"\s+", " "))
    return F.filter(found, lambda p: p != "")


def _places(docs: DataFrame) -> DataFrame:
    """How often each word stands in the corpus."""
    words = F.split(_plain(F.coalesce(F.col("text"), F.lit(""))), r"\s+")
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("places"))


def discover(docs: DataFrame, found: DataFrame) -> DataFrame:
    """key, kind, start and end of the places that trusted patterns add.

    Rounds go on until they know no more instances. More known instances only
    make more patterns trusted, so that a fixed point is reached.
    """
    mentions = stored(_mentions(found), "mentions")
    sides = F.concat(*(F.transform(F.col(s), lambda p, s=s: F.struct(F.lit(s).alias("side"), p.alias("pattern"))) for s in ("left", "right")))
    beside = mentions.select("kind", "value", F.explode(sides).alias("p")).select("kind", "value", "p.*")
    # FEW distinct values, known or not yet, have to stand by a pattern, in SHARP of all its places.
    uses = beside.groupBy("side", "pattern").agg(F.count("*").alias("uses"), F.count_distinct("value").alias("n")).where(F.col("n") >= FEW)
    # Two words stand together in as many places as the rarer of them at most.
    words, parts = _places(docs), F.split("pattern", " ")
    uses = uses.select("*", parts[0].alias("one"), F.element_at(parts, -1).alias("two"))
    for part in ("one", "two"):
        uses = uses.join(words.select(F.col("word").alias(part), F.col("places").alias(f"places of {part}")), part)
    sharp = uses.where(F.col("uses") >= SHARP * F.least("places of one", "places of two")).select(F.col("side").alias("of_side"), F.col("pattern").alias("of_pattern"), "n")
    same = (F.col("side") == F.col("of_side")) & (F.col("pattern") == F.col("of_pattern"))
    edges = beside.join(sharp, same).select("side", "pattern", "n", "value", F.when(F.col("kind") != "other", F.col("kind")).alias("kind")).distinct()
    edges = stored(edges, "edges")
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    links, fresh_ones, n = edges.select("side", "pattern", "n", "value").distinct(), None, 0
    unknown = links.join(seeds.select("value").distinct(), "value", "left_anti")
    while True:
        known = seeds if fresh_ones is None else seeds.union(fresh_ones)
        of = known.select(F.col("value").alias("known"), F.col("kind").alias("as"))
        # A pattern's support: its distinct known instances, from the seeds and from all rounds before.
        hits = links.join(of, F.col("value") == F.col("known")).groupBy("side", "pattern", "n", "as").agg(F.count("*").alias("f"))
        trust = hits.where((F.col("f") >= FEW) & (F.col("f") >= PURE * F.col("n")))
        trust = trust.select(F.col("side").alias("of_side"), F.col("pattern").alias("of_pattern"), "as", F.least(F.col("f") / F.col("n"), F.lit(0.99)).alias("sure"))
        scored = unknown.join(trust, same).groupBy("value", "as").agg(F.sum(F.log(1 - F.col("sure"))).alias("doubt"))
        scored = scored.where(F.col("doubt") <= F.log(F.lit(DOUBT)))
        best = stored(scored.groupBy("value").agg(F.min_by("as", F.struct("doubt", "as")).alias("kind")), "instances")
        now = best.count()
        if fresh_ones is not None:
            drop_stored(fresh_ones)
        fresh_ones = best
        if now <= n:
            break
        n = now
    other = mentions.where("kind = 'other'").drop("kind", "left", "right")
    return other.join(fresh_ones, "value").select("key", "kind", "start", "end")


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans of each row: arrays of (no, start, end, kind), by kind and start.

    ``base`` holds the seeds, ``spans`` those that contexts add as well.
    """
    found = stored(find_spans(docs), "spans")
    numbered = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(KINDS.index(k)).alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = found.select("doc_id", "key", F.concat(*(numbered(k) for k in KINDS)).alias("base"))
    number = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    added = discover(docs, found).groupBy(F.col("key").alias("of")).agg(F.collect_set(F.struct(number.alias("no"), "start", "end", "kind")).alias("added"))
    both = base.join(added, F.col("key") == F.col("of"), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return both.select("doc_id", "key", "base", spans.alias("spans"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of seeds by kind, base_sha256 and spans, as lists kind:start:end."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = personal_data(docs)
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_span_list(F.col("base")), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of their texts replaced by its kind in brackets; all their columns."""
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    own, other, listed = fresh(docs, "key"), fresh(docs, "key of spans"), fresh(docs, "spans")
    found = personal_data(docs).where(F.size("spans") > 0).select(F.col("key").alias(other), by_start.alias(listed)).dropDuplicates([other])
    rows = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text"))).join(found, F.col(own) == F.col(other), "left")
    text, spans = F.col("text"), F.col(listed)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    clean = F.when(spans.isNull(), text).otherwise(F.aggregate(spans, empty, step, finish))
    return rows.select(*(clean.alias(c) if c == "text" else F.col(c) for c in docs.columns))
