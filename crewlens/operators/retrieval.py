"""Retrieval over chunks for batches of questions: inverted token tables, blocked vector search, evidence.

Tokens are exploded once per chunk; tokens that too many chunks hold are cut
before any join, which bounds the skew. Nothing compares all pairs of texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.functions import text as T
from crewlens.functions.similarity import layout_overlap
from crewlens.operators import lookup as L
from crewlens.operators.windows import keep_first, top_k_per_key
from crewlens.sources.durable import stored

#: Rows of a block, queries of a lot, queries scored at a time.
_BLOCK, _LOT, _SLICE = 2048, 1 << 15, 256


def token_table(df: DataFrame, key: list[str], text: str, least: int = 4) -> DataFrame:
    """A row for each distinct token of each row: the inverted index."""
    return df.select(*key, F.explode(T.tokens(F.col(text), least)).alias("token"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with vectors made elsewhere; chunks without one stay."""
    return chunks.join(vectors.select(key, "embedding"), key, "left")


def _nearest(k: int, scope: str | None = None):
    """The k best of each query among a tile's rows, a few queries at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, base = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("id")
        out = []
        if len(queries) and len(base):
            x = np.array([np.asarray(v, np.float64) for v in base["vector"]])
            long, ids = np.linalg.norm(x, axis=1), base["id"].to_numpy()
            for i in range(0, len(queries), _SLICE):
                some = queries.iloc[i : i + _SLICE]
                q = np.array([np.asarray(v, np.float64) for v in some["vector"]])
                score = (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * long, 1e-300)
                score[some["id"].to_numpy()[:, None] == ids] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(some["id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": pdf["id"].iloc[:0], "id": pdf["id"].iloc[:0], "score": pd.Series([], dtype=float)})
        found = found[found["score"] > -np.inf]
        return found if scope is None else found.assign(**{scope: pdf[scope].iloc[0]})

    return run


def _found(df: DataFrame) -> str:
    kind = df.schema["id"].dataType.simpleString()
    return f"query_id {kind}, id {kind}, score double"


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest of each query by cosine: lots of queries against blocks of the corpus, then one rank. Both have id (of one type) and vector.

    A lot has up to _LOT queries, so that the corpus is copied once for each _LOT of them.
    """
    parts = max(1, -(-queries.count() // _LOT))
    n = max(1, -(-corpus.count() // _BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = queries.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("q"), every(n).alias("b"), F.lit(True).alias("asks"), "id", "vector")
    base = corpus.select(every(parts).alias("q"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("b"), F.lit(False).alias("asks"), "id", "vector")
    found = asks.union(base).groupBy("q", "b").applyInPandas(_nearest(k), _found(corpus))
    return top_k_per_key(found, ["query_id"], [F.desc("score"), "id"], k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk_scoped(queries: DataFrame, corpus: DataFrame, by: str, k: int = 8) -> DataFrame:
    """The k nearest inside each of a query's scopes: lots of its queries against blocks of its rows, cut by hash, then one rank. Both: id (of one type), ``by``, vector."""
    parts = lambda df, name, size: df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = parts(queries, "lots", _LOT).join(parts(corpus, "blocks", _BLOCK), by)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spot = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    asks = queries.join(grid, by).select(by, spot("lots", 0).alias("q"), every("blocks").alias("b"), F.lit(True).alias("asks"), "id", "vector")
    base = corpus.join(grid, by).select(by, every("lots").alias("q"), spot("blocks", 1).alias("b"), F.lit(False).alias("asks"), "id", "vector")
    kind = corpus.schema[by].dataType.simpleString()
    found = asks.union(base).groupBy(by, "q", "b").applyInPandas(_nearest(k, by), f"{_found(corpus)}, {by} {kind}")
    return top_k_per_key(found, ["query_id", by], [F.desc("score"), "id"], k)


#: Types of chunks that hold one entry, and those that hold a section of them.
ENTRY_TYPES = ("project_entry", "experience_entry", "education_entry", "certification_entry")
SECTION_TYPES = ("projects", "experience", "education", "certifications")


def _entries_first(kind: Column) -> Column:
    """0 for entries, 1 for sections, 2 for profiles, 3 for all else."""
    return F.when(kind.isin(*ENTRY_TYPES), 0).when(kind.isin(*SECTION_TYPES), 1).when(kind == "profile", 2).otherwise(3)


def asked_terms(queries: DataFrame, least: int = 4) -> DataFrame:
    """query_id and token: the terms of each question with their variants, of ``least`` characters or more. queries: query_id, query."""
    terms = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("token"))
    return terms.where(F.length("token") >= least).distinct()


def rare_token_search(queries: DataFrame, chunks: DataFrame, k: int = 18, share: float = 0.15, least: int = 8) -> DataFrame:
    """Chunks by the sum of 1 / hits over a question's rare tokens; of equal sums entries first, then sections, then profiles.

    A token is hit where one of its variants is a word of the chunk or begins one; it
    is rare if ``least`` chunks or ``share`` of all hold it at most.
    queries: query_id, query; chunks: chunk_id, chunk_type, content.
    """
    most = max(least, int(chunks.count() * share))
    asked = asked_terms(queries)
    hits = stored(L.token_hits(asked, chunks.select("chunk_id", F.col("content").alias("text")), ["chunk_id"], most), "hits")
    # Questions with the same tokens are one, ``like``.
    sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    alike = sets.groupBy("tokens").agg(F.min("query_id").alias("like"))
    terms = alike.select("like", F.explode("tokens").alias("token"))
    # Chunks with the same tokens score the same: of each such set the first k are enough, and its first one is scored.
    order = [_entries_first(F.col("chunk_type")), F.coalesce("chunk_type", F.lit("")), "chunk_id"]
    held = hits.groupBy("chunk_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("token")), " "), 256).alias("held"))
    first = top_k_per_key(held.join(chunks.select("chunk_id", "chunk_type"), "chunk_id"), ["held"], order, k, "nth")
    first = stored(first.withColumn("lead", F.first("chunk_id").over(Window.partitionBy("held").orderBy("nth"))), "first")
    leads = hits.join(first.where("nth = 1").select("chunk_id", "chunk_type"), "chunk_id")
    # Dealt by chunk, so that the sums of a chunk stay where it is.
    scored = leads.repartition("chunk_id").join(terms, "token").groupBy("like", "chunk_id", "chunk_type").agg(F.round(F.sum(1 / F.col("hits")), 9).alias("score"))
    best = top_k_per_key(scored, ["like"], [F.desc("score"), *order], k).select("like", F.col("chunk_id").alias("lead"), "score")
    rows = best.join(first.select("lead", "chunk_id", "chunk_type"), "lead")
    found = top_k_per_key(rows, ["like"], [F.desc("score"), *order], k)
    return sets.join(alike, "tokens").select("query_id", "like").join(found, "like").select("query_id", "chunk_id", "score", "place")


def with_profiles(found: DataFrame, owners: DataFrame, profiles: DataFrame, k: int = 18) -> DataFrame:
    """What was found, and behind its k places the profiles of the persons whose chunks they are, with a score of 0.

    found: query_id, chunk_id, score, place; owners: chunk_id, user_id; profiles: user_id, chunk_id.
    """
    first = found.join(owners.select("chunk_id", "user_id"), "chunk_id").groupBy("query_id", "user_id").agg(F.min("place").alias("place"))
    more = first.join(profiles.select("user_id", "chunk_id"), "user_id").select("query_id", "chunk_id", F.lit(0.0).alias("score"), (F.col("place") + k).alias("place"))
    return found.select("query_id", "chunk_id", "score", "place").union(more.join(found, ["query_id", "chunk_id"], "left_anti"))


def name_words(people: DataFrame) -> DataFrame:
    """user_id and word: the parts of each name, of 3 characters or more. people: user_id, full_name."""
    parts = F.array_distinct(F.split(T.query_key(F.col("full_name")), " "))
    return people.select("user_id", F.explode(parts).alias("word")).where(F.length("word") > 2).distinct()


def _word_owners(people: DataFrame) -> DataFrame:
    return name_words(people).groupBy("word").agg(F.count("*").alias("people"), F.min("user_id").alias("user_id"))


def _asked_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """query_id and word of each part of a name, or a variant of it, that a question holds as a word or the beginning of one."""
    return L.token_hits(words.select(F.col("word").alias("token")), queries.select("query_id", F.col("query").alias("text")), ["query_id"], grows=True).select("query_id", F.col("token").alias("word"))


def name_scope(queries: DataFrame, people: DataFrame) -> DataFrame:
    """Persons that a question names: ``full`` where it holds the whole name anywhere, else ``word`` by a part of it that only one person has.

    Names have any number of words. queries: query_id, query; people: user_id,
    full_name. Parts of several persons are ``name_ambiguities``.
    """
    names = people.select("user_id", T.query_key(F.col("full_name")).alias("phrase")).where("phrase != ''")
    held = L.substring_hits(queries.select("query_id", T.query_key(F.col("query")).alias("text")), names, ["query_id"])
    full = held.join(L.shuffled(names), "phrase").select("query_id", "user_id", F.lit(0).alias("way"))
    own = _word_owners(people).where("people = 1")
    word = _asked_words(queries, own).join(L.shuffled(own), "word").select("query_id", "user_id", F.lit(1).alias("way"))
    best = full.union(word).groupBy("query_id", "user_id").agg(F.min("way").alias("way"))
    return best.select("query_id", "user_id", F.when(F.col("way") == 0, "full").otherwise("word").alias("how"))


def name_ambiguities(queries: DataFrame, people: DataFrame) -> DataFrame:
    """query_id, word and how many people have it: parts of names in a question that several have. ``name_words`` tells who.

    The people of a part aren't listed for each question, as a common one would give all pairs.
    """
    shared = _word_owners(people).where("people > 1")
    return _asked_words(queries, shared).join(L.shuffled(shared), "word").select("query_id", "word", "people")


def focus_rows(scope: DataFrame, queries: DataFrame, chunks: DataFrame, people: DataFrame, k: int = 14, share: float = 0.25) -> DataFrame:
    """Of each person in scope the chunks with a token that up to a quarter of the person's chunks hold; entries first. Parts of the own name don't count.

    scope: query_id, user_id; queries: query_id, query; chunks: user_id, chunk_id, chunk_type, content; people: user_id, full_name.
    """
    names = name_words(people).withColumnRenamed("word", "token")
    asked = scope.select("query_id", "user_id").distinct().join(asked_terms(queries), "query_id").join(names, ["user_id", "token"], "left_anti")
    asked = stored(asked, "asked")
    own = chunks.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    held = stored(L.token_hits(asked, own.select("user_id", "chunk_id", F.col("content").alias("text")), ["user_id", "chunk_id"], by=["user_id"]), "held")
    sizes = own.groupBy("user_id").agg(F.count("*").alias("n"))
    rare = held.groupBy("user_id", "token").agg(F.count("*").alias("hits")).join(sizes, "user_id").where(F.col("hits") <= share * F.col("n"))
    found = asked.join(rare.select("user_id", "token"), ["user_id", "token"]).join(held, ["user_id", "token"]).groupBy("query_id", "user_id", "chunk_id").agg(F.count("*").alias("matched"))
    rows = found.join(chunks.select("user_id", "chunk_id", "chunk_type"), ["user_id", "chunk_id"])
    other = F.when(F.col("chunk_type").isin(*ENTRY_TYPES), 0).otherwise(1)
    return top_k_per_key(rows, ["query_id", "user_id"], [other, "chunk_id"], k).select("query_id", "user_id", "chunk_id", "matched", "place")


def hybrid_retrieve(branches: list[DataFrame], k: int | None = 20) -> DataFrame:
    """Branches (query_id, chunk_id, place) in order of trust, united: the first branch that has a chunk counts. The first k, or all."""
    rows = [b.select("query_id", "chunk_id", F.lit(i).alias("branch"), "place") for i, b in enumerate(branches)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    first = keep_first(both, F.struct("query_id", "chunk_id"), ["branch", "place"]).withColumnRenamed("place", "branch_place")
    order = ["branch", "branch_place", "chunk_id"]
    return top_k_per_key(first, ["query_id"], order, k) if k else first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def retrieve(queries: DataFrame, chunks: DataFrame, people: DataFrame, asks: DataFrame | None = None, k: int = 5, k_scoped: int = 8) -> DataFrame:
    """query_id, chunk_id, branch and place: what each question finds, from names, words and vectors.

    Questions that name someone stay with them: profile (0), chunks of whole sections
    (1), chunks with a focus token (2), the nearest of the person (3), only of entries and
    profiles where there are focus tokens. Others take chunks with rare tokens (4),
    their owners' profiles (5) and the nearest of all (6). The directory's pages belong to every answer
    and aren't listed. queries: query_id, query; chunks: chunk_id, user_id, chunk_type,
    content and, for ``asks`` (query_id, vector), vector; people: user_id, full_name. A person
    of many chunks gives as many rows to each question on them.
    """
    # Stored, as several branches read them.
    scope = stored(name_scope(queries, people).select("query_id", "user_id").distinct(), "scope")
    own = scope.join(chunks.where(F.col("chunk_type").isin("profile", "skills", *SECTION_TYPES)).select("user_id", "chunk_id", "chunk_type"), "user_id")
    first = F.dense_rank().over(Window.partitionBy("query_id").orderBy("chunk_type", "chunk_id"))
    rest = queries.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    focus = stored(focus_rows(scope, queries, chunks, people), "focus")
    plain = chunks.select("chunk_id", "user_id", "chunk_type", "content")
    rare = stored(rare_token_search(rest, plain), "rare")
    profiles = chunks.where("chunk_type = 'profile'").groupBy("user_id").agg(F.min("chunk_id").alias("chunk_id"))
    owners = with_profiles(rare, plain, profiles)
    none = rare.where("false").select("query_id", "chunk_id", "place")
    near = scoped = none
    if asks is not None:
        corpus = chunks.where("vector is not null").select(F.col("chunk_id").alias("id"), "user_id", "vector")
        kind = chunks.schema["chunk_id"].dataType
        ids = asks.join(queries.select("query_id").distinct(), "query_id", "left_semi").withColumn("id", F.col("query_id").cast(kind))
        back = ids.select(F.col("id").alias("asked"), F.col("query_id").alias("of"))
        near = vector_topk(ids.join(rest.select("query_id"), "query_id", "left_semi").select("id", "vector"), corpus.select("id", "vector"), k)
        near = near.join(back, F.col("query_id") == F.col("asked")).select(F.col("of").alias("query_id"), F.col("id").alias("chunk_id"), "place")
        scoped = vector_topk_scoped(ids.join(scope, "query_id").select("id", "user_id", "vector"), corpus, "user_id", k_scoped)
        scoped = scoped.join(back, F.col("query_id") == F.col("asked")).select(F.col("of").alias("query_id"), F.col("id").alias("chunk_id"), "user_id", "place")
        focused = focus.select("query_id", "user_id").distinct().withColumn("focused", F.lit(True))
        scoped = scoped.join(focused, ["query_id", "user_id"], "left").join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
        scoped = scoped.where(F.col("focused").isNull() | F.col("chunk_type").isin("profile", *ENTRY_TYPES)).select("query_id", "chunk_id", "place")
    branches = [
        own.where("chunk_type = 'profile'").withColumn("place", first), own.where("chunk_type != 'profile'").withColumn("place", first), focus, scoped,
        rare, owners.join(rare, ["query_id", "chunk_id"], "left_anti"), near,
    ]
    return hybrid_retrieve(branches, None).select("query_id", "chunk_id", "branch", "place")


def union_forms(found: DataFrame) -> DataFrame:
    """Results of up to three forms of each question as one list: form by form, each chunk where it comes first. found: query_id, form, chunk_id, place."""
    first = keep_first(found.where("form <= 3"), F.struct("query_id", "chunk_id"), ["form", "place"])
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("form", "place", "chunk_id"))).select("query_id", "chunk_id", "form", "place")


def evidence_rows(results: DataFrame, limit: int = 160) -> DataFrame:
    """Distinct evidence of each query in order, numbered E1 and on. results: query_id, person, kind, entity, text, place."""
    rows = keep_first(results, F.struct("query_id", "person", "kind", "entity", "text"), ["place"])
    return top_k_per_key(rows.withColumnRenamed("place", "result_place"), ["query_id"], ["result_place", "person", "kind", "entity", "text"], limit).withColumn("evidence_id", F.concat(F.lit("E"), F.col("place").cast("string")))


def token_people(queries: DataFrame, texts: DataFrame, part: str | None = None) -> DataFrame:
    """Per question and token the people whose texts hold it, unless all do. queries: query_id, query; texts: person, text. A person's texts need not be told apart (``part``)."""
    asked = asked_terms(queries)
    held = L.token_holders(asked, texts.select("person", "text"), ["person"]).groupBy("token").agg(F.array_sort(F.collect_set("person")).alias("people"))
    n = texts.agg(F.count_distinct("person").alias("n"))
    return asked.join(held, "token").join(F.broadcast(n)).where(F.size("people") < F.col("n")).drop("n")


#: Parts of replies that claim nothing, as ``match_key`` spells them.
NO_CLAIM = ("i don", "don t have", "timed out")


def groundedness(answers: DataFrame, evidence: DataFrame, least: int = 4) -> DataFrame:
    """Whether each answer's tokens stand in its evidence, by two rules. Both tables: id, text; an answer's evidence may be many rows.

    grounded: replies that claim nothing, answers without tokens and those without
    evidence pass; else one hit is needed up to 8 tokens, 15 % up to 20, else 20 %;
    blank answers fail. in_results, the stricter rule: 30 % of the tokens, which there have to be.
    A token is hit by a word that is it or begins with it.
    """
    key = T.match_key(F.col("text"))
    rows = answers.select("id", key.alias("key"), T.tokens(F.col("text"), least).alias("tokens"))
    asked = rows.select("id", F.explode("tokens").alias("token"))
    words = evidence.select("id", F.explode(T.tokens(F.col("text"), least, ("",))).alias("word")).distinct()
    held = L.prefix_hits(words, asked.select(F.col("token").alias("form"))).join(words, "word").select("id", F.col("form").alias("token")).distinct()
    hits = asked.join(held.withColumn("held", F.lit(1)), ["id", "token"], "left").groupBy("id").agg(F.count("*").alias("n"), F.count("held").alias("hits"))
    known = evidence.where(T.match_key(F.col("text")) != "").select("id").distinct().withColumn("known", F.lit(True))
    both = rows.join(hits, "id", "left").join(known, "id", "left")
    n, share = F.coalesce("n", F.lit(0)), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))
    no_claim = F.contains("key", F.lit(NO_CLAIM[0])) | F.contains("key", F.lit(NO_CLAIM[1])) | F.contains("key", F.lit(NO_CLAIM[2]))
    passed = F.when(F.col("key") == "", False).when(no_claim | (n == 0) | F.col("known").isNull(), True).when(n <= 8, F.col("hits") >= 1).when(n <= 20, share >= 0.15).otherwise(share >= 0.20)
    return both.select("id", F.round(share, 9).alias("share"), passed.alias("grounded"), ((n > 0) & (share >= 0.30)).alias("in_results"))


#: Words of a search for people that tell nothing about them.
CARD_STOPWORDS = (
    "who", "has", "have", "with", "the", "and", "for", "a", "an", "of", "to", "in", "on", "at", "is", "are", "list", "show", "find",
    "employees", "employee", "team", "members", "me", "please", "need", "want", "looking", "that", "those", "these", "which", "whose", "from",
    "certification", "certifications", "skill", "skills", "project", "projects", "experience", "years", "year", "yrs", "yr", "exp",
    "cert", "certs", "certificate", "certificates", "certified",
)


def card_tokens(query: Column) -> Column:
    """Words of a query that cards are held against: two characters or more, one of them a letter, none of the fixed list."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_except(F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike("[a-z]")), F.array(*map(F.lit, CARD_STOPWORDS)))


def result_cards(results: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """A card for each query and person: role, years, first companies, certifications, projects and skills; those with most fields filled first.

    results: query_id, person, kind (role, years, company, certification, project,
    skill or text), entity, directory (whether the row is one of the directory);
    queries: query_id, query. Persons whose name holds all words of a query of two or
    more are the only ones; else a row of the person outside the directory has to hold
    a word. Years asked for count if anyone has them. Where nobody is left and the query
    has one word at most, the directory's persons by name stand in, with score 0.
    """
    q = queries.select("query_id", card_tokens(F.col("query")).alias("tokens"), T.min_years(F.col("query")).alias("least"))
    rows = results.join(q, "query_id")
    norm = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    held = norm(F.coalesce("entity", F.lit("")))
    hit = F.exists("tokens", lambda t: F.contains(held, F.concat(F.lit(" "), t, F.lit(" "))) | ((F.length(t) >= 4) & F.contains(held, t)))
    listed, here = F.col("directory"), ~F.col("directory")
    entity = lambda kind, where: F.when((F.col("kind") == kind) & where, F.nullif(F.trim("entity"), F.lit("")))
    some = lambda kind, n, where: F.slice(F.array_sort(F.collect_set(entity(kind, where))), 1, n)
    years = lambda where: F.max(entity("years", where).try_cast("int"))
    always = F.lit(True)
    cards = rows.groupBy("query_id", "person").agg(
        F.first("tokens").alias("tokens"),
        F.first("least").alias("least"),
        F.bool_or(here).alias("seen"),
        F.bool_or(listed).alias("listed"),
        F.bool_or(here & hit).alias("hit"),
        F.coalesce(F.min(entity("role", here)), F.min(entity("role", listed))).alias("role"),
        F.min(entity("role", listed)).alias("listed_role"),
        F.coalesce(years(here), years(listed)).alias("years"),
        years(listed).alias("listed_years"),
        some("company", 3, always).alias("company"),
        some("company", 3, listed).alias("listed_company"),
        some("certification", 3, here).alias("certification"),
        some("project", 3, here).alias("project"),
        some("skill", 6, here).alias("skill"),
    )
    asked = F.size("tokens")
    of_query = Window.partitionBy("query_id")
    named = F.col("seen") & (asked >= 2) & (F.size(F.array_except("tokens", F.split(F.trim(norm(F.col("person"))), " "))) == 0)
    cards = cards.withColumn("named", named).withColumn("forced", F.bool_or("named").over(of_query))
    cards = cards.withColumn("fits", F.col("seen") & F.when(F.col("forced"), F.col("named")).when(asked == 0, True).otherwise(F.col("hit")))
    cards = cards.withColumn("enough", F.col("fits") & F.coalesce(F.col("years") >= F.col("least"), F.lit(False)))
    stands_in = ~F.bool_or("fits").over(of_query) & (asked <= 1) & F.col("listed")
    cards = cards.withColumn("keep", F.when(F.bool_or("enough").over(of_query), F.col("enough")).otherwise(F.col("fits"))).withColumn("stands_in", stands_in).where("keep or stands_in")
    none = F.expr("cast(array() as array<string>)")
    alone = lambda name, other: F.when(F.col("stands_in"), other).otherwise(F.col(name)).alias(name)
    lists = ("company", "certification", "project", "skill")
    score = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in lists), F.when(F.col("role").isNotNull(), 1).otherwise(0) + F.when(F.col("years").isNotNull(), 1).otherwise(0))
    out = cards.select(
        "query_id", "person", alone("role", F.col("listed_role")), alone("years", F.col("listed_years")), alone("company", F.col("listed_company")),
        *(alone(c, none) for c in lists[1:]), F.when(F.col("stands_in"), 0).otherwise(score).alias("score"),
    )
    return top_k_per_key(out, ["query_id"], [F.desc("score"), "person"], k)


def cards_summary(cards: DataFrame, n: int = 5) -> DataFrame:
    """Per query a line for each of its first n cards: name, role, years, companies and certifications, as far as they are filled."""
    listed = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c.replace('company', 'companie')}s: "), F.array_join(c, ", ")))
    line = F.concat_ws(" | ", "person", F.concat(F.lit("role: "), "role"), F.concat(F.lit("experience: "), F.col("years").cast("string"), F.lit(" years")), listed("company"), listed("certification"))
    rows = cards.where(F.col("place") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("summary"))


def _layout_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Layouts of both sides that share a number of columns, as sorted arrays, with the share: a_layout, b_layout, layout. Layouts, not documents, are paired."""
    one = lambda df, p: df.where(F.size("cols") > 0).select(F.array_sort("cols").alias(f"{p}_layout")).distinct().select(f"{p}_layout", F.explode(F.array_distinct(f"{p}_layout")).alias("col"))
    near = one(a, "a").join(one(b, "b"), "col").select("a_layout", "b_layout").distinct()
    return near.withColumn("layout", layout_overlap(F.col("a_layout"), F.col("b_layout")))


def similar_documents(a: DataFrame, b: DataFrame, k: int = 3, least: float = 0.12) -> DataFrame:
    """a_id, b_id, score and place: 0.85 Jaccard of tokens plus 0.15 overlap of the tables' column numbers, from ``least`` on; the k best of each a.

    Both: id, text, cols (the columns of each table, an array; none or null has no
    layout). One side is a small set of texts (templates, questions) against many. An a without
    tokens has no matches. Shared tokens are counted from the inverted index: a row of it has two ids and counts,
    and rows of a pair are combined before the shuffle. Pairs without a shared token
    can only score by layout: of these the k of least id for each pair of layouts are enough.
    """
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), T.tokens(F.col("text"), 3, ("",)).alias("tokens"), F.array_sort(F.coalesce("cols", F.array().cast("array<int>"))).alias(f"{p}_layout")).withColumn(f"{p}_n", F.size("tokens"))
    left, right = side(a, "a").where("a_n > 0"), side(b, "b")
    layouts = _layout_pairs(a, b)
    spread = lambda df, p: df.select(f"{p}_id", f"{p}_n", f"{p}_layout", F.explode("tokens").alias("token"))
    shared = spread(left, "a").join(spread(right, "b"), "token").groupBy("a_id", "b_id", "a_n", "b_n", "a_layout", "b_layout").agg(F.count("*").alias("common"))
    shared = shared.join(layouts, ["a_layout", "b_layout"], "left").select("a_id", "b_id", (F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))).alias("jaccard"), F.coalesce("layout", F.lit(0.0)).alias("layout"))
    # b by layout: the k of least id hold all that layout alone can bring into the k best.
    few = top_k_per_key(right.join(layouts.select("b_layout").distinct(), "b_layout").select("b_layout", "b_id"), ["b_layout"], ["b_id"], k, "nth")
    alike = left.join(layouts.where(0.15 * F.col("layout") >= least), "a_layout").join(few, "b_layout").select("a_id", "b_id", F.lit(0.0).alias("jaccard"), "layout")
    both = shared.union(alike).withColumn("score", F.round(0.85 * F.col("jaccard") + 0.15 * F.col("layout"), 9)).where(F.col("score") >= least)
    best = both.groupBy("a_id", "b_id").agg(F.max("score").alias("score"))
    return top_k_per_key(best, ["a_id"], [F.desc("score"), "b_id"], k)


#: Words of greetings, and those that may stand beside them.
GREETINGS = ("hello", "hi", "hey", "greetings", "bonjour", "salut", "yo", "sup", "there", "everyone", "all")


def route_queries(df: DataFrame, text: str = "query") -> DataFrame:
    """greeting where a query holds nothing else, empty where nothing at all, else search."""
    words = F.filter(F.split(T.match_key(F.col(text)), " "), lambda w: w != "")
    rest = F.array_except(words, F.array(*map(F.lit, GREETINGS)))
    return df.withColumn("route", F.when(F.size(words) == 0, "empty").when(F.size(rest) == 0, "greeting").otherwise("search"))


def resolve_references(turns: DataFrame, people: DataFrame, back: int = 4) -> DataFrame:
    """Messages that point to someone, with a name of the last of the ``back`` messages before that mentions any: of several the first by name.

    A message mentions a name that it holds anywhere, or by a part of 3 characters or
    more. turns: conv_id, turn, text; people: full_name.
    """
    key = ["conv_id", "turn"]
    names = people.select("full_name", T.query_key(F.col("full_name")).alias("phrase")).where("phrase != ''").groupBy("phrase").agg(F.min("full_name").alias("label"))
    asks = turns.select(*key, "text", T.needs_reference(F.col("text")).alias("asks"))
    # Conversations that point to no one need no names. Stored, as words and whole names are looked up.
    pointing = asks.withColumn("any", F.max("asks").over(Window.partitionBy("conv_id"))).where("any")
    said = stored(pointing.select(*key, T.query_key(F.col("text")).alias("text")), "said")
    parts = names.select("label", F.explode(F.split("phrase", " ")).alias("token")).where(F.length("token") > 2).groupBy("token").agg(F.min("label").alias("label"))
    partly = stored(L.least_tokens(parts, said, key), "partly")
    # A whole name counts only where it comes before what its parts or others' tell.
    whole = L.least_phrases(said.join(partly.withColumnRenamed("label", "most"), key, "left"), names, key)
    named = partly.union(whole).groupBy(*key).agg(F.min("label").alias("mention"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    rows = asks.select(*key, "asks").join(named, key, "left").withColumn("name", F.last("mention", ignorenulls=True).over(w))
    return rows.select(*key, F.when(F.col("asks"), F.col("name")).alias("name"))


def recent_context(turns: DataFrame, n: int = 8) -> DataFrame:
    """The n messages before each one as lines ``role: text``."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(w), "\n").alias("context"))
