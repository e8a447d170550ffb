"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.pii import span_digests

    return span_digests(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.quality import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), "quality", ~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.graphdedup import audited

    return audited(_table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.bpe import build_lexicon, token_digests

    docs, path = _table(spark, sf_dir, "documents"), tokenizer_path()
    return token_digests(docs, path, build_lexicon(docs, path))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.warc import captures_of_pages, resolve_revisits

    found = resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("record_id", "outcome", "response_id", F.array_join(lines, "; ").alias("headers"), F.sha2("body", 256).alias("body_sha256"))


_REVISITS = r"""with p as (select page_id, url, html, regexp_replace(trim(url), '#.*$', '') as u from pages),
 c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]+)', 1)), '^www\.', ''), ':(80|443)$', '') as host, regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]+([^?]*)', 1), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) as parts from p),
 s as (select page_id, html, md5(html) as tag, case when host = '' then u else host || path || case when len(parts) > 0 then '?' || array_to_string(parts, '&') else '' end end as site, page_id * 60 as at, page_id * 60 + 1 + page_id * 7919 % 100000 as later from c),
 m as (select r.page_id, r.tag, r.later, arg_max(f.page_id, (f.at, f.page_id)) as f from s r left join s f on f.site = r.site and f.at < r.later group by 1, 2, 3)
 select m.page_id * 2 + 1 as record_id, case when f is null then 'no_response' when s.tag = m.tag then 'resolved' else 'mismatch' end as outcome, f * 2 as response_id,
  case when s.tag = m.tag then 'cache-control=max-age=120; content-length=' || strlen(html)::varchar || '; content-type=text/html; date=' || m.later::varchar || '; etag=W/"' || m.tag || '"' end as headers, case when s.tag = m.tag then sha256(html) end as body_sha256 from m left join s on s.page_id = f"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.mixing import taken_words

    return taken_words(_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.knn import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.bpe import build_lexicon, vocabulary
    from crewlens.llm.tokencounts import document_tokens

    docs, path = _table(spark, sf_dir, "documents"), tokenizer_path()
    return document_tokens(docs, path, vocabulary(path).special["<|endoftext|>"], build_lexicon(docs, path))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.simhash import simhash_groups

    found = simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.substrings import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.subvectors import centroid_clusters

    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from crewlens.llm.fertility import judged

    found = judged(_table(spark, sf_dir, "documents"), [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", "measures", "outside")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.fim import fill_in_middle, restore

    made = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_MIDDLE = r"""with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
 l as (select *, string_split(t, chr(10)) as s from d),
 c as (select *, case when t = '' then 0 when s[-1] = '' then len(s) - 1 else len(s) end as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i::int, 8))::bigint) as x from l),
 k as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when x[4] % 100 < 50 then 'spm' else 'psm' end as form from c),
 e as (select *, case when a = n then length(t) else coalesce(list_sum(list_transform(s[1:a], lambda w: length(w) + 1)), 0)::bigint end as p, case when b = n then length(t) else coalesce(list_sum(list_transform(s[1:b], lambda w: length(w) + 1)), 0)::bigint end as q from k),
 f as (select *, t[1:p] as pre, case when q > p then t[p + 1:q] else '' end as mid, case when q < length(t) then t[q + 1:] else '' end as suf from e)
 select doc_id, n::bigint as n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || (case when p > 0 then pre else '' end) || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || (case when p > 0 then pre else '' end) || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from f"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_revisits": _REVISITS, "op13_fill_in_middle": _MIDDLE}
