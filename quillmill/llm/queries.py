"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.passages import near_passages

    return near_passages(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.jaccard import components

    return components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.token_output import packed_sequences

    return packed_sequences(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.substrings import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP9_SQL = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end r from pages),
h as (select page_id, translate(coalesce(regexp_extract(r, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') path from u),
k as (select *, case
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) then 'block' else 'allow' end as verdict from k
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL}
