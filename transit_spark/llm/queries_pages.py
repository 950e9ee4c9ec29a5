"""The registered query over pages, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.catalog.registry import Registry
from transit_spark.llm import url_rules

REGISTRY = Registry()

#: The stated rules (action, host, path).
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words that block a host when a label starts or ends with them, set off by a hyphen, or is one of them.
BAD_WORDS = "adult ads bets casino escort loans lottery pills poker porn replica spam tracker viagra warez xxx".split()

PATTERN_RULES = tuple(
    url_rules.UrlRule("block", pattern, tier=1) for word in BAD_WORDS for pattern in (f"||{word}.", f"||{word}-", f"-{word}.")
)
RULES = (*(url_rules.site_rule(*r) for r in SITE_RULES), *PATTERN_RULES)


def _sql() -> str:
    after = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
    sites = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in SITE_RULES)
    words = "|".join(BAD_WORDS)
    return f"""
with cut as (select page_id, row_number() over () as k, coalesce({after}, '') as rest from pages),
parsed as (
    select page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.UPPER.lower()}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from cut),
sites(action, site, start) as (values {sites}),
found as (
    select k, max_by(struct_pack(action, name := site || start), length(site || start)) as best
    from parsed join sites on (host = site or ends_with(host, '.' || site)) and starts_with(path, start) group by k),
matched as (
    select page_id, host, path, best, regexp_matches(host, '(^|\\.)({words})[.-]|-({words})\\.') as bad from parsed left join found using (k))
select page_id, host, path, best.name as rule, coalesce(best.action, case when bad then 'block' else 'allow' end) as verdict
from matched"""


@REGISTRY.query("op11_url_rules", oracle=_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: the longest stated rule that fits, else a pattern rule that blocks, else allow."""
    judged = url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark, RULES))
    return judged.select(
        F.col("doc_id").alias("page_id"),
        "host",
        "path",
        F.when(F.col("tier") == 0, F.col("name")).alias("rule"),
        F.coalesce("action", F.lit("allow")).alias("verdict"),
    )
