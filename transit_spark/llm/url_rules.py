"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is compiled to one regular expression over the address (host and path) of a url and is filed under one of the
tokens that every url it fits must contain: the one that the fewest urls at hand have. The tokens of a url fetch the
rules filed under them, and only those are run. A rule without such a token is filed under the empty token, which every
url has, so no rule is lost. Everything is DataFrame and SQL functions.

Defined results: a NULL url, or one without ``://``, has an empty host and path; rows with a NULL or repeated id and
repeated urls are all judged and returned; an empty table gives no rows, an empty list of rules allows everything. Of
several rules that fit, one of the lowest tier wins, then the longest, then one that blocks, then the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.llm.common import keyed
from transit_spark.session import stage

TOKEN = "[0-9A-Za-z]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: An index of at most so many rules and characters of expressions is broadcast; a larger one is shuffled by token.
BROADCAST_RULES = 50_000
BROADCAST_CHARS = 8 << 20
#: So many parts of a token's urls when the index is shuffled.
SALTS = 32

RULE_SCHEMA = "tier int, action string, name string, regex string, tokens array<string>"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is plain text in which ``*`` stands for any characters but a slash.

    ``||`` in front ties it to the start of a label of the host, so ``||example.com/en/`` fits the host, all its
    subdomains, and paths that start so. Without it the pattern may start anywhere in the host, or in the whole
    address if it holds a slash. Lower tiers go first.
    """

    action: str
    pattern: str
    tier: int = 0

    @property
    def body(self) -> str:
        text = self.pattern.removeprefix("||")
        host, slash, path = text.partition("/")
        return host.lower() + slash + path

    @property
    def labelled(self) -> bool:
        return self.pattern.startswith("||")

    def regex(self) -> str:
        """The expression, searched in host and path put together."""
        parts = ["".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in part) for part in self.body.split("*")]
        start = "^(?:[^/]*\\.)?" if self.labelled else "" if "/" in self.body else "^[^/]*"
        return start + "[^/]*".join(parts)

    def tokens(self) -> list[str]:
        """Runs of ASCII letters and digits that every fitting address has as whole runs."""
        found, parts = set(), self.body.split("*")
        for k, part in enumerate(parts):
            for run in re.finditer(TOKEN, part):
                bounded = run.start() > 0 or (k == 0 and self.labelled)
                if bounded and run.end() < len(part):
                    found.add(run.group())
        return sorted(found)


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the path of the url starts with ``path``."""
    return UrlRule(action, f"||{host}{path}")


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """The rules as a table; ``name`` is the pattern without its mark."""
    if not rules:
        return spark.range(0).select(F.expr(f"from_json('{{}}', '{RULE_SCHEMA}')").alias("r")).select("r.*")
    rows = [
        F.struct(
            F.lit(r.tier).alias("tier"),
            F.lit(r.action).alias("action"),
            F.lit(r.body).alias("name"),
            F.lit(r.regex()).alias("regex"),
            F.array(*[F.lit(t) for t in r.tokens()]).cast("array<string>").alias("tokens"),
        )
        for r in dict.fromkeys(rules)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def addressed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(doc_id, host, path) of every row, neither ever NULL; letters A-Z of the host in lower case."""
    rest = F.expr("if(instr(text, '://') > 0, substring(text, instr(text, '://') + 3), '')")
    return (
        keyed(pages, id_col, url_col)
        .select("doc_id", F.coalesce(rest, F.lit("")).alias("rest"))
        .select(
            "doc_id",
            F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, UPPER.lower()).alias("host"),
            F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )


def _tokens() -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), F.lit(1)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule columns): every rule once, under its token that the fewest of ``urls`` (host, path) have.

    All urls are counted, summed before the shuffle; only tokens of rules are counted. Ties go to the smaller token.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select("host", "path", F.explode(_tokens()).alias("token"))
    counts = _with_index(seen, wanted).groupBy("token").agg(F.count("*").alias("n_urls"))
    filed = (
        rules.withColumn("token", F.explode_outer("tokens"))
        .join(counts, "token", "left")
        .withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
        .groupBy("tier", "action", "name", "regex")
        .agg(F.min(F.struct("n_urls", "token")).alias("best"))
    )
    return filed.select(F.coalesce("best.token", F.lit("")).alias("token"), "tier", "action", "name", "regex")


def _with_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (host, path, token) joined to an index by token.

    It is broadcast when its rows and characters have been counted to be few. Else both sides are shuffled, and the
    urls of each token are dealt to ``SALTS`` parts, since a token such as ``com`` may be in a third of all urls.
    """
    chars = F.length("regex") if "regex" in index.columns else F.length("token")
    size = index.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    if size[0] <= BROADCAST_RULES and size[1] <= BROADCAST_CHARS:
        return rows.join(F.broadcast(index), "token")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).drop("salt")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(doc_id, host, path, tier, name, action) of every row: the rule that wins, NULLs where none fits.

    Equal addresses are judged once. The distinct addresses are written to the shared folder, since they are read
    twice: to count tokens, and to fetch candidates.
    """
    parsed = addressed(pages, id_col, url_col)
    urls = stage(parsed.select("host", "path").where("host <> '' or path <> ''").distinct())
    index = stage(rule_index(urls, rules))
    fetched = _with_index(urls.withColumn("token", F.explode(F.concat(_tokens(), F.array(F.lit(""))))), index)
    fitting = fetched.where("regexp_like(concat(host, path), regex)")
    order = F.struct("tier", (-F.length("name")).alias("shorter"), (F.col("action") != "block").alias("lenient"), "name", "action")
    best = fitting.groupBy("host", "path").agg(F.min(order).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("doc_id", "host", "path", "best.tier", "best.name", "best.action")
