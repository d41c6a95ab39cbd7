"""URL filters: rules by host and path, and empirical-Bayes host reputation.

Labelled pages give each host trials and bad outcomes. A host's rate of bad pages has a beta prior
whose mean is the shrunken rate of the rest of its registered domain (without the host, whose
outcomes would count twice); that of a domain is the rest of its suffix, and that of a suffix
the rest of all pages. Each level's prior strength comes from the data: by the method
of moments, from how much more the children's rates scatter about their parents' than binomial
outcomes would. A host is blocked when the lower posterior bound of its rate exceeds ``LIMIT``.

Counts are grouped sums (combined before the shuffle), so a hot host costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import source, written

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path begins with the rule's
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: rate that the lower bound must exceed, and the bound's distance in standard deviations
LIMIT, DEVIATIONS = 0.5, 1.645
#: smallest and largest correlation of pages of one parent (prior strength 1 / r - 1)
CORRELATION = (0.001, 0.5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> dict:
    """host, path, domain (last two labels) and suffix (last label) columns of a url column."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return {"host": host, "path": F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1),
            "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def rule_columns(rules=RULES) -> dict:
    """rule and rule_verdict: the longest rule that fits host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return {"rule": rule, "rule_verdict": verdict}


def _strength(children: DataFrame) -> float:
    """Prior strength from children (n, bad) with their parents' rates (mu)."""
    spread = F.col("mu") * (1 - F.col("mu"))
    got = children.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2)).alias("s"),
        F.sum(spread).alias("b"), F.sum(spread * (F.col("n") - 1)).alias("f")).first()
    low, high = CORRELATION
    r = (got["s"] - got["b"]) / got["f"] if got["f"] else low
    return 1 / min(high, max(low, r)) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, lower_bound) of every host of ``pages`` (page_id, host, domain, suffix).

    outcomes: page_id and bad (0 or 1), one row per labelled page; rows with a null count as unlabelled.
    """
    known = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = written(pages.join(known, "page_id", "left").groupBy("suffix", "domain", "host")
                    .agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("bad")), "hosts")
    every = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()

    def under(level: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
        """``level`` with ``mu``: the rate of what else its parent holds, shrunken to the parent's own mu."""
        m = _strength(above)
        up = above.select(*by, F.col("n").alias("up_n"), F.col("bad").alias("up_bad"), F.col("mu").alias("up_mu"))
        rate = (F.col("up_bad") - F.col("bad") + m * F.col("up_mu")) / (F.col("up_n") - F.col("n") + m)
        return level.join(up, by).withColumn("mu", rate).drop("up_n", "up_bad", "up_mu")

    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rest = (F.lit(every["bad"] or 0) - F.col("bad") + 0.5) / (F.lit(every["n"] or 0) - F.col("n") + 1.0)
    suffixes = written(sums("suffix").withColumn("mu", rest), "suffixes")
    domains = written(under(sums("suffix", "domain"), suffixes, ["suffix"]), "domains")
    out = written(under(hosts, domains, ["suffix", "domain"]), "shrunken")
    m = _strength(out)
    out = out.withColumn("m", F.lit(m)).withColumn("rate", (F.col("bad") + m * F.col("mu")) / (F.col("n") + m))
    total = F.col("n") + F.col("m")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return out.select("host", "n", "bad", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("lower_bound"))


def judged_urls(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, lower_bound) of every row of ``pages`` (page_id, url).

    A rule decides where one fits, else the host's reputation: block where ``lower_bound`` > ``limit``. A
    null url, or one without "://", has empty host and path, and so is judged by the host "". Repeated
    rows are judged alike; without outcomes nothing but the rules blocks; an empty table
    gives no rows; further columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns(url_parts()).drop("url")
    hosts = written(host_reputation(rows, outcomes).select("host", "lower_bound"), "reputation")
    own = F.when(F.col("lower_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(hosts, "host", "left").withColumns(rule_columns(rules))
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "lower_bound"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; a page is bad when its label says low quality or toxic."""
    outcomes = source(spark, sf_dir, "labels", F.col("doc_id").alias("page_id"),
                      F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return judged_urls(source(spark, sf_dir, "pages", "page_id", "url"), outcomes).drop("lower_bound")


def _strength_sql(level: str) -> str:
    spread = "mu * (1 - mu)"
    return f"""(SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, coalesce((sum(n * pow(bad / n - mu, 2)) - sum({spread}))
       / nullif(sum({spread} * (n - 1)), 0), 0.001::DOUBLE))) - 1 AS m FROM {level} WHERE n > 0)"""


def oracle_sql() -> str:
    """The query in DuckDB SQL."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named AS (SELECT *, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM parts),
known AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY 1),
hosts AS (SELECT suffix, domain, host, CAST(count(bad) AS DOUBLE) AS n, CAST(sum(coalesce(bad, 0)) AS DOUBLE) AS bad
          FROM named LEFT JOIN known USING (page_id) GROUP BY 1, 2, 3),
every AS (SELECT sum(n) AS n, sum(bad) AS bad FROM hosts),
suf AS (SELECT s.*, (e.bad - s.bad + 0.5::DOUBLE) / (e.n - s.n + 1) AS mu
        FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1) s, every e),
dom AS (SELECT d.*, (s.bad - d.bad + k.m * s.mu) / (s.n - d.n + k.m) AS mu
        FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2) d JOIN suf s USING (suffix), {_strength_sql("suf")} k),
own AS (SELECT h.*, (d.bad - h.bad + k.m * d.mu) / (d.n - h.n + k.m) AS mu
        FROM hosts h JOIN dom d USING (suffix, domain), {_strength_sql("dom")} k),
post AS (SELECT host, n + k.m AS total, (bad + k.m * mu) / (n + k.m) AS rate FROM own, {_strength_sql("own")} k),
judged AS (SELECT host, CASE WHEN rate - {DEVIATIONS}::DOUBLE * sqrt(rate * (1 - rate) / (total + 1)) > {LIMIT}::DOUBLE
                             THEN 'block' ELSE 'allow' END AS verdict FROM post)
SELECT page_id, host, path, {case([h + p for _, h, p in rules])} AS rule,
       coalesce({case([v for v, *_ in rules])}, verdict) AS verdict
FROM named JOIN judged USING (host)
"""
