"""URL filters: rules for hosts and paths, and an empirical-Bayes host reputation for the rest.

Pages that a rule decides are labelled outcomes: blocked pages are bad, allowed
ones good. Bad shares are beta-binomial. The share of a suffix (the last label of
a host, or one of the longer ``suffixes``) is shrunk towards that of all pages, the
one of a registered domain (one label more) towards its suffix, and the one of a
host towards its domain. A port says nothing about a host's reputation and is left
out of it; a numeric address is a domain of its own, and all of them share a suffix.
How strongly is learned on each level from how far the shares below a parent
differ beyond chance. A page without a rule is blocked if even a low bound of its
host's posterior share is above ``threshold``.

All steps are DataFrame expressions. Pages are counted once by host; domains and
suffixes are summed from hosts, so no later step grows with the pages but the
join that brings the reputation back, which splits large hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.joins import split_join
from blackspot.runtime import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "://([^/?#]*)([^?#]*)"
ALLOW, BLOCK = "allow", "block"

#: (verdict, host, start of the path)
RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
         (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]
#: Suffixes of two labels below which domains are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "ac.jp",
            "com.br", "com.ar", "com.mx", "com.cn", "com.hk", "com.tw", "com.sg", "com.tr", "co.in", "co.kr", "co.za", "co.il")
#: A host without its port, what a numeric address looks like, and the suffix of all of them.
PORT, NUMERIC, NO_NAME = ":[0-9]*$", r"^([0-9.]+|\[.*\])$", "#"
#: Bad share above which a host is blocked, and how many standard deviations below its mean the bound lies.
THRESHOLD, DEVIATIONS = 0.5, 1.64
#: Pages that stand behind the prior of all pages, and the limits of the learned correlation within a parent.
PRIOR_PAGES, LEAST, MOST = 2.0, 0.001, 0.999


def address(column: str) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and for text without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(column), ADDRESS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def decided(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(start)
        name, verdict = F.when(fits, host + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def correlation(groups: DataFrame) -> float:
    """Moment estimate of the beta-binomial correlation of shares within their parent.

    ``groups`` has ``n`` labelled pages, ``bad`` ones, and the parent's share ``p``.
    """
    m = groups.filter("n > 0").agg(
        F.sum(F.expr("n * (bad / n - p) * (bad / n - p)")).alias("s"), F.sum(F.expr("p * (1 - p)")).alias("noise"),
        F.sum(F.expr("(n - 1) * p * (1 - p)")).alias("room")).first()
    if not m["room"]:
        return MOST if m["s"] else LEAST
    return min(MOST, max(LEAST, (m["s"] - m["noise"]) / m["room"]))


def shrunk(groups: DataFrame) -> DataFrame:
    """``a`` and ``b`` of the posterior of each group, from its parent's share ``p``; ``share`` is the mean."""
    rho = correlation(groups)
    strength = 1.0 / rho - 1.0
    return (groups.withColumns({"a": F.col("p") * strength + F.col("bad"),
                                "b": (1.0 - F.col("p")) * strength + (F.col("n") - F.col("bad"))})
            .withColumn("share", F.col("a") / (F.col("a") + F.col("b"))))


def named(host: str) -> Column:
    """The host that has a reputation: without its port."""
    return F.regexp_replace(host, PORT, "")


def registered(host: str, suffixes: tuple[str, ...]) -> dict[str, Column]:
    """Suffix and registered domain of a host without port."""
    labels = F.split(host, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n))
    numeric, long = F.col(host).rlike(NUMERIC), last(2).isin(*suffixes)
    return {"suffix": F.when(numeric, NO_NAME).when(long, last(2)).otherwise(last(1)),
            "domain": F.when(numeric, F.col(host)).when(long, last(3)).otherwise(last(2))}


def reputation(labelled: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host, pages, n, bad, a, b, share`` for every host of ``(host, outcome)``.

    ``outcome`` is 1 for a bad page, 0 for a good one and null for one without a
    label. Hosts without labelled pages get the share of their domain.
    """
    hosts = cut(labelled.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("outcome").alias("n"),
                                              F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
                .withColumns(registered("host", suffixes)))
    up = lambda rows, key, *keep: rows.groupBy(key, *keep).agg(*[F.sum(c).alias(c) for c in ("n", "bad")], F.count(F.lit(1)).alias("_size"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = total["n"] or 0, total["bad"] or 0
    everywhere = (bad + PRIOR_PAGES / 2) / (n + PRIOR_PAGES)
    domains = cut(up(hosts, "domain", "suffix"))
    suffixes = cut(shrunk(up(domains, "suffix").withColumn("p", F.lit(everywhere))).select("suffix", F.col("share").alias("p"), "_size"))
    domains = shrunk(cut(split_join(domains.withColumnRenamed("_size", "_hosts"), suffixes, ["suffix"], "_size", "domain").drop("_size")))
    domains = cut(domains.select("domain", F.col("share").alias("p"), F.col("_hosts").alias("_size")))
    return shrunk(cut(split_join(hosts, domains, ["domain"], "_size", "host"))).select("host", "pages", "n", "bad", "a", "b", "share")


def low_bound(deviations: float) -> Column:
    """The posterior mean less ``deviations`` standard deviations."""
    a, b = F.col("a"), F.col("b")
    return F.col("share") - deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
               deviations: float = DEVIATIONS, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Every row of ``pages`` with ``page_id, host, path, rule, verdict, share``.

    Of several fitting rules the longest wins. A null url, or one without
    ``://``, has an empty host and path, which is a host like any other. Repeated
    rows come out as often as they come in, null page ids included; other columns
    are not read; an empty table gives no rows.
    """
    host, path = address("url")
    rule, verdict = decided(rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})
    rows = rows.withColumn("_name", named("host"))
    outcome = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == BLOCK).cast("int")).alias("outcome")
    known = cut(reputation(rows.select(F.col("_name").alias("host"), outcome), suffixes)
                .withColumn("risky", low_bound(deviations) > threshold).select(F.col("host").alias("_name"), "pages", "share", "risky"))
    judged = split_join(rows, known, ["_name"], "pages", ["page_id", "path"])
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("risky"), BLOCK).otherwise(ALLOW)).alias("verdict"), "share")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("share")


def level_sql(name: str, rows: str, key: str) -> str:
    """The shrunk shares of one level, as ``{name}(.., share)``."""
    return f"""{name}_rho AS (SELECT CASE WHEN coalesce(sum((n - 1) * p * (1 - p)), 0) = 0
    THEN CASE WHEN coalesce(sum(n * (bad / n - p) * (bad / n - p)), 0) = 0 THEN {LEAST}::DOUBLE ELSE {MOST}::DOUBLE END
    ELSE least({MOST}::DOUBLE, greatest({LEAST}::DOUBLE, (sum(n * (bad / n - p) * (bad / n - p)) - sum(p * (1 - p))) / sum((n - 1) * p * (1 - p)))) END AS rho
  FROM {rows} WHERE n > 0),
{name} AS (SELECT *, a / (a + b) AS share FROM (SELECT {rows}.*, p * (1.0::DOUBLE / rho - 1.0::DOUBLE) + bad AS a,
    (1.0::DOUBLE - p) * (1.0::DOUBLE / rho - 1.0::DOUBLE) + (n - bad) AS b FROM {rows}, {name}_rho))"""


OP6_SQL = f"""WITH r AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s}') THEN '{h}{s}'"
                                   for _, h, s in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule FROM r),
known AS (SELECT *, regexp_replace(host, '{PORT}', '') AS name, CASE {" ".join(f"WHEN rule = '{h}{s}' THEN '{v}'" for v, h, s in RULES)} END AS ruled FROM ruled),
hosts AS (SELECT name, count(ruled) AS n, CAST(count(*) FILTER (ruled = '{BLOCK}') AS DOUBLE) AS bad, string_split(name, '.') AS parts,
  regexp_matches(name, '{NUMERIC}') AS numeric, array_to_string(parts[-2:], '.') IN {SUFFIXES} AS long FROM known GROUP BY name),
named AS (SELECT name, n, bad, CASE WHEN numeric THEN '{NO_NAME}' WHEN long THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
  CASE WHEN numeric THEN name WHEN long THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM hosts),
d0 AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix),
s0 AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, sum(bad) AS bad,
  (SELECT (sum(bad) + {PRIOR_PAGES / 2}::DOUBLE) / (sum(n) + {PRIOR_PAGES}::DOUBLE) FROM d0) AS p FROM d0 GROUP BY suffix),
{level_sql("s1", "s0", "suffix")},
d1 AS (SELECT d0.*, s1.share AS p FROM d0 JOIN s1 USING (suffix)),
{level_sql("d2", "d1", "domain")},
h1 AS (SELECT named.*, d2.share AS p FROM named JOIN d2 USING (domain)),
{level_sql("h2", "h1", "host")}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN share - {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0::DOUBLE))) > {THRESHOLD}
  THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict FROM known JOIN h2 USING (name)"""
