"""URL filter: explicit rules first, else empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted per host.  The share of bad pages is shrunk level by
level: the suffix (last label) towards all pages, the registered domain (last two labels)
towards its suffix, the host towards its domain.  Each level is a beta prior whose strength is
estimated by moments from the spread of the groups below it.  A host is blocked when the lower
bound of its posterior (normal approximation) is above the tolerated share of bad pages, so a
few bad pages of a small host do not block it.

Everything is a projection or a partial aggregation; only the table of hosts is joined back.
A rule list is compiled into one CASE expression, longest rule first; it is meant for lists of
at most ``MAX_RULES`` and refuses longer ones.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and
gets the reputation of the empty host; labels that are null do not count; a page without
outcome does not count; repeated rows count as often as they stand; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the query, (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MAX_RULES = 1000
#: Tolerated share of bad pages and the number of standard deviations of the bound.
TOLERATED, DEVIATIONS = 0.5, 1.645
#: A prior counts as at least and at most this many pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 200.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(known, "://") > 0, F.substr(known, F.instr(known, F.lit("://")) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule of columns host and path, as text, and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled")
    name, verdict = None, None
    for host, path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def _domain(host: str = "host") -> Column:
    return F.substring_index(host, ".", -2)


def _suffix(host: str = "host") -> Column:
    return F.substring_index(host, ".", -1)


def _strength(mean: Column) -> Column:
    """Prior strength by moments: how much more the groups' shares vary than chance makes them.

    With overdispersion rho (between-group share of variance), a beta prior of strength
    1 / rho - 1 has that spread.
    """
    n, bad, one = F.col("n"), F.col("bad"), F.max(mean)
    between = F.sum((bad - n * mean) * (bad - n * mean) / n)
    chance = F.count(F.lit(1)) * one * (1 - one)
    pairs = F.sum(n - 1) * one * (1 - one)
    rho = F.when(pairs > 0, (between - chance) / pairs)
    strength = F.when(rho > 0, 1 / F.least(rho, F.lit(1.0)) - 1).otherwise(F.lit(MOST_STRENGTH))
    return F.greatest(F.lit(LEAST_STRENGTH), F.least(strength, F.lit(MOST_STRENGTH)))


def host_reputation(pages: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) from rows (host, bad boolean); unlabelled rows have null bad.

    Every host of the pages gets a row; a host without labels has its domain's prior.
    """
    outcome = F.col("bad").cast("boolean")
    hosts = pages.groupBy("host").agg(
        F.count(outcome).alias("n"), F.count(F.when(outcome, 1)).alias("bad")
    ).select("*", _domain().alias("domain"), _suffix().alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("top_mean"))

    def shrunk(joined: DataFrame, prior: str, out: str) -> DataFrame:
        """Adds the posterior parts a, b and the posterior mean ``out``."""
        a = F.col(prior) * F.col("strength") + F.col("bad")
        b = (1 - F.col(prior)) * F.col("strength") + F.col("n") - F.col("bad")
        return joined.withColumn("a", a).withColumn("b", b).withColumn(out, a / (a + b))

    def below(groups: DataFrame, parents: DataFrame, key: str, prior: str, out: str) -> DataFrame:
        joined = groups.join(parents, key)
        strengths = joined.where("n > 0").groupBy(key).agg(_strength(F.col(prior)).alias("strength"))
        return shrunk(joined.join(strengths, key, "left").fillna({"strength": MOST_STRENGTH}), prior, out)

    # One aggregate row each: the mean of all pages, and the strength at the top.
    top = suffixes.crossJoin(F.broadcast(total))
    top_strength = top.where("n > 0").agg(_strength(F.col("top_mean")).alias("strength"))
    by_suffix = shrunk(top.crossJoin(F.broadcast(top_strength)), "top_mean", "suffix_mean").select("suffix", "suffix_mean")
    by_domain = below(domains, by_suffix, "suffix", "suffix_mean", "domain_mean").select("domain", "domain_mean")
    by_host = below(hosts, by_domain, "domain", "domain_mean", "mean")
    spread = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return by_host.select("host", "n", "bad", "mean", (F.col("mean") - DEVIATIONS * spread).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, page_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page, host, path, rule, verdict) of every page.

    ``outcomes`` has (page id, bad boolean) of the labelled pages, one row per page id.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(page_col).alias("page"), host.alias("host"), path.alias("path"))
    said = outcomes.select(F.col(page_col).alias("labelled"), "bad")
    judged = split.select("page", "host").join(said, F.col("page") == F.col("labelled"), "left")
    reputation = host_reputation(judged.select("host", "bad")).select(F.col("host").alias("h"), "bound")
    name, verdict = fitting_rule(rules)
    with_bound = split.join(reputation, F.col("host") == F.col("h"), "left")
    method = F.when(F.col("bound") > TOLERATED, "block").otherwise("allow")
    return with_bound.select(
        F.col("page").alias(page_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url path ends in the id of a labelled document.

    A page is bad if its document is of low quality or toxic.  One row per page id.
    """
    _, path = host_and_path(F.col("url"))
    numbered = pages.select("page_id", F.regexp_extract(path, r"^/[a-z]+/(\d{1,18})(?:\.|/|$)", 1).alias("digits"))
    numbered = numbered.where("digits <> ''").select("page_id", F.col("digits").cast("bigint").alias("doc"))
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(
        (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    )
    judged = labels.select(F.col("doc_id").alias("doc"), bad.alias("bad")).groupBy("doc").agg(F.max("bad").alias("bad"))
    return numbered.join(judged, "doc").groupBy("page_id").agg(F.max("bad").alias("bad"))


def oracle() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, says) for h, p, says in cases]
    rule = "CASE " + " ".join(f"WHEN {when} THEN '{name}'" for when, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {when} THEN '{says}'" for when, _, says in fits) + " END"

    def strength(prior: str) -> str:
        return f"""greatest({LEAST_STRENGTH!r}, least({MOST_STRENGTH!r}, coalesce(CASE WHEN
            (sum((bad - n * {prior}) * (bad - n * {prior}) / n) - count(*) * max({prior}) * (1 - max({prior}))) / nullif(sum(n - 1) * max({prior}) * (1 - max({prior})), 0) > 0
            THEN 1 / least(1.0, (sum((bad - n * {prior}) * (bad - n * {prior}) / n) - count(*) * max({prior}) * (1 - max({prior}))) / nullif(sum(n - 1) * max({prior}) * (1 - max({prior})), 0)) - 1 END, {MOST_STRENGTH!r})))"""

    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT doc_id AS doc, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels
      WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
o AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, try_cast(regexp_extract(path, '^/[a-z]+/(\d{{1,18}})(?:\.|/|$)', 1) AS BIGINT) AS doc FROM h)
      JOIN j USING (doc) GROUP BY 1),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
        count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM h LEFT JOIN o USING (page_id) GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM suffixes),
s1 AS (SELECT *, m AS prior FROM suffixes, top),
k1 AS (SELECT {strength("prior")} AS k FROM s1 WHERE n > 0),
p1 AS (SELECT suffix, (prior * k + bad) / (k + n) AS mean FROM s1, k1),
s2 AS (SELECT d.*, p1.mean AS prior FROM domains d JOIN p1 USING (suffix)),
k2 AS (SELECT suffix, {strength("prior")} AS k FROM s2 WHERE n > 0 GROUP BY 1),
p2 AS (SELECT domain, (prior * coalesce(k, {MOST_STRENGTH!r}) + bad) / (coalesce(k, {MOST_STRENGTH!r}) + n) AS mean FROM s2 LEFT JOIN k2 USING (suffix)),
s3 AS (SELECT t.*, p2.mean AS prior FROM hosts t JOIN p2 USING (domain)),
k3 AS (SELECT domain, {strength("prior")} AS k FROM s3 WHERE n > 0 GROUP BY 1),
p3 AS (SELECT host, prior * coalesce(k, {MOST_STRENGTH!r}) + bad AS a, (1 - prior) * coalesce(k, {MOST_STRENGTH!r}) + n - bad AS b FROM s3 LEFT JOIN k3 USING (domain)),
r AS (SELECT host, a / (a + b) - {DEVIATIONS!r} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM p3)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bound > {TOLERATED!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN r USING (host)
"""
