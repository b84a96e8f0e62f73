"""URL filter: hand-made rules first, then the reputation of a host by empirical Bayes, all native.

Outcomes of labelled pages (bad or not) are counted by host, registered domain and suffix. A level's
rate is shrunk to that of the level above through a beta prior: the global rate is the prior of a suffix,
the suffix's posterior mean that of a domain, the domain's that of a host. The strength of each level's
prior is taken from the data by the method of moments. A host is blocked when the lower bound of its
posterior, mean less z standard deviations, is above the cutoff; a host without labelled pages has its
domain's posterior, and so on up.

Counts are pre-aggregated before each shuffle and the tables above hosts shrink at every step; the last
step is an equi-join of pages with one row a host, in which Spark may split hot hosts.

Defined results: a null URL or one without :// has an empty host and path, no rule, and is judged as a host
like any other; repeated rows give repeated results; extra columns are not read; without any labels the
verdict is allow.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
]
#: Rules stand in the plan as a literal; a longer list is refused.
MAX_RULES = 2000
#: Standard deviations between the posterior mean and its bound; the bound above which a host is blocked.
Z = 1.645
CUTOFF = 0.5
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: Second-level suffixes under which names are registered, plain values.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two under a country's second-level suffix."""
    second = "|".join(SECOND_LEVEL)
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_extract(bare, rf"((?:^|(?<=\.))(?:(?:{second})\.[a-z]{{2}}|[^.]*))$", 1)


def domain_of(host: Column) -> Column:
    """The suffix with the label before it."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    head = F.substring(bare, F.lit(1), F.greatest(F.length(bare) - F.length(suffix_of(host)) - 1, F.lit(0)))
    label = F.regexp_extract(head, r"([^.]*)$", 1)
    return F.when(label == "", suffix_of(host)).otherwise(F.concat_ws(".", label, suffix_of(host)))


def matched_rule(host: Column, path: Column, rules: list[UrlRule] = RULES) -> Column:
    """struct<n, text, verdict> of the longest rule that fits host and path, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<n:int,text:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["text"].alias("text"), r["verdict"].alias("verdict"))))


def _strength(counts: DataFrame, prior: str) -> DataFrame:
    """One row, __s: the prior strength whose beta-binomial variance fits the spread of the rates."""
    p, n = F.col(prior), F.col("n")
    sums = counts.where("n > 0").agg(F.sum((F.col("bad") - n * p) ** 2).alias("q"), F.sum(n * p * (1 - p)).alias("a"), F.sum(n * (n - 1) * p * (1 - p)).alias("b"))
    # E q = a + rho * b with rho = 1 / (strength + 1)
    rho = F.when((F.col("b") > 0) & (F.col("q") > F.col("a")), (F.col("q") - F.col("a")) / F.col("b"))
    s = F.coalesce(F.least(F.greatest(1 / rho - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH))
    return sums.select(s.alias("__s"))


def _level(counts: DataFrame, prior: str, out: str) -> DataFrame:
    """counts with `out`, the posterior mean, and __m, the posterior's total weight."""
    return counts.join(F.broadcast(_strength(counts, prior))).withColumn("__m", F.col("n") + F.col("__s")).withColumn(out, (F.col("bad") + F.col("__s") * F.col(prior)) / F.col("__m")).drop("__s")


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, mean, bound from outcomes (host, bad: 0, 1 or null where a page is not labelled).

    Every host of `outcomes` gets a row, labelled or not.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # one row a host from here on; the levels above read it several times
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    overall = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("p0"))
    suffixes = _level(suffixes.join(F.broadcast(overall)), "p0", "p1").select("suffix", "p1")
    domains = _level(domains.join(suffixes, "suffix"), "p1", "p2").select("domain", "suffix", "p2")
    hosts = _level(hosts.join(domains, ["domain", "suffix"]), "p2", "mean")
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("__m") + 1))
    return hosts.select("host", "n", "mean", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: host, path, the rule that decides, verdict, labelled pages of the host.

    outcomes: (page_id, bad) with one row a labelled page at most; repeated ids count once, as bad if any is.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(p.join(labels, "page_id", "left").select("host", "bad")).select("host", F.col("n").alias("n_labelled"), (F.col("bound") > CUTOFF).alias("__block"))
    p = p.withColumn("__rule", matched_rule(F.col("host"), F.col("path"), rules)).join(hosts, "host", "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__block"), "block").otherwise("allow"))
    return p.select("page_id", "host", "path", F.col("__rule.text").alias("rule"), verdict.alias("verdict"), "n_labelled")


def oracle() -> str:
    """judge() over `pages`, with `labels` of the same numbers as outcomes, in SQL."""
    second = "|".join(SECOND_LEVEL)
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in RULES)

    def level(name: str, source: str, prior: str, keys: str, out: str) -> str:
        return f"""
{name}_s AS (SELECT CASE WHEN b > 0 AND q > a THEN least(greatest(b / (q - a) - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END AS s FROM (
  SELECT sum((bad - n * {prior}) ** 2) AS q, sum(n * {prior} * (1 - {prior})) AS a, sum(n * (n - 1) * {prior} * (1 - {prior})) AS b FROM ({source}) WHERE n > 0)),
{name} AS (SELECT {keys}, n, n + s AS m, (bad + s * {prior}) / (n + s) AS {out} FROM ({source}), {name}_s)"""

    return rf"""
WITH rule(verdict, rhost, rpath, rtext) AS (VALUES {values}),
p0 AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, regexp_extract('.' || host, '\.((?:(?:{second})\.[a-z]{{2}}|[^.]*))$', 1) AS suffix FROM p0),
lab AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, suffix, CASE WHEN len(string_split(host, '.')) = len(string_split(suffix, '.')) THEN suffix ELSE string_split(host, '.')[-1 - len(string_split(suffix, '.'))] || '.' || suffix END AS domain,
  CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM p LEFT JOIN lab USING (page_id) GROUP BY host, suffix),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
g AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS q0 FROM s),{level("ls", "SELECT * FROM s, g", "q0", "suffix", "q1")},{level("ld", "SELECT d.*, q1 FROM d JOIN ls USING (suffix)", "q1", "domain, suffix", "q2")},{level("lh", "SELECT h.*, q2 FROM h JOIN ld USING (domain, suffix)", "q2", "host", "mean")},
best AS (SELECT k, arg_max(rtext, length(rtext)) AS rule, arg_max(verdict, length(rtext)) AS rv FROM p, rule WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (m + 1)) > {CUTOFF} THEN 'block' ELSE 'allow' END) AS verdict, CAST(n AS BIGINT) AS n_labelled
FROM p LEFT JOIN best USING (k) LEFT JOIN lh USING (host)
"""
