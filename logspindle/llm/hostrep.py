"""URL filter by empirical-Bayes host reputation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, settle

#: Fixed values: (host, path, verdict) of the rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A host is blocked if its bad share exceeds this even at the low end of the posterior.
BAD_SHARE = 0.5
#: Standard deviations from the posterior mean to that end: a normal approximation to the tenth percentile of the beta posterior,
#: which neither Spark nor SQL has a function for.
Z = 1.2816
#: Bounds of a level's prior strength, in pages.
STRENGTH = (1.0, 200.0)
#: Second-level labels under which names are registered.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where a country's second level is for registration."""
    labels = F.split(host, r"\.")
    two = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    return F.when(F.instr(suffix, ".") > 0, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame, mean: Column, weight: str, bad: str) -> DataFrame:
    """Adds ``k``: the prior strength by the method of moments over the groups' bad shares."""
    var = F.sum(F.col(weight) * F.pow(F.col(bad) / F.col(weight) - mean, 2)) / F.sum(weight)
    noise = F.sum(mean * (1 - mean)) / F.sum(weight)
    between = F.greatest(var - noise, F.lit(1e-9))
    return groups.agg(F.least(F.greatest(F.avg(mean * (1 - mean)) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("k"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host's bad share from ``outcomes`` (host string, n long labelled pages, bad long of them).

    Hosts shrink towards their registered domain, domains towards their suffix, suffixes towards the whole;
    each level's beta prior has its parent's posterior mean and a strength found from the spread between the
    groups of the level. Returns host, n, bad, prior, strength, mean, low: the posterior mean less ``Z`` deviations.
    """
    hosts = settle(outcomes.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    domains = settle(domains)
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    whole = suffixes.agg(((F.coalesce(F.sum("sbad"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("wmean"))
    suffixes = settle(suffixes.join(F.broadcast(whole)))  # one row
    lab = lambda df, n: df.where(F.col(n) > 0)
    ks = _strength(lab(suffixes, "sn"), F.col("wmean"), "sn", "sbad").select(F.coalesce("k", F.lit(STRENGTH[0])).alias("ks"))
    suffixes = suffixes.join(F.broadcast(ks)).withColumn("smean", (F.col("sbad") + F.col("ks") * F.col("wmean")) / (F.col("sn") + F.col("ks")))
    domains = settle(domains.join(suffixes.select("suffix", "smean"), "suffix"))
    kd = _strength(lab(domains, "dn"), F.col("smean"), "dn", "dbad").select(F.coalesce("k", F.lit(STRENGTH[0])).alias("kd"))
    domains = domains.join(F.broadcast(kd)).withColumn("dmean", (F.col("dbad") + F.col("kd") * F.col("smean")) / (F.col("dn") + F.col("kd")))
    hosts = settle(hosts.join(domains.select("suffix", "domain", "dmean"), ["suffix", "domain"]))
    kh = _strength(lab(hosts, "n"), F.col("dmean"), "n", "bad").select(F.coalesce("k", F.lit(STRENGTH[0])).alias("kh"))
    hosts = hosts.join(F.broadcast(kh))
    a, b = F.col("bad") + F.col("kh") * F.col("dmean"), F.col("n") - F.col("bad") + F.col("kh") * (1 - F.col("dmean"))
    hosts = hosts.withColumn("mean", a / (a + b)).withColumn("low", a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return hosts.select("host", "n", "bad", F.col("dmean").alias("prior"), F.col("kh").alias("strength"), "mean", "low")


def judge(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad_share: float = BAD_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's reputation for every row of ``pages``.

    ``labels`` (id, bad 0/1 or null) has the outcomes of labelled pages, by page id; rows that repeat an id count
    as their largest value. A rule decides where one fits; else a host whose posterior low end exceeds
    ``bad_share`` is blocked and every other host is allowed, also one without labels and the empty host.
    Null and malformed urls have empty host and path; rows that repeat are judged alike; null ids stay.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    marks = labels.where(F.col("id").isNotNull() & F.col("bad").isNotNull()).groupBy("id").agg(F.max("bad").alias("bad"))
    seen = rows.join(marks, rows["page_id"] == marks["id"], "left")
    outcomes = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    outcomes = settle(outcomes)
    rep = settle(reputations(outcomes.drop("pages")).join(outcomes.select("host", "pages"), "host"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > bad_share, F.lit("block")).otherwise(F.lit("allow"))
    out = join_hot(rows, rep, ["host"], "pages")  # every host has its row
    return out.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), F.col("mean").alias("host_mean"), F.col("low").alias("host_low"))


def query(spark, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label row of its number says quality 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict", "host_labelled", "host_bad", F.round("host_low", 6).alias("host_low"))


def _k(mean: str, n: str, bad: str) -> str:
    var = f"sum({n} * pow({bad} / {n}::DOUBLE - {mean}, 2)) / sum({n})"
    return f"coalesce(least(greatest(avg({mean} * (1 - {mean})) / greatest({var} - sum({mean} * (1 - {mean})) / sum({n}), 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]}), {STRENGTH[0]})"


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_SECOND = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
SQL = f"""
WITH r AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
o AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, string_split(host, '.') AS ls FROM r LEFT JOIN m ON page_id = doc_id GROUP BY host),
o2 AS (SELECT host, n, bad, ls, len(ls) >= 3 AND length(ls[-1]) = 2 AND ls[-2] IN ({_SECOND}) AS two FROM o),
o3 AS (SELECT host, n, bad, array_to_string(ls[(CASE WHEN two THEN -2 ELSE -1 END):], '.') AS suffix, array_to_string(ls[greatest(1, len(ls) - CASE WHEN two THEN 2 ELSE 1 END):], '.') AS domain FROM o2),
d AS (SELECT suffix, domain, sum(n) AS dn, sum(bad) AS dbad FROM o3 GROUP BY 1, 2),
s AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY 1),
w AS (SELECT (coalesce(sum(sbad), 0) + 1) / (coalesce(sum(sn), 0) + 2)::DOUBLE AS wmean FROM s),
ks AS (SELECT {_k('wmean', 'sn', 'sbad')} AS k FROM s, w WHERE sn > 0),
s2 AS (SELECT suffix, (sbad + k * wmean) / (sn + k) AS smean FROM s, w, ks),
d2 AS (SELECT * FROM d JOIN s2 USING (suffix)),
kd AS (SELECT {_k('smean', 'dn', 'dbad')} AS k FROM d2 WHERE dn > 0),
d3 AS (SELECT suffix, domain, (dbad + k * smean) / (dn + k) AS dmean FROM d2, kd),
h AS (SELECT * FROM o3 JOIN d3 USING (suffix, domain)),
kh AS (SELECT {_k('dmean', 'n', 'bad')} AS k FROM h WHERE n > 0),
ab AS (SELECT host, n, bad, bad + k * dmean AS a, n - bad + k * (1 - dmean) AS b FROM h, kh),
q AS (SELECT host, n, bad, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT page_id, host, path,
  CASE {' '.join("WHEN " + _FITS.format(h=h, p=p) + f" THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {' '.join("WHEN " + _FITS.format(h=h, p=p) + f" THEN '{v}'" for h, p, v in _LONGEST)} WHEN low > {BAD_SHARE} THEN 'block' ELSE 'allow' END AS verdict,
  n AS host_labelled, bad AS host_bad, round(low, 6) AS host_low
FROM r JOIN q USING (host)
"""
