"""URL filters with empirical-Bayes host reputation (operator 10), in DataFrame functions only.

Rules come first: the longest rule that fits a url decides. For the other urls the method decides: every labelled page
is an outcome, bad or good, of its host. A host's bad rate is shrunk through beta-binomial priors to that of its
registered domain, that to its suffix, and that to all pages; the strength of each level's prior is fitted by moments to
how much the rates of its members differ, and kept within STRENGTH outcomes, a documented parameter: moments give 0 or infinity where a
level's members differ wholly or not at all. A page is blocked when the lower bound of its host's posterior, mean less z deviations of the
beta distribution, lies above the threshold, so a host without evidence of its own is judged by its domain, and one bad page never blocks a host.

Scale: outcomes are summed per host before anything else, so a hot host shrinks map-side to a row per task; the levels
are sums of those rows. Pages meet their host's row in an equi-join that adaptive execution broadcasts when the host
table is small and splits where a host is hot. Rules are a literal list, meant for up to some thousands.

A host's sums are written once, and every level is made from them. Defined results: a null url, or one without ://, has empty host and path, fits no rule and is judged at the root level;
repeated rows are each judged; labels repeated for a page are summed; of rules that fit, equally long ones go by host; a url of any
length is read whole; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, named

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Least and most strength of a prior, in outcomes.
STRENGTH = (1.0, 1000.0)
#: Second-level labels under which names are registered one level deeper.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; null if none fits."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: two labels, or three under a second-level label; an address in digits is whole."""
    part = F.split(host, r"\.")
    n = F.size(part)
    deep = (n > 2) & F.element_at(part, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(part, -1)) == 2)
    take = F.when(deep, 3).otherwise(2)
    return F.when((n <= 2) | host.rlike(r"^[0-9.:\[\]]+$"), host).otherwise(F.array_join(F.slice(part, -take, take), "."))


def suffix_of(host: Column) -> Column:
    domain = domain_of(host)
    return F.when(domain.contains("."), F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1)).otherwise(domain)


def _strength(children: DataFrame, name: str) -> DataFrame:
    """One row: the prior's strength for members with (n, bad), by moments, within STRENGTH."""
    t = children.agg(F.sum("n").cast("double").alias("N"), F.sum("bad").cast("double").alias("B"), F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("Q"), F.count("*").alias("C"))
    mean = F.col("B") / F.col("N")
    var = mean * (1 - mean)
    between = (F.col("Q") - F.col("N") * mean * mean - (F.col("C") - 1) * var) / F.nullif(F.col("N") - F.col("N2") / F.col("N"), F.lit(0.0))
    k = F.when(between > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), var / between - 1))).otherwise(STRENGTH[1])
    return t.select(F.coalesce(k, F.lit(STRENGTH[1])).alias(name))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad) with a row per host that has outcomes or pages (n may be 0) -> posterior rate, sd and bounds per host."""
    h = outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    d = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    g = s.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("g_rate"))
    one = g.crossJoin(_strength(s.where("n > 0"), "k_s")).crossJoin(_strength(d.where("n > 0"), "k_d")).crossJoin(_strength(h.where("n > 0"), "k_h"))  # one row each
    s = s.crossJoin(F.broadcast(one)).select(F.col("suffix").alias("of_s"), "k_d", "k_h", ((F.col("bad") + F.col("k_s") * F.col("g_rate")) / (F.col("n") + F.col("k_s"))).alias("s_rate"))
    d = d.join(s, d["suffix"] == s["of_s"]).select(F.col("domain").alias("of_d"), "k_h", ((F.col("bad") + F.col("k_d") * F.col("s_rate")) / (F.col("n") + F.col("k_d"))).alias("d_rate"))
    h = h.join(d, h["domain"] == d["of_d"])
    a, b = F.col("bad") + F.col("k_h") * F.col("d_rate"), F.col("n") - F.col("bad") + F.col("k_h") * (1 - F.col("d_rate"))
    h = h.select("host", "n", "bad", a.alias("a"), b.alias("b")).withColumn("bad_rate", F.col("a") / (F.col("a") + F.col("b")))
    h = h.withColumn("bad_sd", F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("a") + F.col("b") + 1)))
    return h.select("host", "n", "bad", "bad_rate", "bad_sd", (F.col("bad_rate") - z * F.col("bad_sd")).alias("bad_low"), (F.col("bad_rate") + z * F.col("bad_sd")).alias("bad_high"))


def judge(pages: DataFrame, labels: DataFrame | None, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and bad_rate and bad_low of its host.

    labels has (label_id, label_col): a page's outcome is bad where label_col is 0, good where it is 1; other values and
    nulls are no outcome.
    """
    p = pages.select(named(id_col).alias("page_id"), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    if labels is None:
        seen = p.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    else:
        y = labels.select(named(label_id).alias("of"), named(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("of").agg(F.count("*").alias("n"), F.sum(1 - F.col("y")).alias("bad"))
        seen = p.join(y, p["page_id"] == y["of"], "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    rep = reputation(cut(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))), z).withColumnRenamed("host", "of_host")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = p.join(rep, p["host"] == rep["of_host"], "left")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_low") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_low", 6).alias("bad_low"))
