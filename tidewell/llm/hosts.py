"""URL filters by rules and empirical-Bayes host reputation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import durable
from tidewell.llm.rules import bound

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is blocked where its share of bad pages is above WORST, but for a chance of DOUBT at most.
WORST, DOUBT = 0.5, 0.05
#: Public suffixes of more than one label. Others are the last label; give judge() a full list where it matters.
SUFFIXES = tuple(
    "co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz govt.nz co.jp or.jp ne.jp ac.jp go.jp co.kr or.kr go.kr "
    "com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw co.in net.in org.in gov.in com.mx org.mx com.ar com.tr co.za org.za "
    "com.sg com.hk org.hk co.il org.il com.ua github.io".split()
)
#: What stands for the suffix of IP addresses.
ADDRESS = "#"
#: Bounds of the correlation of pages below one parent, whose inverse is a prior's strength.
LOOSE, TIGHT = 0.9, 0.0001


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def site(host: Column) -> Column:
    """A host without user part, port and a dot at its end."""
    h = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(F.when(F.startswith(h, F.lit("[")), F.regexp_extract(h, r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_replace(h, r":[0-9]*$", "")), r"\.$", "")


def parents(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a site. Addresses are domains of their own below ADDRESS.

    ``suffixes`` may have lines of a public-suffix list: names, wildcards (``*.ck``: any name below ck is a suffix) and
    exceptions (``!www.ck``: a domain below ck after all). The longest that fits decides, exceptions before others.
    """
    address = F.rlike(site, F.lit(r"^(?:[0-9]+(?:\.[0-9]+){3}$|\[)"))
    last = lambda n: F.substring_index(site, ".", -n)
    labels = F.size(F.split(site, r"\."))
    suffix, domain = last(1), last(2)
    names = [x for x in suffixes if x[0] not in "*!"]
    wild, kept = [x[2:] for x in suffixes if x.startswith("*.")], [x[1:] for x in suffixes if x.startswith("!")]
    for n in sorted({x.count(".") + 1 for x in names} | {x.count(".") + 2 for x in wild}):
        known = last(n).isin([x for x in names if x.count(".") + 1 == n])
        known = known | ((labels >= n) & last(n - 1).isin([x for x in wild if x.count(".") + 2 == n])) if n > 1 else known
        suffix, domain = F.when(known, last(n)).otherwise(suffix), F.when(known, last(n + 1)).otherwise(domain)
    for n in sorted({x.count(".") + 1 for x in kept}):
        known = last(n).isin([x for x in kept if x.count(".") + 1 == n])
        suffix, domain = F.when(known, last(n - 1)).otherwise(suffix), F.when(known, last(n)).otherwise(domain)
    return F.when(address, site).otherwise(domain), F.when(address, ADDRESS).otherwise(suffix)


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad of the pages (page_id, url) whose outcome is known.

    A page's outcome is that of the document it carries, which its path names: /lang/doc_id, then a dot, a slash or no
    more. ``labels``: doc_id, quality (1 good). What rules say of a page is no outcome: it would only repeat the rules. Null
    urls, and paths that name no labelled document, have none; null labels give null outcomes, which judge() doesn't count. A
    page that is repeated counts once, unless its rows differ in what they carry; a document with several labels counts
    each. No pages or no labels give no rows.
    """
    named = F.regexp_extract(parts(F.col("url"))[1], r"^/[^/]*/([0-9]{1,18})(?:[./]|$)", 1)
    rows = pages.select("page_id", F.when(named != "", named).cast("long").alias("_named")).distinct()
    return rows.join(labels.select("doc_id", "quality"), F.col("_named") == F.col("doc_id")).select("page_id", (1 - F.col("quality")).cast("int").alias("bad"))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ratio(children: DataFrame, parent_mean: str) -> Column:
    """Correlation of outcomes within a child, by moments: observed spread against what single draws give."""
    m, n = F.col(parent_mean), F.col("n").cast("double")
    spread = F.sum(F.when((n > 0) & (m > 0) & (m < 1), n * F.pow(F.col("bad") / n - m, F.lit(2.0)) / (m * (1 - m))))
    used = F.count_if((n > 0) & (m > 0) & (m < 1))
    pairs = F.sum(F.when((n > 0) & (m > 0) & (m < 1), n - 1))
    return F.least(F.lit(LOOSE), F.greatest(F.lit(TIGHT), F.coalesce((spread - used) / F.when(pairs > 0, pairs), F.lit(TIGHT))))


def strength(children: DataFrame, parent_mean: str) -> float:
    return 1 / children.agg(ratio(children, parent_mean).alias("r")).first()[0] - 1


def tail(x: Column, a: Column, b: Column) -> Column:
    """P(share <= x) for a beta distribution: Lentz's continued fraction, taken on the side where it converges fast."""
    near = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)

    def series(v: Column) -> Column:
        p, q, y = v["p"], v["q"], v["y"]
        safe = lambda z: F.when(F.abs(z) < 1e-300, 1e-300).otherwise(z)
        start = bound(1 / safe(1 - (p + q) * y / (p + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("f")))

        def once(s: Column, factor: Column) -> Column:
            both = F.struct((1 / safe(1 + factor * s["d"])).alias("d"), safe(1 + factor / s["c"]).alias("c"))
            return bound(both, lambda z: F.struct(z["c"].alias("c"), z["d"].alias("d"), (s["f"] * z["c"] * z["d"]).alias("f")))

        def twice(s: Column, i: Column) -> Column:
            even, odd = i * (q - i) * y / ((p + 2 * i - 1) * (p + 2 * i)), -(p + i) * (p + q + i) * y / ((p + 2 * i) * (p + 2 * i + 1))
            return bound(once(s, even), lambda z: once(z, odd))

        steps = F.transform(F.sequence(F.lit(1), (30 + 3 * F.sqrt(p + q)).cast("int")), lambda i: i.cast("double"))
        fraction = F.aggregate(steps, start, twice, lambda s: s["f"])
        return F.exp(p * F.log(y) + q * F.log(1 - y) - v["beta"]) * fraction / p

    def log_gamma(z: Column) -> Column:  # Stirling's series from z + 10 on
        up = z + 10
        return (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3.0))) + 1 / (1260 * F.pow(up, F.lit(5.0))) - sum((F.log(z + i) for i in range(10)), F.lit(0.0))

    value = bound(F.struct(p.alias("p"), q.alias("q"), y.alias("y"), (log_gamma(p) + log_gamma(q) - log_gamma(p + q)).alias("beta")), series)
    return F.when(near, value).otherwise(1 - value)


def reputations(sites: DataFrame, worst: float = WORST, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n, bad -> host, n, bad, alpha, beta, chance: the beta posterior of each host's share of bad pages, and its
    chance of a share of ``worst`` or less.

    Shares are shrunk from level to level: a public suffix towards all pages, a registered domain towards its suffix, a
    host towards its domain, each with a prior whose strength is estimated from the spread at that level. A public suffix
    is shared by strangers: hosts of domains without any outcome have no reputation, and their chance is null.
    """
    domain, suffix = parents(F.col("host"), suffixes)
    sites = durable(sites.withColumn("domain", domain).withColumn("suffix", suffix))
    totals = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = durable(totals(sites, "domain", "suffix"))
    suffixed = durable(totals(domains, "suffix"))
    n, bad = suffixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    up = F.lit((bad + 0.5) / (n + 1))

    def shrunk(rows: DataFrame, key: str, k: float) -> DataFrame:
        return durable(rows.select(F.col(key).alias("_key"), F.col("n").alias("_n"), ((F.col("bad") + k * F.col("up")) / (F.col("n") + k)).alias("up")))

    suffixed = suffixed.withColumn("up", up)
    means = shrunk(suffixed, "suffix", strength(suffixed, "up"))
    domains = durable(domains.join(means, F.col("suffix") == F.col("_key")).drop("_key", "_n"))
    means = shrunk(domains, "domain", strength(domains, "up"))
    sites = durable(sites.join(means, F.col("domain") == F.col("_key")))
    k = strength(sites, "up")
    a, b = F.col("bad") + k * F.col("up"), F.col("n") - F.col("bad") + k * (1 - F.col("up"))
    return durable(sites.select("host", "n", "bad", a.alias("alpha"), b.alias("beta"), F.when(F.col("_n") > 0, tail(F.lit(worst), a, b)).alias("chance")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, worst: float = WORST, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, chance for every page (page_id, url).

    ``outcomes``: page_id, bad (0 or 1) of labelled pages. Where no rule fits, a page is blocked if its site's
    share of bad pages lies above ``worst`` but for a ``chance`` of ``DOUBT``; a site is the host without user part and
    port. Null urls and urls without host have empty parts, no reputation, and are allowed. Repeated rows are judged
    alike, and each counts; a page with several outcomes counts each. Null outcomes don't count. Other columns are
    ignored. No pages give no rows.
    """
    host, path = parts(F.col("url"))
    rows = durable(pages.select("page_id", host.alias("host"), path.alias("path"), site(host).alias("_site")))
    seen = rows.select("page_id", "_site").join(outcomes.select(F.col("page_id").alias("_page"), "bad"), F.col("page_id") == F.col("_page"), "left")
    sites = seen.where("_site <> ''").groupBy(F.col("_site").alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    known = reputations(sites, worst, suffixes).select(F.col("host").alias("_known"), "chance")
    out = rows.join(known, F.col("_site") == F.col("_known"), "left").withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_r.verdict", F.when(F.col("chance") <= DOUBT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "chance")
