"""URL filters: rules by host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants, cut

BUCKETS = 16384
GRAM = 4

# The rules (verdict, domain, path) and what the small labelled table is made of.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BLOCKED_WORDS = (
    "adclick ads adserver adult banner bet bets betting bonus cam casino cheap cialis clickbait crack credit dating deal doubleclick escort free freebie gamble "
    "giveaway hack jackpot keygen loans lottery malware nude payday pharma phishing pills poker popunder popup porn prize promo replica serial sex slots spam "
    "spyware sweepstakes torrent track tracker tracking viagra warez webcam win winner xxx"
).split()
ALLOWED_WORDS = (
    "academy archive art atlas bakery bank books bridge cafe church city clinic college community cooking council court daily design docs engineering family farm "
    "film forest forum garden gazette guide harbor health history hotel journal kitchen lab law learning library manual maps market medical mountain museum music "
    "nature network news office opera park photo planet post press radio recipes research river school science shop society sports state store street studio "
    "support theater times tools town trade travel tutorial university valley village weather wiki winter world writers"
).split()
CONSONANTS, VOWELS = "b c d f g h k l m n p r s t th sh st tr v w".split(), "a e i o u ai ea io ou".split()
PREFIXES, SEPARATORS, TAILS = ("", "", "www.", "m.", "blog.", "my-"), ("-", "-", "", "."), ("", "", "", "24", "1", "s")
DOMAINS = ("example.com", "example.net", "example.org", "site.com", "page.net", "host.org", "web.io", "home.info")
PATHS = ("/", "", "/about", "/articles/2021", "/en/", "/de/", "/fr/", "/es/", "/it/", "/guide/start", "/posts/", "/index.html", "/p/", "/blog/", "/view?id=", "/search?q=")


def labelled_urls(spark: SparkSession, rows: int = 8192) -> DataFrame:
    """A small labelled table (url, blocked): half of hosts with a telling word, half of plain or made-up ones.

    Made from a counter by hashing, so it is the same everywhere. Prefixes, domains and paths are drawn alike for
    both labels and say nothing.
    """
    at = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda items, k: F.get(constants(list(items), "string"), at(k, len(items)))
    pair = lambda items, k: F.concat(pick(items, k), F.when(at(k + 1, 3) == 0, "").otherwise(F.concat(pick(SEPARATORS, k + 2), pick(items, k + 3))))
    made = F.concat(*[pick(part, 30 + 2 * k + j) for k in range(3) for j, part in enumerate((CONSONANTS, VOWELS))], pick(CONSONANTS, 40))
    blocked = F.col("id") % 2 == 0
    # A telling word next to a plain one still tells: two thirds of the blocked names, in either order.
    glue, telling, plain = pick(SEPARATORS, 60), pick(BLOCKED_WORDS, 61), pick(ALLOWED_WORDS, 62)
    mixed = F.when(at(63, 2) == 0, F.concat(telling, glue, plain)).otherwise(F.concat(plain, glue, telling))
    bad = F.when(at(64, 3) > 0, mixed).otherwise(pair(BLOCKED_WORDS, 10))
    name = F.when(blocked, bad).otherwise(F.when(at(20, 2) == 0, pair(ALLOWED_WORDS, 21)).otherwise(made))
    path = F.concat(pick(PATHS, 50), F.when(at(51, 2) == 0, at(52, 10_000).cast("string")).otherwise(""))
    url = F.concat(F.lit("https://"), pick(PREFIXES, 53), name, pick(TAILS, 54), F.lit("."), pick(DOMAINS, 55), path)
    return spark.range(rows).select(url.alias("url"), blocked.cast("int").alias("blocked"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (to ``?`` or ``#``)."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (domain and path) that fits: struct of verdict and rule, null if none does.

    A rule fits its domain and all subdomains, if the path begins with the rule's. Of rules of equal length the one
    that is listed first wins.
    """
    out = None
    for verdict, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def buckets(host: Column, path: Column) -> Column:
    """Hashed character n-grams (of 4) of ``host`` and of ``path``, each with marks at its ends."""

    def grams(part: Column, salt: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        last = F.greatest(F.size(chars) - GRAM + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(chars, i, GRAM), ""), F.lit(salt)), F.lit(BUCKETS)).cast("int"))

    return F.concat(grams(host, 1), grams(path, 2))


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", rounds: int = 40, penalty: float = 0.5) -> list[float]:
    """Weights by bucket, then the constant: penalised logistic regression, by accelerated steps in DataFrame operations.

    A URL's features are the shares of its n-grams by bucket times the root of their number. Each round sums the
    gradient by bucket; a step divides it by a bound of the curvature that holds for all buckets at once, and goes on
    from the last two points. The weights are BUCKETS + 1 numbers for any input. Null URLs or labels are left out;
    an empty table gives weights of 0.
    """
    spark = labelled.sparkSession
    host, path = host_and_path(F.col(url))
    rows = labelled.where(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select((F.col(blocked) > 0).cast("double").alias("y"), buckets(host, path).alias("b"))
    rows = cut(rows.withColumn("v", 1 / F.sqrt(F.size("b"))))
    each = F.explode(F.concat("b", F.array(F.lit(BUCKETS)))).alias("k")
    size = F.when(F.col("k") == BUCKETS, 1.0).otherwise(F.col("v"))
    bounds = rows.select(each, "v").groupBy("k").agg(F.sum(0.25 * size * (1 / F.col("v") + 1)).alias("h")).collect()
    bound = {r.k: r.h + penalty * (r.k < BUCKETS) for r in bounds}
    weights, ahead = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    for n in range(rounds):
        # Read from a table of one row: as a literal they would be spelt out in every round's plans, whose texts the driver keeps.
        held = spark.createDataFrame(pa.table({"w": pa.array([ahead], pa.list_(pa.float64()))})).scalar()
        errors = rows.withColumn("w", held).select("b", "v", (1 / (1 + F.exp(-_linear(F.col("b"), F.col("w"), ahead[BUCKETS]))) - F.col("y")).alias("e"))
        sums = errors.select(each, "v", "e").groupBy("k").agg(F.sum(size * F.col("e")).alias("g")).toArrow()
        for k, g in zip(sums["k"].to_pylist(), sums["g"].to_pylist(), strict=True):
            new = ahead[k] - (g + penalty * ahead[k] * (k < BUCKETS)) / bound[k]
            weights[k], ahead[k] = new, new + n / (n + 3) * (new - weights[k])
    return weights


def _linear(b: Column, weights: Column, constant: float) -> Column:
    total = F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(weights, k))
    return total / F.sqrt(F.size(b)) + constant


def judge(pages: DataFrame, weights: list[float], url: str = "url", rules=RULES) -> DataFrame:
    """Append host, path, rule, score (of blocking, 0 to 1) and verdict: the longest fitting rule's, else the model's.

    The model blocks from a score of 0.5. A null URL or one without ``://`` has an empty host and path, fits no rule
    and is judged by the model like any other. One pass without a shuffle; same-named columns are replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "score", "verdict", "_rule"}]
    host, path = host_and_path(F.col(url))
    out = pages.select(*kept, host.alias("host"), path.alias("path"))
    score = 1 / (1 + F.exp(-_linear(buckets(F.col("host"), F.col("path")), constants(weights, "double"), weights[BUCKETS])))
    out = out.withColumns({"_rule": rule_for(F.col("host"), F.col("path"), rules), "score": score})
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), "score", F.coalesce("_rule.verdict", model).alias("verdict"))
