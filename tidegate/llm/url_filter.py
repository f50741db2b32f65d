"""Operator 4: URL filter by logistic regression on hashed character n-grams of host and path.

The model learns from a small labelled URL table (``labelled_urls()``, or any with ``url`` and
``blocked``; at most ``MAX_LABELLED`` rows, the bound up to which rows are taken for fitting). Hosts
and paths are cut into character n-grams, hashed into ``BUCKETS`` features, and weighed by Spark's
own logistic regression, so scoring is one scan without Python or shuffle. Rules come first: the
longest one that fits decides.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is
judged by the model's intercept; the longest of several rules wins, of equal ones the first given;
repeated rows are judged each; an empty table gives an empty result; other columns are not read and
may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MAX_LABELLED = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The small labelled table: words that name what a site offers, put into the same forms of URL.
_BLOCKED = ("casino poker slots jackpot roulette bets betting gamble lottery bingo pills viagra cialis pharma meds drugs "
            "adult porn xxx sexcam escort nude ads adserver adclick banner track tracker popup spam linkfarm farm seo "
            "warez crack keygen torrent payday loans replica cheap free win bonus").split()
_ALLOWED = ("wiki news library museum school college science history garden recipes weather travel maps parks music "
            "poems radio journal archive docs manual forum health clinic council church theatre cinema sports cycling "
            "hiking birds trees river harbour village market bakery cafe atlas letters essays lessons stories "
            "kitchen furniture chemistry physics biology geography language translation university research library "
         "hospital pharmacy dentist insurance taxes passport railway airport harvest orchard fishing sailing climbing "
         "photography painting sculpture orchestra festival magazine editorial opinion weekend interview obituary "
         "election parliament justice police weather climate energy recycling volunteers charity scouts kindergarten "
         "bicycle engine software database compiler network tutorial reference glossary dictionary contact about team "
         "maison jardin avenir zeitung schule garten casa camino tiempo").split()
# Hosts and paths that say nothing by themselves: both kinds of URL have them alike.
_NEUTRAL_HOSTS = ("www.lumora.info", "brandel.co.uk", "pages.ostrava.eu", "home.kivik.se", "users.delphin.it", "cdn.quorum.io",
                  "www.fabrikam.biz", "static.mirelle.be", "portal.tanaka.jp", "hosting.zubrin.us")
_NEUTRAL_PATHS = ("", "/", "/index.php", "/2019/04/12", "/view/88310", "/a/b/c.htm", "/item-5521", "/home", "/p/77", "/default.aspx")
_NAMES = {1: ("{0}-{1}", "{1}-{0}", "{0}", "my{0}-{1}", "{0}{1}"), 0: ("{0}", "{1}{0}", "{0}", "my{0}", "{0}-{1}")}
_HOSTS = ("www.{}.com", "{}.net", "shop.{}.org", "{}.co.uk", "{}.io")
_PATHS = ("/{0}/{1}", "/{0}", "/{0}-{1}.php", "/c/{1}/{0}/5", "/{1}_{0}/index.htm", "/{0}/{1}.html", "/2021/{0}")


def labelled_urls() -> list[tuple[str, int]]:
    """URLs with 1 for blocked: each word, with another word of its kind, in hosts of neutral paths and in paths of neutral hosts.

    Paths of both kinds are also given on hosts of allowed words. Blocked sites join words by hyphens more
    often; all else is the same for both kinds.
    """
    rows = []
    for words, blocked in ((_BLOCKED, 1), (_ALLOWED, 0)):
        for i, word in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            friendly = _ALLOWED[(i * 11 + 5) % len(_ALLOWED)]
            for j, name in enumerate(_NAMES[blocked]):
                for k, host in enumerate(_HOSTS):
                    path = _NEUTRAL_PATHS[(i + 3 * j + k) % len(_NEUTRAL_PATHS)]
                    rows.append((f"https://{host.format(name.format(word, other))}{path}", blocked))
            for k, path in enumerate(_PATHS):
                hosts = [_NEUTRAL_HOSTS[(i + 3 * k + j) % len(_NEUTRAL_HOSTS)] for j in range(2)]
                rows += [(f"https://{host}{path.format(word, other)}", blocked)
                         for host in (*hosts, _HOSTS[k % len(_HOSTS)].format(friendly))]
    return rows


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams with the text's ends marked; ``mark`` keeps host and path apart."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*[
        F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)),
                                                  lambda i, n=n: F.concat(F.lit(mark), framed.substr(i, F.lit(n)))))
        .otherwise(F.array().cast("array<string>")) for n in SIZES])


def _with_grams(urls: DataFrame, host: str, path: str) -> DataFrame:
    return urls.withColumn("__grams", F.concat(_grams(F.col(host), "h"), _grams(F.col(path), "p")))


def fit(labelled: DataFrame) -> PipelineModel:
    """The model of a labelled URL table with ``url`` and ``blocked`` (0 or 1)."""
    rows = (labelled.where("url is not null and blocked is not null").limit(MAX_LABELLED)
            .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label")))
    stages = [HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features"),
              LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability",
                                 rawPredictionCol="__raw", predictionCol="__blocked", maxIter=60, regParam=0.01)]
    return Pipeline(stages=stages).fit(_with_grams(rows.coalesce(1), "host", "path").cache())


def fits(host: Column, path: Column, rule: tuple[str, str]) -> Column:
    """Whether a rule (host, path) holds for its host and all subdomains, and for paths that start with its own."""
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]], *, keys: list[str],
          url: str = "url", block_at: float = 0.4) -> DataFrame:
    """Key columns, ``host``, ``path``, ``rule``, ``verdict`` and ``probability`` of being blocked by the model.

    ``rules``: (allow or block, host, path).
    """
    parts = pages.select(*(pages[k].alias(f"__key_{i}") for i, k in enumerate(keys)), host_of(pages[url]).alias("host"),
                         path_of(pages[url]).alias("path"))
    scored = model.transform(_with_grams(parts, "host", "path"))
    host, path = F.col("host"), F.col("path")
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    none = F.lit(None).cast("string")
    rule = reduce(lambda rest, r: F.when(fits(host, path, r[1:]), r[1] + r[2]).otherwise(rest), reversed(by_length), none)
    named = reduce(lambda rest, r: F.when(fits(host, path, r[1:]), r[0]).otherwise(rest), reversed(by_length), none)
    probability = vector_to_array("__probability")[1]
    by_model = F.when(probability >= block_at, "block").otherwise("allow")
    return scored.select(*(F.col(f"__key_{i}").alias(k) for i, k in enumerate(keys)), "host", "path", rule.alias("rule"),
                         F.coalesce(named, by_model).alias("verdict"), probability.alias("probability"))


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, blocked int")
