"""URL filtering: host and path rules, and for the rest a logistic regression on hashed character n-grams of host and path.

The model is fitted inside one SQL expression: gradient descent on the dual coefficients of the labelled table, whose kernel is the cosine of
the n-gram sets; it then becomes one weight per hash bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: (action, host, path): a rule fits the host, its subdomains and paths that start so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled rows used at most; hash buckets; n-gram length; descent steps, rate and ridge.
MOST_LABELLED, BUCKETS, GRAM, STEPS, RATE, RIDGE = 512, 4096, 3, 150, 0.3, 0.003
#: The labelled table: 1 is unwanted.
LABELLED = (
    ("http://casino-bonus.example/win-jackpot", 1),
    ("http://free-casino.example/slots/bonus", 1),
    ("http://poker-bets.example/jackpot", 1),
    ("http://sports-betting.example/odds/bet-now", 1),
    ("http://xxx-videos.example/adult/hot", 1),
    ("http://adult-cams.example/live-sex", 1),
    ("http://sexy-dating.example/xxx/singles", 1),
    ("http://cheap-pills.example/viagra/buy", 1),
    ("http://viagra-shop.example/order-pills", 1),
    ("http://replica-watches.example/cheap/buy-now", 1),
    ("http://free-download-crack.example/keygen.exe", 1),
    ("http://warez-torrent.example/download/crack", 1),
    ("http://torrent-movies.example/free-download", 1),
    ("http://secure-login-verify.example/account/update-password", 1),
    ("http://verify-account.example/login.php?confirm", 1),
    ("http://paypa1-secure.example/signin/verify", 1),
    ("http://earn-money-fast.example/crypto-profit", 1),
    ("http://crypto-giveaway.example/double-your-coins", 1),
    ("http://clickbait-ads.example/popunder/track", 1),
    ("http://ads.tracker.example/click?adid=1", 1),
    ("http://payday-loans.example/instant-cash", 1),
    ("http://lottery-winner.example/claim-prize", 1),
    ("http://weight-loss-miracle.example/diet-pills", 1),
    ("http://hot-singles.example/chat-now", 1),
    ("http://news.example/world/2021/05/story.html", 0),
    ("http://www.university.example/research/papers", 0),
    ("http://library.example/catalogue/books/123", 0),
    ("http://docs.example/reference/manual.html", 0),
    ("http://wiki.example/en/article", 0),
    ("http://blog.example/de/5099#top", 0),
    ("http://m.weather.example/en/forecast", 0),
    ("http://museum.example/fr/exhibitions", 0),
    ("http://school.example/es/courses/maths", 0),
    ("http://health.example/advice/nutrition", 0),
    ("http://government.example/en/services/12345", 0),
    ("http://journal.example/article/10417.html", 0),
    ("http://forum.example/thread/33120?page=2", 0),
    ("http://recipes.example/en/soup/7198", 0),
    ("http://travel.example/fr/guide/25930", 0),
    ("http://science.example/physics/lecture-notes", 0),
    ("http://history.example/de/archive/12440", 0),
    ("http://opensource.example/project/readme", 0),
    ("http://m.garden.example/en/9897/", 0),
    ("http://www.theatre.example/de/39547.html", 0),
    ("http://blog.nature.example/en/28653?utm_source=feed", 0),
    ("http://encyclopedia.example/en/20117", 0),
    ("http://shop.example/books/es/26123", 0),
    ("http://help.example/support/en/faq", 0),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without `://`; a host ends at `/`, `?` or `#`, a path at `?` or `#`."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the n-grams of host and path, each text marked at its ends; work is linear in the length."""

    def grams(kind: str, text: Column) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - GRAM + 1)),
            lambda i: F.pmod(F.xxhash64(F.lit(kind), F.array_join(F.slice(chars, i, GRAM), "")), F.lit(BUCKETS)).cast("int"),
        )

    return F.array_distinct(F.concat(grams("host", host), grams("path", path)))


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*LABELLED], "url string, label int")


def fitted(examples: DataFrame) -> DataFrame:
    """One row, bounded by BUCKETS: bias and weights (one per bucket) from rows of (url, label); of these the first MOST_LABELLED by hash are used."""
    host, path = host_path(F.col("url"))
    rows = examples.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED)
    rows = rows.select(buckets(host, path).alias("g"), F.col("label").cast("double").alias("y"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("g", "y"))).alias("e"))
    one = one.withColumn(
        "k", F.transform("e", lambda a: F.transform("e", lambda b: 1 + F.size(F.array_intersect(a["g"], b["g"])) / F.sqrt(F.size(a["g"]) * F.size(b["g"]))))
    )
    one = saved(one, "url-kernel")  # else each descent step would make the kernel anew
    margin = lambda al, i: F.aggregate(F.zip_with(F.get("k", i), al, lambda k, a: k * a), F.lit(0.0), lambda s, x: s + x)
    step = lambda al, _: F.transform(
        al, lambda a, i: a - RATE * (1 / (1 + F.exp(-margin(al, i))) - F.get("e", i)["y"] + RIDGE * a)
    )
    zeros = F.transform("e", lambda _: F.lit(0.0))
    one = saved(one.select("e", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zeros, step).alias("al")), "url-coefficients")
    terms = one.select(F.inline(F.arrays_zip("e", "al"))).select("al", F.explode("e.g").alias("b"), F.size("e.g").alias("n"))
    weights = terms.groupBy("b").agg(F.sum(F.col("al") / F.sqrt("n")).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    model = weights.select(
        one.select(F.aggregate("al", F.lit(0.0), lambda s, x: s + x)).scalar().alias("bias"),
        F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("weights"),
    )
    return saved(model, "url-model")


def judge(pages: DataFrame, rules: tuple = RULES, examples: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null where none fits), verdict, score (of the model: 1 is unwanted).

    The longest fitting rule decides (by its text, then by the order given), else the model: block at a score of 0.5 or more.  Null urls have empty host
    and path.  Other columns than page_id and url aren't read.
    """
    model = fitted(labelled(pages.sparkSession) if examples is None else examples)
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    rows = rows.withColumn("_g", buckets(F.col("host"), F.col("path")))
    weights, bias = model.select("weights").scalar(), model.select("bias").scalar()
    rows = rows.withColumn("_w", weights).withColumn("_b", bias)
    margin = F.col("_b") + F.aggregate("_g", F.lit(0.0), lambda s, i: s + F.get("_w", i)) / F.sqrt(F.size("_g"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-margin)))
    none = F.lit(None).cast("string")
    return rows.select(
        "page_id",
        "host",
        "path",
        (none if rule is None else rule).alias("rule"),
        F.coalesce(none if verdict is None else verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
