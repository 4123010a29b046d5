"""URL verdicts: host and path rules first, then a logistic regression on character n-grams.

The model's features are hashed n-grams of the host and of the path, each with
marks at its ends and digits as zeros, so unseen hosts are judged by what they
are made of. It learns from a small labelled table of URLs. Rules and scoring
are one pass of projections without a shuffle or Python on the executors.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; a port or user in it stays part of it. Path: from there up to ``?``,
``#`` or the end. Defined results: null URLs and URLs without ``://`` have an
empty host and path, fit no rule and get the model's verdict on nothing (its
intercept); long URLs take time in proportion to their length; repeated rows
keep a row each; an empty input gives an empty output. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host and path of the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Lengths of n-grams of host and path, and slots they are hashed to.
HOST_GRAMS, PATH_GRAMS, SLOTS = (3, 4), (3,), 1 << 16
#: Chosen by tenfold cross-validation on the labelled table.
REGULARISATION, ITERATIONS = 1e-5, 200
#: Weight of an allowed row against a blocked one: fewer of the web's URLs are to be blocked than of the table's.
ALLOWED_WEIGHT = 2.0

#: The labelled table, made-up addresses of sites to block (gambling, adult, pills, link farms, trackers, fraud, stolen software) ...
BLOCKED = """
https://online-casino-bonus.example/play http://www.casinoroyal.test/slots/jackpot https://vegas-casino.example.net/de/12 http://m.casino-spin.example.org/bonus.html https://goldcasino.top/register?aff=9
https://poker-stars-win.example/tables http://pokerroom.test/en/77 https://slots-jackpot.example.com/free-spins http://big-win-slots.xyz/ https://winbig-roulette.example.net/live
https://sports-bets.example/odds http://www.bet-now.test/en/9 https://freebet-offers.example.org/signup http://betting-tips.example.com/vip https://livebets.top/football
https://lotto-win.example/claim http://jackpot-winner.test/prize.html https://adult-videos.example/watch http://www.xxx-cams.test/live https://hot-adult-dating.example.net/join
http://adultchat.example.org/en/18 https://sexy-cams.example.com/models http://porn-tube.test/video/55 https://nude-pics.xyz/gallery http://m.adult-stream.example/fr/4
https://escort-dates.example/city http://xrated-movies.test/ https://cheap-viagra.example/buy http://pills-online.test/order https://discount-pills.example.net/no-prescription
http://www.cheapmeds.example.org/en/31 https://rx-pharmacy-cheap.example.com/cart http://diet-pills.xyz/offer https://buy-cialis.test/ https://weight-loss-pills.example/miracle
http://cheap-replica-watches.test/rolex https://cheap-handbags.example/outlet http://replica-bags.example.net/sale https://spam-links.example/page9 http://link-farm.test/seo/backlinks
https://seo-spam.example.org/en/40 http://spammy-directory.example.com/list https://buy-backlinks.xyz/pack http://article-farm.test/spin https://content-farm.example.net/es/8
http://www.linkspam.example/index.html https://guest-post-farm.test/ https://ads-server.example/click http://adserver.test/banner.js https://track-clicks.example.net/pixel.gif
http://tracker.example.org/collect?id=4 https://click-track.example.com/redirect http://popup-ads.xyz/go https://adtracking.test/imp http://m.ads-network.example/en/3
https://banner-ads.example.org/serve http://pixel-tracker.test/t.gif https://retarget-ads.example.com/sync https://free-iphone-winner.example/claim http://claim-your-prize.test/now
https://secure-login-verify.example.net/account/update http://paypa1-verify.test/signin https://bank-account-verify.xyz/login.php http://free-gift-cards.example/survey
https://bitcoin-doubler.test/invest http://crypto-giveaway.example.org/free https://get-rich-quick.example.com/start http://free-money.test/win https://work-home-cash.xyz/join
http://payday-loans-fast.example/apply https://instant-loan-cash.test/ http://cracked-software.example.net/download https://free-keygen.test/serial http://warez-zone.example.org/full
https://www.spam-sites.example.com/en/301 http://blog.cheap-tablets-pills.example.net/fr/88/ https://www.cheap-deals-pills.example.com/de/5.html https://blog.adult-forum.example.net/en/1200?utm_source=feed
http://www.xxx-adult.example.com/es/9#top https://m.free-casino.example.org/en/73 https://blog.win-casino.example.net/en/64.html http://www.best-bets.example.com/fr/410?page=2&ref=x https://m.free-betting.example.net/en/2
https://www.ads-click.example.com/en/8001 http://blog.track-ads.example.net/de/17#top https://www.farm-of-links.example.com/en/45/ http://blog.spamblog.example.com/en/516 https://m.pills-shop.example.net/es/20
https://torrent-movies.xyz/hd http://free-download-crack.example.com/setup.exe https://serial-keys.test/activate http://hacked-games.example/mod https://virus-scan-alert.test/fix
""".split()
#: ... and to let through.
ALLOWED = """
https://www.riverton-library.example/catalogue https://blog.gardenpath.example.com/en/482 http://news.harbourpost.example.net/2021/05/harvest https://docs.tablewright.test/guide/install.html
https://en.openpedia.example.org/wiki/Steam_engine https://m.dailyherald.example.com/fr/901 https://www.stonebridge.example.net/de/77 http://forum.woodworkers.test/thread/1203
https://mathdept.university.example/courses/algebra https://www.townhall.example.org/services/permits http://museum.oldport.example/exhibits https://recipes.kitchenhand.example.com/soup/leek
https://www.mountainweather.test/forecast/today http://blog.linguist.example.net/es/31 https://science.journal.example.org/articles/553 https://www.railways.example/timetable
https://schools.northshire.example/primary/enrol http://www.birdwatch.test/species/heron https://code.quietforge.example.com/projects/parser https://www.cityorchestra.example.net/season
http://history.archive.example.org/en/1911 https://www.farmersmarket.example/stalls https://health.clinic.example/appointments http://m.weeklyreview.example.com/en/65?page=2
https://travel.islands.example.net/ferries https://www.chessclub.test/results https://opendata.ministry.example.org/datasets/12 http://www.bookshop.example/authors/a
https://blog.theatre.example.com/en/2044?utm_source=feed https://www.thornbury.example.net/fr/36 http://press.institute.example.org/releases/8 https://www.physics.example/lectures/optics
https://podcast.evening.example.com/episodes/19 http://cycling.routes.test/map https://www.architecture.example.net/houses https://lab.chemistry.example.org/en/730#top
https://www.communitygarden.example/volunteer http://blog.seamstress.example.com/patterns https://philosophy.reader.example.net/essays/9 https://www.fireservice.example/safety
https://parliament.example.org/debates/2019 http://www.astronomy.test/planets https://music.school.example.com/lessons/violin https://www.bakery.example.net/bread
https://knowledge.support.example/articles/44 http://shop.pottery.example.com/vases https://www.seaside.example.org/en/27 https://blog.runningnotes.example.net/de/518.html
http://poetry.corner.example/poems https://www.theweaver.example.com/es/300/ https://m.tinsmith.example.net/en/12 http://www.anthology.example.org/fr/91#top
https://handbook.engineers.example/bridges https://www.hospital.example.org/wards http://blog.montane.example.com/hikes/4 https://economics.notes.example.net/en/888?page=2&ref=x
https://www.courthouse.example/records https://translations.example.org/en/5 http://wiki.networking.test/routing https://www.thistle.example.net/en/640
https://blog.eastern.example.com/en/23?utm_source=feed http://m.shoreline.example.org/de/14.html https://www.tonality.example.com/en/3307 https://heron.example.net/es/85
http://blog.antonin.example.org/en/77/ https://www.redwing.example.com/fr/2210?page=2&ref=x https://inland.example.net/en/9001#top http://www.orient.example.com/de/3
https://station.example.org/en/404.html https://m.thatcher.example.net/fr/18 http://blog.nation.example.com/en/666 https://www.esther.example.org/es/1290
https://theorem.example.net/de/58 http://m.andover.example.com/en/71?utm_source=feed https://www.relation.example.net/en/4 https://blog.ingot.example.org/fr/333
""".split()


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """rule and verdict of the longest rule that fits, as a struct; null without one.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Of equally long rules one that blocks goes first.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = F.endswith(F.concat(F.lit("."), host), F.lit(f".{at}")) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column, mark: str, lengths: tuple[int, ...]) -> list[Column]:
    """Overlapping n-grams by a look-ahead at every place, each with its part's mark."""
    framed = F.regexp_replace(text, "[0-9]+", "0")
    return [F.transform(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g)) for n in lengths]


def _with_grams(df: DataFrame) -> DataFrame:
    """``df`` with the n-grams of its columns host and path."""
    # Words of a host end at a hyphen as they do at a dot.
    host = F.concat(F.lit("."), F.translate("host", "-", "."), F.lit("."))
    path = F.concat(F.lit("^"), F.col("path"), F.lit("$"))
    return df.withColumn("grams", F.concat(*_grams(host, "h", HOST_GRAMS), *_grams(path, "p", PATH_GRAMS)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url and blocked (0 or 1)."""
    return spark.createDataFrame([*((u, 1) for u in BLOCKED), *((u, 0) for u in ALLOWED)], "url string, blocked int")


def train(labelled: DataFrame) -> PipelineModel:
    """The model for ``labelled`` (url, blocked), a small table: it is learned in one partition. Needs both labels."""
    rows = labelled.filter("blocked in (0, 1)").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label"), F.when(F.col("blocked") == 1, 1.0).otherwise(ALLOWED_WEIGHT).alias("weight"))
    hashing, unit = HashingTF(inputCol="grams", outputCol="counts", numFeatures=SLOTS, binary=True), Normalizer(inputCol="counts", outputCol="features")
    machine = LogisticRegression(maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False, weightCol="weight")
    fitted = machine.fit(unit.transform(hashing.transform(_with_grams(rows.coalesce(1)))))
    return PipelineModel([hashing, unit, fitted])


def score_urls(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` (host, path) with ``score``, the probability that a URL is to be blocked."""
    scored = model.transform(_with_grams(df)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*df.columns, "score")


def url_filter(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = score_urls(rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)), model)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "score")
