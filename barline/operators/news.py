"""Articles: parsing, dedup, matching, recency-weighted sentiment and the tone feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.config import UNDATED_HOURS
from barline.functions.text import clean_summary, company_name, label, mentions, strip, title_key, unescape

#: Companies up to this count are broadcast to the article scan.
BROADCAST_COMPANIES = 100_000

WIRE = "title string, pubDate string, displayTime string, providerPublishTime double, summary string, description string, publisher string, link string, provider struct<displayName:string>, canonicalUrl struct<url:string>, clickThroughUrl struct<url:string>"


def parse_wire(raw: DataFrame) -> DataFrame:
    """JSON items, nested under ``content`` or flat, as articles; items without a title go."""
    e = F.from_json("json", f"content struct<{','.join(p.replace(' ', ':', 1) for p in WIRE.split(', '))}>, {WIRE}")
    df = raw.withColumn("e", e)

    def pick(name: str) -> Column:
        return F.when(F.col("e.content").isNotNull(), F.col(f"e.content.{name}")).otherwise(F.col(f"e.{name}"))

    filled = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    stamp = filled(pick("pubDate"), pick("displayTime"))
    published = F.when(stamp.isNotNull(), F.unix_timestamp(F.try_to_timestamp(stamp)).cast("double")).otherwise(pick("providerPublishTime"))
    title = strip(F.coalesce(pick("title"), F.lit("")))
    return df.select(
        unescape(title).alias("title"),
        F.substring(unescape(strip(F.coalesce(filled(pick("summary"), pick("description")), F.lit("")))), 1, 300).alias("summary"),
        F.coalesce(filled(pick("canonicalUrl.url"), pick("clickThroughUrl.url"), F.col("e.link")), F.lit("")).alias("link"),
        F.coalesce(filled(pick("provider.displayName"), F.col("e.publisher")), F.lit("Wire")).alias("source"),
        F.lit("company").alias("category"),
        published.alias("published"),
    ).where("title <> ''")


def parse_feed(raw: DataFrame, k: int = 40) -> DataFrame:
    """Feed entries (feed, pos, title, summary, link, published, updated): the first ``k`` of each feed, cleaned."""
    title = strip(unescape(F.coalesce("title", F.lit(""))))
    cleaned = raw.where(F.col("pos") < k).withColumn("title", title).withColumn("summary", clean_summary(F.coalesce("summary", F.lit(""))))
    return cleaned.withColumn("published", F.coalesce("published", "updated")).where("title <> ''")


def parse_tone(raw: DataFrame) -> DataFrame:
    """Tone documents (query, json) -> (query, dt, tone): days of the first series, in order of the day."""
    doc = F.from_json("json", "timeline array<struct<series:string,data:array<struct<date:string,value:double>>>>")
    day = raw.select("query", F.explode(F.get(doc["timeline"], F.lit(0))["data"]).alias("x"))
    return day.select("query", F.to_date(F.substring("x.date", 1, 8), "yyyyMMdd").alias("dt"), F.col("x.value").alias("tone"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def newest(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest articles, undated last; the limit is the feature."""
    return df.orderBy(F.coalesce("published", F.lit(0)).desc(), "article_id").limit(k)


def dedup_titles(df: DataFrame, *order: str) -> DataFrame:
    """The first article of each title key.  Aggregated, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("a")
    return df.groupBy(title_key(F.col("title")).alias("title_key")).agg(first).select("title_key", "a.*")


def match_companies(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """(article, ticker) pairs where a title names a company, a row per article and company row.

    Title words meet the longest word of the name, or the ticker; what meets is checked by
    ``mentions``.  A name without a letter or digit isn't sought.  The join is the same at any number
    of companies; a checked small number is broadcast.
    """
    tokens = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    longest = F.array_max(F.transform(tokens(F.col("__name")), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    named = companies.select(F.col("ticker").alias("__ticker"), company_name(F.col("name")).alias("__name"))
    keys = F.array(F.struct(F.lit(True).alias("by_name"), longest.alias("w")), F.struct(F.lit(False).alias("by_name"), F.col("__ticker").alias("w")))
    keyed = named.withColumn("__k", F.explode(keys)).where("__k.w is not null")
    keyed = F.broadcast(keyed) if companies.count() <= BROADCAST_COMPANIES else keyed
    words = articles.withColumn("__w", F.explode(F.array_distinct(tokens(F.col("title")))))
    met = words.join(keyed, F.col("__w") == F.col("__k.w"))
    nothing = F.lit("")
    by_name = mentions(F.col("title"), F.col("__name"), nothing)
    by_ticker = mentions(F.col("title"), nothing, F.col("__ticker"))
    hits = met.where(F.when(F.col("__k.by_name"), by_name).otherwise(by_ticker & ~by_name))
    return hits.select(*articles.columns, F.col("__ticker").alias("ticker"))


def age_hours(now: Column) -> Column:
    """Hours since publication, at least 0; undated articles count as three days old."""
    dated = F.col("published").isNotNull() & (F.col("published") != 0)
    return F.when(dated, F.greatest((now - F.col("published")) / 3600.0, F.lit(0.0))).otherwise(UNDATED_HOURS)


def aggregate_sentiment(scored: DataFrame, now: Column, half_life: float, *keys: str) -> DataFrame:
    """Recency-weighted mean of ``sentiment``; n counts all articles, scored or not."""
    w = F.when(F.col("sentiment").isNotNull(), F.pow(F.lit(0.5), age_hours(now) / half_life))
    mean = F.try_divide(F.sum(w * F.col("sentiment")), F.sum(w))
    out = scored.groupBy(*keys).agg(F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("score"), F.count("*").alias("n"))
    return out.withColumn("label", label(F.col("score")))


def tone_feature(tone: DataFrame, fill: int = 7, smooth: int = 3, window: int = 365, scale: float = 1.5) -> DataFrame:
    """(ticker, dt, news): tanh of the z-score of the smoothed tone over a year, days up to dt only."""
    spine = tone.groupBy("ticker").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).select("ticker", F.explode(F.sequence("a", "b")).alias("dt"))
    w = Window.partitionBy("ticker").orderBy("dt")
    df = spine.join(tone, ["ticker", "dt"], "left").withColumn("f", F.last("tone", ignorenulls=True).over(w.rowsBetween(-fill, 0)))
    df = df.withColumn("s", F.avg("f").over(w.rowsBetween(-(smooth - 1), 0)))
    year = w.rowsBetween(-(window - 1), 0)
    sd = F.nullif(F.stddev_samp("s").over(year), F.lit(0.0))
    return df.select("ticker", "dt", F.tanh((F.col("s") - F.avg("s").over(year)) / sd / scale).alias("news"))
