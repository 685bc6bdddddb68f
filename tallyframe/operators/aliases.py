"""From descriptors to merchants by aliases: resolution, batches, provisional merchants, corrections.

``aliases``: alias, merchant, match (exact, prefix, fuzzy), confidence, source (user, seed, rule, llm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import merchants, text

#: Seed merchants (subscription services first), and prefixes by which they are known.
SUBSCRIPTIONS = ["netflix", "spotify", "hulu", "disney-plus", "amazon-prime", "apple", "google", "microsoft", "dropbox", "adobe"]
SHOPS = ["amazon", "starbucks", "uber", "lyft", "costco", "target"]
PREFIXES = {
    "NETFLIX": "netflix", "SPOTIFY": "spotify", "HULU": "hulu", "DISNEY PLUS": "disney-plus", "DISNEYPLUS": "disney-plus", "AMAZON PRIME": "amazon-prime", "PRIME VIDEO": "amazon-prime",
    "APPLE": "apple", "ITUNES": "apple", "GOOGLE": "google", "MICROSOFT": "microsoft", "MSFT": "microsoft", "DROPBOX": "dropbox", "ADOBE": "adobe", "AMZN MKTP": "amazon", "AMAZON MKTPL": "amazon",
    "AMAZON COM": "amazon", "STARBUCKS": "starbucks", "UBER EATS": "uber", "UBER TRIP": "uber", "UBER": "uber", "LYFT": "lyft", "COSTCO": "costco", "TARGET": "target",
}
SOURCES, MATCHES = ["user", "seed", "rule", "llm"], ["exact", "prefix", "fuzzy"]
FUZZY = 0.72
ALIASES = "alias string, merchant string, match string, confidence double, source string"


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m, "prefix", 1.0, "seed") for k, m in PREFIXES.items()], ALIASES)


def seed_merchants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, True) for m in SUBSCRIPTIONS] + [(m, False) for m in SHOPS], "merchant string, known boolean")


def _rank(c: str, values: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), F.col(c))


def _rare(texts: DataFrame, name: str, often: DataFrame) -> DataFrame:
    """``name``, grams (all), head (those that a like text must share one of, the rarest first), gram: a row for each of the head.

    Two sets of at least FUZZY likeness share so many grams that, in any one order of all grams,
    their first ``size - ceil(FUZZY * size) + 1`` meet.
    """
    ranked = texts.withColumn("gram", F.explode("grams")).join(often, "gram").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("n", "gram")))["gram"].alias("grams"))
    size = F.size("grams")
    head = F.slice("grams", F.lit(1), size - F.ceil(size * FUZZY - 1e-9).cast("int") + 1)
    return ranked.withColumn("head", head).withColumn("gram", F.explode("head"))


def alike(keys: DataFrame, names: DataFrame) -> DataFrame:
    """key, alias, similarity of all pairs from FUZZY on: a prefix-filtered join.

    Each text is dealt out by its rarest grams only, and meets texts of fitting size there, so common
    grams make no pairs. A pair counts where its heads first meet, so none comes twice, and is compared in full there.
    """
    k = keys.select("key").distinct().withColumn("grams", text.trigrams(F.col("key")))
    a = names.select("alias").distinct().withColumn("grams", text.trigrams(F.col("alias")))
    often = k.select(F.explode("grams").alias("gram")).unionByName(a.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    x, y = _rare(k, "key", often), _rare(a, "alias", often).withColumnsRenamed({"grams": "others", "head": "first"})
    size, other = F.size("grams"), F.size("others")
    met = x.join(y, "gram").where((size >= FUZZY * other - 1e-9) & (other >= FUZZY * size - 1e-9)).where(F.element_at(F.array_intersect("head", "first"), 1) == F.col("gram"))
    shared = met.withColumn("shared", F.size(F.array_intersect("grams", "others")))
    likeness = F.when(F.col("key") == F.col("alias"), 1.0).otherwise(F.col("shared") / (size + other - F.col("shared")))
    return shared.select("key", "alias", likeness.alias("similarity")).where(F.col("similarity") >= FUZZY)


def resolved(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, merchant, match, source, similarity of each merchant key that an alias meets; the source counts before the kind of match.

    Exact aliases meet by an equi-join, prefixes by one on the key's beginnings, fuzzy ones by :func:`alike`.
    """
    k = keys.select("key").where("key <> ''").distinct()
    exact = k.join(aliases.where("match = 'exact'"), k["key"] == aliases["alias"]).withColumn("similarity", F.lit(1.0))
    heads = k.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n))))
    prefix = heads.join(aliases.where("match = 'prefix'"), F.col("head") == F.col("alias")).drop("head").withColumn("similarity", F.lit(1.0))
    near = aliases.where("match = 'fuzzy'")
    fuzzy = alike(k, near).join(near, "alias").select(*exact.columns)
    each = exact.unionByName(prefix).unionByName(fuzzy)
    order = [_rank("source", SOURCES), _rank("match", MATCHES), F.desc("similarity"), F.desc(F.length("alias")), F.desc("confidence"), "merchant"]
    best = each.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("place = 1")
    return best.select("key", "merchant", "match", "source", "similarity")


def normalized(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (raw, ...) with key, merchant, provisional, person: each distinct descriptor is worked out once."""
    each = rows.select("raw").distinct().withColumn("key", merchants.stages(F.col("raw")))
    hit = resolved(each, aliases).select("key", "merchant")
    each = each.join(hit, "key", "left").withColumn("person", merchants.to_person(F.col("raw"), list(PREFIXES)))
    each = each.withColumn("provisional", F.when(F.col("merchant").isNull() & (F.col("key") != ""), F.col("key")))
    return rows.join(each, "raw", "left")


def provisional(rows: DataFrame, known: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merchants, aliases) with a merchant, and an exact rule alias, for each provisional name not known yet; blank names give none."""
    names = rows.where("provisional is not null").select(F.col("provisional").alias("name")).distinct()
    new = names.join(known.select("name"), "name", "left_anti").withColumn("merchant", F.substring(F.sha2("name", 256), 1, 16))
    rule = new.select(F.col("name").alias("alias"), "merchant", F.lit("exact").alias("match"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("source"))
    return known.select("merchant", "name").unionByName(new.select("merchant", "name")), upserted(aliases, rule)


def upserted(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases after ``new``: of one alias and match a weaker source, or a language model, never overwrites."""
    keys = ["alias", "match"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when((F.col("fresh") == 1) & (F.col("source") == "llm"), 9).otherwise(_rank("source", SOURCES)), F.desc("fresh"), "merchant"))
    both = aliases.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    return both.withColumn("place", place).where("place = 1").select(*aliases.columns)


def user_aliases(descriptors: DataFrame, merchant: str) -> DataFrame:
    """One exact alias of the user for each distinct descriptor key that is not blank."""
    key = F.trim("key")
    return descriptors.select(key.alias("alias")).where("alias <> ''").distinct().select("alias", F.lit(merchant).alias("merchant"), F.lit("exact").alias("match"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"))


def affected(ledger: DataFrame, keys: DataFrame, ids: DataFrame) -> DataFrame:
    """normalized: the named alias keys (key) that are not blank, and the descriptors of the named rows (id); unknown ids give none."""
    named = keys.where(F.trim("key") != "").select(F.col("key").alias("normalized"))
    return named.unionByName(ledger.join(ids.select("id").distinct(), "id", "left_semi").select("normalized")).distinct()


def renormalized(ledger: DataFrame, keys: DataFrame, aliases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The ledger with all rows of the affected descriptors, transfers and excluded ones too, at the merchant their aliases name now.

    Each descriptor is worked out anew from one raw text of its rows, the latest (of one date that of
    the least id); where no alias meets it, its rows stay as they are, as do rows without a descriptor.
    """
    hit = affected(ledger, keys, ledger.select("id").limit(0) if ids is None else ids)
    age = -F.datediff("date", F.lit("1970-01-01").cast("date"))
    sample = ledger.join(hit, "normalized", "left_semi").groupBy("normalized").agg(F.min(F.struct(age.alias("age"), "id", "raw")).alias("s"))
    sample = sample.select("normalized", merchants.stages(F.col("s.raw")).alias("key"))
    now = sample.join(resolved(sample, aliases).select("key", F.col("merchant").alias("now")), "key").select("normalized", "now")
    out = ledger.join(now, "normalized", "left")
    return out.withColumn("merchant", F.coalesce("now", "merchant")).select(*ledger.columns)
