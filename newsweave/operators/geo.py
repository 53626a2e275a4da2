"""Places: gazetteer, mentions, country vote, narrowing by context, boxes, missing coordinates.

Texts and places may be null or empty: they mention nothing. Equal names in several gazetteers go to the highest
priority, ties to the smallest country code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import collapse, or_empty, place_key


def build_gazetteer(raw: DataFrame, countries: list[str], classes: tuple[str, ...] = ("P", "A")) -> DataFrame:
    """(name, country) from rows (name, alternates, feature_class, country, priority): main names of Latin letters,
    alternates of three letters or more with a vowel, lower-cased; the highest priority wins."""
    kept = raw.where(F.col("country").isin(*countries) & F.col("feature_class").isin(*classes))
    latin = r"^[A-Za-zÀ-ÖØ-öø-ÿ' .-]+$"
    kept = kept.withColumn("name", collapse(F.col("name")))
    main = kept.where(F.col("name").rlike(latin)).select(F.lower("name").alias("name"), "country", "priority")
    alt = kept.select(F.explode(F.transform(F.split(or_empty(F.col("alternates")), ","), collapse)).alias("name"), "country", "priority")
    alt = alt.where(F.col("name").rlike(latin) & (F.length("name") >= 3) & F.lower("name").rlike("[aeiouy]")).select(F.lower("name").alias("name"), "country", "priority")
    both = main.unionAll(alt)
    best = both.groupBy("name").agg(F.min(F.struct((-F.col("priority")).alias("p"), "country")).alias("b"))
    return best.select("name", F.col("b.country").alias("country"))


def mentions(df: DataFrame, key: str, text: Column, gazetteer: DataFrame, name: str = "name", longest: int = 1) -> DataFrame:
    """(key, pos, place): capitalised runs of up to ``longest`` tokens that the gazetteer knows; the longest run at a
    position stays. The gazetteer joins on the name; Spark broadcasts it while it is small."""
    words = F.regexp_extract_all(or_empty(text), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ'-]+"), F.lit(0))
    toks = df.select(key, words.alias("ws"))
    grams = []
    for n in range(1, longest + 1):
        at = toks.where(F.size("ws") >= n).select(key, F.explode(F.sequence(F.lit(1), F.size("ws") - (n - 1))).alias("pos"), "ws")
        grams.append(at.select(key, "pos", F.lit(n).alias("n"), F.array_join(F.slice("ws", F.col("pos"), n), " ").alias("surface")))
    g = grams[0]
    for x in grams[1:]:
        g = g.unionAll(x)
    g = g.where(F.col("surface").rlike("^[A-ZÀ-ÖØ-Þ]")).withColumn(name, F.lower("surface"))
    hit = g.join(gazetteer.select(name).distinct(), name, "left_semi")
    best = hit.groupBy(key, "pos").agg(F.max(F.struct("n", "surface")).alias("m"))
    return best.select(key, "pos", F.col("m.surface").alias("place"))


def country_vote(found: DataFrame, key: str, gazetteer: DataFrame, countries: list[str], least: float = 0.6, docs: DataFrame | None = None) -> DataFrame:
    """(key, country, score, evidence): the share of the winner, ties in the order of ``countries``; under ``least`` the
    country is 'uncertain'. evidence: (place, country) of the mentions that voted, in text order. docs: the documents
    (key) that shall have a row even if nothing was found: uncertain, 0, no evidence."""
    g = gazetteer.select(F.col("name").alias("_n"), "country")
    j = found.withColumn("_n", F.lower("place")).join(g, "_n").where(F.col("country").isin(*countries))
    named = F.transform(F.array_sort(F.collect_list(F.struct("pos", "place", "country"))), lambda x: F.struct(x["place"].alias("place"), x["country"].alias("country")))
    per = j.groupBy(key).agg(*[F.count_if(F.col("country") == c).alias(f"n_{c}") for c in countries], named.alias("evidence"))
    total = sum((F.col(f"n_{c}") for c in countries[1:]), F.col(f"n_{countries[0]}"))
    top = F.greatest(*[F.col(f"n_{c}") for c in countries]) if len(countries) > 1 else F.col(f"n_{countries[0]}")
    winner = F.coalesce(*[F.when(F.col(f"n_{c}") == top, F.lit(c)) for c in countries])
    score = F.round(F.try_divide(top, total), 6)
    voted = per.select(key, F.when(score < least, "uncertain").otherwise(winner).alias("country"), score.alias("score"), "evidence")
    if docs is None:
        return voted
    none = F.array().cast("array<struct<place:string,country:string>>")
    out = docs.select(key).join(voted, key, "left")
    return out.select(key, F.coalesce("country", F.lit("uncertain")).alias("country"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("evidence", none).alias("evidence"))


def by_country(voted: DataFrame, wanted: list[str], least: float = 0.6) -> DataFrame:
    """The documents of the wanted countries that reach the score."""
    return voted.where(F.col("country").isin(*wanted) & (F.col("score") >= least))


def narrow(df: DataFrame, key: str, text: str, places: DataFrame, context: list[str]) -> DataFrame:
    """(key, place): of the places of a document (key, place) the one nearest to a context word, the earliest on ties.
    Documents without a context word or a placed mention keep all their places."""
    words = "|".join(sorted(context))
    low = F.lower(or_empty(F.col(text)))
    # offsets of whole context words: lengths of the pieces between them
    piece = F.split(low, rf"(?<![a-z])(?:{words})(?![a-z])", -1)
    hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z])(?:{words})(?![a-z])"), F.lit(0))
    doc = df.select(key, low.alias("low"), piece.alias("piece"), hits.alias("hits"))
    run = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.get("piece", i)) + F.length(F.get("hits", i))).cast("int").alias("at"),
            F.concat(a["out"], F.array((a["at"] + F.length(F.get("piece", i))).cast("int"))).alias("out"),
        ),
    )
    doc = doc.withColumn("ctx", F.when(F.size("hits") > 0, run["out"]).otherwise(F.array().cast("array<int>")))
    p = places.select(F.col(key).alias("_k"), "place").distinct()
    j = doc.join(p, doc[key] == p["_k"])
    parts = F.split(F.col("low"), F.concat(F.lit("\\Q"), F.lower("place"), F.lit("\\E")), -1)
    offs = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x) + F.length("place")).cast("int").alias("at"), F.concat(a["out"], F.array((a["at"] + F.length(x)).cast("int"))).alias("out")),
    )["out"]
    j = j.withColumn("offs", offs)
    near = F.array_min(F.flatten(F.transform("offs", lambda o: F.transform("ctx", lambda c: F.struct(F.abs(o - c).alias("d"), o.alias("o"))))))
    j = j.withColumn("near", near)
    best = j.where("near is not null").groupBy(key).agg(F.min(F.struct("near", "place")).alias("b")).select(F.col(key).alias("_b"), F.col("b.place").alias("best"))
    out = j.join(best, j[key] == best["_b"], "left")
    return out.where(F.col("best").isNull() | (F.col("best") == F.col("place"))).select(key, "place")


def in_boxes(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """Inside any (south, west, north, east), edges included."""
    out = F.lit(False)
    for s, w, n, e in boxes:
        out |= lat.between(s, n) & lon.between(w, e)
    return F.coalesce(out, F.lit(False))


def narrowing_stats(docs: DataFrame, key: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """(total, narrowed, unchanged, none, ratio) of documents (key) by their places (key, place) before and after."""
    count = lambda x, c: x.select(key, "place").distinct().groupBy(key).agg(F.count(F.lit(1)).alias(c))
    j = docs.select(key).join(count(before, "b"), key, "left").join(count(after, "a"), key, "left").fillna(0, ["a", "b"])
    out = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("b > 1 and a = 1")).alias("narrowed"), F.count_if(F.expr("b = a")).alias("unchanged"), F.count_if(F.expr("b = 0")).alias("none"))
    return out.withColumn("ratio", F.round(F.col("narrowed") / F.greatest("total", F.lit(1)), 6))


def _located(places: DataFrame, cache: DataFrame) -> DataFrame:
    c = cache.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(place_key(F.col("place")).alias("_k"), "lat", "lon")
    c = c.groupBy("_k").agg(F.min(F.struct("lat", "lon")).alias("c"))
    return places.withColumn("_k", place_key(F.col("place"))).join(c, "_k")


def first_located(places: DataFrame, key: str, cache: DataFrame, boxes: list, carried: DataFrame | None = None) -> DataFrame:
    """(key, place, lat, lon): the first place (by pos) with coordinates inside a box, and the other columns of carried
    (key, ...): the title, address, sector, source and date of the article, for instance."""
    j = _located(places, cache).where(in_boxes(F.col("c.lat"), F.col("c.lon"), boxes))
    first = j.groupBy(key).agg(F.min(F.struct("pos", "place", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))).alias("m"))
    out = first.select(key, "m.place", "m.lat", "m.lon")
    return out if carried is None else out.join(carried, key)


def map_funnel(docs: DataFrame, key: str, places: DataFrame, cache: DataFrame, boxes: list) -> DataFrame:
    """One row: documents, with places, without, with a place whose coordinates are known, with one in a box, plotted."""
    some = places.select(key).distinct().withColumn("_p", F.lit(1))
    known = _located(places, cache).groupBy(key).agg(F.max(in_boxes(F.col("c.lat"), F.col("c.lon"), boxes).cast("int")).alias("_in"))
    j = docs.select(key).join(some, key, "left").join(known, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("rows"), F.count("_p").alias("with_places"), F.count_if(F.col("_p").isNull()).alias("empty"),
        F.count("_in").alias("any_cached"), F.count_if(F.expr("_in = 1")).alias("in_box"), F.count_if(F.expr("_in = 1")).alias("plotted"),
    )


def missing_places(places: DataFrame, cache: DataFrame, skip: list[str], least: int = 3) -> DataFrame:
    """Distinct normalised places that the cache doesn't know."""
    p = places.select(place_key(F.col("place")).alias("place")).distinct()
    p = p.where((F.length("place") >= least) & ~F.col("place").isin(*skip))
    return p.join(cache.select(place_key(F.col("place")).alias("place")).distinct(), "place", "left_anti")
