"""Sectors of articles and organisations, by an ordered keyword lexicon.

A sector's score is the number of its keywords that occur as substrings; ties go to the lexicon's order; no keyword
gives ``unknown``. Null texts are ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import or_empty

#: (code, name, keywords) in the order of precedence; data that may be replaced.
LEXICON = [
    ("A", "agriculture", ("melk", "akkerbouw", "vee", "oogst", "glastuin", "kas")),
    ("C", "industry", ("industrie", "fabriek", "machine")),
    ("F", "construction", ("bouw", "vastgoed", "aannemer")),
    ("G", "retail", ("retail", "winkel", "handel")),
    ("H", "transport", ("logistiek", "vervoer", "vrachtwagen", "spoor")),
    ("J", "information", ("software", "data", "systemen", "netwerk", "server")),
    ("K", "finance", ("bank", "verzeker", "fraude", "miljoen euro")),
    ("O", "government", ("gemeente", "provincie", "minister", "wethouder")),
    ("Q", "health", ("zorg", "huisarts", "apotheek", "kliniek", "patiënt")),
    ("R", "culture and sport", ("museum", "orkest", "voetbal", "festival", "etappe")),
]
# Our own cues that an organisation isn't the one affected.
NOT_AFFECTED = ("volgens", "aldus", "onderzoekt", "waarschuwt", "adviseert", "meldt", "verdachte", "dader")


#: Organisations are looked for in so many characters of an article.
FIRST_CHARS = 5000


def score_columns(text: Column, lexicon=LEXICON, lowered: bool = False) -> list[Column]:
    low = text if lowered else F.lower(or_empty(text))
    return [sum((F.contains(low, F.lit(k)).cast("int") for k in ks[1:]), F.contains(low, F.lit(ks[0])).cast("int")).alias(f"s_{code}") for code, _, ks in lexicon]


def _scored(text: Column, lexicon, lowered: bool) -> Column:
    """The best of (score, order, code, name), null if none has a keyword."""
    scored = zip(score_columns(text, lexicon, lowered), lexicon)
    top = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(c).alias("code"), F.lit(n).alias("name")) for i, (s, (c, n, _)) in enumerate(scored)]))
    return F.get(F.filter(F.array(top), lambda x: x["score"] > 0), F.lit(0))


def best_sector(text: Column, lexicon=LEXICON, lowered: bool = False) -> Column:
    """(code, name, score) of the best sector. One pass over constants: no join and no row per keyword."""
    none = F.struct(F.lit(0).alias("score"), F.lit(0).alias("o"), F.lit("unknown").alias("code"), F.lit("Unknown").alias("name"))
    out = F.transform(F.array(F.coalesce(_scored(text, lexicon, lowered), none)), lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"), x["score"].alias("score")))
    return F.get(out, F.lit(0))


def organisations(text: Column, most_chars: int | None = None) -> Column:
    """Runs of capitalised words in text order, repeats kept, longer than two characters."""
    t = or_empty(text) if most_chars is None else F.substring(or_empty(text), 1, most_chars)
    runs = F.regexp_extract_all(t, F.lit(r"[A-Z][a-zà-ÿ]+(?: (?:& )?[A-Z][a-zà-ÿ]+)+"), F.lit(0))
    return F.filter(runs, lambda x: F.length(x) > 2)


def around(low: Column, name: Column, reach: int = 50) -> Column:
    """``reach`` characters of a lower-cased text on either side of the first mention of a name; '' without a mention."""
    pos = F.call_function("locate", F.lower(name), low)
    return F.when(pos > 0, F.substring(low, F.greatest(pos - reach, F.lit(1)), F.least(pos - 1, F.lit(reach)) + F.length(name) + reach)).otherwise("")


def is_affected(text: Column, name: Column, cues: tuple[str, ...] = NOT_AFFECTED, reach: int = 50) -> Column:
    """False if a cue stands within ``reach`` characters of the first mention, else true."""
    return ~around(F.lower(or_empty(text)), name, reach).rlike("|".join(cues))


def _once(df: DataFrame, key: str, *columns) -> DataFrame:
    """The columns worked out once a row: projections over a generated row aren't folded into one another, so long
    expressions aren't repeated wherever they are used."""
    return df.select(key, F.inline(F.array(F.struct(*columns))))


def article_sectors(df: DataFrame, key: str, text: Column, most: int = 10, lexicon=LEXICON, found: Column | None = None) -> DataFrame:
    """(key, primary, primary_name, sectors, companies), to be joined to the articles: each company with its sector or ``not_affected``; the primary sector is the
    most frequent one that isn't unknown, the first seen on ties; without companies it is the article's own. found: names by another recogniser."""
    names = organisations(text, FIRST_CHARS) if found is None else found
    base = _once(df, key, F.lower(or_empty(text)).alias("low"), F.slice(names, 1, most).alias("c"))
    base = _once(base, key, best_sector(F.col("low"), lexicon, lowered=True).alias("b"), "c", F.transform("c", lambda c: around(F.col("low"), c)).alias("w"))

    def company(c: Column, affected: Column) -> Column:
        code = F.when(affected, F.col("b.code")).otherwise("not_affected").alias("sector_code")
        name = F.when(affected, F.col("b.name")).otherwise("Not affected").alias("sector_name")
        return F.struct(c.alias("company_name"), code, name, affected.alias("is_victim"))

    base = _once(base, key, "b", "c", F.transform("w", lambda w: ~w.rlike("|".join(NOT_AFFECTED))).alias("a"))
    base = _once(base, key, "b", F.zip_with("c", "a", company).alias("companies"))
    codes = F.transform("companies", lambda x: x["sector_code"])
    known = F.filter(codes, lambda x: x != "unknown")
    counted = F.transform(F.array_distinct(known), lambda x: F.struct(F.size(F.filter(known, lambda y: y == x)).alias("n"), (-F.array_position(known, x)).alias("p"), x.alias("code")))
    primary = F.when(F.size("companies") == 0, F.col("b.code")).when(F.size(known) == 0, "unknown").otherwise(F.array_max(counted)["code"])
    sectors = F.when(F.size("companies") == 0, F.array("b.code")).otherwise(codes)
    named = F.create_map(*[F.lit(x) for c, n, _ in lexicon for x in (c, n)], F.lit("unknown"), F.lit("Unknown"), F.lit("not_affected"), F.lit("Not affected"))
    base = base.withColumn("primary", primary)
    return base.select(key, "primary", named[F.col("primary")].alias("primary_name"), F.array_sort(F.array_distinct(F.filter(sectors, lambda x: x != "unknown"))).alias("sectors"), "companies")


def report(sectors: DataFrame) -> DataFrame:
    """Articles per primary sector, their share in percent, and companies; an empty input gives no rows."""
    from pyspark.sql import Window

    per = sectors.groupBy("primary").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("companies")).alias("companies"))
    return per.withColumn("percent", F.round(F.col("articles") * 100.0 / F.sum("articles").over(Window.partitionBy()), 4))


def totals(sectors: DataFrame) -> DataFrame:
    """One row over all articles: how many are classified, have companies, name several sectors, and of the companies."""
    n, c = F.count(F.lit(1)), F.sum(F.size("companies"))
    known = F.sum(F.size(F.filter("companies", lambda x: x["sector_code"] != "unknown")))
    pct = lambda a, b: F.coalesce(F.round(F.try_divide(a * 100.0, b), 4), F.lit(0.0))
    classified, with_companies, multi = F.count_if(F.expr("primary <> 'unknown'")), F.count_if(F.expr("size(companies) > 0")), F.count_if(F.expr("size(sectors) > 1"))
    return sectors.agg(
        n.alias("articles"), classified.alias("classified"), pct(classified, n).alias("classified_pct"), with_companies.alias("with_companies"), F.coalesce(c, F.lit(0)).alias("companies"),
        F.coalesce(known, F.lit(0)).alias("companies_classified"), pct(known, c).alias("companies_classified_pct"), multi.alias("multi_sector"), F.coalesce(F.round(F.try_divide(c, n), 4), F.lit(0.0)).alias("mean_companies"),
    )


def samples(sectors: DataFrame, key: str, articles: int = 3, companies: int = 5, each: int = 2) -> DataFrame:
    """(kind, key, what): the first articles of several sectors, and the first classified companies, at most ``each`` of
    an article."""
    multi = sectors.where("size(sectors) > 1").orderBy(key).limit(articles).select(F.lit("article").alias("kind"), key, F.array_join("sectors", ", ").alias("what"))
    named = sectors.select(key, F.posexplode(F.slice("companies", 1, each)).alias("p", "c")).where("c.sector_code <> 'unknown'").orderBy(key, "p").limit(companies)
    return multi.unionByName(named.select(F.lit("company").alias("kind"), key, F.concat_ws(" ", "c.company_name", "c.sector_code").alias("what")))


def label(code: Column, name: Column, show_codes: bool) -> Column:
    """The name of a sector for a list of options, with its code if wanted."""
    name = F.coalesce(name, F.lit("Unclassified"))
    return F.concat(name, F.lit(" ("), code, F.lit(")")) if show_codes else name
