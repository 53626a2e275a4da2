"""All queries of the core; their SQL is in ``newsweave.plans.oracle``. Each runs over whole tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweave.functions import compounds, dates, text
from newsweave.operators import classifier, geo, ingest, keywords, presets, sector, similarity, timestamps, weak
from newsweave.operators.search import FilterSpec, matches
from newsweave.plans import oracle
from newsweave.session import spread, table, written

BOXES = [(50.7, 5.0, 51.8, 6.3), (52.2, 6.0, 53.3, 7.1), (51.2, 3.3, 51.8, 4.3)]
FOCUS = ["inbraak", "droogte", "ransomware", "griepgolf", "faillissement"]


def _articles(spark, d):
    return table(spark, d, "nos_articles")


# --- sources, ids, dates, merge -------------------------------------------------------------------------------------


def url_canonical_id(spark, d):
    return ingest.with_ids(_articles(spark, d)).select("row_id", "canonical_url", "id")


def url_dedup_first(spark, d):
    rows = ingest.with_ids(ingest.with_url(_articles(spark, d))).select("id", "feed_key", "row_id")
    return ingest.first_seen(rows, "id", ["feed_key", "row_id"])


def url_anti_seen(spark, d):
    rows = ingest.with_ids(ingest.with_url(table(spark, d, "merge_batch"))).select("row_id", "id")
    return ingest.unseen(rows, table(spark, d, "cache_single"))


def rows_without_url(spark, d):
    none = F.trim(F.coalesce("url", F.lit(""))) == ""
    return _articles(spark, d).groupBy("feed_key").agg(F.count_if(none).alias("without_url"), F.count(F.lit(1)).alias("n"))


#: Rules of the test feeds, in order.
FEED_RULES = [("starts", "beekdal dagblad", "Beekdal Dagblad"), ("starts", "l3", "L3"), ("has", "omroep", "Omroep"), ("has", "koerier", "Koerier")]


def feed_alias(spark, d):
    """Without compatibility forms, which SQL hasn't; feed_alias_fuzzy has them."""
    named = ingest.fuzzy_feed(F.col("feed"), FEED_RULES, compat=False)
    return _articles(spark, d).groupBy("feed_key", named.alias("alias")).agg(F.count(F.lit(1)).alias("n"))


def feed_alias_fuzzy(spark, d):
    named = ingest.fuzzy_feed(F.col("feed"), FEED_RULES)
    return _articles(spark, d).groupBy("feed_key", named.alias("alias")).agg(F.count(F.lit(1)).alias("n"))


def feed_alias_exact(spark, d):
    """By an alias table: each spelling stands for the most frequent one of its feed."""
    per = _articles(spark, d).where("feed is not null").groupBy("feed_key", F.trim("feed").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("feed_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "alias"))["alias"].alias("canonical"))
    aliases = per.where("n > 1").join(best, "feed_key").select("alias", "canonical")
    return ingest.canonical_feed(_articles(spark, d).select("row_id", "feed"), aliases).select("row_id", "canonical")


def rfc822_parse(spark, d):
    rows = _articles(spark, d).where(F.col("published").rlike("^[A-Z][a-z]{2}, [0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} (GMT|[+-][0-9]{4})$"))
    return rows.select("row_id", F.unix_timestamp(dates.rfc822(F.col("published"))).alias("epoch"), F.unix_timestamp(dates.rfc822(F.col("published"), strict=True)).alias("epoch_strict"))


def iso_z_format(spark, d):
    return table(spark, d, "documents").select("doc_id", dates.iso_z(F.col("published_at").cast("timestamp")).alias("iso"))


def cursor_overlap_filter(spark, d):
    ts = F.try_to_timestamp("published_ts")
    kept = ingest.within_overlap(table(spark, d, "cache_single"), table(spark, d, "rss_state"), "feed_key", ts, F.try_to_timestamp("last_published_ts"))
    return kept.select("id", "feed_key")


def cursor_state_update(spark, d):
    state = table(spark, d, "rss_state").select("feed_key", F.try_to_timestamp("last_published_ts").alias("cursor"))
    kept = table(spark, d, "cache_single").withColumn("ts", F.try_to_timestamp("published_ts"))
    new = ingest.next_state(state, kept, "feed_key", F.col("ts"))
    return new.select("feed_key", F.unix_timestamp("cursor").alias("cursor"), "added")


def merge_counters(spark, d):
    """Per source: rows added, seen before (in history or earlier in the batch), and too old."""
    seen = table(spark, d, "cache_single").select("id").distinct().withColumn("old_id", F.lit(1))
    cur = table(spark, d, "rss_state").select("feed_key", F.try_to_timestamp("last_published_ts").alias("cursor"))
    b = ingest.with_ids(ingest.with_url(table(spark, d, "merge_batch"))).select("feed_key", "id", "batch_no", "pos", "row_id", dates.rfc822(F.col("published")).alias("ts"))
    first = b.groupBy("id").agg(F.min(F.struct("batch_no", "pos", "row_id")).alias("f"))
    j = b.join(first, "id").join(seen, "id", "left").join(cur, "feed_key", "left")
    dup = F.col("old_id").isNotNull() | (F.col("f.row_id") != F.col("row_id"))
    late = F.coalesce(F.col("ts") < F.col("cursor") - F.expr("interval 24 hours"), F.lit(False))
    return j.groupBy("feed_key").agg(F.count_if(~dup & ~late).alias("added"), F.count_if(dup).alias("dup"), F.count_if(~dup & late).alias("old"))


def url_keyed_merge(spark, d):
    new = table(spark, d, "merge_batch").select("url", "title", "row_id")
    old = table(spark, d, "cache_single").select("url", "title")
    firsts = new.groupBy("url").agg(F.min(F.struct("row_id", "title")).alias("m")).select("url", "m.title", F.lit("new").alias("side"))
    olds = old.groupBy("url").agg(F.min("title").alias("title")).select("url", "title", F.lit("old").alias("side"))
    return ingest.keyed_union(firsts, olds, "url").select("url", "side", "title")


def raw_url_dedup(spark, d):
    return _articles(spark, d).where("url is not null").groupBy("url").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def result_cache_split(spark, d):
    b = ingest.with_ids(table(spark, d, "merge_batch")).select("row_id", "id")
    cache = table(spark, d, "cache_single").select("id", F.lit("cached").alias("state"))
    both = ingest.enrich_missing(b, cache, lambda x: x.select("id", F.lit("enriched").alias("state")))
    return both.select("id", "state").distinct()


def source_type_default(spark, d):
    return table(spark, d, "cache_single").groupBy(F.coalesce("source_type", F.lit("rss")).alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


def head_per_source(spark, d):
    w = Window.partitionBy("feed_key").orderBy("row_id")
    return _articles(spark, d).select("feed_key", "row_id", F.row_number().over(w).alias("n")).where("n <= 30")


def latest_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("since"), F.count(F.lit(1)).alias("n"))


def union_distinct(spark, d):
    a = _articles(spark, d).select("feed_key", "url", "title")
    return a.unionByName(table(spark, d, "merge_batch").select("feed_key", "url", "title")).distinct()


def run_state(spark, d):
    """Cursor, count, run time and file of every feed after a run over the accepted articles."""
    state = table(spark, d, "rss_state").select("feed_key", F.try_to_timestamp("last_published_ts").alias("cursor"), "last_file")
    kept = table(spark, d, "cache_single").withColumn("ts", F.try_to_timestamp("published_ts"))
    files = kept.select("feed_key", F.concat("feed_key", F.lit(".json")).alias("last_file"))
    out = ingest.run_state(state, kept, "feed_key", F.col("ts"), F.lit("2026-01-31 12:00:00").cast("timestamp"), files)
    return out.select("feed_key", F.unix_timestamp("cursor").alias("cursor"), "added", dates.iso_z(F.col("last_run_ts")).alias("last_run_ts"), "last_file")


def seen_ids(spark, d):
    return ingest.seen_ids(table(spark, d, "cache_single"))


# --- text -----------------------------------------------------------------------------------------------------------


def raw_text_choice(spark, d):
    t = text.raw_text(F.col("full_text"), F.col("title"), F.col("summary"))
    return _articles(spark, d).select("row_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


def whitespace_tokens(spark, d):
    t = text.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.size(text.tokens(F.col("text"))).alias("tokens"))


def token_clean(spark, d):
    return table(spark, d, "cache_single").select("id", F.md5(text.token_clean(F.col("title"))).alias("digest"))


def token_clean_compat(spark, d):
    """With compatibility forms, which SQL hasn't."""
    return table(spark, d, "cache_single").select("id", text.token_clean(F.concat_ws(" ", "title", "summary", "full_text"), compat=True).alias("clean"))


def geo_clean(spark, d):
    t = text.raw_text(F.col("full_text"), F.col("title"), F.col("summary"))
    return _articles(spark, d).select("row_id", text.geo_clean(t).alias("clean"))


def hashtag_split(spark, d):
    """The first three words of each title as one hashtag, split again by the costs of the corpus's words."""
    words = text.word_tokens(F.col("text"))
    counts = table(spark, d, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    tag = F.concat(F.lit("#"), F.array_join(F.slice(text.word_tokens(F.col("title"), 2), 1, 3), ""))
    a = _articles(spark, d).select("row_id", tag.alias("tag"))
    return a.select("row_id", "tag", F.array_join(compounds.split_compound(F.col("tag"), compounds.word_costs(counts), a), " ").alias("words"))


def ngram_counts(spark, d):
    g = text.ngrams(text.word_tokens(F.col("title")), 1, 3)
    return _articles(spark, d).select(F.explode(g).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def stopword_removal(spark, d):
    kept = text.without_stopwords(text.word_tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("words"), F.size(kept).alias("kept"))


def _vocab_counts(spark, d):
    return keywords.term_counts(table(spark, d, "documents"), "doc_id", text.word_tokens(F.col("text")))


def vocab_topk(spark, d):
    return keywords.vocabulary(_vocab_counts(spark, d))


def _oov(words, vocab):
    j = words.join(vocab.select("term").withColumn("known", F.lit(1)), "term", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("known").isNull()).alias("oov"), F.round(F.avg(F.col("known").isNull().cast("int")), 6).alias("rate"))


def oov_rate(spark, d):
    return _oov(_vocab_words(spark, d), vocab_topk(spark, d))


def oov_replaced(spark, d):
    """The tokens of each text with ``<unk>`` for what isn't among the 500 most frequent, and how many that are."""
    known = keywords.vocabulary(_vocab_counts(spark, d), 500).select("term").withColumn("known", F.lit(1))
    each = table(spark, d, "documents").select("doc_id", F.posexplode(text.word_tokens(F.col("text"))).alias("pos", "term")).join(known, "term", "left")
    token = F.when(F.col("known") == 1, F.col("term")).otherwise("<unk>")
    per = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))).alias("ts"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return per.select("doc_id", F.md5(F.array_join(F.transform("ts", lambda x: x["t"]), " ")).alias("digest"), "unknown")


def _vocab_words(spark, d):
    return table(spark, d, "documents").select(F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("?")).alias("lang"), F.explode(text.word_tokens(F.col("text"))).alias("term"))


def capitalised_tokens(spark, d):
    return table(spark, d, "cache_single").select("id", F.array_join(text.capitalised(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))), "|").alias("entities"))


def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def age_strings(spark, d):
    return table(spark, d, "events").select("event_id", text.age_text(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


def html_escaped(spark, d):
    return _articles(spark, d).select("row_id", F.md5(text.html_escape(F.col("summary"))).alias("digest"))


def list_parsing(spark, d):
    made = F.concat(F.lit("['"), F.concat_ws("', '", F.slice(text.word_tokens(F.col("title"), 3), 1, 4)), F.lit("']"))
    got = text.parse_list(made)
    return _articles(spark, d).select("row_id", F.size(F.filter(got, lambda x: x != "")).alias("items"), F.array_join(got, "+").alias("joined"))


# --- places -----------------------------------------------------------------------------------------------------------


def _gazetteer(spark, d):
    c = table(spark, d, "geocode_cache").where("lat is not null and lon is not null")
    country = F.when(F.col("lon") > 6.5, "DE").when(F.col("lat") < 51.8, "BE").otherwise("NL")
    raw = c.select(F.col("place").alias("name"), F.lit("").alias("alternates"), F.lit("P").alias("feature_class"), country.alias("country"), F.when(country == "DE", 3).when(country == "BE", 2).otherwise(1).alias("priority"))
    return geo.build_gazetteer(raw, ["NL", "BE", "DE"])


def gazetteer_build(spark, d):
    return _gazetteer(spark, d)


COUNTRIES = ["NL", "BE", "DE"]


def _raw():
    return text.raw_text(F.col("full_text"), F.col("title"), F.col("summary"))


def _places(spark, d):
    """Places of up to three words in the article's whole text."""
    return geo.mentions(_articles(spark, d), "row_id", _raw(), _gazetteer(spark, d), longest=3)


def place_mentions(spark, d):
    return _places(spark, d)


def _votes_of_places(spark, d):
    return geo.country_vote(_places(spark, d), "row_id", _gazetteer(spark, d), COUNTRIES, docs=_articles(spark, d).select("row_id"))


def country_vote(spark, d):
    named = F.array_join(F.transform("evidence", lambda e: F.concat(e["place"], F.lit(":"), e["country"])), "|")
    return _votes_of_places(spark, d).select("row_id", "country", "score", named.alias("evidence"))


def country_filter(spark, d):
    return geo.by_country(_votes_of_places(spark, d), ["NL", "BE"]).select("row_id", "country", "score")


CONTEXT = ["inbraak", "ransomware", "datalek", "brandstichting", "afpersing", "faillissement", "beheer", "advies"]


def place_narrowing(spark, d):
    return geo.narrow(_articles(spark, d).select("row_id", _raw().alias("text")), "row_id", "text", _places(spark, d), CONTEXT)


def narrowing_stats(spark, d):
    return geo.narrowing_stats(_articles(spark, d), "row_id", _places(spark, d), place_narrowing(spark, d))


def bbox_first(spark, d):
    carried = _articles(spark, d).select("row_id", "title", "url", "feed", "published", sector.best_sector(_raw())["code"].alias("sector"))
    return geo.first_located(_places(spark, d), "row_id", table(spark, d, "geocode_cache"), BOXES, carried)


def place_classifier(spark, d):
    """Capitalised words of the articles scored by a model of the gazetteer's names against other capitalised words."""
    g = _gazetteer(spark, d)
    words = _articles(spark, d).select(F.explode(F.regexp_extract_all(_raw(), F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0))).alias("word")).distinct()
    labelled = words.join(g.select(F.col("name").alias("_n"), F.lit(1).alias("label")), F.lower("word") == F.col("_n"), "left").fillna(0, ["label"]).select("word", "label")
    train, held = classifier.stratified(labelled, "word", "label")
    scored = classifier.predict(classifier.fit(train), held)
    pred = held.join(scored, "word").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return classifier.report(pred, "label", "pred")


def heatmap(spark, d):
    return bbox_first(spark, d).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def map_funnel(spark, d):
    return geo.map_funnel(_articles(spark, d), "row_id", _places(spark, d), table(spark, d, "geocode_cache"), BOXES)


def geo_missing(spark, d):
    named = _articles(spark, d).select(F.explode(F.regexp_extract_all(_raw(), F.lit("in ([A-Z][a-z]+)"), F.lit(1))).alias("place"))
    return geo.missing_places(named, table(spark, d, "geocode_cache"), ["maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag", "vandaag"])


def province_membership(spark, d):
    inside = table(spark, d, "geocode_cache").where(geo.in_boxes(F.col("lat"), F.col("lon"), BOXES[:1])).select(F.lower("place").alias("place")).distinct()
    p = _places(spark, d).withColumn("place", F.lower("place"))
    return p.join(inside, "place", "left_semi").select("row_id").distinct()


# --- weak supervision -------------------------------------------------------------------------------------------------


def _voted(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("full_text", F.lit("")))
    return weak.votes(table(spark, d, "cache_single"), t)


def rule_votes(spark, d):
    return _voted(spark, d).select("id", *[F.col(r.name).cast("int").alias(r.name) for r in weak.RULES])


def rule_coverage(spark, d):
    return weak.diagnostics(_voted(spark, d))


def posterior_filter(spark, d):
    p = weak.fixed_model().posterior()
    return _voted(spark, d).select("id", F.round(p, 6).alias("p")).where("p >= 0.6")


def adaptive_label(spark, d):
    v = _voted(spark, d).withColumn("p", weak.fixed_model().posterior())
    sig = weak.signal(["cyber", "property_crime"])
    return v.select("id", sig.alias("signal"), weak.adaptive(sig, F.col("p")).alias("label"))


def two_layer_filter(spark, d):
    crime, civic = weak.RULES[:4], weak.RULES[4:8]
    v = _voted(spark, d).withColumns({"a": weak.fixed_model(crime).posterior(), "b": weak.fixed_model(civic).posterior()})
    return weak.two_layers(v, "a", "b", 0.75).select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def label_model_em(spark, d):
    v = _voted(spark, d)
    return v.select("id", F.round(weak.fit(v).posterior(), 6).alias("p"))


# --- sectors ----------------------------------------------------------------------------------------------------------


def sector_scores(spark, d):
    return table(spark, d, "cache_single").select("id", *sector.score_columns(_raw()))


def sector_best(spark, d):
    b = sector.best_sector(_raw())
    return table(spark, d, "cache_single").select("id", b["code"].alias("code"), b["name"].alias("name"), b["score"].cast("int").alias("score"))


def _sectors(spark, d):
    """Written once: the expressions of the companies are long, and several columns are made from them."""
    return written(sector.article_sectors(table(spark, d, "cache_single"), "id", _raw()))


def sector_primary(spark, d):
    return _sectors(spark, d).select("id", "primary", "primary_name", F.array_join("sectors", "|").alias("sectors"), F.size("companies").alias("companies"))


def sector_columns(spark, d):
    """The articles with their sector columns appended."""
    a = table(spark, d, "cache_single").select("id", "title", "feed_key")
    return a.join(_sectors(spark, d), "id").select("id", "title", "feed_key", "primary", "primary_name", F.array_join("sectors", "|").alias("sectors"), F.size("companies").alias("companies"))


def sector_report(spark, d):
    return sector.report(_sectors(spark, d))


def sector_totals(spark, d):
    return sector.totals(_sectors(spark, d))


def sector_samples(spark, d):
    return sector.samples(_sectors(spark, d), "id")


def sector_options(spark, d):
    """The sectors that occur, as they are listed with and without their codes."""
    s = _sectors(spark, d).select("primary", "primary_name").distinct()
    return s.select("primary", sector.label(F.col("primary"), F.col("primary_name"), True).alias("with_code"), sector.label(F.col("primary"), F.col("primary_name"), False).alias("plain"))


def victim_window(spark, d):
    named = F.posexplode(F.slice(sector.organisations(_raw(), sector.FIRST_CHARS), 1, 10)).alias("at", "name")
    c = table(spark, d, "cache_single").select("id", _raw().alias("t"), named)
    return c.select("id", "at", "name", sector.is_affected(F.col("t"), F.col("name")).alias("affected"))


# --- keywords, trends, views --------------------------------------------------------------------------------------------


def _weights(spark, d, smooth=False):
    docs = table(spark, d, "documents")
    counts = keywords.term_counts(docs, "doc_id", text.without_stopwords(text.word_tokens(F.col("text"), 3)))
    counts = written(counts.join(keywords.vocabulary(counts).select("term"), "term", "left_semi"))  # read four times
    return keywords.tfidf(counts, "doc_id", counts.agg(F.countDistinct("doc_id").alias("n")), smooth)


def tfidf_top10(spark, d):
    return keywords.top_terms(_weights(spark, d), "doc_id")


def keyword_global_top20(spark, d):
    return keywords.global_top(tfidf_top10(spark, d))


def keyword_stats(spark, d):
    t = tfidf_top10(spark, d)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.sum("w"), 6).alias("score"))


def _mentions(spark, d):
    words = F.array_distinct(text.word_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 5))
    return table(spark, d, "documents").where("published_at is not null").select(F.date_format("published_at", "yyyy-MM").alias("month"), F.explode(words).alias("word"))


def keyword_trend(spark, d):
    return keywords.trend(_mentions(spark, d), "word", "month", FOCUS)


def order_trend(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("word"))
    return keywords.trend(o, "word", "month", None, roll=6)


def split_by_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0, "test").otherwise("train").alias("split"))


def text_search(spark, d):
    q = 'inbraak OR ransomware -museum "in de nacht"'
    return _articles(spark, d).where(matches(q, [F.coalesce(c, F.lit("")) for c in ("title", "summary", "full_text")])).select("row_id")


#: One query of each kind that the parser knows.
SEARCHES = {
    "and": "inbraak politie", "or": "inbraak OR ransomware", "or_lower": "inbraak or ransomware", "bar": "inbraak | droogte", "not": "inbraak -museum",
    "phrase": '"in de nacht"', "mixed": "gemeente inbraak OR droogte OR ransomware", "only_not": "-de",
}


def search_cases(spark, d):
    cols = [F.coalesce(c, F.lit("")) for c in ("title", "summary", "full_text")]
    hits = F.array(*[F.when(matches(q, cols), F.lit(k)) for k, q in SEARCHES.items()])
    return _articles(spark, d).select("row_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("kind"))


def preset_roundtrip(spark, d):
    """A filter that was saved, loaded and applied; saved a second time and deleted, which changes nothing."""
    store = presets.PresetStore(os.path.join(tempfile.mkdtemp(), "presets.json"))
    spec = FilterSpec(text="inbraak OR droogte", feeds=presets.clean_selection(["bd", "l3", "bd", "x"], ["bd", "l3", "rtv_oever"]), dates=None)
    store.save("mine", spec)
    store.save("other", presets.reset())
    store.delete("other")
    df = _articles(spark, d)
    return store.load("mine").apply(df, ["title", "summary", "full_text"], feed="feed_key").select("row_id", "feed_key")


def filter_combo(spark, d):
    spec = FilterSpec(text="de", feeds=["bd", "l3", "rtv_oever"], min_score=0.15, dates=("2025-01-01", "2025-12-31"))
    voted = _voted(spark, d).withColumn("score", weak.fixed_model().posterior()).withColumn("date", dates.rfc822(F.col("published")))
    return spec.apply(voted, ["title", "summary"], feed="feed_key").select("id")


def sector_filter(spark, d):
    s = _sectors(spark, d)
    return FilterSpec(sectors=["J", "K"]).apply(s, ["primary"], sector="primary", mentioned="sectors").select("id", "primary")


def place_tag_filter(spark, d):
    p = _places(spark, d).groupBy("row_id").agg(F.collect_list("place").alias("locations"))
    return FilterSpec(places="burg, dijk").apply(p, [], places="locations").select("row_id")


def quick_range(spark, d):
    """Orders of each quick range before the newest one, per day."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    hi = o.agg(F.max("day").alias("hi"), F.min("day").alias("lo")).first()
    inside = []
    for name in dates.QUICK:
        lo, top = dates.clamp_range(dates.quick_range(name, hi.lo, hi.hi), hi.lo, hi.hi)
        inside.append(F.when(F.col("day").between(lo, top), F.lit(name)))
    each = o.select("day", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("range"))
    return each.groupBy("range", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def date_bounds(spark, d):
    return table(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("lo"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("hi"))


def feed_options(spark, d):
    return _articles(spark, d).where("feed is not null").select(F.trim("feed").alias("feed")).distinct()


def spotlight(spark, d):
    """Customers of one region and the five with the highest balance, once each."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inside = c.join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    top = c.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(5)
    both = inside.select("c_custkey", "c_acctbal", "n_name").unionByName(top.select("c_custkey", "c_acctbal", "n_name"))
    return both.dropDuplicates(["c_custkey"])


def spotlight_table(spark, d):
    """Accepted articles of one province and the five newest, once each, as the view lists them."""
    a = table(spark, d, "cache_single").withColumn("ts", F.try_to_timestamp("published_ts"))
    near = table(spark, d, "geocode_cache").where(geo.in_boxes(F.col("lat"), F.col("lon"), BOXES[:1])).select(text.place_key(F.col("place")).alias("_k")).distinct()
    inside = geo.mentions(a, "id", _raw(), _gazetteer(spark, d), longest=3).withColumn("_k", text.place_key(F.col("place"))).join(near, "_k", "left_semi").select("id")
    top = a.where("ts is not null").orderBy(F.desc("ts"), "id").limit(5).select("id")
    rows = a.where("ts is not null").join(inside.unionAll(top).distinct(), "id", "left_semi")
    now = F.lit("2026-12-31 00:00:00").cast("timestamp")
    named = sector.best_sector(_raw())["name"].alias("sector")
    return rows.select("id", F.col("feed_key").alias("source"), "title", named, F.date_format("ts", "yyyy-MM-dd HH:mm").alias("date"), text.age_text(F.col("ts"), now).alias("age"), "url")


def alphanumeric_order(spark, d):
    t = table(spark, d, "part").select("p_name").distinct()
    w = Window.orderBy(~F.col("p_name").rlike("^[0-9]"), F.lower("p_name"), "p_name")
    top = t.orderBy(~F.col("p_name").rlike("^[0-9]"), F.lower("p_name"), "p_name").limit(5)  # a top-5 report
    return top.withColumn("n", F.row_number().over(w))


# --- similarity ---------------------------------------------------------------------------------------------------------


def _titles(spark, d):
    return table(spark, d, "cache_single").select("id", F.array_distinct(text.tokens(F.lower("title"))).alias("tokens"), text.capitalised(F.concat_ws(" ", F.col("title"), F.coalesce("summary", F.lit("")))).alias("entities"), F.try_to_timestamp("published_ts").alias("ts"))


def title_jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(_titles(spark, d), "id", "tokens", 0.6).withColumn("sim", F.round("sim", 6))


def entity_jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(_titles(spark, d), "id", "entities", 0.3).withColumn("sim", F.round("sim", 6))


def cosine_pairs(spark, d):
    """Every 20th row against the rows of its own label, cosine of 0.3 or more, as its SQL has it; the whole matrix is
    cosine_all_pairs."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("va"))
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("vb"))
    j = a.where("a % 20 = 0").join(b, "label").where("a <> b").withColumn("sim", similarity.vector_cosine(F.col("va"), F.col("vb")))
    return j.where("sim >= 0.3").select("a", "b", F.round("sim", 5).alias("sim"))


def cosine_all_pairs(spark, d):
    """All rows against all rows, whatever their labels; pairs whose cosine reaches 0.3 or more."""
    return similarity.all_cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).withColumn("sim", F.round("sim", 5))


def _title_vectors(spark, d):
    t = table(spark, d, "cache_single").select("id", text.word_tokens(text.weighted_text(F.col("title"), F.col("summary"), 3), 2).alias("ws"))
    return keywords.run_vectors(t, "id", "ws", 3, 1000)


def tfidf_title_weights(spark, d):
    vectors, terms = _title_vectors(spark, d)
    each = vectors.select("id", F.explode(F.arrays_zip("t", "w")).alias("x"))
    return each.select("id", F.element_at(F.array(*map(F.lit, terms)).cast("array<string>"), F.col("x.t") + 1).alias("term"), F.round("x.w", 6).alias("w"))


def _duplicates(spark, d):
    vectors, terms = _title_vectors(spark, d)
    return similarity.duplicates(_titles(spark, d), "id", "tokens", "entities", written(vectors), len(terms), "ts")


def dup_edges(spark, d):
    return similarity.duplicate_edges(*_duplicates(spark, d))


def leader_clusters(spark, d):
    return similarity.duplicate_clusters(*_duplicates(spark, d), "id")


def cluster_stats(spark, d):
    return similarity.cluster_stats(leader_clusters(spark, d))


def cluster_rollup(spark, d):
    df = table(spark, d, "cache_single").withColumn("ts", F.try_to_timestamp("published_ts"))
    r = similarity.roll_up(leader_clusters(spark, d), df, "id", "ts", "feed_key", "url", "summary")
    return r.select("leader", "size", F.array_join("sources", "|").alias("sources"), F.size("urls").alias("urls"), F.md5("combined_summary").alias("digest"))


def exact_copies(spark, d):
    """Groups of documents with one text: the least id, the size, the sources in order of id."""
    g = table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.countDistinct("source").alias("sources"))
    return g.where("size > 1")


# --- timestamps ---------------------------------------------------------------------------------------------------------


def _with_zone(spark, d):
    zones = table(spark, d, "rss_state").groupBy("feed_key").agg(F.min("tz").alias("tz"))
    return spread(_articles(spark, d).select("row_id", "feed_key", "published", "scraped_at")).join(zones, "feed_key", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    df = timestamps.normalise(_with_zone(spark, d), {"published": F.col("tz"), "scraped_at": F.lit("UTC")})
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_utc").alias("utc")) for c in ("published", "scraped_at")])
    return df.select("row_id", F.explode(pairs).alias("x")).select("row_id", "x.field", "x.utc").where("utc is not null")


def p4_masks(spark, d):
    both = [timestamps.mask_census(_articles(spark, d), c).withColumn("field", F.lit(c)) for c in ("published", "scraped_at")]
    return both[0].unionByName(both[1])


def queries() -> dict:
    fs = [
        url_canonical_id, url_dedup_first, url_anti_seen, rows_without_url, feed_alias, feed_alias_fuzzy, feed_alias_exact, rfc822_parse, iso_z_format, cursor_overlap_filter,
        cursor_state_update, merge_counters, url_keyed_merge, raw_url_dedup, result_cache_split, source_type_default, head_per_source,
        latest_per_source, union_distinct, run_state, seen_ids, raw_text_choice, whitespace_tokens, token_clean, token_clean_compat, geo_clean, hashtag_split, ngram_counts, stopword_removal, vocab_topk,
        oov_rate, oov_replaced, capitalised_tokens, snippets, age_strings, html_escaped, list_parsing, gazetteer_build, place_mentions, country_vote,
        country_filter, place_narrowing, narrowing_stats, place_classifier, bbox_first, heatmap, map_funnel, geo_missing, province_membership, rule_votes, rule_coverage,
        posterior_filter, adaptive_label, two_layer_filter, label_model_em, sector_scores, sector_best, sector_primary, sector_columns, sector_report, sector_totals, sector_samples, sector_options,
        victim_window, tfidf_top10, keyword_global_top20, keyword_stats, keyword_trend, order_trend, split_by_hash, text_search, search_cases, preset_roundtrip,
        filter_combo, sector_filter, place_tag_filter, quick_range, date_bounds, feed_options, spotlight, spotlight_table, alphanumeric_order,
        title_jaccard_pairs, entity_jaccard_pairs, cosine_pairs, cosine_all_pairs, tfidf_title_weights, dup_edges, leader_clusters, cluster_stats,
        cluster_rollup, exact_copies, p4_found, p4_masks,
    ]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
