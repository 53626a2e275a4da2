"""SQL of the catalogue's queries, for DuckDB, written apart from the operators: brute force where they are clever."""

from __future__ import annotations

from newsweave.functions.text import STOPWORDS
from newsweave.operators import sector, weak

_CANON = r"""regexp_replace(CASE WHEN strpos({b},'?')=0 THEN {b}
  WHEN regexp_matches(lower(substr({b}, strpos({b},'?')+1)), 'utm_|fbclid=|gclid=') THEN substr({b},1,strpos({b},'?')-1) ELSE {b} END, '/+$', '')"""


def _canon(u: str = "url") -> str:
    return _CANON.format(b=f"split_part(trim(coalesce({u},'')), '#', 1)")


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x},''), '[ \t\n\r\f]+', ' ', 'g'), ' ')"


_NO_FORMAT = r"regexp_replace(coalesce(feed,''),'\p{Cf}','','g')"
_URL_OK = "trim(coalesce(url,'')) <> ''"
_TS = "try_cast(published_ts AS TIMESTAMPTZ)"
_CURSOR = "try_cast(last_published_ts AS TIMESTAMPTZ)"
_RFC = "try_strptime(regexp_replace(regexp_replace(trim(published),'^[A-Za-z]{3},\\s*',''), ' (GMT|UTC|UT|Z)$', ' +0000'), ['%d %b %Y %H:%M:%S %z'])"
_RFC_ANY = f"coalesce({_RFC}, try_strptime(regexp_replace(trim(published),'^[A-Za-z]{{3}},\\s*',''), ['%d %b %Y %H:%M:%S']))"
_RFC_STRICT = "try_strptime(regexp_replace(trim(published),'^[A-Za-z]{3},\\s*',''), ['%d %b %Y %H:%M:%S %z'])"
_WORDS = "regexp_extract_all(lower(coalesce({x},'')), '[\\p{{L}}\\p{{N}}_]{{{n},}}')"
_STOP = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"
_TEXT = "concat_ws(' ', coalesce(title,''), coalesce(summary,''), coalesce(full_text,''))"
_RAW = "(CASE WHEN length(trim(coalesce(full_text,'')))>0 THEN full_text ELSE trim(concat_ws(' ', coalesce(title,''), coalesce(summary,''))) END)"
_BOXES = "((lat BETWEEN 50.7 AND 51.8 AND lon BETWEEN 5.0 AND 6.3) OR (lat BETWEEN 52.2 AND 53.3 AND lon BETWEEN 6.0 AND 7.1) OR (lat BETWEEN 51.2 AND 51.8 AND lon BETWEEN 3.3 AND 4.3))"

_GAZ = r"""g AS (SELECT name, arg_min(country, p*100+ord) country FROM (
  SELECT lower({P}) name, CASE WHEN lon>6.5 THEN 'DE' WHEN lat<51.8 THEN 'BE' ELSE 'NL' END country,
    CASE WHEN lon>6.5 THEN -3 WHEN lat<51.8 THEN -2 ELSE -1 END p, CASE WHEN lon>6.5 THEN 2 WHEN lat<51.8 THEN 1 ELSE 3 END ord
  FROM geocode_cache WHERE lat IS NOT NULL AND lon IS NOT NULL AND regexp_matches({P}, '^[A-Za-zÀ-ÖØ-öø-ÿ'' .-]+$')) GROUP BY name)""".replace("{P}", _collapse("place"))


def _mentions(table: str = "nos_articles", key: str = "row_id") -> str:
    runs = " UNION ALL ".join(f"SELECT {key}, pos, {n} n, array_to_string(ws[pos:pos+{n - 1}], ' ') place FROM (SELECT {key}, ws, unnest(range(1, len(ws)+{2 - n})) pos FROM w)" for n in (1, 2, 3))
    return rf"""w AS (SELECT {key}, regexp_extract_all({_RAW}, '[A-Za-zÀ-ÖØ-öø-ÿ''-]+') ws FROM {table}),
t AS ({runs}),
m AS (SELECT {key}, pos, arg_max(place, n) place FROM t WHERE regexp_matches(place,'^[A-ZÀ-ÖØ-Þ]') AND lower(place) IN (SELECT name FROM g) GROUP BY ALL)"""


_PLACES = f"WITH {_GAZ}, {_mentions()}"
_VOTE = _PLACES + """, v AS (SELECT row_id, count(*) FILTER (country='NL') nl, count(*) FILTER (country='BE') be, count(*) FILTER (country='DE') de, string_agg(place || ':' || country, '|' ORDER BY pos) ev FROM m JOIN g ON lower(m.place)=g.name GROUP BY row_id),
s AS (SELECT row_id, round(greatest(nl,be,de)/(nl+be+de)::DOUBLE,6) sc, CASE WHEN nl>=be AND nl>=de THEN 'NL' WHEN be>=de THEN 'BE' ELSE 'DE' END w, ev FROM v),
cv AS (SELECT a.row_id, CASE WHEN coalesce(sc,0) < 0.6 THEN 'uncertain' ELSE w END country, coalesce(sc,0.0) score, coalesce(ev,'') evidence FROM nos_articles a LEFT JOIN s ON a.row_id=s.row_id)"""
_FIRST = _PLACES + rf""", c AS (SELECT lower({_collapse('place')}) k, min(struct_pack(lat:=lat, lon:=lon)) c FROM geocode_cache WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1),
f AS (SELECT row_id, place, c.c.lat lat, c.c.lon lon, row_number() OVER (PARTITION BY row_id ORDER BY pos) rn FROM (SELECT m.*, c.c, c.c.lat lat0, c.c.lon lon0 FROM m JOIN c ON lower(m.place)=c.k) c WHERE {_BOXES.replace('lat','lat0').replace('lon','lon0')}),
b AS (SELECT row_id, place, lat, lon FROM f WHERE rn=1)"""


_CONTEXT = "['inbraak','ransomware','datalek','brandstichting','afpersing','faillissement','beheer','advies']"
_NARROW = _PLACES + rf""", p AS (SELECT DISTINCT row_id, place FROM m), d AS (SELECT row_id, lower({_RAW}) low FROM nos_articles WHERE row_id IN (SELECT row_id FROM p)),
o AS (SELECT row_id, low, unnest(range(0, length(low))) o FROM d), cw AS (SELECT unnest({_CONTEXT}) w),
c AS (SELECT row_id, o FROM o, cw WHERE substr(low,o+1,length(w))=w AND (o=0 OR NOT regexp_matches(substr(low,o,1),'[a-z]')) AND NOT regexp_matches(substr(low,o+length(w)+1,1),'[a-z]')),
l AS (SELECT o.row_id, place, o FROM o JOIN p ON o.row_id=p.row_id WHERE substr(low,o+1,length(place))=lower(place)),
n AS (SELECT l.row_id, place, min(struct_pack(d:=abs(l.o-c.o), o:=l.o)) x FROM l JOIN c ON l.row_id=c.row_id GROUP BY ALL),
b AS (SELECT row_id, arg_min(place, struct_pack(x:=x, p:=place)) best FROM n GROUP BY row_id),
nr AS (SELECT p.row_id, p.place FROM p LEFT JOIN b ON p.row_id=b.row_id WHERE best IS NULL OR best=p.place)"""


def _rule(r: weak.Rule) -> str:
    def has(ts):
        if r.kind == "word":
            return rf"regexp_matches(lower({_TEXT}), '\b(?:{'|'.join(ts)})\b')"
        return "(" + " OR ".join(f"contains(lower({_TEXT}), '{t}')" for t in ts) + ")"

    cond = " AND ".join(has(g) for g in r.groups) + (f" AND NOT {has(r.without)}" if r.without else "")
    return f"CASE WHEN {cond} THEN {r.vote} ELSE {r.otherwise} END AS {r.name}"


_VOTES = "v AS (SELECT *, " + ", ".join(map(_rule, weak.RULES)) + " FROM cache_single)"


def _posterior(rules) -> str:
    return "1/(1+exp(-(" + "+".join(f"CASE {r.name} WHEN 1 THEN ln(4.0) WHEN 0 THEN -ln(4.0) ELSE 0 END" for r in rules) + ")))"


def _coverage() -> str:
    rows = []
    for r in weak.RULES:
        n = r.name
        others = [x.name for x in weak.RULES if x is not r]
        yes, no = (" OR ".join(f"{o}={v}" for o in others) for v in (1, 0))
        rows.append(f"SELECT '{n}' AS rule, round(avg(({n}<>-1)::INT),6) coverage, round(avg(({n}=1)::INT),6) positive, round(avg(({n}=0)::INT),6) negative, round(avg((({n}=1 AND ({no})) OR ({n}=0 AND ({yes})))::INT),6) conflict FROM v")
    return f"WITH {_VOTES} " + " UNION ALL ".join(rows)


def _sector_score(ks) -> str:
    return "(" + "+".join(f"contains(lower({_RAW}),'{k}')::INT" for k in ks) + ")"


_SECT = "s AS (SELECT id, " + _RAW + " raw, " + ", ".join(f"{_sector_score(ks)} s_{c}" for c, _, ks in sector.LEXICON) + " FROM cache_single)"
_TOP = "greatest(" + ",".join(f"s_{c}" for c, _, _ in sector.LEXICON) + ")"
_BEST = (
    f"bs AS (SELECT id, raw, CASE WHEN {_TOP}=0 THEN 'unknown' " + " ".join(f"WHEN s_{c}={_TOP} THEN '{c}'" for c, _, _ in sector.LEXICON)
    + f" END code, CASE WHEN {_TOP}=0 THEN 'Unknown' " + " ".join(f"WHEN s_{c}={_TOP} THEN '{n}'" for c, n, _ in sector.LEXICON) + f" END AS name, {_TOP} score FROM s)"
)
_CODE = f"CASE WHEN {_TOP}=0 THEN 'unknown' " + " ".join(f"WHEN s_{c}={_TOP} THEN '{c}'" for c, _, _ in sector.LEXICON) + " END"
_CUES = " OR ".join(f"contains(win,'{c}')" for c in sector.NOT_AFFECTED)
_COMP = rf"""cs AS (SELECT id, code, lower(raw) low, [x FOR x IN regexp_extract_all(substr(raw,1,5000), '[A-Z][a-zà-ÿ]+(?: (?:& )?[A-Z][a-zà-ÿ]+)+') IF length(x)>2] l FROM bs),
cr AS (SELECT id, code, low, unnest(l) nm, generate_subscripts(l,1) rn FROM cs),
cw AS (SELECT *, strpos(low, lower(nm)) p FROM cr WHERE rn<=10),
ca AS (SELECT *, NOT (p>0 AND ({_CUES})) affected FROM (SELECT *, substr(low, greatest(p-50,1), least(p-1,50)+length(nm)+50) win FROM cw)),
cc AS (SELECT id, rn, CASE WHEN affected THEN code ELSE 'not_affected' END sc FROM ca),
pk AS (SELECT id, sc, count(*) n, min(rn) f FROM cc WHERE sc<>'unknown' GROUP BY id, sc),
pr AS (SELECT id, sc FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) k FROM pk) WHERE k=1),
ag AS (SELECT id, count(*) companies, string_agg(DISTINCT sc, '|' ORDER BY sc) FILTER (sc<>'unknown') ss FROM cc GROUP BY id),
ar AS (SELECT bs.id, CASE WHEN ag.id IS NULL THEN bs.code WHEN pr.id IS NULL THEN 'unknown' ELSE pr.sc END AS "primary",
  CASE WHEN ag.id IS NULL THEN CASE WHEN bs.code='unknown' THEN '' ELSE bs.code END ELSE coalesce(ag.ss,'') END sectors, coalesce(companies,0) companies
  FROM bs LEFT JOIN ag ON bs.id=ag.id LEFT JOIN pr ON bs.id=pr.id)"""
_NAMED = "CASE {c} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n, _ in sector.LEXICON) + " WHEN 'not_affected' THEN 'Not affected' ELSE 'Unknown' END"
_SECTORS = f"WITH {_SECT}, {_BEST}, {_COMP}"


def _named(c: str = '"primary"') -> str:
    return _NAMED.replace("{c}", c)




_DOCTERMS = f"dt AS (SELECT doc_id, unnest([w FOR w IN {_WORDS.format(x='text', n=3)} IF w NOT IN {_STOP}]) term FROM documents), tf0 AS (SELECT doc_id, term, count(*) tf FROM dt GROUP BY ALL), vc AS (SELECT term FROM tf0 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000), tf AS (SELECT * FROM tf0 WHERE term IN (SELECT term FROM vc))"
_TFIDF = f"""WITH {_DOCTERMS}, n AS (SELECT count(DISTINCT doc_id) n FROM tf), df AS (SELECT term, count(*) df FROM tf GROUP BY term),
w0 AS (SELECT doc_id, term, tf*log10(n/df::DOUBLE) w FROM tf JOIN df USING(term), n), nn AS (SELECT doc_id, sqrt(sum(w*w)) l FROM w0 GROUP BY doc_id),
w1 AS (SELECT doc_id, term, coalesce(w/nullif(l,0),0) w FROM w0 JOIN nn USING(doc_id)),
top AS (SELECT doc_id, rank, term, round(w,6) w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w,9) DESC, term) rank FROM w1 WHERE round(w,9)>0) WHERE rank<=10)"""


def _trend(mentions: str, focus: str, roll: int) -> str:
    return f"""WITH me AS ({mentions}), p AS (SELECT word, month, count(*) n FROM me {focus} GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT word FROM p), (SELECT DISTINCT month FROM p)), f AS (SELECT g.word, g.month, coalesce(n,0) n FROM g LEFT JOIN p USING(word,month)),
s AS (SELECT *, n/greatest(sum(n) OVER (PARTITION BY month),1)::DOUBLE*100.0 share FROM f)
SELECT word, month, n, round(share,6) share, round(avg(n) OVER w,6) rolling, round(avg(s.share) OVER w,6) share_rolling FROM s WINDOW w AS (PARTITION BY word ORDER BY month ROWS BETWEEN {roll - 1} PRECEDING AND CURRENT ROW)"""


_TOK = rf"list_distinct([x FOR x IN string_split({_collapse('lower(title)')}, ' ') IF x<>''])"
_ENT = rf"list_sort(list_distinct([lower(x) FOR x IN string_split({_collapse("concat_ws(' ', title, coalesce(summary,''))")}, ' ') IF regexp_matches(x,'^\p{{Lu}}')]))"
_JAC = "coalesce(len(list_intersect({a},{b}))/nullif(len({a})+len({b})-len(list_intersect({a},{b})),0)::DOUBLE,0)"
_GRAMS = f"""tw AS (SELECT id, {_WORDS.format(x="concat_ws(' ', coalesce(title,''), coalesce(title,''), coalesce(title,''), coalesce(summary,''))", n=2)} ws FROM cache_single),
gr AS (SELECT id, unnest(ws) term FROM tw UNION ALL
 SELECT id, ws[i] || ' ' || ws[i+1] FROM (SELECT id, ws, unnest(range(1, len(ws))) i FROM tw) UNION ALL
 SELECT id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] FROM (SELECT id, ws, unnest(range(1, len(ws)-1)) i FROM tw WHERE len(ws)>2)),
gt AS (SELECT id, term, count(*) tf FROM gr GROUP BY ALL), vo AS (SELECT term FROM gt GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
gk AS (SELECT * FROM gt WHERE term IN (SELECT term FROM vo)), gd AS (SELECT term, count(*) df FROM gk GROUP BY term), gn AS (SELECT count(*) n FROM cache_single),
g0 AS (SELECT id, term, tf*(ln((1.0+n)/(1.0+df))+1) w FROM gk JOIN gd USING(term), gn), gl AS (SELECT id, sqrt(sum(w*w)) l FROM g0 GROUP BY id),
gw AS (SELECT id, term, w/l w FROM g0 JOIN gl USING(id))"""
_EDGES = f"""WITH {_GRAMS}, nd AS (SELECT id, {_TOK} tk, {_ENT} en, {_TS} ts FROM cache_single),
cs AS (SELECT x.id a, y.id b, sum(x.w*y.w) sim FROM gw x JOIN gw y ON x.term=y.term AND x.id<y.id GROUP BY ALL),
tp AS (SELECT DISTINCT x.id a, y.id b FROM (SELECT id, unnest(tk) t FROM nd) x JOIN (SELECT id, unnest(tk) t FROM nd) y ON x.t=y.t AND x.id<y.id),
pp AS (SELECT a, b FROM cs WHERE sim>=0.59 UNION SELECT a, b FROM tp),
pj AS (SELECT pp.a, pp.b, coalesce(cs.sim,0) sim, {_JAC.format(a='x.tk', b='y.tk')} jt, x.en ea, y.en eb, x.ts xa, y.ts yb FROM pp LEFT JOIN cs ON pp.a=cs.a AND pp.b=cs.b JOIN nd x ON pp.a=x.id JOIN nd y ON pp.b=y.id),
ed AS (SELECT a, b FROM pj WHERE (sim>=0.75 OR jt>=0.6 OR sim>=0.6) AND (xa IS NULL OR yb IS NULL OR abs(epoch(xa)-epoch(yb))<=259200)
 AND (sim>=0.75 OR jt>=0.6 OR ({_JAC.format(a='ea', b='eb')}>=0.5 AND sim>=0.65) OR (sim>=0.6 AND jt>=0.4 AND {_JAC.format(a='ea', b='eb')}>=0.3)))"""

_LEAD = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, nb AS (SELECT b id, list(a) ns FROM ed GROUP BY b), od AS MATERIALIZED (SELECT c.id, coalesce(ns,[]) ns, row_number() OVER (ORDER BY c.id) i FROM cache_single c LEFT JOIN nb ON c.id=nb.id),
r AS (SELECT 0::BIGINT i, NULL::VARCHAR id, NULL::VARCHAR leader, []::VARCHAR[] ls UNION ALL
 SELECT q.i, q.id, coalesce(q.x, q.id), CASE WHEN q.x IS NULL THEN list_append(q.ls, q.id) ELSE q.ls END FROM (SELECT od.i, od.id, r.ls, list_min(list_intersect(od.ns, r.ls)) x FROM r JOIN od ON od.i=r.i+1) q),
lc AS (SELECT id, leader FROM r WHERE i>0)"""


def sql() -> dict[str, str]:
    c = _canon()
    return {
        "url_canonical_id": f"SELECT row_id, {c} canonical_url, sha256({c}) id FROM nos_articles",
        "url_dedup_first": f"SELECT id, feed_key, row_id FROM (SELECT sha256({c}) id, feed_key, row_id, row_number() OVER (PARTITION BY {c} ORDER BY feed_key, row_id) n FROM nos_articles WHERE {_URL_OK}) WHERE n=1",
        "url_anti_seen": f"SELECT row_id, sha256({c}) id FROM merge_batch WHERE {_URL_OK} AND sha256({c}) NOT IN (SELECT id FROM cache_single)",
        "rows_without_url": "SELECT feed_key, count(*) FILTER (trim(coalesce(url,''))='') without_url, count(*) n FROM nos_articles GROUP BY feed_key",
        "feed_alias": rf"""SELECT feed_key, CASE WHEN starts_with(lower(k),'beekdal dagblad') THEN 'Beekdal Dagblad' WHEN starts_with(lower(k),'l3') THEN 'L3' WHEN contains(lower(k),'omroep') THEN 'Omroep'
  WHEN contains(lower(k),'koerier') THEN 'Koerier' ELSE k END alias, count(*) n FROM (SELECT feed_key, {_collapse(_NO_FORMAT)} k FROM nos_articles) GROUP BY ALL""",
        "rfc822_parse": f"SELECT row_id, epoch({_RFC})::BIGINT epoch, epoch({_RFC_STRICT})::BIGINT epoch_strict FROM nos_articles WHERE regexp_matches(published, '^[A-Z][a-z]{{2}}, [0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9:]{{8}} (GMT|[+-][0-9]{{4}})$')",
        "iso_z_format": "SELECT doc_id, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') iso FROM documents",
        "cursor_overlap_filter": f"SELECT c.id, c.feed_key FROM cache_single c LEFT JOIN rss_state s USING(feed_key) WHERE NOT coalesce({_TS} < {_CURSOR} - INTERVAL 24 HOUR, false)",
        "cursor_state_update": f"SELECT coalesce(s.feed_key,k.feed_key) feed_key, epoch(greatest({_CURSOR}, k.m))::BIGINT cursor, coalesce(k.n,0) added FROM rss_state s FULL JOIN (SELECT feed_key, max({_TS}) m, count(*) n FROM cache_single GROUP BY 1) k USING(feed_key)",
        "merge_counters": f"""WITH b AS (SELECT feed_key, sha256({c}) id, row_id, {_RFC_ANY} ts, row_number() OVER (PARTITION BY {c} ORDER BY batch_no, pos, row_id) n FROM merge_batch WHERE {_URL_OK}),
 x AS (SELECT b.feed_key, (n>1 OR id IN (SELECT id FROM cache_single)) dup, coalesce(epoch(ts) < epoch({_CURSOR}) - 86400, false) late FROM b LEFT JOIN rss_state USING(feed_key))
 SELECT feed_key, count(*) FILTER (NOT dup AND NOT late) added, count(*) FILTER (dup) dup, count(*) FILTER (NOT dup AND late) AS "old" FROM x GROUP BY 1""",
        "url_keyed_merge": """WITH a AS (SELECT url, arg_min(title,row_id) title FROM merge_batch WHERE coalesce(url,'')<>'' GROUP BY url), o AS (SELECT url, min(title) title FROM cache_single WHERE coalesce(url,'')<>'' AND url NOT IN (SELECT url FROM a) GROUP BY url)
 SELECT url, 'new' side, title FROM a UNION ALL SELECT url, 'old', title FROM o""",
        "raw_url_dedup": "SELECT url, min(row_id) row_id, count(*) n FROM nos_articles WHERE url IS NOT NULL GROUP BY url HAVING count(*)>1",
        "result_cache_split": f"SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM cache_single) THEN 'cached' ELSE 'enriched' END state FROM (SELECT sha256({c}) id FROM merge_batch)",
        "source_type_default": "SELECT coalesce(source_type,'rss') source_type, count(*) n FROM cache_single GROUP BY 1",
        "head_per_source": "SELECT * FROM (SELECT feed_key, row_id, row_number() OVER (PARTITION BY feed_key ORDER BY row_id) n FROM nos_articles) WHERE n<=30",
        "latest_per_source": "SELECT source, strftime(max(published_at),'%Y-%m-%d %H:%M:%S') since, count(*) n FROM documents GROUP BY source",
        "union_distinct": "SELECT feed_key, url, title FROM nos_articles UNION SELECT feed_key, url, title FROM merge_batch",
        "raw_text_choice": "SELECT row_id, md5(t) digest, length(t) chars FROM (SELECT row_id, CASE WHEN length(trim(coalesce(full_text,'')))>0 THEN full_text ELSE trim(concat_ws(' ', coalesce(title,''), coalesce(summary,''))) END t FROM nos_articles)",
        "whitespace_tokens": f"SELECT doc_id, md5({_collapse('text')}) digest, len([x FOR x IN string_split({_collapse('text')},' ') IF x<>'']) tokens FROM documents",
        "token_clean": r"""SELECT id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(title,''),'<[^>]*>',' ','g'),'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&apos;',chr(39)),'&amp;','&'),'[ \t\n\r\f]+',' ','g')),'^#[0-9]+ - ',''),'([#@][A-Za-z]*?[a-z])([A-Z])','\1 \2','g'),'[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+',' ','g'),'[ \t\n\r\f]+',' ','g')))) digest FROM cache_single""",
        "ngram_counts": f"""WITH t AS (SELECT row_id, {_WORDS.format(x='title', n=2)} ws FROM nos_articles), g AS (SELECT unnest(ws) gram FROM t UNION ALL SELECT ws[i]||' '||ws[i+1] FROM (SELECT ws, unnest(range(1,len(ws))) i FROM t)
 UNION ALL SELECT ws[i]||' '||ws[i+1]||' '||ws[i+2] FROM (SELECT ws, unnest(range(1,len(ws)-1)) i FROM t WHERE len(ws)>2)) SELECT gram, count(*) n FROM g GROUP BY 1""",
        "stopword_removal": f"SELECT doc_id, len(ws) words, len([w FOR w IN ws IF w NOT IN {_STOP}]) kept FROM (SELECT doc_id, {_WORDS.format(x='text', n=2)} ws FROM documents)",
        "vocab_topk": f"SELECT term, count(*) n FROM (SELECT unnest({_WORDS.format(x='text', n=2)}) term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 10000",
        "oov_rate": f"""WITH w AS (SELECT coalesce(lower(substr(lang,1,2)),'?') lang, unnest({_WORDS.format(x='text', n=2)}) term FROM documents), v AS (SELECT term FROM w GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 10000)
 SELECT lang, count(*) tokens, count(*) FILTER (term NOT IN (SELECT term FROM v)) oov, round(avg((term NOT IN (SELECT term FROM v))::INT),6) rate FROM w GROUP BY 1""",
        "capitalised_tokens": rf"""SELECT id, array_to_string(list_sort(list_distinct([lower(x) FOR x IN string_split({_collapse("concat_ws(' ', coalesce(title,''), coalesce(summary,''))")},' ') IF regexp_matches(x,'^\p{{Lu}}')])),'|') entities FROM cache_single""",
        "snippets": f"SELECT doc_id, CASE WHEN length(t)>220 THEN rtrim(substr(t,1,220))||'…' ELSE t END snippet FROM (SELECT doc_id, {_collapse('text')} t FROM documents)",
        "age_strings": """SELECT event_id, CASE WHEN d>0 THEN d||'d '||h||'h' WHEN h>0 THEN h||'h '||m||'m' ELSE m||'m' END age FROM (SELECT event_id, s//86400 d, (s%86400)//3600 h, (s%3600)//60 m
 FROM (SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT, 0) s FROM events))""",
        "html_escaped": "SELECT row_id, md5(replace(replace(replace(replace(replace(coalesce(summary,''),'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')) digest FROM nos_articles",
        "list_parsing": f"SELECT row_id, len(ws) items, array_to_string(ws,'+') joined FROM (SELECT row_id, {_WORDS.format(x='title', n=3)}[1:4] ws FROM nos_articles)",
        "gazetteer_build": f"WITH {_GAZ} SELECT name, country FROM g",
        "place_mentions": _PLACES + " SELECT row_id, pos, place FROM m",
        "country_vote": _VOTE + " SELECT * FROM cv",
        "country_filter": _VOTE + " SELECT row_id, country, score FROM cv WHERE country IN ('NL','BE') AND score>=0.6",
        "bbox_first": _FIRST + f""", sx AS (SELECT row_id id, {", ".join(f"{_sector_score(ks)} s_{x}" for x, _, ks in sector.LEXICON)} FROM nos_articles), sb AS (SELECT id, {_CODE} sector FROM sx)
 SELECT b.row_id, b.place, b.lat, b.lon, a.title, a.url, a.feed, a.published, sb.sector FROM b JOIN nos_articles a ON a.row_id=b.row_id JOIN sb ON sb.id=b.row_id""",
        "heatmap": _FIRST + " SELECT lat, lon, count(*) n FROM b GROUP BY ALL",
        "map_funnel": _FIRST + """, kn AS (SELECT DISTINCT m.row_id FROM m JOIN c ON lower(m.place)=c.k)
 SELECT (SELECT count(*) FROM nos_articles) AS "rows", (SELECT count(DISTINCT row_id) FROM m) with_places, (SELECT count(*) FROM nos_articles WHERE row_id NOT IN (SELECT row_id FROM m)) AS empty, (SELECT count(*) FROM kn) any_cached, (SELECT count(*) FROM b) in_box, (SELECT count(*) FROM b) plotted""",
        "geo_missing": rf"""WITH p AS (SELECT DISTINCT lower(unnest(regexp_extract_all({_RAW}, 'in ([A-Z][a-z]+)', 1))) place FROM nos_articles)
 SELECT place FROM p WHERE length(place)>=3 AND place NOT IN ('maandag','dinsdag','woensdag','donderdag','vrijdag','zaterdag','zondag','vandaag') AND place NOT IN (SELECT lower({_collapse('place')}) FROM geocode_cache)""",
        "province_membership": _PLACES + " SELECT DISTINCT row_id FROM m WHERE lower(place) IN (SELECT lower(trim(place)) FROM geocode_cache WHERE lat BETWEEN 50.7 AND 51.8 AND lon BETWEEN 5.0 AND 6.3)",
        "rule_votes": f"WITH {_VOTES} SELECT id, " + ", ".join(r.name for r in weak.RULES) + " FROM v",
        "rule_coverage": _coverage(),
        "posterior_filter": f"WITH {_VOTES} SELECT id, round(p,6) p FROM (SELECT id, {_posterior(weak.RULES)} p FROM v) WHERE round(p,6)>=0.6",
        "adaptive_label": f"WITH {_VOTES} SELECT id, (cyber=1 OR property_crime=1)::INT signal, CASE WHEN (cyber=1 OR property_crime=1) AND {_posterior(weak.RULES)}>=0.05 THEN 1 ELSE 0 END AS label FROM v",
        "two_layer_filter": f"WITH {_VOTES}, p AS (SELECT id, {_posterior(weak.RULES[:4])} a, {_posterior(weak.RULES[4:8])} b FROM v) SELECT id, round(a,6) a, round(b,6) b FROM p WHERE greatest(a,1-a)>=0.75 AND greatest(b,1-b)>=0.75",
        "sector_scores": f"WITH {_SECT} SELECT id, " + ", ".join(f"s_{x}" for x, _, _ in sector.LEXICON) + " FROM s",
        "sector_best": f"WITH {_SECT}, {_BEST} SELECT id, code, name, score FROM bs",
        "sector_primary": _SECTORS + f' SELECT id, "primary", {_named()} primary_name, sectors, companies FROM ar',
        "sector_report": _SECTORS + ' SELECT "primary", count(*) articles, sum(companies)::BIGINT companies, round(count(*)*100.0/sum(count(*)) OVER (),4) percent FROM ar GROUP BY "primary"',
        "victim_window": _SECTORS + ' SELECT id, (rn-1)::INT AS "at", nm AS name, affected FROM ca',
        "tfidf_top10": _TFIDF + " SELECT doc_id, rank, term, w FROM top",
        "keyword_global_top20": _TFIDF + " SELECT term, round(sum(w),6) score, count(*) mentions FROM top GROUP BY 1 ORDER BY score DESC, mentions DESC, term LIMIT 20",
        "keyword_stats": _TFIDF + " SELECT term, count(*) mentions, round(sum(w),6) score FROM top GROUP BY 1",
        "keyword_trend": _trend(f"SELECT strftime(published_at,'%Y-%m') AS month, unnest(list_distinct({_WORDS.format(x="concat_ws(' ', coalesce(title,''), coalesce(text,''))", n=5)})) word FROM documents WHERE published_at IS NOT NULL", "WHERE word IN ('inbraak','droogte','ransomware','griepgolf','faillissement')", 3),
        "order_trend": _trend("SELECT strftime(o_orderdate,'%Y-%m') AS month, o_orderpriority word FROM orders", "", 6),
        "split_by_hash": "SELECT doc_id, CASE WHEN ('0x'||substr(md5(doc_id::VARCHAR),1,4))::INT % 5 = 0 THEN 'test' ELSE 'train' END split FROM documents",
        "text_search": "SELECT row_id FROM (SELECT row_id, lower(concat_ws(chr(1), coalesce(title,''), coalesce(summary,''), coalesce(full_text,''))) h FROM nos_articles) WHERE contains(h,'in de nacht') AND (contains(h,'inbraak') OR contains(h,'ransomware')) AND NOT contains(h,'museum')",
        "filter_combo": f"WITH {_VOTES} SELECT id FROM v WHERE contains(lower(concat_ws(chr(1), title, summary)),'de') AND feed_key IN ('bd','l3','rtv_oever') AND {_posterior(weak.RULES)}>=0.15 AND ({_RFC_ANY})::TIMESTAMPTZ::TIMESTAMP::DATE BETWEEN DATE '2025-01-01' AND DATE '2025-12-31'",
        "sector_filter": _SECTORS + """ SELECT id, "primary" FROM ar WHERE "primary" IN ('J','K') OR list_has_any(string_split(sectors,'|'), ['J','K'])""",
        "place_tag_filter": _PLACES + " SELECT DISTINCT row_id FROM m WHERE contains(lower(place),'burg') OR contains(lower(place),'dijk')",
        "quick_range": """WITH o AS (SELECT o_orderdate::DATE AS day FROM orders), m AS (SELECT max(day) hi FROM o), q AS (SELECT unnest(['30d','90d','1y','all']) AS "range", unnest([30,90,365,100000]) AS k)
 SELECT "range", strftime(day,'%Y-%m-%d') AS day, count(*) n FROM o, m, q WHERE o.day >= hi - k::INT GROUP BY ALL""",
        "date_bounds": "SELECT strftime(min(o_orderdate),'%Y-%m-%d') lo, strftime(max(o_orderdate),'%Y-%m-%d') hi FROM orders",
        "feed_options": "SELECT DISTINCT trim(feed, ' ') feed FROM nos_articles WHERE feed IS NOT NULL",
        "spotlight": """WITH c AS (SELECT c_custkey, c_acctbal, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey) SELECT c_custkey, c_acctbal, n_name FROM c WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name='EUROPE')
 UNION (SELECT c_custkey, c_acctbal, n_name FROM c ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5)""",
        "alphanumeric_order": "SELECT p_name, row_number() OVER (ORDER BY NOT regexp_matches(p_name,'^[0-9]'), lower(p_name), p_name) n FROM (SELECT DISTINCT p_name FROM part) ORDER BY n LIMIT 5",
        "title_jaccard_pairs": f"WITH nd AS (SELECT id, {_TOK} tk FROM cache_single), p AS (SELECT DISTINCT x.id a, y.id b FROM (SELECT id, unnest(tk) t FROM nd) x JOIN (SELECT id, unnest(tk) t FROM nd) y ON x.t=y.t AND x.id<y.id) SELECT a, b, round(sim,6) sim FROM (SELECT p.a, p.b, {_JAC.format(a='x.tk', b='y.tk')} sim FROM p JOIN nd x ON a=x.id JOIN nd y ON b=y.id) WHERE sim>=0.6",
        "entity_jaccard_pairs": f"WITH nd AS (SELECT id, {_ENT} tk FROM cache_single), p AS (SELECT x.id a, y.id b, count(*) k FROM (SELECT id, unnest(tk) t FROM nd) x JOIN (SELECT id, unnest(tk) t FROM nd) y ON x.t=y.t AND x.id<y.id GROUP BY ALL) SELECT a, b, round(k/(len(x.tk)+len(y.tk)-k)::DOUBLE,6) sim FROM p JOIN nd x ON a=x.id JOIN nd y ON b=y.id WHERE k/(len(x.tk)+len(y.tk)-k)::DOUBLE >= 0.3",
        "cosine_pairs": "SELECT a, b, round(sim,5) sim FROM (SELECT x.vec_id a, y.vec_id b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) sim FROM embeddings x JOIN embeddings y ON x.label=y.label AND x.vec_id<>y.vec_id WHERE x.vec_id%20=0) WHERE sim>=0.3",
        "tfidf_title_weights": f"WITH {_GRAMS} SELECT id, term, round(w,6) w FROM gw",
        "dup_edges": _EDGES + " SELECT a, b FROM ed",
        "feed_alias_exact": """WITH p AS (SELECT feed_key, trim(feed,' ') alias, count(*) n FROM nos_articles WHERE feed IS NOT NULL GROUP BY ALL),
 b AS (SELECT feed_key, arg_min(alias, struct_pack(n:=-n, a:=alias)) canonical FROM p GROUP BY 1), a AS (SELECT alias, min(canonical) canonical FROM p JOIN b USING(feed_key) WHERE n>1 GROUP BY 1)
 SELECT row_id, coalesce(canonical, trim(coalesce(feed,''),' ')) canonical FROM nos_articles LEFT JOIN a ON alias=trim(coalesce(feed,''),' ')""",
        "run_state": f"""SELECT coalesce(s.feed_key,k.feed_key) feed_key, epoch(greatest({_CURSOR}, k.m))::BIGINT cursor, coalesce(k.n,0) added, '2026-01-31T12:00:00Z' last_run_ts, coalesce(k.feed_key || '.json', s.last_file) last_file
 FROM rss_state s FULL JOIN (SELECT feed_key, max({_TS}) m, count(*) n FROM cache_single GROUP BY 1) k ON s.feed_key=k.feed_key""",
        "seen_ids": "SELECT DISTINCT id FROM cache_single WHERE id IS NOT NULL ORDER BY id",
        "oov_replaced": f"""WITH t AS (SELECT doc_id, unnest(ws) term, generate_subscripts(ws,1) pos FROM (SELECT doc_id, {_WORDS.format(x='text', n=2)} ws FROM documents)), v AS (SELECT term FROM t GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 500)
 SELECT doc_id, md5(string_agg(CASE WHEN v.term IS NULL THEN '<unk>' ELSE t.term END, ' ' ORDER BY pos)) digest, count(*) FILTER (v.term IS NULL) AS "unknown" FROM t LEFT JOIN v ON t.term=v.term GROUP BY doc_id""",
        "place_narrowing": _NARROW + " SELECT row_id, place FROM nr",
        "narrowing_stats": _NARROW + """, bc AS (SELECT row_id, count(*) b FROM p GROUP BY 1), ac AS (SELECT row_id, count(*) a FROM nr GROUP BY 1), j AS (SELECT coalesce(b,0) b, coalesce(a,0) a FROM nos_articles x LEFT JOIN bc ON x.row_id=bc.row_id LEFT JOIN ac ON x.row_id=ac.row_id)
 SELECT count(*) total, count(*) FILTER (b>1 AND a=1) narrowed, count(*) FILTER (a=b) unchanged, count(*) FILTER (b=0) AS "none", round(count(*) FILTER (b>1 AND a=1)/greatest(count(*),1)::DOUBLE,6) ratio FROM j""",
        "sector_columns": _SECTORS + f' SELECT c.id, c.title, c.feed_key, ar."primary", {_named()} primary_name, sectors, companies FROM ar JOIN cache_single c ON c.id=ar.id',
        "sector_totals": _SECTORS + """, kc AS (SELECT count(*) FILTER (sc<>'unknown') k FROM cc)
 SELECT count(*) articles, count(*) FILTER ("primary"<>'unknown') classified, round(count(*) FILTER ("primary"<>'unknown')*100.0/count(*),4) classified_pct, count(*) FILTER (companies>0) with_companies, sum(companies)::BIGINT companies,
 any_value(k) companies_classified, round(any_value(k)*100.0/sum(companies),4) companies_classified_pct, count(*) FILTER (contains(sectors,'|')) multi_sector, round(sum(companies)/count(*)::DOUBLE,4) mean_companies FROM ar, kc""",
        "sector_samples": _SECTORS + """ (SELECT 'article' kind, id, replace(sectors,'|',', ') what FROM ar WHERE contains(sectors,'|') ORDER BY id LIMIT 3)
 UNION ALL (SELECT 'company', cw.id, nm || ' ' || sc FROM cc JOIN cw ON cc.id=cw.id AND cc.rn=cw.rn WHERE cc.rn<=2 AND sc<>'unknown' ORDER BY cw.id, cw.rn LIMIT 5)""",
        "sector_options": _SECTORS + f""" SELECT DISTINCT "primary", {_named()} || ' (' || "primary" || ')' with_code, {_named()} plain FROM ar""",
        "search_cases": """WITH h AS (SELECT row_id, lower(concat_ws(chr(1), coalesce(title,''), coalesce(summary,''), coalesce(full_text,''))) h FROM nos_articles)
 SELECT row_id, 'and' kind FROM h WHERE contains(h,'inbraak') AND contains(h,'politie') UNION ALL SELECT row_id, 'or' FROM h WHERE contains(h,'inbraak') OR contains(h,'ransomware')
 UNION ALL SELECT row_id, 'or_lower' FROM h WHERE contains(h,'inbraak') OR contains(h,'ransomware') UNION ALL SELECT row_id, 'bar' FROM h WHERE contains(h,'inbraak') OR contains(h,'droogte')
 UNION ALL SELECT row_id, 'not' FROM h WHERE contains(h,'inbraak') AND NOT contains(h,'museum') UNION ALL SELECT row_id, 'phrase' FROM h WHERE contains(h,'in de nacht')
 UNION ALL SELECT row_id, 'mixed' FROM h WHERE contains(h,'gemeente') AND (contains(h,'inbraak') OR contains(h,'droogte') OR contains(h,'ransomware')) UNION ALL SELECT row_id, 'only_not' FROM h WHERE NOT contains(h,'de')""",
        "preset_roundtrip": """SELECT row_id, feed_key FROM nos_articles WHERE feed_key IN ('bd','l3') AND (contains(lower(concat_ws(chr(1), title, summary, full_text)),'inbraak') OR contains(lower(concat_ws(chr(1), title, summary, full_text)),'droogte'))""",
        "spotlight_table": f"""WITH {_GAZ}, {_mentions("cache_single", "id")}, a AS (SELECT *, {_TS} ts FROM cache_single), top AS (SELECT id FROM a WHERE ts IS NOT NULL ORDER BY ts DESC, id LIMIT 5),
 near AS (SELECT lower({_collapse("place")}) k FROM geocode_cache WHERE lat BETWEEN 50.7 AND 51.8 AND lon BETWEEN 5.0 AND 6.3), ins AS (SELECT DISTINCT id FROM m WHERE lower(place) IN (SELECT k FROM near)),
 {_SECT}, {_BEST}, y AS (SELECT a.id, feed_key source, title, bs.name sector, strftime(ts AT TIME ZONE 'UTC','%Y-%m-%d %H:%M') AS date, greatest(epoch(TIMESTAMP '2026-12-31 00:00:00')::BIGINT-floor(epoch(ts))::BIGINT, 0) sec, url FROM a JOIN bs ON a.id=bs.id WHERE ts IS NOT NULL AND (a.id IN (SELECT id FROM top) OR a.id IN (SELECT id FROM ins)))
 SELECT id, source, title, sector, date, CASE WHEN sec//86400>0 THEN (sec//86400)||'d '||(sec%86400//3600)||'h' WHEN sec%86400//3600>0 THEN (sec%86400//3600)||'h '||(sec%3600//60)||'m' ELSE (sec%3600//60)||'m' END age, url FROM y""",
        "leader_clusters": _LEAD + " SELECT id, leader FROM lc",
        "cluster_stats": _LEAD + """, z AS (SELECT leader, count(*) n FROM lc GROUP BY 1) SELECT sum(n)::BIGINT AS "rows", count(*) FILTER (n>1) AS "groups", max(n) largest, round(avg(n) FILTER (n>1),6) mean_size FROM z""",
        "cluster_rollup": _LEAD + f""", j AS (SELECT leader, c.id, {_TS} ts, feed_key, url, summary FROM lc JOIN cache_single c ON c.id=lc.id),
 g AS (SELECT leader, count(*) size, list(feed_key ORDER BY ts IS NULL, ts, id) fs, list(url ORDER BY ts IS NULL, ts, id) us, list(summary ORDER BY ts IS NULL, ts, id) ms FROM j GROUP BY 1)
 SELECT leader, size, array_to_string([f FOR f, i IN fs IF f IS NOT NULL AND list_position(fs,f)=i],'|') sources, len(list_distinct(us)) urls, md5(array_to_string([m FOR m, i IN ms IF m IS NOT NULL AND list_position(ms,m)=i],' | ')) digest FROM g""",
        "exact_copies": "SELECT md5(text) digest, min(doc_id) AS first, count(*) size, count(DISTINCT source) sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*)>1",
    }
