"""SQL for DuckDB of the training-data queries that SQL can express, by brute force over all pairs and windows."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"
_PLAIN = "strip_accents(lower(coalesce(text,'')))"


def _windows(table: str, key: str) -> str:
    return rf"(SELECT DISTINCT {key}, array_to_string(w[i:i+14],' ') g FROM (SELECT {key}, w, unnest(range(1, len(w)-13)) i FROM (SELECT {key}, {_WORDS.format(x=_PLAIN)} w FROM {table}) WHERE len(w)>14))"


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM {_windows('documents', 'doc_id')} JOIN {_windows('eval_items', 'item_id')} USING(g)"

_BARE = "split_part(trim(coalesce(url,'')), '#', 1)"
_CANON = rf"""regexp_replace(CASE WHEN strpos({_BARE},'?')=0 THEN {_BARE} WHEN regexp_matches(lower(substr({_BARE}, strpos({_BARE},'?')+1)), 'utm_|fbclid=|gclid=')
  THEN substr({_BARE},1,strpos({_BARE},'?')-1) ELSE {_BARE} END, '/+$', '')"""
_BODY = "lower(CASE WHEN trim(coalesce(full_text,''))<>'' THEN full_text ELSE coalesce(summary,'') END)"


def _runs(table: str, key: str) -> str:
    return rf"(SELECT DISTINCT {key}, w[pos_] || ' ' || w[pos_+1] || ' ' || w[pos_+2] g FROM (SELECT {key}, w, unnest(range(1, len(w)-1)) pos_ FROM (SELECT {key}, {_WORDS.format(x=_BODY)} w FROM {table}) WHERE len(w)>2))"


# every row against the whole history by shared runs, then the rows in order against those accepted before them
_HISTORY = rf"""WITH RECURSIVE bt AS MATERIALIZED (SELECT row_id, {_CANON} curl, full_text, summary, row_number() OVER (ORDER BY batch_no, pos, row_id) i FROM merge_batch),
hs AS MATERIALIZED {_runs('cache_single', 'id')}, bs AS MATERIALIZED {_runs('bt', 'i')}, hn AS (SELECT id, count(*) n FROM hs GROUP BY 1), bn AS (SELECT i, count(*) n FROM bs GROUP BY 1),
known AS MATERIALIZED (SELECT i, min(id) id FROM (
  SELECT i, p.id FROM (SELECT i, id, count(*) k FROM bs JOIN hs USING(g) GROUP BY ALL) p JOIN hn USING(id) JOIN bn USING(i) WHERE 2*k >= hn.n+bn.n-k
  UNION ALL SELECT i, id FROM bt JOIN cache_single c ON c.canonical_url=bt.curl WHERE curl<>'') GROUP BY 1),
links AS (SELECT p.a, p.b FROM (SELECT x.i a, y.i b, count(*) k FROM bs x JOIN bs y ON x.g=y.g AND y.i<x.i GROUP BY ALL) p JOIN bn m ON m.i=p.a JOIN bn n ON n.i=p.b WHERE 2*k >= m.n+n.n-k
  UNION SELECT x.i, y.i FROM bt x JOIN bt y ON x.curl=y.curl AND y.i<x.i WHERE x.curl<>''),
od AS MATERIALIZED (SELECT bt.i, coalesce(list(b) FILTER (b IS NOT NULL), []) ns FROM bt LEFT JOIN links ON a=bt.i WHERE bt.i NOT IN (SELECT i FROM known) GROUP BY 1),
ok AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY i) q FROM od),
r AS (SELECT 0::BIGINT q, NULL::BIGINT i, NULL::BIGINT of, []::BIGINT[] ls UNION ALL
  SELECT z.q, z.i, z.x, CASE WHEN z.x IS NULL THEN list_append(z.ls, z.i) ELSE z.ls END FROM (SELECT ok.q, ok.i, r.ls, list_min(list_intersect(ok.ns, r.ls)) x FROM r JOIN ok ON ok.q=r.q+1) z),
found AS (SELECT row_id, id kept_id FROM known JOIN bt USING(i) UNION ALL SELECT a.row_id, sha256(b.curl) FROM r JOIN bt a ON a.i=r.i JOIN bt b ON b.i=r.of WHERE r.of IS NOT NULL)"""


def sql() -> dict[str, str]:
    return {
        "p1_found": _HISTORY + " SELECT row_id, kept_id FROM found",
        "p1_accepted": _HISTORY + " SELECT m.row_id, m.batch_no, m.feed_key, bt.curl canonical_url, sha256(bt.curl) id FROM merge_batch m JOIN bt USING(row_id) WHERE m.row_id NOT IN (SELECT row_id FROM found)",
        "p8_found": _LEAKS,
        "p8_items": f"WITH f AS ({_LEAKS}) SELECT i.item_id, i.suite, (SELECT count(*) FROM f WHERE f.item_id=i.item_id) docs FROM eval_items i",
    }
