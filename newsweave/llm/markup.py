"""Markup residue to clean text, with a site style tree per host.

A field is parsed into nodes of four languages (HTML, Markdown, wiki, LaTeX). The trees of one host are merged: a style
node is (host, path), and its importance is the entropy of the contents seen under it, normalised by the pages that
hold it. A node that shows the same content on page after page is presentation; its branch is removed from every page.
What remains is written as plain text in which headings (``# ``), list items (``- ``), code (fenced), table rows
(`` | ``) and formulas (``$ $``) stay recognisable.

Defined results: null or blank fields have no nodes and clean to themselves; signs used as such in prose (prices,
comparisons, bracketed remarks, single stars, account names, menu separators) are no nodes. Fields of any length are
parsed whole, with one scan per pattern. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names that count as HTML.
HTML_TAGS = set(
    "a abbr article aside b blockquote body br button caption cite code dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html i iframe img input ins label li link main mark meta nav noscript ol option p pre q s script section select "
    "small source span strike strong style sub summary sup svg table tbody td tfoot th thead time title tr tt u ul video audio center".split()
)
VOID = {"br", "img", "hr", "input", "meta", "link", "source"}
DROPPED = ("script", "style", "noscript", "iframe", "svg", "head", "select", "form", "button")
#: Cheap test in the JVM for a field that may hold markup.
MAYBE = (
    r"<[a-zA-Z/!]|&(?:[a-zA-Z]\w*|#\w+);|\*\S|`|\\[a-zA-Z(\[]|\$[^$\n]*[\\^_=][^$\n]*\$|\[\[|\]\(|\[https?:|\{\{|\{\||~~|''|(?<!\w)_"
    r"|(?m)^[ \t]*(?:[-+>*#] |#{2,6} |={2}|\|-|\|\}|\|.*\||~~~|\d{1,3}\. )"
)

_TAG = r"</?(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])[^<>]*>"
_ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});"
_LINES = lambda item: rf"(?m)^[ \t]*{item}[ \t]+\S[^\n]*(?:\n[ \t]*{item}[ \t]+\S[^\n]*)+"
_PATTERNS: list[tuple[str, str, re.Pattern]] = [
    ("html", "comment", re.compile(r"<!--.*?(?:-->|$)", re.S)),
    ("html", "tag", re.compile(_TAG)),
    ("html", "entity", re.compile(_ENTITY)),
    ("markdown", "fence", re.compile(r"(?m)^[ \t]*(?:```|~~~)")),
    ("markdown", "code", re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("markdown", "strong", re.compile(r"\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*")),
    ("markdown", "em", re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])")),
    ("markdown", "strong", re.compile(r"(?<!\w)__(?=[^\s_])[^\n]*?[^\s_]__(?!\w)")),
    ("markdown", "em", re.compile(r"(?<![\w/])_(?=[^\s_])[^_\n]*[^\s_]_(?!\w)")),
    ("markdown", "strike", re.compile(r"~~(?=\S)[^\n]*?~~")),
    ("markdown", "link", re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?: \"[^\"\n]*\")?\)")),
    ("markdown", "h", re.compile(r"(?m)^#{2,6}[ \t]+\S[^\n]*|(?<!\S )^#[ \t]+(?=\S)[^\n]*$(?!\n#[ \t])", re.M)),
    ("markdown", "quote", re.compile(r"(?m)^>[ \t]+\S")),
    ("markdown", "list", re.compile(_LINES(r"[-+]"))),
    ("markdown", "list", re.compile(_LINES(r"\d{1,3}\."))),
    ("markdown", "table", re.compile(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*\|[-|: \t]*$")),
    ("wiki", "link", re.compile(r"\[\[[^\[\]\n]+\]\]")),
    ("wiki", "link", re.compile(r"(?<!\[)\[https?://[^\s\]]+(?: [^\]\n]*)?\](?!\()")),
    ("wiki", "strong", re.compile(r"'''(?=\S)[^\n]*?'''")),
    ("wiki", "em", re.compile(r"(?<!')''(?=[^\s'])[^'\n]*''(?!')")),
    ("wiki", "h", re.compile(r"(?m)^(={2,6})[ \t]*\S[^\n]*?[ \t]*\1[ \t]*$")),
    ("wiki", "template", re.compile(r"\{\{[^{}]+\}\}")),
    ("wiki", "table", re.compile(r"(?m)^(?:\{\||\|-[ \t]*$|\|\})")),
    ("wiki", "list", re.compile(_LINES(r"[*#]"))),
    ("wiki", "ref", re.compile(r"</?(?:ref|nowiki|gallery)\b[^<>]*>")),
    ("latex", "env", re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}")),
    ("latex", "command", re.compile(r"\\[a-zA-Z]{2,}\*?[ \t]*(?:\[[^\]\n]*\])?\{")),
    ("latex", "item", re.compile(r"(?m)^[ \t]*\\item\b")),
    ("latex", "math", re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)", re.S)),
    ("latex", "math", re.compile(r"\$(?=[^\s$])[^$\n]*[\\^_=][^$\n]*\$")),
]
_ENTITIES = {k.rstrip(";") for k in html.entities.html5}


def _real(kind: str, tag: str, m: re.Match) -> bool:
    if tag == "tag":
        return m["tag"].lower() in HTML_TAGS
    if tag == "entity":
        return m[0][1] == "#" or m[0][1:-1] in _ENTITIES
    if tag == "h" and m[0].startswith("# "):  # a run of such lines is a numbered wiki list
        before = m.string[: m.start()].rstrip("\n").rpartition("\n")[2]
        return not before.startswith("# ") and not m.string[m.end() :].lstrip("\n").startswith("# ")
    return True


def _class(tag: str) -> str:
    m = re.search(r"class\s*=\s*[\"']?([\w-]+)", tag)
    return f".{m[1]}" if m else ""


def nodes(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, path, content) of every node; HTML paths are chains of open elements, others the name of the node."""
    if not text or not text.strip():
        return []
    out: list[tuple[str, str, str]] = []
    escaped = text
    if "&lt;" in text or "&#60;" in text:
        escaped = text.replace("&lt;", "<").replace("&gt;", ">").replace("&#60;", "<").replace("&#62;", ">")
    stack: list[tuple[str, int]] = []
    for m in re.finditer(_TAG, escaped) if "<" in escaped else ():
        name = m["tag"].lower()
        if name not in HTML_TAGS:
            continue
        if m[0][1] == "/":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0].split(".")[0] == name), None)
            if depth is not None:
                out.append(("html", ">".join(s for s, _ in stack[: depth + 1]), escaped[stack[depth][1] : m.start()]))
                del stack[depth:]
            else:
                out.append(("html", name, ""))
        elif name in VOID or m[0].endswith("/>"):
            out.append(("html", ">".join([*(s for s, _ in stack), name]), m[0]))
        else:
            stack.append((name + _class(m[0]), m.end()))
    for i, (_, at) in enumerate(stack):
        out.append(("html", ">".join(s for s, _ in stack[: i + 1]), escaped[at:]))
    for kind, tag, pattern in _PATTERNS:
        if tag != "tag":
            for m in pattern.finditer(text):
                if _real(kind, tag, m):
                    out.append((kind, tag, m[0]))
    return out


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in one field, sorted."""
    return sorted({k for k, _, _ in nodes(text)})


def _long(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields]))
    return df.select(*keys, parts.alias("x")).select(*keys, "x.field", "x.value").where(F.col("value").rlike(MAYBE))


def parse(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, nodes: array of (kind, path, content)) of each field that has a node."""

    @F.pandas_udf("array<struct<kind:string,path:string,content:string>>")
    def dom(v: pd.Series) -> pd.Series:
        return v.map(lambda t: [{"kind": k, "path": p, "content": c} for k, p, c in nodes(t)])

    return _long(df, keys, fields).select(*keys, "field", dom("value").alias("nodes")).where(F.size("nodes") > 0)


def markup_kinds(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind): the kinds of the nodes of each field."""
    tree = parse(df, [key], fields)
    return tree.select(key, "field", F.explode(F.array_distinct(F.transform("nodes", lambda n: n["kind"]))).alias("kind"))


def style_tree(df: DataFrame, key: str, host: str, fields: list[str]) -> DataFrame:
    """(host, kind, path, pages, importance): the merged tree of each host. A page counts once for a path and once for a
    content under it, however often it holds them. Importance is the entropy of the contents over log(pages), 1 for a
    node on one page only: what stands on a single page is its content. Paths and contents are counted before they are
    shuffled."""

    @F.pandas_udf("array<struct<kind:string,path:string,c:bigint>>")
    def merged(values: pd.DataFrame) -> pd.Series:
        out = []
        for row in values.itertuples(index=False):
            seen = {(k, p, _content(c)) for v in row if v is not None for k, p, c in nodes(v)}
            whole = {(k, p, None) for k, p, _ in seen}  # the path itself
            out.append([{"kind": k, "path": p, "c": c} for k, p, c in seen | whole])
        return pd.Series(out)

    some = F.lit(False)
    for f in fields:
        some |= F.coalesce(F.col(f).rlike(MAYBE), F.lit(False))
    rows = df.where(some & F.col(key).isNotNull())
    each = rows.select(host, F.explode(merged(F.struct(*[F.when(F.col(f).rlike(MAYBE), F.col(f)).alias(f) for f in fields]))).alias("n")).select(host, "n.*")
    per = each.groupBy(host, "kind", "path", "c").agg(F.count(F.lit(1)).alias("k"))
    of = F.col("c").isNotNull()
    by = per.groupBy(host, "kind", "path").agg(
        F.max(F.when(~of, F.col("k"))).alias("pages"), F.sum(F.when(of, F.col("k"))).alias("all"), F.sum(F.when(of, F.col("k") * F.log("k"))).alias("s")
    )
    entropy = F.log("all") - F.col("s") / F.col("all")
    importance = F.when(F.col("pages") > 1, F.least(F.round(entropy / F.log("pages"), 6), F.lit(1.0))).otherwise(1.0)
    return by.select(host, "kind", "path", "pages", importance.alias("importance"))


def _content(c: str) -> int:
    h = xxhash.xxh64_intdigest(c.strip())
    return h - (1 << 64) if h >> 63 else h


def to_clean(text: str | None, low: set[str] = frozenset()) -> str | None:
    """One field as clean text; low: HTML paths whose branch is removed."""
    if not text:
        return text
    t = text.replace("&lt;", "<").replace("&gt;", ">") if re.search(r"&lt;/?[a-zA-Z]", text) else text
    t = re.sub(r"(?s)<!--.*?(?:-->|$)", " ", t)
    t = re.sub(rf"(?is)<({'|'.join(DROPPED)})\b[^<>]*>.*?(?:</\1>|$)", " ", t)
    if low and "<" in t:
        t = _prune(t, low)
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    # code and formulas are set aside as they are
    t = re.sub(r"(?is)<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", lambda m: keep("\n```\n" + m[1].strip("\n") + "\n```\n"), t)
    t = re.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: keep("\n```\n" + m[2].strip("\n") + "\n```\n"), t)
    t = re.sub(r"(?ms)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```[ \t]*$", lambda m: keep("```\n" + m[1] + "```"), t)
    t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", t)
    t = re.sub(r"\\\[(.*?)\\\]|\\\((.*?)\\\)", lambda m: keep("$" + (m[1] or m[2]).strip() + "$"), t, flags=re.S)
    t = re.sub(r"\$(?=[^\s$])([^$\n]*[\\^_=][^$\n]*)\$", lambda m: keep(m[0]), t)
    # LaTeX
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", r"\n# \1\n", t)
    t = re.sub(r"~?\\cite\w*\{[^{}]*\}|\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\{[^{}]*\})?", "", t)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"(?m)^[ \t]*\\item[ \t]*", "- ", t)
    for _ in range(3):
        t = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    # wiki
    t = re.sub(r"(?m)^(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", r"# \2", t)
    t = re.sub(r"\{\{[^{}]*\}\}|\[\[(?:Categorie|Category|Bestand|File):[^\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"(?<!\[)\[https?://[^\s\]]+ ?([^\]\n]*)\](?!\()", r"\1", t)
    t = re.sub(r"'{2,5}(?=\S)([^\n]*?)'{2,5}", r"\1", t)
    t = re.sub(r"(?m)^\{\|[^\n]*\n?|^\|-[ \t]*\n?|^\|\}[ \t]*\n?", "", t)
    t = re.sub(r"(?m)^[ \t]*\|[ \t]*(.*?)[ \t]*\|?[ \t]*$", r"\1", t)
    t = re.sub(r"(?m)^\*[ \t]+|^#[ \t]+(?=[^\n]*\n#[ \t])|(?<=\n)#[ \t]+(?=[^\n]*: \d+$)", "- ", t)
    # Markdown
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"(?m)^#{2,6}[ \t]+", "# ", t)
    t = re.sub(r"(?m)^>[ \t]+", "", t)
    t = re.sub(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*\|[-|: \t]*\n?", "", t)
    t = re.sub(r"(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1", r"\2", t)
    t = re.sub(r"(?<!\w)(_{1,2})(?=[^\s_])([^\n]*?[^\s_])\1(?!\w)", r"\2", t)
    t = re.sub(r"~~(?=\S)([^\n]*?)~~", r"\1", t)
    # HTML
    t = re.sub(r"(?i)<h[1-6]\b[^<>]*>\s*", "\n# ", t)
    t = re.sub(r"(?i)<li\b[^<>]*>\s*", "\n- ", t)
    t = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t)
    t = re.sub(r"(?i)</?(?:p|div|br|ul|ol|li|h[1-6]|table|tr|blockquote|section|article|figure|hr)\b[^<>]*>", "\n", t)
    t = re.sub(_TAG, lambda m: "" if m["tag"].lower() in HTML_TAGS else m[0], t)
    t = html.unescape(t).replace("\xa0", " ") if "&" in t else t.replace("\xa0", " ")
    t = re.sub(r"[ \t]{2,}", " ", t)
    t = re.sub(r"\ue000(\d+)\ue001", lambda m: kept[int(m[1])], t)
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", t).strip()


def _prune(t: str, low: set[str]) -> str:
    stack: list[str] = []
    cut: list[tuple[int, int]] = []
    open_at: list[tuple[int, int]] = []
    for m in re.finditer(_TAG, t):
        name = m["tag"].lower()
        if name not in HTML_TAGS or name in VOID:
            continue
        if m[0][1] == "/":
            d = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].split(".")[0] == name), None)
            if d is not None:
                del stack[d:]
                if open_at and d <= open_at[-1][0]:
                    cut.append((open_at.pop()[1], m.end()))
        else:
            stack.append(name + _class(m[0]))
            if not open_at and ">".join(stack) in low:
                open_at.append((len(stack) - 1, m.start()))
    for a, b in reversed(cut):
        t = t[:a] + "\n" + t[b:]
    return t


def clean_fields(df: DataFrame, key: str, host: str, fields: list[str], least: float = 0.3, min_pages: int = 8) -> DataFrame:
    """df with ``<field>_clean``: branches whose style node has an importance under ``least`` on at least ``min_pages``
    pages are removed, the rest is written as clean text. The low nodes of a host are a set of paths; they are joined
    on the host, so nothing is collected and Spark broadcasts them only while they are small."""
    low = style_tree(df, key, host, fields).where((F.col("kind") == "html") & (F.col("importance") < least) & (F.col("pages") >= min_pages))
    low = low.groupBy(F.col(host).alias("_host")).agg(F.array_sort(F.collect_set("path")).alias("_low"))

    @F.pandas_udf("string")
    def clean(v: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([to_clean(t, set(p) if p is not None else frozenset()) for t, p in zip(v, paths)], dtype=object)

    joined = df.join(low, df[host] == low["_host"], "left")
    named = {f"{f}_clean": F.when(F.col(f).rlike(MAYBE), clean(F.when(F.col(f).rlike(MAYBE), F.col(f)), F.col("_low"))).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(named).drop("_host", "_low")
