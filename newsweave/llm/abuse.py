"""Abusive, hateful and sexual content, scored by factorization machines over hashed terms.

Every sentence is a bag of hashed terms: words with veiled spellings undone (digits and signs for letters, letters apart,
repeated or starred letters, look-alike letters), names as one class, and words inside quotation marks as terms of
their own, so that a reported insult differs from a said one. For each category a factorization machine adds a weight
for each term and learned interactions for each pair, which tell an insult beside a group mention from either alone. A
document's score is that of its worst sentence. Labels are of documents, so training is by multiple instances: the
sentences of a labelled document that score highest stand for its label, in rounds that start from log-odds of terms.

The labelled sample that a model is fitted on is bounded (``MAX_LABELLED`` documents, the least by seeded hash, and of their sentences without a label at most twice
``MAX_NEGATIVES``);
scoring covers every document and every sentence. The model has a fixed size, whatever the data.

Defined results: null or empty texts score 0 in all categories; labels are trimmed and lower-cased, repeated labels
count once, labels of other categories are ignored; with no label of a category all its scores are 0; null sources are
reported as a source of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.lookalikes import IGNORABLE, LOOKALIKES

CATEGORIES = ("abuse", "hate", "sexual")
MAX_LABELLED, MAX_NEGATIVES, SPACE, FACTORS, SEED = 20_000, 5_000, 1 << 16, 6, 11

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?…]+(?=[\s\"'”’)]|$)|\n|(?<!\w)[\"'“„‘«]|[\"'”’»](?!\w)")
_VEIL = re.compile(r"[*@$€]\w|\w[*@$]|[^\W\d_]\d|\d[^\W\d_]|\b\w[.\-_ ]\w[.\-_ ]\w\b|([^\W\d_])\1\1|[­​-‍⁠﻿Ͱ-ӿＡ-ｚ]")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_ ]){2,}[^\W\d_](?!\w)")
_STARRED = re.compile(r"[^\W_]*\*+[^\W_]+|[^\W_]+\*+")
# Digits and signs written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i"})
_MIXED = re.compile(r"(?=\w*[^\W\d_])(?=[^\s]*[\d@$])[\w@$]+")


def unveil(text: str, lexicon: dict[int, list[str]] | None = None) -> str:
    """text with veiled spellings undone; starred letters are filled from the lexicon (words by length)."""
    if any(ord(c) > 0x36F or c == "\xad" for c in text):
        text = "".join("" if c in IGNORABLE else LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKC", text))
    text = _APART.sub(lambda m: re.sub(r"[.\-_ ]", "", m[0]), text)
    if "*" in text:
        text = _STARRED.sub(lambda m: _fill(m[0], lexicon), text)
    return _MIXED.sub(lambda m: m[0] if sum(c.isdigit() for c in m[0]) * 2 > len(m[0]) + 1 else m[0].translate(_LEET), text)


def _fill(word: str, lexicon: dict[int, list[str]] | None) -> str:
    low = word.lower().translate(_LEET)
    pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in low))
    for w in (lexicon or {}).get(len(word), ()):
        if pattern.fullmatch(w):
            return w
    return word.replace("*", "")


def _fold(word: str, known: dict[str, str]) -> str:
    """Lower case, no accents, no letter twice in a row."""
    f = known.get(word)
    if f is None:
        w = word.lower()
        if not w.isascii():
            w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        f = known[word] = re.sub(r"(.)\1+", r"\1", w)
    return f


def sentences(text: str | None, known: dict[str, str], lexicon: dict[int, list[str]] | None = None) -> list[list[str]]:
    """Terms of each sentence."""
    if not text:
        return []
    if _VEIL.search(text):
        text = unveil(text, lexicon)
    out: list[list[str]] = []
    now: list[str] = []
    quoted = False
    for t in _TOKEN.findall(text):
        c = t[0]
        if c.isalpha():
            if now and c.isupper() and not (len(t) > 1 and t[1].isupper()):
                f = "<name>"
            else:
                f = known.get(t) or _fold(t, known)
            now.append("q:" + f if quoted else f)
        elif c in "\n.!?…":
            if now:
                out.append(now)
                now = []
            if c == "\n":
                quoted = False
        elif c in "“„‘«":
            quoted = True
        elif c in "”’»":
            quoted = False
        elif c in "\"'":
            quoted = not quoted
        else:
            now.append("<number>")
    if now:
        out.append(now)
    return out


def term_id(term: str) -> int:
    return xxhash.xxh32_intdigest(term, 7) % SPACE


class Machine:
    """A factorization machine with logistic loss: bias, weights, factors over SPACE hashed terms."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.b = -3.0
        self.w = np.zeros(SPACE, "f4")
        self.v = rng.normal(0, 0.02, (SPACE, FACTORS)).astype("f4")

    def raw(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of sentences: ids of their terms one after the other, where each starts, how many it has."""
        x = (1 / np.sqrt(np.maximum(length, 4))).astype("f4")
        lin = np.add.reduceat(self.w[ids], start)
        v = self.v[ids]
        s, q = np.add.reduceat(v, start, axis=0), np.add.reduceat(v * v, start, axis=0)
        return self.b + x * lin * 2 + 0.5 * x * x * (s * s - q).sum(axis=1)

    def fit(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> None:
        """Adam on the whole (deduplicated) sample."""
        used, at = np.unique(ids, return_inverse=True)
        w, v, b = self.w[used].copy(), self.v[used].copy(), self.b
        x = (1 / np.sqrt(np.maximum(length, 4))).astype("f4")
        row = np.repeat(np.arange(len(start)), length)
        xr = x[row]
        m = [np.zeros_like(w), np.zeros_like(v), 0.0]
        r = [np.zeros_like(w), np.zeros_like(v), 0.0]
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(used)))
        weight = weight / weight.sum()
        for t in range(1, rounds + 1):
            vi = v[at]
            s, q = np.add.reduceat(vi, start, axis=0), np.add.reduceat(vi * vi, start, axis=0)
            z = b + 2 * x * np.add.reduceat(w[at], start) + 0.5 * x * x * (s * s - q).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y) * weight
            gw = np.add.reduceat((g[row] * 2 * xr)[order], first) + 2e-5 * w
            gv = np.add.reduceat(((g * x * x)[row][:, None] * (s[row] - vi))[order], first, axis=0) + 2e-5 * v
            for k, (p, grad) in enumerate(((w, gw), (v, gv), (b, g.sum()))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                r[k] = 0.99 * r[k] + 0.01 * grad * grad
                step = 0.06 * (m[k] / (1 - 0.9**t)) / (np.sqrt(r[k] / (1 - 0.99**t)) + 1e-7)
                if k == 0:
                    w = w - step
                elif k == 1:
                    v = v - step * 0.5
                else:
                    b = b - float(step)
        self.w[used], self.v[used], self.b = w, v, b


def _flat(sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    ids = []
    for s in sents:
        for t in s:
            i = known.get(t)
            if i is None:
                i = known[t] = term_id(t)
            ids.append(i)
    length = np.array([len(s) for s in sents], "i8")
    return np.array(ids, "i8"), np.concatenate([[0], np.cumsum(length)[:-1]]).astype("i8"), length


def train(texts: list[str], labels: list[set[str]]) -> tuple[dict[str, Machine], dict[int, list[str]]]:
    """Machines per category and the lexicon for starred words. labels: the categories of each text, empty for none."""
    known: dict[str, str] = {}
    docs = [sentences(t, known) for t in texts]
    # sentences with the same terms are one instance that belongs to several documents
    index: dict[tuple, int] = {}
    uniq: list[list[str]] = []
    of: list[list[int]] = []
    for ss in docs:
        mine = []
        for s in ss:
            k = tuple(s)
            if k not in index:
                index[k] = len(uniq)
                uniq.append(s)
            mine.append(index[k])
        of.append(mine)
    machines: dict[str, Machine] = {}
    if not uniq:
        return {c: Machine() for c in CATEGORIES}, {}
    ids, start, length = _flat(uniq)
    n_in = np.zeros(len(uniq))
    for mine in of:
        for i in set(mine):
            n_in[i] += 1
    strong: dict[str, float] = {}
    for c in CATEGORIES:
        pos = [d for d, lab in enumerate(labels) if c in lab and of[d]]
        machine = machines[c] = Machine()
        if not pos:
            machine.b = -30.0
            continue
        in_pos = np.zeros(len(uniq))
        for d in pos:
            for i in set(of[d]):
                in_pos[i] += 1
        # log-odds of terms: documents with and without the label
        df_p, df_n = np.zeros(SPACE), np.zeros(SPACE)
        posset = set(pos)
        for d, mine in enumerate(of):
            terms = {int(t) for i in mine for t in ids[start[i] : start[i] + length[i]]}
            (df_p if d in posset else df_n)[list(terms)] += 1
        odds = np.log((df_p + 0.1) / (len(pos) + 1)) - np.log((df_n + 0.3) / (len(of) - len(pos) + 1))
        odds = np.where(df_p >= 2, odds, np.minimum(odds, 1.0))
        first = np.add.reduceat(odds[ids], start) / np.sqrt(length + 2)
        # a label set by mistake leaves no sentence that stands out: such documents teach nothing
        tops = np.array([max(first[i] for i in of[d]) for d in pos])
        floor = max(0.0, 0.5 * float(np.median(tops)))
        outside = n_in - in_pos
        # negatives: sentences of documents without the label, the likeliest to be confused and a sample of the rest
        neg = np.flatnonzero(outside > 0)
        near = neg[np.argsort(-first[neg], kind="stable")[:MAX_NEGATIVES]]
        rest = np.setdiff1d(neg, near)
        rest = np.sort(np.random.default_rng(SEED).permutation(rest)[:MAX_NEGATIVES])
        scale = (len(neg) - len(near)) / max(len(rest), 1)
        score = first
        for rnd in range(3):
            y = np.zeros(len(uniq))
            for d, top in zip(pos, tops):
                if top < floor:
                    continue
                best = max(score[i] for i in of[d])
                cut = 0.65 * best if rnd == 0 else min(best, 0.5)
                for i in set(of[d]):
                    if score[i] >= cut and first[i] >= 0.6 * floor:
                        y[i] += 1
            chosen = (y > 0) & (y >= 0.3 * n_in)  # what stands mostly elsewhere is none of it
            take = np.concatenate([np.flatnonzero(chosen), near[~chosen[near]], rest[~chosen[rest]]])
            weight = np.concatenate([y[chosen], np.sqrt(outside[near[~chosen[near]]]), np.sqrt(outside[rest[~chosen[rest]]]) * scale])
            k = int(chosen.sum())
            if not k:
                break
            weight[:k] *= max(1.0, 0.2 * weight[k:].sum() / weight[:k].sum())
            sub_len = length[take]
            sub_ids = np.concatenate([ids[start[i] : start[i] + length[i]] for i in take])
            sub_start = np.concatenate([[0], np.cumsum(sub_len)[:-1]]).astype("i8")
            machine.fit(sub_ids, sub_start, sub_len, chosen[take].astype("f8"), weight, 50)
            score = machine.raw(ids, start, length)
        if not score.max() > 0:
            machine.b = min(machine.b, -3.0)
        for i in np.flatnonzero(score > 0):
            for t in uniq[i]:
                strong[t] = max(strong.get(t, 0.0), float(machine.w[term_id(t)]))
    lexicon: dict[int, list[str]] = {}
    for t in sorted(strong, key=lambda t: -strong[t]):
        for form in _surface(t, known):
            lexicon.setdefault(len(form), []).append(form)
    return machines, lexicon


def _surface(term: str, known: dict[str, str]) -> list[str]:
    if term.startswith(("<", "q:")):
        return []
    if "inverse" not in _CACHE or _CACHE["of"] is not known:
        inv: dict[str, set[str]] = {}
        for w, f in known.items():
            inv.setdefault(f, set()).add(w.lower())
        _CACHE.update(inverse=inv, of=known)
    return sorted(_CACHE["inverse"].get(term, ()))


_CACHE: dict = {}


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], list[set[str]]]:
    """The bounded sample: at most MAX_LABELLED labelled documents, least by seeded hash."""
    per = labels.select(F.col(doc_id), F.lower(F.trim("category")).alias("c")).where(F.col(doc_id).isNotNull() & F.col("c").isNotNull())
    per = per.groupBy(doc_id).agg(F.collect_set("c").alias("cs")).orderBy(F.xxhash64(F.col(doc_id), F.lit(SEED)), doc_id).limit(MAX_LABELLED)
    rows = docs.select(doc_id, text).join(F.broadcast(per), doc_id).where(F.col(text).isNotNull()).orderBy(doc_id).collect()  # per: at most MAX_LABELLED
    return [r[text] for r in rows], [set(r.cs) & set(CATEGORIES) for r in rows]


def scores(docs: DataFrame, model: tuple[dict[str, Machine], dict[int, list[str]]], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, abuse, hate, sexual): probabilities of the worst sentence of each document, in one pass."""
    machines, lexicon = model
    share = docs.sparkSession.sparkContext.broadcast((machines, lexicon))  # SPACE x (FACTORS + 1) numbers a category

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ms, lex = share.value
        known: dict[str, str] = {}
        terms: dict[str, int] = {}
        for b in batches:
            if not len(b):
                continue
            ids: list[int] = []
            length: list[int] = []
            count: list[int] = []
            for t in b[text]:
                ss = sentences(t, known, lex)
                count.append(len(ss))
                for s in ss:
                    length.append(len(s))
                    for w in s:
                        i = terms.get(w)
                        if i is None:
                            i = terms[w] = term_id(w)
                        ids.append(i)
            if len(known) > 400_000:
                known.clear()
                terms.clear()
            out = b.drop(columns=[text])
            n = np.array(count)
            for c in CATEGORIES:
                p = np.zeros(len(b))
                if ids:
                    ln = np.array(length, "i8")
                    z = ms[c].raw(np.array(ids, "i8"), np.concatenate([[0], np.cumsum(ln)[:-1]]).astype("i8"), ln)
                    has = np.flatnonzero(n)
                    p[has] = 1 / (1 + np.exp(-np.maximum.reduceat(z, np.concatenate([[0], np.cumsum(n[has])[:-1]]))))
                out[c] = np.round(p, 6)
            yield out

    rows = docs.select(doc_id, *keep, text)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (doc_id, *keep)) + ", abuse double, hate double, sexual double"
    return rows.mapInPandas(run, schema)


def flagged(scored: DataFrame, doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(doc_id, category) of the scores of at least ``least``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES]))
    return scored.select(doc_id, pairs.alias("x")).where(F.col("x.p") >= least).select(doc_id, "x.category")


def source_rates(scored: DataFrame, source: str = "source", least: float = 0.5) -> DataFrame:
    """Per source: documents, and the share of them flagged in each category; counted before the shuffle."""
    rate = [F.round(F.avg((F.col(c) >= least).cast("int")), 6).alias(f"{c}_rate") for c in CATEGORIES]
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), *rate)
