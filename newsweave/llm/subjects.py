"""Subject areas of documents, by label propagation over a document-similarity graph.

Documents are similar through the terms that they share. The graph is kept in its factored form, document - term -
document, so that no pairs are written, and an edge is verified before it carries labels: a term counts by how far its
labels agree (the entropy of its subjects), so words of any subject carry nothing, and a sentence passes on only what
its clearest terms say. A round carries the documents' labels to their terms and the terms' back to the documents:
each sentence takes the subject that its terms weigh most for, unless they weigh little beside the document's clearest
sentence, and a document keeps the subjects with ``SECOND`` of its sentences, the title counting as ``TITLE`` of them;
so what only a passing sentence touches is left out. Rounds go on until the terms' weights stay as they are.

Hand labels are clamped in every round and in the result if they are trusted: if the document's own sentences don't
speak against them (``TRUST``). Labels that aren't trusted are left out, and ``seed_report`` counts them.

Terms are hashed into ``SPACE`` slots, so the table of a round has one size, whatever the corpus; a pass over the
documents sums a batch before anything is shuffled.

Defined results: a row in which no term is known gets no subject; labels are trimmed, lower-cased and matched to the
list of subjects, others are ignored, repeated labels count once. With no seeds or no subjects the result is empty.
Texts are read whole; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm import boilerplate
from newsweave.llm.lookalikes import IGNORABLE, LOOKALIKES
from newsweave.session import spread, written

ROUNDS, SECOND, TITLE, CLEAR, TRUST, STILL, SPACE = 4, 0.2, 2.0, 0.15, 0.15, 0.01, 1 << 18
_WORD = re.compile(r"(?<![\w])[^\W\d_][^\W\d_-]{3,}|[.!?](?=\s|$)|\n")
_TAG = re.compile(r"<[^<>]*>|&[a-z]+;|\{\{[^{}]*\}\}|https?://\S+")


def _terms(text: str, known: dict[str, int]) -> list[list[int]]:
    """Hashed lower-case words of four letters or more of each sentence; names are left out."""
    if "<" in text or "&" in text or "{" in text or "http" in text:
        text = _TAG.sub(" ", text)
    out: list[list[int]] = []
    now: list[int] = []
    first = True
    for w in _WORD.findall(text):
        if len(w) == 1:
            if now:
                out.append(now)
                now = []
            first = True
            continue
        if w[0].isupper() and not first:
            continue
        first = False
        k = known.get(w)
        if k is None:
            k = known[w] = xxhash.xxh32_intdigest(w.lower()) & (SPACE - 1)
        now.append(k)
    if now:
        out.append(now)
    return out


def _fold_title(t: str) -> str:
    if t.isascii():
        return t
    return "".join("" if c in IGNORABLE else LOOKALIKES.get(c, c) for c in t)


def readings(df: DataFrame, key: str, title: str, full_text: str, summary: str) -> DataFrame:
    """(key, title terms, terms of each sentence) of each row, in one pass, after one that counts the lines of pages."""
    df, held = boilerplate.marked(df, "feed_key", full_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        page = boilerplate.Reader(held.value)
        for b in batches:
            if not len(b):
                continue
            heads, bodies = [], []
            for t, f, s, drop in zip(b["t"], b["f"], b["s"], b["_drop"]):
                own = page(f, drop) if f and f.strip() else None
                text = own if own and any(c.isalnum() for c in own) else (s or "")
                heads.append([x for ss in _terms((t and _fold_title(t)) or "", known) for x in ss])
                bodies.append(_terms(text, known))
            if len(known) > 400_000:
                known.clear()
            yield pd.DataFrame({"key": b["key"], "head": heads, "sents": bodies})

    rows = df.select(F.col(key).alias("key"), F.col(title).alias("t"), F.col(full_text).alias("f"), F.col(summary).alias("s"), "_drop")
    return spread(rows).mapInPandas(run, f"key {dict(df.dtypes)[key]}, head array<int>, sents array<array<int>>")


def _seeds(labels: DataFrame, subjects: DataFrame, key: str) -> tuple[list[str], DataFrame]:
    """The subjects in order, and (key, mask): the labelled subjects of each row as bits."""
    names = sorted(r.subject for r in subjects.where("subject is not null").select("subject").distinct().limit(63).collect())  # a short fixed list
    if not names:
        return names, labels.select(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("mask")).limit(0)
    bit = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n.strip().lower(), 1 << i)])
    lab = labels.select(F.col(key).alias("key"), bit[F.lower(F.trim("subject"))].cast("bigint").alias("bit"))
    return names, lab.where("bit is not null and key is not null").groupBy("key").agg(F.bit_or("bit").alias("mask"))


Table = tuple[np.ndarray, np.ndarray]


class _Read:
    """Documents' subjects by a table of terms: the slots that say something and what they say."""

    def __init__(self, table: Table, n: int):
        self.n = n
        self.table = np.zeros((SPACE, n), "f4")
        self.table[table[0]] = table[1]

    def _sums(self, lists: list, length: np.ndarray) -> np.ndarray:
        out = np.zeros((len(length), self.n))
        has = np.flatnonzero(length)
        if len(has):
            flat = np.concatenate([np.asarray(x, "i8") for x in lists])
            out[has] = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(length[has])[:-1]]).astype("i8"), axis=0)
        return out

    def shares(self, b: pd.DataFrame) -> np.ndarray:
        heads, docs = list(b["head"]), list(b["sents"])
        h = self._sums(heads, np.array([len(x) for x in heads], "i8"))
        shares = _normal(h) * TITLE
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = [s for d in docs for s in d]
        if flat:
            v = self._sums(flat, np.array([len(s) for s in flat], "i8"))
            top = v.max(axis=1)
            most = np.zeros(len(docs))
            np.maximum.at(most, owner, top)
            told = (top > 0) & (top >= CLEAR * most[owner])
            np.add.at(shares, (owner[told], v[told].argmax(axis=1)), 1.0)
        return np.round(_normal(shares), 6)

    def labels(self, b: pd.DataFrame, second: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares, whether the row's own label is trusted, and what the row is labelled with: its trusted label, else
        the subject with the largest share and the next if it has ``second``."""
        shares = self.shares(b)
        mask = b["mask"].fillna(0).to_numpy("i8")
        own = (mask[:, None] >> np.arange(self.n)) & 1 == 1
        silent = shares.sum(axis=1) == 0
        trusted = own.any(axis=1) & (silent | (np.where(own, shares, 1.0).min(axis=1) >= TRUST))
        rank = np.argsort(-shares, axis=1, kind="stable")
        rows = np.arange(len(b))
        kept = np.zeros_like(own)
        kept[rows, rank[:, 0]] = shares[rows, rank[:, 0]] > 0
        if self.n > 1:
            next_ = shares[rows, rank[:, 1]]
            kept[rows, rank[:, 1]] = (next_ > 0) & (next_ >= second)
        return shares, trusted, np.where(trusted[:, None], own, kept)


def _normal(x: np.ndarray) -> np.ndarray:
    whole = x.sum(axis=1, keepdims=True)
    return np.divide(x, whole, out=np.zeros_like(x), where=whole > 0)


def _summed(rows: DataFrame, n: int, table: Table | None, second: float) -> pd.DataFrame:
    """(term, df, v0..vn-1): of each term the labels of the documents that have it; with no table yet, of the labelled
    ones. Every batch is summed before the shuffle. The term -1 has the sums over the documents."""
    share = rows.sparkSession.sparkContext.broadcast(table)  # at most SPACE x subjects

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = share.value
        read = _Read(table, n) if table is not None else None
        for b in batches:
            if not len(b):
                continue
            if read is None:
                own = (b["mask"].fillna(0).to_numpy("i8")[:, None] >> np.arange(n)) & 1 == 1
            else:
                own = read.labels(b, second)[2]
            vec = _normal(own.astype("f8"))
            length, flat = [], []
            for h, d in zip(b["head"], b["sents"]):
                t = np.unique(np.concatenate([h, *d])) if len(h) or len(d) else np.empty(0, "i8")
                length.append(len(t)), flat.append(t)
            has = own.any(axis=1)
            terms = np.concatenate([np.asarray(t, "i8") for t, k in zip(flat, has) if k] or [np.empty(0, "i8")])
            doc = np.repeat(np.flatnonzero(has), np.array(length)[has])
            found, at = np.unique(terms, return_inverse=True)
            out = pd.DataFrame({"term": np.append(found, -1), "df": np.append(np.bincount(at, minlength=len(found)), has.sum())})
            for i in range(n):
                out[f"v{i}"] = np.append(np.bincount(at, weights=vec[doc, i], minlength=len(found)), vec[:, i].sum())
            yield out

    sums = ", ".join(f"v{i} double" for i in range(n))
    each = rows.select("head", "sents", "mask").mapInPandas(run, f"term bigint, df bigint, {sums}")
    out = each.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(n)]).toPandas()  # at most SPACE + 1 rows
    share.destroy()
    return out


def _table(t: pd.DataFrame, n: int) -> Table:
    """What each term says of each subject, verified: weighed by how far its labels agree."""
    cols = [f"v{i}" for i in range(n)]
    prior = t.loc[t["term"] == -1, cols].to_numpy("f8").sum(axis=0)
    t = t[t["term"] >= 0]
    # a tenth of a document of every subject: a term seen once says nothing yet
    p = (t[cols].to_numpy("f8") + 0.1) / (prior + 0.1 + 0.01 * prior.mean())
    s = p / p.sum(axis=1, keepdims=True)
    df = t["df"].to_numpy("f8")
    agree = (1 + (s * np.log(s)).sum(axis=1) / math.log(max(n, 2))) * df / (df + 1)
    kept = agree > 0.1
    order = np.argsort(t["term"].to_numpy("i8")[kept])
    return t["term"].to_numpy("i8")[kept][order], (s * (agree * agree)[:, None])[kept][order].astype("f4")


def _moved(a: Table, b: Table) -> float:
    """How far two tables differ, as a share of the second."""
    both = np.union1d(a[0], b[0])
    x, y = np.zeros((len(both), a[1].shape[1])), np.zeros((len(both), a[1].shape[1]))
    x[np.searchsorted(both, a[0])], y[np.searchsorted(both, b[0])] = a[1], b[1]
    return float(np.abs(x - y).sum() / max(np.abs(y).sum(), 1e-12))


def propagated(df: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "row_id", title: str = "title", full_text: str = "full_text", summary: str = "summary", second: float = SECOND, rounds: int = ROUNDS) -> tuple[list[str], DataFrame]:
    """The subjects and (key, labelled, trusted, shares, subjects): of each row whether it has a label of its own and
    that is trusted, its share of every subject, and the numbers of the subjects it ends with."""
    names, seeds = _seeds(labels, subjects, key)
    n = len(names)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, labelled boolean, trusted boolean, shares array<double>, subjects array<int>"
    if not n:
        return names, df.sparkSession.createDataFrame([], schema)
    rows = written(readings(df, key, title, full_text, summary).join(seeds, "key", "left"))
    if not rows.where("mask is not null").limit(1).count():
        return names, df.sparkSession.createDataFrame([], schema)
    table = _table(_summed(rows.where("mask is not null"), n, None, second), n)
    for _ in range(rounds):
        last, table = table, _table(_summed(rows, n, table, second), n)
        if _moved(table, last) <= STILL:
            break
    share = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _Read(share.value, n)
        for b in batches:
            if len(b):
                shares, trusted, kept = read.labels(b, second)
                ends = [np.flatnonzero(k)[np.argsort(-s[k], kind="stable")].astype("i4") for k, s in zip(kept, shares)]
                yield pd.DataFrame({"key": b["key"], "labelled": b["mask"].notna(), "trusted": trusted, "shares": list(shares), "subjects": ends})

    return names, rows.mapInPandas(run, schema)


def row_subjects(df: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "row_id", second: float = SECOND) -> DataFrame:
    """(key, subject): the subjects that each row ends with."""
    names, rows = propagated(df, labels, subjects, key, second=second)
    spelled = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return rows.select(F.col("key").alias(key), F.explode("subjects").alias("i")).select(key, F.get(spelled, F.col("i")).alias("subject"))


def seed_report(df: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "row_id") -> DataFrame:
    """(subject, rows, seeds, trusted): of each subject the rows that end with it, the rows labelled with it by hand and
    how many of these labels are trusted."""
    names, rows = propagated(df, labels, subjects, key)
    _, seeds = _seeds(labels, subjects, key)
    spelled = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    rows = written(rows.select("key", "labelled", "trusted", "subjects"))
    ends = rows.select(F.explode("subjects").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("rows"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.call_function("shiftright", F.col("mask"), i) % 2 == 1)
    own = seeds.join(rows.select("key", "trusted"), "key").select(F.explode(bits).alias("i"), "trusted").groupBy("i").agg(F.count(F.lit(1)).alias("seeds"), F.count_if("trusted").alias("trusted"))
    both = ends.join(own, "i", "full").fillna(0, ["rows", "seeds", "trusted"])
    return both.select(F.get(spelled, F.col("i")).alias("subject"), "rows", "seeds", "trusted")
