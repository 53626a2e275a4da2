"""Weak supervision: labelling rules, their diagnostics, and a label model.

A rule votes 1 (yes), 0 (no) or -1 (abstains). Kinds of matching are never mixed: ``word`` is a whole word, ``part`` a
substring; text is lower-cased, null is ''. All rules are evaluated in one projection. The label model takes the
rules as independent given the class and is fitted by expectation-maximisation over the distinct vote patterns, so an
iteration costs the number of patterns, whatever the number of rows; a row on which all abstain gets the prior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import or_empty
from newsweave.session import dropped, written

ABSTAIN, NO, YES = -1, 0, 1


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` if every group of terms has a hit and no term of ``without`` does; else ``otherwise``."""

    name: str
    vote: int
    groups: tuple[tuple[str, ...], ...]
    kind: str = "word"
    otherwise: int = ABSTAIN
    without: tuple[str, ...] = field(default=())

    def column(self, text: Column) -> Column:
        low = F.lower(or_empty(text))
        hit = F.lit(True)
        for g in self.groups:
            hit &= self._has(low, g)
        if self.without:
            hit &= ~self._has(low, self.without)
        return F.when(hit, self.vote).otherwise(self.otherwise).cast("tinyint").alias(self.name)

    def _has(self, low: Column, terms: tuple[str, ...]) -> Column:
        if self.kind == "word":
            return low.rlike(rf"(?<![\w])(?:{'|'.join(terms)})(?![\w])" if any(not t.isascii() for t in terms) else rf"\b(?:{'|'.join(terms)})\b")
        out = F.contains(low, F.lit(terms[0]))
        for t in terms[1:]:
            out |= F.contains(low, F.lit(t))
        return out


#: A default set for regional news; rules are data and may be replaced.
RULES = [
    Rule("cyber", YES, (("ransomware", "datalek", "hack", "phishing", "wachtwoorden", "encryptie"),)),
    Rule("property_crime", YES, (("inbraak", "straatroof", "overval", "drugslab", "babbeltrucs", "heling"),)),
    Rule("police", YES, (("politie", "arrestatieteam", "verdachte", "wijkagent", "surveillant"),)),
    Rule("firm_and_crime", YES, (("handel", "beheer", "advies", "industrie"), ("inbraak", "overval", "ransomware", "afpersing"))),
    Rule("sport", NO, (("bekerfinale", "strafschop", "derby", "etappe", "clubrecord", "selectie"),)),
    Rule("politics", NO, (("wethouder", "kamerlid", "amendement", "coalitieakkoord", "raadslid"),)),
    Rule("weather_nature", NO, (("droogte", "blauwalg", "bosbrand", "waterpeil", "stikstof"),)),
    Rule("culture", NO, (("museum", "orkest", "expositie", "dichtbundel", "popkoor"),)),
    Rule("public_body", YES, (("gemeente", "provincie", "waterschap"),), kind="part", otherwise=NO),
    Rule("traffic_not_crime", NO, (("verkeer", "file", "afrit", "spoor"),), kind="part", without=("inbraak", "overval")),
]


def votes(df: DataFrame, text: Column, rules: list[Rule] = RULES) -> DataFrame:
    return df.withColumns({r.name: r.column(text) for r in rules})


def diagnostics(voted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(rule, coverage, positive, negative, conflict) of every rule, from one aggregate."""
    some = lambda r, v: F.array_contains(F.array(*[F.col(x.name) for x in rules if x is not r]).cast("array<int>"), v)
    parts = []
    for r in rules:
        c = F.col(r.name)
        clash = ((c == YES) & some(r, NO)) | ((c == NO) & some(r, YES))
        parts.append(F.struct(F.lit(r.name).alias("rule"), F.avg((c != ABSTAIN).cast("int")).alias("coverage"), F.avg((c == YES).cast("int")).alias("positive"), F.avg((c == NO).cast("int")).alias("negative"), F.avg(clash.cast("int")).alias("conflict")))
    out = voted.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("x")).select("x.*")
    return out.select("rule", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("coverage", "positive", "negative", "conflict")])


@dataclass
class LabelModel:
    """P(y=1), and for each rule P(vote | y) for the votes -1, 0, 1."""

    prior: float
    rules: list[str]
    given: list[dict[int, tuple[float, float]]]

    def posterior(self, abstain: bool = False) -> Column:
        """P(y=1 | votes) as an expression: the sigmoid of a sum of log-ratios; abstentions carry nothing, but in fitting."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g in zip(self.rules, self.given):
            for v in (ABSTAIN, NO, YES) if abstain else (NO, YES):
                p0, p1 = g[v]
                z = z + F.when(F.col(name) == v, math.log(p1 / p0)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(voted: DataFrame, rules: list[Rule] = RULES, iterations: int = 20, prior: float = 0.5, smooth: float = 1.0) -> LabelModel:
    """EM from majority votes with a fixed prior, over the table of distinct vote patterns: every step is one aggregate of
    three sums a rule, so nothing is collected but these."""
    names = [r.name for r in rules]
    patterns = written(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    votes_for = lambda v: sum((F.when(F.col(c) == v, 1).otherwise(0) for c in names[1:]), F.when(F.col(names[0]) == v, 1).otherwise(0))
    yes, no = votes_for(YES), votes_for(NO)
    q = F.when(yes > no, 0.9).when(yes < no, 0.1).otherwise(0.5)
    model = LabelModel(prior, names, [])
    for _ in range(iterations):
        sums = [F.sum(F.col("n") * q).alias("m1"), F.sum(F.col("n") * (1 - q)).alias("m0")]
        for c in names:
            for v in (ABSTAIN, NO, YES):
                here = F.when(F.col(c) == v, F.col("n")).otherwise(0)
                sums += [F.sum(here * q).alias(f"{c}:{v}:1"), F.sum(here * (1 - q)).alias(f"{c}:{v}:0")]
        got = patterns.agg(*sums).first()
        mass1, mass0 = got["m1"] or 0.0, got["m0"] or 0.0
        model.given = []
        for c in names:
            g = {}
            for v in (ABSTAIN, NO, YES):
                p0, p1 = ((got[f"{c}:{v}:0"] or 0.0) + smooth) / (mass0 + 3 * smooth), ((got[f"{c}:{v}:1"] or 0.0) + smooth) / (mass1 + 3 * smooth)
                # a vote never counts against what it says
                g[v] = (p0, max(p0, p1)) if v == YES else (max(p0, p1), p1) if v == NO else (p0, p1)
            model.given.append(g)
        q = model.posterior(abstain=True)
    dropped(patterns)
    return model


def fixed_model(rules: list[Rule] = RULES, accuracy: float = 0.8, prior: float = 0.5) -> LabelModel:
    """Every rule right with the same probability."""
    return LabelModel(prior, [r.name for r in rules], [{NO: (accuracy, 1 - accuracy), YES: (1 - accuracy, accuracy), ABSTAIN: (1.0, 1.0)} for r in rules])


def two_layers(scored: DataFrame, first: str, second: str, least: float) -> DataFrame:
    """Rows whose first layer is sure either way, of those the rows whose second layer is."""
    sure = lambda c: F.greatest(F.col(c), 1 - F.col(c)) >= least
    return scored.where(sure(first)).where(sure(second))


def signal(names: list[str]) -> Column:
    """1 if any of the rules votes yes."""
    out = F.lit(False)
    for n in names:
        out |= F.col(n) == YES
    return out.cast("int")


def adaptive(sig: Column, p: Column, least: float = 0.05) -> Column:
    return F.when((sig == 1) & (p >= least), 1).otherwise(0)
