"""Operator 4: personal data by weak supervision, in DataFrame operations only.

Four base kinds (email, ip, card, phone) are found by pattern and check and always stay.
Wider patterns add candidates: telephone numbers without a country code, secrets (keys,
passwords, tokens), names of persons, street addresses, bank accounts and social security
numbers. Five labelers vote for, against or not at all on each candidate: a strict
pattern, gazetteers (names, places, organisations, key prefixes, codes), words in the
context, punctuation next to it, and its shape.

* Fitting counts vote patterns and span features over all documents. Their number is
  bounded by the grid of votes and buckets, not by the input. Expectation-maximisation
  over these counts estimates how each labeler votes on true and on false candidates.
* The posteriors train the final classifier, a logistic regression on the span's
  features, whose weights become part of a SQL expression. Candidates of probability
  ``THRESHOLD`` or more are added, but for those that cut through a base span.

A match's place is found from the lengths of what a split at the pattern leaves, so no
row goes to Python. The patterns are possessive, and begin only where a run begins or the
last match ended, so they take linear time and constant stack on any text; places are
running sums in two levels, and redaction joins pieces, so a text's cost grows with its
length also where it holds many spans.

Defined results: a null text is empty and has no spans; a base match that fails its check
is dropped and not retried; repeated rows and null ids are kept each; an empty table gives
no rows; other columns are ignored, whatever their names (``redact`` keeps them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "name", "address", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5
CONTEXT = 24
#: Votes that each labeler is taken to have cast already, as it is first thought to.
PSEUDO_VOTES = 20.0
#: Elements of the lower level of a running sum.
_FAN = 64

#: The gazetteers: common given and family names of several languages, large places, marks of
#: organisations, prefixes of keys that services issue, and countries of account numbers.
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy "
    "Matthew Lisa Anthony Margaret Mark Sandra Paul Emily Andrew Anna Peter Laura Hans Ursula Klaus Monika Wolfgang Petra Stefan Sabine Jürgen Heike Pierre Marie "
    "Jean Camille Michel Sophie Luc Claire José María Juan Carmen Carlos Ana Luis Lucía Javier Elena Miguel Isabel"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen "
    "King Wright Scott Hill Green Adams Baker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Bernard Dubois Durand Moreau Laurent Lefebvre "
    "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Díaz"
).split()
PLACES = (
    "London Paris Berlin Madrid Rome Vienna Hamburg Munich Köln Lyon Marseille Barcelona Sevilla Valencia Boston Chicago Houston Dallas Denver Seattle Austin Miami "
    "Atlanta Toronto Sydney Dublin Zürich Geneva Brussels Amsterdam York Washington America Germany France Spain England Europe Street Avenue Road University"
).split()
ORGANISATIONS = "Inc Ltd LLC GmbH AG Corp Corporation Company Bank Group Foundation Institute Association Club Committee Ministry Department".split()
KEY_PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_live_ sk_test_ pk_live_ pk_test_ rk_live_ xoxb- xoxp- xoxa- ya29. eyJ SG. npm_ dop_v1_ shpat_".split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK TR".split()

#: The base patterns, possessive and anchored at the start of a run (or the last match's end).
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of 14 to 19 digits with at most one space or hyphen between two
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora|Don|Doña"
_NAMED = ", ".join(f"'{n}'" for n in [*_TITLES.split("|"), *(f"{t}." for t in _TITLES.split("|")), *GIVEN])
_CAPITAL = r"\p{Lu}[\p{L}'’-]++"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Sq"
#: The wider patterns: kind, pattern.
WIDER = {
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
    "name": rf"(?<![^ \n])(?:(?:{_TITLES})\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}|(?:{'|'.join(GIVEN)})(?: {_CAPITAL}){{1,2}})",
    "address": rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}} (?:{_CAPITAL} ){{1,3}}?(?:{_STREETS})(?![\p{{L}}\p{{N}}])|\p{{Lu}}[\p{{L}}-]{{2,30}}(?:straße|strasse|gasse|platz|allee) [0-9]{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
_SPANS = "array<struct<start:int,end:int,kind:int,m:string,before:string,after:string>>"


def _prefix(name: str, op: str) -> Column:
    """For each number of the array ``name``, ``op`` (of two, from 0 on) over all before it.

    In two levels, so that the arrays that grow while they are folded stay short.
    """
    first = "named_struct('x', 0, 'out', cast(array() AS array<int>))"
    scan = lambda xs: f"aggregate({xs}, {first}, (s, v) -> named_struct('x', {op.format('s.x', 'v')}, 'out', concat(s.out, array(s.x))))"
    portions = f"transform(sequence(0, cast((size({name}) - 1) div {_FAN} AS int)), k -> slice({name}, k * {_FAN} + 1, {_FAN}))"
    local = f"transform({portions}, p -> {scan('p')})"
    heads = f"{scan(f'transform({local}, l -> l.x)')}.out"
    joined = f"flatten(transform(arrays_zip({local}, {heads}), z -> transform(z.`0`.out, v -> {op.format('z.out', 'v')})))"
    return F.expr(f"CASE WHEN size({name}) > 0 THEN {joined} ELSE cast(array() AS array<int>) END")


def _occurrences(pieces: Column, matches: Column, before: Column, kind: int) -> Column:
    """Spans of matches, given what a split at the same pattern leaves between them, and the length before each pair of both."""
    n = F.size(matches)
    zipped = F.arrays_zip(F.slice(pieces, 1, n).alias("p"), matches.alias("m"), before.alias("at"), F.slice(pieces, 2, n).alias("next"))

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["p"])
        return F.struct(
            start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"),
            F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after"),
        )

    return F.when(n > 0, F.transform(zipped, span)).otherwise(F.array().cast(_SPANS))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def value(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), value) % 10 == 0


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _valid(kind: str):
    return lambda s: _CHECKS[kind](s["m"])


def _is(kind: int):
    return lambda s: s["kind"] == kind


#: What a text must hold for a pattern to be tried at all.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "wide_phone": lambda t: t.rlike("[0-9]{3}[ .-][0-9]{4}"),
    "wide_secret": lambda t: t.rlike("[A-Za-z0-9_+/-]{16}"),
    "wide_name": lambda t: F.arrays_overlap(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "), F.expr(f"array({_NAMED})")),
    "wide_address": lambda t: t.rlike(r"[0-9] \p{Lu}") | t.rlike("[eßz] [0-9]"),
    "wide_iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "wide_ssn": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
}


def with_spans(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` (never null), ``base`` (checked base spans), ``wide`` (candidates that hold them whole or not at all)."""
    docs = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    patterns = PATTERNS | {f"wide_{k}": p for k, p in WIDER.items()}
    docs = docs.withColumns({f"m_{n}": F.when(_NEEDS[n](text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, p in patterns.items()})
    docs = docs.withColumns({f"p_{n}": F.when(F.size(f"m_{n}") > 0, F.split(text, p, -1)).otherwise(none) for n, p in patterns.items()})
    both = lambda n: F.arrays_zip(F.slice(f"p_{n}", 1, F.size(f"m_{n}")).alias("p"), F.col(f"m_{n}").alias("m"))
    docs = docs.withColumns({f"n_{n}": F.transform(both(n), lambda x: F.length(x["p"]) + F.length(x["m"])) for n in patterns})
    docs = docs.withColumns({f"n_{n}": _prefix(f"n_{n}", "{} + {}") for n in patterns})
    spans = {n: _occurrences(F.col(f"p_{n}"), F.col(f"m_{n}"), F.col(f"n_{n}"), KINDS.index(n.removeprefix("wide_"))) for n in patterns}
    base = F.concat(*(F.filter(spans[k], _valid(k)) for k in BASE))
    docs = docs.select("row", "text", base.alias("base"), F.concat(*(_checked(spans[f"wide_{k}"], k) for k in WIDER)).alias("wide"))
    return _clear(docs)


def _clear(docs: DataFrame) -> DataFrame:
    """``docs`` without the candidates of ``wide`` that cut through a span of ``base``.

    With M(x) the greatest end of base spans that start before x, a candidate cuts through
    one if M(start) > start or M(end) > end. Both are read off one running maximum over
    all places in order.
    """
    event = lambda at, tag, end, k: F.struct(at.alias("at"), F.lit(tag).alias("tag"), end.alias("end"), k.alias("k"))
    asked = lambda at: F.transform("wide", lambda c, k: event(c[at], 0, F.lit(0), k))
    bases = F.transform("base", lambda b: event(b["start"], 1, b["end"], F.lit(-1)))
    some = (F.size("wide") > 0) & (F.size("base") > 0)
    docs = docs.withColumn("events", F.when(some, F.array_sort(F.concat(asked("start"), asked("end"), bases))))
    docs = docs.withColumn("tops", F.transform("events", lambda e: e["end"]))
    docs = docs.withColumn("tops", F.when(F.col("tops").isNotNull(), _prefix("tops", "greatest({}, {})")))
    places = F.filter(F.arrays_zip(F.col("events").alias("e"), F.col("tops").alias("top")), lambda z: z["e"]["tag"] == 0)
    # in the order of the candidates, two for each
    cuts = F.array_sort(F.transform(places, lambda z: F.struct(z["e"]["k"].alias("k"), (z["top"] > z["e"]["at"]).alias("cut"))))
    docs = docs.withColumn("cuts", cuts)
    clear = F.filter("wide", lambda c, k: ~(F.get("cuts", 2 * k)["cut"] | F.get("cuts", 2 * k + 1)["cut"]))
    return docs.select("row", "text", "base", F.when(F.col("cuts").isNull(), F.col("wide")).otherwise(clear).alias("wide"))


def _checked(spans: Column, kind: str) -> Column:
    """Account numbers must pass their check sum to be candidates."""
    return F.filter(spans, lambda s: _checksum(s["m"]) == 1) if kind == "iban" else spans


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (out if no is None else out.when(F.coalesce(no, F.lit(False)), -1)).otherwise(0)


def _checksum(m: Column) -> Column:
    """Account numbers: the rest, modulo 97, of the number that their turned characters write."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))

    def step(acc: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _any(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


def _by_kind(kind: Column, of: dict[str, Column], otherwise: Column) -> Column:
    """The value for a span's own kind."""
    out = F
    for name, value in of.items():
        out = out.when(kind == KINDS.index(name), value)
    return out.otherwise(otherwise)


LABELERS = ("pattern", "gazetteer", "context", "punctuation", "shape")


def votes(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes: 1 for, -1 against, 0 neither."""
    share, none, last = F.length(_digits(m)) / F.length(m), F.lit(0), F.substring_index(m, " ", -1)
    pattern = {
        "secret": _vote(m.rlike("^AKIA[A-Z0-9]{16}$|^[0-9a-f]{18,64}$|^(?:sk|pk|ghp|xox[bp])[-_]")),
        "phone": _vote(m.rlike(r"^\([0-9]{3}\) ")),
        "name": _vote(m.rlike(rf"^(?:{_TITLES})\.? ")),
        "address": _vote(m.rlike("^[0-9]+ .*(?:Street|Avenue|Road|Boulevard|Lane)$|(?:straße|strasse|gasse|allee) ")),
        "iban": _vote(m.rlike("^[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})$")),
        "ssn": _vote(~m.rlike("^(?:078-05-1120|219-09-9999|123-45-6789)$")),
    }
    area = r"^\(?(?:2(?:0[12367]|1[0234579])|3(?:0[1235]|1[0237])|4(?:0[1245]|1[0245])|5(?:0[123]|1[023])|6(?:0[236]|1[024679])|7(?:0[234]|1[3478])|8(?:0[123]|1[0345])|9(?:0[149]|1[0246]))"
    gazetteer = {
        "secret": _vote(m.rlike(f"^(?:{_any(KEY_PREFIXES)})"), m.rlike("(?i)https?|www|index|page|file|version|chapter|section|article")),
        "phone": _vote(m.rlike(area), m.rlike(r"^\(?[01]")),
        "name": _vote(last.rlike(f"^(?:{_any(FAMILY)})$"), last.rlike(f"^(?:{_any(PLACES + ORGANISATIONS)})$")),
        "address": _vote(after.rlike(rf"^[, ]*(?:[0-9]{{5}} )?(?:{_any(PLACES)})")),
        "iban": _vote(m.rlike(f"^(?:{_any(IBAN_COUNTRIES)})"), ~m.rlike(f"^(?:{_any(IBAN_COUNTRIES)})")),
    }
    context = {
        "secret": _vote(before.rlike("(?i)(?:passw|pwd|token|secret|api.?key|access|bearer|credential)"), before.rlike("(?i)(?:commit|sha|md5|checksum|https?:|version|uuid)")),
        "phone": _vote(before.rlike("(?i)(?:tel|phone|call|fax|mobile)"), before.rlike("(?i)(?:isbn|order|invoice|item|part)")),
        "name": _vote(before.rlike(r"(?i)(?:contact|dear|name|from|by|signed|regards|patient|client|mit|von|par|de parte)[:,]? ?\z"), before.rlike(r"(?i)(?:saint|city of|university of|the) ?\z")),
        "address": _vote(before.rlike(r"(?i)(?:address|lives? (?:at|in)|at|wohnt|adresse|located)[:,]? ?(?:in der )?\z")),
        "iban": _vote(before.rlike("(?i)(?:iban|account|konto|compte|cuenta|bank)")),
        "ssn": _vote(before.rlike("(?i)(?:ssn|social security|security n)"), before.rlike("(?i)(?:part|order|model|isbn|invoice)")),
    }
    punctuation = _vote(_by_kind(kind, {"secret": before.rlike("[=:\"']\\s*\\z")}, before.rlike("[:(]\\s*\\z")), before.rlike("[/.#]\\z"))
    shape = {
        "secret": _vote(share.between(0.1, 0.9), share < 0.1),
        "phone": _vote(_digits(m).rlike("^[2-9]"), _digits(m).rlike("^0")),
        "name": _vote(F.length(m).between(6, 40), F.length(m) > 60),
        "address": _vote(F.length(m).between(8, 45)),
        "iban": _vote(share.between(0.4, 0.95), share < 0.3),
    }
    return [_by_kind(kind, pattern, none), _by_kind(kind, gazetteer, none), _by_kind(kind, context, none), punctuation, _by_kind(kind, shape, none)]


def features(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """Bucketed span features of the final classifier; each is a small non-negative number.

    The last two are what the kind's check and lists say, which weigh by kind.
    """
    size, share = F.length(m), F.length(_digits(m)) / F.length(m)
    upper = F.length(F.regexp_replace(m, "[^A-Z]", "")) / size
    last = F.right(before, F.lit(1))
    cast = votes(kind, m, before, after)
    return [
        kind,
        F.when(size < 16, 0).when(size < 20, 1).when(size < 24, 2).when(size < 40, 3).when(size == 40, 4).otherwise(5),
        F.floor(share * 5).cast("int"),
        F.when(upper == 0, 0).when(upper < 0.3, 1).otherwise(2),
        F.when(last == "", 0).when(last == " ", 1).when(last.rlike("[=:\"'(]"), 2).otherwise(3),
        kind * 3 + cast[0] + 1,
        kind * 3 + F.when(cast[2] != 0, cast[2]).otherwise(cast[1]) + 1,
    ]


@dataclass
class Model:
    """Weights of the final classifier by (feature, bucket), and the labelers' estimated voting."""

    bias: float
    weights: dict[tuple[int, int], float]
    reliabilities: dict

    def probability(self, kind: Column, m: Column, before: Column, after: Column) -> Column:
        terms = [F.lit(self.bias)]
        for i, f in enumerate(features(kind, m, before, after)):
            top = max((b for j, b in self.weights if j == i), default=-1)
            if top >= 0:  # what training didn't meet weighs nothing
                known = ", ".join(f"{self.weights.get((i, b), 0.0):.17g}D" for b in range(top + 1))
                terms.append(F.coalesce(F.get(F.expr(f"array({known})"), f), F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


_VOTES, _FEATURES = len(LABELERS), 7


def vote_counts(docs: DataFrame) -> DataFrame:
    """Counts of vote and feature patterns of all candidates: at most one row for each cell of the grid."""
    # an outer explode: from the other kind Catalyst infers a filter, whose push-down would evaluate all patterns again and again
    spans = with_spans(docs.select(docs["text"])).select(F.explode_outer("wide").alias("s")).where("s IS NOT NULL")
    span = [F.col(f"s.{c}") for c in ("kind", "m", "before", "after")]
    named = [v.alias(f"v{i}") for i, v in enumerate(votes(*span))] + [f.alias(f"f{i}") for i, f in enumerate(features(*span))]
    return spans.select(*named).groupBy(*(f"v{i}" for i in range(_VOTES)), *(f"f{i}" for i in range(_FEATURES))).count()


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit(docs: DataFrame, rounds: int = 100) -> Model:
    """Reliabilities by expectation-maximisation and the classifier trained on the posteriors."""
    cells = [(tuple(r[:_VOTES]), tuple(r[_VOTES:-1]), r[-1]) for r in sorted(vote_counts(docs).collect())]
    total = sum(n for *_, n in cells)
    if not total:
        return Model(-35.0, {}, {})
    kinds = sorted({f[0] for _, f, _ in cells})
    prior = dict.fromkeys(kinds, 0.5)
    # p[kind][truth][labeler][vote], votes that abstain apart: they are no evidence;
    # at first a labeler is thought right more often than not
    first = [{-1: 0.6, 1: 0.4}, {-1: 0.2, 1: 0.8}]
    p = {k: [[dict(first[truth]) for _ in range(_VOTES)] for truth in (0, 1)] for k in kinds}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for v, f, _ in cells:
            k = f[0]
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(p[k][1][i][v[i]] / p[k][0][i][v[i]]) for i in range(_VOTES) if v[i])
            post.append(_sigmoid(odds))
        for k in kinds:
            for truth in (0, 1):
                mass = {(i, x): PSEUDO_VOTES * first[truth][x] for i in range(_VOTES) for x in (-1, 1)}
                for (v, f, n), q in zip(cells, post):
                    if f[0] == k:
                        for i in range(_VOTES):
                            if v[i]:
                                mass[i, v[i]] += n * (q if truth else 1 - q)
                for i in range(_VOTES):
                    p[k][truth][i] = {x: mass[i, x] / (mass[i, -1] + mass[i, 1]) for x in (-1, 1)}
            own = [(n, q) for (_, f, n), q in zip(cells, post) if f[0] == k]
            prior[k] = min(0.95, max(0.05, sum(n * q for n, q in own) / sum(n for n, _ in own)))
    bias, weights = 0.0, {(i, b): 0.0 for _, f, _ in cells for i, b in enumerate(f)}
    for _ in range(500):
        grad, slope = dict.fromkeys(weights, 0.0), 0.0
        for (_, f, n), q in zip(cells, post):
            miss = n / total * (q - _sigmoid(bias + sum(weights[i, b] for i, b in enumerate(f))))
            slope += miss
            for i, b in enumerate(f):
                grad[i, b] += miss
        bias += slope
        for key, g in grad.items():
            weights[key] += g - 1e-4 * weights[key]
    return Model(bias, weights, {KINDS[k]: p[k] for k in kinds})


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def _all_spans(model: Model, threshold: float) -> Column:
    added = F.filter("wide", lambda s: model.probability(s["kind"], s["m"], s["before"], s["after"]) >= threshold)
    return _ordered(F.concat("base", added))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(bare)


def find(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = with_spans(docs.select(docs["doc_id"], docs["text"]))
    count = {f"n_{k}": F.size(F.filter("base", _is(i))).cast("long") for i, k in enumerate(BASE)}
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(c.alias(n) for n, c in count.items()),
        F.sha2(_text_of(_ordered(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        _text_of(_all_spans(model, threshold)).alias("spans"),
    )


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by its kind's placeholder; ``n_chars`` follows the text.

    What a span shares with one before it is replaced with that one.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    found = with_spans(docs).select("row", "text", _all_spans(model, threshold).alias("spans"))
    found = found.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    found = found.withColumn("done", _prefix("ends", "greatest({}, {})"))
    found = found.withColumn("chars", F.when(F.size("spans") > 0, F.split("text", "")))

    def piece(x: Column) -> Column:
        kept = F.array_join(F.slice("chars", x["at"] + 1, F.greatest(F.lit(0), x["s"]["start"] - x["at"])), "")
        return F.when(x["s"]["start"] >= x["at"], F.concat(kept, F.element_at(names, x["s"]["kind"] + 1))).otherwise("")

    pieces = F.array_join(F.transform(F.arrays_zip(F.col("spans").alias("s"), F.col("done").alias("at")), piece), "")
    rest = F.array_join(F.slice("chars", F.array_max("ends") + 1, F.size("chars")), "")
    new = F.when(F.size("spans") > 0, F.concat(pieces, rest)).otherwise(F.col("row.text"))
    fresh = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return found.select("row", new.alias("new")).select(*(fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
