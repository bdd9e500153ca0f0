"""Personal data by weak supervision.

Base spans are what the fixed patterns find (and their checks keep): they always
stay. Looser patterns propose more candidates of the same kinds. Labelers vote
on every candidate: patterns (the strict form holds), gazetteers (cue words of
the kind, or words of other numbers, before it; known top-level domains) and
context (what touches it, how its digits are grouped). Expectation-maximisation over
the votes estimates how reliable each labeler is and how likely each vote
pattern is personal data; a logistic classifier over the votes is trained on
those likelihoods and decides which loose candidates become spans.

All of it is array and SQL code. Votes are few and small, so the vote patterns
form a table of at most 4 * 3**5 rows with counts over all documents; only that table
comes to the driver. Candidates that overlap a base span are dropped.

A match's place comes from the pieces between matches (``split``) and the matches
(``regexp_extract_all``): cumulated lengths, in code points. Patterns start
where a run starts, so a long run is read once.

Null texts are empty and have no spans. Repeated rows give repeated rows; a
null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import staged

# Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?:(?<![0-9+])|\G)(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9](?:[\x20./-][0-9]{2}){4}"
    r"|0[0-9]{2,4}[\x20/-][0-9]{5,8})(?![0-9])",
}
# A text without these has no loose candidate of the kind.
LOOSE_NEEDS = {"email": r"(?i)[\[(]at[\])]", "ip": r"\[\.\]", "card": r"[0-9]{4}[\x20-][0-9]{4}", "phone": r"[0-9][\x20./-][0-9]{2}"}
# Words of English, German, French and Spanish that stand before a kind, or before other numbers.
CUE_WORDS = {
    "email": "e-mail email mail contact write reach address inbox newsletter kontakt schreiben adresse courriel contacter"
    " écrire correo contacto escribir dirección",
    "ip": "ip server host address client gateway router dns ping port localhost adresse rechner netz serveur hôte passerelle"
    " servidor dirección equipo",
    "card": "card visa mastercard amex maestro credit debit account payment pay kreditkarte karte konto zahlung carte"
    " bancaire compte paiement tarjeta cuenta pago",
    "phone": "phone telephone tel call fax mobile cell hotline whatsapp contact telefon anruf handy mobil rufnummer téléphone"
    " portable appeler teléfono móvil llamar",
}
OTHER_WORDS = (
    "version isbn issn doi order invoice build section article serial id part model release patch chapter page figure"
    " ticket tracking reference bestellung rechnung artikel seite kapitel commande facture chapitre référence pedido"
    " factura capítulo página referencia"
)
# The generic top-level domains of RFC 920 and RFC 1591 and the commonest later ones. Two letters are
# a country code by the rule of ISO 3166.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "aero", "coop", "museum")
TOP_DOMAINS += ("jobs", "mobi", "travel", "tel", "cat", "asia", "post", "xxx", "app", "dev", "xyz", "online", "site", "shop", "club")


def _any_of(words: str) -> str:
    """A pattern for any of some words, in either case, as a whole word or a word's beginning."""
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(words.split()) + ")"


CUES = {kind: _any_of(words) for kind, words in CUE_WORDS.items()}
OTHER_CUES = _any_of(OTHER_WORDS)
VOTES = ("strict", "cue", "touch", "other", "shape")
# Characters before a candidate that a cue may stand in.
REACH = 32
ROUNDS, STEPS, RATE = 25, 400, 0.5
THRESHOLD = 0.5


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(m["piece"])
        end = start + F.length(m["value"])
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.aggregate(both, begin, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column, separator: str) -> Column:
    def small(p: Column) -> Column:
        p = F.ltrim(p, F.lit("0"))
        return (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255"))

    return F.forall(F.split(value, separator), small)


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return _small_parts(value, r"\.")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _shape(kind: str, value: Column) -> Column:
    if kind == "email":
        top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        return top.isin(*TOP_DOMAINS) | top.rlike("^[a-z]{2}$")
    if kind == "ip":
        return ~value.rlike(r"(?:^|[^0-9])0[0-9]")
    if kind == "card":
        return value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}[\x20-]?[0-9]{0,4})$")
    return value.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$")


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """Base spans of a kind and further candidates, with votes."""
    number = KINDS.index(kind)

    def votes(s: Column, strict: bool) -> Column:
        lead = F.greatest(s["start"] - REACH, F.lit(0))
        before = F.substring(text, lead + 1, s["start"] - lead)
        touching = F.concat(F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(1)))
        vote = {
            "strict": F.lit(1 if strict else -1),
            "cue": before.rlike(CUES[kind]).cast("int"),
            "touch": F.when(touching.rlike(r"[A-Za-z0-9_=]"), -1).otherwise(1),
            "other": -before.rlike(OTHER_CUES).cast("int"),
            "shape": F.when(_shape(kind, s["value"]), 1).otherwise(-1),
        }
        return F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"),
            *[vote[v].cast("int").alias(v) for v in VOTES],
        )

    base = F.filter(_places(text, STRICT[kind]), lambda s: _holds(kind, s["value"]))
    more = F.when(text.rlike(LOOSE_NEEDS[kind]), _places(text, LOOSE[kind])).otherwise(
        F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    )
    return F.transform(base, lambda s: votes(s, True)), F.transform(more, lambda s: votes(s, False))


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, base, more): base spans and further candidates with their votes, by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("_text"), text.rlike("[0-9]").alias("_digit"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,strict:int,cue:int,touch:int,other:int,shape:int>>)")
    base, more = [], []
    for kind in KINDS:
        b, m = _found(F.col("_text"), kind)
        # A text without these characters has no such span.
        digit = F.lit(True) if kind == "email" else F.col("_digit")
        mark = F.col("_text").contains({"email": "@", "ip": ".", "card": "", "phone": "+"}[kind])
        base.append(F.when(digit & mark, b).otherwise(empty))
        more.append(F.when(digit, m).otherwise(empty))
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*more)).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.withColumn("more", apart)


def reliabilities(patterns: list[tuple]) -> tuple[dict[tuple, float], list[dict[int, float]]]:
    """Expectation-maximisation over (votes..., kind, count): likelihood of each pattern, and each labeler's chance to vote right."""
    total = sum(p[-1] for p in patterns) or 1
    # At the start a pattern is as likely as its share of votes for it.
    belief = {}
    for *votes, kind, _ in patterns:
        cast = [v for v in votes if v]
        belief[(*votes, kind)] = (1 + sum(v > 0 for v in cast)) / (2 + len(cast))
    right: list[dict[int, float]] = []
    for _ in range(ROUNDS):
        prior = (1 + sum(belief[tuple(p[:-1])] * p[-1] for p in patterns)) / (2 + total)
        right = []
        for k in range(len(VOTES)):
            chance = {}
            for truth in (1, 0):
                # Chance of each vote, given the truth; one count each for what was not seen.
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for p in patterns:
                    b = belief[tuple(p[:-1])]
                    weight[p[k]] += p[-1] * (b if truth else 1 - b)
                whole = sum(weight.values())
                chance.update({(truth, v): w / whole for v, w in weight.items()})
            right.append(chance)
        for p in patterns:
            yes = math.log(prior) + sum(math.log(right[k][1, p[k]]) for k in range(len(VOTES)))
            no = math.log(1 - prior) + sum(math.log(right[k][0, p[k]]) for k in range(len(VOTES)))
            belief[tuple(p[:-1])] = 1 / (1 + math.exp(min(50.0, no - yes)))
    return belief, right


def classifier(patterns: list[tuple]) -> list[float]:
    """Weights of the votes, then of the kinds: logistic regression on the likelihoods, by gradient steps."""
    belief, _ = reliabilities(patterns)
    weights = [0.0] * (len(VOTES) + len(KINDS))
    total = sum(p[-1] for p in patterns) or 1

    def features(p: tuple) -> list[float]:
        return [*map(float, p[: len(VOTES)]), *[float(p[len(VOTES)] == k) for k in range(len(KINDS))]]

    for _ in range(STEPS):
        slope = [0.0] * len(weights)
        for p in patterns:
            x = features(p)
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - belief[tuple(p[:-1])]) * p[-1] / total
            slope = [s + error * v for s, v in zip(slope, x, strict=True)]
        weights = [w - RATE * s for w, s in zip(weights, slope, strict=True)]
    return weights


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row: counts and digest of its base spans, and all its spans."""
    read = staged(candidates(documents), "pii-candidates")
    seen = read.select(F.explode(F.concat("base", "more")).alias("c")).groupBy(*[f"c.{v}" for v in VOTES], "c.kind")
    patterns = sorted(tuple(r) for r in seen.agg(F.count(F.lit(1)).alias("n")).collect())
    weights = classifier(patterns)

    def likely(c: Column) -> Column:
        z = F.lit(0.0)
        for name, w in zip(VOTES, weights, strict=False):
            z = z + c[name] * F.lit(w)
        for k, w in enumerate(weights[len(VOTES) :]):
            z = z + F.when(c["kind"] == k, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z)) >= THRESHOLD

    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    everything = F.array_sort(F.concat(F.col("base"), F.filter("more", likely)))
    return read.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
    )
