"""All spans of op7 against plain Python; the votes' weights come from the same patterns."""

import hashlib
import random
import re
from collections import Counter

import regex

from strata.llm import pii

CORES = {
    "email": (r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "[A-Za-z0-9._%+-]"),
    "ip": (r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", None),
}
LOOSE_CORES = {
    "email": (r"(?i)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++", "[A-Za-z0-9._%+-]"),
    "ip": (r"[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}", "[0-9]"),
    "card": (r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])", "[0-9]"),
    "phone": (r"(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9](?:[ ./-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9])", "[0-9+]"),
}


def _matches(text, core, before):
    pattern, at, out = re.compile(core), 0, []
    last = 0
    while at < len(text):
        free = before is None or at == 0 or at == last or not re.match(before, text[at - 1])
        found = pattern.match(text, at) if free else None
        if found:
            out.append((at, found.end(), found[0]))
            at = last = found.end()
        else:
            at += 1
    return out


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def _shape(kind, value):
    if kind == "email":
        top = re.search("[A-Za-z0-9-]+$", value)[0].lower()
        return top in pii.TOP_DOMAINS or bool(re.fullmatch("[a-z]{2}", top))
    if kind == "ip":
        return not re.search("(?:^|[^0-9])0[0-9]", value)
    if kind == "card":
        return bool(re.fullmatch("[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]{0,4}", value))
    return bool(re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}", value))


def _votes(text, kind, start, end, value, strict):
    before = text[max(0, start - pii.REACH) : start]
    touching = text[start - 1 : start] * (start > 0) + " " + text[end : end + 1]
    words = lambda listed: regex.search(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(listed.split()) + ")", before)
    return (
        1 if strict else -1,
        int(bool(words(pii.CUE_WORDS[kind]))),
        -1 if re.search("[A-Za-z0-9_=]", touching) else 1,
        -int(bool(words(pii.OTHER_WORDS))),
        1 if _shape(kind, value) else -1,
    )


def _candidates(text):
    base, more = [], []
    for number, kind in enumerate(pii.KINDS):
        for s, e, v in _matches(text, *CORES[kind]):
            if _holds(kind, v):
                base.append((s, number, e, *_votes(text, kind, s, e, v, True)))
        if re.search("[0-9]", text) and re.search(pii.LOOSE_NEEDS[kind], text):
            for s, e, v in _matches(text, *LOOSE_CORES[kind]):
                more.append((s, number, e, *_votes(text, kind, s, e, v, False)))
    return sorted(base), sorted(m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base))


def _joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _texts():
    rng = random.Random(8)
    parts = [
        "mail me at a.b@c.com", "E-Mail: x@y.invalidtop", "jo (at) mail [dot] example.org", "server 10.0.0.1:80", "version 1.2.3.4",
        "IP 300.1.1.1", "host 1[.]2[.]3[.]4", "card 4111 1111 1111 1111", "Karte 4111-1111-1111-1112", "order 1234 5678 9012 3456",
        "Téléphone 01 23 45 67 89", "call +49 (30) 1234-5678", "phone 555-123-4567", "isbn 555-123-4567", "Rufnummer 030/1234567",
        "serial 0301 123456", "4111111111111111", "x=10.1.1.1_", "naïve 𝄞 text", "telemetry 555.123.4567", "+1 2", "1.2.3.4.5.6.7.8",
        "a@b", "@.com", "é@x.de", "12345678901234567890", "0049 30 1234567",
    ]
    out = [None, "", " ", "7" * 3000, "a@" * 500 + "b.com"]
    for _ in range(250):
        out.append(rng.choice([" ", ", ", "\n", ""]).join(rng.choices(parts, k=rng.randint(1, 6))))
    return out + out[5:15] + [" ".join(rng.choices(parts, k=3000))]


def test_all_spans_against_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    found = [_candidates(t or "") for t in texts]
    seen = Counter((*c[3:], c[1]) for base, more in found for c in base + more)
    weights = pii.classifier(sorted((*p, n) for p, n in seen.items()))

    def likely(c):
        return sum(w * v for w, v in zip(weights, c[3:])) + weights[len(pii.VOTES) + c[1]] >= 0

    loose = [c for _, more in found for c in more]
    assert any(map(likely, loose)) and not all(map(likely, loose))
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i, (base, more) in enumerate(found):
        assert got[i]["base_sha256"] == hashlib.sha256(_joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
        assert got[i]["spans"] == _joined(sorted(base + [m for m in more if likely(m)])), texts[i]
