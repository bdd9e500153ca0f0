"""The operators against brute force, on small tables with nulls, empties, long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from strata.llm import (
    decontam,
    hash_tree,
    minhash,
    pii,
    poisson_mix,
    redirects,
    substring_dedup,
    toxicity,
    warc_index,
    winnowing,
)
from strata.llm.common import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, key string, x string, score string"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _prose(rng, n):
    return " ".join(rng.choice(["The", "a", "of"]) if rng.random() < 0.2 else f"w{rng.randrange(900)}" for _ in range(n))


def _texts():
    rng = random.Random(5)
    base = [_prose(rng, n) for n in (3, 40, 60, 120, 200, 300)]
    passage = _prose(rng, 55)
    near = base[4].split(" ")
    near[7] = "other"
    out = [*base, base[3], base[3].upper(), " ".join(near), None, "", " \n", "é ü\x0bß " * 30, "tie tie tie tie " * 40]
    out += [_prose(rng, 30) + " " + passage + " " + _prose(rng, 20) for _ in range(4)]
    out += [base[5] + "\n" + base[4], "long" * 5000 + " " + _prose(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    rows = [(10 + i * 3, t, "en", f"s{i % 3}", len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, texts[4], None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 30 + i) for i in range(9)] + [(7, 7), (50, 50), (None, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "l bigint, r bigint"), "l", "r").collect()}
    assert got == {**dict.fromkeys(range(1, 10), 1), **dict.fromkeys([20, *range(30, 39)], 20), 50: 50}


def test_substring_dedup(docs, rows, nothing):
    length, first = 50, {}
    for d, t, *_ in rows:
        w = _words(t)
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    expect = []
    for d, t, *_ in rows:
        w, gone = _words(t), set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expect.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert Counter(got) == Counter(expect) and any(e[2] for e in expect)
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        refs = [(d, [rng.randrange(3) for _ in range(rng.randrange(12))]) for d in range(5)]
        automaton = substring_dedup.SuffixAutomaton()
        for d, words in refs:
            automaton.add(words, d)
        own, doc, k = [rng.randrange(3) for _ in range(14)], rng.randrange(6), 3
        held = {tuple(w[i : i + k]) for d, w in refs if d < doc for i in range(len(w) - k + 1)}
        expect = {i + j for i in range(len(own) - k + 1) if tuple(own[i : i + k]) in held for j in range(k)}
        got = {i for s, e in automaton.matches(own, doc, k) for i in range(s, e)}
        assert got == expect


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(docs, rows, nothing, k):
    sets = {}
    for d, t, *_ in rows:
        w = _words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        if d is not None:
            sets[d] = own
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k).collect()}
    assert got.keys() == sets.keys() and len(set(root.values())) < len(root)
    for d, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), root[d], root[d] == d)
    if k == 5:
        kept = Counter(r["doc_id"] for r in minhash.keep_first(docs).collect())
        assert kept == Counter(d for d, *_ in rows if d is None or root[d] == d)
        assert minhash.near_duplicates(nothing).collect() == []


def test_minhash_later_rounds(spark, monkeypatch):
    """A bucket whose members link through others than its smallest one."""
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(8)
    w = [f"t{i}" for i in range(100)]
    texts = []
    for step in range(12):
        texts.append(" ".join(w))
        w[rng.randrange(100)] = f"new{step}"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


def _fingerprint(text):
    def hash64(data, seed):
        h = xxhash.xxh64_intdigest(data, seed=seed)
        return h

    w = [hash64(x.encode(), 42) for x in _words(text)]
    if not w:
        return []
    grams = []
    for i in range(max(len(w) - winnowing.K, 0) + 1):
        h = 42
        for x in w[i : i + winnowing.K]:
            h = hash64(x.to_bytes(8, "little"), h)
        grams.append((h >> 32, -i))
    n = max(len(grams) - winnowing.WINDOW + 1, 1)
    out = []
    for i in range(n):
        best = min(grams[i : i + winnowing.WINDOW])
        if best not in out:
            out.append(best)
    return [(h << 25) + (1 << 25) - 1 + p for h, p in out]


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_winnowing(docs, rows, nothing, monkeypatch, range_rows):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", range_rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expect = []
    for (d, t, *_), nxt in zip(order, order[1:] + order[:1]):
        t, o = t or "", nxt[1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + o[:q]
        a, b, c = (_fingerprint(x) for x in (t, e, o))

        def like(x, y):
            x, y = {v >> 25 for v in x}, {v >> 25 for v in y}
            return len(x & y) / len(x | y) if x | y else 1.0

        expect.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), " ".join(map(str, a)), " ".join(map(str, b)), like(a, b), like(a, c)))
    got = [tuple(r) for r in winnowing.fingerprints(docs).collect()]
    assert Counter(got) == Counter(expect)
    assert winnowing.fingerprints(nothing).collect() == []


def test_archives(spark):
    html = "x" * 200
    pages = [
        (5, "http://b.org/1", html), (3, "http://b.org/1", html), (9, "http://a.org/", html), (None, None, html),
        (7, "http://c.org/\r\nX: y", "a\r\n\r\nb WARC/1.1\r\n\r\n" * 9), (8, "http://c.org", ""), (11, "u", None), (12, "u", "x" * 99), (13, "u", "x" * 99),
    ]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, digest string")
    rows = warc_index.captures(df).collect()
    keys = [(r["url_key"], r["date"]) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    for p, _, h in pages:
        data = (h or "").encode()
        again = h == html and p != 3
        assert (got[p]["payload_bytes"], got[p]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[p]["record_type"], got[p]["refers_to"]) == (("revisit", 3) if again else ("response", None))
    assert warc_index.captures(df.where("false")).collect() == []


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.choices(range(30), k=rng.randrange(8))) for _ in range(rng.randrange(9))]
        assert [runs[r][i] for r, i in warc_index.merge(runs)] == sorted(x for r in runs for x in r)


def test_hash_tree(spark, docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(hash_tree, "GROUP_ROWS", 1)
    got = hash_tree.place(docs, 24, grown=True).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.place(nothing, 24).collect() == []
    many = spark.range(24_000).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    sizes = [r["count"] for r in hash_tree.place(many, 24).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and min(sizes) > 800 and max(sizes) < 1200


def test_hash_tree_moves_rows_only_into_a_heavier_subtree(spark):
    ids = spark.range(5000).selectExpr("cast(id AS string) AS k")
    before = hash_tree.descend(ids["k"], hash_tree.tree(24))
    after = hash_tree.descend(ids["k"], hash_tree.tree(24, {13: 3.0}))
    moved = ids.select(before.alias("a"), after.alias("b")).where("a <> b").collect()
    # Shard 13 lies in the second region, fourth rack.
    assert moved and all(r["b"] >= 12 for r in moved) and all(12 <= r["b"] < 16 or r["a"] < 12 for r in moved)


def test_poisson_mix(spark, docs, nothing):
    many = spark.range(6000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', 'b') AS source", "'t' AS text", "'z' AS copy")
    got = poisson_mix.mix(many, {"a": 0.5, "b": 0.5}).collect()
    counts = Counter(r["source"] for r in got)
    assert 2800 < counts["a"] < 3200 and 2800 < counts["b"] < 3200
    per = Counter(r["doc_id"] for r in got if r["source"] == "a")
    share = [sum(per[i] == c for i in range(0, 6000, 4)) / 1500 for c in range(4)]
    assert all(abs(s - p) < 0.04 for s, p in zip(share, (0.135, 0.271, 0.271, 0.180)))
    assert Counter(tuple(r) for r in poisson_mix.mix(many, {"a": 0.5, "b": 0.5}).collect()) == Counter(map(tuple, got))
    assert all(sorted(r["copy"] for r in got if r["doc_id"] == d) == list(range(1, per[d] + 1)) for d in list(per)[:20])
    assert {r["doc_id"] for r in poisson_mix.mix(docs).collect()} and poisson_mix.mix(nothing).collect() == []


def _base(text):
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0

    out = []
    for kind, pattern in enumerate((
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else 1, 14 <= len(n) <= 19 and luhn(n), 10 <= len(n) <= 15)
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_personal_data(spark, docs, nothing):
    texts = [
        "é a@b.c@d.e a@b.c_x@d.e x@y.z..q 1.2.3.4.5.6.7.8 999.1.1.1 00000001.2.3.4 ü 4111 1111 1111 1111 5-5",
        "phone 555-123-4567, mail joe [at] site [dot] com, +1 (555) 123-4567. +12 34 +1234567890 4111111111111112",
        "𝄞 q@w.com " * 20, "a" * 20000 + " " + "1" * 20000 + " " + "1-" * 9000 + "+1" * 5000 + " +1" + " " * 9000, None, "",
    ]
    df = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    )
    rows = pii.personal_data(df).collect()
    by_id = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        base = _base(by_id[r["doc_id"]]["text"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(","))
    assert pii.personal_data(nothing).collect() == []


def test_reliable_labelers_get_more_weight():
    rng = random.Random(3)
    seen = Counter()
    for _ in range(3000):
        truth = rng.random() < 0.4
        right = lambda p: (1 if truth else -1) * (1 if rng.random() < p else -1)  # noqa: E731, B023
        seen[(right(0.95), right(0.9), right(0.85), right(0.8), right(0.5), 0)] += 1
    patterns = [(*k, n) for k, n in seen.items()]
    weights = pii.classifier(patterns)
    assert weights[0] > weights[4] and weights[1] > weights[4] and abs(weights[4]) < 0.3


def test_decontamination(spark, docs, nothing):
    rng = random.Random(4)
    item = _prose(rng, 30).split(" ")
    changed = item.copy()
    changed[9], changed[20] = "sub", "sub"
    texts = [" ".join(item), _prose(rng, 50) + " " + " ".join(changed) + " " + _prose(rng, 9), " ".join(item[:6]), _prose(rng, 200), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, None), (3, ""), (4, "two words")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(df, bench).collect()} == {(0, 1), (1, 1)}
    assert sorted(r["doc_id"] or -1 for r in decontam.clean(df, bench).collect()) == [-1, 2, 3, 4]
    assert decontam.overlaps(nothing, bench).collect() == [] and decontam.overlaps(docs, bench.where("false")).collect() == []
    assert decontam.clean(docs, bench.where("false")).count() == docs.count()


def test_url_rules(spark):
    pages = [
        (1, "https://EXAMPLE.net/en/x", ""), (2, "http://a.example.net/de/", ""), (3, "http://b.com/x", '<link rel="canonical" href="http://c.net/y">'),
        (4, "http://d.com/", '<meta http-equiv="refresh" content="0; url=http://b.com/x">'), (5, "http://example.com", None), (6, None, None), (7, "nothing", ""),
        (8, "http://www.e.com/p.html#q", '<link href="http://z.org/fr/1" rel=canonical>'), (9, "http://e.com/p?utm_x=1", ""), (10, "http://notexample.com/de/", ""),
    ]
    df = spark.createDataFrame([(*p, "x") for p in [*pages, pages[0]]], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in redirects.judge(df).collect()}
    assert got == {
        1: ("example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.example.net", "/de/", "net/", "block"), 3: ("b.com", "/x", None, "block"),
        4: ("d.com", "/", None, "block"), 5: ("example.com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("www.e.com", "/p.html", None, "allow"), 9: ("e.com", "/p", None, "allow"), 10: ("notexample.com", "/de/", None, "allow"),
    }
    assert redirects.judge(df).count() == 11 and redirects.judge(df.where("false")).collect() == []


def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words, bad = _prose(rng, rng.randrange(20, 150)).split(" "), i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefrotz", "snarkwibble"]) + rng.choice(["", "s", "ed", "xy"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows + [(None, None), (901, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    truth = dict(labels)
    held = [r for r in toxicity.toxic_scores(df, marks).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    empty = toxicity.toxic_scores(docs, marks.where("false")).collect()
    assert {r["score"] for r in empty} == {0.5} and len(empty) == docs.count()
    assert toxicity.toxic_scores(nothing, marks).collect() == [] and toxicity.clean(docs, marks).columns == docs.columns
