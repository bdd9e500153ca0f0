"""Conversation repair against a brute force that searches whole lists of edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from strata.llm import dialogue

SEPARATORS = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by best-first search over (cost, letters) of all lists of edits."""
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, letters, i, kept = heapq.heappop(heap)
        initials = "".join(r[0][:1] if r[0] else "-" for r in kept)
        key = (i, initials[-1:] if initials else "")
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, kept
        if key in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add(key)
        want = "assistant" if initials[-1:] == "u" else "user"
        heapq.heappush(heap, (cost + 3, letters + "I", i, (*kept, (want, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, (*kept, (role, text))))
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, (*kept, (want, text))))


def brute(rows):
    """Per conversation the contract's row, from rows after damage."""
    by_conv = {}
    for conv, turn, role, text in rows:
        name = hashlib.sha256(f"{role}\0{text}".encode()).digest()
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role, name, text))
    out = {}
    for conv, own in by_conv.items():
        own.sort()
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, _, text in own:
            body = text.rstrip(SEPARATORS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, kept = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def conversations(seed, n, longest):
    random.seed(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(random.randint(0, longest)):
            role = random.choices(["user", "assistant", "system", "tool", "", None], [6, 6, 2, 1, 1, 1])[0]
            text = random.choice(["Yes.", "No!", "Cut", "  ", "", "Why?\n", "Odd, ", None, "Long one. \x0b", f"T{turn}."])
            for _ in range(random.choice([1, 1, 1, 2, 3])):
                rows.append((conv, random.choice([turn, turn, turn * 2, None]), role, text))
    return rows


@pytest.mark.parametrize("seed, n, longest", [(1, 60, 6), (2, 6, 60)])
def test_report_against_search(spark, seed, n, longest):
    rows = conversations(seed, n, longest)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in dialogue.repair_damaged(frame).collect()}
    want = brute(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}


def test_edits_give_the_report(spark):
    rows = conversations(3, 20, 12)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    report = {r["conv_id"]: r for r in dialogue.repair(frame).collect()}
    by_conv = {}
    for r in dialogue.edits(frame).collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert by_conv.keys() == report.keys()
    for conv, own in by_conv.items():
        assert sorted(r["edit"] for r in own) == sorted(report[conv]["audit"])
        kept = sorted((r["position"], r["role"], r["text"]) for r in own if r["edit"] != "D")
        assert [k[0] for k in kept] == list(range(len(kept)))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest()
        assert digest == report[conv]["repaired_sha256"]


def test_checkpoints_stay_near_the_root_and_give_the_same_walk():
    rng = random.Random(5)
    rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(5000)]
    backward = dialogue.Backward()
    for initial, fault in reversed(rows):
        backward.add(initial, fault)
    assert len(backward.held) * backward.step <= 2 * 5000 + 4 * backward.step
    assert max(len(backward.held), backward.step) < 4 * 5000**0.5
    forward = dialogue.Forward(5000, backward.step, [c for v in backward.held for c in v])
    letters = [(a, new, row) for r in rows for a, new, row in forward.add((*r, None, "", ""))]
    price = {"D": 4, "I": 3, "K": 0, "R": 3}
    total = sum(price[a] + (3 if row and row[1] == 3 and a != "D" else 0) for a, _, row in letters)
    assert total == backward.costs[dialogue.START]


def test_one_long_conversation_and_extra_columns(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + f"{t}.", t) for t in range(40)]
    rows += [(7, 3, "assistant", "same.", 1)] * 300
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, name int").repartition(3)
    got = dialogue.repair(frame).collect()
    want = brute([r[:4] for r in rows])
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [want[7]]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert dialogue.repair_damaged(frame).collect() == []
    assert dialogue.edits(frame).collect() == []
