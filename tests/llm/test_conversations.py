"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from signalloom.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, fault string, copies long"
SOUND = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(c, t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        last = re.sub("[\x20\x09-\x0d]+\\Z", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Shortest path over (turns read, pattern state) with whole audits, one turn or insertion at a time."""
    n = len(turns)
    nxt = lambda state, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    @functools.lru_cache(None)
    def rest(i, state, inserted):
        options = []
        if i == n and state in ("", "a"):
            options.append((0, ""))
        if inserted < 2:
            for c in "ua":
                if nxt(state, c):
                    options.append(tuple(x + y for x, y in zip((5, "I"), rest(i, nxt(state, c), inserted + 1))))
        if i < n:
            options.append(tuple(x + y for x, y in zip((2, "D"), rest(i + 1, state, 0))))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                own = turns[i][2][:1]
                if own and nxt(state, own):
                    options.append(tuple(x + y for x, y in zip((more, "K"), rest(i + 1, nxt(state, own), 0))))
                for c in "ua":
                    if nxt(state, c):
                        options.append(tuple(x + y for x, y in zip((more + 1, "R"), rest(i + 1, nxt(state, c), 0))))
        return min(options, default=(10**9, ""))

    for i in range(n, 0, -50):  # keeps the recursion shallow
        for state, inserted in product(("", "s", "u", "a"), range(3)):
            rest(i, state, inserted)
    return rest(0, "", 0)


def apply(audit, turns):
    kept, i = [], 0
    for letter in audit:
        if letter == "I":
            kept.append([None, ""])
            continue
        if letter != "D":
            kept.append([turns[i][2] if letter == "K" else None, turns[i][3]])
        i += 1
    roles = (["system"] if len(kept) % 2 else []) + ["user", "assistant"] * (len(kept) // 2)
    assert SOUND.fullmatch("".join((r or w)[:1] for (r, _), w in zip(kept, roles)))
    return "\n".join(f"{role or want}:{text}" for (role, text), want in zip(kept, roles))


def plain(rows, damaged=True):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [r for r in (damage(rows) if damaged else rows) if r[0] == c]
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2][:8], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        found, numbers = faults(turns), {t[1] for t in turns if t[1] is not None}
        cost, audit = cheapest(turns, found)
        initials = [t[2][:1] for t in turns]
        out[c] = (
            c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(apply(audit, turns).encode()).hexdigest(),
        )
    return out


def result(df):
    return {r.conv_id: tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def sample(seed, convs=120, longest=9):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Hello there.", "What?", "so it ends", "", "  \n", "Yes!\n", None, f"Own {t}.", f"own {c} {t}", "...\x0b"])
            rows.append((c, rng.choice([t, t, t, t + 3]), role, text))
    return rows


def test_repairs_match_a_search_over_edits(spark):
    rows = sample(3) + [(None, 1, "user", "A."), (None, None, "assistant", "B."), (7, None, "user", "null turn."), (7, None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(5)
    assert result(conv.repair_digests(df)) == plain(rows)


def test_long_and_repeated_conversations_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Text {t}.", f"cut {t}", "Same."])) for t in range(700)]
    rows += [(2, 5, "user", "All the same.")] * 60 + [(2, 6, "assistant", "Fine.")] * 2 + [(3, t, r, f"{r} {t}.") for t, r in enumerate(["user", "assistant"] * 40)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(3)
    assert result(conv.repair_digests(df)) == plain(rows)
    held = conv.repaired_turns(df, damage=True).orderBy("conv_id", "position").collect()
    for c, want in plain(rows).items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in held if r.conv_id == c).encode()).hexdigest() == want[-1]


def test_chart_equals_single_splits():
    rng = random.Random(1)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 8)))
        single = conv.INSERTIONS
        for s in symbols:
            single = conv.join_cells(single, conv.leaf(s))
        assert conv.Chart().cells(symbols) == single


def test_whole_audits_are_least_among_all():
    """Every edit sequence of short conversations is tried."""
    for symbols in ("aU", "ux", "sau", "o", "S", "uu"):
        found = {}
        for edits in product(["D", "K", "Ru", "Ra"], repeat=len(symbols)):
            for places in product([(), ("u",), ("a",), ("u", "a"), ("a", "u")], repeat=len(symbols) + 1):
                cost, initials, audit, fine = 0, "", "", True
                for k in range(len(symbols) + 1):
                    for c in places[k]:
                        cost, initials, audit = cost + 5, initials + c, audit + "I"
                    if k < len(symbols):
                        e, s = edits[k], symbols[k]
                        fine &= not (s == "x" and e != "D")
                        cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and s.isupper() else 0)
                        initials += "" if e == "D" else s.lower() if e == "K" else e[1]
                        audit += e[0]
                if fine and SOUND.fullmatch(initials):
                    found[cost, audit] = 1
        fold = conv.Fold()
        fold.add(symbols)
        assert conv.cheapest(fold.cells()) == min(found)


@pytest.mark.parametrize("rows", [[], [(9, 7, "user", None)]])
def test_empty_tables_and_dropped_conversations(spark, rows):
    gone = next(t for t in range(200) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    rows = rows and rows + [(4, gone, "user", "Hi.")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = result(conv.repair_digests(df))
    assert got == plain(rows)
    if rows:
        assert got[4] == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
