"""Conversation repair against a plain search over all edit scripts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from basketlens.llm import conversation_repair as cr
from basketlens.llm import queries
from basketlens.llm.common import table

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string, k string, seq long, cost double"
GOOD = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """Per row ``(role, text)``: its first fault."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def dijkstra(rows):
    """(cost, audit, repaired) by expanding scripts in order of cost and
    audit, with the pattern checked by what may still follow."""
    import heapq
    faults = faults_of(rows)

    def state(initials):  # only the pattern's own states are followed
        for s in range(4):
            if re.fullmatch(("", "s", "s?(ua)*u", "s?(ua)+")[s], initials):
                return s
        return None

    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        s = state(initials)
        if s is None or (i, s) in best:
            continue
        best[i, s] = True
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, out
        for made in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, initials + made[0], (*out, (made, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + (role[:1] or "?"), (*out, rows[i])))
                for made in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, initials + made[0], (*out, (made, text))))
    raise AssertionError


def scripts(rows):
    """The ASCII-least of all cheapest scripts, by full enumeration (at most two
    inserts in a row)."""
    faults, best = faults_of(rows), None
    gaps = [()] + [("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def go(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for ins in gaps:
            c, a, o = cost + 2 * len(ins), audit + "I" * len(ins), out + [(r, "") for r in ins]
            if i == len(rows):
                if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text = rows[i]
            go(i + 1, c + 3, a + "D", o)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                go(i + 1, c + more, a + "K", o + [(role, text)])
                for made in ("user", "assistant"):
                    go(i + 1, c + 2 + more, a + "R", o + [(made, text)])

    go(0, 0, "", [])
    return best


def plain(conversations, solve):
    """Expected digests of ``{conv: [(turn, role, text), ...]}``."""
    out = {}
    for conv, rows in conversations.items():
        said = [(r, t) for _, r, t in rows]
        faults = faults_of(said)
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(said)]
        cost, audit, repaired = solve(said)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def order(rows):
    def key(r):
        digest = hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        return (r[0] is not None, r[0] or 0, digest)
    return sorted(rows, key=key)


def damage(rows):
    """Damaged conversations of ``(conv, turn, role, text)`` rows."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        made = (turn, "user" if what == 4 else role,
                "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
        out[conv] += [] if what == 0 else [made, made] if what == 3 else [made]
    return {conv: order(found) for conv, found in out.items()}


def got(df):
    found = df.collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in found}


def test_query_against_search(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, SF)) == plain(damage(rows), dijkstra)


def random_rows(rng, n_convs, longest):
    rows = []
    for conv in range(n_convs):
        n = rng.randrange(longest)
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            text = rng.choice(["a.", "b!", "c?", "open", "", " \n", "a.", f"t{rng.randrange(9)}.", "é. \x0b"])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, text))
    return rows


def test_both_searches_agree():
    rng = random.Random(1)
    for conv in range(120):
        said = [(r, t) for _, _, r, t in random_rows(rng, 1, 6)]
        assert dijkstra(said) == (*scripts(said)[:2], tuple(scripts(said)[2]))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_random_conversations(spark, block, monkeypatch):
    """Blocks of one row, of a few, and of whole conversations."""
    monkeypatch.setattr(cr, "LEAST_BLOCK", block)
    monkeypatch.setattr(cr.math, "isqrt", lambda n: 0)
    rng = random.Random(block)
    rows = random_rows(rng, 60, 30)
    full = [(*r, "x", 1, 0.5) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(7)
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, role, text))
    assert got(cr.digests(cr.repair_conversations(df))) == plain({c: order(r) for c, r in want.items()}, dijkstra)


def test_one_long_conversation(spark):
    """Spread over many blocks and range partitions, half of it one repeated row."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), "same." if t % 2 else f"text {t}{rng.choice('.!a')}")
            for t in range(6000)]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(5)
    want = plain({7: order([r[1:] for r in rows])}, dijkstra)
    assert got(cr.digests(cr.repair_conversations(df))) == want


def test_edge_rows(spark):
    """Nulls everywhere, repeated rows, no rows, an id that loses all rows."""
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "user", "x" * 50_000), (1, None, "user", None),
            (1, -5, "assistant", "ok."), (1, 9, None, "ok."), (2, 1, "user", "hi!"), (2, 1, "user", "hi!"),
            (2, 2, "assistant", "yes. \n"), (3, 1, "ünser", "日本。")]
    rows += [(c, 0, "user", "?") for c in range(100, 180)]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    made = cr.damaged(df)
    want = plain(damage(rows), dijkstra)
    assert got(cr.digests(cr.repair_conversations(made, df))) == want
    gone = [c for c, v in want.items() if v[6] == ""]
    assert gone and want[gone[0]][:6] == (0, 0, 0, 0, 0, 0)
    assert cr.digests(cr.repair_conversations(made.where("false"))).collect() == []
    only = got(cr.digests(cr.repair_conversations(made.where("false"), df.where("conv_id = 2"))))
    assert only == {2: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_are_real_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "tool", "c"), (1, 4, "assistant", "")],
                               "conv_id long, turn long, role string, text string")
    edits = [(r.pos, r.edit, r.role, r.text, r.fault, r.cost) for r in cr.repair_conversations(df).collect()]
    cost, audit, repaired = dijkstra([("user", "a."), ("user", "b."), ("tool", "c"), ("assistant", "")])
    assert "".join(e[1] for e in edits[:-1]) == audit and edits[-1][1] is None and edits[-1][5] == cost
    assert tuple((e[2], e[3]) for e in edits[:-1] if e[1] != "D") == repaired
    assert [e[0] for e in edits] == list(range(1, len(edits) + 1))
