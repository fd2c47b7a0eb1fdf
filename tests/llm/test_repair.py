"""The repair against a search over all edits, and the query's rows against plain Python."""

import random
import zlib
from functools import cache

import pytest

from lectern.llm import queries, repair
from lectern.llm.arrow import sha


def cheapest(turns):
    """Least (cost, audit) by trying every edit at every place; turns are (initial, code of the fault)."""

    @cache
    def best(at, state, inserted):
        """state: 0 nothing yet, 1 after s, 2 after u, 3 after a; what is left of the least edits."""
        options = [(0, "")] if at == len(turns) and state in (0, 3) else []
        after = {"u": 2, "a": 3, "s": 1}

        def allowed(symbol):
            return {"s": state == 0, "u": state in (0, 1, 3), "a": state == 2}[symbol]

        def add(cost, edit, rest):
            if rest:
                options.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            for symbol in "ua":
                if allowed(symbol):
                    add(3, "I", best(at, after[symbol], inserted + 1))
        if at < len(turns):
            symbol, fault = turns[at]
            add(4, "D", best(at + 1, state, 0))
            if fault < 2:
                if symbol in after and allowed(symbol):
                    add(3 * fault, "K", best(at + 1, after[symbol], 0))
                for to in "ua":
                    if allowed(to):
                        add(3 + 3 * fault, "R", best(at + 1, after[to], 0))
        return min(options, default=None)

    return best(0, 0, 0)


def test_parser_finds_the_cheapest_edits():
    parser, rng = repair.Parser(), random.Random(3)
    cases = [[(rng.choice("suax"), rng.choice((0, 0, 0, 1, 2))) for _ in range(rng.randrange(9))] for _ in range(4000)]
    cases += [[(a, f), (b, g), (c, 0)] for a in "suax" for b in "suax" for c in "suax" for f in range(3) for g in range(3)]
    for turns in cases:
        codes = bytes(repair.code_of(s, f) for s, f in turns)
        assert parser.parse(codes) == cheapest(tuple(turns)), turns


def test_long_conversations_share_few_sets():
    parser, rng = repair.Parser(), random.Random(4)
    codes = bytes(rng.randrange(12) for _ in range(200_000))
    cost, audit = parser.parse(codes)
    assert cost > 0 and sum(e != "I" for e in audit) == len(codes)
    assert len(parser.sets) < 500
    alike = parser.parse(bytes([repair.code_of("user", 0)]) * 100_000)
    assert sum(e != "I" for e in alike[1]) == 100_000


def fault_of(turn, seen):
    role, text = turn
    body = text.strip(" \t\n\x0b\x0c\r")
    if not body:
        return repair.BLANK
    if turn in seen:
        return repair.REPEATED
    return repair.SOUND if body[-1] in ".!?" else repair.CUT_SHORT


def brute(rows):
    """The contract's row of a conversation, from (turn, role, text) after damage in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault_of((role, text), seen))
        seen.add((role, text))
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(tuple((i, min(f, 2)) for i, f in zip(initials, faults)))
    out, left, wanted = [], list(rows), "user"
    for edit in audit:
        turn = left.pop(0) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K" and turn[1].startswith("s") and not out:
            out.append(f"{turn[1]}:{turn[2]}")
            continue
        out.append(f"{turn[1] if edit == 'K' else wanted}:{turn[2] if turn else ''}")
        wanted = "assistant" if wanted == "user" else "user"
    return gaps, faults.count(repair.BLANK), faults.count(repair.REPEATED), faults.count(repair.CUT_SHORT), illegal, cost, audit, sha("\n".join(out))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        names = [" " if x is None else x for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{names[0]}:{names[1]}".encode()) % 20
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def wanted(rows):
    found, left = {}, damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        found[conv] = brute(own) if own else (0, 0, 0, 0, 0, 0, "", sha(""))
    return found


DDL = "conv_id long, turn long, role string, text string"
COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_query_equals_brute_force(spark):
    from lectern.runtime import load

    rows = [tuple(r) for r in load(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair(spark, "/root/testdata/sf0.01").collect()}
    assert out == wanted(rows) and any(r[5] for r in out.values())


def test_edges(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Yes.", "no", "", " \t", None, "What?", "x" * 300_000 + ".", "a.\n", "b ", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [None, *range(60)]:
        numbers = rng.sample(range(40), rng.randrange(1, 8))
        rows += [(conv, n, rng.choice(roles), rng.choice(texts)) for n in numbers]
    rows += [(100, None, "user", "no number."), (100, 3, "assistant", "ok."), (100, 9, "user", "ok."), (101, 7, "u", "kept."), (101, 8, "a", "kept.")]
    clash = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL + ", fault int, digest string, place int")
    clash.write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair(spark, str(tmp_path)).collect()}
    assert out == wanted(rows)
    # Repeated rows are repeated turns, and a turn that repeats is deleted.
    twice = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Hi.")], DDL)
    row = repair.repaired(twice).first()
    assert (row.duplicate, row.cost, row.audit) == (1, 4, "KDK")
    made = [tuple(r) for r in repair.repaired_turns(twice).orderBy("place").collect()]
    assert made == [(1, 0, "K", "user", "Hi."), (1, 1, "K", "assistant", "Hi.")]
    assert repair.repaired(spark.createDataFrame([], DDL)).count() == 0 == repair.repaired_turns(spark.createDataFrame([], DDL)).count()


@pytest.mark.parametrize("roles,cost,audit", [("", 0, ""), ("s", 4, "D"), ("ua", 0, "KK"), ("au", 6, "IKKI"), ("uua", 3, "KIKK"), ("ssua", 4, "DKKK")])
def test_small_cases(roles, cost, audit):
    found = repair.Parser().parse(bytes(repair.code_of(r, 0) for r in roles))
    assert found == cheapest(tuple((r, 0) for r in roles)) == (cost, audit)
