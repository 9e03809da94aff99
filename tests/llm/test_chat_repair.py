"""Conversation repair: cells against an enumeration of all edits, tables against a plain version of the whole job."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import check
from crawlspark.llm import chat_repair

SOUND = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def all_repairs(rows):
    """(cost, audit) of the best of all edits with at most two insertions at each place. `rows`: (initial, fault)."""
    def options(initial, fault):
        out = [(2, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            out += [(more, "K", initial), (more + 1, "R", "u"), (more + 1, "R", "a")]
        return out

    inserts = [(5 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")]
    places = [inserts]
    for row in rows:
        places += [options(*row), inserts]
    best = min((sum(p[0] for p in chosen), "".join(p[1] for p in chosen)) for chosen in itertools.product(*places)
               if SOUND.fullmatch("".join(p[2] for p in chosen)))
    return best


def best_repair(rows):
    """The same by going through the rows from the left; it also gives the new roles."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(found):
        for _ in range(3):
            for state, (cost, audit, out) in list(found.items()):
                for role in steps[state]:
                    if role != "s":
                        keep(found, role, (cost + 5, audit + "I", out + [(None, role)]))
        return found

    def keep(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    found = inserted({"": (0, "", [])})
    for k, (initial, fault) in enumerate(rows):
        new = {}
        for state, (cost, audit, out) in found.items():
            keep(new, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 if fault == "truncated" else 0
            for role in steps[state]:
                if role == initial:
                    keep(new, role, (cost, audit + "K", out + [(k, None)]))
                if role != "s":
                    keep(new, role, (cost + 1, audit + "R", out + [(k, role)]))
        found = inserted(new)
    return min((found[s] for s in ("", "a") if s in found), key=lambda f: f[:2])


def cell_of(rows):
    return chat_repair.least(chat_repair.combined([chat_repair.row_cell(*r) for r in rows]))


@pytest.mark.parametrize("seed", range(3))
def test_cells_are_the_best_of_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(rng.choice("suuaa?"), rng.choice(["", "", "", "blank", "truncated", "duplicate"]))
                for _ in range(rng.randrange(1, 5))]
        assert cell_of(rows) == all_repairs(rows) == best_repair(rows)[:2]


def test_any_cut_gives_the_same_cell():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice("sua?"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(2, 30))]
        cells = [chat_repair.row_cell(*r) for r in rows]
        cut = rng.randrange(1, len(rows))
        whole = chat_repair.joined(chat_repair.combined(cells[:cut]), chat_repair.combined(cells[cut:]))
        assert whole == chat_repair.combined(cells)
        assert chat_repair.least(whole) == best_repair(rows)[:2]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows, order, everything):
    """What is wrong with every conversation, its audit and its repaired text. `order`: of rows of one turn."""
    result = {c: (0, 0, 0, 0, 0, 0, "", "") for c in everything}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, order(r)))
        faults, seen = [], set()
        for _, _, role, text in mine:
            stripped = text.strip(BLANK)
            fault = ("blank" if not stripped else "duplicate" if (role, text) in seen
                     else "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
            faults.append(fault)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, out = best_repair([(r[2][:1], f) for r, f in zip(mine, faults)])
        full = {"u": "user", "a": "assistant"}
        lines = [f"{mine[k][2] if new is None else full[new]}:{mine[k][3]}" if k is not None else f"{full[new]}:"
                 for k, new in out]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (
                "blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit,
            "\n".join(lines))
    return {c: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for c, r in result.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query(spark, folder):
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damage(given), lambda r: 0, {r[0] for r in given})
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in chat_repair.query(spark, folder).collect()}
    assert got == want


def test_query_has_sql(spark, folder):
    assert check.compare(spark, check.tables(folder), folder, "op13_chat_repair") == ""


def made(seed, n):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No", " ", "", "What? ", "a\nb!\n", "x" * 9000 + ".", None, "ok", "日本。", "end. "]
    for _ in range(n):
        conv = rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6, 7, 2 ** 60 + 1])  # one conversation has a third of all rows
        out.append((conv, rng.choice([None, rng.randrange(300)]), rng.choice(
            ["user", "assistant", "system", "user", "assistant", None, "tool", ""]), rng.choice(texts)))
    return list(dict.fromkeys((c, t) for c, t, _, _ in out)), out


@pytest.mark.parametrize("block,fan", [(512, 64), (4, 3)])
def test_odd_conversations(spark, tmp_path, block, fan):
    """Nulls, blanks, odd roles; a large conversation is parsed in many blocks over several rounds."""
    keys, rows = made(3, 700)
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # ties have an order of their own, see below
    rows += [(8, 5, "user", "a: b."), (8, 5, "user", "a: b.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS n", "2 AS block", "'x' AS conv").repartition(5)
    damaged = chat_repair.damage(table)
    report, repaired = chat_repair.repair(damaged, block, fan)
    found = {r["conv"]: r for r in report.join(chat_repair.digests(repaired), "conv", "left").collect()}
    want = plain(plain_damage(rows), lambda r: 0, {r[0] for r in rows})
    empty = hashlib.sha256(b"").hexdigest()
    for conv, expected in want.items():
        row = found.get(" " if conv is None else str(conv))
        got = tuple(row[c] for c in COLUMNS) if row else (0, 0, 0, 0, 0, 0, "", empty)
        assert (*got[:-1], got[-1] or empty) == expected, conv


def test_ties_go_by_role_then_text(spark):
    rows = [(1, 1, "user", f"{x}.") for x in "abcab"] + [(1, 1, "assistant", "z."), (1, 2, "user", "end.")]
    table = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string").selectExpr(
        "CAST(conv AS string) AS conv", "turn", "role", "text", "1 AS copy")
    results = []
    for parts in (1, 4):
        report, repaired = chat_repair.repair(table.repartition(parts))
        results.append((report.collect(), [tuple(r) for r in repaired.orderBy("out").collect()]))
        assert report.first()["duplicate"] == 2
        assert SOUND.fullmatch("".join(r["role"][0] for r in repaired.orderBy("out").collect()))
    assert results[0] == results[1]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    report, repaired = chat_repair.repair(chat_repair.damage(table))
    assert report.count() == 0 and repaired.count() == 0 and chat_repair.digests(repaired).count() == 0
