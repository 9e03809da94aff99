"""Repair of damaged conversations by weighted interval parsing.

Sound conversations have role initials `(s?(ua)+)?`. The repair grammar is in
Chomsky normal form. Its symbols X_pq stand for spans of rows whose edits lead the
form from state p to state q (0 begun, 1 after s, 2 after u, 3 after ua); binary
rules are X_pr -> X_pq X_qr, terminal rules keep, rerole or delete a row, and
inserted turns are rules over the empty span, of which every cell holds the
closure. A span's cell holds the least (cost, audit) of every symbol. Cells are
combined bottom-up by span length, in doubling steps: as a symbol names the states
at both ends of its span and cells are closed under insertions, every way to cut a
span gives the same cell, and one is enough. Audits of one span and cost are never
prefixes of one another (the longer would have a further insertion and so cost
more), so the least audit of a span is made of the least audits of its parts.

Rows are ordered in fixed partitions, numbered, and parsed in blocks of `BLOCK`
rows; blocks of a conversation are combined `FAN` at a time in rounds of grouping,
until each conversation has one cell, so a conversation that holds a third of all
rows is parsed by many tasks. Its audit is then cut at the blocks and every row
gets its own edit.

Defined results: nulls in role and text count as one space; rows go by turn (nulls
first), then by role and a hash of the text; rows without a conversation id are a
conversation of their own; empty texts are blank; a role's initial is its first
character, whatever follows; texts of any length stay in their rows; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices
from .common import arrow, read, saved

#: Rows that are parsed at once; blocks combined in one group; rows that a task hands on at once.
BLOCK, FAN, STEP = 512, 64, 4096
#: Costs of edits.
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"

#: Where a kept initial or a new role leads from a state.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_STATES = range(4)
_SPAN = ("conv string, block bigint, n bigint, first string, last string, illegal bigint, "
         "cell array<struct<p:int,q:int,cost:bigint,audit:string>>")

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """Binary rules over two spans side by side."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in _STATES:
            if (q, r) in right:
                more, rest = right[q, r]
                new = (cost + more, audit + rest)
                if (p, r) not in out or new < out[p, r]:
                    out[p, r] = new
    return out


def _empty_span() -> Cell:
    """The closure of insertions: from a state to another by inserted turns alone."""
    cell: Cell = {(p, p): (0, "") for p in _STATES}
    step = cell | {(p, q): (INSERT, "I") for (p, role), q in _NEXT.items() if role != "s"}
    for _ in _STATES:
        longer = joined(cell, step)
        cell |= {k: v for k, v in longer.items() if k not in cell or v < cell[k]}
    return cell


EMPTY = _empty_span()
_single: dict[tuple[str, str], Cell] = {}


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row, with insertions before and after it. `fault`: blank, duplicate, truncated or nothing."""
    initial = initial if initial in ("s", "u", "a") else "?"
    if (initial, fault) not in _single:
        edits: Cell = {(p, p): (DELETE, "D") for p in _STATES}
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            for (p, role), q in _NEXT.items():
                options = [(more, "K")] if role == initial else []
                options += [(more + RETITLE, "R")] if role != "s" else []
                if options:
                    edits[p, q] = min(options)
        _single[initial, fault] = joined(joined(EMPTY, edits), EMPTY)
    return _single[initial, fault]


def combined(cells: list[Cell]) -> Cell:
    """The cell of spans side by side, combined by twos into longer and longer spans."""
    while len(cells) > 1:
        cells = [joined(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i]
                 for i in range(0, len(cells), 2)]
    return cells[0]


def least(cell: Cell) -> tuple[int, str]:
    """The cheapest sound conversation of a whole one's cell, by audit among equals."""
    return min(v for k, v in cell.items() if k in ((0, 0), (0, 3)))


def _listed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _illegal(before: str, after: str) -> int:
    return before + after not in ("su", "ua", "au")


_CELL = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SPAN_SCHEMA = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("first", pa.string()),
                          ("last", pa.string()), ("illegal", pa.int64()), ("cell", _CELL)])


def _row(conv: str, block: int, spans: list[tuple[int, str, str, int, Cell]]) -> dict:
    """One span of spans side by side: (rows, first initial, last initial, illegal pairs inside, cell)."""
    return {
        "conv": conv, "block": block, "n": sum(s[0] for s in spans), "first": spans[0][1], "last": spans[-1][2],
        "illegal": sum(s[3] for s in spans) + sum(_illegal(a[2], b[1]) for a, b in zip(spans, spans[1:])),
        "cell": _listed(combined([s[4] for s in spans]))}


# --- rows ------------------------------------------------------------------

def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """`conv`, `turn`, `role`, `text` after damage that a checksum of conversation and turn decides."""
    plain = turns.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    chosen = plain.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return chosen.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).select(
        "conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows with their partition and number in it by conversation; their turns, initials and first faults."""
    order = ["turn", "role", "hash", "copy"]
    kept = slices.ordered(
        rows.select("conv", "turn", "role", "text", "copy", F.xxhash64("text").alias("hash"),
                    F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("same")), ["conv"], order)
    numbered = saved(kept.withColumn("n", F.row_number().over(slices.inside(["conv"], order)).cast("bigint") - 1),
                     "numbered")
    place = F.shiftleft(F.col(slices.PART).cast("bigint"), 40) + F.col("n")
    first = saved(numbered.groupBy("conv", "same").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
                  .where("copies > 1").drop("copies"), "first")
    seen = numbered.join(first, ["conv", "same"], "left")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(trimmed == "", "blank").when(place > F.col("first"), "duplicate")
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    return numbered, saved(seen.select(slices.PART, "conv", "n", "turn", F.substring("role", 1, 1).alias("initial"),
                                       fault.alias("fault")), "faults")


def parsed(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Cells of whole conversations, and where the blocks of each are: `conv`, `block`, part, its block there, `n`."""
    def cells(batches):
        for batch in batches:
            out = []
            for conv, number, rows in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "rows"))):
                rows = sorted((r["n"], r["initial"], r["fault"]) for r in rows)
                out.append(_row(conv, number, [(1, i, i, 0, row_cell(i, f)) for _, i, f in rows]))
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, _SPAN_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _SPAN_SCHEMA)

    def longer(batches):
        for batch in batches:
            for conv, number, spans in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "spans"))):
                spans = sorted(spans, key=lambda s: s["block"])
                yield pa.RecordBatch.from_pylist([_row(conv, number, [
                    (s["n"], s["first"], s["last"], s["illegal"],
                     {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cell"]}) for s in spans])], _SPAN_SCHEMA)

    slim = F.struct("n", "initial", "fault")
    within = rows.withColumn("place", F.floor(F.col("n") / block)).groupBy("conv", slices.PART, "place").agg(
        F.collect_list(slim).alias("rows"))
    # blocks are numbered through the partitions of a conversation; those numbers have gaps, which does no harm
    number = F.shiftleft(F.col(slices.PART).cast("bigint"), 40) + F.col("place")
    spans = saved(within.select("conv", number.alias("block"), "rows").mapInArrow(cells, _SPAN), "spans")
    blocks = slices.row_numbers(spans.select("conv", "block", "n"), ["conv"], ["block"], "number")
    blocks = saved(blocks.select("conv", "block", (F.col("number") - 1).alias("number"), "n"), "blocks")
    spans = saved(spans.join(blocks.select("conv", "block", "number"), ["conv", "block"]).drop("block").withColumnRenamed(
        "number", "block").select(*[f.split()[0] for f in _SPAN.split(", ")]), "spans")
    while spans.where("block > 0").head(1):
        together = spans.select("conv", F.floor(F.col("block") / fan).alias("group"), F.struct(
            "block", "n", "first", "last", "illegal", "cell").alias("span")).groupBy("conv", "group").agg(
            F.collect_list("span").alias("spans")).select("conv", F.col("group").alias("block"), "spans")
        spans = saved(together.mapInArrow(longer, _SPAN), "spans")
    return spans, blocks


def audits(spans: DataFrame) -> DataFrame:
    """`conv`, `illegal`, `cost`, `audit` of every conversation, stored."""
    def run(batches):
        for batch in batches:
            out = []
            for conv, illegal, cell in zip(*(batch.column(c).to_pylist() for c in ("conv", "illegal", "cell"))):
                cost, audit = least({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell})
                out.append({"conv": conv, "illegal": illegal, "cost": cost, "audit": audit})
            if out:
                yield arrow(out, "conv string, illegal bigint, cost bigint, audit string")

    return saved(spans.mapInArrow(run, "conv string, illegal bigint, cost bigint, audit string"), "audits")


def repaired_rows(rows: DataFrame, whole: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """`conv`, `out` (place in the repaired conversation), `edit`, `role`, `text` of all rows that it has, stored."""
    schema = "conv string, row bigint, out bigint, edit string, new_role string"

    def run(batches):
        edits = []
        for batch in batches:
            for conv, audit, has_system in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "system"))):
                row = out = 0
                for letter in audit:
                    if letter != "D":
                        # states fix every role but that of a kept system turn, which only the first can be
                        role = None if letter == "K" else ("user", "assistant")[(out - has_system) % 2]
                        edits.append((conv, -1 if letter == "I" else row, out, letter, role))
                        out += 1
                    row += letter != "I"
                    if len(edits) >= STEP:
                        yield batch_of(edits)
                        edits = []
        if edits:
            yield batch_of(edits)

    def batch_of(edits):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*edits), kinds)],
                                          [f.split()[0] for f in schema.split(", ")])

    # a row's number in its conversation: those of earlier blocks, and its place in its own
    upto = slices.running_sum(blocks, ["conv"], ["block"], "n", "upto")
    begin = saved(upto.select("conv", "block", (F.col("upto") - F.col("n")).alias("begin")), "begins")
    number = F.shiftleft(F.col(slices.PART).cast("bigint"), 40) + F.floor(F.col("n") / block)
    placed = rows.select("conv", "role", "text", "n", number.alias("block")).join(begin, ["conv", "block"]).select(
        "conv", (F.col("begin") + F.col("n") % block).alias("row"), "role", "text")
    edits = saved(systems(whole, placed).mapInArrow(run, schema), "edits")
    kept = edits.where("row >= 0").join(placed, ["conv", "row"]).select(
        "conv", "out", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.where("row < 0").select("conv", "out", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return saved(kept.unionByName(added), "repaired")


def systems(whole: DataFrame, placed: DataFrame) -> DataFrame:
    """Audits, and whether the repaired conversation begins with a kept system turn (1) or not (0)."""
    # the first row that isn't deleted; it begins the repaired conversation unless a turn is inserted before it
    lead = F.regexp_extract("audit", "^D*", 0)
    begins = whole.select("conv", "audit", F.char_length(lead).cast("bigint").alias("row"),
                          (F.substring(F.col("audit"), F.char_length(lead) + 1, F.lit(1)) == "K").alias("kept"))
    kept = begins.where("kept").join(placed.select("conv", "row", F.substring("role", 1, 1).alias("initial")),
                                     ["conv", "row"]).where("initial = 's'").select("conv", F.lit(1).alias("system"))
    return begins.select("conv", "audit").join(kept, "conv", "left").select(
        "conv", "audit", F.coalesce("system", F.lit(0)).alias("system"))


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """What is wrong with every conversation of `rows` (`conv`, `turn`, `role`, `text`, `copy`), and its repaired rows.

    The first has `conv`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`.
    """
    numbered, faults = with_faults(rows)
    spans, blocks = parsed(faults, block, fan)
    whole = audits(spans)
    counts = faults.groupBy("conv").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = faults.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    report = counts.join(whole, "conv").join(turns, "conv", "left").select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", "audit")
    return report, repaired_rows(numbered, whole, blocks, block)


def digests(repaired: DataFrame) -> DataFrame:
    """`conv`, `repaired_sha256`: a digest of `role:text` of every conversation's rows, one after the other."""
    def run(batches):
        conv, digest = None, None
        for batch in batches:
            out = []
            for key, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
                if key != conv:
                    if digest is not None:
                        out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = key, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if out:
                yield arrow(out, "conv string, repaired_sha256 string")
        if digest is not None:
            yield arrow([{"conv": conv, "repaired_sha256": digest.hexdigest()}], "conv string, repaired_sha256 string")

    lines = repaired.select("conv", "out", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "out").select("conv", "line").mapInArrow(
        run, "conv string, repaired_sha256 string")


def query(spark, folder) -> DataFrame:
    turns = read(spark, folder, "conversations")
    report, repaired = repair(damage(turns))
    every = turns.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = every.join(report, "conv", "left").join(digests(repaired), "conv", "left")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(i ORDER BY i) AS bits FROM range(8) AS r(i)
), crc AS (
  SELECT list(list_reduce(list_prepend(b, bits),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b), steps
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), checked AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1)))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind FROM given, crc
), damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM checked, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faulty AS (
  SELECT conv_id, turn, k, role, text, substr(role, 1, 1) AS i, substr(before, 1, 1) || substr(role, 1, 1) AS pair,
    CASE WHEN trimmed = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT suffix(trimmed, '.') AND NOT suffix(trimmed, '!') AND NOT suffix(trimmed, '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), moves(p, role, q) AS (
  VALUES (0, 'system', 1), (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), edits AS (
  SELECT f.conv_id, f.k, p, p AS q, 2 AS cost, 'D' AS edit, NULL AS line FROM faulty f, range(4) AS s(p)
  UNION ALL
  SELECT f.conv_id, f.k, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', f.role || ':' || text
  FROM faulty f, moves m WHERE f.i = substr(m.role, 1, 1) AND fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.k, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', m.role || ':' || text
  FROM faulty f, moves m WHERE m.role <> 'system' AND fault NOT IN ('blank', 'duplicate')
), added(p, q, cost, audit, lines) AS (
  SELECT p, p, 0, '', []::VARCHAR[] FROM range(4) AS s(p)
  UNION ALL VALUES (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']),
    (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])
), parsed AS (
  SELECT conv_id, 0 AS k, q AS state, {'cost': cost, 'audit': audit, 'lines': lines} AS best
  FROM (SELECT DISTINCT conv_id FROM faulty), added WHERE p = 0
  UNION ALL
  SELECT parsed.conv_id, parsed.k + 1, a.q, min({
    'cost': best.cost + e.cost + a.cost, 'audit': best.audit || e.edit || a.audit,
    'lines': list_concat(best.lines, CASE WHEN e.line IS NULL THEN []::VARCHAR[] ELSE [e.line] END, a.lines)})
  FROM parsed JOIN edits e ON e.conv_id IS NOT DISTINCT FROM parsed.conv_id AND e.k = parsed.k + 1 AND e.p = parsed.state
  JOIN added a ON a.p = e.q GROUP BY ALL
), found AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
), whole AS (
  SELECT found.*, (SELECT min(best) FROM parsed WHERE parsed.conv_id IS NOT DISTINCT FROM found.conv_id
    AND parsed.k = found.n AND state IN (0, 3)) AS best FROM found
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT every.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM every.conv_id
"""
