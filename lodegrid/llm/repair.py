"""Repair of damaged conversations: the lightest derivation of a well-formed one.

A conversation is well-formed if the first letters of its roles match (s?(ua)+)?. Its rows may be kept, given another
role, or deleted, and turns without text may be inserted, each at a cost. Item (i, q) says that the rows from the i-th
on, read in state q, can be made to end well; its weight is (cost, audit), the audit being the first letters of the
edits. A deduction takes one edit (an axiom of its own cost) and the item that the edit leads to; its weight puts the
edit before that item's: costs add up and audits are joined, which is monotone in both. Items are taken from an agenda by
Knuth's rule until the goal, (0, start), is final. Equal costs are taken by rising number of rows, as keeping a row is
free: so a weight never comes before those that it is made of. Each letter is one deduction of an item at most, and so
equal costs of an item are settled by the first letters alone: no audit is written out before the goal is final.

Rows are dealt by conversation and sorted; each comes twice, first narrow (what the derivation asks of it), then with its
text, which is written out as the edits say. A task holds some 100 bytes for each row of one conversation and never its
texts, so that a conversation may be longer than memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .manifest import CRC_SQL, crc32_sql

#: Costs of the edits; a truncated row that stays costs `truncated` on top.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
#: States by the first letter of the last role: none yet, s, u, a. What a turn of the user or assistant does to each (-1: nothing good).
START, SYSTEM, USER, ASSISTANT = range(4)
_TURN = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: The only turn that a state may go on with besides s.
_NEXT = "uuau"
_ROLE = {"u": "user", "a": "assistant"}
_LETTERS = "DIKR"  # ASCII order
_BLANKS = " \t\n\x0b\x0c\r"


def _moves(role: str, fault: int, costs: dict) -> list[tuple[int, int, int, int]]:
    """(state, letter, state that the edit leads to, cost) of the edits of a row. fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    out = [(q, 0, q, costs["D"]) for q in range(4)]
    if fault not in (1, 2):
        more = costs["truncated"] if fault == 3 else 0
        for q in range(4):
            if role in _TURN and _TURN[role][q] >= 0:
                out.append((q, 2, _TURN[role][q], costs["K"] + more))
            out.append((q, 3, _TURN[_NEXT[q]][q], costs["R"] + more))
    return out


def lightest(roles: str, faults: bytes, costs: dict = COSTS) -> tuple[int, str]:
    """Cost and audit of the lightest repair of rows with these first letters of roles and faults (0 to 3)."""
    n = len(roles)
    kinds: dict[tuple[str, int], list[list[tuple[int, int, int]]]] = {}
    for kind in set(zip(roles, faults)):
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
        for q, letter, to, cost in _moves(*kind, costs):
            into[to].append((q, letter, cost))
        kinds[kind] = into
    inserts: list[list[tuple[int, int]]] = [[] for _ in range(4)]
    for q in range(4):
        inserts[_TURN[_NEXT[q]][q]].append((q, costs["I"]))
    # An agenda's entry is one number: cost, rows covered, state, letter.
    span = n + 1
    best = np.full(4 * span, -1, np.int8)
    weight = [-1] * (4 * span)
    agenda = [(q << 2) for q in (START, ASSISTANT)]
    while agenda:
        entry = heapq.heappop(agenda)
        letter, q, (cost, rows) = entry & 3, entry >> 2 & 3, divmod(entry >> 4, span)
        at = 4 * rows + q
        if weight[at] >= 0:
            continue
        weight[at], best[at] = cost, letter
        if rows == n and q == START:
            break
        for p, more in inserts[q]:
            if weight[4 * rows + p] < 0:
                heapq.heappush(agenda, ((cost + more) * span + rows << 4) | p << 2 | 1)
        if rows < n:
            k = n - rows - 1
            for p, own, more in kinds[roles[k], faults[k]][q]:
                if weight[4 * rows + 4 + p] < 0:
                    heapq.heappush(agenda, ((cost + more) * span + rows + 1 << 4) | p << 2 | own)
    out, rows, q = bytearray(), n, START
    while rows or q not in (START, ASSISTANT):
        letter = int(best[4 * rows + q])
        out.append(ord(_LETTERS[letter]))
        if letter == 2:
            q = _TURN[roles[n - rows]][q]
        elif letter:
            q = _TURN[_NEXT[q]][q]
        rows -= letter != 1
    return weight[4 * n + START], out.decode()


def damaged(rows: DataFrame, at: Column) -> DataFrame:
    """rows (conv_id, turn, role, text) with damage by `at` (0 to 19): 0 drops the row (gone is true), 1 empties its text,
    2 takes its . ! ? out, 3 repeats it, 4 makes the user its speaker."""
    hit = rows.withColumn("_at", at)
    hit = hit.withColumn("text", F.when(F.col("_at") == 1, "").when(F.col("_at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    hit = hit.withColumn("role", F.when(F.col("_at") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("_at") == 0)
    return hit.withColumn("_copy", F.explode(F.when(F.col("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_at", "_copy")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "position long, edit string, role string, text string"


def _faults(blank: np.ndarray, cut: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """First fault of each row; digest: two numbers for role and text."""
    out = np.zeros(len(blank), np.int8)
    out[cut] = 3
    if len(digest) > 1:
        order = np.lexsort((digest[:, 1], digest[:, 0]))  # stable: of equal ones, the earlier row first
        same = (digest[order[1:]] == digest[order[:-1]]).all(1)
        out[order[1:][same]] = 2
    out[blank] = 1
    return out


class _Plan:
    """What the narrow rows of one conversation say, and the edits that are left for its texts."""

    def __init__(self, parts: list[pa.RecordBatch], costs: dict):
        rows = pa.Table.from_batches(parts)
        rows = rows.filter(pc.invert(rows.column("gone")))
        digest = np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")], 1) if rows.num_rows else np.zeros((0, 2), np.int64)
        fault = _faults(rows.column("blank").to_numpy(), rows.column("cut").to_numpy(), digest)
        letters = rows.column("initial").to_pylist()
        roles = "".join(x if x in _TURN else "-" for x in letters)
        turns = rows.column("turn").drop_null().to_numpy()
        gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, self.audit = lightest(roles, fault.tobytes(), costs)
        self.summary = (gaps, int((fault == 1).sum()), int((fault == 2).sum()), int((fault == 3).sum()), illegal, cost, self.audit)
        self.at, self.state, self.position = 0, START, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns that are put in here: edit, role, text."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            letter = _NEXT[self.state]
            self.at, self.state = self.at + 1, _TURN[letter][self.state]
            yield "I", _ROLE[letter], ""

    def taken(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What the next row of the conversation becomes, after what is put in before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            letter = role[0] if edit == "K" else _NEXT[self.state]
            self.state = _TURN[letter][self.state]
            yield edit, role if edit == "K" else _ROLE[letter], text


def repaired(rows: DataFrame, costs: dict = COSTS, summary: bool = True) -> DataFrame:
    """The lightest repair of each conversation. rows: conv_id, turn, role, text and, if there is one, gone (rows that only
    say that their conversation exists). Other columns are left out.

    With summary, one row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    `role:text` of its turns, joined by newlines). Else one row for each turn that it has after the repair: position from
    0, edit (K, R or I), role, text.

    Rows go by turn, nulls first; of equal turns, by role and then by a hash of the text, so that copies are adjacent.
    Null roles and texts are one space; a role whose first letter is none of s, u, a (an
    empty one, too) can't be kept; a null conv_id is a conversation of its own. A row's
    first fault counts: blank, duplicate (role and text seen earlier in the conversation, deleted rows too), truncated.
    No rows: zeros, an empty audit, the hash of the empty string."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    each = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    end = F.rtrim("text", F.lit(_BLANKS))
    pair = F.concat("role", F.lit("\x00"), "text")
    each = each.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.conv(F.substring(F.md5(pair), 1, 15), 16, 10).cast("long"), "initial": F.substring("role", 1, 1), "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    twice = each.withColumn("late", F.explode(F.when(F.col("gone"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    twice = twice.withColumn("text", F.when(F.col("late"), F.col("text")))
    order = ["conv_id", "late", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    dealt = twice.repartition("conv_id").sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts, plan, sha, first = None, [], None, None, True
        ids, out = [], []

        def closed() -> None:
            nonlocal plan
            if plan is None:
                plan = _Plan(parts, costs)
            for turn in plan.inserted():
                put(turn)
            if summary:
                ids.append(conv)
                out.append((*plan.summary, sha.hexdigest()))

        def put(turn: tuple[str, str, str]) -> None:
            edit, said_by, said = turn
            if summary:
                sha.update(f"{chr(10) * (plan.position > 0)}{said_by}:{said}".encode())
            else:
                ids.append(conv)
                out.append((plan.position, edit, said_by, said))
            plan.position += 1

        def sent() -> pa.RecordBatch:
            names = [x.split()[0] for x in (_SUMMARY if summary else _ROWS).split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in (_SUMMARY if summary else _ROWS).split(", ")]
            columns = list(zip(*out)) if out else [()] * len(names)
            batch = pa.record_batch([pa.array(ids, of), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["conv_id", *names])
            ids.clear(), out.clear()
            return batch

        of = pa.int64()
        for batch in batches:
            of = batch.column("conv_id").type
            convs, late = batch.column("conv_id").to_pylist(), batch.column("late").to_pylist()
            at = 0
            while at < len(convs):
                end = at
                while end < len(convs) and convs[end] == convs[at] and late[end] == late[at]:
                    end += 1
                if first or convs[at] != conv:
                    if not first:
                        closed()
                    conv, parts, plan, sha, first = convs[at], [], None, hashlib.sha256(), False
                if not late[at]:
                    parts.append(batch.slice(at, end - at).select(["turn", "initial", "blank", "cut", "gone", "h1", "h2"]))
                else:
                    if plan is None:
                        plan, parts = _Plan(parts, costs), []
                    for said_by, said in zip(batch.column("role").slice(at, end - at).to_pylist(), batch.column("text").slice(at, end - at).to_pylist()):
                        for turn in plan.taken(said_by, said):
                            put(turn)
                at = end
            if out:
                yield sent()
        if not first:
            closed()
            yield sent()

    return dealt.mapInArrow(work, f"conv_id {kind}, {_SUMMARY if summary else _ROWS}")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum of their ids and turns, and repaired."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return repaired(damaged(rows, F.crc32(key) % 20))


def _sql() -> str:
    """From the last row back: for each state, the lightest end of the conversation as {cost, audit, text}."""
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    edit = lambda s, cost, letter, text="''": f"{{'c': {s}.c + {cost}, 'a': '{letter}' || {s}.a, 't': {text} || {s}.t}}"
    named = lambda q: f"chr(10) || '{_ROLE[_NEXT[q]]}:'"
    to = [_TURN[_NEXT[q]][q] for q in range(4)]

    def closed(raw: list[str]) -> str:
        """With up to two turns put in before the row."""
        once = lambda table, q: f"list_min([raw[{q + 1}], {edit(f'{table}[{to[q] + 1}]', 5, 'I', named(q))}])"
        first = f"(SELECT [{', '.join(once('raw', q) for q in range(4))}] AS one, raw FROM (SELECT [{', '.join(raw)}] AS raw))"
        return f"(SELECT [{', '.join(once('one', q) for q in range(4))}] FROM {first})"

    rows = []
    for q in range(4):
        options = [edit(f"s[{q + 1}]", 2, "D")]
        for letter, moves in _TURN.items():
            if moves[q] >= 0:
                options.append(f"CASE WHEN fault IN (0, 3) AND role[1] = '{letter}' THEN {edit(f's[{moves[q] + 1}]', 'more', 'K', 'chr(10) || role || chr(58) || text')} ELSE {never} END")
        options.append(f"CASE WHEN fault IN (0, 3) THEN {edit(f's[{to[q] + 1}]', '(1 + more)', 'R', f'{named(q)} || text')} ELSE {never} END")
        rows.append(f"list_min([{', '.join(options)}])")
    good = "{'c': 0, 'a': '', 't': ''}"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""WITH RECURSIVE {CRC_SQL},
d AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS hit FROM conversations, crc),
e AS (SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) u(c) WHERE hit <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM p),
r AS (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM f),
dp AS (SELECT conv, max(i) + 1 AS i, {closed([good, never, never, good])} AS s FROM f GROUP BY conv
  UNION ALL SELECT dp.conv, r.i, {closed(rows)} FROM dp JOIN r ON r.conv = dp.conv AND r.i = dp.i - 1),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s[1].c, 0)::BIGINT AS cost, coalesce(s[1].a, '') AS audit, sha256(coalesce(s[1].t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM d) o LEFT JOIN counts USING (conv) LEFT JOIN dp ON dp.conv = o.conv AND dp.i = 1"""


OP12_SQL = _sql()
