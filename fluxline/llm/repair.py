"""Conversation structure repair: the cheapest edits that give a conversation the form (system?, (user, assistant)+) or nothing at all.

Retained-subsequence DP. Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a truncated turn that is not
deleted adds 1, and blank or duplicate turns must go. What stays of a conversation is a sequence of kept or reroled turns whose states are the first
letters of their roles. Between two retained turns all others are deleted, at a price that is a difference of prefix sums, and the pair of roles
determines how many turns are inserted. So each state holds one running minimum of (cost so far - prefix sum), and a turn is priced from the four minima:
linear in turns. Of equal costs the least audit in ASCII order wins. Audits that end in a turn's letter after as many turns are never one another's
beginning (they have as many letters but I), so their order is decided for good where they differ: the DP carries the rank of each state's audit among
the four instead of the audit itself, and back pointers give the best one in the end.

Null roles and texts count as one space, and so do null ids and turns in the dealt damage; turns order by (turn, role, text), null first. An empty role
has no first letter and can't be kept. A repeated row is a duplicate; a null conv_id is one conversation; an empty table gives an empty one; further
columns are not read. The repaired text is digested as a whole, so a conversation must fit one row (2 GB); its rows are gathered map side first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
#: What goes in between the state before ("": nothing yet) and the next one; the last column is the end. Pairs not listed can't follow one another.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
AT_END = {"": "", "s": "ua", "u": "a", "a": ""}
#: A character that is no ASCII white space, and the last of them.
SOLID, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def faults_of(turns: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen, out = set(), []
    for turn in turns:
        last = LAST.search(turn[1])
        out.append("blank" if last is None else "duplicate" if turn in seen else "" if last[1] in ".!?" else "truncated")
        seen.add(turn)
    return out


def cheapest(initials: list[str], faults: list[str]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(place or -1 for an inserted turn, state)]): the cheapest edits, of equal ones the ASCII-least."""
    held = {"": (0, 0, None)}  # state: cost less the deletions so far, rank of its audit, node (place, letter, state, inserted, node before)
    for i, (initial, fault) in enumerate(zip(initials, faults)):
        made = {s: (cost, (rank, "D"), node) for s, (cost, rank, node) in held.items()}
        if fault in ("", "truncated"):
            own = TRUNCATED * (fault == "truncated") - DELETE
            for (before, state), inserted in BETWEEN.items():
                if before in held and (state != "s" or initial == "s"):
                    cost, rank, node = held[before]
                    letter = "K" if state == initial else "R"
                    new = (cost + INSERT * len(inserted) + own + (KEEP if letter == "K" else REROLE), (rank, "I" * len(inserted) + letter))
                    if state not in made or new < made[state][:2]:
                        made[state] = (*new, (i, letter, state, inserted, node))
        order = {key: r for r, key in enumerate(sorted(m[1] for m in made.values()))}
        held = {s: (cost, order[key], node) for s, (cost, key, node) in made.items()}
    n = len(initials)
    cost, _, last = min((cost + DELETE * n + INSERT * len(AT_END[s]), rank, s) for s, (cost, rank, _) in held.items())
    node = held[last][2]
    parts, end = [("D" * (n - 1 - (node[0] if node else -1)) + "I" * len(AT_END[last]), [(-1, s) for s in AT_END[last]])], node
    while end:
        i, letter, state, inserted, before = end
        parts.append(("D" * (i - 1 - (before[0] if before else -1)) + "I" * len(inserted) + letter, [(-1, s) for s in inserted] + [(i, state if letter == "R" else "")]))
        end = before
    return cost, "".join(p[0] for p in reversed(parts)), [x for p in reversed(parts) for x in p[1]]


def repair_one(turns: list[tuple[str, str]]) -> dict:
    """Faults, audit, cost and repaired turns of one conversation of ordered (role, text)."""
    faults, initials = faults_of(turns), [r[:1] for r, _ in turns]
    cost, audit, kept = cheapest(initials, faults)
    pairs = [a + b for a, b in zip(initials, initials[1:])]
    repaired = [{"role": ROLE[s] if s else turns[i][0], "text": turns[i][1] if i >= 0 else ""} for i, s in kept]
    return {f: faults.count(f) for f in ("blank", "duplicate", "truncated")} | {"illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired": repaired}


OUT = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired": "array<struct<role:string,text:string>>"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}


def _repair(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            got = [repair_one([(t["role"], t["text"]) for t in turns]) for turns in some.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("row"), *(pa.array([g[c] for g in got], _ARROW[t]) for c, t in OUT.items())], ["row", *OUT])


def _space(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with copies array<struct<turn, role, text>>: what is left of each row, none, one or two."""
    role, text = _space(rows, "role"), _space(rows, "text")
    kind = C.crc_bucket(F.concat(_space(rows, "conv_id"), F.lit(":"), _space(rows, "turn")), 20)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    one = F.struct(rows["turn"].alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"))
    return rows.select("conv_id", F.array_repeat(one, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same table of rows as they are."""
    return rows.select("conv_id", F.array(F.struct(rows["turn"].alias("turn"), _space(rows, "role").alias("role"), _space(rows, "text").alias("text"))).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation of rows (conv_id, copies), see damage and
    undamaged. gaps: turn numbers that are missing between the least and the greatest."""
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("copies"))).alias("turns"))
    seen = F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull()))
    gaps = F.when(F.size(seen) > 0, F.array_max(seen) - F.array_min(seen) + 1 - F.size(seen)).otherwise(0)
    whole = whole.select("conv_id", gaps.cast("long").alias("gaps"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return C.mapped(whole, "turns", _repair, OUT)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    done = repair(damage(C.table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.encode(text, "UTF-8"), 256).alias("repaired_sha256"))


#: crc32 by the rule of its table, then the DP as a recursive query that keeps the best (cost, audit) of each state after each row.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), convs AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), hashed AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations v JOIN convs ON v.conv_id IS NOT DISTINCT FROM convs.conv_id
), kinds AS (
  SELECT c, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
                                              lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM hashed, crc
), damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS j FROM damaged
), faulty AS (
  SELECT c, turn, role, text, j, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY c ORDER BY j) AS prior,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY j) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c
), pairs(before, state, inserted) AS (
  VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u')
), best AS (
  SELECT c, 0::BIGINT AS j, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM convs
  UNION ALL
  SELECT c, j, state, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) AS place FROM (
      SELECT b.c, f.j, b.state, b.cost + 3 AS cost, b.audit || 'D' AS audit, b.said FROM best b JOIN faulty f ON f.c = b.c AND f.j = b.j + 1
      UNION ALL
      SELECT b.c, f.j, p.state, b.cost + 2 * length(inserted) + CASE WHEN p.state = initial THEN 0 ELSE 2 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
             b.audit || repeat('I', length(inserted)) || CASE WHEN p.state = initial THEN 'K' ELSE 'R' END,
             b.said || CASE inserted WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END
                    || chr(10) || CASE WHEN p.state = initial THEN role WHEN p.state = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
      FROM best b JOIN faulty f ON f.c = b.c AND f.j = b.j + 1 JOIN pairs p ON p.before = b.state
      WHERE fault IN ('', 'truncated') AND (p.state <> 's' OR initial = 's')
    )
  ) WHERE place = 1
), ended AS (
  SELECT c, j, cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
         said || CASE state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END AS said
  FROM best
), least AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.c ORDER BY cost, audit) AS place FROM ended e LEFT JOIN counts n USING (c) WHERE e.j = coalesce(n.n, 0)
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(said[2:]) AS repaired_sha256
FROM convs JOIN least USING (c) LEFT JOIN counts USING (c) WHERE place = 1
"""
