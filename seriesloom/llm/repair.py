"""Conversation repair: cheapest edits to a legal order of roles, solved once per suffix of role and fault signatures.

A row of a conversation is one letter of its signature: the initial of its role, in upper case
where the text is cut short, or ``x`` where the row must go.  Signatures that end alike share
their suffixes, so an automaton of the distinct suffixes holds, for every state of the grammar,
what the rest costs and the first edit of the best rest.  Conversations only follow it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import in_batches, lean, saved

#: What the edits cost, and what a text that stays cut short costs.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; what a kept row leads to, and the next role where it may be chosen.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: The end: states 0 and 3 may stop, the others insert what is missing.
END = ((0, 2 * INSERT, INSERT, 0), "-II-")
LEGAL = {b"su", b"ua", b"au"}
#: Rows, or letters of signatures, that leave a task at a time.
EMIT_ROWS, EMIT_LETTERS = 2000, 4 << 20


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id long, turn long, role, text, copies int): rows with the damage that crc32 of ``conv_id:turn`` modulo 20 names.

    0 drops the row (no copies), 1 empties the text, 2 removes its ``.!?``, 3 repeats the row,
    4 makes it the user's.  Null roles and texts are one blank, in that name null numbers too.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    code = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def order_keys() -> list[Column]:
    """Rows of a conversation by turn (null first); of one turn by role, then by text."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]


def with_order(rows: DataFrame) -> DataFrame:
    """What orders equal turns: the first 64 characters of the text, and a digest of all."""
    return rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.md5("text")})


SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def signatures(rows: DataFrame) -> DataFrame:
    """``SIGNED`` for every conversation of ``rows`` (conv_id, turn, role, text, copies), those without copies included.

    Texts stay where they are: what is shuffled names them by a digest.  Equal rows are counted
    first, the first turn of each text is a streamed window, and a conversation's letters are
    read as a stream, so of a long conversation a task holds its signature.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    keys = ["conv_id", "turn", "role", "head", "digest", "empty", "cut"]
    facts = with_order(rows).withColumns({"empty": F.length(trimmed) == 0, "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    counted = facts.groupBy(*keys).agg(F.sum(F.col("copies").cast("long")).alias("m"))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("m") == 0, F.asc_nulls_first("turn"))
    counted = counted.withColumn("again", F.row_number().over(seen) > 1)
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", *order_keys())
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")

    def task(batches):
        for part in in_parts(conversations(batches)):
            columns = list(zip(*part, strict=True))
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
            )

    def conversations(batches) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv, turn, letter, empty, cut, again, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now.row()
                    now = Signing(conv)
                if m:
                    now.add(turn, letter, empty, cut, again, m)
        if now is not None:
            yield now.row()

    return in_batches(ordered.select("conv_id", "turn", initial.alias("letter"), "empty", "cut", "again", "m")).mapInArrow(lean(task), SIGNED)


class Signing:
    """One conversation while its rows come in order."""

    def __init__(self, conv) -> None:
        self.conv, self.letters = conv, bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = ""

    def add(self, turn, letter: str, empty: bool, cut: bool, again: bool, m: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if self.last and (self.last + letter).encode() not in LEGAL:
            self.illegal += 1
        self.illegal += m - 1  # no role may follow itself
        self.last = letter
        if empty:
            self.blank += m
        else:
            self.duplicate += m if again else m - 1
            self.truncated += cut and not again
        first = "x" if empty or again else letter.upper() if cut else letter
        self.letters += (first + "x" * (m - 1)).encode()

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


def in_parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """``rows`` in lists that end after EMIT_ROWS rows or EMIT_LETTERS letters of their last members."""
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += len(row[-1])
        if len(held) >= EMIT_ROWS or letters >= EMIT_LETTERS:
            yield held
            held, letters = [], 0
    if held:
        yield held


def node(letter: str, rest: tuple[tuple[int, ...], str]) -> tuple[tuple[int, ...], str]:
    """The suffix of ``letter`` and then ``rest``: for each state the cost to go and the first edit, D, I, K or R; of equal costs the least letter.

    Edits of one state that cost the same differ in their first letter, so the least first letter
    makes the least of all cheapest strings.
    """
    kind, cost_short = letter.lower(), CUT_SHORT if letter.isupper() else 0
    base = []
    for state in range(4):
        options = [(DELETE + rest[0][state], "D")]
        if kind != "x":
            if kind in KEEPS[state]:
                options.append((cost_short + rest[0][KEEPS[state][kind]], "K"))
            options.append((REROLE + cost_short + rest[0][NEXT[state]], "R"))
        base.append(min(options))
    # an inserted row goes on at the same suffix; two in a row never end where they began for less
    two = min(base[2], (INSERT + base[3][0], "I"))
    three = min(base[3], (INSERT + base[2][0], "I"))
    best = (min(base[0], (INSERT + two[0], "I")), min(base[1], (INSERT + two[0], "I")), two, three)
    return tuple(b[0] for b in best), "".join(b[1] for b in best)


class SuffixAutomaton:
    """Nodes of the suffixes of signatures that come ordered by their ends; a shared suffix is solved once.

    ``path`` holds the nodes of the last signature, the end first.  The next one, in the order of
    reversed signatures, shares a beginning of that path and adds the rest.
    """

    def __init__(self) -> None:
        self.path, self.last, self.solved = [END], "", 0

    def solve(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and edits of a signature given from its end."""
        shared = 0
        for a, b in zip(self.last, reversed_signature):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for letter in reversed_signature[shared:]:
            self.path.append(node(letter, self.path[-1]))
            self.solved += 1
        self.last = reversed_signature
        return self.path[-1][0][0], "".join(self.edits())

    def edits(self) -> Iterator[str]:
        state, at = 0, len(self.path) - 1
        while True:
            edit = self.path[at][1][state]
            if edit == "-":
                return
            yield edit
            if edit in "IR":
                state = NEXT[state]
            elif edit == "K":
                state = KEEPS[state][self.last[at - 1].lower()]
            at -= edit != "I"


def solutions(signed: DataFrame) -> DataFrame:
    """(signature, cost long, audit string) for each distinct signature; those with like ends meet in one task, in order."""

    def task(batches):
        automaton = SuffixAutomaton()

        def solved():
            for batch in batches:
                for turned in batch.column(0).to_pylist():
                    cost, audit = automaton.solve(turned)
                    yield turned[::-1], cost, audit

        for part in in_parts(solved()):
            signature, cost, audit = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(signature, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    distinct = saved(signed.select(F.reverse("signature").alias("turned")).distinct(), "signatures")
    return in_batches(distinct.repartitionByRange("turned").sortWithinPartitions("turned")).mapInArrow(lean(task), "signature string, cost long, audit string")


def planned(rows: DataFrame) -> DataFrame:
    """``SIGNED``, cost long and audit string for every conversation of ``rows`` (conv_id, turn, role, text, copies)."""
    signed = saved(signatures(rows), "signed")
    return signed.join(solutions(signed), "signature")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"


def applied(rows: DataFrame, plans: DataFrame, turns: bool = False) -> DataFrame:
    """The edits of ``plans`` carried out on ``rows``: ``REPORT`` per conversation, or with ``turns`` its repaired rows (``TURNS``).

    A conversation's plan and its rows meet in order in one task, which reads them as a stream:
    it holds the audit string and a batch of rows, whatever the texts are.
    """
    names = [c.split()[0] for c in REPORT.split(", ")][1:7]
    texts = with_order(rows.where("copies > 0")).select("conv_id", F.lit(True).alias("row"), "turn", "role", "head", "digest", "text", "copies", *[F.lit(None).cast("long").alias(c) for c in names])
    plan = plans.select("conv_id", F.lit(False).alias("row"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("head", "string"), ("digest", "string"))],
                        F.col("audit").alias("text"), F.lit(0).alias("copies"), *names)
    both = plan.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "row", *order_keys())

    def followed(batches) -> Iterator[tuple]:
        """(start of a conversation's report or None, end of one or None, repaired role and text or None)."""
        audit, at, state, report = "", 0, 0, None
        for batch in batches:
            for conv, row, role, text, copies, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row:
                    while at < len(audit):  # what is inserted at the end
                        yield report, ROLES[state], ""
                        at, state = at + 1, NEXT[state]
                    audit, at, state, report = text, 0, 0, (conv, *numbers, text)
                    yield report, None, None
                    continue
                for _ in range(copies):
                    while audit[at] == "I":
                        yield report, ROLES[state], ""
                        at, state = at + 1, NEXT[state]
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        yield report, role, text
                        state = KEEPS[state][role[0]]
                    elif edit == "R":
                        yield report, ROLES[state], text
                        state = NEXT[state]
        while at < len(audit):
            yield report, ROLES[state], ""
            at, state = at + 1, NEXT[state]

    def reports(batches) -> Iterator[tuple]:
        sha, report, first = None, None, True
        for now, role, text in followed(batches):
            if role is None:
                if report is not None:
                    yield (*report, sha.hexdigest())
                sha, report, first = hashlib.sha256(), now, True
            else:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if report is not None:
            yield (*report, sha.hexdigest())

    def repaired(batches) -> Iterator[tuple]:
        place = 0
        for now, role, text in followed(batches):
            place = 0 if role is None else place + 1
            if role is not None:
                yield now[0], place - 1, role, text

    schema = TURNS if turns else REPORT

    def task(batches):
        kinds = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")]
        for part in in_parts((repaired if turns else reports)(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*part, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return in_batches(both.select("conv_id", "row", "role", "text", "copies", *names)).mapInArrow(lean(task), schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: bool = False) -> DataFrame:
    """Faults and cheapest repair of every conversation (``REPORT``), or with ``turns`` the repaired rows (``TURNS``).

    Rows count by turn, null turns first; rows of one turn by role and text.  A row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated (does not end in ``.!?``).
    Keep costs 0, Rerole 1, Delete 2, Insert 5, a text that stays cut short 5; blank and duplicate
    rows are deleted.  The role initials that result match ``(s?(ua)+)?``; the edits are the
    cheapest, of equal ones the least string.

    Null roles and texts are one blank; a null conv_id is a conversation.  An empty role cannot be
    kept.  Repeated rows are duplicates.  Empty table: no rows.  Other columns are not read.  A
    conversation's rows are read as a stream, its edits (a letter a row) are held by a task.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    whole = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), F.lit(1).alias("copies")
    )
    return applied(whole, planned(whole), turns)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and digest of every conversation after the damage."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return applied(rows, planned(rows))


def _add(cost: str, letter: str, value: str) -> str:
    return f"(lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10))"


def _bases() -> str:
    """SQL of the best edit of a row itself for each state, over the values v0 to v3 of what follows (nine digits of cost, then edits)."""
    out = []
    for state in range(4):
        keep = " ".join(f"WHEN fate < 2 AND initial = '{c}' THEN {_add(f'{CUT_SHORT} * fate', 'K', f'v{t}')}" for c, t in KEEPS[state].items())
        rerole = f"CASE WHEN fate < 2 THEN {_add(f'{REROLE} + {CUT_SHORT} * fate', 'R', f'v{NEXT[state]}')} END"
        out.append(f"least({_add(str(DELETE), 'D', f'v{state}')}, CASE {keep} END, {rerole}) AS b{state}")
    return ", ".join(out)


OP13_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS place FROM hurt),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS last FROM placed),
marked AS (
  SELECT *, CASE WHEN trimmed = '' THEN 2 WHEN again THEN 3 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fate FROM judged),
dp AS (
  SELECT conv_id, max(place) + 1 AS place, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, least(b0, {_add('5', 'I', f"least(b2, {_add('5', 'I', 'b3')})")}), least(b1, {_add('5', 'I', f"least(b2, {_add('5', 'I', 'b3')})")}),
    least(b2, {_add('5', 'I', 'b3')}), least(b3, {_add('5', 'I', 'b2')})
  FROM (SELECT m.conv_id, m.place, {_bases()} FROM dp JOIN marked m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.place = dp.place - 1)),
best AS (SELECT conv_id, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM dp WHERE place = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS "at" FROM best WHERE audit <> ''),
steps AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY "at") AS place FROM letters),
kept AS (
  SELECT s.conv_id, s."at", s.edit, m.role, m.initial, m.text,
    count(*) FILTER (NOT (s.edit = 'K' AND m.initial = 's')) OVER (PARTITION BY s.conv_id ORDER BY s."at") AS spoken
  FROM steps s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.place = s.place AND s.edit <> 'I' WHERE s.edit <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END,
    chr(10) ORDER BY "at") AS told FROM kept GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum((fate = 2)::INT)::BIGINT AS blank,
    sum((fate = 3)::INT)::BIGINT AS duplicate, sum((fate = 1)::INT)::BIGINT AS truncated,
    sum((last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
