"""Repair of conversations: the cheapest edits to a well-formed order of roles, by the auction algorithm for shortest paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import SPACES, null_safe_join, spread_join
from shelfcast.operators.scale import running_totals
from shelfcast.session import pin

#: Costs of edits: a rerole or an insertion, a deletion, and a truncated row that stays.
CHANGE, DELETE, CUT_OFF = 3, 4, 3
#: Rows of a segment. Longer conversations are solved in segments of this many rows.
SEGMENT = 64
NEVER = 1 << 40

# States of a repaired conversation: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state that keeping a row with this initial leads to.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that an inserted or reroled row leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in each state.
END = [0, NEVER, NEVER, 0]
_PAIRS = {"su", "ua", "au"}


class Lattice:
    """Nodes (row, state) of a segment with integer arc costs, node prices, and a sink behind the last row.

    Prices always satisfy price(i) <= cost(i, j) + price(j). They start at what the remaining rows cost whatever
    happens. ``converge`` grows a path from a node: it is extended along a tight arc, and contracted by one node, whose
    price rises, where there is none. When the path reaches the sink, the node's price is its distance.
    """

    def __init__(self, initials: str, faults: str, exits: list[int], last: bool):
        n = self.rows = len(initials)
        self.sink = STATES * (n + 1)
        floor = min(exits)
        self.price = [0] * (self.sink + 1)
        for row in range(n, -1, -1):
            for q in range(STATES):
                self.price[STATES * row + q] = floor
            if row:
                floor += {"b": DELETE, "d": DELETE, "t": min(DELETE, CUT_OFF)}.get(faults[row - 1], 0)
        # No distance can be larger, so a price beyond it means that the sink cannot be reached.
        self.most = max((e for e in exits if e < NEVER), default=0) + (DELETE + CUT_OFF) * n + 3 * CHANGE
        self.arcs = [self._arcs(row, q, initials, faults, exits, last) for row in range(n + 1) for q in range(STATES)] + [[]]
        self.known = {self.sink}

    def _arcs(self, row: int, q: int, initials: str, faults: str, exits: list[int], last: bool) -> list[tuple[str, int, int]]:
        """(initial of the edit, cost, node), the initials in ASCII order."""
        here, below = STATES * row, STATES * (row + 1)
        # Insertions before a row belong to its segment, those behind all rows to the last one.
        insert = [("I", CHANGE, here + NEXT[q])]
        if row == self.rows:
            return ([("", exits[q], self.sink)] if exits[q] < NEVER else []) + (insert if last else [])
        out = [("D", DELETE, below + q), *insert]
        if faults[row] not in "bd":
            stays = CUT_OFF if faults[row] == "t" else 0
            if initials[row] in KEEP[q]:
                out.append(("K", stays, below + KEEP[q][initials[row]]))
            out.append(("R", stays + CHANGE, below + NEXT[q]))
        return out

    def converge(self, node: int) -> int:
        """The node's distance to the sink, its price from now on; NEVER if there is no way."""
        price, arcs, known = self.price, self.arcs, self.known
        if node in known:
            return price[node]
        path = [node]
        while True:
            at = path[-1]
            if at in known:
                break
            best, to = NEVER, -1
            for _, cost, j in arcs[at]:
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if price[at] < best:
                if best > self.most:
                    price[at] = NEVER
                    known.add(at)
                    if at == node:
                        return NEVER
                else:
                    price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        # Arcs of the path are tight and it ends in a node at its distance, so all its nodes are.
        if price[path[-1]] < NEVER:
            known.update(path)
        return price[node]

    def trace(self, state: int) -> tuple[str, int]:
        """Initials of the cheapest edits, the ASCII-least of all cheapest, and the state behind the last row.

        Of the tight arcs the first whose head is at its distance lies on a shortest path.
        """
        node, out = state, []
        if self.converge(node) >= NEVER:
            return "", -1
        while True:
            for initial, cost, j in self.arcs[node]:
                if cost + self.price[j] == self.price[node] and cost + self.converge(j) == self.price[node]:
                    break
            if j == self.sink:
                return "".join(out), node % STATES
            out.append(initial)
            node = j


def transfer(initials: str, faults: str, last: bool) -> list[int]:
    """Cheapest cost from each state before a segment to each state behind it, row by row of a 4 x 4 table."""
    table = [[NEVER] * STATES for _ in range(STATES)]
    for leave in range(STATES):
        grid = Lattice(initials, faults, [0 if q == leave else NEVER for q in range(STATES)], last)
        for enter in range(STATES):
            table[enter][leave] = grid.converge(enter)
    return [x for row in table for x in row]


def rendered(audit: str, state: int, roles, texts) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows."""
    row, out_roles, out_texts = 0, [], []
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            role, text, state = roles[row], texts[row], KEEP[state][roles[row][:1]]
        else:
            state = NEXT[state]
            role, text = ROLE[state], "" if edit == "I" else texts[row]
        row += edit != "I"
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows after damage that a checksum of ``conv_id:turn`` decides.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its marks ``.!?``, 3 repeats it, 4 makes it a user's. In
    the checksum, and as role or text, a null is one space.
    """
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(conv, turn, F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    hurt = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return hurt.drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation, the initial of their role and the fault that needs no other row."""
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    first = F.substring("role", 1, 1)
    space = F.lit(" ")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    known = plain.select(
        "*", F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"), fault.alias("fault"), F.sha2("text", 256).alias("digest"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = running_totals(known, order, {"nth": F.lit(1).cast("long")}, by=["conv_id"])
    place = F.col("nth") - 1
    return placed.select("*", F.floor(place / SEGMENT).cast("long").alias("seg"), (place % SEGMENT).cast("int").alias("at")).drop("nth")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, initials, faults, roles, texts): conversations in segments of at most SEGMENT rows, in order."""
    keys = pin(rows.select("conv_id", "seg", "at", "role", "digest"), "turn-keys")
    firsts = keys.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("seg", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = spread_join(keys, firsts, ["conv_id", "role", "digest"]).where(F.struct("seg", "at") > F.col("first"))
    seen = again.groupBy("conv_id", "seg").agg(F.collect_list("at").alias("again"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "role", "text")))
    held = rows.groupBy("conv_id", "seg").agg(ordered.alias("r"))
    both = null_safe_join(held, seen, ["conv_id", "seg"], "left")
    fault = F.transform("r", lambda x: F.when((x["fault"] != "b") & F.array_contains(F.coalesce("again", F.array().cast("array<int>")), x["at"]), "d").otherwise(x["fault"]))
    return both.select(
        "conv_id", "seg", F.array_join(F.transform("r", lambda x: x["initial"]), "").alias("initials"), F.array_join(fault, "").alias("faults"),
        F.transform("r", lambda x: x["role"]).alias("roles"), F.transform("r", lambda x: x["text"]).alias("texts"),
    )


def _streamed(df: DataFrame, order: list[Column], step, schema: str) -> DataFrame:
    """Conversations as runs of rows in order; ``step(rows, state)`` maps a slice of one and what the slice before it left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for batch in batches:
            batch["conv_id"] = batch["conv_id"].astype("Int64")
            number = batch["conv_id"].fillna(0)
            new = ((number != number.shift()) | (batch["conv_id"].isna() != batch["conv_id"].isna().shift())).cumsum()
            out = []
            for _, part in batch.groupby(new, sort=False):
                conv = part["conv_id"].iloc[0]
                key = None if pd.isna(conv) else int(conv)
                if key != held:
                    held, state = key, None
                done, state = step(part, state)
                out.append(done)
            if out:
                yield pd.concat(out, ignore_index=True)

    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order).mapInPandas(run, schema)


def exit_costs(long: DataFrame) -> DataFrame:
    """(conv_id, seg, exits): what the segments behind each one cost from every state, of conversations of several segments."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            costs = [transfer(i, f, bool(z)) for i, f, z in zip(b["initials"], b["faults"], b["last"], strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "seg": b["seg"], "costs": costs})

    def back(part: pd.DataFrame, behind: list[int] | None):
        out, behind = [], behind or END
        for table in part["costs"]:
            out.append(behind)
            behind = [min(NEVER, *(int(table[STATES * q + r]) + behind[r] for r in range(STATES))) for q in range(STATES)]
        return pd.DataFrame({"conv_id": part["conv_id"].to_numpy(), "seg": part["seg"].to_numpy(), "exits": out}).astype({"conv_id": "Int64"}), behind

    each = long.select("conv_id", "seg", "initials", "faults", "last").mapInPandas(tables, "conv_id long, seg long, costs array<long>")
    return _streamed(each, [F.col("seg").desc()], back, "conv_id long, seg long, exits array<long>")


def traced(segs: DataFrame) -> DataFrame:
    """``segs`` with the cheapest edits from every state that may come before: audits, states behind, and costs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            audits, behind, costs, illegal = [], [], [], []
            for initials, faults, exits, seg, last in zip(b["initials"], b["faults"], b["exits"], b["seg"], b["last"], strict=True):
                grid = Lattice(initials, faults, [int(x) for x in exits], bool(last))
                ways = [grid.trace(q) for q in (range(STATES) if seg else [NOTHING])]
                audits.append([w[0] for w in ways])
                behind.append([w[1] for w in ways])
                costs.append([grid.price[q] for q in range(len(ways))])
                illegal.append(sum(initials[i : i + 2] not in _PAIRS for i in range(len(initials) - 1)))
            b["conv_id"] = b["conv_id"].astype("Int64")
            yield b.assign(audits=audits, behind=behind, costs=costs, illegal=illegal)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segs.schema.fields)
    return segs.mapInPandas(run, f"{types}, audits array<string>, behind array<int>, costs array<long>, illegal long")


def entered(ways: DataFrame) -> DataFrame:
    """(conv_id, seg, enter, border): the state in which each segment is entered, and 1 if the rows at its border do not fit."""

    def forth(part: pd.DataFrame, before: tuple[int, str] | None):
        state, last = before or (NOTHING, "")
        enter, border = [], []
        for behind, initials in zip(part["behind"], part["initials"], strict=True):
            enter.append(state)
            border.append(int(bool(last) and last + initials[0] not in _PAIRS))
            state, last = int(behind[state]), initials[-1]
        return pd.DataFrame({"conv_id": part["conv_id"].to_numpy(), "seg": part["seg"].to_numpy(), "enter": enter, "border": border}).astype({"conv_id": "Int64"}), (state, last)

    return _streamed(ways.select("conv_id", "seg", "behind", "initials"), [F.col("seg")], forth, "conv_id long, seg long, enter int, border long")


def solved(segs: DataFrame) -> DataFrame:
    """(conv_id, seg, last, audit, cost, fault counts, illegal, roles, texts): every segment with its edits and repaired rows.

    A segment that is a whole conversation is solved where it is. Of longer conversations every segment first yields a
    4 x 4 table of costs; the tables are folded from the end, one small row a segment; then all segments are
    traced on their own from each state, and a second fold picks the state in which each is entered.
    """

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [rendered(a, int(q), r, t) for a, q, r, t in zip(b["audit"], b["enter"], b["roles"], b["texts"], strict=True)]
            b["conv_id"], b["roles"], b["texts"] = b["conv_id"].astype("Int64"), [d[0] for d in done], [d[1] for d in done]
            yield b

    end = F.array(*[F.lit(x).cast("long") for x in END])
    whole = F.col("last") & (F.col("seg") == 0)
    ways = traced(segs.where(whole).withColumn("exits", end)).withColumn("enter", F.lit(0)).withColumn("border", F.lit(0).cast("long"))
    long = segs.where(~whole)
    if not long.isEmpty():
        known = pin(traced(null_safe_join(long, pin(exit_costs(long), "exit-costs"), ["conv_id", "seg"])), "traced")
        ways = ways.unionByName(null_safe_join(known, entered(known), ["conv_id", "seg"]))

    def many(letter: str) -> Column:
        return (F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))).cast("long")

    picked = ways.select(
        "conv_id", "seg", "last", "enter", F.element_at("audits", F.col("enter") + 1).alias("audit"), F.when(F.col("seg") == 0, F.col("costs")[0]).otherwise(0).alias("cost"),
        many("b").alias("blank"), many("d").alias("duplicate"), many("t").alias("truncated"), (F.col("illegal") + F.col("border")).alias("illegal"), "roles", "texts",
    )
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields)
    return picked.mapInPandas(render, types)


SUMMED = ("blank", "duplicate", "truncated", "illegal", "cost")


def repaired_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments of ``solved``, and (conv_id, gaps) of each conversation."""
    rows = numbered(rows)
    turn = F.col("turn")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long")
    sizes = pin(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), gaps.alias("gaps")), "turn-gaps")
    held = pin(segments(rows), "turn-segments")
    segs = spread_join(held, sizes.select("conv_id", F.floor((F.col("n") - 1) / SEGMENT).alias("final")), ["conv_id"])
    segs = segs.withColumn("last", F.col("seg") == F.col("final")).drop("final")
    return pin(solved(segs), "turn-repairs"), sizes.select("conv_id", "gaps")


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, seg, nth, role, text): the repaired rows themselves, in order of seg and nth."""
    each = F.posexplode(F.arrays_zip("roles", "texts")).alias("nth", "r")
    return pieces.select("conv_id", "seg", each).select("conv_id", "seg", "nth", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def summary(pieces: DataFrame) -> DataFrame:
    """(conv_id, SUMMED, audit, repaired_sha256): one row per conversation that has rows.

    A long conversation's digest runs over its segments in order, one after the other: SHA-256 has no other way.
    """

    def chain(part: pd.DataFrame, before):
        count, audits, sha, any_line = before or ([0] * len(SUMMED), [], hashlib.sha256(), False)
        count = [a + int(part[c].sum()) for a, c in zip(count, SUMMED, strict=True)]
        for audit, roles, texts, last in zip(part["audit"], part["roles"], part["texts"], part["last"], strict=True):
            audits.append(audit)
            for role, text in zip(roles, texts, strict=True):
                sha.update((("\n" if any_line else "") + role + ":" + text).encode("utf-8", "replace"))
                any_line = True
        out = []
        if last:
            out.append((part["conv_id"].iloc[0], *count, "".join(audits), sha.hexdigest()))
        frame = pd.DataFrame(out, columns=["conv_id", *SUMMED, "audit", "repaired_sha256"])
        return frame.astype({"conv_id": "Int64"}), (count, audits, sha, any_line)

    whole = F.col("last") & (F.col("seg") == 0)
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    short = pieces.where(whole).select("conv_id", *SUMMED, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    long = pieces.where(~whole).select("conv_id", "seg", "last", *SUMMED, "audit", "roles", "texts")
    types = ", ".join(f"{c} long" for c in SUMMED)
    return short.unionByName(_streamed(long, [F.col("seg")], chain, f"conv_id long, {types}, audit string, repaired_sha256 string"))


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: (conv_id, gaps, SUMMED, audit, repaired_sha256).

    ``rows`` (conv_id, turn, role, text) are taken by turn, nulls first; rows of equal turn by role and a digest of the
    text. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Edits: Keep, Rerole to user
    or assistant, Delete (blank and duplicate rows must go), Insert an empty user or assistant row. The repaired
    roles are nothing, or an optional system row and then pairs of user and assistant. Audit is the edits' initials.

    A null role or text is one space. Null conv_ids are one conversation. An empty role, or one that begins with
    another letter than s, u or a, cannot be kept. Repeated rows are duplicates. A conversation without rows has zeros, an
    empty audit and the empty string's digest. Empty tables give no rows; other columns are not read. A conversation with
    a third of all rows is numbered by slices and solved in segments; only its digest and audit, which are one value, pass
    one task, as a stream.
    """
    pieces, gaps = repaired_pieces(rows)
    found = null_safe_join(summary(pieces), gaps, ["conv_id"])
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = null_safe_join(ids, found, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *SUMMED)]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
