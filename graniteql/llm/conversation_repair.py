"""Operator 11: conversation structure repair by a dynamic program over the retained turns.

A conversation shall read `(s?(ua)+)?` by the initials of its roles. Each turn is kept, given another role or deleted, and
turns without text are inserted. The program goes over the turns that could be retained: what it costs to retain turn i in
role r is its own price, the price of what is inserted between it and the turn retained before it (the pair of their roles
says how many turns that are), and the deletions in between, a difference of prefix sums. So for every role only the
cheapest end so far counts, less its prefix sum: a running minimum. Of equally cheap edits those whose initials (D, I, K, R)
are least in ASCII order win. Two audits that end in different roles differ at a letter that both have, so their order is
kept as a rank beside each running minimum and never needs the strings.

The same program gives for a part of a conversation the price of getting from any role to any other, with the order of
the audits; such parts are put together like the turns. So rows are sorted into ranges of the table, whose rows have no
texts, and a conversation that lies in several ranges is solved range by range: once to price its ranges, once with the
roles known in which each begins and ends. Back pointers are held for the rows of one range. Texts meet the edits in a
last pass in which a conversation's rows stream by, in order, through a digest: of a conversation nothing is held but
counts and the audit, which is part of the result.

Defined cases: identical rows are one row with a number, so a group of copies is one; copies beyond the first are
duplicates; rows with the same turn are ordered by role, then by a digest of the text; null roles and texts are one blank,
a null turn comes first and is one blank in the draw; a null conv_id is a conversation; a conversation of which the draw
leaves nothing has zeros; texts of any length and empty ones are rows like others; an empty table gives an empty result;
extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteql.llm.common import ship, written
from graniteql.operators import ranks

#: What the last retained turn can be: none, system, user, assistant; and the end.
ROLES, END = ("", "s", "u", "a"), 4
START = 0
#: Turns to insert between two retained roles, by the earlier (rows) and the later or the end; None: never.
INSERTS = ((None, 0, 0, 1, 0), (None, None, 0, 1, 2), (None, None, 1, 0, 1), (None, None, 0, 1, 0))
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
GOOD, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60


class Ends:
    """For every role the cheapest way to end in it: price, the audit's place among the roles' audits, and how it came."""

    def __init__(self, price: list[int], rank: list[int]):
        self.price, self.rank, self.deleted = price, rank, 0  # prices less `deleted`, the prefix sum of deletions

    @staticmethod
    def at(role: int) -> Ends:
        return Ends([0 if r == role else FAR for r in range(END)], [0] * END)

    def step(self, initial: str, fault: int) -> list[tuple[int, int, str] | None]:
        """Takes in one more turn. Gives for every role how it is now the last retained one: (role before, turns to insert,
        edit), or None where the turn is deleted."""
        price, rank, own = self.price, self.rank, TRUNCATED if fault == CUT else 0
        came: list[tuple[int, int, str] | None] = [None] * END
        now, keys = [p for p in price], [(k, "D") for k in rank]
        if fault not in (BLANK, DUPLICATE):
            for role in range(1, END):
                if ROLES[role] == initial:
                    extra, letter = own, "K"
                elif role > 1:
                    extra, letter = own + RETITLE, "R"
                else:
                    continue
                # the deletion that retaining spares is taken off, as all prices are less the prefix sum
                best = (price[role], rank[role], None)
                for before in range(END):
                    n = INSERTS[before][role]
                    if n is not None and price[before] < FAR:
                        found = (price[before] + INSERT * n + extra - DELETE, rank[before])
                        if found < best[:2]:
                            best = (*found, (before, n, letter))
                if best[2]:
                    before, n, _ = best[2]
                    now[role], keys[role], came[role] = best[0], (rank[before], "I" * n + letter), best[2]
        self.deleted += DELETE
        self.price = now
        order = sorted((r for r in range(END) if now[r] < FAR), key=keys.__getitem__)
        self.rank = [0] * END
        for place, r in enumerate(order):
            self.rank[r] = place
        return came

    def last(self) -> int | None:
        """The role after which the conversation ends most cheaply."""
        ways = [(self.price[r] + INSERT * INSERTS[r][END], self.rank[r], r) for r in range(END) if self.price[r] < FAR]
        return min(ways)[2] if ways else None

    def total(self, role: int) -> int:
        return self.price[role] + self.deleted


def edits(turns: list[tuple[str, int]], first: int = START, last: int | None = None) -> list[str]:
    """For each turn (initial, fault) what is done: inserts and the turn's own edit, D, K, Ru or Ra, an insert being written
    as its role's initial. first: the role before; last: the role to end in, or None for the end of the conversation,
    whose inserts follow the last turn's edit."""
    ends, came = Ends.at(first), []
    for turn in turns:
        came.append(ends.step(*turn))
    role = ends.last() if last is None else last
    done = [""] * len(turns)
    tail = inserted(role, INSERTS[role][END]) if last is None else ""
    for i in range(len(turns) - 1, -1, -1):
        if came[i][role] is None:
            done[i] = "D"
        else:
            before, n, letter = came[i][role]
            done[i] = inserted(before, n) + letter + (ROLES[role] if letter == "R" else "")
            role = before
    if turns:
        done[-1] += tail
    return done


def inserted(role: int, n: int) -> str:
    """Initials of n turns put in after a role."""
    out = ""
    for _ in range(n):
        out += "a" if (out or ROLES[role])[-1:] == "u" else "u"
    return out


def crossed(turns: list[tuple[str, int]]) -> list[int]:
    """Prices and ranks from every role to every role, 16 of each in turn, for a part of a conversation."""
    prices, places = [], []
    for first in range(END):
        ends = Ends.at(first)
        for turn in turns:
            ends.step(*turn)
        prices += [min(FAR, p + ends.deleted) for p in ends.price]
        places += ends.rank
    return prices + places


def joined(parts: list[list[int]]) -> list[tuple[int, int | None]]:
    """Role before and role at the end of each part of a conversation, the last None: the end follows."""
    price, rank, ways = [0, FAR, FAR, FAR], [0] * END, []
    for part in parts:
        found = [min((price[a] + part[4 * a + b], rank[a], part[16 + 4 * a + b], a) for a in range(END)) for b in range(END)]
        order = sorted((b for b in range(END) if found[b][0] < FAR), key=lambda b: found[b][1:3])
        price, rank = [min(FAR, x[0]) for x in found], [0] * END
        for place, b in enumerate(order):
            rank[b] = place
        ways.append([x[3] for x in found])
    ends = Ends(price, rank)
    role, out = ends.last(), []
    for way in reversed(ways):
        out.append((way[role], role))
        role = way[role]
    return [(a, None if i == 0 else b) for i, (a, b) in enumerate(out)][::-1]


# -- the rows ------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage, identical ones as one with their number."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20)).alias("draw")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role").alias("role"), spaced("text").alias("text"), draw).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def _digest(*columns: str) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in columns)), 256))


def _lasting(text: Column) -> Column:
    """The last character that is not a blank, or an empty string."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def _edited(rows: DataFrame, parts: int | None) -> DataFrame:
    """conv_id, turn, role, said, initial, fault, copies, done: the edit of every row, from rows with their digests."""
    end = _lasting(F.col("text"))
    fault = F.when(end == "", BLANK).when(F.instr(F.lit(".!?"), end) > 0, GOOD).otherwise(CUT)
    slim = rows.select("conv_id", "turn", "role", "said", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "said"), 256)).alias("same"))
    slim = ranks.placed(slim, ["conv_id"], ["turn", "role", "said"], parts=parts)
    firsts = slim.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    marked = slim.join(firsts, "place", "left").drop("same")  # places are unique, so no key is hot
    marked = written(marked.withColumn("fault", F.when((F.col("fault") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))).drop("new"), "marked")
    # conversations that lie in several ranges
    wide = slim.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select(F.col("conv_id").alias("wide"))
    prices = _by_run(marked.join(wide, F.col("conv_id").eqNullSafe(F.col("wide")), "left_semi"), _priced, "conv_id long, piece long, price array<long>")
    known = prices.groupBy("conv_id").applyInArrow(_put_together, "conv_id long, piece long, first int, last int")  # a row for each range of a conversation
    known = written(known.select(F.col("conv_id").alias("of"), F.col("piece").alias("at"), "first", "last"), "ends")
    runs = marked.join(known, (F.col("piece") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of", "at")
    return _by_run(runs, _solved, "conv_id long, turn long, role string, said binary, initial string, fault int, copies long, done string")


def _by_run(rows: DataFrame, solve, schema: str) -> DataFrame:
    """Gives solve(each conversation's rows of a range, as columns)."""
    names = rows.columns

    def run(batches):
        held = None
        for batch in batches:
            c = batch.to_pydict()
            keys = list(zip(c["piece"], c["conv_id"], strict=True))
            at, out = 0, []
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = {n: c[n][at:end] for n in names}
                if held and (held["piece"][0], held["conv_id"][0]) == keys[at]:
                    for n in names:
                        held[n] += part[n]
                else:
                    if held:
                        out.append(solve(held))
                    held = part
                at = end
            if out:
                yield _batch(out, fields)
        if held:
            yield _batch([solve(held)], fields)

    fields = _fields(schema)
    return rows.repartition("piece", "conv_id").sortWithinPartitions("piece", "conv_id", "place").mapInArrow(run, schema)


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]


def _batch(parts: list[dict[str, list]], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v for p in parts for v in p[n]], kind) for n, kind in fields], names=[n for n, _ in fields])


def _turns(c: dict[str, list]) -> list[tuple[str, int]]:
    return list(zip(c["initial"], c["fault"], strict=True))


def _priced(c: dict[str, list]) -> dict[str, list]:
    more = crossed(_turns(c))
    return {"conv_id": c["conv_id"][:1], "piece": c["piece"][:1], "price": [more]}


def _put_together(table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    ways = joined(table["price"].to_pylist())
    return pa.table({"conv_id": table["conv_id"], "piece": table["piece"], "first": pa.array([a for a, _ in ways], pa.int32()), "last": pa.array([END if b is None else b for _, b in ways], pa.int32())})


def _solved(c: dict[str, list]) -> dict[str, list]:
    first, last = c["first"][0], c["last"][0]
    c["done"] = edits(_turns(c), START if first is None else first, None if last in (None, END) else last)
    return c


# -- the result ----------------------------------------------------------------------------------------------------

RESULT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PRICE = {"K": 0, "R": RETITLE, "D": DELETE, "I": INSERT}
TITLE = {"u": "user", "a": "assistant"}


class Account:
    """What one conversation comes to, its rows and texts going by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.illegal, self.cost, self.audit = conv_id, [0] * 4, 0, 0, []
        self.before, self.digest, self.open = None, hashlib.sha256(), False
        self.todo = None

    def turn(self, role: str, initial: str, fault: int, copies: int, done: str) -> None:
        """A row's edits; its text, if it is retained, is still to come."""
        self.finish()
        good = "su", "ua", "au"
        self.illegal += (self.before is not None and self.before + initial not in good) + (copies - 1) * (initial * 2 not in good)
        self.before = initial
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        at = next(i for i, x in enumerate(done) if x in "DKR")
        inserts, edit, rest = done[:at], done[at], done[at + 1 :]
        new = TITLE[rest[0]] if edit == "R" else role
        rest = rest[1:] if edit == "R" else rest
        self.audit.append("I" * len(inserts) + edit + "D" * (copies - 1) + "I" * len(rest))
        self.cost += sum(PRICE[x] for x in self.audit[-1]) + (TRUNCATED if fault == CUT and edit != "D" else 0)
        self.todo = (inserts, new if edit != "D" else None, rest)
        if edit == "D":
            self.text("")

    def text(self, text: str) -> None:
        """The text of the row whose edits came last."""
        if self.todo:
            inserts, role, rest = self.todo
            for x in inserts:
                self.put(TITLE[x], "")
            if role is not None:
                self.put(role, text)
            for x in rest:
                self.put(TITLE[x], "")
            self.todo = None

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.open else "") + role + ":" + text).encode())
        self.open = True

    def finish(self) -> None:
        assert self.todo is None, "a retained turn without its text"

    def row(self) -> tuple:
        self.finish()
        return (self.conv_id, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _accounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, fields = None, _fields(RESULT)
    for batch in batches:
        c, out = batch.to_pydict(), []
        for conv, role, initial, fault, copies, done, text in zip(*(c[n] for n in ("conv_id", "role", "initial", "fault", "copies", "done", "text")), strict=True):
            if now is None or now.conv_id != conv:
                out += [now.row()] if now else []
                now = Account(conv)
            if done is None:
                now.text(text)
            else:
                now.turn(role, initial, fault, copies, done)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(now.row(), fields, strict=True)], names=[n for n, _ in fields])


def repaired(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after the
    damage. parts: ranges into which the rows are sorted; else the session's shuffle partitions."""
    ship(conversations.sparkSession)
    rows = written(damaged(conversations).withColumn("said", F.unhex(F.sha2("text", 256))), "damaged")
    done = _edited(rows, parts).select("*", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", "said", *(F.lit(None).cast(k).alias(n) for n, k in (("initial", "string"), ("fault", "int"), ("copies", "long"), ("done", "string"))), "text")
    order = ["conv_id", "turn", "role", "said", F.col("done").isNull()]
    made = done.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "said").mapInArrow(_accounts, RESULT)
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("rows"))
    found = made.withColumnRenamed("conv_id", "made_id")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("made_id")), "left")
    out = out.join(turns.withColumnRenamed("conv_id", "turns_id"), F.col("conv_id").eqNullSafe(F.col("turns_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
