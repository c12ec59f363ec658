"""Repair of the turn structure of conversations by aligning them to an alternating grammar.

Rows of a conversation are taken by turn (nulls first; ties by role, then text). The first fault of a row counts: blank
(no word), duplicate (role and text stood earlier), truncated (the last character of a word isn't one of `.!?`). Blank and
duplicate rows must go. `alignment` finds the cheapest edits after which the role initials are s?(ua)+ or nothing; rows
are kept, reroled to user or assistant, deleted, or inserted with an empty text.

Conversations within one span of `SPAN` turns are solved where their rows meet. Longer ones are cut into blocks of `SPAN`
turns, which are solved one by one for all states before and after them and then composed; only audits of a letter an edit
meet in one place, texts never do. Rows with one turn number (or none) stay in one block.

Defined cases: null roles and texts count as one space; a null conv_id is a conversation of its own; conversations without
rows aren't in the result of `repair`, `report` gives them zeros; repeated rows are duplicates; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from . import alignment
from .common import BLANKS
from .shipping import ship

#: Turns in one block.
SPAN = 256
#: Block of rows without a turn number.
_NO_TURN = -(1 << 62)

ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

_TURN = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_TURNS = "array<struct<edit:string, turn:bigint, role:string, text:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WAY = pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
_WAYS = "array<struct<before:string, after:string, cost:bigint, audit:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after a test damage that hangs on crc32 of `conv_id:turn`, modulo 20: 0 drops the
    row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes its role user. Nulls: one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(said("conv_id"), F.lit(":"), said("turn"))
    rows = conversations.select(
        "conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind")
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


class _Block:
    """Rows of a conversation, or of a block of one, in order."""

    def __init__(self, rows: list[tuple]):
        """rows: (turn, role, text, again); again: role and text stood earlier, None if not known yet."""
        self.rows, seen, faults = rows, set(), []
        for _, role, text, again in rows:
            bare = text.rstrip(BLANKS)
            if again is None:
                again = (role, text) in seen
                seen.add((role, text))
            faults.append("blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else "")
        letters = "".join(role[:1] if role[:1] in ("s", "u", "a") else "?" for _, role, _, _ in rows)
        self.counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
        self.counts["illegal"] = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))
        self.plan = alignment.Rows(letters, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        self.turns = {turn for turn, *_ in rows if turn is not None}

    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0

    def repaired(self, audit: str, state: str) -> list[dict]:
        out, k = [], 0
        for edit in audit:
            turn, role, text, _ = (None, "", "", None) if edit == "I" else self.rows[k]
            if edit in "IR":
                role = ROLES[alignment.NEXT[state]]
            if edit != "D":
                out.append({"edit": edit, "turn": turn, "role": role, "text": text})
                state = role[:1]
            k += edit != "I"
        return out


def _by_group(keys: tuple[str, ...], solve: Callable[[tuple, list[dict]], list], schema: pa.Schema, batch: int = 500):
    """Task over rows that come sorted by `keys`: solve(key, rows) gives the values of one row of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        for part in batches:
            for row in part.to_pylist():
                now = tuple(row[k] for k in keys)
                if held and now != key:
                    done.append(solve(key, held))
                    held = []
                    if len(done) >= batch:
                        yield out()
                        done = []
                key = now
                held.append(row)
        if held:
            done.append(solve(key, held))
        yield out()

    return run


def _rows_of(rows: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r.get("again")) for r in rows]


def _whole(key: tuple, rows: list[dict]) -> list:
    block = _Block(_rows_of(rows))
    cost, audit = alignment.solve_last(block.plan, ("",))[""]
    counts = block.counts | {"gaps": block.gaps(), "cost": cost}
    return [*key, 0, 1, *[counts[c] for c in _COUNTS], audit, block.repaired(audit, "")]


def _solved(key: tuple, rows: list[dict]) -> list:
    block = _Block(_rows_of(rows))
    ways = [{"before": a, "after": b, "cost": c, "audit": x} for (a, b), (c, x) in alignment.solve_block(block.plan).items()]
    last = [{"before": a, "after": None, "cost": v[0], "audit": v[1]} for a, v in alignment.solve_last(block.plan).items() if v]
    letters = block.plan.letters
    return [
        *key, *[block.counts[c] for c in _COUNTS[1:-1]], min(block.turns, default=None), max(block.turns, default=None), len(block.turns),
        letters[0], letters[-1], ways, last,
    ]


def _composed(key: tuple, rows: list[dict]) -> list:
    blocks = rows[0]["blocks"]
    ways = [{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in b["ways"]} for b in blocks[:-1]]
    cost, parts = alignment.compose(ways, {w["before"]: (w["cost"], w["audit"]) for w in blocks[-1]["last"]})
    turns = [b for b in blocks if b["low"] is not None]
    gaps = max(b["high"] for b in turns) - min(b["low"] for b in turns) + 1 - sum(b["n_turns"] for b in turns) if turns else 0
    counts = {c: sum(b[c] for b in blocks) for c in _COUNTS[1:-1]} | {"gaps": gaps, "cost": cost}
    counts["illegal"] += sum(a["right"] + b["left"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
    places = [{"block": b["block"], "state": state, "audit": audit} for b, (state, audit) in zip(blocks, parts)]
    return [*key, len(blocks), *[counts[c] for c in _COUNTS], places]


def _edited(key: tuple, rows: list[dict]) -> list:
    one = rows[0]
    return [*key, one["n_blocks"], *[one[c] for c in _COUNTS], one["audit"], _Block(_rows_of(rows)).repaired(one["audit"], one["state"])]


def _fields(conv: pa.DataType, **more: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv), *more.items()])


def repair(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, block, n_blocks, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): one row per block of `span`
    turns, in nearly all conversations the only one. Counts and cost are those of the whole conversation, audit and the
    repaired turns (edit, turn, role, text) those of the block; rows: (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    ship(spark)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    block = F.coalesce(F.floor(F.col("turn").cast("long") / span), F.lit(_NO_TURN)).alias("block")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), block)
    kind = rows.schema["conv_id"].dataType
    # conversations of several blocks are few: their names, written out, are joined by size
    spread = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low <> high").select(F.col("conv_id").alias("long_id"))
    spread = cut_lineage(spread)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    conv = to_arrow_type(kind)
    ints = lambda *names: {n: pa.int64() for n in names}
    result = f"conv_id {kind.simpleString()}, block bigint, n_blocks bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + f", audit string, turns {_TURNS}"
    shape = _fields(conv, **ints("block", "n_blocks", *_COUNTS), audit=pa.string(), turns=pa.list_(_TURN))

    short = rows.join(spread, same, "left_anti").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    short = short.select("conv_id", "turn", "role", "text").mapInArrow(_by_group(("conv_id",), _whole, shape), result)

    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order[0]))
    long = rows.join(spread, same, "left_semi").withColumn("again", earlier > 1)
    long = cut_lineage(long.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *order))
    sorted_by_block = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *order)
    facts = ("blank", "duplicate", "truncated", "illegal", "low", "high", "n_turns")
    solved = sorted_by_block(long).mapInArrow(
        _by_group(("conv_id", "block"), _solved, _fields(conv, **ints("block", *facts), left=pa.string(), right=pa.string(), ways=pa.list_(_WAY), last=pa.list_(_WAY)), 50),
        f"conv_id {kind.simpleString()}, block bigint, {', '.join(f'{c} bigint' for c in facts)}, `left` string, `right` string, ways {_WAYS}, last {_WAYS}",
    )
    of_block = F.struct("block", *facts, F.col("`left`"), F.col("`right`"), "ways", "last")
    gathered = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(of_block)).alias("blocks"))
    place = pa.struct([("block", pa.int64()), ("state", pa.string()), ("audit", pa.string())])
    composed = gathered.mapInArrow(
        _by_group(("conv_id",), _composed, _fields(conv, **ints("n_blocks", *_COUNTS), places=pa.list_(place)), 20),
        f"conv_id {kind.simpleString()}, n_blocks bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, places array<struct<block:bigint, state:string, audit:string>>",
    )
    placed = composed.select(F.col("conv_id").alias("long_id"), "n_blocks", *_COUNTS, F.explode("places").alias("p"))
    placed = placed.select("long_id", F.col("p.block").alias("at"), "n_blocks", *_COUNTS, "p.state", "p.audit")
    edited = sorted_by_block(long.join(placed, same & (F.col("block") == F.col("at"))).drop("long_id", "at"))
    return short.unionByName(edited.mapInArrow(_by_group(("conv_id", "block"), _edited, shape, 50), result))


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _told(conv: pa.DataType):
    """Task over blocks that come sorted: audit and digest of whole conversations, a block at a time."""
    schema = _fields(conv, **{c: pa.int64() for c in _COUNTS}, audit=pa.string(), repaired_sha256=pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, audit, row, begun = None, None, [], None, False

        def out() -> pa.RecordBatch:
            values = [row["conv_id"], *[row[c] for c in _COUNTS], "".join(audit), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for part in batches:
            for row_now in part.to_pylist():
                if row is None or row_now["conv_id"] != row["conv_id"]:
                    if row is not None:
                        yield out()
                    digest, audit, begun = hashlib.sha256(), [], False
                row = row_now
                audit.append(row["audit"])
                if row["n"]:
                    digest.update((b"\n" if begun else b"") + row["lines"].encode())
                    begun = True
        if row is not None:
            yield out()

    return run, schema


def report(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of the
    first table; blocks: the result of `repair` on its rows."""
    told = blocks.select("conv_id", "block", "n_blocks", *_COUNTS, "audit", _lines(F.col("turns")).alias("lines"), F.size("turns").alias("n"))
    told = cut_lineage(told)
    one = told.where("n_blocks = 1").select("conv_id", *_COUNTS, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    kind = told.schema["conv_id"].dataType
    run, _ = _told(to_arrow_type(kind))
    several = told.where("n_blocks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string"
    )
    found = one.unionByName(several).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
