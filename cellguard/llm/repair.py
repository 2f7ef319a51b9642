"""Conversation structure repair with Four-Russians block tables.

A conversation is a sequence of rows whose role initials should read ``(s?(ua)+)?``. The cheapest edits that make it so
are found by a dynamic program over four states (nothing read, after system, after user, after assistant). Its columns
of costs, less their least entry, take few values; so the step over every block of ``BLOCK`` row symbols is
precomputed from every such vector once, and a conversation is solved by one table lookup a block, from its end to
its start. The lookups leave the vector at every block border; a block is expanded backward from its right border when
the edits are traced, forward, taking the ASCII-least edit among the cheapest.

Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit for blank and duplicate rows), Insert an
empty user or assistant row 5; a truncated row that stays adds 5.

Distribution. Rows are range-partitioned by (conversation, turn, digest of role and text, arrival), so a conversation
that holds a third of all rows spreads over many tasks, and cut into chunks of bounded size. A conversation inside one
chunk is solved there. The others (those at partition borders and the long ones) are solved in three steps over chunk
summaries: each chunk's map from every right vector to its left vector; the right vector of every chunk, carried from
the end; the entry state of every chunk, carried from the start. Carries stream over one summary a chunk and keep one
vector or state. Only the SHA-256 of a whole repaired conversation, sequential by definition, streams its text through
one task.

Defined results. Null conversation ids form one conversation; a null turn, role or text counts as one space, and null
turns sort first and are left out of gaps. Ties on the turn are ordered by the MD5 of role and text (lowercase hex);
equal rows are interchangeable. An empty role has no initial and is never legal; initials are case-sensitive. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellguard.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing read, after system, after user, after assistant; the state that user or assistant leads to next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of class s, u, a or other leads from each state (-1: nowhere).
KEPT = {START: (SYSTEM, USER, -1, -1), SYSTEM: (-1, USER, -1, -1), USER: (-1, -1, ASSISTANT, -1),
        ASSISTANT: (-1, USER, -1, -1)}
#: Symbols: 0 a row that must go, 1 to 4 whole rows of class s, u, a, other, 5 to 8 truncated ones, 9 padding.
PAD, SYMBOLS, BLOCK = 9, 10, 4
END = (0, 10, 5, 0)  # cost from each state when no row is left
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 8 << 20


def step(after: tuple, symbol: int) -> tuple:
    """Costs before a row, from the costs after it."""
    if symbol == PAD:
        return after
    plain = []
    for q in range(4):
        best = DELETE + after[q]
        if symbol:
            late, kind = TRUNCATED * (symbol > 4), (symbol - 1) % 4
            best = min(best, REROLE + late + after[NEXT[q]])
            if KEPT[q][kind] >= 0:
                best = min(best, KEEP + late + after[KEPT[q][kind]])
        plain.append(best)
    return tuple(min(plain[q], INSERT + plain[NEXT[q]], 2 * INSERT + plain[NEXT[NEXT[q]]]) for q in range(4))


class Tables:
    """All normalised cost vectors, and for each the vector and offset before every symbol and every block."""

    def __init__(self):
        self.vectors, number, one = [END], {END: 0}, []
        for v in self.vectors:  # grows while it is read
            row = []
            for s in range(SYMBOLS):
                before = step(v, s)
                low = min(before)
                before = tuple(x - low for x in before)
                if before not in number:
                    number[before] = len(self.vectors)
                    self.vectors.append(before)
                row.append((number[before], low))
            one.append(row)
        one = np.array(one, dtype=np.int64)
        self.to, self.plus = one[:, :, 0], one[:, :, 1]
        to, plus = self.to, self.plus
        for _ in range(BLOCK - 1):  # a block is its first symbol applied after (to the left of) the rest
            rest = to.shape[1]
            left = self.to[to]  # vector, rest, symbol
            more = plus[:, :, None] + self.plus[to]
            to = left.transpose(0, 2, 1).reshape(len(left), SYMBOLS * rest)
            plus = more.transpose(0, 2, 1).reshape(len(left), SYMBOLS * rest)
        self.block_to, self.block_plus = to, plus
        self.lists = self.block_to.tolist()

    def codes(self, symbols: bytes) -> np.ndarray:
        """Block numbers of a sequence, padded at its end."""
        s = np.frombuffer(symbols + bytes([PAD]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
        return s.astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def borders(self, symbols: bytes, right: int) -> list[int]:
        """The vector at the right border of every block."""
        out, v = [], right
        for code in self.codes(symbols)[::-1].tolist():
            out.append(v)
            v = self.lists[v][code]
        return out[::-1]

    def summary(self, symbols: bytes) -> np.ndarray:
        """The vector before the sequence for every vector after it."""
        v = np.arange(len(self.vectors))
        for code in self.codes(symbols)[::-1].tolist():
            v = self.block_to[v, code]
        return v


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def trace(symbols: bytes, right: int, state: int, last: bool) -> tuple[str, int, int]:
    """(edits, exit state, cost) of the ASCII-least cheapest edits; ``last`` also closes the conversation."""
    t = tables()
    edits, cost, n = [], 0, len(symbols)
    for b, border in enumerate(t.borders(symbols, right)):
        part = symbols[b * BLOCK:(b + 1) * BLOCK]
        costs = [t.vectors[border]]
        for s in reversed(part):  # expand the block backward; offsets cancel, as only costs of one column meet
            costs.append(step(costs[-1], s))
        costs.reverse()
        for i, s in enumerate(part):
            now, after = costs[i], costs[i + 1]
            late, kind = TRUNCATED * (s > 4), (s - 1) % 4
            while True:
                if DELETE + after[state] == now[state]:
                    edits.append("D")
                    cost += DELETE
                    break
                if INSERT + now[NEXT[state]] == now[state]:
                    edits.append("I")
                    cost += INSERT
                    state = NEXT[state]
                    continue
                if KEPT[state][kind] >= 0 and late + after[KEPT[state][kind]] == now[state]:
                    edits.append("K")
                    cost += KEEP + late
                    state = KEPT[state][kind]
                else:
                    edits.append("R")
                    cost += REROLE + late
                    state = NEXT[state]
                break
    while last and state not in (START, ASSISTANT):
        edits.append("I")
        cost += INSERT
        state = NEXT[state]
    return "".join(edits), state, cost


def apply(edits: str, roles: list, texts: list, state: int) -> tuple[list, list]:
    """The repaired rows of a chunk entered in ``state``."""
    out_roles, out_texts, at = [], [], 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out_roles.append(ROLE_OF[state])
            out_texts.append("")
            continue
        if e == "K":
            state = KEPT[state]["sua".find(roles[at][:1])]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        elif e == "R":
            state = NEXT[state]
            out_roles.append(ROLE_OF[state])
            out_texts.append(texts[at])
        at += 1
    return out_roles, out_texts


def turns(conversations: DataFrame) -> DataFrame:
    """Rows ready for repair: nulls as one space, ``gone`` false; see ``damage`` for rows that went missing."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    return conversations.select(
        "conv_id", text["conv_id"].alias("cid"), F.col("turn").cast("long").alias("turn"),
        text["turn"].alias("turn_text"), text["role"].alias("role"), text["text"].alias("text"),
        F.monotonically_increasing_id().alias("uid"), F.lit(False).alias("gone"))


def damage(rows: DataFrame) -> DataFrame:
    """Reproducible damage by crc32(conv_id:turn) % 20; dropped rows stay as markers, so no conversation vanishes."""
    kind = F.crc32(F.concat_ws(":", "cid", "turn_text").cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.withColumn("kind", kind)
            .select("conv_id", "cid", "turn", "turn_text", F.when(F.col("kind") == 4, F.lit("user"))
                    .otherwise(F.col("role")).alias("role"), text.alias("text"), "uid",
                    (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy"))


FACTS = "n long, blank long, duplicate long, truncated long"
EDGE = ("illegal long, first_role string, last_role string, low long, high long, n_turns long, first_turn long, "
        "last_turn long")


def chunks(rows: DataFrame) -> DataFrame:
    """One row a chunk: (conv_id, cid, part, no, open, roles, texts, faults, turn facts), written once.

    ``open`` chunks belong to a conversation that may have others; (part, no) orders the chunks.
    """
    conv = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(
        f"cid string, part long, no long, open boolean, roles array<string>, texts array<string>, {EDGE}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        no, first, key, conv_id, many = 0, True, None, None, False
        roles, texts, at, size = [], [], [], 0
        done: list[dict] = []

        def close(is_open: bool) -> None:
            nonlocal no, roles, texts, at, size
            known = [x for x in at if x is not None]
            done.append({
                "conv_id": conv_id, "cid": key, "part": part, "no": no, "open": is_open, "roles": roles, "texts": texts,
                "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])),
                "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None,
                "low": min(known, default=None), "high": max(known, default=None), "n_turns": len(set(known)),
                "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None})
            no += 1
            roles, texts, at, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(done, schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for cid, conv_now, turn, role, text, gone in zip(*(c[x] for x in (
                    "cid", "conv_id", "turn", "role", "text", "gone"))):
                if cid != key:
                    if key is not None:
                        close(first or many)
                        first = False
                    key, conv_id, many = cid, conv_now, False
                elif len(roles) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                    close(True)
                    many = True
                if not gone:
                    roles.append(role)
                    texts.append(text)
                    at.append(turn)
                    size += len(role) + len(text)
                if len(done) >= 512:
                    yield out()
            if sum(len(t) for d in done for t in d["texts"]) > CHUNK_BYTES:
                yield out()
        if key is not None:
            close(True)
            yield out()

    order = ["cid", "turn", "tie", "uid"]
    tie = F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"))
    laid = rows.withColumn("tie", tie).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(laid.select("conv_id", "cid", "turn", "role", "text", "gone").mapInArrow(cut, schema), "chunks")


LEGAL = {"su", "ua", "au"}


def faults(roles: list, texts: list, seen: set) -> tuple[bytes, int, int, int]:
    """(symbols, blank, duplicate, truncated) of a chunk; ``seen`` holds digests of rows in earlier chunks."""
    symbols, here, blank, dup, cut = bytearray(), set(), 0, 0, 0
    for role, text in zip(roles, texts):
        body = text.rstrip(SPACE)
        if not body:
            blank += 1
            symbols.append(0)
            continue
        if (role, text) in here or (seen and digest(role, text) in seen):
            dup += 1
            symbols.append(0)
            continue
        here.add((role, text))
        kind = "sua".find(role[:1]) if role else -1
        kind = 3 if kind < 0 else kind
        if body[-1] in ".!?":
            symbols.append(1 + kind)
        else:
            cut += 1
            symbols.append(5 + kind)
    return bytes(symbols), blank, dup, cut


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def rowwise(df: DataFrame, fields: list[str], body, schema: T.StructType | str, state=None) -> DataFrame:
    """``body(row dict, state)`` -> row dict or None for every row, streaming; ``state`` makes a task's fresh state."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state() if state else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [r for row in batch.slice(at, 256).to_pylist() if (r := body(row, held)) is not None]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)
        if held is not None and (r := body(None, held)) is not None:
            yield pa.RecordBatch.from_pylist([r], schema=arrow)

    return df.select(*fields).mapInArrow(run, kind)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations in pieces: (conv_id, cid, part, no, open, audit, cost, faults, turn facts, roles, texts).

    A conversation's pieces in (part, no) order hold its edits and its repaired rows; pieces that are not ``open``
    are whole conversations.
    """
    held = chunks(rows)
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    piece = T.StructType([conv, *T._parse_datatype_string(
        f"cid string, part long, no long, open boolean, audit string, cost long, {FACTS}, {EDGE}, "
        "roles array<string>, texts array<string>").fields])
    carried = ["conv_id", "cid", "part", "no", "open", *[f.split()[0] for f in EDGE.split(", ")], "roles", "texts"]

    def solve(row: dict, _) -> dict:
        symbols, blank, dup, cut = faults(row["roles"], row["texts"], set(row.pop("seen", None) or ()))
        entry = row.pop("entry", START)
        edits, _, cost = trace(symbols, row.pop("right", 0), entry, row.pop("last", True))
        n = len(row["roles"])
        roles, texts = apply(edits, row["roles"], row["texts"], entry)
        return {**row, "audit": edits, "cost": cost, "n": n, "blank": blank, "duplicate": dup, "truncated": cut,
                "roles": roles, "texts": texts}

    whole = rowwise(held.where("not open"), carried, solve, piece)

    # digests of rows that an earlier chunk of the conversation holds, for the open chunks only
    opened = held.where("open")
    key = F.md5(F.concat(F.length("r.roles").cast("string"), F.lit(":"), "r.roles", "r.texts").cast("binary"))
    stands = (opened.select("cid", "part", "no", F.explode(F.arrays_zip("roles", "texts")).alias("r"))
              .select("cid", "part", "no", F.unhex(key).alias("key")).distinct())
    first = (stands.groupBy("cid", "key").agg(F.min(F.struct("part", "no")).alias("first"),
                                              F.count(F.lit(1)).alias("times")).where("times > 1"))
    seen = (stands.join(first, ["cid", "key"]).where(F.struct("part", "no") > F.col("first"))
            .groupBy("part", "no").agg(F.collect_list("key").alias("seen")))

    def symbols_of(row: dict, _) -> dict:
        found = faults(row["roles"], row["texts"], set(row["seen"] or ()))[0]
        return {"cid": row["cid"], "part": row["part"], "no": row["no"], "symbols": found, "seen": row["seen"],
                "left": tables().summary(found).astype(np.int16).tobytes()}

    spelled = cut_lineage(rowwise(
        opened.join(seen, ["part", "no"], "left"), ["cid", "part", "no", "roles", "texts", "seen"], symbols_of,
        "cid string, part long, no long, symbols binary, seen array<binary>, left binary"), "symbols")

    def from_end(row: dict | None, at: dict) -> dict | None:
        if row is None:
            return None
        last = row["cid"] != at.get("cid")
        right = 0 if last else at["vector"]
        at.update(cid=row["cid"], vector=int(np.frombuffer(row["left"], np.int16)[right]))
        return {"part": row["part"], "no": row["no"], "right": right, "last": last}

    back = rowwise(spelled.select("cid", "part", "no", "left").repartition("cid").sortWithinPartitions(
        "cid", F.desc("part"), F.desc("no")), ["cid", "part", "no", "left"], from_end,
        "part long, no long, right long, last boolean", dict)

    def exits(row: dict, _) -> dict:
        ends = [trace(row["symbols"], row["right"], q, row["last"])[1] for q in range(4)]
        return {**{k: row[k] for k in ("cid", "part", "no", "right", "last", "seen")}, "exits": ends}

    through = cut_lineage(rowwise(
        spelled.join(back, ["part", "no"]), ["cid", "part", "no", "symbols", "right", "last", "seen"], exits,
        "cid string, part long, no long, right long, last boolean, seen array<binary>, exits array<int>"), "exits")

    def from_start(row: dict | None, at: dict) -> dict | None:
        if row is None:
            return None
        entry = at["state"] if row["cid"] == at.get("cid") else START
        at.update(cid=row["cid"], state=row["exits"][entry])
        return {"part": row["part"], "no": row["no"], "entry": entry}

    forth = rowwise(through.select("cid", "part", "no", "exits").repartition("cid").sortWithinPartitions(
        "cid", "part", "no"), ["cid", "part", "no", "exits"], from_start, "part long, no long, entry long", dict)
    ready = opened.join(through.drop("cid", "exits"), ["part", "no"]).join(forth, ["part", "no"])
    split = rowwise(ready, [*carried, "right", "last", "seen", "entry"], solve, piece)
    return whole.unionByName(split)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: counts of faults, the least cost, its edits, and the SHA-256 of the repaired rows."""
    out = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string").fields])
    fields = pieces.columns

    def result(at: dict) -> dict:
        gaps = at["high"] - at["low"] + 1 - at["n_turns"] if at["n_turns"] else 0
        return {"conv_id": at["conv_id"], "gaps": gaps, **{k: at[k] for k in SUMS},
                "audit": "".join(at["audit"]), "repaired_sha256": at["sha"].hexdigest()}

    def fold(row: dict | None, at: dict) -> dict | None:
        done = None
        if row is None:
            return result(at) if at else None
        if row["cid"] != at.get("cid"):
            done = result(at) if at else None
            at.clear()
            at.update(cid=row["cid"], conv_id=row["conv_id"], audit=[], sha=hashlib.sha256(), rows=0, n_turns=0,
                      low=None, high=None, last_turn=None, last_role=None, **dict.fromkeys(SUMS, 0))
        for k in SUMS:
            at[k] += row[k]
        if row["first_role"] is not None:
            if at["last_role"] is not None:
                at["illegal"] += at["last_role"][:1] + row["first_role"][:1] not in LEGAL
            at["last_role"] = row["last_role"]
        if row["n_turns"]:
            at["n_turns"] += row["n_turns"] - (at["n_turns"] > 0 and row["first_turn"] == at["last_turn"])
            at["low"] = row["low"] if at["low"] is None else at["low"]
            at["high"] = at["last_turn"] = row["last_turn"]
        at["audit"].append(row["audit"])
        for role, text in zip(row["roles"], row["texts"]):
            at["sha"].update(("\n" * (at["rows"] > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            at["rows"] += 1
        return done

    pieces = cut_lineage(pieces, "pieces")
    whole = rowwise(pieces.where("not open"), fields, lambda row, _: first_of(fold, result, row), out)
    split = rowwise(pieces.where("open").repartition("cid").sortWithinPartitions("cid", "part", "no"), fields, fold,
                    out, dict)
    return whole.unionByName(split)


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def first_of(fold, result, row: dict) -> dict:
    """The digest of a conversation in one piece."""
    at: dict = {}
    fold(row, at)
    return result(at)


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, no, position, role, text): the repaired conversations row by row."""
    return pieces.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts"))).select(
        "conv_id", "part", "no", F.col("pos").alias("position"), F.col("col.roles").alias("role"),
        F.col("col.texts").alias("text"))
