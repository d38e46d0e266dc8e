"""Conversation structure repair by a min-plus scan of 4 x 4 matrices.

Operator 11. A conversation's roles must read ``(s?(ua)+)?`` by initials: a machine of four states (start, after a system turn,
after a user's, after an assistant's). Each turn is a 4 x 4 matrix over elements (cost, audit): the cheapest way, and of equal
ones the ASCII-least string of edits, to go from one state to another over that turn, with the closure of inserted turns in
front of it. Sums of elements take the least, products add costs and join audits. The audits of one matrix
all end with the edit of the same turn, so none begins another, and comparing by parts is comparing whole: the product
is associative. Inserts behind the last turn follow at the end.

So a matrix needs no strings, only costs and the ranks of its 16 audits. Turns in order are cut into chunks of at most
2^12 neighbours; a numpy kernel reduces the chunks of an Arrow batch pair by pair, then chunks by eight range partitions,
then these by conversation, and the same trees walked back give each turn its states, edit and inserts. A very long
conversation is spread over as many tasks as its turns need. One row holds at most 2^12 turns, or
a hundred bytes for each chunk of eight partitions; only the digest of a conversation is made in one task, from a
stream of chunks, since sha256 has no parallel form, and its audit is one string by contract.

Turns that are equal in all columns are counted first and stay one row with a number, however many they are. Repeats within a
conversation are found by the least position of each (conversation, role, digest of the text).

Defined results: null roles and texts are one blank. A null conv_id is a conversation of its own. Null turns come first; turns with the
same number are in the order of role, then text. Long texts are kept whole; equal rows are duplicates of the first.
Other columns are left aside. A conversation without turns has zeros and an empty audit; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, stash, table

#: Fixed costs of the edits.
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
#: Turns of a chunk: 2^12 neighbours; chunks of a group: those of 2^36 positions, which are eight partitions.
CHUNK, GROUP = 12, 36
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Inserts from a state to another; the closure of inserting user and assistant turns.
CLOSURE = np.array([[0, 9, 1, 2], [9, 0, 1, 2], [9, 9, 0, 1], [9, 9, 1, 0]])
#: Turns whose state stands before the key's may come before it.
TRAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
PLAIN, TRUNCATED, DUPLICATE, EMPTY = range(4)
LETTERS = "DKR"


# The kernel ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def leaves() -> dict[str, np.ndarray]:
    """By kind of turn (initial * 2 + truncated for those that may stay, 8 for the others): cost, rank, inserts, via and letter of each pair of states."""
    shape = (9, 4, 4)
    out = {"cost": np.full(shape, NEVER), "rank": np.full(shape, 15), "inserts": np.zeros(shape, int), "via": np.zeros(shape, int), "letter": np.zeros(shape, int)}
    goes = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
    either = goes["u"] | goes["a"]
    for kind in range(9):
        extra = UNFINISHED * (kind % 2)
        edits = [] if kind == 8 else [("K", extra, goes["sua"[kind // 2 : kind // 2 + 1]]), ("R", REROLE + extra, either)]
        edits.append(("D", DELETE, {k: k for k in range(4)}))
        best = {}
        for i in range(4):
            for letter, cost, moves in edits:
                for via, to in moves.items():
                    if CLOSURE[i, via] < 9:
                        n = int(CLOSURE[i, via])
                        best[i, to] = min(best.get((i, to), (NEVER, "", 0)), (cost + INSERT * n, "I" * n + letter, via))
        audits = sorted({b[1] for b in best.values()})
        for (i, to), (cost, audit, via) in best.items():
            for name, value in (("cost", cost), ("rank", audits.index(audit)), ("inserts", len(audit) - 1), ("via", via), ("letter", LETTERS.index(audit[-1]))):
                out[name][kind, i, to] = value
    return out


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """Costs, ranks and middle states of the products of matrices (cost, rank) of shape (n, 4, 4)."""
    cost = np.minimum(a[0][:, :, :, None] + b[0][:, None, :, :], NEVER)
    key = cost * 256 + a[1][:, :, :, None] * 16 + b[1][:, None, :, :]
    middle = key.argmin(2)
    key = np.take_along_axis(key, middle[:, :, None, :], 2)[:, :, 0, :]
    cost = key >> 8
    audit = np.where(cost < NEVER, key & 255, 255).reshape(-1, 16)
    order = audit.argsort(1)
    sorted_ = np.take_along_axis(audit, order, 1)
    rank = np.zeros_like(audit)
    np.put_along_axis(rank, order, np.concatenate((np.zeros((len(audit), 1), np.int64), np.cumsum(np.diff(sorted_, axis=1) != 0, 1)), 1), 1)
    return cost, rank.reshape(-1, 4, 4), middle


def reduce_tree(cost: np.ndarray, rank: np.ndarray, sizes: np.ndarray):
    """Product of each run of ``sizes`` (none 0) neighbours, pair by pair, and what :func:`walk_back` needs."""
    steps = []
    while (sizes > 1).any():
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.flatnonzero(within % 2 == 0)
        paired = within[left] + 1 < np.repeat(sizes, (sizes + 1) // 2)
        a, b = left[paired], left[paired] + 1
        cost_ab, rank_ab, middle = _product((cost[a], rank[a]), (cost[b], rank[b]))
        steps.append((len(cost), left, paired, middle))
        cost, rank = cost[left], rank[left]
        cost[paired], rank[paired] = cost_ab, rank_ab
        sizes = (sizes + 1) // 2
    return cost, rank, steps


def walk_back(steps, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each factor, from those before and after each product."""
    for n, left, paired, middle in reversed(steps):
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[left], after[left] = first, last
        between = middle[np.arange(len(middle)), first[paired], last[paired]]
        after[left[paired] + 1] = last[paired]
        after[left[paired]] = before[left[paired] + 1] = between
        first, last = before, after
    return first, last


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest cost of whole conversations with the inserts behind them, and the state before those."""
    trail = np.array([TRAIL[s] for s in range(4)])
    total = cost[:, START, :] + INSERT * trail
    state = (total * 64 + rank[:, START, :] * 4 + trail).argmin(1)
    return total[np.arange(len(total)), state], state


def unlawful(codes: np.ndarray, copies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Neighbours in each run whose initials aren't su, ua or au; a turn's copies are neighbours with the same."""
    lawful = np.zeros((4, 4), bool)
    lawful[0, 1] = lawful[1, 2] = lawful[2, 1] = True
    wrong = copies - 1
    wrong[1:] += ~lawful[codes[:-1], codes[1:]] & (np.repeat(np.arange(len(sizes)), sizes)[1:] == np.repeat(np.arange(len(sizes)), sizes)[:-1])
    return np.add.reduceat(wrong, np.cumsum(sizes) - sizes)


def _leaf_matrices(code, fault, copies):
    kind = np.where(fault >= DUPLICATE, 8, code * 2 + (fault == TRUNCATED))
    cost = leaves()["cost"][kind]
    cost = np.where((cost < NEVER) & (kind == 8)[:, None, None], cost + (DELETE * (copies - 1))[:, None, None], cost)
    return kind, cost, leaves()["rank"][kind]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sizes and flat fields of a column of non-empty lists of structs; lists of numbers become rows of 16."""
    flat = column.flatten()
    fields = {}
    for k in range(flat.type.num_fields):
        values, kind = flat.field(k), flat.type.field(k).type
        if pa.types.is_list(kind):
            # The field's own offsets count from the start of its buffer.
            fields[flat.type.field(k).name] = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4, 4)
        elif pa.types.is_integer(kind):
            fields[flat.type.field(k).name] = values.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), fields


def _sixteen(matrices: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrices) + 1, dtype=np.int32) * 16), pa.array(matrices.reshape(-1)))


_NODE = "cost array<bigint>, rank array<bigint>, head int, tail int, illegal bigint"


def _node(cost, rank, head, tail, illegal) -> list[pa.Array]:
    return [_sixteen(cost), _sixteen(rank), pa.array(head.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(illegal)]


def _reduced_turns(batches):
    """conv, chunk, turns -> conv, chunk and the chunk's matrix, initials at its ends, unlawful neighbours."""
    for batch in batches:
        if batch.num_rows:
            sizes, t = _lists(batch.column(2))
            _, cost, rank = _leaf_matrices(t["code"], t["fault"], t["copies"])
            cost, rank, _ = reduce_tree(cost, rank, sizes)
            ends = np.cumsum(sizes)
            node = _node(cost, rank, t["code"][ends - sizes], t["code"][ends - 1], unlawful(t["code"], t["copies"], sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *node], names=["conv", "part", *[f.split()[0] for f in _NODE.split(", ")]])


def _joined_nodes(sizes, t):
    cost, rank, steps = reduce_tree(t["cost"], t["rank"], sizes)
    ends = np.cumsum(sizes)
    between = unlawful(np.stack((t["head"], t["tail"]), 1).reshape(-1), np.ones(2 * len(t["head"]), np.int64), 2 * sizes)
    # Head and tail of one node aren't neighbours; their pair was counted among the others and goes away.
    inside = np.add.reduceat(unlawful(np.stack((t["head"], t["tail"]), 1).reshape(-1), np.ones(2 * len(t["head"]), np.int64), np.full(len(t["head"]), 2)), ends - sizes)
    return cost, rank, steps, t["head"][ends - sizes], t["tail"][ends - 1], np.add.reduceat(t["illegal"], ends - sizes) + between - inside


def _reduced_nodes(batches):
    for batch in batches:
        if batch.num_rows:
            cost, rank, _, *rest = _joined_nodes(*_lists(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_node(cost, rank, *rest)], names=["conv", "part", *[f.split()[0] for f in _NODE.split(", ")]])


def _pairs(column: pa.ListArray, *fields: tuple[str, np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for _, v in fields], names=[n for n, _ in fields]))


def _settled(batches):
    """conv, nodes -> cost, illegal, state before the last inserts, and the states around each node."""
    for batch in batches:
        if batch.num_rows:
            sizes, t = _lists(batch.column(1))
            cost, rank, steps, _, _, illegal = _joined_nodes(sizes, t)
            total, state = ending(cost, rank)
            before, after = walk_back(steps, np.zeros(len(sizes), np.int64), state)
            parts = _pairs(batch.column(1), ("part", t["part"]), ("before", before), ("after", after))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(illegal), pa.array(state), parts], names=["conv", "cost", "illegal", "state", "parts"])


def _walked_nodes(batches):
    """conv, nodes, before, after -> conv and the states around each node."""
    for batch in batches:
        if batch.num_rows:
            sizes, t = _lists(batch.column(1))
            _, _, steps = reduce_tree(t["cost"], t["rank"], sizes)
            before, after = walk_back(steps, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _pairs(batch.column(1), ("part", t["part"]), ("before", before), ("after", after))], names=["conv", "parts"])


def _walked_turns(batches):
    """conv, chunk, turns, before, after -> conv, chunk and each turn's inserts in front, state behind those, letter and state after it."""
    for batch in batches:
        if batch.num_rows:
            sizes, t = _lists(batch.column(2))
            kind, cost, rank = _leaf_matrices(t["code"], t["fault"], t["copies"])
            _, _, steps = reduce_tree(cost, rank, sizes)
            before, after = walk_back(steps, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)))
            fields = [(n, leaves()[n][kind, before, after].astype(np.int32)) for n in ("inserts", "via", "letter")]
            edits = _pairs(batch.column(2), *fields, ("after", after.astype(np.int32)), ("fault", t["fault"].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), edits], names=["conv", "chunk", "edits"])


# The plan -----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` deals out."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.where(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def _key(name: str) -> Column:
    """A conversation's name: never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _placed(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, place: numbers in the order of conversations and their turns."""
    rows = turns.select(_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    # The first of equal rows by itself, the others as one.
    rows = rows.withColumn("copies", F.explode(F.filter(F.array(F.lit(1).cast("long"), F.col("n") - 1), lambda n: n > 0)))
    # Bounds of ranges come to the driver: long texts must not.
    rows = rows.withColumn("lead", F.substring("text", 1, 64)).repartitionByRange("conv", "turn", "role", "lead")
    rows = rows.sortWithinPartitions("conv", "turn", "role", "text", "copies")
    return stash(rows.select("conv", "turn", "role", "text", "copies", F.monotonically_increasing_id().alias("place")), "turns")


def _chunk() -> Column:
    return F.shiftright("place", CHUNK)


def _marked(placed: DataFrame) -> DataFrame:
    """conv, place, turn, code of the role's initial, fault, copies."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" " + BLANKS)), -1, 1)
    slim = placed.select(
        "conv", "place", "turn", "copies", "role", F.sha2("text", 256).alias("digest"), (F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1).alias("code"), (last == "").alias("blank"), last.isin(".", "!", "?").alias("done"),
    )
    slim = slim.withColumn("code", F.when((F.col("code") >= 0) & (F.col("role") != ""), F.col("code")).otherwise(3))
    firsts = slim.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), EMPTY).when(F.col("first").isNull(), DUPLICATE).when(F.col("done"), PLAIN).otherwise(TRUNCATED)
    return stash(slim.join(firsts, ["conv", "place"], "left").select("conv", "place", "turn", F.col("code").cast("int").alias("code"), fault.alias("fault"), "copies"), "faults")


class Repairs:
    """The cheapest repair of every conversation of (conv_id, turn, role, text).

    ``turns()`` has each turn with its fault and edits, ``conversations()`` costs and counts, ``digests()`` the audits and hashes.
    """

    def __init__(self, turns: DataFrame):
        self.kind = turns.schema["conv_id"].dataType
        self.placed = _placed(turns)
        self.marked = _marked(self.placed)
        chunks = self.marked.groupBy("conv", _chunk().alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "code", "fault", "copies"))).alias("turns"))
        nodes = stash(chunks.mapInArrow(_reduced_turns, f"conv string, part bigint, {_NODE}"), "chunks")
        listed = F.sort_array(F.collect_list(F.struct("part", "cost", "rank", "head", "tail", "illegal"))).alias("nodes")
        group = F.shiftright("part", GROUP - CHUNK).alias("group")
        groups = nodes.groupBy("conv", group).agg(listed)
        tops = groups.mapInArrow(_reduced_nodes, f"conv string, part bigint, {_NODE}")
        parts = "parts array<struct<part:bigint,before:bigint,after:bigint>>"
        self.whole = stash(tops.groupBy("conv").agg(listed).mapInArrow(_settled, f"conv string, cost bigint, illegal bigint, state bigint, {parts}"), "settled")
        around = self.whole.select("conv", F.explode("parts").alias("p")).select("conv", F.col("p.part").alias("group"), "p.before", "p.after")
        walked = groups.join(around, ["conv", "group"]).select("conv", "nodes", "before", "after").mapInArrow(_walked_nodes, f"conv string, {parts}")
        around = walked.select("conv", F.explode("parts").alias("p")).select("conv", F.col("p.part").alias("chunk"), "p.before", "p.after")
        edits = "edits array<struct<inserts:int,via:int,letter:int,after:int,fault:int>>"
        self.edits = chunks.join(around, ["conv", "chunk"]).select("conv", "chunk", "turns", "before", "after").mapInArrow(_walked_turns, f"conv string, chunk bigint, {edits}")

    def _id(self) -> Column:
        return F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1).cast(self.kind)).alias("conv_id")

    def _edited(self) -> DataFrame:
        """conv, chunk, and its turns with their edits, in order."""
        texts = self.placed.groupBy("conv", _chunk().alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text", "copies"))).alias("rows"))
        both = texts.join(self.edits, ["conv", "chunk"])

        def one(row, edit):
            letter = F.element_at(F.array(*map(F.lit, LETTERS)), edit["letter"] + 1)
            audit = F.concat(F.repeat(F.lit("I"), edit["inserts"]), F.repeat(letter, row["copies"].cast("int")))
            line = lambda who, text: F.struct(who.alias("role"), text.alias("text"))
            user, helper = (line(F.lit(who), F.lit("")) for who in ("user", "assistant"))
            front = F.when(edit["inserts"] == 0, F.array().cast("array<struct<role:string,text:string>>")).when(edit["inserts"] == 2, F.array(user, helper)).when(edit["via"] == USER, F.array(user)).otherwise(F.array(helper))
            role = F.when(letter == "K", row["role"]).when(edit["after"] == USER, "user").otherwise("assistant")
            repaired = F.when(letter == "D", front).otherwise(F.concat(front, F.array(line(role, row["text"]))))
            fault = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("truncated", "duplicate", "blank"))), edit["fault"] + 1)
            return F.struct(row["turn"].alias("turn"), row["role"].alias("role"), row["text"].alias("text"), row["copies"].alias("copies"), fault.alias("fault"), audit.alias("audit"), repaired.alias("repaired"))

        return both.select("conv", "chunk", F.zip_with("rows", "edits", one).alias("turns"))

    def turns(self) -> DataFrame:
        """conv_id, place (ascending within a conversation), turn, role, text, copies, fault, audit, repaired: the turns that stand for it.

        Turns inserted at a conversation's end belong to no turn; ``conversations()`` has them.
        """
        rows = self._edited().select("conv", "chunk", F.posexplode("turns").alias("k", "t"))
        return rows.select(self._id(), (F.shiftleft("chunk", CHUNK) + F.col("k")).alias("place"), "t.*")

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, added (turns inserted at the end)."""
        return self._counted().select(self._id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "added")

    def _counted(self) -> DataFrame:
        count = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("copies")).otherwise(0))
        sums = self.marked.groupBy("conv").agg(
            count(EMPTY).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), (F.max("turn") - F.min("turn") + 1).alias("span"),
        )
        # Two steps: a long conversation's turns aren't told apart in one task.
        numbers = self.marked.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("distinct"))
        added = F.element_at(F.array(*[F.lit(TRAIL[s]) for s in range(4)]), F.col("state").cast("int") + 1)
        out = sums.join(numbers, "conv", "left").join(self.whole.select("conv", "cost", "illegal", "state"), "conv")
        return out.select("conv", F.coalesce(F.col("span") - F.col("distinct"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", added.alias("added"))

    def digests(self) -> DataFrame:
        """conv, audit and repaired_sha256: of repaired ``role:text`` lines."""
        turn = F.col("turns")
        lines = F.flatten(F.transform(turn, lambda t: F.transform(t["repaired"], lambda r: F.concat(r["role"], F.lit(":"), r["text"]))))
        pieces = self._edited().select("conv", "chunk", F.array_join(F.transform(turn, lambda t: t["audit"]), "").alias("audit"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text"))
        state = F.col("state")
        tail = F.when(state == SYSTEM, F.struct(F.lit("II"), F.lit("user:\nassistant:"))).when(state == USER, F.struct(F.lit("I"), F.lit("assistant:")))
        ends = self.whole.select("conv", F.lit(2**63 - 1).alias("chunk"), tail.alias("t")).where("t IS NOT NULL").select("conv", "chunk", F.col("t.col1").alias("audit"), F.col("t.col2").alias("text"))
        ordered = pieces.unionByName(ends).repartition("conv").sortWithinPartitions("conv", "chunk")
        return ordered.mapInArrow(_hashed, "conv string, audit string, repaired_sha256 string")


def _hashed(batches):
    """Audits joined and texts hashed as they stream by, sorted by conversation and chunk."""
    done, now = [], None

    def batch():
        rows = [pa.array([d[k] for d in done], pa.string()) for k in range(3)]
        done.clear()
        return pa.RecordBatch.from_arrays(rows, names=["conv", "audit", "repaired_sha256"])

    for rows in batches:
        for conv, audit, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
            if now is None or conv != now:
                if now is not None:
                    done.append((now, "".join(audits), sha.hexdigest()))
                now, audits, sha, lead = conv, [], hashlib.sha256(), b""
            audits.append(audit)
            if text.is_valid:
                sha.update(lead)
                sha.update(text.as_buffer())
                lead = b"\n"
        if done:
            yield batch()
    if now is not None:
        done.append((now, "".join(audits), sha.hexdigest()))
        yield batch()


def report(conversations: DataFrame) -> DataFrame:
    """Counts, costs and digests of every conversation after the damage."""
    repairs = Repairs(damaged(conversations))
    every = conversations.select(_key("conv_id").alias("conv")).distinct()
    out = every.join(repairs._counted(), "conv", "left").join(repairs.digests(), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(repairs._id(), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit; then one step for each turn, which keeps for each state the least (cost, audit, repaired lines).
ORACLE_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384) ELSE xor(acc, x) >> 1 END, 4294967295::BIGINT), 4294967295) % 20 AS h FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE h <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM dam),
cop AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM num),
flt AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM cop),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
run AS (
  SELECT conv_id, 0::BIGINT AS i, n, {'c': 0::BIGINT, 'a': '', 'o': ''} AS s0, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS s1, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS s2, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS s3 FROM agg
  UNION ALL
  SELECT conv_id, i, n,
    {'c': s0.c + 2, 'a': s0.a || 'D', 'o': s0.o},
    list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 'o': s1.o}, {'c': CASE WHEN k AND c = 's' THEN s0.c + x ELSE 1000000 END, 'a': s0.a || 'K', 'o': s0.o || role || ':' || text || chr(10)}]),
    list_min([{'c': u2.c + 2, 'a': u2.a || 'D', 'o': u2.o}, {'c': CASE WHEN k AND c = 'u' THEN fu.c + x ELSE 1000000 END, 'a': fu.a || 'K', 'o': fu.o || role || ':' || text || chr(10)},
      {'c': CASE WHEN k THEN fu.c + 1 + x ELSE 1000000 END, 'a': fu.a || 'R', 'o': fu.o || 'user:' || text || chr(10)}]),
    list_min([{'c': u3.c + 2, 'a': u3.a || 'D', 'o': u3.o}, {'c': CASE WHEN k AND c = 'a' THEN u2.c + x ELSE 1000000 END, 'a': u2.a || 'K', 'o': u2.o || role || ':' || text || chr(10)},
      {'c': CASE WHEN k THEN u2.c + 1 + x ELSE 1000000 END, 'a': u2.a || 'R', 'o': u2.o || 'assistant:' || text || chr(10)}])
  FROM (SELECT *, list_min([s0, s1, u3]) AS fu FROM (
    SELECT r.conv_id, f.i, r.n, f.role, f.text, f.c, f.fault NOT IN ('blank', 'duplicate') AS k, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS x, s0, s1,
      list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I', 'o': s0.o || 'user:' || chr(10)}, {'c': s1.c + 5, 'a': s1.a || 'I', 'o': s1.o || 'user:' || chr(10)}, {'c': s3.c + 5, 'a': s3.a || 'I', 'o': s3.o || 'user:' || chr(10)}]) AS u2,
      list_min([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'o': s2.o || 'assistant:' || chr(10)}, {'c': s0.c + 10, 'a': s0.a || 'II', 'o': s0.o || 'user:' || chr(10) || 'assistant:' || chr(10)},
        {'c': s1.c + 10, 'a': s1.a || 'II', 'o': s1.o || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS u3
    FROM run r JOIN flt f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1))),
fin AS (SELECT conv_id, list_min([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'o': s2.o || 'assistant:' || chr(10)}, {'c': s1.c + 10, 'a': s1.a || 'II', 'o': s1.o || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS e FROM run WHERE i = n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(left(e.o, greatest(length(e.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""
