"""Quotation linking for chat formatting.

Operator 1. Lines that begin with ``>`` marks are quotes of that nesting level. Adjacent lines of one level are a
passage; the rest of a message, without attribution lines such as "On ... wrote:", is its reply. Passages are normalised
(lower case, letters and digits only) and hashed by line and by paragraph. Hashes are joined to those of original
messages' own text: the latest earlier message of the conversation that holds one, or else the only message of all
conversations that does; a phrase that several hold tells nothing. The message that most words of the outermost quotes point to is the
parent. Following parents gives each message its thread, its depth in it, and its position: a message comes before all that answer it,
and these, each with its own answers, in the order of turns. So thread and position order conversations by replies, without
quotes. Where links between conversations close a circle, its first message loses its parent.

Positions are ranks in a tour that enters and leaves each message: its steps are doubled until they reach the end, so that no task walks
a thread.

The earlier message is looked up in blocks of turns: a grouped maximum over earlier blocks, and a window inside one.
A hot conversation or a very common line is split by those blocks and by partial aggregation. No join pairs
messages with each other.

Defined results: a null text has an empty reply and no quotes. Rows without conv_id or turn keep their reply, and are
neither linked nor pointed to. Repeated (conv_id, turn) share their links. Quotes of nothing known stay unlinked. A
message that quotes nothing is a thread of its own. Columns besides conv_id, turn, role and text have no effect. No
rows give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import release, stash, table

_MARKS = re.compile(r"(?:[ \t]{0,3}>)+")
#: Fixed phrases of mail programs before a quote.
_WROTE = re.compile(r"\s*(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\b[^:]{0,80}:\s*$")
_WORDS = re.compile(r"[^\W_]+")
#: Words from which a line or paragraph is told apart from chance.
LEAST = 3
#: Turns looked up together.
BLOCK = 1024


def levels(text: str | None) -> list[tuple[int, str]]:
    """(nesting level, content) of each line."""
    out = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        out.append((m[0].count(">"), line[m.end() :].strip()) if m else (0, line))
    return out


def parts(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The reply, and passages as (level, lines)."""
    lines = levels(text)
    reply: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for k, (level, line) in enumerate(lines):
        if level:
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line)
        elif not (_WROTE.match(line) and any(n for n, x in lines[k + 1 : k + 3] if n or x.strip())):
            reply.append(line)
        before = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(reply)).strip(), passages


def units(lines: list[str]) -> dict[int, int]:
    """Hash and number of words of each line and each paragraph, normalised."""
    out: dict[int, int] = {}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        words = _WORDS.findall(line.lower())
        if words:
            paragraph += words
        elif paragraph:
            words, paragraph = paragraph, []
        for run in (words,):
            if len(run) >= LEAST:
                out[xxhash.xxh3_64_intdigest(" ".join(run)) - 2**63] = len(run)
    return out


_PARSED = "conv_id bigint, turn bigint, role string, reply string, n_quotes bigint, max_level bigint, own array<bigint>, quoted array<struct<level:bigint,hash:bigint,words:bigint>>"
_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("reply", pa.string()), ("n_quotes", pa.int64()), ("max_level", pa.int64()),
        ("own", pa.list_(pa.int64())), ("quoted", pa.list_(pa.struct([("level", pa.int64()), ("hash", pa.int64()), ("words", pa.int64())]))),
    ]
)


def _parse(batches):
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            reply, passages = parts(text)
            quoted = {(level, h): n for level, lines in passages for h, n in units(lines).items()}
            rows.append(
                {
                    "conv_id": conv, "turn": turn, "role": role, "reply": reply, "n_quotes": len(passages), "max_level": max((n for n, _ in passages), default=0),
                    "own": sorted(units(reply.split("\n"))), "quoted": [{"level": a, "hash": h, "words": n} for (a, h), n in sorted(quoted.items())],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _sources(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, words of quoted units with the message src_conv, src_turn that holds them."""
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    own = known.select("conv_id", "turn", F.explode("own").alias("hash"))
    # Only hashes that are quoted somewhere matter.
    own = own.join(quoted.select("hash").distinct(), "hash", "left_semi").distinct()
    block = F.floor(F.col("turn") / BLOCK)
    asked = quoted.select("conv_id", "hash", "turn", F.lit(None).cast("bigint").alias("has")).distinct()
    both = asked.unionByName(own.select("conv_id", "hash", "turn", F.col("turn").alias("has"))).withColumn("b", block)
    before = Window.partitionBy("conv_id", "hash").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    early = both.groupBy("conv_id", "hash", "b").agg(F.max("has").alias("has")).select("conv_id", "hash", "b", F.max("has").over(before).alias("early"))
    near = Window.partitionBy("conv_id", "hash", "b").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("has").over(near)).where("has IS NULL").join(early, ["conv_id", "hash", "b"])
    here = found.select("conv_id", "hash", "turn", F.coalesce("near", "early").alias("here"))
    # What several messages hold says of none that it is meant.
    first = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = quoted.join(here, ["conv_id", "hash", "turn"], "left").join(first, "hash", "left")
    # Elsewhere only in other conversations: in its own, a later message isn't what it answers.
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first"))
    src = F.when(F.col("here").isNotNull(), F.struct("conv_id", F.col("here").alias("turn"))).otherwise(other)
    return out.select("conv_id", "turn", "level", "hash", "words", src.alias("src")).where("src IS NOT NULL")


def _acyclic(parent: DataFrame) -> DataFrame:
    """The links without that of the first message of each circle, which leads to another conversation.

    Steps are doubled with the first message on the way, which is the message itself only for the one to cut.
    """
    links = stash(parent, "links")
    # In a conversation links go to earlier turns, so a circle has one to a conversation of a larger number.
    if not links.where("parent.conv_id > conv_id").limit(1).count():
        return links
    now = links.select(F.struct("conv_id", "turn").alias("m"), F.col("parent").alias("up"), F.col("parent").alias("low"))
    steps = 1
    while True:
        far = now.select(F.col("m").alias("up"), F.col("up").alias("next"), F.col("low").alias("more"))
        # What leads to a message without a parent is in no circle.
        now = stash(now.join(far, "up").select("m", F.col("next").alias("up"), F.least("low", "more").alias("low")), "circles")
        steps *= 2
        if steps >= now.count():
            break
    cut = now.where("low = m").select("m.conv_id", "m.turn")
    return links.join(cut, ["conv_id", "turn"], "left_anti")


def _threads(parent: DataFrame) -> DataFrame:
    """conv_id, turn, thread (conv_id, turn), depth of messages with a parent, by doubling the steps towards the root."""
    now = stash(parent.select(F.struct("conv_id", "turn").alias("m"), F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth")), "parents")
    while True:
        far = now.select(F.col("m").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = now.join(far, "up", "left").select("m", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        step = stash(step, "parents")
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now.select("m.conv_id", "m.turn", F.col("up").alias("thread"), "depth")


def _positions(parent: DataFrame) -> DataFrame:
    """conv_id, turn, position from 0 of all messages of threads with more than one, parents before their answers."""
    name = lambda conv, turn: F.struct(F.col(turn).alias("turn"), F.col(conv).alias("conv_id"))
    child = parent.select(name("conv_id", "turn").alias("m"), name("parent.conv_id", "parent.turn").alias("up"))
    order = Window.partitionBy("up").orderBy("m")
    nodes = child.select("m").unionByName(child.select(F.col("up").alias("m"))).distinct()
    first = child.groupBy("up").agg(F.min("m").alias("down")).withColumnRenamed("up", "m")
    nodes = nodes.join(child.withColumn("beside", F.lead("m").over(order)), "m", "left").join(first, "m", "left")
    step = lambda m, side: F.struct(m.alias("m"), F.lit(side).alias("side"))
    m, up, down, beside = (F.col(c) for c in ("m", "up", "down", "beside"))
    into = F.when(down.isNotNull(), step(down, 0)).otherwise(step(m, 1))
    out = F.when(beside.isNotNull(), step(beside, 0)).when(up.isNotNull(), step(up, 1))
    both = F.explode(F.array(F.struct(step(m, 0).alias("e"), into.alias("next"), F.lit(1).cast("bigint").alias("n")), F.struct(step(m, 1).alias("e"), out.alias("next"), F.lit(0).cast("bigint").alias("n"))))
    now = stash(nodes.select(both.alias("s")).select("s.*"), "tour")
    while now.where("next IS NOT NULL").limit(1).count():
        far = now.select(F.col("e").alias("next"), F.col("next").alias("more"), F.col("n").alias("further"))
        now = stash(now.join(far, "next", "left").select("e", F.col("more").alias("next"), (F.col("n") + F.coalesce("further", F.lit(0))).alias("n")), "tour")
    # What is entered from a message to the end; the thread's first message has all before it.
    return now.where("e.side = 0").select("e.m.conv_id", "e.m.turn", F.col("n").alias("left"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply, n_quotes, max_level, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, depth, position.

    In the order (thread_conv, thread_turn, position) a message comes after the one that it answers, and before that one's later answers.
    """
    rows = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    parsed = stash(rows.mapInArrow(_parse, _PARSED), "messages")
    sources = stash(_sources(parsed), "sources")
    votes = sources.groupBy("conv_id", "turn", "level", "src").agg(F.sum("words").alias("words"))
    # The outermost level counts first; then words, then the later message.
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("words"), F.col("src.turn"), F.col("src"))).alias("v")).select("conv_id", "turn", F.col("v.src").alias("parent"))
    best = _acyclic(best)
    linked = sources.groupBy("conv_id", "turn").agg(F.countDistinct("level", "hash").alias("n_linked"))
    threads = _threads(best)
    tours = stash(_positions(best), "tours")
    # A thread's first message has the whole thread to its end.
    whole = tours.select(F.struct("conv_id", "turn").alias("thread"), F.col("left").alias("whole"))
    placed = threads.join(whole, "thread").join(tours, ["conv_id", "turn"]).withColumn("position", F.col("whole") - F.col("left")).drop("whole", "left")
    known = linked.join(best, ["conv_id", "turn"], "left").join(placed, ["conv_id", "turn"], "left")
    out = parsed.drop("own", "quoted").join(known, ["conv_id", "turn"], "left")
    release(messages.sparkSession)
    return out.select(
        "conv_id", "turn", "role", "reply", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("thread.conv_id", "conv_id").alias("thread_conv"), F.coalesce("thread.turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("bigint").alias("position"),
    )


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
