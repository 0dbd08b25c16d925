"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: each distinct beginning is one node of a tree, and its last turn,
formatted, is emitted once. A tree's segments stand depth first in one stream of code points, every node
directly before the child that most conversations pass (its heavy child). A segment has the position id of
its first code point, which is what it would be were the conversation alone, and the intervals of the stream that it attends to: its
ancestors'. A path leaves heavy children at most log2(conversations) times, so that many intervals hold any number of ancestors; within
its segment a code point attends to those before it.

On Spark: turns are dealt over ranges of (conversation, turn); a beginning is known by its length and two running sums, modulo a
prime, of hashes of (turn number, SHA-256 of the turn), carried over the ranges, so a conversation of any
length is never in one task. Nodes are aggregates of equal sums. Depth-first order is the order of (path of light children, depth), and
offsets are running totals in that order. Nodes that many conversations share, and conversations with many turns, are
dealt over salts by their counted size. Only reading back puts a conversation in one task, which streams it in order, as a digest of it must.

A turn is formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts get a backslash after
their first character (and one more if they have some already), which is taken out when they are read.

Defined results: null roles and texts are empty; rows with a null conv_id are one conversation; turns with a null number come first;
turns of one number are ordered by their SHA-256, repeated rows are turns of their own; no conversations, no rows; a very long
text is one segment; other columns are ignored. The loss mask covers the texts of role ``assistant``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.llm import hot
from corvella.plans.ordered import running_totals
from corvella.plans.storage import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
# Strings that chat templates in common use give a meaning.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
RESTS = "|".join(re.escape(x[1:]) for x in CONTROL)
ESCAPED = re.compile(rf"([<\[])(\\*)\\(?={RESTS})")
PRIME = (1 << 61) - 1
RUN_TURNS = 4096
CONV = ["known", "cid"]
READ = "known boolean, cid long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Forest(NamedTuple):
    """``segments``: tree, start, n_chars, position, turn, run, shared, text, loss_from, loss_to, attends. ``paths``: known, cid, n_turns, n_chars, spans."""

    segments: DataFrame
    paths: DataFrame


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={RESTS})", r"$1$2\\")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def _role(role: Column) -> Column:
    """A role in one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(role), F.lit("\n"), escape(text), F.lit(CLOSE))


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, _, rest = segment.removeprefix(OPEN).partition("\n")
    if not segment.startswith(OPEN) or not rest.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(head)), unescape(rest.removesuffix(CLOSE))


def _running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` (dealt over ranges of CONV and ``order``, numbered _range) with running sums within each conversation."""
    inside = Window.partitionBy("_range", *CONV).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*CONV).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = rows.groupBy("_range", *CONV).agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    carried = parts.select("_range", *CONV, *[F.sum(f"_{name}").over(earlier).alias(f"_{name}") for name in sums]).filter(F.col(f"_{next(iter(sums))}").isNotNull())
    both = rows.join(F.broadcast(carried), ["_range", *CONV], "left")  # only a range's first conversation is carried: one row per range
    return both.select(*rows.columns, *[(F.sum(c).over(inside) + F.coalesce(F.col(f"_{name}"), F.lit(0))).alias(name) for name, c in sums.items()])


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formatted turns by row number, the same rows without text but with their place, key and parent's key)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("said"))
    made = rows.select(*CONV, "turn", format_turn(F.col("role"), F.col("said")).alias("text"), (F.char_length(_role(F.col("role"))) + len(OPEN) + 1).alias("head"), (F.col("role") == LEARNED_ROLE).alias("learned"))
    made = made.withColumn("digest", F.sha2("text", 256)).withColumn("n_chars", F.char_length("text").cast("long"))
    dealt = made.repartitionByRange(*CONV, "turn", "digest").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("row"))
    dealt = materialise(dealt, "chat-turns")
    bare = dealt.select("_range", "row", *CONV, "turn", "digest", "n_chars")
    placed = _running(bare, ["turn", "digest", "row"], {"nth": F.lit(1), "upto": F.col("n_chars")})
    placed = placed.withColumn("depth", (F.col("nth") - 1).cast("int")).withColumn("pos", F.col("upto") - F.col("n_chars"))
    hashed = placed
    for k in (0, 1):
        hashed = hashed.withColumn(f"h{k}", F.pmod(F.xxhash64(F.lit(k), "depth", "digest"), F.lit(PRIME)).cast("decimal(20,0)"))
    summed = _running(hashed, ["depth"], {"s0": F.col("h0"), "s1": F.col("h1")})

    def key(depth: Column, a: Column, b: Column) -> Column:
        return F.concat(*[F.lpad(F.hex((x % PRIME).cast("long")), n, "0") for x, n in ((depth, 8), (a, 16), (b, 16))])

    own, parent = key(F.col("depth"), F.col("s0"), F.col("s1")), key(F.col("depth") - 1, F.col("s0") - F.col("h0"), F.col("s1") - F.col("h1"))
    turns = summed.select("row", *CONV, "depth", "pos", "n_chars", "digest", own.alias("key"), F.when(F.col("depth") > 0, parent).alias("parent"))
    return dealt, materialise(turns, "chat-keys")


def _nodes(turns: DataFrame) -> DataFrame:
    """One row per distinct beginning: key, depth, pos, n_chars, shared, known, cid and row of one of its turns, and whether it is a head (no heavy child)."""
    found = turns.groupBy("key").agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.struct(*CONV, "row")).alias("of"), F.min("depth").alias("depth"), F.min("pos").alias("pos"), F.min("n_chars").alias("n_chars"), F.min("parent").alias("parent"),
        (F.min("digest") == F.max("digest")).alias("same"),
    )
    kept = F.when(F.col("same"), F.col("n_chars")).otherwise(F.raise_error(F.lit("two beginnings share a key")).cast("long"))
    found = materialise(found.select("key", "shared", "of.*", "depth", "pos", kept.alias("n_chars"), "parent"), "chat-nodes")
    heavy = found.filter("parent IS NOT NULL").groupBy("parent").agg(F.max(F.struct("shared", "key")).alias("best")).select(F.col("best.key").alias("key"), F.lit(True).alias("heavy"))
    return found.join(heavy, "key", "left").select("key", "shared", *CONV, "row", "depth", "pos", "n_chars", F.col("heavy").isNull().alias("head"))


def build(conversations: DataFrame) -> Forest:
    """Write the trees of ``conversations`` (conv_id, turn, role, text): segments in stream order, and the spans of each conversation."""
    dealt, turns = _turns(conversations)
    nodes, total = materialise(_nodes(turns), "chat-nodes"), turns.count()
    heads = nodes.filter("head").select("key", "shared", F.lit(True).alias("is_head"))
    passed = hot.join_groups(turns.select(*CONV, "depth", "pos", "n_chars", "key"), heads, ["key"], "shared", ["cid"], total)
    light = F.when(F.col("is_head"), F.struct("depth", "key", "shared"))
    convs = passed.groupBy(*CONV).agg((F.max("depth") + 1).cast("long").alias("n_turns"), F.max(F.col("pos") + F.col("n_chars")).alias("total_chars"), F.sort_array(F.collect_list(light)).alias("heads"))  # at most log2(conversations) + 1 heads
    convs = materialise(convs, "chat-heads")

    at = hot.join_groups(nodes, convs.select(*CONV, "n_turns", "heads"), CONV, "n_turns", ["key"], total)
    turned = F.transform(F.filter("heads", lambda h: h.depth <= F.col("depth")), lambda h: F.concat(F.lpad(F.hex(F.lit(0xFFFFFFFF) - h.depth), 8, "0"), F.substring(h.key, 9, 32)))
    pathed = at.select("key", F.array_join(turned, "").alias("path"), "depth", "pos", "n_chars", "shared", *CONV, "row", "head")
    order = materialise(running_totals(pathed, ["path", "depth"], {"end": F.col("n_chars")}).drop("path"), "chat-order").withColumn("start", F.col("end") - F.col("n_chars"))

    starts = order.filter("head").select("key", "shared", "start", "pos")
    asked = convs.select(*CONV, F.explode("heads").alias("h")).select(*CONV, F.col("h.depth").alias("depth"), F.col("h.key").alias("key"))
    placed = hot.join_groups(asked, starts, ["key"], "shared", ["cid"], total).groupBy(*CONV).agg(F.sort_array(F.collect_list(F.struct("depth", "start", "pos"))).alias("tops"))
    paths = convs.select(*CONV, "n_turns", "total_chars").join(placed, CONV)

    def span(top: Column, j: Column) -> Column:
        after = F.get("tops", j + 1)
        length = F.coalesce(after.pos, F.col("total_chars")) - top.pos
        return F.struct(top.start.alias("start"), (top.start + length).alias("end"), top.depth.alias("first_turn"), (F.coalesce(after.depth.cast("long"), F.col("n_turns")) - top.depth).alias("turns"))

    paths = materialise(paths.select(*CONV, "n_turns", F.col("total_chars").alias("n_chars"), F.transform("tops", span).alias("spans")), "chat-paths")

    seen = hot.join_groups(order.select("row", *CONV, "start", "n_chars", "pos", "depth", "shared"), paths.select(*CONV, "n_turns", "spans"), CONV, "n_turns", ["row"], total)
    upto = F.filter("spans", lambda s: s.first_turn <= F.col("depth"))
    own = F.element_at("upto", -1)
    attends = F.filter(F.transform("upto", lambda s: F.struct(s.start.alias("start"), F.least(s.end, F.when(s.start == own.start, F.col("start"))).alias("end"))), lambda s: s.start < s.end)
    seen = seen.withColumn("upto", upto).select("row", F.element_at("upto", 1).start.alias("tree"), "start", "n_chars", F.col("pos").alias("position"), F.col("depth").alias("turn"), own.start.alias("run"), "shared", attends.alias("attends"))
    text = dealt.select("row", "text", F.when(F.col("learned"), F.col("head")).otherwise(0).alias("loss_from"), F.when(F.col("learned"), F.char_length("text") - len(CLOSE)).otherwise(0).alias("loss_to"))
    segments = seen.join(text, "row").select("tree", "start", "n_chars", "position", "turn", "run", "shared", "text", "loss_from", "loss_to", "attends")
    return Forest(materialise(segments.repartitionByRange("start").sortWithinPartitions("start"), "chat-segments"), paths)


def turns_of(forest: Forest) -> DataFrame:
    """Each conversation's segments, found through its spans: known, cid, turn, position, text, loss_from, loss_to."""
    each = forest.paths.select(*CONV, F.explode("spans").alias("s")).select(*CONV, F.col("s.start").alias("run"), F.col("s.first_turn").alias("first"), F.col("s.turns").alias("turns"))
    some = each.select(*CONV, "run", "first", "turns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1, F.lit(RUN_TURNS).cast("long"))).alias("lo"))  # arrays stay short however long a conversation is
    within = F.sequence(F.col("first") + F.col("lo"), F.col("first") + F.least(F.col("lo") + RUN_TURNS, F.col("turns")) - 1).cast("array<int>")
    asked = some.select(*CONV, "run", F.explode(within).alias("turn"))
    held = forest.segments.select("run", "turn", "shared", "position", "text", "loss_from", "loss_to")
    total = int(forest.paths.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0])
    return hot.join_groups(asked, held, ["run", "turn"], "shared", ["cid"], total).select(*CONV, "turn", "position", "text", "loss_from", "loss_to")


class _Reader:
    """Digests of one conversation, turn by turn."""

    def __init__(self, known: bool, cid: int):
        self.of, self.n_turns, self.n_chars, self.loss_chars = (known, cid), 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, position: int, segment: str, loss_from: int, loss_to: int) -> None:
        if position != self.n_chars:
            raise ValueError(f"conversation {self.of} has a gap at {self.n_chars}")
        role, text = parse_turn(segment)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_to > loss_from:
            learned = unescape(segment[loss_from:loss_to])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learned)
        self.n_turns += 1
        self.n_chars += len(segment)

    def row(self) -> tuple:
        return (*self.of, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.n_chars)


def read_back(forest: Forest) -> DataFrame:
    """One row per conversation, from the written segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [x.strip().split(" ")[0] for x in READ.split(",")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for b in batches:
            done = []
            for known, cid, position, text, lo, hi in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), b.column(3), *(b.column(i).to_pylist() for i in (4, 5)), strict=True):
                if reader is None or reader.of != (known, cid):
                    done += [reader.row()] if reader else []
                    reader = _Reader(known, cid)
                reader.add(position, text.as_py(), lo, hi)
            if done:
                yield batch(done)
        if reader:
            yield batch([reader.row()])

    ordered = turns_of(forest).repartition(*CONV).sortWithinPartitions(*CONV, "turn").select(*CONV, "position", "text", "loss_from", "loss_to")
    read_rows = ordered.mapInArrow(read, READ)
    return read_rows.select(F.when(F.col("known"), F.col("cid")).alias("conv_id"), *names[2:])
