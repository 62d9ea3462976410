"""Conversations from messages that quote each other.

Leading > marks give every line's quote level. A run of quoted lines of one level is a passage; its normalised text is hashed and
joined to the messages that contain that text as their own. The shallowest passage that is found names the parent. Parents are
followed to the first message, and the message's own lines, without quotes, are what remains.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import table
from tidemark.session import materialize

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"\s*On .{1,200} wrote:\s*$")
_GAP = re.compile(r"\n[ \t]*\n")
BUCKET = 4096  # positions of a thread in which one task looks for the last message with a text


def passage_hash(text: str) -> int | None:
    """A number for the passage without regard to case and white space; None for a blank one."""
    words = text.lower().split()
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if words else None


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text and its quoted passages (level, text), in order.

    Blank lines at the edges of the own text go, as does a line "On ... wrote:" right before a quote.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group(1).count(">") if marks else 0
        if level == 0:
            own.append(line)
        else:
            if last == 0 and own and _ATTRIBUTION.match(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[marks.end() :])
        last = level
    while own and not own[-1].strip():
        own.pop()
    while own and not own[0].strip():
        own.pop(0)
    return "\n".join(own), [(level, "\n".join(lines)) for level, lines in passages]


def units(text: str) -> tuple[list[str], list[str]]:
    """The lines and the paragraphs of a text that are not blank."""
    return tuple([u for u in parts if u.strip()] for parts in (text.split("\n"), _GAP.split(text)))


def _parse(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hashes, quotes = [], [], []
            for text in batch.column("text").to_pylist():
                mine, passages = split_quotes(text or "")
                own.append(mine)
                # the whole text, and each of its paragraphs if there are several
                parts = {passage_hash(p) for p in [mine, *_GAP.split(mine)]}
                hashes.append(sorted(h for h in parts if h is not None))
                found = [(level, h, *map(len, units(t))) for level, t in passages if (h := passage_hash(t)) is not None]
                quotes.append([dict(zip(("level", "hash", "lines", "paragraphs"), q)) for q in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(own, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("lines", pa.int32()), ("paragraphs", pa.int32())])))],
                names + ["own_text", "own_hashes", "quotes"],
            )

    return run


def _runs(lengths: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes = [], []
            for i, text in enumerate(batch.column("own_text").to_pylist()):
                mine = set()
                for parts, wanted in zip(units(text), lengths):
                    for n in wanted:
                        mine.update(passage_hash("\n".join(parts[k : k + n])) for k in range(len(parts) - n + 1))
                row.extend([i] * len(mine))
                hashes.extend(mine)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("thread").take(at), batch.column("position").take(at), pa.array(hashes, pa.int64())], ["thread", "position", "hash"]
            )

    return run


def own_runs(placed: DataFrame) -> DataFrame:
    """(thread, position, hash): runs of lines and of paragraphs of the own texts, of the lengths that some passage has."""
    quoted = placed.select(F.explode("quotes").alias("q"))
    lengths = [sorted(r[0] for r in quoted.select(f"q.{c}").distinct().toLocalIterator()) for c in ("lines", "paragraphs")]
    kind = placed.schema["thread"].dataType.simpleString()
    return placed.select("thread", "position", "own_text").mapInArrow(_runs(lengths), f"thread {kind}, position long, hash long")


def last_before(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``found``: the largest position in ``known`` (thread, hash, position) below the position of ``wanted`` (thread, hash, position).

    Positions are cut into buckets. Inside a bucket a window looks back; the bucket before is looked up in one row per bucket. So
    a text that a thread repeats again and again never gathers in one task.
    """
    bucket = F.floor(F.col("position") / BUCKET)
    marks = known.groupBy("thread", "hash", "position").agg(F.lit(True).alias("mark")).withColumn("bucket", bucket)
    asked = wanted.select("thread", "hash", "position").distinct().withColumns({"bucket": bucket, "mark": F.lit(False)})
    both = marks.select("thread", "hash", "position", "bucket", "mark").unionByName(asked)
    before = Window.partitionBy("thread", "hash", "bucket").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("mark"), F.col("position"))).over(before)).where(~F.col("mark"))
    tops = both.groupBy("thread", "hash", "bucket").agg(F.max(F.when(F.col("mark"), F.col("position"))).alias("top"))
    earlier = Window.partitionBy("thread", "hash").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("far", F.max("top").over(earlier)).select("thread", "hash", "bucket", "far")
    found = near.join(tops, ["thread", "hash", "bucket"]).select("thread", "hash", "position", F.coalesce("near", "far").alias("found"))
    return wanted.join(found, ["thread", "hash", "position"])


def roots(parents: DataFrame) -> DataFrame:
    """(thread, position, parent) -> (thread, position, root, depth), by pointer jumping: a chain of n messages takes log2 n rounds."""
    state = parents.select("thread", "position", F.coalesce("parent", "position").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = materialize(state.withColumn("done", F.col("depth") == 0))
    while not state.where(~F.col("done")).isEmpty():
        up = state.select("thread", F.col("position").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        open_ = state.where(~F.col("done")).join(up, ["thread", "root"])
        moved = open_.select("thread", "position", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        state = materialize(state.where("done").unionByName(moved))
    return state.select("thread", "position", "root", "depth")


def conversations(messages: DataFrame, thread: str | None = "thread", position: str = "position", text: str = "text") -> DataFrame:
    """One row per input row: its columns, own_text, n_quotes, parent, root and depth.

    A message's parent is the last earlier message of the same thread whose own text, or a run of its lines or paragraphs, is the
    shallowest quoted passage that any message has. For mail without thread ids ``thread`` is None: all messages are searched, in
    the order of ``position``, which then tells messages apart. Ordering by (thread, root, depth, position) gives the conversations in reply order;
    root and parent are positions. A message without a found quote starts a conversation. Null or empty texts have no own text
    and quote nothing. Repeated rows and rows that share a position get the same parent each (of different texts, the
    shallowest and then the latest). Rows with a null thread or position stay alone, with null root and depth 0.
    """
    reserved = ["own_text", "own_hashes", "quotes", "n_quotes", "parent", "root", "depth"]
    names = [c for c in messages.columns if c != text and c not in reserved]
    kinds = ", ".join(f"`{n}` {t}" for n, t in messages.select(*names).dtypes)
    rows = messages.select(*names, F.col(text).alias("text")).mapInArrow(
        _parse(names), f"{kinds}, own_text string, own_hashes array<long>, quotes array<struct<level:int,hash:long,lines:int,paragraphs:int>>"
    )
    key = F.lit(0) if thread is None else F.col(thread)
    placed = rows.where(key.isNotNull() & F.col(position).isNotNull()).select(
        key.alias("thread"), F.col(position).cast("long").alias("position"), "own_text", "own_hashes", "quotes"
    )
    placed = materialize(placed)
    known = placed.select("thread", "position", F.explode("own_hashes").alias("hash")).union(own_runs(placed))
    wanted = placed.select("thread", "position", F.explode("quotes").alias("q")).select("thread", "position", "q.level", "q.hash").distinct()
    linked = last_before(wanted, known).where("found is not null")
    best = linked.groupBy("thread", "position").agg(F.min(F.struct("level", (-F.col("found")).alias("minus"))).alias("best"))
    parents = placed.select("thread", "position").distinct().join(best, ["thread", "position"], "left")
    parents = materialize(parents.select("thread", "position", (-F.col("best.minus")).alias("parent")))
    out = roots(parents).join(parents, ["thread", "position"]).select(F.col("thread").alias("_t"), F.col("position").alias("_p"), "parent", "root", "depth")
    joined = rows.join(out, (key == F.col("_t")) & (F.col(position).cast("long") == F.col("_p")), "left")
    return joined.select(*names, "own_text", F.size("quotes").cast("long").alias("n_quotes"), "parent", "root", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def quoted_mail(spark, sf_dir: str, levels: int = 2) -> DataFrame:
    """The turns of ``conversations`` as mail: each message ends with the turns before it, quoted one level deeper each."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text"))
    before = turns.groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    body = F.coalesce("text", F.lit(""))
    out = turns
    for level in range(1, levels + 1):
        mark = "> " * level
        quoted = F.concat(F.lit(mark), F.regexp_replace(body, "\n", "\n" + mark))
        quoted = F.concat(F.lit("\n\nOn turn ") if level == 1 else F.lit("\n"), F.concat(F.col("turn").cast("string"), F.lit(" " ), F.coalesce("role", F.lit("someone")), F.lit(" wrote:\n")) if level == 1 else F.lit(""), quoted)
        earlier = before.select("conv_id", (F.col("turn") + level).alias("turn"), quoted.alias(f"quoted_{level}"))
        out = out.join(earlier, ["conv_id", "turn"], "left")
    message = F.concat(F.coalesce("text", F.lit("")), *[F.coalesce(f"quoted_{i}", F.lit("")) for i in range(1, levels + 1)])
    return out.select("conv_id", "turn", "role", message.alias("text"))
