"""Chat formatting of many conversations as packed prefix trees.

A node of the trees is a turn after the turns before it; conversations that begin alike
share nodes. Every node is written once, whatever the number of conversations that
share it: a node that more than ``PACK`` conversations share is a pack of its own; below
those, whole subtrees of one parent are gathered into packs of about ``PACK``
conversations, depth-first. A node has the position of its first token in its own
conversation, the intervals that its tokens may attend to besides what precedes them in
the node (those of its ancestors, in its own pack and in the packs above it, joined
where they touch), and the intervals of its loss mask. Tokens here are code points,
which any tokenizer can refine.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash goes between ``<`` and ``|`` (and one more where some already stand
there), so no control string is left and the change can be undone; line feeds in
roles are escaped likewise. The loss mask covers the texts of assistant turns.

Turns are in order of (turn, role, text), null first, so ties have one order; null roles
and texts are empty. Rows that repeat are turns of their own, and conversations that are
equal are formatted once. A row without a conv_id is a conversation of its own. A table
without rows gives no packs; columns other than the four are not looked at. A
conversation is held by one task, as a document is, and may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datamill.llm._arrow import small_batches
from datamill.tables import materialize

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Conversations in a pack, about.
PACK = 256

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

SPAN = "struct<pack:string,start:long,end:long>"
NODE = f"struct<start:long,end:long,position:long,ancestors:array<{SPAN}>,loss:array<struct<start:long,end:long>>>"
#: trunk: the packs of single nodes above all nodes of this one, from the first turn on.
PACKS = f"pack string, trunk array<{SPAN}>, text string, nodes array<{NODE}>, leaves array<struct<conv_key:string,node:int>>"

def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def formatted_turn(role: str, said: str) -> tuple[str, int, int]:
    """The text of a turn, and where in it the loss mask of an assistant's turn begins and ends."""
    head, body = f"{START}{escape_role(role)}{MIDDLE}", escape(said)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, keys, lengths, conv_key) of each of ``conversations`` (conv_id, turn, role, text).

    A key is a digest of a turn and all before it, a length that of the formatted turn; conv_key is the last key.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.groupBy("conv_id", own.alias("own")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    turns = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    small_batches(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = [], []
            for conversation in batch.column(1).to_pylist():
                key, mine = b"", []
                for t in conversation:
                    role, text = (t[x].encode("utf-8", "replace") for x in ("role", "text"))
                    key = hashlib.sha256(b"%b%d %d %b%b" % (key, len(role), len(text), role, text)).digest()
                    mine.append(key.hex())
                keys.append(mine)
                lengths.append([len(formatted_turn(t["role"], t["text"])[0]) for t in conversation])
            added = [pa.array(keys, pa.list_(pa.string())), pa.array(lengths, pa.list_(pa.int64())), pa.array([k[-1] for k in keys], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["conv_id", "turns", "keys", "lengths", "conv_key"])

    schema = f"conv_id {kind}, turns array<struct<role:string,text:string>>, keys array<string>, lengths array<long>, conv_key string"
    return rows.select("conv_id", turns.alias("turns")).mapInArrow(run, schema)


def packs(turns: DataFrame, pack: int = PACK) -> DataFrame:
    """PACKS rows of the different conversations of ``turns`` (as ``gathered`` gives them)."""
    different = materialize(
        turns.groupBy("conv_key").agg(F.first("turns").alias("turns"), F.first("keys").alias("keys"), F.first("lengths").alias("lengths")), "conversations"
    )
    steps = different.select("conv_key", F.posexplode("keys").alias("at", "key"))
    common = steps.groupBy("key").count().where(F.col("count") > pack).select("key")
    above = materialize(steps.join(common, "key"), "common-turns")
    depth = above.groupBy("conv_key").agg((F.max("at") + 1).alias("depth"))
    placed = (
        different.select("conv_key", "keys").join(depth, "conv_key", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        .select("conv_key", "depth", F.when(F.col("depth") > 0, F.get("keys", F.col("depth") - 1)).otherwise("").alias("parent"), F.get("keys", F.col("depth")).alias("root"))
        .where("root is not null")
    )
    slots = placed.groupBy("parent").agg(F.ceil(F.count("*") / pack).alias("slots"))
    slot = F.pmod(F.xxhash64("root"), F.col("slots")).cast("string")
    dealt = placed.join(slots, "parent").select("conv_key", "depth", F.concat_ws("/", "parent", slot).alias("pack"))
    trunk = lambda upto: F.transform(
        F.slice("keys", F.lit(1), upto), lambda k, i: F.struct(k.alias("pack"), F.lit(0).cast("long").alias("start"), F.get("lengths", i).alias("end"))
    )
    below = different.join(dealt, "conv_key").select(
        "pack", "conv_key", trunk(F.col("depth")).alias("trunk"), F.expr("slice(turns, depth + 1, size(turns) - depth)").alias("turns")
    )
    written = above.groupBy("key").agg(F.min(F.struct("conv_key", "at")).alias("from")).select("key", "from.*")
    # A turn that many share is written from one of their conversations; some conversation may end with it.
    single = different.join(written, "conv_key").select(
        F.col("key").alias("pack"), "key", trunk(F.col("at")).alias("trunk"), F.slice("turns", F.col("at") + 1, 1).alias("turns")
    )
    ends = different.select(F.col("conv_key").alias("key"), F.col("conv_key").alias("ends"))
    single = single.join(ends, "key", "left").select("pack", F.coalesce("ends", F.lit("")).alias("conv_key"), "trunk", "turns")
    return below.unionByName(single).groupBy("pack").applyInPandas(write_pack, PACKS)


def joined(spans: list[dict], span: dict) -> list[dict]:
    """``spans`` and one more, as one interval with the last where they touch."""
    if spans and spans[-1]["pack"] == span["pack"] and spans[-1]["end"] == span["start"]:
        return [*spans[:-1], {**spans[-1], "end": span["end"]}]
    return [*spans, span]


def write_pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One pack: the prefix trees of its conversations (conv_key, empty for none; trunk; turns), depth-first."""
    pack, trunk = str(rows["pack"].iloc[0]), [dict(x) if isinstance(x, dict) else x.asDict() for x in rows["trunk"].iloc[0]]
    tree: dict = {}
    for key, turns in sorted(zip(rows["conv_key"], rows["turns"]), key=lambda x: x[0]):
        at = tree
        for t in turns:
            at = at.setdefault((t["role"], t["text"]), {})
        if key:
            at.setdefault(None, []).append(key)
    text, nodes, leaves, written = [], [], [], 0
    stack = [(turn, child, trunk, sum(x["end"] - x["start"] for x in trunk)) for turn, child in reversed(tree.items())]
    while stack:
        (role, said), children, ancestors, position = stack.pop()
        whole, low, high = formatted_turn(role, said)
        start, end = written, written + len(whole)
        loss = [{"start": start + low, "end": start + high}] if role == ASSISTANT else []
        text.append(whole)
        written = end
        nodes.append({"start": start, "end": end, "position": position, "ancestors": ancestors, "loss": loss})
        leaves += [{"conv_key": k, "node": len(nodes) - 1} for k in children.pop(None, [])]
        below = joined(ancestors, {"pack": pack, "start": start, "end": end})
        stack += [(turn, child, below, position + end - start) for turn, child in reversed(children.items())]
    return pd.DataFrame({"pack": [pack], "trunk": [trunk], "text": ["".join(text)], "nodes": [nodes], "leaves": [leaves]})


def format_conversations(conversations: DataFrame, pack: int = PACK) -> DataFrame:
    """The packs of all ``conversations`` (conv_id, turn, role, text)."""
    return packs(materialize(gathered(conversations), "turns"), pack)


def with_trunks(written: DataFrame) -> DataFrame:
    """``written`` (PACKS) with ``above``: the text and the loss mask of each pack of its trunk, in order."""
    refs = written.select("pack", F.posexplode("trunk").alias("at", "ref")).select("pack", "at", F.col("ref.pack").alias("key"))
    loss = F.transform(F.flatten(F.col("nodes.loss")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    texts = refs.select("key").distinct().join(written.select(F.col("pack").alias("key"), "text", loss.alias("loss")), "key")
    above = refs.join(texts, "key").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "text", "loss"))).alias("above"))
    return written.join(above, "pack", "left")


class PackReader:
    """Reads conversations back from a pack and what its trunk holds (above)."""

    def __init__(self, pack: str, text: str, nodes: list[dict], above: list[dict] | None):
        self.pack, self.text, self.nodes = pack, text, nodes
        self.starts = [n["start"] for n in nodes]
        self.head = "".join(x["text"] for x in above or [])
        self.head_loss = "".join(unescape(x["text"][s["start"] : s["end"]]) for x in above or [] for s in x["loss"])
        self.head_turns = [t for x in above or [] for t in turns_of(x["text"])]

    def read(self, leaf: int) -> tuple[str, str, list[tuple[str, str]]]:
        """A conversation's formatted text, the text under its loss mask, its turns."""
        node = self.nodes[leaf]
        spans = [s for s in node["ancestors"] if s["pack"] == self.pack] + [{"start": node["start"], "end": node["end"]}]
        own = "".join(self.text[s["start"] : s["end"]] for s in spans)
        path = (n for s in spans for n in self.nodes[bisect_left(self.starts, s["start"]) : bisect_left(self.starts, s["end"])])
        loss = "".join(unescape(self.text[x["start"] : x["end"]]) for n in path for x in n["loss"])
        return self.head + own, self.head_loss + loss, self.head_turns + turns_of(own)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(said)) for role, said in _TURN.findall(formatted)]
