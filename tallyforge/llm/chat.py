"""Reply trees to training conversations: paths by self-joins, branches by score, one text per path.

The template marks each turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end.
``<|`` cannot occur inside a turn: it is written with one backslash more between its characters, as is every
``<``, backslashes, ``|`` already there, so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.*?))<\|im_end\|>\n")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    """As a text, and line ends are written as a backslash and an n, so that a role is one line."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def with_jumps(nodes: DataFrame) -> list[DataFrame]:
    """Pointer doubling: the k-th frame maps a node to its ancestor 2**k steps up, with the score summed over
    the 2**k nodes passed. There are as many frames as doublings until no node has such an ancestor; each is a
    self-join of the one before, written to the shared folder."""
    jump = staged(nodes.where(F.col("parent_id").isNotNull()).select("node_id", F.col("parent_id").alias("up"), "score"), "jump")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        further = jump.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"))
        doubled = jump.join(further, "up").select("node_id", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"))
        jump = staged(doubled, "jump")
    return jumps


def root_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes of the best root-to-leaf paths of each tree: ``tree_id, path_rank, depth, node_id``.

    ``nodes`` has ``tree_id, node_id, parent_id, score``. Leaves are nodes nobody replies to. A branch's score
    is the sum over its nodes (null counts 0); ties go to the smaller leaf id. The best ``branches`` leaves of
    each tree are kept (a top-k, the feature). Then the doubled self-joins are run downwards from the longest
    jump, so a path of n nodes takes log n joins. A parent that does not exist makes its child a root.
    """
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("parent_known"))
    nodes = nodes.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    nodes = nodes.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("parent_known"), F.col("parent_id")))
    nodes = staged(nodes.select("tree_id", "node_id", "parent_id", "score"), "nodes")
    jumps = with_jumps(nodes)
    answered = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()
    reach = nodes.join(answered, "node_id", "left_anti").select(
        "tree_id", F.col("node_id").alias("leaf_id"), F.col("node_id").alias("at"), F.col("score").alias("own"), F.lit(0.0).alias("total")
    )
    for jump in reversed(jumps):  # climb by falling powers of two: each leaf arrives at its root
        up = jump.select(F.col("node_id").alias("at"), F.col("up"), F.col("score").alias("passed"))
        reach = reach.join(up, "at", "left").select(
            "tree_id", "leaf_id", F.coalesce("up", "at").alias("at"), "own",
            (F.col("total") + F.coalesce("passed", F.lit(0.0))).alias("total"),
        )
    root = nodes.select(F.col("node_id").alias("at"), F.col("score").alias("root_score"))
    scored = reach.join(root, "at").withColumn("total", F.col("total") + F.col("root_score"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), "leaf_id")
    chosen = scored.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= branches)
    path = chosen.select("tree_id", "path_rank", F.col("leaf_id").alias("node_id"), F.lit(0).alias("above"))
    for k, jump in reversed(list(enumerate(jumps))):
        higher = path.join(jump, "node_id").select("tree_id", "path_rank", F.col("up").alias("node_id"), (F.col("above") + F.lit(1 << k)).alias("above"))
        path = staged(path.unionByName(higher), "path")  # read twice by the next round
    return path


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: ``tree_id, path_rank, formatted, loss_spans`` (code points, end exclusive).

    ``messages`` has ``node_id, role, text``; null role or text is empty. A conversation is one row and is
    built in one task; that is its size, not the table's.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = messages.select("node_id", head.alias("head"), escape(text).alias("body"), (role == LOSS_ROLE).alias("loss"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    turn = F.struct((-F.col("above")).alias("place"), "turn", F.length("head").alias("n_head"), F.length("body").alias("n_body"), "loss")
    rows = paths.join(turns, "node_id").groupBy("tree_id", "path_rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["n_head"]
        span = F.struct(start.alias("start"), (start + x["n_body"]).alias("end"))
        spans = F.when(x["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(x["turn"])).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return rows.select(
        "tree_id",
        "path_rank",
        F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.aggregate("turns", none, add)["spans"].alias("loss_spans"),
    )


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the best branches of reply trees: ``tree_id, path_rank, formatted, loss_spans``.

    ``messages`` has ``tree_id, node_id, parent_id, role, text, score``; ``node_id`` is unique and does not
    change between reads. Other columns
    are ignored. Empty table: no rows. Null ``tree_id`` is a tree of its own.
    """
    return format_paths(root_paths(messages, branches), messages)


def linear_messages(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows as messages: each replies to the one before it by turn. Rows with the
    same turn are ordered by role and text; repeated rows are turns of their own. Rows are numbered and written
    once, so that ids are short and stay the same."""
    numbered = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("node_id"))
    numbered = staged(numbered, "messages")
    before = F.lag("node_id").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node_id"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", before.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns and masked text with their digests."""
    names = [part.split()[0] for part in READ_BACK.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, whole, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_turns(whole)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(whole[s["start"] : s["end"]]) for s in spans)
                hexes = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
                rows.append((tree, len(turns), hexes[0], len(loss), hexes[1], len(whole)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.select(F.col("tree_id").cast("long"), "formatted", "loss_spans").mapInArrow(digest, READ_BACK)
