"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Conversations are sorted by the hashes of their turns over all partitions, so those with equal
initial turns lie side by side; each task walks its range and merges every conversation with the
one before it, turn by turn, comparing the turns themselves.  Trees are closed at a size bound, so
a first turn that a third of all conversations share is emitted once per tree, not gathered in one.

A tree's text is its nodes' text in depth-first order, every node once.  Tokens are code points.  A
node has the position id of its first token (the length of what its ancestors say) and the spans of
the text that its tokens may attend to besides its own: its ancestors', merged where they touch.

Template: ``<s>`` and, for each turn, ``[INST]role[/INST]text</s>``.  Backslashes are doubled and
control strings in roles and texts get a backslash after their first character, so no text can end
a turn and the escape can be undone.  The loss mask covers the texts of assistant turns.

Edge cases: a null role or text is an empty one; turns of equal number follow by role, then text;
null turn numbers come first; rows without conv_id form one conversation without id; repeated rows
are turns of their own; extra columns are ignored; no rows give no trees.  A conversation is one
sequence and therefore handled as one row, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and of common relatives.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)

#: Code points after which a tree is closed.
TREE_CHARS = 200_000

SPAN = "struct<start:int,stop:int>"
TREES = f"text string, nodes array<struct<start:int,stop:int,parent:int,position:int,attends:array<{SPAN}>>>, loss array<{SPAN}>, leaves array<struct<conv_id:bigint,node:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Tree:
    """Nodes in depth-first order: (start, stop, parent, position, attends)."""

    def __init__(self) -> None:
        self.parts, self.size = ["<s>"], 3
        self.nodes: list[tuple] = [(0, 3, -1, 0, [])]
        self.loss: list[tuple[int, int]] = []
        self.leaves: list[tuple[int | None, int]] = []
        self.turns: list[tuple[str, str]] = []
        self.way: list[int] = [0]

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.turns)) and turns[same] == self.turns[same]:
            same += 1
        del self.way[same + 1 :]
        for role, text in turns[same:]:
            head, body = f"[INST]{escape(role)}[/INST]", escape(text)
            start, parent = self.size, self.way[-1]
            above = self.nodes[parent]
            attends = [*above[4]]
            if attends and attends[-1][1] == above[0]:
                attends[-1] = (attends[-1][0], above[1])
            else:
                attends.append((above[0], above[1]))
            self.parts += [head, body, "</s>"]
            self.size += len(head) + len(body) + 4
            if role == "assistant":
                self.loss.append((start + len(head), start + len(head) + len(body)))
            self.way.append(len(self.nodes))
            self.nodes.append((start, self.size, parent, above[3] + above[1] - above[0], attends))
        self.turns = turns
        self.leaves.append((conv_id, self.way[-1]))

    def row(self) -> dict:
        span = lambda x: {"start": x[0], "stop": x[1]}
        return {
            "text": "".join(self.parts),
            "nodes": [{"start": a, "stop": b, "parent": p, "position": at, "attends": [span(x) for x in seen]} for a, b, p, at, seen in self.nodes],
            "loss": [span(x) for x in self.loss],
            "leaves": [{"conv_id": c, "node": k} for c, k in self.leaves],
        }


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_TREES = pa.schema(
    [
        ("text", pa.string()),
        ("nodes", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(_SPAN))]))),
        ("loss", pa.list_(_SPAN)),
        ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
    ]
)


def trees(rows: DataFrame, tree_chars: int = TREE_CHARS) -> DataFrame:
    """Prefix trees of ``rows`` (conv_id, turn, role, text): rows of ``TREES``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.withColumn("path", F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"])))
    dealt = talks.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").drop("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for batch in batches:
            for conv, turns in zip(*(batch.column(i) for i in range(2))):
                tree.add(conv.as_py(), [(x["role"], x["text"]) for x in turns.as_py()])
                if tree.size >= tree_chars:
                    yield pa.RecordBatch.from_pylist([tree.row()], _TREES)
                    tree = Tree()
        if tree.leaves:
            yield pa.RecordBatch.from_pylist([tree.row()], _TREES)

    return dealt.mapInArrow(run, TREES)


def unroll(tree: dict) -> Iterator[tuple[int | None, str, list[tuple[str, str]], list[str]]]:
    """Per leaf of a row of ``trees``: conv_id, formatted text, turns, texts under the loss mask."""
    text, nodes = tree["text"], tree["nodes"]
    masked = sorted((x["start"], x["stop"]) for x in tree["loss"])
    by_node: dict[int, list[tuple[int, int]]] = {}
    k = 0
    for i, node in enumerate(nodes):  # nodes and masked spans both follow the text
        while k < len(masked) and masked[k][0] < node["stop"]:
            by_node.setdefault(i, []).append(masked[k])
            k += 1
    for leaf in tree["leaves"]:
        node = nodes[leaf["node"]]
        whole = "".join([*(text[x["start"] : x["stop"]] for x in node["attends"]), text[node["start"] : node["stop"]]])
        turns = [(unescape(a), unescape(b)) for a, b in _TURN.findall(whole)]
        way, at = [], leaf["node"]
        while at >= 0:
            way.append(at)
            at = nodes[at]["parent"]
        loss = [unescape(text[a:b]) for i in reversed(way) for a, b in by_node.get(i, ())]
        yield leaf["conv_id"], whole, turns, loss


def digests(made: DataFrame) -> DataFrame:
    """One row of digests per conversation, read back from its tree."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.to_pylist():
                out = []
                for conv, whole, turns, loss in unroll(tree):
                    said = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                    under = "".join(loss)
                    out.append((conv, len(turns), hashlib.sha256(said).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(whole)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
