"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Conversations are sorted by their turns. In that order a conversation differs from its forerunner in its last turns only,
and writing just those gives every tree depth-first. A turn is a node: its tokens, their place in the sequence, the
position id of the first one (its place on the way from the root), and the intervals of the sequence that its ancestors
fill, which is what its tokens may attend to besides themselves. Neighbouring intervals are merged.

A sequence holds one tree or a part of one: beyond ``max_tokens`` tokens or ``max_conversations`` conversations, and where
a task's share ends, the next sequence begins by writing the shared turns again. So no task needs more than one path in
memory and a first turn that a third of all conversations share is split over tasks.

Template: a turn is ``<s>[INST] role [/INST]``, a line feed, the text, ``</s>`` and a line feed. Inside roles and texts a
backslash is doubled, and a control string gets a backslash after its first character, so that none is left.

Defined cases: null roles and texts count as ''. Turns are ordered by number, role and text, null first; turns with one
number all stay. Rows with a null conversation are one conversation. Repeated conversations share all nodes and keep a row
each. A conversation is held whole. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankloom.staging import stage

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
TRAINED_ROLE = "assistant"
PARTITION_BITS = 36
# Characters from which a text is encoded in parts.
ENCODE_CHARS = 1 << 15


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What comes before the text, the text, and what comes after it."""
    return f"<s>[INST] {escape(role)} [/INST]\n", escape(text), "</s>\n"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


class ByteTokens:
    """Byte-level token ids of a vocabulary file with one base64 token and its rank per line; decoding is exact."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.encoding.encode_ordinary(part)]

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts that end where a pre-token ends, so that its ids are those of the whole text."""
        begin = 0
        if len(text) > ENCODE_CHARS:
            for piece in self.pattern.finditer(text):
                if piece.end() - begin >= ENCODE_CHARS:
                    yield text[begin:piece.end()]
                    begin = piece.end()
        yield text[begin:]

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``id, turns, path``: turns in order, and a hash of each turn to sort by."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("given_role"), F.col(text).alias("given_text"),
                     blank(role).alias("role"), blank(text).alias("text"))
    return (rows.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("sorted"))
            .select("id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns"))
            .withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))))


SCHEMA = ("sequence_id bigint, ordinal bigint, depth int, start bigint, position bigint, ids binary, loss_start int, "
          "loss_end int, attends array<struct<start:bigint,end:bigint>>")


def merged(intervals: list[list[int]], start: int, end: int) -> list[list[int]]:
    """The intervals and one more behind them."""
    if intervals and intervals[-1][1] == start:
        return [*intervals[:-1], [intervals[-1][0], end]]
    return [*intervals, [start, end]]


def write_trees(convs: Iterator[tuple[object, list[tuple[str, str]]]], tokens: ByteTokens, first_id: int, max_tokens: int,
                max_conversations: int) -> Iterator[dict]:
    """Rows of nodes and conversations, in order, for conversations that come sorted."""
    stack: list[dict] = []
    sequence, ordinal, used, members = first_id - 1, 0, 0, 0
    for name, turns in convs:
        shared = 0
        while shared < min(len(stack), len(turns)) and stack[shared]["turn"] == turns[shared]:
            shared += 1
        if not shared or used >= max_tokens or members >= max_conversations:
            sequence, ordinal, used, members, shared = sequence + 1, 0, 0, 0, 0
        del stack[shared:]
        for depth in range(shared, len(turns)):
            before, text, after = map(tokens.encode, format_turn(*turns[depth]))
            ids = np.array([*before, *text, *after], dtype="<u4")
            above = stack[-1] if stack else {"path": [], "position": 0, "length": 0}
            trained = turns[depth][0] == TRAINED_ROLE
            node = {"sequence_id": sequence, "ordinal": ordinal, "depth": depth, "start": used,
                    "position": above["position"] + above["length"], "ids": ids.tobytes(),
                    "loss_start": len(before) if trained else 0, "loss_end": len(before) + len(text) if trained else 0,
                    "attends": above["path"], "id": None, "leaf": False}
            yield node
            stack.append({"turn": turns[depth], "path": merged(above["path"], used, used + len(ids)),
                          "position": node["position"], "length": len(ids)})
            used, ordinal = used + len(ids), ordinal + 1
        yield {"sequence_id": sequence, "ordinal": ordinal, "depth": len(turns), "start": None, "position": None,
               "ids": None, "loss_start": None, "loss_end": None, "attends": stack[-1]["path"] if stack else [],
               "id": name, "leaf": True}
        ordinal, members = ordinal + 1, members + 1


def chat_trees(convs: DataFrame, tokenizer_path: str, pattern: str, max_tokens: int = 1 << 18,
               max_conversations: int = 4096) -> DataFrame:
    """Nodes (``leaf`` false) with their tokens, and a row per conversation (``leaf`` true) with ``id``, the number of its
    turns as ``depth`` and the intervals of its sequence that make it up."""
    kind = convs.schema["id"].dataType.simpleString()
    sort = ("path", "id")
    ordered = stage(convs, "conversations").repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = f"{SCHEMA}, id {kind}, leaf boolean"
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = pa.schema([("sequence_id", pa.int64()), ("ordinal", pa.int64()), ("depth", pa.int32()),
                         ("start", pa.int64()), ("position", pa.int64()), ("ids", pa.binary()),
                         ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attends", interval),
                         ("id", to_arrow_type(convs.schema["id"].dataType)), ("leaf", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(tokenizer_path, pattern)
        incoming = ((name, [(t["role"], t["text"]) for t in turns]) for batch in batches
                    for name, turns in zip(batch.column("id").to_pylist(), batch.column("turns").to_pylist()))
        rows, held = [], 0
        for row in write_trees(incoming, tokens, TaskContext.get().partitionId() << PARTITION_BITS, max_tokens,
                               max_conversations):
            row["attends"] = [{"start": a, "end": b} for a, b in row["attends"]]
            rows.append(row)
            held += len(row["ids"] or b"")
            if len(rows) >= 5000 or held >= 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=columns)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=columns)

    return ordered.select("id", "turns").mapInArrow(run, schema)


def read_conversations(trees: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Each conversation back from the tokens: ``id, formatted, turns, trained``.

    ``turns`` are parsed from the formatted text; ``trained`` has the unescaped texts under the loss mask, in order. A
    sequence streams by in its order, so a task holds the nodes of one sequence.
    """
    kind = trees.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(tokenizer_path, pattern)
        current, nodes = None, {}
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["sequence_id"] != current:
                    current, nodes = row["sequence_id"], {}
                if not row["leaf"]:
                    ids = np.frombuffer(row["ids"], "<u4")
                    loss = unescape(tokens.decode(ids[row["loss_start"]:row["loss_end"]]))
                    nodes[row["start"]] = (row["start"] + len(ids), tokens.decode(ids), loss,
                                           row["loss_end"] > row["loss_start"])
                    continue
                pieces, trained = [], []
                for interval in row["attends"]:
                    at = interval["start"]
                    while at < interval["end"]:
                        at, text, loss, has_loss = nodes[at]
                        pieces.append(text)
                        if has_loss:
                            trained.append(loss)
                formatted = "".join(pieces)
                out.append({"id": row["id"], "formatted": formatted, "trained": trained,
                            "turns": [{"role": r, "text": t} for r, t in parse_turns(formatted)]})
                held += len(formatted)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=columns)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=columns)

    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    columns = pa.schema([("id", to_arrow_type(trees.schema["id"].dataType)), ("formatted", pa.string()),
                         ("turns", pa.list_(turn)), ("trained", pa.list_(pa.string()))])
    order = ("sequence_id", "ordinal")
    return (trees.repartition("sequence_id").sortWithinPartitions(*order)
            .mapInArrow(run, f"id {kind}, formatted string, turns array<struct<role:string,text:string>>, "
                             "trained array<string>"))
