"""Chat formatting in budgeted windows with a loss mask.

Turns become ``<|role|>\\n text \\n<|end|>\\n``; ``&``, ``<`` and ``[`` inside texts and roles,
and ``|`` inside roles, are escaped, so no control string (``<|..|>``, ``</s>``, ``[INST]``) can occur in them, and
unescaping gives the texts back. A conversation's windows are turn-aligned spans chosen by
prefix sums of turn tokens: a window takes turns while the sum since its first stays within
the budget. Each later window repeats the system turn and as many last turns as fit the
history allowance; what it repeats is masked, so each assistant text is a target once.

Rows of a conversation are sorted, not gathered: a task streams through them and holds one
window. Defined cases: null texts and roles are empty; null conv_id is a conversation of its
own; equal turn numbers are ordered by role, then text; repeated rows are repeated turns; a
turn larger than the budget, however long, makes a window of its own; other columns are not
looked at; an empty table has no windows. Tokens are those of a public tokenizer where its
file is given, else words and marks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import encoder
from lectern.runtime import ship

BUDGET, HISTORY = 2048, 256
_TURN = re.compile(r"<\|([^<]*?)\|>\n([^<]*)\n<\|end\|>\n")
_PIECES = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def escape_role(role: str) -> str:
    """A role that can also not end its own tag."""
    return escape(role).replace("|", "&#124;")


def unescape(text: str) -> str:
    return text.replace("&#124;", "|").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def count_tokens(text: str) -> int:
    """Words and marks, and the template's own four."""
    return len(_PIECES.findall(text)) + 4


def format_window(repeated: list, new: list) -> tuple[str, list[dict]]:
    """Formatted text and the [start, end) spans of it that are targets."""
    out, mask, at = [], [], 0
    for k, (role, text) in enumerate(repeated + new):
        head, body = f"<|{escape_role(role)}|>\n", escape(text)
        if k >= len(repeated) and role == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body}\n<|end|>\n")
        at += len(out[-1])
    return "".join(out), mask


def windows(turns: Iterable[tuple], budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_tokens) -> Iterator[tuple]:
    """(conv_id, window, n_repeated, repeated turns, new turns) from sorted (conv_id, role, text)."""
    conv, system, new, tail, total, number, begun = None, [], [], [], 0, 0, False

    def shut() -> tuple:
        return conv, number, len(tail), [x[:2] for x in tail], [x[:2] for x in new]

    for c, role, text in turns:
        turn = (role, text, tokens(text))
        if not begun or c != conv:
            if new:
                yield shut()
            conv, begun, new, tail, total, number = c, True, [], [], 0, 0
            system = [turn] if role == "system" else []
        elif new and total + turn[2] > budget:
            yield shut()
            # The last turns whose sum fits the allowance, the system turn first.
            room, keep = history, []
            for x in reversed(new):
                if x[2] > room or (system and x is system[0]):
                    break
                keep.append(x)
                room -= x[2]
            tail = system + keep[::-1]
            total, new, number = sum(x[2] for x in tail), [], number + 1
            if total + turn[2] > budget:
                tail = system  # no room for history before a large turn
                total = sum(x[2] for x in tail)
        new.append(turn)
        total += turn[2]
    if new:
        yield shut()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            yield c, role or "", text or ""


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """conv_id, window, n_repeated (leading turns seen before), text and mask of each window.

    ``vocabulary``: path, on the driver, of a tokenizers JSON file whose tokens the budget counts.
    """
    ship(turns.sparkSession)
    shared = None
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            shared = turns.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    kind = "conv_id long, window int, n_repeated int, text string, mask array<struct<start: int, end: int>>"
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        count = count_tokens
        if shared:
            encode = encoder(shared.value).encode
            count = lambda text: len(encode([text])[0]) + 4
        for conv, number, repeated, old, new in windows(_stream(batches), budget, history, count):
            text, mask = format_window(old, new)
            rows.append({"conv_id": conv, "window": number, "n_repeated": repeated, "text": text, "mask": mask})
            size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )
    return rows.mapInArrow(run, kind)


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back: turns and targets, hashed as a stream."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in kind.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, done = None, False, []
        for b in batches:
            for row in b.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        done.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
                    conv, begun, n, loss_n, size, turns, loss = row["conv_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse_window(row["text"])[row["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in row["mask"]:
                    target = unescape(row["text"][span["start"] : span["end"]])
                    loss.update(target.encode("utf-8", "surrogatepass"))
                    loss_n += len(target)
                size += len(row["text"])
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if begun:
            done.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, kind)
