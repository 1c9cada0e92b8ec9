"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered as one text, encoded once with character offsets, and the
sorted spans of its assistant turns are intersected with the token spans by binary
search."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._spark import by_value

by_value(__name__)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A turn is HEAD role MID text TAIL. A backslash in a role or text is doubled, and one
#: is put into each control string, so that neither control string can occur in them.
HEAD, MID, TAIL = "<|turn|>", "\n", "<|end|>\n"
SCHEMA = "conv_id {id}, n_turns long, text string, turns array<struct<role:string,begin:int,end:int>>, token_ids array<int>, loss_tokens array<int>, loss_spans array<struct<begin:int,end:int>>"
ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Reversible: afterwards every "<|" of the formatted text is the template's own."""
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation and the [begin, end) of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role).replace("\n", "\\\n") + MID, escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def mask(offsets: list[tuple[int, int]], turns: list[tuple[str, int, int]], role: str = "assistant") -> tuple[list[int], list[tuple[int, int]]]:
    """The numbers of the tokens that overlap a turn of ``role``, and the characters under the mask.

    Both lists ascend, so each turn finds its first and last token by binary search. A
    token that reaches beyond its turn counts, but only its characters inside do; the
    pieces of a character that several tokens share count once."""
    begins, ends = [o[0] for o in offsets], [o[1] for o in offsets]
    tokens: list[int] = []
    spans: list[tuple[int, int]] = []
    for who, begin, end in turns:
        if who != role or begin == end:
            continue
        first, last = bisect_right(ends, begin), bisect_left(begins, end)
        tokens += range(max(first, tokens[-1] + 1 if tokens else 0), last)
        reached = begin
        for k in range(first, last):
            a, b = max(begins[k], reached), min(ends[k], end)
            if a < b:
                if spans and spans[-1][1] == a and spans[-1][0] >= begin:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
                reached = b
    return tokens, spans


#: The columns after conv_id, whose type is the input's.
FORMATTED = [
    ("n_turns", pa.int64()),
    ("text", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))),
    ("token_ids", pa.list_(pa.int32())),
    ("loss_tokens", pa.list_(pa.int32())),
    ("loss_spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
]


def _format(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    encoder.encode_special_tokens = True
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *FORMATTED])
        out = []
        for conv, rows in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            turns = [(r["role"] or "", r["text"] or "") for r in rows]
            text, spans = render(turns)
            code = encoder.encode(text, add_special_tokens=False)
            tokens, loss = mask(code.offsets, spans)
            out.append(
                {
                    "conv_id": conv,
                    "n_turns": len(turns),
                    "text": text,
                    "turns": [{"role": r, "begin": a, "end": b} for r, a, b in spans],
                    "token_ids": code.ids,
                    "loss_tokens": tokens,
                    "loss_spans": [{"begin": a, "end": b} for a, b in loss],
                }
            )
            if sum(len(x["text"]) for x in out[-8:]) > 1 << 22 or len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each conv_id: the formatted text, its turns' spans, token ids, the tokens
    under the loss mask and the character spans under it.

    ``conversations`` has conv_id, turn, role and text; turns go by ``turn`` (null first), and
    repeated turn numbers by role and text, so equal rows all stay. Null roles and texts are
    empty. Null conv_id is a conversation of its own; conv_id has any type. Other columns are not read. An empty
    table gives an empty result. ``tokenizer`` is a path that every executor can read; it is
    part of the tokenizer package there. A conversation is one training example, so its turns
    meet in one task; long conversations do not wait on each other."""
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = SCHEMA.format(id=conversations.schema["conv_id"].dataType.simpleString())
    return turns.mapInArrow(lambda batches: _format(batches, tokenizer), schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")}
        for r in batch.to_pylist():
            turns = parse(r["text"])
            loss = "".join(unescape(r["text"][s["begin"] : s["end"]]) for s in r["loss_spans"])
            cols["conv_id"].append(r["conv_id"])
            cols["n_turns"].append(len(turns))
            cols["turns_sha256"].append(hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
            cols["loss_chars"].append(len(loss))
            cols["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            cols["formatted_chars"].append(len(r["text"]))
            cols["n_tokens"].append(len(r["token_ids"]))
            cols["n_loss_tokens"].append(len(r["loss_tokens"]))
        yield pa.RecordBatch.from_arrays([pa.array(cols["conv_id"], batch.column("conv_id").type), *[pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in cols.items() if k != "conv_id"]], names=list(cols))


def digests(formatted: DataFrame) -> DataFrame:
    """For each formatted conversation, what can be read back from its text and its mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
