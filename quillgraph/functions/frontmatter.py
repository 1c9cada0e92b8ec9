"""Front matter (S2): the YAML that heads a node's file, read as the fields of a node.

Read are block and flow mappings and sequences in any nesting, plain and quoted scalars over one line or more, literal
and folded blocks, and comments. Anchors, aliases, tags and keys that are no scalars make a file a rejected one. Every
scalar is text; plain ``null``, ``~`` or nothing is null, a quoted empty text is not."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

EDGE_FIELDS = ("target", "type", "valid_from", "valid_until", "annotation")
FIELDS = ("id", "type", "status", "owner", "created", "updated")
DDL = f"{', '.join(f'{c} string' for c in FIELDS)}, tags array<string>, edges array<struct<{', '.join(f'{c}: string' for c in EDGE_FIELDS)}>>, problem string"

QUOTED = r""""(?:[^"\\]|\\(?s:.))*"|'(?:[^']|'')*'"""
#: A key and its colon: quoted, or plain up to a colon before a blank.
KEY = re.compile(rf"({QUOTED}|[^\s'\"\[\]{{}},&*!|>%@`#](?:[^\s:]|:(?=\S)|[ \t]+(?=[^\s:#]))*?)[ \t]*:(?=[ \t]|$)")
#: A line that needs no further look: a bare key and one bare word.
SIMPLE = re.compile(r"([A-Za-z_]\w*): ([A-Za-z0-9][\w./+-]*)$")
#: In a flow: blanks and comments, then punctuation, a quoted or a plain scalar.
FLOW = re.compile(rf"[ \t\n]*+(?:(?<=[ \t\n])#[^\n]*+[ \t\n]*+)*+(?:([\[\]{{}},])|({QUOTED})|(:)|((?:[^\s,\[\]{{}}:#\"']|:(?=[^\s,\[\]{{}}]))(?:[^\s,\[\]{{}}:]|:(?=[^\s,\[\]{{}}])|[ \t]+(?=[^\s,\[\]{{}}:#]))*)|$)")
ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|\n[ \t]*|(?s:.))|[ \t]*\n((?:[ \t]*\n)*)[ \t]*")
#: The one-letter escapes of double-quoted scalars.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class Malformed(ValueError):
    """The text is not front matter."""


def _unescaped(found: re.Match) -> str:
    code, blank = found.groups()
    if code is None:  # a folded line break
        return "\n" * blank.count("\n") or " "
    if code[0] == "\n":
        return ""
    if code in ESCAPES:
        return ESCAPES[code]
    if len(code) == 1:
        raise Malformed("unknown escape")
    number = int(code[1:], 16)
    if number > 0x10FFFF or 0xD800 <= number < 0xE000:
        raise Malformed("escape of no character")
    return chr(number)


def _unquoted(raw: str) -> str:
    if raw[0] == '"':
        return ESCAPE.sub(_unescaped, raw[1:-1])
    return re.sub(r"[ \t]*\n((?:[ \t]*\n)*)[ \t]*", lambda m: "\n" * m[1].count("\n") or " ", raw[1:-1]).replace("''", "'")


def _plain(text: str) -> str | None:
    return None if text in ("", "~", "null", "Null", "NULL") else text


class Reader:
    """Lines of front matter, read from ``at`` on."""

    def __init__(self, text: str) -> None:
        self.rows = [row.rstrip("\r") for row in text.split("\n")]
        self.at = 0

    def indent(self) -> int:
        """The indentation of the next line with content; -1 at the end."""
        while self.at < len(self.rows):
            row = self.rows[self.at]
            bare = row.lstrip(" ")
            if bare and bare[0] != "#" and not bare.isspace():
                if bare[0] == "\t":
                    raise Malformed("tab in indentation")
                return len(row) - len(bare)
            self.at += 1
        return -1

    def document(self) -> object:
        if self.indent() < 0:
            return None
        out = self.node(self.indent(), -1)
        if self.indent() >= 0:
            raise Malformed(f"line {self.at + 1} belongs to nothing")
        return out

    def node(self, depth: int, above: int) -> object:
        """The node that begins at column ``depth`` of this line, within one at column ``above``."""
        row = self.rows[self.at]
        if row.startswith("-", depth) and row[depth + 1 : depth + 2] in ("", " ", "\t"):
            return self.sequence(depth)
        if SIMPLE.match(row, depth) or KEY.match(row, depth):
            return self.mapping(depth)
        return self.value(row[depth:].rstrip(), above)

    def sequence(self, depth: int) -> list:
        out = []
        while self.indent() == depth and self.rows[self.at].startswith("-", depth) and self.rows[self.at][depth + 1 : depth + 2] in ("", " ", "\t"):
            rest = self.rows[self.at][depth + 1 :]
            bare = rest.lstrip()
            if bare and bare[0] != "#":
                # what follows the dash is a node of its own, as deep as it stands
                inner = depth + 1 + len(rest) - len(bare)
                self.rows[self.at] = " " * inner + bare
                out.append(self.node(inner, depth))
            else:
                self.at += 1
                out.append(self.node(self.indent(), depth) if self.indent() > depth else None)
        if self.indent() > depth:
            raise Malformed(f"line {self.at + 1} is indented")
        return out

    def mapping(self, depth: int) -> dict:
        out: dict = {}
        while self.indent() == depth:
            row = self.rows[self.at]
            simple = SIMPLE.match(row, depth)
            if simple and simple[1] not in out and self.ended(depth):
                out[simple[1]] = _plain(simple[2])
                self.at += 1
                continue
            found = KEY.match(row, depth)
            if not found:
                if row.startswith("-", depth):
                    break
                raise Malformed(f"line {self.at + 1} has no key")
            key = _unquoted(found[1]) if found[1][0] in "'\"" else found[1]
            if key in out:
                raise Malformed(f"key {key} twice")
            rest = row[found.end() :].strip()
            if rest and rest[0] != "#":
                out[key] = self.value(rest, depth)
                continue
            self.at += 1
            below = self.indent()
            listed = below == depth and re.match(r"-(?:[ \t]|$)", self.rows[self.at][depth:])
            out[key] = self.node(below, depth) if below > depth or listed else None
        if self.indent() > depth:
            raise Malformed(f"line {self.at + 1} is indented")
        return out

    def ended(self, depth: int) -> bool:
        """Whether the next line cannot go on with a value of this one."""
        row = self.rows[self.at + 1] if self.at + 1 < len(self.rows) else "-"
        return row != "" and row[: depth + 1].strip(" \t") != ""

    def value(self, rest: str, depth: int) -> object:
        """The node whose first line holds ``rest``; its further lines are deeper than ``depth``."""
        first = rest[0]
        if first in "|>":
            return self.lines(rest, depth)
        if first in "&*!%@`":
            raise Malformed(f"unsupported {first}")
        if first in "'\"":
            return self.quoted(rest)
        if first in "[{":
            return self.flow(rest)
        parts = [re.split(r"[ \t]#", rest, maxsplit=1)[0].strip()]
        if re.search(r":(?:[ \t]|$)", parts[0]):
            raise Malformed(f"line {self.at + 1} has two keys")
        ended = len(parts[0]) < len(rest)  # a comment ends a plain scalar
        self.at += 1
        while not ended and self.at < len(self.rows):
            row = self.rows[self.at]
            bare = row.strip()
            if bare and (len(row) - len(row.lstrip(" ")) <= depth or bare[0] == "#"):
                break
            text = re.split(r"[ \t]#", bare, maxsplit=1)[0].strip()
            if re.search(r":(?:[ \t]|$)", text):
                raise Malformed(f"line {self.at + 1} has a key within a value")
            ended = len(text) < len(bare)
            parts.append(text)
            self.at += 1
        return _plain(_folded(parts)) if len(parts) > 1 else _plain(parts[0])

    def closed(self, tail: str) -> None:
        if tail.strip() and not re.match(r"[ \t]+#", tail):
            raise Malformed(f"line {self.at + 1} goes on after its value")
        self.at += 1

    def quoted(self, rest: str) -> str:
        rows, close = [rest], re.compile(r'(?:[^"\\]|\\.)*(\\?)(")?' if rest[0] == '"' else r"(?:[^']|'')*()(')?")
        found = close.match(rest, 1)
        while not found[2]:
            self.at += 1
            if self.at == len(self.rows):
                raise Malformed("open quote")
            rows.append(self.rows[self.at])
            found = close.match(rows[-1])
        tail = rows[-1][found.end() :]
        rows[-1] = rows[-1][: found.end()]
        self.closed(tail)
        return _unquoted("\n".join(rows))

    def lines(self, head: str, depth: int) -> str:
        """A literal (|) or folded (>) block."""
        found = re.fullmatch(r"([|>])(?:([1-9])?([+-])?|([+-])([1-9]))(?:[ \t]+#.*)?", head)
        if not found:
            raise Malformed("block header")
        style, chomp, given = found[1], found[3] or found[4], found[2] or found[5]
        self.at += 1
        start = self.at
        while self.at < len(self.rows) and (not self.rows[self.at].strip() or len(self.rows[self.at]) - len(self.rows[self.at].lstrip(" ")) > depth):
            self.at += 1
        rows = self.rows[start : self.at]
        left = max(depth, 0) + int(given) if given else next((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), 0)
        if any(r.strip() and r[:left].strip() for r in rows):
            raise Malformed("block indentation")
        rows = [r[left:] for r in rows]
        while rows and not rows[-1].strip():
            rows.pop()
        blanks = self.at - start - len(rows)
        text = "\n".join(rows) if style == "|" else _folded_block(rows)
        return text + ("" if chomp == "-" or (not rows and chomp != "+") else "\n" * (1 + blanks if chomp == "+" and rows else blanks if chomp == "+" else 1))

    def flow(self, rest: str) -> object:
        self.text, self.pos = rest, 0
        out = self.flow_node(self.token())
        self.closed(self.text[self.pos :])
        return out

    def token(self) -> tuple[str, str]:
        """The next token of a flow; further lines are taken as they are needed."""
        while True:
            found = FLOW.match(self.text, self.pos)
            if found and found.lastindex:
                self.pos = found.end()
                return ("", "", "quoted", "", "plain")[found.lastindex], found[found.lastindex]
            rest = self.text[self.pos :]
            if not found and rest.lstrip()[:1] not in ("'", '"'):  # a quote may end on a later line
                raise Malformed("flow")
            self.at += 1
            if self.at == len(self.rows):
                raise Malformed("open flow")
            self.text, self.pos = ("" if found else rest) + "\n" + self.rows[self.at], 0

    def flow_node(self, token: tuple[str, str]) -> object:
        kind, text = token
        if kind:
            return _unquoted(text) if kind == "quoted" else _plain(text)
        if text not in "[{":
            raise Malformed(f"{text} in a flow")
        out: list | dict = [] if text == "[" else {}
        comma, close, token = ("", ","), ("", "]" if text == "[" else "}"), self.token()
        while token != close:
            key, token, value, pair = self.flow_node(token), self.token(), None, False
            if token == ("", ":"):
                pair, token = True, self.token()
                if token not in (comma, close):
                    value, token = self.flow_node(token), self.token()
            if isinstance(out, list):
                out.append({key: value} if pair else key)
            elif not isinstance(key, str) or key in out:
                raise Malformed("key of a flow")
            else:
                out[key] = value
            if token == comma:
                token = self.token()
            elif token != close:
                raise Malformed("flow without comma")
        return out


def _folded(parts: list[str]) -> str:
    """Lines of a plain scalar: one break is a space, each blank line a break."""
    while parts and not parts[-1]:
        parts.pop()
    return re.sub(r"\n(\n*)", lambda m: m[1] or " ", "\n".join(parts))


def _folded_block(rows: list[str]) -> str:
    """Lines of a folded block: lines that are further in keep their breaks."""
    out, held = "", 0
    for k, row in enumerate(rows):
        if not row.strip():
            held += 1
            continue
        if k == held:
            out = "\n" * held
        else:
            loose = row[0] in " \t" or last[0] in " \t"
            out += "\n" * (held + loose) or " "
        out, held, last = out + row, 0, row
    return out


def load(text: str) -> object:
    """Dicts, lists, strings and None. Raises :class:`Malformed`."""
    try:
        return Reader(text).document()
    except RecursionError:
        raise Malformed("nested too deeply") from None


def _text(found: dict, name: str, required: bool = False) -> str | None:
    value = found.get(name)
    if value is None and required:
        raise Malformed(f"no {name}")
    if value is not None and not isinstance(value, str):
        raise Malformed(f"{name} is no scalar")
    return value


def _day(found: dict, name: str) -> str | None:
    value = _text(found, name)
    if value is not None and not re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        raise Malformed(f"{name} is no date")
    return value and date.fromisoformat(value).isoformat()


def _moment(found: dict, name: str) -> str | None:
    value = _text(found, name)
    moment = value and datetime.fromisoformat(value)
    if moment and moment.tzinfo is None:
        raise Malformed(f"{name} has no time zone")
    return moment and moment.isoformat()


def _listed(found: dict, name: str) -> list:
    value = found.get(name)
    if not isinstance(value, list | None):
        raise Malformed(f"{name} is no list")
    return value or []


def node(text: str) -> dict:
    """The fields of :data:`DDL`: ``problem`` says why the text heads no node. Unknown keys are left out."""
    try:
        found = load(text)
        if not isinstance(found, dict):
            raise Malformed("no mapping")
        out = {"id": _text(found, "id", True), "type": _text(found, "type", True), "status": _text(found, "status"), "owner": _text(found, "owner"), "created": _moment(found, "created"), "updated": _moment(found, "updated")}
        tags, edges = _listed(found, "tags"), _listed(found, "edges")
        if not all(isinstance(x, str) for x in tags) or not all(isinstance(x, dict) for x in edges):
            raise Malformed("an element of a list")
        rows = [{"target": _text(x, "target", True), "type": _text(x, "type", True), "valid_from": _day(x, "valid_from"), "valid_until": _day(x, "valid_until"), "annotation": _text(x, "annotation")} for x in edges]
        return out | {"tags": tags, "edges": rows, "problem": None}
    except ValueError as error:
        return {"problem": str(error) or "malformed"}


#: The layout that :func:`quillgraph.sources.markdown.serialise` writes where all scalars are plain: it is read in columns, all else line by line.
_WORD, _TEXT, _DAY, _MOMENT = r"[A-Za-z0-9][A-Za-z0-9_./+-]*", r"[A-Za-z0-9](?:[A-Za-z0-9_./+#-]| +[A-Za-z0-9_./+-])*", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9][0-9T:.Z+-]*[0-9Z]"
_ITEM = rf"(?P<target>{_WORD})\n    type: (?P<type>{_WORD})(?:\n    valid_from: (?P<valid_from>{_DAY}))?(?:\n    valid_until: (?P<valid_until>{_DAY}))?(?:\n    annotation: (?P<annotation>{_TEXT}))?"
_HEAD = rf"id: (?P<id>{_WORD})\ntype: (?P<type>{_WORD})(?:\nstatus: (?P<status>{_TEXT}))?(?:\ncreated: (?P<created>{_MOMENT}))?(?:\nupdated: (?P<updated>{_MOMENT}))?(?:\nowner: (?P<owner>{_TEXT}))?(?:\ntags: \[(?P<tags>{_WORD}(?:, {_WORD})*)\])?"
_FIRST, _NEXT = "\nedges:\n  - target: ", "\n  - target: "
_PLAIN = rf"\A{_HEAD}(?:\nedges:(?:\n  - target: {_ITEM})+)?\z"
_PLAIN = re.sub(r"\(\?P<\w+>", "(?:", _PLAIN)
#: Words that would be read as null.
_NULL = r"[ \[](?:null|Null|NULL)(?:[,\]\n]|\z)"
#: Bytes of front matter that are read at a time (one text at least).
SLICE = 4 << 20


def _strings(values: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values)


def _checked(values: pa.Array, read: Callable[[dict, str], str | None]) -> tuple[pa.Array, np.ndarray]:
    """``values`` as ``read`` gives them, and which of them it refuses; each distinct text is read once."""
    coded = values.dictionary_encode()
    known: list[str | None] = []
    refused = []
    for text in coded.dictionary.to_pylist():
        try:
            known.append(read({"": text}, ""))
        except ValueError:
            refused.append(len(known))
            known.append(None)
    bad = np.isin(pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), refused)
    return pa.array(known, pa.string()).take(coded.indices), bad


def _lists(found: pa.Array, values: pa.Array) -> pa.ListArray:
    """``values`` in lists as long as those of ``found``; null ones are empty."""
    n = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)


def _columns(texts: pa.Array, kind: pa.StructType) -> tuple[pa.StructArray, np.ndarray]:
    """The fields of texts of the plain layout, read in columns, and which texts hold a date or time that is none."""
    halves = pc.split_pattern(texts, _FIRST, max_splits=1)
    head = pc.list_element(halves, 0)
    two = pc.greater(pc.list_value_length(halves), 1)
    tail = pc.list_element(pc.if_else(two, halves, pa.scalar([None, None], halves.type)), 1)
    f = pc.extract_regex(head, rf"\A{_HEAD}\z")
    fields = {c: _strings(f.field(c)) for c in (*FIELDS, "tags")}
    tags = pc.split_pattern(fields["tags"], ", ")
    items = pc.split_pattern(tail, _NEXT)
    flat = pc.extract_regex(items.flatten(), rf"\A{_ITEM}\z")
    edge = {c: _strings(flat.field(c)) for c in EDGE_FIELDS}
    parent = pc.list_parent_indices(items).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(texts), bool)
    for c in ("created", "updated"):
        fields[c], wrong = _checked(fields[c], _moment)
        bad |= wrong
    for c in ("valid_from", "valid_until"):
        edge[c], wrong = _checked(edge[c], _day)
        bad[parent[wrong]] = True
    edges = pa.StructArray.from_arrays([edge[c] for c in EDGE_FIELDS], fields=list(kind.field("edges").type.value_type))
    columns = [*[fields[c] for c in FIELDS], _lists(tags, tags.flatten()), _lists(items, edges), pa.nulls(len(texts), pa.string())]
    return pa.StructArray.from_arrays(columns, fields=list(kind)), bad


def _read(texts: pa.Array, kind: pa.StructType) -> pa.Array:
    plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring_regex(texts, _NULL))).to_numpy(zero_copy_only=False)
    quick = np.flatnonzero(plain)
    found, bad = _columns(texts.take(pa.array(quick)), kind)
    if len(quick) == len(texts) and not bad.any():
        return found
    plain[quick[bad]] = False
    slow = np.flatnonzero(~plain)
    rows = pa.array([node(x) for x in texts.take(pa.array(slow)).to_pylist()], type=kind)
    at = np.empty(len(texts), np.int64)
    at[quick] = np.arange(len(quick))
    at[slow] = len(quick) + np.arange(len(slow))
    return pa.concat_arrays([found, rows]).take(pa.array(at))


def read(fronts: pa.Array, kind: pa.StructType) -> pa.Array:
    """:func:`node` of each text, null as an empty one. Texts of the plain layout are read in columns, some bytes at a time."""
    texts = pc.fill_null(fronts, "").cast(pa.string())
    ends, start, out = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0, []
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        out.append(_read(texts.slice(start, stop - start), kind))
        start = stop
    return pa.concat_arrays(out) if out else pa.array([], type=kind)


def node_fields(front: Column) -> Column:
    """A struct of :data:`DDL`, on Arrow batches. It counts as nondeterministic so that no filter above it reads a text twice."""
    text = pa.string()
    edge = pa.struct([(c, text) for c in EDGE_FIELDS])
    kind = pa.struct([*[(c, text) for c in FIELDS], ("tags", pa.list_(text)), ("edges", pa.list_(edge)), ("problem", text)])

    @F.arrow_udf(DDL)
    def fields(fronts: pa.Array) -> pa.Array:
        return read(fronts, kind)

    return fields.asNondeterministic()(front)
