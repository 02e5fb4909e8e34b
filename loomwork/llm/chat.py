"""Chat formatting: the nested field paths of a record choose a declarative mapping to canonical turns.

A record is a JSON object. Its field paths (``messages[].role``), as far as any mapping names them, are
sorted and hashed; the hash selects the mapping. Records of no known layout give no turns and are counted
by layouts(). Turns are then written with a template that marks them and escapes its own control strings
reversibly, with the spans that carry loss, and can be read back exactly.

Null texts and roles are empty; a null conv_id is a conversation of its own (all its rows together); rows
with equal (conv_id, turn) stay, ordered by role and text. An empty table gives an empty one. Members of a
list of turns that aren't objects make no turn, parts of a content that hold no text say nothing, a turn that
isn't a whole number is null, and half a surrogate pair becomes a question mark. A record that isn't JSON, is
nested deeper than Python decodes, or whose paths are no mapping's gives no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, slices

#: name -> how turns are read. list: path of the list of turns, with its role and text fields; fields: (role, field)
#: in order; row: the record is one turn. Fields in optional may be absent. A content may be a list of parts with text.
MAPPINGS = {
    "turn_row": {"row": ("role", "text"), "required": ("conv_id", "turn", "role", "text"), "optional": ()},
    "messages": {"list": ("messages", "role", "content"), "required": ("messages[].role", "messages[].content"), "optional": ("conv_id", "system")},
    "message_parts": {"list": ("messages", "role", "content"), "required": ("messages[].role", "messages[].content[].text"), "optional": ("conv_id", "system", "messages[].content", "messages[].content[].type")},
    "from_value": {"list": ("conversations", "from", "value"), "required": ("conversations[].from", "conversations[].value"), "optional": ("conv_id", "system")},
    "prompt": {"fields": (("system", "system"), ("user", "prompt"), ("assistant", "completion")), "required": ("prompt", "completion"), "optional": ("conv_id", "system")},
    "prompt_response": {"fields": (("system", "system"), ("user", "prompt"), ("assistant", "response")), "required": ("prompt", "response"), "optional": ("conv_id", "system")},
    "instruction": {"fields": (("system", "system"), ("user", "instruction", "input"), ("assistant", "output")), "required": ("instruction", "output"), "optional": ("conv_id", "system", "input")},
}
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TITLES = {"user": "User", "assistant": "Assistant", "system": "System"}
NAMES = {v: k for k, v in TITLES.items()}
VOCABULARY = {p for m in MAPPINGS.values() for p in m["required"] + m["optional"]}

CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
TURN = re.compile(r'### (?:(User|Assistant|System)|=("(?:[^"\\]|\\.)*")): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n')
TURNS_DDL = "conv_id long, turn long, role string, text string"


def field_paths(value) -> set[str]:
    """Nested field paths of a decoded record; list members share one path, and members that hold nothing have none."""
    found, left = set(), [("", value)]
    while left:
        prefix, value = left.pop()
        if isinstance(value, dict):
            left += ((f"{prefix}.{k}" if prefix else k, v) for k, v in value.items())
        elif isinstance(value, list) and value:
            left += ((f"{prefix}[]", v) for v in value)
        else:
            found.add(prefix)
    return found


def fingerprint(paths: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths & VOCABULARY)))


BY_FINGERPRINT = {fingerprint({*m["required"], *some}): name for name, m in MAPPINGS.items() for some in chain.from_iterable(combinations(m["optional"], n) for n in range(len(m["optional"]) + 1))}


def _text(value) -> str:
    if isinstance(value, list) and any(isinstance(x, dict) and "text" in x for x in value):
        value = "".join(_text(x["text"]) if isinstance(x, dict) and "text" in x else x if isinstance(x, str) else "" for x in value)
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def _turn(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def turns_of(record: dict) -> tuple[str | None, list[tuple[int | None, str, str]]]:
    """The mapping's name and (turn, role, text) of one record."""
    name = BY_FINGERPRINT.get(fingerprint(field_paths(record)))
    if name is None:
        return None, []
    m = MAPPINGS[name]
    if "row" in m:
        role, text = m["row"]
        return name, [(_turn(record["turn"]), _text(record[role]), _text(record[text]))]
    if "list" in m:
        at, role, text = m["list"]
        pairs = [("system", _text(record["system"]))] if record.get("system") else []
        pairs += [(_text(t.get(role)), _text(t.get(text))) for t in record[at] if isinstance(t, dict)]
    else:
        pairs = [(role, "\n\n".join(x for x in (_text(record.get(f)) for f in fields) if x)) for role, *fields in m["fields"] if role != "system" or record.get("system")]
    return name, [(k, ROLES.get(role.lower(), role), text) for k, (role, text) in enumerate(pairs)]


def _records(batch: pa.RecordBatch):
    for conv, record in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
        try:
            value = json.loads(record or "")
            found = turns_of(value) if isinstance(value, dict) else (None, [])
        except (ValueError, RecursionError):
            found = None, []
        yield conv, *found


def canonical_turns(records: DataFrame) -> DataFrame:
    """records(conv_id, record as JSON) -> conv_id, turn, role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def of(batch: pa.RecordBatch) -> dict:
        rows = [(conv, *t) for conv, _, turns in _records(batch) for t in turns]
        return {k: [r[i] for r in rows] for i, k in enumerate(schema.names)}

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(arrow_rows(schema, of), TURNS_DDL)


def layouts(records: DataFrame) -> DataFrame:
    """How many records each mapping took; null for those of no known layout."""
    schema = pa.schema([("layout", pa.string())])
    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), "record")
    return rows.mapInArrow(arrow_rows(schema, lambda b: {"layout": [name for _, name, _ in _records(b)]}), "layout string").groupBy("layout").count()


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn under the template, and where its escaped text begins and ends."""
    head = f"### {TITLES[role] if role in TITLES else '=' + json.dumps(role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        out.append((NAMES[m[1]] if m[1] else json.loads(m[2]), unescape(m[3])))
        at = m.end()
    return out


def in_order(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, end) of the assistant's texts, in code points.

    Conversations are spread by a shuffle and sorted; one passes at a time, so memory holds one output row."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        conv, parts, spans, size, begun = None, [], [], 0, False

        def row():
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": "".join(parts), "loss_spans": spans}], schema=schema)

        done: list = []
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and c != conv:
                    done.append(row())
                    parts, spans, size = [], [], 0
                conv, begun = c, True
                turn, start, end = write_turn(role or "", text or "")
                if role == "assistant":
                    spans.append({"start": size + start, "end": size + end})
                parts.append(turn)
                size += len(turn)
                if len(done) >= 500:
                    yield from pa.Table.from_batches(done, schema).combine_chunks().to_batches()
                    done = []
        if begun:
            done.append(row())
        if done:
            yield from pa.Table.from_batches(done, schema).combine_chunks().to_batches()

    return in_order(turns).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""

    def of(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in DIGESTS.names}
        for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns = read_turns(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            for k, v in zip(DIGESTS.names, (conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                out[k].append(v)
        return out

    return formatted.mapInArrow(arrow_rows(DIGESTS, of), DIGESTS_DDL)


def digest_rows(batches):
    """Digests of conversations whose turns come in order: each turn is formatted and read back alone, and of a
    conversation only the states of its hashes and its sums are held."""
    conv, begun, done = None, False, []
    n_turns = loss_chars = formatted_chars = 0
    said, loss = hashlib.sha256(), hashlib.sha256()

    def row():
        return {"conv_id": conv, "n_turns": n_turns, "turns_sha256": said.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted_chars}

    for batch in batches:
        for part in slices(batch):
            for c, role, text in zip(*(part.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and c != conv:
                    done.append(row())
                    n_turns = loss_chars = formatted_chars = 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                conv, begun = c, True
                turn, start, end = write_turn(role or "", text or "")
                for name, body in read_turns(turn):
                    said.update(f"{name}\n{body}\n".encode())
                    n_turns += 1
                if role == "assistant":
                    body = unescape(turn[start:end])
                    loss.update(body.encode())
                    loss_chars += len(body)
                formatted_chars += len(turn)
            if len(done) >= 500:
                yield pa.RecordBatch.from_pylist(done, schema=DIGESTS)
                done = []
    if begun:
        done.append(row())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=DIGESTS)


def digest_turns(turns: DataFrame) -> DataFrame:
    """digest(format_turns(turns)) without building a conversation's whole string, however long it is."""
    return in_order(turns).mapInArrow(digest_rows, DIGESTS_DDL)
