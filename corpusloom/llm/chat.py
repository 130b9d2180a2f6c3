r"""Chat formatting: records of many layouts become turns, and turns one marked text with a loss mask.

A record is a JSON text. Its nested field paths, of those that any layout names, are sorted and
hashed; the hash selects a layout, and the layout declares where roles and texts of turns are. A
layout's optional fields give it one hash for each choice of them. A record of no known layout has
no turns and is listed by ``unknown``.

Turns are sorted by conversation through Spark's shuffle and streamed into text, so a conversation of
any length needs the memory of one segment. The template writes

    <|im_start|>role
    text<|im_end|>

for each turn. A control string inside a role or text gets a backslash after its first character;
one that already has backslashes there gets one more, so taking one away restores any text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import small_batches

# Control strings of public chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string, as a pattern; and control strings with any backslashes there.
TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)({TAILS})"), re.compile(rf"([<\[])\\(\\*)({TAILS})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Characters of a segment of formatted text, unless one turn has more.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Field paths that a layout needs and may have, and where its turns are.

    ``each`` names a list (or "" for the record itself) and the paths of role and text in its
    elements; ``fields`` names roles and the fields whose texts, joined by an empty line, they say.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    order: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.may) + 1):
            for some in itertools.combinations(self.may, n):
                yield fingerprint([*self.needs, *some])

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            at, role, text = self.each
            found = [(said(x.get(role)), said(x.get(text))) for x in (record[at] if at else [record])]
        else:
            found = [(role, "\n\n".join(t for f in names if (t := said(record.get(f))) or f == names[0])) for role, names in self.fields if record.get(names[0]) is not None]
        return [(self.roles.get(role, role), text) for role, text in found]


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), each=("", "role", "text"), order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("message parts", ("messages[].role", "messages[].content[].text"), ("messages[].content", "messages[].content[].type"), each=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=SPOKEN),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def said(value: object) -> str:
    """The text of a field: null is empty, parts of a message are put together, other values are their JSON."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(said(v.get("text")) if isinstance(v, dict) else said(v) for v in value)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", text) else text


def paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; elements of lists share the path of their list with [] behind it."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return {at}


def fingerprint(known: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(known)).encode()).hexdigest()


@lru_cache(maxsize=1)
def _layouts() -> tuple[dict[str, Layout], frozenset[str]]:
    by = {f: layout for layout in LAYOUTS for f in layout.fingerprints()}
    return by, frozenset(p for layout in LAYOUTS for p in (*layout.needs, *layout.may))


def read_record(text: str | None) -> tuple[Layout | None, dict, str]:
    """Layout, parsed record and fingerprint of one JSON text."""
    by, known = _layouts()
    try:
        record = json.loads(text or "null")
        found = fingerprint(paths(record) & known)
    except (ValueError, RecursionError):
        return None, {}, ""
    layout = by.get(found) if isinstance(record, dict) else None
    if layout and layout.each and layout.each[0] and not all(isinstance(x, dict) for x in record[layout.each[0]]):
        layout = None
    return layout, record, found


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def turns(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``key``, ``turn``, ``tie``, ``at``, ``role``, ``text``: the turns of JSON records of any known layout.

    Turns of a conversation stand in the order of these columns, nulls first. Rows of one turn each
    are sorted by their number; records that hold all turns come whole, in the order of their digests.
    Null texts and roles are empty, repeated rows are turns of their own, a null key is a key, and
    other columns and unnamed fields are left out. No records give no turns.
    """
    small_batches(records.sparkSession)
    found = records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{record}`").cast("string").alias("record"))
    schema = T.StructType([found.schema["key"], *T._parse_datatype_string("turn long, tie string, at int, role string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column("record").to_pylist()):
                layout, value, _ = read_record(text)
                if layout:
                    tie = "" if layout.order else hashlib.md5(text.encode()).hexdigest()
                    number = _whole(value.get(layout.order)) if layout.order else None
                    out += [(i, number, tie, n, role, said) for n, (role, said) in enumerate(layout.turns(value))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(columns[0], pa.int32())), *(pa.array(c, kind) for c, kind in zip(columns[1:], (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True))], schema.names)

    return found.mapInArrow(run, schema)


def unknown(records: DataFrame, record: str = "record") -> DataFrame:
    """The records of no known layout, with ``fingerprint`` (empty if the text isn't JSON), to write a layout for them."""
    small_batches(records.sparkSession)
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("row"), F.col(f"`{record}`").cast("string").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_record(t) for t in batch.column("record").to_pylist()]
            odd = [i for i, (layout, _, _) in enumerate(found) if not layout]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(odd, pa.int32())), pa.array([found[i][2] for i in odd], pa.string())], ["row", "fingerprint"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fingerprint", T.StringType())]))


def escaped(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    """A role on one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


@dataclass
class _Segment:
    """Formatted text of turns of one conversation, with the spans that are learned."""

    key: object
    number: int = 0
    size: int = 0
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, role: str, text: str) -> None:
        head, body = f"{START}{_role(role)}\n", escaped(text)
        if role == "assistant":
            self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.pieces += [head, body, END]
        self.size += len(head) + len(body) + len(END)


FILE = "segment int, last boolean, text string, loss array<struct<start: int, end: int>>"


def _segments(rows: Iterator[tuple[object, str, str]]) -> Iterator[tuple[_Segment, bool]]:
    """Segments of sorted turns, and whether each is the last of its conversation."""
    now: _Segment | None = None
    for key, role, text in rows:
        if now is None or key != now.key:
            if now:
                yield now, True
            now = _Segment(key)
        elif now.size >= SEGMENT:
            yield now, False
            now = _Segment(key, now.number + 1)
        now.add(role, text)
    if now:
        yield now, True


def write(said: DataFrame, path: str) -> None:
    """Write turns (the columns of ``turns``) as segments of formatted text: one for each conversation of up to a megabyte."""
    small_batches(said.sparkSession)
    fields = [said.schema["key"], *T._parse_datatype_string(FILE)]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple[object, str, str]]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("key").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True)

        def batch(held: list[tuple[_Segment, bool]]) -> pa.RecordBatch:
            loss = [[{"start": a, "end": b} for a, b in s.spans] for s, _ in held]
            columns = [([s.key for s, _ in held], kind), ([s.number for s, _ in held], pa.int32()), ([last for _, last in held], pa.bool_()), (["".join(s.pieces) for s, _ in held], pa.string()), (loss, spans)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["key", "segment", "last", "text", "loss"])

        held, size = [], 0
        for found in _segments(rows()):
            held.append(found)
            size += found[0].size
            if size >= SEGMENT:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    order = ["key", "turn", "tie", "at", "role", "text"]
    said.repartition("key").sortWithinPartitions(*order).select("key", "role", "text").mapInArrow(run, T.StructType(fields)).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Formatted segments: ``key``, ``segment``, ``last``, ``text`` and the learned spans ``loss``."""
    return spark.read.parquet(path)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted text."""
    return [(_plain_role(role), unescaped(said)) for role, said in _TURN.findall(text)]


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(parts: DataFrame) -> DataFrame:
    """Figures of conversations whose segments follow each other within a partition."""
    schema = T.StructType([parts.schema["key"], *T._parse_datatype_string(DIGEST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_turns = n_loss = n_chars = 0
        all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for i, (last, text, loss) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("last", "text", "loss")), strict=True)):
                said = parsed(text)
                learned = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
                all_turns.update("".join(f"{role}\n{t}\n" for role, t in said).encode())
                all_loss.update(learned.encode())
                n_turns, n_loss, n_chars = n_turns + len(said), n_loss + len(learned), n_chars + len(text)
                if last:
                    out.append((i, n_turns, all_turns.hexdigest(), n_loss, all_loss.hexdigest(), n_chars))
                    n_turns = n_loss = n_chars = 0
                    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(columns[0], pa.int32())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], schema.names)

    return parts.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Turns, learned text and length of each conversation, parsed from its formatted segments.

    Conversations of one segment are read where they lie; the others' segments are sorted and streamed
    through one task for each conversation, since SHA-256 goes over its text in order.
    """
    small_batches(formatted.sparkSession)
    alone = (F.col("segment") == 0) & F.col("last")
    long = formatted.filter(~alone).repartition("key").sortWithinPartitions("key", "segment")
    return _digests(formatted.filter(alone)).unionAll(_digests(long))
