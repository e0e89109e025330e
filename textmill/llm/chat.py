"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of turns to a string. The prefixes of one,
two, ... turns are rendered and consecutive outputs compared: where an output begins
with the one before, the rest is the new turn's span; where it doesn't, the template
has rewritten history and the turns whose spans were disturbed are reported. That holds
for every turn, so the work grows with the square of a conversation's length.

A template that declares `append_only = True` says that the output of some turns ends
with what any later part of them gives alone. Of such a one only the turns within the
last `HELD` characters are rendered again with the new one, so a conversation of any
length takes memory and work in proportion; the template is rendered and compared at
every turn all the same, and one that breaks its word is reported as a rewrite.
Turns are streamed in order within a partition and never gathered into one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import by_value

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Characters of output that are rendered again for a template that declares itself append-only.
HELD = 1 << 16


@dataclass(frozen=True)
class Span:
    """Where a turn lies in the output, in code points; intact is False where a
    later prefix changed the output before the turn's end."""

    start: int
    end: int
    intact: bool = True


@dataclass
class Probe:
    """Spans of a black-box template's turns, found one prefix at a time.

    output is what the last rendering gave, from the character `base` on; base is 0 but
    for a template that declares itself append-only."""

    template: Template
    turns: list[Turn] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)
    output: str = ""
    base: int = 0
    n_turns: int = 0
    rewrites: list[int] = field(default_factory=list)
    #: Whether spans before `base` are kept; without them memory is bounded.
    keep: bool = True

    def add(self, turn: Turn) -> Span:
        """Render one more turn. A rewrite is noted with the number of the turn whose
        arrival caused it; spans that reach beyond the unchanged part lose `intact`."""
        self.turns.append(turn)
        self.n_turns += 1
        output = self.template(list(self.turns))
        if output.startswith(self.output):
            start = self.base + len(self.output)
        else:
            start = self.base + common_prefix(self.output, output)
            self.rewrites.append(self.n_turns - 1)
            self.spans = [s if s.end <= start else Span(s.start, s.end, False) for s in self.spans]
        self.output = output
        span = Span(start, self.base + len(output))
        self.spans.append(span)
        if getattr(self.template, "append_only", False) and not self.rewrites and len(output) > HELD:
            self._settle()
        return span

    def _settle(self) -> None:
        """Leave all but the last turn behind, if that one alone gives the output's end."""
        alone = self.template(self.turns[-1:])
        if not self.output.endswith(alone) or self.base + len(self.output) - len(alone) != self.spans[-1].start:
            self.rewrites.append(self.n_turns - 1)
            return
        self.base = self.spans[-1].start
        self.output, self.turns = alone, self.turns[-1:]
        if not self.keep:
            self.spans = self.spans[-1:]

    def text_of(self, turn: Turn) -> tuple[int, int]:
        """Where the last turn's text lies: between what stays when other texts stand
        in its place. The whole span where the template gives no such place."""
        one, two = (self.template([*self.turns[:-1], (turn[0], c)]) for c in "xy")
        head, tail = common_prefix(one, two), common_prefix(one[::-1], two[::-1])
        start, end = self.base + head, self.base + len(self.output) - tail
        same = head + tail < len(one) and self.output[:head] == one[:head] and self.output[len(self.output) - tail :] == one[len(one) - tail :]
        return (start, end) if same and self.spans[-1].start <= start <= end else (self.spans[-1].start, self.spans[-1].end)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class MarkedTemplate:
    """`<turn ROLE>` newline TEXT newline `</turn>` newline for every turn.

    In texts a backslash is put before each backslash and each `<`, so no marker can
    occur inside one, and taking them out again restores the text. Roles also have
    `>` and line feeds escaped. Each turn's output depends on nothing but the turn."""

    append_only = True
    _marker = re.compile(r"<turn ([^\\<>\n]*(?:\\.[^\\<>\n]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)\n</turn>\n", re.DOTALL)

    def __call__(self, turns: Iterable[Turn]) -> str:
        return "".join(map(self.append, turns))

    def append(self, turn: Turn) -> str:
        return f"<turn {self.escape_role(turn[0])}>\n{self.escape(turn[1])}\n</turn>\n"

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<", "\\<")

    @classmethod
    def escape_role(cls, role: str) -> str:
        return cls.escape(role).replace(">", "\\>").replace("\n", "\\n")

    @staticmethod
    def unescape(text: str, role: bool = False) -> str:
        if "\\" not in text:
            return text
        return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.DOTALL)

    def parse(self, output: str) -> list[tuple[str, str, int, int]]:
        """The turns in an output: role, text, and the span of the escaped text."""
        found, at = [], 0
        while at < len(output):
            m = self._marker.match(output, at)
            if m is None:
                raise ValueError(f"no turn at character {at}")
            found.append((self.unescape(m[1], role=True), self.unescape(m[2]), m.start(2), m.end(2)))
            at = m.end()
        return found


@dataclass
class Formatted:
    """One conversation as it is rendered: running digests of what is read back."""

    template: MarkedTemplate
    probe: Probe
    n_turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    all_turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, turn: Turn) -> None:
        span = self.probe.add(turn)
        self.chars = self.probe.base + len(self.probe.output)
        piece = self.probe.output[span.start - self.probe.base :] if not self.probe.rewrites else ""
        for role, text, *_ in self.template.parse(piece):  # read back from the output
            self.n_turns += 1
            self.all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        if self.probe.rewrites:
            return conv, self.probe.n_turns, None, None, None, self.chars, len(self.probe.rewrites)
        return conv, self.n_turns, self.all_turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, 0


def _ordered(turns: DataFrame) -> DataFrame:
    """One conversation after another within each partition, by turn, role and text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, Turn | None]]:
    """(first of a conversation, its id, turn) for every turn, in order; at the end (True, None, None)."""
    now: int | None = None
    begun = False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            yield not begun or conv != now, conv, (role or "", text or "")
            now, begun = conv, True
    yield True, None, None


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
_EMIT = 4096


def digests(turns: DataFrame, template: MarkedTemplate | None = None) -> DataFrame:
    """What is read back of every formatted conversation, one row each, by a template
    that can `parse` its output: digests of all turns and of the assistant's texts, and
    `rewrites`, how many turns changed what was rendered before. Where there is any, no
    turn has a lasting span, n_turns is the input's and the digests are null.

    Input: conv_id, turn, role, text; other columns are ignored. Null texts and roles
    are empty; turns of equal number follow each other by role and text, repeated rows
    are repeated turns; a null conv_id is a conversation too. An empty table gives no
    rows. With a template that declares itself append-only no memory grows with a
    conversation; else the whole conversation is rendered for each of its turns."""
    template = by_value(template or MarkedTemplate())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: Formatted | None = None
        now: int | None = None
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
        for new, conv, turn in _conversations(batches):
            if new:
                if current is not None:
                    out.append(current.row(now))
                now, current = conv, Formatted(template, Probe(template, keep=False))
            if turn is not None:
                current.add(turn)
            if out and (turn is None or len(out) == _EMIT):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []

    return _ordered(turns).mapInArrow(rows, DIGEST)


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("turn_spans", _SPANS),
        T.StructField("loss_spans", _SPANS),
        T.StructField("rewrites", T.ArrayType(T.LongType())),
    ]
)


def formatted(turns: DataFrame, template: Template | None = None, loss_role: str = "assistant") -> DataFrame:
    """The output of every conversation by any template, the span of each turn in it
    (null where a later turn changed it), the spans of the texts of `loss_role` among
    the intact ones, and the numbers of the turns that rewrote history.

    Input and order as in `digests`; here each conversation's output is one value."""
    template = by_value(template or MarkedTemplate())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.list_(pa.int64()))
        probe, pieces, texts, now = None, [], [], None
        for new, conv, turn in _conversations(batches):
            if new:
                if probe is not None:
                    # What a settled probe has left behind, then what it holds.
                    whole = "".join(pieces)[: probe.base] + probe.output
                    loss = [list(t) for t, s in zip(texts, probe.spans) if t and s.intact]
                    kept = [[s.start, s.end] if s.intact else None for s in probe.spans]
                    arrays = [pa.array([now], pa.int64()), pa.array([whole], pa.string()), pa.array([kept], spans), pa.array([loss], spans), pa.array([probe.rewrites], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=FORMATTED.names)
                probe, pieces, texts, now = Probe(template), [], [], conv
            if turn is not None:
                span = probe.add(turn)
                texts.append(probe.text_of(turn) if turn[0] == loss_role else None)
                if getattr(template, "append_only", False):
                    pieces.append(probe.output[span.start - probe.base :])

    return _ordered(turns).mapInArrow(rows, FORMATTED)


#: A conversation that says what markers and escapes look like.
PROBE_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(turns: DataFrame) -> DataFrame:
    """turns with the probe; a stored conversation of its number gives way to it."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.where(~F.col("conv_id").eqNullSafe(F.lit(PROBE_CONVERSATION[0][0])))
    return rows.unionByName(turns.sparkSession.createDataFrame(PROBE_CONVERSATION, "conv_id long, turn long, role string, text string"))
