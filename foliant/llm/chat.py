"""Chat formatting in budgeted windows.

A turn is written `<|im_start|>role`, a line end, its text, `<|im_end|>`, a line end. Within roles and texts a
backslash is put behind the `<` of each `<|`, `<\\|`, `<\\\\|` and so on, so that no control string can come from a
text, and taking one backslash away gives the text again; a line end within a role is `<|nl|>`.

Tokens of turns are summed along each conversation. The sums deal the turns to stretches of STRETCH budgets (a turn
belongs where it begins), so that a conversation of any length is worked on in many tasks; a stretch is bounded by its
tokens. Within a stretch, windows take whole turns as long as the budget lasts. A window begins with the system turn (the
conversation's first turn, if its role is system), then repeats the turns before it as far as `history` tokens
and the budget go, also those of the stretch before, then has its new turns. The loss mask covers the texts of the
new assistant turns, so each is a target once. A turn that is over the budget with the system turn alone has a
window without history. A system turn over half the budget is not repeated.

Order: by turn, nulls first, then by a hash of role and text. Nulls: a null text or role counts as empty; a null
conversation is one of its own. Repeated rows are turns of their own. An empty table gives no windows. Other columns
are not read, so their names don't matter. A single text is held whole by a task, and what is
read back of a conversation goes through its digest in order, without being held."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._shared import hold, map_batches, texts_of, trim
from foliant.llm.packing import PackedTokenizer
from foliant.plans.prefix import running

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
STRETCH = 64  # budgets
BATCH = 1 << 20  # characters of windows that are given on at once
WINDOWS = "window long, turns int, repeated int, tokens long, text string, loss array<struct<begin:int,end:int>>"
SYSTEM, PAST, OWN = 0, 1, 2  # what a turn is to a stretch

_escape = re.compile(r"<(\\*)\|").sub
_unescape = re.compile(r"<\\(\\*)\|").sub


def escaped(text: str) -> str:
    return _escape(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return _unescape(r"<\1|", text) if "|" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text lies in it."""
    head = START + escaped(role).replace("\n", LINE) + "\n"
    body = escaped(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    turns = []
    for part in window.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescaped(role.replace(LINE, "\n")), unescaped(text)))
    return turns


def token_counts(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of the tokenizer at path. Markers count as the text that they are."""
    made: list[PackedTokenizer] = []

    def count(texts: list[str]) -> list[int]:
        if not made:
            made.append(PackedTokenizer(path))
            hold("chat", made.clear)
        return [len(x) // 4 for x in made[0].packed(texts)]

    return count


def counted(turns: DataFrame, count: Callable[[list[str]], list[int]]) -> DataFrame:
    """turns with the tokens of each as it is written."""
    schema = T.StructType([*turns.schema.fields, T.StructField("tokens", T.LongType())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [formatted(r, t)[0] for r, t in zip(texts_of(batch.column("role")), texts_of(batch.column("text")), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(whole), pa.int64())], schema.names)

    return map_batches(turns, kernel, schema, most=4 << 20)


#: (role, text, tokens)
Turn = tuple[str, str, int]


class Stretch:
    """Windows of one stretch, made turn by turn; no more than a window and the history are held."""

    def __init__(self, number: int, budget: int, history: int):
        self.number, self.budget, self.history = number, budget, history
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.again: list[Turn] = []
        self.new: list[Turn] = []
        self.used = 0

    def remember(self, turn: Turn) -> None:
        self.past.append(turn)
        while self.past and sum(x[2] for x in self.past) > self.history:
            self.past.pop(0)

    def repeated(self, turn: Turn) -> list[Turn]:
        """What stands before `turn` in the window that it opens."""
        held = [self.system] if self.system else []
        room = min(self.history, self.budget - turn[2] - sum(x[2] for x in held))
        last = len(self.past)
        while last and room >= self.past[last - 1][2]:
            last -= 1
            room -= self.past[last][2]
        return held + self.past[last:]

    def add(self, turn: Turn, opens: bool) -> Iterator[tuple]:
        """opens: whether it is the system turn that its conversation begins with."""
        if self.new and self.used + turn[2] > self.budget:
            yield self.close()
        if not self.new:
            self.again = self.repeated(turn)
            self.used = sum(x[2] for x in self.again)
        self.new.append(turn)
        self.used += turn[2]
        if opens and 2 * turn[2] <= self.budget:
            self.system = turn
        else:
            self.remember(turn)

    def close(self) -> tuple:
        """A row of WINDOWS."""
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(self.again + self.new):
            whole, begin, end = formatted(role, text)
            if role == "assistant" and k >= len(self.again) and begin < end:
                loss.append({"begin": at + begin, "end": at + end})
            parts.append(whole)
            at += len(whole)
        row = (self.number, len(parts), len(self.again), self.used, "".join(parts), loss)
        self.number, self.new = self.number + 1, []
        return row


def dealt(turns: DataFrame, stretch: int, history: int) -> DataFrame:
    """(conv, stretch, kind, rn, role, text, tokens): turns under each stretch that needs them. turns: with rn and
    at, how many turns and tokens stand before."""
    home = F.floor(F.col("at") / stretch)
    heir = F.floor((F.col("at") + history) / stretch)
    places = F.when(heir > home, F.array(F.struct(home.alias("stretch"), F.lit(OWN).alias("kind")), F.struct(heir.alias("stretch"), F.lit(PAST).alias("kind")))).otherwise(F.array(F.struct(home.alias("stretch"), F.lit(OWN).alias("kind"))))
    rows = turns.select("conv", F.explode(places).alias("x"), "rn", "role", "text", "tokens").select("conv", "x.stretch", "x.kind", "rn", "role", "text", "tokens")
    later = turns.select(F.col("conv").alias("c"), home.alias("stretch")).where("stretch > 0").distinct()
    system = turns.where("rn = 0 and role = 'system'")
    again = system.join(later, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "stretch", F.lit(SYSTEM).alias("kind"), "rn", "role", "text", "tokens")
    return rows.unionByName(again)


def windows(turns: DataFrame, count: Callable[[list[str]], list[int]], budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(conv, window, turns, repeated, tokens, text, loss): window: grows along a conversation. turns: of the window,
    of which the first `repeated` were in one before it. loss: ranges of code points of the text. The counted turns are
    stored once."""
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    named = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    summed = running(counted(named, count).withColumn("tie", F.xxhash64("role", "text")), "conv", ["turn", "tie"], {"rn": F.lit(1), "at": F.col("tokens")})
    schema = T.StructType([T.StructField("conv", named.schema["conv"].dataType), *T._parse_datatype_string(WINDOWS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, convs, rows, size = None, None, [], [], 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

        kind = pa.null()
        for batch in batches:
            kind = batch.column("conv").type
            names = ("conv", "stretch", "kind", "rn", "role", "text", "tokens")
            for conv, place, what, rn, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                made = []
                if key != (conv, place):
                    if one is not None and one.new:
                        made.append((key[0], one.close()))
                    key, one = (conv, place), Stretch(place << 32, budget, history)
                turn = (role, text, tokens)
                if what == SYSTEM:
                    one.system = turn if 2 * tokens <= budget else None
                elif what == PAST:
                    if not (rn == 0 and one.system):
                        one.remember(turn)
                else:
                    made += [(conv, w) for w in one.add(turn, rn == 0 and role == "system")]
                for c, w in made:
                    convs.append(c)
                    rows.append(w)
                    size += len(w[4])
                if size > BATCH:
                    yield given()
                    convs, rows, size = [], [], 0
        if one is not None and one.new:
            convs.append(key[0])
            rows.append(one.close())
        if rows:
            yield given()
        trim()

    placed = dealt(summed, stretch * budget, history).repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "kind", "rn")
    return placed.mapInArrow(run, schema)


def read_back(made: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its windows:
    roles and texts of turns that are new in their window, and the texts under the loss mask, unescaped. Windows are
    parsed where they are; what they hold is then digested in order."""
    kind = made.schema["conv"].dataType
    parts = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string("window long, turns long, body binary, loss_chars long, loss binary, chars long").fields])

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        turns, bodies, chars, losses, whole = [], [], [], [], []
        for text, again, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "repeated", "loss")), strict=True):
            new = parsed(text)[again:]
            loss = "".join(unescaped(text[x["begin"] : x["end"]]) for x in spans)
            turns.append(len(new))
            bodies.append("".join(f"{r}\n{t}\n" for r, t in new).encode())
            chars.append(len(loss))
            losses.append(loss.encode())
            whole.append(len(text))
        return pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("window"), pa.array(turns, pa.int64()), pa.array(bodies, pa.binary()), pa.array(chars, pa.int64()), pa.array(losses, pa.binary()), pa.array(whole, pa.int64())], parts.names)

    schema = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, hashes, out, of = None, [0, 0, 0], None, [], pa.null()

        def ended() -> tuple:
            return (key[0], sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2])

        def given() -> pa.RecordBatch:
            kinds = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

        for batch in batches:
            of = batch.column("conv").type
            for conv, turns, body, chars, loss, whole in zip(*(batch.column(c).to_pylist() for c in ("conv", "turns", "body", "loss_chars", "loss", "chars")), strict=True):
                if key != (conv,):
                    if key is not None:
                        out.append(ended())
                    key, sums, hashes = (conv,), [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [a + b for a, b in zip(sums, (turns, chars, whole), strict=True)]
                hashes[0].update(body)
                hashes[1].update(loss)
            if out:
                yield given()
                out = []
        if key is not None:
            out.append(ended())
            yield given()

    ordered = map_batches(made.select("conv", "window", "repeated", "text", "loss"), parse, parts, most=4 << 20).repartition("conv").sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(digest, schema)
