"""Transcript parsing: a hidden Markov model over lines recovers who speaks, before turns are rendered in one form.

Each line has a state: the first (B) or a later (I) line of a turn of the system, the user or the assistant. What is
seen of a line is the role its speaker marker names and how plainly, whether a blank line stands before it, its length
and whether it asks. Viterbi finds the likeliest states of a whole transcript, many transcripts at once; a marker that
the text merely mentions loses to the lines around it, and a turn without marker is told by a blank line and its shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import dropwhile, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

ROLES = ("system", "user", "assistant")
#: What speakers are called, by role.
NAMES = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "prompter": 1, "question": 1, "customer": 1, "q": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "answer": 2, "agent": 2, "a": 2,
}
MARKER = re.compile(rf"^[ \t]*(?P<open>(?:\*\*|#+|<\|(?:im_start\|>)?|\[|\()?)[ \t]*(?P<name>{'|'.join(sorted(NAMES, key=len, reverse=True))})[ \t]*(?P<close>(?:\*\*|\|>|\]|\))?)[ \t]*(?P<colon>:?)(?:\*\*)?[ \t]*(?P<rest>.*)$", re.IGNORECASE | re.DOTALL)
#: Plainness of a marker: none, a short name or a bare word, a name with a sign of its own.
NONE, WEAK, STRONG = range(3)
#: Turn numbers of a part. A conversation is stored in parts, but its transcript is parsed as a whole.
PART_TURNS = 512
#: Log-likelihoods of a marker of the own role, of another role and of none, by plainness, for first and for later lines.
FIRST_OWN, FIRST_OTHER, FIRST_NONE = {WEAK: -1.2, STRONG: -0.2}, {WEAK: -6.0, STRONG: -9.0}, -4.0
LATER_MARK, LATER_NONE = {WEAK: -4.5, STRONG: -6.5}, -0.02
#: Added where no marker is seen: a blank line before a first line (by whether the transcript has plain markers at all), none before it, and one before a later line.
BLANK_FIRST, TIGHT_FIRST, BLANK_LATER = {True: 1.5, False: 5.0}, -2.5, -1.0
#: Who begins, who follows whom after the last line of a turn, and ending or keeping a turn.
BEGIN = np.log([0.2, 0.7, 0.1])
FOLLOW = np.log([[0.01, 0.95, 0.04], [0.01, 0.06, 0.93], [0.01, 0.93, 0.06]])
END, STAY = np.log(0.4), np.log(0.6)
#: Log-likelihood of lines of up to 40, 120, 400 and more characters, and of a question, for each role.
LENGTHS = np.log([[0.2, 0.35, 0.35, 0.1], [0.3, 0.35, 0.27, 0.08], [0.15, 0.25, 0.35, 0.25]])
ASKS = np.log([[0.95, 0.05], [0.6, 0.4], [0.9, 0.1]])


def has_markers(transcript: str) -> bool:
    """Whether a transcript has plain markers at all."""
    return any((m := MARKER.match(x)) and (m["colon"] or m["close"]) and len(m["name"]) > 1 for x in transcript.split("\n"))


def blanks_after(transcript: str, blank: int = 0) -> int:
    """How many blank lines stand at the end of a transcript with ``blank`` of them before it."""
    lines = transcript.split("\n")
    return next((i for i, x in enumerate(reversed(lines)) if x.strip()), blank + len(lines))


def seen(transcript: str, marked: bool | None = None, blank: int = 0) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """A transcript's lines that are not blank, as (line, what follows its marker, role, blank lines before), and the log-likelihood of each under the six states.

    For a part of a transcript, ``marked`` tells whether the whole has plain markers, and ``blank`` how many blank lines stand before.
    """
    lines, scores = [], []
    marked = has_markers(transcript) if marked is None else marked
    for line in transcript.split("\n"):
        if not line.strip():
            blank += 1
            continue
        m = MARKER.match(line)
        role, plain, rest = -1, NONE, line
        if m and (m["colon"] or m["close"] or m["open"].startswith(("#", "<")) or not m["rest"]):
            name = m["name"].lower()
            plain = STRONG if (m["colon"] or m["close"] or m["open"]) and len(name) > 1 else WEAK
            role, rest = NAMES[name], m["rest"]
        size = int(np.searchsorted((40, 120, 400), len(line)))
        asks = int(line.rstrip().endswith("?"))
        row = np.empty(6)
        for r in range(3):
            shape = LENGTHS[r, size] + ASKS[r, asks]
            if plain == NONE:
                row[2 * r] = FIRST_NONE + (BLANK_FIRST[marked] if blank else TIGHT_FIRST)
                row[2 * r + 1] = LATER_NONE + (BLANK_LATER if blank else 0)
            else:
                row[2 * r] = FIRST_OWN[plain] if role == r else FIRST_OTHER[plain]
                row[2 * r + 1] = LATER_MARK[plain]
            row[2 * r : 2 * r + 2] += shape
        lines.append((line, rest, role, blank))
        scores.append(row)
        blank = 0
    return lines, np.array(scores).reshape(-1, 6)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the first state and of each state after each; states are B, I of each role in turn."""
    begin, step = np.full(6, -np.inf), np.full((6, 6), -np.inf)
    begin[::2] = BEGIN
    for r in range(3):
        for of in (2 * r, 2 * r + 1):
            step[of, ::2] = END + FOLLOW[r]
            step[of, 2 * r + 1] = STAY
    return begin, step


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each sequence of log-likelihoods; ties go to the earlier state."""
    begin, step = transitions()
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    n, longest = int((sizes > 0).sum()), int(sizes.max(initial=0))
    if not n:
        return out
    best = begin + np.stack([scores[i][0] for i in order[:n]])
    back = []
    for t in range(1, longest):
        live = int((sizes > t).sum())
        ways = best[:live, :, None] + step
        back.append(ways.argmax(1))
        best[:live] = ways.max(1) + np.stack([scores[i][t] for i in order[:live]])
    for k in range(n):
        path = np.empty(sizes[k], np.int64)
        path[-1] = best[k].argmax()
        for t in range(sizes[k] - 1, 0, -1):
            path[t - 1] = back[t - 1][k, path[t]]
        out[order[k]] = path
    return out


def viterbi_of_parts(parts: Iterable[np.ndarray]) -> list[np.ndarray]:
    """viterbi() of one sequence that comes in parts: the best scores pass from part to part, and back pointers are all that is kept of a line."""
    best, step = transitions()
    first, back = True, []
    for scores in parts:
        pointers = np.zeros((len(scores), 6), np.int8)
        for t, row in enumerate(scores):
            if not first:
                ways = best[:, None] + step
                pointers[t], best = ways.argmax(0), ways.max(0)
            best, first = best + row, False
        back.append(pointers)
    state, out = int(best.argmax()), []
    for pointers in reversed(back):
        path = np.empty(len(pointers), np.int64)
        for t in range(len(pointers) - 1, -1, -1):
            path[t] = state
            state = int(pointers[t, state])
        out.append(path)
    return out[::-1]


def gather(lines: list[tuple[str, str, int, int]], path: np.ndarray, open_turn: list[str] | None = None) -> list[tuple[int, list[str]]]:
    """The turns (role, lines) that begin in these lines of the given states; lines before the first one go to ``open_turn``."""
    turns: list[tuple[int, list[str]]] = []
    for (line, rest, role, blank), state in zip(lines, path.tolist(), strict=True):
        if state % 2 == 0:
            open_turn = [rest if role == state // 2 else line]
            turns.append((state // 2, open_turn))
        else:
            open_turn += [""] * blank + [line]
    return turns


def joined(turns: list[tuple[int, list[str]]]) -> list[tuple[str, str]]:
    return [(ROLES[r], "\n".join(dropwhile(lambda x: not x.strip(), text))) for r, text in turns]


def parse(transcripts: list[str]) -> list[list[tuple[str, str]]]:
    """The turns (role, text) of each transcript; a marker before a turn's first line is no part of its text, nor are blank lines at either end."""
    found = [seen(t) for t in transcripts]
    return [joined(gather(lines, path)) for (lines, _), path in zip(found, viterbi([s for _, s in found]), strict=True)]


def parse_parts(parts: list[str]) -> Iterator[list[tuple[str, str]]]:
    """The turns of the one transcript that the parts make, with a blank line between them, by the part in which each begins."""
    marked = any(map(has_markers, parts))
    blanks = [0]
    for p in parts:
        blanks.append(blanks_after(p, blanks[-1]) + 1)
    paths = viterbi_of_parts(seen(p, marked, blank)[1] for p, blank in zip(parts, blanks, strict=False))
    held: list[list[tuple[int, list[str]]]] = []
    last: list[str] | None = None
    for p, blank, path in zip(parts, blanks, paths, strict=False):
        turns = gather(seen(p, marked, blank)[0], path, last)
        if turns:  # what began before has ended
            yield from map(joined, held)
            held, last = [], turns[-1][1]
        held.append(turns)
    yield from map(joined, held)


def render(turns: list[tuple[str, str]]) -> str:
    """One form for all: each turn between start and end marks; marks in a text are broken by a space so that they stay text."""
    safe = lambda x: x.replace("<|im_", "<| im_")
    return "".join(f"<|im_start|>{role}\n{safe(text)}<|im_end|>\n" for role, text in turns)


#: What is made of a transcript.
MADE = pa.schema([("n_turns", pa.int64()), ("roles", pa.list_(pa.string())), ("turns", pa.list_(pa.string())), ("chat", pa.string())])


def made(parsed: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    return table(MADE, n_turns=[len(p) for p in parsed], roles=[[r for r, _ in p] for p in parsed], turns=[[t for _, t in p] for p in parsed], chat=[render(p) for p in parsed])


def made_schema(transcripts: DataFrame, keys: list[str]) -> str:
    kinds = dict(transcripts.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_turns long, roles array<string>, turns array<string>, chat string"])


def format_transcripts(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_turns, roles, turns, chat) of each row's ``text``. Null and blank transcripts have no turns and an empty chat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                parsed = parse([t or "" for t in part.column(len(keys)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made(parsed).columns], names=[*keys, *MADE.names])

    return transcripts.select(*keys, "text").mapInArrow(run, made_schema(transcripts, keys))


def format_conversations(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_turns, roles, turns, chat) of each part that transcripts_of() makes, ``keys`` beginning with conv_id and part.

    All parts of a conversation are parsed as one transcript. A turn stands in the part in which it begins, so that the
    chats of the parts, in order, make the chat of the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[pa.RecordBatch], parsed: Iterable[list[tuple[str, str]]]) -> Iterator[pa.RecordBatch]:
            parsed = iter(parsed)
            for f in found:
                for part in slices(f):
                    turns = list(islice(parsed, part.num_rows))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made(turns).columns], names=[*keys, *MADE.names])

        def finish(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for f in found for t in f.column(len(keys)).to_pylist()]
            return rows(found, parse_parts(texts) if len(texts) > 1 else parse(texts))

        held: list[pa.RecordBatch] = []  # what has come of the conversation that comes last
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            if held and held[-1].column(0)[0].as_py() != ids[0]:
                yield from finish(held)
                held = []
            alone: list[int] = []  # conversations of one part are parsed many at a time
            for start, stop in pairwise(starts):
                if stop - start == 1 and not held:
                    alone.append(start)
                else:
                    yield from finish([*held, batch.slice(start, stop - start)])
                    held = []
            if alone:
                for part in slices(batch.take(pa.array(alone))):
                    yield from rows([part], parse([t or "" for t in part.column(len(keys)).to_pylist()]))
            held.append(batch.slice(starts[-1]))
        if held:
            yield from finish(held)

    return raw.select(*keys, "text").sortWithinPartitions("conv_id", "part").mapInArrow(run, made_schema(raw, keys))


#: How raw transcripts mark speakers, by style: before the text of a turn of the system, the user, the assistant.
STYLES = [("System: ", "User: ", "Assistant: "), ("### Instructions:\n", "### Human:\n", "### AI:\n"), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("[Context] ", "[Q] ", "[A] "), ("**System:** ", "**Customer:** ", "**Agent:** "), ("", "", "")]


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns_in, text, roles_in): each conversation (conv_id, turn, role, text) as a raw transcript in a style of its own, in parts.

    The style goes by conv_id; the last one has no markers but blank lines. Turns stand by number, equal ones by role
    and text; repeated rows count once; null texts are empty, null turns come first, and unknown roles have no marker.
    Part 0 also takes null and negative turns. All parts of a conversation are in one partition.
    """
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(len(STYLES))).cast("int")

    def marker(role: int) -> Column:
        return F.element_at(F.array(*(F.lit(s[role]) for s in STYLES)), style + 1)

    before = F.when(F.col("role") == "system", marker(0)).when(F.col("role") == "user", marker(1)).when(F.col("role") == "assistant", marker(2)).otherwise("")
    rows = conversations.select("conv_id", "turn", "role", "text").distinct().withColumn("line", F.concat(before, F.coalesce("text", F.lit(""))))
    part = F.greatest(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).cast("long")
    lists = rows.repartition("conv_id").groupBy("conv_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n_turns_in"), F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "line"))).alias("_lines"))
    return lists.select("conv_id", "part", "n_turns_in", F.concat_ws("\n\n", F.col("_lines.line")).alias("text"), F.transform("_lines", lambda x: x["role"]).alias("roles_in"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations, their recovered turns, and one chat form of each."""
    raw = transcripts_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    done = format_conversations(raw, ["conv_id", "part", "roles_in"])
    return done.select("conv_id", "part", "n_turns", F.concat_ws(",", "roles").alias("roles"), (F.col("roles") == F.col("roles_in")).alias("as_marked"), "chat")
