"""Token counts by a compiled finite-state transducer.

The tokenizer's greedy pair merges have the prefix property: the tokens of a text's prefix end in exactly one
token that can be told from the prefix, and two tokens may stand side by side iff the merges leave their joint
text as those two. So a deterministic machine can read a text one character at a time. Its state holds, for
every position from which a piece of the vocabulary may still be under way, the characters since, the token
that ended there and the number of tokens up to there, relative to the present number; its transitions carry
the change of the token count. States and transitions are compiled when first needed and the table is dropped
when it outgrows its bound, as lazy automata do; that changes no result.

A text is cut into chunks of ``CHUNK`` characters, wherever they fall. The map of a chunk lists entering states with the
leaving state and the number of tokens emitted for each. A word mark after another character, and a line feed, lead
back to the start state whatever came before; so does a mark or digit (ASCII) after a Latin letter if, as is checked,
no piece of the vocabulary holds such a pair. What stands after a chunk's first such point is therefore the same for
all entering states and read once; only what stands before it is read for each. Which states can enter a chunk is
told by the ``LOOK`` characters before it, without the chunks before; where these hold no such point the state is a guess, and
an entering state that a map does not list is added to it when a composition asks for it. Maps compose associatively (``then``), and
an inclusive prefix scan (log2(chunks) rounds, in each of which all compositions are independent) gives the count and
the state after every chunk. Runs between two such points are maps from the start state to itself; their counts are
kept in a memo, bounded in entries and in characters an entry.

Edge cases: a null text counts as empty and has no tokens; blanks, runs of blanks, control characters and
unknown characters count as the library counts them (byte pieces); strings of special tokens inside a text are
ordinary text; repeated rows are counted each; an empty table gives an empty table; other columns are ignored,
whatever their names; very long texts are many chunks, and unbroken ones are not remembered.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.runtime import at_task_end, column, map_rows

MARK = "▁"
_RUN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_PAIR = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ][!-@\\[-`{-~]")
_SEAM = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-@\\[-`{-~])")
#: Characters of a chunk, those looked at before it, and of the longest run that is remembered.
CHUNK, LOOK, REMEMBERED = 4096, 64, 48
_compiled: dict = {}


class CountTransducer:
    """A lazily compiled deterministic transducer over characters whose outputs are changes of the token count."""

    def __init__(self, ranks: dict[str, int], most_states: int = 150_000, most_words: int = 200_000):
        self.ranks = ranks
        self.prefixes = {p[:k] for p in ranks for k in range(1, len(p))}
        self.most_states, self.most_words = most_states, most_words
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}  # the generation before; what is met again moves up
        self.letters_end = not any(map(_PAIR.search, ranks))
        self._reset()

    @classmethod
    def from_model(cls, path: str) -> CountTransducer:
        """From a BPE model file with byte fallback; ranks are the order of merging, the best first."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        plain.sort(key=lambda i: -p.get_score(i))
        return cls({p.id_to_piece(i): r for r, i in enumerate(plain)})

    def _reset(self) -> None:
        self.heads: dict[str, tuple[tuple, int]] = {}
        self.states: list[tuple] = [_START]
        self.numbers = {self.states[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The greedy merges themselves: the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, left: str | None, right: str) -> bool:
        """Whether the merges leave ``right`` after ``left`` (None: at the start)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            want = [right] if left is None else [left, right]
            known = self.pairs[key] = self.merged("".join(want)) == want
        return known

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change of the token count; compiled at first use."""
        go = self.next[state].get(char)
        if go is not None:
            return go
        here = self.states[state]
        ended = None
        going = []
        ranks, prefixes = self.ranks, self.prefixes
        for since, token, count in here:
            run = since + char
            if ended is None and (run in ranks or len(run) == 1) and self.beside(token, run):
                ended = (run, count + (1 if run in ranks else len(char.encode("utf-8", "surrogatepass"))))
            if run in prefixes:
                going.append((run, token, count))
        token, now = ended
        to = (*((run, t, c - now) for run, t, c in going), ("", token, 0))
        if len(self.states) >= self.most_states:  # start over with the present state alone
            self._reset()
            state = self._number(here)
        go = self.next[state][char] = (self._number(to), now)
        return go

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return n

    def count_run(self, run: str) -> int:
        """Tokens of a run from the start state: a macro transition."""
        n = self.words.get(run)
        if n is not None:
            return n
        n = self.old.get(run)
        if n is None:
            parts = _SEAM.split(run) if self.letters_end else [run]
            if len(parts) > 1:
                n = sum(map(self.count_run, parts))
            else:
                head = self.heads.get(run[:5])  # where the first five characters lead
                if head is None:
                    if len(self.heads) > self.most_words:
                        self.heads = {}
                    head = self.heads[run[:5]] = self.leads(_START, run[:5])
                n = head[1] + self.walk(self._number(head[0]), run[5:])[1] if len(run) > 5 else head[1]
        if len(run) <= REMEMBERED:
            if len(self.words) > self.most_words:
                self.old, self.words = self.words, {}
            self.words[run] = n
        return n

    def walk(self, state: int, text: str) -> tuple[int, int]:
        n = 0
        for c in text:
            state, more = self.next[state].get(c) or self.step(state, c)
            n += more
        return state, n

    def leads(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The same for states as such, which outlive the table."""
        number, n = self.walk(self._number(state), text)
        return self.states[number], n

    def count_closed(self, text: str) -> int:
        """Tokens of whole runs: the composition of their maps, all from the start state to itself."""
        if MARK * 2 in text or "\0" in text:
            return sum(map(self.count_run, _RUN.findall(text)))
        known, n = self.words, 0
        for run in text.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0"):
            if run:
                k = known.get(run)
                if k is None:
                    k = self.count_run(run)
                    known = self.words
                n += k
        return n

    def chunk_map(self, text: str, at: int, size: int) -> ChunkMap:
        """The map of ``text[at : at + size]``."""
        end = min(len(text), at + size)
        first = _POINT.search(text, at, end)
        if first is None:
            made = ChunkMap(self, head=text[at:end])
        else:
            last = end - 1
            while not _POINT.match(text, last):
                last -= 1
            leaving, n = self.leads(_START, text[last:end])
            n += self.count_closed(text[first.start() : last])
            made = ChunkMap(self, head=text[at : first.start()], rest=(leaving, n))
        if at and made.head:  # the state that the characters before lead to
            low = max(0, at - LOOK)
            for x in range(at - 1, low - 1, -1):
                if _POINT.match(text, x):
                    low = x
                    break
            made(self.leads(_START, text[low:at])[0])
        else:
            made(_START)
        return made

    def scan(self, text: str, size: int = CHUNK) -> list[ChunkMap]:
        """For each chunk of normalised text the map of all text up to its end: an inclusive prefix scan."""
        maps = [self.chunk_map(text, at, size) for at in range(0, len(text), size)]
        step = 1
        while step < len(maps):
            maps = [maps[i - step].then(m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        return self.scan(MARK + text.replace(" ", MARK), size)[-1](_START)[1]

    def trim(self) -> None:
        """Give back what a long task has piled up."""
        self.old, self.heads = {}, {}
        if len(self.states) > self.most_states // 2:
            self._reset()


_START = (("", None, 0),)
#: Where the machine starts anew: a mark after another character, before and after a line feed.
_POINT = re.compile(f"(?<!{MARK}){MARK}|\n|(?<=\n).", re.S)


class ChunkMap:
    """What a chunk does: parallel lists of entering states, leaving states and numbers of tokens emitted.

    ``head`` is read from each entering state; ``rest``, if there is any, has one leaving state and number for all.
    A composition has two ``parts`` instead.
    """

    __slots__ = ("machine", "head", "rest", "parts", "entering", "leaving", "emitted")

    def __init__(self, machine: CountTransducer, head: str = "", rest: tuple | None = None, parts: tuple | None = None):
        self.machine, self.head, self.rest, self.parts = machine, head, rest, parts
        self.entering: list[tuple] = []
        self.leaving: list[tuple] = []
        self.emitted: list[int] = []

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        """The leaving state and the tokens emitted for an entering state; an unlisted one is added."""
        if not self.head and self.rest is not None:
            return self.rest
        for known, to, n in zip(self.entering, self.leaving, self.emitted, strict=True):
            if known == state:
                return to, n
        if self.parts:
            to, n = self.parts[0](state)
            to, more = self.parts[1](to)
            n += more
        else:
            to, n = self.machine.leads(state, self.head)
            if self.rest is not None:
                to, n = self.rest[0], n + self.rest[1]
        self.entering.append(state)
        self.leaving.append(to)
        self.emitted.append(n)
        return to, n

    def then(self, other: ChunkMap) -> ChunkMap:
        """First this chunk, then the other."""
        made = ChunkMap(self.machine, parts=(self, other))
        for state in self.entering or [_START]:
            made(state)
        return made


def _trim() -> None:
    for machine in _compiled.values():
        machine.trim()


at_task_end.append(_trim)


def transducer(path: str) -> CountTransducer:
    """This process's transducer for a model file."""
    if path not in _compiled:
        _compiled[path] = CountTransducer.from_model(path)
    return _compiled[path]


def _count(batch, path, limit):
    machine = transducer(path)
    texts = [t or "" for t in column(batch, "text").to_pylist()]
    n = [machine.count(t) for t in texts]
    return [column(batch, "doc_id"), [len(t.encode()) for t in texts], n, [x > limit for x in n]]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"),
        functools.partial(_count, path=model, limit=limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
