"""Token counts by a finite-state tokenizer, compiled from a vocabulary file of pair merges with word ends.

The vocabulary becomes a deterministic transducer over symbols (a byte, or a byte that ends a word).  Its transitions
carry the number of tokens that they add to the encoding of what was read, which may be negative.  A state lists the
borders that an entry may still start from: what was read since (the beginning of some entry), the last token of the
encoding up to the border, and its number of tokens relative to the end of the input.

The encoding of a prefix is settled by its last token: an entry t may follow the encoding up to its start exactly if the
merges of (last token + t) give these two tokens again.  So a transition looks at the few entries that end at the new
symbol.  States and transitions are compiled when first met and kept; a word end leads back to the start.

A text is a sequence of chunks.  The state map of a chunk is (head, count, tail): symbols before its first blank, which
still depend on the state it is entered in; tokens between its blanks, which depend on nothing; and what stands behind
its last blank.  Maps compose associatively, and `scan` composes neighbours in log2(chunks) rounds.

Defined cases: null and empty texts have 0 tokens; rows are independent, so ties and repeats need no rule; a text of any
length is cut into chunks; the strings of added tokens inside a text count one token each, as is the library's default.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 16
#: Bounds of what a task keeps; when one is reached the table is started anew, which changes no result.
MOST_STATES, MOST_WORDS = 400_000, 1_000_000
#: White space of the vocabulary's normaliser.
BLANK = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words, digits and runs of signs, as the vocabulary's splitter has them (fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Symbols are numbered from here, word-ending ones from END: private characters, so that strings of symbols are cheap.
PLAIN, END = 0x4E00, 0x4F00
SYMBOLS = 512
#: Separators at which str.split splits though they are no white space of the normaliser.
SEPARATOR = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """Tokens of unbroken text; kept if short."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, s):
        n = self.count(s)
        if len(s) <= 64:
            self[s] = n
        return n


class Transducer:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters, mark = byte_letters(), spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(mark)
            s = "".join(chr(PLAIN + letters[c]) for c in (token[: -len(mark)] if ends else token))
            return s[:-1] + chr(ord(s[-1]) - PLAIN + END) if ends else s

        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(pairs)}
        self.entries = {symbols(a + b) for a, b in pairs} | {chr(base + b) for base in (PLAIN, END) for b in range(256)}
        self.longest = max(map(len, self.entries))
        self.beginnings = {e[:k] for e in self.entries for k in range(1, len(e))}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.restart()

    def restart(self):
        """Forget what was compiled.  State 0 is the start: nothing read."""
        start = (("", "", 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.steps: dict[int, tuple[int, int]] = {}  # state * SYMBOLS + symbol: next state * SYMBOLS, tokens added
        self.follows, self.words = {}, Words(self.unbroken)

    def room(self, state: int) -> int:
        """The state's number, in tables started anew where they are full: also amid a word, so that no word is too long."""
        if len(self.states) <= MOST_STATES and len(self.words) <= MOST_WORDS and len(self.follows) <= 4 * MOST_STATES:
            return state
        live = self.states[state // SYMBOLS]
        self.restart()
        if live not in self.numbers:
            self.numbers[live] = len(self.states)
            self.states.append(live)
        return self.numbers[live] * SYMBOLS

    def merged(self, s: str) -> list[str]:
        """The encoding of a short string of symbols, by its merges in order of rank."""
        parts = list(s)
        while len(parts) > 1:
            ranked = [(self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i) for i in range(len(parts) - 1)]
            least, i = min(ranked)
            if least == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follow(self, last: str, token: str) -> bool:
        """Whether `token` may follow an encoding whose last token is `last` ("" for none)."""
        known = self.follows.get((last, token))
        if known is None:
            known = self.follows[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return known

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition of a state on a symbol: next state and tokens added."""
        read = [(since + symbol, last, count) for since, last, count in self.states[state]]
        for token, last, count in read:  # longest first
            if token in self.entries and self.follow(last, token):
                break
        else:
            raise ValueError("no entry of the vocabulary can end here")
        added = count + 1
        if symbol >= chr(END):
            return 0, added
        # borders that no entry can start from any more are dropped
        new = (*((since, last, n - added) for since, last, n in read if since in self.beginnings), ("", token, 0))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        return number * SYMBOLS, added

    def word(self, piece: str) -> int:
        """Tokens of one piece of the splitter: its path from the start back to the start."""
        data = piece.encode()
        state, count, steps = 0, 0, self.steps
        for b in data[:-1]:
            step = steps.get(state + b)
            if step is None:
                state = self.room(state)
                steps = self.steps
                step = steps[state + b] = self.compile(state // SYMBOLS, chr(PLAIN + b))
            state, added = step
            count += added
        last = state + data[-1] + 256
        if last not in steps:
            steps[last] = self.compile(state // SYMBOLS, chr(END + data[-1]))
        return count + steps[last][1]

    def unbroken(self, s: str) -> int:
        """Tokens of normalised text without blanks."""
        self.room(0)
        return sum(map(self.word, PIECE.findall(s)))

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None for a chunk without a blank, which is all head."""
        if SEPARATOR.search(chunk):
            parts = BLANK.split(chunk)
        else:
            parts = f".{chunk}.".split()  # points keep the ends apart from the blanks
            parts = [parts[0][1:], *parts[1:-1], parts[-1][:-1]] if len(parts) > 1 else parts
        if len(parts) == 1:
            return chunk, None, ""
        return parts[0], sum(map(self.words.__getitem__, parts[1:-1])), parts[-1]

    def compose(self, a, b):
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.unbroken(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list):
        """The map of a whole sequence of chunks: the up-sweep of a parallel prefix scan, neighbours first."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower case character by character: a final sigma is no special case
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def plain(self, text: str) -> int:
        s = self.normalised(text)
        maps = [self.state_map(s[i : i + CHUNK]) for i in range(0, len(s), CHUNK)]
        if not maps:
            return 0
        head, count, tail = self.scan(maps)
        return self.unbroken(head) if count is None else self.unbroken(head) + count + self.unbroken(tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(t in text for t in self.added):
            return self.plain(text)
        parts = self.split_added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The worker's transducer of a vocabulary file, which every machine has under the same path."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: str = "doc_id", limit: int = 2048) -> DataFrame:
    """keep, n_bytes (UTF-8), n_tokens and over_limit, one row per input row; one pass without a shuffle."""

    def run(batches):
        machine = compiled(path)
        for batch in batches:
            counts = [machine.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=[keep, "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(keep, F.octet_length(t).cast("bigint").alias("n_bytes"), t.alias("t"))
    out = rows.mapInArrow(run, f"{keep} {dict(docs.dtypes)[keep]}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
