"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of ranks (byte strings, numbered in the order of their merging) becomes a model of the library: bytes are
mapped to printable characters, and each entry's merge is the last pair that its own bytes reduce to, lowest ranks first.
No other pair that forms the entry can ever stand side by side: nothing was merged over its borders by then, so inside
them merging went as it goes for the entry alone.  So the library's merges give what merging any two neighbours that form
an entry gives.  A piece that is an entry is taken whole.  A text is cut into pieces by a pattern; what the pattern does not match is left out.

Decoding reverses the table: ids become byte strings, their bytes are joined, and only whole characters are made from
them.  A character whose bytes lie in several tokens belongs, as text, to the token that completes it; as offsets, all
these tokens cover the whole character.

A row costs one pass without a shuffle.  Texts longer than `WINDOW` characters go through the library in windows, each
cut at the end of a piece that is well before the window's end, and the next window starts there; so what a task holds
is bounded by the longest piece.  This needs a pattern that never looks back (\\b, ^ and look-behind do) and looks ahead
less than `MARGIN` characters past a piece.

Defined cases: null and empty texts have no tokens; ids that are null decode to null, as do ids with a null or with a
number that the vocabulary lacks; rows are independent, so ties and repeats need no rule; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from paperlens.llm.tokens import byte_letters

#: Characters that go through the library at once, and how far before a window's end the last piece used must stop.
WINDOW, MARGIN = 1 << 18, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (x.split() for x in lines if x.strip())}


def merge_of(entry: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the bytes of an entry reduce to before they are one: two parts, if merging reaches it at all."""
    parts, order = [entry[i : i + 1] for i in range(len(entry))], {}
    while len(parts) > 2:
        for pair in zip(parts, parts[1:]):
            order.setdefault(pair, ranks.get(pair[0] + pair[1], math.inf))
        i = min(range(len(parts) - 1), key=lambda k: order[parts[k], parts[k + 1]])
        if order[parts[i], parts[i + 1]] == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pairs to merge, first ones first."""
    entries = sorted((e for e in ranks if len(e) > 1), key=ranks.__getitem__)
    return [tuple(parts) for parts in (merge_of(e, ranks) for e in entries) if len(parts) == 2]


class Codec:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks bytes {missing}")
        letter = {b: c for c, b in byte_letters().items()}
        shown = lambda entry: "".join(letter[b] for b in entry)
        pairs = [(shown(a), shown(b)) for a, b in merges(ranks)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        self.library = Tokenizer(models.BPE({shown(e): n for e, n in ranks.items()}, pairs, ignore_merges=True))
        pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pieces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the table in reverse: bytes by id, and one empty entry behind them for ids that are none
        entries = [b""] * (max(ranks.values()) + 2)
        self.known = np.zeros(len(entries), bool)
        for e, n in ranks.items():
            entries[n], self.known[n] = e, True
        self.table = pa.array(entries, pa.large_binary())

    def windows(self, text: str):
        """(ids, starts, ends) of the windows of one text; offsets are character numbers in the text."""
        at, size = 0, WINDOW
        while at < len(text):
            found = self.library.encode(text[at : at + size], add_special_tokens=False)
            ids, offsets, use = found.ids, found.offsets, len(found)
            step = size
            if at + size < len(text):
                piece = found.word_ids
                while use and offsets[use - 1][1] > size - MARGIN:
                    use -= 1
                while 0 < use < len(piece) and piece[use - 1] == piece[use]:
                    use -= 1
                if not use and ids:  # one piece fills the window
                    size *= 2
                    continue
                step = offsets[use - 1][1] if use else size - MARGIN
            spans = np.array(offsets[:use], np.int64).reshape(-1, 2) + at
            yield np.array(ids[:use], np.int32), spans[:, 0], spans[:, 1]
            at, size = at + step, WINDOW

    def encode(self, texts: list[str | None], offsets: bool):
        """For each text its (ids, starts, ends); the offsets are empty unless they are wanted."""
        texts, none = [t or "" for t in texts], np.zeros(0, np.int64)
        encode = self.library.encode_batch if offsets else self.library.encode_batch_fast
        at = 0
        while at < len(texts):
            until, chars = at, 0
            while until < len(texts) and (chars := chars + len(texts[until])) <= WINDOW:
                until += 1
            if until == at:
                parts = list(zip(*self.windows(texts[at])))
                yield tuple(np.concatenate(p) for p in parts) if parts else (none, none, none)
                at += 1
                continue
            for found in encode(texts[at:until], add_special_tokens=False):
                spans = np.array(found.offsets, np.int64).reshape(-1, 2) if offsets else none.reshape(0, 2)
                yield np.array(found.ids, np.int32), spans[:, 0], spans[:, 1]
            at = until

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of every row of ids."""
        flat, ends = ids.flatten(), np.concatenate(([0], np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
        numbers = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        valid = (numbers >= 0) & (numbers < len(self.known))
        valid[valid] = self.known[numbers[valid]]
        taken = self.table.take(pa.array(np.where(valid, numbers, len(self.known) - 1)))
        borders = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        data, bad = taken.buffers()[2], np.concatenate(([0], np.cumsum(~valid)))
        null = ids.is_null().to_numpy(zero_copy_only=False) | (bad[ends[1:]] > bad[ends[:-1]])
        rows = [None if no else data[i:j].to_pybytes() if j > i else b"" for i, j, no in zip(borders[ends[:-1]].tolist(), borders[ends[1:]].tolist(), null.tolist())]
        return pa.array(rows, pa.binary())

    def token_texts(self, ids: list[int]) -> list[str]:
        """The characters that each token completes; together the text.  Bytes that form no character become U+FFFD."""
        whole = codecs.getincrementaldecoder("utf-8")("replace")
        last = len(ids) - 1
        return [whole.decode(self.table[i].as_py(), n == last) for n, i in enumerate(ids)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary file, which every machine has under the same path."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def flat_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: str = "doc_id", offsets: bool = False) -> DataFrame:
    """keep and ids; with offsets also starts and ends, the characters that a token covers."""
    names = [keep, "ids", *(["starts", "ends"] if offsets else [])]

    def run(batches):
        machine = codec(path, pattern)
        for batch in batches:
            found = list(zip(*machine.encode(batch.column(1).to_pylist(), offsets)))[: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(flat_lists, found or [[]] * (len(names) - 1))], names=names)

    kinds = ", ".join(f"{n} array<int>" for n in names[1:])
    return docs.select(keep, F.col(text).cast("string")).mapInArrow(run, f"{keep} {dict(docs.dtypes)[keep]}, {kinds}")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with `bytes`, what their ids stand for; it replaces an earlier column of that name."""
    rows = encoded.drop("bytes")
    at = rows.columns.index(ids)

    def run(batches):
        machine = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, machine.decode(batch.column(at))], names=[*batch.schema.names, "bytes"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("bytes", BinaryType())]))
