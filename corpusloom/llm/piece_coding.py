"""SentencePiece encoding with a prefix table, and decoding.

Of each prefix of a text only the last token of its encoding is kept. A token that ends
at a place is the last one exactly if it doesn't merge with the last token of the prefix
before it, which is found once for each pair by merging the two. An automaton names the
tokens that end at each place; the ids are then recovered from the end backwards. The
time is linear in the text, however long a word is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, arrow_schema, text_batches

MARK = "▁"
#: Bytes that a worker may keep of what it has coded, while it reads a partition.
SEGMENT_BYTES, RUN_BYTES, PAIR_BYTES = 88 << 20, 8 << 20, 24 << 20
#: The first of them where the executor has other stages' memory as well.
PIPELINE_SEGMENT_BYTES = 48 << 20
CACHED_CHARS = 48
_SEGMENT = re.compile(" +[^ ]*")
_SCHEMA = "doc_id long, n_tokens long, ids_text string, decoded string"
_TABLES: dict[str, "PieceTable"] = {}


class PieceTable:
    """A BPE vocabulary with byte fallback, read from a sentencepiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only BPE models that leave the text as it is are supported")
        kinds = type(proto.pieces[0])
        self.pieces = [p.piece for p in proto.pieces]
        scores = sorted({p.score for p in proto.pieces}, reverse=True)
        order = {score: i for i, score in enumerate(scores)}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        #: Pieces by the order of merging; of equal ones the leftmost pair merges first.
        self.ranks = {p: order[proto.pieces[i].score] for p, i in self.normal.items()}
        self.characters = frozenset(p for p in self.normal if len(p) == 1)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        #: Whether no piece has a space mark behind another character.
        self.split = bool(self.prefix) and not any(MARK in p.lstrip(MARK) for p in self.normal)
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.names = [str(i) for i in range(len(self.pieces))]
        self.spelled = [p.replace(MARK, " ") for p in self.pieces]
        #: By decimal id, what doesn't depend on the tokens beside it: all but high bytes.
        self.plain = {str(i): self.spelled[i] for i in self.normal.values()}
        self.plain |= {str(i): chr(b) for b, i in self.byte_ids.items() if b < 128}
        self.unknown = re.compile("([^" + "".join(map(re.escape, sorted(self.characters))) + "])")
        self.base = [(i + 1) * len(self.pieces) for i in range(len(self.pieces))]
        self.lengths = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.normal.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = len(self.pieces)
        self.forget()

    def forget(self, segment_bytes: int = SEGMENT_BYTES) -> None:
        """Drop what was kept of texts; the vocabulary stays."""
        self.fits = Memo(self._fits, PAIR_BYTES, 100)  # two numbers
        self.runs = Memo(self._run, RUN_BYTES)
        self.segment = Memo(self._segment, segment_bytes)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again."""
        rank, none = self.ranks.get, self.size
        parts = list(text)
        open_pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while open_pairs and (best := min(open_pairs)) < none:
            i = open_pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del open_pairs[i]
            if i:
                open_pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(open_pairs):
                open_pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether two tokens (the left one's id + 1 times the size, 0 for none) stay apart."""
        left, right = divmod(pair, self.size)
        pieces = [self.pieces[left - 1], self.pieces[right]] if left else [self.pieces[right]]
        return self.merged("".join(pieces)) == pieces

    def _run(self, text: str) -> list[int]:
        """Ids of a text of which every character is a piece."""
        last = [-1] * (len(text) + 1)
        last[-1] = 0  # before the first character: no token
        lengths, fits, base = self.lengths, self.fits, self.base
        for end, token in self.automaton.iter(text):
            if last[end] < 0 and fits[last[end - lengths[token]] + token]:
                last[end] = base[token]
        ids, at, size = [], len(text) - 1, self.size
        while at >= 0:
            token = last[at] // size - 1
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text with space marks in place of spaces; other characters become bytes."""
        if self.characters.issuperset(text):
            return self._run(text)
        ids = []
        for i, part in enumerate(self.unknown.split(text)):
            if i % 2:
                ids += [self.byte_ids[b] for b in part.encode()]
            elif part:
                ids += self.runs[part] if len(part) <= CACHED_CHARS else self._run(part)
        return ids

    def _segment(self, segment: str) -> str:
        return " ".join([self.names[i] for i in self.encode_marked(MARK + segment.replace(" ", MARK))])

    def spell(self, ids: list[int]) -> str:
        """The text of ids, with the space that encoding puts before it."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i is not None and i not in self.silent:
                out.append(self.spelled[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None)
        marked = self.prefix and first is not None and self.pieces[first].startswith(MARK)
        return self.spell(ids)[1:] if marked else self.spell(ids)

    def encode(self, text: str) -> str:
        """The ids of a text, decimal and joined by spaces, with the end id."""
        end = self.names[self.end_id]
        if not text:
            return end
        text = text.replace(MARK, " ")
        if not self.split:
            ids = self.encode_marked(self.prefix + text.replace(" ", MARK))
            return " ".join([self.names[i] for i in [*ids, self.end_id]])
        parts = text.split(" ")
        if "" in parts:
            parts = [s[1:] for s in _SEGMENT.findall(" " + text)]
        memo, compute = self.segment, self._segment
        if max(map(len, parts)) > CACHED_CHARS:
            return " ".join([memo[s] if len(s) <= CACHED_CHARS else compute(s) for s in parts] + [end])
        return f"{' '.join(map(memo.__getitem__, parts))} {end}"

    def decode_names(self, ids: str) -> str:
        """The text of what ``encode`` gives."""
        names = ids.split(" ")[:-1]
        try:
            text = "".join(map(self.plain.__getitem__, names))
            return text[1:] if self.prefix and text else text
        except KeyError:  # bytes that only together make characters
            return self.decode(list(map(int, names)))


def _characters(data: bytes) -> str:
    """Byte pieces as text; each byte that is no part of a character gives one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as bad:
        head = data[:bad.start].decode()
        return head + "�" + _characters(data[bad.start + 1:])


def piece_table(path: str) -> PieceTable:
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def _coded(
    docs: DataFrame, model_path: str, batch_bytes: int, out: str, columns, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Rows of ``out``: doc_id, n_tokens and ``columns(table, texts, ids as text)``."""
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_path)
        pieces.forget(segment_bytes)
        try:
            for batch in text_batches(batches, batch_bytes):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [pieces.encode(t) for t in texts]
                counts = [s.count(" ") + 1 for s in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), *columns(pieces, texts, ids)], schema=schema)
        finally:
            pieces.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def code_documents(docs: DataFrame, model_path: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_text, decoded) of every row of ``docs``, whole texts.

    ``ids_text`` has the decimal ids, joined by one space, with the end id; ``decoded`` is
    the text they decode to. Null and empty texts have the end id alone and decode to an
    empty text; repeated rows are coded row by row; a null doc_id stays.
    """

    def columns(pieces: PieceTable, texts: list[str], ids: list[str]) -> list[pa.Array]:
        return [pa.array(ids, pa.string()), pa.array(map(pieces.decode_names, ids), pa.string())]

    return _coded(docs, model_path, batch_bytes, _SCHEMA, columns)


def encode_documents(docs: DataFrame, model_path: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row: the ids as numbers, and whether they decode to the text.

    Nulls, empty texts and repeated rows as in ``code_documents``; neither the text nor
    what it decodes to leaves the task.
    """

    def columns(pieces: PieceTable, texts: list[str], ids: list[str]) -> list[pa.Array]:
        numbers = [np.fromstring(s, np.int32, sep=" ") for s in ids]
        ends = np.cumsum([0, *map(len, numbers)]).astype(np.int32)
        same = [pieces.decode_names(s) == t for s, t in zip(ids, texts)]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers)))
        return [lists, pa.array(same, pa.bool_())]

    out = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    return _coded(docs, model_path, batch_bytes, out, columns, PIPELINE_SEGMENT_BYTES)
