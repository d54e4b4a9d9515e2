"""SentencePiece encoding by a prefix table, and decoding."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lectern.llm.common import pieces

BLANK = "▁"
CACHE = 900_000
LONGEST_CACHED = 64
START = ("", 0, [], {}, "", "")


class Codec(dict):
    """Encoder and decoder of a merge-type (BPE) model with byte fallback.

    A text is cut before each run of blanks, where no merge can reach across (checked on the vocabulary).  For a
    stretch, `last[i]` is the one token that ends the encoding of its first i characters: of the tokens an automaton
    finds ending at i, the one that stands beside `last[i - its length]` when both are encoded together.  The ids are
    read off backwards.  As a dictionary it keeps what short stretches gave, up to CACHE of them, in two generations.
    """

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.rank, self.byte, self.by_byte = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[i] = int(piece[3:-1], 16)
                self.by_byte[self.byte[i]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece
                self.rank[piece] = (-model.get_score(i), i)
        self.shown = {i: p.replace(BLANK, " ") for i, p in self.text.items()}
        self.unknown = model.unk_id()
        self.prefix = BLANK if model.encode("a b", out_type=str)[0].startswith(BLANK) else ""
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.rank):
            self.cut = re.compile("(?s).+")
        self.chars = frozenset(p for p in self.rank if len(p) == 1)
        self.found = ahocorasick.Automaton()
        for piece in self.rank:
            self.found.add_word(piece, self.token(piece, [self.rank[piece][1]]))
        self.found.make_automaton()
        self.unseen: dict[str, tuple] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def token(self, piece: str, ids: list[int]) -> tuple[str, int, list[int], dict[str, bool], str, str]:
        """Piece, length, ids, what is known of tokens on its left, the ids in decimal, the text they decode to."""
        return piece, len(piece), ids, {}, ",".join(map(str, ids)), self.pieces_text(ids)

    def merged(self, text: str) -> list[str]:
        """Best merge first, leftmost among equals: the definition, used on pairs of tokens only."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                       default=None)
            if not best:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart and whole when their texts are encoded together."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def stretch(self, text: str) -> list[tuple]:
        """The tokens of a stretch."""
        last: list = [START] + [None] * len(text)
        found = self.found.iter(text)
        if not self.chars.issuperset(text):
            found = self.with_unknown(text, found)
        for i, token in found:
            if last[i + 1] is not None:
                continue
            left, beside = last[i + 1 - token[1]][0], token[3]
            good = beside.get(left)
            if good is None:
                if len(beside) >= CACHE:
                    beside.clear()
                good = beside[left] = self.fits(left, token[0])
            if good:
                last[i + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"no token ends at {at} of {text[max(0, at - 40):at]!r}")
            out.append(token)
            at -= token[1]
        return out[::-1]

    def with_unknown(self, text: str, found) -> Iterator:
        """The automaton's matches in order of their ends, and a token of bytes for each character without a piece."""
        at = 0
        for i, token in found:
            while at < i or at == i and text[at] not in self.chars:
                if text[at] not in self.chars:
                    yield at, self.as_bytes(text[at])
                at += 1
            yield i, token
        for k in range(at, len(text)):
            if text[k] not in self.chars:
                yield k, self.as_bytes(text[k])

    def as_bytes(self, char: str) -> tuple:
        if char not in self.unseen:
            if len(self.unseen) >= CACHE:
                self.unseen.clear()
            self.unseen[char] = self.token(char, [self.by_byte.get(b, self.unknown) for b in char.encode()])
        return self.unseen[char]

    def pieces_text(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            out.append(self.shown.get(i, " ⁇ "))
        return "".join(out) + run.decode("utf-8", "replace")

    def __missing__(self, text: str) -> tuple[str, str]:
        if text in self.older:
            made = self.older[text]
        else:
            tokens = self.stretch(text)
            made = ",".join([t[4] for t in tokens]), "".join([t[5] for t in tokens])
        if len(text) <= LONGEST_CACHED:
            if len(self) >= CACHE:       # two generations: what is asked for again comes back from the older one
                self.older = dict(self)
                self.clear()
            self[text] = made
        return made

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def parts(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        return list(map(self.__getitem__, self.cut.findall(self.prefix + text.replace(" ", BLANK))))


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, built once a worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode_decode(df: DataFrame, model: str, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per row: token count and SHA-256 of the ids and of the text they decode to; with `ids` also the ids and the text.

    A null text counts as empty (no tokens, digests of the empty string).  Each row gives one row, repeated and null
    ids included; an empty table gives no rows.  Other columns are not read.  Work is linear in a text's length.
    """
    rows = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for piece, _, _ in pieces(batches):
            count, id_hash, text_hash, all_ids, decoded = [], [], [], [], []
            for value in piece.column("text").to_pylist():
                parts = own.parts(value or "")
                joined = ",".join([p[0] for p in parts])
                back = "".join([p[1] for p in parts])
                back = back[1:] if own.prefix and back.startswith(" ") else back
                count.append(joined.count(",") + 1 if parts else 0)
                id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    all_ids.append([int(i) for i in joined.split(",")] if parts else [])
                    decoded.append(back)
            cols = [piece.column("doc_id"), pa.array(count, pa.int64()), pa.array(id_hash, pa.string()),
                    pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>, decoded string" if ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
