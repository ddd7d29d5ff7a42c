"""Exact merge-type (BPE) encoding of whole texts into sentence pieces by backtracking, and decoding.

Merging always takes the best-scored adjacent pair, the leftmost of equals. Its result is the one sequence of pieces in
which every neighbouring pair survives when the two are merged again on their own. So no merge queue over a text is
needed: an Aho-Corasick automaton finds the longest piece at every position, pieces are taken from left to right, longest
first, as long as they agree with their left neighbour, and a bit field remembers the positions from which nothing fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import col, fresh, held, spans_of
from .packing import Remembered

BLANK = "▁"


class Followers(dict):
    """Whether a piece may follow ``last``: it may if the two survive when they are merged on their own."""

    def __init__(self, last: str, merged, room: list[int]):
        super().__init__()
        self.last, self.merged, self.room = last, merged, room

    def __missing__(self, piece: str) -> bool:
        fits = not self.last or self.merged(self.last + piece) == [self.last, piece]
        if self.room[0] > 0:
            self.room[0] -= 1
            self[piece] = fits
        return fits


class PieceEncoder:
    """Ids of whole texts. Memory is bounded: words and pairs are remembered while there is room."""

    def __init__(self, path: str, words: int = 500_000, pairs: int = 700_000, longest: int = 48):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        self.model = model = SentencePieceProcessor(model_file=path)
        whole = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(model.is_unused(i) for i in whole):
            raise ValueError("models with unused pieces are not supported")
        piece = {model.id_to_piece(i): i for i in whole}
        self.cost = {p: -model.get_score(i) for p, i in piece.items()}
        self.joined = {p[i: i + 2] for p in piece for i in range(len(p) - 1)}
        #: Single characters always count: one that is no piece itself is written as bytes.
        reachable = {p for p in piece if len(p) == 1 or self.merged(p) == [p]} | set("".join(piece))
        self.ids = {p: np.int32(piece[p]).tobytes() if p in piece else self.bytes_of(p) for p in reachable}
        self.matcher = ahocorasick.Automaton()
        #: A piece, its length, and the same of the next shorter piece that it begins with.
        chained: dict[str, tuple] = {}
        for p in sorted(reachable, key=len):
            chained[p] = (p, len(p), next((chained[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in chained), None))
            if len(p) > 1:
                self.matcher.add_word(p, chained[p])
        self.matcher.make_automaton()
        self.single = {p: c for p, c in chained.items() if len(p) == 1}
        room = [pairs]
        self.after = {p: Followers(p, self.merged, room) for p in ("", *reachable)}
        self.words = Remembered(self.word, words, longest)
        self.known = re.compile(f"[{re.escape(''.join(sorted(p for p in reachable if len(p) == 1)))}]{{1,{longest}}}")
        # Cuts that no piece crosses: before a blank that follows another sign, and around control signs.
        inner = set("".join(self.joined))
        alone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in inner)
        blank_starts = not any(b == BLANK != a for a, b in self.joined)
        self.split = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]" if blank_starts and alone else
                                f"{BLANK}*[^{BLANK}]+|{BLANK}+" if blank_starts else r"(?s).+")

    def bytes_of(self, char: str) -> bytes:
        """Byte pieces of a sign outside the vocabulary, or the unknown id in a model without them."""
        ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in char.encode()]
        return np.array(ids if all(map(self.model.is_byte, ids)) else [self.model.unk_id()], np.int32).tobytes()

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost of equals."""
        parts, cost, never = list(text), self.cost.get, float("inf")
        pairs = [cost(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            at = pairs.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = cost(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = cost(parts[at] + parts[at + 1], never)
        return parts

    def stretch(self, text: str) -> list[str]:
        """Pieces of a text without inner cut, by backtracking."""
        longest = {at: self.single[c] for at, c in enumerate(text)}
        longest.update({end + 1 - found[1]: found for end, found in self.matcher.iter(text)})  # the longest comes last
        longest[len(text)] = None
        viable, after = bytearray(b"\x01") * (len(text) + 1), self.after
        taken: list[tuple] = []
        at, piece, fits = 0, longest.get(0), after[""]
        while at < len(text):
            while piece is not None and not (viable[at + piece[1]] and fits[piece[0]]):
                piece = piece[2]
            if piece is not None:
                taken.append(piece)
                at += piece[1]
                fits, piece = after[piece[0]], longest[at]
            elif taken:
                viable[at] = 0
                piece = taken.pop()
                at -= piece[1]
                fits = after[taken[-1][0] if taken else ""]
            else:
                raise ValueError(f"no merge order gives {text[:40]!r}")
        return [piece[0] for piece in taken]

    def word(self, word: str) -> bytes:
        """Ids of a word: one with unknown signs, or a long one, is cut wherever no piece holds the two signs that meet."""
        if self.known.fullmatch(word):
            return b"".join([self.ids[piece] for piece in self.stretch(word)])
        cuts = [i for i, pair in enumerate(map("".join, zip(word, word[1:])), 1) if pair not in self.joined]
        out: list[bytes] = []
        for first, last in zip([0, *cuts], [*cuts, len(word)]):
            part = word[first:last]
            if len(part) == 1:
                out.append(self.ids.get(part) or self.bytes_of(part))
            else:
                out += [self.ids[piece] for piece in self.stretch(part)]
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers; the model's own rules normalise it first."""
        return b"".join(map(self.words.__getitem__, self.split.findall(self.model.normalize(text))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def model_of(path: str):
    """The library's model alone, one for each worker process."""
    from sentencepiece import SentencePieceProcessor
    return held(("piece-model", path), lambda: SentencePieceProcessor(model_file=path))


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return held(("pieces", path), lambda: PieceEncoder(path))


def _added(df: DataFrame, source: str, outs: dict[str, pa.DataType], convert) -> DataFrame:
    """``df`` with more columns; ``convert`` turns a slice of ``source`` into their arrays. Slices hold about 4 MB."""
    names = df.columns
    if taken := {o.lower() for o in outs} & {n.lower() for n in names}:
        raise ValueError(f"{sorted(taken)} is taken: name another output column")
    at = names.index(source)
    held_as = [fresh([*names, *outs], f"_c{i}") for i in range(len(names))]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            units = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
            ends = np.concatenate([[0], np.cumsum(units.fill_null(0).to_numpy(zero_copy_only=False))])
            for a, b in spans_of(ends, 4_000_000):
                part = batch.slice(a, b - a)
                made = [c.cast(k) for c, k in zip(convert(part.column(at)), outs.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*held_as, *outs])

    kinds = [f"`{o}` {'string' if k == pa.string() else 'array<int>'}" for o, k in outs.items()]
    schema = ", ".join([*[f"`{h}` {f.dataType.simpleString()}" for h, f in zip(held_as, df.schema)], *kinds])
    made = df.toDF(*held_as).mapInArrow(work, schema)
    return made.select(*[col(h).alias(n) for h, n in zip(held_as, names)], *map(col, outs))


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids",
                  decoded_out: str | None = None) -> DataFrame:
    """Add the ids of every whole text (array of int) as the model's library gives them, without begin or end ids.

    ``decoded_out`` names a second column, the text that the library decodes from these ids (else use ``decode_pieces``).
    Null and empty texts have no ids (an empty array). Rows keep their order, copies and other columns; an empty table
    gives no row. An output name that is taken is an error. Models with user-defined or unused pieces are not supported.
    """
    def ids_of(texts: pa.Array) -> list[pa.Array]:
        of = encoder(model_path)
        rows = [of.packed(t or "") for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(rows), np.int32))
        return [ids] if decoded_out is None else [ids, decoded(of.model, ids)]

    outs = {out: pa.list_(pa.int32())} | ({} if decoded_out is None else {decoded_out: pa.string()})
    return _added(docs, text_col, outs, ids_of)


def decoded(model, ids: pa.ListArray) -> pa.Array:
    """Texts of lists of ids by the library; null and empty lists give the empty text."""
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    return pa.array([model.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(ends[:-1], ends[1:])], pa.string())


def decode_pieces(coded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the model's library decodes from the ids; null ids give the empty text."""
    return _added(coded, ids_col, {out: pa.string()}, lambda ids: [decoded(model_of(model_path), ids)])
