"""SentencePiece (merge type) encoding by backtracking, and decoding.

A text is normalised (space becomes U+2581, one is put in front) and cut where no piece of the vocabulary can
span the cut, so that units are encoded on their own.  A unit is encoded without running the merges: one pass of an
Aho-Corasick automaton of the pieces over the unit gives the longest piece at every place, a piece is accepted if
re-merging it with the piece before gives just these two again, and a bitfield holds the places from which no rest
fits, so that the search steps back over each of them once at most.

Nulls: a null text counts as empty, which has the end id only and decodes to "".  Very long texts are cut in
units; the time of a unit without a cut is in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import keeps, ship, slim

META = "▁"
#: Units in a generation of a worker's store; it bounds memory and changes no result.
STORE_UNITS, STORE_PAIRS = 400_000, 300_000
#: Units that are encoded, then decoded, together.
RUN_UNITS = 4096


class Encoder:
    """Encodes and decodes as the library does for the merge-type model in model_bytes."""

    def __init__(self, model_bytes: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model_bytes)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not m.trainer_spec.byte_fallback:
            raise ValueError("needs a merge-type model with byte fallback and without a character map")
        self.dummy = n.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.piece = {i: p for p, i in self.ids.items()}
        self.shown = {i: p.replace(META, " ") for i, p in self.piece.items()}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.control = {i for i, p in enumerate(m.pieces) if p.type == 3}
        self.end = next((i for i, p in enumerate(m.pieces) if p.piece == (m.trainer_spec.eos_piece or "</s>")), 2)
        self.chars = {p for p in self.ids if len(p) == 1}
        if any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("a piece spans two words")
        self._merged: dict[str, tuple[str, ...]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self.trie = ahocorasick.Automaton()
        for p in self.ids:
            if self.merge(p) == (p,):  # other pieces never come out of merging
                self.trie.add_word(p, len(p))
        #: the longest shorter piece that begins a piece, or ""
        self.prefixes = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if self.trie.exists(p[:k])), "") for p in self.trie}
        self.trie.make_automaton()
        inside = "".join(map(re.escape, sorted(self.chars)))
        self.unknown, self.runs = re.compile(f"[^{inside}]"), re.compile(f"[{inside}]+|[^{inside}]+")
        single = "".join(c for c in sorted({c for p in self.ids for c in p}) if c != META)
        self.unit = re.compile(f"{META}*[^{META}\\n]+|{META}+|\\n") if "\n" not in single else re.compile(f"{META}*[^{META}]+|{META}+")

    def merge(self, s: str) -> tuple[str, ...]:
        """Merges the best pair, the first of equals, until none is in the vocabulary."""
        parts, score = list(s), self.score
        never = -float("inf")
        worth = [score.get(x + y, never) for x, y in zip(parts, parts[1:])]
        while worth and (best := max(worth)) != never:
            i = worth.index(best)
            joined = parts[i] + parts.pop(i + 1)
            parts[i] = joined
            del worth[i]
            if i:
                worth[i - 1] = score.get(parts[i - 1] + joined, never)
            if i < len(worth):
                worth[i] = score.get(joined + parts[i + 1], never)
        return tuple(parts)

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text of two adjacent pieces gives these two."""
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > STORE_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merge(a + b) == key
        return known

    def longest_pieces(self, s: str) -> list[int]:
        """Length of the longest piece from each place of s on; 0 where there is none."""
        out = [0] * len(s)
        for last, k in self.trie.iter(s):  # of pieces that begin at one place the longest ends last
            out[last - k + 1] = k
        return out

    def known(self, s: str) -> list[str]:
        """The pieces of a run of characters of the vocabulary."""
        if s in self.prefixes:
            return [s]
        out: list[str] = []
        n, fits, prefixes, longest = len(s), self._fits, self.prefixes, self.longest_pieces(s)
        failed = bytearray((n >> 3) + 1)  # bit i: the rest from i on has failed
        pos, piece = 0, s[: longest[0]]
        while pos < n:
            end = pos + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                if not out:
                    fit = True
                elif (fit := fits.get((out[-1], piece))) is None:
                    fit = self.fits(out[-1], piece)
                if fit:
                    out.append(piece)
                    pos, piece = end, s[end : end + longest[end]] if end < n else ""
                    continue
            piece = prefixes[piece]
            while not piece:  # nothing shorter: the rest from here on fails, so the piece before has to change
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(f"no encoding of {s!r}")
                last = out.pop()
                pos -= len(last)
                piece = prefixes[last]
        return out

    def encode_unit(self, unit: str) -> list[int]:
        ids = self.ids
        if self.unknown.search(unit) is None:
            return [ids[p] for p in self.known(unit)]
        out: list[int] = []
        for run in self.runs.findall(unit):
            if self.unknown.match(run):  # spelt in bytes; nothing merges across it
                out += [self.byte[b] for b in run.encode("utf-8", "surrogatepass")]
            else:
                out += [ids[p] for p in self.known(run)]
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall((META if self.dummy else "") + text.replace(" ", META))

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def decode_unit(self, ids: list[int]) -> str:
        """decode() of ids inside a text; pieces only, in most cases."""
        try:
            return "".join([self.shown[i] for i in ids])
        except KeyError:
            return self.decode(ids, first=False)

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Pieces joined; bytes that are no UTF-8 become U+FFFD; the space put in front goes, control ids are empty."""
        out, raw, begun = [], bytearray(), not first
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                begun = True
            if i is None or i in self.control:
                continue
            p = " ⁇ " if i == self.unk else self.piece[i]
            if not begun and self.dummy and p.startswith(META):
                p = p[1:]
            begun = True
            out.append(p.replace(META, " "))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """One U+FFFD for each byte that begins no valid character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for k in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Kept(dict):
    """Values by unit, worked out when missing; of two generations, so that frequent units stay and memory is bounded."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, unit: str) -> str:
        value = self.older.get(unit)
        if value is None:
            value = self.work(unit)
        if len(self) >= STORE_UNITS:
            self.older = dict(self)
            self.clear()
        self[unit] = value
        return value


class _Store:
    """Ids by unit.  Each unit is decoded again when it is encoded; odd has those that do not decode to themselves."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.odd: dict[str, str] = {}
        self.ids = _Kept(self._ids)

    def _ids(self, unit: str) -> str:
        ids = self.encoder.encode_unit(unit)
        decoded = self.encoder.decode_unit(ids)
        if decoded != unit.replace(META, " "):
            self.odd[unit] = decoded
        return sys.intern(str(ids[0])) if len(ids) == 1 else " ".join(map(str, ids))

    def decoded(self, units: list[str]) -> str:
        """The text that the ids of units, just encoded, decode to."""
        if not self.odd or self.odd.keys().isdisjoint(units):
            return "".join(units).replace(META, " ")
        text = "".join([self.odd.get(u, u.replace(META, " ")) for u in units])
        if len(self.odd) >= STORE_UNITS:  # what was encoded before is encoded and decoded again when met again
            self.odd.clear()
            self.ids.clear()
            self.ids.older = {}
        return text


_STORES: dict[bytes, _Store] = {}
keeps(__name__, _STORES)


def _store(model: bytes) -> _Store:
    key = hashlib.sha256(model).digest()
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = _Store(Encoder(model))
    return _STORES[key]


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text", end: bool = True, keep: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row; with keep also ids (array) and decoded (string).

    model: the model's bytes, read once by the caller and sent with the function (a vocabulary's fixed size).
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(sent.value)
        e, get_ids, tail = store.encoder, store.ids.__getitem__, f" {store.encoder.end}" if end else ""

        def encoded(units: list[str]) -> tuple[str, str]:
            """Ids and what they decode to; bytes of one character never lie in two units, so units decode on their own."""
            ids, texts = [], []
            for i in range(0, len(units), RUN_UNITS):
                part = units[i : i + RUN_UNITS]
                ids.append(" ".join(map(get_ids, part)))
                texts.append(store.decoded(part))
            return (" ".join(ids) + tail).lstrip(" "), "".join(texts)

        for batch in batches:
            n, sha, decoded_sha, all_ids, all_texts = [], [], [], [], []
            for value in batch.column(1):
                units = e.units(value.as_py() or "")
                ids, decoded = encoded(units)
                decoded = decoded[1:] if e.dummy and units else decoded
                n.append(ids.count(" ") + 1 if ids else 0)
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if keep:
                    all_ids.append(list(map(int, ids.split())))
                    all_texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(id_col, F.col(text)).mapInArrow(slim(run, __name__), schema)
