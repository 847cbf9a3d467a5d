"""SentencePiece encoding by backtracking, and decoding.

Merging starts from characters and joins, again and again, the two neighbours that make the
piece of the best score.  The result is the one sequence of pieces in which every two
neighbours are *compatible*: their own characters, merged anew, give these two pieces again.
So a text is encoded from the left, without a queue of merges: an Aho-Corasick automaton of all
pieces gives the longest piece that starts at each place; the encoder takes it, or the next
shorter one, if it is compatible with the piece before it; where none is, the place is marked in a bitfield of
failed positions and the encoder goes back by one piece.  No failed position is entered twice,
so time is linear.

Facts of the vocabulary, checked when it is loaded, let texts be cut with the same result: no piece has
a space mark behind another character (cut before a word's space mark), and no piece has a
character that isn't a piece itself (cut at unknown characters, which become bytes).  A vocabulary
without the first is encoded in whole runs of known characters.  Each worker remembers the distinct words that it has encoded.

Decoding is the library's own.  Defined cases: null text is empty, without ids; very long texts
are encoded whole, in steps that end at such cuts; repeated rows and null ids are rows as any; an empty table gives an empty
one; other columns stay, but for those of the results' names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodegrid.llm.arrow import map_arrow, with_columns

SPACE = "▁"
#: Distinct words, and pairs of neighbours, that a worker remembers.
CACHE_WORDS, CACHE_PAIRS = 400_000, 500_000
#: Characters of words that are not remembered.
LONG = 100
#: Characters taken at a time from a text.
STEP = 1 << 20


class Vocabulary:
    """The pieces of a merge-type model file that need no normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = proto.ModelProto.SentencePiece
        rules, made = model.normalizer_spec, model.trainer_spec
        other = {p.type for p in model.pieces} - {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}
        if made.model_type != made.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not made.byte_fallback or made.treat_whitespace_as_suffix or other:
            raise ValueError(f"{path}: not a merge-type model with byte fallback and without normalization")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError(f"{path}: a character of a piece is no piece")
        self.characters = {p for p in self.ids if len(p) == 1}
        # Words: where no piece goes on over the border of a word, words are encoded each for itself.
        cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        bare = re.escape("".join(chr(i) for i in range(128) if chr(i) not in self.characters))
        word = f"{SPACE}*[^{SPACE}{bare}]+|{SPACE}+|[{bare}]+"
        self.words = re.compile(word if cuts else "(?s:.+)")
        self.border = re.compile(f"(?<!{SPACE})(?={SPACE})") if cuts else None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole, parts = [], {}
        for p in self.ids:
            last: list[tuple[str, str]] = []
            if self.merged(p, last) == [p]:  # no text ends up as another piece
                whole.append(p)
                parts[p] = last[-1] if last else None
        self._edges(whole, parts)
        for p in whole:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(whole)
        #: The longest piece that a piece starts with, but for itself.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in whole}

    def merged(self, text: str, last: list[tuple[str, str]] | None = None) -> list[str]:
        """The pieces of a short text, by merging: best score first, then the leftmost; ``last`` gets the pairs."""
        now, score = list(text), self.score
        while len(now) > 1:
            best, at = None, -1
            for i in range(len(now) - 1):
                s = score.get(now[i] + now[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if last is not None:
                last.append((now[at], now[at + 1]))
            now[at : at + 2] = [now[at] + now[at + 1]]
        return now

    def _edges(self, whole: list[str], parts: dict[str, tuple[str, str] | None]) -> None:
        """What is at either end of each piece while it is merged: symbols, and the score of the merge that takes each in.

        ``plain``: pieces for which these tell when: each merge has a score of its own, below those of its parts.
        """
        times: dict[float, int] = {}
        for s in self.score.values():
            times[s] = times.get(s, 0) + 1
        self.plain: set[str] = set()
        self.ends: tuple[dict, dict] = {}, {}
        for p in sorted(whole, key=len):
            pair, own = parts[p], self.score[p]
            if pair is None:
                self.plain.add(p)
            elif times[own] == 1 and all(q in self.plain and (len(q) == 1 or self.score[q] > own) for q in pair):
                self.plain.add(p)
            if p in self.plain:
                for side in (0, 1):
                    below = self.ends[side][pair[side]][:-1] + [(pair[side], own)] if pair else []
                    self.ends[side][p] = [*below, (p, -math.inf)]

    def _border_holds(self, left: str, right: str) -> bool:
        """If no merge joins the two while their own characters are merged: only what stands at the border counts."""
        a, b, i, j, score = self.ends[1][left], self.ends[0][right], 0, 0, self.score
        while True:
            (x, up), (y, down) = a[i], b[j]
            s = score.get(x + y)
            if s is not None and s > up and s >= down:  # of equals the leftmost is first
                return False
            if up >= down and i < len(a) - 1:
                i += 1
            elif j < len(b) - 1:
                j += 1
            else:
                return True

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            plain = left in self.plain and right in self.plain
            found = self.pairs[pair] = self._border_holds(left, right) if plain else self.merged(left + right) == [left, right]
        return found

    def encode_known(self, text: str) -> list[str]:
        """The pieces of a text of known characters, by backtracking."""
        if text in self.shorter:
            return [text]
        shorter, compatible, end = self.shorter, self.compatible, len(text)
        failed: bytearray | None = None
        out: list[str] = []
        ahead = self.automaton.iter_long(text)  # one longest piece after another, while each is taken
        last, at, piece = None, 0, next(ahead)[1]
        while at < end:
            while piece is not None:
                to = at + len(piece)
                if (failed is None or not failed[to >> 3] & 1 << (to & 7)) and (last is None or compatible(last, piece)):
                    break
                piece, ahead = shorter[piece], None
            if piece is not None:
                out.append(piece)
                last, at = piece, to
                if at < end:
                    ahead = ahead or self.automaton.iter_long(text, at)
                    piece = next(ahead)[1]
                continue
            if last is None:
                raise ValueError(f"no encoding of {text[:80]!r}")
            failed = failed or bytearray(len(text) // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            out.pop()
            at -= len(last)
            last, piece = out[-1] if out else None, shorter[last]
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word: of its runs of known characters, and the bytes of the others."""
        ids = self.ids
        if self.characters.issuperset(word):
            return [ids[p] for p in self.encode_known(word)]
        out: list[int] = []
        run = 0
        for i, c in enumerate(word):
            if c not in ids:
                out += [ids[p] for p in self.encode_known(word[run:i])] if i > run else []
                out += [self.bytes[b] for b in c.encode()]
                run = i + 1
        return out + ([ids[p] for p in self.encode_known(word[run:])] if run < len(word) else [])


class Encoder:
    """Encodes texts, word by word where the vocabulary lets it."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}

    def _learn(self, words: list[str]) -> list[str]:
        """Encode the words that aren't known; those too long to be kept."""
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS // 2:
            self.known, self.older, fresh = {}, self.known, set(words)
        for word in fresh:
            found = self.older.get(word)
            if found is None:
                ids = tuple(self.vocabulary.encode_word(word))
                found = (ids, ",".join(map(str, ids)))
            self.known[word] = found
        return [w for w in fresh if len(w) > LONG]

    def _steps(self, text: str) -> Iterator[str]:
        """The escaped text, in steps that end at a border of words."""
        border, at = self.vocabulary.border, 0
        text = self.vocabulary.prefix + text.replace(" ", SPACE)
        while border is not None and len(text) - at > STEP and (cut := border.search(text, at + STEP)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> tuple[list[int], str]:
        """Ids of a text, and the SHA-256 of their decimal digits joined by commas."""
        ids: list[int] = []
        digest, comma = hashlib.sha256(), False
        for step in self._steps(text) if text else ():
            words = self.vocabulary.words.findall(step)
            long = self._learn(words)
            found = list(map(self.known.__getitem__, words))
            ids += chain.from_iterable(map(itemgetter(0), found))
            digest.update(("," * comma + ",".join(map(itemgetter(1), found))).encode())
            comma = True
            for word in long:
                del self.known[word]
        return ids, digest.hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Documents with ``ids``: their texts' pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = encoder(path)
            yield with_columns(batch, ids=pa.array([of(x.as_py() or "")[0] for x in batch.column(column)], pa.list_(pa.int32())))

    return _mapped(docs, run, "ids array<int>")


def decode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Documents with ``decoded``: the text of their ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            library = encoder(path).vocabulary.library
            yield with_columns(batch, decoded=pa.array([library.decode(x.as_py() or []) for x in batch.column(column)], pa.string()))

    return _mapped(docs, run, "decoded string")


def digests(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Documents with n_tokens, ids_sha256 and decoded_sha256 in place of the text: encoded, and decoded again from the ids."""

    def one(text: str) -> tuple[int, str, str]:
        of = encoder(path)
        ids, told = of(text)
        return len(ids), told, hashlib.sha256(of.vocabulary.library.decode(ids).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py() or "") for x in batch.column(column)]
            n, told, decoded = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))
            yield with_columns(batch, drop=(column,), n_tokens=n, ids_sha256=told, decoded_sha256=decoded)

    return _mapped(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", drop=(column,))


def _mapped(docs: DataFrame, run, made: str, drop: tuple[str, ...] = ()) -> DataFrame:
    new = {x.split()[0] for x in made.split(", ")}
    kept = [f for f in docs.schema.fields if f.name not in new and f.name not in drop]
    return map_arrow(docs, run, T.StructType(kept + T.StructType.fromDDL(made).fields))
