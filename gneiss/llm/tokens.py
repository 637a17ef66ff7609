"""Token counts and ids of whole texts, by the public tokenizers library.

Texts are cut at boundaries where the library itself always cuts, so equal pieces are encoded once
and a text of any length needs no more memory than its pieces. A null text is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_bytes, worker_state

#: Pieces whose encodings a worker remembers; beyond, it forgets all and starts anew.
CACHE_PIECES = 700_000
#: Characters up to which a piece is remembered, so that the memory is bounded in bytes too.
LONGEST_KEPT = 64
#: Bytes of pieces given to the library in one call.
ENCODE_BYTES = 1 << 18
#: Bytes from which a text is cut at safe boundaries in parts before it is split into pieces.
LONG_TEXT = 1 << 20
#: Characters of texts that are looked up at once: more calls cost less each, fewer words stay in the caches of the processor.
TOGETHER = 1 << 17


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once for each process."""
    from tokenizers import Tokenizer

    loaded = worker_state().setdefault("tokenizers", {})
    if path not in loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def encodings(kind: str, path: str, most: int | None = None) -> Encodings:
    """What this process remembers of pieces under a tokenizer file, from now on at most `most` a generation."""
    known = worker_state().setdefault("encoded", {})
    if (kind, path) not in known:
        known[kind, path] = Encodings(path, len, False) if kind == "count" else Encodings(path, lambda code: np.array(code.ids, dtype="<u4").tobytes(), True)
    known[kind, path].most = most or CACHE_PIECES
    return known[kind, path]


def balanced(pieces: list[str], most: int = ENCODE_BYTES) -> Iterator[list[str]]:
    """Batches of about `most` UTF-8 bytes each."""
    start = size = 0
    for i, piece in enumerate(pieces):
        n = len(piece) if piece.isascii() else len(piece.encode())
        if size and size + n > most:
            yield pieces[start:i]
            start, size = i, 0
        size += n
    if start < len(pieces):
        yield pieces[start:]


#: White space as the libraries' patterns have it; str.split() also takes the four separators of ODD.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD = re.compile("[\\x1c-\\x1f]")
SPACE = re.compile(f"[{WHITE}]+")
#: A text without this has only single spaces and line feeds, each between two other characters.
UNEVEN = re.compile(f"[{WHITE.replace(' ', '')}\\0](?<!\\n)|[ \\n][ \\n]|^[ \\n]|[ \\n]\\Z")
BYTE_LEVEL = re.compile(f"(?<=[^{WHITE}])(?=[ \\n][^{WHITE}])|(?<=[^{WHITE}]\\n)(?=[^{WHITE}])")
#: A letter that stays one letter in lower case and under composition.
LETTER = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]"
LETTERS = re.compile(f"{LETTER}+")
#: Between such a letter and a mark that no special token holds.
LETTER_MARK = re.compile(f"(?<={LETTER})(?=[!-;=?-@\\[-`{{}}~])(?=[^0-9])")


def byte_level_pieces(text: str) -> list[str]:
    """Cut before a single space or line feed between two non-spaces, and after such a line feed.

    The byte-level pattern joins such a space to the word after it and lets such a line feed stand alone,
    so no token crosses these cuts; special tokens hold neither.
    """
    if UNEVEN.search(text):
        return BYTE_LEVEL.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def spaced_pieces(text: str) -> list[str]:
    """The runs between white space, for patterns that drop it."""
    return [p for p in SPACE.split(text) if p] if ODD.search(text) else text.split()


class Encodings:
    """What a worker remembers of pieces, as `value` of the library's encoding.

    Two generations of at most `most` pieces (CACHE_PIECES): when the newer is full it becomes the older, so
    frequent pieces stay. A piece not met yet is cut at LETTER_MARK, where both patterns end a token,
    and only parts not met yet are encoded.
    """

    def __init__(self, path: str, value, fold: bool):
        self.library, self.value, self.fold = tokenizer(path), value, fold
        self.ends = word_ends(self.library) if fold else None
        self.new, self.old = {}, {}
        self.most = CACHE_PIECES

    def of(self, pieces: list[str]) -> list:
        missing = set(pieces).difference(self.new)
        if not missing:
            return list(map(self.new.__getitem__, pieces))
        if len(self.new) + len(missing) > self.most:
            self.old, self.new, missing = self.new, {}, set(pieces)
        self.learn(missing)
        found = list(map(self.new.__getitem__, pieces))
        for p in missing:
            if len(p) > LONGEST_KEPT:
                del self.new[p]
        return found

    def parts(self, piece: str) -> list[str]:
        xs = [piece] if piece.isalpha() else LETTER_MARK.split(piece)
        return [x.lower() if x.isascii() and "<" not in x else x for x in xs] if self.fold else xs

    def learn(self, missing: set[str]) -> None:
        new, old = self.new, self.old
        # Most are words of one part, themselves; `parts` holds the others.
        unknown, parts, fold = set(), {}, self.fold
        for p in missing:
            if p in old:
                new[p] = old[p]
            elif p.isalpha():
                x = p.lower() if fold and p.isascii() else p
                unknown.add(x)
                if x != p:
                    parts[p] = (x,)
            else:
                parts[p] = xs = self.parts(p)
                unknown.update(xs)
        unknown = unknown.difference(new)
        rest = unknown.difference(old)
        for x in unknown.difference(rest):
            new[x] = old[x]
        self.encode(rest)
        for p, xs in parts.items():
            if len(xs) > 1 or xs[0] != p:
                new[p] = b"".join(map(new.__getitem__, xs)) if self.fold else sum(map(new.__getitem__, xs))
        for x in unknown:
            if len(x) > LONGEST_KEPT and x not in missing:
                del new[x]

    def encode(self, unknown: set[str]) -> None:
        """Encode each part; words of LETTER alone go as one text and are told apart by the tokens that end words."""
        words = list(filter(LETTERS.fullmatch, unknown)) if self.ends is not None else []
        others = list(unknown.difference(words)) if words else list(unknown)
        for batch in balanced(words):
            ids = np.array(self.library.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(batch) or stops[-1] != 4 * len(ids):
                others += batch
                continue
            data, start = ids.tobytes(), 0
            for x, stop in zip(batch, stops, strict=True):
                self.new[x] = data[start:stop]
                start = stop
        for batch in balanced(others):
            for x, code in zip(batch, self.library.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.new[x] = self.value(code)


def word_ends(library) -> np.ndarray | None:
    """Which ids end a word, or None where the tokenizer's vocabulary does not mark them."""
    suffix = getattr(library.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(library.get_vocab_size(), dtype=bool)
    for token, i in library.get_vocab().items():
        ends[i] = token.endswith(suffix)
    return ends


def safe_parts(text: str, longest: int = LONG_TEXT, cut: re.Pattern = BYTE_LEVEL) -> Iterator[str]:
    """Parts of about `longest` characters, cut where `cut` matches, as the pieces of a text are.

    A run of letters without white space has no such place, as its merges may go through all of it.
    """
    start = 0
    while len(text) - start > longest:
        found = cut.search(text, start + longest)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text under a byte-level tokenizer file."""
    known = encodings("count", path)
    return np.array([sum(sum(known.of(byte_level_pieces(part))) for part in safe_parts(text)) if text else 0 for text in texts], dtype=np.int64)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """Columns `keep`, n_bytes, n_tokens, over_limit of every row; no shuffle, lengths only leave Python.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows each get a row, no rows give no rows. Columns
    besides `keep` are ignored, whatever their names.
    """
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__text"):
                column = batch.column("__text")
                texts = column.to_pylist()
                n_bytes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
                n_tokens = count_tokens(texts, path)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"],
                )

    return source.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")


def word_ids(text: str, path: str, most: int | None = None) -> bytes:
    """The ids of a text under a tokenizer file that drops white space, as little-endian 32-bit numbers.

    White space separates whatever that tokenizer makes, so the runs between it are encoded one by one.
    """
    known = encodings("ids", path, most)
    return b"".join(b"".join(known.of(spaced_pieces(part))) for part in safe_parts(text, cut=SPACE))


def word_ids_of(texts: list[str | None], path: str, most: int | None = None) -> Iterator[bytes]:
    """word_ids of each text, of whose pieces those of many texts are looked up, and encoded, at once.

    About TOGETHER characters go together; a text longer than LONG_TEXT goes alone, in its own parts.
    """
    known = encodings("ids", path, most)
    held: list[list[str]] = []
    size = 0

    def found() -> Iterator[bytes]:
        ids, start = known.of([piece for pieces in held for piece in pieces]), 0
        for pieces in held:
            yield b"".join(ids[start : start + len(pieces)])
            start += len(pieces)

    for text in texts:
        if held and size + len(text or "") > min(TOGETHER, LONG_TEXT):
            yield from found()
            held, size = [], 0
        if text and len(text) > LONG_TEXT:
            yield word_ids(text, path, most)
            continue
        held.append(spaced_pieces(text or ""))
        size += len(text or "")
    yield from found()
