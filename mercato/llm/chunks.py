"""Encode texts piece by piece with bounded caches.

A byte-level BPE never merges across pre-tokens, and every step from a
non-space to a space starts a new pre-token.  So a text may be cut there and
each cut piece encoded alone, once per distinct piece: the same ids at a small
part of the work.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, repeat

import regex

# The pre-token pattern of the byte-level tokenizer, and the
# characters that its \s stands for.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"

RUNS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Runs that keep a text from the plain cut at single blanks and line ends.
DOUBLE = ("  ", "\n\n", " \n", "\n ")
#: Other blanks, which keep it, too, right before a single blank or line end.
OTHERS = [x for x in map(chr, range(0x3001)) if x not in " \n" and re.match(f"[{BLANK}]", x)]
OTHER_RUN = re.compile(f"[{''.join(OTHERS)}][ \n]")
#: Characters of text cut, looked up and given back at a time.
SLICE_CHARS = 4_000_000
#: Longer pieces are encoded but not kept.
KEPT_CHARS = 256
#: Characters below it are cut into pre-tokens here, as every version of Unicode in use has the same letters there.
FAR = "\u0530"
#: So is general punctuation.
MARKS = range(0x2000, 0x2070)
#: Classes of characters: those of a run belong together.
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """``texts`` in slices of bounded length (one text at least), null as empty."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def column_slices(column, size: int) -> Iterator[list[str]]:
    """Texts of an Arrow column in slices of about ``size`` bytes (one text at least), null as empty; one slice is unpacked at a time."""
    for part in column_parts(column, size):
        yield [text or "" for text in part.to_pylist()]


def column_parts(column, size: int) -> Iterator:
    """Slices of an Arrow column of texts of about ``size`` bytes (one text at least), as they stand."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield column.slice(at, upto - at)
        at, before = upto, int(ends[upto - 1])


def column_bytes(column):
    """The bytes of an Arrow column of texts one after another, null as empty, and where each begins (with the end)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.string()), "")
    column.validate(full=True)
    _, places, raw = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


@cache
def _class_table():
    """The class of each code point up to the last blank."""
    import numpy as np

    table = np.full(0x3001, UNKNOWN, np.uint8)
    for code, x in enumerate(map(chr, range(len(table)))):
        if re.match(f"[{BLANK}]", x):
            table[code] = SPACE
        elif x < FAR or code in MARKS:
            table[code] = LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
    return table


def byte_classes(data):
    """The class of the character that each byte of UTF-8 belongs to; ``UNKNOWN`` beyond the table."""
    import numpy as np

    table = _class_table()
    single = np.full(256, UNKNOWN, np.uint8)
    single[:128] = table[:128]
    classes = single[data]
    lead = np.flatnonzero((data >= 0xC0) & (data < 0xE4))  # the table ends within those after 0xE3
    first = data[lead]
    for at, size in ((lead[first < 0xE0], 2), (lead[first >= 0xE0], 3)):
        code = data[at].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for beside in range(1, size):
            code = code << 6 | data[at + beside] & 0x3F
        found = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], UNKNOWN)
        for beside in range(size):
            classes[at + beside] = found
    return classes


def pre_token_starts(data, places, classes):
    """Marks of the bytes where the pre-tokens of ``PRE_TOKEN`` begin in texts of UTF-8 that begin at ``places`` (with the end).

    What stands between blanks is left whole, with the space before it, if it has characters of ``UNKNOWN`` class.
    """
    import numpy as np

    first = np.zeros(len(data) + 1, bool)
    first[places] = True
    starts = first.copy()
    starts[1:-1] |= classes[1:] != classes[:-1]
    # The last of the blanks before something else is a token of its own, or its beginning if it is a space.
    runs = np.flatnonzero(starts[:-1])
    after = runs[1:][(classes[runs[1:]] != SPACE) & (classes[runs[:-1]] == SPACE) & ~first[runs[1:]]]
    starts[after[data[after - 1] == 0x20]] = False
    blank = after - 1
    for _ in range(2):  # to the first byte of a longer blank
        blank = blank - (data[blank] & 0xC0 == 0x80)
    starts[blank] = True
    # 's 't 'm 'd 're 've 'll where a token begins.
    quote = np.flatnonzero(data == 0x27)
    quote = quote[starts[quote] & ~first[quote + 1]]
    one = np.isin(data[quote + 1], list(b"stmd"))
    longer = quote[~one & ~first[quote + 2]]
    pair = data[longer + 1].astype(np.int64) << 8 | data[longer + 2]
    longer = longer[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    for found, size in ((quote[one], 2), (longer, 3)):
        starts[found + 1] = False
        starts[found + size] = True
    unknown = runs[classes[runs] == UNKNOWN]
    if len(unknown):
        space = np.append(classes == SPACE, True)
        stops = np.flatnonzero(first | space)
        begins = np.flatnonzero(~space[:-1] & (first[:-1] | np.roll(space, 1)[:-1]))
        begins = begins[np.unique(np.searchsorted(begins, unknown, "right") - 1)]
        clear(starts, begins, stops[np.searchsorted(stops, begins, "right")])
    return starts


def clear(marks, begins, ends) -> None:
    """Take away the marks between ``begins`` and ``ends`` (of ranges apart), both left out."""
    import numpy as np

    if not len(begins):
        return
    inside = np.zeros(len(marks) + 1, np.int8)
    inside[begins + 1] += 1
    inside[ends] -= 1
    marks &= np.cumsum(inside[:-1], dtype=np.int8) == 0


class ChunkTable:
    """Values of text pieces, kept between texts.

    ``encode`` gives the values of a list of pieces; ``specials`` are strings
    that stand for one value wherever they occur; ``frequent`` are values known
    beforehand, by piece as ``cut`` gives it.  About ``limit`` pieces are kept:
    when there are more, those the current slice doesn't use go.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list],
        specials: dict[str, object],
        limit: int = 700_000,
        frequent: dict[str, object] | None = None,
    ):
        self.encode, self.specials, self.limit = encode, specials, limit
        self.frequent = frequent or {}
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.heads: dict[str, object] = {}  # by the piece as it stands
        self.tails: dict[str, object] = dict(self.frequent)  # by the piece without its leading blank

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces as they stand, and after them pieces whose leading blank is left out."""
        if self.special and self.special.search(text):
            heads, at = [], 0
            for found in self.special.finditer(text):
                heads += [*RUNS.findall(text[at : found.start()]), found[0]]
                at = found.end()
            return heads + RUNS.findall(text[at:]), []
        if any(double in text for double in DOUBLE):
            return RUNS.findall(text), []
        if any(other in text for other in OTHERS) and OTHER_RUN.search(text):
            return RUNS.findall(text), []
        tails = text.replace("\n", " \n").split(" ")
        return [tails[0]] if tails[0] else [], tails[1:]

    def _fill(self, table: dict, used: set[str], whole: Callable[[str], str], fixed: dict) -> dict:
        missing = list(used.difference(table))
        if len(table) + len(missing) > self.limit + len(fixed):
            table = fixed | {piece: table[piece] for piece in used.intersection(table) if len(piece) <= KEPT_CHARS}
        table.update(zip(missing, self.encode([whole(piece) for piece in missing]), strict=True))
        return table

    def values(self, texts: Iterable[str]) -> Iterator[Iterator]:
        """For each of ``texts`` (a slice) the values of its pieces in order."""
        cuts = [self.cut(text) for text in texts]
        self.heads = self._fill(self.heads, set().union(*(heads for heads, _ in cuts)), str, self.specials)
        self.heads.update(self.specials)
        self.tails = self._fill(self.tails, set().union(*(tails for _, tails in cuts)), with_blank, self.frequent)
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        for heads, tails in cuts:
            yield chain(map(head, heads), map(tail, tails))


def pre_tokens(piece: str) -> list[str]:
    """Pre-tokens of a piece; most pieces are a blank and letters, which is one."""
    return [piece] if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) else PRE_TOKEN.findall(piece)


def with_blank(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def library_encoder(tokenizer, newline: int, typecode: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of pieces by the tokenizers library, as bytes of an array of ``typecode``.

    The distinct pre-tokens go to the library in one text with line ends
    between them, which are pre-tokens (and one id) of their own.
    """
    import numpy as np

    kept: dict[str, bytes] = {}
    width = np.dtype(typecode).itemsize

    def alone(words: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, typecode).tobytes() for x in found]

    def encode(pieces: list[str]) -> list[bytes]:
        cut = [pre_tokens(piece) for piece in pieces]
        if len(kept) > 200_000:
            kept.clear()
        words = list(set(chain.from_iterable(cut)).difference(kept))
        joined = [word for word in words if not word.isspace()]
        if joined:
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(joined)], add_special_tokens=False)[0].ids, typecode)
            ends = [*(np.flatnonzero(ids == newline) * width).tolist(), len(ids) * width]
            if len(ends) == len(joined):
                raw = ids.tobytes()
                kept.update((w, raw[a:b]) for w, a, b in zip(joined, [0, *(x + width for x in ends)], ends))
            else:
                kept.update(zip(joined, alone(joined)))
        blank = [word for word in words if word.isspace()]
        kept.update(zip(blank, alone(blank)))
        return [kept[x[0]] if len(x) == 1 else b"".join(map(kept.__getitem__, x)) for x in cut]

    return encode


def load_library(spec: str):
    """The library's tokenizer of a .json description, without truncation or padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Pieces:
    """Ids of texts, each distinct piece encoded once while it is kept; the classes below say how.

    A slice of texts is cut into pieces at once, as arrays of bytes, and only
    its distinct ones are looked up.  A piece is one of the ``specials`` (an
    added token with its id), a pre-token or what ``pre_token_starts`` leaves
    whole.  Pieces are numbered; their ids stand in one array, from which those
    of a slice are gathered at once.  When the pieces kept take more than
    ``limit`` bytes, all go before the next slice (if no class below keeps some).
    """

    #: Bytes that a kept piece takes beside its text and ids: its entry, number and place.
    BESIDE = 170
    #: Pieces whose ids are gathered together.
    TOGETHER = 200_000

    def __init__(self, specials: dict[bytes, int], code: str, limit: int):
        self.specials, self.code, self.limit = specials, code, limit
        self.special = re.compile(b"|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
        self._forget()

    def _shrink(self) -> None:
        self._forget()

    def encode_words(self, words: list[bytes]):
        """The ids of pre-tokens without line ends, and where those of each begin and how many they are."""
        raise NotImplementedError

    def encode_others(self, pieces: list[bytes]):
        """The same of any pieces."""
        raise NotImplementedError

    def _forget(self) -> None:
        import numpy as np

        self.known, self.held = len(self.specials), 0
        self.flat = np.array(list(self.specials.values()), self.code)
        self.begin, self.size = np.arange(self.known), np.ones(self.known, np.int64)
        self.numbers = {piece: i for i, piece in enumerate(self.specials)}

    def _learn(self, new: list[bytes], encode: Callable) -> None:
        """Encode and number new pieces."""
        import numpy as np

        if not new:
            return
        ids, begin, size = encode(new)
        self.numbers.update(zip(new, range(self.known, self.known + len(new))))
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.known += len(new)
        self.held += sum(map(sys.getsizeof, new)) + self.BESIDE * len(new) + ids.nbytes

    def _specials(self, data, places):
        """Where added tokens begin and end."""
        import numpy as np

        raw = data.tobytes()
        if not any(special in raw for special in self.specials):
            return np.zeros((2, 0), np.int64)
        ends = places.tolist()
        spans = [found.span() for a, b in zip(ends, ends[1:]) for found in self.special.finditer(raw, a, b)]
        return np.array(spans, np.int64).reshape(-1, 2).T

    def _pieces(self, column):
        """The numbers of the pieces of an Arrow column of texts, and how many each text has."""
        import numpy as np
        import pyarrow as pa

        data, places = column_bytes(column)
        classes = byte_classes(data)
        begins, ends = self._specials(data, places)
        marks = pre_token_starts(data, np.concatenate([places, begins, ends]), classes)
        clear(marks, begins, ends)
        starts = np.flatnonzero(marks[:-1])
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        distinct, indices = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        numbers = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int32, len(distinct))
        if (numbers < 0).any():
            # Pieces with line ends or characters of unknown class, by the first of these.
            odd = (classes == UNKNOWN) | (data == 10)
            odd[1:] &= marks[1:-1] | ~odd[:-1]
            other = np.zeros(len(distinct), bool)
            other[indices[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1]] = True
            for new, encode in ((~other & (numbers < 0), self.encode_words), (other & (numbers < 0), self.encode_others)):
                numbers[new] = np.arange(self.known, self.known + new.sum())
                self._learn([distinct[i] for i in np.flatnonzero(new).tolist()], encode)
        return numbers[indices], np.diff(np.searchsorted(starts, places))

    def _gathered(self, numbers):
        """The ids of pieces, one after another."""
        import numpy as np

        out = [np.zeros(0, self.code)]
        for start in range(0, len(numbers), self.TOGETHER):
            some = numbers[start : start + self.TOGETHER]
            size = self.size[some]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.begin[some] - ends + size, size) + np.arange(ends[-1])])
        return np.concatenate(out)

    def ids(self, texts):
        """The ids of all ``texts`` (a list or an Arrow column) in one array, and how many each has."""
        import numpy as np
        import pyarrow as pa

        if self.held > self.limit:
            self._shrink()
        numbers, counts = self._pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        total = np.concatenate([[0], np.cumsum(self.size[numbers])])
        return self._gathered(numbers), np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


class PieceIds(Pieces):
    """Ids of texts by the tokenizers library."""

    def __init__(self, tokenizer, code: str, limit: int = 192 << 20):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.newline = tokenizer.token_to_id("Ċ")
        self.letters = np.array(list(map(ord, byte_letters())), "<u2")
        # The same model on words given by their bytes' letters, with line ends between them.
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(chr(self.letters[10]), "isolated")
        super().__init__({x.content.encode(): i for i, x in tokenizer.get_added_tokens_decoder().items()}, code, limit)

    def encode_words(self, words: list[bytes]):
        """They go to the library's model in one text, as the letters that stand for their bytes, with line ends between them."""
        import numpy as np

        letters = self.letters[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids if words else [], self.code)
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids))[: len(words)]
        begin = np.append(0, ends + 1)[: len(words)]
        return ids, begin, ends - begin

    def encode_others(self, pieces: list[bytes]):
        import numpy as np

        found = self.tokenizer.encode_batch_fast([piece.decode() for piece in pieces], add_special_tokens=False)
        size = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(x.ids for x in found), self.code), np.cumsum(size) - size, size
