"""Byte-level BPE by a tokenization automaton.

``compile_merges`` turns the merges of a tokenizer into a deterministic
automaton over tokens that accepts exactly the right tokenizations.  It starts
with one state that loops on every byte.  Each merge ``u v -> w``, in order,
inserts a gadget: the state after ``u`` is copied without the arc ``v``, arcs
``u`` go to the copy, and every state with an arc ``u`` gets an arc ``w`` to
where ``u v`` led.  A pre-token is encoded by following the arcs whose labels
spell it (there is one path only); ids are decoded by emitting their labels.

Arcs aren't stored state by state, which would be billions: a state is what it
was copied from, less one arc, and an arc ``w`` is there wherever its ``u`` was
when the merge came, so both are kept as one entry per merge and an arc is
looked up in a few steps.  Arcs once found stay in a table.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from mercato.llm.chunks import Pieces, byte_letters, column_slices, pre_tokens, slices
from mercato.llm.common import frugal

NEVER = 1 << 60
#: Ids decoded at a time (those of one row at least).
IDS = 500_000
#: Bytes of text unpacked, cut into pieces and encoded at a time (one text at least).
SLICE_BYTES = 1 << 20
#: Bytes of pieces and their ids that a worker keeps, about.
KEPT_BYTES = 48 << 20


def read_labels(model: dict) -> dict[int, bytes]:
    """The label of each id of a byte-level BPE: its bytes, those of its characters for an added token."""
    byte = {letter: i for i, letter in enumerate(byte_letters())}
    added = {x["id"]: x["content"].encode() for x in model["added_tokens"]}
    return {i: bytes(byte[x] for x in token) for token, i in model["model"]["vocab"].items() if i not in added} | added


class Labels:
    """Labels of ids in one table; unknown ids have none."""

    def __init__(self, labels: dict[int, bytes]):
        import pyarrow as pa

        self.size = max(labels) + 1
        self.table = pa.array([labels.get(i, b"") for i in range(self.size + 1)], pa.binary())

    def emit(self, ids, ends: list[int]) -> list[str]:
        """The texts whose bytes are the labels of ``ids`` between ``ends``; broken UTF-8 becomes U+FFFD."""
        import numpy as np
        import pyarrow as pa

        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return [""] * (len(ends) - 1)
        joined = self.table.take(pa.array(np.where((ids >= 0) & (ids < self.size), ids, self.size)))
        data = joined.buffers()[2].to_pybytes()
        places = np.frombuffer(joined.buffers()[1], np.int32)[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in pairwise(places)]


class Automaton:
    """States, arcs and labels; see the module's text."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        if model["model"]["type"] != "BPE" or (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE is needed")
        if model["normalizer"] or model["pre_tokenizer"]["add_prefix_space"] or not model["pre_tokenizer"]["use_regex"]:
            raise ValueError("a normalizer, a prefix blank or another pre-token pattern is not supported")
        self.specials = {}
        for added in model["added_tokens"]:
            if added["lstrip"] or added["rstrip"] or added["single_word"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.specials[added["content"]] = added["id"]
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        special_ids = set(self.specials.values())
        self.label = read_labels(model)
        vocab = {token: i for i, token in self.label.items() if i not in special_ids}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self._compile(vocab, [tuple(vocab[bytes(byte[c] for c in x)] for x in pair) for pair in pairs])

    def _compile(self, vocab: dict[bytes, int], merges: list[tuple[int, int]]) -> None:
        size = max(vocab.values()) + 1
        self.after = array("l", [0]) * size  # the state that arcs of a token lead to
        self.base = array("l", [0]) * size  # what it was when the token came
        self.left, self.made = array("l", [-1]) * size, array("l", [-1]) * size
        self.owner, self.when = array("l", [-1]), array("l", [-1])  # of a state: the token before it, the merge that made it
        self.rank: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        live = {vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        for i, (u, v) in enumerate(merges):
            w = vocab[self.label[u] + self.label[v]]
            if w in live:
                raise ValueError("two merges that make the same token are not supported")
            if u not in live or v not in live or not self._find(self.after[u], v):
                continue  # the pair never stands in a text
            target = self.after[v]
            self.owner.append(u)
            self.when.append(i)
            self.after[u] = len(self.owner) - 1
            self.after[w] = self.base[w] = target
            self.left[w], self.made[w], self.rank[u, v] = u, i, i
            live.add(w)
        self.token = {self.label[i]: i for i in live}
        self.step: dict[int, int] = {}  # node of the tree of labels and next byte to node
        self.ends = array("l", [-1])  # token whose label ends at a node
        for label, i in self.token.items():
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i

    def _removed(self, state: int, token: int) -> int:
        """The merge that took the arc ``token`` from ``state``, or NEVER."""
        while state:
            owner = self.owner[state]
            rank = self.rank.get((owner, token), NEVER)
            if rank <= self.when[state]:
                return rank
            state = self.base[owner]
        return NEVER

    def _find(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``: neither it nor, before it came, what it was made from was taken."""
        until = NEVER
        while True:
            removed = self._removed(state, token)
            if removed < NEVER and removed <= until:
                return False
            if self.left[token] < 0:
                return True
            token, until = self.left[token], self.made[token]

    def _keep(self, key: int) -> bool:
        if len(self.arcs) > 250_000:
            self.arcs.clear()
        found = self.arcs[key] = self._find(key >> 20, key & 0xFFFFF)
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the labels of the one path that spells it.

        Tries the longest label first.  A place in the word has one right
        tokenization before it, so a place from which no arc leads on is never
        tried again and the work stays in proportion to the length.
        """
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        step, ends, after, arcs = self.step.get, self.ends, self.after, self.arcs.get
        n, at, state = len(word), 0, 0
        path: list[int] = []
        back: list[tuple[int, int, list]] = []  # of each arc: from where, in which state, shorter labels
        dead: set[int] = set()
        found: list[tuple[int, int]] | None = None
        while at < n:
            if found is None:
                found, node, to = [], 0, at
                while to < n:
                    node = step(node << 8 | word[to])
                    if node is None:
                        break
                    to += 1
                    if ends[node] >= 0:
                        found.append((to, ends[node]))
            while found:
                to, token = found.pop()
                key = state << 20 | token
                known = arcs(key)
                if (self._keep(key) if known is None else known) and to not in dead:
                    back.append((at, state, found))
                    path.append(token)
                    at, state, found = to, after[token], None
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                path.pop()
                at, state, found = back.pop()
        return path

    def decode(self, ids) -> str:
        return Labels(self.label).emit(ids, [0, len(ids)])[0]


class _Words(dict):
    """Ids of pre-tokens; emptied when full."""

    def __init__(self, automaton: Automaton):
        self.encode = automaton.encode

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 50_000:
            self.clear()
        found = self[word] = self.encode(word.encode())
        return found


class Encoder(Pieces):
    """Texts to ids by the automaton, with the caches of one worker.

    When too many pieces are kept, the half that was used least goes.
    """

    def __init__(self, spec: str, limit: int = KEPT_BYTES):
        self.automaton = Automaton(spec)
        self.words = _Words(self.automaton)
        super().__init__({text.encode(): i for text, i in self.automaton.specials.items()}, "uint32", limit)

    def encode_words(self, words: list[bytes]):
        return self._flat(list(map(self.automaton.encode, words)))

    def encode_others(self, pieces: list[bytes]):
        """Cut into pre-tokens first."""
        cut = (pre_tokens(piece.decode()) for piece in pieces)
        return self._flat([list(chain.from_iterable(map(self.words.__getitem__, words))) for words in cut])

    def _forget(self) -> None:
        import numpy as np

        super()._forget()
        self.used = np.zeros(self.known, np.int64)

    def _pieces(self, column):
        import numpy as np

        numbers, counts = super()._pieces(column)
        uses = np.bincount(numbers, minlength=self.known)
        uses[: len(self.used)] += self.used
        self.used = uses
        return numbers, counts

    def _shrink(self) -> None:
        """Keep the pieces used most, up to half of the bytes; older uses count less."""
        import numpy as np

        pieces = list(self.numbers)  # in the order of their numbers
        cost = np.fromiter(map(sys.getsizeof, pieces), np.int64, len(pieces)) + self.BESIDE + self.flat.itemsize * self.size
        order = np.argsort(-self.used, kind="stable")
        keep = np.zeros(self.known, bool)
        keep[order[np.cumsum(cost[order]) <= self.limit // 2]] = True
        fixed = len(self.specials)
        keep[:fixed] = True
        kept = np.flatnonzero(keep)
        self.flat = self._gathered(kept)
        self.size, self.used = self.size[kept], self.used[kept] // 2
        self.begin = np.cumsum(self.size) - self.size
        self.numbers.clear()
        self.numbers.update((pieces[i], n) for n, i in enumerate(kept.tolist()))
        self.known, self.held = len(kept), int(cost[kept[fixed:]].sum())

    def _flat(self, found: list[list[int]]):
        import numpy as np

        size = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(size)
        return np.fromiter(chain.from_iterable(found), self.code, int(size.sum())), ends - size, size

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text the ids as bytes of 32-bit integers; null as empty."""
        import numpy as np

        for part in slices(texts):
            ids, counts = self.ids(part)
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in pairwise([0, *(4 * np.cumsum(counts)).tolist()]))


_BUILT: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder per worker and tokenizer."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(spec)
    return _BUILT[key]


def _spec(frame: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def _encoded(encoder: Encoder, batches, kept: int, names: list[str]) -> Iterator:
    """Batches of the first ``kept`` columns and the ids of the text behind them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = 0
        for part in column_slices(batch.column(kept), SLICE_BYTES):
            found = list(encoder.encode(part))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            ids = pa.array(np.frombuffer(b"".join(found), np.int32))
            columns = [batch.column(c).slice(rows, len(part)) for c in range(kept)]
            rows += len(part)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names)


def _decoded(labels: Labels, batches, ids: str, names: list[str]) -> Iterator:
    """``batches`` with the column ``decoded`` among ``names``, about ``IDS`` ids at a time."""
    import pyarrow as pa

    for batch in batches:
        start = size = 0
        lengths = batch.column(ids).value_lengths().fill_null(0).to_pylist()
        for row, n in enumerate([*lengths, IDS]):
            if start < row and (size + n > IDS or row == len(lengths)):
                part = batch.slice(start, row - start)
                flat = part.column(ids).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = pa.array(labels.emit(flat, [0, *accumulate(lengths[start:row])]), pa.string())
                yield pa.RecordBatch.from_arrays([texts if name == "decoded" else part.column(name) for name in names], names)
                start, size = row, 0
            size += n


def _picked(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` and the text behind them, and the types of those kept."""
    picked = docs.select(*keep, docs[text].alias("__text"))
    return picked, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) and ``token_ids``, the ids of ``text``.

    Ids are those of the tokenizers library for the byte-level BPE described
    in the file ``tokenizer``, without added special tokens; special strings
    within a text are ids of their own.  Null and empty texts have no ids.
    Rows are independent: repeated rows stay, other columns are ignored, an
    empty table gives an empty table.  The vocabulary (1.5 MB, fixed) is
    broadcast; the automaton is compiled once per worker.
    """
    keep = ["doc_id"] if keep is None else keep
    spec = _spec(docs, tokenizer)
    picked, kinds = _picked(docs, text, keep)
    names = [*keep, "token_ids"]

    def run(batches):
        yield from _encoded(_encoder(spec.value), batches, len(keep), names)

    return picked.mapInArrow(frugal(run), f"{kinds}token_ids array<int>")


def decode(frame: DataFrame, tokenizer: str, ids: str = "token_ids") -> DataFrame:
    """``frame`` with a column ``decoded`` (in place of one of that name): the text of the ids, special tokens kept; null and no ids give ''."""
    spec = _spec(frame, tokenizer)
    schema = StructType([f for f in frame.schema.fields if f.name != "decoded"] + [StructField("decoded", StringType())])
    names = schema.names

    def run(batches):
        # The labels are all that decoding takes; the automaton isn't compiled for it.
        yield from _decoded(Labels(read_labels(json.loads(spec.value))), batches, ids, names)

    return frame.mapInArrow(frugal(run), schema)


def encode_and_decode(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode``, and ``decode`` of its ids in the same worker: the columns ``keep``, ``token_ids`` and ``decoded``."""
    keep = ["doc_id"] if keep is None else keep
    spec = _spec(docs, tokenizer)
    picked, kinds = _picked(docs, text, keep)
    names = [*keep, "token_ids"]

    def run(batches):
        encoder = _encoder(spec.value)
        coded = _encoded(encoder, batches, len(keep), names)
        yield from _decoded(Labels(encoder.automaton.label), coded, "token_ids", [*names, "decoded"])

    return picked.mapInArrow(frugal(run), f"{kinds}token_ids array<int>, decoded string")
