"""Alignment of the tokens of two tokenizers, and corpus counts of linked pairs.

A text is encoded by a byte-level BPE (A) and a sentencepiece model (B).  Byte
offsets at which tokens of both end cut them into groups; the tokens of a group
are linked, each of A with each of B.  A pair of ids counts the documents that
hold it linked.

The first pass aligns all documents and writes each task's distinct pairs with
their documents.  Distinct pairs get numbers by a minimal perfect hash, built
bucket by bucket; tasks add what they read into dense vectors indexed by it,
and the vectors are summed up as a tree, slice by slice.  The second pass
aligns the documents again and looks pairs up, comparing the key kept under
the number.  Hash and vectors are broadcast only up to ``PAIRS`` distinct
pairs; beyond, the second pass joins the counts instead.

No token of either tokenizer reaches over the step from a character to a blank
(but for blanks that the vocabulary of B holds behind others), nor, if no piece
of B does, from a letter to a mark; so texts are aligned piece by piece, once
for each distinct piece that a bounded table of the worker holds from task to
task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.chunks import LETTER, OTHERS, SPACE, byte_classes, column_bytes, column_slices, library_encoder, load_library
from mercato.llm.common import frugal, partitions, written
from mercato.llm.pair_hash import PER_BUCKET, SPREAD, PairHash, build_bucket, spread

#: Distinct pairs up to which hash, keys and counts are broadcast (about 17 bytes a pair).
PAIRS = 4_000_000
#: Counts of a vector that go together, and vectors summed up in one step of the tree.
SLICE, BRANCHES = 65_536, 8
#: Bytes of pieces and their alignments that a worker keeps, about.
KEPT_BYTES = 128 << 20
#: Bytes of text unpacked and aligned at a time (one text at least).
SLICE_BYTES = 1 << 20
#: Characters that go to the sentencepiece library at once (one piece at least).
JOINED = 200_000
#: Links of a group above which equal ids are counted instead of listed.
LISTED = 1 << 16
SPACE_LETTER = "▁"
MARKS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
#: A letter behind which a text may be cut before a mark, and the mark.
MIXED = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ][{re.escape(MARKS)}]")


def is_word(piece: str) -> bool:
    """Whether ``piece`` is letters, with or without a blank before them: one pre-token."""
    return piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())


class Aligner:
    """Tokens of both tokenizers and their groups; ``spec`` is the .json text of A, ``model`` the bytes of B's file."""

    def __init__(self, spec: str, model: bytes):
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        from mercato.llm.bpe import byte_letters

        library = load_library(spec)
        library.encode_special_tokens = True
        self.a, self.newline_a = library, library.token_to_id("Ċ")
        self.encode_a = library_encoder(library, self.newline_a, "uint32")
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        special = {x.content for x in library.get_added_tokens_decoder().values()}
        bytes_a = [b""] * library.get_vocab_size()
        for token, i in library.get_vocab().items():
            if token not in special:
                bytes_a[i] = bytes(byte[x] for x in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        bytes_b, behind, self.letters_end = [], set(), True
        blanks = {" ", "\n", *OTHERS}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                bytes_b.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
                bytes_b.append(b"")
            else:
                text = piece.replace(SPACE_LETTER, " ")
                self.letters_end = self.letters_end and not MIXED.search(text)
                behind |= {y for x, y in zip(text, text[1:]) if x not in blanks and y in blanks}
                if " " in behind or "\n" in text:
                    raise ValueError("a vocabulary with blanks or line ends inside of pieces is not supported")
                bytes_b.append(text.encode())
        self.newline = self.b.encode("\n")[-1]
        self.head = len(self.b.encode("\n")) - 1
        self.stays = [x.encode() for x in sorted(behind)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        if len(bytes_a) * len(bytes_b) > 1 << 31:
            raise ValueError("vocabularies with more than 2**31 pairs of ids are not supported")
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (bytes_a, bytes_b))
        names = [f"{i}{end}" for n, last in ((len(bytes_a), "|"), (len(bytes_b), ";")) for i in range(n) for end in (",", last)]
        self.names = pa.array(names, pa.string())

    def cut(self, texts: list[str]):
        """The pieces of texts with a blank before each (an empty one has none): distinct ones as bytes, the place of each piece among these, how many each text has.

        A piece begins at a blank behind something else.  A line end alone between other characters is a piece of its own,
        as it is a token of its own for both; words end before a mark, if they do so for B.
        """
        import numpy as np
        import pyarrow as pa

        data, places = column_bytes(pa.array([" " + text if text else "" for text in texts], pa.string()))
        classes = byte_classes(data)
        first = np.zeros(len(data) + 1, bool)
        first[places] = True
        space = np.append(classes == SPACE, True)
        marks = first.copy()
        marks[1:-1] |= space[1:-1] & ~space[:-2]
        for blank in self.stays:
            at = np.flatnonzero(marks & ~first)
            at = at[at + len(blank) <= len(data)]
            marks[at[np.all([data[at + i] == byte for i, byte in enumerate(blank)], axis=0)]] = False
        line = np.flatnonzero(marks[:-1] & ~first[:-1])
        line = line[data[line] == 10]
        marks[line[~space[line + 1] & ~first[line + 1]] + 1] = True
        if self.letters_end:
            runs = np.flatnonzero(first[1:-1] | (classes[1:] != classes[:-1])) + 1
            ends, begins = runs[1:], runs[:-1]
            word = (classes[begins] == LETTER) & space[begins - 1] & ~first[begins] & ~first[ends] & np.isin(data[ends], list(MARKS.encode()))
            ends = ends[word]
            marks[ends[(data[ends - 1] < 0x80) | (data[ends - 2] == 0xC3)]] = True
        starts = np.flatnonzero(marks[:-1])
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        return pieces.dictionary.to_pylist(), pieces.indices.to_numpy(), np.diff(np.searchsorted(starts, places))

    def _encode_a(self, pieces: list[str]):
        """All ids of ``pieces`` and how many each has; the first ones, a blank and letters, go to the library as one text."""
        import numpy as np

        found, counts, at = [], [], 0
        words = next((i for i, piece in enumerate(pieces) if not is_word(piece)), len(pieces))
        while at < words:
            upto = min(at + 50_000, words)
            ids = np.array(self.a.encode_batch_fast(["\n".join(pieces[at:upto])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(ids == self.newline_a), len(ids))
            if len(ends) != upto - at:
                raise ValueError("line ends are not tokens of their own")
            found.append(ids[ids != self.newline_a])
            counts.append(np.diff(ends, prepend=-1) - 1)
            at = upto
        coded = self.encode_a(pieces[words:])
        found.append(np.frombuffer(b"".join(coded), np.uint32).astype(np.int64))
        counts.append(np.array([len(x) // 4 for x in coded], np.int64))
        return np.concatenate(found), np.concatenate(counts)

    def _encode_b(self, pieces: list[str]):
        """All ids of ``pieces`` and how many each has.  Line ends, tokens of their own, stand between the pieces."""
        import numpy as np

        found, counts, at = [], [], 0
        while at < len(pieces):
            upto, size = at, 0
            while upto < len(pieces) and (upto == at or size + len(pieces[upto]) < JOINED):
                size += len(pieces[upto]) + 1
                upto += 1
            part = pieces[at:upto]
            ids = np.array(self.b.encode("\n" + "\n".join(part)), np.int64)
            ends = np.flatnonzero(ids == self.newline)
            own = np.array([piece.count("\n") for piece in part])
            first = np.arange(len(part)) + np.cumsum(own) - own
            if len(ends) != len(part) + own.sum() or ends[0] != self.head:
                raise ValueError("line ends are not tokens of their own")
            keep = np.ones(len(ids), bool)
            keep[ends[first]] = False
            keep[: self.head] = False
            stops = np.append(ends[first[1:]], len(ids))
            found.append(ids[keep])
            counts.append(stops - ends[first] - 1)
            at = upto
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *counts])

    def _whole(self, pieces: list[str], tokens, ids, counts):
        """Whether the tokens of each piece have its bytes."""
        import numpy as np

        raw = [piece.encode() for piece in pieces]
        joined = tokens.take(ids)
        data = joined.buffers()[2]
        data = data.to_pybytes() if data else b""
        starts = np.frombuffer(joined.buffers()[1], np.int32) if len(ids) else np.zeros(1, np.int32)
        ends = np.cumsum(counts)
        stops, begins = starts[ends], starts[ends - counts]
        return np.array([data[a:b] == own for a, b, own in zip(begins.tolist(), stops.tolist(), raw)], bool)

    def align(self, pieces: list[str], spelled: bool) -> dict:
        """Per piece ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``good``, ``n_pairs`` and (if ``spelled``) ``groups``; flat ``pairs`` and ``times``.

        A piece whose tokens don't have its bytes isn't good and has none.
        """
        import numpy as np
        import pyarrow as pa

        ids_a, count_a = self._encode_a(pieces)
        ids_b, count_b = self._encode_b(pieces)
        good = self._whole(pieces, self.bytes_a, pa.array(ids_a), count_a) & self._whole(pieces, self.bytes_b, pa.array(ids_b), count_b)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
            count_a, count_b = count_a * good, count_b * good
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        total = int(end_a[-1]) + 1 if len(end_a) else 1
        marks = np.zeros((2, total), bool)
        marks[0, end_a], marks[1, end_b] = True, True
        last_a, last_b = marks[1, end_a], marks[0, end_b]  # tokens that end a group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        owner = np.repeat(np.arange(len(pieces)), count_a)[last_a]  # the piece of each group
        links = in_a * in_b
        out = {
            "n_a": count_a,
            "n_b": count_b,
            "n_groups": np.bincount(owner, minlength=len(pieces)).astype(np.int64),
            "n_links": np.bincount(owner, links, minlength=len(pieces)).astype(np.int64),
            "good": good,
        }
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        small = np.flatnonzero(links <= LISTED)
        of = np.repeat(small, links[small])
        number = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        pairs = [ids_a[start_a[of] + number // in_b[of]] << 32 | ids_b[start_b[of] + number % in_b[of]]]
        piece, times = [owner[of]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(links > LISTED).tolist():
            a, many_a = np.unique(ids_a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            b, many_b = np.unique(ids_b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            pairs.append((a[:, None] << 32 | b[None, :]).ravel())
            times.append((many_a[:, None] * many_b[None, :]).ravel())
            piece.append(np.full(len(pairs[-1]), owner[g]))
        pairs, piece, times = np.concatenate(pairs), np.concatenate(piece), np.concatenate(times)
        order = np.lexsort((pairs, piece))
        pairs, piece, times = pairs[order], piece[order], times[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        out["pairs"] = pairs[first]
        out["times"] = np.add.reduceat(times, first) if len(first) else times
        out["n_pairs"] = np.bincount(piece[first], minlength=len(pieces)).astype(np.int64)
        if spelled:
            codes = np.empty(len(ids_a) + len(ids_b), np.int64)
            codes[np.arange(len(ids_a)) + start_b[group_a]] = 2 * ids_a + last_a
            codes[np.arange(len(ids_b)) + (start_a + in_a)[group_b]] = 2 * (len(self.size_a) + ids_b) + last_b
            joined = self.names.take(pa.array(codes))
            data = joined.buffers()[2].to_pybytes().decode() if len(codes) else ""
            starts = np.frombuffer(joined.buffers()[1], np.int32) if len(codes) else np.zeros(1, np.int32)
            ends = np.cumsum(count_a + count_b)
            stops, begins = starts[ends], starts[ends - count_a - count_b]
            out["groups"] = [data[a : b - 1] if b else "" for a, b in zip(begins.tolist(), stops.tolist())]
        return out


class PieceTable:
    """Alignments of pieces, kept between texts up to about ``limit`` bytes; ``score`` adds columns made from pairs and times.

    When there are more, the half that was used least goes.
    """

    COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")

    def __init__(self, aligner: Aligner, spelled: bool, score=None, limit: int = KEPT_BYTES):
        import numpy as np

        self.aligner, self.spelled, self.score, self.limit = aligner, spelled, score, limit
        self.columns = [*self.COLUMNS, *(["n_best", "count_sum"] if score else [])]
        self.index: dict[bytes, int] = {}
        self.values = {name: np.zeros(0, np.int64) for name in self.columns}
        self.good, self.pairs, self.times = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups: list[str] = []

    def _shrink(self) -> None:
        """Keep the pieces used most, up to half of the bytes; older uses count less."""
        import numpy as np

        order = np.argsort(-self.used, kind="stable")
        keep = np.zeros(len(order), bool)
        keep[order[np.cumsum(self.size[order]) <= self.limit // 2]] = True
        listed = np.repeat(keep, self.values["n_pairs"])
        self.pairs, self.times = self.pairs[listed], self.times[listed]
        self.values = {name: column[keep] for name, column in self.values.items()}
        self.good, self.used, self.size = self.good[keep], self.used[keep] // 2, self.size[keep]
        if self.spelled:
            self.groups = [groups for groups, stays in zip(self.groups, keep.tolist()) if stays]
        self.index = {piece: i for i, piece in enumerate(piece for piece, stays in zip(self.index, keep.tolist()) if stays)}

    def numbers(self, pieces: list[bytes]):
        """The place in the table of each of ``pieces``, which are distinct."""
        import numpy as np

        if self.size.sum() > self.limit:
            self._shrink()
        missing = sorted((piece.decode() for piece in pieces if piece not in self.index), key=is_word, reverse=True)
        if missing:
            found = self.aligner.align(missing, self.spelled)
            if self.score:
                found |= self.score(found)
            self.index.update(zip(map(str.encode, missing), range(len(self.index), len(self.index) + len(missing))))
            for name in self.columns:
                self.values[name] = np.concatenate([self.values[name], found[name]])
            self.good = np.concatenate([self.good, found["good"]])
            self.pairs, self.times = np.concatenate([self.pairs, found["pairs"]]), np.concatenate([self.times, found["times"]])
            size = 300 + np.fromiter(map(len, missing), np.int64) + 16 * found["n_pairs"]
            if self.spelled:
                self.groups += found["groups"]
                size += np.fromiter(map(len, found["groups"]), np.int64)
            self.size = np.concatenate([self.size, size])
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def texts(self, texts: list[str]):
        """The pieces of ``texts`` by number, where each text's end, and which texts have tokens."""
        import numpy as np

        distinct, places, counts = self.aligner.cut(texts)
        flat = self.numbers(distinct)[places]
        uses = np.bincount(flat, minlength=len(self.index))
        uses[: len(self.used)] += self.used
        self.used = uses
        ends = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~self.good[flat])])
        return flat, ends, (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])

    def groups_of(self, flat, ends, whole) -> list[str]:
        """The groups of the texts that have tokens, one after another; ``flat``, ``ends`` and ``whole`` as ``texts`` gives them."""
        import numpy as np
        import pyarrow as pa

        if not len(flat):
            return [""] * len(whole)
        used = np.zeros(len(self.index), bool)
        used[flat] = True
        distinct = pa.array([self.groups[i] + ";" for i in np.flatnonzero(used).tolist()], pa.string())
        joined = distinct.take(pa.array((np.cumsum(used) - 1)[flat]))
        data = joined.buffers()[2].to_pybytes()
        stops = np.frombuffer(joined.buffers()[1], np.int32)[ends].tolist()
        return [data[a : b - 1].decode() if ok else "" for a, b, ok in zip(stops, stops[1:], whole.tolist())]

    def pairs_of(self, flat):
        """The pairs of each piece of ``flat`` one after another, how often each, and how many each piece has."""
        import numpy as np

        counts = self.values["n_pairs"]
        start = np.cumsum(counts) - counts
        many = counts[flat]
        at = np.repeat(start[flat] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.pairs[at], self.times[at], many


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(shared) -> Aligner:
    """One per worker and broadcast of the tokenizers."""
    if shared.value[0] not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[shared.value[0]] = Aligner(*shared.value[1:])
    return _ALIGNERS[shared.value[0]]


_TABLES: dict[tuple, PieceTable] = {}


def _table(shared, use: str, spelled: bool, score=None) -> PieceTable:
    """One per worker, kept from task to task for the same tokenizers and ``use`` (a pass and the counts that ``score`` takes)."""
    key = shared.value[0], use
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(_aligner(shared), spelled, score)
    return _TABLES[key]


def _distinct(keys):
    """Distinct keys in order and where each begins in the sorted keys, with the end as the last place."""
    import numpy as np

    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.append(first, len(keys))


def _summed(keys, counts):
    """Distinct keys and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys)
    distinct, first = _distinct(keys[order])
    return distinct, np.add.reduceat(counts[order], first[:-1]) if len(distinct) else counts


def document_pairs(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """Distinct pairs of each task: ``pair`` (id of A times 2**32 plus id of B), ``spread`` (for its bucket) and ``docs`` that hold it."""

    def run(batches) -> Iterator:
        import numpy as np

        table = _table(shared, "pairs", spelled=False)
        narrow = len(table.aligner.size_b)
        keys, counts, rows = [], [], 0
        for batch in batches:
            for part in column_slices(batch.column(0), SLICE_BYTES):
                flat, ends, whole = table.texts(part)
                doc = np.repeat(np.arange(len(part)), np.diff(ends))
                use = whole[doc]
                pieces = max(len(table.index), 1)
                held, _ = _distinct(doc[use] * pieces + flat[use])
                pairs, _, many = table.pairs_of(held % pieces)
                # Ids of A and B within 31 bits leave 32 for the document within the slice.
                codes, _ = _distinct(np.repeat(held // pieces, many) << 31 | (pairs >> 32) * narrow + (pairs & 0xFFFFFFFF))
                distinct, first = _distinct(codes & (1 << 31) - 1)
                keys.append(distinct // narrow << 32 | distinct % narrow)
                counts.append(np.diff(first))
                rows += len(distinct)
                if rows > 1_000_000:
                    key, count = _summed(np.concatenate(keys), np.concatenate(counts))
                    # Half full of distinct pairs already: hand them on, later ones are a row of their own.
                    if len(key) > 500_000:
                        yield from _pair_rows(key, count)
                        key, count = key[:0], count[:0]
                    keys, counts, rows = [key], [count], len(key)
        if keys:
            yield from _pair_rows(*_summed(np.concatenate(keys), np.concatenate(counts)))

    def _pair_rows(key, count):
        import pyarrow as pa

        for at in range(0, len(key), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(spread(key[part])), pa.array(count[part])], ["pair", "spread", "docs"])

    return docs.select(text).mapInArrow(frugal(run), "pair long, spread long, docs long")


def hash_pairs(pairs: DataFrame) -> list[tuple] | None:
    """What ``PairHash`` takes, for the distinct ``pair`` of ``pairs``; None if there are more than ``PAIRS``."""
    spark = pairs.sparkSession
    distinct = written(pairs.select("pair", "spread").distinct(), "alignment-keys")
    count = distinct.count()
    if count > PAIRS:
        return None
    buckets = max(1, count // PER_BUCKET)
    dealt = distinct.select("pair", F.shiftright(F.col("spread") * buckets, SPREAD).cast("int").alias("bucket"))
    dealt = dealt.repartition(min(partitions(spark), buckets), "bucket").sortWithinPartitions("bucket", "pair")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def row(bucket, keys):
            sizes, words, ordered = build_bucket(np.concatenate(keys))
            return pa.RecordBatch.from_pydict(
                {"bucket": [bucket], "sizes": [sizes], "words": [words.tobytes()], "keys": [ordered.tobytes()]},
                schema=pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("keys", pa.binary())]),
            )

        held, current = [], None
        for batch in batches:
            keys, own = (np.asarray(column) for column in batch.columns)
            for bucket in np.unique(own).tolist():
                if bucket != current and held:
                    yield row(current, held)
                    held = []
                current = bucket
                held.append(keys[own == bucket])
        if held:
            yield row(current, held)

    built = dealt.mapInArrow(frugal(run), "bucket int, sizes array<int>, words binary, keys binary")
    # At most PAIRS keys of 8 bytes and less than a byte of bits for each.
    return _buckets(buckets, [(r["bucket"], r["sizes"], r["words"], r["keys"]) for r in built.collect()])


def _buckets(count: int, rows: list[tuple]) -> list[tuple]:
    import numpy as np

    found = {b: (sizes, np.frombuffer(words, "<u8"), np.frombuffer(keys, "<i8")) for b, sizes, words, keys in rows}
    return [found.get(b, ([], np.zeros(0, np.uint64), np.zeros(0, np.int64))) for b in range(count)]


def dense_counts(pairs: DataFrame, shared_hash, count: int):
    """The sum of ``docs`` over ``pairs`` for each number of the hash, as one array: dense vectors, summed up as a tree."""
    import numpy as np

    spark = pairs.sparkSession
    width = partitions(spark)
    rows = pairs.count()
    tasks = max(1, min(width, rows // (4 * max(count, 1))))

    def fill(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        numbers = shared_hash.value
        held = np.zeros(count, np.int64)
        for batch in batches:
            place = numbers.find(np.asarray(batch.column(0)))
            if (place < 0).any():
                raise ValueError("a pair has no number")
            np.add.at(held, place, np.asarray(batch.column(1)))
        part = TaskContext.get().partitionId()
        for at in range(0, count, SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([at // SLICE], pa.int32()), "part": pa.array([part], pa.int32()), "counts": [held[at : at + SLICE].tobytes()]})

    def add(batches):
        import numpy as np
        import pyarrow as pa

        def row(key, held):
            return pa.RecordBatch.from_pydict({"slice": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "counts": [held.tobytes()]})

        current, held = None, None
        for batch in batches:
            for key0, key1, counts in zip(*(column.to_pylist() for column in batch.columns)):
                vector = np.frombuffer(counts, "<i8")
                if (key0, key1) == current:
                    held = held + vector
                else:
                    if current is not None:
                        yield row(current, held)
                    current, held = (key0, key1), vector
        if current is not None:
            yield row(current, held)

    kind = "slice int, part int, counts binary"
    vectors = written(pairs.select("pair", "docs").coalesce(tasks).mapInArrow(frugal(fill), kind), "alignment-vectors")
    while tasks > 1:
        step = vectors.withColumn("part", F.floor(F.col("part") / BRANCHES).cast("int"))
        step = step.repartition(width, "slice", "part").sortWithinPartitions("slice", "part")
        vectors = written(step.mapInArrow(frugal(add), kind), "alignment-vectors")
        tasks = -(-tasks // BRANCHES)
    parts = {r["slice"]: r["counts"] for r in vectors.select("slice", "counts").collect()}  # 8 bytes a pair
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(parts[s], "<i8") for s in sorted(parts))])


OUT = "doc_id {}, n_a long, n_b long, n_groups long, n_links long"


def _second_pass(docs: DataFrame, shared, known, text: str) -> DataFrame:
    """Documents aligned again; with ``known`` (a mark of its own, hash, counts, best count of each id of A) looked up, else with their pairs listed."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["n_best", "count_sum"] if known else ["pairs", "times"]), "groups"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def score(found):
            _, numbers, counts, best = known.value
            # Pairs without a number stand only in pieces of texts without tokens; the last count is theirs.
            count = counts[numbers.find(found["pairs"])]
            owner = np.repeat(np.arange(len(found["n_pairs"])), found["n_pairs"])
            each = found["times"] * count
            first = found["pairs"] >> 32
            top = found["times"] * (count == np.append(best, -1)[np.minimum(first, len(best))])
            sums = [np.zeros(len(found["n_pairs"]), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, top)
            np.add.at(sums[1], owner, each)
            return {"n_best": sums[0], "count_sum": sums[1]}

        table = _table(shared, known.value[0] if known else "listed", spelled=True, score=score if known else None)
        for batch in batches:
            done = 0
            for part in column_slices(batch.column(1), SLICE_BYTES):
                flat, ends, whole = table.texts(part)
                columns = [batch.column(0).slice(done, len(part))]
                done += len(part)
                for name in names[1:5] + (names[5:7] if known else []):
                    sums = np.concatenate([[0], np.cumsum(table.values[name][flat])])
                    columns.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]) * whole, pa.int64()))
                if not known:
                    pairs, times, many = table.pairs_of(flat)
                    stops = np.concatenate([[0], np.cumsum(many)])[ends]
                    keep = np.repeat(whole, np.diff(stops))
                    stops = np.concatenate([[0], np.cumsum(np.diff(stops) * whole)])
                    columns += [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(x[keep])) for x in (pairs, times)]
                columns.append(pa.array(table.groups_of(flat, ends, whole), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select("doc_id", docs[text].alias("__text"))
    kind = OUT.format(picked.schema["doc_id"].dataType.simpleString())
    kind += ", n_best long, count_sum long" if known else ", pairs array<long>, times array<long>"
    return picked.mapInArrow(frugal(run), kind + ", groups string")


def align_tokenizers(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    ``a`` is the .json file of a byte-level BPE, ``b`` a sentencepiece model;
    special strings in texts are plain text.  ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``: ids of A and B by group.  ``n_best`` counts the links
    whose pair is in as many documents as any pair of its id of A,
    ``count_sum`` adds up the documents of all links.  Null and empty texts, and
    those whose tokens don't have the bytes of a blank and the text, have no
    tokens, groups or links and count for no pair.  Repeated rows are documents
    each; texts may be of any length; an empty table gives no rows.  Other
    columns are ignored whatever their names.
    """
    import hashlib
    import uuid

    import numpy as np

    spark = docs.sparkSession
    with open(a, encoding="utf-8") as spec, open(b, "rb") as model:
        tokenizers = spec.read(), model.read()
    mark = hashlib.sha256(tokenizers[0].encode() + tokenizers[1]).hexdigest()
    shared = spark.sparkContext.broadcast((mark, *tokenizers))
    pairs = written(document_pairs(docs, shared, text), "alignment-pairs")
    buckets = hash_pairs(pairs)
    if buckets is not None:
        numbers = PairHash(buckets)
        counts = dense_counts(pairs, spark.sparkContext.broadcast(numbers), len(numbers.keys))
        best = np.zeros(int(numbers.keys.max() >> 32) + 1 if len(numbers.keys) else 1, np.int64)
        np.maximum.at(best, numbers.keys >> 32, counts)
        known = spark.sparkContext.broadcast((uuid.uuid4().hex, numbers, np.append(counts, 0), best))
        return _second_pass(docs, shared, known, text)
    return _joined_counts(_second_pass(docs, shared, None, text), pairs)


def _joined_counts(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The counts of more pairs than are broadcast: documents' pairs meet them in a join."""
    aligned = written(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("docs"))
    best = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = written(counts.withColumn("best", F.col("docs") == best), "alignment-counts")
    listed = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    listed = listed.groupBy("row", F.col("pairs").alias("pair")).agg(F.sum("times").alias("times"))
    looked = listed.join(counts, "pair").groupBy("row")
    looked = looked.agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    joined = aligned.join(looked, "row", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups")
