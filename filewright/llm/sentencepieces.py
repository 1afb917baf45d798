"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Spaces become the meta symbol and one is put before the text, as the model does. A batch of texts is cut where no piece of the model holds the two
characters side by side (no merge crosses such a place), and equal segments are encoded once. The different
segments, end to end, are indexed by a suffix array (prefix doubling up to the longest piece's length). All pieces are
binary-searched in it at once; each piece's range of suffixes gives an edge for every occurrence. Edges are sorted by their
end and then relaxed from left to right in all segments together: an edge extends a path whose last piece is compatible with
it, that is, if BPE encodes the two pieces' joined text as just these two. For BPE exactly one path into every place is compatible,
and it is what merging gives, so the ids equal the sentencepiece library's.

The piece tables are built once a worker process from the model file; segments seen before come from a bounded memo keyed by a hash of
64 bits and the length. Segments of any length take this way. Only segments that begin outside the model, and those with runs of meta symbols (among whose
pieces the model breaks ties by place), are merged one by one.

Defined results: null and empty texts have no ids; characters outside the model become bytes; decoding returns the text that was encoded
(a literal meta symbol decodes as a space, as in the library); texts may be of any length; repeated rows are encoded
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import releasing, slices, table, text_or_empty

META = "▁"
LONG, MEMO = 128, 250_000
#: Texts of up to so many characters (or one text) are cut into segments together, new segments of about so many are indexed together, and texts of up to so many
#: bytes (or one text) make a batch of rows. What a worker holds beside its tables grows with these.
BATCH_CHARS, NEW_CHARS, BATCH_BYTES = 1 << 18, 1 << 16, 1 << 18
NONE, START = -1, -2


class Pieces:
    """Tables of a model: ids, ranks, splits, and which two pieces stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.id_of = {names[i]: i for i in range(size) if not special[i]}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.rank = {names[i]: -model.get_score(i) for i in range(size) if not special[i]}
        self.bytes_of = [b"" if special[i] else names[i].replace(META, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        # pieces in the order in which merges prefer them; single characters come first, as they are never merged into
        singles = sorted(p for p in self.id_of if len(p) == 1)
        merged = sorted((p for p in self.id_of if len(p) > 1), key=lambda p: self.rank[p])
        split = {p: self.merge(p, True) for p in merged if META * 2 not in p}
        self.order = singles + [p for p in merged if split.get(p)]
        number = {p: i for i, p in enumerate(self.order)}
        self.ids = np.array([self.id_of[p] for p in self.order])
        own = np.arange(len(self.order))
        self.left, self.right = own.copy(), own.copy()
        for p in self.order[len(singles) :]:
            self.left[number[p]], self.right[number[p]] = number[split[p][0]], number[split[p][1]]
        pairs = [(number[p[:i]] * len(own) + number[p[i:]], number[p]) for p in self.order for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        pairs.sort()
        self.pairs, self.joined = np.array([k for k, _ in pairs]), np.array([v for _, v in pairs])
        # characters: small numbers for those of the model (0: none), and which two stand side by side in a piece
        chars = sorted({c for p in self.id_of for c in p})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.zeros(len(chars) + 1, np.int64)
        for c in chars:
            self.single[self.char[ord(c)]] = self.id_of.get(c, -1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.id_of:
            codes = self.char[[ord(c) for c in p]]
            self.beside[codes[:-1], codes[1:]] = True
        self.longest = max(map(len, self.order))
        self.width = -(-self.longest // 4)
        self.keys_low, self.keys_high = self._keys()
        self.sizes = np.array([len(p) for p in self.order])
        self.known: dict[tuple[int, int], bool] = {}

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's characters packed by four: as the least and as the largest string that begins with it."""
        codes = np.zeros((len(self.order), self.width * 4), np.uint64)
        top = np.full(codes.shape, 0xFFFF, np.uint64)
        for i, p in enumerate(self.order):
            codes[i, : len(p)] = top[i, : len(p)] = self.char[[ord(c) for c in p]]
        return _packed(codes), _packed(top)

    def merge(self, text: str, last: bool = False):
        """BPE by merging the best pair, leftmost first; the ids, or the last merge's two sides if all becomes one piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            whole = parts[i] + parts[j]
            if whole in self.id_of:
                heapq.heappush(heap, (self.rank[whole], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        sides = None
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != whole or after[i] != j:
                continue
            sides = (parts[i], parts[j])
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        if last:
            return sides if parts[0] == text else None
        ids: list[int] = []
        for p in parts:
            if p is not None:
                ids.extend([self.id_of[p]] if p in self.id_of else self.byte_ids[list(p.encode("utf-8", "replace"))].tolist())
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the two pieces apart: no merge across their border comes before the merges that make them."""
        n = len(self.order)
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), n)
        a, b = a.copy(), b.copy()
        while len(at):
            key = a * n + b
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[place] == key) & (self.joined[place] < limit)
            out[at[hit]] = False
            # undo the later of the two merges; ties of one piece with itself undo the right one first
            undo_a = a > b
            limit = np.where(undo_a, a, b + 1)
            next_a, next_b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            done_a, done_b = undo_a & (next_a == a), ~undo_a & (next_b == b)
            # a single character can't be undone: then the other side is, until both are single
            limit = np.where(done_a, b + 1, np.where(done_b, a, limit))
            next_b, next_a = np.where(done_a, self.left[b], next_b), np.where(done_b, self.right[a], next_a)
            end = hit | (done_a & (next_b == b)) | (done_b & (next_a == a))
            go = ~end
            at, a, b, limit = at[go], next_a[go], next_b[go], limit[go]
        return out


def _packed(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::4] << np.uint64(48)) | (codes[:, 1::4] << np.uint64(32)) | (codes[:, 2::4] << np.uint64(16)) | codes[:, 3::4]


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memo: dict[tuple[int, int], int] = {}
        self.starts, self.found = np.zeros(1, np.int64), np.zeros(0, np.int32)
        rng = np.random.default_rng(11)
        self.powers = rng.integers(0, 1 << 63, LONG + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, 1 << 16, np.uint64)
        self.hashes = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            if batch and size + len(text) > BATCH_CHARS:
                out += self._batch(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        return out + self._batch(batch) if batch else out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        p = self.pieces
        plain = [META + t.replace(" ", META) if t else "" for t in texts]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        whole = "".join(plain)
        n = len(whole)
        if not n:
            return [np.zeros(0, np.int32)] * len(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        char = p.char[code]
        cut = np.ones(n, bool)
        cut[1:] = ~p.beside[char[:-1], char[1:]]
        begins = np.cumsum(sizes) - sizes
        cut[begins[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, n))
        # equal segments are found by a random sum of powers by place; characters outside the model by their own code
        offset = np.arange(n) - np.repeat(starts, lengths)
        mixed = (self.salt[code & 0xFFFF] ^ code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.powers[np.minimum(offset, LONG)]
        mixed ^= mixed >> np.uint64(31)
        total = np.add.reduceat(mixed, starts) * np.uint64(0xD6E8FEB86659FD93) + lengths.astype(np.uint64)
        long = np.flatnonzero(lengths > LONG)
        total[long] = np.array([zlib.crc32(whole[s : s + k].encode("utf-8", "surrogatepass")) | 1 << 63 for s, k in zip(starts[long], lengths[long], strict=True)], np.uint64) ^ long.astype(np.uint64) << np.uint64(32)
        keys, first, back = np.unique(total, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, keys)
        old = np.zeros(len(keys), bool)
        inside = at < len(self.hashes)
        old[inside] = self.hashes[at[inside]] == keys[inside]
        number = np.zeros(len(keys), np.int64)
        number[old] = self.numbers[at[old]]
        new = np.flatnonzero(~old)
        frozen = len(self.starts) - 1
        number[new] = frozen + np.arange(len(new))
        if len(new):
            at = first[new]
            turns = np.flatnonzero(np.diff(np.cumsum(lengths[at]) // NEW_CHARS)) + 1
            found = [self._segments(whole, char, code, starts[some], lengths[some]) for some in np.split(at, turns)]
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([counts for _, counts in found]))])
            self.found = np.concatenate([self.found, *[ids for ids, _ in found]])
        each = number[back]
        counts = np.diff(self.starts)[each]
        ends = np.cumsum(counts)
        ids = self.found[np.repeat(self.starts[each] - ends + counts, counts) + np.arange(ends[-1])]
        doc = np.searchsorted(starts, np.append(begins, n))  # segments before each document
        bounds = np.concatenate([[0], ends])[doc]
        if len(new):
            if frozen < MEMO and not len(long):
                self.hashes, self.numbers = np.concatenate([self.hashes, keys[new]]), np.concatenate([self.numbers, number[new]])
                order = np.argsort(self.hashes)
                self.hashes, self.numbers = self.hashes[order], self.numbers[order]
            else:  # a full memo stays as it is
                self.starts = self.starts[: frozen + 1]
                self.found = self.found[: self.starts[-1]]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _segments(self, whole: str, char: np.ndarray, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of some segments end to end, and the number of ids of each."""
        p = self.pieces
        counts = np.zeros(len(starts), np.int64)
        doubled = np.zeros(len(char), bool)
        meta = p.char[ord(META)]
        doubled[1:] = (char[1:] == meta) & (char[:-1] == meta)
        doubles = np.cumsum(doubled)
        runs = doubles[starts + lengths - 1] - doubles[starts]
        odd = (runs > 0) | (char[starts] == 0)
        one = (lengths == 1) & ~odd & (p.single[char[starts]] >= 0)
        by_hand = {int(i): np.array(p.merge(whole[starts[i] : starts[i] + lengths[i]]), np.int32) for i in np.flatnonzero(odd | ((lengths == 1) & ~one))}
        steps = []
        # long segments go through the same steps apart, as all segments of a call are relaxed place by place together
        for some in (lengths <= LONG, lengths > LONG):
            rest = np.flatnonzero(~odd & (lengths > 1) & some)
            if not len(rest):
                continue
            size = lengths[rest] + 1  # a separator after each
            n = int(size.sum())
            text = np.zeros(n, np.uint16)
            head = np.cumsum(size) - size
            offset = np.arange(n) - np.repeat(head, size)
            inner = offset < np.repeat(lengths[rest], size)
            text[inner] = char[(np.repeat(starts[rest], size) + offset)[inner]]
            last, back = self._relax(text, *self._edges(text), offset, inner, size)
            # walk all segments back from their ends together
            ends, of, k = head + lengths[rest], np.arange(len(rest)), 0
            while len(of):
                steps.append((rest[of], last[ends], k))
                ends, k = back[ends], k + 1
                go = ends > head[of]
                ends, of = ends[go], of[go]
        for of, _, _ in steps:
            counts[of] += 1
        counts[one] = 1
        for i, ids in by_hand.items():
            counts[i] = len(ids)
        out = np.zeros(int(counts.sum()), np.int32)
        to = np.cumsum(counts)
        out[to[one] - 1] = p.single[char[starts[one]]]
        for of, piece, k in steps:
            out[to[of] - 1 - k] = p.ids[piece]
        for i, ids in by_hand.items():
            out[to[i] - len(ids) : to[i]] = ids
        return out, counts

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every occurrence of every piece, by a suffix array and binary search."""
        p = self.pieces
        n = len(text)
        padded = np.concatenate([text, np.zeros(4 * p.width, np.uint16)]).astype(np.uint64)
        packed = (padded[: n + 4 * p.width - 3] << np.uint64(48)) | (padded[1 : n + 4 * p.width - 2] << np.uint64(32)) | (padded[2 : n + 4 * p.width - 1] << np.uint64(16)) | padded[3:]
        order = np.argsort(packed[:n])
        span = 4
        while span < 4 * p.width:
            ranked = packed[order] if span == 4 else key[order]
            rank = np.zeros(n + 4 * p.width, np.uint64)
            rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])).astype(np.uint64)
            key = (rank[:n] << np.uint64(32)) | rank[span : n + span]
            order = np.argsort(key)
            span *= 2
        columns = [packed[np.minimum(order + 4 * k, len(packed) - 1)] for k in range(p.width)]
        low, high = (self._search(columns, keys, right) for keys, right in ((p.keys_low, False), (p.keys_high, True)))
        counts = high - low
        piece = np.repeat(np.arange(len(p.order)), counts)
        return order[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(len(piece))], piece

    @staticmethod
    def _search(columns: list[np.ndarray], keys: np.ndarray, right: bool) -> np.ndarray:
        """For all keys together: the number of suffixes below (or, with right, not above) each."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(columns[0]))
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(columns[0]) - 1)
            less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for k, column in enumerate(columns):
                value = column[mid]
                less |= same & (value < keys[:, k])
                same &= value == keys[:, k]
            up = open_ & (less | (same if right else False))
            low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return low

    def _relax(self, text, place, piece, offset, inner, size) -> tuple[np.ndarray, np.ndarray]:
        """For each place: the last piece of the path into it, and where that piece begins."""
        p = self.pieces
        n = len(text)
        last, back = np.full(n + 1, NONE, np.int64), np.zeros(n + 1, np.int64)
        last[:n][offset == 0] = START
        end = place + p.sizes[piece]
        until = offset[place] + p.sizes[piece]
        order = np.argsort(until.astype(np.uint16) if len(until) and until.max() < 1 << 16 else until, kind="stable")
        place, piece, end, until = place[order], piece[order], end[order], until[order]
        bounds = np.searchsorted(until, np.arange(1, (int(until.max()) if len(until) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            before = last[place[a:b]]
            good = before == START
            ask = np.flatnonzero(before >= 0)
            if len(ask):
                pairs, inverse = np.unique(before[ask] * len(p.order) + piece[a:b][ask], return_inverse=True)
                good[ask] = p.compatible(pairs // len(p.order), pairs % len(p.order))[inverse]
            at = np.flatnonzero(good) + a
            last[end[at]], back[end[at]] = piece[at], place[at]
        return last, back

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (as little-endian unsigned 32-bit), round_trip (decoding gives the text), and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for some in slices(batch, 1, 512, BATCH_BYTES):
                texts = some.column(1).to_pylist()
                ids = own(texts)
                columns = [some.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)])]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    kind = dict(docs.dtypes)[id_column]
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(releasing(run), schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
