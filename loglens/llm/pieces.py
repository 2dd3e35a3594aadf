"""SentencePiece encoding and decoding through a relational lattice.

Texts are cut into units that no piece of the vocabulary can cross. Every distinct unit of the corpus is segmented once:
its bounded-length substrings are exploded and equi-joined to the piece table, the edges are grouped by unit, and a
higher-order aggregate folds them. For a unigram model the fold is Viterbi's. For a BPE model the best path by score is
not the model's own segmentation; there the fold goes through the edges by rank, start and length, and an edge is taken if
it joins exactly two of the tokens that stand so far. That is the model's segmentation where every piece in the unit is, for
itself, put together by merges of falling score (equal ones from its start), which load() checks for each piece. Characters
that are no piece become byte pieces.

The boundaries of a unit are the bits of a bigint, so the fold takes units of up to LONG characters. Longer ones (hashes,
runs without a space) and those that hold an odd piece (in the public model a run of 16 spaces) are segmented where the
lexicon is dealt out, by segment(), which is exact for all units.

The corpus is encoded in blocks of about BLOCK_CHARS characters, each with the part of the lexicon that it needs, so no
task ever holds the whole lexicon. Blocks that repeated rows have made too large are split.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import release, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG, BLOCK_CHARS, PART_CHARS, SET_BITS, GROUP_BLOCKS, FLUSH = 60, 10_000_000, 4_000_000, 60, 3840, 100_000
MAX_ODD = 20
#: What is cut, told apart, or decoded at a time; the character that marks where a text is cut.
SLICE_BYTES, SLICE_UNITS, SLICE_IDS, MARK = 2_000_000, 800_000, 250_000, "\x01"
HASH_KEYS, HASH_LIMIT = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 250_000
PARTITIONS, COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
SPACE = "▁"
LETTERS = "A-Za-zÀ-ɏ"
NORMAL, CONTROL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 3, 2, 6, 1, 2
#: An edge of a BPE lattice is a bigint: rank, start, length and piece id from the highest bits down.
ID_BITS, SIZE_BITS, START_BITS = 20, 6, 6
SIZE_AT, START_AT, RANK_AT = ID_BITS, ID_BITS + SIZE_BITS, ID_BITS + SIZE_BITS + START_BITS
NO_PIECE = (1 << ID_BITS) - 1


@dataclass(frozen=True)
class Model:
    """kind: UNIGRAM or BPE; pieces: (piece, id, score) that text can match; byte_ids: the ids of the 256 byte pieces;
    shown: for each id the bytes that it decodes to; cut: where units end, as a regular expression; odd: the BPE pieces that
    are not put together by merges of falling score."""

    kind: int
    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    shown: tuple[bytes, ...]
    longest: int
    cut: str
    odd: tuple[str, ...]


@lru_cache(maxsize=4)
def load(path: str = MODEL, kind: int | None = None) -> Model:
    """Reads a .model file; kind overrides its segmentation. Refused are models whose texts would come out differently:
    with another normalizer than identity, without a dummy prefix or with the space mark as a suffix, without byte pieces,
    with user-defined or unused pieces, with pieces that cross words or lines, and BPE models with more than MAX_ODD odd
    pieces."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = tuple((p.piece, k, p.score) for k, p in enumerate(proto.pieces) if p.type == NORMAL)
    byte_ids = tuple(k for k, p in enumerate(proto.pieces) if p.type == BYTE)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only identity normalization with a dummy prefix is supported")
    if proto.trainer_spec.treat_whitespace_as_suffix or len(byte_ids) != 256:
        raise ValueError("only space marks ahead of words and byte fallback are supported")
    if any(p.type not in (NORMAL, CONTROL, UNKNOWN, BYTE) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    if len(proto.pieces) >= NO_PIECE or max(len(p) for p, *_ in pieces) >= LONG:
        raise ValueError("too many or too long pieces")
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, *_ in pieces):
        raise ValueError("pieces must not cross words or lines")
    kind = kind or proto.trainer_spec.model_type
    index = {p: (k, s) for p, k, s in pieces}
    odd = tuple(p for p in index if not _in_order(p, index)) if kind == BPE else ()
    if len(odd) > MAX_ODD:
        raise ValueError("too many pieces are not put together by merges of falling score")
    byte_of = {k: bytes([b]) for b, k in enumerate(byte_ids)}
    text_of = {k: p.replace(SPACE, " ").encode() for p, k, _ in pieces}
    shown = tuple(byte_of.get(k) or text_of.get(k, b"") for k in range(len(proto.pieces)))
    letter = re.compile(f"[{LETTERS}]")
    crossed = {p[i] for p in index for i in range(1, len(p)) if letter.match(p[i - 1])}
    marks = "".join(re.escape(c) for c in "!#$%&()*+,./:;<=>?@[]^_`{|}~\"'-" if c not in crossed)
    cut = rf"(?={SPACE})(?<=[^{SPACE}])|(?=\n)|(?<=\n)" + (rf"|(?=[{marks}])(?<=[{LETTERS}])" if marks else "")
    return Model(kind, pieces, byte_ids, shown, max(map(len, index)), cut, odd)


def _in_order(piece: str, index: dict[str, tuple[int, float]]) -> bool:
    """Whether merging the best pair again and again, leftmost on ties, gives the piece without a score above the one before,
    and those that equal the piece's own begin where it begins."""
    parts, last, own = list(piece), float("inf"), index[piece][1]
    while len(parts) > 1:
        pairs = [(index[a + b][1], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in index]
        score, i = max(pairs, default=(float("inf"), 0))
        if score > last or (score == own and i):
            return False
        parts[-i : 2 - i], last = [parts[-i] + parts[1 - i]], score
    return True


def marked(text: Column) -> Column:
    """The text as the model sees it: a space mark ahead and for every space. Empty and NULL stay empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text == "", text).otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def segment(unit: str, model: Model, index: dict[str, tuple[int, float]]) -> list[int]:
    """Ids of one unit, in plain Python; index: piece -> (id, score)."""
    n = len(unit)
    if model.kind == BPE:
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        stop = list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and stop[j] - i <= model.longest and (got := index.get(unit[i : stop[j]])):
                heapq.heappush(heap, (-got[1], i, stop[i], stop[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not alive[i] or stop[i] != mid or mid >= n or not alive[mid] or stop[mid] != end:
                continue
            alive[mid], stop[i], after[i] = False, end, after[mid]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        bounds = [(i, stop[i]) for i in range(n) if alive[i]]
    else:
        worst = min(s for _, _, s in model.pieces) - 10
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-float("inf"), 0)] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - model.longest), e):
                got = index.get(unit[s:e])
                score = best[s][0] + (got[1] if got else worst if e - s == 1 else -float("inf"))
                if score > best[e][0]:
                    best[e] = (score, s)
        bounds, e = [], n
        while e:
            bounds.append((best[e][1], e))
            e = best[e][1]
        bounds.reverse()
    out: list[int] = []
    for s, e in bounds:
        got = index.get(unit[s:e])
        out += [got[0]] if got else [model.byte_ids[b] for b in unit[s:e].encode("utf-8", "replace")]
    return out


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """Rows (unit, ...) -> (unit, ..., edges): for a BPE model an array of packed edges, for a unigram model a map from
    start * (LONG + 1) + end to (score, id). Characters that are no piece have an edge with the id NO_PIECE. Of a unit over
    LONG characters only the first one is looked up. Units are told apart by all their columns but arrays.

    With rows partitioned by unit, neither the join (the piece table is broadcast, it has less than 2 ** ID_BITS rows) nor
    the grouping moves anything.
    """
    carried = [c for c, t in units.dtypes if t.startswith("array")]
    keys, own = [c for c in units.columns if c not in carried], [F.first(c).alias(c) for c in carried]
    ranks = {score: k for k, score in enumerate(sorted({s for *_, s in model.pieces}, reverse=True))}
    packed = [(p, float(s), k, (ranks[s] << RANK_AT) | (len(p) << SIZE_AT) | k) for p, k, s in model.pieces]
    pieces = F.broadcast(units.sparkSession.createDataFrame(packed, "piece string, score double, id int, packed bigint"))
    short, n = F.length("unit") <= LONG, F.length("unit")
    starts = F.when(short, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    size = F.when(short, F.least(F.lit(model.longest), n - F.col("s"))).otherwise(F.lit(1))
    cells = units.select("*", F.explode(starts).alias("s")).select("*", F.explode(F.sequence(F.lit(1), size)).alias("l"))
    cells = cells.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("l")))
    found = cells.join(pieces, "piece", "left").where(F.col("packed").isNotNull() | (F.col("l") == 1))
    if model.kind == BPE:
        base = F.coalesce("packed", F.lit((1 << SIZE_AT) | NO_PIECE).cast("long"))
        edge = base + F.shiftleft(F.col("s").cast("long"), START_AT)
        return found.groupBy(*keys).agg(*own, F.collect_list(edge).alias("edges"))
    at = (F.col("s") * (LONG + 1) + F.col("s") + F.col("l")).alias("at")
    value = F.struct("score", F.coalesce("id", F.lit(NO_PIECE)).alias("id")).alias("value")
    grouped = found.groupBy(*keys).agg(*own, F.collect_list(F.struct(at, value)).alias("edges"))
    return grouped.withColumn("edges", F.map_from_entries("edges"))


def _bits(edge: Column) -> tuple[Column, Column]:
    """Of an edge the two boundaries at its ends, and the boundaries inside it, as bits."""
    start = F.shiftright(edge, START_AT).bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")
    size = F.shiftright(edge, SIZE_AT).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")
    one = F.lit(1).cast("long")
    stop = F.call_function("shiftleft", one, start + size)
    return F.call_function("shiftleft", one, start) + stop, stop - F.call_function("shiftleft", one, start + 1)


def merge_fold() -> Column:
    """The tokens of a BPE segmentation from edges, as start << START_AT | id in order. The state holds a bit per boundary; an edge whose ends are boundaries
    and that has one boundary inside joins two tokens and takes that boundary away."""

    def step(state: Column, edge: Column) -> Column:
        ends, inner = _bits(edge)
        joins = (state.bitwiseAND(ends) == ends) & (F.bit_count(state.bitwiseAND(inner)) == 1)
        return F.when(joins, state.bitwiseAND(F.bitwise_not(inner))).otherwise(state)

    def tokens(state: Column) -> Column:
        def stands(edge: Column) -> Column:
            ends, inner = _bits(edge)
            return (state.bitwiseAND(ends) == ends) & (state.bitwiseAND(inner) == 0)

        place = F.lit((((1 << START_BITS) - 1) << START_AT) | NO_PIECE).cast("long")
        return F.sort_array(F.transform(F.filter("edges", stands), lambda e: e.bitwiseAND(place)))

    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.length("unit") + 1) - F.lit(1).cast("long")
    return F.aggregate(F.sort_array("edges"), every, step, tokens)


def viterbi_fold(model: Model) -> Column:
    """The tokens of the best-scoring path, as merge_fold() gives them; a character that is no piece costs 10 more than the worst piece."""
    n, worst = F.length("unit"), min(s for _, _, s in model.pieces) - 10
    edge = lambda s, e: F.try_element_at("edges", s * (LONG + 1) + e)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))

    def step(acc: Column, e: Column) -> Column:
        def arrive(s: Column) -> Column:
            own = edge(s, e)
            cost = F.when(own.isNotNull(), F.coalesce(own["score"], F.lit(float(worst))))
            return F.struct((F.get(acc, s)["score"] + cost).alias("score"), s.alias("from"))

        near = F.sequence(F.greatest(e - model.longest, F.lit(0)), e - 1)
        ways = F.filter(F.transform(near, arrive), lambda w: w["score"].isNotNull())
        top = F.reduce(ways, F.get(ways, F.lit(0)), lambda a, w: F.when(w["score"] > a["score"], w).otherwise(a))
        return F.concat(acc, F.array(top))

    def back(states: Column) -> Column:
        further = lambda b: F.concat(F.array(F.get(states, F.get(b, F.lit(0)))["from"]), b)
        walk = lambda b, _: F.when(F.get(b, F.lit(0)) <= 0, b).otherwise(further(b))

        def token(s: Column, e: Column) -> Column:
            return F.shiftleft(s.cast("long"), START_AT).bitwiseOR(edge(s, e)["id"].cast("long"))

        spans = lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), token)
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk, spans)

    return F.aggregate(F.sequence(F.lit(1), n), first, step, back)


def lexicon(units: DataFrame, model: Model) -> DataFrame:
    """Rows (unit, ...) of non-empty units -> (unit, ..., ids array<int>); ids are NULL for units over LONG characters
    and those that hold an odd piece."""
    folded = merge_fold() if model.kind == BPE else viterbi_fold(model)
    able = reduce(lambda a, b: a & ~F.contains("unit", F.lit(b)), model.odd, F.length("unit") <= LONG)
    made = lattice(units, model).select(*units.columns, F.when(able, folded).alias("tokens"))
    byte_ids = F.array(*[F.lit(k) for k in model.byte_ids])
    own_id = lambda x: x.bitwiseAND(F.lit(NO_PIECE).cast("long")).cast("int")

    def spelled(x: Column) -> Column:
        char = F.substring("unit", F.shiftright(x, START_AT).cast("int") + 1, F.lit(1))
        code = F.hex(F.encode(char, "UTF-8"))
        pairs = F.sequence(F.lit(1), F.length(code), F.lit(2))
        return F.transform(pairs, lambda i: F.get(byte_ids, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")))

    whole = F.flatten(F.transform("tokens", lambda x: F.when(own_id(x) == NO_PIECE, spelled(x)).otherwise(F.array(own_id(x)))))
    plain = F.transform("tokens", own_id)
    ids = F.when(F.exists("tokens", lambda x: own_id(x) == NO_PIECE), whole).otherwise(plain)
    return made.select(*units.columns, ids.alias("ids"))


def _bytes_of(units: pa.StringArray) -> tuple[np.ndarray, bytes]:
    """The lengths in bytes of an array's strings, and all their bytes."""
    ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    data = units.buffers()[2]
    return np.diff(ends), b"" if data is None else data.to_pybytes()[ends[0] : ends[-1]]


def _packed(units: pa.StringArray, counts: np.ndarray, values: np.ndarray) -> bytes:
    """Strings, each with a list of 32-bit numbers, compressed: lengths and numbers apart, so that they compress well."""
    lengths, data = _bytes_of(units)
    parts = [lengths.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), values.astype("<i4").tobytes(), data]
    whole = b"".join(parts)
    head = np.array([len(units), len(values), len(whole)], "<i8").tobytes()
    return head + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    n, m, size = np.frombuffer(packed[:24], "<i8").tolist()
    whole = pa.decompress(packed[24:], decompressed_size=size, codec="zstd", asbytes=True)
    numbers = np.frombuffer(whole[: 4 * (2 * n + m)], "<i4")
    ends = np.concatenate([[0], np.cumsum(numbers[:n])]).astype(np.int32)
    units = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole[4 * (2 * n + m) :]))
    return units, numbers[n : 2 * n], numbers[2 * n :]


def _cutter(cut: str) -> Callable[[pa.Array], Iterator[tuple[int, pa.Array, np.ndarray]]]:
    """Texts -> (row, units, ends) for stretches of about SLICE_BYTES of them: the first text's row, the units of all texts in
    order, and where each text's units end. It cuts where the expression does, by putting a MARK there: texts with a MARK of
    their own are cut by the expression itself."""
    rx = re.compile(cut)
    # what is cut off a letter ahead of it
    marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and len(rx.split("a" + c)) == 2)
    after = f"([{LETTERS}])([{marks}])" if marks else None

    def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        seen = pc.replace_substring(texts, " ", SPACE)
        seen = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(SPACE, texts.type), seen, pa.scalar("", texts.type)))
        if pc.any(pc.match_substring(seen, MARK)).as_py():
            found = [[u for u in rx.split(text) if u] for text in seen.to_pylist()]
            return pa.array([u for us in found for u in us], texts.type), np.cumsum([len(us) for us in found])
        runs = pc.any(pc.match_substring(seen, SPACE * 2)).as_py()
        seen = pc.replace_substring(pc.replace_substring(seen, "\n", MARK + "\n" + MARK), SPACE, MARK + SPACE)
        # a run of space marks is one unit's; each pass joins every other pair of what is left
        for _ in range(2 * runs):
            seen = pc.replace_substring(seen, SPACE + MARK + SPACE, SPACE * 2)
        if after:
            seen = pc.replace_substring_regex(seen, after, rf"\1{MARK}\2")
        lists = pc.split_pattern(seen, MARK)
        flat, offsets = lists.flatten(), np.asarray(lists.offsets)
        full = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(np.asarray(full))])[offsets[1:] - offsets[0]]
        return flat.filter(full), ends

    def stretches(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(texts))) // SLICE_BYTES
        starts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)] if len(texts) else []
        for first, stop in zip(starts, starts[1:], strict=False):
            yield first, *units_of(texts.slice(first, stop - first))

    return stretches


def _units(cut: str, n_sets: int) -> Callable:
    """(block, text) -> (unit, first, bits0, ...): the distinct units of some texts with the blocks that hold them."""
    cutter = _cutter(cut)

    def made(held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.chunked_array([units for units, _ in held]).unify_dictionaries().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        pairs = np.unique(np.asarray(coded.indices).astype(np.int64) << 32 | np.concatenate([blocks for _, blocks in held]))
        code, block = pairs >> 32, pairs & 0xFFFFFFFF
        place = block % GROUP_BLOCKS
        start = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(block - place, prepend=-1))
        bits = [np.bitwise_or.reduceat(np.where(place // SET_BITS == k, np.int64(1) << (place % SET_BITS), 0), start) for k in range(n_sets)]
        columns = [coded.dictionary.take(pa.array(code[start])).cast(pa.string()), pa.array((block - place)[start], pa.int32()), *map(pa.array, bits)]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "first", *(f"bits{k}" for k in range(n_sets))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            blocks = np.asarray(batch.column(0)).astype(np.int64)
            for first, units, ends in cutter(batch.column(1)):
                if len(units):
                    held.append((units.dictionary_encode(), np.repeat(blocks[first : first + len(ends)], np.diff(ends, prepend=0))))
                if sum(len(units) for units, _ in held) >= SLICE_UNITS:
                    yield made(held)
                    held = []
                    release()
            del batch
            release()
        if held:
            yield made(held)
        del held
        release()

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches that counts gives."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _deal(model: Model) -> Callable:
    """Lexicon rows (unit, first, bits, ids) -> (block, packed): the part of the lexicon that each block needs."""

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        whole = whole.take(pc.sort_indices(whole.column(0))).combine_chunks()
        units, lowest, bits, ids = (whole.column(k).chunk(0) for k in range(4))
        if ids.null_count:
            index, lists = {p: (k, s) for p, k, s in model.pieces}, ids.to_pylist()
            for i, unit in enumerate(units.to_pylist()):
                if lists[i] is None:
                    lists[i] = segment(unit, model, index)
            ids = pa.array(lists, pa.list_(pa.int32()))
        sets = np.asarray(bits.flatten(), dtype=np.int64).reshape(len(units), -1)
        lowest = np.asarray(lowest, dtype=np.int64)
        rows_of, flat_of = [], []
        for k in range(sets.shape[1] * SET_BITS):
            at = np.flatnonzero(sets[:, k // SET_BITS] >> (k % SET_BITS) & 1)
            rows_of.append(at)
            flat_of.append(lowest[at] + k)
        rows, flat = np.concatenate(rows_of), np.concatenate(flat_of)
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        counts, values = np.diff(np.asarray(ids.offsets)), np.asarray(ids.flatten())
        starts = np.cumsum(counts) - counts
        out = []
        for own in np.split(rows[order], first[1:]):
            at = np.repeat(starts[own], counts[own]) + _within(counts[own])
            out.append(_packed(units.take(pa.array(own)), counts[own], values[at]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH:
                yield packs(held)
                held = []
        if held:
            yield packs(held)
        del held
        release()

    return run


TEXTS = pa.schema([("row_id", pa.int64()), ("text", pa.string())])


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sub, row_id, text) -> (block, sub, packed): the rows of a block in a batch, compressed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        order = np.argsort(key, kind="stable")
        names, first = np.unique(key[order], return_index=True)
        rows = [batch.take(pa.array(x)) for x in np.split(order, first[1:])]
        packed = [_stream(pa.RecordBatch.from_arrays([x.column(2), x.column(3)], schema=TEXTS)) for x in rows]
        columns = [pa.array(names >> 32, pa.int32()), pa.array(names & 0xFFFFFFFF, pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "sub", "packed"])


def _assembler(cut: str) -> Callable:
    cutter = _cutter(cut)

    def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        parts = [_unpacked(packed.as_py()) for packed in words.column("packed")]
        known = pa.concat_arrays([units for units, _, _ in parts] or [pa.array([], pa.string())]).cast(pa.large_string())
        counts = np.concatenate([[0], *(counts for _, counts, _ in parts)]).astype(np.int64)
        values = np.concatenate([np.empty(0, "<i4"), *(values for *_, values in parts)])
        pieces = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(values, pa.int32()))
        del parts, counts, values
        read = [pa.ipc.open_stream(packed.as_buffer()).read_all() for packed in texts.column("packed")]
        whole = pa.concat_tables(read, promote_options="none").combine_chunks() if read else TEXTS.empty_table()
        del read
        ids, ends, total = [], [np.zeros(1, np.int64)], 0
        for column in whole.column("text").chunks:
            for _, units, stops in cutter(column):
                at = pc.index_in(units, value_set=known)
                if at.null_count:
                    raise KeyError("a unit is not in the lexicon of its block")
                taken = pieces.take(at)
                ids.append(taken.flatten())
                ends.append(total + np.asarray(taken.offsets).astype(np.int64)[stops])
                total += len(ids[-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.concat_arrays(ids or [pa.array([], pa.int32())]))
        made = pa.table({"row_id": whole.column("row_id"), "ids": lists})
        del whole, known, pieces, ids
        release()
        return made

    return assemble


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """rows (row_id bigint, text, ...) -> (row_id, ids array<int>), a row per row; NULL and empty texts have no ids.

    row_id names a row in the result and spreads rows over blocks; it may be NULL and may repeat. Equal rows fall into one
    block; a block of more than twice BLOCK_CHARS is split, each part with its own copy of the block's lexicon. There are
    at most as many such blocks as the corpus has times that many characters, a row of two numbers each.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks, n_parts = -(-chars // BLOCK_CHARS) or 1, -(-chars // PART_CHARS) or 1
    block = F.pmod(F.xxhash64("row_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    # the blocks of a unit are bits, as many columns of them as the corpus needs, up to GROUP_BLOCKS blocks a row
    width = min(n_blocks, GROUP_BLOCKS)
    n_sets = -(-width // SET_BITS)
    units = own.select(block, "text").mapInArrow(_units(model.cut, n_sets), "unit string, first int, " + ", ".join(f"bits{k} long" for k in range(n_sets)))
    held = units.groupBy("unit", "first").agg(*[F.bit_or(f"bits{k}").alias(f"bits{k}") for k in range(n_sets)])
    held = held.select("unit", "first", F.array(*[f"bits{k}" for k in range(n_sets)]).alias("bits"))
    wanted = {PARTITIONS: str(n_parts), COALESCE: "false", HASH_KEYS: str(HASH_LIMIT)}
    before = {k: spark.conf.get(k) for k in wanted}
    # each task groups the units of its part in memory, without sorting their edges
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        known = stored(lexicon(held, model), "lexicon")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = own.select(block, F.length("text").alias("n")).groupBy("block").agg(F.sum("n").alias("n"))
    large = sizes.where(F.col("n") > 2 * BLOCK_CHARS).select("block", F.ceil(F.col("n") / BLOCK_CHARS).cast("int").alias("subs"))
    large = F.broadcast(stored(large, "large-blocks"))
    sub = F.when(F.col("subs").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("subs")))
    texts = own.select(block, "row_id", "text").join(large, "block", "left").select("block", sub.cast("int").alias("sub"), "row_id", "text")
    words = known.select("unit", "first", "bits", "ids").mapInArrow(_deal(model), "block int, packed binary").join(large, "block", "left")
    words = words.select("block", F.explode(F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1)).alias("sub"), "packed")
    packed = texts.mapInArrow(_pack_texts, "block int, sub int, packed binary")
    both = packed.groupBy("block", "sub").cogroup(words.groupBy("block", "sub"))
    return both.applyInArrow(_assembler(model.cut), "row_id long, ids array<int>")


def _decoder(model: Model) -> Callable[[pa.ListArray], Iterator[tuple[np.ndarray, str]]]:
    """A column of ids -> the ids of each row, none for NULL, and the text that they show."""
    shown = pa.array(model.shown, pa.large_binary())

    def decoded(column: pa.ListArray) -> Iterator[tuple[np.ndarray, str]]:
        flat, ends = np.asarray(column.values, dtype="<i4"), np.asarray(column.offsets).astype(np.int64)
        size = ends[1:] // SLICE_IDS
        starts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(column)] if len(column) else []
        for first, stop in zip(starts, starts[1:], strict=False):
            own = flat[ends[first] : ends[stop]]
            found = shown.take(pa.array(own))
            places = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
            data = found.buffers()[2] if len(own) else None
            data = memoryview(data) if data is not None else memoryview(b"")
            bounds = (ends[first : stop + 1] - ends[first]).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                text = bytes(data[places[a] : places[b]])
                yield own[a:b], (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    return decoded


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(row_id, ids) -> (row_id, text): pieces and bytes joined, the mark ahead of the text taken off; bytes that are no
    UTF-8 become U+FFFD. Ids of control pieces show nothing; NULL ids give an empty text."""
    decoded = _decoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text for _, text in decoded(batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row_id", "text"])

    return encoded.select("row_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "row_id long, text string")


DIGESTS = "n_pieces long, ids_sha256 string, decoded_chars long, decoded_sha256 string"


def digests(encoded: DataFrame, model: Model, keep_ids: bool = False) -> DataFrame:
    """(row_id, ids) -> (row_id, n_pieces, ids_sha256, decoded_chars, decoded_sha256), with ids if they are to be kept: the
    number and SHA-256 (32-bit little-endian) of a row's ids, and length and SHA-256 of the text decoded from them."""
    decoded = _decoder(model)
    names = ["row_id", *(["ids"] if keep_ids else []), *(c.split()[0] for c in DIGESTS.split(", "))]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, text in decoded(batch.column(1)):
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            del rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_ids], *made], names=names)
            del batch, made
            release()

    schema = "row_id long, " + ("ids array<int>, " if keep_ids else "") + DIGESTS
    return encoded.select("row_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents digests() of its ids. NULL and empty texts have no ids and decode to an empty text; repeated
    rows and rows of equal doc_id each get a row; an empty table gives none; other columns are not read."""
    model = load()
    rows = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    return digests(encode(rows, model), model).withColumnRenamed("row_id", "doc_id")
