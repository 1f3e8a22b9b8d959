"""SentencePiece encoding and decoding by a relational lattice.

The text, after a space in front, is cut into units wherever no piece of the model can reach across (so at the
spaces between words, at most punctuation and often inside a word), and nowhere else, so the best paths of the
units are the best path of the text. Each distinct unit of the corpus is encoded once:
its substrings of bounded length are exploded and equi-joined to the piece table, the edges found are
grouped by unit, and a fold (Spark's higher-order ``aggregate``) keeps the best-scoring path to every
position. Units of over UNIT_CHARS characters (separators, glued words) are folded in blocks of that many
positions: from block to block go the scores of the last positions that a piece can begin at, and each
position's best last piece, from which a second fold reads the path backwards; so the work stays in proportion
to the length. Characters without a piece become their UTF-8 bytes.

Texts then look their units up. The unit table is broadcast in shards of at most ``shard_bytes``. A task holds the
texts of CHUNK_BYTES and its distinct units, and with several shards opens one after another for each such chunk, so
neither rows nor ids are ever shuffled or read again.

The best path maximises the sum of the scores in the model file, as for a unigram model. For a model whose
scores are merge ranks that path is not always the one that replaying merges would give; decoding is
exact either way. Special and control pieces never match inside texts.

Defined cases: a null text has null ids and decodes to null, an empty one has none; repeated rows are
encoded alike; the model's word mark (U+2581) inside a text is coded as bytes, so decoding is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab.llm._store import materialize
from marketlab.llm._text import _BYTE, _P, _Q, U64, _pow, mix, slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK, UNIT_CHARS, SHARD_BYTES, CHUNK_BYTES, SEEN, SLICE, HASH_BITS = "▁", 64, 96 << 20, 48 << 20, 1 << 20, 1 << 18, 22
#: Units of one lattice task: their edges are grouped by hashing, in memory.
LATTICE_UNITS = 6000
#: Characters of long units in one such task, or one unit if that is longer.
LATTICE_CHARS = 1 << 15


class Pieces:
    """Pieces of a model file: text with spaces for word marks, id and score; and the ids of single bytes."""

    def __init__(self, rows: list[tuple[str, int, float]], byte_ids: list[int], size: int):
        self.rows, self.byte_ids, self.size = rows, byte_ids, size
        self.longest = max(len(p) for p, _, _ in rows)
        self.bytes_of = [b""] * size
        for p, i, _ in rows:
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([(model.id_to_piece(i).replace(MARK, " "), i, model.get_score(i)) for i in plain], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], len(ids))


class Cutter:
    """Finds units: between two characters there is a cut unless a piece of two or three characters, or four
    characters in a row of some longer piece, stand across. Hashed tables may say yes too often, which only
    leaves units longer."""

    def __init__(self, pieces: Pieces):
        texts = [p for p, _, _ in pieces.rows]
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in texts if len(p) > 1 for c in p}))}
        self.number = np.zeros(0x110000, np.uint32)
        self.number[[ord(c) for c in chars]] = list(chars.values())
        grams = {2: {p for p in texts if len(p) == 2}, 3: {p for p in texts if len(p) == 3}, 4: {p[i : i + 4] for p in texts for i in range(len(p) - 3)}}
        self.across = {}
        for n, found in grams.items():
            table = np.zeros(1 << HASH_BITS, bool)
            code = np.array([[chars[c] for c in p] for p in found], np.uint32).reshape(len(found), n)
            table[self._hash([code[:, k] for k in range(n)])] = True
            self.across[n] = table

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = columns[0].copy()
        for c in columns[1:]:
            h = h * np.uint32(0x9E3779B1) + c
        return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with a space before every text, start and end of each unit in them, its document, its fingerprint)."""
        size = np.diff(off)
        full = size > 0
        lead = np.cumsum(full)
        wide = np.full(len(data) + int(full.sum()), 32, np.uint8)
        wide[np.arange(len(data)) + np.repeat(lead, size)] = data
        edges = off + np.concatenate([[0], lead])
        chars = np.flatnonzero(wide & 0xC0 != 0x80)
        code = np.frombuffer(wide.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        number = self.number[code]
        ends = np.searchsorted(chars, edges)  # of documents, in characters
        cut = np.ones(len(chars) + 1, bool)
        inner = np.zeros(len(chars) + 1, bool)  # before each character: does a piece stand across?
        for n, table in self.across.items():
            m = len(number) - n + 1
            if m > 0:
                hit = table[self._hash([number[k : m + k] for k in range(n)])]
                for k in range(1, n):
                    over = ends - k
                    hit[over[(over >= 0) & (over < m)]] = False  # nothing stands across two documents
                for k in range(1, n):
                    inner[k : m + k] |= hit
        cut[1:-1] = ~inner[1:-1]
        cut[ends] = True
        place = np.append(chars, len(wide))[np.flatnonzero(cut)]
        start, end = place[:-1], place[1:]
        return wide, start, end, np.searchsorted(edges, start, "right") - 1, fingerprints(wide, start, end)


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _pow(_P, n + 1)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _pow(pow(_P, -1, 1 << 64), n + 1)[start] + (end - start).astype(U64) * _Q)


def gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges of source."""
    to = np.cumsum(size)
    return source[np.repeat(start - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)]


def distinct_units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, unit) of the corpus; docs: (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the model file's size

    def run(batches):
        cutter, seen, late = Cutter(shared.value), np.zeros(0, U64), []
        for batch in batches:
            for _, _, data, off in slices(batch.column("text"), SLICE):
                wide, start, end, _, key = cutter.units(data, off)
                key, first = np.unique(key, return_index=True)
                new = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key if len(seen) else np.ones(len(key), bool)
                key, first = key[new], first[new]
                late.append(key)
                if len(late) == 16:  # what the last slices share goes out more than once; the aggregation below sees to it
                    seen, late = np.unique(np.concatenate([seen, *late])) if len(seen) < SEEN else np.zeros(0, U64), []
                size = end[first] - start[first]
                values = pa.StringArray.from_buffers(len(key), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(gather(wide, start[first], size).tobytes()))
                yield pa.RecordBatch.from_arrays([values], ["unit"])
        pa.default_memory_pool().release_unused()  # this worker idles while the lattice needs the executor's memory

    def keyed(batches):  # after the shuffle, which carries the units alone
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("unit"), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(data, off[:-1], off[1:]).view(np.int64)), batch.column("unit").slice(lo, hi - lo)], ["key", "unit"])

    return docs.select("text").mapInArrow(run, "unit string").distinct().mapInArrow(keyed, "key long, unit string")


def best_paths(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids): the best-scoring segmentation of every unit."""
    spark = units.sparkSession
    units = materialize(units, "distinct")
    is_long = F.length("unit") > UNIT_CHARS
    count = units.agg(F.count(F.when(~is_long, 1)).alias("short"), F.coalesce(F.sum(F.when(is_long, F.length("unit"))), F.lit(0)).alias("chars")).first()
    # The model file's size. Strings meet by their 64-bit hashes, and then in full.
    table = F.broadcast(spark.createDataFrame(pieces.rows, "piece string, id int, score double").withColumn("hash", F.xxhash64("piece")))
    short = units.where(~is_long).repartition(count["short"] // LATTICE_UNITS + 1, "key")
    paths = _short_paths(short.select("key", "unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("i")).select("key", "i", F.expr(f"substr(unit, i, {pieces.longest})").alias("tail")), table, pieces)
    if count["chars"]:
        paths = paths.unionByName(_long_paths(units.where(is_long).repartition(count["chars"] // LATTICE_CHARS + 1, "key"), table, pieces))
    bytes_of = F.array(*(F.lit(i) for i in pieces.byte_ids))
    raw = lambda code: F.transform(_utf8(-code), lambda b: F.element_at(bytes_of, b + 1))
    plain = F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(raw(x))))
    return paths.select("key", F.when(F.exists("ids", lambda x: x < 0), plain).otherwise(F.col("ids")).alias("ids"))


def _edges(tails: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, edge) of tails: (key, i, tail), the text from each position i on as far as a piece reaches."""
    least = min(s for _, _, s in pieces.rows) - 10.0
    spots = tails.select("key", "i", "tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("l"))
    exploded = spots.select("key", "i", "l", F.expr("substr(tail, 1, l)").alias("part")).withColumn("part_hash", F.xxhash64("part"))
    edges = exploded.join(table, (exploded["part_hash"] == table["hash"]) & (exploded["part"] == table["piece"]), "left").where("id is not null or l = 1")
    # A character without a piece is its code point, negative, until the bytes replace it.
    return edges.select("key", F.struct((F.col("i") + F.col("l") - 1).alias("end"), "i", F.coalesce("score", F.lit(least)).alias("score"), F.coalesce("id", -F.ascii("part")).alias("id")).alias("edge"))


def _short_paths(tails: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids), with negative code points; tails: (key, i, tail)."""
    grouped = _edges(tails, table, pieces).groupBy("key").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # Edges come by their end, and every position ends one: ``done`` holds the best path (score and pieces) to each
    # position before that of ``now``. Of equal paths the one with the longer last piece stays.
    path = "struct<s: double, ids: array<int>>"
    fold = F.expr(f"""
        aggregate(edges,
            cast(named_struct('done', array(), 'now', named_struct('s', 0, 'ids', array())) as struct<done: array<{path}>, now: {path}>),
            (a, e) -> if(e.end > size(a.done),
                named_struct('done', array_append(a.done, a.now), 'now', if(e.i > size(a.done),
                    named_struct('s', a.now.s + e.score, 'ids', array_append(a.now.ids, e.id)),
                    named_struct('s', get(a.done, e.i - 1).s + e.score, 'ids', array_append(get(a.done, e.i - 1).ids, e.id)))),
                if(get(a.done, e.i - 1).s + e.score > a.now.s,
                    named_struct('done', a.done, 'now', named_struct('s', get(a.done, e.i - 1).s + e.score, 'ids', array_append(get(a.done, e.i - 1).ids, e.id))),
                    a)),
            a -> a.now.ids)
    """)
    return grouped.select("key", fold.alias("ids"))


def _long_paths(units: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for long units: (key, unit), dealt by key."""
    blocks = units.select("key", F.posexplode(F.expr(f"transform(sequence(1, length(unit), {UNIT_CHARS}), p -> substr(unit, p, {UNIT_CHARS + pieces.longest - 1}))")).alias("block", "text"))
    starts = blocks.select("key", "block", "text", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(UNIT_CHARS)))).alias("j"))
    tails = starts.select("key", (F.col("block") * UNIT_CHARS + F.col("j")).alias("i"), F.expr(f"substr(text, j, {pieces.longest})").alias("tail"))
    found = _edges(tails, table, pieces).groupBy("key", F.expr(f"(edge.end - 1) div {UNIT_CHARS}").alias("block")).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    grouped = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "edges"))).alias("blocks"))
    # ``scores`` are those of the positions from ``at`` on; ``back`` is the last piece (length and id) of the best path to each
    # position. Edges come by their end and the longer first, and of equal paths the first stays, as for short units.
    back = "array<struct<l: int, id: int>>"
    forward = F.expr(f"""
        aggregate(blocks,
            cast(named_struct('at', 0, 'scores', array(0), 'backs', array()) as struct<at: int, scores: array<double>, backs: array<{back}>>),
            (a, block) -> aggregate(block.edges,
                named_struct('scores', a.scores, 'back', cast(array() as {back})),
                (x, e) -> if(e.end >= a.at + size(x.scores),
                    named_struct('scores', array_append(x.scores, get(x.scores, e.i - 1 - a.at) + e.score), 'back', array_append(x.back, named_struct('l', e.end - e.i + 1, 'id', e.id))),
                    if(get(x.scores, e.i - 1 - a.at) + e.score > element_at(x.scores, -1),
                        named_struct('scores', array_append(slice(x.scores, 1, size(x.scores) - 1), get(x.scores, e.i - 1 - a.at) + e.score),
                            'back', array_append(slice(x.back, 1, size(x.back) - 1), named_struct('l', e.end - e.i + 1, 'id', e.id))),
                        x)),
                x -> named_struct('at', a.at + greatest(0, size(x.scores) - {pieces.longest}), 'scores', slice(x.scores, greatest(0, size(x.scores) - {pieces.longest}) + 1, {pieces.longest}),
                    'backs', array_append(a.backs, x.back))),
            a -> a.backs)
    """)
    # ``skip`` positions lie inside the piece taken last.
    backward = F.expr("""
        aggregate(reverse(backs),
            cast(named_struct('skip', 0, 'ids', array()) as struct<skip: int, ids: array<array<int>>>),
            (a, back) -> aggregate(reverse(back),
                named_struct('skip', a.skip, 'ids', cast(array() as array<int>)),
                (x, b) -> if(x.skip > 0, named_struct('skip', x.skip - 1, 'ids', x.ids), named_struct('skip', b.l - 1, 'ids', array_append(x.ids, b.id))),
                x -> named_struct('skip', x.skip, 'ids', array_append(a.ids, reverse(x.ids)))),
            a -> flatten(reverse(a.ids)))
    """)
    return grouped.select("key", forward.alias("backs")).select("key", backward.alias("ids"))


def _utf8(code):
    """The bytes of a code point (columns)."""
    low = lambda shift: F.lit(0x80) + F.shiftright(code, shift).bitwiseAND(F.lit(0x3F))
    return (
        F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(F.lit(0xC0) + F.shiftright(code, 6), low(0)))
        .when(code < 0x10000, F.array(F.lit(0xE0) + F.shiftright(code, 12), low(6), low(0))).otherwise(F.array(F.lit(0xF0) + F.shiftright(code, 18), low(12), low(6), low(0)))
    )


class _Directory:
    """Positions of sorted, evenly spread 64-bit keys; takes little memory beside them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, len(keys).bit_length() - 1)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.first[(keys >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        todo = np.flatnonzero(self.keys[np.minimum(at, last)] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.keys[at[todo]] < keys[todo]]
        return np.where((at <= last) & (self.keys[np.minimum(at, last)] == keys), at, -1)


def _narrow(lengths: np.ndarray) -> np.ndarray:
    """Lengths in two bytes each, unless a long unit has more pieces than they can tell."""
    return lengths.astype(np.uint32 if len(lengths) and lengths.max() > 0xFFFF else np.uint16)


def _shard_of(key, shards: int):
    return F.pmod(F.shiftright(key, 8), F.lit(shards))


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids", shard_bytes: int = SHARD_BYTES, decoded_col: str | None = None) -> DataFrame:
    """The same rows and columns, and the ids of the text's pieces in column ``ids_col``; in column ``decoded_col``, if one is named, what decode() makes of these ids."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spark = docs.sparkSession
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(4 * LATTICE_UNITS))
    try:
        table = materialize(best_paths(distinct_units(rows, pieces), pieces), "units")
    finally:
        spark.conf.set(setting, before)
    size = table.agg(F.sum(F.size("ids") * 2 + 28).alias("bytes")).first()["bytes"] or 0
    shards = -(-size // shard_bytes) or 1
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(pieces)
    units = []
    for k in range(shards):
        arrow = table.where(_shard_of(F.col("key"), shards) == k).toArrow()
        keys = arrow.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        lists = arrow.column("ids").combine_chunks().take(pa.array(order))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int16 if pieces.size <= 1 << 15 else np.int32)
        units.append(context.broadcast((keys[order], _narrow(lists.value_lengths().to_numpy(zero_copy_only=False)), flat)))
        del arrow, lists, keys, order, flat
    run, fields = _encoder(shared, units, docs.columns.index(text_col)), [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        encoded, decoded = run, _decoder(shared, 1, "decoded")
        run, fields = lambda batches: decoded(encoded(batches)), [*fields, T.StructField("decoded", T.StringType())]
    out = rows.drop("text").mapInArrow(run, T.StructType(fields))
    added = {ids_col: "ids"} | ({decoded_col: "decoded"} if decoded_col is not None else {})
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in added), *(F.col(c).alias(name) for name, c in added.items()))


def _opened(shards: list):
    """Iterates (find, starts, lengths, ids) of broadcast shards; of several only one is in memory at a time, a single one stays."""

    def table(shard):
        keys, lengths, flat = shard.value
        return _Directory(keys), np.cumsum(lengths, dtype=np.int64) - lengths, lengths, flat

    if len(shards) == 1:
        single = table(shards[0])
        return lambda: iter([single])

    def each():
        for shard in shards:
            yield table(shard)
            vars(shard).pop("_value", None)  # a broadcast keeps what it has read

    return each


def _looked_up(keys: np.ndarray, opened) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, ids): of each of the sorted keys the ids are ids[start : start + number]."""
    number, todo, found = np.zeros(len(keys), np.int64), np.arange(len(keys)), []
    for find, starts, lengths, flat in opened():
        at = find(keys[todo])
        mine = np.flatnonzero(at >= 0)
        place, at = todo[mine], at[mine]
        number[place] = lengths[at]
        found.append((place, gather(flat, starts[at], number[place])))
        todo = np.delete(todo, mine)
        del find, starts, lengths, flat
    if len(todo):
        raise RuntimeError("a unit of the text is not in the table of units")
    start = np.cumsum(number) - number
    ids = np.zeros(int(number.sum()), np.int32)
    for place, own in found:
        to = np.cumsum(number[place])
        ids[np.repeat(start[place] - to + number[place], number[place]) + np.arange(len(own))] = own
    return start, number, ids


def _encoder(shared, shards: list, text_at: int):
    def run(batches):
        cutter, opened = Cutter(shared.value), _opened(shards)

        def encoded(chunk):  # (rows, missing, units of each row, keys of the slice's units, which of them each unit is)
            keys = np.unique(np.concatenate([own for _, _, _, own, _ in chunk]))
            start, number, flat = _looked_up(keys, opened)
            for row, missing, units, own, which in chunk:
                at = np.searchsorted(keys, own)[which]
                size = number[at]
                ids = gather(flat, start[at], size)
                edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(units)])].astype(np.int32)
                offsets = pa.array(edges, mask=np.append(missing.to_numpy(zero_copy_only=False), False)) if missing.true_count else pa.array(edges)
                yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(offsets, pa.array(ids))], ["row", "ids"])

        chunk, held = [], 0
        for batch in batches:
            row = batch.column("row")
            text = row.field(text_at)
            missing = text.is_null()
            for lo, hi, data, off in slices(text, SLICE):
                _, _, _, doc, key = cutter.units(data, off)
                own, which = np.unique(key, return_inverse=True)
                chunk.append((row.slice(lo, hi - lo), missing.slice(lo, hi - lo), np.bincount(doc, minlength=hi - lo), own, which.astype(np.int32)))
                held += len(data)
                if len(shards) == 1 or held >= CHUNK_BYTES:
                    yield from encoded(chunk)
                    chunk, held = [], 0
        if chunk:
            yield from encoded(chunk)

    return run


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Strings of consecutive bytes; bytes that are no UTF-8 (ids of no text) become replacement characters."""
    raw = data.tobytes()
    out = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(raw))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        cut = edges.tolist()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])], pa.string())
    return out


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The same rows and columns, and the decoded text in column ``text_col``."""
    run = _decoder(encoded.sparkSession.sparkContext.broadcast(pieces), encoded.columns.index(ids_col), text_col)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))


def _decoder(shared, at: int, text_col: str):
    def run(batches):
        table = shared.value.bytes_of
        size_of = np.array([len(b) for b in table], np.int64)
        start_of, flat = np.cumsum(size_of) - size_of, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            column = batch.column(at)
            ids, count = column.flatten().to_numpy(zero_copy_only=False), np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            lo, edge = 0, np.concatenate([[0], np.cumsum(count)])
            while lo < len(count):  # a few hundred thousand ids at a time
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + (1 << 18), "right")) - 1)
                part = ids[edge[lo] : edge[hi]]
                data = gather(flat, start_of[part], size_of[part])
                cut = np.concatenate([[0], np.cumsum(size_of[part])])[edge[lo : hi + 1] - edge[lo]]
                full = np.diff(cut) > 0
                text = _strings(np.delete(data, cut[:-1][full]), cut - np.concatenate([[0], np.cumsum(full)]))  # without the space in front
                here = batch.slice(lo, hi - lo)
                if column.null_count:
                    text = pc.if_else(here.column(at).is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*here.columns, text], [*batch.schema.names, text_col])
                lo = hi

    return run
