"""Byte-level BPE by recursive DuckDB queries inside each partition.

Encoding. A text is cut into stretches of white space and the word after it. The pattern never matches
across such a cut, so a stretch always has the same tokens, and each task encodes every distinct
stretch once (about ``KEPT`` of them are remembered). The pattern splits new stretches into pieces. A
piece that is a vocabulary entry is that token. For the others a recursive query holds the token list
of each piece; every step lays it out as token positions, joins the neighbouring pairs with the merge
table, and contracts the leftmost pair of minimum rank of each piece, until no pair is in the table.

Decoding. Ids are cut before tokens that start with white space, and after every second token, again
into stretches that occur many times; a query joins the positions of the distinct ones with the vocabulary and aggregates the bytes
in order. The text is what the stretches say one after the other.

The vocabulary is read on the driver from the path given, checked to be of at most ``MOST_TOKENS``
entries, and broadcast. Each partition opens its own in-memory DuckDB with one thread and a bounded
buffer.

Defined cases: a null text counts as empty: no tokens, the digests of no bytes; rows that repeat a
doc_id or have none are encoded one by one; an empty table gives an empty result; other columns play
no part. A step contracts one pair per piece, so a single piece of very many letters without white
space takes time in the square of its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import Powers, id_and_text, mix, slices, table

KEPT = 400_000
DECODED = 2  # tokens of one decoded stretch at most; short ones recur most
MOST_TOKENS = 1 << 20
# White space of the pattern beyond ASCII, in UTF-8; texts with it are cut by the pattern itself.
OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
PLAIN = re.compile(rb" ?[A-Za-z]+")  # stretches that are one piece of the pattern
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

ENCODE = """
WITH RECURSIVE t(w, toks, step) AS (
  SELECT w, toks, 0 FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT w, (l::BIGINT << 32) | r AS pair, i
     FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS i FROM t)
   ), best AS (  -- the smallest rank, and of equal ones the leftmost
     SELECT p.w, min(m.rank * 4294967296 + p.i) AS b FROM pairs p JOIN merges m USING (pair) GROUP BY p.w
   )
   SELECT t.w, list_concat(list_append(toks[:(b % 4294967296) - 1], (b // 4294967296)::INTEGER), toks[(b % 4294967296) + 2:]), step + 1
   FROM t JOIN best USING (w))
)
SELECT w, arg_max(toks, step) AS toks FROM t GROUP BY w ORDER BY w
"""
DECODE = """
SELECT w, string_agg(piece, '' ORDER BY i) AS bytes
FROM (SELECT w, unnest(toks) AS id, generate_subscripts(toks, 1) AS i FROM stretches) JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the token's bytes and its rank, one per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if not 256 <= len(ranks) <= MOST_TOKENS or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not a byte-level vocabulary of at most {MOST_TOKENS} tokens")
    return ranks


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class _Stretches:
    """Replaces every run of numbers by what a function says of it, asked once for each distinct run."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], unit: int, alphabet: int) -> None:
        self.learn, self.unit = learn, unit
        one = mix(np.arange(1, alphabet + 1, dtype=np.uint64))
        self.numbers = one, mix(one)
        self.powers = Powers(0xB5026F5AA96619E9), Powers(0xD1342543DE82EF95)
        self._forget()

    def _forget(self) -> None:
        """Known runs, sorted by hash: where in the store they are said, and at what length."""
        self.one = self.two = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint8 if self.unit == 1 else "<u4")

    def _keep(self, one: np.ndarray, two: np.ndarray, said: list[bytes]) -> np.ndarray:
        """Adds runs; returns their places in the store."""
        size = np.array([len(x) for x in said], np.int64) // self.unit
        at = len(self.store) + np.cumsum(size) - size
        self.store = np.concatenate([self.store, np.frombuffer(b"".join(said), self.store.dtype)])
        columns = [np.concatenate(x) for x in ((self.one, one), (self.two, two), (self.at, at), (self.size, size))]
        order = np.argsort(columns[0], kind="stable")
        self.one, self.two, self.at, self.size = (c[order] for c in columns)
        return at

    def replace(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """starts: where runs begin, in order, the first at 0; ends: how many runs each text has."""
        if not len(starts):
            return [b""] * len(ends)
        stops = np.r_[starts[1:], len(values)]
        one, two = (q.runs(q.prefix(x[values]), starts, stops) for q, x in zip(self.powers, self.numbers, strict=True))
        order = np.argsort(one)
        a, b = one[order], two[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # equal in 64 bits only
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        kind = np.empty(len(one), np.int64)
        kind[order] = np.cumsum(new) - 1
        first, a, b = order[new], a[new], b[new]
        if len(self.one) > KEPT:
            self._forget()
        place = np.minimum(np.searchsorted(self.one, a), max(0, len(self.one) - 1))
        known = (self.one[place] == a) & (self.two[place] == b) if len(self.one) else np.zeros(len(a), bool)
        at, size = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        if not known.all():
            raw, wide, missing = values.tobytes(), values.itemsize, first[~known]
            said = self.learn([raw[x:y] for x, y in zip((starts[missing] * wide).tolist(), (stops[missing] * wide).tolist(), strict=True)])
            at[~known] = self._keep(a[~known], b[~known], said)
            size[~known] = [len(x) // self.unit for x in said]
        took = size[kind]
        end = np.cumsum(took)
        out = self.store[np.repeat(at[kind] - (end - took), took) + np.arange(end[-1])]
        cut = np.r_[0, end][np.r_[0, ends]].tolist()
        return [out[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Codec:
    """Encodes and decodes texts of one partition; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        merges = np.array(rows, np.int64).reshape(-1, 3)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "80MB"})
        self._table("merges", pair=merges[:, 0] << 32 | merges[:, 1], rank=merges[:, 2])
        ids = np.fromiter(ranks.values(), np.int32)
        self._table("vocabulary", id=ids, piece=[t.decode("latin-1") for t in ranks])
        self.opens = np.zeros(int(ids.max()) + 1, bool)  # tokens that start with white space
        self.opens[[r for t, r in ranks.items() if t[:1] in b" \t\n\r\v\f"]] = True
        self.encoded, self.decoded = _Stretches(self._tokens, 4, 256), _Stretches(self._bytes, 1, len(self.opens))

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, query: str, name: str, lists: pa.ListArray) -> pa.Table:
        self.db.register(name, pa.table({"w": pa.array(np.arange(len(lists))), "toks": lists}))
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that are not in the vocabulary, some thousands at a time."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 12_000):
            some = pieces[at : at + 12_000]
            start = self.byte_tokens[np.frombuffer(b"".join(some), np.uint8)]
            found = self._ask(ENCODE, "pieces", _lists(start, [len(p) for p in some])).column("toks").combine_chunks()
            ids, ends = found.flatten().to_numpy().astype("<u4").tobytes(), found.offsets.to_numpy().astype(np.int64) * 4
            ends -= ends[0]
            out += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out

    def _tokens(self, stretches: list[bytes]) -> list[bytes]:
        whole = PLAIN.fullmatch
        split = [[s] if whole(s) else [p.encode() for p in self.find(s.decode())] for s in stretches]
        pieces = {p for ps in split for p in ps}
        ids = {p: int(self.ranks[p]).to_bytes(4, "little") for p in pieces if p in self.ranks}
        rare = list(pieces.difference(ids))
        ids.update(zip(rare, self._contract(rare), strict=True))
        return [ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for ps in split]

    def _bytes(self, stretches: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(stretches), 12_000):
            some = stretches[k : k + 12_000]
            lists = _lists(np.frombuffer(b"".join(some), "<u4").astype(np.int32), [len(s) // 4 for s in some])
            out += [b.encode("latin-1") for b in self._ask(DECODE, "stretches", lists).column("bytes").to_pylist()]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts. A run is white space and what follows it up to the next white space."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        space = SPACE[raw]
        begins = space & ~np.r_[False, space[:-1]]
        begins[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
        for text, end in zip(texts, ends.tolist(), strict=True):
            if OTHER_SPACE.search(text):
                lengths = np.cumsum([len(p.encode()) for p in self.find(text.decode())])
                begins[end - len(text) : end] = False
                begins[end - len(text) + np.r_[0, lengths[:-1]]] = True
        starts = np.flatnonzero(begins)
        return self.encoded.replace(raw, starts, np.searchsorted(starts, ends))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum([len(i) // 4 for i in ids])
        begins = self.opens[raw]
        begins[(ends - [len(i) // 4 for i in ids])[[len(i) > 0 for i in ids]]] = True
        starts = np.flatnonzero(begins)
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
        starts = np.flatnonzero(place % DECODED == 0)
        return self.decoded.replace(raw, starts, np.searchsorted(starts, ends))


def _run(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for rows, texts in slices(batches, most=3 << 19):
            codec = codec or Codec(shared.value, pattern)
            ids = codec.encode(texts)
            decoded = codec.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded bytes, one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    return id_and_text(docs).mapInArrow(_run(shared, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", *more, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_and_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))
