"""Byte-level BPE by DuckDB recursive queries, one in-memory database for each Python worker.

A text is cut at its runs of white space; each match of the vocabulary's pattern inside a cut is a word of its own. New words of a
batch become rows (word, position, token). One step of the recursive query joins neighbouring tokens to the merge
table and contracts each word's leftmost pair of minimum rank; it ends when no word has a pair. Ordered
aggregation turns token rows into byte strings again. Encoded words are kept in dictionaries of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, slim

#: White space as the vocabulary's pattern has it (Unicode's White_Space).
_GAP = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CUT = re.compile(f"[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")
#: Encoded cuts and words kept by a worker, at most, in two generations; and the longest kept.
KEPT, KEPT_CHARS = 800_000, 48
#: The recursion holds all steps of a word, so a word of n bytes takes up to n * n / 2 rows. Longer words take the same steps with a heap.
RECURSION_BYTES = 96
#: Words contracted by one recursive query.
QUERY_WORDS = 40_000
#: The part of the words kept, of a query's words and of a group's characters that lean workers handle.
LEAN = 8
#: Characters handled at once by a worker.
GROUP_CHARS = 8_000_000

#: A row is a token, its position in its word, and the position and token after it. A step finds each word's pair of minimum rank, of
#: equal ones the leftmost; the pair's first row takes the merged token, the second row goes, the row before sees the merged token.
_CONTRACT = """
WITH RECURSIVE s AS (
  SELECT word, pos, tok, lead(pos) OVER w AS npos, lead(tok) OVER w AS ntok, 0 AS step
  FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  (WITH best AS (
     SELECT s.word, min(m.rank * 128 + s.pos) AS k
     FROM s JOIN merges m ON m.l = s.tok AND m.r = s.ntok GROUP BY s.word
   ), pair AS (
     SELECT best.word, best.k % 128 AS first, CAST(best.k // 128 AS INTEGER) AS merged, s.npos AS second
     FROM best JOIN s ON s.word = best.word AND s.pos = best.k % 128
   ), step AS (
     SELECT pair.*, s.npos AS after, s.ntok AS after_tok
     FROM pair JOIN s ON s.word = pair.word AND s.pos = pair.second
   )
   SELECT s.word, s.pos,
          CASE WHEN s.pos = step.first THEN step.merged ELSE s.tok END,
          CASE WHEN s.pos = step.first THEN step.after ELSE s.npos END,
          CASE WHEN s.pos = step.first THEN step.after_tok WHEN s.npos = step.first THEN step.merged ELSE s.ntok END,
          s.step + 1
   FROM s JOIN step ON s.word = step.word WHERE s.pos <> step.second)
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM s) t
WHERE step = last GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.doc
"""


class Bpe:
    """A vocabulary in a DuckDB database, with encode and decode."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.words = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        l, r, rank = [], [], []
        for token, n in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    l.append(a), r.append(b), rank.append(n)
        self._table("merges", l=np.array(l, np.int32), r=np.array(r, np.int32), rank=np.array(rank, np.int64))
        self._table("vocab", id=np.array(list(self.ranks.values()), np.int32), hex=[t.hex() for t in self.ranks])
        self.most, self.at_once = KEPT, QUERY_WORDS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self, name: str, **columns: object) -> None:
        table = pa.table({k: pa.array(v) for k, v in columns.items()})
        self.db.register("_in", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _in")
        self.db.unregister("_in")

    def _rows(self, name: str, words: list[bytes]) -> None:
        n = np.array([len(w) for w in words])
        first = np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        self._table(name, word=np.repeat(np.arange(len(words), dtype=np.int32), n), pos=(np.arange(len(data)) - first).astype(np.int32), tok=self.byte_ids[data])

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that aren't tokens themselves."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= RECURSION_BYTES]
        for at in range(0, len(short), self.at_once):
            part = short[at : at + self.at_once]
            self._rows("start", [words[i] for i in part])
            ids = self.db.sql(_CONTRACT).to_arrow_table()["ids"].combine_chunks()
            flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
            for k, i in enumerate(part):
                out[i] = flat[4 * ends[k] : 4 * ends[k + 1]]
        for i, w in enumerate(words):
            if len(w) > RECURSION_BYTES:
                out[i] = self._contract_long(w)
        return out

    def _contract_long(self, word: bytes) -> bytes:
        """The same steps for one long word: pairs wait in a heap by rank and position; a pair that has changed is skipped."""
        ranks, n = self.ranks, len(word)
        size, before = [1] * n, list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, width = heapq.heappop(heap)
            if not size[i] or (j := i + size[i]) >= n or size[i] + size[j] != width:
                continue
            size[i], size[j] = width, 0
            if (k := i + width) < n:
                before[k] = i
            for a in (before[i], i):
                if a >= 0 and (b := a + size[a]) < n:
                    w = size[a] + size[b]
                    if (r := ranks.get(word[a : a + w])) is not None:
                        heapq.heappush(heap, (r, a, w))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : i + size[i]]])
            i += size[i]
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.young) > self.most // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        cuts = [_CUT.findall(t) for t in texts]
        fresh: dict[str, list[str]] = {}
        for c in set().union(*cuts).difference(young):
            if (ids := old.get(c)) is None:
                fresh[c] = self.words.findall(c)
            else:
                young[c] = ids
        todo: dict[str, bytes] = {}
        words: dict[str, bytes] = {}
        for w in set().union(*fresh.values()):
            if (ids := young.get(w) or old.get(w)) is not None:
                words[w] = ids
            elif (rank := self.ranks.get(b := w.encode())) is not None:
                words[w] = rank.to_bytes(4, "little")
            else:
                todo[w] = b
        for w, ids in zip(todo, self._contract(list(todo.values())), strict=True):
            words[w] = ids
        long = {c: b"".join([words[w] for w in parts]) for c, parts in fresh.items() if len(c) > KEPT_CHARS}
        young.update((w, ids) for w, ids in words.items() if len(w) <= KEPT_CHARS)
        young.update((c, b"".join([words[w] for w in parts])) for c, parts in fresh.items() if len(c) <= KEPT_CHARS)
        if not long:
            return [b"".join(map(young.__getitem__, doc)) for doc in cuts]
        return [b"".join([long[c] if len(c) > KEPT_CHARS else young[c] for c in doc]) for doc in cuts]

    def decode(self, ids: Iterable[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        ids = list(ids)
        n = np.array([len(i) // 4 for i in ids], np.int64)
        out = [b""] * len(ids)
        if n.sum():
            self._table("tokens", doc=np.repeat(np.arange(len(ids), dtype=np.int32), n), pos=np.arange(n.sum(), dtype=np.int32), id=np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            got = self.db.sql(_DECODE).to_arrow_table()
            for d, h in zip(got["doc"].to_pylist(), got["hex"].to_pylist(), strict=True):
                out[d] = bytes.fromhex(h)
        return out


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """This process's vocabulary: read once, not for each task."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def forget(path: str, pattern: str) -> None:
    """Give this process's vocabulary back."""
    if (path, pattern) in _LOADED:
        _LOADED.pop((path, pattern)).db.close()


def grouped(batches: Iterator[pa.RecordBatch], column: str, chars: int = GROUP_CHARS) -> Iterator[pa.Table]:
    """Batches put together until their texts have so many bytes; batches that are larger are cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        step = max(1, int(b.num_rows * chars / max(1, b.column(b.schema.get_field_index(column)).nbytes)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            size += part.column(part.schema.get_field_index(column)).nbytes
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and, for its text (null: empty), ids (array of int), n_tokens. A row for each row; other columns are ignored."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for t in grouped(batches, "text"):
            ids = bpe.encode(t["text"].to_pylist())
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield from pa.table({"doc_id": t["doc_id"], "ids": lists, "n_tokens": pa.array(np.diff(ends).astype(np.int64))}).combine_chunks().to_batches()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids (array of int; null: empty). Bytes of cut texts needn't be valid UTF-8."""
    python_ready(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for t in grouped(batches, "ids"):
            texts = bpe.decode(np.asarray(i or [], "<u4").tobytes() for i in t["ids"].to_pylist())
            yield from pa.table({"doc_id": t["doc_id"], "bytes": pa.array(texts, pa.binary())}).combine_chunks().to_batches()

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, lean: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: each text encoded, and its ids decoded.

    Null and empty texts have no tokens; repeated rows come out alike; words of any length are contracted whole. Other columns are
    ignored. Encoding and decoding share a worker, so ids don't cross between processes. lean: for executors that other work shares; workers
    keep and contract an eighth of the words, take texts in groups an eighth as large, and give memory back before, in and after each task.
    """
    python_ready(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = LEAN if lean else 1
        if lean:
            slim()
        bpe = loaded(path, pattern)
        bpe.most, bpe.at_once = KEPT // part, QUERY_WORDS // part
        for t in grouped(batches, "text", GROUP_CHARS // part):
            ids = bpe.encode(t["text"].to_pylist())
            back = bpe.decode(ids)
            yield pa.record_batch(
                {
                    "doc_id": t["doc_id"].combine_chunks(),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array(map(sha, ids), pa.string()),
                    "decoded_sha256": pa.array(map(sha, back), pa.string()),
                    "n_bytes": pa.array(map(len, back), pa.int64()),
                }
            )
        if lean:
            del bpe
            forget(path, pattern)
            slim()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
